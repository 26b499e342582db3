"""Registry look-ups by one automaton, in Arrow batches.

The functions of identifiers spell the registry out as expressions, over a
hundred tests for a name that no entry has. Here all names are one multi-pattern
automaton, which reads a string once however many names there are, and prefixes
are a table by length. A batch's repository strings are few, so each different
one is looked up once. The automaton is built once in each Python worker.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from citeloom.functions.identifiers import col, normalize_identifier, strip
from citeloom.functions.registry import NA, REGISTRY, Repository
from citeloom.session import reach_workers

FOUND = "struct<repository:string,url:string>"


class Registry:
    """Names, prefixes and templates of registry entries, ready to be looked up."""

    def __init__(self, entries: tuple[Repository, ...] = REGISTRY):
        self.entries = entries
        self.exact: dict[str, int] = {}
        self.prefixes: dict[str, int] = {}
        for i, r in enumerate(entries):
            for name in r.names:
                self.exact.setdefault(name.lower(), i)
            for prefix in r.prefixes:
                self.prefixes.setdefault(prefix.upper(), i)
        self.lengths = sorted({len(p) for p in self.prefixes})
        self.names = ahocorasick.Automaton()
        for name, i in self.exact.items():
            self.names.add_word(name, i)
        self.names.make_automaton()
        self.of = {}
        for i, r in enumerate(entries):
            self.of.setdefault(r.canonical, []).append(i)

    def name(self, given: str) -> str:
        """The canonical name: by exact name, else of the first entry that has a name inside it, else as given."""
        low = given.lower()
        at = self.exact.get(low)
        if at is None:
            at = min((i for _, i in self.names.iter(low)), default=None)
        return given if at is None else self.entries[at].canonical

    def by_prefix(self, identifier: str) -> int | None:
        """The first entry that has a prefix of the identifier."""
        upper = identifier.upper()
        return min((self.prefixes[p] for n in self.lengths if (p := upper[:n]) in self.prefixes and len(p) == n), default=None)

    def repository(self, identifier: str, known: str, is_doi: bool) -> str:
        """The repository of a normalized identifier and name: a known name, else by prefix, else DOI by shape."""
        if known in self.of:
            return known
        at = self.by_prefix(identifier)
        if at is not None:
            return self.entries[at].canonical
        return known or ("DOI" if is_doi else "")

    def url(self, identifier: str, canonical: str, is_doi: bool) -> str:
        if identifier in ("", NA) or not canonical:
            return ""
        if canonical not in self.of:
            return f"https://doi.org/{identifier}" if is_doi else ""
        own, upper = [self.entries[i] for i in self.of[canonical]], identifier.upper()
        for r in own:
            if r.url and any(upper.startswith(p.upper()) for p in r.prefixes):
                return r.url.replace("{id}", identifier)
        template = next((r.url for r in own if not r.prefixes and r.url), "")
        return "" if "doi.org" in template and not is_doi else template.replace("{id}", identifier)


@cache
def registry() -> Registry:
    return Registry()


def by_value(values: pa.Array, of: Callable[[str], str]) -> list[str]:
    """of() of each value, called once for each different one."""
    coded = values.dictionary_encode()
    known = [of(v) for v in coded.dictionary.to_pylist()]
    return [known[i] for i in coded.indices.to_pylist()]


def _reach() -> None:
    if (spark := SparkSession.getActiveSession()) is not None:
        reach_workers(spark)


def look_up_repository(c: str | Column) -> Column:
    """What normalize_repository() says, by the automaton."""
    _reach()

    @F.pandas_udf("string")
    def named(s: pd.Series) -> pd.Series:
        return pd.Series(by_value(pa.Array.from_pandas(s), registry().name))

    return named(F.coalesce(strip(c), F.lit("")))


def look_up(identifier: str | Column, repository: str | Column) -> Column:
    """(repository, url): what infer_repository() and build_dataset_url() say, by one pass over a batch."""
    _reach()

    @F.pandas_udf(FOUND)
    def found(ids: pd.Series, names: pd.Series) -> pd.DataFrame:
        r = registry()
        known, out = by_value(pa.Array.from_pandas(names), r.name), []
        dois = ids.str.match(r"(?i)10\.[0-9]{4,9}/").tolist()
        for i, n, is_doi in zip(ids.tolist(), known, dois, strict=True):
            canonical = r.repository(i, n, is_doi)
            out.append((canonical, r.url(i, canonical, is_doi)))
        return pd.DataFrame(out, columns=["repository", "url"])

    return found(normalize_identifier(col(identifier)), F.coalesce(strip(repository), F.lit("")))
