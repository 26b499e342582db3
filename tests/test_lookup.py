"""The automaton against the rules as they are worded, and against the expressions."""

import random
import re

from pyspark.sql import functions as F

from citeloom.functions import identifiers as fn
from citeloom.functions.lookup import Registry, look_up, look_up_repository
from citeloom.functions.registry import REGISTRY


def by_the_rules(identifier, name):
    """(name, repository, url) entry by entry, no tables."""
    low, canonical = name.lower(), name
    for test in (lambda n: n.lower() == low, lambda n: n.lower() in low):
        hit = next((r for r in REGISTRY if any(test(n) for n in r.names)), None) if low else None
        if hit:
            canonical = hit.canonical
            break
    doi = bool(re.match(r"10\.\d{4,9}/", identifier))
    starts = lambda r: any(identifier.upper().startswith(p.upper()) for p in r.prefixes)
    repo = canonical
    if canonical not in {r.canonical for r in REGISTRY}:
        repo = next((r.canonical for r in REGISTRY if starts(r)), canonical or ("DOI" if doi else ""))
    own = [r for r in REGISTRY if r.canonical == repo]
    if identifier in ("", "N/A") or not repo:
        url = ""
    elif not own:
        url = f"https://doi.org/{identifier}" if doi else ""
    else:
        template = next((r.url for r in own if r.url and starts(r)), None)
        if template is None:
            template = next((r.url for r in own if r.url and not r.prefixes), "")
            template = "" if "doi.org" in template and not doi else template
        url = template.replace("{id}", identifier)
    return canonical, repo, url


def samples():
    r = random.Random(6)
    names = [n for e in REGISTRY for n in e.names]
    prefixes = [p for e in REGISTRY for p in e.prefixes]
    odd = ["", "a", "archive ", "the ", " of data", "é", "İ", ".", "www.", "geo", "pr", "ide"]

    def some_name():
        n = r.choice(names)
        n = r.choice([n, n.upper(), n.lower(), n[: r.randint(0, len(n))], n[r.randint(0, len(n)) :]])
        return "".join(r.choice([r.choice(odd), n, r.choice(names)]) if r.random() < 0.4 else n for _ in range(r.randint(1, 2))).strip()

    def some_id():
        return r.choice(["", "N/A", "10.5281/zenodo.1", "10.6019/PXD1", "10.17632/x", "XYZ1", *[r.choice([p, p.lower()]) + str(r.randint(0, 999)) for p in r.sample(prefixes, 6)], *[p[:-1] for p in r.sample(prefixes, 2)]])

    return [(i, some_id(), some_name()) for i in range(4000)]


def test_against_the_rules(spark):
    registry = Registry()
    for _, i, n in samples():
        is_doi = bool(re.match(r"10\.\d{4,9}/", i))
        name = registry.name(n) if n else ""
        repo = registry.repository(i, name, is_doi)
        assert (name, repo, registry.url(i, repo, is_doi)) == by_the_rules(i, n), (i, n)


def test_against_the_expressions(spark):
    rows = [*samples(), (5000, None, None), (5001, " gse1. ", "  "), (5002, "n/a", "GEO"), (5003, "https://doi.org/10.5281/ZENODO.1", None)]
    df = spark.createDataFrame(rows, "n int, i string, r string").repartition(3)
    both = df.select("n", "i", "r", look_up_repository("r").alias("name"), look_up("i", "r").alias("f"), fn.normalize_repository("r").alias("name_"), fn.infer_repository("i", "r").alias("repo_"), fn.build_dataset_url("i", "r").alias("url_"))
    assert both.filter("name <> name_ or f.repository <> repo_ or f.url <> url_").limit(5).collect() == []
    assert both.filter(F.col("name").isNull() | F.col("f.url").isNull()).count() == 0 and both.count() == len(rows)
    assert df.limit(0).select(look_up("i", "r").alias("f")).count() == 0
