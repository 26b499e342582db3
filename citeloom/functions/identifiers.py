"""Column functions over identifiers, repositories and papers.

All are built-in expressions: they fold into one code-generated stage with the
scan, need no lookup join and no Python on the executors.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.functions.registry import ACCESSION_TEST, CANONICALS, DOI_START, MENTION_TEST, NA, REGISTRY, UPPER_PREFIXES, exact_name, factored, first_prefix, known_group, literal_map

#: Every blank of any script, the characters of (?U)\s; a pattern of one of them that passes over other printable ASCII by one test.
BLANKS = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
BLANK = r"(?![!-~])[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
NA_WORDS = ("", "n/a", "na", "none", "null")
NA_LENGTH = max(map(len, NA_WORDS))
JUNK = "\"'`()[]{}.,;:"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """body(value) with the value computed once, however often body uses it.

    Column expressions that use a long one several times would be spelled out
    each time, beyond what one generated method can hold.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def first_of(items: Column, key) -> Column:
    """Array elements whose key(element) no earlier element has, in order; by a sort, not by comparing all with all."""

    def firsts(order: Column) -> Column:
        fresh = lambda x, i: F.when(i == 0, True).otherwise(~F.try_element_at(order, i)["key"].eqNullSafe(x["key"]))
        marked = F.transform(order, lambda x, i: F.when(fresh(x, i), x["at"]))
        return F.array_sort(F.filter(marked, lambda at: at.isNotNull()))

    def chosen(held: Column) -> Column:
        keyed = F.array_sort(F.transform(held, lambda x, i: F.struct(key(x).alias("key"), i.alias("at"))))
        return F.transform(let(keyed, firsts), lambda at: F.element_at(held, at + 1))

    return let(items, chosen)


def strip(c: str | Column) -> Column:
    """Without blanks (of any script) at either end; null stays null."""
    return F.btrim(col(c), F.lit(BLANKS))


def solid_ends(c: str | Column) -> Column:
    """Whether both ends are printable ASCII, as they mostly are: then there is nothing to strip."""
    c = col(c)
    last = F.substring(c, -1, 1)
    return (c >= "!") & (c < "\x7f") & (last >= "!") & (last <= "~")


def stripped(c: str | Column) -> Column:
    """strip() of a column or field, which is named several times here: the ends are looked at first, as stripping goes over the whole value."""
    return F.when(solid_ends(c), col(c)).otherwise(strip(c))


def present(c: str | Column) -> Column:
    """The stripped value, or null if that is empty."""
    return F.when(solid_ends(c), col(c)).when(strip(c) != "", strip(c))


def is_na(c: str | Column) -> Column:
    """Null, blank, or a word for 'not available'."""
    return F.coalesce(F.lower(stripped(c)), F.lit("")).isin(*NA_WORDS)


def is_doi(c: str | Column) -> Column:
    return col(c).rlike(DOI_START)


def starts_with_any(c: Column, prefixes) -> Column:
    return c.rlike("(?i)^(" + "|".join(p.replace(".", r"\.") for p in prefixes) + ")")


def bare(s: Column) -> Column:
    """A stripped identifier without junk at its ends and blanks."""
    return F.regexp_replace(F.btrim(s, F.lit(JUNK)), BLANK, "")


def without_doi(bare: Column) -> Column:
    out = F.regexp_replace(F.regexp_replace(bare, r"(?i)^doi:", ""), r"(?i)^https?://doi\.org/", "")
    out = F.regexp_replace(out, r"(?i)^10\.6019/(PXD\d+)$", "$1")
    # What begins with another letter has none of the three.
    return F.when(F.left(bare, F.lit(1)).isin("d", "D", "h", "H", "1"), out).otherwise(bare)


def upper_prefixed(x: Column) -> Column:
    return F.when(x.rlike(f"(?i)^{factored(UPPER_PREFIXES)}"), F.upper(x)).otherwise(x)


def na_word(s: Column) -> Column:
    return (F.length(s) <= NA_LENGTH) & F.lower(s).isin(*NA_WORDS)


def normalize_identifier(c: str | Column) -> Column:
    """The canonical form of a dataset identifier; N/A for missing ones, '' for blank."""

    def cleaned(s: Column) -> Column:
        return F.when(s == "", "").when(na_word(s), NA).otherwise(let(let(bare(s), without_doi), upper_prefixed))

    return let(F.coalesce(stripped(c), F.lit("")), cleaned)


def canonical_name(low: Column) -> Column:
    """The canonical name of a repository that is stripped and in lower case, or null."""
    names = lambda r: dict.fromkeys(x.lower() for x in r.names)
    # A name that holds another name of its entry is found with that.
    holds = lambda r: reduce(or_, [F.contains(low, F.lit(n)) for n in names(r) if not any(m != n and m in n for m in names(r))])
    loose = reduce(lambda w, r: w.when(holds(r), r.canonical), REGISTRY[1:], F.when(holds(REGISTRY[0]), REGISTRY[0].canonical))
    return F.coalesce(exact_name(low), loose)


def normalize_repository(c: str | Column) -> Column:
    """The canonical name: by exact name, else the first name contained, else as given."""
    return let(F.coalesce(stripped(c), F.lit("")), lambda s: F.when(s == "", "").otherwise(F.coalesce(let(F.lower(s), canonical_name), s)))


def with_normalized(rows: DataFrame, identifier: str, repository: str, given: str, named: str, no_name: str) -> DataFrame:
    """rows with both normalized as ``given`` (N/A where missing) and ``named`` (no_name where missing).

    In steps of plain columns, so that generated code does all of it: let() is
    evaluated outside of it.
    """
    rows = rows.withColumns({"_i": F.coalesce(stripped(identifier), F.lit("")), "_r": F.coalesce(stripped(repository), F.lit(""))})
    rows = rows.withColumns({"_bare": bare(F.col("_i")), "_low": F.lower("_r")})
    rows = rows.withColumn("_out", without_doi(F.col("_bare")))
    rows = rows.withColumns({given: F.when(na_word(F.col("_i")), NA).otherwise(upper_prefixed(F.col("_out"))), named: F.when(F.col("_low").isin(*NA_WORDS), no_name).otherwise(F.coalesce(canonical_name(F.col("_low")), "_r"))})
    return rows.drop("_i", "_r", "_bare", "_low", "_out")


def prefix_repository(identifier: Column) -> Column:
    """The repository an identifier's prefix tells, or null; of the first entry that has one."""
    if not any(r.prefixes for r in REGISTRY):
        return F.lit(None).cast("string")
    # One test finds the prefix, in the entries' order.
    prefix = F.upper(F.regexp_extract(identifier, first_prefix(), 1))
    return F.try_element_at(literal_map((p.upper(), r.canonical) for r in REGISTRY for p in r.prefixes), prefix)


def infer_known(identifier: Column, repository: Column) -> Column:
    """infer_repository() of values that are normalized already."""
    return F.when(repository.isin(*CANONICALS), repository).otherwise(F.coalesce(prefix_repository(identifier), F.when(is_doi(identifier) & (repository == ""), "DOI"), repository))


def infer_repository(identifier: str | Column, repository: str | Column) -> Column:
    """A known repository as given, else by prefix, else DOI by shape, else as given."""
    return let(normalize_identifier(identifier), lambda i: let(normalize_repository(repository), lambda r: infer_known(i, r)))


def url_known(identifier: Column, canonical: Column) -> Column:
    """The dataset URL of a normalized identifier in an inferred repository."""
    out = F.when((identifier == "") | (identifier == NA) | (canonical == ""), "")
    fill = lambda r: F.replace(F.lit(r.url), F.lit("{id}"), identifier)
    for r in REGISTRY:
        if r.prefixes and r.url:
            out = out.when((canonical == r.canonical) & starts_with_any(identifier, r.prefixes), fill(r))
    for r in REGISTRY:
        if not r.prefixes and r.url:
            here = canonical == r.canonical
            if "doi.org" in r.url:
                out = out.when(here & ~is_doi(identifier), "")
            out = out.when(here, fill(r))
    return out.when(~canonical.isin(*CANONICALS) & is_doi(identifier), F.concat(F.lit("https://doi.org/"), identifier)).otherwise("")


def build_dataset_url(identifier: str | Column, repository: str | Column) -> Column:
    return let(normalize_identifier(identifier), lambda i: let(normalize_repository(repository), lambda r: let(infer_known(i, r), lambda c: url_known(i, c))))


def synonym_group(c: str | Column) -> Column:
    """The group of an exact name, else the name itself in lower case."""
    low, group = F.coalesce(F.lower(stripped(c)), F.lit("")), lambda s: F.coalesce(known_group(s), s)
    # Of a plain column generated code computes it once without let(), which is evaluated outside of it.
    return group(low) if isinstance(c, str) else let(low, group)


def validate_identifier(identifier: str | Column, repository: str | Column) -> Column:
    """Whether an identifier has the shape its repository asks for."""

    def fits(i: Column, r: Column) -> Column:
        shape, seen = None, set()
        for e in REGISTRY:
            if e.shape and e.canonical not in seen:
                seen.add(e.canonical)
                test = i.rlike("(?i)" + e.shape)
                shape = F.when(r == e.canonical, test) if shape is None else shape.when(r == e.canonical, test)
        return F.when((i == "") | (r == ""), True).otherwise(F.coalesce(shape, F.lit(True)))

    return let(F.coalesce(col(identifier), F.lit("")), lambda i: let(F.coalesce(col(repository), F.lit("")), lambda r: fits(i, r)))


def evidence_inconsistent(identifier: str | Column, evidence: str | Column) -> Column:
    """Whether evidence quotes accessions but not the identifier."""
    squeeze = lambda x: F.lower(F.regexp_replace(x, BLANK, ""))

    def contradicts(i: Column, e: Column) -> Column:
        # The cheapest tests first: no accession is without a digit.
        return F.when((i == "") | (e == ""), False).otherwise(e.rlike("[0-9]") & e.rlike(ACCESSION_TEST) & ~F.contains(squeeze(e), squeeze(i)))

    return let(F.coalesce(col(identifier), F.lit("")), lambda i: let(F.coalesce(col(evidence), F.lit("")), lambda e: contradicts(i, e)))


def looks_relevant(c: str | Column) -> Column:
    """Whether a text may name a dataset; the cheapest tests come first."""
    t = F.coalesce(col(c), F.lit(""))
    low = F.lower(t)
    return F.contains(low, F.lit("doi.org")) | (F.contains(low, F.lit("available")) & (F.contains(low, F.lit("repository")) | F.contains(low, F.lit("deposited")))) | t.rlike(ACCESSION_TEST) | t.rlike(MENTION_TEST)


def normalize_doi(c: str | Column) -> Column:
    """Lower case, without scheme."""
    return F.coalesce(F.lower(strip(F.regexp_replace(strip(c), r"(?i)^(https?://doi\.org/|doi:)", ""))), F.lit(""))


def paper_key(pmcid="pmcid", pmid="pmid", paper_doi="paper_doi", paper_id="paper_id") -> Column:
    """field:value of the first identity that is set, in lower case."""
    parts = [F.concat(F.lit(f"{name}:"), F.lower(present(c))) for name, c in (("pmcid", pmcid), ("pmid", pmid), ("paper_doi", paper_doi), ("paper_id", paper_id))]
    return F.coalesce(*parts, F.lit("paper_id:"))


def slug(url: str | Column, most: int = 80) -> Column:
    """The last path segment of a URL as a file name."""
    last = F.element_at(F.split(F.regexp_replace(col(url), "/+$", ""), "/"), -1)
    return F.left(F.regexp_replace(last, r"(?U)[^\w\-.]", "_"), F.lit(most))


def sanitize_paper_id(c: str | Column) -> Column:
    return F.translate(col(c), '\\/:*?"<>|', "_________")


def safe_model(c: str | Column) -> Column:
    return F.translate(col(c), "/:", "--")


def display_model(c: str | Column) -> Column:
    return F.regexp_replace(col(c), "^[^/]*/", "")


def pmcid_from_url(url: str | Column) -> Column:
    return F.upper(F.regexp_extract(col(url), r"(?i)/(PMC\d{4,})(?:[/?#]|$)", 1))


def classify_url(url: str | Column) -> Column:
    """pmc, doi or other."""
    u = col(url)
    return F.when(u.rlike(r"(?i)PMC\d{4,}"), "pmc").when(u.rlike(r"(?i)doi\.org/") | u.rlike(r"10\.\d{4,9}/"), "doi").otherwise("other")


def pick_url(source_url="source_url", pmcid="pmcid", paper_doi="paper_doi") -> Column:
    """A paper's own URL, else one built from its identity, else null."""
    return F.coalesce(present(source_url), F.concat(F.lit("https://pmc.ncbi.nlm.nih.gov/articles/"), present(pmcid), F.lit("/")), F.concat(F.lit("https://doi.org/"), present(paper_doi)))


def metrics_file(stem: str | Column) -> Column:
    """(benchmark, model, method) from a metrics file's stem; nulls where it does not parse."""
    shape = r"^(exp|rev)_(.*?)_(datagatherer_rtr|datagatherer_fdr|fdr|rtr)$"
    part = lambda i: F.nullif(F.regexp_extract(col(stem), shape, i), F.lit(""))
    return F.struct(part(1).alias("benchmark"), part(2).alias("model"), part(3).alias("method"))


def method_from_stem(stem: str | Column) -> Column:
    s = F.regexp_replace(col(stem), "_predictions$", "")
    return F.when(s == "datagatherer", "datagatherer_rtr").otherwise(s)
