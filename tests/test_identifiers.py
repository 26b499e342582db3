import random

import pytest
from pyspark.sql import functions as F

from citeloom.functions import identifiers as fn
from citeloom.functions.registry import ACCESSION, MENTION, MENTION_TEST, REGISTRY, look_up, prompt_block, prompt_block_frame


def column(spark, make, rows, schema):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(make().alias("x")).collect()]


def test_normalize_identifier(spark):
    cases = {' "GSE123." ': "GSE123", "doi:10.5061/dryad.1": "10.5061/dryad.1", "https://doi.org/10.1/x": "10.1/x", "gse1": "GSE1", "10.6019/PXD000001": "PXD000001", "n/a": "N/A", "": "", None: "", "(na)": "na", "phs001.v1.p1": "phs001.v1.p1", "G S E 5": "GSE5", "...": ""}
    assert column(spark, lambda: fn.normalize_identifier("v"), [(k,) for k in cases], "v string") == list(cases.values())


def test_repositories(spark):
    cases = {"gene expression omnibus": "GEO", "PRIDE Archive": "PRIDE", "Harvard Dataverse": "Dataverse", "zenodo.org record": "Zenodo", "renal": "ENA", "Unknown Place": "Unknown Place", "": "", None: ""}
    assert column(spark, lambda: fn.normalize_repository("v"), [(k,) for k in cases], "v string") == list(cases.values())


@pytest.mark.parametrize(
    ("identifier", "repository", "canonical", "url"),
    [
        ("GSE1", "", "GEO", "https://www.ncbi.nlm.nih.gov/geo/query/acc.cgi?acc=GSE1"),
        ("GDS1", "", "GEO", "https://www.ncbi.nlm.nih.gov/sites/GDSbrowser?acc=GDS1"),
        ("PXD1", "ProteomeXchange", "ProteomeXchange", "https://proteomecentral.proteomexchange.org/cgi/GetDataset?ID=PXD1"),
        ("10.5281/zenodo.1", "", "DOI", "https://doi.org/10.5281/zenodo.1"),
        ("10.5281/zenodo.1", "My Lab", "My Lab", "https://doi.org/10.5281/zenodo.1"),
        ("XYZ", "My Lab", "My Lab", ""),
        ("N/A", "GEO", "GEO", ""),
        ("abc", "Zenodo", "Zenodo", ""),
    ],
)
def test_infer_and_url(spark, identifier, repository, canonical, url):
    df = spark.createDataFrame([(identifier, repository)], "i string, r string")
    assert tuple(df.select(fn.infer_repository("i", "r"), fn.build_dataset_url("i", "r")).first()) == (canonical, url)


def test_shapes_evidence_and_na(spark):
    df = spark.createDataFrame([("GSE", "GEO"), ("GSE1", "GEO"), ("GDS1", "GEO"), ("x", "DepMap"), ("", "GEO"), (None, None)], "i string, r string")
    assert [r[0] for r in df.select(fn.validate_identifier("i", "r")).collect()] == [False, True, False, True, True, True]
    df = spark.createDataFrame([("GSE1", "see GSE2"), ("GSE1", "see g s e1"), ("GSE1", "prose"), ("GSE1", None)], "i string, e string")
    assert [r[0] for r in df.select(fn.evidence_inconsistent("i", "e")).collect()] == [True, False, False, False]
    df = spark.createDataFrame([("N/A",), (" none ",), ("null",), (None,), ("nan",)], "v string")
    assert [r[0] for r in df.select(fn.is_na("v")).collect()] == [True, True, True, True, False]


def test_patterns(spark):
    df = spark.createDataFrame([("in GSE12 and phs001.v1.p1, not gse3 or E-MTAB-1",)], "t string")
    assert df.select(F.regexp_extract_all("t", F.lit(ACCESSION), F.lit(0))).first()[0] == ["GSE12", "phs001.v1.p1"]
    df = spark.createDataFrame([("in the European Genome Phenome Archive",), ("a MASSIVE tree",), ("nothing",)], "t string")
    assert [r[0] for r in df.select(F.col("t").rlike(MENTION)).collect()] == [True, True, False]


def test_synonyms_and_prompt(spark):
    df = spark.createDataFrame([("PRIDE",), ("proteomexchange",), ("SRA",), ("bioproject",), ("Own",), (None,)], "r string")
    assert [r[0] for r in df.select(fn.synonym_group("r")).collect()] == ["proteomexchange", "proteomexchange", "ncbi-sra", "ncbi-sra", "own", ""]
    assert prompt_block("    ").split("\n    ") == [r["bullet"] for r in prompt_block_frame(spark).orderBy("pos").collect()]
    assert "  - GEO: GSE####, GSM####, GPL####, GDS####" in prompt_block()


def test_names_and_urls(spark):
    df = spark.createDataFrame([("https://x.org/a b/c d/", "exp_org_m_rtr"), ("https://pmc.ncbi.nlm.nih.gov/articles/PMC12345/", "rev_m_datagatherer_fdr")], "u string, s string")
    got = df.select(fn.slug("u"), fn.classify_url("u"), fn.pmcid_from_url("u"), fn.metrics_file("s")).collect()
    assert tuple(got[0][:3]) == ("c_d", "other", "") and tuple(got[0][3]) == ("exp", "org_m", "rtr")
    assert tuple(got[1][:3]) == ("PMC12345", "pmc", "PMC12345") and tuple(got[1][3]) == ("rev", "m", "datagatherer_fdr")


def test_factored_mentions_find_what_the_list_finds(spark):
    r = random.Random(1)
    names, texts = [n for e in REGISTRY for n in e.names], []
    for _ in range(4000):
        n = r.choice(names)
        k = r.randint(0, len(n))
        texts.append((r.choice(["", "a ", "x", "("]) + r.choice([n, n.upper(), n.lower(), n[:k], n[k:], n[:k] + r.choice("aX. -") + n[k:], n + r.choice(names)]) + r.choice(["", " b", "s", ".", "9", "/"]),))
    df = spark.createDataFrame(texts, "t string").select("t", F.col("t").rlike(MENTION).alias("a"), F.col("t").rlike(MENTION_TEST).alias("b"))
    assert df.filter("a <> b").count() == 0 and 0 < df.filter("a").count() < 4000
    # A place is tried by its first letters: far fewer alternatives stand side by side.
    assert len(MENTION_TEST) < len(MENTION) * 0.9


def test_one_pattern_finds_the_prefix(spark):
    df = spark.createDataFrame([("gse1",), ("GDS2",), ("phs3",), ("e-mtab-4",), ("10.17632/x",), ("egad5",), ("none",), ("",)], "t string").select(fn.prefix_repository(F.col("t")).alias("r"))
    assert [r.r for r in df.collect()] == ["GEO", "GEO", "dbGaP", "ArrayExpress", "MendeleyData", "EGA", None, None]
    assert df._jdf.queryExecution().optimizedPlan().toString().count("RLIKE") == 0


def test_blanks_of_any_script(spark):
    every = "".join(map(chr, range(1, 0x3100)))
    df = spark.createDataFrame([(every,), (fn.BLANKS + "a b" + fn.BLANKS,)], "t string")
    got = df.select(F.regexp_replace("t", fn.BLANK, "").alias("a"), F.regexp_replace("t", r"(?U)\s", "").alias("b"), fn.strip("t").alias("s")).collect()
    assert all(r.a == r.b for r in got) and got[1].s == "a b"


def test_ends_are_looked_at_first(spark):
    ends = ["", "a", "~", "!", "\x7f", "\xa0", "\u2003", "é", "\U0001f600", " ", "\t", "\x00", "\x1f"]
    df = spark.createDataFrame([(a + m + b,) for a in ends for m in ("", "x y", "é") for b in ends] + [(None,)], "t string")
    same = df.select(fn.stripped("t").eqNullSafe(fn.strip("t")).alias("a"), fn.present("t").eqNullSafe(F.nullif(fn.strip("t"), F.lit(""))).alias("b"))
    assert same.filter("not (a and b)").count() == 0


def test_look_up_by_length(spark):
    pairs = [("a", "1"), ("b", "2"), ("a", "3"), ("éé", "4"), ("abcd", "5"), ("", "6")]
    df = spark.createDataFrame([(k,) for k in ("a", "b", "c", "éé", "éa", "abcd", "abcde", "", None)], "k string")
    assert [r.v for r in df.select(look_up(pairs, F.col("k")).alias("v")).collect()] == ["1", "2", None, "4", None, "5", None, "6", None]
    assert df.select(look_up([], F.col("k")).alias("v")).filter("v is not null").count() == 0


def test_normalized_in_steps(spark):
    r = random.Random(2)
    ids = ["GSE1", " gse2. ", "(PXD3)", "10.6019/PXD4", "https://doi.org/10.5281/zenodo.5", "doi:10.1/x", "n/a", "N/A ", "", None, " ", "phs1.v1", "(na)", "\xa0e-mtab-1\u2003", "'", "DOI: 10.1/ y"]
    names = ["GEO", " ncbi geo ", "zenodo.org record", "Renal", "none", "", None, "\tNowhere", "PRIDE Archive", "é"]
    rows = spark.createDataFrame([(r.choice(ids), r.choice(names)) for _ in range(400)], "i string, n string")
    made = fn.with_normalized(rows, "i", "n", "given", "named", "none")
    want = made.select(F.when(fn.is_na("i"), "N/A").otherwise(fn.normalize_identifier("i")).eqNullSafe(F.col("given")).alias("a"), F.when(fn.is_na("n"), "none").otherwise(fn.normalize_repository("n")).eqNullSafe(F.col("named")).alias("b"))
    assert want.filter("not (a and b)").count() == 0 and made.columns == ["i", "n", "given", "named"]
    # Generated code does all of it.
    assert "lambda" not in made._jdf.queryExecution().optimizedPlan().toString()
