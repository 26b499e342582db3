import pytest
from pyspark.sql import functions as F

from citeloom.operators import candidates, extract, flatten, match, metrics, report, sections
from citeloom.plans.pipeline import Pipeline, evaluate, passages_pipeline
from citeloom.sources import readers, sinks
from citeloom.streaming.ingest import stream_papers, stream_predictions, write_stream

RAW = "paper_id string, paper_doi string, pmcid string, pmid string, dataset_references " + flatten.ITEMS


def item(i, r="", e="", c="high", n=""):
    return (i, r, e, c, n)


def test_flatten(spark):
    rows = [
        ("p1", "", "PMC1", "", [item("gse1", "GEO"), item("GSE1", "Gene Expression Omnibus"), item("GSE", "GEO"), item("GSE9", "", "only GSE8 here"), item("PXD1"), item("10.6019/PXD1", "ProteomeXchange")]),
        ("p2", None, "", "", []),
        ("p3", "", "", "", [item("n/a", "GEO"), item("none", "geo")]),
        ("p4", "", "", "", None),
        ("p5", "", "", "", [item("GDS1", "GEO")]),
    ]
    got = [(r.paper_id, r.dataset_identifier, r.repository, r.confidence) for r in flatten.flatten_references(spark.createDataFrame(rows, RAW)).orderBy("paper_id", "dataset_identifier").collect()]
    assert got == [("p1", "GSE1", "GEO", "high"), ("p1", "PXD1", "PRIDE", "high"), ("p2", "N/A", "N/A", ""), ("p3", "N/A", "GEO", ""), ("p4", "N/A", "N/A", ""), ("p5", "N/A", "N/A", "")]


IDS = "paper_id string, pmcid string, pmid string, paper_doi string, dataset_identifier string, repository string, row_id long"


def both(spark):
    truth = spark.createDataFrame([("a", "PMC1", "", "10.1/a", "GSE1", "GEO", 1), ("b", "", "22", "10.1/b", "PXD2", "PRIDE", 2), ("c", "PMC3", "", "", "MSV3", "MassIVE", 3)], IDS)
    pred = spark.createDataFrame([("x", "PMC1", "", "", "gse1", "GEO", 1), ("y", "", "", "10.1/C", "zz", "GEO", 2), ("z", "", "22", "", "PXD2", "ProteomeXchange", 3)], IDS)
    return pred, truth


def test_match_and_metrics(spark):
    out = evaluate(*both(spark))
    assert tuple(out["pair_micro"].first()) == (2, 1, 1, 0.6667, 0.6667, 0.6667)
    assert out["triple_micro"].first().tp == 2
    assert out["pair_macro"].first().n_papers == 4
    assert {r.bucket: r["count"] for r in out["pair_failures"].groupBy("bucket").count().collect()} == {"missed": 1, "incomplete": 1}
    pred, truth = both(spark)
    wrong = pred.filter("row_id = 1").withColumn("repository", F.lit("PDB"))
    assert metrics.micro_metrics(match.match(wrong, truth)).first().tp == 1
    assert metrics.micro_metrics(match.match(wrong, truth, True)).first().tp == 0
    assert match.prediction_status(wrong, truth).first().status == "REPO-MISMATCH"
    nothing = pred.limit(0)
    assert tuple(metrics.macro_metrics(match.match(nothing, truth.limit(0))).first()) == (0, 0.0, 0.0, 0.0)


def test_passages(spark):
    rows = [
        ("We used GSE1.\n\nNothing.\n\nStored in PRIDE.", "Results", "abs", "full"),
        ("plain text", "Intro", "An abstract", "the body " * 10),
        ("x" * 30_000, "Methods", "", ""),
        (None, None, None, None),
    ]
    df = spark.createDataFrame(rows, "body string, title string, abstract string, full_text string")
    df = df.withColumn("sections", F.array(F.struct(F.col("title").alias("section_title"), F.col("body").alias("section_text"), F.lit("").alias("section_path"), F.lit(None).cast("int").alias("page"))))
    got = [r[0] for r in candidates.select_passages(df).select("candidate_passages").collect()]
    assert got[0] == "### Results\nWe used GSE1.\n\n### Results\nStored in PRIDE.\n\n### Results\nWe used GSE1.\n\nNothing.\n\nStored in PRIDE."
    assert got[1].startswith("### Abstract\nAn abstract\n\n### [fallback: tail of paper body]\nthe body")
    assert len(got[2]) == 24_000 + len(candidates.CUT_MARK) and got[3] == ""


def test_html_and_jats(spark):
    html = "<html><head><title>t</title></head><body><!-- c --><h1>Title &amp; more</h1><script>x</script><p>One PMC12345</p><h2>Data</h2><p>Two</p><li>Three</li><figcaption>Cap</figcaption></body></html>"
    jats = '<article><front><article-meta><article-id pub-id-type="pmc">777</article-id><article-id pub-id-type="doi">10.1/x</article-id><title-group><article-title>T</article-title></title-group><abstract><p>Abs</p></abstract></article-meta></front><body><sec><title>Results</title><p>R</p><sec><title>Inner</title><p>I</p></sec></sec><sec><title>Funding</title><p>F</p></sec></body></article>'
    raw = spark.createDataFrame([(html, "h", "h.html"), (jats, "j", "j.xml"), ("<article><p>broken", "b", "b.xml"), (None, "n", "n.html")], "content string, paper_id string, source_path string")
    got = {r.source_path: r for r in sections.parse_documents(raw).collect()}
    assert [(s.section_title, s.section_text) for s in got["h.html"].sections] == [("Title & more", "One PMC12345"), ("Data", "Two\nThree\n[CAPTION] Cap")]
    assert got["h.html"].title == "Title & more" and got["h.html"].paper_id == "PMC12345"
    assert [(s.section_title, s.section_path) for s in got["j.xml"].sections] == [("Results", "body/sec[1]"), ("Inner", "body/sec[1]/sec[1]")]
    assert (got["j.xml"].paper_id, got["j.xml"].abstract) == ("PMC777", "Abs") and set(got) == {"h.html", "j.xml", "b.xml", "n.html"}


def test_page_sections(spark):
    pages = spark.createDataFrame([("a", 1, "A Title\nAbstract\nsome words\n1 Introduction\nbody"), ("a", 2, "more\nReferences\n[1] cut")], "path string, page int, text string")
    got = [(r.section_title, r.section_text, r.page) for r in sections.page_sections(pages).orderBy("ordinal").collect()]
    assert got == [("", "A Title", None), ("Abstract", "some words", 1), ("1 Introduction", "body\nmore", 1)]


def test_page_papers(spark, tmp_path):
    pages = spark.createDataFrame([("in/a.pdf", 2, "more\nReferences\n[1] cut 10.1234/abc"), ("in/a.pdf", 1, "\n A Title \nAbstract\nsome words\n\nend\n1 Introduction\nsee PMID: 12345"), ("b.pdf", 1, None), ("c.pdf", 1, "References\nall cut")], "path string, page int, text string")
    got = {r.source_path: r for r in sections.parse_pages(pages).collect()}
    a = got["in/a.pdf"]
    assert (a.paper_id, a.paper_doi, a.pmid, a.title, a.abstract) == ("12345", "10.1234/abc", "12345", "A Title", "some words\n\nend")
    assert [(s.section_title, s.section_path, s.page) for s in a.sections] == [("", "body/sec[0]", None), ("Abstract", "body/sec[1]", 1), ("1 Introduction", "body/sec[2]", 1)]
    assert a.full_text == "A Title\nAbstract\nsome words\n\nend\n1 Introduction\nsee PMID: 12345\nmore"
    assert (got["b.pdf"].paper_id, got["b.pdf"].full_text, got["b.pdf"].title) == ("b", "", "") and got["c.pdf"].full_text == "References\nall cut"
    (tmp_path / "x.pdf").write_bytes(b"first page|Abstract\nGSE1")
    (tmp_path / "y.html").write_bytes(b"<p>caf\xc3\xa9 \xff ok</p>")
    (tmp_path / "z.xml").write_text("<article><p>broken <b></p>")
    files = readers.paper_files(spark, str(tmp_path))
    papers = {r.source_path.rsplit("/", 1)[1]: r for r in sections.parse_files(files, lambda data: data.decode().split("|")).collect()}
    assert papers["x.pdf"].abstract == "GSE1" and papers["y.html"].full_text == "café ok" and papers["z.xml"].full_text == "broken"
    with pytest.raises(Exception, match="no reader"):
        sections.parse_files(files).collect()
    with pytest.raises(Exception, match="unsupported file type"):
        sections.parse_files(spark.createDataFrame([("a.doc", "a", b"")], "source_path string, paper_id string, bytes binary")).collect()


def test_html_parts(spark):
    page = "<body><title>stray</title><header><p>kept</p></header><main class='x'><h2>Empty</h2><h2>Data</h2><aside><p>aside too</p></aside><span class='the abstract'>short</span></main><p>outside</p><meta name=a><input><img src=x>"
    jats = '<article><front><notes notes-type="data"><sec><p>one</p><p>two</p></sec></notes></front><body><sec><title>R</title><boxed-text>b</boxed-text><fig><label>1</label><caption><p>C</p></caption></fig></sec></body><back><ref-list><ref>no</ref></ref-list><fn><p>foot</p></fn><sec><p>S</p></sec></back></article>'
    raw = spark.createDataFrame([(page, "p", "p.html"), (jats, "j", "j.xml")], "content string, paper_id string, source_path string")
    got = {r.source_path: r for r in sections.parse_documents(raw).collect()}
    p, j = got["p.html"], got["j.xml"]
    assert p.title == "stray" and p.abstract == "short"
    assert [(s.section_title, s.section_text, s.section_path) for s in p.sections] == [("Empty", "", "body/sec[1]"), ("Data", "aside too", "body/sec[2]")]
    assert [(s.section_title, s.section_text, s.section_path) for s in j.sections] == [("data", "one\ntwo", "front/notes[1]"), ("R", "b\n[CAPTION] C", "body/sec[1]"), ("[fig]", "C", "fig"), ("", "S", "back/sec[1]"), ("[footnote]", "foot", "back/fn[1]")]


def test_extractors(spark):
    papers = spark.createDataFrame([("p", "", "", "", "GSE1 and GSE1, PXD22"), ("q", "", "", "", "boom"), ("r", "", "", "", None)], "paper_id string, paper_doi string, pmcid string, pmid string, full_text string")
    assert [len(r.dataset_references) for r in extract.extract_by_pattern(papers, "full_text").orderBy("paper_id").collect()] == [2, 0, 0]

    def client(text, paper):
        if text == "boom":
            raise ValueError("no")
        return [{"dataset_identifier": "GSE1"}] if text else []

    assert [r.status for r in extract.extract_with_status(papers, client).orderBy("paper_id").collect()] == ["ok", "error: no", "no_predictions"]


def test_truth_columns(spark):
    df = spark.createDataFrame([("123456", "https://doi.org/10.1/AB", "gse5", "ncbi geo"), (None, "", "none", None)], "PMCID string, DOI string, accession string, database string")
    got = [tuple(r) for r in readers.normalize_truth(df).collect()]
    assert got == [("PMC123456", "PMC123456", "", "10.1/ab", "GSE5", "GEO", ""), ("", "", "", "", "N/A", "N/A", "")]


def test_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.HTML").write_text("<p>x</p>" * 30)
    (tmp_path / "in" / "b.txt").write_text("x")
    files = readers.paper_files(spark, str(tmp_path / "in"))
    assert [r.paper_id for r in files.collect()] == ["a"] and readers.has_papers(spark, str(tmp_path / "in"))
    assert readers.paper_texts(files).first().content.startswith("<p>")
    (tmp_path / "t.csv").write_text("PMCID,accession\n1,GSE1\n2,\n")
    assert [r.dataset_identifier for r in readers.read_truth(spark, str(tmp_path / "t.csv")).collect()] == ["GSE1", "N/A"]
    (tmp_path / "t.json").write_text('{"rows": [{"pmcid": "1", "id": "GSE2"}]}')
    assert readers.read_truth(spark, str(tmp_path / "t.json")).first().dataset_identifier == "GSE2"
    (tmp_path / "u.txt").write_text("# c\n\nhttp://a/b\nhttp://c/d\n")
    urls = readers.url_lines(spark, str(tmp_path / "u.txt"))
    assert readers.collect_urls(spark, urls, urls).count() == 2
    sinks.write_json_lines(spark.createDataFrame([("é", None)], "a string, b string"), str(tmp_path / "out"))
    assert '{"a":"é","b":null}' in "".join(p.read_text() for p in (tmp_path / "out").glob("part-*"))
    got = readers.fetch(urls, lambda u: u.upper() if u.endswith("b") else 1 / 0, tries=2).orderBy("source_url").collect()
    assert got[0].content == "HTTP://A/B" and got[1].error


def test_pipeline_and_stream(spark, tmp_path):
    schema = "paper_id string, paper_doi string, pmcid string, pmid string, abstract string, full_text string, sections " + candidates.SECTION
    papers = spark.createDataFrame([("p", "", "", "", "GSE77 is deposited", "", [])], schema)
    plan = passages_pipeline(folder=str(tmp_path / "run"))
    assert plan.run(papers).first().dataset_identifier == "GSE77"
    assert plan.run(papers, resume=True).first().dataset_identifier == "GSE77"
    assert Pipeline([("same", lambda d: d)]).run(papers).count() == 1
    papers.write.parquet(str(tmp_path / "s"))
    write_stream(stream_predictions(stream_papers(spark, str(tmp_path / "s"), schema)), str(tmp_path / "o"), str(tmp_path / "c")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "o")).first().dataset_identifier == "GSE77"


def test_reports(spark):
    m = spark.createDataFrame([("b", "m", "x", "f1", 0.5), ("b", "m", "y", "f1", 0.5), ("b", "m", "z", "f1", 0.1)], "benchmark string, model string, method string, metric string, value double")
    best = report.best_in_group(m)
    assert sorted((r.method, r.best) for r in best.collect()) == [("x", True), ("y", True), ("z", False)]
    assert "**0.5000**" in report.markdown_table(best.select("method", "value", "best"), {"value": "best"})
    runs = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("a", float("nan")), ("b", 2.0)], "k string, value double")
    got = {r.k: (r["mean"], r["std"], r.n) for r in metrics.run_statistics(runs, ["k"]).collect()}
    assert got["a"][0] == 2.0 and got["a"][2] == 2 and got["b"][1] != got["b"][1]


def test_flatten_by_window_normalizes_once(spark):
    refs = [(n, "", "", "", pos, *item) for n, items in (("a", [("GSE1", "GEO"), ("gse1", "NCBI GEO"), ("n/a", "")]), ("b", [("GSEx", "GEO"), ("bad", "GEO")]), ("c", [("GSEx", "GEO"), ("PXD2", "")]), ("d", [("na", "PRIDE")])) for pos, item in enumerate(items)]
    rows = spark.createDataFrame(refs, "paper_id string, paper_doi string, pmcid string, pmid string, pos int, dataset_identifier string, repository string")
    flat = flatten.flatten_by_window(rows)
    got = sorted((r.paper_id, r.dataset_identifier, r.repository) for r in flat.collect())
    assert got == [("a", "GSE1", "GEO"), ("a", "N/A", "N/A"), ("b", "N/A", "N/A"), ("c", "PXD2", "PRIDE"), ("d", "N/A", "PRIDE")]
    plan = flat._jdf.queryExecution().optimizedPlan().toString()
    # One pass over the input, whose rows are normalized once: no join, no union.
    assert "Join" not in plan and "Union" not in plan and plan.count("LogicalRDD") == 1


def test_references_move_as_numbers(spark, tmp_path):
    from citeloom.plans import queries

    line = "cast(id div 4 as bigint) as l_orderkey, id * 7 % 50 as l_partkey, id % 9 as l_suppkey, cast(id % 3 as int) as l_linenumber, double(id % 5) as l_quantity, 1d as l_extendedprice, 0d as l_discount, 0d as l_tax, 'N' as l_returnflag, 'O' as l_linestatus, timestamp '1995-01-01' as l_shipdate"
    spark.range(400).selectExpr(*[c.strip() for c in line.split(", ")]).write.parquet(str(tmp_path / "lineitem.parquet"))
    refs = queries.v_refs(spark, str(tmp_path))
    want = spark.sql("with " + queries.REFS_CTE.replace("from lineitem", "from {lineitem}") + " select * from refs", lineitem=spark.read.parquet(str(tmp_path / "lineitem.parquet")))
    assert refs.columns == want.columns and refs.count() == 400 and refs.exceptAll(want).count() == 0
    below = refs._jdf.queryExecution().optimizedPlan().toString().split("Window")[1]
    assert "CASE" not in below and "concat" not in below
    # A paper's references are grouped where they were numbered.
    assert queries.nested(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
