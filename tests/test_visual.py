"""Pages of both sides: what they show, how they are cut, that they are whole documents."""

import re
from html.parser import HTMLParser

from pyspark.sql import functions as F

from citeloom.operators import match, visual

SIDE = "row_id long, paper_id string, pmcid string, pmid string, paper_doi string, dataset_identifier string, repository string, url string"


class Balanced(HTMLParser):
    def __init__(self):
        super().__init__()
        self.open, self.rows = [], 0

    def handle_starttag(self, tag, attrs):
        if tag != "meta":
            self.open.append(tag)
        self.rows += tag == "tr" and bool(attrs)

    def handle_endtag(self, tag):
        assert self.open.pop() == tag


def test_pages(spark, tmp_path):
    p = [(i, f"paper{i % 7}", "", "", "", f"GSE{i % 5}", "GEO" if i % 2 else "<b>&\"odd'", "https://x.org/?a=1&b=<2>" if i % 3 else "javascript:1") for i in range(600)] + [(700, "only\npredicted", "", "", "", "GSE1", "GEO", None), (701, "paper1", "", "", "", "N/A", "N/A", "")]
    t = [(i, f"paper{i % 9}", "", "", "", f"gse{i % 4}", "GEO", "") for i in range(60)]
    predictions, truth = spark.createDataFrame(p, SIDE), spark.createDataFrame(t, SIDE)
    rows = visual.visual_rows(predictions, truth)
    status = {("prediction", r.row_id): r.status for r in match.prediction_status(predictions, truth).collect()} | {("truth", r.row_id): r.status for r in match.truth_status(predictions, truth).collect()}
    got = {(r.side, r.row_id): r for r in rows.collect()}
    assert {k: r.status for k, r in got.items()} == status and ("prediction", 701) not in got
    for r in got.values():
        assert (r.picked is not None) == (r.side == "prediction" and r.status != "FP")
        assert r.picked is None or (got["truth", r.picked].paper, got["truth", r.picked].identifier.lower()) == (r.paper, r.identifier.lower())
    blocks = visual.visual_blocks(rows)
    sizes = blocks.select(*[F.sum(f"`{s}`").alias(s) for s in visual.STATUSES]).first().asDict()
    assert sizes == {s: list(status.values()).count(s) for s in visual.STATUSES}
    assert blocks.filter("paper = 'paper_id:paper1'").count() == 3  # cut at every 256 rows
    named = blocks.withColumns({"benchmark": F.lit("exp"), "model": F.lit("m"), "method": F.lit("rtr")})
    both = named.unionByName(named.withColumns({"model": F.lit("other"), "method": F.lit("fdr")}))
    pages = visual.write_visual(spark, both, str(tmp_path / "v"), pages=4)
    assert len(pages) >= 4 and {p.split("/")[1] for p in pages} == {"model=m", "model=other"}
    rows_seen = 0
    for page in pages:
        text = (tmp_path / "v" / page).read_text()
        check = Balanced()
        check.feed(text)
        assert not check.open and text.startswith("<!doctype html>") and "<b>" not in text and 'href="javascript' not in text
        rows_seen += check.rows
    assert rows_seen == 2 * len(status)
    assert len(re.findall("<a ", (tmp_path / "v" / "index.html").read_text())) == len(pages)
