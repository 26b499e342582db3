"""The command line from a folder of papers to the report, prompts, statuses, settings."""

import json
import os
import subprocess
import sys

from pyspark.sql import functions as F

from citeloom import __main__ as app
from citeloom.functions import prompts, registry
from citeloom.functions.identifiers import first_of
from citeloom.operators import match, report
from citeloom.plans.pipeline import passages_pipeline
from citeloom.sources import sinks

IDS = "paper_id string, pmcid string, pmid string, paper_doi string, dataset_identifier string, repository string, row_id long"


def test_run_from_folder_to_report(spark, tmp_path, capsys):
    folder = tmp_path / "raw"
    folder.mkdir()
    (folder / "a.html").write_text("<html><body><h1>Paper</h1><p>PMC1234567</p><h2>Data availability</h2><p>Data are in GEO under GSE11111.</p></body></html>")
    (folder / "b.xml").write_text('<article><front><article-meta><article-id pub-id-type="pmcid">7654321</article-id></article-meta></front><body><sec><title>Methods</title><p>See PXD000222 and GSE999.</p></sec></body></article>')
    (tmp_path / "truth.csv").write_text("pmcid,accession,database\nPMC1234567,GSE11111,GEO\nPMC7654321,PXD000222,PRIDE\nPMC7654321,MSV1,MassIVE\n")
    out = str(tmp_path / "out")
    text = app.run(spark, str(folder), str(tmp_path / "truth.csv"), out, "exp", "lab/model:1")
    assert text == (tmp_path / "out" / "report.md").read_text() and "| EXP | model:1 | rtr | **0.6667** |" in text and "## Cost and time" in text
    assert text.index("model:1, rtr") < text.index("model:1, fdr")
    record = json.loads((tmp_path / "out" / "metrics" / "exp_lab-model-1_rtr.json").read_text())
    assert (record["pair_micro"]["tp"], record["pair_micro"]["fp"], record["pair_micro"]["fn"]) == (2, 1, 1)
    assert record["failures"]["missed"] == {"n": 1, "examples": [["pmcid:pmc7654321", "msv1"]]}
    runs = json.loads((tmp_path / "out" / "runs.json").read_text())["runs"]
    assert [(r["method"], r["n_papers"], r["n_predictions"]) for r in runs] == [("rtr", 2, 3), ("fdr", 2, 3)]
    assert {r.status for r in spark.read.parquet(f"{out}/status/exp_lab-model-1_rtr/truth").collect()} == {"TP", "FN"}
    # Names come from the file where a record lacks them; what is no record is left out.
    (tmp_path / "out" / "metrics" / "rev_m_fdr.json").write_text(json.dumps({"pair_micro": {"precision": 0.5, "recall": 0.5, "f1": 0.5}}))
    (tmp_path / "out" / "metrics" / "broken.json").write_text("{")
    loaded = report.report_order(report.load_metrics(spark, f"{out}/metrics")).collect()
    assert [(r.benchmark, r.label) for r in loaded] == [("exp", "rtr"), ("exp", "fdr"), ("rev", "fdr")]
    same = app.compare(spark, *[str(tmp_path / "out" / "metrics" / "exp_lab-model-1_rtr.json")] * 2)
    assert same.endswith("tie on pair F1") and "failures.missed" in same
    assert app.main(["report", "--metrics", f"{out}/metrics", "--output", f"{out}/again.md"]) == 0 and "REV" in capsys.readouterr().out
    sinks.write_text(spark, "é", f"{out}/x.txt")
    assert (tmp_path / "out" / "x.txt").read_text() == "é"


def test_truth_status(spark):
    truth = spark.createDataFrame([("a", "PMC1", "", "", "GSE1", "GEO", 1), ("a", "PMC1", "", "", "GSE1", "GEO", 2), ("a", "PMC1", "", "", "GSE2", "PRIDE", 3), ("a", "PMC1", "", "", "GSE2", "PDB", 4), ("a", "PMC1", "", "", "GSE3", "GEO", 5)], IDS)
    pred = spark.createDataFrame([("x", "PMC1", "", "", "gse1", "Gene Expression Omnibus", 1), ("x", "PMC1", "", "", "GSE2", "MassIVE", 2), ("x", "PMC1", "", "", "N/A", "", 3)], IDS)
    got = {r.row_id: r.status for r in match.truth_status(pred, truth).collect()}
    assert got == {1: "TP", 2: "REPO-MISMATCH", 3: "TP", 4: "REPO-MISMATCH", 5: "FN"}
    assert {(r.side, r.status): r.n for r in match.status_tally(pred, truth).collect()}["prediction", "REPO-MISMATCH"] == 1
    assert match.truth_status(pred.limit(0), truth).filter("status = 'FN'").count() == 5


def test_prompts_reach_the_extractor(spark):
    assert prompts.fields(prompts.PASSAGES) == ["paper_id", "paper_doi", "pmcid", "pmid", "title", "candidate_passages"] and "full_text" in prompts.fields(prompts.FULL_TEXT)
    papers = spark.createDataFrame([("p", "", "PMC1", "", "A title", "GSE77 is deposited", "body", [])], "paper_id string, paper_doi string, pmcid string, pmid string, title string, abstract string, full_text string, sections array<struct<section_title:string,section_text:string,section_path:string,page:int>>")

    def client(text, paper):
        whole = "Title: A title" in text and "GSE77" in text and "- GEO: GSE####" in text and "{{" not in text
        return [{"dataset_identifier": "GSE77", "evidence": "GSE77"}] if whole and paper == "p" else []

    assert passages_pipeline(client).run(papers).first().dataset_identifier == "GSE77"


def test_first_of_each(spark):
    rows = [(["b", "a", "b", "c", "a"],), ([],), ([None, "x", None],), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "v array<string>").select(first_of(F.col("v"), lambda x: x)).collect()]
    assert got == [["b", "a", "c"], [], [None, "x"], None]


def test_registry_of_a_file(tmp_path):
    path = tmp_path / "r.json"
    path.write_text(json.dumps({"repositories": [{"canonical": "MyStore", "aliases": ["My Store"], "prefixes": ["MS-"], "identifier_pattern": r"^MS-\d+$", "url_template": "https://my.store/{id}"}]}))
    assert registry.load_registry(str(path))[0].names == ("MyStore", "My Store")
    code = "from citeloom.functions import registry; print(registry.CANONICALS, registry.ACCESSION)"
    out = subprocess.run([sys.executable, "-c", code], env=os.environ | {registry.REGISTRY_FILE: str(path)}, capture_output=True, text=True).stdout
    assert "('MyStore',)" in out and "MS\\-" in out


def test_details_are_one_long_frame(spark, tmp_path):
    record = {"pair_micro": {"precision": 1.0, "recall": 0.5, "f1": 0.6667, "tp": 1, "fp": 0, "fn": 1}, "coverage": {"empty_papers": 2}, "failures": {"missed": {"n": 7, "examples": [["p", "gse1"], ["q", "gse2"]]}, "incomplete": {"n": 0, "examples": []}}}
    (tmp_path / "exp_m_rtr.json").write_text(json.dumps(record))
    loaded = report.load_metrics(spark, str(tmp_path))
    rows = [(r.part, r.item, r.value) for r in report.detail_rows(loaded).orderBy("pos").collect()]
    assert rows == [("pair_micro", "precision", "1.0000"), ("pair_micro", "recall", "0.5000"), ("pair_micro", "f1", "0.6667"), ("pair_micro", "tp", "1"), ("pair_micro", "fp", "0"), ("pair_micro", "fn", "1"), ("coverage", "empty_papers", "2"), ("failures", "missed", "7"), ("first missed", "1", "p, gse1"), ("first missed", "2", "q, gse2")]
    assert "| first missed | 2 | q, gse2 |" in report.generate_report(loaded)
