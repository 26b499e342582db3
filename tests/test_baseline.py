"""Every status of a baseline run, reached by its rows."""

import pytest

from citeloom.plans import baseline

PAPER = "paper_id string, paper_doi string, pmcid string, pmid string, source_url string, full_text string"


def papers(spark, *rows):
    return spark.createDataFrame([(i, d, p, "", u, "some text " * 40) for i, d, p, u in rows], PAPER)


def test_statuses(spark):
    def tool(url, text):
        if "bad" in url:
            raise ValueError(f"no {url}")
        if "empty" in url:
            return [{"dataset_id": "n/a"}, {"dataset_identifier": None}]
        return [{"dataset_id": "GSE" + str(len(url)), "data_repository": "nan", "source": "GEO", "dataset_webpage": "https://x.org/1"}, {"dataset_id": "nan"}]

    good, doi, bad, empty, none = ("a", "", "PMC123", None), ("b", "10.1/x", "", " "), ("c", "", "", "https://bad.org/c"), ("d", "", "", "https://empty.org"), ("e", "", "", None)
    run = lambda *rows, make=lambda: tool, **k: baseline.run_baseline(papers(spark, *rows), make, **k)

    predictions, rejects, status = run(good, doi, bad, empty, none)
    assert status["status"] == "ok", status
    assert (status["status"], status["n_papers"], status["n_urls"], status["n_failed"], status["n_references"], status["raw_rows"], status["n_predictions"]) == ("ok", 5, 4, 1, 2, 6, 2)
    assert status["input_tokens"] == 300 and status["output_tokens"] == 30 and status["cost_usd"] == pytest.approx(300 / 1000 * 0.00015 + 30 / 1000 * 0.0006, abs=1e-6)
    found = {r.paper_id: r for r in predictions.collect()}
    assert found["a"].repository == "GEO" and found["a"].notes == "webpage=https://x.org/1" and found["d"].dataset_identifier == "N/A"
    assert {(r.paper_id, r.outcome) for r in rejects.collect()} == {("c", "failed"), ("e", "no_url")}
    assert [r.error for r in rejects.collect() if r.error] == ["ValueError: no https://bad.org/c"]

    assert run(empty, none)[2]["status"] == "no_predictions"
    assert run(none)[2]["status"] == "no_urls"
    failed = run(bad, none)
    assert failed[2]["status"] == "all_urls_failed" and "ValueError" in failed[2]["error"] and failed[0].count() == 0 and failed[1].count() == 2
    assert run(good, key=None)[2]["status"] == "no_key"

    def missing():
        raise baseline.Unavailable("not installed")

    assert run(good, make=missing)[2]["error"] == "not installed" and run(good, make=missing)[2]["status"] == "unavailable"
    broken = baseline.run_baseline(papers(spark, good).drop("full_text"), lambda: tool)
    assert broken[2]["status"] == "error" and broken[0].count() == 0
    assert baseline.run_baseline(papers(spark, good).limit(0), lambda: tool)[2]["status"] == "no_urls"
