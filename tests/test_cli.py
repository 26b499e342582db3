"""Commands beyond the plain run: PDF files, skipped steps, several models, URLs, pages, repeated runs."""

import json

import pytest

from citeloom import __main__ as app
from citeloom.sources.fetch import Response


@pytest.fixture
def folder(tmp_path):
    raw = tmp_path / "raw"
    raw.mkdir()
    (raw / "a.html").write_text("<html><body><h1>Paper</h1><p>PMC1234567</p><h2>Data availability</h2><p>In GEO under GSE11111.</p></body></html>")
    (raw / "b.pdf").write_bytes(b"Title|PMC7654321 Methods|See PXD000222.")
    (tmp_path / "truth.csv").write_text("pmcid,accession,database\nPMC1234567,GSE11111,GEO\nPMC7654321,PXD000222,PRIDE\n")
    return tmp_path


def test_pdf_files_are_read_or_refused(spark, folder, capsys):
    raw, truth, out = str(folder / "raw"), str(folder / "truth.csv"), str(folder / "out")
    with pytest.raises(ValueError, match="1 PDF files"):
        app.prepare(spark, raw, out)
    assert app.prepare(spark, raw, f"{out}/skipped", skip_pdf=True).count() == 1 and "1 PDF files left out" in capsys.readouterr().out
    text = app.run(spark, raw, truth, out, model="m,n/2", strategies=("rtr",), read_pages=lambda data: data.decode().split("|"))
    runs = json.loads((folder / "out/runs.json").read_text())["runs"]
    assert [(r["model"], r["n_papers"], r["n_predictions"]) for r in runs] == [("m", 2, 2), ("n/2", 2, 2)] and "| EXP | 2 | rtr | **1.0000**" in text
    assert list((folder / "out/visual/exp_n-2_rtr").glob("benchmark=exp/model=n-2/part-*.html")) and (folder / "out/visual/exp_m_rtr/index.html").exists()
    assert app.main(["costs", "--runs", f"{out}/runs.json"]) == 0
    shown = capsys.readouterr().out.splitlines()
    assert shown[0].split() == ["Benchmark", "Model", "Method", "Time(s)", "Input", "tokens", "Cost($)"] and [x.split()[:3] for x in shown[2:]] == [["exp", "m", "rtr"], ["exp", "n/2", "rtr"]]
    # What is skipped isn't made again; what isn't there can't be skipped.
    (folder / "truth.csv").write_text("pmcid,accession,database\nPMC1,GSE1,GEO\n")
    again = app.run(spark, "nowhere", truth, out, model="m", strategies=("rtr",), skip=("prepare", "predict", "visualize", "status"))
    assert "| EXP | m | rtr | **0.0000**" in again
    with pytest.raises(ValueError, match="isn't there"):
        app.run(spark, "nowhere", truth, out, model="other", strategies=("rtr",), skip=("prepare", "predict"))
    # A second run of the log, and the first again.
    for n in (1, 2, 1):
        table = app.repeat(spark, f"{out}/metrics", f"{out}/log", n, f"{out}/repeats.json")
    assert "exp / m / rtr  (2 runs)" in table and json.loads((folder / "out/repeats.json").read_text())["n_runs"] == 2


def test_papers_of_a_url_list(spark, folder):
    (folder / "urls.txt").write_text("# list\nhttps://a.org/x\nhttps://a.org/gone\nhttps://pmc.ncbi.nlm.nih.gov/articles/PMC1234567/\n")

    def transport(url):
        if "gone" in url:
            return Response(404)
        return Response(200, "<article><body><sec><title>Data availability</title><p>In GEO under GSE11111.</p></sec></body></article>", "text/xml")

    out = str(folder / "out")
    assert app.fetch_papers(spark, str(folder / "urls.txt"), f"{out}/p", transport) == {"papers": 2, "failed": 1}
    text = app.run(spark, "", str(folder / "truth.csv"), out, strategies=("rtr",), urls=str(folder / "urls.txt"), transport=transport, skip=("visualize", "status"))
    record = json.loads((folder / "out/metrics/exp_offline_rtr.json").read_text())
    assert record["pair_micro"]["tp"] == 1 and "rtr" in text
    with pytest.raises(ValueError, match="transport"):
        app.run(spark, "", str(folder / "truth.csv"), out, urls=str(folder / "urls.txt"))
