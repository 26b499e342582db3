"""Files whose records don't fit: every record comes out, as a row or as a reject."""

import json

from citeloom.sources import readers


def test_ragged_csv(spark, tmp_path):
    lines = ["pmcid,accession,database", "1,GSE1,GEO", "2,GSE2", "3,GSE3,GEO,more,and more", '4,"GSE4, really",GEO', "", "5"]
    (tmp_path / "t.csv").write_text("﻿" + "\n".join(lines) + "\n")
    rows, rejects = readers.read_ragged(spark, str(tmp_path / "t.csv"))
    got = {r.pmcid: (r.accession, r.database, r[readers.RESCUED]) for r in rows.collect()}
    assert got == {"1": ("GSE1", "GEO", None), "2": ("GSE2", None, lines[2]), "3": ("GSE3", "GEO", lines[3]), "4": ("GSE4, really", "GEO", None), "5": (None, None, "5")}
    assert {(r.raw, r.reason) for r in rejects.collect()} == {(lines[2], "short"), (lines[3], "long"), ("5", "bare")}
    assert [r.dataset_identifier for r in readers.normalize_truth(rows.orderBy("pmcid")).collect()] == ["GSE1", "GSE2", "GSE3", "GSE4,REALLY", "N/A"]
    (tmp_path / "t.tsv").write_text("id\turl\na\tb\na\tb\tc\n")
    rows, rejects = readers.read_ragged(spark, str(tmp_path / "t.tsv"))
    assert rows.count() == 2 and [r.reason for r in rejects.collect()] == ["long"]


def test_mixed_json_lines(spark, tmp_path):
    records = [{"id": "GSE1", "n": 1}, {"id": 2, "n": "two", "x": {"y": [1, 2]}}, {"id": None}, {}, {"id": True, "n": 1.5}]
    lines = [*map(json.dumps, records), "{broken", "[1, 2]", '"text"', "", "12"]
    (tmp_path / "t.jsonl").write_text("\n".join(lines) + "\n")
    rows, rejects = readers.read_ragged(spark, str(tmp_path / "t.jsonl"))
    assert rows.columns == ["id", "n", "x", readers.RESCUED]
    assert sorted((r.id or "", r.n or "", r.x or "") for r in rows.collect()) == sorted([("GSE1", "1", ""), ("2", "two", '{"y":[1,2]}'), ("", "", ""), ("", "", ""), ("true", "1.5", "")])
    assert {r.raw for r in rejects.collect()} == {"{broken", "[1, 2]", '"text"', "12"}
