"""The run log and its summary."""

import json
import math
import statistics

import pytest

from citeloom.operators import repeats, report

NAN = float("nan")


def test_appending_a_run_again_replaces_it(spark, tmp_path):
    log = str(tmp_path / "log")
    make = lambda rows: spark.createDataFrame(rows, repeats.LOG)
    runs = [("exp", "m", "rtr", n, 1, "f1", n / 10) for n in range(1, 6)] + [("exp", "m/x", "fdr", 1, 1, "f1", 0.5)]
    repeats.append_runs(make(runs), log)
    repeats.append_runs(make(runs[:2]), log)  # the same again
    repeats.append_runs(make([("exp", "m", "rtr", 2, 2, "f1", 0.9), ("exp", "m", "rtr", 2, 1, "f1", 0.0), ("exp", "m", "rtr", 2, 2, "f1", 0.9), ("exp", "m", "rtr", 6, 1, "f1", NAN)]), log)
    got = {(r.method, r.metric): r for r in repeats.repeat_summary(repeats.read_runs(spark, log)).collect()}
    r = got["rtr", "f1"]
    want = [0.1, 0.9, 0.3, 0.4, 0.5]
    assert r.n_runs == 6 and r["values"][:5] == want and math.isnan(r["values"][5])
    assert r["mean"] == pytest.approx(statistics.mean(want)) and r["std"] == pytest.approx(statistics.stdev(want))
    one = got["fdr", "f1"]
    assert (one["mean"], one.n_runs, one["values"]) == (0.5, 1, [0.5]) and math.isnan(one["std"])
    none = repeats.repeat_summary(make([("e", "m", "x", 1, 1, "f1", NAN)])).first()
    assert math.isnan(none["mean"]) and math.isnan(none["std"]) and none.n_runs == 1
    assert repeats.repeat_summary(make([])).count() == 0
    text = repeats.console_table(repeats.repeat_summary(repeats.read_runs(spark, log)))
    assert "exp / m / rtr  (6 runs)" in text and "0.4400" in text and "nan" in text
    assert json.dumps(repeats.payload(repeats.repeat_summary(repeats.read_runs(spark, log)), 6)).count('"values"') == 2


def test_scores_of_records(spark, tmp_path):
    (tmp_path / "exp_m_rtr.json").write_text(json.dumps({"pair_micro": {"precision": 1.0, "recall": 0.5, "f1": 0.75}, "pair_macro": {"f1": 0.25}}))
    rows = {r.metric: r for r in repeats.run_scores(report.load_metrics(spark, str(tmp_path)), 3).collect()}
    assert set(rows) == set(repeats.METRICS) and rows["pair_f1"].value == 0.75 and rows["macro_pair_f1"].value == 0.25 and math.isnan(rows["triple_f1"].value)
    assert {(r.benchmark, r.model, r.method, r.run) for r in rows.values()} == {("exp", "m", "rtr", 3)}
