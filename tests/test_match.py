"""Matching at scale: how often an input is scanned, hot keys, and a plain version."""

import random

from pyspark.sql import functions as F

from citeloom.functions.identifiers import synonym_group
from citeloom.operators import match, metrics

SIDE = "row_id long, paper_id string, pmcid string, pmid string, paper_doi string, dataset_identifier string, repository string"


def sides(spark, n=400, hot=0):
    r = random.Random(8)

    def rows(shift):
        out = []
        for i in range(n):
            p = r.randint(0, 40)
            ids = [f"P{p}" if r.random() < 0.6 else "", f"pmc{p}" if r.random() < 0.5 else None, str(p) if r.random() < 0.4 else " ", f"10.1/{p % 30}" if r.random() < 0.4 else ""]
            out.append((i + shift, *ids, r.choice([*[f"GSE{k}" for k in range(6)], "N/A", "", None]), r.choice(["GEO", "ncbi geo", "PRIDE", "ProteomeXchange", "Zenodo", None])))
        out += [(n + i + shift, "", "", "", "", f"GSE{i % 3}", r.choice(["GEO", "Zenodo"])) for i in range(hot)]
        return out

    a, b = rows(0), rows(10_000)
    return spark.createDataFrame(a, SIDE), spark.createDataFrame(b, SIDE), a, b


def plain(rows_a, rows_b, groups):
    """(prediction statuses, truth statuses) row by row."""
    low = lambda v: (v or "").strip().lower()
    fields = ("pmcid", "pmid", "paper_doi", "paper_id")

    def names(row):
        _, paper_id, pmcid, pmid, doi = row[:5]
        return [f"{f}:{low(v)}" for f, v in zip(fields, (pmcid, pmid, doi, paper_id), strict=True) if low(v)]

    key = lambda row: (names(row) or ["paper_id:"])[0]

    def index(rows):
        papers = {}
        for row in sorted(rows):
            papers.setdefault(key(row), []).append(row)
        return {alias: paper for paper, of in papers.items() for row in of for alias in names(row)}

    pred, truth = index(rows_a), index(rows_b)
    place = lambda row, one, two: one.get(key(row), two.get(key(row), key(row)))
    named = lambda rows, one, two: [(row[0], place(row, one, two), low(row[5]), groups[row[0]]) for row in sorted(rows) if low(row[5]) not in ("", "n/a")]
    p, t = named(rows_a, pred, truth), named(rows_b, truth, pred)
    picked, out = set(), {}
    for row_id, paper, ds, g in p:
        mine = [x for x in t if x[1:3] == (paper, ds)]
        same = [x for x in mine if x[3] == g]
        out[row_id] = "TP" if same else "REPO-MISMATCH" if mine else "FP"
        picked |= {(same or mine)[0][0]} if mine else set()
    seen = {x[1:3] for x in p}
    return out, {x[0]: "TP" if x[0] in picked else "REPO-MISMATCH" if x[1:3] in seen else "FN" for x in t}


def test_statuses_against_the_plain_version(spark):
    predictions, truth, a, b = sides(spark, hot=100)
    groups = {r.row_id: r.g for r in predictions.unionByName(truth).select("row_id", synonym_group("repository").alias("g")).collect()}
    want_p, want_t = plain(a, b, groups)
    assert {r.row_id: r.status for r in match.prediction_status(predictions, truth).collect()} == want_p
    assert {r.row_id: r.status for r in match.truth_status(predictions, truth).collect()} == want_t
    tally = {(r.side, r.status): r.n for r in match.status_tally(predictions, truth).collect()}
    assert tally == {(s, v): list(w.values()).count(v) for s, w in (("prediction", want_p), ("truth", want_t)) for v in set(w.values())}
    empty = predictions.limit(0)
    assert {r.status for r in match.prediction_status(predictions, empty).collect()} == {"FP"} and match.truth_status(empty, empty).count() == 0


def test_inputs_are_scanned_twice_at_most(spark, tmp_path, monkeypatch):
    predictions, truth, *_ = sides(spark, 40)
    for name, df in (("p", predictions), ("t", truth)):
        df.write.parquet(str(tmp_path / name))
    p, t = (spark.read.parquet(str(tmp_path / n)) for n in "pt")

    def scans(df):
        plan = df._jdf.queryExecution().executedPlan().toString()
        return [plan.count(f"{tmp_path}/{n}]") + plan.count(f"{tmp_path}/{n},") for n in "pt"]

    assert scans(match.match(p, t, True)) == [2, 2]
    # The rows are written, then their look-up, which reads each input for the index; later steps read neither.
    written, stored = [], match.stored
    monkeypatch.setattr(match, "stored", lambda df, tag: written.append(scans(df)) or stored(df, tag))
    statuses = match.truth_status(p, t)
    assert written == [[1, 1], [1, 1]] and scans(statuses) == [0, 0]


def test_rows_of_one_key_are_spread(spark):
    keyed = spark.range(6400).select(F.lit("paper_id:").alias("own_key"), F.col("id").alias("row_id"))
    index = spark.createDataFrame([("paper_id:", "x", None)], "alias string, prediction string, truth string")
    plan = match.with_papers(keyed, index)
    assert plan.filter("prediction = 'x'").count() == 6400
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert "own_key" in text and "part" in text
    parts = keyed.withColumn("part", F.pmod(F.hash("row_id"), F.lit(match.PARTS))).groupBy("part").count().agg(F.max("count")).first()[0]
    assert parts < 2 * 6400 / match.PARTS


def test_papers_in_parts(spark):
    _, truth, _, rows = sides(spark, 60, hot=50)
    got = match.group_by_paper(truth, ["dataset_identifier"], 4).collect()
    assert sum(r.n for r in got) == len(rows) and max(r.n for r in got) <= 16
    assert sorted((x.row_id, x.dataset_identifier) for r in got for x in r.rows) == sorted((r[0], r[5]) for r in rows)
    assert all([x.row_id for x in r.rows] == sorted(x.row_id for x in r.rows) for r in got)


def test_both_ways_of_judging_agree(spark, monkeypatch):
    predictions, truth, a, b = sides(spark, 300, hot=60)
    extra = {"said": lambda df: F.col("dataset_identifier")}
    rows = match.resolved_rows(predictions, truth, extra)
    shown = lambda df: sorted(map(tuple, df.select("side", "row_id", "paper", "ds", "g", "said", "status", "picked").collect()), key=str)
    few = shown(match.judged(rows))
    plan = match.judged(rows)._jdf.queryExecution().executedPlan().toString()
    # Rows move once, to their paper and dataset.
    assert plan.count("Exchange") == 1 and "Join" not in plan
    monkeypatch.setattr(match, "crowded", lambda *_: True)
    assert shown(match.judged(match.resolved_rows(predictions, truth, extra))) == few and len(few) > 300


def test_crowded_keys_are_noticed(spark, monkeypatch):
    monkeypatch.setattr(match, "MOST_ROWS", 100)
    rows = spark.range(4000).withColumn("k", F.when(F.col("id") < 200, -1).otherwise(F.col("id")))
    assert match.crowded(rows, "k") and not match.crowded(rows, "id") and not match.crowded(rows.limit(0), "k")


def test_failures_are_told_in_one_pass(spark):
    predictions, truth, *_ = sides(spark, 200)
    for triples in (False, True):
        matched = match.match(predictions, truth, triples)
        rows = matched.collect()
        missed = {(r.paper, r.ds) for r in rows if r.outcome == "FN"}
        letters = lambda ds: 0 < len(ds) <= 4 and ds.isalpha()
        wrong = lambda r: "wrong_repository" if (r.paper, r.ds) in missed else "hallucinated"
        name = lambda r: "missed" if r.outcome == "FN" else wrong(r) if triples else "incomplete" if letters(r.ds) else "hallucinated"
        failures = metrics.failure_buckets(matched)
        assert sorted(map(tuple, failures.collect())) == sorted((r.paper, r.ds, name(r)) for r in rows if r.outcome != "TP")
        # The match is computed once.
        assert failures._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1


def test_tally_moves_groups_and_writes_no_rows(spark, monkeypatch):
    predictions, truth, *_ = sides(spark, 60, hot=40)

    def refused(*_):
        raise AssertionError("rows are written")

    monkeypatch.setattr(match, "stored", refused)
    tally = match.status_tally(predictions, truth)
    # Rows collapse by hash before they move; the one window is over the sets of identities.
    assert sum(r.n for r in tally.filter("side = 'prediction'").collect()) == predictions.filter("lower(coalesce(dataset_identifier, '')) not in ('', 'n/a')").count()
    assert tally._jdf.queryExecution().optimizedPlan().toString().count("Window ") == 1


def test_sorts_by_long_keys_begin_with_a_hash(spark):
    predictions, truth, *_ = sides(spark, 40)
    judged = match.judged(match.resolved_rows(predictions, truth))._jdf.queryExecution().executedPlan().toString()
    assert all("Sort [hash#" in line for line in judged.splitlines() if "Sort [" in line) and "Sort [" in judged
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        matched = match.match(predictions, truth)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    sorts = [line for line in matched.splitlines() if "Sort [" in line]
    assert sorts and all("Sort [hash#" in line for line in sorts)


def test_sets_of_both_sides_move_as_one(spark):
    ids = "pmcid string, pmid string, paper_doi string, paper_id string, since long, side string"
    held = [("P1", "1", "", "a", 1, "prediction"), ("P1", "1", "", "a", 101, "truth"), ("P1", "2", "", "a", 102, "truth"), ("P2", "1", "", "b", 103, "truth"), ("P2", "", "", "b", 2, "prediction")]
    index = match.index_of(spark.createDataFrame(held, ids))
    got = {r.alias: (r.prediction, r.truth) for r in index.collect()}
    p1, p2 = "pmcid:p1", "pmcid:p2"
    # A set of the truth alone gives predictions nothing, and the last paper holds an alias of two.
    assert got == {"pmcid:p1": (p1, p1), "pmcid:p2": (p2, p2), "pmid:1": (p1, p2), "pmid:2": (None, p1), "paper_id:a": (p1, p1), "paper_id:b": (p2, p2)}
    plan = index._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [pmcid#" in plan and "Aggregate [side#" not in plan
