"""Mixing: targets against the rule as it is worded, rates against the optimum's conditions, copies against both."""

import math
import random
import re

import numpy as np
import pytest

from citeloom.llm import mixing

SCHEMA = "doc_id long, text string, source string, size string, at string, k1 string"


def targets(sizes, weights=(3, 1, 2), share=1.5, most=2):
    """Shares by weight; what is above a source's end goes to the others by weight, until nothing is."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    got, over, free = dict.fromkeys(names, 0.0), share * sum(sizes.values()), set(names)
    while over > 1e-9 and free:
        unit = over / sum(weight[s] for s in free)
        for s in free:
            got[s] += unit * weight[s]
        over = sum(max(0, got[s] - most * sizes[s]) for s in free)
        full = {s for s in free if got[s] >= most * sizes[s]}
        for s in full:
            got[s] = most * sizes[s]
        free -= full
        if not full:
            break
    return got


def count(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


@pytest.fixture(scope="module")
def corpus(spark):
    r = random.Random(11)
    rows = [(i, " ".join("w" * r.randint(1, 5) for _ in range(int(r.expovariate(1 / 60)))), r.choice(["a", "a", "a", "B", "é", "😀", None, "tiny"] if i % 7 else ["a"])) for i in range(900)]
    rows += [(2000 + i, "the same text of seven words here", "a") for i in range(500)] + [(5000, None, "a"), (5001, "", "nothing"), (5002, "x " * 1_500, "B"), (None, "no id at all", "é"), (7, "again", "B"), (7, "again", "B")]
    return rows, spark.createDataFrame([(*x, "c", "d", "e") for x in rows], SCHEMA)


def test_targets_rates_and_copies(corpus):
    rows, docs = corpus
    got = mixing.mixing_plan(docs).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.size) for r in got) == sorted((i if i is not None else -1, count(t)) for i, t, _ in rows)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + count(t)
    want = targets(sizes)
    assert sum(want.values()) == pytest.approx(1.5 * sum(sizes.values()))
    for source, aim in want.items():
        mine = [r for r in got if r.source == source]
        assert {r.source_size for r in mine} == {sizes[source]} and all(r.target == pytest.approx(aim) for r in mine)
        assert all(r.taken == r.copies * r.size and 0 <= r.copies <= 2 for r in mine)
        # The rates meet the constraint, and the copies do but for a small document.
        assert sum(r.rate * r.size for r in mine) == pytest.approx(aim, rel=1e-6)
        assert abs(sum(r.taken for r in mine) - aim) <= max(1, min((r.size for r in mine if r.size), default=1))
        # Optimum of the relative entropy: below the end, log(rate) is one multiple of the size.
        slopes = [math.log(r.rate) / r.size for r in mine if r.size and 0.05 < r.rate < 2]
        assert not slopes or np.ptp(slopes) < 1e-6 * max(1, abs(slopes[0]))


    # A rerun over other partitions takes the same documents as often.
    mixed = mixing.mixture(docs.repartition(7, "text"))
    assert mixed.columns == docs.columns
    plan, again = {}, {}
    for r in got:
        plan[r.doc_id] = plan.get(r.doc_id, 0) + r.copies
    for r in mixed.collect():
        again[r.doc_id] = again.get(r.doc_id, 0) + 1
    assert again == {k: n for k, n in plan.items() if n}


def test_edges(spark, corpus):
    _, docs = corpus
    assert mixing.mixing_plan(docs.limit(0)).count() == 0
    empty = spark.createDataFrame([(1, None, None), (2, "", "s")], "doc_id long, text string, source string")
    assert [(r.size, r.target, r.taken) for r in mixing.mixing_plan(empty).collect()] == [(0, 0.0, 0)] * 2
    alone = spark.createDataFrame([(1, "a b c d", "s"), (2, "e f", "s")], "doc_id long, text string, source string")
    assert sum(r.taken for r in mixing.mixing_plan(alone).collect()) in (8, 10)


def test_whole_copies_hand_on_the_rest():
    import pandas as pd

    r = random.Random(3)
    for _ in range(200):
        sizes = sorted({r.randint(1, 400) for _ in range(r.randint(1, 30))})
        frame = pd.DataFrame({"at": "s", "size": sizes, "docs": [r.randint(1, 5) for _ in sizes], "rate": [int(r.random() * 2 * mixing.UNIT) for _ in sizes]})
        got = mixing.whole_copies(frame)
        assert (got["copies"] <= 2 * got["docs"]).all() and (got["copies"] >= 0).all()
        due = (frame["docs"] * frame["rate"] / mixing.UNIT * frame["size"]).sum()
        assert abs((got["copies"] * got["size"]).sum() - due) <= sizes[-1] / 2
