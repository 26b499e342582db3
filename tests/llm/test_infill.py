"""Fill-in-the-middle against a plain version, text by text."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from citeloom.llm import infill

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, n string, form int, k1 string, output string"


def plain(i, text):
    t = text or ""
    units = UNIT.findall(t)
    n, d = len(units), hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()
    h = [int(d[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not t or any(x in t for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return (i, n, "plain", None, None, t)
    if h[3] % 100 < 80:
        return (i, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}")
    return (i, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def rows():
    r = random.Random(5)
    parts = [" ", "  ", "\n", "\t", "\x0b", "\x1c", "\xa0", "a", "bc", "é", "😀", "<", "P>", "<P", "S>", "<M>", "中", "ﬀ"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 60))) for _ in range(400)] + ["", None, " ", "\n\n", "x", "<P>", "a <S> b", " lead and trail \n", "long " * 60_000, "w" * 50_000 + " " * 50_000]
    return [*enumerate(texts), (None, "a text without id"), (None, None), (3, "the same id"), (4, "again and again"), (4, "again and again")]


def test_against_the_plain_version(spark):
    docs = spark.createDataFrame([(i, t, "n", 1, "k", "o") for i, t in rows()], SCHEMA)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    key = lambda r: tuple((x is None, x if x is not None else 0) for x in r)
    want = sorted([(*(w := plain(i, t))[:5], sha(w[5]), sha(t or "")) for i, t in rows()], key=key)
    assert sorted(map(tuple, infill.digests(docs).collect()), key=key) == want
    assert {w[2] for w in want} == {"plain", "spm", "psm"}
    made = infill.fill_in_middle(docs)
    assert made.columns == [*docs.columns, "n_1", "form_1", "prefix_chars", "middle_chars", "output_1"]
    assert sorted((r[6], r[7], r[10]) for r in made.collect()) == sorted((w[1], w[2], w[5]) for w in (plain(i, t) for i, t in rows()))
    assert infill.digests(docs.limit(0)).count() == 0


def test_restore_at_marks_that_nearly_meet(spark):
    texts = [(i, t) for i, t in enumerate(["< S> < P> <", "<S <P <M x", "> > >", "<< << <<", "S> P> M> S>"] * 40)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    made = infill.fill_in_middle(docs, rate=100).withColumn("back", infill.restore(F.col("form"), F.col("output")))
    assert made.filter("form <> 'plain'").count() > 150 and made.filter("back <> text").count() == 0


def test_units_move_once(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    plan = infill.digests(docs)._jdf.queryExecution().executedPlan().toString()
    # Texts to be rearranged, and the measured documents for requests and units; no unit row is shuffled.
    assert plan.count("Exchange hashpartitioning") == 3
    assert "Exchange" not in plan[plan.index("Window [") : plan.index("Generate posexplode")]
