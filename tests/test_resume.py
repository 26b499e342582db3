"""Kept stages are read again if nothing changed, and made again if anything did."""

from pyspark.sql import functions as F

from citeloom.plans.pipeline import Pipeline, content_digest


def test_content_digest(spark):
    make = lambda rows, n=2: spark.createDataFrame(rows, "a int, b string, c map<string,int>").repartition(n)
    rows = [(1, "x", {"k": 1}), (2, None, None), (None, "2", {}), (1, "x", {"k": 1})]
    same = content_digest(make(rows))
    assert content_digest(make(rows[::-1], 3)) == same
    for other in ([(1, "x", {"k": 2}), *rows[1:]], rows[:3], [*rows, rows[0]], [*rows[:1], (None, "2", None), (2, None, {}), rows[3]]):
        assert content_digest(make(other)) != same
    assert content_digest(make(rows).withColumnRenamed("a", "z")) != same and content_digest(make([]))


def test_resume(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    at = str(calls)

    def counted(df, factor=2):
        def run(batches):
            import uuid

            for b in batches:
                if b.num_rows:
                    open(f"{at}/{uuid.uuid4().hex}", "w").close()
                yield b

        return df.mapInArrow(run, df.schema).withColumn("v", F.col("v") * factor)

    def made(rows, factor=2, version="", resume=True):
        before = len(list(calls.iterdir()))
        source = spark.createDataFrame(rows, "k int, v long").coalesce(1)
        plan = Pipeline([("first", lambda d: d.filter("v > 0")), ("costly", lambda d: counted(d, factor)), ("last", lambda d: d.withColumn("w", F.col("v") + 1))], str(tmp_path / "kept"), {"costly"}, {"costly": version})
        got = sorted(map(tuple, plan.run(source, resume=resume).collect()))
        return got, len(list(calls.iterdir())) > before

    rows = [(1, 1), (2, 2), (3, -1)]
    want = [(1, 2, 3), (2, 4, 5)]
    assert made(rows) == (want, True)
    assert made(rows) == (want, False)
    assert made(rows[::-1]) == (want, False)  # the same rows in another order
    assert made(rows, resume=False) == (want, True)
    assert made([(1, 1), (2, 3), (3, -1)]) == ([(1, 2, 3), (2, 6, 7)], True)  # a changed row
    assert made([(1, 1), (2, 3), (3, -1)], factor=5) == ([(1, 5, 6), (2, 15, 16)], True)  # a changed plan
    assert made([(1, 1), (2, 3), (3, -1)], factor=5, version="model 2") == ([(1, 5, 6), (2, 15, 16)], True)
    assert made([(1, 1), (2, 3), (3, -1)], factor=5, version="model 2") == ([(1, 5, 6), (2, 15, 16)], False)
    (tmp_path / "kept" / "costly.mark").unlink()  # an interrupted run
    assert made([(1, 1), (2, 3), (3, -1)], factor=5, version="model 2")[1]
