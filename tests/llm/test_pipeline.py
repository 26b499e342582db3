"""The corpus pipeline, each stage against a plain version of itself on its own input."""

import random

import pytest

import corpus_pipeline
from citeloom.llm import common

random.seed(11)
WORDS = [f"w{i}" for i in range(500)]
say = lambda n: " ".join(random.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    common.prepare(spark)
    folder = str(tmp_path_factory.mktemp("sf"))
    good = [(i, say(150)) for i in range(80)]
    junk = [(100 + i, " ".join(f"{w.upper()}!!" for w in say(90).split())) for i in range(60)]
    copies = [(200 + i, good[i][1]) for i in range(5)]
    near = [(300 + i, good[10 + i][1] + " tail") for i in range(5)]
    private = [(400, say(100) + " reach me at joe@lab.org or +1 (386) 555-3733 " + say(20))]
    rows = [(d, t, "en", "s", len(t)) for d, t in good + junk + copies + near + private]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(d, int(d < 100), 0) for d, _ in good + junk], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def test_stages(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    columns, ids = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.materialise(stage(spark, docs, corpus), name)
        assert docs.columns == columns
        ids.append({r.doc_id for r in docs.select("doc_id").collect()})
    kept, unique, apart, clean = ids
    assert not kept & set(range(100, 160)) and len(kept & set(range(80))) >= 76
    assert unique == kept - {i for i in range(5) if 200 + i in kept}
    assert apart == unique - {300 + i for i in range(5) if 10 + i in unique}
    assert clean == apart
    text = docs.filter("doc_id = 400").first()
    assert "[EMAIL]" in text.text and "[PHONE]" in text.text and text.n_chars == len(text.text)
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, corpus).collect()
    assert {r.doc_id for r in pieces} == clean and all(r.length == len(r.ids) for r in pieces)
    assert corpus_pipeline.run(spark, corpus).count() == len(pieces)
