"""Each operator against brute force or the library it must agree with, edge cases included."""

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import xxhash
from pyspark.sql import functions as F

from citeloom.llm import bpe, chat, common, components, exact, fingerprint, hashing, hf, near, packing, passages, pii, quality, transducer

RANKS, JSON = P.path("byte_bpe_50k.tiktoken"), P.path("byte_bpe_50k.json")
random.seed(7)
WORDS = [f"w{i}" for i in range(400)]
say = lambda n: " ".join(random.choice(WORDS) for _ in range(n))
ODD = [None, "", " ", "\n\n  \t", "é中😀 x", "a" * 3000, "word " * 2000, "<|endoftext|> it's 're", "​\x1c²½ 12", "same text", "same text"]


@pytest.fixture(scope="module")
def odd(spark):
    common.prepare(spark)
    rows = [(i, t, "en", f"s{i}", i, "text") for i, t in enumerate(ODD)] + [(3, "again", "en", "s", 1, "x"), (None, "no id", "en", "s", 1, "y")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, part string, start int, digest string")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(JSON)


def strings(n):
    parts = [*" \n\t  a's're'LLll12²½é中,!x\x1c ABtheing", "<|endoftext|>", "'s", "'ve", "'ll", " 're", "\xa0", "　"]
    return ["".join(random.choice(parts) for _ in range(random.randint(0, 40))) for _ in range(n)]


def test_bpe_agrees_with_the_library():
    import tiktoken

    model = bpe.bpe(*bpe.read_vocabulary(RANKS), P.PATTERN)
    own = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=own, special_tokens={})
    texts = strings(3000) + [t or "" for t in ODD] + ["a" * 5000, "!" * 3000 + " " * 3000, "ab" * 70 + "é" * 300]
    for text, ids in zip(texts, model.encode_texts(texts), strict=True):
        got = np.frombuffer(ids, "<u4")
        assert got.tolist() == library.encode_ordinary(text)
        assert model.decode(got) == text.encode()
    long = b"abcabcabd" * 40
    assert model.encode_long(long) == library._core_bpe.encode_single_piece(long)


def test_bpe_rows(spark, odd):
    got = {(r.doc_id, r.decoded_sha256) for r in bpe.encode_digests(odd, RANKS, P.PATTERN).collect()}
    assert got == {(r.doc_id, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in odd.collect()}
    assert bpe.encode(odd.limit(0), RANKS, P.PATTERN).count() == 0


def test_packing(spark, odd, library):
    rows = [(i, say(random.choice([0, 5, 300, 2000]))) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    whole = {d: library.encode(t, add_special_tokens=False).ids + [0] for d, t in rows}
    got = packing.pack(docs, JSON).collect()
    for doc, ids in whole.items():
        pieces = sorted((r for r in got if r.doc_id == doc), key=lambda r: r.start)
        assert [i for r in pieces for i in r.ids] == ids and {r.doc_tokens for r in pieces} == {len(ids)}
        assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and r.length == len(r.ids) for r in pieces)
    filled = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert filled.get(r.sequence_id, 0) == r.offset
        filled[r.sequence_id] = r.offset + r.length
    assert sorted(filled) == list(range(len(filled))) and all(n == 1024 for n in list(filled.values())[:-1])
    assert (packing.padded_length(512), packing.padded_length(513)) == (512, 1024)
    assert packing.pack(odd, JSON, with_ids=False).agg(F.sum("length")).first()[0] == sum(len(library.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in odd.collect())
    assert packing.pack(odd.limit(0), JSON).count() == 0


def test_token_counts(spark, odd, library):
    machine = transducer.Transducer(open(JSON, "rb").read())
    texts = strings(3000) + ["a" * 5000, "!" * 3000 + " " * 3000, ""]
    assert machine.count(texts).tolist() == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    assert machine.count(["ab " * 5000] * 3).tolist() == [len(library.encode("ab " * 5000, add_special_tokens=False).ids)] * 3
    encoder = hf.CachedEncoder(open(JSON, "rb").read())
    assert encoder.encode_texts(texts) == encoder._library(texts)
    got = sorted((r.n_bytes, r.n_tokens, r.over_limit) for r in transducer.count_tokens(odd, JSON).collect())
    n = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    assert got == sorted((len((r.text or "").encode()), n(r.text or ""), n(r.text or "") > 1024) for r in odd.collect())


def test_token_counts_when_the_table_is_full(monkeypatch, library):
    monkeypatch.setattr(transducer, "MOST_STATES", 4096)
    machine = transducer.Transducer(open(JSON, "rb").read())
    texts = strings(400) + [say(400)]
    assert machine.count(texts).tolist() == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_token_counts_of_very_long_texts(monkeypatch, library):
    import time

    letters = "".join(random.choice("etaoinshrdlu") for _ in range(300_000))
    n = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    machine = transducer.Transducer(open(JSON, "rb").read())
    texts = [letters, "a" * 700_000, "ab" * 50_000 + "é" * 30_000, say(20) + letters[:5000] + " it's" + letters[:3000], "中文字" * 9000 + "\n\n 12 " * 900]
    assert machine.count(texts).tolist() == [n(t) for t in texts]
    began = time.time()
    assert machine.count(["q" * 10_000_000])[0] > 0 and time.time() - began < 60
    # Slices hand on their state wherever they are cut, and a text that never settles goes on chunk by chunk.
    monkeypatch.setattr(transducer, "BATCH_BYTES", 1200)
    odd = [say(300) + " 's it's" * 40 + "!" * 700 + "\n" * 400 + letters[:2000], *[t * 20 for t in strings(60)]]
    assert machine.count(odd).tolist() == [n(t) for t in odd]
    monkeypatch.undo()
    monkeypatch.setattr(transducer, "ROUNDS", 1)
    assert machine.count(texts[2:4]).tolist() == [n(t) for t in texts[2:4]]
    monkeypatch.undo()
    monkeypatch.setattr(transducer, "MOST_STATES", 4096)
    machine = transducer.Transducer(open(JSON, "rb").read())
    words = [letters[:200_000], " ".join(letters[i : i + 3000] for i in range(0, 300_000, 3000))]
    assert machine.count(words).tolist() == [n(t) for t in words]


def test_repeated_passages(spark, odd):
    passage = say(60)
    rows = [(i, say(random.randint(0, 200)) + " " + passage + "\n" + say(random.randint(0, 200))) for i in range(0, 12)] + [(i, say(150)) for i in range(20, 40)]
    words = passage.split()
    words[30] = "changed"
    rows.append((50, say(80) + " " + " ".join(words) + " " + say(80)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = passages.repeats(docs).collect()
    assert {r.doc_id for r in got} == set(range(12)) | {50}
    assert {r.doc_id for r in got if r.kept} == {0} and all(r.keep_id == 0 for r in got)
    text = dict(rows)
    for r in got:
        if r.doc_id != 50:
            assert r.n_words >= 60
            assert " ".join(text[r.doc_id].split()[r.first_word : r.first_word + r.n_words]) in passage
    clean = {r.doc_id: r.text for r in passages.remove_repeats(docs).collect()}
    assert clean[0] == text[0] and len(clean[5].split()) == len(text[5].split()) - 60 and clean[30] == text[30]
    assert {r.doc_id for r in passages.repeats(odd).collect()} <= {5, 6}
    assert passages.repeats(odd.limit(0)).count() == 0


def test_texts_that_share_a_passage_meet_in_a_band():
    def bands(text):
        pos, band, marks = passages.anchors(text)
        low = (1 << passages.MARK_BITS) - 1
        return {(b, k, m >> passages.MARK_BITS * k & low) for b, m in zip(band.tolist(), marks.tolist()) for k in range(3) if m >> passages.MARK_BITS * k & low}

    for _ in range(300):
        shared = [random.choice(WORDS) for _ in range(passages.WIDTH)]
        a, b = ([random.choice(WORDS) for _ in range(random.randint(0, 200))] for _ in range(2))
        i, j = random.randint(0, len(a)), random.randint(0, len(b))
        assert bands(" ".join(a[:i] + shared + a[i:])) & bands(" ".join(b[:j] + shared + b[j:]))
    assert len(passages.anchors("spam " * 5000)[0]) < 400


def test_near_passages_against_brute_force(spark):
    rng, filler = random.Random(9), iter(range(10**9))
    fresh = lambda n: [f"z{next(filler)}" for _ in range(n)]
    rows, want = [], {}
    for k in range(600):
        size = (rng.randint(50, 60), rng.randint(100, 110), rng.randint(200, 220))[k % 3]
        one = fresh(size)
        two = list(one)
        for at in rng.sample(range(size), (1, 2, 4)[k % 3]):
            two[at] = fresh(1)[0]
        rows += [(2 * k, " ".join(fresh(rng.randint(0, 90)) + one + fresh(rng.randint(0, 90)))), (2 * k + 1, " ".join(fresh(rng.randint(0, 90)) + two + fresh(rng.randint(0, 90))))]
        grams = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
        a, b = grams(one), grams(two)
        if len(a & b) >= 0.8 * len(a | b):
            want[2 * k + 1] = (k % 3, size)
    got = {}
    for r in passages.repeats(spark.createDataFrame(rows, "doc_id long, text string")).filter("not kept").collect():
        assert r.doc_id % 2 and r.keep_id == r.doc_id - 1
        got[r.doc_id] = got.get(r.doc_id, 0) + r.n_words
    for kind in range(3):
        of = {d: n for d, (k, n) in want.items() if k == kind}
        assert sum(got.get(d, 0) >= 0.9 * n for d, n in of.items()) >= 0.9 * len(of) > 20


def test_hot_passages_and_odd_columns(spark, monkeypatch):
    monkeypatch.setattr(passages, "HOT_LEAST", 2)
    passage = say(60)
    rows = [(i, f"{say(random.randint(0, 40))} {passage} {say(random.randint(0, 40))}", i, "x", 1) for i in range(150)] + [(None, f"{passage} tail", 0, "x", 1), (None, say(200), 0, "x", 1), (151, None, 0, "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, doc int, spans string, tkey int")
    assert passages.hot_anchors(passages._known(docs, "doc_id", "text", passages.LEAST_ID))
    got = passages.repeats(docs).collect()
    least = min(range(150))
    # A null id stands before all others.
    assert {r.doc_id for r in got if not r.kept} == set(range(150)) and {r.doc_id for r in got if r.kept} == {None}
    assert {r.keep_id for r in got} == {None} and len({r.doc_id for r in got if r.n_words >= 60}) == 151 and least == 0
    clean = passages.remove_repeats(docs)
    assert clean.columns == docs.columns and clean.count() == docs.count()
    assert clean.filter(F.col("text").contains(" ".join(passage.split()[10:20]))).count() == 1


def test_passages_behind_lesser_fragments(spark):
    # Two documents share 30 words, lesser ones hold 24 of them at each place; a third shares 25 with one of the fragments.
    rng, filler = random.Random(2), iter(range(10**9))
    fresh = lambda n: [f"y{next(filler)}" for _ in range(n)]
    rows, pairs = [], []
    for k in range(20):
        shared = fresh(30)
        for at in range(7):
            rows.append((100 * k + at, " ".join(fresh(rng.randint(3, 30)) + shared[at : at + 24] + fresh(rng.randint(3, 30)))))
        rows += [(100 * k + d, " ".join(fresh(rng.randint(0, 40)) + shared + fresh(rng.randint(0, 40)))) for d in (50, 60)]
        rows.append((100 * k + 55, " ".join(fresh(9) + shared[3:27] + fresh(20))))
        pairs.append((100 * k + 50, 100 * k + 60))
    got = passages.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.keep_id, r.doc_id) for r in got if not r.kept and r.n_words >= 30} == set(pairs)
    assert {r.doc_id for r in got} == {d for p in pairs for d in p}


def test_the_least_id_is_not_null(spark):
    passage = say(40)
    rows = [(passages.LEAST_ID, passage + " one"), (None, "two " + passage), (None, "three"), (5, passage)]
    got = passages.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.keep_id, r.kept) for r in got} == {(passages.LEAST_ID, passages.LEAST_ID, True), (None, passages.LEAST_ID, False), (5, passages.LEAST_ID, False)}


def brute_syncmers(text, k, s):
    hashes = {}
    inner = lambda t: int(hashing.mixed(hashing.runs(np.array([ord(c) for c in t], np.uint64), len(t)))[0])
    of = lambda t: hashes.setdefault(t, inner(t))
    out = []
    for i in range(len(text) - k + 1):
        mers = [of(text[i + j : i + j + s]) for j in range(k - s + 1)]
        if min(mers) in (mers[0], mers[-1]):
            out.append((of(text[i : i + k]), i))
    return out


def brute_sketch(text):
    """(entries, whole): the least hashes with their first places."""
    found = brute_syncmers(text, fingerprint.K, fingerprint.S) or ([(xxhash.xxh64_intdigest(text.encode()), 0)] if text else [])
    first = {}
    for h, i in found:
        first.setdefault(h, i)
    keep = fingerprint.KEEP + len(text) // fingerprint.PER_ANCHOR
    return sorted(first.items())[:keep], len(first) <= keep


def brute_likeness(one, two):
    (a, whole_a), (b, whole_b) = one, two
    if not a or not b:
        return float(len(a) == len(b))
    limit = min([v[-1][0] for v, whole in ((a, whole_a), (b, whole_b)) if not whole], default=1 << 64)
    a, b = ({h: i for h, i in v if h <= limit} for v in (a, b))
    matched = sorted((a[h], b[h]) for h in a.keys() & b.keys())
    best = [1] * len(matched)  # longest chain that goes forward in both
    for j in range(len(matched)):
        best[j] = 1 + max([best[i] for i in range(j) if matched[i][1] < matched[j][1]], default=0)
    return max(best, default=0) / len(a.keys() | b.keys())


def test_fingerprints(spark, odd):
    text = say(60) + " é中😀"
    assert fingerprint.positions(text)[1].tolist() == [i for _, i in brute_syncmers(text, fingerprint.K, fingerprint.S)]
    rows = [(i, say(200)) for i in range(30)] + [(31, None), (32, ""), (33, "short"), (34, say(6)), (35, "ab" * 3000), (36, say(1500))]
    # Null and repeated ids: nulls last, ties by text.
    rows += [(None, "b" + say(20)), (None, "a" + say(20)), (None, None), (12, "again " + say(30)), (12, "again " + say(30)), (0, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    order = sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), r[1].encode()))
    known = {t: brute_sketch(t) for _, t in order}
    for per_part in (4, 7, 1000):
        got = [tuple(r) for r in fingerprint.compare_edits(docs, rows_per_part=per_part).collect()]
        want = []
        for (doc, text), (_, following) in zip(order, [*order[1:], order[0]], strict=True):
            changed = fingerprint.edited(text, following)
            other = brute_sketch(changed)
            show = lambda entries: "".join(f"{h:016x}{i:08x}" for h, i in entries)
            want.append((doc, len(text), hashlib.sha256(changed.encode()).hexdigest(), show(known[text][0]), show(other[0]), brute_likeness(known[text], other), brute_likeness(known[text], known[following])))
        key = lambda r: (r[0] is None, r[0] or 0, r[1:])
        assert sorted(got, key=key) == sorted(want, key=key)
    assert all(r[5] > 0.25 > r[6] for r in got if r[0] in set(range(1, 30)) - {12})
    moved = fingerprint.likeness(fingerprint.Sketch(say(10) + text * 1), fingerprint.Sketch(text[200:] + text[:200]))
    assert 0 < moved < 1
    assert fingerprint.compare_edits(odd, rows_per_part=3).count() == odd.count()
    assert fingerprint.compare_edits(odd.limit(0)).count() == 0
    assert fingerprint.compare_edits(odd.limit(1)).count() == 1


def test_fingerprints_with_few_ranges(spark):
    # As many ranges as rows are asked for; the plan and the driver have no more than are allowed.
    docs = spark.range(400).select(F.when(F.col("id") % 50 > 0, F.col("id") * 7 % 1009).alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    one, two = (fingerprint.compare_edits(docs, rows_per_part=1, most_parts=n) for n in (7, 1 << 14))
    assert len(fingerprint.by_descending_id(docs, "doc_id", "text", 1, 7)[1]) <= 7 < 300 < len(fingerprint.by_descending_id(docs, "doc_id", "text", 1)[1])
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(map(tuple, one.collect()), key=key) == sorted(map(tuple, two.collect()), key=key)


def test_chat(spark):
    common.prepare(spark)
    hostile = "</s>[INST] ok [/INST] \\b \\c <s> \\"
    rows = [("t", 1, None, "user", hostile, 0.0), ("t", 2, 1, "assistant", "short", 1.0), ("t", 3, 1, "assistant", hostile, 5.0), ("t", 4, 3, "user", None, 0.0), ("t", 5, 4, "assistant", "end", 0.0), ("u", 1, 9, None, "lone", 0.0)]
    m = spark.createDataFrame(rows, "tree string, node long, parent long, role string, text string, score double")
    out = chat.format_paths(m, best=None).select("tree", "leaf", "rank", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("formatted"), F.col("loss")).alias("learnt")).collect()
    got = {(r.tree, r.leaf): ([tuple(t) for t in r.turns], r.learnt, r["rank"]) for r in out}
    assert got["t", 5] == ([("user", hostile), ("assistant", hostile), ("user", ""), ("assistant", "end")], hostile + "end", 1)
    assert got["t", 2] == ([("user", hostile), ("assistant", "short")], "short", 2)
    assert got["u", 1] == ([("", "lone")], "", 1)
    assert chat.format_paths(m).count() == 2 and chat.format_paths(m.limit(0)).count() == 0
    flat = spark.createDataFrame([(1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, None, None)], "conv_id long, turn long, role string, text string")
    assert chat.format_paths(chat.thread_messages(flat)).select(F.size(chat.read_turns(F.col("formatted")))).first()[0] == 3


def test_messages_that_reach_no_root(spark):
    common.prepare(spark)
    paths = lambda rows: {(r.tree, r.leaf, r.node, r.up) for r in chat.tree_paths(spark.createDataFrame(rows, "tree string, node long, parent long, score double")).collect()}
    tail = [("a", 1, 2, 0.0), ("a", 2, 1, 0.0), ("a", 3, 1, 0.0)]
    assert paths(tail) == set()
    # A cycle, a long tail on it, a message that is its own parent; beside them a tree, in another one and in the same.
    rows = tail + [("a", n, n - 1, 0.0) for n in range(4, 40)] + [("b", 1, 1, 0.0), ("b", 2, 1, 0.0), ("b", 5, None, 0.0), ("b", 6, 5, 0.0), (None, 7, None, 0.0), (None, 8, 7, 0.0), (None, 9, 7, 0.0)]
    assert paths(rows) == {("b", 6, 6, 0), ("b", 6, 5, 1), (None, 8, 8, 0), (None, 8, 7, 1), (None, 9, 9, 0), (None, 9, 7, 1)}


def test_branches_are_ranked(spark):
    # Every path of a bushy tree against a walk in memory, best first.
    rng = random.Random(4)
    parent = {n: rng.randrange(max(0, n - 9), n) if n else None for n in range(120)}
    score = {n: float(rng.randint(0, 3)) for n in parent}
    rows = [("t", n, p, "assistant" if n % 2 else "user", f"m{n}", score[n]) for n, p in parent.items()]
    got = chat.format_paths(spark.createDataFrame(rows, "tree string, node long, parent long, role string, text string, score double"), best=None)
    got = {r.leaf: (r["rank"], r.score, [t.text for t in r.turns]) for r in got.select("leaf", "rank", "score", chat.read_turns(F.col("formatted")).alias("turns")).collect()}
    want = {}
    for leaf in set(parent) - set(parent.values()):
        walk = [leaf]
        while parent[walk[-1]] is not None:
            walk.append(parent[walk[-1]])
        want[leaf] = (sum(score[n] for n in walk), [f"m{n}" for n in reversed(walk)])
    order = sorted(want, key=lambda n: (-want[n][0], n))
    assert got == {n: (order.index(n) + 1, *want[n]) for n in want}


def brute_near(rows, words):
    sets = {}
    for d, t in rows:
        w = (t or "").encode().lower().split()
        n = min(words, len(w))
        sets[d] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()
    root = {d: d for d in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    return {d: (len(sets[d]), root[d]) for d in sets}


def test_near_duplicates(spark, odd):
    rows = [(i, say(random.randint(1, 80))) for i in range(20)]
    base = [random.choice(WORDS) for _ in range(120)]
    for i in range(20, 60):
        w = list(base)
        for _ in range(random.randint(0, 5)):
            w[random.randrange(len(w))] = random.choice(WORDS)
        rows.append((i, " ".join(w).upper() if i % 5 == 0 else " ".join(w)))
    rows += [(61, None), (62, ""), (63, "two words"), (64, "TWO  words"), (65, rows[3][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near.near_groups(docs, near.Plan(words=4)).collect()}
    assert got == brute_near(rows, 4)
    assert near.near_dedup(docs, near.Plan(words=4)).count() == len({c for _, c in got.values()})
    assert near.near_groups(odd).count() == odd.count() and near.near_groups(odd.limit(0)).count() == 0


def test_blocks_of_a_bucket_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(near, "BLOCK", 5)
    base = [random.choice(WORDS) for _ in range(100)]
    rows = []
    for i in range(40):
        w = list(base)
        w[random.randrange(100)] = f"x{i}"
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in near.near_groups(docs).collect()} == brute_near(rows, 5)


def test_components(spark):
    edges = [(random.randrange(60), random.randrange(60)) for _ in range(45)]
    root = {n: n for e in edges if e[0] != e[1] for n in e}
    for _ in root:
        for a, b in edges:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    assert {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()} == root


def test_quality(spark, odd):
    good, bad = [(i, say(120), 1) for i in range(60)], [(100 + i, " ".join(f"{random.choice(WORDS).upper()}!!" for _ in range(100)), 0) for i in range(40)] + [(200 + i, "spam spam " * 50, 0) for i in range(20)]
    docs = spark.createDataFrame([r[:2] for r in good + bad] + [(900, None), (901, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2], 0) for r in good + bad] + [(1, None, 0), (5000, 1, 0)], "doc_id long, quality int, toxic int")
    out = {r.doc_id: r for r in quality.classify(docs, labels).collect()}
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 4 == 2) for d, r in out.items())
    held = [(out[d].predicted, q) for d, _, q in good + bad if out[d].held_out]
    assert sum(a == b for a, b in held) >= 0.9 * len(held) and out[900].score == out[901].score
    assert all(0 <= r.score <= 1 for r in out.values())
    assert quality.classify(odd, labels.limit(0)).filter("score <> 0.5").count() == 0
    assert quality.scored(odd, quality.fit(docs, labels)).columns == [*odd.columns, "quality_score"]


def test_quality_against_plain_compression(spark):
    import zstandard

    good, bad = [say(150) for _ in range(60)], [" ".join(f"{random.choice(WORDS).upper()}!!" for _ in range(100)) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(good + bad + [None, "", "é" * 700])), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 60), 0) for i in range(120)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, labels)

    def size(text, dictionary):
        raw, total = text.encode(), 0
        for i in range(0, max(1, len(raw)), quality.BLOCK):
            tool = zstandard.ZstdCompressor(level=1, dict_data=zstandard.ZstdCompressionDict(dictionary), write_content_size=False, write_dict_id=False)
            total += len(tool.compress(raw[i : i + quality.BLOCK]))
        return total

    for r in quality.scored(docs, model).collect():
        text = r.text or ""
        g, b = size(text, model.good), size(text, model.bad)
        alone = len(zstandard.ZstdCompressor(level=1, write_content_size=False).compress(text.encode()))
        u, v = ((x - c) / d for x, c, d in zip(((b - g) / (g + b), np.log(alone / max(1, len(text.encode())))), model.centre, model.scale))
        z = sum(w * f for w, f in zip(model.weights, (1, u, v, u * u, u * v, v * v)))
        assert abs(r.quality_score - 1 / (1 + np.exp(-max(-30, min(30, z))))) < 1e-9
    known = quality.scored(docs, model)
    assert quality.scored(known, model).columns == known.columns


def test_columns_of_the_same_names(spark):
    rows = [(1, "a b c", 7, 8, 9, 10, 11), (2, "a b c", 7, 8, 9, 10, 11)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key int, digest int, at int, stay int, quality_score int")
    kept = exact.exact_dedup(docs)
    assert kept.columns == docs.columns and [tuple(r) for r in kept.collect()] == [rows[1]]
    assert [tuple(r) for r in near.near_dedup(docs).collect()] == [rows[0]]


def test_a_cluster_needs_a_shared_folder():
    class Fake:
        conf = {}

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Fake)


def test_exact_dedup(spark, odd):
    rows = [(i, random.choice(["a", "b", "c", None, "", "A"])) for i in range(60)] + [(7, "b"), (7, "b"), (None, "a"), (None, "lone"), (None, "lone")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    groups = {}
    for d, t in rows:
        groups.setdefault(t or "", []).append(d)
    got = exact.exact_groups(docs, runs=8, fan_in=3).collect()
    best = {t: max((d for d in ds if d is not None), default=None) for t, ds in groups.items()}
    digest = {hashlib.sha256(t.encode()).hexdigest(): t for t in groups}
    assert len(got) == len(rows) and all(r.keep_id == best[digest[r.text_sha256]] and r.group_size == len(groups[digest[r.text_sha256]]) for r in got)
    assert sorted(digest[r.text_sha256] for r in got if r.kept) == sorted(groups)
    assert exact.exact_dedup(docs).count() == len(groups) and exact.exact_dedup(odd).columns == odd.columns
    least = exact.exact_groups(docs, keep="smallest", normalise=F.lower("text")).filter("kept and text_sha256 = sha2('a', 256)").first()
    assert least.doc_id == min(d for d in groups["a"] + groups["A"] if d is not None)
    assert exact.exact_groups(docs.limit(0)).count() == 0


PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_spans(text):
    out = []
    for rank, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (12 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0):
                continue
            if kind == "phone" and not 9 <= len(d) <= 15:
                continue
            out.append((m.start(), rank, m.end(), kind))
    return ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(out))


def test_pii(spark, odd):
    parts = ["a@b.c", "@", ".", "1", "25", "255.255.", "4041894974608795", "-", " ", "+1 (386) 555-3733", "é", "😀", "%", "x.y@z.de", "0", "00", "+", "(", "12.", "999"]
    rows = [(i, "".join(random.choice(parts) for _ in range(random.randint(0, 25)))) for i in range(800)] + [(-1, "1" * 5000), (-2, "a.a@" + "a." * 3000 + "a"), (-3, "1 " * 5000), (-4, None)]
    got = {r.doc_id: r for r in pii.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for d, t in rows:
        assert got[d].spans == brute_spans(t or "") and got[d].base_sha256 == hashlib.sha256(got[d].spans.encode()).hexdigest()
    found = pii.find(spark.createDataFrame([(1, "to a@b.c, or 1.2.3.4 now"), (2, None)], "doc_id long, text string"))
    assert [r[0] for r in found.orderBy("doc_id").select(pii.sanitise(common.text_of("text"), F.col("spans"))).collect()] == ["to [EMAIL], or [IP] now", ""]
    assert pii.report(odd).count() == odd.count() and pii.find(odd).columns[:6] == odd.columns and pii.report(odd.limit(0)).count() == 0


def test_personal_data_of_very_long_texts(spark):
    import time

    numbers = ", ".join(str(random.randint(10, 10**9)) for _ in range(150_000))
    hosts = " ".join(f"10.{random.randint(0, 255)}.{random.randint(0, 300)}.7" for _ in range(20_000)) + " é😀 end a@b.c"
    docs = spark.createDataFrame([(1, numbers), (2, hosts)], "doc_id long, text string")
    began = time.time()
    got = {r.doc_id: r for r in pii.report(docs).collect()}
    assert time.time() - began < 120
    for d, text in ((1, numbers), (2, hosts)):
        assert got[d].base_sha256 == hashlib.sha256(brute_spans(text).encode()).hexdigest()
    clean = pii.find(docs.filter("doc_id = 2")).select(pii.sanitise(common.text_of("text"), F.col("spans"))).first()[0]
    assert clean == re.sub(r"\S+@\S+", "[EMAIL]", re.sub(r"[0-9]+(?:\.[0-9]+){3}", lambda m: "[IP]" if int(m[0].split(".")[2]) < 256 else m[0], hosts))


def test_personal_data_in_odd_columns(spark):
    rows = [(i, "mail joe@lab.org now", 1, "x", "y", 2) for i in range(3)] + [(None, None, 1, "x", "y", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, text_key int, base string, spans string, terms int")
    got = pii.find(docs)
    assert got.columns == [*docs.columns, "base_1", "spans_1"] and got.filter("size(spans_1) = 1").count() == 3


def test_running_totals(spark):
    for n in (0, 1, 255, 256, 257, 1000):
        values = [random.randint(0, 9) for _ in range(n)]
        row = spark.createDataFrame([(values,)], "v array<int>").select(pii.running(F.col("v"), lambda a, b: a + b), pii.running(F.col("v"), lambda a, b: F.greatest(a, b))).first()
        assert list(row[0]) == np.cumsum(values).tolist() and list(row[1]) == (np.maximum.accumulate(values).tolist() if n else [])


def test_revealing_terms(spark):
    rows = [(i, f"{random.choice(WORDS)} {say(3)} zebrafish {random.choice(WORDS)} mail joe@lab.org {random.choice(WORDS)}{i} today") for i in range(12)]
    rows += [(100 + i, f"mail and today {say(30)}") for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert [r.term for r in pii.revealing_terms(docs).collect()] == ["zebrafish"]
    spans = {r.doc_id: r.spans for r in pii.report(docs.filter("doc_id < 300").unionByName(docs.filter("doc_id >= 300"))).filter("doc_id < 12").collect()}
    assert all("term:" in s and "email:" in s for s in spans.values())


def test_edited_passages_are_found_whole(spark):
    rng, filler = random.Random(3), iter(range(10**9))
    fresh = lambda n: [f"x{next(filler)}" for _ in range(n)]
    rows, spans = [], {}
    for k in range(120):
        size = rng.randint(50, 100)
        one = fresh(size)
        two, at = list(one), rng.randint(0, size - 1) if k % 3 else size // 2
        two[at : at + (k % 4 > 0)] = [] if k % 4 == 1 else fresh(1)
        for doc, words in ((2 * k, one), (2 * k + 1, two)):
            before = rng.randint(0, 60)
            rows.append((doc, " ".join(fresh(before) + words + fresh(rng.randint(0, 60)))))
            spans[doc] = (before, words)
    got = {}
    for r in passages.repeats(spark.createDataFrame(rows, "doc_id long, text string")).filter("not kept").collect():
        assert r.keep_id == r.doc_id - 1
        got.setdefault(r.doc_id, set()).update(range(r.first_word, r.first_word + r.n_words))
    shingles = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    for k in range(120):
        (_, one), (before, two) = spans[2 * k], spans[2 * k + 1]
        a, b = shingles(one), shingles(two)
        assert len(a & b) >= 0.8 * len(a | b) or len(one) < 54
        held = [before + i for i, w in enumerate(two) if w in set(one)]
        # Whole but for what lies beyond an edit fewer than five words from an end.
        found = sum(h in got.get(2 * k + 1, ()) for h in held)
        assert found >= len(held) - 4 if len(a & b) >= 0.8 * len(a | b) else found >= 25


def test_exact_repeats_are_found_whole(spark):
    filler = iter(range(10**9))
    fresh = lambda n: " ".join(f"y{next(filler)}" for _ in range(n))
    rows, want = [], set()
    for k, size in enumerate((25, 26, 37, 48, 51, 60, 80, 300)):
        p = fresh(size)
        rows += [(3 * k, f"{fresh(30)} {p} {fresh(9)}"), (3 * k + 1, f"{fresh(7)} {p} {fresh(40)} {p} {fresh(3)}"), (3 * k + 2, f"{p} {fresh(30)} {p}")]
        want |= {(3 * k, 30, size, 3 * k, True), (3 * k + 1, 7, size, 3 * k, False), (3 * k + 1, 47 + size, size, 3 * k, False), (3 * k + 2, 0, size, 3 * k, False), (3 * k + 2, size + 30, size, 3 * k, False)}
    p, a, b, c = fresh(40), fresh(5), fresh(50), fresh(5)
    rows.append((900, f"{a} {p} {b} {p} {c}"))
    want |= {(900, 5, 40, 900, True), (900, 95, 40, 900, False)}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r.doc_id, r.first_word, r.n_words, r.keep_id, r.kept) for r in passages.repeats(docs).collect()} == want
    clean = {r.doc_id: r.text for r in passages.remove_repeats(docs).collect()}
    assert clean[900] == f"{a} {p} {b} {c}"


def test_revealing_terms_of_hot_entities_and_small_corpora(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(9))
    hot = [(i, f"{word()} zebrafish {word()} mail joe@lab.org {word()} today" if i < 40 else f"{word()} mail joe@lab.org {word()}" if i < 300 else f"mail and today {word()}") for i in range(900)]
    small = [(i, f"{word()} zebrafish {word()} mail joe@lab.org {word()} today" if i < 5 else f"mail and today {word()}") for i in range(200)]
    everywhere = [(i, f"{word()} zebrafish {word()} mail joe@lab.org {word()}") for i in range(100)]
    for rows, want in ((hot, ["zebrafish"]), (small, ["zebrafish"]), (everywhere, [])):
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        assert [r.term for r in pii.revealing_terms(docs).collect()] == want


def test_revealing_terms_at_the_edges_and_short_ones(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(9))
    rows = [(i, f"Zebrafish mail {word()} joe@lab.org {word()}") for i in range(8)] + [(10 + i, f"{word()} ann@lab.org {word()} Quokka") for i in range(8)]
    rows += [(20 + i, f"{word()} Kim {word()} kk@lab.org {word()}") for i in range(8)] + [(30 + i, f"{word()} mail and today {word()}") for i in range(400)]
    # Words that the window cuts are no terms: 80 characters before the mail begin inside "axolotl", those after end inside "pangolin".
    rows += [(500 + i, f"{word()} axolotl{'.' * 60} {word()} x: cut@lab.org {word()} {'.' * 62} pangolin {word()}") for i in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.term for r in pii.revealing_terms(docs).collect()}
    assert {"zebrafish", "quokka", "kim"} <= got and not got & {"mail", "and", "today", "axolotl", "pangolin"} and all(a not in got for a in ("axol", "lotl", "pango", "pangol"))


def test_chat_with_a_null_conversation(spark):
    flat = spark.createDataFrame([(None, 0, "user", "a"), (None, 1, "assistant", "b"), (1, 0, "user", "c")], "conv_id long, turn long, role string, text string")
    out = chat.format_paths(chat.thread_messages(flat)).select("tree", chat.read_turns(F.col("formatted")).alias("turns")).collect()
    assert {r.tree: [tuple(t) for t in r.turns] for r in out} == {None: [("user", "a"), ("assistant", "b")], 1: [("user", "c")]}
    assert {(r.tree, r.leaf, r.node) for r in chat.tree_paths(chat.thread_messages(flat)).collect()} == {(None, 2, 1), (None, 2, 2), (1, 1, 1)}
