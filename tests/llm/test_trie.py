"""The prefix trie against one made of all prefixes in memory."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from citeloom.llm import trie

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "conv_id long, turn long, role string, text string, depth string, tokens int"


def plain(rows, rebuild=True):
    turns, seqs = defaultdict(list), {}
    for c, t, r, x in rows:
        r, x = r or "", x or ""
        turns[c].append((t is not None, t or 0, hashlib.sha256(f"{len(r)}:{r}{x}".encode()).digest(), (r, x)))
    for c in turns:
        turns[c] = [t[3] for t in sorted(turns[c])]
    for c, own in turns.items():
        h, first = 0, []
        if rebuild and c is not None and (rest := abs(c) % 20):
            h, first = zlib.crc32(str(c).encode()) % 4, turns.get(c - (rest if c > 0 else -rest), [])
        seqs[c] = (*first[:h], *own[h:])
    members, kids = defaultdict(list), defaultdict(set)
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
            if d:
                kids[s[: d - 1]].add(s[:d])
    least = lambda cs: min((c for c in cs if c is not None), default=None)
    leaves, saved, out = defaultdict(int), defaultdict(int), []
    for p, cs in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(cs) - 1) * len(WORD.findall(p[-1][1])) if p else 0
    for p, cs in members.items():
        ends = sorted((c for c in cs if len(seqs[c]) == len(p)), key=lambda c: (c is None, c or 0))
        text = ",".join("null" if c is None else str(c) for c in ends)
        out.append((least(cs), len(p), least(members[p[:-1]]) if p else None, len(cs), len(kids[p]), leaves[p], saved[p], hashlib.sha256(text.encode()).hexdigest()))
    return out


def ordered(rows):
    return sorted(map(tuple, rows), key=lambda r: tuple((x is None, x if x is not None else 0) for x in r))


def conversations(seed, n):
    r = random.Random(seed)
    say = lambda: r.choice(["hello", "hi there you", "", "what is this\n", "é 中", None, *[f"t{i} and more" for i in range(8)]])
    hot = [("user", f"shared turn {i}") for i in range(6)]
    rows = []
    for c in range(n):
        turns = [(r.choice(["user", "assistant", None]), say()) for _ in range(r.choice([1, 2, 3, 5, 9]))]
        if c % 3 == 0:
            turns = hot[: r.randint(1, 6)] + turns[: r.choice([0, 1, 2])]
        rows += [(c * r.choice([1, 1, 7]) if c % 5 else c, i, *t) for i, t in enumerate(turns)]
    return rows


@pytest.mark.parametrize("local_turns", [1 << 16, 40, 1])
def test_against_all_prefixes(spark, local_turns):
    rows = conversations(local_turns, 100)
    rows += [(-7, 0, "user", "x"), (-7, 1, "assistant", "y"), (-20, None, "user", "null turn"), (-20, 0, "a", "b"), (41, 0, "user", "p"), (41, 0, "user", "p"), (41, 0, "user", "q"), (None, 2, "user", "no id"), (None, 1, None, None)]
    df = spark.createDataFrame([(*x, "d", 1) for x in rows], SCHEMA).repartition(5)
    for rebuild in (True, False) if local_turns == 40 else (True,):
        assert ordered(trie.conversation_trie(df, rebuild=rebuild, local_turns=local_turns).collect()) == ordered(plain(rows, rebuild))


def test_edges(spark):
    make = lambda rows: spark.createDataFrame([(*x, "d", 1) for x in rows], SCHEMA)
    run = lambda rows, **k: ordered(trie.conversation_trie(make(rows), **k).collect())
    assert trie.conversation_trie(make([(1, 1, "a", "b")]).limit(0)).count() == 0
    for rows in ([(None, None, None, None)], [(c, 0, "user", "all the same") for c in range(300)], [(40, i, "u", f"turn {i}") for i in range(300)]):
        assert run(rows, local_turns=10) == ordered(plain(rows))


def test_ends_of_many_ids_are_in_order(spark):
    ids = random.Random(1).sample(range(-5000, 50_000), 6000)
    df = spark.createDataFrame([(1, 2, i) for i in [*ids, None]], "k1 long, k2 long, conv long").repartition(4)
    want = hashlib.sha256(",".join([*map(str, sorted(ids)), "null"]).encode()).hexdigest()
    assert [r.ends for r in trie.ends_digests(df).collect()] == [want]
