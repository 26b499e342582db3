"""The corpus part of the personal-data operator against counting by hand over random corpora."""

import math
import random
import re

from citeloom.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LETTERS = re.compile(r"[^\W\d_]+")


def around(text, start, end):
    """(context, terms) of what stands at start to end: the words beside it, and whole words within the window."""
    size = pii.CONTEXT_CHARS
    left, right = text[max(0, start - size) : start], text[end : end + size]
    before, after = re.search(r"(\S+)\s*$", left), re.search(r"^\s*(\S+)", right)
    if start > size and not text[start - size - 1].isspace():
        left = re.sub(r"^\S*", "", left)
    if end + size < len(text) and not text[end + size].isspace():
        right = re.sub(r"\S*$", "", right)
    return (before and before[1], after and after[1]), {w.lower() for w in LETTERS.findall(f"{left} {right}")}


def revealing(texts):
    texts = set(texts)
    contexts, copies, pairs, holding = {}, {}, {}, {}
    for text in texts:
        for w in {w.lower() for w in LETTERS.findall(text)}:
            holding[w] = holding.get(w, 0) + 1
        for m in EMAIL.finditer(text):
            entity = m[0].lower()
            beside, terms = around(text, m.start(), m.end())
            contexts.setdefault(entity, set()).add(beside)
            copies.setdefault(entity, set()).add(text)
            for t in terms:
                seen = pairs.setdefault((entity, t), (set(), set()))
                seen[0].add(beside)
                seen[1].add(text)
    out = set()
    for (entity, term), (beside, held) in pairs.items():
        if len(beside) < pii.MIN_CONTEXTS or len(contexts[entity]) < pii.MIN_CONTEXTS:
            continue
        share, prior, n = len(held) / holding[term], len(copies[entity]) / len(texts), holding[term]
        bits = math.log2(share) - math.log2(prior)
        apart = n - len(held)
        evidence = len(held) * bits + (apart * (math.log2(1 - share) - math.log2(1 - prior)) if apart and prior < 1 else 0)
        if share >= pii.MIN_SHARE and bits >= -pii.MIN_PART * math.log2(prior) and evidence >= pii.MIN_EVIDENCE:
            out.add(term)
    return out


def corpus(seed):
    r = random.Random(seed)
    common = ["".join(r.choice("abcdefgh") for _ in range(r.randint(1, 9))) for _ in range(60)]
    # Each entity has words that mostly stand near it, some of them with another entity or alone as well.
    own = {f"{n}@x{n}.org": ["".join(r.choice("ijklmnop") for _ in range(5)) for _ in range(3)] for n in "pqrs"}
    loose = [w for ws in own.values() for w in ws]
    texts = []
    for _ in range(500):
        words = [r.choice(common) for _ in range(r.randint(3, 40))]
        if r.random() < 0.5:
            entity = r.choice(list(own))
            at = r.randint(0, len(words))
            words[at:at] = [r.choice([*own[entity], r.choice(common)]), *(r.choice(common) for _ in range(r.randint(0, 3))), r.choice([entity, entity.upper()]), r.choice([r.choice(common), r.choice(own[entity])])]
        if r.random() < 0.06:
            words.insert(r.randint(0, len(words)), r.choice(loose))
        texts.append(r.choice([" ", "  ", "\n"]).join(words))
    return texts + texts[:40]


def test_terms_against_counting_by_hand(spark):
    found = []
    for seed in (1, 2, 3):
        texts = corpus(seed)
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
        want = revealing(texts)
        assert {r.term for r in pii.revealing_terms(docs).collect()} == want
        found.append(want)
        # Every place of a term is a span, whole words only, in any case.
        spans = {r.doc_id: {s for s in r.spans.split(",") if s.startswith("term:")} for r in pii.report(docs).collect()}
        for i, text in enumerate(texts):
            assert spans[i] == {f"term:{m.start()}:{m.end()}" for m in LETTERS.finditer(text) if m[0].lower() in want}
    assert any(found) and len({frozenset(f) for f in found}) == 3
