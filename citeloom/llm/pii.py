"""Personal data: patterns and information-theoretic sanitisation (operator 10).

DataFrame operations only. Patterns find e-mail addresses, IP addresses, card
and phone numbers. What they find are the protected entities; the corpus then
says which other terms give them away. For a term seen near an entity, over
independent contexts (mentions with other neighbouring words),

    disclosure = log2( P(entity | term) / P(entity) )

with P(entity | term) the share of the texts holding the term that hold it
near the entity, and P(entity) the entity's share of all texts. An entity can
give away log2(1 / P(entity)) at most, and a term is held against that part,
so neither frequent entities nor small corpora are left out. That it isn't
chance is judged by the evidence of all texts holding the term,

    n * KL(P(entity | term) || P(entity)) bits, n = texts holding the term.

A term whose part, evidence, conditional probability and number of contexts
all reach their thresholds is generalised wherever it occurs. Counts are over
all texts, copies of a text counting once.

Defined cases: null and empty texts have no spans; spans of different kinds
may overlap and are all reported; sanitised texts replace overlapping spans by
the placeholder of the first. Positions are code points, ends exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.llm.common import forget, fresh, materialise, text_of

_LOCAL = "[A-Za-z0-9._%+-]"
#: Kinds in their order, with patterns that match what the plain ones do but
#: neither backtrack nor restart inside a run (long runs stay linear).
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = (*PATTERNS, "term")
SPAN = "array<struct<start:int,kind:int,end:int>>"
#: Thresholds of the corpus part.
CONTEXT_CHARS = 80
BLOCK, CHUNK = 256, 1024
MIN_CONTEXTS, MIN_SHARE, MIN_PART, MIN_EVIDENCE = 5, 0.9, 0.5, 20.0


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits has a valid Luhn check digit."""
    marks = F.reverse(F.split(number, ""))

    def share(d: Column, i: Column) -> Column:
        value = d.cast("int")
        double = value * 2
        return F.when(i % 2 == 0, value).otherwise(F.when(double > 9, double - 9).otherwise(double))

    return F.aggregate(F.transform(marks, share), F.lit(0), lambda a, b: a + b) % 10 == 0


def octet(part: Column) -> Column:
    bare = F.regexp_replace(part, "^0+(?=[0-9])", "")
    return (F.length(bare) <= 3) & (F.lpad(bare, 3, "0") <= "255")


def valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(match, r"\."), octet)
    if kind == "card":
        size = F.length(digits(match))
        return F.when(size.between(12, 19), luhn(digits(match))).otherwise(False)
    if kind == "phone":
        return F.length(digits(match)).between(9, 15)
    return F.lit(True)


def let(value: Column, use) -> Column:
    """use(value), with value computed once a row."""
    return F.element_at(F.transform(F.array(value), use), 1)


def running(values: Column, combine) -> Column:
    """Running totals of an array of int under combine (from 0): in blocks, then over the blocks.

    Appending to one list would be quadratic in its length; here a list of n
    is copied BLOCK times and a list of n / BLOCK appended to.
    """
    last = lambda a: F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0))
    none = F.array().cast("array<int>")
    append = lambda a, x: F.concat(a, F.array(combine(last(a), x)))
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(values)), F.lit(BLOCK))
    blocks = F.transform(starts, lambda i: F.aggregate(F.slice(values, i, F.lit(BLOCK)), none, append))
    # Each block's total goes on top of those before it.
    before = lambda local: F.aggregate(local, F.array(F.lit(0)), lambda a, block: append(a, last(block)))
    return let(blocks, lambda local: F.flatten(F.zip_with(local, F.slice(before(local), F.lit(1), F.size(local)), lambda block, base: F.transform(block, lambda x: combine(base, x)))))


def chunks(text: Column) -> Column:
    """The text in parts of CHUNK code points: looking up a place in a long text is linear, in a part it is not."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))


def cut(parts: Column, start: Column, size: Column) -> Column:
    """size code points from start (0-based) of a text in chunks."""
    first = (start / CHUNK).cast("int")
    held = F.slice(parts, first + 1, ((start + size) / CHUNK).cast("int") - first + 1)
    return F.substr(F.array_join(held, ""), start % CHUNK + 1, size)


def matches(text: Column, pattern: Column | str, kind: int) -> Column:
    """Spans of all matches with the matched text: the gaps between give their places."""
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    pairs = F.filter(F.arrays_zip(gaps.alias("gap"), found.alias("match")), lambda p: p["match"].isNotNull())

    def placed(p: Column) -> Column:
        ends = running(F.transform(p, lambda x: x["gap"] + F.length(x["match"])), lambda a, b: a + b)
        return F.zip_with(p, ends, lambda x, end: F.struct((end - F.length(x["match"])).alias("start"), F.lit(kind).alias("kind"), end.alias("end"), x["match"].alias("match")))

    return let(pairs, placed)


def validator(kind: str):
    return lambda m: valid(kind, m["match"])


def of_kind(kind: int):
    return lambda s: s["kind"] == kind


def bare(spans: Column) -> Column:
    return F.transform(spans, lambda m: F.struct(m["start"].alias("start"), m["kind"].alias("kind"), m["end"].alias("end")))


def base_spans(text: Column) -> Column:
    """Sorted spans (start, kind number, end) of the four patterns."""
    none = F.array().cast(SPAN)
    kinds = []
    for i, (kind, pattern) in enumerate(PATTERNS.items()):
        spans = bare(F.filter(matches(text, pattern, i), validator(kind)))
        hint = {"email": F.contains(text, F.lit("@")), "phone": F.contains(text, F.lit("+"))}.get(kind)
        may = text.rlike(pattern) if hint is None else hint & text.rlike(pattern)
        kinds.append(F.when(may, spans).otherwise(none))
    return F.array_sort(F.concat(*kinds))


def show_spans(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat(F.element_at(names, s["kind"] + 1), F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")


def words(text: Column) -> Column:
    """Distinct lower-cased runs of letters, however short."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"\p{L}++"), F.lit(0)), F.lower))


def spotted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, key, base, mentions) of every row, written once for all that follows.

    key is a hash of the text; base has the spans of the patterns, mentions
    (kind, entity, context, terms) what stands around each. Texts stay behind.
    """
    text = F.col("text")
    rows = docs.select(docs[id_col].alias("id"), text_of(docs[text_col]).alias("text"))
    rows = rows.select("id", "text", F.xxhash64("text").alias("key"), base_spans(text).alias("base"))

    def mention(s: Column, at: Column, around: Column) -> Column:
        """s begins at ``at`` of ``around``, which has one character more than the context on either side."""
        end = at + s["end"] - s["start"]
        left = F.substr(around, F.greatest(F.lit(1), at - CONTEXT_CHARS + 1), F.least(F.lit(CONTEXT_CHARS), at))
        right = F.substr(around, end + 1, F.lit(CONTEXT_CHARS))
        value = F.substr(around, at + 1, end - at)
        entity = F.when(s["kind"] >= 2, digits(value)).otherwise(F.lower(value))
        beside = F.xxhash64(F.regexp_extract(left, r"(\S+)\s*$", 1), F.regexp_extract(right, r"^\s*(\S+)", 1))
        # A word cut by the window's edge is not a term; beyond the text's ends the character is empty.
        cut_left = (at > CONTEXT_CHARS) & F.substr(around, F.lit(1), F.lit(1)).rlike(r"\S")
        cut_right = F.substr(around, end + CONTEXT_CHARS + 1, F.lit(1)).rlike(r"\S")
        whole = F.concat_ws(" ", F.when(cut_left, F.regexp_replace(left, r"^\S*", "")).otherwise(left), F.when(cut_right, F.regexp_replace(right, r"\S*$", "")).otherwise(right))
        return F.struct(s["kind"].alias("kind"), entity.alias("entity"), beside.alias("context"), words(whole).alias("terms"))

    def placed(parts: Column, s: Column) -> Column:
        low = F.greatest(F.lit(0), s["start"] - CONTEXT_CHARS - 1)
        return let(cut(parts, low, s["end"] + CONTEXT_CHARS + 1 - low), lambda around: mention(s, s["start"] - low, around))

    none = F.array().cast("array<struct<kind:int,entity:string,context:bigint,terms:array<string>>>")
    mentions = F.when(F.size("base") > 0, let(chunks(text), lambda parts: F.transform("base", lambda s: placed(parts, s)))).otherwise(none)
    return materialise(rows.select("id", "key", "base", mentions.alias("mentions")), "spotted")


def term_hits(docs: DataFrame, seen: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, key, term) of every row that holds a revealing term; see the module's docstring.

    Candidates are gathered around the entities first; only they are looked for
    over the corpus. They are written before that, so their size decides how
    they are joined.
    """
    total = seen.agg(F.count_distinct("key").alias("total"))
    near = seen.select("key", F.explode("mentions").alias("m")).select("key", "m.*")
    per_entity = near.groupBy("kind", "entity").agg(F.count_distinct("context").alias("contexts"), F.count_distinct("key").alias("copies")).filter(F.col("contexts") >= MIN_CONTEXTS)
    together = near.select("kind", "entity", "context", "key", F.explode("terms").alias("term"))
    together = together.groupBy("kind", "entity", "term").agg(F.count_distinct("context").alias("contexts"), F.count_distinct("key").alias("together")).filter(F.col("contexts") >= MIN_CONTEXTS)
    candidates = materialise(together.drop("contexts").join(per_entity.select("kind", "entity", "copies"), ["kind", "entity"]), "candidates")
    text = text_of(docs[text_col])
    rows = docs.select(docs[id_col].alias("id"), F.xxhash64(text).alias("key"), F.explode(words(text)).alias("term"))
    if candidates.isEmpty():
        return rows.limit(0)
    hits = materialise(rows.join(candidates.select("term").distinct(), "term").select("id", "key", "term"), "hits")
    held = hits.groupBy("term").agg(F.count_distinct("key").alias("holding"))
    judged = candidates.join(held, "term").crossJoin(F.broadcast(total))
    share = F.col("together") / F.col("holding")
    prior = F.col("copies") / F.col("total")
    bits = F.log2(share) - F.log2(prior)
    apart = F.col("holding") - F.col("together")
    against = F.when((apart > 0) & (prior < 1), apart * (F.log2(1 - share) - F.log2(1 - prior))).otherwise(0.0)
    evidence = F.col("together") * bits + against
    revealing = judged.filter((share >= MIN_SHARE) & (bits >= -MIN_PART * F.log2(prior)) & (evidence >= MIN_EVIDENCE)).select("term").distinct()
    out = materialise(hits.join(revealing, "term").select("id", "key", "term"), "revealing")
    forget(candidates, hits)
    return out


def revealing_terms(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The terms (term) that reveal protected entities."""
    return term_hits(docs, spotted(docs, id_col, text_col), id_col, text_col).select("term").distinct()


def id_key(column: Column) -> Column:
    """A row's id as a key that null joins on too."""
    return F.coalesce(column.cast("string"), F.lit(""))


def term_spans(text: Column, terms: Column) -> Column:
    """Spans of whole words that are among the terms (an array)."""
    pattern = F.concat(F.lit(r"(?iu)(?<!\p{L})(?:"), F.array_join(F.array_sort(terms), "|"), F.lit(r")(?!\p{L})"))
    return bare(matches(text, pattern, len(PATTERNS)))


def per_row(hits: DataFrame, own: str, key: str, terms: str) -> DataFrame:
    """(own, key, terms): the revealing terms of each text, by its row's id and its hash."""
    return hits.groupBy(id_key(F.col("id")).alias(own), F.col("key").alias(key)).agg(F.collect_set("term").alias(terms))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of docs, with base (pattern spans) and spans (all, sorted)."""
    base, spans, own, key, terms = (fresh(docs, n) for n in ("base", "spans", "own_key", "text_key", "terms"))
    text = text_of(docs[text_col])
    out = docs.withColumn(base, base_spans(text))
    hits = term_hits(docs, spotted(docs, id_col, text_col), id_col, text_col)
    if hits.isEmpty():
        return out.withColumn(spans, F.col(base))
    # By id and text: a text with many copies is no hot key.
    met = out.withColumn(own, id_key(docs[id_col])).withColumn(key, F.xxhash64(text)).join(per_row(hits, own, key, terms), [own, key], "left")
    more = F.when(F.col(terms).isNotNull(), term_spans(text, F.col(terms))).otherwise(F.array().cast(SPAN))
    return met.withColumn(spans, F.array_sort(F.concat(F.col(base), more))).select(*[F.col(f"`{c}`") for c in docs.columns], base, spans)


def sanitise(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    ends = lambda s: running(F.transform(s, lambda x: x["end"]), lambda a, b: F.greatest(a, b))
    # reach: how far the spans up to this one go. A span that begins behind that of the one before is part of it.
    reached = lambda s: F.zip_with(s, ends(s), lambda x, reach: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), reach.alias("reach")))

    def heads(all_: Column) -> Column:
        before = lambda i: F.when(i > 0, F.try_element_at(all_, i)["reach"]).otherwise(F.lit(0))
        marked = F.transform(all_, lambda x, i: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), before(i).alias("after")))
        return F.filter(marked, lambda x: x["start"] >= x["after"])

    def replaced(all_: Column, parts: Column) -> Column:
        # Before each placeholder stands the text since the spans before it.
        pieces = F.transform(heads(all_), lambda x: F.concat(cut(parts, x["after"], x["start"] - x["after"]), F.element_at(names, x["kind"] + 1)))
        last = F.element_at(all_, -1)["reach"]
        return F.concat(F.array_join(pieces, ""), cut(parts, last, F.length(text) - last))

    return F.when(F.size(spans) > 0, let(reached(spans), lambda s: let(chunks(text), lambda parts: replaced(s, parts)))).otherwise(text)


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_email, n_ip, n_card, n_phone, base_sha256, spans) of every row."""
    rows = docs.select(docs[id_col].alias("id"), text_of(docs[text_col]).alias("text"))
    found = spotted(rows, "id")
    hits = term_hits(rows, found, "id")
    out = found.select("id", "base", F.col("base").alias("spans"))
    if not hits.isEmpty():
        terms = per_row(hits, "own", "key", "terms")
        texts = rows.select(id_key(F.col("id")).alias("own"), F.xxhash64("text").alias("key"), "text").join(terms, ["own", "key"])
        # Repeated rows have one entry.
        where = texts.select("own", "key", term_spans(F.col("text"), F.col("terms")).alias("more")).dropDuplicates(["own", "key"])
        out = found.withColumn("own", id_key(F.col("id"))).join(where, ["own", "key"], "left")
        out = out.select("id", "base", F.when(F.col("more").isNotNull(), F.array_sort(F.concat("base", "more"))).otherwise(F.col("base")).alias("spans"))
    counts = [F.size(F.filter("base", of_kind(i))).cast("long").alias(f"n_{kind}") for i, kind in enumerate(PATTERNS)]
    return out.select(F.col("id").alias(id_col), *counts, F.sha2(show_spans(F.col("base")), 256).alias("base_sha256"), show_spans(F.col("spans")).alias("spans"))
