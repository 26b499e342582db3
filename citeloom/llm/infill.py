"""Fill-in-the-middle transformation (operator 12).

A relational plan over units, a unit being a word with the blanks before it (or
the blanks that end a text):

1. Every text is matched once; of a text that will be rearranged the lengths of
   its units go on, up to the last unit that a cut asks for.
2. posexplode makes one row for each of these units, and a window's running sum
   of lengths says at which character each unit ends.
3. Cut requests (one row for each document and cut) are joined with the units
   by document and ordinal, and the offsets found are aggregated per document.
4. The offsets meet the texts again, and substring cuts prefix, middle, suffix.

Texts that stay plain need no units and take no part in any shuffle. Documents
are told apart by two 64-bit hashes of id and text, so units travel without
either; of rows that repeat with id and text one is measured. Units are made
after the shuffle by document, so the window and the join of step 3 move nothing:
the join's keys are the document's, its ordinal a further condition.

Defined cases: a null text counts as empty, an empty text is plain with no
unit; a null id hashes as the empty string; repeated rows give repeated results.
The work of a document is linear in its text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from citeloom.llm.common import fresh, text_of

UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100 documents so many are rearranged, and of 100 of these so many put the suffix first.
RATE, SPM_RATE, SEED = 50, 80, 42
KEY = ["k1", "k2"]


def draw(doc_id: Column, i: int, seed: int = SEED) -> Column:
    """The i-th (1 to 8) 32-bit number that a document's id gives, as a long."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * i - 7, 8), 16, 10).cast("long")


def form_of(doc_id: Column, text: Column, rate: int = RATE, spm_rate: int = SPM_RATE, seed: int = SEED) -> Column:
    """plain, spm or psm. A text that holds a mark stays plain, so marks in outputs are unambiguous."""
    marked = F.contains(text, F.lit(PREFIX)) | F.contains(text, F.lit(SUFFIX)) | F.contains(text, F.lit(MIDDLE))
    plain = (text == "") | (draw(doc_id, 3, seed) % 100 >= rate) | marked
    return F.when(plain, "plain").when(draw(doc_id, 4, seed) % 100 < spm_rate, "spm").otherwise("psm")


def unit_rows(measured: DataFrame) -> DataFrame:
    """(k1, k2, ordinal, ends): where each unit of measured(k1, k2, lengths) ends, in characters; ordinals from 1."""
    units = measured.select(*KEY, F.posexplode("lengths").alias("at", "length"))
    upto = W.partitionBy(*KEY).orderBy("at").rowsBetween(W.unboundedPreceding, W.currentRow)
    return units.select(*KEY, (F.col("at") + 1).alias("ordinal"), F.sum(F.col("length").cast("long")).over(upto).alias("ends"))


def cut_offsets(rows: DataFrame, seed: int = SEED) -> DataFrame:
    """(k1, k2, n, first, last): units of each text of rows(k1, k2, id, text), and the characters before its cuts."""
    units = F.regexp_extract_all("text", F.lit(UNIT), F.lit(0))
    cut = lambda i: (draw(F.col("id"), i, seed) % (F.col("n") + 1)).cast("int")
    measured = rows.select(*KEY, "id", F.transform(units, lambda u: F.length(u)).alias("lengths"))
    measured = measured.withColumn("n", F.size("lengths")).withColumn("low", F.least(cut(1), cut(2))).withColumn("high", F.greatest(cut(1), cut(2)))
    # Units behind the last cut are not asked for.
    measured = measured.select(*KEY, "n", "low", "high", F.slice("lengths", 1, F.col("high")).alias("lengths")).dropDuplicates(KEY)
    requests = measured.select(*KEY, "n", F.explode(F.array(F.struct(F.lit(0).alias("cut"), F.col("low").alias("ordinal")), F.struct(F.lit(1).alias("cut"), F.col("high").alias("ordinal")))).alias("r"))
    requests = requests.select(*KEY, "n", "r.cut", F.col("r.ordinal").alias("asked"))
    ends = unit_rows(measured.select(*KEY, "lengths"))
    same = [requests[k] == ends[k] for k in KEY]
    met = requests.hint("merge").join(ends, [*same, ends["ordinal"] - requests["asked"] == 0], "left").select(*[requests[k] for k in KEY], "n", "cut", "ends")
    # A cut before the first unit meets none.
    offset = lambda i: F.coalesce(F.max(F.when(F.col("cut") == i, F.col("ends"))), F.lit(0))
    return met.groupBy(*KEY).agg(F.max("n").cast("long").alias("n"), offset(0).alias("first"), offset(1).alias("last"))


def arranged(form: Column, prefix: Column, middle: Column, suffix: Column) -> Column:
    psm = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)
    return F.when(form == "psm", psm).otherwise(F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))


def restore(form: Column, output: Column) -> Column:
    """The text that an output of this form was made of; it reads nothing but these two."""
    lead = F.when(form == "psm", SUFFIX).otherwise(PREFIX)
    at, mid = F.locate(SUFFIX, output, 2), F.locate(MIDDLE, output)
    at = F.when(form == "psm", at).otherwise(F.locate(PREFIX, output))
    one, two = F.substr(output, F.lit(4), at - 4), F.substr(output, at + F.length(lead), mid - at - F.length(lead))
    three = F.substr(output, mid + 3)
    return F.when(form == "plain", output).when(form == "psm", F.concat(one, three, two)).otherwise(F.concat(two, three, one))


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: int = RATE, spm_rate: int = SPM_RATE, seed: int = SEED) -> DataFrame:
    """docs with the columns n (units), form, prefix_chars, middle_chars and output, under names that docs doesn't have.

    The five new columns stand last, in this order. Of plain texts
    prefix_chars and middle_chars are null and output is the text.
    """
    n, form, prefix, middle, output = (fresh(docs, c) for c in ("n", "form", "prefix_chars", "middle_chars", "output"))
    whole, one, two = (fresh(docs, c) for c in ("whole", *KEY))
    own = [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.withColumn(whole, text_of(docs[text_col])).withColumn(form, form_of(docs[id_col], F.col(whole), rate, spm_rate, seed))
    none = F.lit(None).cast("long")
    plain = rows.filter(F.col(form) == "plain").select(*own, F.regexp_count(whole, F.lit(UNIT)).cast("long").alias(n), form, none.alias(prefix), none.alias(middle), F.col(whole).alias(output))
    moved = rows.filter(F.col(form) != "plain").withColumn(one, F.xxhash64(docs[id_col], whole)).withColumn(two, F.xxhash64(whole, docs[id_col], F.lit(1)))
    found = cut_offsets(moved.select(F.col(one).alias("k1"), F.col(two).alias("k2"), docs[id_col].alias("id"), F.col(whole).alias("text")), seed)
    found = found.select(F.col("k1").alias(one), F.col("k2").alias(two), F.col("n").alias(n), F.col("first").alias(prefix), (F.col("last") - F.col("first")).alias(middle))
    met = moved.join(found.hint("merge"), [one, two])
    text, a, b = F.col(whole), F.col(prefix).cast("int"), F.col(middle).cast("int")
    made = arranged(F.col(form), F.substr(text, F.lit(1), a), F.substr(text, a + 1, b), F.substr(text, a + b + 1))
    return met.select(*own, n, form, prefix, middle, made.alias(output)).unionByName(plain)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256) of every row."""
    made = fill_in_middle(docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")), "id")
    return made.select(F.col("id").alias(id_col), "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restore(F.col("form"), F.col("output")), 256).alias("restored_sha256"))
