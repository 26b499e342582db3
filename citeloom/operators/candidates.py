"""Which passages of a paper go to the extractor, within a budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.functions.identifiers import first_of, looks_relevant, strip

BUDGET = 24_000
CUT_MARK = "\n\n[... truncated for prompt budget ...]"
#: Headings of sections that often hold a data statement (a fixed value).
HEADINGS = r"(?i)(data\s+availability|availability\s+of\s+data|code\s+availability|supplement|materials?\s+and\s+methods|methods?|results?|experimental\s+procedures|deposit|accession)"
SECTION = "array<struct<section_title:string,section_text:string,section_path:string,page:int>>"


def chunks(sections: Column, abstract: Column) -> Column:
    """Labelled chunks in order of priority: paragraphs, headed sections, abstract."""
    blank = lambda c: F.coalesce(c, F.lit(""))
    chunk = lambda label, text: F.struct(label.alias("label"), F.coalesce(strip(text), F.lit("")).alias("text"))

    def paragraphs(s: Column) -> Column:
        label = F.when(blank(s["section_title"]) == "", "(paragraph)").otherwise(s["section_title"])
        # What no section says no paragraph of it does: most sections are tested once.
        some = F.filter(F.split(blank(s["section_text"]), r"\n{2,}"), looks_relevant)
        return F.transform(F.when(looks_relevant(s["section_text"]), some).otherwise(F.array().cast("array<string>")), lambda p: chunk(label, p))

    first = F.flatten(F.transform(sections, paragraphs))
    second = F.transform(F.filter(sections, lambda s: blank(s["section_title"]).rlike(HEADINGS)), lambda s: chunk(s["section_title"], s["section_text"]))
    third = F.when(looks_relevant(abstract), F.array(chunk(F.lit("Abstract"), abstract))).otherwise(F.array().cast("array<struct<label:string,text:string>>"))
    return F.filter(F.concat(first, second, third), lambda c: c["text"] != "")


def first_by_signature(items: Column, size: int = 200) -> Column:
    """Chunks whose first characters no earlier chunk has."""
    return first_of(items, lambda c: F.left(c["text"], F.lit(size)))


def fallback(abstract: Column, full_text: Column, budget: int = BUDGET) -> Column:
    """The abstract and the end of the body, for papers where nothing was selected."""
    a = F.nullif(F.coalesce(strip(abstract), F.lit("")), F.lit(""))
    head = F.concat(F.lit("### Abstract\n"), a)
    room = F.lit(budget - 200) - F.coalesce(F.length(head), F.lit(0))
    body = F.nullif(F.coalesce(strip(full_text), F.lit("")), F.lit(""))
    tail = F.when(room > 0, F.concat(F.lit("### [fallback: tail of paper body]\n"), F.right(body, room)))
    return F.concat_ws("\n\n", head, tail)


def select_passages(papers: DataFrame, budget: int = BUDGET) -> DataFrame:
    """papers(sections, abstract, full_text, ...) with candidate_passages and candidate_char_count.

    Everything is one projection: no shuffle, no Python.
    """
    sections = F.coalesce(F.col("sections").cast(SECTION), F.array().cast(SECTION))
    listed = papers.withColumn("_chunks", chunks(sections, F.coalesce("abstract", F.lit(""))))
    once = listed.withColumn("_chunks", first_by_signature(F.col("_chunks")))
    text = F.array_join(F.transform("_chunks", lambda c: F.concat(F.lit("### "), c["label"], F.lit("\n"), c["text"])), "\n\n")
    chosen = once.withColumn("_text", F.when(F.size("_chunks") > 0, text).otherwise(fallback(F.col("abstract"), F.col("full_text"), budget)))
    cut = F.when(F.length("_text") > budget, F.concat(F.left("_text", F.lit(budget)), F.lit(CUT_MARK))).otherwise(F.col("_text"))
    return chosen.withColumn("candidate_passages", cut).withColumn("candidate_char_count", F.length("candidate_passages")).drop("_chunks", "_text")
