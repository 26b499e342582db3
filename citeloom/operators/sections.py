"""Papers from HTML, JATS XML and page texts.

Markup needs a tree, which is built and read in Arrow batches, one document at a
time: JATS sections come out whole, of HTML the blocks in their order. All else
is built-in functions: ids from the raw text, HTML and page sections cut at
headings, full texts.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator
from html.entities import name2codepoint

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.functions.identifiers import let, strip
from citeloom.functions.registry import literal_map
from citeloom.operators import markup
from citeloom.operators.markup import words
from citeloom.session import reach_workers

DOI, PMCID, PMID = r"(?i)10\.\d{4,9}/[\w\.\-/:;()<>]+", r"(?i)PMC\d{4,}", r"(?i)\bpmid[:\s]*(\d{4,9})\b"
#: Elements without readable content (fixed values).
DROPPED = ("script", "style", "noscript", "img", "iframe", "video", "audio", "canvas", "svg", "object", "embed", "button", "input", "select", "textarea", "form", "head", "meta", "link")
#: Those of them that have no end tag.
VOID = ("img", "embed", "input", "meta", "link")
#: Section titles that are left out (fixed values).
SKIPPED = r"(?i)^(author\s+contributions?|competing\s+interests?|conflict\s+of\s+interest|ethics?\s+(statement|declaration)s?|funding|declaration\s+of\s+competing)\b"
#: Shapes of headings in page texts, and the closing sections (fixed values).
NUMBERED = r"^\s*\d+(?:\.\d+)*\s+[A-Z][A-Za-z0-9 ,\-/]{2,80}\s*$"
NAMED = r"(?i)^\s*(Abstract|Introduction|Methods?|Materials and Methods|Results?|Discussion|Conclusions?|References|Acknowledg(?:e?ments?)|Data Availability(?: Statement)?|Code Availability|Availability of Data and Materials?|Supplementary (?:Information|Materials?))\s*$"
LINE_ENDS = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\u0085\u2028\u2029]"
CUT_FROM = r"(?i)^(\d+(?:\.\d+)*\s+)?(references?|bibliography|acknowledg(?:e?ments?)|author\s+contributions?|competing\s+interests?|conflict\s+of\s+interest|ethics?\s+(statement|declaration)s?|funding)\s*$"


def strip_non_content(html: Column) -> Column:
    """HTML without comments and elements that hold nothing to read."""
    out = F.regexp_replace(html, r"(?s)<!--.*?-->", "")
    for tag in DROPPED:
        out = F.regexp_replace(out, rf"(?is)<{tag}\b[^>]*>" if tag in VOID else rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", "")
    return out


def decode_entities(c: Column) -> Column:
    """Text with numeric entities and HTML's named ones as characters; unknown names stay as they are."""
    names = literal_map((name, chr(point)) for name, point in name2codepoint.items())

    def number(digits: Column, base: int) -> Column:
        point = F.conv(digits, base, 10).cast("long")
        known = (point > 0) & (point < 0x110000) & ~point.between(0xD800, 0xDFFF)
        return F.when(known, F.decode(F.unhex(F.lpad(F.hex(point), 8, "0")), "UTF-32"))

    def piece(p: Column) -> Column:
        name = F.regexp_extract(p, r"^(#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);", 1)
        char = F.when(name.rlike(r"^#\d"), number(F.substring(name, 2, 9), 10)).when(name.startswith("#"), number(F.substring(name, 3, 9), 16)).when(name != "", F.try_element_at(names, name))
        return let(name, lambda n: F.when(char.isNull(), F.concat(F.lit("&"), p)).otherwise(F.concat(char, F.substr(p, F.length(n) + 2))))

    parts = lambda a: F.array_join(F.transform(a, lambda p, i: F.when(i == 0, p).otherwise(piece(p))), "")
    return F.when(F.contains(c, F.lit("&")), let(F.split(c, "&"), parts)).otherwise(c)


def plain(html: Column) -> Column:
    """Text of markup: tags to blanks, entities decoded, blanks collapsed."""
    return strip(F.regexp_replace(decode_entities(F.regexp_replace(html, r"<[^>]*>", " ")), r"(?U)\s+", " "))


def first_group(text: Column, pattern: str, group: int = 0) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def find_title(raw: Column) -> Column:
    """The article's title, else a page title outside the head, else the first h1, by patterns, without a tree."""
    body = strip_non_content(raw)
    found = lambda b, tag: let(plain(F.regexp_extract(b, rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}\s*>", 1)), lambda x: F.when(x != "", x))
    return let(body, lambda b: F.coalesce(*[found(b, tag) for tag in ("article-title", "title", "h1")], F.lit("")))


def html_sections(blocks: Column) -> Column:
    """Sections of a page's blocks (kind, text): a heading opens one, the blocks after it fill it.

    Text before the first heading is a section without title and number 0;
    sections with neither title nor text are left out. Each section is a slice
    between two headings, so the work is linear in the page.
    """

    def cut(blocks: Column) -> Column:
        heads = F.filter(F.transform(blocks, lambda b, i: F.when(b["kind"] == "head", i)), lambda i: i.isNotNull())
        # -1 stands for what precedes the first heading.
        return let(F.concat(F.array(F.lit(-1)), heads), lambda at: F.transform(at, lambda i, k: section(blocks, i, k, F.coalesce(F.try_element_at(at, k + 2), F.size(blocks)))))

    def section(blocks: Column, i: Column, k: Column, end: Column) -> Column:
        title = F.when(i >= 0, F.try_element_at(blocks, i + 1)["text"]).otherwise("")
        said = F.transform(F.slice(blocks, i + 2, F.greatest(F.lit(0), end - i - 1)), lambda b: F.when(b["kind"] == "caption", F.concat(F.lit("[CAPTION] "), b["text"])).otherwise(b["text"]))
        return F.struct(title.alias("section_title"), F.array_join(said, "\n").alias("section_text"), F.concat(F.lit("body/sec["), k.cast("string"), F.lit("]")).alias("section_path"), F.lit(None).cast("int").alias("page"))

    return F.filter(let(blocks, cut), lambda s: (s["section_title"] != "") | (s["section_text"] != ""))


def full_text(sections: Column, *before: Column) -> Column:
    """What stands before, titles and texts, each on its own line."""
    parts = F.flatten(F.transform(sections, lambda s: F.array(s["section_title"], s["section_text"])))
    return F.array_join(F.filter(F.concat(F.array(*before) if before else F.array().cast("array<string>"), parts), lambda x: x != ""), "\n")


def paper_id_of(*columns: str) -> Column:
    """The first of the columns that is set."""
    return F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in columns], F.lit("")).alias("paper_id")


# -- page texts (PDF) --------------------------------------------------------


def is_heading(line: Column) -> Column:
    """Numbered or well-known headings, or a short line of capitals without digits."""
    s = strip(line)
    capitals = (F.upper(s) == s) & (F.lower(s) != s) & ~s.rlike(r"\d") & F.length(s).between(4, 59)
    return F.coalesce((s != "") & (F.length(s) <= 100) & (s.rlike(NUMBERED) | s.rlike(NAMED) | capitals), F.lit(False))


def page_lines(pages: DataFrame) -> DataFrame:
    """(path, page, pos, line) of pages(path, page, text)."""
    return pages.select("path", "page", F.posexplode(F.split(F.coalesce("text", F.lit("")), LINE_ENDS)).alias("pos", "line"))


def page_sections(pages: DataFrame, cut_tail: bool = True) -> DataFrame:
    """(path, ordinal, section_title, section_text, page): headings open sections.

    A running count of headings numbers the sections of a document, 0 being
    what precedes the first; page is that of the heading. Sections with neither
    title nor text are left out. With cut_tail everything from the first closing
    section (references, acknowledgements, funding, ...) on is dropped.
    """
    from pyspark.sql import Window as W

    order = W.partitionBy("path").orderBy("page", "pos")
    lines = page_lines(pages).withColumn("head", is_heading(F.col("line")))
    lines = lines.withColumn("ordinal", F.sum(F.col("head").cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0)))
    if cut_tail:
        end = F.min(F.when(F.col("head") & strip("line").rlike(CUT_FROM), F.col("ordinal"))).over(W.partitionBy("path"))
        lines = lines.withColumn("end", end).filter("end is null or ordinal < end")
    body = F.array_sort(F.collect_list(F.when(~F.col("head"), F.struct("page", "pos", "line"))))
    grouped = lines.groupBy("path", "ordinal").agg(
        F.coalesce(F.max(F.when(F.col("head"), strip("line"))), F.lit("")).alias("section_title"),
        F.coalesce(strip(F.array_join(F.transform(body, lambda s: s["line"]), "\n")), F.lit("")).alias("section_text"),
        F.min(F.when(F.col("head"), F.col("page"))).alias("page"),
    )
    return grouped.filter("section_title <> '' or section_text <> ''")


def parse_pages(pages: DataFrame) -> DataFrame:
    """Paper records of page texts (path, page, text), as PDF readers give them.

    The title is the first line with text of the first page, the abstract the
    first section named so. The full text is made of the sections that stay; a
    document without any has its raw text. Ids come from the raw text, the file
    name's stem if there are none.
    """
    numbered = F.array_sort(F.collect_list(F.struct("page", F.coalesce("text", F.lit("")).alias("text"))))
    raw = pages.groupBy("path").agg(numbered.alias("all"))
    whole = F.array_join(F.transform("all", lambda p: p["text"]), "\n")
    first = F.filter(F.split(F.col("all")[0]["text"], LINE_ENDS), lambda x: strip(x) != "")
    grab = lambda c, pattern, group=0: F.regexp_extract(c, pattern, group)
    raw = raw.select("path", whole.alias("raw"), F.coalesce(strip(F.try_element_at(first, F.lit(1))), F.lit("")).alias("title"))
    raw = raw.select("path", "raw", "title", grab(F.col("raw"), DOI).alias("paper_doi"), F.upper(grab(F.col("raw"), PMCID)).alias("pmcid"), grab(F.col("raw"), PMID, 1).alias("pmid"))
    section = F.struct("ordinal", "section_title", "section_text", F.concat(F.lit("body/sec["), F.col("ordinal").cast("string"), F.lit("]")).alias("section_path"), F.col("page").cast("int").alias("page"))
    listed = page_sections(pages).groupBy("path").agg(F.array_sort(F.collect_list(section)).alias("listed"))
    made = raw.join(listed, "path", "left").withColumn("sections", F.coalesce(F.transform("listed", lambda s: s.dropFields("ordinal")), F.array().cast(SECTIONS)))
    abstract = F.try_element_at(F.filter("sections", lambda s: F.startswith(F.lower(s["section_title"]), F.lit("abstract"))), F.lit(1))["section_text"]
    stem = F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1)
    text = F.when(F.size("sections") > 0, strip(full_text(F.col("sections")))).otherwise(F.col("raw"))
    made = made.withColumn("stem", stem)
    return made.select(paper_id_of("pmcid", "pmid", "paper_doi", "stem"), "paper_doi", "pmcid", "pmid", F.col("path").alias("source_path"), "title", F.coalesce(abstract, F.lit("")).alias("abstract"), text.alias("full_text"), "sections")


# -- markup ------------------------------------------------------------------

SECTIONS = "array<struct<section_title:string,section_text:string,section_path:string,page:int>>"
#: Elements of a section that are its text, and those whose captions are (fixed values).
SAID, CAPTIONED = ("p", "list", "disp-quote", "boxed-text", "statement"), ("fig", "table-wrap", "supplementary-material")
#: What the blocks of a page are, by element (fixed values).
BLOCKS = {**dict.fromkeys(("h1", "h2", "h3", "h4"), "head"), **dict.fromkeys(("p", "li", "blockquote"), "text"), "figcaption": "caption"}


def jats_sections(root: ET.Element) -> list[tuple[str, str, str]]:
    """(title, text, path) of an article's sections.

    Sections are walked depth first; contributor, ethics and funding sections
    and the reference list are left out; captions are marked.
    """
    sections: list[tuple[str, str, str]] = []

    def walk(node: ET.Element, base: str) -> None:
        for i, sec in enumerate(node.findall("sec"), start=1):
            title, here, own = words(sec.find("title")), f"{base}/sec[{i}]", []
            if re.search(SKIPPED, title):
                continue
            for child in sec:
                if child.tag in SAID:
                    own.append(words(child))
                elif child.tag in CAPTIONED and (caption := next(child.iter("caption"), None)) is not None:
                    own.append("[CAPTION] " + words(caption))
            text = "\n".join(filter(None, own))
            if title or text:
                sections.append((title, text, here))
            walk(sec, here)

    def notes(part: ET.Element, base: str) -> None:
        for i, note in enumerate(part.iter("notes"), start=1):
            title = next(note.iter("title"), None)
            if body := "\n".join(words(p) for p in note.iter("p")) or words(note):
                sections.append((words(title) if title is not None else (note.get("notes-type") or "").strip() or "Notes", body, f"{base}/notes[{i}]"))

    front, body, back = (next(root.iter(k), None) for k in ("front", "body", "back"))
    if front is not None:
        notes(front, "front")
    if body is not None:
        walk(body, "body")
        for node in body.iter():
            if node.tag in CAPTIONED and (text := words(next(node.iter("caption"), None))):
                sections.append((f"[{node.tag}]", text, node.tag))
    if back is not None:
        markup.without(back, frozenset(("ref-list",)))
        notes(back, "back")
        walk(back, "back")
        for i, fn in enumerate(back.iter("fn"), start=1):
            if text := words(fn):
                sections.append(("[footnote]", text, f"back/fn[{i}]"))
    return sections


def page_blocks(root: ET.Element) -> list[tuple[str, str]]:
    """(kind, text) of the headings, paragraphs, list items, quotes and captions of a page's main part, in order.

    A block inside a block comes after it, and its text is in both. A heading
    without text still ends the section before it.
    """
    main = next((n for k in ("main", "article", "body") if (n := next(root.iter(k), None)) is not None), root)
    made = ((BLOCKS[n.tag], words(n)) for n in main.iter() if n.tag in BLOCKS and n is not main)
    return [(kind, text) for kind, text in made if text or kind == "head"]


def document_parts(text: str) -> dict:
    """What a tree tells of a document: tagged ids, title, abstract, and its sections (JATS) or its blocks (any other)."""
    root = markup.without(markup.parsed(text), frozenset(DROPPED))
    ids = {n.get("pub-id-type"): words(n) for n in reversed(list(root.iter("article-id")))}
    first = lambda tag: next(root.iter(tag), None)
    title = next((n for k in ("article-title", "title", "h1") if (n := first(k)) is not None), None)
    abstract = first("abstract")
    if abstract is None:
        abstract = next((n for n in root.iter() if "abstract" in (n.get("class") or "").lower()), None)
    article = first("article")
    whole = article is not None and next(article.iter("body"), None) is not None
    sections = [dict(zip(("section_title", "section_text", "section_path"), s, strict=True)) for s in jats_sections(root)] if whole else None
    blocks = None if whole else [{"kind": k, "text": t} for k, t in page_blocks(root)]
    return {"doi": ids.get("doi"), "pmc": ids.get("pmcid") or ids.get("pmc"), "pm": ids.get("pmid"), "title": words(title), "abstract": words(abstract), "sections": sections, "blocks": blocks}


PARTS = f"doi string, pmc string, pm string, title string, abstract string, sections {SECTIONS}, blocks array<struct<kind:string,text:string>>"


def parse_documents(raw: DataFrame, content: str = "content", default_id: str = "paper_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """Papers of markup documents (content, paper_id, source_path), JATS or HTML, of any quality, with the columns to keep.

    An article with a body has JATS sections; any other document those of its
    headings and blocks. Well-formed XML is read as such; what isn't, as HTML
    if it has HTML's elements, else as XML as far as that goes. Ids are the
    tagged ones, then the first mention anywhere, markup included. A null
    document has empty fields and no section.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                made = pa.RecordBatch.from_pylist([document_parts(text) for text in part.column("content").to_pylist()], schema=arrow)
                yield pa.RecordBatch.from_arrays([*part.columns, *made.columns], [*part.schema.names, *arrow.names])

    reach_workers(raw.sparkSession)
    section = pa.struct([("section_title", pa.string()), ("section_text", pa.string()), ("section_path", pa.string()), ("page", pa.int32())])
    block = pa.struct([("kind", pa.string()), ("text", pa.string())])
    arrow = pa.schema([(n, pa.string()) for n in ("doi", "pmc", "pm", "title", "abstract")] + [("sections", pa.list_(section)), ("blocks", pa.list_(block))])
    c = F.coalesce(F.col(content), F.lit("")).alias("content")
    given = raw.select(F.col(default_id).alias("own_id"), "source_path", c, *keep)
    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in given.schema.fields)
    said = given.mapInArrow(run, kept + PARTS)
    present_ = lambda c: F.nullif(F.col(c), F.lit(""))
    pmc = F.when(F.upper("pmc").startswith("PMC"), F.col("pmc")).otherwise(F.concat(F.lit("PMC"), present_("pmc")))
    ids = said.select(
        "own_id", "source_path", "title", "abstract", F.coalesce(present_("doi"), first_group(F.col("content"), DOI), F.lit("")).alias("paper_doi"), F.coalesce(F.nullif(pmc, F.lit("")), F.upper(first_group(F.col("content"), PMCID)), F.lit("")).alias("pmcid"),
        F.coalesce(present_("pm"), first_group(F.col("content"), PMID, 1), F.lit("")).alias("pmid"), F.coalesce("sections", html_sections(F.col("blocks"))).alias("sections"), *keep,
    )
    return ids.select(paper_id_of("pmcid", "pmid", "paper_doi", "own_id"), "paper_doi", "pmcid", "pmid", "source_path", "title", "abstract", full_text(F.col("sections"), F.col("title"), F.col("abstract")).alias("full_text"), "sections", *keep)


def parse_files(files: DataFrame, read_pages: Callable[[bytes], list[str]] | None = None) -> DataFrame:
    """Papers of files (source_path, paper_id, bytes) by their suffix.

    HTML and XML go to parse_documents(); a PDF's pages come from read_pages, an
    injected reader (bytes to page texts), and a PDF it can't read has a record
    without text. Without a reader PDF files raise an error, as do files of any
    other kind: when the rows are read, not before.
    """
    known = F.regexp_extract(F.lower("source_path"), r"\.(html?|n?xml|pdf)$", 1)
    kind = F.when(known == "", F.raise_error(F.concat(F.lit("unsupported file type: "), F.col("source_path")))).otherwise(known)
    if read_pages is None:
        kind = F.when(kind == "pdf", F.raise_error(F.concat(F.lit("no reader of PDF pages given: "), F.col("source_path")))).otherwise(kind)
        return parse_documents(files.withColumn("kind", kind).filter("kind <> 'pdf'").select(decoded(F.col("bytes")).alias("content"), "paper_id", "source_path"))
    files = files.withColumn("kind", kind)
    papers = parse_documents(files.filter("kind <> 'pdf'").select(decoded(F.col("bytes")).alias("content"), "paper_id", "source_path"))
    return papers.unionByName(parse_pages(pdf_pages(files.filter("kind = 'pdf'"), read_pages)))


def decoded(data: Column) -> Column:
    """Bytes as text; those that are not UTF-8 are left out."""
    text = data.cast("string")
    return F.when(F.is_valid_utf8(text), text).otherwise(F.replace(F.make_valid_utf8(text), F.lit("\ufffd"), F.lit("")))


def pdf_pages(files: DataFrame, read_pages: Callable[[bytes], list[str]]) -> DataFrame:
    """(path, page, text) of PDF files (source_path, bytes) by an injected reader; an unreadable file is one empty page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data in zip(*[batch.column(c).to_pylist() for c in ("source_path", "bytes")], strict=True):
                try:
                    texts = list(read_pages(data)) or [""]
                except Exception:  # noqa: BLE001 - one broken file must not end the job
                    texts = [""]
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(texts)), pa.array(range(1, len(texts) + 1), pa.int32()), pa.array(texts, pa.string())], ["path", "page", "text"])

    reach_workers(files.sparkSession)
    return files.select("source_path", "bytes").mapInArrow(run, "path string, page int, text string")
