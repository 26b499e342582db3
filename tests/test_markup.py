"""Trees of any quality, the records made of them, and entities."""

import pytest
from pyspark.sql import functions as F

from citeloom.operators import markup, sections


def blocks(text):
    return sections.page_blocks(markup.without(markup.parsed(text), frozenset(sections.DROPPED)))


@pytest.mark.parametrize(
    ("page", "want"),
    [
        # Ends that HTML implies: a paragraph, a list item, a row, open fonts inside a paragraph.
        ("<body><p>one<p>two<div>three</div>", [("text", "one"), ("text", "two")]),
        ("<ul><li>a<li>b</ul><p>c", [("text", "a"), ("text", "b"), ("text", "c")]),
        ("<p><b>bold<br><p>next</p>", [("text", "bold"), ("text", "next")]),
        ("<h2>Head<p>text<h3>Other", [("head", "Head"), ("text", "text"), ("head", "Other")]),
        # A block in a block comes after it, with its text in both.
        ("<li>out <p>in</p> after</li>", [("text", "out in after"), ("text", "in")]),
        ("<blockquote><p>q</p></blockquote>", [("text", "q"), ("text", "q")]),
        ("<figure><img src=x><figcaption>cap <i>it</i></figcaption></figure>", [("caption", "cap it")]),
        # End tags without a start, crossed ones, cut ones; an end tag doesn't leave a division.
        ("<p>a</b></i> b</p></div><p>c</p", [("text", "a b"), ("text", "c")]),
        ("<div><p>in</div></p><p>out", [("text", "in"), ("text", "out")]),
        ("<p>cut <b", [("text", "cut")]),
        ("<p>a <!-- never closed <p>b", [("text", "a")]),
        ("<p>a<!-- x -->b</p>", [("text", "a b")]),
        # What holds no text to read is gone, what follows it stays.
        ("<p>a<script>if (1 < 2) '</p>'</script>b<style>p{}</style> c</p>", [("text", "a b c")]),
        ("<form><p>x</p></form><p>y</p><svg><p>z</p></svg> w", [("text", "y")]),
        ('<p class="a>b" title=\'c>d\'>text</p>', [("text", "text")]),
        # Entities, with and without their end.
        ("<p>1&ndash;2 &#8211; &#x2013; caf&eacute; &amp;lt; &copy 5 &unknown; &</p>", [("text", "1–2 – – café &lt; © 5 &unknown; &")]),
        ("<main><p>m</p></main><p>beside</p>", [("text", "m")]),
        ("", []),
        ("no markup at all", []),
    ],
)
def test_blocks(page, want):
    assert blocks(page) == want


def test_depth_and_length_are_bounded():
    import time

    deep = blocks("<blockquote>x" * 5000 + "end")
    assert len(deep) == markup.MOST_OPEN - 1 or len(deep) == markup.MOST_OPEN
    began = time.time()
    assert len(blocks("<p>a" * 200_000)) == 200_000
    blocks("<a '" * 100_000)
    blocks("<!--" * 100_000)
    blocks("<" * 300_000)
    assert time.time() - began < 30


XHTML = '<?xml version="1.0" encoding="utf-8"?><!DOCTYPE html><html xmlns="http://www.w3.org/1999/xhtml"><head><title>head title</title></head><body><h1>Page &amp; title</h1><p>One<br/>two</p></body></html>'
ARTICLE = "<!DOCTYPE html><html><head><meta charset=utf-8><title>t</title></head><body><nav><p>menu</p></nav><article><h1>T&eacute;</h1><p>P1<p>P2 PMID: 1234567</article></body></html>"
JATS = '<article><front><article-meta><article-id pub-id-type="pmcid">99</article-id><article-id pub-id-type="doi">10.1/x</article-id><title-group><article-title>A&nbsp;T</article-title></title-group><abstract><p>Abs</p></abstract></article-meta></front><body><sec><title>Results</title><p>R &ndash; <italic>x</italic></p><sec><title>Inner</title><p>I</p></sec></sec></body><back><ref-list><ref><p>a reference</p></ref></ref-list><fn><p>foot</p></fn></back></article>'


def test_documents(spark):
    cut = JATS[: JATS.index("</sec></sec>")]
    crossed = JATS.replace("<p>I</p>", "<p><b>I</p></b>")
    rows = [(XHTML, "x"), (ARTICLE, "a"), (JATS, "j"), (cut, "cut"), (crossed, "crossed"), (JATS.replace("&nbsp;", " ").replace("&ndash;", "–"), "strict"), (None, "none"), ("", "empty"), ("<p>only", "p"), ("\ud800".encode("utf-8", "ignore").decode() + "<h1>\x00</h1>", "odd")]
    raw = spark.createDataFrame([(c, i, f"{i}.html") for c, i in rows], "content string, paper_id string, source_path string")
    got = {r.source_path[:-5]: r for r in sections.parse_documents(raw.repartition(3)).collect()}
    said = lambda i: [(s.section_title, s.section_text) for s in got[i].sections]
    assert got["x"].title == "Page & title" and said("x") == [("Page & title", "One two")] and got["x"].paper_id == "x"
    assert got["a"].title == "Té" and said("a") == [("Té", "P1\nP2 PMID: 1234567")] and got["a"].pmid == "1234567"
    whole = [("Results", "R – x"), ("Inner", "I"), ("[footnote]", "foot")]
    for i in ("j", "crossed", "strict"):
        assert said(i) == whole and (got[i].title, got[i].abstract, got[i].paper_id, got[i].paper_doi) == ("A T", "Abs", "PMC99", "10.1/x")
        assert "a reference" not in got[i].full_text
    assert said("cut") == whole[:2] and got["cut"].title == "A T"
    assert [s.section_path for s in got["j"].sections] == ["body/sec[1]", "body/sec[1]/sec[1]", "back/fn[1]"]
    assert said("none") == said("empty") == [] and got["none"].full_text == "" and said("p") == [("", "only")]
    assert sections.parse_documents(raw.limit(0)).count() == 0


def test_entities_of_columns(spark):
    texts = ["a &ndash; b", "&#8211;&#x2013;", "caf&eacute;", "&amp;lt;", "&bogus; & &;", "&#0; &#xD800; &#99999999;", "none", "", None, "&#128512;"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", sections.decode_entities(F.col("t")).alias("t")).collect()
    assert [r.t for r in sorted(rows)] == ["a – b", "––", "café", "&lt;", "&bogus; & &;", "&#0; &#xD800; &#99999999;", "none", "", None, "😀"]
