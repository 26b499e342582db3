"""Markup of any quality as a tree: well-formed XML, HTML with implied ends, and broken documents.

A helper of the parsing tasks: one document in, one ElementTree out. What is
well-formed goes through the standard library's parser. Everything else is cut
into tags and texts by one pattern and put together with a stack of open
elements, so unknown entities, missing or crossed end tags and cut documents
lose nothing but themselves. Both are linear in the document.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from html import unescape

#: Start tags of HTML that end open elements: the tag, then what it ends (fixed values of the format).
_FONT = ("tt", "i", "b", "u", "s", "strike", "big", "small")
_HEADS = ("h1", "h2", "h3", "h4", "h5", "h6")
_BLOCKS = ("address", "blockquote", "center", "dir", "div", "dl", "fieldset", "form", "hr", "menu", "ol", "pre", "table", "ul")
ENDS = {
    "p": ("p", "head", "pre", *_HEADS, *_FONT),
    **{h: ("p", "head", *_HEADS) for h in _HEADS},
    **{b: ("p", "head") for b in _BLOCKS},
    "li": ("p", "li", "dl", "address", "pre", *_HEADS),
    "dt": ("p", "dt", "dd"),
    "dd": ("p", "dt", "dd"),
    "tr": ("p", "tr", "td", "th", "caption", "col", "colgroup"),
    "td": ("p", "td", "th", "span", "font", "a", "b", "i", "u"),
    "th": ("p", "td", "th", "span", "font", "a", "b", "i", "u"),
    "tbody": ("tr", "td", "th", "thead", "tbody", "tfoot", "caption", "col", "colgroup", "p"),
    "tfoot": ("tr", "td", "th", "thead", "tbody", "tfoot", "caption", "col", "colgroup", "p"),
    "thead": ("caption", "col", "colgroup"),
    "option": ("option",),
    "a": ("a", "head"),
    "body": ("head", "style", "script", "title"),
}
#: Elements of HTML without content, and those whose content is no markup (fixed values of the format).
EMPTY = frozenset("area base br col embed frame hr img input link meta param source track wbr".split())
RAW = ("script", "style")
#: End tags don't reach beyond an open element of a higher rank.
RANK = {"div": 150, "td": 160, "th": 160, "tr": 170, "thead": 180, "tbody": 180, "tfoot": 180, "table": 190, "head": 200, "body": 200, "html": 220}
#: Elements that belong to a head, wherever a page begins with them.
HEADED = frozenset(("title", "meta", "link", "base", "script", "style"))
MOST_OPEN = 256

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</([A-Za-z][^\s/><]*)[^>]*(?:>|\Z)|<([A-Za-z][^\s/><]*)((?:[^>"']|"[^"]*"|'[^']*')*)(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.S)
_DOCTYPE = re.compile(r"<!DOCTYPE[^>\[]*(\[[^\]]*\])?[^>]*>", re.I)


def local(name: str) -> str:
    return name.rsplit("}", 1)[-1].rsplit(":", 1)[-1]


def well_formed(text: str) -> ET.Element | None:
    """The tree of a well-formed XML document, else None; comments stay, since they part texts."""
    parser = ET.XMLParser(target=ET.TreeBuilder(insert_comments=True))
    try:
        parser.feed(_DOCTYPE.sub("", text, count=1).strip())
        root = parser.close()
    except (ET.ParseError, ValueError):
        return None
    for node in root.iter():
        if isinstance(node.tag, str):
            node.tag = local(node.tag)
    return root


def attributes(raw: str, lower: bool) -> dict[str, str]:
    return {(k.lower() if lower else local(k)): unescape(a or b or c) for k, a, b, c in _ATTRIBUTE.findall(raw)}


def recovered(text: str, html: bool) -> ET.Element:
    """The tree of a document that isn't well-formed, or of HTML, below one root named ''."""
    build, open_, at, raw = ET.TreeBuilder(), [], 0, None
    build.start("", {})

    def end() -> None:
        build.end(open_.pop())

    def begin(tag: str, given: dict[str, str]) -> None:
        build.start(tag, given)
        open_.append(tag)

    while at < len(text):
        if raw is not None:  # nothing but its own end tag ends it
            close = re.compile(rf"</{raw}\b[^>]*(?:>|\Z)", re.I).search(text, at)
            build.data(text[at : close.start() if close else len(text)])
            at, raw = (close.end() if close else len(text)), None
            end()
            continue
        m = _TOKEN.search(text, at)
        if before := text[at : m.start() if m else len(text)]:
            build.data(unescape(before))
        if not m:
            break
        at = m.end()
        data, closed, opened, given = m.groups()
        if opened:
            tag = opened.lower() if html else local(opened)
            if html:
                while open_ and open_[-1] in ENDS.get(tag, ()):
                    end()
                if tag in HEADED and not set(open_) - {"html"}:
                    begin("head", {})
            if len(open_) >= MOST_OPEN:
                continue
            begin(tag, attributes(given, html))
            if given.rstrip().endswith("/") and not html or html and tag in EMPTY:
                end()
            elif html and tag in RAW:
                raw = tag
        elif closed:
            tag = closed.lower() if html else local(closed)
            rank = RANK.get(tag, 100)
            for depth in range(len(open_) - 1, -1, -1):
                if open_[depth] == tag:
                    while len(open_) > depth:
                        end()
                    break
                if html and RANK.get(open_[depth], 100) > rank:
                    break
        else:
            build.data(data if data is not None else " ")  # a comment parts texts
    while open_:
        end()
    build.end("")
    return build.close()


def parsed(text: str) -> ET.Element:
    """The tree of any document: XML if it is well-formed, else HTML if it has that element, else XML as far as it goes."""
    looks_xml = text.lstrip()[:5] == "<?xml" or "<article" in text[:2000]
    root = well_formed(text) if looks_xml else None
    if root is None:
        root = recovered(text, not looks_xml or re.search(r"<(?:html|div|h[1-6])\b", text[:100_000], re.I) is not None)
    return root


def without(root: ET.Element, tags: frozenset[str]) -> ET.Element:
    """The tree without the elements of these names; what follows them stays."""
    todo = [root]
    while todo:
        node = todo.pop()
        if any(child.tag in tags for child in node):
            kept: list[ET.Element] = []
            for child in list(node):
                if child.tag in tags:
                    if child.tail and kept:
                        kept[-1].tail = (kept[-1].tail or "") + " " + child.tail
                    elif child.tail:
                        node.text = (node.text or "") + " " + child.tail
                else:
                    kept.append(child)
            node[:] = kept
        todo.extend(node)
    return root


def words(node: ET.Element | None) -> str:
    """The text of an element, its pieces parted by blanks."""
    return "" if node is None else re.sub(r"\s+", " ", " ".join(node.itertext())).strip()
