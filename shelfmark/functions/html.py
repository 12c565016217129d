"""Reading the tags of HTML in one pass, in Arrow batches.

Every character is looked at a bounded number of times, whatever a page holds. Where pages are broken: a quote opens a
value only behind ``=``, and one that is never closed is a plain character; a tag that never ends ends the page; a comment
that never ends is text; what stands in script and style is no tag; an end tag closes all that was opened within its
element, and is ignored if there is none; an element that isn't closed ends with the one around it. Null stays null.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from shelfmark.sources.shared import light_batches

# Fixed values of HTML.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style"}
#: Elements that are removed with all they hold.
DROPPED = {"script", "style", "nav", "footer", "header", "iframe", "noscript"}
#: What elements() gives, by kind of tag.
WANTED = {"a": ("href", "rel", "class", "aria-current"), "link": ("href", "rel"), "meta": ("property", "name", "content"), "script": ("type",)}
FIELDS = ("href", "rel", "class", "current", "property", "name", "content")

_NAME = re.compile(r"(/?)([A-Za-z][^\s/>]*)")
_OPENS = re.compile(r"=\s*([\"'])")
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]+)))?""")
_RAW_END = {name: re.compile(f"(?i)</{name}(?=[\\s/>])") for name in RAW}


class Tag(NamedTuple):
    name: str
    closing: bool
    start: int
    end: int
    #: Where the attributes begin; they end before ``end``.
    inner: int


def tags(html: str) -> Iterator[Tag]:
    """The tags of a page in order."""
    at, find, lost = 0, html.find, set()

    def end_of(pos: int) -> int:
        close = find(">", pos)
        while close >= 0:
            opens = _OPENS.search(html, pos, close)
            if not opens:
                return close + 1
            pos = opens.end()
            shut = -1 if opens[1] in lost else find(opens[1], pos)
            if shut < 0:
                lost.add(opens[1])
            else:
                pos = shut + 1
            if close < pos:
                close = find(">", pos)
        return -1

    while (at := find("<", at)) >= 0:
        if html.startswith("<!--", at) and "-->" not in lost:
            shut = find("-->", at + 4)
            if shut < 0:
                lost.add("-->")
            else:
                at = shut + 3
                continue
        named = _NAME.match(html, at + 1)
        if not named:
            at += 1
            continue
        end = end_of(named.end())
        if end < 0:
            return
        tag = Tag(named[2].lower(), bool(named[1]), at, end, named.end())
        yield tag
        at = end
        if tag.name in RAW and not tag.closing:
            shut = _RAW_END[tag.name].search(html, at)
            at = shut.start() if shut else len(html)


def attributes(html: str, tag: Tag) -> Iterator[re.Match]:
    return _ATTRIBUTE.finditer(html, tag.inner, tag.end - 1)


def value_of(found: re.Match) -> str:
    return next((v for v in found.groups()[1:] if v is not None), "")


def page_elements(html: str) -> list[dict]:
    """Links, meta tags and JSON-LD scripts of a page, with their text."""
    found, link, texts, text_from = [], None, [], 0

    def close_link() -> None:
        if link is not None:
            link["text"] = re.sub(r"\s+", " ", " ".join(texts)).strip()

    for tag in tags(html):
        if link is not None:
            texts.append(html[text_from : tag.start])
            text_from = tag.end
        if tag.name == "a":
            close_link()
            link, texts, text_from = None, [], tag.end
        if tag.closing or tag.name not in WANTED:
            continue
        own: dict = {"tag": tag.name}
        for match in attributes(html, tag):
            name = match[1].lower()
            if name in WANTED[tag.name] and (key := "current" if name == "aria-current" else name) not in own:
                own[key] = value_of(match)
        if tag.name == "script":
            if own.pop("type", "").strip().lower() != "application/ld+json":
                continue
            shut = _RAW_END["script"].search(html, tag.end)
            own["text"] = html[tag.end : shut.start() if shut else len(html)]
        elif tag.name == "a":
            link = own
        found.append(own)
    if link is not None:
        texts.append(html[text_from:])
        close_link()
    return found


def without_comments(html: str) -> str:
    kept, at = [], 0
    while (start := html.find("<!--", at)) >= 0 and (end := html.find("-->", start + 4)) >= 0:
        kept.append(html[at:start])
        at = end + 3
    return "".join([*kept, html[at:]])


def cleaned_page(html: str) -> str:
    """A page without comments, DROPPED elements, and style and event attributes."""
    html = without_comments(html)
    kept, at, stack, open_, dropped = [], 0, [], {}, None
    for tag in tags(html):
        if tag.closing:
            if not open_.get(tag.name):
                continue
            while True:
                name = stack.pop()
                open_[name] -= 1
                if dropped is not None and len(stack) == dropped:
                    # Its own end tag goes with it, that of an element around it stays.
                    dropped, at = None, tag.end if name == tag.name else tag.start
                if name == tag.name:
                    break
            continue
        if dropped is None and tag.name in DROPPED:
            kept.append(html[at : tag.start])
            dropped = len(stack)
        elif dropped is None:
            for match in attributes(html, tag):
                name = match[1].lower()
                if name == "style" or name.startswith("on"):
                    start = match.start() - html[match.start() - 1].isspace()
                    kept.append(html[at:start])
                    at = match.end()
        if tag.name not in VOID:
            stack.append(tag.name)
            open_[tag.name] = open_.get(tag.name, 0) + 1
    return "".join(kept) if dropped is not None else "".join([*kept, html[at:]])


#: Characters of pages whose results are packed at a time.
PACKED = 1 << 20


def _results(pages: pa.Array, each: Callable, kind: pa.DataType) -> pa.Array:
    """What ``each`` gives of each page. A page at a time is read as Python text, and results are packed by a few pages."""
    packed, held, size = [], [], 0
    for page in pages:
        text = page.as_py()
        held.append(None if text is None else each(text))
        size += len(text or "")
        if size >= PACKED:
            packed.append(pa.array(held, kind))
            held, size = [], 0
    return pa.concat_arrays([*packed, pa.array(held, kind)])


def _by_page(each: Callable, kind: str) -> Callable[[Column], Column]:
    def run(pages):
        element = pa.struct([(name, pa.string()) for name in ("tag", *FIELDS, "text")])
        return _results(pages, each, pa.string() if kind == "string" else pa.list_(element))

    run.__annotations__ = {"pages": pa.Array, "return": pa.Array}

    def column(html: Column) -> Column:
        # A row may be a page of megabytes, so batches are held by bytes and not by rows alone.
        light_batches(SparkSession.active())
        return F.arrow_udf(run, kind)(html)

    return column


#: array<struct> of a page's links, meta tags and JSON-LD scripts: tag, FIELDS, text.
elements = _by_page(page_elements, "array<struct<" + ",".join(f"`{name}`:string" for name in ("tag", *FIELDS, "text")) + ">>")
#: A page as cleaned_page has it.
cleaned = _by_page(cleaned_page, "string")


def of_kind(found: Column, tag: str) -> Column:
    return F.filter(found, lambda e: e["tag"] == tag)
