"""Text and images of HTML pages."""

from __future__ import annotations

import re
from functools import reduce
from html.entities import html5
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import extract, once, squeeze

#: What is no content, and where content is looked for, in order (fixed values).
_DROPPED = {"script", "style", "nav", "header", "footer", "aside", "iframe", "form"}
_DROPPED_CLASSES = {"sidebar", "widget"}
_PLACES = ["article", ".post-content", ".entry-content", ".post-body", ".single-content", "main"]
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_LEAST = 200
#: An ampersand, and the reference that it begins if a semicolon ends one.
_AMPERSAND = re.compile(r"&(?:(#[0-9]+|#[xX][0-9a-fA-F]+|[a-zA-Z][a-zA-Z0-9]*);)?")
_ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&amp;": "&"}


def strip_html(html: Column) -> Column:
    """The text between tags, white space squeezed; of entities the common ones are decoded. Null is empty."""
    text = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?s)<(?:!--.*?-->|!?/?[A-Za-z][^>]*>)", "")
    decoded = lambda t: reduce(lambda t, e: F.replace(t, F.lit(e[0]), F.lit(e[1])), _ENTITIES.items(), t)
    return squeeze(once(text, lambda t: F.when(t.contains("&"), decoded(t)).otherwise(t)))


def first_image(html: Column) -> Column:
    """The source of the first image; null without one, or if that one has none."""
    values = (r'"([^"]*)"', r"'([^']*)'", r"([^\s\"'>]+)")
    return once(extract(html, r"(?is)<img\b([^>]*)>"), lambda attributes: F.coalesce(*[extract(attributes, rf"(?is)(?:^|[\s\"'])src\s*=\s*{v}") for v in values]))


class _Page(HTMLParser):
    """Text and first image of the body and of each place where content is looked for."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, bool, list]] = []
        self.found: dict[str, dict] = {}
        self.og = None

    def handle_starttag(self, tag, attrs):
        attributes = dict(reversed(attrs))
        classes = set((attributes.get("class") or "").split())
        gone = tag in _DROPPED or bool(classes & _DROPPED_CLASSES) or any(x[1] for x in self.stack)
        if tag == "meta" and attributes.get("property") == "og:image" and self.og is None:
            self.og = attributes.get("content")
        if tag == "img" and not gone:
            for part in self._open():
                part.setdefault("image", attributes.get("src"))
        if tag in _VOID:
            return
        begun = []
        if not gone:
            for place in ("body", *_PLACES):
                if place not in self.found and (place[1:] in classes if place[0] == "." else place == tag):
                    self.found[place] = {"text": []}
                    begun.append(self.found[place])
        self.stack.append((tag, gone, begun))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                del self.stack[i:]
                break

    def handle_data(self, data):
        if not any(x[1] for x in self.stack):
            for part in self._open():
                part["text"].append(data)

    def _open(self):
        return [part for _, _, begun in self.stack for part in begun]


def _closed(m: re.Match) -> str:
    """An ampersand that begins no whole reference, as one that is text; parsers would decode ``&amp`` and ``&copy=1``."""
    name = m[1]
    return m[0] if name and (name[0] == "#" or f"{name};" in html5) else f"&amp;{m[0][1:]}"


def _main(html: str | None, cap: int) -> tuple[str, str | None]:
    page = _Page()
    page.feed(_AMPERSAND.sub(_closed, html or ""))
    page.close()
    texts = {k: "".join(v["text"]) for k, v in page.found.items()}
    place = next((p for p in _PLACES if len(texts.get(p, "").strip()) > _LEAST), "body")
    image = page.found.get(place, {}).get("image")
    return " ".join(texts.get(place, "").split())[:cap], page.og if image is None else image


def main_content(html: Column, cap: int = 10_000) -> Column:
    """struct<text, thumbnail>: a page's main text, at most ``cap`` characters, and its first image or the one it names for sharing.

    As in ``strip_html``, only references that a semicolon ends are decoded.

    The one operation that needs a parser; it runs on whole Arrow batches.
    """

    @F.pandas_udf("text string, thumbnail string")
    def run(pages: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_main(p, cap) for p in pages], columns=["text", "thumbnail"])

    return run(html)
