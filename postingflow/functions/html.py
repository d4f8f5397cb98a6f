"""Reading HTML on the executors, column by column over Arrow batches.

HTML needs a real tokenizer, which Spark lacks: these Arrow functions are the only Python
that runs in tasks. Only the HTML column travels to Python.
"""

from __future__ import annotations

import sys
from collections import Counter
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

# Tasks get this module's code with the function: executors need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Elements without content, and elements whose text is not visible.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
HIDDEN = frozenset(("script", "style", "template", "rt", "rp"))
LINK_TYPE = "array<struct<text:string,href:string,attrs:map<string,string>>>"
LINK_ARROW = pa.list_(pa.struct([("text", pa.string()), ("href", pa.string()), ("attrs", pa.map_(pa.string(), pa.string()))]))
LINK_PAGES = 64  # read at once


def parse_selector(selector: str) -> list[tuple[str, frozenset]]:
    """``div.a.b h2 a.c`` as [(tag, classes), ...], outermost first."""
    steps = []
    for step in selector.split():
        tag, *classes = step.split(".")
        steps.append((tag, frozenset(classes)))
    return steps


class _Element:
    __slots__ = ("tag", "attrs", "classes", "start", "slot", "blocks", "outer")

    def __init__(self, tag, attrs, start):
        self.tag, self.attrs, self.start = tag, attrs, start
        self.classes = frozenset((attrs.get("class") or "").split())
        self.slot = None
        self.blocks = None
        self.outer = (0, 0)

    def matches(self, step) -> bool:
        return (not step[0] or self.tag == step[0]) and step[1] <= self.classes


class Page(HTMLParser):
    """Visible text of a page and the elements a selector picks, in document order.

    Pages may never close their tags, so nothing looks through the open elements: open tags
    are counted, and an element carries how many leading steps of a selector the elements
    around it fulfil.
    """

    def __init__(self, selector: str | None = None, block: str | None = None):
        super().__init__(convert_charrefs=True)
        self.selectors = tuple(parse_selector(s) if s else None for s in (selector, block))
        self.parts: list[str] = []
        self.open: list[_Element] = []
        self.counts: Counter = Counter()
        self.hidden = 0
        self.open_blocks: list[dict] = []
        self.picked: list[dict] = []
        self.found_blocks: list[dict] = []

    def _selected(self, element: _Element, which: int) -> bool:
        steps = self.selectors[which]
        around = self.open[-1].outer[which] if self.open else 0
        return bool(steps) and around == len(steps) - 1 and element.matches(steps[-1])

    def _push(self, element: _Element):
        around = self.open[-1].outer if self.open else (0, 0)
        element.outer = tuple(
            n + 1 if steps and n < len(steps) - 1 and element.matches(steps[n]) else n
            for n, steps in zip(around, self.selectors, strict=True)
        )
        self.open.append(element)
        self.counts[element.tag] += 1
        self.hidden += element.tag in HIDDEN
        if element.blocks is not None:
            self.open_blocks.append(element.blocks)

    def _pop(self) -> _Element:
        element = self.open.pop()
        self.counts[element.tag] -= 1
        self.hidden -= element.tag in HIDDEN
        if element.slot is not None:
            element.slot["text"] = "".join(self.parts[element.start:])
        if element.blocks is not None:
            self.open_blocks.pop()
            element.blocks["text"] = "".join(self.parts[element.start:])
        return element

    def handle_starttag(self, tag, attrs):
        element = _Element(tag, dict(attrs), len(self.parts))
        if self._selected(element, 0):
            element.slot = {"attrs": {k: v or "" for k, v in attrs}, "text": ""}
            self.picked.append(element.slot)
        if self.selectors[1]:
            self._note_block(element)
        if tag not in VOID:
            self._push(element)

    def _note_block(self, element: _Element):
        if element.tag == "ul" and self.open_blocks:
            slot = {"attrs": {}, "text": ""}
            for found in self.open_blocks:
                found["has_list"] = True
                if not element.attrs:
                    found["lists"].append(slot)
            element.slot = slot
        if self._selected(element, 1):
            element.blocks = {"has_list": False, "lists": [], "text": ""}
            self.found_blocks.append(element.blocks)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self._pop()

    def handle_endtag(self, tag):
        if not self.counts[tag]:
            return
        while self._pop().tag != tag:
            pass

    def handle_data(self, data):
        if not self.hidden:
            self.parts.append(data)

    def read(self, html: str) -> "Page":
        self.feed(html)
        self.close()
        while self.open:
            self._pop()
        return self


def visible_text(html: str | None) -> str | None:
    return None if html is None else "".join(Page().read(html).parts)


def selected_elements(html: str | None, selector: str) -> list[dict]:
    if html is None:
        return []
    return [
        {"text": p["text"], "href": p["attrs"].get("href"), "attrs": p["attrs"]}
        for p in Page(selector).read(html).picked
    ]


def list_sections(html: str | None, block: str) -> dict | None:
    """Texts of the attribute-free lists of the first block that has a list, else of the
    last block; None without any block."""
    if html is None:
        return None
    blocks = Page(block=block).read(html).found_blocks
    if not blocks:
        return None
    chosen = next((b for b in blocks if b["has_list"]), blocks[-1])
    return {"sections": [s["text"] for s in chosen["lists"]], "text": chosen["text"]}


def html_to_text(html: Column) -> Column:
    """Text of an HTML fragment without scripts, styles and comments."""

    @F.pandas_udf("string")
    def read(pages: pd.Series) -> pd.Series:
        return pages.map(visible_text)

    return read(html)


def page_links(html: Column, selector: str = "a") -> Column:
    """Elements matching a ``tag.class`` descendant selector: text, href and attributes."""

    @F.arrow_udf(LINK_TYPE)
    def read(pages: pa.Array) -> pa.Array:
        # Elements become Arrow rows by few pages: as Python objects they take far more memory.
        parts = [pages.slice(i, LINK_PAGES) for i in range(0, len(pages), LINK_PAGES)]
        found = [pa.array([selected_elements(p, selector) for p in part.to_pylist()], LINK_ARROW) for part in parts]
        return pa.concat_arrays(found) if found else pa.array([], LINK_ARROW)

    return read(html)


def page_sections(html: Column, block: str) -> Column:
    """``struct<sections, text>`` of a posting page, NULL without a content block."""

    @F.pandas_udf("struct<found:boolean,sections:array<string>,text:string>")
    def read(pages: pd.Series) -> pd.DataFrame:
        rows = [list_sections(page, block) for page in pages]
        return pd.DataFrame(
            {
                "found": [r is not None for r in rows],
                "sections": [r["sections"] if r else None for r in rows],
                "text": [r["text"] if r else None for r in rows],
            }
        )

    return read(html)


def is_full_page(links: Column, sizes) -> Column:
    """Whether a listing page is full, so that another page follows."""
    return F.size(links).isin(*sizes)
