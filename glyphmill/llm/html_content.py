"""Content of web pages by the ratios of their tag paths.

The path of a text node is the tags from the root down to it. For each path the text's length and its punctuation, each per
node, are aggregated; both are smoothed along the page and fused to the root of length times (1 + punctuation), so that a long text without
any mark still counts; the paths above a share of the paths' mean are content.
"""

from __future__ import annotations

import html
import re
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.llm.session import table

MARKUP = re.compile(r"<!--|<[!?]|<(/?)([a-zA-Z][^\s/>]*)")
QUOTE = re.compile(r"[>\"']")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title svg head".split())
#: Of these, unclosed ones hold the rest of the page; other unclosed ones are elements like others.
TEXT = frozenset("script style textarea title".split())
#: These end an open paragraph; those of ONCE end an open one of their own kind.
BLOCK = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
ONCE = {"li": ("ul", "ol"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
MARK = re.compile(r"[.,;:!?…。、，；：！？]")


class Scanner:
    """Where markup ends. Every place of the page is looked at a bounded number of times: what isn't found once isn't looked for again."""

    def __init__(self, page: str) -> None:
        self.page, self.absent, self.quoted = page, set(), True

    def find(self, what: str, at: int) -> int:
        if what in self.absent:
            return -1
        i = self.page.find(what, at)
        if i < 0:
            self.absent.add(what)
        return i

    def tag(self, at: int) -> int:
        """The ">" that ends the tag whose attributes begin here, -1 if none does. A quote that is never closed is a character like others; once no tag ends outside quotes, quotes don't count."""
        i = at
        while self.quoted:
            m = QUOTE.search(self.page, i)
            if not m:
                self.quoted = False
            elif m[0] == ">":
                return m.start()
            else:
                end = self.find(m[0], m.end())
                i = m.end() if end < 0 else end + 1
        return self.find(">", at)

    def closing(self, name: str, at: int) -> int:
        """After the closing tag of a raw element, -1 if it has none."""
        if name in self.absent:
            return -1
        m = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(self.page, at)
        if not m:
            self.absent.add(name)
            return -1
        return m.end()


class Stack:
    """The open elements; each knows the number of its path, and each name the places where it is open."""

    def __init__(self) -> None:
        self.names: list[str] = []
        self.path: list[int] = [0]
        self.places: dict[str, list[int]] = {}
        self.numbers: dict[tuple[int, str], int] = {}

    def push(self, name: str) -> None:
        self.places.setdefault(name, []).append(len(self.names))
        self.names.append(name)
        self.path.append(self.numbers.setdefault((self.path[-1], name), len(self.numbers) + 1))

    def last(self, name: str) -> int:
        own = self.places.get(name)
        return own[-1] if own else -1

    def cut(self, at: int) -> None:
        while len(self.names) > at:
            self.places[self.names.pop()].pop()
            self.path.pop()


def text_nodes(page: str) -> list[tuple[int, str]]:
    """(number of the path, text) of each text node that shows something, in the order of the page."""
    nodes: list[tuple[int, str]] = []
    stack, scan = Stack(), Scanner(page)
    at = begin = 0  # text begins

    def text(upto: int) -> None:
        shown = " ".join(html.unescape(page[begin:upto]).split())
        if shown:
            nodes.append((stack.path[-1], shown))

    while m := MARKUP.search(page, at):
        name = m[2]
        if name is None:
            end = scan.find("-->", m.end()) if m[0] == "<!--" else scan.find(">", m.end())
            text(m.start())
            at = begin = len(page) if end < 0 else end + (3 if m[0] == "<!--" else 1)
            continue
        end = scan.tag(m.end())
        if end < 0:  # no tag ends from here on
            break
        text(m.start())
        name, attributes = name.lower(), page[m.end() : end]
        at = begin = end + 1
        if m[1]:
            if (i := stack.last(name)) >= 0:
                stack.cut(i)
            continue
        if name in RAW:
            end = scan.closing(name, at)
            if end >= 0:
                at = begin = end
                continue
            if name in TEXT:  # what it holds is no markup, to the end
                begin = len(page)
                break
        if name in BLOCK and (i := stack.last("p")) >= 0:
            stack.cut(i)
        if name in ONCE and (i := stack.last(name)) >= 0 and all(stack.last(x) < i for x in ONCE[name]):
            stack.cut(i)
        if name not in VOID and not attributes.rstrip().endswith("/"):
            stack.push(name)
    text(len(page))
    return nodes


def content(page: str | None, width: int = 2, factor: float = 0.75) -> tuple[str | None, int, int]:
    """Text of the content nodes (a line for each run of one block), number of paths, number of content paths. Null gives null; a page without text gives ""."""
    if page is None:
        return None, 0, 0
    nodes = text_nodes(page)
    if not nodes:
        return "", 0, 0
    paths = list(dict.fromkeys(p for p, _ in nodes))
    number = {p: i for i, p in enumerate(paths)}
    of = np.array([number[p] for p, _ in nodes])
    count = np.bincount(of)
    smoothed = []
    for values in ([len(t) for _, t in nodes], [len(MARK.findall(t)) for _, t in nodes]):
        ratio = (np.bincount(of, np.array(values, float)) / count)[of]
        kernel = np.exp(-(np.arange(-width, width + 1) ** 2) / 2.0)
        smooth = np.convolve(np.pad(ratio, width, "edge"), kernel / kernel.sum(), "valid")
        smoothed.append(np.sqrt(ratio * smooth))
    length, marks = smoothed
    by_path = np.bincount(of, np.sqrt(length * (1 + marks))) / count
    kept = by_path >= min(factor * by_path.mean(), by_path.max())
    lines = [" ".join(t for _, t in run) for _, run in groupby((n for n in nodes if kept[number[n[0]]]), key=lambda n: n[0])]
    return "\n".join(lines), len(paths), int(kept.sum())


def html_content(pages: DataFrame, width: int = 2, factor: float = 0.75, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """page_id, text, n_paths and n_content_paths: one row for each row.

    A null page has null text, an empty one empty text; if all paths are alike (a tie) all are content; a very long page, also of tags that never end or are never closed, takes time in proportion to its length.
    Repeated rows repeat; other columns are left out; an empty table gives none."""

    @F.arrow_udf("struct<text:string,n_paths:int,n_content_paths:int>")
    def apply(column: pa.Array) -> pa.Array:
        text, n, kept = [], [], []
        for x in column:
            a, b, c = content(x.as_py(), width, factor)
            text.append(a), n.append(b), kept.append(c)
        return pa.StructArray.from_arrays([pa.array(text, pa.string()), pa.array(n, pa.int32()), pa.array(kept, pa.int32())], ["text", "n_paths", "n_content_paths"])

    return pages.select(F.col(id_col).alias("page_id"), apply(F.col(html_col).cast("string")).alias("r")).select("page_id", "r.*")


def op8_html_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_content(table(spark, sf_dir, "pages"))
