"""How a file's encoding is found: byte order mark, then what its head says, then what its content says, then the default.

The functions over bytes work inside Python steps; those over columns are the same rules as expressions.
"""

from __future__ import annotations

import codecs
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from glyphmill.model import ALIASES, Chunk, Filter

#: A file of so many bytes isn't looked into; the head is so many bytes.
VERY_LARGE, HEAD = 30 << 20, 1024
#: The longer marks first, as a mark of UTF-32 begins like one of UTF-16.
MARKS = ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\x00\x00\xfe\xff", "utf-32"), (b"\xff\xfe\x00\x00", "utf-32"), (b"\xfe\xff", "utf-16"), (b"\xff\xfe", "utf-16"))


def from_mark(raw: bytes) -> str | None:
    return next((name for mark, name in MARKS if raw.startswith(mark)), None)


def known(name: str | None) -> str | None:
    """The name if Python has such a codec for text."""
    if name is None or name == "":
        return name
    name = ALIASES.get(name.lower(), name)
    try:
        return name if codecs.lookup(name)._is_text_encoding else None
    except LookupError:
        return None


def marks_allowed(name: str) -> str:
    """The codec that takes a mark off, for encodings that may have one."""
    low = name.lower()
    if low.startswith("utf-8") or low == "utf8":
        return "utf-8-sig"
    return next((family for family in ("utf-16", "utf-32") if low.startswith(family)), name)


def detect(raw: bytes, step: Filter) -> str | None:
    """The encoding of a file for its first step; None if nothing tells it, "" for binary."""
    if len(raw) >= VERY_LARGE:
        return None
    if not raw:
        return "ascii"
    found = step.magic_encoding(raw)
    if found is None:
        found = from_mark(raw)
    if found is None:
        found = known(step.header_encoding(raw[:HEAD]))
        found = marks_allowed(found) if found else None
    if found is None:
        found = known(step.content_encoding(raw))
    return found


def read(raw: bytes, context: str, step: Filter) -> list[Chunk]:
    """The chunks of a file by its first step; if its bytes aren't in the encoding found, once more with the default one. An error makes one chunk that says so."""
    try:
        step.ready()
        encoding = detect(raw, step)
        if encoding is None:
            return step.read(raw, context, step.default_encoding)
        try:
            return step.read(raw, context, encoding)
        except UnicodeDecodeError:
            return step.read(raw, context, step.default_encoding)
    except Exception as e:
        return [Chunk("", context, "", "", f"{type(e).__name__}: {e}")]


XML_HEAD = re.compile(r"<\?xml\b[^>]*?\bencoding\s*=\s*([\"'])(?P<name>.*?)\1", re.I)


def xml_declaration(head: bytes) -> str | None:
    """The encoding that an XML declaration names, whichever the width of its characters; with none in UTF-16 or UTF-32, that."""
    start = "<?xml"
    for codec in ("ascii", "utf-32-be", "utf-32-le", "utf-16-be", "utf-16-le"):
        if head.startswith(start.encode(codec)):
            width = {"a": 1, "utf-3": 4}.get(codec[:5] if codec != "ascii" else "a", 2)
            m = XML_HEAD.match(head[: len(head) // width * width].decode(codec, "replace"))
            return m["name"] if m else (codec[:6] if codec != "ascii" else None)
    return None


META = re.compile(rb"<meta\b(?=[^>]*?\bcharset\s*=\s*[\"']?\s*([-\w.:]+))[^>]*>", re.I)


def html_meta(head: bytes) -> str | None:
    m = META.search(head)
    return m[1].decode("ascii", "replace") if m else xml_declaration(head)


COOKIE = re.compile(rb"coding[=:]\s*([\w.-]+)")


def source_cookie(head: bytes) -> str:
    """The encoding named in one of the first two lines of a Python source, else UTF-8."""
    for line in head.splitlines()[:2]:
        if m := COOKIE.search(line):
            return m[1].decode("ascii")
    return "utf-8"


# The same over columns.


def mark_column(raw: Column) -> Column:
    """Name of the encoding that a byte order mark tells, or null."""
    head, out = F.hex(F.substring(raw, 1, 4)), F.lit(None).cast("string")
    for mark, name in reversed(MARKS):
        out = F.when(head.startswith(mark.hex().upper()), F.lit(name)).otherwise(out)
    return out


def meta_charset_column(html: Column) -> Column:
    """The charset named in the first meta element that names one, in lower case; "" if there is none."""
    return F.lower(F.regexp_extract(F.substring(html, 1, HEAD), r"(?i)<meta\s[^>]*?charset\s*=\s*[\"']?\s*([-\w.:]+)", 1))


def newlines_column(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n?", "\n")
