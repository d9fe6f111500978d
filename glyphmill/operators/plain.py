"""Filters over plain text: as it is, without addresses, without or only within delimiters; and the choice by category."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from glyphmill.functions.encodings import newlines_column
from glyphmill.functions.globs import Matcher
from glyphmill.model import ALLOW, HALT, SKIP, Chunk, Filter, FlowControl, encoding_name, newlines, normal_form

#: Spaces for a Unicode-aware trim, as Python knows them.
BLANK = r"(?U)^[\s\x1c-\x1f]*\z"


class TextFilter(Filter):
    """Text as it is; on request in a Unicode normal form, and as another encoding would hold it."""

    universal_newlines = False
    FORMS = ("", "nfc", "nfd", "nfkc", "nfkd")
    ERRORS = ("strict", "ignore", "replace", "backslashreplace")

    def default_config(self) -> dict:
        return {"normalize": "", "convert_encoding": "", "errors": "strict"}

    def validated(self, key, value):
        value = super().validated(key, value)
        if key == "normalize" and value.lower() not in self.FORMS or key == "errors" and value.lower() not in self.ERRORS:
            raise ValueError(f"{key} can't be {value!r}")
        if key == "convert_encoding" and value:
            encoding_name(value)
        return value

    def categories(self) -> tuple[str, ...]:
        return ("text",)

    def column(self, text: Column) -> Column | None:
        return None if self.config["normalize"] or self.config["convert_encoding"] else text

    def process(self, chunk: Chunk) -> list[Chunk]:
        c = self.config
        text, encoding = chunk.text, chunk.encoding
        if c["normalize"]:
            text = normal_form(text, c["normalize"].upper())
        if c["convert_encoding"]:
            encoding = encoding_name(c["convert_encoding"])
            text = text.encode(encoding, c["errors"].lower()).decode(encoding)
        return [Chunk(text, chunk.context, encoding, "text")]


#: Mail addresses and links, in the syntax that Java's and Python's expressions share; Unicode's word characters in both.
MAIL = r"(?i)(?<![\d_a-z@+/-])[\d_a-z+-]+(?:\.[\d_a-z+-]+)*@(?:[\d_a-z-]+\.)+[\d_a-z-]*[a-z]\b(?![@-])"
_HOST = r"[^\W_][\w-]*(?:\.[\w.-]+)+"
LINK = rf"(?i)(?:\b|(?<=_))(?:(?:https?|ftps?)://(?:{_HOST}|localhost)|www\.{_HOST})[\w#$%&'()+,./:;=?@\[\]{{|}}~!\"-]*(?:[^\W_]|[#$+/=@-])"


class UrlFilter(Filter):
    def default_config(self) -> dict:
        return {"urls": True, "emails": True}

    def categories(self) -> tuple[str, ...]:
        return ("url-free",)

    def column_category(self) -> str:
        return "url-free"

    def column(self, text: Column) -> Column:
        for on, pattern in (("urls", LINK), ("emails", MAIL)):
            if self.config[on]:
                text = F.regexp_replace(text, "(?U)" + pattern, "")
        return text

    def setup(self) -> None:
        self.patterns = [re.compile(p) for on, p in (("urls", LINK), ("emails", MAIL)) if self.config[on]]

    def process(self, chunk: Chunk) -> list[Chunk]:
        self.ready()
        text = chunk.text
        for p in self.patterns:
            text = p.sub("", text)
        return [Chunk(text, chunk.context, chunk.encoding, "url-free")]


class ContextFilter(Filter):
    """Text within delimiters (or, with context_visible_first, outside of them); escapes are passed over."""

    def default_config(self) -> dict:
        return {"delimiters": [], "normalize_line_endings": True, "context_visible_first": False, "escapes": ""}

    def validated(self, key, value):
        value = super().validated(key, value)
        if key == "delimiters":
            for d in value:
                if not isinstance(d, dict) or set(d) - {"open", "close", "content"} or not all(isinstance(x, str) for x in d.values()):
                    raise ValueError("a delimiter has open, close and content, all of them strings")
                if not d.get("open"):
                    raise ValueError("a delimiter needs open")
                if re.compile(self.pattern(d)).match(""):
                    raise ValueError(f"the delimiter {d['open']!r} would match nothing, for ever")
        if key == "escapes" and value and re.compile(value).match(""):
            raise ValueError("escapes would match nothing, for ever")
        return value

    @staticmethod
    def pattern(d: dict, group: str = "(?P<_content_>", names: str = "") -> str:
        end = d.get("close") or ""
        tail = rf"(?:{end}|\Z)" if end else r"\Z"
        return f"(?s:{d['open']}{group}{d.get('content', '.*?')}){tail})"

    def categories(self) -> tuple[str, ...]:
        return ("context",)

    def column_category(self) -> str:
        return "context"

    def setup(self) -> None:
        self.escape = re.compile(self.config["escapes"], re.M) if self.config["escapes"] else None
        self.marks = [re.compile(self.pattern(d), re.M) for d in self.config["delimiters"]]

    def pieces(self, text: str) -> list[str]:
        outside = self.config["context_visible_first"]
        out: list[str] = []
        at = last = 0
        patterns = [*([self.escape] if self.escape else []), *self.marks]
        ahead = [p.search(text) for p in patterns]  # the next match of each
        while True:
            for k, m in enumerate(ahead):
                if m and m.start() < at:
                    ahead[k] = patterns[k].search(text, at)
            m = min((m for m in ahead if m), key=lambda m: m.start(), default=None)  # of equal places the first pattern's
            if m is None or m.start() >= len(text):
                break
            if m.re is not self.escape:
                out.append(text[last : m.start()] if outside else m["_content_"])
                last = m.end()
            at = max(m.end(), m.start() + 1)
        if outside and last < len(text):
            out.append(text[last:])
        return out

    def column(self, text: Column) -> Column | None:
        """Visible-first as one replacement: a hidden span becomes a pair of marks, an escape stays between such; the pairs then become a space and other marks go."""
        c = self.config
        java = [java_pattern(self.pattern(d, "(?:"), k) for k, d in enumerate(c["delimiters"])]
        escape = java_pattern(c["escapes"], 99) if c["escapes"] else "(?!)"
        if not c["context_visible_first"] or any(p is None for p in (*java, escape)) or not java:
            return None
        if c["normalize_line_endings"]:
            text = newlines_column(text)
        marked = F.regexp_replace(text, f"(?dm)({escape})|" + "|".join(f"(?:{p})" for p in java), "\ue001$1\ue000")
        ended = F.regexp_replace(marked, "\ue001\ue000\\z", "")  # nothing is visible after it
        return F.translate(F.regexp_replace(ended, "\ue001\ue000", " "), "\ue001\ue000", "")

    def process(self, chunk: Chunk) -> list[Chunk]:
        self.ready()
        text = newlines(chunk.text) if self.config["normalize_line_endings"] else chunk.text
        return [Chunk(" ".join(self.pieces(text)), chunk.context, chunk.encoding, "context")]


def java_pattern(pattern: str, number: int) -> str | None:
    """The same expression for Java, with the names of its groups made unique; None where the two differ or groups are counted."""
    if re.search(r"\(\?\(|\\[0-9]|\(\?P?<?[aLu]+[):]|\\N\{", pattern) or re.search(r"(?<!\\)\((?!\?)", pattern):
        return None
    names = re.findall(r"\(\?P<(\w+)>", pattern)
    for name in names:
        new = f"g{number}x{re.sub('[^a-zA-Z0-9]', '', name)}"
        pattern = pattern.replace(f"(?P<{name}>", f"(?<{new}>").replace(f"(?P={name})", rf"\k<{new}>")
    return pattern.replace(r"\Z", r"\z")


class WildcardControl(FlowControl):
    """By patterns of categories. Where none in allow matches, SKIP; else HALT or SKIP if a pattern there matches, HALT first; else ALLOW."""

    FLAGS = "N|B|I|S"

    def default_config(self) -> dict:
        return {"allow": ["*"], "halt": [], "skip": []}

    def setup(self) -> None:
        self.match = {k: [Matcher(p, self.FLAGS, 0, False) for p in v] for k, v in self.config.items()}

    def columns(self, category: Column) -> tuple[Column, Column]:
        """(allowed, halted) as expressions, for categories that aren't known beforehand."""
        self.ready()
        hit = lambda k: reduce(lambda a, b: a | b, (m.column(category) for m in self.match[k]), F.lit(False))
        allow, halt, skip = (hit(k) for k in ("allow", "halt", "skip"))
        return allow & ~halt & ~skip, allow & halt

    def adjust(self, category: str) -> int:
        self.ready()
        hit = lambda k: any(m(category) for m in self.match[k])
        if not hit("allow"):
            return SKIP
        return HALT if hit("halt") else SKIP if hit("skip") else ALLOW
