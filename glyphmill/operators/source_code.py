"""Comments and strings of C-like sources, JavaScript and style sheets.

Each language is a scanner: a function that goes through the text and reports what it finds as items. Grouping of line comments, outdenting, contexts
and the order of output are the same for all.
"""

from __future__ import annotations

import re
import struct
import sys
import textwrap
from collections.abc import Iterator
from dataclasses import dataclass

from glyphmill.model import Chunk, Filter, newlines


@dataclass
class Item:
    """kind: block, line, doc or string. indent: the white space before a line comment that stands alone on its line, else None."""

    kind: str
    text: str
    line: int
    encoding: str | None = None
    indent: str | None = None


def grouped(items: Iterator[Item], group: bool) -> list[Item]:
    """Line comments on consecutive lines by themselves, equally indented, as one."""
    out: list[Item] = []
    last: Item | None = None
    upto = 0
    for item in items:
        if item.kind == "line":
            if group and last and item.indent is not None and last.indent == item.indent and item.line == upto + 1:
                last.text += "\n" + item.text
            else:
                out.append(item)
                last = item if item.indent is not None else None
            upto = item.line + item.text.count("\n") if item.text.endswith("\\") else item.line
            continue
        out.append(item)
    return out


class SourceFilter(Filter):
    """order: the kinds in their order of output, with the category of each."""

    order: tuple[tuple[str, str], ...] = ()

    def wanted(self, kind: str) -> bool:
        return bool(self.config[{"block": "block_comments", "line": "line_comments", "doc": "jsdocs", "string": "strings"}[kind]])

    def prefix(self) -> str:
        raise NotImplementedError

    def scan(self, text: str) -> Iterator[Item]:
        raise NotImplementedError

    def categories(self) -> tuple[str, ...]:
        prefix = self.prefix()
        return tuple(f"{prefix}-{name}" if prefix else name for _, name in self.order)

    def process(self, chunk: Chunk) -> list[Chunk]:
        self.ready()
        items = grouped((i for i in self.scan(chunk.text) if self.wanted(i.kind)), self.config["group_comments"])
        names = dict(zip((kind for kind, _ in self.order), self.categories()))
        return [
            Chunk(textwrap.dedent(item.text), f"{chunk.context} ({item.line})", item.encoding or chunk.encoding, names[kind])
            for kind, _ in self.order
            for item in items
            if item.kind == kind
        ]


def alone(text: str, at: int) -> str | None:
    """The white space between the line's start and a place, or null if something else stands there."""
    start = text.rfind("\n", 0, at) + 1
    before = text[start:at]
    return before if not before.strip(" \t") else None


class Strings:
    """Which types of strings are meant: letters of which all of a string's must be among, "x*" for any string with x, "*" for all."""

    def __init__(self, spec: str, letters: str) -> None:
        if not re.fullmatch(rf"\*|(?:[{letters}]\*?)+", spec, re.I):
            raise ValueError(f"{spec!r} are no types of strings")
        parts = re.findall(r"(\w)(\*?)", spec.lower())
        self.all = spec == "*"
        self.wild = {x for x, star in parts if star}
        self.plain = {x for x, star in parts if not star}

    def __call__(self, types: set[str]) -> bool:
        return self.all or types <= self.plain or bool(types & self.wild)


SIMPLE = {"a": "\a", "b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t", "v": "\v", "\n": ""}


class CppFilter(SourceFilter):
    """Sources of C, C++ and, in generic mode, of other languages with such comments."""

    order = (("block", "block-comment"), ("line", "line-comment"), ("string", "string"))
    TRIGRAPH = dict(zip("=/'()!<>-", "#\\^[]|{}~"))
    WIDTH = {1: "B", 2: "H", 4: "I"}

    def default_config(self) -> dict:
        return {"block_comments": True, "line_comments": True, "strings": False, "group_comments": False, "generic_mode": False, "trigraphs": False, "decode_escapes": True, "prefix": "cpp", "string_types": "sul", "charset_size": 1, "exec_charset": "utf-8", "wide_charset_size": 4, "wide_exec_charset": "utf-32"}

    def validated(self, key, value):
        value = super().validated(key, value)
        if key == "string_types":
            Strings(value, "rusl")
        if key == "charset_size" and value not in (1, 2, 4) or key == "wide_charset_size" and value not in (2, 4):
            raise ValueError(f"{key} can't be {value}")
        return value

    def setup(self) -> None:
        c = self.config
        self.types = Strings(c["string_types"], "rusl")
        self.generic = c["generic_mode"]
        line = r"//[^\n]*" if self.generic else r"//(?:\\[\s\S]|[^\\\n])*"
        text = "" if self.generic else r"""|(?P<raw>(?P<r>(?:u8|[LuU])?R)"(?P<d>[^\s()\\]*)\((?P<body>[\s\S]*?)\)(?P=d)")|(?P<str>(?P<p>u8|[LuU])?"(?P<in>(?:\\[\s\S]|[^"\\\n])*)")|(?:u8|[LuU])?'(?:\\[\s\S]|[^'\\\n])*'"""
        plain = r"""|"(?:\\[\s\S]|[^"\\\n])*"|'(?:\\[\s\S]|[^'\\\n])*'""" if self.generic else ""
        self.token = re.compile(rf"/\*(?P<block>[\s\S]*?)\*/|(?P<line>{line}){text}{plain}|\w+|[\s\S]")
        endian = "<" if sys.byteorder == "little" else ">"
        name = "le" if endian == "<" else "be"

        def exact(charset: str) -> str:
            low = charset.lower()
            return f"{low}-{name}" if low in ("utf-16", "utf-32") else low

        self.narrow = (endian + self.WIDTH[c["charset_size"]], 1 << 8 * c["charset_size"], exact(c["exec_charset"]), c["exec_charset"])
        self.wide = (endian + self.WIDTH[c["wide_charset_size"]], 1 << 8 * c["wide_charset_size"], exact(c["wide_exec_charset"]), c["wide_exec_charset"])

    def prefix(self) -> str:
        return self.config["prefix"]

    def scan(self, text: str) -> Iterator[Item]:
        if self.config["trigraphs"] and not self.generic:
            text = re.sub(r"\?\?([=/'()!<>-])", lambda m: self.TRIGRAPH[m[1]], text)
        line = 1
        for m in self.token.finditer(text):
            if m["block"] is not None:
                yield Item("block", m["block"], line)
            elif m["line"] is not None:
                body = m["line"][2:]
                yield Item("line", body if self.generic else body.replace("\\\n", ""), line, indent=alone(text, m.start()))
            elif not self.generic and m["raw"] is not None:
                prefix = m["r"][:-1]
                if self.types({"r"} | self.kind(prefix)):
                    yield Item("string", newlines(m["body"]), line, self.charset(prefix))
            elif not self.generic and m["str"] is not None:
                prefix = m["p"] or ""
                if self.types(self.kind(prefix)):
                    body = m["in"]
                    if self.config["decode_escapes"]:
                        body = self.code_points(body, prefix) if prefix[:1] in ("u", "U") else self.code_units(body, prefix)
                    yield Item("string", newlines(body.replace("\0", "\n")), line, self.charset(prefix))
            line += m[0].count("\n")

    @staticmethod
    def kind(prefix: str) -> set[str]:
        return {"l"} if prefix == "L" else {"u"} if prefix else {"s"}

    def charset(self, prefix: str) -> str:
        return {"": self.narrow[3], "L": self.wide[3], "u8": "utf-8", "u": "utf-16", "U": "utf-32"}[prefix]

    def code_points(self, body: str, prefix: str) -> str:
        """Escapes of u8, u and U strings: each is a character by itself; one beyond the type's range stays as it is."""
        most = 0x10FFFF if prefix == "U" else 0xFFFF

        def one(m: re.Match) -> str:
            if m["s"] is not None:
                return SIMPLE.get(m["s"], m["s"])
            n = int(m["x"] or m["u"] or m["U"] or "0", 16) if not m["o"] else int(m["o"], 8)
            return chr(n) if n <= most else m[0]

        return re.sub(r"\\(?:(?P<s>[abfnrtv'\"?\\\n])|x(?P<x>[0-9a-fA-F]+)|u(?P<u>[0-9a-fA-F]{4})|U(?P<U>[0-9a-fA-F]{8})|(?P<o>[0-7]{1,3}))", one, body)

    def code_units(self, body: str, prefix: str) -> str:
        """Escapes of other strings: neighbouring hexadecimal or octal ones are units of one sequence in the execution character set."""
        pack, most, codec, _ = self.wide if prefix == "L" else self.narrow

        def units(numbers: list[int]) -> str:
            return b"".join(struct.pack(pack, n) if n < most else " ".encode(codec) for n in numbers).decode(codec, "replace")

        def one(m: re.Match) -> str:
            if m["s"] is not None:
                return SIMPLE.get(m["s"], m["s"])
            if m["x"]:
                return units([int(x, 16) for x in m["x"].split("\\x")[1:]])
            if m["o"]:
                return units([int(x, 8) for x in m["o"].split("\\")[1:]])
            n = int(m["u"], 16)
            return chr(n).encode(codec, "replace").decode(codec) if n <= 0x10FFFF else m[0]

        return re.sub(r"(?P<x>(?:\\x[0-9a-fA-F]+)+)|(?P<o>(?:\\[0-7][0-7]?[0-7]?)+)|\\(?:(?P<s>[abfnrtv'\"?\\\n])|(?:u(?=[0-9a-fA-F]{4})|U(?=[0-9a-fA-F]{8}))(?P<u>(?<=u)[0-9a-fA-F]{4}|(?<=U)[0-9a-fA-F]{8}))", one, body)


class StylesheetsFilter(SourceFilter):
    """CSS, SCSS and Sass; only the latter two have line comments."""

    order = (("block", "block-comment"), ("line", "line-comment"))

    def default_config(self) -> dict:
        return {"group_comments": False, "line_comments": True, "block_comments": True, "stylesheets": "css"}

    def validated(self, key, value):
        value = super().validated(key, value)
        if key == "stylesheets" and value.lower() not in ("css", "scss", "sass"):
            raise ValueError(f"{value!r} is no kind of style sheet")
        return value

    def prefix(self) -> str:
        return self.config["stylesheets"].lower()

    def setup(self) -> None:
        line = "" if self.prefix() == "css" else r"|(?P<line>//[^\n]*)"
        self.token = re.compile(rf"""/\*(?P<block>[\s\S]*?)\*/{line}|url\(\s*[^"')\s][^)]*\)|"(?:\\[\s\S]|[^"\\\n])*"|'(?:\\[\s\S]|[^'\\\n])*'|[\w-]+|[\s\S]""")

    def scan(self, text: str) -> Iterator[Item]:
        line = 1
        for m in self.token.finditer(text):
            found = m.groupdict()
            if found["block"] is not None:
                yield Item("block", found["block"], line)
            elif found.get("line") is not None:
                yield Item("line", found["line"][2:], line, indent=alone(text, m.start()))
            line += m[0].count("\n")


class JavaScriptFilter(SourceFilter):
    order = (("block", "block-comment"), ("line", "line-comment"), ("doc", "docs"), ("string", "strings"))
    CODE = re.compile(r"""/\*[\s\S]*?\*/|//[^\n]*|"(?:\\[\s\S]|[^"\\\n])*"|'(?:\\[\s\S]|[^'\\\n])*'|[`{}\n]|[^"'`{}/\n]+|[\s\S]""")
    TEMPLATE = re.compile(r"(?P<text>(?:[^\\$`]|\\[\s\S]|\$(?!\{))*)(?P<end>`|\$\{|\Z)")
    ESCAPE = re.compile(r"\\(?:(?P<o>0[0-7]{1,2}|[1-7][0-7]{0,2})|(?P<s>[bfnrtv0\n])|u\{(?P<b>[0-9a-fA-F]+)\}|u(?P<u>[0-9a-fA-F]{4})|x(?P<x>[0-9a-fA-F]{2})|(?P<any>[\s\S]))")

    def default_config(self) -> dict:
        return {"jsdocs": False, "strings": False, "group_comments": False, "line_comments": True, "block_comments": True, "decode_escapes": True}

    def prefix(self) -> str:
        return "js"

    def unescaped(self, text: str, template: bool) -> str:
        if not self.config["decode_escapes"]:
            return text

        def one(m: re.Match) -> str:
            if m["o"] and not template:
                n = int(m["o"], 8)
                return (chr(n) if n < 256 else chr(n >> 3) + m["o"][-1]).replace("\0", "\n")
            if m["s"]:
                return "\n" if m["s"] == "0" else SIMPLE.get(m["s"], m["s"])
            code = m["b"] or m["u"] or m["x"]
            if code:
                n = int(code, 16)
                return m[0] if n > 0x10FFFF else chr(n).replace("\0", "\n")
            return m[0][1:]

        out = self.ESCAPE.sub(one, text)
        paired = out.encode("utf-16", "surrogatepass").decode("utf-16", "replace")  # halves that belong together become one character
        return paired

    def scan(self, text: str) -> Iterator[Item]:
        """Templates may hold code that holds templates: a stack has the pieces of each open one, and how many braces are open in its code."""
        line, at = 1, 0
        open_: list[tuple[list[str], int]] = []

        def template(at: int) -> tuple[int, bool]:
            m = self.TEMPLATE.match(text, at)
            piece = self.unescaped(m["text"], True)
            if piece:
                open_[-1][0].append(piece)
            return m.end(), m["end"] == "${"

        while at < len(text):
            m = self.CODE.match(text, at)
            got, start = m[0], at
            at = m.end()
            if got == "`":
                open_.append(([], 0))
                at, more = template(at)
            elif got == "{" and open_:
                open_[-1] = (open_[-1][0], open_[-1][1] + 1)
                continue
            elif got == "}" and open_:
                if open_[-1][1]:
                    open_[-1] = (open_[-1][0], open_[-1][1] - 1)
                    continue
                at, more = template(at)
            else:
                if got.startswith("/*"):
                    doc = re.match(r"/\*\*[ \t]*\n", got) if self.config["jsdocs"] else None
                    if doc:
                        lines = [re.sub(r"^\s*\*", "", x, count=1) if x.lstrip().startswith("*") else x.lstrip() for x in got[doc.end() : -2].rstrip(" \t").splitlines(True)]
                        yield Item("doc", "\n" + "".join(lines), line)
                    else:
                        yield Item("block", got[2:-2], line)
                elif got.startswith("//"):
                    yield Item("line", got[2:], line, indent=alone(text, start))
                elif got[0] in "\"'" and len(got) > 1:
                    yield Item("string", self.unescaped(got[1:-1], False), line, "utf-8")
                line += got.count("\n")
                continue
            line += text.count("\n", start, at)
            if not more:
                pieces, _ = open_.pop()
                if pieces:
                    yield Item("string", " ".join(pieces), line, "utf-8")
