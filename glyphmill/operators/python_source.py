"""Docstrings, comments and strings of Python sources."""

from __future__ import annotations

import io
import re
import textwrap
import tokenize
import unicodedata

from glyphmill.functions import encodings
from glyphmill.model import Chunk, Filter, newlines
from glyphmill.operators.source_code import Strings

#: What stands before a string that is a statement of its own.
BEFORE_DOC = {tokenize.INDENT, tokenize.DEDENT, tokenize.NEWLINE, tokenize.ENCODING}
FSTRING = {kind: getattr(tokenize, name) for kind, name in (("start", "FSTRING_START"), ("middle", "FSTRING_MIDDLE"), ("end", "FSTRING_END")) if hasattr(tokenize, name)}
TSTRING = {kind: getattr(tokenize, name) for kind, name in (("start", "TSTRING_START"), ("middle", "TSTRING_MIDDLE"), ("end", "TSTRING_END")) if hasattr(tokenize, name)}
STARTS, MIDDLES, ENDS = ({x[kind] for x in (FSTRING, TSTRING) if kind in x} for kind in ("start", "middle", "end"))
LITERAL = re.compile(r"([a-zA-Z]*)('''|\"\"\"|'|\")([\s\S]*)\2\Z")
PLAIN = {"a": "\a", "b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t", "v": "\v", "\n": ""}
ESCAPE = re.compile(r"\\(?:(?P<s>[abfnrtv'\"\\\n])|x(?P<x>[0-9a-fA-F]{2})|u(?P<u>[0-9a-fA-F]{4})|U(?P<U>[0-9a-fA-F]{8})|(?P<o>[0-7]{1,3})|N\{(?P<n>[^{}]*)\})")
BYTE_ESCAPE = re.compile(r"\\(?:(?P<s>[abfnrtv'\"\\\n])|x(?P<x>[0-9a-fA-F]{2})|(?P<o>[0-7]{1,3}))")
FIELD = re.compile(r"(?P<twice>\{\{|\}\})|\{[^{}]*\}")


def unescaped(m: re.Match) -> str:
    found = m.groupdict()
    if found["s"]:
        out = PLAIN.get(found["s"], found["s"])
    elif found.get("n") is not None:
        try:
            out = unicodedata.lookup(found["n"])
        except KeyError:
            out = m[0]
    elif found["o"]:
        n = int(found["o"], 8)
        out = chr(n % 256 if m.re is BYTE_ESCAPE else n)
    else:
        n = int(found["x"] or found.get("u") or found.get("U"), 16)
        out = chr(n) if n <= 0x10FFFF else m[0]
    return out.replace("\0", "\n")


def content(prefix: str, body: str, decode: bool) -> str:
    """A literal's text: escapes decoded by its prefix, format fields as a space, the non-printing bytes of byte strings as line breaks, outdented."""
    types = set(prefix.lower())
    fields = types & {"f", "t"}
    if fields and (decode or "r" not in types):
        body = FIELD.sub(lambda m: m[0] if m["twice"] else " ", body) if "r" in types else FIELD.sub(lambda m: m[0] if m["twice"] else " ", re.sub(r"\\N\{\{?([^{}]*)\}\}?", lambda m: unescaped(ESCAPE.match(f"\\N{{{m[1]}}}")), body))
    if "r" not in types and decode:
        body = (BYTE_ESCAPE if "b" in types else ESCAPE).sub(unescaped, body)
    body = newlines(body)
    if "b" in types:
        body = re.sub(r"[^\n\x20-\x7e\u0100-\U0010ffff]+", "\n", body)
    return textwrap.dedent(body)


class PythonFilter(Filter):
    def default_config(self) -> dict:
        return {"comments": True, "docstrings": True, "strings": False, "group_comments": False, "decode_escapes": True, "string_types": "ftu"}

    def validated(self, key, value):
        value = super().validated(key, value)
        if key == "string_types":
            Strings(value, "bfrut")
        return value

    def setup(self) -> None:
        self.types = Strings(self.config["string_types"], "bfrut")

    def header_encoding(self, head: bytes) -> str | None:
        return encodings.source_cookie(head)

    def categories(self) -> tuple[str, ...]:
        return "py-docstring", "py-comment", "py-string"

    def meant(self, prefix: str) -> bool:
        types = set(prefix.lower())
        return self.types(types if types & set("bft") else types | {"u"})

    def process(self, chunk: Chunk) -> list[Chunk]:
        self.ready()
        c = self.config
        docs: list[Chunk] = []
        strings: list[Chunk] = []
        comments: list[list] = []
        scopes: list[tuple[str, int, bool]] = []  # name as shown, column of its keyword, whether a class
        column = 0  # of the block that the token is in
        keyword = ""
        header = False  # between "def" or "class" and the end of that line
        before, after_comment = tokenize.NEWLINE, False
        formats: list[tuple[str, bool]] = []

        def place(line: int) -> str:
            crumbs = "".join((("." if scopes[k - 1][2] else ", ") if k else "") + s[0] for k, s in enumerate(scopes))
            return f"{chunk.context}({line}): {crumbs}"

        def is_doc() -> bool:
            return before in BEFORE_DOC and not header

        for kind, value, (line, at), _, _ in tokenize.generate_tokens(io.StringIO(chunk.text).readline):
            if kind == tokenize.NAME:
                if value in ("def", "class") and not keyword:
                    keyword = value
                    while scopes and scopes[-1][1] >= column:
                        scopes.pop()
                    header = True
                elif keyword:
                    scopes.append((value + ("" if keyword == "class" else "()"), column, keyword == "class"))
                    keyword = ""
            elif kind in STARTS:
                formats.append((value, is_doc()))
            elif kind in ENDS:
                formats.pop()
            elif kind in MIDDLES and formats:
                opening, doc = formats[-1]
                prefix = opening.rstrip("'\"")
                if (c["docstrings"] if doc else c["strings"]) and (doc or self.meant(prefix)) and self.meant(prefix):
                    text = content(prefix, value, c["decode_escapes"])
                    if text:
                        strings.append(Chunk(text, place(line), "utf-8", "py-string"))
            elif kind == tokenize.STRING:
                prefix, _, body = LITERAL.match(value.strip()).groups()
                doc = is_doc()
                if c["docstrings"] if doc else c["strings"] and self.meant(prefix):
                    text = content(prefix, body, c["decode_escapes"])
                    if text:
                        (docs if doc else strings).append(Chunk(text, place(line), "utf-8", "py-docstring" if doc else "py-string"))
            elif kind == tokenize.COMMENT and c["comments"]:
                if c["group_comments"] and after_comment and comments and comments[-1][2] + 1 == line:
                    comments[-1][0] += "\n" + value[1:]
                    comments[-1][2] = line
                else:
                    comments.append([value[1:], place(line) if scopes else f"{chunk.context}({line})", line])
            if kind == tokenize.INDENT:
                column = len(value.expandtabs())
                header = False
            elif kind == tokenize.DEDENT:
                column = at
                while scopes and scopes[-1][1] >= column:
                    scopes.pop()
            elif kind == tokenize.NEWLINE and header:
                header = False
                if before != tokenize.OP:  # a body on the same line ends with it
                    pass
            if kind == tokenize.COMMENT or after_comment and kind == tokenize.NL:
                after_comment = True
            else:
                before, after_comment = kind, False
        return docs + [Chunk(textwrap.dedent(text), where, chunk.encoding, "py-comment") for text, where, _ in comments] + strings
