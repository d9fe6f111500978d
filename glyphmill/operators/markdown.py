"""Markdown as HTML: blocks line by line, then the text inside them.

Extensions: fenced_code (or superfences), tables, footnotes, def_list and attr_list are rendered (extra is all of them); toc, admonition, meta and others that only change looks are
accepted where they leave words alone.
"""

from __future__ import annotations

import html
import re

from glyphmill.model import Chunk, Filter

KNOWN = frozenset("fenced_code superfences tables extra attr_list toc meta nl2br sane_lists smarty codehilite highlight admonition wikilinks abbr def_list footnotes md_in_html betterem caret mark tilde".split())
BLOCK_HTML = re.compile(r"<!--|</?(?:address|article|aside|blockquote|details|div|dl|fieldset|figure|footer|form|h[1-6]|header|hr|main|nav|ol|p|pre|script|section|style|table|ul)(?=[\s/>]|$)", re.I)
FENCE = re.compile(r"^(?P<indent> {0,3})(?P<mark>`{3,}|~{3,})[ \t]*(?P<info>[^`\n]*)$")
LIST = re.compile(r"^( {0,3})([*+-]|\d{1,9}[.)])(?:[ \t]+|$)")
RULE = re.compile(r"^ {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
DEFINITION = re.compile(r"^ {0,3}\[(?P<id>[^\]\n]+)\]:[ \t]*<?(?P<url>[^\s>]+)>?[ \t]*(?:[\"'(](?P<title>.*)[\"')])?[ \t]*$")

FOOTNOTE = re.compile(r"^ {0,3}\[\^(?P<id>[^\]\s]+)\]:[ \t]*(?P<text>.*)$")
DESCRIPTION = re.compile(r"^ {0,3}:[ ]{1,3}(?P<text>.*)$")

# spans
CODE = re.compile(r"(?<![\\`])(`+)(?!`)([\s\S]+?)(?<!`)\1(?!`)")
ESCAPE = re.compile(r"\\([\\`*_{}\[\]()>#+.!|~-])")
ADDRESS = re.compile(r"<((?:https?|ftp)://[^\s>]+)>")
MAIL = re.compile(r"<([^\s<>@]+@[^\s<>]+)>")
TAG = re.compile(r"<!--[\s\S]*?-->|</?[a-zA-Z](?:[^<>\"']|\"[^\"]*\"|'[^']*')*>")
AMPERSAND = re.compile(r"&(?!#?\w+;)")
_TARGET = r"\((?:<(?P<angled>[^>]*)>|(?P<url>(?:[^\s()]|\([^\s()]*\))*))(?:\s+(?P<title>\"[^\"]*\"|'[^']*'))?\s*\)"
LINK = re.compile(rf"(!?)\[((?:[^\[\]]|\[[^\[\]]*\])*)\](?:{_TARGET}|[ ]?\[(?P<ref>[^\]]*)\]|(?P<alone>))")
EMPHASIS = [
    (mark, re.compile(rf"{before}{re.escape(mark)}(?=\S)([\s\S]+?)(?<=\S){re.escape(mark)}{after}"), tag)
    for mark, tag, before, after in (("**", "strong", "", ""), ("__", "strong", r"(?<!\w)", r"(?!\w)"), ("*", "em", "", ""), ("_", "em", r"(?<!\w)", r"(?!\w)"))
]
BREAK = re.compile(r" {2,}\n")
HEADING = re.compile(r"^ {0,3}(#{1,6})[ \t]*(.*?)[ \t]*#*[ \t]*$")
QUOTE = re.compile(r"^ {0,3}>")
#: Lines that end a paragraph, besides rules and fences: headings, quotes, and what underlines a heading.
ENDS = re.compile(r"^ {0,3}(?:(?:#{1,6}[ \t]|>)|=+[ \t]*$)")
#: What lines begin with, after blanks, that are no plain text of a paragraph: without one of these none of the patterns of blocks can match.
SPECIAL = frozenset("#>=*-_`~")


class Markdown:
    def __init__(self, extensions: set[str]) -> None:
        self.fences = bool(extensions & {"fenced_code", "superfences", "extra"})
        self.tables = bool(extensions & {"tables", "extra"})
        self.attributes = bool(extensions & {"attr_list", "extra"})
        self.breaks = "nl2br" in extensions
        self.footnotes = bool(extensions & {"footnotes", "extra"})
        self.descriptions = bool(extensions & {"def_list", "extra"})

    def convert(self, text: str) -> str:
        self.links: dict[str, tuple[str, str]] = {}
        self.notes: dict[str, list[str]] = {}
        lines, out, fence, note = text.expandtabs(4).split("\n"), [], None, None
        for i, line in enumerate(lines):
            if note is not None:  # goes on over indented lines, and over what follows it without a blank one
                if line.startswith("    ") or not line.strip() or lines[i - 1].strip() and not FOOTNOTE.match(line):
                    self.notes[note].append(line[4:] if line.startswith("    ") else line)
                    continue
                note = None
            m = FENCE.match(line) if self.fences and ("`" in line or "~" in line) else None
            if m and (fence is None or m["mark"].startswith(fence)):
                fence = m["mark"] if fence is None else None
            f = FOOTNOTE.match(line) if self.footnotes and fence is None else None
            if f:
                note = f["id"]
                self.notes[note] = [f["text"]]
                continue
            d = DEFINITION.match(line) if fence is None and "]:" in line else None
            if d and not d["id"].startswith("^"):
                self.links[" ".join(d["id"].lower().split())] = (d["url"], d["title"] or "")
            else:
                out.append(line)
        return "\n".join(self.blocks(out) + self.noted())

    def noted(self) -> list[str]:
        """The footnotes, at the end."""
        if not self.notes:
            return []
        items = []
        for k, (name, lines) in enumerate(self.notes.items()):
            back = f'&#160;<a class="footnote-backref" href="#fnref:{html.escape(name)}" title="Jump back to footnote {k + 1} in the text">&#8617;</a>'
            body = self.blocks(lines) or ["<p></p>"]
            body = [*body[:-1], body[-1][:-4] + back + "</p>"] if body[-1].endswith("</p>") else [*body, f"<p>{back}</p>"]
            items.append(f'<li id="fn:{html.escape(name)}">\n' + "\n".join(body) + "\n</li>")
        return ['<div class="footnote">\n<hr />\n<ol>\n' + "\n".join(items) + "\n</ol>\n</div>"]

    def described(self, lines: list[str], i: int) -> tuple[int, str] | None:
        """A list of terms and descriptions from line i on, if one begins there: where it ends, and what it is."""
        out: list[str] = []
        while True:
            j = i
            while j < len(lines) and lines[j].strip() and not DESCRIPTION.match(lines[j]) and not lines[j].startswith("    "):
                j += 1
            k = j + 1 if j < len(lines) and not lines[j].strip() else j
            if j == i or k >= len(lines) or not DESCRIPTION.match(lines[k]):
                break
            out += [f"<dt>{self.inline(x.strip())}</dt>" for x in lines[i:j]]
            loose, i = k > j, k
            while i < len(lines) and (m := DESCRIPTION.match(lines[i])):
                body, i = [m["text"]], i + 1
                while i < len(lines) and not DESCRIPTION.match(lines[i]):
                    if not lines[i].strip() and not (i + 1 < len(lines) and lines[i + 1].startswith("    ")):
                        break
                    body.append(re.sub("^ {1,4}", "", lines[i]))
                    i += 1
                loose |= "" in (x.strip() for x in body)
                out.append("<dd>" + "\n".join(self.blocks(body, not loose)) + "</dd>")
                if i + 1 < len(lines) and not lines[i].strip() and DESCRIPTION.match(lines[i + 1]):
                    loose, i = True, i + 1
            while i + 1 < len(lines) and not lines[i].strip():
                i += 1
        return (i, "<dl>\n" + "\n".join(out) + "\n</dl>") if out else None

    def blocks(self, lines: list[str], tight: bool = False) -> list[str]:
        out: list[str] = []
        i = 0
        while i < len(lines):
            line = lines[i]
            if not line.strip():
                i += 1
                continue
            fence = FENCE.match(line) if self.fences else None
            if fence:
                j = i + 1
                close = re.compile(rf"^ {{0,3}}{re.escape(fence['mark'][0])}{{{len(fence['mark'])},}}[ \t]*$")
                while j < len(lines) and not close.match(lines[j]):
                    j += 1
                if j < len(lines):
                    out.append(f"<pre><code>{html.escape(chr(10).join(lines[i + 1 : j]), False)}\n</code></pre>")
                    i = j + 1
                    continue
            if line.startswith("    "):
                j = i
                while j < len(lines) and (lines[j].startswith("    ") or not lines[j].strip()):
                    j += 1
                code = "\n".join(x[4:] for x in lines[i:j]).rstrip("\n")
                out.append(f"<pre><code>{html.escape(code, False)}\n</code></pre>")
                i = j
                continue
            if m := HEADING.match(line):
                out.append(f"<h{len(m[1])}>{self.inline(self.plain(m[2]))}</h{len(m[1])}>")
                i += 1
                continue
            if RULE.match(line):
                out.append("<hr />")
                i += 1
                continue
            if BLOCK_HTML.match(line):
                j = i
                while j < len(lines) and (lines[j].strip() or self.inside(lines[i:j])):
                    j += 1
                out.append("\n".join(lines[i:j]))
                i = j
                continue
            if QUOTE.match(line):
                j = i
                while j < len(lines) and lines[j].strip():
                    j += 1
                inner = self.blocks([re.sub(r"^ {0,3}> ?", "", x) for x in lines[i:j]])
                out.append("<blockquote>\n" + "\n".join(inner) + "\n</blockquote>")
                i = j
                continue
            if m := LIST.match(line):
                i = self.list_(lines, i, m, out)
                continue
            if self.tables and i + 1 < len(lines) and "|" in line and re.match(r"^ {0,3}\|?[ \t]*:?-+:?[ \t]*(\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$", lines[i + 1]):
                j = i + 2
                while j < len(lines) and "|" in lines[j]:
                    j += 1
                rows = [lines[i], *lines[i + 2 : j]]
                cells = [[c.strip() for c in re.split(r"(?<!\\)\|", r.strip().strip("|"))] for r in rows]
                head, *body = ["".join(f"<{t}>{self.inline(c)}</{t}>" for c in row) for t, row in zip(["th"] + ["td"] * len(cells), cells)]
                out.append(f"<table><thead><tr>{head}</tr></thead><tbody>" + "".join(f"<tr>{r}</tr>" for r in body) + "</tbody></table>")
                i = j
                continue
            if self.descriptions and (found := self.described(lines, i)):
                i = found[0]
                out.append(found[1])
                continue
            j = i + 1
            while j < len(lines) and (bare := lines[j].strip()) and (bare[0] not in SPECIAL or not ENDS.match(lines[j]) and not RULE.match(lines[j]) and not (self.fences and FENCE.match(lines[j]))):
                j += 1
            if j < len(lines) and j == i + 1 and (m := re.match(r"^ {0,3}(=+|-+)[ \t]*$", lines[j])):
                level = 1 if m[1][0] == "=" else 2
                out.append(f"<h{level}>{self.inline(self.plain(line.strip()))}</h{level}>")
                i = j + 1
                continue
            text = self.inline("\n".join(x.strip() if k else x.lstrip() for k, x in enumerate(lines[i:j])).rstrip())
            out.append(text if tight else f"<p>{text}</p>")
            i = j
        return out

    def plain(self, text: str) -> str:
        return re.sub(r"[ \t]*\{:?[^{}]*\}$", "", text) if self.attributes else text

    @staticmethod
    def inside(lines: list[str]) -> bool:
        """Whether a block of raw HTML is still open after these lines."""
        text = "\n".join(lines)
        if text.lstrip().startswith("<!--"):
            return "-->" not in text
        name = re.match(r"\s*<(\w+)", text)
        if not name or name[1].lower() == "hr":
            return False
        return len(re.findall(rf"<{name[1]}\b", text, re.I)) > len(re.findall(rf"</{name[1]}\s*>", text, re.I))

    def list_(self, lines: list[str], i: int, m: re.Match, out: list[str]) -> int:
        ordered = m[2][0].isdigit()
        items: list[list[str]] = []
        loose = False
        blank = False
        while i < len(lines):
            line = lines[i]
            n = LIST.match(line)
            if n and not RULE.match(line):
                if n[2][0].isdigit() != ordered:
                    break
                loose |= blank and bool(items)
                items.append([line[n.end() :]])
            elif not line.strip():
                if items:
                    items[-1].append("")
            elif line.startswith(" " * 4) or (line.startswith(" " * 2) and not blank):
                loose |= blank
                items[-1].append(re.sub(r"^ {1,4}", "", line))
            elif blank or not items:
                break
            else:
                items[-1].append(line)
            blank = not line.strip()
            i += 1
        tag = "ol" if ordered else "ul"
        out.append(f"<{tag}>\n" + "\n".join("<li>" + "\n".join(self.blocks(x, not loose)) + "</li>" for x in items) + f"\n</{tag}>")
        return i

    def inline(self, text: str) -> str:
        """Spans in order of precedence: code, escapes, raw tags and addresses, images and links, emphasis. What is done is put aside behind a mark."""
        kept: list[str] = []

        def keep(value: str) -> str:
            kept.append(value)
            return f"\ue010{len(kept) - 1}\ue011"

        def code(m: re.Match) -> str:
            return keep(f"<code>{html.escape(m[2].strip(), False)}</code>")

        def link(m: re.Match) -> str:
            image, label = m[1], m[2]
            if m["url"] is not None:
                url, title = m["url"], m["title"] or ""
            else:
                key = " ".join((m["ref"] or label).lower().split())
                if key not in self.links:
                    return m[0]
                url, title = self.links[key]
            named = f' title="{html.escape(title.strip(chr(34) + chr(39)))}"' if title else ""
            if image:
                return keep(f'<img alt="{html.escape(label)}" src="{html.escape(url)}"{named} />')
            return keep(f'<a href="{html.escape(url)}"{named}>') + label + keep("</a>")

        # each expression is tried only where the character is that it can't do without
        if "`" in text:
            text = CODE.sub(code, text)
        if "\\" in text:
            text = ESCAPE.sub(lambda m: keep(html.escape(m[1], False)), text)
        if "<" in text:
            text = ADDRESS.sub(lambda m: keep(f'<a href="{m[1]}">{m[1]}</a>'), text)
            text = MAIL.sub(lambda m: keep(f'<a href="mailto:{m[1]}">{m[1]}</a>'), text)
            text = TAG.sub(lambda m: keep(m[0]), text)
        if "&" in text:
            text = AMPERSAND.sub("&amp;", text)
        text = text.replace("<", "&lt;").replace(">", "&gt;")
        for k, name in enumerate(self.notes):
            text = text.replace(f"[^{name}]", keep(f'<sup id="fnref:{html.escape(name)}"><a class="footnote-ref" href="#fn:{html.escape(name)}">{k + 1}</a></sup>'))
        if "[" in text:
            for _ in range(2):  # an image may be a link's label
                text = LINK.sub(link, text)
        if self.attributes:
            text = re.sub(r"\{:[^{}]*\}", "", text)
        for mark, pattern, tag in EMPHASIS:
            if mark in text:
                text = pattern.sub(rf"<{tag}>\1</{tag}>", text)
        if "  \n" in text:
            text = BREAK.sub("<br />\n", text)
        if self.breaks:
            text = re.sub(r"(?<!<br />)\n", "<br />\n", text)
        while "\ue010" in text:
            text = re.sub("\ue010(\\d+)\ue011", lambda m: kept[int(m[1])], text)
        return text


class MarkdownFilter(Filter):
    def default_config(self) -> dict:
        return {"markdown_extensions": []}

    def validated(self, key, value):
        value = super().validated(key, value)
        self.names(value)
        return value

    @staticmethod
    def names(extensions: list) -> set[str]:
        """Extensions by their short names, from names or {name: options}; one that isn't known is an error."""
        found = {str(n).rsplit(".", 1)[-1] for e in extensions for n in (e if isinstance(e, dict) else [e])}
        if missing := found - KNOWN:
            raise ValueError(f"Markdown extensions that aren't known: {', '.join(sorted(missing))}")
        return found

    def setup(self) -> None:
        self.renderer = Markdown(self.names(self.config["markdown_extensions"]))

    def categories(self) -> tuple[str, ...]:
        return ("markdown",)

    def process(self, chunk: Chunk) -> list[Chunk]:
        self.ready()
        return [Chunk(self.renderer.convert(chunk.text), chunk.context, chunk.encoding, "markdown")]
