"""Glob patterns as regular expressions, for paths and for categories."""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

FLAGS = {
    "CASE": "C", "IGNORECASE": "I", "RAWCHARS": "R", "NEGATE": "N", "MINUSNEGATE": "M", "GLOBSTAR": "G", "DOTGLOB": "D", "EXTGLOB": "E",
    "BRACE": "B", "FOLLOW": "L", "MATCHBASE": "X", "NEGATEALL": "A", "NOUNIQUE": "Q", "GLOBTILDE": "T", "SPLIT": "S", "NODIR": "O",
}
DEFAULT = "N|B|G"


class PatternLimitError(ValueError):
    """Brace expansion and splitting gave more patterns than allowed."""


def to_flags(text: str) -> frozenset[str]:
    """Letters of the flags named in text, by name or letter, between "|"; unknown names are left out."""
    names = (x.strip().upper() for x in text.split("|"))
    return frozenset(FLAGS.get(x, x) for x in names if x in FLAGS or x in FLAGS.values())


def split(pattern: str) -> list[str]:
    """Parts between "|" outside of brackets, groups and escapes."""
    out, depth, start, i = [], 0, 0, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            i += 1
        elif c == "[":
            close = bracket_end(pattern, i)
            i = close if close > 0 else i
        elif c == "(":
            depth += 1
        elif c == ")":
            depth = max(0, depth - 1)
        elif c == "|" and not depth:
            out.append(pattern[start:i])
            start = i + 1
        i += 1
    return out + [pattern[start:]]


def bracket_end(pattern: str, at: int) -> int:
    """Where the character class that begins at a "[" ends, or -1."""
    i = at + 1
    if pattern[i : i + 1] in ("!", "^"):
        i += 1
    if pattern[i : i + 1] == "]":
        i += 1
    while i < len(pattern) and pattern[i] != "]":
        i += 2 if pattern[i] == "\\" else 1
    return i if i < len(pattern) else -1


def braces(pattern: str) -> Iterator[str]:
    """Expansions of {a,b} and {1..3} in the order of a shell."""
    i = 0
    while i < len(pattern):
        if pattern[i] == "\\":
            i += 2
            continue
        if pattern[i] == "{":
            depth, j, cuts = 0, i, [i]
            while j < len(pattern):
                c = pattern[j]
                if c == "\\":
                    j += 1
                elif c == "{":
                    depth += 1
                elif c == "}":
                    depth -= 1
                    if not depth:
                        break
                elif c == "," and depth == 1:
                    cuts.append(j)
                j += 1
            if j < len(pattern):
                body = pattern[i + 1 : j]
                span = re.fullmatch(r"(-?\d+|[a-zA-Z])\.\.(-?\d+|[a-zA-Z])(?:\.\.(-?\d+))?", body)
                options: list[str] | None = None
                if len(cuts) > 1:
                    options = [x for a, b in zip(cuts, cuts[1:] + [j]) for x in braces(pattern[a + 1 : b])]
                elif span:
                    options = sequence(span[1], span[2], int(span[3] or 1))
                if options is not None:
                    for tail in braces(pattern[j + 1 :]):
                        for x in options:
                            yield pattern[:i] + x + tail
                    return
        i += 1
    yield pattern


def sequence(a: str, b: str, step: int) -> list[str]:
    step = abs(step) or 1
    if a.lstrip("-").isdigit() != b.lstrip("-").isdigit():
        return [f"{{{a}..{b}}}"]
    low, high = (int(a), int(b)) if a.lstrip("-").isdigit() else (ord(a), ord(b))
    values = range(low, high + 1, step) if low <= high else range(low, high - 1, -step)
    if not a.lstrip("-").isdigit():
        return [chr(x) for x in values]
    width = max(len(a), len(b)) if any(x.lstrip("-").startswith("0") and len(x.lstrip("-")) > 1 for x in (a, b)) else 0
    return [str(x).zfill(width) for x in values]


def translate(pattern: str, flags: frozenset[str], path: bool) -> str:
    """One pattern, without negation, as an expression to be matched whole."""
    if "R" in flags:
        pattern = re.sub(r"\\(?:x([0-9a-fA-F]{2})|u([0-9a-fA-F]{4})|U([0-9a-fA-F]{8}))", lambda m: chr(int(m[1] or m[2] or m[3], 16)), pattern)
    if path and "T" in flags and pattern.startswith("~"):
        pattern = os.path.expanduser(pattern)
    if path and "X" in flags and "/" not in pattern:
        pattern = "**/" + pattern
        flags |= {"G"}
    any_char, hidden = ("[^/]" if path else "[\\s\\S]"), ("" if "D" in flags or not path else r"(?!\.)")
    groups: list[tuple[str, str]] = []
    out: list[str] = []
    i, fresh = 0, True  # fresh: at the start of a part of the path
    while i < len(pattern):
        c = pattern[i]
        start = fresh
        fresh = False
        if "E" in flags and c in "?*+@!" and pattern[i + 1 : i + 2] == "(":
            groups.append((c, "".join(out)))
            out.append({"!": f"(?:(?!(?:"}.get(c, (hidden if start else "") + "(?:"))
            i += 2
            continue
        if groups and c == "|":
            out.append("|")
        elif groups and c == ")":
            kind, _ = groups.pop()
            out.append(f")(?:$|/)){any_char}*)" if kind == "!" else ")" + {"@": ""}.get(kind, kind))
        elif c == "\\" and i + 1 < len(pattern):
            i += 1
            out.append(re.escape(pattern[i]))
        elif c == "/" and path:
            out.append("/+")
            fresh = True
        elif c == "*":
            j = i
            while j < len(pattern) and pattern[j] == "*":
                j += 1
            whole = start and pattern[j : j + 1] in ("", "/")
            if path and "G" in flags and j - i >= 2 and whole:
                part = hidden + "[^/]+"
                if pattern[j : j + 1] == "/":
                    out.append(f"(?:{part}/+)*")
                    j += 1
                    fresh = True
                else:
                    out.append(f"(?:{part}(?:/+{part})*)?")
            else:
                out.append((hidden if start else "") + any_char + ("+" if start and path and whole else "*"))
            i = j
            continue
        elif c == "?":
            out.append((hidden if start else "") + any_char)
        elif c == "[" and (close := bracket_end(pattern, i)) > 0:
            body = pattern[i + 1 : close]
            no = body[:1] in ("!", "^")
            body = body[1:] if no else body
            named = {"alpha": "a-zA-Z", "digit": "0-9", "alnum": "a-zA-Z0-9", "upper": "A-Z", "lower": "a-z", "space": r"\s", "xdigit": "0-9a-fA-F", "word": r"\w", "punct": r"!-/:-@\[-`{-~"}
            body = re.sub(r"\[:(\w+):\]", lambda m: named.get(m[1], ""), body.replace("[", "\\[") if "[:" not in body else body)
            body = re.sub(r"([&~|])\1", r"\\\1\\\1", body)
            out.append((hidden if start else "") + ("(?!/)" if path else "") + f"[{'^' if no else ''}{body if body[:1] != '^' else chr(92) + body}]")
            i = close
        else:
            out.append(re.escape(c))
        i += 1
    return "".join(out)


class Matcher:
    """Patterns of one glob: a text matches if a positive pattern does and no negated one."""

    def __init__(self, patterns: str | Iterable[str], flags: str = DEFAULT, limit: int = 1000, path: bool = True) -> None:
        self.letters = to_flags(flags) | ({"S"} if path else frozenset())
        case = re.IGNORECASE if "I" in self.letters and "C" not in self.letters else 0
        count = 0
        self.positive: list[str] = []
        self.negative: list[str] = []
        for whole in [patterns] if isinstance(patterns, str) else patterns:
            for part in split(whole) if "S" in self.letters else [whole]:
                for one in braces(part) if "B" in self.letters else [part]:
                    count += 1
                    if limit and count > limit:
                        raise PatternLimitError(f"The patterns expand to more than {limit}")
                    mark = "-" if "M" in self.letters else "!"
                    no = "N" in self.letters and one.startswith(mark) and not ("E" in self.letters and one[1:2] == "(")
                    one = one[1:] if no else one
                    (self.negative if no else self.positive).append(os.path.normpath(one) if path and one and "\\" not in one else one)
        if self.negative and not self.positive and "A" in self.letters:
            self.positive.append("**" if path else "*")
        deep = self.letters | ({"G", "D"} if path else frozenset())
        self.yes = [re.compile(translate(p, self.letters, path), case) for p in self.positive]
        self.no = [re.compile(translate(p, deep, path), case) for p in self.negative]

    def __call__(self, text: str) -> bool:
        return any(p.fullmatch(text) for p in self.yes) and not any(p.fullmatch(text) or p.fullmatch(text.lstrip("/")) for p in self.no)

    def column(self, text: Column) -> Column:
        """The same as an expression."""
        whole = lambda p: rf"\A(?{'iuU' if p.flags & re.IGNORECASE else 'U'}:{p.pattern})\z"
        any_ = lambda patterns, of: reduce(lambda a, b: a | b, (of.rlike(whole(p)) for p in patterns), F.lit(False))
        found = any_(self.yes, text)
        return found & ~any_(self.no, text) & ~any_(self.no, F.regexp_replace(text, "^/+", "")) if self.no else found

    def roots(self) -> list[tuple[str, bool]]:
        """For each positive pattern the longest folder that has no special character, and whether deeper folders can match."""
        out = []
        for p in self.positive:
            parts = (os.path.expanduser(p) if "T" in self.letters else p).split("/")
            k = 0
            while k < len(parts) - 1 and not re.search(r"[*?\[\](){}!+@\\]", parts[k]):
                k += 1
            deep = len(parts) - k > 1 or "**" in p or ("X" in self.letters and "/" not in p)
            out.append(("/".join(parts[:k]) or ("/" if p.startswith("/") else "."), deep))
        return out
