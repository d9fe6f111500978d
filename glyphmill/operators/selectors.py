"""CSS selectors over trees: compiled once to nested conditions, matched from the right."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from glyphmill.operators.tree import Node

Test = Callable[[Node], bool]
NAME = r"(?:\\(?:[0-9a-fA-F]{1,6}[ \t\n]?|[^\n0-9a-fA-F])|[-\w]|[^\x00-\x7f])+"
SPACE = r"[ \t\r\n\f]*"
TYPE = re.compile(rf"(?:(?P<ns>{NAME}|\*)?(?P<bar>\|)(?!=))?(?P<name>{NAME}|\*)")
ATTRIBUTE = re.compile(rf"\[{SPACE}(?:(?P<ns>{NAME}|\*)?\|(?!=))?(?P<name>{NAME}){SPACE}(?:(?P<op>[~^$*|!]?=){SPACE}(?P<value>\"(?:\\[\s\S]|[^\"\\])*\"|'(?:\\[\s\S]|[^'\\])*'|{NAME}){SPACE}(?P<flag>[iIsS])?{SPACE})?\]")
NTH = re.compile(rf"{SPACE}(?:(?P<word>odd|even)|(?P<a>[-+]?\d*)n{SPACE}(?:(?P<sign>[-+]){SPACE}(?P<b>\d+))?|(?P<only>[-+]?\d+)){SPACE}(?:of\b(?P<of>[\s\S]*))?\Z", re.I)


class SelectorError(ValueError):
    pass


def unescape(name: str) -> str:
    def one(m: re.Match) -> str:
        return chr(int(m[1], 16)) if m[1] else m[2]

    return re.sub(r"\\(?:([0-9a-fA-F]{1,6})[ \t\n]?|([\s\S]))", one, name)


def siblings(node: Node) -> list[Node]:
    return node.parent.elements() if node.parent is not None else [node]


def before(node: Node) -> list[Node]:
    out = []
    for other in siblings(node):
        if other is node:
            return out
        out.append(other)
    return out


def after(node: Node) -> list[Node]:
    every = siblings(node)
    return every[next(i for i, x in enumerate(every) if x is node) + 1 :]


def is_root(node: Node) -> bool:
    """An element around which nothing is, and beside which no other element or text stands."""
    if node.parent is None or node.parent.kind != "document":
        return False
    return all(x is node or x.kind in ("comment", "doctype", "instruction") or x.kind == "text" and not x.value.strip() for x in node.parent.children)


def same_type(a: Node, b: Node) -> bool:
    return a.name == b.name and a.namespace == b.namespace


@dataclass
class Compound:
    """Conditions on one element, and how it stands to the element that the rest of the selector is about."""

    tests: list[Test]
    combinator: str = ""
    rest: Compound | None = None

    def match(self, node: Node) -> bool:
        if not all(t(node) for t in self.tests):
            return False
        if self.rest is None:
            return True
        rest = self.rest.match
        if self.combinator == " ":
            return any(rest(x) for x in reversed(node.ancestors()))
        if self.combinator == ">":
            return node.parent is not None and node.parent.kind == "element" and rest(node.parent)
        earlier = before(node)
        return any(map(rest, earlier)) if self.combinator == "~" else bool(earlier) and rest(earlier[-1])


class Selector:
    """A list of selectors: matches what any of them matches. html: names are matched in lower case."""

    def __init__(self, text: str, namespaces: dict[str, str] | None = None, html: bool = False) -> None:
        self.namespaces, self.html = namespaces or {}, html
        self.text, self.at = text, 0
        self.compounds = self.selectors()
        if self.at < len(self.text):
            raise SelectorError(f"can't read {self.text[self.at :]!r}")

    def match(self, node: Node) -> bool:
        return any(c.match(node) for c in self.compounds)

    def take(self, pattern: str | re.Pattern) -> re.Match | None:
        m = re.compile(pattern).match(self.text, self.at)
        if m:
            self.at = m.end()
        return m

    def selectors(self) -> list[Compound]:
        out = []
        while True:
            out.append(self.chain())
            if not self.take(SPACE + "," + SPACE):
                return out

    def chain(self) -> Compound:
        self.take(SPACE)
        left = Compound(self.simple())
        while m := self.take(rf"{SPACE}([>+~]){SPACE}|[ \t\r\n\f]+(?![,)]|\Z)"):
            left = Compound(self.simple(), m[1] or " ", left)
        self.take(SPACE)
        return left

    def simple(self) -> list[Test]:
        tests: list[Test] = []
        start = self.at
        if m := self.take(TYPE):
            tests += self.type_tests(m["ns"], bool(m["bar"]), m["name"])
        elif "" in self.namespaces:
            tests += self.type_tests(None, False, "*")
        while True:
            if m := self.take(rf"#({NAME})"):
                tests.append(lambda n, v=unescape(m[1]): n.attribute("id") == v)
            elif m := self.take(rf"\.({NAME})"):
                tests.append(lambda n, v=unescape(m[1]): v in (n.attribute("class") or "").split())
            elif m := self.take(ATTRIBUTE):
                tests.append(self.attribute_test(m))
            elif m := self.take(rf":({NAME})(\()?"):
                tests.append(self.pseudo(m[1].lower(), self.argument() if m[2] else None))
            else:
                break
        if self.at == start:
            raise SelectorError(f"a selector is expected at {self.text[self.at :]!r}")
        return tests

    def argument(self) -> str:
        depth, start = 1, self.at
        while self.at < len(self.text):
            c = self.text[self.at]
            if c == "\\":
                self.at += 1
            elif c in "\"'":
                m = re.compile(rf"{c}(?:\\[\s\S]|[^{c}\\])*{c}").match(self.text, self.at)
                self.at = m.end() - 1 if m else self.at
            elif c == "(":
                depth += 1
            elif c == ")":
                depth -= 1
                if not depth:
                    self.at += 1
                    return self.text[start : self.at - 1]
            self.at += 1
        raise SelectorError("a parenthesis isn't closed")

    def type_tests(self, ns: str | None, bar: bool, name: str) -> list[Test]:
        tests: list[Test] = []
        if bar and not ns:
            tests.append(lambda n: not n.namespace)
        elif bar and ns != "*":
            wanted = self.namespaces.get(unescape(ns))
            tests.append(lambda n: wanted is not None and (n.namespace or "") == wanted)
        elif not bar and self.namespaces.get("") is not None:
            tests.append(lambda n, v=self.namespaces[""]: (n.namespace or "") == v)
        if name != "*":
            wanted_name = unescape(name)
            if self.html:
                tests.append(lambda n, v=wanted_name.lower(): n.name.lower() == v)
            else:
                tests.append(lambda n, v=wanted_name: n.name == v)
        return tests

    def attribute_test(self, m: re.Match) -> Test:
        ns, name, op, flag = m["ns"], unescape(m["name"]), m["op"], (m["flag"] or "").lower()
        value = m["value"]
        if value is not None:
            value = unescape(value[1:-1]) if value[0] in "\"'" else unescape(value)
        fold = flag == "i" or (self.html and name.lower() == "type" and flag != "s")
        value = value.lower() if fold and value is not None else value
        has_ns = "|" in m[0].split("=")[0].split("[", 1)[1][: len((ns or "") + "|") + 2] and op != "|=" or ns is not None

        def values(node: Node) -> list[str]:
            out = []
            for key, (space, local, text) in node.attributes.items():
                if has_ns and ns:
                    ok = local == name and (ns == "*" or space == self.namespaces.get(unescape(ns), "\0"))
                elif self.html:
                    ok = key.lower() == name.lower()
                else:
                    ok = key == name or (not has_ns and not space and local == name)
                if ok:
                    out.append(text.lower() if fold else text)
            return out

        tests = {
            None: lambda x: True,
            "=": lambda x: x == value,
            "~=": lambda x: bool(value) and not re.search(r"\s", value) and value in x.split(),
            "^=": lambda x: bool(value) and x.startswith(value),
            "$=": lambda x: bool(value) and x.endswith(value),
            "*=": lambda x: bool(value) and value in x,
            "|=": lambda x: x == value or x.startswith(value + "-"),
        }
        if op == "!=":
            return lambda n: value not in values(n)
        test = tests[op]
        return lambda n: any(map(test, values(n)))

    def inner(self, text: str) -> Selector:
        return Selector(text, self.namespaces, self.html)

    def pseudo(self, name: str, argument: str | None) -> Test:
        if argument is None:
            plain: dict[str, Test] = {
                "root": is_root,
                "empty": lambda n: not any(c.kind == "element" or c.kind in ("text", "cdata") and c.value.strip() for c in n.children),
                "first-child": lambda n: siblings(n)[0] is n,
                "last-child": lambda n: siblings(n)[-1] is n,
                "only-child": lambda n: len(siblings(n)) == 1,
                "first-of-type": lambda n: not any(same_type(x, n) for x in before(n)),
                "last-of-type": lambda n: not any(same_type(x, n) for x in after(n)),
                "only-of-type": lambda n: sum(same_type(x, n) for x in siblings(n)) == 1,
                "checked": lambda n: n.name == "option" and "selected" in n.attributes or n.name == "input" and "checked" in n.attributes and (n.attribute("type") or "").lower() in ("checkbox", "radio"),
                "disabled": lambda n: "disabled" in n.attributes,
                "enabled": lambda n: n.name in ("button", "input", "select", "textarea", "option", "optgroup", "fieldset") and "disabled" not in n.attributes,
                "required": lambda n: "required" in n.attributes,
                "optional": lambda n: n.name in ("input", "select", "textarea") and "required" not in n.attributes,
                "link": lambda n: n.name in ("a", "area") and "href" in n.attributes,
                "any-link": lambda n: n.name in ("a", "area") and "href" in n.attributes,
            }
            if name not in plain:
                raise SelectorError(f":{name} isn't known")
            return plain[name]
        if name in ("is", "matches", "where", "any"):
            return self.inner(argument).match if argument.strip() else (lambda n: False)
        if name == "not":
            if not argument.strip():
                return lambda n: True
            inner = self.inner(argument)
            return lambda n: not inner.match(n)
        if name == "has":
            return self.has(argument)
        if name in ("contains", "-soup-contains"):
            wanted = [unescape(x[1:-1] if x[:1] in "\"'" else x) for x in (p.strip() for p in re.findall(r"\"(?:\\.|[^\"])*\"|'(?:\\.|[^'])*'|[^,]+", argument))]
            return lambda n: any(w in n.text() for w in wanted)
        if name == "lang":
            wanted = [x.strip().strip("\"'").lower() for x in argument.split(",")]

            def speaks(n: Node) -> bool:
                for x in [n, *reversed(n.ancestors())]:
                    lang = x.attribute("lang") or x.attribute("xml:lang")
                    if lang is not None:
                        return any(lang.lower() == w or lang.lower().startswith(w + "-") for w in wanted)
                return False

            return speaks
        if name.startswith("nth-"):
            return self.nth(name, argument)
        raise SelectorError(f":{name}() isn't known")

    def has(self, argument: str) -> Test:
        """Relative selectors, each applied to what lies in the direction of its combinator."""
        parts: list[tuple[str, str]] = []
        helper = Selector.__new__(Selector)
        helper.text, helper.at = argument, 0
        depth, start = 0, 0
        cuts = []
        for i, c in enumerate(argument):
            depth += (c in "([") - (c in ")]")
            if c == "," and not depth:
                cuts.append(i)
        for a, b in zip([-1, *cuts], [*cuts, len(argument)]):
            text = argument[a + 1 : b].strip()
            combinator = text[0] if text[:1] in (">", "+", "~") else " "
            parts.append((combinator, text[1:].strip() if combinator != " " else text))
        tests = []
        for combinator, text in parts:
            if not text:
                raise SelectorError(":has() lacks a selector")
            tests.append((combinator, self.inner(text)))

        def found(node: Node) -> bool:
            for combinator, inner in tests:
                near = node.elements() if combinator == ">" else after(node)[:1] if combinator == "+" else after(node) if combinator == "~" else []
                # a longer chain ends below the first element that the combinator reaches
                for compound in inner.compounds:
                    if self.reaches(node, compound, combinator, near):
                        return True
            return False

        return found

    def reaches(self, node: Node, compound: Compound, combinator: str, near: list[Node]) -> bool:
        chain = [compound]
        while chain[-1].rest is not None:
            chain.append(chain[-1].rest)
        first, links = chain[-1], [c.combinator for c in chain[:-1]][::-1]
        here = [n for n in (x for x in node.walk() if x.kind == "element")] if combinator == " " else near
        here = [x for x in here if all(t(x) for t in first.tests)]
        for link, step in zip(links, chain[:-1][::-1]):
            nxt: list[Node] = []
            for x in here:
                nxt += [y for y in x.walk() if y.kind == "element"] if link == " " else x.elements() if link == ">" else after(x)[:1] if link == "+" else after(x)
            here = [x for x in nxt if all(t(x) for t in step.tests)]
        return bool(here)

    def nth(self, name: str, argument: str) -> Test:
        m = NTH.match(argument.strip())
        if not m or m["of"] and not name.endswith("child"):
            raise SelectorError(f":{name}({argument}) can't be read")
        if m["word"]:
            a, b = 2, int(m["word"].lower() == "odd")
        elif m["only"]:
            a, b = 0, int(m["only"])
        else:
            a = int(m["a"] + "1" if m["a"] in ("", "+", "-") else m["a"])
            b = int((m["sign"] or "") + (m["b"] or "0"))
        of = self.inner(m["of"]).match if m["of"] and m["of"].strip() else None
        last, by_type = "last" in name, name.endswith("of-type")

        def place(node: Node) -> bool:
            if of and not of(node):
                return False
            count = 1 + sum((not by_type or same_type(x, node)) and (of is None or of(x)) for x in (after(node) if last else before(node)))
            return count == b if a == 0 else (count - b) % a == 0 and (count - b) // a >= 0

        return place
