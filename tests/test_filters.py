"""Filters on strings, without Spark."""

import io
import zipfile

import pytest

from glyphmill.functions import encodings
from glyphmill.model import ALLOW, HALT, SKIP, Chunk, Filter
from glyphmill.operators.markdown import MarkdownFilter
from glyphmill.operators.markup import OASIS, HtmlFilter, OdfFilter, OoxmlFilter, XmlFilter
from glyphmill.operators.plain import ContextFilter, TextFilter, UrlFilter, WildcardControl
from glyphmill.operators.python_source import PythonFilter
from glyphmill.operators.selectors import Selector, SelectorError
from glyphmill.operators.source_code import CppFilter, JavaScriptFilter, StylesheetsFilter
from glyphmill.operators.tree import XHTML, parse_html, parse_xml


def made(step: Filter, text, **changes):
    return step.process(Chunk(text, "f", "utf-8", "text").but(**changes))


def pairs(step: Filter, text):
    return [(c.category, c.text) for c in made(step, text)]


def contexts(step: Filter, text):
    return [c.context for c in made(step, text)]


# ---- plain


def test_text_normal_form_and_conversion():
    assert made(TextFilter({"normalize": "nfd"}), "é")[0].text == "e\u0301"
    got = made(TextFilter({"convert_encoding": "ascii", "errors": "backslashreplace"}), "é")[0]
    assert (got.text, got.encoding) == ("\\xe9", "ascii")
    with pytest.raises(ValueError):
        TextFilter({"normalize": "nfx"})
    with pytest.raises(ValueError):
        TextFilter({"errors": "xmlcharrefreplace"})
    with pytest.raises(KeyError):
        TextFilter({"nothing": 1})


def test_url():
    text = "see https://a.example.com/x?y=1#z and (www.b.example.org/path) or c.d+e@mail.example.com, ok"
    assert made(UrlFilter(), text)[0].text == "see  and () or , ok"
    assert "c.d+e@mail.example.com" in made(UrlFilter({"emails": False}), text)[0].text
    assert "https://" in made(UrlFilter({"urls": False}), text)[0].text


FENCES = {"context_visible_first": True, "escapes": r"\\[\\`]", "delimiters": [{"open": "^(?P<mark> *```+)$", "close": "^(?P=mark)$"}, {"open": "(?P<open>`+)", "close": "(?P=open)"}]}


def test_context_visible_first():
    text = "aaaa\n```\nbbbb\n```\ncccc `dddd` eeee \\`ffff\\`"
    assert made(ContextFilter(FENCES), text)[0].text.split() == ["aaaa", "cccc", "eeee", "\\`ffff\\`"]


def test_context_inside_and_unclosed():
    step = ContextFilter({"delimiters": [{"open": r"\$", "close": r"\$"}]})
    assert made(step, "a $b$ c $d")[0].text == "b d"
    with pytest.raises(ValueError):
        ContextFilter({"delimiters": [{"open": "a?", "close": "a?"}]})
    with pytest.raises(ValueError):
        ContextFilter({"delimiters": [{"close": "a"}]})


@pytest.mark.parametrize("category, expected", [("py-comment", ALLOW), ("py-docstring", SKIP), ("PY-STRING", HALT), ("cpp-comment", SKIP)])
def test_wildcard(category, expected):
    assert WildcardControl({"allow": ["py-*"], "skip": ["*doc*"], "halt": ["py-{string,docs}"]}).adjust(category) == expected


def test_wildcard_negation_and_default():
    assert WildcardControl().adjust("anything") == ALLOW
    step = WildcardControl({"allow": ["*|!html*"]})
    assert (step.adjust("htmlcontent"), step.adjust("text")) == (SKIP, ALLOW)


# ---- encodings


def test_marks_and_heads():
    assert encodings.from_mark("\ufeffa".encode("utf-32-le")) == "utf-32"
    assert encodings.from_mark("\ufeffa".encode("utf-16-le")) == "utf-16"
    assert encodings.source_cookie(b"#!/usr/bin/python\n# -*- coding: latin-1 -*-\n") == "latin-1"
    assert encodings.source_cookie(b"a\nb\n# coding: latin-1\n") == "utf-8"
    assert encodings.html_meta(b"<html><META http-equiv=x content='text/html; charset=iso-8859-1'>") == "iso-8859-1"
    assert encodings.html_meta(b"<?xml version='1.0' encoding='utf-8'?><a/>") == "utf-8"
    for codec in ("ascii", "utf-16-le", "utf-16-be", "utf-32-le", "utf-32-be"):
        assert encodings.xml_declaration('<?xml version="1.0" encoding="latin-1"?><a/>'.encode(codec)) == "latin-1"


@pytest.mark.parametrize("codec", ["utf-8", "utf-8-sig", "utf-16", "utf-32"])
def test_reading_files(codec):
    (chunk,) = encodings.read("helo\r\nbegn".encode(codec), "f", TextFilter())
    assert (chunk.text, chunk.error) == ("helo\r\nbegn", None)


def test_fallback_to_the_default_encoding_and_errors():
    (chunk,) = encodings.read("é".encode("latin-1"), "f", TextFilter(default_encoding="latin-1"))
    assert chunk.text == "é"
    (chunk,) = encodings.read(b"\xff\xfa", "f", TextFilter())
    assert chunk.error and "UnicodeDecodeError" in chunk.error
    (chunk,) = encodings.read(b"", "f", TextFilter())
    assert (chunk.text, chunk.encoding) == ("", "ascii")


def test_categories_are_checked():
    with pytest.raises(ValueError):
        Chunk("a", "f", "utf-8", "not good")
    assert Chunk("a", "f", "X-SJIS", "a").encoding == "shift_jis"
    assert Chunk("a", "f", "", "a", "an error").encoding == ""


# ---- source code

CPP = """// aaaa
  // bbbb
  // cccc
int x; // dddd \\
eeee
/* ffff
   gggg */
auto s = "hhhh" L"iiii" u8"jjjj" u"kkkk" U"llll" R"x(mmmm)x" 'n';
"""


def test_cpp_comments():
    got = pairs(CppFilter(), CPP)
    assert [t.split() for c, t in got if c == "cpp-block-comment"] == [["ffff", "gggg"]]
    assert [t.strip() for c, t in got if c == "cpp-line-comment"] == ["aaaa", "bbbb", "cccc", "dddd eeee"]
    grouped = [t for c, t in pairs(CppFilter({"group_comments": True}), CPP) if c == "cpp-line-comment"]
    assert [t.split() for t in grouped] == [["aaaa"], ["bbbb", "cccc"], ["dddd", "eeee"]]
    generic = [t.strip() for c, t in pairs(CppFilter({"generic_mode": True, "prefix": ""}), CPP) if c == "line-comment"]
    assert generic == ["aaaa", "bbbb", "cccc", "dddd \\"]
    assert contexts(CppFilter(), CPP)[0] == "f (6)"


@pytest.mark.parametrize("types, expected", [("sul", "hijkl"), ("*", "hijklm"), ("s", "h"), ("u", "jkl"), ("l", "i"), ("rs", "hm"), ("r*", "m")])
def test_cpp_string_types(types, expected):
    got = pairs(CppFilter({"strings": True, "block_comments": False, "line_comments": False, "string_types": types}), CPP)
    assert [t for _, t in got] == [c * 4 for c in expected]


def test_cpp_escapes_and_trigraphs():
    step = CppFilter({"strings": True})
    assert [t for _, t in pairs(step, r'"\x61\x62 \141\142 \u00e9 \"q\" a\tb" u8"\x41\u00e9" L"\x61"')] == ['ab ab é "q" a\tb', "Aé", "a"]
    assert [t for _, t in pairs(CppFilter({"strings": True, "decode_escapes": False}), r'"\x61"')] == [r"\x61"]
    assert [t for _, t in pairs(CppFilter({"trigraphs": True}), "// a ??/\nb")] == ["a b"]
    for bad in ({"string_types": "x"}, {"charset_size": 3}, {"wide_charset_size": 1}):
        with pytest.raises(ValueError):
            CppFilter(bad)


def test_cpp_ignores_comment_marks_in_strings():
    assert [t.strip() for _, t in pairs(CppFilter(), 'x = "/* no */ // no"; \'"\' // yes')] == ["yes"]


def test_stylesheets():
    text = "a { } /* aaaa */\n// bbbb\n// cccc\nb: url(http://x/y) // dddd\n"
    assert [(c, t.strip()) for c, t in pairs(StylesheetsFilter(), text)] == [("css-block-comment", "aaaa")]
    got = pairs(StylesheetsFilter({"stylesheets": "scss", "group_comments": True}), text)
    assert [(c, t.split()) for c, t in got] == [("scss-block-comment", ["aaaa"]), ("scss-line-comment", ["bbbb", "cccc"]), ("scss-line-comment", ["dddd"])]
    with pytest.raises(ValueError):
        StylesheetsFilter({"stylesheets": "less"})


JS = """/**
 * aaaa
 * bbbb
 */
/* cccc */
// dddd
  // eeee
let x = 'ffff // no' + "gg\\u0067g" + `hhhh ${call({a: `iiii`})} jjjj`; // kkkk
"""


def test_javascript():
    got = pairs(JavaScriptFilter({"jsdocs": True, "strings": True}), JS)
    assert [(c, t.split()) for c, t in got] == [
        ("js-block-comment", ["cccc"]),
        ("js-line-comment", ["dddd"]),
        ("js-line-comment", ["eeee"]),
        ("js-line-comment", ["kkkk"]),
        ("js-docs", ["aaaa", "bbbb"]),
        ("js-strings", ["ffff", "//", "no"]),
        ("js-strings", ["gggg"]),
        ("js-strings", ["iiii"]),
        ("js-strings", ["hhhh", "jjjj"]),
    ]
    plain = pairs(JavaScriptFilter(), JS)
    assert [c for c, _ in plain] == ["js-block-comment"] * 2 + ["js-line-comment"] * 3


def test_javascript_escapes_and_unclosed_template():
    step = JavaScriptFilter({"strings": True})
    assert [t for _, t in pairs(step, r"'\101\x41\u{41}\q' '\400' '\ud83d\ude00'")] == ["AAAq", "0", "😀"]
    assert [t for _, t in pairs(step, "`open` + 'x' + `lost ${a")] == ["open", "x"]


PY = '''#!/usr/bin/env python
"""aaaa"""
import x  # bbbb


# cccc
# dddd
class A:
    """eeee"""

    def f(self):
        "ffff"
        s = "gggg" + b"hhhh".decode() + f"iiii {x} jjjj" + r"kk\\q"
        return s

    def one(self): "llll"


def g():
    x = """mmmm"""
'''


def test_python_docstrings_and_comments():
    got = pairs(PythonFilter(), PY)
    assert [t for c, t in got if c == "py-docstring"] == ["aaaa", "eeee", "ffff"]
    assert [t.strip() for c, t in got if c == "py-comment"] == ["!/usr/bin/env python", "bbbb", "cccc", "dddd"]
    where = [c.context for c in made(PythonFilter(), PY) if c.category == "py-docstring"]
    assert where == ["f(2): ", "f(9): A", "f(12): A.f()"]
    grouped = [t.split() for c, t in pairs(PythonFilter({"group_comments": True}), PY) if c == "py-comment"]
    assert grouped[-1] == ["cccc", "dddd"]


@pytest.mark.parametrize("types, expected", [("ftu", {"gggg", "iiii", "jjjj", "llll", "mmmm"}), ("b", {"hhhh"}), ("u", {"gggg", "llll", "mmmm"}), ("ur", {"gggg", "kk\\q", "llll", "mmmm"}), ("r*", {"kk\\q"}), ("*", set("hhhh gggg jjjj iiii mmmm llll kk\\q".split()))])
def test_python_strings(types, expected):
    got = pairs(PythonFilter({"strings": True, "comments": False, "docstrings": False, "string_types": types}), PY)
    assert {w for _, t in got for w in t.split()} == expected


def test_python_escapes():
    step = PythonFilter({"strings": True, "string_types": "*"})
    text = 'x = ["\\x61\\u0062\\143\\N{LATIN SMALL LETTER D}", b"e\\x66\\x00g", r"\\x61"]\n'
    assert [t for _, t in pairs(step, text)] == ["abcd", "ef\ng", "\\x61"]
    with pytest.raises(ValueError):
        PythonFilter({"string_types": "z"})


# ---- markup

PAGE = """<!DOCTYPE html><html><head><title>tttt</title><style>p {}</style><script>var x = "</p>";</script></head>
<body><!-- aaaa --><p>bbbb <b>cccc</b> dddd<p>eeee<code>ffff</code></p>
<img src="x" alt="gggg"><div class="skip one" id="d">hhhh <!-- iiii --> <span>jjjj</span></div>
<ol><li>kkkk<p>llll</p></li></ol><pre>mmmm</pre></body></html>"""


def test_html():
    step = HtmlFilter({"attributes": ["alt"], "ignores": ["pre", ":is(code, .skip)"]})
    got = pairs(step, PAGE)
    assert [c for c, _ in got] == ["htmlcomment"] * 2 + ["htmlattribute"] + ["htmlcontent"] * 5
    assert [t for _, t in got] == ["aaaa", "iiii", "gggg", "tttt", "bbbb cccc dddd", "eeee", "kkkk", "llll"]
    where = contexts(step, PAGE)
    assert where[2] == "f: html>body>img[alt]"
    assert where[-2:] == ["f: html>body>ol>li", "f: html>body>ol>li>p"]
    assert where[0].endswith("<!--comment-->")
    assert contexts(HtmlFilter({"comments": False, "captures": ["div"]}), PAGE) == ["f: html>body>div#d.skip.one"]


def test_html_modes():
    assert {c for c, _ in pairs(HtmlFilter({"mode": "html5"}), PAGE)} == {"html5comment", "html5content"}
    xhtml = f'<?xml version="1.0"?><html xmlns="{XHTML}"><body><p>a &nbsp;b</p><pre>no<!-- xxxx --></pre></body></html>'
    got = pairs(HtmlFilter({"mode": "xhtml", "ignores": ["pre"]}), xhtml)
    assert got[0] == ("xhtmlcomment", "xxxx") and got[1][1].split() == ["a", "b"]
    with pytest.raises(ValueError):
        HtmlFilter({"mode": "sgml"})


def test_names_without_semicolon():
    page = '<p>x &amp y&amp;&am</p><!-- &amp &lt; --><p>&#38 &copy;&notit; &copyx &nope;</p><i title="a&ampb&lt;"></i><script>a&ampb</script>'
    step = lambda mode: pairs(HtmlFilter({"mode": mode, "attributes": ["title"]}), page)
    assert [t for _, t in step("html")] == ["&amp &lt;", "a&ampb<", "x &amp y&&am", "& ©&notit; &copyx &nope;"]
    assert [t for _, t in step("html5")][2:] == ["x & y&&am", "& ©¬it; ©x &nope;"]


DOM = """<html><body><div id="a" class="one two" lang="en-GB" data-x="v w"><p id="p1">x</p><p id="p2"></p><span id="s"><b id="b"></b></span><p id="p3">z</p></div><div id="e"> </div>"""


@pytest.mark.parametrize(
    "selector, expected",
    [
        ("p", "p1 p2 p3"),
        ("#p2, span", "p2 s"),
        (".one.two", "a"),
        ("[lang|=en]", "a"),
        ("[data-x~=w]", "a"),
        ("[id^=p]", "p1 p2 p3"),
        ("[id$='3']", "p3"),
        ('[id*="p"]', "p1 p2 p3"),
        ("[data-x='V W' i]", "a"),
        ("div p", "p1 p2 p3"),
        ("div > b", ""),
        ("p + p", "p2"),
        ("p ~ p", "p2 p3"),
        ("span + p", "p3"),
        (":is(b, span)", "s b"),
        ("div :not(p, b)", "s"),
        ("p:not(:empty)", "p1 p3"),
        ("div:has(> span b)", "a"),
        ("p:has(+ span)", "p2"),
        ("span:has(p, b)", "s"),
        ("p:first-child", "p1"),
        ("p:last-child", "p3"),
        ("b:only-child", "b"),
        ("span:only-of-type", "s"),
        ("p:first-of-type", "p1"),
        ("p:last-of-type", "p3"),
        ("p:nth-child(2n+1)", "p1"),
        ("p:nth-child(even)", "p2 p3"),
        ("p:nth-of-type(odd)", "p1 p3"),
        ("p:nth-last-child(1)", "p3"),
        ("p:nth-last-of-type(-n+2)", "p2 p3"),
        (":nth-child(2 of p)", "p2"),
        ("div:empty", "e"),
        ("p:-soup-contains('z')", "p3"),
        ("div:lang(en)", "a"),
        (r"#\70 1", "p1"),
    ],
)
def test_selectors(selector, expected):
    s = Selector(selector, html=True)
    found = [n.attribute("id") for n in parse_html(DOM).walk() if n.kind == "element" and s.match(n)]
    assert [x for x in found if x] == expected.split()


def test_selector_root_and_errors():
    s = Selector(":root")
    assert [n.name for n in parse_html(DOM).walk() if n.kind == "element" and s.match(n)] == ["html"]
    for bad in ("p >", "::before", ":nope", "[a", ":nth-child(x)", ""):
        with pytest.raises(SelectorError):
            Selector(bad)


NAMESPACES = '<r xmlns="urn:d" xmlns:f="urn:f" xmlns:b="urn:b"><head>aaaa</head><f:title>bbbb</f:title><b:e1>cccc</b:e1><x xmlns="">dddd</x></r>'


@pytest.mark.parametrize(
    "selector, spaces, expected",
    [("foo|title", {"foo": "urn:f"}, "bbbb"), ("bar|*", {"bar": "urn:b"}, "cccc"), ("|x", {}, "dddd"), ("*|e1", {}, "cccc"), ("head", {}, "aaaa"), ("head", {"": "urn:f"}, ""), ("title", {"": "urn:f"}, "bbbb"), (":root > head", {}, "aaaa")],
)
def test_xml_namespaces(selector, spaces, expected):
    got = made(XmlFilter({"captures": [selector], "namespaces": spaces}), NAMESPACES)
    assert " ".join(c.text for c in got) == expected


def test_xml():
    step = XmlFilter({"attributes": ["a"], "break_tags": ["q"], "ignores": ["no"]})
    got = pairs(step, '<?xml version="1.0" encoding="latin-1"?><r a="x"><q>aaaa</q><no a="y">bbbb<!-- cccc --></no>dddd<![CDATA[eeee]]></r>')
    assert got == [("xmlcomment", "cccc"), ("xmlattribute", "x"), ("xmlcontent", "dddd"), ("xmlcontent", "aaaa")]
    with pytest.raises(ValueError):
        made(step, "<r>")
    (chunk,) = encodings.read('<?xml version="1.0" encoding="utf-16"?><r>é</r>'.encode("utf-16"), "f", XmlFilter())
    assert chunk.text == "é"


def test_long_text_nodes_stay_whole():
    text = "word " * 5000
    assert made(XmlFilter(), f"<r>{text}</r>")[0].text == text.strip()


def zipped(members: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in members.items():
            z.writestr(name, text)
    return out.getvalue()


ODF = " ".join(f'xmlns:{x}="{OASIS}:{y}:1.0"' for x, y in (("office", "office"), ("text", "text"), ("draw", "drawing")))


@pytest.mark.parametrize("kind, short", [("text", "odt"), ("spreadsheet", "ods"), ("presentation", "odp")])
def test_odf(kind, short):
    content = f"<office:doc {ODF}><draw:page><text:p>tihs smoe</text:p></draw:page><draw:page><text:p>txet</text:p></draw:page></office:doc>"
    raw = zipped({"mimetype": f"application/vnd.oasis.opendocument.{kind}", "content.xml": content, "styles.xml": "<no/>"})
    got = encodings.read(raw, "f", OdfFilter())
    assert {c.category for c in got} == {short + "content"}
    assert " ".join(c.text for c in got).split() == ["tihs", "smoe", "txet"]
    if kind == "presentation":
        assert [c.context.split(": ")[1] for c in got] == ["slide1", "slide2"]


def test_flat_odf_and_chained():
    flat = f'<?xml version="1.0"?><office:document {ODF} office:mimetype="{OdfFilter.MIME}text"><office:meta>no</office:meta><office:body><text:p>tihs</text:p></office:body></office:document>'
    assert [c.text for c in encodings.read(flat.encode(), "f", OdfFilter())] == ["tihs"]
    raw = zipped({"mimetype": "application/vnd.oasis.opendocument.text", "content.xml": f"<a {ODF}><text:p>txet</text:p></a>"})
    assert [c.text for c in OdfFilter().process(Chunk(raw.decode("latin-1"), "f", "latin-1", "text"))] == ["txet"]


def test_ooxml():
    types = lambda part: f'<Types><Override PartName="{part}"/></Types>'
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    raw = zipped({"[Content_Types].xml": types("/word/document.xml"), "word/document.xml": f"<w:d {w}><w:t>tihs</w:t><w:x>no</w:x></w:d>", "word/header1.xml": f"<w:d {w}><w:t>smoe</w:t></w:d>", "word/styles.xml": "<no/>"})
    got = encodings.read(raw, "f", OoxmlFilter())
    assert [(c.category, c.text) for c in got] == [("docxcontent", "tihs"), ("docxcontent", "smoe")]
    assert got[1].context.startswith("f: header1: ")
    a = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"'
    raw = zipped({"[Content_Types].xml": types("/ppt/presentation.xml"), **{f"ppt/slides/slide{k}.xml": f"<a:d {a}><a:t>s{k}</a:t></a:d>" for k in (2, 10, 1)}})
    assert [c.text for c in encodings.read(raw, "f", OoxmlFilter())] == ["s1", "s2", "s10"]
    raw = zipped({"[Content_Types].xml": types("/xl/workbook.xml"), "xl/sharedStrings.xml": "<sst><si><t>txet</t></si></sst>"})
    assert [(c.category, c.text) for c in encodings.read(raw, "f", OoxmlFilter())] == [("xlsxcontent", "txet")]
    (bad,) = encodings.read(zipped({"[Content_Types].xml": types("/other/x.xml")}), "f", OoxmlFilter())
    assert bad.error


MD = """Title aaaa
==========

Some *text* with `cccc` and [link](http://x "dddd") and ![eeee](y).

- one
- two

    ffff

```python
gggg
```

> quoted <span>hhhh</span>

| a | b |
|---|---|
| c | d |

1. x
2. y
"""


def test_markdown():
    step = MarkdownFilter({"markdown_extensions": ["fenced_code", "tables", {"markdown.extensions.toc": {"x": 1}}]})
    html = made(step, MD)[0].text
    for part in ("<h1>Title aaaa</h1>", "<em>text</em>", "<code>cccc</code>", 'title="dddd"', 'alt="eeee"', "<li><p>one</p></li>", "<pre><code>gggg", "<blockquote>", "<span>hhhh</span>", "<td>c</td>", "<ol>"):
        assert part in html, part
    words = " ".join(t for c, t in pairs(HtmlFilter({"ignores": ["code", "pre"]}), html)).split()
    assert "gggg" not in words and "cccc" not in words and "hhhh" in words and "link" in words
    with pytest.raises(ValueError):
        MarkdownFilter({"markdown_extensions": ["no_such"]})


def test_every_filter_takes_empty_and_long_texts():
    long_ = "word 'x' \"y\" `z` /* c */ // d # e\n" * 2000
    for step in (TextFilter(), UrlFilter(), ContextFilter(FENCES), MarkdownFilter(), HtmlFilter(), CppFilter({"strings": True}), JavaScriptFilter({"strings": True}), StylesheetsFilter()):
        made(step, "")
        made(step, long_)
    assert made(PythonFilter(), "") == []
    assert parse_html("").children[-1].name == "html"
    with pytest.raises(ValueError):
        parse_xml("")


def test_markdown_footnotes():
    text = "One[^a] and two[^long].\n\n[^a]: Note *aaaa*\n    goes on\n\n[^long]:\n    First bbbb\n\n    Second cccc\n\nAfter dddd[^none]\n"
    html = made(MarkdownFilter({"markdown_extensions": ["footnotes"]}), text)[0].text
    assert html.index("dddd[^none]") < html.index('<div class="footnote">') < html.index("<em>aaaa</em>") < html.index("Second cccc")
    assert '<sup id="fnref:a"><a class="footnote-ref" href="#fn:a">1</a></sup>' in html and "One<sup" in html and "goes on&#160;<a" in html and "[^a]:" not in html
    plain = made(MarkdownFilter(), text)[0].text
    assert "[^a]" in plain and "footnote" not in plain


def test_markdown_descriptions():
    text = "Intro aaaa\n\nTerm bbbb\n:   What it *is*\n    and more\n\nTwo\nTerms\n\n:   Loose cccc\n\n:   Again\n\n    with dddd\n\nEnd: of it\n"
    html = made(MarkdownFilter({"markdown_extensions": ["def_list"]}), text)[0].text
    assert "<dl>\n<dt>Term bbbb</dt>\n<dd>What it <em>is</em>\nand more</dd>" in html
    assert "<dt>Two</dt>\n<dt>Terms</dt>\n<dd><p>Loose cccc</p></dd>" in html and "<p>with dddd</p></dd>\n</dl>" in html and html.endswith("<p>End: of it</p>")
    assert "<dl>" not in made(MarkdownFilter(), text)[0].text
