"""Pipelines, tasks, the checker and the sources on Spark."""

import os
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from glyphmill.functions import encodings
from glyphmill.functions.batches import PART, parts
from glyphmill.functions.globs import Matcher, PatternLimitError
from glyphmill.model import CHUNK, Filter, FlowControl
from glyphmill.operators import check, external, lines
from glyphmill.operators.plain import ContextFilter, TextFilter, UrlFilter
from glyphmill.plans import pipeline, tasks
from glyphmill.sources import files
from glyphmill.streaming.check_stream import misspelled_stream

WORDS = "yes word okay good here is a bad link line with title this some text and the no value"


@pytest.fixture(scope="module")
def known(spark):
    return spark.createDataFrame([(w,) for w in WORDS.split()], "word string")


def bad_words(results):
    return sorted({w for r in results.collect() for w in r.words})


def config(*matrix):
    return {"matrix": list(matrix)}


def test_globs(tmp_path):
    assert Matcher("a/**/*.py")("a/b/c/d.py") and Matcher("a/**/*.py")("a/d.py") and not Matcher("a/*.py")("a/b/d.py")
    assert Matcher("*.{py,js}|!x*", "N|B|G|S")("a.js") and not Matcher("*.{py,js}|!x*")("x.js")
    assert not Matcher("*")(".hidden") and Matcher("*", "D")(".hidden")
    assert Matcher("@(a|b)?.txt", "E")("b1.txt") and not Matcher("!(a|b)", "E")("a") and Matcher("!(a|b)", "E")("c")
    assert Matcher("file[0-2].t[!a]", "I")("FILE1.TX") and Matcher("f{1..3}.x", "B")("f2.x") and not Matcher("f{1..3}.x", "B")("f4.x")
    assert Matcher("*.py", "X")("deep/in/it.py") and Matcher("-a|*", "N|M")("b") and not Matcher("-a|*", "N|M")("a")
    with pytest.raises(PatternLimitError):
        Matcher("{1..20}", limit=10)
    Matcher("{1..2000}", limit=0)


def test_listing(tmp_path, monkeypatch):
    for name in ("a.txt", "b.md", "sub/c.txt", "sub/x.txt", ".h.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("x")
    assert files.listed([f"{tmp_path}/**/*.txt|!**/x.txt"]) == [f"{tmp_path}/a.txt", f"{tmp_path}/sub/c.txt"]
    monkeypatch.chdir(tmp_path)
    assert files.listed(["*.{txt,md}"]) == ["a.txt", "b.md"]
    assert files.listed(["sub/*.txt", "sub/c.*"]) == ["sub/c.txt", "sub/x.txt"]


def test_files_to_misspellings(spark, known, tmp_path):
    (tmp_path / "a.txt").write_bytes("helo yes\nbegn Word".encode("utf-16"))
    (tmp_path / "b b.txt").write_text("good flga http://x.example.com/yess me@mail.example.org")
    (tmp_path / "c.txt").write_text("   \n")
    task = {"name": "t", "sources": [f"{tmp_path}/*.txt"], "pipeline": ["text", "url"]}
    results = tasks.spellcheck(spark, config(task), dictionary=known)
    rows = {os.path.basename(r.src_id): r.words for r in results.collect()}
    assert rows == {"a.txt": ["begn", "helo"], "b b.txt": ["flga"]}
    text, failed = check.report(results.drop("task", "task_no"))
    assert failed and "<url-free>" in text and "begn\nhelo" in text
    assert check.report(results.where("false").drop("task", "task_no")) == ("Spelling check passed :)", False)


def test_python_then_context(spark, known, tmp_path):
    source = '#!/usr/bin/env python\n# -*- coding: utf-8 -*-\n"""helo"""\n# begn\n# ```\n# flga\n# ```\nx = 1\n'
    (tmp_path / "a.py").write_text(source)
    steps = [{"python": {"group_comments": True}}, {"wildcard": {"allow": ["py-comment"]}}, {"context": {"context_visible_first": True, "delimiters": [{"open": r"(?s)^ *```".replace("(?s)", ""), "close": "^ *```"}]}}]
    found = bad_words(tasks.spellcheck(spark, config({"sources": [f"{tmp_path}/*.py"], "pipeline": steps}), dictionary=known))
    assert {"helo", "begn"} <= set(found) and "flga" not in found


def test_markdown_html_chain(spark, known, tmp_path):
    (tmp_path / "a.md").write_text("# helo\n\nyes `flga` begn\n\n```\ngraet\n```\n")
    steps = [{"markdown": {"markdown_extensions": ["fenced_code"]}}, {"html": {"ignores": ["code", "pre"]}}]
    assert bad_words(tasks.spellcheck(spark, config({"sources": [f"{tmp_path}/*.md"], "pipeline": steps}), dictionary=known)) == ["begn", "helo"]


def test_tasks_are_chosen(spark):
    every = tasks.tasks(config({"name": "a", "group": "g"}, {"name": "b", "group": "h", "hidden": True}, {"name": "a", "group": "g", "sources": ["x"]}))
    assert [t.sources for t in tasks.chosen(every, ["a"])] == [["x"]]
    assert [t.name for t in tasks.chosen(every)] == ["a", "a"]
    assert [t.name for t in tasks.chosen(every, ["b"])] == ["b"]
    assert [t.name for t in tasks.chosen(every, groups=["g"])] == ["a", "a"]
    assert tasks.chosen(every, ["a"], sources=["y"])[0].sources == ["y"]
    assert [t.sources for t in tasks.chosen(every, ["a", "b"], sources=["y"])] == [[], ["x"]]
    with pytest.raises(ValueError):
        tasks.chosen(every, ["zz"])


def test_configuration_errors(spark, tmp_path):
    with pytest.raises(KeyError):
        tasks.spellcheck(spark, {})
    with pytest.raises(ValueError):
        tasks.spellcheck(spark, {"matrix": []})
    with pytest.raises(ValueError):
        pipeline.build([{"text": {}, "url": {}}])
    with pytest.raises(ValueError):
        pipeline.build(["wildcard", "text"])
    with pytest.raises(RuntimeError):
        tasks.spellcheck(spark, config({"sources": [f"{tmp_path}/none*"]}))
    assert tasks.spellcheck(spark, config({"sources": [f"{tmp_path}/none*"], "expect_match": False})).count() == 0
    with pytest.raises(ValueError):
        tasks.spellcheck(spark, config({"sources": ["x"]}), checker="ispell")
    with pytest.warns(DeprecationWarning):
        assert tasks.tasks({"documents": [{"filters": ["url"]}]})[0].pipeline == ["url"]
    with pytest.raises(Exception):
        tasks.load_yaml("a: !!python/name:os.system")
    (tmp_path / "c.yml").write_text("matrix:\n- name: x\n  sources: 'y'\n")
    assert tasks.tasks(tasks.read_config(str(tmp_path / "c.yml")))[0].sources == ["y"]
    assert [type(s).__name__ for s in pipeline.build(None) or []] == [] and len(pipeline.build([])) == 1


def test_no_pipeline_and_wordlists(spark, known, tmp_path):
    (tmp_path / "a.txt").write_text("helo yes begn")
    (tmp_path / "words").write_bytes(b"begn\r\nbegn\r\n\r\nhelo\n")
    task = {"sources": [f"{tmp_path}/a.txt"], "pipeline": None}
    rows = tasks.spellcheck(spark, config(task), dictionary=known).collect()
    assert [(r.category, r.words) for r in rows] == [("file", ["begn", "helo"])]
    listed = task | {"dictionary": {"wordlists": [str(tmp_path / "words")], "output": str(tmp_path / "out")}}
    assert bad_words(tasks.spellcheck(spark, config(listed), dictionary=known)) == []
    (tmp_path / "words").write_text("other")
    assert bad_words(tasks.spellcheck(spark, config(listed), dictionary=known, skip_dict_compile=True)) == []
    latin = tmp_path / "latin"
    latin.write_bytes("é".encode("latin-1"))
    assert [r.word for r in check.read_wordlists(spark, [str(latin)], "latin-1").collect()] == ["é"]


def chunks(spark, rows):
    return pipeline.chunks_of(spark.createDataFrame(rows, "id string, text string, kind string"), "id", "text", F.col("kind"))


def test_checker_cases(spark, known):
    df = chunks(spark, [("1", "Yes WORD wOrd helo helo", "a"), ("2", "good", "a"), ("3", " \n", "a"), ("4", None, "a"), (None, "helo", "a"), ("5", "don't ça", "a")])
    got = {r.src_id: r.words for r in check.check(df, known).collect()}
    assert got == {"1": ["helo", "wOrd"], "2": [], "5": ["don't", "ça"]}
    assert check.check(df.where("false"), known).count() == 0
    empty = spark.createDataFrame([], "word string")
    assert {r.src_id: r.words for r in check.check(df, empty).collect()}["2"] == ["good"]


def test_error_rows_pass_by(spark, known):
    df = chunks(spark, [("1", "<a", "text"), ("2", "<a>helo</a>", "text")])
    got = {r.src_id: (r.words, r.error is not None) for r in check.check(pipeline.apply(df, pipeline.build(["text", "xml", "url"])[1:], {"text"}), known).collect()}
    assert got == {"1": ([], True), "2": (["helo"], False)}


def test_flow_controls(spark):
    df = chunks(spark, [("1", "x", "one"), ("2", "x", "two"), ("3", "x", "three")])
    rules = {"wildcard": {"allow": ["one", "three"], "halt": ["three"]}}
    steps = pipeline.build(["text", rules, "url", "context"])[1:]
    for categories in ({"one", "two", "three"}, None):  # decided in the plan, and in the workers
        got = {r.src_id: (r.category, r.halted) for r in pipeline.apply(df, steps, categories).collect()}
        assert got == {"1": ("context", False), "2": ("context", False), "3": ("three", True)}
    last = pipeline.build(["text", {"wildcard": {"allow": ["*"], "halt": ["*"]}}, "wildcard", "url"])[1:]
    assert {r.category for r in pipeline.apply(df, last, {"one", "two", "three"}).collect()} == {"url-free"}


@pytest.mark.parametrize("step", [UrlFilter(), ContextFilter({"context_visible_first": True, "escapes": r"\\[`$]", "delimiters": [{"open": "`", "close": "`"}, {"open": r"(?P<m>\$+)", "close": "(?P=m)"}]})])
def test_columns_and_python_agree(spark, step):
    texts = ["a `b` c $$d$$ e \\`f\\` $g", "`x`", "`x` y", "", "mail a.b@c.example.org, http://x.example.com/a(b)c. end", "é_http://x.example.com", "www.example.com/é", "$a", "a\r\nb `c\r\nd` e", "a@b", "x-a@b.example.co"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    got = [r[0] for r in df.orderBy("i").select(step.column(df["text"])).collect()]
    assert got == [step.process(pipeline.Chunk(t, "f", "utf-8", "text"))[0].text for t in texts]


class Shout(Filter):
    def default_config(self):
        return {"mark": "!", "times": 1, "weight": 1.0, "on": True, "names": [], "map": {}}

    def process(self, chunk):
        return [chunk.but(text=chunk.text + self.config["mark"] * self.config["times"], category="shout")]


class Never(FlowControl):
    def adjust(self, category):
        return 1


def test_own_steps_and_option_types(spark):
    pipeline.register("shout", Shout)
    pipeline.register("never", Never)
    got = pipeline.build(["text", {"shout": {"times": 2.0, "weight": 3}}])[1]
    assert got.config["times"] == 2 and got.config["weight"] == 3.0
    for bad in ({"mark": 1}, {"times": 1.5}, {"times": True}, {"weight": "x"}, {"on": 1}, {"names": "x"}, {"map": []}):
        with pytest.raises(ValueError):
            Shout(bad)
    with pytest.raises(KeyError):
        Shout({"x": 1})
    with pytest.raises(ImportError):
        pipeline.build(["no_such_module_at_all"])


def test_external_commands():
    given = {"lang": "en", "W": 2, "run-together": True, "filters": ["a", "b"], "guess": True, "x": False}
    assert external.aspell("utf-8", given, "d") == ["aspell", "list", "--encoding", "utf-8", "--add-extra-dicts", "d", "--mode", "none", "--lang", "en", "-W", "2", "--run-together", "--filters", "a", "--filters", "b"]
    assert external.hunspell("utf-8", {"d": "en_US", "l": True}, "p", "f") == ["hunspell", "-l", "-i", "utf-8", "-p", "p", "-d", "en_US", "f"]
    parts = list(external.short_lines("aé " * 5000 + "\n" + "x" * 20000, "utf-8"))
    assert max(map(len, parts)) <= external.LINE and b"".join(parts).decode() == "aé " * 5000 + "x" * 20000
    assert external.safe_encoding("utf-16") == "utf-8"


def test_external_program(spark, tmp_path):
    program = tmp_path / "fake"
    program.write_text("#!/bin/sh\ncase \"$*\" in *fail*) echo broken; exit 3;; esac\ntr ' ' '\\n' | grep -v yes\nexit 0\n")
    program.chmod(0o755)
    df = chunks(spark, [("1", "helo yes begn", "a"), ("2", " ", "a")])
    got = external.check_by(df, "hunspell", {}, binary=str(program)).collect()
    assert [(r.src_id, r.words, r.error) for r in got] == [("1", ["begn", "helo"], None)]
    (row,) = external.check_by(df, "hunspell", {"d": "fail"}, binary=str(program)).collect()
    assert "broken" in row.error and row.words == []


FAKE = """#!/bin/sh
known=/dev/null; file=
while [ $# -gt 0 ]; do
  case "$1" in
    create) exec cat > "$3" ;;
    -p|--add-extra-dicts) known="$2"; shift ;;
    -i|--encoding|--mode|--lang) shift ;;
    list|-*) ;;
    *) file="$1" ;;
  esac
  shift
done
echo x >> "$COUNTER"
if [ "$known" != /dev/null ] && grep -q broken "$known"; then echo broken; exit 3; fi
if [ -n "$file" ]; then exec < "$file"; fi
grep -oE '[A-Za-z]+' | grep -vxF -f "$known"
exit 0
"""


@pytest.fixture
def fake(tmp_path):
    path = tmp_path / "fake"
    path.write_text(FAKE.replace("$COUNTER", str(tmp_path / "count")))
    path.chmod(0o755)
    return str(path)


def test_one_process_for_a_batch(spark, tmp_path, fake):
    df = chunks(spark, [(str(i), "yes helo\nbegn" if i % 3 else "yes", "a") for i in range(50)]).coalesce(1)
    own = external.compile_words(spark.createDataFrame([("yes",)], "word string"), "aspell", str(tmp_path / "out" / "d.dic"), binary=fake)
    assert open(own).read() == "yes\n"
    got = {r.src_id: r.words for r in external.check_by(df, "aspell", {}, own, fake).collect()}
    assert got == {str(i): ["begn", "helo"] if i % 3 else [] for i in range(50)}
    assert len((tmp_path / "count").read_text().split()) == 1
    broken = tmp_path / "broken"
    broken.write_text("broken\n")
    rows = external.check_by(df.limit(2), "hunspell", {}, str(broken), fake).collect()
    assert len(rows) == 2 and all("broken" in r.error for r in rows)


def test_answers_that_cannot_be_told_apart(tmp_path, fake):
    assert external.ask_all([fake, "list"], [[b"one two"], [], [b"three"]], "utf-8") == [["one", "two"], [], ["three"]]

    assert external.ask_all(["true"], [[b"a"], [b"b"]], "utf-8") is None
    assert external.ask_all(["false"], [[b"a"], [b"b"]], "utf-8") is None


@pytest.mark.parametrize("program", ["aspell", "hunspell"])
def test_program_without_a_pipeline(spark, tmp_path, fake, program):
    (tmp_path / "in.txt").write_text("helo yes begn")
    (tmp_path / "words").write_text("yes\r\nyes\n\n")
    task = {"name": "t", "sources": [f"{tmp_path}/in.txt"], "pipeline": None, "dictionary": {"wordlists": [str(tmp_path / "words")], "output": str(tmp_path / "made.dic")}}
    (row,) = tasks.spellcheck(spark, config(task), checker=program, binary=fake).collect()
    assert (row.category, row.words, row.error) == ("file", ["begn", "helo"], None) and (tmp_path / "made.dic").read_text() == "yes\n"
    (tmp_path / "made.dic").write_text("helo\n")
    (row,) = tasks.spellcheck(spark, config(task), checker=program, binary=fake, skip_dict_compile=True).collect()
    assert row.words == ["begn", "yes"]
    (row,) = tasks.spellcheck(spark, config(task | {"pipeline": ["text"]}), checker=program, binary=fake).collect()
    assert row.words == ["begn", "helo"]


def test_a_chunk_is_computed_once(spark, known):
    df = pipeline.apply(chunks(spark, [("1", "<p>helo</p>", "text")]), pipeline.build(["text", "html"])[1:], {"text"})
    plan = check.check(df, known)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and plan.count("BroadcastHashJoin") == 2 and plan.count("Exchange hashpartitioning") == 1


def test_verbose(spark, known, tmp_path, capsys):
    (tmp_path / "a.txt").write_text("yes")
    task = {"name": "mine", "sources": [f"{tmp_path}/*.txt"], "pipeline": ["text"]}
    for level, told in ((0, []), (1, ["mine"]), (3, ["mine", "*.txt", "Pipeline"])):
        tasks.spellcheck(spark, config(task), dictionary=known, verbose=level)
        said = capsys.readouterr().err
        assert all(x in said for x in told) and ("Running" in said) == bool(level)


def test_large_and_small_dictionaries_agree(spark, known, monkeypatch):
    df = chunks(spark, [("1", "Yes WORD wOrd helo helo", "a"), ("2", "good", "a"), ("3", " ", "a"), ("4", "", "a")])
    small = sorted(check.check(df, known).collect())
    monkeypatch.setattr(check, "sized", lambda d: d.select(F.col("word").alias("_known_")))
    assert sorted(check.check(df, known).collect()) == small


def test_wildcards_as_expressions(spark):
    names = ["one", "Two", "src12", "a/b", "x-y", "", "été", "a.b", "/x"]
    df = spark.createDataFrame([(n,) for n in names], "c string")
    for rules in ({"allow": ["o*", "t?o"], "skip": ["one"]}, {"allow": ["src{1..12}|!*"], "halt": ["*"]}, {"allow": ["[a-x]*", "é*"], "halt": ["*[.]*"], "skip": ["x-?"]}, {"allow": ["*|!o*|!/x"]}):
        control = pipeline.build(["text", {"wildcard": rules}])[1]
        allowed, halted = control.columns(F.col("c"))
        got = {r.c: (r.a, r.h) for r in df.select("c", allowed.alias("a"), halted.alias("h")).collect()}
        assert got == {n: (control.adjust(n) == 0, control.adjust(n) == 2) for n in names}, rules


def test_grouped_comments(spark):
    text = "// a\n// b\n  // c\nx // d\n// e\n// f"
    df = spark.createDataFrame([(1, text), (2, "")], "id int, text string")
    got = lines.grouped_comments(lines.lines(df, "id", df["text"]), "id").orderBy("line").collect()
    assert [(r.line, r.n_lines, r.comment) for r in got] == [(1, 2, " a\n b"), (3, 1, " c"), (5, 2, " e\n f")]


def test_stream(spark, known, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("helo yes Word helo")
    stream = misspelled_stream(files.stream(spark, str(tmp_path / "in"), "*.txt"), pipeline.build(["text", "url"]), known)
    q = stream.writeStream.format("memory").queryName("misspelled").option("checkpointLocation", str(tmp_path / "state")).start()
    try:
        q.processAllAvailable()
        (tmp_path / "in" / "b.txt").write_text("begn")
        q.processAllAvailable()
        assert sorted(r.word for r in spark.table("misspelled").collect()) == ["begn", "helo"]
    finally:
        q.stop()


def test_a_large_dictionary_is_not_broadcast(spark, known):
    assert "broadcast" in check.sized(known)._jdf.queryExecution().toString().lower()
    assert "broadcast" not in check.sized(known, 10)._jdf.queryExecution().toString().lower()


def test_rows_of_a_batch_are_taken_by_their_bytes():
    """What a worker makes of a batch leaves it in parts, however many rows the batch has."""
    text, n = "let a = '" + "x" * 10_000 + "';", 500
    row = {"src_id": "1", "path": [0], "text": text, "raw": None, "context": "f", "encoding": "utf-8", "category": "text", "error": None, "halted": False}
    batch = pa.RecordBatch.from_pylist([row] * n, pipeline.to_arrow_schema(CHUNK))
    steps = pipeline.guard(pipeline.build(["text", {"javascript": {"strings": True}}])[1:])
    made = list(pipeline.python_steps(steps)(iter([batch])))
    assert sum(len(b) for b in made) == n and max(b.nbytes for b in made) < 1.2 * PART
    texts = pa.RecordBatch.from_arrays([pa.array(["a" * (3 * PART), None, "b", "c" * PART, ""])], ["text"])
    assert [len(p) for p in parts(texts, 0)] == [1, 2, 1, 1]


def test_lines_of_a_program_are_not_held(tmp_path):
    """Of what a program prints for a file only the distinct lines come to memory."""
    command = ["awk", "BEGIN { for (i = 0; i < 400000; i++) print i % 7 ? \"word\" : \"other\\r\" }"]
    peaks = []
    for run in (external.ask, external.ask_distinct):
        tracemalloc.start()
        assert sorted(set(run(command, None))) == ["other", "word"]
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < 1 << 20 < peaks[0]
    assert external.ask_distinct(["cat"], b"b\na\n\nb") == ["a", "b"]
    with pytest.raises(RuntimeError, match="no such"):
        external.ask_distinct(["sh", "-c", "echo no such; exit 3"], None)


def test_text_files_in_the_jvm(spark):
    """Files in UTF-8 don't come to Python; what it makes of all others is the same."""
    raws = [b"plain", "é ü\r\n".encode(), b"", None, b"\xef\xbb\xbfmark", "ä".encode("utf-16"), b"\xff\xfa\xfb", "x\ud800".encode("utf-8", "surrogatepass"), b"\x00"]
    found = spark.createDataFrame([(str(i), f"c{i}", raw) for i, raw in enumerate(raws)], "src_id string, context string, raw binary")
    chunks = pipeline.first(found, TextFilter())
    assert "MapInArrow" not in chunks._jdf.queryExecution().toString()
    got = {r.src_id: (r.text, r.context, r.encoding, r.category, r.error) for r in chunks.collect()}
    want = {str(i): encodings.read(raw, f"c{i}", TextFilter())[0] for i, raw in enumerate(raws) if raw is not None}
    assert got == {k: (c.text, c.context, c.encoding, c.category, c.error) for k, c in want.items()}


def test_expressions_of_filters_are_computed_once(spark):
    """The plan of a check has the links' pattern once for each use that the filter makes of it, not again for blank texts and for words."""
    chunks = pipeline.chunks_of(spark.createDataFrame([(1, "see www.a.org now"), (2, " "), (3, "www.a.org")], "id long, text string"), "id", "text")
    plain = pipeline.apply(chunks, pipeline.build(["text", {"url": {"emails": False}}])[1:], {"text"})
    times = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("https?|ftps?")
    results = check.check(plain, spark.createDataFrame([("see",)], "word string"))
    assert times(results) == times(plain)
    assert {r.src_id: r.words for r in results.collect()} == {"1": ["now"]}
