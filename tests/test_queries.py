"""Every query against its SQL at the smallest size, and those without SQL against plain Python."""

import glob
import os

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from glyphmill.model import Chunk
from glyphmill.operators.markup import HtmlFilter
from glyphmill.plans import catalogue

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_sql_agrees(spark, duck, name):
    df = catalogue.queries()[name](spark, SF)
    names = sorted(df.columns)
    got = sorted(map(repr, (tuple(r[c] for c in names) for r in df.collect())))
    rel = duck.sql(catalogue.oracle_sql()[name])
    assert sorted(rel.columns) == names
    at = [rel.columns.index(c) for c in names]
    assert got == sorted(map(repr, (tuple(r[i] for i in at) for r in rel.fetchall())))


def column(name, key, value):
    t = pq.read_table(f"{SF}/{name}.parquet")
    return dict(zip(t[key].to_pylist(), t[value].to_pylist()))


@pytest.mark.parametrize("name, options", [("html_blocks", {}), ("html_ignores_selector", {"ignores": ["nav", "h1", ".ad", "title", "footer"]})])
def test_html_queries(spark, name, options):
    got = {r.page_id: r.texts for r in catalogue.queries()[name](spark, SF).collect()}
    step = HtmlFilter({"comments": False} | options)
    for page, html in column("pages", "page_id", "html").items():
        assert got[page] == "\n".join(c.text for c in step.process(Chunk(html, "f", "utf-8", "text")))


def test_ooxml_query(spark):
    got = {r.doc_id: r.text for r in catalogue.queries()["ooxml_text"](spark, SF).collect()}
    assert got == {k: v.replace("\r\n", "\n").replace("\r", "\n").strip() for k, v in column("documents", "doc_id", "text").items() if v and v.strip()}


def test_markdown_query(spark):
    rows = catalogue.queries()["markdown_to_html_words"](spark, SF).collect()
    assert rows and not any({"notaword", "alsonot"} & set(r.words.split("\n")) for r in rows)


def test_words_of_markdown_are_not_shuffled_again(spark):
    """After the check a chunk's words stay one row: nothing is partitioned by document and word."""
    plan = catalogue.queries()["markdown_to_html_words"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    by = [line for line in plan.split("\n") if "hashpartitioning(" in line]
    assert by and not any("word#" in line.split("hashpartitioning(")[1] for line in by)


def sql_agrees(spark, folder, name, **tables):
    """A query against its SQL, over tables of a few rows."""
    con = duckdb.connect()
    for table, columns in tables.items():
        pq.write_table(pa.table(columns), f"{folder}/{table}.parquet")
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    df = catalogue.queries()[name](spark, str(folder))
    want = con.sql(catalogue.oracle_sql()[name])
    at = [want.columns.index(c) for c in df.columns]
    assert sorted(map(tuple, df.collect())) == sorted(tuple(r[i] for i in at) for r in want.fetchall())


CUT = ["<html><head><title>Dogs &amp;&amp</title></head><body><h1>Dogs &amp;&amp</h1><p>a&ltb &amp; c</p></body></html>", "<html><body><p>&am</p></body></html>"]


def test_references_cut_in_the_middle(spark, tmp_path):
    sql_agrees(spark, tmp_path, "html_blocks", pages={"page_id": [1, 2], "html": CUT})


def test_references_cut_in_files(spark, tmp_path):
    sql_agrees(spark, tmp_path, "html_files", pages={"page_id": [1, 2, 3], "html": [*CUT, '<meta charset="utf-8"><p>é&eacute</p>']})


def test_declared_xml_of_blank_texts(spark, tmp_path):
    sql_agrees(spark, tmp_path, "xml_declared_files", documents={"doc_id": [1, 2, 3, 4, 5], "text": ["", " \n ", " a ]]> b\t", None, "\r\n<&é"]})


@pytest.mark.parametrize("name", ["xml_text", "odf_text"])
def test_end_of_cdata_in_texts(spark, tmp_path, name):
    sql_agrees(spark, tmp_path, name, documents={"doc_id": [1, 2], "text": ["a ]]> b", "]]]>"], "lang": ["en", "fr"], "source": ["x", "y"]})
