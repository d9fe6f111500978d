"""Queries by name over the driver's tables, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.functions import encodings
from glyphmill.functions.batches import parts, tidied
from glyphmill.model import Step
from glyphmill.operators import check, lines
from glyphmill.operators.markup import OASIS, OdfFilter
from glyphmill.operators.plain import BLANK, TextFilter
from glyphmill.plans import pipeline

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
#: Words as all engines' expressions can say it.
LETTERS = r"[\p{L}]+"


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from glyphmill.plans import file_queries  # noqa: F401 - adds its own

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(SQL)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def wordlist(df: DataFrame, column: str = "text", pattern: str = LETTERS) -> DataFrame:
    return check.compiled(df.select(F.explode(check.words(F.col(column), pattern)).alias("word")))


def joined(column: str | Column) -> Column:
    return F.array_join(column, "\n")


def run(df: DataFrame, id_col: str, text_col: str, steps: list, category: Column | str = "text", known: set[str] | None = None) -> DataFrame:
    """Chunks of a table after the steps of a pipeline, with the id as a number again."""
    built: list[Step] = pipeline.build(["text", *steps])[1:]
    known = known if known is not None else {category} if isinstance(category, str) else None
    out = pipeline.apply(pipeline.chunks_of(df, id_col, text_col, category), built, known)
    return out.withColumn(id_col, F.col("src_id").cast("long"))


def in_order(chunks: DataFrame, id_col: str, category: str | None = None) -> DataFrame:
    """Texts of each source's chunks in their order: how many, and joined by line breaks."""
    chunks = chunks.where("error is null") if category is None else chunks.where(F.col("category") == category)
    return chunks.groupBy(id_col).agg(F.count("*").alias("n"), joined(F.transform(F.array_sort(F.collect_list(F.struct("path", "text"))), lambda x: x["text"])).alias("texts"))


# ---- the checker

_TOKENS = rf"tok AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '{LETTERS}')) AS w FROM documents), dict AS (SELECT DISTINCT unnest(regexp_extract_all(text, '{LETTERS}')) AS w FROM benchmark)"


def _bad(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.explode(F.array_distinct(check.words(F.col("text"), LETTERS))).alias("word"))
    return check.unknown(docs, wordlist(table(spark, sf_dir, "benchmark")), fold_case=False)


@query(f"WITH {_TOKENS} SELECT doc_id, count(*) AS n_words, string_agg(w, chr(10) ORDER BY w) AS words FROM tok WHERE w NOT IN (SELECT w FROM dict) GROUP BY doc_id")
def misspelled_by_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bad(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("n_words"), joined(F.sort_array(F.collect_set("word"))).alias("words"))


@query(f"WITH {_TOKENS} SELECT lang, count(DISTINCT doc_id) AS n_docs, count(*) AS n_pairs, count(DISTINCT w) AS n_words FROM tok JOIN documents USING (doc_id) WHERE w NOT IN (SELECT w FROM dict) GROUP BY lang")
def misspelled_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bad(spark, sf_dir).groupBy("lang").agg(F.count_distinct("doc_id").alias("n_docs"), F.count("*").alias("n_pairs"), F.count_distinct("word").alias("n_words"))


@query(f"WITH {_TOKENS} SELECT source, count(*) AS n_pairs FROM tok JOIN documents USING (doc_id) WHERE w NOT IN (SELECT w FROM dict) GROUP BY source")
def misspelled_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bad(spark, sf_dir).groupBy("source").agg(F.count("*").alias("n_pairs"))


@query(f"WITH {_TOKENS} SELECT w AS word, count(*) AS n_docs FROM tok WHERE w NOT IN (SELECT w FROM dict) GROUP BY w ORDER BY n_docs DESC, word LIMIT 100")
def most_frequent_misspellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A top-k report."""
    return _bad(spark, sf_dir).groupBy("word").agg(F.count("*").alias("n_docs")).orderBy(F.desc("n_docs"), "word").limit(100)


@query(f"WITH {_TOKENS} SELECT lang, source, count(*) AS n_pairs FROM tok JOIN documents USING (doc_id) WHERE w NOT IN (SELECT w FROM dict) GROUP BY ROLLUP (lang, source)")
def misspelled_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bad(spark, sf_dir).rollup("lang", "source").agg(F.count("*").alias("n_pairs"))


_WORD = r"[\p{L}\p{M}]+(?:[''’][\p{L}\p{M}]+)*"


@query(f"""
WITH tok AS (SELECT DISTINCT conv_id, turn, unnest(regexp_extract_all(text, '{_WORD}')) AS w FROM conversations WHERE text IS NOT NULL),
dict AS (SELECT DISTINCT unnest(regexp_extract_all(text, '{_WORD}')) AS w FROM benchmark),
bad AS (SELECT * FROM tok WHERE w NOT IN (SELECT w FROM dict) AND NOT ((w = upper(w) OR substring(w, 2) = substring(lower(w), 2)) AND lower(w) IN (SELECT w FROM dict)))
SELECT c.conv_id, c.turn, c.role AS category, count(w) AS n_words, coalesce(string_agg(w, chr(10) ORDER BY w), '') AS words
FROM conversations c LEFT JOIN bad USING (conv_id, turn) WHERE regexp_matches(c.text, '\\S') GROUP BY ALL""")
def clean_and_dirty_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chunk that isn't blank, also those without a misspelled word; a turn's role is its category."""
    turns = table(spark, sf_dir, "conversations").withColumn("id", F.concat_ws(":", "conv_id", "turn"))
    results = check.check(pipeline.chunks_of(turns, "id", "text", F.col("role")), wordlist(table(spark, sf_dir, "benchmark"), pattern=check.WORD))
    part = F.split("src_id", ":")
    return results.select(part[0].cast("long").alias("conv_id"), part[1].cast("long").alias("turn"), "category", F.size("words").cast("long").alias("n_words"), joined("words").alias("words"))


@query(f"SELECT DISTINCT unnest(regexp_extract_all(text, '{LETTERS}')) AS word FROM benchmark")
def dictionary_compile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordlist(table(spark, sf_dir, "benchmark"))


@query(f"""
WITH tok AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '{LETTERS}')) AS w FROM documents),
dict AS (SELECT unnest(regexp_extract_all(text, '{LETTERS}')) AS w FROM benchmark UNION SELECT unnest(regexp_extract_all(text, '{LETTERS}')) FROM conversations)
SELECT doc_id, count(*) AS n_words FROM tok WHERE w NOT IN (SELECT w FROM dict) GROUP BY doc_id""")
def personal_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = check.compiled(wordlist(table(spark, sf_dir, "benchmark")), wordlist(table(spark, sf_dir, "conversations")))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array_distinct(check.words(F.col("text"), LETTERS))).alias("word"))
    return check.unknown(docs, own, fold_case=False).groupBy("doc_id").agg(F.count("*").alias("n_words"))


@query(f"WITH {_TOKENS} SELECT doc_id, count(*) AS n_words FROM tok WHERE w IN (SELECT w FROM dict) GROUP BY doc_id")
def known_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array_distinct(check.words(F.col("text"), LETTERS))).alias("word"))
    known = check.sized(wordlist(table(spark, sf_dir, "benchmark")))
    return docs.join(known, docs["word"] == known["_known_"], "left_semi").groupBy("doc_id").agg(F.count("*").alias("n_words"))


# ---- plain filters

_MAIL_RE2 = r"(^|[^-/+@a-zA-Z\d_])[-+a-zA-Z\d_](?:[-+a-zA-Z\d_]|\.[-+a-zA-Z\d_])*@[-a-zA-Z\d_]+(?:\.[-a-zA-Z\d_]+)*\.[-a-zA-Z\d_]*[a-zA-Z]\b"
_LINK_RE2 = r"https?://[-\w]+(?:\.[-\w.]+)+/?(?:[\w#$%&''()+,./:;=?@\[\]{|}~!\"-]*(?:[a-zA-Z0-9]|[-/#@$+=]))?"


@query(rf"SELECT doc_id, regexp_replace(regexp_replace(text, '{_LINK_RE2}', '', 'g'), '{_MAIL_RE2}', '\1', 'g') AS text FROM documents WHERE text IS NOT NULL")
def url_email_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(table(spark, sf_dir, "documents"), "doc_id", "text", ["url"]).select("doc_id", "text")


@query(rf"SELECT page_id, 'see ' || regexp_replace(url, '{_LINK_RE2}', '', 'g') || ' there' AS text FROM pages")
def url_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").withColumn("line", F.concat(F.lit("see "), "url", F.lit(" there")))
    return run(pages, "page_id", "line", [{"url": {"emails": False}}]).select("page_id", "text")


@query(r"SELECT page_id, regexp_replace(regexp_replace(html, '(?s)###.*?(###|\z)|\$\$\$.*?(\$\$\$|\z)', ' ', 'g'), ' \z', '') AS text FROM pages")
def context_fences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text outside of two kinds of delimiters; a page ends with a tag, so that a space at the end stands for what is hidden."""
    steps = [{"context": {"context_visible_first": True, "delimiters": [{"open": "###", "close": "###"}, {"open": r"\$\$\$", "close": r"\$\$\$"}]}}]
    return run(table(spark, sf_dir, "pages"), "page_id", "html", steps).select("page_id", "text")


@query(r"SELECT page_id, array_to_string(list_transform(regexp_extract_all(html, '<p>[^<]*'), lambda x: x[4:]), ' ') AS text FROM pages")
def context_inside(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text inside of delimiters."""
    steps = [{"context": {"delimiters": [{"open": "<p>", "content": "[^<]*", "close": "(?=<)"}]}}]
    return run(table(spark, sf_dir, "pages"), "page_id", "html", steps).select("page_id", "text")


@query("SELECT doc_id, replace(text, chr(13), chr(10)) AS text FROM documents WHERE text IS NOT NULL")
def newline_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("text is not null").withColumn("text", F.replace("text", F.lit("\n"), F.lit("\r\n")))
    return docs.select("doc_id", encodings.newlines_column(F.col("text")).alias("text"))


@query("SELECT doc_id, nfc_normalize(text) AS text FROM documents WHERE text IS NOT NULL")
def nfc_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(table(spark, sf_dir, "documents"), "doc_id", "text", [{"text": {"normalize": "nfc"}}]).select("doc_id", "text")


@query("SELECT source AS category, count(*) AS n FROM documents WHERE regexp_matches(text, '\\S') GROUP BY source")
def blank_chunk_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document, and beside it a blank one."""
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("category"), "text")
    blank = docs.withColumn("text", F.lit("\u2003\u00a0"))
    return docs.unionByName(blank).where(~F.col("text").rlike(BLANK)).groupBy("category").agg(F.count("*").alias("n"))


# ---- encodings


@query("SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'utf-8-sig' WHEN 1 THEN 'utf-16' WHEN 2 THEN 'utf-32' END AS encoding FROM pages")
def bom_sniff(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("page_id") % 4
    mark = F.unhex(F.when(kind == 0, F.lit("EFBBBF")).when(kind == 1, F.lit("FFFE")).when(kind == 2, F.lit("FFFE0000")).otherwise(F.lit("")))
    return table(spark, sf_dir, "pages").select("page_id", encodings.mark_column(F.concat(mark, F.encode("html", "UTF-8"))).alias("encoding"))


@query(r"SELECT page_id, lower(regexp_extract(substring(html, 1, 1024), '(?i)<meta\s[^>]*?charset\s*=\s*[\"'']?\s*([-\w.:]+)', 1)) AS charset FROM pages")
def meta_charset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", encodings.meta_charset_column(F.col("html")).alias("charset"))


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'utf-8' WHEN 1 THEN 'utf-16' ELSE 'utf-32' END AS encoding, replace(text, chr(13), chr(10)) AS text FROM documents WHERE text IS NOT NULL")
def decoded_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files in three encodings, told by their marks or taken for the default."""
    kind = F.col("doc_id") % 3
    mark = F.unhex(F.when(kind == 2, F.lit("0000FEFF")).otherwise(F.lit("")))
    raw = F.when(kind == 0, F.encode("text", "UTF-8")).when(kind == 1, F.encode("text", "UTF-16")).otherwise(F.concat(mark, F.encode("text", "UTF-32")))
    files = table(spark, sf_dir, "documents").where("text is not null").select(F.col("doc_id").alias("src_id"), F.lit("file").alias("context"), raw.alias("raw"))
    return pipeline.first(files, TextFilter()).select(F.col("src_id").cast("long").alias("doc_id"), "encoding", encodings.newlines_column(F.regexp_replace("text", "^\ufeff", "")).alias("text"))


# ---- markup


@query("SELECT page_id, len(regexp_extract_all(html, '<!--(.*?)-->', 1)) AS n, array_to_string(list_transform(regexp_extract_all(html, '<!--(.*?)-->', 1), lambda x: trim(x)), chr(10)) AS texts FROM pages WHERE html LIKE '%<!--%'")
def html_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return in_order(run(table(spark, sf_dir, "pages"), "page_id", "html", ["html"]), "page_id", "htmlcomment")


@query("SELECT page_id, len(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS n, replace(array_to_string(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1), chr(10)), '&amp;', '&') AS texts FROM pages WHERE html LIKE '%href=%'")
def html_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return in_order(run(table(spark, sf_dir, "pages"), "page_id", "html", [{"html": {"attributes": ["href"], "comments": False}}]), "page_id", "htmlattribute")


#: Blocks by SQL: what is between the tags of block elements; in it, inline tags part texts that are trimmed and joined by a space.
_NO_TEXT = r"(?s)<!--.*?-->|<script.*?</script>|<style.*?</style>|<!DOCTYPE[^>]*>"
_BLOCK_TAG = r"</?(?:html|head|meta|body|nav|ul|li|div|article|h1|p|footer)(?:\s[^>]*)?>"
_INLINE = r"array_to_string(list_filter(list_transform(string_split_regex(b, '<[^>]*>'), lambda t: trim(replace(replace(replace(replace(replace(replace(replace(t, '&copy;', '©'), '&middot;', '·'), '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&#x27;', chr(39)), '&amp;', '&'), ' ' || chr(10))), lambda t: t <> ''), ' ')"


def _blocks_sql(gone: str) -> str:
    return f"SELECT page_id, len(x)::BIGINT AS n, array_to_string(x, chr(10)) AS texts FROM (SELECT page_id, list_filter(list_transform(string_split_regex(regexp_replace(html, '{_NO_TEXT}{gone}', '', 'g'), '{_BLOCK_TAG}'), lambda b: {_INLINE}), lambda b: b <> '') AS x FROM pages) WHERE len(x) > 0"


@query(_blocks_sql(""))
def html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return in_order(run(table(spark, sf_dir, "pages"), "page_id", "html", [{"html": {"comments": False}}]), "page_id", "htmlcontent")


@query(_blocks_sql('|<nav>.*?</nav>|<h1>.*?</h1>|<div class="ad">.*?</div>|<title>.*?</title>|<footer>.*?</footer>'))
def html_ignores_selector(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = [{"html": {"ignores": ["nav", ":is(h1, .ad)", "title", "footer"], "comments": False}}]
    return in_order(run(table(spark, sf_dir, "pages"), "page_id", "html", steps), "page_id", "htmlcontent")


@query(r"SELECT page_id, len(regexp_extract_all(html, '<li><a [^>]*>([^<]*)</a></li>', 1)) AS n, array_to_string(list_transform(regexp_extract_all(html, '<li><a [^>]*>([^<]*)</a></li>', 1), lambda x: trim(replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'), '&amp;', '&'))), chr(10)) AS texts FROM pages WHERE html LIKE '%<li><a %'")
def html_captures_selector(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = [{"html": {"captures": ["li > a[href]:only-child"], "comments": False}}]
    return in_order(run(table(spark, sf_dir, "pages"), "page_id", "html", steps), "page_id", "htmlcontent")


def _escaped(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


_STRIPPED = r"regexp_replace(replace(text, chr(13), chr(10)), '^\s+|\s+$', '', 'g')"


@query(f"SELECT doc_id, {_STRIPPED} || ' tail' AS content, lang AS attribute, source AS comment FROM documents WHERE regexp_matches(text, '\\S')")
def xml_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where(r"text rlike '\\S'")
    xml = F.concat(F.lit('<d:doc xmlns:d="urn:d"><d:t lang="'), "lang", F.lit('">'), _escaped(F.col("text")), F.lit("</d:t><skip>no</skip><!-- "), "source", F.lit(" -->tail</d:doc>"))
    steps = [{"xml": {"attributes": ["lang"], "ignores": ["|skip"], "namespaces": {"d": "urn:d"}, "captures": ["d|*"]}}]
    chunks = run(docs.withColumn("xml", xml), "doc_id", "xml", steps)
    of = lambda c: F.max(F.when(F.col("category") == c, F.col("text")))
    return chunks.groupBy("doc_id").agg(of("xmlcontent").alias("content"), of("xmlattribute").alias("attribute"), of("xmlcomment").alias("comment"))


@query(f"SELECT doc_id, {_STRIPPED} AS text FROM documents WHERE regexp_matches(text, '\\S')")
def odf_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat documents made of the texts."""
    spaces = " ".join(f'xmlns:{x}="{OASIS}:{x}:1.0"' for x in ("office", "text"))
    head = f'<office:document {spaces} office:mimetype="{OdfFilter.MIME}text"><office:body><text:p>'
    docs = table(spark, sf_dir, "documents").where(r"text rlike '\\S'").withColumn("odf", F.concat(F.lit(head), _escaped(F.col("text")), F.lit("</text:p></office:body></office:document>")))
    return run(docs, "doc_id", "odf", ["odf"]).where("category = 'odtcontent'").select("doc_id", "text")


@query(f"SELECT doc_id, 'docxcontent' AS category, {_STRIPPED} AS text FROM documents WHERE regexp_matches(text, '\\S')")
def ooxml_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zipped documents made of the texts, read as files."""
    docs = table(spark, sf_dir, "documents").where(r"text rlike '\\S'").select("doc_id", "text")

    def zipped(batches):
        import io
        import zipfile
        from xml.sax.saxutils import escape

        import pyarrow as pa

        for batch in (part for whole in batches for part in parts(whole, 1)):
            out = []
            for text in batch.column(1).to_pylist():
                buffer = io.BytesIO()
                with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
                    z.writestr("[Content_Types].xml", '<Types><Override PartName="/word/document.xml"/></Types>')
                    z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:p><w:r><w:t>{escape(text)}</w:t></w:r></w:p></w:document>')
                out.append(buffer.getvalue())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(["file"] * len(out)), pa.array(out, pa.binary())], ["src_id", "context", "raw"])

    from glyphmill.operators.markup import OoxmlFilter

    files = docs.mapInArrow(tidied(zipped), "src_id long, context string, raw binary")
    return pipeline.first(files, OoxmlFilter()).select(F.col("src_id").cast("long").alias("doc_id"), "category", "text")


@query(f"""
WITH tok AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(source || ' ' || text, '{_WORD}')) AS w FROM documents WHERE text IS NOT NULL),
dict AS (SELECT DISTINCT unnest(regexp_extract_all(text, '{_WORD}')) AS w FROM benchmark)
SELECT doc_id, count(*) AS n_words, string_agg(w, chr(10) ORDER BY w) AS words FROM tok
WHERE w NOT IN (SELECT w FROM dict) AND NOT ((w = upper(w) OR substring(w, 2) = substring(lower(w), 2)) AND lower(w) IN (SELECT w FROM dict)) GROUP BY doc_id""")
def markdown_to_html_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markdown made of the texts, rendered, and checked but for its code."""
    md = F.concat(F.lit("# "), "source", F.lit("\n\n"), "text", F.lit("\n\n```\nnotaword\n```\n\n* `alsonot`\n"))
    docs = table(spark, sf_dir, "documents").where("text is not null").withColumn("md", md)
    chunks = run(docs, "doc_id", "md", [{"markdown": {"markdown_extensions": ["fenced_code"]}}, {"html": {"comments": False, "ignores": ["code"]}}])
    results = check.check(chunks.drop("doc_id"), wordlist(table(spark, sf_dir, "benchmark"), pattern=check.WORD))
    dirty = results.where(F.size("words") > 0).groupBy(F.col("src_id").cast("long").alias("doc_id"))
    words = dirty.agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("words")))).alias("words"))  # a row for each chunk is shuffled, not for each of its words
    return words.select("doc_id", F.size("words").cast("long").alias("n_words"), joined("words").alias("words"))


# ---- source code


def _code(spark: SparkSession, sf_dir: str, *ends: str) -> DataFrame:
    """Whole texts, after an x; of what would end a comment the characters are parted by a blank."""
    text = F.concat(F.lit("x"), F.replace("text", F.lit("\r"), F.lit("\n")))
    for end in ends:
        text = F.replace(text, F.lit(end), F.lit(" ".join(end)))
    return table(spark, sf_dir, "documents").where(r"text rlike '\\S'").select("doc_id", text.alias("text"))


_CODE_SQL = r"code AS (SELECT doc_id, 'x' || replace(replace(text, chr(13), chr(10)), '*/', '* /') AS text FROM documents WHERE regexp_matches(text, '\S'))"
_RAW_SQL = r"code AS (SELECT doc_id, 'x' || replace(text, chr(13), chr(10)) AS text FROM documents WHERE regexp_matches(text, '\S'))"
_LINES_SQL = "array_to_string(list_transform(string_split(text, chr(10)), lambda x: CASE WHEN regexp_matches(x, '^[ \\t]*$') THEN '' ELSE x END), chr(10))"


@query(f"WITH {_CODE_SQL} SELECT doc_id, 1::BIGINT AS n, {_LINES_SQL} AS texts FROM code")
def cpp_block_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _code(spark, sf_dir, "*/").withColumn("code", F.concat(F.lit("int x = 1; /*"), "text", F.lit("*/ char y = 'z';")))
    return in_order(run(docs, "doc_id", "code", ["cpp"]), "doc_id", "cpp-block-comment")


@query(f"WITH {_CODE_SQL} SELECT doc_id, 2::BIGINT AS n, {_LINES_SQL} || chr(10) || 'tail' AS texts FROM code")
def css_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _code(spark, sf_dir, "*/").withColumn("code", F.concat(F.lit("a { b: c } /*"), "text", F.lit("*/\na { b: c } //tail\n")))
    return in_order(run(docs, "doc_id", "code", [{"stylesheets": {"stylesheets": "scss"}}]), "doc_id")


@query(f"WITH {_RAW_SQL} SELECT doc_id, {_LINES_SQL} AS text FROM code")
def js_line_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line of a text as a line comment: grouped, they are the text."""
    docs = _code(spark, sf_dir).withColumn("code", F.concat(F.lit("let a = `x${'y'}`;\n//"), F.replace("text", F.lit("\n"), F.lit("\n//"))))
    return run(docs, "doc_id", "code", [{"javascript": {"group_comments": True}}]).where("category = 'js-line-comment'").select("doc_id", "text")


@query(f"WITH {_RAW_SQL} SELECT doc_id, {_LINES_SQL} AS docstring, 'note' AS comment FROM code")
def py_docstrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as docstrings; quotes and backslashes are escaped in the source, and come back."""
    escaped = F.replace(F.replace("text", F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    docs = _code(spark, sf_dir).withColumn("code", F.concat(F.lit('class A:\n    def b(self):\n        """'), escaped, F.lit('"""\n        return "no"  #note\n')))
    of = lambda c: F.max(F.when(F.col("category") == c, F.col("text")))
    return run(docs, "doc_id", "code", ["python"]).groupBy("doc_id").agg(of("py-docstring").alias("docstring"), of("py-comment").alias("comment"))


@query(f"WITH {_RAW_SQL} SELECT doc_id, category, count(*) AS n, string_agg(text, chr(10)) AS texts FROM (SELECT doc_id, 'py-string' AS category, text FROM code UNION ALL SELECT doc_id, 'py-comment', 'tail' FROM code) GROUP BY doc_id, category")
def py_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as string literals, of which escapes are decoded; bytes and raw strings are not asked for."""
    escaped = F.replace(F.replace(F.replace("text", F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit("\n"), F.lit("\\n"))
    docs = _code(spark, sf_dir).withColumn("code", F.concat(F.lit("a = '"), escaped, F.lit("'\nb = b'no' + r'no'  # tail\n")))
    chunks = run(docs, "doc_id", "code", [{"python": {"strings": True, "string_types": "u"}}]).where("error is null")
    return chunks.groupBy("doc_id", "category").agg(F.count("*").alias("n"), joined(F.collect_list(F.trim("text"))).alias("texts"))


@query(f"WITH {_RAW_SQL} SELECT doc_id, text FROM code")
def js_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as string literals of JavaScript."""
    escaped = F.replace(F.replace(F.replace("text", F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit("\n"), F.lit("\\n"))
    docs = _code(spark, sf_dir).withColumn("code", F.concat(F.lit("let a = '"), escaped, F.lit("'; // tail\n")))
    return run(docs, "doc_id", "code", [{"javascript": {"strings": True}}]).where("category = 'js-strings'").select("doc_id", "text")


@query(f"WITH {_RAW_SQL} SELECT doc_id, text FROM code")
def cpp_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as string literals of C++."""
    escaped = F.replace(F.replace(F.replace("text", F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
    docs = _code(spark, sf_dir).withColumn("code", F.concat(F.lit('auto a = u8"'), escaped, F.lit("\"; char b = 'c'; // tail\n")))
    return run(docs, "doc_id", "code", [{"cpp": {"strings": True}}]).where("category = 'cpp-string'").select("doc_id", "text")


@query(r"""
WITH l AS (SELECT doc_id, unnest(range(1, len(s) + 1)) AS line, unnest(s) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents WHERE text IS NOT NULL)),
c AS (SELECT doc_id, line, regexp_extract(text, '^([ \t]*)[A-M]([^\n]*)$', 2) AS comment, regexp_extract(text, '^([ \t]*)[A-M]([^\n]*)$', 1) AS indent FROM l WHERE regexp_matches(text, '^[ \t]*[A-M][^\n]*$')),
g AS (SELECT *, line - row_number() OVER (PARTITION BY doc_id, indent ORDER BY line) AS island FROM c)
SELECT doc_id, indent, min(line) AS line, count(*) AS n_lines, string_agg(comment, chr(10) ORDER BY line) AS comment FROM g GROUP BY doc_id, indent, island""")
def grouped_line_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that begin with a letter from A to M stand for comments."""
    docs = table(spark, sf_dir, "documents").where("text is not null")
    rows = lines.lines(docs, "doc_id", F.col("text")).withColumn("text", F.regexp_replace("text", r"^([ \t]*)[A-M]", "$1//"))
    marked = rows.where(F.col("text").rlike(r"^[ \t]*//"))
    return lines.grouped_comments(marked, "doc_id")


# ---- flow control and tasks

_ROUTE = "CASE WHEN NOT regexp_matches(source, '^src1[0-9]$|^src[2-5]$') THEN 'skip' WHEN source = 'src13' THEN 'halt' WHEN regexp_matches(source, '^src1[12]$') THEN 'skip' ELSE 'allow' END"
_RULES = {"wildcard": {"allow": ["src1[0-9]", "src{2..5}"], "skip": ["src11|SRC12"], "halt": ["src13"]}}


@query(f"SELECT doc_id, {_ROUTE} AS route, length(text)::BIGINT AS n_chars FROM documents WHERE text IS NOT NULL")
def wildcard_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a flow control says for each document, whose source is its category: the filter after it changes the category, a halt is marked."""
    keep = {"context": {"context_visible_first": True, "normalize_line_endings": False, "delimiters": [{"open": "\ue123", "close": "\ue123"}]}}
    chunks = run(table(spark, sf_dir, "documents"), "doc_id", "text", [_RULES, keep], F.col("source"))
    route = F.when(F.col("halted"), "halt").when(F.col("category") == "context", "allow").otherwise("skip")
    return chunks.select("doc_id", route.alias("route"), F.length("text").cast("long").alias("n_chars"))


@query(f"SELECT route, count(*) AS n, sum(length(text))::BIGINT AS n_chars FROM (SELECT {_ROUTE} AS route, CASE WHEN {_ROUTE} = 'allow' THEN nfc_normalize(replace(text, chr(13), chr(10))) WHEN {_ROUTE} = 'halt' THEN text ELSE nfc_normalize(text) END AS text FROM documents WHERE text IS NOT NULL) GROUP BY route")
def pipeline_skip_halt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A flow control before the first of two filters: skipped chunks come to the second, halted ones to none."""
    docs = table(spark, sf_dir, "documents")
    steps = [_RULES, {"context": {"context_visible_first": True, "delimiters": [{"open": "\ue123", "close": "\ue123"}]}}, {"text": {"normalize": "nfc"}}]
    kept = docs.select("doc_id", "source", "text")
    built = pipeline.build(["text", *steps])[1:]
    chunks = pipeline.apply(pipeline.chunks_of(kept, "doc_id", "text", F.col("source"), F.col("source")), built)
    route = F.when(~F.col("context").rlike("^src1[0-9]$|^src[2-5]$"), "skip").when(F.col("context") == "src13", "halt").when(F.col("context").rlike("^src1[12]$"), "skip").otherwise("allow")
    return chunks.groupBy(route.alias("route")).agg(F.count("*").alias("n"), F.sum(F.length("text")).cast("long").alias("n_chars"))


@query(f"""
WITH dict AS (SELECT DISTINCT unnest(regexp_extract_all(text, '{LETTERS}')) AS w FROM benchmark),
tok AS (SELECT 'docs' AS task, doc_id AS id, unnest(regexp_extract_all(text, '{LETTERS}')) AS w FROM documents UNION ALL
        SELECT 'turns', conv_id, unnest(regexp_extract_all(text, '{LETTERS}')) FROM conversations)
SELECT task, id, count(DISTINCT w) AS n_words FROM tok WHERE w NOT IN (SELECT w FROM dict) GROUP BY task, id""")
def task_matrix_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tasks with one dictionary, their results one table."""
    words = F.explode(F.array_distinct(check.words(F.col("text"), LETTERS))).alias("word")
    docs = table(spark, sf_dir, "documents").select(F.lit("docs").alias("task"), F.col("doc_id").alias("id"), words)
    turns = table(spark, sf_dir, "conversations").select(F.lit("turns").alias("task"), F.col("conv_id").alias("id"), words)
    bad = check.unknown(docs.unionByName(turns), wordlist(table(spark, sf_dir, "benchmark")), fold_case=False)
    return bad.distinct().groupBy("task", "id").agg(F.count("*").alias("n_words"))
