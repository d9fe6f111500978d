"""The checker: words of chunks that no dictionary has.

A word is a maximal run of letters and marks, with single apostrophes between letters. A word is known as it stands, or in lower case if it is
capitalised or all in capitals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.operators.plain import BLANK

WORD = r"[\p{L}\p{M}]+(?:['’][\p{L}\p{M}]+)*"
#: Bytes up to which a dictionary is sent to all executors; beyond, both sides are shuffled by word.
BROADCAST_BYTES = 64 << 20


def words(text: Column, pattern: str = WORD) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def compiled(*wordlists: DataFrame, column: str = "word") -> DataFrame:
    """One dictionary (word) of several lists: distinct, without carriage returns, blank lines and nulls."""
    every = None
    for one in wordlists:
        one = one.select(F.translate(F.col(column).cast("string"), "\r", "").alias("word")).where("word is not null and word <> ''")
        every = one if every is None else every.unionByName(one)
    if every is None:
        raise ValueError("a dictionary needs a list of words")
    return every.distinct()


def read_wordlists(spark: SparkSession, paths: list[str], encoding: str = "utf-8") -> DataFrame:
    """Words of files, one on a line."""
    if encoding.lower().replace("_", "-") in ("utf-8", "utf8", "ascii", "us-ascii"):
        return compiled(spark.read.text(list(paths)), column="value")
    files = spark.read.format("binaryFile").load(list(paths)).select("content")

    @F.pandas_udf("array<string>")
    def lines(content):
        return content.map(lambda raw: bytes(raw).decode(encoding).splitlines())

    return compiled(files.select(F.explode(lines("content")).alias("word")))


def known_forms(word: Column) -> Column:
    """The forms in which a dictionary may have a word."""
    lower = F.lower(word)
    folded = F.when((word == F.upper(word)) | (F.substring(word, 2, 1 << 30) == F.substring(lower, 2, 1 << 30)), lower).otherwise(word)
    return F.array_distinct(F.array(word, folded))


def sized(dictionary: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """The dictionary's words as _known_. One that is small enough by measure is fetched, once, and broadcast; of a larger one only the words up to the bound are ever fetched."""
    dictionary = dictionary.select(F.col("word").alias("_known_"))
    rows = most // 32  # of a word's bytes and what a row costs besides
    found = dictionary.limit(rows + 1).toArrow()
    if found.num_rows > rows or found.nbytes > most:
        return dictionary
    return F.broadcast(dictionary.sparkSession.createDataFrame(found, dictionary.schema))


def is_small(known: DataFrame) -> bool:
    return "ResolvedHint" in known._jdf.queryExecution().analyzed().toString()


def unknown(rows: DataFrame, dictionary: DataFrame, fold_case: bool = True) -> DataFrame:
    """Of rows with a word those whose word isn't known; rows whose word is null stay.

    A dictionary that is broadcast is looked up row by row: nothing is shuffled by word. For a larger one the distinct words are looked up once each, and the rows joined to those found."""
    known = sized(dictionary)
    if not is_small(known):
        looked = rows.select("word").distinct().select("word", F.explode(known_forms(F.col("word")) if fold_case else F.array("word")).alias("form"))
        found = looked.join(known, looked["form"] == known["_known_"], "left_semi").select(F.col("word").alias("_found_")).distinct()
        return rows.join(found, rows["word"] == found["_found_"], "left_anti")
    left = rows.join(known, rows["word"] == known["_known_"], "left_anti")
    if not fold_case:
        return left
    return left.join(known, F.get(known_forms(left["word"]), F.lit(1)) == known["_known_"], "left_anti")


def check(chunks: DataFrame, dictionary: DataFrame, pattern: str = WORD, fold_case: bool = True) -> DataFrame:
    """Results (src_id, path, words, context, category, error) of chunks.

    words: distinct and sorted by code point; empty for a chunk without any unknown one. Blank chunks have no result. Chunks with an error have it and no words.
    Binary chunks are read as UTF-8 with what isn't left out. Chunks of one source and path, context and category have one result. The chunks are computed once:
    each brings a row of its own, without a word, beside those of its words."""
    text = F.coalesce(F.col("text"), F.expr("try_validate_utf8(cast(raw as string))"), F.lit(""))
    order = ["src_id", "path", "context", "category", "error"]
    # a generator is what the optimizer doesn't copy: otherwise the filters' expressions would be computed for each use of the text
    whole = chunks.select(*order, F.explode(F.array(text)).alias("text"))
    checked = whole.where(F.col("error").isNotNull() | ~F.col("text").rlike(BLANK))
    found = F.when(F.col("error").isNull(), F.array_distinct(words(F.col("text"), pattern))).otherwise(F.array().cast("array<string>"))
    each = checked.select(*order, F.explode(F.concat(found, F.array(F.lit(None).cast("string")))).alias("word"))
    bad = unknown(each, dictionary, fold_case)
    return bad.groupBy(*order).agg(F.sort_array(F.collect_set("word")).alias("words")).select("src_id", "path", "words", "context", "category", "error")


def report(results: DataFrame) -> tuple[str, bool]:
    """Results as text for a person, and whether anything is wrong. Only what is wrong comes to the driver, a part at a time."""
    bad = results.where("error is not null or size(words) > 0").orderBy("src_id", "path")
    out, rule = [], "-" * 80
    for row in bad.toLocalIterator():
        if row.error is not None:
            out.append(f"ERROR: {row.context} -- {row.error}")
        else:
            out += ["Misspelled words:", f"<{row.category}> {row.context}", rule, *row.words, rule, ""]
    out.append("!!!Spelling check failed!!!" if out else "Spelling check passed :)")
    return "\n".join(out), len(out) > 1
