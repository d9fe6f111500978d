"""Bringing together documents that share keys, without pairs of all that share one."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.llm.session import counted, stored


def led(keys: DataFrame) -> DataFrame:
    """keys: (key, doc_id, ...), with no pair twice. Adds to each row of a key that several documents have its leader, their least id, and n, their number; other rows go.

    Leaders are aggregated before they are shuffled, so that a key of very many documents gives a row for each task; joining them back is a join that the
    engine splits where a key is skewed. No pairs are made. The keys are computed twice."""
    shared = keys.groupBy("key").agg(F.min("doc_id").alias("leader"), F.max("doc_id").alias("last"), F.count("*").alias("n")).where("leader < last").drop("last")
    return keys.join(stored(shared).hint("shuffle_hash"), "key")


def gathered(edges: DataFrame, docs: DataFrame) -> DataFrame:
    """Texts joined to edges, one row for each doc_id at most. The edges are hashed, so that texts needn't be sorted."""
    return docs.join(edges.hint("shuffle_hash"), "doc_id")


def runs(batches: Iterator[pa.RecordBatch], column: int = 0) -> Iterator[pa.Table]:
    """The rows of batches that are sorted by a column of no nulls, as one table for each of its values."""
    held: list[pa.RecordBatch] = []
    at = None
    for batch in batches:
        values = batch.column(column).to_pylist()
        i = 0
        while i < len(values):
            j = i + 1
            while j < len(values) and values[j] == values[i]:
                j += 1
            if held and at != values[i]:
                yield pa.Table.from_batches(held)
                held = []
            at = values[i]
            held.append(batch.slice(i, j - i))
            i = j
    if held:
        yield pa.Table.from_batches(held)


def components(edges: DataFrame) -> DataFrame:
    """(a, b) of long: pairs of linked ids. Returns (doc_id, group_id): the least id of its connected component, for each id with a link to another.

    Large-star and small-star by turns until nothing changes; each round is written to the shared folder."""
    now = stored(edges.select("a", "b").where("a <> b").distinct())
    before = None
    while True:
        of = Window.partitionBy("a")
        both = now.union(now.select("b", "a")).toDF("a", "b").distinct()
        large = both.withColumn("m", F.least(F.min("b").over(of), "a")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        small = down.withColumn("m", F.min("b").over(of))
        now, state = counted(small.select(F.col("b").alias("x"), "m").union(small.select("a", "m")).toDF("a", "b").where("a <> b").distinct(), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("of"))
        if state == before:
            break
        before = state
    return now.groupBy(F.col("a").alias("doc_id")).agg(F.min("b").alias("group_id"))
