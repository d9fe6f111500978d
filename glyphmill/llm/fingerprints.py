"""Fingerprints of closed syncmers.

Of the k characters from each place of the lower-cased text, those are chosen whose least inner substring of s characters (by hash; ties
count) is the first or the last one. Whether a k-mer is chosen depends on nothing outside it, so that passages shared by
two texts have the same anchors at the same distances.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.llm.arrays import U, flat, large, lists, mix, powers, signed, slices, sliding_min
from glyphmill.llm.session import table

K, S = 48, 12


def code_points(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = flat(column)
    count = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=count[1:])
    return np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32), count[offsets]


def substrings(chars: np.ndarray, n: int) -> np.ndarray:
    """A hash of the n characters from each place."""
    power, inverse = powers(len(chars) + 1)
    total = np.zeros(len(chars) + 1, np.uint64)
    np.cumsum(mix(chars.astype(np.uint64) + U(77)) * power[: len(chars)], out=total[1:])
    m = max(0, len(chars) - n + 1)
    return mix((total[n : n + m] - total[:m]) * inverse[:m])


def syncmers(column: pa.Array, k: int, s: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The character at which each chosen k-mer begins, its hash, and the number of them in each text, of a large_string array."""
    chars, offsets = code_points(pc.utf8_lower(column))
    rows = len(offsets) - 1
    if len(chars) < k:
        return np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(rows, np.int64)
    inner, outer = substrings(chars, s), substrings(chars, k)
    m = len(outer)
    least = sliding_min(inner, k - s + 1)[:m]
    chosen = (inner[:m] == least) | (inner[k - s : k - s + m] == least)
    row = np.repeat(np.arange(rows), np.diff(offsets))
    chosen &= row[:m] == row[k - 1 : k - 1 + m]
    at = np.flatnonzero(chosen)
    return (at - offsets[row[at]]).astype(np.int32), signed(outer[at]), np.bincount(row[at], minlength=rows)


def fingerprints(docs: DataFrame, k: int = K, s: int = S, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, positions and anchors (the hashes there, in the order of the text): one row for each row.

    Null texts and texts of fewer than k characters have empty lists; very long texts are one row like others; of equal inner substrings (ties) the first and the last count; repeated rows give repeated rows; other columns are left out; an empty table gives none."""
    if not 0 < s <= k:
        raise ValueError("0 < s <= k is needed")

    @F.arrow_udf("struct<positions:array<int>,anchors:array<long>>")
    def apply(column: pa.Array) -> pa.Array:
        parts = [syncmers(part, k, s) for _, part in slices(large(column))] or [syncmers(large(column), k, s)]
        at, anchors, counts = (np.concatenate(x) for x in zip(*parts))
        return pa.StructArray.from_arrays([lists(pa.array(at, pa.int32()), counts), lists(pa.array(anchors, pa.int64()), counts)], ["positions", "anchors"])

    return docs.select(F.col(id_col).alias("doc_id"), apply(F.col(text_col).cast("string")).alias("f")).select("doc_id", "f.*")


def positional_matches(prints: DataFrame, min_anchors: int = 2) -> DataFrame:
    """doc_a < doc_b, shift and n_anchors: how many anchors a document shares with an earlier one at the same distance between their places. A document is held against the least one that has the
    anchor, at its first place there, and not against all: an anchor of very many documents costs no more than its rows, and those that share a passage meet in its first document. No query runs this.

    Null ids and empty lists match nothing; an empty table gives no rows."""
    one = prints.select("doc_id", F.explode(F.arrays_zip("positions", "anchors")).alias("x")).select("doc_id", F.col("x.positions").alias("at"), F.col("x.anchors").alias("anchor")).where("doc_id is not null")
    first = one.groupBy("anchor").agg(F.min(F.struct("doc_id", "at")).alias("first"), F.max("doc_id").alias("last")).where("first.doc_id < last")
    met = one.join(first.select("anchor", F.col("first.doc_id").alias("doc_a"), F.col("first.at").alias("at_a")), "anchor").where("doc_a < doc_id")
    return met.groupBy("doc_a", F.col("doc_id").alias("doc_b"), (F.col("at_a") - F.col("at")).alias("shift")).agg(F.count("*").alias("n_anchors")).where(F.col("n_anchors") >= min_anchors)


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
