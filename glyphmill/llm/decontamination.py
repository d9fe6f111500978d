"""Benchmark decontamination by spaced seeds.

A seed is a hash of the words at the picked places of a mask; words at its other places may differ. Seeds of the benchmark and of the
training texts are joined, and around each hit the two are compared word by word on its diagonal.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.llm.arrays import U, WORD_RE2, Words, grams, large, lists, mix, signed, slices
from glyphmill.llm.session import counted, table, texts, tidied

MASKS = ("1101001101", "101110011", "1110001011")
SPAN = max(map(len, MASKS))
#: A hit counts if WINDOW words in a row around it (or the whole item, if shorter) agree in at least SHARE of the places.
WINDOW, SHARE = 16, 0.75
#: Items of fewer words say nothing and match nothing: a parameter of ``contaminated``, 1 to match all.
LEAST = 4
#: The masks above may miss substitutions that SHARE allows in items of fewer words; those have masks of their own (``short_masks``).
SHORT = 14


def short_masks(n: int) -> tuple[str, ...]:
    """Masks of n places of which one at least has all its words left, whichever SHARE lets differ: the places are cut into two blocks more than words may differ; each mask has two blocks."""
    blocks = int((1 - SHARE) * n + 1e-9) + 2
    of = [k * blocks // n for k in range(n)] if n >= blocks else list(range(n))
    pairs = combinations(range(blocks), 2) if n >= blocks else combinations(range(n), max(1, n - blocks + 2))
    return tuple("".join("1" if b in pair else "0" for b in of) for pair in pairs) if n > 1 else ("1",)


def picks(mask: str) -> tuple[int, ...]:
    return tuple(i for i, c in enumerate(mask) if c == "1")


def seeds(words: Words, masks: tuple[str, ...]) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """For each mask, the places where it lies inside a text, and the seeds there; they differ by mask."""
    left = words.left()
    for mask in masks:
        g = grams(words.hashes, len(mask), picks(mask))
        at = np.flatnonzero(left[: len(g)] >= len(mask))
        yield mask, at, g[at] ^ mix(np.array([len(mask) << 32 | int(mask, 2)], np.uint64))


def around(w: Words, text: np.ndarray, at: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """Where the words near each hit begin in their text, and their hashes: as many as its verification may look at, however long the text."""
    low, high = np.maximum(w.first[text], at - WINDOW), np.minimum(w.first[text + 1], at + SPAN + WINDOW)
    size = high - low
    inner = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    return pa.array(low - w.first[text], pa.int64()), lists(pa.array(signed(w.hashes)[np.repeat(low, size) + inner], pa.int64()), size)


def item_seeds(items: DataFrame, least: int) -> DataFrame:
    """item_seed, item_id, item_at, n_words of the item, and the words near the seed, from item_from on."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.asarray(batch.column(0))
            for first, part in slices(large(batch.column(1))):
                w = Words(part)
                size = np.diff(w.first)
                masks = MASKS + tuple(m for n in np.unique(size[(size >= least) & (size < SHORT)]).tolist() for m in short_masks(n))
                for mask, at, g in seeds(w, masks) if len(w) else ():
                    text = w.text_of()[at]
                    ok = np.flatnonzero((size[text] >= SHORT) if mask in MASKS else (size[text] == len(mask)))
                    if len(ok):
                        text, at = text[ok], at[ok]
                        yield pa.RecordBatch.from_arrays([pa.array(signed(g[ok])), pa.array(ids[first + text]), pa.array(at - w.first[text]), pa.array(size[text]), *around(w, text, at)], ["item_seed", "item_id", "item_at", "n_words", "item_from", "item_near"])

    return items.mapInArrow(tidied(apply), "item_seed long, item_id long, item_at long, n_words long, item_from long, item_near array<long>")


def bitmap(found: DataFrame, bits: int) -> np.ndarray:
    """A Bloom filter of two bits a seed. Its size is fixed, whatever the benchmark's: a large benchmark only lets more seeds pass to the join."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(bits // 8, np.uint8)
        for batch in batches:
            for k in places(np.asarray(batch.column(0)).view(np.uint64), bits):
                np.bitwise_or.at(own, k >> 3, (1 << (k & 7)).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array([own.tobytes()], pa.binary())], ["bits"])

    out = np.zeros(bits // 8, np.uint8)
    for row in found.select("item_seed").coalesce(4).mapInArrow(tidied(apply), "bits binary").toLocalIterator():
        out |= np.frombuffer(row[0], np.uint8)
    return out


def places(seed: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    return (seed & U(bits - 1)).astype(np.int64), (seed >> U(64 - bits.bit_length() + 1)).astype(np.int64)


def contaminated(docs: DataFrame, items: DataFrame, least: int = LEAST, bits: int = 1 << 25, small_bytes: int = 32 << 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, item_id, overlap (the best share of agreeing words) and at_word (where the first verified hit lies), for each document and item of which a passage was found.

    Items of fewer than `least` words match nothing; items of fewer than SHORT words have seeds that find whatever SHARE lets differ; of longer ones the three masks find 0.92 at least of windows that barely reach SHARE.
    Rows without id or text find nothing, nor do empty texts; very long texts and items are compared near hits only; of ties the first place counts; rows that repeat an id are found once; other columns are left out; empty tables on either side give an empty result.
    The items' seeds are broadcast only if they take at most small_bytes by measure; else both sides are shuffled."""
    given = items.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).cast("string").alias("text")).where("item_id is not null and text is not null")
    bench, size = counted(item_seeds(given, least), F.sum(F.size("item_near") * 8 + 60).alias("bytes"))
    n_bytes = size["bytes"] or 0
    short = sorted(r[0] for r in bench.where(F.col("n_words") < SHORT).select("n_words").distinct().collect())  # SHORT - 1 rows at most
    known = docs.sparkSession.sparkContext.broadcast(bitmap(bench, bits))
    masks = MASKS + tuple(m for n in short for m in short_masks(n))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        is_known = known.value
        for batch in batches:
            ids = np.asarray(batch.column(0))
            for first, part in slices(large(batch.column(1))):
                w = Words(part)
                if not len(w):
                    continue
                at, seed = [], []
                for _, p, g in seeds(w, masks):
                    one, two = places(g, bits)
                    on = np.flatnonzero(is_known[one >> 3] >> (one & 7).astype(np.uint8) & 1)
                    on = on[is_known[two[on] >> 3] >> (two[on] & 7).astype(np.uint8) & 1 == 1]
                    at.append(p[on])
                    seed.append(g[on])
                at, seed = np.concatenate(at), np.concatenate(seed)
                if len(at):
                    text = w.text_of()[at]
                    yield pa.RecordBatch.from_arrays([pa.array(signed(seed)), pa.array(ids[first + text]), pa.array(at - w.first[text], pa.int64()), *around(w, text, at)], ["seed", "doc_id", "at", "near_from", "near"])

    hits = texts(docs, id_col, text_col).mapInArrow(tidied(apply), "seed long, doc_id long, at long, near_from long, near array<long>")
    bench = F.broadcast(bench) if n_bytes <= small_bytes else bench
    joined = hits.join(bench, hits.seed == bench.item_seed).select("doc_id", "item_id", "at", "near_from", "near", "item_at", "n_words", "item_from", "item_near")
    return joined.mapInArrow(tidied(verified), "doc_id long, item_id long, overlap double, at_word long").groupBy("doc_id", "item_id").agg(F.max("overlap").alias("overlap"), F.min("at_word").alias("at_word"))


def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hits around which the words agree enough."""
    for batch in batches:
        doc, item, at, start, near, item_at, n_words, item_from, item_near = (batch.column(k) for k in range(9))
        near_off, item_off = np.asarray(near.offsets), np.asarray(item_near.offsets)
        near_all, item_all = np.asarray(near.values), np.asarray(item_near.values)
        at, shift, most = np.asarray(at), np.asarray(start) - np.asarray(at) + np.asarray(item_at) - np.asarray(item_from), np.asarray(n_words)
        share = np.zeros(len(batch))
        for i in range(len(batch)):
            a, b = near_all[near_off[i] : near_off[i + 1]], item_all[item_off[i] : item_off[i + 1]]
            s = int(shift[i])  # the item's near word that lies on a[0]
            low, high = max(0, -s), min(len(a), len(b) - s)
            same = np.concatenate([[0], np.cumsum(a[low:high] == b[low + s : high + s])])
            size = min(WINDOW, int(most[i]))
            if len(same) > size:
                share[i] = (same[size:] - same[:-size]).max() / size
        ok = np.flatnonzero(share >= SHARE)
        yield pa.RecordBatch.from_arrays([doc.take(pa.array(ok)), item.take(pa.array(ok)), pa.array(share[ok]), pa.array(at[ok], pa.int64())], ["doc_id", "item_id", "overlap", "at_word"])


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _sql() -> str:
    """The same rows by SQL: words themselves instead of hashes, and every hit compared without a filter before it."""
    short = [m for n in range(LEAST, SHORT) for m in short_masks(n)]

    def seeds_of(table_: str, key: str, place: str, mask: str, only: str) -> str:
        chosen = ", ".join(f"w[i + {k + 1}]" for k in picks(mask))
        return f"SELECT {key}, '{mask}' AS mask, i AS {place}, concat_ws(' ', {chosen}) AS seed FROM {table_}, unnest(range(len(w) - {len(mask) - 1})) AS r(i) WHERE len(w) >= {len(mask)}{only}"

    items = " UNION ALL ".join(seeds_of("b", "item_id", "item_at", m, f" AND len(w) >= {SHORT}" if m in MASKS else f" AND len(w) = {len(m)}") for m in (*MASKS, *short))
    docs = " UNION ALL ".join(seeds_of("d", "doc_id", "p", m, "" if m in MASKS else f" AND EXISTS (SELECT 1 FROM b WHERE len(w) = {len(m)})") for m in (*MASKS, *short))
    return f"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '{WORD_RE2}') AS w FROM documents),
b AS (SELECT item_id, w FROM (SELECT item_id, regexp_extract_all(lower(text), '{WORD_RE2}') AS w FROM benchmark) WHERE len(w) >= {LEAST}),
x AS ({items}), y AS ({docs}),
h AS (SELECT DISTINCT doc_id, item_id, p, item_at FROM x JOIN y USING (mask, seed)),
m AS (SELECT doc_id, item_id, p, least({WINDOW}, len(b.w)) AS size,
             [(d.w[k + 1] = b.w[k - p + item_at + 1])::INT FOR k IN range(greatest(0, p - {WINDOW}, p - item_at), least(len(d.w), p + {SPAN + WINDOW}, p - item_at + len(b.w)))] AS same
      FROM h JOIN d USING (doc_id) JOIN b USING (item_id)),
s AS (SELECT doc_id, item_id, p, list_max([list_sum(same[k + 1 : k + size]) FOR k IN range(len(same) - size + 1)])::DOUBLE / size AS share FROM m WHERE len(same) >= size)
SELECT doc_id, item_id, max(share) AS overlap, min(p)::BIGINT AS at_word FROM s WHERE share >= {SHARE} GROUP BY doc_id, item_id"""


OP6_SQL = _sql()


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in which no passage of the benchmark was found, unchanged; those without id or text, and of empty texts, stay. Of rows that repeat an id all stay or go; an empty table stays empty."""
    bad, size = counted(contaminated(docs, table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("_bad_")).distinct())
    bad = bad.hint("broadcast" if size["n"] * 16 <= 32 << 20 else "shuffle_hash")
    return docs.join(bad, F.col("doc_id").cast("long") == F.col("_bad_"), "left_anti")
