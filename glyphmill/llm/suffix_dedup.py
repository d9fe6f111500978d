"""Passages that repeat across documents, by suffix arrays.

1. Anchors. Of each LENGTH // 2 word n-grams in a row the one of least hash is an anchor; any two passages of LENGTH equal words share one
   at the same place. An anchor of one document only can't be part of a repeat: this leaves out, exactly, what is unique.
2. Shards. The regions of LENGTH words around an anchor go to the shard of the anchor's leader, the least document that has it, so that any two
   passages that agree meet in a shard. A leader with too many anchors for one suffix array has several shards, by a hash of the document.
3. Per shard, a suffix array by Larsson-Sadakane refinement and Kasai's common prefixes: neighbours with a common prefix of LENGTH words are repeats.
4. The shards of one leader are merged: what each has of distinct passages is looked up by binary search in the sorted suffixes of those before it. As equal
   passages share an anchor, the merge, too, is split: into as many buckets of anchors as the leader has shards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.llm.arrays import WORD_RE2, Words, grams, large, signed, slices, sliding_min
from glyphmill.llm.groups import gathered, led, runs
from glyphmill.llm.session import stored, table, texts, tidied

LENGTH = 50
#: Words in one suffix array, about; anchors (one to LENGTH / 4 words) in one shard of a leader.
SHARD_WORDS, SHARD_ANCHORS = 150_000, 8_000


def shape(length: int) -> tuple[int, int]:
    """Words in an anchor, and how many anchors' places in a row have one chosen."""
    span = max(1, length // 2)
    return length - span + 1, span


def anchors(docs: DataFrame, length: int) -> DataFrame:
    """(key, doc_id) of each anchor, no two alike from one row."""
    n, span = shape(length)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.asarray(batch.column(0))
            for first, part in slices(large(batch.column(1))):
                w = Words(part)
                if len(w) < length:
                    continue
                g = grams(w.hashes, n)
                chosen = np.zeros(len(g), bool)
                least = sliding_min(g, span)  # of the anchors' places from each on
                if len(least):
                    high = ~sliding_min(~np.concatenate([np.zeros(span - 1, np.uint64), least, np.zeros(span - 1, np.uint64)]), span)
                    chosen = high[: len(g)] == g
                of = w.text_of()[: len(g)]
                whole = w.left()[: len(g)] >= n
                at = np.flatnonzero(chosen & whole)
                pair = np.unique(np.stack([of[at], signed(g[at])]), axis=1) if len(at) else np.zeros((2, 0), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(pair[1]), pa.array(ids[first + pair[0]])], ["key", "doc_id"])

    return docs.mapInArrow(tidied(apply), "key long, doc_id long")


def anchored(hashes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and keys of the anchors of one run of words."""
    n, span = shape(length)
    g = grams(hashes, n)
    edge = np.zeros(span - 1, np.uint64)
    least = sliding_min(g, span)
    at = np.flatnonzero(~sliding_min(~np.concatenate([edge, least, edge]), span)[: len(g)] == g)
    return at, g[at]


def suffix_array(x: np.ndarray) -> np.ndarray:
    """The order of all suffixes of x: groups of suffixes that agree so far are refined by the groups of what follows them, twice as far each time, until each is alone."""
    n = len(x)
    order = np.argsort(x, kind="stable")
    rank = np.empty(n + 1, np.int64)  # a group's number is the place of its last member
    rank[n] = -1

    def number(at: np.ndarray, new: np.ndarray) -> np.ndarray:
        """Places at[...] of the order are in groups that begin where new is set; returns those not alone."""
        begin = np.flatnonzero(new)
        size = np.diff(np.append(begin, len(at)))
        rank[order[at]] = np.repeat(at[begin + size - 1], size)
        return at[np.repeat(size > 1, size)]

    sorted_x = x[order]
    left = number(np.arange(n), np.append(True, sorted_x[1:] != sorted_x[:-1])) if n else np.zeros(0, int)
    h = 1
    while len(left):
        own = order[left]
        group, after = rank[own], rank[np.minimum(own + h, n)]
        key = group * (n + 2) + after + 1
        by = np.argsort(key, kind="stable")
        order[left] = own[by]
        key = key[by]
        left = number(left, np.append(True, key[1:] != key[:-1]))
        h *= 2
    return order


def common_prefixes(x: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Kasai: how many elements each suffix, in order, shares with the one before it; the first has 0."""
    n = len(x)
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    out, text, h = [0] * n, x.tolist(), 0
    for i, j in enumerate(before.tolist()):
        if j < 0:
            h = 0
            continue
        most = n - (i if i > j else j)
        while h < most and text[i + h] == text[j + h]:
            h += 1
        out[i] = h
        if h:
            h -= 1
    return np.array(out, np.int64)[order]


class Shard:
    """Regions' words one after another: value (0 between regions), document, and place in the document, of each."""

    def __init__(self, rows: pa.Table) -> None:
        docs, at, parts = np.asarray(rows.column("doc_id")), np.asarray(rows.column("at")), []
        for first, part in slices(large(rows.column("text"))):
            w = Words(part)
            count = np.diff(w.first)
            size = count + 1
            end = np.cumsum(size) - 1
            value, doc, place = np.zeros(size.sum(), np.uint64), np.repeat(docs[first : first + len(part)], size), np.zeros(size.sum(), np.int64)
            word = np.ones(len(value), bool)
            word[end] = False
            value[word] = w.hashes
            place = np.arange(len(value)) - np.repeat(end - count, size) + np.repeat(at[first : first + len(part)], size)
            parts.append((value, doc, place))
        self.value, self.doc, self.place = (np.concatenate(x) for x in zip(*parts))

    def sort(self, length: int) -> None:
        """order: the suffixes; run: for each of them in order, the number of its run of suffixes that agree in `length` words."""
        ids = np.unique(self.value, return_inverse=True)[1] + len(self.value)
        between = np.flatnonzero(self.value == 0)
        ids[between] = np.arange(len(between))  # no two alike, and all less than a word
        self.order = suffix_array(ids)
        self.run = np.cumsum(common_prefixes(ids, self.order) < length) - 1
        ends = np.append(between, len(self.value))
        self.whole = (ends[np.searchsorted(ends, self.order)] - self.order) >= length  # a passage of the length begins there


def ranges(doc: np.ndarray, place: np.ndarray, removed: np.ndarray) -> pa.RecordBatch:
    """Passages' first words as ranges from..upto (inclusive) for each document."""
    if not len(doc):
        return pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 3 + [pa.array([], pa.bool_())], ["doc_id", "from", "upto", "removed"])
    by = np.lexsort((place, removed, doc))
    doc, place, removed = doc[by], place[by], removed[by]
    new = np.append(True, (doc[1:] != doc[:-1]) | (removed[1:] != removed[:-1]) | (place[1:] > place[:-1] + 1))
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(doc)) - 1
    return pa.RecordBatch.from_arrays([pa.array(doc[begin]), pa.array(place[begin]), pa.array(place[end]), pa.array(removed[begin])], ["doc_id", "from", "upto", "removed"])


def regions(length: int):
    """For documents with their leaders' anchors: the words around the anchors, as (leader, salt, salts, doc_id, at, text)."""
    n, _ = shape(length)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for i in range(len(batch)):
                w = Words(large(batch.column(1).slice(i, 1)))
                g = signed(grams(w.hashes, n))
                for led_ in batch.column(2)[i].as_py():
                    at = np.flatnonzero(np.isin(g, np.array(led_["keys"])))
                    if not len(at):
                        continue
                    low, high = np.maximum(at - (length - n), 0), np.minimum(at + length, len(w))
                    begin = np.flatnonzero(np.append(True, low[1:] > high[:-1]))
                    for a, b in zip(low[begin].tolist(), high[np.append(begin[1:], len(at)) - 1].tolist()):
                        if b - a >= length:
                            out.append((led_["leader"], led_["salt"], led_["salts"], batch.column(0)[i].as_py(), a, bytes(w.data[w.starts[a] : w.ends[b - 1]]).decode()))
                if sum(len(x[5]) for x in out[-64:]) > 1 << 20 or len(out) > 5000:
                    yield region_batch(out)
                    out = []
            yield region_batch(out)

    return apply


REGION = "leader long, salt int, salts int, doc_id long, at long, text string"


def region_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["leader", "salt", "salts", "doc_id", "at", "text"])


def repeats(docs: DataFrame, length: int = LENGTH, shard_words: int = SHARD_WORDS, shard_anchors: int = SHARD_ANCHORS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start_word, end_word (exclusive) and is_first: the words covered by passages of `length` words that stand in several documents, as maximal spans.

    is_first: of the spans made of passages of which this document is the one of least id; the other spans are copies. The two may overlap. Repeats inside one document only don't count.
    Null ids or texts, and texts of fewer words, give no rows; a very long text gives its shards only the words around anchors that others have; rows that repeat an id are one document, whose spans are those of all its rows;
    of equal passages that of the least id is the first; other columns are left out; an empty table gives no rows."""
    docs = texts(docs, id_col, text_col)
    n, _ = shape(length)
    keyed = led(anchors(docs, length).distinct()).groupBy("doc_id", "leader").agg(F.collect_list("key").alias("keys"))
    keyed = stored(keyed)
    big = keyed.groupBy("leader").agg(F.sum(F.size("keys")).alias("anchors")).where(F.col("anchors") > shard_anchors).select("leader", F.ceil(F.col("anchors") / shard_anchors).cast("int").alias("salts"))
    salted = keyed.join(big, "leader", "left").withColumn("salts", F.coalesce("salts", F.lit(1))).withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.col("salts")).cast("int"))
    edges = salted.groupBy("doc_id").agg(F.collect_list(F.struct("leader", "salt", "salts", "keys")).alias("led"))
    parts = gathered(edges, docs).select("doc_id", "text", "led").mapInArrow(tidied(regions(length)), REGION)

    def sorted_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        size = 0
        for run in by_shard(batches):
            held.append(run)
            size += run.column("text").nbytes // 6
            if size >= shard_words:
                yield from one_shard(pa.concat_tables(held))
                held, size = [], 0
        if held:
            yield from one_shard(pa.concat_tables(held))

    def one_shard(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        x = Shard(rows)
        x.sort(length)
        doc, place, run = x.doc[x.order], x.place[x.order], x.run
        begin = np.flatnonzero(np.append(True, run[1:] != run[:-1]))
        low, high = np.minimum.reduceat(doc, begin)[run], np.maximum.reduceat(doc, begin)[run]
        on = (low < high) & x.whole
        found = ranges(doc[on], place[on], doc[on] > low[on])
        nothing = region_batch([])
        yield pa.RecordBatch.from_arrays([*found.columns, *(pa.nulls(len(found), c.type) for c in (nothing.column(k) for k in (0, 1, 1, 5)))], OUT_NAMES)
        several = np.asarray(rows.column("salts")) > 1
        if several.any():  # of a leader with other shards: what stands here for the first time
            first = np.zeros(len(x.value), bool)
            first[x.order[(doc == low) & x.whole]] = True
            cover = np.zeros(len(x.value) + 1, np.int64)
            at = np.flatnonzero(first)
            np.add.at(cover, at, 1)
            np.add.at(cover, at + length, -1)
            covered = np.cumsum(cover)[:-1] > 0
            ends = np.flatnonzero(x.value == 0)
            leader, salt, buckets, text = (rows.column(k).to_pylist() for k in ("leader", "salt", "salts", "text"))
            out = []
            for r in np.flatnonzero(several):
                a, b = (int(ends[r - 1]) + 1 if r else 0), int(ends[r])
                inside = covered[a:b]
                if not inside.any():
                    continue
                w = Words(large(pa.array([text[r]])))
                edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
                for c, d in zip(edge[::2].tolist(), edge[1::2].tolist()):
                    at, key = anchored(w.hashes[c:d], length)
                    bucket = (key % np.uint64(buckets[r])).astype(np.int64)
                    for k in np.unique(bucket).tolist():
                        own = at[bucket == k]
                        low, high = np.maximum(c + own - (length - n), c), np.minimum(c + own + length, d)
                        new = np.flatnonzero(np.append(True, low[1:] > high[:-1]))
                        for f, t in zip(low[new].tolist(), high[np.append(new[1:], len(own)) - 1].tolist()):
                            if t - f >= length:
                                out.append((int(x.doc[a]), int(x.place[a + f]), 0, False, leader[r], salt[r], k, bytes(w.data[w.starts[f] : w.ends[t - 1]]).decode()))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int32(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], kind) for k, kind in enumerate(kinds)], OUT_NAMES)

    shards = parts.repartition("leader", "salt").sortWithinPartitions("leader", "salt", "doc_id", "at", "text")
    first = stored(shards.mapInArrow(tidied(sorted_shards), OUT))
    content = first.where("leader is not null").select("leader", "bucket", "salt", "doc_id", F.col("from").alias("at"), "text")
    merged = content.repartition("leader", "bucket").sortWithinPartitions("leader", "bucket", "salt", "doc_id", "at", "text").mapInArrow(tidied(merge(length)), "doc_id long, `from` long, upto long, removed boolean")
    every = first.where("leader is null").select("doc_id", "from", "upto", "removed").union(merged)
    return every.groupBy("doc_id").agg(F.collect_list(F.struct("from", "upto", "removed")).alias("r")).mapInArrow(tidied(spans(length)), "doc_id long, start_word long, end_word long, is_first boolean")


OUT = "doc_id long, `from` long, upto long, removed boolean, leader long, salt int, bucket int, text string"
OUT_NAMES = ["doc_id", "from", "upto", "removed", "leader", "salt", "bucket", "text"]


def by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    for run in runs(batches):
        yield from runs(iter(run.combine_chunks().to_batches()), 1)


def search(x: Shard, order: np.ndarray, words: np.ndarray, length: int) -> np.ndarray:
    """For each row of `length` words, the place in the sorted passages of x (begun at order) of an equal one, or -1: binary search."""
    low, high = np.zeros(len(words), np.int64), np.full(len(words), len(order), np.int64)
    step = np.arange(length)
    equal = np.full(len(words), -1, np.int64)
    live = np.flatnonzero(low < high)
    while len(live):
        middle = (low[live] + high[live]) // 2
        other = x.value[order[middle][:, None] + step]
        differs = other != words[live]
        any_ = differs.any(1)
        at = differs.argmax(1)
        k = np.arange(len(live))
        less = any_ & (other[k, at] < words[live][k, at])
        equal[live[~any_]] = middle[~any_]
        low[live[less]] = middle[less] + 1
        high[live[any_ & ~less]] = middle[any_ & ~less]
        live = live[any_]
        live = live[low[live] < high[live]]
    return equal


def merge(length: int):
    """For each leader and bucket: the passages of its shards' distinct content that stand in several documents of different shards."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in by_shard(batches):
            done: list[tuple[Shard, np.ndarray, np.ndarray]] = []
            least, most = np.zeros(0, np.int64), np.zeros(0, np.int64)
            for part in runs(iter(rows.combine_chunks().to_batches()), 2):
                x = Shard(part)
                x.sort(length)
                order, run = x.order[x.whole], x.run[x.whole]
                begin = np.flatnonzero(np.append(True, run[1:] != run[:-1]))[: len(run)]
                size = np.diff(np.append(begin, len(run)))
                of = np.full(len(begin), -1, np.int64)
                for y, y_order, y_class in done:
                    for c in range(0, len(begin), 20_000):  # a class has one representative
                        todo = c + np.flatnonzero(of[c : c + 20_000] < 0)
                        hit = search(y, y_order, x.value[order[begin[todo]][:, None] + np.arange(length)], length)
                        of[todo[hit >= 0]] = y_class[hit[hit >= 0]]
                new = np.flatnonzero(of < 0)
                of[new] = len(least) + np.arange(len(new))
                least, most = np.append(least, np.full(len(new), 2**62)), np.append(most, np.full(len(new), -(2**62)))
                own = np.repeat(of, size)
                np.minimum.at(least, own, x.doc[order])
                np.maximum.at(most, own, x.doc[order])
                done.append((x, order, own))
            for x, order, own in done:
                on = least[own] < most[own]
                at, low = order[on], least[own[on]]
                yield ranges(x.doc[at], x.place[at], x.doc[at] > low)

    return apply


def union(parts: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(parts):
        if out and a <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def minus(parts: list[tuple[int, int]], less: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out = []
    k = 0
    for a, b in parts:
        while k < len(less) and less[k][1] < a:
            k += 1
        j = k
        while j < len(less) and less[j][0] <= b:
            if a < less[j][0]:
                out.append((a, less[j][0] - 1))
            a = max(a, less[j][1] + 1)
            j += 1
        if a <= b:
            out.append((a, b))
    return out


def spans(length: int):
    """The shards' findings on each document as spans: a passage is a copy if any shard says so."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                removed = union([(f["from"], f["upto"]) for f in found if f["removed"]])
                first = minus(union([(f["from"], f["upto"]) for f in found if not f["removed"]]), removed)
                for parts, is_first in ((removed, False), (first, True)):
                    for a, b in union([(a, b + length - 1) for a, b in parts]):
                        out.append((doc, a, b + 1, is_first))
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.bool_()))], ["doc_id", "start_word", "end_word", "is_first"])

    return apply


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(table(spark, sf_dir, "documents"))


OP1_SQL = f"""
WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '{WORD_RE2}') AS w FROM documents),
p AS (SELECT doc_id, i - 1 AS p, array_to_string(w[i : i + {LENGTH - 1}], ' ') AS g FROM w, unnest(range(1, len(w) - {LENGTH - 2})) AS r(i) WHERE len(w) >= {LENGTH}),
m AS (SELECT g, min(doc_id) AS low FROM p GROUP BY g HAVING min(doc_id) < max(doc_id)),
f AS (SELECT doc_id, p, doc_id = low AS is_first FROM p JOIN m USING (g)),
s AS (SELECT *, sum(CASE WHEN p <= before + {LENGTH} THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, is_first ORDER BY p) AS island
      FROM (SELECT *, coalesce(lag(p) OVER (PARTITION BY doc_id, is_first ORDER BY p), -1000000) AS before FROM f))
SELECT doc_id, min(p)::BIGINT AS start_word, (max(p) + {LENGTH})::BIGINT AS end_word, is_first FROM s GROUP BY doc_id, is_first, island
"""


def cut(column: pa.Array, found: pa.Array) -> pa.Array:
    """Each text without the words of its spans (from the first of each up to the word after it); null if no word is left."""
    out = []
    for text, parts in zip(column, found):
        text, parts = text.as_py(), parts.as_py()
        w = Words(large(pa.array([text])))
        chars = w.characters()
        starts = np.append(chars[w.starts], len(text))
        kept, at, left = [], 0, len(w)
        for a, b in sorted((p["start_word"], p["end_word"]) for p in parts):
            a, b = min(a, len(w)), min(b, len(w))
            kept.append(text[at : starts[a]])
            at = int(starts[b])
            left -= b - a
        out.append("".join([*kept, text[at:]]) if left > 0 else None)
    return pa.array(out, pa.string())


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without the copies of passages; a passage stays in the document of least id. Those of which nothing is left go; those without copies, and of null or empty texts, are unchanged. n_chars is the new length.

    Of rows that repeat an id the same words are cut; an empty table stays empty; other columns are passed on, whatever their names."""
    of, spans_ = (next(n for n in (f"_{k}{x}_" for x in range(1 << 30)) if n not in docs.columns) for k in ("of", "cut"))
    found = stored(repeats(docs).where("not is_first").groupBy(F.col("doc_id").alias(of)).agg(F.collect_list(F.struct("start_word", "end_word")).alias(spans_)))
    shorter = F.arrow_udf(cut, "string")
    joined = docs.join(found.hint("shuffle_hash"), F.col("doc_id").cast("long") == F.col(of), "left")
    same = joined.where(F.col(spans_).isNull()).select(docs.columns)
    less = joined.where(F.col(spans_).isNotNull() & F.col("text").isNotNull()).withColumn("text", shorter(F.col("text").cast("string"), F.col(spans_))).where("text is not null")
    if "n_chars" in docs.columns:
        less = less.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return same.unionByName(less.select(docs.columns))
