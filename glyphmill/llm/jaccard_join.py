"""Documents whose sets of word n-grams have a Jaccard similarity of at least a threshold, by a token-group matrix.

Documents of one set are one class from the start. Min-hash bands bring classes that may be similar to the same shards (each has the least id of a
band's documents for its leader). Inside a shard the sets, ordered so that those linked by min-hashes are neighbours, are partitioned into groups; a matrix holds
for each group which n-grams its sets have between them. A set's overlap with a group's union bounds that with each of its members: only groups
where the bound reaches the threshold are opened, and there all overlaps are counted exactly. Links are counted where they are found and not listed, so
that what is shuffled and returned grows with the documents. Every similarity is exact; a pair of similarity s is missed with probability (1 - s^ROWS)^BANDS, 0.001 at 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.llm.arrays import U, WORD_RE2, Words, grams, large, lists, mix, signed, slices
from glyphmill.llm.groups import components, gathered, led, runs
from glyphmill.llm.session import counted, stored, table, texts, tidied

N, THRESHOLD, BANDS, ROWS, GROUP = 3, 0.5, 24, 2, 64
#: Bytes of text in one shard, about; a leader's documents of more are cut into blocks, and any two blocks share a shard.
SHARD_BYTES = 16 << 20
#: What is broadcast has at most so many bytes; of more, both sides are shuffled.
SMALL_BYTES = 32 << 20


def gram_sets(column: pa.Array, n: int) -> Iterator[np.ndarray]:
    """The sorted distinct n-grams of each text; a text of fewer words has one of all its words, and one of none has none."""
    w = Words(column)
    g = grams(w.hashes, n)
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist()):
        if b - a >= n:
            yield np.unique(g[a : b - n + 1])
        else:
            yield grams(w.hashes[a:b], b - a) if b > a else np.zeros(0, np.uint64)


def signatures(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """doc_id, whole (a hash of the set), bands, and the bytes of the text, for each document with words."""
    factor = np.random.Generator(np.random.PCG64(7)).integers(0, 2**63, bands * rows, dtype=np.uint64) * U(2) + U(1)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.asarray(batch.column(0))
            for first, part in slices(large(batch.column(1))):
                sets = list(gram_sets(part, n))
                some = np.array([i for i, s in enumerate(sets) if len(s)], int)
                if not len(some):
                    continue
                every = np.concatenate([sets[i] for i in some])
                size = np.array([len(sets[i]) for i in some])
                begin = np.cumsum(size) - size
                whole = mix(np.add.reduceat(every, begin) + mix(size.astype(np.uint64)))  # as set_hash
                key = np.zeros((len(some), bands), np.uint64)
                for k, f in enumerate(factor):
                    key[:, k // rows] = mix(key[:, k // rows] + np.minimum.reduceat(every * f, begin) + U(k))
                length = np.asarray(pc.binary_length(part))[some]
                yield pa.RecordBatch.from_arrays([pa.array(ids[first + some]), pa.array(signed(whole)), lists(pa.array(signed(key.ravel())), np.full(len(some), bands)), pa.array(length)], ["doc_id", "whole", "bands", "bytes"])

    return docs.mapInArrow(tidied(apply), "doc_id long, whole long, bands array<long>, bytes long")


def similar(sets: list[np.ndarray], threshold: float, group: int = GROUP, opened_share: list | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """i < j and the similarity of all pairs of sets that reach the threshold, group by group: the token-group matrix of one shard. opened_share: gets the numbers of rows of groups opened and of all that there are."""
    m = len(sets)
    size = np.array([len(s) for s in sets])
    begin = np.cumsum(size) - size
    every = np.concatenate(sets)
    alike = np.arange(m)  # sets that share a min-hash, or are linked by others that do
    for k in 2 * list(range(4)):
        _, of = np.unique(np.minimum.reduceat(mix(every + U(k)), begin), return_inverse=True)
        first = np.full(m, m)
        np.minimum.at(first, of, alike)
        alike = first[of]
    order = np.lexsort((size, alike))
    _, token = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True)
    row = np.repeat(np.arange(m), size[order])
    shared = np.bincount(token) > 1  # an n-gram of one document overlaps with nothing
    number = np.cumsum(shared) - 1
    row, token = row[shared[token]], number[token[shared[token]]]
    v, by_order = int(shared.sum()), size[order].astype(float)
    begin = np.searchsorted(row, np.arange(m + 1))
    for g0 in range(0, m, group):
        g1 = min(m, g0 + group)
        union = np.zeros(v, bool)
        union[token[begin[g0] : begin[g1]]] = True
        # queries: the documents from this group on, so that each pair is met once
        overlap = np.add.reduceat(np.append(union[token[begin[g0] :]], False).astype(np.int32), begin[g0:m] - begin[g0])
        overlap[begin[g0 + 1 :] == begin[g0:m]] = 0
        q_size, low, high = by_order[g0:], by_order[g0:g1].min(), by_order[g0:g1].max()
        qualifies = (overlap >= threshold / (1 + threshold) * (q_size + low) - 1e-9) & (high >= threshold * q_size - 1e-9) & (low * threshold <= q_size + 1e-9)
        opened = g0 + np.flatnonzero(qualifies)
        if opened_share is not None:
            opened_share.append((len(opened), m - g0))
        column = np.cumsum(union) - 1
        width = int(union.sum())
        gc, gr = column[token[begin[g0] : begin[g1]]], row[begin[g0] : begin[g1]] - g0
        for q0 in range(0, len(opened), 256):
            q = opened[q0 : q0 + 256]
            inter = np.zeros((len(q), g1 - g0), np.float32)
            cells = np.concatenate([np.arange(begin[i], begin[i + 1]) for i in q])
            local = np.repeat(np.arange(len(q)), begin[q + 1] - begin[q])
            hit = union[token[cells]]
            qr, qc = local[hit], column[token[cells[hit]]]
            for c0 in range(0, width, 8192):
                c1 = min(width, c0 + 8192)
                a, b = np.zeros((len(q), c1 - c0), np.float32), np.zeros((g1 - g0, c1 - c0), np.float32)
                on = (qc >= c0) & (qc < c1)
                a[qr[on], qc[on] - c0] = 1
                on = (gc >= c0) & (gc < c1)
                b[gr[on], gc[on] - c0] = 1
                inter += a @ b.T
            inter = inter.astype(float)
            score = inter / (by_order[q][:, None] + by_order[g0:g1][None, :] - inter)
            i, j = np.nonzero((score >= threshold) & (q[:, None] > np.arange(g0, g1)[None, :]))
            if len(i):
                x, y = order[q[i]], order[g0 + j]
                yield np.minimum(x, y), np.maximum(x, y), score[i, j]


def sharded(docs: DataFrame, n: int, threshold: float, bands: int, rows: int, shard_bytes: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The documents as (whole, doc_id); those that stand for their set, as (whole, doc_id, n, bands); and (leader, salt, doc_id, block, leaders, n, whole, text), sorted by leader, salt and doc_id in each partition."""
    every = stored(signatures(docs, n, bands, rows).groupBy("doc_id").agg(F.min(F.struct("whole", "bands", "bytes")).alias("s")).select("doc_id", "s.*"))
    one = stored(every.groupBy("whole").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"), F.first("bands").alias("bands"), F.max("bytes").alias("bytes")))
    keys = one.select("doc_id", F.posexplode("bands").alias("band", "key")).select("doc_id", F.xxhash64("band", "key").alias("key"))
    edges = stored(led(keys).groupBy("doc_id").agg(F.sort_array(F.collect_set("leader")).alias("leaders")).join(one.select("doc_id", "n", "whole", "bytes"), "doc_id"))
    met = gathered(edges, docs).withColumn("leader", F.explode("leaders")).select("leader", "doc_id", "leaders", "n", "whole", "text")
    hot, size = counted(edges.select(F.explode("leaders").alias("leader"), "bytes").groupBy("leader").agg(F.sum("bytes").alias("bytes")).where(F.col("bytes") > shard_bytes).select("leader", F.ceil(F.col("bytes") / shard_bytes).cast("int").alias("salts")))
    salted = met.join(F.broadcast(hot) if size["n"] * 64 <= SMALL_BYTES else hot, "leader", "left").withColumn("salts", F.coalesce("salts", F.lit(1))).withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("salts")).cast("int"))
    tasks = salted.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).withColumn("salt", (F.least("block", "other") * 32768 + F.greatest("block", "other")).cast("int")).select("leader", "salt", "doc_id", "block", "leaders", "n", "whole", "text")
    return every, one, tasks.repartition("leader", "salt").sortWithinPartitions("leader", "salt", "doc_id")


def shard_sets(run: pa.Table, n: int) -> tuple[pa.Table, list[np.ndarray]]:
    """The rows of a shard, one for each document (of texts of one id, that whose set is meant), and their sets."""
    sets = [s for _, part in slices(large(run.column("text"))) for s in gram_sets(part, n)]
    ids, whole = np.asarray(run.column("doc_id")), np.asarray(run.column("whole"))
    repeats = np.append(False, ids[1:] == ids[:-1])
    if repeats.any():
        repeats |= np.append(repeats[1:], False)
        meant = [not r or signed(set_hash(s)).tolist() == [w] for s, r, w in zip(sets, repeats, whole.tolist())]
        at = np.flatnonzero(meant)
        at = at[np.append(True, ids[at][1:] != ids[at][:-1])]
        return run.take(pa.array(at)), [sets[i] for i in at]
    return run, sets


def set_hash(s: np.ndarray) -> np.ndarray:
    return mix(np.array([s.sum(dtype=np.uint64)]) + mix(np.array([len(s)], np.uint64)))


FOUND = "doc_id long, root long, n_links long, max_jaccard double"


def near_documents(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, shard_bytes: int = SHARD_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, class_id (the least document of its connected component), n_links (the other documents of a similarity at or above the threshold, copies included) and max_jaccard (the largest of these similarities): one row for each document with a link.

    Links are counted once each, in the shard of the least leader that two documents have in common. Documents with null id or text, or without a word, have no row; a text of fewer than n words has one n-gram of all
    its words; very long texts are sets like others; ties don't matter; rows that repeat an id are one document, of which the text with the least hash of its set counts; other columns are left out; an empty table gives no rows."""
    every, one, shards = sharded(texts(docs, id_col, text_col), n, threshold, bands, rows, shard_bytes)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in by_two(batches):
            run, sets = shard_sets(run, n)
            m = len(sets)
            if m < 2:
                continue
            ids, count, block = (np.asarray(run.column(k).combine_chunks()) for k in ("doc_id", "n", "block"))
            apart = run.column("salt")[0].as_py()
            apart = apart >> 15 != apart & 0x7FFF
            leader, leaders = run.column("leader")[0].as_py(), run.column("leaders").combine_chunks()
            least = np.asarray(leaders.flatten())[np.asarray(leaders.offsets)[:-1] - leaders.offsets[0].as_py()]
            earlier: dict[int, set[int]] = {}
            links, best, root = np.zeros(m, np.int64), np.zeros(m), np.arange(m)
            for i, j, score in similar(sets, threshold):
                if apart:
                    ok = block[i] != block[j]
                    i, j, score = i[ok], j[ok], score[ok]
                # a pair is counted by the first shard that both are in
                ok = np.ones(len(i), bool)
                for k in np.flatnonzero((least[i] < leader) & (least[j] < leader)).tolist():
                    for x in (int(i[k]), int(j[k])):
                        if x not in earlier:
                            earlier[x] = {y for y in leaders[x].as_py() if y < leader}
                    ok[k] = earlier[int(i[k])].isdisjoint(earlier[int(j[k])])
                i, j, score = i[ok], j[ok], score[ok]
                links += np.bincount(i, count[j], m).astype(np.int64) + np.bincount(j, count[i], m).astype(np.int64)
                np.maximum.at(best, i, score)
                np.maximum.at(best, j, score)
                root = rooted(root, i, j)
            on = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays([pa.array(ids[on]), pa.array(ids[root[on]]), pa.array(links[on]), pa.array(best[on])], ["doc_id", "root", "n_links", "max_jaccard"])

    found = stored(shards.mapInArrow(tidied(apply), FOUND))
    parts = components(found.select(F.col("doc_id").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("doc_id").agg(F.sum("n_links").alias("n_links"), F.max("max_jaccard").alias("max_jaccard"))
    linked = one.select("doc_id", "n", "whole").join(links, "doc_id", "left").where("n > 1 or n_links is not null").join(parts, "doc_id", "left")
    of = linked.select("whole", F.coalesce("group_id", "doc_id").alias("class_id"), (F.coalesce("n_links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.when(F.col("n") > 1, 1.0).otherwise(F.col("max_jaccard")).alias("max_jaccard"))
    return every.select("doc_id", "whole").join(of.hint("shuffle_hash"), "whole").select("doc_id", "class_id", "n_links", "max_jaccard")


def rooted(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The roots after joining the classes of i and j: the least of each connected component."""
    while True:
        new = root.copy()
        low = np.minimum(root[i], root[j])
        for x in (i, j, root[i], root[j]):
            np.minimum.at(new, x, low)
        new = np.minimum(new, new[new])
        if (new == root).all():
            return root
        root = new


def by_two(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each leader and salt."""
    for run in runs(batches):
        yield from runs(iter(run.combine_chunks().to_batches()), 1)


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_documents(table(spark, sf_dir, "documents"))


#: By brute force over all pairs that share an n-gram.
OP9_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(text), '{WORD_RE2}') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < {N} THEN w ELSE w[i : i + {N - 1}] END AS g FROM w, unnest(range(1, greatest(2, len(w) - {N - 2}))) AS r(i) WHERE len(w) > 0),
k AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
c AS (SELECT x.doc_id AS doc_a, y.doc_id AS doc_b, count(*) AS hits FROM g x JOIN g y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
p AS (SELECT doc_a, doc_b, hits::DOUBLE / (a.n + b.n - hits)::DOUBLE AS jaccard FROM c JOIN k a ON a.doc_id = doc_a JOIN k b ON b.doc_id = doc_b WHERE hits::DOUBLE / (a.n + b.n - hits)::DOUBLE >= {THRESHOLD}),
reach AS (SELECT doc_a AS doc_id, doc_a AS member FROM p UNION SELECT reach.doc_id, p.doc_b FROM reach JOIN p ON p.doc_a = reach.member),
l AS (SELECT doc_id, min(member) AS class_id FROM reach GROUP BY doc_id)
SELECT doc_id, class_id, count(*)::BIGINT AS n_links, max(jaccard) AS max_jaccard FROM p JOIN l ON l.doc_id = p.doc_a GROUP BY doc_id, class_id
"""


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document of the least id; all other documents, too, unchanged: null, empty and wordless texts are in no group.

    Of rows that repeat an id in a group, all stay or go. An empty table stays empty."""
    gone, size = counted(near_documents(docs).where("doc_id <> class_id").select(F.col("doc_id").alias("_gone_")))
    small = size["n"] * 16 <= SMALL_BYTES
    return docs.join(gone.hint("broadcast" if small else "shuffle_hash"), F.col("doc_id").cast("long") == F.col("_gone_"), "left_anti")
