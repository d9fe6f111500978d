"""SentencePiece encoding by a streaming Viterbi search, and decoding.

The lattice has a node for each boundary between characters and an edge for each piece. The public vocabulary is of the byte-pair kind: its segmentation is the only
path in which every two neighbours would also come of merging their own characters alone. That is a property of pairs, so that each
node keeps one backpointer: the piece by which it is reached from a node it fits to. Nodes further back than the longest piece can't be extended; when the
paths of all others run through one boundary, the ids up to it are final and leave the window.

Every path has a boundary before a space that follows something else, and around characters that no piece has. Segments between such places are
searched many at a time, in step; the ids of recent ones are kept, a bounded number of them. Long segments are streamed one by one.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.llm.arrays import U, large, mix, slices
from glyphmill.llm.session import released, table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Segments of which the ids are kept; characters above which a segment is streamed; segments searched in step.
KEPT, LONG, LANES = 200_000, 48, 10_000
SEGMENT = re.compile(r" *[^ \n]+|\n| +")
_BASE = U(0x9E3779B97F4A7C15)


class Vocabulary:
    """Pieces with " " for the mark of a space; ranks: the order of merging, 0 for single characters; left and right: of which pieces each was merged (-1: none)."""

    def __init__(self, path: str) -> None:
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.raw = [b""] * n
        self.byte = [-1] * 256
        scores, self.ids = {}, {}
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte[int(piece[3:5], 16)] = i
                self.raw[i] = bytes([int(piece[3:5], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.ids[text := piece.replace("▁", " ")] = i
                self.raw[i] = text.encode()
                scores[i] = sp.get_score(i)
        self.space = self.ids[" "]
        self.longest = max(map(len, self.ids))
        words = {t: i for t, i in self.ids.items() if t.strip(" ")}
        self.rank = np.zeros(n, np.int64)
        merged = sorted((t for t in words if len(t) > 1), key=lambda t: -scores[words[t]])
        for k, t in enumerate(merged):
            self.rank[words[t]] = k + 1
        pairs = {}
        for t in merged:
            for k in range(1, len(t)):
                if t[:k] in self.ids and t[k:] in self.ids:
                    pairs[self.ids[t[:k]], self.ids[t[k:]]] = words[t]
        self.pairs = pairs
        self.left, self.right = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        self._left, self._right, self._rank = self.left.tolist(), self.right.tolist(), self.rank.tolist()
        self.pieces = {t: i for t, i in words.items() if len(t) == 1} | {" ": self.space}
        for t in merged:  # a piece that its own characters don't merge to is never used
            for k in range(1, len(t)):
                a, b = self.pieces.get(t[:k], -1), self.pieces.get(t[k:], -1)
                i = words[t]
                if a >= 0 and b >= 0 and self._rank[a] < self._rank[i] and self._rank[b] < self._rank[i] and self._fits(a, b, self._rank[i]):
                    self._left[i], self._right[i], self.pieces[t] = a, b, i
                    break
        self.left[:], self.right[:] = self._left, self._right
        key = np.array([a * n + b for a, b in pairs], np.int64)
        by = np.argsort(key)
        self.pair_key, self.pair_rank = key[by], self.rank[np.array(list(pairs.values()))[by]]
        self.pair_seen = np.zeros(1 << 20, bool)
        self.pair_seen[self._slot(self.pair_key)] = True
        self.n = n
        hashes = np.array([_hash(t) for t in self.pieces], np.uint64)
        by = np.argsort(hashes)
        self.piece_hash, self.piece_id = hashes[by], np.array(list(self.pieces.values()), np.int64)[by]
        self.piece_seen = np.zeros(1 << 20, bool)
        self.piece_seen[(self.piece_hash >> U(44)).astype(np.int64)] = True
        self.sizes = np.zeros(1 << 16, np.uint64)  # by a hash of the last three characters: which lengths pieces that end so have
        for t in self.pieces:
            if len(t) >= 3:
                self.sizes[_hash(t[-3:]) >> 48] |= U(1 << len(t))
        self.lengths = sorted({len(t) for t in self.pieces}, reverse=True)
        self.decoded = pa.array(self.raw, pa.binary())
        self._runs: dict[int, list[int]] = {0: []}

    @staticmethod
    def _slot(key: np.ndarray) -> np.ndarray:
        return (key * 0x9E3779B1 >> 7) & ((1 << 20) - 1)

    def _fits(self, a: int, b: int, below: int = 1 << 60) -> bool:
        """Whether merging, until the rank below, leaves a boundary between a and b. The pieces at the boundary are undone, the later merge first, to those that stood there together; none of these may merge across it."""
        left, right, rank, pairs = self._left, self._right, self._rank, self.pairs
        until_a = until_b = below  # ranks of the merges that ended these pieces
        while True:
            over = pairs.get((a, b))
            if over is not None and rank[over] < until_a and rank[over] <= until_b and rank[over] < below:
                return False
            if rank[a] > rank[b]:
                until_a, a = rank[a], right[a]
            elif rank[b]:
                until_b, b = rank[b], left[b]
            else:
                return True

    @lru_cache(1 << 16)
    def fits(self, a: int, b: int) -> bool:
        return self._fits(a, b)

    def fit(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The same for many pairs at once."""
        ok = np.ones(len(a), bool)
        far = 1 << 60
        lane, a, b = np.arange(len(a)), a.copy(), b.copy()
        until_a, until_b = np.full(len(a), far), np.full(len(a), far)
        while len(lane):
            key = a * self.n + b
            on = np.flatnonzero(self.pair_seen[self._slot(key)])
            at = np.minimum(np.searchsorted(self.pair_key, key[on]), len(self.pair_key) - 1)
            hit = self.pair_key[at] == key[on]
            on, over = on[hit], self.pair_rank[at[hit]]
            bad = on[(over < until_a[on]) & (over <= until_b[on])]
            ok[lane[bad]] = False
            rank_a, rank_b = self.rank[a], self.rank[b]
            go = (rank_a > 0) | (rank_b > 0)
            go[bad] = False
            undo_a = rank_a > rank_b
            until_a, a = np.where(undo_a, rank_a, until_a), np.where(undo_a, self.right[a], a)
            until_b, b = np.where(undo_a, until_b, rank_b), np.where(undo_a, b, self.left[b])
            lane, a, b, until_a, until_b = lane[go], a[go], b[go], until_a[go], until_b[go]
        return ok

    def run(self, n: int) -> list[int]:
        """Ids of n spaces with nothing after that they merge with: all such merges rank alike, so that the leftmost possible one is always next."""
        if n not in self._runs:
            if n > 4096:  # the leftmost pieces are final: whatever follows, they can't grow
                head = self.run(4096)
                size = [len(self.raw[i]) for i in head]
                keep = len(head) - 4
                self._runs[n] = head[:keep] + self.run(n - sum(size[:keep]))
                return self._runs[n]
            parts = [1] * n
            k = 0
            while k + 1 < len(parts):
                if " " * (parts[k] + parts[k + 1]) in self.ids:
                    parts[k : k + 2] = [parts[k] + parts[k + 1]]
                    k = max(0, k - 1)
                else:
                    k += 1
            self._runs[n] = [self.ids[" " * p] for p in parts]
        return self._runs[n]

    def bytes_of(self, char: str) -> list[int]:
        return [self.byte[b] for b in char.encode()]


def _hash(text: str) -> int:
    h, mask = 0, 0xFFFFFFFFFFFFFFFF
    for c in text:
        h = h * int(_BASE) + ord(c) + 1 & mask
    for odd in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):  # as in mix()
        h = (h ^ h >> 33) * odd & mask
    return h ^ h >> 33


@lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def stream(chars: Iterable[str], v: Vocabulary) -> Iterator[list[int]]:
    """Final ids of a text's characters (with a space put before them by the caller), as soon as they are; characters may come one by one, and no more of them are held than the undecided ones."""
    window: list[str] = []  # characters since the last final boundary
    back: list[tuple[int, int]] = [(0, -1)]  # for each boundary of the window: where its last piece begins, and its id; (-1, -1): it can't be reached
    spaces = 0  # the window begins with so many, not yet decided
    last = -1  # the last final piece, -1 if nothing merges with it
    steps = 0

    def follow(at: int, upto: int = 0) -> list[int]:
        ids: list[int] = []
        while at > upto:
            at, piece = back[at]
            ids.append(piece)
        return ids[::-1]

    def close() -> list[int]:
        out = follow(len(window), spaces)
        if out and back_start(len(window)) == spaces - 1:
            return v.run(spaces - 1) + out
        return v.run(spaces) + out

    def back_start(at: int) -> int:
        while at > spaces:
            at = back[at][0]
        return at

    for c in chars:
        if c not in v.pieces:
            yield close() + v.bytes_of(c)
            window, back, spaces, last = [], [(0, -1)], 0, -1
            continue
        if c == " ":
            if len(window) > spaces:  # every path has a boundary here
                yield close()
                window, back, spaces, last = [], [(0, -1)], 0, -1
            window.append(c)
            spaces += 1
            back.append((spaces - 1, v.space))
            continue
        window.append(c)
        n = len(window)
        found = (-1, -1)
        for size in range(min(v.longest, n), 0, -1):
            begin = n - size
            if begin < spaces - 1 or back[begin][0] < 0 and begin:
                continue
            piece = v.pieces.get("".join(window[begin:]))
            if piece is None:
                continue
            before = back[begin][1] if begin else last
            if before < 0 or begin == spaces - 1 or v.fits(before, piece):
                found = (begin, piece)
                break
        back.append(found)
        steps += 1
        if steps % v.longest == 0 and n > 2 * v.longest:
            alive = {k for k in range(n - v.longest, n + 1) if back[k][0] >= 0}
            while len(alive) > 1:
                most = max(alive)
                alive.remove(most)
                alive.add(back[most][0])
            met = alive.pop()
            if met > spaces:
                ids = follow(met, spaces)
                yield v.run(spaces - (back_start(met) == spaces - 1)) + ids
                last = ids[-1]
                window, spaces = window[met:], 0
                back = [(0, -1)] + [(a - met if a >= met else -1, p) for a, p in back[met + 1 :]]
    yield close()


def search(segments: list[str], v: Vocabulary) -> list[bytes]:
    """The ids (as the bytes of 32-bit integers) of segments, each of spaces and then other characters, all of them in pieces: the same search in step, a character of every segment at a time."""
    size = np.array([len(s) for s in segments])
    order = np.argsort(-size, kind="stable")
    size = size[order]
    m, width = len(segments), int(size[0])
    chars = np.zeros((m, width), np.uint32)  # longest segments first
    chars[np.arange(width) < size[:, None]] = np.frombuffer("".join([segments[k] for k in order]).encode("utf-32-le"), np.uint32)
    chars = np.ascontiguousarray(chars.T)
    spaces = np.cumprod(chars == 32, axis=0).sum(0)
    total = np.zeros((width + 1, m), np.uint64)
    for j in range(width):
        total[j + 1] = total[j] * _BASE + chars[j].astype(np.uint64) + U(1)
    power = np.concatenate([[U(1)], np.cumprod(np.full(width + 1, _BASE, np.uint64))])
    piece = np.full((width + 1, m), -1, np.int32)  # the last piece of each boundary's path
    begin = np.full((width + 1, m), -1, np.int32)
    for j in range(int(spaces.max()) + 1):
        on = spaces >= j
        piece[j, on], begin[j, on] = v.space if j else -1, 0
    lives = np.searchsorted(-size, -np.arange(width + 1), "right").tolist()  # segments of so many characters at least
    for j in range(1, width + 1):
        open_ = np.flatnonzero(spaces[: lives[j]] < j)
        if j >= 3:
            sizes = v.sizes[(mix(total[j, open_] - total[j - 3, open_] * power[3]) >> U(48)).astype(np.int64)]
        for length in v.lengths:
            if length > j:
                continue
            i = j - length
            lane = open_[(sizes >> np.uint64(length) & U(1)) == 1] if length >= 3 else open_
            lane = lane[(begin[j, lane] < 0) & (spaces[lane] - 1 <= i) & (begin[i, lane] >= 0)]
            if not len(lane):
                continue
            h = mix(total[j, lane] - total[i, lane] * power[length])
            seen = v.piece_seen[(h >> U(44)).astype(np.int64)]
            lane, h = lane[seen], h[seen]
            at = np.minimum(np.searchsorted(v.piece_hash, h), len(v.piece_hash) - 1)
            same = v.piece_hash[at] == h
            lane, new = lane[same], v.piece_id[at[same]]
            if not len(lane):
                continue
            ok = (i == 0) | (spaces[lane] - 1 == i)
            check = np.flatnonzero(~ok)
            if len(check):
                ok[check] = v.fit(piece[i, lane[check]].astype(np.int64), new[check])
            lane = lane[ok]
            piece[j, lane], begin[j, lane] = new[ok], i
    steps, at, lanes = [], size.copy(), np.arange(m)
    lane = lanes[at > spaces]
    while len(lane):
        here = at[lane]
        steps.append((lane, piece[here, lane]))
        at[lane] = begin[here, lane]
        lane = lane[at[lane] > spaces[lane]]
    count = np.bincount(np.concatenate([x for x, _ in steps]), minlength=m) if steps else np.zeros(m, int)
    end = np.cumsum(count)
    flat_ids = np.zeros(int(end[-1]), np.int32)
    for k, (lane, ids) in enumerate(steps):
        flat_ids[end[lane] - 1 - k] = ids
    data, out = flat_ids.tobytes(), [b""] * m
    heads = {n: np.array(v.run(n), np.int32).tobytes() for n in np.unique(at).tolist()}
    for k, a, b, n in zip(order.tolist(), ((end - count) * 4).tolist(), (end * 4).tolist(), at.tolist()):
        out[k] = heads[n] + data[a:b]
    return out


class Encoder:
    """Ids of texts; it keeps those of recent segments."""

    def __init__(self, path: str) -> None:
        self.v = vocabulary(path)
        self.known: dict[str, bytes] = {}
        self.plain = re.compile("[" + re.escape("".join(t for t in self.v.pieces if len(t) == 1)) + "]*")

    def learn(self, segments: Iterable[str]) -> None:
        short = []
        for s in segments:
            if len(s) <= LONG and self.plain.fullmatch(s):
                short.append(s)
            else:
                self.known[s] = np.array([i for ids in stream(s, self.v) for i in ids], np.int32).tobytes()
        short.sort(key=len)
        for k in range(0, len(short), LANES):
            part = short[k : k + LANES]
            self.known.update(zip(part, search(part, self.v)))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text, as the bytes of 32-bit integers; nothing for null and empty texts."""
        split = [SEGMENT.findall(" " + t) if t else [] for t in texts]
        known = self.known
        new = {s for parts in split for s in parts if s not in known}
        if len(known) + len(new) > KEPT:
            known.clear()
            new = {s for parts in split for s in parts}
        self.learn(new)
        out = [b"".join([known[s] for s in parts]) for parts in split]
        for s in [s for s in new if len(s) > LONG]:
            del known[s]
        return out


@lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encode(column: pa.Array, path: str) -> pa.ListArray:
    """The ids of each text of a string array; null for null."""
    e = encoder(path)
    data, sizes = [], []
    for _, part in slices(column.cast(pa.large_string()), 1 << 19):
        ids = e.encode(part.to_pylist())
        sizes += [len(x) // 4 for x in ids]
        data.append(b"".join(ids))
    offsets = np.zeros(len(column) + 1, np.int32)
    np.cumsum(np.array(sizes, np.int64), out=offsets[1:])
    released()
    mask = np.append(np.asarray(column.is_null()), False) if column.null_count else None
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32(), mask=mask), pa.array(np.frombuffer(b"".join(data), np.int32)))


def encoded(text: F.Column, path: str = MODEL) -> F.Column:
    """array<int> of the ids of a text; null for null, empty for empty."""

    @F.arrow_udf("array<int>")
    def apply(column: pa.Array) -> pa.Array:
        return encode(column, path)

    return apply(text)


def decode(rows: pa.Array, v: Vocabulary) -> pa.Array:
    offsets, values = np.asarray(rows.offsets).astype(np.int64), np.asarray(rows.values)
    out = []
    at = 0
    valid = np.asarray(rows.is_valid())
    while at < len(rows):
        upto = max(at + 1, int(np.searchsorted(offsets, offsets[at] + (1 << 18), "right")) - 1)
        part = values[offsets[at] : offsets[upto]].astype(np.int64)
        part = np.where((part >= 0) & (part < v.n), part, 0)
        got = v.decoded.take(pa.array(part))
        ends = np.frombuffer(got.buffers()[1], np.int32)[: len(part) + 1] if len(part) else np.zeros(1, np.int32)
        data = got.buffers()[2].to_pybytes() if len(part) and got.buffers()[2] is not None else b""
        cut = ends[offsets[at : upto + 1] - offsets[at]]
        for k in range(upto - at):
            one = data[cut[k] : cut[k + 1]].decode("utf-8", "replace")
            out.append((one[1:] if one[:1] == " " else one) if valid[at + k] else None)
        at = upto
    return pa.array(out, pa.string())


def decoded(ids: F.Column, path: str = MODEL) -> F.Column:
    """The text of ids, without the space that encoding puts first; ids that stand for nothing add nothing, bytes that aren't UTF-8 become U+FFFD; null for null."""

    @F.arrow_udf("string")
    def apply(column: pa.Array) -> pa.Array:
        return decode(column, vocabulary(path))

    return apply(ids)


def coded(batches: Iterator[pa.Array], path: str) -> Iterator[tuple[pa.Array, pa.Array, pa.Array]]:
    """Slices of the texts of batches, their ids and what these give back: what a worker holds besides a batch is a slice's, not a batch's, which may be 64 MB."""
    for column in batches:
        for _, part in slices(column.cast(pa.large_string()), 1 << 19):
            ids = encode(part, path)
            yield part, ids, decode(ids, vocabulary(path))


def codec(docs: DataFrame, path: str = MODEL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids and decoded (the text that the ids give back, which equals the one encoded): one row for each row.

    Ids are those of the SentencePiece library, but that a U+2581 in a text is encoded by its bytes and not taken for a space, so that decoding gives every text back.
    A null text has null ids, an empty one no ids; long runs without a boundary are streamed through a bounded window, however long the text; ties can't be, as the path is unique; repeated rows repeat; other columns are left out; an empty
    table gives none. A vocabulary's file must be readable by all executors."""

    # both ways in one function: decoding a column that another function gives would encode it a second time
    @F.arrow_udf("struct<ids:array<int>,decoded:string>")
    def both(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for _, ids, text in coded(batches, path):
            yield pa.StructArray.from_arrays([ids, text], ["ids", "decoded"])

    return docs.select(F.col(id_col).alias("doc_id"), both(F.col(text_col).cast("string")).alias("r")).select("doc_id", "r.*")


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codec(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' columns but text and n_chars, with ids, n_tokens and round_trip (whether decoding the ids gives the text back): one row for each row.

    Of a null text all three are null; an empty text has no ids, and comes back; very long texts are encoded through a bounded window; repeated rows repeat; columns called ids, n_tokens, round_trip or _codec_ are replaced; an empty table gives none."""

    @F.arrow_udf("struct<ids:array<int>,round_trip:boolean>")
    def both(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        try:
            for part, ids, text in coded(batches, MODEL):
                yield pa.StructArray.from_arrays([ids, pc.equal(text, part.cast(pa.string()))], ["ids", "round_trip"])
        finally:  # what other stages left of an executor's memory is less than a query has
            encoder(MODEL).known.clear()
            released()

    kept = [c for c in docs.columns if c not in ("text", "n_chars", "ids", "n_tokens", "round_trip", "_codec_")]
    found = docs.withColumn("_codec_", both(F.col("text").cast("string")))
    return found.select(*kept, "_codec_.ids", F.when(F.col("_codec_.ids").isNotNull(), F.size("_codec_.ids")).alias("n_tokens"), "_codec_.round_trip")
