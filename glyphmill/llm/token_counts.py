"""Token counts by a public tokenizer, in Arrow functions that return lengths only."""

from __future__ import annotations

import base64
import re
from functools import lru_cache
from heapq import heappop, heappush

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.llm.arrays import slices
from glyphmill.llm.session import table

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The pattern above never matches across a white space that follows something else: a text may be cut there.
SAFE = re.compile(r"(?<=[^\s\x1c-\x1f\x85])(?=[ \n])")


@lru_cache(2)
def encoding(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, most: int) -> list[str]:
    """The text in pieces of at least so many characters each (but the last), cut at safe places only."""
    out, start = [], 0
    while len(text) - start > most:
        cut = SAFE.search(text, start + most)
        if not cut:
            break
        out.append(text[start : cut.start()])
        start = cut.start()
    out.append(text[start:])
    return out


def counted(texts: list[str | None], path: str, piece_chars: int, batch_bytes: int) -> list[int | None]:
    """Pieces of long texts and whole short ones, longest first, each into the batch of fewest bytes; each batch is encoded by one call."""
    work = [(len(p.encode()), i, p) for i, t in enumerate(texts) if t for p in ([t] if len(t) <= piece_chars else pieces(t, piece_chars))]
    work.sort(key=lambda x: -x[0])
    n = max(1, -(-sum(x[0] for x in work) // batch_bytes))
    batches: list[list[tuple[int, str]]] = [[] for _ in range(n)]
    lightest = [(0, k) for k in range(n)]
    for size, i, p in work:
        total, k = heappop(lightest)
        heappush(lightest, (total + size, k))
        batches[k].append((i, p))
    out: list[int | None] = [None if t is None else 0 for t in texts]
    for batch in batches:
        for (i, _), ids in zip(batch, encoding(path).encode_ordinary_batch([p for _, p in batch], num_threads=1)):
            out[i] += len(ids)
    return out


def lengths(text: F.Column, path: str = VOCABULARY, piece_chars: int = 50_000, batch_bytes: int = 1 << 20) -> F.Column:
    """The number of tokens of a text; null for null, 0 for empty."""

    @F.arrow_udf("long")
    def apply(column: pa.Array) -> pa.Array:
        out: list[int | None] = []
        for _, part in slices(column.cast(pa.large_string()), 4 * batch_bytes):  # at most so many batches are Python strings at once
            out += counted(part.to_pylist(), path, piece_chars, batch_bytes)
        return pa.array(out, pa.int64())

    return apply(text)


def token_counts(docs: DataFrame, path: str = VOCABULARY, piece_chars: int = 50_000, batch_bytes: int = 1 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and n_tokens: one row for each row. A null text has a null count, an empty one 0; a very long text is encoded in pieces, unless it has no place where one may cut; repeated rows repeat; other columns are left out; an empty table gives none."""
    return docs.select(F.col(id_col).alias("doc_id"), lengths(F.col(text_col).cast("string"), path, piece_chars, batch_bytes).alias("n_tokens"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
