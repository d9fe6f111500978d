"""The pipeline and the checker over streams: no state is kept, as every chunk is checked by itself against a static dictionary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.model import Step
from glyphmill.operators import check
from glyphmill.plans import pipeline


def misspelled_stream(files: DataFrame, steps: list[Step], dictionary: DataFrame, pattern: str = check.WORD) -> DataFrame:
    """(src_id, path, context, category, word): the unknown words of files (src_id, context, raw) as they arrive. A word that a chunk has twice comes once.

    The dictionary, which must be small enough to be broadcast, is joined as a static side, so that the stream needs neither watermark nor state."""
    head, rest = steps[0], steps[1:]
    known = head.categories()
    chunks = pipeline.apply(pipeline.first(files, head), rest, set(known) if known is not None else None)
    words = chunks.where("error is null and text is not null").select("src_id", "path", "context", "category", F.explode(F.array_distinct(check.words(F.col("text"), pattern))).alias("word"))
    return check.unknown(words, dictionary)
