"""The queries of this package, by name, and the SQL that tells their results where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from glyphmill.llm.chat_windows import op10_chat_windows
from glyphmill.llm.compact_windows import op7_compact_windows
from glyphmill.llm.decontamination import OP6_SQL, op6_decontamination
from glyphmill.llm.fingerprints import op3_fingerprints
from glyphmill.llm.html_content import op8_html_content
from glyphmill.llm.jaccard_join import OP9_SQL, op9_jaccard_join
from glyphmill.llm.language_id import op2_language_id
from glyphmill.llm.sentencepiece_codec import op5_sentencepiece
from glyphmill.llm.suffix_dedup import OP1_SQL, op1_suffix_dedup
from glyphmill.llm.token_counts import op4_token_counts


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_suffix_dedup, op2_language_id, op3_fingerprints, op4_token_counts, op5_sentencepiece, op6_decontamination, op7_compact_windows, op8_html_content, op9_jaccard_join, op10_chat_windows)}


def oracle_sql() -> dict[str, str]:
    return {"op1_suffix_dedup": OP1_SQL, "op6_decontamination": OP6_SQL, "op9_jaccard_join": OP9_SQL}
