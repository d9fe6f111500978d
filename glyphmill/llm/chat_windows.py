"""Conversations as training windows of a token budget.

Prefix sums of the turns' tokens choose spans of whole turns. Each window begins with the conversation's system turns, repeats at
most a limited history of the turns before its span, and masks what it repeats: only assistant turns of its own span are targets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glyphmill.llm.session import table
from glyphmill.llm.token_counts import lengths

BUDGET, HISTORY, PER_TURN = 256, 2, 4


def chat_windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY, per_turn: int = PER_TURN, tokens: Column | None = None) -> DataFrame:
    """conv_id, window (from 0), first_turn and last_turn (of the span), n_history, n_tokens, n_target_tokens, text and target (for each part of the text, whether it is trained on).

    A turn has the tokens of its text (by the public tokenizer of token_counts, unless a column says otherwise), and per_turn more. System turns, wherever they stand, go to the head of every window. A span begins where the one before ended
    and takes turns as long as they fit the budget less the system turns; a turn that is too long for that alone makes a window by itself, whole and over the budget: nothing is cut or lost.
    History is the longest run of at most `history` turns right before the span that still fits.
    Null roles are "user"; null texts are empty; rows with a null conv_id or turn are left out; turns with equal numbers are ordered by role and text; repeated rows are kept.
    A conversation of system turns only gives no window; an empty table gives none. A very long turn is a window by itself; a very long conversation is one row until it is cut into windows. Other columns are left out."""
    role, text = F.coalesce(F.col("role"), F.lit("user")), F.coalesce(F.col("text"), F.lit(""))
    size = ((lengths(text) if tokens is None else tokens) + per_turn).cast("long")
    one = turns.where("conv_id is not null and turn is not null").select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), size.alias("n"))
    # prefix sums over the turns that aren't system turns; the same partitioning serves the grouping after them
    so_far = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = one.withColumn("upto", F.sum(F.when(F.col("role") == "system", 0).otherwise(F.col("n"))).over(so_far))
    whole = summed.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text", "n", "upto"))).alias("all"))
    split = whole.select("conv_id", F.filter("all", lambda t: t.role == "system").alias("sys"), F.filter("all", lambda t: t.role != "system").alias("ts")).where(F.size("ts") > 0)
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, t: s + t.n)
    based = split.withColumn("n_sys", total(F.col("sys")))
    room = F.lit(budget) - F.col("n_sys")

    def turn(i: Column) -> Column:
        return F.get("ts", i - 1)

    def between(low: Column, high: Column) -> Column:
        return turn(high).upto - turn(low).upto + turn(low).n

    # a span begins at i if the turns since the last beginning, with turn i, are more than the room
    begins = F.aggregate(F.sequence(F.lit(1), F.size("ts")), F.array(F.lit(1)), lambda b, i: F.when((i > F.element_at(b, -1)) & (between(F.element_at(b, -1), i) > room), F.concat(b, F.array(i))).otherwise(b))
    begun = based.withColumn("begins", begins)

    def span(first: Column, window: Column) -> Column:
        last = F.coalesce(F.get("begins", window + 1) - 1, F.size("ts"))
        reach = F.filter(F.sequence(F.lit(0), F.least(F.lit(history), first - 1)), lambda h: (h == 0) | (between(first - h, last) <= room))
        return F.struct(window.cast("long").alias("window"), F.array_max(reach).alias("h"), first.alias("first"), last.alias("last"))

    spans = begun.withColumn("spans", F.transform("begins", span))
    # only a window's own turns go on with it, not the whole conversation
    cut = F.transform("spans", lambda x: F.struct(x.window.alias("window"), x.h.alias("h"), F.slice("ts", x.first - x.h, x.last - x.first + x.h + 1).alias("shown")))
    each = spans.select("conv_id", "sys", "n_sys", F.explode(cut).alias("x")).select("conv_id", "sys", "n_sys", "x.*")
    own = F.slice("shown", F.col("h") + 1, F.size("shown"))
    is_target = F.transform("shown", lambda t, i: (i >= F.col("h")) & (t.role == "assistant"))
    return each.select(
        "conv_id",
        "window",
        F.get("shown", F.col("h")).turn.alias("first_turn"),
        F.element_at("shown", -1).turn.alias("last_turn"),
        F.col("h").cast("long").alias("n_history"),
        (F.col("n_sys") + total(F.col("shown"))).alias("n_tokens"),
        total(F.filter(own, lambda t: t.role == "assistant")).alias("n_target_tokens"),
        F.array_join(F.transform(F.concat("sys", "shown"), lambda t: F.concat(F.lit("<|"), t.role, F.lit("|>\n"), t.text)), "\n").alias("text"),
        F.array_join(F.transform(F.concat(F.transform("sys", lambda t: F.lit(False)), is_target), lambda m: F.when(m, F.lit("1")).otherwise(F.lit("0"))), "").alias("target"),
    )


def op10_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_windows(table(spark, sf_dir, "conversations"))


#: For tests: the same over conversations with a column n_tokens, as no SQL has the tokenizer.
OP10_SQL = rf"""
WITH RECURSIVE one AS (
  SELECT conv_id, turn, coalesce(role, 'user') AS role, coalesce(text, '') AS text,
         n_tokens + {PER_TURN} AS n
  FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
sys AS (SELECT conv_id, sum(n) AS n_sys, count(*) AS k_sys, string_agg('<|' || role || '|>' || chr(10) || text, chr(10) ORDER BY turn, text) AS s FROM one WHERE role = 'system' GROUP BY conv_id),
ts AS (
  SELECT o.*, row_number() OVER w AS i, sum(n) OVER w AS upto, coalesce(n_sys, 0) AS n_sys, coalesce(k_sys, 0) AS k_sys, s
  FROM one o LEFT JOIN sys USING (conv_id) WHERE role <> 'system'
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
walk AS (
  SELECT conv_id, i, 1::BIGINT AS first, 0::BIGINT AS win FROM ts WHERE i = 1
  UNION ALL
  SELECT t.conv_id, t.i, CASE WHEN t.upto - b.upto + b.n > {BUDGET} - t.n_sys THEN t.i ELSE w.first END,
         CASE WHEN t.upto - b.upto + b.n > {BUDGET} - t.n_sys THEN w.win + 1 ELSE w.win END
  FROM walk w JOIN ts t ON t.conv_id = w.conv_id AND t.i = w.i + 1 JOIN ts b ON b.conv_id = w.conv_id AND b.i = w.first),
spans AS (SELECT conv_id, win, min(first) AS first, max(i) AS last FROM walk GROUP BY conv_id, win),
reach AS (
  SELECT s.conv_id, s.win, max(h.h) AS h
  FROM spans s JOIN ts l ON l.conv_id = s.conv_id AND l.i = s.last CROSS JOIN (SELECT unnest(range({HISTORY} + 1)) AS h) h
  JOIN ts f ON f.conv_id = s.conv_id AND f.i = s.first - h.h
  WHERE h.h = 0 OR l.upto - f.upto + f.n <= {BUDGET} - l.n_sys GROUP BY s.conv_id, s.win)
SELECT s.conv_id, s.win AS "window", min(t.turn) FILTER (t.i = s.first) AS first_turn, min(t.turn) FILTER (t.i = s.last) AS last_turn, min(r.h)::BIGINT AS n_history,
       (min(t.n_sys) + sum(t.n))::BIGINT AS n_tokens, coalesce(sum(t.n) FILTER (t.i >= s.first AND t.role = 'assistant'), 0)::BIGINT AS n_target_tokens,
       coalesce(min(t.s) || chr(10), '') || string_agg('<|' || t.role || '|>' || chr(10) || t.text, chr(10) ORDER BY t.i) AS text,
       repeat('0', min(t.k_sys)::BIGINT) || string_agg(CASE WHEN t.i >= s.first AND t.role = 'assistant' THEN '1' ELSE '0' END, '' ORDER BY t.i) AS target
FROM spans s JOIN reach r ON r.conv_id = s.conv_id AND r.win = s.win JOIN ts t ON t.conv_id = s.conv_id AND t.i BETWEEN s.first - r.h AND s.last
GROUP BY s.conv_id, s.win
"""
