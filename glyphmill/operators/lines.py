"""Lines of text as rows, and runs of consecutive ones as groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lines(df: DataFrame, id_col: str, text: Column) -> DataFrame:
    """(id, line from 1, text) of each line."""
    return df.select(F.col(id_col), F.posexplode(F.split(text, "\n")).alias("line", "text")).withColumn("line", F.col("line").cast("long") + 1)


def grouped_comments(rows: DataFrame, id_col: str, mark: str = "//", by: tuple[str, ...] = ()) -> DataFrame:
    """Comments of lines (id, line, text) that have only white space before the mark: those on consecutive lines, equally indented, are one, their texts joined by line breaks.

    One shuffle by id and indent; the group is the line's number less its place among its like."""
    pattern = rf"^([ \t]*)\Q{mark}\E([^\n]*)$"
    found = rows.where(F.col("text").rlike(pattern)).select(id_col, "line", F.regexp_extract("text", pattern, 1).alias("indent"), F.regexp_extract("text", pattern, 2).alias("comment"))
    island = F.col("line") - F.row_number().over(Window.partitionBy(id_col, "indent").orderBy("line"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "comment"))), lambda x: x["comment"]), "\n")
    return found.withColumn("island", island).groupBy(id_col, "indent", "island").agg(F.min("line").alias("line"), F.count("*").alias("n_lines"), joined.alias("comment")).drop("island")
