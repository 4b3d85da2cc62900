"""Fenced blocks of marked-up texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FENCE = r"^\s*```[a-zA-Z]*\s*$"


def fenced_blocks(df: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc, block, lang, body): fences open and close in turn; an open last block counts.

    A fence is a line of three backticks and an optional tag of letters; any other tag makes it content.
    """
    lines = df.select(doc, F.posexplode(F.split(text, "\n")).alias("pos", "line")).withColumn("fence", F.col("line").rlike(FENCE))
    seen = F.sum(F.col("fence").cast("int")).over(Window.partitionBy(doc).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    inside = lines.withColumn("_c", seen).where("_c % 2 = 1").withColumn("block", F.expr("(_c + 1) div 2"))
    rows = F.array_sort(F.collect_list(F.when(~F.col("fence"), F.struct("pos", "line"))))
    tag = F.max(F.when(F.col("fence"), F.regexp_extract("line", "```([a-zA-Z]*)", 1)))
    return inside.groupBy(doc, "block").agg(tag.alias("lang"), F.array_join(F.transform(rows, lambda x: x["line"]), "\n").alias("body"))


def first_or_all(blocks: DataFrame, doc: str, lang: str, every: bool) -> DataFrame:
    """Each text's first block of the language, or all its blocks of it joined by line ends."""
    own = blocks.where(F.col("lang") == lang)
    if not every:
        return own.groupBy(doc).agg(F.min_by("body", "block").alias("body"))
    rows = F.array_sort(F.collect_list(F.struct("block", "body")))
    return own.groupBy(doc).agg(F.array_join(F.transform(rows, lambda x: x["body"]), "\n").alias("body"))
