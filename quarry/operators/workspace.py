"""A workspace as a table of versions: pushes are appended, nothing is rewritten, any version can be read.

A push names the segments that it may bring (none named: all) and has, for each segment, the pieces that
were matched with it. Pieces of other segments are evicted: they are kept as such rows, and count nowhere.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS = "version long, segment string, piece string, text string, ord long, evicted boolean"


def judged(pushes: DataFrame, allowed: DataFrame) -> DataFrame:
    """pushes (version, segment, piece, text, ord) with evicted; allowed: version, segment; a version without rows there may bring all."""
    some = allowed.select("version").where("version is not null").distinct().withColumn("_some", F.lit(True))
    may = allowed.select("version", "segment").distinct().withColumn("_may", F.lit(True))
    rows = pushes.select("version", "segment", "piece", "text", "ord").where("version is not null and segment is not null and piece is not null")
    met = rows.join(some, "version", "left").join(may, ["version", "segment"], "left")
    return met.select("version", "segment", "piece", "text", "ord", (F.col("_some").isNotNull() & F.col("_may").isNull()).alias("evicted"))


def append(path: str, pushes: DataFrame, allowed: DataFrame) -> None:
    """Adds a batch of pushes to the table at path, a folder for each version."""
    judged(pushes, allowed).write.mode("append").partitionBy("version").parquet(path)


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The rows up to a version; later folders aren't read."""
    rows = spark.read.schema(ROWS).parquet(path)
    return rows if version is None else rows.where(F.col("version") <= version)


def forward(rows: DataFrame) -> DataFrame:
    """(segment, piece, ord): what each segment came to: the pieces of the last push that brought it."""
    good = rows.where("not evicted")
    last = good.groupBy("segment").agg(F.max("version").alias("version"))
    return good.join(last, ["segment", "version"]).groupBy("segment", "piece").agg(F.min("ord").alias("ord"))


def back(rows: DataFrame) -> DataFrame:
    """(piece, segments): all segments that a piece was ever brought for, in order."""
    return rows.where("not evicted").groupBy("piece").agg(F.array_sort(F.collect_set("segment")).alias("segments"))


def code(rows: DataFrame) -> DataFrame:
    """(piece, text, version, ord): each piece as pushed last; of several rows in one push the last by ord, then by text."""
    last = F.max(F.struct("version", "ord", "text")).alias("last")
    return rows.where("not evicted").groupBy("piece").agg(last).select("piece", "last.text", "last.version", "last.ord")


def of_dependencies(rows: DataFrame, uses: DataFrame) -> DataFrame:
    """(segment, piece, text): the pieces of the segments that each segment uses; uses: src, dst."""
    pieces = forward(rows).join(code(rows).select("piece", "text"), "piece").select(F.col("segment").alias("dst"), "piece", "text")
    return uses.where("src <> dst").select("src", "dst").distinct().join(pieces, "dst").select(F.col("src").alias("segment"), "piece", "text").distinct()
