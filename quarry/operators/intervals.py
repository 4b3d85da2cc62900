"""Intervals per key: maximal ones, containment lookups, running offsets. All ends are inclusive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def maximal_intervals(df: DataFrame, key: str = "file", start: str = "start", end: str = "end") -> DataFrame:
    """Distinct intervals that no other of the key contains.

    One pass in the order of start, longest first: an interval is contained if an earlier one reaches as
    far. No self-join, so a key's intervals cost a sort.
    """
    order = Window.partitionBy(key).orderBy(F.col(start), F.col(end).desc()).rowsBetween(Window.unboundedPreceding, -1)
    rows = df.select(key, start, end).where(F.col(start).isNotNull() & F.col(end).isNotNull()).distinct()
    return rows.withColumn("_reach", F.max(end).over(order)).where("_reach is null or _reach < `%s`" % end).drop("_reach")


def _classes(start: Column, end: Column, width: int) -> tuple[Column, Column]:
    """The size class of an interval and the width of its bins: `width`, eight times that, and so on, the first that isn't shorter."""
    size = F.greatest(end - start + 1, F.lit(1)).cast("double")
    level = F.greatest(F.ceil(F.log(size / width) / F.log(F.lit(8.0)) - 1e-9), F.lit(0)).cast("int")
    return level, F.call_function("shiftleft", F.lit(width).cast("long"), (level * 3).cast("int"))


def _in_bins(probes: DataFrame, segments: DataFrame, key: str, width: int, how: str) -> DataFrame:
    """containment_join with the length (_level) and bin (_bin) in which each probe stands."""
    level, size = _classes(F.col("ss"), F.col("se"), width)
    binned = segments.where("ss is not null and se is not null").withColumn("_slevel", level).withColumn("_sbin", F.explode(F.sequence(F.floor(F.col("ss") / size), F.floor(F.greatest("ss", "se") / size))))
    levels = segments.where("ss is not null and se is not null").select(level.alias("_level")).union(segments.sparkSession.range(1).select(F.col("id").cast("int"))).distinct()
    at = probes.crossJoin(F.broadcast(levels)).withColumn("_bin", F.floor(F.col("ps") / F.call_function("shiftleft", F.lit(width).cast("long"), (F.col("_level") * 3).cast("int"))))  # a dozen lengths at most
    s = binned.select(F.col(key).alias("_key"), "_sbin", "_slevel", *[c for c in segments.columns if c != key])
    within = (F.col(key) == F.col("_key")) & (F.col("_level") == F.col("_slevel")) & (F.col("_bin") == F.col("_sbin")) & (F.col("ss") <= F.col("ps")) & (F.col("pe") <= F.col("se"))
    return at.join(s, within, how).drop("_key", "_sbin", "_slevel")


def containment_join(probes: DataFrame, segments: DataFrame, key: str = "file", width: int = 64, how: str = "inner") -> DataFrame:
    """Probes (key, ps, pe) with the segments (key, ss, se) that contain them.

    A segment stands in the bins that it touches among those of its own length: two or three rows, however
    long it is. A probe stands in the bin of its start, once for each length of bins that some segment has,
    at most a dozen. So the join is on key, length and bin, and a long list of one key is split up. With
    how="left" a probe may come without a segment beside its rows with one.
    """
    return _in_bins(probes, segments, key, width, how).drop("_bin", "_level")


def least_ordinals(probes: DataFrame, segments: DataFrame, ordinal: str, key: str = "file", width: int = 64) -> DataFrame:
    """(key, ps, pe, ordinal): the lowest ordinal of the segments that contain each distinct probe; probes in none have no row.

    The least of a bin is taken where the bin is joined, so no more than a row for each probe and length is
    shuffled, however many segments contain it.
    """
    met = _in_bins(probes.select(key, "ps", "pe").distinct(), segments.select(key, "ss", "se", ordinal), key, width, "inner")
    in_bin = met.groupBy(key, "_level", "_bin", "ps", "pe").agg(F.min(ordinal).alias(ordinal))
    return in_bin.groupBy(key, "ps", "pe").agg(F.min(ordinal).alias(ordinal))


def lookup_first(probes: DataFrame, segments: DataFrame, probe: str, ordinal: str, key: str = "file", width: int = 64) -> DataFrame:
    """Each probe with the containing segment of the lowest ordinal; null columns if there is none."""
    both = containment_join(probes, segments, key, width, "left")
    rest = [c for c in both.columns if c not in probes.columns]
    first = both.groupBy(*probes.columns).agg(F.min(F.struct(F.col(ordinal).isNull().alias("_none"), ordinal, *[c for c in rest if c != ordinal])).alias("_first"))
    return first.select(*probes.columns, *[F.col(f"_first.{c}").alias(c) for c in rest])


def line_ranges(df: DataFrame, doc: str, order: str, newlines: str) -> DataFrame:
    """Line ranges of ordered fragments; a fragment starts on the line on which the one before it ends."""
    w = Window.partitionBy(doc).orderBy(order)
    before = F.coalesce(F.sum(newlines).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return df.withColumn("start_line", 1 + before).withColumn("end_line", 1 + before + F.col(newlines))


def comment_groups(df: DataFrame, doc: str, order: str, is_comment: str) -> DataFrame:
    """Each row that is no comment with the number of comment rows right before it, by gaps and islands."""
    w = Window.partitionBy(doc).orderBy(order)
    island = F.sum((~F.col(is_comment)).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = df.withColumn("_island", F.coalesce(island, F.lit(0)))
    count = F.sum(F.col(is_comment).cast("int")).over(Window.partitionBy(doc, "_island"))
    return rows.withColumn("comments", count).where(~F.col(is_comment)).drop("_island")
