"""Nested documents as rows (doc_id, path array<string>, kind, text, ord): upsert, removal, selection, comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators.rounds import stored


def parent(path: str = "path"):
    return F.slice(F.col(path), 1, F.size(path) - 1)


def upsert(old: DataFrame, new: DataFrame, extendable: list[str] | None = None) -> DataFrame:
    """New pieces, with all that lies in them, in place of old ones of the same path.

    Of a replaced container the direct children that the new one doesn't name stay, with all below them,
    if both are of the same kind and that is extendable (None: every kind is). New rows come last in
    order, such children after them. Both sides are read several times, so they are written once.
    """
    old, new = stored(old), stored(new)
    above = new.select("doc_id", "path", "kind").withColumn("_up", parent()).join(new.select("doc_id", F.col("path").alias("_up")), ["doc_id", "_up"], "left_anti").select("doc_id", F.col("path").alias("_top"), F.col("kind").alias("_new_kind"))
    span = new.groupBy("doc_id").agg((F.max("ord") + 2).alias("_span"))
    last = old.groupBy("doc_id").agg(F.max("ord").alias("_last")).join(span, "doc_id")
    hit = old.withColumn("_top", F.explode(F.transform(F.sequence(F.lit(1), F.size("path")), lambda k: F.slice("path", 1, k)))).join(above, ["doc_id", "_top"])
    hit = stored(hit)
    was = old.select("doc_id", F.col("path").alias("_top"), F.col("kind").alias("_old_kind"))
    same = (F.col("_old_kind") == F.col("_new_kind")) & (F.lit(True) if extendable is None else F.col("_old_kind").isin(extendable))
    below = hit.where(F.size("path") > F.size("_top")).join(was, ["doc_id", "_top"]).where(same).withColumn("_child", F.slice(F.col("path"), F.lit(1), F.size("_top") + 1))
    carried = below.join(new.select("doc_id", F.col("path").alias("_child")), ["doc_id", "_child"], "left_anti").join(last, "doc_id")
    carried = carried.withColumn("ord", F.col("_last") + F.col("_span") + F.col("ord")).select(*old.columns)
    kept = old.join(hit.select("doc_id", "path").distinct(), ["doc_id", "path"], "left_anti").select(*old.columns)
    fresh = new.join(last, "doc_id", "left").withColumn("ord", F.coalesce("_last", F.lit(0)) + F.col("ord") + 1).select(*old.columns)
    return kept.unionByName(fresh).unionByName(carried)


def evicted(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old rows whose path a new row takes."""
    return old.join(new.select("doc_id", "path"), ["doc_id", "path"], "left_semi")


def without(pieces: DataFrame, gone: DataFrame, container_kinds: list[str]) -> DataFrame:
    """Pieces without those in gone, without what lay in them, and without containers that are left empty. Pieces are read several times, so they are written once."""
    pieces = stored(pieces)
    away = gone.select("doc_id", F.col("path").alias("_gone"))
    ups = pieces.withColumn("_gone", F.explode(F.transform(F.sequence(F.lit(1), F.size("path")), lambda k: F.slice("path", 1, k))))
    lost = ups.join(away, ["doc_id", "_gone"], "left_semi").select("doc_id", "path").distinct()
    left = stored(pieces.join(lost, ["doc_id", "path"], "left_anti"))
    parents = left.where(F.size("path") > 1).select("doc_id", parent().alias("path")).distinct()
    empty = left.where(F.col("kind").isin(container_kinds)).select("doc_id", "path").join(parents, ["doc_id", "path"], "left_anti")
    had = pieces.where(F.size("path") > 1).select("doc_id", parent().alias("path")).distinct()
    return left.join(empty.join(had, ["doc_id", "path"], "left_semi"), ["doc_id", "path"], "left_anti")


def shadowed(old: DataFrame, uses: DataFrame) -> DataFrame:
    """old without top-level pieces, imports or others, whose name a new import brings; uses: doc_id, name."""
    names = uses.select("doc_id", F.col("name").alias("_name")).distinct()
    top = old.withColumn("_name", F.get("path", F.lit(0)))
    return top.join(names, ["doc_id", "_name"], "left_anti").select(*old.columns)


def halves(pieces: DataFrame, chosen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pieces at or below a chosen path, and all others."""
    want = chosen.select("doc_id", F.col("path").alias("_chosen")).distinct()
    ups = pieces.select("doc_id", "path", F.explode(F.transform(F.sequence(F.lit(1), F.size("path")), lambda k: F.slice("path", 1, k))).alias("_chosen"))
    inside = ups.join(want, ["doc_id", "_chosen"], "left_semi").select("doc_id", "path").distinct()
    return pieces.join(inside, ["doc_id", "path"], "left_semi"), pieces.join(inside, ["doc_id", "path"], "left_anti")


def trimmed(pieces: DataFrame, wanted: DataFrame, whole_kinds: list[str]) -> DataFrame:
    """Wanted pieces, all above them, and all members of a container of whole_kinds of which one is wanted. Pieces are read several times, so they are written once."""
    pieces = stored(pieces)
    want = wanted.select("doc_id", "path").distinct()
    above = want.select("doc_id", F.explode(F.transform(F.sequence(F.lit(1), F.size("path")), lambda k: F.slice("path", 1, k))).alias("path")).distinct()
    whole = pieces.where(F.col("kind").isin(whole_kinds)).join(above, ["doc_id", "path"], "left_semi").select("doc_id", F.col("path").alias("_parent"))
    members = pieces.withColumn("_parent", parent()).join(whole, ["doc_id", "_parent"], "left_semi").select("doc_id", "path")
    return pieces.join(above.union(members).distinct(), ["doc_id", "path"], "left_semi")


def interface_differences(old: DataFrame, new: DataFrame) -> DataFrame:
    """(doc_id, path, side): paths that only one side has or whose kind or signature differs."""
    a = old.select("doc_id", "path", F.struct("kind", "signature").alias("_a"), F.lit(1).alias("_l"))
    b = new.select("doc_id", "path", F.struct("kind", "signature").alias("_b"), F.lit(1).alias("_r"))
    side = F.when(F.col("_r").isNull(), "old").when(F.col("_l").isNull(), "new").when(~F.col("_a").eqNullSafe(F.col("_b")), "changed")
    return a.join(b, ["doc_id", "path"], "full").select("doc_id", "path", side.alias("side")).where("side is not null")


def rendered(pieces: DataFrame, separator: str = "\n") -> DataFrame:
    """Each document's pieces in order, as one text."""
    rows = F.array_sort(F.collect_list(F.struct("ord", "text")))
    return pieces.groupBy("doc_id").agg(F.array_join(F.transform(rows, lambda x: x["text"]), separator).alias("text"))
