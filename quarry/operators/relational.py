"""Set operations, division, ranking and shaping of relations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def union_distinct(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts).distinct()


def forall_division(pairs: DataFrame, group: str, other: str, item: str) -> DataFrame:
    """(group, other) where every item of the group stands with the other, and there is one at least."""
    total = pairs.groupBy(group).agg(F.countDistinct(item).alias("_all"))
    own = pairs.groupBy(group, other).agg(F.countDistinct(item).alias("_own"))
    return own.join(total, group).where("_own = _all and _all > 0").select(group, other)


def diff(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """key and side: left, right, changed or both, by one full join on the key of null-safe row values."""
    rest = [c for c in old.columns if c not in key]
    a = old.select(*key, F.struct(*rest).alias("_a"), F.lit(True).alias("_in_a"))
    b = new.select(*key, F.struct(*rest).alias("_b"), F.lit(True).alias("_in_b"))
    side = F.when(F.col("_in_b").isNull(), "left").when(F.col("_in_a").isNull(), "right").when(F.col("_a").eqNullSafe(F.col("_b")), "both").otherwise("changed")
    return a.join(b, key, "full").select(*key, side.alias("side"))


def latest(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """Each key's row of the highest order; tasks pass on one row of a key each."""
    rest = [c for c in df.columns if c not in key]
    best = df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_best"))
    return best.select(*[F.col(c) if c in key else F.col("_best")[c].alias(c) for c in df.columns])


def reduction(before: Column, after: Column) -> Column:
    """By what share `after` is below `before`; null where that is nought."""
    return 1 - after / F.nullif(before, F.lit(0))


def pivoted(df: DataFrame, row: str, column: str, values: list[str], measure: Column) -> DataFrame:
    """One row for each `row`, one column for each of the listed values, in sorted order; rows that lack one are left out."""
    return df.groupBy(row).pivot(column, sorted(values)).agg(measure).na.drop("any")


def joined_text(df: DataFrame, key: str, order: str, text: str, separator: str = "\n") -> DataFrame:
    """Each key's texts in order, joined."""
    rows = F.array_sort(F.collect_list(F.struct(order, text)))
    return df.groupBy(key).agg(F.array_join(F.transform(rows, lambda x: x[text]), separator).alias("text"))


def owner_split(pairs: DataFrame, item: str, owner: str) -> DataFrame:
    """(owner, items, shared): items of one owner counted together, items of several each on its own."""
    owners = pairs.select(item, owner).distinct().groupBy(item).agg(F.count(F.lit(1)).alias("n"), F.min(owner).alias(owner))
    single = owners.where("n = 1").groupBy(owner).agg(F.count(F.lit(1)).alias("items"), F.lit(False).alias("shared"))
    return single.unionByName(owners.where("n > 1").select(owner, F.lit(1).cast("long").alias("items"), F.lit(True).alias("shared")))


def with_average(df: DataFrame, label: str, name: str = "Average") -> DataFrame:
    """df and a row of its columns' means."""
    measures = [c for c in df.columns if c != label]
    return df.select(label, *[F.col(c).cast("double").alias(c) for c in measures]).unionByName(df.agg(*[F.avg(c).alias(c) for c in measures]).select(F.lit(name).alias(label), *measures))


def row_shares(df: DataFrame, measures: list[str]) -> DataFrame:
    """Measures divided by their row's total; a total of nought counts as one."""
    total = reduce(lambda a, b: a + b, [F.coalesce(F.col(c), F.lit(0)) for c in measures])
    return df.withColumns({c: F.col(c) / F.when(total == 0, F.lit(1)).otherwise(total) for c in measures})


def result_hash(df: DataFrame) -> DataFrame:
    """One row: a hash that the order of rows doesn't change, and their number."""
    return df.agg(F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).alias("hash"), F.count(F.lit(1)).alias("rows"))


def page(df: DataFrame, keys: list[Column], offset: int, limit: int) -> DataFrame:
    """A sorted slice of a result, the reader's own limit and offset."""
    return df.orderBy(*keys).offset(offset).limit(limit)
