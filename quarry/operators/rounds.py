"""What loops over DataFrames share: tables between rounds, numbers in order, fixpoints by delta."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; only where that is unset (tests) a local one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = "file://" + tempfile.mkdtemp(prefix="quarry-")
        spark.conf.set("spark.checkpoint.dir", base)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base)
    return f"{base}/rounds-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """A table written to the shared folder and read back: lineage ends here, its size is known to the joins that follow, and lost executors take nothing with them."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def places(rows: DataFrame, group: list[str], order: list[str], name: str = "place") -> DataFrame:
    """rows with their 0-based place in their group's order: places within ranges of rows, plus the sizes of the ranges before.

    No task sees more than a range, however large a group is; equal rows are told apart by chance, so
    that they don't make a range larger.
    """
    spread = rows.withColumn("_luck", F.xxhash64(F.monotonically_increasing_id()))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = stored(spread.repartitionByRange(parts, *group, *order, "_luck").withColumn("_part", F.spark_partition_id()))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranged.groupBy(*group, "_part").agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    sizes = sizes.select(*[F.col(c).alias(f"_of_{c}") for c in [*group, "_part"]], "_before")
    same = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in [*group, "_part"]]  # a null group is one too
    own = F.row_number().over(Window.partitionBy(*group, "_part").orderBy(*order, "_luck")) - 1
    return ranged.withColumn("_own", own).join(sizes, same, "inner").drop(*[f"_of_{c}" for c in [*group, "_part"]]).withColumn(name, (F.col("_before") + F.col("_own")).cast("long")).drop("_before", "_own", "_part", "_luck")


def fixpoint(items: DataFrame, step: Callable[[DataFrame, int], DataFrame], done: Column, most_rounds: int) -> DataFrame:
    """items after as many steps as each needs, with rounds (steps taken) and unresolved (whether the bound ended it).

    step takes the rows that are still at work and the round, and returns rows of the same columns: one
    for each row, several, or none. A row for which `done` holds is set aside and not read again, so round
    k costs what is left after k - 1. A null `done` counts as not done. A row that is done at the start
    takes no step.
    """
    ready = F.coalesce(done, F.lit(False))
    left = stored(items.withColumn("_ready", ready))
    settled: list[DataFrame] = []
    for k in range(most_rounds + 1):
        settled.append(left.where("_ready").drop("_ready").withColumn("rounds", F.lit(k)).withColumn("unresolved", F.lit(False)))
        rest = left.where("not _ready").drop("_ready")
        if rest.isEmpty():
            break
        if k == most_rounds:
            settled.append(rest.withColumn("rounds", F.lit(k)).withColumn("unresolved", F.lit(True)))
            break
        left = stored(step(rest, k + 1).select(*items.columns).withColumn("_ready", ready))
    found = settled[0]
    for more in settled[1:]:
        found = found.unionByName(more)
    return found
