"""Mixing sources to target weights by Pfair scheduling.

Each source's documents, in hash order, are cut into blocks of equal size. Block k of a source of weight
w may run from slot floor(k / w) on and must have run by slot ceil((k + 1) / w); each slot goes to the
released block of the earliest deadline. All deadlines are met, so after t slots a source has had its
weight's share of t, within less than one block.

Weights are exact fractions, for any number of slots and of sources: nothing is rounded, so nothing adds
up. One task goes through the blocks in a row, knows one block of each source at a time and passes on
one row for each block; documents are placed by a join with their blocks.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from fractions import Fraction
from itertools import islice
from math import lcm

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

PERIOD = 4096
BLOCK_BYTES = 1 << 16
#: Documents that one window task sums up, about.
BUCKET_DOCS = 1024
OTHER = "\x00other"
#: Slots of vanishing weights end here, as longs do.
LAST_SLOT = (1 << 63) - 1
PLAN = "source string, block long, place long, slot long, release long, deadline long, on_target boolean"


def slots_of(weights: dict[str, float], period: int = PERIOD) -> dict[str, int]:
    """Whole slots of a period for each source, one at least, by largest remainders: for a plan that repeats."""
    weights = {s: float(w) for s, w in weights.items() if w > 0}
    if len(weights) > period:
        raise ValueError(f"more than {period} sources with a weight")
    if not weights:
        return {}
    total = sum(weights.values())
    exact = {s: w / total * period for s, w in weights.items()}
    slots = {s: max(1, int(x)) for s, x in exact.items()}
    while (short := period - sum(slots.values())) != 0:
        step = 1 if short > 0 else -1
        movable = [s for s in slots if step > 0 or slots[s] > 1]
        for s in sorted(movable, key=lambda s: (-step * (exact[s] - slots[s]), s))[: abs(short)]:
            slots[s] += step
    return slots


def whole(weights: dict[str, float]) -> dict[str, int]:
    """Whole numbers in exactly the proportions of the weights above 0."""
    exact = {s: Fraction(w) for s, w in weights.items() if w > 0}
    by = lcm(*[x.denominator for x in exact.values()])
    return {s: int(x * by) for s, x in exact.items()}


def earliest_deadline_first(parts: dict[str, int], blocks: dict[str, int]) -> Iterator[tuple[str, int, int, int, int]]:
    """(source, block, slot, release, deadline) of each source's blocks, by slot; a source's weight is its part of all parts.

    A slot in which no block is released, as sources that have run out leave some, stays empty.
    """
    total = sum(parts.values())
    waiting = [(0, s, 0) for s in parts if blocks.get(s, 0) > 0]
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int, int]] = []
    t = 0
    while waiting or ready:
        if not ready and waiting[0][0] > t:
            t = waiting[0][0]
        while waiting and waiting[0][0] <= t:
            release, s, k = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(k + 1) * total // parts[s]), s, k, release))
        deadline, s, k, release = heapq.heappop(ready)
        if t >= deadline:
            raise AssertionError("a deadline was missed")
        yield s, k, t, release, deadline
        if k + 1 < blocks[s]:
            heapq.heappush(waiting, ((k + 1) * total // parts[s], s, k + 1))
        t += 1


def schedule(slots: dict[str, int], period: int = PERIOD) -> list[tuple[str, int, int, int, int]]:
    """(source, block of the period, slot, release, deadline) over one period."""
    return list(islice(earliest_deadline_first(slots, slots), period))


def _plan(block_bytes: int):
    """From (source, bytes, weight) of all sources, in one task, the rows of PLAN; sources without a weight come last."""

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sources = [r for batch in batches for r in batch.to_pylist()]
        blocks = {r["source"]: -(-r["bytes"] // block_bytes) for r in sources if r["bytes"]}
        parts = whole({r["source"]: r["weight"] or 0.0 for r in sources})
        total = sum(parts.values())
        horizon = min((blocks[s] * total // parts[s] for s in parts if s in blocks), default=0)

        def rows() -> Iterator[tuple]:
            place = end = 0
            for s, k, t, release, deadline in earliest_deadline_first(parts, blocks):
                yield s, k, place, min(t, LAST_SLOT), min(release, LAST_SLOT), min(deadline, LAST_SLOT), t < horizon
                place, end = place + 1, t + 1
            for s in sorted(set(blocks) - set(parts)):
                for k in range(blocks[s]):
                    yield s, k, place, min(end, LAST_SLOT), None, None, False
                    place, end = place + 1, end + 1

        types = [pa.string(), *[pa.int64()] * 5, pa.bool_()]
        names = [x.split()[0] for x in PLAN.split(", ")]
        out: list[tuple] = []
        for row in rows():
            out.append(row)
            if len(out) == 1 << 14:
                yield pa.RecordBatch.from_arrays([pa.array(x, y) for x, y in zip(zip(*out), types)], names=names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, y) for x, y in zip(zip(*out), types)], names=names)

    return plan


def _source() -> Column:
    return F.coalesce(F.col("source").cast("string"), F.lit(""))


def _size() -> Column:
    return (F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)) + 1).cast("long")


def _placed(docs: DataFrame, weights: dict[str, float] | None, power: float, block_bytes: int) -> DataFrame:
    """(row, mix): each row of docs as one struct, whatever its columns are called, and its place."""
    spark = docs.sparkSession
    every = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select(every, _source().alias("source"), _size().alias("size"), F.xxhash64("doc_id", "text").alias("hash"), F.col("doc_id").alias("id"))
    given = None
    if weights is not None:
        weights = {s: float(w) for s, w in weights.items() if w > 0}
        given = spark.createDataFrame(list(weights.items()), "named string, weight double")
        own = given.where(F.col("named") != OTHER).select(F.col("named").alias("source"), F.lit(True).alias("weighed"))
        rows = rows.join(own, "source", "left").withColumn("source", F.when(F.col("weighed"), F.col("source")).otherwise(F.lit(OTHER))).drop("weighed")
    sizes = stored(rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes")))
    rows = rows.join(sizes.select("source", F.ceil(F.col("n") / BUCKET_DOCS).alias("many")), "source")
    rows = rows.withColumn("bucket", F.pmod(F.shiftright("hash", 20), F.col("many"))).drop("many")

    totals = rows.groupBy("source", "bucket").agg(F.sum("size").alias("bytes"))
    sums = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("source", "bucket", F.coalesce(F.sum("bytes").over(sums), F.lit(0)).alias("before"), "bytes")
    if given is None:
        shares = sizes.select("source", "bytes", F.pow(F.col("bytes").cast("double"), F.lit(float(power))).alias("weight"))
    else:
        shares = sizes.join(given, F.col("source") == F.col("named"), "full").select(F.coalesce("source", "named").alias("source"), "bytes", "weight")
    plan = shares.repartition(1).mapInArrow(_plan(block_bytes), PLAN)
    first, last = F.floor(F.col("before") / block_bytes), F.floor((F.col("before") + F.col("bytes") - 1) / block_bytes)
    blocks = totals.select("source", "bucket", "before", F.explode(F.sequence(first, last)).alias("block")).join(plan, ["source", "block"])
    of_bucket = F.sort_array(F.collect_list(F.struct("block", "place", "slot", "release", "deadline", "on_target")))
    placed = blocks.groupBy("source", "bucket").agg(F.first("before").alias("before"), of_bucket.alias("plan"))

    local = Window.partitionBy("source", "bucket").orderBy("hash", "id").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("local", F.coalesce(F.sum("size").over(local), F.lit(0))).join(placed, ["source", "bucket"], "left")
    rows = rows.withColumn("at", F.col("before") + F.col("local")).withColumn("block", F.floor(F.col("at") / block_bytes).cast("long"))
    rows = rows.withColumn("p", F.get("plan", (F.col("block") - F.floor(F.col("before") / block_bytes)).cast("int")))
    order = (F.col("p.place") * block_bytes + F.col("at") % block_bytes).alias("order")
    return rows.select("row", F.struct("source", "block", "p.release", "p.deadline", "p.slot", order, "p.on_target").alias("mix"))


def mixed(docs: DataFrame, weights: dict[str, float] | None = None, power: float = 0.7, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with a struct column `mix`: source, block, release, deadline, slot, order, on_target.

    docs: doc_id, text and source; other columns are kept, but for one called `mix`, which is replaced.
    Every row stays. A null source is "", a null text has size 1 like an empty one. A document is placed
    in the block in which it begins, so a block holds a document's rest beyond its size at most. Without
    weights, each source's is its bytes to a power below one, which lifts small sources. Sources without
    a weight share OTHER's, or, if that has none either, come after all others. `order` is a distinct long
    for each row (but for full repeats, which share neither) that puts documents in mixed order; on_target
    tells the part in which every source still has blocks, where the deviation from the weights is below
    one block.
    """
    return _placed(docs, weights, power, block_bytes).select(*[F.col("row")[c].alias(c) for c in docs.columns if c != "mix"], "mix")


def mix_table(docs: DataFrame, weights: dict[str, float] | None = None, power: float = 0.7, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, source, block, release, deadline, slot, mix_order, on_target) for every row of docs."""
    rows = mixed(docs.select("doc_id", "text", "source"), weights, power, block_bytes)
    m = {c: F.col(f"mix.{c}") for c in ("source", "block", "release", "deadline", "slot", "on_target")}
    return rows.select("doc_id", *[v.alias(k) for k, v in m.items()], F.col("mix.order").alias("mix_order"))


def in_mixed_order(docs: DataFrame, weights: dict[str, float] | None = None, power: float = 0.7, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs, all columns whatever their names, in mixed order from file to file."""
    rows = _placed(docs, weights, power, block_bytes).repartitionByRange("mix.order").sortWithinPartitions("mix.order")
    return rows.select(*[F.col("row")[c].alias(c) for c in docs.columns])
