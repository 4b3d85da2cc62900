"""Work that must not meet: tasks that share a lock get different colours, and those of a colour run at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.rounds import places, stored


def repair_tasks(conflicts: DataFrame) -> DataFrame:
    """(task, conflict, piece): conflicts as tasks; conflicts: conflict, piece.

    A conflict of several pieces is a task, named by itself; those of one piece and no other are one task,
    named by the piece. Conflicts without a piece (null) are none.
    """
    rows = conflicts.select("conflict", "piece").where("conflict is not null and piece is not null").distinct()
    count = rows.groupBy("conflict").agg(F.count(F.lit(1)).alias("n"))
    several = F.col("n") > 1
    task = F.struct(several.alias("several"), F.when(several, F.col("conflict").cast("string")).otherwise(F.col("piece").cast("string")).alias("name"))
    return rows.join(count, "conflict").select(task.alias("task"), "conflict", "piece")


#: A lock of more tasks than this has their places worked out in ranges of rows; smaller ones by a window.
LARGE = 100_000


def conflict_free(holds: DataFrame, first: list[str] | None = None) -> DataFrame:
    """(task, colour): colours from 0, no two tasks of one colour share a lock; no colour is above the number of tasks that a task shares locks with. holds, first: as coloured."""
    return coloured(holds, first).select("task", "colour")


def coloured(holds: DataFrame, first: list[str] | None = None) -> DataFrame:
    """(task, locks, colour), a row for each task, as conflict_free has them; locks: the distinct ones, without null.

    holds: task, lock; a task whose only lock is null shares none. Who shares with whom is never listed:
    in each round a task's place among the waiting tasks of each of its locks is worked out, and it asks
    for the colour at its largest place among those that its locks have not given away. So the tasks of one
    lock ask for different colours at once, however many they are. Of two that share a lock and ask for one
    colour, the first by hash gets it and the other waits. The very first of all waiting tasks always gets
    its colour, so every round makes progress.

    A round moves the waiting rows four times, by lock, task, asked colour and task, and writes a row for
    each waiting task; given colours are bits, 64 to a number, and go to the waiting tasks of their lock.
    """
    rank = [F.col(f"task.{c}") for c in first] if first else [F.xxhash64("task"), F.col("task")]
    lock_type = dict(holds.dtypes)["lock"]
    none = F.array().cast(f"array<{lock_type}>")
    rows = holds.select("task", "lock").where("task is not null").groupBy("task").agg(F.collect_set("lock").alias("locks"))
    waiting = stored(rows)
    sizes = waiting.select(F.explode("locks").alias("lock")).groupBy("lock").agg(F.count(F.lit(1)).alias("n"))
    large = stored(sizes.where(F.col("n") > LARGE).select("lock"))
    any_large = not large.isEmpty()
    alone = waiting.where(F.size("locks") == 0).withColumn("colour", F.lit(0).cast("long"))
    waiting = waiting.where(F.size("locks") > 0)
    given: DataFrame | None = None  # lock, chunk, bits
    found = [alone]
    while True:
        held = waiting.select("task", F.explode("locks").alias("lock"))
        small = (held.join(large, "lock", "left_anti") if any_large else held).select("task", "lock").repartition("lock")
        own = small.withColumn("place", F.row_number().over(Window.partitionBy("lock").orderBy(*rank)).cast("long") - 1)
        if any_large:
            more = held.join(large, "lock", "left_semi").withColumn("rank", F.struct(*[r.alias(f"r{k}") for k, r in enumerate(rank)]))
            own = own.unionByName(places(more, ["lock"], ["rank"]).select("task", "lock", "place"))
        if given is None:
            ask = own.groupBy("task").agg(F.max("place").alias("colour"), F.collect_list("lock").alias("locks"))
        else:
            own = own.join(given, "lock", "left").select("task", "lock", "place", "chunk", "bits").repartition("task")
            by = own.groupBy("task", "chunk").agg(F.bit_or("bits").alias("bits"), F.max("place").alias("place"), F.collect_set("lock").alias("locks"))
            by = by.groupBy("task").agg(F.max("place").alias("place"), F.array_sort(F.collect_list(F.when(F.col("chunk").isNotNull(), F.struct("chunk", "bits")))).alias("chunks"), F.array_distinct(F.flatten(F.collect_list("locks"))).alias("locks"))
            taken = lambda c: F.transform(F.filter(F.sequence(F.lit(0), F.lit(63)), lambda b: F.getbit(c["bits"], b) == 1), lambda b: c["chunk"] * 64 + b)
            free = F.aggregate(F.flatten(F.transform("chunks", taken)), F.col("place"), lambda c, u: F.when(u <= c, c + 1).otherwise(c))
            ask = by.select("task", free.alias("colour"), "locks")
        asked = ask.select("task", "colour", F.explode("locks").alias("lock")).repartition("lock", "colour")
        late = F.row_number().over(Window.partitionBy("lock", "colour").orderBy(*rank)) > 1
        marked = stored(asked.withColumn("late", late).groupBy("task").agg(F.max("late").alias("late"), F.first("colour").alias("colour"), F.collect_list("lock").alias("locks")))
        won = marked.where("not late").select("task", "locks", "colour")
        found.append(won)
        waiting = marked.where("late").select("task", "locks")
        if waiting.isEmpty():
            break
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("colour") % 64).cast("int"))
        new = won.select(F.explode("locks").alias("lock"), F.floor(F.col("colour") / 64).alias("chunk"), bit.alias("bits"))
        given = stored((new if given is None else given.unionByName(new)).groupBy("lock", "chunk").agg(F.bit_or("bits").alias("bits")))
    every = found[0].select("task", F.coalesce("locks", none).alias("locks"), "colour")
    for more in found[1:]:
        every = every.unionByName(more.select("task", "locks", "colour"))
    return every
