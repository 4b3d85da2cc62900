"""Batches of connected nodes within a budget, grown from many seeds at once, and covers of all relations by them.

A relation (src, dst) is covered once both its ends are in one batch; one of a node with itself stands for
a node without others. Seeds are relations that share no node. In each round every batch takes the
neighbour with most relations to what it has; nodes that no longer fit are banned from the batch, and a
node that several batches want goes to the one of the smallest order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators.rounds import stored

Order = Callable[[Column, Column, int], Column]


def by_hash(src: Column, dst: Column, round_: int) -> Column:
    """An order of relations that no one can foresee and everyone works out alike."""
    return F.xxhash64(src, dst, F.lit(round_))


def independent(relations: DataFrame, locked: DataFrame | None = None, order: Order = by_hash, round_: int = 0) -> DataFrame:
    """(seed, src, dst, order): relations of which no two share a node, those that come first at both ends; seed is their order.

    locked: node, nodes that no seed may have. There is a seed unless every relation has a locked end.
    """
    rows = relations.select("src", "dst").distinct()
    if locked is not None:
        taken = locked.select("node").distinct()
        rows = rows.join(taken.withColumnRenamed("node", "src"), "src", "left_anti").join(taken.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst")
    return _first(rows, order, round_)


def _first(rows: DataFrame, order: Order, round_: int) -> DataFrame:
    """rows (src, dst, no two alike, and more) that come first at both ends, with seed."""
    keyed = rows.withColumn("seed", F.struct(order(F.col("src"), F.col("dst"), round_).alias("order"), "src", "dst"))
    first = keyed.select(F.explode(F.array_distinct(F.array("src", "dst"))).alias("node"), "seed").groupBy("node").agg(F.min("seed").alias("first"))
    a, b = (first.select(F.col("node").alias(c), F.col("first").alias(f"_{c}")) for c in ("src", "dst"))
    return keyed.join(a, "src").join(b, "dst").where((F.col("seed") == F.col("_src")) & (F.col("seed") == F.col("_dst"))).select("seed", *rows.columns)


def expand(relations: DataFrame, neighbours: DataFrame, sizes: DataFrame, seeds: DataFrame, budget: int, locked: DataFrame | None = None, recency: DataFrame | None = None) -> DataFrame:
    """(seed, node, step): each seed's batch; step is the round in which the node came, 0 for the seed's own ends.

    relations (src, dst): those still to cover; a candidate's votes are its relations, either way, with what
    the batch has. neighbours (src, dst): what makes a node a candidate, in both directions. sizes: node,
    size; a missing or null size is 0. recency: node, recent; among candidates without votes the most
    recent comes first. Ties go by the smaller node. A seed's ends stay even if they are over the budget.

    The rows of a round: the open candidates of all seeds, each with its votes so far; what a new node adds
    is joined to neighbours alone. Candidates that don't fit leave for good, as room never grows.
    """
    weight = sizes.groupBy("node").agg(F.max(F.coalesce("size", F.lit(0))).alias("size"))
    near = stored(_near(relations, neighbours, weight, recency))
    ends = seeds.select("seed", F.explode(F.array_distinct(F.array("src", "dst"))).alias("node")).join(weight, "node", "left")
    own = ends.groupBy("seed").agg((F.lit(budget) - F.sum(F.coalesce("size", F.lit(0)))).alias("room"), F.collect_list("node").alias("nodes"))  # two nodes
    return _grown(near, stored(own.select("seed", F.explode("nodes").alias("node"), "room")), locked)


def _near(relations: DataFrame, neighbours: DataFrame, weight: DataFrame, recency: DataFrame | None) -> DataFrame:
    """(node, other, votes, size, recent): neighbours both ways, with their relations and the other's size; weight: node, size."""
    both = lambda df: df.select(F.explode(F.array(F.struct(F.col("src").alias("a"), F.col("dst").alias("b")), F.struct(F.col("dst").alias("a"), F.col("src").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b")
    near = both(relations.select("src", "dst").distinct()).groupBy("a", "b").agg(F.count(F.lit(1)).alias("votes"))
    if neighbours is not relations:
        near = both(neighbours.select("src", "dst")).distinct().join(near, ["a", "b"], "left")
    near = near.join(weight.withColumnRenamed("node", "b"), "b", "left")
    if recency is not None:
        near = near.join(recency.groupBy("node").agg(F.max("recent").alias("recent")).withColumnRenamed("node", "b"), "b", "left")
    else:
        near = near.withColumn("recent", F.lit(0))
    return near.select(F.col("a").alias("node"), F.col("b").alias("other"), F.coalesce("votes", F.lit(0)).alias("votes"), F.coalesce("size", F.lit(0)).alias("size"), "recent")


def _grown(near: DataFrame, new: DataFrame, locked: DataFrame | None = None) -> DataFrame:
    """(seed, node, step) from near (as of _near) and new: seed, node, room of the seeds' own ends; both are stored tables.

    A node's neighbours are read in the round after it came, and never again: in rounds 1, 4, 16 and so on
    near is written anew without the nodes that have gone since. An open candidate that a seed got leaves
    with all rows, so that only what new nodes add is held against the nodes gone since near was written.
    """
    found = [new.select("seed", "node", F.lit(0).alias("step"))]
    taken = new.select("node") if locked is None else new.select("node").union(locked.select("node"))
    open_: DataFrame | None = None
    step, clean = 0, 1
    while True:
        step += 1
        rows = new.join(near, "node").select("seed", F.col("other").alias("node"), "votes", "size", "recent", "room").where("size <= room").join(taken, "node", "left_anti")
        if open_ is not None:
            after = new.select("seed", F.col("room").alias("now"))
            rows = rows.unionByName(open_.where("not won").join(after, "seed", "left").select("seed", "node", "votes", "size", "recent", F.coalesce("now", "room").alias("room")).where("size <= room"))
        rows = rows.groupBy("seed", "node").agg(F.sum("votes").alias("votes"), F.max("size").alias("size"), F.max("recent").alias("recent"), F.min("room").alias("room"))
        rank = F.struct(-F.col("votes"), F.when(F.col("votes") == 0, -F.coalesce(F.col("recent").cast("double"), F.lit(float("-inf")))), F.col("node"))
        wanted = rows.groupBy("seed").agg(F.min(rank).alias("best")).groupBy(F.col("best.node").alias("node")).agg(F.min("seed").alias("to"))
        open_ = stored(rows.join(wanted, "node", "left").where("to is null or seed = to").withColumn("won", F.col("to").isNotNull()).drop("to"))
        new = open_.where("won").select("seed", "node", (F.col("room") - F.col("size")).alias("room"))
        if new.isEmpty():
            break
        found.append(new.select("seed", "node", F.lit(step).alias("step")))
        if step == clean:
            clean *= 4
            near = stored(near.join(taken, "node", "left_anti").join(taken.select(F.col("node").alias("other")), "other", "left_anti").select(*near.columns))
            taken = new.select("node")
        else:
            taken = taken.union(new.select("node"))
            if step % 8 == 0:
                taken = stored(taken)
    batches = found[0]
    for more in found[1:]:
        batches = batches.unionByName(more)
    return batches


def cover(relations: DataFrame, sizes: DataFrame, budget: int, changed: Callable[[DataFrame, int], DataFrame] | None = None, neighbours: DataFrame | None = None, most_tries: int = 2, most_rounds: int = 1000, order: Order = by_hash) -> tuple[DataFrame, DataFrame]:
    """Batches until every relation has stood in one: (round, seed, node), and (src, dst, tries) of all relations.

    In each round seeds that share no node grow to batches; relations with both ends in one batch are
    covered and leave, one try the more. changed(batches, round) gives the nodes (node) whose interface came
    out otherwise: relations (x, node) of which exactly one end is in node's batch come back, unless they are
    there or have had most_tries. Without it nothing comes back.

    neighbours: what makes a candidate; None: the relations still open, so that a round reads no more than
    these. With the whole graph, covered neighbours fill batches up to the budget. Relations still
    open after most_rounds keep their tries; a relation that never was in a batch has 0.

    State: the open relations with their ends' sizes, written anew each round, and the covered ones, of which a round touches only
    those of changed nodes.
    """
    ends = relations.select("src", "dst").where("src is not null and dst is not null").distinct()
    weight = sizes.groupBy("node").agg(F.max(F.coalesce("size", F.lit(0))).alias("size"))
    if neighbours is not None:
        weight = stored(weight)
    left = ends.withColumn("tries", F.lit(0))
    for end in ("src", "dst"):
        left = left.join(weight.select(F.col("node").alias(end), F.col("size").alias(f"{end}_size")), end, "left").withColumn(f"{end}_size", F.coalesce(f"{end}_size", F.lit(0)))
    columns = ["src", "dst", "tries", "src_size", "dst_size"]
    left = stored(left.select(*columns))
    done = left.limit(0)
    recent: DataFrame | None = None
    rounds: list[DataFrame] = []
    for k in range(most_rounds):
        if left.isEmpty():
            break
        if neighbours is None:
            ways = F.array(F.struct(F.col("src").alias("node"), F.col("dst").alias("other"), F.col("dst_size").alias("size")), F.struct(F.col("dst").alias("node"), F.col("src").alias("other"), F.col("src_size").alias("size")))
            near = left.where("src <> dst").select(F.explode(ways).alias("e")).groupBy("e.node", "e.other").agg(F.count(F.lit(1)).alias("votes"), F.max("e.size").alias("size")).withColumn("recent", F.lit(0))
        else:
            near = _near(left, neighbours, weight, recent)
        room = F.lit(budget).cast("long") - F.col("src_size") - F.when(F.col("src") == F.col("dst"), 0).otherwise(F.col("dst_size"))
        seeds = _first(left, order, k).select("seed", F.explode(F.array_distinct(F.array("src", "dst"))).alias("node"), room.alias("room"))
        batches = stored(_grown(stored(near), stored(seeds)).select(F.lit(k).alias("round"), "seed", "node"))
        rounds.append(batches)
        of = batches.select("node", "seed")
        a, b = of.select(F.col("node").alias("src"), F.col("seed").alias("_a")), of.select(F.col("node").alias("dst"), F.col("seed").alias("_b"))
        marked = stored(left.join(a, "src", "left").join(b, "dst", "left").select(*columns, F.coalesce(F.col("_a") == F.col("_b"), F.lit(False)).alias("in")))
        done = done.unionByName(marked.where("in").withColumn("tries", F.col("tries") + 1).select(*columns))
        left = marked.where("not in").select(*columns)
        if changed is not None:
            new = changed(batches, k).select("node").distinct().join(of, "node").select(F.col("node").alias("dst"), F.col("seed").alias("_b"))
            # of the covered relations only those of changed nodes; one that was covered just now has both ends inside
            again = done.join(new, "dst").join(a, "src", "left").where((F.col("_a").isNull() | (F.col("_a") != F.col("_b"))) & (F.col("tries") < most_tries) & (F.col("src") != F.col("dst"))).select(*columns)
            again = stored(again)
            done = done.join(again.select("src", "dst"), ["src", "dst"], "left_anti")
            left = left.unionByName(again)
        left, done = stored(left), stored(done) if k % 4 == 3 else done
        if neighbours is not None:
            seen = batches.select("node", F.lit(k).alias("recent"))
            recent = stored(seen if recent is None else recent.union(seen).groupBy("node").agg(F.max("recent").alias("recent")))
    found = rounds[0] if rounds else left.select(F.lit(0).alias("round"), F.struct(order(F.col("src"), F.col("dst"), 0).alias("order"), "src", "dst").alias("seed"), F.col("src").alias("node"))
    for more in rounds[1:]:
        found = found.unionByName(more)
    return found, done.unionByName(left).select("src", "dst", "tries")
