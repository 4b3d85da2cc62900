"""Packing of ordered items into batches of bounded size, per key."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def fixed_grid(df: DataFrame, key: str, order: str, size: str, budget: int) -> DataFrame:
    """df with batch: the budgets that the items before have used up; a plain window."""
    before = F.coalesce(F.sum(size).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return df.withColumn("batch", F.floor(before / budget).cast("long"))


def next_fit(df: DataFrame, key: str, order: str, size: str, budget: int) -> DataFrame:
    """(key, order, size, batch): an item opens a batch if it doesn't fit the open one; a larger one has a batch of its own.

    Sequential within a key, but not gathered: rows come sorted and only the open batch is remembered.
    """
    rows = df.select(F.col(key).cast("long"), F.col(order).cast("long"), F.col(size).cast("long"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, batch, used = object(), 0, 0
        for rows in batches:
            out = []
            for k, n in zip(rows.column(0).to_pylist(), rows.column(2).to_pylist()):
                n = n or 0
                if k != last:
                    last, batch, used = k, 0, n
                elif used + n > budget:
                    batch, used = batch + 1, n
                else:
                    used += n
                out.append(batch)
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(out, pa.int64())], names=[*rows.schema.names, "batch"])

    return rows.repartition(key).sortWithinPartitions(key, order).mapInArrow(pack, f"`{key}` long, `{order}` long, `{size}` long, batch long")


class Rooms:
    """Batches with what is left of each, and the first with room: a tree of the largest rooms, log n steps each."""

    def __init__(self) -> None:
        self.n, self.width, self.most = 0, 1, [float("-inf")] * 2

    def put(self, size: int, budget: int) -> int:
        """The first batch with room for the size, or a new one, which now has it."""
        most = self.most
        if most[1] >= size:
            k = 1
            while k < self.width:
                k *= 2
                if most[k] < size:
                    k += 1
            room = most[k] - size
        else:
            if self.n == self.width:  # twice as wide: each level of the tree moves one down
                none = [float("-inf")]
                wide = none + [most[1]]
                at = 1
                while at <= self.width:
                    wide += most[at : 2 * at] + none * at
                    at *= 2
                self.width *= 2
                self.most = most = wide
            k, room = self.n + self.width, budget - size
            self.n += 1
        at = k - self.width
        most[k] = room
        while k > 1:
            k //= 2
            a, b = most[2 * k], most[2 * k + 1]
            best = a if a > b else b
            if most[k] == best:
                break
            most[k] = best
        return at


def first_fit(df: DataFrame, key: str, order: str, size: str, budget: int) -> DataFrame:
    """(key, order, size, batch): each item goes to the first batch with room, found in a tree of the rooms of the key's batches. Sequential within a key; kept are two numbers for each of its batches."""
    rows = df.select(F.col(key).cast("long"), F.col(order).cast("long"), F.col(size).cast("long"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: object = object()
        rooms = Rooms()
        for rows in batches:
            out = []
            for k, n in zip(rows.column(0).to_pylist(), rows.column(2).to_pylist()):
                n = n or 0
                if k != last:
                    last, rooms = k, Rooms()
                out.append(rooms.put(n, budget))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(out, pa.int64())], names=[*rows.schema.names, "batch"])

    return rows.repartition(key).sortWithinPartitions(key, order).mapInArrow(pack, f"`{key}` long, `{order}` long, `{size}` long, batch long")


class Room:
    """The first place, from some place on, whose size is below a bound: a tree of least sizes over the places, log n steps each."""

    def __init__(self, sizes: list[int]):
        self.width = 1 << max(len(sizes) - 1, 0).bit_length()
        none = float("inf")
        self.least = [none] * self.width + [*sizes, *[none] * (self.width - len(sizes))]
        for k in range(self.width - 1, 0, -1):
            self.least[k] = min(self.least[2 * k], self.least[2 * k + 1])

    def take(self, at: int) -> None:
        k = at + self.width
        self.least[k] = float("inf")
        while k > 1:
            k //= 2
            self.least[k] = min(self.least[2 * k], self.least[2 * k + 1])

    def first(self, start: int, bound: float) -> int | None:
        """The first place from `start` on whose size is below the bound."""
        k = start + self.width
        if start >= self.width:
            return None
        while not self.least[k] < bound:  # up, to the next tree on the right
            while k & 1:
                k //= 2
            if not k:
                return None
            k += 1
        while k < self.width:
            k = 2 * k if self.least[2 * k] < bound else 2 * k + 1
        return k - self.width


def pack_leaves(sizes: list[int], budget: int) -> list[int]:
    """The batch of each leaf, in order: a batch opens with the first leaf left, at no charge, then takes every later leaf whose size is below what is left of the budget."""
    tree, batch, out = Room(sizes), 0, [0] * len(sizes)
    while (at := tree.first(0, float("inf"))) is not None:
        left = budget
        tree.take(at)
        out[at] = batch
        while (at := tree.first(at + 1, left)) is not None:  # what did not fit before fits no more
            tree.take(at)
            out[at] = batch
            left -= sizes[at]
        batch += 1
    return out


def first_fit_layers(nodes: DataFrame, edges: DataFrame, budget: int, key: str = "key") -> DataFrame:
    """(key, scc, layer, batch): components in batches, each after all that it depends on.

    nodes: key, node, size (null is 0); edges: src, dst, src depends on dst. A component has its nodes' key
    (the lowest, if they differ) and their sizes together. Components whose dependencies all lie in earlier
    layers are released together; those of one key and layer are packed by pack_leaves in the order of
    their names. Within a key and layer that is sequential, with a tree in place of a search of all that
    is left; keys and layers are packed side by side, and only one group's sizes are held.
    """
    from quarry.operators.contraction import layers
    from quarry.operators.rounds import stored

    found = layers(edges, nodes.select("node"))
    items = found.join(nodes.groupBy("node").agg(F.min(key).alias(key), F.max(F.coalesce("size", F.lit(0))).alias("size")), "node", "left")
    items = stored(items.groupBy("scc").agg(F.min(key).alias(key), F.first("layer").alias("layer"), F.sum(F.coalesce("size", F.lit(0))).cast("long").alias("size")))

    def pack(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("scc")
        return rows.select([key, "scc", "layer"]).append_column("batch", pa.array(pack_leaves(rows.column("size").to_pylist(), budget), pa.int64()))

    kind = dict(items.dtypes)
    return items.select(key, "scc", "layer", "size").groupBy(key, "layer").applyInArrow(pack, f"`{key}` {kind[key]}, scc {kind['scc']}, layer long, batch long")
