"""Approximate nearest neighbours: NN-descent builds a graph by Spark joins, greedy search walks it.

Equal vectors are one node; as many of its smallest ids as a query can return are kept with it. A first
graph comes from blocks of nodes that share a nearest pivot, a random sample of fixed size, and lie next
to each other on a line. Then, round after round, each node brings together its neighbours and the nodes
it is a neighbour of, where one at least is new since the last round; pairs nearer than what a node has
go to its list. A node brings together at most 2 K others, chosen by hash: that's the method's sampling,
and bounds each task's work for hubs. Rounds end when few lists change.

Where vectors lie in clusters far apart, the graph falls into pieces, of which the pivots know a part only.
So a query starts at its own node as well as at its nearest pivots. In each hop the nearest nodes of its beam that weren't opened yet
give their graph neighbours, by joins with the graph and the vectors, until none is left to open.
Distances on the way are of 16-bit copies while the graph is built; in the search they are exact.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

DEGREE = 26
ROUNDS = 8
PIVOTS = 256
BLOCK = 48
BEAM = 400
OPEN = 100
NEAREST = 10
#: Ends a packed vector of 64-bit floats.
WIDE = b"d"


def clean_vectors(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, node, vec): vectors that take part, as 64-bit floats where they are such, else as 32-bit ones; of several lengths the most common."""
    kind = "double" if df.schema[vector].dataType.simpleString() in ("array<double>", "array<bigint>", "array<int>") or "decimal" in df.schema[vector].dataType.simpleString() else "float"
    v = F.col(vector).cast(f"array<{kind}>")
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null and size(v) > 0")
    rows = rows.where("forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x <> 0)")
    width = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    rows = rows.where(F.size("v") == (width["n"] if width else 0))
    rows = rows.withColumn("v", F.transform("v", lambda x: F.when(x == 0, F.lit(0.0).cast(kind)).otherwise(x)))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = np.asarray(batch.column(2).flatten().to_numpy(zero_copy_only=False), "<f4" if kind == "float" else "<f8").reshape(batch.num_rows, -1)
            tag = b"" if kind == "float" else WIDE
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x.tobytes() + tag for x in raw], pa.binary())], names=["vec_id", "node", "vec"])

    return rows.select("vec_id", F.xxhash64("v").alias("node"), "v").mapInArrow(pack, "vec_id long, node long, vec binary")


def distinct_nodes(rows: DataFrame, most: int) -> DataFrame:
    """(node, vec, ids): each different vector with its `most` smallest ids; ids are thinned out in the tasks first."""

    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[bytes, list[int]]] = {}

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array([x[0] for x in held.values()], pa.binary()), pa.array([[-i for i in x[1]] for x in held.values()], pa.list_(pa.int64()))], names=["node", "vec", "ids"])

        for batch in batches:
            for i, node, vec in zip(*(batch.column(c).to_pylist() for c in ("vec_id", "node", "vec"))):
                ids = held.setdefault(node, (vec, []))[1]
                (heapq.heappush if len(ids) < most else heapq.heappushpop)(ids, -i)
            if len(held) >= 100_000:
                yield out()
                held.clear()
        yield out()

    some = rows.mapInArrow(thin, "node long, vec binary, ids array<long>")
    return some.groupBy("node").agg(F.first("vec").alias("vec"), F.slice(F.array_sort(F.flatten(F.collect_list("ids"))), 1, most).alias("ids"))


def _matrix(column: pa.Array | list[bytes], kind: str | None = None) -> np.ndarray:
    """Packed vectors as rows; without a kind, their own: a tag at the end tells 64-bit ones."""
    rows = column if isinstance(column, list) else column.to_pylist()
    if kind is None and rows and len(rows[0]) % 4:
        kind, rows = "<f8", [x[: -len(WIDE)] for x in rows]
    return np.frombuffer(b"".join(rows), kind or "<f4").reshape(len(rows), -1)


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of a and b, of stacks of such too."""
    both = (a * a).sum(-1)[..., :, None] + (b * b).sum(-1)[..., None, :] - 2 * (a @ np.swapaxes(b, -1, -2))
    return np.maximum(both, 0)


def _whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables that hold whole groups of rows sorted by key."""
    kept: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if kept is not None:
            table = pa.concat_tables([kept, table])
        if not table.num_rows:
            continue
        keys = table.column(key).to_numpy()
        last = int(np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])[-1])
        kept = table.slice(last)
        if last:
            yield table.slice(0, last).combine_chunks()
    if kept is not None and kept.num_rows:
        yield kept.combine_chunks()


def _best(edges: DataFrame, k: int) -> DataFrame:
    """The k nearest of each u, each once; of equal (u, v) the one that isn't new."""

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_groups(batches, "u"):
            u, v, d = (table.column(c).to_numpy() for c in ("u", "v", "d"))
            first = np.r_[True, (u[1:] != u[:-1]) | (v[1:] != v[:-1])]
            table, u, v, d = table.filter(pa.array(first)), u[first], v[first], d[first]
            order = np.lexsort((v, d, u))
            u = u[order]
            begin = np.r_[True, u[1:] != u[:-1]]
            rank = np.arange(len(u)) - np.maximum.accumulate(np.where(begin, np.arange(len(u)), 0))
            yield from table.take(pa.array(order[rank < k])).combine_chunks().to_batches()

    return edges.repartition("u").sortWithinPartitions("u", "v", "new").mapInArrow(take, edges.schema)


EDGE = "u long, v long, d float, new int"


def _first_graph(nodes: DataFrame, pivots: np.ndarray, k: int) -> DataFrame:
    """Neighbours within blocks of nodes of one pivot that lie next to each other on a line."""
    line = np.random.default_rng(5).normal(size=(2, pivots.shape[1] if pivots.size else 1)).astype(np.float32)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1)).astype(np.float32, copy=False)
            near = np.argsort(_squares(x, pivots), axis=1)[:, :2]
            for r in range(near.shape[1]):
                yield pa.RecordBatch.from_arrays([pa.array(near[:, r] * 2 + r), pa.array(x @ line[r]), batch.column(0), pa.array([y.tobytes() for y in x.astype("<f2")], pa.binary())], names=["cell", "at", "node", "vec"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, node, x = batch.column(0).to_numpy(), batch.column(2).to_numpy(), _matrix(batch.column(3), "<f2").astype(np.float32)
            for a in range(0, len(node), BLOCK):
                some = slice(a, a + BLOCK)
                d = _squares(x[some], x[some]) + np.where(cell[some, None] == cell[None, some], 0, 1e6).astype(np.float32)
                np.fill_diagonal(d, np.inf)
                near = np.argsort(d, axis=1)[:, : min(k, d.shape[1] - 1)]
                if near.size:
                    u = np.repeat(node[some], near.shape[1])
                    yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(node[some][near].ravel()), pa.array(np.take_along_axis(d, near, 1).ravel()), pa.array(np.ones(len(u), np.int32))], names=["u", "v", "d", "new"])

    placed = nodes.select("node", "vec").mapInArrow(place, "cell long, at float, node long, vec binary")
    return placed.repartitionByRange("cell", "at").sortWithinPartitions("cell", "at").mapInArrow(meet, EDGE)


def _local_join(graph: DataFrame, nodes: DataFrame, k: int, turn: int) -> DataFrame:
    """Pairs of nodes that meet at a common neighbour and are nearer than what one of them has."""
    bound = graph.groupBy("u").agg(F.max("d").alias("bound"), F.count(F.lit(1)).alias("n")).select(F.col("u").alias("member"), F.when(F.col("n") >= k, F.col("bound")).otherwise(F.lit(float("inf"))).cast("float").alias("bound"))
    ends = graph.select(F.col("u").alias("center"), F.col("v").alias("member"), "new").union(graph.select(F.col("v").alias("center"), F.col("u").alias("member"), "new"))

    def half(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.set_column(1, "vec", pa.array([x.tobytes() for x in _matrix(batch.column(1)).astype("<f2")], pa.binary()))

    def few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """At most 2 k members of each center, new ones first, else by hash."""
        for table in _whole_groups(batches, "center"):
            c, m = table.column("center").to_numpy(), table.column("member").to_numpy()
            first = np.r_[True, (c[1:] != c[:-1]) | (m[1:] != m[:-1])]
            table = table.filter(pa.array(first))
            c, m, new = (table.column(x).to_numpy() for x in ("center", "member", "new"))
            order = np.lexsort(((m * np.int64(0x9E3779B97F4A7C1)) ^ (m >> 13), -new, c))
            c = c[order]
            begin = np.r_[True, c[1:] != c[:-1]]
            rank = np.arange(len(c)) - np.maximum.accumulate(np.where(begin, np.arange(len(c)), 0))
            yield from table.take(pa.array(order[rank < 2 * k])).combine_chunks().to_batches()

    ends = ends.repartition("center").sortWithinPartitions("center", "member", F.desc("new")).mapInArrow(few, "center long, member long, new int")
    vectors = nodes.select("node", "vec").mapInArrow(half, "node long, vec binary").withColumnRenamed("node", "member")
    rows = ends.join(vectors, "member").join(bound, "member", "left").select("center", "member", "new", "vec", F.coalesce("bound", F.lit(float("inf")).cast("float")).alias("bound"))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = 2 * k
        for whole in _whole_groups(batches, "center"):
            c = whole.column("center").to_numpy()
            begin = np.flatnonzero(np.r_[True, c[1:] != c[:-1]])
            begin = np.r_[begin, len(c)]
            x = _matrix(whole.column("vec").combine_chunks() if isinstance(whole.column("vec"), pa.ChunkedArray) else whole.column("vec"), "<f2").astype(np.float32)
            member, new, bound = (whole.column(n).to_numpy() for n in ("member", "new", "bound"))
            for a in range(0, len(begin) - 1, 256):
                own = begin[a : a + 257]
                size = np.diff(own)
                at = np.arange(own[-1] - own[0])
                row = np.repeat(np.arange(len(size)), size)
                col = at - np.repeat(own[:-1] - own[0], size)
                fill = np.full((len(size), width), -1)
                fill[row, col] = at + own[0]
                real = fill >= 0
                d = _squares(x[fill], x[fill])
                fresh = (new[fill] > 0) & real
                ok = real[:, :, None] & real[:, None, :] & (fresh[:, :, None] | fresh[:, None, :]) & (d < np.where(real, bound[fill], 0)[:, :, None])
                ok &= ~np.eye(width, dtype=bool)
                g, i, j = np.nonzero(ok)
                u, v, dist = member[fill[g, i]], member[fill[g, j]], d[g, i, j]
                order = np.lexsort((v, dist, u))
                u, v, dist = u[order], v[order], dist[order]
                keep = np.r_[True, (u[1:] != u[:-1]) | (v[1:] != v[:-1])] if len(u) else np.empty(0, bool)
                u, v, dist = u[keep], v[keep], dist[keep]
                start = np.r_[True, u[1:] != u[:-1]] if len(u) else np.empty(0, bool)
                rank = np.arange(len(u)) - np.maximum.accumulate(np.where(start, np.arange(len(u)), 0)) if len(u) else np.empty(0)
                keep = rank < k
                yield pa.RecordBatch.from_arrays([pa.array(u[keep]), pa.array(v[keep]), pa.array(dist[keep]), pa.array(np.ones(int(keep.sum()), np.int32))], names=["u", "v", "d", "new"])

    return rows.repartition("center").sortWithinPartitions("center").mapInArrow(meet, EDGE)


def sample_pivots(nodes: DataFrame, n: int = PIVOTS) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the lowest hashes, of fixed number: names and vectors."""
    rows = nodes.select("node", "vec").orderBy(F.xxhash64("node", F.lit(11)), "node").limit(n).collect()
    return np.array([r["node"] for r in rows], np.int64), _matrix([bytes(r["vec"]) for r in rows]) if rows else np.zeros((0, 1), np.float32)


def neighbour_graph(nodes: DataFrame, k: int = DEGREE, rounds: int = ROUNDS) -> DataFrame:
    """(u, v, d, new): the k nearest found of each node, d a squared distance. nodes: node, vec."""
    pivots = sample_pivots(nodes)[1].astype(np.float32)
    graph = stored(_best(_first_graph(nodes, pivots, k), k))
    total = nodes.count()
    for turn in range(rounds):
        met = _local_join(graph, nodes, k, turn)
        graph = stored(_best(graph.withColumn("new", F.lit(0)).union(met), k))
        if graph.where("new = 1").count() <= 0.01 * k * total:
            break
    return graph


def search(queries: DataFrame, nodes: DataFrame, graph: DataFrame, n: int, beam: int = BEAM, opened: int = OPEN) -> DataFrame:
    """(query, node, d): the n nearest nodes found of each query, d the exact distance.

    queries: query, vec; a query that is named as a node starts there too.
    """
    names, pivots = sample_pivots(nodes)
    links = stored(graph.select("u", "v").union(graph.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1)).astype(np.float64)
            d = np.sqrt(((x[:, None, :] - pivots[None].astype(np.float64)) ** 2).sum(-1)) if len(x) <= 64 else np.concatenate([np.sqrt(((x[a : a + 64, None, :] - pivots[None].astype(np.float64)) ** 2).sum(-1)) for a in range(0, len(x), 64)])
            near = np.argsort(d, axis=1)[:, :opened]
            q = np.repeat(batch.column(0).to_numpy(), near.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(names[near].ravel()), pa.array(np.take_along_axis(d, near, 1).ravel()), pa.array(np.zeros(len(q), np.int32))], names=["query", "node", "d", "done"])

    def distance(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                d = np.sqrt(((_matrix(batch.column(2)).astype(np.float64) - _matrix(batch.column(3)).astype(np.float64)) ** 2).sum(1))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(d), pa.array(np.zeros(len(d), np.int32))], names=["query", "node", "d", "done"])

    def trim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The beam of each query: nearest nodes, each once; done of a node seen before is kept."""
        for table in _whole_groups(batches, "query"):
            q, node, d, done = (table.column(c).to_numpy() for c in ("query", "node", "d", "done"))
            first = np.r_[True, (q[1:] != q[:-1]) | (node[1:] != node[:-1])]
            q, node, d, done = q[first], node[first], d[first], done[first]
            order = np.lexsort((node, d, q))
            q, node, d, done = q[order], node[order], d[order], done[order]
            begin = np.r_[True, q[1:] != q[:-1]]
            rank = np.arange(len(q)) - np.maximum.accumulate(np.where(begin, np.arange(len(q)), 0))
            keep = rank < beam
            yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (q, node, d, done)], names=["query", "node", "d", "done"])

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """done 1 for the nearest nodes not opened yet, 2 for those opened before."""
        for table in _whole_groups(batches, "query"):
            q, done = table.column("query").to_numpy(), table.column("done").to_numpy().copy()
            done[done == 1] = 2
            fresh = np.flatnonzero(done == 0)
            begin = np.r_[True, q[fresh][1:] != q[fresh][:-1]] if len(fresh) else np.empty(0, bool)
            rank = np.arange(len(fresh)) - np.maximum.accumulate(np.where(begin, np.arange(len(fresh)), 0)) if len(fresh) else np.empty(0, int)
            done[fresh[rank < opened]] = 1
            yield from table.set_column(3, "done", pa.array(done)).combine_chunks().to_batches()

    state = "query long, node long, d double, done int"

    def next_beam(found: DataFrame) -> DataFrame:
        rows = found.repartition("query").sortWithinPartitions("query", "node", F.desc("done")).mapInArrow(trim, state)
        return stored(rows.mapInArrow(mark, state))

    own = queries.join(nodes.select(F.col("node").alias("query")), "query", "left_semi").select("query", F.col("query").alias("node"), F.lit(0.0).alias("d"), F.lit(0).alias("done"))
    beam_now = next_beam(queries.select("query", "vec").mapInArrow(start, state).union(own))
    while not beam_now.where("done = 1").isEmpty():
        front = beam_now.where("done = 1").select("query", F.col("node").alias("u"))
        met = front.join(links, "u").select("query", F.col("v").alias("node")).distinct().join(beam_now.select("query", "node"), ["query", "node"], "left_anti")
        met = met.join(nodes.select("node", "vec"), "node").join(queries.select("query", F.col("vec").alias("own")), "query").select("query", "node", "vec", "own")
        beam_now = next_beam(beam_now.union(met.mapInArrow(distance, state)))
    return beam_now.select("query", "node", "d")


def nearest(vectors: DataFrame, every: int = 100, n: int = NEAREST, k: int = DEGREE) -> DataFrame:
    """(query_id, rank, vec_id, score): the n nearest found of each row whose vec_id `every` divides.

    vectors: vec_id long, embedding array of numbers; other columns don't matter. Null vectors, zero
    vectors and such with null or non-finite numbers take no part, nor those of another length than the
    most common. Rows that repeat a vec_id are candidates each, but not for that id's own query, which is
    asked once, with the vector of the lowest hash. A query's own row is no candidate; ties go to the smaller vec_id; fewer candidates give
    fewer rows. score is the Euclidean distance in double precision.
    """
    rows = stored(clean_vectors(vectors))
    nodes = stored(distinct_nodes(rows, n + 1))
    graph = neighbour_graph(nodes, k)
    asked = rows.where(F.col("vec_id") % every == 0).groupBy(F.col("vec_id").alias("query")).agg(F.min(F.struct("node", "vec")).alias("one")).select("query", "one.*")
    found = search(nodes.join(asked.select("node").distinct(), "node", "left_semi").select(F.col("node").alias("query"), "vec"), nodes, graph, n + 1)
    found = asked.select(F.col("query").alias("query_id"), F.col("node").alias("own")).join(found.withColumnRenamed("query", "own"), "own")
    found = found.join(nodes.select("node", "ids"), "node").select("query_id", F.explode("ids").alias("vec_id"), F.col("d").alias("score")).where("vec_id <> query_id")
    from pyspark.sql import Window

    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n).select("query_id", "rank", "vec_id", "score")
