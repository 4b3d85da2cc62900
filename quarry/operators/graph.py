"""Directed graphs as edges(src, dst): loops end when nothing changes, each round cut by a checkpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators.rounds import shared_dir, stored

#: Steps of a loop between two checkpoints.
STEPS = 3


def _kept(df: DataFrame) -> DataFrame:
    if df.sparkSession.sparkContext.getCheckpointDir() is None:
        shared_dir(df.sparkSession)
    return df.checkpoint()


def clean_edges(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").where("src is not null and dst is not null and src <> dst").distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """(node, out_degree, in_degree), in one aggregation over both ends."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e"))
    return ends.groupBy("e.node").agg(F.sum("e.o").alias("out_degree"), F.sum("e.i").alias("in_degree"))


def reach(edges: DataFrame, depth: int) -> DataFrame:
    """(src, dst, hops): all pairs within so many hops, by the fewest; a delta joins only newly found pairs."""
    found = _kept(edges.select("src", "dst").distinct().withColumn("hops", F.lit(1)))
    step, new = edges.select(F.col("src").alias("dst"), F.col("dst").alias("next")).distinct(), found
    for k in range(2, depth + 1):
        new = new.join(step, "dst").select("src", F.col("next").alias("dst")).distinct().join(found, ["src", "dst"], "left_anti").withColumn("hops", F.lit(k))
        new = _kept(new)
        if new.isEmpty():
            break
        found = found.union(new)
    return found


def isolated(nodes: DataFrame, edges: DataFrame, node: str = "node") -> DataFrame:
    """Nodes without edges, as self relations (src, dst)."""
    ends = edges.select(F.col("src").alias(node)).union(edges.select(F.col("dst").alias(node)))
    return nodes.select(node).join(ends, node, "left_anti").select(F.col(node).alias("src"), F.col(node).alias("dst"))


def _spread(edges: DataFrame, labels: DataFrame, source: str, target: str) -> DataFrame:
    """Labels moved along edges from source to target until none falls: the smallest node that reaches each."""
    while True:
        moved = labels.select("node", "label", F.col("label").alias("was"))
        for _ in range(STEPS):
            near = edges.join(moved.select(F.col("node").alias(source), "label"), source).groupBy(target).agg(F.min("label").alias("near"))
            moved = moved.join(near.withColumnRenamed(target, "node"), "node", "left").select("node", F.least("label", F.coalesce("near", "label")).alias("label"), "was")
        moved = _kept(moved)
        labels = moved.select("node", "label")
        if moved.where("label <> was").isEmpty():
            return labels


def strongly_connected(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(node, scc): scc is the smallest node of the strongly connected component.

    In each round the smallest node that reaches a node colours it; a root with the nodes of its colour
    that reach it back is a component and leaves the graph. Sources and sinks leave at once. Nothing
    grows beyond the edges, unlike a closure.
    """
    left = _kept(clean_edges(edges))
    ends = edges.select(F.col("src").alias("node")).union(edges.select(F.col("dst").alias("node")))
    every = _kept((ends if nodes is None else ends.union(nodes.select("node"))).where("node is not null").distinct())
    found: DataFrame | None = None
    while not left.isEmpty():
        while True:  # nodes that nothing enters or leaves are components of their own
            inner = left
            for _ in range(STEPS):
                inner = inner.join(inner.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(inner.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst")
            inner = _kept(inner)
            done, left = inner.count() == left.count(), inner
            if done:
                break
        if left.isEmpty():
            break
        own = left.select(F.col("src").alias("node")).distinct().withColumn("label", F.col("node"))
        colour = _spread(left, _kept(own), "src", "dst")
        a, b = colour.withColumnRenamed("node", "src").withColumnRenamed("label", "sc"), colour.withColumnRenamed("node", "dst").withColumnRenamed("label", "dc")
        same = _kept(left.join(a, "src").join(b, "dst").where("sc = dc").select("src", "dst", "sc"))
        back = _kept(colour.select("node", F.when(F.col("node") == F.col("label"), F.lit(0)).otherwise(F.lit(1)).alias("label")))
        members = _spread(same.select("src", "dst"), back, "dst", "src").where("label = 0").select("node").join(colour, "node").select("node", F.col("label").alias("scc"))
        members = _kept(members)
        found = members if found is None else found.union(members)
        left = _kept(left.join(members.select(F.col("node").alias("src")), "src", "left_anti").join(members.select(F.col("node").alias("dst")), "dst", "left_anti").select("src", "dst"))
    if found is None:
        return every.select("node", F.col("node").alias("scc"))
    return every.join(found, "node", "left").select("node", F.coalesce("scc", "node").alias("scc"))


def condensed(edges: DataFrame, scc: DataFrame) -> DataFrame:
    """(src, dst, n): edges between different components, with how many each stands for."""
    a, b = scc.select(F.col("node").alias("src"), F.col("scc").alias("a")), scc.select(F.col("node").alias("dst"), F.col("scc").alias("b"))
    return clean_edges(edges).join(a, "src").join(b, "dst").where("a <> b").groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.count(F.lit(1)).alias("n"))


def topological_levels(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, level): 0 for nodes that depend on nothing, else one more than the highest of what they depend on (src on dst); nodes in or behind a cycle have no row."""
    left = _kept(clean_edges(edges))
    waiting = _kept(nodes.select("node").distinct())
    found, level = None, 0
    while True:
        ready = _kept(waiting.join(left.select(F.col("src").alias("node")).distinct(), "node", "left_anti").withColumn("level", F.lit(level)))
        if ready.isEmpty():
            return found if found is not None else ready
        found = ready if found is None else found.union(ready)
        waiting = _kept(waiting.join(ready, "node", "left_anti"))
        left = _kept(left.join(ready.select(F.col("node").alias("dst")), "dst", "left_anti").select("src", "dst"))
        level += 1


def votes(edges: DataFrame, chosen: DataFrame) -> DataFrame:
    """(node, votes): candidates next to chosen nodes, by their edges with them; edges both ways are two votes."""
    once = edges.select("src", "dst").distinct()
    both = once.select(F.explode(F.array(F.struct(F.col("src").alias("a"), F.col("dst").alias("node")), F.struct(F.col("dst").alias("a"), F.col("src").alias("node")))).alias("e")).select("e.a", "e.node")
    picked = chosen.select(F.col("node").alias("a"))
    return both.join(picked, "a", "left_semi").groupBy("node").agg(F.count(F.lit(1)).alias("votes")).join(chosen.select("node"), "node", "left_anti")


def roots(parents: DataFrame, most_rounds: int = 64) -> DataFrame:
    """(node, root, depth): where each node's chain of parents ends, and its length, by pointer jumping.

    parents: node, parent, one row at most for a node; a parent that has no row itself is a root. Every
    round doubles the jumps, so a chain of n takes log(n) joins. A cycle has no root and is an error.
    """
    at = _kept(parents.select("node", F.col("parent").alias("to"), F.lit(1).cast("long").alias("depth")))
    for _ in range(most_rounds):
        on = at.select(F.col("node").alias("to"), F.col("to").alias("next"), F.col("depth").alias("more"))
        if at.join(on, "to", "left_semi").isEmpty():
            return at.select("node", F.col("to").alias("root"), "depth")
        at = _kept(at.join(on, "to", "left").select("node", F.coalesce("next", "to").alias("to"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")))
    raise ValueError("a chain of parents is a cycle")


def between_mains(edges: DataFrame, mains: DataFrame) -> DataFrame:
    """edges (src, dst, src_file, dst_file) without those between two different files that both have a main; mains: file."""
    m = mains.select("file").distinct()
    a, b = (m.select(F.col("file").alias(c), F.lit(True).alias(f"_{c}")) for c in ("src_file", "dst_file"))
    both = F.coalesce("_src_file", F.lit(False)) & F.coalesce("_dst_file", F.lit(False)) & (F.col("src_file") != F.col("dst_file"))
    return edges.join(a, "src_file", "left").join(b, "dst_file", "left").where(~both).select(*edges.columns)


def one_end_in(edges: DataFrame, chosen: DataFrame) -> DataFrame:
    """edges (src, dst) of which exactly one end is chosen."""
    c = chosen.select("node").distinct()
    a, b = (c.select(F.col("node").alias(x), F.lit(True).alias(f"_{x}")) for x in ("src", "dst"))
    return edges.join(a, "src", "left").join(b, "dst", "left").where(F.col("_src").isNull() != F.col("_dst").isNull()).select(*edges.columns)


def segment_graph(facts: list[DataFrame], segments: DataFrame, mains: DataFrame | None = None) -> DataFrame:
    """(src, dst): distinct edges between segments, from facts of any number of kinds.

    facts: src and dst, locations as text; segments: file, ss, se, segment (the lowest of several that
    contain a location is the one meant); mains: file. Facts are parsed once and written; each distinct
    place is looked up once. Without the written tables Spark would parse anew for each use, and push what
    it knows of found places, regular expressions and all, down to the facts at every join.
    Facts of which an end can't be parsed, names no file or lies in no segment give no edge; edges between
    two different files that both have a main are left out, and so are loops.
    """
    from functools import reduce

    from quarry.functions import text as T
    from quarry.operators.intervals import least_ordinals

    texts = reduce(lambda a, b: a.union(b), [f.select(F.explode(F.array(F.struct("src", "dst"))).alias("t")) for f in facts])  # each text is made once, not for each field of its place
    every = texts.select(T.location(F.col("t.src")).alias("a"), T.location(F.col("t.dst")).alias("b"))
    every = stored(every.select(*[F.col(f"{at}.{field}").alias(f"{end}_{c}") for at, end in (("a", "src"), ("b", "dst")) for field, c in (("file", "file"), ("start_line", "ps"), ("end_line", "pe"))]).distinct()).where("src_file is not null and dst_file is not null")  # not before it's written: the filter would parse on its own
    ends = every.select(F.explode(F.array(*[F.struct(*[F.col(f"{end}_{c}").alias(c) for c in ("file", "ps", "pe")]) for end in ("src", "dst")])).alias("at")).select("at.*")
    found = stored(least_ordinals(ends, stored(segments.select("file", "ss", "se", "segment")), "segment"))
    met = every
    for end in ("src", "dst"):
        met = met.join(found.select(*[F.col(c).alias(f"{end}_{c}") for c in ("file", "ps", "pe")], F.col("segment").alias(end)), [f"{end}_{c}" for c in ("file", "ps", "pe")])
    met = met.select("src", "dst", "src_file", "dst_file")
    return clean_edges(met if mains is None else between_mains(met, mains))
