"""Levels and components of graphs with long chains: chains are contracted first, so rounds follow their logarithm.

edges(src, dst): src depends on dst. A node with one edge out is decided by where that leads, so it can
leave the graph: its edges in are led on to the end of its chain, and it comes back once that end is known.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators.graph import clean_edges, condensed
from quarry.operators.rounds import stored

#: Pointer jumps between two tables, and rounds of contraction in which less than this share goes end it.
JUMPS = 3
LEAST_SHARE = 0.05
#: A level that no path reaches: what stands in or behind a cycle has it or more.
NEVER = 1 << 40


# --------------------------------------------------------------------------- levels


def longest_levels(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, level): the longest path out of each node of an acyclic graph, in edges.

    nodes: node, and least, the level that it has at least (0 for ends of edges that aren't listed); edges: src, dst. In each round nodes without
    edges are settled, and each chain of nodes with one edge out is composed to one step by pointer
    jumping: such a node's level is max(c, level(end) + w), and two of these make one of the same form. What
    is left are nodes that depend on several; their chains shrink as what they depend on is settled. So a
    chain or tree takes a logarithm of its length, and only meshes of several edges at each level take a
    round a level. Edges never grow in number.
    """
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node"), F.lit(0).cast("long").alias("c"))
    left = stored(nodes.select("node", F.col("least").cast("long").alias("c")).union(ends).groupBy("node").agg(F.max("c").alias("c")))
    rest = stored(edges.select("src", "dst").distinct().withColumn("w", F.lit(1).cast("long")))
    settled: list[DataFrame] = []
    led: list[DataFrame] = []
    while not rest.isEmpty():
        outs = rest.groupBy("src").agg(F.count(F.lit(1)).alias("n"), F.min("dst").alias("to"), F.max("w").alias("w"))
        degree = stored(left.join(outs.withColumnRenamed("src", "node"), "node", "left").select("node", "c", F.coalesce("n", F.lit(0)).alias("n"), "to", "w"))
        settled.append(degree.where("n = 0").select("node", F.col("c").alias("level")))
        chain = degree.where("n = 1").select("node", "to", "c", "w")
        while True:  # to the end of each chain
            for _ in range(JUMPS):
                on = chain.select(F.col("node").alias("to"), F.col("to").alias("to2"), F.col("c").alias("c2"), F.col("w").alias("w2"))
                chain = chain.join(on, "to", "left").select("node", F.coalesce("to2", "to").alias("to"), F.greatest("c", F.col("w") + F.col("c2")).alias("c"), (F.col("w") + F.coalesce("w2", F.lit(0))).alias("w"))
            chain = stored(chain)
            if chain.join(chain.select(F.col("node").alias("to")), "to", "left_semi").isEmpty():
                break
        led.append(chain)
        several = degree.where("n > 1").select("node", "c")
        if several.isEmpty():
            left = several
            break
        known = settled[-1].select(F.col("node").alias("dst"), F.col("level").alias("end"))
        via = chain.select(F.col("node").alias("dst"), F.col("to").alias("on"), F.col("c").alias("by"), F.col("w").alias("more"))
        open_ = rest.join(several.select(F.col("node").alias("src")), "src", "left_semi").join(via, "dst", "left")
        open_ = open_.select("src", F.coalesce("on", "dst").alias("dst"), (F.col("w") + F.coalesce("more", F.lit(0))).alias("w"), (F.col("w") + F.col("by")).alias("least")).join(known, "dst", "left")
        open_ = stored(open_)
        bound = open_.groupBy(F.col("src").alias("node")).agg(F.max(F.greatest("least", F.col("w") + F.col("end"))).alias("least"))
        left = stored(several.join(bound, "node", "left").select("node", F.greatest("c", "least").alias("c")))
        rest = stored(open_.where("end is null").groupBy("src", "dst").agg(F.max("w").alias("w")))
    levels = left.select("node", F.col("c").alias("level"))
    for more in settled:
        levels = levels.unionByName(more)
    for chain in reversed(led):
        levels = stored(levels)
        ends = levels.select(F.col("node").alias("to"), F.col("level").alias("end"))
        levels = levels.unionByName(chain.join(ends, "to").select("node", F.greatest("c", F.col("end") + F.col("w")).alias("level")))
    return levels


def layers(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(node, scc, layer): the longest path of components that a node's component depends on; nodes of one cycle have one layer.

    Null ends and self loops are no edges; nodes: node, those without edges too.
    """
    scc = stored(components(edges, nodes))
    found = longest_levels(stored(condensed(edges, scc).select("src", "dst")), scc.select(F.col("scc").alias("node"), F.lit(0).alias("least")).distinct())
    return scc.join(found.select(F.col("node").alias("scc"), F.col("level").alias("layer")), "scc").select("node", "scc", "layer")


def levels_before_cycles(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(node, level) of the nodes from which no cycle can be reached: the order in which work without cycles can be done."""
    scc = stored(components(edges, nodes))
    sizes = scc.groupBy("scc").agg(F.count(F.lit(1)).alias("n")).select(F.col("scc").alias("node"), F.when(F.col("n") > 1, NEVER).otherwise(0).alias("least"))
    found = longest_levels(stored(condensed(edges, scc).select("src", "dst")), sizes)
    return found.where(F.col("level") < NEVER).select("node", "level")


# --------------------------------------------------------------------------- components


def _cycles(single: DataFrame) -> DataFrame:
    """(node, label): the nodes on cycles of single (node, to; one row for a node), with the smallest of their cycle.

    Nodes that nothing leads to leave first. Then pointers jump, and only nodes that are still jumped to
    stay: on a tree of height h that is over after a logarithm of h, and what is left, written anew, is
    shorter each time. Jumps that lead from all that's left to all of it are between nodes of cycles; label,
    the least on the way, is the cycle's once no further way lowers it.
    """
    at = stored(_hit(single.select("node", "to", F.col("node").alias("label"))))
    while True:
        at = at.withColumn("was", F.col("label"))
        for _ in range(JUMPS):
            on = at.select(F.col("node").alias("to"), F.col("to").alias("next"), F.col("label").alias("more"))
            at = at.join(on, "to").select("node", F.col("next").alias("to"), F.least("label", "more").alias("label"), "was")
        at = stored(at)
        met = stored(_hit(at))
        if met.count() == at.count() and at.where("label <> was").isEmpty():
            return at.select("node", "label")
        at = met.select("node", "to", "label")


def _hit(at: DataFrame) -> DataFrame:
    """The rows of at whose node another row leads to."""
    return at.join(at.select(F.col("to").alias("node")).distinct(), "node", "left_semi").select(*at.columns)


def _contracted(edges: DataFrame) -> tuple[DataFrame | None, DataFrame | None, DataFrame]:
    """(edges left, chains, cycles), None for edges and chains if no node has several edges out: chains has node, to, end of the nodes with one edge out that lead to one with several, end; all others with one edge leave for good.

    What leads into a cycle of nodes with one edge out, or to a node without any, is a component of its
    own, and such a cycle is one: cycles has node, label.
    """
    outs = stored(edges.groupBy("src").agg(F.count(F.lit(1)).alias("n"), F.min("dst").alias("to")))
    single, several = outs.where("n = 1").select(F.col("src").alias("node"), "to"), outs.where("n > 1").select("src")
    cycles = _cycles(single)
    if several.isEmpty():
        return None, None, cycles
    gone = single.join(cycles, "node", "left_anti").select("node", "to", F.col("to").alias("end"))
    while True:
        for _ in range(JUMPS):
            step = gone.select(F.col("node").alias("end"), F.col("end").alias("next"))
            gone = gone.join(step, "end", "left").select("node", "to", F.coalesce("next", "end").alias("end"))
        gone = stored(gone)
        if gone.join(gone.select(F.col("node").alias("end")), "end", "left_semi").isEmpty():
            break
    gone = gone.join(several.withColumnRenamed("src", "end"), "end", "left_semi").select("node", "to", "end")
    ends = gone.select(F.col("node").alias("dst"), "end").union(several.select("src", "src"))
    left = edges.join(several, "src", "left_semi").join(ends, "dst").select("src", F.col("end").alias("dst"))
    return stored(left.where("src <> dst").distinct()), stored(gone), cycles


def _trimmed(edges: DataFrame) -> DataFrame:
    """Edges without nodes that nothing enters or leaves, some rounds of it."""
    for _ in range(JUMPS):
        edges = edges.join(edges.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(edges.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst")
    return stored(edges)


def _returned(labels: DataFrame, edges: DataFrame, gone: DataFrame) -> DataFrame:
    """labels (node, label) with the nodes of chains: one is in its end's component if an edge from there leads into the chain at or before it."""
    label = lambda df, c: df.join(labels.select(F.col("node").alias(c), F.col("label").alias(f"_{c}")), c, "left").withColumn(f"_{c}", F.coalesce(f"_{c}", c))
    known = label(gone, "end").select("node", "to", F.col("_end").alias("label"))
    enters = label(edges.join(gone.select(F.col("node").alias("src")), "src", "left_anti").join(known.select(F.col("node").alias("dst"), "label"), "dst"), "src").where("_src = label")
    found = stored(enters.select(F.col("dst").alias("node"), "label").distinct())
    had = found.count()
    if not had:
        return labels
    on = gone.select("node", "to").join(gone.select(F.col("node").alias("to")), "to", "left_semi").select("node", "to")
    while True:  # on along the chains, twice as far each time
        for _ in range(JUMPS):
            found = found.union(found.join(on, "node").select(F.col("to").alias("node"), "label")).distinct()
            on = on.join(on.select(F.col("node").alias("to"), F.col("to").alias("next")), "to").select("node", F.col("next").alias("to"))
        found = stored(found)
        has = found.count()
        if has == had:
            return stored(labels.union(found))
        had, on = has, stored(on)


def components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(node, scc): scc is the smallest node of the strongly connected component.

    Chains are contracted along and against the edges and nodes that no cycle can hold are trimmed, until little
    goes; what is left, where nodes have several edges both ways, is coloured as in graph.strongly_connected.
    Then chains come back, the last first. A graph whose nodes have one edge out at most is done by the first contraction.
    """
    from quarry.operators.graph import strongly_connected

    left = stored(clean_edges(edges))
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node"))
    every = (ends if nodes is None else ends.union(nodes.select("node"))).where("node is not null").distinct()
    back: list[tuple[DataFrame, DataFrame]] = []
    labels = every.limit(0).select("node", F.col("node").alias("label"))
    had = left.count()
    while had:
        has = had
        for turned in (False, True):
            way = left.select(F.col("dst").alias("src"), F.col("src").alias("dst")) if turned else left
            rest, gone, cycles = _contracted(way)
            labels = labels.union(cycles)
            if rest is None:
                has = 0
                break
            back.append((way, gone))
            left = rest.select(F.col("dst").alias("src"), F.col("src").alias("dst")) if turned else rest
        if has:
            left = _trimmed(left)
            has = left.count()
        if had - has <= LEAST_SHARE * had:
            break
        had = has
    if had:
        labels = labels.union(strongly_connected(left).select("node", "scc"))
    labels = stored(labels) if back else labels
    for way, gone in reversed(back):
        labels = _returned(labels, way, gone)
    # nodes without a label are components of their own, or the one that others took as their label
    first = labels.groupBy("label").agg(F.min("node").alias("first")).select("label", F.least("label", "first").alias("first"))
    found = every.join(labels, "node", "left").select("node", F.coalesce("label", "node").alias("label"))
    return found.join(first, "label", "left").select("node", F.coalesce("first", "label").alias("scc"))
