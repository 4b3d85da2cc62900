"""Queries of the procedures that run in rounds: batches grown from seeds, covers, colours, fixpoints, layers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import colouring, contraction, expansion, rounds
from quarry.plans.registry import EDGES, SCC, _edges, query
from quarry.sources.tables import table

BUDGET = 400


def _sizes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").cast("long").alias("node"), F.col("p_size").alias("size"))


@query()
def grown_batches(spark: SparkSession, d: str) -> DataFrame:
    """(seed_src, seed_dst, node, step): batches of parts grown along their relations from all seeds at once, sizes within the budget."""
    relations = _edges(spark, d)
    recent = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("node")).agg(F.max(F.unix_seconds(F.col("l_shipdate").cast("timestamp"))).alias("recent"))
    found = expansion.expand(relations, relations, _sizes(spark, d), expansion.independent(relations), BUDGET, recency=recent)
    return found.select(F.col("seed.src").alias("seed_src"), F.col("seed.dst").alias("seed_dst"), "node", "step")


def _changed(batches: DataFrame, k: int) -> DataFrame:
    """In the first rounds, a node in seven comes out with another interface."""
    return batches.where((F.col("node") % 7 == k) & F.lit(k < 3)).select("node")


@query(f"WITH {EDGES} SELECT src, dst, true AS covered, true AS within FROM ed")
def edge_cover(spark: SparkSession, d: str) -> DataFrame:
    """Whether each relation has stood in a batch, and no more often than allowed, when interfaces change and relations come back."""
    _, tries = expansion.cover(_edges(spark, d), _sizes(spark, d), BUDGET, _changed, most_tries=3)
    return tries.select("src", "dst", (F.col("tries") > 0).alias("covered"), (F.col("tries") <= 3).alias("within"))


@query("SELECT l_partkey AS lock, count(DISTINCT l_orderkey) AS tasks, count(DISTINCT l_orderkey) AS colours FROM lineitem GROUP BY l_partkey")
def conflict_free_batches(spark: SparkSession, d: str) -> DataFrame:
    """For each part, the orders that lock it and their colours: as many, or two orders of a colour would share it."""
    holds = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("task"), F.col("l_partkey").alias("lock"))
    found = colouring.coloured(holds).select("task", "colour", F.explode("locks").alias("lock"))
    return found.groupBy("lock").agg(F.count(F.lit(1)).alias("tasks"), F.countDistinct("colour").alias("colours"))


@query("WITH c AS (SELECT DISTINCT l_orderkey AS conflict, l_partkey AS piece FROM lineitem WHERE l_returnflag = 'R'), n AS (SELECT *, count(*) OVER (PARTITION BY conflict) AS n FROM c) SELECT n > 1 AS several, CASE WHEN n > 1 THEN conflict ELSE piece END AS name, count(DISTINCT conflict) AS conflicts, count(DISTINCT piece) AS pieces FROM n GROUP BY ALL")
def repair_tasks(spark: SparkSession, d: str) -> DataFrame:
    """Conflicts of several pieces are a task each, those of one piece and no other are one task."""
    conflicts = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("conflict"), F.col("l_partkey").alias("piece"))
    found = colouring.repair_tasks(conflicts).groupBy("task").agg(F.countDistinct("conflict").alias("conflicts"), F.countDistinct("piece").alias("pieces"))
    return found.select("task.several", F.col("task.name").cast("long").alias("name"), "conflicts", "pieces")


@query("WITH RECURSIVE g AS (SELECT o_orderkey, o_orderkey AS a, o_custkey AS b, 0 AS rounds FROM orders UNION ALL SELECT o_orderkey, b, a % b, rounds + 1 FROM g WHERE b <> 0 AND rounds < 5) SELECT o_orderkey, arg_max(a, rounds) AS a, max(rounds) AS rounds, arg_max(b, rounds) <> 0 AS unresolved FROM g GROUP BY o_orderkey")
def bounded_fixpoint(spark: SparkSession, d: str) -> DataFrame:
    """Each order's pair of keys is reduced until nothing remains, in five rounds at most; what isn't done by then is marked."""
    pairs = table(spark, d, "orders").select("o_orderkey", F.col("o_orderkey").alias("a"), F.col("o_custkey").alias("b"))
    step = lambda left, k: left.select("o_orderkey", F.col("b").alias("a"), (F.col("a") % F.col("b")).alias("b"))
    return rounds.fixpoint(pairs, step, F.col("b") == 0, 5).select("o_orderkey", "a", "rounds", "unresolved")


COMPONENTS = f"{SCC}, lab AS (SELECT node, coalesce(scc, node) AS scc FROM scc), dag AS (SELECT DISTINCT a.scc AS src, b.scc AS dst FROM ed JOIN lab a ON a.node = ed.src JOIN lab b ON b.node = ed.dst WHERE a.scc <> b.scc), walk AS (SELECT DISTINCT scc AS node, scc AS v, 0 AS n FROM lab UNION ALL SELECT walk.node, dag.dst, n + 1 FROM walk JOIN dag ON walk.v = dag.src)"


@query(f"{COMPONENTS} SELECT lab.node, scc, max(n)::BIGINT AS layer FROM lab JOIN walk ON walk.node = lab.scc GROUP BY ALL")
def component_layers(spark: SparkSession, d: str) -> DataFrame:
    return contraction.layers(_edges(spark, d))


@query(f"{COMPONENTS}, bad AS (SELECT scc FROM lab GROUP BY scc HAVING count(*) > 1) SELECT node, max(n)::BIGINT AS level FROM walk GROUP BY node HAVING count(*) FILTER (v IN (SELECT scc FROM bad)) = 0")
def levels_before_cycles(spark: SparkSession, d: str) -> DataFrame:
    return contraction.levels_before_cycles(_edges(spark, d))
