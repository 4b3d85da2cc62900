"""Queries over facts: sources, filters, joins of edges, arrays and maps, with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import diagnostics, graph, pieces, relational
from quarry.plans.registry import query
from quarry.sources.tables import table

# --------------------------------------------------------------------------- fact queries


@query("SELECT DISTINCT p_name AS file, n_name AS folder FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey")
def include_paths(spark: SparkSession, d: str) -> DataFrame:
    """Includes joined with their file and its folder."""
    folders = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_name").alias("folder"))
    rows = table(spark, d, "lineitem").select("l_partkey", "l_suppkey").distinct().join(table(spark, d, "part").select("p_partkey", F.col("p_name").alias("file")), F.col("l_partkey") == F.col("p_partkey"))
    return rows.join(folders, F.col("l_suppkey") == F.col("s_suppkey")).select("file", "folder").distinct()


@query("SELECT p_partkey, p_name AS name, p_type AS body FROM part WHERE p_name <> '' AND p_brand NOT IN (SELECT p_brand FROM part WHERE p_size = 50 AND p_partkey % 7 = 0) AND p_type NOT IN ('PROMO', 'ECONOMY')")
def macro_facts(spark: SparkSession, d: str) -> DataFrame:
    """Macros but those without a name, those of a dimension of builtin ones, and those of a constant list."""
    p = table(spark, d, "part")
    builtin = p.where("p_size = 50 and p_partkey % 7 = 0").select("p_brand").distinct()
    return p.where((F.col("p_name") != "") & ~F.col("p_type").isin("PROMO", "ECONOMY")).join(builtin, "p_brand", "left_anti").select("p_partkey", F.col("p_name").alias("name"), F.col("p_type").alias("body"))


@query("SELECT DISTINCT o_orderpriority AS header, c_name AS impl FROM orders JOIN customer ON c_custkey = CASE WHEN o_orderstatus = 'F' THEN o_custkey ELSE o_custkey // 2 END WHERE o_totalprice > 500")
def conditional_target(spark: SparkSession, d: str) -> DataFrame:
    """A join whose key depends on the row: typedefs by what they stand for, others by themselves."""
    key = F.when(F.col("o_orderstatus") == "F", F.col("o_custkey")).otherwise(F.floor(F.col("o_custkey") / 2))
    o = table(spark, d, "orders").where("o_totalprice > 500").select("o_orderpriority", key.cast("long").alias("target"))
    return o.join(table(spark, d, "customer"), F.col("target") == F.col("c_custkey")).select(F.col("o_orderpriority").alias("header"), F.col("c_name").alias("impl")).distinct()


@query("SELECT event_id, event_type AS name FROM events WHERE json_extract_string(props, '$.k') = '1' OR event_type IN ('view', 'click')")
def const_globals(spark: SparkSession, d: str) -> DataFrame:
    const = (F.get_json_object("props", "$.k") == "1") | F.col("event_type").isin("view", "click")
    return table(spark, d, "events").where(const).select("event_id", F.col("event_type").alias("name"))


@query("SELECT CASE WHEN url LIKE '%.c' THEN 'c' WHEN regexp_matches(url, '\\.(cpp|cc|cxx)$') THEN 'cpp' WHEN regexp_matches(url, '[02468]$') THEN 'header' ELSE 'other' END AS route, count(*) AS n FROM pages GROUP BY 1")
def routed_files(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("url")
    route = F.when(u.endswith(".c"), "c").when(u.rlike(r"\.(cpp|cc|cxx)$"), "cpp").when(u.rlike("[02468]$"), "header").otherwise("other")
    return table(spark, d, "pages").groupBy(route.alias("route")).agg(F.count(F.lit(1)).alias("n"))


@query("WITH s AS (SELECT l_orderkey AS seg, count(*) AS decls, bool_and(l_returnflag = 'R') AS macros, bool_or(l_linestatus = 'F') AS used FROM lineitem GROUP BY l_orderkey) SELECT o_orderkey AS seg, decls FROM orders JOIN s ON seg = o_orderkey WHERE decls > 0 AND NOT (macros AND NOT used)")
def sealed_segments(spark: SparkSession, d: str) -> DataFrame:
    """Segments with declarations, but those of macros alone that nothing uses."""
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("seg")).agg(F.collect_list("l_returnflag").alias("decls"), F.some(F.col("l_linestatus") == "F").alias("used"))
    keep = (F.size("decls") > 0) & ~(F.forall("decls", lambda k: k == "R") & ~F.col("used"))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("seg")).join(lines, "seg").where(keep).select("seg", F.size("decls").cast("long").alias("decls"))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber + CAST(l_quantity AS INT) >= 40)")
def messages_after_offset(spark: SparkSession, d: str) -> DataFrame:
    """Messages of which some span ends at line 40 or later; one without spans goes."""
    spans = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct((F.col("l_linenumber") + F.col("l_quantity").cast("int")).alias("line_end"))).alias("spans"))
    rows = table(spark, d, "orders").join(spans, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return rows.where(diagnostics.not_before(F.col("spans"), F.lit(40))).select("o_orderkey")


@query("WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) SELECT doc_id, count(*) AS n FROM l WHERE trim(line, ' ,;{}' || chr(9) || chr(10)) <> '' GROUP BY doc_id")
def non_blank_lines(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.where(T.non_blank(F.col("line"))).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


# --------------------------------------------------------------------------- joins of edges

FILES = "e AS (SELECT DISTINCT l_partkey AS src, l_suppkey AS dst, 'f' || (l_partkey % 30) AS src_file, 'f' || (l_suppkey % 30) AS dst_file FROM lineitem)"


def _file_edges(spark: SparkSession, d: str) -> DataFrame:
    name = lambda c: F.concat(F.lit("f"), (F.col(c) % 30).cast("string"))
    return table(spark, d, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"), name("l_partkey").alias("src_file"), name("l_suppkey").alias("dst_file")).distinct()


@query(f"WITH {FILES}, m AS (SELECT 'f' || n_nationkey AS file FROM nation WHERE n_regionkey < 3) SELECT * FROM e WHERE NOT (src_file IN (SELECT file FROM m) AND dst_file IN (SELECT file FROM m) AND src_file <> dst_file)")
def cross_main_edges(spark: SparkSession, d: str) -> DataFrame:
    mains = table(spark, d, "nation").where("n_regionkey < 3").select(F.concat(F.lit("f"), F.col("n_nationkey").cast("string")).alias("file"))
    return graph.between_mains(_file_edges(spark, d), mains)


@query(f"WITH {FILES} SELECT src, dst FROM e WHERE (src % 3 = 0) <> (dst IN (SELECT p_partkey FROM part WHERE p_partkey % 3 = 0))")
def one_end_edges(spark: SparkSession, d: str) -> DataFrame:
    chosen = table(spark, d, "part").where("p_partkey % 3 = 0").select(F.col("p_partkey").alias("node"))
    return graph.one_end_in(_file_edges(spark, d).select("src", "dst"), chosen)


@query("WITH e AS (SELECT DISTINCT user_id AS src, user_id * 3 % 50 AS dst FROM events UNION SELECT DISTINCT user_id * 3 % 50, user_id FROM events WHERE user_id % 2 = 0), c AS (SELECT DISTINCT user_id AS node FROM events WHERE user_id % 4 = 0), b AS (SELECT src AS a, dst AS node FROM e UNION ALL SELECT dst, src FROM e) SELECT node, count(*) AS votes FROM b WHERE a IN (SELECT node FROM c) AND node NOT IN (SELECT node FROM c) GROUP BY node")
def votes_of_mutual_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges both ways count twice."""
    u = table(spark, d, "events").select(F.col("user_id").alias("src"), (F.col("user_id") * 3 % 50).alias("dst")).distinct()
    edges = u.union(u.where("src % 2 = 0").select("dst", "src")).distinct()
    return graph.votes(edges, u.where("src % 4 = 0").select(F.col("src").alias("node")).distinct())


@query("SELECT node AS src, node AS dst FROM (SELECT DISTINCT user_id AS node FROM events) WHERE node NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase')")
def lonely_users(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    bought = e.where("event_type = 'purchase'").select(F.col("user_id").alias("src"), F.lit(None).cast("long").alias("dst"))
    return graph.isolated(e.select(F.col("user_id").alias("node")).distinct(), bought)


@query("WITH m AS (SELECT doc_id, 'unresolved import `' || (doc_id % 40) || '::x`' AS message FROM documents) SELECT doc_id, n_name AS crate, n_regionkey AS version FROM m JOIN nation ON CAST(n_nationkey AS VARCHAR) = split_part(regexp_extract(message, '^unresolved imports? `([^ ]+)`', 1), '::', 1)")
def import_registry(spark: SparkSession, d: str) -> DataFrame:
    """What import errors name, looked up in a registry; unknown names go."""
    m = table(spark, d, "documents").select("doc_id", F.concat(F.lit("unresolved import `"), (F.col("doc_id") % 40).cast("string"), F.lit("::x`")).alias("message"))
    names = table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("root"), F.col("n_name").alias("crate"), F.col("n_regionkey").alias("version"))
    return m.withColumn("root", T.import_root(F.col("message"))).join(names, "root").select("doc_id", "crate", "version")


@query("WITH t AS (SELECT conv_id, turn, lead(turn) OVER w AS next, lead(role) OVER w AS b FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) SELECT conv_id, 'crate' || turn AS crate, 'feature' || next AS feature FROM t WHERE turn % 2 = 0 AND next IS NOT NULL")
def gated_features(spark: SparkSession, d: str) -> DataFrame:
    """Each even note with the one after it: the crate of the one, the feature of the other."""
    even = F.col("turn") % 2 == 0
    message = F.when(even, F.lit("found an item that was configured out")).otherwise(F.concat(F.lit("the item is gated behind the `feature"), F.col("turn").cast("string"), F.lit("` feature")))
    path = F.when(even, F.concat(F.lit("/r/.cargo/registry/src/index/crate"), F.col("turn").cast("string"), F.lit("-1.0.2/src/lib.rs")))
    notes = table(spark, d, "conversations").select("conv_id", F.struct("turn", message.alias("message"), path.alias("path")).alias("n"))
    children = notes.groupBy("conv_id").agg(F.array_sort(F.collect_list("n")).alias("children"))
    return children.select("conv_id", F.explode(diagnostics.gated_features(F.col("children"))).alias("f")).select("conv_id", "f.crate", "f.feature")


# --------------------------------------------------------------------------- aggregates, order


@query("WITH a AS (SELECT o_orderpriority, count_if(o_orderstatus = 'F') AS before, count_if(o_orderstatus = 'P') AS after FROM orders GROUP BY ALL) SELECT o_orderpriority, round(1 - after / nullif(before, 0), 8) AS reduced FROM a")
def relative_reduction(spark: SparkSession, d: str) -> DataFrame:
    a = diagnostics.kind_counts(table(spark, d, "orders"), ["o_orderpriority"], ["F", "P"], "o_orderstatus")
    return a.select("o_orderpriority", F.round(relational.reduction(F.col("F"), F.col("P")), 8).alias("reduced"))


@query("SELECT l_partkey AS conflict, array_to_string(list_sort(list_distinct(list(l_returnflag))), ',') AS pieces, array_to_string(list_reverse_sort(list_distinct(list(l_suppkey))), ',') AS owners FROM lineitem GROUP BY l_partkey")
def pieces_of_conflicts(spark: SparkSession, d: str) -> DataFrame:
    sets = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("conflict")).agg(F.array_sort(F.collect_set("l_returnflag")).alias("p"), F.sort_array(F.collect_set("l_suppkey"), asc=False).alias("o"))
    return sets.select("conflict", F.array_join("p", ",").alias("pieces"), F.array_join(F.col("o").cast("array<string>"), ",").alias("owners"))


@query("SELECT role, count(DISTINCT text) AS texts, min(text) AS first FROM conversations GROUP BY role")
def texts_of_categories(spark: SparkSession, d: str) -> DataFrame:
    """How many different texts each category has: counted from distinct rows, as a set in one row would grow with the data."""
    return table(spark, d, "conversations").select("role", "text").distinct().groupBy("role").agg(F.count("text").alias("texts"), F.min("text").alias("first"))


@query("SELECT * FROM (SELECT c_mktsegment AS method, n_regionkey AS r, round(avg(c_acctbal), 6) AS a FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL) PIVOT (first(a) FOR r IN (0 AS region0, 1 AS region1, 2 AS region2, 3 AS region3, 4 AS region4)) WHERE region0 IS NOT NULL AND region1 IS NOT NULL AND region2 IS NOT NULL AND region3 IS NOT NULL AND region4 IS NOT NULL")
def method_model_pivot(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    c = c.select(F.col("c_mktsegment").alias("method"), F.concat(F.lit("region"), F.col("n_regionkey").cast("string")).alias("model"), "c_acctbal")
    return relational.pivoted(c, "method", "model", [f"region{k}" for k in (3, 1, 0, 4, 2)], F.round(F.avg("c_acctbal"), 6))


@query("SELECT r_name, p_type AS kind, coalesce(n, 0) AS n FROM region CROSS JOIN (SELECT DISTINCT split_part(p_type, ' ', 1) AS p_type FROM part) LEFT JOIN (SELECT n_regionkey AS r_regionkey, split_part(p_type, ' ', 1) AS p_type, count(*) AS n FROM part JOIN nation ON p_partkey = n_nationkey GROUP BY ALL) USING (r_regionkey, p_type)")
def cells_with_zeros(spark: SparkSession, d: str) -> DataFrame:
    """All cells of two small dimensions, those without rows too."""
    p = table(spark, d, "part").select("p_partkey", F.split_part("p_type", F.lit(" "), F.lit(1)).alias("kind"))
    counts = p.join(table(spark, d, "nation"), F.col("p_partkey") == F.col("n_nationkey")).groupBy(F.col("n_regionkey").alias("r_regionkey"), "kind").agg(F.count(F.lit(1)).alias("n"))
    cells = table(spark, d, "region").crossJoin(p.select("kind").distinct())  # two small dimensions
    return cells.join(counts, ["r_regionkey", "kind"], "left").select("r_name", "kind", F.coalesce("n", F.lit(0)).alias("n"))


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45) ORDER BY md5('7-' || o_orderkey), o_orderkey LIMIT 1")
def first_eligible(spark: SparkSession, d: str) -> DataFrame:
    """The first row that isn't taken, in an order of chance that a seed fixes."""
    taken = table(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    free = table(spark, d, "orders").where("o_orderstatus = 'O'").select("o_orderkey").join(taken, "o_orderkey", "left_anti")
    return free.orderBy(F.md5(F.concat(F.lit("7-"), F.col("o_orderkey").cast("string"))), "o_orderkey").limit(1)


# --------------------------------------------------------------------------- arrays and maps


@query("SELECT event_id, 60 * pow(2, user_id % 6) AS wait FROM events")
def backoff_seconds(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", (60 * F.pow(F.lit(2.0), F.col("user_id") % 6)).alias("wait"))


@query("WITH a AS (SELECT l_orderkey AS k, list_sort(list_distinct(list(l_returnflag))) AS l, list_sort(list_distinct(list(l_linestatus || l_returnflag))) AS r, list(l_suppkey) AS s, list(l_partkey) AS p FROM lineitem GROUP BY l_orderkey) SELECT k, len(l) = len(r) AS same_size, list_has_any(s, p) AS conflict, array_to_string(list_sort(list_distinct(list_concat(l, ['Z']))), '') AS with_z FROM a")
def locks_and_unions(spark: SparkSession, d: str) -> DataFrame:
    """Whether two sets meet, and a value added where it is absent."""
    a = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.collect_set("l_returnflag").alias("l"), F.collect_set(F.concat("l_linestatus", "l_returnflag")).alias("r"), F.collect_set("l_suppkey").alias("s"), F.collect_set("l_partkey").alias("p"))
    return a.select("k", (F.size("l") == F.size("r")).alias("same_size"), F.arrays_overlap("s", "p").alias("conflict"), F.array_join(F.array_sort(F.array_union("l", F.array(F.lit("Z")))), "").alias("with_z"))


@query("WITH n AS (SELECT o_custkey, max(o_orderkey) AS last FROM orders GROUP BY o_custkey), a AS (SELECT o_custkey, o_orderstatus, max(o_orderkey) AS v FROM orders WHERE o_orderkey % 2 = 0 GROUP BY ALL), b AS (SELECT o_custkey, o_orderstatus, max(o_orderkey) AS v FROM orders WHERE o_orderkey % 2 = 1 GROUP BY ALL), m AS (SELECT coalesce(a.o_custkey, b.o_custkey) AS c, coalesce(a.o_orderstatus, b.o_orderstatus) AS s, coalesce(b.v, a.v) AS v, a.v IS NOT NULL AND b.v IS NOT NULL AS twice FROM a FULL JOIN b USING (o_custkey, o_orderstatus)) SELECT c AS o_custkey, string_agg(s || '=' || v, ',' ORDER BY s) AS merged, bool_and(twice) AS same_keys, max(CASE WHEN s = 'F' THEN v ELSE 0 END) AS f FROM m GROUP BY c")
def merged_maps(spark: SparkSession, d: str) -> DataFrame:
    """Two maps: whether their keys are the same, both merged with the right one's values first, and a lookup with a default."""
    latest = table(spark, d, "orders").groupBy("o_custkey", "o_orderstatus", (F.col("o_orderkey") % 2).alias("side")).agg(F.max("o_orderkey").alias("v"))
    entries = lambda side: F.map_from_entries(F.array_compact(F.collect_list(F.when(F.col("side") == side, F.struct("o_orderstatus", "v")))))
    maps = latest.groupBy("o_custkey").agg(entries(0).alias("a"), entries(1).alias("b"))
    keys = F.array_sort(F.array_union(F.map_keys("a"), F.map_keys("b")))
    value = lambda k: F.coalesce(F.try_element_at(F.col("b"), k), F.try_element_at(F.col("a"), k))
    merged = F.array_join(F.transform(keys, lambda k: F.concat(k, F.lit("="), value(k).cast("string"))), ",")
    same = F.array_sort(F.map_keys("a")) == F.array_sort(F.map_keys("b"))
    return maps.select("o_custkey", merged.alias("merged"), same.alias("same_keys"), F.coalesce(value(F.lit("F")), F.lit(0)).alias("f"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE 'v' || c_nationkey END AS version, CASE WHEN c_custkey % 2 = 0 THEN '' ELSE c_mktsegment END AS features FROM customer")
def string_or_struct(spark: SparkSession, d: str) -> DataFrame:
    """A value that is a plain string or an object becomes an object either way."""
    even = F.col("c_custkey") % 2 == 0
    raw = F.when(even, F.to_json(F.struct(F.col("c_name").alias("v")))).otherwise(F.to_json(F.struct(F.struct(F.concat(F.lit("v"), F.col("c_nationkey").cast("string")).alias("version"), F.array("c_mktsegment").alias("features")).alias("v"))))
    v = F.get_json_object("raw", "$.v")
    full = F.from_json(v, "version string, features array<string>")
    plain = ~v.startswith("{")
    return table(spark, d, "customer").select("c_custkey", raw.alias("raw")).select("c_custkey", F.when(plain, v).otherwise(full["version"]).alias("version"), F.when(plain, "").otherwise(F.array_join(full["features"], ",")).alias("features"))


# --------------------------------------------------------------------------- texts, inherited values, pieces


@query("WITH t AS (SELECT conv_id, turn, text, text || ' { ' || role || ' }' AS whole, '{ ' || role || ' }' AS body FROM conversations) SELECT conv_id, turn, replace(whole, body, '') AS signature, concat_ws(chr(10), nullif(CASE WHEN turn % 2 = 0 THEN '' ELSE 'c' END, ''), nullif('a' || turn, ''), text) AS joined FROM t")
def signatures(spark: SparkSession, d: str) -> DataFrame:
    body = F.concat(F.lit("{ "), F.col("role"), F.lit(" }"))
    whole = F.concat(F.col("text"), F.lit(" "), body)
    note = F.when(F.col("turn") % 2 == 0, "").otherwise("c")
    return table(spark, d, "conversations").select("conv_id", "turn", F.replace(whole, body, F.lit("")).alias("signature"), T.joined(note, F.concat(F.lit("a"), F.col("turn").cast("string")), F.col("text")).alias("joined"))


@query("SELECT page_id, CASE WHEN contains(url, 'item') THEN url ELSE regexp_replace(url, '/[^/]*$', '') END AS folder, list_aggregate(list_reverse(string_split(url, '/')), 'string_agg', '/') AS back FROM pages")
def reversed_paths(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("url")
    return table(spark, d, "pages").select("page_id", F.when(F.contains(u, F.lit("item")), u).otherwise(F.regexp_replace(u, "/[^/]*$", "")).alias("folder"), F.array_join(F.reverse(F.split(u, "/")), "/").alias("back"))


@query("SELECT event_id, last_value(CASE WHEN event_type = 'view' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS file FROM events")
def inherited_file(spark: SparkSession, d: str) -> DataFrame:
    """A value that holds for all rows after it, until the next one."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, d, "events").select("event_id", F.last(F.when(F.col("event_type") == "view", F.col("event_id")), ignorenulls=True).over(w).alias("file"))


TREE = "t AS (SELECT o_orderkey AS k, 0 AS line, o_orderstatus AS s FROM orders UNION SELECT l_orderkey, l_linenumber, '' FROM lineitem)"


def _tree(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("k").cast("string")
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.lit(0).alias("line"), F.col("o_orderstatus").alias("kind"))
    rows = o.union(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.lit("item")).distinct())
    path = F.when(F.col("line") == 0, F.array(key)).otherwise(F.array(key, F.col("line").cast("string")))
    return rows.select(F.lit("all").alias("doc_id"), path.alias("path"), "kind", key.alias("text"), F.col("line").alias("ord"), "k", "line")


@query(f"WITH {TREE} SELECT k, line FROM t WHERE NOT (line = 0 AND k % 5 = 0)")
def shadowed_imports(spark: SparkSession, d: str) -> DataFrame:
    """Top-level pieces without those whose name a new import takes."""
    rows = _tree(spark, d)
    uses = rows.where("line = 0 and k % 5 = 0").select("doc_id", F.get("path", F.lit(0)).alias("name"))
    top = rows.where("line = 0")
    return pieces.shadowed(top, uses).select("k", "line").union(rows.where("line > 0").select("k", "line"))


@query(f"WITH {TREE} SELECT k, line, k % 4 = 0 AS inside FROM t")
def piece_halves(spark: SparkSession, d: str) -> DataFrame:
    rows = _tree(spark, d)
    inside, outside = pieces.halves(rows, rows.where("line = 0 and k % 4 = 0").select("doc_id", "path"))
    return inside.select("k", "line", F.lit(True).alias("inside")).union(outside.select("k", "line", F.lit(False).alias("inside")))


@query("WITH o AS (SELECT o_orderkey AS k, o_orderstatus AS s FROM orders), li AS (SELECT DISTINCT l_orderkey AS k, l_linenumber AS line FROM lineitem), n AS (SELECT k, CASE WHEN k % 4 = 0 THEN 'F' ELSE s END AS s FROM o WHERE k % 2 = 0), ni AS (SELECT k, line FROM li WHERE k % 2 = 0 AND line % 2 = 0) SELECT k, 0 AS line, CASE WHEN k % 2 = 0 THEN 'new' ELSE 'old' END AS side FROM o UNION ALL SELECT k, line, 'new' FROM ni UNION ALL SELECT li.k, li.line, 'old' FROM li WHERE li.k % 2 = 1 OR (line % 2 = 1 AND EXISTS (SELECT 1 FROM n JOIN o USING (k) WHERE n.k = li.k AND n.s = o.s))")
def upsert_of_trees(spark: SparkSession, d: str) -> DataFrame:
    """Containers replaced by new ones: unnamed children stay where the kind is the same, and go where it isn't."""
    rows = _tree(spark, d).select("doc_id", "path", "kind", F.lit("old").alias("text"), "ord")
    key, line = F.get("path", F.lit(0)).cast("long"), F.coalesce(F.get("path", F.lit(1)).cast("long"), F.lit(0))
    new = rows.where((key % 2 == 0) & (line % 2 == 0)).withColumn("text", F.lit("new")).withColumn("kind", F.when((line == 0) & (key % 4 == 0), "F").otherwise(F.col("kind")))
    return pieces.upsert(rows, new).select(key.alias("k"), line.cast("int").alias("line"), F.col("text").alias("side"))


@query("WITH s AS (SELECT event_id, user_id % 4 AS n, CAST(value AS INT) AS v FROM events), c AS (SELECT event_id, n, unnest(range(0, n + 1)) AS i FROM s) SELECT event_id, 10 * i + CASE WHEN i = n THEN 5 ELSE 0 END AS line FROM c WHERE i = n OR (event_id + i) % 2 = 1")
def expansion_spans(spark: SparkSession, d: str) -> DataFrame:
    """Spans inside macros: each level's definition site that has a place, then the innermost call site."""
    n, depth = F.col("user_id") % 4, 3
    site = lambda line, byte: F.struct(F.lit("m.rs").alias("file_name"), line.alias("line_start"), line.alias("line_end"), byte.alias("byte_start"))
    span = None
    for level in range(depth, -1, -1):  # built from the innermost span out
        own = [F.lit("m.rs").alias("file_name"), (10 * n + 5).cast("long").alias("line_start"), (10 * n + 5).cast("long").alias("line_end"), F.lit(1).cast("long").alias("byte_start")]
        if span is None:
            span = F.struct(*own)
        else:
            step = F.struct(span.alias("span"), site(F.lit(10 * level).cast("long"), ((F.col("event_id") + level) % 2).cast("long")).alias("def_site_span"))
            span = F.struct(*own, F.when(n > level, step).alias("expansion"))
    rows = table(spark, d, "events").select("event_id", span.alias("span"))
    return rows.select("event_id", F.explode(diagnostics.unfolded(F.col("span"), depth)).alias("s")).select("event_id", F.col("s.line_start").alias("line"))
