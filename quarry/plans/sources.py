"""Queries of sources, sinks and small functions: files are written to the shared folder from the given tables and read back by the declared schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import diagnostics, fences, intervals, pieces, relational, rounds
from quarry.plans.registry import MESSAGES, SQL, VERSIONS, _messages, _versions, query
from quarry.sources import tables

UNITS = "u AS (SELECT DISTINCT o_custkey % 20 AS build, o_orderkey % 400 AS lo, o_orderkey % 400 + o_orderkey % 9 AS hi FROM orders)"
LOGGED = (
    f"m AS (SELECT t.*, n_chars FROM ({MESSAGES}) t JOIN documents USING (doc_id) WHERE doc_id % 4 <> 0 AND doc_id % 13 <> 0), "
    "s AS (SELECT doc_id, CASE WHEN outside THEN 'src/other.rs' ELSE 'src/lib.rs' END AS file, CASE WHEN n_chars % 5 = 0 THEN n_chars * 3 % 400 ELSE n_chars % 400 END AS a, 1 AS more FROM m UNION ALL SELECT doc_id, 'src/lib.rs', n_chars * 7 % 400, 0 FROM m), "
    f"{UNITS}, h AS (SELECT DISTINCT doc_id, doc_id % 20 AS build, lo, hi FROM s JOIN u ON u.build = doc_id % 20 AND file = 'src/lib.rs' AND lo <= a AND a + more <= hi)"
)


def _build_log(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(msg, build, text, spans) of the errors in a log of build events, one JSON text a line, and the builds' units."""
    n = F.col("n_chars")
    docs = tables.table(spark, d, "documents").select("doc_id", "n_chars").join(_messages(spark, d).select("doc_id", "message", "outside"), "doc_id")
    place = lambda file, a, more: [file.alias("file_name"), F.lit(1).alias("byte_start"), a.cast("int").alias("line_start"), (a + more).cast("int").alias("line_end"), F.lit(True).alias("is_primary")]
    file = F.when(F.col("outside"), "src/other.rs").otherwise("src/lib.rs")
    site = F.struct(F.lit("make!").alias("macro_decl_name"), F.struct(*place(file, n * 3 % 400, 1)).alias("span"), F.struct(F.lit("<std>").alias("file_name"), F.lit(0).alias("byte_start")).alias("def_site_span"))
    own = F.when(n % 5 == 0, F.struct(*place(F.lit("<macro>"), n % 400, 1), site.alias("expansion"))).otherwise(F.struct(*place(file, n % 400, 1), F.lit(None).cast("struct<macro_decl_name:string,span:struct<file_name:string,byte_start:int,line_start:int,line_end:int,is_primary:boolean>,def_site_span:struct<file_name:string,byte_start:int>>").alias("expansion")))
    rendered = F.when(F.col("doc_id") % 13 == 0, "error: aborting due to 2 previous errors; 1 warning emitted").otherwise(F.col("message"))
    child = F.struct(F.lit("note").alias("message"), F.lit("note").alias("level"), F.array(F.struct(*place(F.lit("src/lib.rs"), n * 7 % 400, 0))).alias("spans"))
    event = F.struct(F.lit("compiler-message").alias("reason"), F.col("doc_id").cast("string").alias("package_id"), F.struct("message", F.when(F.col("doc_id") % 4 == 0, "warning").otherwise("error").alias("level"), rendered.alias("rendered"), F.array(own).alias("spans"), F.array(child).alias("children")).alias("message"))
    path = rounds.shared_dir(spark)
    docs.select(F.to_json(event).alias("value")).write.text(path)
    events = diagnostics.errors_only(tables.build_events(spark, path))
    spans = F.flatten(F.transform(diagnostics.all_spans(), lambda s: diagnostics.unfolded(s, tables.EXPANSIONS)))
    rows = events.select(F.col("package_id").cast("long").alias("msg"), (F.col("package_id").cast("long") % 20).alias("build"), F.col("message.message").alias("text"), spans.alias("spans"))
    units = tables.table(spark, d, "orders").select((F.col("o_custkey") % 20).alias("build_id"), (F.col("o_orderkey") % 400).alias("lo"), (F.col("o_orderkey") % 400 + F.col("o_orderkey") % 9).alias("hi")).distinct()
    return rows, units


@query(f"WITH {LOGGED} SELECT build, messages, places, coalesce(units, 0) AS units FROM (SELECT doc_id % 20 AS build, count(*) AS messages FROM m GROUP BY 1) JOIN (SELECT doc_id % 20 AS build, count(DISTINCT (file, a, more)) AS places FROM s GROUP BY 1) USING (build) LEFT JOIN (SELECT build, count(DISTINCT (lo, hi)) AS units FROM h GROUP BY 1) USING (build)")
def build_log_summary(spark: SparkSession, d: str) -> DataFrame:
    """Messages, their distinct places and the units they lie in, for each build of a log that was written and read back."""
    rows, units = _build_log(spark, d)
    return diagnostics.per_build(rows, "build", "msg", "spans", units)


@query(f"WITH {LOGGED}, k AS (SELECT m.doc_id, CASE WHEN coalesce(n, 0) > 1 THEN 'inter_unit' WHEN outside OR contains(message, 'crate') OR contains(message, 'failed to resolve') OR contains(message, 'unresolved import') THEN 'external_crate' WHEN regexp_matches(message, '^cannot find .* in this scope') OR regexp_matches(message, '^no .* found for .* in the current scope') OR regexp_matches(message, '^.* call to .* function .*') THEN 'inter_unit' ELSE 'intra_unit' END AS kind FROM m LEFT JOIN (SELECT doc_id, count(*) AS n FROM h GROUP BY doc_id) c USING (doc_id)) SELECT doc_id % 20 AS build, count_if(kind = 'external_crate') AS external_crate, count_if(kind = 'inter_unit') AS inter_unit, count_if(kind = 'intra_unit') AS intra_unit FROM k GROUP BY doc_id % 20")
def build_log_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Errors of a log by kind, for each build."""
    rows, units = _build_log(spark, d)
    return diagnostics.kind_counts(diagnostics.classified(rows, units, "build", "msg", "text"), ["build"], ["external_crate", "inter_unit", "intra_unit"])


@query("SELECT DISTINCT c_name AS name, c_mktsegment AS class FROM customer")
def tuple_files(spark: SparkSession, d: str) -> DataFrame:
    """Rows of result files, one for each nation."""
    c = tables.table(spark, d, "customer").groupBy("c_nationkey").agg(F.collect_list(F.array("c_name", "c_mktsegment")).alias("tuples"))
    path = rounds.shared_dir(spark)
    c.select("c_nationkey", F.struct("tuples").alias("#select")).repartition("c_nationkey").write.partitionBy("c_nationkey").json(path)
    return tables.tuples(spark, path, ["name", "class"])


@query("SELECT doc_id, lang || '/' || source || '.h|' || source || '.h' AS paths FROM documents")
def include_directives(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.lit('#include "'), F.col("lang"), F.lit("/"), F.col("source"), F.lit('.h"\nint x;\n# include <no.h>\n#include   <'), F.col("source"), F.lit(".h>\n"))
    return tables.table(spark, d, "documents").select("doc_id", F.array_join(T.includes(text), "|").alias("paths"))


@query("SELECT event_id, event_type AS key, CASE WHEN event_id % 3 = 0 THEN '' ELSE props || '=x' END AS value FROM events")
def key_values(spark: SparkSession, d: str) -> DataFrame:
    pair = F.when(F.col("event_id") % 3 == 0, F.col("event_type")).otherwise(F.concat("event_type", F.lit("="), "props", F.lit("=x")))
    return tables.table(spark, d, "events").select("event_id", T.key_value(pair).alias("p")).select("event_id", "p.key", "p.value")


@query(f"WITH b AS ({SQL['fenced_blocks']}) SELECT conv_id, arg_min(body, block) AS body, false AS every FROM b WHERE lang = 'user' GROUP BY conv_id UNION ALL SELECT conv_id, string_agg(body, chr(10) ORDER BY block), true FROM b WHERE lang = 'user' GROUP BY conv_id")
def blocks_of_language(spark: SparkSession, d: str) -> DataFrame:
    from quarry.plans.registry import fenced_blocks

    b = fenced_blocks(spark, d)
    return fences.first_or_all(b, "conv_id", "user", False).withColumn("every", F.lit(False)).union(fences.first_or_all(b, "conv_id", "user", True).withColumn("every", F.lit(True)))


@query("SELECT conv_id, turn, trim(role || ' ' || replace(text, '`', ''), ' ' || chr(9) || chr(10) || chr(13)) || '|' || trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS bodies FROM conversations WHERE NOT contains(text, '`')")
def fenced_bodies(spark: SparkSession, d: str) -> DataFrame:
    fence = F.lit("```")
    md = F.concat(F.lit("a "), fence, F.lit("md \n"), "role", F.lit(" "), "text", F.lit("\n"), fence, F.lit(" b\n"), fence, F.lit("\n"), "text", fence, F.lit(" open"), fence)
    return tables.table(spark, d, "conversations").where(~F.col("text").contains("`")).select("conv_id", "turn", F.array_join(T.fenced_bodies(md), "|").alias("bodies"))


@query("SELECT 'lineitem' AS name, count(*) AS rows, true AS same, true AS other FROM lineitem")
def result_hashes(spark: SparkSession, d: str) -> DataFrame:
    """Whether a result and a shuffled copy of it have one hash, and a changed copy another."""
    rows = tables.table(spark, d, "lineitem")
    a, b = relational.result_hash(rows), relational.result_hash(rows.repartition("l_partkey"))
    c = relational.result_hash(rows.withColumn("l_tax", F.col("l_tax") + F.when(F.col("l_linenumber") == 1, 1).otherwise(0)))
    a, b, c = (x.select(F.col("hash").alias(n), F.col("rows").alias(f"{n}_rows"), F.lit("lineitem").alias("name")) for x, n in ((a, "a"), (b, "b"), (c, "c")))
    return a.join(b, "name").join(c, "name").select("name", F.col("a_rows").alias("rows"), ((F.col("a") == F.col("b")) & (F.col("a_rows") == F.col("b_rows"))).alias("same"), (F.col("a") != F.col("c")).alias("other"))


@query("SELECT 's/' || l_suppkey || '.c' AS path, 'clang -c ' || string_agg(DISTINCT '-Iinc/' || l_returnflag, ' ' ORDER BY '-Iinc/' || l_returnflag) || ' s/' || l_suppkey || '.c' AS line FROM lineitem GROUP BY l_suppkey")
def build_scripts(spark: SparkSession, d: str) -> DataFrame:
    files = tables.table(spark, d, "lineitem").select(F.concat(F.lit("s/"), F.col("l_suppkey").cast("string"), F.lit(".c")).alias("path"), F.concat(F.lit("inc/"), "l_returnflag").alias("include_dir"))
    return tables.build_script(files)


@query("SELECT conv_id, turn, 'fn a() {}' || chr(10) || '#[unsafe(no_mangle)] ' || role AS text FROM conversations")
def exported_texts(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.lit("  #[test]\nfn a() {}\n#[no_mangle] "), "role")
    return tables.table(spark, d, "conversations").select("conv_id", "turn", T.exported(text).alias("text"))


@query(f"WITH {VERSIONS} SELECT o_orderkey FROM old WHERE o_orderkey IN (SELECT o_orderkey FROM new)")
def evicted_pieces(spark: SparkSession, d: str) -> DataFrame:
    shape = lambda df: df.select(F.lit("all").alias("doc_id"), F.array(F.col("o_orderkey").cast("string")).alias("path"), "o_orderkey")
    return pieces.evicted(*map(shape, _versions(spark, d))).select("o_orderkey")


@query("WITH l AS (SELECT l_orderkey AS k, l_linenumber AS n, min(l_returnflag) AS t FROM lineitem GROUP BY ALL), g AS (SELECT k, CASE k % 3 WHEN 0 THEN 'struct' WHEN 1 THEN 'impl' ELSE 'mod' END AS kind, CASE k % 3 WHEN 0 THEN string_agg(t, ',' || chr(10) ORDER BY n) ELSE string_agg(t, chr(10) ORDER BY n) END AS body FROM l GROUP BY k) SELECT k, CASE kind WHEN 'mod' THEN body ELSE kind || ' T' || k || ' {' || chr(10) || body || chr(10) || '}' END AS text FROM g")
def rendered_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Orders as containers with heads, tails and separators of their kinds."""
    lines = tables.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("ord")).agg(F.min("l_returnflag").alias("text"))
    kind = F.when(F.col("doc_id") % 3 == 0, "struct").when(F.col("doc_id") % 3 == 1, "impl").otherwise("mod")
    rows = pieces.rendered(lines, "\0").withColumn("kind", kind)
    return rows.select(F.col("doc_id").alias("k"), T.wrapped(F.col("kind"), F.concat(F.lit("T"), F.col("doc_id").cast("string")), F.replace("text", F.lit("\0"), T.separator(F.col("kind")))).alias("text"))


@query("WITH f AS (SELECT conv_id, turn, length(text) % 5 AS nl, coalesce(sum(length(text) % 5) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1 AS a FROM conversations), m AS (SELECT conv_id, turn AS message, 1 + (turn * 3 + length(text)) % 9 AS line FROM conversations) SELECT DISTINCT f.conv_id, message, turn AS piece FROM m JOIN f ON f.conv_id = m.conv_id AND a <= line AND line <= a + nl")
def conflict_pieces(spark: SparkSession, d: str) -> DataFrame:
    """The turns in whose lines messages lie, when a conversation's turns are put one after the other."""
    c = tables.table(spark, d, "conversations")
    fragments = intervals.line_ranges(c.select("conv_id", F.col("turn").alias("piece"), (F.length("text") % 5).alias("nl")), "conv_id", "piece", "nl")
    line = 1 + (F.col("turn") * 3 + F.length("text")) % 9
    return diagnostics.pieces_of_messages(fragments, c.select("conv_id", F.col("turn").alias("message"), line.alias("line_start"), line.alias("line_end")), "conv_id")


@query("SELECT p_partkey, starts_with(split_part(p_name, ' ', 1), 'test_') OR p_size % 7 = 0 AS test, p_size % 3 = 0 AS typedef, p_size % 3 = 1 AS function, p_size % 2 = 0 AS own FROM part")
def piece_predicates(spark: SparkSession, d: str) -> DataFrame:
    size = F.col("p_size")
    names = F.array(F.lit(None).cast("string"), F.element_at(F.split("p_name", " "), 1), F.when(size % 7 == 0, "test_x"))
    kind = F.when(size % 3 == 0, "CTypedefType").when(size % 3 == 1, "MemberFunction").otherwise("Struct")
    text = F.when(size % 2 == 0, " use crate::x;").otherwise("use std::x;")
    return tables.table(spark, d, "part").select("p_partkey", T.is_test(names).alias("test"), T.is_typedef(kind).alias("typedef"), T.is_function(kind).alias("function"), T.own_import(text).alias("own"))


@query("SELECT project, method, sum(f)::BIGINT AS f, sum(o)::BIGINT AS o FROM (SELECT c_mktsegment AS project, o_orderpriority AS method, c_nationkey AS model, count_if(o_orderstatus = 'F') AS f, count_if(o_orderstatus = 'O') AS o FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL) GROUP BY ALL")
def two_level_sums(spark: SparkSession, d: str) -> DataFrame:
    """Counts by three keys, summed over the third."""
    rows = tables.table(spark, d, "orders").join(tables.table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    cells = diagnostics.kind_counts(rows.withColumn("k", F.lower("o_orderstatus")), ["c_mktsegment", "o_orderpriority", "c_nationkey"], ["f", "o"], "k")
    return cells.groupBy(F.col("c_mktsegment").alias("project"), F.col("o_orderpriority").alias("method")).agg(F.sum("f").alias("f"), F.sum("o").alias("o"))
