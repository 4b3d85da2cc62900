"""Build messages: flattening, location in units, classification, pivoted counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators.intervals import containment_join

ABORTING = r"^error: aborting due to \d+ previous errors?"


def errors_only(messages: DataFrame) -> DataFrame:
    """Messages of level error, without the summary line; message: struct of level, rendered, spans, children."""
    return messages.where((F.col("message.level") == "error") & ~F.coalesce(F.col("message.rendered"), F.lit("")).rlike(ABORTING))


def all_spans(message: str = "message"):
    """A message's own spans and its children's, as one array."""
    own = F.coalesce(F.col(f"{message}.spans"), F.array())
    return F.concat(own, F.flatten(F.transform(F.coalesce(F.col(f"{message}.children"), F.array()), lambda c: F.coalesce(c["spans"], F.array()))))


def unfolded(span: Column, depth: int) -> Column:
    """A span's chain of macro expansions: the definition sites that have a place, from the outside in, and the innermost call site.

    span: a struct with `expansion` (span, def_site_span), nested `depth` times.
    """
    sites, at = [], span
    plain = lambda s: F.struct(*[s[c].alias(c) for c in ("file_name", "line_start", "line_end", "byte_start")])
    inner = plain(at)
    for _ in range(depth):
        step = at["expansion"]
        sites.append(F.when(step["def_site_span"]["byte_start"] != 0, plain(step["def_site_span"])))
        inner = F.when(step.isNotNull(), plain(step["span"])).otherwise(inner)
        at = step["span"]
    return F.concat(F.filter(F.array(*sites), lambda s: s.isNotNull()), F.array(inner))


def cut_off(span: Column, depth: int) -> Column:
    """Whether a span's chain goes on beyond `depth` expansions, so that unfolded() leaves some out."""
    for _ in range(depth):
        span = span["expansion"]["span"]
    return span["expansion"].isNotNull()


def pieces_of_messages(fragments: DataFrame, messages: DataFrame, doc: str) -> DataFrame:
    """(doc, message, piece): pieces whose lines hold a message's place; fragments: doc, piece, start_line, end_line as intervals.line_ranges makes them; messages: doc, message, line_start, line_end."""
    probes = messages.select(F.col(doc).alias("file"), "message", F.col("line_start").alias("ps"), F.col("line_end").alias("pe"))
    ranges = fragments.select(F.col(doc).alias("file"), "piece", F.col("start_line").alias("ss"), F.col("end_line").alias("se"))
    return containment_join(probes, ranges).select(F.col("file").alias(doc), "message", "piece").distinct()


def per_build(messages: DataFrame, build: str, msg: str, spans: str, units: DataFrame, file: str = "src/lib.rs") -> DataFrame:
    """(build, messages, places, units): each build's messages, distinct places (file and lines) of them, and distinct units in which one lies."""
    places = messages.select(build, F.explode(spans).alias("s")).groupBy(build).agg(F.countDistinct("s.file_name", "s.line_start", "s.line_end").alias("places"))
    hit = located(messages, units, build, msg, spans, file).groupBy(build).agg(F.countDistinct("unit").alias("units"))
    count = messages.groupBy(build).agg(F.count(F.lit(1)).alias("messages"))
    return count.join(places, build, "left").join(hit, build, "left").select(build, "messages", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("places", "units")])


def not_before(spans: Column, line: Column) -> Column:
    """Whether some span ends at the line or later; no spans, no."""
    return F.exists(F.coalesce(spans, F.array().cast("array<struct<line_end:int>>")), lambda s: s["line_end"] >= line)


def gated_features(children: Column) -> Column:
    """(crate, feature) of neighbouring notes: an item that was configured out, and the gate that the next note names. The last note has no next one."""
    pairs = F.arrays_zip(children.alias("a"), F.slice(children, F.lit(2), F.greatest(F.size(children) - 1, F.lit(0))).alias("b"))
    out = F.filter(pairs, lambda p: (p["a"]["message"] == "found an item that was configured out") & p["b"].isNotNull())
    found = F.transform(out, lambda p: F.struct(T.registry_crate(p["a"]["path"]).alias("crate"), T.feature_gate(p["b"]["message"]).alias("feature")))
    return F.array_distinct(F.filter(found, lambda f: f["crate"].isNotNull() & f["feature"].isNotNull()))


def located(messages: DataFrame, units: DataFrame, build: str, msg: str, spans: str = "spans", file: str = "src/lib.rs") -> DataFrame:
    """(build, msg, unit): distinct units of the build that contain a span of the message in the file."""
    s = messages.select(build, msg, F.explode(spans).alias("s")).where(F.col("s.file_name") == file)
    s = s.select(build, msg, F.col(build).alias("file"), F.col("s.line_start").alias("ps"), F.col("s.line_end").alias("pe"))
    u = units.select(F.col("build_id").alias("file"), F.col("lo").alias("ss"), F.col("hi").alias("se"))
    return containment_join(s, u).select(build, msg, F.struct(F.col("ss").alias("lo"), F.col("se").alias("hi")).alias("unit")).distinct()


def several_units(messages: DataFrame, units: DataFrame, build: str, msg: str, spans: str = "spans", file: str = "src/lib.rs") -> DataFrame:
    """(build, msg, several): messages of which a span lies in a unit of the build, and whether they lie in more than one.

    Each distinct place is looked up once, and brings the ends of its units' bounds: all units are one if
    these agree. So a message costs a row for each of its spans, however many units contain them.
    """
    s = messages.select(build, msg, F.explode(spans).alias("s")).where(F.col("s.file_name") == file)
    s = s.select(F.col(build).alias("file"), msg, F.col("s.line_start").alias("ps"), F.col("s.line_end").alias("pe"))
    u = units.select(F.col("build_id").alias("file"), F.col("lo").alias("ss"), F.col("hi").alias("se"))
    bounds = [F.min("a").alias("a"), F.max("b").alias("b"), F.min("c").alias("c"), F.max("d").alias("d")]
    met = containment_join(s.select("file", "ps", "pe").distinct(), u)
    places = met.select("file", "ps", "pe", F.col("ss").alias("a"), F.col("ss").alias("b"), F.col("se").alias("c"), F.col("se").alias("d")).groupBy("file", "ps", "pe").agg(*bounds)
    found = s.join(places, ["file", "ps", "pe"]).groupBy("file", msg).agg(*bounds)
    return found.select(F.col("file").alias(build), msg, ((F.col("a") != F.col("b")) | (F.col("c") != F.col("d"))).alias("several"))


def classified(messages: DataFrame, units: DataFrame, build: str, msg: str, text: str, file: str = "src/lib.rs") -> DataFrame:
    """messages with a kind: external_crate, inter_unit or intra_unit."""
    n = several_units(messages, units, build, msg, file=file).select(build, msg, F.when(F.col("several"), 2).otherwise(1).alias("_units"))  # the rules ask for more than one
    outside = F.exists("spans", lambda s: s["file_name"] != file)
    return messages.join(n, [build, msg], "left").withColumn("kind", T.error_kind(F.col(text), F.coalesce("_units", F.lit(0)), outside)).drop("_units")


def kind_counts(messages: DataFrame, keys: list[str], kinds: list[str], column: str = "kind") -> DataFrame:
    """Counts of the listed kinds as columns; the list spares a pass over the data."""
    return messages.groupBy(*keys).agg(*[F.count_if(F.col(column) == k).alias(k) for k in kinds])
