"""Nested pieces with ranges for labels: what lies in a piece has numbers within its range, so trees meet by range joins.

pieces: doc_id, path array<string>, and any others. Labels are worked out once; paths are not taken apart again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators.intervals import containment_join
from quarry.operators.rounds import places, stored

#: The kinds that have another interface than their text: how a reader of only the interface sees them.
SIGNED = ("fn", "fn_signature")
TYPED = ("const", "static")


def labelled(pieces: DataFrame) -> DataFrame:
    """pieces with pre and last: a piece's number in the order of paths, and the last number in it. Rows of one path of a document count as pieces of their own, all outside each other; a null path has no row."""
    rows = places(pieces.where("path is not null and size(path) > 0"), ["doc_id"], ["path"], "pre")
    rows = stored(rows)
    up = F.transform(F.sequence(F.lit(1), F.size("path")), lambda k: F.struct(F.slice("path", 1, k).alias("path"), F.when(k == F.size("path"), F.col("pre")).alias("own")))
    held = rows.select("doc_id", F.explode(up).alias("up")).groupBy("doc_id", "up.path").agg(F.count(F.lit(1)).alias("n"), F.count("up.own").alias("own"), F.min("up.own").alias("first"))
    # of equal paths the last one holds what lies below, as it comes right after it; the others end with themselves
    held = held.where("own > 0 and n > own").select(F.col("doc_id").alias("_doc"), (F.col("first") + F.col("own") - 1).alias("_pre"), (F.col("first") + F.col("n") - 1).alias("_last"))
    met = rows.join(held, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("pre") == F.col("_pre")), "left")
    return stored(met.select(*rows.columns, F.coalesce("_last", "pre").alias("last")))


def _below(labels: DataFrame, chosen: DataFrame) -> DataFrame:
    """(doc_id, pre) at or below chosen pieces. Those that hold nothing need no range: they are their own."""
    probes = labels.select(F.col("doc_id").alias("file"), F.col("pre").alias("ps"), F.col("pre").alias("pe"))
    ranges = chosen.where("pre < last").select(F.col("doc_id").alias("file"), F.col("pre").alias("ss"), F.col("last").alias("se")).distinct()
    hit = containment_join(probes, ranges).select(F.col("file").alias("doc_id"), F.col("ps").alias("pre"))
    return hit.union(chosen.where("pre <= last").select("doc_id", "pre")).distinct()


def _above(labels: DataFrame, chosen: DataFrame, *columns: str) -> DataFrame:
    """(doc_id, pre, columns of labels) of the pieces above chosen ones, and of such that hold something at them."""
    probes = chosen.select(F.col("doc_id").alias("file"), F.col("pre").alias("ps"), F.col("pre").alias("pe")).distinct()
    ranges = labels.where("pre < last").select(F.col("doc_id").alias("file"), F.col("pre").alias("ss"), F.col("last").alias("se"), *[F.col(c).alias(f"_{c}") for c in columns])
    return containment_join(probes, ranges).select(F.col("file").alias("doc_id"), F.col("ss").alias("pre"), *[F.col(f"_{c}").alias(c) for c in columns]).distinct()


def below(labels: DataFrame, chosen: DataFrame) -> DataFrame:
    """Labels of the pieces at or below chosen ones; chosen: doc_id, pre, last."""
    return labels.join(_below(labels, chosen), ["doc_id", "pre"], "left_semi")


def above(labels: DataFrame, chosen: DataFrame) -> DataFrame:
    """Labels of the pieces at or above chosen ones; chosen: doc_id, pre."""
    return labels.join(_above(labels, chosen).union(chosen.select("doc_id", "pre")), ["doc_id", "pre"], "left_semi")


def with_paths(labels: DataFrame, paths: DataFrame) -> DataFrame:
    """Labels of the pieces that paths (doc_id, path) name."""
    return labels.join(paths.select("doc_id", "path").distinct(), ["doc_id", "path"], "left_semi")


def _trimmed(labels: DataFrame, wanted: DataFrame, whole_kinds: list[str]) -> DataFrame:
    """(doc_id, pre) of trimmed; wanted: labels with kind."""
    up = stored(_above(labels, wanted, "last", "kind").union(wanted.select("doc_id", "pre", "last", "kind")))
    whole = up.where(F.col("kind").isin(whole_kinds)).select("doc_id", "pre", "last").union(wanted.select("doc_id", "pre", "last"))
    return up.select("doc_id", "pre").union(_below(labels, whole)).distinct()


def trimmed(labels: DataFrame, wanted: DataFrame, whole_kinds: list[str]) -> DataFrame:
    """Wanted pieces with all in them, all above them, and all in a container of whole_kinds in which one lies."""
    own = wanted if "kind" in wanted.columns else labels.join(wanted.select("doc_id", "pre"), ["doc_id", "pre"], "left_semi")
    return labels.join(_trimmed(labels, own, whole_kinds), ["doc_id", "pre"], "left_semi")


def without(labels: DataFrame, gone: DataFrame, container_kinds: list[str]) -> DataFrame:
    """Labels without gone pieces and all in them, and without containers that had something in them and are left with nothing but such containers, at any depth."""
    lost = _below(labels, gone)
    left = stored(labels.join(lost, ["doc_id", "pre"], "left_anti"))
    held = left.where(~F.col("kind").isin(container_kinds) | (F.col("pre") == F.col("last")))  # what keeps a container: other pieces, and containers that were empty before
    kept = _above(left, held).union(held.select("doc_id", "pre"))
    return left.join(kept, ["doc_id", "pre"], "left_semi")


def summary(kind: Column, text: Column, signature: Column, type_name: Column) -> Column:
    """What of a piece is its interface: a function's signature, a value's type, a macro's left sides, else its whole text."""
    sides = F.array_join(F.filter(F.transform(F.split(text, ";"), lambda r: F.trim(F.split(r, "=>")[0])), lambda r: r != ""), "; ")
    return F.when(kind.isin(*SIGNED), F.coalesce(signature, text)).when(kind.isin(*TYPED), F.coalesce(type_name, text)).when(kind == "macro", sides).otherwise(text)


def context(labels: DataFrame, matched: DataFrame, used: DataFrame, split_kinds: list[str], whole_kinds: list[str]) -> tuple[DataFrame, DataFrame]:
    """(what to show, what to sign): the pieces to carry along when some are worked on, and those of which the interface will do.

    Shown: top pieces of kind use, matched pieces, containers of split_kinds cut down to the matched pieces
    in them, and those of whole_kinds whole if a matched piece lies in them. Signed: the pieces that are
    used, with what is above them, cut the same way. matched, used: doc_id, path.
    """
    top = F.size("path") == 1
    named = [p.select("doc_id", "path", F.lit(n).alias("of")) for n, p in enumerate((matched, used))]
    marks = named[0].union(named[1]).groupBy("doc_id", "path").agg(F.collect_set("of").alias("of"))  # both at once
    marked = stored(labels.join(marks, ["doc_id", "path"]).select("doc_id", "pre", "last", "kind", top.alias("top"), "of"))
    mine, theirs = (marked.where(F.array_contains("of", n)).drop("of") for n in (0, 1))
    cut = _trimmed(labels, mine, whole_kinds)
    roots = labels.where(top & F.col("kind").isin(*split_kinds, *whole_kinds)).select("doc_id", "pre", "last").union(mine.where("top").select("doc_id", "pre", "last"))
    kept = containment_join(cut.select(F.col("doc_id").alias("file"), F.col("pre").alias("ps"), F.col("pre").alias("pe")), roots.select(F.col("doc_id").alias("file"), F.col("pre").alias("ss"), F.col("last").alias("se")).distinct()).select(F.col("file").alias("doc_id"), F.col("ps").alias("pre"))
    shown = kept.union(_below(labels, labels.where(top & (F.col("kind") == "use")))).distinct()
    return labels.join(shown, ["doc_id", "pre"], "left_semi"), labels.join(_trimmed(labels, theirs, whole_kinds), ["doc_id", "pre"], "left_semi")
