"""Record linkage: ranked rules on names between compatible kinds, and best matches by suffix or similarity."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from quarry.functions import text as T

Rule = Callable[[Column], Column]

#: Rules in order: a name's key on both sides; the first rule that finds a partner wins.
RULES: dict[str, Rule] = {"exact": lambda n: n, "tokens": T.token_key, "lower": F.lower}
#: Kinds of the left side that a rule is for; a rule that isn't named here is for all.
RULE_KINDS: dict[str, tuple[str, ...]] = {"lower": ("macro",)}


def link(left: DataFrame, right: DataFrame, kinds: DataFrame, rules: dict[str, Rule] | None = None, rule_kinds: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """(left_id, right_id, rule): each left piece's partner of a compatible kind by the first rule that has one, the lowest right id of several.

    left, right: id, kind, name; kinds: left_kind, right_kind. Each rule is an equi-join on its key with
    one row for each key of the right side, so common names make no pairs. Null and empty names match
    nothing.
    """
    pick = lambda df, side: df.where("name is not null and name <> ''").select(F.col("id").alias(f"{side}_id"), F.col("kind").alias(f"{side}_kind"), F.col("name").alias(f"{side}_name"))
    a, b = pick(left, "left").join(kinds.distinct(), "left_kind"), pick(right, "right")
    only = RULE_KINDS if rule_kinds is None else rule_kinds
    found: DataFrame | None = None
    for rank, (name, rule) in enumerate((rules or RULES).items()):
        own = a.where(F.col("left_kind").isin(list(only[name]))) if name in only else a
        first = b.groupBy("right_kind", rule(F.col("right_name")).alias("_key")).agg(F.min("right_id").alias("right_id"))
        met = own.withColumn("_key", rule(F.col("left_name"))).join(first, ["right_kind", "_key"])
        met = met.select("left_id", "right_id", F.lit(rank).alias("rank"), F.lit(name).alias("rule"))
        found = met if found is None else found.union(met)
    best = found.groupBy("left_id").agg(F.min(F.struct("rank", "right_id", "rule")).alias("best"))
    return best.select("left_id", "best.right_id", "best.rule")


def unmatched(left: DataFrame, links: DataFrame) -> DataFrame:
    return left.join(links.select(F.col("left_id").alias("id")), "id", "left_anti")


def members_equal(left: DataFrame, right: DataFrame) -> DataFrame:
    """(left_id, right_id): pieces whose sets of lower-case member names are equal; left, right: id, members."""
    key = lambda df, name: df.select(F.col("id").alias(name), F.array_join(F.array_sort(F.array_distinct(F.transform("members", F.lower))), "\0").alias("_key")).where("_key <> ''")
    first = key(right, "right_id").groupBy("_key").agg(F.min("right_id").alias("right_id"))  # one for each set, so that no pairs multiply
    return key(left, "left_id").join(first, "_key").groupBy("left_id").agg(F.min("right_id").alias("right_id"))


def best_by_suffix(includes: DataFrame, files: DataFrame) -> DataFrame:
    """(inc, path, score): of the files whose path ends in inc, the one of the longest common suffix, the first by name of several.

    Joined on the last path segment, so no file meets an include of another name.
    """
    a = includes.select("inc").distinct().withColumn("_base", T.basename(T.norm_path(F.col("inc"))))
    b = files.select("path").distinct().withColumn("_base", T.basename(F.col("path")))
    met = a.join(b, "_base").where(F.col("path").endswith(T.norm_path(F.col("inc"))))
    met = met.withColumn("score", T.common_suffix_length(F.col("inc"), F.col("path")))
    best = met.groupBy("inc").agg(F.min(F.struct((-F.col("score")).alias("s"), "path", "score")).alias("best"))
    return best.select("inc", "best.path", "best.score")


def indel_ratio(a: str, b: str) -> int:
    """100 times twice the longest common subsequence over both lengths, rounded."""
    if not a and not b:
        return 100
    rows = {c: sum(1 << k for k, x in enumerate(a) if x == c) for c in set(a)}
    state = (1 << len(a)) - 1
    for c in b:
        hit = state & rows.get(c, 0)
        state = (state + hit) | (state - hit)
    common = len(a) - bin(state & ((1 << len(a)) - 1)).count("1")
    return round(200 * common / (len(a) + len(b)))


@F.pandas_udf(IntegerType())
def fuzzy_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([indel_ratio(x, y) if x and y else None for x, y in zip(a, b)], dtype="Int32")


def _signs(name: Column) -> Column:
    """A name's characters, each with how often it stood before: a set whose overlap bounds the common subsequence."""
    chars = F.split(name, "")
    return F.transform(chars, lambda c, k: F.concat(c, F.size(F.filter(F.slice(chars, F.lit(1), k), lambda x: x == c)).cast("string")))


def best_similar(left: DataFrame, right: DataFrame, kinds: DataFrame, threshold: int = 90) -> DataFrame:
    """(left_id, right_id, similarity): the most similar name of a compatible kind at the threshold, the lowest right id of several.

    left, right: id, kind, name; kinds: left_kind, right_kind. Similar names share enough characters, so
    they share one of the few that each puts into its prefix, the rarest first: pairs come from an
    equi-join on those, pass the bounds on length, and are compared once. None is lost.
    """
    pick = lambda df, side: df.where("name is not null and name <> ''").select(F.col("id").alias(f"{side}_id"), F.col("kind").alias(f"{side}_kind"), F.col("name").alias(f"{side}_name"))
    a, b = pick(left, "left").join(kinds.distinct(), "left_kind"), pick(right, "right")
    b = b.groupBy("right_kind", "right_name").agg(F.min("right_id").alias("right_id"))  # the lowest id of equal names is the answer for all of them
    names = a.select(F.col("left_name").alias("name")).union(b.select(F.col("right_name").alias("name"))).distinct()
    signs = names.select("name", F.posexplode(_signs(F.col("name"))).alias("_", "sign")).drop("_")
    often = signs.groupBy("sign").agg(F.count(F.lit(1)).alias("often"))
    size = F.length("name")
    # a partner has threshold / (200 - threshold) of the length at least, and shares the threshold's part of both
    need = F.ceil(F.lit(threshold) * (size + size * threshold / (200 - threshold)) / 200 - 1e-9)
    own = F.array_sort(F.collect_list(F.struct("often", "sign")))
    prefix = signs.join(often, "sign").groupBy("name").agg(own.alias("own")).select("name", F.explode(F.slice(F.col("own"), F.lit(1), (size - need + 1).cast("int"))).alias("s")).select("name", "s.sign")
    x, y = prefix.select(F.col("name").alias("left_name"), "sign"), prefix.select(F.col("name").alias("right_name"), "sign")
    near = (F.length("left_name") * (200 - threshold) >= F.length("right_name") * threshold) & (F.length("right_name") * (200 - threshold) >= F.length("left_name") * threshold)
    pairs = a.join(x, "left_name").join(b.join(y, "right_name"), ["right_kind", "sign"]).where(near).select("left_name", "right_name").distinct()
    close = pairs.withColumn("similarity", fuzzy_ratio("left_name", "right_name")).where(F.col("similarity") >= threshold)
    met = a.join(close, "left_name").join(b, ["right_kind", "right_name"])
    best = met.groupBy("left_id").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "right_id", "similarity")).alias("best"))
    return best.select("left_id", "best.right_id", "best.similarity")
