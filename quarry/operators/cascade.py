"""Matching of declarations to their counterparts by rules for each kind, the first rule that finds one deciding.

Every rule of every kind is a row: which counterparts it looks at, by what key, and its rank. All rows of
all declarations meet all counterparts in one equi-join, in which each key of the right side has a single
row, its first counterpart. So there is one shuffle for any number of rules, and common names make no pairs.
A piece becomes a dozen rows by rules that Spark's estimate of a table's size doesn't see, so joins here
are sorted ones: neither side is gathered in the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import text as T

# The kinds of counterparts of each kind of declaration.
COUNTERPARTS = {
    "typedef": ["type"],
    "using": ["type"],
    "macro": ["macro", "const"],
    "macro_fun": ["macro", "fn"],
    "function": ["fn"],
    "enum": ["enum"],
    "struct": ["struct"],
    "class": ["struct"],
}
VALUES = ["const", "static"]

LEFT = "id long, kind string, name string, names array<string>, functions array<boolean>, body_kind string, body_name string, members array<string>"
RIGHT = "id long, kind string, name string, parent long, members array<string>"


def members_key(members: Column) -> Column:
    """A key of the set of lower-case names; null without any."""
    names = F.array_sort(F.array_distinct(F.transform(F.filter(members, lambda m: m.isNotNull()), F.lower)))
    return F.when(F.size(names) > 0, F.array_join(names, "\0"))


def _counterparts(kind: Column) -> Column:
    found = F.lit(None).cast("array<string>")
    for k, kinds in COUNTERPARTS.items():
        found = F.when(kind == k, F.array(*map(F.lit, kinds))).otherwise(found)
    return found


def _rule(part: Column | int, group: int, rank: int, rule: str, scope: str, kinds: Column | list[str], how: str, name: Column, when: Column) -> Column:
    targets = kinds if isinstance(kinds, Column) else F.array(*map(F.lit, kinds))
    part = part if isinstance(part, Column) else F.lit(part)
    return F.when(when & name.isNotNull() & (name != ""), F.struct(part.cast("int").alias("part"), F.lit(group).alias("group"), F.lit(rank).alias("rank"), F.lit(rule).alias("rule"), F.lit(scope).alias("scope"), targets.alias("targets"), F.lit(how).alias("how"), name.alias("name")))


def _named(part: Column | int, group: int, rank: int, rule: str, kinds: Column | list[str], name: Column, when: Column) -> list[Column]:
    """By the name itself, else by its parts."""
    return [_rule(part, group, rank, rule, "top", kinds, "exact", name, when), _rule(part, group, rank + 1, f"{rule} parts", "top", kinds, "tokens", name, when)]


def _rules(kind: Column, name: Column, members: Column, rank: int, when: Column, prefix: str = "") -> list[Column]:
    """The rules of a piece with one name: its counterparts, then what its kind falls back on."""
    rules = _named(0, 0, rank, f"{prefix}name", _counterparts(kind), name, when)
    enum = when & (kind == "enum")
    rules.append(_rule(0, 0, rank + 2, f"{prefix}lower", "top", _counterparts(kind), "lower", name, when & (kind == "macro")))
    rules += [_rule(0, 0, rank + 2, f"{prefix}method", "method", ["fn"], how, name, when & (kind == "function")) for how in ("exact", "tokens")]
    rules.append(_rule(0, 0, rank + 3, f"{prefix}members", "top", ["enum"], "members", members_key(members), enum))
    return rules


def probes(left: DataFrame) -> DataFrame:
    """(left_id, part, group, rank, rule, scope, kind, how, key): what each piece is looked up by; left: as LEFT."""
    kind, name, names = F.col("kind"), F.col("name"), F.coalesce("names", F.array().cast("array<string>"))
    yes = F.lit(True)
    typed = kind.isin("typedef", "using")
    single = ~kind.isin("typedef", "using", "declaration", "multi_typedef", "multi_declaration")
    rules = _rules(kind, name, F.col("members"), 0, single)
    # a type name: what it names first, then the name among that kind's counterparts, then types
    rules += _rules(F.col("body_kind"), F.col("body_name"), F.col("members"), 0, typed & F.col("body_kind").isNotNull(), "body ")
    rules += _named(0, 0, 4, "body kind", _counterparts(F.col("body_kind")), name, typed & F.col("body_kind").isNotNull())
    rules += _named(0, 0, 6, "type", ["type"], name, typed)

    def value(part: Column | int, n: Column, function: Column, when: Column) -> list[Column]:
        function = F.coalesce(function, F.lit(False))
        return [*_named(part, 0, 0, "signature", ["fn_signature"], n, when & function), *_named(part, 0, 0, "value", VALUES, n, when & ~function), _rule(part, 0, 2, "field", "field", ["field"], "exact", n, when & ~function)]

    rules += value(0, name, F.get("functions", F.lit(0)), kind == "declaration")
    at = lambda make: F.flatten(F.transform(names, lambda n, i: F.array(*make(n, i))))
    several = F.concat(
        F.when(kind == "multi_declaration", at(lambda n, i: value(i, n, F.get("functions", i), yes))).otherwise(F.array()),
        F.when(kind == "multi_typedef", at(lambda n, i: _named(i, 0, 0, "type", F.coalesce(_counterparts(F.col("body_kind")), F.when(F.col("body_kind").isNull(), F.array(F.lit("type"))), F.array().cast("array<string>")), n, yes))).otherwise(F.array()),
        # an enum's names as values, each by itself, only if nothing stands for the enum
        F.when(kind == "enum", F.flatten(F.transform(F.coalesce("members", F.array().cast("array<string>")), lambda n, i: F.array(*_named(i, 1, 0, "enumerator", VALUES, n, yes))))).otherwise(F.array()),
    )
    rows = left.repartition("id").select(F.col("id").alias("left_id"), F.explode(F.concat(F.array(*rules), several)).alias("p")).where("p is not null").select("left_id", "p.*")
    key = F.when(F.col("how") == "tokens", T.token_key(F.col("name"))).when(F.col("how") == "lower", F.lower("name")).otherwise(F.col("name"))
    return rows.select("left_id", "part", "group", "rank", "rule", "scope", F.explode("targets").alias("kind"), "how", key.alias("key"))


def counterparts(right: DataFrame) -> DataFrame:
    """(scope, kind, how, key, right_id): for each key its first counterpart; right: as RIGHT, ids in the order of the text."""
    top = right.where("parent is null").select("id", "kind", "name", "members")
    named = lambda df, scope: df.where("name is not null and name <> ''").select("id", F.lit(scope).alias("scope"), "kind", F.explode(F.array(F.struct(F.lit("exact").alias("how"), F.col("name").alias("key")), F.struct(F.lit("tokens").alias("how"), T.token_key(F.col("as")).alias("key")), F.struct(F.lit("lower").alias("how"), F.lower("name").alias("key")))).alias("k"))
    inner = right.where("parent is not null").select("id", "kind", "name", "parent").join(top.select(F.col("id").alias("parent"), F.col("kind").alias("of"), F.col("name").alias("type_name")).hint("merge"), "parent")
    fields = inner.where("of = 'struct'").withColumn("kind", F.lit("field")).withColumn("as", F.col("name"))
    methods = inner.where("of = 'impl' and kind = 'fn'").withColumn("as", F.concat_ws("_", "type_name", "name"))
    sets = top.where("kind = 'enum'").select("id", F.lit("top").alias("scope"), "kind", F.struct(F.lit("members").alias("how"), members_key(F.col("members")).alias("key")).alias("k")).where("k.key is not null")
    rows = named(top.withColumn("as", F.col("name")), "top").union(named(fields, "field")).union(named(methods, "method")).union(sets)
    return rows.select("scope", "kind", "k.how", "k.key", "id").groupBy("scope", "kind", "how", "key").agg(F.min("id").alias("right_id"))


def match(left: DataFrame, right: DataFrame) -> DataFrame:
    """(left_id, part, right_id, rule): for each declaration, and each of its names if it has several, its counterpart by the first rule that finds one.

    Null and empty names match nothing; a piece without a match has no row. An enum's own names are only
    looked up if the enum itself has no counterpart; a field stands for a variable, and a method for a
    function by its own name or by that of its type and it, only if nothing at the top does. Of several
    counterparts the first is taken. Rows that repeat an id are one piece's rules together.
    """
    met = probes(left).join(counterparts(right).hint("merge"), ["scope", "kind", "how", "key"])
    best = met.groupBy("left_id", "part", "group").agg(F.min(F.struct("rank", "right_id", "rule")).alias("best"))
    first = F.min("group").over(Window.partitionBy("left_id"))
    return best.withColumn("first", first).where("group = first").select("left_id", "part", "best.right_id", "best.rule")
