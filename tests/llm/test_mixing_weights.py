"""Mixing against the unrounded weights, over many periods of the former plan."""

from collections import Counter
from fractions import Fraction
from math import ceil, floor


def test_exact_weights_over_many_slots():
    from quarry.llm.mixing import earliest_deadline_first, whole

    weights = {"big": 10.0} | {f"s{k}": (20 / 19 + k / 97) ** 0.7 for k in range(19)} | {"rare": 0.001}
    exact = {s: Fraction(w) / sum(map(Fraction, weights.values())) for s, w in weights.items()}
    had, n = Counter(), 60_000
    for t, (s, k, slot, release, deadline) in zip(range(n), earliest_deadline_first(whole(weights), dict.fromkeys(weights, n))):
        assert slot == t and k == had[s] and (release, deadline) == (floor(k / exact[s]), ceil((k + 1) / exact[s]))
        had[s] += 1
        assert abs(had[s] - exact[s] * (t + 1)) < 1
        if t % 997 == 0:
            assert all(abs(had[x] - w * (t + 1)) < 1 for x, w in exact.items())
    assert 0 < had["rare"] < n / 4096


def test_table_of_exact_weights(spark):
    from pyspark.sql import functions as F

    from quarry.llm.mixing import mix_table

    weights = {"a": 5.0, "b": 1.7, "c": 0.3, "d": 0.0007}
    source = F.when(F.col("id") < 9000, "a").when(F.col("id") < 12000, "b").when(F.col("id") < 12600, "c").when(F.col("id") < 12605, "d").otherwise("none")
    docs = spark.range(12650).select(F.col("id").alias("doc_id"), F.lit("").alias("text"), source.alias("source"))  # a block for each document
    got = mix_table(docs, weights, block_bytes=1).orderBy("mix_order").collect()
    exact = {s: Fraction(w) / sum(map(Fraction, weights.values())) for s, w in weights.items()}
    had = Counter()
    assert len(got) == 12650 == len({r["slot"] for r in got}) and [r["slot"] for r in got] == sorted(r["slot"] for r in got)
    for r in got[:-45]:
        s, k = r["source"], r["block"]
        assert (r["release"], r["deadline"]) == (floor(k / exact[s]), ceil((k + 1) / exact[s])) and r["release"] <= r["slot"] < r["deadline"]
        if r["on_target"]:
            had[s] += 1
            assert all(abs(had[x] - w * (r["slot"] + 1)) < 1 for x, w in exact.items())
    assert sum(had.values()) > 2 * 4096 and all(r["source"] == "\x00other" and r["release"] is None and not r["on_target"] for r in got[-45:])


def test_more_sources_than_a_thousand(spark):
    from pyspark.sql import functions as F

    from quarry.llm.mixing import mix_table

    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("x y").alias("text"), (F.col("id") % 1500).cast("string").alias("source"))
    got = mix_table(docs, block_bytes=4).collect()
    assert len(got) == 3000 and len({r["source"] for r in got}) == 1500 and all(r["deadline"] - r["release"] == 1500 for r in got)
