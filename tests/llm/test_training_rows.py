"""The bounded rows that classifiers learn from."""

import zlib

import pytest
from pyspark.sql import functions as F

from quarry.llm.toxicity import training_rows


@pytest.mark.parametrize("most", [1, 20, 5000])
def test_lowest_hashes_of_distinct_ids(spark, most):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"))
    repeated = spark.range(2000).select(F.lit(7).cast("long").alias("doc_id"), F.concat(F.lit("other "), F.col("id").cast("string")).alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 2).alias("toxic")).union(spark.range(500).select(F.lit(9).cast("long"), F.lit(0).cast("long")))
    labels = labels.union(spark.createDataFrame([(None, 1), (3, None)], "doc_id long, toxic long"))
    got = training_rows(docs.union(repeated), labels, "toxic", most).collect()
    hashes = {r["doc_id"]: r["h"] for r in docs.select("doc_id", F.xxhash64("doc_id").alias("h")).collect()}
    free = sorted((d for d in hashes if zlib.crc32(str(d).encode()) % 3 != 1), key=hashes.get)[:most]
    texts = {r["text"]: r["label"] for r in got}
    assert len(got) == len(texts) == len(free)
    assert {t: n for t, n in texts.items() if t[0] == "t" and t != "t7"} == {f"t{d}": d % 2 for d in free if d != 7}


def test_none(spark):
    docs, labels = spark.createDataFrame([(1, "a")], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, toxic int")
    assert training_rows(docs, labels, "toxic", 10).count() == training_rows(docs.limit(0), labels, "toxic", 10).count() == 0
