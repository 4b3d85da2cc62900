"""From documents to token ids: toxicity, near duplicates, decontamination, mixing, token output.

Each stage takes what its predecessor kept, as Parquet. The first three drop rows, the fourth puts rows
in mixed order, the last writes the ids of all texts in that order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.llm.common import shared_dir
from quarry.llm.decontamination import without_items
from quarry.llm.mixing import in_mixed_order, mixed
from quarry.llm.ngram_join import one_of_each
from quarry.llm.token_output import read_digest, write_tokens
from quarry.llm.toxicity import without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the lexicon, learned from labels, finds toxic."""
    return without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of exact and near copies."""
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents in which a benchmark item stands."""
    return without_items(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order that mixes sources to their weights."""
    return in_mixed_order(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The written token table's (doc_id, start, n_tokens, ids_crc32), ids in mixed order.

    A table's rows have no order of their own when read, so the order is worked out again; it is a
    function of the set of documents.
    """
    import public_tokenizers
    from pyspark.sql import functions as F

    path = shared_dir(spark)
    ordered = mixed(docs.select("doc_id", "text", "source")).select("doc_id", "text", F.col("mix.order").alias("order"))
    write_tokens(ordered, path, public_tokenizers.path("byte_bpe_50k.json"), F.col("order"))
    return read_digest(spark, path)


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixing", mixing), ("token_output", token_output)]

#: SQL can express neither the lexicon's matching nor the tokenizer; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage's rows are written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = f"{shared_dir(spark)}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
