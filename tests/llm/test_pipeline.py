"""The pipeline against its operators' brute-force versions, on the smallest documents."""

import zlib

import numpy as np
import pytest

DATA = "/root/testdata/sf0.001"


def test_stages_and_run(spark):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    import corpus_pipeline
    from quarry.llm.mixing import mix_table

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = docs
    sizes = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, DATA).cache()
        assert kept.columns == docs.columns, name
        sizes.append(kept.count())
    assert docs.count() > sizes[0] > sizes[1] >= sizes[2] == sizes[3] > 0
    texts = {r["doc_id"]: r["text"] for r in kept.collect()}
    order = [r["doc_id"] for r in mix_table(kept).orderBy("mix_order").collect()]
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    at, want = 0, {}
    for i in order:
        ids = t.encode(texts[i], add_special_tokens=False).ids + [2]
        want[i] = (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in corpus_pipeline.run(spark, DATA).collect()}
    assert got == want
