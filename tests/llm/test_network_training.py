"""The network's weights learn from every training document, however few there are."""

import numpy as np


def test_each_document_is_learned(spark):
    from quarry.llm import language_model as m

    text = "some words of a text that stands here " * 20
    for key in (1, 2, 3, 4):
        rows = spark.createDataFrame([(key, text)], "key long, text string")
        v = m.learn_vocabulary(m.token_counts(rows.select("text")).cache())
        untrained = m.new_weights(v.shape, np.r_[v.counts_of_head, v.tail_tokens])
        learned = m.learn_network(rows, spark.sparkContext.broadcast(v))
        assert any(not np.array_equal(learned[c], x) for c, x in untrained.items()), key
