"""Decontamination: scores don't depend on how many indexes the items are dealt to."""

import random

from quarry.llm import decontamination as D


def test_slices_share_statistics(spark, monkeypatch):
    rng = random.Random(4)
    words = [f"w{k}" for k in range(400)]
    text = lambda n: " ".join(rng.choice(words[: rng.choice((20, 400))]) for _ in range(n))
    items = [(k, f"{text(rng.randint(5, 120))}\nAnswer: {text(4)}") for k in range(60)] + [(60, ""), (61, None), (None, "a b c")]
    docs = [(k, f"{text(50)} {items[k % 60][1]} {text(30)}") for k in range(90)] + [(90, None), (91, ""), (92, text(200))]
    items, docs = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string")

    def found():
        return {(r["doc_id"], r["item_id"]): round(r["score"], 9) for r in D.contaminated(docs, items).collect()}

    whole = found()
    assert {(k, k % 60) for k in range(90)} <= set(whole) and all(d < 90 for d, _ in whole)
    alone = D.build_index([(r["item_id"], r["text"]) for r in items.orderBy("item_id").collect()])
    assert len(alone.item_ids) == 60
    monkeypatch.setattr(D, "INDEX_ITEMS", 20)
    assert found() == whole
    assert D.without_items(docs, items).count() == 3
    assert D.contaminated(docs, items.limit(0)).count() == 0
