"""The lexicon's bound takes the heaviest entries, not those of most contexts."""

import random


def test_bound_by_weight(spark):
    from quarry.llm.toxicity import learn_lexicon

    rng = random.Random(3)
    common = ["".join(rng.choice("abcdefgh") for _ in range(7)) for _ in range(200)]
    data, labels = [], []
    for k in range(400):
        w = [rng.choice(common) for _ in range(60)]
        if k % 4 == 0:  # rare beside the ordinary words, which stand in far more contexts
            w.insert(rng.randrange(1, 59), "zounds" if k % 8 else "wretch")
        data.append((k, " ".join(w)))
        labels.append((k, int(k % 4 == 0)))
    docs, lab = spark.createDataFrame(data, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    found = learn_lexicon(docs, lab, most_entries=4)
    assert len(found.entries) <= 4 and any("zounds".startswith(x) for x in found.entries) and any("wretch".startswith(x) for x in found.entries)
    assert found.entries == learn_lexicon(docs, lab).entries
