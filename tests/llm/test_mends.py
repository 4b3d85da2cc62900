"""Bounds, orders and columns at sizes that small tables don't reach."""

import numpy as np
import pytest


def counts(spark, rows):
    return spark.createDataFrame([(k, k & 63, c) for k, c in rows], "key long, tail int, c long")


def end():
    from quarry.llm.language_model import END

    key = END & ~63 | 63
    return key


@pytest.mark.parametrize("frequent", [2**20, 2**33])
def test_the_vocabulary_holds_as_many_words_as_its_bound(spark, frequent):
    from quarry.llm.language_model import learn_vocabulary

    rows = [(k << 40 | 1, frequent + k) for k in range(-4, 5) if k] + [(end(), 7)] + [(k << 30 | 2, 3) for k in range(50)]
    for most in (3, 8, 20, 1000):
        found = learn_vocabulary(counts(spark, rows), most)
        want = sorted((x for x in rows if x[0] != end()), key=lambda x: (-x[1] // frequent, x[0]))[:most]
        keys = set(found.keys.tolist())
        assert end() in keys and len(keys) >= min(most, len(rows))
        if most <= 8:
            assert {c > 1000 for k, c in rows if k in keys and k != end()} == {True}
        assert found.places(np.array([end()]))[0] >= 0 and found.head[found.places(np.array([end()]))[0]] >= 0
        assert found.tail_tokens.min() >= 0 and want
    assert not len(learn_vocabulary(counts(spark, []), 3).keys)


def test_levels_never_wrap():
    from quarry.llm.ngram_join import levels_of

    n = np.array([0, 1, 2, 1000, 2**31, 2**32, 2**33, 2**62])
    assert (np.diff(levels_of(n).astype(int)) > 0).all()


def test_repeated_rows_list_a_position_once(spark):
    from quarry.llm.common import text_key
    from quarry.llm.substring_dedup import WINDOW, _anchors, _shared, dedup_substrings

    text = " ".join(f"w{k}" for k in range(60))
    docs = spark.createDataFrame([(7, text)] * 3000 + [(None, text)] * 10 + [(8, "other words")], "doc_id long, text string")
    lists = _shared(docs.withColumn("key", text_key()).select("key", "text"), _anchors(WINDOW)).collect()
    assert len(lists) == 2 and all(len(r["at"]) == len(set(r["at"])) < 20 for r in lists)
    got = dedup_substrings(docs).groupBy("doc_id", "n_words", "n_removed").count().collect()
    assert {tuple(r) for r in got} == {(7, 60, 60, 3000), (None, 60, 60, 10), (8, 2, 0, 1)}


def test_stages_keep_all_columns_whatever_their_names(spark):
    from quarry.llm.ngram_join import one_of_each
    from quarry.llm.toxicity import without_toxic

    names = ["doc_id", "text", "key", "__key", "row", "found", "__toxicity", "a.b", "node"]
    rows = [(k, f"{'same words of one text here ' * 4}{k // 2}", f"k{k}", "x", 1, 2.0, "t", "dot", 5) for k in range(6)]
    docs = spark.createDataFrame(rows, names)
    labels = spark.createDataFrame([(0, 1), (1, 0)], "doc_id long, toxic int")
    for out in (one_of_each(docs), without_toxic(docs, labels)):
        assert out.columns == names
        assert {tuple(r) for r in out.collect()} <= set(rows)
    assert without_toxic(docs, labels).count() == 6
    assert one_of_each(docs.limit(0)).columns == names and one_of_each(docs.limit(0)).count() == 0


def test_neighbours_in_clusters_far_apart(spark):
    from quarry.llm.neighbours import nearest

    rng = np.random.default_rng(4)
    centers = rng.normal(size=(300, 24)) * 40
    x = np.repeat(centers, 20, axis=0) + rng.normal(size=(6000, 24))
    table = spark.createDataFrame([(k, v) for k, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    found = {}
    for r in nearest(table).collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    right = 0
    for q in range(0, 6000, 100):
        d = ((x - x[q]) ** 2).sum(1)
        d[q] = np.inf
        right += len(found[q] & set(np.argsort(d)[:10].tolist()))
    assert right >= 0.95 * 10 * 60
