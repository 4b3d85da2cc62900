"""op12: against a plain scoring of all documents, and what the search reads."""

import re
from collections import Counter
from math import floor, log

import numpy as np
import pytest

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def expected(docs, items, top=10):
    bags = [(i, Counter(terms(t))) for i, t in docs]
    sizes = [sum(b.values()) for _, b in bags]
    n_docs, length = sum(n > 0 for n in sizes), sum(sizes)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item_id, text in items:
        scores = []
        for (doc_id, bag), n in zip(bags, sizes):
            s = 0
            for t in terms(text):
                if bag[t]:
                    m = 100 - 75 + (75 * n * n_docs) // length
                    s += floor(1000 * log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * bag[t]) // (1000 * bag[t] + 8 * m))
            if s > 0:
                scores.append((-s, doc_id is not None, doc_id or 0))
        out += [(item_id, k + 1, x[2] if x[1] else None, -x[0]) for k, x in enumerate(sorted(scores)[:top])]
    return out


def same(spark, docs, items, **how):
    from quarry.llm.ranked_search import best_documents

    d = spark.createDataFrame([(*x, 1, "q") for x in docs], "doc_id long, text string, rank int, item string")
    q = spark.createDataFrame([(*x, 0.5) for x in items], "item_id long, text string, score double")
    got = [tuple(r) for r in best_documents(d, q, **how).collect()]
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(got, key=key) == sorted(expected(docs, items), key=key)


def words(rng, n, most=300):
    return " ".join(f"w{x}" for x in np.minimum(rng.zipf(1.3, n), most))


def test_many_documents(spark):
    rng = np.random.default_rng(3)
    docs = [(k, words(rng, rng.integers(1, 120))) for k in range(800)]
    docs += [(5000 + k, docs[7][1]) for k in range(30)]  # ties
    items = [(k, words(rng, 25)) for k in range(25)] + [(99, docs[7][1])]
    same(spark, docs, items)
    same(spark, docs, items, item_bytes=1000)  # several passes


def test_nulls_repeats_long_and_strange_texts(spark):
    docs = [(None, "alpha beta"), (None, "alpha beta"), (3, None), (4, ""), (5, " \t\x00.,;"), (6, "Alpha ALPHA été-Été ßx９"), (6, "alpha gamma"), (7, "alpha " * 200_000), (8, "beta_gamma\x7fdelta")]
    items = [(1, "alpha"), (1, "beta beta gamma"), (None, "delta été"), (2, None), (3, ""), (4, "nowhere")]
    same(spark, docs, items)


@pytest.mark.parametrize("docs, items", [([], [(1, "a")]), ([(1, "a")], []), ([(1, None)], [(1, "a")])])
def test_empty(spark, docs, items):
    same(spark, docs, items)


def test_stops_before_the_lists_end():
    """A document that holds all terms often: the bound falls strictly below the kth score long before the lists end."""
    from quarry.llm.ranked_search import Lists

    rng = np.random.default_rng(1)
    n, t = 6000, 6
    tf = rng.integers(1, 3, (n, t))
    tf[:12] = 60
    lists = Lists(list(range(n)), np.full(n, 200), np.full(n, t), np.tile(np.arange(t), n), tf.ravel().astype(np.int64), t, n, 200 * n)
    weights = np.full(t, 5000)
    docs, scores, read = lists.best(np.arange(t), weights, 10, [])
    assert set(docs.tolist()) == set(range(12)) and len(set(scores.tolist())) == 1  # ties with the kth are all there
    assert read < n * t / 50
    assert not len(lists.best(np.arange(t), weights, 10, [10**12] * 10)[0])  # nothing is read once better ones are known
