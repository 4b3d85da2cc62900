"""op11: the tree, its proofs and the tampered rows against plain Python."""

import hashlib
import zlib
from collections import defaultdict

import pytest

SCHEMA = "doc_id long, text string, source string, lang string, n_chars long"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(doc_id, source, lang, n_chars, text):
    return h(*["-" if x is None else f"{len(str(x).encode())}:{x}" for x in (doc_id, source, lang, n_chars, text)])


def levels_above(nodes):
    rows = [nodes]
    while len(rows[-1]) > 1:
        rows.append([h(*rows[-1][k : k + 16]) for k in range(0, len(rows[-1]), 16)])
    return rows


def path(rows, at):
    out = []
    for row in rows[:-1]:
        run = at // 16 * 16
        out.append((row[run:at], row[at + 1 : run + 16]))
        at //= 16
    return out


def expected(rows):
    groups = defaultdict(list)
    for doc_id, text, source, lang, n_chars in rows:
        groups[source].append(((doc_id is not None, doc_id or 0), leaf_of(doc_id, source, lang, n_chars, text), doc_id, text, lang, n_chars))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: levels_above([x[1] for x in sorted(groups[s], key=lambda x: x[:2])]) for s in order}
    top = levels_above([trees[s][-1][0] for s in order])
    root, out = top[-1][0], []
    for place, s in enumerate(order):
        for k, (_, leaf, doc_id, text, lang, n_chars) in enumerate(sorted(groups[s], key=lambda x: x[:2])):
            steps = path(trees[s], k) + path(top, place)
            other = leaf
            if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0:
                low = text if text is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
                other = leaf_of(doc_id, s, lang, n_chars, low)
            folded = other
            for a, b in steps:
                folded = h(*a, folded, *b)
            out.append((doc_id, leaf, trees[s][-1][0], root, h(*[x for a, b in steps for x in (*a, *b)]), folded, folded == root))
    return out


def same(spark, rows):
    from quarry.llm.merkle import proofs

    got = [tuple(r) for r in proofs(spark.createDataFrame(rows, SCHEMA)).collect()]
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(got, key=key) == sorted(expected(rows), key=key)


def test_more_than_a_block_and_many_sources(spark):
    rows = [(k * 7 - 9000, f"Text {k} ÄÖ" if k % 3 else "", "hot", "de", k) for k in range(4500)]
    rows += [(k * 100_003, f"Other {k}", f"s{k % 40}", None, None) for k in range(400)]
    same(spark, rows)


def test_nulls_repeats_and_ties(spark):
    rows = [(None, "a", "x", "en", 1), (None, None, "x", None, None), (None, "a", "x", "en", 1), (5, "Five", "x", "en", 4), (5, "Five", "x", "en", 4), (5, "FIVE", "x", "en", 4), (7, None, None, None, None), (7, "Z" * 300_000, "", "en", 2), (-3, "A", "x", "en", 1), (2**62, "B", "x", "en", 1), (-(2**63), "C", "x", "en", 1)]
    same(spark, rows + [(5, "Five", "x", "en", 4)] * 40)


@pytest.mark.parametrize("rows", [[(15, "Only", "s", "en", 4)], [(None, None, None, None, None)], [(1, "A", "s", "en", 1), (1, "A", "t", "en", 1)]])
def test_small(spark, rows):
    same(spark, rows)


def test_empty_and_other_columns(spark):
    from quarry.llm.merkle import manifest, proofs

    assert proofs(spark.createDataFrame([], SCHEMA)).count() == 0
    assert manifest(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(k, f"T{k}", f"s{k % 3}", "en", k) for k in range(60)]
    extra = spark.createDataFrame([(*r, 9, "w", "p") for r in rows], SCHEMA + ", place long, word string, leaf string")
    want = expected(rows)
    assert sorted(tuple(r) for r in proofs(extra).collect()) == sorted(want)
    kept = {r["source"]: r for r in manifest(extra).collect()}
    assert {k: r["documents"] for k, r in kept.items()} == {"s0": 20, "s1": 20, "s2": 20} and {r["root"] for r in kept.values()} == {want[0][3]}
    assert {r["subroot"] for r in kept.values()} == {x[2] for x in want}


def test_directory_places_every_id(spark):
    from quarry.llm.merkle import bitmap_directory

    ids = sorted({(k * k * 2654435761) % 2**63 - 2**62 for k in range(3000)} | set(range(-200, 200)))
    words = bitmap_directory(spark.createDataFrame([("1s", i) for i in ids], "src string, id long")).collect()
    for w in words:
        low = w["word"] * 64
        assert w["before"] == sum(i < low for i in ids) and w["n"] == sum(low <= i < low + 64 for i in ids) and w["total"] == len(ids)
    assert sum(bin(w["bits"] & (2**64 - 1)).count("1") for w in words) == len(ids)
