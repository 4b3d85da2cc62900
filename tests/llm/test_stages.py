"""Stages of the pipeline, each against a plain version of its operator, and the whole pipeline on odd tables."""

import math
import random
import re

import numpy as np
import pytest

DATA = "/root/testdata/sf0.001"
SPACE = re.compile("[ \t-\r]+")
LOWER = {k: k + 32 for k in range(65, 91)}
PLAIN = {k: 32 for k in range(33, 127) if not chr(k).isalnum()} | LOWER


def split(text, table):
    return [w for w in SPACE.split((text or "").translate(table)) if w]


def runs(words, n):
    return {tuple(words[k : k + n]) for k in range(len(words) - n + 1)}


def plain_items(docs, items):
    """{(doc_id, item_id): score}: every passage scored against every unit by BM25, then both overlaps."""
    from quarry.llm.decontamination import question_and_answer

    units = []
    for i, text in items:
        words = split(text, PLAIN)
        if words:
            units += [(i, list(x)) for x in np.array_split(np.array(words, object), -(-len(words) // 48))]
    mean, df = sum(len(u) for _, u in units) / len(units), {}
    for _, u in units:
        for t in set(u):
            df[t] = df.get(t, 0) + 1
    weights = []
    for i, u in units:
        w = {t: math.log(1 + (len(units) - df[t] + 0.5) / (df[t] + 0.5)) * u.count(t) * 2.2 / (u.count(t) + 1.2 * (0.25 + 0.75 * len(u) / mean)) for t in set(u)}
        weights.append((i, {t: x / sum(w.values()) for t, x in w.items()}))
    parts = {i: [split(p, PLAIN) for p in question_and_answer(text)] for i, text in items if text}
    length = {i: len(split(text, PLAIN)) for i, text in items}
    found, refused = {}, 0
    for d, text in docs:
        words = split(text, PLAIN)
        for a in range(0, max(1, len(words)), 48):
            passage = set(words[a : a + 96])
            for i, w in weights:
                score = sum(x for t, x in w.items() if t in passage)
                if score < 0.5 - 1e-6:
                    continue
                around = words[max(0, a - length[i] - 4) : a + 96 + length[i] + 4]
                around = runs(around, 3) | runs(around, 1)
                of = [runs(p, 3) if len(p) >= 3 else runs(p, 1) for p in parts[i]]
                q, r = (len(x & around) / len(x) if x else 1.0 for x in of)
                if q >= 0.6 and r >= 0.5:
                    found[d, i] = max(score, found.get((d, i), 0.0))
                else:
                    refused += 1
    return found, refused


def test_decontamination_finds_what_plain_bm25_finds(spark):
    from quarry.llm.decontamination import contaminated

    rng = random.Random(9)
    vocabulary = [f"w{k}" for k in range(260)]
    text = lambda n: [vocabulary[min(rng.randrange(260), rng.randrange(260))] for _ in range(n)]

    def changed(words):
        how, words = rng.randrange(5), list(words)
        if how == 1:
            return words[: max(3, len(words) * rng.randint(3, 9) // 10)]
        if how == 2:
            rng.shuffle(words)
        if how == 3:
            return [w if rng.random() < 0.9 else "new" for w in words]
        if how == 4:
            return [w.upper() + "," for w in words]
        return words

    items = [(k, " ".join(text(rng.randint(2, 160))) + (f"\nAnswer: {' '.join(text(rng.randint(1, 12)))}" if k % 2 else ". And the last.")) for k in range(40)]
    docs = [(k, " ".join(text(rng.randint(0, 150)) + changed(items[k % 40][1].replace("\n", " ").split(" ")) + text(rng.randint(0, 150)))) for k in range(120)]
    docs += [(200, None), (201, ""), (202, "w1"), (203, " ".join(text(20_000)) + " " + items[3][1])]
    want, refused = plain_items(docs, items)
    rows = contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([*items, (50, None), (51, ""), (52, ".,;")], "item_id long, text string")).collect()
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in rows}
    assert len(rows) == len(got) and refused > 10 and 40 < len(want) < 124 * 40
    assert set(got) == set(want) and (203, 3) in got
    assert all(abs(got[k] - want[k]) < 1e-6 for k in want)


def plain_score(lexicon, text):
    from quarry.llm.toxicity import fold

    folded = fold(text or "")

    def places(entry, whole):
        for a in range(len(folded) - len(entry) + 1):
            b = a + len(entry)
            if folded[a:b] == entry and not (a and folded[a - 1].isalpha()) and not (whole and b < len(folded) and folded[b].isalpha()):
                yield a, b

    spared = [p for x in lexicon.exceptions if x not in lexicon.entries and x in folded for p in places(x, True)]
    best = {}
    for entry, (weight, whole) in lexicon.entries.items():
        if entry in folded:
            for a, b in places(entry, whole):
                if not any(x <= a and b <= y for x, y in spared):
                    best[a] = max(weight, best.get(a, 0.0))
    one, hits, words = lexicon.curve
    return 1 / (1 + math.exp(-(one + hits * math.log1p(sum(best.values())) + words * math.log1p(len((text or "").split())))))


def one_of_each(texts):
    """Smallest doc_id of each component of {doc_id: text}; texts without words all stay."""
    sets = {}
    for d, text in texts.items():
        words = split(text, LOWER)
        sets[d] = runs(words, 5) if len(words) >= 5 else {tuple(words)} if words else set()
    kept, ids, left = set(), sorted(sets), set(sets)
    for d in ids:
        if d not in left:
            continue
        kept.add(d)
        left.discard(d)
        near = [d]
        while near:
            a = sets[near.pop()]
            met = [x for x in left if a and sets[x] and 100 * len(a & sets[x]) >= 80 * len(a | sets[x])]
            left.difference_update(met)
            near += met
    return kept


def test_stages_keep_what_plain_versions_keep(spark):
    import corpus_pipeline
    from quarry.llm.toxicity import learn_lexicon

    read = lambda name: spark.read.parquet(f"{DATA}/{name}.parquet")
    docs, stages = read("documents"), dict(corpus_pipeline.STAGES)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}

    lexicon = learn_lexicon(docs, read("labels"))
    scores = {d: plain_score(lexicon, t) for d, t in texts.items()}
    want = {d for d, s in scores.items() if s < 0.7}
    assert ids(stages["toxicity"](spark, docs, DATA)) == want and len(want) < len(texts)

    assert ids(stages["near_duplicates"](spark, docs, DATA)) == one_of_each(texts) != set(texts)

    benchmark = [(r["item_id"], r["text"]) for r in read("benchmark").collect()]
    leaked = {d for d, _ in plain_items(list(texts.items()), benchmark)[0]}
    assert ids(stages["decontamination"](spark, docs, DATA)) == set(texts) - leaked and leaked


LONG = "many words of one very long text that repeats nothing of the others " * 30_000
ODD = [
    (None, None, None, None, None, 0),
    (None, "a text without an id stays here", "s", "en", 5, 1),
    (1, None, "s", None, None, 2),
    (2, "", None, "en", 0, 3),
    (3, " \t\n", "s", "en", 3, 4),
    (4, "twice the same row, with the same id and words", "s", "en", 9, 5),
    (4, "twice the same row, with the same id and words", "s", "en", 9, 5),
    (4, "the same id but quite another text of some words", "t", "en", 9, 6),
    (5, "Twice the same row, with the same id and Words", "t", "en", 9, 7),
    (6, LONG, "long", "en", len(LONG), 8),
    (7, "\x00 ퟿ あก café \U0001f600", "é", "xx", 9, 9),
]


@pytest.mark.parametrize("rows", [ODD, []], ids=["odd", "empty"])
def test_pipeline_of_odd_rows(spark, tmp_path, rows):
    """Nulls, empty and long texts, repeats, ties, columns of clashing names; full repeats are one document after near_duplicates."""
    pytest.importorskip("public_tokenizers")
    import corpus_pipeline

    schema = "doc_id long, text string, source string, lang string, n_chars long, "
    docs = spark.createDataFrame([(*r, r[5]) for r in rows], schema + "key int, mix int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{DATA}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, str(tmp_path)).cache()
        assert kept.columns == docs.columns, name
    assert sorted(r["key"] for r in kept.collect()) == sorted({r[5] for r in rows} - {7})
    out = sorted((r["start"], r["n_tokens"], r["doc_id"] is None) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert len(out) == kept.count() and sum(x[2] for x in out) == (2 if rows else 0)
    at = 0
    for start, n, _ in out:
        assert start == at and n >= 1
        at += n
