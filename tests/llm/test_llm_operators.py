"""The training-data operators against brute force on small tables, with odd rows."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

LOW = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, key string"


def words(text):
    return (text or "").encode().translate(LOW).split()


def corpus(seed=0, n=60):
    """Random texts with copies, near copies, shared passages, and null, empty, blank and odd ones."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 6))) for _ in range(400)]
    make = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    texts = [make(rng.randint(1, 150)) for _ in range(n)]
    passage = make(50)
    for k in range(0, n, 9):
        texts[k] = f"{make(20)}\n{passage} {make(10)}"
    for k in range(1, n, 7):
        texts[k] = texts[0]
    for k in range(3, n, 11):
        w = make(120).split() if k == 3 else texts[3].split()
        if k > 3:
            w[rng.randrange(len(w))] = "changed"
        texts[k] = " ".join(w)
    texts += [None, "", " \n\t ", "one two", "One TWO", "\x0bé\xa0x\x0c y", "x " * 200, make(9000)]
    return [(k * 3, t, "en", f"s{k % 4}" if k % 5 else None, len(t or ""), 0.5, "z") for k, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_words_are_those_of_bytes_split():
    from quarry.llm.common import words_of_texts

    texts = [r[1] for r in corpus()]
    found = words_of_texts(texts)
    raw = found.data.tobytes()
    for k, t in enumerate(texts):
        a, b = found.first[k], found.first[k + 1]
        assert [raw[i:j] for i, j in zip(found.starts[a:b], found.ends[a:b])] == (t or "").encode().split()


def test_token_code_round_trip():
    from quarry.llm.token_output import pack, unpack

    rng = np.random.default_rng(0)
    for n in (0, 1, 3, 4, 5, 1000):
        x = rng.integers(0, 1 << 32, n, dtype=np.uint64).astype(np.uint32) >> rng.integers(0, 32, n).astype(np.uint32)
        assert (unpack(*pack(x), n) == x).all()


def test_token_output(docs, empty):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    from quarry.llm.common import shared_dir
    from quarry.llm.token_output import read_digest, read_ids, token_table, write_tokens

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    at, want, ids = 0, {}, {}
    for i, text, *_ in sorted(corpus(), key=lambda r: r[0]):
        ids[i] = t.encode(text or "", add_special_tokens=False).ids + [2]
        want[i] = (at, len(ids[i]), zlib.crc32(np.array(ids[i], "<u4").tobytes()))
        at += len(ids[i])
    out = shared_dir(docs.sparkSession)
    write_tokens(docs, out, path, block_ids=500)
    assert {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in read_digest(docs.sparkSession, out).collect()} == want
    assert {r["doc_id"]: r["ids"] for r in read_ids(docs.sparkSession, out).collect()} == ids
    assert token_table(empty, path).count() == 0
    repeated = token_table(docs.union(docs), path)
    assert repeated.count() == 2 * len(want) and repeated.agg({"n_tokens": "sum"}).first()[0] == 2 * at


def removed(texts, window=35):
    seen = Counter(tuple(w[k : k + window]) for w in texts for k in range(len(w) - window + 1))
    out = []
    for w in texts:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if seen[tuple(w[k : k + window])] > 1:
                gone[k : k + window] = [True] * window
        kept = [x for x, g in zip(w, gone) if not g]
        out.append((len(w), sum(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return out


def test_substring_dedup(docs, empty):
    from quarry.llm.substring_dedup import COVER, PERIOD, dedup_substrings

    assert {(a - b) % PERIOD for a in COVER for b in COVER} == set(range(PERIOD))
    data = corpus()
    want = dict(zip([r[0] for r in data], removed([(r[1] or "").encode().split() for r in data])))
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in dedup_substrings(docs).collect()} == want
    assert dedup_substrings(empty).count() == 0
    twice = removed([(r[1] or "").encode().split() for r in data] * 2)
    got = dedup_substrings(docs.union(docs)).select("n_words", "n_removed", "kept_sha256")
    assert Counter(map(tuple, got.collect())) == Counter(twice)


def linked(texts, percent=80):
    sets = []
    for t in texts:
        w = words(t)
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    up = list(range(len(texts)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return [(len(s), root(k)) for k, s in enumerate(sets)]


def test_ngram_join(docs, empty):
    from quarry.llm.ngram_join import jaccard_components, one_of_each

    data = corpus()
    want = {data[k][0]: (n, data[c][0]) for k, (n, c) in enumerate(linked([r[1] for r in data]))}
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_components(docs).collect()} == want
    assert jaccard_components(empty).count() == 0
    kept = one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, (n, c) in want.items() if i == c)
    assert one_of_each(docs.union(docs)).count() == kept.count()


def test_toxicity(spark, empty):
    from quarry.llm.toxicity import fold, held_out, hits, learn_lexicon, score_toxicity, without_toxic

    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("abcdefg") for _ in range(5)) for _ in range(300)]
    data, labels = [], []
    for k in range(600):
        w = [rng.choice(vocabulary) for _ in range(rng.randint(4, 60))]
        toxic = k % 5 == 0
        if toxic:
            w.insert(rng.randrange(len(w)), rng.choice(["zounds", "zxq" + rng.choice("abcde") + "h", "ZOUNDS", "z0unds"]))
        data.append((k, " ".join(w)))
        labels.append((k, int(toxic)))
    data += [(700, None), (701, ""), (702, "z0und5 are zounds")]
    docs, lab = spark.createDataFrame(data, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = score_toxicity(docs, lab).collect()
    truth = dict(labels)
    assert len(got) == len(data) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) >= 0.95 * len(held)
    assert {r["doc_id"]: r["predicted"] for r in got}[702] == 1
    lexicon = learn_lexicon(docs, lab, exceptions=("zounds cake",))
    found = lambda t: [x[3] for x in hits(lexicon.automaton(), fold(t))]
    assert found("z0unds") and found("zоunds") and not found("a zounds cake") and not found("azounds")
    assert without_toxic(docs, lab).columns == docs.columns
    assert score_toxicity(empty, lab).count() == 0 and all(r["predicted"] == 0 for r in score_toxicity(docs, lab.limit(0)).collect())
    assert spark.createDataFrame([(None,)], "doc_id long").select(held_out()).first()[0] is False


def test_decontamination(spark, docs, empty):
    from quarry.llm.decontamination import contaminated, without_items

    data = {r[0]: r[1] for r in corpus()}
    passage = " ".join(data[0].split("\n")[1].split()[:50])
    items = spark.createDataFrame([(1, passage), (2, "never seen words stand here. not at all."), (3, None), (4, ""), (5, passage.translate({k: k - 32 for k in range(97, 123)}))], "item_id long, text string")
    want = {i for i, t in data.items() if t and passage in " ".join(t.split())}
    got = contaminated(docs, items).collect()
    assert len(want) > 3 and {r["doc_id"] for r in got if r["item_id"] == 1} == want and {r["item_id"] for r in got} == {1, 5}
    kept = without_items(docs, items)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == set(data) - want
    assert contaminated(empty, items).count() == 0 and contaminated(docs, items.limit(0)).count() == 0


def test_mixing(docs, empty):
    from quarry.llm.mixing import in_mixed_order, mix_table, schedule, slots_of

    slots = slots_of({"a": 5, "b": 3, "c": 1.7, "d": 0.01}, 64)
    assert sum(slots.values()) == 64
    had = Counter()
    for t, (s, _, at, release, deadline) in enumerate(schedule(slots, 64)):
        had[s] += 1
        assert at == t and release <= t < deadline
        assert all(abs(had[s] - n / 64 * (t + 1)) < 1 for s, n in slots.items())
    got = mix_table(docs, {"s1": 2, "s2": 1, "s3": 1, "": 1}, block_bytes=300).collect()
    assert len(got) == docs.count() and len({r["mix_order"] for r in got}) == len(got)
    blocks = {}
    for r in got:
        assert blocks.setdefault(r["slot"], (r["source"], r["block"])) == (r["source"], r["block"])
    assert mix_table(empty).count() == 0
    odd = docs.selectExpr("*", "doc_id as _a", "doc_id as mix", "doc_id as _at", "doc_id as bucket", "doc_id as row", "doc_id as plan")
    kept = in_mixed_order(odd)
    assert kept.columns == odd.columns and sorted(map(str, kept.collect())) == sorted(map(str, odd.collect()))
    assert mix_table(docs.union(docs)).count() == 2 * docs.count() and in_mixed_order(empty).count() == 0
    assert slots_of({}) == {}
    assert in_mixed_order(docs).columns == docs.columns and in_mixed_order(docs).count() == docs.count()


def test_quality(spark, empty):
    from quarry.llm.quality import score_quality

    rng = random.Random(7)
    data, labels = [], []
    for k in range(500):
        w = ["".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(10, 80))]
        good = k % 4 != 0
        data.append((k, " ".join(w) if good else " | ".join(w) if k % 8 else " ".join(w[:3] * 20)))
        labels.append((k, int(good)))
    data += [(900, None), (901, "")]
    lab = spark.createDataFrame(labels, "doc_id long, quality int")
    got = score_quality(spark.createDataFrame(data, "doc_id long, text string"), lab).collect()
    truth = dict(labels)
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert len(got) == len(data) and sum(r["predicted"] == truth[r["doc_id"]] for r in held) >= 0.95 * len(held)
    assert score_quality(empty, lab).count() == 0
    assert {r["score"] for r in score_quality(spark.createDataFrame(data[:3], "doc_id long, text string"), lab.limit(0)).collect()} == {0.5}


def test_gradients():
    from quarry.llm.recurrent import Shape, Streams, log_probability, new_weights, output, run, train

    rng = np.random.default_rng(0)
    shape = Shape(np.array([0, 0, 1, 1, 1]), 2, 4)
    w = {k: x.astype(np.float32) + rng.normal(0, 0.3, x.shape).astype(np.float32) for k, x in new_weights(shape, np.ones(7)).items()}
    total = np.zeros(2)
    for token in range(7):  # the first token's probabilities add up to one
        total[0] += np.exp(log_probability(w, shape, np.array([token]), np.array([0, 1]))[0])
    assert abs(total[0] - 1) < 1e-5
    tokens, first = rng.integers(0, 7, 40), np.array([0, 15, 15, 40])
    a = log_probability(w, shape, tokens, first, width=3, window=4)
    assert np.allclose(a, log_probability(w, shape, tokens, first, width=1, window=50), atol=1e-4) and a[1] == 0
    text = np.tile(np.array([0, 3, 1, 5]), 300)
    better = train(w, shape, text, np.arange(0, 1201, 60), width=4)
    assert log_probability(better, shape, text, np.array([0, 1200]))[0] > log_probability(w, shape, text, np.array([0, 1200]))[0] + 300
    s = Streams(tokens, first, shape, 2)
    states, _ = run(w, s, s.at, np.zeros((2, 4), np.float32))
    assert output(w, shape, states[s.at >= 0], tokens[s.at[s.at >= 0]])[0].shape == (40,)


def test_language_model(docs, empty, monkeypatch):
    from quarry.llm import language_model

    monkeypatch.setattr(language_model, "KNOWN_WORDS", 200)  # so that the join is used
    got = {r["doc_id"]: r for r in language_model.score_documents(docs).collect()}
    data = {r[0]: words(r[1]) + [None] for r in corpus()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in data}
    c = Counter(x for i, w in data.items() if not held[i] for x in w)
    n, v = sum(c.values()), len(c)
    for i, w in data.items():
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(w), sum(c[x] > 0 for x in w), n)
        assert math.isclose(r["base_score"], sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), rel_tol=1e-9, abs_tol=1e-7) and r["score"] < 0
    assert language_model.score_documents(empty).count() == 0


def test_neighbours(spark):
    from quarry.llm.neighbours import nearest

    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, 12)).astype(np.float32)
    x[300:340] = x[0]
    data = [(k, r.tolist()) for k, r in enumerate(x)]
    odd = [(1000, None), (1100, [0.0] * 12), (1200, [float("nan")] * 12), (1300, [None] * 12), (1400, [1.0])]
    got = nearest(spark.createDataFrame(data + odd, "vec_id long, embedding array<float>")).collect()
    hit = 0
    for q in range(0, 600, 100):
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(1))
        d[q] = np.inf
        want = np.lexsort((np.arange(600), d))[:10]
        own = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(1, 11)) and all(abs(r["score"] - d[r["vec_id"]]) < 1e-12 for r in own)
        hit += len({r["vec_id"] for r in own} & set(want.tolist()))
    assert hit >= 54 and {r["query_id"] for r in got} == set(range(0, 600, 100))
    few = nearest(spark.createDataFrame(data[:3], "vec_id long, embedding array<float>")).collect()
    assert [(r["query_id"], r["rank"]) for r in few] == [(0, 1), (0, 2)]


def test_ngram_join_of_loose_copies(spark):
    """A large group of copies that are too far apart to be one class: few pairs are made, no link is lost."""
    from quarry.llm import ngram_join

    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(3000)]
    origin, data = [rng.choice(vocabulary) for _ in range(150)], []
    for k in range(420):
        w = list(origin)
        for _ in range(rng.randrange(9)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        data.append((k, " ".join(w + [rng.choice(vocabulary) for _ in range(rng.randrange(30))])))
    data += [(1000 + k, " ".join(["long"] * 3 + [rng.choice(vocabulary) for _ in range(2500)])) for k in range(3)] + [(1005 + k, data[-1][1] if k else None) for k in range(2)]
    want = {data[k][0]: (n, data[c][0]) for k, (n, c) in enumerate(linked([t for _, t in data]))}
    docs = spark.createDataFrame(data, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_components(docs).collect()}
    assert got == want and 1 < len({c for _, c in got.values()}) < len(data) - 50


def test_parities_bound_the_difference():
    from quarry.llm.ngram_join import parities_of

    rng = np.random.default_rng(5)
    x = np.unique(rng.integers(0, 1 << 63, 900, dtype=np.int64).astype(np.uint64))
    for cut in (0, 1, 40, 300):
        y = np.concatenate([x[cut:], rng.integers(0, 1 << 63, cut // 2, dtype=np.int64).astype(np.uint64)])
        a, b = (np.unpackbits(np.frombuffer(parities_of(z), np.uint8), bitorder="little") for z in (x, y))
        if len(a) > len(b):
            a = a.reshape(2, -1)[0] ^ a.reshape(2, -1)[1]
        assert int((a ^ b).sum()) <= len(np.setxor1d(x, y)) and (cut or not (a ^ b).any())


def test_gradient_by_differences():
    """The gradient of one window, as training sees it through Adam's first step, has the sign of finite differences."""
    from quarry.llm.recurrent import Shape, log_probability, new_weights, train

    rng = np.random.default_rng(1)
    shape = Shape(np.array([0, 0, 1, 1]), 2, 3)
    w = {k: (x + rng.normal(0, 0.4, x.shape)).astype(np.float32) for k, x in new_weights(shape, np.ones(6)).items()}
    tokens, first = rng.integers(0, 6, 12), np.array([0, 12])
    stepped = train(w, shape, tokens, first, width=1, window=12, rate=1e-3)
    checked = 0
    for name, x in w.items():
        for at in np.ndindex(x.shape):
            up, down = ({k: y.astype(np.float64) for k, y in w.items()} for _ in range(2))
            up[name][at] += 1e-3
            down[name][at] -= 1e-3
            slope = (log_probability(up, shape, tokens, first)[0] - log_probability(down, shape, tokens, first)[0]) / 2e-3
            if abs(slope) > 0.05:
                assert np.sign(stepped[name][at] - x[at]) == np.sign(slope), (name, at, slope)
                checked += 1
    assert checked > 40


def test_language_model_learns(spark):
    """Held-out texts of a language with order are likelier than their words' counts make them, by a third of the base's log at least; a rerun agrees."""
    from quarry.llm import language_model

    rng = random.Random(9)
    follow = {k: [rng.randrange(60) for _ in range(2)] for k in range(60)}
    data = []
    for k in range(900):
        x, out = rng.randrange(60), []
        for _ in range(rng.randint(20, 120)):
            out.append(f"w{x}")
            x = rng.choice(follow[x])
        data.append((k, " ".join(out)))
    docs = spark.createDataFrame(data + data[:5], "doc_id long, text string")
    got = language_model.score_documents(docs).collect()
    held = [r for r in got if r["held_out"]]
    assert len(got) == 905 and sum(r["score"] for r in held) > 0.67 * sum(r["base_score"] for r in held)
    again = language_model.score_documents(docs.repartition(3)).collect()
    key = lambda rows: sorted((r["doc_id"], round(r["score"], 3)) for r in rows)
    assert key(got) == key(again)


def test_end_token_has_a_share_beside_many_frequent_words():
    from quarry.llm.language_model import END, HEAD, TAILS, Vocabulary

    keys = np.r_[np.arange(2000) * 64 + 3, END & ~63 | 63]
    v = Vocabulary(keys, np.r_[np.full(2000, 50), 7], keys & 63, np.full(TAILS, 5e4), np.full(TAILS, 900.0), 100_007, 2001)
    assert v.head[np.searchsorted(v.keys, END & ~63 | 63)] >= 0 and (v.head >= 0).sum() == HEAD


def test_pieces_against_the_tokenizer():
    """Texts of odd signs, spaces and letters: the ids put together from pieces are the tokenizer's own."""
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from quarry.llm.token_output import Encoder

    enc, rng = Encoder(public_tokenizers.path("byte_bpe_50k.json")), random.Random(3)
    signs = ["a", "b", "Z", "é", "ß", "×", "÷", "«", "»", "'", "'s", "'t", "'ll", ",", ".", "!", "-", "_", "$", "1", "23", "²", "½", "中", "。", "–", "’", "😀", "́"]
    odd = ["\u00a0", "\u3000", "\u2009", "  ", "\n\n", "\t", "\r", "\x1c", "\u0085", "<|", "<|endoftext|>", "\x00"]
    texts = [None, "", " ", "\n", " a", "a ", "x" * 700, "a" + "," * 300]
    for k in range(4000):
        texts.append("".join(rng.choice(signs + [" "] * 12 + ["\n"] * 4 + ["th", "in", ",", "."] * 3 + (odd if k % 2 else [])) for _ in range(rng.randrange(40))))
    raw = [(x or "").encode() for x in texts]
    for part in (slice(0, 2000), slice(1500, None), slice(0, 0)):
        own = raw[part]
        ids, n = enc.encode(np.frombuffer(b"".join(own), np.uint8), np.cumsum([0, *map(len, own)]), 2)
        cuts = np.split(ids, np.cumsum(n)[:-1]) if len(own) else []
        for t, found in zip(texts[part], cuts):
            assert found.tolist() == [*enc.tokenizer.encode(t or "", add_special_tokens=False).ids, 2], t


def test_neighbours_of_doubles_repeats_and_none(spark):
    """64-bit vectors are measured as they are; repeated ids and an empty table have defined results."""
    from quarry.llm.neighbours import nearest

    rng = np.random.default_rng(6)
    x = rng.normal(size=(150, 8))
    x[50:60] = x[0] + rng.normal(size=(10, 8)) * 1e-9
    docs = spark.createDataFrame([(k, v.tolist(), 1) for k, v in enumerate(x)] + [(100, x[1].tolist(), 2)], "vec_id long, embedding array<double>, query long")
    got = sorted((r for r in nearest(docs).collect() if r["query_id"] == 0), key=lambda r: r["rank"])
    d = np.sqrt(((x - x[0]) ** 2).sum(1))
    want = sorted(range(1, 150), key=lambda k: (d[k], k))[:10]
    assert [r["vec_id"] for r in got] == want and all(r["score"] == d[r["vec_id"]] for r in got)
    own = [r for r in nearest(docs).collect() if r["query_id"] == 100]
    assert len(own) == 10 and all(r["vec_id"] != 100 for r in own)
    assert nearest(docs.limit(0)).count() == 0
