"""LM scoring: a gated recurrent language model over words, trained and applied by Spark tasks.

Words are `[^\\x20\\x09-\\x0D]+`, A-Z in lower case; each text ends with one end token. The counts of all
training tokens are exact: tasks add up their own, a shuffle adds up the rest. The most frequent words
make the network's head; every other word, known or not, belongs to a tail class by its spelling, and
takes its share of the class by its count plus one. So every text has a probability, and the untrained
network is a unigram model by classes.

The network learns by truncated backpropagation in numpy. In each round several replicas go on from the
same weights, each over documents of its own, and their weights are averaged. Weights have a fixed size.
Every training document is in one round's share, so the weights learn from all of them, once.

Scoring carries the state through whole documents. Counts of frequent words are looked up in a table of
bounded size; the other words' counts come by a join.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import U64, Words, longs, row_key, signed, stored, unique_counts, words_of
from .recurrent import Shape, log_probability, new_weights, train

HEAD = 1000
HEAD_CLASSES = 24
HIDDEN = 16
#: Words whose counts are looked up by each task, at most; it bounds what is broadcast.
KNOWN_WORDS = 1 << 18
ROUNDS = 3
#: Training tokens of a replica in a round, about, and replicas, at most.
REPLICA_TOKENS = 600_000
MOST_REPLICAS = 512
#: Tokens that a task scores at a time.
CHUNK_TOKENS = 1 << 19
LONG_TEXT = 1024

END = 0x6A09E667F3BCC908
SIGN = np.zeros(256, bool)
SIGN[[x for x in range(33, 127) if not chr(x).isalnum()]] = True
LENGTHS = np.array([3, 5, 8, 12])
TAILS = (len(LENGTHS) + 1) * 2 * 4


def tail_class(words: Words) -> np.ndarray:
    """Of each word: by its bytes' number, a sign at its end, and its last byte outside ASCII."""
    length = np.searchsorted(LENGTHS, words.ends - words.starts, side="right")
    if not len(length):
        return length
    at = np.where(words.data >= 128, np.arange(len(words.data)), -1)
    last = np.maximum.accumulate(at)[words.ends - 1]
    foreign = np.where(last >= words.starts, 1 + words.data[np.maximum(last, 0)] % 3, 0)
    return (length * 2 + SIGN[words.data[words.ends - 1]]) * 4 + foreign


def in_training(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 7 != 2, F.lit(True))


def token_counts(texts: DataFrame) -> DataFrame:
    """(hash, tail, c): exact counts of all tokens of column text; the end token's hash is END, its tail 63, which is no tail class."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = ends = 0

        def out() -> Iterator[pa.RecordBatch]:
            keys, n = np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held])
            order = np.argsort(keys, kind="stable")
            keys, n = keys[order], n[order]
            at = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            keys, n = keys[at], np.add.reduceat(n, at)
            for k in range(0, len(keys), 1 << 16):
                some = slice(k, k + (1 << 16))
                yield pa.RecordBatch.from_pydict({"key": signed(keys[some]), "c": n[some].astype(np.int64)})

        for rows, words in words_of(batches, lower=True):
            ends += rows.num_rows
            keys, n = unique_counts(words.hashes & ~U64(63) | tail_class(words).astype(U64))
            held.append((keys, n))
            size += len(keys)
            if size >= 1 << 21:
                yield from out()
                held, size = [], 0
        if size:
            yield from out()
        if ends:
            yield pa.RecordBatch.from_pydict({"key": [END & ~63 | 63], "c": [ends]})

    found = texts.mapInArrow(count, "key long, c long").groupBy("key").agg(F.sum("c").alias("c"))
    return found.select("key", F.col("key").bitwiseAND(F.lit(63)).cast("int").alias("tail"), "c")


class Vocabulary:
    """Head words, tail classes and counts of the most frequent words; of bounded size."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, tails: np.ndarray, tail_tokens: np.ndarray, tail_types: np.ndarray, tokens: int, types: int):
        order = np.lexsort((keys, -counts))
        top = order[:HEAD]
        end = np.flatnonzero(keys == (END & ~63 | 63))
        if len(end) and end[0] not in top:  # the end is always in the head, as no tail class counts it
            top[-1] = end[0]
        cut = np.cumsum(np.sqrt(counts[top]))
        classes = np.minimum((cut - 1e-9) / (cut[-1] if len(cut) else 1) * HEAD_CLASSES, HEAD_CLASSES - 1).astype(np.int64)
        self.shape = Shape(np.unique(classes, return_inverse=True)[1], TAILS, HIDDEN)
        self.counts_of_head = counts[top].astype(float)
        head = np.full(len(keys), -1)
        head[top] = np.arange(len(top))
        by_key = np.argsort(keys)
        self.keys, self.counts, self.head = keys[by_key], counts[by_key], head[by_key]
        self.bits = max(1, len(keys).bit_length())
        self.begin = np.searchsorted(self.keys >> (64 - self.bits), np.arange(-(1 << self.bits - 1), (1 << self.bits - 1) + 1))  # keys by their first bits
        left = np.bincount(tails[top][tails[top] < TAILS], weights=counts[top][tails[top] < TAILS], minlength=TAILS), np.bincount(tails[top][tails[top] < TAILS], minlength=TAILS)
        self.tail_tokens, self.tail_types = tail_tokens - left[0], tail_types - left[1]
        self.tokens, self.types = tokens, types

    def places(self, keys: np.ndarray) -> np.ndarray:
        """Where each key stands in self.keys, -1 if it doesn't: from the first key of its first bits on."""
        part = (keys >> (64 - self.bits)) + (1 << self.bits - 1)
        at, end = self.begin[part], self.begin[part + 1]
        out = np.full(len(keys), -1)
        left = np.flatnonzero(at < end)
        while len(left):
            here = at[left]
            found = self.keys[here] == keys[left]
            out[left[found]] = here[found]
            left = left[~found]
            at[left] += 1
            left = left[at[left] < end[left]]
        return out

    def tokens_of(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(tokens, first, counts, keys) with an end token after each text; a count is -1 where it isn't known here."""
        n = len(words.first) - 1
        tail = tail_class(words)
        key = signed(words.hashes & ~U64(63) | tail.astype(U64))
        ends = words.first[1:] + np.arange(n)
        first = np.r_[0, ends + 1]
        place = np.ones(len(key) + n, bool)
        place[ends] = False
        keys = np.full(len(key) + n, END & ~63 | 63, np.int64)
        keys[place] = key
        token = np.full(len(keys), 0)
        token[place] = tail
        token[ends] = 0
        token += self.shape.head
        count = np.full(len(keys), -1, np.int64)
        if len(self.keys):
            at = self.places(keys)
            hit = at >= 0
            count[hit] = self.counts[at[hit]]
            head = np.where(hit, self.head[at], -1)
            token = np.where(head >= 0, head, token)
        return token, first, count, keys


def learn_vocabulary(counts: DataFrame, most: int = 0) -> Vocabulary:
    """The most frequent words, `most` (KNOWN_WORDS) or all if there are fewer; the end is always one of them.

    Words come by levels of their counts, sixteen to a doubling; of the level in which the bound falls,
    those of the smallest keys. What reaches the driver besides the words are numbers of words by level,
    and for that one level by the first 16 bits of the keys.
    """
    most = most or KNOWN_WORDS
    sums = counts.groupBy("tail").agg(F.sum("c").alias("tokens"), F.count(F.lit(1)).alias("types")).collect()
    tail_tokens, tail_types = np.zeros(TAILS), np.zeros(TAILS)
    for r in sums:
        if r["tail"] < TAILS:
            tail_tokens[r["tail"]], tail_types[r["tail"]] = r["tokens"], r["types"]
    level = F.floor(F.log2("c") * 16)
    steps = sorted(((r["level"], r["n"]) for r in counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    total, border = 0, None
    for at, n in steps:
        if total + n > most:
            border = at
            break
        total += n
    top = counts
    if border is not None:
        room, part = most - total, F.shiftright("key", 48)
        on = counts.where(level == border)
        parts = sorted((r["part"], r["n"]) for r in on.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()) if room else []
        reach = np.cumsum([n for _, n in parts])
        last = parts[int(np.searchsorted(reach, room))][0] if room else 0
        some = on.where(part <= last).orderBy("key").limit(room)
        top = counts.where(level > border).unionByName(some).unionByName(counts.where(F.col("key") == (END & ~63 | 63))).dropDuplicates(["key"])
    top = top.toArrow()
    column = lambda c, t: top.column(c).to_numpy().astype(t)
    return Vocabulary(column("key", np.int64), column("c", np.int64), column("tail", np.int64), tail_tokens, tail_types, int(sum(r["tokens"] for r in sums)), int(sum(r["types"] for r in sums)))


def learn_network(texts: DataFrame, vocabulary) -> dict[str, np.ndarray]:
    """Rounds of replicas over shares of the training texts; texts: key, text. vocabulary: a broadcast."""
    v = vocabulary.value
    weights = new_weights(v.shape, np.r_[v.counts_of_head, v.tail_tokens])
    if not v.tokens:
        return weights
    shares = texts.withColumn("round", F.pmod(F.xxhash64("key", F.lit(29)), F.lit(ROUNDS)))
    replicas = int(min(MOST_REPLICAS, max(2, v.tokens // (ROUNDS * REPLICA_TOKENS))))
    spark = texts.sparkSession
    for k in range(ROUNDS):
        shared = spark.sparkContext.broadcast(weights)

        def learn(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            v, w, n, held, size = vocabulary.value, shared.value, 0, [], 0

            def step() -> None:
                nonlocal w, n
                first = np.r_[0, np.cumsum(np.concatenate([np.diff(f) for _, f in held]))]
                w = train(w, v.shape, np.concatenate([t for t, _ in held]), first)
                n += int(first[-1])

            for _, words in words_of(batches, lower=True):
                token, first, _, _ = v.tokens_of(words)
                held.append((token, first))
                size += len(token)
                if size >= CHUNK_TOKENS:
                    step()
                    held, size = [], 0
            if size:
                step()
            if n:
                yield pa.RecordBatch.from_pydict({"slot": [int(np.random.default_rng(n).integers(16))], "n": [n], "w": [pickle.dumps({c: x * np.float32(n) for c, x in w.items()})]})

        def add(rows):
            total: dict[str, np.ndarray] = {}
            for raw in sorted(rows.column("w").to_pylist()):  # in one order, so that a repeated task gives the same sums
                for c, x in pickle.loads(raw).items():
                    total[c] = total.get(c, 0) + x
            return pa.table({"slot": rows.column("slot")[:1], "n": [int(sum(rows.column("n").to_pylist()))], "w": [pickle.dumps(total)]})

        schema = "slot long, n long, w binary"
        learned = shares.where(F.col("round") == k).select("key", "text").repartition(replicas, "key").sortWithinPartitions("key", "text").mapInArrow(learn, schema)
        learned = learned.groupBy("slot").applyInArrow(add, schema).collect()  # 16 rows at most
        if learned:
            n = sum(r["n"] for r in learned)
            sums = [pickle.loads(bytes(r["w"])) for r in sorted(learned, key=lambda r: r["slot"])]
            weights = {c: (sum(x[c] for x in sums) / np.float32(n)).astype(np.float32) for c in weights}
    return weights


def score_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of docs.

    docs: doc_id long, text string; other columns don't matter. A null or empty text is its end token.
    A null doc_id counts as a training row. Without training tokens every word is unknown and the base
    is a uniform one over the end.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.withColumn("key", row_key(docs))
    spark = docs.sparkSession
    learning = docs.where(in_training())
    counts = stored(token_counts(learning.select("text")))
    v = learn_vocabulary(counts)
    vocabulary = spark.sparkContext.broadcast(v)
    weights = spark.sparkContext.broadcast(learn_network(learning.select("key", "text"), vocabulary))
    schema = "doc_id long, key long, n_tokens long, n_known long, base double, score double, rare array<long>"

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, w = vocabulary.value, weights.value
        base_of_unknown = np.log10(v.tokens + v.types + 1)
        share_of_tail = np.log10(v.tail_tokens + v.tail_types + 1)

        def out(held: list) -> pa.RecordBatch:
            token, count, keys, n = (np.concatenate([x[k] for x in held]) for k in (1, 2, 3, 4))
            first = np.r_[0, np.cumsum(n)]
            doc = np.repeat(np.arange(len(n)), n)
            total = log_probability(w, v.shape, token, first) / np.log(10)
            add = lambda values: np.bincount(doc, weights=values, minlength=len(n))
            here = count >= 0
            logc = np.log10(np.maximum(count, 0) + 1.0)
            tail = token >= v.shape.head
            total += add(np.where(tail, logc - share_of_tail[np.where(tail, token - v.shape.head, 0)], 0))
            rare = ~here
            rows = pa.LargeListArray.from_arrays(np.r_[0, np.cumsum(np.bincount(doc[rare], minlength=len(n)))], keys[rare])
            return pa.RecordBatch.from_arrays(
                [pa.concat_arrays([x[0].column(0) for x in held]), pa.concat_arrays([x[0].column(2) for x in held]), pa.array(n), pa.array(add(here & (count > 0)).astype(np.int64)),
                 pa.array(add(logc) - n * base_of_unknown), pa.array(total), rows.cast(pa.list_(pa.int64()))],
                names=["doc_id", "key", "n_tokens", "n_known", "base", "score", "rare"],
            )

        # long texts wait for each other, so that a few of them don't keep many short ones' lanes idle
        held, size = {False: [], True: []}, {False: 0, True: 0}
        for rows, words in words_of(batches, lower=True):
            token, first, count, keys = v.tokens_of(words)
            n = np.diff(first)
            for long in (False, True):
                own = (n > LONG_TEXT) == long
                if own.any():
                    of = np.repeat(own, n)
                    held[long].append((rows.filter(pa.array(own)), token[of], count[of], keys[of], n[own]))
                    size[long] += int(n[own].sum())
                    if size[long] >= CHUNK_TOKENS:
                        yield out(held[long])
                        held[long], size[long] = [], 0
        for some in held.values():
            if some:
                yield out(some)

    scored = stored(docs.select("doc_id", "text", "key").mapInArrow(score, schema))
    rare = scored.select("key", F.explode("rare").alias("token")).groupBy("token", "key").agg(F.count(F.lit(1)).alias("n"))
    rare = rare.join(counts.select(F.col("key").alias("token"), "c"), "token").groupBy("key").agg(F.sum("n").alias("known"), F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("more"))
    rows = scored.drop("rare").join(rare, "key", "left")
    more = F.coalesce("more", F.lit(0.0))
    return rows.select(
        "doc_id", (~in_training()).alias("held_out"), "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(v.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + more).alias("base_score"), (F.col("score") + more).alias("score"),
    )
