"""Benchmark decontamination: an inverted index of the test items, queried by every training passage.

Items are cut into units of at most 48 words, passages are 96 words from every 48th on, so that each
unit that stands in a text lies whole in a passage. A unit's score is BM25 with its own terms, divided
by what the unit itself would score. Retrieval is block-max WAND with a fixed threshold: units lie in
blocks by length; a block is opened only if the largest impacts in it, of the passage's terms, can
reach the threshold, and what is not essential (the common terms that alone cannot reach it) is looked
up only then. All units at the threshold are retrieved; there is no top k. Unit counts, document
frequencies and the mean length are those of all items, added up by Spark, however many indexes there are. A retrieved item counts if
enough word triples of its question and of its answer stand around the passage.

Words are lower-cased and without ASCII signs. The work is done for many passages at a time on arrays.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PLAIN, U64, Words, longs, signed, stored, unique_counts, words_of, words_of_texts

UNIT = 48
BLOCK = 8
SCORE = 0.5
QUESTION = 0.6
ANSWER = 0.5
#: Items of one index; more items make more indexes, each of bounded size, and as many passes over the texts.
INDEX_ITEMS = 20_000
K1, B = 1.2, 0.75

ANSWER_MARK = re.compile(r"\n\s*(?:answer|a)\s*:", re.I)
LAST_SENTENCE = re.compile(r"(?<=[.!?])\s+(?=\S[^.!?]*[.!?]?\s*\Z)")


def question_and_answer(text: str) -> tuple[str, str]:
    """An item's parts: before and after `Answer:` or `A:` at a line's begin, else all but the last sentence and that one."""
    if mark := ANSWER_MARK.search(text):
        return text[: mark.start()], text[mark.end() :]
    if cut := LAST_SENTENCE.search(text):
        return text[: cut.start()], text[cut.end() :]
    return text, ""


def triples(words: Words, k: int) -> np.ndarray:
    """Distinct hashes of a text's word triples; of its words, if fewer than three."""
    a, b = int(words.first[k]), int(words.first[k + 1])
    return np.unique(words.grams(3)[a : b - 2]) if b - a >= 3 else np.unique(words.hashes[a:b])


@dataclass
class Index:
    """Terms, and compressed rows of their blocks and units.

    essential: for each term, whether it can belong to a unit's essential terms; of_block: rows (block,
    largest impact) of essential terms; of_unit: rows (unit, impact) of all terms. rest: for each block,
    the most that a unit's other terms can add.
    """

    terms: np.ndarray
    of_block: tuple[np.ndarray, np.ndarray, np.ndarray]
    of_unit: tuple[np.ndarray, np.ndarray, np.ndarray]
    rest: np.ndarray
    item: np.ndarray
    item_ids: list[int]
    lengths: np.ndarray
    questions: list[np.ndarray]
    answers: list[np.ndarray]
    score: float = SCORE

    def retrieve(self, hashes: np.ndarray, passage: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(passage, unit, score) at the threshold; hashes of words and the passages they lie in."""
        none = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        if not len(self.terms) or not len(hashes):
            return none
        term = np.minimum(np.searchsorted(self.terms, hashes), len(self.terms) - 1)
        known = self.terms[term] == hashes
        pairs = np.unique(passage[known] * len(self.terms) + term[known])
        if not len(pairs):
            return none
        passage, term = np.divmod(pairs, len(self.terms))
        blocks = len(self.rest)
        _, key, most = self._sums(passage, term, self.of_block, blocks)
        key = key[most + self.rest[key % blocks] >= self.score - 1e-6]
        if not len(key):
            return none
        opened = np.isin(passage, key // blocks)
        passage, term = passage[opened], term[opened]
        row, unit, impact = self._rows(term, self.of_unit)
        passage = passage[row]
        kept = np.isin(passage * blocks + unit // BLOCK, key)
        key, score = self._add(passage[kept] * len(self.item) + unit[kept], impact[kept])
        kept = score >= self.score - 1e-6
        return *np.divmod(key[kept], len(self.item)), score[kept]

    @staticmethod
    def _rows(term: np.ndarray, table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        start, column, value = table
        n = start[term + 1] - start[term]
        row = np.repeat(np.arange(len(term)), n)
        at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + start[term][row]
        return row, column[at], value[at]

    @staticmethod
    def _add(key: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(key, kind="stable")
        key = key[order]
        at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)
        return key[at], np.add.reduceat(value[order], at) if len(at) else np.empty(0)

    def _sums(self, passage, term, table, width):
        row, column, value = self._rows(term, table)
        return row, *self._add(passage[row] * width + column, value)


@dataclass
class Statistics:
    """Of all items: number of units, their mean length, and how many units hold each of the ascending terms."""

    units: int
    mean: float
    terms: np.ndarray
    df: np.ndarray


def units_of(words: Words, k: int) -> list[np.ndarray]:
    """A text's units: runs of at most UNIT words, about equally long."""
    own = words.hashes[words.first[k] : words.first[k + 1]]
    return [x for x in np.array_split(own, max(1, -(-len(own) // UNIT))) if len(x)]


def build_index(items: list[tuple[int, str]], score: float = SCORE, of_all: Statistics | None = None) -> Index:
    """An index of a bounded number of items; of_all: statistics of the items that these are some of, else they are all."""
    items = [(i, t) for i, t in items if t and i is not None]
    words = words_of_texts([t for _, t in items], table=PLAIN)
    units = []  # (words, item)
    for k in range(len(items)):
        units += [(x, k) for x in units_of(words, k)]
    units.sort(key=lambda u: (len(u[0]), u[1]))
    counts = [np.unique(x, return_counts=True) for x, _ in units]
    terms, df = np.unique(np.concatenate([t for t, _ in counts]), return_counts=True) if units else (np.empty(0, np.uint64), np.empty(0))
    mean = np.mean([len(x) for x, _ in units]) if units else 1.0
    if of_all is None:
        of_all = Statistics(len(units), float(mean), terms, df)
    df, mean = of_all.df[np.searchsorted(of_all.terms, terms)], of_all.mean
    idf = np.log(1 + (of_all.units - df + 0.5) / (df + 0.5))
    unit, term, impact, essential = [], [], [], []
    rest = np.zeros(-(-len(units) // BLOCK) or 1)
    for u, ((x, _), (t, tf)) in enumerate(zip(units, counts)):
        at = np.searchsorted(terms, t)
        own = idf[at] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(x) / mean))
        own = own / own.sum()
        order = np.argsort(own, kind="stable")
        light = np.cumsum(own[order]) <= score / 2  # these alone reach half the threshold at most
        is_light = np.zeros(len(own), bool)
        is_light[order[light]] = True
        rest[u // BLOCK] = max(rest[u // BLOCK], own[is_light].sum())
        unit.append(np.full(len(t), u))
        term.append(at)
        impact.append(own)
        essential.append(~is_light)
    unit, term, impact, essential = (np.concatenate(x) if units else np.empty(0, np.int64) for x in (unit, term, impact, essential))

    def rows(column: np.ndarray, keep: np.ndarray, width: int):
        key = term[keep] * width + column[keep]
        order = np.lexsort((impact[keep], key))
        key, value = key[order], impact[keep][order]
        last = np.r_[key[1:] != key[:-1], True] if len(key) else np.empty(0, bool)  # the largest of equal keys
        start = np.searchsorted(key[last] // width, np.arange(len(terms) + 1))
        return start, key[last] % width, value[last]

    everything = np.ones(len(unit), bool)
    parts = [question_and_answer(t) for _, t in items]
    q, a = (words_of_texts([p[k] for p in parts], table=PLAIN) for k in (0, 1))
    return Index(
        terms, rows(unit // BLOCK, essential.astype(bool), len(rest)), rows(unit, everything, max(1, len(units))), rest,
        np.array([k for _, k in units], np.int64), [i for i, _ in items], np.diff(words.first), [triples(q, k) for k in range(len(items))], [triples(a, k) for k in range(len(items))], score,
    )


def share(part: np.ndarray, of_text: np.ndarray) -> float:
    return float(np.isin(part, of_text, assume_unique=True).mean()) if len(part) else 1.0


def find_items(words: Words, index: Index, question: float = QUESTION, answer: float = ANSWER) -> list[tuple[int, int, float, float, float]]:
    """(text, item, score, question's share, answer's share) of items that stand in the texts, once for each text."""
    count = np.diff(words.first)
    doc = np.repeat(np.arange(len(count)), count)
    step = (np.arange(len(words.hashes)) - words.first[doc]) // UNIT  # a word lies in the passages of its step and the one before
    passages = np.maximum(-(-count // UNIT), 1)
    base = np.cumsum(passages) - passages
    own = base[doc] + step
    early = step > 0
    passage, unit, score = index.retrieve(np.concatenate([words.hashes, words.hashes[early]]), np.concatenate([own, own[early] - 1]))
    found: dict[tuple[int, int], tuple[float, float, float]] = {}
    for p, u, s in zip(passage.tolist(), unit.tolist(), score.tolist()):
        d, k = int(np.searchsorted(base, p, side="right")) - 1, int(index.item[u])
        margin = int(index.lengths[k]) + 4
        a = max(int(words.first[d]), int(words.first[d]) + (p - int(base[d])) * UNIT - margin)
        b = min(int(words.first[d + 1]), int(words.first[d]) + (p - int(base[d])) * UNIT + 2 * UNIT + margin)
        around = np.unique(np.concatenate([words.grams_of(a, b, 3), words.hashes[a:b]]))
        q, r = share(index.questions[k], around), share(index.answers[k], around)
        if q >= question and r >= answer and s > found.get((d, k), (0.0,))[0]:
            found[d, k] = (s, q, r)
    return [(d, k, *x) for (d, k), x in found.items()]


def _indexes(items: DataFrame, score: float) -> Iterator[Index]:
    """Indexes of at most INDEX_ITEMS items each: by slices of their ids' hash when there are more."""
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    slices = -(-items.count() // (INDEX_ITEMS * 3 // 4)) or 1
    items = items.withColumn("slice", F.pmod(F.xxhash64("item_id"), F.lit(slices)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(slice, term, units, words): units that hold a term; without a term, all units and their words."""
        for rows, words in words_of(batches, table=PLAIN):
            of_slice: dict[int, list[np.ndarray]] = {}
            for k, own in enumerate(longs(rows, "slice").tolist()):
                of_slice.setdefault(own, []).extend(units_of(words, k))
            for own, units in of_slice.items():
                terms, df = unique_counts(np.concatenate([np.unique(x) for x in units])) if units else (np.empty(0, U64), np.empty(0, np.int64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(terms) + 1, own)), pa.array([None, *signed(terms).tolist()], pa.int64()), pa.array(np.r_[len(units), df]), pa.array(np.r_[sum(map(len, units)), np.zeros(len(terms), np.int64)])],
                    names=["slice", "term", "units", "words"],
                )

    counts = items.select("text", "slice").mapInArrow(count, "slice long, term long, units long, words long")
    counts = stored(counts.groupBy("slice", "term").agg(F.sum("units").alias("units"), F.sum("words").alias("words")))
    total = counts.where("term is null").agg(F.coalesce(F.sum("units"), F.lit(0)).alias("units"), F.coalesce(F.sum("words"), F.lit(0)).alias("words")).first()
    df = counts.where("term is not null").groupBy("term").agg(F.sum("units").alias("df"))
    for k in range(slices):
        own = counts.where((F.col("slice") == k) & F.col("term").isNotNull()).select("term").join(df, "term").toArrow()
        terms = own.column("term").to_numpy().astype(np.int64).view(U64)
        order = np.argsort(terms)
        of_all = Statistics(total["units"], total["words"] / max(1, total["units"]), terms[order], own.column("df").to_numpy()[order])
        yield build_index([(r["item_id"], r["text"]) for r in items.where(F.col("slice") == k).orderBy("item_id", "text").collect()], score, of_all)


def contaminated(docs: DataFrame, items: DataFrame, score: float = SCORE, question: float = QUESTION, answer: float = ANSWER) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap) of every item found in every text.

    docs: doc_id long, text string; items: item_id, text. Null and empty texts hold nothing and are no
    items; an item that has no answer apart needs its question only; repeated rows count each on its own.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"
    out = None
    for index in _indexes(items, score):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch, words in words_of(batches, table=PLAIN):
                found = find_items(words, index, question, answer)
                ids = batch.column(0).to_pylist()
                columns = list(zip(*[(ids[d], index.item_ids[k], *x) for d, k, *x in found])) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 2 + [pa.float64()] * 3)], names=["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

        found = rows.mapInArrow(search, schema)
        out = found if out is None else out.union(found)
    return out


def without_items(docs: DataFrame, items: DataFrame, score: float = SCORE, question: float = QUESTION, answer: float = ANSWER) -> DataFrame:
    """The rows of docs, all columns, in whose text no item was found."""
    for index in _indexes(items, score):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def clean(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch, words in words_of(batches, table=PLAIN):
                keep = np.ones(batch.num_rows, bool)
                keep[[x[0] for x in find_items(words, shared.value, question, answer)]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs
