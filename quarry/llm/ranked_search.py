"""Ranked lexical search: the documents that score highest for each item, by the Best Position Algorithm.

Texts are read once: of each, the occurrences of the items' terms are kept, in rows of about a megabyte of
text. Counts over all of these rows (N, L, df) fix weights and impacts. Then tasks take documents some
thousands at a time and lay out, for every term, a list of its documents by falling impact. An item reads
its terms' lists from the top. A document met for the first time is looked up in all the other lists at
once, which also marks its positions there as seen; a list's best position is the end of the seen positions
without a gap, so it is often far behind the last one read. No unseen document scores more than the
impacts after the best positions add up to; the search stops once this is strictly below the item's kth
score. The k best so far of a task's earlier documents count, so later ones stop early.

Items are searched for in groups whose bytes are bounded, as a group's terms are broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Words, pieces, stored, unique_counts, words_of_texts

TOP = 10
#: Bytes of items whose terms are searched for in one pass; a longer item has a pass of its own.
ITEM_BYTES = 4 << 20
#: Postings that a task lays out at a time; a document with more is laid out alone.
POSTINGS = 1 << 20
#: Positions read of each list at first; doubled in each round.
STEP = 16

#: A-Z as a-z, and spaces for what is in no term: ASCII but for letters and digits.
TERMS = np.arange(256, dtype=np.uint8)
TERMS[65:91] += 32
TERMS[[x for x in range(128) if not chr(x).isalnum()]] = 0x20


class Queries:
    """The terms of some items: sorted hashes, and for each item its terms' indexes with their repeats."""

    def __init__(self, rows: list[tuple[int, str | None]]):
        self.items = [r[0] for r in rows]
        words = words_of_texts([r[1] for r in rows], table=TERMS)
        self.terms = np.unique(words.hashes)
        at = np.searchsorted(self.terms, words.hashes)
        self.wanted = [unique_counts(at[a:b]) for a, b in zip(words.first[:-1], words.first[1:])]


# --------------------------------------------------------------------------- postings


def postings(docs: DataFrame, queries) -> DataFrame:
    """(ids, sizes, counts, terms, tfs, docs, length): for a run of texts their ids and lengths in terms, how many postings each has, and the postings; how many texts have terms, and their length together."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = queries.value.terms
        for batch in batches:
            for rows, data, offsets in pieces(batch):
                words = Words(data, offsets, table=TERMS)
                size = np.diff(words.first)
                at = np.minimum(np.searchsorted(known, words.hashes), max(len(known) - 1, 0))
                hit = np.flatnonzero(known[at] == words.hashes) if len(known) else np.empty(0, np.int64)
                text = np.searchsorted(words.first, hit, side="right") - 1
                key, tf = unique_counts(text * max(len(known), 1) + at[hit])
                text, term = np.divmod(key, max(len(known), 1))
                lists = ((rows.column(0).to_pylist(), pa.int64()), (size, pa.int64()), (np.bincount(text, minlength=len(size)), pa.int32()), (term, pa.int32()), (tf, pa.int64()))
                yield pa.RecordBatch.from_arrays([*(pa.array([x], pa.list_(kind)) for x, kind in lists), pa.array([int((size > 0).sum())], pa.int64()), pa.array([int(size.sum())], pa.int64())], names=["ids", "sizes", "counts", "terms", "tfs", "docs", "length"])

    return docs.mapInArrow(find, "ids array<long>, sizes array<long>, counts array<int>, terms array<int>, tfs array<long>, docs long, length long")


def document_frequencies(found: DataFrame, terms: int) -> np.ndarray:
    """For each term the documents that hold it: summed in tasks, then by term."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(terms, np.int64)
        for batch in batches:
            total += np.bincount(batch.column("terms").flatten().to_numpy(), minlength=terms)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"term": at, "df": total[at]})

    df = np.zeros(terms, np.int64)
    for row in found.select("terms").mapInArrow(count, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():  # as many as the broadcast terms at most
        df[row["term"]] = row["df"]
    return df


def weight(documents: int, df: int) -> int:
    return floor(1000 * log((2 * documents + 2) / (2 * df + 1)))


# --------------------------------------------------------------------------- the search


class Lists:
    """Impact lists of some documents: for every term its documents by falling impact."""

    def __init__(self, ids: list[int | None], sizes: np.ndarray, counts: np.ndarray, terms: np.ndarray, tfs: np.ndarray, terms_in_all: int, documents: int, length: int):
        self.ids, self.stride, n = ids, terms_in_all, len(sizes)
        m = 25 + (75 * sizes * documents) // length
        doc = np.repeat(np.arange(n), counts)
        impact = (1_000_000_000 * tfs) // (1000 * tfs + 8 * m[doc])
        order = np.lexsort((-impact, terms))
        self.doc, self.impact = doc[order], impact[order]
        self.begin = np.searchsorted(terms[order], np.arange(terms_in_all + 1))
        # direct access: postings by document and term, with their position among all lists
        self.key = doc * terms_in_all + terms  # ascending, as postings came by text and term
        self.at = np.empty(len(order), np.int64)
        self.at[order] = np.arange(len(order))
        self.new = np.ones(n, bool)

    def look_up(self, docs: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of all that these documents have in these terms' lists (the terms ascending), and whether they have it."""
        want = (docs[:, None] * self.stride + terms[None, :]).ravel()
        at = np.minimum(np.searchsorted(self.key, want), len(self.key) - 1)
        return self.at[at].reshape(len(docs), -1), (self.key[at] == want).reshape(len(docs), -1)

    def best(self, terms: np.ndarray, weights: np.ndarray, top: int, known: list[int]) -> tuple[np.ndarray, np.ndarray, int]:
        """(documents, scores) among which are all that reach the top, and how many positions were read.

        known: scores of documents elsewhere. A score that equals the kth may still win by its doc_id, so
        the search goes on until no unseen document can reach it.
        """
        has = self.begin[terms + 1] > self.begin[terms]
        terms, weights = terms[has], weights[has]
        start, end = self.begin[terms], self.begin[terms + 1]
        seen = [np.zeros(b - a, bool) for a, b in zip(start, end)]
        best, read, step, positions = start.copy(), start.copy(), STEP, 0
        docs, scores, top_scores = [], [], sorted(known, reverse=True)[:top]
        while len(terms):
            inside = best < end
            bound = int((weights[inside] * self.impact[best[inside]]).sum())
            if bound <= 0 or (len(top_scores) == top and bound < top_scores[-1]):
                break
            runs = [self.doc[a : min(a + step, b)] for a, b in zip(read, end)]
            positions += sum(map(len, runs))
            read = np.minimum(read + step, end)
            met = np.unique(np.concatenate(runs))
            met = met[self.new[met]]
            if len(met):
                self.new[met] = False
                at, there = self.look_up(met, terms)
                score = (np.where(there, self.impact[at], 0) * weights).sum(axis=1)
                for k in range(len(terms)):
                    seen[k][at[there[:, k], k] - start[k]] = True
                docs.append(met)
                scores.append(score)
                top_scores = sorted([*top_scores, *np.sort(score)[-top:].tolist()], reverse=True)[:top]
            for k in range(len(terms)):
                left = seen[k][best[k] - start[k] :]
                if len(left) and left[0]:
                    gap = int(left.argmin())
                    best[k] += gap if not left[gap] else len(left)
            step *= 2
        if not docs:
            return np.empty(0, np.int64), np.empty(0, np.int64), positions
        docs, scores = np.concatenate(docs), np.concatenate(scores)
        self.new[docs] = True
        keep = np.flatnonzero(scores > 0)
        if len(keep) > top:
            keep = keep[scores[keep] >= np.partition(scores[keep], -top)[-top]]
        return docs[keep], scores[keep], positions


def _searched(found: DataFrame, queries, statistics, top: int) -> DataFrame:
    """(item, doc_id, score): the best of every task's documents."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, terms = queries.value.wanted, len(queries.value.terms)
        weights, documents, length = statistics.value
        best: list[list[tuple[int, bool, int]]] = [[] for _ in wanted]  # the largest first: score, then ids ascending, null first
        for ids, sizes, counts, term, tf in _gathered(batches):
            lists = Lists(ids, sizes, counts, term, tf, terms, documents, length)
            for k, (of, times) in enumerate(wanted):
                docs, scores, _ = lists.best(of, weights[of] * times, top, [x[0] for x in best[k]])
                if len(docs):
                    mine = [(s, ids[d] is None, -(ids[d] or 0)) for d, s in zip(docs.tolist(), scores.tolist())]
                    best[k] = sorted([*best[k], *mine], reverse=True)[:top]
        rows = [(queries.value.items[k], None if none else -x, s) for k, mine in enumerate(best) for s, none, x in mine]
        for k in range(0, len(rows), 1 << 16):
            item, doc_id, score = zip(*rows[k : k + (1 << 16)])
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.array(doc_id, pa.int64()), pa.array(score, pa.int64())], names=["item", "doc_id", "score"])

    return found.select("ids", "sizes", "counts", "terms", "tfs").mapInArrow(search, "item long, doc_id long, score long")


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows of `postings` put together up to POSTINGS, without texts that hold none of the terms."""
    held, n = [], 0

    def joined() -> tuple:
        ids, (sizes, counts, terms, tfs) = [x for h in held for x in h[0]], (np.concatenate(x) for x in list(zip(*held))[1:])
        return ids, sizes, counts, terms, tfs

    for batch in batches:
        for k in range(batch.num_rows):
            ids, sizes, counts, terms, tfs = (batch.column(c)[k].values for c in ("ids", "sizes", "counts", "terms", "tfs"))
            counts = counts.to_numpy().astype(np.int64)
            keep = np.flatnonzero(counts)
            if len(keep):
                held.append((ids.take(pa.array(keep)).to_pylist(), sizes.to_numpy()[keep], counts[keep], terms.to_numpy().astype(np.int64), tfs.to_numpy()))
                n += len(terms)
            if n >= POSTINGS:
                yield joined()
                held, n = [], 0
    if held:
        yield joined()


def _item_groups(items: DataFrame, most: int) -> list[DataFrame]:
    """items (item, text) in groups of no more bytes than `most`, or of one item."""
    sized = items.withColumn("bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
    groups = 1
    while True:
        group = F.pmod(F.xxhash64("item"), F.lit(groups))
        over = sized.groupBy(group.alias("g")).agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("n")).where((F.col("bytes") > most) & (F.col("n") > 1))
        if over.isEmpty():
            return [items.where(group == g) for g in range(groups)]
        groups *= 2


def best_documents(docs: DataFrame, items: DataFrame, top: int = TOP, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): for each row of items the `top` documents with the highest scores above 0.

    docs: doc_id, text; items: item_id, text; other columns don't matter. Null and termless texts match
    nothing and have no part in N. Equal scores go by ascending doc_id, null first; rows that repeat a
    doc_id are documents of their own. Every row of items is searched for, also one without item_id or
    with another's. An item without a match has no rows. Score as the module's contract has it: weights
    floor(1000 ln((2N+2)/(2df+1))), impacts and lengths in 64-bit integers.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    items = stored(items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).withColumn("item", F.monotonically_increasing_id()))
    rows: DataFrame | None = None
    for group in _item_groups(items, item_bytes):
        wanted = Queries([(r["item"], r["text"]) for r in group.select("item", "text").collect()])  # bounded by item_bytes
        queries = spark.sparkContext.broadcast(wanted)
        found = stored(postings(texts, queries))
        total = found.agg(F.sum("docs").alias("docs"), F.sum("length").alias("length")).first()
        documents, length = total["docs"] or 0, total["length"] or 0
        df = document_frequencies(found, len(wanted.terms))
        weights = np.array([weight(documents, x) for x in df.tolist()], np.int64)
        mine = _searched(found, queries, spark.sparkContext.broadcast((weights, documents, max(length, 1))), top)
        rows = mine if rows is None else rows.unionByName(mine)
    best = _ranked(stored(rows), top).join(items.select("item", "item_id"), "item")
    return best.select("item_id", "rank", "doc_id", "score")


def _ranked(rows: DataFrame, top: int) -> DataFrame:
    """The top of each item: first within slices of its rows, so that no task gets all that tasks found for an item."""
    order = [F.desc("score"), F.asc_nulls_first("doc_id")]
    slices = rows.withColumn("slice", F.pmod(F.xxhash64("doc_id"), F.lit(64)))
    first = slices.withColumn("rank", F.row_number().over(Window.partitionBy("item", "slice").orderBy(*order))).where(F.col("rank") <= top).drop("slice", "rank")
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= top)
