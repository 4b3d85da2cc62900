"""Substring dedup: words covered by a run of words that also starts elsewhere, by difference-cover anchors.

Two equal runs of 35 words at positions i and j hold, for some shift below 21, positions i + shift and
j + shift that both lie in the difference cover modulo 21. So only the 15 words from each cover position
on are hashed and shuffled, 5 positions of 21; equal runs always share such an anchor. What shares an
anchor is extended: the whole windows around it are hashed, twice over, and only windows whose words
really start elsewhere count.

Both shuffles combine equal hashes within a task first, so a passage that a third of all documents
hold sends a row per task, not a row per document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import longs, routed, row_key, sharing, signed, words_of

WINDOW = 35
#: A perfect difference set: every difference modulo 21 is one of two of its members.
PERIOD = 21
COVER = (0, 1, 4, 14, 16)
#: Bits of a window's second hash.
CHECK = 0xFFFF


def _anchors(window: int):
    """Hashes of the words from each cover position on, as far as a shift below the period leaves room."""
    width = window - PERIOD + 1
    covered = np.zeros(PERIOD, bool)
    covered[list(COVER)] = True

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for batch, words in words_of(batches):
            count = np.diff(words.first)
            keys = longs(batch, "key")
            doc = np.repeat(np.arange(len(count)), count)
            pos = np.arange(len(words.hashes)) - words.first[doc]
            keep = np.flatnonzero(covered[pos % PERIOD] & (pos + width <= count[doc]) & (count[doc] >= window))
            if len(keep):
                yield signed(words.grams(width)[keep]), pos[keep], keys[doc[keep]]

    return rows


def _windows(window: int):
    """Hashes of the whole windows around shared anchors."""
    width = window - PERIOD + 1

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for batch, words in words_of(batches):
            if len(words.hashes) < window:
                continue
            count = np.diff(words.first)
            owner, anchor = _positions(batch)
            start = np.zeros(len(words.hashes) + 1, np.int32)  # +1 where a run of window starts begins, -1 after its end
            low = words.first[owner] + np.maximum(anchor - (window - width), 0)
            high = words.first[owner] + np.minimum(anchor, count[owner] - window)
            np.add.at(start, low, 1)
            np.add.at(start, high + 1, -1)
            keep = np.flatnonzero(np.cumsum(start)[:-1] > 0)
            if len(keep):
                doc = np.searchsorted(words.first, keep, side="right") - 1
                check = (words.grams(window, seed=0x2545F4914F6CDD1D)[keep] & np.uint64(CHECK)).astype(np.int64)
                yield signed(words.grams(window)[keep]), (keep - words.first[doc]) << 16 | check, longs(batch, "key")[doc]

    return rows


def _shared(rows: DataFrame, make, shift: int = 0, mask: int = 0) -> DataFrame:
    """(key, at): positions whose hashes also stand elsewhere, each once for each text, however many rows have it."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in sharing(batches, mask):
            pos = (table.column("note").to_numpy() >> shift).astype(np.int32)
            yield from pa.table({"key": table.column("owner"), "pos": pos}).combine_chunks().to_batches()

    found = rows.mapInArrow(lambda b: routed(make(b), mask), "route long, note long, owner long")
    found = found.repartition("route").sortWithinPartitions("route").mapInArrow(places, "key long, pos int")
    return found.groupBy("key").agg(F.collect_set("pos").alias("at"))


def _positions(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The row and the position of all that column `at` lists; a null lists none."""
    at = batch.column(batch.schema.get_field_index("at"))
    row = np.repeat(np.arange(batch.num_rows), at.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    return row, at.flatten().to_numpy(zero_copy_only=False).astype(np.int64)


def _kept(window: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, words in words_of(batches):
            count = np.diff(words.first)
            owner, at = _positions(batch)
            lengths = np.bincount(owner, minlength=batch.num_rows)
            start = words.first[owner] + at
            change = np.zeros(len(words.hashes) + 1, np.int32)
            np.add.at(change, start, 1)
            np.add.at(change, start + window, -1)
            gone = np.cumsum(change)[:-1] > 0
            raw = words.data.tobytes()
            removed, digests, texts = [], [], []
            for k, (a, b) in enumerate(zip(words.first[:-1].tolist(), words.first[1:].tolist())):
                mine = raw[words.offsets[k] : words.offsets[k + 1]].split()
                if lengths[k]:
                    lost = gone[a:b]
                    mine = [w for w, x in zip(mine, lost.tolist()) if not x]
                    removed.append(int(lost.sum()))
                else:
                    removed.append(0)
                text = b" ".join(mine)
                texts.append(text)
                digests.append(hashlib.sha256(text).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(count), pa.array(removed, pa.int64()), pa.array(digests), pa.array(texts, pa.binary()).cast(pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"],
            )

    return rows


def dedup_substrings(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept) for every row of docs.

    docs: doc_id long, text string; other columns don't matter. Words are `[^\\x20\\x09-\\x0D]+`; a null
    text has none. Each word goes that is covered by a window of `window` words whose sequence also
    starts anywhere else, in the same text too; all occurrences go, the first one included. kept: the
    other words, joined by one space. Rows that repeat a doc_id are documents of their own.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.withColumn("key", row_key(docs))
    anchors = _shared(docs.select("key", "text"), _anchors(window))
    texts = docs.select("doc_id", "key", "text").repartition("key")
    near = texts.join(anchors, "key").select("doc_id", "key", "text", "at")
    repeats = _shared(near, _windows(window), shift=16, mask=CHECK)
    rows = texts.join(repeats, "key", "left").select("doc_id", "key", "text", "at")
    return rows.mapInArrow(_kept(window), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")
