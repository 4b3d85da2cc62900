"""Quality rules: counts of a text's words, signs and repeats, and lines that many documents of a host share.

Each text is read once. What is kept of it is a row with its counts and, for every line with a word, a
128-bit hash of the normalised line and of the host, and the line's number of words. Lines that stand in
more than LIMIT different texts of their host go; a document of which too little is left is rejected.

Rows of one text count as one document, so copies alone make no line common. Distinct (line, text) pairs
are dealt by both, and lines counted in tasks before they are dealt by line.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, Words, pieces, stored

#: A line of more different texts of a host goes.
LIMIT = 10
#: What has to be left of a document: words, and percent of its words. A short text of its own beside a long shared passage stays.
LEAST_WORDS = 5
LEAST_PERCENT = 20
#: Words that a text has at least.
FEWEST_WORDS = 20
#: Words of a window that counts as a repeat, and the percent of words in such windows that a text may have.
REPEAT = 8
MOST_REPEATS = 30

SYMBOL = np.zeros(256, bool)
SYMBOL[np.frombuffer(b"#*$%&|<>", np.uint8)] = True
#: A byte that isn't a later one of a code point.
POINT = (np.arange(256) & 0xC0) != 0x80
#: Lines are alike if their words are, in lower case; numbers count, as lines of clean tables may differ in these alone.
NORMAL = bytes(x + 32 if 65 <= x < 91 else x for x in range(256))

LINES = "array<struct<high:long,low:long,words:int,line:int>>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated_words(words: Words, size: int) -> np.ndarray:
    """For each text, its words in windows of `size` words that stand in it twice or more."""
    count, n = np.diff(words.first), len(words.hashes)
    covered = np.zeros(n + 1, np.int32)
    grams = words.grams(size)
    if len(grams):
        text = np.repeat(np.arange(len(count)), count)[: len(grams)]
        at = np.flatnonzero(np.arange(len(grams)) + size <= words.first[1:][text])
        order = at[np.lexsort((grams[at], text[at]))]
        same = (grams[order][1:] == grams[order][:-1]) & (text[order][1:] == text[order][:-1])
        again = order[np.r_[False, same] | np.r_[same, False]] if len(order) else order
        np.add.at(covered, again, 1)
        np.add.at(covered, again + size, -1)
    total = np.r_[0, np.cumsum(np.cumsum(covered)[:n] > 0)]
    return np.diff(total[words.first])


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("high", pa.int64()), ("low", pa.int64()), ("words", pa.int32()), ("line", pa.int32())]))
    for batch in batches:
        for rows, data, offsets in pieces(batch):
            words = Words(data, offsets)
            per_text = lambda marks: np.diff(np.r_[0, np.cumsum(marks)][offsets])  # noqa: B023, E731
            hosts = rows.column(rows.schema.get_field_index("host")).to_pylist()
            raw = data.tobytes()
            repeats, lines, texts = [], [], []
            for k, host in enumerate(hosts):
                text = raw[offsets[k] : offsets[k + 1]]
                seed = 1 if host is None else xxhash.xxh64_intdigest(host.encode(), 2)
                seen, again, mine = set(), 0, []
                for number, line in enumerate(text.split(b"\n")):
                    tokens = line.translate(NORMAL).split()
                    if not tokens:
                        continue
                    if line in seen:
                        again += 1
                    seen.add(line)
                    h = xxhash.xxh3_128_intdigest(b" ".join(tokens), seed)
                    mine.append((_long(h >> 64), _long(h & 0xFFFFFFFFFFFFFFFF), len(tokens), number))
                repeats.append(again)
                lines.append(mine)
                texts.append(_long(xxhash.xxh3_64_intdigest(text)))
            high, low, size, number = (np.array(x) for x in zip(*(y for x in lines for y in x))) if any(lines) else (np.empty(0, np.int64),) * 4
            every = pa.StructArray.from_arrays([pa.array(high, pa.int64()), pa.array(low, pa.int64()), pa.array(size, pa.int32()), pa.array(number, pa.int32())], fields=list(kind.value_type))
            yield pa.RecordBatch.from_arrays(
                [
                    *(rows.column(rows.schema.get_field_index(c)) for c in ("doc_id", "key")),
                    *(pa.array(np.asarray(x), pa.int64()) for x in (np.diff(words.first), per_text(POINT[data] & ~SPACE[data]), per_text(SYMBOL[data]), repeats, repeated_words(words, REPEAT), texts)),
                    pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, lines)]), pa.int32()), every),
                ],
                names=["doc_id", "key", *COUNTS, "content", "lines"],
            )


def _long(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def row_of(host: str):
    """One long for rows of the same doc_id, host and text."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.col(host).cast("string"), F.col("text").cast("string"))


def described(docs: DataFrame, host: str = "source") -> DataFrame:
    """(doc_id, key, the five counts, content, lines) for every row of docs, written once."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(host).cast("string").alias("host"), F.col("text").cast("string").alias("text"), row_of(host).alias("key"))
    schema = f"doc_id long, key long, {', '.join(f'{c} long' for c in COUNTS)}, content long, lines {LINES}"
    return stored(rows.mapInArrow(_described, schema))


def common_lines(rows: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(high, low, texts): lines of more than `limit` different texts of their host; rows of `described`."""
    every = rows.select("content", F.explode("lines").alias("x")).select("x.high", "x.low", "content").distinct()
    return every.groupBy("high", "low").agg(F.count(F.lit(1)).alias("texts")).where(F.col("texts") > limit)


def judged(docs: DataFrame, host: str = "source", limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_lines, n_lines_removed, n_words_left, key, removed) for every row of docs.

    docs: doc_id, text and the host's column; others don't matter. A null text has no words and fails, as
    an empty one does; rows without host are a host of their own. Rows that repeat doc_id, host and text
    each have their row. removed: the numbers, from 0, of the lines that go. A document is rejected if it
    fails the counts, or if fewer than LEAST_WORDS words or LEAST_PERCENT percent of them are left.
    """
    rows = described(docs, host)
    common = stored(common_lines(rows, limit)).select("high", "low")
    lines = rows.dropDuplicates(["doc_id", "key"]).select("doc_id", "key", F.explode("lines").alias("x")).select("doc_id", "key", "x.high", "x.low", "x.words", "x.line")
    gone = lines.join(common, ["high", "low"]).groupBy("doc_id", "key").agg(F.sum("words").alias("_gone"), F.array_sort(F.collect_list("line")).alias("_removed"))
    base = (F.col("n_words") < FEWEST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATS * F.col("n_words"))
    met = rows.join(gone.withColumnRenamed("doc_id", "_id").withColumnRenamed("key", "_key"), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key")), "left")
    left = F.col("n_words") - F.coalesce("_gone", F.lit(0))
    enough = (left >= LEAST_WORDS) & (100 * left >= LEAST_PERCENT * F.col("n_words"))
    removed = F.coalesce("_removed", F.array().cast("array<int>"))
    return met.select("doc_id", *COUNTS, base.alias("base_failed"), (~base & enough).alias("kept"), F.size("lines").cast("long").alias("n_lines"), F.size(removed).cast("long").alias("n_lines_removed"), left.alias("n_words_left"), "key", removed.alias("removed"))


def cleaned(docs: DataFrame, host: str = "source", limit: int = LIMIT) -> DataFrame:
    """The rows of docs that are kept, all columns, their text without the common lines of its host; a text that loses none stays as it is."""
    found = judged(docs, host, limit).where("kept").select("doc_id", "key", "removed").dropDuplicates(["doc_id", "key"])
    mine = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), row_of(host).alias("key"))
    met = mine.join(found.withColumnRenamed("doc_id", "_id"), "key").where(F.col("doc_id").eqNullSafe(F.col("_id")))
    lines = F.split(F.col("row.text").cast("string"), "\n", -1)
    text = F.when(F.size("removed") == 0, F.col("row.text")).otherwise(F.array_join(F.filter(lines, lambda _, k: ~F.array_contains("removed", k)), "\n"))
    return met.select("row", text.alias("text")).select(*[F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])
