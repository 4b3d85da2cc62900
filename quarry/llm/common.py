"""What the training-data operators share: shared folders, vectorised word hashing, components.

Texts travel to Python as Arrow batches and are cut into pieces of about a megabyte, so that
the memory of a task depends on the longest document and never on the size of a partition.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that are hashed at a time.
PIECE = 1 << 20

U64 = np.uint64


# --------------------------------------------------------------------------- shared folders


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; only where that is unset (tests) a local one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = "file://" + tempfile.mkdtemp(prefix="quarry-")
        spark.conf.set("spark.checkpoint.dir", base)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base)
    return f"{base}/quarry-{uuid.uuid4().hex}"


def stored(df: DataFrame, **options: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.options(**{"compression": "zstd", **options}).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """One long for a row: tells repeated doc_ids with different texts apart."""
    return F.xxhash64(F.col(doc_id), F.col(text))


def row_key(docs: DataFrame) -> Column:
    """doc_id itself where no row lacks it and none repeats it, else text_key(); reads that column only."""
    ids = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    return text_key() if ids.where("doc_id is null or n > 1").limit(1).count() else F.coalesce(F.col("doc_id"), F.lit(0))  # never null, which spares joins a filter and lets them share an exchange


# --------------------------------------------------------------------------- words of many texts

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Lower case, with ASCII signs as spaces: for words without their punctuation.
PLAIN = LOWER.copy()
PLAIN[[x for x in range(33, 127) if not chr(x).isalnum()]] = 0x20

_rng = np.random.default_rng(20240229)
#: A random value for each byte, and an odd base with its inverse modulo 2**64.
BYTE_VALUE = _rng.integers(1, 1 << 63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)
BASE = U64(0x9E3779B97F4A7C15)
BASE_INVERSE = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of BASE and of its inverse."""
    if "up" not in _powers or len(_powers["up"]) < n:
        n = max(n, PIECE * 2)
        with np.errstate(over="ignore"):
            for name, base in (("up", BASE), ("down", BASE_INVERSE)):
                x = np.full(n, base, U64)
                x[0] = 1
                _powers[name] = np.multiply.accumulate(x)
    return _powers["up"], _powers["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on unsigned longs."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> U64(33))
        x = x * U64(0xFF51AFD7ED558CCD)
        x = x ^ (x >> U64(33))
        x = x * U64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> U64(33))


class Words:
    """The words `[^\\x20\\x09-\\x0D]+` of consecutive texts.

    starts, ends: byte positions in data; first: index of each text's first word, with the
    total at the end; hashes: a 64-bit hash of each word.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False, table: np.ndarray | None = None):
        self.data, self.offsets = data, offsets
        table = LOWER if lower else table
        folded = data if table is None else table[data]
        space = SPACE[folded]
        word = ~space
        begins = word.copy()
        begins[1:] &= space[:-1]
        finishes = word.copy()
        finishes[:-1] &= space[1:]
        if len(data):
            edges = offsets[(offsets > 0) & (offsets < len(data))]
            begins[edges] = word[edges]
            finishes[edges - 1] = word[edges - 1]
        self.starts, self.ends = np.flatnonzero(begins), np.flatnonzero(finishes) + 1
        self.first = np.searchsorted(self.starts, offsets)
        up, down = powers(len(data) + 1)
        with np.errstate(over="ignore"):
            sums = np.empty(len(data) + 1, U64)
            sums[0] = 0
            np.cumsum(BYTE_VALUE[folded] * up[: len(data)], out=sums[1:])
            self.hashes = mix((sums[self.ends] - sums[self.starts]) * down[self.starts] + (self.ends - self.starts).astype(U64))

    def grams(self, n: int, seed: int = 0) -> np.ndarray:
        """A hash of the n words from each word on; only those within one text mean anything."""
        if len(self.hashes) < n:
            return np.empty(0, U64)
        up, down = powers(len(self.hashes) + 1)
        with np.errstate(over="ignore"):
            values = mix(self.hashes + U64(seed)) if seed else self.hashes
            sums = np.empty(len(values) + 1, U64)
            sums[0] = 0
            np.cumsum(values * up[: len(values)], out=sums[1:])
            return mix((sums[n:] - sums[:-n]) * down[: len(values) - n + 1] + U64(n))

    def grams_of(self, a: int, b: int, n: int) -> np.ndarray:
        """grams() of the words from a to b."""
        if not hasattr(self, "_grams"):
            self._grams: dict[int, np.ndarray] = {}
        if n not in self._grams:
            self._grams[n] = self.grams(n)
        return self._grams[n][a : max(a, b - n + 1)]


def pieces(batch: pa.RecordBatch, column: str = "text", size: int = PIECE) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of a batch with their texts' bytes and offsets; a null text is empty."""
    if not batch.num_rows:
        return
    text = batch.column(batch.schema.get_field_index(column))
    if text.null_count:
        text = text.fill_null("")
    text = text.cast(pa.large_string())
    _, at, data = text.buffers()
    at = np.frombuffer(at, np.int64)[text.offset : text.offset + len(text) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    row = 0
    while row < len(text):
        to = max(row + 1, int(np.searchsorted(at, at[row] + size, side="right")) - 1)
        yield batch.slice(row, to - row), data[at[row] : at[to]], at[row : to + 1] - at[row]
        row = to


def words_of(batches: Iterator[pa.RecordBatch], lower: bool = False, column: str = "text", table: np.ndarray | None = None) -> Iterator[tuple[pa.RecordBatch, Words]]:
    for batch in batches:
        for rows, data, offsets in pieces(batch, column):
            yield rows, Words(data, offsets, lower, table)


def words_of_texts(texts: list[str | None], **how) -> Words:
    raw = [(x or "").encode() for x in texts]
    return Words(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]), **how)


def longs(rows: pa.RecordBatch, name: str) -> np.ndarray:
    return rows.column(rows.schema.get_field_index(name)).to_numpy(zero_copy_only=False)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def unique_counts(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values and their counts; faster than numpy's own for long arrays."""
    x = np.sort(x)
    at = np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else np.empty(0, np.int64)
    return x[at], np.diff(np.r_[at, len(x)])


# --------------------------------------------------------------------------- rows that share a key


# A row is (hash, note, owner): longs, a note below 2**60. Two rows are equal by their hashes and by
# the bits of their notes that `mask` names. On the way the note's two lowest bits say what is known:
# 0 the key's first row in its task, 1 the first of several there, 2 one of those others.


def _order(hashes: np.ndarray, notes: np.ndarray, mask: int) -> tuple[np.ndarray, np.ndarray]:
    """An order that brings equal rows together, and where in it each key begins."""
    marks = notes & mask if mask else None
    order = np.lexsort((marks, hashes)) if mask else np.argsort(hashes, kind="stable")
    begins = np.zeros(len(order), bool)
    begins[:1] = True
    for x in (hashes,) if marks is None else (hashes, marks):
        x = x[order]
        begins[1:] |= x[1:] != x[:-1]
    return order, begins


def routed(chunks: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], mask: int = 0, keep_hash: bool = False, flush: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """(route, note, owner[, hash]): rows combined before a shuffle, so that no key sends more than one row a flush to its task.

    A key's first row is routed by its hash; the others, known to share their key, are routed by chance
    and, where asked for, carry their hash.
    """
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    n = 0
    for chunk in chunks:
        held.append(chunk)
        n += len(chunk[0])
        if n >= flush:
            yield from _combined(held, mask, keep_hash)
            held, n = [], 0
    if n:
        yield from _combined(held, mask, keep_hash)


def _combined(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]], mask: int, keep_hash: bool) -> Iterator[pa.RecordBatch]:
    hashes, notes, owners = (np.concatenate(x) for x in zip(*held))
    order, begins = _order(hashes, notes, mask)
    known = np.empty(len(order), np.int64)
    known[order] = np.where(begins, np.where(np.r_[begins[1:], True], 0, 1), 2)
    others = np.flatnonzero(known == 2)
    route = hashes.copy()
    with np.errstate(over="ignore"):
        route[others] = signed(mix(route[others].view(U64) + others.astype(U64) + U64(1)))
    columns = {"route": route, "note": notes << 2 | known, "owner": owners}
    for at in range(0, len(order), 1 << 16):
        some = {c: pa.array(x[at : at + (1 << 16)]) for c, x in columns.items()}
        if keep_hash:
            some["hash"] = pa.array(hashes[at : at + (1 << 16)], mask=known[at : at + (1 << 16)] != 2)
        yield pa.RecordBatch.from_pydict(some)


def sharing(batches: Iterator[pa.RecordBatch], mask: int = 0, owners: bool = False) -> Iterator[pa.Table]:
    """From rows of `routed`, sorted by route: those whose key has several rows, or with `owners` several owners, each then once.

    Holds one route's rows at most beside a batch.
    """
    kept: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if kept is not None:
            table = pa.concat_tables([kept, table])
        route = table.column("route").to_numpy()
        if not len(route):
            continue
        last = int(np.searchsorted(route, route[-1]))
        kept = table.slice(last)
        if last:
            yield _shared(table.slice(0, last), mask, owners)
    if kept is not None:
        yield _shared(kept, mask, owners)


def _shared(table: pa.Table, mask: int, owners: bool) -> pa.Table:
    notes = table.column("note").to_numpy()
    known = notes & 3
    if owners:  # of first rows that repeat both key and owner, the one that knows of most stays
        order = np.lexsort((known != 1, table.column("owner").to_numpy(), table.column("route").to_numpy()))
        route, owner = table.column("route").to_numpy()[order], table.column("owner").to_numpy()[order]
        again = np.r_[False, (route[1:] == route[:-1]) & (owner[1:] == owner[:-1])] & (known[order] != 2)
        table = table.take(pa.array(order[~again]))
        notes = table.column("note").to_numpy()
        known = notes & 3
    firsts = np.flatnonzero(known != 2)
    order, begins = _order(table.column("route").to_numpy()[firsts], notes[firsts] >> 2, mask)
    group = np.cumsum(begins) - 1
    several = (np.bincount(group) > 1) | (np.bincount(group, weights=known[firsts][order] == 1) > 0) if len(firsts) else np.empty(0, bool)
    keep = known == 2
    keep[firsts[order]] = several[group]
    return table.set_column(table.schema.get_field_index("note"), "note", pa.array(notes >> 2)).filter(pa.array(keep))


# --------------------------------------------------------------------------- connected components


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): a member of each component of undirected edges; only nodes with edges.

    In each round a node goes over to its smallest neighbour, and edges between the nodes that are left
    make the next round's smaller graph; a star, as copies of one text make it, is gone after one round.
    Long paths need few rounds if names are in no order along them, as hashes are. Each round is a
    reliable checkpoint.
    """
    shared_dir(edges.sparkSession)
    left = edges.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).where("u < v").distinct().checkpoint()
    rounds: list[DataFrame] = []
    while True:
        both = left.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.u", "e.v")
        to = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("to")).checkpoint()
        rounds.append(to)
        left = left.join(to, "u").select(F.col("to").alias("x"), "v").join(to.withColumnRenamed("u", "v"), "v").select(F.least("x", "to").alias("u"), F.greatest("x", "to").alias("v"))
        left = left.where("u < v").distinct().checkpoint()
        if left.isEmpty():
            break
    found = rounds.pop()
    for to in reversed(rounds):
        later = found.select(F.col("u").alias("to"), F.col("to").alias("last"))
        found = to.join(later, "to", "left").select("u", F.coalesce("last", "to").alias("to"))
    return found.select(F.col("u").alias("node"), F.col("to").alias("component"))
