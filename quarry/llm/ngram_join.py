"""N-gram Jaccard join: documents whose word-shingle sets overlap, by rare-first prefix filtering.

Steps, all of them Spark jobs:

1. Every document's set of distinct shingles gets a 64-bit name; equal sets are one node.
2. Shingles are ordered rarest first by a counting sketch of fixed size, then by hash. Any total
   order is right; rare first keeps common shingles out of the prefixes.
3. A set of n shingles puts its first n - ceil(t n) + 1 into an index; two sets at or above t share
   one of them. Shingles that only one set puts there are dropped (before the shuffle, rows of one
   shingle are combined within a task, so that a common one sends no more than one row per task).
4. Round one verifies each node against the leaders, by shingle and length band, with which it shares
   most, and finds connected components. Round two takes all other pairs that share an indexed shingle
   and aren't in one component yet, after the length, pair-prefix, positional and suffix filters. No
   link between two components is lost, and no group is expanded into all its pairs.

Verification compares whole sets, once for each pair.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import U64, components, longs, mix, routed, sharing, signed, stored, text_key, words_of

SHINGLE = 5
PERCENT = 80
#: Counters of the order's sketch: four for a document, within these bounds; of the set filter, always as many.
SKETCH_BITS = (20, 24)
FILTER_BITS = 23
#: Longs of the short parities that go along with index rows; pairs are held against the long ones afterwards.
SHORT_PARTS = 8
#: Leaders that a node is verified against in round one, those of the most common shingles first.
LEADERS = 5


def shingle_sets(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """The sorted distinct shingle hashes of each text; fewer words than a shingle has make one shingle."""
    for rows, words in words_of(batches, lower=True):
        grams, sets = words.grams(size), []
        for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
            if b - a >= size:
                x = np.sort(grams[a : b - size + 1])
                sets.append(x[np.r_[True, x[1:] != x[:-1]]])
            elif b > a:
                with np.errstate(over="ignore"):
                    x = words.hashes[a:b] * np.arange(3, 2 * (b - a) + 3, 2, dtype=U64)
                    sets.append(mix(np.array([x.sum(dtype=U64) + U64(b - a)], U64)))
            else:
                sets.append(np.empty(0, U64))
        yield rows, sets


def set_name(x: np.ndarray) -> int:
    """A 64-bit name of a set: the mixed sum of its members' mixed hashes."""
    with np.errstate(over="ignore"):
        return int(signed(mix(np.array([mix(x + U64(0x5851F42D4C957F2D)).sum(dtype=U64) + U64(len(x))], U64)))[0])


def parities_of(x: np.ndarray) -> bytes:
    """For each range of the hash, whether it holds an odd number of members: what the suffix filter compares.

    Ranges are a power of two, two to four for a member; those of a short set are unions of those of a
    long one. Two sets differ in as many members at least as in ranges of odd difference.
    """
    bits = max(64, min(1 << 17, 1 << int(2 * len(x)).bit_length()))
    odd = np.bincount((x & U64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1
    return np.packbits(odd, bitorder="little").tobytes()


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


# --------------------------------------------------------------------------- the order


def frequency_levels(docs: DataFrame, size: int) -> np.ndarray:
    """Per sketch counter, how common its shingles are in all documents, as a small level: four to a doubling, so that no count of 64 bits is too large.

    Each task adds up its own counters; 64 slices of them are summed by as many groups. What reaches
    the driver has the size of the sketch, which follows the number of documents up to a bound.
    """
    slices = 64
    low, high = SKETCH_BITS
    bits = min(high, max(low, docs.count().bit_length() + 2))
    width = (1 << bits) // slices

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, np.int64)
        for _, sets in shingle_sets(batches, size):
            total += np.bincount((np.concatenate(sets) & U64((1 << bits) - 1)).astype(np.int64), minlength=len(total))
        if total.any():
            yield pa.RecordBatch.from_pydict({"slice": np.arange(slices), "counts": [zlib.compress(x.tobytes(), 1) for x in total.reshape(slices, width)]})

    def add(rows):
        total = np.zeros(width, np.int64)
        for x in rows.column("counts").to_pylist():
            total += np.frombuffer(zlib.decompress(x), np.int64)
        return pa.table({"slice": rows.column("slice")[:1], "counts": [zlib.compress(total.tobytes(), 1)]})

    schema = "slice long, counts binary"
    rows = docs.mapInArrow(count, schema).groupBy("slice").applyInArrow(add, schema).collect()
    total = np.zeros((slices, width), np.int64)
    for row in rows:
        total[row["slice"]] = np.frombuffer(zlib.decompress(row["counts"]), np.int64)
    return levels_of(total.reshape(-1))


def levels_of(counts: np.ndarray) -> np.ndarray:
    return np.minimum(np.floor(4 * np.log2(counts.astype(float) + 1)), 255).astype(np.uint8)


# --------------------------------------------------------------------------- the join


def jaccard_sets(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(doc_id, key, n, node, parts): the size, name and parities of each document's shingle set, null node if empty."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, sets in shingle_sets(batches, size):
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column(0),
                    rows.column(2),
                    pa.array([len(x) for x in sets], pa.int64()),
                    pa.array([set_name(x) if len(x) else None for x in sets], pa.int64()),
                    pa.array([np.frombuffer(parities_of(x), np.int64) for x in sets], pa.list_(pa.int64())),
                ],
                names=["doc_id", "key", "n", "node", "parts"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), text_key().alias("key")).mapInArrow(describe, "doc_id long, key long, n long, node long, parts array<long>")


def _prefixes(texts: DataFrame, levels, size: int, percent: int) -> DataFrame:
    """(token, node, n, pos): indexed shingles that two nodes at least have in their prefixes."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        level, seen = levels.value, set()
        for _, sets in shingle_sets(batches, size):
            out = []
            for x in sets:
                if not len(x) or (name := set_name(x)) in seen:
                    continue
                if len(seen) >= 1 << 19:
                    seen.clear()
                seen.add(name)
                key = level[(x & U64(len(level) - 1)).astype(np.int64)].astype(U64) << U64(56) | x >> U64(8)
                k = prefix_length(len(x), percent)
                key = np.sort(np.partition(key, k - 1)[:k] if k < len(key) else key)
                out.append((key, np.full(k, name, np.int64), np.full(k, len(x), np.int64), np.arange(k)))
            if out:
                token, node, n, pos = (np.concatenate(c) for c in zip(*out))
                yield signed(token), n << 28 | pos, node

    schema = "route long, note long, owner long, hash long"
    rows = texts.mapInArrow(lambda b: routed(index(b), keep_hash=True), schema).repartition("route").sortWithinPartitions("route")
    rows = rows.mapInArrow(lambda b: (x for t in sharing(b, owners=True) for x in t.combine_chunks().to_batches()), schema)
    n, pos = F.shiftright("note", 28), F.col("note").bitwiseAND(F.lit((1 << 28) - 1))
    return rows.select(F.coalesce("hash", "route").alias("token"), F.col("owner").alias("node"), n.alias("n"), pos.alias("pos"))


def _needed(percent: int, na: str, nb: str) -> str:
    """The least overlap of two sets at the threshold."""
    return f"cast(ceil({percent} * ({na} + {nb}) / {100 + percent}.0D - 1e-9) as long)"


def _apart(x: Column, y: Column) -> Column:
    """The least size of the symmetric difference of two sets, by their parities; a set twice as fine is folded once."""

    def folded(p: Column, other: Column) -> Column:
        half = F.size(other)
        return F.when(F.size(p) > half, F.zip_with(F.slice(p, F.lit(1), half), F.slice(p, half + 1, half), lambda u, v: u.bitwiseXOR(v))).otherwise(p)

    odd = F.zip_with(folded(x, y), folded(y, x), lambda u, v: F.bit_count(u.bitwiseXOR(v)))
    return F.aggregate(odd, F.lit(0), lambda total, n: total + n)


def _near(percent: int) -> Column:
    """The length and suffix filters on (nx, px, ny, py): whether two sets can overlap enough."""
    fit = F.expr(f"100 * least(nx, ny) >= {percent} * greatest(nx, ny)")
    return fit & (_apart(F.col("px"), F.col("py")) <= F.col("nx") + F.col("ny") - 2 * F.expr(_needed(percent, "nx", "ny")))


def _close(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that pass the length and suffix filters."""
    x, y = (nodes.select(F.col("node").alias(c), F.col("n").alias("n" + s), F.col("parts").alias("p" + s)) for c, s in (("a", "x"), ("b", "y")))
    return pairs.join(x, "a").join(y, "b").where(_near(percent)).select("a", "b")


def _verified(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Pairs of nodes whose whole sets are at the threshold; pairs: a, b, stored."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    bits = 1 << FILTER_BITS

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(bits // 8, np.uint8)
        for batch in batches:
            at = (longs(batch, "node").view(U64) & U64(bits - 1)).astype(np.int64)
            np.bitwise_or.at(found, at >> 3, (1 << (at & 7)).astype(np.uint8))
        yield pa.RecordBatch.from_pydict({"slice": np.arange(64), "marks": [x.tobytes() for x in found.reshape(64, -1)]})

    def unite(rows):
        found = np.zeros(bits // 8 // 64, np.uint8)
        for x in rows.column("marks").to_pylist():
            found |= np.frombuffer(x, np.uint8)
        return pa.table({"slice": rows.column("slice")[:1], "marks": [found.tobytes()]})

    marks = np.zeros((64, bits // 8 // 64), np.uint8)
    for row in wanted.coalesce(8).mapInArrow(mark, "slice long, marks binary").groupBy("slice").applyInArrow(unite, "slice long, marks binary").collect():
        marks[row["slice"]] = np.frombuffer(row["marks"], np.uint8)
    shared = texts.sparkSession.sparkContext.broadcast(marks.reshape(-1))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sets of nodes that may be wanted; a filter of fixed size lets some others pass."""
        marks, seen = shared.value, set()
        for _, sets in shingle_sets(batches, size):
            out = []
            for x in sets:
                if len(x):
                    name = set_name(x)
                    at = name & bits - 1
                    if marks[at >> 3] >> (at & 7) & 1 and name not in seen:
                        if len(seen) >= 1 << 19:
                            seen.clear()
                        seen.add(name)
                        out.append((name, x.tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.binary())], names=["node", "members"])

    sets = texts.mapInArrow(gather, "node long, members binary").groupBy("node").agg(F.first("members").alias("members")).join(wanted, "node", "left_semi")
    sets = stored(sets)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, keep = batch.column("in_a"), batch.column("in_b"), []
            last, x = None, None
            for k in range(batch.num_rows):
                if (raw := a[k].as_buffer().to_pybytes()) != last:
                    last, x = raw, np.frombuffer(raw, U64)
                y = np.frombuffer(b[k].as_buffer().to_pybytes(), U64)
                if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                    keep.append(False)
                    continue
                both = np.concatenate([x, y])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    with_b = pairs.join(sets.select(F.col("node").alias("b"), F.col("members").alias("in_b")), "b")
    both = with_b.join(sets.select(F.col("node").alias("a"), F.col("members").alias("in_a")), "a")
    return both.select("a", "b", "in_a", "in_b").mapInArrow(verify, "a long, b long")


def linked_nodes(docs: DataFrame, nodes: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(node, component) of nodes that have a link; nodes: node, n, parts, one row for each set."""
    spark = docs.sparkSession
    texts = docs.select(F.col("text").cast("string").alias("text"))
    levels = spark.sparkContext.broadcast(frequency_levels(texts, size))
    index = stored(_prefixes(texts, levels, size, percent))

    band = F.floor(F.log("n") / -log(percent / 100)).alias("band")
    ranked = index.select("token", "node", "pos", band)
    # where a common shingle comes early, few rarer ones come before it: such a set is the middle of its copies
    leaders = ranked.groupBy("token", "band").agg(F.min(F.struct("pos", "node")).alias("first")).select("token", "band", F.col("first.node").alias("leader"))
    near = ranked.join(leaders, ["token", "band"]).where("node <> leader").groupBy("node", "leader").agg(F.count(F.lit(1)).alias("common"))
    rank = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("common"), "leader"))  # a node has no more leaders than indexed shingles
    near = near.withColumn("rank", rank).where(F.col("rank") <= LEADERS).select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")).distinct()
    first = stored(_close(near, nodes, percent))
    links = stored(_verified(first, texts, size, percent))
    found = stored(components(links, "a", "b"))

    second = stored(_met(index, found, nodes, percent).join(first, ["a", "b"], "left_anti"))
    return components(links.union(_verified(second, texts, size, percent)), "a", "b")


def _met(index: DataFrame, found: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """(a, b): pairs of different components that share an indexed shingle and pass the filters.

    The first shingle that two sets at the threshold share lies in both prefixes that their own two sizes
    ask for. All they share beyond those counted comes after the last one counted. The join itself
    applies the filters, the suffix filter by parities folded to a fixed size, so that a pair that fails
    them never becomes a row.
    """
    member = index.join(found, "node", "left").select("token", "node", "n", "pos", F.coalesce("component", "node").alias("component"))
    mixed = member.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("token")
    member = member.join(mixed, "token", "left_semi").dropDuplicates(["token", "node"])
    short = F.when(F.size("parts") <= SHORT_PARTS, F.col("parts")).otherwise(
        F.transform(F.sequence(F.lit(0), F.lit(SHORT_PARTS - 1)), lambda k: F.aggregate(F.filter("parts", lambda _, i: i % SHORT_PARTS == k), F.lit(0).cast("long"), lambda u, v: u.bitwiseXOR(v)))
    )
    member = stored(member.join(nodes.select("node", short.alias("p")), "node"))
    x, y = (member.select("token", *[F.col(c).alias(c + s) for c in ("node", "n", "pos", "component", "p")]) for s in "xy")
    need = _needed(percent, "nx", "ny")
    apart = F.expr(f"nodex < nodey and componentx <> componenty and posx <= nx - {need} and posy <= ny - {need}")
    met = x.join(y, (x["token"] == y["token"]) & apart & _near(percent))
    met = met.groupBy(F.col("nodex").alias("a"), F.col("nodey").alias("b")).agg(
        F.count(F.lit(1)).alias("common"), F.max("posx").alias("lastx"), F.max("posy").alias("lasty"), F.first("nx").alias("nx"), F.first("ny").alias("ny")
    )
    return _close(met.where(f"common + least(nx - lastx - 1, ny - lasty - 1) >= {need}").select("a", "b"), nodes, percent)


def _classes(docs: DataFrame, size: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, key, n, node) for each row, and (node, component, least) for each distinct set."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sets = stored(jaccard_sets(rows, size))
    nodes = stored(sets.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"), F.first("n").alias("n"), F.first("parts").alias("parts")))
    linked = linked_nodes(rows, nodes, size, percent)
    return sets, nodes.select("node", "least").join(linked, "node", "left").select("node", "least", F.coalesce("component", "node").alias("component"))


def jaccard_components(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of docs.

    docs: doc_id long, text string; other columns don't matter. Null and wordless texts have an empty
    set and are linked with nothing; texts of fewer words than a shingle are one shingle. Equal sets
    are linked. component_id is the smallest doc_id of the component, null doc_ids left aside.
    """
    sets, named = _classes(docs, size, percent)
    lowest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.join(lowest, "component").select("node", "component_id")
    return sets.select("doc_id", F.col("n").alias("n_shingles"), "node").join(named, "node", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of docs, all columns, without near duplicates: of each component the row of the smallest doc_id stays.

    Null doc_ids come last, ties go by the text's hash. Rows without words are all kept; rows that repeat
    both doc_id and text are one.
    """
    sets, named = _classes(docs, size, percent)
    best = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key"))
    first = sets.where("node is not null").groupBy("node").agg(best.alias("best"))
    first = first.join(named, "node").groupBy("component").agg(F.min("best").alias("best")).select("best.key")
    kept = first.union(sets.where("node is null").select("key")).distinct()
    rows = docs.select(F.struct("*").alias("row"), text_key().alias("key"))
    return rows.join(kept, "key", "left_semi").dropDuplicates(["key"]).select("row.*")
