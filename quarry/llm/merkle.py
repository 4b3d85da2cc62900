"""Merkle manifest of a dataset: a tree of 16 for each source over its documents, and one over the sources.

A document's place in its source comes from bitmaps, not from a sort: a row for every 64 consecutive
doc_ids of a source holds a bit for each that is there, merged over all tasks; running popcounts of these
rows, kept level by level (65,536 children at most below a parent), are the directory. A document looks up
its row; directory plus the bits below its own is its place.

Nodes then go by place into slots of blocks of 4,096, which one group reduces by three levels; the blocks'
nodes are the next round's leaves. No group exceeds a block, no level needs the one before in one task. On
the way back every block gets the siblings above it, and proofs are put together block by block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Children of a node, as bits; levels that a block reduces.
FAN_BITS = 4
LEVELS = 3
BLOCK_BITS = FAN_BITS * LEVELS
#: Bits of a place in a row of the bitmap, and of a child in its directory row.
WORD_BITS = 6
CHILD_BITS = 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


# --------------------------------------------------------------------------- leaves


def leaf_hash(*columns: Column) -> Column:
    """H of the columns, each `-` if null, else UTF-8 byte count, `:`, value."""
    parts = [F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string"))) for c in columns]
    return F.sha2(F.concat(*parts), 256)


def tampered(text: Column, doc_id: Column) -> Column:
    """The text with A-Z lower-cased where 5 divides the crc32 of the decimal doc_id; a null doc_id has no number and stays."""
    return F.when(F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False)), F.translate(text, UPPER, LOWER)).otherwise(text)


def _leaves(docs: DataFrame) -> DataFrame:
    """(src, id, leaf, other): other is the leaf of the tampered text, null where nothing is tampered."""
    i, s, lang, n, t = (F.col(c).cast(kind) for c, kind in (("doc_id", "long"), ("source", "string"), ("lang", "string"), ("n_chars", "long"), ("text", "string")))
    hit = F.coalesce(F.crc32(i.cast("string")) % 5 == 0, F.lit(False))
    other = F.when(hit, F.unhex(leaf_hash(i, s, lang, n, tampered(t, i))))
    return docs.select(_source(s).alias("src"), i.alias("id"), F.unhex(leaf_hash(i, s, lang, n, t)).alias("leaf"), other.alias("other"))


def _source(source: Column) -> Column:
    """A source as a key that is never null and keeps the order, null first."""
    return F.when(source.isNull(), "0").otherwise(F.concat(F.lit("1"), source))


# --------------------------------------------------------------------------- places


def numbered(rows: DataFrame, group: list[str], order: list[str], number: str) -> DataFrame:
    """rows with their place, from 0, in their group's order: places within ranges of rows, whose sizes add up.

    Equal rows are told apart by chance, so a range stays of its size if all rows are equal.
    """
    spread = rows.withColumn("_luck", F.xxhash64(F.monotonically_increasing_id()))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = stored(spread.repartitionByRange(parts, *group, *order, "_luck").withColumn("_part", F.spark_partition_id()))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranged.groupBy(*group, "_part").agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    sizes = sizes.select(*[F.col(c).alias(f"_of_{c}") for c in [*group, "_part"]], "_before")
    same = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in [*group, "_part"]]  # a null group is one too
    own = F.row_number().over(Window.partitionBy(*group, "_part").orderBy(*order, "_luck")) - 1
    return ranged.withColumn("_own", own).join(sizes, same, "inner").drop(*[f"_of_{c}" for c in [*group, "_part"]]).withColumn(number, (F.col("_before") + F.col("_own")).cast("long")).drop("_before", "_own", "_part", "_luck")


def _bits_below() -> Column:
    """The bits of a row's ids that are smaller than the id."""
    return F.expr(f"bits & ~shiftleft(-1L, cast(id & {(1 << WORD_BITS) - 1} as int))")


def bitmap_directory(ids: DataFrame) -> DataFrame:
    """(src, word, bits, n, before, total): for every 64 consecutive ids of a source that has any: which are there, rows with their repeats, rows of the source before, rows of the source in all; ids: src, id, no nulls."""
    bit = F.expr(f"shiftleft(1L, cast(id & {(1 << WORD_BITS) - 1} as int))")
    words = ids.groupBy("src", F.shiftright("id", WORD_BITS).alias("word")).agg(F.bit_or(bit).alias("bits"), F.count(F.lit(1)).alias("n"))
    words = stored(words)
    levels, below, name = [], words, "word"
    for k in range(1, 5):  # the parent's parent ... until a source's parents are few: 64 - 6 - 3 * 16 = 10 bits
        up = f"up{k}"
        parent = F.shiftright(name, CHILD_BITS) if k < 4 else F.lit(0).cast("long")
        inner = Window.partitionBy("src", up).orderBy(name).rowsBetween(Window.unboundedPreceding, -1)
        levels.append(below.withColumn(up, parent).withColumn(f"b{k}", F.coalesce(F.sum("n").over(inner), F.lit(0))))
        below, name = below.withColumn(up, parent).groupBy("src", up).agg(F.sum("n").alias("n")), up
    base = below.select("src", F.col("up4"), F.lit(0).cast("long").alias("base"), F.col("n").alias("total"))
    for k in (4, 3, 2, 1):
        level = levels[k - 1]
        own = f"up{k - 1}" if k > 1 else "word"
        extra = ["bits", "n"] if k == 1 else []
        base = level.join(base, ["src", f"up{k}"]).select("src", own, *extra, (F.col("base") + F.col(f"b{k}")).alias("base"), "total")
    return base.withColumnRenamed("base", "before")


def placed(leaves: DataFrame, docs: DataFrame) -> DataFrame:
    """leaves with place and total: 0-based in the ascending order of ids in a source, null ids first, rows of one id by leaf."""
    ids = docs.select(_source(F.col("source").cast("string")).alias("src"), F.col("doc_id").cast("long").alias("id"))
    words = stored(bitmap_directory(ids.where("id is not null")))
    nulls = stored(ids.where("id is null").groupBy("src").agg(F.count(F.lit(1)).alias("nulls")))
    repeats = words.where(F.col("n") > F.bit_count("bits"))
    if nulls.isEmpty() and repeats.isEmpty():
        below = _bits_below()
        met = leaves.withColumn("word", F.shiftright("id", WORD_BITS)).join(words.drop("n"), ["src", "word"])
        return met.select("src", "id", "leaf", "other", (F.col("before") + F.bit_count(below)).cast("long").alias("place"), "total")
    # ids of several rows: how many rows more than bits stand before an id, and a number for each of its rows
    several = ids.withColumn("word", F.shiftright("id", WORD_BITS)).join(repeats.select("src", "word"), ["src", "word"], "left_semi").groupBy("src", "word", "id").agg((F.count(F.lit(1)) - 1).alias("more")).where("more > 0")
    lists = several.groupBy("src", "word").agg(F.collect_list(F.struct("id", "more")).alias("more"))  # 64 at most
    words = words.drop("n").join(lists, ["src", "word"], "left").join(nulls, "src", "left")
    words = stored(words.withColumn("nulls", F.coalesce("nulls", F.lit(0))))
    below = _bits_below()
    extra = F.expr("aggregate(filter(coalesce(more, array()), x -> x.id < id), 0L, (s, x) -> s + x.more)")
    again = F.expr("exists(coalesce(more, array()), x -> x.id = id)")
    met = leaves.where("id is not null").withColumn("word", F.shiftright("id", WORD_BITS)).join(words, ["src", "word"])
    met = stored(met.select("src", "id", "leaf", "other", (F.col("nulls") + F.col("before") + F.bit_count(below) + extra).cast("long").alias("place"), (F.col("total") + F.col("nulls")).alias("total"), again.alias("again")))
    totals = words.groupBy("src").agg(F.first("total").alias("total"))
    none = leaves.where("id is null").join(nulls, "src").join(totals, "src", "left").withColumn("total", F.coalesce("total", F.lit(0)) + F.col("nulls"))
    ties = met.where("again").drop("again").unionByName(none.select("src", "id", "leaf", "other", F.lit(0).cast("long").alias("place"), "total"))
    ties = numbered(ties, ["src", "id"], ["leaf"], "nth").withColumn("place", F.col("place") + F.col("nth")).drop("nth")
    return met.where("not again").drop("again").unionByName(ties.select("src", "id", "leaf", "other", "place", "total"))


# --------------------------------------------------------------------------- trees


def height(n: int) -> int:
    """Levels above n nodes: while there are several, every 16 become one."""
    levels = 0
    while n > 1:
        n, levels = -(-n >> FAN_BITS), levels + 1
    return levels


def levels_of(nodes: list[bytes], count: int) -> list[list[bytes]]:
    """The nodes, and so many levels above them; digests as hex text."""
    rows = [nodes]
    for _ in range(count):
        last = rows[-1]
        rows.append([hashlib.sha256(b"".join(last[k : k + (1 << FAN_BITS)])).hexdigest().encode() for k in range(0, len(last), 1 << FAN_BITS)])
    return rows


def siblings(rows: list[list[bytes]], at: int) -> list[tuple[bytes, bytes]]:
    """The run's others, left and right of the node, for each level below the last."""
    found = []
    for row in rows[:-1]:
        run = at >> FAN_BITS << FAN_BITS
        found.append((b"".join(row[run:at]), b"".join(row[at + 1 : run + (1 << FAN_BITS)])))
        at >>= FAN_BITS
    return found


def fold(node: bytes, path: list[tuple[bytes, bytes]]) -> bytes:
    for left, right in path:
        node = hashlib.sha256(left + node + right).hexdigest().encode()
    return node


def _blocks(nodes: DataFrame, below: int) -> DataFrame:
    """(tree, block, total, ids, leaves, others, has, levels, top): nodes of 4,096 places in one row, in order.

    nodes: tree, place, total (of the tree's lowest level), id, leaf, other; below: levels that the nodes
    stand above that. A group has one row for each slot, 4,096 at most.
    """

    def reduce(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("place")
        total = rows.column("total")[0].as_py()
        count = min(LEVELS, height(total) - below)
        leaves = rows.column("leaf").to_pylist()
        others = rows.column("other").to_pylist()
        top = levels_of([x.hex().encode() for x in leaves], count)[-1]
        columns = {
            "tree": rows.column("tree")[:1].combine_chunks(), "block": pa.array([rows.column("place")[0].as_py() >> BLOCK_BITS], pa.int64()), "total": pa.array([total], pa.int64()), "ids": pa.array([rows.column("id").to_pylist()], pa.list_(pa.int64())),
            "leaves": pa.array([b"".join(leaves)], pa.binary()), "others": pa.array([b"".join(x for x in others if x is not None)], pa.binary()), "has": pa.array([[k for k, x in enumerate(others) if x is not None]], pa.list_(pa.int32())),
            "levels": pa.array([count], pa.int32()), "top": pa.array([bytes.fromhex(top[0].decode())], pa.binary()),
        }
        return pa.table(columns)

    keyed = nodes.select("tree", F.shiftright("place", BLOCK_BITS).alias("block"), "place", "total", "id", "leaf", "other")
    return keyed.groupBy("tree", "block").applyInArrow(reduce, "tree string, block long, total long, ids array<long>, leaves binary, others binary, has array<int>, levels int, top binary")


def _trees(nodes: DataFrame, most: int) -> list[DataFrame]:
    """Stored rounds of blocks, the lowest first; the last round has one block for each tree of more than one round. most: the largest total."""
    rounds = [stored(_blocks(nodes, 0))]
    while most > 1 << BLOCK_BITS * len(rounds):
        under = rounds[-1].where(F.col("total") > F.lit(1 << BLOCK_BITS * len(rounds)))
        nodes = under.select("tree", F.col("block").alias("place"), "total", F.lit(None).cast("long").alias("id"), F.col("top").alias("leaf"), F.lit(None).cast("binary").alias("other"))
        rounds.append(stored(_blocks(nodes, LEVELS * len(rounds))))
    return rounds


PATH = "array<struct<left:string,right:string>>"


def _descended(rounds: list[DataFrame], above: DataFrame) -> DataFrame:
    """(tree, block, path, subroot, root): what stands above the lowest blocks; above: tree, path, subroot, root of each tree's top."""

    def open_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                nodes = [row["leaves"][k : k + 32].hex().encode() for k in range(0, len(row["leaves"]), 32)]
                rows = levels_of(nodes, row["levels"])
                first = row["block"] << BLOCK_BITS
                out = {"tree": [], "block": [], "path": [], "subroot": [], "root": []}
                for k in range(len(nodes)):
                    own = [{"left": a.decode(), "right": b.decode()} for a, b in siblings(rows, k)]
                    for c, x in zip(out, (row["tree"], first + k, own + row["path"], row["subroot"], row["root"])):
                        out[c].append(x)
                for k in range(0, len(nodes), 256):
                    yield pa.RecordBatch.from_pydict({c: x[k : k + 256] for c, x in out.items()}, schema)

    schema = pa.schema([("tree", pa.string()), ("block", pa.int64()), ("path", pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))), ("subroot", pa.string()), ("root", pa.string())])
    paths: DataFrame | None = None
    for k in range(len(rounds) - 1, -1, -1):
        # trees whose only block is of this round start here
        least, most = (1 << BLOCK_BITS * k if k else 0), 1 << BLOCK_BITS * (k + 1)
        tops = rounds[k].where((F.col("total") > F.lit(least)) & (F.col("total") <= F.lit(most))).select("tree", "block").join(above, "tree").select("tree", "block", "path", "subroot", "root")
        paths = tops if paths is None else paths.unionByName(tops)
        if k:
            paths = stored(rounds[k].join(paths, ["tree", "block"]).select("tree", "block", "leaves", "levels", "path", "subroot", "root").mapInArrow(open_up, f"tree string, block long, path {PATH}, subroot string, root string"))
    return paths


def _roots(rounds: list[DataFrame]) -> DataFrame:
    """(tree, total, top): the node that is left of each tree."""
    found = None
    for k, blocks in enumerate(rounds):
        rows = blocks.where(F.col("total") <= F.lit(1 << BLOCK_BITS * (k + 1))).where(F.col("total") > F.lit(1 << BLOCK_BITS * k if k else 0)).select("tree", "total", "top")
        found = rows if found is None else found.unionByName(rows)
    return found


def _largest(nodes: DataFrame) -> int:
    return nodes.agg(F.max("total")).first()[0] or 0


def _source_tree(rounds: list[DataFrame]) -> tuple[DataFrame, list[DataFrame], DataFrame]:
    """Sources in order with their subroots, the rounds of the tree above them, and that tree's root."""
    subroots = stored(_roots(rounds))
    ordered = stored(numbered(subroots.select(F.lit("all").alias("tree"), F.col("tree").alias("src"), F.col("top").alias("leaf"), F.col("total").alias("documents")), ["tree"], ["src"], "place"))
    count = ordered.count()
    nodes = ordered.select("tree", "place", F.lit(count).cast("long").alias("total"), F.col("place").alias("id"), "leaf", F.lit(None).cast("binary").alias("other"))
    upper = _trees(nodes, count)
    return ordered, upper, _roots(upper).select(F.lower(F.hex("top")).alias("root"))


def _document_trees(docs: DataFrame) -> list[DataFrame]:
    places = stored(placed(_leaves(docs), docs))
    return _trees(places.select(F.col("src").alias("tree"), "place", "total", "id", "leaf", "other"), _largest(places))


def manifest(docs: DataFrame) -> DataFrame:
    """(source, documents, subroot, root): the record to keep of docs, a row for each source; no rows for no documents."""
    ordered, _, root = _source_tree(_document_trees(docs))
    source = F.when(F.col("src") != "0", F.substring("src", 2, 1 << 30))
    return ordered.select(source.alias("source"), "documents", F.lower(F.hex("leaf")).alias("subroot")).crossJoin(F.broadcast(root))  # one row


def proofs(docs: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) for every row of docs.

    docs: doc_id, source, lang, n_chars, text; other columns don't matter. Null columns are `-` in a
    leaf. Rows without doc_id come first in their source, in the order of their leaves, as rows that share
    a doc_id do; rows without source are a source of their own, the first. folded_root is recomputed from
    the tampered leaf where there is one, with the original siblings. No documents have no rows.
    """
    rounds = _document_trees(docs)
    ordered, upper, root = _source_tree(rounds)

    def of_sources(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                nodes = [row["leaves"][k : k + 32].hex().encode() for k in range(0, len(row["leaves"]), 32)]
                rows = levels_of(nodes, row["levels"])
                for k, place in enumerate(row["ids"]):
                    own = [{"left": a.decode(), "right": b.decode()} for a, b in siblings(rows, k)]
                    yield pa.RecordBatch.from_pydict({"place": [place], "path": [own + row["path"]]}, schema)

    schema = pa.schema([("place", pa.int64()), ("path", pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())])))])
    nothing = F.lit(None).cast("string")
    top = F.lit("all").alias("tree")
    start = root.select(top, F.array().cast(PATH).alias("path"), nothing.alias("subroot"), "root")
    lowest = _descended(upper, start)
    over = upper[0].join(lowest, ["tree", "block"]).select("leaves", "levels", "ids", "path").mapInArrow(of_sources, f"place long, path {PATH}")
    above = ordered.join(over, "place").crossJoin(F.broadcast(root))  # one row
    above = stored(above.select(F.col("src").alias("tree"), "path", F.lower(F.hex("leaf")).alias("subroot"), "root"))
    paths = _descended(rounds, above)

    def prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                yield from _proven(batch.slice(k, 1).to_pylist()[0])

    blocks = rounds[0].join(paths, ["tree", "block"]).select("ids", "leaves", "others", "has", "levels", "path", "subroot", "root")
    return blocks.mapInArrow(prove, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def _proven(row: dict) -> Iterator[pa.RecordBatch]:
    """A block's rows."""
    leaves = [row["leaves"][k : k + 32].hex().encode() for k in range(0, len(row["leaves"]), 32)]
    others = dict(zip(row["has"], (row["others"][k : k + 32].hex().encode() for k in range(0, len(row["others"]), 32))))
    rows = levels_of(leaves, row["levels"])
    above = [(x["left"].encode(), x["right"].encode()) for x in row["path"]]
    tail = b"".join(a + b for a, b in above)
    proof, folded = [], []
    for k, leaf in enumerate(leaves):
        own = siblings(rows, k)
        proof.append(hashlib.sha256(b"".join(a + b for a, b in own) + tail).hexdigest())
        folded.append(fold(others.get(k, leaf), own + above).decode())
    n = len(leaves)
    yield pa.RecordBatch.from_pydict(
        {
            "doc_id": pa.array(row["ids"], pa.int64()), "leaf": [x.decode() for x in leaves], "subroot": [row["subroot"]] * n, "root": [row["root"]] * n,
            "proof_sha256": proof, "folded_root": folded, "verified": [x == row["root"] for x in folded],
        }
    )
