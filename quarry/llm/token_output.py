"""Token ids as a binary table: frequency-ranked, byte-aligned, with separate control bytes.

A file is a table of blocks, written and committed by Spark's own writer, so that a lost or repeated
task leaves no partial file. A block holds whole documents:

    part, start   the range of the order it belongs to, and the ids before it in that range
    n_ids, n_docs counts
    doc_ids       little-endian signed 64-bit, one per document; doc_null has a byte 1 for a null id
    lengths       little-endian unsigned 32-bit, ids per document
    ranks         little-endian unsigned 32-bit, the block's distinct ids, the most frequent first
    control       2 bits per id, four to a byte, low bits first: bytes of its rank, less one
    data          the ranks, little-endian, 1 to 4 bytes each

Most ids of a text take one byte, as their rank is below 256.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BYTE_VALUE, U64, mix, pieces, powers, shared_dir

END_ID = 2
BLOCK_IDS = 1 << 21
#: Pieces whose ids a Python worker keeps, at most, bytes of text that are encoded at a time, and bytes of a piece, at most.
MOST_PIECES = 4_000_000
CHUNK_BYTES = 1 << 21
LONGEST_PIECE = 256
BLOCK_SCHEMA = "part int, start long, n_ids long, n_docs long, first_order long, doc_ids binary, doc_null binary, lengths binary, ranks binary, control binary, data binary"

# --------------------------------------------------------------------------- the code

#: For each control byte: the lengths of its four ranks.
LENGTHS = np.array([[(c >> s & 3) + 1 for s in (0, 2, 4, 6)] for c in range(256)], np.uint8)


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """Unsigned 32-bit values as control and data bytes."""
    values = values.astype(np.uint32)
    length = np.ones(len(values), np.uint8)
    for least in (1 << 8, 1 << 16, 1 << 24):
        if not len(values) or values.max() < least:
            break
        length += values >= least
    codes = np.zeros(-(-len(values) // 4) * 4, np.uint8)
    codes[: len(values)] = length - 1
    codes = codes.reshape(-1, 4)
    control = codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6
    at = np.cumsum(length, dtype=np.int64) - length
    data = np.empty(int(length.sum(dtype=np.int64)), np.uint8)
    data[at] = values
    for k in (1, 2, 3):
        has = np.flatnonzero(length > k)
        if not len(has):
            break
        data[at[has] + k] = values[has] >> np.uint32(8 * k)
    return control.tobytes(), data.tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n values of pack(): lengths come from a table by control byte."""
    length = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    at = np.cumsum(length, dtype=np.int64) - length
    raw = np.frombuffer(data + b"\0\0\0", np.uint8)
    values = raw[at].astype(np.uint32)
    for k in (1, 2, 3):
        has = np.flatnonzero(length > k)
        if not len(has):
            break
        values[has] |= raw[at[has] + k].astype(np.uint32) << np.uint32(8 * k)
    return values


# --------------------------------------------------------------------------- ids of texts

SPACE_BYTE, LINE_BYTE = 0x20, 0x0A
#: Control signs, and any that some reader of texts takes for a space.
ODD = np.zeros(256, bool)
ODD[:0x20] = True
ODD[LINE_BYTE] = False
SIGN = np.zeros(256, bool)
SIGN[[x for x in range(33, 127) if not chr(x).isalnum()]] = True
ALNUM = np.zeros(256, bool)
ALNUM[[x for x in range(33, 127) if chr(x).isalnum()]] = True


def _after(data: np.ndarray, *followers) -> np.ndarray:
    """Where bytes that meet the followers' tests stand in a row; the position of the first."""
    hit = followers[0](data)
    for k, test in enumerate(followers[1:], 1):
        hit = hit.copy()
        hit[: len(data) - k] &= test(data[k:])
        hit[len(data) - k :] = False
    return np.flatnonzero(hit)


def odd_places(data: np.ndarray) -> np.ndarray:
    """Places of what keeps a text from being cut: rows of spaces, spaces outside ASCII, control signs, and `<|`."""
    space = (data == SPACE_BYTE) | (data == LINE_BYTE)
    found = [np.flatnonzero(ODD[data]), np.flatnonzero(space[1:] & space[:-1]), _after(data, lambda x: x == 0x3C, lambda x: x == 0x7C)]
    if len(data) and data.max() >= 0x80:
        found += [
            _after(data, lambda x: x == 0xC2, lambda x: (x == 0xA0) | (x == 0x85)),
            _after(data, lambda x: x == 0xE1, lambda x: x == 0x9A, lambda x: x == 0x80),
            _after(data, lambda x: x == 0xE2, lambda x: x == 0x80, lambda x: (x <= 0x8A) | (x == 0xA8) | (x == 0xA9) | (x == 0xAF)),
            _after(data, lambda x: x == 0xE2, lambda x: x == 0x81, lambda x: x == 0x9F),
            _after(data, lambda x: x == 0xE3, lambda x: x == 0x80, lambda x: x == 0x80),
        ]
    return np.concatenate(found)


class Pieces:
    """Cuts of texts that no pre-token of a byte-level tokenizer crosses.

    A piece begins at a text's start, at a space, at a line's end, behind one, and where a word's run of
    signs at its end follows a letter or digit. Texts in which such cuts aren't sure are `odd`.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        n = len(data)
        line = data == LINE_BYTE
        space = (data == SPACE_BYTE) | line
        begin = space.copy()
        begin[1:] |= line[:-1]
        size = np.diff(offsets)
        starts, ends = offsets[:-1][size > 0], offsets[1:][size > 0]
        begin[starts] = True
        sign = SIGN[data]
        # a run of signs that goes up to a space or a text's end, and what stands before it
        last = np.zeros(n, bool)
        last[:-1] = space[1:]
        last[ends - 1] = True
        run_begin = sign.copy()
        run_begin[1:] &= ~sign[:-1]
        run_begin[starts] = sign[starts]
        run_end = sign & last
        at = np.flatnonzero(run_begin)
        of = np.searchsorted(at, np.flatnonzero(run_end), side="right") - 1
        cut = at[of]
        cut = cut[(cut > 0) & ~begin[cut]]
        before = data[cut - 1]
        latin = (data[np.maximum(cut - 2, 0)] == 0xC3) & (before >= 0x80) & (before <= 0xBF) & (before != 0x97) & (before != 0xB7)
        begin[cut[ALNUM[before] | latin]] = True

        self.starts = np.flatnonzero(begin)
        self.ends = np.append(self.starts[1:], n)
        self.first = np.searchsorted(self.starts, offsets)
        odd = np.zeros(len(size), bool)
        text_at = lambda places: np.searchsorted(offsets, places, side="right") - 1
        odd[text_at(odd_places(data))] = True
        odd[text_at(self.starts[self.ends - self.starts > LONGEST_PIECE])] = True
        whole = np.flatnonzero(size > 0)
        odd[whole[space[starts] | space[ends - 1]]] = True
        self.odd = odd
        up, down = powers(n + 1)
        with np.errstate(over="ignore"):
            sums = np.empty(n + 1, U64)
            sums[0] = 0
            np.cumsum(BYTE_VALUE[data] * up[:n], out=sums[1:])
            self.hashes = mix((sums[self.ends] - sums[self.starts]) * down[self.starts] + (self.ends - self.starts).astype(U64))


_encoders: dict[str, "Encoder"] = {}


class Encoder:
    """Ids of texts by the tokenizers library, with a bounded table of the ids of pieces.

    Pieces are known by a 64-bit hash; their ids lie in one array, and a chunk of texts is put together
    by gathers. The ids of new pieces come from encoding them in a row and cutting by the bytes that each
    id stands for. Texts that can't be cut surely, and all texts of tokenizers of another kind than
    byte-level ones, are encoded as they are.
    """

    def __init__(self, path: str):
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size()
        self.kind = np.dtype("<u4" if size > 1 << 16 else "<u2")
        with open(path, encoding="utf-8") as f:
            parts = json.load(f)
        before = parts.get("pre_tokenizer") or {}
        self.cuts = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and parts.get("normalizer") is None
        self.cuts = self.cuts and parts["model"].get("type") == "BPE" and all(x["content"].startswith("<|") for x in parts.get("added_tokens", ()))
        self.width = np.zeros(size, np.int64)  # bytes of each id: a byte-level token has one sign for a byte
        if self.cuts:
            for token, at in self.tokenizer.get_vocab().items():
                self.width[at] = len(token)
        self._clear()

    def _clear(self) -> None:
        self.keys, self.number = np.empty(0, U64), np.empty(0, np.int64)
        self.at, self.size, self.flat, self.used = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, self.kind), 0

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind)

    def _in_a_row(self, raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces that stand in a row in raw, and how many belong to each."""
        text = raw.tobytes().decode()
        ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.kind)
        return ids, np.diff(np.searchsorted(np.cumsum(self.width[ids]), ends, side="right"), prepend=0)

    def _learn(self, p: Pieces, data: np.ndarray, some: np.ndarray) -> None:
        """some: numbers of pieces with different new hashes. Line ends go alone, others in a row, in which a space or a line's end keeps each from the one before."""
        first = data[p.starts[some]]
        for k in some[first == LINE_BYTE].tolist():
            ids = self.whole(data[p.starts[k] : p.ends[k]].tobytes().decode())
            self._add(p.hashes[k : k + 1], ids, np.array([len(ids)]))
        for own, spacer in ((some[first == SPACE_BYTE], False), (some[(first != SPACE_BYTE) & (first != LINE_BYTE)], True)):
            for k in range(0, len(own), 1 << 13):
                now = own[k : k + (1 << 13)]
                n = p.ends[now] - p.starts[now]
                gap = n + spacer  # a line's end in front
                ends = np.cumsum(gap)
                raw = np.full(int(ends[-1]), LINE_BYTE, np.uint8)
                to = np.repeat(ends - n - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                raw[to] = data[np.repeat(p.starts[now] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
                if spacer:
                    ids, counts = self._in_a_row(raw, np.sort(np.concatenate([ends - n, ends])))
                    keep = np.repeat(np.tile([False, True], len(now)), counts)
                    ids, counts = ids[keep], counts[1::2]
                else:
                    ids, counts = self._in_a_row(raw, ends)
                self._add(p.hashes[now], ids, counts)

    def _add(self, hashes: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        self.keys = np.concatenate([self.keys, hashes])
        self.at = np.concatenate([self.at, self.used + np.cumsum(counts) - counts])
        self.size = np.concatenate([self.size, counts])
        if self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.used], np.empty(max(1 << 20, self.used, len(ids)), self.kind)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.used += len(ids)

    def _numbers(self, p: Pieces, data: np.ndarray, real: np.ndarray) -> np.ndarray:
        """The table's numbers of the pieces marked in `real`; the others' mean nothing."""
        if len(self.keys) > MOST_PIECES:
            self._clear()
        hashes, first, back = np.unique(p.hashes[real], return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.keys, hashes), max(len(self.keys) - 1, 0))
        new = self.keys[at] != hashes if len(self.keys) else np.ones(len(hashes), bool)
        number = np.empty(len(hashes), np.int64)
        number[~new] = self.number[at[~new]]
        if new.any():
            had, order = len(self.at), self.number
            sorted_keys = self.keys
            self.keys = np.empty(0, U64)
            self._learn(p, data, np.flatnonzero(real)[first[new]])
            added = self.keys  # in the order learned
            rank = np.argsort(added, kind="stable")
            number[new] = had + rank  # hashes[new] ascend, as added[rank] does
            place = np.searchsorted(sorted_keys, added[rank])
            self.keys, self.number = np.insert(sorted_keys, place, added[rank]), np.insert(order, place, had + rank)
        out = np.zeros(len(real), np.int64)
        out[real] = number[back]
        return out

    def encode(self, data: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the texts between the offsets of data, an end id after each, and each text's number of ids."""
        n = len(offsets) - 1
        p = Pieces(data, offsets)
        odd = p.odd if self.cuts else np.diff(offsets) > 0
        text_of = np.repeat(np.arange(n), np.diff(p.first))
        number = self._numbers(p, data, ~odd[text_of])
        own = [self.whole(data[offsets[k] : offsets[k + 1]].tobytes().decode()) for k in np.flatnonzero(odd)]
        # an odd text is one piece in place of its own, and a piece for the end follows each text
        keep = ~odd[text_of]
        count = np.where(odd, 1, np.bincount(text_of[keep], minlength=n)) + 1
        ends = np.cumsum(count) - 1
        row = np.empty(int(count.sum()), np.int64)
        inner = np.ones(len(row), bool)
        inner[ends] = False
        row[ends] = len(self.at) + len(own)
        inner[ends[odd] - 1] = False
        row[ends[odd] - 1] = len(self.at) + np.arange(len(own))
        row[inner] = number[keep]
        sizes = np.concatenate([self.size, [len(x) for x in own], [1]]).astype(np.int64)
        starts = np.concatenate([self.at, self.used + np.cumsum([0, *map(len, own)])]).astype(np.int64)
        flat = np.concatenate([self.flat[: self.used], *own, np.array([end_id], self.kind)])
        length = sizes[row]
        before = np.cumsum(length) - length
        ids = flat[np.repeat(starts[row] - before, length) + np.arange(int(length.sum()))]
        edges = np.append(before, len(ids))[np.r_[0, np.cumsum(count)]]
        return ids, np.diff(edges)


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


# --------------------------------------------------------------------------- writing


def _blocks(path: str, end_id: int, block_ids: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def block(part: int, start: int, first: int | None, docs: pa.Array, ids: np.ndarray, lengths: np.ndarray) -> pa.RecordBatch:
        counts = np.bincount(ids)
        order = np.argsort(-counts, kind="stable")
        order = order[: int((counts > 0).sum())].astype(np.uint32)
        rank = np.zeros(len(counts), np.uint32)
        rank[order] = np.arange(len(order), dtype=np.uint32)
        control, data = pack(rank[ids])
        row = {
            "part": part, "start": start, "n_ids": len(ids), "n_docs": len(docs), "first_order": first,
            "doc_ids": docs.fill_null(0).to_numpy().astype("<i8").tobytes(), "doc_null": docs.is_null().to_numpy(zero_copy_only=False).astype(np.uint8).tobytes(),
            "lengths": lengths.astype("<u4").tobytes(), "ranks": order.astype("<u4").tobytes(), "control": control, "data": data,
        }
        types = [pa.int32(), *[pa.int64()] * 4, *[pa.binary()] * 6]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row.values(), types)], names=list(row))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, start, enc = TaskContext.get().partitionId(), 0, encoder(path)
        held: list[tuple[pa.Array, pa.Array, np.ndarray, np.ndarray]] = []

        def cut(n: int, last: bool) -> Iterator[pa.RecordBatch]:
            """Blocks of block_ids ids at least, and what is left over if it is the last."""
            nonlocal start, held
            docs, orders = (pa.concat_arrays([x[k] for x in held]) for k in (0, 1))
            ids, lengths = (np.concatenate([x[k] for x in held]) for k in (2, 3))
            ends, row, at = np.cumsum(lengths), 0, 0
            while row < len(docs):
                to = int(np.searchsorted(ends, at + block_ids)) + 1
                if to > len(docs):
                    if not last:
                        break
                    to = len(docs)
                yield block(part, start, orders[row].as_py(), docs.slice(row, to - row), ids[at : ends[to - 1]], lengths[row:to])
                start, at, row = start + int(ends[to - 1]) - at, int(ends[to - 1]), to
            held = [(docs.slice(row), orders.slice(row), ids[at:], lengths[row:])] if row < len(docs) else []

        size = 0
        for batch in batches:
            for rows, data, offsets in pieces(batch, size=CHUNK_BYTES):
                held.append((rows.column(0), rows.column(1), *enc.encode(data, offsets, end_id)))
                size += len(held[-1][2])
                if size >= block_ids:
                    yield from cut(size, False)
                    size = sum(len(x[2]) for x in held)
        if held:
            yield from cut(size, True)

    return write


def write_tokens(docs: DataFrame, path: str, tokenizer: str, order: Column | None = None, end_id: int = END_ID, block_ids: int = BLOCK_IDS) -> None:
    """Write the ids of every text, an end id after each, in ascending order of `order` (doc_id).

    docs: doc_id long, text string; other columns don't matter. A null text is empty, a null order
    comes first, rows of equal order stand in the order of their texts' hashes.
    tokenizer: the path of a file of the tokenizers library that every executor can read.
    """
    key = F.col("doc_id") if order is None else order
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), key.cast("long").alias("order"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("tie"))
    rows = rows.repartitionByRange("order").sortWithinPartitions("order", "doc_id", "tie").select("doc_id", "order", "text")
    rows.mapInArrow(_blocks(tokenizer, end_id, block_ids), BLOCK_SCHEMA).write.option("compression", "none").parquet(path)


# --------------------------------------------------------------------------- reading


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            ids = np.frombuffer(row["ranks"], "<u4")[unpack(row["control"], row["data"], row["n_ids"])] if row["n_ids"] else np.empty(0, "<u4")
            lengths = np.frombuffer(row["lengths"], "<u4").astype(np.int64)
            ends = np.cumsum(lengths)
            raw = memoryview(np.ascontiguousarray(ids, "<u4").tobytes())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(lengths), row["part"], np.int32)),
                    pa.array(np.frombuffer(row["doc_ids"], "<i8"), mask=np.frombuffer(row["doc_null"], np.uint8).astype(bool)),
                    pa.array(row["start"] + ends - lengths),
                    pa.array(lengths),
                    pa.array([zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist())], pa.int64()),
                ],
                names=["part", "doc_id", "within", "n_tokens", "ids_crc32"],
            )


def _ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            ids = np.frombuffer(row["ranks"], "<u4")[unpack(row["control"], row["data"], row["n_ids"])].astype(np.int64)
            cuts = np.cumsum(np.frombuffer(row["lengths"], "<u4").astype(np.int64))[:-1]
            docs = [None if gone else x for x, gone in zip(np.frombuffer(row["doc_ids"], "<i8").tolist(), row["doc_null"])]
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array([x.tolist() for x in np.split(ids, cuts)], pa.list_(pa.int64()))], names=["doc_id", "ids"])


def read_ids(spark, path: str) -> DataFrame:
    """(doc_id, ids array<long>) of a written table."""
    return spark.read.schema(BLOCK_SCHEMA).parquet(path).mapInArrow(_ids, "doc_id long, ids array<long>")


def read_digest(spark, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) per document, from decoded files.

    Ranges are put in order by their first document; there are as many as tasks wrote, so their
    running total is a small window.
    """
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(path)
    ranges = blocks.groupBy("part").agg(F.sum("n_ids").alias("ids"), F.min(F.struct(F.col("first_order").isNotNull().alias("set"), "first_order", "part")).alias("first"))
    before = F.sum("ids").over(Window.orderBy("first").rowsBetween(Window.unboundedPreceding, -1))
    ranges = ranges.select("part", F.coalesce(before, F.lit(0)).alias("before"))
    docs = blocks.mapInArrow(_documents, "part int, doc_id long, within long, n_tokens long, ids_crc32 long")
    return docs.join(F.broadcast(ranges), "part").select("doc_id", (F.col("before") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


def token_table(docs: DataFrame, tokenizer: str, order: Column | None = None) -> DataFrame:
    """Write the token table to the shared folder and return read_digest() of it."""
    path = shared_dir(docs.sparkSession)
    write_tokens(docs, path, tokenizer, order)
    return read_digest(docs.sparkSession, path)
