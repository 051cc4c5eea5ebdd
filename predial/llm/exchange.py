"""Corpus-wide counts of hashed n-grams, asked for and answered in packed arrays.

Documents are cut into batches of bounded size, written once as word hashes. Each batch sends its distinct n-gram
hashes, with how often it has them, to buckets of the hash space; each bucket sums over all batches and answers every
batch with the totals of the hashes it sent, in the order sent. Nothing is collected: a bucket holds about BUCKET_KEYS
distinct hashes of any corpus, and a hash that is everywhere is one entry per batch.
"""

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import Rule, text_bytes, words
from .shared import write_table

STRETCH = 3 << 20
MOST_DOCS = 1 << 15
LEAST_BITS = 8
BUCKET_KEYS = 1 << 22
BATCH = "batch long, n_docs long, n_words long, payload binary"
SENT = "kind int, bucket int, batch long, sent binary"
ANSWER = "kind int, bucket int, batch long, totals binary, distinct long"


class Batch(NamedTuple):
    """Documents' ids and the words of each: indices into the batch's sorted distinct word hashes."""

    ids: list
    rows: np.ndarray
    vocabulary: np.ndarray
    word: np.ndarray

    @property
    def hashes(self) -> np.ndarray:
        return self.vocabulary[self.word]


def _dump(ids: list, h: np.ndarray, rows: np.ndarray) -> bytes:
    vocabulary, word = np.unique(h, return_inverse=True)
    # The index by falling frequency makes small numbers frequent, which the compressor then exploits.
    often = np.argsort(-np.bincount(word, minlength=len(vocabulary)), kind="stable")
    rank = np.empty(len(often), np.uint32)
    rank[often] = np.arange(len(often), dtype=np.uint32)
    index = rank[word]
    low, high = (index & np.uint32(0xFFFF)).astype("<u2"), (index >> np.uint32(16)).astype("<u2")
    names = pa.array(ids, pa.int64())
    parts = [np.array([len(ids), len(vocabulary), len(word)], "<i8"), np.array(names.is_valid().to_pylist(), np.uint8), names.fill_null(0).to_numpy().astype("<i8"), rows.astype("<i8"), vocabulary[often].astype("<u8"), low, high]
    return zstandard.ZstdCompressor(level=3).compress(b"".join(p.tobytes() for p in parts))


def load(raw: bytes) -> Batch:
    raw = zstandard.ZstdDecompressor().decompress(raw)
    n, v, w = np.frombuffer(raw, "<i8", 3).tolist()
    at, parts = 24, []
    for kind, size in (("u1", n), ("<i8", n), ("<i8", n + 1), ("<u8", v), ("<u2", w), ("<u2", w)):
        parts.append(np.frombuffer(raw, kind, size, at))
        at += parts[-1].nbytes
    known, names, rows, vocabulary, low, high = parts
    order = np.argsort(vocabulary)
    rank = np.empty(v, np.int64)
    rank[order] = np.arange(v)
    return Batch([i if k else None for i, k in zip(names.tolist(), known.tolist())], rows, vocabulary[order], rank[low.astype(np.int64) | high.astype(np.int64) << 16])


def batches(docs: DataFrame, rule: Rule, id_col: str, text_col: str) -> DataFrame:
    """The documents as batches of about STRETCH bytes of text (a longer document is alone) and at most MOST_DOCS, written and reread."""

    def cut(records: Iterator[pa.RecordBatch]):
        base, seq = TaskContext.get().partitionId() << 24, 0
        for record in records:
            column, names = record.column(1), record.column(0).to_pylist()
            _, offsets = text_bytes(column)
            at = 0
            while at < record.num_rows:
                end = min(max(at + 1, int(np.searchsorted(offsets, offsets[at] + STRETCH, "right")) - 1), at + MOST_DOCS)
                h, rows = words(column.slice(at, end - at), rule)
                yield pa.RecordBatch.from_arrays([pa.array([base + seq], pa.int64()), pa.array([end - at], pa.int64()), pa.array([len(h)], pa.int64()), pa.array([_dump(names[at:end], h, rows)], pa.binary())], ["batch", "n_docs", "n_words", "payload"])
                seq, at = seq + 1, end

    narrow = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).alias("__text"))
    return write_table(narrow.mapInArrow(cut, BATCH), "batches", "uncompressed")[0]


def bucket_bits(n_keys: int) -> int:
    """Bits of a hash that number its bucket, so that a bucket has about BUCKET_KEYS of ``n_keys`` hashes."""
    return max(LEAST_BITS, (n_keys // BUCKET_KEYS).bit_length())


class Kind(NamedTuple):
    """One sort of n-gram: its hashes in a batch (sorted, distinct, with times), and the bytes a sent hash takes.

    Of a hash, the bits of its bucket and the ``width`` bytes after them are kept.
    """

    keys: Callable[[Batch], tuple[np.ndarray, np.ndarray]]
    width: int


def _pack(keys: np.ndarray, times: np.ndarray, bits: int, width: int) -> bytes:
    """Sorted hashes of one bucket and their times, compressed: differences and times, byte place by byte place."""
    short = (keys << np.uint64(bits)) >> np.uint64(64 - 8 * width)
    apart = np.diff(short, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
    planes = np.concatenate([apart, times.astype("<u4").view(np.uint8).reshape(-1, 4)], axis=1).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpack(raw: bytes, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes without their bucket's bits, and their times."""
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(width + 4, -1)
    wide = np.zeros((planes.shape[1], 8), np.uint8)
    wide[:, :width] = planes[:width].T
    return np.cumsum(wide.view("<u8").reshape(-1), dtype=np.uint64), np.ascontiguousarray(planes[width:].T).view("<u4").reshape(-1)


def answers(found: DataFrame, kinds: list[Kind], bits: int, name: str) -> DataFrame:
    """For each kind, bucket and batch: the totals (unsigned 64-bit, zstd) of the hashes that the batch has there.

    ``distinct`` is, in one row of each bucket, how many of its hashes have a total over 0, and 0 in the others.
    """
    widths = [k.width for k in kinds]

    def send(records):
        for record in records:
            for batch, raw in zip(record.column(0).to_pylist(), record.column(1)):
                batch_rows = load(raw.as_py())
                for number, kind in enumerate(kinds):
                    keys, times = kind.keys(batch_rows)
                    # Only the buckets that the batch has keys in: the work goes with its keys, whatever the corpus.
                    some, cut = np.unique(keys >> np.uint64(64 - bits), return_index=True)
                    some, cut = some.astype(np.int64).tolist(), [*cut.tolist(), len(keys)]
                    sent = [_pack(keys[a:b], times[a:b], bits, kind.width) for a, b in zip(cut, cut[1:])]
                    columns = [pa.array([number] * len(some), pa.int32()), pa.array(some, pa.int32()), pa.array([batch] * len(some), pa.int64()), pa.array(sent, pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, ["kind", "bucket", "batch", "sent"])

    def answer(group: pa.Table) -> pa.Table:
        kind = group.column("kind")[0].as_py()
        keys, times = zip(*(_unpack(x.as_py(), widths[kind]) for x in group.column("sent")))
        known, back = np.unique(np.concatenate(keys), return_inverse=True)
        totals = np.bincount(back, np.concatenate(times), len(known)).astype("<u8")
        parts = np.split(totals[back], np.cumsum([len(k) for k in keys])[:-1])
        press = zstandard.ZstdCompressor(level=1)
        distinct = [0] * len(keys)
        distinct[0] = int((totals > 0).sum())
        return pa.table(
            [group.column("kind"), group.column("bucket"), group.column("batch"), pa.array([press.compress(p.tobytes()) for p in parts], pa.binary()), pa.array(distinct, pa.int64())],
            ["kind", "bucket", "batch", "totals", "distinct"],
        )

    sent = found.select("batch", "payload").mapInArrow(send, SENT)
    return write_table(sent.groupBy("kind", "bucket").applyInArrow(answer, ANSWER), name, "uncompressed")[0]


def with_answers(found: DataFrame, replies: DataFrame, use: Callable[[Batch, list[np.ndarray]], Iterator[pa.RecordBatch]], kinds: int, schema: str) -> DataFrame:
    """Run ``use(batch, totals)`` on every batch, totals[k] being aligned with the hashes that kind k gave."""
    empty = _empty(schema)

    def one(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [r for payload in left.column("payload") for r in use(load(payload.as_py()), _totals(right, kinds))]
        return pa.Table.from_batches(out) if out else empty

    left = found.select("batch", "payload").groupBy("batch")
    return left.cogroup(replies.select("batch", "kind", "bucket", "totals").groupBy("batch")).applyInArrow(one, schema)


def with_rows(found: DataFrame, replies: DataFrame, use: Callable[[int, Batch, np.ndarray, np.ndarray], list[tuple]], schema: str) -> DataFrame:
    """Run ``use(number, batch, totals, places)`` on every batch, places being the answer of kind 1 as numbers."""
    empty = _empty(schema)

    def one(left: pa.Table, right: pa.Table) -> pa.Table:
        marked = [x.as_py() for x, kind in zip(right.column("totals"), right.column("kind").to_pylist()) if kind == 1]
        places = np.array([int(p) for x in marked for p in x.split(b",")], np.int64)
        rows = [r for number, payload in zip(left.column("batch").to_pylist(), left.column("payload")) for r in use(number, load(payload.as_py()), _totals(right, 1)[0], places)]
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows), empty.schema)], schema=empty.schema) if rows else empty

    left = found.select("batch", "payload").groupBy("batch")
    return left.cogroup(replies.groupBy("batch")).applyInArrow(one, schema)


def _totals(answered: pa.Table, kinds: int) -> list[np.ndarray]:
    bucket, kind, raw = answered.column("bucket").to_numpy(), answered.column("kind").to_numpy(), answered.column("totals")
    press, totals = zstandard.ZstdDecompressor(), []
    for k in range(kinds):
        mine = np.flatnonzero(kind == k)
        mine = mine[np.argsort(bucket[mine])]
        totals.append(np.concatenate([np.frombuffer(press.decompress(raw[int(i)].as_py()), "<u8") for i in mine] or [np.zeros(0, "<u8")]))
    return totals


def _empty(schema: str) -> pa.Table:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(schema)).empty_table()
