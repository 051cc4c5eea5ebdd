"""Token-id output: Simple-8b files of a corpus in ascending id order, and their reader.

A word of 64 bits has a selector in its top 4 bits and 1 to 60 equally wide values in the others. Values of more than
60 bits are escapes: the word holds their index in the segment's own list. Words start anew every BLOCK ids, and a
segment lists where each block's words begin, so that blocks are packed and unpacked side by side by numpy.

Segments are rows of a Parquet table (part, seq, n_ids, payload): Spark's writer brings them to any store.
"""

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import encoder
from .shared import write_table

BLOCK = 256
SEGMENT_IDS = 1 << 19
#: Fixed values of the coding: how many values of how many bits each selector packs; selector 15 is the escape.
COUNTS = np.array([60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1, 0, 1])
BITS = np.array([1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60, 0, 60])
ESCAPE = 15
_HEAD = struct.Struct("<4sHHQQQQ")
MAGIC = b"S8BW"


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, word offset of each block and of the end, escaped values) of unsigned 64-bit values."""
    values = np.asarray(values, np.uint64)
    n = len(values)
    blocks = -(-n // BLOCK)
    rows = np.zeros((blocks, BLOCK + 60), np.uint64)
    flat = np.zeros(blocks * BLOCK, np.uint64)
    flat[:n] = values
    rows[:, :BLOCK] = flat.reshape(blocks, BLOCK)
    wide = np.zeros(rows.shape, np.uint8)
    for b in np.unique(BITS[:14]):
        wide += rows >= np.uint64(1 << int(b))  # the number of widths that are too small
    steps = np.unique(BITS[:14])
    # best[i]: the selector with most values that all fit, from the largest window down
    best = np.full((blocks, BLOCK), ESCAPE, np.uint8)
    windows, size = {1: wide}, 1
    while size < 60:
        last = windows[size]
        windows[2 * size] = np.maximum(last[:, : last.shape[1] - size], last[:, size:])
        size *= 2
    for s in range(13, -1, -1):
        count, p = int(COUNTS[s]), 1 << (int(COUNTS[s]).bit_length() - 1)
        top = np.maximum(windows[p][:, :BLOCK], windows[p][:, count - p : count - p + BLOCK])
        best[top <= np.searchsorted(steps, BITS[s])] = s
    ends = np.full(blocks, BLOCK)
    if n % BLOCK:
        ends[-1] = n % BLOCK
    at, live, found = np.zeros(blocks, np.int64), np.arange(blocks), []
    while len(live):
        chosen = best[live, at[live]]
        found.append((live, at[live], chosen))
        at[live] += COUNTS[chosen]
        live = live[at[live] < ends[live]]
    if not found:
        return np.zeros(0, np.uint64), np.zeros(1, np.int64), np.zeros(0, np.uint64)
    step = np.repeat(np.arange(len(found)), [len(x[0]) for x in found])
    row, start, chosen = (np.concatenate(x) for x in zip(*found))
    offsets = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=blocks))])
    words = np.zeros(len(row), np.uint64)
    escapes = np.zeros(0, np.uint64)
    for s in np.unique(chosen).tolist():
        mine = np.flatnonzero(chosen == s)
        taken = rows[row[mine, None], start[mine, None] + np.arange(COUNTS[s])]
        if s == ESCAPE:
            escapes, taken = taken[:, 0], np.arange(len(mine), dtype=np.uint64)[:, None]
        shifts = (np.arange(COUNTS[s]) * BITS[s]).astype(np.uint64)
        words[offsets[row[mine]] + step[mine]] = np.bitwise_or.reduce(taken << shifts, axis=1) | np.uint64(s << 60)
    return words, offsets, escapes


def unpack(words: np.ndarray, offsets: np.ndarray, escapes: np.ndarray, n: int, first: int = 0, last: int | None = None) -> np.ndarray:
    """The values of blocks ``first`` to ``last`` (all by default) of ``n`` packed values."""
    last = len(offsets) - 1 if last is None else last
    words = words[offsets[first] : offsets[last]]
    chosen = (words >> np.uint64(60)).astype(np.int64)
    block = np.repeat(np.arange(last - first), np.diff(offsets[first : last + 1]))
    ends = np.cumsum(COUNTS[chosen])
    begin = np.concatenate([[0], ends])[offsets[first:last] - offsets[first]]
    at = ends - COUNTS[chosen] - begin[block]
    out = np.zeros((last - first, BLOCK + 60), np.uint64)
    for s in np.unique(chosen).tolist():
        mine = np.flatnonzero(chosen == s)
        shifts = (np.arange(COUNTS[s]) * BITS[s]).astype(np.uint64)
        values = (words[mine, None] & np.uint64((1 << 60) - 1)) >> shifts & np.uint64((1 << int(BITS[s])) - 1)
        out[block[mine, None], at[mine, None] + np.arange(COUNTS[s])] = escapes[values.astype(np.int64)] if s == ESCAPE else values
    return out[:, :BLOCK].reshape(-1)[: max(0, min(n, last * BLOCK) - first * BLOCK)]


def write_segment(doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray) -> bytes:
    words, offsets, escapes = pack(ids)
    known = np.array([d is not None for d in doc_ids], np.uint8)
    names = np.array([d or 0 for d in doc_ids], "<i8")
    head = _HEAD.pack(MAGIC, 1, BLOCK, len(doc_ids), len(ids), len(words), len(escapes))
    return b"".join([head, names.tobytes(), counts.astype("<i8").tobytes(), offsets.astype("<i8").tobytes(), words.astype("<u8").tobytes(), escapes.astype("<u8").tobytes(), known.tobytes()])


def read_segment(raw: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """The documents' ids, their numbers of token ids, and all token ids."""
    magic, version, block, docs, n, n_words, n_escapes = _HEAD.unpack_from(raw)
    if (magic, version, block) != (MAGIC, 1, BLOCK):
        raise ValueError("not a token segment of this version")
    at, parts = _HEAD.size, []
    for kind, size in (("<i8", docs), ("<i8", docs), ("<i8", -(-n // BLOCK) + 1), ("<u8", n_words), ("<u8", n_escapes), ("u1", docs)):
        parts.append(np.frombuffer(raw, kind, size, at))
        at += parts[-1].nbytes
    names, counts, offsets, words, escapes, known = parts
    return [d if k else None for d, k in zip(names.tolist(), known.tolist())], counts, unpack(words, offsets, escapes, n)


def encoded_rows(batch: pa.RecordBatch, id_col: str, text_col: str, tokenizer: str, end_id: int) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """(ids of documents, counts, token ids with an end id after each document) of stretches of a batch."""
    names = batch.column(batch.schema.names.index(id_col)).to_pylist()
    for a, b, ids, cut in encoder(tokenizer).encode(batch.column(batch.schema.names.index(text_col))):
        yield names[a:b], np.diff(cut) + 1, np.insert(ids, cut[1:], end_id)


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, str]:
    """Encode whole texts and write them as segments in ascending id order; returns the reread segments and their path.

    A null text is empty (its end id alone), null ids come first, and equal ids stand side by side in no set order.
    Segments end with a document, so one document's ids are never apart. An empty table gives an empty one.
    """
    keyed = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"), F.monotonically_increasing_id().alias("__row"))
    ordered = keyed.repartitionByRange("__id", "__row").sortWithinPartitions("__id", "__row")

    def segments(batches):
        part, seq, names, counts, ids, held = TaskContext.get().partitionId(), 0, [], [], [], 0
        for batch in batches:
            for n, c, x in encoded_rows(batch, "__id", "__text", tokenizer, end_id):
                names += n
                counts.append(c)
                ids.append(x)
                held += len(x)
                if held >= SEGMENT_IDS:
                    yield _segment_row(part, seq, names, counts, ids)
                    seq, names, counts, ids, held = seq + 1, [], [], [], 0
        if names:
            yield _segment_row(part, seq, names, counts, ids)

    return write_table(ordered.mapInArrow(segments, "part int, seq int, n_ids long, payload binary"), "tokens", "uncompressed")


def _segment_row(part, seq, names, counts, ids):
    ids = np.concatenate(ids)
    payload = write_segment(names, np.concatenate(counts), ids)
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([len(ids)], pa.int64()), pa.array([payload], pa.binary())], ["part", "seq", "n_ids", "payload"])


def read_tokens(segments: DataFrame, with_ids: bool = False) -> DataFrame:
    """A row per document of the segments: doc_id, start (ids of all documents before), n_tokens, ids_crc32, part, seq.

    With ``with_ids`` also the ids themselves, as an array.
    """
    parts = segments.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    within = Window.partitionBy("part").orderBy("seq")
    # The heads alone are summed; payloads are read where they lie.
    heads = segments.select("part", "seq", "n_ids").withColumn("skip", F.sum("n_ids").over(within) - F.col("n_ids"))
    starts = heads.join(before, "part").select("part", "seq", (F.col("base") + F.col("skip")).alias("first"))

    def rows(batches):
        for batch in batches:
            for part, seq, raw in zip(*(batch.column(i).to_pylist() for i in (0, 1)), batch.column(2)):
                names, counts, ids = read_segment(raw.as_py())
                ends = np.cumsum(counts)
                flat = ids.astype("<u4")
                cut = (ends * 4).tolist()
                view = memoryview(flat.tobytes())
                crc = [zlib.crc32(view[a:b]) for a, b in zip([0, *cut], cut)]
                data = [pa.array(names, pa.int64()), pa.array(ends - counts), pa.array(counts), pa.array(crc, pa.int64())]
                data += [pa.array([part] * len(names), pa.int32()), pa.array([seq] * len(names), pa.int32())]
                if with_ids:
                    data.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids.astype(np.int64))))
                yield pa.RecordBatch.from_arrays(data, [*"iscnpqx"[: len(data)]])

    schema = "i long, s long, c long, n long, p int, q int" + (", x array<long>" if with_ids else "")
    docs = segments.select("part", "seq", "payload").mapInArrow(rows, schema)
    found = docs.join(starts, (docs.p == starts.part) & (docs.q == starts.seq))
    return found.select(F.col("i").alias("doc_id"), (F.col("first") + F.col("s")).alias("start"), F.col("c").alias("n_tokens"), F.col("n").alias("ids_crc32"), "part", "seq", *[F.col("x").alias("ids")] * with_ids)
