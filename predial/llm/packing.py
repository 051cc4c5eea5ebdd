"""Best-fit packing of token sequences by minimum bin slack.

The fullest feasible combination of the available lengths is found per bin by a bitset subset-sum over the lengths'
counts, seeded with the longest length left. All that this needs is the number of pieces of each length - at most
``capacity`` numbers, whatever the corpus's size - and a combination is reused as often as its lengths last, so the
driver's work is bounded by the capacity. Pieces find their places by their rank among the pieces of their length.
"""

import zlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import write_table
from .token_files import encoded_rows

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long"


def fullest(counts: dict[int, int], capacity: int, seed: int) -> list[tuple[int, int]]:
    """(length, times) of a combination of ``seed`` and other available lengths that fills ``capacity`` best.

    counts: how many pieces there are of each length. Among equally full combinations, longer lengths go first.
    """
    room = capacity - seed
    mask = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for length in sorted(counts, reverse=True):
        if length > room:
            continue
        left = min(counts[length] - (length == seed), room // length)
        times = 1
        while left > 0:
            times = min(times, left)
            steps.append((length, times, reach))
            reach |= (reach << (length * times)) & mask
            left -= times
            times *= 2
        if reach >> room & 1:
            break
    total, used = reach.bit_length() - 1, {seed: 1}
    for length, times, before in reversed(steps):
        if not before >> total & 1:
            total -= length * times
            used[length] = used.get(length, 0) + times
    return sorted(used.items(), reverse=True)


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first rank, end rank, first sequence, pieces of the length per sequence, offset of the first)."""
    counts = {n: c for n, c in counts.items() if c}
    ranks, rows, sequence = dict.fromkeys(counts, 0), [], 0
    while counts:
        combination = fullest(counts, capacity, max(counts))
        bins = min(counts[n] // k for n, k in combination)
        offset = 0
        for n, k in combination:
            rows.append((n, ranks[n], ranks[n] + bins * k, sequence, k, offset))
            ranks[n] += bins * k
            counts[n] -= bins * k
            if not counts[n]:
                del counts[n]
            offset += n * k
        sequence += bins
    return rows


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode whole texts and cut those longer than ``capacity``: full pieces, but for the first, which may be shorter."""

    def cut(batches: Iterable[pa.RecordBatch]):
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for names, counts, ids in encoded_rows(batch, "__id", "__text", tokenizer, end_id):
                many = -(-counts // capacity)
                doc = np.repeat(np.arange(len(counts)), many)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
                end = counts[doc] - (many[doc] - 1 - piece) * capacity
                start = np.where(piece == 0, 0, end - capacity)
                length = end - start
                base = (np.cumsum(counts) - counts)[doc]
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[a:b]) for a, b in zip((4 * (base + start)).tolist(), (4 * (base + end)).tolist())]
                order = np.argsort(length, kind="stable")
                again = np.bincount(length, minlength=capacity + 1)
                rank = np.empty(len(doc), np.int64)
                rank[order] = np.arange(len(doc)) - np.repeat(np.cumsum(again) - again, again)
                rank += seen[length]
                seen += again
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names, pa.int64()).take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(np.full(len(doc), part, np.int32)), pa.array(rank)],
                    ["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank"],
                )

    return docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).mapInArrow(cut, PIECES)


def pack(found: DataFrame, capacity: int = 1024) -> DataFrame:
    """Give each piece (of pieces(), or any rows with length, part and rank from 0 within part and length) its place.

    Adds sequence_id and offset and drops part and rank. Lengths must be from 1 to ``capacity``. Equal pieces are
    placed each on its own; an empty table stays empty.
    """
    found, _ = write_table(found, "pieces")
    spark = found.sparkSession
    per_part = found.groupBy("length", "part").agg(F.count("*").alias("n"))
    base = per_part.select("length", "part", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("base"))
    # At most ``capacity`` rows: the number of pieces of each length.
    counts = {r.length: r.n for r in per_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table = sorted(plan(counts, capacity))
    rows = np.array(table, np.int64).reshape(-1, 6)
    keys = rows[:, 0] * (1 << 48) + rows[:, 1]
    plans = spark.sparkContext.broadcast((keys, rows))

    def place(batches):
        keys, rows = plans.value
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("__at").to_numpy()
            row = rows[np.searchsorted(keys, length * (1 << 48) + rank, "right") - 1]
            nth, slot = (rank - row[:, 1]) // row[:, 4], (rank - row[:, 1]) % row[:, 4]
            kept = batch.select([c for c in batch.schema.names if c != "__at"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(row[:, 3] + nth), pa.array(row[:, 5] + slot * length)], [*kept.schema.names, "sequence_id", "offset"])

    placed = found.join(base, ["length", "part"]).withColumn("__at", F.col("rank") + F.col("base")).drop("part", "rank", "base")
    fields = [f.simpleString().replace(":", " ", 1) for f in placed.drop("__at").schema.fields]
    return placed.mapInArrow(place, ", ".join([*fields, "sequence_id long", "offset long"]))


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack whole documents into as few sequences of at most ``capacity`` tokens as this method finds.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset, a row per piece. A null text is empty (one
    piece of the end id alone); a null id stays null; repeated rows are packed each.
    """
    return pack(pieces(docs, tokenizer, capacity, end_id, id_col, text_col), capacity)
