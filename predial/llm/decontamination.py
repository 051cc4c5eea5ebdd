"""Benchmark decontamination by spaced seeds.

Each fixed mask hashes some of the words in a window and ignores the others, so a hit survives substituted words. The
hashes of benchmark and corpus are joined inside the scan of the corpus, and around each hit the two word sequences
are compared place by place: the longest stretch that is alike enough decides. The benchmark goes to the tasks in blocks of bounded size: a benchmark of any size takes
as many passes as it has blocks, and no row of the corpus is ever shuffled.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import ALNUM, mix, seeded, text_bytes, words

#: The places that each mask looks at.
MASKS = ((0, 1, 2, 3, 4), (0, 1, 3, 4, 6), (0, 2, 3, 5, 7), (0, 1, 4, 6, 8))
BLOCK_BYTES = 4 << 20
STRETCH = 1 << 20
#: A seed that an item has more often than this is compared over ranges of shifts; words of a text taken together for it; cells compared at once.
OFTEN = 4
CHUNK = 64
CELLS = 1 << 20
HITS = "doc_id long, item_id long, n_matched long, n_aligned long, item_words long, first_word long, last_word long"


class Index:
    """The seeds of one block of the benchmark."""

    def __init__(self, item_ids: list, texts: pa.Array, min_words: int):
        self.h, self.rows = words(texts, ALNUM)
        self.items, self.min_words = item_ids, min_words
        lengths = np.diff(self.rows)
        #: Items too short for a mask are sought whole; those under ``SHORTEST`` words mark nothing.
        self.masks = [*MASKS, *(tuple(range(n)) for n in sorted({int(n) for n in lengths if n < len(MASKS[0]) and n >= SHORTEST}))]
        keys, where = [], []
        for m, mask in enumerate(self.masks):
            seeds = windows(self.h, mask, m)
            at = np.arange(len(seeds))
            item = np.searchsorted(self.rows, at, "right") - 1
            ok = at + mask[-1] < self.rows[item + 1]
            if m >= len(MASKS):
                ok &= lengths[item] == len(mask)
            keys.append(seeds[ok])
            where.append(at[ok])
        keys, where = np.concatenate(keys), np.concatenate(where)
        self.bits = max(16, int(len(keys) * 32 + 1).bit_length())
        self.marked = np.zeros(1 << self.bits, bool)
        self.marked[(keys >> np.uint64(64 - self.bits)).astype(np.int64)] = True
        # A seed that one item has often is kept once, with its first and last place there.
        item = np.searchsorted(self.rows, where, "right") - 1
        order = np.lexsort((where, item, keys))
        keys, where, item = keys[order], where[order], item[order]
        new = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (item[1:] != item[:-1])])) if len(keys) else np.zeros(0, np.int64)
        many = np.diff(np.append(new, len(keys)))
        often = many > OFTEN
        self.often_keys, self.often_item, self.often_first, self.often_last = keys[new[often]], item[new[often]], where[new[often]], where[(new + many - 1)[often]]
        once = ~np.repeat(often, many)
        self.keys, self.where = keys[once], where[once]

    def find(self, h: np.ndarray, rows: np.ndarray) -> list[tuple[int, int, int, int, int, int]]:
        """(row, item, matched, aligned, first word, last word): the best stretch of each row and item that overlap."""
        row_of, item_of, shift, runs = [], [], [], []
        for m, mask in enumerate(self.masks):
            seeds = windows(h, mask, m)
            at = np.flatnonzero(self.marked[(seeds >> np.uint64(64 - self.bits)).astype(np.int64)])
            low, high = np.searchsorted(self.keys, seeds[at], "left"), np.searchsorted(self.keys, seeds[at], "right")
            row = np.searchsorted(rows, at, "right") - 1
            ok = (high > low) & (at + mask[-1] < rows[row + 1])
            runs.append(self._runs(seeds, at, row, rows, mask))
            at, low, many, row = at[ok], low[ok], (high - low)[ok], row[ok]
            each = np.repeat(np.arange(len(at)), many)
            place = self.where[low[each] + np.arange(len(each)) - np.repeat(np.cumsum(many) - many, many)]
            row_of.append(row[each])
            item_of.append(np.searchsorted(self.rows, place, "right") - 1)
            shift.append(at[each] - place)
        found = np.unique(np.stack([np.concatenate(x) for x in (row_of, item_of, shift)]), axis=1)
        best: dict[tuple[int, int], tuple[int, int, int, int]] = {}  # most matches, then first, then shortest
        for row, item, by in found.T.tolist():
            a, b = int(self.rows[item]), int(self.rows[item + 1])
            low, high = max(a, int(rows[row]) - by), min(b, int(rows[row + 1]) - by)
            same, least = self.h[low:high] == h[low + by : high + by], min(self.min_words, b - a)
            matched, first, last = densest(same)
            if last - first + 1 < least:
                matched, first, last = longest(same)
            aligned = last - first + 1
            base = low + by - int(rows[row])
            if aligned >= least and (matched, -(base + first), -aligned) > best.get((row, item), (0, 0, 0))[:3]:
                best[row, item] = (matched, -(base + first), -aligned, base + last)
        for row, item, low, high in merged(np.concatenate(runs, axis=1)):
            self._slide(h, int(rows[row]), int(rows[row + 1]), item, low, high, row, best)
        return [(row, item, m, -n, -first, last) for (row, item), (m, first, n, last) in best.items()]

    def _runs(self, seeds: np.ndarray, at: np.ndarray, row: np.ndarray, rows: np.ndarray, mask: tuple[int, ...]) -> np.ndarray:
        """(row, item, first shift, last shift) around the words whose seeds an item has often, CHUNK words at a time."""
        at, row = (x[(at + mask[-1] < rows[row + 1]) & np.isin(seeds[at], self.often_keys)] for x in (at, row))
        if not len(at):
            return np.zeros((4, 0), np.int64)
        order = np.lexsort((at, seeds[at], at // CHUNK, row))
        at, row = at[order], row[order]
        key = seeds[at]
        new = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (row[1:] != row[:-1]) | (at[1:] // CHUNK != at[:-1] // CHUNK)]))
        last = np.append(new[1:], len(at)) - 1
        low, high = np.searchsorted(self.often_keys, key[new], "left"), np.searchsorted(self.often_keys, key[new], "right")
        each = np.repeat(np.arange(len(new)), high - low)
        one = low[each] + np.arange(len(each)) - np.repeat(np.cumsum(high - low) - (high - low), high - low)
        return np.stack([row[new][each], self.often_item[one], at[new][each] - self.often_last[one], at[last][each] - self.often_first[one]])

    def _slide(self, h: np.ndarray, begin: int, end: int, item: int, low: int, high: int, row: int, best: dict) -> None:
        """Compare one item with all shifts from ``low`` to ``high`` of one row, many shifts at once."""
        a, b = int(self.rows[item]), int(self.rows[item + 1])
        n, own, least = b - a, self.h[a:b], min(self.min_words, b - a)
        low, high = max(low, begin - b + 1), min(high, end - a - 1)
        step = max(1, CELLS // n)
        for first in range(low, high + 1, step):
            shifts = np.arange(first, min(first + step, high + 1))
            at = shifts[:, None] + np.arange(a, b)[None, :]
            # Places outside the row count as words that differ, which no best stretch has at its ends.
            same = (h[np.clip(at, begin, end - 1)] == own[None, :]) & (at >= begin) & (at < end)
            hits = np.cumsum(same, axis=1)
            near = np.flatnonzero(hits[:, -1] * 4 >= least * 3)
            if not len(near):
                continue
            same, hits = same[near], np.concatenate([np.zeros((len(near), 1), np.int64), hits[near]], axis=1)
            score = np.concatenate([np.zeros((len(near), 1), np.int64), np.cumsum(np.where(same, 1, -3), axis=1)], axis=1)
            lowest = np.minimum.accumulate(score, axis=1)
            fresh = np.concatenate([np.ones((len(near), 1), bool), lowest[:, 1:] < lowest[:, :-1]], axis=1)
            start = np.maximum.accumulate(np.where(fresh, np.arange(n + 1)[None, :], 0), axis=1)
            stop = np.argmax(score - lowest, axis=1)
            each = np.arange(len(near))
            start = start[each, stop]
            matched = hits[each, stop] - hits[each, start]
            for i in np.flatnonzero(stop - start < least).tolist():
                if int(hits[i, -1]) >= best.get((row, item), (0, 0))[0]:  # the longest stretch may still beat the best so far
                    inside = slice(max(0, begin - int(shifts[near[i]]) - a), min(n, end - int(shifts[near[i]]) - a))
                    matched[i], start[i], last = longest(same[i, inside])
                    start[i], stop[i] = start[i] + inside.start, last + 1 + inside.start
            good = np.flatnonzero(stop - start >= least)
            if len(good):
                base = shifts[near] + a - begin
                i = good[np.lexsort(((stop - start)[good], (base + start)[good], -matched[good]))[0]]
                found = (int(matched[i]), -int(base[i] + start[i]), -int(stop[i] - start[i]))
                if found > best.get((row, item), (0, 0, 0))[:3]:
                    best[row, item] = (*found, int(base[i] + stop[i] - 1))


def merged(runs: np.ndarray) -> list[tuple[int, int, int, int]]:
    """Ranges of shifts by row and item, those that touch as one."""
    out: list[tuple[int, int, int, int]] = []
    for row, item, low, high in runs[:, np.lexsort((runs[2], runs[1], runs[0]))].T.tolist():
        if out and out[-1][:2] == (row, item) and low <= out[-1][3] + 1:
            out[-1] = (row, item, out[-1][2], max(high, out[-1][3]))
        else:
            out.append((row, item, low, high))
    return out


SHORTEST = 3


def windows(h: np.ndarray, mask: tuple[int, ...], number: int) -> np.ndarray:
    """The seed that begins at each word, those that would leave the array left out."""
    n = max(0, len(h) - mask[-1])
    total = np.full(n, number, np.uint64)
    for place, factor in zip(mask, seeded(len(mask), 31)):
        total = total + h[place : place + n] * factor
    return mix(total)


def densest(same: np.ndarray) -> tuple[int, int, int]:
    """(matches, first, last) of the stretch with most matches when a mismatch costs three: over 75 % of it matches."""
    score = np.concatenate([[0], np.cumsum(np.where(same, 1, -3))])
    low = np.minimum.accumulate(score)
    end = int(np.argmax(score - low))
    start = int(np.flatnonzero(score[: end + 1] == low[end])[0])
    return int(same[start:end].sum()), start, end - 1


def longest(same: np.ndarray) -> tuple[int, int, int]:
    """(matches, first, last) of the first longest stretch of which at least 75 % match."""
    score = np.concatenate([[0], np.cumsum(np.where(same, 1, -3))])
    starts = np.searchsorted(-np.minimum.accumulate(score), -score, "left")
    end = int(np.argmax(np.arange(len(score)) - starts))
    start = int(starts[end])
    return int(same[start:end].sum()), start, end - 1


def blocks(benchmark: DataFrame, id_col: str, text_col: str):
    """The benchmark's rows in blocks of about BLOCK_BYTES, one at a time on the driver."""
    rows = benchmark.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t"))
    size = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = -(-size // BLOCK_BYTES)
    for b in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("t", "i"), F.lit(n)) == b)
        yield part.where("t is not null").toArrow()


def overlaps(docs: DataFrame, benchmark: DataFrame, min_words: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """A row for each document and benchmark item that share a stretch of at least ``min_words`` words (or the whole item).

    Words are lower-cased runs of letters, digits and non-ASCII; at least three quarters of the stretch's words are
    equal place by place. The densest stretch is reported where it is long enough, else the longest; among equally good
    stretches the first counts. Items of fewer than SHORTEST words and null texts
    on either side match nothing; rows with a null id on either side are matched and carry that null; repeated rows
    are reported each; an empty table on either side gives none.
    """
    spark, narrow = docs.sparkSession, docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).alias("__text"))
    found = [narrow.mapInArrow(_finder(spark, block, min_words), HITS) for block in blocks(benchmark, item_col, item_text_col)]
    if not found:
        return spark.createDataFrame([], HITS)
    out = found[0]
    for more in found[1:]:
        out = out.unionAll(more)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, min_words: int = 10, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The documents, with all their columns, that overlap with no benchmark item (as overlaps() defines it)."""
    out, at = docs, docs.columns.index(text_col)
    for block in blocks(benchmark, item_col, item_text_col):
        shared = docs.sparkSession.sparkContext.broadcast(Index(block.column("i").to_pylist(), block.column("t"), min_words))

        def keep(batches, shared=shared):
            for batch in batches:
                good = np.ones(batch.num_rows, bool)
                for a, _, h, rows in stretches(batch.column(at)):
                    good[[a + x[0] for x in shared.value.find(h, rows)]] = False
                yield batch.filter(pa.array(good))

        out = out.mapInArrow(keep, docs.schema)
    return out


def stretches(column: pa.Array):
    """(first row, last row + 1, word hashes, word offsets of the rows) of about STRETCH bytes each."""
    _, offsets = text_bytes(column)
    at, n = 0, len(offsets) - 1
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + STRETCH, "right")) - 1)
        yield (at, end, *words(column.slice(at, end - at), ALNUM))
        at = end


def _finder(spark, block, min_words):
    shared = spark.sparkContext.broadcast(Index(block.column("i").to_pylist(), block.column("t"), min_words))

    def find(batches):
        index = shared.value
        lengths = np.diff(index.rows)
        for batch in batches:
            names = batch.column(0).to_pylist()
            for a, _, h, rows in stretches(batch.column(1)):
                if hits := index.find(h, rows):
                    row, item, matched, aligned, first, last = zip(*hits)
                    columns = [[names[a + r] for r in row], [index.items[i] for i in item], matched, aligned, lengths[list(item)].tolist(), first, last]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], [f.split()[0] for f in HITS.split(", ")])

    return find
