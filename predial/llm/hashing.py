"""Vectorised word splitting and 64-bit hashing over the byte buffers of Arrow string columns.

Words are cut and hashed straight from UTF-8 bytes with numpy, a few megabytes at a time, so a task's
memory does not depend on the length of its longest text (beyond the arrays of words themselves).
"""

import zlib
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa

CHUNK = 1 << 18
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_GOLD = 0x9E3779B97F4A7C15
BASE = 0xD6E8FEB86659FD93
MASK64 = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x = x ^ (x >> np.uint64(27))
    x = x * _M2
    return x ^ (x >> np.uint64(31))


def seeded(n: int, seed: int) -> np.ndarray:
    """``n`` fixed pseudo-random odd 64-bit numbers."""
    at = (np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed * 1_000_003)) * np.uint64(_GOLD)
    return mix(at) | np.uint64(1)


@lru_cache(1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(BASE, -1, 1 << 64)
    up, down = np.full(CHUNK + 1, BASE, np.uint64), np.full(CHUNK + 1, inverse, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


class Rule(NamedTuple):
    """How bytes become words: which bytes separate, and the byte each one counts as."""

    separator: np.ndarray
    value: np.ndarray


def _rule(separators: bytes) -> Rule:
    cut = np.zeros(256, bool)
    cut[list(separators)] = True
    fold = np.arange(256)
    fold[65:91] += 32
    return Rule(cut, seeded(256, 7)[fold])


#: Lower-cased words between white space: [^\x20\x09-\x0D]+
SPACE = _rule(bytes([32, *range(9, 14)]))
#: Lower-cased words of letters, digits and all non-ASCII: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing
ALNUM = _rule(bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))
#: Runs of ASCII punctuation: what neither ALNUM's words nor white space and control characters take.
PUNCTUATION = _rule(bytes([*range(33), *range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x7F, 0x100)]))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column (null: empty) and the n + 1 offsets of its rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _pieces(data: np.ndarray, offsets: np.ndarray, cut: np.ndarray):
    """Stretches of about CHUNK bytes that end at a separator or a row's end."""
    at, n = 0, len(data)
    while at < n:
        end = min(at + CHUNK, n)
        if end < n:
            row = int(offsets[np.searchsorted(offsets, end, "right") - 1])
            gap = np.flatnonzero(cut[data[at:end]][::-1][: 1 << 12])
            end = max(row, end - int(gap[0]) if len(gap) else 0)
            if end <= at:  # one word fills the stretch
                end = at + CHUNK
                while end < n and not cut[data[end]] and end != int(offsets[np.searchsorted(offsets, end)]):
                    end += 1
        yield at, end
        at = end


class Words(NamedTuple):
    """All words of all rows in order: hashes, the n + 1 word offsets of the rows, and byte offsets in the column."""

    hash: np.ndarray
    rows: np.ndarray
    start: np.ndarray
    end: np.ndarray


def _stretch(part, first, last, rule):
    """Hashes, starts and ends of the words in bytes that begin and end with a row or at a separator."""
    up, down = _powers()
    inside = ~rule.separator[part]
    before = np.empty(len(part), bool)
    before[0], before[1:] = True, ~inside[:-1]
    after = np.empty(len(part), bool)
    after[-1], after[:-1] = True, ~inside[1:]
    s = np.flatnonzero(inside & (before | first))
    e = np.flatnonzero(inside & (after | last)) + 1
    if len(part) > CHUNK:  # only a single word can be so long
        return np.array([_long(part[i:j], rule) for i, j in zip(s, e)], np.uint64), s, e
    total = np.zeros(len(part) + 1, np.uint64)
    np.cumsum(rule.value[part] * up[: len(part)], out=total[1:])
    return mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64)), s, e


def all_words(column: pa.Array, rule: Rule) -> Words:
    """Every word of a string column (null: empty), cut and hashed about CHUNK bytes at a time."""
    data, offsets = text_bytes(column)
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    parts = []
    for at, end in _pieces(data, offsets, rule.separator):
        h, s, e = _stretch(data[at:end], first[at:end], first[at + 1 : end + 1], rule)
        parts.append((h, s + at, e + at))
    if not parts:
        parts = [(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))]
    h, s, e = map(np.concatenate, zip(*parts))
    return Words(h, np.searchsorted(s, offsets), s, e)


def words(column: pa.Array, rule: Rule) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of all rows in order, and the n + 1 word offsets of the rows."""
    found = all_words(column, rule)
    return found.hash, found.rows


def _long(part: np.ndarray, rule: Rule) -> int:
    total, shift = 0, 1
    up, _ = _powers()
    for at in range(0, len(part), CHUNK):
        piece = part[at : at + CHUNK]
        total += int((rule.value[piece] * up[: len(piece)]).sum(dtype=np.uint64)) * shift
        shift = shift * pow(BASE, CHUNK, 1 << 64) & MASK64
    return int(mix(np.array([(total + len(part)) & MASK64], np.uint64))[0])


def shingles(h: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's k-word shingles, repeats included, and their row offsets.

    A row of 1 to k - 1 words has its whole sequence as one shingle; a row without words has none.
    """
    n = np.diff(rows)
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    out_rows = np.concatenate([[0], np.cumsum(count)])
    coef = seeded(k, 11)
    start = np.repeat(rows[:-1] - out_rows[:-1], count) + np.arange(out_rows[-1])
    width = np.repeat(np.minimum(n, k), count)
    total = np.zeros(len(start), np.uint64)
    last = max(len(h) - 1, 0)
    for j in range(k):
        here = h[np.minimum(start + j, last)] * coef[j] if len(h) else total
        total = total + (here if not len(width) or width.min() > j else np.where(width > j, here, np.uint64(0)))
    return mix(total + width.astype(np.uint64)), out_rows


def crc_mod(ids: pa.Array, divisor: int) -> np.ndarray:
    """crc32(id as text) mod ``divisor``; -1 for a null id."""
    return np.array([-1 if i is None else zlib.crc32(str(i).encode()) % divisor for i in ids.to_pylist()], np.int64)
