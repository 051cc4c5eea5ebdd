"""Byte-level BPE ids of whole texts, by the tokenizers library, for Spark tasks.

A byte-level pre-tokenizer always breaks before a single blank or line feed that stands between two other
characters, and between a letter or digit and ASCII punctuation that ends a word. So a text whose white space is
single can be cut there, each distinct piece has to be encoded by the library only once per worker, and the ids of
the text are the ids of its pieces, gathered by numpy from a table of pieces (found by 64-bit hash). Any other text
(runs of white space, special tokens' strings) is given to the library whole.
"""

import os
from functools import lru_cache

import numpy as np
import pyarrow as pa

from .hashing import CHUNK, Rule, all_words, seeded, text_bytes

SLOTS = 1 << 22
PIECES = 3_000_000
_BLANKS = np.zeros(256, bool)
_BLANKS[[10, 32]] = True
_EXACT = Rule(_BLANKS, seeded(256, 23))
_SPACED, _FEED = np.uint64(0x5851F42D4C957F2C), np.uint64(0x14057B7EF767814E)
_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_UNSURE = ("\u180e", "\u200b", "\ufeff")


class _Table:
    """Open-addressing map from 64-bit key to a run of ids; length -1 marks a piece that can't stand alone."""

    def __init__(self):
        self.key, self.at = np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, np.int32)
        self.start, self.length = np.zeros(PIECES, np.int32), np.zeros(PIECES, np.int32)
        self.pool, self.used, self.n = np.zeros(1 << 16, "<u4"), 0, 0

    def find(self, keys: np.ndarray) -> np.ndarray:
        found = np.full(len(keys), -1, np.int64)
        slot = (keys & np.uint64(SLOTS - 1)).astype(np.int64)
        left = np.arange(len(keys))
        while len(left):
            there = self.key[slot]
            hit = there == keys[left]
            found[left[hit]] = self.at[slot[hit]]
            on = ~hit & (there != 0)
            left, slot = left[on], (slot[on] + 1) & (SLOTS - 1)
        return found

    def add(self, keys: np.ndarray, ids: list[np.ndarray | None]) -> None:
        flat = np.concatenate([x for x in ids if x is not None] or [np.zeros(0, "<u4")])
        while self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(len(self.pool), "<u4")])
        self.pool[self.used : self.used + len(flat)] = flat
        length = np.array([-1 if x is None else len(x) for x in ids], np.int32)
        here = np.arange(self.n, self.n + len(keys))
        self.length[here] = length
        self.start[here] = self.used + np.cumsum(np.maximum(length, 0)) - np.maximum(length, 0)
        self.used += len(flat)
        self.n += len(keys)
        slot = (keys & np.uint64(SLOTS - 1)).astype(np.int64)
        left = np.arange(len(keys))
        while len(left):
            free = self.key[slot] == 0
            self.key[slot[free]] = keys[left[free]]
            mine = self.key[slot] == keys[left]
            self.at[slot[mine]] = here[left[mine]]
            left, slot = left[~mine], (slot[~mine] + 1) & (SLOTS - 1)


class Encoder:
    """Ids of texts; remembers up to ``PIECES`` pieces, then starts anew."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.feed = self.whole("\n")
        text = "ab cd,\nef's 12 .x\né ü!!\nx"
        parts = ["ab", " cd", ",", "\n", "ef's", " 12", " .x", "\n", "é", " ü", "!!", "\n", "x"]
        self.cuts = len(self.feed) == 1 and np.array_equal(self.whole(text), np.concatenate([self.whole(p) for p in parts]))
        self.table = _Table()

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def _each(self, cores: list[str]) -> list[np.ndarray]:
        """The ids of each core: all in one text, cut apart at the line feeds' own id."""
        ids = self.whole("\n".join(cores))
        at = np.flatnonzero(ids == self.feed[0])
        if len(at) != len(cores) - 1:
            return [self.whole(c) for c in cores]
        return [x[1:] if i else x for i, x in enumerate(np.split(ids, at))]

    def _known(self, parts: list[str]) -> list[np.ndarray]:
        """The ids of each part, from the table or else from the library."""
        keys = np.array([hash(p) for p in parts], np.int64).view(np.uint64) & ~np.uint64(1) | np.uint64(2)
        keys, first, back = np.unique(keys, return_index=True, return_inverse=True)
        found = self.table.find(keys)
        if len(new := np.flatnonzero(found < 0)):
            texts = [parts[i] for i in first[new].tolist()]
            self.table.add(keys[new], [x for a in range(0, len(texts), 200) for x in self._each(texts[a : a + 200])])
            found[new] = self.table.find(keys[new])
        start, length, pool = self.table.start, self.table.length, self.table.pool
        ids = [pool[a : a + n] for a, n in zip(start[found].tolist(), length[found].tolist())]
        return [ids[i] for i in back.tolist()]

    def _learn(self, keys: np.ndarray, leads: list[str], texts: list[str]) -> None:
        """Add words that follow a blank, a line feed or a row's start: the word without ending punctuation, then that."""
        parts, many = [], []
        for lead, text in zip(leads, texts):
            core = text.rstrip(_PUNCTUATION)
            if not text.isascii() and (text.startswith(_UNSURE) or text.endswith(_UNSURE)) or text.strip() != text:
                many.append(0)
                continue
            own = [lead + core, text[len(core) :]] if core != text and core[-1:].isalnum() else [lead + text]
            if lead == "\n":
                own[:1] = ["\n", own[0][1:]]
            many.append(len(own))
            parts += own
        known, at, ids = self._known([p for p in parts if p != "\n"]), 0, []
        known = iter(known)
        for n in many:
            own = [self.feed if p == "\n" else next(known) for p in parts[at : at + n]]
            ids.append(own[0] if n == 1 else np.concatenate(own) if n else None)
            at += n
        self.table.add(keys, ids)

    def encode(self, column: pa.Array, step: int = 2 * CHUNK):
        """(first row, last row + 1, ids, row offsets of the ids) for stretches of rows of about ``step`` bytes."""
        data, offsets = text_bytes(column)
        at, n = 0, len(offsets) - 1
        while at < n:
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + step, "right")) - 1)
            yield (at, end, *self._stretch(column.slice(at, end - at), data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]))
            at = end

    def _stretch(self, column, data, offsets):
        n = len(offsets) - 1
        found = all_words(column, _EXACT)
        keys, rows, s, e = found.hash, found.rows, found.start, found.end
        # Rows whose blanks are single and inside: one word more than blanks.
        blanks = np.searchsorted(np.flatnonzero(_BLANKS[data]), offsets)
        even = (np.diff(rows) == np.diff(blanks) + 1) & self.cuts
        for special in self.special:
            mark, raw, where = special.encode(), data.tobytes(), -1
            while (where := raw.find(mark, where + 1)) >= 0:
                even[np.searchsorted(offsets, where, "right") - 1] = False
        if len(s):
            lead = np.where(data[np.maximum(s - 1, 0)] == 10, _FEED, _SPACED)
            lead[rows[:-1][np.diff(rows) > 0]] = 0
            keys = (keys ^ lead) | np.uint64(1)
        word = np.arange(len(s))
        if not even.all():
            word = np.flatnonzero(np.repeat(even, np.diff(rows)))
            keys = keys[word]
        found = self.table.find(keys)
        if (found < 0).any():
            missing = np.flatnonzero(found < 0)
            new, where = np.unique(keys[missing], return_index=True)
            if self.table.n + 2 * len(new) > PIECES:
                self.table = _Table()
                missing = np.arange(len(keys))
                new, where = np.unique(keys, return_index=True)
            if 2 * len(new) > PIECES:  # a stretch richer than the table: the library takes its rows whole
                even[:] = False
                word, keys = word[:0], keys[:0]
            else:
                at, raw = word[missing[where]], data.tobytes()
                kinds = {0: "", int(_FEED): "\n", int(_SPACED): " "}
                texts = [raw[a:b].decode() for a, b in zip(s[at].tolist(), e[at].tolist())]
                self._learn(new, [kinds[k] for k in lead[at].tolist()], texts)
            found = self.table.find(keys)
        length = self.table.length[found]
        if len(length) and length.min() < 0:
            even[np.searchsorted(rows, word[length < 0], "right") - 1] = False
            use = np.repeat(even, np.diff(rows))[word]
            found, length, word = found[use], length[use], word[use]
        ends = np.cumsum(length, dtype=np.int64)
        ids = self.table.pool[np.repeat(self.table.start[found] - (ends - length), length) + np.arange(ends[-1] if len(ends) else 0)]
        cut = np.concatenate([[0], ends])[np.searchsorted(word, rows)]
        counts = np.diff(cut)
        odd = np.flatnonzero(~even & (np.diff(offsets) > 0))
        if len(odd):
            parts, done = [], 0
            for r in odd.tolist():
                parts += [ids[cut[done] : cut[r]], x := self.whole(data[offsets[r] : offsets[r + 1]].tobytes().decode())]
                counts[r], done = len(x), r
            parts.append(ids[cut[done] :])
            ids = np.concatenate(parts)
        return ids, np.concatenate([[0], np.cumsum(counts)])


@lru_cache(4)
def encoder(path: str) -> Encoder:
    """This worker's encoder for the file at ``path``."""
    return Encoder(path)
