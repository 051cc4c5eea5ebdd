"""Exact token counts of every prefix of a text, by byte-level BPE, stored so that budgets are answered without encoding.

The tokens of a prefix are not the first tokens of the text, but they can be found one character after the other: the
encoding of a prefix is its last token, which is one alone, behind the encoding of what stands before that token. Two
tokens may stand side by side if no merge across their border would have come before the merges that built them. So one
pass over a word, with the last token of every shorter prefix at hand, gives the count at each of its prefixes. Words
are as the library's pre-tokenizer cuts them; where a prefix would be cut otherwise than the whole text (runs of white
space, contractions, strings of special tokens), the prefix's own cut counts.
"""

import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

#: Fixed value: how the byte-level pre-tokenizer cuts texts, its classes of letters, digits and marks in re's terms.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"
BLOCK_CHARS = 1 << 16
MOST_PIECES = 1_000_000
MOST_PAIRS = 4_000_000
ADDED = ("n_bytes", "n_chars", "n_tokens", "prefixes")
#: Of a block: characters, tokens before it, least count in it, byte planes, compressed bytes.
_HEAD = struct.Struct("<qqqBI")
_NEVER = 1 << 60


def byte_letters() -> dict[str, int]:
    """The letter that a byte-level vocabulary writes for each byte: itself where it prints, else the next from 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in prints]
    return {chr(b): b for b in prints} | {chr(256 + i): b for i, b in enumerate(others)}


class Merges:
    """Tokens as numbers: 0 to 255 the bytes, 256 + r the result of the r-th merge."""

    def __init__(self, merges: list[tuple[str, str]]):
        letters = byte_letters()
        number = {letter: byte for letter, byte in letters.items()}
        self.pair: dict[tuple[int, int], int] = {}
        self.parts: list[tuple[int, int] | None] = [None] * 256
        spelled = [bytes([b]) for b in range(256)]
        for a, b in merges:
            left, right = number[a], number[b]
            if a + b in number:
                raise ValueError("two merges give one token")
            number[a + b] = self.pair[left, right] = len(self.parts)
            self.parts.append((left, right))
            spelled.append(spelled[left] + spelled[right])
        # What can end a token: from a state and the byte before, the next state; and the token spelled on the way.
        self.before: dict[int, int] = {}
        self.token: list[int] = [-1]
        for t, text in enumerate(spelled):
            if self.encoded(text) != [t]:
                continue  # no text has this token
            state = 0
            for byte in reversed(text):
                key = state << 8 | byte
                if key not in self.before:
                    self.before[key] = len(self.token)
                    self.token.append(-1)
                state = self.before[key]
            self.token[state] = t
        self.beside: dict[int, bool] = {}

    def encoded(self, text: bytes) -> list[int]:
        """The tokens of a short text by merging, the first merge first."""
        tokens = list(text)
        while len(tokens) > 1:
            found = [self.pair.get(p, _NEVER) for p in zip(tokens, tokens[1:])]
            if (least := min(found)) == _NEVER:
                break
            at = found.index(least)
            tokens[at : at + 2] = [least]
        return tokens

    def _edge(self, token: int, side: int) -> list[int]:
        """The tokens that the outermost byte of one side goes through until it is in ``token``."""
        edge = [token]
        while (parts := self.parts[edge[-1]]) is not None:
            edge.append(parts[side])
        return edge[::-1]

    def fits(self, a: int, b: int) -> bool:
        """Whether ``b`` can follow ``a``: no merge across their border comes before the next one on either side.

        Of equal merges the leftmost comes first: the one inside ``a`` before the one across, that before the one inside ``b``.
        """
        key = a << 32 | b
        known = self.beside.get(key)
        if known is None:
            left, right = self._edge(a, 1), self._edge(b, 0)
            after_left, after_right = [*left[1:], _NEVER], [*right[1:], _NEVER]
            known = not any((m := self.pair.get((x, y))) is not None and m < p and m <= q for x, p in zip(left, after_left) for y, q in zip(right, after_right))
            if len(self.beside) >= MOST_PAIRS:
                self.beside.clear()
            self.beside[key] = known
        return known

    def counts(self, word: bytes) -> list[int]:
        """The number of tokens of every prefix of one word, byte by byte."""
        before, token, fits = self.before, self.token, self.fits
        last: list[int] = []
        count: list[int] = []
        for end in range(len(word)):
            state, start = 0, end
            while True:  # each byte is a token, so that some token fits before the walk ends
                state = before[state << 8 | word[start]]
                t = token[state]
                if t >= 0 and (start == 0 or fits(last[start - 1], t)):
                    break
                start -= 1
            last.append(t)
            count.append(count[start - 1] + 1 if start else 1)
        return count


class Counter:
    """Counts of prefixes by the tokenizers file at ``path``; remembers up to MOST_PIECES words, then starts anew."""

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        cut, model = spec["pre_tokenizer"] or {}, spec["model"]
        if cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True) or spec["normalizer"] or model["type"] != "BPE" or model.get("ignore_merges") or model.get("dropout"):
            raise ValueError("not a plain byte-level BPE tokenizer")
        added = spec["added_tokens"]
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
            raise ValueError("special tokens that take blanks or whole words")
        self.merges = Merges([tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]])
        self.cutter = Tokenizer.from_file(path).pre_tokenizer
        self.pattern = re.compile(PATTERN)
        self.special = re.compile("|".join(re.escape(t["content"]) for t in sorted(added, key=lambda t: -len(t["content"])))) if added else None
        self.marks = [t["content"] for t in added]
        self.kinds: dict[str, tuple[str, bool]] = {}
        self.odd: set[str] = set()
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.start, self.length, self.total = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)
        self.blank, self.leads, self.pool, self.used = np.zeros(1 << 12, bool), np.zeros(1 << 12, bool), np.zeros(1 << 16, np.int32), 0

    def kind(self, letter: str) -> tuple[str, bool]:
        """The library's class of a character, and whether re has another (superscripts, newer Unicode)."""
        if letter not in self.kinds:
            first = lambda cut: next((k for k, mate in (("letter", "a"), ("digit", "1"), ("mark", "!")) if len(cut(mate + letter)) == 1), "blank")
            ours, theirs = first(self.pattern.findall), first(self.cutter.pre_tokenize_str)
            self.kinds[letter] = theirs, ours != theirs
        return self.kinds[letter]

    def piece_counts(self, piece: str) -> list[int]:
        """The count at each character of one word of the pre-tokenizer."""
        raw = piece.encode()
        counts = self.merges.counts(raw)
        if len(raw) != len(piece):
            counts = [counts[i - 1] for i in range(1, len(raw) + 1) if i == len(raw) or raw[i] & 0xC0 != 0x80]
        if piece in ("'re", "'ve", "'ll"):
            counts[1] = 2  # an apostrophe and a letter: no contraction yet
        return counts

    def _learn(self, pieces: list[str]) -> None:
        """Remember words that are new and differ."""
        if not pieces:
            return
        counts = [self.piece_counts(p) for p in pieces]
        flat = np.array([c for cs in counts for c in cs], np.int32)
        n, at = len(pieces), len(self.number)
        while at + n > len(self.start):
            self.start, self.length, self.total = (np.concatenate([x, x]) for x in (self.start, self.length, self.total))
            self.blank, self.leads = np.concatenate([self.blank, self.blank]), np.concatenate([self.leads, self.leads])
        while self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, self.pool])
        self.pool[self.used : self.used + len(flat)] = flat
        self.length[at : at + n] = length = np.array([len(c) for c in counts])
        self.start[at : at + n] = self.used + np.cumsum(length) - length
        self.total[at : at + n] = [c[-1] for c in counts]
        self.blank[at : at + n] = [self.kind(p[-1])[0] == "blank" for p in pieces]
        self.leads[at : at + n] = [self.kind(p[0])[0] == "blank" for p in pieces]
        self.used += len(flat)
        self.number.update(zip(pieces, range(at, at + n)))

    def _pieces(self, text: str) -> list[str]:
        pieces = self.pattern.findall(text)
        if len(self.number) + len(pieces) > MOST_PIECES:
            self.forget()
        new = set(pieces).difference(self.number)
        self.odd.update(c for c in set().union(*new) if self.kind(c)[1])
        if any(c in text for c in self.odd):
            pieces = [text[a:b] for _, (a, b) in self.cutter.pre_tokenize_str(text)]
            new = set(pieces).difference(self.number)
        self._learn(list(new))
        return pieces

    def _plain(self, text: str) -> tuple[np.ndarray, str, int]:
        """Counts at each character of a text without special tokens, its last word and the tokens before that."""
        pieces = self._pieces(text)
        k = np.array(list(map(self.number.__getitem__, pieces)), np.int64)
        length, total = self.length[k], self.total[k]
        ends = np.cumsum(length)
        base = np.cumsum(total) - total
        counts = self.pool[np.repeat(self.start[k] - (ends - length), length) + np.arange(ends[-1])] + np.repeat(base, length)
        # A run of white space is one word while nothing follows it, so its last character belongs to the run.
        broken = np.flatnonzero(self.blank[k[:-1]] & self.leads[k[1:]]).tolist()
        runs = [pieces[i] + pieces[i + 1][0] for i in broken]
        whole = {r: self.piece_counts(r)[-1] for r in set(runs)}
        for i, run in zip(broken, runs):
            counts[ends[i]] = base[i] + whole[run]
        return counts, pieces[-1], int(base[-1])

    def counts(self, text: str) -> np.ndarray:
        """The number of tokens of text[:1], text[:2] and so on."""
        if not text:
            return np.zeros(0, np.int64)
        if self.special is None or not any(m in text for m in self.marks):
            return self._plain(text)[0]
        parts, at, done = [], 0, 0
        for hit in [*self.special.finditer(text), None]:
            upto = hit.start() if hit else len(text)
            last, before = "", done
            if upto > at:
                counts, last, base = self._plain(text[at:upto])
                parts.append(counts + done)
                before, done = done + base, done + int(counts[-1])
            if hit:
                # Inside the special token's string the prefix has but ordinary text, which the last word may go on into.
                mark = hit.group()
                parts.append(np.array([before + int(self.counts(last + mark[:j])[-1]) for j in range(1, len(mark))] + [done + 1]))
                at, done = hit.end(), done + 1
        return np.concatenate(parts)

    def blocks(self, text: str) -> Iterator[np.ndarray]:
        """counts() of about BLOCK_CHARS characters at a time: a text can be cut before a single blank between other characters."""
        if self.special is not None and any(m in text for m in self.marks):
            whole = self.counts(text)
            yield from (whole[a : a + BLOCK_CHARS] for a in range(0, len(whole), BLOCK_CHARS))
            return
        at, done, gap = 0, 0, re.compile(r"(?<=[A-Za-z0-9,.]) (?=[A-Za-z0-9])")
        while at < len(text):
            cut = gap.search(text, at + BLOCK_CHARS) if at + BLOCK_CHARS < len(text) else None
            end = cut.start() if cut else len(text)
            counts = self.counts(text[at:end]) + done
            yield from (counts[a : a + BLOCK_CHARS] for a in range(0, len(counts), BLOCK_CHARS))
            at, done = end, int(counts[-1])


@lru_cache(2)
def counter(path: str) -> Counter:
    """This worker's counter for the file at ``path``."""
    return Counter(path)


def dump(blocks: Iterator[np.ndarray]) -> tuple[bytes, int, int]:
    """(stored counts, characters, tokens): differences of neighbours, signs folded in, byte plane by byte plane."""
    press, parts, done, chars = zstandard.ZstdCompressor(level=1), [], 0, 0
    for counts in blocks:
        apart = np.diff(counts, prepend=done)
        folded = ((apart << 1) ^ (apart >> 63)).astype("<u8")
        planes = max(1, -(-int(folded.max()).bit_length() // 8))
        raw = press.compress(np.ascontiguousarray(folded.view(np.uint8).reshape(-1, 8)[:, :planes].T).tobytes())
        parts += [_HEAD.pack(len(counts), done, int(counts.min()), planes, len(raw)), raw]
        done, chars = int(counts[-1]), chars + len(counts)
    return b"".join(parts), chars, done


class Stored:
    """The blocks of stored counts; only those that a question asks for are unpacked."""

    def __init__(self, raw: bytes):
        self.raw, self.heads, at, chars = raw, [], 0, 0
        while at < len(raw):
            n, before, least, planes, size = _HEAD.unpack_from(raw, at)
            self.heads.append((chars, n, before, least, planes, at + _HEAD.size, size))
            at, chars = at + _HEAD.size + size, chars + n
        self.chars = chars

    def _block(self, i: int) -> np.ndarray:
        _, n, before, _, planes, at, size = self.heads[i]
        flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(self.raw[at : at + size]), np.uint8).reshape(planes, n)
        folded = np.zeros(n, np.int64)
        for p in range(planes):
            folded |= flat[p].astype(np.int64) << (8 * p)
        return before + np.cumsum((folded >> 1) ^ -(folded & 1))

    def at(self, chars: int) -> int | None:
        """The tokens of the first ``chars`` characters; None where the text has fewer."""
        if not 0 <= chars <= self.chars:
            return None
        if not chars:
            return 0
        starts = [h[0] for h in self.heads]
        i = int(np.searchsorted(starts, chars - 1, "right")) - 1
        return int(self._block(i)[chars - 1 - starts[i]])

    def within(self, budget: int) -> int:
        """The characters of the longest prefix of at most ``budget`` tokens."""
        for i in range(len(self.heads) - 1, -1, -1):
            if self.heads[i][3] <= budget:
                return self.heads[i][0] + int(np.flatnonzero(self._block(i) <= budget)[-1]) + 1
        return 0


def add_prefixes(docs: DataFrame, tokenizer: str, text_col: str = "text") -> DataFrame:
    """The rows with n_bytes, n_chars, n_tokens of the whole text and prefixes, the stored counts of all its prefixes.

    A null text is empty: no bytes, no tokens, prefixes without blocks. Rows are independent of each other, so repeated
    rows and ids give equal results and an empty table an empty one; input columns of the four names are replaced.
    """
    kept = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in ADDED or c == text_col])
    where = kept.columns.index(text_col)
    names = [c for c in kept.columns if c.lower() not in ADDED]
    own = [kept.columns.index(c) for c in names]
    schema = StructType([*[kept.schema.fields[i] for i in own], *[StructField(c, LongType()) for c in ADDED[:3]], StructField(ADDED[3], BinaryType())])

    def count(batches):
        mine = counter(tokenizer)
        for batch in batches:
            rows = []
            for value in batch.column(where):
                text = value.as_py() or ""
                stored, chars, tokens = dump(mine.blocks(text))
                rows.append((len(text.encode()), chars, tokens, stored))
            added = [pa.array([r[i] for r in rows], pa.int64() if i < 3 else pa.binary()) for i in range(4)]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in own], *added], [*names, *ADDED])

    return kept.mapInArrow(count, schema)


def longest_within(budget: int, prefixes: Column | str = "prefixes") -> Column:
    """Characters of the longest prefix of at most ``budget`` tokens, from stored counts; null where there are none."""

    @F.arrow_udf("long")
    def chars(stored: pa.Array) -> pa.Array:
        return pa.array([None if s is None else Stored(s).within(budget) for s in stored.to_pylist()], pa.int64())

    return chars(prefixes)


def tokens_at(chars: Column | str, prefixes: Column | str = "prefixes") -> Column:
    """Tokens of the first ``chars`` characters, from stored counts; null where the text is shorter."""

    @F.arrow_udf("long")
    def tokens(at: pa.Array, stored: pa.Array) -> pa.Array:
        return pa.array([None if s is None or n is None else Stored(s).at(n) for n, s in zip(at.to_pylist(), stored.to_pylist())], pa.int64())

    return tokens(chars, prefixes)


def truncated(counted: DataFrame, budget: int, text_col: str = "text") -> DataFrame:
    """Texts of add_prefixes() cut to the longest prefix of at most ``budget`` tokens; the other columns stay."""
    return counted.withColumn(text_col, F.substring(F.col(text_col), F.lit(1), longest_within(budget)))
