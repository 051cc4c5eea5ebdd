"""Kernels whose results no SQL gives, against exhaustive searches on small inputs."""

import itertools
import math
import random

import numpy as np
import pyarrow as pa
import pytest

from predial.llm import decontamination, language, licenses


def edits(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


@pytest.mark.parametrize("seed", range(12))
def test_notice_spans_by_enumeration(seed):
    """Every reported span has the edits it says; every stretch within the bound overlaps a report that is no worse."""
    rng = random.Random(seed)
    notice = "all rights reserved here"
    scanner = licenses.Scanner({}, {notice: "x"}, licenses.PER_ERROR)
    k = scanner.notices[0][1]

    def spoilt(n):
        text = list(notice)
        for _ in range(n):
            at = rng.randrange(len(text))
            text[at : at + 1] = rng.choice(([], ["z"], [text[at], "q"]))
        return "".join(text)

    parts = [rng.choice(["some words", "all right here", "reserved", spoilt(0), spoilt(1), spoilt(2), spoilt(3)]) for _ in range(5)]
    text = licenses.normalise(" ".join(parts))
    found = [hit[1:] for hit in scanner.scan(text)[1]]
    assert all(edits(notice, text[a:b]) == e <= k for a, b, e in found)
    assert all(b <= c for (_, b, _), (c, _, _) in zip(sorted(found), sorted(found)[1:]))
    for a in range(len(text)):
        for b in range(a + len(notice) - k, min(len(text), a + len(notice) + k) + 1):
            n = edits(notice, text[a:b])
            if n <= k:
                assert any(c < b and a < d and e <= n for c, d, e in found), (text[a:b], found)


def test_overlaps_against_all_alignments():
    """Of the pairs that some alignment proves, nearly all are found, and no others; copies with up to a quarter of words replaced."""
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(3000)]
    items = [[words[i] for i in rng.integers(0, 3000, n)] for n in rng.integers(10, 40, 40)]
    docs = []
    for n in range(400):
        text = [words[i] for i in rng.integers(0, 3000, 60)]
        if n % 2:
            item = items[n % 40]
            size = int(rng.integers(10, len(item) + 1))
            at = int(rng.integers(0, len(item) - size + 1))
            passage = [w if rng.random() > 0.15 else words[int(rng.integers(0, 3000))] for w in item[at : at + size]]
            text[20:20] = passage
        docs.append(text)

    def proven(doc, item):
        for by in range(-len(doc) + 1, len(item)):
            same = [doc[i] == item[i + by] for i in range(max(0, -by), min(len(doc), len(item) - by))]
            total = [0, *itertools.accumulate(same)]
            least = min(10, len(item))
            if sum(same) >= 0.75 * least and any(4 * (total[b] - total[a]) >= 3 * (b - a) for a in range(len(same)) for b in range(a + least, len(same) + 1)):
                return True
        return False

    index = decontamination.Index(list(range(40)), pa.array([" ".join(x) for x in items]), 10)
    h, rows = decontamination.words(pa.array([" ".join(x) for x in docs]), decontamination.ALNUM)
    found = {(r, i) for r, i, *_ in index.find(h, rows)}
    expected = {(d, i) for d in range(400) for i in range(40) if len(set(docs[d]) & set(items[i])) > 5 and proven(docs[d], items[i])}
    assert found <= expected and len(expected) > 100
    assert len(found & expected) >= 0.9 * len(expected), (len(found), len(expected))


def _likelihood(like, share):
    return float(np.log(np.maximum(np.exp(like) @ share, 1e-300)).sum())


def test_language_sets_against_all_sets():
    """The grown set of languages is that of the best penalised likelihood over all sets, by an EM of its own, for nearly all texts."""
    rng = np.random.default_rng(4)
    alphabets = ["abcdef", "efghij", "ijklmn", "mnopqa"]
    word = lambda a: "".join(rng.choice(list(a), rng.integers(3, 8)))
    counts = np.zeros((4, 1 << language.BITS))
    for k, a in enumerate(alphabets):
        data, offsets = language.text_bytes(pa.array([" ".join(word(a) for _ in range(3000))]))
        counts[k] = np.bincount(language.trigrams(data, offsets)[0], minlength=1 << language.BITS)
    smooth = counts + 0.5
    model = language.Model(["a", "b", "c", "d"], np.log(smooth / smooth.sum(axis=1, keepdims=True)))
    agree = 0
    for n in range(60):
        parts = rng.choice(4, int(rng.integers(1, 4)), replace=False)
        text = " ".join(word(alphabets[k]) for k in parts for _ in range(int(rng.integers(8, 40))))
        data, offsets = language.text_bytes(pa.array([text]))
        gram, start, _ = language.trigrams(data, offsets)
        like = np.stack([np.add.reduceat(p[gram], start) for p in model.log_p], axis=1)
        best = (-math.inf, ())
        for size in range(1, 5):
            for chosen in itertools.combinations(range(4), size):
                share = np.zeros(4)
                share[list(chosen)] = 1 / size
                for _ in range(200):
                    odds = np.exp(like - like.max(axis=1, keepdims=True)) * share
                    share = (odds / odds.sum(axis=1, keepdims=True)).mean(axis=0)
                top = like.max(axis=1)
                value = _likelihood(like - top[:, None], share) + top.sum() - (size - 1) * (0.5 * math.log(max(len(start), 2)) + 3)
                best = max(best, (value, chosen))
        _, _, shares = language.identify(model, data, offsets)
        agree += tuple(np.flatnonzero(shares[0] > 0.005).tolist()) == best[1]
    assert agree >= 57, agree
