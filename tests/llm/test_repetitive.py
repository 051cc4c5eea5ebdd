"""Repetitive texts and items in decontamination, and batches against many buckets."""

import random
import time

import numpy as np
import pyarrow as pa
import pytest

from predial.llm import decontamination, exchange


def find(items, texts, least=10):
    index = decontamination.Index(list(range(len(items))), pa.array(items), least)
    h, rows = decontamination.words(pa.array(texts), decontamination.ALNUM)
    return {(r, i): x for r, i, *x in index.find(h, rows)}


def every_shift(items, texts, least=10):
    """The best stretch over all alignments with at least one seed in common."""
    best = {}
    for r, text in enumerate(texts):
        for i, item in enumerate(items):
            a, b = text.split(), item.split()
            need = min(least, len(b))
            for shift in range(-len(b) + 1, len(a)):
                low, high = max(0, -shift), min(len(b), len(a) - shift)
                same = np.array([b[j] == a[j + shift] for j in range(low, high)])
                if len(b) >= 5 and not any(all(j + k < len(same) and same[j + k] for k in m) for m in decontamination.MASKS for j in range(len(same))):
                    continue
                matched, first, last = decontamination.densest(same)
                if last - first + 1 < need:
                    matched, first, last = decontamination.longest(same)
                start = low + shift + first
                if last - first + 1 >= need and (matched, -start, first - last) > best.get((r, i), (0, 0, 0))[:3]:
                    best[r, i] = (matched, -start, first - last, low + shift + last)
    return {k: (m, 1 - n, -s, e) for k, (m, s, n, e) in best.items()}


@pytest.mark.parametrize("seed", range(6))
def test_repeated_words_are_found_as_over_all_shifts(seed):
    rng = random.Random(seed)
    unit = rng.choice([["a"], ["a", "b"], ["a", "a", "b"]])
    make = lambda n, noise: " ".join(rng.choice("xyz") if rng.random() < noise else unit[j % len(unit)] for j in range(n))
    items = [make(rng.randint(5, 40), 0.05), make(25, 0.0), "one two three four five six seven"]
    texts = [make(90, 0.1), make(12, 0.0), "x " * 20 + make(30, 0.2), "no such words here at all", "one two three four five six seven " * 3]
    got, want = find(items, texts), every_shift(items, texts)
    assert set(want) == set(got)
    for key, (matched, aligned, first, _) in want.items():
        # Ranges of shifts hold some without a seed in common, which may be better still.
        m, n, f, last = got[key]
        assert (m, -f, -n) >= (matched, -first, -aligned), key
        text, item = texts[key[0]].split(), items[key[1]].split()
        assert last - f + 1 == n and any(sum(text[f + j] == item[o + j] for j in range(n)) == m for o in range(len(item) - n + 1)), key


@pytest.mark.parametrize("unit", ["a", "a b", "a b c d e f g"])
def test_a_million_repeated_words_take_seconds(unit):
    items = [" ".join([unit] * 60), "some other words " * 20]
    began = time.time()
    found = find(items, [" ".join([unit] * (1_000_000 // len(unit.split()))), "a b"])
    assert set(found) == {(0, 0)} and found[0, 0][0] == 60 * len(unit.split()) and found[0, 0][2] == 0
    assert time.time() - began < 60


def test_a_batch_costs_its_keys_not_the_buckets(spark):
    """With 2 ** 20 buckets a batch of few words is sent in a moment, and answered with the corpus' totals."""
    docs = spark.createDataFrame([(i, f"w{i % 3} w{i} same") for i in range(40)], "doc_id long, text string").repartition(2)
    found = exchange.batches(docs, decontamination.ALNUM, "doc_id", "text")
    kind = exchange.Kind(lambda b: (b.vocabulary, np.bincount(b.word, minlength=len(b.vocabulary))), 6)
    began = time.time()
    replies = exchange.answers(found, [kind], 20, "test-answers")

    def use(batch, totals):
        yield pa.RecordBatch.from_arrays([pa.array([int(totals[0].max())], pa.int64()), pa.array([len(totals[0])], pa.int64())], ["most", "n"])

    got = exchange.with_answers(found, replies, use, 1, "most long, n long").collect()
    assert {r.most for r in got} == {40} and time.time() - began < 120
