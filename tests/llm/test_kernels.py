"""Kernels against brute force: hashing, Simple-8b, packing plans, tokenising, spaced seeds, prefixes."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from predial.llm import bpe, decontamination, exchange, hashing, jaccard, language, language_model, licenses, packing, quality, token_files

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [None, "", " ", "a", "a b", "  The the  THE\n x", "é ü", "abc" * 200, "\t\n"]


@pytest.mark.parametrize("rule, pattern", [(hashing.SPACE, rb"[^\x20\x09-\x0D]+"), (hashing.ALNUM, rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")])
@pytest.mark.parametrize("chunk", [None, 64])
def test_words(monkeypatch, rule, pattern, chunk):
    if chunk:
        monkeypatch.setattr(hashing, "CHUNK", chunk)
    hashing._powers.cache_clear()
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choice("ab \n.éX1") for _ in range(rng.randint(0, 300))) for _ in range(200)]
    h, rows = hashing.words(pa.array(texts), rule)
    known = {}
    for i, text in enumerate(texts):
        expected = re.findall(pattern, (text or "").encode().lower())
        assert len(expected) == rows[i + 1] - rows[i]
        for word, key in zip(expected, h[rows[i] : rows[i + 1]]):
            assert known.setdefault(word, key) == key
    assert len(set(known.values())) == len(known)
    hashing._powers.cache_clear()


def test_shingles():
    h, rows = hashing.words(pa.array(["a b c d a b c d", "a b c", "", "a b c d"]), hashing.SPACE)
    x, at = hashing.shingles(h, rows, 4)
    assert np.diff(at).tolist() == [5, 1, 0, 1]
    assert x[0] == x[4] == x[6] and len(set(x.tolist())) == 5


def test_encoder_is_exact():
    encoder, rng = bpe.Encoder(PATH), random.Random(2)
    bits = ["ab", " ", "\n", "'s", "don't", ".", "é", "\t", "12", "\r", "  ", "<|endoftext|>", "x", "ß", "​", "🙂", "\x85", "　", " w", " w2", "\nq", "—", "€", "!!"]
    texts = ODD + ["".join(rng.choice(bits) for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    found = [ids[cut[i] : cut[i + 1]] for a, b, ids, cut in encoder.encode(pa.array(texts), 2000) for i in range(b - a)]
    assert all(np.array_equal(encoder.whole(t or ""), x) for t, x in zip(texts, found))


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 3000])
@pytest.mark.parametrize("high", [0, 1, 300, 50257, 1 << 40, (1 << 60) - 1, (1 << 64) - 1])
def test_simple8b(n, high):
    values = np.random.default_rng(n).integers(0, high, n, dtype=np.uint64, endpoint=True)
    words, offsets, escapes = token_files.pack(values)
    assert np.array_equal(token_files.unpack(words, offsets, escapes, n), values)
    if n > 600:
        assert np.array_equal(token_files.unpack(words, offsets, escapes, n, 1, 2), values[256:512])
        assert high >= 1 << 60 or not len(escapes)


def test_segment_round_trip():
    ids, counts = np.arange(1000, dtype="<u4"), np.array([1000 - 7, 0, 7])
    names, got, values = token_files.read_segment(token_files.write_segment([5, None, -3], counts, ids))
    assert (names, got.tolist(), values.tolist()) == ([5, None, -3], counts.tolist(), ids.tolist())
    with pytest.raises(ValueError):
        token_files.read_segment(b"x" * 64)


def test_fullest_against_brute_force():
    rng = random.Random(3)
    for _ in range(200):
        counts = {n: rng.randint(1, 3) for n in rng.sample(range(1, 20), 5)}
        seed = max(counts)
        sums = {seed}
        for n, c in counts.items():
            sums = {s + n * k for s in sums for k in range(c + 1 - (n == seed)) if s + n * k <= 30}
        used = packing.fullest(counts, 30, seed)
        assert sum(n * k for n, k in used) == max(sums) and all(k <= counts[n] for n, k in used)


def test_plan_places_every_piece_once():
    rng = random.Random(4)
    counts = {n: rng.randint(0, 9) for n in range(1, 65)}
    used, fill = {n: [] for n in counts}, {}
    for n, first, end, sequence, times, offset in packing.plan(counts, 64):
        for rank in range(first, end):
            used[n].append(rank)
            fill.setdefault(sequence + (rank - first) // times, []).append((offset + (rank - first) % times * n, n))
    assert all(sorted(used[n]) == list(range(c)) for n, c in counts.items())
    for places in fill.values():
        ends = 0
        for offset, n in sorted(places):
            assert offset == ends
            ends += n
        assert ends <= 64
    total = sum(n * c for n, c in counts.items())
    over_half = sum(c for n, c in counts.items() if n > 32)
    assert len(fill) <= max(-(-total // 64), over_half) * 1.04
    assert packing.plan({}, 64) == []


def test_densest():
    same = np.array([0, 1, 1, 1, 1, 0, 1, 1, 1, 1, 0, 0, 1], bool)
    assert decontamination.densest(same) == (8, 1, 9)
    assert decontamination.densest(np.zeros(3, bool))[0] == 0


def test_seeds_survive_substitution():
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi".split()
    index = decontamination.Index([7, 8], pa.array([" ".join(item), "one two three"]), 10)
    changed = list(item)
    changed[3], changed[9] = "x", "y"
    texts = [" ".join(["w", *changed, "v"]), "One, two; THREE", "one two four", None, " ".join(reversed(item))]
    found = index.find(*hashing.words(pa.array(texts), hashing.ALNUM))
    assert sorted(found) == [(0, 0, 14, 16, 1, 16), (1, 1, 3, 3, 0, 2)]


def test_license_scanner():
    scanner = licenses.Scanner(licenses.PHRASES, licenses.NOTICES, licenses.PER_ERROR)
    text = licenses.normalise("Licensed Under the MIT license, under the-mit\nlicense. cc-by-nc2 CC BY NC")
    assert [x[0] for x in scanner.scan(text)[0]] == ["mit", "mit", "cc-by-nc"]
    exact, spans = scanner.scan(licenses.normalise("Permision is hereby granted free of charge to any persn obtaining a copy of this software"))
    assert not exact and {scanner.labels[n] for n, *_ in spans} == {"mit"} and spans[0][3] == 2
    assert scanner.scan(licenses.normalise(None)) == ([], [])


def test_language_mixture():
    texts = {"aa": "xaba xabo xabi xabu " * 30, "bb": "qod qud qid qad " * 30}
    counts = []
    for text in texts.values():
        gram, _, _ = language.trigrams(*hashing.text_bytes(pa.array([text])))
        counts.append(np.bincount(gram, minlength=1 << language.BITS) + 0.5)
    model = language.Model(list(texts), np.log(np.array(counts) / np.sum(counts, axis=1, keepdims=True)))
    mixed = " ".join(["xaba"] * 30 + ["qod"] * 10)
    lead, score, shares = language.identify(model, *hashing.text_bytes(pa.array([texts["aa"], texts["bb"], mixed, "12 ..", None])))
    assert lead.tolist() == [0, 1, 0, -1, -1] and score[0] == 1.0 and abs(score[2] - 0.75) < 0.02 and score[3] == 0


def test_prefix_matches():
    assert jaccard.prefix_matches(np.ones(20, np.int64), 17) == 1
    assert jaccard.prefix_matches(np.full(200, 1000), 170) > 4
    assert jaccard.prefix_matches(np.array([2]), 1) == 1


def test_quality_features():
    row, bucket = quality.features(pa.array(["A b, a", None, "a  ...b", "", "B,b"]))
    found = [sorted(bucket[row == i].tolist()) for i in range(5)]
    assert [len(x) for x in found] == [7, 0, 5, 0, 5]
    one = {t: quality.features(pa.array([t]))[1].tolist()[0] for t in ("a", "b", ",", "...")}
    assert {one["a"], one["b"], one[","]} <= set(found[0]) and found[0].count(one["a"]) == 2 and one["..."] in found[2]
    # The same words in another order have the same tokens and other pairs.
    left, right = (quality.features(pa.array([t]))[1].tolist() for t in ("x y z", "z y x"))
    assert sorted(left[:3]) == sorted(right[:3]) and sorted(left) != sorted(right)


def test_quality_models_by_brute_force():
    texts = ["one two three.", "two two", "bad!! one", "", "bad!! bad!! two"]
    column, good = pa.array(texts), [0, 1]
    row, bucket = quality.features(column)
    raw = Counter(bucket.tolist())
    target = Counter(bucket[np.isin(row, good)].tolist())
    count = lambda c: np.array([c[i] for i in range(quality.BUCKETS)])
    w = quality.weights(count(target), count(raw))
    n, m = sum(raw.values()), sum(target.values())
    for i in raw:
        p, q = raw[i] / n, (target[i] + quality.PRIOR * raw[i] / n) / (m + quality.PRIOR)
        assert abs(w[i] - math.log(q / p)) < 1e-9
    assert (w[[i for i in range(quality.BUCKETS) if i not in raw]] == 0).all()
    assert abs(sum(raw[i] / n * math.exp(w[i]) for i in raw) - 1) < 1e-9


def test_exchange_packing():
    rng = np.random.default_rng(3)
    keys = np.sort(rng.integers(0, 1 << 63, 1000, dtype=np.uint64) >> np.uint64(7))
    times = rng.integers(0, 1 << 31, 1000)
    for width in (4, 5, 7):
        found, n = exchange._unpack(exchange._pack(keys, times, 8, width), width)
        assert (n == times).all() and (found == ((keys << np.uint64(8)) >> np.uint64(64 - 8 * width))).all()


def test_automaton_states():
    """Arcs where training has seen the run of words, failure arcs elsewhere; the weights of every state sum to one."""
    words = ["a", "b", "c", "new"]
    h = {w: np.uint64(i * 1_000_003 + 5) for i, w in enumerate(words)}
    texts = ["a b c", "a b a b c", "new a"]
    flat = [w for t in texts for w in t.split()]
    vocabulary, index = np.unique([h[w] for w in flat], return_inverse=True)
    rows = np.cumsum([0, *(len(t.split()) for t in texts)])
    batch = exchange.Batch([1, 2, 3], rows, vocabulary, index)
    own = language_model.grams(batch)
    learn = own.doc < 2
    totals = [np.bincount(at[(at >= 0) & learn], minlength=len(k)) for at, k in zip(own.at, own.hashes)]
    n, v = int(learn.sum()), int((totals[0] > 0).sum())
    a = language_model.build(own, totals, n, v)
    place = {w: int(np.searchsorted(own.hashes[0], h[w])) for w in words}
    assert a.root_next[place["new"]] == 0 and a.root_next[place["a"]] == 1 + place["a"]
    p = lambda s, w: 10 ** a.arc_weight[np.flatnonzero(a.arc_key == s * a.n_words + w)[0]] if (a.arc_key == s * a.n_words + w).any() else 10 ** a.root_weight[w] if s == 0 else 10 ** a.fail_weight[s] * p(int(a.fail_next[s]), w)
    unseen = 0.1 / (n + 0.1 * (v + 1))
    for s in range(len(a.fail_next)):
        rest, at = 1.0, s
        while at:
            rest, at = rest * 10 ** a.fail_weight[at], int(a.fail_next[at])
        known = [w for w in range(a.n_words) if w != place["new"]]
        if s == 0 or (s <= a.n_words and totals[0][s - 1]) or (s > a.n_words and totals[1][s - 1 - a.n_words] and int(own.hashes[0][own.at[0][own.first[1][s - 1 - a.n_words]]]) != int(language_model.END)):
            if s != 1 + int(np.searchsorted(own.hashes[0], language_model.END)):
                assert abs(sum(p(s, w) for w in known) + rest * unseen - 1) < 1e-9


def test_crc_mod():
    assert hashing.crc_mod(pa.array([5, None]), 3).tolist() == [zlib.crc32(b"5") % 3, -1]


def _labels(scanner, text):
    return {scanner.labels[n] for n, *_ in scanner.scan(licenses.normalise(text))[1]}


def test_misspelt_phrases():
    scanner = licenses.Scanner(licenses.PHRASES, licenses.NOTICES, licenses.PER_ERROR)
    for text, label in {
        "Released under the MIT Licence": "mit", "distributed under teh MIT license": "mit", "under the M.I.T. license": "mit", "Apache Licence, Version 2.0": "apache-2",
        "released under the apache lisence version 2.0": "apache-2", "x cc bi nc": "cc-by-nc", "x cc bync y": "cc-by-nc",
    }.items():
        assert _labels(scanner, text) == {label}, text
    for text in ("released under the MPL license", "under the site license", "apache license, version 1.1", "cc-by-nd", "cc by sa", "acc by nct", "thunder the mit licenses s"):
        assert not _labels(scanner, text), text


def test_phrases_with_random_edits():
    rng, scanner = random.Random(5), licenses.Scanner(licenses.PHRASES, licenses.NOTICES, licenses.PER_ERROR)
    for phrase, safe, k in (("under the mit license", (0, 10), 2), ("apache license version 2", (0, 22), 2), ("cc by nc", (0, 6), 1)):
        for _ in range(300):
            text = list(phrase)
            for _ in range(rng.randint(1, k)):
                at, letter = rng.randrange(1, safe[1] - 3), rng.choice("aeox")
                text[at : at + rng.randint(0, 1)] = rng.choice(["", letter])
            assert scanner.phrases[phrase] in _labels(scanner, f"released {''.join(text)} 0 by us"), text


def test_hits_before_the_best():
    scanner = licenses.Scanner(licenses.PHRASES, licenses.NOTICES, licenses.PER_ERROR)
    text = licenses.normalise("licensed undr the mit licence licensed under the mit license licensed under teh mit license")
    long = list(licenses.NOTICES).index("licensed under the mit license")
    assert [e for n, _, _, e in scanner.scan(text)[1] if n == long] == [2, 0, 2]
    short = [scanner.notices[n][0] for n, *_ in scanner.scan(text)[1]].count("under the mit license")
    assert short == 3


def test_longest_against_brute_force():
    rng = np.random.default_rng(2)
    for _ in range(500):
        same = rng.random(rng.integers(1, 24)) < rng.choice([0.5, 0.75, 0.9])
        spans = [(b - a, -a) for a in range(len(same)) for b in range(a + 1, len(same) + 1) if 4 * same[a:b].sum() >= 3 * (b - a)]
        n, first = max(spans, default=(0, 0))
        matched, start, end = decontamination.longest(same)
        assert end - start + 1 == n and (n == 0 or (start == -first and matched == same[start : end + 1].sum()))


def test_substituted_passages_against_brute_force():
    """Wherever a seed hits, the passage counts if any stretch of 10 words or the whole item is alike in three quarters."""
    rng, checked = random.Random(3), 0
    for n, subs in [(16, 3), (16, 2), (20, 4), (13, 2), (12, 1), (10, 1), (8, 1)]:
        for _ in range(100):
            item, text = [f"w{i}" for i in range(n)], [f"w{i}" for i in range(n)]
            for at in rng.sample(range(n), subs):
                text[at] = "x"
            same = [a == b for a, b in zip(item, text)]
            if not any(all(same[at + i] for i in mask) for mask in decontamination.MASKS for at in range(n - mask[-1])):
                continue
            checked += 1
            index = decontamination.Index([7], pa.array([" ".join(item)]), 10)
            found = index.find(*hashing.words(pa.array([" ".join(text)]), hashing.ALNUM))
            alike = any(4 * sum(same[a:b]) >= 3 * (b - a) for a in range(n) for b in range(a + min(10, n), n + 1))
            assert bool(found) == alike, (same, found)
    assert checked > 500
