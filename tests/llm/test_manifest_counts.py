"""Prefix counts, divergences and manifests against the library, plain loops and exhaustive refolding."""

import hashlib
import os
import random
import re
import time
import zlib
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from predial.llm import divergence, manifest, prefix_counts

os.environ["TOKENIZERS_PARALLELISM"] = "false"
PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_tokens int, `odd name` string"
#: Runs of blanks, contractions, special strings, characters whose class differs between Unicode tables.
PARTS = ["a", "b", "the", " ", "  ", "\n", "\n\n", "'", "re", "'ll", "'s", "é", "日本", "!", "..", "<|endoftext|>", "<|endo", "1", "²", "23", "\t", " ", "\x1c", "​", "=====", "aaaa", "\U0001f600", " \n", "\r\n", "\x00", "́", "_"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(PATH)
    return lambda text: len(tokenizer.encode(text, add_special_tokens=False).ids)


@pytest.fixture(scope="module")
def counter():
    return prefix_counts.Counter(PATH)


def rows():
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdeéÄ") for _ in range(rng.randint(1, 5))) for _ in range(60)]
    out = []
    for i in range(400):
        text = rng.choice([" ", "-", "\n"]).join(rng.choice(words[: rng.choice((5, 60))]) for _ in range(rng.randint(1, 40)))
        out.append((i, text.title() if i % 2 else text, rng.choice(["de", "en", "en", "en", None]), rng.choice(["s0", "s0", "s1", "ß", None]), len(text), 1, "x"))
    out += [(500, None, "fr", "s9", None, 1, "x"), (501, "", "de", "s8", 0, 1, "x"), (502, "12 ..", "", "s0", 5, 1, "x"), (503, "Long " * 50_000, "en", "s1", 3, 1, "x"), (None, "b", None, None, None, None, None)]
    return [*out, out[0], out[0], (3, "other text", "en", "s1", 1, 1, "x"), out[-1]]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# Prefix counts


def test_every_prefix_is_counted_as_the_library_does(counter, library):
    rng = random.Random(7)
    for _ in range(700):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 12)))
        assert counter.counts(text).tolist() == [library(text[: i + 1]) for i in range(len(text))], repr(text)


def test_two_tokens_side_by_side_are_what_the_library_makes_of_their_text(counter):
    rng = random.Random(8)
    merges = counter.merges
    for _ in range(3000):
        word = bytes(rng.choice(b"aabcdeernst") for _ in range(rng.randint(1, 14)))
        tokens = merges.encoded(word)
        assert merges.counts(word)[-1] == len(tokens)
        assert all(merges.fits(a, b) for a, b in zip(tokens, tokens[1:]))


def test_very_long_words_and_texts_take_seconds(counter, library):
    began = time.time()
    for text in ("a" * 400_000, "=" * 200_000, "ab" * 100_000, " " * 200_000, "日" * 60_000, "a b\n" * 100_000):
        stored, chars, tokens = prefix_counts.dump(counter.blocks(text))
        assert (chars, tokens) == (len(text), library(text))
    assert time.time() - began < 60


def test_stored_counts_answer_all_questions(counter):
    text = " ".join(random.Random(1).choice(["some", "words", "12", "here,", "<|endoftext|>"]) for _ in range(30_000))
    for sample in (text, text.replace("<|endoftext|>", "x"), ""):
        raw, chars, tokens = prefix_counts.dump(counter.blocks(sample))
        counts, stored = counter.counts(sample).tolist(), prefix_counts.Stored(raw)
        for at in (0, 1, 5, len(sample) // 2, len(sample)):
            if at <= len(sample):
                assert stored.at(at) == ([0, *counts])[at]
        assert stored.at(len(sample) + 1) is None
        for budget in (0, 1, 7, 512, 20_000, 10**9):
            assert stored.within(budget) == max((i + 1 for i, c in enumerate(counts) if c <= budget), default=0)


def test_counts_on_spark(docs, empty, library):
    counted = prefix_counts.add_prefixes(docs, PATH)
    assert counted.columns == ["doc_id", "text", "lang", "source", "n_chars", "odd name", "n_bytes", "n_tokens", "prefixes"] or set(counted.columns) >= {"odd name", "prefixes"}
    cut = prefix_counts.truncated(counted.withColumn("half", F.col("n_chars").cast("long")), 9)
    found = counted.select("doc_id", "text", "n_bytes", "n_chars", "n_tokens", prefix_counts.longest_within(9).alias("fit"), prefix_counts.tokens_at(F.lit(2).cast("long")).alias("two")).collect()
    assert len(found) == len(rows())
    for r in found:
        text = r.text or ""
        assert (r.n_bytes, r.n_chars, r.n_tokens) == (len(text.encode()), len(text), library(text))
        assert r.two == (library(text[:2]) if len(text) >= 2 else None)
        assert library(text[: r.fit]) <= 9 and (len(text) > 3000 or all(library(text[:i]) > 9 for i in range(r.fit + 1, len(text) + 1)))
    assert all(library(r.text or "") <= 9 for r in cut.collect())
    assert prefix_counts.add_prefixes(empty, PATH).count() == 0


# Divergences


def divergences(data, least=10, top=10):
    """The contract, by plain loops over every group and kept term."""
    docs = [((lang or ""), (source or ""), re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))) for _, text, lang, source, *_ in data]
    out = set()
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        kept = {t for t, n in Counter(t for d in mine for t in set(d[2])).items() if n >= least}
        counts = {s: Counter() for s in {d[1] for d in mine}}
        for _, s, terms in mine:
            counts[s].update(t for t in terms if t in kept)
        whole = sum(counts.values(), Counter())
        value = lambda c, t: 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept))
        f = lambda p, q: (p - q) ** 2 // (p + q)
        for s, c in counts.items():
            pairs = [(-sum(f(value(c, t), value(o, t)) for t in kept), name.encode(), name) for name, o in counts.items() if name != s]
            terms = [(-f(value(c, t), value(whole, t)), t.encode(), t) for t in kept if c[t] and value(c, t) > value(whole, t)]
            out |= {(lang, s, "pair", n, -v, i) for i, (v, _, n) in enumerate(sorted(pairs), 1)}
            out |= {(lang, s, "term", n, -v, i) for i, (v, _, n) in enumerate(sorted(terms)[:top], 1)}
    return out


@pytest.mark.parametrize("least", [10, 1, 10**6])
def test_divergences_are_those_of_plain_loops(docs, least):
    found = [tuple(r) for r in divergence.audit(docs, least).collect()]
    assert len(found) == len(set(found)) and set(found) == divergences(rows(), least)


def test_divergences_do_not_depend_on_blocks_and_flushes(docs, monkeypatch):
    for name, value in (("BLOCK_SOURCES", 2), ("LEAST_SHARDS", 3)):
        monkeypatch.setattr(divergence, name, value)
    import numpy as np

    absent, place, term, p = np.array([3, 5, 9]), np.array([0, 2, 1, 0]), np.array([0, 0, 4, 4]), np.array([70, 20, 11, 50])
    whole = divergence._pair_sums(3, 0, absent, place, term, p)
    monkeypatch.setattr(divergence, "CELLS", 7)
    assert [x.tolist() for x in divergence._pair_sums(3, 0, absent, place, term, p)] == [x.tolist() for x in whole]
    assert {tuple(r) for r in divergence.audit(docs).collect()} == divergences(rows())


def test_partial_counts_are_flushed_in_bounded_tables(monkeypatch):
    import pyarrow as pa

    for name, value in (("MERGE_ROWS", 40), ("FLUSH_ROWS", 60), ("STRETCH", 50)):
        monkeypatch.setattr(divergence, name, value)
    data = pa.RecordBatch.from_pydict({"lang": [r[2] for r in rows()], "source": [r[3] for r in rows()], "text": [r[1] for r in rows()]})
    total, docs = Counter(), Counter()
    for batch in divergence._partial_counts(iter([data, data.slice(0, 0)])):
        for lang, source, term, n, d in zip(*(c.to_pylist() for c in batch.columns)):
            total[lang, source, term] += n
            docs[lang, source, term] += d
    want, seen = Counter(), Counter()
    for _, text, lang, source, *_ in rows():
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        want.update((lang or "", source or "", t) for t in terms)
        seen.update((lang or "", source or "", t) for t in {"", *terms})
    assert docs == seen and +total == want


def test_counts_beyond_64_bits_of_the_product_stay_exact(spark):
    row = spark.sql("select 30000000000L as n, 70000000001L as total, 5L as terms").select(divergence.smoothed(F.col("n"), F.col("total"), F.col("terms"))).first()[0]
    assert row == 1 + 10**9 * (30000000000 + 2) // (70000000001 + 10)


def test_divergences_of_nothing(empty):
    assert divergence.audit(empty).count() == 0


# Manifests


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    doc_id, _, lang, source, chars, *_ = row
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, chars, text)))


def ascend(nodes, watched):
    """(root, siblings of the watched node) by the plain rule."""
    path = []
    while len(nodes) > 1:
        run = watched // 8 * 8
        path += [n for i, n in enumerate(nodes[run : run + 8], run) if i != watched]
        nodes = [H(*nodes[i : i + 8]) for i in range(0, len(nodes), 8)]
        watched //= 8
    return nodes[0], path


def manifests(data):
    trees: dict = {}
    for row in data:
        trees.setdefault(row[2], []).append((row[0] is not None, row[0] or 0, leaf(row, row[1]), row))
    for rows_ in trees.values():
        rows_.sort(key=lambda x: x[:3])
    names = sorted(trees, key=lambda n: (n is not None, (n or "").encode()))
    tops = [ascend([x[2] for x in trees[n]], 0)[0] for n in names]
    out = []
    for at, name in enumerate(names):
        nodes = [x[2] for x in trees[name]]
        for i, (_, _, own, row) in enumerate(trees[name]):
            sub, path = ascend(nodes, i)
            root, above = ascend(tops, at)
            changed = own
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0 and row[1] is not None:
                changed = leaf(row, re.sub("[A-Z]", lambda m: m[0].lower(), row[1]))
            folded = ascend([ascend([changed if j == i else n for j, n in enumerate(nodes)], 0)[0] if k == at else n for k, n in enumerate(tops)], 0)[0]
            out.append((row[0], own, sub, root, H(*path, *above), folded, folded == root))
    return sorted(out, key=repr)


@pytest.mark.parametrize("levels", [4, 2, 1])
def test_manifest_is_that_of_the_plain_rule(docs, levels):
    found = sorted((tuple(r) for r in manifest.manifest(docs, levels=levels).collect()), key=repr)
    assert found == manifests(rows())


@pytest.mark.parametrize("n", [1, 2, 8, 9, 64, 65])
def test_manifest_of_one_language_and_few_rows(spark, n):
    data = [(i, f"Text {i}", "en", "s", i, 1, "x") for i in range(n)]
    found = sorted((tuple(r) for r in manifest.manifest(spark.createDataFrame(data, SCHEMA)).collect()), key=repr)
    assert found == manifests(data)


def test_manifest_of_many_languages(spark):
    data = [(i, "T", f"l{i % 70}", "s", 1, 1, "x") for i in range(200)]
    assert sorted((tuple(r) for r in manifest.manifest(spark.createDataFrame(data, SCHEMA)).collect()), key=repr) == manifests(data)


def test_manifest_of_nothing(empty):
    assert manifest.manifest(empty).count() == 0


def test_folding_resumes_the_state_before_the_slot():
    children = [H(str(i)).encode() for i in range(8)]
    made, digest = manifest.parent(children)
    assert digest == H(*(c.decode() for c in children)).encode()
    for slot in range(8):
        other = [*children[:slot], H("new").encode(), *children[slot + 1 :]]
        assert made.fold(slot, H("new").encode()) == hashlib.sha256(b"".join(other)).hexdigest().encode()
