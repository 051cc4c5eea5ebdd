"""Operators on Spark: brute force on small corpora, and the defined results of odd rows."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from predial.llm import components, decontamination, hashing, jaccard, language, language_model, licenses, packing, quality, token_files, vectors

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string, batch long, token int, score double, start string"


def corpus(seed: int = 1, n: int = 120) -> list[tuple]:
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(150)]
    texts: list = []
    for _ in range(n):
        kind = rng.random()
        if texts and kind < 0.25:
            copy = (rng.choice(texts) or "").split(" ")
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy))
        elif texts and kind < 0.35:
            texts.append(rng.choice(texts))
        else:
            texts.append(" ".join(rng.choice(words) for _ in range(rng.randint(1, 90))))
    texts += [None, "", " \n", "One", "one two  three", "word " * 4000, "one"]
    rows = [(i * 3, t, "xx" if i % 2 else "yy", "s", 1, 2, 0.5, "z") for i, t in enumerate(texts)]
    return [*rows, rows[5], (None, texts[7], None, None, None, None, None, None), (None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def tokens(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids + [2]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_files(spark, docs, empty):
    segments, _ = token_files.write_tokens(docs, PATH)
    rows = token_files.read_tokens(segments, with_ids=True).orderBy("start").collect()
    assert [r.doc_id for r in rows] == sorted((r[0] for r in corpus()), key=lambda i: -1 if i is None else i)
    texts = {r[0]: r[1] for r in corpus() if r[0] is not None}
    start = 0
    for r in rows:
        if r.doc_id is not None:
            assert r.ids == tokens(texts[r.doc_id])
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(r.ids), crc(r.ids))
        start += len(r.ids)
    assert token_files.read_tokens(token_files.write_tokens(empty, PATH)[0]).count() == 0


def test_packing(docs, empty):
    rows = packing.pack_documents(docs, PATH, capacity=64).collect()
    expected = Counter()
    for row in corpus():
        ids = tokens(row[1])
        many = -(-len(ids) // 64)
        for piece in range(many):
            end = len(ids) - (many - 1 - piece) * 64
            begin = max(0, end - 64)
            expected[row[0], piece, begin, end - begin, crc(ids[begin:end])] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == expected
    bins: dict = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in bins.values():
        ends = 0
        for offset, length in sorted(places):
            assert offset == ends
            ends += length
        assert ends <= 64
    assert len(bins) <= math.ceil(sum(r.length for r in rows) / 64) + 2
    assert packing.pack_documents(empty, PATH).count() == 0


def test_licenses(spark, docs, empty):
    texts = ["Under the MIT License, under the mit license!", "x cc-by-nc", "apache license, version 2.0", "aapache license version 2", None, "", "--", "licensed undr the apache licence version 2"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r for r in licenses.licenses(rows).collect()}
    assert (found[0].n_words, found[0].n_base, found[0].first_word, found[0].last_word, found[0].base_labels) == (8, 2, 0, 4, "mit")
    assert (found[1].base_labels, found[1].first_word, found[1].score) == ("cc-by-nc", 1, 1.0)
    assert (found[2].n_base, found[2].base_labels) == (1, "apache-2")
    assert found[3].n_base == 0 and all((found[i].n_words, found[i].labels, found[i].score, found[i].first_word) == (0, "", 0.0, None) for i in (4, 5, 6))
    assert found[7].labels == "apache-2" and 0.8 < found[7].score < 1
    span = licenses.notice_spans(rows).where("doc_id = 7").first()
    assert (span.start_word, span.n_errors) == (0, 2)
    assert licenses.licenses(docs).count() == docs.count() and licenses.licenses(empty).count() == 0


def test_language(spark, docs, empty):
    rng = random.Random(5)
    sets = {"aa": "ba be bi bo bu".split(), "bb": "qua que qui quo".split()}
    rows = []
    for i in range(120):
        lang = rng.choice(list(sets))
        rows.append((i, " ".join("".join(rng.choice(sets[lang]) for _ in range(3)) for _ in range(12)), lang if i % 7 else None))
    rows += [(200, None, "aa"), (201, "12 -", "bb"), (202, "", None), (None, "bababa", "aa")]
    found = language.identify_documents(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    truth = {r[0]: r[1][:1] for r in rows if r[0] is not None and r[0] < 200}
    assert all(r.lang_pred == {"b": "aa", "q": "bb"}[truth[r.doc_id]] for r in found if r.doc_id in truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in found if r.doc_id is not None)
    odd = {r.doc_id: r for r in found if r.doc_id in (200, 201, 202)}
    assert all((r.lang_pred, r.score) == ("und", 0.0) for r in odd.values()) and len(found) == len(rows)
    assert language.identify_documents(empty).count() == 0
    assert language.identify_documents(docs.withColumn("lang", F.lit(None).cast("string"))).where("lang_pred <> 'und'").count() == 0


def brute_components(rows, percent=85):
    sets = []
    for _, text, *_ in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
        sets.append({tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    least: dict = {}
    for i, row in enumerate(rows):
        if row[0] is not None:
            least[root(i)] = min(least.get(root(i), row[0]), row[0])
    return Counter((row[0], len(sets[i]), least.get(root(i))) for i, row in enumerate(rows))


@pytest.mark.parametrize("hot, block, part", [(48, 384, 8192), (1, 5, 7)])
def test_jaccard(monkeypatch, docs, empty, hot, block, part):
    monkeypatch.setattr(jaccard, "HOT", hot)
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "SLICE", part)
    found = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.components(docs).collect())
    assert found == brute_components(corpus())
    assert jaccard.components(empty).count() == 0


def test_jaccard_candidates_share_what_is_asked(spark):
    """Common stock passages make short prefixes dear: longer ones ask for more shared shingles, and lose no similar pair."""
    rng = random.Random(4)
    stock = [[f"s{k}x{i}" for i in range(30)] for k in range(6)]
    texts = []
    for i in range(150):
        own = [f"d{i // 2}w{j}" for j in range(rng.choice([20, 60, 200]) if i % 2 == 0 else len(texts[-1][1]) - 60)] if i % 2 == 0 else list(texts[-1][0])
        if i % 2:
            own[rng.randrange(len(own))] = "changed"
        parts = rng.sample(stock, 2) if i % 2 == 0 else texts[-1][2]
        texts.append((own, [*parts[0], *own, *parts[1]], parts))
    rows = [(i, " ".join(w)) for i, (_, w, _) in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = jaccard.exchange.batches(docs, hashing.SPACE, "doc_id", "text")
    members = jaccard._members(jaccard._measure(found, 4))
    classes = jaccard._candidates(found, members, 4, 85)
    live = jaccard._postings(classes).withColumn("component", F.col("ref")).cache()
    pairs = jaccard.candidate_pairs(live, 85).collect()
    name = {r.ref: r.doc_id for r in members.collect()}
    sets = [{tuple(w[i : i + 4]) for i in range(len(w) - 3)} for _, w, _ in texts]
    similar = {(i, j) for i in range(150) for j in range(i + 1, 150) if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])}
    met = {tuple(sorted((name[r.a], name[r.b]))) for r in pairs}
    assert similar and similar <= met and all(r.shared >= r.asked for r in pairs)
    by_m = Counter(r.asked for r in pairs)
    assert len(by_m) > 1 and max(by_m) > 1, by_m
    right = live.select("token", F.col("ref").alias("other"))
    once = live.join(right, "token").where("ref < other").select("ref", "other").distinct().count()
    assert len(met) <= once
    expected = Counter((i, len(sets[i]), min([i, *(a for a, b in similar if b == i)])) for i in range(150))
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.components(docs).collect()) == expected


def test_connected(spark):
    rng = random.Random(6)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5, 5), (None, 3)]
    parent: dict = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None:
            low, high = sorted((root(a), root(b)))
            parent[high] = low
    found = {r.node: r.component for r in components.connected(spark.createDataFrame(links, "p long, q long"), "p", "q").collect()}
    assert found == {x: root(x) for x in parent}


def lm_by_recursion(rows):
    """(id, held out, tokens, known, N, base, score) by the definition of the backed-off probability, text by text."""
    split = [re.findall(rb"[^\x20\x09-\x0D]+", (r[1] or "").encode().lower()) + [None] for r in rows]
    held = [r[0] is not None and zlib.crc32(str(r[0]).encode()) % 10 == 0 for r in rows]
    seen = Counter()
    for r, w, out in zip(rows, split, held):
        if r[0] is not None and not out:
            for n in (1, 2, 3):
                seen.update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    one = {g: c for g, c in seen.items() if len(g) == 1}
    n, v = sum(one.values()), len(one)

    def p(word, context):
        if not context:
            return (seen[(word,)] + 0.1) / (n + 0.1 * (v + 1))
        if not seen[context]:
            return p(word, context[1:])
        k = language_model.PRIORS[len(context)]
        return (seen[(*context, word)] + k * p(word, context[1:])) / (seen[context] + k)

    logs = [([math.log10(p(x, ())) for x in w], [math.log10(p(x, tuple(w[max(0, i - 2) : i]))) for i, x in enumerate(w)]) for w in split]
    return [(r[0], out, len(w), sum(seen[(x,)] > 0 for x in w), n, sum(base), sum(full)) for r, w, out, (base, full) in zip(rows, split, held, logs)]


@pytest.mark.parametrize("lane", [256, 4])
def test_lm_scoring(monkeypatch, docs, empty, lane):
    monkeypatch.setattr(language_model, "LANE", lane)
    expected = lm_by_recursion(corpus())
    found = language_model.score_documents(docs).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score").collect()
    order = lambda r: (r[0] is None, r[0] or 0, r[2], r[6])
    for a, b in zip(sorted(map(tuple, found), key=order), sorted(expected, key=order), strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-9)
    assert language_model.score_documents(empty).count() == 0


def test_lm_learns_nothing(spark):
    """Every id is held out (crc32 mod 10 is 0) or null."""
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0][:4]
    rows = [(i, "a b a", None) for i in ids] + [(None, "a b", None), (None, None, None)]
    found = language_model.score_documents(spark.createDataFrame(rows, "doc_id long, text string, score string")).collect()
    assert all((r.n_known, r.train_tokens, r.base_score, r.score) == (0, 0, 0.0, 0.0) for r in found) and len(found) == len(rows)


def test_decontamination(spark, docs, empty):
    rng = random.Random(7)
    item = [f"w{rng.randrange(1000)}" for _ in range(40)]
    near = [w if i % 6 else "zz" for i, w in enumerate(item)]
    rows = [(1, "x y " + " ".join(item) + " z", 1), (2, " ".join(near).upper(), 2), (3, " ".join(item[:12]), 3), (4, " ".join(item[:9]), 4), (5, None, 5), (6, "", 6), (None, " ".join(item), 7)]
    texts = spark.createDataFrame(rows, "doc_id long, text string, item_id long")
    bench = spark.createDataFrame([(9, " ".join(item)), (10, None), (11, ""), (12, "the of")], "item_id long, text string")
    found = {(r.doc_id, r.item_id): (r.n_matched, r.n_aligned, r.first_word) for r in decontamination.overlaps(texts, bench).collect()}
    assert found == {(1, 9): (40, 40, 2), (2, 9): (30, 35, 1), (3, 9): (12, 12, 0), (None, 9): (40, 40, 0)}
    assert sorted(r.doc_id for r in decontamination.clean(texts, bench).collect()) == [4, 5, 6]
    assert decontamination.clean(texts, bench).columns == texts.columns
    assert decontamination.overlaps(empty, bench).count() == 0
    assert decontamination.overlaps(texts, bench.limit(0)).count() == 0 and decontamination.clean(texts, bench.limit(0)).count() == len(rows)


def test_decontamination_in_blocks(monkeypatch, spark):
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", 200)
    items = [(i, " ".join(f"w{i}x{j}" for j in range(15))) for i in range(12)]
    bench, texts = (spark.createDataFrame(items, f"{c} long, text string") for c in ("item_id", "doc_id"))
    assert {(r.doc_id, r.item_id) for r in decontamination.overlaps(texts, bench).collect()} == {(i, i) for i in range(12)}
    assert decontamination.clean(texts, bench).count() == 0


def test_quality(spark, docs, empty):
    rng = random.Random(8)
    words = [f"word{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(600):
        bad = i % 5 == 0
        text = [rng.choice(words) for _ in range(30)]
        rows.append((i, " ".join(f"{w.upper()}!!" for w in text) if bad else " ".join(text), "gumbel_key" if i else None))
        if i % 2:
            labels.append((i, 0 if bad else 1, 0))
    rows += [(1000, None, ""), (1001, "", ""), (None, "word1", ""), (7, rows[7][1], ""), (2000, "word2 " * 50_000, "")]
    texts = spark.createDataFrame(rows, "doc_id long, text string, log_ratio string")
    marks = spark.createDataFrame([*labels, (1, 0, 0), (5000, 1, 0), (None, None, None)], "doc_id long, quality int, toxic int")
    model = quality.train(texts, marks)
    assert model.share == 241 / 301  # id 7 has two rows
    scores = quality.add_scores(texts, model).cache()
    bound = quality.resample(scores, model.share)
    kept = {r.doc_id for r in scores.where(F.col("gumbel_key") >= bound).collect()}
    assert {i for i in range(600) if i % 5} <= kept and len(kept & set(range(0, 600, 5))) <= 3
    assert all(r.log_ratio == 0 for r in scores.where("doc_id in (1000, 1001)").collect()) and scores.count() == len(rows)
    whole, again = (quality.features(pa.array([t]))[1] for t in (rows[3][1], rows[5][1]))
    for i, bucket in ((3, whole), (5, again)):
        assert abs(scores.where(F.col("doc_id") == i).first().log_ratio - model.weight[bucket].sum()) < 1e-9
    keys = sorted((r.gumbel_key for r in scores.collect()), reverse=True)
    for k in (1, 10, 300, len(keys)):
        assert quality.threshold(scores, "gumbel_key", k) == keys[k - 1]
    assert quality.threshold(scores, "gumbel_key", len(keys) + 1) is None and quality.threshold(scores, "gumbel_key", 0) is None
    none = quality.train(texts, marks.limit(0))
    assert none.share == 1 and quality.add_scores(texts, none).where("log_ratio <> 0").count() == 0
    assert quality.add_scores(empty, quality.train(empty, marks)).count() == 0


def test_quality_samples_by_weight(spark):
    """Of texts of two kinds, how many of each are drawn follows their weights' ratio; without noise one kind would be taken whole."""
    weight = np.zeros(quality.BUCKETS)
    weight[quality.features(pa.array(["b"]))[1][0]] = math.log(3)
    rows = [(i, "b" if i % 2 else "a") for i in range(20_000)]
    scores = quality.add_scores(spark.createDataFrame(rows, "doc_id long, text string"), quality.Model(weight, 1.0, 17)).cache()
    bound = quality.resample(scores, 0.05)
    drawn = Counter(r.text for r in scores.where(F.col("gumbel_key") >= bound).collect())
    assert sum(drawn.values()) == 1000 and abs(drawn["b"] / 1000 - 0.75) < 0.05
    other = quality.add_scores(scores.select("doc_id", "text"), quality.Model(weight, 1.0, 18))
    assert scores.join(other, "doc_id").where(scores.gumbel_key == other.gumbel_key).count() == 0


def test_vector_lists_prune_and_lose_nothing():
    """Clustered vectors: all pairs at the threshold are found while the codes are asked for few of all pairs."""
    rng = np.random.default_rng(5)
    x = vectors._unit(rng.normal(size=(60, 32))[rng.integers(60, size=1500)] + rng.normal(size=(1500, 32)) * 0.06)
    quantiser = vectors.Quantiser(x, vectors.count_lists(len(x), len(x)))
    which, codes, error = quantiser.index(x)
    i, j, compared = vectors.matches(quantiser, math.sqrt(2 - 2 * 0.98), 0.98, x, x, which, codes, error)
    assert set(zip(i.tolist(), j.tolist())) == set(zip(*(k.tolist() for k in np.nonzero(x @ x.T >= 0.98))))
    assert len(quantiser.centres) > 50 and compared < 0.1 * len(x) ** 2
    assert vectors.count_lists(500, 500) > 1 and vectors.count_lists(10**9, vectors.SAMPLE) > 2000


@pytest.mark.parametrize("block, listed", [(1500, 8), (7, 2)])
def test_vectors(monkeypatch, spark, block, listed):
    monkeypatch.setattr(vectors, "BLOCK", block)
    monkeypatch.setattr(vectors, "PER_LIST", listed)
    rng = np.random.default_rng(9)
    base = rng.normal(size=(20, 8))
    rows = []
    for i in range(220):
        x = base[rng.integers(20)] + rng.normal(size=8) * rng.choice([0.02, 0.1, 0.3])
        rows.append((i, [float(v) for v in x], int(rng.integers(3))))
    rows += [(300 + i, rows[0][1], rows[0][2]) for i in range(9)] + [(320, [2 * v for v in rows[0][1]], rows[0][2])]
    odd = [(400, None, 1), (401, [0.0] * 8, 1), (402, [None] * 8, 1), (403, [float("nan")] * 8, 1), (404, rows[0][1], None), (405, [], 0), (406, [1.0], 0), (407, [float("inf")] + [1.0] * 7, 1)]
    found = {r.vec_id: r for r in vectors.near_duplicates(spark.createDataFrame([*rows, *odd], "vec_id long, embedding array<float>, label int")).collect()}
    unit = np.array([r[1] for r in rows], np.float32).astype(float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    label = np.array([r[2] for r in rows])
    link = (unit @ unit.T >= 0.98) & (label[:, None] == label)
    np.fill_diagonal(link, False)
    ids = np.array([r[0] for r in rows])
    least = np.arange(len(rows))
    for _ in range(len(rows)):
        least = np.minimum(least, np.where(link, least[None, :], len(rows)).min(axis=1))
    for k, i in enumerate(ids.tolist()):
        assert (found[i].n_links, found[i].component_id, found[i].kept) == (link[k].sum(), ids[least[k]], ids[least[k]] == i)
    assert all((found[i].n_links, found[i].component_id, found[i].kept) == (0, i, True) for i, *_ in odd)
    assert vectors.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
