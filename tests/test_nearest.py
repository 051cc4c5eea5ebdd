"""The outward search for comparables, against the ranked pair join and a plain loop."""

import random

import pytest
from pyspark.sql import functions as F

from predial.config import DEFAULT
from predial.operators import valuation
from tests.test_listings import frame, listing

SHOWN = ["t_id", "c_id", "same_segment", "adjacent"]


def by_join(targets, listings, cfg, least):
    """All pairs, ranked."""
    own = valuation.Window.partitionBy("t_id")
    pairs = valuation.capped(valuation.candidates(targets, listings, cfg), cfg)
    pairs = pairs.withColumn("n1", F.count_if("strict").over(own)).withColumn("n2", F.count_if("wide").over(own)).withColumn("adjacent", F.col("n1") < least)
    return pairs.where(F.when(F.col("adjacent") & (F.col("n2") > F.col("n1")), F.col("wide")).otherwise(F.col("strict")))


def rows(seed, n):
    rng = random.Random(seed)
    areas = [30.0, 45.0, 48.0, 49.9, 50.0, 52.5, 61.0, 70.0, 95.0, 99.0, 100.0, 100.5, 110.0, 160.0]
    return [
        listing(i, m2_construidos=rng.choice([*areas, round(rng.uniform(25, 180), 2)]), dormitorios=rng.choice([None, 0, 1, 2, 3, 4]), banos=rng.choice([None, 1, 2, 3]), estacionamientos=rng.choice([None, 0, 1, 2]), comuna=rng.choice(["Macul", "Macul", "Ñuñoa", None]), precio_clp=rng.choice([None, 5, 120_000_000, 140_000_000]))
        for i in range(1, n)
    ]


@pytest.mark.parametrize(("seed", "cap", "least", "chunk"), [(1, 150, 5, 2000), (2, 7, 3, 2000), (3, 4, 30, 3), (4, 1, 1, 1)])
def test_the_search_finds_what_the_ranked_join_finds(spark, monkeypatch, seed, cap, least, chunk):
    from dataclasses import replace

    monkeypatch.setattr(valuation, "CHUNK", chunk)
    monkeypatch.setattr(valuation, "_WINDOW", 2)
    cfg = replace(DEFAULT, max_candidates=cap)
    base = frame(spark, rows(seed, 220))
    got = sorted(map(tuple, valuation._segmented(base, base, cfg, least).select(SHOWN).collect()))
    assert got == sorted(map(tuple, by_join(base, base, cfg, least).select(SHOWN).collect()))


def test_windows_grow_until_all_nearer_ones_are_inside(monkeypatch):
    import numpy as np

    monkeypatch.setattr(valuation, "_WINDOW", 1)
    rng = np.random.default_rng(1)
    for _ in range(200):
        area = np.sort(rng.choice([50.0, 51.0, 52.0, 53.0, 60.0, 40.0], 60))
        ids, fits = rng.permutation(60), rng.random(60) < 0.2
        m = float(rng.choice([50.0, 52.0, 45.0]))
        want = sorted((abs(a - m), i, p) for p, (a, i, f) in enumerate(zip(area, ids, fits)) if f and m * 0.85 <= a <= m * 1.15)[:5]
        assert valuation._nearest(area, np.arange(60), ids, fits, m, 0.15, 5).tolist() == [p for *_, p in want]


def test_no_targets_and_no_candidates(spark):
    base = frame(spark, rows(5, 20))
    assert valuation._segmented(base.limit(0), base, DEFAULT, 5).count() == valuation._segmented(base, base.limit(0), DEFAULT, 5).count() == 0


def relaxed_by_loop(base, cap):
    """Each target against all others, in plain Python."""
    of = lambda m: 0 if m < 50 else 1 if m <= 100 else 2
    rows = valuation.pool(base).where("c_usable and c_price is not null").collect()
    out = {}
    for t in base.select("id", "comuna", "m2_construidos").collect():
        m = t.m2_construidos
        if m is None or not 10 <= m <= 1000:
            continue
        near = [(abs(c.c_m2_construidos - m), c.c_id, c.c_price / c.c_m2_construidos, c.c_comuna) for c in rows if c.c_id != t.id and m * 0.5 <= c.c_m2_construidos <= m * 1.5 and abs(of(m) - of(c.c_m2_construidos)) <= 1]
        own = [x for x in near if x[3] is not None and x[3] == t.comuna]
        kept = sorted(own or near)[:cap]
        if kept:
            out[t.id] = (round(sum(x[2] for x in kept) / len(kept) * m, 3), len(kept), bool(own))
    return out


@pytest.mark.parametrize(("seed", "cap", "shares"), [(1, 50, 1000), (2, 3, 5), (3, 1, 1000)])
def test_relaxed_estimates_are_those_of_a_plain_loop(spark, monkeypatch, seed, cap, shares):
    monkeypatch.setattr(valuation, "_SHARES", shares)
    some = rows(seed, 160)
    # Half of all rows have one area, and one commune has a single listing.
    hot = [listing(1_000 + i, m2_construidos=61.0, comuna="Macul" if i % 3 else "Lampa", precio_clp=130_000_000 + i) for i in range(150)]
    alone = [listing(2_000, m2_construidos=75.0, comuna="Alhue", precio_clp=120_000_000), listing(2_001, m2_construidos=None), listing(2_002, m2_construidos=5.0)]
    base = frame(spark, some + hot + alone)
    got = {r.id: (round(r.estimate, 3), r.comparables, r.same_comuna) for r in valuation.relaxed_estimates(base, base, cap=cap).collect()}
    want = relaxed_by_loop(base, cap)
    assert got.keys() == want.keys() and 2_000 in got and not got[2_000][2]
    assert all(got[i][1:] == want[i][1:] and abs(got[i][0] - want[i][0]) < 1 for i in got)


def test_relaxed_estimates_of_nothing(spark):
    base = frame(spark, rows(5, 20))
    assert valuation.relaxed_estimates(base.limit(0), base).count() == valuation.relaxed_estimates(base, base.limit(0)).count() == 0
