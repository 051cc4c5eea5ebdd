"""The search for the best comparables by score, against all scored pairs."""

import random
import time

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from predial.config import DEFAULT
from predial.operators import evaluate, valuation
from tests.test_listings import frame
from tests.test_nearest import rows


def placed(spark, seed, n):
    rng = random.Random(seed)
    at = lambda low: rng.choice([None, low, low - 0.01, round(low - rng.uniform(0, 0.1), 4)])
    return frame(spark, [r | {"lat": at(-33.4), "lon": at(-70.5), "url": rng.choice([r["url"], "https://x.cl/1", None]), "source_listing_id": rng.choice([r["source_listing_id"], "7", None])} for r in rows(seed, n)])


def top(pairs, cap):
    rank = F.row_number().over(Window.partitionBy("t_id").orderBy(F.desc("score"), "c_id"))
    return sorted(tuple(r) for r in pairs.withColumn("rank", rank).where(F.col("rank") <= cap).select("t_id", "rank", "c_id", "score", "price_m2").collect())


@pytest.mark.parametrize(("seed", "cap", "chunk"), [(11, 10, 2000), (12, 1, 3), (13, 400, 2000)])
def test_best_by_rooms(spark, monkeypatch, seed, cap, chunk):
    monkeypatch.setattr(valuation, "CHUNK", chunk)
    base = placed(spark, seed, 220)
    want = valuation.scored(valuation.candidates(base, base).where("same_segment and c_usable"))
    assert top(valuation.best_scored(base, base, cap=cap), cap) == top(want, cap)


@pytest.mark.parametrize("scores", [1_000_000, 5])
def test_best_strangers(spark, monkeypatch, scores):
    monkeypatch.setattr(valuation, "_SCORES", scores)
    base = placed(spark, 14, 240)
    base = base.withColumn("names", F.array_compact(F.array("url", F.concat("fuente", F.lit(" "), "source_listing_id")))).withColumn("names", F.coalesce("names", F.array().cast("array<string>")))
    pairs = valuation.candidates(base, base, by_rooms=False, extra=("names",)).where("t_comuna is not null")
    close = lambda c: F.abs(F.col(f"t_{c}") - F.col(f"c_{c}")) <= 1
    m, o = F.col("t_m2_construidos"), F.col("c_m2_construidos")
    twin = (F.abs(m - o) <= F.greatest(m, o) * DEFAULT.duplicate_m2) & close("dormitorios") & close("banos") & F.coalesce(close("estacionamientos"), F.lit(True))
    want = valuation.scored(pairs.where(~F.arrays_overlap("t_names", "c_names")).where(~F.coalesce(twin, F.lit(False))))
    assert top(valuation.best_scored(base, base, by_rooms=False, names="names"), 10) == top(want, 10)


def test_holdout_of_many_listings_ends(spark):
    """20,000 listings of one commune have some 10 million pairs of held-out rows and others in range."""
    n = 20_000
    base = spark.range(1, n + 1).select(
        "id", F.lit("yapo").alias("fuente"), F.col("id").cast("string").alias("source_listing_id"), F.concat(F.lit("https://x.cl/"), F.col("id").cast("string")).alias("url"), F.lit("active").alias("status"), F.lit("x").alias("titulo"), F.lit("Macul").alias("comuna"),
        (-33.4 - F.col("id") % 100 / 1000).alias("lat"), (-70.5 - F.col("id") % 70 / 1000).alias("lon"), ((F.col("id") % 7 + 40) * 1_000_000).alias("precio_clp"), F.lit(None).cast("double").alias("precio_uf"), (30.0 + F.col("id") % 51 * 3).alias("m2_construidos"),
        (F.col("id") % 4).cast("int").alias("dormitorios"), (F.col("id") % 3).cast("int").alias("banos"), (F.col("id") % 5).cast("int").alias("estacionamientos"))
    start = time.time()
    found = evaluate.holdout(base.repartition(4))
    assert found.agg(F.count("*"), F.max("mode")).first()[:] == (n // 4, "STRICT")
    assert time.time() - start < 40
