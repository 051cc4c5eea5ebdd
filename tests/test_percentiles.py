"""Percentiles by counting rounds, against the built-in aggregate."""

import math

import pytest
from pyspark.sql import functions as F

from predial.operators import percentiles as module
from predial.operators.percentiles import percentiles

SHARES = {"p0": 0.0, "p10": 0.1, "p25": 0.25, "p50": 0.5, "p99": 0.99, "p100": 1.0}


def _both(df, by=("g",)):
    built = df.groupBy(*by).agg(*[F.percentile("x", F.lit(p)).alias(n) for n, p in SHARES.items()])
    key = lambda r: tuple(str(r[c]) for c in by)
    return ({key(r): tuple(r[n] for n in SHARES) for r in d.collect()} for d in (percentiles(df, list(by), "x", SHARES), built))


@pytest.fixture
def small(monkeypatch):
    """Rounds as of long groups, on few rows."""
    monkeypatch.setattr(module, "SORTED", 3)
    monkeypatch.setattr(module, "BINS", 16)


def test_rounds_give_the_built_in_values(spark, small):
    rows = [("even", float(i)) for i in range(101)] + [("ties", 7.0)] * 50 + [("ties", 8.0), ("ties", 1.0)] + [("one", 3.5), (None, 2.0), (None, 5.0), ("none", None)]
    rows += [("sizes", s * 10.0**e) for e in range(-300, 300, 7) for s in (1, -1)] + [("close", math.nextafter(1.0, 2.0)), ("close", 1.0)] * 9 + [("ties", None)]
    rows += [("tiny", v) for v in (5e-324, 0.0, 1e-323, -5e-324) * 5]
    found, built = _both(spark.createDataFrame(rows, "g string, x double"))
    assert found == built


def test_infinities_and_nan(spark, small):
    rows = [("a", v) for v in [math.inf] * 5 + [-math.inf] * 5 + [float(i) for i in range(20)] + [math.nan] * 3]
    row = percentiles(spark.createDataFrame(rows, "g string, x double"), ["g"], "x", {"least": 0.0, "mid": 0.5, "most": 1.0}).first()
    assert (row.least, row.mid, row.most) == (-math.inf, 9.5, math.inf)


def test_ranges_that_meet_the_rows_in_a_join(spark, small, monkeypatch):
    monkeypatch.setattr(module, "SENT", 0)
    found, built = _both(spark.range(3000).select((F.col("id") % 7).alias("g"), (F.col("id") * 37 % 1001 / 3).alias("x")))
    assert found == built


def test_two_keys_and_clashing_names(spark, small):
    df = spark.range(500).select((F.col("id") % 3).alias("low"), (F.col("id") % 2).alias("n"), (F.col("id") * 13 % 97).cast("double").alias("x"))
    found, built = _both(df, ("low", "n"))
    assert found == built


def test_an_empty_table(spark):
    assert percentiles(spark.createDataFrame([], "g string, x double"), ["g"], "x", SHARES).count() == 0


def test_a_long_group_takes_rounds(spark):
    df = spark.range(600_000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise("rest").alias("g"), (F.pmod(F.xxhash64("id"), F.lit(10**9)) / 7 + 1e6).alias("x"))
    found, built = _both(df)
    assert found == built
