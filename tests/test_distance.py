"""Distances of close places to the last digits, since scores that are equal but for those change the order."""

from math import radians

from pyspark.sql import functions as F

from predial.config import DEFAULT
from predial.functions.geo import haversine_km


def test_close_places_lose_no_digits(spark):
    pairs = [(-33.4 - a / 1000, -33.4 - b / 1000) for a in range(0, 100, 7) for b in (a + 1, a + 2, a + 5)]
    rows = spark.createDataFrame(pairs, "a double, b double")
    got = rows.select("a", "b", haversine_km(F.col("a"), F.lit(-70.5), F.col("b"), F.lit(-70.5)).alias("km")).collect()
    # On one meridian the distance is the arc; the difference of two close doubles is exact.
    assert max(abs(r.km / (radians(abs(r.b - r.a)) * DEFAULT.earth_km) - 1) for r in got) < 5e-14
