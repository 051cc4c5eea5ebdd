"""Exact percentiles of groups of any size, by counting ranges in rounds: a group's values never meet in one task."""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import checkpointed

#: A range of at most so many values is sorted as an array; a longer one is counted again, in BINS parts.
SORTED = 16_384
BINS = 4_096
#: Up to so many ranges go to the tasks as a whole (about 100 bytes each); more meet the rows in a join of SALTS parts a group.
SENT = 100_000
SALTS = 16


def _bin(x: Column, low: Column, high: Column, curved: bool) -> Column:
    """The part of [low, high] that x lies in: never falling as x grows, low in the first part and high in the last alone.

    Linear, or by the logarithm of the size, which parts values of very different sizes.
    """
    at = (lambda v: F.signum(v) * F.log1p(F.abs(v))) if curved else (lambda v: v / 2)
    width = at(high) - at(low)
    inner = F.least(F.greatest(F.floor(F.nanvl((at(x) - at(low)) / width * BINS, F.lit(1.0))), F.lit(0)), F.lit(BINS - 1))
    return F.when(x <= low, F.lit(0)).when(x >= high, F.lit(BINS)).when(width == 0, F.lit(1)).otherwise(inner).cast("int")


def _inside(rows: DataFrame, ranges: DataFrame, n: int) -> DataFrame:
    """The rows that lie in one of n ranges, with it."""
    here = (F.col("x") >= F.col("low")) & (F.col("x") <= F.col("high"))
    if n <= SENT:
        return rows.join(F.broadcast(ranges), "g").where(here)
    salted = ranges.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("x"), F.lit(SALTS)).cast("int")).join(salted, ["g", "salt"]).where(here).drop("salt")


def _ranks(n: Column, shares: tuple[float, ...]) -> Column:
    """The places, from 0, of the values on both sides of each share."""
    places = [f((n - 1) * F.lit(float(p))).cast("long") for p in shares for f in (F.floor, F.ceil)]
    return F.array_sort(F.array_distinct(F.array(*places)))


def _selected(rows: DataFrame, ranges: DataFrame) -> DataFrame:
    """(g, rank, x) of all the ranks that the ranges (g, low, high, before, n, ranks) hold."""
    found, turn = [], 0
    while True:
        single = F.col("low") == F.col("high")
        found.append(ranges.where(single).select("g", F.explode("ranks").alias("rank"), F.col("low").alias("x")))
        few = F.col("n") <= SORTED
        shorts, longs = ranges.agg(F.count_if(~single & few), F.count_if(~single & ~few)).first()
        gathered = _inside(rows, ranges.where(~single & few), shorts).groupBy("g", "low", "before", "ranks").agg(F.sort_array(F.collect_list("x")).alias("xs"))
        taken = F.explode("ranks").alias("rank")
        found.append(gathered.select("g", "before", "xs", taken).select("g", "rank", F.get("xs", (F.col("rank") - F.col("before")).cast("int")).alias("x")))
        if not longs:
            return reduce(DataFrame.unionByName, found)
        part = _bin(F.col("x"), F.col("low"), F.col("high"), turn % 2 == 1).alias("bin")
        counts = _inside(rows, ranges.where(~single & ~few), longs).groupBy("g", F.col("low").alias("from"), "before", "ranks", part).agg(F.min("x").alias("low"), F.max("x").alias("high"), F.count("*").alias("n"))
        below = F.col("before") + F.sum("n").over(Window.partitionBy("g", "from").orderBy("bin")) - F.col("n")
        counts = counts.withColumn("before", below)
        mine = F.filter("ranks", lambda r: (r >= F.col("before")) & (r < F.col("before") + F.col("n")))
        ranges = checkpointed(counts.withColumn("ranks", mine).where(F.size("ranks") > 0).select("g", "low", "high", "before", "n", "ranks"))
        turn += 1


def percentiles(df: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """One row per group of ``by`` with exact interpolated percentiles of a number, a column per name in ``shares``.

    As the built-in percentile gives them. Null and NaN do not count; a group without a value has null percentiles; null
    is a group of its own; infinities count as extremes. A round counts at most BINS + 1 parts a range, of which the
    ranks' own go on, so that no task holds over SORTED values of a group. A range ends when its values are few or
    equal; usual prices take one round to a hundred million rows a group, each a pass over the rows.
    """
    x = F.col(value).cast("double")
    rows = df.select(F.struct(*by).alias("g"), F.when(~F.isnan(x), x).alias("x"))
    sizes = checkpointed(rows.groupBy("g").agg(F.count("x").alias("n"), F.min("x").alias("low"), F.max("x").alias("high")))
    rows = rows.where("x is not null")
    some = sizes.where("n > 0").select("g", "low", "high", F.lit(0).cast("long").alias("before"), "n", _ranks(F.col("n"), tuple(shares.values())).alias("ranks"))
    values = _selected(rows, some).groupBy("g").agg(F.map_from_entries(F.collect_list(F.struct("rank", "x"))).alias("at"))

    def between(p: float) -> Column:
        place = (F.col("n") - 1) * F.lit(float(p))
        first, last = F.floor(place).cast("long"), F.ceil(place).cast("long")
        low, high = F.element_at("at", first), F.element_at("at", last)
        return F.when(low == high, low).otherwise((last - place) * low + (place - first) * high)

    return sizes.join(values, "g", "left").select(*[F.col("g")[c].alias(c) for c in by], *[between(p).alias(name) for name, p in shares.items()])


def with_percentiles(aggregates: DataFrame, df: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Aggregates of the groups of ``by``, with the percentiles of a value; null finds null."""
    found = percentiles(df, by, value, shares).select(F.struct(*by).alias("__g"), *shares)
    return aggregates.withColumn("__g", F.struct(*by)).join(found, "__g", "left").drop("__g")
