"""Exchange rates in time: the rate that was known when a price was seen."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Config

#: Rows of one day that one task sorts.
CHUNK = 1_000_000


def rates_in_time(rows: DataFrame, quotes: DataFrame, at: str, hours: float = 12, cfg: Config = DEFAULT) -> DataFrame:
    """The rows with rate, rate_source and rate_age_hours: the last quote (ts, valor) at or before their time ``at``.

    rate_source is live up to ``hours`` of age, cached beyond, and fixed (the constant) where nothing was known, which
    includes rows without a time. Quotes that are null or not positive don't count; of several of one time the highest does.

    An as-of join by days: each day's rows meet that day's quotes and the last one from before, so no task sorts more
    than a share of one day; only a row per day is put in order at once.
    """
    taken = set(rows.columns)
    day = lambda c: F.floor(F.unix_timestamp(c) / 86_400)
    good = quotes.where("ts is not null and valor > 0").groupBy("ts").agg(F.max("valor").alias("valor"))
    good = good.select(day(F.col("ts")).alias("__day"), F.struct(F.col("ts").alias("ts"), F.col("valor").cast("double").alias("valor")).alias("__quote"))
    sized = rows.withColumn("__day", day(F.col(at).cast("timestamp")))
    days = sized.groupBy("__day").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("__chunks"))
    ends = good.groupBy("__day").agg(F.max("__quote").alias("__end"))
    ordered = Window.orderBy("__day")
    days = days.join(ends, "__day", "full").select("__day", F.coalesce("__chunks", F.lit(0)).alias("__chunks"), F.last("__end", ignorenulls=True).over(ordered.rowsBetween(Window.unboundedPreceding, -1)).alias("__before"))
    chunk = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col("__chunks")).cast("int")
    left = sized.join(days, "__day", "left").withColumns({"__chunk": F.coalesce(chunk, F.lit(0)), "__row": F.lit(1), "__at": F.col(at).cast("timestamp")})
    right = good.join(days.where("__chunks > 0"), "__day").select("*", F.explode(F.sequence(F.lit(0), F.col("__chunks") - 1)).alias("__chunk"))
    right = right.select("__day", "__chunk", F.lit(0).alias("__row"), F.col("__quote.ts").alias("__at"), "__quote")
    both = left.unionByName(right, allowMissingColumns=True)
    seen = Window.partitionBy("__day", "__chunk").orderBy("__at", "__row").rowsBetween(Window.unboundedPreceding, 0)
    known = both.withColumn("__known", F.last("__quote", ignorenulls=True).over(seen)).where("__row = 1")
    quote = F.coalesce("__known", "__before")
    age: Column = (F.unix_timestamp("__at") - F.unix_timestamp(quote["ts"])) / F.lit(3600.0)
    source = F.when(quote.isNull() | F.col("__at").isNull(), "fixed").when(age <= hours, "live").otherwise("cached")
    new = {"rate_source": source, "rate_age_hours": F.when(source != "fixed", age), "rate": F.when(source == "fixed", F.lit(float(cfg.uf_to_clp))).otherwise(quote["valor"])}
    return known.withColumns(new).select(*[c for c in rows.columns if c not in new], *[c for c in ("rate", "rate_source", "rate_age_hours") if c not in taken or c in new])
