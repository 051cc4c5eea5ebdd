"""Price history: drops, evolution, days on market, and the append-only log."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions.prices import ask_clp, historical_clp

#: Columns that order a listing's log within a day, as far as the log has them.
TIES = ("id", "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice", "precio_clp_nuevo")


def log_order(history: DataFrame) -> list[str]:
    return ["fecha_captura", *[c for c in TIES if c in history.columns]]


def _price(history: DataFrame, cfg: Config) -> Column:
    return historical_clp(history.columns, cfg)


def signals(listings: DataFrame, history: DataFrame, as_of: str, cfg: Config = DEFAULT) -> DataFrame:
    """Per listing: price_drop_pct from the first logged price, and time_on_market_days."""
    first = history.groupBy("listing_id").agg(F.min_by(F.struct(_price(history, cfg).alias("price"), "fecha_captura"), F.struct(*log_order(history))).alias("first"))
    now, start = ask_clp(cfg), F.coalesce("fecha_publicacion", F.col("first.fecha_captura"), "fecha_captura")
    drop = F.when((now > 0) & (F.col("first.price") > now), (F.col("first.price") - now) / F.col("first.price")).otherwise(0.0)
    joined = listings.join(first, listings.id == first.listing_id, "left")
    return joined.select("id", drop.alias("price_drop_pct"), F.greatest(F.datediff(F.lit(as_of).cast("date"), start), F.lit(0)).alias("time_on_market_days"))


def evolution(listings: DataFrame, history: DataFrame, as_of: str, cfg: Config = DEFAULT) -> DataFrame:
    """Per listing, over its logged prices and the present one: high, low, drop from the peak, range, changes, trend, age."""
    today = F.lit(as_of).cast("date")
    price = _price(history, cfg)
    day = F.coalesce(F.col("fecha_cambio").cast("date"), F.col("fecha_captura")) if "fecha_cambio" in history.columns else F.col("fecha_captura")
    logged = history.withColumn("__price", price).where("__price is not null").select(F.col("listing_id").alias("id"), F.struct(*log_order(history)).alias("seq"), day.alias("day"), "__price")
    ask = listings.select("id", ask_clp(cfg).alias("__price")).where("__price is not null")
    # One stable order: by day, logged points before the present one.
    points = logged.select("id", "day", F.lit(0).alias("now"), "seq", "__price")
    points = points.unionByName(ask.select("id", today.alias("day"), F.lit(1).alias("now"), F.lit(None).cast(logged.schema["seq"].dataType).alias("seq"), "__price"))
    order = Window.partitionBy("id").orderBy(F.col("day").asc_nulls_last(), "now", "seq")
    steps = points.withColumn("before", F.lag("__price").over(order)).withColumn("n", F.row_number().over(order))
    changed = F.col("before").isNotNull() & (F.col("__price") != F.col("before"))
    per = steps.groupBy("id").agg(
        F.max("__price").alias("all_time_high"), F.min("__price").alias("all_time_low"), F.count_if(changed).alias("price_changes"),
        F.max_by(F.when(changed, F.col("day")), F.when(changed, F.col("n"))).alias("last_change"), F.max_by(F.when(changed, F.col("before")), F.when(changed, F.col("n"))).alias("last_distinct"))
    starts = history.groupBy("listing_id").agg(F.min("fecha_captura").alias("first_day"))
    base = listings.select("id", ask_clp(cfg).alias("current_price"), "fecha_publicacion").join(per, "id", "left").join(starts, F.col("id") == F.col("listing_id"), "left")
    high, low, now = F.col("all_time_high"), F.col("all_time_low"), F.col("current_price")
    trend = F.when(now.isNotNull() & F.col("last_distinct").isNotNull() & (now != F.col("last_distinct")), F.when(now < F.col("last_distinct"), "down").otherwise("up")).otherwise("stable")
    return base.select(
        "id", "current_price", "all_time_high", "all_time_low", F.when(now.isNotNull(), F.greatest((high - now) / high, F.lit(0.0))).alias("price_drop_from_peak_pct"), F.greatest((high - low) / high, F.lit(0.0)).alias("price_range_pct"),
        F.coalesce("price_changes", F.lit(0)).alias("price_changes"), F.greatest(F.datediff(today, "last_change"), F.lit(0)).alias("last_price_change_days"), trend.alias("trend"),
        F.greatest(F.datediff(today, F.least("fecha_publicacion", "first_day")), F.lit(0)).alias("days_on_market"))


def ordered(history: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """The log of every listing in its order: listing_id, step (from 1), day and price in CLP."""
    step = F.row_number().over(Window.partitionBy("listing_id").orderBy(*log_order(history)))
    return history.select("listing_id", step.alias("step"), "fecha_captura", _price(history, cfg).alias("price"))


def chart_series(history: DataFrame) -> DataFrame:
    """The dated prices of each listing in order; rows without a price are dropped."""
    price = F.coalesce(*[F.col(c) for c in ("precio_clp_nuevo", "precio_clp") if c in history.columns])
    return history.select("listing_id", "fecha_captura", price.alias("price")).where("price is not null").orderBy("listing_id", "fecha_captura", "price")


def initial_rows(listings: DataFrame, history: DataFrame) -> DataFrame:
    """A first log row for every priced listing that has none."""
    priced = listings.where("precio_clp is not null or precio_uf is not null")
    missing = priced.join(history, priced.id == history.listing_id, "left_anti")
    return missing.select(F.col("id").alias("listing_id"), F.col("precio_clp").alias("precio_clp_nuevo"), F.col("precio_uf").alias("precio_uf_nuevo"), "fecha_captura")


def append_changes(history: DataFrame, incoming: DataFrame) -> DataFrame:
    """Rows to append for listings that are new or whose prices changed, null being equal to null.

    incoming: listing_id, precio_clp_anterior, precio_uf_anterior, precio_clp_nuevo, precio_uf_nuevo, fecha_captura,
    was_created. Nothing is appended where the log's latest row has the same new prices and day.
    """
    order = F.struct(*(["fecha_cambio"] if "fecha_cambio" in history.columns else []), *log_order(history))
    columns = ["precio_clp_nuevo", "precio_uf_nuevo", "fecha_captura"]
    old = F.struct(*[(F.col(c) if c in history.columns else F.lit(None).cast("double")).alias(c) for c in columns])
    latest = history.groupBy("listing_id").agg(F.max_by(old, order).alias("__last"))
    changed = F.col("was_created") | ~F.col("precio_clp_anterior").eqNullSafe(F.col("precio_clp_nuevo")) | ~F.col("precio_uf_anterior").eqNullSafe(F.col("precio_uf_nuevo"))
    joined = incoming.where(changed).join(latest, "listing_id", "left")
    same = F.col("__last").isNotNull()
    for c in columns:
        same &= F.col(c).eqNullSafe(F.col(f"__last.{c}"))
    return joined.where(~same).select("listing_id", "precio_clp_anterior", "precio_uf_anterior", *columns)
