"""The watchlist and what became of its listings."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions.prices import ask_clp
from .risk import position_status, price_action


def add_saved(saved: DataFrame, new: DataFrame) -> DataFrame:
    """Insert if absent, by listing_id; of repeated new ones the earliest saved."""
    first = new.groupBy("listing_id").agg(F.min_by(F.struct(*[c for c in new.columns if c != "listing_id"]), F.struct("saved_at", "precio_guardado")).alias("r")).select("listing_id", "r.*")
    return saved.unionByName(first.join(saved, "listing_id", "left_anti"))


def remove_saved(saved: DataFrame, gone: DataFrame) -> DataFrame:
    return saved.join(gone, "listing_id", "left_anti")


def newest_first(saved: DataFrame) -> DataFrame:
    return saved.orderBy(F.desc("saved_at"), "listing_id")


def lookup(listings: DataFrame, keys: DataFrame, key: str = "key") -> DataFrame:
    """The listing whose source id or own id a key is (the smallest id of several)."""
    both = listings.select("id", F.explode(F.array_distinct(F.array_compact(F.array("source_listing_id", F.col("id").cast("string"))))).alias(key))
    return keys.join(both, key).groupBy(key).agg(F.min("id").alias("id"))


def positions(saved: DataFrame, listings: DataFrame, opportunities: DataFrame, signals: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Saved listings with their present price and score, change, status and action; the deepest fall first."""
    ids = lookup(listings, saved.select(F.col("listing_id").alias("key")).distinct())
    now = listings.select("id", "comuna", ask_clp(cfg).alias("precio_actual"))
    score = opportunities.select("id", F.col("investment_score").alias("score_actual"))
    base = saved.join(ids, saved.listing_id == ids.key, "left").drop("key").join(now, "id", "left").join(score, "id", "left").join(signals, "id", "left")
    delta = F.when(F.col("precio_guardado") > 0, (F.col("precio_actual") - F.col("precio_guardado")) / F.col("precio_guardado") * 100)
    out = base.withColumn("delta_pct", delta).withColumn("status", position_status(F.col("precio_guardado"), F.col("precio_actual"), F.col("score_guardado"), F.col("score_actual"))).withColumn("action", price_action(F.col("delta_pct")))
    return out.orderBy(F.coalesce("delta_pct", F.lit(999.0)), "listing_id")


def buckets(found: DataFrame) -> DataFrame:
    return found.agg(F.count("*").alias("saved"), F.count_if(F.col("action") == "BUY").alias("opportunities"), F.count_if(F.col("action") == "WATCH").alias("watching"), F.count_if(F.col("action") == "HOLD").alias("neutral"), F.avg("delta_pct").alias("mean_change"), F.count_if(F.col("score_actual") >= 70).alias("strong_signals"))


def movers(found: DataFrame) -> DataFrame:
    """The greatest fall, the greatest rise, and the most improved score."""
    gain = F.col("score_actual") - F.col("score_guardado")
    return found.agg(F.min_by("listing_id", F.struct("delta_pct", "listing_id")).alias("best"), F.max_by("listing_id", F.struct("delta_pct", "listing_id")).alias("worst"), F.max_by("listing_id", F.struct(gain, "listing_id")).alias("most_improved"))
