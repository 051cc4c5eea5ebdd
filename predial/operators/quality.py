"""Data quality of listings: issues, usability, outliers, status."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions.prices import quality_clp
from .percentiles import percentiles, with_percentiles

#: Issue codes; the critical ones make a listing unusable.
CRITICAL = ("missing_price", "missing_m2", "invalid_m2_range", "invalid_precio_m2")
MINOR = ("missing_basic_attributes", "unknown_comuna")


def price_m2(cfg: Config = DEFAULT) -> Column:
    return F.when(F.col("m2_construidos") > 0, quality_clp(cfg) / F.col("m2_construidos"))


def issues(cfg: Config = DEFAULT) -> Column:
    """The codes of a listing's issues."""
    ppm2, m2 = price_m2(cfg), F.col("m2_construidos")
    comuna = F.lower(F.trim(F.coalesce("comuna", F.lit(""))))
    rules = [
        (quality_clp(cfg).isNull(), "missing_price"),
        (m2.isNull() | (m2 <= 0), "missing_m2"),
        ((m2 > 0) & ~m2.between(cfg.quality_min_m2, cfg.quality_max_m2), "invalid_m2_range"),
        (~(F.coalesce(F.col("dormitorios") > 0, F.lit(False)) | F.coalesce(F.col("banos") > 0, F.lit(False))), "missing_basic_attributes"),
        (comuna.isin("", "desconocida"), "unknown_comuna"),
        (ppm2.isNull() | ~ppm2.between(cfg.min_clp_m2, cfg.max_clp_m2), "invalid_precio_m2"),
    ]
    return F.array_compact(F.array(*[F.when(F.coalesce(rule, F.lit(False)), F.lit(code)) for rule, code in rules]))


def usable(cfg: Config = DEFAULT) -> Column:
    return ~F.arrays_overlap(issues(cfg), F.array(*map(F.lit, CRITICAL)))


def representative(df: DataFrame) -> Column:
    """Not marked as a duplicate (or never looked at)."""
    return ~F.coalesce(F.col("is_duplicate"), F.lit(False)) if "is_duplicate" in df.columns else F.lit(True)


def clean_valid(cfg: Config = DEFAULT) -> Column:
    """A cleaned row with a positive UF price and an area in range."""
    return F.coalesce((F.col("precio_uf") > 0) & F.col("m2_construidos").between(cfg.min_m2, cfg.max_m2), F.lit(False))


def ingest_valid(source_kind: str = "scraper") -> Column:
    """A usable price (UF decides if present; scraped CLP from ten million) and a positive area."""
    least = F.lit(10_000_000 if source_kind == "scraper" else 1)
    price = F.when(F.col("precio_uf").isNotNull(), F.col("precio_uf") > 0).otherwise(F.col("precio_clp") >= least)
    return F.coalesce(price & (F.col("m2_construidos") > 0), F.lit(False))


def mark_invalid(df: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Active rows without a sane area or without any price that gives 5 to 300 UF a m2 become invalid_data."""
    m2 = F.col("m2_construidos")
    fair = lambda uf: F.coalesce((uf / m2).between(cfg.min_uf_m2, cfg.max_uf_m2), F.lit(False))
    bad = ~F.coalesce(m2.between(cfg.min_m2, cfg.max_m2), F.lit(False)) | ~(fair(F.col("precio_uf")) | fair(F.col("precio_clp") / F.lit(cfg.uf_to_clp)))
    return df.withColumn("status", F.when((F.col("status") == "active") & bad, "invalid_data").otherwise(F.col("status")))


def expire(df: DataFrame, as_of: str, cfg: Config = DEFAULT) -> DataFrame:
    """Active rows not seen for ``expiry_days`` become inactive."""
    old = F.col("last_seen").isNull() | (F.col("last_seen").cast("date") < F.date_sub(F.lit(as_of).cast("date"), cfg.expiry_days))
    return df.withColumn("status", F.when((F.col("status") == "active") & old, "inactive").otherwise(F.col("status")))


def comuna_outliers(df: DataFrame, value: str = "uf_m2", least: int = 4) -> DataFrame:
    """Adds keep: within 1.5 IQR of the commune's quartiles; by the median's half where the IQR is 0; all in small groups.

    Rows without a commune are a group of their own. Quartiles are counted in rounds and joined back, not windows over a commune.
    """
    joined = df.withColumn("__group", F.coalesce("comuna", F.lit("sin_comuna")))
    counts = joined.groupBy("__group").agg(F.count(value).alias("__n"))
    stats = percentiles(joined, ["__group"], value, {"__q1": 0.25, "__q2": 0.5, "__q3": 0.75})
    joined = joined.join(counts.join(stats, "__group"), "__group")
    iqr = F.col("__q3") - F.col("__q1")
    inside = F.when(iqr > 0, F.col(value).between(F.col("__q1") - 1.5 * iqr, F.col("__q3") + 1.5 * iqr)).otherwise(F.col(value).between(F.col("__q2") * 0.5, F.col("__q2") * 1.5))
    return joined.withColumn("keep", F.when(F.col("__n") < least, True).otherwise(F.coalesce(inside, F.lit(False)))).drop("__group", "__n", "__q1", "__q2", "__q3")


def data_sufficiency(df: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """One row: active listings, communes, the share of thin ones, their counts, and low_data_mode with its reasons."""
    priced = F.col("precio_clp").isNotNull() | F.col("precio_uf").isNotNull()
    active = df.where((F.col("status") == "active") & F.col("comuna").isNotNull() & (F.col("m2_construidos") > 0) & priced).where(representative(df))
    per = active.groupBy("comuna").agg(F.count("*").alias("n"))
    total = per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_active"), F.count("*").alias("comunas"), F.count_if(F.col("n") < cfg.low_data_comuna).alias("thin_comunas"))
    thin = F.col("thin_comunas") > F.col("comunas") / 2
    reasons = F.array_compact(F.array(F.when(F.col("total_active") < cfg.low_data_active, "few_active_listings"), F.when(thin, "most_comunas_thin"), F.when(F.col("comunas") == 0, "no_active_listings")))
    return total.withColumn("reasons", reasons).withColumn("low_data_mode", F.size("reasons") > 0)


def coverage(df: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """One row of field coverage ratios, missing counts and price validity."""
    fields = ["comuna", "m2_construidos", "dormitorios", "banos", "estacionamientos", "lat", "lon", "precio_clp", "precio_uf"]
    ppm2 = price_m2(cfg)
    valid = ppm2.between(cfg.min_clp_m2, cfg.max_clp_m2)
    aggregates = [F.count("*").alias("total"), F.count_if(usable(cfg)).alias("usable"), F.count_if(F.coalesce(valid, F.lit(False))).alias("price_m2_valid"), F.count_if(F.coalesce(~valid, F.lit(False))).alias("price_m2_invalid"), F.count_if(ppm2.isNull()).alias("price_m2_unknown")]
    aggregates += [F.count_if(F.col(c).isNull()).alias(f"missing_{c}") for c in fields]
    return df.agg(*aggregates)


def issue_frequency(df: DataFrame, cfg: Config = DEFAULT, top: int = 10) -> DataFrame:
    return df.select(F.explode(issues(cfg)).alias("issue")).groupBy("issue").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "issue").limit(top)


def comuna_coverage(df: DataFrame, cfg: Config = DEFAULT, least: int = 3) -> DataFrame:
    """Per commune: counts, price per m2 spread and coverage ratios; small_group sets thin ones apart."""
    ppm2 = price_m2(cfg)
    share = lambda c: F.avg(F.col(c).isNotNull().cast("double")).alias(f"{c}_coverage")
    df = df.withColumns({"comuna": F.coalesce("comuna", F.lit("sin_comuna")), "__ppm2": ppm2})
    out = df.groupBy("comuna").agg(
        F.count("*").alias("total"), F.count_if(F.col("status") == "active").alias("active"), F.min(ppm2).alias("min_price_m2"), F.max(ppm2).alias("max_price_m2"), share("dormitorios"), share("banos"), share("estacionamientos"), share("lat"))
    out = with_percentiles(out, df, ["comuna"], "__ppm2", {"median_price_m2": 0.5})
    return out.withColumn("small_group", F.col("total") < least)


def top_outliers(df: DataFrame, cfg: Config = DEFAULT, n: int = 20) -> DataFrame:
    """The listings farthest from the sane range of price per m2."""
    ppm2 = price_m2(cfg)
    far = F.greatest(ppm2 / F.lit(cfg.max_clp_m2), F.lit(cfg.min_clp_m2) / ppm2)
    return df.select("id", "comuna", ppm2.alias("price_m2"), far.alias("excess")).where(F.col("excess") > 1).orderBy(F.desc("excess"), "id").limit(n)


def first_per_link(df: DataFrame, link: str = "link", order: list[str] | None = None) -> DataFrame:
    """One row per link: the first by ``order``."""
    rank = F.row_number().over(Window.partitionBy(link).orderBy(*(order or ["id"])))
    return df.withColumn("__rank", rank).where("__rank = 1").drop("__rank")
