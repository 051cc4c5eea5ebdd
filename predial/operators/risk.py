"""Judgements on an opportunity: decisions, metrics, bands, negotiation, display texts."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def percent(value: Column) -> Column:
    """A share up to 1 as a percentage; larger values are percentages already."""
    return F.when(F.abs(value) <= 1, value * 100).otherwise(value)


def first_known(df: DataFrame, *names: str) -> Column:
    """The first non-null of the columns that the frame has."""
    have = [F.col(n) for n in names if n in df.columns]
    return F.coalesce(*have) if have else F.lit(None)


def decision(score: Column, confidence: Column, is_outlier: Column, n: Column, missing_pct: Column) -> Column:
    """Comprar, Revisar or Evitar; weak data lowers it."""
    plain = F.when((score >= 75) & (confidence * 100 >= 75), "Comprar").when(score >= 60, "Revisar").otherwise("Evitar")
    weak = F.coalesce(is_outlier, F.lit(False)) | (F.coalesce(n, F.lit(0)) < 5) | (F.coalesce(missing_pct, F.lit(0.0)) >= 20)
    return F.when(confidence < 0.5, F.when(score >= 75, "Revisar").otherwise("Evitar")).when((plain == "Comprar") & weak, "Revisar").otherwise(plain)


def decision_profile(decided: Column, confidence: Column) -> Column:
    """struct(strategy, profile)."""
    strategy = F.when(decided == "Comprar", "Comprar con validacion").when(decided == "Revisar", "Esperar").otherwise("Evitar")
    profile = F.when(decided == "Comprar", F.when(confidence < 0.85, "Balanceado").otherwise("Conservador")).when(decided == "Revisar", "Balanceado").otherwise("Agresivo")
    return F.struct(strategy.alias("strategy"), profile.alias("profile"))


def risk_level(score: Column, confidence: Column) -> Column:
    return F.when((score >= 75) & (confidence >= 0.75), "Low Risk").when((score >= 60) & (confidence >= 0.55), "Medium Risk").otherwise("High Risk")


def report_verdict(score: Column) -> Column:
    return F.when(score >= 75, "Comprar").when(score >= 55, "Revisar").otherwise("Evitar")


def recommendation(discount: Column, confidence: Column) -> Column:
    return F.when((discount > 0.25) & (confidence > 0.6), "Buena inversion").when(discount > 0.15, "Interesante pero revisar").otherwise("Baja oportunidad")


def bullets(discount: Column, confidence: Column, n: Column, is_outlier: Column) -> Column:
    return F.array_compact(F.array(
        F.when(discount > 0.25, "Descuento alto vs mercado").when(discount > 0.15, "Descuento moderado"),
        F.when(confidence > 0.75, "Alta confianza").when(confidence > 0.5, "Confianza media -> validar").otherwise("Baja confianza"),
        F.when(n >= 8, "Comparables suficientes").otherwise("Pocos comparables"), F.when(is_outlier, "Posible anomalia en precio")))


def investment_metrics(price: Column, appreciation_pct: Column, backend_roi: Column) -> Column:
    """struct(rent_monthly, yield_pct, appreciation, roi): the rent is a three-hundredth of the price."""
    rent = F.when(price > 0, price / 300)
    yields = F.when(price > 0, rent * 12 / price * 100).otherwise(0.0)
    roi = F.when(backend_roi.isNull() | (backend_roi <= appreciation_pct + 0.05), yields + appreciation_pct).otherwise(backend_roi)
    return F.struct(rent.alias("rent_monthly"), yields.alias("yield_pct"), appreciation_pct.alias("appreciation"), roi.alias("roi"))


def data_bands(missing_pct: Column, n: Column, confidence: Column) -> Column:
    """struct(data_consistency, comparable_coverage, model_confidence)."""
    sure = percent(confidence)
    band = lambda first, second: first.otherwise(second)
    return F.struct(
        band(F.when(missing_pct <= 15, "Alta").when(missing_pct <= 30, "Media"), "Baja").alias("data_consistency"),
        band(F.when(n >= 6, "Amplia").when(n >= 3, "Parcial"), "Limitada").alias("comparable_coverage"),
        band(F.when(sure >= 75, "Alta").when(sure >= 60, "Media"), "Baja").alias("model_confidence"))


def negotiation(days: Column, changes: Column, drop: Column, missing_pct: Column, n: Column, confidence: Column) -> Column:
    """struct(seller_profile, score, strategy, confidence): time on market, price changes and drop add up."""
    d, c, p = F.coalesce(days, F.lit(0)), F.coalesce(changes, F.lit(0)), F.coalesce(drop, F.lit(0.0))
    seller = F.when((d > 25) & (c >= 2), "Flexible").when(d > 10, "Neutral").otherwise("Rigid")
    score = F.least(F.least(d * 1.5, F.lit(40.0)) + c * 15 + F.least(p * 100, F.lit(30.0)), F.lit(100.0))
    strategy = F.when(score >= 70, "Aggressive").when(score >= 40, "Moderate").otherwise("Wait")
    sure = F.when((missing_pct > 50) | (n < 4) | (confidence < 0.5), "Low").when((missing_pct > 25) | (n < 7) | (confidence < 0.75), "Medium").otherwise("High")
    tactic = F.when((strategy == "Aggressive") & (sure != "Low"), "aggressive_offer").when(strategy == "Moderate", "moderate_offer").when(strategy == "Wait", "wait_for_evidence").otherwise("validate_by_hand")
    return F.struct(seller.alias("seller_profile"), score.alias("score"), strategy.alias("strategy"), sure.alias("confidence"), tactic.alias("tactic"), (missing_pct > 50).alias("warning"))


def versus_market(price_m2: Column, mean_m2: Column) -> Column:
    """Within eight percent of the comparables' mean is in the market."""
    apart = price_m2 / mean_m2 - 1
    return F.when(~F.coalesce(mean_m2 > 0, F.lit(False)), "En mercado").when(apart < -0.08, "Bajo mercado").when(apart > 0.08, "Sobre mercado").otherwise("En mercado")


def position_status(saved_price: Column, price: Column, saved_score: Column, score: Column) -> Column:
    better = F.coalesce(price < saved_price, F.lit(False)) | F.coalesce(score > saved_score, F.lit(False))
    same = F.coalesce(price == saved_price, F.lit(True)) & F.coalesce(score == saved_score, F.lit(True))
    return F.when(better, "Improving").when(same, "Stable").otherwise("Deteriorating")


def price_action(delta_pct: Column) -> Column:
    return F.when(delta_pct <= -5, "BUY").when(delta_pct <= -3, "WATCH").otherwise("HOLD")


def discount_badge(discount: Column) -> Column:
    return F.when(discount > 0.30, "Posible anomalía").when(discount >= 0.20, "Descuento relevante").otherwise("Descuento moderado")


def similarity_band(score: Column) -> Column:
    return F.when(score >= 0.85, "Alta").when(score >= 0.65, "Media").otherwise("Baja")


def confidence_title(value: Column) -> Column:
    return F.when(value > 75, "Alta confianza").when(value >= 50, "Confianza media").otherwise("Baja confianza")


def dispersion() -> Column:
    """An opportunity's spread of comparable prices against their mean, else of its own range against its price."""
    of_comparables = F.when(F.col("comparables_mean") != 0, (F.col("comparables_max") - F.col("comparables_min")) / F.col("comparables_mean"))
    return F.coalesce(of_comparables, F.when(F.col("m2_construidos") > 0, (F.col("max_price") - F.col("min_price")) / F.col("estimated_price")))


def dashboard(found: DataFrame) -> DataFrame:
    """One row over opportunities: mean discount and confidence, shares of outliers and weak ones, price per m2, spread, score, text."""
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.0))
    clamped = F.greatest(F.least(F.coalesce("confidence_score", F.lit(0.0)), F.lit(1.0)), F.lit(0.0))
    out = found.agg(
        F.count("*").alias("n"), mean("undervaluation").alias("mean_discount"), mean(clamped).alias("mean_confidence"), mean(F.col("is_outlier").cast("double")).alias("outlier_share"),
        mean((F.col("confidence_level") == "low").cast("double")).alias("low_confidence_share"), mean(F.when(F.col("m2_construidos") > 0, F.col("estimated_price") / F.col("m2_construidos"))).alias("mean_price_m2"), mean(dispersion()).alias("dispersion"))
    score = F.col("mean_confidence") * 70 + F.least(F.col("mean_discount") / 0.30, F.lit(1.0)) * 30 - F.col("outlier_share") * 25
    out = out.withColumn("score", F.greatest(F.least(score, F.lit(100.0)), F.lit(0.0)))
    text = F.when((F.col("score") >= 75) & (F.col("outlier_share") < 0.20), "Mercado ineficiente con senales de alta calidad").when(F.col("score") >= 55, "Mercado moderadamente ineficiente - oportunidades selectivas").when(F.col("score") >= 35, "Mercado con senales mixtas - revisar riesgo").otherwise("Mercado poco concluyente - priorizar validacion")
    return out.withColumn("interpretation", text)


def scaled_points(comps: DataFrame, by: str, value: str) -> DataFrame:
    """Min-max scaled positions of a value within each group, from aggregates joined back."""
    ends = comps.groupBy(by).agg(F.min(value).alias("__low"), F.max(value).alias("__high"))
    at = F.when(F.col("__high") > F.col("__low"), (F.col(value) - F.col("__low")) / (F.col("__high") - F.col("__low"))).otherwise(0.5)
    return comps.join(ends, by).withColumn("position", at).drop("__low", "__high")


def property_summary() -> Column:
    """Commune, area, bedrooms and bathrooms of a row as one line; what is missing or zero is left out."""
    shown = lambda c, unit: F.when(F.col(c) != 0, F.concat(F.col(c).cast("string"), F.lit(unit)))
    comuna = F.when(F.col("comuna") != "", F.col("comuna")).otherwise("Sin comuna")
    return F.concat_ws(" | ", comuna, shown("m2_construidos", " m2"), shown("dormitorios", "D"), shown("banos", "B"))


def chart_points(found: DataFrame) -> DataFrame:
    """A row per opportunity and chart (chart, id, x, y, size): return against confidence, discount against comparables.

    Confidence and discount are percentages; a point's size is half of the score, 8 at least; missing numbers are 0.
    """
    known = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    point = lambda chart, x, y: F.struct(F.lit(chart).alias("chart"), x.alias("x"), y.alias("y"))
    points = F.array(point("risk_return", known("roi"), known("confidence_score") * 100), point("discount_comparables", known("undervaluation") * 100, known("comparable_count")))
    size = F.greatest(known("investment_score") / 2, F.lit(8.0))
    return found.select("id", size.alias("size"), F.explode(points).alias("p")).select("p.chart", "id", "p.x", "p.y", "size")


#: Names of the points that stand for a missing price log.
REFERENCE_POINTS = {"Min comparables": "comparables_min", "Promedio": "comparables_mean", "Max comparables": "comparables_max", "Listado": "listing_price"}


def reference_series(found: DataFrame, series: DataFrame) -> DataFrame:
    """(id, place, label, value) of the opportunities without a row in the price ``series``: extremes and mean of the
    comparables and the listed price, in this order; those with under two known values have no row."""
    points = F.array(*[F.struct(F.lit(label).alias("label"), F.col(c).cast("double").alias("value")) for label, c in REFERENCE_POINTS.items()])
    known = found.join(series.select(F.col("listing_id").alias("id")).distinct(), "id", "left_anti").select("id", F.filter(points, lambda p: p["value"].isNotNull()).alias("points"))
    return known.where(F.size("points") >= 2).select("id", F.posexplode("points").alias("place", "p")).select("id", "place", "p.label", "p.value")


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int = 20) -> DataFrame:
    return df.where(F.col(value).isNotNull()).groupBy(F.width_bucket(F.col(value), F.lit(low), F.lit(high), F.lit(bins)).alias("bin")).agg(F.count("*").alias("n"))
