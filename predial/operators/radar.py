"""The opportunity radar: undervalued listings with their signals, scores and texts."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions.prices import ask_clp, short_price
from .components import checkpointed
from .dedup import mark_duplicates
from .history import evolution, signals
from .quality import data_sufficiency, representative
from .valuation import market_values


def radar_candidates(listings: DataFrame) -> DataFrame:
    """Active representatives with commune, area and any price."""
    keep = (F.col("status") == "active") & F.col("comuna").isNotNull() & (F.col("m2_construidos") > 0) & (F.col("precio_clp").isNotNull() | F.col("precio_uf").isNotNull())
    return listings.where(keep).where(representative(listings))


def missing_fields() -> Column:
    fields = ("comuna", "dormitorios", "banos", "estacionamientos", "lat", "lon")
    count = F.lit(0)
    for name in fields:
        count = count + F.col(name).isNull().cast("int")
    return count


def confidence_level(score: Column, is_outlier: Column) -> Column:
    return F.when(is_outlier, "low").when(score >= 0.8, "high").when(score >= 0.65, "medium").otherwise("low")


def count_confidence(n: Column, missing_pct: Column) -> Column:
    """Confidence by comparables and missing fields."""
    return F.when((n < 3) | (missing_pct >= 40), "low").when(n <= 5, "medium").when(missing_pct <= 20, "high").otherwise("medium")


def opportunity_score(undervaluation: Column, confidence: Column, drop: Column, days: Column, missing_penalty: Column) -> Column:
    bonus = F.when(days >= 120, 0.06).when(days >= 60, 0.03).otherwise(0.0)
    value = undervaluation * 0.65 + confidence * 0.25 + F.least(drop, F.lit(0.20)) * 0.20 + bonus - missing_penalty
    return F.greatest(F.least(value, F.lit(1.0)), F.lit(0.0))


def investment_score(discount_pct: Column, confidence: Column, n: Column, is_outlier: Column, missing: Column) -> Column:
    """struct(total, discount, confidence, comparables, risk, missing_data_penalty).

    ``missing`` is a percentage, but a value up to 1 is read as a fraction.
    """
    missing_pct = F.when(missing > 1, missing).otherwise(missing * 100)
    fraction = F.when(missing > 1, missing / 100).otherwise(missing)
    discount = F.least(F.greatest(discount_pct / 100, F.lit(0.0)) / 0.30, F.lit(1.0))
    penalty = F.when(missing_pct > 30, 20).when(missing_pct > 15, 10).otherwise(0)
    sure = F.greatest(F.least(confidence, F.lit(1.0)), F.lit(0.0)) * F.when(missing_pct > 30, 0.8).when(missing_pct > 15, 0.9).otherwise(1.0)
    known = F.least(n / F.lit(10.0), F.lit(1.0))
    risk = F.greatest(F.lit(0.0), 1 - (F.when(is_outlier, 0.3).otherwise(0.0) + fraction))
    score = discount * 0.4 + sure * 0.3 + known * 0.2 + risk * 0.1
    total = F.greatest(F.lit(0), (score * 100).cast("int") - penalty)
    return F.struct(total.alias("total"), (discount * 100).alias("discount"), (sure * 100).alias("confidence"), (known * 100).alias("comparables"), (risk * 100).alias("risk"), penalty.alias("missing_data_penalty"))


def verdict(score: Column) -> Column:
    return F.when(score >= 75, "Comprar").when(score >= 55, "Interesante").otherwise("Evitar")


def label(score: Column) -> Column:
    return F.when(score >= 75, "🟢 Alta oportunidad").when(score >= 55, "🟡 Revisar").otherwise("🔴 Riesgoso")


def legal_risk(n: Column, confidence: Column, missing_pct: Column) -> Column:
    """struct(legal_risk_score, legal_risk_level, legal_flags, legal_summary): few comparables, low confidence and gaps add up from 30."""
    sure = F.when(confidence <= 1, confidence * 100).otherwise(confidence)
    score = F.least(F.lit(30) + F.when(n < 3, 25).when(n < 6, 15).otherwise(0) + F.when(sure < 60, 20).when(sure < 75, 10).otherwise(0) + F.when(missing_pct > 30, 20).when(missing_pct > 15, 10).otherwise(0), F.lit(100))
    flags = F.array_compact(F.array(
        F.when(n < 3, "Muy pocos comparables").when(n < 6, "Pocos comparables"), F.when(sure < 60, "Baja confianza en datos"), F.when(missing_pct > 15, "Datos incompletos"),
        F.when((n < 3) & (sure < 60), "Alta incertidumbre en valorización"), F.when((missing_pct > 30) & (sure < 70), "Información insuficiente para evaluación confiable"),
        F.when((n >= 8) & (sure >= 80), "Buena base de comparables y alta confiabilidad")))
    count = n.cast("string")
    summary = F.when(score < 40, F.concat(F.lit("No se detectan riesgos estructurales. Basado en "), count, F.lit(" comparables con buena consistencia de datos."))).when(
        score < 70, F.concat(F.lit("Información parcial ("), count, F.lit(" comparables). Se recomienda validación adicional antes de invertir."))
    ).otherwise(F.concat(F.lit("Alta incertidumbre: solo "), count, F.lit(" comparables y datos incompletos. Validar exhaustivamente.")))
    return F.struct(score.alias("legal_risk_score"), F.when(score < 40, "Bajo").when(score < 70, "Medio").otherwise("Alto").alias("legal_risk_level"), flags.alias("legal_flags"), summary.alias("legal_summary"))


def appreciation(comuna: Column) -> Column:
    return F.when(comuna.isin("Vitacura", "Las Condes"), 0.035).when(comuna.isin("Providencia", "Ñuñoa"), 0.03).otherwise(0.02)


def _percent(value: Column, digits: int) -> Column:
    return F.format_string(f"%.{digits}f%%", value * 100)


def reason_text() -> Column:
    parts = [
        F.concat(_percent(F.col("undervaluation"), 1), F.lit(" bajo valor estimado")),
        F.concat(F.col("comparable_count").cast("string"), F.lit(" comparables")),
        F.concat(F.lit("confianza "), _percent(F.col("confidence_score"), 0)),
        F.when(F.col("price_drop_pct") >= 0.03, F.concat(F.lit("baja de precio "), _percent(F.col("price_drop_pct"), 1))),
        F.concat(F.col("time_on_market_days").cast("string"), F.lit(" dias en mercado")),
        F.when(F.col("missing_data_penalty") > 0, F.concat(F.lit("penalizacion por datos faltantes "), _percent(F.col("missing_data_penalty"), 0))),
    ]
    return F.concat_ws("; ", *parts)


def explanation_text() -> Column:
    level = F.col("confidence_level")
    why = F.when(F.col("missing_fields_pct") >= 40, "varios datos faltantes").when(F.col("comparable_count") <= 5, "un numero acotado de comparables").otherwise("buena cobertura de datos y comparables")
    return F.concat(
        F.lit("Esta propiedad esta un "), _percent(F.col("undervaluation"), 0), F.lit(" bajo el valor estimado. Se comparo con "), F.col("comparable_count").cast("string"), F.lit(" propiedades similares en "), F.coalesce("comuna", F.lit("la zona")),
        F.lit(" con precios entre "), short_price(F.col("comparables_min")), F.lit(" y "), short_price(F.col("comparables_max")), F.lit(". Tiene confianza "), F.when(level == "low", "baja").when(level == "medium", "media").otherwise("alta"), F.lit(" debido a "), why, F.lit("."))


def opportunities(listings: DataFrame, history: DataFrame, as_of: str, cfg: Config = DEFAULT, low_data: bool = False, budget: float | None = None) -> DataFrame:
    """Every active listing that asks clearly less than its market value, with signals, scores and texts."""
    targets = radar_candidates(listings)
    if budget is not None:
        targets = targets.where(ask_clp(cfg) <= budget)
    values = market_values(targets, listings, cfg, low_data)
    least = cfg.low_data_undervaluation if low_data else cfg.min_undervaluation
    base = targets.withColumn("listing_price", ask_clp(cfg)).join(values.select("id", "estimated_price", "min_price", "max_price", "confidence_score", "score_mean", "comparable_count", "comps"), "id")
    base = base.withColumn("undervaluation", (F.col("estimated_price") - F.col("listing_price")) / F.col("estimated_price")).where(F.col("undervaluation") >= least)
    base = base.withColumn("is_outlier", F.col("undervaluation") > cfg.outlier_discount).withColumn("missing_fields_pct", missing_fields() / 6 * 100).withColumn("missing_data_penalty", F.least(missing_fields() * 0.04, F.lit(0.24)))
    base = base.join(signals(listings, history, as_of, cfg), "id")
    prices = F.transform("comps", lambda c: c["price"])
    base = base.withColumn("confidence_level", confidence_level(F.col("confidence_score"), F.col("is_outlier")))
    base = base.withColumn("comparables_mean", F.aggregate(prices, F.lit(0.0), lambda a, p: a + p) / F.size(prices)).withColumn("comparables_min", F.array_min(prices)).withColumn("comparables_max", F.array_max(prices))
    by_score = F.array_sort(F.transform("comps", lambda c: F.struct((-c["score"]).alias("order"), c["id"].alias("id"), c["price"].alias("price"), c["m2"].alias("m2"), c["comuna"].alias("comuna"))))
    summary = F.transform(F.slice(by_score, 1, 3), lambda c: F.struct(c["price"].alias("precio"), c["m2"].alias("m2_construidos"), c["comuna"].alias("comuna"), ((c["price"] - F.col("listing_price")) / F.col("listing_price") * 100).alias("diferencia_pct")))
    scores = investment_score(F.col("undervaluation") * 100, F.col("confidence_score"), F.col("comparable_count"), F.col("is_outlier"), F.col("missing_fields_pct"))
    base = base.withColumn("comparables_summary", summary).withColumn("opportunity_score", opportunity_score(F.col("undervaluation"), F.col("confidence_score"), F.col("price_drop_pct"), F.col("time_on_market_days"), F.col("missing_data_penalty")))
    base = base.withColumn("score_breakdown", scores).withColumn("investment_score", F.col("score_breakdown.total")).withColumn("verdict", verdict(F.col("investment_score"))).withColumn("label", label(F.col("investment_score")))
    base = base.withColumn("legal_profile", legal_risk(F.col("comparable_count"), F.col("confidence_score"), F.col("missing_fields_pct"))).withColumn("roi", appreciation(F.col("comuna")) * 100)
    return base.withColumn("ranking", F.col("undervaluation") * F.col("confidence_score")).withColumn("reason", reason_text()).withColumn("explanation", explanation_text())


def ranked(found: DataFrame, limit: int = 20) -> DataFrame:
    """Normal discounts first, then outliers, each by discount times confidence."""
    return found.orderBy("is_outlier", F.desc("ranking"), "id").limit(limit)


def radar(listings: DataFrame, history: DataFrame, as_of: str, cfg: Config = DEFAULT, limit: int = 20, gate: bool = True, mark: bool = True) -> DataFrame:
    """The top opportunities; none if the market has too few listings. Low data mode follows from the listings.

    Duplicates are marked first (unless ``mark`` is false), and only representatives take part.
    """
    base = checkpointed(mark_duplicates(listings, cfg=cfg)) if mark else listings
    low = bool(data_sufficiency(base, cfg).first().low_data_mode)
    found = opportunities(base, history, as_of, cfg, low)
    if gate:
        found = found.where(F.lit(radar_candidates(base).limit(cfg.low_data_active).count() >= (cfg.low_data_active if low else cfg.radar_dataset)))
    return ranked(found, limit)


def radar_result(found: DataFrame, ready: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """One row of the radar's contract: status, counts, low_data_mode and a message where there is nothing to show."""
    both = found.agg(F.count("*").alias("total_count")).crossJoin(ready.agg(F.count("*").alias("ready_count")))
    return contract(both.withColumn("low_data_mode", F.col("ready_count") < cfg.radar_dataset))


def contract(results: DataFrame) -> DataFrame:
    """Result rows with all fields of the contract: absent and null counts are 0, low_data_mode false, the status follows from the count."""
    has = lambda c, kind: F.col(c).try_cast(kind) if c in results.columns else F.lit(None).cast(kind)
    total = F.coalesce(has("total_count", "bigint"), F.lit(0))
    status = F.coalesce(has("status", "string"), F.when(total > 0, "ok").otherwise("insufficient_data"))
    message = F.when(status == "insufficient_data", "No hay suficientes datos u oportunidades disponibles para el radar.")
    return results.select(status.alias("status"), total.alias("total_count"), F.coalesce(has("ready_count", "bigint"), F.lit(0)).alias("ready_count"), F.coalesce(has("low_data_mode", "boolean"), F.lit(False)).alias("low_data_mode"), message.alias("message"))


def with_evolution(found: DataFrame, history: DataFrame, as_of: str, cfg: Config = DEFAULT) -> DataFrame:
    """Opportunities with their price evolution as a struct; they are checkpointed, so that they are found once."""
    found = checkpointed(found)
    part = evolution(found, history, as_of, cfg)
    return found.join(part.select("id", F.struct(*[c for c in part.columns if c != "id"]).alias("price_evolution")), "id", "left")
