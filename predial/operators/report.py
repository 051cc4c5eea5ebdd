"""Numbers and texts of valuation and risk reports, from opportunities and their comparables."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clean_text
from .risk import dispersion, investment_metrics, percent

#: A report's texts, kept together with the conditions under which they hold.
THESES = (
    ("undervaluation >= 0.15 and confidence_score >= 0.65 and comparable_count >= 5", "Activo subvalorado con buen respaldo de mercado."),
    ("legal_profile.legal_risk_level = 'Alto' or missing_fields_pct > 30 or confidence_score < 0.55", "Oportunidad con incertidumbre relevante."),
    ("undervaluation >= 0.10", "Descuento atractivo, sujeto a validación de datos y antecedentes."),
    ("true", "Oportunidad defensiva: requiere comparar contra alternativas cercanas."),
)
SHORT_THESES = (
    ("undervaluation >= 0.25 and confidence_score >= 0.65 and comparable_count >= 5", "Descuento atractivo con soporte comparable suficiente."),
    ("undervaluation >= 0.15 and comparable_count >= 5", "Precio bajo mercado con evidencia moderada."),
    ("comparable_count < 5", "Senal preliminar con base comparable limitada."),
    ("true", "Oportunidad acotada; priorizar validacion antes de avanzar."),
)
RISK_FLAGS = (
    ("missing_fields_pct > 30", "Datos incompletos sobre 30%."),
    ("missing_fields_pct > 15 and missing_fields_pct <= 30", "Datos parcialmente incompletos."),
    ("comparable_count < 5", "Pocos comparables para sostener convicción."),
    ("confidence_score < 0.55", "Confianza baja del modelo."),
)
CATALYSTS = (
    ("undervaluation > 0.15", "Descuento superior a 15% frente al valor estimado."),
    ("comparable_count >= 5", "Base comparable suficiente para una revisión inicial."),
    ("confidence_score >= 0.65", "Buena confianza relativa del modelo."),
    ("legal_profile.legal_risk_level = 'Bajo'", "Legal risk preliminar bajo."),
)
NARRATIVE = (
    (("undervaluation >= 0.25", "Propiedad bajo mercado con descuento relevante."), ("undervaluation >= 0.15", "Descuento moderado frente al rango comparable."), ("true", "Brecha de precio acotada frente al mercado.")),
    (("comparable_count >= 8", "Soporte comparable suficiente para una primera lectura."), ("comparable_count >= 5", "Soporte moderado de comparables."), ("true", "Base comparable limitada; requiere validacion.")),
    (("missing_fields_pct > 0", "Existen datos incompletos que elevan el riesgo."), ("confidence_score < 0.55", "La confianza es baja y conviene revisar manualmente."), ("true", "Senal interpretable para priorizacion inicial.")),
)
PRICE_INSIGHTS = (
    ("days_on_market < 7", "Propiedad recien publicada"),
    ("days_on_market > 60", "Tiempo en mercado elevado"),
    ("price_changes >= 2", "El vendedor ha ajustado el precio multiples veces"),
    ("price_drop_from_peak_pct > 0.1", "Reduccion significativa desde el precio inicial"),
    ("trend = 'down'", "Tendencia bajista reciente"),
)
NEGATIVE = ("baja", "bajo", "pocos", "poco", "incompleto", "incompleta", "faltante", "riesgo", "outlier", "legal", "incertidumbre", "insuficiente", "débil", "debil")
POSITIVE = ("alta confianza", "base sólida", "base solida", "descuento significativo", "favorable", "sólida", "solida")


def first_text(rules: tuple) -> Column:
    """The text of the first rule that holds."""
    return F.coalesce(*[F.when(F.expr(rule), F.lit(text)) for rule, text in rules])


def all_texts(rules: tuple) -> Column:
    """The texts of all rules that hold, in order."""
    return F.array_compact(F.array(*[F.when(F.expr(rule), F.lit(text)) for rule, text in rules]))


def _whole(value: Column) -> Column:
    """A number without decimals, halves to even."""
    return F.bround(value).cast("bigint").cast("string")


def risk_context(found: DataFrame) -> DataFrame:
    """Per opportunity: thesis, scores of valuation, market support and risk (0 to 100), flags and catalysts."""
    legal = F.coalesce("legal_profile.legal_risk_score", F.lit(0))
    support = F.least(F.col("comparable_count") / F.lit(10.0), F.lit(1.0)) * 50 + F.col("confidence_score") * 50
    return found.select(
        "id", first_text(THESES).alias("thesis"), (F.least(F.greatest("undervaluation", F.lit(0.0)) / 0.30, F.lit(1.0)) * 100).alias("valuation_score"), support.alias("market_support_score"),
        F.greatest(F.lit(0.0), 100 - legal * 0.5 - F.least("missing_fields_pct", F.lit(50.0))).alias("risk_score"), F.concat(F.col("legal_profile.legal_flags"), all_texts(RISK_FLAGS)).alias("risk_flags"), all_texts(CATALYSTS).alias("catalysts"))


def investment_case(found: DataFrame) -> DataFrame:
    """Per opportunity: the short thesis, three sentences, the risks, the report's blocks and the investment flags."""
    missing = F.when(F.col("missing_fields_pct") > 0, F.concat(F.lit("Datos faltantes: "), _whole(F.col("missing_fields_pct")), F.lit("%")))
    few = F.when(F.col("comparable_count") < 5, "Pocos comparables")
    risks = F.array_compact(F.array(missing, few, F.when(F.col("is_outlier"), "Outlier de descuento")))
    line = F.when(F.size(risks) == 0, "Riesgo operativo acotado con los datos disponibles.").otherwise(F.concat(F.lit("Riesgo: "), F.array_join(risks, " | ")))
    spread = dispersion()
    wide = F.when(spread > 0.30, F.concat(F.lit("Alta dispersion: "), F.format_string("%.1f%%", spread * 100)))
    factors = F.array_compact(F.array(few, wide, F.when(F.col("missing_fields_pct") > 0, "Datos incompletos"), F.when(F.col("is_outlier"), "Descuento extremo / outlier")))
    flags = F.array_compact(F.array(F.when(F.col("is_outlier"), "Outlier: posible anomalia de precio"), F.when(F.col("confidence_score") < 0.55, "Baja confianza"), missing, few))
    return found.select(
        "id", first_text(SHORT_THESES).alias("thesis"), F.concat_ws(" ", *[first_text(r) for r in NARRATIVE]).alias("narrative"), line.alias("risk_line"),
        F.array(F.when(F.col("undervaluation") >= 0.15, "Precio bajo mercado").otherwise("Precio cercano al rango de mercado"), F.when(F.col("confidence_score") >= 0.65, "Consistencia AVM favorable").otherwise("Consistencia AVM por validar")).alias("valuation_block"),
        F.when(F.size(factors) == 0, F.array(F.lit("Riesgos operativos acotados"))).otherwise(factors).alias("risk_factors"), flags.alias("risk_flags"))


def report_metrics(found: DataFrame) -> DataFrame:
    """Per opportunity: price per m2 against the comparables' mean, status bands, reliability, adverse flags and strengths."""
    m2, price = F.col("m2_construidos"), F.col("listing_price")
    market = F.when((F.col("comparables_mean") > 0) & (m2 > 0), F.col("comparables_mean") / m2)
    market = F.when(market <= 10_000_000, market)
    delta = F.when(m2 > 0, price / m2 / market - 1)
    band = lambda value, best, fair: F.when(value >= best, "beat").when(value >= fair, "caution").otherwise("miss")
    missing = F.coalesce("missing_fields_pct", F.lit(0.0))
    low = lambda f, words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(F.lower(f), w))
    flags = F.filter(F.array_distinct(F.concat(F.col("legal_profile.legal_flags"), all_texts(RISK_FLAGS))), lambda f: low(f, NEGATIVE) & ~low(f, POSITIVE))
    return found.select(
        "id", F.when(m2 > 0, price / m2).alias("price_m2"), market.alias("market_price_m2"), delta.alias("delta"), F.when(delta.isNull(), "amber").when(delta < 0, "green").when(delta <= 0.05, "amber").otherwise("red").alias("delta_status"),
        F.when(F.col("undervaluation") > 0.15, "beat").when(F.col("undervaluation") >= 0.05, "caution").otherwise("miss").alias("discount_status"), band(F.col("comparable_count"), 8, 4).alias("comparables_status"), band(F.col("confidence_score"), 0.75, 0.5).alias("confidence_status"),
        F.when(missing > 40, "miss").when(missing >= 20, "caution").otherwise("beat").alias("missing_status"), F.when(missing > 50, "Low Reliability").when(missing > 25, "Medium Reliability").otherwise("High Reliability").alias("reliability"),
        F.when(F.col("investment_score") >= 75, "Strong Signal").when(F.col("investment_score") >= 55, "Needs Review").otherwise("High Risk").alias("signal"), flags.alias("risk_flags"),
        all_texts((("comparable_count >= 8", "Base sólida de comparables"), ("confidence_score >= 0.8", "Alta confianza del modelo"), ("undervaluation >= 0.15", "Descuento significativo"))).alias("strengths"))


def price_insights(evolution: DataFrame, n: int = 2) -> DataFrame:
    """Per listing: the first ``n`` remarks on its price's course."""
    return evolution.select("id", F.slice(all_texts(PRICE_INSIGHTS), 1, n).alias("insights"))


def negotiation_signals(evolution: DataFrame) -> DataFrame:
    """Per listing: what speaks for room to negotiate, in words."""
    days, changes, drop = F.col("days_on_market"), F.col("price_changes"), F.col("price_drop_from_peak_pct")
    return evolution.select("id", F.array_compact(F.array(
        F.when(days != 0, F.concat(days.cast("string"), F.lit(" días en mercado"))), F.when(changes != 0, F.concat(changes.cast("string"), F.lit(" cambios de precio"))),
        F.when(drop != 0, F.concat(_whole(drop * 100), F.lit("% caída desde peak"))))).alias("signals"))


def analysis_detail(found: DataFrame) -> DataFrame:
    """Per opportunity: score, discount, yield and the comparables with price per m2 and difference to the asking price, with a text."""
    metrics = investment_metrics(F.col("listing_price"), F.col("roi"), F.lit(None).cast("double"))
    rows = F.transform("comparables_summary", lambda c, i: F.struct((i + 1).alias("place"), c["precio"].alias("price"), c["m2_construidos"].alias("m2"), F.when(c["m2_construidos"] > 0, c["precio"] / c["m2_construidos"]).alias("price_m2"), c["diferencia_pct"].alias("difference_pct")))
    spread = dispersion()
    told = F.when(spread.isNull(), " La dispersion no esta disponible con los datos actuales.").otherwise(F.concat(F.lit(" La dispersion estimada entre comparables es "), F.format_string("%.1f%%", spread * 100), F.lit(".")))
    text = F.concat(F.lit("Basado en "), F.col("comparable_count").cast("string"), F.lit(" comparables similares, con confianza "), F.col("confidence_level"), F.lit(" ("), _whole(F.col("confidence_score") * 100), F.lit("%)."), told, F.when(F.col("is_outlier"), " El descuento es extremo y debe revisarse como posible anomalia.").otherwise(""))
    return found.select("id", F.col("investment_score").alias("score"), F.col("undervaluation").alias("discount"), metrics["yield_pct"].alias("yield_pct"), percent(F.col("missing_fields_pct")).alias("missing_pct"), rows.alias("comparables"), text.alias("text"))


def radar_table(found: DataFrame) -> DataFrame:
    """The columns that radar tables and audits show of an opportunity."""
    return found.select("id", "comuna", F.col("m2_construidos").alias("m2"), "listing_price", F.col("estimated_price").alias("estimated_value"), F.format_string("%.1f%%", F.col("undervaluation") * 100).alias("discount"), "reason", "investment_score", percent(F.col("confidence_score")).alias("confidence_pct"), "comparable_count", F.col("legal_profile.legal_risk_level").alias("legal_level"))


def comparables(valued: DataFrame) -> DataFrame:
    """A row per target and used comparable."""
    return valued.select("id", F.explode("comps").alias("c")).select("id", F.col("c.id").alias("c_id"), "c.score", "c.price_m2", "c.price", "c.m2", "c.comuna", "c.dormitorios", "c.banos")


def comparable_table(rows: DataFrame, n: int = 15) -> DataFrame:
    """Each target's comparables by score, the first ``n`` with their place."""
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "c_id"))
    return rows.withColumn("place", place).where(F.col("place") <= n).select("id", "place", "c_id", "price", "m2", "price_m2", F.round("score", 3).alias("score"), F.coalesce(clean_text(F.col("comuna")), F.lit("Sin dato")).alias("comuna"))


def comparable_summary(rows: DataFrame) -> DataFrame:
    """Per target: means, ranges and spread of its comparables, and the commonest layout (the best-scored one's of several)."""
    layout = F.when(F.coalesce("dormitorios", "banos").isNotNull(), F.concat(F.coalesce(F.col("dormitorios").cast("string"), F.lit("sin dato")), F.lit(" dorm / "), F.coalesce(F.col("banos").cast("string"), F.lit("sin dato")), F.lit(" baños")))
    counted = rows.withColumn("layout", layout).where("layout is not null").groupBy("id", "layout").agg(F.count("*").alias("n"), F.max(F.struct("score", -F.col("c_id"))).alias("best"))
    common = counted.groupBy("id").agg(F.max_by("layout", F.struct("n", "best")).alias("layout"))
    area, price = F.when(F.col("m2") > 0, F.col("m2")), F.when(F.col("price") > 0, F.col("price"))
    out = rows.groupBy("id").agg(
        F.count("*").alias("n"), F.avg("price_m2").alias("mean_price_m2"), F.avg(area).alias("mean_m2"), F.when((F.count("*") >= 2) & (F.avg("price_m2") > 0), F.stddev_pop("price_m2") / F.avg("price_m2")).alias("variation"),
        F.avg("dormitorios").alias("mean_dormitorios"), F.min(area).alias("min_m2"), F.max(area).alias("max_m2"), F.min(price).alias("min_price"), F.max(price).alias("max_price"))
    return out.join(common, "id", "left").withColumn("layout", F.coalesce("layout", F.lit("Sin datos")))


def factors(targets: DataFrame, summary: DataFrame, year: int) -> DataFrame:
    """Per target: what area, location, bedrooms and age do to its value, as shares, and the two largest by name."""
    limited = lambda x: F.when(x.isNotNull(), F.greatest(F.least(x, F.lit(0.12)), F.lit(-0.12)))
    built = F.col("ano_construccion") if "ano_construccion" in targets.columns else F.lit(None).cast("int")
    s = summary.select("id", "n", "mean_m2", "mean_dormitorios")
    rows = targets.select("id", "m2_construidos", "dormitorios", F.when(built > 0, F.greatest(F.lit(year) - built, F.lit(0))).alias("age")).join(s, "id", "left")
    area = F.when((F.col("m2_construidos") > 0) & (F.col("mean_m2") > 0), limited((F.col("m2_construidos") / F.col("mean_m2") - 1) * 0.35)).otherwise(0.0)
    place = F.when(F.col("n") >= 5, 0.08).when(F.col("n") > 0, 0.03).otherwise(-0.05)
    rooms = F.when(F.col("mean_dormitorios") > 0, F.coalesce(limited((F.col("dormitorios") - F.col("mean_dormitorios")) * 0.03), F.lit(0.0))).otherwise(0.0)
    age = F.when(F.col("age").isNull(), 0.0).when(F.col("age") <= 5, 0.06).when(F.col("age") <= 15, 0.02).when(F.col("age") <= 30, -0.03).otherwise(-0.08)
    named = [("superficie", area), ("ubicación", place), ("dormitorios", rooms), ("antigüedad", age)]
    ranked = F.array_sort(F.array(*[F.struct((-F.abs(x)).alias("size"), F.lit(i).alias("place"), F.lit(name).alias("name")) for i, (name, x) in enumerate(named)]))
    top = F.concat(F.get(ranked, F.lit(0))["name"], F.lit(" y "), F.get(ranked, F.lit(1))["name"])
    return rows.select("id", area.alias("area"), place.alias("location"), rooms.alias("bedrooms"), age.alias("age"), top.alias("largest"))


def automatic_summary(state: Column, largest: Column) -> Column:
    """The sentence on a valuation: how it stands to the market, and what weighs most."""
    return F.concat(F.lit("La propiedad se encuentra "), F.lower(state), F.lit(" según los comparables disponibles. Los factores que más influyen en esta estimación son "), largest, F.lit(". La lectura combina precio por m², similitud y consistencia de mercado."))
