"""Audits: source runs, radar and risk summaries, product checks, findings and health."""

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import shared_folder

#: Texts of pages that block a scraper or ask for a login.
BLOCKING = ("captcha", "access denied", "acceso denegado", "bloqueado", "blocked", "robot", "verifica que eres humano", "verificar que eres humano", "soy nuevo", "ya tengo cuenta", "iniciar sesion", "iniciar sesión", "login", "registration", "err_internet_disconnected", "site cannot be reached")
#: What a finding of each severity takes from the health score.
COST = {"critical": 40, "high": 20, "medium": 10, "low": 5}


def blocked(url: Column, text: Column) -> Column:
    both = F.lower(F.concat_ws(" ", url, text))
    return reduce(lambda a, b: a | b, [F.contains(both, F.lit(p)) for p in BLOCKING])


def source_health(runs: DataFrame) -> DataFrame:
    """Adds validation_rate, status OK, DEGRADED or FAILED, and reasons to source runs."""
    stopped = F.coalesce(F.col("block_detected"), F.lit(False)) if "block_detected" in runs.columns else F.lit(False)
    rate = F.when(F.col("raw_rows") > 0, F.col("valid_rows") / F.col("raw_rows")).otherwise(0.0)
    failed = stopped | (F.col("raw_rows") == 0)
    thin = F.col("valid_rows") < F.col("expected_min_valid")
    reasons = F.array_compact(F.array(F.when(stopped, "blocked"), F.when(F.col("raw_rows") == 0, "no_rows"), F.when(~failed & (rate < 0.5), "low_validation_rate"), F.when(~failed & thin, "few_valid_rows")))
    return runs.withColumn("validation_rate", rate).withColumn("status", F.when(failed, "FAILED").when((rate < 0.5) | thin, "DEGRADED").otherwise("OK")).withColumn("reasons", reasons)


def iteration_summary(health: DataFrame) -> DataFrame:
    """Per run: sums, failed and degraded sources, the run's status and whether to stop early.

    Nothing valid, or more than four fifths of the valid rows mere updates, is a reason to stop.
    """
    sums = [F.sum(c).alias(c) for c in ("raw_rows", "valid_rows", "inserted", "updated") if c in health.columns]
    out = health.groupBy("run").agg(*sums, F.count_if(F.col("status") == "FAILED").alias("failed"), F.count_if(F.col("status") == "DEGRADED").alias("degraded"), F.count("*").alias("sources"))
    status = F.when(F.col("failed") == F.col("sources"), "failed").when(F.col("failed") + F.col("degraded") > 0, "partial").otherwise("success")
    stop = F.col("valid_rows") == 0
    if "updated" in health.columns:
        stop |= F.coalesce(F.col("updated") > 0.8 * F.col("valid_rows"), F.lit(False))
    return out.withColumn("run_status", status).withColumn("stop_early", stop)


def status_counts(listings: DataFrame) -> DataFrame:
    duplicate = F.coalesce(F.col("is_duplicate"), F.lit(False)) if "is_duplicate" in listings.columns else F.lit(False)
    return listings.groupBy("status").agg(F.count("*").alias("n"), F.count_if(~duplicate).alias("representatives"))


def snapshot_alert(runs: DataFrame) -> DataFrame:
    """runs (run, active): the change against the run before, and an alert below 80 % of it."""
    before = runs.select((F.col("run") + 1).alias("run"), F.col("active").alias("previous"))
    return runs.join(before, "run", "left").withColumn("variation_pct", (F.col("active") - F.col("previous")) / F.col("previous") * 100).withColumn("alert", F.coalesce(F.col("active") < 0.8 * F.col("previous"), F.lit(False)))


def radar_summary(found: DataFrame) -> DataFrame:
    return found.agg(F.count("*").alias("opportunities"), F.count_if("is_outlier").alias("outliers"), F.avg("investment_score").alias("mean_score"), F.avg(F.col("undervaluation") * 100).alias("mean_discount_pct"))


def legal_summary(found: DataFrame) -> DataFrame:
    """Per level: how many, mean score and scores out of range."""
    score = F.col("legal_profile.legal_risk_score")
    return found.groupBy(F.col("legal_profile.legal_risk_level").alias("level")).agg(F.count("*").alias("n"), F.avg(score).alias("mean_score"), F.count_if(~score.between(0, 100)).alias("invalid"))


def legal_flags(found: DataFrame) -> DataFrame:
    return found.select(F.explode("legal_profile.legal_flags").alias("flag")).groupBy("flag").agg(F.count("*").alias("n"))


#: Contradictions on an opportunity: severity, code, and when. Columns: confidence and discount in per cent, n, missing, score, legal, level, mean_score, status.
CONTRADICTIONS = (
    ("warning", "high_confidence_with_few_comparables", "confidence > 80 and n < 3"),
    ("warning", "strong_opportunity_with_missing_data", "strong and missing > 30"),
    ("critical", "extreme_discount_with_low_confidence", "discount > 40 and confidence < 60"),
    ("warning", "strong_opportunity_non_market_comparable_status", "strong and status <> 'market_comparable'"),
    ("warning", "high_investment_score_with_high_legal_risk", "score >= 75 and (level = 'Alto' or legal >= 70)"),
    ("warning", "legal_low_with_low_confidence", "level = 'Bajo' and confidence < 60"),
    ("info", "many_comparables_with_low_average_score", "n >= 8 and mean_score < 0.55"),
)
#: Contradictions of the legal profile alone.
LEGAL_CONTRADICTIONS = (
    ("warning", "legal_low_with_low_confidence", "level = 'Bajo' and confidence < 60"),
    ("warning", "legal_low_with_few_comparables", "level = 'Bajo' and n < 3"),
    ("info", "legal_high_despite_strong_data", "level = 'Alto' and n >= 8 and confidence >= 80"),
)


def _facts(found: DataFrame) -> DataFrame:
    percent = lambda c: F.when(F.abs(c) <= 1, c * 100).otherwise(c)
    status = F.col("valuation_status") if "valuation_status" in found.columns else F.lit("market_comparable")
    discount = F.col("undervaluation") * 100
    return found.select(
        "id", percent(F.col("confidence_score")).alias("confidence"), F.col("comparable_count").alias("n"), F.col("missing_fields_pct").alias("missing"), discount.alias("discount"), F.col("investment_score").alias("score"),
        F.col("legal_profile.legal_risk_score").alias("legal"), F.col("legal_profile.legal_risk_level").alias("level"), F.col("score_mean").alias("mean_score"), status.alias("status"), F.coalesce(F.col("investment_score") >= 75, discount >= 20, F.lit(False)).alias("strong"))


def broken_rules(found: DataFrame, rules: tuple = CONTRADICTIONS) -> DataFrame:
    """A row (id, severity, code) for each opportunity and rule that it breaks; a rule about something unknown is not broken."""
    broken = F.array_compact(F.array(*[F.when(F.expr(rule), F.struct(F.lit(severity).alias("severity"), F.lit(code).alias("code"))) for severity, code, rule in rules]))
    return _facts(found).select("id", F.explode(broken).alias("f")).select("id", "f.severity", "f.code")


#: Product checks: severity, code, when. ``unless`` names the codes that come first and exclude it.
PRODUCT_RULES = (
    ("critical", "high_score_poor_data", "score > 70 and missing > 50", ()),
    ("critical", "high_score_weak_confidence", "score >= 75 and confidence < 0.55", ("high_score_poor_data",)),
    ("warning", "good_score_incomplete_data", "score >= 60 and missing > 25", ("high_score_poor_data", "high_score_weak_confidence")),
    ("critical", "high_discount_few_comparables", "discount >= 0.15 and coalesce(n, 0) < 4", ()),
    ("warning", "discount_thin_support", "discount >= 0.10 and n < 7", ("high_discount_few_comparables",)),
    ("warning", "negotiation_on_weak_data", "(days > 25 or changes >= 2 or drop >= 0.08) and (missing > 50 or confidence < 0.5)", ()),
    ("critical", "positive_text_low_confidence", "text rlike 'strong|sólida|solida|alta confianza|fuerte|comprar' and confidence < 0.5", ()),
    ("critical", "positive_text_few_comparables", "text rlike 'strong|sólida|solida|alta confianza|fuerte|comprar' and n < 4", ()),
    ("warning", "doubtful_text_high_score", "text rlike 'riesgo|pocos comparables|baja confianza|datos incompletos' and score >= 75", ()),
    ("warning", "unknown_depth", "n is null", ()),
    ("critical", "very_low_depth", "n < 3", ()),
    ("warning", "limited_depth", "n >= 3 and n < 6", ()),
    ("critical", "invalid_price", "price is null or price <= 0", ()),
    ("warning", "invalid_area", "m2 is null or m2 <= 0", ()),
    ("critical", "price_m2_too_low", "price <> 0 and m2 > 0 and price / m2 < 300000", ()),
    ("critical", "price_m2_too_high", "m2 > 0 and price / m2 > 10000000", ()),
    ("critical", "positive_verdict_low_score", "lower(verdict) rlike 'comprar|strong' and score < 55", ()),
    ("critical", "negative_verdict_high_score", "lower(verdict) rlike 'evitar|risk' and score >= 70", ()),
    ("critical", "no_discount_high_score", "discount < 0 and score >= 70", ()),
)


def product_audit(found: DataFrame, rules: tuple = PRODUCT_RULES) -> DataFrame:
    """id, severity, warnings and critical_issues (codes in the order of the rules) of each opportunity.

    Rules may be added: (severity, code, SQL condition on score, confidence, missing, discount, n, price, m2, verdict,
    text, days, changes and drop, codes that exclude it). Columns that the frame lacks are null.
    """
    has = lambda c, kind: F.col(c).cast(kind) if c.split(".")[0] in found.columns else F.lit(None).cast(kind)
    facts = found.select(
        "id", has("investment_score", "double").alias("score"), has("confidence_score", "double").alias("confidence"), F.coalesce(has("missing_fields_pct", "double"), F.lit(0.0)).alias("missing"), has("undervaluation", "double").alias("discount"), has("comparable_count", "int").alias("n"),
        has("listing_price", "double").alias("price"), has("m2_construidos", "double").alias("m2"), has("verdict", "string").alias("verdict"), F.lower(F.concat_ws(" ", *[has(c, "string") for c in ("verdict", "label", "reason", "explanation")])).alias("text"),
        has("price_evolution.days_on_market", "int").alias("days"), F.coalesce(has("price_evolution.price_changes", "int"), F.lit(0)).alias("changes"), has("price_evolution.price_drop_from_peak_pct", "double").alias("drop"))
    holds = {code: F.coalesce(F.expr(rule), F.lit(False)) for _, code, rule, _ in rules}

    def listed(severity: str) -> Column:
        codes = []
        for kind, code, _, unless in rules:
            if kind == severity:
                codes.append(F.when(reduce(lambda a, b: a & ~b, [holds[u] for u in unless], holds[code]), F.lit(code)))
        return F.array_compact(F.array(*codes))

    out = facts.select("id", listed("warning").alias("warnings"), listed("critical").alias("critical_issues"))
    return out.withColumn("severity", F.when(F.size("critical_issues") > 0, "high").when(F.size("warnings") > 0, "medium").otherwise("low"))


def audit_totals(audited: DataFrame) -> DataFrame:
    return audited.agg(F.count("*").alias("audited"), F.sum(F.size("warnings")).alias("warnings"), F.sum(F.size("critical_issues")).alias("critical_issues"), F.count_if(F.col("severity") == "high").alias("high"))


def funnel(pairs: DataFrame, results: DataFrame) -> DataFrame:
    """One row of what is left of the candidates on the way, from valuation.funnel_counts() and the ids with a result."""
    done = results.select(F.col("id").alias("t_id")).distinct().withColumn("done", F.lit(True))
    per = pairs.join(done, "t_id", "left")
    n = lambda c: F.count_if(c)
    out = per.agg(
        F.count("*").alias("targets"), F.avg("before").alias("mean_before"), F.avg("segmented").alias("mean_segmented"), n((F.col("before") > 0) & (F.col("segmented") == 0)).alias("none_left"), n(F.col("segmented") < 3).alias("under_three"),
        n((F.col("before") > 20) & (F.col("segmented") == 0)).alias("many_lost"), F.coalesce(F.sum(F.col("relaxed").cast("int") + F.col("adjacent").cast("int")), F.lit(0)).alias("fallbacks"), n(F.col("segmented") < 3).alias("insufficient"), n(F.col("done")).alias("results"))
    share = lambda c: F.coalesce(F.try_divide(F.col(c), F.col("targets")), F.lit(0.0))
    return out.withColumns({"none_left_share": share("none_left"), "insufficient_share": share("insufficient"), "result_share": share("results")})


#: Findings: section, severity, code, when (SQL on the section's row).
FINDINGS = (
    ("database", "critical", "no_active_listings", "active = 0"),
    ("database", "warning", "listings_without_price", "without_price > 0"),
    ("database", "warning", "listings_without_m2", "without_m2 > 0"),
    ("database", "warning", "duplicate_source_link", "duplicate_links > 0"),
    ("quality", "warning", "low_usable_listing_ratio", "usable_ratio < 0.5"),
    ("quality", "warning", "precio_m2_outliers", "outliers > 0"),
    ("benchmark", "critical", "benchmark_no_results", "evaluated = 0"),
    ("benchmark", "warning", "high_median_model_error", "evaluated > 0 and median_error_pct > 25"),
    ("radar", "critical", "radar_no_ready_listings", "ready = 0"),
    ("radar", "warning", "radar_no_opportunities", "opportunities = 0"),
    ("legal", "critical", "missing_legal_profile", "missing_profile > 0"),
    ("legal", "critical", "invalid_legal_scores", "invalid_scores > 0"),
    ("funnel", "critical", "segmentation_loses_comparables_over_50pct", "none_left_share > 0.5"),
    ("funnel", "warning", "segmentation_loses_comparables_over_30pct", "none_left_share > 0.3 and none_left_share <= 0.5"),
    ("funnel", "critical", "segmentation_eliminating_valid_data", "many_lost > 0"),
    ("funnel", "critical", "radar_not_functional", "insufficient_share > 0.7"),
    ("funnel", "warning", "fallback_not_effective", "fallbacks >= 3 and (mean_segmented < 3 or insufficient_share > 0.3)"),
    ("funnel", "warning", "pipeline_loses_data_before_scoring", "results > 0 and result_share < 0.2"),
    ("funnel", "info", "insufficient_segment_data_events", "insufficient > 0"),
)
#: Codes whose findings weigh otherwise than by their severity (critical as critical, the others as low).
LEVELS = {"listings_without_m2": "high", "legal_low_with_few_comparables": "high", "high_confidence_with_few_comparables": "high", "low_usable_listing_ratio": "medium"}
#: What weighs besides the findings: section, level, code, when.
EXTRA_LEVELS = (
    ("database", "high", "missing_m2", "without_m2 > 0"),
    ("database", "medium", "missing_coordinates", "without_coordinates > 0"),
    ("benchmark", "high", "median_error_over_30", "median_error_pct > 30"),
    ("benchmark", "high", "average_error_over_30", "average_error_pct > 30"),
)


def _applied(sections: dict[str, DataFrame], rules: tuple, name: str) -> DataFrame:
    """Rows (section, name, code) of the rules that hold on their section's row."""
    parts = []
    for section, row in sections.items():
        own = [F.when(F.expr(rule), F.struct(F.lit(kind).alias(name), F.lit(code).alias("code"))) for s, kind, code, rule in rules if s == section]
        if own:
            parts.append(row.select(F.lit(section).alias("section"), F.explode(F.array_compact(F.array(*own))).alias("f")).select("section", f"f.{name}", "f.code"))
    return reduce(DataFrame.unionByName, parts)


def database_section(listings: DataFrame, link: str = "link") -> DataFrame:
    pairs = listings.where(F.col(link).isNotNull()).groupBy("fuente", link).agg(F.count("*").alias("n")).where("n > 1").agg(F.count("*").alias("duplicate_links"))
    counts = listings.agg(
        F.count("*").alias("total"), F.count_if(F.col("status") == "active").alias("active"), F.count_if(F.col("precio_clp").isNull() & F.col("precio_uf").isNull()).alias("without_price"),
        F.count_if(F.col("m2_construidos").isNull()).alias("without_m2"), F.count_if(F.col("lat").isNull() | F.col("lon").isNull()).alias("without_coordinates"))
    return counts.crossJoin(pairs)


def quality_section(coverage: DataFrame) -> DataFrame:
    return coverage.select("total", F.coalesce(F.try_divide("usable", "total"), F.lit(0.0)).alias("usable_ratio"), F.col("price_m2_invalid").alias("outliers"))


def benchmark_section(predictions: DataFrame) -> DataFrame:
    done = predictions.where("skipped is null")
    return done.agg(F.count("*").alias("evaluated"), (F.percentile("percentage_error", F.lit(0.5)) * 100).alias("median_error_pct"), (F.avg("percentage_error") * 100).alias("average_error_pct"))


def radar_section(ready: DataFrame, found: DataFrame) -> DataFrame:
    return ready.agg(F.count("*").alias("ready")).crossJoin(found.agg(F.count("*").alias("opportunities")))


def legal_section(found: DataFrame) -> DataFrame:
    """Counts, the spread of the scores, and missing or invalid profiles."""
    score = F.col("legal_profile.legal_risk_score")
    fine = F.when(score.between(0, 100), score)
    return found.agg(
        F.count("*").alias("checked"), F.count_if(F.col("legal_profile").isNull()).alias("missing_profile"), F.count_if(F.col("legal_profile").isNotNull() & fine.isNull()).alias("invalid_scores"), F.min(fine).alias("least"), F.max(fine).alias("most"),
        F.avg(fine).alias("mean"), F.percentile(fine, F.lit(0.5)).alias("median"), F.count_if((F.col("legal_profile.legal_risk_level") == "Alto") | (score >= 70)).alias("high_risk"))


def findings(sections: dict[str, DataFrame], found: DataFrame | None = None) -> DataFrame:
    """(section, severity, code, n): what the sections' rows and the opportunities' contradictions give."""
    out = _applied(sections, FINDINGS, "severity").withColumn("n", F.lit(1).cast("long"))
    if found is not None:
        for section, rules in (("legal", LEGAL_CONTRADICTIONS), ("consistency", CONTRADICTIONS)):
            rows = broken_rules(found, rules).groupBy("severity", "code").agg(F.count("*").alias("n"))
            out = out.unionByName(rows.select(F.lit(section).alias("section"), "severity", "code", "n"))
    return out


def health(found: DataFrame, sections: dict[str, DataFrame]) -> DataFrame:
    """One row: findings by severity, what weighs at each level, the score from 100 down, the statuses.

    A code weighs once, however many rows have it.
    """
    known = F.create_map(*[F.lit(x) for pair in LEVELS.items() for x in pair])
    level = F.coalesce(F.try_element_at(known, F.col("code")), F.when(F.col("severity") == "critical", "critical").otherwise("low"))
    weighing = found.select(level.alias("level"), "code").unionByName(_applied(sections, EXTRA_LEVELS, "level").select("level", "code")).distinct()
    counts = weighing.agg(*[F.count_if(F.col("level") == name).alias(name) for name in COST])
    rows = found.agg(F.count_if(F.col("severity") == "critical").alias("critical_findings"), F.count_if(F.col("severity") == "warning").alias("warnings"), F.count("*").alias("findings"))
    both = rows.crossJoin(counts)
    score = F.greatest(reduce(lambda a, b: a - b, [F.col(name) * cost for name, cost in COST.items()], F.lit(100)), F.lit(0))
    status = F.when(F.col("critical") > 0, "CRITICAL").when(F.col("high") > 0, "UNSTABLE").when(F.col("medium") > 0, "WARNING").otherwise("HEALTHY")
    general = F.when(F.col("critical_findings") > 0, "CRITICAL").when(F.col("warnings") > 0, "WARNING").otherwise("OK")
    return both.withColumns({"score": score, "system_status": status, "general_status": general})


#: Actions: when (SQL on critical_findings, warnings, median_error_pct, opportunities, high_risk, thin_comunas), and what to do, by urgency.
ACTIONS = (
    ("critical_findings > 0", "Resolver primero los hallazgos críticos listados arriba."),
    ("warnings > 0", "Agrupar warnings por código y atacar los de mayor frecuencia."),
    ("median_error_pct is not null", "Revisar los peores casos del benchmark y validar patrones por comuna/m2."),
    ("opportunities > 0", "Revisar manualmente las top oportunidades con mayor descuento y baja confianza."),
    ("high_risk > 0", "Priorizar validación legal manual de oportunidades con risk alto."),
    ("critical_findings > 0", "Revisar hallazgos críticos antes de usar resultados comerciales."),
    ("warnings > 0", "Priorizar warnings repetidos en calidad de datos y radar."),
    ("high_risk > 0", "Validar manualmente oportunidades con legal risk alto."),
    ("thin_comunas > 0", "Aumentar cobertura en comunas con bajo volumen de registros."),
    ("critical_findings = 0 and warnings = 0 and high_risk = 0 and thin_comunas = 0", "Mantener monitoreo periódico del benchmark y legal risk."),
)


def top_actions(state: DataFrame, n: int = 5) -> DataFrame:
    """(place, action): the first ``n`` actions that a health row, with the sections' numbers, calls for."""
    called = F.array_compact(F.array(*[F.when(F.expr(rule), F.lit(text)) for rule, text in ACTIONS]))
    return state.select(F.posexplode(F.slice(called, 1, n)).alias("place", "action"))


def summary(sections: dict[str, DataFrame], found: DataFrame, listed: DataFrame, health_row: DataFrame) -> DataFrame:
    """(place, line): an audit's summary, from its sections database, quality, benchmark, radar and legal, the
    opportunities, findings and health row.

    The first critical finding and the first warning are those first in order of section and code; lines of what an
    audit does not have are left out. Checks are the listings of database and quality, the opportunities of legal and
    consistency, and one for each other section.
    """
    levels = F.col("legal_profile.legal_risk_level")
    legal = found.agg(*[F.count_if(levels == name).alias(f"legal_{name}") for name in ("Alto", "Medio", "Bajo")])
    first = lambda kind: F.min(F.when(F.col("severity") == kind, F.struct("section", "code")))["code"]
    worst = listed.agg(first("critical").alias("first_critical"), first("warning").alias("first_warning"), F.coalesce(F.sum(F.when((F.col("section") == "legal") & (F.col("severity") != "info"), F.col("n"))), F.lit(0)).alias("legal_findings"))
    # Each is one row, so one partition: the product's partitions would multiply otherwise.
    one = reduce(DataFrame.crossJoin, [row.coalesce(1) for row in (sections["database"].select("total", "active", "without_price", "without_m2"), sections["quality"].select(F.col("total").alias("rated"), "usable_ratio"), sections["benchmark"], sections["radar"], sections["legal"].select("checked"), legal, worst, health_row.select("general_status"))])
    checks = F.col("total") + F.col("rated") + 2 * F.col("checked") + (len(sections) - 3)
    share = lambda c: F.when(c.isNull(), "Sin datos").otherwise(F.format_string("%.1f%%", c))
    levels_text = F.concat_ws(", ", *[F.when(F.col(f"legal_{name}") > 0, F.concat(F.lit(f"{name}: "), F.col(f"legal_{name}"))) for name in ("Alto", "Medio", "Bajo")])
    # The texts of the lines.
    lines = F.array_compact(F.array(
        F.concat(F.lit("- Estado general: **"), "general_status", F.lit("**.")),
        F.concat(F.lit("- Checks: "), checks, F.lit(".")),
        F.concat(F.lit("- Salud de datos: "), "active", F.lit(" activos, "), share(F.col("usable_ratio") * 100), F.lit(" usables, "), "without_price", F.lit(" sin precio, "), "without_m2", F.lit(" sin m2.")),
        F.concat(F.lit("- Benchmark: "), "evaluated", F.lit(" evaluados, error mediano "), share(F.col("median_error_pct")), F.lit(".")),
        F.concat(F.lit("- Radar: "), "ready", F.lit(" listings listos, "), "opportunities", F.lit(" oportunidades generadas.")),
        F.concat(F.lit("- Legal risk: "), F.when(levels_text == "", "Sin datos").otherwise(levels_text), F.lit("; "), "legal_findings", F.lit(" inconsistencias legales.")),
        F.concat(F.lit("- Principal crítico: `"), "first_critical", F.lit("`")), F.concat(F.lit("- Principal warning: `"), "first_warning", F.lit("`"))))
    return one.select(F.posexplode(lines).alias("place", "line"))


def system_audit(sections: dict[str, DataFrame], found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(findings, health row) of the sections database, quality, benchmark, radar, legal and funnel, and the opportunities."""
    listed = findings(sections, found)
    return listed, health(listed, sections)


def write_json(rows: DataFrame, name: str) -> DataFrame:
    """Rows written as JSON under the session's spark.checkpoint.dir (a sink's folder in general), and reread."""
    folder = f"{shared_folder(rows.sparkSession)}/{name}-{uuid.uuid4().hex}"
    rows.write.json(folder)
    return rows.sparkSession.read.schema(rows.schema).json(folder)
