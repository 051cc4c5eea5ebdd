"""Queries of valuations, opportunities, reports, evaluation and audits, with their SQL."""

from pyspark.sql import functions as F

from ..functions.geo import distance_penalty
from ..functions.prices import ask_clp, full_price
from ..functions.text import normal_url
from ..operators import audit, evaluate, history, portfolio, quality, radar, report, risk, valuation
from ..operators.components import checkpointed
from ..operators.percentiles import percentiles
from ..sources.views import AS_OF, listings, price_history, runs, table
from . import forms, jobs, oracles
from .jobs import ASK, TIES, _sql


def _round(df, digits=4):
    return df.select([F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _found(spark, sf_dir):
    return radar.opportunities(listings(spark, sf_dir), price_history(spark, sf_dir), AS_OF)


def _text(column, name):
    return F.array_join(column, "|").alias(name)


def a8_percentiles(spark, sf_dir):
    """Each commune's percentiles of prices per m2, by counting rounds."""
    base = listings(spark, sf_dir).where("m2_construidos is not null").select("comuna", (ask_clp() / F.col("m2_construidos")).alias("x"))
    return _round(percentiles(base, ["comuna"], "x", {"p25": 0.25, "p50": 0.5, "p90": 0.9}), 2)


def t1_best_comparables(spark, sf_dir):
    base = listings(spark, sf_dir)
    pairs = valuation.best_scored(base.where("status = 'active'"), base)
    return _round(valuation.top_rows(pairs.withColumns({"n_valid": F.lit(None).cast("long"), "cluster_penalty": F.lit(1.0)})).select(F.col("t_id").alias("id"), "c_id", "score"), 6)


def p7_distance_penalties(spark, sf_dir):
    """Of each listing's shift from the centre of its map."""
    km = F.when(F.col("lat").isNotNull(), F.abs(F.col("lat") + 33.45) * 111)
    return _round(listings(spark, sf_dir).select("id", distance_penalty(km).alias("penalty")), 6)


def p8_confidence_labels(spark, sf_dir):
    base = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 101 / 100).alias("score"), (F.col("p_size") % 12).alias("n"))
    return base.select("id", valuation.confidence_label(F.col("score"), F.col("n")).alias("label"), valuation.confidence_label(F.col("score"), F.col("n"), True).alias("lower"), radar.count_confidence(F.col("n"), F.col("score") * 100).alias("by_count"), risk.similarity_band(F.col("score")).alias("band"), risk.confidence_title(F.col("score") * 100).alias("title"), risk.discount_badge(F.col("score")).alias("badge"))


def p10_opportunities(spark, sf_dir):
    return _round(_found(spark, sf_dir).select("id", "listing_price", "undervaluation", "is_outlier", "missing_fields_pct", "missing_data_penalty", "confidence_level", "opportunity_score", "investment_score", "verdict", "label", "roi", "ranking", "price_drop_pct", "time_on_market_days", "comparables_mean", "comparables_min", "comparables_max"))


def p14_score_breakdowns(spark, sf_dir):
    return _round(_found(spark, sf_dir).select("id", "score_breakdown.*"))


def p16_legal_profiles(spark, sf_dir):
    return _found(spark, sf_dir).select("id", "legal_profile.legal_risk_score", "legal_profile.legal_risk_level", _text(F.col("legal_profile.legal_flags"), "flags"), "legal_profile.legal_summary")


def p18_texts(spark, sf_dir):
    return _found(spark, sf_dir).select("id", F.regexp_replace("reason", r"\d+(\.\d+)?%", "%").alias("reason"), F.regexp_replace("explanation", r"\d+%", "%").alias("explanation"))


def t2_ranking(spark, sf_dir):
    return radar.ranked(_found(spark, sf_dir), 20).select("id", "is_outlier", F.round("ranking", 6).alias("ranking"))


def t6_first_comparables(spark, sf_dir):
    found = _found(spark, sf_dir).select("id", F.posexplode("comparables_summary").alias("place", "c"))
    return _round(found.select("id", "place", F.col("c.precio").alias("price"), F.col("c.m2_construidos").alias("m2"), F.col("c.diferencia_pct").alias("difference_pct")))


def p19_risk_contexts(spark, sf_dir):
    found = report.risk_context(_found(spark, sf_dir))
    return _round(found.select("id", "thesis", "valuation_score", "market_support_score", "risk_score", _text(F.col("risk_flags"), "flags"), _text(F.col("catalysts"), "catalysts")))


def p21_decisions(spark, sf_dir):
    found = _found(spark, sf_dir)
    score, sure = F.col("investment_score"), F.col("confidence_score")
    judged = found.withColumn("decision", risk.decision(score, sure, F.col("is_outlier"), F.col("comparable_count"), F.col("missing_fields_pct"))).withColumn("profile", risk.decision_profile(F.col("decision"), sure))
    return judged.select("id", "decision", "profile.strategy", "profile.profile", risk.risk_level(score, sure).alias("risk"), risk.report_verdict(score).alias("verdict"), risk.recommendation(F.col("undervaluation"), sure).alias("recommendation"))


def p22_investment_metrics(spark, sf_dir):
    found = _found(spark, sf_dir)
    metrics = risk.investment_metrics(F.col("listing_price"), F.col("roi"), F.when(F.col("id") % 2 == 0, F.col("roi") + 1))
    return _round(found.select("id", metrics.alias("m"), _text(risk.bullets(F.col("undervaluation"), F.col("confidence_score"), F.col("comparable_count"), F.col("is_outlier")), "bullets")).select("id", "m.*", "bullets"))


def p24_data_bands(spark, sf_dir):
    return _found(spark, sf_dir).select("id", risk.data_bands(F.col("missing_fields_pct"), F.col("comparable_count"), F.col("confidence_score")).alias("bands")).select("id", "bands.*")


def p25_investment_cases(spark, sf_dir):
    found = report.investment_case(_found(spark, sf_dir))
    return found.select("id", "thesis", "narrative", "risk_line", _text(F.col("valuation_block"), "valuation"), F.size("risk_factors").alias("n_factors"), _text(F.col("risk_flags"), "flags"))


def p26_negotiations(spark, sf_dir):
    found = radar.with_evolution(_found(spark, sf_dir), price_history(spark, sf_dir), AS_OF)
    e = F.col("price_evolution")
    rows = found.select("id", risk.negotiation(e["days_on_market"], e["price_changes"], e["price_drop_from_peak_pct"], F.col("missing_fields_pct"), F.col("comparable_count"), F.col("confidence_score")).alias("n")).select("id", "n.*")
    return _round(rows)


def p27_report_metrics(spark, sf_dir):
    found = report.report_metrics(_found(spark, sf_dir))
    return _round(found.select("id", "price_m2", "market_price_m2", "delta", "delta_status", "discount_status", "comparables_status", "confidence_status", "missing_status", "reliability", "signal", _text(F.col("risk_flags"), "flags"), _text(F.col("strengths"), "strengths")))


def p29_price_insights(spark, sf_dir):
    course = history.evolution(listings(spark, sf_dir), price_history(spark, sf_dir), AS_OF)
    return report.price_insights(course).select("id", _text(F.col("insights"), "insights"))


def p36_negotiation_signals(spark, sf_dir):
    course = history.evolution(listings(spark, sf_dir), price_history(spark, sf_dir), AS_OF)
    found = report.negotiation_signals(course)
    return found.select("id", F.size("signals").alias("n"), F.get("signals", F.lit(0)).alias("first"))


def p30_positions(spark, sf_dir):
    base = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_totalprice") * (1 + (F.col("o_custkey") % 9 - 4) / 50)).alias("now"), F.col("o_totalprice").alias("saved"), (F.col("o_custkey") % 100).cast("double").alias("a"), F.when(F.col("o_custkey") % 7 > 0, (F.col("o_orderkey") % 100).cast("double")).alias("b"))
    delta = (F.col("now") - F.col("saved")) / F.col("saved") * 100
    return base.select("id", risk.position_status(F.col("saved"), F.col("now"), F.col("a"), F.col("b")).alias("status"), risk.price_action(F.round(delta, 6)).alias("action"), risk.versus_market(F.col("now"), F.when(F.col("id") % 5 > 0, F.col("saved"))).alias("market"))


def p35_details(spark, sf_dir):
    found = report.analysis_detail(_found(spark, sf_dir))
    return _round(found.select("id", "score", "discount", "yield_pct", F.size("comparables").alias("n"), F.get("comparables", F.lit(0))["price_m2"].alias("first_price_m2")))


def p38_radar_table(spark, sf_dir):
    return _round(report.radar_table(_found(spark, sf_dir)).drop("discount", "reason"))


def p39_scaled_prices(spark, sf_dir):
    """Each listing's place between its commune's extremes, and its bin."""
    base = listings(spark, sf_dir).select("id", "comuna", ask_clp().alias("price"))
    return _round(risk.scaled_points(base, "comuna", "price").select("id", "position"), 6)


def p39_histogram(spark, sf_dir):
    base = listings(spark, sf_dir).where("m2_construidos is not null").select((ask_clp() / F.col("m2_construidos") / 1e6).alias("x"))
    return risk.histogram(base, "x", 0.0, 12.0, 24)


def p39_points(spark, sf_dir):
    return _round(risk.chart_points(_found(spark, sf_dir)))


def p39_reference_series(spark, sf_dir):
    """Points of the opportunities whose log shows no change: one price or none."""
    series = history.chart_series(price_history(spark, sf_dir))
    series = series.groupBy("listing_id").agg(F.min("price").alias("least"), F.max("price").alias("most")).where("least < most")
    return _round(risk.reference_series(_found(spark, sf_dir), series), 2)


def c39_texts(spark, sf_dir):
    """Every listing's price in pesos and its summary."""
    return listings(spark, sf_dir).select("id", full_price(ask_clp()).alias("price"), risk.property_summary().alias("summary"))


def p40_summary(spark, sf_dir):
    base = listings(spark, sf_dir).withColumn("link", normal_url(F.col("url")))
    found = checkpointed(_found(spark, sf_dir))
    sections = {
        "database": audit.database_section(base), "quality": audit.quality_section(quality.coverage(base)), "benchmark": audit.benchmark_section(evaluate.benchmark(base)), "radar": audit.radar_section(radar.radar_candidates(base), found), "legal": audit.legal_section(found)}
    sections = {k: checkpointed(v) for k, v in sections.items()}
    listed, health = audit.system_audit(sections, found)
    return audit.summary(sections, found, listed, health)


def a14_market_context(spark, sf_dir):
    return _round(_found(spark, sf_dir).select("id", "comparables_mean", "comparables_min", "comparables_max"), 2)


def a22_legal_audit(spark, sf_dir):
    return _round(audit.legal_section(_found(spark, sf_dir)))


def a22_legal_levels(spark, sf_dir):
    found = checkpointed(_found(spark, sf_dir))
    levels = audit.legal_summary(found).select(F.concat(F.lit("level "), "level").alias("what"), "n")
    return levels.unionByName(audit.legal_flags(found).select(F.concat(F.lit("flag "), "flag").alias("what"), "n")).unionByName(audit.broken_rules(found, audit.LEGAL_CONTRADICTIONS).groupBy("code").agg(F.count("*").alias("n")).select(F.col("code").alias("what"), "n"))


def a23_radar_audit(spark, sf_dir):
    return _round(audit.radar_summary(_found(spark, sf_dir)))


def a24_dashboard(spark, sf_dir):
    return _round(risk.dashboard(_found(spark, sf_dir)), 6)


def a25_portfolio_header(spark, sf_dir):
    return _round(portfolio.buckets(_positions(spark, sf_dir)))


def t7_movers(spark, sf_dir):
    return portfolio.movers(_positions(spark, sf_dir))


def _positions(spark, sf_dir):
    base, log = listings(spark, sf_dir), price_history(spark, sf_dir)
    saved = base.select(F.col("source_listing_id").alias("listing_id"), (ask_clp() * (1 + (F.col("id") % 11 - 5) / 100)).alias("precio_guardado"), (F.col("id") % 100).cast("double").alias("score_guardado"), F.lit(AS_OF).alias("saved_at"))
    return portfolio.positions(saved, base, radar.opportunities(base, log, AS_OF), history.signals(base, log, AS_OF))


def e14_positions(spark, sf_dir):
    return _round(_positions(spark, sf_dir).select("listing_id", "precio_guardado", "precio_actual", "delta_pct", "score_actual", "status", "action", "price_drop_pct"))


def a27_comparable_summaries(spark, sf_dir):
    base = listings(spark, sf_dir)
    found = report.comparable_summary(report.comparables(valuation.market_values(radar.radar_candidates(base), base)))
    return _round(found, 3)


def a34_factors(spark, sf_dir):
    base = listings(spark, sf_dir)
    targets = radar.radar_candidates(base).withColumn("ano_construccion", F.when(F.col("id") % 4 > 0, (1960 + F.col("id") % 42).cast("int")))
    summary = report.comparable_summary(report.comparables(valuation.market_values(targets, base)))
    rows = report.factors(targets, summary, 2001)
    return _round(rows.withColumn("summary", report.automatic_summary(F.lit("En mercado"), F.col("largest"))), 6)


def t9_comparable_tables(spark, sf_dir):
    base = listings(spark, sf_dir)
    return _round(report.comparable_table(report.comparables(valuation.market_values(radar.radar_candidates(base), base)), 5), 3)


def p33_radar_results(spark, sf_dir):
    base = listings(spark, sf_dir)
    return radar.radar_result(radar.ranked(_found(spark, sf_dir), 20), radar.radar_candidates(base))


def p33_contracts(spark, sf_dir):
    """Result rows with gaps, one a part."""
    base = table(spark, sf_dir, "part")
    rows = base.select(F.when(F.col("p_partkey") % 3 == 0, "ok").alias("status"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_size").cast("string")).otherwise("x").alias("total_count"), F.when(F.col("p_partkey") % 5 > 0, F.col("p_size").cast("bigint")).alias("ready_count"))
    return radar.contract(rows).groupBy("status", "low_data_mode", F.col("message").isNull().alias("silent")).agg(F.count("*").alias("n"), F.sum("total_count").alias("total"), F.sum("ready_count").alias("ready"))


def a30_funnel(spark, sf_dir):
    base = listings(spark, sf_dir)
    targets = radar.radar_candidates(base)
    found = audit.funnel(checkpointed(valuation.funnel_counts(targets, base)), valuation.market_values(targets, base))
    return _round(found, 6)


def a15_errors(spark, sf_dir):
    return _round(evaluate.error_metrics(evaluate.holdout(listings(spark, sf_dir))), 3)


def a16_outcomes(spark, sf_dir):
    return evaluate.skip_counts(evaluate.holdout(listings(spark, sf_dir)))


def a18_best_and_worst(spark, sf_dir):
    return evaluate.best_and_worst(evaluate.error_metrics(evaluate.holdout(listings(spark, sf_dir))))


def a19_repeated_runs(spark, sf_dir):
    """The held-out predictions dealt into five runs."""
    found = evaluate.holdout(listings(spark, sf_dir)).where("skipped is null")
    return _round(evaluate.run_summary(found.groupBy((F.col("id") % 5).alias("run")).agg(F.avg("percentage_error").alias("mape"))), 6)


def e8_repeated_runs(spark, sf_dir):
    """Five seeded runs of the benchmark, valued in one plan."""
    return _round(evaluate.run_errors(evaluate.repeated_benchmark(listings(spark, sf_dir))), 5)


def a19_benchmark_runs(spark, sf_dir):
    """Mean, best, worst and deviation of the five runs, by mean and by median error."""
    runs = checkpointed(evaluate.run_errors(evaluate.repeated_benchmark(listings(spark, sf_dir))))
    parts = [evaluate.run_summary(runs, metric).withColumn("metric", F.lit(metric)) for metric in ("mape", "median_pe")]
    return _round(parts[0].unionByName(parts[1]), 5)


def t3_extremes(spark, sf_dir):
    return _round(evaluate.extremes(evaluate.holdout(listings(spark, sf_dir))), 6)


def t5_split(spark, sf_dir):
    return evaluate.split(evaluate.evaluation_rows(listings(spark, sf_dir))).select("id", "held_out")


def e7_predictions(spark, sf_dir):
    return _round(evaluate.holdout(listings(spark, sf_dir)).drop("mode"), 3)


def e8_errors(spark, sf_dir):
    return _round(evaluate.benchmark(listings(spark, sf_dir)), 3)


def a17_benchmark(spark, sf_dir):
    return _round(evaluate.error_metrics(evaluate.benchmark(listings(spark, sf_dir)), ("comuna", "m2_range")).select("grouping", "value", "n", "mape", "median_pe"), 5)


def e6_best_within_budget(spark, sf_dir):
    found = radar.opportunities(listings(spark, sf_dir), price_history(spark, sf_dir), AS_OF, budget=250_000_000)
    return _round(radar.ranked(found, 3).select("id", "listing_price", "undervaluation", "investment_score"))


def e9_system_audit(spark, sf_dir):
    base = listings(spark, sf_dir).withColumn("link", normal_url(F.col("url")))
    found, targets = checkpointed(_found(spark, sf_dir)), radar.radar_candidates(base)
    sections = {
        "database": audit.database_section(base), "quality": audit.quality_section(quality.coverage(base)), "benchmark": audit.benchmark_section(evaluate.benchmark(base)), "radar": audit.radar_section(targets, found),
        "legal": audit.legal_section(found), "funnel": audit.funnel(checkpointed(valuation.funnel_counts(targets, base)), found)}
    listed, health = audit.system_audit({k: checkpointed(v) for k, v in sections.items()}, found)
    return listed.select("section", "severity", "code", "n").unionByName(health.select(F.lit("health").alias("section"), F.col("system_status").alias("severity"), F.col("general_status").alias("code"), F.col("score").cast("long").alias("n")))


def p40_actions(spark, sf_dir):
    base = listings(spark, sf_dir).withColumn("link", normal_url(F.col("url")))
    found = checkpointed(_found(spark, sf_dir))
    sections = {"database": audit.database_section(base), "quality": audit.quality_section(quality.coverage(base)), "radar": audit.radar_section(radar.radar_candidates(base), found), "legal": audit.legal_section(found)}
    sections = {k: checkpointed(v) for k, v in sections.items()}
    _, health = audit.system_audit(sections, found)
    thin = quality.comuna_coverage(base).agg(F.count_if("small_group").alias("thin_comunas"))
    return audit.top_actions(health.crossJoin(sections["radar"]).crossJoin(sections["legal"].select("high_risk")).crossJoin(thin).withColumn("median_error_pct", F.lit(None).cast("double")))


def p32_contradictions(spark, sf_dir):
    return audit.broken_rules(_found(spark, sf_dir))


def a32_audit_totals(spark, sf_dir):
    base, log = listings(spark, sf_dir), price_history(spark, sf_dir)
    return audit.audit_totals(audit.product_audit(radar.with_evolution(radar.opportunities(base, log, AS_OF), log, AS_OF)))


def a21_stopped_runs(spark, sf_dir):
    """Runs with what they inserted and updated; a run of updates alone stops the scraping."""
    inserted = F.col("valid_rows") - F.floor(F.col("valid_rows") * (F.col("raw_rows") % 11) / 10)
    base = runs(spark, sf_dir).withColumns({"inserted": F.greatest(inserted, F.lit(0)), "updated": F.col("valid_rows") - F.greatest(inserted, F.lit(0))})
    return audit.iteration_summary(audit.source_health(base)).select("run", "raw_rows", "valid_rows", "inserted", "updated", "stop_early")


QUERIES = {name: f for name, f in list(globals().items()) if callable(f) and name[0] in "acptfwe" and name[1:2].isdigit()}

FLOAT = "CAST({} AS DOUBLE)"
#: Opportunities: g0 values joined, g1 discounts, opp with all scores.
OPP = f"""{oracles.BASE}, {oracles.PAIRS.format(targets=oracles.RADAR_TARGETS)}, {oracles.MARKET}, {oracles.FIRST},
cps AS (SELECT t_id, avg(price) AS comparables_mean, min(price) AS comparables_min, max(price) AS comparables_max FROM x4 GROUP BY t_id),
g0 AS (SELECT l.*, {ASK} AS listing_price, x6.price_m2 * x6.m2 AS estimated_price, p25 * x6.m2 AS min_price, p75 * x6.m2 AS max_price, confidence_score, score_mean, CAST(comparable_count AS INT) AS comparable_count, comparables_mean, comparables_min, comparables_max
  FROM listings l JOIN x6 ON x6.t_id = l.id JOIN cps ON cps.t_id = l.id WHERE x6.before >= 3 AND confidence_score >= 0.25),
g1 AS (SELECT *, (estimated_price - listing_price) / estimated_price AS undervaluation, CAST(comuna IS NULL AS INT) + CAST(dormitorios IS NULL AS INT) + CAST(banos IS NULL AS INT) + CAST(estacionamientos IS NULL AS INT) + CAST(lat IS NULL AS INT) + CAST(lon IS NULL AS INT) AS missing FROM g0),
g2 AS (SELECT g1.*, undervaluation > 0.30 AS is_outlier, missing / 6 * 100 AS missing_fields_pct, least(missing * 0.04::DOUBLE, 0.24) AS missing_data_penalty, CASE WHEN listing_price > 0 AND f.price > listing_price THEN (f.price - listing_price) / f.price ELSE 0 END AS price_drop_pct,
    CAST(greatest(date_diff('day', coalesce(fecha_publicacion, f.day, fecha_captura), DATE '2001-12-01'), 0) AS INT) AS time_on_market_days FROM g1 LEFT JOIN f ON f.listing_id = g1.id WHERE undervaluation >= 0.05),
g3 AS (SELECT *, CASE WHEN is_outlier THEN 'low' WHEN confidence_score >= 0.8 THEN 'high' WHEN confidence_score >= 0.65 THEN 'medium' ELSE 'low' END AS confidence_level,
    greatest(least(undervaluation * 0.65 + confidence_score * 0.25 + least(price_drop_pct, 0.20) * 0.20 + CASE WHEN time_on_market_days >= 120 THEN 0.06 WHEN time_on_market_days >= 60 THEN 0.03 ELSE 0 END - missing_data_penalty, 1), 0) AS opportunity_score,
    CASE WHEN missing_fields_pct > 1 THEN missing_fields_pct ELSE missing_fields_pct * 100 END AS mp, CASE WHEN missing_fields_pct > 1 THEN missing_fields_pct / 100 ELSE missing_fields_pct END AS mf FROM g2),
g4 AS (SELECT *, least(greatest(undervaluation * 100 / 100, 0) / 0.30::DOUBLE, 1) AS bd, greatest(least(confidence_score, 1), 0) * CASE WHEN mp > 30 THEN 0.8 WHEN mp > 15 THEN 0.9 ELSE 1 END AS bc, least(comparable_count / 10, 1) AS bn, greatest(0, 1 - (CASE WHEN is_outlier THEN 0.3::DOUBLE ELSE 0 END + mf)) AS br,
    CASE WHEN mp > 30 THEN 20 WHEN mp > 15 THEN 10 ELSE 0 END AS bp FROM g3),
g5 AS (SELECT *, greatest(0, CAST(trunc((bd * 0.4::DOUBLE + bc * 0.3::DOUBLE + bn * 0.2::DOUBLE + br * 0.1::DOUBLE) * 100) AS INT) - bp) AS investment_score,
    least(30 + CASE WHEN comparable_count < 3 THEN 25 WHEN comparable_count < 6 THEN 15 ELSE 0 END + CASE WHEN confidence_score * 100 < 60 THEN 20 WHEN confidence_score * 100 < 75 THEN 10 ELSE 0 END + CASE WHEN missing_fields_pct > 30 THEN 20 WHEN missing_fields_pct > 15 THEN 10 ELSE 0 END, 100) AS legal_risk_score FROM g4),
opp AS (SELECT *, CASE WHEN legal_risk_score < 40 THEN 'Bajo' WHEN legal_risk_score < 70 THEN 'Medio' ELSE 'Alto' END AS legal_risk_level, CASE WHEN investment_score >= 75 THEN 'Comprar' WHEN investment_score >= 55 THEN 'Interesante' ELSE 'Evitar' END AS verdict,
    undervaluation * confidence_score AS ranking, CASE WHEN comuna IN ('Vitacura', 'Las Condes') THEN 3.5 WHEN comuna IN ('Providencia', 'Ñuñoa') THEN 3.0 ELSE 2.0 END AS roi, CASE WHEN comparables_mean <> 0 THEN (comparables_max - comparables_min) / comparables_mean END AS dispersion,
    list_filter([CASE WHEN comparable_count < 3 THEN 'Muy pocos comparables' WHEN comparable_count < 6 THEN 'Pocos comparables' END, CASE WHEN confidence_score * 100 < 60 THEN 'Baja confianza en datos' END, CASE WHEN missing_fields_pct > 15 THEN 'Datos incompletos' END,
      CASE WHEN comparable_count < 3 AND confidence_score * 100 < 60 THEN 'Alta incertidumbre en valorización' END, CASE WHEN missing_fields_pct > 30 AND confidence_score * 100 < 70 THEN 'Información insuficiente para evaluación confiable' END,
      CASE WHEN comparable_count >= 8 AND confidence_score * 100 >= 80 THEN 'Buena base de comparables y alta confiabilidad' END], lambda x: x IS NOT NULL) AS flags,
    list_filter([CASE WHEN missing_fields_pct > 30 THEN 'Datos incompletos sobre 30%.' WHEN missing_fields_pct > 15 THEN 'Datos parcialmente incompletos.' END, CASE WHEN comparable_count < 5 THEN 'Pocos comparables para sostener convicción.' END, CASE WHEN confidence_score < 0.55 THEN 'Confianza baja del modelo.' END], lambda x: x IS NOT NULL) AS more_flags FROM g5)"""
EVO = f"""pts AS (SELECT listing_id AS id, fecha_captura AS day, 0 AS now, {TIES.replace('fecha_captura, ', '')}, CAST(precio_clp_nuevo AS DOUBLE) AS p FROM history WHERE precio_clp_nuevo > 0
  UNION ALL SELECT id, DATE '2001-12-01', 1, NULL, NULL, NULL, NULL, NULL, NULL, {ASK} FROM listings WHERE {ASK} IS NOT NULL),
stp AS (SELECT *, lag(p) OVER w AS before, row_number() OVER w AS n FROM pts WINDOW w AS (PARTITION BY id ORDER BY day, now, {TIES.replace('fecha_captura, ', '')})),
evg AS (SELECT id, max(p) AS hi, min(p) AS lo, count(*) FILTER (p <> before) AS price_changes, arg_max(day, n) FILTER (p <> before) AS last_change, arg_max(before, n) FILTER (p <> before) AS last_distinct FROM stp GROUP BY id),
evs AS (SELECT listing_id, min(fecha_captura) AS first_day FROM history GROUP BY listing_id),
evo AS (SELECT l.id, {ASK} AS current_price, hi AS all_time_high, lo AS all_time_low, CASE WHEN ({ASK}) IS NOT NULL THEN greatest((hi - ({ASK})) / hi, 0) END AS price_drop_from_peak_pct, greatest((hi - lo) / hi, 0) AS price_range_pct, coalesce(price_changes, 0) AS price_changes,
    CAST(greatest(date_diff('day', last_change, DATE '2001-12-01'), 0) AS INT) AS last_price_change_days, CASE WHEN ({ASK}) <> last_distinct THEN CASE WHEN ({ASK}) < last_distinct THEN 'down' ELSE 'up' END ELSE 'stable' END AS trend,
    CAST(greatest(date_diff('day', least(fecha_publicacion, first_day), DATE '2001-12-01'), 0) AS INT) AS days_on_market FROM listings l LEFT JOIN evg ON evg.id = l.id LEFT JOIN evs ON evs.listing_id = l.id)"""
#: Held-out predictions.
HELD = f"""{oracles.BASE}, ev AS (SELECT *, {ASK} AS price FROM u WHERE status = 'active' AND m2_construidos > 0 AND (precio_clp IS NOT NULL OR precio_uf IS NOT NULL)),
sp AS (SELECT *, row_number() OVER (ORDER BY md5('42-' || id)) <= greatest(1, CAST(round_even((SELECT count(*) FROM ev) * 0.25::DOUBLE, 0) AS INT)) AS held FROM ev),
hp AS (SELECT t.id AS t_id, t.m2_construidos AS tm, t.dormitorios AS td, t.banos AS tb, t.estacionamientos AS te, t.lat AS tlat, t.lon AS tlon, c.id AS c_id, c.m2_construidos AS cm, c.dormitorios AS cd, c.banos AS cb, c.estacionamientos AS ce, c.lat AS clat, c.lon AS clon, c.price,
    {oracles.SEGMENT.format(m='t.m2_construidos')} = {oracles.SEGMENT.format(m='c.m2_construidos')} AS same_segment
  FROM sp t JOIN sp c ON t.held AND NOT c.held AND t.comuna = c.comuna AND t.m2_construidos BETWEEN 10 AND 1000 AND c.m2_construidos BETWEEN 10 AND 1000 AND c.m2_construidos BETWEEN t.m2_construidos * 0.85 AND t.m2_construidos * 1.15 AND NOT coalesce({jobs.SAME.format(a='t', b='c')}, false)
    AND ({oracles.SEGMENT.format(m='t.m2_construidos')} = {oracles.SEGMENT.format(m='c.m2_construidos')} OR 'standard_apartment' IN ({oracles.SEGMENT.format(m='t.m2_construidos')}, {oracles.SEGMENT.format(m='c.m2_construidos')}))),
{oracles.SCORED.format(source='hp')},
least_ AS (SELECT 5 AS k UNION ALL SELECT 3),
h1 AS (SELECT s.*, k, count(*) FILTER (score >= 0.40) OVER (PARTITION BY t_id, k) AS n40 FROM s, least_),
h2 AS (SELECT *, count(*) OVER (PARTITION BY t_id, k) AS nv, row_number() OVER (PARTITION BY t_id, k ORDER BY score DESC, c_id) AS rk FROM h1 WHERE score >= 0.40 OR (n40 < k AND score >= 0.25)),
h3 AS (SELECT *, count(*) OVER w AS n, quantile_cont(price_m2, 0.25) OVER w AS q1, quantile_cont(price_m2, 0.75) OVER w AS q3 FROM h2 WHERE nv >= k AND rk <= 10 WINDOW w AS (PARTITION BY t_id, k)),
h4 AS (SELECT *, count(*) FILTER (price_m2 BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) OVER (PARTITION BY t_id, k) AS inside FROM h3),
h5 AS (SELECT *, count(*) OVER (PARTITION BY t_id, k) AS m, sum(score) OVER (PARTITION BY t_id, k ORDER BY price_m2, c_id) AS run, sum(score) OVER (PARTITION BY t_id, k) AS total FROM h4 WHERE n < 3 OR q3 <= q1 OR inside < 3 OR price_m2 BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)),
h6 AS (SELECT t_id, k, min(CASE WHEN run >= total / 2 THEN price_m2 END) * any_value(tm) AS estimated_price, CAST(any_value(m) AS INT) AS comparable_count, greatest(least(avg(score) * 0.5 + least(any_value(m) / 10, 1) * 0.25 + greatest(1 - least(stddev_pop(price_m2) / avg(price_m2) / 0.35, 1), 0) * 0.25, 1), 0) AS confidence_score FROM h5 WHERE m >= k GROUP BY t_id, k),
md AS (SELECT CASE WHEN count(*) >= 10 THEN 5 ELSE 3 END AS k FROM h6 WHERE k = 5),
pred AS (SELECT t.id, coalesce(t.comuna, 'Sin dato') AS comuna, CASE WHEN t.m2_construidos < 60 THEN 'pequeno' WHEN t.m2_construidos <= 100 THEN 'mediano' ELSE 'grande' END AS size_bucket, CASE WHEN t.m2_construidos < 50 THEN '<50' WHEN t.m2_construidos <= 100 THEN '50-100' ELSE '>100' END AS m2_range, t.price AS actual_price,
    e.estimated_price, e.comparable_count, e.confidence_score, abs(e.estimated_price - t.price) AS absolute_error, abs(e.estimated_price - t.price) / t.price AS percentage_error, CASE WHEN coalesce(t.price, 0) <= 0 THEN 'invalid' WHEN e.t_id IS NULL THEN 'low_data' END AS skipped FROM sp t LEFT JOIN h6 e ON e.t_id = t.id AND e.k = (SELECT k FROM md) WHERE t.held)"""
METRICS = "SELECT {g} AS grouping, {v} AS value, count(*) AS n, avg(absolute_error) AS mae, avg(percentage_error) AS mape, quantile_cont(absolute_error, 0.5) AS median_ae, quantile_cont(percentage_error, 0.5) AS median_pe, avg(comparable_count) AS mean_comparables, quantile_cont(comparable_count::DOUBLE, 0.5) AS median_comparables FROM {t} WHERE skipped IS NULL GROUP BY 1, 2"


def _metrics(source: str, *by: str) -> str:
    return " UNION ALL ".join([METRICS.format(g="'all'", v="'all'", t=source), *(METRICS.format(g=f"'{b}'", v=b, t=source) for b in by)])


_SAMPLE = f"smp AS (SELECT id FROM listings WHERE status = 'active' AND m2_construidos > 0 AND comuna IS NOT NULL AND (precio_clp IS NOT NULL OR precio_uf IS NOT NULL) ORDER BY md5('0-' || id) LIMIT 100)"
BENCH = f"""{_SAMPLE}, {oracles.BASE}, {oracles.PAIRS.format(targets='id IN (SELECT id FROM smp)')}, {oracles.MARKET},
bm AS (SELECT l.id, comuna, CASE WHEN m2_construidos < 50 THEN '<50' WHEN m2_construidos <= 100 THEN '50-100' ELSE '>100' END AS m2_range, {ASK} AS actual_price, x6.price_m2 * x6.m2 AS estimated_price, CAST(x6.comparable_count AS INT) AS comparable_count,
  abs(x6.price_m2 * x6.m2 - ({ASK})) AS absolute_error, abs(x6.price_m2 * x6.m2 - ({ASK})) / ({ASK}) AS percentage_error, CASE WHEN x6.t_id IS NULL THEN 'no_estimate' END AS skipped FROM smp JOIN listings l ON l.id = smp.id LEFT JOIN x6 ON x6.t_id = l.id AND x6.before >= 3 AND x6.confidence_score >= 0.25)"""
REPEATED = BENCH.replace(_SAMPLE, "rn AS (SELECT run, id FROM (SELECT run, id, row_number() OVER (PARTITION BY run ORDER BY md5(run || '-' || id), id) AS r FROM listings, (VALUES (0), (1), (2), (3), (4)) v(run) WHERE status = 'active' AND m2_construidos > 0 AND comuna IS NOT NULL AND (precio_clp IS NOT NULL OR precio_uf IS NOT NULL)) WHERE r <= 100), smp AS (SELECT DISTINCT id FROM rn)") + ", re AS (SELECT run, avg(percentage_error) AS mape, quantile_cont(percentage_error, 0.5) AS median_pe, count(*) FILTER (skipped IS NULL) AS evaluated, count(*) FILTER (skipped IS NOT NULL) AS skipped FROM rn JOIN bm USING (id) GROUP BY run)"
_ALL = f"{oracles.BASE}, {oracles.PAIRS.format(targets=oracles.RADAR_TARGETS)}, {oracles.MARKET}"
_GOOD = "x6.before >= 3 AND x6.confidence_score >= 0.25"
_POS = f"""{OPP}, ps AS (SELECT source_listing_id AS listing_id, id, ({ASK}) * (1 + (id % 11 - 5) / 100) AS saved, CAST(id % 100 AS DOUBLE) AS score_saved, {ASK} AS now FROM listings),
pos AS (SELECT ps.listing_id, saved AS precio_guardado, now AS precio_actual, CASE WHEN saved > 0 THEN (now - saved) / saved * 100 END AS delta_pct, o.investment_score AS score_actual, score_saved, CASE WHEN now > 0 AND f.price > now THEN (f.price - now) / f.price ELSE 0 END AS price_drop_pct,
  CASE WHEN coalesce(now < saved, false) OR coalesce(o.investment_score > score_saved, false) THEN 'Improving' WHEN coalesce(now = saved, true) AND coalesce(o.investment_score = score_saved, true) THEN 'Stable' ELSE 'Deteriorating' END AS status FROM ps LEFT JOIN opp o ON o.id = ps.id LEFT JOIN f ON f.listing_id = ps.id),
po AS (SELECT *, CASE WHEN delta_pct <= -5 THEN 'BUY' WHEN delta_pct <= -3 THEN 'WATCH' ELSE 'HOLD' END AS action FROM pos)"""
_THIRD = "CASE WHEN {a} THEN 'beat' WHEN {b} THEN 'caution' ELSE 'miss' END"
_LAYOUT = "CASE WHEN cd IS NOT NULL OR cb IS NOT NULL THEN coalesce(CAST(cd AS VARCHAR), 'sin dato') || ' dorm / ' || coalesce(CAST(cb AS VARCHAR), 'sin dato') || ' baños' END"
SUMMARY = f"""{_ALL}, cq AS (SELECT x4.* FROM x4 JOIN x6 ON x6.t_id = x4.t_id WHERE {_GOOD}),
lay AS (SELECT t_id, {_LAYOUT} AS layout, count(*) AS n, max(ROW(score, -c_id)) AS best FROM cq WHERE cd IS NOT NULL OR cb IS NOT NULL GROUP BY 1, 2),
summ AS (SELECT cq.t_id AS id, count(*) AS n, avg(price_m2) AS mean_price_m2, avg(cm) AS mean_m2, CASE WHEN count(*) >= 2 THEN stddev_pop(price_m2) / avg(price_m2) END AS variation, avg(cd) AS mean_dormitorios, min(cm) AS min_m2, max(cm) AS max_m2, min(price) AS min_price, max(price) AS max_price,
  coalesce((SELECT arg_max(layout, ROW(n, best)) FROM lay WHERE lay.t_id = cq.t_id), 'Sin datos') AS layout FROM cq GROUP BY cq.t_id)"""
_LIMIT = "greatest(least({}, 0.12), -0.12)"
_RULES = {
    "high_confidence_with_few_comparables": ("warning", "confidence_score * 100 > 80 AND comparable_count < 3"),
    "strong_opportunity_with_missing_data": ("warning", "investment_score >= 75 AND missing_fields_pct > 30"),
    "extreme_discount_with_low_confidence": ("critical", "undervaluation * 100 > 40 AND confidence_score * 100 < 60"),
    "high_investment_score_with_high_legal_risk": ("warning", "investment_score >= 75 AND (legal_risk_level = 'Alto' OR legal_risk_score >= 70)"),
    "legal_low_with_low_confidence": ("warning", "legal_risk_level = 'Bajo' AND confidence_score * 100 < 60"),
    "many_comparables_with_low_average_score": ("info", "comparable_count >= 8 AND score_mean < 0.55"),
}
_FUNNEL = f"""{_ALL}, fn AS (SELECT t_id, count(*) AS before, count(*) FILTER (CASE mode WHEN 0 THEN equal WHEN 1 THEN close ELSE true END) AS segmented, any_value(ne) < 5 AS relaxed, any_value(n1) < 3 AS adjacent FROM k6 GROUP BY t_id),
fu AS (SELECT count(*) AS targets, avg(before) AS mean_before, avg(segmented) AS mean_segmented, count(*) FILTER (before > 0 AND segmented = 0) AS none_left, count(*) FILTER (segmented < 3) AS under_three, count(*) FILTER (before > 20 AND segmented = 0) AS many_lost,
  CAST(sum(CAST(relaxed AS INT) + CAST(adjacent AS INT)) AS BIGINT) AS fallbacks, count(*) FILTER (segmented < 3) AS insufficient, count(*) FILTER (fn.t_id IN (SELECT t_id FROM x6 WHERE {_GOOD})) AS results FROM fn)"""
VALUE = oracles.MARKET
for _old, _new in (
    ("n1 < 3 AND n2 > n1", "n1 < 5 AND n2 > n1"),
    ("n40 < 3 AND", "n40 < 5 AND"),
    ("WHERE nv >= 3", "WHERE nv >= 5"),
    ("FROM k8 WHERE nk >= 3", "FROM (SELECT *, 0 AS mode, count(*) OVER (PARTITION BY t_id) AS candidates FROM k3) WHERE candidates >= 5"),
    ("count(*) OVER (PARTITION BY t_id) AS m FROM w6", "count(*) OVER (PARTITION BY t_id) AS m, avg(score) OVER (PARTITION BY t_id) AS sb FROM w6"),
    ("avg(score) AS score_mean", "any_value(sb) AS score_mean"),
):
    VALUE = VALUE.replace(_old, _new)
_CODES = """list_filter([CASE WHEN investment_score >= 60 AND missing_fields_pct > 25 AND NOT (investment_score > 70 AND missing_fields_pct > 50) AND NOT (investment_score >= 75 AND confidence_score < 0.55) THEN 'good_score_incomplete_data' END, CASE WHEN undervaluation >= 0.10 AND comparable_count < 7 AND NOT (undervaluation >= 0.15 AND comparable_count < 4) THEN 'discount_thin_support' END,
  CASE WHEN (e.days_on_market > 25 OR e.price_changes >= 2 OR coalesce(e.price_drop_from_peak_pct >= 0.08, false)) AND (missing_fields_pct > 50 OR confidence_score < 0.5) THEN 'negotiation_on_weak_data' END, CASE WHEN comparable_count BETWEEN 3 AND 5 THEN 'limited_depth' END], lambda x: x IS NOT NULL) AS warnings,
  list_filter([CASE WHEN investment_score > 70 AND missing_fields_pct > 50 THEN 'high_score_poor_data' END, CASE WHEN investment_score >= 75 AND confidence_score < 0.55 AND NOT (investment_score > 70 AND missing_fields_pct > 50) THEN 'high_score_weak_confidence' END, CASE WHEN undervaluation >= 0.15 AND comparable_count < 4 THEN 'high_discount_few_comparables' END,
  CASE WHEN investment_score >= 75 AND confidence_score < 0.5 THEN 'positive_text_low_confidence' END, CASE WHEN investment_score >= 75 AND comparable_count < 4 THEN 'positive_text_few_comparables' END, CASE WHEN comparable_count < 3 THEN 'very_low_depth' END, CASE WHEN listing_price / m2_construidos < 300000 THEN 'price_m2_too_low' END, CASE WHEN listing_price / m2_construidos > 10000000 THEN 'price_m2_too_high' END], lambda x: x IS NOT NULL) AS critical"""
AUDIT = f"{OPP}, {EVO}, pau AS (SELECT opp.id, {_CODES} FROM opp JOIN evo e ON e.id = opp.id)"
_DB = f"""lk AS (SELECT *, {jobs.LINK} AS link FROM listings), db AS (SELECT count(*) AS total, count(*) FILTER (status = 'active') AS active, count(*) FILTER (precio_clp IS NULL AND precio_uf IS NULL) AS without_price, count(*) FILTER (m2_construidos IS NULL) AS without_m2, count(*) FILTER (lat IS NULL OR lon IS NULL) AS without_coordinates,
  (SELECT count(*) FROM (SELECT fuente, link FROM lk GROUP BY 1, 2 HAVING count(*) > 1)) AS duplicate_links FROM listings), ql AS (SELECT count(*) FILTER (usable) / count(*) AS usable_ratio, count(*) FILTER (NOT ppm2 BETWEEN 500000 AND 10000000) AS outliers FROM u)"""
_DBF = """SELECT 'database' AS section, 'critical' AS severity, 'no_active_listings' AS code, 1 AS n FROM db WHERE active = 0 UNION ALL SELECT 'database', 'warning', 'listings_without_price', 1 FROM db WHERE without_price > 0 UNION ALL SELECT 'database', 'warning', 'listings_without_m2', 1 FROM db WHERE without_m2 > 0
  UNION ALL SELECT 'database', 'warning', 'duplicate_source_link', 1 FROM db WHERE duplicate_links > 0 UNION ALL SELECT 'quality', 'warning', 'low_usable_listing_ratio', 1 FROM ql WHERE usable_ratio < 0.5 UNION ALL SELECT 'quality', 'warning', 'precio_m2_outliers', 1 FROM ql WHERE outliers > 0"""
_WEIGHED = """lv AS (SELECT DISTINCT CASE WHEN code IN ('listings_without_m2', 'legal_low_with_few_comparables', 'high_confidence_with_few_comparables') THEN 'high' WHEN code = 'low_usable_listing_ratio' THEN 'medium' WHEN severity = 'critical' THEN 'critical' ELSE 'low' END AS level, code FROM fd
  UNION SELECT 'high', 'missing_m2' FROM db WHERE without_m2 > 0 UNION SELECT 'medium', 'missing_coordinates' FROM db WHERE without_coordinates > 0{more}),
hl AS (SELECT count(*) FILTER (level = 'critical') AS critical, count(*) FILTER (level = 'high') AS high, count(*) FILTER (level = 'medium') AS medium, count(*) FILTER (level = 'low') AS low FROM lv),
hs AS (SELECT *, greatest(100 - 40 * critical - 20 * high - 10 * medium - 5 * low, 0) AS score, CASE WHEN critical > 0 THEN 'CRITICAL' WHEN high > 0 THEN 'UNSTABLE' WHEN medium > 0 THEN 'WARNING' ELSE 'HEALTHY' END AS system_status, CASE WHEN (SELECT count(*) FROM fd WHERE severity = 'critical') > 0 THEN 'CRITICAL' WHEN (SELECT count(*) FROM fd WHERE severity = 'warning') > 0 THEN 'WARNING' ELSE 'OK' END AS general_status FROM hl)"""
_FUNNEL_ROWS = f"""fn AS (SELECT t_id, count(*) AS before, count(*) FILTER (CASE mode WHEN 0 THEN equal WHEN 1 THEN close ELSE true END) AS segmented, any_value(ne) < 5 AS relaxed, any_value(n1) < 3 AS adjacent FROM k6 GROUP BY t_id),
fu AS (SELECT avg(segmented) AS mean_segmented, count(*) FILTER (before > 0 AND segmented = 0) / count(*) AS lost, count(*) FILTER (before > 20 AND segmented = 0) AS many_lost, sum(CAST(relaxed AS INT) + CAST(adjacent AS INT)) AS fallbacks, count(*) FILTER (segmented < 3) AS insufficient, count(*) FILTER (segmented < 3) / count(*) AS insufficient_share, count(*) FILTER (t_id IN (SELECT id FROM opp)) AS results, count(*) FILTER (t_id IN (SELECT id FROM opp)) / count(*) AS result_share FROM fn)"""
_SYSTEM = f"""{OPP}, {_DB}, {_FUNNEL_ROWS}, {_SAMPLE}, bn AS (SELECT count(x6.t_id) AS evaluated, quantile_cont(abs(x6.price_m2 * x6.m2 - ({ASK})) / ({ASK}), 0.5) * 100 AS med, avg(abs(x6.price_m2 * x6.m2 - ({ASK})) / ({ASK})) * 100 AS mean FROM smp JOIN listings l ON l.id = smp.id JOIN x6 ON x6.t_id = l.id AND {_GOOD}),
fd AS ({_DBF} UNION ALL SELECT 'benchmark', 'critical', 'benchmark_no_results', 1 FROM bn WHERE evaluated = 0 UNION ALL SELECT 'benchmark', 'warning', 'high_median_model_error', 1 FROM bn WHERE med > 25
  UNION ALL SELECT 'radar', 'critical', 'radar_no_ready_listings', 1 WHERE NOT EXISTS (FROM t) UNION ALL SELECT 'radar', 'warning', 'radar_no_opportunities', 1 WHERE NOT EXISTS (FROM opp)
  UNION ALL SELECT 'funnel', 'critical', 'segmentation_loses_comparables_over_50pct', 1 FROM fu WHERE lost > 0.5 UNION ALL SELECT 'funnel', 'warning', 'segmentation_loses_comparables_over_30pct', 1 FROM fu WHERE lost > 0.3 AND lost <= 0.5 UNION ALL SELECT 'funnel', 'critical', 'segmentation_eliminating_valid_data', 1 FROM fu WHERE many_lost > 0
  UNION ALL SELECT 'funnel', 'critical', 'radar_not_functional', 1 FROM fu WHERE insufficient_share > 0.7 UNION ALL SELECT 'funnel', 'warning', 'fallback_not_effective', 1 FROM fu WHERE fallbacks >= 3 AND (mean_segmented < 3 OR insufficient_share > 0.3) UNION ALL SELECT 'funnel', 'warning', 'pipeline_loses_data_before_scoring', 1 FROM fu WHERE results > 0 AND result_share < 0.2 UNION ALL SELECT 'funnel', 'info', 'insufficient_segment_data_events', 1 FROM fu WHERE insufficient > 0
  UNION ALL SELECT 'legal', 'warning', 'legal_low_with_low_confidence', count(*) FROM opp WHERE legal_risk_level = 'Bajo' AND confidence_score * 100 < 60 HAVING count(*) > 0 UNION ALL SELECT 'legal', 'warning', 'legal_low_with_few_comparables', count(*) FROM opp WHERE legal_risk_level = 'Bajo' AND comparable_count < 3 HAVING count(*) > 0 UNION ALL SELECT 'legal', 'info', 'legal_high_despite_strong_data', count(*) FROM opp WHERE legal_risk_level = 'Alto' AND comparable_count >= 8 AND confidence_score * 100 >= 80 HAVING count(*) > 0
  {" ".join(f"UNION ALL SELECT 'consistency', '{severity}', '{code}', count(*) FROM opp WHERE {rule} HAVING count(*) > 0" for code, (severity, rule) in _RULES.items())}),
{_WEIGHED.format(more=" UNION SELECT 'high', 'median_error_over_30' FROM bn WHERE med > 30 UNION SELECT 'high', 'average_error_over_30' FROM bn WHERE mean > 30")}"""
_PLAIN_TITLE = "upper(comuna[1]) || lower(comuna[2:])"
ORACLES = {
    "a8_percentiles": _sql(f"SELECT comuna, " + ", ".join(f"round(quantile_cont(({ASK}) / m2_construidos, {p}), 2) AS p{int(100 * p)}" for p in (0.25, 0.5, 0.9)) + " FROM listings WHERE m2_construidos IS NOT NULL GROUP BY comuna"),
    "t1_best_comparables": _sql("SELECT t_id AS id, c_id, round(score, 6) AS score FROM s QUALIFY row_number() OVER (PARTITION BY t_id ORDER BY score DESC, c_id) <= 10", f"{oracles.BASE}, {oracles.PAIRS.format(targets=chr(39).join(['status = ', 'active', '']))}, p1 AS (SELECT * FROM pairs WHERE same_segment AND usable), {oracles.SCORED.format(source='p1')}"),
    "p7_distance_penalties": _sql("SELECT id, round(CASE WHEN km IS NULL THEN 1 ELSE exp(-km / 2) * CASE WHEN km > 5 THEN 0.5 ELSE 1 END END, 6) AS penalty FROM (SELECT id, abs(lat + 33.45) * 111 AS km FROM listings)"),
    "p8_confidence_labels": "SELECT id, CASE WHEN s >= 0.75 AND n >= 8 THEN 'high' WHEN s >= 0.5 AND n >= 5 THEN 'medium' ELSE 'low' END AS label, CASE WHEN s >= 0.75 AND n >= 8 THEN 'medium' ELSE 'low' END AS lower, CASE WHEN n < 3 OR s * 100 >= 40 THEN 'low' WHEN n <= 5 THEN 'medium' WHEN s * 100 <= 20 THEN 'high' ELSE 'medium' END AS by_count, CASE WHEN s >= 0.85 THEN 'Alta' WHEN s >= 0.65 THEN 'Media' ELSE 'Baja' END AS band, CASE WHEN s * 100 > 75 THEN 'Alta confianza' WHEN s * 100 >= 50 THEN 'Confianza media' ELSE 'Baja confianza' END AS title, CASE WHEN s > 0.3 THEN 'Posible anomalía' WHEN s >= 0.2 THEN 'Descuento relevante' ELSE 'Descuento moderado' END AS badge FROM (SELECT p_partkey AS id, p_partkey % 101 / 100.0::DOUBLE AS s, p_size % 12 AS n FROM part)",
    "p10_opportunities": _sql("SELECT id, round(listing_price, 4) AS listing_price, round(undervaluation, 4) AS undervaluation, is_outlier, round(missing_fields_pct, 4) AS missing_fields_pct, round(missing_data_penalty, 4) AS missing_data_penalty, confidence_level, round(opportunity_score, 4) AS opportunity_score, investment_score, verdict, CASE WHEN investment_score >= 75 THEN '🟢 Alta oportunidad' WHEN investment_score >= 55 THEN '🟡 Revisar' ELSE '🔴 Riesgoso' END AS label, round(roi::DOUBLE, 4) AS roi, round(ranking, 4) AS ranking, round(price_drop_pct, 4) AS price_drop_pct, time_on_market_days, round(comparables_mean, 4) AS comparables_mean, round(comparables_min, 4) AS comparables_min, round(comparables_max, 4) AS comparables_max FROM opp", OPP),
    "p14_score_breakdowns": _sql("SELECT id, investment_score AS total, round(bd * 100, 4) AS discount, round(bc * 100, 4) AS confidence, round(bn * 100, 4) AS comparables, round(br * 100, 4) AS risk, bp AS missing_data_penalty FROM opp", OPP),
    "p16_legal_profiles": _sql("SELECT id, legal_risk_score, legal_risk_level, array_to_string(flags, '|') AS flags, CASE legal_risk_level WHEN 'Bajo' THEN 'No se detectan riesgos estructurales. Basado en ' || comparable_count || ' comparables con buena consistencia de datos.' WHEN 'Medio' THEN 'Información parcial (' || comparable_count || ' comparables). Se recomienda validación adicional antes de invertir.' ELSE 'Alta incertidumbre: solo ' || comparable_count || ' comparables y datos incompletos. Validar exhaustivamente.' END AS legal_summary FROM opp", OPP),
    "p18_texts": _sql("SELECT id, '% bajo valor estimado; ' || comparable_count || ' comparables; confianza %' || CASE WHEN price_drop_pct >= 0.03 THEN '; baja de precio %' ELSE '' END || '; ' || time_on_market_days || ' dias en mercado' || CASE WHEN missing_data_penalty > 0 THEN '; penalizacion por datos faltantes %' ELSE '' END AS reason, 'Esta propiedad esta un % bajo el valor estimado. Se comparo con ' || comparable_count || ' propiedades similares en ' || comuna || ' con precios entre ' || CAST(round_even(comparables_min / 1e6, 0) AS BIGINT) || 'M y ' || CAST(round_even(comparables_max / 1e6, 0) AS BIGINT) || 'M. Tiene confianza ' || CASE confidence_level WHEN 'low' THEN 'baja' WHEN 'medium' THEN 'media' ELSE 'alta' END || ' debido a ' || CASE WHEN missing_fields_pct >= 40 THEN 'varios datos faltantes' WHEN comparable_count <= 5 THEN 'un numero acotado de comparables' ELSE 'buena cobertura de datos y comparables' END || '.' AS explanation FROM opp", OPP),
    "t2_ranking": _sql("SELECT id, is_outlier, round(ranking, 6) AS ranking FROM opp ORDER BY is_outlier, ranking DESC, id LIMIT 20", OPP),
    "t6_first_comparables": _sql("SELECT id, CAST(r - 1 AS INT) AS place, round(price, 4) AS price, round(cm, 4) AS m2, round((price - listing_price) / listing_price * 100, 4) AS difference_pct FROM (SELECT opp.id, x4.price, x4.cm, opp.listing_price, row_number() OVER (PARTITION BY opp.id ORDER BY x4.score DESC, x4.c_id) AS r FROM opp JOIN x4 ON x4.t_id = opp.id) WHERE r <= 3", OPP),
    "p19_risk_contexts": _sql("SELECT id, CASE WHEN undervaluation >= 0.15 AND confidence_score >= 0.65 AND comparable_count >= 5 THEN 'Activo subvalorado con buen respaldo de mercado.' WHEN legal_risk_level = 'Alto' OR missing_fields_pct > 30 OR confidence_score < 0.55 THEN 'Oportunidad con incertidumbre relevante.' WHEN undervaluation >= 0.10 THEN 'Descuento atractivo, sujeto a validación de datos y antecedentes.' ELSE 'Oportunidad defensiva: requiere comparar contra alternativas cercanas.' END AS thesis, round(least(undervaluation / 0.30::DOUBLE, 1) * 100, 4) AS valuation_score, round(least(comparable_count / 10, 1) * 50 + confidence_score * 50, 4) AS market_support_score, round(greatest(0, 100 - legal_risk_score * 0.5::DOUBLE - least(missing_fields_pct, 50)), 4) AS risk_score, array_to_string(flags || more_flags, '|') AS flags, array_to_string(list_filter([CASE WHEN undervaluation > 0.15 THEN 'Descuento superior a 15% frente al valor estimado.' END, CASE WHEN comparable_count >= 5 THEN 'Base comparable suficiente para una revisión inicial.' END, CASE WHEN confidence_score >= 0.65 THEN 'Buena confianza relativa del modelo.' END, CASE WHEN legal_risk_level = 'Bajo' THEN 'Legal risk preliminar bajo.' END], lambda x: x IS NOT NULL), '|') AS catalysts FROM opp", OPP),
    "p21_decisions": _sql("SELECT id, decision, CASE decision WHEN 'Comprar' THEN 'Comprar con validacion' WHEN 'Revisar' THEN 'Esperar' ELSE 'Evitar' END AS strategy, CASE decision WHEN 'Comprar' THEN CASE WHEN confidence_score < 0.85 THEN 'Balanceado' ELSE 'Conservador' END WHEN 'Revisar' THEN 'Balanceado' ELSE 'Agresivo' END AS profile, CASE WHEN investment_score >= 75 AND confidence_score >= 0.75 THEN 'Low Risk' WHEN investment_score >= 60 AND confidence_score >= 0.55 THEN 'Medium Risk' ELSE 'High Risk' END AS risk, CASE WHEN investment_score >= 75 THEN 'Comprar' WHEN investment_score >= 55 THEN 'Revisar' ELSE 'Evitar' END AS verdict, CASE WHEN undervaluation > 0.25 AND confidence_score > 0.6 THEN 'Buena inversion' WHEN undervaluation > 0.15 THEN 'Interesante pero revisar' ELSE 'Baja oportunidad' END AS recommendation FROM (SELECT *, CASE WHEN confidence_score < 0.5 THEN CASE WHEN investment_score >= 75 THEN 'Revisar' ELSE 'Evitar' END WHEN investment_score >= 75 AND confidence_score * 100 >= 75 THEN CASE WHEN is_outlier OR comparable_count < 5 OR missing_fields_pct >= 20 THEN 'Revisar' ELSE 'Comprar' END WHEN investment_score >= 60 THEN 'Revisar' ELSE 'Evitar' END AS decision FROM opp)", OPP),
    "p22_investment_metrics": _sql("SELECT id, round(listing_price / 300, 4) AS rent_monthly, 4.0 AS yield_pct, round(roi::DOUBLE, 4) AS appreciation, round(CASE WHEN id % 2 = 0 THEN roi + 1 ELSE 4 + roi END::DOUBLE, 4) AS roi, array_to_string(list_filter([CASE WHEN undervaluation > 0.25 THEN 'Descuento alto vs mercado' WHEN undervaluation > 0.15 THEN 'Descuento moderado' END, CASE WHEN confidence_score > 0.75 THEN 'Alta confianza' WHEN confidence_score > 0.5 THEN 'Confianza media -> validar' ELSE 'Baja confianza' END, CASE WHEN comparable_count >= 8 THEN 'Comparables suficientes' ELSE 'Pocos comparables' END, CASE WHEN is_outlier THEN 'Posible anomalia en precio' END], lambda x: x IS NOT NULL), '|') AS bullets FROM opp", OPP),
    "p24_data_bands": _sql("SELECT id, CASE WHEN missing_fields_pct <= 15 THEN 'Alta' WHEN missing_fields_pct <= 30 THEN 'Media' ELSE 'Baja' END AS data_consistency, CASE WHEN comparable_count >= 6 THEN 'Amplia' WHEN comparable_count >= 3 THEN 'Parcial' ELSE 'Limitada' END AS comparable_coverage, CASE WHEN confidence_score * 100 >= 75 THEN 'Alta' WHEN confidence_score * 100 >= 60 THEN 'Media' ELSE 'Baja' END AS model_confidence FROM opp", OPP),
    "p25_investment_cases": _sql("SELECT id, CASE WHEN undervaluation >= 0.25 AND confidence_score >= 0.65 AND comparable_count >= 5 THEN 'Descuento atractivo con soporte comparable suficiente.' WHEN undervaluation >= 0.15 AND comparable_count >= 5 THEN 'Precio bajo mercado con evidencia moderada.' WHEN comparable_count < 5 THEN 'Senal preliminar con base comparable limitada.' ELSE 'Oportunidad acotada; priorizar validacion antes de avanzar.' END AS thesis, CASE WHEN undervaluation >= 0.25 THEN 'Propiedad bajo mercado con descuento relevante.' WHEN undervaluation >= 0.15 THEN 'Descuento moderado frente al rango comparable.' ELSE 'Brecha de precio acotada frente al mercado.' END || ' ' || CASE WHEN comparable_count >= 8 THEN 'Soporte comparable suficiente para una primera lectura.' WHEN comparable_count >= 5 THEN 'Soporte moderado de comparables.' ELSE 'Base comparable limitada; requiere validacion.' END || ' ' || CASE WHEN missing_fields_pct > 0 THEN 'Existen datos incompletos que elevan el riesgo.' WHEN confidence_score < 0.55 THEN 'La confianza es baja y conviene revisar manualmente.' ELSE 'Senal interpretable para priorizacion inicial.' END AS narrative, CASE WHEN len(risks) = 0 THEN 'Riesgo operativo acotado con los datos disponibles.' ELSE 'Riesgo: ' || array_to_string(risks, ' | ') END AS risk_line, CASE WHEN undervaluation >= 0.15 THEN 'Precio bajo mercado' ELSE 'Precio cercano al rango de mercado' END || '|' || CASE WHEN confidence_score >= 0.65 THEN 'Consistencia AVM favorable' ELSE 'Consistencia AVM por validar' END AS valuation, CAST(greatest(1, CAST(comparable_count < 5 AS INT) + CAST(coalesce(dispersion > 0.30, false) AS INT) + CAST(missing_fields_pct > 0 AS INT) + CAST(is_outlier AS INT)) AS INT) AS n_factors, array_to_string(list_filter([CASE WHEN is_outlier THEN 'Outlier: posible anomalia de precio' END, CASE WHEN confidence_score < 0.55 THEN 'Baja confianza' END, gap, CASE WHEN comparable_count < 5 THEN 'Pocos comparables' END], lambda x: x IS NOT NULL), '|') AS flags FROM (SELECT *, list_filter([gap, CASE WHEN comparable_count < 5 THEN 'Pocos comparables' END, CASE WHEN is_outlier THEN 'Outlier de descuento' END], lambda x: x IS NOT NULL) AS risks FROM (SELECT *, CASE WHEN missing_fields_pct > 0 THEN 'Datos faltantes: ' || CAST(round_even(missing_fields_pct, 0) AS BIGINT) || '%' END AS gap FROM opp))", OPP),
    "p26_negotiations": _sql("SELECT id, CASE WHEN days > 25 AND ch >= 2 THEN 'Flexible' WHEN days > 10 THEN 'Neutral' ELSE 'Rigid' END AS seller_profile, round(sc, 4) AS score, st AS strategy, sure AS confidence, CASE WHEN st = 'Aggressive' AND sure <> 'Low' THEN 'aggressive_offer' WHEN st = 'Moderate' THEN 'moderate_offer' WHEN st = 'Wait' THEN 'wait_for_evidence' ELSE 'validate_by_hand' END AS tactic, missing_fields_pct > 50 AS warning FROM (SELECT *, CASE WHEN sc >= 70 THEN 'Aggressive' WHEN sc >= 40 THEN 'Moderate' ELSE 'Wait' END AS st, CASE WHEN missing_fields_pct > 50 OR comparable_count < 4 OR confidence_score < 0.5 THEN 'Low' WHEN missing_fields_pct > 25 OR comparable_count < 7 OR confidence_score < 0.75 THEN 'Medium' ELSE 'High' END AS sure FROM (SELECT opp.*, e.days_on_market AS days, e.price_changes AS ch, least(least(e.days_on_market * 1.5::DOUBLE, 40) + e.price_changes * 15 + least(coalesce(e.price_drop_from_peak_pct, 0) * 100, 30), 100) AS sc FROM opp JOIN evo e ON e.id = opp.id))", f"{OPP}, {EVO}"),
    "p27_report_metrics": _sql(f"SELECT id, round(listing_price / m2_construidos, 4) AS price_m2, round(mk, 4) AS market_price_m2, round(dl, 4) AS delta, CASE WHEN dl IS NULL THEN 'amber' WHEN dl < 0 THEN 'green' WHEN dl <= 0.05 THEN 'amber' ELSE 'red' END AS delta_status, {_THIRD.format(a='undervaluation > 0.15', b='undervaluation >= 0.05')} AS discount_status, {_THIRD.format(a='comparable_count >= 8', b='comparable_count >= 4')} AS comparables_status, {_THIRD.format(a='confidence_score >= 0.75', b='confidence_score >= 0.5')} AS confidence_status, CASE WHEN missing_fields_pct > 40 THEN 'miss' WHEN missing_fields_pct >= 20 THEN 'caution' ELSE 'beat' END AS missing_status, CASE WHEN missing_fields_pct > 50 THEN 'Low Reliability' WHEN missing_fields_pct > 25 THEN 'Medium Reliability' ELSE 'High Reliability' END AS reliability, CASE WHEN investment_score >= 75 THEN 'Strong Signal' WHEN investment_score >= 55 THEN 'Needs Review' ELSE 'High Risk' END AS signal, array_to_string(list_filter(flags || more_flags, lambda x: x NOT IN ('Buena base de comparables y alta confiabilidad')), '|') AS flags, array_to_string(list_filter([CASE WHEN comparable_count >= 8 THEN 'Base sólida de comparables' END, CASE WHEN confidence_score >= 0.8 THEN 'Alta confianza del modelo' END, CASE WHEN undervaluation >= 0.15 THEN 'Descuento significativo' END], lambda x: x IS NOT NULL), '|') AS strengths FROM (SELECT *, listing_price / m2_construidos / mk - 1 AS dl FROM (SELECT *, CASE WHEN comparables_mean / m2_construidos <= 10000000 THEN comparables_mean / m2_construidos END AS mk FROM opp))", OPP),
    "p29_price_insights": _sql("SELECT id, array_to_string(list_filter([CASE WHEN days_on_market < 7 THEN 'Propiedad recien publicada' END, CASE WHEN days_on_market > 60 THEN 'Tiempo en mercado elevado' END, CASE WHEN price_changes >= 2 THEN 'El vendedor ha ajustado el precio multiples veces' END, CASE WHEN price_drop_from_peak_pct > 0.1 THEN 'Reduccion significativa desde el precio inicial' END, CASE WHEN trend = 'down' THEN 'Tendencia bajista reciente' END], lambda x: x IS NOT NULL)[1:2], '|') AS insights FROM evo", EVO),
    "p36_negotiation_signals": _sql("SELECT id, CAST(len(sg) AS INT) AS n, sg[1] AS first FROM (SELECT id, list_filter([CASE WHEN days_on_market <> 0 THEN days_on_market || ' días en mercado' END, CASE WHEN price_changes <> 0 THEN price_changes || ' cambios de precio' END, CASE WHEN price_drop_from_peak_pct <> 0 THEN CAST(round_even(price_drop_from_peak_pct * 100, 0) AS BIGINT) || '% caída desde peak' END], lambda x: x IS NOT NULL) AS sg FROM evo)", EVO),
    "w4_price_evolution": _sql("SELECT id, round(current_price, 6) AS current_price, round(all_time_high, 6) AS all_time_high, round(all_time_low, 6) AS all_time_low, round(price_drop_from_peak_pct, 6) AS price_drop_from_peak_pct, round(price_range_pct, 6) AS price_range_pct, price_changes, last_price_change_days, trend, days_on_market FROM evo", EVO),
    "p30_positions": "SELECT id, CASE WHEN now < saved OR coalesce(b > a, false) THEN 'Improving' WHEN now = saved AND coalesce(b = a, true) THEN 'Stable' ELSE 'Deteriorating' END AS status, CASE WHEN dl <= -5 THEN 'BUY' WHEN dl <= -3 THEN 'WATCH' ELSE 'HOLD' END AS action, CASE WHEN id % 5 = 0 THEN 'En mercado' WHEN now / saved - 1 < -0.08 THEN 'Bajo mercado' WHEN now / saved - 1 > 0.08 THEN 'Sobre mercado' ELSE 'En mercado' END AS market FROM (SELECT *, round((now - saved) / saved * 100, 6) AS dl FROM (SELECT o_orderkey AS id, o_totalprice * (1 + (o_custkey % 9 - 4) / 50) AS now, o_totalprice AS saved, CAST(o_custkey % 100 AS DOUBLE) AS a, CASE WHEN o_custkey % 7 > 0 THEN CAST(o_orderkey % 100 AS DOUBLE) END AS b FROM orders))",
    "p35_details": _sql("SELECT id, investment_score AS score, round(undervaluation, 4) AS discount, 4.0 AS yield_pct, CAST(least(comparable_count, 3) AS INT) AS n, round((SELECT arg_max(price / cm, ROW(score, -c_id)) FROM x4 WHERE x4.t_id = opp.id), 4) AS first_price_m2 FROM opp", OPP),
    "p38_radar_table": _sql("SELECT id, comuna, round(m2_construidos, 4) AS m2, round(listing_price, 4) AS listing_price, round(estimated_price, 4) AS estimated_value, investment_score, round(confidence_score * 100, 4) AS confidence_pct, comparable_count, legal_risk_level AS legal_level FROM opp", OPP),
    "p39_scaled_prices": _sql(f"SELECT id, round(CASE WHEN hi > lo THEN (p - lo) / (hi - lo) ELSE 0.5 END, 6) AS position FROM (SELECT id, {ASK} AS p, min({ASK}) OVER (PARTITION BY comuna) AS lo, max({ASK}) OVER (PARTITION BY comuna) AS hi FROM listings)"),
    "p39_histogram": _sql(f"SELECT CAST(least(floor(x * 2) + 1, 25) AS BIGINT) AS bin, count(*) AS n FROM (SELECT ({ASK}) / m2_construidos / 1e6 AS x FROM listings WHERE m2_construidos IS NOT NULL) WHERE x IS NOT NULL GROUP BY 1"),
    "p39_points": _sql("SELECT 'risk_return' AS chart, id, round(coalesce(roi, 0), 4) AS x, round(coalesce(confidence_score, 0) * 100, 4) AS y, greatest(coalesce(investment_score, 0) / 2, 8.0) AS size FROM opp UNION ALL SELECT 'discount_comparables', id, round(coalesce(undervaluation, 0) * 100, 4), CAST(comparable_count AS DOUBLE), greatest(coalesce(investment_score, 0) / 2, 8.0) FROM opp", OPP),
    "c39_texts": _sql(f"SELECT id, coalesce('$' || replace(format('{{:,}}', CAST(round_even({ASK}, 0) AS BIGINT)), ',', '.'), 'Sin precio') AS price, concat_ws(' | ', coalesce(nullif(comuna, ''), 'Sin comuna'), CAST(nullif(m2_construidos, 0) AS VARCHAR) || ' m2', CAST(nullif(dormitorios, 0) AS VARCHAR) || 'D', CAST(nullif(banos, 0) AS VARCHAR) || 'B') AS summary FROM listings"),
    "a14_market_context": _sql("SELECT id, round(comparables_mean, 2) AS comparables_mean, round(comparables_min, 2) AS comparables_min, round(comparables_max, 2) AS comparables_max FROM opp", OPP),
    "a22_legal_audit": _sql("SELECT count(*) AS checked, CAST(0 AS BIGINT) AS missing_profile, CAST(0 AS BIGINT) AS invalid_scores, min(legal_risk_score) AS least, max(legal_risk_score) AS most, round(avg(legal_risk_score), 4) AS mean, round(quantile_cont(legal_risk_score::DOUBLE, 0.5), 4) AS median, count(*) FILTER (legal_risk_score >= 70) AS high_risk FROM opp", OPP),
    "a22_legal_levels": _sql("SELECT 'level ' || legal_risk_level AS what, count(*) AS n FROM opp GROUP BY 1 UNION ALL SELECT 'flag ' || x, count(*) FROM (SELECT unnest(flags) AS x FROM opp) GROUP BY 1 UNION ALL SELECT w, n FROM (SELECT 'legal_low_with_low_confidence' AS w, count(*) AS n FROM opp WHERE legal_risk_level = 'Bajo' AND confidence_score * 100 < 60 UNION ALL SELECT 'legal_low_with_few_comparables', count(*) FROM opp WHERE legal_risk_level = 'Bajo' AND comparable_count < 3 UNION ALL SELECT 'legal_high_despite_strong_data', count(*) FROM opp WHERE legal_risk_level = 'Alto' AND comparable_count >= 8 AND confidence_score * 100 >= 80) WHERE n > 0", OPP),
    "a23_radar_audit": _sql("SELECT count(*) AS opportunities, count(*) FILTER (is_outlier) AS outliers, round(avg(investment_score), 4) AS mean_score, round(avg(undervaluation * 100), 4) AS mean_discount_pct FROM opp", OPP),
    "a24_dashboard": _sql("SELECT *, CASE WHEN score >= 75 AND outlier_share < 0.20 THEN 'Mercado ineficiente con senales de alta calidad' WHEN score >= 55 THEN 'Mercado moderadamente ineficiente - oportunidades selectivas' WHEN score >= 35 THEN 'Mercado con senales mixtas - revisar riesgo' ELSE 'Mercado poco concluyente - priorizar validacion' END AS interpretation FROM (SELECT n, round(d, 6) AS mean_discount, round(c, 6) AS mean_confidence, round(o, 6) AS outlier_share, round(l, 6) AS low_confidence_share, round(p, 6) AS mean_price_m2, round(s, 6) AS dispersion, round(greatest(least(c * 70 + least(d / 0.30::DOUBLE, 1) * 30 - o * 25, 100), 0), 6) AS score FROM (SELECT count(*) AS n, avg(undervaluation) AS d, avg(confidence_score) AS c, avg(CAST(is_outlier AS INT)) AS o, avg(CAST(confidence_level = 'low' AS INT)) AS l, avg(estimated_price / m2_construidos) AS p, avg(dispersion) AS s FROM opp))", OPP),
    "a25_portfolio_header": _sql("SELECT count(*) AS saved, count(*) FILTER (action = 'BUY') AS opportunities, count(*) FILTER (action = 'WATCH') AS watching, count(*) FILTER (action = 'HOLD') AS neutral, round(avg(delta_pct), 4) AS mean_change, count(*) FILTER (score_actual >= 70) AS strong_signals FROM po", _POS),
    "t7_movers": _sql("SELECT arg_min(listing_id, ROW(delta_pct, listing_id)) AS best, arg_max(listing_id, ROW(delta_pct, listing_id)) AS worst, arg_max(listing_id, ROW(coalesce(score_actual - score_saved, -1e9), listing_id)) AS most_improved FROM po", _POS),
    "e14_positions": _sql("SELECT listing_id, round(precio_guardado, 4) AS precio_guardado, round(precio_actual, 4) AS precio_actual, round(delta_pct, 4) AS delta_pct, score_actual, status, action, round(price_drop_pct, 4) AS price_drop_pct FROM po", _POS),
    "a27_comparable_summaries": _sql("SELECT id, n, round(mean_price_m2, 3) AS mean_price_m2, round(mean_m2, 3) AS mean_m2, round(variation, 3) AS variation, round(mean_dormitorios, 3) AS mean_dormitorios, min_m2, max_m2, round(min_price, 3) AS min_price, round(max_price, 3) AS max_price, layout FROM summ", SUMMARY),
    "a34_factors": _sql("SELECT id, round(fa, 6) AS area, round(fl, 6) AS location, round(fr, 6) AS bedrooms, round(fg, 6) AS age, largest, 'La propiedad se encuentra en mercado según los comparables disponibles. Los factores que más influyen en esta estimación son ' || largest || '. La lectura combina precio por m², similitud y consistencia de mercado.' AS summary FROM (SELECT *, (SELECT string_agg(nm, ' y ' ORDER BY sz DESC, pl) FROM (SELECT * FROM (VALUES (abs(fa), 0, 'superficie'), (abs(fl), 1, 'ubicación'), (abs(fr), 2, 'dormitorios'), (abs(fg), 3, 'antigüedad')) v(sz, pl, nm) ORDER BY sz DESC, pl LIMIT 2)) AS largest FROM fct)", f"""{SUMMARY}, fct AS (SELECT l.id, {FLOAT.format(f"CASE WHEN s2.mean_m2 > 0 THEN {_LIMIT.format('(l.m2_construidos / s2.mean_m2 - 1) * 0.35')} ELSE 0 END")} AS fa, {FLOAT.format('CASE WHEN s2.n >= 5 THEN 0.08 WHEN s2.n > 0 THEN 0.03 ELSE -0.05 END')} AS fl, {FLOAT.format(f"CASE WHEN s2.mean_dormitorios > 0 AND l.dormitorios IS NOT NULL THEN {_LIMIT.format('(l.dormitorios - s2.mean_dormitorios) * 0.03')} ELSE 0 END")} AS fr,
  {FLOAT.format('CASE WHEN l.id % 4 = 0 THEN 0 WHEN 2001 - (1960 + l.id % 42) <= 5 THEN 0.06 WHEN 2001 - (1960 + l.id % 42) <= 15 THEN 0.02 WHEN 2001 - (1960 + l.id % 42) <= 30 THEN -0.03 ELSE -0.08 END')} AS fg FROM listings l LEFT JOIN summ s2 ON s2.id = l.id WHERE l.status = 'active' AND l.comuna IS NOT NULL AND l.m2_construidos > 0 AND (l.precio_clp IS NOT NULL OR l.precio_uf IS NOT NULL))"""),
    "t9_comparable_tables": _sql("SELECT t_id AS id, CAST(r AS INT) AS place, c_id, round(price, 3) AS price, cm AS m2, round(price_m2, 3) AS price_m2, round(score, 3) AS score, t_comuna AS comuna FROM (SELECT *, row_number() OVER (PARTITION BY t_id ORDER BY score DESC, c_id) AS r FROM cq) WHERE r <= 5", SUMMARY),
    "p33_radar_results": _sql("SELECT CASE WHEN t > 0 THEN 'ok' ELSE 'insufficient_data' END AS status, t AS total_count, r AS ready_count, r < 10 AS low_data_mode, CASE WHEN t = 0 THEN 'No hay suficientes datos u oportunidades disponibles para el radar.' END AS message FROM (SELECT (SELECT least(count(*), 20) FROM opp) AS t, (SELECT count(*) FROM listings WHERE status = 'active' AND comuna IS NOT NULL AND m2_construidos > 0 AND (precio_clp IS NOT NULL OR precio_uf IS NOT NULL)) AS r)", OPP),
    "p33_contracts": "SELECT status, false AS low_data_mode, status <> 'insufficient_data' AS silent, count(*) AS n, CAST(sum(total) AS BIGINT) AS total, CAST(sum(ready) AS BIGINT) AS ready FROM (SELECT CASE WHEN p_partkey % 3 = 0 THEN 'ok' WHEN p_partkey % 2 = 0 AND p_size > 0 THEN 'ok' ELSE 'insufficient_data' END AS status, CASE WHEN p_partkey % 2 = 0 THEN p_size ELSE 0 END AS total, CASE WHEN p_partkey % 5 > 0 THEN p_size ELSE 0 END AS ready FROM part) GROUP BY 1, 3",
    "a30_funnel": _sql("SELECT targets, round(mean_before, 6) AS mean_before, round(mean_segmented, 6) AS mean_segmented, none_left, under_three, many_lost, fallbacks, insufficient, results, round(none_left / targets, 6) AS none_left_share, round(insufficient / targets, 6) AS insufficient_share, round(results / targets, 6) AS result_share FROM fu", _FUNNEL),
    "t5_split": _sql("SELECT id, held AS held_out FROM sp", HELD),
    "e7_predictions": _sql("SELECT id, comuna, size_bucket, m2_range, round(actual_price, 3) AS actual_price, round(estimated_price, 3) AS estimated_price, comparable_count, round(confidence_score, 3) AS confidence_score, round(absolute_error, 3) AS absolute_error, round(percentage_error, 3) AS percentage_error, skipped FROM pred", HELD),
    "a15_errors": _sql(f"SELECT grouping, value, n, round(mae, 3) AS mae, round(mape, 3) AS mape, round(median_ae, 3) AS median_ae, round(median_pe, 3) AS median_pe, round(mean_comparables, 3) AS mean_comparables, round(median_comparables, 3) AS median_comparables FROM ({_metrics('pred', 'comuna', 'size_bucket')})", HELD),
    "a16_outcomes": _sql("SELECT coalesce(skipped, 'evaluated') AS outcome, count(*) AS n FROM pred GROUP BY 1", HELD),
    "a18_best_and_worst": _sql(f"SELECT grouping, arg_min(value, ROW(median_pe, mape, value)) AS best, arg_max(value, ROW(median_pe, mape, value)) AS worst FROM ({_metrics('pred', 'comuna', 'size_bucket')}) WHERE grouping <> 'all' GROUP BY grouping", HELD),
    "a19_repeated_runs": _sql("SELECT count(*) AS runs, round(avg(mape), 6) AS mean, arg_min(run, mape) AS best_run, arg_max(run, mape) AS worst_run, round(stddev_samp(mape), 6) AS deviation FROM (SELECT id % 5 AS run, avg(percentage_error) AS mape FROM pred WHERE skipped IS NULL GROUP BY 1)", HELD),
    "e8_repeated_runs": _sql("SELECT run, round(mape, 5) AS mape, round(median_pe, 5) AS median_pe, evaluated, skipped FROM re", REPEATED),
    "a19_benchmark_runs": _sql(" UNION ALL ".join(f"SELECT count(*) AS runs, round(avg({m}), 5) AS mean, arg_min(run, {m}) AS best_run, arg_max(run, {m}) AS worst_run, round(stddev_samp({m}), 5) AS deviation, '{m}' AS metric FROM re" for m in ("mape", "median_pe")), REPEATED),
    "t3_extremes": _sql("SELECT * FROM (SELECT id, comuna, round(percentage_error, 6) AS percentage_error, 'worst' AS kind FROM pred WHERE skipped IS NULL ORDER BY pred.percentage_error DESC, id LIMIT 10) UNION ALL SELECT * FROM (SELECT id, comuna, round(percentage_error, 6), 'best' FROM pred WHERE skipped IS NULL ORDER BY pred.percentage_error, id LIMIT 10)", HELD),
    "e8_errors": _sql("SELECT id, comuna, m2_range, round(actual_price, 3) AS actual_price, round(estimated_price, 3) AS estimated_price, comparable_count, round(absolute_error, 3) AS absolute_error, round(percentage_error, 3) AS percentage_error, skipped FROM bm", BENCH),
    "a17_benchmark": _sql(f"SELECT grouping, value, n, round(mape, 5) AS mape, round(median_pe, 5) AS median_pe FROM ({_metrics('bm', 'comuna', 'm2_range')})", BENCH),
    "e6_best_within_budget": _sql("SELECT id, round(listing_price, 4) AS listing_price, round(undervaluation, 4) AS undervaluation, investment_score FROM opp WHERE listing_price <= 250000000 ORDER BY is_outlier, ranking DESC, id LIMIT 3", OPP),
    "p32_contradictions": _sql(" UNION ALL ".join(f"SELECT id, '{severity}' AS severity, '{code}' AS code FROM opp WHERE {rule}" for code, (severity, rule) in _RULES.items()), OPP),
    "a21_stopped_runs": _sql("SELECT run, CAST(sum(raw_rows) AS BIGINT) AS raw_rows, CAST(sum(valid_rows) AS BIGINT) AS valid_rows, CAST(sum(ins) AS BIGINT) AS inserted, CAST(sum(valid_rows - ins) AS BIGINT) AS updated, sum(valid_rows) = 0 OR sum(valid_rows - ins) > 0.8 * sum(valid_rows) AS stop_early FROM (SELECT *, greatest(valid_rows - CAST(floor(valid_rows * (raw_rows % 11) / 10) AS BIGINT), 0) AS ins FROM runs) GROUP BY run"),
    "e5_opportunities": _sql("SELECT opp.id, investment_score, verdict, CASE WHEN confidence_score < 0.5 THEN CASE WHEN investment_score >= 75 THEN 'Revisar' ELSE 'Evitar' END WHEN investment_score >= 75 AND confidence_score * 100 >= 75 THEN CASE WHEN is_outlier OR comparable_count < 5 OR missing_fields_pct >= 20 THEN 'Revisar' ELSE 'Comprar' END WHEN investment_score >= 60 THEN 'Revisar' ELSE 'Evitar' END AS decision, CASE WHEN sc >= 70 THEN 'Aggressive' WHEN sc >= 40 THEN 'Moderate' ELSE 'Wait' END AS strategy, CASE WHEN days > 25 AND ch >= 2 THEN 'Flexible' WHEN days > 10 THEN 'Neutral' ELSE 'Rigid' END AS seller_profile, sc AS negotiation_score, legal_risk_level, CAST(round_even(listing_price / 1e6, 0) AS BIGINT) || 'M' AS price_text, CASE WHEN undervaluation > 0.25 AND confidence_score > 0.6 THEN 'Buena inversion' WHEN undervaluation > 0.15 THEN 'Interesante pero revisar' ELSE 'Baja oportunidad' END AS recommendation FROM (SELECT opp.*, e.days_on_market AS days, e.price_changes AS ch, least(least(e.days_on_market * 1.5::DOUBLE, 40) + e.price_changes * 15 + least(coalesce(e.price_drop_from_peak_pct, 0) * 100, 30), 100) AS sc FROM opp JOIN evo e ON e.id = opp.id) opp", f"{OPP}, {EVO}"),
    "e10_product_audit": _sql("SELECT id, CASE WHEN len(critical) > 0 THEN 'high' WHEN len(warnings) > 0 THEN 'medium' ELSE 'low' END AS severity, array_to_string(warnings, ',') AS warnings, array_to_string(critical, ',') AS critical_issues FROM pau", AUDIT),
    "a32_audit_totals": _sql("SELECT count(*) AS audited, CAST(sum(len(warnings)) AS BIGINT) AS warnings, CAST(sum(len(critical)) AS BIGINT) AS critical_issues, count(*) FILTER (len(critical) > 0) AS high FROM pau", AUDIT),
    "a31_findings": _sql("SELECT (SELECT count(*) FROM fd WHERE severity = 'critical') AS critical_findings, (SELECT count(*) FROM fd WHERE severity = 'warning') AS warnings, (SELECT count(*) FROM fd) AS findings, critical, high, medium, low, score, system_status, general_status FROM hs", f"{oracles.BASE}, {_DB}, fd AS ({_DBF}), {_WEIGHED.format(more='')}"),
    "s15_written_findings": _sql("SELECT * FROM fd", f"{oracles.BASE}, {_DB}, fd AS ({_DBF})"),
    "e9_system_audit": _sql("SELECT section, severity, code, n FROM fd UNION ALL SELECT 'health', system_status, general_status, score FROM hs", _SYSTEM),
    "e3_valuations": _sql("SELECT id, CASE WHEN ok THEN 'market_comparable' ELSE 'insufficient_data' END AS valuation_status, round(CASE WHEN ok THEN price_m2 * m2 END, 2) AS estimated_price, round(CASE WHEN ok THEN price_m2 END, 2) AS price_m2, round(CASE WHEN ok THEN p25 * m2 END, 2) AS min_price, round(CASE WHEN ok THEN p75 * m2 END, 2) AS max_price, round(CASE WHEN ok THEN confidence_score ELSE 0 END, 2) AS confidence_score, CASE WHEN ok AND confidence_score >= 0.75 AND comparable_count >= 8 THEN 'high' WHEN ok AND confidence_score >= 0.5 AND comparable_count >= 5 THEN 'medium' ELSE 'low' END AS confidence, CAST(CASE WHEN ok THEN comparable_count ELSE 0 END AS INT) AS comparable_count, candidates, reason FROM (SELECT *, reason LIKE 'market%' AS ok FROM (SELECT l.id, x6.*, coalesce(cn.n, 0) AS candidates, CASE WHEN NOT coalesce(l.m2_construidos BETWEEN 10 AND 1000, false) THEN 'subject surface area is missing or outside valid range' WHEN coalesce(cn.n, 0) < 5 THEN 'not enough comparable candidates' WHEN coalesce(vn.n, 0) < 5 THEN 'not enough reliable comparables after scoring' WHEN x6.before < 5 THEN 'not enough reliable comparables after price filtering' ELSE 'market valuation based on reliable comparables' END AS reason FROM listings l LEFT JOIN x6 ON x6.t_id = l.id LEFT JOIN (SELECT t_id, count(*) AS n FROM k3 GROUP BY 1) cn ON cn.t_id = l.id LEFT JOIN (SELECT t_id, count(*) AS n FROM v1 GROUP BY 1) vn ON vn.t_id = l.id))", f"{oracles.BASE}, {oracles.PAIRS.format(targets='true')}, {VALUE}"),
    "a29_relaxed_estimates": _sql("SELECT id, round(avg(p) * any_value(tm), 2) AS estimate, count(*) AS comparables, same AS same_comuna FROM (SELECT *, row_number() OVER (PARTITION BY id, same ORDER BY abs(cm - tm), c_id) AS r FROM rp) WHERE r <= 50 AND (same OR id NOT IN (SELECT id FROM rp WHERE same)) GROUP BY id, same", f"{oracles.BASE}, rp0 AS (SELECT t.id, c.id AS c_id, t.m2_construidos AS tm, c.m2_construidos AS cm, c.comuna = t.comuna AS own, ({ASK.replace('precio', 'c.precio')}) / c.m2_construidos AS p FROM u t JOIN u c ON t.id <> c.id AND c.usable AND c.status = 'active' AND t.m2_construidos BETWEEN 10 AND 1000 AND c.m2_construidos BETWEEN 10 AND 1000 AND c.m2_construidos BETWEEN t.m2_construidos * 0.5 AND t.m2_construidos * 1.5 AND ({oracles.SEGMENT.format(m='t.m2_construidos')} = {oracles.SEGMENT.format(m='c.m2_construidos')} OR 'standard_apartment' IN ({oracles.SEGMENT.format(m='t.m2_construidos')}, {oracles.SEGMENT.format(m='c.m2_construidos')}))), rp AS (SELECT *, true AS same FROM rp0 WHERE own AND p IS NOT NULL UNION ALL SELECT *, false FROM rp0 WHERE p IS NOT NULL)"),
    "e1_cleaned_batch": _sql("SELECT id, comuna, clp AS precio_clp, round(uf, 4) AS precio_uf, m2 AS m2_construidos, d AS dormitorios, b AS banos, src AS m2_source FROM (SELECT *, count(x) OVER w AS n, quantile_cont(x, 0.25) OVER w AS q1, quantile_cont(x, 0.5) OVER w AS q2, quantile_cont(x, 0.75) OVER w AS q3 FROM cl WINDOW w AS (PARTITION BY comuna)) WHERE n < 4 OR coalesce(CASE WHEN q3 > q1 THEN x BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) ELSE x BETWEEN q2 * 0.5 AND q2 * 1.5 END, false)", f"cl AS (SELECT *, uf / m2 AS x FROM (SELECT id, {_PLAIN_TITLE} AS comuna, coalesce(precio_clp, CAST(trunc(precio_uf * 37000) AS BIGINT)) AS clp, coalesce(precio_uf, precio_clp / 37000.0) AS uf, coalesce(m2_construidos, CAST(regexp_extract(titulo, '([0-9]+) m2', 1) AS DOUBLE)) AS m2, coalesce(dormitorios, CAST(1 + id % 4 AS INT)) AS d, coalesce(banos, CAST(1 + id % 3 AS INT)) AS b, CASE WHEN m2_construidos IS NULL THEN 'text' ELSE 'field' END AS src FROM listings) WHERE uf > 0 AND m2 BETWEEN 10 AND 1000)"),
    "c4_locale_numbers": _sql("SELECT id, round(coalesce(CAST(precio_clp AS DOUBLE), round(precio_uf, 2)), 2) AS number, precio_clp AS clp, round(precio_uf, 2) AS uf FROM listings"),
    "c32_usable_pages": "SELECT page_id, length(trim(html)) >= 500 AND NOT regexp_matches(lower(regexp_replace(html, '(?s)<[^>]*>', ' ', 'g')), 'sin resultados|no se encontraron resultados|no encontramos resultados|error|err_internet_disconnected|site cannot be reached|no internet') AS usable, " + " OR ".join(f"contains(lower(url || ' ' || html), '{w}')" for w in ("captcha", "access denied", "acceso denegado", "bloqueado", "blocked", "robot", "verifica que eres humano", "verificar que eres humano", "soy nuevo", "ya tengo cuenta", "iniciar sesion", "iniciar sesión", "login", "registration", "err_internet_disconnected", "site cannot be reached")) + " AS blocked FROM pages",
}
ORACLES["c21_fingerprints"] = forms.ORACLES["c21_fingerprint_parts"]
