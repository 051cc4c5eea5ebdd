"""Single rules by hand-worked values, orders that decide against plain loops, and the entry without its training-data part."""

import datetime as dt
import os
import shutil
import subprocess
import sys
import unicodedata

import pytest
from pyspark.sql import functions as F

from predial.functions import extract, geo, text
from predial.operators import audit, dedup, history, ingest, radar, risk, validation
from predial.sources import pages, views
from predial.streaming.ingest import stream_upserts

from .test_listings import frame, listing

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_without_training_data_part(tmp_path):
    """With predial/llm, its tests and the pipeline's operators gone, the other queries are still there."""
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm"))
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert len(q) > 100 and set(o) <= set(q) and 'pipeline' not in q and not [n for n in q if n.startswith('op')]"
    env = {**os.environ, "PYTHONPATH": str(copy)}
    for gone in ((), ("corpus_pipeline.py",)):
        for name in gone:
            (copy / name).unlink()
        done = subprocess.run([sys.executable, "-c", code], cwd=copy, env=env, capture_output=True, text=True)
        assert done.returncode == 0, done.stderr


def of(spark, value, expression):
    return spark.createDataFrame([(value,)], "t string").select(expression(F.col("t")).alias("x")).first().x


@pytest.mark.parametrize("raw", ["a\u00a0 b\u00a0", "\u2003Ñuñoa\x1f x", "m² Ž ½ ﬁn ｆｕｌｌ", "ǅ é", "", None, "ΰ", "日本 ﷺ"])
def test_keys_follow_unicode(spark, raw):
    plain = None if raw is None else " ".join("".join(c for c in unicodedata.normalize("NFKD", " ".join(raw.split()).lower()) if not unicodedata.combining(c)).split())
    assert of(spark, raw, text.match_key) == plain
    assert of(spark, raw, text.clean_text) == (" ".join((raw or "").split()) or None)


@pytest.mark.parametrize("raw, key", [("Ã‘uÃ±oa", "nunoa"), ("Ñuñoa", "nunoa"), ("PeÃ±alolÃ©n", "penalolen"), (" MAIPÚ ", "maipu"), ("", ""), (None, "")])
def test_commune_keys(spark, raw, key):
    assert of(spark, raw, text.comuna_key) == key


@pytest.mark.parametrize("title, at", [("cerca metro", (-33.456, -70.613)), ("Plaza Egaña", (-33.454, -70.575)), ("nada", None)])
def test_places(spark, title, at):
    found = of(spark, title, geo.place_position)
    assert (found and tuple(found)) == at


@pytest.mark.parametrize("raw, rooms", [("9 dormitorios", (None, None, None)), ("6 dormitorios 6 baños", (6, None, None)), ("2D/2B", (2, 2, None)), ("dormitorios 3 baños 2 posibilidad de 1 estacionamiento", (3, None, 1))])
def test_believed_numbers(spark, raw, rooms):
    assert tuple(of(spark, raw, extract.rooms))[:3] == rooms


def test_unchanged_prices_are_not_logged(spark):
    log = spark.createDataFrame([(1, 1, 100, dt.date(2001, 1, 1)), (2, 1, 120, dt.date(2001, 1, 2))], "id long, listing_id long, precio_clp_nuevo long, fecha_captura date")
    day, later = dt.date(2001, 1, 2), dt.date(2001, 1, 9)
    rows = [(1, 120, None, 120, None, later, False), (1, 100, None, 120, None, day, False), (1, 120, None, 130, None, later, False), (2, None, None, None, None, later, False), (3, None, None, 50, None, later, True), (4, None, 9.0, 50, None, later, False)]
    new = spark.createDataFrame(rows, "listing_id long, precio_clp_anterior long, precio_uf_anterior double, precio_clp_nuevo long, precio_uf_nuevo double, fecha_captura date, was_created boolean")
    assert sorted((r.listing_id, r.precio_clp_nuevo) for r in history.append_changes(log, new).collect()) == [(1, 130), (3, 50), (4, 50)]


def test_greedy_groups_by_a_plain_loop(spark):
    rows = [listing(i, m2_construidos=20.0 + (i * 7) % 60, dormitorios=1 + i % 4, banos=1 + i % 3, estacionamientos=None if i % 5 == 0 else i % 3, comuna=("Ñuñoa", "Macul")[i % 2]) for i in range(1, 120)]
    near = lambda a, b: abs(a["m2_construidos"] - b["m2_construidos"]) <= max(a["m2_construidos"], b["m2_construidos"]) * 0.1 and all(abs(a[c] - b[c]) <= 1 for c in ("dormitorios", "banos")) and (a["estacionamientos"] is None or b["estacionamientos"] is None or abs(a["estacionamientos"] - b["estacionamientos"]) <= 1)
    expected = {}
    for comuna in ("Ñuñoa", "Macul"):
        groups = []
        for r in sorted((r for r in rows if r["comuna"] == comuna), key=lambda r: (r["m2_construidos"], r["id"])):
            home = next((g for g in groups if any(near(r, x) for x in g)), None)
            if home is None:
                groups.append(home := [])
            home.append(r)
            expected[r["id"]] = home[0]["id"]
    assert {r.id: r.group for r in dedup.groups_greedy(frame(spark, rows)).collect()} == expected


def test_batch_rows_merge_into_the_first_kept(spark):
    rows = [listing(1, source_listing_id=None, url=None, lat=1.0), listing(2, lat=None, precio_uf=None), listing(3, lat=2.0, precio_uf=5.0), listing(4, dormitorios=None), listing(5, comuna=None), listing(6, comuna=None, m2_construidos=71.0)]
    batch = frame(spark, rows).withColumn("arrival", F.col("id"))
    found = {r.id: r for r in dedup.batch_dedup(batch).collect()}
    # 3 is the most complete with a source id, so it is kept; 1 and 2 are less complete and are dropped.
    assert set(found) == {3, 4, 5} and (found[3].lat, found[3].precio_uf) == (2.0, 5.0)
    assert dedup.batch_dedup(batch.limit(0)).count() == 0


def test_dashboard_score(spark):
    rows = [(0.2, 0.8, False, "high", 110.0, 50.0, 100.0, 90.0, 120.0, 80.0, 130.0), (0.4, 0.6, True, "low", 220.0, 50.0, 0.0, None, None, 200.0, 240.0)]
    found = spark.createDataFrame(rows, "undervaluation double, confidence_score double, is_outlier boolean, confidence_level string, estimated_price double, m2_construidos double, comparables_mean double, comparables_min double, comparables_max double, min_price double, max_price double")
    row = risk.dashboard(found).first()
    assert row.score == pytest.approx(0.7 * 70 + 30 - 0.5 * 25) and row.dispersion == pytest.approx((0.3 + 40 / 220) / 2) and row.interpretation.startswith("Mercado moderadamente")
    none = risk.dashboard(found.limit(0)).first()
    assert (none.n, none.score) == (0, 0.0)


def test_contract_fills_gaps(spark):
    rows = spark.createDataFrame([(None, "7", None), ("ok", "x", "true"), (None, None, "x")], "status string, total_count string, low_data_mode string")
    assert [r[:4] for r in radar.contract(rows).collect()] == [("ok", 7, 0, False), ("ok", 0, 0, True), ("insufficient_data", 0, 0, False)]


def test_validation_reasons(spark):
    rows = [listing(1, url="https://www.yapo.cl/bienes-raices/x/1234567"), listing(2, url="https://www.yapo.cl/login"), listing(3, url=None, precio_clp=0, comuna=" ", m2_construidos=None)]
    valid, rejected = validation.validated(frame(spark, rows))
    assert [r.id for r in valid.collect()] == [1]
    reasons = {r.id: list(r.validation_errors) for r in rejected.collect()}
    assert reasons[2] == ["not a real property listing link", "navigation/search/category link"]
    assert reasons[3] == ["missing link/url", "missing or invalid price", "missing comuna", "missing usable surface area"]


def test_strong_partial_cards(spark):
    card = lambda n, body: f"<div><a href='/bienes-raices/x/{n}'><h2>Departamento amplio y luminoso</h2></a><p>{body}</p></div>"
    html = "<html>" + card(1000001, "UF 4.500 en Macul, 2 dormitorios") + card(1000002, "UF 4.500, 70 m2") + card(1000003, "UF 4.500 en Macul") + card(1000004, "sin precio 80 m2") + "</html>"
    found = {r.source_listing_id: r for r in pages.card_rows(pages.cards(spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string"))).collect()}
    assert {k: (r.quality, r.m2_construidos, r.comuna, r.dormitorios) for k, r in found.items()} == {"1000001": ("low", None, "Macul", 2), "1000002": ("standard", 70.0, None, None)}


def test_whole_ingest_expires_and_marks(spark):
    old = listing(1, url="https://www.yapo.cl/bienes-raices/x/1000001", link="https://www.yapo.cl/bienes-raices/x/1000001", last_seen=dt.datetime(2001, 11, 1))
    gone = listing(2, comuna="Macul", last_seen=dt.datetime(2001, 11, 1))
    twin = listing(3, m2_construidos=72.0)
    log = spark.createDataFrame([], "listing_id long, precio_clp_nuevo long, precio_uf_nuevo double, fecha_captura date")
    batch = frame(spark, [{**old, "precio_clp": 150_000_000}, listing(9, url="https://www.yapo.cl/login")]).withColumn("arrival", F.col("id")).drop("id", "last_seen")
    snapshot, rows, rejected = ingest.ingest(frame(spark, [old, gone, twin]), log, batch, "2001-12-01")
    found = {r.id: r for r in snapshot.collect()}
    assert (found[1].status, found[1].precio_clp, found[2].status) == ("active", 150_000_000, "inactive")
    assert {found[1].is_duplicate, found[3].is_duplicate} == {True, False} and found[1].duplicate_group_id == found[3].duplicate_group_id
    assert [r.listing_id for r in rows.collect()] == [1] and rejected.count() == 1


def test_streamed_files_are_merged(spark, tmp_path):
    source, state = tmp_path / "in", {"snapshot": frame(spark, []), "rows": 0}
    schema = frame(spark, []).withColumn("arrival", F.col("id")).schema

    def write(snapshot, log, epoch):
        snapshot.write.mode("overwrite").parquet(str(tmp_path / f"out{epoch}"))
        state["snapshot"], state["rows"] = spark.read.parquet(str(tmp_path / f"out{epoch}")), state["rows"] + log.count()

    for k, price in enumerate((145_000_000, 150_000_000)):
        frame(spark, [listing(1, precio_clp=price)]).withColumn("arrival", F.col("id")).write.mode("append").parquet(str(source))
        stream_upserts(spark, str(source), schema, lambda: state["snapshot"], write, "2001-12-01", str(tmp_path / "checkpoint")).awaitTermination(120)
    assert [r.precio_clp for r in state["snapshot"].collect()] == [150_000_000] and state["rows"] == 2


def test_system_health_levels(spark):
    one = spark.range(1)
    sections = {"database": one.select(F.lit(5).alias("active"), F.lit(1).alias("without_price"), F.lit(2).alias("without_m2"), F.lit(0).alias("without_coordinates"), F.lit(0).alias("duplicate_links"))}
    listed = audit.findings(sections)
    row = audit.health(listed, sections).first()
    # Two findings and the missing areas once more: 20 + 20 + 5.
    assert {r.code for r in listed.collect()} == {"listings_without_price", "listings_without_m2"}
    assert (row.score, row.system_status, row.general_status, row.high, row.low) == (55, "UNSTABLE", "WARNING", 2, 1)


def test_radar_marks_duplicates_first(spark):
    rows = frame(spark, [listing(i, m2_construidos=40.0 + 6 * i, precio_clp=(95 if i == 3 else 140 + i) * 1_000_000) for i in range(1, 13)])
    log = spark.createDataFrame([], "id long, listing_id long, precio_clp_nuevo long, fecha_captura date")
    marked = {r.id for r in dedup.mark_duplicates(rows).where("is_duplicate").collect()}
    found = {r.id for r in radar.radar(rows, log, "2001-12-01", gate=False).collect()}
    assert marked and not found & marked
    assert views.AS_OF == "2001-12-01"


def test_displayed_texts_and_points(spark):
    from predial.functions.prices import full_price
    from predial.operators import risk

    rows = spark.createDataFrame([(1, 95_000_000.5, "La Reina", 75.0, 3, 2), (2, None, "", 0.0, None, 0), (3, 950.0, None, None, 1, None)], "id int, p double, comuna string, m2_construidos double, dormitorios int, banos int")
    assert [tuple(r) for r in rows.orderBy("id").select(full_price(F.col("p")), risk.property_summary()).collect()] == [("$95.000.000", "La Reina | 75.0 m2 | 3D | 2B"), ("Sin precio", "Sin comuna"), ("$950", "Sin comuna | 1D")]
    found = spark.createDataFrame([(1, 10.0, 20.0, 30.0, 15.0), (2, None, None, None, 5.0), (3, 1.0, 2.0, 3.0, 4.0)], "id int, comparables_min double, comparables_mean double, comparables_max double, listing_price double")
    series = spark.createDataFrame([(3, 7.0)], "listing_id int, price double")
    assert [(r.id, r.place, r.label, r.value) for r in risk.reference_series(found, series).orderBy("id", "place").collect()] == [(1, 0, "Min comparables", 10.0), (1, 1, "Promedio", 20.0), (1, 2, "Max comparables", 30.0), (1, 3, "Listado", 15.0)]
    point = spark.createDataFrame([(1, None, 0.5, 0.2, 4, 10.0)], "id int, roi double, confidence_score double, undervaluation double, comparable_count int, investment_score double")
    assert sorted((r.chart, r.x, r.y, r.size) for r in risk.chart_points(point).collect()) == [("discount_comparables", 20.0, 4.0, 8.0), ("risk_return", 0.0, 50.0, 8.0)]


def test_actions_by_urgency(spark):
    from predial.operators import audit

    schema = "critical_findings int, warnings int, median_error_pct double, opportunities int, high_risk int, thin_comunas int"
    calls = lambda *row: [r.action[:9] for r in audit.top_actions(spark.createDataFrame([row], schema)).orderBy("place").collect()]
    assert calls(0, 0, None, 0, 0, 0) == ["Mantener "]
    assert calls(1, 1, 20.0, 1, 1, 1) == ["Resolver ", "Agrupar w", "Revisar l", "Revisar m", "Priorizar"]
    assert calls(0, 0, None, 0, 0, 2) == ["Aumentar "]


def test_summary_lines_of_an_audit_without_results(spark):
    from predial.operators import audit

    row = lambda schema, *values: spark.createDataFrame([values], schema)
    sections = {
        "database": row("total long, active long, without_price long, without_m2 long, without_coordinates long, duplicate_links long", 0, 0, 0, 0, 0, 0), "quality": row("total long, usable_ratio double, outliers long", 0, 0.0, 0),
        "benchmark": row("evaluated long, median_error_pct double, average_error_pct double", 0, None, None), "radar": row("ready long, opportunities long", 0, 0), "legal": row("checked long", 0)}
    found = spark.createDataFrame([], "legal_profile struct<legal_risk_level: string>")
    listed = spark.createDataFrame([], "section string, severity string, code string, n long")
    lines = [r.line for r in audit.summary(sections, found, listed, row("general_status string", "OK")).orderBy("place").collect()]
    assert lines == ["- Estado general: **OK**.", "- Checks: 2.", "- Salud de datos: 0 activos, 0.0% usables, 0 sin precio, 0 sin m2.", "- Benchmark: 0 evaluados, error mediano Sin datos.", "- Radar: 0 listings listos, 0 oportunidades generadas.", "- Legal risk: Sin datos; 0 inconsistencias legales."]
