"""Branches of the listings engine on small tables, and the registered queries' contract."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from predial.functions import extract, text
from predial.functions.prices import ask_clp, quality_clp, segment, short_price
from predial.operators import audit, dedup, history, ingest, quality, radar, risk, valuation
from predial.sources import pages
from predial.sources.schema import LISTING, conform


def listing(i, **more):
    base = {"id": i, "fuente": "yapo", "source_listing_id": str(100000 + i), "url": f"https://www.yapo.cl/d/{100000 + i}", "status": "active", "titulo": "Departamento en venta", "comuna": "Ñuñoa", "precio_clp": 145_000_000, "m2_construidos": 70.0, "dormitorios": 2, "banos": 2, "estacionamientos": 1, "last_seen": dt.datetime(2001, 12, 1), "fecha_captura": dt.date(2001, 12, 1)}
    return {**base, **more}


def frame(spark, rows):
    ddl = ", ".join(f"{k} {v}" for k, v in LISTING.items())
    return spark.createDataFrame([[r.get(k) for k in LISTING] for r in rows], ddl)


def test_text_functions(spark):
    row = spark.createDataFrame([("  Ñuñoa\t Centro ", "$ 1.250.000", "UF 4.500,5", "https://Ex.CL/a/b/?q=1#x")], "a string, b string, c string, d string")
    got = row.select(text.clean_text(F.col("a")), text.match_key(F.col("a")), text.locale_number(F.col("b")), text.price_text(F.col("c"))[1], text.normal_url(F.col("d")), text.title_case(F.lit("la reina-alta")), text.rounded_m2(F.lit(72.5)), text.standard_comuna(F.lit(" NUNOA "))).first()
    assert tuple(got) == ("Ñuñoa Centro", "nunoa centro", 1250000.0, 4500.5, "https://ex.cl/a/b", "La Reina-Alta", 70, "Ñuñoa")
    assert row.select(text.locale_number(F.lit("120.5")), text.clean_text(F.lit(" ")), text.comuna_key(F.lit(None).cast("string"))).first()[:] == (1205.0, None, "")


@pytest.mark.parametrize("raw, expected", [("depto 3d/2b/1e", (3, 2, 1)), ("2 dormitorios, 1 bano", (2, 1, None)), ("dormitorios: 4 banos: 2", (4, 2, None)), ("opcional 2 estacionamientos", (None, None, 2)), ("", (None, None, None)), (None, (None, None, None))])
def test_rooms(spark, raw, expected):
    assert tuple(spark.range(1).select(extract.rooms(F.lit(raw).cast("string")).alias("r")).first().r)[:3] == expected


@pytest.mark.parametrize("raw, expected", [("depto 75 m2", (75, "high")), ("superficie: 80 total", (80, "medium")), ("lindo 95 vista", (95, "low")), ("precio 95 uf", (None, "low")), ("ano 2001", (None, "low")), (None, (None, "low"))])
def test_area(spark, raw, expected):
    assert tuple(spark.range(1).select(extract.area(F.lit(raw).cast("string")).alias("a")).first().a) == expected


def test_prices_and_quality(spark):
    rows = frame(spark, [listing(1), listing(2, precio_clp=None, precio_uf=4000.0), listing(3, m2_construidos=5.0), listing(4, precio_clp=None, dormitorios=None, banos=None, comuna=None)])
    got = {r.id: r for r in rows.select("id", ask_clp().alias("ask"), quality_clp().alias("q"), quality.issues().alias("issues"), quality.usable().alias("ok"), segment(F.col("m2_construidos")).alias("seg")).collect()}
    assert (got[2].ask, got[2].q) == (148_000_000.0, 152_000_000.0) and got[1].ok and not got[3].ok
    assert set(got[4].issues) == {"missing_price", "missing_basic_attributes", "unknown_comuna", "invalid_precio_m2"} and got[3].seg == "small_apartment"
    assert spark.range(1).select(short_price(F.lit(95_400_000.0)), short_price(F.lit(None).cast("double")), short_price(F.lit(12345.0))).first()[:] == ("95M", "N/D", "12.345")


def test_upsert_cases(spark):
    none = frame(spark, [])
    row = lambda i, arrival, **m: {**listing(i, **m), "arrival": arrival}

    def run(current, batch):
        df = frame(spark, batch).join(spark.createDataFrame([(b["id"], b["arrival"]) for b in batch], "id long, arrival long"), "id").drop("id")
        return ingest.upsert(current, df, "2001-12-01")

    same, log = run(none, [row(1, 1), row(2, 2, precio_clp=150_000_000)])
    assert [(r.precio_clp, r.source_listing_id) for r in same.collect()] == [(150_000_000, "100002")] and log.count() == 1
    current = frame(spark, [listing(1)])
    close, log = run(current, [row(2, 1, m2_construidos=72.0, precio_clp=150_000_000)])
    assert [(r.id, r.m2_construidos) for r in close.collect()] == [(1, 72.0)] and log.first().precio_clp_anterior == 145_000_000
    assert run(current, [row(2, 1, comuna="Providencia")])[0].count() == 2
    assert run(none, [row(3, 1, m2_construidos=None)])[0].count() == 0


def test_duplicates(spark):
    rows = frame(spark, [listing(1), listing(2, m2_construidos=75.0, lat=1.0, lon=1.0), listing(3, m2_construidos=200.0), listing(4, dormitorios=None), listing(5, comuna="Macul"), listing(6, m2_construidos=82.0)])
    assert {(r.a, r.b) for r in dedup.duplicate_pairs(rows).collect()} == {(1, 2), (2, 6)}
    assert {r.id: r.group for r in dedup.groups_by_components(rows).collect()} == {1: 1, 2: 1, 6: 1, 3: 3, 5: 5}
    assert {r.id: r.group for r in dedup.groups_greedy(rows).collect()} == {1: 1, 2: 1, 6: 1, 3: 3, 5: 5}
    marked = {r.id: (r.is_duplicate, r.duplicate_group_id) for r in dedup.mark_duplicates(rows).collect()}
    assert marked[2] == (False, "property-2") and marked[1] == (True, "property-2") and marked[4] == (False, None)


def test_history(spark):
    rows = frame(spark, [listing(1, fecha_publicacion=dt.date(2001, 11, 1)), listing(2)])
    log = spark.createDataFrame([(1, 1, 160_000_000, dt.date(2001, 11, 5)), (2, 1, 150_000_000, dt.date(2001, 11, 20))], "id long, listing_id long, precio_clp_nuevo long, fecha_captura date")
    got = {r.id: r for r in history.signals(rows, log, "2001-12-01").collect()}
    assert got[1].price_drop_pct == pytest.approx(15 / 160) and got[1].time_on_market_days == 30 and got[2].price_drop_pct == 0
    ev = {r.id: r for r in history.evolution(rows, log, "2001-12-01").collect()}
    assert (ev[1].price_changes, ev[1].trend, ev[1].all_time_high, ev[1].last_price_change_days) == (2, "down", 160_000_000.0, 0) and ev[2].trend == "stable"


def test_judgements(spark):
    one = spark.range(1)
    n = one.select(risk.negotiation(F.lit(35), F.lit(2), F.lit(0.12), F.lit(0.0), F.lit(9), F.lit(0.8)).alias("n")).first().n
    assert (n.score, n.strategy, n.seller_profile, n.confidence) == (82.0, "Aggressive", "Flexible", "High")
    s = one.select(radar.investment_score(F.lit(30.0), F.lit(0.9), F.lit(10), F.lit(False), F.lit(0.0)).alias("s")).first().s
    assert s.total in (96, 97) and s.discount == 100.0
    assert one.select(radar.legal_risk(F.lit(2), F.lit(0.5), F.lit(83.0)).alias("x")).first().x.legal_risk_score == 95
    assert one.select(risk.decision(F.lit(80), F.lit(0.9), F.lit(True), F.lit(9), F.lit(0.0))).first()[0] == "Revisar"
    bad = spark.createDataFrame([(1, 80.0, 0.4, 0.2, 2, None)], "id long, investment_score double, confidence_score double, undervaluation double, comparable_count int, listing_price double")
    out = audit.product_audit(bad).first()
    assert out.severity == "high" and {"high_discount_few_comparables", "very_low_depth", "invalid_price"} <= set(out.critical_issues)


def test_valuation_of_equal_comparables(spark):
    rows = frame(spark, [listing(i, precio_clp=140_000_000 + i * 1_000_000) for i in range(1, 9)])
    got = valuation.valuations(rows.where("id = 1"), rows).first()
    assert got.valuation_status == "market_comparable" and 140_000_000 < got.estimated_price < 150_000_000 and got.comparable_count == 7
    assert valuation.valuations(rows.where("id = 1"), rows.where("id < 3")).first().reason == "not enough comparable candidates"
    assert valuation.valuations(rows.where("id = 1").withColumn("m2_construidos", F.lit(None).cast("double")), rows).first().reason.startswith("subject")


def test_pages(spark):
    html = "<html><body><div><a href='/depto/123456'>Depto uno lindo con vista</a><p>UF 4.500 dos dormitorios amplios</p></div><div><a href='/depto/777777'>Otro</a><span>$ 98.000.000 en Macul cerca del metro</span></div></body></html>"
    rows = spark.createDataFrame([(1, "u", html), (2, "u", None)], "page_id long, url string, html string")
    got = {r.source_listing_id: r for r in pages.fallback_rows(pages.cards(rows), F.lit("Macul")).collect()}
    assert pages.card_rows(pages.cards(rows)).count() == 0  # neither has an area, a commune and rooms
    assert got["123456"].precio_uf == 4500.0 and got["777777"].precio_clp == 98_000_000 and set(got) == {"123456", "777777"}
    js = '{"results": [{"id": "MLC1", "title": "t", "price": 4000, "currency_id": "CLF", "permalink": "https://x.cl/a?b", "address": {"city_name": "Macul"}, "location": {"latitude": -33.1, "longitude": -70.2}, "attributes": [{"id": "BEDROOMS", "value_name": "3"}, {"id": "TOTAL_AREA", "value_struct": {"number": 81}}]}]}'
    item = pages.search_rows(spark.createDataFrame([(js,)], "json string")).first()
    assert (item.precio_uf, item.dormitorios, item.m2_construidos, item.comuna, item.link) == (4000.0, 3, 81.0, "Macul", "https://x.cl/a")


def test_cards_hold_a_price_and_links_a_host(spark):
    """The container with the price counts, not a title's box of 35 characters; relative links get the page's host."""
    card = "<div class=card><div class='card-title'><a href='/bienes-raices/venta/12345678'><h2>Departamento amplio y luminoso en Las Condes</h2></a></div><span>UF 5.000</span><p>70 m2 2 dormitorios</p></div>"
    chosen = "<ul><li><article data-testid='ad-1'><a href='/bienes-raices/venta/22222222'>Casa</a> <b>$ 99.000.000</b> con patio y 3 dormitorios, 90 m2 en Macul</article></li></ul>"
    plain = "<main><section><a href='/bienes-raices/venta/33333333'>Piso</a> <i>UF 3.000</i></section><a href='/bienes-raices/venta/44444444'>Sin precio</a></main>"
    pages_ = spark.createDataFrame([(1, "https://www.Yapo.cl/busca?x=1", card + chosen), (2, "https://www.yapo.cl/b", plain), (3, None, card)], "page_id long, url string, html string")
    got = {(r.page_id, r.source_listing_id): r for r in pages.fallback_rows(pages.cards(pages_), F.lit("x")).collect()}
    assert set(got) == {(1, "12345678"), (1, "22222222"), (2, "33333333"), (3, "12345678")}
    assert got[1, "12345678"].link == "https://www.yapo.cl/bienes-raices/venta/12345678" and got[1, "12345678"].precio_uf == 5000.0
    assert got[1, "12345678"].titulo == "Departamento amplio y luminoso en Las Condes" and got[1, "22222222"].precio_clp == 99_000_000
    assert got[2, "33333333"].raw_text == "Piso Piso UF 3.000" and got[3, "12345678"].link == "/bienes-raices/venta/12345678"
    row = pages.card_rows(pages.cards(pages_.where("page_id = 1"))).where("source_listing_id = '12345678'").first()
    assert (row.precio_uf, row.m2_construidos, row.comuna, row.dormitorios) == (5000.0, 70.0, "Las Condes", 2)


def test_conform(spark):
    row = conform(spark.createDataFrame([(1, "9")], "id int, precio_clp string"), LISTING).first()
    assert (row.id, row.precio_clp, row.status, row.is_duplicate, row.comuna) == (1, 9, "active", False, None)


def test_entry_contract():
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(queries) and {"e4_market_values", "e5_radar"} <= set(queries)
