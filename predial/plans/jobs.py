"""Queries of joins, logs, duplicates, ingestion, maintenance and table copies, with their SQL."""

from pyspark.sql import functions as F

from ..functions.prices import ask_clp
from ..functions.text import normal_url
from ..operators import audit, dedup, history, ingest, portfolio, quality, validation
from ..operators.components import checkpointed
from ..sources import pages, schema
from ..sources.views import AS_OF, CTE, listings, price_history, table

ASK = "CASE WHEN precio_uf > 0 THEN precio_uf * 37000.0 WHEN precio_clp > 0 THEN CAST(precio_clp AS DOUBLE) END"
LINK = "regexp_replace(regexp_extract(url, '^([A-Za-z]+://[^/?#]*)', 1), 'Example', 'example') || regexp_replace(regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), '/+$', '')"
TIES = "fecha_captura, l_orderkey, l_linenumber, l_suppkey, l_quantity, l_extendedprice, precio_clp_nuevo"
SAME = "abs({a}.m2_construidos - {b}.m2_construidos) <= greatest({a}.m2_construidos, {b}.m2_construidos) * 0.10 AND abs({a}.dormitorios - {b}.dormitorios) <= 1 AND abs({a}.banos - {b}.banos) <= 1 AND coalesce(abs({a}.estacionamientos - {b}.estacionamientos) <= 1, true)"
POINTS = "(CAST(precio_clp IS NOT NULL AS INT) + CAST(precio_uf IS NOT NULL AS INT) + CAST(lat IS NOT NULL AS INT) + CAST(lon IS NOT NULL AS INT) + CAST(m2_construidos IS NOT NULL AS INT) + CAST(dormitorios IS NOT NULL AS INT) + CAST(banos IS NOT NULL AS INT) + CAST(estacionamientos IS NOT NULL AS INT))"
ELIGIBLE = "el AS (SELECT *, row_number() OVER (PARTITION BY comuna ORDER BY m2_construidos, id) AS k FROM listings WHERE status = 'active' AND m2_construidos > 0 AND dormitorios IS NOT NULL AND banos IS NOT NULL)"
_MEMBER = "'id': el.id, 'm': el.m2_construidos, 'd': el.dormitorios, 'b': el.banos, 'e': el.estacionamientos}"
#: The greedy groups, one row of every commune a turn.
GREEDY = f"""{ELIGIBLE},
gr(comuna, k, members) AS (SELECT comuna, k, [{{'g': CAST(1 AS BIGINT), {_MEMBER}] FROM el WHERE k = 1
  UNION ALL SELECT gr.comuna, el.k, list_append(gr.members, {{'g': coalesce(list_min(list_transform(list_filter(gr.members,
      lambda x: abs(x.m - el.m2_construidos) <= greatest(x.m, el.m2_construidos) * 0.10 AND abs(x.d - el.dormitorios) <= 1 AND abs(x.b - el.banos) <= 1 AND coalesce(abs(x.e - el.estacionamientos) <= 1, true)), lambda x: x.g)),
      list_max(list_transform(gr.members, lambda x: x.g)) + 1), {_MEMBER}) FROM gr JOIN el ON el.comuna = gr.comuna AND el.k = gr.k + 1),
gm AS (SELECT comuna, unnest(arg_max(members, k)) AS m FROM gr GROUP BY comuna),
gg AS (SELECT m.id AS id, first_value(m.id) OVER (PARTITION BY comuna, m.g ORDER BY m.m, m.id) AS grp FROM gm)"""
MARKED = f"""{GREEDY},
rk AS (SELECT l.id, gg.grp, row_number() OVER (PARTITION BY gg.grp ORDER BY {POINTS} DESC, last_seen DESC, l.id) AS r, count(*) OVER (PARTITION BY gg.grp) AS size FROM listings l JOIN gg ON gg.id = l.id),
mk AS (SELECT l.*, coalesce(rk.r > 1 AND rk.size > 1, false) AS is_duplicate, CASE WHEN rk.size > 1 THEN 'property-' || min(CASE WHEN rk.r = 1 THEN l.id END) OVER (PARTITION BY rk.grp) END AS duplicate_group_id FROM listings l LEFT JOIN rk ON rk.id = l.id)"""


def _sql(body: str, extra: str = "", recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' * recursive}{CTE}{', ' + extra if extra else ''} {body}"


def _linked(spark, sf_dir):
    return listings(spark, sf_dir).withColumn("link", normal_url(F.col("url")))


def s1_listings_with_property(spark, sf_dir):
    """Suppliers stand for the properties of some listings."""
    properties = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("ano_construccion"))
    return schema.with_property(listings(spark, sf_dir).withColumn("property_id", F.col("id") % 1000), properties).select("id", "property_id", F.col("property.ano_construccion").alias("built"))


def s2b_evaluation_rows(spark, sf_dir):
    from ..operators.evaluate import evaluation_rows

    return evaluation_rows(listings(spark, sf_dir)).select("id", F.round(ask_clp(), 4).alias("ask_clp"))


def s3_ordered_log(spark, sf_dir):
    return history.ordered(price_history(spark, sf_dir))


def s4_chart_series(spark, sf_dir):
    return history.chart_series(price_history(spark, sf_dir))


def s5_lookup(spark, sf_dir):
    """Keys are source ids of even listings and own ids of the others, and some that nothing has."""
    keys = listings(spark, sf_dir).select(F.when(F.col("id") % 5 == 0, F.concat(F.lit("no-"), F.col("id").cast("string"))).when(F.col("id") % 2 == 0, F.col("source_listing_id")).otherwise(F.col("id").cast("string")).alias("key"))
    return portfolio.lookup(listings(spark, sf_dir), keys)


def s6_watchlist(spark, sf_dir):
    """Customers' parts of some orders are saved, some a second time, some removed; the newest first."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("listing_id"), F.col("o_totalprice").alias("precio_guardado"), F.col("o_orderdate").alias("saved_at"), "o_orderkey")
    saved = orders.where("o_orderkey % 2 = 0").groupBy("listing_id").agg(F.min("precio_guardado").alias("precio_guardado"), F.min("saved_at").alias("saved_at"))
    new = orders.where("o_orderkey % 2 = 1").select("listing_id", "precio_guardado", "saved_at")
    gone = table(spark, sf_dir, "customer").where("c_nationkey = 3").select(F.col("c_custkey").cast("string").alias("listing_id"))
    found = portfolio.newest_first(portfolio.remove_saved(portfolio.add_saved(saved, new), gone))
    return found.select("listing_id", F.round("precio_guardado", 2).alias("precio_guardado"), F.col("saved_at").cast("date").alias("saved_at"))


def s8_coordinates(spark, sf_dir):
    updates = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.when(F.col("s_suppkey") % 3 > 0, F.lit(-33.0) - F.col("s_nationkey") / 100).alias("lat"), F.when(F.col("s_suppkey") % 4 > 0, F.lit(-70.0) - F.col("s_nationkey") / 100).alias("lon"))
    return ingest.update_coordinates(listings(spark, sf_dir), updates).select("id", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


def s9_copy_counts(spark, sf_dir):
    """The log is copied to a store that has its even lines and the listings of every third part."""
    log = price_history(spark, sf_dir).select(F.col("l_orderkey").alias("order"), F.col("l_linenumber").alias("line"), "listing_id")
    _, counts = ingest.copy_missing(log, log.where("line = 2"), ["order", "line"], listings(spark, sf_dir).where("id % 3 = 0"), "listing_id")
    return counts


def s9_copied_rows(spark, sf_dir):
    log = price_history(spark, sf_dir).select(F.col("l_orderkey").alias("order"), F.col("l_linenumber").alias("line"), "listing_id")
    return ingest.copy_missing(log, log.where("line = 2"), ["order", "line"], listings(spark, sf_dir).where("id % 3 = 0"), "listing_id")[0]


def s11_search_results(spark, sf_dir):
    """Each commune's listings as one search result's JSON, read back."""
    base = listings(spark, sf_dir)
    number = lambda name, c: F.struct(F.lit(name).alias("id"), F.lit(None).cast("string").alias("value_name"), F.struct(F.col(c).cast("double").alias("number")).alias("value_struct"))
    word = lambda name, c: F.struct(F.lit(name).alias("id"), F.col(c).cast("string").alias("value_name"), F.struct(F.lit(None).cast("double").alias("number")).alias("value_struct"))
    item = F.struct(
        F.col("source_listing_id").alias("id"), F.col("titulo").alias("title"), F.coalesce(F.col("precio_clp").cast("double"), "precio_uf").alias("price"), F.when(F.col("precio_uf").isNotNull(), "CLF").otherwise("CLP").alias("currency_id"), F.col("url").alias("permalink"), F.struct(F.col("comuna").alias("city_name")).alias("address"),
        F.struct(F.col("lat").alias("latitude"), F.col("lon").alias("longitude")).alias("location"), F.array(number("TOTAL_AREA", "m2_construidos"), word("BEDROOMS", "dormitorios"), number("BATHROOMS", "banos"), word("PARKING_LOTS", "estacionamientos")).alias("attributes"))
    results = base.groupBy("comuna", (F.col("id") % 7).alias("page")).agg(F.to_json(F.struct(F.collect_list(item).alias("results"))).alias("json"))
    return pages.search_rows(results).select("source_listing_id", "titulo", "link", "precio_clp", F.round("precio_uf", 4).alias("precio_uf"), "comuna", F.round("lat", 6).alias("lat"), F.round("m2_construidos", 4).alias("m2_construidos"), "dormitorios", "banos", "estacionamientos")


CARD = "<div class='card'><a href='https://www.yapo.cl/bienes-raices/x/{id}?a=1'><h2>{title}</h2></a><span>{price}</span><p>{area} {rooms}</p></div>"


def _search_pages(spark, sf_dir):
    """Pages of up to seven listings of a commune as HTML: every fifth listing shows no area, every seventh no price."""
    base = listings(spark, sf_dir)
    number = (F.col("id") + 100_000).cast("string")
    price = F.when(F.col("id") % 7 == 0, "Consultar").when(F.col("precio_uf").isNotNull(), F.concat(F.lit("UF "), F.floor("precio_uf").cast("string"))).otherwise(F.concat(F.lit("$ "), F.col("precio_clp").cast("string")))
    area = F.when(F.col("id") % 5 == 0, "").otherwise(F.concat((F.col("id") % 90 + 20).cast("string"), F.lit(" m2")))
    rooms = F.concat((F.col("id") % 6 + 1).cast("string"), F.lit(" dormitorios "), (F.col("id") % 4 + 1).cast("string"), F.lit(" baños en Las Condes"))
    parts = {"id": number, "title": F.concat(F.lit("Departamento amplio "), F.col("comuna")), "price": price, "area": area, "rooms": rooms}
    html = F.concat(*[parts[p] if i % 2 else F.lit(p) for i, p in enumerate(CARD.replace("}", "{").split("{"))])
    page = base.groupBy("comuna", F.floor(F.col("id") / 7).alias("n")).agg(F.array_join(F.array_sort(F.collect_list(html)), "").alias("body"), F.min("id").alias("page_id"))
    return page.select("page_id", F.lit("https://www.yapo.cl/search").alias("url"), F.concat(F.lit("<html><body><nav><a href='/ayuda'>Ayuda</a></nav>"), F.col("body"), F.lit("</body></html>")).alias("html"))


def s10_card_rows(spark, sf_dir):
    """Every listing's card on its page, read back."""
    rows = pages.card_rows(pages.cards(_search_pages(spark, sf_dir), pattern=r"/bienes-raices/.*/\d{5,}"))
    return rows.select((F.col("source_listing_id").cast("bigint") - 100_000).alias("id"), "link", "precio_clp", "precio_uf", "m2_construidos", "comuna", "dormitorios", "banos", "quality", F.array_join("quality_flags", ",").alias("flags"))


def s12_fallback_rows(spark, sf_dir):
    found = pages.cards(_search_pages(spark, sf_dir), pattern=r"/bienes-raices/.*/\d{5,}")
    return pages.fallback_rows(found, F.lit("Las Condes")).select((F.col("source_listing_id").cast("bigint") - 100_000).alias("id"), "titulo", "precio_clp", "precio_uf", "comuna")


def c32_search_pages(spark, sf_dir):
    """Pages that are too short, that say that there is nothing, and good ones."""
    base = _search_pages(spark, sf_dir).withColumn("html", F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("<p>No se encontraron   resultados</p>"), F.col("html"))).when(F.col("page_id") % 3 == 1, F.substring("html", 1, 300)).otherwise(F.concat(F.col("html"), F.repeat(F.lit(" "), 10), F.repeat(F.lit("<i>a</i>"), 80))))
    return base.select("page_id", pages.usable_page(F.col("html")).alias("usable"))


def s14_conformed(spark, sf_dir):
    """Parts onto the listing schema: what they lack is null or has its default."""
    base = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("titulo"), F.col("p_size").alias("m2_construidos"), F.when(F.col("p_size") > 25, "inactive").alias("status"))
    return schema.conform(base, schema.LISTING).select("id", "titulo", "m2_construidos", "status", "fuente", "is_duplicate", "comuna", "precio_clp")


def s14_sample(spark, sf_dir):
    return schema.sample(listings(spark, sf_dir), {"id": 0, "titulo": "", "comuna": "", "piscina": False})


def s15_written_findings(spark, sf_dir):
    """The coverage findings, written as JSON and read back."""
    base = _linked(spark, sf_dir)
    found = audit.findings({"database": audit.database_section(base), "quality": audit.quality_section(quality.coverage(base))})
    return audit.write_json(found, "findings").select("section", "severity", "code", "n")


def j5_properties(spark, sf_dir):
    """Each listing's property among the distinct shapes of the active ones; nulls equal nulls."""
    keys = ["comuna", "m2_construidos", "dormitorios", "banos", "estacionamientos"]
    known = listings(spark, sf_dir).where("status = 'active'").select("id", *keys)
    return ingest.find_properties(listings(spark, sf_dir), known, keys).select("id", "property_id")


def j6_backfilled(spark, sf_dir):
    properties = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_nationkey") % 4).cast("int").alias("dormitorios"), (F.col("s_nationkey") % 3).cast("int").alias("banos"))
    return ingest.backfill(listings(spark, sf_dir).withColumn("property_id", F.col("id")), properties, ["dormitorios", "banos"]).select("id", "dormitorios", "banos")


def j7_initial_log(spark, sf_dir):
    """First log rows of the priced listings, the log having those of dates after 1997 only."""
    return history.initial_rows(listings(spark, sf_dir), price_history(spark, sf_dir).where("fecha_captura >= '1998-06-01'")).select("listing_id", "precio_clp_nuevo", F.round("precio_uf_nuevo", 4).alias("precio_uf_nuevo"), "fecha_captura")


def f1_valid_prices(spark, sf_dir):
    base = listings(spark, sf_dir).withColumn("precio_clp", F.when(F.col("id") % 4 == 0, F.floor(F.col("precio_clp") / 1000)).otherwise(F.col("precio_clp")))
    return base.select("id", quality.clean_valid().alias("clean"), quality.ingest_valid().alias("scraped"), quality.ingest_valid("app").alias("app"), (F.size(quality.issues()) == 0).alias("high_quality"))


LINKS = {0: "https://www.yapo.cl/bienes-raices/x/{id}00000", 1: "https://www.yapo.cl/bienes-raices/venta", 2: "https://www.portalinmobiliario.com/MLC-{id}", 3: "https://www.portalinmobiliario.com/venta", 4: "/login", 5: ""}


def _scraped(spark, sf_dir):
    pieces = F.when(F.lit(False), "")
    for k, text in LINKS.items():
        head, _, tail = text.partition("{id}")
        pieces = pieces.when(F.col("id") % 6 == k, F.concat(F.lit(head), F.col("id").cast("string"), F.lit(tail)) if "{id}" in text else F.lit(text))
    source = F.when(F.col("id") % 6 < 2, "yapo").when(F.col("id") % 6 < 4, "portalinmobiliario").otherwise("otra")
    return listings(spark, sf_dir).withColumns({"url": pieces, "fuente": source, "comuna": F.when(F.col("id") % 11 > 0, F.col("comuna"))})


def f8_rejected_rows(spark, sf_dir):
    valid, rejected = validation.validated(_scraped(spark, sf_dir))
    return valid.select("id", F.lit("").alias("reasons")).unionByName(rejected.select("id", F.array_join("validation_errors", "; ").alias("reasons")))


def f9_links(spark, sf_dir):
    base = _scraped(spark, sf_dir)
    return base.select("id", F.coalesce(validation.listing_link(F.col("fuente"), F.col("url")), F.lit(False)).alias("listing"), validation.navigation_link(F.col("fuente"), F.col("url")).alias("navigation"))


def f10_blocked_pages(spark, sf_dir):
    page = table(spark, sf_dir, "pages").withColumn("html", F.when(F.col("page_id") % 4 == 0, F.concat(F.col("html"), F.lit(" Verifica que eres HUMANO"))).otherwise(F.col("html")))
    return page.select("page_id", audit.blocked(F.col("url"), F.col("html")).alias("blocked"))


def f11_portal_rows(spark, sf_dir):
    base = listings(spark, sf_dir).withColumn("titulo", F.when(F.col("id") % 5 == 0, "Iniciar  Sesión").when(F.col("id") % 5 == 1, "Venta").otherwise(F.col("titulo")))
    first = quality.first_per_link(_linked(spark, sf_dir).select("id", "link"), "link").select("id", F.lit(True).alias("first"))
    rows = base.select("id", validation.portal_row(base).alias("portal"), validation.card_title(F.col("titulo")).alias("card"))
    return rows.join(first, "id", "left").withColumn("first", F.coalesce("first", F.lit(False)))


def a3_repeated_values(spark, sf_dir):
    """The most frequent fingerprints, urls and titles."""
    from ..functions.text import fingerprint

    base = listings(spark, sf_dir).withColumn("print", fingerprint())
    kinds = [("fingerprint", "print", 2, 25), ("url", "url", 2, 20), ("titulo", "titulo", 3, 20)]
    parts = [dedup.duplicate_counts(base, [c], least, top).select(F.lit(kind).alias("kind"), F.col(c).alias("value"), "n") for kind, c, least, top in kinds]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def a33_snapshot_alerts(spark, sf_dir):
    """Orders of a year as a run's active listings."""
    runs = table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("run")).agg(F.count("*").alias("active"))
    found = audit.snapshot_alert(runs)
    return found.select("run", "active", "previous", F.round("variation_pct", 6).alias("variation_pct"), "alert")


def w8_representatives(spark, sf_dir):
    """The kept listing of each group of duplicates."""
    marked = dedup.mark_duplicates(listings(spark, sf_dir))
    return marked.where("duplicate_group_id is not null").select("id", "is_duplicate", "duplicate_group_id")


def w10_batch_properties(spark, sf_dir):
    return dedup.batch_dedup(_linked(spark, sf_dir).withColumn("arrival", F.col("id"))).select("id", "comuna", "precio_clp", "lat", "estacionamientos")


def w11_smallest_cards(spark, sf_dir):
    found = pages.cards(_search_pages(spark, sf_dir), pattern=r"/bienes-raices/.*/\d{5,}", priced=False)
    return found.select((F.regexp_extract("link", r"(\d{5,})", 1).cast("bigint") - 100_000).alias("id"), "title", F.length("raw_text").alias("length"))


def e12_maintained(spark, sf_dir):
    properties = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_nationkey") % 4).cast("int").alias("dormitorios"))
    base = _linked(spark, sf_dir).withColumn("property_id", F.col("id"))
    done, log = ingest.maintain(base, price_history(spark, sf_dir), properties, ["dormitorios"])
    n = log.groupBy("listing_id").agg(F.count("*").alias("log_rows"))
    return done.join(n, F.col("id") == F.col("listing_id"), "left").select("id", "status", "dormitorios", "estacionamientos", F.coalesce("log_rows", F.lit(0)).alias("log_rows"))


def e13_coordinate_counts(spark, sf_dir):
    base = listings(spark, sf_dir).withColumn("comuna", F.when(F.col("id") % 3 == 0, "Ñuñoa").when(F.col("id") % 3 == 1, " ").otherwise(F.col("comuna")))
    return ingest.geocode_counts(ingest.geocode(base))


def e2_scraped_job(spark, sf_dir):
    """The whole ingest of the listings as freshly scraped, rows of bad links rejected: statuses, duplicates and log rows."""
    base = _linked(spark, sf_dir)
    batch = _scraped(spark, sf_dir).withColumn("arrival", F.col("id"))
    snapshot, log, rejected = ingest.ingest(base, price_history(spark, sf_dir), batch, AS_OF)
    snapshot = checkpointed(snapshot)
    counts = snapshot.groupBy("status", "is_duplicate").agg(F.count("*").alias("n"))
    return counts.unionByName(log.select(F.lit("logged").alias("status"), F.lit(False).alias("is_duplicate")).groupBy("status", "is_duplicate").agg(F.count("*").alias("n"))).unionByName(rejected.select(F.lit("rejected").alias("status"), F.lit(False).alias("is_duplicate")).groupBy("status", "is_duplicate").agg(F.count("*").alias("n")))


def s7_batch_resolution(spark, sf_dir):
    """Every listing of a known area as four rows of one batch, in a commune of its own: what they become together.

    The second row is within a tenth of the first, the third of neither, the fourth of both and so of the later.
    """
    base = listings(spark, sf_dir).where("m2_construidos >= 20")
    grown = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(g).alias("g")) for k, g in enumerate((1.0, 1.04, 1.2, 1.12))])
    rows = base.select("*", F.explode(grown).alias("x")).withColumns({
        "arrival": F.col("id") * 4 + F.col("x.k"), "comuna": F.concat(F.lit("zona "), F.col("id").cast("string")), "m2_construidos": F.col("m2_construidos") * F.col("x.g"), "dormitorios": F.coalesce("dormitorios", F.lit(2)), "banos": F.coalesce("banos", F.lit(1)),
        "precio_clp": F.lit(90_000_000).cast("long") + F.col("x.k"), "source_listing_id": F.concat("source_listing_id", F.lit("-"), F.col("x.k").cast("string")), "url": F.concat(F.lit("https://x.cl/casa/"), F.col("id").cast("string"), F.lit("-"), F.col("x.k").cast("string"))})
    none = _linked(spark, sf_dir).limit(0)
    snapshot, log = ingest.upsert(none, rows.drop("id", "x"), AS_OF)
    logged = log.select(F.col("listing_id").alias("id"), "precio_clp_anterior", "precio_clp_nuevo")
    return snapshot.join(logged, "id", "left").select("id", "source_listing_id", F.round("m2_construidos", 6).alias("m2"), "precio_clp_anterior", "precio_clp_nuevo")


def _batches(spark, sf_dir):
    """The listings with links of their own, and three scraped batches of them: those of ids with a rest of 1, 2 and 3 or more by 4, and of every batch the later."""
    base = listings(spark, sf_dir).withColumn("url", F.concat(F.lit("https://x.cl/casa/"), F.col("id").cast("string"))).withColumn("link", F.col("url"))
    rows = [base.where(F.col("id") % 4 >= k).withColumns({"arrival": F.col("id"), "precio_clp": F.lit(100_000_000 + 1_000_000 * k).cast("bigint") + F.col("id"), "precio_uf": F.lit(None).cast("double")}) for k in (1, 2, 3)]
    return base, rows


def e2_streamed(spark, sf_dir):
    """Three scraped batches as a stream of files, an epoch each, merged into versions of a store; unseen listings expire at the end."""
    from ..sources.store import Store
    from ..streaming.ingest import stream_into

    base, batches = _batches(spark, sf_dir)
    store = Store.scratch(spark)
    none = spark.createDataFrame([], "listing_id long, precio_clp_anterior long, precio_uf_anterior double, precio_clp_nuevo long, precio_uf_nuevo double, fecha_captura date")
    store.write({"listings": base, "log": none})
    schema = batches[0].drop("id").schema
    for rows in batches:
        rows.drop("id").repartition(4, "arrival").write.mode("append").parquet(f"{store.root}/arrived")
    stream_into(store, f"{store.root}/arrived", schema, AS_OF, 4, f"{store.root}/stream")
    logged = store.read("log").groupBy(F.col("listing_id").alias("id")).agg(F.count("*").alias("log_rows"))
    store.clean(1)
    return store.read("listings").join(logged, "id", "left").select("id", "status", "precio_clp", F.coalesce("log_rows", F.lit(0)).alias("log_rows"))


def s13_rates_in_time(spark, sf_dir):
    """The rate known at the time of each log row: quotes come now and then, from orders, some of them void."""
    from ..operators.rates import rates_in_time

    log = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("order"), F.col("l_linenumber").alias("line"), F.timestamp_seconds(F.unix_timestamp(F.col("l_shipdate").cast("timestamp")) + F.col("l_partkey") % 1440 * 60).alias("seen"))
    quotes = table(spark, sf_dir, "orders").where("o_orderkey % 16 = 1 and year(o_orderdate) > 1992").select(F.timestamp_seconds(F.unix_timestamp(F.col("o_orderdate").cast("timestamp")) + F.col("o_custkey") % 1440 * 60).alias("ts"), F.when(F.col("o_orderkey") % 3 > 0, 36_000.0 + F.col("o_orderkey") % 1500).alias("valor"))
    return rates_in_time(log, quotes, "seen").select("order", "line", "rate", "rate_source", F.round("rate_age_hours", 4).alias("rate_age_hours"))


QUERIES = {name: f for name, f in list(globals().items()) if callable(f) and name[0] in "sacjpfwe" and name[1:2].isdigit()}

_PAGE = "pg AS (SELECT id, floor(id / 7) AS n, comuna, precio_clp, precio_uf, min(id) OVER (PARTITION BY comuna, floor(id / 7)) AS page_id FROM listings)"
_TITLE = "'Departamento amplio ' || comuna"
_PRICE = "CASE WHEN id % 7 = 0 THEN 'Consultar' WHEN precio_uf IS NOT NULL THEN 'UF ' || CAST(floor(precio_uf) AS BIGINT) ELSE '$ ' || precio_clp END"
_CARD = f"({_TITLE} || ' ' || {_PRICE} || ' ' || CASE WHEN id % 5 = 0 THEN '' ELSE (id % 90 + 20) || ' m2 ' END || (id % 6 + 1) || ' dormitorios ' || (id % 4 + 1) || ' baños en Las Condes')"
_LINKED = f"ln AS (SELECT *, {LINK} AS link FROM listings)"
_SCRAPED = f"sc AS (SELECT * EXCLUDE (url, fuente, comuna), CASE WHEN id % 11 > 0 THEN comuna END AS comuna, CASE WHEN id % 6 < 2 THEN 'yapo' WHEN id % 6 < 4 THEN 'portalinmobiliario' ELSE 'otra' END AS fuente, id % 6 AS k FROM listings)"
ORACLES = {
    "e2_streamed": _sql("SELECT id, CASE WHEN seen THEN 'active' WHEN status = 'active' AND last_seen < DATE '2001-11-24' THEN 'inactive' ELSE status END AS status, CASE WHEN seen THEN 100000000 + 1000000 * (id % 4) + id ELSE precio_clp END AS precio_clp, CASE WHEN seen THEN id % 4 ELSE 0 END AS log_rows FROM (SELECT *, m2_construidos > 0 AND id % 4 > 0 AS seen FROM (SELECT * REPLACE (coalesce(m2_construidos, 0) AS m2_construidos) FROM listings))"),
    "s13_rates_in_time": "WITH l AS (SELECT l_orderkey AS \"order\", l_linenumber AS line, CAST(l_shipdate AS TIMESTAMP) + to_minutes(CAST(l_partkey % 1440 AS INT)) AS seen FROM lineitem), q AS (SELECT CAST(o_orderdate AS TIMESTAMP) + to_minutes(CAST(o_custkey % 1440 AS INT)) AS ts, max(36000.0::DOUBLE + o_orderkey % 1500) AS valor FROM orders WHERE o_orderkey % 16 = 1 AND year(o_orderdate) > 1992 AND o_orderkey % 3 > 0 GROUP BY 1) SELECT \"order\", line, coalesce(valor, 37000.0::DOUBLE) AS rate, CASE WHEN ts IS NULL THEN 'fixed' WHEN seen - ts <= INTERVAL 12 HOURS THEN 'live' ELSE 'cached' END AS rate_source, round(epoch(seen - ts) / 3600.0::DOUBLE, 4) AS rate_age_hours FROM l ASOF LEFT JOIN q ON l.seen >= q.ts",
    "c30_page_cards": "SELECT DISTINCT lower(regexp_extract(url, '^[a-zA-Z]+://[^/?#]*')) || '/bienes-raices/venta/' || (page_id * 2 + k + 100000) AS link, 'Departamento amplio y luminoso en Las Condes ' || (page_id * 2 + k) AS titulo, CAST(page_id * 2 + k + 3000 AS DOUBLE) AS precio_uf, 70.0::DOUBLE AS m2_construidos, 'Las Condes' AS comuna, 2 AS dormitorios, 1 AS banos, 'standard' AS quality, CAST(page_id * 2 + k + 100000 AS VARCHAR) AS source_listing_id FROM pages, (VALUES (0), (1)) t(k) WHERE url IS NOT NULL AND html IS NOT NULL",
    "s7_batch_resolution": _sql("SELECT 1 + id * 4 + k AS id, source_listing_id || '-' || (k + 1) AS source_listing_id, round(m2_construidos * CASE k WHEN 0 THEN 1.04::DOUBLE ELSE 1.12::DOUBLE END, 6) AS m2, CAST(NULL AS BIGINT) AS precio_clp_anterior, CAST(90000001 + k AS BIGINT) AS precio_clp_nuevo FROM listings, (VALUES (0), (2)) t(k) WHERE m2_construidos >= 20"),
    "s1_listings_with_property": _sql("SELECT l.id, l.id % 1000 AS property_id, s_nationkey AS built FROM listings l LEFT JOIN supplier ON s_suppkey = l.id % 1000"),
    "s2b_evaluation_rows": _sql(f"SELECT id, round({ASK}, 4) AS ask_clp FROM listings WHERE status = 'active' AND m2_construidos > 0 AND (precio_clp IS NOT NULL OR precio_uf IS NOT NULL)"),
    "s3_ordered_log": _sql(f"SELECT listing_id, row_number() OVER (PARTITION BY listing_id ORDER BY {TIES}) AS step, fecha_captura, CASE WHEN precio_clp_nuevo > 0 THEN CAST(precio_clp_nuevo AS DOUBLE) END AS price FROM history"),
    "s4_chart_series": _sql("SELECT listing_id, fecha_captura, precio_clp_nuevo AS price FROM history WHERE precio_clp_nuevo IS NOT NULL"),
    "s5_lookup": _sql("SELECT CASE WHEN id % 2 = 0 THEN source_listing_id ELSE CAST(id AS VARCHAR) END AS key, id FROM listings WHERE id % 5 <> 0"),
    "s6_watchlist": "WITH o AS (SELECT CAST(o_custkey AS VARCHAR) AS listing_id, o_custkey, o_totalprice AS p, o_orderdate AS d, o_orderkey % 2 AS k FROM orders), a AS (SELECT listing_id, o_custkey, min(p) AS p, min(d) AS d FROM o WHERE k = 0 GROUP BY ALL), b AS (SELECT listing_id, o_custkey, arg_min(p, ROW(d, p)) AS p, min(d) AS d FROM o WHERE k = 1 AND listing_id NOT IN (SELECT listing_id FROM a) GROUP BY ALL) SELECT listing_id, round(p, 2) AS precio_guardado, CAST(d AS DATE) AS saved_at FROM (SELECT * FROM a UNION ALL SELECT * FROM b) JOIN customer ON c_custkey = o_custkey WHERE c_nationkey <> 3",
    "s8_coordinates": _sql("SELECT id, round(CASE WHEN s_suppkey % 3 > 0 AND s_suppkey % 4 > 0 THEN -33.0 - s_nationkey / 100.0 ELSE lat END, 6) AS lat, round(CASE WHEN s_suppkey % 3 > 0 AND s_suppkey % 4 > 0 THEN -70.0 - s_nationkey / 100.0 ELSE lon END, 6) AS lon FROM listings LEFT JOIN supplier ON s_suppkey = id"),
    "s9_copy_counts": _sql("SELECT CASE WHEN l_linenumber = 2 THEN 'already_there' WHEN listing_id % 3 <> 0 THEN 'no_parent' ELSE 'migrated' END AS outcome, count(*) AS n FROM history GROUP BY 1"),
    "s9_copied_rows": _sql('SELECT l_orderkey AS "order", l_linenumber AS line, listing_id FROM history WHERE l_linenumber <> 2 AND listing_id % 3 = 0'),
    "s11_search_results": _sql(f"SELECT source_listing_id, titulo, {LINK} AS link, precio_clp, round(precio_uf, 4) AS precio_uf, comuna, round(lat, 6) AS lat, m2_construidos, dormitorios, banos, CASE WHEN estacionamientos > 0 THEN estacionamientos END AS estacionamientos FROM listings"),
    "s10_card_rows": _sql("SELECT id, 'https://www.yapo.cl/bienes-raices/x/' || (id + 100000) AS link, CASE WHEN precio_uf IS NULL THEN precio_clp END AS precio_clp, floor(precio_uf) AS precio_uf, CASE WHEN id % 5 > 0 THEN CAST(id % 90 + 20 AS DOUBLE) END AS m2_construidos, 'Las Condes' AS comuna, CAST(id % 6 + 1 AS INT) AS dormitorios, CAST(id % 4 + 1 AS INT) AS banos, CASE WHEN id % 5 = 0 THEN 'low' ELSE 'standard' END AS quality, CASE WHEN id % 5 = 0 THEN 'missing_m2' ELSE '' END AS flags FROM pg WHERE id % 7 <> 0 AND (precio_uf IS NOT NULL OR precio_clp >= 10000000)", _PAGE),
    "s12_fallback_rows": _sql(f"SELECT id, {_TITLE} AS titulo, CASE WHEN precio_uf IS NULL THEN precio_clp END AS precio_clp, floor(precio_uf) AS precio_uf, 'Las Condes' AS comuna FROM pg WHERE id % 7 <> 0", _PAGE),
    "c32_search_pages": _sql("SELECT DISTINCT page_id, page_id % 3 = 2 AS usable FROM pg", _PAGE),
    "w11_smallest_cards": _sql(f"SELECT id, {_TITLE} AS title, CAST(length({_CARD}) AS INT) AS length FROM pg", _PAGE),
    "s14_conformed": "SELECT p_partkey AS id, p_name AS titulo, CAST(p_size AS DOUBLE) AS m2_construidos, CASE WHEN p_size > 25 THEN 'inactive' ELSE 'active' END AS status, 'unknown' AS fuente, false AS is_duplicate, CAST(NULL AS VARCHAR) AS comuna, CAST(NULL AS BIGINT) AS precio_clp FROM part",
    "s14_sample": _sql("SELECT id, titulo, comuna, false AS piscina FROM listings WHERE status = 'active' ORDER BY id LIMIT 10"),
    "j3_identity_matches": _sql("SELECT a.id AS arrival, min(b.id) AS id, count(*) AS hits FROM ln a JOIN ln b ON a.fuente = b.fuente AND a.link = b.link AND a.id <> b.id GROUP BY a.id", _LINKED),
    "j4_structural_matches": _sql(f"SELECT a.id AS arrival, arg_max(b.id, ROW(b.points, b.last_seen, -b.id)) AS id FROM pt a JOIN pt b ON a.comuna = b.comuna AND a.id <> b.id AND {SAME.format(a='a', b='b')} WHERE a.m2_construidos > 0 AND b.m2_construidos > 0 GROUP BY a.id", f"pt AS (SELECT *, {POINTS} AS points FROM listings)"),
    "j5_properties": _sql("SELECT l.id, (SELECT min(p.id) FROM listings p WHERE p.status = 'active' AND p.comuna IS NOT DISTINCT FROM l.comuna AND p.m2_construidos IS NOT DISTINCT FROM l.m2_construidos AND p.dormitorios IS NOT DISTINCT FROM l.dormitorios AND p.banos IS NOT DISTINCT FROM l.banos AND p.estacionamientos IS NOT DISTINCT FROM l.estacionamientos) AS property_id FROM listings l"),
    "j6_backfilled": _sql("SELECT id, coalesce(dormitorios, CAST(s_nationkey % 4 AS INT)) AS dormitorios, coalesce(banos, CAST(s_nationkey % 3 AS INT)) AS banos FROM listings LEFT JOIN supplier ON s_suppkey = id"),
    "j7_initial_log": _sql("SELECT id AS listing_id, precio_clp AS precio_clp_nuevo, round(precio_uf, 4) AS precio_uf_nuevo, fecha_captura FROM listings WHERE (precio_clp IS NOT NULL OR precio_uf IS NOT NULL) AND id NOT IN (SELECT listing_id FROM history WHERE fecha_captura >= DATE '1998-06-01')"),
    "f8_rejected_rows": _sql("SELECT id, array_to_string(list_filter([CASE k WHEN 0 THEN NULL WHEN 2 THEN NULL WHEN 3 THEN NULL WHEN 5 THEN 'missing link/url' ELSE 'not a real property listing link' END, CASE WHEN NOT coalesce(precio_clp > 0, false) AND NOT coalesce(precio_uf > 0, false) THEN 'missing or invalid price' END, CASE WHEN comuna IS NULL THEN 'missing comuna' END, CASE WHEN NOT coalesce(m2_construidos > 0, false) THEN 'missing usable surface area' END, CASE WHEN k IN (1, 3, 4) THEN 'navigation/search/category link' END], lambda x: x IS NOT NULL), '; ') AS reasons FROM sc", _SCRAPED),
    "f9_links": _sql("SELECT id, k IN (0, 2, 3) AS listing, k IN (1, 3, 4) AS navigation FROM sc", _SCRAPED),
    "f10_blocked_pages": "SELECT page_id, page_id % 4 = 0 OR " + " OR ".join(f"contains(lower(url || ' ' || html), '{w}')" for w in ("captcha", "access denied", "acceso denegado", "bloqueado", "blocked", "robot", "soy nuevo", "ya tengo cuenta", "iniciar sesion", "login", "registration")) + " AS blocked FROM pages",
    "f11_portal_rows": _sql("SELECT id, coalesce((precio_clp IS NOT NULL OR precio_uf IS NOT NULL) AND m2_construidos > 0 AND id % 5 > 1, false) AS portal, id % 5 <> 1 AS card, id = min(id) OVER (PARTITION BY link) AS first FROM ln", _LINKED),
    "f1_valid_prices": _sql("SELECT id, coalesce(precio_uf > 0 AND m2_construidos BETWEEN 10 AND 1000, false) AS clean, coalesce((CASE WHEN precio_uf IS NOT NULL THEN precio_uf > 0 ELSE precio_clp >= 10000000 END) AND m2_construidos > 0, false) AS scraped, coalesce((CASE WHEN precio_uf IS NOT NULL THEN precio_uf > 0 ELSE precio_clp >= 1 END) AND m2_construidos > 0, false) AS app, coalesce(m2_construidos BETWEEN 20 AND 500 AND (dormitorios > 0 OR banos > 0) AND coalesce(CAST(nullif(precio_clp, 0) AS DOUBLE), precio_uf * 38000) / m2_construidos BETWEEN 500000 AND 10000000, false) AS high_quality FROM (SELECT * REPLACE (CASE WHEN id % 4 = 0 THEN CAST(floor(precio_clp / 1000) AS BIGINT) ELSE precio_clp END AS precio_clp) FROM listings)"),
    "a3_repeated_values": _sql("SELECT * FROM (SELECT 'fingerprint' AS kind, print AS value, count(*) AS n FROM fp WHERE print IS NOT NULL GROUP BY print HAVING count(*) >= 2 ORDER BY n DESC, value LIMIT 25) UNION ALL SELECT * FROM (SELECT 'url', url, count(*) AS n FROM fp GROUP BY url HAVING count(*) >= 2 ORDER BY n DESC, url LIMIT 20) UNION ALL SELECT * FROM (SELECT 'titulo', titulo, count(*) AS n FROM fp GROUP BY titulo HAVING count(*) >= 3 ORDER BY n DESC, titulo LIMIT 20)", "fp AS (SELECT *, CASE WHEN m2_construidos > 0 THEN lower(comuna) || '|m2:' || CAST(round_even(m2_construidos / 5, 0) * 5 AS INT) || '|d:' || coalesce(CAST(dormitorios AS VARCHAR), 'x') || '|b:' || coalesce(CAST(banos AS VARCHAR), 'x') || '|p:' || coalesce(CAST(estacionamientos AS VARCHAR), 'x') || '|t:' || array_to_string(list_filter(string_split(lower(titulo), ' '), lambda w: length(w) > 2)[1:6], '-') END AS print FROM listings)"),
    "a33_snapshot_alerts": "WITH r AS (SELECT year(o_orderdate) AS run, count(*) AS active FROM orders GROUP BY 1) SELECT a.run, a.active, b.active AS previous, round((a.active - b.active) / CAST(b.active AS DOUBLE) * 100, 6) AS variation_pct, coalesce(a.active < 0.8 * b.active, false) AS alert FROM r a LEFT JOIN r b ON b.run = a.run - 1",
    "w1_changed_prices": _sql(f"SELECT id AS listing_id, new AS precio_clp_nuevo, precio_clp AS precio_clp_anterior, day AS fecha_captura FROM (SELECT l.id, l.precio_clp, CASE l.id % 4 WHEN 0 THEN l.precio_clp WHEN 2 THEN h.clp ELSE l.precio_clp + 1 END AS new, CASE WHEN l.id % 4 = 2 THEN h.day ELSE l.fecha_captura END AS day, h.clp, h.day AS last_day, h.listing_id FROM listings l LEFT JOIN h ON h.listing_id = l.id) WHERE (id % 4 = 3 OR precio_clp IS DISTINCT FROM new) AND NOT (listing_id IS NOT NULL AND clp IS NOT DISTINCT FROM new AND last_day IS NOT DISTINCT FROM day)", f"h AS (SELECT listing_id, arg_max(precio_clp_nuevo, ROW({TIES})) AS clp, max(fecha_captura) AS day FROM history GROUP BY listing_id)"),
    "w8_representatives": _sql("SELECT id, is_duplicate, duplicate_group_id FROM mk WHERE duplicate_group_id IS NOT NULL", MARKED, True),
    "w12_duplicate_groups_greedy": _sql('SELECT id, grp AS "group" FROM gg', GREEDY, True),
    "w12_duplicate_groups": _sql(f'SELECT a AS id, min(z) AS "group" FROM rc GROUP BY a', f"{ELIGIBLE}, rc(a, z) AS (SELECT id, id FROM el UNION SELECT a.id, rc.z FROM rc JOIN el b ON b.id = rc.a JOIN el a ON a.comuna = b.comuna AND {SAME.format(a='a', b='b')})", True),
    "e11_marked_duplicates": _sql("SELECT status, is_duplicate, count(*) AS n, count(DISTINCT duplicate_group_id) AS groups FROM mk GROUP BY 1, 2", MARKED, True),
    "e2_ingested": _sql(f"SELECT l.id, l.fuente, CASE WHEN b.id IS NULL THEN l.precio_clp ELSE b.clp END AS precio_clp, CASE WHEN b.id IS NOT NULL AND (l.precio_clp IS DISTINCT FROM b.clp OR l.precio_uf IS DISTINCT FROM b.precio_uf) THEN l.precio_clp END AS precio_clp_anterior, CASE WHEN b.id IS NOT NULL AND (l.precio_clp IS DISTINCT FROM b.clp OR l.precio_uf IS DISTINCT FROM b.precio_uf) THEN b.clp END AS precio_clp_nuevo, CASE WHEN b.id IS NULL THEN l.status ELSE 'active' END AS status FROM ln l LEFT JOIN bt b ON b.target = l.id", f"{_LINKED}, v AS (SELECT *, CAST(trunc(precio_clp * 1.05::DOUBLE) AS BIGINT) AS clp FROM ln), bt AS (SELECT v.*, (SELECT min(x.id) FROM ln x WHERE x.fuente = v.fuente AND x.link = v.link) AS target FROM v WHERE m2_construidos > 0 AND (precio_uf > 0 OR (precio_uf IS NULL AND clp >= 10000000)) QUALIFY row_number() OVER (PARTITION BY fuente, link ORDER BY id DESC) = 1)"),
    "e12_maintained": _sql("SELECT k.id, CASE WHEN status = 'active' AND (NOT coalesce(m2_construidos BETWEEN 10 AND 1000, false) OR NOT (coalesce(precio_uf / m2_construidos BETWEEN 5 AND 300, false) OR coalesce(precio_clp / 37000.0 / m2_construidos BETWEEN 5 AND 300, false))) THEN 'invalid_data' ELSE status END AS status, nullif(coalesce(dormitorios, CAST(s_nationkey % 4 AS INT)), 0) AS dormitorios, nullif(estacionamientos, 0) AS estacionamientos, CASE WHEN coalesce(n, 0) > 0 THEN n ELSE CAST(precio_clp IS NOT NULL OR precio_uf IS NOT NULL AS BIGINT) END AS log_rows FROM kp k LEFT JOIN supplier ON s_suppkey = k.id LEFT JOIN lg ON lg.keep = k.id", f"{_LINKED}, w AS (SELECT *, min(id) OVER (PARTITION BY fuente, link) AS keep FROM ln), kp AS (SELECT * FROM w WHERE id = keep), lg AS (SELECT keep, count(*) AS n FROM history JOIN w ON w.id = listing_id GROUP BY keep)"),
    "e13_coordinate_counts": _sql("SELECT count(*) FILTER (todo AND (id % 3 = 0 OR (id % 3 = 2 AND id % 6 IN (0, 1)))) AS updated, count(*) FILTER (todo AND id % 3 = 1) AS skipped, count(*) FILTER (todo AND id % 3 = 2 AND id % 6 NOT IN (0, 1)) AS failed FROM (SELECT *, lat IS NULL OR lon IS NULL AS todo FROM listings)"),
    "c26_geocoded": _sql("SELECT id, round(CASE WHEN NOT todo THEN lat WHEN id % 6 = 0 THEN -33.456 WHEN id % 6 = 1 THEN -33.454 WHEN id % 2 = 0 THEN -33.4543 END, 6) AS lat, round(CASE WHEN NOT todo THEN lon WHEN id % 6 = 0 THEN -70.613 WHEN id % 6 = 1 THEN -70.575 WHEN id % 2 = 0 THEN -70.5936 END, 6) AS lon, CASE WHEN NOT todo THEN 'kept' WHEN id % 6 IN (0, 1) THEN 'place' WHEN id % 2 = 0 THEN 'centroid' ELSE 'unresolved' END AS resolution FROM (SELECT *, lat IS NULL OR lon IS NULL AS todo FROM listings)"),
}
