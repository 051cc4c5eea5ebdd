"""Queries of the text and value rules: each part gives one of several written forms, and the SQL says what the rule must read from it."""

from pyspark.sql import functions as F

from ..functions import extract, geo, prices
from ..functions.text import clean_text, comuna_key, fingerprint, last_number_or_slug, locale_number, match_key, normal_url, non_negative_int, positive_int, float_or_null, price_text, source_id, standard_comuna, title_key
from ..operators import cleaning, ingest
from ..sources.views import CTE, listings, table

#: The numbers that forms are written with.
NUMBERS = "SELECT p_partkey AS id, CAST(1 + p_partkey % 6 AS INT) AS d, CAST(1 + p_partkey % 5 AS INT) AS b, CAST(p_partkey % 7 AS INT) AS e, CAST(20 + 3 * p_size AS INT) AS m, p_size FROM {part}"
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _text(parts: str) -> str:
    """'Depto {d} dorm' as an SQL expression over the numbers."""
    out = []
    for i, piece in enumerate(parts.replace("}", "{").split("{")):
        if piece:
            out.append(f"CAST({piece} AS VARCHAR(20))" if i % 2 else "'" + piece + "'")
    return " || ".join(out) if out else "''"


def _case(values: list[str]) -> str:
    return f"CASE id % {len(values)} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


def written(spark, sf_dir, columns: dict[str, list[str | None]]):
    """id and, for each column, one of its written forms (None: null)."""
    fields = ", ".join(f"{_case(['NULL' if f is None else _text(f) for f in forms])} AS {name}" for name, forms in columns.items())
    return spark.sql(f"WITH n AS ({NUMBERS}) SELECT id, {fields} FROM n", part=table(spark, sf_dir, "part"))


def register(name: str, forms: dict[str, list[str | None]], read, expected: dict[str, list[str]]) -> None:
    """A query that reads the forms, and SQL with what is expected of each form in order."""

    def query(spark, sf_dir):
        return read(written(spark, sf_dir, forms))

    QUERIES[name] = query
    ORACLES[name] = f"WITH n AS ({NUMBERS.format(part='part')}) SELECT id, " + ", ".join(f"{_case(values)} AS {column}" for column, values in expected.items()) + " FROM n"


def _null(kind: str = "INT") -> str:
    return f"CAST(NULL AS {kind})"


INT, DOUBLE, TEXT = _null(), _null("DOUBLE"), _null("VARCHAR")


def T():  # noqa: N802
    return F.col("t")



register("c3_comuna_keys", {"t": ["Ã‘uÃ±oa", "Ñuñoa", "  PROVIDENCIA ", "PeÃ±alolÃ©n", None, "Maipú", "San Joaquín {id}", "ﬁnca nº {d}"]}, lambda df: df.select("id", comuna_key(T()).alias("key")), {
    "key": ["'nunoa'", "'nunoa'", "'providencia'", "'penalolen'", "''", "'maipu'", "'san joaquin ' || id", "'finca no ' || d"]})
register("c4_numbers", {"t": ["{m}.500", "{m},5", "$ {m}.000.000", "-{m}", "sin precio", None, "UF {m}.250,75", "0"]}, lambda df: df.select("id", F.round(locale_number(T()), 4).alias("number"), positive_int(T()).alias("whole"), non_negative_int(T()).alias("natural"), F.round(float_or_null(T()), 4).alias("float")), {
    "number": ["m * 1000.0 + 500", "m + 0.5", "m * 1000000.0", DOUBLE, DOUBLE, DOUBLE, "m * 1000.0 + 250.75", DOUBLE],
    "whole": ["m", "m", INT, INT, INT, INT, INT, INT], "natural": ["m", "m", INT, INT, INT, INT, INT, "0"], "float": ["m + 0.5", "m + 0.5", DOUBLE, "CAST(-m AS DOUBLE)", DOUBLE, DOUBLE, DOUBLE, "0.0"]})
register("c7_comuna_names", {"t": ["nunoa", "Ñuñoa  Santiago", "PROVIDENCIA", "las condes", "Santiago Centro", "vitacura", "la reina", "MACUL", "la florida", "san miguel", "recoleta", "independencia", "Penalolen", "peñalolén santiago", "puente alto", "lo barnechea", "La Dehesa", "maipu", "villa ALEMANA", "  ", None]}, lambda df: df.select("id", standard_comuna(T()).alias("comuna")), {
    "comuna": ["'Ñuñoa'", "'Ñuñoa'", "'Providencia'", "'Las Condes'", "'Santiago'", "'Vitacura'", "'La Reina'", "'Macul'", "'La Florida'", "'San Miguel'", "'Recoleta'", "'Independencia'", "'Peñalolén'", "'Peñalolén'", "'Puente Alto'", "'Lo Barnechea'", "'Lo Barnechea'", "'Maipú'", "'Villa Alemana'", TEXT, TEXT]})
register("c11_prices_in_text", {"t": ["Vendo UF {m}.500 cerca", "{m}.500 UF metro", "precio $ {m}.000.000 fijo", "CLP {m}.000.000", "{m}000000 pesos", "CLF {m}", "sin precio {m}"]}, lambda df: df.withColumn("p", extract.price_in_text(T())).select("id", "p", extract.price_amounts(F.col("p"))[0].alias("clp"), F.round(extract.price_amounts(F.col("p"))[1], 4).alias("uf")), {
    "p": ["'UF ' || m || '.500'", "m || '.500 UF'", "'$ ' || m || '.000.000'", "'$ ' || m || '.000.000'", "'$ ' || m || '000000'", "'UF ' || m", TEXT],
    "clp": [_null("BIGINT"), _null("BIGINT"), "m * 1000000::BIGINT", "m * 1000000::BIGINT", "m * 1000000::BIGINT", _null("BIGINT"), _null("BIGINT")], "uf": ["m * 1000.0 + 500", "m * 1000.0 + 500", DOUBLE, DOUBLE, DOUBLE, "CAST(m AS DOUBLE)", DOUBLE]})
register("c10_price_texts", {"t": ["UF {m}.500,5", "$ {m}.000.000", "clp {m}000", "{m}", None]}, lambda df: df.select("id", price_text(T())[0].alias("clp"), F.round(price_text(T())[1], 4).alias("uf")), {
    "clp": [_null("BIGINT"), "m * 1000000::BIGINT", "m * 1000::BIGINT", _null("BIGINT"), _null("BIGINT")], "uf": ["m * 1000.0 + 500.5", DOUBLE, DOUBLE, DOUBLE, DOUBLE]})
_rooms = lambda df: df.select("id", extract.rooms(T()).alias("r")).select("id", "r.dormitorios", "r.banos", "r.estacionamientos", F.col("r.dormitorios_confidence").alias("dc"), F.col("r.banos_confidence").alias("bc"), F.col("r.estacionamientos_confidence").alias("ec"))
register("c12_room_forms", {"t": ["{d}D/{b}B/{e}E", "Depto {d} dormitorios {b} baños {e} estacionamientos", "Dormitorios: {d} Baños: {b} Estacionamiento: {e}", "{b}B/{e}E", "estacionamiento opcional", "{d} hab y 9 baños", "Venta con posibilidad de {e} estacionamientos", "7 dormitorios", "{d} dorm {b} banos opcion 1 estac", None]}, _rooms, {
    "dormitorios": ["d", "d", "d", INT, INT, "d", INT, INT, "d", INT], "banos": ["b", "b", "b", "b", INT, INT, INT, INT, "b", INT], "estacionamientos": ["e", "e", "e", "e", "1", INT, "e", INT, "1", INT],
    "dc": ["'medium'", "'high'", "'high'", TEXT, TEXT, "'high'", TEXT, TEXT, "'high'", TEXT], "bc": ["'medium'", "'high'", "'high'", "'medium'", TEXT, TEXT, TEXT, TEXT, "'high'", TEXT], "ec": ["'medium'", "'high'", "'high'", "'medium'", "'low'", TEXT, "'low'", TEXT, "'low'", TEXT]})
register("c14_area_forms", {"t": ["Depto {m} m2", "Depto de {m} m² en venta", "{m} mts2", "superficie: {m}", "construidos {m} y vista", "{m} m utiles", "Calle {m} casa", "precio {m}", "12{m}45 m2", "{m} metros cuadrados", "Piso {d}{d} torre {m}", None]}, lambda df: df.select("id", extract.area(T()).alias("a")).select("id", "a.m2", "a.confidence"), {
    "m2": ["m", "m", "m", "m", "m", "m", "m", INT, INT, "m", INT, INT], "confidence": ["'high'", "'high'", "'high'", "'medium'", "'medium'", "'medium'", "'low'", "'low'", "'low'", "'high'", "'low'", "'low'"]})
register("c15_labelled_areas", {"t": ["superficie util {m} m2 total 999 m2", "total 999 m2, construidos {m} m2", "{m} m2", "total: {m}", "sup. {m},5 m2", "sin dato", "5 m2", "util {m}, total 400 m2"]}, lambda df: df.select("id", extract.labelled_area(T()).alias("m2"), extract.first_area(T()).alias("first")), {
    "m2": ["CAST(m AS DOUBLE)", "CAST(m AS DOUBLE)", "CAST(m AS DOUBLE)", "CAST(m AS DOUBLE)", "m + 0.5", DOUBLE, DOUBLE, "CAST(m AS DOUBLE)"], "first": ["CAST(m AS DOUBLE)", "999.0", "CAST(m AS DOUBLE)", DOUBLE, "m + 0.5", DOUBLE, "5.0", "400.0"]})
register("c16_nearest_numbers", {"t": ["{d} dormitorios {b} banos", "dorm: {d} bano: {b}", "habitaciones {d}", "9 dormitorios", "{b} baños, {d} dorms", "dormitorios {d}"]}, lambda df: df.select("id", extract.nearest_number(T(), "dormitorios").alias("d"), extract.nearest_number(T(), "banos").alias("b")), {
    "d": ["d", "d", "d", INT, "d", "d"], "b": ["b", "b", INT, INT, "b", INT]})
register("c17_card_tails", {"t": ["Venta {m} m2 {d} dorm {b} banos {e} estac contactar 5 dorm", "{m} mts ver 3 banos", "sin area {d} dormitorios", "{d} dormitorios {m} m2 {b} banos"]}, lambda df: df.select("id", extract.card_rooms(T()).alias("r"), extract.tail_after_area(T()).alias("tail"), extract.result_rooms(T(), "dormitorios").alias("result_d")).select("id", "tail", "result_d", "r.*"), {
    "tail": ["' ' || d || ' dorm ' || b || ' banos ' || e || ' estac '", "' '", TEXT, "' ' || b || ' banos'"], "result_d": ["d", INT, "d", "d"], "dormitorios": ["d", INT, "d", "d"], "banos": ["b", "3", INT, "b"], "estacionamientos": ["CASE WHEN e > 0 THEN e END", INT, INT, INT]})
register("c18_comunas_in_text", {"t": ["Depto en Nunoa metro", "casa peñalolen", "LAS CONDES oriente", "rancagua {m}", "Metropolitana, Providencia", "Chile| Macul |x", None]}, lambda df: df.select("id", extract.comuna_in_text(T()).alias("comuna"), extract.comuna_in_location(T()).alias("place")), {
    "comuna": ["'Ñuñoa'", "'Peñalolén'", "'Las Condes'", TEXT, "'Providencia'", "'Macul'", TEXT], "place": [TEXT, TEXT, TEXT, TEXT, "'Providencia'", "'Macul'", TEXT]})
register("c20_source_ids", {"t": ["https://x.cl/mlc-{d}77", "https://x.cl/MLC_{m}", "https://x.cl/p/{id}00000", "https://x.cl/casa-bonita/", "HTTPS://Example.COM/", "https://a.cl/b/{m}//?q=12345#f", "https://a.cl/b;p=1", None]}, lambda df: df.select("id", source_id(T()).alias("sid"), last_number_or_slug(T()).alias("last"), normal_url(T()).alias("link")), {
    "sid": ["'mlc-' || d || '77'", "'MLC_' || m", "id || '00000'", TEXT, TEXT, "'12345'", TEXT, TEXT], "last": ["'mlc-' || d || '77'", "'MLC_' || m", "id || '00000'", "'casa-bonita'", TEXT, "CAST(m AS VARCHAR)", "'b'", TEXT],
    "link": ["'https://x.cl/mlc-' || d || '77'", "'https://x.cl/MLC_' || m", "'https://x.cl/p/' || id || '00000'", "'https://x.cl/casa-bonita'", "'https://example.com/'", "'https://a.cl/b/' || m", "'https://a.cl/b'", TEXT]})
register("c24_places", {"t": ["Cerca metro {m}", "vista plaza", "EGAÑA", "Av. Irarrázaval {m}", "los {m}", "Zañartu y San Eugenio", "nada {m}", None]}, lambda df: df.select("id", geo.place_in_title(T()).alias("place"), geo.place_position(T())["lat"].alias("lat"), geo.named_centroid(T())["lon"].alias("lon")), {
    "place": ["'metro nuble'", "'plaza egana'", "'plaza egana'", "'irarrazaval'", "'los leones'", "'san eugenio'", TEXT, TEXT], "lat": ["-33.456", "-33.454", "-33.454", "-33.455", "-33.42", "-33.459", DOUBLE, DOUBLE], "lon": [DOUBLE] * 8})
register("c25_centroids", {"t": ["Ñuñoa", "providencia", "LAS CONDES", "Vitacura", "Santiago", "Macul", "La Reina", "La Florida", "San Miguel", "Recoleta", "Independencia", "Peñalolén", "Puente Alto", "Otra"]}, lambda df: df.select("id", geo.centroid(T())["lat"].alias("lat"), geo.centroid(T())["lon"].alias("lon"), geo.named_centroid(T())["lat"].alias("map_lat"), geo.named_centroid(T())["lon"].alias("map_lon")), {
    "lat": ["-33.4543", "-33.4263", "-33.408", "-33.385", "-33.4489", "-33.487", *[DOUBLE] * 8], "lon": ["-70.5936", "-70.617", "-70.567", "-70.565", "-70.6693", "-70.599", *[DOUBLE] * 8],
    "map_lat": ["-33.456", DOUBLE, DOUBLE, "-33.386", "-33.448", "-33.487", "-33.441", "-33.522", "-33.496", "-33.406", "-33.414", "-33.486", "-33.616", DOUBLE], "map_lon": ["-70.597", DOUBLE, DOUBLE, "-70.573", "-70.669", "-70.599", "-70.535", "-70.598", "-70.651", "-70.642", "-70.665", "-70.533", "-70.575", DOUBLE]})


def _cleaned(df):
    done = cleaning.enrich(cleaning.normalise(df)).withColumns(prices.fill_currencies(text=price_text(F.col("precio_texto"))))
    return done.select("id", "titulo", "precio_clp", F.round("precio_uf", 4).alias("precio_uf"), "m2_construidos", "m2_source", "dormitorios", "banos", "estacionamientos")


register("c6_cleaned_fields", {
    "titulo": ["  Depto   {d}D/{b}B ", "Casa {m} m2 {d} dormitorios", "x", "opcion {e} estacionamientos"], "precio_clp": ["{m}.000.000", None, None, "abc"], "precio_uf": [None, "{m},5", None, None], "precio_texto": [None, None, "UF {m}", "$ {m}.000.000"],
    "m2_construidos": ["{m},5", None, None, "0"], "m2_total": [None, None, "{m}", None], "dormitorios": [None, "{b}", "0", "2,5"], "banos": ["3", None, "x", None], "estacionamientos": ["0", "-1", "2,0", None], "lat": ["-33,4", "x", None, "1"]}, _cleaned, {
    "titulo": ["'Depto ' || d || 'D/' || b || 'B'", "'Casa ' || m || ' m2 ' || d || ' dormitorios'", "'x'", "'opcion ' || e || ' estacionamientos'"],
    "precio_clp": ["m * 1000000::BIGINT", "CAST(floor((m + 0.5) * 37000) AS BIGINT)", "m * 37000::BIGINT", "m * 1000000::BIGINT"], "precio_uf": ["round(m * 1000000 / 37000.0, 4)", "m + 0.5", "CAST(m AS DOUBLE)", "round(m * 1000000 / 37000.0, 4)"],
    "m2_construidos": ["m + 0.5", "CAST(m AS DOUBLE)", "CAST(m AS DOUBLE)", DOUBLE], "m2_source": ["'field'", "'text'", "'field'", TEXT], "dormitorios": ["d", "b", INT, "2"], "banos": ["3", INT, INT, INT], "estacionamientos": ["0", INT, "2", INT]})


def c21_fingerprint_parts(spark, sf_dir):
    return listings(spark, sf_dir).select("id", fingerprint().alias("fingerprint"), title_key(F.col("titulo")).alias("title_key"))


def c2_plain_titles(spark, sf_dir):
    """Part names with accents and ligatures put in."""
    base = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat(F.translate("p_name", "aeioun", "áéîöúñ"), F.lit(" 45 m² Ž½ ﬁn  x ")).alias("t"))
    return base.select("id", match_key(F.col("t")).alias("key"), clean_text(F.col("t")).alias("clean"))


def c38_heuristic_prices(spark, sf_dir):
    base = table(spark, sf_dir, "part")
    price = prices.heuristic_price(F.col("p_retailprice") * 1000, F.col("p_size"), F.col("p_size") % 7, F.lit(0), F.col("p_partkey") % 40)
    return base.select(F.col("p_partkey").alias("id"), F.round(price, 2).alias("price"))


def s13_rates(spark, sf_dir):
    """Each day's rate of the listings: live where an order says one, else cached, else fixed."""
    orders = table(spark, sf_dir, "orders").groupBy(F.col("o_orderdate").cast("date").alias("day")).agg(F.max(F.when(F.col("o_orderkey") % 3 == 0, 37_000.0 + F.col("o_orderkey") % 500)).alias("live"), F.max(F.when(F.col("o_orderkey") % 2 == 0, 36_000.0)).alias("cached"))
    return orders.select("day", prices.uf_rate(F.col("live"), F.col("cached")).alias("rate"))


def c27_maintenance_fields(spark, sf_dir):
    """Zeros as nulls and links filled."""
    base = listings(spark, sf_dir).withColumns({"dormitorios": F.when(F.col("id") % 5 == 0, 0).otherwise(F.col("dormitorios")), "link": F.when(F.col("id") % 3 == 0, " ").when(F.col("id") % 3 == 1, F.concat(F.lit("l"), F.col("id").cast("string")))})
    base = base.withColumn("url", F.when(F.col("id") % 2 == 0, F.col("url")))
    return ingest.fill_links(ingest.zeros_to_null(base)).select("id", "dormitorios", "estacionamientos", "link", "url")


def c36_logged_prices(spark, sf_dir):
    """The price of a log's row with all four columns."""
    base = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), F.when(F.col("l_partkey") % 4 == 0, F.col("l_extendedprice")).alias("precio_clp_nuevo"), F.when(F.col("l_partkey") % 4 == 1, F.col("l_extendedprice")).alias("precio_clp"), F.when(F.col("l_partkey") % 4 == 2, F.col("l_quantity")).alias("precio_uf_nuevo"), F.when(F.col("l_partkey") % 8 == 3, F.col("l_quantity")).alias("precio_uf"))
    return base.select("id", "line", F.round(prices.historical_clp(base.columns), 2).alias("price"))


QUERIES |= {f.__name__: f for f in (c21_fingerprint_parts, c2_plain_titles, c38_heuristic_prices, s13_rates, c27_maintenance_fields, c36_logged_prices)}
_PLAIN = "lower(comuna) || '|m2:' || CAST(round_even(m2_construidos / 5, 0) * 5 AS INT) || '|d:' || coalesce(CAST(dormitorios AS VARCHAR), 'x') || '|b:' || coalesce(CAST(banos AS VARCHAR), 'x') || '|p:' || coalesce(CAST(estacionamientos AS VARCHAR), 'x')"
_WORDS = "array_to_string(list_filter(string_split(lower(titulo), ' '), lambda w: length(w) > 2 AND w NOT IN ('venta', 'vende', 'depto', 'departamento'))[1:6], '-')"
ORACLES |= {
    "c21_fingerprint_parts": f"WITH {CTE} SELECT id, CASE WHEN m2_construidos > 0 THEN {_PLAIN} || '|t:' || {_WORDS} END AS fingerprint, {_WORDS} AS title_key FROM listings",
    "c2_plain_titles": "SELECT p_partkey AS id, p_name || ' 45 m2 z1⁄2 fin x' AS key, translate(p_name, 'aeioun', 'áéîöúñ') || ' 45 m² Ž½ ﬁn x' AS clean FROM part",
    "c38_heuristic_prices": "SELECT p_partkey AS id, round(p_retailprice * 1000 + p_size * 650000 + (p_size % 7) * 120000 - (p_partkey % 40) * 500000, 2) AS price FROM part",
    "s13_rates": "SELECT CAST(o_orderdate AS DATE) AS day, coalesce(max(CASE WHEN o_orderkey % 3 = 0 THEN 37000.0 + o_orderkey % 500 END), max(CASE WHEN o_orderkey % 2 = 0 THEN 36000.0 END), 37000.0)::DOUBLE AS rate FROM orders GROUP BY 1",
    "c27_maintenance_fields": f"WITH {CTE}, z AS (SELECT id, CASE WHEN id % 5 <> 0 THEN dormitorios END AS dormitorios, nullif(estacionamientos, 0) AS estacionamientos, CASE WHEN id % 3 = 1 THEN 'l' || id END AS link, CASE WHEN id % 2 = 0 THEN url END AS url FROM listings) SELECT id, dormitorios, estacionamientos, coalesce(link, url) AS link, coalesce(url, link) AS url FROM z",
    "c36_logged_prices": "SELECT l_orderkey AS id, l_linenumber AS line, round(CASE l_partkey % 4 WHEN 0 THEN l_extendedprice WHEN 1 THEN l_extendedprice WHEN 2 THEN l_quantity * 37000 ELSE CASE WHEN l_partkey % 8 = 3 THEN l_quantity * 37000 END END, 2) AS price FROM lineitem",
}
