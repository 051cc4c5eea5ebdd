"""DuckDB SQL of the queries that SQL can express; views as in sources.views."""

from ..sources.views import CTE
from . import forms, jobs

ACCENTED, PLAIN = "áàäâãéèëêíìïîóòöôõúùüûñçÁÀÄÂÃÉÈËÊÍÌÏÎÓÒÖÔÕÚÙÜÛÑÇ", "aaaaaeeeeiiiiooooouuuuncAAAAAEEEEIIIIOOOOOUUUUNC"
ASK = "CASE WHEN precio_uf > 0 THEN precio_uf * 37000.0 WHEN precio_clp > 0 THEN CAST(precio_clp AS DOUBLE) END"
ASK_UF = "CASE WHEN precio_uf > 0 THEN precio_uf WHEN precio_clp > 0 THEN precio_clp / 37000.0 END"
QUALITY = "CASE WHEN precio_clp > 0 THEN CAST(precio_clp AS DOUBLE) WHEN precio_uf > 0 THEN precio_uf * 38000.0 END"
SEGMENT = "CASE WHEN {m} IS NULL THEN 'standard_apartment' WHEN {m} < 50 THEN 'small_apartment' WHEN {m} <= 100 THEN 'standard_apartment' ELSE 'large_apartment' END"
LINK = "regexp_replace(regexp_extract(url, '^([A-Za-z]+://[^/?#]*)', 1), 'Example', 'example') || regexp_replace(regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), '/+$', '')"
SPACE = r"\s+"


def _sql(body: str, extra: str = "", recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' * recursive}{CTE}{', ' + extra if extra else ''} {body}"


PRICED = f"q AS (SELECT *, {QUALITY} AS quality, CASE WHEN m2_construidos > 0 THEN ({QUALITY}) / m2_construidos END AS ppm2 FROM listings)"
ISSUES = """i AS (SELECT *, list_filter([
  CASE WHEN quality IS NULL THEN 'missing_price' END,
  CASE WHEN m2_construidos IS NULL OR m2_construidos <= 0 THEN 'missing_m2' END,
  CASE WHEN m2_construidos > 0 AND NOT m2_construidos BETWEEN 20 AND 500 THEN 'invalid_m2_range' END,
  CASE WHEN NOT (coalesce(dormitorios > 0, false) OR coalesce(banos > 0, false)) THEN 'missing_basic_attributes' END,
  CASE WHEN lower(trim(coalesce(comuna, ''))) IN ('', 'desconocida') THEN 'unknown_comuna' END,
  CASE WHEN ppm2 IS NULL OR NOT ppm2 BETWEEN 500000 AND 10000000 THEN 'invalid_precio_m2' END], lambda x: x IS NOT NULL) AS issues FROM q),
u AS (SELECT *, NOT list_has_any(issues, ['missing_price', 'missing_m2', 'invalid_m2_range', 'invalid_precio_m2']) AS usable FROM i)"""
BASE = f"{PRICED}, {ISSUES}"

PAIRS = f"""
t AS (SELECT * FROM u WHERE m2_construidos BETWEEN 10 AND 1000 AND {{targets}}),
c AS (SELECT *, {ASK} AS price FROM u WHERE status = 'active' AND m2_construidos BETWEEN 10 AND 1000 AND (precio_clp IS NOT NULL OR precio_uf IS NOT NULL)),
pairs AS (
  SELECT t.id AS t_id, t.comuna AS t_comuna, t.m2_construidos AS tm, t.dormitorios AS td, t.banos AS tb, t.estacionamientos AS te, t.lat AS tlat, t.lon AS tlon,
    c.id AS c_id, c.m2_construidos AS cm, c.dormitorios AS cd, c.banos AS cb, c.estacionamientos AS ce, c.lat AS clat, c.lon AS clon, c.titulo, c.price, c.usable,
    {SEGMENT.format(m='t.m2_construidos')} = {SEGMENT.format(m='c.m2_construidos')} AS same_segment
  FROM t JOIN c ON t.comuna = c.comuna AND t.id <> c.id AND c.m2_construidos BETWEEN t.m2_construidos * 0.85 AND t.m2_construidos * 1.15
    AND ({SEGMENT.format(m='t.m2_construidos')} = {SEGMENT.format(m='c.m2_construidos')} OR {SEGMENT.format(m='t.m2_construidos')} = 'standard_apartment' OR {SEGMENT.format(m='c.m2_construidos')} = 'standard_apartment')
    AND (t.dormitorios IS NULL OR c.dormitorios IS NULL OR c.dormitorios BETWEEN greatest(t.dormitorios - 1, 0) AND t.dormitorios + 1)
    AND (t.banos IS NULL OR c.banos IS NULL OR c.banos BETWEEN greatest(t.banos - 1, 0) AND t.banos + 1)
    AND (t.estacionamientos IS NULL OR c.estacionamientos IS NULL OR c.estacionamientos BETWEEN greatest(t.estacionamientos - 1, 0) AND t.estacionamientos + 1))"""


def _like(t: str, c: str, w: float) -> str:
    return f"CASE WHEN {t} IS NULL THEN 0 ELSE coalesce(CASE WHEN {t} > 0 AND {c} IS NOT NULL THEN greatest(least(1 - abs({t} - {c}) / CAST(greatest({t}, 1) AS DOUBLE), 1), 0) END, 0) * {w} END"


KM = "2 * 6371.0 * asin(sqrt(pow(sin(radians(clat - tlat) / 2), 2) + cos(radians(tlat)) * cos(radians(clat)) * pow(sin(radians(clon - tlon) / 2), 2)))"
SCORED = f"""
s0 AS (SELECT *, {KM} AS km, price / cm AS price_m2 FROM {{source}} WHERE abs(cm - tm) / tm <= 0.30 AND coalesce(abs(cd - td) <= 1, true) AND coalesce(abs(cb - tb) <= 1, true) AND price IS NOT NULL),
s1 AS (SELECT *, ({_like('tm', 'cm', 0.35)} + {_like('td', 'cd', 0.15)} + {_like('tb', 'cb', 0.15)} + {_like('te', 'ce', 0.10)}
    + CASE WHEN tlat IS NULL OR tlon IS NULL THEN 0 ELSE coalesce(CASE WHEN km <= 0.5 THEN 1 WHEN km >= 10 THEN 0 ELSE 1 - (km - 0.5) / 9.5 END, 0) * 0.25 END)
  / (0.35 + CASE WHEN td IS NULL THEN 0 ELSE 0.15 END + CASE WHEN tb IS NULL THEN 0 ELSE 0.15 END + CASE WHEN te IS NULL THEN 0 ELSE 0.10 END + CASE WHEN tlat IS NULL OR tlon IS NULL THEN 0 ELSE 0.25 END) AS raw
  FROM s0 WHERE price_m2 / 37000.0 BETWEEN 5 AND 300),
s AS (SELECT *, CASE WHEN same_segment THEN raw ELSE greatest(raw - 0.10, 0) END AS score FROM s1)"""

MARKET = f"""
k AS (SELECT *, row_number() OVER (PARTITION BY t_id, same_segment ORDER BY abs(cm - tm), c_id) AS r1, row_number() OVER (PARTITION BY t_id ORDER BY abs(cm - tm), c_id) AS r2 FROM pairs),
k1 AS (SELECT *, same_segment AND r1 <= 150 AND usable AS strict, r2 <= 150 AND usable AS wide FROM k),
k2 AS (SELECT *, count(*) FILTER (strict) OVER w AS n1, count(*) FILTER (wide) OVER w AS n2 FROM k1 WINDOW w AS (PARTITION BY t_id)),
k3 AS (SELECT *, abs(cm - tm) / tm <= 0.15 AND coalesce(abs(cb - tb) <= 1, true) AS fits FROM k2 WHERE CASE WHEN n1 < 3 AND n2 > n1 THEN wide ELSE strict END),
k4 AS (SELECT *, coalesce(fits AND cd = td, false) AS equal, coalesce(fits AND abs(cd - td) <= 1, false) AS close FROM k3),
k5 AS (SELECT *, count(*) FILTER (equal) OVER w AS ne, count(*) FILTER (close) OVER w AS nc, count(*) OVER w AS na FROM k4 WINDOW w AS (PARTITION BY t_id)),
k6 AS (SELECT *, CASE WHEN ne >= 5 THEN 0 WHEN nc >= 5 THEN 1 WHEN na >= 3 THEN 2 ELSE 0 END AS mode FROM k5),
k7 AS (SELECT * FROM k6 WHERE CASE mode WHEN 0 THEN equal WHEN 1 THEN close ELSE true END),
k8 AS (SELECT *, count(*) OVER (PARTITION BY t_id) AS nk FROM k7),
k9 AS (SELECT * FROM k8 WHERE nk >= 3),
{SCORED.format(source='k9')},
v0 AS (SELECT *, count(*) FILTER (score >= 0.40) OVER (PARTITION BY t_id) AS n40 FROM s),
v1 AS (SELECT * FROM v0 WHERE score >= 0.40 OR (n40 < 3 AND score >= 0.25)),
v2 AS (SELECT *, count(*) OVER w AS nv, quantile_cont(price_m2, 0.33) OVER w AS p33, quantile_cont(price_m2, 0.66) OVER w AS p66,
    first_value(price_m2) OVER (PARTITION BY t_id ORDER BY score DESC, c_id) AS best FROM v1 WINDOW w AS (PARTITION BY t_id)),
v3 AS (SELECT *, abs(CASE WHEN price_m2 <= p33 THEN 0 WHEN price_m2 <= p66 THEN 1 ELSE 2 END - CASE WHEN best <= p33 THEN 0 WHEN best <= p66 THEN 1 ELSE 2 END) AS apart FROM v2 WHERE nv >= 3),
v4 AS (SELECT * EXCLUDE (score), CASE apart WHEN 0 THEN 1.0 WHEN 1 THEN 0.90 ELSE 0.75 END AS penalty,
    CASE WHEN mode > 0 AND td IS NOT NULL AND NOT coalesce(cd = td, false) THEN score * 0.90 ELSE score END AS score FROM v3),
w0 AS (SELECT *, row_number() OVER (PARTITION BY t_id ORDER BY score DESC, c_id) AS rk FROM v4),
w1 AS (SELECT *, quantile_cont(price_m2, 0.5) OVER (PARTITION BY t_id) AS mid, count(*) OVER (PARTITION BY t_id) AS n FROM w0 WHERE rk <= 10),
w2 AS (SELECT *, count(*) FILTER (price_m2 BETWEEN mid * 0.5 AND mid * 1.5) OVER (PARTITION BY t_id) AS inside FROM w1),
w3 AS (SELECT * FROM w2 WHERE n < 3 OR inside < 3 OR price_m2 BETWEEN mid * 0.5 AND mid * 1.5),
w4 AS (SELECT *, quantile_cont(price_m2, 0.25) OVER (PARTITION BY t_id) AS q1, quantile_cont(price_m2, 0.75) OVER (PARTITION BY t_id) AS q3, count(*) OVER (PARTITION BY t_id) AS n_b FROM w3),
w5 AS (SELECT *, count(*) FILTER (price_m2 BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) OVER (PARTITION BY t_id) AS inside_b FROM w4),
w6 AS (SELECT * FROM w5 WHERE n_b < 3 OR q3 <= q1 OR inside_b < 3 OR price_m2 BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)),
x0 AS (SELECT *, greatest(0, least(1 - abs(cm - tm) / tm * 1.2, 1)) * CASE WHEN cd IS NULL OR td IS NULL THEN 0.8 WHEN cd = td THEN 1 WHEN abs(cd - td) = 1 THEN 0.75 ELSE 0.4 END
    * CASE WHEN cb IS NULL OR tb IS NULL THEN 0.8 WHEN cb = tb THEN 1 WHEN abs(cb - tb) = 1 THEN 0.75 ELSE 0.4 END * greatest(score, 0.01)
    * least((CASE WHEN contains(lower(titulo), 'metro') THEN 1.03 ELSE 1 END) * (CASE WHEN contains(lower(titulo), 'plaza') THEN 1.02 ELSE 1 END) * (CASE WHEN contains(lower(titulo), 'avenida') THEN 1.01 ELSE 1 END) * (CASE WHEN contains(lower(titulo), 'centro') THEN 1.01 ELSE 1 END), 1.05) * penalty AS base,
    count(*) OVER (PARTITION BY t_id) AS m FROM w6),
x1 AS (SELECT *, count(*) FILTER (base >= 0.02) OVER (PARTITION BY t_id) AS strong, row_number() OVER (PARTITION BY t_id, base >= 0.02 ORDER BY score DESC, c_id) AS again FROM x0),
x2 AS (SELECT * FROM x1 WHERE base >= 0.02 OR (strong < 5 AND again <= 5 - strong)),
x3 AS (SELECT *, pow(base, 1.2) / sum(pow(base, 1.2)) OVER (PARTITION BY t_id) AS weight, count(*) OVER (PARTITION BY t_id) AS nx, row_number() OVER (PARTITION BY t_id ORDER BY price_m2, c_id) AS asc_rank FROM x2),
x4 AS (SELECT *, sum(weight) OVER (PARTITION BY t_id ORDER BY asc_rank) AS run, sum(weight) OVER (PARTITION BY t_id) AS total, greatest(CAST(floor(nx * 0.1) AS INT), 1) AS cut FROM x3),
x5 AS (SELECT t_id, any_value(tm) AS m2, any_value(nx) AS comparable_count, any_value(m) AS before, avg(score) AS score_mean,
    sum(CASE WHEN nx < 5 OR nx - 2 * cut < 3 OR (asc_rank > cut AND asc_rank <= nx - cut) THEN price_m2 * weight END) / sum(CASE WHEN nx < 5 OR nx - 2 * cut < 3 OR (asc_rank > cut AND asc_rank <= nx - cut) THEN weight END) AS price_m2,
    min(CASE WHEN run >= total * 0.25 THEN price_m2 END) AS p25, min(CASE WHEN run >= total * 0.75 THEN price_m2 END) AS p75, avg(price_m2) AS mean, stddev_pop(price_m2) AS spread FROM x4 GROUP BY t_id),
x6 AS (SELECT *, CASE WHEN comparable_count < 3 THEN 0 ELSE greatest(least(score_mean * 0.5 + least(comparable_count / 10.0, 1) * 0.25 + greatest(1 - least(spread / mean / 0.35, 1), 0) * 0.25, 1), 0) END AS confidence_score FROM x5)"""
RADAR_TARGETS = "status = 'active' AND comuna IS NOT NULL AND (precio_clp IS NOT NULL OR precio_uf IS NOT NULL)"
TIES = "fecha_captura, l_orderkey, l_linenumber, l_suppkey, l_quantity, l_extendedprice, precio_clp_nuevo"
FIRST = f"f AS (SELECT listing_id, min(fecha_captura) AS day, arg_min(CASE WHEN precio_clp_nuevo > 0 THEN CAST(precio_clp_nuevo AS DOUBLE) ELSE -1 END, ROW({TIES})) AS price FROM history GROUP BY listing_id)"
HEALTH = """h AS (SELECT *, CASE WHEN raw_rows > 0 THEN valid_rows / CAST(raw_rows AS DOUBLE) ELSE 0 END AS validation_rate FROM runs),
h1 AS (SELECT *, CASE WHEN raw_rows = 0 THEN 'FAILED' WHEN validation_rate < 0.5 OR valid_rows < expected_min_valid THEN 'DEGRADED' ELSE 'OK' END AS status FROM h)"""
GONE = "least(greatest(0, date_diff('day', {d}, DATE '2001-12-01')), 1000000)"

ORACLES = {
    "s2_radar_candidates": _sql(f"SELECT id, comuna, round({ASK}, 6) AS ask_clp FROM listings WHERE status = 'active' AND comuna IS NOT NULL AND m2_construidos > 0 AND (precio_clp IS NOT NULL OR precio_uf IS NOT NULL)"),
    "s4_price_series": _sql("SELECT listing_id, fecha_captura, precio_clp_nuevo AS price FROM history WHERE precio_clp_nuevo IS NOT NULL"),
    "c1_clean_documents": f"SELECT doc_id, length(c) AS n, md5(c) AS digest FROM (SELECT doc_id, nullif(trim(regexp_replace(text, '{SPACE}', ' ', 'g')), '') AS c FROM documents)",
    "c2_match_keys": f"SELECT doc_id, md5(trim(regexp_replace(translate(lower(text), '{ACCENTED}', '{PLAIN}'), '{SPACE}', ' ', 'g'))) AS digest FROM documents",
    "c7_comunas": _sql("SELECT upper(comuna[1]) || lower(comuna[2:]) AS comuna, count(*) AS n FROM listings GROUP BY 1"),
    "c12_rooms_from_titles": "SELECT p_partkey AS id, CAST(1 + p_partkey % 4 AS INT) AS dormitorios, CAST(1 + p_partkey % 3 AS INT) AS banos, 'medium' AS confidence FROM part",
    "c14_area_from_titles": "SELECT p_partkey AS id, CAST(20 + 3 * p_size AS INT) AS m2, 'high' AS confidence FROM part",
    "c19_urls": _sql(f"SELECT id, {LINK} AS link, 'MLC-' || (id + 100000) AS sid, CAST(id - id % 3 + 100000 AS VARCHAR) AS from_url FROM listings"),
    "c34_prices": _sql(f"SELECT id, round({ASK}, 4) AS ask_clp, round({ASK_UF}, 4) AS ask_uf, round({QUALITY}, 4) AS quality_clp FROM listings"),
    "c37_size_classes": _sql(f"SELECT {SEGMENT.format(m='m2_construidos')} AS segment, CASE WHEN m2_construidos IS NULL THEN 'sin_dato' WHEN m2_construidos < 60 THEN 'pequeno' WHEN m2_construidos <= 100 THEN 'mediano' ELSE 'grande' END AS bucket, CASE WHEN m2_construidos IS NULL THEN 'sin_dato' WHEN m2_construidos < 50 THEN '<50' WHEN m2_construidos <= 100 THEN '50-100' ELSE '>100' END AS m2_range, count(*) AS n FROM listings GROUP BY 1, 2, 3"),
    "j1_comparable_candidates": _sql("SELECT t_id AS id, count(*) AS n, min(c_id) AS first_id, CAST(sum(c_id) AS BIGINT) AS sum_id FROM pairs WHERE same_segment AND usable GROUP BY 1", f"{BASE}, {PAIRS.format(targets=chr(39).join(['status = ', 'active', '']))}"),
    "j2_duplicate_pairs": _sql("SELECT a.id AS id, count(*) AS n, CAST(sum(b.id) AS BIGINT) AS sum_id FROM e a JOIN e b ON a.comuna = b.comuna AND a.id < b.id AND abs(a.m2_construidos - b.m2_construidos) <= greatest(a.m2_construidos, b.m2_construidos) * 0.10 AND abs(a.dormitorios - b.dormitorios) <= 1 AND abs(a.banos - b.banos) <= 1 AND coalesce(abs(a.estacionamientos - b.estacionamientos) <= 1, true) GROUP BY a.id", "e AS (SELECT * FROM listings WHERE status = 'active' AND m2_construidos > 0 AND dormitorios IS NOT NULL AND banos IS NOT NULL)"),
    "p3_pair_scores": _sql("SELECT t_id AS id, c_id, round(score, 6) AS score, round(price_m2, 4) AS price_m2 FROM s", f"{BASE}, {PAIRS.format(targets='true')}, p1 AS (SELECT * FROM pairs WHERE same_segment AND usable), {SCORED.format(source='p1')}"),
    "f3_issue_frequency": _sql("SELECT issue, count(*) AS n FROM (SELECT unnest(issues) AS issue FROM u) GROUP BY issue ORDER BY n DESC, issue LIMIT 10", BASE),
    "f4_usable": _sql("SELECT id, usable, CAST(len(issues) AS INT) AS issues FROM u", BASE),
    "f6_invalid_status": _sql("SELECT CASE WHEN status = 'active' AND (NOT coalesce(m2_construidos BETWEEN 10 AND 1000, false) OR NOT (coalesce(precio_uf / m2_construidos BETWEEN 5 AND 300, false) OR coalesce(precio_clp / 37000.0 / m2_construidos BETWEEN 5 AND 300, false))) THEN 'invalid_data' ELSE status END AS status, count(*) AS n FROM listings GROUP BY 1"),
    "f16_comuna_outliers": _sql("SELECT id, n < 4 OR coalesce(CASE WHEN q3 > q1 THEN x BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) ELSE x BETWEEN q2 * 0.5 AND q2 * 1.5 END, false) AS keep FROM (SELECT id, x, count(x) OVER w AS n, quantile_cont(x, 0.25) OVER w AS q1, quantile_cont(x, 0.5) OVER w AS q2, quantile_cont(x, 0.75) OVER w AS q3 FROM o WINDOW w AS (PARTITION BY comuna))", f"o AS (SELECT id, comuna, ({ASK_UF}) / m2_construidos AS x FROM listings)"),
    "f17_expired": _sql("SELECT CASE WHEN status = 'active' AND (last_seen IS NULL OR last_seen < DATE '2001-11-24') THEN 'inactive' ELSE status END AS status, count(*) AS n FROM listings GROUP BY 1"),
    "a1_status_counts": _sql("SELECT status, count(*) AS n, count(*) AS representatives FROM listings GROUP BY status"),
    "a2_duplicate_links": _sql(f"SELECT fuente, {LINK} AS link, count(*) AS n FROM listings GROUP BY 1, 2 HAVING count(*) >= 2 ORDER BY n DESC, fuente, link LIMIT 20"),
    "a4_data_sufficiency": _sql("SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS total_active, count(*) AS comunas, count(*) FILTER (n < 10) AS thin_comunas, coalesce(sum(n), 0) < 50 OR count(*) FILTER (n < 10) > count(*) / 2.0 OR count(*) = 0 AS low_data_mode FROM (SELECT comuna, count(*) AS n FROM listings WHERE status = 'active' AND comuna IS NOT NULL AND m2_construidos > 0 AND (precio_clp IS NOT NULL OR precio_uf IS NOT NULL) GROUP BY comuna)"),
    "a5_coverage": _sql("SELECT count(*) AS total, count(*) FILTER (usable) AS usable, count(*) FILTER (ppm2 BETWEEN 500000 AND 10000000) AS price_m2_valid, count(*) FILTER (NOT ppm2 BETWEEN 500000 AND 10000000) AS price_m2_invalid, count(*) FILTER (ppm2 IS NULL) AS price_m2_unknown, " + ", ".join(f"count(*) FILTER ({c} IS NULL) AS missing_{c}" for c in ("comuna", "m2_construidos", "dormitorios", "banos", "estacionamientos", "lat", "lon", "precio_clp", "precio_uf")) + " FROM u", BASE),
    "a6_price_outliers": _sql("SELECT id, comuna, round(ppm2, 4) AS price_m2, round(greatest(ppm2 / 10000000.0, 500000.0 / ppm2), 2) AS excess FROM q WHERE greatest(ppm2 / 10000000.0, 500000.0 / ppm2) > 1 ORDER BY greatest(ppm2 / 10000000.0, 500000.0 / ppm2) DESC, id LIMIT 20", PRICED),
    "a7_comuna_coverage": _sql("SELECT comuna, count(*) AS total, count(*) FILTER (status = 'active') AS active, round(quantile_cont(ppm2, 0.5), 4) AS median_price_m2, round(min(ppm2), 4) AS min_price_m2, round(max(ppm2), 4) AS max_price_m2, " + ", ".join(f"round(count({c}) / CAST(count(*) AS DOUBLE), 4) AS {c}_coverage" for c in ("dormitorios", "banos", "estacionamientos", "lat")) + ", count(*) < 3 AS small_group FROM q GROUP BY comuna", PRICED),
    "a20_source_health": _sql("SELECT source, run, raw_rows, CAST(valid_rows AS BIGINT) AS valid_rows, round(validation_rate, 6) AS validation_rate, status, array_to_string(list_filter([CASE WHEN raw_rows = 0 THEN 'no_rows' END, CASE WHEN status <> 'FAILED' AND validation_rate < 0.5 THEN 'low_validation_rate' END, CASE WHEN status <> 'FAILED' AND valid_rows < expected_min_valid THEN 'few_valid_rows' END], lambda x: x IS NOT NULL), ',') AS reasons FROM h1", HEALTH),
    "a21_iteration_summary": _sql("SELECT *, CASE WHEN failed = sources THEN 'failed' WHEN failed + degraded > 0 THEN 'partial' ELSE 'success' END AS run_status, valid_rows = 0 AS stop_early FROM (SELECT run, CAST(sum(raw_rows) AS BIGINT) AS raw_rows, CAST(sum(valid_rows) AS BIGINT) AS valid_rows, count(*) FILTER (status = 'FAILED') AS failed, count(*) FILTER (status = 'DEGRADED') AS degraded, count(*) AS sources FROM h1 GROUP BY run)", HEALTH),
    "w2_price_signals": _sql(f"SELECT x.id, round(CASE WHEN ask > 0 AND f.price > ask THEN (f.price - ask) / f.price ELSE 0 END, 6) AS price_drop_pct, CAST(greatest(date_diff('day', coalesce(fecha_publicacion, f.day, fecha_captura), DATE '2001-12-01'), 0) AS INT) AS time_on_market_days FROM (SELECT *, {ASK} AS ask FROM listings) x LEFT JOIN f ON f.listing_id = x.id", FIRST),
    "w9_exact_links": _sql(f"SELECT k.id, count(h.listing_id) AS log_rows FROM (SELECT min(id) AS id, fuente, link FROM (SELECT id, fuente, {LINK} AS link FROM listings) GROUP BY fuente, link) k JOIN (SELECT id AS member, fuente, {LINK} AS link FROM listings) m ON m.fuente = k.fuente AND m.link = k.link LEFT JOIN history h ON h.listing_id = m.member GROUP BY k.id"),
    "e4_market_values": _sql("SELECT t_id AS id, round(price_m2 * m2, 1) AS estimated_price, round(price_m2, 2) AS price_m2, round(p25 * m2, 1) AS min_price, round(p75 * m2, 1) AS max_price, round(confidence_score, 4) AS confidence_score, round(score_mean, 4) AS score_mean, CAST(comparable_count AS INT) AS comparable_count FROM x6 WHERE before >= 3 AND confidence_score >= 0.25", f"{BASE}, {PAIRS.format(targets=RADAR_TARGETS)}, {MARKET}"),
}

ORACLES |= forms.ORACLES | jobs.ORACLES
