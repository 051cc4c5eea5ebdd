"""Views that give the driver's tables the shapes of listings, price logs, watchlists and source runs.

The SQL texts run unchanged on Spark and on DuckDB; {part} and the like stand for the tables.
"""

from pyspark.sql import DataFrame, SparkSession

AS_OF = "2001-12-01"

LISTINGS = """
WITH b AS (
  SELECT p_partkey AS id, p_type AS comuna, p_name, p_size,
    CASE WHEN p_partkey % 53 = 0 THEN NULL WHEN p_partkey % 59 = 0 THEN CAST(8 AS DOUBLE)
         ELSE CAST(20 + 3 * p_size AS DOUBLE) END AS m2,
    p_retailprice * 1000 * (2 + ((p_partkey * 7) % 13) / CAST(4 AS DOUBLE))
      * CASE WHEN p_partkey % 97 = 0 THEN CAST(10 AS DOUBLE)
             WHEN p_partkey % 89 = 0 THEN CAST(0.1 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS ppm2,
    CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE CAST(1 + p_partkey % 4 AS INT) END AS dormitorios,
    CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE CAST(1 + p_partkey % 3 AS INT) END AS banos,
    CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE CAST(p_partkey % 3 AS INT) END AS estacionamientos
  FROM {part})
SELECT id,
  CASE WHEN id % 2 = 0 THEN 'yapo' ELSE 'portalinmobiliario' END AS fuente,
  'MLC-' || CAST(id + 100000 AS VARCHAR(20)) AS source_listing_id,
  'https://Example.com/bienes-raices/' || CAST(id - id % 3 + 100000 AS VARCHAR(20)) || '/?ref=' || CAST(id % 3 AS VARCHAR(20)) AS url,
  CASE WHEN id % 13 = 0 THEN 'inactive' ELSE 'active' END AS status,
  p_name || CASE id % 6 WHEN 0 THEN ' cerca metro' WHEN 1 THEN ' plaza egana' ELSE '' END
         || ' ' || CAST(20 + 3 * p_size AS VARCHAR(20)) || ' m2 '
         || CAST(1 + id % 4 AS VARCHAR(20)) || 'D/' || CAST(1 + id % 3 AS VARCHAR(20)) || 'B' AS titulo,
  comuna,
  CASE WHEN id % 4 = 0 THEN NULL ELSE -33.40 - (id % 100) / CAST(1000 AS DOUBLE) END AS lat,
  CASE WHEN id % 4 = 0 THEN NULL ELSE -70.55 - (id % 70) / CAST(1000 AS DOUBLE) END AS lon,
  CASE WHEN id % 3 <> 0 THEN CAST(floor(ppm2 * coalesce(m2, 100)) AS BIGINT) END AS precio_clp,
  CASE WHEN id % 3 = 0 THEN floor(ppm2 * coalesce(m2, 100) / 370) / 100 END AS precio_uf,
  m2 AS m2_construidos, dormitorios, banos, estacionamientos,
  CASE WHEN id % 10 = 0 THEN NULL ELSE DATE '2001-12-01' - CAST(id % 150 AS INT) END AS fecha_publicacion,
  DATE '2001-12-01' - CAST(id % 40 AS INT) AS fecha_captura,
  DATE '2001-12-01' - CAST(id % 20 AS INT) AS last_seen
FROM b
"""

HISTORY = """
SELECT row_number() OVER (ORDER BY l_shipdate, l_partkey, l_orderkey, l_linenumber, l_suppkey, l_quantity, l_extendedprice) AS id,
  l_partkey AS listing_id,
  CAST(l_shipdate AS DATE) AS fecha_captura,
  CAST(floor(coalesce(CAST(x.precio_clp AS DOUBLE), x.precio_uf * 37000) * (0.9 + 0.005 * l_quantity)) AS BIGINT) AS precio_clp_nuevo
FROM {lineitem} JOIN {listings} x ON x.id = l_partkey
WHERE l_linenumber <= 2
"""

#: The same log without the global numbering; ties are broken by the same columns within a listing.
HISTORY_KEYED = """
SELECT l_partkey AS listing_id, CAST(l_shipdate AS DATE) AS fecha_captura,
  CAST(floor(coalesce(CAST(x.precio_clp AS DOUBLE), x.precio_uf * 37000) * (0.9 + 0.005 * l_quantity)) AS BIGINT) AS precio_clp_nuevo,
  l_orderkey, l_linenumber, l_suppkey, l_quantity, l_extendedprice
FROM {lineitem} JOIN {listings} x ON x.id = l_partkey
WHERE l_linenumber <= 2
"""

RUNS = """
SELECT event_type AS source, CAST(ts AS DATE) AS run, count(*) AS raw_rows,
  sum(CASE WHEN value > 5 THEN 1 ELSE 0 END) AS valid_rows, 20 AS expected_min_valid
FROM {events} GROUP BY event_type, CAST(ts AS DATE)
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(LISTINGS, part=table(spark, sf_dir, "part"))


def price_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The price log keyed by its tie-breaking columns, so that no global numbering is needed."""
    return spark.sql(HISTORY_KEYED, lineitem=table(spark, sf_dir, "lineitem"), listings=listings(spark, sf_dir))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(RUNS, events=table(spark, sf_dir, "events"))


#: The same views as common table expressions for DuckDB.
CTE = f"listings AS ({LISTINGS.format(part='part')}), history AS ({HISTORY_KEYED.format(lineitem='lineitem', listings='listings')}), runs AS ({RUNS.format(events='events')})"
