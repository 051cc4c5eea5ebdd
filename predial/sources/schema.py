"""Schemas of the listing tables and projections onto them."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LISTING = {
    "id": "bigint", "property_id": "bigint", "fuente": "string", "source_listing_id": "string", "url": "string", "link": "string",
    "status": "string", "titulo": "string", "custom_name": "string", "comuna": "string", "lat": "double", "lon": "double",
    "precio_clp": "bigint", "precio_uf": "double", "m2_construidos": "double", "m2_terreno": "double", "m2_util": "double", "m2_total": "double",
    "dormitorios": "int", "banos": "int", "estacionamientos": "int", "fecha_publicacion": "date", "fecha_captura": "date", "last_seen": "timestamp",
    "property_fingerprint": "string", "is_duplicate": "boolean", "duplicate_group_id": "string",
}
PROPERTY = {
    "id": "bigint", "comuna": "string", "lat": "double", "lon": "double", "m2_construidos": "double", "m2_terreno": "double", "m2_util": "double",
    "m2_total": "double", "dormitorios": "int", "banos": "int", "estacionamientos": "int", "piscina": "boolean", "ano_construccion": "int",
}
PRICE_HISTORY = {
    "id": "bigint", "listing_id": "bigint", "precio_clp": "bigint", "precio_uf": "double", "precio_clp_anterior": "bigint", "precio_uf_anterior": "double",
    "precio_clp_nuevo": "bigint", "precio_uf_nuevo": "double", "fecha_captura": "date", "fecha_cambio": "timestamp",
}
#: Defaults of columns that may not be null.
DEFAULTS = {"status": "active", "is_duplicate": False, "fuente": "unknown"}


def conform(df: DataFrame, schema: dict[str, str], exprs: dict[str, Column] | None = None) -> DataFrame:
    """Project onto a schema: given expressions, else the column of that name, else null; defaults fill nulls."""
    exprs = exprs or {}
    columns = []
    for name, kind in schema.items():
        value = exprs.get(name, F.col(name) if name in df.columns else F.lit(None)).cast(kind)
        if name in DEFAULTS:
            value = F.coalesce(value, F.lit(DEFAULTS[name]).cast(kind))
        columns.append(value.alias(name))
    return df.select(columns)


def with_property(listings: DataFrame, properties: DataFrame) -> DataFrame:
    """Every listing with its property as a struct, null where it has none."""
    side = properties.select(F.col("id").alias("__pid"), F.struct("*").alias("property"))
    return listings.join(side, F.col("property_id") == F.col("__pid"), "left").drop("__pid")


def sample(df: DataFrame, defaults: dict[str, object], n: int = 10) -> DataFrame:
    """The first ``n`` active rows by id with the asked columns, absent ones replaced by their defaults."""
    active = df.where("status = 'active'") if "status" in df.columns else df
    ordered = active.orderBy("id") if "id" in df.columns else active
    return ordered.select([F.col(c) if c in df.columns else F.lit(v).alias(c) for c, v in defaults.items()]).limit(n)
