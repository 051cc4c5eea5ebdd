"""Cleaning a batch of scraped listings."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions import extract
from ..functions.prices import fill_currencies
from ..functions.text import clean_text, float_or_null, non_negative_int, positive_number, price_text, standard_comuna
from .quality import clean_valid, comuna_outliers

TEXT = ("titulo", "descripcion", "precio_texto", "comuna", "url", "link", "source_listing_id", "fuente")
ROOMS = ("dormitorios", "banos", "estacionamientos")
NUMBERS = ("precio_clp", "precio_uf", "m2", "m2_construidos", "m2_terreno", "m2_util", "m2_total")


def normalise(rows: DataFrame) -> DataFrame:
    """Text fields cleaned, numbers of every class parsed; fields that the rows lack are left out."""
    have = lambda names: [c for c in names if c in rows.columns]
    changes = {c: clean_text(F.col(c)) for c in have(TEXT)}
    changes |= {c: positive_number(rows, c) for c in have(NUMBERS)}
    changes |= {c: positive_number(rows, c).cast("int") for c in have(("dormitorios", "banos"))}
    changes |= {c: non_negative_int(F.col(c)) for c in have(("estacionamientos",))} | {c: float_or_null(F.col(c)) for c in have(("lat", "lon"))}
    return rows.withColumns(changes)


def enrich(rows: DataFrame) -> DataFrame:
    """Missing room numbers and areas from title and description; low confidence is not believed for rooms."""
    text = F.concat_ws(" ", *[c for c in ("titulo", "descripcion") if c in rows.columns])
    found = rows.withColumn("__rooms", extract.rooms(text)).withColumn("__area", extract.area(text))
    fill = {c: F.coalesce(c, F.when(F.col(f"__rooms.{c}_confidence") != "low", F.col(f"__rooms.{c}"))) for c in ROOMS}
    known = [F.col(c) for c in ("m2_construidos", "m2", "m2_util", "m2_total") if c in rows.columns]
    source = F.when(F.coalesce(*known).isNotNull(), "field").when(F.col("__area.m2").isNotNull(), "text")
    return found.withColumns({**fill, "m2_source": source, "m2_confidence": F.when(F.coalesce(*known).isNull(), F.col("__area.confidence")), "m2_construidos": F.coalesce(*known, F.col("__area.m2").cast("double"))}).drop("__rooms", "__area")


def clean(rows: DataFrame, cfg: Config = DEFAULT, outliers: bool = True) -> DataFrame:
    """Text, numbers, rooms, commune, area, prices; invalid rows out, then each commune's price outliers."""
    done = enrich(normalise(rows)).withColumn("comuna", standard_comuna(F.col("comuna")))
    text = price_text(F.col("precio_texto")) if "precio_texto" in rows.columns else None
    done = done.withColumns(fill_currencies(cfg, text)).where(clean_valid(cfg)).withColumn("uf_m2", F.col("precio_uf") / F.col("m2_construidos"))
    return comuna_outliers(done).where("keep").drop("keep", "uf_m2") if outliers else done.drop("uf_m2")
