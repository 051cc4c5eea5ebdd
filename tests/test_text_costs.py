"""Text rules on many rows: each text is looked through a few times, whatever number of characters the rules know."""

import time

import pytest
from pyspark.sql import functions as F

from predial.functions import extract, text
from predial.sources import pages

LONG = " 45 m² Ž½ ﬁn ﷺ "


def seconds(df) -> float:
    began = time.time()
    df.write.format("noop").mode("overwrite").save()
    return time.time() - began


def test_keys_of_many_marked_texts(spark):
    rows = spark.range(60_000, numPartitions=1).select(F.concat(F.col("id").cast("string"), F.lit(LONG)).alias("t"))
    assert rows.limit(1).select(text.match_key(F.col("t")).alias("k")).first().k == "0 45 m2 z1⁄2 fin صلى الله عليه وسلم"
    assert seconds(rows.select(text.match_key(F.col("t")))) < 15


def test_cards_are_read_once(spark):
    """Every fifth card shows no area, so that it stays for its title, commune and rooms."""
    card = F.concat(F.lit("Departamento amplio "), F.col("id").cast("string"), F.lit(" $ 352836000 "), F.when(F.col("id") % 5 > 0, "21 m2").otherwise(""), F.lit(" 2 dormitorios 2 baños en Las Condes"))
    found = spark.range(3_000).select(F.col("id").alias("page_id"), F.lit("https://a.cl").alias("url"), F.concat(F.lit("https://a.cl/x/"), F.col("id") + 100_000).alias("link"), F.concat(F.lit("Departamento amplio "), F.col("id").cast("string")).alias("title"), F.lit("$ 352836000").alias("price_text"), card.alias("raw_text"))
    rows = pages.card_rows(found).localCheckpoint()
    assert {(r.quality, r.m2_construidos, r.comuna, r.dormitorios, r.banos, r.estacionamientos): r.n for r in rows.groupBy("quality", "m2_construidos", "comuna", "dormitorios", "banos", "estacionamientos").agg(F.count("*").alias("n")).collect()} == {("standard", 21.0, "Las Condes", 2, 2, None): 2_400, ("low", None, "Las Condes", 2, 2, None): 600}
    assert seconds(pages.card_rows(found)) < 15


@pytest.mark.parametrize("raw, area, rooms", [
    ("superficie 80 m2 util 60 m2", 80.0, None), ("50 m2 construidos 70", 50.0, None), ("util 70 m2 total 90 m2", 70.0, None), ("m2 55 construida", 55.0, None), ("2 baños 3 dormitorios", None, 3), ("baños: 2 dormitorios: 3", None, 3), ("baños 2 dormitorios", None, None), ("dorm 4", None, 4)])
def test_what_stands_before_a_number_decides(spark, raw, area, rooms):
    row = spark.createDataFrame([(raw,)], "t string").select(extract.labelled_area(F.col("t")).alias("a"), extract.nearest_number(F.col("t"), "dormitorios").alias("d")).first()
    assert (row.a, row.d) == (area, rooms)
