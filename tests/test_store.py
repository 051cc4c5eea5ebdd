"""Versioned tables, streams into them, and rates in time."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from predial.operators import ingest, rates
from predial.sources.store import Store
from predial.streaming.ingest import merge_epoch, stream_into
from tests.test_listings import frame, listing


def test_readers_see_whole_versions_only(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    with pytest.raises(ValueError):
        store.read("a")
    assert store.write({"a": spark.range(3)}, counts={"copied": 3, "skipped": 1}) == 1
    # A writer that dies after its data, and one that dies within its commit.
    spark.range(9).write.parquet(f"{store.root}/version-2-dead/a")
    (tmp_path / "s" / "commits" / "2.json").write_text('{"folder": "vers')
    assert store.read("a").count() == 3 and list(store.commits()) == [1] and store.commits()[1]["counts"] == {"copied": 3, "skipped": 1}
    assert store.write({"a": spark.range(5)}) == 3
    with pytest.raises(Exception, match="exist"):
        store.commit(3, {"folder": "x"})
    assert (store.read("a").count(), store.read("a", 1).count()) == (5, 3)
    assert len(store.clean(1)) == 2 and list(store.commits()) == [3] and store.read("a").count() == 5


def test_epochs_are_merged_once_and_as_the_batch_job_does(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    rows = [[listing(i, precio_clp=140_000_000 + 1_000_000 * k + i, m2_construidos=60.0 + 9 * i) for i in range(1 + k, 5 + k)] for k in range(3)]
    batches = [frame(spark, r).withColumn("arrival", F.col("id")).drop("id") for r in rows]
    none = spark.createDataFrame([], "listing_id long, precio_clp_anterior long, precio_uf_anterior double, precio_clp_nuevo long, precio_uf_nuevo double, fecha_captura date")
    store.write({"listings": frame(spark, [listing(1)]), "log": none})
    want, log = frame(spark, [listing(1)]), none
    for k, batch in enumerate(batches):
        batch.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        want, new = ingest.upsert(want, batch, "2001-12-01", history=log)
        log = log.unionByName(new.select(log.columns))
    stream_into(store, str(tmp_path / "in"), batches[0].schema, "2001-12-01", 1, str(tmp_path / "checkpoint"), timeout=300)
    shown = lambda df: sorted(map(tuple, df.select("id", "precio_clp", "m2_construidos", "status").collect()))
    assert shown(store.read("listings")) == shown(want) and store.read("log").count() == log.count()
    before = max(store.commits())
    assert merge_epoch(store, batches[2], 2, "2001-12-01") < before  # the epoch is there: nothing happens
    assert max(store.commits()) == before and store.read("log").count() == log.count()


def test_rates_are_those_known_at_the_time(spark):
    at = lambda d, h: dt.datetime(2001, 12, d, h)
    quotes = spark.createDataFrame([(at(2, 0), 10.0), (at(2, 0), 11.0), (at(2, 6), None), (at(4, 23), 12.0), (at(5, 1), -1.0), (None, 5.0)], "ts timestamp, valor double")
    rows = spark.createDataFrame([(1, at(1, 5)), (2, at(2, 0)), (3, at(2, 12)), (4, at(2, 13)), (5, at(5, 2)), (6, at(9, 0)), (7, None), (5, at(5, 2))], "id long, seen timestamp")
    found = sorted((r.id, r.rate, r.rate_source) for r in rates.rates_in_time(rows, quotes, "seen").collect())
    assert found == [(1, 37000.0, "fixed"), (2, 11.0, "live"), (3, 11.0, "live"), (4, 11.0, "cached"), (5, 12.0, "live"), (5, 12.0, "live"), (6, 12.0, "cached"), (7, 37000.0, "fixed")]
    assert rates.rates_in_time(rows.limit(0), quotes, "seen").count() == 0
    assert {r.rate_source for r in rates.rates_in_time(rows, quotes.limit(0), "seen").collect()} == {"fixed"}
