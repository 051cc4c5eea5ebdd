"""Greedy grouping as a sliding-window minimum, against the plain rule."""

import random
import sys

import pytest
from pyspark.sql import functions as F

from predial.operators import dedup
from tests.test_listings import frame, listing


def alike(a, b, tolerance):
    near = all(abs(a[c] - b[c]) <= 1 for c in ("dormitorios", "banos"))
    parking = a["estacionamientos"] is None or b["estacionamientos"] is None or abs(a["estacionamientos"] - b["estacionamientos"]) <= 1
    m, o = a["m2_construidos"], b["m2_construidos"]
    return near and parking and abs(m - o) <= max(m, o) * tolerance


def plain(rows, tolerance=0.10):
    groups: list[list[dict]] = []
    out = {}
    for row in sorted(rows, key=lambda r: (r["m2_construidos"], r["id"])):
        home = next((g for g in groups if any(alike(row, o, tolerance) for o in g)), None)
        if home is None:
            groups.append(home := [])
        home.append(row)
        out[row["id"]] = home[0]["id"]
    return out


@pytest.mark.parametrize("seed", range(3))
def test_groups_are_those_of_the_plain_rule(spark, seed):
    rng = random.Random(seed)
    areas = [40.0, 41.5, 45.0, 50.0, 60.0, 66.0, 72.6, 73.0, 90.0, 150.0]
    rows = [listing(i, m2_construidos=rng.choice([*areas, round(rng.uniform(38, 80), 1)]), dormitorios=rng.randint(0, 5), banos=rng.randint(1, 4), estacionamientos=rng.choice([None, 0, 1, 2, 3]), comuna=rng.choice(["Macul", "Ñuñoa"])) for i in rng.sample(range(1, 2000), 300)]
    want = {}
    for comuna in ("Macul", "Ñuñoa"):
        want |= plain([r for r in rows if r["comuna"] == comuna])
    assert {r.id: r.group for r in dedup.groups_greedy(frame(spark, rows)).collect()} == want


def test_a_million_rows_of_one_run_take_bounded_state():
    rng, groups, name = random.Random(1), dedup.OpenGroups(0.1), 0
    for area in range(4000, 12000, 40):
        for _ in range(1000):
            name += 1
            groups.place(area / 100, rng.randint(1, 4), rng.randint(1, 3), rng.choice((None, 0, 1, 2)), name)
    held = sum(len(m) for cell in groups.cells.values() for m in cell.values())
    assert held <= len(groups.names) * 48 and sys.getsizeof(groups.names) < 1 << 20


def test_a_module_that_cannot_be_imported_leaves_the_other_queries(monkeypatch):
    import __spark_entry__

    monkeypatch.setitem(sys.modules, "predial.llm.queries", None)
    assert "e5_radar" in __spark_entry__.queries() and "op1_vector_near_duplicates" not in __spark_entry__.queries() and "pipeline" not in __spark_entry__.queries()
    assert "e4_market_values" in __spark_entry__.oracle_sql()


def test_a_batch_passes_as_a_stream_and_not_as_one_frame_a_commune(spark):
    """Equal to one row after the other, over Arrow batches of a few rows each."""
    rng = random.Random(5)
    rows = [listing(i, comuna=rng.choice(["Macul", "Lampa", None]), m2_construidos=rng.choice([None, 50.0, 54.0, 60.0, 66.0, 90.0]), dormitorios=rng.choice([1, 2, 4, None]), banos=2, lat=rng.choice([None, -33.4]), source_listing_id=rng.choice([None, f"s{i}"])) for i in range(1, 200)]
    batch = frame(spark, rows).withColumn("arrival", F.col("id"))
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        found = dedup.batch_dedup(batch)
        got = {r.id: r.lat for r in found.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert "InPandas" not in found._jdf.queryExecution().toString()
    full = lambda r: sum(r.get(c) is not None for c in dedup.COMPLETE if c in batch.columns)
    want, kept = {}, {}
    records = [r.asDict() for r in batch.collect()]
    for row in sorted(records, key=lambda r: (not r["source_listing_id"], not (r.get("url") or r.get("link")), -full(r), r["id"])):
        if row["m2_construidos"] is None or row["dormitorios"] is None:
            want[row["id"]] = row["lat"]
            continue
        group = kept.setdefault(row["comuna"], [])
        home = next((k for k in group if dedup._near(k, row, 0.10)), None)
        if home is None:
            group.append(row)
        elif full(row) > full(home):
            home.update({c: row[c] for c in batch.columns if home[c] is None})
    want |= {k["id"]: k["lat"] for group in kept.values() for k in group}
    assert got == want
