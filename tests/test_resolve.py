"""Batches whose rows are listings to each other, against a plain loop over one row after the other."""

import random

import pytest
from pyspark.sql import functions as F

from predial.operators import ingest, resolve
from predial.plans import jobs

FIELDS = "arrival long, fuente string, link string, url string, source_listing_id string, comuna string, m2_construidos double, dormitorios int, banos int, estacionamientos int, precio_clp long, precio_uf double, lat double, lon double, titulo string, fecha_publicacion date"
NAMES = [f.split()[0] for f in FIELDS.split(", ")]


def some_row(rng, n, batch):
    link = rng.choice([None, "https://a.cl/1", "https://a.cl/2", f"https://a.cl/x{rng.randint(1, 12)}"])
    link = link or (f"https://a.cl/own{n}-{batch}" if batch else None)
    return {
        "arrival": n, "fuente": rng.choice(["yapo", "otra"]), "link": link, "url": link, "source_listing_id": rng.choice([None, None, f"s{rng.randint(1, 9)}"]), "comuna": rng.choice(["Macul", "Ñuñoa", None]),
        "m2_construidos": rng.choice([50.0, 54.0, 57.0, 60.0, 66.0, 73.0, 80.0, 120.0, 131.0]), "dormitorios": rng.choice([1, 2, 3, 4, None]), "banos": rng.choice([1, 2, 3]), "estacionamientos": rng.choice([None, 0, 1, 2]),
        "precio_clp": 100_000_000 + n, "precio_uf": rng.choice([None, 3000.0]), "lat": rng.choice([None, -33.4]), "lon": None, "titulo": f"t{n}", "fecha_publicacion": None,
    }


def plain(listings, batch, tolerance=0.10):
    """One row after the other against all listings as they are by then."""
    state = {r["id"]: dict(r, seen=(0, r["id"] % 3)) for r in listings}
    top = max(state, default=0)

    def near(a, b):
        m, o = a["m2_construidos"], b["m2_construidos"]
        rooms = all(a[c] is not None and b[c] is not None and abs(a[c] - b[c]) <= 1 for c in ("dormitorios", "banos"))
        parking = a["estacionamientos"] is None or b["estacionamientos"] is None or abs(a["estacionamientos"] - b["estacionamientos"]) <= 1
        return bool(a["comuna"]) and a["comuna"] == b["comuna"] and abs(m - o) <= max(m, o) * tolerance and rooms and parking

    def rank(i):
        r = state[i]
        points = sum(r[c] is not None for c in ("precio_clp", "precio_uf", "lat", "lon", "m2_construidos", "dormitorios", "banos", "estacionamientos"))
        return points, bool(r["source_listing_id"]), bool(r["link"] or r["url"]), r["seen"], -i

    for row in sorted(batch, key=lambda r: r["arrival"]):
        hits = []
        for c in ("link", "url", "source_listing_id"):
            hits = hits or [i for i, r in state.items() if row[c] and r[c] == row[c] and r["fuente"] == row["fuente"]]
        if hits:
            home = min(hits)
        else:
            home = max((i for i, r in state.items() if near(r, row)), key=rank, default=None)
        old = state.get(home, {})
        home = top + 1 + row["arrival"] if home is None else home
        state[home] = {**row, "fuente": old.get("fuente", row["fuente"]), **{c: row[c] or old.get(c) for c in ("link", "url", "source_listing_id", "titulo")}, "seen": (1, row["arrival"])}
    return {i: (r["titulo"], r["m2_construidos"], r["link"], r["source_listing_id"], r["precio_clp"]) for i, r in state.items()}


@pytest.mark.parametrize("seed", range(4))
def test_rows_of_a_batch_meet_as_one_after_the_other(spark, seed):
    rng = random.Random(seed)
    listings = [{**some_row(rng, n, False), "id": n} for n in range(1, rng.choice([1, 40]))]
    batch = [some_row(rng, n, True) for n in rng.sample(range(1000), rng.choice([12, 70]))]
    current = spark.createDataFrame([(r["id"], *[r[c] for c in NAMES[1:]], "active") for r in listings], "id long, " + FIELDS.split(", ", 1)[1] + ", status string")
    current = current.withColumn("last_seen", F.timestamp_seconds(F.col("id") % 3)).withColumn("fecha_captura", F.lit(None).cast("date"))
    found, log = ingest.upsert(current, spark.createDataFrame([tuple(r[c] for c in NAMES) for r in batch], FIELDS).repartition(3), "2001-12-01")
    got = {r.id: (r.titulo, r.m2_construidos, r.link, r.source_listing_id, r.precio_clp) for r in found.collect()}
    assert got == plain(listings, batch)
    assert {r.listing_id for r in log.where("was_created").collect()} == set(got) - {r["id"] for r in listings} if "was_created" in log.columns else log.count() > 0


def test_areas_out_of_one_bucket_are_one_listing(spark):
    """70 and 73 m2 in one batch: one listing with the later row's area."""
    rows = [{**some_row(random.Random(1), n, True), "m2_construidos": m, "comuna": "Macul", "dormitorios": 2, "banos": 1, "estacionamientos": None, "fuente": "yapo", "source_listing_id": None, "titulo": f"otro {n}"} for n, m in ((1, 70.0), (2, 73.0), (3, 90.0))]
    for n, r in enumerate(rows):
        r["link"] = r["url"] = f"https://a.cl/casa/{n}"
    none = spark.createDataFrame([], "id long, " + FIELDS.split(", ", 1)[1] + ", status string, last_seen timestamp, fecha_captura date")
    found, log = ingest.upsert(none, spark.createDataFrame([tuple(r[c] for c in NAMES) for r in rows], FIELDS), "2001-12-01")
    assert sorted(r.m2_construidos for r in found.collect()) == [73.0, 90.0] and log.count() == 2


def test_area_runs_end_at_gaps(spark):
    areas = spark.createDataFrame([("a", 50.0), ("a", 55.0), ("a", 62.0), ("a", 56.0), ("b", 55.0)], "comuna_key string, m2_construidos double")
    runs = {(r.comuna_key, r.m2_construidos): r.node for r in resolve.area_runs(areas, 0.1).collect()}
    assert runs["a", 50.0] == runs["a", 55.0] == runs["a", 56.0] == runs["a", 62.0] != runs["b", 55.0]
    assert len({r.node for r in resolve.area_runs(areas.where("m2_construidos <> 55 and m2_construidos <> 56"), 0.1).collect()}) == 2


def test_empty_batches_and_snapshots(spark):
    none = spark.createDataFrame([], "id long, " + FIELDS.split(", ", 1)[1] + ", status string, last_seen timestamp, fecha_captura date")
    found, log = ingest.upsert(none, spark.createDataFrame([], FIELDS), "2001-12-01")
    assert found.count() == log.count() == 0
    assert "s7_batch_resolution" in jobs.QUERIES and "s7_batch_resolution" in jobs.ORACLES


def test_a_large_commune_is_replayed_by_shapes():
    """20,000 rows of one commune against 20,000 listings: a row costs shapes, not listings."""
    import time

    rng = random.Random(5)
    make = lambda kind, n: {"kind": kind, "n": n, "fuente": "f", "link": f"l{kind}-{n}", "url": None, "source_listing_id": None, "comuna_key": "macul", "m2_construidos": float(rng.randint(30, 200)), "dormitorios": rng.randint(1, 4), "banos": rng.randint(1, 3), "estacionamientos": rng.choice([None, 0, 1]), "precio_clp": 1, "precio_uf": None, "has_lat": rng.random() < 0.5, "has_lon": True, "seen": float(rng.randint(0, 9))}
    rows = [make(k, n) for k in (0, 1) for n in range(20_000)]
    began = time.time()
    assert len(resolve.replay(rows, 0.1, 10.0, False)) == 20_000
    assert time.time() - began < 60


@pytest.mark.parametrize(("seed", "fresh"), [(1, 0), (2, 3), (3, 40)])
def test_rows_of_known_links_meet_by_names_alone(spark, seed, fresh):
    """Two communes without gaps in area; of the first's rows some have new links, of the second's none."""
    rng = random.Random(seed)

    def entity(kind, n, comuna, link):
        return (kind, n, "yapo", link, None, rng.choice([None, f"s{rng.randrange(60)}"]), comuna, 100, None, float(rng.randrange(40, 80)), 2, rng.choice([1, 2]), rng.choice([None, 1]), True, False, float(rng.randrange(9)) if kind == 0 else 0.0)

    fields = "kind int, n long, fuente string, link string, url string, source_listing_id string, comuna_key string, precio_clp long, precio_uf double, m2_construidos double, dormitorios int, banos int, estacionamientos int, has_lat boolean, has_lon boolean, seen double"
    known = [entity(0, i, "ab"[i % 2], f"l{i}") for i in range(1, 121)]
    new = [entity(1, i, "ab"[i % 2], f"new{i}" if i % 2 == 0 and i // 2 <= fresh else f"l{rng.randrange(1, 61) * 2 - 1 + (i + 1) % 2}") for i in range(1, 101)]
    # Source ids of one commune stay in it.
    known, new = ([(*r[:5], r[5] and r[6] + r[5], *r[6:]) for r in side] for side in (known, new))
    rows, listings = spark.createDataFrame(new, fields), spark.createDataFrame(known, fields)
    placed = {(r.kind, r.n): r.component for r in resolve.meeting(rows, listings, 0.1).collect()}
    names = [x.split()[0] for x in fields.split(", ")]
    every = [dict(zip(names, r)) for r in known + new]
    want = sorted(resolve.replay(every, 0.1, 99.0, False))
    groups = {}
    for r in every:
        if r["kind"] == 1 or (0, r["n"]) in placed:
            groups.setdefault(placed.get((r["kind"], r["n"]), ("alone", r["n"])), []).append(r)
    got = [x for g in groups.values() for x in resolve.replay(g, 0.1, 99.0, False)]
    assert sorted(got) == want
    # Without a new link nobody's area counts: only names connect.
    assert all(len({r["comuna_key"] for r in group}) == 1 for group in groups.values())
    taken = {(c, r[c]) for r in every for c in ("link", "source_listing_id") if r["kind"] == 1 and r[c]}
    bare = [r["n"] for r in every if r["kind"] == 0 and r["comuna_key"] == "b" and not any((c, r[c]) in taken for c in ("link", "source_listing_id"))]
    assert bare and not any((0, n) in placed for n in bare)
