"""Which listing each row of a batch is, when rows of one batch are listings to each other, in order of arrival.

A row's listing depends on what earlier rows made of the listings that it could match, so rows that can meet are
replayed one after the other, on keys alone. What can meet is found by joins: rows and listings that share a link, url or
source id, or stand in one run of a commune's areas, a run ending where the next area is out of tolerance.
"""

import heapq
from bisect import bisect_left, bisect_right
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions.text import comuna_key
from .components import checkpointed, smallest_linked
from .dedup import area_runs

KEYS = ("link", "url", "source_listing_id")
SHAPE = ("comuna_key", "dormitorios", "banos", "estacionamientos")
#: What counts for the completeness of a listing, besides coordinates.
POINTS = ("precio_clp", "precio_uf", "m2_construidos", "dormitorios", "banos", "estacionamientos")


class Rank(NamedTuple):
    """The better a listing, the smaller: most data, a source id, a link, last seen, lowest id."""

    points: int
    no_source: bool
    no_link: bool
    unseen: float
    before: int
    id: int


class Shelf:
    """Listings while a batch is replayed: by link, url and source id, and by shape with areas in order."""

    def __init__(self, tolerance: float):
        self.tolerance = tolerance
        self.rows: dict[int, dict] = {}
        self.named: dict[tuple, set[int]] = {}
        self.areas: dict[tuple, list[float]] = {}
        self.best: dict[tuple, list[tuple[Rank, int]]] = {}
        self.parkings: dict[tuple, set] = {}
        self.rank: dict[int, Rank] = {}

    @staticmethod
    def shape(row: dict) -> tuple | None:
        if not row["comuna_key"] or not row["m2_construidos"] or row["m2_construidos"] <= 0 or row["dormitorios"] is None or row["banos"] is None:
            return None
        return tuple(row[c] for c in SHAPE)

    def put(self, key: int, row: dict, rank: Rank) -> None:
        """Add a listing, or replace what it was."""
        if (old := self.rows.get(key)) is not None:
            for c in KEYS:
                if old[c] is not None:
                    self.named[c, old["fuente"], old[c]].discard(key)
        self.rows[key], self.rank[key] = row, rank
        for c in KEYS:
            if row[c] is not None and row["fuente"] is not None:
                self.named.setdefault((c, row["fuente"], row[c]), set()).add(key)
        if (shape := self.shape(row)) is not None:
            area = row["m2_construidos"]
            heap = self.best.setdefault((shape, area), [])
            if not heap:
                areas = self.areas.setdefault(shape, [])
                at = bisect_left(areas, area)
                if at == len(areas) or areas[at] != area:
                    areas.insert(at, area)
                self.parkings.setdefault(shape[:3], set()).add(shape[3])
            heapq.heappush(heap, (rank, key))

    def find(self, row: dict) -> int | None:
        """The listing that a row is: by link, url or source id, else the best of those that look like it."""
        for c in KEYS:
            found = self.named.get((c, row["fuente"], row[c])) if row[c] is not None and row["fuente"] is not None else None
            if found:
                return min(found)
        if (shape := self.shape(row)) is None:
            return None
        comuna, rooms, baths, parking = shape
        area, best = row["m2_construidos"], None
        low, high = area * (1 - self.tolerance) * 0.999, area / (1 - self.tolerance) * 1.001
        for d in (rooms - 1, rooms, rooms + 1):
            for b in (baths - 1, baths, baths + 1):
                for p in self.parkings.get((comuna, d, b), ()):
                    if p is not None and parking is not None and abs(p - parking) > 1:
                        continue
                    areas = self.areas[comuna, d, b, p]
                    for other in areas[bisect_left(areas, low) : bisect_right(areas, high)]:
                        if abs(area - other) > max(area, other) * self.tolerance:
                            continue
                        heap = self.best[(comuna, d, b, p), other]
                        while heap and not self._current(heap[0], (comuna, d, b, p), other):
                            heapq.heappop(heap)
                        if heap and (best is None or heap[0] < best):
                            best = heap[0]
        return None if best is None else best[1]

    def _current(self, entry: tuple[Rank, int], shape: tuple, area: float) -> bool:
        row = self.rows[entry[1]]
        return self.rank[entry[1]] == entry[0] and row["m2_construidos"] == area and self.shape(row) == shape


def replay(rows: list[dict], tolerance: float, now: float, keep_geocodes: bool) -> list[tuple[int, int | None, int | None]]:
    """(arrival, id, origin) of each row of a batch, given listings (kind 0) and rows (kind 1) in any order.

    id is a listing's, origin the arrival of the row that made a new one.
    """
    shelf, out = Shelf(tolerance), []

    def rank(row: dict, seen: float, before: int, key: int) -> Rank:
        points = sum(row[c] is not None for c in POINTS) + row["has_lat"] + row["has_lon"]
        return Rank(-points, not row["source_listing_id"], not (row["link"] or row["url"]), -seen, -before, key)

    listings = sorted((r for r in rows if r["kind"] == 0), key=lambda r: r["n"])
    above = (listings[-1]["n"] if listings else 0) + 1
    for row in listings:
        shelf.put(row["n"], row, rank(row, row["seen"], -1, row["n"]))
    new: dict[int, int] = {}
    for turn, row in enumerate(sorted((r for r in rows if r["kind"] == 1), key=lambda r: r["n"])):
        key = shelf.find(row)
        if key is None:
            key = above + turn
            new[key] = row["n"]
            state = row
        else:
            old = shelf.rows[key]
            state = {**row, "fuente": old["fuente"], **{c: row[c] if row[c] is not None else old[c] for c in KEYS}}
            if keep_geocodes:
                state |= {c: row[c] or old[c] for c in ("has_lat", "has_lon")}
        shelf.put(key, state, rank(state, now, turn, key))
        out.append((row["n"], None if key in new else key, new.get(key)))
    return out


def _entities(df: DataFrame, kind: int, number: str, seen: Column) -> DataFrame:
    parts = [F.col(c) if c in df.columns else F.lit(None).alias(c) for c in POINTS]
    return df.select(
        F.lit(kind).alias("kind"), F.col(number).cast("long").alias("n"), "fuente", *KEYS, comuna_key(F.col("comuna")).alias("comuna_key"), *parts,
        F.col("lat").isNotNull().alias("has_lat"), F.col("lon").isNotNull().alias("has_lon"), seen.cast("double").alias("seen"))


def _names(df: DataFrame) -> DataFrame:
    """kind, n and the hash of each link, url and source id of a row."""
    each = [F.when(F.col(c).isNotNull() & F.col("fuente").isNotNull(), F.xxhash64(F.lit(c), "fuente", c)) for c in KEYS]
    return df.select("kind", "n", F.explode(F.array_compact(F.array(*each))).alias("node"))


def _placed(links: DataFrame) -> DataFrame:
    """kind, n and component of the entities of (kind, n, node), linked by the nodes that they share."""
    entity = links.groupBy("kind", "n").agg(F.min("node").alias("first"), F.collect_set("node").alias("nodes"))
    pairs = entity.select("first", F.explode("nodes").alias("node")).where("first <> node").distinct()
    found = smallest_linked(pairs, "first", "node")
    return entity.select("kind", "n", "first").join(found, F.col("first") == F.col("id"), "left").select("kind", "n", F.coalesce("component", "first").alias("component"))


def meeting(rows: DataFrame, known: DataFrame, tolerance: float) -> DataFrame:
    """(kind, n, component) of the rows and listings that can meet; a row that is not there meets nothing.

    A row whose link a listing has finds that by its link, and the listing's link stays what it is. So where all rows of
    a component are such, none of them looks for its like, and names alone connect them: no run of areas is one task's.
    """
    shaped = lambda df: df.where("comuna_key <> '' and m2_construidos > 0 and dormitorios is not null and banos is not null")
    names = _names(rows)
    others = _names(known).join(names.select("node").distinct(), "node", "left_semi")
    named = names.unionByName(others).distinct()
    # A name that only one row has connects nothing.
    shared = named.groupBy("node").agg(F.count("*").alias("many")).where("many > 1").select("node")
    named = checkpointed(named.join(shared, "node", "left_semi"))
    searching = checkpointed(rows.join(known.select("fuente", "link").distinct(), ["fuente", "link"], "left_anti").select("kind", "n"))
    if searching.isEmpty():
        return _placed(named)
    place = ["comuna_key", "m2_construidos"]
    areas = shaped(rows).select(*place, F.lit(True).alias("new")).unionByName(shaped(known).select(*place, F.lit(False).alias("new"))).groupBy(*place).agg(F.max("new").alias("new"))
    areas = checkpointed(areas)
    runs = area_runs(areas.select(*place), tolerance)
    met = areas.where("new").join(runs, place).select("node").distinct()
    runs = checkpointed(runs.join(met, "node", "left_semi"))
    in_runs = lambda df: shaped(df).join(runs, place).select("kind", "n", "node")
    placed = checkpointed(_placed(checkpointed(named.unionByName(in_runs(rows)).unionByName(in_runs(known)))))
    # Searching rows that meet nothing are not placed.
    restless = placed.join(searching, ["kind", "n"]).select("component").distinct()
    calm = placed.join(restless, "component", "left_anti").select("kind", "n")
    return placed.join(restless, "component", "left_semi").select("kind", "n", "component").unionByName(_placed(checkpointed(named.join(calm, ["kind", "n"], "left_semi"))))


def resolve(batch: DataFrame, listings: DataFrame, as_of: str, cfg: Config = DEFAULT, keep_geocodes: bool = False) -> DataFrame:
    """(arrival, id, origin) for each row of a prepared batch: the id of its listing, or the arrival of the row that makes a new one.

    Rows are taken in order of arrival, each after all earlier ones have been merged: a listing found by link, url or
    source id, the smallest id of several, else the best of those of its commune with areas within a tenth and rooms
    within one. Arrivals differ. A component of rows that can meet is one task's, keys alone, and a row costs a search
    among shapes; in a commune whose areas leave no gap, and where some row's link is new, that is the batch's rows of the
    commune with its listings.
    """
    tolerance = cfg.duplicate_m2
    rows = checkpointed(_entities(batch, 1, "arrival", F.lit(0.0)))
    known = _entities(listings, 0, "id", F.coalesce(F.unix_timestamp(F.col("last_seen").cast("timestamp")), F.lit(0)))
    placed = meeting(rows, known, tolerance)
    own = F.coalesce("component", F.xxhash64(F.lit("alone"), "n"))
    whole = rows.join(placed, ["kind", "n"], "left").withColumn("component", own).unionByName(known.join(placed, ["kind", "n"]))
    now = F.to_timestamp(F.lit(as_of))
    whole = whole.withColumn("now", F.unix_timestamp(now).cast("double"))

    def components(batches):
        held: list[dict] = []
        out: list[tuple] = []
        for batch in batches:
            for row in batch.to_pylist():
                if held and row["component"] != held[0]["component"]:
                    out += replay(held, tolerance, held[0]["now"], keep_geocodes)
                    held = []
                held.append(row)
            if out:
                yield _settled(out)
                out = []
        if held:
            yield _settled(replay(held, tolerance, held[0]["now"], keep_geocodes))

    # A component's rows come one behind the other, so that a task holds one component and no group costs a call.
    return whole.repartition("component").sortWithinPartitions("component").mapInArrow(components, "arrival long, id long, origin long")


def _settled(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], ["arrival", "id", "origin"])
