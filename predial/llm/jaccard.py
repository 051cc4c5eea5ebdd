"""N-gram Jaccard join with adaptive multi-match prefixes.

Texts with equal shingle sets are one class. A class's shingles are ordered from rare to frequent by their exact
corpus-wide document counts. Two similar sets share at least m shingles within the prefixes that leave out all but
(required overlap - m) of their shingles; each class takes the m of least estimated cost (its prefix's postings, and
the verifications they may lead to), and a pair is verified where it shares the smaller m of the two. Shingles of one
document can't match, so a class with too few others has no partner and drops out before any posting is made, and
what is left of a set bounds the sizes of its partners.

Pairs become candidates by that rule alone, in three places. First each class meets the most central class of the
lists it is in, which joins most groups of near copies in as many steps as they have members. What is then left to
compare lies between components: lists of up to HOT classes are joined, and the classes of longer lists are met in blocks
under the list's centre, where a product of incidence matrices counts the shared prefix shingles, so that the pairs of a
large group never become rows.
"""

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange
from .components import connected, spanning
from .hashing import SPACE, mix, shingles
from .shared import release, write_table

SIZES = "ref long, batch long, place int, doc_id long, n_shingles long, set_a long, set_b long"
CLASSES = "ref long, n int, s int, m int, prefix binary, shingles binary"
VERIFY_COST = 10
#: Classes of a list from which on its pairs are compared in blocks, and the classes of a block.
HOT = 48
BLOCK = 384
SLICE = 8192
SLOT = 16


def _sets(batch: exchange.Batch, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each document in order, and the row offsets."""
    x, rows = shingles(batch.hashes, batch.rows, k)
    doc = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
    order = np.lexsort((x, doc))
    x, doc = x[order], doc[order]
    new = np.ones(len(x), bool)
    new[1:] = (x[1:] != x[:-1]) | (doc[1:] != doc[:-1])
    return x[new], np.searchsorted(doc[new], np.arange(len(rows)))


def least_overlap(n: np.ndarray, percent: int) -> np.ndarray:
    """The fewest shingles that a set of n shares with any set at the threshold."""
    return -(-percent * n // 100)


def prefix_matches(df: np.ndarray, need: int) -> int:
    """The number of matches to ask for, by estimated cost; df is in the set's order, ``need`` its least overlap."""
    others = np.cumsum(df - 1)
    steps = np.unique(np.minimum(1 << np.arange(need.bit_length()), need))
    postings = others[len(df) - need + steps - 1]
    return int(steps[np.argmin(postings * (1 + VERIFY_COST / steps) + steps)])


def _measure(found: DataFrame, k: int) -> DataFrame:
    def measure(records):
        for record in records:
            for number, raw in zip(record.column(0).to_pylist(), record.column(1)):
                batch = exchange.load(raw.as_py())
                x, rows = _sets(batch, k)
                n = np.diff(rows)
                total = lambda y: np.concatenate([[np.uint64(0)], np.cumsum(y, dtype=np.uint64)])
                a, b = total(mix(x)), total(mix(x ^ np.uint64(0x5555555555555555)))
                a, b = a[rows[1:]] - a[rows[:-1]], b[rows[1:]] - b[rows[:-1]]
                place = np.arange(len(n))
                columns = [pa.array((number << SLOT) + place), pa.array([number] * len(n), pa.int64()), pa.array(place.astype(np.int32)), pa.array(batch.ids, pa.int64()), pa.array(n), pa.array(a.view(np.int64)), pa.array(b.view(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in SIZES.split(", ")])

    return write_table(found.select("batch", "payload").mapInArrow(measure, SIZES), "sizes")[0]


def _candidates(found: DataFrame, members: DataFrame, k: int, percent: int) -> DataFrame:
    """The classes that may have a partner: their prefix's shared shingles, m, and their set."""

    def keys(batch):
        x, _ = _sets(batch, k)
        return np.unique(x, return_counts=True)

    size = members.agg(F.sum("n_shingles")).first()[0] or 0
    replies = exchange.answers(found, [exchange.Kind(keys, 4)], exchange.bucket_bits(size), "frequencies")
    copies = members.where("ref <> class or n_shingles = 0").groupBy("batch").agg(F.concat_ws(",", F.collect_list(F.col("place").cast("string"))).cast("binary").alias("places"))
    copies = copies.select("batch", F.lit(1).alias("kind"), F.lit(0).alias("bucket"), F.col("places").alias("totals"))

    def use(number, batch, df, copies):
        x, rows = _sets(batch, k)
        df = df[np.unique(x, return_inverse=True)[1]].astype(np.int64)
        n = np.diff(rows)
        first = np.ones(len(n), bool)
        first[copies] = False
        unique = np.concatenate([[0], np.cumsum(df == 1)])
        need = least_overlap(n, percent)
        live = first & (n - (unique[rows[1:]] - unique[rows[:-1]]) >= need) & (n > 0)
        out = []
        for i in np.flatnonzero(live).tolist():
            own, often = x[rows[i] : rows[i + 1]], df[rows[i] : rows[i + 1]]
            order = np.lexsort((own, often))
            m = prefix_matches(often[order], int(need[i]))
            prefix = order[: n[i] - need[i] + m]
            out.append(((number << SLOT) + i, int(n[i]), int((often > 1).sum()), m, own[prefix[often[prefix] > 1]].tobytes(), own.tobytes()))
        return out

    classes, _ = write_table(exchange.with_rows(found, replies.select("batch", "kind", "bucket", "totals").unionAll(copies), use, CLASSES), "classes", "uncompressed")
    release(replies)
    return classes


def _postings(classes: DataFrame) -> DataFrame:
    names = ["ref", "n", "s", "m"]

    def spread(records):
        for record in records:
            lists = [np.frombuffer(p.as_py(), np.int64) for p in record.column(4)]
            many = [len(x) for x in lists]
            each = [pa.array(np.repeat(record.column(i).to_numpy(), many)) for i in range(4)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(lists)), *each], ["token", *names])

    return write_table(classes.select(*names, "prefix").mapInArrow(spread, "token long, ref long, n int, s int, m int"), "postings")[0]


def _verified(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough."""
    sets = classes.select("ref", "shingles")
    one = sets.select(F.col("ref").alias("a"), F.col("shingles").alias("set_a"))
    two = sets.select(F.col("ref").alias("b"), F.col("shingles").alias("set_b"))

    def check(records):
        for record in records:
            good = []
            for x, y in zip(record.column(2), record.column(3)):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * both >= percent * (len(x) + len(y) - both))
            yield record.select([0, 1]).filter(pa.array(good, pa.bool_()))

    joined = pairs.join(one, "a").join(two, "b").select("a", "b", "set_a", "set_b")
    return joined.mapInArrow(check, "a long, b long")


def _fits(percent: int):
    """Whether the sizes allow similarity: the overlap is at most what either set shares with anyone at all."""
    most = F.least("s", "other_s", "n", "other_n")
    return 100 * most >= percent * (F.col("n") + F.col("other_n") - most)


def _central(postings: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Links of classes with the most central class (the fewest unshared shingles) of a list, that of most shared lists."""
    centre = F.min(F.struct(((F.col("n") - F.col("s")) / F.col("n")).alias("apart"), F.xxhash64("ref").alias("rank"), "ref", "n", "s", "m")).alias("c")
    lists = postings.groupBy("token").agg(F.count("*").alias("size"), centre).where("size > 1")
    lists, _ = write_table(lists.select("token", F.col("c.ref").alias("other"), F.col("c.n").alias("other_n"), F.col("c.s").alias("other_s"), F.col("c.m").alias("other_m")), "centres")
    met = postings.join(lists, "token").where("ref <> other").where(_fits(percent))
    # The lists that have this centre are some of those that the two share, so no pair is taken for one that shares enough.
    enough = met.groupBy("ref", "other").agg(F.count("*").alias("shared"), F.min(F.least("m", "other_m")).alias("asked")).where("shared >= asked")
    best = enough.groupBy("ref").agg(F.max_by("other", F.struct("shared", "other")).alias("other"))
    pairs, _ = write_table(best.select(F.col("ref").alias("a"), F.col("other").alias("b")), "pairs")
    similar, _ = write_table(_verified(pairs, classes, percent), "similar")
    release(lists, pairs)
    return similar


def candidate_pairs(live: DataFrame, percent: int) -> DataFrame:
    """(a, b, shared, asked): pairs across components that share as many prefix shingles as the smaller m of the two asks.

    live: (token, ref, n, s, m, component). A pair that meets in a long list too is met there, whatever it shares here.
    """
    right = live.select("token", F.col("ref").alias("other"), F.col("n").alias("other_n"), F.col("s").alias("other_s"), F.col("m").alias("other_m"), F.col("component").alias("other_component"))
    met = live.join(right, "token").where((F.col("ref") < F.col("other")) & (F.col("component") != F.col("other_component"))).where(_fits(percent))
    counted = met.groupBy(F.col("ref").alias("a"), F.col("other").alias("b")).agg(F.count("*").alias("shared"), F.min(F.least("m", "other_m")).alias("asked"))
    return counted.where("shared >= asked")


def _long_lists(members: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Spanning links across components of the classes that meet in a long list; members: (centre, ref, component)."""
    counts, _ = write_table(members.groupBy("centre").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), "blocks")
    placed = members.join(counts, "centre").withColumn("at", F.pmod(F.xxhash64("ref"), F.col("blocks")).cast("int"))
    own = ["component", "m", "prefix", "shingles"]
    full, _ = write_table(placed.join(classes.select("ref", "m", "prefix", "shingles"), "ref").select("centre", "blocks", "at", "ref", *own), "members", "uncompressed")
    left = full.select("centre", F.col("at").alias("i"), F.explode(F.sequence(F.col("at"), F.col("blocks") - 1)).alias("j"), "ref", *own)
    right = full.select("centre", F.explode(F.sequence(F.lit(0), F.col("at"))).alias("i"), F.col("at").alias("j"), "ref", *own)

    def compare(one: pa.Table, two: pa.Table) -> pa.Table:
        links = linked_in_block(_block(one), _block(two), percent)
        return pa.table([pa.array([p for p, _ in links], pa.int64()), pa.array([q for _, q in links], pa.int64())], ["a", "b"])

    key = ["centre", "i", "j"]
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(compare, "a long, b long")


class Block(NamedTuple):
    ref: np.ndarray
    component: np.ndarray
    m: np.ndarray
    prefix: list[np.ndarray]
    shingles: list[np.ndarray]


def _block(table: pa.Table) -> Block:
    lists = ([np.frombuffer(v.as_py(), np.uint64) for v in table.column(c)] for c in ("prefix", "shingles"))
    return Block(*(table.column(c).to_numpy() for c in ("ref", "component", "m")), *lists)


def linked_in_block(one: Block, two: Block, percent: int) -> list[tuple[int, int]]:
    """Spanning links of the pairs across components that share enough prefix shingles and are then similar enough."""
    if not len(one.ref) or not len(two.ref) or len(np.union1d(one.component, two.component)) < 2:
        return []
    apart = one.component[:, None] != two.component
    i, j = np.nonzero(apart & (overlaps(one.prefix, two.prefix) >= np.minimum(one.m[:, None], two.m)))
    if not len(i):
        return []
    rows, columns = np.unique(i), np.unique(j)
    both = overlaps([one.shingles[k] for k in rows], [two.shingles[k] for k in columns])[np.searchsorted(rows, i), np.searchsorted(columns, j)]
    size = lambda sets, at: np.array([len(v) for v in sets])[at]
    similar = 100 * both >= percent * (size(one.shingles, i) + size(two.shingles, j) - both)
    return spanning(one.ref, two.ref, i[similar], j[similar])


def overlaps(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets of x with all sets of y."""
    tokens, back = np.unique(np.concatenate([*x, *y]), return_inverse=True)
    row = np.repeat(np.arange(len(x) + len(y)), [len(v) for v in (*x, *y)])
    known = np.flatnonzero(np.bincount(back, minlength=len(tokens)) > 1)
    place = np.full(len(tokens), -1)
    place[known] = np.arange(len(known))
    row, column = row[place[back] >= 0], place[back][place[back] >= 0]
    total = np.zeros((len(x), len(y)), np.int64)
    for at in range(0, len(known), SLICE):
        wide = np.zeros((len(x) + len(y), min(SLICE, len(known) - at)), np.float32)
        mine = (column >= at) & (column < at + SLICE)
        wide[row[mine], column[mine] - at] = 1
        total += (wide[: len(x)] @ wide[len(x) :].T).astype(np.int64)
    return total


def similar_classes(classes: DataFrame, percent: int) -> DataFrame:
    """(node, component) of the classes that are linked with others."""
    postings = _postings(classes)
    links = _central(postings, classes, percent)
    component, _ = write_table(connected(links, "a", "b"), "components")
    live = postings.join(component.withColumnRenamed("node", "ref"), "ref", "left").withColumn("component", F.coalesce("component", "ref"))
    centre = F.min(F.struct(((F.col("n") - F.col("s")) / F.col("n")).alias("apart"), F.xxhash64("ref").alias("rank"), "ref")).alias("c")
    lists = live.groupBy("token").agg(F.count("*").alias("size"), F.min("component").alias("c0"), F.max("component").alias("c1"), centre).where("c0 <> c1")
    lists, _ = write_table(lists.select("token", "size", F.col("c.ref").alias("centre")), "lists")
    live, _ = write_table(live.join(lists, "token"), "live")
    members, _ = write_table(live.where(F.col("size") > HOT).select("centre", "ref", "component").distinct(), "long")
    short = live.where(F.col("size") <= HOT).drop("size", "centre")
    pairs, _ = write_table(candidate_pairs(short, percent).select("a", "b"), "pairs")
    found = links.unionAll(_verified(pairs, classes, percent))
    if not members.isEmpty():
        found = found.unionAll(_long_lists(members, classes, percent))
    found, _ = write_table(found, "links")
    release(postings, links, component, lists, live, members, pairs)
    return connected(found, "a", "b")


def _members(sizes: DataFrame) -> DataFrame:
    """The sizes with each document's class: the smallest ref of those with the same set."""
    filled = sizes.where("n_shingles > 0")
    key = ["n_shingles", "set_a", "set_b"]
    first, _ = write_table(filled.groupBy(*key).agg(F.min("ref").alias("class"), F.min("doc_id").alias("least_id")), "sets")
    joined = filled.join(first, key).select("ref", "batch", "place", "doc_id", "n_shingles", "class", "least_id")
    empty = sizes.where("n_shingles = 0").select("ref", "batch", "place", "doc_id", "n_shingles", F.col("ref").alias("class"), F.col("doc_id").alias("least_id"))
    members, _ = write_table(joined.unionAll(empty), "members")
    release(first, sizes)
    return members


def components(docs: DataFrame, percent: int = 85, k: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest id reachable by links, itself included) and class of each row.

    Words are lower-cased runs without white space; a set holds the distinct k-word shingles, or the whole of a
    shorter sequence. Rows link when 100 * intersection >= percent * union. A null, empty or blank text has no
    shingle, links with nothing and is its own component. Repeated rows are linked like any copies; a null id is no
    candidate for component_id, which is null where all ids are.
    """
    found = exchange.batches(docs, SPACE, id_col, text_col)
    members = _members(_measure(found, k))
    candidates = _candidates(found, members, k, percent)
    release(found)
    component = similar_classes(candidates, percent)
    release(candidates)
    classes = members.where("ref = class").select("class", "least_id")
    named = classes.join(component, F.col("class") == F.col("node"), "left").select("class", "least_id", F.coalesce("component", "class").alias("component"))
    named, _ = write_table(named, "named")
    least, _ = write_table(named.groupBy("component").agg(F.min("least_id").alias("component_id")), "least")
    by_class, _ = write_table(named.join(least, "component").select("class", "component_id", "component"), "named")
    return members.join(by_class, "class").select("doc_id", "n_shingles", "component_id", "class", "ref", "component")
