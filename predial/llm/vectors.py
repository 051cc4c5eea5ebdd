"""Near-duplicate vectors by product quantisation over coarse inverted lists.

Vectors of one label that are equal are one node. Nodes are put in the inverted list of their nearest centroid, and
what is left after the centroid is coded subspace by subspace. A node probes every list that can hold a vector within
the radius (by its distance to the plane between the two centroids), compares itself there with codes by table lookup
- widened by each coded vector's own coding error, so that no link is lost - and what remains is reranked by exact
cosine. Centroids and codebooks are fitted on a bounded sample; every node is indexed. The number of lists grows with
the square root of the nodes.

Lists that lie near each other form groups of about BLOCK nodes of a label. A node travels once to each group in which
it probes a list, and a task compares a block of probing nodes with a block of a group, list by list. It gives counts
and a spanning set of links, never the pairs.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import connected, spanning
from .shared import write_table

SAMPLE = 20_000
SUBSPACES = 8
CODES = 64
#: Sampled vectors that a list is fitted on at least.
PER_LIST = 8
BLOCK = 1_500
ROUNDS = 8
CHUNK = 2_048


def _means(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Centroids of Lloyd's method from a fixed random start."""
    rng = np.random.default_rng(seed)
    centres = x[np.sort(rng.choice(len(x), min(k, len(x)), replace=False))].copy()
    for _ in range(ROUNDS):
        near = _nearest(x, centres)
        count = np.bincount(near, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, near, x)
        some = count > 0
        centres[some] = total[some] / count[some, None]
    return centres


def _squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ y.T + (y * y).sum(1), 0)


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.int64), *(_squares(x[a : a + CHUNK], centres).argmin(axis=1) for a in range(0, len(x), CHUNK))])


def _in_line(centres: np.ndarray) -> np.ndarray:
    """Each centroid's place in an order that keeps near ones together: by centroids of the centroids."""
    few = _means(centres, max(1, int(len(centres) ** 0.5)), 99)
    of = _nearest(centres, few)
    order = np.lexsort((_squares(centres, few)[np.arange(len(centres)), of], of))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return place


class Quantiser:
    """Coarse centroids and, for each subspace of the residuals, a codebook."""

    def __init__(self, sample: np.ndarray, lists: int):
        self.centres = _means(sample, lists, 1)
        self.centres = self.centres[np.argsort(_in_line(self.centres))]
        self.cuts = np.array_split(np.arange(sample.shape[1]), min(SUBSPACES, sample.shape[1]))
        rest = sample - self.centres[_nearest(sample, self.centres)]
        self.books = [_means(rest[:, cut], CODES, 2 + i) for i, cut in enumerate(self.cuts)]
        apart = np.sqrt(_squares(self.centres, self.centres))
        self.apart = np.where(apart > 0, apart, np.inf)

    def index(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """List, codes and coding error of each vector."""
        near = _nearest(x, self.centres)
        rest = x - self.centres[near]
        codes = np.stack([_squares(rest[:, c], b).argmin(axis=1) for c, b in zip(self.cuts, self.books)], axis=1).astype(np.uint8)
        return near, codes, np.sqrt(((rest - self.decode(codes)) ** 2).sum(axis=1))

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([b[codes[:, i]] for i, b in enumerate(self.books)], axis=1)

    def probes(self, x: np.ndarray, radius: float) -> np.ndarray:
        """Vectors x lists: whether the list may hold a vector within the radius."""
        d = _squares(x, self.centres)
        near = d.argmin(axis=1)
        margin = (d - d[np.arange(len(x)), near, None]) / (2 * self.apart[near])
        return margin <= radius + 1e-6

    def distances(self, x: np.ndarray, which: int, codes: np.ndarray) -> np.ndarray:
        """Asymmetric squared distances of vectors to coded vectors of one list, by table lookup."""
        rest = x - self.centres[which]
        total = np.zeros((len(x), len(codes)))
        for i, (cut, book) in enumerate(zip(self.cuts, self.books)):
            total += _squares(rest[:, cut], book)[:, codes[:, i]]
        return total


def _matrix(column) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, n_links, component_id and kept of every row; vectors of one label link at cosine >= threshold.

    A vector that is null, empty, zero, holds null or non-finite components, or has no label links with nothing; so
    do vectors of different lengths. Equal vectors are one node in the work and count as links of each other. A
    repeated id is a row of its own; a null id has component null and is not kept.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<float>" if vectors.schema[vector_col].dataType == T.ArrayType(T.FloatType()) else "array<double>").alias("v"), F.col(label_col).alias("label"))
    bad = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    fine = F.col("label").isNotNull() & F.col("v").isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists("v", lambda c: c != 0)
    rows = rows.withColumn("fine", F.coalesce(fine, F.lit(False)))
    nodes, _ = write_table(rows.where("fine").groupBy("label", "v").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies")).withColumn("node_key", F.monotonically_increasing_id()), "nodes")
    parts = [_links(nodes.where(F.size("v") == r.d), r.n, threshold) for r in nodes.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).collect()]
    found = parts[0] if parts else spark.createDataFrame([], "a long, b long, links long")
    for more in parts[1:]:
        found = found.unionAll(more)
    found, _ = write_table(found, "found")
    component = connected(found.where("b is not null").select("a", "b"), "a", "b")
    links = found.groupBy("a").agg(F.sum("links").alias("more"))
    named = nodes.join(links, F.col("node_key") == F.col("a"), "left").join(component.withColumnRenamed("node", "in_component"), F.col("node_key") == F.col("in_component"), "left")
    named = named.select("label", "v", "node", "copies", F.coalesce("more", F.lit(0)).alias("more"), F.coalesce("component", "node_key").alias("component"))
    named, _ = write_table(named, "named")
    least, _ = write_table(named.groupBy("component").agg(F.min("node").alias("component_id")), "least")
    named, _ = write_table(named.join(least, "component").select("label", "v", "component_id", (F.col("copies") - 1 + F.col("more")).alias("n_links")), "named")
    linked = rows.where("fine").join(named, ["label", "v"]).select("vec_id", "n_links", "component_id")
    alone = rows.where(~F.col("fine")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionAll(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def count_lists(nodes: int, sampled: int) -> int:
    return max(1, min(sampled // PER_LIST, int(2 * nodes**0.5)))


def matches(quantiser: Quantiser, radius: float, threshold: float, x: np.ndarray, y: np.ndarray, which: np.ndarray, codes: np.ndarray, error: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(i, j, compared): the pairs x[i], y[j] at the threshold, y being listed and coded, and how many pairs the codes were asked for."""
    wide = quantiser.probes(x, radius)
    reach = (radius + error + 1e-6) ** 2
    found, compared = [(np.zeros(0, np.int64), np.zeros(0, np.int64))], 0
    for number in np.unique(which):
        rows, columns = np.flatnonzero(wide[:, number]), np.flatnonzero(which == number)
        compared += len(rows) * len(columns)
        i, j = np.nonzero(quantiser.distances(x[rows], number, codes[columns]) <= reach[columns])
        i, j = rows[i], columns[j]
        exact = np.einsum("ij,ij->i", x[i], y[j]) >= threshold
        found.append((i[exact], j[exact]))
    i, j = (np.concatenate(part) for part in zip(*found))
    return i, j, compared


def _links(nodes: DataFrame, n: int, threshold: float) -> DataFrame:
    """For nodes of one length: (a, null, links) with how many vectors node a links to, and (a, b, 0) spanning links."""
    spark = nodes.sparkSession
    sample = nodes.select("v").orderBy(F.xxhash64("v")).limit(SAMPLE).toArrow()
    quantiser = Quantiser(_unit(_matrix(sample.column("v"))), count_lists(n, len(sample)))
    lists = len(quantiser.centres)
    shared = spark.sparkContext.broadcast(quantiser)
    radius = float(np.sqrt(2 - 2 * threshold))
    label, vector = (nodes.schema[c].dataType.simpleString() for c in ("label", "v"))

    def listed(records):
        for record in records:
            which, codes, error = shared.value.index(_unit(_matrix(record.column("v"))))
            yield pa.RecordBatch.from_arrays([*record.columns, pa.array(which.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error)], [*record.schema.names, "list", "codes", "error"])

    index = nodes.select("label", "v", "copies", "node_key").mapInArrow(listed, f"label {label}, v {vector}, copies long, node_key long, list int, codes binary, error double")
    index, _ = write_table(index, "index")
    # A label's lists in as many stretches as its nodes fill blocks.
    sizes, _ = write_table(index.groupBy("label").agg(F.least(F.ceil(F.count("*") / BLOCK), F.lit(lists)).cast("int").alias("groups")), "groups")
    placed = index.join(sizes, "label").withColumn("group", F.floor(F.col("list") * F.col("groups") / F.lit(lists)).cast("int"))

    def probing(records):
        for record in records:
            wide = shared.value.probes(_unit(_matrix(record.column("v"))), radius)
            row, which = np.nonzero(wide)
            group = which * record.column("groups").to_numpy()[row].astype(np.int64) // lists
            both = np.unique(row * np.int64(1 << 32) + group)
            taken = record.select(["label", "v", "node_key"]).take(pa.array(both >> 32))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array((both & 0xFFFFFFFF).astype(np.int32))], [*taken.schema.names, "group"])

    queries, _ = write_table(placed.select("label", "v", "node_key", "groups").mapInArrow(probing, f"label {label}, v {vector}, node_key long, group int"), "probes")
    key = ["label", "group"]
    blocks = placed.groupBy(*key).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("n_listed"))
    blocks = blocks.join(queries.groupBy(*key).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("n_probing")), key)
    blocks, _ = write_table(blocks, "blocks")
    own = lambda n: F.pmod(F.xxhash64("node_key"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    there = placed.join(blocks, key).select(*key, "list", "v", "node_key", "copies", "codes", "error", own("n_listed").alias("i"), every("n_probing").alias("j"))
    asking = queries.join(blocks, key).select(*key, "v", "node_key", own("n_probing").alias("j"), every("n_listed").alias("i"))

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if left.num_rows and right.num_rows:
            a, b = left.column("node_key").to_numpy(), right.column("node_key").to_numpy()
            codes = np.frombuffer(b"".join(right.column("codes").to_pylist()), np.uint8).reshape(len(b), -1)
            i, j, _ = matches(shared.value, radius, threshold, _unit(_matrix(left.column("v"))), _unit(_matrix(right.column("v"))), right.column("list").to_numpy(), codes, right.column("error").to_numpy())
            other = a[i] != b[j]
            i, j = i[other], j[other]
            links = np.bincount(i, right.column("copies").to_numpy()[j], len(a)).astype(np.int64)
            out = [(int(a[k]), None, int(links[k])) for k in np.flatnonzero(links).tolist()]
            out += [(p, q, 0) for p, q in spanning(a, b, i, j)]
        columns = list(zip(*out)) or [(), (), ()]
        return pa.table([pa.array(c, pa.int64()) for c in columns], ["a", "b", "links"])

    cell = [*key, "i", "j"]
    return asking.groupBy(*cell).cogroup(there.groupBy(*cell)).applyInArrow(compare, "a long, b long, links long")
