"""A Merkle manifest of a corpus: one digest for all rows, a proof for each, and what a changed row makes of the root.

A parent hashes up to eight children in order. While it does so it keeps a copy of its hash state before each child's
slot, so that a changed child is folded by resuming that copy with the new digest and the siblings to its right; those
to its left are never hashed again. Trees are built 4,096 nodes a task and round, so that a tree of any size takes a
few rounds; what a node needs of the rounds above it is its siblings there, which reach it on the way down.
"""

import hashlib
import zlib
from typing import NamedTuple

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import release, write_table

FANOUT = 8
#: Levels of a tree that one task builds in one round: groups of 8 ** 4 nodes.
LEVELS = 4
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
PATH = "array<struct<left: string, right: string>>"


def _field(value) -> bytes:
    if value is None:
        return b"-"
    raw = str(value).encode()
    return b"%d:" % len(raw) + raw


def _texts(column: pa.Array):
    """Each text's bytes, None for null."""
    column = pc.cast(column, pa.large_binary())
    return (v.as_buffer() if v.is_valid else None for v in column)


def leaves(docs: DataFrame, divisor: int = 3) -> DataFrame:
    """tree, doc_id, leaf, changed: the digest of each row, and that of its tampered form where it is to be tampered with.

    A row is tampered with where ``divisor`` divides the crc32 of its id; a null id is not. tree is the language behind
    '=', or empty for null, so that trees sort as languages do, null first.
    """

    def digest(batches):
        for batch in batches:
            ids, source, lang, chars = (c.to_pylist() for c in batch.columns[:4])
            leaf, changed = [], []
            for i, s, lg, n, raw in zip(ids, source, lang, chars, _texts(batch.column(4))):
                state = hashlib.sha256(_field(i) + _field(s) + _field(lg) + _field(n) + (b"-" if raw is None else b"%d:" % raw.size))
                other = None
                if i is not None and zlib.crc32(str(i).encode()) % divisor == 0:
                    other = state.copy()  # the text alone differs, and its length doesn't
                    other.update(b"" if raw is None else raw.to_pybytes().translate(_LOWER))
                if raw is not None:
                    state.update(raw)
                leaf.append(state.hexdigest())
                changed.append(other and other.hexdigest())
            tree = ["" if lg is None else "=" + lg for lg in lang]
            yield pa.RecordBatch.from_arrays([pa.array(tree, pa.string()), pa.array(ids, pa.int64()), pa.array(leaf, pa.string()), pa.array(changed, pa.string())], ["tree", "doc_id", "leaf", "changed"])

    return docs.select(*[F.col(f"`{c}`") for c in FIELDS]).mapInArrow(digest, "tree string, doc_id long, leaf string, changed string")


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """The rows with at (their number in their tree, from 0, in the given order) and size (the tree's rows).

    Rows are sorted in ranges and written; numbers follow from the counts of the ranges, so no tree is one task's.
    """
    columns = rows.columns

    def number(batches):
        part, seen = TaskContext.get().partitionId(), {}
        for batch in batches:
            trees = batch.column(0).to_pylist()
            at = []
            for t in trees:
                n = seen.get(t, 0)
                at.append(n)
                if not n:
                    seen.clear()  # sorted: an earlier tree does not come back
                seen[t] = n + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * len(at), pa.int32()), pa.array(at, pa.int64())], [*columns, "part", "within"])

    ranged = rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", part int, within long"
    placed, _ = write_table(ranged.mapInArrow(number, schema), name)
    parts = placed.groupBy("tree", "part").agg(F.count("*").alias("n"))
    tree = Window.partitionBy("tree")
    before = parts.select("tree", "part", (F.sum("n").over(tree.orderBy("part")) - F.col("n")).alias("before"), F.sum("n").over(tree).alias("size"))
    done, _ = write_table(placed.join(before, ["tree", "part"]).select(*columns, (F.col("before") + F.col("within")).alias("at"), "size"), name)
    release(placed)
    return done


class Parent(NamedTuple):
    """One parent while folding: the state before each child's slot, and the digests of the children."""

    states: list
    children: list[bytes]

    def fold(self, slot: int, digest: bytes) -> bytes:
        state = self.states[slot].copy()
        state.update(digest)
        state.update(b"".join(self.children[slot + 1 :]))
        return state.hexdigest().encode()


def parent(children: list[bytes]) -> tuple[Parent, bytes]:
    state, states = hashlib.sha256(), []
    for child in children:
        states.append(state.copy())
        state.update(child)
    return Parent(states, children), state.hexdigest().encode()


def build(nodes: list[bytes], most: int | None) -> tuple[list[list[Parent]], bytes]:
    """The levels of parents over one group's nodes, and the top: ``most`` levels, or until one node is left where None."""
    levels: list[list[Parent]] = []
    while len(nodes) > 1 if most is None else len(levels) < most:
        made = [parent(nodes[i : i + FANOUT]) for i in range(0, len(nodes), FANOUT)]
        levels.append([p for p, _ in made])
        nodes = [d for _, d in made]
    return levels, nodes[0]


def siblings(levels: list[list[Parent]], at: int) -> list[tuple[bytes, bytes]]:
    """The digests left and right of a node, level by level."""
    path = []
    for level in levels:
        mine, slot = level[at // FANOUT], at % FANOUT
        path.append((b"".join(mine.children[:slot]), b"".join(mine.children[slot + 1 :])))
        at //= FANOUT
    return path


def _group(table: pa.Table, digest: str, levels: int) -> tuple[pa.Table, list[list[Parent]], bytes]:
    table = table.sort_by("at")
    whole = table.column("size")[0].as_py() <= FANOUT**levels
    return table, *build([d.encode() for d in table.column(digest).to_pylist()], None if whole else levels)


def _span(levels: int) -> Column:
    return F.floor(F.col("at") / FANOUT**levels).alias("span")


def rounds(nodes: DataFrame, most: int, levels: int = LEVELS) -> list[DataFrame]:
    """tree, at, digest, size of the nodes at the start of each round, up to the roots (the last); ``most``: the largest tree."""

    def top(table: pa.Table) -> pa.Table:
        table, _, digest = _group(table, "digest", levels)
        at, size = table.column("at")[0].as_py(), table.column("size")[0].as_py()
        return pa.table({"tree": table.column("tree").slice(0, 1), "at": pa.array([at // FANOUT**levels]), "digest": pa.array([digest.decode()]), "size": pa.array([-(-size // FANOUT**levels)])})

    found = [nodes]
    while len(found) == 1 or most > 1:
        groups = found[-1].groupBy("tree", _span(levels)).applyInArrow(top, "tree string, at long, digest string, size long")
        found.append(write_table(groups, "tree-nodes")[0])
        most = -(-most // FANOUT**levels)
    return found


def paths_down(found: list[DataFrame], top: DataFrame, to_leaves: bool, levels: int = LEVELS) -> DataFrame:
    """tree, at, path (siblings level by level, up to the very top) of the nodes of the first round after the leaves, or of those.

    ``top`` has the paths of the trees' roots.
    """

    def one(left: pa.Table, right: pa.Table) -> pa.Table:
        left, parents, _ = _group(left, "digest", levels)
        above = right.column("path")[0].as_py()
        paths = [[{"left": a.decode(), "right": b.decode()} for a, b in siblings(parents, i)] + above for i in range(left.num_rows)]
        kind = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))
        return pa.table({"tree": left.column("tree"), "at": left.column("at"), "path": pa.array(paths, kind)})

    for nodes in found[-2::-1] if to_leaves else found[-2:0:-1]:
        top = nodes.groupBy("tree", _span(levels)).cogroup(top.groupBy("tree", "at")).applyInArrow(one, f"tree string, at long, path {PATH}")
    return top


def _folded(rows: DataFrame, spans: DataFrame, levels: int) -> DataFrame:
    """The manifest's rows, from the leaves and, for each group of them, path, subroot and root."""

    def one(left: pa.Table, right: pa.Table) -> pa.Table:
        left, parents, _ = _group(left, "leaf", levels)
        above = [(x["left"].encode(), x["right"].encode()) for x in right.column("path")[0].as_py()]
        upper = [(hashlib.sha256(a), b) for a, b in above]
        rest = b"".join(a + b for a, b in above)
        root = right.column("root")[0].as_py()
        leaf, proofs, folded = left.column("leaf").to_pylist(), [], []
        for i, digest in enumerate(c or d for c, d in zip(left.column("changed").to_pylist(), leaf)):
            digest, slot = digest.encode(), i
            for level in parents:
                digest, slot = level[slot // FANOUT].fold(slot % FANOUT, digest), slot // FANOUT
            for before, after in upper:
                state = before.copy()
                state.update(digest)
                state.update(after)
                digest = state.hexdigest().encode()
            folded.append(digest.decode())
            proofs.append(hashlib.sha256(b"".join(a + b for a, b in siblings(parents, i)) + rest).hexdigest())
        n = len(leaf)
        data = [left.column("doc_id"), left.column("leaf"), pa.array([right.column("subroot")[0].as_py()] * n), pa.array([root] * n), pa.array(proofs), pa.array(folded), pa.array([f == root for f in folded])]
        return pa.table(data, ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    schema = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return rows.groupBy("tree", _span(levels)).cogroup(spans.groupBy("tree", "at")).applyInArrow(one, schema)


def manifest(docs: DataFrame, divisor: int = 3, levels: int = LEVELS) -> DataFrame:
    """doc_id, leaf, subroot (of its language), root (of all), proof_sha256, folded_root, verified; a row per row.

    Nulls are '-' in a leaf; null languages form a tree of their own, null ids come first in it. Rows of one id stand in
    the order of their leaves, so repeated rows have one leaf but proofs of their own. A tree of one row is that row's
    leaf. An empty table gives an empty one. Other columns play no part.
    """
    rows = numbered(leaves(docs, divisor), ["doc_id", "leaf"], "leaves")
    found = rounds(rows.select("tree", "at", F.col("leaf").alias("digest"), "size"), rows.agg(F.max("size")).first()[0] or 0, levels)
    # Above the languages stands one tree of their roots.
    langs = numbered(found[-1].select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest"), ["name"], "language-roots")
    above = rounds(langs.select("tree", "at", "digest", "size"), langs.count(), levels)
    up = paths_down(above, above[-1].select("tree", "at", F.array().cast(PATH).alias("path")), True, levels)
    tops = langs.join(up, ["tree", "at"]).select(F.col("name").alias("tree"), F.lit(0).cast("long").alias("at"), "path", F.col("digest").alias("subroot"))
    tops, _ = write_table(tops.crossJoin(F.broadcast(above[-1].select(F.col("digest").alias("root")))), "language-paths")
    spans = paths_down(found, tops.select("tree", "at", "path"), False, levels).join(tops.select("tree", "subroot", "root"), "tree")
    result, _ = write_table(_folded(rows, spans, levels), "manifest")
    release(rows, langs, tops, *found[1:], *above[1:])
    return result
