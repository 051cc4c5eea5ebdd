"""How far a language's sources are from each other and from the language, by the terms they use.

Tasks lower, split, dictionary-encode and group with Arrow's compute functions and hand on counts per language, source
and term. Spark merges these into shards, each a set of whole terms with all their sources; a shard is a small dense
matrix, from which the divergences of all pairs of sources are summed. All arithmetic is on integers.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import release, write_table

#: Fixed value: what stands between terms, after A-Z are lower-cased (RE2 syntax, code points).
BETWEEN = r"[\x00-\x60\x7B-\x7F]+"
SCALE = 1_000_000_000
PARTIAL = "lang string, source string, term string, n long, d long"
MERGE_ROWS = 1 << 19
FLUSH_ROWS = 1 << 20
STRETCH = 8 << 20
SHARD_ROWS = 200_000
LEAST_SHARDS = 16
BLOCK_SOURCES = 256
CELLS = 1 << 21
_KEY = ["lang", "source", "term"]


def _counted(batch: pa.RecordBatch) -> pa.Table:
    """Occurrences n and rows d of each term by language and source; the empty term stands for the rows themselves."""
    lang, source, text = (pc.fill_null(c, "") for c in batch.columns)
    groups = pa.table({"lang": lang, "source": source, "row": pa.array(np.arange(len(text), dtype=np.int64))})
    rows = groups.group_by(["lang", "source"], use_threads=False).aggregate([("row", "count")])
    rows = pa.table({"lang": rows["lang"], "source": rows["source"], "term": pa.array([""] * len(rows), pa.string()), "n": pa.array(np.zeros(len(rows), np.int64)), "d": rows["row_count"]})
    lists = pc.split_pattern_regex(pc.ascii_lower(text), pattern=BETWEEN)
    terms = pc.list_flatten(lists).dictionary_encode()
    found = pa.table({"row": pc.list_parent_indices(lists), "term": terms.indices})
    if (blank := terms.dictionary.index("").as_py()) >= 0:
        found = found.filter(pc.not_equal(found["term"], blank))
    each = found.group_by(["row", "term"], use_threads=False).aggregate([([], "count_all")])
    each = each.append_column("lang", lang.take(each["row"])).append_column("source", source.take(each["row"]))
    each = each.group_by(["lang", "source", "term"], use_threads=False).aggregate([("count_all", "sum"), ("count_all", "count")])
    each = pa.table({"lang": each["lang"], "source": each["source"], "term": pc.take(terms.dictionary, each["term"]), "n": each["count_all_sum"], "d": each["count_all_count"]})
    return pa.concat_tables([rows, each])


def _stretches(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about STRETCH bytes of text; a longer text is alone."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(2)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + STRETCH, "right")))
        yield batch.slice(at, end - at)
        at = end


def _merged(tables: list[pa.Table]) -> pa.Table:
    whole = pa.concat_tables(tables).group_by(_KEY, use_threads=False).aggregate([("n", "sum"), ("d", "sum")])
    return pa.table({**{k: whole[k] for k in _KEY}, "n": whole["n_sum"], "d": whole["d_sum"]})


def _partial_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.Table] = []
    size = 0
    for batch in batches:
        for part in _stretches(batch):
            held.append(_counted(part))
            size += held[-1].num_rows
            if size > MERGE_ROWS:
                held = [_merged(held)]
                size = held[0].num_rows
                if size > FLUSH_ROWS:
                    yield from held[0].combine_chunks().to_batches(1 << 16)
                    held, size = [], 0
                elif size > MERGE_ROWS // 2:  # let as many again come before the next merge
                    size = MERGE_ROWS // 2
    if held:
        yield from _merged(held).combine_chunks().to_batches(1 << 16)


def term_counts(docs: DataFrame, least_docs: int = 10) -> DataFrame:
    """A row per language, source and kept term (at least ``least_docs`` rows of the language): n, lang_n (n of all
    sources), first (one row per language and term). A row with the empty term per language and source comes with it.
    """
    narrow = docs.select(*[F.col(c).cast("string").alias(c) for c in ("lang", "source", "text")])
    counts = narrow.mapInArrow(_partial_counts, PARTIAL).groupBy(*_KEY).agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
    term = Window.partitionBy("lang", "term")
    ranked = counts.withColumns({"lang_d": F.sum("d").over(term), "lang_n": F.sum("n").over(term), "first": F.min("source").over(term) == F.col("source")})
    return ranked.where((F.col("term") == "") | (F.col("lang_d") >= least_docs)).drop("d", "lang_d")


def group_totals(counts: DataFrame) -> DataFrame:
    """A row per language and source: total (its occurrences of kept terms), lang_total and terms (of the language), sources and place (from 0, by name)."""
    groups = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count_if(F.col("first") & (F.col("term") != "")).alias("firsts"))
    langs = groups.groupBy("lang").agg(F.sum("total").alias("lang_total"), F.sum("firsts").alias("terms"), F.count("*").alias("sources"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    return groups.drop("firsts").withColumn("place", place).join(langs, "lang")


def smoothed(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10^9 (n + 2) / (total + 2 terms)), in decimals so that no count overflows; null without terms."""
    wide = lambda c: c.cast("decimal(27,0)")
    top, under = wide(n + 2) * F.lit(SCALE).cast("decimal(11,0)"), wide(total + 2 * terms)
    return F.when(terms > 0, F.call_function("div", top, under) + 1)


def divergence(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def distinctive_terms(counts: DataFrame, totals: DataFrame, top: int = 10) -> DataFrame:
    """The ``top`` kept terms of each group that it has more of than its language, by divergence from the language."""
    rows = counts.where("term <> ''").join(totals, ["lang", "source"])
    p, q = smoothed(F.col("n"), F.col("total"), F.col("terms")), smoothed(F.col("lang_n"), F.col("lang_total"), F.col("terms"))
    rows = rows.select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).where("p > q")
    rows = rows.select("lang", "source", "item", divergence(F.col("p"), F.col("q")).alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= top)


def _pair_sums(block: int, first: int, fallback: np.ndarray, place: np.ndarray, term: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, sum over the shard's terms of the divergence) for a in the block and all b > a; places of sources."""
    sources, terms = len(fallback), int(term.max()) + 1 if len(term) else 0
    last = min(first + block, sources)
    sums = np.zeros((last - first, sources), np.int64)
    step = max(1, CELLS // sources)
    order = np.argsort(term, kind="stable")
    term, place, p = term[order], place[order], p[order]
    for at in range(0, terms, step):
        lo, hi = np.searchsorted(term, [at, at + step])
        dense = np.repeat(fallback[:, None], min(step, terms - at), axis=1)
        dense[place[lo:hi], term[lo:hi] - at] = p[lo:hi]
        for a in range(first, last):
            apart = dense[a] - dense[a + 1 :]
            sums[a - first, a + 1 :] += (apart * apart // (dense[a] + dense[a + 1 :])).sum(axis=1)
    a, b = np.nonzero(np.arange(first, last)[:, None] < np.arange(sources)[None, :])
    return a + first, b, sums[a, b]


def source_pairs(counts: DataFrame, totals: DataFrame, shards: int) -> DataFrame:
    """For each source every other source of its language, by divergence over all kept terms; the work grows with the result.

    Terms are dealt into shards by their hash, the sources of a language into blocks: a task has a shard's rows and the
    smoothed value of an absent term for each source.
    """
    blocks = F.explode(F.sequence(F.lit(0), F.floor((F.col("sources") - 1) / BLOCK_SOURCES).cast("int"))).alias("block")
    rows = counts.where("term <> ''").join(totals, ["lang", "source"])
    rows = rows.select("lang", F.pmod(F.xxhash64("term"), F.lit(shards)).cast("int").alias("shard"), blocks, "term", F.col("place").cast("int").alias("place"), smoothed(F.col("n"), F.col("total"), F.col("terms")).alias("p"))
    absent = F.coalesce(smoothed(F.lit(0), F.col("total"), F.col("terms")), F.lit(1)).alias("absent")
    sides = totals.select("lang", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), blocks, F.col("place").cast("int").alias("place"), absent)
    out = pa.schema([("lang", pa.string()), ("a", pa.int32()), ("b", pa.int32()), ("value", pa.int64())])

    def one(left: pa.Table, right: pa.Table) -> pa.Table:
        lang, shard, block = (right.column(c)[0].as_py() for c in ("lang", "shard", "block"))
        if not left.num_rows and shard:
            return out.empty_table()
        order = np.argsort(right.column("place").to_numpy())
        term = left.column("term").combine_chunks().dictionary_encode()
        codes = (term.combine_chunks() if isinstance(term, pa.ChunkedArray) else term).indices.to_numpy(zero_copy_only=False)
        a, b, value = _pair_sums(BLOCK_SOURCES, block * BLOCK_SOURCES, right.column("absent").to_numpy()[order], left.column("place").to_numpy(), codes, left.column("p").to_numpy())
        return pa.table([pa.array([lang] * len(a), pa.string()), pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(value, pa.int64())], schema=out)

    key = ["lang", "shard", "block"]
    sums = rows.groupBy(*key).cogroup(sides.groupBy(*key)).applyInArrow(one, "lang string, a int, b int, value long")
    sums = sums.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = sums.select("lang", F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("x"), "value").select("lang", "x.a", "x.b", "value")
    name = lambda p, c: totals.select("lang", F.col("place").alias(p), F.col("source").alias(c))
    named = both.join(name("a", "source"), ["lang", "a"]).join(name("b", "item"), ["lang", "b"])
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return named.select("lang", "source", "item", "value").withColumn("rank", rank)


def audit(docs: DataFrame, least_docs: int = 10, top: int = 10) -> DataFrame:
    """lang, source, part, item, value, rank: part ``pair`` ranks a source's fellow sources, ``term`` its ``top`` own terms.

    Null language, source and text are ''. A group without terms has its pairs (0 where the language keeps no term) and
    no term rows; a language of one source has no pairs; repeated rows count as often as they are there; an empty table
    gives an empty one. Columns other than the three play no part.
    """
    counts, _ = write_table(term_counts(docs, least_docs), "term-counts")
    totals, _ = write_table(group_totals(counts), "group-totals")
    shards = max(LEAST_SHARDS, -(-counts.count() // SHARD_ROWS))
    pairs = source_pairs(counts, totals, shards).withColumn("part", F.lit("pair"))
    terms = distinctive_terms(counts, totals, top).withColumn("part", F.lit("term"))
    found, _ = write_table(pairs.unionByName(terms).select("lang", "source", "part", "item", "value", "rank"), "divergences")
    release(counts, totals)
    return found
