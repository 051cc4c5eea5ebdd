"""Quality by importance resampling: hashed n-gram models of target and raw text, sampled by Gumbel top-k.

Tokens are lower-cased words and runs of punctuation; a document's features are its tokens and its pairs of neighbouring
tokens, each as often as it stands there, hashed into BUCKETS. Target and raw text are multinomial models of the buckets,
a document's log weight is the sum of its features' log ratios, and the k documents of largest log weight plus Gumbel
noise are a sample without replacement with odds in proportion to the weights.
"""

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import ALNUM, PUNCTUATION, all_words, mix, seeded, text_bytes

BITS = 16
BUCKETS = 1 << BITS
STRETCH = 1 << 20
#: Raw text's buckets count in the target model as so many features in all, spread as the raw model spreads them.
PRIOR = float(BUCKETS)
#: Labelled rows that the target model and the share are learnt from.
LABELLED = 200_000


class Model(NamedTuple):
    """Each bucket's log ratio of target and raw model, and the target's share among the labelled documents."""

    weight: np.ndarray
    share: float
    seed: int


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every token and of every pair of neighbouring tokens of a stretch of texts (null: none)."""
    one, two = all_words(column, ALNUM), all_words(column, PUNCTUATION)
    h = np.concatenate([one.hash, two.hash])[np.argsort(np.concatenate([one.start, two.start]), kind="stable")]
    rows = one.rows + two.rows
    row = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
    at = np.flatnonzero(row[1:] == row[:-1])
    a, b = seeded(2, 59)
    key = np.concatenate([mix(h), mix(h[at] * a + h[at + 1] * b)])
    return np.concatenate([row, row[at]]), (key >> np.uint64(64 - BITS)).astype(np.int64)


def _stretches(column: pa.Array):
    _, offsets = text_bytes(column)
    at, n = 0, len(offsets) - 1
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + STRETCH, "right")) - 1)
        yield at, end, column.slice(at, end - at)
        at = end


def _counts(texts: DataFrame) -> tuple[np.ndarray, np.ndarray, int, int]:
    """The buckets' counts in target and in all texts, and how many texts are good and labelled; texts: (text, mark).

    The mark is 3 for a target text, 2 for another good one, 1 for another labelled one, else 0. A task sends what it
    has counted, at most BUCKETS rows; Spark adds them up, and one table of BUCKETS rows comes to the driver.
    """

    def count(batches):
        total, seen = np.zeros((2, BUCKETS), np.int64), np.zeros(2, np.int64)
        for batch in batches:
            mark = batch.column(1).to_numpy(zero_copy_only=False)
            seen += [(mark >= 2).sum(), (mark > 0).sum()]
            for a, b, column in _stretches(batch.column(0)):
                row, bucket = features(column)
                total[1] += np.bincount(bucket, minlength=BUCKETS)
                total[0] += np.bincount(bucket[mark[a:b][row] == 3], minlength=BUCKETS)
        at = np.flatnonzero(total[1])
        columns = [np.append(at, -1), np.append(total[0][at], seen[0]), np.append(total[1][at], seen[1])]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["bucket", "target", "raw"])

    table = texts.mapInArrow(count, "bucket long, target long, raw long").groupBy("bucket").agg(F.sum("target").alias("target"), F.sum("raw").alias("raw")).toArrow()
    bucket, target, raw = (table.column(c).to_numpy() for c in ("bucket", "target", "raw"))
    t, r = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    real = bucket >= 0
    t[bucket[real]], r[bucket[real]] = target[real], raw[real]
    return t, r, int(target[~real].sum()), int(raw[~real].sum())


def weights(t: np.ndarray, r: np.ndarray) -> np.ndarray:
    """The buckets' log ratios of the target model, smoothed by PRIOR features of the raw model, and the raw model; 0 where raw text has nothing."""
    raw = r / max(r.sum(), 1)
    target = (t + PRIOR * raw) / (t.sum() + PRIOR)
    return np.log(np.divide(target, raw, out=np.ones(BUCKETS), where=raw > 0))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", labelled: int = LABELLED, seed: int = 17) -> Model:
    """The target model from up to ``labelled`` labelled documents (quality 1, not toxic), the raw model from all documents.

    Labels beyond ``labelled`` are left out by the order of their id's hash. Labels without a document and null labels
    teach nothing; an id with several labels has its best one. The share is that of quality 1 among the labelled
    documents. Without any target document every weight is 0; without any labelled one the share is 1.
    """
    good = F.col("quality") == 1
    mark = F.when(good & (F.coalesce("toxic", F.lit(0)) == 0), 3).when(good, 2).when(F.col("quality").isNotNull(), 1)
    known = labels.select(F.col(id_col).alias("__key"), mark.alias("__mark")).where("__key is not null and __mark is not null")
    bound = F.broadcast(known.groupBy("__key").agg(F.max("__mark").alias("__mark")).orderBy(F.xxhash64(F.lit(seed), "__key")).limit(labelled))
    keyed = docs.select(F.col(id_col).alias("__key"), F.col(text_col).alias("__text"))
    t, r, n_good, n_labelled = _counts(keyed.join(bound, "__key", "left").select("__text", F.coalesce("__mark", F.lit(0))))
    share = n_good / n_labelled if n_labelled else 1.0
    return Model(weights(t, r) if t.any() else np.zeros(BUCKETS), share, seed)


SCORES = ("log_ratio", "gumbel_key")


def add_scores(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", names: tuple[str, str] = SCORES) -> DataFrame:
    """The documents with log_ratio, their log weight (0 for a null or empty text), and gumbel_key, its sampling key in fixed point.

    The noise is a hash of id and text, so that a row has the same key in every run and equal rows share one; columns
    of these names are replaced.
    """
    base = docs.drop(*names)
    at = base.columns.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        for batch in batches:
            total = np.zeros(batch.num_rows)
            for a, b, column in _stretches(batch.column(at)):
                row, bucket = features(column)
                total[a:b] = np.bincount(row, shared.value.weight[bucket], b - a)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(total)], [*batch.schema.names, names[0]])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields)
    scored = base.mapInArrow(score, f"{fields}, `{names[0]}` double")
    uniform = (F.shiftrightunsigned(F.xxhash64(F.lit(model.seed), F.col(id_col), F.col(text_col)), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    noisy = F.col(names[0]) - F.log(-F.log(uniform))
    return scored.withColumn(names[1], F.round(F.greatest(F.least(noisy, F.lit(1e9)), F.lit(-1e9)) * (1 << 16)).cast("long"))


def threshold(keys: DataFrame, key: str, k: int) -> int | None:
    """The k-th largest of a column of whole numbers under 2**47 in size; None if there are fewer, or k is 0.

    Three rounds, each counting at most 2**16 + 1 ranges; no row is sorted or gathered.
    """
    if k <= 0:
        return None
    value, base = F.col(key) + F.lit(1 << 47), 0
    for shift in (32, 16, 0):
        part = keys.where(F.col(key).isNotNull())
        if shift < 32:
            part = part.where(F.shiftright(value, shift + 16) == base >> (shift + 16))
        table = sorted(((r.b, r.n) for r in part.groupBy(F.shiftright(value, shift).alias("b")).agg(F.count("*").alias("n")).collect()), reverse=True)
        for b, n in table:
            if k <= n:
                base = b << shift
                break
            k -= n
        else:
            return None
    return base - (1 << 47)


def resample(scores: DataFrame, share: float, key: str = SCORES[1]) -> int:
    """The key from which rows are kept, so that ``share`` of them (Model.share by default use) are; ties at it all stay."""
    found = threshold(scores, key, round(scores.count() * share))
    return (1 << 62) if found is None else found
