"""A training-corpus pipeline: language, quality, near duplicates, benchmark leaks, packing.

Every stage reads what its predecessor kept and returns the columns of documents; the last returns packed pieces. All
stages read whole texts of any length, keep rows with a null id and repeated rows as rows of their own (unless they
are near copies), pass other columns through whatever their names, and give an empty table for an empty one.
"""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from predial.llm import decontamination, jaccard, language, packing, quality
from predial.llm.shared import free_name, small_batches, write_table

#: A document whose leading language holds a smaller part of its words is rejected.
LEADING = 0.5
#: Near copies share this part (in per cent) of their shingles of so many words; op7 alone has its own rule.
PERCENT, WORDS = 80, 5


def keep_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without letters (null and empty ones too) and texts of which no language holds half of the words.

    Of languages that hold equal parts the first by name leads. Where no document has a language, all are rejected.
    """
    small_batches(spark)
    lead, share, others = (free_name(docs, name) for name in ("__lang", "__share", "__languages"))
    scored = language.add_language(docs, language.train(docs), names=(lead, share, others))
    return scored.where((F.col(lead) != language.UNDECIDED) & (F.col(share) >= LEADING)).select(docs.columns)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects the documents that importance resampling leaves out.

    As many stay as the share of quality 1 among the labelled ones says; rows whose keys tie at the bound all stay. A
    null or empty text weighs 0. Without labels all stay.
    """
    small_batches(spark)
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    ratio, key = free_name(docs, "__ratio"), free_name(docs, "__key")
    scored = quality.add_scores(docs, model, names=(ratio, key))
    # The keys alone are written for finding the bound; texts are scored anew rather than stored a second time.
    keys, _ = write_table(scored.select(key), "quality")
    return scored.where(F.col(key) >= quality.resample(keys, model.share, key)).select(docs.columns)


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the row of smallest id of each group of near copies, the first of its rows where that id is repeated.

    A null id counts as the greatest. Rows decide, not ids: differing texts of one id are documents of their own. Null,
    empty and blank texts are no copies of each other.
    """
    small_batches(spark)
    number = free_name(docs, "__row")
    rows, _ = write_table(docs.withColumn(number, F.monotonically_increasing_id()), "rows")
    named = rows.select(F.col(number).alias("__row"), "doc_id")
    found = jaccard.components(rows, percent=PERCENT, k=WORDS, id_col=number).select(F.col("doc_id").alias("__row"), F.col("component_id").alias("__group"))
    placed, _ = write_table(found.hint("merge").join(named, "__row"), "groups")
    several = placed.groupBy("__group").agg(F.count("*").alias("n"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "__row"))["__row"].alias("__keep")).where("n > 1")
    dropped, _ = write_table(placed.join(several.hint("merge"), "__group").where("__row <> __keep").select(F.col("__row").alias(number)), "dropped")
    # A merge join at every size: the rows to drop grow with the corpus.
    return rows.join(dropped.hint("merge"), number, "left_anti").select(docs.columns)


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that hold a passage of the benchmark; null and empty texts hold none, an empty benchmark rejects none."""
    small_batches(spark)
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 1024 tokens; a null text is empty and has its end alone."""
    small_batches(spark)
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("language", keep_language), ("quality", keep_quality), ("near_duplicates", keep_distinct), ("decontamination", keep_clean), ("packing", pack)]

#: The stages learn models; SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs, _ = write_table(stage(spark, docs, sf_dir), f"stage_{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
