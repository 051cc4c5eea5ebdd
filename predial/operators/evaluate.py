"""Evaluation of the valuation: hold-out without leakage, benchmarks, error metrics."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions.prices import ask_clp, benchmark_range, size_bucket
from .components import checkpointed
from .percentiles import percentiles
from .quality import representative
from .valuation import best_scored, level, market_values


def evaluation_rows(listings: DataFrame, limit: int | None = None) -> DataFrame:
    """Active representatives with an area and any price, by id."""
    rows = listings.where((F.col("status") == "active") & (F.col("m2_construidos") > 0) & (F.col("precio_clp").isNotNull() | F.col("precio_uf").isNotNull())).where(representative(listings))
    return rows if limit is None else rows.orderBy("id").limit(limit)


def seeded_order(column: str = "id", seed: int = 42) -> Column:
    """A reproducible shuffle: the same rows in every run and on every engine."""
    return F.md5(F.concat(F.lit(f"{seed}-"), F.col(column).cast("string")))


def split(rows: DataFrame, fraction: float = 0.25, seed: int = 42) -> DataFrame:
    """Adds held_out: the given share (5 to 50 %), one row at least, by the seeded order.

    Where the share falls is found by counting prefixes of the order, so that no single task sorts all rows.
    """
    fraction = min(max(fraction, 0.05), 0.50)
    keyed = rows.withColumn("__order", seeded_order(seed=seed))
    total = rows.count()
    want = max(1, int(round(total * fraction))) if total else 0
    prefix, seen = "", 0
    while want:
        counts = sorted((r.d, r.n) for r in keyed.where(F.col("__order").startswith(prefix)).groupBy(F.substring("__order", len(prefix) + 1, 1).alias("d")).agg(F.count("*").alias("n")).collect())
        for digit, n in counts:
            if seen + n >= want:
                break
            seen += n
        prefix += digit
        if seen + n == want or len(prefix) == 32:
            break
    # All orders up to this prefix (and what continues it) are held out.
    return keyed.withColumn("held_out", F.col("__order") < F.lit(prefix + "g") if want else F.lit(False)).drop("__order")


def identities(df: DataFrame) -> Column:
    """The listing's normalised urls and links."""
    clean = lambda c: F.lower(F.regexp_replace(F.trim(F.col(c)), "/+$", ""))
    return F.array_compact(F.array(*[F.nullif(clean(c), F.lit("")) for c in ("url", "link") if c in df.columns]))


def held_out_predictions(rows: DataFrame, cfg: Config = DEFAULT, least: int = 5) -> DataFrame:
    """A row per held-out listing: its estimate from the others' prices, or the reason why it was skipped.

    A comparable may share neither url nor source id with the target, nor look like the same property.
    """
    own = F.when(F.col("source_listing_id").isNotNull() & F.col("fuente").isNotNull(), F.concat(F.lit("id "), F.length("fuente").cast("string"), F.lit(" "), "fuente", "source_listing_id"))
    known = rows.withColumn("names", F.concat(F.transform(identities(rows), lambda x: F.concat(F.lit("url "), x)), F.array_compact(F.array(own))))
    test, train = known.where("held_out"), known.where("not held_out")
    # A target counts up to ``least`` and keeps top_k of its rows, so its best ones are all that matter; terciles play no part.
    pairs = best_scored(test, train, cfg, max(cfg.top_k, least), by_rooms=False, names="names")
    rank = F.row_number().over(Window.partitionBy("t_id").orderBy(F.desc("score"), "c_id"))
    pairs = pairs.withColumn("__rank", rank).where(F.col("__rank") <= max(cfg.top_k, least))
    # Rows, not arrays: an array's steps would be repeated in every expression that reads its result.
    own, size = Window.partitionBy("t_id"), F.count("*").over(Window.partitionBy("t_id"))
    r = level(pairs, cfg, False, least).withColumn("n", size).where(F.col("n") >= least).where(F.col("__rank") <= cfg.top_k)
    r = r.withColumns({"n": size, "q1": F.percentile("price_m2", F.lit(0.25)).over(own), "q3": F.percentile("price_m2", F.lit(0.75)).over(own)})
    iqr = F.col("q3") - F.col("q1")
    r = r.withColumn("inside", F.col("price_m2").between(F.col("q1") - 1.5 * iqr, F.col("q3") + 1.5 * iqr)).withColumn("k", F.count_if("inside").over(own))
    r = r.where((F.col("n") < 3) | (iqr <= 0) | (F.col("k") < 3) | F.col("inside")).withColumn("n", size).where(F.col("n") >= least)
    ascending = Window.partitionBy("t_id").orderBy("price_m2", "c_id").rowsBetween(Window.unboundedPreceding, 0)
    r = r.withColumn("run", F.sum("score").over(ascending)).withColumn("total", F.max("run").over(own))
    found = r.groupBy("t_id").agg(
        F.first("t_m2_construidos").alias("m2"), F.first("n").cast("int").alias("comparable_count"), F.first("total").alias("total"), F.avg("score").alias("score"), F.avg("price_m2").alias("mean"), F.stddev_pop("price_m2").alias("spread"),
        F.min(F.when(F.col("run") >= F.col("total") / 2, F.col("price_m2"))).alias("half"), F.percentile("price_m2", F.lit(0.5)).alias("middle"))
    n = F.col("comparable_count")
    even = F.when(F.col("mean") <= 0, 0.0).otherwise(F.greatest(1 - F.least(F.col("spread") / F.col("mean") / 0.35, F.lit(1.0)), F.lit(0.0)))
    sure = F.col("score") * 0.5 + F.least(n / F.lit(10.0), F.lit(1.0)) * 0.25 + even * 0.25
    price = F.when(F.col("total") > 0, F.col("half")).otherwise(F.col("middle"))
    done = found.select(F.col("t_id").alias("id"), (price * F.col("m2")).alias("estimated_price"), n, F.when(n < 3, 0.0).otherwise(F.greatest(F.least(sure, F.lit(1.0)), F.lit(0.0))).alias("confidence_score"))
    base = test.select("id", "comuna", "m2_construidos", ask_clp(cfg).alias("actual_price")).join(done, "id", "left")
    error = F.abs(F.col("estimated_price") - F.col("actual_price"))
    reason = F.when(F.coalesce(F.col("actual_price"), F.lit(0)) <= 0, "invalid").when(F.col("estimated_price").isNull(), "low_data")
    return base.select("id", F.coalesce("comuna", F.lit("Sin dato")).alias("comuna"), size_bucket(F.col("m2_construidos")).alias("size_bucket"), benchmark_range(F.col("m2_construidos")).alias("m2_range"), "actual_price", "estimated_price", "comparable_count", "confidence_score", error.alias("absolute_error"), (error / F.col("actual_price")).alias("percentage_error"), reason.alias("skipped"))


def error_metrics(predictions: DataFrame, by: tuple[str, str] = ("comuna", "size_bucket")) -> DataFrame:
    """Error metrics overall and by each grouping (grouping, value)."""
    rows = predictions.where("skipped is null")
    each = F.explode(F.array(F.struct(F.lit("all").alias("grouping"), F.lit("all").alias("value")), *[F.struct(F.lit(g).alias("grouping"), F.col(g).alias("value")) for g in by]))
    measures = {"median_ae": "absolute_error", "median_pe": "percentage_error", "median_comparables": "comparable_count"}
    flat = checkpointed(rows.select(each.alias("g"), *measures.values()).select("g.grouping", "g.value", *measures.values()))
    means = flat.groupBy("grouping", "value").agg(F.count("*").alias("n"), F.avg("absolute_error").alias("mae"), F.avg("percentage_error").alias("mape"), F.avg("comparable_count").alias("mean_comparables"))
    pairs = F.explode(F.array(*[F.struct(F.lit(name).alias("measure"), F.col(c).cast("double").alias("x")) for name, c in measures.items()]))
    long = flat.select("grouping", "value", pairs.alias("p")).select("grouping", "value", "p.*")
    medians = percentiles(long, ["grouping", "value", "measure"], "x", {"median": 0.5}).groupBy("grouping", "value").agg(*[F.max(F.when(F.col("measure") == name, F.col("median"))).alias(name) for name in measures])
    found = means.withColumn("__g", F.struct("grouping", "value")).join(medians.select(F.struct("grouping", "value").alias("__g"), *measures), "__g")
    return found.select("grouping", "value", "n", "mae", "mape", "median_ae", "median_pe", "mean_comparables", "median_comparables")


def skip_counts(predictions: DataFrame) -> DataFrame:
    return predictions.groupBy(F.coalesce("skipped", F.lit("evaluated")).alias("outcome")).agg(F.count("*").alias("n"))


def extremes(predictions: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` worst and best predictions."""
    rows = predictions.where("skipped is null").select("id", "comuna", "percentage_error")
    worst = rows.orderBy(F.desc("percentage_error"), "id").limit(n).withColumn("kind", F.lit("worst"))
    return worst.unionByName(rows.orderBy("percentage_error", "id").limit(n).withColumn("kind", F.lit("best")))


def holdout(listings: DataFrame, cfg: Config = DEFAULT, fraction: float = 0.25, seed: int = 42) -> DataFrame:
    """Predictions in strict mode, or relaxed (three comparables) where strict evaluates under ten."""
    rows = split(evaluation_rows(listings), fraction, seed)
    strict = checkpointed(held_out_predictions(rows, cfg, 5))
    if strict.where("skipped is null").limit(10).count() >= 10:
        return strict.withColumn("mode", F.lit("STRICT"))
    return held_out_predictions(rows, cfg, 3).withColumn("mode", F.lit("RELAXED"))


def benchmark(listings: DataFrame, cfg: Config = DEFAULT, n: int = 100, seed: int = 0) -> DataFrame:
    """The radar's estimate against the asking price for a seeded sample of ``n`` listings."""
    sample = evaluation_rows(listings).where("comuna is not null").orderBy(seeded_order(seed=seed)).limit(n)
    values = market_values(sample, listings, cfg).select("id", "estimated_price", "comparable_count")
    base = sample.select("id", "comuna", "m2_construidos", ask_clp(cfg).alias("actual_price")).join(values, "id", "left")
    error = F.abs(F.col("estimated_price") - F.col("actual_price"))
    return base.select("id", "comuna", benchmark_range(F.col("m2_construidos")).alias("m2_range"), "actual_price", "estimated_price", "comparable_count", error.alias("absolute_error"), (error / F.col("actual_price")).alias("percentage_error"), F.when(F.col("estimated_price").isNull(), "no_estimate").alias("skipped"))


def repeated_benchmark(listings: DataFrame, cfg: Config = DEFAULT, n: int = 100, seeds: tuple[int, ...] = (0, 1, 2, 3, 4)) -> DataFrame:
    """The benchmark() of each seed as a run: run, id, actual_price, estimated_price, percentage_error, skipped.

    The samples of all runs are dealt by one ranked limit, their listings valued once, and the values dealt back.
    """
    rows = evaluation_rows(listings).where("comuna is not null")
    order = F.md5(F.concat(F.col("run").cast("string"), F.lit("-"), F.col("id").cast("string")))
    dealt = rows.select("id", F.explode(F.array(*[F.lit(s) for s in seeds])).alias("run"))
    rank = F.row_number().over(Window.partitionBy("run").orderBy(order, "id"))
    dealt = checkpointed(dealt.withColumn("rank", rank).where(F.col("rank") <= n).drop("rank"))
    targets = rows.join(dealt.select("id").distinct(), "id", "left_semi")
    values = market_values(targets, listings, cfg).select("id", "estimated_price")
    base = checkpointed(targets.select("id", ask_clp(cfg).alias("actual_price")).join(values, "id", "left"))
    error = F.abs(F.col("estimated_price") - F.col("actual_price")) / F.col("actual_price")
    return dealt.join(base, "id").select("run", "id", "actual_price", "estimated_price", error.alias("percentage_error"), F.when(F.col("estimated_price").isNull(), "no_estimate").alias("skipped"))


def run_errors(runs: DataFrame) -> DataFrame:
    """A row per run that evaluated anything: mape, median_pe, evaluated and skipped."""
    per = runs.groupBy("run").agg(F.avg("percentage_error").alias("mape"), F.percentile("percentage_error", F.lit(0.5)).alias("median_pe"), F.count_if(F.col("skipped").isNull()).alias("evaluated"), F.count_if(F.col("skipped").isNotNull()).alias("skipped"))
    return per.where("evaluated > 0")


def best_and_worst(metrics: DataFrame) -> DataFrame:
    """Per grouping: the groups of least and greatest median error."""
    key = F.struct("median_pe", "mape", "value")
    return metrics.where("grouping <> 'all'").groupBy("grouping").agg(F.min_by("value", key).alias("best"), F.max_by("value", key).alias("worst"))


def run_summary(runs: DataFrame, metric: str = "mape") -> DataFrame:
    """Over repeated runs: their number, and mean, extremes and sample deviation of a metric; of equal runs the first."""
    return runs.agg(F.count("*").alias("runs"), F.avg(metric).alias("mean"), F.min_by("run", metric).alias("best_run"), F.max_by("run", metric).alias("worst_run"), F.stddev_samp(metric).alias("deviation"))


def rank_within(df: DataFrame, by: str, order: list[Column], name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(by).orderBy(*order)))
