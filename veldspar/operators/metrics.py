"""Classification metrics and shares as single-pass aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def confusion(df: DataFrame, truth: str, guess: str, *by: str) -> DataFrame:
    """Cells, accuracy, balanced accuracy, precision, recall, F1 and kappa for labels 0 and 1."""
    t, g = F.col(truth), F.col(guess)
    cells = df.groupBy(*by).agg(*(F.count_if((t == a) & (g == b)).alias(n) for n, a, b in (("tn", 0, 0), ("fp", 0, 1), ("fn", 1, 0), ("tp", 1, 1))))
    tn, fp, fn, tp = (F.col(x).cast("double") for x in ("tn", "fp", "fn", "tp"))
    n = tn + fp + fn + tp
    recall, spec, precision = F.try_divide(tp, tp + fn), F.try_divide(tn, tn + fp), F.try_divide(tp, tp + fp)
    accuracy = F.try_divide(tp + tn, n)
    chance = F.try_divide((tp + fp) * (tp + fn) + (tn + fn) * (tn + fp), n * n)
    return cells.select(
        *by, "tn", "fp", "fn", "tp", accuracy.alias("accuracy"), ((recall + spec) / 2).alias("balanced_accuracy"), precision.alias("precision"), recall.alias("recall"),
        F.try_divide(2 * tp, 2 * tp + fp + fn).alias("f1"), F.try_divide(accuracy - chance, 1 - chance).alias("kappa"),
    )


def roc_auc(df: DataFrame, truth: str, score: str) -> DataFrame:
    """(auc): the share of pairs in the right order, ties for half.

    Rows are counted by score first.  The running sum then goes over 1,000 ranges of scores between the least and the largest: one task adds up the
    ranges' totals, and others go on inside each range.
    """
    n = df.groupBy(F.col(score).alias("s")).agg(F.count_if(F.col(truth) == 1).alias("p"), F.count_if(F.col(truth) == 0).alias("q"))
    ends = n.agg(F.min("s").alias("lo"), F.max("s").alias("hi"))
    n = n.crossJoin(F.broadcast(ends)).withColumn("range", F.coalesce(F.floor(F.try_divide(F.col("s") - F.col("lo"), F.col("hi") - F.col("lo")) * 1000), F.lit(0).cast("long"))).drop("lo", "hi")
    totals = n.groupBy("range").agg(F.sum("q").alias("rq"))
    before = totals.withColumn("base", F.coalesce(F.sum("rq").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("range", "base")
    inner = Window.partitionBy("range").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    below = n.join(before, "range").withColumn("below", F.col("base") + F.coalesce(F.sum("q").over(inner), F.lit(0)))
    return below.agg(F.try_divide(F.sum(F.col("p") * (F.col("below") + F.col("q") / 2)), F.sum("p") * F.sum("q")).alias("auc"))


def weighted_mean(value: Column, weight: Column) -> Column:
    return F.try_divide(F.sum(weight * value), F.sum(weight))


def shares(df: DataFrame, by: str, flag: Column, least: int) -> DataFrame:
    """Groups of ``least`` rows or more with the share of rows that hold."""
    return df.groupBy(by).agg(F.count("*").alias("n"), F.count_if(flag).alias("k")).where(F.col("n") >= least).withColumn("share", F.col("k") / F.col("n")).orderBy(F.desc("n"), by)


def distribution(value: str, least: float) -> list[Column]:
    """Mean, population deviation, linear percentiles and the share that reaches ``least``, for groups of a bounded size; ``order.percentiles`` has none."""
    return [F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"), F.percentile(value, F.lit(0.05)).alias("p05"), F.percentile(value, F.lit(0.95)).alias("p95"), F.avg((F.col(value) >= least).cast("int")).alias("exceeds")]


def conservative_bounds(positive: Column, negative: Column, unresolved: Column, share: float = 0.5) -> list[Column]:
    """Shares if all unresolved rows were of one kind, and how many negative rows have to flip besides for a majority, or for a share, of positive ones."""
    n = positive + negative + unresolved
    most = positive + unresolved
    flips = lambda need: F.greatest(F.lit(0).cast("long"), need.cast("long") - most)
    return [(positive / n).alias("low"), (most / n).alias("high"), (negative / n).alias("least_negative"), flips(F.floor(n / 2) + 1).alias("flips_to_majority"), flips(F.ceil(share * n)).alias("flips_to_share")]
