"""Grids of parameters and simulations."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lexicons import SCENARIOS
from .indices import pci, rpci_norm
from .metrics import distribution


def one_at_a_time(scenarios: DataFrame, deltas: list[float]) -> DataFrame:
    """Each domain of each scenario changed by a share, clipped to [0, 1]: index values and their changes."""
    spark = scenarios.sparkSession
    grid = scenarios.crossJoin(F.broadcast(spark.createDataFrame([(d,) for d in "IRS"], "domain string"))).crossJoin(F.broadcast(spark.createDataFrame([(x,) for x in deltas], "delta double")))
    moved = [F.when(F.col("domain") == d, F.least(F.greatest(F.col(d) * (1 + F.col("delta")), F.lit(0.0)), F.lit(1.0))).otherwise(F.col(d)) for d in "IRS"]
    old = [F.col(d) for d in "IRS"]
    return grid.select("scenario", "domain", "delta", pci(*moved).alias("PCI"), rpci_norm(*moved).alias("RPCI"), (pci(*moved) - pci(*old)).alias("PCI_change"), (rpci_norm(*moved) - rpci_norm(*old)).alias("RPCI_change"))


def monte_carlo(scenarios: DataFrame, n: int, sd: float = 0.05, least: float = 0.70, seed: int = 42) -> DataFrame:
    """Index distributions of scenarios with normal noise, drawn by Spark: any number of draws, no driver work."""
    draws = scenarios.crossJoin(scenarios.sparkSession.range(n).select("id"))
    noisy = [F.least(F.greatest(F.col(d) + sd * F.randn(seed + k), F.lit(0.0)), F.lit(1.0)) for k, d in enumerate("IRS")]
    draws = draws.select("scenario", *(x.alias(d) for x, d in zip(noisy, "IRS")))
    return draws.select("scenario", pci(F.col("I"), F.col("R"), F.col("S")).alias("PCI")).groupBy("scenario").agg(F.count("*").alias("n"), *distribution("PCI", least))


def monte_carlo_reference_stream(n: int = 10_000, sd: float = 0.05, seed: int = 42) -> dict[str, np.ndarray]:
    """Linear index values from numpy's legacy stream in the order scenario, then domain: the recorded simulation."""
    np.random.seed(seed)
    out = {}
    for name, (i, r, s) in SCENARIOS.items():
        x = [np.clip(np.random.normal(m, sd, n), 0, 1) for m in (i, r, s)]
        out[name] = 0.30 * x[0] + 0.35 * x[1] + 0.35 * x[2]
    return out


def stance_grid(scores: DataFrame, a: str, b: str, weights: list[float], thresholds: list[float]) -> DataFrame:
    """Counts of each kind for every weight of reading A and least distance from 0.  Rows are counted in one pass for all cells of the grid."""
    cells = []
    for w in weights:
        s = w * F.col(a) + (1 - w) * F.col(b)
        for t in thresholds:
            clear = F.abs(s) >= t
            cells.append(F.struct(F.lit(w).alias("weight"), F.lit(t).alias("threshold"), F.count_if(clear & (s > 0)).alias("pro"), F.count_if(clear & (s <= 0)).alias("resistant"), F.count_if(~clear).alias("unresolved")))
    got = scores.agg(F.array(*cells).alias("g")).select(F.explode("g").alias("g")).select("g.*")
    return got.withColumn("pro_share", F.try_divide(F.col("pro"), F.col("pro") + F.col("resistant")))


def random_matrices(spark: SparkSession, n: int, weights: DataFrame, groups: DataFrame, delta: float = 0.3, share: Column | None = None, contention: Column | None = None, seed: int = 42) -> DataFrame:
    """One row of invariants over ``n`` random prevalence matrices: weights sum to 1, are positive, and differ from the base weights.

    ``share`` and ``contention`` are numbers of [0, 1) by (m, group, criterion) and by (m, group), else drawn by Spark.
    """
    share, contention = F.rand(seed) if share is None else share, F.xxhash64("m", "group", F.lit(seed)) / 2.0**64 + 0.5 if contention is None else contention
    cells = spark.range(n).withColumnRenamed("id", "m").crossJoin(F.broadcast(groups)).crossJoin(F.broadcast(weights))
    cells = cells.withColumn("share", share).withColumn("e", F.col("sic") * (1 - contention))
    g = cells.groupBy("m", "criterion", "w0").agg((F.sum(F.col("e") * F.col("share")) / F.sum("e")).alias("g"))
    raw = g.withColumn("x", F.col("w0") * (1 + delta * F.col("g")))
    per = raw.groupBy("m").agg(F.sum("x").alias("total"), F.min("x").alias("least"))
    moved = F.max(F.abs(F.col("weight") - F.col("w0")))
    out = raw.join(per, "m").withColumn("weight", F.col("x") / F.col("total")).groupBy("m").agg(F.sum("weight").alias("sum"), F.min("weight").alias("least"), moved.alias("moved"))
    bad, low = F.count_if(F.abs(F.col("sum") - 1) > 1e-12), F.count_if(F.col("least") <= 0)
    return out.agg(F.count("*").alias("matrices"), bad.alias("bad_sums"), low.alias("not_positive"), F.count_if(F.col("moved") > 1e-10).alias("changed"), F.min("least").alias("least"), F.max("moved").alias("most_moved"))


def ratio_identity(weights: DataFrame) -> DataFrame:
    """For criteria j < k: weight ratio over base ratio, and how far it is from the ratio of their factors (criterion, w0, g, weight, delta)."""
    a, b = (weights.select(F.col("criterion").alias(f"c{x}"), *(F.col(c).alias(f"{c}{x}") for c in ("w0", "g", "weight", "delta"))) for x in "jk")
    ratio = (F.col("weightj") / F.col("weightk")) / (F.col("w0j") / F.col("w0k"))
    err = F.abs(ratio - (1 + F.col("deltaj") * F.col("gj")) / (1 + F.col("deltak") * F.col("gk")))
    return a.join(F.broadcast(b), (F.col("cj") < F.col("ck")) & (F.col("deltaj") == F.col("deltak"))).select("cj", "ck", F.col("deltaj").alias("delta"), ratio.alias("ratio"), err.alias("error"))
