"""Multi-criteria indices and weights, as columns and small tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.lexicons import BASE_WEIGHTS, BLEND, DISPERSION, DOMAIN_WEIGHTS, SCENARIOS, SIC, SIC_WEIGHTS


def pci(i: Column, r: Column, s: Column, w=DOMAIN_WEIGHTS) -> Column:
    return w[0] * i + w[1] * r + w[2] * s


def sigma(i: Column, r: Column, s: Column, w=DOMAIN_WEIGHTS) -> Column:
    m = pci(i, r, s, w)
    return F.sqrt(w[0] * (i - m) * (i - m) + w[1] * (r - m) * (r - m) + w[2] * (s - m) * (s - m))


def rpci_raw(i: Column, r: Column, s: Column, w=DOMAIN_WEIGHTS, k: float = DISPERSION) -> Column:
    return F.greatest(F.lit(0.0), pci(i, r, s, w) - k * sigma(i, r, s, w))


def rpci_norm(i: Column, r: Column, s: Column, w=DOMAIN_WEIGHTS, k: float = DISPERSION) -> Column:
    return rpci_raw(i, r, s, w, k) / (1 + k / 2)


def pci_nonlinear(i: Column, r: Column, s: Column, w=DOMAIN_WEIGHTS, blend: float = BLEND) -> Column:
    """The linear index blended with the weighted harmonic mean; linear alone if a domain is 0 or less."""
    linear = pci(i, r, s, w)
    harmonic = F.try_divide(F.lit(1.0), F.try_divide(F.lit(w[0]), i) + F.try_divide(F.lit(w[1]), r) + F.try_divide(F.lit(w[2]), s))
    return F.when((i > 0) & (r > 0) & (s > 0), blend * linear + (1 - blend) * harmonic).otherwise(linear)


def sic(p: Column, l: Column, u: Column, w=SIC_WEIGHTS) -> Column:  # noqa: E741
    return w[0] * p + w[1] * l + w[2] * u


def scenarios(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, *map(float, v)) for k, v in SCENARIOS.items()], "scenario string, I double, R double, S double")


def base_weights(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(BASE_WEIGHTS.items()), "criterion string, w0 double")


def group_sic(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(SIC.items()), "group string, sic double")


def normalised(column: Column, *by: str) -> Column:
    """Divided by its sum in the group; a sum of 0 or less stops the query."""
    total = F.sum(column).over(Window.partitionBy(*by))
    return F.when(total > 0, column / total).otherwise(F.raise_error(F.lit("the weights' sum isn't positive")).cast("double"))


def scaled_by_group(weights: DataFrame, sic_: Column, delta: Column, *by: str) -> DataFrame:
    """The original rule, w0 (1 + delta SIC) over the sum: the factor is the same for all criteria and cancels."""
    return weights.withColumn("weight", normalised(F.col("w0") * (1 + delta * sic_), *by))


def pressure(matrix: DataFrame, acceptance: DataFrame, mode: str = "full") -> DataFrame:
    """(criterion, g) from (group, criterion, share) and (group, sic, p[, n]): sum of E times share over sum of E.

    E is SIC (1 - p); the modes drop parts of it: equal, volume (n), sic, full.  Mode none has no pressure.
    """
    e = {"none": F.lit(0.0), "equal": F.lit(1.0), "volume": F.col("n").cast("double") if "n" in acceptance.columns else F.lit(1.0), "sic": F.col("sic"), "full": F.col("sic") * (1 - F.col("p"))}[mode]
    j = matrix.join(acceptance, "group").withColumn("e", e)
    return j.groupBy("criterion").agg(F.coalesce(F.try_divide(F.sum(F.col("e") * F.col("share")), F.sum("e")), F.lit(0.0)).alias("g"))


def revised_weights(weights: DataFrame, pressures: DataFrame, deltas: DataFrame, *by: str) -> DataFrame:
    """(criterion, delta, w0, g, weight, change): w0 (1 + delta g) over the sum."""
    j = weights.join(pressures, "criterion").crossJoin(F.broadcast(deltas))
    j = j.withColumn("weight", normalised(F.col("w0") * (1 + F.col("delta") * F.col("g")), "delta", *by))
    return j.withColumn("change", F.col("weight") - F.col("w0"))


def mapped_domains(acceptance: DataFrame) -> DataFrame:
    """One row (I, R, S): investor, government, and the SIC-weighted mean of all groups."""
    pick = lambda g: F.max(F.when(F.col("group") == g, F.col("p")))
    return acceptance.agg(pick("investor").alias("I"), pick("government").alias("R"), (F.sum(F.col("sic") * F.col("p")) / F.sum("sic")).alias("S"))
