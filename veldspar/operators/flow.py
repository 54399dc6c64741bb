"""From probabilities, groups and matched sentences to revised weights and indices, in one pass of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import indices

#: How a group's pressure is made of its salience and acceptance.
MODES = {"salience_times_contention": "full", "salience_only": "sic"}


def group_means(probabilities: DataFrame, groups: DataFrame, id_col: str) -> DataFrame:
    """(group, sic, p, n): the mean out-of-fold probability of each group of ``indices.group_sic`` that has rows with one."""
    means = probabilities.join(groups, id_col).groupBy("group").agg(F.avg("p").alias("p"), F.count("*").alias("n"))
    return means.join(F.broadcast(indices.group_sic(probabilities.sparkSession)), "group").select("group", "sic", "p", "n")


def relevance_shares(matches: DataFrame, groups: DataFrame, id_col: str, rules: list[tuple[int, int]]) -> DataFrame:
    """(s, f, group, criterion, recovered, relevant, share) from (id, criterion, matched_sentences, families): a document is relevant with ``s`` matched sentences and ``f`` families or more.

    All rules are counted in one pass; every document has a row for each criterion, so pairs without relevant documents are there.
    """
    counts = [F.count_if((F.col("matched_sentences") >= s) & (F.col("families") >= f)).alias(f"r{k}") for k, (s, f) in enumerate(rules)]
    wide = matches.join(groups, id_col).groupBy("group", "criterion").agg(F.count("*").alias("recovered"), *counts)
    rows = F.explode(F.array(*(F.struct(F.lit(s).alias("s"), F.lit(f).alias("f"), F.col(f"r{k}").alias("relevant")) for k, (s, f) in enumerate(rules)))).alias("x")
    return wide.select("group", "criterion", "recovered", rows).select("x.s", "x.f", "group", "criterion", "recovered", "x.relevant", (F.col("x.relevant") / F.col("recovered")).alias("share"))


def weights_of(means: DataFrame, shares: DataFrame, weights: DataFrame, deltas: list[float]) -> DataFrame:
    """(s, f, mode, delta, criterion, w0, pressure, weight, change) for each rule, mode and delta.

    ``weights``: (criterion, w0, name), the name being the criterion's in ``shares``.  Both modes are sums of one grouped pass, and all deltas one small product.
    """
    j = shares.join(means, "group")
    e = {m: F.col("sic") * (1 - F.col("p")) if kind == "full" else F.col("sic") for m, kind in MODES.items()}
    g = j.groupBy("s", "f", "criterion").agg(*(F.coalesce(F.try_divide(F.sum(x * F.col("share")), F.sum(x)), F.lit(0.0)).alias(m) for m, x in e.items()))
    rows = F.explode(F.array(*(F.struct(F.lit(m).alias("mode"), F.col(m).alias("g")) for m in MODES))).alias("x")
    long = g.select("s", "f", F.col("criterion").alias("name"), rows).select("s", "f", "name", "x.mode", "x.g")
    long = long.join(weights, "name").withColumn("delta", F.explode(F.array(*map(F.lit, deltas))))
    weight = indices.normalised(F.col("w0") * (1 + F.col("delta") * F.col("g")), "s", "f", "mode", "delta")
    return long.withColumn("weight", weight).select("s", "f", "mode", "delta", "criterion", "w0", F.col("g").alias("pressure"), "weight", (F.col("weight") - F.col("w0")).alias("change"))


def corpus_indices(means: DataFrame) -> DataFrame:
    """(I, R, S, pci, sigma, rpci, nonlinear) of the groups' means; null where the investor's or the government's is missing."""
    d = indices.mapped_domains(means)
    c = F.col("I"), F.col("R"), F.col("S")
    return d.select("I", "R", "S", indices.pci(*c).alias("pci"), indices.sigma(*c).alias("sigma"), indices.rpci_norm(*c).alias("rpci"), indices.pci_nonlinear(*c).alias("nonlinear"))
