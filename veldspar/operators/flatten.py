"""Duplicate decisions of several origins, flattened: one keeper for everything that pairs connect."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..tables import shared_dir, written


def star_pairs(df: DataFrame, id_col: str, origin: str, *keys: str) -> DataFrame:
    """(origin, a, b): every row that has others of equal keys, with the smallest id of them; as connected as all pairs, and one row each.  Null keys are equal to none."""
    own = df.select(F.col(id_col).alias("b"), *keys).na.drop(subset=list(keys))
    first = own.groupBy(*keys).agg(F.min("b").alias("a"), F.count("*").alias("n")).where("n > 1").drop("n")
    return own.join(first, list(keys)).where("a < b").select(F.lit(origin).alias("origin"), "a", "b")


def components(pairs: DataFrame, folder: str, most_rounds: int = 200) -> DataFrame:
    """(node, component): the smallest node that pairs (a, b) connect a node with, for every node of a pair.

    Large-star and small-star steps alternate: each node's larger neighbours move to its smallest one, then its smaller ones do.  Every step is a grouped minimum and a join,
    written to ``folder``; a chain of n nodes takes some log n rounds, and a node of any number of neighbours is a key that joins can split.  Pairs of a node with itself and repeated ones are harmless.
    """
    cur = written(pairs.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), folder, "edges0")
    before = None
    for k in range(1, most_rounds + 1):
        both = cur.union(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # a (larger neighbour, smallest of all) for each node; duplicates go before the next join
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        cur = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(small.select("a", F.col("m").alias("b"))).distinct()
        cur = written(cur, folder, f"edges{k}")
        now = cur.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return cur.select(F.col("a").alias("node"), F.col("b").alias("component")).union(cur.select("b", F.col("b")).distinct())
        before = now
    raise RuntimeError(f"not settled after {most_rounds} rounds")


def flatten(records: DataFrame, id_col: str, pairs: DataFrame, *order: Column) -> DataFrame:
    """(id_col, keeper, kept, size, origins): every record with the keeper of its component, the first by ``order`` and id; a record of no pair keeps itself.

    ``pairs`` (origin, a, b) may come from several reviews, may chain and may contradict one another: what one drops, another may keep.  No keeper is itself dropped, and none is kept
    through a chain.  ``origins`` are those of the component's pairs.  A pair of an id that ``records`` lacks, or a repeated or null id there, stops the query.
    """
    folder = shared_dir(records.sparkSession)
    pairs = written(pairs.select("origin", "a", "b"), folder, "pairs")
    parts = written(components(pairs, folder), folder, "components")
    places = [o.alias(f"o{k}") for k, o in enumerate(order)]
    rows = records.select(F.col(id_col).alias("id"), F.struct(*places, F.col(id_col).alias("id")).alias("place"))
    named = parts.select(F.col("node").alias("id"), "component")
    # ids of pairs that no record has
    lost = named.join(rows.select("id"), "id", "left_anti").take(5)
    bad = rows.groupBy("id").agg(F.count("*").alias("n")).where("n > 1 or id is null").take(5)
    if lost or bad:
        raise ValueError(f"pairs of unknown ids: {lost}; repeated or null ids: {bad}")
    member = rows.join(named, "id")
    keepers = member.groupBy("component").agg(F.min("place").alias("p"), F.count("*").alias("size")).select("component", F.col("p.id").alias("keeper"), "size")
    origins = pairs.join(parts, pairs["a"] == parts["node"]).groupBy("component").agg(F.array_sort(F.collect_set("origin")).alias("origins"))
    flat = named.join(keepers, "component").join(origins, "component")
    flat = records.select(id_col).join(flat.withColumnRenamed("id", id_col), id_col, "left")
    keeper = F.coalesce("keeper", id_col)
    return flat.select(id_col, keeper.alias("keeper"), (keeper == F.col(id_col)).alias("kept"), F.coalesce("size", F.lit(1)).alias("size"), F.coalesce("origins", F.array().cast("array<string>")).alias("origins"))
