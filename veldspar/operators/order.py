"""Places in a whole order and exact percentiles, without a task that holds all rows of a table or group."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import shared_dir, written

#: Bits that number the rows of one partition.
_ROWS = 33
#: Values of a range that are put in order at once; pieces that a larger one is cut into.
AT_ONCE, PIECES = 100_000, 64


def numbered(df: DataFrame, *order: Column | str, name: str = "k", parts: int | None = None) -> DataFrame:
    """``df`` with its rows' places in ``order`` from 1, as a long.

    Rows are dealt by ranges of the order, put in order there and written; the numbers of rows in the ranges before are added, one number a range.  Rows that ``order`` doesn't tell apart are
    numbered in the order of all their columns' hash, so ties of any number are split over ranges too, and the numbers are the same each time (for rows equal in all columns, that one is as good as another).
    """
    spark, folder = df.sparkSession, shared_dir(df.sparkSession)
    by = [F.col(c) if isinstance(c, str) else c for c in order]
    # in the row's own partition before it is dealt: only tells equal rows apart
    rows = df.withColumn("_h", F.xxhash64(*df.columns)).withColumn("_own", F.monotonically_increasing_id())
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(n, *by, "_h", "_own").sortWithinPartitions(*by, "_h", "_own")
    rows = written(rows.drop("_h", "_own").withColumn("_at", F.monotonically_increasing_id()), folder, "ordered")
    part = F.shiftright("_at", _ROWS)
    sizes = {r.p: r["count"] for r in rows.groupBy(part.alias("p")).count().collect()}
    starts = list(accumulate((sizes.get(p, 0) for p in range(max(sizes, default=0) + 1)), initial=1))
    start = F.element_at(F.lit(starts).cast("array<bigint>"), (part + 1).cast("int"))
    return rows.withColumn(name, start + F.col("_at").bitwiseAND((1 << _ROWS) - 1)).drop("_at")


def joined_by_place(a: DataFrame, b: DataFrame, order_a: list, order_b: list, how: str = "inner") -> DataFrame:
    """Rows of two tables side by side: the first with the first, and so on."""
    return numbered(a, *order_a, name="_k").join(numbered(b, *order_b, name="_k"), "_k", how).drop("_k")


def percentiles(df: DataFrame, group: str, value: str, shares: dict[str, float], at_once: int = AT_ONCE) -> DataFrame:
    """(group, one double a name of ``shares``): exact percentiles with linear interpolation, nulls left out.

    Equal values are counted first, so the most frequent value is one row.  Then the two values around each share are selected: the range that is known to hold a value's
    place is cut at approximate quantiles, exact counts of the pieces tell which one holds it, and so on until ranges have ``at_once`` distinct values or
    fewer; only those are put in order.  Each round divides the ranges by some ``PIECES``, whatever the distribution.
    """
    spark, folder = df.sparkSession, shared_dir(df.sparkSession)
    # a struct, as those of a null are equal
    values = df.select(F.struct(F.col(group).alias("g")).alias("g"), F.col(value).cast("double").alias("v")).where("v is not null").groupBy("g", "v").agg(F.count("*").alias("n"))
    values = written(values, folder, "values")
    sizes = values.groupBy("g").agg(F.sum("n").alias("total"), F.count("*").alias("many"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    places = F.explode(F.array(*(F.struct(F.lit(k).alias("share"), ((F.col("total") - 1) * F.lit(p)).alias("place")) for k, p in shares.items()))).alias("x")
    wanted = sizes.select("g", "lo", "hi", "many", places).select("g", "lo", "hi", "many", "x.*").select("g", "lo", "hi", "many", "share", "place", F.explode(F.array_distinct(F.array(F.floor("place"), F.ceil("place")))).alias("rank"))
    wanted = written(wanted, folder, "wanted")
    ranges = wanted.select("g", "rank", "lo", "hi", "many", F.lit(0).cast("long").alias("before")).distinct()
    found, k = [], 0
    while True:
        ranges = written(ranges, folder, f"ranges{k}")
        few = values.join(ranges.where(F.col("many") <= at_once), "g").where(F.col("v").between(F.col("lo"), F.col("hi")))
        through = Window.partitionBy("g", "rank").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
        found.append(written(few.withColumn("upto", F.col("before") + F.sum("n").over(through)).where("upto > rank and upto - n <= rank").select("g", "rank", "v"), folder, f"found{k}"))
        large = ranges.where(F.col("many") > at_once)
        if large.isEmpty():
            break
        k += 1
        inside = values.join(large, "g").where(F.col("v").between(F.col("lo"), F.col("hi")))
        cuts = inside.groupBy("g", "rank").agg(F.percentile_approx("v", [j / PIECES for j in range(1, PIECES)], 1000).alias("cuts"))
        pieces = inside.join(cuts, ["g", "rank"]).withColumn("piece", F.size(F.filter("cuts", lambda c: c <= F.col("v"))))
        pieces = pieces.groupBy("g", "rank", "before", "piece").agg(F.sum("n").alias("n"), F.count("*").alias("many"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        upto = F.col("before") + F.sum("n").over(Window.partitionBy("g", "rank").orderBy("piece").rowsBetween(Window.unboundedPreceding, 0))
        ranges = pieces.withColumn("upto", upto).where("upto > rank and upto - n <= rank").select("g", "rank", "lo", "hi", "many", (F.col("upto") - F.col("n")).alias("before"))
    got = found[0]
    for x in found[1:]:
        got = got.union(x)
    ends = wanted.join(got, ["g", "rank"]).select("g", "share", "place", "v")
    ends = ends.groupBy("g", "share", "place").agg(F.min("v").alias("a"), F.max("v").alias("b"))
    part = F.col("place") - F.floor("place")
    each = ends.select("g", "share", F.when(F.col("a") == F.col("b"), F.col("a")).otherwise((1 - part) * F.col("a") + part * F.col("b")).alias("value"))
    return each.groupBy(F.col("g.g").alias(group)).agg(*(F.max(F.when(F.col("share") == k, F.col("value"))).alias(k) for k in shares))
