"""Places and percentiles against sorted lists."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from veldspar.operators.order import joined_by_place, numbered, percentiles


def test_places_equal_a_sorted_list(spark):
    rng = random.Random(1)
    rows = [(rng.choice("abc"), rng.randrange(5), i) for i in range(500)] + [(None, 1, 1000), ("b", None, 1001)]
    df = spark.createDataFrame(rows, "c string, n int, id long").repartition(7)
    got = [(r.c, r.n, r.id) for r in sorted(numbered(df, "c", F.desc("n"), "id", parts=6).collect(), key=lambda r: r.k)]
    assert got == sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", -r[1] if r[1] is not None else 9, r[2]))
    assert sorted(r.k for r in numbered(df, "c").collect()) == list(range(1, 503))


def test_ties_are_split_and_stable(spark):
    df = spark.range(3000).select(F.lit(1).alias("same"), "id")
    own = numbered(df, "same", parts=4)
    assert own.groupBy(F.spark_partition_id()).count().count() > 1
    first, again = ({(r.id, r.k) for r in numbered(df.repartition(n), "same", parts=4).collect()} for n in (2, 5))
    assert first == again
    equal = spark.createDataFrame([(1,)] * 300, "x int")
    assert sorted(r.k for r in numbered(equal, "x", parts=3).collect()) == list(range(1, 301))
    assert numbered(df.limit(0), "id").count() == 0


def test_no_window_without_a_key(spark):
    plan = numbered(spark.range(100), "id")._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "Window" not in plan


def test_tables_side_by_side(spark):
    a, b = spark.createDataFrame([(3,), (1,), (2,)], "x int"), spark.createDataFrame([("q",), ("p",)], "y string")
    assert sorted(map(tuple, joined_by_place(a, b, ["x"], ["y"]).collect())) == [(1, "p"), (2, "q")]
    assert sorted(map(str, joined_by_place(a, b, [F.desc("x")], ["y"], "left").collect())) == ["Row(x=1, y=None)", "Row(x=2, y='q')", "Row(x=3, y='p')"]


@pytest.mark.parametrize("at_once", [100_000, 7, 1])
def test_percentiles_equal_sorted_lists(spark, at_once):
    rng = random.Random(at_once)
    groups = {"even": [rng.random() for _ in range(300)], "steep": [10.0 ** rng.uniform(-300, 300) for _ in range(200)], "ties": [5.0] * 400 + [1.0, 9.0, 9.0], "one": [3.5], None: [1.0, 2.0], "big": [float(i) for i in range(1000)]}
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("even", None), ("none", None)]
    rng.shuffle(rows)
    shares = {"p05": 0.05, "median": 0.5, "p95": 0.95, "least": 0.0, "most": 1.0}
    got = {r.g: r for r in percentiles(spark.createDataFrame(rows, "g string, v double"), "g", "v", shares, at_once).collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        for name, p in shares.items():
            assert got[g][name] == pytest.approx(np.percentile(vs, 100 * p), rel=1e-9), (g, name)


def test_percentiles_of_nothing(spark):
    assert percentiles(spark.createDataFrame([], "g string, v double"), "g", "v", {"p": 0.5}).count() == 0
