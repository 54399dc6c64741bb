"""Components and flattened decisions against union-find."""

import random

import pytest
from pyspark.sql import functions as F

from veldspar.operators.flatten import components, flatten, star_pairs


def plain(pairs):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in parent}


def found(spark, pairs, tmp_path, kind="long"):
    df = spark.createDataFrame(pairs, f"a {kind}, b {kind}") if isinstance(pairs, list) else pairs
    rows = [(r.node, r.component) for r in components(df, f"file://{tmp_path}").collect()]
    assert len(rows) == len(dict(rows))
    return dict(rows)


def test_chain_is_flat(spark, tmp_path):
    rng = random.Random(1)
    names = list(range(1000))
    rng.shuffle(names)
    assert set(found(spark, list(zip(names, names[1:])), tmp_path).values()) == {0}


def test_star_is_flat(spark, tmp_path):
    hub = spark.range(100_000).where("id <> 50000").select(F.when(F.col("id") % 2 == 0, F.col("id")).otherwise(F.lit(50_000)).alias("a"), F.when(F.col("id") % 2 == 0, F.lit(50_000)).otherwise(F.col("id")).alias("b"))
    got = components(hub, f"file://{tmp_path}")
    assert got.count() == 100_000 and [r.component for r in got.select("component").distinct().collect()] == [0]


def test_random_graphs(spark, tmp_path):
    rng = random.Random(2)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(7, 7), (1, 2), (2, 1), (1, 2)]
    assert found(spark, pairs, tmp_path / "a") == plain([p for p in pairs if p[0] != p[1]])
    words = [(f"w{a}", f"w{b}") for a, b in pairs if a != b]
    assert found(spark, words, tmp_path / "b", "string") == plain(words)
    assert found(spark, spark.createDataFrame([], "a long, b long"), tmp_path / "c") == {}


def test_flattened_decisions(spark):
    # 1 drops 2, another review drops 3 for 2, and a third one keeps 3 over 1: one component, whose keeper is the earliest
    pairs = spark.createDataFrame([("hash", 1, 2), ("title", 2, 3), ("review", 3, 1), ("hash", 5, 6)], "origin string, a long, b long")
    records = spark.createDataFrame([(1, 2015, "x"), (2, 2013, "x"), (3, 2013, "y"), (4, 2010, "z"), (5, None, "z"), (6, 2011, "z")], "id long, year int, keeper string")
    got = {r.id: (r.keeper, r.kept, r["size"], r.origins) for r in flatten(records, "id", pairs, F.coalesce("year", F.lit(9999))).collect()}
    three, two = ["hash", "review", "title"], ["hash"]
    assert got == {1: (2, False, 3, three), 2: (2, True, 3, three), 3: (2, False, 3, three), 4: (4, True, 1, []), 5: (6, False, 2, two), 6: (6, True, 2, two)}
    assert flatten(records, "id", pairs.limit(0)).where("kept").count() == 6


def test_unknown_and_repeated_ids_stop(spark):
    records = spark.createDataFrame([(1,), (2,)], "id long")
    for rows, pairs in ((records, [("h", 1, 9)]), (records.union(records), [("h", 1, 2)]), (records.union(spark.createDataFrame([(None,)], "id long")), [("h", 1, 2)])):
        with pytest.raises(ValueError):
            flatten(rows, "id", spark.createDataFrame(pairs, "origin string, a long, b long"))


def test_stars_connect_what_keys_do(spark):
    rows = [(1, "a", None), (2, "a", "x"), (3, "b", "x"), (4, None, None), (5, None, None), (6, "a", "y")]
    df = spark.createDataFrame(rows, "id long, k string, j string")
    assert sorted(map(tuple, star_pairs(df, "id", "k", "k").collect())) == [("k", 1, 2), ("k", 1, 6)]
    assert sorted(map(tuple, star_pairs(df, "id", "kj", "k", "j").collect())) == [] and sorted(map(tuple, star_pairs(df, "id", "j", "j").collect())) == [("j", 2, 3)]
