"""Scans, sinks, checks, models and pair joins on small tables."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from veldspar.operators import dedup, features, integrity, rules
from veldspar.sources import readers, writers


def test_typed_scan_of_several_files(spark, tmp_path):
    for name, text in (("b_1.csv", "id,x\n3,0.5\n"), ("a_1.csv", 'id,x\n1,1.5\n2,"2.5"\n'), ("c.txt", "id,x\n9,9\n")):
        (tmp_path / name).write_text(text)
    got = readers.read_typed(spark, f"{tmp_path}/*_1.csv", "id int, x double").collect()
    assert [(r.file, r.id, r.x) for r in got] == [("a_1.csv", 1, 1.5), ("a_1.csv", 2, 2.5), ("b_1.csv", 3, 0.5)]
    (tmp_path / "d_2.csv").write_text("id,x\none,1\n")
    with pytest.raises(Exception, match="(?i)malformed|cast"):
        readers.read_typed(spark, f"{tmp_path}/*_2.csv", "id int, x double").collect()


def test_candidates_json_and_union_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,screening_status\n1,kept\n")
    (tmp_path / "b.csv").write_text("id,status,relevance_note\n2,out,far\n")
    got = readers.read_candidates(spark, [(f"{tmp_path}/a.csv", ["id", "screening_status"]), (f"{tmp_path}/b.csv", ["id", "status", "relevance_note"])])
    assert {(r.id, r.any_status, r.any_reason, r.file) for r in got.collect()} == {("1", "kept", None, "a.csv"), ("2", "out", "far", "b.csv")}
    (tmp_path / "one.json").write_text(json.dumps({"a": 1, "b": ["x"]}, indent=1))
    assert readers.read_json(spark, f"{tmp_path}/one.json", "a int, b array<string>").first().asDict() == {"a": 1, "b": ["x"]}
    writers.write_csv([spark.createDataFrame([(1, "x,y")], "a int, b string"), spark.createDataFrame([(2, True)], "a int, c boolean")], f"{tmp_path}/out")
    back = readers.read_csv(spark, f"{tmp_path}/out")
    assert back.columns == ["a", "b", "c"] and {(r.a, r.b, r.c) for r in back.collect()} == {("1", "x,y", None), ("2", None, "true")}


def test_tables_are_whole_or_an_error(spark):
    df = spark.range(300).withColumn("t", F.lit("y" * 60))
    assert len(writers.markdown_table(df).splitlines()) == 302
    shown = writers.console_table(df).splitlines()
    assert len(shown) == 301 and all(line.endswith("y" * 60) for line in shown[1:])
    for sink in (writers.markdown_table, writers.console_table):
        with pytest.raises(ValueError, match="more than 200"):
            sink(df, 200)


def test_guards(spark, tmp_path):
    (tmp_path / "a" / "x").mkdir(parents=True)
    (tmp_path / "b").mkdir()
    (tmp_path / "a/x/f.txt").write_text("one")
    (tmp_path / "b/f.txt").write_text("two")
    had = spark.createDataFrame(integrity.hash_manifest(spark, str(tmp_path)).collect())
    assert sorted(r.file for r in had.collect()) == ["a/x/f.txt", "b/f.txt"]
    (tmp_path / "b/f.txt").write_text("new")
    assert {r.file: r.state for r in integrity.verify_manifest(integrity.hash_manifest(spark, str(tmp_path)), had).collect()} == {"a/x/f.txt": "match", "b/f.txt": "mismatch"}
    pinned = next(r.sha256 for r in had.collect() if r.file == "a/x/f.txt")
    integrity.assert_no_drift(spark, str(tmp_path / "a/x/f.txt"), pinned)
    with pytest.raises(integrity.IntegrityError):
        integrity.assert_no_drift(spark, str(tmp_path / "b/f.txt"), pinned)
    integrity.assert_none_of(spark, str(tmp_path), "*.env")
    with pytest.raises(integrity.IntegrityError):
        integrity.assert_none_of(spark, str(tmp_path), "*.txt")
    one, two = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(2,)], "k int")
    integrity.assert_not_final(one.where("k = 1"), two, "k")
    with pytest.raises(integrity.IntegrityError):
        integrity.assert_not_final(one, two, "k")
    integrity.assert_disjoint(one, "k")
    with pytest.raises(integrity.IntegrityError):
        integrity.assert_disjoint(one.union(two), "k")


def test_rules(spark):
    df = spark.createDataFrame([("2012",), ("1999",)], "y string")
    assert [r[0] for r in df.select(rules.in_period(F.col("y"), 2010, 2023)).collect()] == [True, False]
    with pytest.raises(Exception, match="not a year: n.d."):
        spark.createDataFrame([("n.d.",)], "y string").select(rules.in_period(F.col("y"), 2010, 2023)).collect()
    got = spark.range(3).select(rules.first_match_struct([(F.col("id") == 0, {"a": "x", "b": "1"}), (F.col("id") < 2, {"a": "y", "b": "2"})], {"a": "z", "b": "3"}).alias("s")).collect()
    assert [(r.s.a, r.s.b) for r in got] == [("x", "1"), ("y", "2"), ("z", "3")]
    listed = rules.allow_list(spark.range(2), "id", spark.createDataFrame([(1, "include", "seen")], "id long, decision string, reason string"))
    assert {(r.id, r.decision, r.reason) for r in listed.collect()} == {(0, "pending", ""), (1, "include", "seen")}


def test_pairs_of_token_sets_equal_brute_force(spark):
    r = random.Random(2)
    docs = [(k, r.choice("ab"), sorted({r.choice("abcdefghij") + str(r.randrange(3)) for _ in range(r.randint(1, 14))})) for k in range(70)]
    docs += [(70, "a", []), (71, "a", docs[0][2]), (72, docs[0][1], docs[0][2])]
    df = spark.createDataFrame(docs, "id long, block string, t array<string>")
    want = {(a, b) for a, x, s in docs for b, y, t in docs if a < b and x == y and s and t and len({*s} & {*t}) / len({*s} | {*t}) >= 0.5}
    assert {(x.a, x.b) for x in dedup.token_pairs(df, "id", "block", "t", 0.5).collect()} == want


def test_near_vectors_equal_brute_force(spark):
    x = np.random.default_rng(4).standard_normal((300, 6))
    df = spark.createDataFrame([(k, [float(v) for v in row]) for k, row in enumerate(x)] + [(300, None), (301, [0.0] * 6)], "id long, v array<double>")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {(a, b) for a in range(0, 300, 50) for b in range(300) if unit[a] @ unit[b] >= 0.6}
    assert {(r.a, r.b) for r in dedup.near_vectors(df, df.where("id % 50 = 0 and id < 300"), "id", "v", 0.6).collect()} == want
    assert dedup.near_vectors(df, df.limit(0), "id", "v", 0.6).count() == 0


def _labelled(spark, change=None):
    r, rows = random.Random(6), []
    for k in range(120):
        y = k % 3 == 0
        words = [r.choice(["calm", "kind", "open", "plain"]) for _ in range(12)] + [r.choice(["awful", "rotten"] if y else ["lovely", "pretty"]) for _ in range(4)]
        rows.append((k, "quite another text " * 5 if k == change else " ".join(words), int(y)))
    return spark.createDataFrame([*rows, (500, "no label here", None)], "id long, text string, y int")


def test_out_of_fold_scores_every_labelled_row_without_leaks(spark):
    first = {r.id: r for r in features.out_of_fold(_labelled(spark), "id", "text", "y").collect()}
    assert sorted(first) == list(range(120))
    assert np.mean([(r.p >= 0.5) == (r.y == 1) for r in first.values()]) > 0.95
    again = {r.id: r for r in features.out_of_fold(_labelled(spark, change=7), "id", "text", "y").collect()}
    mine = first[7].fold  # a text of this fold can't matter to the fold's own model
    assert all(math.isclose(first[k].p, again[k].p, rel_tol=1e-12) for k in first if first[k].fold == mine and k != 7)
    assert any(not math.isclose(first[k].p, again[k].p, rel_tol=1e-9) for k in first if first[k].fold != mine)
    few = features.out_of_fold(_labelled(spark), "id", "text", "y", sample=40)
    assert few.count() == 120
    leaky = {r.id: r.p for r in features.out_of_fold(_labelled(spark, change=7), "id", "text", "y", leaky=True).collect()}
    assert len(leaky) == 120


def test_folds_equal_a_window(spark):
    from pyspark.sql import Window

    df = spark.range(2000).withColumn("y", (F.col("id") % 7 == 0).cast("int"))
    w = Window.partitionBy("y").orderBy(F.sha2(F.col("id").cast("string"), 256), "id")
    want = {(r.id, r.fold) for r in df.withColumn("fold", ((F.row_number().over(w) - 1) % 5).cast("int")).collect()}
    assert {(r.id, r.fold) for r in features.folds(df, "id", "y", 5).collect()} == want
