"""The classifier of sums over tasks against one that holds all rows, and against the exact kernel."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from veldspar.functions.lexicons import STOP_WORDS
from veldspar.operators import features
from veldspar.operators.kernel import Model, calibration, kernel_out_of_fold
from veldspar.operators.vectors import analysed


def grams(text, stop=()):
    w = analysed(text or "", frozenset(stop), True)
    return w + [f"{a} {b}" for a, b in zip(w, w[1:])]


def whole(lists, y, fold, terms, c=3.0):
    """Decisions of each row's fold by plain logistic regression on all rows at once."""
    out = np.zeros(len(y))
    for f in range(5):
        train = np.flatnonzero(fold != f)
        model = features.TextModel.__new__(features.TextModel)
        seen, total = {}, {}
        for i in train:
            for t in lists[i]:
                total[t] = total.get(t, 0) + 1
            for t in set(lists[i]):
                seen[t] = seen.get(t, 0) + 1
        names = [t for t, d in seen.items() if 2 <= d <= 0.9 * len(train)]
        assert len(names) <= terms, "a choice among ties would need the hashes"
        model.place = {t: j for j, t in enumerate(names)}
        model.idf = np.log((1 + len(train)) / (1 + np.array([seen[t] for t in names], float))) + 1
        x = model.rows(lists)
        g = 1 / (x.shape[1] * x[train].var())
        z = np.c_[np.sqrt(2 * g * np.exp(-2 * g)) * x, np.ones(len(x))]
        n1 = y[train].sum()
        w = np.where(y > 0, len(train) / (2 * n1), len(train) / (2 * (len(train) - n1)))[train]
        b, ridge = np.zeros(z.shape[1]), np.append(np.full(z.shape[1] - 1, 1 / c), 1e-9)
        for _ in range(50):
            p = 1 / (1 + np.exp(-(z[train] @ b)))
            b = b + 0.5 * np.linalg.solve(z[train].T @ (z[train] * (w * p * (1 - p))[:, None]) + np.diag(ridge), z[train].T @ (w * (y[train] - p)) - ridge * b)
        out[fold == f] = z[fold == f] @ b
    return out


def test_equals_a_fit_on_all_rows(spark):
    rng = random.Random(4)
    words = ["red", "blue", "green", "oak", "elm", "ash", "stone", "sand"]
    rows = [(i, " ".join(rng.choice(words[: 5 if i % 3 else 8]) for _ in range(12)) + (" ash" if i % 3 == 0 and rng.random() < 0.5 else ""), int(i % 3 == 0)) for i in range(160)]
    df = spark.createDataFrame(rows, "id long, text string, y int").repartition(5)
    got = {r.id: r for r in kernel_out_of_fold(df, "id", "text", "y").collect()}
    assert set(got) == {r[0] for r in rows} and all(0 < r.p < 1 for r in got.values())
    fold = np.array([got[i].fold for i, _, _ in rows])
    want = whole([grams(t) for _, t, _ in rows], np.array([r[2] for r in rows], float), fold, 500)
    for f in range(5):  # the sigmoid is one of the fold: log odds are linear in decisions
        own = np.flatnonzero(fold == f)
        odds = np.array([np.log(got[i].p / (1 - got[i].p)) for i in own])
        slope, offset = np.polyfit(want[own], odds, 1)
        assert slope > 0 and np.abs(slope * want[own] + offset - odds).max() < 0.02 * np.abs(odds).max()


def test_near_the_exact_kernel_and_calibrated(spark):
    folder = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{folder}/labels.parquet").join(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text"), "doc_id")
    some = spark.createDataFrame(labels.orderBy(F.sha2(F.col("doc_id").cast("string"), 256)).limit(1000).toPandas())
    got = kernel_out_of_fold(some, "doc_id", "text", "toxic", stop=STOP_WORDS).toPandas()
    exact = features.out_of_fold(some, "doc_id", "text", "toxic", stop=STOP_WORDS).toPandas()
    share = lambda d: ((d.p >= 0.5) == d.toxic).mean()
    assert len(got) == len(exact) == 1000 and share(got) >= share(exact) - 0.01
    report = {r.bin: r for r in calibration(spark.createDataFrame(got), "toxic", "p").collect()}
    assert report[None].n == 1000 and report[None].error < 0.05
    assert report[None].error == pytest.approx(sum(r.n * r.error for b, r in report.items() if b is not None) / 1000)


def test_random_features_learn_too(spark):
    rows = [(i, "one two three " * 3 if i % 2 else "four five six " * 3, i % 2) for i in range(60)]
    got = kernel_out_of_fold(spark.createDataFrame(rows, "id long, text string, y int"), "id", "text", "y", width=64, c=10.0).collect()
    assert all((r.p >= 0.5) == bool(r.y) for r in got)


def test_a_step_that_overshoots_is_halved():
    m = Model(0, [1], (1, 1), np.zeros(2), np.zeros(2))
    m.move(np.eye(2), np.array([8.0, 0.0]), 10.0, np.zeros(2))
    assert m.beta.tolist() == [8.0, 0.0] and not m.done
    m.move(np.eye(2), np.array([1.0, 0.0]), 11.0, np.zeros(2))
    assert m.beta.tolist() == [4.0, 0.0] and m.best.tolist() == [0.0, 0.0]


def test_awkward_rows(spark):
    rows = [("a", None, 1), ("b", "", 0), ("c", "x", None), ("d", "word word", 1), ("e", "word", 0), ("f", "word other", 1)]
    got = kernel_out_of_fold(spark.createDataFrame(rows, "id string, text string, y int"), "id", "text", "y").collect()
    assert {r.id for r in got} == {"a", "b", "d", "e", "f"} and all(0 <= r.p <= 1 for r in got)
    same = kernel_out_of_fold(spark.createDataFrame([(i, "t", 1) for i in range(7)], "id long, text string, y int"), "id", "text", "y").collect()
    assert {r.p for r in same} == {1.0}
    assert kernel_out_of_fold(spark.createDataFrame([], "id long, text string, y int"), "id", "text", "y").count() == 0
