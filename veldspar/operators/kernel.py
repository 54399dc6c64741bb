"""A kernel classifier over any number of rows: explicit features of the RBF kernel, and weighted least squares whose sums come from tasks.

For rows of unit length the kernel is ``exp(-2 g) exp(2 g x.y)``, a series whose first term that tells rows apart is ``2 g exp(-2 g) x.y``.  A linear model on the scaled terms takes that term exactly; with ``width`` it is fitted
on so many random Fourier features of the whole kernel instead, ``sqrt(2 / width) cos(w x + b)`` for normal w, whose products equal it on average.  Neither needs the rows together in one place.
A round reweights the rows by the present model; every task adds up its weighted squares, a matrix of as many rows as features a model,
these rows are added over tasks where Spark deals them, and the driver solves one small system a model.  Probabilities are calibrated on rows that the calibrating models haven't seen:
each outer fold has two inner models, each of one half of the other folds, whose decisions on the other half give the sigmoid.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import shared_dir, written
from . import vectors
from .features import folds, platt

#: Rounds of least squares at most; steps of a decision's histogram to either side.
ROUNDS, STEPS = 15, 500


@dataclass
class Space:
    """Terms and weights of one outer fold, and its features."""

    terms: np.ndarray  # sorted
    idf: np.ndarray
    scale: float = 1.0
    turn: np.ndarray | None = None
    shift: np.ndarray | None = None

    def rows(self, n: int, row: np.ndarray, t: np.ndarray, tf: np.ndarray) -> np.ndarray:
        """Unit TF-IDF rows."""
        m = np.zeros((n, len(self.terms)))
        if len(self.terms):
            at = np.minimum(np.searchsorted(self.terms, t), len(self.terms) - 1)
            own = self.terms[at] == t
            m[row[own], at[own]] = (1 + np.log(tf[own])) * self.idf[at[own]]
        return m / np.maximum(1e-12, np.sqrt((m * m).sum(1, keepdims=True)))

    def features(self, x: np.ndarray) -> np.ndarray:
        z = self.scale * x if self.shift is None else np.sqrt(2 / len(self.shift)) * np.cos(x @ self.turn + self.shift)
        return np.concatenate([z, np.ones((len(z), 1))], 1)


@dataclass
class Model:
    """A model of an outer fold's space, fitted on some folds.  A step that makes the loss greater is halved until it doesn't."""

    fold: int
    train: list[int]
    weights: tuple[float, float]  # of the labels 0 and 1
    beta: np.ndarray
    best: np.ndarray
    loss: float = np.inf
    done: bool = False

    def move(self, squares: np.ndarray, slope: np.ndarray, loss: float, ridge: np.ndarray) -> None:
        loss += 0.5 * float((ridge * self.beta * self.beta).sum())
        if loss > self.loss + 1e-9:
            self.beta = (self.beta + self.best) / 2
            self.done = bool(np.abs(self.beta - self.best).max() < 1e-6)
            return
        self.done = self.loss - loss < 1e-4 * max(1.0, loss)
        self.best, self.loss = self.beta, loss
        if not self.done:
            self.beta = self.beta + np.linalg.solve(squares + np.diag(ridge), slope - ridge * self.beta)


def _batch(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """(label, fold, row of each term, term, count)."""
    y, fold = (batch.column(k).to_numpy(zero_copy_only=False) for k in (1, 2))
    n = batch.column(3).value_lengths().to_numpy()
    return y.astype(np.float64), fold, np.repeat(np.arange(len(batch)), n), batch.column(3).flatten().to_numpy(), batch.column(4).flatten().to_numpy().astype(np.float64)


def _moments(spaces: list[Space]):
    """(fold of the space, fold of the rows, sum of all entries, of their squares)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(spaces), len(spaces), 2))
        for batch in batches:
            _, fold, row, t, tf = _batch(batch)
            for f, space in enumerate(spaces):
                x = space.rows(len(fold), row, t, tf)
                for j, values in enumerate((x.sum(1), (x * x).sum(1))):
                    sums[f, :, j] += np.bincount(fold, values, len(spaces))
        f, g = np.indices(sums.shape[:2])
        yield pa.RecordBatch.from_arrays([pa.array(f.ravel()), pa.array(g.ravel()), *(pa.array(sums[:, :, j].ravel()) for j in range(2))], names=["f", "g", "s", "q"])

    return run


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _squares(shared):
    """Rows (model, part, x) of each model's weighted squares, beside their products with the residuals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spaces, models = shared.value
        sums = [np.zeros((len(m.beta) + 1, len(m.beta) + 1)) for m in models]  # the last row begins with the loss
        for batch in batches:
            y, fold, row, t, tf = _batch(batch)
            for f, space in enumerate(spaces):
                z = space.features(space.rows(len(y), row, t, tf))
                for m, out in zip(models, sums):
                    if m.fold == f and not m.done:
                        own = np.isin(fold, m.train)
                        zm, ym = z[own], y[own]
                        p, c = _sigmoid(zm @ m.beta), np.where(ym > 0, m.weights[1], m.weights[0])
                        out[:-1, :-1] += zm.T @ (zm * (c * p * (1 - p))[:, None])
                        out[:-1, -1] += zm.T @ (c * (ym - p))
                        out[-1, 0] += (c * np.logaddexp(0, np.where(ym > 0, -1, 1) * (zm @ m.beta))).sum()
        for k, out in enumerate(sums):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(out), k, np.int32)), pa.array(np.arange(len(out), dtype=np.int32)), pa.array(list(out))], names=["model", "part", "x"])

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        for model, part, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            x = x.values.to_numpy()
            sums[model, part] = sums[model, part] + x if (model, part) in sums else x
    keys = list(sums)
    yield pa.RecordBatch.from_arrays([*(pa.array([k[j] for k in keys], pa.int32()) for j in range(2)), pa.array([sums[k] for k in keys], pa.list_(pa.float64()))], names=["model", "part", "x"])


def _decisions(shared):
    """Each row's decision by its own fold's model, and by the inner models that haven't seen it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spaces, models = shared.value
        for batch in batches:
            y, fold, row, t, tf = _batch(batch)
            own, inner = np.zeros(len(y)), np.full((len(y), len(spaces)), np.nan)
            for f, space in enumerate(spaces):
                z = space.features(space.rows(len(y), row, t, tf))
                for m in models:
                    if m.fold == f:
                        d = z @ m.beta
                        if len(m.train) == len(spaces) - 1:
                            own = np.where(fold == f, d, own)
                        else:
                            held = (fold != f) & ~np.isin(fold, m.train)
                            inner[held, f] = d[held]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), pa.array(own), pa.array(list(inner))], names=["id", "y", "fold", "d", "inner"])

    return run


def _spaces(rows: DataFrame, folder: str, k: int, features: int) -> list[Space]:
    """The terms of each outer fold: the most used of the other folds' that two rows have and nine tenths don't."""
    x = rows.select("fold", F.explode(F.arrays_zip("t", "tf")).alias("x"))
    per = [a for f in range(k) for a in (F.count_if(F.col("fold") == f).alias(f"df{f}"), F.sum(F.when(F.col("fold") == f, F.col("x.tf")).otherwise(0)).alias(f"total{f}"))]
    terms = written(x.groupBy(F.col("x.t").alias("t")).agg(*per), folder, "terms")
    n = {r.fold: r["count"] for r in rows.groupBy("fold").count().collect()}
    out = []
    for f in range(k):
        others = [g for g in range(k) if g != f]
        size = sum(n.get(g, 0) for g in others)
        own = terms.select("t", sum(F.col(f"df{g}") for g in others).alias("df"), sum(F.col(f"total{g}") for g in others).alias("total"))
        got = sorted((r.t, r.df) for r in own.where((F.col("df") >= 2) & (F.col("df") <= 0.9 * size)).orderBy(F.desc("total"), "t").limit(features).collect())
        out.append(Space(np.array([t for t, _ in got], np.int64), np.log((1 + size) / (1 + np.array([d for _, d in got], np.float64))) + 1))
    return out


def kernel_out_of_fold(df: DataFrame, id_col: str, text_col: str, label: str, k: int = 5, features: int = 500, width: int = 0, stop: list[str] | None = None, c: float = 3.0, seed: int = 42) -> DataFrame:
    """(id_col, fold, label, p): the calibrated probability of label 1 of every labelled row, from models of the other folds' rows, all of them.

    Terms are words and neighbouring pairs (``vectors.analysed``, accents folded); labels have balanced weights; ``c`` weighs errors against size; ``width`` random features of a fixed ``seed``, or the
    series for 0.  Ids are distinct.  Null labels take no part; null texts are rows without terms.  Where the other folds have one label only, its share is the probability.  The driver holds ``features`` terms and the square of their number
    (or of ``width``) of sums a model, whatever the number of rows.
    """
    folder, spark = shared_dir(df.sparkSession), df.sparkSession
    own = df.where(F.col(label).isNotNull())
    counts = vectors.term_counts(own, id_col, text_col, None, stop, True, True).select("id", "t", "tf")
    dealt = folds(own.select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("y")), "id", "y", k)
    rows = written(dealt.join(counts, "id").select("id", "y", "fold", "t", "tf"), folder, "rows")
    kind = dict(rows.dtypes)["id"]
    labels = {(r.fold, r.y): r["count"] for r in rows.groupBy("fold", "y").count().collect()}
    size = lambda of, y: sum(labels.get((g, y), 0) for g in of)
    spaces = _spaces(rows, folder, k, features)

    moments: dict[int, np.ndarray] = {f: np.zeros(3) for f in range(k)}
    for r in rows.mapInArrow(_moments(spaces), "f long, g long, s double, q double").groupBy("f", "g").agg(F.sum("s").alias("s"), F.sum("q").alias("q")).collect():
        if r.f != r.g:
            moments[r.f] += (size([r.g], 0) + size([r.g], 1), r.s, r.q)
    rng = np.random.default_rng(seed)
    normal, shift = rng.standard_normal((features, width)), rng.uniform(0, 2 * np.pi, width)
    models = []
    for f, space in enumerate(spaces):
        cells = max(1.0, moments[f][0] * len(space.terms))
        variance = moments[f][2] / cells - (moments[f][1] / cells) ** 2
        g = 1 / max(1e-12, len(space.terms) * variance)
        space.scale = float(np.sqrt(2 * g * np.exp(-2 * g)))
        if width:
            space.turn, space.shift = np.sqrt(2 * g) * normal[: len(space.terms)], shift
        size_ = (width or len(space.terms)) + 1
        others = [g for g in range(k) if g != f]
        for train in (others, others[: len(others) // 2], others[len(others) // 2 :]):
            n0, n1 = size(train, 0), size(train, 1)
            if n0 and n1:
                models.append(Model(f, train, ((n0 + n1) / (2 * n0), (n0 + n1) / (2 * n1)), np.zeros(size_), np.zeros(size_)))

    for _ in range(ROUNDS if models else 0):
        shared = spark.sparkContext.broadcast((spaces, models))
        sums = rows.mapInArrow(_squares(shared), "model int, part int, x array<double>").repartition("model", "part").mapInArrow(_added, "model int, part int, x array<double>")
        got = [np.zeros((len(m.beta) + 1, len(m.beta) + 1)) for m in models]
        for r in sums.collect():
            got[r.model][r.part] = r.x
        shared.destroy()
        for m, x in zip(models, got):
            if not m.done:
                m.move(x[:-1, :-1], x[:-1, -1], float(x[-1, 0]), np.append(np.full(len(m.beta) - 1, 1 / c), 1e-9))
        if all(m.done for m in models):
            break
    for m in models:
        m.beta = m.best

    shared = spark.sparkContext.broadcast((spaces, models))
    scored = written(rows.mapInArrow(_decisions(shared), f"id {kind}, y int, fold int, d double, inner array<double>"), folder, "decisions")
    # the sigmoids from counts of decisions in steps: their number is bounded, and each stands for its mean
    held = scored.select("y", F.posexplode("inner").alias("f", "d")).where("not isnan(d)")
    spread = {r.f: r.s or 1.0 for r in held.groupBy("f").agg(F.avg(F.abs("d")).alias("s")).collect()}
    own = F.col("d") / F.element_at(F.lit([spread.get(f, 1.0) for f in range(k)]), F.col("f") + 1)
    held = held.groupBy("f", "y", F.round(F.greatest(F.least(own, F.lit(10.0)), F.lit(-10.0)) * (STEPS / 10)).alias("step")).agg(F.count("*").alias("n"), F.avg("d").alias("d")).collect() if models else []
    step = {f: [r for r in held if r.f == f] for f in range(k)}
    p = F.lit(None).cast("double")
    fitted = {m.fold for m in models if len(m.train) == k - 1}
    for f in range(k):
        train = [g for g in range(k) if g != f]
        if f in fitted:
            seen = step[f] if len({r.y for r in step[f]}) == 2 else []
            a, b = platt(*(np.array([r[c] for r in seen], float) for c in ("d", "y", "n"))) if seen else (1.0, 0.0)
            value = 1 / (1 + F.exp(-F.greatest(F.least(F.col("d") * a + b, F.lit(30.0)), F.lit(-30.0))))
        else:
            n0, n1 = size(train, 0), size(train, 1)
            value = F.lit(n1 / (n0 + n1) if n0 + n1 else 0.5)
        p = F.when(F.col("fold") == f, value).otherwise(p)
    return scored.select(F.col("id").alias(id_col), "fold", F.col("y").alias(label), p.alias("p"))


def calibration(df: DataFrame, label: str, p: str, bins: int = 10) -> DataFrame:
    """(bin, n, mean_p, share, error): how far probabilities lie from shares, and the weighted mean of it over all in the row of the null bin."""
    each = df.groupBy(F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("mean_p"), F.avg(F.col(label).cast("double")).alias("share"))
    each = each.withColumn("error", F.abs(F.col("mean_p") - F.col("share")))
    total = each.agg(F.sum("n").alias("n"), *((F.sum(F.col(c) * F.col("n")) / F.sum("n")).alias(c) for c in ("mean_p", "share", "error")))
    return each.unionByName(total.select(F.lit(None).cast("int").alias("bin"), "n", "mean_p", "share", "error"))
