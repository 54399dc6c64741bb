"""TF-IDF in tables, folds, and out-of-fold models."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import alnum_tokens
from ..tables import shared_dir, written


def grams(df: DataFrame, text_col: str, stop: list[str] | None = None, bigrams: bool = False) -> DataFrame:
    """``df`` with the array ``t`` of its words, and pairs of neighbours, without stop words."""
    tokens = alnum_tokens(F.col(text_col))
    if stop:
        tokens = F.filter(tokens, lambda t: ~t.isin(stop))
    df = df.withColumn("t", tokens)
    rest = F.greatest(F.size("t") - 1, F.lit(0))
    return df.withColumn("t", F.concat("t", F.zip_with(F.slice("t", 1, rest), F.slice("t", 2, rest), lambda a, b: F.concat_ws(" ", a, b)))) if bigrams else df


#: Buckets of terms by hash, by whose totals rare terms are left out.
BUCKETS = 1 << 18


def terms(df: DataFrame, id_col: str, text_col: str, stop: list[str] | None = None, bigrams: bool = False, top: int | None = None, max_df: float = 0.9) -> DataFrame:
    """(id, term, tf).  Exploded terms are counted before the shuffle.

    With ``top``, terms that can't be among so many of the greatest totals (``tfidf``) are left out: the words alone give a total that the last of them has at least,
    and a bucket of hashes whose terms have less in all holds none.  All texts are counted; each count that is given is whole.
    """
    rows = grams(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "text", stop, bigrams)
    each = rows.select("id", F.explode("t").alias("term"))
    if top:
        folder = shared_dir(df.sparkSession)
        words = grams(df.select(F.col(text_col).alias("text")), "text", stop).select("t")
        totals = words.select(F.explode("t").alias("term")).groupBy("term").agg(F.count("*").alias("total"))
        seen = words.select(F.explode(F.array_distinct("t")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
        own = totals.join(seen, "term").where((F.col("df") >= 2) & (F.col("df") <= max_df * df.count()))
        last = own.orderBy(F.desc("total")).select("total").limit(top).agg(F.min("total").alias("total"), F.count("*").alias("n")).first()
        if last.n == top:
            bucket = F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).alias("bucket")
            full = written(each.groupBy(bucket).agg(F.count("*").alias("total")).where(F.col("total") >= last.total).select("bucket"), folder, "buckets")
            each = each.withColumn("bucket", bucket).join(F.broadcast(full), "bucket", "left_semi").select("id", "term")
    return each.groupBy("id", "term").agg(F.count("*").alias("tf"))


def tfidf(tf: DataFrame, n_docs: int, min_df: int = 2, max_df: float = 0.9, features: int | None = 500) -> DataFrame:
    """(id, term, w): (1 + ln tf)(ln((1 + n)/(1 + df)) + 1), rows of unit length, for the most used terms (ties by name).  Counts are written once, as they are read for statistics and for weights."""
    tf = written(tf, shared_dir(tf.sparkSession), "tf")
    df_ = tf.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total")).where((F.col("df") >= min_df) & (F.col("df") <= max_df * n_docs))
    if features:
        df_ = df_.orderBy(F.desc("total"), "term").limit(features)
    raw = tf.join(F.broadcast(df_) if features and features <= 100_000 else df_, "term")
    raw = raw.select("id", "term", ((1 + F.ln("tf")) * (F.ln(F.lit(1.0 + n_docs) / (1 + F.col("df"))) + 1)).alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("id")))
    return raw.select("id", "term", (F.col("w") / norm).alias("w"))


def folds(df: DataFrame, id_col: str, label: str, k: int) -> DataFrame:
    """Stratified folds: rows of a label are numbered in the order of the id's hash, and dealt in turn.

    Rows are numbered within 4,096 ranges of hashes, to which the numbers of rows in the ranges before are added, so no task has a label's rows.
    """
    df = df.withColumn("_h", F.sha2(F.col(id_col).cast("string"), 256)).withColumn("_r", F.substring("_h", 1, 3))
    sizes = df.groupBy(F.col(label).alias("_l"), F.col("_r").alias("_q")).agg(F.count("*").alias("_n"))
    before = Window.partitionBy("_l").orderBy("_q").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inner = Window.partitionBy(label, "_r").orderBy("_h", id_col)
    own = df.withColumn("_k", F.row_number().over(inner)).join(F.broadcast(sizes), F.col(label).eqNullSafe(F.col("_l")) & (F.col("_r") == F.col("_q")))
    return own.withColumn("fold", ((F.col("_base") + F.col("_k") - 1) % k).cast("int")).drop("_h", "_r", "_l", "_q", "_k", "_base")


def fit_rbf_svc(x: np.ndarray, y: np.ndarray, c: float = 1.0, steps: int = 300) -> tuple[np.ndarray, float, float]:
    """A support vector classifier with an RBF kernel (gamma: scale) and balanced classes: (dual weights, constant, gamma), by projected gradient."""
    gamma = 1.0 / max(1e-12, x.shape[1] * x.var())
    sq = (x * x).sum(1)
    kernel = np.exp(-gamma * np.maximum(0, sq[:, None] + sq[None] - 2 * x @ x.T))
    s = np.where(y > 0, 1.0, -1.0)
    bound = c * len(y) / (2 * np.where(y > 0, max(1, (y > 0).sum()), max(1, (y <= 0).sum())))
    q = kernel * s[:, None] * s[None]
    a = np.zeros(len(y))
    rate = 1.0 / max(1e-9, np.linalg.norm(q, 1))
    for _ in range(steps):
        a = a - rate * (q @ a - 1)
        for _ in range(8):  # onto the box and the plane s'a = 0 in turn
            a = np.clip(a - s * (s @ a) / len(s), 0, bound)
    free = (a > 1e-6) & (a < bound - 1e-6)
    f = kernel @ (a * s)
    return a * s, float(np.mean((s - f)[free])) if free.any() else float(-np.median(f)), gamma


def decide_rbf(model, train: np.ndarray, x: np.ndarray) -> np.ndarray:
    w, b, gamma = model
    d = (x * x).sum(1)[:, None] + (train * train).sum(1)[None] - 2 * x @ train.T
    return np.exp(-gamma * np.maximum(0, d)) @ w + b


def platt(f: np.ndarray, y: np.ndarray, n: np.ndarray | float = 1.0) -> tuple[float, float]:
    """Slope and offset of the sigmoid that turns decisions into probabilities, with smoothed targets; ``n``: rows that each decision stands for."""
    n = np.broadcast_to(np.asarray(n, float), f.shape)
    hi, lo = (n[y > 0].sum() + 1) / (n[y > 0].sum() + 2), 1 / (n[y <= 0].sum() + 2)
    t, a, b = np.where(y > 0, hi, lo), 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * f + b, -30, 30)))
        g, w = n * (t - p), n * p * (1 - p) + 1e-9
        h = np.array([[(w * f * f).sum() + 1e-6, (w * f).sum()], [(w * f).sum(), w.sum() + 1e-6]])
        step = np.linalg.solve(h, [(g * f).sum(), g.sum()])
        a, b = a + step[0], b + step[1]
    return float(a), float(b)


class TextModel:
    """Weighted terms, a kernel classifier on them, and the sigmoid of its decisions, fitted on lists of terms and labels; ``every`` names the terms and weights."""

    def __init__(self, lists: list[list[str]], y: np.ndarray, every: list[list[str]], features: int):
        total, seen = Counter(t for x in every for t in x), Counter(t for x in every for t in set(x))
        n = len(every)
        names = sorted((t for t, d in seen.items() if 2 <= d <= 0.9 * n), key=lambda t: (-total[t], t))[:features]
        self.place = {t: j for j, t in enumerate(names)}
        self.idf = np.log((1 + n) / (1 + np.array([seen[t] for t in names], float))) + 1
        self.train = self.rows(lists)
        self.model = fit_rbf_svc(self.train, y)
        self.slope, self.offset = platt(decide_rbf(self.model, self.train, self.train), y)

    def rows(self, lists: list[list[str]]) -> np.ndarray:
        m = np.zeros((len(lists), len(self.place)))
        for i, x in enumerate(lists):
            for t in x:
                if (j := self.place.get(t)) is not None:
                    m[i, j] += 1
        m = np.where(m > 0, 1 + np.log(np.maximum(m, 1)), 0) * self.idf
        return m / np.maximum(1e-12, np.sqrt((m * m).sum(1, keepdims=True)))

    def probability(self, lists: list[list[str]]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * decide_rbf(self.model, self.train, self.rows(lists)) + self.offset, -30, 30)))


def out_of_fold(df: DataFrame, id_col: str, text_col: str, label: str, k: int = 5, features: int = 500, leaky: bool = False, stop: list[str] | None = None, bigrams: bool = True, sample: int = 1_000) -> DataFrame:
    """(id, fold, label, p): every labelled row's probability, from a model of the other folds.

    Each model is fitted on the other folds' part of the first ``sample`` labelled rows in the order of the id's hash, as a kernel model needs its
    rows together; vocabulary and weights are taken from these rows too, or from those of all folds where ``leaky``.  All labelled rows are scored.
    """
    rows = folds(df.where(F.col(label).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(label).cast("int").alias("y")), "id", "y", k)
    tokens = grams(rows, "text", stop, bigrams).select("id", "y", "fold", F.coalesce("t", F.array().cast("array<string>")).alias("t"))
    held = tokens.orderBy(F.sha2(F.col("id").cast("string"), 256), "id").limit(sample).toPandas()
    lists, y, fold = [list(x) for x in held["t"]], held["y"].to_numpy(float), held["fold"].to_numpy()
    models: dict[int, TextModel | float] = {}
    for f in range(k):
        at = np.flatnonzero(fold != f)
        own = [lists[i] for i in at]
        if len(set(y[at].tolist())) == 2:
            models[f] = TextModel(own, y[at], lists if leaky else own, features)
        else:  # one label only: its share
            models[f] = float(y[at].mean()) if len(at) else 0.5

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            p = np.zeros(len(pdf))
            for f, model in models.items():
                at = np.flatnonzero(pdf["fold"].to_numpy() == f)
                if len(at):
                    p[at] = model if isinstance(model, float) else model.probability([list(x) for x in pdf["t"].iloc[at]])
            yield pd.DataFrame({"id": pdf["id"], "fold": pdf["fold"], "y": pdf["y"], "p": p})

    kind = df.schema[id_col].dataType.simpleString()
    return tokens.mapInPandas(score, f"id {kind}, fold int, y int, p double").select(F.col("id").alias(id_col), "fold", F.col("y").alias(label), "p")
