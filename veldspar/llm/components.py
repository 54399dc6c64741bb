"""Connected components of a link table: union-find inside partitions, then star contraction by joins."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import written


#: Up to so many edges, 16 MB, one task finishes the job.
ONE_TASK = 1_000_000


def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over up to ONE_TASK edges at a time; emits one (node, smaller root) edge per node that isn't a root."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent.setdefault(p, p)
        return x

    def stars() -> pa.RecordBatch:
        out = [(x, r) for x in list(parent) if (r := root(x)) != x]
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

    n = 0
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        n += batch.num_rows
        if n >= ONE_TASK:
            yield stars()
            parent, n = {}, 0
    yield stars()


def connected(edges: DataFrame, folder: str, one_task: int = ONE_TASK, contracted: bool = False) -> DataFrame:
    """(node, comp): the smallest node reachable, for every node of ``edges`` (a long, b long).

    Edges are first contracted by union-find inside each task, unless the tasks that made them did it (``contracted``).  If ``one_task`` edges or fewer are left, one more task joins them;
    else large-star and small-star steps alternate until nothing changes, each a grouped minimum and a join, written to ``folder``.
    Self-loops and repeated edges are harmless; an empty table gives an empty result.
    """
    cur = written(edges if contracted else edges.where("a <> b").select("a", "b").mapInArrow(forest, "a long, b long"), folder, "edges0")
    if cur.count() <= one_task:
        cur = written(cur.coalesce(1).mapInArrow(forest, "a long, b long"), folder, "stars")
        return cur.select(F.col("a").alias("node"), F.col("b").alias("comp")).union(cur.select(F.col("b"), F.col("b")).distinct())
    cur = cur.distinct()
    k, before = 0, None
    while True:
        k += 1
        both = cur.union(cur.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        big = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        small_least = big.groupBy("a").agg(F.min("b").alias("m"))
        small = big.join(small_least, "a")
        small = small.select(F.col("a"), F.col("m").alias("b")).union(small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct()
        cur = written(small, folder, f"edges{k}")
        now = cur.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return cur.select(F.col("a").alias("node"), F.col("b").alias("comp")).union(cur.select(F.col("b"), F.col("b")).distinct())
