"""Document fingerprints by locally consistent parsing.

A text is parsed in rounds.  In each round runs of one symbol become one; deterministic coin tossing compares each symbol with the one before
it and keeps the place and value of the lowest bit in which they differ, which after four steps leaves labels under six with no two neighbours
equal; a phrase starts at each local maximum of the labels, and its name, a hash of its symbols, is a symbol of the next round.  A label depends
on a few neighbours only, so equal substrings get equal names inside, whatever stands before them.

The fingerprint is a sketch of the set of names of the rounds from ``FIRST`` on (and of the last name of shorter texts): the least
hash in each of ``BINS`` bins, cut to 16 bits.  The likeness of two fingerprints estimates the Jaccard similarity of the name sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._words import mix, powers

BINS = 64
#: Names of earlier rounds, of a few characters, occur in any text of a language.
FIRST = 2
_CHARS = 1 << 20


def _toss(x: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Twice the lowest bit in which an element differs from the one before it, plus that bit; a document's first counts bit 0."""
    diff = np.empty_like(x)
    diff[0] = 1
    np.bitwise_xor(x[1:], x[:-1], out=diff[1:])
    diff[new] = 1
    low = np.bitwise_count((diff & (~diff + x.dtype.type(1))) - x.dtype.type(1))
    return (low << 1 | (x >> low.astype(x.dtype) & x.dtype.type(1)).astype(np.uint8)).astype(np.uint8)


def parse_round(s: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all documents (64-bit, one after the other) and each one's document: the same for the next round."""
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    run = np.diff(np.append(at, len(s))).astype(np.uint64)
    s, doc = mix(s[at] + run * np.uint64(0xA0761D6478BD642F)), doc[at]
    first = np.ones(len(s), bool)
    first[1:] = doc[1:] != doc[:-1]
    label = _toss(s, first)
    for _ in range(3):
        label = _toss(label, first)
    # a landmark is larger than both neighbours; documents' ends have none
    mark = first.copy()
    if len(s) > 2:
        up, down = label[1:-1] > label[:-2], label[1:-1] > label[2:]
        mark[1:-1] |= up & down & ~first[1:-1] & ~first[2:]
    at = np.flatnonzero(mark)
    end = np.append(at[1:], len(s))
    pw, inv = powers(len(s) + 1)
    sums = np.zeros(len(s) + 1, np.uint64)
    np.cumsum(s * pw[: len(s)], out=sums[1:])
    return mix((sums[end] - sums[at]) * inv[at] + (end - at).astype(np.uint64)), doc[at]


def sketch(texts: list[str]) -> np.ndarray:
    """Fingerprints, texts x BINS of uint16; 0 marks an empty bin."""
    least = np.full(len(texts) * BINS, np.uint64(0xFFFFFFFFFFFFFFFF))
    if any(texts):
        s = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.uint64)
        doc = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        k = 0
        while len(s):
            k += 1
            s, doc = parse_round(s, doc)
            alone = np.ones(len(s), bool)
            alone[1:] = doc[1:] != doc[:-1]
            alone[:-1] &= doc[1:] != doc[:-1]
            if k >= FIRST:
                name, of = s, doc
            else:
                name, of = s[alone], doc[alone]
            h = mix(name ^ np.uint64(0x2545F4914F6CDD1D))
            np.minimum.at(least, of * BINS + (h & np.uint64(BINS - 1)).astype(np.int64), h)
            s, doc = s[~alone], doc[~alone]
    empty = least == np.uint64(0xFFFFFFFFFFFFFFFF)
    out = ((mix(least) >> np.uint64(48)).astype(np.uint16) | np.uint16(1))
    out[empty] = 0
    return out.reshape(-1, BINS)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, the share of bins that are equal among those that either has; 1 for two empty texts."""
    used = ((a != 0) | (b != 0)).sum(1)
    same = ((a == b) & (a != 0)).sum(1)
    return np.where(used == 0, 1.0, same / np.maximum(used, 1))


def _strings(x: np.ndarray) -> list[str]:
    return [row.astype(">u2").tobytes().hex() for row in x]


def _groups(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about _CHARS characters."""
    at = n = 0
    for k, t in enumerate(texts):
        n += len(t)
        if n >= _CHARS:
            yield at, k + 1
            at, n = k + 1, 0
    if at < len(texts):
        yield at, len(texts)


def _alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1).fill_null("").to_pylist()
        for a, b in _groups(texts):
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([len(t) for t in texts[a:b]], pa.int64()), pa.array(_strings(sketch(texts[a:b])))], names=["_own", "n_chars", "fingerprint"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_chars long, fingerprint string of hex digits), one row per row of ``docs``; no shuffle.

    Null text counts as empty; the empty text's fingerprint is all zeros.  Equal texts have equal fingerprints.  Other columns are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("_own"), text_col).mapInArrow(_alone, f"_own {kind}, n_chars long, fingerprint string").withColumnRenamed("_own", id_col)


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, tail, id, text) in order.  Each row is paired with the row after it in its bucket."""
    held: tuple | None = None  # bucket, tail, id, text, sketch of the last row
    for batch in batches:
        buckets, tails, ids = (batch.column(k).to_pylist() for k in range(3))
        texts = batch.column(3).to_pylist()
        for a, b in _groups(texts):
            now = sketch(texts[a:b])
            rows = [(x, y, z, t) for x, y, z, t in zip(buckets[a:b], tails[a:b], ids[a:b], texts[a:b])]
            if held is not None:
                rows, now = [held[:4], *rows], np.concatenate([held[4][None], now])
            held = (*rows[-1], now[-1])
            use = [k for k in range(len(rows) - 1) if rows[k][0] == rows[k + 1][0] and not rows[k][1]]
            if not use:
                continue
            edited = []
            for k in use:
                text, half = rows[k][3], len(rows[k][3]) // 2
                edited.append(text[: len(text) - half] + rows[k + 1][3][:half])
            other = sketch(edited)
            own, nxt = now[use], now[[k + 1 for k in use]]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([rows[k][2] for k in use], pa.int64()), pa.array([len(rows[k][3]) for k in use], pa.int64()),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]), pa.array(_strings(own)), pa.array(_strings(other)),
                    pa.array(likeness(own, other)), pa.array(likeness(own, nxt)),
                ],
                names=["_own", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )


def compare_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """(id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next), one row per row of ``docs``.

    The edited text has the last half (rounded down) replaced by as many characters of the next document, or all it has, in descending
    order of id; the first follows the last.  Rows that share an id follow in the order of their text; null ids come last; null text counts as empty.
    A table of one row has itself next.  Documents are dealt by ranges of id, and each range also gets the first document of the next one.
    """
    spark = docs.sparkSession
    parts = parts or max(1, docs.rdd.getNumPartitions())
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)))
    src = docs.select(key.alias("_id"), F.col(id_col).cast("long").alias("_own"), F.coalesce(text_col, F.lit("")).alias("_text"))
    got = src.select(F.col("_id").cast("double").alias("x")).approxQuantile("x", [k / parts for k in range(1, parts)], 0.1 / parts) if parts > 1 else []
    bounds = np.unique(np.array(got, np.float64))

    @F.pandas_udf("int")
    def bucket_of(x: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, x.to_numpy().astype(np.float64), "right").astype(np.int32))

    src = src.withColumn("bucket", bucket_of("_id"))
    # one row for each range of ids
    tops = [(r.bucket, r.top) for r in src.groupBy("bucket").agg(F.max("_id").alias("top")).orderBy("bucket").collect()]
    if not tops:
        tops = [(0, 0)]
    follow = spark.createDataFrame([(tops[k][0], tops[k - 1][1]) for k in range(len(tops))], "bucket int, _id long")
    heads = src.drop("bucket").join(F.broadcast(follow), "_id").groupBy("bucket", "_id").agg(F.min("_text").alias("_text"))
    rows = src.select("bucket", F.lit(False).alias("tail"), "_own", "_text", "_id").union(heads.select("bucket", F.lit(True), F.lit(None).cast("long"), "_text", "_id"))
    dealt = rows.repartitionByRange(parts, "bucket").sortWithinPartitions("bucket", "tail", F.desc("_id"), "_text").select("bucket", "tail", "_own", "_text")
    out = dealt.mapInArrow(_pairs, "_own long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    return out.withColumnRenamed("_own", id_col)
