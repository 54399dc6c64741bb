"""Exact removal of repeated word windows by De Bruijn compaction with Spark joins.

Windows of ``window`` consecutive words are the edges of a De Bruijn graph over word k-mers.  Most
edges lie on nonbranching paths, so they are handled as paths and not one by one:

1. Compaction.  Each window has an anchor, its leftmost ``gram``-word gram of least hash.  The windows
   of one document that share an anchor position form a path; it depends on their words alone.
   A path is one row: anchor, hash of all its words, source coordinates.  Inside one map task equal paths are merged at once, so that
   a passage that fills a third of the input gives one row per task.
2. Repeats.  Equal windows have equal anchors, so a path whose anchor has one row can't repeat.  A grouped count and a join leave
   the paths with repeated anchors; of equal paths all but the first, by source coordinates, are removed whole.
3. Branches.  Where an anchor has several different paths, the path branches: the first copy of each is resolved into its
   windows, whose coordinates are compared one by one.
4. The intervals found are joined to the texts and covered words removed.

No step needs all rows of a key in one task: counts and minima are partially aggregated and joins can be split.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import drop_folder, release, shared_dir, written
from ._words import Block, blocks, hash_spans, mix, powers, rolling, signed, split_words, take

GRAM = 6
_FLUSH = 1_500_000
_NAMES = ["anchor", "path", "doc", "th", "start", "n", "again"]
_TYPES = "anchor long, path long, doc long, th long, start int, n int, again boolean"


def paths_of(words: np.ndarray, bounds: np.ndarray, window: int, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(anchor, path hash, document, start within it, number of windows) of every path of a block."""
    none = tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64))
    if len(words) < window:
        return none
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    grams, span = rolling(words, gram), window - gram + 1
    least, have = grams, 1
    while have * 2 <= span:
        least, have = np.minimum(least[: len(least) - have], least[have:]), have * 2
    if have < span:
        least = np.minimum(least[: len(least) - (span - have)], least[span - have :])
    at = np.flatnonzero(doc[: len(least)] == doc[window - 1 :])
    if not len(at):
        return none
    least = least[at]
    off = np.zeros(len(at), np.int64)
    for k in range(span - 1, -1, -1):
        off[grams[at + k] == least] = k
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(at + off) != 0) | (np.diff(at) != 1)
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(at)))
    s = at[first]
    e = s + n + window - 1
    pw, inv = powers(len(words))
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * pw, out=sums[1:])
    path = mix((sums[e] - sums[s]) * inv[s] + n.astype(np.uint64))
    return least[first], path, doc[s], s - bounds[doc[s]], n


def _merge(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    """Rows of one task with the later ones of equal paths flagged."""
    anchor, path, doc, th, start, n = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((start, th, doc))
    order = order[np.argsort(mix(anchor ^ mix(path))[order], kind="stable")]
    anchor, path, doc, th, start, n = (x[order] for x in (anchor, path, doc, th, start, n))
    again = np.zeros(len(anchor), bool)
    again[1:] = (anchor[1:] == anchor[:-1]) & (path[1:] == path[:-1])
    return pa.RecordBatch.from_arrays([*map(pa.array, (signed(anchor), signed(path), doc, th, start.astype(np.int32), n.astype(np.int32), again))], names=_NAMES)


def _words(block: Block) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, bounds = split_words(block)
    return hash_spans(block.data, starts, ends), bounds


def _paths(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for block in blocks(batches, "_text"):
            anchor, path, doc, start, n = paths_of(*_words(block), window)
            ids, ths = (x.to_numpy(zero_copy_only=False) for x in take(block, ["_id", "_th"]))
            parts.append((anchor, path, ids[doc], ths[doc], start, n))
            held += len(anchor)
            if held >= _FLUSH:
                yield _merge(parts)
                parts, held = [], 0
        if held:
            yield _merge(parts)

    return run


def _flat(block: Block, column: str) -> tuple[np.ndarray, list[np.ndarray]]:
    """Document of each element of a list-of-structs column, and the struct's fields."""
    col = take(block, [column])[0]
    lists, values = col.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), col.flatten()
    return np.repeat(np.arange(len(block)), lists), [x.to_numpy(zero_copy_only=False) for x in values.flatten()]


def _windows(window: int):
    """Every window of the listed paths: (anchor, window hash, doc, th, start)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "_text"):
            words, bounds = _words(block)
            doc, (anchor, start, n) = _flat(block, "paths")
            each = np.repeat(np.arange(len(doc)), n)
            pos = start[each] + np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
            ids, ths = (x.to_numpy(zero_copy_only=False)[doc[each]] for x in take(block, ["_id", "_th"]))
            yield pa.RecordBatch.from_arrays([*map(pa.array, (anchor[each], signed(rolling(words, window))[bounds[doc[each]] + pos], ids, ths, pos.astype(np.int32)))], names=["anchor", "w", "doc", "th", "start"])

    return run


def _cut(window: int, texts: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "_text"):
            bounds = split_words(block)[2]
            doc, (start, n) = _flat(block, "cuts")
            step = np.zeros(int(bounds[-1]) + 1, np.int64)
            np.add.at(step, bounds[doc] + start, 1)
            np.add.at(step, bounds[doc] + start + n + window - 1, -1)
            gone = np.cumsum(step[:-1]) > 0
            total = np.concatenate([[0], np.cumsum(gone)])
            removed = total[bounds[1:]] - total[bounds[:-1]]
            kept = []
            for i, r in enumerate(removed.tolist()):
                words = block.bytes_of(i).split()
                kept.append(b" ".join(compress(words, ~gone[bounds[i] : bounds[i + 1]]) if r else words))
            out = [*take(block, ["_own"]), pa.array(np.diff(bounds)), pa.array(removed), pa.array([hashlib.sha256(x).hexdigest() for x in kept])]
            yield pa.RecordBatch.from_arrays(out + [pa.array([x.decode("utf-8", "replace") for x in kept])] * texts, names=["_own", "n_words", "n_removed", "kept_sha256", "kept_text"][: 4 + texts])

    return run


def _place(*names: str) -> Column:
    return F.struct(*names)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20, texts: bool = False) -> DataFrame:
    """(id_col, n_words long, n_removed long, kept_sha256 string[, kept_text string]), one row per row of ``docs``.

    Words are maximal runs of characters other than space and 0x09-0x0D, unchanged.  A word goes if a window covers it
    whose word sequence also starts earlier: at a smaller id, or earlier in the same document.  Windows are judged on the input.
    Null text has no words; texts of fewer than ``window`` words stay whole.  A null id counts as smaller than all others.  Different texts under
    one id follow each other in the order of their hash; rows equal in id and text are one document and are cut alike.
    Hashes of 64 bits for anchor and window (or path) together identify a sequence.  Other columns are not read.
    """
    spark = docs.sparkSession
    folder = shared_dir(spark)
    own, text = F.col(id_col), F.col(text_col)
    repeated = not docs.groupBy(own).count().where("count > 1").isEmpty()
    src = docs.select(own.alias("_own"), F.coalesce(own.cast("long"), F.lit(-(1 << 63))).alias("_id"), (F.xxhash64(text) if repeated else F.lit(0).cast("long")).alias("_th"), text.cast("binary").alias("_text"))
    rows = written(src.select("_id", "_th", "_text").mapInArrow(_paths(window), _TYPES), folder, "paths")
    first = rows.where("not again").drop("again")

    anchors = first.groupBy("anchor").agg(F.count("*").alias("c"), F.min("path").alias("lo"), F.max("path").alias("hi")).where("c > 1").select("anchor", (F.col("lo") != F.col("hi")).alias("branches"))
    anchors = written(anchors, folder, "anchors")
    release(spark)
    shared = written(first.join(anchors, "anchor"), folder, "shared")
    release(spark)

    place = _place("doc", "th", "start")
    heads = written(shared.groupBy("anchor", "path").agg(F.min(F.struct("doc", "th", "start", "n")).alias("h"), F.count("*").alias("c"), F.max("branches").alias("branches")), folder, "heads")
    whole = shared.join(heads.where("c > 1").select("anchor", "path", F.struct("h.doc", "h.th", "h.start").alias("f")), ["anchor", "path"]).where(place != F.col("f")).select("doc", "th", "start", "n")

    key = [F.col("doc").alias("_id"), F.col("th").alias("_th")]
    open_ = heads.where("branches").select("anchor", "h.*").groupBy(*key).agg(F.collect_list(F.struct("anchor", "start", "n")).alias("paths"))
    # equal rows (id and text) would give each window twice
    unique = src.select("_id", "_th", "_text")
    unique = unique.dropDuplicates(["_id", "_th"]) if repeated else unique
    windows = written(unique.join(open_.hint("shuffle_hash"), ["_id", "_th"]).mapInArrow(_windows(window), "anchor long, w long, doc long, th long, start int"), folder, "windows")
    release(spark)
    least = windows.groupBy("anchor", "w").agg(F.min(place).alias("f"), F.count("*").alias("c")).where("c > 1").select("anchor", "w", "f")
    single = windows.join(least, ["anchor", "w"]).where(place != F.col("f")).select("doc", "th", "start", F.lit(1).alias("n"))

    # equal rows of one task count as one document: a path is 'again' only if its first copy lies elsewhere
    again = rows.where("again").select("doc", "th", "start", "n")
    if repeated:
        again = _elsewhere(rows)
        whole = whole.distinct()
    cuts = again.union(whole).union(single).groupBy(*key).agg(F.collect_list(F.struct("start", "n")).alias("cuts"))
    cuts = written(cuts, folder, "cuts")
    for name in ("paths", "shared", "windows", "heads", "anchors"):
        drop_folder(spark, f"{folder}/{name}")
    release(spark)
    out = src.join(cuts.hint("shuffle_hash"), ["_id", "_th"], "left").select("_own", "_text", "cuts")
    kind = docs.schema[id_col].dataType.simpleString()
    got = out.mapInArrow(_cut(window, texts), f"_own {kind}, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * texts)
    return got.withColumnRenamed("_own", id_col)


def _elsewhere(rows: DataFrame) -> DataFrame:
    """For tables with repeated ids: merged rows whose path has an earlier place in another document or start."""
    least = rows.groupBy("anchor", "path").agg(F.min(_place("doc", "th", "start")).alias("f"))
    return rows.where("again").join(least, ["anchor", "path"]).where(_place("doc", "th", "start") != F.col("f")).select("doc", "th", "start", "n").distinct()
