"""Near-duplicate documents: SuperMinHash signatures, banding, verification on full sets, union-find grouping.

Signatures.  Every distinct shingle draws, at step j = 0, 1, ..., a bin from its own permutation
of the bins and a fraction in [0, 1); a bin keeps the least ``j + fraction``.  Bins that one
shingle reaches are thus correlated through its permutation, which lowers the variance against
plain MinHash, and a document stops at the first step after which every bin holds a smaller step.

Grouping.  Documents with equal shingle sets form a class, and only the class's smallest id goes on.  Each band of a signature names a bucket.

1. Inside each bucket, sketches (one byte of each bin) are compared, and those equal in ``LIKELY`` of the bins or more are joined by union-find.  Only the
   edges of the resulting forest leave the task, never the pairs.  Their components over all buckets are groups: no link crosses groups.
2. The full sets of each group are compared, all intersections of a cell at once, exactly, and again only a forest of the links leaves the task.  The
   components of these are the result.

Both steps deal large buckets and groups to cells of bounded size, each with the bucket's or group's first member besides its own.  What is joined then, in
a cell or by that member, needs no further look; only members outside the largest component so far are dealt to cells with all others.  Rows formed thus grow
with the members, and with the product of members and those left apart.  No step caps a bucket, a group or a list of partners.  A pair
of similarity 0.8 shares no band once in 2e7, and has less than 0.56 of its bins equal once in 1e10.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import release, shared_dir, written
from ._words import blocks, hash_spans, mix, rolling, signed, split_words, take
from .components import connected, forest

BINS = 128
#: Rows of a band: 32 bands of 4 miss a pair of similarity 0.8 once in 2e7.
ROWS = 4
#: Share of equal bins below which a pair isn't checked.
LIKELY = 0.56
#: Members of half a cell: by sketch, and by full set (also a bound of all their shingles).
BLOCK, SET_BLOCK, SET_ITEMS, APART = 192, 192, 1 << 20, 64
#: Rows of three numbers that are broadcast at most, some 5 MB; more are joined by a shuffle.
FEW = 200_000


def shingle_sets(words: np.ndarray, bounds: np.ndarray, k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each document.  ``words``: word hashes; ``bounds``: words before each document."""
    grams = rolling(words, k)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= k:
            out.append(np.unique(grams[a : b - k + 1]))
        else:
            out.append(rolling(words[a:b], b - a) if b > a else np.zeros(0, np.uint64))
    return out


def superminhash(sets: list[np.ndarray], bins: int = BINS) -> np.ndarray:
    """Signatures (documents x bins, uint32: step in the high byte, fraction below).  Empty sets keep all ones."""
    sig = np.full((len(sets), bins), 0xFFFFFFFF, np.uint32)
    flat = sig.reshape(-1)
    sizes = np.array([len(x) for x in sets])
    if not sizes.sum():
        return sig
    e = mix(np.concatenate(sets) ^ np.uint64(0x51ED270B))
    doc = np.repeat(np.arange(len(sets)), sizes)
    live = sizes > 0
    m = np.uint64(bins - 1)
    a, b = e & m, (e >> np.uint64(7)) & m | np.uint64(1)
    c, d = (e >> np.uint64(14)) & m, (e >> np.uint64(21)) & m | np.uint64(1)
    for j in range(bins):
        x = (np.uint64(j) * b + a) & m
        x ^= x >> np.uint64(3)
        x = (x * d + c) & m
        x ^= x >> np.uint64(4)
        step = np.uint64(j * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        value = (mix(e + step) >> np.uint64(40)).astype(np.uint32) | np.uint32(j << 24)
        np.minimum.at(flat, doc * bins + x.astype(np.int64), value)
        done = live & (sig.max(1) < np.uint64((j + 1) << 24))
        if done.any():
            live &= ~done
            if not live.any():
                break
            keep = live[doc]
            e, doc, a, b, c, d = e[keep], doc[keep], a[keep], b[keep], c[keep], d[keep]
    return sig


def _sets(block, k: int) -> list[np.ndarray]:
    starts, ends, bounds = split_words(block)
    return shingle_sets(hash_spans(block.data, starts, ends, lower=True), bounds, k)


def _low_bytes(column: str):
    """The low byte of each little-endian 32-bit value of a binary column."""
    digits = F.hex(column)
    return F.unhex(F.regexp_replace(digits, "(..)......", "$1"))


def _sign(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "_text", 4 << 20):
            sets = _sets(block, k)
            sig = superminhash(sets)
            keys = [np.array([mix(s ^ np.uint64(salt)).sum(dtype=np.uint64) for s in sets], np.uint64) for salt in (0x1B873593, 0x7ED55D16)]
            yield pa.RecordBatch.from_arrays(
                [*take(block, ["_id"]), pa.array([len(s) for s in sets], pa.int64()), *(pa.array(signed(x)) for x in keys), pa.array([row.tobytes() for row in sig], pa.binary())],
                names=["_id", "n", "k1", "k2", "sig"],
            )

    return run


def _full(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "_text", 4 << 20):
            sets = _sets(block, k)
            off = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            flat = signed(np.concatenate(sets)) if len(sets) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*take(block, ["_id", "key", "cells"]), pa.ListArray.from_arrays(pa.array(off), pa.array(flat))], names=["id", "key", "cells", "payload"])

    return run


def _cells(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[pa.Table, list[tuple[int, int]]]]:
    """Tables of whole cells with each one's range of rows; rows come sorted by the first ``keys`` columns, which are long."""

    def out(t: pa.Table):
        change = np.zeros(max(0, t.num_rows - 1), bool)
        for k in range(keys):
            change |= np.diff(t.column(k).to_numpy()) != 0
        cuts = (np.flatnonzero(change) + 1).tolist()
        return t, list(zip([0, *cuts], [*cuts, t.num_rows]))

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(keys)])
        first = np.array([(held[0] if held else batch).column(k)[0].as_py() for k in range(keys)])
        if (key[:, -1] == first).all():  # one cell so far, and it may go on
            held.append(batch)
            continue
        last = int(np.flatnonzero((key != key[:, -1:]).any(0))[-1]) + 1 if (key != key[:, -1:]).any() else 0
        if held or last:
            yield out(pa.Table.from_batches([*held, batch.slice(0, last)]))
        held = [batch.slice(last)]
    if held:
        yield out(pa.Table.from_batches(held))


def _edges(out: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    cols = [np.concatenate([np.zeros(0, np.int64), *(x[k] for x in out)]) for k in (0, 1)]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["a", "b"])


def _star(ids: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An edge from each member to the smallest id of its label."""
    order = np.lexsort((ids, label))
    first = np.ones(len(ids), bool)
    first[1:] = label[order][1:] != label[order][:-1]
    root = ids[order][np.flatnonzero(first)[np.cumsum(first) - 1]]
    keep = root != ids[order]
    return root[keep], ids[order][keep]


def _likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, cell, id, sketch) -> a forest that joins likely pairs inside each cell."""
    for t, ranges in _cells(batches, 2):
        ids = t.column(2).to_numpy()
        sketches = np.frombuffer(b"".join(t.column(3).to_pylist()), np.uint8).reshape(-1, BINS)
        out = []
        for a, b in ranges:
            x, label = sketches[a:b], np.arange(b - a)
            for i in range(b - a - 1):
                other = np.flatnonzero(label[i + 1 :] != label[i]) + i + 1
                hit = other[(x[other] == x[i]).sum(1) >= LIKELY * BINS]
                if len(hit):
                    label[np.isin(label, label[hit])] = label[i]
            out.append(_star(ids[a:b], label))
        yield _edges(out)


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """The size of each pair's intersection."""
    m = len(sets)
    flat = np.concatenate(sets)
    _, inverse, n = np.unique(flat, return_inverse=True, return_counts=True)
    member = np.repeat(np.arange(m), [len(x) for x in sets])
    keep = n[inverse] > 1
    order = np.argsort(inverse[keep], kind="stable")
    member, inverse = member[keep][order], inverse[keep][order]
    column = np.cumsum(np.concatenate([[0], np.diff(inverse) != 0])) if len(inverse) else inverse
    out = np.zeros((m, m), np.float32)
    step = max(1, (1 << 23) // m)
    for c in range(0, int(column[-1]) + 1 if len(column) else 0, step):
        at, to = np.searchsorted(column, [c, c + step])
        x = np.zeros((m, min(step, int(column[to - 1]) + 1 - c)), np.float32)
        x[member[at:to], column[at:to] - c] = 1
        out += x @ x.T
    return out


def _exact(percent: int):
    """(group, cell, id, items) -> a forest of the links inside each cell."""

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, ranges in _cells(batches, 2):
            ids = t.column(2).to_numpy()
            lists = t.column(3).combine_chunks()
            off, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
            out = []
            for a, b in ranges:
                n = np.diff(off[a : b + 1])
                both = intersections([flat[off[k] : off[k + 1]] for k in range(a, b)])
                linked = 100.0 * both.astype(np.float64) >= percent * (n[:, None] + n[None, :] - both.astype(np.float64))
                label = np.arange(b - a)
                while True:
                    least = np.where(linked, label[None, :], len(label)).min(1)
                    least = np.minimum(least, label)[np.minimum(least, label)]
                    if (least == label).all():
                        break
                    label = least
                out.append(_star(ids[a:b], label))
            yield _edges(out)

    return lambda batches: forest(links(batches))


def _in_cells(rows: DataFrame, compare) -> DataFrame:
    return rows.select("key", "cell", "id", "payload").repartition("key", "cell").sortWithinPartitions("key", "cell").mapInArrow(compare, "a long, b long")


def _few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(FEW + 1).count() <= FEW else df


def _links(members, payload, sizes: DataFrame, compare, folder: str, name: str) -> DataFrame:
    """(a, b): edges whose components are those of all pairs that ``compare`` joins within a key.

    ``members(sizes)`` gives (key, id) and what ``sizes`` (key, first, parts) has of them, ``payload`` adds the column of that name.  The members are dealt to
    ``parts`` cells, with the member ``first`` in each.  Of keys of several cells, members that are not in the key's largest component then meet all others.
    """
    own, every = F.pmod(F.xxhash64("id", F.lit(7)), F.col("parts")), F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)
    cell = F.when(F.col("id") == F.col("first"), every).otherwise(F.array(own))
    edges = written(_in_cells(payload(members(sizes).withColumn("cells", cell).select("key", "id", "cells")).withColumn("cell", F.explode("cells")), compare), folder, f"{name}-once")
    large = sizes.where("parts > 1")
    if not large.take(1):
        return edges
    joined = connected(edges, f"{folder}/{name}-joined", contracted=True).withColumnRenamed("node", "id")
    inside = members(_few(large)).join(joined, "id", "left").select("key", "id", "parts", F.coalesce("comp", "id").alias("comp"))
    inside = written(inside.distinct(), folder, f"{name}-members")
    main = inside.groupBy("key", "comp").count().groupBy("key").agg(F.max_by("comp", F.struct("count", "comp")).alias("main"), (F.sum("count") - F.max("count")).alias("rest"))
    main = written(main.where("rest > 0").select("key", "main", F.ceil(F.col("rest") / APART).alias("deals")), folder, f"{name}-main")
    if not main.take(1):
        return edges
    turn = F.pmod(F.xxhash64("id", F.lit(11)), F.col("deals")) * F.col("parts")
    met = F.transform(F.sequence(F.lit(0).cast("long"), F.col("deals") - 1), lambda k: k * F.col("parts") + own)
    cells = F.array_distinct(F.concat(met, F.when(F.col("comp") != F.col("main"), F.transform(every, lambda k: turn + k)).otherwise(F.array().cast("array<long>"))))
    again = written(inside.join(_few(main), "key").select("key", "id", cells.alias("cells")), folder, f"{name}-cells")
    return edges.union(written(_in_cells(payload(_few(again)).withColumn("cell", F.explode("cells")), compare), folder, f"{name}-again"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """(id_col, n_shingles long, component_id long, kept boolean), one row per row of ``docs``.

    Links join documents with ``100 * |A & B| >= percent * |A | B|`` over distinct ``shingle``-word
    shingles of the text with A-Z lowered; a document with fewer words has the whole sequence as its
    only shingle; one without words, with empty or null text has the empty set and no links.
    ``component_id`` is the smallest id reachable; ``kept`` tells whether it is the row's own.
    Rows that share an id are judged by their own texts.  A row whose id is null is linked with nothing: its component_id is null
    and it is kept.  Other columns are not read, whatever their names.
    """
    spark = docs.sparkSession
    folder = shared_dir(spark)
    src = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("binary").alias("_text"))
    signed_docs = written(src.mapInArrow(_sign(shingle), "_id long, n long, k1 long, k2 long, sig binary"), folder, "signatures")
    keys = ["n", "k1", "k2"]
    classes = signed_docs.where("n > 0 and _id is not null").groupBy(*keys).agg(F.min(F.struct("_id", "sig")).alias("r")).select(*keys, F.col("r._id").alias("id"), F.col("r.sig").alias("sig"))
    classes = written(classes, folder, "classes")
    release(spark)

    width = 4 * ROWS
    band = F.explode(F.transform(F.sequence(F.lit(0), F.lit(BINS // ROWS - 1)), lambda i: F.xxhash64(i, F.substr("sig", i * width + 1, F.lit(width)))))
    banded = classes.select(band.alias("key"), "id", "n")
    # buckets with the same members are one bucket
    heads = banded.groupBy("key").agg(F.count("*").alias("c"), F.min("id").alias("m"), F.sum(F.xxhash64("id").cast("decimal(20,0)")).alias("h")).where("c > 1").groupBy("c", "m", "h").agg(F.min("key").alias("key"))
    heads = written(heads.select("key", F.col("m").alias("first"), F.greatest(F.lit(1), F.ceil(F.col("c") / BLOCK)).cast("long").alias("parts")), folder, "buckets")
    sketches = classes.select("id", _low_bytes("sig").alias("payload"))
    likely = _links(lambda some: banded.join(some, "key"), lambda rows: rows.join(sketches, "id"), heads, lambda batches: forest(_likely(batches)), folder, "likely")
    groups = connected(likely, f"{folder}/groups", contracted=True)
    release(spark)

    sized = classes.select(F.col("id").alias("node"), "n").join(groups, "node")
    sizes = sized.groupBy(F.col("comp").alias("key")).agg(F.count("*").alias("c"), F.sum("n").alias("s"))
    parts = F.greatest(F.lit(1), F.ceil(F.col("c") / SET_BLOCK), F.least(F.col("c"), F.ceil(F.col("s") / SET_ITEMS))).cast("long")
    sizes = written(sizes.select("key", F.col("key").alias("first"), parts.alias("parts")), folder, "sizes")
    grouped = groups.select(F.col("comp").alias("key"), F.col("node").alias("id"))

    def sets(rows: DataFrame) -> DataFrame:
        full = src.where("_id is not null").join(rows.withColumnRenamed("id", "_id"), "_id")
        return full.mapInArrow(_full(shingle), "id long, key long, cells array<long>, payload array<long>")

    linked = _links(lambda some: grouped.join(some, "key"), sets, sizes, _exact(percent), folder, "links")
    comps = connected(linked, f"{folder}/components", contracted=True).select(F.col("node").alias("id"), "comp")
    found = classes.select(*keys, "id").join(comps, "id", "left").select(*keys, F.coalesce("comp", "id").alias("component_id"))
    found = written(found, folder, "found")
    out = signed_docs.select("_id", *keys).join(found, keys, "left").withColumn("component_id", F.when(F.col("_id").isNotNull(), F.coalesce("component_id", "_id")))
    return out.select(F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("component_id") == F.col("_id"), F.lit(True)).alias("kept"))
