"""Pairs of texts of a block by their sets of shingles, hashed on Arrow buffers.

A set that is alike to another by ``least`` has at least that part of its shingles in it.  So the first pass only counts how many of a text's shingles other
texts of its block have, too: it deals 32 bits of each, which can take two shingles for one but never the other way round.  The sets of the texts that
pass, and of no others, are dealt whole and compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..tables import shared_dir, written
from .dedup import block_jaccard

#: Characters of a block beyond which its shingles are dealt to several groups, and of a group; bytes of texts hashed at a time.
HEAVY, GROUP, _BYTES = 12_000_000, 3_000_000, 2 << 20
#: Bits of the filter of texts that pass: 16 for each of them, within these bounds.
LEAST_BITS, MOST_BITS = 1 << 15, 1 << 26
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_RANDOM = np.random.Generator(np.random.PCG64(11))
_BYTE = _RANDOM.integers(0, 1 << 64, 256, _U)
_ALNUM = np.isin(np.arange(256), np.frombuffer(b"0123456789abcdefghijklmnopqrstuvwxyz", np.uint8))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> _U(30)) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ x >> _U(27)) * _U(0x94D049BB133111EB)
    return x ^ x >> _U(31)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, _U)
    out[:1] = 1
    return np.cumprod(out, dtype=_U)


def shingle_sets(column: pa.Array, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, hashes): the ascending distinct 64-bit hashes of each text's runs of ``k`` words ``[a-z0-9]+``; fewer words are one run.  Binary, without nulls."""
    off = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(column.buffers()[2] or b"", np.uint8)[off[0] : off[-1]]
    off = off - off[0]
    data = np.insert(raw, off[1:-1], 0x20)
    edge = np.diff(np.concatenate([[0], _ALNUM[data].view(np.int8), [0]]))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    with np.errstate(over="ignore"):
        # a polynomial of each word's bytes, as a difference of running sums that is moved to the word's start
        total = np.concatenate([np.zeros(1, _U), np.cumsum(_BYTE[data] * _powers(_BASE, len(data)), dtype=_U)])
        word = _mixed((total[ends] - total[starts]) * _powers(pow(_BASE, -1, 1 << 64), len(data) + 1)[starts])
        bounds = np.searchsorted(starts, np.append(off[:-1] + np.arange(len(column)), len(data)))
        n = np.diff(bounds)
        doc = np.repeat(np.arange(len(column)), n)
        left = bounds[doc + 1] - np.arange(len(doc))
        first = (left >= k) | ((n[doc] < k) & (left == n[doc]))
        run, place = np.zeros(len(word), _U), np.arange(len(word))
        for j in range(k):
            inside = place[left > j]
            run[inside] += word[inside + j] * _U(2 * j + 1) + _mixed(word[inside + j] ^ _U(j))
        run = _mixed(run + _mixed(np.minimum(left, k).astype(_U)))[first]
    doc = doc[first]
    order = np.lexsort((run, doc))
    run, doc = run[order], doc[order]
    keep = np.concatenate([[True], (run[1:] != run[:-1]) | (doc[1:] != doc[:-1])])[: len(run)]
    return np.searchsorted(doc[keep], np.arange(len(column) + 1)), run[keep]


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of some 2 MB of texts, the last column."""
    for batch in batches:
        if batch.num_rows:
            size = np.cumsum(pc.binary_length(batch.column(batch.num_columns - 1)).to_numpy().astype(np.int64))
            cuts = np.flatnonzero(np.diff(size // _BYTES)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
                yield batch.slice(a, b - a)


def _dealt(parts: dict[int, int], groups: int, k: int):
    """(g, block, parts, id, size, keys): 32 bits of each of a text's shingles, in a row for each part of its block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            bounds, h = shingle_sets(batch.column(2), k)
            block, size = batch.column(1).to_numpy(), np.diff(bounds)
            many = np.array([parts.get(b, 1) for b in block.tolist()], np.int64)
            doc = np.repeat(np.arange(len(size)), size)
            part = ((h & _U(0xFFFFFFFF)) % many[doc].astype(_U)).astype(np.int64)
            order = np.lexsort((part, doc))
            doc, part, key = doc[order], part[order], (h[order] >> _U(32)).astype(np.uint32).view(np.int32)
            row = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (part[1:] != part[:-1])])[: len(doc)])
            own = doc[row]
            with np.errstate(over="ignore"):
                g = (_mixed(block[own].view(_U) + _mixed(part[row].astype(_U))) % _U(groups)).astype(np.int32)
            keys = pa.ListArray.from_arrays(pa.array(np.append(row, len(doc)).astype(np.int32)), pa.array(key))
            yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(block[own]), pa.array(many[own].astype(np.int32)), batch.column(0).take(pa.array(own)), pa.array(size[own].astype(np.int32)), keys], names=["g", "block", "parts", "id", "size", "keys"])

    return run


def _shared(least: float):
    """(id, size, shared): how many of a row's shingles other rows of its block have, too; texts of undivided blocks only if those are enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(batches).combine_chunks()
        lists = t.column("keys").combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        n = lists.value_lengths().to_numpy().astype(np.int64)
        row = np.repeat(np.arange(len(n)), n)
        place = np.unique(t.column("block").to_numpy(), return_inverse=True)[1].astype(_U)
        _, at, many = np.unique(place[row] << _U(32) | lists.flatten().to_numpy().view(np.uint32), return_inverse=True, return_counts=True)
        shared = np.bincount(row, many[at] > 1, len(n)).astype(np.int64)
        size = t.column("size").to_numpy().astype(np.int64)
        keep = pa.array((shared > 0) & ((t.column("parts").to_numpy() > 1) | (shared >= least * size - 1e-9)))
        yield pa.RecordBatch.from_arrays([t.column("id").combine_chunks().filter(keep), pa.array(size).filter(keep), pa.array(shared).filter(keep)], names=["id", "size", "shared"])

    return run


def _whole(bits: np.ndarray, k: int):
    """(id, block, t): the sets of the texts whose bit is set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = batch.column(2).to_numpy()
            for piece in _pieces(iter([batch.filter(pa.array(bits[p >> 3] >> (p & 7) & 1).cast(pa.bool_()))])):
                bounds, h = shingle_sets(piece.column(3), k)
                some = np.flatnonzero(np.diff(bounds))
                sets = pa.ListArray.from_arrays(pa.array(np.append(bounds[some], len(h)).astype(np.int32)), pa.array(h.view(np.int64)))
                yield pa.RecordBatch.from_arrays([piece.column(0).take(pa.array(some)), piece.column(1).take(pa.array(some)), sets], names=["id", "block", "t"])

    return run


def _bits(ids: DataFrame) -> np.ndarray:
    """A bit for each remainder of the hash of an id, eight a byte."""
    n = LEAST_BITS
    while n < min(MOST_BITS, 16 * ids.count()):
        n *= 2
    at = ids.select(F.pmod(F.xxhash64("id"), F.lit(n)).alias("p"))
    out = np.zeros(n // LEAST_BITS * 4096, np.uint8)
    for r in at.groupBy(F.shiftright("p", 15).alias("k")).agg(F.bitmap_construct_agg(F.col("p").bitwiseAND(LEAST_BITS - 1)).alias("bits")).collect():  # MOST_BITS at most
        out[r.k * 4096 : (r.k + 1) * 4096] = np.frombuffer(r.bits, np.uint8)
    return out


def shingle_jaccard(df: DataFrame, id_col: str, block: Column, text_col: str, least: float, k: int = 5) -> DataFrame:
    """(a, b, jaccard): pairs a < b of a block whose sets of ``k``-word shingles are alike by ``least`` or more.

    Words are ``[a-z0-9]+`` of the text in lower case.  Null blocks and texts without words take no part.
    """
    folder, kind = shared_dir(df.sparkSession), dict(df.dtypes)[id_col]
    rows = df.select(F.col(id_col).alias("id"), F.xxhash64(block).alias("block"), F.coalesce(F.lower(text_col), F.lit("")).alias("low"), (block.isNotNull() & F.col(id_col).isNotNull()).alias("ok")).where("ok").drop("ok")
    sizes = written(rows.groupBy("block").agg(F.sum(F.length("low")).alias("n")), folder, "sizes")
    groups = 1 + (sizes.agg(F.sum("n")).first()[0] or 0) // GROUP
    parts = {r.block: 1 + r.n // HEAVY for r in sizes.where(F.col("n") >= HEAVY).collect()}  # one row for each HEAVY characters at most
    texts = F.col("low").cast("binary")
    keys = rows.select("id", "block", texts).mapInArrow(_dealt(parts, groups, k), f"g int, block long, parts int, id {kind}, size int, keys array<int>")
    counted = keys.groupBy("g").applyInArrow(_shared(least), f"id {kind}, size long, shared long")
    enough = counted.groupBy("id").agg(F.min("size").alias("size"), F.sum("shared").alias("shared")).where(F.col("shared") >= least * F.col("size") - 1e-9)
    bits = _bits(written(enough.select("id"), folder, "enough"))
    sets = rows.select("id", "block", F.pmod(F.xxhash64("id"), F.lit(8 * len(bits))).alias("p"), texts).mapInArrow(_whole(bits, k), f"id {kind}, block long, t array<long>")
    return block_jaccard(sets, "id", "block", "t", least)
