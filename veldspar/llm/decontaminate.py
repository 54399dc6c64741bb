"""Benchmark decontamination by latent semantic retrieval.

Passages are TF-IDF vectors.  A distributed randomised SVD of a bounded sample of corpus passages and of all benchmark passages gives a latent
space, which is whitened.  As a passage's latent vector is the weighted sum of its words' vectors, all overlapping passages of every document follow from
block sums.  Passages whose cosine to a benchmark passage is high are candidates.  A candidate counts if the longest common
subsequence of words with the benchmark item, near the passage, is long enough, or for paraphrases shorter but with the item's answer (its last words) whole.
Of a longer item it also counts if one of its passages is covered, or any stretch as long as a passage is copied word for word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import shared_dir, written
from ._words import Block, Places, blocks, give_back, hash_spans, split_words, take

#: Words of a passage, and of the steps between passages of a document.
PASSAGE, STEP = 24, 8
#: Latent dimensions; further random directions and power iterations of the SVD.
RANK, OVER, POWER = 64, 16, 2
#: Corpus passages that the latent space is fitted on at most (one a document, in the order of the hash of its id and text).
SAMPLE = 3_000
#: Least cosine of a candidate.
COSINE = 0.36
#: Least part of an item's words in common order: to count, and to count with the answer.
WHOLE, PARTLY, ANSWER = 0.7, 0.5, 4
#: Least part of a passage's words in common order that covers it.
COVERED = 0.7
#: Least part of a passage's words, weighted by inverse document frequency, that a candidate has in any order before the subsequence is measured.
SHARED = 0.3
#: Steps of a document, and benchmark passages, compared at once: these arrays stay in the processor's cache.
ROWS, QUERIES = 512, 512


def _hashes(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes with A-Z and the capitals of U+00C0-U+00DE lowered, and the words before each row."""
    starts, ends, bounds = split_words(block)
    low = block.data.copy()
    second = low[1:]
    second[(low[:-1] == 0xC3) & (second >= 0x80) & (second <= 0x9E) & (second != 0x97)] += 0x20
    return hash_spans(low, starts, ends, lower=True), bounds


def words_of(texts: list[str]) -> list[np.ndarray]:
    """Word hashes of each text."""
    if not texts:
        return []
    block = next(blocks(iter([pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["t"])]), "t", 1 << 62))
    h, bounds = _hashes(block)
    return [h[a:b] for a, b in zip(bounds[:-1], bounds[1:])]


def cut_passages(words: np.ndarray, size: int = PASSAGE) -> list[np.ndarray]:
    """Passages of ``size`` words that cover the words; the last ends with them; shorter texts are one passage."""
    if len(words) <= size:
        return [words] if len(words) else []
    n = -(-len(words) // size)
    return [words[s : s + size] for s in np.unique(np.linspace(0, len(words) - size, n).astype(int))]


def _document_counts(places: Places):
    """In how many documents of a task each word occurs; as a last term, the number of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(places.words)
        total = np.zeros(n + 1, np.int64)
        for block in blocks(batches, "_text", 2 << 20):
            h, bounds = _hashes(block)
            at = places.of(h)
            own = np.flatnonzero(at < n)
            doc = np.repeat(np.arange(len(block)), np.diff(bounds))
            pairs = np.unique(at[own] * np.int64(len(block)) + doc[own])
            total += np.bincount(pairs // len(block), minlength=n + 1)
            total[n] += len(block)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["term", "n"])

    return run


def _products(basis: np.ndarray):
    """A'(A x basis) of a task's rows of A, for the terms that occur in them: (term, bytes of a row of float64)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for terms, weights in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                t, w = np.array(terms, np.int64), np.array(weights)
                y = w @ basis[t] if len(t) else np.zeros(basis.shape[1])
                for k, x in zip(terms, weights):
                    total[k] = total[k] + x * y if k in total else x * y
        keys = sorted(total)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([total[k].tolist() for k in keys], pa.list_(pa.float64()))], names=["term", "row"])

    return run


def _gram_times(rows: DataFrame, basis: np.ndarray) -> np.ndarray:
    """(A'A) basis.  The result has as many rows as the bounded vocabulary of the sample."""
    width = basis.shape[1]
    parts = rows.mapInArrow(_products(basis), "term long, row array<double>")
    total = parts.groupBy("term").agg(F.array(*(F.sum(F.col("row")[k]) for k in range(width))).alias("row"))
    out = np.zeros_like(basis)
    for batch in total.toArrow().to_batches():
        if batch.num_rows:
            out[batch.column(0).to_numpy()] = np.array(batch.column(1).flatten().to_numpy()).reshape(-1, width)
    return out


class Latent:
    """Word vectors of the latent space: sorted word hashes, a row for each, and a last row of zeros for other words."""

    def __init__(self, words: np.ndarray, vectors: np.ndarray, idf: np.ndarray):
        self.places, self.idf = Places(words), np.append(idf, 0.0)
        self.vectors = np.concatenate([vectors, np.zeros((1, vectors.shape[1]))]).astype(np.float32)

    def rows(self, hashes: np.ndarray) -> np.ndarray:
        return self.places.of(hashes)


def _normal(x: np.ndarray) -> np.ndarray:
    n = np.sqrt((x * x).sum(-1, keepdims=True))
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def fit(docs: DataFrame, items: list[np.ndarray], text_col: str = "text", rank: int = RANK, sample: int = SAMPLE) -> Latent:
    """The latent space of benchmark passages ``items`` and a bounded sample of corpus passages; inverse document frequencies count all documents."""
    spark, folder = docs.sparkSession, shared_dir(docs.sparkSession)
    text = docs.select(F.col(text_col).cast("binary").alias("_text"))
    # texts in the order of their hash: the sample doesn't depend on how the table is dealt.  Only hashes are sorted.
    hashes = docs.select(F.xxhash64(text_col).alias("h")).where(F.col(text_col).isNotNull()).distinct().orderBy("h").limit(sample)
    top = [r.h for r in hashes.collect()]
    least = max(top) if top else 0
    picked = docs.where(F.col(text_col).isNotNull() & (F.xxhash64(text_col) <= F.lit(least))).select(F.xxhash64(text_col).alias("h"), F.col(text_col).alias("t")).groupBy("h").agg(F.min("t").alias("t"))
    # one passage of each, from a place that the hash names
    parts = F.regexp_extract_all(F.col("t"), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    at = F.pmod(F.col("h"), F.greatest(F.lit(1), F.size("w") - PASSAGE + 1)).cast("int") + 1
    texts = picked.select("h", parts.alias("w")).select(F.array_join(F.slice("w", at, PASSAGE), " ").alias("t"))
    passages = [*words_of([r.t for r in texts.collect()]), *items]
    words = np.unique(np.concatenate([np.zeros(0, np.uint64), *passages]))
    if not len(words):
        return Latent(words, np.zeros((0, rank)), np.zeros(0))
    # at most PASSAGE words of each sampled passage
    counts = np.zeros(len(words) + 1)
    for batch in text.mapInArrow(_document_counts(Places(words)), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow().to_batches():
        counts[batch.column(0).to_numpy()] = batch.column(1).to_numpy()
    idf = np.log((1 + counts[-1]) / (1 + counts[:-1])) + 1
    rows = []
    for p in passages:
        t, n = np.unique(np.searchsorted(words, p), return_counts=True)
        w = n * idf[t]
        rows.append((t, w / np.sqrt((w * w).sum()) if len(w) else w))
    a = spark.createDataFrame(pa.table({"terms": pa.array([t.tolist() for t, _ in rows], pa.list_(pa.int64())), "weights": pa.array([w.tolist() for _, w in rows], pa.list_(pa.float64()))}))
    a = written(a.repartition(max(1, min(8, len(rows) // 500))), folder, "sample")
    width = min(rank + OVER, len(words))
    basis = np.random.Generator(np.random.PCG64(7)).standard_normal((len(words), width))
    for _ in range(POWER):
        basis, _ = np.linalg.qr(_gram_times(a, basis))
    b = basis.T @ _gram_times(a, basis)
    values, turn = np.linalg.eigh((b + b.T) / 2)
    order = [k for k in np.argsort(-values) if values[k] > 1e-9][:rank]
    whitened = basis @ turn[:, order] / np.sqrt(values[order])
    latent = Latent(words, idf[:, None] * whitened, idf)
    del a, rows, passages, basis, whitened
    give_back()
    return latent


def lcs(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, a bit for each element of ``a``."""
    where: dict[int, int] = {}
    for k, x in enumerate(a.tolist()):
        where[x] = where.get(x, 0) | 1 << k
    full, row = (1 << len(a)) - 1, 0
    row = full
    for x in b.tolist():
        if m := where.get(x):
            u = row & m
            row = (row + u | row - u) & full
    return len(a) - row.bit_count()


def _holds(text: np.ndarray, part: np.ndarray) -> bool:
    """Whether ``part`` occurs whole in ``text``."""
    n = len(text) - len(part) + 1
    ok = np.ones(max(0, n), bool)
    for k, x in enumerate(part):
        ok &= text[k : k + n] == x
    return bool(ok.any())


class _Item:
    """A benchmark item: its words as places in the latent vocabulary, and what a text has to share with it."""

    def __init__(self, key: int, words: np.ndarray):
        self.key, self.words, self.kinds = key, words, set(words.tolist())
        self.own = {x: words.tolist().count(x) for x in self.kinds}
        self.stretches = {words[k : k + PASSAGE].tobytes() for k in range(len(words) - PASSAGE + 1)}

    def within(self, text: set[int]) -> int:
        """How many of the item's words occur in ``text``: no common subsequence is longer."""
        return sum(self.own[x] for x in self.kinds & text)


def _search(latent: Latent, items: list[tuple[int, np.ndarray]], cosine: float, text: str = "_text", keep: bool = False):
    """(id, item, cosine, common, answer, start): the best place of each document and benchmark item that passes the checks.

    With ``keep``, instead the rows that hold no leak, with all their columns.
    """
    zero = len(latent.places.words)
    known = [(key, latent.rows(words)) for key, words in items]
    pieces = [(k, p) for k, (_, rows) in enumerate(known) for p in cut_passages(rows)]
    queries = _normal(np.array([latent.vectors[p].sum(0) for _, p in pieces], np.float32).reshape(-1, latent.vectors.shape[1]))
    # a passage shorter than the window shares it with other words
    limits = (cosine * np.sqrt(np.minimum(1.0, np.array([len(p) for _, p in pieces]) / PASSAGE))).astype(np.float32)
    enough = np.array([SHARED * latent.idf[p].sum() for _, p in pieces])
    many = PASSAGE // STEP

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        full = [_Item(key, rows) for key, rows in known]
        marks = np.zeros(zero + 1)
        for block in blocks(batches, text, 2 << 20):
            best = leaks(block, full, marks)
            if keep:
                clean = np.ones(len(block), bool)
                clean[[d for d, _ in best]] = False
                yield block.rows.filter(pa.array(clean))
            elif best:
                keys = list(best)
                cols = [take(block, ["_id"])[0].take(pa.array([d for d, _ in keys])), pa.array([full[k].key for _, k in keys], pa.int64())]
                cols += [pa.array([best[x][j] for x in keys], t) for j, t in enumerate((pa.float64(), pa.float64(), pa.bool_(), pa.int64()))]
                yield pa.RecordBatch.from_arrays(cols, names=["_id", "item_id", "cosine", "common", "answer", "start"])

    def candidates(rows: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(document, its word, passage, cosine) of windows of the block that are close enough to a benchmark passage."""
        # words in steps that start anew at each document; a place past its end holds the row of zeros
        steps = -(-np.diff(bounds) // STEP)
        first = np.concatenate([[0], np.cumsum(steps)])
        doc = np.repeat(np.arange(len(steps)), steps)
        nth = np.arange(len(doc)) - first[doc]
        at, end = bounds[doc] + nth * STEP, bounds[doc + 1]
        # the last steps of a document only start a passage if the document is shorter than one
        full = nth <= np.maximum(0, steps[doc] - many)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for w in range(0, len(doc), ROWS):
            hi = min(len(doc), w + ROWS + many - 1)
            near = at[w:hi, None] + np.arange(STEP)
            vectors = latent.vectors[np.where(near < end[w:hi, None], rows[near], zero).ravel()].reshape(hi - w, STEP, -1).sum(1)
            n = min(ROWS, len(doc) - w)
            windows = vectors[:n].copy()
            for k in range(1, many):
                m = min(n, hi - w - k)
                windows[:m] += vectors[k : k + m] * (doc[w + k : w + k + m] == doc[w : w + m])[:, None]
            windows = _normal(windows[full[w : w + n]])
            place = np.flatnonzero(full[w : w + n]) + w
            for q in range(0, len(queries), QUERIES):
                got = windows @ queries[q : q + QUERIES].T
                r, c = np.divmod(np.flatnonzero(got >= limits[q : q + QUERIES]), got.shape[1])
                if len(r):
                    found.append((place[r], q + c, got[r, c]))
        step, query, value = (np.concatenate([np.zeros(0, t), *(x[k] for x in found)]) for k, t in enumerate((np.int64, np.int64, np.float32)))
        return doc[step], at[step], query, value

    def leaks(block: Block, full: list[_Item], marks: np.ndarray) -> dict[tuple[int, int], tuple]:
        h, bounds = _hashes(block)
        if not len(h) or not len(queries):
            return {}
        rows = np.concatenate([latent.rows(h), np.full(PASSAGE, zero, np.int32)])
        doc, at, query, value = candidates(rows, bounds)
        # of those whose window holds enough of the passage's words, the best of each document, passage and stretch of the document
        order = np.argsort(query, kind="stable")
        cuts = np.searchsorted(query[order], np.arange(len(queries) + 1))
        seen: dict[tuple[int, int, int], tuple[float, int]] = {}
        for q in np.flatnonzero(np.diff(cuts)).tolist():
            pick = order[cuts[q] : cuts[q + 1]]
            marks[pieces[q][1]] = latent.idf[pieces[q][1]]
            near = at[pick][:, None] + np.arange(PASSAGE)
            held = (marks[rows[near]] * (near < bounds[doc[pick] + 1][:, None])).sum(1)
            marks[pieces[q][1]] = 0
            for k in pick[held >= enough[q]].tolist():
                key = (int(doc[k]), q, int(at[k]) // PASSAGE)
                if key not in seen or value[k] > seen[key][0]:
                    seen[key] = (float(value[k]), int(at[k]))
        tops: dict[tuple[int, int, int], tuple[float, int]] = {}
        covered: dict[tuple[int, int, int], tuple[float, int]] = {}
        for (d, q, near), (x, place) in seen.items():
            owner, piece = pieces[q]
            item, key = full[owner], (d, owner, near)
            if key not in tops or x > tops[key][0]:
                tops[key] = (x, place)
            if len(piece) < len(item.words) and (key not in covered or x > covered[key][0]) and _covers(rows, int(bounds[d]), int(bounds[d + 1]), place, piece, item):
                covered[key] = (x, place)
        best: dict[tuple[int, int], tuple] = {}
        for key, top in tops.items():
            d, k, _ = key
            words = full[k].words
            x, place = covered.get(key, top)
            a, b = max(int(bounds[d]), place - len(words) - STEP), min(int(bounds[d + 1]), place + PASSAGE + len(words) + STEP)
            near = rows[a:b]
            if key not in covered and full[k].within(set(near.tolist())) < PARTLY * len(words):
                continue
            common = lcs(words, near) / len(words)
            answer = _holds(near, words[-ANSWER:])
            if (key in covered or common >= WHOLE or common >= PARTLY and answer) and ((d, k) not in best or common > best[d, k][1]):
                best[d, k] = (x, common, answer, place - int(bounds[d]))
        return best

    return run


def _covers(rows: np.ndarray, first: int, last: int, place: int, piece: np.ndarray, item: _Item) -> bool:
    """Whether the text at ``place``, of the words ``first`` to ``last``, covers the passage or holds a whole stretch of its item."""
    a, b = max(first, place - PASSAGE), min(last, place + 2 * PASSAGE)
    wide = rows[a:b].tolist()
    if item.within(set(wide)) < COVERED * len(piece):  # a stretch has as many of them, too
        return False
    near = rows[max(first, place - STEP) : min(last, place + PASSAGE + STEP)]
    if lcs(piece, near) >= COVERED * len(piece):
        return True
    run = 0
    for k, x in enumerate(wide):
        run = run + 1 if x in item.kinds else 0
        if run >= PASSAGE and rows[a + k + 1 - PASSAGE : a + k + 1].tobytes() in item.stretches:
            return True
    return False


#: Benchmark rows searched at once; more are searched block by block, in one latent space.
ITEMS = 50_000


def _blocks_of_items(docs: DataFrame, benchmark: DataFrame, text_col: str, item_col: str, item_text: str, at_once: int) -> tuple[Latent, list[list[tuple[int, np.ndarray]]]]:
    """The latent space that holds all benchmark passages, and the benchmark rows in blocks of ``at_once``."""
    numbered = benchmark.where(F.col(item_text).isNotNull() & F.col(item_col).isNotNull()).select(F.col(item_col).cast("long").alias("i"), F.col(item_text).alias("t"))
    rows = numbered.orderBy("i", "t").toArrow()
    items = [(i, w) for i, w in zip(rows.column(0).to_pylist(), words_of(rows.column(1).to_pylist())) if len(w)]
    latent = fit(docs, [p for _, w in items for p in cut_passages(w)], text_col)
    return latent, [items[k : k + at_once] for k in range(0, len(items), at_once)] or [[]]


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", cosine: float = COSINE, items_at_once: int = ITEMS) -> DataFrame:
    """(id_col, item_id long, cosine double, common double, answer boolean, start long): pairs of document and benchmark item that pass the checks.

    ``start`` is the word where the best passage starts, ``common`` the part of the item's words found in order near it.  Null or empty texts and
    items take no part; ids may repeat (a row for each) or be null.  Items with equal texts are all reported.  The driver holds the
    benchmark's texts.  The documents are read once for each block of ``items_at_once`` benchmark rows; the result doesn't depend on it.  Other columns are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    src, out = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("binary").alias("_text")), None
    latent, blocks_ = _blocks_of_items(docs, benchmark, text_col, item_col, item_text, items_at_once)
    for items in blocks_:
        got = src.mapInArrow(_search(latent, items, cosine), f"_id {kind}, item_id long, cosine double, common double, answer boolean, start long")
        out = got if out is None else out.union(got)
    return out.withColumnRenamed("_id", id_col)


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", cosine: float = COSINE, items_at_once: int = ITEMS) -> DataFrame:
    """The rows of ``docs`` whose text holds no leak, columns unchanged; ids play no part.  No shuffle."""
    out = docs
    latent, blocks_ = _blocks_of_items(docs, benchmark, text_col, item_col, item_text, items_at_once)
    for items in blocks_:
        out = out.mapInArrow(_search(latent, items, cosine, text_col, keep=True), docs.schema)
    return out
