"""Toxicity of restored text.

Writers hide words: letters become digits or signs, stand apart, or repeat.  The reader undoes this as a noisy channel.  Each suspicious token
is a lattice of what every character may stand for, and Viterbi decoding finds the likeliest path under a trigram language model of characters,
which is counted over all documents.  A logistic model then scores the restored words and their beginnings.  It is fitted on all labelled rows: tasks count
features and sum what each step of the fit needs.
"""

from __future__ import annotations

import math
import os.path
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, StringType

from ._shared import drop_folder, shared_dir, written
from ._words import Block, blocks, hash_spans, split_words, take

#: Features of the model, and tasks that sum a step of its fit at most (each sends a square matrix of the features).
FEATURES, SUMS = 256, 32
#: Least and most bits of the marks of labelled ids (32 KB to 8 MB), and bits a label.
LEAST_BITS, MOST_BITS, BITS = 1 << 18, 1 << 26, 16
PREFIXES = (4, 5, 6, 7)
SHORTEST = min(PREFIXES)
# What signs may stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l"}
APART = frozenset(".-_*~'/,:;")
#: Those of them that may stand between words, and what a boundary costs; letters that stand apart: a boundary at a gap, at a wider gap, and none at a wider gap.
BETWEEN, BOUNDARY = frozenset(".-_~/,:;"), -0.7
GAP, WIDE, NO_WIDE = -1.0, 0.0, -2.0
_LATIN = [chr(c) for c in (*range(0x61, 0x7B), *range(0xDF, 0xF7), *range(0xF8, 0x100))]
#: Symbols of the language model: 0 stands between words, the last for any other letter.
INDEX = {c: k + 1 for k, c in enumerate(_LATIN)}
SIZE = len(_LATIN) + 2


def _symbol_table() -> np.ndarray:
    table = np.zeros(0x250, np.int64)
    for c in range(0x250):
        if chr(c).isalpha():
            table[c] = INDEX.get(chr(c).lower()[:1], SIZE - 1)
    return table


_TABLE = _symbol_table()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trigram counts of a task's texts; documents are set apart by gaps, and gaps of any length count as one."""
    total = np.zeros(SIZE**3, np.int64)
    for block in blocks(batches, "_text", 2 << 20):
        raw = np.insert(block.data, block.offsets[1:-1], 0x20)
        x = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        s = np.where(x < len(_TABLE), _TABLE[np.minimum(x, len(_TABLE) - 1)], SIZE - 1)
        s = np.concatenate([[0, 0], s, [0]])
        s = s[np.concatenate([[True, True], (s[2:] != 0) | (s[1:-1] != 0)])]
        total += np.bincount(s[:-2] * SIZE * SIZE + s[1:-1] * SIZE + s[2:], minlength=SIZE**3)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["gram", "n"])


def language_model(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Log probabilities (SIZE, SIZE, SIZE) of a symbol after two, from all texts; the counts number SIZE**3 at most."""
    rows = docs.select(F.col(text_col).cast("binary").alias("_text")).mapInArrow(_count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    counts = np.zeros(SIZE**3)
    for r in rows.collect():
        counts[r.gram] = r.n
    c = counts.reshape(SIZE, SIZE, SIZE)
    two, one = c.sum(0), c.sum((0, 1))
    p1 = (one + 1) / (one.sum() + SIZE)
    p2 = (two + 20 * p1) / (two.sum(1, keepdims=True) + 20)
    p3 = (c + 20 * p2[None]) / (c.sum(2, keepdims=True) + 20)
    return np.log(p3).astype(np.float32)


def _place(c: str, n: int) -> list[tuple[str, float]]:
    """What ``n`` times ``c`` may say."""
    if c.isalpha():
        return [(c, 0.0)] if n == 1 else [(c, -0.5), (c + c, -0.2 if n == 2 else -1.0)]
    options = [(a * k, -1.0 * k) for a in LEET.get(c, "") for k in ((1, 2) if n > 1 else (1,))]
    if c in APART or not options:
        options.append(("", -0.7))
    if c in BETWEEN:
        options.append((" ", BOUNDARY))
    return options


def lattice(token: str) -> list[list[tuple[str, float]]]:
    """For each place what it may say, with the channel's log probability: a letter, two of it, nothing, or a boundary of words."""
    return [_place(m[1], len(m[0])) for m in re.finditer(r"(.)\1*", token, re.S)]


def lattice_apart(letters: list[str], wide: list[bool]) -> list[list[tuple[str, float]]]:
    """The same for letters that stand apart; ``wide`` tells of each whether the gap before it is wider than others.  Any gap may be a boundary."""
    out: list[list[tuple[str, float]]] = []
    k = 0
    while k < len(letters):
        c, to = letters[k], k + 1
        while to < len(letters) and letters[to] == c and not wide[to]:
            to += 1
        if k:
            out.append([(" ", WIDE), ("", NO_WIDE)] if wide[k] else [("", 0.0), (" ", GAP)])
        options = _place(c, to - k)
        out.append([*options, (f"{c} {c}", GAP - 0.2)] if to - k > 1 and c.isalpha() else options)
        k = to
    return out


def decode(places: list[list[tuple[str, float]]], model: np.ndarray) -> str:
    """The likeliest reading: Viterbi over the lattice, the state being the last two symbols.  What all paths agree on is put out on the way."""
    states: dict[tuple[int, int], tuple[float, str]] = {(0, 0): (0.0, "")}
    done: list[str] = []
    for k, options in enumerate(places):
        after: dict[tuple[int, int], tuple[float, str]] = {}
        for (a, b), (score, said) in states.items():
            for text, cost in options:
                x, y, total = a, b, score + cost
                for c in text:
                    z = 0 if c == " " else INDEX.get(c, SIZE - 1)
                    total += float(model[x, y, z])
                    x, y = y, z
                if (x, y) not in after or total > after[x, y][0]:
                    after[x, y] = (total, said + text)
        states = after
        if k % 64 == 63:
            same = os.path.commonprefix([said for _, said in states.values()])
            done.append(same)
            states = {at: (score, said[len(same) :]) for at, (score, said) in states.items()}
    last = max(((score + float(model[a, b, 0]), said) for (a, b), (score, said) in states.items()), key=lambda s: (s[0], s[1]))[1]
    return " ".join("".join([*done, last]).split())


def readings(places: list[list[tuple[str, float]]], model: np.ndarray) -> str:
    """The likeliest reading as one word, and the words of the likeliest one with boundaries that differ from it."""
    whole = [[o for o in options if " " not in o[0]] for options in places]
    one = decode([options or [("", 0.0)] for options in whole], model)
    return one if whole == places else " ".join(dict.fromkeys([one, *decode(places, model).split(" ")])).strip()


# every pattern takes time in proportion to the token's length
_EDGE = re.compile(r"^[\W_]++|(?<![\W_])[\W_]++$")
_ODD = re.compile(r"[^\W\d_][\d@$!|+(€£._*~'/,:;-]+[^\W_]|(?<![\d@$!|+(€£._*~-])[._*~-]*+[\d@$!|+(€£][\d@$!|+(€£._*~-]*+[^\W\d_]|(.)\1\1")
_FRONT = re.compile(r"^[^\w@$!|+(€£]+")
_THRICE = re.compile(r"(.)\1\1")


def restore(token: str, model: np.ndarray) -> str:
    """A token in lower case without signs at its ends, and decoded where it looks disguised, which may give several words."""
    low = token.lower()
    if low.isalpha() and not _THRICE.search(low):
        return low  # most words: no sign or digit that the patterns below could find
    plain = _EDGE.sub("", low)
    if not _ODD.search(low):
        return plain
    bare = _FRONT.sub("", low)
    n = len(bare)
    while n and not (bare[n - 1].isalnum() or bare[n - 1] in "@$!|+€£" and not bare.endswith((bare[n - 1] * 2, "!", "|", "+"), 0, n)):
        n -= 1
    bare = bare[:n]
    return readings(lattice(bare), model) if _ODD.search(bare) else plain


def features_of(said: str) -> list[str]:
    return [f for word in said.split(" ") if len(word) > 1 for f in (word, *(word[:k] + "~" for k in PREFIXES if len(word) > k))]


#: Bytes of a character of UTF-8 by its first one.
_WIDTH = np.array([1] * 0xC0 + [2] * 0x20 + [3] * 0x10 + [4] * 0x10)


def _distinct_words(block: Block, model: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(restored distinct words, the place among them of every word, the document of every word); letters that stand apart, three or more in a
    row, also give the words that they spell."""
    starts, ends, bounds = split_words(block)
    doc = np.repeat(np.arange(len(block)), np.diff(bounds))
    _, first, inverse = np.unique(hash_spans(block.data, starts, ends), return_index=True, return_inverse=True)
    raw = block.data.tobytes()
    words = [restore(raw[s:e].decode("utf-8", "replace"), model) for s, e in zip(starts[first].tolist(), ends[first].tolist())]
    single = ends - starts == (_WIDTH[block.data[starts]] if len(starts) else 0)
    if single.any():
        edge = np.diff(np.concatenate([[0], single.astype(np.int8), [0]]))
        at, to = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        more: list[tuple[int, int]] = []
        for a, b in zip(at[to - at >= 3].tolist(), to[to - at >= 3].tolist()):
            while a < b:
                c = min(b, int(bounds[doc[a] + 1]))
                if c - a >= 3:
                    letters = [x[:1] for x in (raw[starts[k] : ends[k]].decode("utf-8", "replace").lower() for k in range(a, c))]
                    gaps = starts[a + 1 : c] - ends[a : c - 1]
                    for said in readings(lattice_apart(letters, [False, *(gaps > gaps.min()).tolist()]), model).split(" "):
                        words.append(said)
                        more.append((len(words) - 1, int(doc[a])))
                a = c
        if more:
            inverse = np.concatenate([inverse, [x for x, _ in more]])
            doc = np.concatenate([doc, [x for _, x in more]])
    return words, inverse, doc


def _found(block: Block, model: np.ndarray, names: dict[str, int], fronts: set[str]) -> tuple[np.ndarray, np.ndarray]:
    """(document, feature) of each occurrence of the features ``names``, whose first characters are ``fronts``."""
    words, inverse, doc = _distinct_words(block, model)
    at, to = [], []
    for k, w in enumerate(words):
        if w[:SHORTEST] in fronts or " " in w:
            for f in features_of(w):
                if (j := names.get(f)) is not None:
                    at.append(k)
                    to.append(j)
    if not at:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.argsort(inverse, kind="stable")
    left = np.searchsorted(inverse[order], at, "left")
    n = np.searchsorted(inverse[order], at, "right") - left
    places = order[np.repeat(left - (np.cumsum(n) - n), n) + np.arange(n.sum())]
    return doc[places], np.repeat(to, n)


def _fronts(names: dict[str, int]) -> set[str]:
    """What a word begins with if it has one of the features."""
    return {f[:SHORTEST] for f in names}


def _counts(block: Block, model: np.ndarray, names: dict[str, int]) -> np.ndarray:
    """Documents x features: how often each occurs."""
    out = np.zeros((len(block), len(names)), np.float64)
    np.add.at(out, _found(block, model, names, _fronts(names)), 1)
    return out


def _tally(model: np.ndarray):
    """In how many documents each feature occurs."""

    def rows(held: dict[str, int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["feature", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = {}
        for block in blocks(batches, "_text", 1 << 20):
            words, inverse, doc = _distinct_words(block, model)
            # the features of each distinct word, then those of each document without repeats
            place: dict[str, int] = {}
            own = [[place.setdefault(f, len(place)) for f in features_of(w)] for w in words]
            size = np.array([len(x) for x in own], np.int64)
            flat = np.array([x for y in own for x in y], np.int64)
            first = np.cumsum(size) - size
            pairs = np.unique(doc.astype(np.int64) * max(1, len(words)) + inverse)
            doc, word = np.divmod(pairs, max(1, len(words)))
            n = size[word]
            at = flat[np.repeat(first[word] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            counts = np.bincount(np.unique(np.repeat(doc, n) * max(1, len(place)) + at) % max(1, len(place)), minlength=len(place))
            for f, c in zip(place, counts.tolist()):
                held[f] = held.get(f, 0) + c
            if len(held) > 300_000:
                yield rows(held)
                held = {}
        yield rows(held)

    return run


def _tally_of(model: np.ndarray, features: list[str]):
    """The same of given features alone."""
    names = {f: k for k, f in enumerate(features)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, fronts = np.zeros(len(names), np.int64), _fronts(names)
        for block in blocks(batches, "_text", 1 << 20):
            doc, at = _found(block, model, names, fronts)
            total += np.bincount(np.unique(doc.astype(np.int64) * max(1, len(names)) + at) % max(1, len(names)), minlength=len(names))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([features[k] for k in some.tolist()], pa.string()), pa.array(total[some])], names=["feature", "n"])

    return run


def _matrix(model: np.ndarray, names: dict[str, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "_text", 2 << 20):
            yield pa.RecordBatch.from_arrays([*take(block, ["_k", "_y"]), pa.array([row.astype(np.float32).tobytes() for row in _counts(block, model, names)], pa.binary())], names=["_k", "_y", "row"])

    return run


def _design(counts: np.ndarray, evidence: np.ndarray) -> np.ndarray:
    """Columns of the logistic model: each feature's damped count, and the sum and the largest of the evidence (log ratios) that a text has.

    The last two pool features, so a word that few training rows hold still counts as much as its ratio says.
    """
    x = np.log1p(counts)
    if not counts.shape[1]:
        return x
    return np.hstack([x, (x @ evidence)[:, None], np.where(counts > 0, evidence, 0.0).max(1)[:, None]])


def _sums(x: np.ndarray, yes: np.ndarray, n: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows that stand for ``n`` each, ``yes`` of them positive: gradient and square matrix of a step, without the ridge; the constant is the last column."""
    x = np.hstack([x, np.ones((len(x), 1))])
    p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
    return x.T @ (yes - n * p), (x * (n * (p * (1 - p) + 1e-9))[:, None]).T @ x


def _newton(sums, width: int, ridge: float = 1.0, steps: int = 30) -> np.ndarray:
    """Weights, the constant last, by iterated weighted least squares; ``sums`` gives those of all rows at given weights."""
    w, eye = np.zeros(width + 1), np.eye(width + 1) * ridge
    eye[-1, -1] = 1e-6
    for _ in range(steps):
        g, h = sums(w)
        step = np.linalg.solve(h + eye, g - eye @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30) -> np.ndarray:
    """The same of rows that are at hand."""
    return _newton(lambda w: _sums(x, y, np.ones(len(y)), w), x.shape[1], ridge, steps)


def _step(evidence: np.ndarray, w: np.ndarray):
    """A task's sums, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, h = np.zeros(len(w)), np.zeros((len(w), len(w)))
        for batch in batches:
            if batch.num_rows:
                counts = np.array([np.frombuffer(r, np.float32) for r in batch.column(0).to_pylist()], np.float64).reshape(batch.num_rows, len(evidence))
                more = _sums(_design(counts, evidence), *(batch.column(k).to_numpy().astype(np.float64) for k in (1, 2)), w)
                g, h = g + more[0], h + more[1]
        yield pa.RecordBatch.from_arrays([pa.array([g.tobytes()], pa.binary()), pa.array([h.tobytes()], pa.binary())], names=["g", "h"])

    return run


def remainder(id_col: str) -> Column:
    """crc32(id as text) mod 3; rows where it is 1 are never learnt from."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(3))


def labelled_texts(docs: DataFrame, chosen: DataFrame, n: int) -> DataFrame:
    """(_k, _y, _text): the rows of ``docs`` (_k, _text) whose id is one of the ``n`` of ``chosen`` (_k, _y).

    The join deals texts to where labels are, at any size alike.  Before it, texts whose id has no mark in a bitmap of hashed ids stay where they are: an
    unlabelled id that shares a mark costs work, never a wrong row.
    """
    kind = chosen.schema["_k"].dataType
    if kind == docs.schema["_k"].dataType and isinstance(kind, (IntegralType, StringType)):
        bits = min(max(1 << max(0, BITS * n - 1).bit_length(), LEAST_BITS), MOST_BITS)
        mark = F.pmod(F.xxhash64("_k"), F.lit(bits))
        part, bit = F.bitmap_bucket_number(mark).alias("_part"), F.bitmap_bit_position(mark).alias("_bit")
        marks = chosen.groupBy(part).agg(F.bitmap_construct_agg(bit).alias("_marks"))
        marked = F.expr("getbit(cast(conv(hex(substring(_marks, cast(_bit div 8 AS int) + 1, 1)), 16, 10) AS long), cast(_bit % 8 AS int)) = 1")
        docs = docs.select("*", part, bit).join(F.broadcast(marks), "_part").where(marked).select("_k", "_text")
    return docs.join(chosen.hint("shuffle_hash"), "_k").select("_k", "_y", "_text")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[np.ndarray, dict[str, int], np.ndarray, np.ndarray]:
    """(language model, features, their evidence, weights), from all labelled rows."""
    model, folder = language_model(docs, text_col), shared_dir(docs.sparkSession)
    chosen = labels.where(F.col("toxic").isNotNull() & F.col(id_col).isNotNull() & (remainder(id_col) != 1)).select(F.col(id_col).alias("_k"), F.col("toxic").cast("int").alias("_y"))
    chosen = written(chosen.groupBy("_k").agg(F.max("_y").alias("_y")), folder, "labels")
    kind = docs.schema[id_col].dataType.simpleString()
    size = {bool(r["_y"]): r["n"] for r in chosen.groupBy((F.col("_y") != 0).alias("_y")).agg(F.count("*").alias("n")).collect()}
    t, o = size.get(True, 0), size.get(False, 0)
    if not t or not o:
        return model, {}, np.zeros(0), np.array([-3.0 if not t else 3.0])
    # labelled texts are read three times
    rows = written(labelled_texts(docs.select(F.col(id_col).alias("_k"), F.col(text_col).cast("binary").alias("_text")), chosen, t + o), folder, "labelled")
    # what too few toxic documents hold is never a feature, so it isn't counted in the others
    tally = rows.where("_y > 0").select("_text").mapInArrow(_tally(model), "feature string, n long").groupBy("feature").agg(F.sum("n").alias("a"))
    tally = written(tally.where(F.col("a") >= max(4, math.ceil(t / 500))), folder, "common")
    common = [r.feature for r in tally.select("feature").orderBy("feature").collect()]
    rest = rows.where("_y <= 0").select("_text").mapInArrow(_tally_of(model, common), "feature string, n long").groupBy("feature").agg(F.sum("n").alias("b"))
    tally = tally.join(rest, "feature", "left").fillna(0, "b")
    rate = F.col("a") / t / ((F.col("b") + 0.5) / o)
    gain = F.col("a") * F.log(rate)
    tally = tally.withColumn("evidence", F.log(rate))
    best = tally.where(rate >= 2.5).orderBy(F.desc(gain), "feature").limit(FEATURES).collect()
    names, evidence = {r.feature: k for k, r in enumerate(best)}, np.array([r.evidence for r in best])
    # one row an id, however many rows an id has; equal rows are one with its counts
    each = rows.mapInArrow(_matrix(model, names), f"_k {kind}, _y int, row binary").groupBy("_k").agg(F.max("_y").alias("_y"), F.min("row").alias("row"))
    each = each.groupBy("row").agg(F.sum((F.col("_y") > 0).cast("int")).alias("yes"), F.count("*").alias("n"))
    each = written(each.coalesce(SUMS), folder, "rows").coalesce(SUMS)
    drop_folder(docs.sparkSession, f"{folder}/labelled")

    def sums(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        got = each.mapInArrow(_step(evidence, w), "g binary, h binary").collect()
        g, h = (sum((np.frombuffer(r[k]) for r in got), np.zeros(len(w) ** (k + 1))) for k in (0, 1))
        return g, h.reshape(len(w), len(w))

    width = len(names) + 2 if names else 0
    return model, names, evidence, _newton(sums, width)


def _probability(block: Block, model: np.ndarray, names: dict[str, int], evidence: np.ndarray, weights: np.ndarray) -> np.ndarray:
    z = _design(_counts(block, model, names), evidence) @ weights[:-1] + weights[-1]
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _scores(*fitted):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "_text", 2 << 20):
            yield pa.RecordBatch.from_arrays([*block.rows.columns[:-1], pa.array(_probability(block, *fitted))], names=[*block.rows.schema.names[:-1], "_score"])

    return run


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, score double), one row per row of ``docs``; the text alone decides the score.

    ``labels`` has id_col and ``toxic``; rows with a null in either, or whose id's crc32 leaves 1 modulo 3, aren't learnt from; of several labels of an id the
    largest counts, and of several texts of an id one is fitted.  Null text counts as empty; texts without words get the constant's score.  Without labels of both kinds all scores are alike.
    Other columns are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    src = docs.select(F.col(id_col).alias("_own"), F.col(text_col).cast("binary").alias("_text"))
    return src.mapInArrow(_scores(*fit(docs, labels, id_col, text_col)), f"_own {kind}, _score double").select(F.col("_own").alias(id_col), F.col("_score").alias("score"))


def keep_clean(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.7) -> DataFrame:
    """The rows of ``docs``, columns unchanged, whose score is under ``least``."""
    fitted = fit(docs, labels, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, text_col, 2 << 20):
            yield block.rows.filter(pa.array(_probability(block, *fitted) < least))

    return docs.mapInArrow(run, docs.schema)
