"""Spelling variants: a trie self-join with active-node sets over the vocabulary, its trie dealt out by prefixes.

Two words one edit apart differ at one place.  From the fourth code point on, they share the first three, and both lie in the
subtrie of that prefix.  Before it, they share all but their first code points, and both lie in one subtrie of the trie of the reversed words,
whose prefix is that shared end.  So each word goes to one subtrie forwards and to two backwards (as the shorter or equal word of a pair and as the
longer one).  A task builds one subtrie at a time and walks it with the set of active nodes, those at distance one from the node at hand: the node
above, those beside, those below, and the active nodes' children by the same character.  Terminal nodes among the active ones are pairs.

A subtrie of more than ``most`` words isn't built: joins settle the edits at its two upper levels, on the word without the code point at
that place, and its grandchildren are dealt out as subtries of their own, until none is too large.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import drop_folder, shared_dir, written
from ._words import Block, blocks, give_back, hash_spans, split_words, take

#: Code points that forward subtries share.
PREFIX = 3
#: Words of the largest subtrie that a task builds.
MOST = 4096
#: One run in so many loses a code point.
EVERY = 31
#: Bytes of a run whose checksum is put together from tables.
_TABLED = 64
_FLUSH = 400_000


@lru_cache(1)
def _shifts() -> np.ndarray:
    """What ``n`` further bytes make of each byte of a checksum (n, byte's place, its value)."""
    out = np.zeros((_TABLED + 1, 4, 256), np.uint32)
    for n in range(_TABLED + 1):
        zeros = bytes(n)
        rest = zlib.crc32(zeros)
        out[n] = [[zlib.crc32(zeros, value << 8 * place) ^ rest for value in range(256)] for place in range(4)]
    return out


def checksums(before: np.ndarray, runs: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """crc32 of texts of which the first part has the checksum ``before`` and the second one, of ``lengths`` bytes, ``runs``."""
    table = _shifts()
    out = runs.copy()
    for place in range(4):
        out ^= table[lengths, place, before >> np.uint32(8 * place) & np.uint32(255)]
    return out


def without(run: bytes, at: int) -> bytes:
    """``run`` less its code point number ``at``."""
    text = run.decode()
    return (text[:at] + text[at + 1 :]).encode()


def block_words(block: Block, ids: list[str | None], least: int) -> Counter:
    """Uses of each word of a block."""
    data = block.data
    low = data | np.uint8(0x20)
    letter = (low - np.uint8(0x61) < 26) | (data == 0xC3)
    letter[1:] |= data[:-1] == 0xC3  # U+00C0 to U+00FF: 0xC3 and one more byte
    data = np.where(letter, np.where(data < 0x80, low, data), np.uint8(0x20))
    starts, ends, bounds = split_words(Block(block.rows, data, block.offsets))
    if not len(starts):
        return Counter()
    pairs = np.concatenate([[0], np.cumsum(data == 0xC3)])
    row, size, points = np.repeat(np.arange(len(block)), np.diff(bounds)), ends - starts, ends - starts - pairs[ends] + pairs[starts]
    keep = np.flatnonzero(points >= least)
    hashes = hash_spans(data, starts, ends)[keep]
    starts, size, points, row = starts[keep], size[keep], points[keep], row[keep]
    raw = data.tobytes()
    _, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
    words = [raw[s : s + n] for s, n in zip(starts[first].tolist(), size[first].tolist())]
    heads = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in ids], np.uint32)[row]
    sums = checksums(heads, np.array([zlib.crc32(w) for w in words], np.uint32)[inverse], np.minimum(size, _TABLED))
    for k in np.flatnonzero(size > _TABLED).tolist():
        sums[k] = zlib.crc32(words[inverse[k]], int(heads[k]))
    cut = sums % EVERY == 0
    out = Counter(without(words[inverse[k]], int(sums[k] % points[k])) for k in np.flatnonzero(cut & (points > least)).tolist())
    for w, n in zip(words, np.bincount(inverse[~cut], minlength=len(words)).tolist()):
        if n:
            out[w] += n
    return out


def _words(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

        held: Counter = Counter()
        for block in blocks(batches, "_text", 4 << 20):
            held.update(block_words(block, take(block, ["_id"])[0].to_pylist(), least))
            if len(held) > _FLUSH:
                yield rows()
                held = Counter()
        if held:
            yield rows()
        del held
        give_back()

    return run


def subtrie_pairs(words: Iterable[str], depth: int) -> Iterator[tuple[int, int]]:
    """Places of the pairs of distinct ``words`` one edit apart, which share their first ``depth`` code points."""
    root: dict = {}  # children by character; "" has a terminal's place
    for place, word in enumerate(words):
        node = root
        for c in word[depth:]:
            node = node.setdefault(c, {})
        node[""] = place
    if "" in root:  # the prefix itself is a word: it is active for the nodes below
        own = root[""]
        yield from ((own, n[""]) for c, n in root.items() if c and "" in n and own < n[""])
    todo = [(root, [n for c, n in root.items() if c])]
    while todo:
        above, near = todo.pop()
        for c, node in above.items():
            if not c:
                continue
            active = {id(above): above}
            active.update((id(n), n) for x, n in above.items() if x and x != c)
            active.update((id(n), n) for x, n in node.items() if x)
            active.update((id(n), n) for v in near if (n := v.get(c)) is not None and n is not node)
            if "" in node:
                own = node[""]
                yield from ((own, n[""]) for n in active.values() if "" in n and own < n[""])
            if len(node) > ("" in node):
                todo.append((node, list(active.values())))


def _subtries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of each subtrie of sorted rows (back, key, depth, w, n)."""

    def rows() -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns))

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held), kinds)], names=["a", "an", "b", "bn"])

    kinds, held = (pa.string(), pa.int64(), pa.string(), pa.int64()), []
    for (back, _, depth), group in groupby(rows(), key=lambda r: r[:3]):
        own = [(w, n) for *_, w, n in group]
        for i, j in subtrie_pairs((w for w, _ in own), depth):
            (a, an), (b, bn) = own[i], own[j]
            if back:
                a, b = a[::-1], b[::-1]
            held.append((a, an, b, bn) if a < b else (b, bn, a, an))
        if len(held) > 50_000:
            yield out()
            held = []
    if held:
        yield out()


def near_pairs(words: DataFrame, folder: str, prefix: int = PREFIX, most: int = MOST) -> DataFrame:
    """(a, an, b, bn) for all pairs a < b of ``words`` (word string, n long; distinct, more than 2 ``prefix`` code points each) one insertion, deletion or replacement of a code point apart."""
    size, back = F.length("word"), F.reverse("word")
    rows = words.select(F.lit(False).alias("back"), F.lit(prefix).alias("depth"), F.col("word").alias("w"), "n")
    for less in (0, 1):  # the word as the shorter or an equal one, and as the longer one
        rows = rows.union(words.select(F.lit(True), size - prefix - less, back, "n"))
    found, level = [], 0
    while True:
        rows = rows.withColumn("key", F.expr("substring(w, 1, depth)"))
        groups = written(rows.groupBy("back", "key", "depth").agg(F.count("*").alias("words")).where("words > 1"), folder, f"subtries{level}")
        dealt = rows.join(groups.where(f"words <= {most}"), ["back", "key", "depth"]).select("back", "key", "depth", "w", "n")
        dealt = dealt.repartition("back", "key", "depth").sortWithinPartitions("back", "key", "depth").mapInArrow(_subtries, "a string, an long, b string, bn long")
        found.append(written(dealt, folder, f"pairs{level}"))
        large = groups.where(f"words > {most}").drop("words")
        if large.isEmpty():
            break
        rows = written(rows.join(large, ["back", "key", "depth"]).select("back", "depth", "w", "n"), folder, f"large{level}")
        found.append(written(_upper_levels(rows), folder, f"upper{level}"))
        rows, level = rows.withColumn("depth", F.col("depth") + 2), level + 1
    out = found[0]
    for x in found[1:]:
        out = out.union(x)
    return out


def _upper_levels(rows: DataFrame) -> DataFrame:
    """Pairs that differ first at their subtrie's depth or one place below.  Words that share a key differ at its mark alone, so a key has no more words than there are letters, and one."""
    at = rows.select("back", "w", "n", F.explode(F.array(F.col("depth"), F.col("depth") + 1)).alias("at"))
    cut = at.where("length(w) > at").selectExpr("back", "at", "concat(substring(w, 1, at), '|', substring(w, at + 2)) as mark", "w", "n")
    whole = at.selectExpr("back", "at", "concat(substring(w, 1, at), '|', substring(w, at + 1)) as mark", "w", "n")
    other = cut.withColumn("cut", F.lit(True)).union(whole.withColumn("cut", F.lit(False))).select("back", "at", "mark", "cut", F.col("w").alias("v"), F.col("n").alias("vn"))
    both = cut.join(other, ["back", "at", "mark"]).where("not cut or w < v")
    side = lambda word, n: F.struct(F.when(F.col("back"), F.reverse(word)).otherwise(F.col(word)).alias("word"), F.col(n).alias("n"))
    both = both.select(F.least(side("w", "n"), side("v", "vn")).alias("x"), F.greatest(side("w", "n"), side("v", "vn")).alias("y"))
    return both.selectExpr("x.word as a", "x.n as an", "y.word as b", "y.n as bn")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 7, uses: int = 2, times: int = 10, most: int = MOST) -> DataFrame:
    """(word, form, root string, n, n_near, form_n long), one row a word.

    Words: runs of A-Z, a-z and U+00C0-U+00FF with A-Z in lower case; where 31 divides crc32 h of ``<id>:<run>``, the run's code point h % length is
    deleted.  Those of ``least`` code points or more that occur ``uses`` times or more in all texts count.  ``form``: of the words one edit
    away the most frequent (then the smallest), if used ``times`` as often or more; ``root``: where forms lead, or the word; ``n_near``: words one edit away.
    Null text has no words.  A null id reads as an empty one; rows of one id and text are alike and each count.  Other columns are not read, an empty table gives no rows.
    """
    spark, folder = docs.sparkSession, shared_dir(docs.sparkSession)
    if least < 2 * PREFIX + 1:
        raise ValueError(f"least must be {2 * PREFIX + 1} or more")
    src = docs.select(F.col(id_col).cast("string").alias("_id"), F.col(text_col).cast("binary").alias("_text"))
    words = src.mapInArrow(_words(least), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= uses)
    words = written(words.select(F.col("word").cast("string").alias("word"), "n"), folder, "vocabulary")
    pairs = near_pairs(words, folder, most=most)
    pairs = pairs.groupBy("a", "b").agg(F.first("an").alias("an"), F.first("bn").alias("bn"))  # some are found twice
    sides = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("word"), F.struct((-F.col("bn")).alias("less"), F.col("b").alias("form")).alias("other")), F.struct(F.col("b").alias("word"), F.struct((-F.col("an")).alias("less"), F.col("a").alias("form")).alias("other")))).alias("s"))
    near = sides.groupBy("s.word").agg(F.count("*").alias("n_near"), F.min("s.other").alias("best"))
    known = F.expr(f"-best.less >= {times} * n")
    own = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(known, F.col("best.form")).alias("form"), F.when(known, -F.col("best.less")).alias("form_n"))
    own = written(own, folder, "forms")
    # each step leads to a word used ``times`` as often, which bounds a path; doubling takes its logarithm of joins
    most_used = words.agg(F.max("n")).first()[0] or 1
    steps = max(1, math.floor(math.log(max(1, most_used / uses), times) + 1e-9))
    to = written(own.where("form is not null").select("word", F.col("form").alias("to")), folder, "to0")
    for k in range(1, 1 + math.ceil(math.log2(steps))):
        then = to.select(F.col("word").alias("to"), F.col("to").alias("then"))
        to = written(to.join(then, "to", "left").select("word", F.coalesce("then", "to").alias("to")), folder, f"to{k}")
        drop_folder(spark, f"{folder}/to{k - 1}")
    return own.join(to, "word", "left").select("word", "form", F.coalesce("to", "word").alias("root"), "n", "n_near", "form_n")


def variants_sql(least: int = 7, uses: int = 2, times: int = 10) -> str:
    """The same in SQL for DuckDB; crc32 goes byte by byte through a table that is made from its polynomial."""
    lower = "".join(map(chr, range(0x61, 0x7B)))
    return f"""
WITH RECURSIVE crc AS (SELECT list(v ORDER BY b) AS t FROM (SELECT b, list_reduce(list_prepend(b, [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
  FROM (SELECT unnest(range(256)) AS b))),
runs AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS r FROM documents),
own AS (SELECT doc_id, translate(r, '{lower.upper()}', '{lower}') AS r, count(*) AS n FROM runs GROUP BY ALL),
bytes AS (SELECT r, n, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || r)) AS x FROM own WHERE length(r) >= {least}),
sums AS (SELECT r, n, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(len(x) // 2), lambda i: ('0x' || x[2 * i + 1:2 * i + 2])::BIGINT)),
  lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM bytes, crc),
made AS (SELECT CASE WHEN h % {EVERY} = 0 THEN left(r, (h % length(r))::INT) || substr(r, (h % length(r))::INT + 2) ELSE r END AS word, n FROM sums),
words AS (SELECT word, sum(n)::BIGINT AS n FROM made WHERE length(word) >= {least} GROUP BY word HAVING sum(n) >= {uses}),
places AS (SELECT word, n, unnest(range(length(word))) AS i FROM words),
cut AS (SELECT word, n, i, left(word, i) AS head, substr(word, i + 2) AS tail FROM places),
links AS (SELECT a.word, b.word AS other, b.n FROM cut a JOIN cut b USING (i, head, tail) WHERE a.word <> b.word
  UNION SELECT c.word, w.word, w.n FROM cut c JOIN words w ON w.word = c.head || c.tail
  UNION SELECT w.word, c.word, c.n FROM cut c JOIN words w ON w.word = c.head || c.tail),
best AS (SELECT word, count(*) AS n_near, arg_min(other, (-n, other)) AS form, max(n) AS form_n FROM links GROUP BY word),
forms AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= {times} * w.n THEN form END AS form, CASE WHEN form_n >= {times} * w.n THEN form_n END AS form_n FROM words w LEFT JOIN best USING (word)),
walk AS (SELECT word, word AS at, form AS then FROM forms UNION ALL SELECT walk.word, f.word, f.form FROM walk JOIN forms f ON f.word = walk.then)
SELECT f.word, f.form, walk.at AS root, f.n, f.n_near, f.form_n FROM forms f JOIN walk ON walk.word = f.word WHERE walk.then IS NULL"""
