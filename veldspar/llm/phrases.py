"""Phrase collocations with PCY/DHP hashing and Apriori pruning.

Phrases of one to four words are counted exactly, a length in each pass over the texts.  While a pass counts the phrases of
its length, it counts the phrases of the next length into buckets by hash (only those whose two parts it counts, which is DHP's pruning);
a phrase that is frequent lies in a bucket that is.  The next pass counts a phrase only if its bucket is frequent (PCY) and both its
parts are frequent (Apriori).  Both facts reach the tasks as bitmaps over the buckets, whose size is fixed by a parameter and
not by the corpus; that two phrases share a bucket costs work and never changes a count, which a grouped sum of the phrases themselves gives.

Each pass writes what its tasks have counted to the shared folder: one row for each distinct phrase of a task and one for each
section of its buckets.  Bucket sections are added up in two steps, so that no task reads all tasks' counts of a section at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import drop_folder, shared_dir, written
from ._words import Block, blocks, give_back, hash_spans, mix, rolling, split_words, take
from .bpe import gather

#: Buckets of one section, a row of counts.
SECTION = 1 << 16
#: Least and most buckets where their number isn't given: a bitmap has 128 KB to 8 MB.
BUCKETS = 1 << 20, 1 << 26
#: Distinct phrases that a task holds before it writes them.
_FLUSH = 500_000
#: Salts of the first of two rankings; groups of tasks whose bucket counts are added first.
_SALTS, _SPREAD = 16, 16

# Byte by byte: A-Z in lower case, tab as space, ends of pieces as line feed.
_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[0x41:0x5B] += 0x20
_PLAIN[9] = 0x20
_PLAIN[[*b".,;:!?\x0b\x0c\x0d"]] = 10


class Text:
    """The words of a block: hashes, rows and pieces."""

    def __init__(self, block: Block):
        self.data = _PLAIN[block.data]
        self.starts, self.ends, bounds = split_words(Block(block.rows, self.data, block.offsets))
        self.row = np.repeat(np.arange(len(block)), np.diff(bounds))
        self.piece = np.cumsum(self.data == 10)[self.starts] + self.row if len(self.starts) else self.row
        self.hashes = hash_spans(self.data, self.starts, self.ends)
        self.lang = take(block, ["_lh"])[0].to_numpy(zero_copy_only=False).view(np.uint64)

    def keys(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The key of the ``k`` words from each word on, and whether they lie in one piece."""
        n = max(0, len(self.hashes) - k + 1)
        return mix(rolling(self.hashes, k) ^ self.lang[self.row[:n]]), self.piece[:n] == self.piece[k - 1 :][:n]

    def spell(self, first: np.ndarray, k: int) -> pa.Array:
        """The ``k`` words from each of these words on, joined by a space."""
        w = (first[:, None] + np.arange(k)).ravel()
        n = self.ends[w] - self.starts[w]
        to = np.cumsum(n + 1)
        out = np.full(int(to[-1]) if len(to) else 0, 0x20, np.uint8)
        out[np.arange(int(n.sum())) + np.repeat(np.arange(len(w)), n)] = gather(self.data, self.starts[w], n)
        last = to[k - 1 :: k]
        out = np.delete(out, last - 1)
        off = np.concatenate([[0], last - np.arange(1, len(first) + 1)]).astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(off), pa.py_buffer(out)])


class Buckets:
    """Counts by bucket, held at ``least``."""

    def __init__(self, buckets: int, least: int):
        self.shift, self.least = np.uint64(64 - (buckets.bit_length() - 1)), least
        self.counts = np.zeros(buckets, np.uint8 if least < 256 else np.uint32)

    def add(self, keys: np.ndarray) -> None:
        at, n = np.unique(keys >> self.shift, return_counts=True)
        self.counts[at] = np.minimum(self.counts[at] + n, self.least)

    def sections(self) -> Iterator[tuple[int, bytes]]:
        for k in range(0, len(self.counts), SECTION):
            if (x := self.counts[k : k + SECTION]).any():
                yield k // SECTION, x.tobytes()


def _has(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether the bit of each key's bucket is set."""
    at = (keys >> np.uint64(64 - (len(bits).bit_length() + 2))).astype(np.int64)
    return bits[at >> 3] >> (at & 7).astype(np.uint8) & 1 > 0


_COUNTS = "lang string, phrase binary, n long, section int, counts binary"


def _counted(held: list) -> pa.RecordBatch:
    keys, lang, phrase, n = np.concatenate([x[0] for x in held]), pa.concat_arrays([x[1] for x in held]), pa.concat_arrays([x[2] for x in held]), np.concatenate([x[3] for x in held])
    _, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
    cols = [lang.take(pa.array(first)), phrase.take(pa.array(first)), pa.array(np.bincount(inverse, n).astype(np.int64))]
    return pa.RecordBatch.from_arrays([*cols, pa.nulls(len(first), pa.int32()), pa.nulls(len(first), pa.binary())], names=["lang", "phrase", "n", "section", "counts"])


def _summed(sections: Iterator[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
    for k, x in sections:
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.string()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.int64()), pa.array([k], pa.int32()), pa.array([x], pa.binary())], names=["lang", "phrase", "n", "section", "counts"])


def _pass(k: int, least: int, buckets: int, maps, following: bool):
    """Count the phrases of ``k`` words, and into buckets those of one more.  ``maps``: bitmaps of the frequent buckets of this length and of the frequent phrases one word shorter.

    The first pass gives the number of words of a language too, with null for the phrase.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        likely, shorter = maps.value if maps else (None, None)
        after, held, size = Buckets(buckets, least), [], 0
        for block in blocks(batches, "_text", 4 << 20):
            text = Text(block)
            langs = take(block, ["_lang"])[0]
            keys, ok = text.keys(k)
            if maps:
                before = _has(shorter, text.keys(k - 1)[0])
                ok &= before[:-1][: len(ok)] & before[1:][: len(ok)]
                at = np.flatnonzero(ok)
                ok[at] = _has(likely, keys[at])
            at = np.flatnonzero(ok)
            got, first, n = np.unique(keys[at], return_index=True, return_counts=True)
            first = at[first]
            if len(got):
                held.append((got, langs.take(pa.array(text.row[first])), text.spell(first, k), n))
                size += len(got)
            if following:
                keys, whole = text.keys(k + 1)
                after.add(keys[whole & ok[:-1][: len(whole)] & ok[1:][: len(whole)]])
            if k == 1 and len(text.row):
                rows, n = np.unique(text.row, return_counts=True)
                yield pa.RecordBatch.from_arrays([langs.take(pa.array(rows)), pa.nulls(len(rows), pa.binary()), pa.array(n), pa.nulls(len(rows), pa.int32()), pa.nulls(len(rows), pa.binary())], names=["lang", "phrase", "n", "section", "counts"])
            if size > _FLUSH:
                yield _counted(held)
                held, size = [], 0
        if held:
            yield _counted(held)
        yield from _summed(after.sections())
        del after, held
        give_back()

    return run


def _marks(k: int, least: int, buckets: int):
    """The buckets of given phrases of ``k`` words, as counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Buckets(buckets, least)
        for block in blocks(batches, "_text", 4 << 20):
            out.counts[(Text(block).keys(k)[0][::k] >> out.shift).astype(np.int64)] = least
        yield from _summed(out.sections())

    return run


def _merge(least: int, bits: bool):
    """Add up counts by section (and part): a task holds one array for each of its sections."""
    kind = np.uint8 if least < 256 else np.uint32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for part, section, x in zip(*(c.to_pylist() for c in batch.columns)):
                x = np.frombuffer(x, kind)
                have = sums.get((part, section))
                sums[part, section] = x if have is None else np.minimum(have.astype(np.int64) + x, least).astype(kind)
        for (part, section), x in sums.items():
            raw = np.packbits(x >= least, bitorder="little") if bits else x
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([section], pa.int32()), pa.array([raw.tobytes()], pa.binary())], names=["part", "section", "counts"])

    return run


def _bitmap(sections: DataFrame, least: int, buckets: int) -> np.ndarray:
    """A bit for each bucket that counts ``least`` over all tasks.  The driver gets ``buckets`` / 8 bytes at most."""
    rows = sections.select((F.spark_partition_id() % _SPREAD).alias("part"), "section", "counts")
    some = rows.repartition("part", "section").mapInArrow(_merge(least, False), "part int, section int, counts binary")
    whole = some.select(F.lit(0).alias("part"), "section", "counts").repartition("section").mapInArrow(_merge(least, True), "part int, section int, counts binary")
    out = np.zeros(buckets // 8, np.uint8)
    for r in whole.collect():
        x = np.frombuffer(r.counts, np.uint8)
        out[r.section * (SECTION // 8) :][: len(x)] = x
    return out


def _buckets_for(docs: DataFrame) -> int:
    """A bucket for each 64 bytes of the scan, within ``BUCKETS``, as a power of two."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return 1 << max(BUCKETS[0].bit_length() - 1, min(BUCKETS[1].bit_length() - 1, (size // 64).bit_length()))


def count_phrases(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", longest: int = 4, least: int = 30, buckets: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Two written tables: (lang, phrase string, m int, f long) for all phrases of 1 to ``longest`` words that occur ``least`` times or more in
    a language, and (lang, n long), all words of a language.

    Texts are lower-cased (A-Z), split at ``. , ; : ! ?`` and 0x0A-0x0D into pieces and these at spaces and tabs into words; phrases lie in one
    piece, and overlapping occurrences count.  Null text counts as empty, null language as ``und``.  ``buckets`` (a power of two, 64 or more) sizes the
    bitmaps; by default it follows the size of the scan.  Inside one task words are told apart by 64-bit hashes; across tasks by themselves.
    """
    spark, folder = docs.sparkSession, shared_dir(docs.sparkSession)
    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit("und"))
    src = docs.select(lang.alias("_lang"), F.xxhash64(lang).alias("_lh"), F.col(text_col).cast("binary").alias("_text"))
    buckets = buckets or _buckets_for(src)
    if buckets & (buckets - 1) or buckets < 64:
        raise ValueError("buckets must be a power of two, 64 or more")
    found, words, maps = [], None, None
    for k in range(1, longest + 1):
        counts = written(src.mapInArrow(_pass(k, least, buckets, maps, k < longest), _COUNTS), folder, f"counted{k}")
        own = counts.where("section is null").groupBy("lang", "phrase").agg(F.sum("n").alias("f"))
        if k == 1:  # words of a language have no phrase
            own = written(own.where(f"f >= {least} or phrase is null"), folder, "words")
            words = own.where("phrase is null").select("lang", F.col("f").alias("n"))
            own = own.where(f"phrase is not null and f >= {least}")
        else:
            own = own.where(f"f >= {least}")
        own = written(own.select("lang", F.col("phrase").cast("string").alias("phrase"), F.lit(k).alias("m"), "f"), folder, f"frequent{k}")
        found.append(own)
        if k < longest:
            likely = _bitmap(counts.where("section is not null").select("section", "counts"), least, buckets)
            marks = own.select("lang", F.xxhash64("lang").alias("_lh"), F.col("phrase").cast("binary").alias("_text")).mapInArrow(_marks(k, least, buckets), _COUNTS)
            maps = spark.sparkContext.broadcast((likely, _bitmap(marks.select("section", "counts"), least, buckets)))
        drop_folder(spark, f"{folder}/counted{k}")
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out, words


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", longest: int = 4, least: int = 30, top: int = 2000, buckets: int | None = None) -> DataFrame:
    """(lang, rank, phrase string, a, l, r, n, score long): the best ``top`` phrases of each language, numbered from 1.

    Candidates have 2 to ``longest`` words and occur a >= ``least`` times.  Cut after its first k words, a candidate has l (uses of the first
    part), r (of the rest) and the score floor(2000000 a / (l + r)); its lowest-scoring cut counts, of equal ones the first.  A
    candidate goes if a longer one holds its words in a row and occurs at least 0.8 times as often.  Order: score and a descending, phrase by bytes.  n counts all
    words of the language.  Rows and columns as in ``count_phrases``: ids are not read, repeated rows count each time, an empty table gives no rows.
    """
    spark, folder = docs.sparkSession, shared_dir(docs.sparkSession)
    grams, words = count_phrases(docs, text_col, lang_col, longest, least, buckets)
    exact = lambda c: F.col(c).cast("decimal(38,0)")  # noqa: E731  products may pass 64 bits
    many = grams.where("m > 1").select("lang", "phrase", "m", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))

    inner = many.where("m > 2").select("lang", "a", F.explode(F.expr("flatten(transform(sequence(2, m - 1), s -> transform(sequence(1, m - s + 1), p -> array_join(slice(w, p, s), ' '))))")).alias("phrase"))
    most = inner.groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    kept = many.join(most, ["lang", "phrase"], "left").where(F.col("most").isNull() | (exact("most") * 100 < exact("a") * 80))

    cuts = kept.select("lang", "phrase", "a", "w", F.explode(F.expr("sequence(1, m - 1)")).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.expr("array_join(slice(w, 1, k), ' ')").alias("head"), F.expr("array_join(slice(w, k + 1, size(w) - k), ' ')").alias("tail"))
    part = lambda key, count: grams.select("lang", F.col("phrase").alias(key), F.col("f").alias(count))
    cuts = cuts.join(part("head", "l"), ["lang", "head"]).join(part("tail", "r"), ["lang", "tail"])
    cuts = cuts.withColumn("score", F.expr("cast((cast(2000000 as decimal(38,0)) * cast(a as decimal(20,0))) div (cast(l as decimal(20,0)) + r) as bigint)"))
    worst = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("c")).select("lang", "phrase", "c.score", "c.a", "c.l", "c.r")
    worst = written(worst, folder, "scored")

    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    some = Window.partitionBy("lang", "salt").orderBy(*order)
    best = worst.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(_SALTS))).withColumn("rank", F.row_number().over(some)).where(F.col("rank") <= top).drop("salt", "rank")
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return best.join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def collocations_sql(longest: int = 4, least: int = 30, top: int = 2000) -> str:
    """The same in SQL for DuckDB."""
    lower = "".join(map(chr, range(0x61, 0x7B)))
    cuts = " UNION ALL ".join(f"SELECT lang, p, w, f AS a, {k} AS k, array_to_string(w[1:{k}], ' ') AS head, array_to_string(w[{k + 1}:], ' ') AS tail FROM kept WHERE len(w) > {k}" for k in range(1, longest))
    ahead = ", ".join(f"lead(w, {k}) OVER o AS w{k}" for k in range(longest))
    grams = " UNION ALL ".join(
        f"SELECT lang, [{', '.join(f'w{j}' for j in range(k))}] AS w, count(*) AS f FROM ahead WHERE w{k - 1} IS NOT NULL GROUP BY ALL HAVING count(*) >= {least}" for k in range(1, longest + 1)
    )
    return rf"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{lower.upper()}', '{lower}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
rows_ AS (SELECT lang, row_number() OVER () AS piece, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM pieces),
words AS (SELECT lang, piece, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM rows_),
ahead AS (SELECT lang, {ahead} FROM words WINDOW o AS (PARTITION BY piece ORDER BY i)),
grams AS ({grams}),
g AS (SELECT lang, array_to_string(w, ' ') AS p, w, f FROM grams),
total AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM rows_ GROUP BY lang),
spans AS (SELECT lang, w, f, unnest(range(1, len(w))) AS i, len(w) AS m FROM g WHERE len(w) > 2),
inside AS (SELECT lang, array_to_string(w[i:i + s - 1], ' ') AS p, max(f) AS most FROM spans, (SELECT unnest(range(2, {longest})) AS s) WHERE s < m AND i + s - 1 <= m GROUP BY ALL),
kept AS (SELECT g.* FROM g LEFT JOIN inside USING (lang, p) WHERE len(w) > 1 AND (most IS NULL OR 100 * most::HUGEINT < 80 * f::HUGEINT)),
cuts AS ({cuts}),
scored AS (SELECT c.lang, c.p, a, k, h.f AS l, t.f AS r, ((2000000::HUGEINT * a) // (h.f + t.f))::BIGINT AS score
  FROM cuts c JOIN g h ON h.lang = c.lang AND h.p = c.head JOIN g t ON t.lang = c.lang AND t.p = c.tail),
worst AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
ranked AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, p) AS rank, p AS phrase, a, l, r, score FROM worst)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN total USING (lang) WHERE rank <= {top}"""
