"""Pairs of titles by character similarity, through an index of positional 3-grams, and the signals of candidate pairs.

Let M characters of two titles of S characters together match in order, so that their ratio is 2 M / S.  An unmatched character destroys at most three 3-grams
of its own title and, where it parts a run of the other one, two there.  So 5 M - 2 S - 2 grams at least are common, each at places that differ by no more than
the characters unmatched before it.  A ratio bounds M, and with it the lengths (``2 * shorter >= ratio * S``), the common grams and the shift.  The rarest common gram
lies among the rarest grams of both titles, so only those are keys.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import similarity, text
from ..tables import shared_dir, written
from .dedup import token_pairs
from .rules import first_match

GRAM = 3


def least_common(total: int, ratio: float) -> float:
    """3-grams that titles of ``total`` characters together must share to be alike by ``ratio``."""
    return (2.5 * ratio - 2) * total - 2


def _ratios(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = similarity.sequence_ratios(batch.column(2).to_pylist(), batch.column(3).to_pylist(), least)
            keep = pa.array(np.flatnonzero(got >= least))
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(keep) for k in (0, 1)), pa.array(got).take(keep)], names=["a", "b", "ratio"])

    return run


def similar_titles(titles: DataFrame, least: float = 0.9) -> DataFrame:
    """(a, b, ratio): all pairs a < b of one block alike by ``least`` or more, of rows (id, block, title) whose titles differ within a block.

    The ratio is that of ``difflib`` on characters, a's title first.  None is lost; ``least`` must be over 8/9, where titles too short to share a gram are equal.
    """
    if not 8 / 9 < least <= 1:
        raise ValueError("least must be over 8/9")
    kind = dict(titles.dtypes)["id"]
    rows = titles.select("id", "block", "title", F.length("title").alias("m")).where(f"m >= {GRAM}")
    grams = rows.select("id", "block", "m", F.posexplode(F.expr(f"transform(sequence(1, m - {GRAM - 1}), i -> substring(title, i, {GRAM}))")).alias("at", "g"))
    grams = grams.join(grams.groupBy("g").agg(F.count("*").alias("n")), "g")
    rare = F.row_number().over(Window.partitionBy("id").orderBy("n", "g", "at"))
    # against the shortest title that can be alike
    need = F.greatest(F.lit(1.0), F.ceil((2.5 * least - 2) * (F.col("m") + F.ceil(F.col("m") * (least / (2 - least)) - 1e-9)) - 2 - 1e-9))
    keys = grams.withColumn("k", rare).where(F.col("k") <= F.col("m") - (GRAM - 1) - need + 1)
    x, y = (keys.select("block", "g", F.col("id").alias(s), F.col("m").alias(f"m{s}"), F.col("at").alias(f"at{s}")) for s in "ab")
    half = (F.col("ma") + F.col("mb")) * (least / 2)
    shift = F.col("ata") - F.col("atb")
    near = (F.least("ma", "mb") + 1e-9 >= half) & (shift <= F.col("ma") - half + 1e-9) & (-shift <= F.col("mb") - half + 1e-9)
    met = x.join(y, ["block", "g"]).where((F.col("a") < F.col("b")) & near).select("a", "b").distinct()
    of = lambda s: titles.select(F.col("id").alias(s), F.col("title").alias(f"t{s}"))
    return met.join(of("a"), "a").join(of("b"), "b").select("a", "b", "ta", "tb").mapInArrow(_ratios(least), f"a {kind}, b {kind}, ratio double")


def _token_jaccard(a: Column, b: Column, stop: list[str]) -> Column:
    """Of the words of two normalised titles without stop words; 0 where either has none."""
    words = lambda c: F.array_distinct(F.filter(F.split(c, " "), lambda x: (x != "") & ~x.isin(stop)))
    x, y = words(a), words(b)
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(similarity.jaccard(x, y))


def candidate_pairs(df: DataFrame, id_col: str, block: str, title: str, url: str, sha: str, ready: str, sites: list[str], stop: list[str]) -> DataFrame:
    """(a, b, title_ratio, title_jaccard, slug_ratio, same_host, signal): pairs of one block with a signal of being the same, a < b.

    In order: equal hashes of two ``ready`` rows, equal titles, titles alike by 0.97 (words by 0.85), by 0.93 (0.78), slugs alike by 0.97 (0.65), and titles by 0.90 (0.75) of two hosts of
    ``sites``.  Titles are lower-cased letters and digits; the slug is the last part of the path without a date at its end.  Rows equal in block, title, slug, host and hash are one, that of the
    smallest id; rows of equal hash, or of equal title, are each paired with the first of them, not with each other.  Beyond that no pair is lost.  Null titles count as empty, null blocks are
    one; empty titles, slugs and hosts are equal to none.  Ratios that decide nothing are null.
    """
    folder = shared_dir(df.sparkSession)
    path = F.regexp_replace(F.regexp_replace(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[a-zA-Z]+://[^/?#]*([^?#]*)", 1), "/+$", ""), "^.*/", "")
    rows = df.select(
        F.col(id_col).alias("id"), F.coalesce(F.col(block).cast("string"), F.lit("")).alias("block"), F.coalesce(text.title_key(F.col(title)), F.lit("")).alias("title"),
        text.title_key(F.regexp_replace(path, r"-20\d{2}-\d{2}-\d{2}(?:-\d+)?$", "")).alias("slug"), text.url_host(F.coalesce(F.col(url), F.lit(""))).alias("host"),
        F.when(F.col(ready) & text.valid_sha256(F.col(sha)), F.col(sha)).alias("sha"),
    )
    nodes = written(rows.groupBy("block", "title", "slug", "host", "sha").agg(F.min("id").alias("id"), F.count("*").alias("rows")), folder, "nodes")
    site = F.col("host").isin(sites)

    def first(*keys: str, only: Column | None = None) -> DataFrame:
        return (nodes.where(only) if only is not None else nodes).groupBy("block", *keys).agg(F.min("id").alias("id"))

    def stars(key: str, known: Column) -> DataFrame:
        return nodes.where(known).join(first(key, only=known).withColumnRenamed("id", "a"), ["block", key]).where("a < id").select("a", F.col("id").alias("b"))

    found = [stars("sha", F.col("sha").isNotNull()), stars("title", F.col("title") != "")]
    titles = first("title", only=F.col("title") != "")
    alike = written(similar_titles(titles, 0.9), folder, "titles")
    found.append(alike.where("ratio >= 0.93").select("a", "b"))
    # pairs of titles whose first rows are of other hosts
    of = lambda s: titles.select(F.col("id").alias(s), "block", F.col("title").alias(f"t{s}"))
    theirs = lambda s: first("title", only=site & (F.col("title") != "")).select("block", F.col("title").alias(f"t{s}"), F.col("id").alias(f"own{s}"))
    cross = alike.select("a", "b").join(of("a"), "a").join(of("b").drop("block"), "b").join(theirs("a"), ["block", "ta"]).join(theirs("b"), ["block", "tb"])
    found.append(cross.select(F.least("owna", "ownb").alias("a"), F.greatest("owna", "ownb").alias("b")))
    # slugs: rows of one slug, or of two alike, are compared by words; each such set of rows is a block of its own
    slugs = written(first("slug", only=F.col("slug") != ""), folder, "slugs")
    like = written(similar_titles(slugs.withColumnRenamed("slug", "title"), 0.97), folder, "slug_pairs")
    sets = slugs.select("id", F.col("id").cast("string").alias("set")).union(like.select(F.col("a").alias("id"), F.concat_ws("|", "a", "b").alias("set"))).union(like.select(F.col("b").alias("id"), F.concat_ws("|", "a", "b").alias("set")))
    members = sets.join(slugs, "id").drop("id").join(nodes.select("block", "slug", "id", "title"), ["block", "slug"])
    members = members.select("id", "set", F.array_distinct(F.filter(F.split("title", " "), lambda x: (x != "") & ~x.isin(stop))).alias("words")).where("size(words) > 0")
    found.append(token_pairs(members, "id", "set", "words", 0.65).select("a", "b"))

    pairs = found[0]
    for x in found[1:]:
        pairs = pairs.union(x)
    side = lambda s: nodes.select(F.col("id").alias(s), *(F.col(c).alias(f"{c}_{s}") for c in ("title", "slug", "host", "sha")))
    pairs = pairs.distinct().join(side("a"), "a").join(side("b"), "b")
    ratio = lambda c, least: F.when(similarity.may_reach(F.col(f"{c}_a"), F.col(f"{c}_b"), least) & (F.col(f"{c}_a") != "") & (F.col(f"{c}_b") != ""), similarity.sequence_ratio(f"{c}_a", f"{c}_b"))
    pairs = pairs.withColumns({"title_ratio": ratio("title", 0.9), "slug_ratio": ratio("slug", 0.97), "title_jaccard": _token_jaccard(F.col("title_a"), F.col("title_b"), stop)})
    r, s, j = F.col("title_ratio"), F.col("slug_ratio"), F.col("title_jaccard")
    signal = first_match(
        [
            (F.col("sha_a") == F.col("sha_b"), "same_trusted_hash_requires_metadata_review"),
            ((F.col("title_a") == F.col("title_b")) & (F.col("title_a") != ""), "exact_normalised_title"),
            ((r >= 0.97) & (j >= 0.85), "very_high_title_similarity"),
            ((r >= 0.93) & (j >= 0.78), "high_title_similarity"),
            ((s >= 0.97) & (j >= 0.65), "very_high_slug_similarity"),
            (F.col("host_a").isin(sites) & F.col("host_b").isin(sites) & (r >= 0.90) & (j >= 0.75), "cross_site_high_title_similarity"),
        ]
    )
    same_host = (F.col("host_a") == F.col("host_b")) & (F.col("host_a") != "")
    return pairs.select("a", "b", "title_ratio", "title_jaccard", "slug_ratio", same_host.alias("same_host"), signal.alias("signal")).where("signal is not null")
