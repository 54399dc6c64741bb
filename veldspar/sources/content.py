"""Main text of pages: blocks of a page with word counts and link densities, scores that spread to neighbouring blocks, and candidates of several extractors.

A page is cut into tags and text by one pattern, and rows of tags and text become blocks by running counts over the page: where block tags stand, whether an anchor, an article or a part that is no content is
open.  All of it is DataFrame expressions and windows over one page's rows; nothing is parsed in Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.rules import first_match
from .json_tree import article_bodies

#: Tags and text; a comment, script or style is one tag, as far as it is closed.
TOKENS = r"(?s)<!--.*?-->|<(?i:script|style|noscript|template)\b.*?</(?i:script|style|noscript|template)\s*>|</?[a-zA-Z][^>]*>|<[!?][^>]*>|[^<]+|<"
BLOCKS = "address article aside blockquote body caption dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main nav ol p pre section table tbody td th thead title tr ul".split()
#: Parts that are no content.
SKIPPED = "nav footer header form aside title head".split()
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&"))
#: Least words of a block's spread score, greatest link density of a block, least characters of the density extractor and words of the others.
SCORE, LINKS, CHARACTERS, WORDS = 12.0, 0.5, 200, 80
#: Extractors in order of precedence.
EXTRACTORS = ("density", "json_ld", "article", "main", "paragraphs")


def plain(text: Column) -> Column:
    """Text without entities, runs of white space as one space."""
    for entity, c in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(c))
    return F.trim(F.regexp_replace(text, r"[ \t\r\n\f]+", " "))


def blocks(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """(id, block, text, words, links, tag, skipped, in_article, in_main): the blocks of each page that have text, numbered in order.

    ``links`` is the share of a block's characters that anchors hold, ``tag`` the block tag before it, with a slash if it closes.  An unclosed part lasts to the end of the page.
    """
    rows = pages.select(F.col(id_col).alias("id"), F.posexplode(F.regexp_extract_all(F.coalesce(F.col(html_col), F.lit("")), F.lit(TOKENS), F.lit(0))).alias("at", "token"))
    rows = rows.select("id", "at", "token", F.lower(F.regexp_extract("token", r"^<(/?[a-zA-Z][a-zA-Z0-9]*)", 1)).alias("tag"), (~F.col("token").rlike(r"^<[!?/a-zA-Z]")).alias("is_text"))
    name = F.regexp_replace("tag", "^/", "")
    upto = Window.partitionBy("id").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)

    def depth(names: list[str]) -> Column:
        inside = name.isin(names)
        return F.sum(F.when(inside & F.col("tag").startswith("/"), -1).when(inside, 1).otherwise(0)).over(upto)

    is_block = name.isin(BLOCKS)
    rows = rows.select(
        "id", "at", "token", "is_text", F.sum(is_block.cast("int")).over(upto).alias("block"), F.last(F.when(is_block, F.col("tag")), True).over(upto).alias("tag"),
        (F.coalesce(F.last(F.when(name == "a", F.col("tag")), True).over(upto), F.lit("/a")) == "a").alias("in_link"), (depth(SKIPPED) > 0).alias("skipped"), (depth(["article"]) > 0).alias("in_article"), (depth(["main"]) > 0).alias("in_main"),
    ).where("is_text")
    raw = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "token"))), lambda x: x["token"]), "")
    sums = rows.groupBy("id", "block").agg(
        raw.alias("raw"), F.sum(F.length("token")).alias("n"), F.sum(F.when(F.col("in_link"), F.length("token")).otherwise(0)).alias("linked"), F.max("tag").alias("tag"),
        *(F.max(c).alias(c) for c in ("skipped", "in_article", "in_main")),
    )
    text = sums.withColumn("text", plain(F.col("raw"))).where("text != ''")
    words = (F.length("text") - F.length(F.replace("text", F.lit(" "), F.lit(""))) + 1).cast("long")
    return text.select("id", "block", "text", words.alias("words"), (F.col("linked") / F.col("n")).alias("links"), "tag", "skipped", "in_article", "in_main")


def scored(page_blocks: DataFrame) -> DataFrame:
    """``blocks`` with ``score``: unlinked words, and half of those of the blocks before and after it; parts that are no content have none of their own."""
    own = F.when(F.col("skipped"), 0.0).otherwise(F.col("words") * (1 - F.col("links")))
    order = Window.partitionBy("id").orderBy("block")
    both = F.coalesce(F.lag("own").over(order), F.lit(0.0)) + F.coalesce(F.lead("own").over(order), F.lit(0.0))
    return page_blocks.withColumn("own", own).withColumn("score", F.col("own") + both / 2).drop("own")


def candidates(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """(id, extractor, text, words, chars): what each extractor makes of a page, where it is long enough; of equal texts only the first extractor's stays.

    ``density``: blocks whose score reaches ``SCORE`` and that anchors hold half of at most, of ``CHARACTERS`` or more together.  ``json_ld``: each articleBody of the page's linked data, ``article`` and ``main``: all blocks inside, of ``WORDS`` words or more.
    ``paragraphs``: blocks after a paragraph's tag, inside the article, or else the main part, or anywhere.  No extractor takes parts that are no content.
    """
    rows = scored(blocks(pages, id_col, html_col)).where("not skipped")
    part = F.when(F.col("in_article"), 2).when(F.col("in_main"), 1).otherwise(0)
    rows = rows.withColumn("part", part).withColumn("inner", F.col("part") == F.max("part").over(Window.partitionBy("id")))
    kinds = {"density": (F.col("score") >= SCORE) & (F.col("links") <= LINKS), "article": F.col("in_article"), "main": F.col("in_main"), "paragraphs": F.col("inner") & (F.col("tag") == "p")}
    rows = rows.select("id", "block", "text", F.explode(F.array_compact(F.array(*(F.when(c, F.lit(EXTRACTORS.index(k))) for k, c in kinds.items())))).alias("e"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "text"))), lambda x: x["text"]), "\n")
    bodies = article_bodies(pages.select(F.col(id_col).alias("id"), F.col(html_col).alias("html")), "id", "html").select("id", F.lit(EXTRACTORS.index("json_ld")).alias("e"), plain(F.col("body")).alias("text"))
    made = rows.groupBy("id", "e").agg(text.alias("text")).unionByName(bodies)
    made = made.withColumn("words", F.size(F.split("text", r"[ \n]")).cast("long")).withColumn("chars", F.length("text").cast("long"))
    made = made.where(F.when(F.col("e") == 0, F.col("chars") >= CHARACTERS).when(F.col("e") < len(EXTRACTORS) - 1, F.col("words") >= WORDS).otherwise(True))
    made = made.groupBy("id", F.sha2("text", 256).alias("h")).agg(F.min_by(F.struct("e", "text", "words", "chars"), "e").alias("c")).select("id", "c.*")
    return made.select("id", F.element_at(F.array(*map(F.lit, EXTRACTORS)), F.col("e") + 1).alias("extractor"), "text", "words", "chars")


def main_texts(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """(id_col, first, longest, candidates): for every page the first extractor's candidate and the longest one (by words, then characters, then order), each (extractor, text, words, chars), null where there is none.

    The first is what an acquisition takes; the longest is for audits that compare pages.  Null and empty pages have no candidate.
    """
    place = first_match([(F.col("extractor") == e, str(k)) for k, e in enumerate(EXTRACTORS)]).cast("int")
    c = F.struct("extractor", "text", "words", "chars")
    best = candidates(pages, id_col, html_col).withColumn("e", place).groupBy("id").agg(F.min_by(c, "e").alias("first"), F.max_by(c, F.struct("words", "chars", -F.col("e"))).alias("longest"), F.count("*").alias("candidates"))
    return pages.select(F.col(id_col).alias("id")).join(best, "id", "left").select(F.col("id").alias(id_col), "first", "longest", F.coalesce("candidates", F.lit(0).cast("long")).alias("candidates"))
