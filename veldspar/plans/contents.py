"""Queries on the content of pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import content, frontier, json_tree
from ..tables import shared_dir
from .registry import Tables, query


def _in(names: list[str]) -> str:
    return "(" + ", ".join(f"'{x}'" for x in names) + ")"


def _plain(text: str) -> str:
    for entity, c in content.ENTITIES:
        text = f"replace({text}, '{entity}', '{c.replace(chr(39), chr(39) * 2)}')"
    return rf"trim(regexp_replace({text}, '[ \t\r\n\f]+', ' ', 'g'))"


def _depth(names: list[str]) -> str:
    return f"sum(CASE WHEN name IN {_in(names)} THEN CASE WHEN shut THEN -1 ELSE 1 END ELSE 0 END) OVER w > 0"


_BLOCKS = rf"""tokens AS (SELECT page_id, unnest(t) AS token, generate_subscripts(t, 1) AS pos FROM (SELECT page_id, regexp_extract_all(coalesce(html, ''), '{content.TOKENS}') AS t FROM pages)),
tags AS (SELECT page_id, pos, token, lower(regexp_extract(token, '^</?([a-zA-Z][a-zA-Z0-9]*)', 1)) AS name, starts_with(token, '</') AS shut, NOT regexp_matches(token, '^<[!?/a-zA-Z]') AS is_text FROM tokens),
run AS (SELECT page_id, pos, token, is_text, sum((name IN {_in(content.BLOCKS)})::INT) OVER w AS block, coalesce(last_value(CASE WHEN name = 'a' THEN NOT shut END IGNORE NULLS) OVER w, false) AS in_link,
  last_value(CASE WHEN name IN {_in(content.BLOCKS)} THEN CASE WHEN shut THEN '/' ELSE '' END || name END IGNORE NULLS) OVER w AS tag,
  {_depth(content.SKIPPED)} AS skipped, {_depth(['article'])} AS in_article, {_depth(['main'])} AS in_main FROM tags WINDOW w AS (PARTITION BY page_id ORDER BY pos ROWS UNBOUNDED PRECEDING)),
sums AS (SELECT page_id, block, {_plain("string_agg(token, '' ORDER BY pos)")} AS text, sum(length(token)) AS n, sum(CASE WHEN in_link THEN length(token) ELSE 0 END) AS linked, max(tag) AS tag, bool_or(skipped) AS skipped, bool_or(in_article) AS in_article, bool_or(in_main) AS in_main
  FROM run WHERE is_text GROUP BY ALL),
blocks AS (SELECT *, length(text) - length(replace(text, ' ', '')) + 1 AS words, linked::DOUBLE / n::DOUBLE AS links FROM sums WHERE text <> ''),
owned AS (SELECT *, CASE WHEN skipped THEN 0.0::DOUBLE ELSE words * (1 - links) END AS own FROM blocks),
scored AS (SELECT *, own + (coalesce(lag(own) OVER o, 0.0) + coalesce(lead(own) OVER o, 0.0)) / 2 AS score FROM owned WINDOW o AS (PARTITION BY page_id ORDER BY block))"""


@query(f"""WITH {_BLOCKS} SELECT page_id, count(*) AS blocks, count_if(skipped) AS skipped, CAST(sum(words) AS BIGINT) AS words, round(max(links), 6) AS most_links, round(max(score), 6) AS most_score FROM scored GROUP BY page_id""")
def page_blocks(t: Tables) -> DataFrame:
    rows = content.scored(content.blocks(t.pages, "page_id", "html"))
    return rows.groupBy(F.col("id").alias("page_id")).agg(
        F.count("*").alias("blocks"), F.count_if("skipped").alias("skipped"), F.sum("words").alias("words"), F.round(F.max("links"), 6).alias("most_links"), F.round(F.max("score"), 6).alias("most_score")
    )


@query(f"""WITH {_BLOCKS},
kept AS (SELECT *, CASE WHEN in_article THEN 2 WHEN in_main THEN 1 ELSE 0 END AS part FROM scored WHERE NOT skipped), inner_ AS (SELECT *, part = max(part) OVER (PARTITION BY page_id) AS inmost FROM kept),
made AS (SELECT page_id, 0 AS e, string_agg(text, chr(10) ORDER BY block) AS text FROM inner_ WHERE score >= {content.SCORE} AND links <= {content.LINKS} GROUP BY page_id UNION ALL SELECT page_id, 2, string_agg(text, chr(10) ORDER BY block) FROM inner_ WHERE in_article GROUP BY page_id
  UNION ALL SELECT page_id, 3, string_agg(text, chr(10) ORDER BY block) FROM inner_ WHERE in_main GROUP BY page_id UNION ALL SELECT page_id, 4, string_agg(text, chr(10) ORDER BY block) FROM inner_ WHERE inmost AND tag = 'p' GROUP BY page_id
  UNION ALL SELECT page_id, 1, {_plain("x.value ->> '$'")} FROM (SELECT page_id, unnest(regexp_extract_all(html, '{json_tree.LINKED.replace(chr(39), chr(39) * 2)}', 1)) AS j FROM pages) s, json_tree(CASE WHEN json_valid(s.j) THEN s.j ELSE 'null' END) x WHERE x.key = 'articleBody' AND x.type = 'VARCHAR'),
counted AS (SELECT *, length(text) AS chars, len(regexp_split_to_array(text, '[ \\n]')) AS words FROM made),
long AS (SELECT * FROM counted WHERE CASE e WHEN 0 THEN chars >= {content.CHARACTERS} WHEN 4 THEN true ELSE words >= {content.WORDS} END QUALIFY row_number() OVER (PARTITION BY page_id, text ORDER BY e) = 1),
c AS (SELECT page_id, count(*) AS candidates, arg_min(e, e) AS first_e, arg_min(sha256(text), e) AS first_sha256, arg_max(e, (words, chars, -e)) AS longest_e, arg_max(sha256(text), (words, chars, -e)) AS longest_sha256, max(words) AS words FROM long GROUP BY page_id)
SELECT page_id, coalesce(candidates, 0) AS candidates, {list(content.EXTRACTORS)}[first_e + 1] AS first_extractor, first_sha256, {list(content.EXTRACTORS)}[longest_e + 1] AS longest_extractor, longest_sha256, words FROM pages LEFT JOIN c USING (page_id)""")
def page_contents(t: Tables) -> DataFrame:
    """The first and the longest candidate of each page's main text."""
    got = content.main_texts(t.pages, "page_id", "html")
    return got.select(
        "page_id", "candidates", F.col("first.extractor").alias("first_extractor"), F.sha2("first.text", 256).alias("first_sha256"), F.col("longest.extractor").alias("longest_extractor"),
        F.sha2("longest.text", 256).alias("longest_sha256"), F.col("longest.words").alias("words"),
    )


@query("""SELECT key AS name, type, value, count(*) AS n FROM (SELECT t.key, CASE t.type WHEN 'UBIGINT' THEN 'bigint' WHEN 'BIGINT' THEN 'bigint' WHEN 'VARCHAR' THEN 'string' ELSE lower(t.type) END AS type, t.atom ->> '$' AS value FROM events, json_tree(props) t WHERE t.type NOT IN ('OBJECT', 'ARRAY')) x GROUP BY ALL""")
def event_properties(t: Tables) -> DataFrame:
    """How often each value of each property occurs."""
    rows = json_tree.leaves(t.events.select("event_id", "props"), "event_id", "props")
    return rows.groupBy("name", F.col("kind").alias("type"), "value").agg(F.count("*").alias("n"))


@query("""SELECT conv_id, count(*) AS bodies, max(length(text)) AS longest, sha256(string_agg(text, chr(10) ORDER BY turn)) AS texts_sha256 FROM conversations WHERE text IS NOT NULL GROUP BY conv_id""")
def nested_bodies(t: Tables) -> DataFrame:
    """Conversations as pages whose linked data nests the turns in lists in an object, and the bodies found in them."""
    turn = F.struct(F.col("role").alias("author"), F.col("text").alias("articleBody"))
    turns = F.transform(F.array_sort(F.collect_list(F.struct("turn", turn.alias("t")))), lambda x: F.struct(F.array(x["t"]).alias("part")))
    script = F.replace(F.to_json(F.struct(F.struct(turns.alias("hasPart")).alias("@graph"))), F.lit("</"), F.lit("<\\/"))
    pages = t.conversations.groupBy("conv_id").agg(F.concat(F.lit("<html><script type='application/ld+json'>"), script, F.lit("</script>")).alias("html"))
    scripts = pages.select("conv_id", F.explode(json_tree.linked_data(F.col("html"))).alias("j"))
    rows = json_tree.leaves(scripts, "conv_id", "j").where("name = 'articleBody' and kind = 'string'")
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "value"))), lambda x: x["value"]), "\n")
    return rows.groupBy("conv_id").agg(F.count("*").alias("bodies"), F.max(F.length("value")).cast("long").alias("longest"), F.sha2(texts, 256).alias("texts_sha256"))


@query("SELECT url, min(2) AS depth FROM pages GROUP BY url")
def sitemap_crawl(t: Tables) -> DataFrame:
    """Pages found through the sitemaps that list them: one of sitemaps by language, which lead to lists of an eighth of the pages each."""
    lang = F.regexp_extract("url", "^[a-z]+://[^/]*/([a-z]{2})/", 1)
    text = F.replace(F.replace(F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    rows = t.pages.select(F.concat_ws("-", F.lit("post"), lang, F.col("page_id") % 8).alias("list"), F.concat(F.lit("post-"), lang).alias("index"), F.concat(F.lit("<url><loc>"), text, F.lit("</loc></url>")).alias("loc"))
    tag = lambda kind, rows: F.concat(F.lit(f"<{kind}>"), F.array_join(F.array_sort(F.collect_set(rows)), ""), F.lit(f"</{kind}>"))
    lists = rows.groupBy(F.col("list").alias("url")).agg(tag("urlset", "loc").alias("xml"))
    loc = lambda c: F.concat(F.lit("<sitemap><loc>"), F.col(c), F.lit("</loc></sitemap>"))
    indexes = rows.groupBy(F.col("index").alias("url")).agg(tag("sitemapindex", loc("list")).alias("xml"))
    root = rows.groupBy(F.lit("root").alias("url")).agg(tag("sitemapindex", loc("index")).alias("xml"))
    leaves, _ = frontier.crawl(t.spark.createDataFrame([("root",)], "url string"), root.union(indexes).union(lists), shared_dir(t.spark))
    return leaves
