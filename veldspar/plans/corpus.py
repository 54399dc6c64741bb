"""Queries on texts, pages and duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import similarity, text
from ..operators import dedup, features, rules
from ..sources import readers
from .registry import Tables, query

STOP = ["the", "and", "with", "by"]
FAMILIES = {"the": r"\bthe\b", "und": r"\bund\b", "est": r"\best\b", "licence": r"licen[sc]e", "erroneous": r"err\w*"}
WORDS_SQL = r"len(regexp_extract_all(text, '[\p{L}\p{N}_]+'))"
NORM_SQL = r"trim(regexp_replace(replace(text, chr(0), ' '), '\s+', ' ', 'g'))"
TITLE_SQL = "trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'))"
SENTENCES_SQL = r"list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1) || '|\n+'), lambda z: trim(z)), lambda z: length(z) >= 25)"


@query(f"""
WITH c AS (SELECT source, n_chars, {WORDS_SQL} AS words, row_number() OVER (PARTITION BY sha256(text) ORDER BY CASE lang WHEN 'en' THEN 0 ELSE 1 END, doc_id) AS rn FROM documents)
SELECT source, count(*) AS documents, CAST(sum(words) AS BIGINT) AS words, CAST(sum(n_chars) AS BIGINT) AS chars FROM c WHERE rn = 1 GROUP BY source""")
def canonical_by_source(t: Tables) -> DataFrame:
    """One document per text hash, then documents and words by source.  Only hashes, ids and counts are shuffled, not texts."""
    rows = t.documents.select("doc_id", "lang", "source", "n_chars", F.sha2("text", 256).alias("h"), text.word_count(F.col("text")).alias("words"))
    kept = dedup.canonical(rows, "h", F.when(F.col("lang") == "en", 0).otherwise(1), "doc_id")
    return kept.groupBy("source").agg(F.count("*").alias("documents"), F.sum("words").alias("words"), F.sum("n_chars").alias("chars"))


@query("SELECT sha256(text) AS h, min(doc_id) AS first_id, count(*) AS size, count(DISTINCT lang) = 1 OR count(DISTINCT source) = 1 AS coherent FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_clusters(t: Tables) -> DataFrame:
    return dedup.clusters(t.documents.select("doc_id", "lang", "source", F.sha2("text", 256).alias("h")), "h", "doc_id", "lang", "source")


@query("SELECT lang, count(*) AS n FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn FROM documents) WHERE rn > 1) GROUP BY lang")
def manifest_without_redundant(t: Tables) -> DataFrame:
    d = t.documents.select("doc_id", "lang", F.sha2("text", 256).alias("h"))
    return dedup.anti(d, d.join(dedup.canonical(d, "h", "doc_id").select("doc_id"), "doc_id", "left_anti"), "doc_id").groupBy("lang").agg(F.count("*").alias("n"))


@query(rf"""
SELECT doc_id, sha256({NORM_SQL}) AS norm_sha, sha256({TITLE_SQL}) AS key_sha, CAST({WORDS_SQL} AS BIGINT) AS words,
CAST(len(regexp_extract_all(text, '[a-zA-Z]{{3,}}')) AS BIGINT) AS alpha, CAST(len(regexp_extract_all(lower(text), '[a-z0-9]+')) AS BIGINT) AS alnum FROM documents""")
def text_measures(t: Tables) -> DataFrame:
    x = F.col("text")
    return t.documents.select("doc_id", F.sha2(text.norm(x), 256).alias("norm_sha"), F.sha2(text.title_key(x), 256).alias("key_sha"), text.word_count(x).alias("words"), F.size(text.alpha_tokens(x)).cast("long").alias("alpha"), F.size(text.alnum_tokens(x)).cast("long").alias("alnum"))


@query(f"SELECT doc_id, CAST(len({SENTENCES_SQL}) AS BIGINT) AS sentences, CAST(coalesce(list_sum(list_transform({SENTENCES_SQL}, lambda z: length(z))), 0) AS BIGINT) AS chars FROM documents")
def sentence_units(t: Tables) -> DataFrame:
    s = text.sentences(F.col("text"))
    return t.documents.select("doc_id", F.size(s).cast("long").alias("sentences"), F.coalesce(F.aggregate(s, F.lit(0).cast("long"), lambda a, z: a + F.length(z)), F.lit(0)).alias("chars"))


@query("""SELECT doc_id, CAST((length(lower(text)) - length(replace(lower(text), 'the', ''))) / 3 AS BIGINT) AS the_count, CAST((length(lower(text)) - length(replace(lower(text), 'est', ''))) / 3 AS BIGINT) AS est_count FROM documents""")
def literal_counts(t: Tables) -> DataFrame:
    low = F.lower("text")
    return t.documents.select("doc_id", text.literal_count(low, "the").alias("the_count"), text.literal_count(low, "est").alias("est_count"))


def _ascii(c):
    return F.regexp_replace(c, r"[^\x00-\x7F]", "~")


ASCII_SQL = r"regexp_replace(text, '[^\x00-\x7F]', '~', 'g')"


@query(
    "SELECT doc_id, CAST("
    + " + ".join(f"CAST(regexp_matches({ASCII_SQL}, '(?i){p}') AS INT)" for p in FAMILIES.values())
    + f" AS BIGINT) AS families, CAST(len(regexp_extract_all({ASCII_SQL}, '(?i){FAMILIES['the']}')) AS BIGINT) AS the_hits FROM documents"
)
def family_hits(t: Tables) -> DataFrame:
    x = F.col("a")
    return t.documents.select("doc_id", _ascii(F.col("text")).alias("a")).select("doc_id", text.families_hit(x, list(FAMILIES.values())).alias("families"), text.pattern_count(x, FAMILIES["the"]).alias("the_hits"))


@query(r"""SELECT page_id, 'https://' || regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1)), '^www\.', '') || regexp_replace(regexp_replace(regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1), '/+', '/', 'g'), '/+$', '') AS canonical FROM pages""")
def canonical_urls(t: Tables) -> DataFrame:
    return t.pages.select("page_id", text.canonical_url(F.col("url")).alias("canonical"))


@query(r"""
WITH u AS (SELECT page_id, url, 'https://' || regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1)), '^www\.', '') || regexp_replace(regexp_replace(regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1), '/+', '/', 'g'), '/+$', '') AS c FROM pages),
r AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY page_id) AS rn FROM u)
SELECT CASE WHEN rn > 1 THEN 'duplicate_discovery_url' WHEN regexp_matches(c, '/20[0-9][0-9]/') THEN 'dated' WHEN regexp_matches(c, 'article|news|blog') THEN 'explicit_review' ELSE 'secondary_review' END AS status, count(*) AS n FROM r GROUP BY 1""")
def prescreen_urls(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    u = t.pages.select("page_id", text.canonical_url(F.col("url")).alias("c")).withColumn("rn", F.row_number().over(Window.partitionBy("c").orderBy("page_id")))
    status = rules.first_match([(F.col("rn") > 1, "duplicate_discovery_url"), (F.col("c").rlike("/20[0-9][0-9]/"), "dated"), (F.col("c").rlike("article|news|blog"), "explicit_review")], "secondary_review")
    return u.groupBy(status.alias("status")).agg(F.count("*").alias("n"))


@query(r"""SELECT page_id, nullif(regexp_extract(url, '(20[0-9]{2}-[0-9]{2}-[0-9]{2})', 1), '') AS raw, try_cast(nullif(regexp_extract(url, '(20[0-9]{2}-[0-9]{2}-[0-9]{2})', 1), '') AS DATE) AS found, CAST(nullif(regexp_extract(url, '/(20[0-9]{2})/', 1), '') AS INT) AS year FROM pages""")
def url_dates(t: Tables) -> DataFrame:
    url = F.col("url")
    return t.pages.select("page_id", F.nullif(F.regexp_extract(url, r"(20\d{2}-\d{2}-\d{2})", 1), F.lit("")).alias("raw"), text.date_in(url).alias("found"), F.nullif(F.regexp_extract(url, r"/(20\d{2})/", 1), F.lit("")).cast("int").alias("year"))


@query()
def page_texts(t: Tables) -> DataFrame:
    """The best extraction of each page; parsing HTML is beyond SQL."""
    c = readers.best_candidate(F.col("c"))
    got = t.pages.select("page_id", readers.page_candidates("html").alias("c")).select("page_id", c.alias("b"))
    return got.select("page_id", "b.extractor", "b.words", F.sha2("b.text", 256).alias("text_sha256"))


@query()
def page_link_counts(t: Tables) -> DataFrame:
    links = readers.page_links("html", "url")
    return t.pages.select("page_id", links.alias("l")).select("page_id", F.size("l").alias("links"), F.size(F.array_distinct("l")).alias("distinct_links"))


@query(r"""
WITH s AS (SELECT doc_id, source, lang, sha256(text) AS h, substring(trim(regexp_replace(lower(substring(text, 1, 80)), '[^a-z0-9]+', ' ', 'g')), 1, 40) AS title FROM documents),
p AS (SELECT a.doc_id AS id_a, b.doc_id AS id_b, 0 AS k, 'same_text' AS reason FROM s a JOIN s b ON a.h = b.h WHERE a.doc_id % 2 = 0 AND b.doc_id % 2 = 1
UNION ALL SELECT a.doc_id, b.doc_id, 1, 'same_title_source' FROM s a JOIN s b ON a.title = b.title AND a.source = b.source WHERE a.doc_id % 2 = 0 AND b.doc_id % 2 = 1)
SELECT id_a, id_b, arg_min(reason, k) AS reason, count(*) AS n_reasons FROM p GROUP BY id_a, id_b""")
def cross_phase_pairs(t: Tables) -> DataFrame:
    """Two phases, told apart by the id, to which all documents belong, joined on any of two keys."""
    s = t.documents.select("doc_id", "source", F.sha2("text", 256).alias("h"), F.substring(text.title_key(F.substring("text", 1, 80)), 1, 40).alias("title"))
    return dedup.or_key_pairs(s.where("doc_id % 2 = 0"), s.where("doc_id % 2 = 1"), "doc_id", {"same_text": ["h"], "same_title_source": ["title", "source"]})


def _titled(t: Tables) -> DataFrame:
    """Documents with their title key, and the block of its beginning and their language; null languages and texts are in no block."""
    d = t.documents.select("doc_id", "lang", "n_chars", "text", text.title_key(F.substring("text", 1, 80)).alias("title"))
    return d.withColumn("block", F.concat("lang", F.lit("|"), F.substring("title", 1, 12)))


@query(r"""
WITH d AS (SELECT doc_id, lang, n_chars, trim(regexp_replace(lower(substring(text, 1, 80)), '[^a-z0-9]+', ' ', 'g')) AS title FROM documents)
SELECT a.doc_id AS id_a, b.doc_id AS id_b, abs(a.n_chars - b.n_chars) AS difference FROM d a JOIN d b ON a.lang = b.lang AND substring(a.title, 1, 12) = substring(b.title, 1, 12) AND a.doc_id < b.doc_id WHERE a.title = b.title""")
def blocked_title_pairs(t: Tables) -> DataFrame:
    p = dedup.blocked_pairs(_titled(t), "doc_id", "block", "title", "n_chars")
    return p.where("title_a = title_b").select(F.col("doc_id_a").alias("id_a"), F.col("doc_id_b").alias("id_b"), F.abs(F.col("n_chars_a") - F.col("n_chars_b")).alias("difference"))


@query()
def title_ratio_pairs(t: Tables) -> DataFrame:
    """Character similarity of blocked titles: Ratcliff-Obershelp has no SQL form."""
    p = dedup.title_pairs(_titled(t), "doc_id", "block", "title", 0.6)
    return p.select(F.col("a").alias("id_a"), F.col("b").alias("id_b"), F.round("ratio", 6).alias("ratio"), rules.similarity_signal(F.col("ratio"), F.lit(0.0)).alias("signal"))


@query()
def pair_signals(t: Tables) -> DataFrame:
    """Title pairs with a signal by both likenesses: of titles from 0.8 and of five-word shingles from 0.25, beyond which neither has a say.

    Blocks are languages with the first 12 characters of the title key (of the first 80 characters); a likeness below its bound is null.
    """
    titles = dedup.title_pairs(_titled(t), "doc_id", "block", "title", 0.8)
    d = _titled(t).select("doc_id", "block", text.alnum_tokens(F.col("text")).alias("w")).select("doc_id", "block", similarity.shingles(F.col("w")).alias("s"))
    shared = dedup.block_jaccard(d, "doc_id", "block", "s", 0.25)
    both = titles.join(shared, ["a", "b"], "full")
    signal = rules.similarity_signal(F.coalesce("ratio", F.lit(0.0)), F.coalesce("jaccard", F.lit(0.0)))
    return both.select("a", "b", F.round("ratio", 6).alias("ratio"), F.round("jaccard", 6).alias("jaccard"), signal.alias("signal"))


@query()
def title_collisions(t: Tables) -> DataFrame:
    """Equal endings (the last 40 characters of a text) of three documents or more whose beginnings (title key of the first 80) differ."""
    d = t.documents.select("doc_id", F.sha2(F.right("text", F.lit(40)), 256).alias("ending"), text.title_key(F.substring("text", 1, 80)).alias("title"))
    return dedup.title_collisions(d, "ending", "doc_id", "title")


@query(r"""
WITH d AS (SELECT doc_id, lang, substring(trim(regexp_replace(lower(substring(text, 1, 80)), '[^a-z0-9]+', ' ', 'g')), 1, 12) AS b, list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: x NOT IN ('the', 'and', 'with', 'by'))) AS t FROM documents)
SELECT a.doc_id AS id_a, b.doc_id AS id_b, round(CASE WHEN len(a.t) + len(b.t) = 0 THEN 1.0 ELSE CAST(len(list_intersect(a.t, b.t)) AS DOUBLE) / (len(a.t) + len(b.t) - len(list_intersect(a.t, b.t))) END, 6) AS jaccard FROM d a JOIN d b ON a.lang = b.lang AND a.b = b.b AND a.doc_id < b.doc_id""")
def blocked_token_jaccard(t: Tables) -> DataFrame:
    """Token-set similarity inside blocks of equal language and title beginning."""
    d = _titled(t).select("doc_id", "block", F.transform(similarity.without(text.alnum_tokens(F.col("text")), STOP), lambda x: F.xxhash64(x)).alias("t"))
    return dedup.block_jaccard(d, "doc_id", "block", "t").select(F.col("a").alias("id_a"), F.col("b").alias("id_b"), F.round("jaccard", 6).alias("jaccard"))


TFIDF_SQL = """
WITH tf AS (SELECT doc_id AS id, term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents) x WHERE term NOT IN ('the', 'and', 'with', 'by') GROUP BY doc_id, term),
n AS (SELECT count(*) AS n FROM documents),
df AS (SELECT term, count(*) AS df, sum(tf) AS total FROM tf GROUP BY term),
v AS (SELECT term, df FROM df, n WHERE df >= 2 AND df <= 0.9 * n ORDER BY total DESC, term LIMIT 500),
raw AS (SELECT id, tf.term, (1 + ln(tf)) * (ln((1.0 + n) / (1 + df)) + 1) AS w FROM tf JOIN v ON tf.term = v.term, n),
u AS (SELECT id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM raw)
"""


def _weights(t: Tables, n_features: int | None = 500) -> DataFrame:
    tf = features.terms(t.documents, "doc_id", "text", STOP)
    return features.tfidf(tf, t.documents.count(), features=n_features)


@query(TFIDF_SQL + "SELECT term, count(*) AS docs, round(sum(w), 5) AS total, round(max(w), 6) AS most FROM u GROUP BY term")
def tfidf_terms(t: Tables) -> DataFrame:
    return _weights(t).groupBy("term").agg(F.count("*").alias("docs"), F.round(F.sum("w"), 5).alias("total"), F.round(F.max("w"), 6).alias("most"))


@query("""
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)
SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.v, b.v), 5) AS cosine FROM e a JOIN e b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= 0.3""")
def embedding_neighbours(t: Tables) -> DataFrame:
    """Stated queries, the vectors whose id is divisible by 50, against all vectors: a matrix product for each batch and block of queries."""
    stated = t.embeddings.where("vec_id % 50 = 0")
    times, out = max(1, -(-stated.count() // dedup.QUERIES)), None
    for k in range(times):
        block = stated.where(F.pmod(F.xxhash64("vec_id"), F.lit(times)) == k) if times > 1 else stated
        got = dedup.near_vectors(t.embeddings, block, "vec_id", "embedding", 0.3)
        out = got if out is None else out.union(got)
    return out.where("a <> b").select("a", "b", F.round("cosine", 5).alias("cosine"))
