"""Queries on pairs of whole texts: weighted and hashed term vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..functions.lexicons import STOP_WORDS
from ..operators import flatten, rules, titles, vectors
from .registry import Tables, query

_STOPS = ", ".join(f"'{x}'" for x in STOP_WORDS)


def _terms_sql(text: str) -> str:
    return rf"""d AS (SELECT min(doc_id) AS id, count(*) AS copies, text FROM documents WHERE text IS NOT NULL GROUP BY text),
tok AS (SELECT id, copies, list_filter(regexp_extract_all({text}, '[\p{{L}}\p{{N}}_]{{2,}}'), lambda x: NOT list_contains([{_STOPS}], x)) AS t FROM d),
tf AS (SELECT id, copies, term, count(*) AS tf FROM (SELECT id, copies, unnest(t) AS term FROM tok UNION ALL SELECT id, copies, unnest(list_transform(list_zip(t[1:len(t) - 1], t[2:len(t)]), lambda p: p[1] || ' ' || p[2])) FROM tok WHERE len(t) > 1) x GROUP BY ALL)"""


def _pairs_sql(least: float) -> str:
    return f"""p AS (SELECT a.id AS a, b.id AS b, sum(a.w * b.w) AS cosine FROM u a JOIN u b ON a.term = b.term AND a.id < b.id GROUP BY a.id, b.id HAVING sum(a.w * b.w) >= {least})
SELECT a, b, round(cosine, 6) AS cosine, da.copies AS copies_a, db.copies AS copies_b"""


_OF = " FROM p JOIN d da ON da.id = p.a JOIN d db ON db.id = p.b"


@query(f"""WITH {_terms_sql('strip_accents(lower(text))')},
n AS (SELECT count(*) AS n FROM documents WHERE text IS NOT NULL),
df AS (SELECT term, sum(copies) AS df, sum(tf * copies) AS total FROM tf GROUP BY term),
border AS (SELECT coalesce((SELECT total FROM df ORDER BY total DESC LIMIT 1 OFFSET 100000), 0) AS border),
raw AS (SELECT id, tf.term, (1 + ln(tf)) * (ln((1.0 + n) / (1 + df)) + 1) AS w FROM tf JOIN df USING (term), n, border WHERE total > border),
u AS (SELECT id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM raw),
{_pairs_sql(0.92)}, CASE WHEN cosine >= 0.95 THEN 'near_duplicate_ge_0_95' ELSE 'watch_0_92_to_0_95' END AS signal{_OF}""")
def textwide_pairs(t: Tables) -> DataFrame:
    """Pairs of different texts whose TF-IDF (100,000 words and word pairs, accents folded) is alike by 0.92 or more, in two bands; a text is its first document."""
    p = vectors.similar_texts(t.documents, "doc_id", "text", 0.92, stop=STOP_WORDS)
    signal = rules.first_match([(F.col("cosine") >= 0.95, "near_duplicate_ge_0_95")], "watch_0_92_to_0_95")
    return p.select("a", "b", F.round("cosine", 6).alias("cosine"), "copies_a", "copies_b", signal.alias("signal"))


def _times(x: str, c: int) -> str:
    return f"((({x})::UBIGINT * {c}::UBIGINT) & 4294967295)"


def _turned(x: str, r: int) -> str:
    return f"list_transform([{x}], lambda z: ((z << {r}) | (z >> {32 - r})) & 4294967295)[1]"


def _murmur_sql(text: str) -> str:
    """The published MurmurHash3 (x86, 32 bits, seed 0) of a text's bytes."""
    raw = f"hex(encode({text}))"
    byte = lambda i: f"('0x' || {raw}[2 * ({i}) + 1:2 * ({i}) + 2])::UBIGINT"
    mixed = lambda k: _times(_turned(_times(k, 0xCC9E2D51), 15), 0x1B873593)
    n = f"(len({raw}) // 2)"
    four = " | ".join(f"({byte(f'4 * i + {j}')} << {8 * j})" for j in range(4))
    blocks = f"list_transform(range({n} // 4), lambda i: {mixed(four)})"
    h = f"list_reduce(list_prepend(0::UBIGINT, {blocks}), lambda h, k: ({_times(_turned('xor(h, k)', 13), 5)} + {0xE6546B64}) & 4294967295)"
    tail = " | ".join(f"CASE WHEN {n} % 4 > {j} THEN {byte(f'{n} // 4 * 4 + {j}')} << {8 * j} ELSE 0::UBIGINT END" for j in range(3))
    h = f"xor(xor({h}, CASE WHEN {n} % 4 > 0 THEN {mixed(tail)} ELSE 0::UBIGINT END), {n}::UBIGINT)"
    for shift, by in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        h = f"list_transform([{h}], lambda z: {_times(f'xor(z, z >> {shift})', by)})[1]"
    return f"list_transform([{h}], lambda z: xor(z, z >> 16))[1]"


@query(f"""WITH {_terms_sql('lower(text)')},
g AS (SELECT term, {_murmur_sql('term')} AS h FROM (SELECT DISTINCT term FROM tf)),
counts AS (SELECT id, (CASE WHEN h >= 2147483648 THEN 4294967296 - h ELSE h END) % 131072 AS term, sum(tf) AS w FROM tf JOIN g USING (term) GROUP BY ALL),
u AS (SELECT id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM counts),
{_pairs_sql(0.95)}{_OF}""")
def hashed_pairs(t: Tables) -> DataFrame:
    """Pairs of different texts whose counts of words and word pairs, hashed to 131,072 buckets, are alike by 0.95 or more; a text is its first document."""
    p = vectors.similar_texts(t.documents, "doc_id", "text", 0.95, buckets=1 << 17, stop=STOP_WORDS)
    return p.select("a", "b", F.round("cosine", 6).alias("cosine"), "copies_a", "copies_b")


#: Hosts that publish one another's pages.
SITES = ["blog.tionsh.example.com", "tionble.example.org"]


@query()
def page_title_pairs(t: Tables) -> DataFrame:
    """Candidate pairs of pages of one language by hash, title, slug and host; character similarity has no SQL form."""
    pages = t.pages.select("page_id", "url", F.regexp_extract("url", "^[a-z]+://[^/]*/([a-z]{2})/", 1).alias("block"), F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1).alias("title"), F.sha2("html", 256).alias("sha"), (F.length("html") >= 500).alias("ready"))
    got = titles.candidate_pairs(pages, "page_id", "block", "title", "url", "sha", "ready", SITES, ["the", "and", "with", "by"])
    return got.select("a", "b", F.round("title_ratio", 6).alias("title_ratio"), F.round("title_jaccard", 6).alias("title_jaccard"), F.round("slug_ratio", 6).alias("slug_ratio"), "same_host", "signal")


_TITLE_SQL = r"trim(regexp_replace(lower(substring(text, 1, 80)), '[^a-z0-9]+', ' ', 'g'))"


@query(f"""WITH RECURSIVE d AS (SELECT doc_id, n_chars, lang, sha256(text) AS h, nullif({_TITLE_SQL}, '') || '|' || lang AS title, CASE WHEN length(text) >= 60 THEN right(text, 60) END AS ending FROM documents),
k AS (SELECT doc_id, 'same_text' AS origin, h AS k FROM d UNION ALL SELECT doc_id, 'same_title', title FROM d UNION ALL SELECT doc_id, 'same_ending', ending FROM d),
e AS (SELECT DISTINCT a.origin, a.doc_id AS a, b.doc_id AS b FROM k a JOIN (SELECT origin, k, min(doc_id) AS doc_id FROM k WHERE k IS NOT NULL GROUP BY ALL) b ON a.origin = b.origin AND a.k = b.k AND a.doc_id <> b.doc_id),
near AS (SELECT DISTINCT a, b FROM (SELECT a, b FROM e UNION ALL SELECT b, a FROM e)),
r AS (SELECT doc_id, doc_id AS other FROM d UNION SELECT r.doc_id, near.b FROM r JOIN near ON near.a = r.other),
c AS (SELECT doc_id, min(other) AS component FROM r GROUP BY doc_id),
f AS (SELECT component, arg_min(doc_id, (-n_chars, doc_id)) AS keeper, count(*) AS size FROM c JOIN d USING (doc_id) GROUP BY component),
o AS (SELECT component, string_agg(DISTINCT origin, ',' ORDER BY origin) AS origins FROM e JOIN c ON c.doc_id = e.a GROUP BY component)
SELECT doc_id, keeper, keeper = doc_id AS kept, size, coalesce(origins, '') AS origins FROM c JOIN f USING (component) LEFT JOIN o USING (component)""")
def flattened_duplicates(t: Tables) -> DataFrame:
    """Documents that equal texts, beginnings or endings connect, in any chain, with the longest of each component as its keeper."""
    d = t.documents.select(
        "doc_id", "n_chars", "lang", F.sha2("text", 256).alias("h"), F.nullif(text.title_key(F.substring("text", 1, 80)), F.lit("")).alias("title"), F.when(F.length("text") >= 60, F.sha2(F.right("text", F.lit(60)), 256)).alias("ending")
    )
    pairs = flatten.star_pairs(d, "doc_id", "same_text", "h").union(flatten.star_pairs(d, "doc_id", "same_title", "title", "lang")).union(flatten.star_pairs(d, "doc_id", "same_ending", "ending"))
    return flatten.flatten(d, "doc_id", pairs, -F.col("n_chars")).withColumn("origins", F.array_join("origins", ","))
