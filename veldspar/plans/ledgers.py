"""Queries on screening decisions: signals counted in documents, addresses of pages, ledgers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import similarity, text
from ..operators import dedup, flatten, rules
from .analysis import DOCS_SQL, _any, _docs, _sum
from .registry import Tables, query
from .screening import _VARIANT_SQL

# --- evidence counted in texts: stand-in words of the supplied languages, so that every branch is reached -----------------------------------
MENTIONS = {"lonmin": r"\bund\b", "sibanye": r"\bque\b", "case_n": r"\bwith\b"}
FAMILIES = {"event": [r"\bthe\b", r"\band\b", r"\bder\b", r"\best\b", r"\bfor\b", r"\bque\b"], "social": [r"\bby\b", r"\blicensed\b"], "corp": [r"\bof\b", r"\bin\b", r"\bto\b", r"\bles\b"]}
FLAGS = {"actors": [r"\bund\b", r"\bthe\b"], "forces": [r"\bder\b", r"\bby\b"]}
TITLES = {"title_case": r"\bwith\b", "title_corp": r"\bof\b"}
_SIGNALS_SQL = f"""sig AS (SELECT doc_id, length(a) < 500 AS unusable, lang = 'de' AS early, {", ".join(f"len(regexp_extract_all(a, '(?i){p}')) AS {n}" for n, p in MENTIONS.items())},
{", ".join(f"{_sum('a', p)} AS {n}" for n, p in FAMILIES.items())}, {", ".join(f"regexp_matches(a, '{_any(p)}') AS {n}" for n, p in FLAGS.items())}, {", ".join(f"regexp_matches(substring(a, 1, 80), '(?i){p}') AS {n}" for n, p in TITLES.items())} FROM d)"""


def _signals(t: Tables) -> DataFrame:
    """Each document's signals as columns, counted once for all rule lists."""
    a = F.col("a")
    return _docs(t).select(
        "doc_id", (F.length("a") < 500).alias("unusable"), (F.col("lang") == "de").alias("early"), *(text.pattern_count(a, p).alias(n) for n, p in MENTIONS.items()),
        *(text.families_hit(a, p).alias(n) for n, p in FAMILIES.items()), *(text.any_hit(a, p).alias(n) for n, p in FLAGS.items()), *(text.any_hit(F.substring("a", 1, 80), [p]).alias(n) for n, p in TITLES.items()),
    )


def _class(variant: str):
    return rules.evidence_variant(variant, **{n: F.col(n) for n in ("unusable", "early", *FLAGS, *MENTIONS, *FAMILIES, *TITLES)})


@query(f"WITH {DOCS_SQL}, {_SIGNALS_SQL}, v AS (" + " UNION ALL ".join(f"SELECT '{v}' AS variant, {e} AS class FROM sig" for v, e in _VARIANT_SQL.items()) + ") SELECT variant, class, count(*) AS n FROM v GROUP BY variant, class")
def document_evidence(t: Tables) -> DataFrame:
    """Evidence classes of all documents by each of the four rule lists."""
    pairs = F.explode(F.array(*(F.struct(F.lit(v).alias("variant"), _class(v).alias("class")) for v in rules.VARIANTS)))
    return _signals(t).select(pairs.alias("p")).groupBy("p.variant", "p.class").agg(F.count("*").alias("n"))


@query(f"""WITH {DOCS_SQL}, {_SIGNALS_SQL}, c AS (SELECT *, {_VARIANT_SQL['secondary']} AS class FROM sig)
SELECT class, early OR lonmin >= 2 OR (case_n >= 2 AND event >= 4) OR (case_n >= 2 AND event >= 3 AND forces) AS guarded, coalesce(class IN ('strong_case_context_supported', 'possible_lonmin_substantive_context') AND lonmin >= 1 AND event >= 4 AND title_corp, false) AS labour, count(*) AS n FROM c GROUP BY ALL""")
def document_guards(t: Tables) -> DataFrame:
    """Case guards and the rule of the strike years, as if every text were of 2014, by evidence class."""
    s = _signals(t)
    guard = rules.case_guard(F.col("early"), F.col("lonmin"), F.col("case_n"), F.col("event"), F.col("forces"))
    labour = rules.temporal_labour(_class("secondary"), F.lit(2014), F.col("lonmin"), F.col("event"), F.when(F.col("title_corp"), "of").otherwise(""), "^of$").isNotNull()
    return s.groupBy(_class("secondary").alias("class"), guard.alias("guarded"), labour.alias("labour")).agg(F.count("*").alias("n"))


# --- addresses of pages ------------------------------------------------------------------------------------------------------------------
_CANON = r"'https://' || regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1)), '^www\.', '') || regexp_replace(regexp_replace(regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1), '/+', '/', 'g'), '/+$', '')"
_YEAR = "CAST(coalesce(nullif(regexp_extract(url, '(20[0-9]{2})-[0-9]{2}-[0-9]{2}', 1), ''), nullif(regexp_extract(url, '/(20[0-9]{2})/', 1), '')) AS INT)"
KEYWORDS = ["blog", "the", "spam"]


@query(f"""WITH u AS (SELECT page_id, url, {_CANON} AS c, {_YEAR} AS y FROM pages), f AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY page_id) AS rn FROM u)
SELECT CASE WHEN starts_with(lower(regexp_extract(url, '://([^/?#]*)', 1)), 'm.') THEN 'already_screened' WHEN rn > 1 THEN 'duplicate_discovery_url' WHEN y < 2010 OR y > 2023 THEN 'exclude_outside_period' WHEN y IS NULL AND NOT contains(url, 'blog') THEN 'review_year_unresolved'
WHEN contains(url, '/en/') THEN 'explicit_case_title_review' WHEN contains(url, '/de/') THEN 'lonmin_only_title_review' ELSE 'secondary_keyword_only_review' END AS status, count(*) AS n FROM f GROUP BY 1""")
def page_prescreen(t: Tables) -> DataFrame:
    """Statuses of the pages' own addresses; blogs without a year count as of the period's last."""
    u = F.col("url")
    year = F.coalesce(text.year_in(u), F.when(u.contains("blog"), 2023))
    rows = t.pages.select("page_id", "url", text.canonical_url(u).alias("c"), year.alias("y"))
    rows = rows.join(rows.groupBy("c").agg(F.min("page_id").alias("first")), "c")
    status = rules.prescreen(F.lower(F.regexp_extract("url", "://([^/?#]*)", 1)).startswith("m."), F.col("page_id") > F.col("first"), F.col("y"), u.contains("/en/"), u.contains("/de/"))
    return rows.groupBy(status.alias("status")).agg(F.count("*").alias("n"))


@query(r"""SELECT page_id, regexp_replace(regexp_replace(lower(regexp_extract(url, '://([^/?#]*)', 1)), '^www\.', ''), '^m\.', '') AS host, array_to_string(list_transform(regexp_extract_all(lower(trim(regexp_replace(regexp_replace(regexp_extract(regexp_replace(regexp_replace(regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1), '/+', '/', 'g'), '/+$', ''), '([^/]*)$', 1), '^20[0-9]{2}-[0-9]{2}-[0-9]{2}-', ''), '[-_]+', ' ', 'g'))), '[a-z]+|[^a-z]+'), lambda x: upper(x[1]) || x[2:]), '') AS title,
regexp_matches(lower(url), 'blog|the|spam') AS keyword, regexp_matches(lower(url), 'blog|the|spam') AND (coalesce(try_cast(nullif(regexp_extract(lower(url), '(?:^|[-_/])(201[0-9]|202[0-3])(?:[-_/]|$)', 1), '') AS INT) BETWEEN 2010 AND 2023, false) OR contains(lower(url), '/article/')) AS kept FROM pages""")
def page_addresses(t: Tables) -> DataFrame:
    """Hosts, titles from slugs and keyword rules of each page."""
    u = F.col("url")
    host = text.strip_prefix(text.strip_prefix(F.lower(F.regexp_extract(u, "://([^/?#]*)", 1)), "www."), "m.")
    return t.pages.select("page_id", host.alias("host"), text.slug_title(u).alias("title"), F.lower(u).rlike("|".join(KEYWORDS)).alias("keyword"), rules.keyword_url(u, KEYWORDS).alias("kept"))


@query("""WITH a AS (SELECT page_id, url, regexp_replace(url, '^http://', 'https://') AS s FROM pages), b AS (SELECT page_id, [url, s, replace(s, '://blog.tionsh.example.com/', '://tionble.example.org/')] AS l FROM a)
SELECT page_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ' ') AS tried FROM b""")
def page_mirrors(t: Tables) -> DataFrame:
    """Addresses to try for each page in order, without repeats: its own, the secure one, a mirror's."""
    return t.pages.select("page_id", F.array_join(text.url_candidates(F.col("url"), {"blog.tionsh.example.com": "tionble.example.org"}), " ").alias("tried"))


# --- ledgers -----------------------------------------------------------------------------------------------------------------------------
_LEDGER = "SELECT d.doc_id, CASE WHEN l.toxic = 1 THEN 'Exclude' WHEN l.quality = 1 AND d.n_chars > 1000 THEN ' Include ' WHEN l.quality = 0 THEN '' END AS decision, CASE d.lang WHEN 'en' THEN 'candidate_pending_substantive_screen' WHEN 'de' THEN 'Eligible_secondary' WHEN 'fr' THEN 'rejected' END AS status FROM documents d LEFT JOIN labels l USING (doc_id)"


@query(f"WITH r AS ({_LEDGER}) SELECT coalesce(decision, '-') AS decision, coalesce(status, '-') AS status, lower(trim(coalesce(decision, ''))) IN ('include', 'included', 'include_candidate', 'eligible') OR starts_with(lower(trim(coalesce(status, ''))), 'eligible') OR lower(trim(coalesce(status, ''))) IN ('candidate_pending_substantive_screen', 'verified_candidate', 'verified', 'include', 'included', 'verified_archive', 'verified_historical_citation') AS eligible, count(*) AS n FROM r GROUP BY ALL")
def eligible_records(t: Tables) -> DataFrame:
    """Documents by decision and state, and whether they are to be acquired; what is excluded by decision may still be pending by state."""
    l, d = t.labels.select("doc_id", "quality", "toxic"), t.documents.select("doc_id", "n_chars", "lang")  # noqa: E741
    decision = F.when(F.col("toxic") == 1, "Exclude").when((F.col("quality") == 1) & (F.col("n_chars") > 1000), " Include ").when(F.col("quality") == 0, "")
    status = F.when(F.col("lang") == "en", "candidate_pending_substantive_screen").when(F.col("lang") == "de", "Eligible_secondary").when(F.col("lang") == "fr", "rejected")
    r = d.join(l, "doc_id", "left").select(decision.alias("decision"), status.alias("status"))
    return r.groupBy(F.coalesce("decision", F.lit("-")).alias("decision"), F.coalesce("status", F.lit("-")).alias("status"), rules.eligible(F.col("decision"), F.col("status")).alias("eligible")).agg(F.count("*").alias("n"))


TRIAGE = ("acquisition_exception", "unusable text", "0"), ("priority_review", "case in title", "1"), ("possible", "context without case", "2"), ("low_signal", "no signal", "4")


@query(f"""WITH {DOCS_SQL}, {_SIGNALS_SQL}, x AS (SELECT CASE WHEN unusable THEN 0 WHEN title_case OR case_n >= 5 THEN 1 WHEN event >= 3 OR social >= 1 THEN 2 WHEN event = 0 THEN 3 ELSE 4 END AS k FROM sig)
SELECT {[a for a, _, _ in TRIAGE] + ['manual_review']}[k + 1] AS status, {[b for _, b, _ in TRIAGE] + ['ambiguous']}[k + 1] AS rationale, {[c for _, _, c in TRIAGE] + ['3']}[k + 1] AS priority, count(*) AS n FROM x GROUP BY k""")
def document_triage(t: Tables) -> DataFrame:
    """Status, rationale and priority of each document by the first rule that holds."""
    holds = (F.col("unusable"), F.col("title_case") | (F.col("case_n") >= 5), (F.col("event") >= 3) | (F.col("social") >= 1), F.col("event") == 0)
    pack = lambda x: dict(zip(("status", "rationale", "priority"), x))
    d = rules.first_match_struct([(c, pack(x)) for c, x in zip(holds, TRIAGE)], pack(("manual_review", "ambiguous", "3")))
    return _signals(t).select(d.alias("d")).groupBy("d.status", "d.rationale", "d.priority").agg(F.count("*").alias("n"))


@query(r"""WITH x AS (SELECT text, len(regexp_extract_all(text, '[\p{L}\p{N}_]+')) AS words, count(*) OVER (PARTITION BY text) AS rows FROM documents)
SELECT CASE WHEN coalesce(length(text), 0) = 0 THEN 'missing_text' WHEN rows > 1 THEN 'repeated_extraction_hash' WHEN words < 150 THEN 'short_text_review' ELSE 'usable_text' END AS disposition, count(*) AS n FROM x GROUP BY 1""")
def text_dispositions(t: Tables) -> DataFrame:
    """What becomes of each text; hashes and counts are shuffled, not texts."""
    rows = t.documents.select(F.sha2("text", 256).alias("h"), F.substring("text", 1, 1).alias("text"), text.word_count(F.col("text")).alias("words"))
    counts = rows.groupBy("h", "text", "words").agg(F.count("*").alias("rows"))
    return counts.groupBy(rules.text_quality(F.col("text"), F.col("words"), F.col("rows")).alias("disposition")).agg(F.sum("rows").alias("n"))


_TITLE = r"nullif(trim(regexp_replace(lower(substring(text, 1, 80)), '[^a-z0-9]+', ' ', 'g')), '')"


@query(f"""WITH d AS (SELECT doc_id, lang, sha256(text) AS h, {_TITLE} AS title FROM documents),
p AS (SELECT f.doc_id AS a, d.doc_id AS b FROM d JOIN (SELECT h, min(doc_id) AS doc_id FROM d GROUP BY h) f USING (h) WHERE d.doc_id > f.doc_id UNION SELECT f.doc_id, d.doc_id FROM d JOIN (SELECT lang, title, min(doc_id) AS doc_id FROM d WHERE title IS NOT NULL GROUP BY ALL) f USING (lang, title) WHERE d.doc_id > f.doc_id)
SELECT CASE WHEN x.h = y.h THEN 'identical_text_hash' ELSE 'identical_title_and_language' END AS basis, count(*) AS n FROM p JOIN d x ON x.doc_id = p.a JOIN d y ON y.doc_id = p.b GROUP BY 1""")
def duplicate_bases(t: Tables) -> DataFrame:
    """Pairs by hash or title, and the basis of each; one without any would stop the query."""
    d = t.documents.select("doc_id", "lang", F.sha2("text", 256).alias("h"), F.nullif(text.title_key(F.substring("text", 1, 80)), F.lit("")).alias("title"))
    pairs = flatten.star_pairs(d, "doc_id", "hash", "h").union(flatten.star_pairs(d, "doc_id", "title", "lang", "title")).select("a", "b").distinct()
    x, y = (d.select(F.col("doc_id").alias(s), F.struct("h", "lang", "title").alias(f"d{s}")) for s in "ab")
    both = pairs.join(x, "a").join(y, "b")
    basis = rules.duplicate_basis(F.col("da.h") == F.col("db.h"), F.lit(None).cast("double"), (F.col("da.title") == F.col("db.title")) & (F.col("da.lang") == F.col("db.lang")))
    return both.groupBy(basis.alias("basis")).agg(F.count("*").alias("n"))


@query("""SELECT coalesce(CASE WHEN quality = 1 AND toxic = 0 THEN 'include' WHEN toxic = 1 THEN 'exclude' WHEN quality = 0 THEN 'review' END, 'pending') AS decision, coalesce(CASE WHEN quality = 1 AND toxic = 0 THEN 'of quality' WHEN toxic = 1 THEN 'toxic' WHEN quality = 0 THEN 'poor' END, '') AS reason, lang, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ALL""")
def ledger_decisions(t: Tables) -> DataFrame:
    """Documents with the decision and reason that a ledger has for them, or pending."""
    q, x = F.col("quality"), F.col("toxic")
    known = t.labels.select("doc_id", rules.first_match([((q == 1) & (x == 0), "include"), (x == 1, "exclude")], "review").alias("decision"), rules.first_match([((q == 1) & (x == 0), "of quality"), (x == 1, "toxic")], "poor").alias("reason"))
    return rules.allow_list(t.documents.select("doc_id", "lang"), "doc_id", known).groupBy("decision", "reason", "lang").agg(F.count("*").alias("n"))


@query("""SELECT o_custkey, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS keep, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS "drop" FROM orders GROUP BY o_custkey HAVING count(*) = 2""")
def earlier_and_later(t: Tables) -> DataFrame:
    """Customers of two orders: the earlier one is kept."""
    return dedup.earlier_and_later(t.orders.select("o_custkey", "o_orderkey", "o_orderdate"), "o_custkey", "o_orderkey", "o_orderdate")


@query(r"""WITH w AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS t FROM conversations WHERE text IS NOT NULL)
SELECT a.conv_id, a.turn, CAST(len(list_intersect(a.t, b.t)) AS INT) AS shared, CAST(len(list_filter(a.t, lambda x: NOT list_contains(b.t, x))) AS INT) AS only_own, CAST(len(list_filter(b.t, lambda x: NOT list_contains(a.t, x))) AS INT) AS only_next, len(list_intersect(a.t, b.t)) > 0 AS "any",
round(CASE WHEN len(a.t) = 0 OR len(b.t) = 0 THEN 0.0 ELSE len(list_intersect(a.t, b.t)) / (len(a.t) + len(b.t) - len(list_intersect(a.t, b.t)))::DOUBLE END, 6) AS jaccard FROM w a JOIN w b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1""")
def turn_overlaps(t: Tables) -> DataFrame:
    """Words that a turn shares with the next one, as sets; without words on either side the likeness is 0."""
    w = t.conversations.where("text is not null").select("conv_id", "turn", F.array_distinct(text.alnum_tokens(F.col("text"))).alias("t"))
    both = w.join(w.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("t").alias("u")), ["conv_id", "turn"]).select("conv_id", "turn", "t", "u", similarity.overlap(F.col("t"), F.col("u")).alias("o"))
    likeness = F.when((F.size("t") == 0) | (F.size("u") == 0), 0.0).otherwise(similarity.jaccard(F.col("t"), F.col("u")))
    return both.select("conv_id", "turn", F.size("o.shared").alias("shared"), F.size("o.only_a").alias("only_own"), F.size("o.only_b").alias("only_next"), F.col("o.any").alias("any"), F.round(likeness, 6).alias("jaccard"))
