"""Queries on the rule lists, URL rules, formats, bounds and pair joins that texts alone don't reach; signals are taken from number columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..functions.lexicons import AUTHORS, BASE_WEIGHTS, RELEVANCE_RULES, STOP_WORDS, VARIANTS
from ..operators import dedup, features, indices, metrics, rules, shingles, stance
from .analysis import _CRITS, _G, _LANGS, _W, _acceptance
from .corpus import TITLE_SQL
from .registry import Tables, both, query

# --- evidence classes: signals of a text are stood in for by remainders of numbers, so that every branch is reached --------------------------
SIGNALS = {
    "lonmin": "l_quantity % 5", "sibanye": "l_partkey % 3", "case_n": "l_linenumber % 3", "event": "l_orderkey % 6", "social": "(l_partkey + l_orderkey) % 3", "corp": "l_suppkey % 5",
}
FLAGS = {"unusable": "l_extendedprice < 5000", "early": "l_returnflag = 'R'", "actors": "l_partkey % 2 = 0", "forces": "l_suppkey % 2 = 0", "title_case": "l_tax > 0.06", "title_corp": "l_linestatus = 'O'"}
_SIG = ", ".join(f"CAST({e} AS INT) AS {n}" for n, e in SIGNALS.items()) + ", " + ", ".join(f"{e} AS {n}" for n, e in FLAGS.items())
_QUIET, _CONTEXT = "event <= 1 AND social = 0", "(event >= 2 OR social >= 1)"
_EARLY = "early AND lonmin >= 3 AND event >= 3 AND actors"
_VARIANT_SQL = {
    "derived": f"CASE WHEN unusable THEN 'acquisition_exception' WHEN {_EARLY} AND forces THEN 'strong_early_2012_event_context' WHEN case_n > 0 AND ({_CONTEXT} OR title_case) THEN 'strong_case_context_supported' WHEN case_n > 0 AND title_corp AND corp >= 1 AND {_QUIET} THEN 'case_name_only_routine_project_or_corporate_signal' WHEN case_n > 0 THEN 'case_term_low_context_review' WHEN title_corp AND corp >= 2 AND {_QUIET} THEN 'strong_routine_corporate_signal' WHEN corp >= 3 AND {_QUIET} THEN 'likely_routine_corporate_signal' WHEN event >= 3 OR social >= 2 THEN 'possible_substantive_case_context' ELSE 'ambiguous_low_signal' END",
    "archive": f"CASE WHEN unusable THEN 'acquisition_or_text_exception' WHEN {_EARLY} AND forces THEN 'strong_early_2012_event_context' WHEN case_n > 0 AND ({_CONTEXT} OR title_case) THEN 'strong_case_context_supported' WHEN case_n > 0 AND title_corp AND corp >= 1 AND {_QUIET} AND NOT title_case THEN 'case_name_only_routine_project_or_corporate_signal' WHEN case_n > 0 THEN 'case_term_low_context_review' WHEN title_corp AND corp >= 2 AND {_QUIET} AND NOT title_case THEN 'strong_routine_corporate_signal' WHEN corp >= 3 AND {_QUIET} AND NOT title_case THEN 'likely_routine_corporate_signal' WHEN event >= 3 OR social >= 2 OR title_case THEN 'possible_substantive_case_context' ELSE 'ambiguous_low_signal' END",
    "low_signal": f"CASE WHEN unusable THEN 'acquisition_or_text_exception' WHEN {_EARLY} AND forces THEN 'strong_early_2012_event_context' WHEN case_n > 0 AND {_CONTEXT} THEN 'case_context_supported' WHEN title_corp AND corp >= 2 AND {_QUIET} AND case_n = 0 THEN 'strong_routine_corporate_signal' WHEN corp >= 3 AND {_QUIET} AND case_n = 0 THEN 'likely_routine_corporate_signal' WHEN event >= 3 OR social >= 2 THEN 'possible_substantive_case_context' ELSE 'ambiguous_low_signal' END",
    "secondary": f"CASE WHEN unusable THEN 'acquisition_or_text_exception' WHEN {_EARLY} THEN 'strong_early_2012_event_context' WHEN case_n > 0 AND ({_CONTEXT} OR title_case) THEN 'strong_case_context_supported' WHEN lonmin >= 3 AND (event >= 3 OR social >= 2) THEN 'strong_lonmin_context_supported' WHEN case_n > 0 AND title_corp AND corp >= 1 AND {_QUIET} THEN 'case_name_only_routine_project_or_corporate_signal' WHEN case_n > 0 THEN 'case_term_low_context_review' WHEN lonmin > 0 AND {_CONTEXT} THEN 'possible_lonmin_substantive_context' WHEN lonmin > 0 THEN 'lonmin_low_context_review' WHEN sibanye > 0 AND {_CONTEXT} THEN 'sibanye_context_without_case_anchor_review' WHEN title_corp AND corp >= 2 AND {_QUIET} THEN 'strong_routine_no_case_anchor' WHEN case_n = 0 AND lonmin = 0 AND sibanye = 0 THEN 'no_case_anchor' ELSE 'ambiguous_secondary_review' END",
}


def _signals(t: Tables) -> DataFrame:
    return t.lineitem.select("l_shipdate", "l_returnflag", *(F.expr(f"CAST({e} AS INT)").alias(n) for n, e in SIGNALS.items()), *(F.expr(e).alias(n) for n, e in FLAGS.items()))


def _class(variant: str):
    return rules.evidence_variant(variant, **{n: F.col(n) for n in (*FLAGS, *SIGNALS)})


@query(f"WITH s AS (SELECT {_SIG} FROM lineitem), v AS (" + " UNION ALL ".join(f"SELECT '{v}' AS variant, {e} AS class FROM s" for v, e in _VARIANT_SQL.items()) + ") SELECT variant, class, count(*) AS n FROM v GROUP BY variant, class")
def evidence_variants(t: Tables) -> DataFrame:
    """All four rule lists over the same signals, in one pass."""
    pairs = F.explode(F.array(*(F.struct(F.lit(v).alias("variant"), _class(v).alias("class")) for v in rules.VARIANTS)))
    return _signals(t).select(pairs.alias("p")).groupBy("p.variant", "p.class").agg(F.count("*").alias("n"))


@query(f"SELECT guarded, count(*) AS n FROM (SELECT early OR lonmin >= 2 OR (case_n >= 2 AND event >= 4) OR (case_n >= 2 AND event >= 3 AND forces) AS guarded FROM (SELECT {_SIG} FROM lineitem)) GROUP BY guarded")
def case_guards(t: Tables) -> DataFrame:
    guard = rules.case_guard(F.col("early"), F.col("lonmin"), F.col("case_n"), F.col("event"), F.col("forces"))
    return _signals(t).groupBy(guard.alias("guarded")).agg(F.count("*").alias("n"))


@query(f"""WITH s AS (SELECT l_returnflag AS title, year(l_shipdate) + 14 AS y, {_SIG} FROM lineitem), c AS (SELECT *, {_VARIANT_SQL['secondary']} AS class FROM s)
SELECT CASE WHEN y = 2014 THEN 'include_2014_platinum_strike_lonmin' ELSE 'include_lonmin_marikana_labour_governance' END AS reason, count(*) AS n FROM c
WHERE class IN ('strong_case_context_supported', 'possible_lonmin_substantive_context') AND y IN (2013, 2014) AND lonmin >= 1 AND event >= 4 AND title IN ('A', 'N') GROUP BY 1""")
def temporal_labour(t: Tables) -> DataFrame:
    reason = rules.temporal_labour(_class("secondary"), F.year("l_shipdate") + 14, F.col("lonmin"), F.col("event"), F.col("l_returnflag"), "^[AN]$")
    return _signals(t).select(reason.alias("reason")).where("reason is not null").groupBy("reason").agg(F.count("*").alias("n"))


# --- URLs and years ----------------------------------------------------------------------------------------------------------------------
_MADE = "'https://www.example.org/' || CASE page_id % 4 WHEN 0 THEN 'news/2012-08-' || lpad(CAST(page_id % 28 + 1 AS VARCHAR{n}), 2, '0') || '-strike-at-mine' WHEN 1 THEN 'article/mine_' || CAST(page_id % 9 AS VARCHAR{n}) WHEN 2 THEN CAST(2005 + page_id % 30 AS VARCHAR{n}) || '/union-talks-' || CAST(page_id % 7 AS VARCHAR{n}) ELSE 'sport/o''neil-2nd-day-2013-05-01-2' END"


def _urls(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.expr(_MADE.format(n="(20)").replace("''", "\\'")).alias("u"))


_URLS = f"u AS (SELECT page_id, {_MADE.format(n='')} AS u FROM pages)"
_YEAR = "coalesce(nullif(regexp_extract(u, '(20[0-9]{2})-[0-9]{2}-[0-9]{2}', 1), ''), nullif(regexp_extract(u, '/(20[0-9]{2})/', 1), ''))"


@query(f"WITH {_URLS} SELECT count(*) AS n, count_if(regexp_matches(u, 'strike|union|mine') AND (coalesce(try_cast(nullif(regexp_extract(u, '(?:^|[-_/])(201[0-9]|202[0-3])(?:[-_/]|$)', 1), '') AS INT) BETWEEN 2010 AND 2023, false) OR contains(u, '/article/'))) AS kept FROM u")
def keyword_urls(t: Tables) -> DataFrame:
    return _urls(t).agg(F.count("*").alias("n"), F.count_if(rules.keyword_url(F.col("u"), ["strike", "union", "mine"])).alias("kept"))


@query(f"""WITH {_URLS}, y AS (SELECT page_id, u, CAST({_YEAR} AS INT) AS y, row_number() OVER (PARTITION BY u ORDER BY page_id) AS rn FROM u)
SELECT CASE WHEN page_id % 11 = 0 THEN 'already_screened' WHEN rn > 1 THEN 'duplicate_discovery_url' WHEN y < 2010 OR y > 2023 THEN 'exclude_outside_period' WHEN y IS NULL THEN 'review_year_unresolved' WHEN contains(u, 'strike') THEN 'explicit_case_title_review' WHEN contains(u, 'union') THEN 'lonmin_only_title_review' ELSE 'secondary_keyword_only_review' END AS status, count(*) AS n FROM y GROUP BY 1""")
def prescreen_statuses(t: Tables) -> DataFrame:
    """All branches; whether a URL was seen before is its place among equal ones, found from the least id by a grouped minimum."""
    u = _urls(t).withColumn("y", text.year_in(F.col("u")))
    first = u.groupBy("u").agg(F.min("page_id").alias("first"))
    status = rules.prescreen(F.col("page_id") % 11 == 0, F.col("page_id") > F.col("first"), F.col("y"), F.col("u").contains("strike"), F.col("u").contains("union"))
    return u.join(first, "u").groupBy(status.alias("status")).agg(F.count("*").alias("n"))


@query("SELECT l_returnflag, count(*) AS n FROM lineitem WHERE year(l_shipdate) BETWEEN 1994 AND 1999 GROUP BY l_returnflag")
def years_in_period(t: Tables) -> DataFrame:
    """The year as text; one that is no number stops the query."""
    return t.lineitem.where(rules.in_period(F.date_format("l_shipdate", "yyyy"), 1994, 1999)).groupBy("l_returnflag").agg(F.count("*").alias("n"))


_SLUG = "trim(regexp_replace(regexp_replace(regexp_replace(regexp_extract(u, '([^/]*)$', 1), '^20[0-9]{2}-[0-9]{2}-[0-9]{2}-', ''), '-20[0-9]{2}-[0-9]{2}-[0-9]{2}(?:-[0-9]+)?$', ''), '[-_]+', ' ', 'g'))"


@query(rf"""WITH {_URLS} SELECT page_id, CAST({_YEAR} AS INT) AS y, array_to_string(list_transform(regexp_extract_all({_SLUG}, '[a-z]+|[^a-z]+'), lambda x: upper(x[1]) || x[2:]), '') AS title,
regexp_replace(regexp_extract(u, '://([^/]*)', 1), '^www\.', '') AS host, array_to_string([CAST(page_id % 2 = 0 AS VARCHAR), 'x'], ';') AS flags FROM u""")
def url_parts(t: Tables) -> DataFrame:
    """Years of two shapes, titles from slugs, hosts without prefix, joined flags."""
    u = F.col("u")
    host = text.strip_prefix(F.lower(F.regexp_extract(u, "://([^/]*)", 1)), "www.")
    return _urls(t).select("page_id", text.year_in(u).alias("y"), text.slug_title(u).alias("title"), host.alias("host"), F.concat_ws(";", text.flag(F.col("page_id") % 2 == 0), F.lit("x")).alias("flags"))


# --- numbers and texts -------------------------------------------------------------------------------------------------------------------
@query("""SELECT event_type, count(*) AS n, CAST(sum(least(greatest((value / 20 - 2.5 + 2.5) / 5, 0.0), 1.0)) AS DECIMAL(18, 4)) AS wgi, CAST(sum(round_even(event_id * 0.125, 2)) AS DECIMAL(18, 2)) AS even,
max(printf('%.6f', value)) AS most, CAST(sum(coalesce(try_cast(CASE WHEN event_id % 3 = 0 THEN 'x' ELSE CAST(event_id AS VARCHAR) END AS INT), 0)) AS BIGINT) AS whole FROM events GROUP BY event_type""")
def number_forms(t: Tables) -> DataFrame:
    """Clipped shares, rounding of halves to even, fixed formats, numbers from text."""
    wild = F.when(F.col("event_id") % 3 == 0, "x").otherwise(F.col("event_id").cast("string"))
    even = text.half_even((F.col("event_id") * F.lit(0.125)).cast("decimal(18,3)"), 2)
    return t.events.groupBy("event_type").agg(
        F.count("*").alias("n"), F.sum(text.wgi(F.col("value") / 20 - 2.5)).cast("decimal(18,4)").alias("wgi"), F.sum(even).cast("decimal(18,2)").alias("even"),
        F.max(text.fixed(F.col("value"), 6)).alias("most"), F.sum(text.int_or_zero(wild)).alias("whole"),
    )


@query(r"""WITH p AS (SELECT doc_id, text, regexp_replace(regexp_replace(replace(text, chr(0), ' '), '\r\n?', chr(10), 'g'), '[ \t\f]+', ' ', 'g') AS a FROM documents)
SELECT doc_id, sha256(trim(regexp_replace(regexp_replace(a, ' ?\n ?', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'))) AS paragraphs, CASE WHEN length(text) > 0 THEN sha256(text) ELSE '' END AS own,
regexp_full_match(sha256(text), '[0-9a-f]{64}') AS valid, sha256(array_to_string(list_filter(regexp_split_to_array(text, '[ \t\n\x0B\f\r]+'), lambda w: w <> '')[1:1200], ' ')) AS beginning FROM p""")
def text_forms(t: Tables) -> DataFrame:
    """Paragraphs kept, hashes and their test, the first 1,200 words."""
    x = F.col("text")
    own = text.sha256_or_empty(x)
    return t.documents.select("doc_id", F.sha2(text.norm_paragraphs(x), 256).alias("paragraphs"), own.alias("own"), text.valid_sha256(F.sha2(x, 256)).alias("valid"), F.sha2(text.first_words(x), 256).alias("beginning"))


# --- authors, lexicon variants, bounds ----------------------------------------------------------------------------------------------------
BYLINES = [
    ("Lonmin plc", "Results"), ("The AMCU", "Statement on wages"), ("Daily", "NUM rejects offer"), ("Legal Resources Centre", "Families speak"), ("Daily", "Injured and arrested miners"),
    ("Office", "Minister answers"), ("Bench Marks Foundation", "Report"), ("Daily", "Platinum price rises"), (None, None),
]
_text = lambda x: "NULL" if x is None else f"'{x}'"
_BY = " UNION ALL ".join(f"SELECT {k} AS k, {_text(p)} AS p, {_text(h)} AS h" for k, (p, h) in enumerate(BYLINES))
_AUTHOR = "CASE " + " ".join(f"WHEN regexp_matches({'lower(coalesce(p, {e}))' if on else 'lower(coalesce(p, {e}) || {b} || coalesce(h, {e}))'}, '{on or both_}') THEN '{g}'".replace("{e}", "''").replace("{b}", "' '") for g, on, both_ in AUTHORS) + " END"


@query(f"SELECT k, {_AUTHOR} AS author FROM ({_BY}) x")
def author_groups(t: Tables) -> DataFrame:
    rows = t.spark.createDataFrame([(k, *x) for k, x in enumerate(BYLINES)], "k int, p string, h string")
    return rows.select("k", stance.author_group(F.col("p"), F.col("h")).alias("author"))


SAID = [
    "Local employment fell and retrenchments followed the wage dispute at the shaft.", "The net present value and cash flow of the project rose with revenue.", "Shareholder return and earnings per share beat the internal rate of return.",
    "Workers and employees asked for housing, water and roads in the community.", "Job creation and local hiring were promised by the mine last year.", "Platinum price and market demand remained weak during the quarter.",
]
_SAID = " UNION ALL ".join(f"SELECT {k} AS k, '{s}' AS s" for k, s in enumerate(SAID))
_HITS = " UNION ALL ".join(f"SELECT k, '{v}' AS variant, '{c}' AS criterion, " + " + ".join(f"CAST(regexp_matches(s, '(?i){p}') AS BIGINT)" for p in patterns) + " AS families FROM s" for v, crit in VARIANTS.items() for c, patterns in crit.items())


@query(f"WITH s AS ({_SAID}) SELECT variant, criterion, k, families FROM ({_HITS}) x WHERE families > 0")
def lexicon_variants(t: Tables) -> DataFrame:
    """Families of each variant of the criteria's lexicon that a sentence holds."""
    rows = t.spark.createDataFrame(list(enumerate(SAID)), "k int, s string")
    cells = [F.struct(F.lit(v).alias("variant"), F.lit(c).alias("criterion"), text.families_hit(F.col("s"), p).alias("families")) for v, crit in VARIANTS.items() for c, p in crit.items()]
    return rows.select("k", F.explode(F.array(*cells)).alias("x")).select("x.variant", "x.criterion", "k", "x.families").where("families > 0")


@query("""WITH c AS (SELECT user_id % 10 AS g, count_if(value >= 60) AS p, count_if(value < 40) AS q, count_if(value >= 40 AND value < 60) AS u FROM events GROUP BY 1)
SELECT g, round(p / (p + q + u), 8) AS low, round((p + u) / (p + q + u), 8) AS high, round(q / (p + q + u), 8) AS least_negative, CAST(greatest(0, floor((p + q + u) / 2) + 1 - p - u) AS BIGINT) AS flips_to_majority, CAST(greatest(0, ceil(0.65 * (p + q + u)) - p - u) AS BIGINT) AS flips_to_share FROM c""")
def bounds_of_unresolved(t: Tables) -> DataFrame:
    v = F.col("value")
    c = t.events.groupBy((F.col("user_id") % 10).alias("g")).agg(F.count_if(v >= 60).alias("p"), F.count_if(v < 40).alias("q"), F.count_if((v >= 40) & (v < 60)).alias("u"))
    got = c.select("g", *metrics.conservative_bounds(F.col("p"), F.col("q"), F.col("u"), 0.65))
    return got.select("g", *(F.round(x, 8).alias(x) for x in ("low", "high", "least_negative")), "flips_to_majority", "flips_to_share")


# --- the grid of relevance thresholds, modes, deltas and criteria --------------------------------------------------------------------------
DELTAS = [0.0, 0.1, 0.3, 0.5, 0.8]
_RULES = " UNION ALL ".join(f"SELECT {s} AS s, {f} AS f" for s, f in RELEVANCE_RULES)
_DELTAS = " UNION ALL ".join(f"SELECT CAST({d} AS DOUBLE) AS delta" for d in DELTAS)


@query(f"""WITH w AS ({_W}), g AS ({_G}), la AS ({_LANGS}), cr AS ({_CRITS}), ru AS ({_RULES}),
acc AS (SELECT la.grp, g.sic, coalesce(avg(CASE WHEN d.n_chars > 1500 THEN 1.0 WHEN d.n_chars IS NOT NULL THEN 0.0 END), 0.5) AS p FROM la JOIN g ON la.grp = g.grp LEFT JOIN documents d ON d.lang = la.lang GROUP BY la.grp, g.sic),
mat AS (SELECT la.grp, cr.criterion, ru.s, ru.f, coalesce(avg(CASE WHEN (d.n_chars + k) % 5 >= ru.s AND (d.n_chars + 2 * k) % 4 >= ru.f THEN 1.0 ELSE 0.0 END), 0.0) AS share FROM la CROSS JOIN cr CROSS JOIN ru LEFT JOIN documents d ON d.lang = la.lang GROUP BY la.grp, cr.criterion, ru.s, ru.f),
pr AS (SELECT mat.criterion, mat.s, mat.f, m.mode, sum(acc.sic * (CASE WHEN m.mode = 'full' THEN 1 - acc.p ELSE 1.0 END) * mat.share) / sum(acc.sic * (CASE WHEN m.mode = 'full' THEN 1 - acc.p ELSE 1.0 END)) AS gj FROM mat JOIN acc ON mat.grp = acc.grp CROSS JOIN (SELECT 'full' AS mode UNION ALL SELECT 'sic') m GROUP BY ALL),
z AS (SELECT pr.*, dl.delta, w.w0, w.w0 * (1 + dl.delta * pr.gj) AS x FROM pr JOIN w ON w.criterion = pr.criterion CROSS JOIN ({_DELTAS}) dl)
SELECT s, f, mode, delta, criterion, round(gj, 8) AS pressure, round(x / sum(x) OVER (PARTITION BY s, f, mode, delta), 8) AS weight FROM z""")
def threshold_grid(t: Tables) -> DataFrame:
    """Weights for each threshold, mode, delta and criterion; prevalences of all thresholds come from one pass over the documents."""
    acc, _ = _acceptance(t)
    crit = {c: k for k, c in enumerate(BASE_WEIGHTS)}
    n = F.col("n_chars")
    flags = [F.avg((((n + k) % 5 >= s) & ((n + 2 * k) % 4 >= f)).cast("double")).alias(f"c{k}_{s}_{f}") for k in crit.values() for s, f in RELEVANCE_RULES]
    lang = acc.join(F.broadcast(t.spark.createDataFrame([("government", "en"), ("investor", "fr"), ("community", "de"), ("labour", "es"), ("NGO", "xx")], "group string, lang string")), "group").select("group", "lang")
    wide = lang.join(t.documents.groupBy("lang").agg(*flags), "lang", "left")
    cells = [F.struct(F.lit(c).alias("criterion"), F.lit(s).alias("s"), F.lit(f).alias("f"), F.coalesce(F.col(f"c{k}_{s}_{f}"), F.lit(0.0)).alias("share")) for c, k in crit.items() for s, f in RELEVANCE_RULES]
    mat = wide.select("group", F.explode(F.array(*cells)).alias("x")).select("group", "x.*")
    deltas, out = t.spark.createDataFrame([(d,) for d in DELTAS], "delta double"), None
    for mode in ("full", "sic"):
        for s, f in RELEVANCE_RULES:
            r = indices.revised_weights(indices.base_weights(t.spark), indices.pressure(mat.where((F.col("s") == s) & (F.col("f") == f)).drop("s", "f"), acc, mode), deltas)
            r = r.select(F.lit(s).alias("s"), F.lit(f).alias("f"), F.lit(mode).alias("mode"), "delta", "criterion", F.round("g", 8).alias("pressure"), F.round("weight", 8).alias("weight"))
            out = r if out is None else out.union(r)
    return out


# --- pairs of texts ----------------------------------------------------------------------------------------------------------------------
_STOPS = ", ".join(f"'{x}'" for x in STOP_WORDS)
_GRAMS = f"""WITH tok AS (SELECT doc_id AS id, list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: NOT list_contains([{_STOPS}], x)) AS t FROM documents),
tf AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(t) AS term FROM tok UNION ALL SELECT id, unnest(list_transform(list_zip(t[1:len(t) - 1], t[2:len(t)]), lambda p: p[1] || ' ' || p[2])) FROM tok WHERE len(t) > 1) x GROUP BY id, term),
n AS (SELECT count(*) AS n FROM documents), df AS (SELECT term, count(*) AS df, sum(tf) AS total FROM tf GROUP BY term),
v AS (SELECT term, df FROM df, n WHERE df >= 2 AND df <= 0.9 * n ORDER BY total DESC, term LIMIT 500),
raw AS (SELECT id, tf.term, (1 + ln(tf)) * (ln((1.0 + n) / (1 + df)) + 1) AS w FROM tf JOIN v ON tf.term = v.term, n),
u AS (SELECT id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM raw)"""


def _grams(t: Tables) -> DataFrame:
    return features.tfidf(features.terms(t.documents, "doc_id", "text", STOP_WORDS, bigrams=True, top=500), t.documents.count())


@query(_GRAMS + " SELECT term, count(*) AS docs, round(sum(w), 5) AS total FROM u GROUP BY term")
def tfidf_bigrams(t: Tables) -> DataFrame:
    """500 words and word pairs without English stop words."""
    return _grams(t).groupBy("term").agg(F.count("*").alias("docs"), F.round(F.sum("w"), 5).alias("total"))


_PHASE_SQL = "CAST(regexp_extract(source, '([0-9]+)$', 1) AS INT) % 2"


@query(f"""WITH s AS (SELECT doc_id, lang, {_PHASE_SQL} AS phase, sha256(text) AS h, substring({TITLE_SQL.replace('text', 'substring(text, 1, 80)')}, 1, 40) AS title, n_chars // 100 AS size FROM documents),
p AS (SELECT a.doc_id AS id_a, b.doc_id AS id_b, 0 AS k, 'same_text_and_title' AS reason FROM s a JOIN s b ON a.h = b.h AND a.title = b.title WHERE a.phase = 0 AND b.phase = 1
UNION ALL SELECT a.doc_id, b.doc_id, 1, 'same_text_and_language' FROM s a JOIN s b ON a.h = b.h AND a.lang = b.lang WHERE a.phase = 0 AND b.phase = 1
UNION ALL SELECT a.doc_id, b.doc_id, 2, 'same_title_language_size' FROM s a JOIN s b ON a.title = b.title AND a.lang = b.lang AND a.size = b.size WHERE a.phase = 0 AND b.phase = 1 AND a.title <> '')
SELECT id_a, id_b, arg_min(reason, k) AS reason, count(*) AS n_reasons, CASE WHEN min(k) = 2 THEN 'review' ELSE 'safe' END AS disposition FROM p GROUP BY id_a, id_b""")
def cross_source_pairs(t: Tables) -> DataFrame:
    """Documents of even and odd sources, all of them: two keys that are safe, and a third that is for review only."""
    phase = F.regexp_extract("source", "([0-9]+)$", 1).cast("int") % 2
    title = F.nullif(F.substring(text.title_key(F.substring("text", 1, 80)), 1, 40), F.lit(""))
    s = t.documents.select("doc_id", "lang", phase.alias("phase"), F.sha2("text", 256).alias("h"), F.coalesce(title, F.lit("")).alias("title"), title.alias("own_title"), F.floor(F.col("n_chars") / 100).alias("size"))
    keys = {"same_text_and_title": ["h", "title"], "same_text_and_language": ["h", "lang"]}
    return dedup.or_key_pairs(s.where("phase = 0"), s.where("phase = 1"), "doc_id", keys, {"same_title_language_size": ["own_title", "lang", "size"]})


@query(_GRAMS + " SELECT a.id AS a, b.id AS b, round(sum(a.w * b.w), 5) AS cosine FROM u a JOIN u b ON a.term = b.term AND a.id < b.id GROUP BY a.id, b.id HAVING sum(a.w * b.w) >= 0.9")
def tfidf_pairs(t: Tables) -> DataFrame:
    """All pairs of documents whose TF-IDF vectors have a cosine of 0.9 or more."""
    return dedup.cosine_pairs(_grams(t), 0.9).select("a", "b", F.round("cosine", 5).alias("cosine"))


_SHINGLED = r"""WITH d AS (SELECT doc_id, lang, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM documents),
s AS (SELECT doc_id, lang || '|' || coalesce(t[1], '') AS b, list_distinct(CASE WHEN len(t) >= 5 THEN list_transform(range(1, len(t) - 3), lambda i: array_to_string(t[i:i + 4], ' ')) WHEN len(t) > 0 THEN [array_to_string(t, ' ')] ELSE [] END) AS s FROM d)"""


@query(_SHINGLED + " SELECT a.doc_id AS a, b.doc_id AS b, round(CAST(len(list_intersect(a.s, b.s)) AS DOUBLE) / (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s))), 6) AS jaccard FROM s a JOIN s b ON a.b = b.b AND a.doc_id < b.doc_id WHERE len(a.s) > 0 AND len(b.s) > 0 AND CAST(len(list_intersect(a.s, b.s)) AS DOUBLE) / (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s))) >= 0.6")
def shingle_pairs(t: Tables) -> DataFrame:
    """Pairs of equal language and first word whose five-word shingles are alike by 0.6 or more; those of texts without a language are no pairs."""
    block = F.concat("lang", F.lit("|"), F.coalesce(F.regexp_extract(F.lower("text"), "[a-z0-9]+", 0), F.lit("")))
    return shingles.shingle_jaccard(t.documents, "doc_id", block, "text", 0.6).select("a", "b", F.round("jaccard", 6).alias("jaccard"))


both("map_defaults", "SELECT event_type, coalesce(try_element_at(map('view', 1, 'click', 2), event_type), 0) AS code, count(*) AS n FROM {events} GROUP BY event_type", "SELECT event_type, coalesce(MAP {{'view': 1, 'click': 2}}[event_type], 0) AS code, count(*) AS n FROM events GROUP BY event_type")
