"""Queries on readings, actors, criteria, models, indices and grids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..functions.lexicons import BASE_WEIGHTS, PLU, SCENARIOS, SIC, STOP_WORDS
from ..operators import features, grids, indices, metrics, rules, stance
from .corpus import ASCII_SQL, _ascii
from .registry import Tables, query

# Stand-ins for lexicons whose words occur in the supplied texts.
POSITIVE, NEGATIVE = [r"\bthe\b", r"\bund\b"], [r"\band\b", r"\best\b"]
ACTORS = {"NGO": [r"\bwith\b"], "community": [r"\band\b", r"\best\b"], "government": [r"\bthe\b", r"\bder\b"], "labour": [r"\bby\b", r"\bque\b"]}
SPEECH = r"\bfor\b"
CRITERIA = {"alpha": [r"\bthe\b", r"\bder\b"], "beta": [r"\band\b", r"\bund\b"], "gamma": [r"\blicensed\b", r"\breleased\b"]}
POWER, LEGIT, URGENT = ["the", "est"], ["and", "und"], ["with", "for", "the"]

# Sentences of texts in which other characters than ASCII are masked: word boundaries then agree between engines.
SENT = r"list_filter(list_transform(regexp_split_to_array(regexp_replace(a, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1) || '|\n+'), lambda z: trim(z)), lambda z: length(z) >= 25)"
DOCS_SQL = f"d AS (SELECT doc_id, lang, {ASCII_SQL} AS a FROM documents), s AS (SELECT doc_id, lang, substring(a, 1, 80) AS title, {SENT} AS s FROM d)"


def _hit(c: str, p: str) -> str:
    return f"CAST(regexp_matches({c}, '(?i){p}') AS INT)"


def _any(patterns: list[str]) -> str:
    return "(?i)" + "|".join(f"(?:{p})" for p in patterns)


def _docs(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", "lang", _ascii(F.col("text")).alias("a"))


def _sum(c: str, patterns: list[str]) -> str:
    return "(" + " + ".join(_hit(c, p) for p in patterns) + ")"


READ_SQL = f"""r AS (SELECT doc_id, lang, len(list_filter(s, lambda z: regexp_matches(z, '{_any(POSITIVE)}'))) AS pos, len(list_filter(s, lambda z: regexp_matches(z, '{_any(NEGATIVE)}'))) AS neg,
{_sum("title", POSITIVE)} - {_sum("title", NEGATIVE)} AS lead FROM s),
ab AS (SELECT doc_id, lang, pos, neg, ln(1 + pos) - ln(1 + neg) + 1.15 * lead AS a, sqrt(CAST(pos AS DOUBLE)) - sqrt(CAST(neg AS DOUBLE)) + 1.5 * lead AS b FROM r)"""


def _readings(t: Tables) -> DataFrame:
    title, lex = F.substring("a", 1, 80), {"positive": POSITIVE, "negative": NEGATIVE}
    d = stance.with_sentences(_docs(t), F.col("a"), "s")
    r = d.select("doc_id", "lang", stance.reading(title, F.col("s"), lex, "A").alias("ra"), stance.reading(title, F.col("s"), lex, "B").alias("rb"))
    return r.select("doc_id", "lang", F.col("ra.positive").alias("pos"), F.col("ra.negative").alias("neg"), F.col("ra.score").alias("a"), F.col("rb.score").alias("b"), F.col("ra.label").alias("label_a"), F.col("rb.label").alias("label_b"))


@query(f"WITH {DOCS_SQL}, {READ_SQL} SELECT doc_id, CAST(pos AS BIGINT) AS pos, CAST(neg AS BIGINT) AS neg, round(a, 6) AS a, round(b, 6) AS b, CAST(a >= 0 AS INT) AS label_a, CAST(b >= 0 AS INT) AS label_b FROM ab")
def stance_readings(t: Tables) -> DataFrame:
    return _readings(t).select("doc_id", "pos", "neg", F.round("a", 6).alias("a"), F.round("b", 6).alias("b"), "label_a", "label_b")


@query(f"""WITH {DOCS_SQL}, {READ_SQL}, c AS (SELECT *, least(1.0, (abs(a) + abs(b)) / 5) AS conf, (a >= 0) = (b >= 0) AS same FROM ab)
SELECT lang, count_if(same AND conf >= 0.18) AS agreed, count_if(NOT (same AND conf >= 0.18)) AS review, round(avg(conf), 6) AS confidence FROM c GROUP BY lang""")
def two_readings(t: Tables) -> DataFrame:
    r = _readings(t).withColumn("d", stance.two_readings(F.col("a"), F.col("b"), F.col("label_a"), F.col("label_b")))
    return r.groupBy("lang").agg(F.count_if(~F.col("d.needs_review")).alias("agreed"), F.count_if("d.needs_review").alias("review"), F.round(F.avg("d.confidence"), 6).alias("confidence"))


@query(f"""WITH {DOCS_SQL}, {READ_SQL}, c AS (SELECT doc_id, 0.6 * round(a, 5) + (1 - 0.6) * round(b, 5) AS s FROM ab)
SELECT doc_id, round(s, 5) AS score, CASE WHEN abs(s) >= 0.3 THEN CAST(s > 0 AS INT) END AS label, CASE WHEN abs(s) >= 0.3 THEN round(least(1.0, abs(s) / 3), 5) END AS confidence FROM c""")
def adjudicated_stance(t: Tables) -> DataFrame:
    """Scores are taken as their five-decimal text gives them."""
    r = _readings(t).select("doc_id", stance.adjudicated(F.round("a", 5), F.round("b", 5)).alias("d"))
    return r.select("doc_id", F.round("d.score", 5).alias("score"), F.col("d.label").alias("label"), F.round("d.confidence", 5).alias("confidence"))


def _cnt(col: str, term: str) -> str:
    return f"CAST((length({col}) - length(replace({col}, '{term}', ''))) / {len(term)} AS BIGINT)"


_P, _L, _U = (" + ".join(_cnt("lower(text)", x) for x in terms) for terms in (POWER, LEGIT, URGENT))


@query(f"WITH h AS (SELECT doc_id, {_P} AS p, {_L} AS l, {_U} AS u FROM documents) SELECT doc_id, round(coalesce(p / nullif(p + l + u, 0), 0.0), 6) AS P, round(coalesce(l / nullif(p + l + u, 0), 0.0), 6) AS L, round(coalesce(u / nullif(p + l + u, 0), 0.0), 6) AS U FROM h")
def plu_shares(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", stance.plu_shares(F.col("text"), POWER, LEGIT, URGENT).alias("s")).select("doc_id", *(F.round(f"s.{x}", 6).alias(x) for x in "PLU"))


VOICE_SQL = " UNION ALL ".join(
    f"SELECT doc_id, '{g}' AS grp, 3.0 * {_sum('title', p)} + coalesce(list_sum(list_transform(s, lambda z: {_sum('z', p)} * CASE WHEN regexp_matches(z, '(?i){SPEECH}') THEN 2.5 ELSE 0.35 END)), 0.0) AS score FROM s" for g, p in ACTORS.items()
)


@query(f"""WITH {DOCS_SQL}, v AS (SELECT doc_id, grp, CAST(score AS DOUBLE) AS score FROM ({VOICE_SQL}) x),
k AS (SELECT doc_id, grp, round(score, 6) AS top, row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 6) DESC, grp) AS rn, lead(round(score, 6)) OVER (PARTITION BY doc_id ORDER BY round(score, 6) DESC, grp) AS second FROM v)
SELECT doc_id, grp AS actor, round(top, 4) AS top, round((top - second) / greatest(top, 1.0), 4) AS margin FROM k WHERE rn = 1""")
def dominant_voice(t: Tables) -> DataFrame:
    scores = stance.voice_scores(_docs(t), "doc_id", F.substring("a", 1, 80), F.col("a"), ACTORS, SPEECH).withColumn("score", F.round("score", 6))
    return stance.dominant(scores, "doc_id").select("doc_id", F.col("group").alias("actor"), F.round("top", 4).alias("top"), F.round("margin", 4).alias("margin"))


@query()
def adjudicated_actors(t: Tables) -> DataFrame:
    """Third pass: lead sentences count more, and a group alone in the title wins."""
    d = _docs(t)
    title = F.substring("a", 1, 80)
    scores = stance.voice_scores(d, "doc_id", title, F.col("a"), ACTORS, SPEECH, 4.0, 3.0, 0.0, lead=12, lead_weight=0.8)
    names = F.array_compact(F.array(*(F.when(text.families_hit(title, p) > 0, F.lit(g)) for g, p in ACTORS.items())))
    in_title = d.select("doc_id", names.alias("n")).select("doc_id", F.try_element_at("n", F.lit(1)).alias("title_group"), F.size("n").alias("n_title_groups"))
    return stance.adjudicated_actor(stance.dominant(scores, "doc_id"), in_title, "doc_id")


REL_SQL = " UNION ALL ".join(
    f"SELECT doc_id, lang, '{c}' AS criterion, len(list_filter(s, lambda z: regexp_matches(z, '{_any(p)}'))) AS m, " + " + ".join(f"CAST(len(list_filter(s, lambda z: regexp_matches(z, '(?i){x}'))) > 0 AS INT)" for x in p) + " AS f FROM s"
    for c, p in CRITERIA.items()
)


@query(f"WITH {DOCS_SQL} SELECT doc_id, criterion, CAST(m AS BIGINT) AS matched, CAST(f AS BIGINT) AS families, m >= 2 AND f >= 2 AS relevant FROM ({REL_SQL}) x")
def criterion_relevance(t: Tables) -> DataFrame:
    r = stance.criterion_relevance(_docs(t), "doc_id", F.col("a"), CRITERIA, ((2, 2),))
    return r.select("doc_id", "criterion", F.col("matched_sentences").alias("matched"), "families", F.col("relevant_2_2").alias("relevant"))


@query(f"""WITH {DOCS_SQL}, r AS (SELECT lang, criterion, sum(CASE WHEN m >= 2 AND f >= 1 THEN 1 ELSE 0 END) AS relevant, count(*) AS recovered FROM ({REL_SQL}) x GROUP BY lang, criterion)
SELECT lang AS grp, criterion, CAST(recovered AS BIGINT) AS recovered, CAST(relevant AS BIGINT) AS relevant, round(relevant / recovered, 8) AS share FROM r""")
def prevalence_matrix(t: Tables) -> DataFrame:
    d = _docs(t)
    r = stance.criterion_relevance(d, "doc_id", F.col("a"), CRITERIA, ((2, 1),))
    p = stance.prevalence(d.select("doc_id", F.col("lang").alias("group")), r, "doc_id", list(CRITERIA), "relevant_2_1")
    return p.select(F.col("group").alias("grp"), "criterion", "recovered", F.col("relevant").cast("long").alias("relevant"), F.round("share", 8).alias("share"))


@query(f"""WITH {DOCS_SQL}, x AS (SELECT doc_id, len(s) AS n, length(a) AS chars, {_sum("title", POSITIVE)} > 0 AS tc, {_sum("title", NEGATIVE)} > 0 AS tp, len(regexp_extract_all(a, '(?i){POSITIVE[0]}')) AS c, {_sum("a", NEGATIVE + POSITIVE)} AS e, {_sum("a", CRITERIA["gamma"])} AS so FROM s JOIN d USING (doc_id)),
k AS (SELECT CASE WHEN chars < 500 THEN 'acquisition_or_text_exception' WHEN c > 0 AND (e >= 2 OR so >= 1 OR tc) THEN 'strong_case_context_supported' WHEN c > 0 THEN 'case_term_low_context_review' WHEN e >= 3 OR so >= 2 OR tc THEN 'possible_substantive_case_context' ELSE 'ambiguous_low_signal' END AS class FROM x)
SELECT class, count(*) AS n FROM k GROUP BY class""")
def evidence_classes(t: Tables) -> DataFrame:
    a, title, none = F.col("a"), F.substring("a", 1, 80), F.lit(False)
    k = rules.evidence_variant(
        "archive", unusable=F.length("a") < 500, early=none, actors=none, forces=none, lonmin=F.lit(0), sibanye=F.lit(0), case_n=text.pattern_count(a, POSITIVE[0]), event=text.families_hit(a, NEGATIVE + POSITIVE),
        social=text.families_hit(a, CRITERIA["gamma"]), corp=F.lit(0), title_case=text.families_hit(title, POSITIVE) > 0, title_corp=none,
    )
    return _docs(t).groupBy(k.alias("class")).agg(F.count("*").alias("n"))


# --- metrics and models ------------------------------------------------------------------------------------------------------------------
@query("""WITH c AS (SELECT CAST(count_if(quality = 0 AND toxic = 0) AS DOUBLE) AS tn, CAST(count_if(quality = 0 AND toxic = 1) AS DOUBLE) AS fp, CAST(count_if(quality = 1 AND toxic = 0) AS DOUBLE) AS fn, CAST(count_if(quality = 1 AND toxic = 1) AS DOUBLE) AS tp FROM labels),
m AS (SELECT *, tn + fp + fn + tp AS n, (tp + tn) / (tn + fp + fn + tp) AS acc, ((tp + fp) * (tp + fn) + (tn + fn) * (tn + fp)) / ((tn + fp + fn + tp) * (tn + fp + fn + tp)) AS chance FROM c)
SELECT CAST(tn AS BIGINT) AS tn, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CAST(tp AS BIGINT) AS tp, round(acc, 8) AS accuracy, round((tp / (tp + fn) + tn / (tn + fp)) / 2, 8) AS balanced_accuracy, round(tp / (tp + fp), 8) AS precision, round(tp / (tp + fn), 8) AS recall, round(2 * tp / (2 * tp + fp + fn), 8) AS f1, round((acc - chance) / (1 - chance), 8) AS kappa FROM m""")
def label_agreement(t: Tables) -> DataFrame:
    c = metrics.confusion(t.labels, "quality", "toxic")
    return c.select("tn", "fp", "fn", "tp", *(F.round(x, 8).alias(x) for x in ("accuracy", "balanced_accuracy", "precision", "recall", "f1", "kappa")))


@query("""WITH x AS (SELECT l.toxic, least(1.0, d.n_chars / 40000.0) AS s FROM labels l JOIN documents d ON l.doc_id = d.doc_id),
r AS (SELECT toxic, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS k FROM x),
n AS (SELECT count_if(toxic = 1) AS p, count_if(toxic = 0) AS q FROM x)
SELECT round((sum(CASE WHEN toxic = 1 THEN k ELSE 0 END) - any_value(p) * (any_value(p) + 1) / 2.0) / (any_value(p) * any_value(q)), 8) AS auc FROM r, n""")
def length_auc(t: Tables) -> DataFrame:
    x = t.labels.join(t.documents.select("doc_id", "n_chars"), "doc_id").select("toxic", F.least(F.lit(1.0), F.col("n_chars") / 40000.0).alias("s"))
    return metrics.roc_auc(x, "toxic", "s").select(F.round("auc", 8).alias("auc"))


@query("SELECT toxic, CAST(k AS INT) AS fold, count(*) AS n FROM (SELECT toxic, (row_number() OVER (PARTITION BY toxic ORDER BY sha256(CAST(doc_id AS VARCHAR)), doc_id) - 1) % 5 AS k FROM labels) x GROUP BY toxic, k")
def stratified_folds(t: Tables) -> DataFrame:
    return features.folds(t.labels, "doc_id", "toxic", 5).groupBy("toxic", "fold").agg(F.count("*").alias("n"))


@query()
def out_of_fold_model(t: Tables) -> DataFrame:
    """Metrics of each fold, their mean, and those of all labelled documents together, of a kernel classifier; models are fitted on 1,000 labelled documents at most."""
    d = t.labels.select("doc_id", "toxic").join(t.documents.select("doc_id", "text"), "doc_id")
    p = features.out_of_fold(d, "doc_id", "text", "toxic", stop=STOP_WORDS).withColumn("guess", (F.col("p") >= 0.5).cast("int"))
    cols = ["accuracy", "f1", "kappa"]
    n = (F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")).alias("n")
    by_fold = metrics.confusion(p, "toxic", "guess", "fold").select(F.col("fold").cast("string").alias("row"), n, *cols)
    mean = by_fold.agg(F.lit("mean").alias("row"), F.sum("n").alias("n"), *(F.avg(c).alias(c) for c in cols))
    return by_fold.union(mean).union(metrics.confusion(p, "toxic", "guess").select(F.lit("all").alias("row"), n, *cols))


# --- indices -----------------------------------------------------------------------------------------------------------------------------
_SCN = " UNION ALL ".join(f"SELECT '{k}' AS scenario, CAST({i} AS DOUBLE) AS i, CAST({r} AS DOUBLE) AS r, CAST({s} AS DOUBLE) AS s" for k, (i, r, s) in SCENARIOS.items())


def _index_sql(i: str, r: str, s: str) -> dict[str, str]:
    m = f"(0.30 * {i} + 0.35 * {r} + 0.35 * {s})"
    sd = f"sqrt(0.30 * ({i} - {m}) ** 2 + 0.35 * ({r} - {m}) ** 2 + 0.35 * ({s} - {m}) ** 2)"
    raw = f"greatest(0.0, {m} - 0.1 * {sd})"
    return {"pci": m, "sd": sd, "raw": raw, "norm": f"({raw} / 1.05)", "non": f"CASE WHEN {i} > 0 AND {r} > 0 AND {s} > 0 THEN 0.5 * {m} + 0.5 / (0.30 / {i} + 0.35 / {r} + 0.35 / {s}) ELSE {m} END"}


_IX = _index_sql("i", "r", "s")


@query(f"SELECT scenario, round({_IX['pci']}, 8) AS pci, round({_IX['sd']}, 8) AS sd, round({_IX['raw']}, 8) AS rpci_raw, round({_IX['norm']}, 8) AS rpci, round({_IX['non']}, 8) AS nonlinear FROM ({_SCN}) x")
def scenario_indices(t: Tables) -> DataFrame:
    d = F.col("I"), F.col("R"), F.col("S")
    cols = {"pci": indices.pci(*d), "sd": indices.sigma(*d), "rpci_raw": indices.rpci_raw(*d), "rpci": indices.rpci_norm(*d), "nonlinear": indices.pci_nonlinear(*d)}
    return indices.scenarios(t.spark).select("scenario", *(F.round(c, 8).alias(k) for k, c in cols.items()))


_LI = _index_sql("(l_discount * 10)", "(l_tax * 10)", "least(1.0, l_quantity / 50)")


@query(f"SELECT l_returnflag, count(*) AS n, round(avg({_LI['pci']}), 8) AS pci, round(avg({_LI['norm']}), 8) AS rpci, round(avg({_LI['non']}), 8) AS nonlinear FROM lineitem GROUP BY l_returnflag")
def row_indices(t: Tables) -> DataFrame:
    """The indices as column arithmetic over a large table."""
    d = F.col("l_discount") * 10, F.col("l_tax") * 10, F.least(F.lit(1.0), F.col("l_quantity") / 50)
    return t.lineitem.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.round(F.avg(indices.pci(*d)), 8).alias("pci"), F.round(F.avg(indices.rpci_norm(*d)), 8).alias("rpci"), F.round(F.avg(indices.pci_nonlinear(*d)), 8).alias("nonlinear"))


_PLU = " UNION ALL ".join(f"SELECT '{g}' AS grp, CAST({p} AS DOUBLE) AS p, CAST({l} AS DOUBLE) AS l, CAST({u} AS DOUBLE) AS u, CAST({SIC[g]} AS DOUBLE) AS stated" for g, (p, l, u) in PLU.items())


@query(f"SELECT grp, round(0.3 * p + 0.4 * l + 0.3 * u, 8) AS sic, round(0.3 * p + 0.4 * l + 0.3 * u - stated, 8) AS difference FROM ({_PLU}) x")
def sic_deltas(t: Tables) -> DataFrame:
    df = t.spark.createDataFrame([(g, *map(float, v), SIC[g]) for g, v in PLU.items()], "grp string, p double, l double, u double, stated double")
    s = indices.sic(F.col("p"), F.col("l"), F.col("u"))
    return df.select("grp", F.round(s, 8).alias("sic"), F.round(s - F.col("stated"), 8).alias("difference"))


_W = " UNION ALL ".join(f"SELECT '{c}' AS criterion, CAST({w} AS DOUBLE) AS w0" for c, w in BASE_WEIGHTS.items())
_G = " UNION ALL ".join(f"SELECT '{g}' AS grp, CAST({s} AS DOUBLE) AS sic" for g, s in SIC.items())
_LANG = {"government": "en", "investor": "fr", "community": "de", "labour": "es", "NGO": "xx"}
_LANGS = " UNION ALL ".join(f"SELECT '{g}' AS grp, '{v}' AS lang" for g, v in _LANG.items())
_CRIT = {c: k for k, c in enumerate(BASE_WEIGHTS)}
_CRITS = " UNION ALL ".join(f"SELECT '{c}' AS criterion, {k} AS k" for c, k in _CRIT.items())
PRESSURE_SQL = f"""WITH w AS ({_W}), g AS ({_G}), la AS ({_LANGS}), cr AS ({_CRITS}),
acc AS (SELECT la.grp, g.sic, coalesce(avg(CASE WHEN d.n_chars > 1500 THEN 1.0 WHEN d.n_chars IS NOT NULL THEN 0.0 END), 0.5) AS p, count(d.doc_id) AS n FROM la JOIN g ON la.grp = g.grp LEFT JOIN documents d ON d.lang = la.lang GROUP BY la.grp, g.sic),
mat AS (SELECT la.grp, cr.criterion, coalesce(avg(CASE WHEN (d.n_chars + k) % 6 < 2 THEN 1.0 ELSE 0.0 END), 0.0) AS share FROM la CROSS JOIN cr LEFT JOIN documents d ON d.lang = la.lang GROUP BY la.grp, cr.criterion)"""


def _acceptance(t: Tables) -> tuple[DataFrame, DataFrame]:
    spark = t.spark
    lang = F.broadcast(spark.createDataFrame(list(_LANG.items()), "group string, lang string"))
    d = t.documents.select("lang", "n_chars")
    acc = lang.join(d.groupBy("lang").agg(F.avg((F.col("n_chars") > 1500).cast("double")).alias("p"), F.count("*").alias("n")), "lang", "left").join(F.broadcast(indices.group_sic(spark)), "group")
    acc = acc.select("group", "sic", F.coalesce("p", F.lit(0.5)).alias("p"), F.coalesce("n", F.lit(0)).alias("n"))
    parts = d.groupBy("lang").agg(*(F.avg(((F.col("n_chars") + k) % 6 < 2).cast("double")).alias(c) for c, k in _CRIT.items()))
    wide = lang.join(parts, "lang", "left")
    cells = F.explode(F.array(*(F.struct(F.lit(c).alias("criterion"), F.coalesce(F.col(c), F.lit(0.0)).alias("share")) for c in _CRIT)))
    return acc, wide.select("group", cells.alias("x")).select("group", "x.*")


@query(PRESSURE_SQL + """, pr AS (SELECT mat.criterion, sum(acc.sic * (1 - acc.p) * mat.share) / sum(acc.sic * (1 - acc.p)) AS gj FROM mat JOIN acc ON mat.grp = acc.grp GROUP BY mat.criterion),
z AS (SELECT w.criterion, dl.delta, w.w0, pr.gj, w.w0 * (1 + dl.delta * pr.gj) AS x FROM w JOIN pr ON w.criterion = pr.criterion CROSS JOIN (SELECT 0.0 AS delta UNION ALL SELECT 0.3 UNION ALL SELECT 1.0) dl)
SELECT criterion, CAST(delta AS DOUBLE) AS delta, round(gj, 8) AS pressure, round(x / sum(x) OVER (PARTITION BY delta), 8) AS weight, round(x / sum(x) OVER (PARTITION BY delta) - w0, 8) AS change FROM z""")
def revised_weights(t: Tables) -> DataFrame:
    acc, mat = _acceptance(t)
    deltas = t.spark.createDataFrame([(0.0,), (0.3,), (1.0,)], "delta double")
    r = indices.revised_weights(indices.base_weights(t.spark), indices.pressure(mat, acc), deltas)
    return r.select("criterion", "delta", F.round("g", 8).alias("pressure"), F.round("weight", 8).alias("weight"), F.round("change", 8).alias("change"))


_MODES = {"none": "0.0", "equal": "1.0", "volume": "CAST(acc.n AS DOUBLE)", "sic": "acc.sic", "full": "acc.sic * (1 - acc.p)"}


@query(PRESSURE_SQL + ", " + "m AS (" + " UNION ALL ".join(f"SELECT '{m}' AS mode, mat.criterion, CASE WHEN sum({e}) = 0 THEN 0.0 ELSE sum({e} * mat.share) / sum({e}) END AS gj FROM mat JOIN acc ON mat.grp = acc.grp GROUP BY mat.criterion" for m, e in _MODES.items()) + "), z AS (SELECT m.mode, m.criterion, w.w0 * (1 + 0.3 * m.gj) AS x FROM m JOIN w ON w.criterion = m.criterion) SELECT mode, criterion, round(x / sum(x) OVER (PARTITION BY mode), 8) AS weight FROM z")
def component_ablation(t: Tables) -> DataFrame:
    acc, mat = _acceptance(t)
    delta, out = t.spark.createDataFrame([(0.3,)], "delta double"), None
    for mode in _MODES:
        r = indices.revised_weights(indices.base_weights(t.spark), indices.pressure(mat, acc, mode), delta).select(F.lit(mode).alias("mode"), "criterion", F.round("weight", 8).alias("weight"))
        out = r if out is None else out.union(r)
    return out


@query(f"SELECT g.grp, CAST(d.delta AS DOUBLE) AS delta, round(max(abs(x.w - x.w0)), 12) AS most FROM ({_G}) g CROSS JOIN (SELECT 0.0 AS delta UNION ALL SELECT 0.1 UNION ALL SELECT 0.3 UNION ALL SELECT 0.5 UNION ALL SELECT 0.8 UNION ALL SELECT 1.0) d JOIN LATERAL (SELECT w0, w0 * (1 + d.delta * g.sic) / sum(w0 * (1 + d.delta * g.sic)) OVER () AS w FROM ({_W}) w) x ON true GROUP BY g.grp, d.delta")
def cancelling_factor(t: Tables) -> DataFrame:
    """The original weight rule's factor is the same for all criteria, so nothing changes."""
    d = t.spark.createDataFrame([(x,) for x in (0.0, 0.1, 0.3, 0.5, 0.8, 1.0)], "delta double")
    x = indices.base_weights(t.spark).crossJoin(F.broadcast(indices.group_sic(t.spark))).crossJoin(F.broadcast(d))
    w = indices.scaled_by_group(x, F.col("sic"), F.col("delta"), "group", "delta")
    return w.groupBy(F.col("group").alias("grp"), "delta").agg(F.round(F.max(F.abs(F.col("weight") - F.col("w0"))), 12).alias("most"))


@query(PRESSURE_SQL + " SELECT round(max(CASE WHEN grp = 'investor' THEN p END), 8) AS I, round(max(CASE WHEN grp = 'government' THEN p END), 8) AS R, round(sum(sic * p) / sum(sic), 8) AS S FROM acc")
def mapped_domains(t: Tables) -> DataFrame:
    return indices.mapped_domains(_acceptance(t)[0]).select(*(F.round(x, 8).alias(x) for x in "IRS"))


# --- grids and simulation ----------------------------------------------------------------------------------------------------------------
_MOVED = {d: f"CASE WHEN g.domain = '{d}' THEN least(greatest({d} * (1 + g.delta), 0.0), 1.0) ELSE {d} END" for d in "irs"}
_MI = _index_sql("mi", "mr", "ms")


@query(f"""WITH x AS (SELECT * FROM ({_SCN}) y), g AS (SELECT domain, CAST(delta AS DOUBLE) AS delta FROM (SELECT 'i' AS domain UNION ALL SELECT 'r' UNION ALL SELECT 's') a CROSS JOIN (SELECT -0.1 AS delta UNION ALL SELECT -0.05 UNION ALL SELECT 0.0 UNION ALL SELECT 0.05 UNION ALL SELECT 0.1) b),
m AS (SELECT x.*, g.domain, g.delta, {_MOVED['i']} AS mi, {_MOVED['r']} AS mr, {_MOVED['s']} AS ms FROM x CROSS JOIN g)
SELECT scenario, upper(domain) AS domain, delta, round({_MI['pci']}, 8) AS pci, round({_MI['norm']}, 8) AS rpci, round({_MI['pci']} - {_IX['pci']}, 8) AS pci_change, round({_MI['norm']} - {_IX['norm']}, 8) AS rpci_change FROM m""")
def sensitivity(t: Tables) -> DataFrame:
    g = grids.one_at_a_time(indices.scenarios(t.spark), [-0.1, -0.05, 0.0, 0.05, 0.1])
    return g.select("scenario", "domain", "delta", F.round("PCI", 8).alias("pci"), F.round("RPCI", 8).alias("rpci"), F.round("PCI_change", 8).alias("pci_change"), F.round("RPCI_change", 8).alias("rpci_change"))


_WEIGHTS, _LEAST = [0.4, 0.5, 0.6, 0.7, 0.8], [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6]
_GRID = " UNION ALL ".join(f"SELECT CAST({w} AS DOUBLE) AS weight, CAST({x} AS DOUBLE) AS threshold, CAST({w} AS DOUBLE) * round(value / 50 - 1, 4) + (1 - CAST({w} AS DOUBLE)) * round(CAST(event_id % 100 AS DOUBLE) / 50 - 1, 4) AS s FROM events" for w in _WEIGHTS for x in _LEAST)


@query(f"WITH g AS ({_GRID}) SELECT weight, threshold, count_if(abs(s) >= threshold AND s > 0) AS pro, count_if(abs(s) >= threshold AND s <= 0) AS resistant, count_if(abs(s) < threshold) AS unresolved FROM g GROUP BY weight, threshold")
def stance_grid(t: Tables) -> DataFrame:
    e = t.events.select(F.round(F.col("value") / 50 - 1, 4).alias("a"), F.round((F.col("event_id") % 100) / 50.0 - 1, 4).alias("b"))
    return grids.stance_grid(e, "a", "b", _WEIGHTS, _LEAST).drop("pro_share")


@query()
def monte_carlo(t: Tables) -> DataFrame:
    """Draws come from Spark's generator, so figures agree with closed forms within sampling error."""
    return grids.monte_carlo(indices.scenarios(t.spark), 10_000)


_DRAW = "(({m} * 7919 + {a} * 104729 + {b} * 1299709 + {m} * {m} * {b}) % 10007) / 10007.0"
_PLACES = "CASE {g} " + " ".join(f"WHEN '{x}' THEN {k}" for k, x in enumerate(SIC, 1)) + " END"
_CPLACES = "CASE {c} " + " ".join(f"WHEN '{x}' THEN {k}" for k, x in enumerate(BASE_WEIGHTS, 1)) + " END"
_SHARE = _DRAW.format(m="m", a=_PLACES.format(g="{g}"), b=_CPLACES.format(c="criterion"))
_CONTENTION = _DRAW.format(m="m", a=_PLACES.format(g="{g}"), b="11")


@query(f"""WITH w AS ({_W}), g AS ({_G}), c AS (SELECT m, grp, criterion, w0, {_SHARE.format(g='grp')} AS share, sic * (1 - {_CONTENTION.format(g='grp')}) AS e FROM range(5000) r(m) CROSS JOIN g CROSS JOIN w),
p AS (SELECT m, criterion, w0, sum(e * share) / sum(e) AS gj FROM c GROUP BY m, criterion, w0), x AS (SELECT m, w0, w0 * (1 + 0.3 * gj) / sum(w0 * (1 + 0.3 * gj)) OVER (PARTITION BY m) AS w FROM p),
k AS (SELECT m, sum(w) AS total, min(w) AS least, max(abs(w - w0)) AS moved FROM x GROUP BY m)
SELECT count(*) AS matrices, count_if(abs(total - 1) > 1e-12) AS bad_sums, count_if(least <= 0) AS not_positive, count_if(moved > 1e-10) AS changed, round(min(least), 8) AS least, round(max(moved), 8) AS most_moved FROM k""")
def random_matrix_stress(t: Tables) -> DataFrame:
    """Shares and contentions are remainders of a polynomial, so that other engines draw the same."""
    group = '`group`'
    r = grids.random_matrices(t.spark, 5000, indices.base_weights(t.spark), indices.group_sic(t.spark), share=F.expr(_SHARE.format(g=group)), contention=F.expr(_CONTENTION.format(g=group)))
    return r.select("matrices", "bad_sums", "not_positive", "changed", F.round("least", 8).alias("least"), F.round("most_moved", 8).alias("most_moved"))


@query(PRESSURE_SQL + """, pr AS (SELECT mat.criterion, sum(acc.sic * (1 - acc.p) * mat.share) / sum(acc.sic * (1 - acc.p)) AS gj FROM mat JOIN acc ON mat.grp = acc.grp GROUP BY mat.criterion),
z AS (SELECT w.criterion, dl.delta, w.w0, pr.gj, w.w0 * (1 + dl.delta * pr.gj) AS x FROM w JOIN pr ON w.criterion = pr.criterion CROSS JOIN (SELECT 0.3 AS delta UNION ALL SELECT 1.0) dl),
v AS (SELECT *, x / sum(x) OVER (PARTITION BY delta) AS weight FROM z)
SELECT j.criterion AS cj, k.criterion AS ck, CAST(j.delta AS DOUBLE) AS delta, round((j.weight / k.weight) / (j.w0 / k.w0), 8) AS ratio, abs((j.weight / k.weight) / (j.w0 / k.w0) - (1 + j.delta * j.gj) / (1 + k.delta * k.gj)) <= 1e-12 AS holds FROM v j JOIN v k ON j.criterion < k.criterion AND j.delta = k.delta""")
def ratio_identity(t: Tables) -> DataFrame:
    acc, mat = _acceptance(t)
    deltas = t.spark.createDataFrame([(0.3,), (1.0,)], "delta double")
    r = grids.ratio_identity(indices.revised_weights(indices.base_weights(t.spark), indices.pressure(mat, acc), deltas))
    return r.select("cj", "ck", "delta", F.round("ratio", 8).alias("ratio"), (F.col("error") <= 1e-12).alias("holds"))
