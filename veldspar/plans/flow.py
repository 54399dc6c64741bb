"""Queries from documents and labels to voices, decisions, weights and indices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lexicons import BASE_WEIGHTS, SIC, STOP_WORDS
from ..operators import features, flow, kernel, metrics, stance
from .analysis import ACTORS, CRITERIA, DOCS_SQL, READ_SQL, REL_SQL, SPEECH, VOICE_SQL, _docs, _index_sql, _readings
from .registry import Tables, query

#: Stand-ins for publishers, of which the texts have none: (group, pattern on the source, or else on source and title).
AUTHORED = (("investor", "[05]$", None), ("NGO", "7$", None), ("labour", None, r"\bque\b"), ("community", None, r"\bder\b"))
NEWS = "[02468]$"
#: The criteria of the weights and the ones that are counted in texts, in turn.
COUNTED = dict(zip(BASE_WEIGHTS, [list(CRITERIA)[k % len(CRITERIA)] for k in range(len(BASE_WEIGHTS))]))
RULES, DELTAS = [(1, 1), (2, 1), (2, 2)], [0.0, 0.3, 0.8]

_AUTHOR_SQL = "CASE " + " ".join(f"WHEN regexp_matches(lower(source), '{p}') THEN '{g}'" if p else f"WHEN regexp_matches(lower(source || ' ' || substring({{a}}, 1, 80)), '{b}') THEN '{g}'" for g, p, b in AUTHORED) + " END"
VOICES = f"""{DOCS_SQL}, v AS (SELECT doc_id, grp, round(CAST(score AS DOUBLE), 6) AS score FROM ({VOICE_SQL}) x),
k AS (SELECT doc_id, grp, score AS top, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, grp) AS rn, lead(score) OVER (PARTITION BY doc_id ORDER BY score DESC, grp) AS second FROM v),
au AS (SELECT d.doc_id, {_AUTHOR_SQL.format(a='a')} AS author, regexp_matches(source, '{NEWS}') AS news FROM d JOIN documents USING (doc_id)),
voices AS (SELECT doc_id, CASE WHEN author IS NOT NULL AND NOT news THEN author WHEN top <= 0 THEN coalesce(author, 'government') ELSE grp END AS actor,
  CASE WHEN author IS NOT NULL AND NOT news THEN 1.0::DOUBLE WHEN top <= 0 THEN 0.0::DOUBLE ELSE greatest(0.0, least(1.0, (top - second) / greatest(top, 1.0))) END AS confidence,
  CASE WHEN author IS NOT NULL AND NOT news THEN 'document_author_group' WHEN top <= 0 THEN 'fallback_no_actor_signal' ELSE 'dominant_voice_proxy' END AS method FROM k JOIN au USING (doc_id) WHERE rn = 1)"""


def _voices(t: Tables) -> DataFrame:
    d = _docs(t).join(t.documents.select("doc_id", "source"), "doc_id")
    title = F.substring("a", 1, 80)
    scores = stance.voice_scores(d, "doc_id", title, F.col("a"), ACTORS, SPEECH).withColumn("score", F.round("score", 6))
    authors = t.documents.select("doc_id", stance.author_group(F.col("source"), F.regexp_replace(F.substring("text", 1, 80), r"[^\x00-\x7F]", "~"), AUTHORED).alias("author_group"), F.col("source").rlike(NEWS).alias("is_news"))
    return stance.settled_voice(stance.dominant(scores, "doc_id"), authors, "doc_id")


@query(f"WITH {VOICES} SELECT doc_id, actor, round(confidence, 6) AS confidence, method FROM voices")
def stakeholder_voices(t: Tables) -> DataFrame:
    """The group that each document speaks for, by author, words or neither."""
    return _voices(t).select("doc_id", F.col("group").alias("actor"), F.round("confidence", 6).alias("confidence"), "method")


@query(f"""WITH {VOICES}, {READ_SQL}, x AS (SELECT lang, (a >= 0) = (b >= 0) AND least(1.0, (abs(a) + abs(b)) / 5) >= 0.18 AS agreed, confidence < 0.12 AND method = 'dominant_voice_proxy' AS low FROM ab JOIN voices USING (doc_id))
SELECT lang, CASE WHEN NOT agreed THEN 'stance_readings_disagree_or_low_margin' WHEN low THEN 'stakeholder_voice_low_confidence' ELSE 'computational_readings_agree' END AS reason, NOT agreed OR low AS needs_review, count(*) AS n FROM x GROUP BY ALL""")
def coding_decisions(t: Tables) -> DataFrame:
    """Two readings and a voice: what is settled, and why the rest is for review."""
    d = stance.coding_decision(F.col("a"), F.col("b"), F.col("label_a"), F.col("label_b"), F.col("confidence"), F.col("method"))
    return _readings(t).join(_voices(t), "doc_id").select("lang", d.alias("d")).groupBy("lang", "d.reason", "d.needs_review").agg(F.count("*").alias("n"))


@query(f"WITH {VOICES} SELECT method, count(*) AS n, CAST(count_if(method = 'fallback_no_actor_signal' OR (confidence < 0.12 AND method = 'dominant_voice_proxy')) AS BIGINT) AS low FROM voices GROUP BY method")
def low_confidence_voices(t: Tables) -> DataFrame:
    """Voices for review by how they were found."""
    return _voices(t).groupBy("method").agg(F.count("*").alias("n"), F.count_if(stance.low_confidence(F.col("confidence"), F.col("method"))).alias("low"))


# An estimate that SQL can make too: of each document, the smoothed share of the label among the other folds' documents of its language and length.
_P_SQL = """f AS (SELECT l.doc_id, l.quality, lang, n_chars > 1500 AS long, (row_number() OVER (PARTITION BY quality ORDER BY sha256(CAST(l.doc_id AS VARCHAR)), l.doc_id) - 1) % 5 AS fold FROM labels l JOIN documents USING (doc_id)),
c AS (SELECT lang, long, fold, sum(quality) AS ones, count(*) AS n FROM f GROUP BY ALL), w AS (SELECT lang, long, sum(ones) AS ones, sum(n) AS n FROM c GROUP BY ALL),
prob AS (SELECT f.doc_id, (w.ones - c.ones + 1) / (w.n - c.n + 2)::DOUBLE AS p FROM f JOIN c USING (lang, long, fold) JOIN w USING (lang, long))"""
_SIC_SQL = "sic_(actor, sic) AS (VALUES " + ", ".join(f"('{g}', {v}::DOUBLE)" for g, v in SIC.items()) + ")"
_MEANS_SQL = f"WITH {VOICES}, {_P_SQL}, {_SIC_SQL}, means AS (SELECT actor, any_value(sic) AS sic, avg(p) AS p, count(*) AS n FROM prob JOIN voices USING (doc_id) JOIN sic_ USING (actor) GROUP BY actor)"


def _shares_out_of_fold(t: Tables) -> DataFrame:
    """(doc_id, p) of labelled documents."""
    d = t.labels.select("doc_id", "quality").join(t.documents.select("doc_id", "lang", (F.col("n_chars") > 1500).alias("long")), "doc_id")
    f = features.folds(d, "doc_id", "quality", 5)
    c = f.groupBy("lang", "long", "fold").agg(F.sum("quality").alias("own"), F.count("*").alias("n_own"))
    w = c.groupBy("lang", "long").agg(F.sum("own").alias("ones"), F.sum("n_own").alias("n"))
    j = f.join(c, ["lang", "long", "fold"]).join(w, ["lang", "long"])
    return j.select("doc_id", ((F.col("ones") - F.col("own") + 1) / (F.col("n") - F.col("n_own") + 2)).alias("p"))


def _matches(t: Tables) -> DataFrame:
    return stance.criterion_relevance(_docs(t), "doc_id", F.col("a"), CRITERIA, ())


def _weights(t: Tables, p: DataFrame) -> DataFrame:
    groups = _voices(t).select("doc_id", "group")
    names = t.spark.createDataFrame([(c, float(BASE_WEIGHTS[c]), n) for c, n in COUNTED.items()], "criterion string, w0 double, name string")
    return flow.weights_of(flow.group_means(p, groups, "doc_id"), flow.relevance_shares(_matches(t), groups, "doc_id", RULES), F.broadcast(names), DELTAS)


@query(_MEANS_SQL + f""", rel AS ({REL_SQL}), rule(s, f) AS (VALUES {", ".join(map(str, RULES))}), dl(delta) AS (VALUES {", ".join(f"({x}::DOUBLE)" for x in DELTAS)}), base(criterion, w0, name) AS (VALUES {", ".join(f"('{c}', {BASE_WEIGHTS[c]}::DOUBLE, '{n}')" for c, n in COUNTED.items())}),
sh AS (SELECT s, f, actor, criterion AS name, count_if(m >= s AND rel.f_ >= rule.f) / count(*)::DOUBLE AS share FROM (SELECT doc_id, criterion, m, f AS f_ FROM rel) rel JOIN voices USING (doc_id) CROSS JOIN rule GROUP BY ALL),
g AS (SELECT s, f, name, sum(sic * (1 - p) * share) / sum(sic * (1 - p)) AS full_, sum(sic * share) / sum(sic) AS only_ FROM sh JOIN means USING (actor) GROUP BY ALL),
m AS (SELECT s, f, name, 'salience_times_contention' AS mode, full_ AS g FROM g UNION ALL SELECT s, f, name, 'salience_only', only_ FROM g),
z AS (SELECT s, f, mode, delta, criterion, w0, g, w0 * (1 + delta * g) AS x FROM m JOIN base USING (name) CROSS JOIN dl)
SELECT s, f, mode, delta, criterion, round(g, 8) AS pressure, round(x / sum(x) OVER o, 8) AS weight, round(x / sum(x) OVER o - w0, 8) AS change FROM z WINDOW o AS (PARTITION BY s, f, mode, delta)""")
def labels_to_weights(t: Tables) -> DataFrame:
    """From labels and texts to revised weights: out-of-fold shares, voices and matched sentences, by three rules, two modes and three deltas."""
    w = _weights(t, _shares_out_of_fold(t))
    return w.select("s", "f", "mode", "delta", "criterion", *(F.round(c, 8).alias(c) for c in ("pressure", "weight", "change")))


_CX = _index_sql("i", "r", "s")


@query(_MEANS_SQL + f""", x AS (SELECT max(CASE WHEN actor = 'investor' THEN p END) AS i, max(CASE WHEN actor = 'government' THEN p END) AS r, sum(sic * p) / sum(sic) AS s FROM means)
SELECT round(i, 8) AS "I", round(r, 8) AS "R", round(s, 8) AS "S", round({_CX['pci']}, 8) AS pci, round({_CX['sd']}, 8) AS sigma, round({_CX['norm']}, 8) AS rpci, round({_CX['non']}, 8) AS nonlinear FROM x""")
def labels_to_indices(t: Tables) -> DataFrame:
    """From labels to indices of the corpus, by the groups' mean out-of-fold shares."""
    got = flow.corpus_indices(flow.group_means(_shares_out_of_fold(t), _voices(t).select("doc_id", "group"), "doc_id"))
    return got.select(*(F.round(c, 8).alias(c) for c in got.columns))


@query()
def model_to_weights(t: Tables) -> DataFrame:
    """The same weights from the probabilities of the kernel classifier, which SQL can't fit."""
    d = t.labels.select("doc_id", "quality").join(t.documents.select("doc_id", "text"), "doc_id")
    p = kernel.kernel_out_of_fold(d, "doc_id", "text", "quality", stop=STOP_WORDS).select("doc_id", "p")
    return _weights(t, p).select("s", "f", "mode", "delta", "criterion", *(F.round(c, 8).alias(c) for c in ("pressure", "weight", "change")))


@query()
def kernel_model(t: Tables) -> DataFrame:
    """Metrics of each fold, their mean, and those of all labelled documents together, of the classifier that is fitted on all of them; ``error`` is that of its calibration."""
    d = t.labels.select("doc_id", "toxic").join(t.documents.select("doc_id", "text"), "doc_id")
    p = kernel.kernel_out_of_fold(d, "doc_id", "text", "toxic", stop=STOP_WORDS).withColumn("guess", (F.col("p") >= 0.5).cast("int"))
    cols, n = ["accuracy", "f1", "kappa"], (F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")).alias("n")
    by_fold = metrics.confusion(p, "toxic", "guess", "fold").select(F.col("fold").cast("string").alias("row"), n, *cols)
    mean = by_fold.agg(F.lit("mean").alias("row"), F.sum("n").alias("n"), *(F.avg(c).alias(c) for c in cols))
    error = kernel.calibration(p, "toxic", "p").where("bin is null").select("error")
    every = metrics.confusion(p, "toxic", "guess").select(F.lit("all").alias("row"), n, *cols).join(F.broadcast(error))
    return by_fold.union(mean).withColumn("error", F.lit(None).cast("double")).unionByName(every)
