"""Lexicon scores of sentences, readings, and actors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lexicons import AUTHORS
from ..functions.text import any_hit, families_hit, literal_count, sentences


def plu_shares(text: Column, power: list[str], legitimacy: list[str], urgency: list[str]) -> Column:
    """(P, L, U): each list's share of all hits, 0 without hits.  A term of two lists counts in both."""
    low = F.lower(text)
    hits = [reduce(lambda a, b: a + b, [literal_count(low, t) for t in terms]) for terms in (power, legitimacy, urgency)]
    total = hits[0] + hits[1] + hits[2]
    return F.struct(*(F.coalesce(F.try_divide(h, total), F.lit(0.0)).alias(n) for h, n in zip(hits, "PLU")))


def with_sentences(df: DataFrame, text: Column, name: str = "_sentences") -> DataFrame:
    """``df`` with its sentences as a column: they are split once, however many expressions use them."""
    return df.withColumn(name, sentences(text))


def sentence_hits(parts: Column, patterns: list[str]) -> Column:
    """Sentences in which any pattern occurs."""
    return F.size(F.filter(parts, lambda s: any_hit(s, patterns))).cast("long")


def reading(title: Column, parts: Column, lexicon: dict[str, list[str]], kind: str = "A") -> Column:
    """(positive, negative, score, label) from a title and sentences: label 1 at a score of 0 or more."""
    pos, neg = sentence_hits(parts, lexicon["positive"]), sentence_hits(parts, lexicon["negative"])
    lead = families_hit(title, lexicon["positive"]) - families_hit(title, lexicon["negative"])
    score = F.log1p(pos) - F.log1p(neg) + 1.15 * lead if kind == "A" else F.sqrt(pos.cast("double")) - F.sqrt(neg.cast("double")) + 1.5 * lead
    return F.struct(pos.alias("positive"), neg.alias("negative"), score.alias("score"), (score >= 0).cast("int").alias("label"))


def two_readings(a: Column, b: Column, label_a: Column, label_b: Column, least: float = 0.18) -> Column:
    """(label, confidence, needs_review) from scores and labels of two readings."""
    confidence = F.least(F.lit(1.0), (F.abs(a) + F.abs(b)) / 5)
    agreed = (label_a == label_b) & (confidence >= least)
    return F.struct(F.when(agreed, label_a).alias("label"), confidence.alias("confidence"), (~agreed).alias("needs_review"))


def adjudicated(a: Column, b: Column, weight: float = 0.60, margin: float = 0.30) -> Column:
    """(score, label, confidence): a label only where the weighted score is ``margin`` or more away from 0."""
    score = weight * a + (1 - weight) * b
    clear = F.abs(score) >= margin
    return F.struct(score.alias("score"), F.when(clear, (score > 0).cast("int")).alias("label"), F.when(clear, F.least(F.lit(1.0), F.abs(score) / 3)).alias("confidence"))


def author_group(publisher: Column, title: Column, rules=AUTHORS) -> Column:
    out, p, both = None, F.lower(F.coalesce(publisher, F.lit(""))), F.lower(F.concat_ws(" ", F.coalesce(publisher, F.lit("")), F.coalesce(title, F.lit(""))))
    for group, on_publisher, on_both in rules:
        cond = p.rlike(on_publisher) if on_publisher else both.rlike(on_both)
        out = F.when(cond, group) if out is None else out.when(cond, group)
    return out


def voice_scores(df: DataFrame, id_col: str, title: Column, text: Column, groups: dict[str, list[str]], speech: str, title_weight: float = 3.0, said: float = 2.5, other: float = 0.35, lead: int | None = None, lead_weight: float = 0.0) -> DataFrame:
    """(id, group, score), a row for each group: hits in the title, and in sentences, which weigh more where somebody speaks.

    With ``lead``, sentences before that place also add ``lead_weight`` for each hit.
    """

    def weighed(s: Column, k: Column) -> Column:
        weight = F.when(s.rlike(f"(?i){speech}"), F.lit(said)).otherwise(F.lit(other))
        if lead is not None:
            weight = weight + F.when(k < lead, F.lit(lead_weight)).otherwise(F.lit(0.0))
        return F.struct(s.alias("s"), weight.alias("w"))

    # sentences that name no group at all add nothing; the weight of each of the rest is found once for all groups
    named = lambda x: any_hit(x["s"], [p for patterns in groups.values() for p in patterns])
    numbered = F.filter(F.transform(sentences(text), lambda s, k: F.struct(s.alias("s"), k.alias("k"))), named)
    df = df.withColumn("_title", title).withColumn("_numbered", numbered)
    df = df.withColumn("_numbered", F.transform("_numbered", lambda x: weighed(x["s"], x["k"])))

    def score(patterns: list[str]) -> Column:
        hits = F.aggregate("_numbered", F.lit(0.0), lambda acc, x: acc + families_hit(x["s"], patterns) * x["w"])
        return families_hit(F.col("_title"), patterns) * title_weight + hits

    rows = F.explode(F.array(*(F.struct(F.lit(g).alias("group"), score(p).cast("double").alias("score")) for g, p in groups.items())))
    return df.select(id_col, rows.alias("r")).select(id_col, "r.group", "r.score")


def dominant(scores: DataFrame, id_col: str) -> DataFrame:
    """(id, group, top, second, margin): the largest score, ties by name; margin is relative to it (1 at least)."""
    w = Window.partitionBy(id_col).orderBy(F.desc("score"), "group")
    ranked = scores.withColumn("rn", F.row_number().over(w)).withColumn("second", F.lead("score").over(w)).where("rn = 1")
    second = F.coalesce("second", F.lit(0.0))
    return ranked.select(id_col, "group", F.col("score").alias("top"), second.alias("second"), ((F.col("score") - second) / F.greatest("score", F.lit(1.0))).alias("margin"))


def settled_voice(dominant_: DataFrame, authors: DataFrame, id_col: str, fallback: str = "government") -> DataFrame:
    """(id, group, confidence, method) from ``dominant`` and (id, author_group, is_news).

    A document whose author is of a group and no news publisher speaks for that group, whatever its words; one whose words name no group speaks for the author's, or else for ``fallback``, with no confidence; any other
    for the group of the largest score, by its margin.
    """
    j = dominant_.join(authors, id_col, "left")
    own = F.col("author_group").isNotNull() & ~F.coalesce(F.col("is_news"), F.lit(False))
    silent = F.col("top") <= 0
    group = F.when(own, F.col("author_group")).when(silent, F.coalesce("author_group", F.lit(fallback))).otherwise(F.col("group"))
    confidence = F.when(own, 1.0).when(silent, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("margin"))))
    method = F.when(own, "document_author_group").when(silent, "fallback_no_actor_signal").otherwise("dominant_voice_proxy")
    return j.select(id_col, group.alias("group"), confidence.alias("confidence"), method.alias("method"))


def low_voice(confidence: Column, method: Column, least: float = 0.12) -> Column:
    """Whether a group was taken from its score by a margin too small to stand unseen; authors and fallbacks are stated as such."""
    return (confidence < least) & (method == "dominant_voice_proxy")


def low_confidence(confidence: Column, method: Column, least: float = 0.12) -> Column:
    """Whether a voice goes to the next pass: one without any signal, or a low one."""
    return (method == "fallback_no_actor_signal") | low_voice(confidence, method, least)


def coding_decision(a: Column, b: Column, label_a: Column, label_b: Column, voice_confidence: Column, voice_method: Column, least: float = 0.18) -> Column:
    """(label, confidence, needs_review, reason) from two readings and the settled voice: a label where the readings agree clearly, which is still for review where the voice is low."""
    read, low = two_readings(a, b, label_a, label_b, least), low_voice(voice_confidence, voice_method)
    reason = F.when(read["needs_review"], "stance_readings_disagree_or_low_margin").when(low, "stakeholder_voice_low_confidence").otherwise("computational_readings_agree")
    return F.struct(read["label"].alias("label"), read["confidence"].alias("confidence"), (read["needs_review"] | low).alias("needs_review"), reason.alias("reason"))


def adjudicated_actor(dominant_: DataFrame, title_groups: DataFrame, id_col: str) -> DataFrame:
    """A group that alone occurs in the title is taken; else a clear margin; else none.  ``title_groups``: (id, title_group, n_title_groups)."""
    j = dominant_.join(title_groups, id_col, "left")
    alone, clear = F.coalesce(F.col("n_title_groups") == 1, F.lit(False)), (F.col("top") >= 4.0) & (F.col("margin") >= 0.25)
    group = F.when(alone, F.col("title_group")).when(clear, F.col("group"))
    confidence = F.when(alone, 0.95).when(clear, F.least(F.lit(0.94), 0.55 + 0.45 * F.col("margin"))).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(0.49), F.col("margin"))))
    method = F.when(alone, "third_pass_unique_headline_subject").when(clear, "third_pass_attributed_voice_clear_margin").otherwise("unresolved_stakeholder_voice_ambiguous")
    return j.select(id_col, group.alias("final_group"), confidence.alias("confidence"), method.alias("method"))


def criterion_relevance(df: DataFrame, id_col: str, text: Column, criteria: dict[str, list[str]], rules) -> DataFrame:
    """(id, criterion, matched_sentences, families, relevant_s_f ...): enough matched sentences and distinct families."""
    every = [p for patterns in criteria.values() for p in patterns]
    df = with_sentences(df, text).withColumn("_sentences", F.filter("_sentences", _any_of(every)))  # the rest match nothing below
    parts, rows = F.col("_sentences"), []
    for name, patterns in criteria.items():
        matched = F.size(F.filter(parts, _any_of(patterns))).cast("long")
        distinct = reduce(lambda a, b: a + b, [F.exists(parts, _any_of([p])).cast("long") for p in patterns])
        rows.append(F.struct(F.lit(name).alias("criterion"), matched.alias("matched_sentences"), distinct.alias("families")))
    out = df.select(id_col, F.explode(F.array(*rows)).alias("r")).select(id_col, "r.*")
    for s, f in rules:
        out = out.withColumn(f"relevant_{s}_{f}", (F.col("matched_sentences") >= s) & (F.col("families") >= f))
    return out


def _any_of(patterns: list[str]):
    return lambda s: any_hit(s, patterns)


def prevalence(groups: DataFrame, relevance: DataFrame, id_col: str, criteria: list[str], flag: str) -> DataFrame:
    """(group, criterion, recovered, relevant, share): every pair has a row, also without relevant documents."""
    spark = groups.sparkSession
    n = groups.groupBy("group").agg(F.count("*").alias("recovered"))
    grid = n.crossJoin(F.broadcast(spark.createDataFrame([(c,) for c in criteria], "criterion string")))
    hit = groups.join(relevance.where(flag), id_col).groupBy("group", "criterion").agg(F.count("*").alias("relevant"))
    return grid.join(hit, ["group", "criterion"], "left").select("group", "criterion", "recovered", F.coalesce("relevant", F.lit(0)).alias("relevant"), (F.coalesce("relevant", F.lit(0)) / F.col("recovered")).alias("share"))
