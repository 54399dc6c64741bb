"""Ordered rules: the first that holds decides."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_match(rules: Sequence[tuple[Column, str]], otherwise: str | None = None) -> Column:
    """The value of the first rule that holds; null conditions don't."""
    out = None
    for condition, value in rules:
        out = F.when(condition, F.lit(value)) if out is None else out.when(condition, F.lit(value))
    return out.otherwise(F.lit(otherwise))


def first_match_struct(rules: Sequence[tuple[Column, dict[str, str]]], otherwise: dict[str, str]) -> Column:
    """Several values at once, as a struct."""
    pack = lambda d: F.struct(*(F.lit(v).alias(k) for k, v in d.items()))
    out = None
    for condition, value in rules:
        out = F.when(condition, pack(value)) if out is None else out.when(condition, pack(value))
    return out.otherwise(pack(otherwise))


def or_raise(rules: Sequence[tuple[Column, str]], message: str) -> Column:
    """Like first_match, but a row that no rule takes stops the query."""
    return F.coalesce(first_match(rules), F.raise_error(F.lit(message)).cast("string"))


def allow_list(df: DataFrame, key: str, decisions: DataFrame) -> DataFrame:
    """Decisions (key, decision, reason) by id; rows without one are pending."""
    return df.join(decisions, key, "left").withColumn("decision", F.coalesce("decision", F.lit("pending"))).withColumn("reason", F.coalesce("reason", F.lit("")))


#: Decisions and states for which a row is acquired; a pending one is acquired because its text is needed to decide.
TAKEN = ("include", "included", "include_candidate", "eligible")
OPEN = ("candidate_pending_substantive_screen", "verified_candidate", "verified", "include", "included", "verified_archive", "verified_historical_citation")


def eligible(decision: Column, status: Column) -> Column:
    """Whether a row is to be acquired: its decision is one of ``TAKEN``, or its status one of ``OPEN`` or begins with eligible; blanks around and capitals don't matter, null is neither."""
    d, s = (F.lower(F.trim(F.coalesce(c, F.lit("")))) for c in (decision, status))
    return d.isin(*TAKEN) | s.startswith("eligible") | s.isin(*OPEN)


def text_quality(text: Column, words: Column, rows: Column, least: int = 150) -> Column:
    """What becomes of a recovered text, ``rows`` being how many have it: none, one of several, too short, or fine."""
    return first_match([(F.coalesce(F.length(text), F.lit(0)) == 0, "missing_text"), (rows > 1, "repeated_extraction_hash"), (words < least, "short_text_review")], "usable_text")


def duplicate_basis(same_hash: Column, ratio: Column, same_title: Column) -> Column:
    """The basis on which a pair is one record; a pair without any stops the query, so that none is dropped unseen."""
    return or_raise([(same_hash, "identical_text_hash"), (ratio >= 0.95, "near_identical_text"), (same_title, "identical_title_and_language")], "a pair without a basis")


#: The classes of the variants, in the order in which they are tried; the last takes the rest.
VARIANTS = {
    "derived": ("acquisition_exception", "strong_early_2012_event_context", "strong_case_context_supported", "case_name_only_routine_project_or_corporate_signal", "case_term_low_context_review", "strong_routine_corporate_signal", "likely_routine_corporate_signal", "possible_substantive_case_context", "ambiguous_low_signal"),
    "archive": ("acquisition_or_text_exception", "strong_early_2012_event_context", "strong_case_context_supported", "case_name_only_routine_project_or_corporate_signal", "case_term_low_context_review", "strong_routine_corporate_signal", "likely_routine_corporate_signal", "possible_substantive_case_context", "ambiguous_low_signal"),
    "low_signal": ("acquisition_or_text_exception", "strong_early_2012_event_context", "case_context_supported", "strong_routine_corporate_signal", "likely_routine_corporate_signal", "possible_substantive_case_context", "ambiguous_low_signal"),
    "secondary": ("acquisition_or_text_exception", "strong_early_2012_event_context", "strong_case_context_supported", "strong_lonmin_context_supported", "case_name_only_routine_project_or_corporate_signal", "case_term_low_context_review", "possible_lonmin_substantive_context", "lonmin_low_context_review", "sibanye_context_without_case_anchor_review", "strong_routine_no_case_anchor", "no_case_anchor", "ambiguous_secondary_review"),
}


def evidence_variant(variant: str, unusable: Column, early: Column, actors: Column, forces: Column, lonmin: Column, sibanye: Column, case_n: Column, event: Column, social: Column, corp: Column, title_case: Column, title_corp: Column) -> Column:
    """The evidence class by one of the four rule lists; counts are distinct families but for ``lonmin``, ``sibanye`` and ``case_n``, which are mentions.

    ``actors`` tells of strike or worker families, ``forces`` of police, death, wage or union ones; ``secondary`` needs only the first.
    """
    context, quiet, calm = (event >= 2) | (social >= 1), (event <= 1) & (social == 0), ~title_case
    case = case_n > 0
    early_event = early & (lonmin >= 3) & (event >= 3) & actors
    many = (event >= 3) | (social >= 2)
    holds = {
        "acquisition_exception": unusable,
        "acquisition_or_text_exception": unusable,
        "strong_early_2012_event_context": early_event if variant == "secondary" else early_event & forces,
        "strong_case_context_supported": case & (context | title_case),
        "case_context_supported": case & context,
        "strong_lonmin_context_supported": (lonmin >= 3) & many,
        "case_name_only_routine_project_or_corporate_signal": case & title_corp & (corp >= 1) & quiet & (calm if variant == "archive" else F.lit(True)),
        "case_term_low_context_review": case,
        "possible_lonmin_substantive_context": (lonmin > 0) & context,
        "lonmin_low_context_review": lonmin > 0,
        "sibanye_context_without_case_anchor_review": (sibanye > 0) & context,
        "strong_routine_corporate_signal": title_corp & (corp >= 2) & quiet & {"archive": calm, "low_signal": ~case}.get(variant, F.lit(True)),
        "likely_routine_corporate_signal": (corp >= 3) & quiet & {"archive": calm, "low_signal": ~case}.get(variant, F.lit(True)),
        "possible_substantive_case_context": many | title_case if variant == "archive" else many,
        "strong_routine_no_case_anchor": title_corp & (corp >= 2) & quiet,
        "no_case_anchor": ~case & (lonmin == 0) & (sibanye == 0),
    }
    *names, rest = VARIANTS[variant]
    return first_match([(holds[n], n) for n in names], rest)


def temporal_labour(klass: Column, year: Column, lonmin: Column, event: Column, title: Column, title_pattern: str) -> Column:
    """The reason for which a text of the two strike years is included, or null."""
    ok = klass.isin("strong_case_context_supported", "possible_lonmin_substantive_context") & (lonmin >= 1) & (event >= 4) & F.coalesce(title.rlike(title_pattern), F.lit(False))
    return F.when(ok & (year == 2014), "include_2014_platinum_strike_lonmin").when(ok & (year == 2013), "include_lonmin_marikana_labour_governance")


def keyword_url(url: Column, keywords: Sequence[str], first: int = 2010, last: int = 2023) -> Column:
    """Whether a URL has a keyword, and a year of the period between separators or else an article path."""
    low = F.lower(url)
    year = F.regexp_extract(low, "(?:^|[-_/])(201[0-9]|202[0-3])(?:[-_/]|$)", 1).try_cast("int")
    return F.coalesce(low.rlike("|".join(keywords)) & (F.coalesce(year.between(first, last), F.lit(False)) | low.contains("/article/")), F.lit(False))


def prescreen(known: Column, seen: Column, year: Column, case: Column, lonmin: Column, first: int = 2010, last: int = 2023) -> Column:
    """The status of a discovered URL."""
    return first_match(
        [
            (known, "already_screened"), (seen, "duplicate_discovery_url"), (~year.between(first, last), "exclude_outside_period"), (year.isNull(), "review_year_unresolved"),
            (case, "explicit_case_title_review"), (lonmin, "lonmin_only_title_review"),
        ],
        "secondary_keyword_only_review",
    )


def in_period(year: Column, first: int, last: int) -> Column:
    """Whether the text of a year lies in the period; a text that is no number stops the query."""
    n = F.coalesce(year.try_cast("int"), F.raise_error(F.concat(F.lit("not a year: "), F.coalesce(year, F.lit("null")))).cast("int"))
    return n.between(first, last)


def case_guard(high_specific: Column, lonmin: Column, case_n: Column, event: Column, justice: Column) -> Column:
    return high_specific | (lonmin >= 2) | ((case_n >= 2) & (event >= 4)) | ((case_n >= 2) & (event >= 3) & justice)


def similarity_signal(ratio: Column, shingle: Column) -> Column:
    return first_match([((ratio >= 0.95) | (shingle >= 0.90), "near_exact"), ((ratio >= 0.80) | (shingle >= 0.60), "high_overlap"), (shingle >= 0.25, "partial_overlap")], "distinct")
