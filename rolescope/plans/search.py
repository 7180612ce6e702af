"""End-to-end plans built from the operators."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from rolescope.operators import dedupe, matching, query_match, ranking, scoring, stats
from rolescope.operators.query_generation import generate_queries
from rolescope.session import cut_lineage
from rolescope.settings import Settings

POSTING_KEY = ["source", "id", "source_ord", "ord"]


@dataclass
class SearchResult:
    queries: DataFrame
    evaluated: DataFrame
    stats: DataFrame
    ranked: DataFrame


def search_and_rank(
    profiles: DataFrame, postings: DataFrame, settings: Settings = Settings(), responses: DataFrame | None = None,
    key: list[str] = POSTING_KEY,
) -> SearchResult:
    """Queries per profile, matched postings per profile, first of equal postings, scores, ranks.

    `postings` carries `source_ord` and a row number `ord` unique over all sources.
    """
    queries = generate_queries(profiles, settings)
    # every text is evaluated once; the narrow result serves the statistics and the ranking
    evaluated = cut_lineage(query_match.match_queries(postings, queries, key, settings).select(
        "profile_id", *key, "query_match"))
    kept, _ = query_match.split_by_match(evaluated)
    # texts are read where they lie; the joins, the deduplication and the scores move narrow rows only
    narrow = scoring.text_flags(postings, settings).drop(*ranking.WIDE_COLUMNS)
    url = F.coalesce(F.nullif("application_url", F.lit("")), "source_url", F.lit(""))
    unique = dedupe.first_per_key(
        narrow.withColumn("_url", url).join(kept, key), ["profile_id", "source", "id", "_url"], ["source_ord", "ord"]
    ).drop("_url")
    scored = scoring.score_rules(unique, scoring.prepare_profiles(profiles, settings), settings)
    return SearchResult(queries, evaluated, stats.source_stats(evaluated), ranking.rank_postings(scored, settings, responses))


def whole_ranked(ranked: DataFrame, postings: DataFrame, key: list[str] = POSTING_KEY, n: int | None = None) -> DataFrame:
    """Ranked rows (up to rank n, where given) with the posting texts that the ranking left out, as the JSON bundle wants."""
    rows = ranked if n is None else ranked.where(F.col("rank") <= n)
    texts = postings.select(*key, *[c for c in ranking.WIDE_COLUMNS if c in postings.columns])
    return rows.join(texts, key)


def explain_matches(
    profiles: DataFrame, postings: DataFrame, pairs: DataFrame, settings: Settings = Settings(),
    claims: DataFrame | None = None, raw_sections: str | None = None,
) -> DataFrame:
    """Match report for every (profile_id, posting_id) pair.

    `postings` has `posting_id`; `claims` holds (profile_id, posting_id, ord, claim).
    """
    key = ["profile_id", "posting_id"]
    rows = pairs.select(*key).join(postings, "posting_id")
    evidence = cut_lineage(matching.build_evidence(profiles, raw_sections))
    asked = matching.extract_requirements(rows, key, settings)
    found = matching.retrieve_evidence(asked, evidence, [*key, "ord"], settings.evidence_top_k)
    assessed = matching.assess_requirements(matching.with_evidence(asked, found, [*key, "ord"]), settings)
    checked = None
    if claims is not None:
        listed = dedupe.first_per_value(claims, key, "claim", "ord")
        near = matching.retrieve_evidence(listed, evidence, [*key, "ord"], 3, text="claim")
        checked = matching.check_claims(matching.with_evidence(listed, near, [*key, "ord"]))
    scored = scoring.score_rules(rows, scoring.prepare_profiles(profiles, settings), settings)
    names = profiles.select("profile_id", F.col("name").alias("candidate_name"))
    base = scored.select(*key, "title", "company", "missing_skills").join(names, "profile_id")
    return matching.match_report(base, assessed, key, checked)
