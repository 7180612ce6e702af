"""Counts and summaries per source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rolescope.plans.spread import rank_rows

COUNTERS = ["raw_jobs_discovered", "jobs_matched", "jobs_filtered_out"]


def source_stats(evaluated: DataFrame) -> DataFrame:
    """Raw, matched and filtered counts per source (and per profile, where there are any), in source order."""
    matched = F.col("query_match.matched")
    order = F.min("source_ord") if "source_ord" in evaluated.columns else F.lit(0)
    by = [c for c in ("profile_id",) if c in evaluated.columns]
    return evaluated.groupBy(*by, "source").agg(
        order.alias("source_ord"), F.count("*").alias("raw_jobs_discovered"),
        F.count_if(matched).alias("jobs_matched"), F.count_if(~matched).alias("jobs_filtered_out"))


def merge_source_stats(left: DataFrame, right: DataFrame) -> DataFrame:
    """Largest value of each counter per source; a missing counter is 0."""
    both = left.unionByName(right, allowMissingColumns=True)
    return both.groupBy("source").agg(*[F.max(F.coalesce(F.col(c), F.lit(0))).alias(c) for c in COUNTERS])


def merge_runs(runs: DataFrame) -> DataFrame:
    """Several runs of one source as one: counters added."""
    return runs.groupBy("source").agg(*[F.sum(F.coalesce(F.col(c), F.lit(0))).alias(c) for c in COUNTERS])


def merge_lists(rows: DataFrame, by: list[str], run: str = "run_ord", ord_col: str = "ord") -> DataFrame:
    """Lists of several runs as one: rows of a later run stand behind those of an earlier one, numbered anew from 0.

    `ord_col` orders a run's rows; (run, ord) is unique within a group. Postings, notes, details and diagnostics
    merge alike. A group may be of any size: ranges of it are numbered side by side.
    """
    ranked = rank_rows(rows.withColumn("_was", F.col(ord_col)), by, [(run, False)], "_was", "_rank")
    return ranked.withColumn(ord_col, (F.col("_rank") - 1).cast("long")).drop("_rank", "_was")


def merge_debug(entries: DataFrame, by: list[str], run: str = "run_ord") -> DataFrame:
    """Debug maps of several runs as one, by (group, key): lists are joined, anything else is replaced by the later.

    `entries` has one row per list element (ord from 0) or scalar (ord null), with key and value. A list after a
    scalar replaces it, so a key keeps what follows its last scalar, or that scalar if nothing follows.
    """
    group = [*by, "key"]
    last = entries.groupBy(*group).agg(F.max(run).alias("_last"), F.max(F.when(F.col("ord").isNull(), F.col(run))).alias("_scalar"))
    rows = entries.join(last, group)
    scalar = F.coalesce(F.col("_scalar") == F.col("_last"), F.lit(False))
    kept = rows.where(F.when(scalar, F.col(run) == F.col("_last")).otherwise(F.col("_scalar").isNull() | (F.col(run) > F.col("_scalar"))))
    kept = kept.drop("_last", "_scalar")
    return merge_lists(kept.where("ord is not null"), group, run).unionByName(kept.where("ord is null")).drop(run)


def report_totals(stats: DataFrame, deduped: DataFrame, ranked: DataFrame | None = None) -> DataFrame:
    """Raw and filtered are summed before deduplication, discovered counts deduplicated rows."""
    totals = stats.agg(
        F.coalesce(F.sum("raw_jobs_discovered"), F.lit(0)).alias("total_jobs_raw_discovered"),
        F.coalesce(F.sum("jobs_filtered_out"), F.lit(0)).alias("total_jobs_filtered_out"))
    found = deduped.agg(F.count("*")).scalar()
    n_ranked = (ranked if ranked is not None else deduped).agg(F.count("*")).scalar()
    return totals.withColumns({"total_jobs_discovered": found, "total_jobs_ranked": n_ranked})


def diagnosis_summary(
    stats: DataFrame, fetch_log: DataFrame, notes: DataFrame | None = None, site_source: str = "custom_career_pages"
) -> DataFrame:
    """One sentence per source: matched, all filtered, first error, first note, or nothing found."""
    first = fetch_log.groupBy("source").agg(
        F.min(F.struct("ord", "status_code", "kind", "message")).alias("_d"))
    rows = stats.join(first, "source", "left")
    if notes is not None:
        rows = rows.join(notes.groupBy("source").agg(F.min(F.struct("ord", "note")).alias("_n")), "source", "left")
    note = F.col("_n.note") if notes is not None else F.lit(None).cast("string")
    s, d = F.col("source"), F.col("_d")
    n = lambda c: F.col(c).cast("string")
    say = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    none = lambda rest: say("Fetched 0 jobs from ", s, rest)
    sentence = (
        F.when((F.col("jobs_matched") > 0) & (F.col("jobs_filtered_out") > 0), say(
            "Fetched ", n("jobs_matched"), " jobs from ", s, " (", n("raw_jobs_discovered"),
            " raw jobs, filtered out ", n("jobs_filtered_out"), " by queries)"))
        .when(F.col("jobs_matched") > 0, say("Fetched ", n("jobs_matched"), " jobs from ", s))
        .when(F.col("raw_jobs_discovered") > 0, say(
            "Fetched 0 jobs from ", s, ": got ", n("raw_jobs_discovered"),
            " raw jobs, but all were filtered out by the generated queries"))
        .when((d["status_code"] == 404) & (s == site_source), none(
            ": an optional discovery URL returned 404 (commonly a sitemap path or auxiliary page), "
            "so rendered or in-page discovery may be needed"))
        .when(d["status_code"] == 404, none(
            ": endpoint returned 404, which usually means a wrong board slug or the company is not using that ATS"))
        .when(d["status_code"] == 403, none(": endpoint returned 403 and blocked access"))
        .when(d["status_code"] == 429, none(": endpoint rate-limited the requests with 429"))
        .when(d["kind"] == "robots_blocked", none(": robots.txt disallowed fetching this source"))
        .when(d["kind"] == "request_error", say(
            "Fetched 0 jobs from ", s, ": request failed (", F.coalesce(d["message"], F.lit("")), ")"))
        .when(note.isNotNull(), say("Fetched 0 jobs from ", s, ": ", note))
        .otherwise(none(": source returned no jobs or no source entries were configured"))
    )
    return rows.select("source", sentence.alias("summary"))


def total_jobs(*counts: str) -> Column:
    return sum((F.coalesce(F.col(c), F.lit(0)) for c in counts), F.lit(0))


def discovery_counts(boards: DataFrame, hits: DataFrame) -> DataFrame:
    n_hits = hits.agg(F.count("*")).scalar()
    flags = [c for c in boards.columns if c.startswith("has_") and c != "has_any_board"]
    return boards.agg(
        F.count("*").alias("candidate_company_count"),
        *[F.count_if(F.col(f)).alias(f.removeprefix("has_") + "_hits") for f in flags],
    ).withColumn("search_result_count", n_hits)


def discovery_metadata(asked: DataFrame, boards: DataFrame, hits: DataFrame, warnings: DataFrame) -> DataFrame:
    """What a discovery run asked and found, a row per profile of `asked` (summary, keywords, regions, queries).

    `warnings` has (ord, warning); they are listed in order, with their number, beside the counts of the boards.
    """
    listed = F.transform(F.array_sort(F.collect_list(F.struct("ord", "warning"))), lambda w: w["warning"])
    told = warnings.agg(F.count("*").alias("search_warning_count"), listed.alias("search_warnings"))
    found = discovery_counts(boards, hits)
    one = found.join(F.broadcast(told))  # one row beside one row
    return asked.select(
        *[c for c in ("profile_id",) if c in asked.columns], F.col("summary").alias("profile_summary"), F.col("keywords").alias("keywords_used"),
        F.col("regions").alias("regions_used"), F.col("queries").alias("queries_used")).join(F.broadcast(one))
