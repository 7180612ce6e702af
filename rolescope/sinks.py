"""Writers and the row forms of every report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rolescope import fixed_values as V
from rolescope.functions import text as t
from rolescope.operators.discovery import BOARDS

EXCERPT = 280


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def ranked_csv_rows(ranked: DataFrame) -> DataFrame:
    """The fixed columns of the ranked table as text, in fixed order."""
    zero = F.lit(0.0)
    columns = {
        **{c: F.col(c) for c in V.RANKED_CSV_COLUMNS if c in ranked.columns},
        "missing_skills": F.array_join("missing_skills", " | "),
    }
    return ranked.select(*[columns.get(c, zero).cast("string").alias(c) for c in V.RANKED_CSV_COLUMNS])


def write_ranked_csv(ranked: DataFrame, path: str) -> None:
    ordered = ranked.orderBy("profile_id", "rank")
    ranked_csv_rows(ordered).write.mode("overwrite").option("header", True).csv(path)


def _line(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def top_match_lines(ranked: DataFrame, n: int = 20) -> DataFrame:
    """(profile_id, rank, line_ord, line): one Markdown block per ranked row up to n."""
    c = F.col
    missing = F.array_join("missing_skills", ", ")
    block = F.array(
        _line("## ", c("rank"), ". ", c("title"), " @ ", c("company")),
        _line("- Score: ", c("overall_score")), _line("- Disposition: ", c("disposition")),
        _line("- Location: ", t.first_filled("location", F.lit("Unknown")), " | Work mode: ", c("work_mode")),
        _line("- Source: ", c("source")), _line("- Why it matches: ", c("why_match")),
        _line("- Missing skills: ", t.first_filled(missing, F.lit("None flagged"))),
        _line("- Resume emphasis: ", c("recommended_resume_emphasis")),
        _line("- Cover-letter angle: ", c("recommended_cover_letter_angle")),
        _line("- Apply URL: ", t.first_filled("application_url", "source_url")), F.lit(""))
    return ranked.where(c("rank") <= n).select("profile_id", "rank", F.posexplode(block).alias("line_ord", "line"))


def excerpt(x: Column) -> Column:
    return t.let(t.squeeze(x), lambda v: t.clip_text(v, EXCERPT, "..."))


def _bullets(values: Column, empty: str) -> Column:
    return F.when(F.size(values) > 0, F.transform(values, lambda v: F.concat(F.lit("- "), v))).otherwise(
        F.array(F.lit(f"- {empty}")))


def match_report_lines(reports: DataFrame, key: list[str]) -> DataFrame:
    """(key, line_ord, line) of the Markdown form of match reports."""
    c = F.col
    two = lambda x: F.format_number(x, 2)

    def evidence(items: Column) -> Column:
        return F.concat(F.array(F.lit("- Evidence:")), F.when(F.size(items) > 0, F.transform(items, lambda e: _line(
            "  - [", e["source_section"], "] similarity ", two(e["similarity"]), ": ", excerpt(e["text"])))
        ).otherwise(F.array(F.lit("  - None supplied."))))

    def requirement(a: Column) -> Column:
        shared = F.when(F.size(a["transferable_skills"]) > 0, F.array(_line(
            "- Transferable skills: ", F.array_join(a["transferable_skills"], ", ")))).otherwise(
                F.array().cast("array<string>"))
        return F.concat(F.array(
            F.lit(""), _line("### ", a["requirement"]), _line("- Status: ", a["status"]),
            _line("- Confidence: ", two(a["confidence"])), _line("- Explanation: ", a["explanation"])),
            shared, evidence(a["evidence"]))

    def claim(a: Column) -> Column:
        wording = F.when(F.coalesce(a["safer_wording"], F.lit("")) != "", F.array(
            _line("- Safer wording: ", a["safer_wording"]))).otherwise(F.array().cast("array<string>"))
        return F.concat(F.array(
            F.lit(""), _line("### ", a["claim"]), F.lit("- Supported: false"),
            _line("- Confidence: ", two(a["confidence"])), _line("- Explanation: ", a["explanation"])),
            wording, evidence(a["evidence"]))

    def part(name: str, render, empty: str) -> Column:
        if name not in reports.columns:
            return F.array(F.lit(empty))
        return F.when(F.size(F.coalesce(c(name), F.array())) > 0, F.flatten(F.transform(name, render))).otherwise(
            F.array(F.lit(empty)))

    candidate = c("candidate_name") if "candidate_name" in reports.columns else F.lit(None).cast("string")
    lines = F.concat(
        F.array(
            _line("# Explainable Match Report: ", c("title"), " @ ", c("company")), F.lit(""),
            _line("- Candidate: ", t.first_filled(candidate, F.lit("Unknown"))),
            _line("- Overall score: ", two(c("overall_score"))),
            _line("- Recommendation: ", c("recommendation")), F.lit(""), F.lit("## Strengths")),
        _bullets(c("strengths"), "No strengths identified from supplied evidence."),
        F.array(F.lit(""), F.lit("## Gaps")), _bullets(c("gaps"), "No gaps identified from supplied evidence."),
        F.array(F.lit(""), F.lit("## Requirement Assessments")),
        part("assessments", requirement, "No requirements were extracted for this job."),
        F.array(F.lit(""), F.lit("## Unsupported Claims")),
        part("unsupported_claims", claim, "No unsupported claims were flagged."))
    return reports.select(*key, F.posexplode(lines).alias("line_ord", "line"))


def search_report_lines(
    totals: DataFrame, queries: DataFrame, stats: DataFrame, top: DataFrame, summary: str = "", notes: list[str] = (),
    samples: int = 15, top_n: int = 10,
) -> DataFrame:
    """(section, ord, line) of the run report; each part is small by its own limit."""
    c = F.col
    sources = stats.agg(F.array_join(F.transform(F.array_sort(F.collect_list(
        F.struct("source_ord", "source"))), lambda s: s["source"]), ", ")).scalar()
    n_queries = queries.agg(F.count("*")).scalar()
    head = totals.select(F.lit(0).alias("section"), F.posexplode(F.array(
        F.lit("# Search Report"), F.lit(""),
        _line("- Generated at: ", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss")),
        _line("- Sources searched: ", t.first_filled(sources, F.lit("None"))), _line("- Queries generated: ", n_queries),
        _line("- Raw jobs discovered: ", c("total_jobs_raw_discovered")),
        _line("- Jobs filtered out: ", c("total_jobs_filtered_out")),
        _line("- Jobs matched after filtering: ", c("total_jobs_discovered")),
        _line("- Jobs ranked: ", c("total_jobs_ranked")), F.lit(""), F.lit("## Profile Summary"),
        F.lit(summary or "No summary available."), F.lit(""), F.lit("## Query Samples"))).alias("ord", "line"))
    asked = queries.orderBy("query_ord").limit(samples).select(
        F.lit(1).alias("section"), c("query_ord").cast("int").alias("ord"),
        _line("- ", c("text"), " (", t.first_filled("rationale", F.lit("generated")), ")").alias("line"))
    counted = stats.select(F.lit(3).alias("section"), c("source_ord").cast("int").alias("ord"), _line(
        "- ", c("source"), ": raw ", c("raw_jobs_discovered"), ", filtered ", c("jobs_filtered_out"),
        ", matched ", c("jobs_matched")).alias("line"))
    best = top.where(c("rank") <= top_n).select(F.lit(5).alias("section"), c("rank").cast("int").alias("ord"), _line(
        "- ", c("title"), " @ ", c("company"), ": ", c("overall_score"), " [", c("disposition"), "]").alias("line"))
    titles = [(2, 0, ""), (2, 1, "## Source Stats"), (4, 0, ""), (4, 1, "## Top Jobs")]
    if notes:
        titles += [(6, 0, ""), (6, 1, "## Notes"), *[(7, i, f"- {n}") for i, n in enumerate(notes)]]
    fixed = totals.sparkSession.createDataFrame(titles, "section int, ord int, line string")
    return head.unionByName(asked).unionByName(counted).unionByName(best).unionByName(fixed)


def write_lines(lines: DataFrame, order: list[str], path: str) -> None:
    lines.orderBy(*order).select("line").write.mode("overwrite").text(path)


def keyword_pack(profiles: DataFrame) -> DataFrame:
    """(profile_id, section_ord, section, ord, value): ten lists, empty ones absent."""
    c = F.col
    summary = t.first_filled("model_summary", "summary")
    parts = [
        ("Summary", F.array_compact(F.array(summary))), ("Role Families", c("role_families")),
        ("Search Keywords", c("search_keywords")), ("Domain Strengths", c("domain_strengths")),
        ("Industries", c("industries")), ("Skills", F.transform("skills", lambda s: s["name"])),
        ("Tools", c("tools")), ("Programming Languages", c("programming_languages")),
        ("Research Topics", c("research_topics")), ("Locations", c("locations")),
    ]
    listed = F.array(*[F.struct(
        F.lit(i).alias("section_ord"), F.lit(name).alias("section"), v.cast("array<string>").alias("values"))
        for i, (name, v) in enumerate(parts)])
    return profiles.select("profile_id", F.explode(listed).alias("_s")).select(
        "profile_id", "_s.section_ord", "_s.section", F.posexplode("_s.values").alias("ord", "value"))


def filtered_out_rows(evaluated: DataFrame) -> DataFrame:
    """Rejected postings with the evaluation of their best query."""
    return evaluated.where(~F.col("query_match.matched"))


def discovered_rows(postings: DataFrame, source: str = "custom_career_pages") -> DataFrame:
    """Every parsed career-page posting before query filtering."""
    return postings.where(F.col("source") == source)


def site_filtered_rows(postings: DataFrame) -> DataFrame:
    """Postings found through a site's own filters."""
    method = F.get_json_object("raw_payload", "$.discovery_method")
    return postings.where(method == "site_filter").select("*", method.alias("discovery_method"))


def site_filtered_lines(rows: DataFrame, key: list[str]) -> DataFrame:
    c = F.col
    block = F.array_compact(F.array(
        _line("## ", c("title"), " @ ", c("company")), F.lit(""),
        _line("- Location: ", t.first_filled("location", F.lit("Unknown location"))), _line("- Source: ", c("source")),
        F.when(t.first_filled("source_url", "application_url").isNotNull(), _line(
            "- URL: ", t.first_filled("source_url", "application_url"))),
        F.when(c("discovery_method").isNotNull(), _line("- Discovery method: ", c("discovery_method"))), F.lit("")))
    return rows.select(*key, F.posexplode(block).alias("line_ord", "line"))


def write_company_boards(boards: DataFrame, path: str) -> None:
    """The full table and one table per board flag, from one persisted frame."""
    boards = boards.persist()
    try:
        boards.write.mode("overwrite").option("header", True).csv(f"{path}/all")
        for flag in [f"has_{k}" for k in BOARDS] + ["has_any_board"]:
            boards.where(F.col(flag)).write.mode("overwrite").option("header", True).csv(f"{path}/{flag}")
    finally:
        boards.unpersist()
