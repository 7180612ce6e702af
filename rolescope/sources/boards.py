"""Job-board payload files landed as JSON, one file per board or page, read into postings.

Payloads are kept as VARIANT: every lookup is typed and lenient, no schema is inferred.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rolescope import schemas as S
from rolescope.functions import text as t
from rolescope.functions.html import html_text, page_facts
from rolescope.operators import normalize


def _payload_rows(spark: SparkSession, path: str, items: str) -> DataFrame:
    """(board, file, ord, job VARIANT) of every posting in the payload files."""
    files = spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("file"), F.try_parse_json("value").alias("v"))
    board = F.regexp_replace(F.regexp_extract("file", r"([^/]+)\z", 1), r"\.json\z", "")
    return files.select(
        "file", F.url_decode(board).alias("board"),
        F.posexplode(F.try_variant_get("v", items, "array<variant>")).alias("ord", "job"))


def _get(path: str, of: str = "job") -> Column:
    return F.try_variant_get(F.col(of), path, "string")


def _or(*paths: str) -> Column:
    """First filled value of several paths ("" counts as absent)."""
    return t.first_filled(*[_get(p) for p in paths])


def _board_company() -> Column:
    return t.title_case(F.replace(F.col("board"), F.lit("-"), F.lit(" ")))


def _finish(rows: DataFrame, columns: dict[str, Column], mode: Column) -> DataFrame:
    """Text-derived columns, then the shared normalization."""
    d = F.col("description")
    rows = rows.withColumns(columns).withColumns({
        "work_mode": mode, "required_skills": normalize.skill_mentions(d),
        "domain_signals": normalize.domain_signals(d),
        "language_requirements": normalize.language_requirements(d),
        "raw_payload": F.to_json("job"),
    })
    return normalize.normalize_postings(S.conform(rows, S.POSTING, keep=["file", "ord"]))


def _first_bullets() -> Column:
    return F.slice(t.bullets_or_sentences("description"), 1, 6)


def _or_list(values: Column, other: Column) -> Column:
    return t.let(F.coalesce(values, F.array().cast("array<string>")), lambda v: F.when(F.size(v) > 0, v).otherwise(other))


def read_greenhouse(spark: SparkSession, path: str) -> DataFrame:
    rows = _payload_rows(spark, path, "$.jobs")
    facts = rows.withColumn("_f", page_facts(F.coalesce(_get("$.content"), F.lit(""))))
    place = F.when(
        F.try_variant_get("job", "$.location", "map<string,variant>").isNotNull(), _get("$.location.name")
    ).otherwise(_get("$.location"))
    rows = facts.withColumn("description", F.col("_f.text"))
    return _finish(rows, {
        "id": F.coalesce(_get("$.id"), F.lit("None")), "source": F.lit("greenhouse"),
        "source_url": F.coalesce(_or("$.absolute_url", "$.url"), F.lit("")),
        "title": F.coalesce(_get("$.title"), F.lit("Unknown title")),
        "company": t.first_filled(
            F.coalesce(_get("$.company_name"), _board_company()), _get("$.company"), _get("$.board_token"), "board"),
        "location": place, "application_url": _or("$.absolute_url", "$.url"),
        "date_posted": _or("$.updated_at", "$.created_at"),
        "preferred_skills": F.col("_f.preferred_qualifications"),
        "responsibilities": _or_list(F.col("_f.responsibilities"), _first_bullets()),
        "minimum_qualifications": F.col("_f.minimum_qualifications"),
    }, normalize.work_mode("description"))


def read_lever(spark: SparkSession, path: str) -> DataFrame:
    rows = _payload_rows(spark, path, "$")
    lists = F.transform(
        F.coalesce(F.try_variant_get("job", "$.lists", "array<variant>"), F.array().cast("array<variant>")),
        lambda x: F.struct(
            F.coalesce(F.try_variant_get(x, "$.text", "string"), F.lit("")).alias("text"),
            F.coalesce(F.try_variant_get(x, "$.content", "string"), F.lit("")).alias("content")))
    rows = rows.withColumn("_lists", lists)
    parts = F.concat(
        F.array(*[F.coalesce(_get(p), F.lit("")) for p in ("$.description", "$.descriptionPlain", "$.additional")]),
        F.flatten(F.transform("_lists", lambda x: F.array(x["text"], x["content"]))))
    rows = rows.withColumn("description", html_text(F.array_join(F.filter(parts, lambda x: x != ""), "\n")))

    def contents(test) -> Column:
        return F.transform(F.filter("_lists", lambda x: test(F.lower(x["text"]))), lambda x: x["content"])

    return _finish(rows, {
        "id": F.coalesce(_get("$.id"), F.lit("None")), "source": F.lit("lever"),
        "source_url": F.coalesce(_or("$.hostedUrl", "$.applyUrl"), F.lit("")),
        "title": F.coalesce(_get("$.text"), F.lit("Unknown title")),
        "company": F.coalesce(
            t.first_filled(F.coalesce(_get("$.company"), _board_company()), _get("$.categories.team")),
            F.lit("Unknown company")),
        "location": _get("$.categories.location"), "application_url": _or("$.applyUrl", "$.hostedUrl"),
        "date_posted": _or("$.createdAt", "$.updatedAt"),
        "preferred_skills": contents(lambda h: F.contains(h, F.lit("preferred"))),
        "responsibilities": _or_list(contents(lambda h: F.contains(h, F.lit("respons"))), _first_bullets()),
        "minimum_qualifications": contents(lambda h: h.isin("requirements", "basic qualifications")),
    }, normalize.work_mode("location", "description"))


def read_ashby(spark: SparkSession, path: str) -> DataFrame:
    rows = _payload_rows(spark, path, "$.jobs")
    sections = F.transform(
        F.coalesce(F.try_variant_get("job", "$.jobPostSections", "array<variant>"), F.array().cast("array<variant>")),
        lambda x: F.coalesce(F.try_variant_get(x, "$.content", "string"), F.lit("")))
    parts = F.concat(F.array(*[
        F.coalesce(_get(p), F.lit("")) for p in ("$.description", "$.descriptionHtml", "$.content", "$.jobDescription")
    ]), sections)
    rows = rows.withColumn("description", html_text(F.array_join(F.filter(parts, lambda x: x != ""), "\n")))
    url = F.coalesce(_or("$.jobUrl", "$.applyUrl", "$.url"), F.lit(""))
    return _finish(rows, {
        "id": t.first_filled(_get("$.id"), _get("$.jobId"), url), "source": F.lit("ashby"), "source_url": url,
        "title": F.coalesce(_or("$.title", "$.jobTitle"), F.lit("Unknown title")),
        "company": t.first_filled(F.coalesce(_get("$.companyName"), _board_company()), F.lit("Unknown company")),
        "location": _or("$.location", "$.jobLocation", "$.secondaryLocation", "$.locationName"),
        "application_url": t.first_filled(_get("$.applyUrl"), url),
        "date_posted": _or("$.postedDate", "$.publishedAt", "$.updatedAt"),
        "responsibilities": _first_bullets(),
    }, normalize.work_mode("location", "description"))
