"""Declared schemas. Readers never infer; lists keep their order; `ord` columns carry row order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

STR, INT, LONG, DBL, BOOL = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType()
STRS = T.ArrayType(STR)


def struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


SALARY = struct(currency=STR, minimum=DBL, maximum=DBL, interval=STR)

POSTING = struct(
    id=STR, source=STR, source_url=STR, title=STR, company=STR, location=STR, work_mode=STR,
    salary=SALARY, description=STR, required_skills=STRS, preferred_skills=STRS,
    responsibilities=STRS, minimum_qualifications=STRS, domain_signals=STRS,
    application_url=STR, date_posted=STR, language_requirements=STRS, raw_payload=STR,
)
POSTING_LISTS = [
    "required_skills", "preferred_skills", "responsibilities", "minimum_qualifications",
    "domain_signals", "language_requirements",
]

SECTION = struct(heading=STR, level=INT, content=STR)
SKILL = struct(name=STR, category=STR, evidence_count=INT)
EXPERIENCE = struct(
    title=STR, company=STR, start_date=STR, end_date=STR, highlights=STRS, technologies=STRS,
    domains=STRS, leadership_signals=STRS,
)
PROJECT = struct(
    name=STR, role=STR, description=STR, highlights=STRS, technologies=STRS, domains=STRS,
    links=STRS,
)
EDUCATION = struct(institution=STR, degree=STR, date_range=STR, notes=STRS)
PROFILE = struct(
    profile_id=STR, name=STR, headline=STR, summary=STR, source_files=STRS,
    work_experience=T.ArrayType(EXPERIENCE), projects=T.ArrayType(PROJECT),
    education=T.ArrayType(EDUCATION), skills=T.ArrayType(SKILL), tools=STRS,
    programming_languages=STRS, research_topics=STRS, domain_strengths=STRS,
    leadership_experience=STRS, publications=STRS, portfolio_links=STRS, role_families=STRS,
    industries=STRS, locations=STRS, search_keywords=STRS, seniority_hint=STR, raw_text=STR,
    sections=T.ArrayType(SECTION), model_summary=STR,
)
INSIGHTS = struct(
    profile_id=STR, summary=STR, role_families=STRS, search_keywords=STRS,
    domain_strengths=STRS, industries=STRS, seniority_hint=STR,
)
QUERY = struct(
    profile_id=STR, query_ord=INT, text=STR, title=STR, location=STR, language=STR,
    rationale=STR, terms=STRS,
)
ASSESSMENT = struct(
    fit_label=STR, why_match=STR, missing_requirements=STRS,
    recommended_resume_emphasis=STR, recommended_cover_letter_angle=STR,
)
EVIDENCE = struct(profile_id=STR, ord=LONG, text=STR, source_section=STR)
FETCH_LOG = struct(source=STR, url=STR, status_code=INT, message=STR, kind=STR, ord=LONG)
PROBES = struct(kind=STR, slug=STR, url=STR, status=INT, api_status=INT, api_ok=BOOL, jobs_count=LONG)

WORK_MODES = ["remote", "hybrid", "onsite", "unknown"]
DISPOSITIONS = ["apply", "maybe", "skip"]
MATCH_STATUSES = ["strong_match", "partial_match", "missing", "uncertain"]


def empty_list() -> Column:
    return F.array().cast(STRS)


def conform(df: DataFrame, schema: T.StructType, keep: list[str] = ()) -> DataFrame:
    """Project onto a schema: missing lists become [], other missing columns null."""

    def column(f: T.StructField) -> Column:
        is_list = isinstance(f.dataType, T.ArrayType)
        if f.name not in df.columns:
            base = F.array() if is_list else F.lit(None)
        else:
            base = F.coalesce(df[f.name], F.array()) if is_list else df[f.name]
        return base.cast(f.dataType).alias(f.name)

    return df.select(*[F.col(k) for k in keep], *[column(f) for f in schema.fields])


def violations(df: DataFrame) -> DataFrame:
    """Posting rows with the list of rules they break (empty list = valid)."""
    checks = {
        "id missing": F.col("id").isNull(),
        "source missing": F.col("source").isNull(),
        "source_url missing": F.col("source_url").isNull(),
        "title missing": F.col("title").isNull(),
        "company missing": F.col("company").isNull(),
        "work_mode invalid": ~F.coalesce(F.col("work_mode"), F.lit("")).isin(WORK_MODES),
    }
    found = F.array(*[F.when(test, F.lit(name)) for name, test in checks.items()])
    return df.withColumn("violations", F.array_compact(found))
