"""Posting normalization: list clean-up, salary, work mode, skills, domains, languages, seniority."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rolescope import fixed_values as V, schemas as S
from rolescope.functions import text as t

SALARY_PATTERN = (
    r"(?iU)(EUR|GBP|USD|€|£|\$)\s*(\d[\d,]*(?:\.\d+)?)(?:\s*(?:-|–|to)\s*(\d[\d,]*(?:\.\d+)?))?"
)


def salary_range(text: t.Expr) -> Column:
    """First "currency amount [- amount]" of a text as a yearly range, null when there is none."""
    names = F.create_map(*[F.lit(x) for pair in V.CURRENCY_SYMBOLS.items() for x in pair])

    def parts(found: Column) -> Column:
        def amount(group: int) -> Column:
            return F.regexp_replace(F.regexp_extract(found, SALARY_PATTERN, group), ",", "").try_cast("double")

        symbol = F.upper(F.regexp_extract(found, SALARY_PATTERN, 1))
        return F.when(
            amount(2).isNotNull(),
            F.struct(
                F.coalesce(F.try_element_at(names, symbol), symbol).alias("currency"),
                amount(2).alias("minimum"),
                amount(3).alias("maximum"),
                F.lit("year").alias("interval"),
            ),
        ).cast(S.SALARY)

    # the whole text is searched once; the groups are read from the short match
    return t.let(F.regexp_extract(t.text_or_empty(text), SALARY_PATTERN, 0), parts)


def work_mode(*texts: t.Expr) -> Column:
    """First of hybrid, remote, onsite that the texts speak of, else unknown."""

    def mode(hay: Column) -> Column:
        has = lambda word: F.contains(hay, F.lit(word))
        return (
            F.when(has("hybrid"), "hybrid").when(has("remote") | has("work from home"), "remote")
            .when(has("on-site") | has("onsite") | has("office"), "onsite").otherwise("unknown")
        )

    return t.let(F.lower(F.concat_ws(" ", *[t.text_or_empty(x) for x in texts])), mode)


def skill_terms(skills: dict[str, list[str]] = V.SKILLS) -> list[str]:
    return [term for terms in skills.values() for term in terms]


def skill_mentions(text: t.Expr, terms: list[str] | None = None, whole_word: bool = False) -> Column:
    found = t.phrase_matches(t.text_or_empty(text), terms or skill_terms(), whole_word)
    return t.unique_ordered(found)


def domain_signals(
    text: t.Expr,
    domains: dict[str, list[str]] = V.DOMAINS,
    industries: dict[str, list[str]] = V.INDUSTRIES,
) -> Column:
    c = t.text_or_empty(text)
    return t.unique_ordered(F.concat(t.parents_matched(c, domains), t.parents_matched(c, industries)))


def language_requirements(text: t.Expr, languages: list[str] = V.LANGUAGES) -> Column:
    return t.let(
        F.lower(t.text_or_empty(text)),
        lambda hay: F.filter(t.string_array(languages), lambda name: F.contains(hay, name)),
    )


def seniority_hint(text: t.Expr, order: list[str] = V.SENIORITY_ORDER) -> Column:
    return t.first_contained(F.lower(t.text_or_empty(text)), order)


def normalize_postings(postings: DataFrame) -> DataFrame:
    """Ordered-distinct lists, salary from the description when absent, work mode when unknown."""
    lists = {name: t.unique_ordered(F.col(name)) for name in S.POSTING_LISTS}
    unknown = F.coalesce(F.col("work_mode"), F.lit("unknown")) == "unknown"
    return postings.withColumns({
        **lists,
        "salary": F.coalesce(F.col("salary"), salary_range("description")),
        "work_mode": F.when(unknown, work_mode("location", "description")).otherwise(F.col("work_mode")),
    })


def clean_requirement(x: t.Expr, limit: int = 180) -> Column:
    """Tags out, spaces squeezed, edge marks and a leading label dropped, clipped to whole words."""
    c = F.regexp_replace(t.as_col(x), "<[^>]+>", " ")
    c = F.regexp_replace(c, rf"{t.WS}+", " ")
    c = F.btrim(c, F.lit(" -*\t\r\n:.;"))
    c = F.regexp_replace(
        c, r"(?i)\A(requirements?|responsibilities|qualifications?|preferred|nice to have)\s*[:\-]\s*", ""
    )
    return t.let(c, lambda v: t.clip_text(v, limit))


def is_noise_requirement(requirement: Column, description: Column) -> Column:
    """One-character requirements, unless it is "c" and the description names C as a language."""
    names_c = description.rlike(r"(?<![A-Za-z])C(?:\s*(?:/|\+\+)|\s+programming|\s+language|[,\.;:]|\z)")
    return (F.length(requirement) <= 1) & ~((F.lower(requirement) == "c") & names_c)


def is_vague_requirement(requirement: Column, description_normalized: Column) -> Column:
    """Vague wording without emphasis in itself or in the description."""
    pairs = [f"{e} {v}" for e in V.EMPHASIS_TERMS for v in V.VAGUE_TERMS]
    return t.let(
        t.normalize_text(requirement),
        lambda r: t.contains_any(r, V.VAGUE_TERMS)
        & ~t.contains_any(r, V.EMPHASIS_TERMS)
        & ~t.contains_any(description_normalized, pairs),
    )
