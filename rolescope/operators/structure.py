"""Headed documents: sections, children of a section, and a structured profile."""

from __future__ import annotations

import heapq
import re
from collections import Counter
from collections.abc import Iterator
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from rolescope import fixed_values as V, schemas as S
from rolescope.functions import text as t
from rolescope.functions.batches import in_slices
from rolescope.operators import normalize

HEADING = r"(?mU)^[^\S\n]*(#{1,6})[^\S\n]+(\S[^\n]*)$"
LINK = r"(?U)https?://\S+"
SLICE = 256  # texts that are Python objects at a time
COUNTED = pa.list_(pa.struct({"term": pa.string(), "count": pa.int64()}))


def sections(text: t.Expr) -> Column:
    """array<struct<heading, level, content>> of a headed text.

    Text before the first heading is "Introduction"; a heading directly followed by another one,
    or by the end, has no lines of its own and is dropped unless nothing else is left.
    """

    def build(body: Column) -> Column:
        marks = F.regexp_extract_all(body, F.lit(HEADING), F.lit(1))
        names = F.regexp_extract_all(body, F.lit(HEADING), F.lit(2))
        bodies = F.split(body, HEADING, -1)
        own = F.transform(bodies, lambda b, i: F.when(i == 0, b).otherwise(F.regexp_replace(b, r"\A\n", "")))
        heads = F.concat(
            F.array(F.struct(F.lit("Introduction").alias("heading"), F.lit(1).alias("level"))),
            F.zip_with(names, marks, lambda n, m: F.struct(t.strip(n).alias("heading"), F.length(m).alias("level"))),
        )
        rows = F.zip_with(heads, own, lambda h, b: F.struct(
            h["heading"].alias("heading"), h["level"].alias("level"), b.alias("content")))

        def finish(all_rows: Column) -> Column:
            kept = F.filter(all_rows, lambda r: r["content"] != "")
            last = F.slice(all_rows, -1, 1)
            return F.transform(
                F.when(F.size(kept) > 0, kept).otherwise(last),
                lambda r: F.struct(r["heading"].alias("heading"), r["level"].alias("level"),
                                   t.strip(r["content"]).alias("content")))

        return t.let(rows, finish)

    return t.let(F.regexp_replace(t.text_or_empty(text), t.LINE_BREAK, "\n"), build)


def split_sections(docs: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    return docs.select(*key, F.posexplode(sections(text)).alias("ord", "_s")).select(*key, "ord", "_s.*")


def child_sections(rows: Column, terms: list[str]) -> Column:
    """Sections one level below the first section whose heading holds a term, until its end."""

    def after(items: Column, at: Column) -> Column:
        parent = F.get(items, at)
        rest = F.slice(items, at + 2, F.size(items))
        ends = F.filter(
            F.transform(rest, lambda s, i: F.when(s["level"] <= parent["level"], i)), lambda i: i.isNotNull())
        span = F.slice(rest, F.lit(1), F.coalesce(F.get(ends, F.lit(0)), F.size(rest)))
        return F.filter(span, lambda s: s["level"] == parent["level"] + 1)

    def find(items: Column) -> Column:
        hits = F.filter(
            F.transform(items, lambda s, i: F.when(t.contains_any(F.lower(s["heading"]), terms), i)),
            lambda i: i.isNotNull())
        return t.let(F.get(hits, F.lit(0)), lambda at: F.when(at.isNull(), F.slice(items, 1, 0)).otherwise(
            after(items, at)))

    return t.let(rows, find)


def dated_heading(heading: Column) -> Column:
    """struct<first, second, third> of an "A | B | C" heading."""
    parts = F.transform(F.split(heading, r"\|", -1), t.strip)
    return F.struct(
        F.get(parts, F.lit(0)).alias("first"), F.get(parts, F.lit(1)).alias("second"),
        F.get(parts, F.lit(2)).alias("third"))


def date_range(value: Column) -> Column:
    """struct<start, end>; only a dash or "to" with spaces around it splits."""
    parts = F.split(value, rf"{t.WS}+-{t.WS}+|{t.WS}+to{t.WS}+", 2)
    return F.struct(
        F.when(value == "", None).when(F.size(parts) == 2, t.strip(F.get(parts, F.lit(0)))).otherwise(value)
        .alias("start"),
        F.when(F.size(parts) == 2, t.strip(F.get(parts, F.lit(1)))).alias("end"))


def term_counts(text: t.Expr, n: int = 15, stop_words: list[str] = V.TERM_STOP_WORDS) -> Column:
    """array<struct<term, count>>: most frequent content words, earlier first on ties.

    A text is one row, so it is counted where it lies; exploding its words would shuffle them all, and array
    expressions would sort them as objects.
    """
    stopped = frozenset(stop_words)

    def best(low: str) -> list[dict]:
        counts = Counter(re.findall(t.TOKEN, low))  # in order of first appearance, which nlargest keeps on ties
        kept = [x for x in counts.items() if len(x[0]) > 2 and x[0] not in stopped]
        return [{"term": term, "count": count} for term, count in heapq.nlargest(n, kept, key=itemgetter(1))]

    def counted(batches):
        return in_slices(((batch,) for batch in batches), SLICE, best, COUNTED)

    # annotations as objects: the kind of function is chosen from them
    counted.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(counted, "array<struct<term: string, count: bigint>>")(F.lower(t.text_or_empty(text)))


def top_terms(docs: DataFrame, key: list[str], text: str, n: int = 15, stop_words: list[str] = V.TERM_STOP_WORDS) -> DataFrame:
    """(key, pos, term, count) of the most frequent content words."""
    counted = docs.select(*key, term_counts(text, n, stop_words).alias("_t"))
    return counted.select(*key, F.posexplode_outer("_t").alias("pos", "x")).where("x is not null").select(*key, "pos", "x.*")


def _skills(text: Column, skills: dict[str, list[str]]) -> Column:
    return t.unique_ordered(t.phrase_matches(text, normalize.skill_terms(skills)))


def _category(name: Column, skills: dict[str, list[str]]) -> Column:
    out = F.lit("general")
    for category in reversed(skills):
        out = F.when(F.lower(name).isin(skills[category]), F.lit(category)).otherwise(out)
    return out


def structure_profiles(
    docs: DataFrame, skills: dict[str, list[str]] = V.SKILLS, domains: dict[str, list[str]] = V.DOMAINS,
    industries: dict[str, list[str]] = V.INDUSTRIES, families: dict[str, list[str]] = V.ROLE_FAMILIES,
) -> DataFrame:
    """Profiles from (profile_id, raw_text, source_files, sections) documents."""
    named_families = {k.replace("_", " "): v for k, v in families.items()}
    c = F.col

    def combined(highlights: Column, content: Column) -> Column:
        return t.first_filled(F.array_join(highlights, " "), content)

    def experience(s: Column) -> Column:
        def row(head: Column, high: Column) -> Column:
            body, span = combined(high, s["content"]), date_range(head["third"])
            return F.struct(
                F.coalesce(head["first"], t.strip(s["heading"])).alias("title"), head["second"].alias("company"),
                span["start"].alias("start_date"), span["end"].alias("end_date"), high.alias("highlights"),
                _skills(body, skills).alias("technologies"),
                t.parents_matched(body, domains).alias("domains"),
                t.phrase_matches(body, skills.get("leadership", [])).alias("leadership_signals"))
        return t.let(dated_heading(s["heading"]), lambda h: t.let(t.bullets_or_sentences(s["content"]), lambda b: row(h, b)))

    def project(s: Column) -> Column:
        def row(high: Column) -> Column:
            body = combined(high, s["content"])
            return F.struct(
                s["heading"].alias("name"), F.lit(None).cast("string").alias("role"), body.alias("description"),
                high.alias("highlights"), _skills(body, skills).alias("technologies"),
                t.parents_matched(body, domains).alias("domains"),
                F.regexp_extract_all(s["content"], F.lit(LINK), F.lit(0)).alias("links"))
        return t.let(t.bullets_or_sentences(s["content"]), row)

    def education(s: Column) -> Column:
        return t.let(dated_heading(s["heading"]), lambda h: F.struct(
            t.first_filled(h["second"], h["first"]).alias("institution"), h["first"].alias("degree"),
            h["third"].alias("date_range"), t.bullets_or_sentences(s["content"]).alias("notes")))

    first = F.get("sections", F.lit(0))
    lines = F.filter(F.transform(t.split_lines(t.text_or_empty(first["content"])), t.strip), lambda x: x != "")
    raw = c("raw_text")
    base = docs.withColumn("_counted", term_counts("raw_text", 12)).withColumns({
        "_terms": F.transform("_counted", lambda x: x["term"]),
        "headline": F.get(lines, F.lit(0)),
        "_skills": _skills(raw, skills),
        "domain_strengths": t.unique_ordered(t.parents_matched(raw, domains)),
        "role_families": t.unique_ordered(t.parents_matched(raw, named_families)),
        "portfolio_links": F.regexp_extract_all(raw, F.lit(LINK), F.lit(0)),
    })
    low = F.lower(raw)
    full = base.withColumns({
        "name": F.when(first["heading"] != "Introduction", first["heading"]),
        "summary": F.coalesce(t.first_filled("headline", F.array_join(F.slice("_terms", 1, 10), " ")), F.lit("")),
        "work_experience": F.transform(
            child_sections(c("sections"), ["experience", "employment", "work history"]), experience),
        "projects": F.transform(child_sections(c("sections"), ["project"]), project),
        "education": F.transform(child_sections(c("sections"), ["education"]), education),
        "skills": t.let(low, lambda text: F.transform("_skills", lambda s: F.struct(
            s.alias("name"), _category(s, skills).alias("category"),
            F.greatest(F.lit(1), t.occurrences(text, F.lower(s))).alias("evidence_count")))),
        "tools": t.unique_ordered(t.phrase_matches(raw, skills.get("frameworks", []) + skills.get("cloud", []))),
        "programming_languages": t.phrase_matches(raw, skills.get("programming_languages", [])),
        "research_topics": c("domain_strengths"),
        "leadership_experience": t.phrase_matches(raw, skills.get("leadership", [])),
        "publications": F.filter("portfolio_links", lambda x: F.contains(F.lower(x), F.lit("publication"))),
        "industries": t.unique_ordered(t.parents_matched(raw, industries)),
        "search_keywords": t.unique_ordered(F.concat("_skills", "domain_strengths", "role_families", "_terms")),
        "seniority_hint": normalize.seniority_hint(raw),
    })
    return S.conform(full, S.PROFILE)


def apply_insights(profiles: DataFrame, insights: DataFrame) -> DataFrame:
    """Merge model-made additions: lists are united in order, filled scalars win."""
    extra = insights.select("profile_id", F.struct(*[x for x in insights.columns if x != "profile_id"]).alias("_i"))
    rows = profiles.join(extra, "profile_id", "left")
    known = F.col("_i").isNotNull()
    merged = {
        name: F.when(known, t.unique_ordered(F.concat(
            F.col(name), F.coalesce(F.col(f"_i.{name}"), F.array()).cast("array<string>")))).otherwise(F.col(name))
        for name in ("role_families", "search_keywords", "domain_strengths", "industries")
    }
    return rows.withColumns({
        **merged,
        "model_summary": F.when(known, F.col("_i.summary")).otherwise(F.col("model_summary")),
        "summary": F.coalesce(t.first_filled("_i.summary", "summary"), F.lit("")),
        "seniority_hint": t.first_filled("_i.seniority_hint", "seniority_hint"),
    }).drop("_i")


def insights_from_payload(payloads: DataFrame, profiles: DataFrame) -> DataFrame:
    """(profile_id, payload JSON) to insights; every missing field falls back to the profile."""
    v = F.try_parse_json("payload")
    scalar = lambda n: F.coalesce(F.try_variant_get(v, f"$.{n}", "string"), F.col(n))
    listed = lambda n: t.unique_ordered(F.coalesce(F.try_variant_get(v, f"$.{n}", "array<string>"), F.col(n)))
    lists = ["role_families", "search_keywords", "domain_strengths", "industries"]
    return profiles.join(payloads, "profile_id", "left").select(
        "profile_id", scalar("summary").alias("summary"), *[listed(n).alias(n) for n in lists],
        scalar("seniority_hint").alias("seniority_hint"))
