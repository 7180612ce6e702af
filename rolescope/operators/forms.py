"""Search-form fields of career sites and the filter plans derived from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rolescope import fixed_values as V
from rolescope.functions import text as t
from rolescope.functions.html import MAX_OPTIONS, form_fields, page_nodes
from rolescope.operators.dedupe import dedupe_fields, dedupe_plans
from rolescope.settings import Settings

MAX_SEARCH_TERMS = 6


def filter_kind(hint_text: Column, kinds: dict[str, list[str]] = V.FILTER_KINDS) -> Column:
    """First kind one of whose hints is contained in the field's own texts."""
    def choose(hay: Column) -> Column:
        out = F.lit("unknown")
        for kind in reversed(kinds):
            out = F.when(t.contains_any(hay, kinds[kind]), F.lit(kind)).otherwise(out)
        return out
    return t.let(t.normalize_text(t.text_or_empty(hint_text)), choose)


def filter_fields(pages: DataFrame, key: list[str] = ("url",), max_options: int | None = MAX_OPTIONS) -> DataFrame:
    """(key, ord, name, label, type, semantic_kind, selector, options), first of equal fields kept.

    A select keeps its first `max_options` options, all with None.
    """
    found = pages.withColumn("_fields", t.let(page_nodes(F.col("html")), lambda page: form_fields(page, max_options)))
    return found.select(*key, F.posexplode(dedupe_fields(F.col("_fields"))).alias("ord", "f")).select(
        *key, "ord", "f.name", "f.label", "f.type", filter_kind(F.col("f.hint_text")).alias("semantic_kind"),
        "f.selector", "f.options")


def first_option_match(options: Column, wanted: Column) -> Column:
    """For each wanted value in order, the first option equal to, containing or inside it."""

    def hit(w: Column) -> Column:
        return t.let(t.normalize_text(w), lambda key: F.get(F.filter(options, lambda o: t.let(
            t.normalize_text(o), lambda n: F.contains(n, key) | F.contains(key, n))), F.lit(0)))

    return F.get(F.filter(F.transform(wanted, hit), lambda x: x.isNotNull()), F.lit(0))


def site_search_terms(queries: Column, settings: Settings) -> Column:
    """Titles and keywords, then title, terms and short text of every query; distinct in order."""
    def of_query(q: Column) -> Column:
        words = F.size(F.filter(F.split(q["text"], r"(?U)\s+", -1), lambda w: w != ""))
        return F.concat(
            F.when(F.coalesce(q["title"], F.lit("")) != "", F.array(q["title"])).otherwise(F.array().cast("array<string>")),
            F.coalesce(q["terms"], F.array().cast("array<string>")),
            F.when(words <= 4, F.array(q["text"])).otherwise(F.array().cast("array<string>")))

    return t.unique_ordered(F.concat(
        t.string_array(settings.job_titles + settings.include_keywords), F.flatten(F.transform(queries, of_query))))


def filter_plans(
    fields: DataFrame, sites: DataFrame, queries: Column, settings: Settings = Settings(), key: str = "url"
) -> DataFrame:
    """(key, plan_ord, plan map): one base plan, then one per search term, capped per site.

    `sites` holds (key, company, max_plans); `queries` is the bounded list of query structs.
    """
    by_kind = fields.where(F.col("semantic_kind") != "unknown").groupBy(key).agg(*[
        F.max(F.when(F.col("semantic_kind") == k, F.struct("ord", "options"))).alias(k)
        for k in ("country_region", "company", "category", "search_text")])
    rows = by_kind.join(sites.select(key, F.col("company").alias("_company"), "max_plans"), key)
    own = F.when(F.coalesce("_company", F.lit("")) != "", F.array("_company")).otherwise(
        F.array().cast("array<string>"))
    wanted = {
        "country_region": t.string_array(settings.target_countries), "company": own,
        "category": t.string_array(settings.job_titles + settings.include_keywords),
    }

    def entry(kind: str, values: Column) -> Column:
        return t.let(first_option_match(F.col(f"{kind}.options"), values), lambda v: F.when(
            v.isNotNull(), F.struct(F.lit(kind).alias("key"), v.alias("value"))))

    entries = F.array_compact(F.array(*[entry(kind, values) for kind, values in wanted.items()]))
    terms = F.when(F.col("search_text").isNotNull(), F.slice(site_search_terms(queries, settings), 1, MAX_SEARCH_TERMS))
    searching = F.transform(F.coalesce(terms, F.array().cast("array<string>")), lambda term: F.map_from_entries(
        F.concat(F.col("_base"), F.array(F.struct(F.lit("search_text").alias("key"), term.alias("value"))))))
    alone = F.when(F.size("_base") > 0, F.array(F.map_from_entries("_base"))).otherwise(F.slice(searching, 1, 0))
    plans = F.slice(dedupe_plans(F.concat(alone, searching)), F.lit(1), F.col("max_plans"))
    return rows.withColumn("_base", entries).select(key, F.posexplode(plans).alias("plan_ord", "plan"))


def render_urls(url: Column, seeds: Column, include: Column) -> Column:
    """Page url, seeds, and the url with each single-segment include pattern appended."""
    base = F.regexp_replace(url, r"/+\z", "")
    plain = F.filter(
        F.transform(include, lambda p: F.btrim(t.strip(p), F.lit("/"))),
        lambda p: (p != "") & ~F.contains(p, F.lit("/")))
    return F.array_distinct(F.concat(
        F.array(url), seeds, F.transform(plain, lambda p: F.concat(base, F.lit("/"), p))))
