"""Search queries from a profile: title, domain, skill and location combinations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rolescope import fixed_values as V
from rolescope.functions import text as t
from rolescope.settings import Settings


def expand_titles(
    titles: Column, role_families: Column, families: dict[str, list[str]] = V.ROLE_FAMILIES
) -> Column:
    """Add a family's variants when its label is among the families or a variant among the titles."""

    def added(said: Column, held: Column) -> Column:
        return F.flatten(F.array(*[
            F.when(
                F.contains(held, F.lit(family.replace("_", " "))) | t.contains_any(said, variants),
                t.string_array(variants),
            ).otherwise(F.array().cast("array<string>"))
            for family, variants in families.items()
        ]))

    said = F.array_join(F.transform(titles, t.normalize_text), " ")
    held = F.lower(F.array_join(role_families, " "))
    return t.unique_ordered(F.concat(titles, t.let(said, lambda a: t.let(held, lambda b: added(a, b)))))


def expand_domains(terms: Column, domains: dict[str, list[str]] = V.DOMAINS) -> Column:
    """Add parent and synonyms of every domain one of whose names equals a given term."""

    def added(keys: Column) -> Column:
        return F.flatten(F.array(*[
            F.when(F.arrays_overlap(keys, t.string_array([parent, *names])), t.string_array([parent, *names]))
            .otherwise(F.array().cast("array<string>"))
            for parent, names in domains.items()
        ]))

    return t.unique_ordered(F.concat(terms, t.let(F.transform(terms, t.normalize_text), added)))


def german_variants(title: t.Expr, words: dict[str, str] = V.GERMAN_TITLE_WORDS) -> Column:
    """The title, then one variant per known word with that word replaced."""

    def variants(low: Column) -> Column:
        return F.array_compact(F.array(t.as_col(title), *[
            F.when(F.contains(low, F.lit(word)), F.replace(low, F.lit(word), F.lit(other)))
            for word, other in words.items()
        ]))

    return t.unique_ordered(t.let(F.lower(t.as_col(title)), variants))


def _query(parts: list[Column], title: Column, place: Column | None, why: str, lang: str = "en") -> Column:
    raw = F.concat_ws(" ", *parts)
    return t.let(raw, lambda text: F.struct(
        t.squeeze(text).alias("text"), title.alias("title"),
        (place if place is not None else F.lit(None)).cast("string").alias("location"),
        F.lit(lang).alias("language"), F.lit(why).alias("rationale"), t.tokenise(text).alias("terms"),
    ))


def drop_near_duplicates(queries: Column, threshold: float, limit: int) -> Column:
    """Greedy, in order: drop a query equal or near-equal to one already kept; stop at `limit`.

    The kept list never grows past `limit`, and later candidates cannot change an earlier
    decision, so stopping there gives the same first queries.
    """
    prepared = F.transform(queries, lambda q: F.struct(
        q.alias("q"), t.normalize_text(q["text"]).alias("key"), t.token_set(q["text"]).alias("tokens")))

    def step(kept: Column, item: Column) -> Column:
        seen = F.exists(kept, lambda k: (k["key"] == item["key"])
                        | (t.jaccard(k["tokens"], item["tokens"]) >= threshold))
        return F.when((F.size(kept) >= limit) | seen, kept).otherwise(F.concat(kept, F.array(item)))

    return F.transform(
        t.let(prepared, lambda items: F.aggregate(items, F.slice(items, 1, 0), step)), lambda k: k["q"])


def round_robin(lists: Column) -> Column:
    """The items of an array of lists, by their place in their list and then by list."""
    placed = F.flatten(F.transform(lists, lambda items, i: F.transform(items, lambda x, j: F.struct(j.alias("j"), i.alias("i"), x.alias("x")))))
    return F.transform(F.array_sort(placed), lambda p: p["x"])


def generate_queries(profiles: DataFrame, settings: Settings = Settings(), broader: list[str] = V.BROADER_QUERIES) -> DataFrame:
    """One row per (profile, query) in priority order, at most `query_limit` per profile.

    By default one title's queries come before the next title's, so that a low limit covers few titles; with
    `query_order` "round_robin" the lists of the titles, the wider, the broader and the German queries take turns.
    Every list is cut at its length in the settings before it is combined, so a profile yields a few hundred candidates
    inside its own row: nothing is joined and nothing is shuffled.
    """
    strings = lambda values: t.string_array(list(values))
    held = F.coalesce(F.col("role_families"), F.array()).cast("array<string>")
    base = t.unique_ordered(F.concat(strings(settings.target_titles), strings(settings.job_titles), held))
    titles = F.slice(expand_titles(base, held), 1, settings.max_titles)
    domains = F.slice(expand_domains(F.concat(
        F.coalesce(F.col("domain_strengths"), F.array()).cast("array<string>"),
        strings(settings.include_keywords))), 1, settings.max_domains)
    skills = F.slice(t.unique_ordered(F.concat(
        F.transform(F.coalesce(F.col("skills"), F.array()), lambda s: s["name"]),
        F.coalesce(F.col("tools"), F.array()), F.coalesce(F.col("programming_languages"), F.array()))), 1, settings.max_skills)
    places = F.slice(t.unique_ordered(
        strings(settings.preferred_locations + settings.search_locations)), 1, settings.max_places)

    def combine(c: Column) -> Column:
        def with_each(values: Column, why: str, is_place: bool = False):
            return lambda title: F.transform(values, lambda v: _query(
                [title, v], title, v if is_place else None, why))

        per_title = F.transform(c["titles"], lambda title: F.concat(
            F.array(_query([title], title, None, "exact title")),
            with_each(c["domains"], "title + domain")(title),
            with_each(c["skills"], "title + skill")(title),
            with_each(c["places"], "title + location", True)(title),
        ))
        wide = F.flatten(F.flatten(F.transform(F.slice(c["titles"], 1, settings.wide_titles), lambda title: F.transform(
            F.slice(c["domains"], 1, settings.wide_domains), lambda domain: F.transform(
                F.slice(c["places"], 1, settings.wide_places), lambda place: _query(
                    [title, domain, place], title, place, "title + domain + location"))))))
        parts = [wide]
        if broader:
            parts.append(F.transform(strings(broader), lambda text: _query(
                [text], F.lit(None).cast("string"), None, "broader concept combination")))
        if settings.german_variants:
            parts.append(F.flatten(F.transform(F.slice(c["titles"], 1, settings.wide_titles), lambda title: F.transform(
                F.filter(german_variants(title), lambda v: v != title),
                lambda v: _query([v], title, None, "german title variant", "de")))))
        lists = F.concat(per_title, F.array(*parts))
        ordered = round_robin(lists) if settings.query_order == "round_robin" else F.flatten(lists)
        return drop_near_duplicates(ordered, settings.near_duplicate_threshold, settings.query_limit)

    lists = F.struct(
        titles.alias("titles"), domains.alias("domains"), skills.alias("skills"), places.alias("places"))
    return (
        profiles.select("profile_id", t.let(lists, combine).alias("queries"))
        .select("profile_id", F.posexplode("queries").alias("query_ord", "q"))
        .select("profile_id", "query_ord", "q.*")
    )


def discovery_keywords(
    lists: Column, settings: Settings = Settings(), limit: int = 14
) -> Column:
    """Distinct profile keywords of at least three characters."""
    return F.slice(F.filter(t.unique_ordered(lists), lambda k: F.length(k) >= 3), 1, limit)


def discovery_regions(settings: Settings) -> list[str]:
    seen: dict[str, str] = {}
    for value in settings.target_countries + settings.search_locations + settings.preferred_locations:
        seen.setdefault(" ".join(value.lower().split()), value.strip())
    return [v for k, v in seen.items() if k] or V.DEFAULT_REGIONS


def discovery_queries(
    keywords: Column, regions: Column, limit: int, templates: list[str] = V.DISCOVERY_TEMPLATES,
    fixed: list[str] = V.DISCOVERY_QUERIES,
) -> Column:
    """keyword x region x template, then the fixed queries; distinct, limited."""

    def fill(keyword: Column, region: Column) -> Column:
        def one(template: str) -> Column:
            return F.replace(F.replace(F.lit(template), F.lit("{keyword}"), keyword), F.lit("{region}"), region)
        return F.array(*[one(x) for x in templates])

    made = F.flatten(F.flatten(F.transform(
        keywords, lambda k: F.transform(regions, lambda r: fill(k, r)))))
    return F.slice(t.unique_ordered(F.concat(made, t.string_array(fixed))), 1, limit)
