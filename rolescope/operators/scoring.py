"""Interpretable sub-scores of a (profile, posting) row and their weighted sum."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rolescope import fixed_values as V
from rolescope.functions import text as t
from rolescope.plans.spread import salted_join
from rolescope.settings import Settings

WEIGHTS = {
    "title_match_score": 0.24, "skills_overlap_score": 0.26, "domain_match_score": 0.20,
    "seniority_fit_score": 0.10, "location_fit_score": 0.10, "constraints_fit_score": 0.10,
}


def _strings(name: str) -> Column:
    return F.coalesce(F.col(name), F.array()).cast("array<string>")


def _lower_unique(values: list[str]) -> list[str]:
    return list(dict.fromkeys(v.lower() for v in values))


def prepare_profiles(
    profiles: DataFrame, settings: Settings = Settings(),
    families: dict[str, list[str]] = V.ROLE_FAMILIES, seniority: dict[str, int] = V.SENIORITY_VALUES,
) -> DataFrame:
    """The profile side of every sub-score, computed once per profile instead of once per pair."""
    wanted = t.string_array(settings.target_titles + settings.job_titles)
    held = F.transform(_strings("role_families"), F.lower)
    variants = F.flatten(F.array(*[
        F.when(F.array_contains(held, family.replace("_", " ")), t.string_array(names))
        .otherwise(F.array().cast("array<string>"))
        for family, names in families.items()
    ])) if families else F.array().cast("array<string>")
    titles = t.unique_ordered(F.concat(wanted, _strings("role_families"), variants))
    names = F.transform(F.coalesce(F.col("skills"), F.array()), lambda s: s["name"])
    target = F.lower(t.first_filled("seniority_hint", F.lit(settings.experience_level or "mid"), F.lit("mid")))
    value = F.lit(60)
    for hint, number in seniority.items():
        value = F.when(target == hint, F.lit(number)).otherwise(value)
    keys = lambda values: F.array_distinct(F.filter(F.transform(values, t.normalize_text), lambda k: k != ""))
    return profiles.select(
        "profile_id",
        F.struct(
            F.transform(titles, t.normalize_text).alias("titles"),
            keys(F.concat(names, _strings("tools"), _strings("programming_languages"),
                          _strings("domain_strengths"))).alias("skills"),
            keys(F.concat(_strings("domain_strengths"), _strings("industries"),
                          t.string_array(settings.include_keywords), _strings("role_families"))).alias("domains"),
            value.alias("seniority"),
            F.exists(names, lambda n: F.lower(n) == "german").alias("speaks_german"),
            F.slice(_strings("domain_strengths"), 1, 3).alias("top_domains"),
        ).alias("_p"),
    )


def title_score(title: Column, expected: Column) -> Column:
    return t.let(t.normalize_text(t.text_or_empty(title)), lambda own: F.when(
        F.array_contains(expected, own), 100.0
    ).when(
        F.exists(expected, lambda e: F.contains(own, e) | F.contains(e, own)), 88.0
    ).otherwise(0.0))


def skills_score(required: Column, preferred: Column, held: Column) -> Column:
    def score(keys: Column) -> Column:
        found = F.size(F.filter(keys, lambda k: F.array_contains(held, k)))
        return F.when(F.size(keys) == 0, 45.0).otherwise(t.round_to(100.0 * found / F.size(keys), 2))

    listed = t.unique_ordered(F.concat(required, preferred))
    return t.let(F.transform(listed, t.normalize_text), score)


def missing_skills(required: Column, preferred: Column, held: Column) -> Column:
    """Required skills not held, first ten; empty when the posting lists no skill at all."""
    missing = F.filter(required, lambda s: ~F.array_contains(held, t.normalize_text(s)))
    return F.slice(missing, 1, 10)


def domain_score(signals: Column, title: Column, terms: Column) -> Column:
    """Share of the posting's signals, its title counted as one more, among the profile's terms."""
    own = t.unique_ordered(F.concat(signals, F.array(t.text_or_empty(title))))
    return t.let(F.transform(own, t.normalize_text), lambda keys: F.when(F.size(keys) == 0, 40.0).otherwise(
        t.round_to(100.0 * F.size(F.filter(keys, lambda k: F.array_contains(terms, k))) / F.size(keys), 2)))


def seniority_score(title: Column, target: Column, seniority: dict[str, int] = V.SENIORITY_VALUES,
                    most_specific: bool = False) -> Column:
    """100 minus 1.5 per point of distance; the first listed hint in the title counts."""
    hints = sorted(seniority, key=len, reverse=True) if most_specific else list(seniority)

    def value(low: Column) -> Column:
        own = F.lit(60)
        for hint in reversed(hints):
            own = F.when(F.contains(low, F.lit(hint)), F.lit(seniority[hint])).otherwise(own)
        return own

    own = t.let(F.lower(t.text_or_empty(title)), value)
    return F.greatest(F.lit(0.0), 100.0 - F.abs(target - own) * 1.5)


def location_score(mode: Column, location: Column, s: Settings) -> Column:
    preference = s.remote_preference.lower()
    places = _lower_unique(s.preferred_locations + s.search_locations)
    place = F.lower(t.text_or_empty(location))
    return (
        F.when((mode == "remote") & F.lit(preference in ("remote", "hybrid")), 100.0)
        .when((mode == "hybrid") & F.lit(preference == "hybrid"), 92.0)
        .when(t.contains_any(place, places), 90.0)
        .when(place == "", 55.0)
        .otherwise(35.0)
    )


def _joined(*normalized: Column) -> Column:
    """Normalized texts as if they had been joined by a space before normalizing."""
    return F.concat_ws(" ", *[F.nullif(x, F.lit("")) for x in normalized])


def visa_limits(description: Column) -> Column:
    """`description` is already normalized, as in the next two scores."""
    return t.contains_any(description, ["no sponsorship", "must be authorized"])


def constraints_score(visa: Column, languages: Column, speaks_german: Column, s: Settings) -> Column:
    visa_cost = F.when(visa, 30.0).otherwise(0.0) if s.visa_constraints else F.lit(0.0)
    german = F.exists(languages, lambda l: F.lower(l) == "german") & ~speaks_german
    return F.greatest(F.lit(0.0), 75.0 - visa_cost - F.when(german, 15.0).otherwise(0.0))


def sector_bonus(signals: Column, description: Column, title: Column, s: Settings) -> Column:
    sectors = [x.lower() for x in s.criteria_industries + s.search_industries]
    text = _joined(
        t.normalize_text(F.array_join(signals, " ")), description, t.normalize_text(t.text_or_empty(title)))
    return t.let(text, lambda hay: F.when(t.contains_any(hay, sectors), 10.0).otherwise(0.0))


def mismatch_penalty(title: Column, description: Column, company: Column, s: Settings,
                     unrelated: list[str] = V.UNRELATED_TITLE_WORDS, whole_word: bool = False) -> Column:
    def norm(values: list[str]) -> list[str]:
        return [" ".join(v.lower().split()) for v in values]

    body = _joined(t.normalize_text(t.text_or_empty(title)), description)

    def cost(hay: Column) -> Column:
        has = (lambda words: F.size(t.phrase_matches(hay, words, True)) > 0) if whole_word else (
            lambda words: t.contains_any(hay, words))
        return (
            F.when(t.normalize_text(t.text_or_empty(company)).isin(norm(s.blacklist_companies)), 50.0).otherwise(0.0)
            + F.when(has(norm(s.exclude_keywords)), 25.0).otherwise(0.0)
            + F.when(has(unrelated), 35.0).otherwise(0.0)
        )

    return t.let(body, cost)


def rules_disposition(score: Column) -> Column:
    return F.when(score >= 78, "apply").when(score >= 55, "maybe").otherwise("skip")


def fit_label(score: Column) -> Column:
    return F.when(score >= 78, "realistic").when(score >= 55, "stretch").otherwise("poor_fit")


def label_score(label: Column) -> Column:
    out = F.lit(V.FIT_LABEL_SCORES["unknown"])
    for name, value in V.FIT_LABEL_SCORES.items():
        out = F.when(label == name, value).otherwise(out)
    return out


def text_flags(
    postings: DataFrame, settings: Settings = Settings(), unrelated: list[str] = V.UNRELATED_TITLE_WORDS,
    whole_word: bool = False,
) -> DataFrame:
    """Everything the scores read from a posting's text; none of it depends on a profile.

    Computed once per posting before any join or deduplication, so that texts need not be shuffled.
    """
    body, title = F.col("_body"), F.col("title")
    return postings.withColumn("_body", t.normalize_text(t.text_or_empty("description"))).withColumns({
        "_visa": visa_limits(body),
        "preferred_sector_bonus": sector_bonus(_strings("domain_signals"), body, title, settings),
        "mismatch_penalty": mismatch_penalty(title, body, F.col("company"), settings, unrelated, whole_word),
    }).drop("_body")


def score_rules(
    pairs: DataFrame, prepared: DataFrame, settings: Settings = Settings(),
    unrelated: list[str] = V.UNRELATED_TITLE_WORDS, seniority: dict[str, int] = V.SENIORITY_VALUES,
    most_specific: bool = False, whole_word: bool = False,
) -> DataFrame:
    """Add every sub-score and text to (profile_id, posting columns) rows.

    `pairs` is what the query match kept, so the join is an equi-join on profile_id and only
    related pairs exist. The profile side is one narrow row per profile, repeated per salt so that a
    profile with a large share of the pairs is spread over several tasks. Rows that come from
    `text_flags` need no description; without a later use of it the description stays out of the join.
    `most_specific` takes the longest seniority hint of a title, `whole_word` matches unwanted words as words.
    """
    flagged = pairs if "_visa" in pairs.columns else text_flags(pairs, settings, unrelated, whole_word)
    rows = salted_join(flagged, prepared, ["profile_id"], ["id"])
    c, s = F.col, settings
    required, preferred, signals = _strings("required_skills"), _strings("preferred_skills"), _strings("domain_signals")
    lists = F.size(t.unique_ordered(F.concat(required, preferred)))
    rows = rows.withColumns({
        "title_match_score": title_score(c("title"), c("_p.titles")),
        "skills_overlap_score": skills_score(required, preferred, c("_p.skills")),
        "domain_match_score": domain_score(signals, c("title"), c("_p.domains")),
        "seniority_fit_score": seniority_score(c("title"), c("_p.seniority"), seniority, most_specific),
        "location_fit_score": location_score(c("work_mode"), c("location"), s),
        "constraints_fit_score": constraints_score(
            c("_visa"), _strings("language_requirements"), c("_p.speaks_german"), s),
        "missing_skills": F.when(lists == 0, F.array().cast("array<string>"))
        .otherwise(missing_skills(required, preferred, c("_p.skills"))),
    })
    weighted = sum((c(name) * weight for name, weight in WEIGHTS.items()), F.lit(0.0))
    total = t.round_to(weighted + c("preferred_sector_bonus") - c("mismatch_penalty"), 2)
    parts = F.array_compact(F.array(
        F.when(c("title_match_score") >= 80, "strong adjacent-title match"),
        F.when(c("skills_overlap_score") >= 50, "meaningful skill overlap"),
        F.when(c("domain_match_score") >= 50, "clear domain alignment"),
        F.when(c("location_fit_score") >= 80, "location or work-mode fit"),
    ))
    strong = t.unique_ordered(F.concat(F.slice(required, 1, 3), F.slice(signals, 1, 2)))
    emphasis = t.let(strong, lambda v: F.when(F.size(v) > 0, v).otherwise(c("_p.top_domains")))
    rows = rows.withColumn("rules_based_score", F.greatest(F.lit(0.0), F.least(F.lit(100.0), total)))
    return rows.withColumns({
        "why_match": t.let(parts, lambda p: F.when(F.size(p) > 0, F.array_join(p, ", ")).otherwise(
            F.concat(F.lit("some overlap with "), t.text_or_empty("title")))),
        "recommended_resume_emphasis": F.concat(
            F.lit("Emphasize evidence for "), F.array_join(emphasis, ", "), F.lit(".")),
        "recommended_cover_letter_angle": F.concat(
            F.lit("Connect prior delivery experience to "), F.coalesce(F.get(signals, F.lit(0)), c("title")),
            F.lit(" impact at "), t.text_or_empty("company"), F.lit(".")),
        "disposition": rules_disposition(c("rules_based_score")),
    }).drop("_p", "_visa")


def profile_text() -> Column:
    """Text of a profile for similarity: summary, skills, domains, role families."""
    summary = F.coalesce(t.first_filled("summary", "model_summary"), F.lit(""))
    names = F.transform(F.coalesce(F.col("skills"), F.array()), lambda s: s["name"])
    return F.array_join(t.unique_ordered(F.concat(
        F.array(summary), names, _strings("domain_strengths"), _strings("role_families"))), " ")


def posting_text() -> Column:
    return F.array_join(t.unique_ordered(F.concat(
        F.array(t.text_or_empty("title"), t.text_or_empty("description"), t.text_or_empty("company")),
        _strings("required_skills"), _strings("preferred_skills"), _strings("domain_signals"))), " ")


def vector_similarity(left: Column, right: Column) -> Column:
    """Dot product of unit vectors, clamped to 0-1."""
    dot = F.aggregate(F.zip_with(left, right, lambda a, b: a.cast("double") * b.cast("double")),
                      F.lit(0.0), lambda acc, x: acc + x)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot))


def unit_vector(v: Column) -> Column:
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))
    return t.let(norm, lambda n: F.transform(v, lambda x: F.when(n == 0, F.lit(0.0)).otherwise(x.cast("double") / n)))
