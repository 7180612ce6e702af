"""Requirements against evidence: retrieval, support classes, claims and the match report."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from rolescope import fixed_values as V
from rolescope.functions import coerce, text as t
from rolescope.operators import normalize
from rolescope.operators.evidence_index import retrieve_by_tokens
from rolescope.operators.scoring import unit_vector, vector_similarity
from rolescope.operators.vector_blocks import retrieve_by_vectors
from rolescope.plans.spread import first_per_key
from rolescope.session import land
from rolescope.settings import Settings

MAX_REQUIREMENTS = 15
CHUNK = 520
EVIDENCE_BLOCK = 256
BUSY = 8192  # requirements of a profile that one task takes
PIECES = r"(?U)(?<=[.!?;])\s+|\n+"


def _strings(name: str) -> Column:
    return F.coalesce(F.col(name), F.array()).cast("array<string>")


def description_requirements(description: Column) -> Column:
    """Bullets or sentences of a description that carry a requirement word."""
    fallback = F.filter(F.transform(F.split(description, r"(?U)(?<=[.;])\s+|\n+", -1), t.strip), lambda x: x != "")
    lines = t.let(t.bullets_or_sentences(description), lambda b: F.when(F.size(b) > 0, b).otherwise(fallback))
    cleaned = F.transform(lines, lambda x: normalize.clean_requirement(x))
    return F.filter(cleaned, lambda x: (F.length(x) >= 4) & t.contains_any(t.normalize_text(x), V.REQUIREMENT_MARKERS))


def requirement_list(limit: int = MAX_REQUIREMENTS, model: Column | None = None) -> Column:
    """Requirements of a posting row: listed skills and texts first, model-made ones last."""
    description = t.text_or_empty("description")
    candidates = F.concat(
        _strings("required_skills"), _strings("minimum_qualifications"), _strings("preferred_skills"),
        _strings("responsibilities"), description_requirements(description),
        F.transform(_strings("domain_signals"), lambda s: F.concat(F.lit("Experience with "), s)),
        *([] if model is None else [model]),
    )
    cleaned = F.transform(candidates, lambda x: normalize.clean_requirement(x))
    kept = t.let(t.normalize_text(description), lambda norm: F.filter(cleaned, lambda r: (
        (r != "") & ~normalize.is_noise_requirement(r, description) & ~normalize.is_vague_requirement(r, norm))))
    return F.slice(t.unique_ordered(kept), 1, min(MAX_REQUIREMENTS, limit))


def extract_requirements(postings: DataFrame, key: list[str], settings: Settings = Settings()) -> DataFrame:
    """(key, ord, requirement); `model_requirements`, where present, holds a raw JSON answer."""
    model = None
    if "model_requirements" in postings.columns:
        model = coerce.as_list(F.try_parse_json("model_requirements"), "$.requirements")
    return postings.select(
        *key, F.posexplode(requirement_list(settings.max_requirements, model)).alias("ord", "requirement"))


def section_label(heading: Column) -> Column:
    def label(h: Column) -> Column:
        has = lambda *words: t.contains_any(h, list(words))
        return (
            F.when(has("experience", "employment", "work history"), "work_history")
            .when(has("project"), "projects").when(has("education", "degree"), "education")
            .when(has("skill", "tool", "technology"), "skills")
            .when(has("summary", "profile", "introduction"), "summary")
            .when(has("domain", "research"), "domains").when(has("role"), "roles")
            .when(h == "", "profile").otherwise(F.replace(h, F.lit(" "), F.lit("_")))
        )
    return t.let(t.normalize_text(heading), label)


def chunk_text(text: Column) -> Column:
    """Evidence pieces of a text: bullets or sentences, packed to at most 520 characters."""
    body = t.text_or_empty(text)
    loose = F.filter(F.transform(F.split(body, PIECES, -1), t.strip), lambda x: x != "")
    pieces = t.let(t.bullets_or_sentences(body), lambda b: F.when(F.size(b) > 0, b).otherwise(loose))
    compact = F.filter(
        F.transform(pieces, lambda p: F.btrim(F.regexp_replace(p, rf"{t.WS}+", " "), F.lit(" -*\t\r\n"))),
        lambda p: p != "")
    packed = F.flatten(F.transform(
        compact, lambda p: F.when(F.length(p) <= CHUNK, F.array(p)).otherwise(t.pack_words(p, CHUNK))))
    return F.when(t.squeeze(body) == "", F.slice(packed, 1, 0)).otherwise(packed)


def chunk_group(label: str, values: Column) -> Column:
    packed = t.pack_values(t.unique_ordered(values), ", ", CHUNK)
    return F.transform(packed, lambda p: F.concat(F.lit(f"{label}: "), p))


def build_evidence(profiles: DataFrame, raw_sections: str | None = None) -> DataFrame:
    """(profile_id, ord, text, source_section) in evidence order, first of equal texts kept.

    `raw_sections` names a column with the sections of the person's raw text.
    """
    c = F.col

    def tagged(chunks: Column, label: Column | str) -> Column:
        tag = F.lit(label) if isinstance(label, str) else label
        return F.transform(chunks, lambda x: F.struct(x.alias("text"), tag.alias("source_section")))

    def from_sections(name: str) -> Column:
        return F.flatten(F.transform(
            c(name), lambda s: tagged(chunk_text(s["content"]), section_label(s["heading"]))))

    def lines(head: Column, *rest: Column) -> Column:
        return t.strip(F.array_join(F.concat(F.array(head), *rest), "\n"))

    def bar(*parts: Column) -> Column:
        return F.array_join(F.filter(F.array(*parts), lambda x: x.isNotNull() & (x != "")), " | ")

    names = F.transform(F.coalesce(c("skills"), F.array()), lambda s: s["name"])
    extra_summary = F.when(
        F.coalesce(c("model_summary"), F.lit("")) != F.coalesce(c("summary"), F.lit("")), c("model_summary"))
    branches = [
        tagged(chunk_text(c("summary")), "summary"),
        tagged(chunk_text(extra_summary), "summary"),
        tagged(chunk_group("Skills", F.concat(
            names, _strings("tools"), _strings("programming_languages"), _strings("research_topics"))), "skills"),
        tagged(chunk_group("Domain strengths", _strings("domain_strengths")), "domains"),
        tagged(chunk_group("Role families", _strings("role_families")), "roles"),
        F.flatten(F.transform("work_experience", lambda e: tagged(chunk_text(lines(
            bar(e["title"], e["company"]), e["highlights"], e["technologies"], e["domains"])), "work_history"))),
        F.flatten(F.transform("projects", lambda p: tagged(chunk_text(lines(
            p["name"], F.array(p["description"]), p["highlights"], p["technologies"], p["domains"])), "projects"))),
        F.flatten(F.transform("education", lambda e: tagged(chunk_text(lines(
            bar(e["degree"], e["institution"], e["date_range"]), e["notes"])), "education"))),
        from_sections("sections"),
        *([from_sections(raw_sections)] if raw_sections else []),
    ]
    rows = profiles.select("profile_id", F.posexplode(F.concat(*branches)).alias("ord", "_e")).select(
        "profile_id", F.col("ord").cast("long").alias("ord"),
        t.squeeze("_e.text").alias("text"), F.col("_e.source_section").alias("source_section"))
    return first_evidence(rows)


def first_evidence(rows: DataFrame) -> DataFrame:
    """First row per normalized text within a profile; aggregated map-side."""
    return (
        rows.withColumn("_key", t.normalize_text("text")).where(F.col("_key") != "")
        .groupBy("profile_id", "_key").agg(F.min(F.struct("ord", "text", "source_section")).alias("_e"))
        .select("profile_id", "_e.ord", "_e.text", "_e.source_section")
    )


@dataclass(frozen=True)
class Similarity:
    """How a requirement meets an evidence item: one expression per side, and a score of the two."""

    asked: Column
    held: Column
    score: Callable[[Column, Column], Column]
    vectors: bool = False  # the score is that of `by_vector`, so blocks of both sides are multiplied


def lexical(text: str = "requirement") -> Similarity:
    """Jaccard of token sets."""
    return Similarity(t.token_set(text), t.token_set("text"), t.jaccard)


def by_vector(column: str = "vector") -> Similarity:
    """Cosine of a vector column on both sides, clamped to 0-1; a missing vector scores 1, as least() passes over a null."""
    unit = unit_vector(F.col(column))
    return Similarity(unit, unit, lambda a, b: F.coalesce(vector_similarity(a, b), F.lit(0.0)), vectors=True)


def retrieve_evidence(
    requirements: DataFrame, evidence: DataFrame, key: list[str], k: int = 3, text: str = "requirement",
    salts: int = 16, lanes: int = 8, similarity: Similarity | None = None, direct: int = 256,
) -> DataFrame:
    """Top-k evidence per requirement of the same profile, by token Jaccard or the given similarity, earlier first.

    Profiles of at most `direct` items are compared item by item inside a row, which bounds the work per
    requirement. Larger ones go through postings lists (`evidence_index`) and give the same rows. Another
    similarity than that of tokens has no such lists; its items are all compared, those of vectors in blocks. `key` must hold profile_id.
    """
    if similarity is not None and similarity.vectors:
        return retrieve_by_vectors(requirements, evidence, key, k, text, similarity.asked, similarity.held)
    if similarity is not None:
        return _compare_items(requirements, evidence, key, k, text, salts, lanes, similarity)
    evidence = land(evidence.select("profile_id", "ord", "text", "source_section"), "evidence")
    large = land(evidence.groupBy("profile_id").count().where(F.col("count") > direct).select("profile_id"), "large")
    if large.isEmpty():
        return _compare_profiles(requirements, evidence, key, k, text)
    part = lambda rows, how: rows.join(large, "profile_id", how)
    small = _compare_profiles(part(requirements, "left_anti"), part(evidence, "left_anti"), key, k, text)
    return small.unionByName(retrieve_by_tokens(part(requirements, "left_semi"), part(evidence, "left_semi"), key, k, text))


def _best_items(own: Column, items: Column, score: Callable[[Column, Column], Column], k: int) -> Column:
    scored = F.transform(items, lambda e: F.struct(
        (-score(own, e["_held"])).alias("neg"), e["ord"].alias("evidence_ord"),
        e["text"].alias("evidence"), e["source_section"].alias("source_section")))
    return F.slice(F.array_sort(scored), 1, k)


def _compare_profiles(requirements: DataFrame, evidence: DataFrame, key: list[str], k: int, text: str) -> DataFrame:
    """Every requirement against its profile's items, which are few enough for one row, by token Jaccard.

    Both sides move once, by profile; items get their tokens after that. A profile of more than BUSY requirements is
    cut into lanes: its row is repeated per lane and a requirement takes one.
    """
    asked = land(requirements.where(t.strip(text) != "").select(*dict.fromkeys([*key, text])), "asked")
    busy = land(asked.groupBy("profile_id").count().where(F.col("count") > BUSY).select(
        "profile_id", F.ceil(F.col("count") / BUSY).cast("int").alias("_lanes")), "busy")
    # an item without a number has no place among the others and is left out
    held = evidence.where(F.col("ord").isNotNull()).groupBy("profile_id").agg(F.collect_list(F.struct("ord", "text", "source_section")).alias("_items"))
    held = held.withColumn("_items", F.transform("_items", lambda e: e.withField("_held", t.token_set(e["text"]))))
    by, within = ["profile_id"], key
    if not busy.isEmpty():
        lanes = F.coalesce("_lanes", F.lit(1))
        asked = asked.join(busy, "profile_id", "left").withColumn("_lane", F.pmod(F.xxhash64(*key), lanes)).drop("_lanes")
        held = held.join(busy, "profile_id", "left").withColumn(
            "_lane", F.explode(F.sequence(F.lit(0).cast("long"), lanes.cast("long") - 1))).drop("_lanes")
        by, within = [*by, "_lane"], [*key, "_lane"]
    found = asked.join(held, by).select(*dict.fromkeys([*within, text]), F.explode(t.let(
        t.token_set(text), lambda own: _best_items(own, F.col("_items"), t.jaccard, k))).alias("_e"))
    found = found.select(*dict.fromkeys([*within, text]), "_e.*")
    # rows of a repeated key share k places; they lie together already
    top = first_per_key(found, within, ["neg", "evidence_ord"], k)
    return top.select(*key, text, "evidence_ord", "evidence", "source_section", F.abs("neg").alias("similarity"))


def _compare_items(
    requirements: DataFrame, evidence: DataFrame, key: list[str], k: int, text: str,
    salts: int, lanes: int, measure: Similarity,
) -> DataFrame:
    """Every requirement against every item of its profile.

    Evidence is packed into blocks of at most 256 consecutive items, so one row holds a bounded
    array however much a profile owns. A requirement meets its profile's blocks (spread over
    salts), keeps k per block inside the row, and only those few meet in the last step; rows
    without any common token take part with similarity 0. Blocks are repeated per lane and a
    requirement takes one lane, so that a profile with few blocks and very many requirements is
    spread too.
    """
    blocks = (
        evidence.withColumn("_block", F.floor(F.col("ord") / EVIDENCE_BLOCK).cast("long"))
        .groupBy("profile_id", "_block")
        .agg(F.collect_list(F.struct("ord", "text", "source_section", measure.held.alias("_held"))).alias("_items"))
        .withColumn("_salt", F.pmod(F.col("_block"), F.lit(salts)))
    )
    # one narrow row per profile, read from the blocks and repeated per lane as they are
    spans = blocks.groupBy("profile_id").agg(F.least(F.lit(salts), F.max("_block") + 1).alias("_spread"))
    lane = F.explode(F.sequence(F.lit(0), F.lit(lanes - 1)))
    asked = (
        requirements.where(t.strip(text) != "").withColumn("_asked", measure.asked)
        .withColumn("_lane", F.pmod(F.xxhash64(*key), F.lit(lanes)).cast("int"))
        .join(spans.withColumn("_lane", lane), ["profile_id", "_lane"])
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_spread") - 1)))
    )

    found = (
        asked.join(blocks.withColumn("_lane", lane), ["profile_id", "_salt", "_lane"])
        .select(*key, text, F.explode(t.let(
            F.col("_asked"), lambda own: _best_items(own, F.col("_items"), measure.score, k))).alias("_e"))
        .select(*key, text, "_e.*")
    )
    top = first_per_key(found, key, ["neg", "evidence_ord"], k)
    return top.select(*key, text, "evidence_ord", "evidence", "source_section", F.abs("neg").alias("similarity"))


def with_evidence(requirements: DataFrame, retrieved: DataFrame, key: list[str]) -> DataFrame:
    """Requirement rows with their evidence as an array, best first; [] where none exists."""
    lists = retrieved.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(
        (-F.col("similarity")).alias("neg"), F.col("evidence_ord").alias("ord"), F.col("evidence").alias("text"),
        "source_section"))).alias("_l"))
    items = F.transform(F.coalesce("_l", F.array()), lambda e: F.struct(
        e["text"].alias("text"), e["source_section"].alias("source_section"),
        F.abs(e["neg"]).alias("similarity")))
    return requirements.join(lists, key, "left").withColumn("evidence", items).drop("_l")


def _best(evidence: Column) -> Column:
    return F.get(evidence, F.lit(0))["similarity"]


def _content_tokens(tokens: Column, ignored: list[str]) -> Column:
    return F.filter(tokens, lambda x: (F.length(x) > 2) & ~x.isin(ignored))


def _evidence_tokens(evidence: Column) -> Column:
    return F.array_distinct(F.flatten(F.transform(evidence, lambda e: t.tokenise(e["text"]))))


def overlap_terms(requirement: Column, evidence: Column, most: int = 8) -> Column:
    own = _content_tokens(t.token_set(requirement), V.OVERLAP_IGNORED)
    return F.slice(F.array_sort(F.array_intersect(own, _evidence_tokens(evidence))), 1, most)


def support_status(best: Column, s: Settings = Settings()) -> Column:
    return (
        F.when(best >= s.strong_threshold, "strong_match").when(best >= s.partial_threshold, "partial_match")
        .when(best >= s.uncertain_threshold, "uncertain").otherwise("missing")
    )


def _between(x: Column, low: float, high: float) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), x))


def assess_requirements(rows: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Status, confidence, explanation and shared terms for rows with an `evidence` array.

    A `payload` column, where present, holds the model's raw JSON answer; an answer without a
    known status is ignored.
    """
    evidence, best = F.col("evidence"), _best(F.col("evidence"))
    status = support_status(F.coalesce(best, F.lit(0.0)), settings)
    shown = F.format_number(best, 2)
    why = lambda head, mid: F.concat(F.lit(f"{head} ({mid}similarity "), shown, F.lit(")."))
    explanation = (
        F.when(best.isNull(), "No candidate evidence was available for this requirement.")
        .when(status == "strong_match", why("The strongest evidence directly overlaps with this requirement", ""))
        .when(status == "partial_match", why(
            "The candidate has related evidence, but it does not fully establish the requirement", "best "))
        .when(status == "uncertain", why(
            "Evidence is weak or indirect, so this requirement should be reviewed manually", "best "))
        .otherwise(why("No supplied evidence clearly supports this requirement", "best "))
    )
    confidence = (
        F.when(best.isNull(), 0.65).when(status == "strong_match", _between(best, 0.72, 0.95))
        .when(status == "partial_match", _between(best, 0.55, 0.85))
        .when(status == "uncertain", _between(best, 0.35, 0.65)).otherwise(0.70)
    )
    related = F.when(status.isin("partial_match", "uncertain"), overlap_terms(F.col("requirement"), evidence)).otherwise(
        F.array().cast("array<string>"))
    out = rows.withColumns({
        "status": status, "explanation": explanation, "confidence": confidence, "transferable_skills": related})
    return out if "payload" not in rows.columns else _prefer_model(out)


def _prefer_model(rows: DataFrame) -> DataFrame:
    v = F.try_parse_json("payload")
    said = coerce.as_status(v, "$.status")
    picked = coerce.pick_evidence(F.col("evidence"), v, "$.selected_evidence_indices")
    fallback_one = said.isin("missing", "uncertain") & (F.size(picked) == 0)
    chosen = F.when(fallback_one, F.slice("evidence", 1, 1)).otherwise(picked)
    with_pick = rows.withColumns({"_said": said, "_chosen": chosen})
    text = F.when(F.size("_chosen") > 0, F.concat(
        F.lit("Assessment for '"), F.col("requirement"), F.lit("' is "), F.col("_said"),
        F.lit(" based on supplied evidence only."))).otherwise(F.concat(
            F.lit("Assessment for '"), F.col("requirement"), F.lit("' is "), F.col("_said"),
            F.lit("; no supporting evidence was selected.")))
    model = F.col("_said").isNotNull()
    pick = lambda name, value: F.when(model, value).otherwise(F.col(name))
    return with_pick.withColumns({
        "explanation": pick("explanation", t.first_filled(coerce.as_text(v, "$.explanation"), text)),
        "transferable_skills": pick("transferable_skills", t.unique_ordered(coerce.as_list(v, "$.transferable_skills"))),
        "confidence": pick("confidence", coerce.as_confidence(
            v, "$.confidence", F.coalesce(_best(F.col("_chosen")), F.lit(0.5)))),
        "status": pick("status", F.col("_said")),
        "evidence": pick("evidence", F.col("_chosen")),
    }).drop("_said", "_chosen", "payload")


def safer_wording(claim: Column, evidence: Column) -> Column:
    terms = F.array_sort(_content_tokens(t.token_set(claim), V.CLAIM_IGNORED))
    focus = F.when(F.size(terms) == 0, "this area").otherwise(F.array_join(F.slice(terms, 1, 6), ", "))
    strongest = F.regexp_replace(F.get(evidence, F.lit(0))["text"], r"\.+\z", "")
    return F.when(F.size(evidence) > 0, F.concat(
        F.lit("My background includes "), strongest,
        F.lit(", which provides a foundation for work related to "), focus, F.lit(".")
    )).otherwise(F.concat(
        F.lit("I am interested in applying my documented background to work related to "), focus, F.lit(".")))


def check_claims(rows: DataFrame) -> DataFrame:
    """Support of claims: rows with `claim` and the top-3 `evidence` array."""
    claim, evidence = F.col("claim"), F.col("evidence")
    best = F.coalesce(_best(evidence), F.lit(0.0))
    rows = rows.withColumns({
        "_terms": _content_tokens(t.token_set(claim), V.CLAIM_IGNORED), "_seen": _evidence_tokens(evidence)})
    covered = F.size(F.array_intersect("_terms", "_seen"))
    coverage = F.when(F.size("_terms") > 0, covered / F.size("_terms")).otherwise(0.0)
    rows = rows.withColumns({
        "coverage": coverage, "best_similarity": best,
        "missing_terms": F.slice(F.array_sort(F.array_except("_terms", "_seen")), 1, 6)})
    none = F.size("evidence") == 0
    supported = ~none & (F.col("best_similarity") >= 0.70) & (F.col("coverage") >= 0.60)
    partial = (F.col("best_similarity") >= 0.45) | (F.col("coverage") > 0)
    shown = F.format_number(F.col("best_similarity"), 2)
    missing = F.when(F.size("missing_terms") > 0, F.array_join("missing_terms", ", ")).otherwise("some specific details")
    rows = rows.withColumns({
        "supported": supported,
        "explanation": F.when(none, "No candidate evidence was available to support this claim.")
        .when(supported, F.concat(
            F.lit("The claim is supported by direct evidence (best similarity "), shown,
            F.lit(", key-term coverage "), F.format_number(F.col("coverage"), 2), F.lit(").")))
        .when(partial, F.concat(
            F.lit("Related evidence exists, but the claim is not fully supported. Missing direct evidence for: "),
            missing, F.lit(".")))
        .otherwise(F.concat(
            F.lit("No supplied evidence clearly supports the claim (best similarity "), shown, F.lit(")."))),
        "confidence": F.when(none, 0.70).when(supported, _between(F.col("best_similarity"), 0.72, 0.92))
        .when(partial, _between(F.col("best_similarity"), 0.50, 0.82)).otherwise(0.72),
        "safer_wording": F.when(~supported, safer_wording(claim, evidence)),
    }).drop("_terms", "_seen")
    return rows if "payload" not in rows.columns else _prefer_model_claim(rows)


def _prefer_model_claim(rows: DataFrame) -> DataFrame:
    v = F.try_parse_json("payload")
    answered = F.try_variant_get(v, "$", "map<string,variant>").isNotNull()
    picked = coerce.pick_evidence(F.col("evidence"), v, "$.selected_evidence_indices")
    raw = F.try_variant_get(v, "$.supported", "string")
    truth = F.coalesce(F.try_variant_get(v, "$.supported", "boolean"), raw.isNotNull() & (raw != "") & (raw != "0"))
    rows = rows.withColumns({"_picked": picked, "_true": F.coalesce(truth, F.lit(False))})
    text = (
        F.when(F.col("_true"), F.concat(F.lit("The claim '"), "claim", F.lit("' is supported by the selected evidence.")))
        .when(F.size("_picked") > 0, F.concat(
            F.lit("The selected evidence does not fully support the claim '"), "claim", F.lit("'.")))
        .otherwise(F.concat(F.lit("No evidence was selected for the claim '"), "claim", F.lit("'.")))
    )
    pick = lambda name, value: F.when(answered, value).otherwise(F.col(name))
    wording = t.first_filled(coerce.as_text(v, "$.safer_wording"), safer_wording(F.col("claim"), F.col("_picked")))
    return rows.withColumns({
        "explanation": pick("explanation", t.first_filled(coerce.as_text(v, "$.explanation"), text)),
        "confidence": pick("confidence", coerce.as_confidence(
            v, "$.confidence", F.coalesce(_best(F.col("_picked")), F.lit(0.5)))),
        "safer_wording": pick("safer_wording", F.when(~F.col("_true"), wording)),
        "supported": pick("supported", F.col("_true")),
        "evidence": pick("evidence", F.col("_picked")),
    }).drop("_picked", "_true", "payload")


def status_score(status: Column) -> Column:
    out = F.lit(0.0)
    for name, value in V.STATUS_SCORES.items():
        out = F.when(status == name, value).otherwise(out)
    return out


def recommendation(score: Column) -> Column:
    return (
        F.when(score >= 75.0, "Strong candidate based on supplied evidence; still review requirement details before applying.")
        .when(score >= 55.0, "Plausible candidate with gaps; tailor application materials to the strongest evidence.")
        .otherwise("Weak match based on supplied evidence; consider applying only with a clear strategy for the gaps.")
    )


def match_report(
    pairs: DataFrame, assessments: DataFrame, key: list[str], claims: DataFrame | None = None
) -> DataFrame:
    """One row per (profile, posting): score, strengths, gaps, unsupported claims, recommendation.

    `pairs` holds the key and `missing_skills`; a posting has at most 15 assessments and a claim
    list is one person's, so the collected lists are bounded.
    """
    order = F.struct("ord", "requirement", "status", "confidence", "explanation", "transferable_skills", "evidence")
    grouped = assessments.groupBy(*key).agg(
        t.round_to(F.avg(status_score(F.col("status"))) * 100.0, 2).alias("_score"),
        F.array_sort(F.collect_list(order)).alias("assessments"))
    rows = pairs.join(grouped, key, "left")
    if claims is not None:
        lists = claims.where(~F.col("supported")).groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(
            "ord", "claim", "explanation", "safer_wording", "confidence", "evidence"))).alias("unsupported_claims"))
        rows = rows.join(lists, key, "left")
    done = F.coalesce("assessments", F.array())
    say = lambda status, words: (lambda a: F.when(a["status"] == status, F.concat(F.lit(words), a["requirement"])))
    strong, related = say("strong_match", "Strong evidence for: "), say(
        "partial_match", "Related or transferable evidence for: ")
    lost, unsure = say("missing", "No clear evidence for: "), say("uncertain", "Needs manual review: ")
    strengths = F.array_compact(F.transform(done, lambda a: F.coalesce(strong(a), related(a))))
    gaps = F.concat(
        F.array_compact(F.transform(done, lambda a: F.coalesce(lost(a), unsure(a)))),
        F.transform(F.coalesce("missing_skills", F.array().cast("array<string>")),
                    lambda s: F.concat(F.lit("Rules-based skill gap: "), s)))
    return rows.withColumns({
        "overall_score": F.coalesce("_score", F.lit(0.0)),
        "strengths": F.slice(strengths, 1, 8),
        "gaps": F.slice(t.unique_ordered(gaps), 1, 10),
    }).withColumn("recommendation", recommendation(F.col("overall_score"))).drop("_score")
