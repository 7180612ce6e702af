"""Two-pass ranking: cheap scores for all rows, model labels for a shortlist, one final order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from rolescope import schemas as S
from rolescope.functions import coerce, text as t
from rolescope.operators.scoring import fit_label, label_score
from rolescope.plans.spread import first_per_key, rank_rows
from rolescope.session import cut_lineage
from rolescope.settings import Settings


def clamp100(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), x))


WIDE_COLUMNS = ("description", "raw_payload", "responsibilities", "minimum_qualifications")


def score_table(scored: DataFrame, wide: tuple[str, ...] = WIDE_COLUMNS) -> DataFrame:
    """Scores written once without the posting texts.

    Shortlist, labels, offsets and ranks all read the scored rows; without this every one of them
    would read and score the whole texts again. The posting's own columns join back by its key.
    """
    return cut_lineage(scored.drop(*wide))


def preliminary(scored: DataFrame) -> DataFrame:
    """0.80 rules + 0.20 similarity; similarity is 0 unless the rows carry one."""
    if "embedding_similarity_score" not in scored.columns:
        scored = scored.withColumn("embedding_similarity_score", F.lit(0.0))
    blend = t.round_to(F.col("rules_based_score") * 0.80 + F.col("embedding_similarity_score") * 0.20, 2)
    return scored.withColumn("preliminary_score", clamp100(blend))


def shortlist(prelim: DataFrame, settings: Settings = Settings(), ord_col: str = "ord") -> DataFrame:
    """(profile_id, id): the first n distinct posting ids above the rules floor, in preliminary order."""
    if not settings.label_enabled or settings.label_top_n <= 0:
        return prelim.select("profile_id", "id").limit(0)
    order = F.struct((-F.col("preliminary_score")).alias("s"), F.col(ord_col).alias("o"))
    eligible = prelim.where(F.col("rules_based_score") >= settings.label_min_rules_score)
    by_id = eligible.groupBy("profile_id", "id").agg(F.min(order).alias("_at"))
    return first_per_key(by_id, ["profile_id"], ["_at"], settings.label_top_n).drop("_at")


def heuristic_assessment() -> Column:
    """Label and texts used where no model response exists."""
    label = fit_label(F.col("rules_based_score"))
    title, company = t.text_or_empty("title"), t.text_or_empty("company")
    signals = F.coalesce(F.col("domain_signals"), F.array()).cast("array<string>")
    focus = F.when(F.size(signals) > 0, F.array_join(F.slice(signals, 1, 2), ", ")).otherwise(title)
    return F.struct(
        label.alias("fit_label"),
        F.concat(F.lit("Rules-based scoring indicates a "), label, F.lit(" match for "), title, F.lit("."))
        .alias("why_match"),
        F.col("missing_skills").alias("missing_requirements"),
        F.concat(F.lit("Stress direct work on "), focus, F.lit(".")).alias("recommended_resume_emphasis"),
        F.concat(F.lit("Tie shipped results to "), company, F.lit("'s role scope."))
        .alias("recommended_cover_letter_angle"),
    )


def response_assessment(payload: Column) -> Column:
    """Assessment from a raw JSON response; every missing field has its default."""
    v = F.try_parse_json(payload)
    title, company = t.text_or_empty("title"), t.text_or_empty("company")
    required = F.coalesce(F.col("required_skills"), F.array()).cast("array<string>")
    top = F.when(F.size(required) > 0, F.array_join(F.slice(required, 1, 3), ", ")).otherwise(title)
    text = lambda name, default: t.first_filled(coerce.as_text(v, f"$.{name}"), default)
    listed = coerce.as_list(v, "$.missing_requirements")
    return F.struct(
        text("fit_label", fit_label(F.col("rules_based_score"))).alias("fit_label"),
        text("why_match", F.concat(F.lit("Potential fit for "), title, F.lit("."))).alias("why_match"),
        F.when(F.size(listed) > 0, listed).otherwise(F.col("missing_skills")).alias("missing_requirements"),
        text("recommended_resume_emphasis", F.concat(F.lit("Highlight overlap with "), top, F.lit(".")))
        .alias("recommended_resume_emphasis"),
        text("recommended_cover_letter_angle", F.concat(
            F.lit("Explain why your background maps to "), company, F.lit("'s needs.")))
        .alias("recommended_cover_letter_angle"),
    )


def attach_assessments(prelim: DataFrame, short: DataFrame, responses: DataFrame | None) -> DataFrame:
    """`assessment` per row: the model response for shortlisted ids, the heuristic elsewhere.

    `responses` holds (profile_id, id, payload JSON). A response outside the shortlist is ignored; of
    several usable ones for a posting the least payload counts.
    """
    if responses is None:
        return prelim.withColumn("assessment", heuristic_assessment())
    usable = (
        responses.select("profile_id", "id", "payload")
        .where(F.try_variant_get(F.try_parse_json("payload"), "$", "map<string,variant>").isNotNull())
        .join(short, ["profile_id", "id"], "left_semi")
        .groupBy("profile_id", "id").agg(F.min("payload").alias("payload"))
    )
    rows = prelim.join(usable, ["profile_id", "id"], "left")
    chosen = F.when(F.col("payload").isNotNull(), response_assessment(F.col("payload"))).otherwise(heuristic_assessment())
    return rows.withColumn("assessment", chosen.cast(S.ASSESSMENT)).drop("payload")


def final_scores(rows: DataFrame) -> DataFrame:
    """0.65 rules + 0.20 similarity + 0.15 label; without similarity nothing passes 78.5."""
    blend = t.round_to(
        F.col("rules_based_score") * 0.65 + F.col("embedding_similarity_score") * 0.20
        + label_score(F.col("assessment.fit_label")) * 0.15, 2)
    rows = rows.withColumn("overall_score", clamp100(blend))
    texts = {
        n: t.first_filled(f"assessment.{n}", n)
        for n in ("why_match", "recommended_resume_emphasis", "recommended_cover_letter_angle")
    }
    return rows.withColumns({
        **texts,
        "disposition": F.when(F.col("overall_score") >= 80, "apply")
        .when(F.col("overall_score") >= 55, "maybe").otherwise("skip"),
    })


def rank_postings(
    scored: DataFrame, settings: Settings = Settings(), responses: DataFrame | None = None, ord_col: str = "ord"
) -> DataFrame:
    """Every scored row, without its wide texts, with its final score and its rank within the profile."""
    prelim = preliminary(score_table(scored))
    short = shortlist(prelim, settings, ord_col) if responses is not None else None
    rows = final_scores(attach_assessments(prelim, short, responses))
    return rank_rows(rows, ["profile_id"], [("overall_score", True), ("preliminary_score", True)], ord_col)


def top_ranked(scored: DataFrame, n: int, settings: Settings = Settings(), responses: DataFrame | None = None,
               ord_col: str = "ord") -> DataFrame:
    """First n rows per profile; Spark limits each partition before the shuffle."""
    prelim = preliminary(score_table(scored))
    short = shortlist(prelim, settings, ord_col) if responses is not None else None
    rows = final_scores(attach_assessments(prelim, short, responses))
    order = [F.col("overall_score").desc(), F.col("preliminary_score").desc(), F.col(ord_col)]
    w = W.partitionBy("profile_id").orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
