import random

import pytest
from pyspark.sql import functions as F

from rolescope import schemas as S, sinks
from rolescope.functions.query_kernel import TOKEN_ONLY
from rolescope.operators import matching as m
from rolescope.plans.search import explain_matches
from rolescope.settings import Settings
from tests.test_queries_and_ranking import postings, profiles

KEY = ["profile_id", "posting_id", "ord"]


def with_items(spark, text, similarities, column="requirement", item="Built and deployed Python AI workflows."):
    items = F.array(*[F.struct(F.lit(item).alias("text"), F.lit("work_history").alias("source_section"), F.lit(x).alias("similarity"))
                      for x in similarities])
    empty = "array<struct<text:string,source_section:string,similarity:double>>"
    return spark.range(1).select(F.lit(text).alias(column), items.cast(empty).alias("evidence"))


@pytest.mark.parametrize("sims, status, confidence", [
    ([0.80], "strong_match", 0.80), ([0.99], "strong_match", 0.95), ([0.55], "partial_match", 0.55),
    ([0.35], "uncertain", 0.35), ([0.1], "missing", 0.70), ([], "missing", 0.65)])
def test_support_bands(spark, sims, status, confidence):
    r = m.assess_requirements(with_items(spark, "Python workflows", sims)).first()
    assert (r.status, r.confidence) == (status, confidence)
    if status in ("partial_match", "uncertain"):
        assert r.transferable_skills == ["python", "workflows"]


def test_model_answer_wins_and_bad_answer_falls_back(spark):
    rows = with_items(spark, "Python", [0.1, 0.05])
    good = m.assess_requirements(rows.withColumn("payload", F.lit(
        '{"status": "Strong Match", "confidence": 3, "selected_evidence_indices": [2, "1", "x"], "transferable_skills": "go"}'))).first()
    assert (good.status, good.confidence, good.transferable_skills) == ("strong_match", 1.0, ["go"])
    assert [e.similarity for e in good.evidence] == [0.05, 0.05]
    for payload in ("not json", '{"status": "great"}', None):
        r = m.assess_requirements(rows.withColumn("payload", F.lit(payload).cast("string"))).first()
        assert r.status == "missing" and len(r.evidence) == 2


def test_claim_without_support(spark):
    rows = with_items(spark, "I have built production RAG systems using FastAPI.", [0.52], "claim")
    r = m.check_claims(rows).first()
    assert not r.supported and r.safer_wording.startswith("My background includes Built and deployed Python AI workflows,")
    assert r.explanation == "No supplied evidence clearly supports the claim (best similarity 0.52)." or "Missing direct evidence for: fastapi, production, rag" in r.explanation
    r = m.check_claims(with_items(spark, "Deployed Python workflows", [0.8], "claim")).first()
    assert r.supported and r.safer_wording is None and r.confidence == 0.8
    r = m.check_claims(with_items(spark, "Deployed", [], "claim")).first()
    assert not r.supported and r.confidence == 0.70 and r.safer_wording.startswith("I am interested")


def test_model_claim_answer(spark):
    rows = with_items(spark, "Deployed Rust", [0.2], "claim").withColumn("payload", F.lit('{"supported": true, "confidence": 0.9}'))
    r = m.check_claims(rows).first()
    assert r.supported and r.confidence == 0.9 and r.safer_wording is None


def test_requirements(spark):
    post = postings(spark, [dict(
        title="T", required_skills=["Python", "Python", "computer vision", "c"], preferred_skills=["PyTorch", "PyTorch"],
        description="Good communication is helpful. Build computer vision classification evaluation pipelines.")])
    got = [r.requirement for r in m.extract_requirements(post, ["id"]).orderBy("ord").collect()]
    assert got.count("Python") == 1 and "c" not in got and len(got) <= 15
    assert not any("communication" in g.lower() for g in got)
    assert got[-1] == "Build computer vision classification evaluation pipelines"


def test_model_requirements_come_last(spark):
    post = postings(spark, [dict(title="T", required_skills=["Python"])]).withColumn(
        "model_requirements", F.lit('{"requirements": ["python", "Go"]}'))
    assert [r.requirement for r in m.extract_requirements(post, ["id"]).orderBy("ord").collect()] == ["Python", "Go"]


@pytest.mark.parametrize("direct", [0, 256, 1 << 20])
def test_evidence_top_k_over_many_blocks(spark, direct):
    """Item by item, through postings lists, and both: the same rows, with ties, copies and items without a token."""
    random.seed(9)
    words = [f"w{i}" for i in range(60)] + ["common"] * 40
    text = lambda n: " ".join(random.choice(words) for _ in range(n))
    items = [("p", i, text(random.randint(0, 8))) for i in range(1500)] + [("q", 0, "only one"), ("q", 7000, "w1 w2")]
    items += [("p", i, "common rare") for i in range(1500, 1900)] + [("p", 5000 + i, f"common x{i} y{i}") for i in range(200)]
    asked = [("p", "j", i, text(random.randint(1, 14))) for i in range(25)] + [("p", "j", 40 + i, "common x7 absent") for i in range(3)] + [
        ("p", "j", 50, "rare"), ("p", "j", 51, "absent words"), ("p", "j", 52, " "), ("p", "j", 53, None), ("p", "j", 54, "x1 x2")] + [("q", "j", 0, "w1"), ("none", "j", 0, "w1"), ("p", "j", 99, "!!!")]
    evidence = spark.createDataFrame([(p, i, t, "s") for p, i, t in items], "profile_id string, ord long, text string, source_section string")
    reqs = spark.createDataFrame(asked, "profile_id string, posting_id string, ord int, requirement string")
    got = m.retrieve_evidence(reqs, evidence.repartition(6), KEY, 3, salts=4, direct=direct).collect()
    found = {}
    for r in sorted(got, key=lambda r: (-r.similarity, r.evidence_ord)):
        found.setdefault((r.profile_id, r.ord), []).append((r.evidence_ord, round(r.similarity, 9)))
    tok = lambda x: set(TOKEN_ONLY.findall(x.lower()))
    for p, _, o, req in asked:
        if not (req or "").strip():
            assert (p, o) not in found
            continue
        a = tok(req)
        scored = []
        for q, i, t in items:
            if q == p:
                b = tok(t)
                scored.append((i, round(len(a & b) / len(a | b), 9) if a and b else 0.0))
        scored.sort(key=lambda x: (-x[1], x[0]))
        assert found.get((p, o), []) == scored[:3]


def test_built_evidence_labels_and_uniqueness(spark):
    me = profiles(spark, summary="Applied engineer. Builds vision systems.", skills=["Python"], domain_strengths=["robotics"],
                  role_families=["perception"])
    me = me.withColumns({
        "work_experience": F.array(F.struct(
            F.lit("Engineer").alias("title"), F.lit("Co").alias("company"), F.lit(None).cast("string").alias("start_date"),
            F.lit(None).cast("string").alias("end_date"), F.array(F.lit("- Built pipelines")).alias("highlights"),
            F.array().cast("array<string>").alias("technologies"), F.array().cast("array<string>").alias("domains"),
            F.array().cast("array<string>").alias("leadership_signals"))),
        "projects": F.array(F.struct(
            F.lit("Demo project name that is long").alias("name"), F.lit(None).cast("string").alias("role"), F.lit("d").alias("description"),
            *[F.array().cast("array<string>").alias(c) for c in ("highlights", "technologies", "domains", "links")]))})
    rows = m.build_evidence(S.conform(me, S.PROFILE)).collect()
    assert {r.source_section for r in rows} == {"summary", "skills", "domains", "roles", "work_history", "projects"}
    assert len({r.text.lower() for r in rows}) == len(rows)
    assert "Skills: Python" in {r.text for r in rows}


def test_match_scores_from_statuses(spark):
    me = profiles(spark, skills=["Python"])
    jobs = postings(spark, [dict(title="Backend Engineer", company="Example Co", required_skills=["Python", "Rust"])]).withColumn(
        "posting_id", F.lit("j"))
    pairs = spark.createDataFrame([("me", "j")], "profile_id string, posting_id string")
    claims = spark.createDataFrame([("me", "j", 0, "Wrote Rust kernels"), ("me", "j", 1, " wrote rust  kernels")],
                                   "profile_id string, posting_id string, ord int, claim string")
    r = explain_matches(me, jobs, pairs, Settings(), claims).first()
    assert r.overall_score == 30.0 and [a.status for a in r.assessments] == ["partial_match", "missing"]
    assert r.gaps == ["No clear evidence for: Rust", "Rules-based skill gap: Rust"] and len(r.unsupported_claims) == 1
    assert r.recommendation.startswith("Weak match")
    report = explain_matches(me, jobs, pairs, Settings(), claims)
    lines = [x.line for x in sinks.match_report_lines(report, ["profile_id"]).orderBy("line_ord").collect()]
    assert lines[0] == "# Explainable Match Report: Backend Engineer @ Example Co"
    assert "- Overall score: 30.00" in lines and "### Wrote Rust kernels" in lines and "- Supported: false" in lines


def test_no_evidence_is_missing(spark):
    me = profiles(spark, role_families=[])
    jobs = postings(spark, [dict(title="ML Engineer", required_skills=["Python"])]).withColumn("posting_id", F.lit("j"))
    pairs = spark.createDataFrame([("me", "j")], "profile_id string, posting_id string")
    r = explain_matches(me, jobs, pairs).first()
    assert r.overall_score == 0.0 and r.assessments[0].status == "missing" and r.gaps


@pytest.mark.parametrize("block", [3, 4096])
def test_vectors_meet_in_blocks(spark, monkeypatch, block):
    """The rows of comparing item by item, with ties, copies, opposite, missing, broken and short vectors; no row for a pair."""
    from rolescope.operators import vector_blocks
    monkeypatch.setattr(vector_blocks, "ASKED_BLOCK", block)
    monkeypatch.setattr(vector_blocks, "HELD_BLOCK", block)
    random.seed(3)
    vector = lambda: [random.choice([-1.0, 0.0, 0.5, 2.0]) for _ in range(4)]
    odd = [None, [], [1.0, None, 0.0, 0.0], [1.0, 2.0], [0.0] * 4, [float("nan"), 1.0, 0.0, 0.0]]
    items = [("p", i, f"t{i}", "s", v) for i, v in enumerate([*(vector() for _ in range(60)), *odd])] + [("p", 7, "t7b", "s", vector()), ("q", 0, "x", "s", [1.0] * 4), ("p", None, "n", "s", [1.0] * 4)]
    asked = [("p", i, "r", v) for i, v in enumerate([*(vector() for _ in range(12)), *odd])] + [("p", 3, "r", vector()), ("p", 90, " ", vector()), ("q", 1, "r", [1.0] * 4), ("z", 1, "r", [1.0] * 4)]
    evidence = spark.createDataFrame(items, "profile_id string, ord long, text string, source_section string, vector array<double>")
    reqs = spark.createDataFrame(asked, "profile_id string, ord int, requirement string, vector array<double>")
    key, measure = ["profile_id", "ord"], m.by_vector("vector")
    got = m.retrieve_evidence(reqs, evidence, key, 3, similarity=measure)
    assert "Arrow" in got._jdf.queryExecution().optimizedPlan().toString()
    want = m._compare_items(reqs, evidence, key, 3, "requirement", 16, 8, measure)
    rows = lambda df: sorted((r.profile_id, r.ord, r.evidence_ord, r.similarity) for r in df.collect())
    assert rows(got) == rows(want) and got.columns == want.columns
