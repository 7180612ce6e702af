import random

import pytest
from pyspark.sql import functions as F

from rolescope import schemas as S, sinks
from rolescope.operators import dedupe, model_scorer, query_generation, query_match, ranking, scoring, stats
from rolescope.plans.search import search_and_rank
from rolescope.plans.spread import rank_rows, salted_join
from rolescope.settings import Settings

SETTINGS = Settings(
    target_titles=["Perception Engineer"], job_titles=["Computer Vision Engineer"], preferred_locations=["Berlin"],
    include_keywords=["slam"], search_industries=["robotics"], experience_level="senior",
    exclude_keywords=["sales"], visa_constraints=["x"])


def postings(spark, rows):
    base = dict(source="manual", source_url="u", company="Example Robotics", work_mode="unknown", description="")
    made = [{**base, "id": str(i), "ord": i, "source_ord": 0, **r} for i, r in enumerate(rows)]
    schema = S.T.StructType([*S.POSTING.fields, S.T.StructField("ord", S.LONG), S.T.StructField("source_ord", S.INT)])
    df = spark.createDataFrame([tuple(r.get(f.name) for f in schema.fields) for r in made], schema)
    return S.conform(df, S.POSTING, keep=["ord", "source_ord"])


def profiles(spark, **fields):
    names = ["profile_id", *[k for k in fields if k != "skills"]]
    df = spark.createDataFrame([("me", *[v for k, v in fields.items() if k != "skills"])],
                               ", ".join(f"{n} {'string' if n in ('profile_id', 'summary', 'seniority_hint', 'name') else 'array<string>'}" for n in names))
    skills = [F.struct(F.lit(s).alias("name"), F.lit("general").alias("category"), F.lit(1).alias("evidence_count"))
              for s in fields.get("skills", [])]
    return S.conform(df.withColumn("skills", F.array(*skills).cast(S.T.ArrayType(S.SKILL))), S.PROFILE)


FIT = dict(
    title="Perception Engineer", location="Berlin, Germany", work_mode="hybrid",
    description="Build multimodal perception, 3D vision, computer vision, and SLAM systems for robotics.",
    required_skills=["python", "pytorch", "computer vision", "slam"], preferred_skills=["3d vision", "sensor fusion"],
    domain_signals=["robotics", "multimodal perception", "slam"])
ME = dict(skills=["python", "pytorch", "computer vision", "slam", "3d vision"],
          domain_strengths=["multimodal perception", "slam", "robotics"], role_families=["perception"])


def test_rules_prefer_a_fitting_posting(spark):
    pairs = postings(spark, [FIT]).withColumn("profile_id", F.lit("me"))
    r = scoring.score_rules(pairs, scoring.prepare_profiles(profiles(spark, **ME), SETTINGS), SETTINGS).first()
    assert r.title_match_score == 100 and r.skills_overlap_score == 83.33 and r.domain_match_score == 75
    assert r.location_fit_score == 92 and r.preferred_sector_bonus == 10 and r.rules_based_score >= 70
    assert r.missing_skills == [] and r.disposition == "apply"


def test_scoring_branches(spark):
    rows = [
        dict(title="Internal Lead", company="Bad Co", description="three steps", location=None),
        dict(title="Vision", work_mode="remote", description="No sponsorship here", language_requirements=["german"]),
        dict(title="", location="Paris", description="sales of robotics"),
    ]
    s = Settings(target_titles=["Computer Vision Engineer"], blacklist_companies=["bad  co"], exclude_keywords=["sales"],
                 visa_constraints=["x"], search_industries=["robotics"])
    pairs = postings(spark, rows).withColumn("profile_id", F.lit("me"))
    got = {r.id: r for r in scoring.score_rules(pairs, scoring.prepare_profiles(profiles(spark), s), s).collect()}
    assert got["0"].seniority_fit_score == 100 - 1.5 * 40 and got["0"].mismatch_penalty == 50 + 35  # "hr" in three
    assert got["0"].location_fit_score == 55 and got["0"].title_match_score == 0
    assert got["1"].title_match_score == 88 and got["1"].location_fit_score == 100 and got["1"].constraints_fit_score == 30
    assert got["2"].title_match_score == 88 and got["2"].mismatch_penalty == 25 + 35 and got["2"].preferred_sector_bonus == 10
    assert got["2"].domain_match_score == 40 and got["2"].skills_overlap_score == 45


def test_hr_inside_a_word_costs(spark):
    pairs = postings(spark, [dict(title="X", description="through")]).withColumn("profile_id", F.lit("me"))
    r = scoring.score_rules(pairs, scoring.prepare_profiles(profiles(spark), Settings()), Settings()).first()
    assert r.mismatch_penalty == 35


def test_shortlist_and_fusion(spark):
    base = postings(spark, [dict(title=f"T{i}") for i in range(4)]).withColumns({
        "profile_id": F.lit("me"), "missing_skills": F.array().cast("array<string>"), "why_match": F.lit("w"),
        "recommended_resume_emphasis": F.lit("e"), "recommended_cover_letter_angle": F.lit("a"),
        "rules_based_score": F.element_at(F.array(*[F.lit(float(x)) for x in (60, 90, 90, 40)]), (F.col("ord") + 1).cast("int"))})
    answers = spark.createDataFrame(
        [("me", str(i), '{"fit_label": ["poor_fit"], "why_match": "because", "missing_requirements": "rust"}') for i in range(4)],
        "profile_id string, id string, payload string")
    out = ranking.rank_postings(base, Settings(label_top_n=1), answers).orderBy("rank").collect()
    assert [r.id for r in out] == ["2", "1", "0", "3"]
    labels = {r.id: r.assessment.fit_label for r in out}
    assert labels == {"1": "poor_fit", "2": "realistic", "0": "stretch", "3": "poor_fit"}
    first = {r.id: r for r in out}["1"]
    assert first.why_match == "because" and first.assessment.missing_requirements == ["rust"]
    assert first.overall_score == round(90 * .65 + 25 * .15, 2) and first.disposition == "maybe"
    lines = [r.line for r in sinks.top_match_lines(ranking.rank_postings(base), 1).orderBy("line_ord").collect()]
    assert lines[0] == "## 1. T1 @ Example Robotics" and "- Missing skills: None flagged" in lines


def test_rank_rows_equals_a_plain_sort(spark):
    random.seed(3)
    rows = [(random.choice("ab"), round(random.random(), 1), random.randint(0, 2), i) for i in range(500)]
    df = spark.createDataFrame(rows, "p string, a double, c int, ord long").repartition(7)
    got = {(r.p, r.ord): r.rank for r in rank_rows(df, ["p"], [("a", True), ("c", False)], "ord").collect()}
    for p in "ab":
        mine = sorted((r for r in rows if r[0] == p), key=lambda r: (-r[1], r[2], r[3]))
        assert [got[p, r[3]] for r in mine] == list(range(1, len(mine) + 1))


def test_salted_join_keeps_every_row(spark):
    big = spark.range(1000).select("id", F.when(F.col("id") < 700, 0).otherwise(F.col("id") % 5).alias("k"))
    small = spark.range(5).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    assert salted_join(big, small, ["k"], ["id"]).agg(F.count("*"), F.sum("v")).first() == (
        big.join(small, "k").agg(F.count("*"), F.sum("v")).first())


def naive_best(posting, queries):
    from rolescope.functions.query_kernel import TOKEN_ONLY
    norm = lambda x: " ".join(x.lower().split())
    tok = lambda x: TOKEN_ONLY.findall(norm(x))
    title, place = norm(posting["title"]), norm(posting["location"])
    skills = norm(" ".join(posting["required_skills"]))
    domain = norm(" ".join(posting["domain_signals"]))
    full = norm(" ".join([posting["title"], "Example Robotics", posting["location"], " ".join(posting["domain_signals"]),
                          " ".join(posting["required_skills"]), posting["description"]]))
    best = None
    for i, q in enumerate(queries):
        terms = q["terms"] or tok(q["text"])
        n = max(len(set(terms)), 1)
        a, b = set(tok(q["text"])), set(tok(full))
        ts = 1.0 if q["title"] and norm(q["title"]) in title else 0.0
        ls = 1.0 if q["location"] and norm(q["location"]) in place else 0.0
        ds = sum(1 for w in terms if w in domain or w in title or w in skills) / n
        ov = sum(1 for w in set(terms) if w in full) / n
        js = len(a & b) / len(a | b) if a and b else 0.0
        ph = 1.0 if norm(q["text"]) and norm(q["text"]) in full else 0.0
        score = ts * .35 + ds * .25 + ls * .10 + ov * .20 + js * .10 + ph * .10
        row = (round(score * 100, 2), i, score >= .32 or (ts >= 1 and ov >= .2) or ov >= .45)
        if best is None or row[0] > best[0]:
            best = row
    return best


@pytest.mark.parametrize("options", [{}, {"block_queries": 7}])
def test_match_equals_nested_loops(spark, options):
    random.seed(5)
    words = ["c++", "c", "slam", "vision", "robot", "berlin", "python", "across", "3d", "x-ray", "ai", "", "Für"]
    text = lambda n: " ".join(random.choice(words) for _ in range(n))
    queries = [dict(text=text(3), title=text(1) if i % 2 else None, location=random.choice([None, "Berlin", ""]),
                    terms=random.choice([[], ["c", "c", "VISION"], ["x-ray", "robot sl"], ["3d", "a"]])) for i in range(40)]
    posts = [dict(title=text(2), location=random.choice(["Berlin, DE", "", "Rome"]), description=text(12),
                  required_skills=[text(1)], domain_signals=[text(2)]) for _ in range(30)]
    q = spark.createDataFrame([(i, x["text"], x["title"], x["location"], x["terms"]) for i, x in enumerate(queries)],
                              "query_ord int, text string, title string, location string, terms array<string>")
    got = {r.ord: r.query_match for r in query_match.match_queries(postings(spark, posts).repartition(5), q, ["ord"], **options).collect()}
    for i, p in enumerate(posts):
        score, at, matched = naive_best(p, queries)
        assert (got[i].best_query_score, got[i].query_ord, got[i].matched) == (pytest.approx(score, abs=.011), at, matched)


def test_match_without_queries_keeps_all(spark):
    q = spark.createDataFrame([], "query_ord int, text string, title string, location string, terms array<string>")
    r = query_match.match_queries(postings(spark, [dict(title="T")]), q, ["ord"]).first()
    assert r.query_match.matched and r.query_match.best_query_score == 100.0


def test_match_per_profile(spark):
    q = spark.createDataFrame([("a", 0, "slam engineer"), ("a", 1, "robot"), ("b", 0, "sales lead")],
                              "profile_id string, query_ord int, text string").withColumns({
        "title": F.lit(None).cast("string"), "location": F.lit(None).cast("string"), "terms": F.array().cast("array<string>")})
    posts = postings(spark, [dict(title="Slam Engineer", description="slam engineer robot")])
    for options in ({}, {"block_queries": 1}):
        got = {r.profile_id: r.query_match for r in query_match.match_queries(posts, q, ["ord"], **options).collect()}
        assert got["a"].best_query == "slam engineer" and got["a"].matched and not got["b"].matched


def greedy(rows, threshold):
    from rolescope.functions.query_kernel import TOKEN_ONLY
    kept = []
    for key, text in rows:
        tokens, norm = set(TOKEN_ONLY.findall(text.lower())), " ".join(text.lower().split())
        if not norm and any(n == "" for _, n, _ in kept):
            continue
        near = lambda b: bool(tokens and b) and len(tokens & b) / len(tokens | b) >= threshold
        if not any(n == norm or near(b) for _, n, b in kept):
            kept.append((key, norm, tokens))
    return [k for k, _, _ in kept]


@pytest.mark.parametrize("threshold", [0.82, 0.5])
def test_near_duplicates_are_greedy(spark, threshold):
    random.seed(11)
    rows = [(i, " ".join(random.choice("abcdefgh") for _ in range(random.randint(0, 9)))) for i in range(250)]
    df = spark.createDataFrame(rows, "ord long, text string").repartition(5)
    got = sorted(r.ord for r in dedupe.near_duplicates(df, "text", "ord", threshold=threshold).collect())
    assert got == greedy(rows, threshold)


def test_generated_queries(spark):
    me = profiles(spark, **ME)
    s = Settings(job_titles=["Computer Vision Engineer", "Perception Engineer"], search_locations=["Berlin", "Remote"],
                 include_keywords=["slam"], german_variants=True, query_limit=40)
    rows = query_generation.generate_queries(me, s).orderBy("query_ord").collect()
    texts = [r.text for r in rows]
    assert len(texts) == 40 == len(set(map(str.lower, texts))) and texts[0] == "Computer Vision Engineer"
    assert [r.query_ord for r in rows] == list(range(40)) and rows[0].terms == ["computer", "vision", "engineer"]
    many = query_generation.generate_queries(me, Settings(**{**s.__dict__, "query_limit": 10_000})).orderBy("query_ord").collect()
    assert [r.text for r in many][:40] == texts and any(r.language == "de" for r in many)
    assert [r.query_ord for r in many] == greedy([(r.query_ord, r.text) for r in many], 0.82)


def test_stats_split_adds_up(spark):
    q = spark.createDataFrame([(0, "slam engineer")], "query_ord int, text string").withColumns({
        "title": F.lit(None).cast("string"), "location": F.lit(None).cast("string"), "terms": F.array().cast("array<string>")})
    found = query_match.match_queries(postings(spark, [FIT, dict(title="Cook")]), q, ["ord"])
    r = stats.source_stats(found).first()
    assert r.raw_jobs_discovered == r.jobs_matched + r.jobs_filtered_out == 2 and r.jobs_matched == 1
    assert sinks.filtered_out_rows(found).first().title == "Cook"


def test_search_and_rank_end_to_end(spark):
    posts = postings(spark, [FIT, FIT, dict(title="Cook", company="Diner", description="kitchen"), dict(title="Computer Vision Engineer", description="vision")])
    posts = posts.withColumn("id", F.when(F.col("ord") == 1, "0").otherwise(F.col("id")))
    out = search_and_rank(profiles(spark, **ME), posts, SETTINGS)
    ranked = out.ranked.orderBy("rank").collect()
    assert [r.title for r in ranked] == ["Perception Engineer", "Computer Vision Engineer"] and ranked[0].ord == 0
    assert out.stats.first().raw_jobs_discovered == 4


def test_dedupe_is_idempotent_and_first_wins(spark):
    rows = postings(spark, [dict(title="A", id="1"), dict(title="B", id="1"), dict(title="C", id="2", application_url="x")])
    once = dedupe.dedupe_postings(rows.repartition(7), ["source_ord", "ord"])
    assert sorted(r.title for r in once.collect()) == ["A", "C"]
    assert dedupe.dedupe_postings(once, ["source_ord", "ord"]).count() == 2


@pytest.mark.parametrize("options", [{}, {"block_queries": 2}])
def test_whole_word_terms_of_several_words_are_runs_of_tokens(spark, options):
    terms = ["computer vision", "vision team", "node.js", "team the", "vision"]
    q = spark.createDataFrame([(i, f"q{i}", [x]) for i, x in enumerate(terms)], "query_ord int, text string, terms array<string>").withColumns({
        "title": F.lit(None).cast("string"), "location": F.lit(None).cast("string")})
    posts = postings(spark, [dict(title="Computer", description="the computer vision lab, team the node js"),
                             dict(title="x", description="vision computer the vision teams")])
    for i, x in enumerate(terms):
        one = query_match.match_queries(posts, q.where(F.col("query_ord") == i), ["ord"], whole_word=True, **options).collect()
        hits = {r.ord: r.query_match.best_query_term_overlap for r in one}
        assert hits == {0: float(x != "vision team"), 1: float(x == "vision")}, x


def test_more_queries_than_a_block_lose_none(spark):
    q = spark.range(300).select(F.col("id").cast("int").alias("query_ord"), F.concat(F.lit("target"), "id").alias("text")).withColumns({
        "title": F.lit(None).cast("string"), "location": F.lit(None).cast("string"), "terms": F.array(F.col("text"))})
    posts = postings(spark, [dict(title="x", description="some target299 here"), dict(title="y", description="a target5")])
    got = query_match.match_queries(posts, q, ["ord"], whole_word=True, block_queries=40).collect()
    assert {r.ord: r.query_match.best_query for r in got} == {0: "target299", 1: "target5"}


MATCHED = ["matched", "best_query", "query_ord", "best_query_score", "best_query_similarity", "best_query_title_score",
           "best_query_domain_score", "best_query_location_score", "best_query_term_overlap", "decision_reason"]


@pytest.mark.parametrize("whole_word", [False, True])
def test_index_of_many_queries_equals_the_evaluation_in_the_row(spark, whole_word):
    random.seed(8)
    words = [a + b for a in ("rob", "vis", "sl", "data", "x", "c++", "ber") for b in ("", "ot", "ion", "am", "lin", "3", "ö")]
    odd = ["", " ", "—", "node.js", "a b", "z" * 700, "Über", "robot sl"]
    text = lambda n: " ".join(random.choice(words + odd[:5]) for _ in range(n))
    queries = [(random.choice("ab"), i, text(random.randint(0, 5)), random.choice([None, "", " ", text(1), "—"]), random.choice([None, "", "Ber", "ö lin"]),
                random.choice([None, [], [text(1), text(2)], [random.choice(odd), "robot", "robot"]])) for i in range(5000)]
    q = spark.createDataFrame(queries, "profile_id string, query_ord int, text string, title string, location string, terms array<string>")
    posts = postings(spark, [dict(title=text(3), location=random.choice(["", "Berlin — ö"]), description=text(random.choice([0, 3, 30])) + random.choice(["", " " + "y" * 600 + "z" * 900]),
                                  required_skills=[text(1)], domain_signals=[text(2)]) for _ in range(25)] + [dict(title="", description="", location="")])
    rows = lambda **options: {(r.ord, r.profile_id): tuple(r.query_match[c] for c in MATCHED) for r in query_match.match_queries(
        posts.repartition(3), q, ["ord"], whole_word=whole_word, **options).collect()}
    in_row, by_index = rows(block_queries=10_000), rows()
    assert len(in_row) == 52 and by_index == in_row
    assert rows(matched_only=True) == {k: v for k, v in in_row.items() if v[0]}


def test_model_answers_are_checked_retried_and_kept(spark, tmp_path):
    """Answers by kind of row; a second run asks only rows without an answer."""
    log = str(tmp_path / "calls")

    def client(rows):
        with open(log, "a", encoding="utf-8") as f:
            f.write("".join(f"{r['kind']}:{len(rows)}\n" for r in rows))
        if len(rows) > 1 and any(r["kind"] == "alone" for r in rows):
            raise ValueError("too many")
        if any(r["kind"] == "never" for r in rows):
            return []
        return [{"text": '{"fit_label": "stretch"}', "alone": {"fit_label": "realistic"}, "list": "[1]", "null": None}.get(r["kind"]) for r in rows]

    kinds = ["text", "alone", "list", "null", "never", "text", None]
    rows = spark.createDataFrame([(i, k, [k]) for i, k in enumerate(kinds)], "id long, kind string, payload array<string>").coalesce(1)
    got = {r.id: r for r in model_scorer.ask_model(rows, client, ["id"], ["kind", "payload"], batch=4, retries=2).collect()}
    text = '{"fit_label": "stretch"}'
    assert [got[i].payload for i in range(7)] == [text, '{"fit_label": "realistic"}', None, None, None, text, None]
    assert got[2].error == got[3].error == got[6].error == "answer is no JSON object" and got[4].error == "0 answers to 1 rows"
    assert got[2].attempts == 3 and got[1].attempts == 2
    assert model_scorer.ask_model(rows.limit(0), client, ["id"], ["kind"]).count() == 0

    target, seen = str(tmp_path / "answers"), []
    parts = lambda: model_scorer.ask_in_parts(rows, client, ["id"], ["kind"], target, parts=3, batch=2, retries=1,
                                              on_partial=lambda df, part: seen.append((part, {r.id for r in df.collect()})))
    first = {r.id: r.payload for r in parts().collect()}
    assert first == {i: got[i].payload for i in range(7)}
    assert [p for p, _ in seen] == [0, 1, 2] and sorted(x for _, ids in seen for x in ids) == list(range(7))
    before = len(open(log).read().splitlines())
    assert {r.id: r.payload for r in parts().collect()} == first
    again = open(log).read().splitlines()[before:]
    assert again and not any(x.startswith(("text", "alone")) for x in again)
