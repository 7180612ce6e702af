import csv
import glob
import random

from pyspark.sql import functions as F

from rolescope import fixed_values as V, schemas as S, sinks
from rolescope.operators import dedupe, query_match, ranking, scoring, state, stats
from rolescope.settings import Settings
from rolescope.sources import files
from rolescope.streaming import jobs
from tests.test_queries_and_ranking import FIT, ME, SETTINGS, postings, profiles


def queries(spark):
    return spark.createDataFrame([(0, "slam engineer"), (1, "perception")], "query_ord int, text string").withColumns({
        "title": F.lit(None).cast("string"), "location": F.lit(None).cast("string"), "terms": F.array().cast("array<string>")})


def test_stream_match_equals_batch_and_survives_restart(spark, tmp_path):
    rows = postings(spark, [FIT, dict(title="Cook"), dict(title="Slam")])
    src, out, state = (str(tmp_path / x) for x in ("src", "out", "state"))
    rows.where("ord < 2").coalesce(1).write.parquet(src)
    read = lambda: spark.readStream.schema(rows.schema).parquet(src)
    for extra in (None, "ord = 2"):
        if extra:
            rows.where(extra).coalesce(1).write.mode("append").parquet(src)
        jobs.stream_match(read(), queries(spark), out, state, ["ord"], trigger={"availableNow": True}).awaitTermination()
    got = {r.ord: (r.query_match.matched, r.query_match.best_query_score) for r in spark.read.parquet(out).collect()}
    want = {r.ord: (r.query_match.matched, r.query_match.best_query_score)
            for r in query_match.match_queries(rows, queries(spark), ["ord"]).collect()}
    assert got == want and len(glob.glob(out + "/batch=*")) == 2


def test_stream_match_manifest_changed_queries_and_final_table(spark, tmp_path):
    rows = postings(spark, [FIT, dict(title="Cook"), dict(title="Slam")])
    src, out, state, asked = (str(tmp_path / x) for x in ("src", "out", "state", "queries"))
    seen = []

    def run(n, text):
        rows.where(F.col("ord") == n).coalesce(1).write.mode("append").parquet(src)
        queries(spark).limit(1).withColumn("text", F.lit(text)).write.mode("overwrite").parquet(asked)
        stream = spark.readStream.schema(rows.schema).parquet(src)
        jobs.stream_match(stream, spark.read.parquet(asked), out, state, ["ord"], trigger={"availableNow": True},
                          on_partial=lambda part, batch: seen.append((batch, part.count()))).awaitTermination()
        return {r.ord: r.query_match.best_query for r in jobs.read_matches(spark, out).collect()}

    assert run(0, "slam") == {0: "slam"}
    assert run(1, "cook") == {0: "slam", 1: "cook"} and seen == [(0, 1), (1, 1)]
    # a part without an entry of the manifest was never finished
    spark.read.parquet(f"{out}/batch=0").write.parquet(f"{out}/batch=7")
    assert jobs.read_matches(spark, out).count() == 2
    assert {r.ord for r in jobs.finish_matches(spark, out).collect()} == {0, 1} == {r.ord for r in jobs.read_matches(spark, out).collect()}
    assert run(2, "robot") == {0: "slam", 1: "cook", 2: "robot"}
    assert jobs.finish_matches(spark, out).count() == 3 == jobs.finish_matches(spark, out).count()


def test_fresh_requests_match_a_walk(spark, tmp_path):
    seconds = {"a": [0, 10, 59, 60, 61, 119, 121, 500], "b": [5, 5, 70]}
    rows = spark.createDataFrame([(k, float(s) + 1e6) for k, v in seconds.items() for s in v], "url string, s double").select(
        "url", F.timestamp_seconds("s").alias("ts"))
    expected = set()
    for k, v in seconds.items():
        last = None
        for s in sorted(v):
            if last is None or s - last >= 60:
                expected.add((k, float(s) + 1e6))
                last = s
    random.seed(2)
    many = [(random.choice("abc"), random.randint(0, 5000) / 4) for _ in range(3000)]
    plain = lambda df: {(r.url, r.s) for r in df.select("url", F.col("ts").cast("double").alias("s")).collect()}
    assert plain(dedupe.fresh_requests(rows, ["url"], "ts", 60.0)) == expected
    walked = set()
    for k in "abc":
        last = None
        for x in sorted(s for q, s in many if q == k):
            if last is None or x - last >= 7.5:
                walked.add((k, x))
                last = x
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    more = spark.createDataFrame(many, "url string, s double").select("url", F.timestamp_seconds("s").alias("ts"))
    assert plain(dedupe.fresh_requests(more.repartition(5), ["url"], "ts", 7.5)) == walked
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    src, out, state = (str(tmp_path / x) for x in ("src", "out", "state"))
    rows.coalesce(1).write.parquet(src)
    stream = spark.readStream.schema(rows.schema).parquet(src)
    jobs.stream_fresh(stream, 60 / 3600).writeStream.option("checkpointLocation", state).trigger(
        availableNow=True).format("parquet").start(out).awaitTermination()
    assert plain(spark.read.parquet(out)) == expected


def ranked(spark):
    pairs = postings(spark, [FIT, dict(title="Cook", description='quote " and, comma')]).withColumn("profile_id", F.lit("me"))
    return ranking.rank_postings(scoring.score_rules(
        pairs, scoring.prepare_profiles(profiles(spark, **ME), SETTINGS), SETTINGS))


def test_ranked_csv(spark, tmp_path):
    path = str(tmp_path / "csv")
    sinks.write_ranked_csv(ranked(spark), path)
    rows = [r for part in sorted(glob.glob(path + "/*.csv")) for r in csv.DictReader(open(part))]
    assert list(rows[0]) == V.RANKED_CSV_COLUMNS and [r["title"] for r in rows] == ["Perception Engineer", "Cook"]
    assert rows[0]["disposition"] in ("apply", "maybe") and rows[0]["llm_latency_seconds"] == "0.0"


def test_json_and_reload(spark, tmp_path):
    path = str(tmp_path / "p")
    postings(spark, [FIT]).select(*S.POSTING.names).write.parquet(path)
    assert files.read_stage_output(spark, path, S.POSTING).schema == S.POSTING
    sinks.write_json(ranked(spark), str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2


def test_search_report(spark, tmp_path):
    evaluated = query_match.match_queries(postings(spark, [FIT, dict(title="Cook")]), queries(spark), ["ord"])
    kept, _ = query_match.split_by_match(evaluated)
    counted = stats.source_stats(evaluated)
    totals = stats.report_totals(counted, kept)
    asked = queries(spark).withColumn("rationale", F.lit(None).cast("string"))
    lines = sinks.search_report_lines(totals, asked, counted, ranked(spark), "me", ["a note"])
    text = [r.line for r in lines.orderBy("section", "ord").collect()]
    assert "- Raw jobs discovered: 2" in text and "- Jobs matched after filtering: 1" in text
    assert "- slam engineer (generated)" in text and "- manual: raw 2, filtered 1, matched 1" in text
    assert "## Top Jobs" in text and text[-1] == "- a note" and "- Sources searched: manual" in text
    sinks.write_lines(lines, ["section", "ord"], str(tmp_path / "r"))
    assert spark.read.text(str(tmp_path / "r")).count() >= len(text) - 5


def test_union_keeps_source_order(spark):
    a, b = postings(spark, [dict(title="A")]), postings(spark, [dict(title="B"), dict(title="C")])
    got = files.union_sources([("x", b), ("y", a)]).groupBy("source_ord").count().orderBy("source_ord").collect()
    assert [tuple(r) for r in got] == [(0, 2), (1, 1)]


def test_company_board_files(spark, tmp_path):
    from rolescope.operators import discovery
    companies = spark.createDataFrame([("Acme",), ("Nobody",)], "company string")
    probes = spark.createDataFrame([("lever", "acme", "https://l/a", 200, 200, True, 3)], S.PROBES)
    boards = discovery.company_boards(companies, probes, [])
    sinks.write_company_boards(boards, str(tmp_path / "b"))
    size = lambda part: spark.read.option("header", True).csv(str(tmp_path / "b" / part)).count()
    assert (size("all"), size("has_lever"), size("has_any_board")) == (2, 1, 1)
    table = files.read_board_table(spark, str(tmp_path / "b" / "all"))
    given = spark.createDataFrame([("lever", " ACME ", 0), ("ashby", "zed", 1)], "kind string, slug string, ord long")
    slugs = discovery.board_slugs(boards.withColumn("ord", F.xxhash64("company")), given)
    assert {(r.kind, r.slug) for r in slugs.collect()} == {("lever", "ACME"), ("ashby", "zed")} and table.count() == 2


def test_latest_within_ttl(spark):
    rows = spark.createDataFrame([("k", 100.0, "old"), ("k", 7300.0, "new"), ("j", 100.0, "stale")], "k string, s double, v string")
    rows = rows.withColumn("created", F.timestamp_seconds("s"))
    got = dedupe.latest_within_ttl(rows, ["k"], "created", F.timestamp_seconds(F.lit(10000.0)), 1).collect()
    assert [(r.k, r.v) for r in got] == [("k", "new")]


def test_changed_inputs(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id int, t string").withColumn("fingerprint", dedupe.fingerprint("t", config="v1"))
    assert dedupe.changed_inputs(rows, rows.where("id = 1"), ["id"]).first().id == 2
    other = rows.withColumn("fingerprint", dedupe.fingerprint("t", config="v2"))
    assert dedupe.changed_inputs(other, rows, ["id"]).count() == 2


def test_posting_validation_and_settings(spark):
    bad = postings(spark, [dict(title=None)]).withColumn("work_mode", F.lit("moon"))
    assert set(S.violations(bad).first().violations) == {"title missing", "work_mode invalid"}
    assert Settings().query_limit == 40


def test_merged_debug_maps_follow_the_fold(spark):
    random.seed(9)
    runs = [{k: random.choice([[f"{r}{k}{i}" for i in range(random.randint(1, 3))], f"s{r}{k}"]) for k in "abcd" if random.random() < 0.7} for r in range(6)]
    merged = {}
    for run in runs:
        for k, v in run.items():
            old = merged.get(k)
            merged[k] = old + v if isinstance(old, list) and isinstance(v, list) else v
    rows = []
    for r, run in enumerate(runs):
        for k, v in run.items():
            rows += [("s", r, k, i, x) for i, x in enumerate(v)] if isinstance(v, list) else [("s", r, k, None, v)]
    df = spark.createDataFrame(rows, "source string, run_ord int, key string, ord long, value string").repartition(4)
    got = {}
    for r in stats.merge_debug(df, ["source"]).orderBy("key", "ord").collect():
        if r.ord is None:
            got[r.key] = r.value
        else:
            got.setdefault(r.key, []).append(r.value)
            assert r.ord == len(got[r.key]) - 1
    assert got == merged
    assert stats.merge_debug(df.limit(0), ["source"]).count() == 0


def test_state_versions_and_reasons(spark, tmp_path):
    target, schema = str(tmp_path / "state"), "id long, fingerprint string"
    assert state.read_state(spark, target, schema).count() == 0
    first = spark.createDataFrame([(1, "a"), (2, "b"), (None, "n")], schema)
    assert state.commit_state(first, target) == 1
    inputs = spark.createDataFrame([(1, "a"), (2, "B"), (3, "c"), (None, "n"), (None, "m")], schema)
    outputs = spark.createDataFrame([(2,), (None,)], "id long")
    pending = state.pending_inputs(inputs, state.read_state(spark, target, schema), outputs, ["id"])
    assert {(r.id, r.fingerprint, r.reason) for r in pending.collect()} == {(1, "a", "lost"), (2, "B", "changed"), (3, "c", "new"), (None, "m", "changed")}
    after = state.with_finished(state.read_state(spark, target, schema), pending.drop("reason"), ["id"])
    # a version without its commit is not read
    after.limit(1).write.parquet(f"{target}/versions/9")
    assert {tuple(r) for r in state.read_state(spark, target, schema).collect()} == {(1, "a"), (2, "b"), (None, "n")}
    assert state.commit_state(after, target) == 2
    assert {tuple(r) for r in state.read_state(spark, target, schema).collect()} == {(1, "a"), (2, "B"), (3, "c"), (None, "m")}


def test_discovery_metadata_without_warnings(spark):
    asked = spark.createDataFrame([("p", "s", ["k"], ["r"], ["q"])], "profile_id string, summary string, keywords array<string>, regions array<string>, queries array<string>")
    boards = spark.createDataFrame([(True, False), (False, False)], "has_lever boolean, has_any_board boolean")
    none = spark.createDataFrame([], "ord long, warning string")
    r = stats.discovery_metadata(asked, boards, spark.range(7), none).first()
    assert (r.candidate_company_count, r.lever_hits, r.search_result_count, r.search_warning_count, r.search_warnings) == (2, 1, 7, 0, [])
