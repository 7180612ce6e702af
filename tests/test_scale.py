"""Work that must not grow with the number of rows, batches or copies."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rolescope import schemas as S
from rolescope.functions import text as t
from rolescope.functions.batches import in_slices
from rolescope.functions.query_kernel import MEMO_LIMIT, NOTHING, Limits, QuerySet
from rolescope.operators import evidence_index, matching as m, normalize, query_index, query_match, structure
from rolescope.sources import files as sources
from workload import matching, normalizing, streams

KEY = ["profile_id", "posting_id", "ord"]


@pytest.mark.parametrize("files", ["one", "folder"])
def test_a_table_streams_as_one_file_or_as_a_folder(spark, tmp_path, files):
    rows = spark.range(40).withColumnRenamed("id", "doc_id")
    rows.repartition(3).write.parquet(str(tmp_path / "documents.parquet" if files == "folder" else tmp_path / "made"))
    if files == "one":
        rows.coalesce(1).write.mode("overwrite").parquet(str(tmp_path / "made"))
        next((tmp_path / "made").glob("part-*")).rename(tmp_path / "documents.parquet")
    rows.where("doc_id < 5").write.parquet(str(tmp_path / "documents_of_others.parquet"))
    got = streams.drain(streams.stream(spark, str(tmp_path), "documents"), spark, "documents")
    assert sorted(r.doc_id for r in got.collect()) == list(range(40))


def test_a_batch_is_worked_off_in_slices():
    done, sizes = [], []
    batch = (pa.array(range(10)), pa.array([None, *"abcdefghi"]))
    for made in in_slices([batch], 4, lambda n, x: done.append(n) or {"n": n, "x": x}, pa.struct({"n": pa.int64(), "x": pa.string()})):
        sizes.append((len(made), len(done)))  # a slice is made when it is asked for
    assert sizes == [(4, 4), (4, 8), (2, 10)]


def test_terms_inside_tokens_and_a_bounded_memory_of_them():
    random.seed(4)
    word = lambda most: "".join(random.choice("ab1+") for _ in range(random.randint(1, most)))
    terms = sorted({word(6) for _ in range(80)})
    query = dict(pid="", ord=0, text="t", text_n="t", title_n=None, location_n=None, terms=terms, term_set=terms, tokens=["ab", "ba1"])
    known = QuerySet([query], Limits(1.0, 1.0, 1.0), False)
    for token in [word(14) for _ in range(500)]:
        inside = {known.term_id[x] for x in terms if x in token}
        found = known._contained(token)
        assert set(found[0]) == inside and found[1] == known.word_id.get(token, -1)
        assert (found is NOTHING) == (not inside and token not in known.word_id)
    assert MEMO_LIMIT <= 1 << 18


@pytest.mark.parametrize("busy", [3, 1 << 20])
def test_evidence_meets_its_profile_once(spark, monkeypatch, busy):
    """Numbers of items lie far apart, as those of turns do; a profile of many requirements is cut into lanes."""
    monkeypatch.setattr(m, "BUSY", busy)
    items = [("p", turn << 32, f"a{turn % 3} b{turn} c", "s") for turn in range(12)] + [("q", 1 << 40, "c", "s"), ("q", None, "c", "s")]
    asked = [("p", "j", i, f"a{i % 4} b{i} d") for i in range(10)] + [("p", "j", 3, "a0 b3 d"), ("q", "j", 0, "c"), (None, "j", 0, "c"), ("q", "j", 1, None)]
    evidence = spark.createDataFrame(items, "profile_id string, ord long, text string, source_section string")
    reqs = spark.createDataFrame(asked, "profile_id string, posting_id string, ord int, requirement string")
    rows = m.retrieve_evidence(reqs, evidence, KEY, 2)
    found = {}
    for r in rows.collect():
        found.setdefault((r.profile_id, r.ord), []).append((-round(r.similarity, 9), r.evidence_ord))
    want = {}
    for p, _, o, text in asked:
        near = [] if text is None else [
            (-round(len(set(text.split()) & set(x.split())) / len(set(text.split()) | set(x.split())), 9), at) for q, at, x, _ in items if q == p and at is not None]
        want[p, o] = sorted(want.get((p, o), []) + near)[:2]  # rows of a repeated key share the places
    assert {k: sorted(v) for k, v in found.items()} == {k: v for k, v in want.items() if v}
    assert set(rows.columns) == {*KEY, "requirement", "evidence_ord", "evidence", "source_section", "similarity"}
    if busy > len(asked):
        assert "sequence(" not in rows._jdf.queryExecution().optimizedPlan().toString()  # nothing is repeated


def test_split_sides_read_one_evaluation(spark, tmp_path):
    spark.createDataFrame([(i, f"title {i}\nthe slam text", "en", "src") for i in range(6)] + [(9, None, None, None)],
                          "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "slam the text"), (2, "zebra")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = normalizing.query_filter_split(spark, str(tmp_path))
    assert "Arrow" not in rows._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.doc_id for r in rows.collect()) == [0, 1, 2, 3, 4, 5, 9]


def test_posting_files_are_opened_once(spark, tmp_path):
    (tmp_path / "a.txt").write_text("Title: Cook\nDescription: soups")
    (tmp_path / "b.json").write_text('{"id": "1", "source": "s", "source_url": "u", "title": "Vet", "company": "c"}')
    rows = sources.read_posting_files(spark, str(tmp_path))
    assert "Scan text" not in rows._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.title for r in rows.collect()) == ["Cook", "Vet"]


def test_small_files_are_written_by_row_and_read_in_few_tasks(spark, monkeypatch):
    from rolescope.plans.spread import gather_input
    from workload import landing
    texts = [f"Title: t{i}\nDescription: d{i}" for i in range(149)] + [None]
    path = landing.landed_each(spark.createDataFrame([(x,) for x in texts], "value string").repartition(5), "small")
    most = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4m")
    try:
        scan = spark.read.text(path, wholetext=True)
        assert scan.rdd.getNumPartitions() >= 100 and gather_input(scan).rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism
        tasks = []
        monkeypatch.setattr(sources, "land", lambda df, name: tasks.append(df.rdd.getNumPartitions()) or df)
        titles = sorted(r.title for r in sources.read_posting_files(spark, path).collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", most)
    assert titles == sorted([f"t{i}" for i in range(149)] + ["Selected role"]) and max(tasks) <= 4 * spark.sparkContext.defaultParallelism
    assert sorted(r.value for r in spark.read.text(path, wholetext=True).collect()) == sorted(f"{x or ''}\n" for x in texts)


def plan_of(rows):
    return rows._jdf.queryExecution().optimizedPlan().toString()


def test_top_terms_are_counted_without_sorting_words(spark):
    rows = spark.createDataFrame([(1, "Bee cat bee, dog cat ab ab ab and and"), (2, None), (3, "zzz yyy")], "id int, text string")
    got = structure.top_terms(rows, ["id"], "text", 2)
    assert sorted(map(tuple, got.collect())) == [(1, 0, "bee", 2), (1, 1, "cat", 2), (3, 0, "zzz", 1), (3, 1, "yyy", 1)]
    assert "sort_array" not in plan_of(got)


def test_similarity_cuts_each_text_into_tokens_once(spark):
    rows = spark.createDataFrame([("a b c", "b c d"), ("", "a"), (None, "a")], "l string, r string")
    got = rows.select(t.text_jaccard("l", "r").alias("s"))
    assert [r.s for r in got.collect()] == [0.5, 0.0, None]
    assert plan_of(got).count("regexp_extract_all(") == 2


def test_a_salary_is_searched_once_in_a_text(spark):
    rows = spark.createDataFrame([("x EUR 50,000 - 60,000 y $ 7",), ("none",), ("gbp 5 to z",)], "d string")
    got = rows.select(normalize.salary_range("d").alias("s"))
    assert [tuple(r.s) if r.s else None for r in got.collect()] == [("EUR", 50000.0, 60000.0, "year"), None, ("GBP", 5.0, None, "year")]
    assert plan_of(got).count("coalesce(d") == 1


@pytest.mark.parametrize("text", ["a b", " a  b ", "a\t b", "a \tb", "\x1ca\x1c\x1cb\x85", "a  　b", "\xe4 \xa0\xa0~!", "", "a\n"])
def test_white_space_is_squeezed_as_a_whole(spark, text):
    got = spark.createDataFrame([(text,)], "s string").select(t.squeeze("s").alias("a"), F.trim(F.regexp_replace("s", rf"{t.WS}+", " ")).alias("b")).first()
    assert got.a == got.b


def test_shared_evidence_asks_every_assistant_line(spark, tmp_path):
    rows = [(c, i, role, f"{role} line {c}") for c in range(45) for i, role in enumerate(["user", "assistant"])]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = matching.evidence_topk_shared(spark, str(tmp_path)).collect()
    assert {r.ord >> 40 for r in got} == set(range(45))
    assert len(got) == 45 * 5 and {r.evidence_ord >> 40 for r in got if r.ord >> 40 == 40} >= {40}


@pytest.mark.parametrize("least, held", [(1 << 15, 1 << 16), (16, 40)])
def test_shared_evidence_writes_no_pairs(spark, monkeypatch, least, held):
    """A profile whose lines all share a token writes its bags and k items for each, whatever the blocks are."""
    random.seed(5)
    line = lambda: " ".join(["common", *(f"w{random.randint(0, 30)}" for _ in range(random.randint(0, 6)))])
    items, asked = [("p", 10 * i, line(), "s") for i in range(400)] + [("p", None, "only", "s")], [("p", i, line()) for i in range(120)] + [("p", 200, "only")]
    sizes, land = {}, evidence_index.land
    monkeypatch.setattr(evidence_index, "land", lambda df, name: sizes.setdefault(name, (kept := land(df, name)).count()) and kept)
    monkeypatch.setattr(evidence_index, "ASKED_LEAST", least, raising=False)
    monkeypatch.setattr(evidence_index, "HELD_BLOCK", held, raising=False)
    got = {}
    for r in m.retrieve_evidence(spark.createDataFrame(asked, "profile_id string, ord int, requirement string"), spark.createDataFrame(
            items, "profile_id string, ord long, text string, source_section string"), ["profile_id", "ord"], 4, direct=0).collect():
        got.setdefault(r.ord, []).append((-round(r.similarity, 9), r.evidence_ord))
    for _, o, x in asked:
        a = set(x.split())
        assert sorted(got[o]) == sorted((-round(len(a & set(y.split())) / len(a | set(y.split())), 9), i) for _, i, y, _ in items if i is not None)[:4]
    assert max(sizes.values()) <= 400, sizes


def test_pairs_of_an_index_meet_in_one_exchange(spark):
    queries = spark.createDataFrame([(i, f"alpha{i % 3} beta") for i in range(20)], "query_ord int, text string").withColumn(
        "terms", F.split("text", " ")).withColumn("title", F.lit("alpha1 beta")).withColumn("location", F.lit("de"))
    posts = S.conform(spark.createDataFrame([(1, "Alpha1 beta", "gamma"), (2, "x", "alpha2"), (3, "", None)], "ord int, title string, description string"), S.POSTING, keep=["ord"])
    index = query_index.prepare_queries(queries)
    pairs = query_index._pairs(query_index._contexts(posts, ["ord"]), ["ord"], index)
    assert plan_of(pairs).count("Aggregate") == 2 and "RepartitionByExpression" in plan_of(pairs)
    pairs.collect()
    plan = pairs._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "hashpartitioning(ord" in plan and "fid" not in "".join(x for x in plan.splitlines() if "hashpartitioning" in x)
    rows = lambda n: sorted((r.ord, r.query_match) for r in query_match.match_queries(posts, queries, ["ord"], block_queries=n).collect())
    assert rows(16) == rows(4096)
