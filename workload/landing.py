"""Payloads, files and reports landed from the test tables in the shared folder, then read by the readers."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rolescope import schemas as S, sinks
from rolescope.functions import text as t
from rolescope.operators import discovery as disc, ranking
from rolescope.plans.search import whole_ranked
from rolescope.plans.spread import rank_rows, spread_input
from rolescope.session import land
from rolescope.sources import boards, files
from rolescope.sources.manual import import_files
from workload import query, sql as q, tables as b
from workload.discovery import PROBES, boards as found_boards
from workload.normalizing import _evaluated
from workload.ranking import FUSED, S as SETTINGS, responses, scored
from workload.tables import scratch

PAGE = 100  # postings of one payload file


def landed(rows: DataFrame, name: str, kind: str = "text", **options) -> str:
    path = f"{scratch(rows.sparkSession, name)}/files"
    rows.write.format(kind).options(**options).save(path)
    return path


def landed_each(rows: DataFrame, name: str) -> str:
    """A file for each row of one text column, written in the tasks; Spark's writer takes about 18 ms for a file."""
    path = f"{scratch(rows.sparkSession, name)}/files"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
        store.create_dir(folder)
        task = TaskContext.get().partitionId()  # a task that runs again writes the same files again
        n = 0
        for batch in batches:
            for text in batch.column(0):
                with store.open_output_stream(f"{folder}/{task:05d}-{n}.txt") as out:
                    out.write(f"{text.as_py() or ''}\n".encode())
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n])], names=["files"])

    rows.mapInArrow(write, "files long").agg(F.sum("files")).collect()
    return path


def listings(spark: SparkSession, d: str) -> DataFrame:
    return b.table(spark, d, "documents").select(
        "doc_id", b.first_line().alias("title"), F.coalesce("source", F.lit("none")).alias("source"), "lang", "text",
        F.concat(F.lit("https://example.org/doc/"), F.col("doc_id")).alias("url"))


def pages(spark: SparkSession, d: str, name: str, job: Column, items: str | None = None) -> str:
    """One payload file per page of postings."""
    jobs = F.transform(F.array_sort(F.collect_list(F.struct("doc_id", job.alias("job")))), lambda x: x["job"])
    rows = listings(spark, d).groupBy(F.floor(F.col("doc_id") / PAGE)).agg(jobs.alias("jobs"))
    return landed(rows.select(F.to_json(F.struct(F.col("jobs").alias(items)) if items else "jobs")), name, maxRecordsPerFile=1)


def html(x: str) -> Column:
    safe = F.replace(F.replace(F.col(x), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    return F.concat(F.lit("<p>"), safe, F.lit("</p>"))


def facts(postings: DataFrame) -> DataFrame:
    """What a reader made of each posting; white space counts as one space."""
    squeezed = {c: t.normalize_text(c) for c in ("title", "description")}
    return postings.withColumns(squeezed).select(
        "id", "title", "company", "location", "work_mode", "source_url", "application_url", "date_posted", "description")


MODE = """case when contains(h, 'hybrid') then 'hybrid' when contains(h, 'remote') or contains(h, 'work from home') then 'remote'
  when contains(h, 'on-site') or contains(h, 'onsite') or contains(h, 'office') then 'onsite' else 'unknown' end"""
URL = "'https://example.org/doc/' || doc_id"


def facts_sql(id: str = "cast(doc_id as varchar)", date: str = "'2024-05-06'", apply: str = URL, source_url: str = URL,
              place: str = "lang", company: str = "coalesce(source, 'none')") -> str:
    return f"""
select {id} id, {q.norm("coalesce(" + q.FIRST + ", 'Unknown title')")} title, {company} company, {place} "location", {MODE} work_mode,
  {source_url} source_url, {apply} application_url, {date} date_posted, {q.norm("coalesce(text, '')")} description
from (select *, lower(coalesce({place}, '') || ' ' || {q.norm("coalesce(text, '')")}) h from documents)"""


@query("read_greenhouse", facts_sql())
def read_greenhouse(spark, d):
    job = F.struct(
        F.col("doc_id").alias("id"), "title", F.col("source").alias("company_name"), F.col("url").alias("absolute_url"),
        F.struct(F.col("lang").alias("name")).alias("location"), F.lit("2024-05-06").alias("updated_at"), html("text").alias("content"))
    return facts(boards.read_greenhouse(spark, pages(spark, d, "greenhouse", job, "jobs")))


@query("read_lever", facts_sql(apply=URL + " || '/apply'"))
def read_lever(spark, d):
    job = F.struct(
        F.col("doc_id").alias("id"), F.col("title").alias("text"), F.col("source").alias("company"), F.col("url").alias("hostedUrl"),
        F.concat("url", F.lit("/apply")).alias("applyUrl"), F.struct(F.col("lang").alias("location")).alias("categories"),
        F.lit("2024-05-06").alias("createdAt"), html("text").alias("description"))
    return facts(boards.read_lever(spark, pages(spark, d, "lever", job)))


@query("read_ashby", facts_sql(apply=URL + " || '/apply'"))
def read_ashby(spark, d):
    job = F.struct(
        F.col("doc_id").alias("jobId"), F.col("title").alias("jobTitle"), F.col("source").alias("companyName"),
        F.col("url").alias("jobUrl"), F.concat("url", F.lit("/apply")).alias("applyUrl"), F.col("lang").alias("jobLocation"),
        F.lit("2024-05-06").alias("publishedAt"), html("text").alias("descriptionHtml"))
    return facts(boards.read_ashby(spark, pages(spark, d, "ashby", job, "jobs")))


def plain_posting() -> Column:
    return F.struct(
        F.col("doc_id").cast("string").alias("id"), "source", F.col("url").alias("source_url"), "title",
        F.col("source").alias("company"), F.col("lang").alias("location"), F.col("text").alias("description"),
        F.lit("2024-05-06").alias("date_posted"))


@query("read_postings_json", facts_sql(apply="null::varchar"))
def read_postings_json(spark, d):
    return facts(files.read_postings_json(spark, pages(spark, d, "postings-json", plain_posting())).where(F.size("violations") == 0))


MANUAL = ("id", "source", "source_url", "title", "company", "location", "work_mode", "description", "required_skills", "domain_signals")


@query("manual_import", f"""
with {q.MATCH}, files as (
  select doc_id, matched, case when doc_id // {PAGE} % 10 = 9 then '.json' else '.csv' end suffix,
    case when doc_id // {PAGE} % 10 = 9 then doc_id else doc_id // {PAGE} end file from best)
select min(doc_id) first_doc, suffix, count(*) raw_jobs, sum(matched::BIGINT)::BIGINT matched_jobs, sum((not matched)::BIGINT)::BIGINT filtered_out_jobs,
  null::VARCHAR note from files group by suffix, file
union all select null, null, null, null, null, unnest(['configured manual file not found: absent.json', 'unsupported manual import file type: .txt'])""")
def manual_import(spark, d):
    """Pages of postings as CSV files, every tenth page as JSON files of one posting; a missing file and one of a foreign kind."""
    base = scratch(spark, "manual")
    posts, page = b.postings(spark, d), F.floor(F.col("ord") / PAGE)
    posts.where(page % 10 == 9).select(*MANUAL).write.option("maxRecordsPerFile", 1).json(f"{base}/json")
    piped = [F.array_join(c, "|").alias(c) if c in files.CSV_LISTS else F.col(c) for c in MANUAL]
    posts.where(page % 10 != 9).select(page.alias("page"), *piped).repartition("page").write.partitionBy("page").options(
        header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(f"{base}/csv")
    spark.range(1).select(F.lit("x").alias("value")).coalesce(1).write.text(f"{base}/text")
    there = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base).where(F.col("length") > 0).select(
        F.regexp_extract("path", r"/((?:json|csv|text)/.*)\z", 1).alias("name"))
    names = land(there.unionByName(spark.sql("SELECT 'json/absent.json' AS name")).sort("name").select(
        F.monotonically_increasing_id().alias("file_ord"), "name"), "manual-names")
    got = import_files(spark, base, names, b.queries(spark, d))
    first = got.postings.groupBy("file_ord").agg(F.min(F.col("id").cast("long")).alias("first_doc"))
    counted = got.counts.join(first, "file_ord").select(
        "first_doc", F.regexp_extract("name", r"(\.[a-z]+)\z", 1).alias("suffix"), "raw_jobs", "matched_jobs", "filtered_out_jobs",
        F.lit(None).cast("string").alias("note"))
    empty = [F.lit(None).cast(counted.schema[c].dataType).alias(c) for c in counted.columns[:-1]]
    return counted.unionByName(got.notes.select(*empty, "note"))


@query("read_postings_csv", facts_sql())
def read_postings_csv(spark, d):
    rows = listings(spark, d).select(plain_posting().alias("p")).select("p.*")
    path = landed(rows, "postings-csv", "csv", header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return facts(files.read_postings_csv(spark, path))


@query("read_rss", facts_sql(id=URL, place="null::varchar", company="'RSS Import'"))
def read_rss(spark, d):
    rows = listings(spark, d).select(
        "title", F.col("text").alias("description"), F.col("url").alias("link"), F.lit("2024-05-06").alias("pubDate"))
    path = landed(rows, "rss", "xml", rootTag="channel", rowTag="item")
    return facts(files.read_rss(spark, path))


@query("read_posting_files", f"""
select {q.norm("coalesce(" + q.FIRST + ", 'Selected role')")} title, coalesce(source, 'none') company, 'manual_file' source,
  {q.norm("coalesce(text, '')")} description from documents""")
def read_posting_files(spark, d):
    """One labelled text file per document; a part file of a text sink does not end in .json."""
    text = F.concat(
        F.lit("Title: "), "title", F.lit("\nCompany: "), "source", F.lit("\nDescription: "), F.coalesce("text", F.lit("")))
    path = landed_each(spread_input(listings(spark, d)).select(text), "posting-files")
    rows = files.read_posting_files(spark, path)
    return rows.select(
        t.normalize_text("title").alias("title"), "company", "source", t.normalize_text("description").alias("description"))


@query("union_sources", f"""
with u as (
  select 0 source_ord, doc_id, 'a' kind from documents union all select 1, doc_id, 'b' from documents where doc_id % 2 = 0)
select source_ord, cast(doc_id as varchar) id, row_number() over (partition by source_ord order by doc_id) place from u""")
def union_sources(spark, d):
    """Row order survives: places by `ord` within a source are those of the documents."""
    first = b.postings(spark, d)
    second = b.postings(spark, d).where(F.col("ord") % 2 == 0)
    rows = files.union_sources([("a", first), ("b", second)]).select("source_ord", "id", "ord")
    ranked = rank_rows(rows, ["source_ord"], [], "ord", "place")
    return ranked.select("source_ord", "id", "place")


@query("read_stage_output", """select cast(doc_id as varchar) id, source, text description from documents""")
def read_stage_output(spark, d):
    path = landed(b.postings(spark, d), "stage", "parquet")
    return files.read_stage_output(spark, path, S.POSTING).select("id", "source", "description")


@query("read_web_hits", """
select page_id::INTEGER query_ord, url href, regexp_extract(html, '<title>([^<]*)</title>', 1) title from pages""")
def read_web_hits(spark, d):
    hits = b.table(spark, d, "pages").select(
        F.col("page_id").cast("int").alias("query_ord"), F.lit("q").alias("query"),
        F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.col("url").alias("href"), F.lit("").alias("body"))
    return files.read_web_hits(spark, landed(hits, "hits", "parquet")).select("query_ord", "href", "title")


@query("board_table_slugs", f"""
with {PROBES}, x as (select distinct slug from cos)
select distinct kind, slug from probes where slug in (select slug from x)""")
def board_table_slugs(spark, d):
    """Company boards written as CSV, read back and reduced to the slugs of every board kind."""
    path = f"{scratch(spark, 'boards')}/csv"
    sinks.write_company_boards(found_boards(spark, d), path)
    none = spark.createDataFrame([], "kind string, slug string, ord long")
    return disc.board_slugs(files.read_board_table(spark, f"{path}/all"), none).select("kind", "slug")


@query("write_ranked_json", f"with {FUSED} select profile_id, id, overall overall_score, rank from ordered")
def write_ranked_json(spark, d):
    path = f"{scratch(spark, 'ranked-json')}/json"
    sinks.write_json(ranking.rank_postings(scored(spark, d), SETTINGS, responses(spark, d)), path)
    return spark.read.schema("profile_id string, id string, overall_score double, rank bigint").json(path)


@query("write_ranked_csv", f"""
with {FUSED} select company, {q.norm('title')} title, overall overall_score, array_to_string(missing, ' | ') missing_skills from ordered""")
def write_ranked_csv(spark, d):
    path = f"{scratch(spark, 'ranked-csv')}/csv"
    sinks.write_ranked_csv(ranking.rank_postings(scored(spark, d), SETTINGS, responses(spark, d)), path)
    rows = spark.read.option("header", True).option("multiLine", True).csv(path)
    return rows.select("company", t.normalize_text("title").alias("title"), F.col("overall_score").cast("double").alias("overall_score"),
                       F.coalesce("missing_skills", F.lit("")).alias("missing_skills"))


@query("filtered_out_rows", f"with {q.MATCH} select doc_id, round_even(total * 100, 2) score from best where not matched")
def filtered_out_rows(spark, d):
    return sinks.filtered_out_rows(_evaluated(spark, d)).select(
        F.col("ord").alias("doc_id"), F.col("query_match.best_query_score").alias("score"))


@query("discovered_rows", """
select cast(doc_id as varchar) id from documents where source in (select min(source) from documents)""")
def discovered_rows(spark, d):
    least = b.table(spark, d, "documents").agg(F.min("source")).first()[0]
    return sinks.discovered_rows(b.postings(spark, d), least).select("id")


@query("site_filtered_lines", """
with x as (select doc_id, unnest(list_filter([
  '## ' || split_part(text, chr(10), 1) || ' @ Group ' || source, '', '- Location: ' || lang, '- Source: ' || source,
  '- URL: https://example.org/doc/' || doc_id, '- Discovery method: site_filter', ''], lambda v: v is not null)) line
  from documents where lang = 'en')
select cast(doc_id as varchar) id, line from x""")
def site_filtered_lines(spark, d):
    method = F.when(F.col("location") == "en", "site_filter").otherwise("crawl")
    rows = b.postings(spark, d).withColumn("raw_payload", F.to_json(F.struct(method.alias("discovery_method"))))
    return sinks.site_filtered_lines(sinks.site_filtered_rows(rows), ["id"]).select("id", "line")


@query("whole_ranked_json", f"""
with {FUSED} select profile_id, id, rank, description from ordered where rank <= 5""")
def whole_ranked_json(spark, d):
    """The JSON bundle of the best postings, with their texts."""
    ranked = ranking.rank_postings(scored(spark, d), SETTINGS, responses(spark, d))
    path = f"{scratch(spark, 'bundle')}/json"
    sinks.write_json(whole_ranked(ranked, b.postings(spark, d), ["ord", "source_ord"], 5), path)
    return spark.read.schema("profile_id string, id string, rank bigint, description string").json(path)
