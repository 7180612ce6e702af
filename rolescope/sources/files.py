"""Postings, feeds, profiles, claims and stage outputs from files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rolescope import schemas as S
from rolescope.functions import text as t
from rolescope.operators import normalize
from rolescope.operators.structure import sections
from rolescope.plans.spread import gather_input
from rolescope.session import land

CSV_TEXT = [
    "id", "source", "source_url", "title", "company", "location", "work_mode", "description",
    "application_url", "date_posted",
]
CSV_LISTS = [
    "required_skills", "preferred_skills", "responsibilities", "minimum_qualifications", "domain_signals",
]
LABEL = r"(?iU)\A(title|company|location|description)\s*:\s*(.*)\z"


def read_postings_json(spark: SparkSession, path: str | list[str], **options: str) -> DataFrame:
    """A list of postings, or one, per file; rows that break the schema are in `violations`."""
    raw = gather_input(spark.read.options(**options).text(path, wholetext=True)).select(
        F.col("_metadata.file_path").alias("file"), F.try_parse_json("value").alias("v"))
    listed = F.try_variant_get("v", "$", "array<variant>")
    one = F.when(F.col("v").isNotNull(), F.array("v")).otherwise(F.array().cast("array<variant>"))
    rows = raw.select("file", F.posexplode(F.coalesce(listed, one)).alias("ord", "_v"))
    rows = rows.select("file", "ord", F.from_json(F.to_json("_v"), _posting_input()).alias("_p"),
                       F.to_json(F.try_variant_get("_v", "$.raw_payload", "variant")).alias("raw_payload"))
    flat = rows.select("file", "ord", "_p.*", "raw_payload")
    flat = flat.withColumn("work_mode", F.coalesce("work_mode", F.lit("unknown")))
    flat = flat.withColumn("description", F.coalesce("description", F.lit("")))
    return S.violations(normalize.normalize_postings(S.conform(flat, S.POSTING, keep=["file", "ord"])))


def _posting_input():
    return S.T.StructType([f for f in S.POSTING.fields if f.name != "raw_payload"])


def read_postings_csv(spark: SparkSession, path: str | list[str], like: str | None = None, **options: str) -> DataFrame:
    """Header CSV; list columns are split on |. The columns are those of the first file, or of the file `like`."""
    reader = lambda: spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    header = reader().csv(path) if like is None else reader().options(**options).schema(reader().csv(like).schema).csv(path)
    c = lambda n: F.col(n) if n in header.columns else F.lit(None).cast("string")

    def pipes(n: str) -> Column:
        parts = F.transform(F.split(t.text_or_empty(c(n)), r"\|", -1), t.strip)
        return F.filter(parts, lambda x: x != "")

    rows = header.select(
        F.col("_metadata.file_path").alias("file"),
        t.first_filled(c("id"), c("source_url"), c("application_url"), c("title")).alias("id"),
        t.first_filled(c("source"), F.lit("manual_import")).alias("source"),
        F.coalesce(t.first_filled(c("source_url"), c("application_url")), F.lit("")).alias("source_url"),
        t.first_filled(c("title"), F.lit("Unknown title")).alias("title"),
        t.first_filled(c("company"), F.lit("Unknown company")).alias("company"),
        c("location").alias("location"), t.first_filled(c("work_mode"), F.lit("unknown")).alias("work_mode"),
        t.text_or_empty(c("description")).alias("description"), *[pipes(n).alias(n) for n in CSV_LISTS],
        t.first_filled(c("application_url"), c("source_url")).alias("application_url"),
        c("date_posted").alias("date_posted"))
    return normalize.normalize_postings(S.conform(with_row_order(rows), S.POSTING, keep=["file", "ord"]))


def read_rss(spark: SparkSession, path: str) -> DataFrame:
    """Items of feed files, wherever they are nested; a missing link falls back to the feed."""
    item = "title STRING, description STRING, link STRING, pubDate STRING"
    rows = (
        spark.read.format("xml").option("rowTag", "item").schema(item).load(path)
        .withColumn("feed", F.col("_metadata.file_path"))
    )
    text = lambda n, default: t.strip(F.coalesce(t.first_filled(n), default))
    rows = rows.withColumns({
        "feed_url": F.col("feed"), "title": text("title", F.lit("Unknown title")),
        "description": text("description", F.lit("")), "source_url": text("link", F.col("feed")),
        "date_posted": F.col("pubDate"),
    })
    d = F.col("description")
    rows = rows.withColumns({
        "id": F.col("source_url"), "source": F.lit("rss"), "company": F.lit("RSS Import"),
        "application_url": F.col("source_url"), "work_mode": normalize.work_mode(d),
        "required_skills": normalize.skill_mentions(d), "domain_signals": normalize.domain_signals(d),
        "language_requirements": normalize.language_requirements(d),
        "raw_payload": F.to_json(F.struct("feed_url")), "file": F.col("feed"),
    })
    return normalize.normalize_postings(S.conform(with_row_order(rows), S.POSTING, keep=["file", "ord"]))


def read_profile_docs(spark: SparkSession, folder: str, files: DataFrame) -> DataFrame:
    """(profile_id, raw_text, source_files, sections) of each person's ordered files.

    `files` holds (profile_id, ord, path); the texts below `folder` are joined on the path.
    """
    plain = lambda c: F.regexp_replace(F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), r"\Afile:/*", "/")
    texts = spark.read.option("recursiveFileLookup", True).text(folder, wholetext=True).select(
        plain(F.col("_metadata.file_path")).alias("_path"),
        F.regexp_replace("value", "\\A\\x{FEFF}", "").alias("text"))
    listed = files.withColumn("_path", F.regexp_replace("path", r"\Afile:/*", "/"))
    return profile_documents(listed.join(texts, "_path").select("profile_id", "ord", "path", "text"))


def profile_documents(parts: DataFrame) -> DataFrame:
    """Join (profile_id, ord, path, text) parts; a person's files are few, so the list is bounded."""
    listed = parts.groupBy("profile_id").agg(F.array_sort(F.collect_list(F.struct("ord", "path", "text"))).alias("_f"))
    return listed.select(
        "profile_id",
        t.strip(F.array_join(F.transform("_f", lambda f: f["text"]), "\n\n")).alias("raw_text"),
        F.transform("_f", lambda f: f["path"]).alias("source_files"),
        F.flatten(F.transform("_f", lambda f: sections(f["text"]))).alias("sections"))


def labeled_postings(texts: DataFrame, text: str = "text", source: str = "manual_text") -> DataFrame:
    """Postings from free text with Title / Company / Location / Description lines.

    The description runs from its label to the next label. Extra columns are kept.
    """
    lines = F.transform(t.split_lines(t.text_or_empty(text)), lambda l: F.struct(
        l.alias("line"), F.lower(F.regexp_extract(t.strip(l), LABEL, 1)).alias("label"),
        t.strip(F.regexp_extract(t.strip(l), LABEL, 2)).alias("value")))
    rows = texts.withColumn("_lines", lines)

    def field(name: str) -> Column:
        return F.element_at(F.transform(F.filter("_lines", lambda l: l["label"] == name), lambda l: l["value"]), -1)

    def last(name: str) -> Column:
        found = F.filter("_lines", lambda l: l["label"] == name)
        return F.when(F.size(found) > 0, F.element_at(found, -1)["value"])

    empty = F.struct(F.lit(False).alias("on"), F.array().cast("array<string>").alias("kept"))

    def step(acc: Column, l: Column) -> Column:
        opens = l["label"] == "description"
        put = F.when(opens & (l["value"] != ""), F.concat(acc["kept"], F.array(l["value"]))).when(
            (l["label"] == "") & acc["on"], F.concat(acc["kept"], F.array(l["line"]))).otherwise(acc["kept"])
        return F.struct(F.when(l["label"] != "", opens).otherwise(acc["on"]).alias("on"), put.alias("kept"))

    described = t.strip(F.array_join(F.aggregate("_lines", empty, step)["kept"], "\n"))
    unlabeled = t.strip(F.array_join(F.transform(
        F.filter("_lines", lambda l: ~l["label"].isin("title", "company", "location")),
        lambda l: F.regexp_replace(l["line"], r"(?iU)\Adescription\s*:\s*", "")), "\n"))
    stripped = F.transform("_lines", lambda l: t.strip(l["line"]))
    heading = F.get(F.filter(stripped, lambda l: l.startswith("#")), F.lit(0))
    given = lambda n: F.col(n) if n in texts.columns else F.lit(None).cast("string")
    rows = rows.withColumns({
        "title": t.first_filled(given("title"), last("title"), t.strip(F.regexp_replace(heading, r"\A#+", "")),
                                F.lit("Selected role")),
        "company": t.first_filled(given("company"), last("company"), F.lit("Unknown company")),
        "location": t.first_filled(given("location"), last("location")),
        "description": F.coalesce(t.first_filled(described, unlabeled), F.lit("")),
    })
    digest = F.sha2(F.concat_ws("\n", "title", "company", "description"), 256)
    d = F.col("description")
    rows = rows.withColumns({
        "id": F.concat(F.lit("manual-"), F.substring(digest, 1, 16)),
        "source": given("source") if "source" in texts.columns else F.lit(source),
        "source_url": given("source_url") if "source_url" in texts.columns else F.lit(source),
        "work_mode": normalize.work_mode("location", d), "required_skills": normalize.skill_mentions(d),
        "responsibilities": F.slice(t.bullets_or_sentences(d), 1, 8),
        "domain_signals": normalize.domain_signals(d),
        "language_requirements": normalize.language_requirements(d),
        "raw_payload": F.lit('{"input_format": "manual_text"}'),
    })
    keep = [c for c in texts.columns if c not in S.POSTING.names and c != text]
    return normalize.normalize_postings(S.conform(rows, S.POSTING, keep=keep))


def read_posting_files(spark: SparkSession, path: str) -> DataFrame:
    """JSON postings (bare or under "listing"); anything else is read as labelled text.

    Both kinds are told apart by their content, so the texts are written together once: opening many small files
    costs far more than their bytes, and so does a task for every few of them.
    """
    files = land(gather_input(spark.read.text(path, wholetext=True)).select(
        F.col("_metadata.file_path").alias("file"), F.regexp_replace("value", "\\A\\x{FEFF}", "").alias("text")), "posting-texts")
    is_json = F.lower("file").endswith(".json")
    v = F.when(is_json, F.try_parse_json("text"))
    inner = F.try_variant_get(v, "$.listing", "map<string,variant>")
    job = F.when(inner.isNotNull(), F.try_variant_get(v, "$.listing", "variant")).otherwise(v)
    rows = files.withColumn("_job", job).withColumn("_p", F.from_json(F.to_json("_job"), _posting_input()))
    complete = F.lit(True)
    for name in ("id", "source", "source_url", "title", "company"):
        complete = complete & F.col(f"_p.{name}").isNotNull()
    complete = F.coalesce(complete, F.lit(False))
    good = rows.where(complete).select("file", "_p.*", F.to_json(
        F.try_variant_get("_job", "$.raw_payload", "variant")).alias("raw_payload"))
    good = good.withColumn("work_mode", F.coalesce("work_mode", F.lit("unknown")))
    get = lambda n: F.try_variant_get("_job", f"$.{n}", "string")
    loose = rows.where(~complete).select(
        "file", F.coalesce(F.to_json("_job", {"pretty": "true"}), F.col("text")).alias("text"),
        F.when(F.col("_job").isNotNull(), t.first_filled(get("title"), get("job_title"), F.lit("Selected role")))
        .alias("title"),
        F.when(F.col("_job").isNotNull(), t.first_filled(get("company"), F.lit("Unknown company"))).alias("company"),
        get("location").alias("location"),
        F.when(F.col("_job").isNotNull(), "manual_json").otherwise("manual_file").alias("source"),
        F.col("file").alias("source_url"))
    return S.conform(good, S.POSTING, keep=["file"]).unionByName(labeled_postings(loose))


def claim_lines(rows: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """(key, ord, claim): one claim per line, marks stripped, blank and # lines dropped."""
    lines = F.transform(
        t.split_lines(t.text_or_empty(text)), lambda l: t.strip(F.regexp_replace(t.strip(l), r"\A[-* ]+", "")))
    cut = rows.select(*key, F.posexplode(lines).alias("ord", "claim"))
    return cut.where((F.col("claim") != "") & ~F.col("claim").startswith("#"))


def read_claims(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("file"), F.regexp_replace("value", "\\A\\x{FEFF}", "").alias("text"))
    return claim_lines(files, ["file"])


def read_board_table(spark: SparkSession, path: str) -> DataFrame:
    """Discovery CSV with the slug columns of every board kind."""
    return with_row_order(spark.read.option("header", True).csv(path))


def with_row_order(rows: DataFrame) -> DataFrame:
    """Rows of a scan with `ord`, a long that rises with the place in the files, split by split."""
    return rows.withColumn("ord", F.monotonically_increasing_id())


def read_stage_output(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def read_web_hits(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("query_ord INT, query STRING, title STRING, href STRING, body STRING").parquet(path)


def read_sitemap(spark: SparkSession, path: str) -> DataFrame:
    """(file, ord, loc) of sitemap files; a malformed file gives no rows."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("xml"))
    return sitemap_locations(raw, ["file"])


def sitemap_locations(rows: DataFrame, key: list[str], xml: str = "xml") -> DataFrame:
    """(key, ord, loc): text of every element whose name ends in loc, in document order."""
    parsed = F.from_xml(F.col(xml), "_bad STRING", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    parsed = rows.withColumn("_ok", F.coalesce(F.col(xml), F.lit("")).rlike(r"\S") & parsed["_bad"].isNull())
    bare = F.regexp_replace(xml, r"(?s)<!--.*?-->", "")
    found = F.regexp_extract_all(bare, F.lit(r"(?s)<(?:[\w.\-]+:)?[\w.\-]*loc(?:\s[^>]*)?>([^<]+)<"), F.lit(1))
    entities = lambda x: F.replace(F.replace(F.replace(x, F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&amp;"), F.lit("&"))
    return parsed.where("_ok").select(
        *key, F.posexplode(F.transform(found, lambda x: t.strip(entities(x)))).alias("ord", "loc"))


def union_sources(parts: list[tuple[str, DataFrame]]) -> DataFrame:
    """Postings of all enabled sources with `source_ord`, the order in which sources count.

    `ord` (a row's order within its source or file) and `file` are kept and null where a source has none.
    """
    out = None
    for i, (_, df) in enumerate(parts):
        own = {"ord": "long", "file": "string"}
        df = df.withColumns({c: F.col(c).cast(kind) if c in df.columns else F.lit(None).cast(kind) for c, kind in own.items()})
        rows = S.conform(df, S.POSTING, keep=list(own)).withColumn("source_ord", F.lit(i))
        out = rows if out is None else out.unionByName(rows)
    return out
