"""How the engine's tables are filled from the test tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rolescope import schemas as S
from rolescope.functions import text as t
from rolescope.operators import normalize
from rolescope.plans.spread import spread_input
from rolescope.settings import Settings

# The test prose is invented, so the lists hold words that occur in it.
SKILLS = {
    "programming_languages": ["inoran", "hehely", "nicht"],
    "frameworks": ["orantion", "ononst", "thatin"],
    "cloud": ["sich", "pour"],
    "ml_topics": ["of the", "that the", "de la", "mente"],
    "leadership": ["with the", "dans"],
}
TERMS = [x for xs in SKILLS.values() for x in xs]
DOMAINS = {
    "rewh": ["orre", "elle est"],
    "keit": ["heit und", "für"],
    "tion": ["mentar", "ación"],
    "anea": ["erer the", "eran the"],
}
INDUSTRIES = {"lich": ["schaft", "ungen"], "eron": ["thble the", "ered to"]}
LANGUAGES = ["english", "nicht", "pour", "that"]
SENIORITY = {"der": 10, "des": 25, "la": 50, "is": 60, "the": 78, "er": 95}
UNRELATED = ["hehely ononst", "worthless", "quex"]
SETTINGS = Settings(
    target_titles=["The of", "Er"], preferred_locations=["de"], search_locations=["Es"],
    include_keywords=["orre", "lich"], exclude_keywords=["thatin  inoran", "nzz"],
    criteria_industries=["Keit und"], search_industries=["ation the"],
    blacklist_companies=["Group  src3"], visa_constraints=["visa"], experience_level="la",
    label_top_n=5, label_min_rules_score=30.0,
)


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def wide(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A test table is one small file; spread it so that heavy expressions use every core."""
    return spread_input(table(spark, d, name))


def first_line(c: str = "text") -> Column:
    return F.split_part(F.col(c), F.lit("\n"), F.lit(1))


def postings(spark: SparkSession, d: str) -> DataFrame:
    docs = wide(spark, d, "documents")
    rows = docs.select(
        F.col("doc_id").alias("ord"), F.lit(0).alias("source_ord"),
        F.col("doc_id").cast("string").alias("id"), "source",
        F.concat(F.lit("https://example.org/doc/"), F.col("doc_id")).alias("source_url"),
        first_line().alias("title"), F.concat(F.lit("Group "), "source").alias("company"),
        F.col("lang").alias("location"), F.lit("unknown").alias("work_mode"), F.col("text").alias("description"),
        normalize.skill_mentions("text", TERMS).alias("required_skills"),
        normalize.domain_signals("text", DOMAINS, INDUSTRIES).alias("domain_signals"),
        normalize.language_requirements("text", LANGUAGES).alias("language_requirements"),
    )
    return S.conform(rows, S.POSTING, keep=["ord", "source_ord"])


def queries(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(
        F.col("item_id").cast("int").alias("query_ord"), "text",
        F.regexp_extract("text", r"^\S+", 0).alias("title"), F.substring("text", 1, 2).alias("location"),
        F.array_distinct(t.tokenise("text")).alias("terms"))


def profiles(spark: SparkSession, d: str) -> DataFrame:
    """One profile per source, from its documents labelled as good; lists are bounded by the taxonomies."""
    docs = wide(spark, d, "documents").join(table(spark, d, "labels").where("quality = 1"), "doc_id")
    said = docs.select(
        F.col("source").alias("profile_id"), first_line().alias("title"),
        normalize.skill_mentions("text", TERMS).alias("skills"),
        normalize.domain_signals("text", DOMAINS, {}).alias("domains"),
        normalize.domain_signals("text", {}, INDUSTRIES).alias("industries"))
    union = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(c))))
    rows = said.groupBy("profile_id").agg(
        union("skills").alias("_skills"), union("domains").alias("domain_strengths"),
        union("industries").alias("industries"), F.array(F.min("title")).alias("role_families"))
    rows = rows.withColumn("skills", F.transform(
        F.col("_skills"), lambda s: F.struct(s.alias("name"), F.lit("general").alias("category"), F.lit(1).alias("evidence_count"))))
    return S.conform(rows, S.PROFILE)


def turns(spark: SparkSession, d: str, role: str) -> DataFrame:
    """(profile_id, posting_id, ord, text): non-blank lines of one side of each conversation."""
    rows = wide(spark, d, "conversations").where(F.col("role") == role)
    cut = rows.select("conv_id", "turn", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    return cut.where(F.trim("line") != "").select(
        F.col("conv_id").cast("string").alias("profile_id"), F.col("conv_id").cast("string").alias("posting_id"),
        (F.col("turn") * (1 << 32) + F.col("pos")).alias("ord"), F.col("line").alias("text"))


def headed_text() -> Column:
    """First line as heading, the others as bullets, then a second heading with the language."""
    rest = F.substr(F.col("text"), F.length(first_line()) + 2)
    return F.concat(
        F.lit("# "), first_line(), F.when(rest != "", F.concat(
            F.lit("\n- "), F.replace(rest, F.lit("\n"), F.lit("\n- ")))).otherwise(""),
        F.lit("\n## "), "source", F.lit("\n"), "lang")


def scratch(spark, name: str) -> str:
    """A new folder under the shared checkpoint folder; a local session without one uses /tmp."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if shared:
        return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can read")
    return tempfile.mkdtemp(prefix=f"run-{name}-")
