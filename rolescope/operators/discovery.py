"""Companies and their boards from web search hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rolescope import fixed_values as V
from rolescope.functions import text as t
from rolescope.functions.urls import url_host

BOARDS = ["greenhouse", "lever", "ashby"]
PROBED_VARIANTS = 5
CAPITALIZED = r"(?U)\b([A-Z][A-Za-z0-9&\-.]+(?:\s+[A-Z][A-Za-z0-9&\-.]+){0,3})\b"


def clean_company(name: Column, stop_words: list[str] = V.NON_COMPANY_WORDS) -> Column:
    """Trimmed candidate name, null when it cannot be a company."""

    def check(c: Column) -> Column:
        low = F.lower(c)
        bad = (
            (F.length(c) < 2) | (F.length(c) > 80) | c.rlike(r"(?U)\A[0-9\W_]+\z") | low.isin(stop_words)
            | low.rlike(r"(jobs|careers|career)\z")
        )
        return F.when(~bad, c)

    return t.let(F.btrim(F.regexp_replace(name, rf"{t.WS}+", " "), F.lit(" -|–—:,.")), check)


def normalize_company(name: Column) -> Column:
    """Legal and generic words removed anywhere, other symbols dropped."""
    words = "|".join(V.COMPANY_SUFFIXES)
    c = F.regexp_replace(t.strip(name), rf"(?iU)\b({words})\b", "")
    return t.squeeze(F.regexp_replace(c, r"(?U)[^A-Za-z0-9\s\-&]", ""))


def slug_variants(name: Column) -> Column:
    """Up to five spellings of a company name as a board slug."""

    def spell(base: Column) -> Column:
        anded = F.replace(base, F.lit("&"), F.lit("and"))
        dash = lambda x: F.replace(x, F.lit(" "), F.lit("-"))
        glue = lambda x: F.replace(x, F.lit(" "), F.lit(""))
        return t.unique_ordered(F.array(
            dash(base), glue(base), dash(anded), glue(anded), F.regexp_replace(base, "[^a-z0-9]", "")))

    return t.let(F.lower(normalize_company(name)), spell)


def host_root(url: Column, stop_words: list[str] = V.NON_COMPANY_WORDS) -> Column:
    root = F.split_part(F.replace(F.lower(url_host(url)), F.lit("www."), F.lit("")), F.lit("."), F.lit(1))
    return t.let(root, lambda r: F.when(
        (F.length(r) >= 2) & ~r.isin(stop_words) & ~r.rlike(r"\A[0-9]+\z"), r))


def company_candidates(title: Column, href: Column, body: Column) -> Column:
    """Names found in one search hit: title pieces, host root, capitalised phrases."""
    pieces = F.transform(F.split(t.text_or_empty(title), r"[|\-–—:•/]", -1), lambda x: clean_company(x))
    phrases = F.transform(F.regexp_extract_all(t.text_or_empty(body), F.lit(CAPITALIZED), F.lit(1)), lambda x: clean_company(x))
    return F.array_distinct(F.array_compact(F.concat(pieces, F.array(host_root(t.text_or_empty(href))), phrases)))


def extract_companies(hits: DataFrame, seeds: list[str] = V.COMPANY_SEEDS, fold_case: bool = False) -> DataFrame:
    """Distinct normalized company names of all hits and the seeds.

    Names are distinct within a hit before they are exploded, and `distinct` aggregates map-side.
    """
    names = hits.select(F.explode(F.array_distinct(F.transform(
        company_candidates(F.col("title"), F.col("href"), F.col("body")), normalize_company))).alias("company"))
    if seeds:
        extra = hits.sparkSession.createDataFrame([(s,) for s in seeds], "company string")
        names = names.where(F.length("company") >= 2).unionByName(
            extra.select(normalize_company(F.col("company")).alias("company")))
    names = names.where(F.length("company") >= 2)
    if fold_case:
        return names.groupBy(F.lower("company").alias("_k")).agg(F.min("company").alias("company")).drop("_k")
    return names.distinct()


def score_company(name: Column, keywords: list[str], hints: list[str] = V.COMPANY_NAME_HINTS) -> Column:
    low = F.lower(name)
    return sum((F.contains(low, F.lit(k.lower())).cast("int") for k in [*keywords, *hints]), F.lit(0))


def best_probes(companies: DataFrame, probes: DataFrame, kinds: list[str] = BOARDS) -> DataFrame:
    """Per company and board kind, the probe of its first slug variant that answered.

    `probes` holds (kind, slug, url, status, api_status, api_ok, jobs_count). One aggregation
    with a minimum per kind takes the place of a pivot.
    """
    variants = companies.select("company", slug_variants(F.col("company")).alias("slug_variants"))
    asked = variants.select("company", F.posexplode(F.slice("slug_variants", 1, PROBED_VARIANTS)).alias("pos", "slug"))
    answered = probes.where((F.coalesce("url", F.lit("")) != "") | F.coalesce("api_ok", F.lit(False)))
    hits = asked.join(answered, "slug")
    row = F.struct("pos", "slug", "url", "status", "api_status", "api_ok", "jobs_count")
    best = hits.groupBy("company").agg(*[F.min(F.when(F.col("kind") == k, row)).alias(f"_{k}") for k in kinds])
    out = variants.join(best, "company", "left")
    columns = []
    for k in kinds:
        columns += [
            F.col(f"_{k}.slug").alias(f"{k}_slug"), F.col(f"_{k}.url").alias(f"{k}_url"),
            F.col(f"_{k}.status").alias(f"{k}_status"), F.col(f"_{k}.api_status").alias(f"{k}_api_status"),
            F.coalesce(F.col(f"_{k}.api_ok"), F.lit(False)).alias(f"{k}_api_ok"),
            F.col(f"_{k}.jobs_count").alias(f"{k}_jobs_count")]
    return out.select("company", F.to_json("slug_variants").alias("slug_variants"), *columns)


def company_boards(companies: DataFrame, probes: DataFrame, keywords: list[str], kinds: list[str] = BOARDS) -> DataFrame:
    """Best probes with relevance, flags and the total number of jobs."""
    rows = best_probes(companies, probes, kinds)
    flags = {f"has_{k}": F.col(f"{k}_url").isNotNull() | F.col(f"{k}_api_ok") for k in kinds}
    any_flag = flags[f"has_{kinds[0]}"]
    for k in kinds[1:]:
        any_flag = any_flag | flags[f"has_{k}"]
    return rows.withColumns({
        "relevance_score": score_company(F.col("company"), keywords), **flags, "has_any_board": any_flag,
        "total_jobs_count": sum((F.coalesce(F.col(f"{k}_jobs_count"), F.lit(0)) for k in kinds), F.lit(0)),
    })


def sort_companies(boards: DataFrame) -> DataFrame:
    return boards.orderBy(
        F.col("has_any_board").desc(), F.col("total_jobs_count").desc(), F.col("relevance_score").desc(), "company")


def board_slugs(boards: DataFrame, configured: DataFrame, ord_col: str = "ord") -> DataFrame:
    """(kind, slug): configured slugs first, then discovered ones, distinct by normalized value."""
    from rolescope.operators.dedupe import first_per_value

    stacked = boards.select(ord_col, F.explode(F.array(*[
        F.struct(F.lit(k).alias("kind"), F.col(f"{k}_slug").alias("slug")) for k in BOARDS])).alias("_s"))
    found = stacked.select("_s.kind", "_s.slug", F.struct(F.lit(1), F.col(ord_col).cast("long")).alias("_o"))
    given = configured.select("kind", "slug", F.struct(F.lit(0), F.col(ord_col).cast("long")).alias("_o"))
    rows = given.union(found).where(F.col("slug").isNotNull())
    return first_per_value(rows, ["kind"], "slug", "_o").select("kind", "slug", F.col("_o").alias("slug_order"))
