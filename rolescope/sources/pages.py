"""Postings from landed HTML pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rolescope import fixed_values as V, schemas as S
from rolescope.functions import text as t
from rolescope.functions.html import page_cards, page_facts
from rolescope.functions.urls import is_candidate_url, join_url, url_host
from rolescope.operators import normalize
from rolescope.operators.crawl import crawl_sites, link_table
from rolescope.plans.spread import first_per_key


def page_postings(
    pages: DataFrame, source: str = "static_company_pages", payload: dict[str, Column] | None = None
) -> DataFrame:
    """One posting per (url, html[, company]) page. Extra columns are kept."""
    rows = pages.withColumn("_f", page_facts(F.col("html")))
    given = F.col("company") if "company" in pages.columns else F.lit(None).cast("string")
    d = F.col("_f.text")
    apply_href = F.col("_f.apply_href")
    made = rows.withColumns({
        "id": F.col("url"), "source": F.lit(source), "source_url": F.col("url"),
        "title": F.coalesce("_f.title", F.lit("Unknown title")),
        "company": t.first_filled(given, url_host("url")),
        "location": F.col("_f.location"), "description": d,
        "work_mode": normalize.work_mode("_f.location", d),
        "required_skills": normalize.skill_mentions(d),
        "responsibilities": F.slice(t.bullets_or_sentences(d), 1, 6),
        "domain_signals": normalize.domain_signals(d),
        "language_requirements": normalize.language_requirements(d),
        "application_url": F.when(apply_href.isNotNull(), join_url("url", apply_href)).otherwise(F.col("url")),
        "raw_payload": F.to_json(F.struct(
            F.length("html").alias("html_length"),
            *[c.alias(n) for n, c in (payload or {}).items()])),
    })
    keep = [c for c in pages.columns if c not in S.POSTING.names and c != "html"]
    return normalize.normalize_postings(S.conform(made, S.POSTING, keep=keep))


def card_postings(
    pages: DataFrame, details: DataFrame, card: str, title: str | None = None, link: str | None = None
) -> DataFrame:
    """One posting per card of a listing page, read from its detail page where the link differs.

    Extra columns of `pages` are kept, but for those called like the new ones (`ord`, `page_url`).
    """
    made = {"html", "ord", "page_url", "c", "target", "_card_title"}
    cards = pages.select(
        *[c for c in pages.columns if c not in made],
        F.posexplode(page_cards(F.col("html"), card, title, link)).alias("ord", "c"))
    target = F.when(F.col("c.href").isNotNull(), join_url("url", "c.href")).otherwise(F.col("url"))
    cards = cards.withColumns({"page_url": F.col("url"), "target": target})
    found = cards.join(details.select(F.col("url").alias("target"), "html"), "target", "left")
    own = F.concat(F.lit("<div>"), t.text_or_empty("c.text"), F.lit("</div>"))
    rows = found.withColumns({
        "url": F.col("target"),
        "html": F.when(F.col("target") == F.col("page_url"), own).otherwise(F.coalesce("html", F.lit(""))),
        "_card_title": F.col("c.title")}).drop("c", "target")
    posted = page_postings(rows)
    named = F.when((F.col("title") == "Unknown title") & F.col("_card_title").isNotNull(), F.col("_card_title"))
    return posted.withColumn("title", F.coalesce(named, "title")).drop("_card_title")


def looks_like_posting() -> Column:
    """No listing-page title, at least 120 characters, some job word."""
    title, text = t.strip(F.lower(F.col("title"))), F.lower(t.text_or_empty("description"))
    hints = V.URL_JOB_HINTS + V.POSTING_WORD_HINTS
    return (
        ~title.isin(V.LISTING_PAGE_TITLES) & (F.length(text) >= 120)
        & (t.contains_any(text, hints) | t.contains_any(title, hints))
    )


def career_site_postings(
    sites: DataFrame, pages: DataFrame, sitemaps: DataFrame | None = None, method: str | None = None
) -> DataFrame:
    """Crawl, candidate pages, postings that look like one; distinct by url per site.

    `sites`: (site, company, url, seed_urls, include, exclude, max_pages). `sitemaps` holds
    (site, ord, loc) and counts only for sites whose crawl found nothing.
    """
    _, found = crawl_sites(sites, link_table(pages))
    candidates = found.select("site", "url", F.struct("visit", "pos").alias("at"))
    if sitemaps is not None:
        rules = sites.select("site", "include", "exclude")
        extra = (
            sitemaps.join(candidates.select("site").distinct(), "site", "left_anti").join(rules, "site")
            .where(is_candidate_url("loc", F.col("include"), F.col("exclude")))
            .groupBy("site", F.col("loc").alias("url"))
            .agg(F.min(F.struct(F.lit(0).cast("long").alias("visit"), F.col("ord").cast("int").alias("pos"))).alias("at"))
        )
        candidates = candidates.unionByName(extra)
    site = sites.select("site", t.first_filled("company", "site").alias("company"), F.col("url").alias("discovery_url"))
    rows = candidates.join(pages.where(F.coalesce("html", F.lit("")) != ""), "url").join(site, "site")
    payload = {"custom_page_name": F.col("site"), "discovery_url": F.col("discovery_url")}
    if method:
        payload["discovery_method"] = F.lit(method)
    postings = page_postings(rows, "custom_career_pages", payload).where(looks_like_posting())
    return first_per_key(postings, ["site", "source_url"], ["at"])
