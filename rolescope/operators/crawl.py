"""Link reachability inside career sites, level by level."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window as W, functions as F

from rolescope.functions.urls import in_scope, is_candidate_url, page_links, url_host
from rolescope.plans.spread import first_per_key
from rolescope.session import cut_lineage, land

SPAN = 1024  # pages whose links are numbered together
COMPACT = 32  # levels kept as parts of their own before they are written as one


def _appended(parts: list[DataFrame], part: DataFrame) -> list[DataFrame]:
    """Levels as written parts: a level adds its own rows, and all rows are written again only once in COMPACT levels."""
    parts = [*parts, part]
    return parts if len(parts) < COMPACT else [cut_lineage(_whole(parts))]


def _whole(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def link_table(pages: DataFrame) -> DataFrame:
    """(url, pos, link) of every same-host link; pages without text have no row."""
    filled = pages.where(F.coalesce("html", F.lit("")) != "")
    return filled.select("url", F.posexplode(page_links("url", "html")).alias("pos", "link"))


def _queued(pages: DataFrame, done: DataFrame | None) -> DataFrame:
    """(site, url, visit): pages numbered after those done, in the order of (visit, pos) of the link that led there.

    A site's pages are counted per range of SPAN parents, map-side; a running sum over its ranges says where each
    range starts, ranges that start beyond max_pages go, and only the pages of one range are sorted together.
    """
    cut = pages.withColumn("_range", F.floor(F.col("visit") / SPAN).cast("long"))
    before = W.partitionBy("site").orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    offsets = cut.groupBy("site", "_range").agg(F.count("*").alias("_n")).select(
        "site", "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    if done is not None:
        offsets = offsets.join(done, "site").select("site", "_range", (F.col("_offset") + F.col("_done")).alias("_offset"))
    placed = cut.join(offsets, ["site", "_range"]).where(F.col("_offset") < F.col("max_pages"))
    inside = F.row_number().over(W.partitionBy("site", "_range").orderBy("visit", "pos"))
    return placed.withColumn("visit", (F.col("_offset") + inside).cast("long")).where(
        F.col("visit") <= F.col("max_pages")).select("site", "url", "visit")


def crawl_sites(sites: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Breadth-first walk of every site at once.

    `sites`: (site, url, seed_urls, include, exclude, max_pages). Returns visited pages
    (site, url, visit) and candidate pages (site, url, visit, pos), both in queue order.
    Candidates are recorded and not expanded; other pages in scope are expanded until a site has
    visited max_pages. Each level is one equi-join with the link table; the next level takes only
    as many pages per site as the site may still visit, and is written to the checkpoint folder.
    Null seeds count as none, a site without an address starts at its seeds, and a page without links ends there.
    """
    links = land(links.select("url", "pos", "link"), "links")  # pages are parsed once, not once per level
    rules = cut_lineage(sites.select("site", url_host("url").alias("host"), "include", "exclude", "max_pages"))
    start = sites.select("site", "max_pages", F.lit(0).cast("long").alias("visit"), F.posexplode(F.array_distinct(
        F.concat(F.array("url"), F.coalesce("seed_urls", F.array().cast("array<string>"))))).alias("pos", "url"))
    frontier = cut_lineage(_queued(start.where(F.col("url").isNotNull()), None))
    parts, found = [frontier], None
    while not frontier.isEmpty():  # ends, as a site visits max_pages at most
        visited = _whole(parts)
        seen = (
            frontier.join(links, "url").join(rules, "site")
            .select("site", "visit", "pos", F.col("link").alias("url"), "host", "max_pages",
                    is_candidate_url("link", F.col("include"), F.col("exclude")).alias("candidate"),
                    in_scope("link", F.col("host"), F.col("exclude")).alias("scoped"))
        )
        seen = cut_lineage(seen)
        hits = seen.where("candidate").select("site", "url", "visit", "pos")
        found = hits if found is None else found.unionByName(hits)
        at = F.min(F.struct("visit", "pos"))
        following = cut_lineage(
            seen.where("scoped AND NOT candidate")
            .groupBy("site", "url", "max_pages").agg(at.alias("_at"))
            .join(visited.select("site", "url"), ["site", "url"], "left_anti")
            .select("site", "url", "max_pages", "_at.*"))
        done = visited.groupBy("site").agg(F.max("visit").alias("_done"))
        frontier = cut_lineage(_queued(following, done))
        parts = _appended(parts, frontier)
    visited = _whole(parts)
    if found is None:
        found = visited.select("site", "url", "visit", F.lit(0).alias("pos")).limit(0)
    # a link to a page visited earlier in the queue is no candidate
    known = visited.select("site", "url", F.col("visit").alias("_own"))
    open_hits = found.join(known, ["site", "url"], "left").where(F.col("_own").isNull() | (F.col("_own") > F.col("visit")))
    candidates = first_per_key(open_hits.drop("_own"), ["site", "url"], ["visit", "pos"])
    return visited, candidates


def reachable(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(node, depth) of all nodes reachable from the seeds over (src, dst) edges."""
    frontier = cut_lineage(seeds.select("node").distinct().withColumn("depth", F.lit(0)))
    parts, level = [frontier], 0
    while True:
        level += 1
        following = frontier.join(edges, frontier["node"] == edges["src"]).select(F.col("dst").alias("node")).distinct()
        frontier = cut_lineage(
            following.join(_whole(parts), "node", "left_anti").withColumn("depth", F.lit(level)))
        if frontier.isEmpty():
            return _whole(parts)
        parts = _appended(parts, frontier)
