"""Companies, boards and crawling, bound to the hosts of the pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from rolescope import fixed_values as V
from rolescope.functions import text as t
from rolescope.functions.urls import page_links, url_host
from rolescope.operators import crawl, discovery as disc, query_generation, stats
from rolescope.settings import Settings
from rolescope.sources.pages import card_postings, career_site_postings
from workload import query, sql as q, tables as b
from workload.structuring import HINTS as JOB_WORDS, PIECES, TITLE_SQL

TITLE = "regexp_extract(html, '<title>([^<]*)</title>', 1)"
HOST = "regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)"
STOP = ", ".join(f"'{w}'" for w in V.NON_COMPANY_WORDS)
SUFFIX = "|".join(V.COMPANY_SUFFIXES)


def hits(spark, d):
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    return b.wide(spark, d, "pages").select(
        "page_id", title.alias("title"), F.col("url").alias("href"),
        F.regexp_extract("html", "<footer>([^<]*)</footer>", 1).alias("body"))


def clean_sql(x: str) -> str:
    c = f"trim(regexp_replace({x}, '\\s+', ' ', 'g'), ' -|–—:,.')"
    return (f"case when length({c}) between 2 and 80 and not regexp_matches({c}, '^[^\\p{{L}}]+$') and lower({c}) not in ({STOP}) "
            f"and not regexp_matches(lower({c}), '(jobs|careers|career)$') then {c} end")


def company_sql(x: str) -> str:
    safe = f"regexp_replace({x}, '[^\\x00-\\x7F]', '_', 'g')"
    return f"trim(regexp_replace(regexp_replace(regexp_replace({safe}, '(?i)\\b({SUFFIX})\\b', '', 'g'), '[^A-Za-z0-9\\s\\-&]', '', 'g'), '\\s+', ' ', 'g'))"


HITS = f"""hits as (select page_id, {TITLE} title, url, regexp_extract(html, '<footer>([^<]*)</footer>', 1) body from pages),
pieces as (select page_id, unnest(regexp_split_to_array(title, '[|\\-–—:•/]')) s from hits),
root as (select page_id, split_part(replace(lower({HOST}), 'www.', ''), '.', 1) r from hits),
phr as (select page_id, unnest(regexp_extract_all(regexp_replace(body, '[^\\x00-\\x7F]', '_', 'g'),
  '\\b([A-Z][A-Za-z0-9&\\-.]+(?:\\s+[A-Z][A-Za-z0-9&\\-.]+){{0,3}})\\b', 1)) s from hits),
names as (
  select {clean_sql('s')} s from pieces union all
  select case when length(r) >= 2 and r not in ({STOP}) and not regexp_matches(r, '^[0-9]+$') then r end from root union all
  select {clean_sql('s')} from phr),
companies as (select distinct {company_sql('s')} company from names where s is not null)"""


@query("company_extract", f"with {HITS} select company from companies where length(company) >= 2")
def company_extract(spark, d):
    return disc.extract_companies(hits(spark, d), seeds=[])


@query("company_normalize", f"""
with x as (select c_custkey, c_name || case c_nationkey % 4 when 0 then ' Systems GmbH' when 1 then '  & Sons, Inc.' when 2 then ' Technology Group AG' else '' end n from customer)
select c_custkey, {company_sql('n')} company from x""")
def company_normalize(spark, d):
    return _named(spark, d).select("c_custkey", disc.normalize_company(F.col("n")).alias("company"))


def _named(spark, d):
    tail = F.element_at(F.array(*[F.lit(x) for x in (" Systems GmbH", "  & Sons, Inc.", " Technology Group AG", "")]),
                        F.col("c_nationkey") % 4 + 1)
    return b.table(spark, d, "customer").select("c_custkey", F.concat("c_name", tail).alias("n"))


@query("slug_variants", f"""
with x as (select c_custkey, c_name || case c_nationkey % 4 when 0 then ' Systems GmbH' when 1 then '  & Sons, Inc.' when 2 then ' Technology Group AG' else '' end n from customer),
y as (select c_custkey, lower({company_sql('n')}) s from x),
v as (select c_custkey, [replace(s, ' ', '-'), replace(s, ' ', ''), replace(replace(s, '&', 'and'), ' ', '-'),
  replace(replace(s, '&', 'and'), ' ', ''), regexp_replace(s, '[^a-z0-9]', '', 'g')] vs from y)
select c_custkey, array_to_string(list_filter(vs, lambda w, i: w <> '' and list_position(vs, w) = i), '|') slugs from v""")
def slug_variants(spark, d):
    return _named(spark, d).select("c_custkey", F.array_join(disc.slug_variants(F.col("n")), "|").alias("slugs"))


LABEL = f"case when len(str_split({HOST}, '.')) > 3 then split_part({HOST}, '.', 2) else split_part({HOST}, '.', 1) end"
KIND = f"case when {HOST} like '%.com' then 'greenhouse' when {HOST} like '%.net' then 'lever' else 'ashby' end"
PROBES = f"""probes as (
  select {KIND} kind, {LABEL} slug, min(url) url, count(*) jobs_count, count(*) > 2 api_ok from pages group by 1, 2),
cos as (select distinct {LABEL} || ' Group' company, {LABEL} slug from pages)"""


def _label():
    host = url_host("url")
    parts = F.split(host, r"\.", -1)
    return F.when(F.size(parts) > 3, F.get(parts, F.lit(1))).otherwise(F.get(parts, F.lit(0)))


def probes(spark, d):
    host = url_host("url")
    kind = F.when(host.endswith(".com"), "greenhouse").when(host.endswith(".net"), "lever").otherwise("ashby")
    rows = b.wide(spark, d, "pages").groupBy(kind.alias("kind"), _label().alias("slug")).agg(
        F.min("url").alias("url"), F.count("*").alias("jobs_count"))
    return rows.withColumns({
        "api_ok": F.col("jobs_count") > 2, "status": F.lit(200), "api_status": F.when(F.col("jobs_count") > 2, 200)})


def companies(spark, d):
    return b.wide(spark, d, "pages").select(F.concat(_label(), F.lit(" Group")).alias("company")).distinct()


BEST = ", ".join(
    f"max(case when kind = '{k}' then p.slug end) {k}_slug, max(case when kind = '{k}' then url end) {k}_url, "
    f"max(case when kind = '{k}' then jobs_count end) {k}_jobs_count" for k in disc.BOARDS)


@query("best_probe", f"""
with {PROBES} select company, {BEST} from cos c left join probes p on p.slug = regexp_replace(c.slug, '[^A-Za-z0-9\\-&]', '', 'g') group by company""")
def best_probe(spark, d):
    rows = disc.best_probes(companies(spark, d), probes(spark, d))
    return rows.select("company", *[f"{k}_{c}" for k in disc.BOARDS for c in ("slug", "url", "jobs_count")])


def boards(spark, d):
    return disc.company_boards(companies(spark, d), probes(spark, d), ["th", "cheap"])


HINTS = " + ".join(f"contains(lower(company), '{k}')::INTEGER" for k in ["th", "cheap", *V.COMPANY_NAME_HINTS])


@query("company_boards", f"""
with {PROBES}, x as (select company, {BEST} from cos c left join probes p on p.slug = regexp_replace(c.slug, '[^A-Za-z0-9\\-&]', '', 'g') group by company)
select company, ({HINTS})::INTEGER relevance_score, greenhouse_url is not null has_greenhouse, lever_url is not null has_lever, ashby_url is not null has_ashby,
  (coalesce(greenhouse_jobs_count, 0) + coalesce(lever_jobs_count, 0) + coalesce(ashby_jobs_count, 0))::BIGINT total_jobs_count from x""")
def company_boards(spark, d):
    return disc.sort_companies(boards(spark, d)).select(
        "company", F.col("relevance_score").cast("int").alias("relevance_score"), "has_greenhouse", "has_lever",
        "has_ashby", F.col("total_jobs_count").cast("bigint").alias("total_jobs_count"))


@query("discovery_counts", f"""
with {PROBES}, x as (select company, {BEST} from cos c left join probes p on p.slug = regexp_replace(c.slug, '[^A-Za-z0-9\\-&]', '', 'g') group by company)
select count(*) candidate_company_count, count(greenhouse_url) greenhouse_hits, count(lever_url) lever_hits, count(ashby_url) ashby_hits,
  (select count(*) from pages) search_result_count from x""")
def discovery_counts(spark, d):
    return stats.discovery_counts(boards(spark, d), hits(spark, d))


WORDS = "list_filter(list_concat(domains, skills), lambda w: length(w) >= 3)[1:14]"
FIXED = ", ".join("'" + x.replace("'", "''") + "'" for x in V.DISCOVERY_QUERIES)


@query("discovery_metadata", f"""
with {q.PROFILES}, {PROBES}, x as (select company, {BEST} from cos c left join probes p on p.slug = regexp_replace(c.slug, '[^A-Za-z0-9\\-&]', '', 'g') group by company),
counts as (select count(*) candidate_company_count, count(greenhouse_url) greenhouse_hits, count(lever_url) lever_hits, count(ashby_url) ashby_hits,
  (select count(*) from pages) search_result_count from x),
told as (select count(*) search_warning_count, string_agg('no footer: ' || url, '|' order by page_id) search_warnings from pages where not contains(html, '<footer>')),
k as (select profile_id, role, {WORDS} ks from profiles), k2 as (select profile_id, unnest(ks) keyword, generate_subscripts(ks, 1) ki from k),
m as (select profile_id, string_agg(keyword || tail || region, '|' order by ki, ri, ti) made from k2, (values (1, 'Germany'), (2, 'Europe')) r(ri, region),
  (values (1, ' companies '), (2, ' jobs '), (3, ' company careers '), (4, ' robotics company '), (5, ' ai company ')) t(ti, tail) group by profile_id)
select k.profile_id, role profile_summary, array_to_string(ks, '|') keywords_used, 'Germany|Europe' regions_used,
  sha256(concat_ws('|', made, array_to_string([{FIXED}], '|'))) queries_used, counts.*, search_warning_count, coalesce(search_warnings, '') search_warnings
from k left join m using (profile_id), counts, told""")
def discovery_metadata(spark, d):
    keywords = query_generation.discovery_keywords(F.concat("domain_strengths", F.transform("skills", lambda s: s["name"])))
    regions = t.string_array(query_generation.discovery_regions(Settings()))
    asked = b.profiles(spark, d).select(
        "profile_id", F.get("role_families", F.lit(0)).alias("summary"), keywords.alias("keywords"), regions.alias("regions"),
        query_generation.discovery_queries(keywords, regions, 100_000).alias("queries"))
    warnings = b.wide(spark, d, "pages").where(~F.contains("html", F.lit("<footer>"))).select(
        F.col("page_id").alias("ord"), F.concat(F.lit("no footer: "), "url").alias("warning"))
    made = stats.discovery_metadata(asked, boards(spark, d), hits(spark, d), warnings)
    line = lambda c: F.array_join(c, "|").alias(c)
    return made.withColumns({"queries_used": F.sha2(F.array_join("queries_used", "|"), 256)}).select(
        "profile_id", "profile_summary", line("keywords_used"), line("regions_used"), "queries_used", line("search_warnings"), "search_warning_count",
        "candidate_company_count", "greenhouse_hits", "lever_hits", "ashby_hits", "search_result_count")


@query("board_slugs", f"""
with {PROBES}, x as (select slug, row_number() over (order by slug) ord from (select distinct slug from cos)),
g as (select * from (values ('greenhouse', 'extra'), ('lever', 'tionsh'), ('ashby', 'zz')) v(kind, slug)),
a as (select kind, slug, 0 p from g union all select kind, slug, 1 from probes where slug in (select slug from x))
select distinct kind, slug from a""")
def board_slugs(spark, d):
    rows = boards(spark, d).withColumn("ord", F.xxhash64("company"))
    given = spark.createDataFrame(
        [("greenhouse", "extra", 0), ("lever", "tionsh", 1), ("ashby", "zz", 2)], "kind string, slug string, ord long")
    return disc.board_slugs(rows, given).select("kind", "slug")


@query("diagnosis_summary", """
with s as (select 'u' || user_id source, count(*) filter (where value > 60) raw, count(*) filter (where value > 80) matched from events group by user_id),
s2 as (select *, raw - matched filtered from s),
f as (select 'u' || user_id source, arg_min(user_id, event_id) u, arg_min(value, event_id) v from events where event_type = 'error' group by user_id)
select s2.source, case
  when matched > 0 and filtered > 0 then 'Fetched ' || matched || ' jobs from ' || s2.source || ' (' || raw || ' raw jobs, filtered out ' || filtered || ' by queries)'
  when matched > 0 then 'Fetched ' || matched || ' jobs from ' || s2.source
  when raw > 0 then 'Fetched 0 jobs from ' || s2.source || ': got ' || raw || ' raw jobs, but all were filtered out by the generated queries'
  when u % 5 = 0 then 'Fetched 0 jobs from ' || s2.source || ': endpoint returned 404, which usually means a wrong board slug or the company is not using that ATS'
  when u % 5 = 1 then 'Fetched 0 jobs from ' || s2.source || ': endpoint returned 403 and blocked access'
  when u % 5 = 2 then 'Fetched 0 jobs from ' || s2.source || ': endpoint rate-limited the requests with 429'
  when u % 5 = 3 then 'Fetched 0 jobs from ' || s2.source || ': robots.txt disallowed fetching this source'
  when u % 5 = 4 then 'Fetched 0 jobs from ' || s2.source || ': request failed (' || u || ')'
  else 'Fetched 0 jobs from ' || s2.source || ': source returned no jobs or no source entries were configured' end summary
from s2 left join f using (source)""")
def diagnosis_summary(spark, d):
    events = b.table(spark, d, "events").withColumn("source", F.concat(F.lit("u"), "user_id"))
    counted = events.groupBy("source").agg(
        F.count_if(F.col("value") > 60).alias("raw_jobs_discovered"), F.count_if(F.col("value") > 80).alias("jobs_matched"))
    counted = counted.withColumn("jobs_filtered_out", F.col("raw_jobs_discovered") - F.col("jobs_matched"))
    code = F.element_at(F.array(F.lit(404), F.lit(403), F.lit(429), F.lit(None).cast("int"), F.lit(None).cast("int")),
                        (F.col("user_id") % 5 + 1).cast("int"))
    log = events.where("event_type = 'error'").select(
        "source", F.col("event_id").alias("ord"), code.alias("status_code"),
        F.when(F.col("user_id") % 5 == 3, "robots_blocked").otherwise("request_error").alias("kind"),
        F.col("user_id").cast("string").alias("message"))
    return stats.diagnosis_summary(counted, log)


@query("crawl_reach", """
with recursive edges as (select p.page_id src, c.page_id dst from pages p join pages c on c.page_id in (2 * p.page_id + 1, 2 * p.page_id + 2)),
r(node, depth) as (select min(page_id), 0 from pages union all select e.dst, r.depth + 1 from r join edges e on e.src = r.node)
select node, depth from r""")
def crawl_reach(spark, d):
    pages = b.table(spark, d, "pages").select("page_id")
    made = pages.select(F.col("page_id").alias("src"), F.explode(F.array(
        F.col("page_id") * 2 + 1, F.col("page_id") * 2 + 2)).alias("dst"))
    edges = made.join(pages.select(F.col("page_id").alias("dst")), "dst", "left_semi").select("src", "dst")
    return crawl.reachable(edges, pages.agg(F.min("page_id").alias("node")))


INCLUDE = {"all": ["/th", "/d"], "com": ["/th"], "net": ["/qu"], "org": []}
LISTED, EXCLUDE, MOST = "list=1", "ouble", 150
WALK = f"""raw as (select page_id, unnest(['all', regexp_extract(url, '^[a-z]+://[^/?#]*\\.([a-z]+)', 1)]) site, url, html,
  regexp_extract_all(html, '<a\\s[^>]*href="([^"]*)"', 1) xs from pages),
hrefs as (select page_id, site, 'https://www.' || site || '.example.org' root, generate_subscripts(xs, 1) - 1 pos, unnest(xs) x from raw),
every_link as (select page_id, site, pos, root || split_part(replace(x, '&amp;', '&'), '#', 1) link from hrefs),
own as (select link url, site, max(page_id) page_id, min(page_id * 1000 + pos) first_at, min(pos) = 0 leads from every_link group by all),
kinds as (select o.url, site, l.pos, l.link, not contains(lower(link), '{EXCLUDE}') fine,
  (contains(lower(link), '{LISTED}') or {' or '.join(f"(site = '{k}' and contains(lower(link), '{x}'))" for k, xs in INCLUDE.items() for x in xs)}) wanted
  from own o join every_link l using (page_id, site)),
nexts as (select url, list(link order by pos) links from (
  select url, link, min(pos) pos from kinds where fine and not wanted group by all) group by url),
ends as (select site, arg_min(url, first_at) a, list_sort(list(url) filter (leads)) seeds from own group by site),
walk(site, i, queue) as (
  select site, 0, list_concat([a], list_filter(seeds, lambda x: x <> a)) from ends union all
  select w.site, i + 1, list_concat(queue, list_filter(coalesce(n.links, []::VARCHAR[]), lambda x: not list_contains(queue, x)))
  from walk w left join nexts n on n.url = w.queue[i + 1] where i < len(queue) and i < {MOST}),
ways as (select site, arg_max(queue, i)[1:{MOST}] queue from walk group by site),
visited as (select site, unnest(queue) url, generate_subscripts(queue, 1) visit from ways),
met as (select v.site, k.link url, v.visit, k.pos from visited v join kinds k using (url) where k.fine and k.wanted),
candidates as (select site, url, visit from (
  select m.*, row_number() over (partition by m.site, m.url order by m.visit, m.pos) rn
  from met m left join visited o on o.site = m.site and o.url = m.url where o.visit is null or o.visit > m.visit) where rn = 1)"""


def _sites(spark, d):
    """One site with all pages and one per top domain. A page lies at the addresses that its links name; the last such page counts."""
    pages = b.wide(spark, d, "pages").select(
        "page_id", F.explode(F.array(F.lit("all"), F.regexp_extract("url", r"^[a-z]+://[^/?#]*\.([a-z]+)", 1))).alias("site"), "html")
    root = F.concat(F.lit("https://www."), "site", F.lit(".example.org/"))
    named = pages.withColumn("root", root).select("page_id", "site", F.posexplode(page_links("root", "html")).alias("pos", "url"))
    at = F.col("page_id") * 1000 + F.col("pos")
    named = named.groupBy("site", "url").agg(F.max("page_id").alias("page_id"), F.min(at).alias("first_at"), (F.min("pos") == 0).alias("leads"))
    pages = named.join(pages, ["site", "page_id"])
    includes = F.array(F.lit(LISTED))
    for site, patterns in INCLUDE.items():
        if patterns:
            includes = F.when(F.col("site") == site, F.array(F.lit(LISTED), *map(F.lit, patterns))).otherwise(includes)
    sites = pages.groupBy("site").agg(F.min_by("url", "first_at").alias("url"), F.array_sort(F.collect_set(F.when(F.col("leads"), F.col("url")))).alias("seed_urls")).select(
        "site", "url", F.lit(None).cast("string").alias("company"), "seed_urls", includes.alias("include"),
        F.array(F.lit(EXCLUDE)).alias("exclude"), F.lit(MOST).alias("max_pages"))
    return sites, pages


@query("crawl_sites", f"""with recursive {WALK}
select site, url, visit, 'page' kind from visited union all select site, url, visit, 'candidate' from candidates""")
def crawl_sites(spark, d):
    sites, pages = _sites(spark, d)
    visited, found = crawl.crawl_sites(sites, crawl.link_table(pages.select("url", "html")))
    return visited.select("site", "url", "visit", F.lit("page").alias("kind")).unionByName(
        found.select("site", "url", "visit", F.lit("candidate").alias("kind")))


@query("career_site_postings", f"""
with recursive {WALK},
listed as (select o.site, o.url || '?{LISTED}' url, o.page_id from own o where o.site not in (select site from candidates)
  and not contains(lower(o.url), '{EXCLUDE}')),
landed as (select c.site, c.url, o.page_id from candidates c join own o using (site, url) union all select * from listed),
x as (select l.site, l.url source_url, {TITLE_SQL} title, array_to_string({PIECES}, chr(10)) description
  from landed l join (select page_id, replace(html, '</footer>', ' Apply now.</footer>') html from pages) using (page_id)),
y as (select *, lower(description) h from x)
select site, source_url, title, sha256(description) description, a discovery_url from y join ends using (site)
where lower(title) not in ({", ".join(f"'{x}'" for x in V.LISTING_PAGE_TITLES)}) and length(description) >= 120
  and ({q.any_in('h', JOB_WORDS)} or {q.any_in('lower(title)', JOB_WORDS)})""")
def career_site_postings_q(spark, d):
    """Postings at the candidates of each crawl; a site whose crawl finds none takes those that its sitemap lists."""
    sites, pages = _sites(spark, d)
    # the invented prose holds no job word, so each page gets one
    pages = pages.withColumn("html", F.replace("html", F.lit("</footer>"), F.lit(" Apply now.</footer>")))
    extra = pages.withColumn("url", F.concat("url", F.lit("?" + LISTED)))
    listed = extra.select("site", F.col("page_id").alias("ord"), F.col("url").alias("loc"))
    landed = pages.select("url", "html").unionByName(extra.select("url", "html"))
    rows = career_site_postings(sites, landed, listed)
    return rows.select("site", "source_url", "title", F.sha2("description", 256).alias("description"),
                       F.get_json_object("raw_payload", "$.discovery_url").alias("discovery_url"))


CARD_ROOT = "https://www.all.example.org"


@query("card_postings", f"""
with d1 as (select page_id, unnest(regexp_extract_all(html, '<a\\s[^>]*href="([^"]*)"', 1)) x from pages),
details as (select '{CARD_ROOT}' || split_part(replace(x, '&amp;', '&'), '#', 1) url, max(page_id) detail from d1 group by all),
lists as (select page_id, regexp_extract_all(html, '<li><a href="([^"]*)">', 1) hrefs, regexp_extract_all(html, '<li><a href="[^"]*">([^<]*)</a></li>', 1) names from pages),
cards as (select page_id, generate_subscripts(names, 1) - 1 as ord, unnest(names) card, '{CARD_ROOT}' || replace(unnest(hrefs), '&amp;', '&') target from lists),
read as (select c.*, p.html from cards c left join details d on d.url = c.target left join pages p on p.page_id = d.detail)
select page_id, ord::INTEGER as ord, target source_url, case when html is null then card else {TITLE_SQL} end title, 'www.all.example.org' company,
  sha256(case when html is null then '' else array_to_string({PIECES}, chr(10)) end) description from read""")
def card_postings_q(spark, d):
    """Every page's navigation as the cards of a listing; a card's detail page is the page that lies at its link, where there is one."""
    _, placed = _sites(spark, d)
    details = placed.where(F.col("site") == "all").select("url", "html")
    listing = b.wide(spark, d, "pages").select("page_id", F.lit(CARD_ROOT + "/").alias("url"), "html")
    rows = card_postings(listing, details, "li", title="a")
    return rows.select("page_id", "ord", "source_url", "title", "company", F.sha2("description", 256).alias("description"))
