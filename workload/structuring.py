"""Headed documents, profiles and HTML pages."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from rolescope import fixed_values as V
from rolescope.functions import text as t, urls
from rolescope.functions.html import html_text, page_cards, page_facts
from rolescope.operators import forms, normalize, structure
from rolescope.sources import files, pages as page_sources
from workload import query, sql as q, tables as b

HEADED = f"""headed as (
  select doc_id, '# ' || {q.FIRST} || case when length(text) > length({q.FIRST}) + 1 then
    chr(10) || '- ' || replace(substr(text, length({q.FIRST}) + 2), chr(10), chr(10) || '- ') else '' end
    || chr(10) || '## ' || source || chr(10) || lang as body from documents),
lines as (select doc_id, unnest(str_split(body, chr(10))) line, generate_subscripts(str_split(body, chr(10)), 1) pos from headed),
flagged as (select *, regexp_matches({q.strip('line')}, '^#{{1,6}}\\s+.*$') head from lines),
grp as (select *, sum(case when head then 1 else 0 end) over (partition by doc_id order by pos) g from flagged),
secs as (
  select doc_id, g, max(case when head then {q.strip("regexp_extract(" + q.strip('line') + ", '^#{1,6}\\s+(.*)$', 1)")} end) heading,
    max(case when head then length(regexp_extract({q.strip('line')}, '^(#+)', 1)) end) lvl,
    {q.strip("string_agg(case when not head then line end, chr(10) order by pos)")} body, count(*) filter (where not head) n
  from grp group by doc_id, g)"""


@query("section_split", f"""
with {HEADED}
select doc_id, (row_number() over (partition by doc_id order by g) - 1)::INTEGER ord, coalesce(heading, 'Introduction') heading,
  coalesce(lvl, 1)::INTEGER as level, sha256(body) digest from secs where n > 0""")
def section_split(spark, d):
    docs = b.wide(spark, d, "documents").select("doc_id", b.headed_text().alias("text"))
    return structure.split_sections(docs, ["doc_id"]).select(
        "doc_id", "ord", "heading", "level", F.sha2("content", 256).alias("digest"))


@query("child_sections", """
select doc_id, source child, lang content from documents
where trim(split_part(text, chr(10), 1)) <> '' and length(text) > length(split_part(text, chr(10), 1)) + 1
  and contains(lower(split_part(text, chr(10), 1)), 'the')""")
def child_sections(spark, d):
    docs = b.wide(spark, d, "documents").select("doc_id", structure.sections(b.headed_text()).alias("s"))
    # the first section whose heading holds the word is the first line when it does
    rows = docs.where(F.contains(F.lower(F.get("s", F.lit(0))["heading"]), F.lit("the")))
    return rows.select("doc_id", F.explode(structure.child_sections(F.col("s"), ["the"])).alias("c")).select(
        "doc_id", F.col("c.heading").alias("child"), F.col("c.content").alias("content"))


@query("child_ranges", """
with p as (select o_orderkey, o_custkey, case o_orderstatus when 'F' then 1 when 'O' then 2 else 3 end lvl,
  row_number() over (partition by o_custkey order by o_orderkey) ord from orders),
firsts as (select o_custkey, min(ord) at_ord from p where lvl = 1 group by o_custkey),
ends as (select p.o_custkey, min(ord) stop from p join firsts f using (o_custkey) where ord > at_ord and lvl <= 1 group by p.o_custkey)
select p.o_custkey, p.o_orderkey from p join firsts f using (o_custkey) left join ends e using (o_custkey)
where ord > at_ord and ord < coalesce(stop, 1000000000) and lvl = 2""")
def child_ranges(spark, d):
    """The same rule on sections made from orders: level from the status, heading from the level."""
    level = F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 2).otherwise(3)
    rows = b.table(spark, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct(
        F.col("o_orderkey"), level.alias("level")))).alias("_o"))
    made = F.transform("_o", lambda o: F.struct(
        F.concat(F.lit("level "), o["level"]).alias("heading"), o["level"].alias("level"),
        o["o_orderkey"].cast("string").alias("content")))
    return rows.select("o_custkey", F.explode(structure.child_sections(made, ["level 1"])).alias("c")).select(
        "o_custkey", F.col("c.content").cast("bigint").alias("o_orderkey"))


@query("dated_heading", """
select p_partkey, trim(p_name) as "first", trim(p_brand) as "second", case when p_size % 2 = 0 then trim(p_type) end as "third",
  case when p_size % 2 = 0 and p_size % 3 = 0 then p_brand end as start_part,
  case when p_size % 2 = 0 and p_size % 3 = 0 then cast(p_size as varchar) end as end_part from part""")
def dated_heading(spark, d):
    heading = F.concat_ws(" | ", F.col("p_name"), F.col("p_brand"), F.when(F.col("p_size") % 2 == 0, F.col("p_type")))
    spans = F.when((F.col("p_size") % 2 == 0) & (F.col("p_size") % 3 == 0), F.concat("p_brand", F.lit(" to "), "p_size"))
    return b.table(spark, d, "part").withColumns({
        "h": structure.dated_heading(heading), "r": structure.date_range(spans)}).select(
            "p_partkey", "h.first", "h.second", "h.third", F.col("r.start").alias("start_part"), F.col("r.end").alias("end_part"))


def conversation_documents(spark, d):
    """One document per conversation: a headed text from its user turns."""
    rows = b.wide(spark, d, "conversations").where("role = 'user'")
    body = F.concat(F.lit("# Person "), "conv_id", F.lit("\n\n## Experience\n\n### Turn | Co | 2020 - 2021\n- "),
                    F.replace("text", F.lit("\n"), F.lit("\n- ")))
    parts = rows.select(
        F.col("conv_id").cast("string").alias("profile_id"), F.col("turn").alias("ord"),
        F.concat(F.lit("turn-"), "turn").alias("path"), body.alias("text"))
    return files.profile_documents(parts)


def conversation_profiles(spark, d):
    return structure.structure_profiles(
        conversation_documents(spark, d), b.SKILLS, b.DOMAINS, b.INDUSTRIES, {"inoran_orre": ["hehely ononst"]})


@query("profile_documents", """
select cast(conv_id as varchar) profile_id, count(*)::INTEGER n_files from conversations where role = 'user' group by conv_id""")
def profile_documents(spark, d):
    return conversation_documents(spark, d).select("profile_id", F.size("source_files").alias("n_files"))


RAW = """raw as (
  select cast(conv_id as varchar) profile_id, regexp_replace(string_agg('# Person ' || conv_id || chr(10) || chr(10) || '## Experience' || chr(10) || chr(10)
    || '### Turn | Co | 2020 - 2021' || chr(10) || '- ' || replace(text, chr(10), chr(10) || '- '), chr(10) || chr(10) order by turn),
    '^\\s+|\\s+$', '', 'g') raw_text
  from conversations where role = 'user' group by conv_id)"""


@query("structure_profiles", f"""
with {RAW}
select profile_id, 'Person ' || profile_id as name, array_to_string({q.mentions('raw_text', b.TERMS)}, '|') skills,
  array_to_string({q.parents('raw_text', b.DOMAINS)}, '|') domains, array_to_string({q.parents('raw_text', b.INDUSTRIES)}, '|') industries,
  case when contains(lower(raw_text), 'principal') then 'principal' when contains(lower(raw_text), 'staff') then 'staff'
    when contains(lower(raw_text), 'senior') then 'senior' when contains(lower(raw_text), 'lead') then 'lead'
    when contains(lower(raw_text), 'mid') then 'mid' when contains(lower(raw_text), 'junior') then 'junior'
    when contains(lower(raw_text), 'intern') then 'intern' end seniority,
  'Turn' job_title, 'Co' job_company, '2020' job_start, '2021' job_end
from raw""")
def structure_profiles(spark, d):
    rows = conversation_profiles(spark, d)
    job = F.get("work_experience", F.lit(0))
    return rows.select(
        "profile_id", "name", F.array_join(F.transform("skills", lambda s: s["name"]), "|").alias("skills"),
        F.array_join("domain_strengths", "|").alias("domains"), F.array_join("industries", "|").alias("industries"),
        F.col("seniority_hint").alias("seniority"), job["title"].alias("job_title"), job["company"].alias("job_company"),
        job["start_date"].alias("job_start"), job["end_date"].alias("job_end"))


@query("labeled_postings", f"""
with x as (select doc_id, source, lang, text, case when regexp_matches(split_part(text, chr(10), 1), '^(?i)\\s*(title|company|location|description)\\s*:') then 1 else 0 end odd from documents)
select cast(doc_id as varchar) doc_id, source title, 'Unknown company' company, lang location, sha256({q.strip('text')}) digest,
  'manual-' || left(sha256(source || chr(10) || 'Unknown company' || chr(10) || {q.strip('text')}), 16) id from x""")
def labeled_postings(spark, d):
    text = F.concat(F.lit("Title: "), "source", F.lit("\nLocation:  "), "lang", F.lit("\nDescription:\n"), "text")
    rows = b.wide(spark, d, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), text.alias("text"))
    return files.labeled_postings(rows).select(
        "doc_id", "title", "company", "location", F.sha2("description", 256).alias("digest"), "id")


@query("claim_lines", f"""
with l as (select cast(conv_id as varchar) conv_id, turn, {q.strip("unnest(str_split(text, chr(10)))")} claim,
  generate_subscripts(str_split(text, chr(10)), 1) pos from conversations)
select conv_id, turn, (pos - 1)::INTEGER ord, claim from l where claim <> ''""")
def claim_lines(spark, d):
    rows = b.table(spark, d, "conversations").select(
        F.col("conv_id").cast("string").alias("conv_id"), "turn",
        F.concat(F.lit("- "), F.replace("text", F.lit("\n"), F.lit("\n* "))).alias("text"))
    return files.claim_lines(rows, ["conv_id", "turn"])


@query("url_host", "select page_id, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) host, split_part(url, '#', 1) bare from pages")
def url_host(spark, d):
    return b.wide(spark, d, "pages").select(
        "page_id", urls.url_host("url").alias("host"), urls.drop_fragment("url").alias("bare"))


@query("candidate_urls", """
select page_id, not contains(lower(url), 'pills') and (contains(lower(url), '/en/') or contains(lower(url), 'page=2')) listed,
  not contains(lower(url), 'pills') and regexp_matches(lower(url), 'job|career|vacanc|opening|position|stellen') hinted from pages""")
def candidate_urls(spark, d):
    return b.wide(spark, d, "pages").select(
        "page_id", urls.is_candidate_url("url", ["/EN/", "page=2"], ["Pills"]).alias("listed"),
        urls.is_candidate_url("url", [], ["Pills"]).alias("hinted"))


@query("site_links", """
with l as (select page_id, url, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) href,
  generate_subscripts(regexp_extract_all(html, '<a href="([^"]*)"', 1), 1) pos from pages)
select page_id, (pos - 1)::INTEGER pos, split_part(regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || href, '#', 1) link from l
where href like '/%'""")
def site_links(spark, d):
    return b.wide(spark, d, "pages").select("page_id", F.posexplode(urls.page_links("url", "html")).alias("pos", "link"))


@query("join_url", """
with x as (select page_id, url, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) root, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) path from pages)
select page_id, root || '/jobs/a?b=1' rooted, 'https://other.example.com/x' abs, regexp_extract(url, '^([a-z]+):', 1) || '://cdn.example.com/y' proto,
  root || coalesce(nullif(regexp_extract(path, '^(.*/)', 1), ''), '/') || 'detail.html' rel from x""")
def join_url(spark, d):
    to = lambda h: urls.join_url("url", F.lit(h))
    return b.wide(spark, d, "pages").select(
        "page_id", to("/jobs/./x/../a?b=1").alias("rooted"), to("https://other.example.com/x").alias("abs"),
        to("//cdn.example.com/y").alias("proto"), to("detail.html").alias("rel"))


PIECES = """list_filter(list_transform(regexp_split_to_array(regexp_replace(html,
  '(?s)<!--.*?-->|<script[^>]*>.*?</script>|<style[^>]*>.*?</style>', '', 'g'), '<[^>]*>'),
  lambda x: regexp_replace(replace(replace(replace(replace(replace(replace(x, '&copy;', '©'), '&middot;', '·'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'),
  '^\\s+|\\s+$', '', 'g')), lambda x: x <> '')"""


@query("html_text", f"select page_id, array_to_string({PIECES}, chr(10)) as text from pages")
def html_text_q(spark, d):
    return b.wide(spark, d, "pages").select("page_id", html_text(F.col("html")).alias("text"))


@query("page_titles", """
select page_id, trim(regexp_replace(replace(replace(replace(replace(regexp_extract(html, '<h1>([^<]*)</h1>', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'),
  '^\\s+|\\s+$', '', 'g')) title from pages""")
def page_titles(spark, d):
    return b.wide(spark, d, "pages").select("page_id", page_facts(F.col("html")).title.alias("title"))


TITLE_SQL = """trim(regexp_replace(replace(replace(replace(replace(regexp_extract(html, '<h1>([^<]*)</h1>', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'),
  '^\\s+|\\s+$', '', 'g'))"""
HINTS = V.URL_JOB_HINTS + V.POSTING_WORD_HINTS


@query("page_postings", f"""
with x as (select page_id, url, {TITLE_SQL} title, array_to_string({PIECES}, chr(10)) as description from pages),
y as (select *, lower(description) h from x)
select page_id, url source_url, title, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) company, null as location, url application_url, sha256(description) description,
  case when contains(h, 'hybrid') then 'hybrid' when contains(h, 'remote') or contains(h, 'work from home') then 'remote'
    when contains(h, 'on-site') or contains(h, 'onsite') or contains(h, 'office') then 'onsite' else 'unknown' end work_mode,
  array_to_string({q.mentions('description', normalize.skill_terms())}, '|') skills, array_to_string({q.parents('description', V.DOMAINS, V.INDUSTRIES)}, '|') signals,
  array_to_string(list_filter({q.arr(V.LANGUAGES)}, lambda w: contains(h, w)), '|') languages,
  lower(title) not in ({", ".join(f"'{x}'" for x in V.LISTING_PAGE_TITLES)}) and length(description) >= 120
    and ({q.any_in('h', HINTS)} or {q.any_in('lower(title)', HINTS)}) is_posting
from y""")
def page_postings(spark, d):
    rows = page_sources.page_postings(b.wide(spark, d, "pages").select("page_id", "url", "html")).withColumn("is_posting", page_sources.looks_like_posting())
    line = lambda c: F.array_join(c, "|")
    return rows.select(
        "page_id", "source_url", "title", "company", "location", "application_url", F.sha2("description", 256).alias("description"), "work_mode",
        line("required_skills").alias("skills"), line("domain_signals").alias("signals"), line("language_requirements").alias("languages"), "is_posting")


@query("page_cards", """
with x as (select page_id, regexp_extract_all(html, '<li><a href="([^"]*)">', 1) hrefs, regexp_extract_all(html, '<li><a href="[^"]*">([^<]*)</a></li>', 1) names from pages)
select page_id, unnest(generate_series(0, len(names) - 1)) as ord, unnest(names) as title, unnest(hrefs) as href, unnest(names) as text from x""")
def page_cards_q(spark, d):
    """The entries of a page's navigation as cards."""
    rows = b.wide(spark, d, "pages").select("page_id", F.posexplode(page_cards(F.col("html"), "li", title="a")).alias("ord", "c"))
    return rows.select("page_id", "ord", "c.title", "c.href", "c.text")


@query("html_sections", """
with x as (select page_id, regexp_extract_all(html, '<li><a href="[^"]*">([^<]*)</a></li>', 1) names from pages),
y as (select page_id, case when page_id % 2 = 1 then list_concat(names, names) else names end words from x),
z as (select page_id, list_concat(['Requirements', array_to_string(words, ' ')], words[1:6]) texts from y)
select page_id, generate_subscripts(texts, 1) - 1 ord, unnest(texts) as text from z""")
def html_sections(spark, d):
    """A list of requirements made of a page's own words, longer than what counts on every other page, and a section after it."""
    i, words = F.col("page_id"), F.transform(F.regexp_extract_all("html", F.lit('<li><a href="[^"]*">([^<]*)</a></li>'), F.lit(1)),
                                             lambda w: F.concat(F.lit("<li>"), w, F.lit("</li>")))
    listed = F.array_join(F.when(i % 2 == 1, F.concat(words, words)).otherwise(words), "")
    made = F.concat(F.lit("<h3>Your <i>Requirements</i></h3><ul>"), listed, F.lit("</ul><h2>Other</h2><p>no</p><article>"))
    rows = b.wide(spark, d, "pages").withColumn("html", F.replace("html", F.lit("<article>"), made))
    return rows.select("page_id", F.posexplode(page_facts(F.col("html")).minimum_qualifications).alias("ord", "text"))


HOST_SQL = "regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)"


def _with_form(spark, d):
    """Pages with a search form made of their own host and number, so that forms differ by page."""
    i = F.col("page_id")
    host = F.regexp_extract("url", r"^[a-z]+://([^/?#:]*)", 1)
    options = F.array_join(F.transform(F.split(host, r"\.", -1), lambda x: F.concat(F.lit("<option> "), x, F.lit("</option>"))), "")
    opened = F.concat(F.lit("<select"), F.when(i % 5 == 0, " multiple").otherwise(""), F.lit(' name="country'), i, F.lit('"'))
    select = F.when(i % 2 == 1, F.concat(
        F.lit('<label for="c'), i, F.lit('">Region <i>'), host, F.lit("</i></label>"), opened, F.lit(' id="c'), i, F.lit('"><option></option>'), options,
        F.lit("</select>"))).otherwise(F.concat(F.lit("<label><b>Region</b> "), host, opened, F.lit(">"), options, F.lit("</select></label>")))
    search = (F.when(i % 3 == 0, F.concat(F.lit('<input name="q" type="Search" placeholder="Search jobs '), i, F.lit('">')))
              .when(i % 3 == 1, F.concat(F.lit('<input type="checkbox" name="remote" aria-label=" Remote jobs" value="v'), i, F.lit('">')))
              .otherwise('<input type="hidden" name="token"><select name="empty"><option> </option></select>'))
    return b.wide(spark, d, "pages").withColumn("html", F.replace("html", F.lit("<article>"), F.concat(F.lit("<form>"), search, select, F.lit("</form><article>"))))


@query("filter_fields", f"""
select page_id, 0 as ord, 'country' || page_id as name,
  'Region ' || {HOST_SQL} || case when page_id % 2 = 1 then '' else ' ' || replace({HOST_SQL}, '.', ' ') end label,
  case when page_id % 5 = 0 then 'multi_select' else 'select' end as type, 'country_region' semantic_kind,
  case when page_id % 2 = 1 then '#c' || page_id else 'select[name=''country' || page_id || ''']' end selector, replace({HOST_SQL}, '.', '|') options from pages
union all select page_id, 1, 'q', 'Search jobs ' || page_id, 'search', 'search_text', 'input[name=''q'']', '' from pages where page_id % 3 = 0
union all select page_id, 1, 'remote', 'Remote jobs', 'checkbox', 'work_mode', 'input[name=''remote'']', 'v' || page_id from pages where page_id % 3 = 1""")
def filter_fields(spark, d):
    return forms.filter_fields(_with_form(spark, d), ["page_id"]).select(
        "page_id", "ord", "name", "label", "type", "semantic_kind", "selector", F.array_join("options", "|").alias("options"))


@query("filter_plans", f"""
with x as (select page_id, str_split({HOST_SQL}, '.') options, page_id % 4 + 1 most from pages),
y as (select *, coalesce(list_filter(options, lambda o: contains(o, 'com') or contains('com', o))[1],
  list_filter(options, lambda o: contains(o, 'exam') or contains('exam', o))[1]) place from x),
z as (select page_id, place, list_concat([''], case when page_id % 3 = 0 then ['Vision Engineer', 'Vision', 'engineer'] else []::VARCHAR[] end)[1:most] terms from y),
u as (select page_id, place, unnest(terms) term, generate_subscripts(terms, 1) - 1 plan_ord from z)
select page_id, plan_ord, '{{"country_region":"' || place || '"' || case when term = '' then '' else ',"search_text":"' || term || '"' end || '}}' as plan from u""")
def filter_plans(spark, d):
    fields = forms.filter_fields(_with_form(spark, d), ["page_id"])
    sites = b.wide(spark, d, "pages").select("page_id", F.lit(None).cast("string").alias("company"), (F.col("page_id") % 4 + 1).cast("int").alias("max_plans"))
    asked = F.array(F.struct(F.lit("vision engineer").alias("text"), F.lit("Vision").alias("title"),
                             F.array(F.lit("vision"), F.lit("engineer")).alias("terms")))
    settings = type(b.SETTINGS)(target_countries=["com", "exam"], job_titles=["Vision Engineer"])
    plans = forms.filter_plans(fields, sites, asked, settings, key="page_id")
    return plans.select("page_id", "plan_ord", F.to_json(F.map_from_entries(F.array_sort(F.map_entries("plan")))).alias("plan"))


@query("option_match", """
with x as (select p_partkey, list_transform(str_split(p_type, ' '), lambda w: lower(w)) os, str_split(p_type, ' ') raw,
  [lower(split_part(p_name, ' ', 1)), 'po', 'brass', 's'] ws from part),
m as (select p_partkey, list_filter(flatten(list_transform(ws, lambda w: list_transform(list_filter(raw, lambda o:
  contains(lower(o), w) or contains(w, lower(o))), lambda o: o))), lambda o: o is not null) hits from x)
select p_partkey, hits[1] chosen from m""")
def option_match(spark, d):
    wanted = F.array(F.split_part(F.col("p_name"), F.lit(" "), F.lit(1)), F.lit("PO"), F.lit(" brass"), F.lit("s"))
    return b.table(spark, d, "part").select(
        "p_partkey", forms.first_option_match(F.split("p_type", " ", -1), wanted).alias("chosen"))


@query("sitemap_locations", """
select page_id, 0 ord, split_part(url, '#', 1) loc from pages""")
def sitemap_locations(spark, d):
    xml = F.concat(
        F.lit('<?xml version="1.0"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc> '),
        F.replace(urls.drop_fragment("url"), F.lit("&"), F.lit("&amp;")), F.lit(" </loc></url></urlset>"))
    return files.sitemap_locations(b.table(spark, d, "pages").select("page_id", xml.alias("xml")), ["page_id"])
