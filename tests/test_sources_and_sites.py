import json
from collections import deque

import pytest
from pyspark.sql import functions as F

from rolescope import schemas as S, sinks
from rolescope.functions.html import page_facts, selected_hrefs
from rolescope.functions.urls import in_scope, is_candidate_url, url_host
from rolescope.operators import crawl, discovery, forms, stats, structure
from rolescope.settings import Settings
from rolescope.sources import boards, files, pages
from rolescope.sources.manual import import_files


def put(folder, name, content):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(content if isinstance(content, str) else json.dumps(content), encoding="utf-8")
    return str(folder)


def test_greenhouse(spark, tmp_path):
    html = ("<p>Hybrid role with Python</p><h3>Requirements</h3><ul><li>C++</li></ul>"
            "<h2>Preferred qualifications</h2><p>SLAM</p>")
    path = put(tmp_path, "agile-robots.json", {"jobs": [
        {"id": 7, "title": "Engineer", "absolute_url": "", "url": "https://x/7", "location": {"name": "Berlin"},
         "content": html, "created_at": "2026-01-01"},
        {"id": 8, "title": "Other", "location": "Remote", "company_name": "Own Name", "content": "plain"}]})
    put(tmp_path, "empty.json", {"jobs": []})
    a, b = boards.read_greenhouse(spark, path).orderBy("ord").collect()
    assert (a.id, a.company, a.location, a.source_url, a.date_posted) == ("7", "Agile Robots", "Berlin", "https://x/7", "2026-01-01")
    assert a.work_mode == "hybrid" and "python" in a.required_skills and a.domain_signals == ["slam"]
    assert a.minimum_qualifications == ["C++"] and a.preferred_skills == ["SLAM"]
    assert json.loads(a.raw_payload)["id"] == 7
    assert (b.company, b.location, b.work_mode) == ("Own Name", "Remote", "remote")


def test_lever(spark, tmp_path):
    path = put(tmp_path, "3d-vision.json", [{
        "id": "a", "text": "Dev", "hostedUrl": "https://l/a", "categories": {"location": "On-site Munich", "team": "T"},
        "descriptionPlain": "Salary EUR 50,000", "lists": [
            {"text": "Responsibilities", "content": "<li>Ship</li>"}, {"text": "Requirements", "content": "Rust"},
            {"text": "Preferred", "content": "Go"}]}])
    r = boards.read_lever(spark, path).first()
    assert (r.company, r.title, r.work_mode, r.salary.minimum) == ("3D Vision", "Dev", "onsite", 50000.0)
    assert r.responsibilities == ["<li>Ship</li>"] and r.minimum_qualifications == ["Rust"] and r.preferred_skills == ["Go"]
    assert r.application_url == "https://l/a" and "Ship" in r.description


def test_ashby(spark, tmp_path):
    path = put(tmp_path, "acme.json", {"jobs": [{
        "jobId": "j1", "jobTitle": "ML", "jobUrl": "https://a/1", "locationName": "Paris", "descriptionHtml": "<b>x</b> y",
        "jobPostSections": [{"content": "<p>more</p>"}], "publishedAt": "2026"}]})
    r = boards.read_ashby(spark, path).first()
    assert (r.id, r.title, r.company, r.location, r.application_url, r.date_posted) == ("j1", "ML", "Acme", "Paris", "https://a/1", "2026")
    assert r.description == "x\ny\nmore"


def test_postings_json_and_csv(spark, tmp_path):
    good = {"id": "1", "source": "m", "source_url": "u", "title": "T", "company": "C", "required_skills": ["A", " a "],
            "raw_payload": {"k": 1}}
    put(tmp_path / "j", "list.json", [good, {"id": "2", "title": "no company"}])
    put(tmp_path / "j", "one.json", {**good, "id": "3", "work_mode": "beach"})
    rows = {r.id: r for r in files.read_postings_json(spark, str(tmp_path / "j")).collect()}
    assert rows["1"].violations == [] and rows["1"].required_skills == ["A"] and json.loads(rows["1"].raw_payload) == {"k": 1}
    assert set(rows["2"].violations) == {"source missing", "source_url missing", "company missing"}
    assert rows["3"].violations == ["work_mode invalid"]
    put(tmp_path / "c", "p.csv", "title,company,source_url,required_skills,description\n"
        "Dev,,https://u/1,python | rust|, Remote job\n")
    r = files.read_postings_csv(spark, str(tmp_path / "c")).first()
    assert (r.id, r.company, r.source, r.work_mode) == ("https://u/1", "Unknown company", "manual_import", "remote")
    assert r.required_skills == ["python", "rust"] and r.application_url == "https://u/1"


def test_rss(spark, tmp_path):
    path = put(tmp_path, "feed.xml", "<rss><channel><title>c</title><item><title> SLAM dev </title><description>Hybrid python</description>"
               "<link>https://r/1</link><pubDate>Mon</pubDate></item><item><title>No link</title></item></channel></rss>")
    a, b = sorted(files.read_rss(spark, path).collect(), key=lambda r: r.title, reverse=True)
    assert (a.title, a.source_url, a.company, a.work_mode, a.date_posted) == ("SLAM dev", "https://r/1", "RSS Import", "hybrid", "Mon")
    assert b.title == "No link" and b.source_url.endswith("feed.xml")


def test_labeled_text_and_files(spark, tmp_path):
    text = "Title: Vision Dev\nCompany:  Acme\nLocation: Berlin\nDescription: Build things.\n\n- python\nCompany: Other\nignored"
    put(tmp_path, "a.txt", "﻿" + text)
    put(tmp_path, "b.md", "# My role\nPlain text with remote work")
    put(tmp_path, "c.json", {"listing": {"id": "9", "source": "s", "source_url": "u", "title": "T", "company": "C"}})
    put(tmp_path, "d.json", {"job_title": "Loose", "note": "rust"})
    rows = {r.file.rsplit("/", 1)[1]: r for r in files.read_posting_files(spark, str(tmp_path)).collect()}
    a = rows["a.txt"]
    assert (a.title, a.company, a.location, a.description) == ("Vision Dev", "Other", "Berlin", "Build things.\n\n- python")
    assert a.id.startswith("manual-") and len(a.id) == 23 and a.responsibilities == ["python"] and a.source == "manual_file"
    assert rows["b.md"].title == "My role" and rows["b.md"].work_mode == "remote" and rows["b.md"].company == "Unknown company"
    assert rows["c.json"].id == "9" and rows["d.json"].title == "Loose" and rows["d.json"].source == "manual_json"
    assert "rust" in rows["d.json"].required_skills


def test_claims(spark, tmp_path):
    path = put(tmp_path, "claims.txt", "﻿- First claim\n\n# note\n  * Second\n")
    assert [r.claim for r in files.read_claims(spark, path).orderBy("ord").collect()] == ["First claim", "Second"]


def test_profile_files(spark, tmp_path):
    main = tmp_path / "main.md"
    main.write_text("﻿# Jo Doe\n\nApplied engineer\n\n## Experience\n\n### Dev | Acme | 2020 - 2022\n- Led Python work\n"
                    "## Projects\n\n### Demo\nUses OpenCV https://x.org/publication\n## Education\n\n### MSc | Uni | 2019\n- note")
    extra = tmp_path / "extra.md"
    extra.write_text("## Skills\nPython, SLAM")
    listed = spark.createDataFrame([("me", 0, str(main)), ("me", 1, str(extra))], "profile_id string, ord int, path string")
    p = structure.structure_profiles(files.read_profile_docs(spark, str(tmp_path), listed)).first()
    assert (p.name, p.headline, p.summary) == ("Jo Doe", "Applied engineer", "Applied engineer")
    job, project, school = p.work_experience[0], p.projects[0], p.education[0]
    assert (job.title, job.company, job.start_date, job.end_date) == ("Dev", "Acme", "2020", "2022")
    assert "python" in job.technologies and project.links == ["https://x.org/publication"] and "opencv" in project.technologies
    assert (school.degree, school.institution, school.date_range, school.notes) == ("MSc", "Uni", "2019", ["note"])
    counts = {s.name: (s.category, s.evidence_count) for s in p.skills}
    assert counts["python"] == ("programming_languages", 2) and p.publications == ["https://x.org/publication"]
    assert p.source_files == [str(main), str(extra)] and "slam" in p.domain_strengths and p.seniority_hint is None
    insights = spark.createDataFrame([("me", '{"summary": "New", "industries": ["Space"]}')], "profile_id string, payload string")
    base = structure.structure_profiles(files.read_profile_docs(spark, str(tmp_path), listed))
    merged = structure.apply_insights(base, structure.insights_from_payload(insights, base)).first()
    assert merged.summary == "New" and merged.industries[-1] == "Space" and merged.skills == p.skills
    pack = sinks.keyword_pack(base).collect()
    assert ("Summary", "Applied engineer") in {(r.section, r.value) for r in pack}


DETAIL = ('<html><head><title>t</title><style>p{}</style></head><body><h1>Perception Engineer</h1><p class="job-Location">Berlin</p>'
          '<p>Work on slam ' + "and cameras " * 12 + '</p><script>var x;</script><a href="/apply?x=1">Apply <b>now</b></a>'
          '<a href="go">Apply here</a></body></html>')


def test_page_posting(spark):
    df = spark.createDataFrame([("https://h.org/jobs/1", DETAIL)], "url string, html string")
    r = pages.page_postings(df).first()
    assert (r.title, r.location, r.company, r.application_url) == ("Perception Engineer", "Berlin", "h.org", "https://h.org/jobs/go")
    assert "var x" not in r.description and "p{}" not in r.description and "slam" in r.domain_signals
    assert pages.page_postings(df).where(pages.looks_like_posting()).count() == 1
    listing = DETAIL.replace("Perception Engineer", "Stellenangebote")
    df = spark.createDataFrame([("https://h.org/jobs/1", listing)], "url string, html string")
    assert pages.page_postings(df).where(pages.looks_like_posting()).count() == 0


def test_section_lists_follow_headings(spark):
    html = "<h3>Requirements</h3><ul><li>A</li><li>B</li></ul><h3>Other</h3><p>no</p><b>What you'll do</b><p>x</p>"
    f = spark.range(1).select(page_facts(F.lit(html)).alias("f")).first().f
    assert f.minimum_qualifications == ["A B", "A", "B"] and f.responsibilities == ["x"]


def test_cards(spark):
    listing = ('<div class="card"><h4>One</h4><a href="/d/1">go</a></div><div class="card"><h4>Two</h4></div>')
    site = spark.createDataFrame([("https://h.org/list", listing, "Acme")], "url string, html string, company string")
    details = spark.createDataFrame([("https://h.org/d/1", "<p>no title here</p>")], "url string, html string")
    rows = {r.source_url: r for r in pages.card_postings(site, details, "div.card", "h4").collect()}
    assert rows["https://h.org/d/1"].title == "One" and rows["https://h.org/d/1"].company == "Acme"
    assert rows["https://h.org/list"].title == "Two"


def test_selected_links(spark):
    html = '<a class="m x" href="/j/1">a</a><a class="y" href="/j/2">b</a><a href="/job/3">c</a>'
    pick = lambda sel: spark.range(1).select(selected_hrefs(F.lit(html), sel).alias("x")).first().x
    assert pick("a.m") == ["/j/1"] and pick('a[href*="/job/"]') == ["/job/3"] and pick("a") == ["/j/1", "/j/2", "/job/3"]


def naive_crawl(site, graph):
    queue, seen, found = deque([site["url"], *site["seed_urls"]]), [], []
    host = site["url"].split("/")[2]
    while queue and len(seen) < site["max_pages"]:
        page = queue.popleft()
        if page in seen:
            continue
        seen.append(page)
        for link in graph.get(page, []):
            if link in seen:
                continue
            low = link.lower()
            bad = any(p in low for p in site["exclude"])
            if not bad and any(p in low for p in site["include"]):
                found.append(link)
            elif not bad and link.split("/")[2] == host:
                queue.append(link)
    return seen, list(dict.fromkeys(found))


@pytest.mark.parametrize("cap, span", [(1, 1024), (3, 2), (6, 1), (100, 1), (100, 1024)])
def test_crawl_equals_queue(spark, monkeypatch, cap, span):
    monkeypatch.setattr(crawl, "SPAN", span)
    u = lambda h, n: f"https://{h}.org/{n}"
    graph = {
        u("a", ""): [u("a", "p1"), u("a", "p2"), u("a", "jobs/1"), u("a", "p1"), u("a", "private/x")],
        u("a", "p1"): [u("a", "p3"), u("a", ""), u("a", "jobs/2"), u("a", "jobs/seed")],
        u("a", "p2"): [u("a", "p3"), u("a", "p4"), u("a", "jobs/1")], u("a", "p3"): [u("a", "p5"), u("a", "jobs/3")],
        u("a", "p4"): [u("a", "p1")], u("a", "jobs/1"): [u("a", "p9")], u("a", "jobs/seed"): [u("a", "p7"), u("a", "jobs/seed")],
        u("b", ""): [u("b", "x"), u("b", "y")], u("b", "x"): [u("b", "jobs/9")], u("b", "y"): [u("b", "jobs/9"), u("b", "")],
    }
    sites = [dict(site="A", url=u("a", ""), seed_urls=[u("a", "jobs/seed")], include=["/jobs/"], exclude=["private"], max_pages=cap),
             dict(site="B", url=u("b", ""), seed_urls=[], include=["/jobs/"], exclude=[], max_pages=cap)]
    table = spark.createDataFrame([(k, i, x) for k, v in graph.items() for i, x in enumerate(v)], "url string, pos int, link string")
    rules = spark.createDataFrame([tuple(s.values()) for s in sites],
                                  "site string, url string, seed_urls array<string>, include array<string>, exclude array<string>, max_pages int")
    visited, found = crawl.crawl_sites(rules, table)
    for s in sites:
        seen, urls = naive_crawl(s, graph)
        assert [r.url for r in visited.where(F.col("site") == s["site"]).orderBy("visit").collect()] == seen
        assert [r.url for r in found.where(F.col("site") == s["site"]).orderBy("visit", "pos").collect()] == urls


def test_career_site_with_links_and_with_sitemap(spark):
    land = '<a href="/jobs/1">x</a><a href="https://other.org/jobs/2">y</a>'
    pages_df = spark.createDataFrame(
        [("https://h.org/", land), ("https://h.org/jobs/1", DETAIL), ("https://s.org/", "<p>none</p>"), ("https://s.org/jobs/5", DETAIL)],
        "url string, html string")
    sites = spark.createDataFrame(
        [("H", None, "https://h.org/", [], ["/jobs/"], [], 10), ("Ess", "S Co", "https://s.org/", [], ["/jobs/"], [], 10)],
        "site string, company string, url string, seed_urls array<string>, include array<string>, exclude array<string>, max_pages int")
    xml = ('<?xml version="1.0"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc>https://s.org/jobs/5</loc></url>'
           '<url><loc>https://s.org/about</loc></url></urlset>')
    maps = files.sitemap_locations(
        spark.createDataFrame([("Ess", xml), ("H", "<urlset><url><loc>https://h.org/jobs/9</loc>")], "site string, xml string"), ["site"])
    assert {r.loc for r in maps.collect()} == {"https://s.org/jobs/5", "https://s.org/about"}
    rows = {r.site: r for r in pages.career_site_postings(sites, pages_df, maps).collect()}
    assert rows["H"].source_url == "https://h.org/jobs/1" and rows["H"].company == "H"
    assert rows["Ess"].source_url == "https://s.org/jobs/5" and rows["Ess"].company == "S Co"
    assert json.loads(rows["H"].raw_payload)["discovery_url"] == "https://h.org/"
    found = pages.career_site_postings(sites, pages_df, maps, method="site_filter")
    lines = [r.line for r in sinks.site_filtered_lines(sinks.site_filtered_rows(found), ["site"]).collect()]
    assert "- Discovery method: site_filter" in lines and sinks.discovered_rows(found).count() == 2


FORM = ('<label for="country">Country / Region</label><select id="country" name="country"><option></option><option>Germany</option>'
        '<option>Netherlands</option></select><label for="company">Company</label><select id="company" name="company" multiple="multiple">'
        '<option>KUKA</option><option>Swisslog</option></select><input id="search" name="q" type="search" placeholder="Search jobs" />'
        '<label>Remote <input type="checkbox" value="1"></label><input type="hidden" name="h">')


def test_form_fields_and_plans(spark):
    site = spark.createDataFrame([("https://h.org/", FORM)], "url string, html string")
    fields = forms.filter_fields(site)
    rows = fields.orderBy("ord").collect()
    assert [(r.type, r.semantic_kind, r.selector) for r in rows] == [
        ("select", "country_region", "#country"), ("multi_select", "company", "#company"), ("search", "search_text", "#search"),
        ("checkbox", "work_mode", None)]
    assert rows[0].options == ["Germany", "Netherlands"] and rows[3].options == ["1"]
    rules = spark.createDataFrame([("https://h.org/", "Swisslog AG", 4)], "url string, company string, max_plans int")
    queries = F.array(F.struct(F.lit("computer vision engineer germany").alias("text"), F.lit(None).cast("string").alias("title"),
                               F.array().cast("array<string>").alias("terms")))
    s = Settings(target_countries=["Germany"], job_titles=["Computer Vision Engineer"], include_keywords=["ml", "vision"])
    plans = [r.plan for r in forms.filter_plans(fields, rules, queries, s).orderBy("plan_ord").collect()]
    assert plans[0] == {"country_region": "Germany", "company": "Swisslog"} and len(plans) == 4
    assert plans[1] == {**plans[0], "search_text": "Computer Vision Engineer"}
    capped = forms.filter_plans(fields, rules.withColumn("max_plans", F.lit(2)), queries, s)
    assert capped.count() == 2


def test_render_urls(spark):
    got = spark.range(1).select(forms.render_urls(
        F.lit("https://k.com/de/"), F.array().cast("array<string>"), F.array(F.lit("/stellen/"), F.lit("/a/b/"))).alias("x")).first().x
    assert got == ["https://k.com/de/", "https://k.com/de/stellen"]


def test_url_rules(spark):
    df = spark.createDataFrame([("https://h.org/Jobs/1",), ("https://h.org/about",), ("https://x.org/jobs",)], "u string")
    got = df.select(is_candidate_url("u").alias("c"), in_scope("u", F.lit("h.org"), ["about"]).alias("s"), url_host("u").alias("h")).collect()
    assert [(r.c, r.s) for r in got] == [(True, True), (False, False), (True, False)]


def test_companies(spark):
    hits = spark.createDataFrame([
        ("NavVis GmbH | Jobs – 3D", "https://www.navvis.com/x", "We are Agile Robots Group and KUKA. Careers at Acme careers"),
        ("123 - ai", "https://jobs.lever.co/acme", None)], "title string, href string, body string")
    got = {r.company for r in discovery.extract_companies(hits, seeds=["Bosch"]).collect()}
    assert {"NavVis", "navvis", "3D", "Agile Robots", "Bosch", "KUKA Careers", "Acme"} >= got - {"We", "Careers"}
    assert "NavVis" in got and "Agile Robots" in got and "123" not in got
    one = lambda n: spark.createDataFrame([(n,)], "n string").select(discovery.slug_variants(F.col("n")).alias("s")).first().s
    assert one("Smith & Sons Systems GmbH") == ["smith-&-sons", "smith&sons", "smith-and-sons", "smithandsons", "smithsons"]
    assert one("GmbH") == []


def test_boards(spark):
    companies = spark.createDataFrame([("Agile Robots",), ("Nobody",)], "company string")
    probes = spark.createDataFrame([
        ("greenhouse", "agilerobots", "https://g/2", 200, 200, True, 9), ("greenhouse", "agile-robots", None, 404, 404, False, 0),
        ("lever", "agile-robots", None, 404, 200, True, 3)], S.PROBES)
    rows = {r.company: r for r in discovery.company_boards(companies, probes, ["robot"]).collect()}
    a, n = rows["Agile Robots"], rows["Nobody"]
    assert (a.greenhouse_slug, a.lever_slug, a.total_jobs_count, a.relevance_score) == ("agilerobots", "agile-robots", 12, 2)
    assert a.has_any_board and not n.has_any_board and n.total_jobs_count == 0
    assert json.loads(a.slug_variants) == ["agile-robots", "agilerobots"]


def test_summaries(spark):
    counted = spark.createDataFrame(
        [("a", 5, 2, 3), ("b", 5, 0, 5), ("greenhouse", 0, 0, 0), ("custom_career_pages", 0, 0, 0), ("n", 0, 0, 0), ("z", 0, 0, 0)],
        "source string, raw_jobs_discovered int, jobs_matched int, jobs_filtered_out int")
    log = spark.createDataFrame([("greenhouse", "u", 404, "", "request_error", 1), ("custom_career_pages", "u", 404, "", "request_error", 1),
                                 ("greenhouse", "u", 403, "", "request_error", 2)], S.FETCH_LOG)
    notes = spark.createDataFrame([("n", 0, "nothing configured")], "source string, ord int, note string")
    got = {r.source: r.summary for r in stats.diagnosis_summary(counted, log, notes).collect()}
    assert got["a"] == "Fetched 2 jobs from a (5 raw jobs, filtered out 3 by queries)" and "all were filtered out" in got["b"]
    assert "wrong board slug" in got["greenhouse"] and "optional discovery URL returned 404" in got["custom_career_pages"]
    assert got["n"].endswith("nothing configured") and "no source entries" in got["z"]


def test_manual_import_counts_and_notes(spark, tmp_path):
    job = lambda i, title: dict(id=str(i), source="manual", source_url=f"https://x/{i}", title=title, company="Co", description="Perception work")
    put(tmp_path, "in/a.json", [job(1, "Perception Engineer"), dict(job(2, "Cook"), description="Kitchen"), dict(job(3, "Perception Engineer"), source_url=None)])
    put(tmp_path, "in/one.JSON", job(4, "Perception Engineer"))
    put(tmp_path, "in/b.csv", 'id,title,company,source_url,required_skills\n5,Perception Engineer,Co,https://x/5,"python| |c++"\n6,Cook,Co,https://x/6,\n')
    put(tmp_path, "in/bad.json", "{no json")
    put(tmp_path, "in/n.txt", "text")
    queries = spark.createDataFrame(
        [(0, "perception engineer", "perception engineer", None, ["perception"])],
        "query_ord int, text string, title string, location string, terms array<string>")
    names = ["a.json", "one.JSON", "gone.csv", "b.csv", "n.txt", "bad.json", "a.json", "noend"]
    got = import_files(spark, str(tmp_path / "in"), names, queries)
    counts = {r.file_ord: (r.name, r.raw_jobs, r.matched_jobs, r.filtered_out_jobs) for r in got.counts.collect()}
    assert counts == {0: ("a.json", 2, 1, 1), 1: ("one.JSON", 1, 1, 0), 3: ("b.csv", 2, 1, 1), 5: ("bad.json", 0, 0, 0), 6: ("a.json", 2, 1, 1)}
    assert {(r.file_ord, r.note) for r in got.notes.collect()} == {
        (2, "configured manual file not found: gone.csv"), (4, "unsupported manual import file type: .txt"), (5, "no posting in bad.json"),
        (7, "configured manual file not found: noend"), (0, "1 rows of a.json break the schema"), (6, "1 rows of a.json break the schema")}
    rows = {(r.file_ord, r.id): r for r in got.postings.collect()}
    assert len(rows) == 7 and rows[3, "5"].required_skills == ["python", "c++"] and not rows[3, "6"].query_match.matched
    none = import_files(spark, str(tmp_path / "in"), [], queries)
    assert none.postings is None and none.counts.count() == 0 and [r.note for r in none.notes.collect()] == ["no manual import files were configured"]


def test_many_manual_files_are_read_by_folder(spark, tmp_path, monkeypatch):
    """Names from a table, more files than are read by name, and files that are not listed: the same rows, counts and notes."""
    from rolescope.sources import manual
    job = lambda i: dict(id=str(i), source="m", source_url=f"https://x/{i}", title="Perception Engineer", company="Co", description="")
    for i in range(4):
        put(tmp_path, f"in/sub/{i}.{'JSON' if i == 2 else 'json'}", dict(job(i), source_url=None) if i == 1 else job(i))
        put(tmp_path, f"in/{i}.csv", f"id,title,source_url\n{10 + i},Perception Engineer,https://x/{10 + i}\n")
    put(tmp_path, "in/0unlisted.csv", "title,id\nx,99\n")
    put(tmp_path, "in/unlisted.json", job(98))
    queries = spark.createDataFrame([(0, "perception engineer", ["perception"])], "query_ord int, text string, terms array<string>")
    names = ["sub/0.json", "sub/1.json", "sub/2.JSON", "sub/3.json", *(f"{i}.csv" for i in range(4)), "gone.json", "sub/0.json"]
    seen = lambda got: (sorted((r.file_ord, r.id, r.title, r.query_match) for r in got.postings.collect()), sorted(got.counts.collect()), sorted(got.notes.collect()))
    want = seen(import_files(spark, str(tmp_path / "in"), names, queries))
    monkeypatch.setattr(manual, "NAMED", 2)
    listed = spark.createDataFrame([(i, n) for i, n in enumerate(names)], manual.LISTED)
    got = import_files(spark, str(tmp_path / "in"), listed, queries)
    assert seen(got) == want and len(want[0]) == 8 and len(want[2]) == 3
