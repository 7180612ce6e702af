"""Scoring, ranking, freshness and deduplication."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from rolescope import fixed_values as V, sinks
from rolescope.functions import text as t
from rolescope.operators import dedupe, model_scorer, normalize, query_generation, ranking, scoring, state
from rolescope.operators.structure import apply_insights
from workload import query, sql as q, tables as b
from workload.tables import scratch


def _first_value(hay: str, values: dict) -> str:
    return "case " + " ".join(f"when contains({hay}, '{k}') then {v}" for k, v in values.items()) + " else 60 end"


def _norms(values: list[str]) -> list[str]:
    return [" ".join(v.lower().split()) for v in values]


S = b.SETTINGS
SCORES = f"""{q.POSTS}, {q.PROFILES},
pairs as (
  select posts.*, p.profile_id, p.skills p_skills, p.domains p_domains, p.industries p_industries, p.role,
         {q.norm('title')} title_n, {q.norm("title || ' ' || description")} body_n,
         list_filter(list_distinct([{', '.join("'" + x + "'" for x in _norms(S.target_titles))}, {q.norm('p.role')}]), lambda w: w <> '') titles,
         list_concat(list_transform(p.skills, lambda w: lower(w)), p.domains) held,
         list_concat(list_concat(p.domains, p.industries), [{', '.join("'" + x + "'" for x in S.include_keywords)}, {q.norm('p.role')}]) terms
  from posts join profiles p on p.profile_id = posts.source),
subs as (
  select *, case when list_contains(titles, title_n) then 100.0 when len(list_filter(titles,
           lambda e: contains(title_n, e) or contains(e, title_n))) > 0 then 88.0 else 0.0 end::DOUBLE title_s,
         case when len(skills) = 0 then 45.0::DOUBLE else round_even(100.0::DOUBLE * len(list_filter(skills,
           lambda w: list_contains(held, w))) / len(skills), 2) end skills_s,
         list_filter(list_distinct(list_concat(signals, [title_n])), lambda w: w <> '') own,
         greatest(0.0::DOUBLE, 100.0::DOUBLE - abs({b.SENIORITY[S.experience_level]} - {_first_value('lower(title)', b.SENIORITY)}) * 1.5) seniority_s,
         case when {q.any_in("lower(location)", [x.lower() for x in S.preferred_locations + S.search_locations])} then 90.0 when location = '' then 55.0 else 35.0 end::DOUBLE place_s,
         75.0::DOUBLE - case when {q.any_in(q.norm('description'), ['no sponsorship', 'must be authorized'])} then 30.0 else 0.0 end constraints_s,
         case when {q.any_in(q.norm("array_to_string(signals, ' ') || ' ' || description || ' ' || title"), [x.lower() for x in S.criteria_industries + S.search_industries])} then 10.0 else 0.0 end::DOUBLE bonus,
         (case when {q.norm('company')} in ({', '.join("'" + x + "'" for x in _norms(S.blacklist_companies))}) then 50.0 else 0.0 end
          + case when {q.any_in('body_n', _norms(S.exclude_keywords))} then 25.0 else 0.0 end
          + case when {q.any_in('body_n', b.UNRELATED)} then 35.0 else 0.0 end)::DOUBLE penalty,
         list_filter(skills, lambda w: not list_contains(held, w))[1:10] missing
  from pairs),
subs2 as (
  select *, case when len(own) = 0 then 40.0::DOUBLE else
    round_even(100.0::DOUBLE * len(list_filter(own, lambda w: list_contains(terms, w))) / len(own), 2) end domain_s from subs),
rules as (
  select *, greatest(0.0::DOUBLE, least(100.0::DOUBLE, round_even(title_s * 0.24::DOUBLE + skills_s * 0.26::DOUBLE + domain_s * 0.20::DOUBLE
    + seniority_s * 0.10::DOUBLE + place_s * 0.10::DOUBLE + constraints_s * 0.10::DOUBLE + bonus - penalty, 2))) rules_s from subs2)"""


def scored(spark, d):
    pairs = normalize.normalize_postings(b.postings(spark, d)).withColumn("profile_id", F.col("source"))
    prepared = scoring.prepare_profiles(b.profiles(spark, d), S, seniority=b.SENIORITY)
    return scoring.score_rules(pairs, prepared, S, b.UNRELATED, b.SENIORITY)


def _sub(name: str, column: str, sql_column: str) -> None:
    @query(name, f"with {SCORES} select id, {sql_column} score from rules")
    def fn(spark, d):
        return scored(spark, d).select("id", F.col(column).alias("score"))


_sub("title_score", "title_match_score", "title_s")
_sub("skills_score", "skills_overlap_score", "skills_s")
_sub("domain_score", "domain_match_score", "domain_s")
_sub("seniority_score", "seniority_fit_score", "seniority_s")
_sub("location_score", "location_fit_score", "place_s")
_sub("constraints_score", "constraints_fit_score", "constraints_s")
_sub("sector_bonus", "preferred_sector_bonus", "bonus")
_sub("mismatch_penalty", "mismatch_penalty", "penalty")


@query("missing_skills", f"with {SCORES} select id, array_to_string(missing, '|') missing from rules")
def missing_skills(spark, d):
    return scored(spark, d).select("id", F.array_join("missing_skills", "|").alias("missing"))


@query("rules_score", f"""
with {SCORES} select id, profile_id, rules_s rules_score,
  case when rules_s >= 78 then 'apply' when rules_s >= 55 then 'maybe' else 'skip' end disposition,
  coalesce(nullif(concat_ws(', ', case when title_s >= 80 then 'strong adjacent-title match' end,
    case when skills_s >= 50 then 'meaningful skill overlap' end, case when domain_s >= 50 then 'clear domain alignment' end,
    case when place_s >= 80 then 'location or work-mode fit' end), ''), 'some overlap with ' || title) why from rules""")
def rules_score(spark, d):
    return scored(spark, d).select(
        "id", "profile_id", F.col("rules_based_score").alias("rules_score"), "disposition", F.col("why_match").alias("why"))


@query("fit_label", f"""
with {SCORES}, l as (select id, case when rules_s >= 78 then 'realistic' when rules_s >= 55 then 'stretch' else 'poor_fit' end label from rules)
select id, label, case label when 'realistic' then 90.0 when 'stretch' then 65.0 else 25.0 end::DOUBLE value from l""")
def fit_label(spark, d):
    label = scoring.fit_label(F.col("rules_based_score"))
    return scored(spark, d).select("id", label.alias("label"), scoring.label_score(label).alias("value"))


def responses(spark, d):
    """Model labels as raw JSON answers: good documents are realistic, others poor fits."""
    rows = b.table(spark, d, "labels").join(b.table(spark, d, "documents").select("doc_id", "source"), "doc_id")
    label = F.when(F.col("quality") == 1, "realistic").otherwise("poor_fit")
    return rows.select(
        F.col("source").alias("profile_id"), F.col("doc_id").cast("string").alias("id"),
        F.to_json(F.struct(label.alias("fit_label"))).alias("payload"))


FUSED = f"""{SCORES},
prelim as (select *, round_even(rules_s * 0.80::DOUBLE + 0.0::DOUBLE * 0.20::DOUBLE, 2) prelim_s from rules),
short as (
  select * from (select profile_id, doc_id, row_number() over (partition by profile_id order by prelim_s desc, doc_id) rn
    from prelim where rules_s >= {S.label_min_rules_score}) where rn <= {S.label_top_n}),
fused as (
  select p.*, case when s.doc_id is not null and l.quality = 1 then 'realistic' when s.doc_id is not null and l.quality = 0 then 'poor_fit'
      when rules_s >= 78 then 'realistic' when rules_s >= 55 then 'stretch' else 'poor_fit' end label
  from prelim p left join short s using (profile_id, doc_id) left join labels l on l.doc_id = p.doc_id),
final as (
  select *, greatest(0.0::DOUBLE, least(100.0::DOUBLE, round_even(rules_s * 0.65::DOUBLE + 0.0::DOUBLE
    + (case label when 'realistic' then 90.0 when 'stretch' then 65.0 else 25.0 end)::DOUBLE * 0.15::DOUBLE, 2))) overall from fused),
ordered as (
  select *, case when overall >= 80 then 'apply' when overall >= 55 then 'maybe' else 'skip' end disposition,
         row_number() over (partition by profile_id order by overall desc, prelim_s desc, doc_id) rank from final)"""


@query("shortlist", f"with {FUSED} select profile_id, cast(doc_id as varchar) id from short")
def shortlist(spark, d):
    return ranking.shortlist(ranking.preliminary(scored(spark, d)), S)


@query("fuse_rank", f"with {FUSED} select profile_id, id, label fit_label, overall overall_score, disposition, rank from ordered")
def fuse_rank(spark, d):
    return ranking.rank_postings(scored(spark, d), S, responses(spark, d)).select(
        "profile_id", "id", "assessment.fit_label", "overall_score", "disposition", "rank")


@query("model_rank", f"with {FUSED} select profile_id, id, label fit_label, overall overall_score, disposition, rank from ordered")
def model_rank(spark, d):
    """The labels as answers of a client that gives up on every call with a poor fit among several rows."""
    def client(rows):
        if len(rows) > 1 and any("poor_fit" in (r["said"] or "") for r in rows):
            raise RuntimeError("busy")
        return [r["said"] for r in rows]

    said = responses(spark, d).withColumnRenamed("payload", "said")
    rows = scored(spark, d).join(said, ["profile_id", "id"], "left")
    ranked = model_scorer.rank_with_model(rows, client, ["title", "said"], scratch(spark, "answers"), S, parts=2, retries=1)
    return ranked.select("profile_id", "id", "assessment.fit_label", "overall_score", "disposition", "rank")


@query("top_matches", f"with {FUSED} select profile_id, id, overall overall_score, rank from ordered where rank <= 10")
def top_matches(spark, d):
    return ranking.top_ranked(scored(spark, d), 10, S, responses(spark, d)).select(
        "profile_id", "id", "overall_score", F.col("rank").cast("bigint").alias("rank"))


@query("top_match_lines", f"""
with {FUSED} select profile_id, rank, '- Score: ' || overall line from ordered where rank <= 20
union all select profile_id, rank, '## ' || rank || '. ' || title || ' @ ' || company from ordered where rank <= 20
union all select profile_id, rank, '- Missing skills: ' || coalesce(nullif(array_to_string(missing, ', '), ''), 'None flagged')
from ordered where rank <= 20""")
def top_match_lines(spark, d):
    ranked = ranking.rank_postings(scored(spark, d), S, responses(spark, d))
    lines = sinks.top_match_lines(ranked, 20).where(F.col("line_ord").isin(0, 1, 6))
    return lines.select("profile_id", "rank", "line")


CSV_MODE = """case when contains(h, 'hybrid') then 'hybrid' when contains(h, 'remote') or contains(h, 'work from home') then 'remote'
  when contains(h, 'on-site') or contains(h, 'onsite') or contains(h, 'office') then 'onsite' else 'unknown' end"""


@query("ranked_csv_rows", f"""
with {FUSED}, said as (
  select o.*, lower(coalesce(location, '') || ' ' || description) h, s.doc_id is not null and l.quality is not null answered
  from ordered o left join short s using (profile_id, doc_id) left join labels l on l.doc_id = o.doc_id)
select overall::VARCHAR overall_score, disposition, title, company, location, {CSV_MODE} work_mode, source, null::VARCHAR application_url,
  rules_s::VARCHAR rules_based_score, '0.0' embedding_similarity_score, '0.0' llm_latency_seconds, title_s::VARCHAR title_match_score,
  skills_s::VARCHAR skills_overlap_score, domain_s::VARCHAR domain_match_score, seniority_s::VARCHAR seniority_fit_score,
  place_s::VARCHAR location_fit_score, constraints_s::VARCHAR constraints_fit_score,
  case when answered then 'Potential fit for ' || title || '.' else 'Rules-based scoring indicates a ' || label || ' match for ' || title || '.' end why_match,
  array_to_string(missing, ' | ') missing_skills,
  case when answered then 'Highlight overlap with ' || coalesce(nullif(array_to_string(skills[1:3], ', '), ''), title) || '.'
    else 'Stress direct work on ' || coalesce(nullif(array_to_string(signals[1:2], ', '), ''), title) || '.' end recommended_resume_emphasis,
  case when answered then 'Explain why your background maps to ' || company || chr(39) || 's needs.'
    else 'Tie shipped results to ' || company || chr(39) || 's role scope.' end recommended_cover_letter_angle
from said""")
def ranked_csv_rows(spark, d):
    return sinks.ranked_csv_rows(ranking.rank_postings(scored(spark, d), S, responses(spark, d)))


@query("profile_posting_similarity", f"""
with {q.POSTS}, {q.PROFILES},
x as (select id, list_distinct({q.tokens("array_to_string(p.skills, ' ') || ' ' || array_to_string(p.domains, ' ') || ' ' || p.role")}) l,
  list_distinct({q.tokens("title || ' ' || description || ' ' || company || ' ' || array_to_string(posts.skills, ' ') || ' ' || array_to_string(signals, ' ')")}) r
  from posts join profiles p on p.profile_id = posts.source)
select id, round_even(100.0::DOUBLE * (case when len(l) = 0 or len(r) = 0 then 0 else len(list_intersect(l, r))::DOUBLE
  / (len(l) + len(r) - len(list_intersect(l, r))) end), 2) score from x""")
def profile_posting_similarity(spark, d):
    own = b.profiles(spark, d).select("profile_id", scoring.profile_text().alias("_own"))
    rows = b.postings(spark, d).withColumn("profile_id", F.col("source")).join(own, "profile_id")
    return rows.select("id", t.round_to(100.0 * t.text_jaccard(F.col("_own"), scoring.posting_text()), 2).alias("score"))


@query("cosine_topk", """
with e as (select label, unnest(embedding)::DOUBLE v, generate_subscripts(embedding, 1) i from embeddings),
m as (select label, i, avg(v) v from e group by label, i),
c as (select label, list(v order by i) vec from m group by label),
s as (select vec_id, c.label, round_even(greatest(0.0, least(1.0, list_cosine_similarity(list_transform(embedding, lambda x: x::DOUBLE), c.vec))), 4) sim
  from embeddings, c),
r as (select *, row_number() over (partition by vec_id order by sim desc, label) rn from s)
select vec_id, label, sim from r where rn <= 3""")
def cosine_topk(spark, d):
    """Each vector's three nearest label centroids."""
    vectors = b.wide(spark, d, "embeddings")
    cells = vectors.select("label", F.posexplode("embedding").alias("i", "v"))
    mean = cells.groupBy("label", "i").agg(F.avg(F.col("v").cast("double")).alias("v"))
    centroids = mean.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("_c")).select(
        "label", scoring.unit_vector(F.transform("_c", lambda x: x["v"])).alias("center"))
    all_centers = centroids.agg(F.collect_list(F.struct("label", "center"))).scalar()
    rows = vectors.withColumn("_u", scoring.unit_vector(F.col("embedding"))).withColumn("_all", all_centers)
    near = F.transform("_all", lambda c: F.struct(
        (-t.round_to(scoring.vector_similarity(F.col("_u"), c["center"]), 4)).alias("neg"), c["label"].alias("label")))
    return rows.select("vec_id", F.explode(F.slice(F.array_sort(near), 1, 3)).alias("n")).select(
        "vec_id", "n.label", F.abs("n.neg").alias("sim"))


@query("dedupe_postings", f"""
with x as (select source, lang id, {q.FIRST} url, doc_id, row_number() over (partition by source, lang, {q.FIRST} order by doc_id) rn from documents)
select source, id, url, doc_id from x where rn = 1""")
def dedupe_postings(spark, d):
    rows = b.wide(spark, d, "documents").select(
        "source", F.col("lang").alias("id"), b.first_line().alias("application_url"), F.lit("").alias("source_url"), "doc_id")
    return dedupe.dedupe_postings(rows, ["doc_id"]).select("source", "id", F.col("application_url").alias("url"), "doc_id")


@query("merge_by_url", f"""
with x as (select doc_id, {q.FIRST} url, lang from documents),
old as (select * from x where lang = 'en'),
new as (select *, row_number() over (partition by url order by doc_id) rn from x where lang <> 'en' and url not in (select url from old))
select doc_id, url from old union all select doc_id, url from new where rn = 1""")
def merge_by_url(spark, d):
    rows = b.wide(spark, d, "documents").select(F.col("doc_id").alias("ord"), b.first_line().alias("source_url"), "lang")
    merged = dedupe.merge_by_url(rows.where("lang = 'en'"), rows.where("lang <> 'en'"))
    return merged.select(F.col("ord").alias("doc_id"), F.col("source_url").alias("url"))


def near_dup_sql(threshold: float) -> str:
    """Rows in order; one goes if an earlier row that stays is near it. Only rows with a near one before them are walked."""
    return f"""
with recursive lines as (
  select item_id ord, text from benchmark union all select doc_id + 1000000, split_part(text, chr(10), 1) from documents),
r as materialized (select ord, {q.norm('text')} n, list_distinct({q.tokens('text')}) toks from lines),
words as materialized (select ord, len(toks) n, unnest(toks) w from r),
common as (select a.ord earlier, b.ord, a.n na, b.n nb, count(*) c from words a join words b on a.w = b.w and a.ord < b.ord group by all),
pairs as (
  select ord, earlier from common where c::DOUBLE / (na + nb - c) >= {threshold}
  union select b.ord, a.ord from r a join r b on a.n = b.n and a.ord < b.ord),
steps as materialized (select ord, list(earlier) before, row_number() over (order by ord) i from pairs group by ord),
walk(i, gone) as (
  select 0::BIGINT, []::BIGINT[] union all
  select s.i, case when len(list_filter(s.before, lambda x: not list_contains(w.gone, x))) > 0 then list_append(w.gone, s.ord) else w.gone end
  from walk w join steps s on s.i = w.i + 1),
dropped as (select unnest(gone) ord from walk where i = (select max(i) from walk))
select ord, text from lines anti join dropped using (ord)"""


def _near_dup(spark, d, threshold):
    """Benchmark items and document first lines, near-duplicates removed greedily in order."""
    items = b.table(spark, d, "benchmark").select(F.col("item_id").alias("ord"), "text")
    lines = b.wide(spark, d, "documents").select((F.col("doc_id") + 1_000_000).alias("ord"), b.first_line().alias("text"))
    return dedupe.near_duplicates(items.unionByName(lines), "text", "ord", threshold=threshold)


@query("near_dup_queries", near_dup_sql(0.82))
def near_dup_queries(spark, d):
    return _near_dup(spark, d, 0.82)


@query("near_dup_queries_loose", near_dup_sql(0.55))
def near_dup_queries_loose(spark, d):
    return _near_dup(spark, d, 0.55)


@query("latest_within_ttl", """
with r as (select user_id, event_id, ts, row_number() over (partition by user_id order by ts desc, event_id desc) rn
  from events where ts >= (select max(ts) from events) - interval 24 hour)
select user_id, event_id from r where rn = 1""")
def latest_within_ttl(spark, d):
    events = b.table(spark, d, "events")
    now = events.agg(F.max("ts")).scalar()
    return dedupe.latest_within_ttl(events, ["user_id"], "ts", now, 24, ["event_id"]).select("user_id", "event_id")


@query("changed_inputs", """
select d.doc_id from documents d left join labels l on l.doc_id = d.doc_id and l.quality = 1 where l.doc_id is null""")
def changed_inputs(spark, d):
    docs = b.wide(spark, d, "documents").select("doc_id", dedupe.fingerprint("source", "lang", "text").alias("fingerprint"))
    done = docs.join(b.table(spark, d, "labels").where("quality = 1").select("doc_id"), "doc_id", "left_semi")
    return dedupe.changed_inputs(docs, done, ["doc_id"]).select("doc_id")


@query("pending_inputs", """
with now as (select l_orderkey, sha256(concat_ws(chr(31), cast(sum(l_quantity)::BIGINT as varchar), cast(count(*) as varchar), '')) f from lineitem group by l_orderkey),
past as (select l_orderkey, sha256(concat_ws(chr(31), cast(sum(l_quantity)::BIGINT as varchar), cast(count(*) as varchar), '')) f from lineitem
  where l_returnflag <> 'R' group by l_orderkey),
made as (select o_orderkey from orders where o_orderpriority <> '1-URGENT')
select n.l_orderkey, case when p.f is null then 'new' when p.f <> n.f then 'changed' else 'lost' end reason
from now n left join past p using (l_orderkey) left join made m on m.o_orderkey = n.l_orderkey
where p.f is null or p.f <> n.f or m.o_orderkey is null""")
def pending_inputs(spark, d):
    """Orders finished before their returned lines came: some are new, some changed, of some the output is lost."""
    def orders(lines):
        return lines.groupBy("l_orderkey").agg(F.sum("l_quantity").cast("long").alias("q"), F.count("*").alias("n")).select(
            "l_orderkey", dedupe.fingerprint("q", "n").alias("fingerprint"))
    lines, folder = b.table(spark, d, "lineitem"), scratch(spark, "work-state")
    state.commit_state(orders(lines.limit(0)), folder)
    done = orders(lines.where("l_returnflag <> 'R'"))
    schema = done.schema.simpleString()[len("struct<"):-1].replace(":", " ")
    state.commit_state(state.with_finished(state.read_state(spark, folder, schema), done, ["l_orderkey"]), folder)
    made = b.table(spark, d, "orders").where("o_orderpriority <> '1-URGENT'").select(F.col("o_orderkey").alias("l_orderkey"))
    return state.pending_inputs(orders(lines), state.read_state(spark, folder, schema), made, ["l_orderkey"]).select("l_orderkey", "reason")


FRESH = """
with recursive kept(user_id, ts) as (
  select user_id, min(ts) from events group by user_id
  union all
  select k.user_id, (select min(e.ts) from events e where e.user_id = k.user_id and e.ts >= k.ts + interval 24 hour) nxt
  from kept k where k.ts is not null)
select user_id, epoch_us(ts) ts_us from kept where ts is not null"""


@query("fresh_requests", FRESH)
def fresh_requests(spark, d):
    kept = dedupe.fresh_requests(b.table(spark, d, "events"), ["user_id"], "ts", 24 * 3600.0)
    return kept.select("user_id", F.unix_micros("ts").alias("ts_us"))


def _insights(spark, d):
    p = b.profiles(spark, d)
    return p.select("profile_id", F.concat(F.lit("Works on "), F.array_join("domain_strengths", " and ")).alias("summary"),
                    F.array(F.lit("Applied role")).alias("role_families"),
                    F.array(F.lit("extra  word"), F.lit("Extra word")).alias("search_keywords"),
                    F.array(F.lit("TION"), F.lit("new domain")).alias("domain_strengths"), "industries",
                    F.lit(None).cast("string").alias("seniority_hint"))


@query("apply_insights", f"""
with {q.PROFILES}
select profile_id, 'Works on ' || array_to_string(domains, ' and ') summary,
  array_to_string(list_concat(case when trim(role) = '' then [] else [trim(role)] end, ['Applied role']), '|') roles,
  'extra  word' keywords, array_to_string(list_concat(domains, case when list_contains(domains, 'tion') then ['new domain']
  else ['TION', 'new domain'] end), '|') domains from profiles""")
def apply_insights_q(spark, d):
    rows = apply_insights(b.profiles(spark, d), _insights(spark, d))
    return rows.select("profile_id", "summary", F.array_join("role_families", "|").alias("roles"),
                       F.array_join("search_keywords", "|").alias("keywords"),
                       F.array_join("domain_strengths", "|").alias("domains"))


@query("keyword_pack", f"""
with {q.PROFILES}, x as (
  select profile_id, 'Role Families' section, [role] vs from profiles union all
  select profile_id, 'Domain Strengths', domains from profiles union all
  select profile_id, 'Industries', industries from profiles union all
  select profile_id, 'Skills', skills from profiles)
select profile_id, section, unnest(vs) as value, (generate_subscripts(vs, 1) - 1)::INTEGER ord from x""")
def keyword_pack(spark, d):
    return sinks.keyword_pack(b.profiles(spark, d)).select("profile_id", "section", "value", "ord")


def generated_sql(limit: int, order: str) -> str:
    """Combinations in order, then a walk over them that keeps what is not near to what was kept."""
    unique = lambda xs: f"list_filter({xs}, lambda w, i: w <> '' and list_position(list_transform({xs}, lambda y: {q.norm('y')}), {q.norm('w')}) = i)"
    return f"""
with recursive {q.PROFILES},
lists as (
  select profile_id, {unique(f"list_concat({q.arr(S.target_titles + S.job_titles)}, [role])")}[1:15] titles,
    {unique(f"list_concat(domains, {q.arr(S.include_keywords)})")}[1:8] domains, {unique("skills")}[1:6] skills,
    {q.arr(S.preferred_locations + S.search_locations)} places from profiles),
titles as (select *, unnest(titles) title, generate_subscripts(titles, 1) ti from lists),
made as (
  select profile_id, ti l, 0 a, 0 c, 0 e, title text, title, null place, 'exact title' why from titles
  union all select profile_id, ti, 1, generate_subscripts(domains, 1), 0, title || ' ' || unnest(domains), title, null, 'title + domain' from titles
  union all select profile_id, ti, 2, generate_subscripts(skills, 1), 0, title || ' ' || unnest(skills), title, null, 'title + skill' from titles
  union all select profile_id, ti, 3, generate_subscripts(places, 1), 0, title || ' ' || unnest(places), title, unnest(places), 'title + location' from titles
  union all select profile_id, 1000, ti, di, generate_subscripts(places, 1), title || ' ' || domain || ' ' || unnest(places[1:4]), title, unnest(places[1:4]), 'title + domain + location'
    from (select *, unnest(domains[1:6]) domain, generate_subscripts(domains[1:6], 1) di from titles where ti <= 10)
  union all select profile_id, 2000, unnest(generate_series(1, {len(V.BROADER_QUERIES)})), 0, 0, unnest({q.arr(V.BROADER_QUERIES)}), null, null, 'broader concept combination' from profiles),
placed as (select *, row_number() over (partition by profile_id, l order by a, c, e) j from made),
steps as materialized (select profile_id, text, title, place, why, {q.norm('text')} n, list_distinct({q.tokens('text')}) toks,
  row_number() over (partition by profile_id order by {order}) i from placed),
walk(profile_id, i, kept) as (
  select profile_id, 0::BIGINT, []::STRUCT(n VARCHAR, toks VARCHAR[], i BIGINT)[] from profiles union all
  select w.profile_id, s.i, case when len(w.kept) >= {limit} or len(list_filter(w.kept, lambda k: k.n = s.n or (len(k.toks) > 0 and len(s.toks) > 0
      and len(list_intersect(k.toks, s.toks))::DOUBLE / (len(k.toks) + len(s.toks) - len(list_intersect(k.toks, s.toks))) >= 0.82))) > 0
    then w.kept else list_append(w.kept, {{'n': s.n, 'toks': s.toks, 'i': s.i}}) end
  from walk w join steps s on s.profile_id = w.profile_id and s.i = w.i + 1),
last as (select profile_id, max_by(kept, i) kept from walk group by profile_id),
chosen as (select profile_id, unnest(kept).i i, generate_subscripts(kept, 1) - 1 query_ord from last)
select profile_id, query_ord, n as text, title, place location, 'en' as language, why rationale, array_to_string({q.tokens('n')}, '|') terms
from chosen join (select profile_id, i, regexp_replace(trim(text), '\\s+', ' ', 'g') n, title, place, why from steps) using (profile_id, i)"""


def _generated(spark, d, settings):
    rows = query_generation.generate_queries(b.profiles(spark, d), settings)
    return rows.withColumn("terms", F.array_join("terms", "|"))


@query("generate_queries", generated_sql(40, "l, j"))
def generate_queries(spark, d):
    return _generated(spark, d, S)


@query("generate_queries_in_turn", generated_sql(25, "j, l"))
def generate_queries_in_turn(spark, d):
    """The lists of the titles, the wider and the broader queries take turns, with room for fewer queries."""
    return _generated(spark, d, replace(S, query_order="round_robin", query_limit=25))


@query("expand_domains", f"""
with {q.PROFILES}, x as (select profile_id, list_concat(domains, ['robotics ai', 'slam']) ts from profiles)
select profile_id, array_to_string(list_concat(ts, ['visual slam', 'mapping', 'localization', 'odometry', 'robotics', 'autonomy', 'robot perception']), '|') terms from x""")
def expand_domains(spark, d):
    given = F.concat("domain_strengths", t.string_array(["robotics ai", "slam"]))
    return b.profiles(spark, d).select("profile_id", F.array_join(query_generation.expand_domains(given), "|").alias("terms"))


@query("discovery_queries", f"""
with {q.PROFILES}, k as (select profile_id, list_filter(list_concat(domains, skills), lambda w: length(w) >= 3)[1:14] ks from profiles),
k2 as (select profile_id, unnest(ks) keyword, generate_subscripts(ks, 1) ki from k),
m as (select profile_id, keyword, ki, r.ri, r.region, t.ti, t.tail, t.lead from k2,
  (values (1, 'Germany'), (2, 'Europe')) r(ri, region),
  (values (1, '', ' companies '), (2, '', ' jobs '), (3, '', ' company careers '), (4, '', ' robotics company '), (5, '', ' ai company ')) t(ti, lead, tail))
select profile_id, count(*) + 8 n, sha256(string_agg(keyword || tail || region, '|' order by ki, ri, ti)) digest from m group by profile_id""")
def discovery_queries(spark, d):
    words = F.concat("domain_strengths", F.transform("skills", lambda s: s["name"]))
    made = query_generation.discovery_queries(
        query_generation.discovery_keywords(words), t.string_array(query_generation.discovery_regions(type(S)())), 100_000)
    rows = b.profiles(spark, d).withColumn("q", made)
    return rows.select("profile_id", F.size("q").cast("bigint").alias("n"),
                       F.sha2(F.array_join(F.slice("q", F.lit(1), F.size("q") - 8), "|"), 256).alias("digest"))
