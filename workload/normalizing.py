"""Posting normalization and query matching."""

from __future__ import annotations

from pyspark.sql import functions as F

from rolescope import fixed_values as V
from rolescope.functions import text as t
from rolescope.operators import dedupe, normalize, query_match, stats
from rolescope.operators.query_generation import german_variants
from rolescope.session import land
from workload import query, sql as q, tables as b

SALARY_SQL = ("'Pay: EUR ' || cast(round(o_totalprice) as bigint) || ' - ' || "
              "cast(round(o_totalprice * 1.2) as bigint) || ' per year'")


@query("salary_parse", f"""
with o as (select o_orderkey, case when o_orderstatus = 'F' then 'Paid $' || cast(round(o_totalprice) as bigint) || 'k a year'
  when o_orderstatus = 'O' then {SALARY_SQL} else 'Industry ' || o_orderkey || '.0' end txt from orders),
m as (select o_orderkey, regexp_extract(txt, '(EUR|\\$)\\s*(\\d[\\d,]*(?:\\.\\d+)?)(?:\\s*-\\s*(\\d[\\d,]*(?:\\.\\d+)?))?', ['c', 'lo', 'hi']) g from o)
select o_orderkey, case g.c when '$' then 'USD' when '' then null else g.c end currency,
  try_cast(nullif(g.lo, '') as double) minimum, try_cast(nullif(g.hi, '') as double) maximum from m""")
def salary_parse(spark, d):
    o = b.table(spark, d, "orders")
    # rounding casts differ between engines, so the text is made from rounded values
    whole = lambda c: F.round(c, 0).cast("bigint").cast("string")
    price = F.col("o_totalprice")
    txt = (
        F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("Paid $"), whole(price), F.lit("k a year")))
        .when(F.col("o_orderstatus") == "O", F.concat(
            F.lit("Pay: EUR "), whole(price), F.lit(" - "), whole(price * 1.2), F.lit(" per year")))
        .otherwise(F.concat(F.lit("Industry "), "o_orderkey", F.lit(".0"))))
    s = o.select("o_orderkey", normalize.salary_range(txt).alias("s"))
    return s.select("o_orderkey", "s.currency", "s.minimum", "s.maximum")


@query("work_mode", """
with x as (select c_custkey, lower(concat_ws(' ', case c_nationkey % 4 when 0 then 'Hybrid' when 1 then 'Work from home'
  when 2 then 'Office' else '' end, c_mktsegment, c_name)) h from customer)
select c_custkey, case when contains(h, 'hybrid') then 'hybrid' when contains(h, 'remote') or contains(h, 'work from home') then 'remote'
  when contains(h, 'on-site') or contains(h, 'onsite') or contains(h, 'office') then 'onsite' else 'unknown' end work_mode from x""")
def work_mode(spark, d):
    place = F.element_at(F.array(*[F.lit(x) for x in ("Hybrid", "Work from home", "Office", "")]),
                         F.col("c_nationkey") % 4 + 1)
    return b.table(spark, d, "customer").select(
        "c_custkey", normalize.work_mode(place, "c_mktsegment", "c_name").alias("work_mode"))


@query("skill_mentions", f"""
select doc_id, array_to_string({q.mentions('text', b.TERMS)}, '|') skills from documents""")
def skill_mentions(spark, d):
    return b.wide(spark, d, "documents").select(
        "doc_id", F.array_join(normalize.skill_mentions("text", b.TERMS), "|").alias("skills"))


@query("domain_signals", f"""
select doc_id, array_to_string({q.parents('text', b.DOMAINS, b.INDUSTRIES)}, '|') signals from documents""")
def domain_signals(spark, d):
    return b.wide(spark, d, "documents").select(
        "doc_id", F.array_join(normalize.domain_signals("text", b.DOMAINS, b.INDUSTRIES), "|").alias("signals"))


@query("language_requirements", f"""
select doc_id, array_to_string(list_filter({q.arr(b.LANGUAGES)}, lambda w: contains(lower(text), w)), '|') languages from documents""")
def language_requirements(spark, d):
    return b.wide(spark, d, "documents").select(
        "doc_id", F.array_join(normalize.language_requirements("text", b.LANGUAGES), "|").alias("languages"))


def _first_case(hay: str, words: list[str]) -> str:
    return "case " + " ".join(f"when contains({hay}, '{w}') then '{w}'" for w in words) + " end"


@query("seniority_hint", f"select doc_id, {_first_case('lower(text)', V.SENIORITY_ORDER)} hint from documents")
def seniority_hint(spark, d):
    return b.wide(spark, d, "documents").select("doc_id", normalize.seniority_hint("text").alias("hint"))


CLEAN = """regexp_replace(trim(regexp_replace(regexp_replace({x}, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'),
  ' -*' || chr(9) || chr(13) || chr(10) || ':.;'), '^(requirements?|responsibilities|qualifications?|preferred|nice to have)\\s*[:\\-]\\s*', '', 'i')"""


@query("clean_requirement", f"""
with l as (select doc_id, unnest(str_split(text, chr(10))) s, generate_subscripts(str_split(text, chr(10)), 1) pos from documents),
c as (select doc_id, pos, {CLEAN.format(x="'<b>Requirements</b>: ' || s")} v from l)
select doc_id, pos::INTEGER pos, case when length(v) <= 180 then v else
  regexp_replace(regexp_replace(left(v, 180), ' [^ ]*$', ''), '[,;:]+$', '') end cleaned from c""")
def clean_requirement(spark, d):
    lines = b.wide(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("p", "s"))
    return lines.select(
        "doc_id", (F.col("p") + 1).alias("pos"),
        normalize.clean_requirement(F.concat(F.lit("<b>Requirements</b>: "), "s")).alias("cleaned"))


def _vague_text(n: str) -> str:
    return f"(case {n} % 4 when 0 then 'Good communication' when 1 then 'Strong collaboration' when 2 then 'C' else 'Build tools' end)"


def _vague_sql() -> str:
    vague = q.any_in("lower(r)", V.VAGUE_TERMS)
    strong = q.any_in("lower(r)", V.EMPHASIS_TERMS)
    paired = q.any_in("lower(dsc)", [f"{e} {v}" for e in V.EMPHASIS_TERMS for v in V.VAGUE_TERMS])
    return f"""
with x as (select o_orderkey, {_vague_text('o_orderkey')} r, case o_custkey % 3 when 0 then 'Excellent communication with C programming '
  when 1 then 'Embedded C++ work ' else 'Basic tools ' end || o_orderpriority dsc from orders)
select o_orderkey, (length(r) <= 1 and not (lower(r) = 'c' and regexp_matches(dsc,
  '(^|[^A-Za-z])C(\\s*(/|\\+\\+)|\\s+programming|\\s+language|[,\\.;:]|$)'))) noise, ({vague} and not {strong} and not {paired}) vague from x"""


@query("noise_and_vague_filter", _vague_sql())
def noise_and_vague_filter(spark, d):
    pick = lambda words, c, n: F.element_at(F.array(*[F.lit(w) for w in words]), (F.col(c) % n + 1).cast("int"))
    rows = b.table(spark, d, "orders").select(
        "o_orderkey", pick(["Good communication", "Strong collaboration", "C", "Build tools"], "o_orderkey", 4).alias("r"),
        F.concat(pick(["Excellent communication with C programming ", "Embedded C++ work ", "Basic tools "], "o_custkey", 3),
                 "o_orderpriority").alias("dsc"))
    return rows.select(
        "o_orderkey", normalize.is_noise_requirement(F.col("r"), F.col("dsc")).alias("noise"),
        normalize.is_vague_requirement(F.col("r"), t.normalize_text("dsc")).alias("vague"))


@query("normalize_postings", f"""
with {q.POSTS}
select id, case when contains(h, 'hybrid') then 'hybrid' when contains(h, 'remote') or contains(h, 'work from home') then 'remote'
  when contains(h, 'on-site') or contains(h, 'onsite') or contains(h, 'office') then 'onsite' else 'unknown' end work_mode,
  array_to_string(skills, '|') skills, array_to_string(signals, '|') signals
from (select *, lower(location || ' ' || description) h from posts)""")
def normalize_postings(spark, d):
    return normalize.normalize_postings(b.postings(spark, d)).select(
        "id", "work_mode", F.array_join("required_skills", "|").alias("skills"),
        F.array_join("domain_signals", "|").alias("signals"))


def _evaluated(spark, d, **options):
    return query_match.match_queries(b.postings(spark, d), b.queries(spark, d), ["ord"], **options)


BEST_COLUMNS = """doc_id, item_id best_query_ord, matched, round_even(total * 100, 2) score, round_even(jac_s, 4) similarity,
  title_s title_score, round_even(domain_s, 4) domain_score, round_even(overlap_s, 4) term_overlap,
  case when total >= 0.32 then 'passed threshold' else 'below threshold' end reason"""


@query("query_match_best", f"with {q.MATCH} select {BEST_COLUMNS} from best")
def query_match_best(spark, d):
    m = F.col("query_match")
    return _evaluated(spark, d).select(
        F.col("ord").alias("doc_id"), m["query_ord"].alias("best_query_ord"), m["matched"].alias("matched"),
        m["best_query_score"].alias("score"), m["best_query_similarity"].alias("similarity"),
        m["best_query_title_score"].alias("title_score"), m["best_query_domain_score"].alias("domain_score"),
        m["best_query_term_overlap"].alias("term_overlap"), m["decision_reason"].alias("reason"))


@query("query_match_blocks", f"with {q.MATCH} select doc_id, item_id best_query_ord, matched, round_even(total * 100, 2) score from best")
def query_match_blocks(spark, d):
    """The same answer from several blocks of queries."""
    m = F.col("query_match")
    return _evaluated(spark, d, block_queries=16).select(
        F.col("ord").alias("doc_id"), m["query_ord"].alias("best_query_ord"), m["matched"].alias("matched"),
        m["best_query_score"].alias("score"))


@query("query_match_whole_word", f"""
with {q.MATCH.replace("contains(p2.full_n, w)", "list_contains(p2.toks, w)").replace(
    "contains(p2.probe, w)", "list_contains(regexp_extract_all(p2.probe, '[a-z0-9+#]+'), w)")}
select doc_id, item_id best_query_ord, matched, round_even(total * 100, 2) score from best""")
def query_match_whole_word(spark, d):
    m = F.col("query_match")
    return _evaluated(spark, d, whole_word=True).select(
        F.col("ord").alias("doc_id"), m["query_ord"].alias("best_query_ord"), m["matched"].alias("matched"),
        m["best_query_score"].alias("score"))


@query("query_filter_split", f"""
with {q.MATCH} select case when matched then 'kept' else 'rejected' end side, doc_id, source from best""")
def query_filter_split(spark, d):
    # both sides read the evaluation, so it is made once and written without its texts
    evaluated = land(_evaluated(spark, d).select("ord", "source", "query_match"), "evaluated")
    kept, rejected = query_match.split_by_match(evaluated)
    pick = lambda df, side: df.select(F.lit(side).alias("side"), F.col("ord").alias("doc_id"), "source")
    return pick(kept, "kept").unionByName(pick(rejected, "rejected"))


STATS = """stats as (
  select source, count(*) raw_jobs_discovered, count(*) filter (where matched) jobs_matched,
         count(*) filter (where not matched) jobs_filtered_out from best group by source)"""


@query("source_stats", f"with {q.MATCH}, {STATS} select * from stats")
def source_stats(spark, d):
    return stats.source_stats(_evaluated(spark, d)).select("source", *stats.COUNTERS)


EVENT_STATS = """
select event_type source, count(*) raw_jobs_discovered, count(*) filter (where value > 10) jobs_matched,
       count(*) filter (where value <= 10) jobs_filtered_out from events where {w} group by event_type"""


def _event_stats(spark, d, condition):
    ok = F.col("value") > 10
    rows = b.table(spark, d, "events").where(condition)
    return rows.groupBy(F.col("event_type").alias("source")).agg(
        F.count("*").alias("raw_jobs_discovered"), F.count_if(ok).alias("jobs_matched"),
        F.count_if(~ok).alias("jobs_filtered_out"))


BOTH = f"""(({EVENT_STATS.format(w="event_type <> 'error'")}) union all ({EVENT_STATS.format(w="value < 30 and event_type <> 'view'")}))"""


@query("merge_source_stats", f"""
select source, max(raw_jobs_discovered) raw_jobs_discovered, max(jobs_matched) jobs_matched, max(jobs_filtered_out) jobs_filtered_out
from {BOTH} group by source""")
def merge_source_stats(spark, d):
    return stats.merge_source_stats(
        _event_stats(spark, d, "event_type <> 'error'"), _event_stats(spark, d, "value < 30 and event_type <> 'view'"))


@query("merge_runs", f"""
select source, sum(raw_jobs_discovered)::BIGINT raw_jobs_discovered, sum(jobs_matched)::BIGINT jobs_matched,
  sum(jobs_filtered_out)::BIGINT jobs_filtered_out from {BOTH} group by source""")
def merge_runs(spark, d):
    return stats.merge_runs(_event_stats(spark, d, "event_type <> 'error'").unionByName(
        _event_stats(spark, d, "value < 30 and event_type <> 'view'")))


def _runs(spark, d):
    """Events as two kinds of debug entries: a run is the rest of the user by 5, a key a band of values."""
    key, run = F.floor(F.col("value") / 20), F.col("user_id") % 5
    return b.table(spark, d, "events").select(
        F.col("event_type").alias("source"), run.alias("run_ord"), key.cast("string").alias("key"), ((run + key) % 3 == 0).alias("scalar"),
        F.col("event_id").alias("ord"), F.col("event_id").cast("string").alias("value"))


@query("merge_notes", """
select event_type source, row_number() over (partition by event_type order by user_id % 5, event_id) - 1 as ord, cast(event_id as varchar) note from events""")
def merge_notes(spark, d):
    return stats.merge_lists(_runs(spark, d), ["source"]).select("source", "ord", F.col("value").alias("note"))


@query("merge_debug", """
with e as (select event_type source, user_id % 5 run, cast(floor(value / 20)::BIGINT as varchar) key, (user_id % 5 + floor(value / 20)) % 3 = 0 scalar, event_id from events),
v as (select source, key, run, not scalar as lists, case when scalar then [max(event_id)] else list(event_id order by event_id) end as vals from e group by source, key, run, scalar),
folded as (select source, key, list_reduce(list({'lists': lists, 'vals': vals} order by run), lambda acc, x:
  case when acc.lists and x.lists then {'lists': true, 'vals': list_concat(acc.vals, x.vals)} else x end) f from v group by source, key)
select source, key, case when f.lists then unnest(generate_series(0, len(f.vals) - 1)) end as ord, cast(unnest(f.vals) as varchar) as value from folded""")
def merge_debug(spark, d):
    """Several runs' debug maps as one; what is a scalar in a run has one value."""
    rows = _runs(spark, d)
    one = rows.where("scalar").groupBy("source", "run_ord", "key").agg(F.max("ord").cast("string").alias("value")).withColumn("ord", F.lit(None).cast("long"))
    entries = rows.where("not scalar").select("source", "run_ord", "key", F.col("ord").cast("long").alias("ord"), "value").unionByName(one)
    return stats.merge_debug(entries, ["source"]).select("source", "key", "ord", "value")


@query("report_totals", f"""
with {q.MATCH}, {STATS}
select (select sum(raw_jobs_discovered) from stats)::BIGINT total_jobs_raw_discovered,
  (select sum(jobs_filtered_out) from stats)::BIGINT total_jobs_filtered_out,
  (select count(distinct description) from posts join best using (doc_id) where matched) total_jobs_discovered,
  (select count(distinct description) from posts join best using (doc_id) where matched) total_jobs_ranked""")
def report_totals(spark, d):
    evaluated = _evaluated(spark, d)
    kept, _ = query_match.split_by_match(evaluated)
    unique = dedupe.first_per_key(kept.select("description", "ord"), ["description"], ["ord"])
    return stats.report_totals(stats.source_stats(evaluated), unique)


@query("german_variants", f"""
with x as (select p_partkey, p_name || ' Engineer mapping' title from part),
v as (select p_partkey, title, [title, replace(lower(title), 'engineer', 'ingenieur'),
  replace(lower(title), 'mapping', 'mapping')] vs from x)
select p_partkey, array_to_string(list_filter(vs, lambda w, i: list_position(list_transform(vs, lambda y: lower(y)), lower(w)) = i), '|') variants from v""")
def german_variants_q(spark, d):
    return b.table(spark, d, "part").select("p_partkey", F.array_join(german_variants(
        F.concat("p_name", F.lit(" Engineer mapping"))), "|").alias("variants"))
