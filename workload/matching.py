"""Requirements, evidence, claims and match reports: assistant lines against user lines of a conversation."""

from __future__ import annotations

from pyspark.sql import functions as F

from rolescope import fixed_values as V, sinks
from rolescope.functions import text as t
from rolescope.operators import matching as m
from workload import query, sql as q, tables as b

KEY = ["profile_id", "posting_id", "ord"]


def evidence(spark, d):
    rows = b.turns(spark, d, "user").withColumn("source_section", F.lit("user"))
    return m.first_evidence(rows.select("profile_id", "ord", "text", "source_section"))


def requirements(spark, d):
    return b.turns(spark, d, "assistant").withColumnRenamed("text", "requirement")


def assessed(spark, d):
    asked = requirements(spark, d)
    found = m.retrieve_evidence(asked, evidence(spark, d), KEY, 3)
    return m.assess_requirements(m.with_evidence(asked, found, KEY))


def claims(spark, d):
    asked = requirements(spark, d).withColumnRenamed("requirement", "claim")
    found = m.retrieve_evidence(asked, evidence(spark, d), KEY, 3, text="claim")
    return m.check_claims(m.with_evidence(asked, found, KEY))


EVIDENCE = f"""turns as (
  select cast(conv_id as varchar) profile_id, role, turn * 4294967296 + pos - 1 ord, line from (
    select conv_id, turn, role, unnest(str_split(text, chr(10))) line, generate_subscripts(str_split(text, chr(10)), 1) pos from conversations)
  where trim(line) <> ''),
ev as (
  select profile_id, ord, line, list_distinct({q.tokens('line')}) toks, {q.tokens('line')} alltoks from (
    select *, row_number() over (partition by profile_id, {q.norm('line')} order by ord) rn from turns where role = 'user') where rn = 1),
req as (select profile_id, ord, line requirement, list_distinct({q.tokens('line')}) toks from turns where role = 'assistant'),
sim as (
  select r.profile_id, r.ord, r.requirement, r.toks rtoks, e.ord evidence_ord, e.line, e.toks, case when len(r.toks) = 0 or len(e.toks) = 0 then 0.0::DOUBLE else
    len(list_intersect(r.toks, e.toks))::DOUBLE / (len(r.toks) + len(e.toks) - len(list_intersect(r.toks, e.toks))) end similarity
  from req r join ev e using (profile_id)),
top3 as (select * from (select *, row_number() over (partition by profile_id, ord order by similarity desc, evidence_ord) rn from sim) where rn <= 3),
best as (
  select r.profile_id, r.ord, r.requirement, r.toks rtoks, max(t.similarity) best, list_distinct(flatten(list(t.toks))) etoks,
         arg_min(t.line, t.rn) first_line, count(t.rn) n
  from req r left join top3 t using (profile_id, ord) group by all),
st as (
  select *, case when coalesce(best, 0) >= 0.72 then 'strong_match' when coalesce(best, 0) >= 0.50 then 'partial_match'
    when coalesce(best, 0) >= 0.30 then 'uncertain' else 'missing' end status from best)"""


@query("evidence_topk", f"with {EVIDENCE} select profile_id, ord, evidence_ord, round(similarity, 6) similarity from top3")
def evidence_topk(spark, d):
    return m.retrieve_evidence(requirements(spark, d), evidence(spark, d), KEY, 3).select(
        "profile_id", "ord", "evidence_ord", F.round("similarity", 6).alias("similarity"))


@query("evidence_topk_shared", f"""
with turns as (
  select role, conv_id * 1099511627776 + turn * 1048576 + pos - 1 ord, line, list_distinct({q.tokens('line')}) toks from (
    select conv_id, turn, role, unnest(str_split(text, chr(10))) line, generate_subscripts(str_split(text, chr(10)), 1) pos from conversations)
  where trim(line) <> ''),
sim as (
  select r.ord, e.ord evidence_ord, case when len(r.toks) = 0 or len(e.toks) = 0 then 0.0::DOUBLE else
    len(list_intersect(r.toks, e.toks))::DOUBLE / (len(r.toks) + len(e.toks) - len(list_intersect(r.toks, e.toks))) end similarity
  from turns r, turns e where r.role = 'assistant' and e.role = 'user')
select ord, evidence_ord, round(similarity, 6) similarity from (
  select *, row_number() over (partition by ord order by similarity desc, evidence_ord) rn from sim) where rn <= 5""")
def evidence_topk_shared(spark, d):
    """All user lines as the evidence of one profile, through postings lists whatever its size."""
    def lines(role):
        rows = b.wide(spark, d, "conversations").where(F.col("role") == role)
        cut = rows.select("conv_id", "turn", F.posexplode(F.split("text", "\n", -1)).alias("pos", "text"))
        return cut.where(F.trim("text") != "").select(
            F.lit("all").alias("profile_id"), (F.col("conv_id") * (1 << 40) + F.col("turn") * (1 << 20) + F.col("pos")).alias("ord"),
            "text", F.lit(role).alias("source_section"))
    asked = lines("assistant").select("profile_id", "ord", F.col("text").alias("requirement"))
    found = m.retrieve_evidence(asked, lines("user"), ["profile_id", "ord"], 5, direct=0)
    return found.select("ord", "evidence_ord", F.round("similarity", 6).alias("similarity"))


@query("evidence_topk_vector", """
with v as (select vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) e from embeddings),
u as (select vec_id, label, e, sqrt(list_dot_product(e, e)) n from v),
s as (select a.vec_id ord, b.vec_id evidence_ord, greatest(0.0, least(1.0, list_dot_product(a.e, b.e) / a.n / b.n)) similarity
      from u a join u b using (label) where a.vec_id % 20 = 0)
select ord, evidence_ord, round(similarity, 5) similarity from (
  select *, row_number() over (partition by ord order by round(similarity, 9) desc, evidence_ord) rn from s) where rn <= 3""")
def evidence_topk_vector(spark, d):
    """Vectors as requirements and evidence of their label; the stated queries are the ids divisible by 20."""
    rows = b.table(spark, d, "embeddings").select(
        F.col("label").cast("string").alias("profile_id"), F.col("vec_id").alias("ord"), F.col("vec_id").cast("string").alias("text"),
        F.lit("vector").alias("source_section"), F.col("embedding").alias("vector"))
    asked = rows.where(F.col("ord") % 20 == 0).withColumnRenamed("text", "requirement")
    found = m.retrieve_evidence(asked, rows, ["profile_id", "ord"], 3, similarity=m.by_vector("vector"))
    return found.select("ord", "evidence_ord", F.round("similarity", 5).alias("similarity"))


@query("dedupe_evidence", f"with {EVIDENCE} select profile_id, ord, trim(line) as text from ev")
def dedupe_evidence(spark, d):
    return evidence(spark, d).select("profile_id", "ord", F.trim("text").alias("text"))


IGNORED = ", ".join(f"'{w}'" for w in V.OVERLAP_IGNORED)
CLAIM_IGNORED = ", ".join(f"'{w}'" for w in V.CLAIM_IGNORED)


@query("assess_requirements", f"""
with {EVIDENCE}
select profile_id, ord, status, round(case when n = 0 then 0.65 when status = 'strong_match' then least(0.95, greatest(0.72, best))
    when status = 'partial_match' then least(0.85, greatest(0.55, best)) when status = 'uncertain' then least(0.65, greatest(0.35, best))
    else 0.70 end, 6)::DOUBLE confidence,
  case when status in ('partial_match', 'uncertain') then array_to_string(list_sort(list_filter(list_intersect(rtoks, etoks),
    lambda w: length(w) > 2 and w not in ({IGNORED})))[1:8], '|') else '' end shared
from st""")
def assess_requirements(spark, d):
    return assessed(spark, d).select(
        "profile_id", "ord", "status", F.round("confidence", 6).alias("confidence"),
        F.array_join("transferable_skills", "|").alias("shared"))


@query("match_score", f"""
with {EVIDENCE}
select profile_id, round_even(avg(case status when 'strong_match' then 1.0::DOUBLE when 'partial_match' then 0.6::DOUBLE when 'uncertain' then 0.3::DOUBLE
  else 0.0::DOUBLE end) * 100.0, 2) overall_score from st group by profile_id""")
def match_score(spark, d):
    return assessed(spark, d).groupBy("profile_id").agg(
        t.round_to(F.avg(m.status_score(F.col("status"))) * 100.0, 2).alias("overall_score"))


def reports(spark, d):
    rows = assessed(spark, d)
    pairs = b.table(spark, d, "conversations").select(
        F.col("conv_id").cast("string").alias("profile_id"), F.col("conv_id").cast("string").alias("posting_id")).distinct()
    pairs = pairs.withColumns({"missing_skills": F.array(F.lit("slam")), "title": F.lit("Role"), "company": F.lit("Co")})
    return m.match_report(pairs, rows, ["profile_id", "posting_id"], claims(spark, d))


@query("strengths_gaps", f"""
with {EVIDENCE}, ids as (select distinct cast(conv_id as varchar) profile_id from conversations),
s as (select profile_id, list(case status when 'strong_match' then 'Strong evidence for: ' else 'Related or transferable evidence for: ' end
  || requirement order by ord)[1:8] xs from st where status in ('strong_match', 'partial_match') group by profile_id),
g0 as (select profile_id, ord, trim(case status when 'missing' then 'No clear evidence for: ' else 'Needs manual review: ' end || requirement) x
  from st where status in ('missing', 'uncertain') union all select profile_id, 9223372036854775807, 'Rules-based skill gap: slam' from ids),
g1 as (select *, row_number() over (partition by profile_id, {q.norm('x')} order by ord) rn from g0),
g as (select profile_id, list(x order by ord)[1:10] xs from g1 where rn = 1 group by profile_id)
select profile_id, coalesce(array_to_string(s.xs, '|'), '') strengths, coalesce(array_to_string(g.xs, '|'), '') gaps
from ids left join s using (profile_id) left join g using (profile_id)""")
def strengths_gaps(spark, d):
    return reports(spark, d).select(
        "profile_id", F.array_join("strengths", "|").alias("strengths"), F.array_join("gaps", "|").alias("gaps"))


@query("claim_check", f"""
with {EVIDENCE},
c as (select *, list_filter(rtoks, lambda w: length(w) > 2 and w not in ({CLAIM_IGNORED})) terms, coalesce(etoks, []::VARCHAR[]) seen from best),
c2 as (select *, case when len(terms) = 0 then 0.0::DOUBLE else len(list_intersect(terms, seen))::DOUBLE / len(terms) end coverage,
  list_sort(list_filter(terms, lambda w: not list_contains(seen, w)))[1:6] lost, coalesce(best, 0.0) b from c),
c3 as (select *, (n > 0 and b >= 0.70 and coverage >= 0.60) supported from c2)
select profile_id, ord, supported, round(coverage, 6) coverage, array_to_string(lost, '|') missing,
  round(case when n = 0 then 0.70 when supported then least(0.92, greatest(0.72, b)) when b >= 0.45 or coverage > 0
    then least(0.82, greatest(0.50, b)) else 0.72 end, 6)::DOUBLE confidence,
  case when supported then null when n > 0 then 'My background includes ' || regexp_replace(trim(regexp_replace(first_line, '\\s+', ' ', 'g')), '\\.+$', '') ||
    ', which provides a foundation for work related to ' || coalesce(nullif(array_to_string(list_sort(terms)[1:6], ', '), ''), 'this area') || '.'
  else 'I am interested in applying my documented background to work related to ' ||
    coalesce(nullif(array_to_string(list_sort(terms)[1:6], ', '), ''), 'this area') || '.' end safer
from c3""")
def claim_check(spark, d):
    rows = claims(spark, d)
    squeezed = F.trim(F.regexp_replace("safer_wording", r"\s+", " "))
    return rows.select(
        "profile_id", "ord", "supported", F.round("coverage", 6).alias("coverage"),
        F.array_join("missing_terms", "|").alias("missing"), F.round("confidence", 6).alias("confidence"),
        squeezed.alias("safer"))


@query("match_report_lines")
def match_report_lines(spark, d):
    return sinks.match_report_lines(reports(spark, d), ["profile_id"])


CLEAN = """regexp_replace(trim(regexp_replace(s, '\\s+', ' ', 'g'), ' -*:.;'), '^(requirements?|responsibilities|qualifications?|preferred|nice to have)\\s*[:\\-]\\s*', '', 'i')"""
MARK = q.any_in("lower(v)", V.REQUIREMENT_MARKERS)


@query("requirements_extract", f"""
with {q.POSTS},
cand as (
  select id, 1 part, generate_subscripts(skills, 1) pos, unnest(skills) s from posts union all
  select id, 2 part, pos, s from (select id, generate_subscripts(ls, 1) pos, unnest(ls) s from (
    select id, regexp_split_to_array(description, '[.\\n]+') ls from posts)) where length({q.strip('s')}) > 20 union all
  select id, 3 part, generate_subscripts(signals, 1) pos, 'Experience with ' || unnest(signals) s from posts),
cl as (select id, part, pos, {CLEAN} w from cand),
cl2 as (select id, part, pos, case when length(w) <= 180 then w else regexp_replace(regexp_replace(left(w, 180), ' [^ ]*$', ''), '[,;:]+$', '') end v from cl),
ok as (select * from cl2 where v <> '' and (part <> 2 or (length(v) >= 4 and {MARK})) and length(v) > 1 and not ({q.any_in('lower(v)', V.VAGUE_TERMS)})),
u as (select *, row_number() over (partition by id, {q.norm('v')} order by part, pos) rn from ok),
n as (select *, row_number() over (partition by id order by part, pos) k from u where rn = 1)
select id, (k - 1)::INTEGER ord, v requirement from n where k <= 15""")
def requirements_extract(spark, d):
    return m.extract_requirements(b.postings(spark, d), ["id"])


@query("build_evidence")
def build_evidence(spark, d):
    """Evidence of the profiles structured from each conversation's user turns."""
    from workload.structuring import conversation_profiles
    return m.build_evidence(conversation_profiles(spark, d))


@query("explain_matches")
def explain_matches(spark, d):
    """Match reports of conversation profiles against the postings of documents that share their number."""
    from rolescope.plans.search import explain_matches as explain
    from workload.structuring import conversation_profiles
    people = conversation_profiles(spark, d)
    jobs = b.postings(spark, d).withColumn("posting_id", F.col("id"))
    pairs = people.select("profile_id", F.col("profile_id").alias("posting_id"))
    return explain(people, jobs, pairs).select(
        "profile_id", "posting_id", "overall_score", "recommendation", F.size("assessments").alias("n_requirements"),
        F.array_join("gaps", "|").alias("gaps"))
