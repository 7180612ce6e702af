"""Text functions over whole documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from rolescope.functions import text as t
from rolescope.operators import dedupe, structure
from rolescope.operators.matching import chunk_text
from workload import query, sql as q, tables as b

N_LINES = "str_split(text, chr(10))"


@query("normalize_text", f"""
select doc_id, length({q.norm('text')}) n, sha256({q.norm('text')}) digest from documents""")
def normalize_text(spark, d):
    v = t.normalize_text("text")
    return b.wide(spark, d, "documents").select(
        "doc_id", F.length(v).cast("bigint").alias("n"), F.sha2(v, 256).alias("digest"))


@query("tokenise_counts", f"""
select doc_id, len({q.tokens('text')}) n_tokens, len(list_distinct({q.tokens('text')})) n_distinct from documents""")
def tokenise_counts(spark, d):
    return b.wide(spark, d, "documents").select(
        "doc_id", F.size(t.tokenise("text")).cast("bigint").alias("n_tokens"),
        F.size(t.token_set("text")).cast("bigint").alias("n_distinct"))


PAIRS = """pairs as (
  select a.conv_id, a.turn, a.text l, b.text r from conversations a
  join conversations b on a.conv_id = b.conv_id and b.turn = a.turn + 1)"""


def _pairs(spark, d):
    c = b.table(spark, d, "conversations")
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("r"))
    return c.select("conv_id", "turn", F.col("text").alias("l")).join(nxt, ["conv_id", "turn"])


@query("jaccard_pairs", f"""
with {PAIRS}, s as (select conv_id, turn, list_distinct({q.tokens('l')}) l, list_distinct({q.tokens('r')}) r from pairs)
select conv_id, turn, round(case when len(l) = 0 or len(r) = 0 then 0 else
  len(list_intersect(l, r))::DOUBLE / (len(l) + len(r) - len(list_intersect(l, r))) end, 6) jaccard from s""")
def jaccard_pairs(spark, d):
    return _pairs(spark, d).select("conv_id", "turn", F.round(t.text_jaccard("l", "r"), 6).alias("jaccard"))


def _phrases(x):
    return f"list_distinct(list_transform(list_filter(regexp_split_to_array({x}, '[ ,.]+'), lambda w: w <> ''), lambda w: {q.norm('w')}))"


@query("keyword_overlap", f"""
with {PAIRS}, s as (select conv_id, turn, {_phrases('l')} l, {_phrases('r')} r from pairs)
select conv_id, turn, round_even(case when len(l) = 0 or len(r) = 0 then 0 else
  100.0::DOUBLE * (len(list_intersect(l, r))::DOUBLE / (len(l) + len(r) - len(list_intersect(l, r)))) end, 2) score from s""")
def keyword_overlap(spark, d):
    cut = lambda c: F.split(c, "[ ,.]+", -1)
    return _pairs(spark, d).select(
        "conv_id", "turn", t.keyword_overlap(cut("l"), cut("r")).alias("score"))


@query("unique_preserve_order", f"""
with l as (select doc_id, unnest({N_LINES}) line, generate_subscripts({N_LINES}, 1) pos from documents),
k as (select *, {q.norm('line')} key from l),
f as (select *, row_number() over (partition by doc_id, key order by pos) rn from k where key <> '')
select d.doc_id, count(pos) n, coalesce(sha256(string_agg({q.strip('line')}, chr(10) order by pos)), sha256('')) digest
from documents d left join f on f.doc_id = d.doc_id and f.rn = 1 group by d.doc_id""")
def unique_preserve_order(spark, d):
    kept = t.unique_ordered(F.split("text", "\n", -1))
    return b.wide(spark, d, "documents").withColumn("k", kept).select(
        "doc_id", F.size("k").cast("bigint").alias("n"), F.sha2(F.array_join("k", "\n"), 256).alias("digest"))


@query("first_per_value", f"""
with l as (select lang, doc_id, {q.norm(q.FIRST)} key, {q.strip(q.FIRST)} title from documents),
f as (select *, row_number() over (partition by lang, key order by doc_id) rn from l where key <> '')
select lang, doc_id, title from f where rn = 1""")
def first_per_value(spark, d):
    rows = b.wide(spark, d, "documents").select("lang", "doc_id", b.first_line().alias("title"))
    return dedupe.first_per_value(rows, ["lang"], "title", "doc_id")


@query("phrase_matches", f"""
select doc_id, array_to_string({q.mentions('text', b.TERMS)}, '|') found from documents""")
def phrase_matches(spark, d):
    return b.wide(spark, d, "documents").select(
        "doc_id", F.array_join(t.phrase_matches("text", b.TERMS), "|").alias("found"))


@query("phrase_matches_whole_word", f"""
select doc_id, array_to_string(list_filter({q.arr(b.TERMS)}, lambda w:
  contains(' ' || array_to_string({q.tokens('text')}, ' ') || ' ', ' ' || array_to_string({q.tokens('w')}, ' ') || ' ')), '|') found
from documents""")
def phrase_matches_whole_word(spark, d):
    return b.wide(spark, d, "documents").select(
        "doc_id", F.array_join(t.phrase_matches("text", b.TERMS, whole_word=True), "|").alias("found"))


@query("clip_text", """
with c as (select doc_id, text, regexp_replace(regexp_replace(left(text, 180), ' [^ ]*$', ''), '[,;:]+$', '') cut from documents)
select doc_id, case when length(text) <= 180 then text else cut || '...' end clipped from c""")
def clip_text(spark, d):
    return b.wide(spark, d, "documents").select("doc_id", t.clip_text("text", 180, "...").alias("clipped"))


@query("bullets_or_sentences", f"""
with l as (
  select doc_id, 0 kind, pos, {q.strip('s')} s from (
    select doc_id, unnest(regexp_split_to_array(text, '[.\\n]+')) s, generate_subscripts(regexp_split_to_array(text, '[.\\n]+'), 1) pos
    from documents) where length({q.strip('s')}) > 20
  union all
  select doc_id, 1 kind, pos, {q.strip('s')} s from (
    select doc_id, unnest({N_LINES}) s, generate_subscripts({N_LINES}, 1) pos from documents))
select d.doc_id, k.kind, count(s) n, sha256(coalesce(string_agg(s, '|' order by pos), '')) digest
from documents d cross join (values (0), (1)) k(kind) left join l on l.doc_id = d.doc_id and l.kind = k.kind group by d.doc_id, k.kind""")
def bullets_or_sentences(spark, d):
    docs = b.wide(spark, d, "documents")
    marked = F.concat(F.lit("- "), F.replace("text", F.lit("\n"), F.lit("\n- ")))
    both = docs.select("doc_id", F.explode(F.array(
        F.struct(F.lit(0).alias("kind"), F.col("text")), F.struct(F.lit(1).alias("kind"), marked.alias("text")))).alias("x"))
    return both.select("doc_id", "x.kind", t.bullets_or_sentences("x.text").alias("k")).select(
        "doc_id", "kind", F.size("k").cast("bigint").alias("n"), F.sha2(F.array_join("k", "|"), 256).alias("digest"))


@query("top_terms", f"""
with w as (select doc_id, unnest({q.tokens('text')}) term, generate_subscripts({q.tokens('text')}, 1) pos from documents),
c as (select doc_id, term, count(*) n, min(pos) pos from w
      where length(term) > 2 and term not in ('and','the','with','for','from','that','this','have','into','across','using',
      'built','developed','worked','led') group by doc_id, term),
r as (select *, row_number() over (partition by doc_id order by n desc, pos) rn from c)
select doc_id, term, n from r where rn <= 15""")
def top_terms(spark, d):
    return structure.top_terms(b.wide(spark, d, "documents"), ["doc_id"], "text", 15).select(
        "doc_id", "term", F.col("count").alias("n"))


@query("occurrences", """
select doc_id, ((length(lower(text)) - length(replace(lower(text), 'tion', ''))) / 4)::BIGINT n from documents""")
def occurrences(spark, d):
    return b.wide(spark, d, "documents").select(
        "doc_id", t.occurrences(F.lower("text"), F.lit("tion")).cast("bigint").alias("n"))


@query("pack_words", """
with lists as (select doc_id,
  list_filter(list_transform(regexp_split_to_array(text, '[.\\n]+'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: length(x) > 20) said,
  regexp_split_to_array(regexp_replace(text, '([.!?;])\\s+', '\\1' || chr(10), 'g'), '\\n+') loose from documents),
bodies as (select doc_id, case when len(said) > 0 then said else loose end ps from lists),
pieces as (select doc_id, generate_subscripts(ps, 1) i, trim(regexp_replace(unnest(ps), '\\s+', ' ', 'g'), ' -*' || chr(9) || chr(10) || chr(13)) p from bodies),
packed as (select doc_id, i, case when length(p) <= 520 then [p] else list_reduce(list_transform(str_split(p, ' '), lambda w: [w]), lambda acc, x:
  case when length(acc[-1]) + 1 + length(x[1]) <= 520 then list_concat(acc[:-2], [acc[-1] || ' ' || x[1]]) else list_concat(acc, x) end) end xs
  from pieces where p <> ''),
chunks as (select doc_id, i, generate_subscripts(xs, 1) k, unnest(xs) chunk from packed)
select doc_id, (row_number() over (partition by doc_id order by i, k) - 1)::INTEGER as ord, chunk from chunks""")
def pack_words(spark, d):
    """Evidence chunks of every document; no chunk of several words passes 520 characters."""
    return b.wide(spark, d, "documents").select("doc_id", F.posexplode(chunk_text(F.col("text"))).alias("ord", "chunk"))


@query("sha256_fingerprint", """
select doc_id, sha256(concat_ws(chr(31), source, lang, text, 'v1')) fingerprint from documents""")
def sha256_fingerprint(spark, d):
    return b.wide(spark, d, "documents").select(
        "doc_id", dedupe.fingerprint("source", "lang", "text", config="v1").alias("fingerprint"))
