"""Pieces of the equivalent SQL."""

from __future__ import annotations

from workload import tables as b


def norm(x: str) -> str:
    return f"trim(regexp_replace(lower({x}), '\\s+', ' ', 'g'))"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def tokens(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '[a-z0-9+#]+')"


def arr(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]::VARCHAR[]"


def any_in(hay: str, needles: list[str]) -> str:
    return "(" + (" or ".join(f"contains({hay}, '{n}')" for n in needles) or "false") + ")"


def mentions(x: str, terms: list[str]) -> str:
    return f"list_filter({arr(terms)}, lambda w: contains({norm(x)}, w))"


def parents(x: str, *taxonomies: dict) -> str:
    items = [(p, s) for tax in taxonomies for p, s in tax.items()]
    cases = ", ".join(f"case when {any_in(f'lower({x})', [p, *s])} then '{p}' end" for p, s in items)
    return f"list_filter([{cases}]::VARCHAR[], lambda w: w is not null)"


FIRST = "split_part(text, chr(10), 1)"

POSTS = f"""posts as (
  select doc_id, cast(doc_id as varchar) id, source, {FIRST} title, 'Group ' || source company, lang location,
         text description, {mentions('text', b.TERMS)} skills, {parents('text', b.DOMAINS, b.INDUSTRIES)} signals,
         list_filter({arr(b.LANGUAGES)}, lambda w: contains(lower(text), w)) langs
  from documents)"""

PROFILES = f"""labelled as (
  select d.source profile_id, {FIRST} title, {mentions('text', b.TERMS)} skills,
         {parents('text', b.DOMAINS)} domains, {parents('text', b.INDUSTRIES)} industries
  from documents d join labels l using (doc_id) where l.quality = 1),
profiles as (
  select profile_id, list_sort(list_distinct(flatten(list(skills)))) skills,
         list_sort(list_distinct(flatten(list(domains)))) domains,
         list_sort(list_distinct(flatten(list(industries)))) industries, min(title) role
  from labelled group by profile_id)"""

MATCH = f"""{POSTS},
q as (
  select item_id, text, {norm('text')} text_n, {norm("regexp_extract(text, '^[^ \\n]+')")} title_n,
         {norm("substr(text, 1, 2)")} place_n, list_distinct({tokens('text')}) terms,
         list_distinct({tokens('text')}) toks
  from benchmark),
p as (
  select *, {norm('title')} title_n,
         {norm("concat_ws(' ', title, company, location, array_to_string(signals, ' '), array_to_string(skills, ' '), description)")} full_n
  from posts),
p2 as (
  select *, list_distinct(regexp_extract_all(full_n, '[a-z0-9+#]+')) toks,
         concat_ws(chr(1), {norm("array_to_string(signals, ' ')")}, title_n, {norm("array_to_string(skills, ' ')")}) probe
  from p),
feats as (
  select p2.doc_id, p2.source, q.item_id, q.text query,
         case when contains(p2.title_n, q.title_n) then 1.0::DOUBLE else 0.0::DOUBLE end title_s,
         case when contains({norm('p2.location')}, q.place_n) then 1.0::DOUBLE else 0.0::DOUBLE end place_s,
         len(list_filter(q.terms, lambda w: contains(p2.probe, w)))::DOUBLE / greatest(len(list_distinct(q.terms)), 1) domain_s,
         len(list_filter(list_distinct(q.terms), lambda w: contains(p2.full_n, w)))::DOUBLE / greatest(len(list_distinct(q.terms)), 1) overlap_s,
         case when len(p2.toks) = 0 or len(q.toks) = 0 then 0.0::DOUBLE else
           len(list_intersect(q.toks, p2.toks))::DOUBLE
           / (len(q.toks) + len(p2.toks) - len(list_intersect(q.toks, p2.toks))) end jac_s,
         case when q.text_n <> '' and contains(p2.full_n, q.text_n) then 1.0::DOUBLE else 0.0::DOUBLE end sub_s
  from p2, q),
scored as (
  select *, title_s * 0.35 + domain_s * 0.25 + place_s * 0.10 + overlap_s * 0.20 + jac_s * 0.10 + sub_s * 0.10 as total from feats),
ranked as (
  select *, row_number() over (partition by doc_id order by round_even(total * 100, 2) desc, item_id) rn from scored),
best as (
  select *, (total >= 0.32 or (title_s >= 1 and overlap_s >= 0.20) or overlap_s >= 0.45) matched
  from ranked where rn = 1)"""
