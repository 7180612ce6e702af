"""The registered queries of this subpackage: each applies its operator to a whole given table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolescope.llm import (class_lm, collocations, common, conversation_trie, decontaminate, language_id, line_rules, packing, simhash,
                           substring_dedup, suffix_dedup, token_counts, token_files, url_filter)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        common.batches_of_bounded_bytes(spark)
        return fn(spark, sf_dir)
    QUERIES[fn.__name__] = run
    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = suffix_dedup.remove_repeats(docs, width=200)
    removed = F.aggregate("removed_spans", F.lit(0).cast("long"), lambda n, s: n + s["hi"] - s["lo"])
    return out.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), removed.alias("n_removed"),
                      F.size("removed_spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query
def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"), distance=3)
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query
def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = substring_dedup.remove_repeats(docs, width=50)
    removed = F.aggregate("removed_spans", F.lit(0).cast("long"), lambda n, s: n + s["hi"] - s["lo"])
    return out.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


ORACLES["op8_substring_dedup"] = r"""
WITH words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
starts AS (SELECT doc_id, w, unnest(range(len(w) - 49)) AS p FROM words WHERE len(w) >= 50),
windows AS (SELECT doc_id, p, md5(array_to_string(w[p + 1:p + 50], ' ')) AS h FROM starts),
least AS (SELECT h, min(doc_id) AS d FROM windows GROUP BY h),
gone AS (SELECT DISTINCT doc_id, p + o AS i
         FROM windows JOIN least USING (h), (SELECT unnest(range(50)) AS o) WHERE d < doc_id),
lists AS (SELECT doc_id, list(i) AS g FROM gone GROUP BY doc_id),
each AS (SELECT doc_id, w, unnest(range(len(w))) AS i FROM words JOIN lists USING (doc_id)),
kept AS (SELECT doc_id, string_agg(w[i + 1], ' ' ORDER BY i) AS kept FROM each ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(g), 0)::BIGINT AS n_removed,
       sha256(CASE WHEN g IS NULL THEN array_to_string(w, ' ') ELSE coalesce(kept, '') END) AS kept_sha256
FROM words LEFT JOIN lists USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


@query
def op9_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_rules.clean_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


ORACLES["op9_line_rules"] = r"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT doc_id, p, array_to_string(w[p + 1:p + 3], ' ') AS g
            FROM (SELECT doc_id, w, unnest(range(len(w) - 2)) AS p FROM docs WHERE len(w) >= 3)),
twice AS (SELECT doc_id, p FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
repeated AS (SELECT doc_id, count(DISTINCT p + o) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS o) GROUP BY doc_id),
each AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM docs),
lines AS (SELECT doc_id, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS w FROM each WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
judged AS (
  SELECT doc_id, line, len(w) AS n, len(list_filter(w, lambda x: x IN ('|', '/', '>', '-', '·', '»', '›', '•'))) AS marks,
         len(list_filter(w, lambda x: regexp_matches(x, '[#*$%&|<>]'))) AS symbols,
         regexp_matches(line, '(?i)all rights reserved|licensed under|released under the|this work is licensed|cookie policy|privacy policy|terms of use|terms of service|enable javascript|click here|sign up for our newsletter|lorem ipsum') AS boilerplate,
         len(list_filter(w, lambda x: right(x, 1) IN ('.', '!', '?', '…', ':', ';', '"', chr(39), ')', ']', '}', '»', '”', '’', '。', '！', '？'))) > 0 AS ended
  FROM lines),
summed AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines,
         coalesce(sum(n) FILTER (WHERE ended AND NOT boilerplate AND NOT (marks >= 3 AND marks * 5 >= n) AND NOT (symbols >= 3 AND symbols * 10 >= n * 3)), 0) AS kept_words
  FROM judged GROUP BY doc_id),
based AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words, coalesce(kept_words, 0) AS kept_words
  FROM docs LEFT JOIN summed USING (doc_id) LEFT JOIN repeated r USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND (n_words - kept_words) * 2 <= n_words AS kept
FROM based
"""


@query
def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = url_filter.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"))
    return out.select("page_id", "host", "path", "rule", "verdict", "score")


@query
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.train(docs.where(language_id.fold("doc_id", 3) != 1))
    out = language_id.predict(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (language_id.fold("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")


@query
def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = table(spark, sf_dir, "documents").select("doc_id", "text"), token_files.folder_for(spark)
    manifest = token_files.write_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), folder)
    return token_files.read_tokens(manifest, folder)


@query
def op3_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model, tail = class_lm.train(docs.where(~class_lm.held_out("doc_id")))
    out = class_lm.score(docs, model, tail)
    return out.select("doc_id", class_lm.held_out("doc_id").alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score",
                      "perplexity")


@query
def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.contaminated(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "item_id", "score", "first_word", "end_word", "n_seeds")


@query
def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


@query
def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = collocations.mine(table(spark, sf_dir, "documents").select("text", "lang"), least=10, overlap=50)
    return collocations.best(out, 2000)


ORACLES["op11_collocations"] = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
starts AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS p FROM words WHERE len(w) > 0),
grams AS (SELECT lang, k, array_slice(w, p, p + k - 1) AS g FROM starts, (SELECT unnest([1, 2, 3]) AS k) WHERE p + k - 1 <= len(w)),
f AS (SELECT lang, k, g, count(*) AS a FROM grams GROUP BY ALL),
totals AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
parts AS (SELECT lang, k, g, a, unnest(range(1, k)) AS cut FROM f WHERE k > 1 AND a >= 10),
keyed AS (SELECT *, g[1:cut] AS g1, g[cut + 1:k] AS g2 FROM parts),
cuts AS (
  SELECT c.lang, c.k, c.g, c.a, c.cut, x.a AS l, y.a AS r, (1000000::HUGEINT * c.a * c.a // (x.a::HUGEINT * y.a))::BIGINT AS score
  FROM keyed AS c JOIN f AS x ON x.lang = c.lang AND x.g = c.g1 JOIN f AS y ON y.lang = c.lang AND y.g = c.g2),
least AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, cut) = 1),
inside AS (
  SELECT lang, g[1:2] AS g, a FROM f WHERE k = 3 AND a >= 10 UNION ALL SELECT lang, g[2:3], a FROM f WHERE k = 3 AND a >= 10),
longest AS (SELECT lang, g, max(a) AS most FROM inside GROUP BY lang, g),
kept AS (
  SELECT lang, array_to_string(g, ' ') AS phrase, a, l, r, score FROM least LEFT JOIN longest USING (lang, g)
  WHERE k = 3 OR most IS NULL OR 100 * most < 50 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a::BIGINT AS a,
       l::BIGINT AS l, r::BIGINT AS r, n, score
FROM kept JOIN totals USING (lang) QUALIFY rank <= 2000
"""


@query
def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = token_counts.count_tokens(docs, public_tokenizers.path("word_bpe_49k.json"), limit=2048)
    return out.select("doc_id", "n_bytes", "n_tokens", "over_limit")


@query
def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return conversation_trie.prefix_trie(conversation_trie.rebuilt(turns))


ORACLES["op13_conversation_trie"] = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
         sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))[1:32] AS t FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT conv_id, list(struct_pack(t := t, n := length(text)) ORDER BY turn NULLS FIRST, t) AS own FROM turns GROUP BY conv_id),
bytes AS (SELECT conv_id, own, [ord(c)::BIGINT FOR c IN string_split(conv_id::VARCHAR, '')] AS b FROM convs),
crc AS (
  SELECT conv_id, own, list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, x: list_reduce(list_prepend(xor(c, x), range(8)),
         lambda v, i: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::BIGINT) ELSE v >> 1 END)) AS c FROM bytes),
heads AS (SELECT conv_id, own, xor(c, 4294967295::BIGINT) % 6 AS h FROM crc),
rebuilt AS (
  SELECT x.conv_id, coalesce(y.own, [])[1:h] || x.own[h + 1:] AS seq
  FROM heads AS x LEFT JOIN convs AS y ON y.conv_id = x.conv_id - x.conv_id % 100),
prefixes AS (SELECT conv_id, len(seq) AS size, d, coalesce(seq[d].n, 0) AS n, array_to_string([s.t FOR s IN seq[1:d]], '') AS node
             FROM rebuilt, unnest(range(len(seq) + 1)) AS r(d)),
nodes AS (
  SELECT node, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(n) AS n,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE size = d), '')) AS ends_sha256
  FROM prefixes GROUP BY node, d),
children AS (SELECT left(node, (depth - 1) * 32) AS node, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
marked AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN children USING (node)),
above AS (SELECT left(node, a * 32) AS node, n_children, n_convs, n FROM marked, unnest(range(depth + 1)) AS r(a)),
sums AS (SELECT node, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum((n_convs - 1) * n) AS saved_tokens FROM above GROUP BY node)
SELECT m.conv_id, m.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, m.n_convs::BIGINT AS n_convs, m.n_children::BIGINT AS n_children,
       n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, m.ends_sha256
FROM marked AS m JOIN sums USING (node) LEFT JOIN marked AS p ON m.depth > 0 AND p.node = left(m.node, (m.depth - 1) * 32)
"""
