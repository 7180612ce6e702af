"""Best search query per posting for any number of queries, by an inverted index over them.

What a query can score with are features: a term in the posting's text or in its title, skills and domains, a
whole word, and its title, place or text as a phrase. Features are 64-bit numbers, and an index lists the
queries of each. The postings are scanned once into their distinct tokens. Which features a token has depends
on the token alone, so that is found once per distinct token of all postings: terms as substrings of tokens by
equi-joins, whole words as they are. A posting's features then meet the index, the hits of a (posting, query)
pair are added up where the posting lies, and the best pair stays.

Strings that are not a token themselves (terms of several words, titles, places, query texts) are looked up by
their longest token; only postings that have it are compared with the whole string.

A table travels to the tasks only if it was counted and is small; else the same join is a shuffle.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from rolescope.functions import text as t
from rolescope.plans.spread import spread_input
from rolescope.session import land
from rolescope.settings import Settings

FULL, PROBE, TITLE, PLACE = "", "\x01", "\x02", "\x03"  # where a string is looked for: the mark before a token found there
TITLE_HIT, PLACE_HIT, PHRASE_HIT = 1, 2, 4
COUNT = 1 << 32            # two counts share a number
LIST_QUERIES = 4096        # queries in a row of the index
TRAVELS_BYTES = 64 << 20   # a table of at most so many bytes may travel to the tasks
WINDOW = 256               # long tokens are cut into overlapping windows for their substrings


class QueryIndex(NamedTuple):
    """Queries prepared for matching; a stream prepares them once."""

    queries: DataFrame   # q, pid, query_ord, text, n_terms, n_tokens, first
    lists: DataFrame     # fid, hits: array of (q, words_terms, near_flags), see _pairs
    needles: DataFrame   # needle, whole, place, fid, value (null if finding the needle is enough)
    whole_word: bool


def _run(x: Column) -> Column:
    """The tokens of a text, each between spaces; empty without a token."""
    return t.let(t.tokenise(x), lambda ws: F.when(F.size(ws) > 0, F.concat(F.lit(" "), F.array_join(ws, " "), F.lit(" "))).otherwise(""))


def _longest(x: Column) -> Column:
    """The longest token, the first in order of the alphabet; null without one."""
    tokens = F.regexp_extract_all(x, F.lit(t.TOKEN), F.lit(0))
    return F.get(F.sort_array(F.transform(tokens, lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")))), 0)["w"]


def _small(df: DataFrame, bytes_per_row: Column) -> DataFrame:
    """A landed table, marked to travel to the tasks if its counted size allows."""
    size = df.agg(F.coalesce(F.sum(bytes_per_row.cast("long")), F.lit(0))).first()[0]
    return F.broadcast(df) if size <= TRAVELS_BYTES else df


def prepare_queries(queries: DataFrame, whole_word: bool = False, list_queries: int = LIST_QUERIES) -> QueryIndex:
    """The index of a query table (text, terms, query_ord; optional title, location, profile_id), written once.

    Queries without terms take the tokens of their text. Nulls are empty. `query_ord` is unique per profile.
    """
    has = lambda c: c in queries.columns
    terms = F.transform(F.filter(F.coalesce("terms", F.array().cast("array<string>")), lambda x: x.isNotNull()), lambda x: x)
    terms = F.when(F.size(terms) > 0, terms).otherwise(t.tokenise(t.text_or_empty("text")))
    probe = lambda c: F.when(F.col(c) != "", t.normalize_text(c)) if has(c) else F.lit(None).cast("string")
    order = W.partitionBy("pid").orderBy("query_ord")
    rows = land(queries.select(
        (F.col("profile_id") if has("profile_id") else F.lit("")).cast("string").alias("pid"), F.col("query_ord").cast("long").alias("query_ord"),
        "text", t.normalize_text(t.text_or_empty("text")).alias("text_n"), probe("title").alias("title_n"), probe("location").alias("place_n"),
        terms.alias("terms"), t.token_set(t.text_or_empty("text")).alias("tokens"),
    ).withColumn("q", F.xxhash64("pid", "query_ord")), "match-queries")
    n_queries = rows.count()
    info = rows.select("q", "pid", "query_ord", "text", F.greatest(F.size(F.array_distinct("terms")), F.lit(1)).cast("double").alias("n_terms"),
                       F.size("tokens").cast("double").alias("n_tokens"), (F.row_number().over(order) == 1).alias("first"))

    def entries(kind: str, values: Column, words_terms: int = 0, near_flags: int = 0) -> DataFrame:
        return rows.select("q", F.lit(kind).alias("kind"), F.explode(values).alias("value"), F.lit(words_terms).cast("long").alias("words_terms"),
                           F.lit(near_flags).cast("long").alias("near_flags"))

    one = lambda c: F.filter(F.array(c), lambda x: x.isNotNull())
    kinds = (entries("term", F.array_distinct("terms"), words_terms=COUNT)
             .unionByName(entries("near", F.col("terms"), near_flags=COUNT))
             .unionByName(entries("word", F.col("tokens"), words_terms=1))
             .unionByName(entries("title", one("title_n"), near_flags=TITLE_HIT))
             .unionByName(entries("place", one("place_n"), near_flags=PLACE_HIT))
             .unionByName(entries("text", F.filter(F.array("text_n"), lambda x: x != ""), near_flags=PHRASE_HIT))
             .groupBy("q", "kind", "value").agg(F.sum("words_terms").alias("words_terms"), F.sum("near_flags").alias("near_flags")))
    kinds = land(kinds.withColumn("fid", F.xxhash64("kind", "value")), "match-features")
    parts = max(1, -(-n_queries // list_queries))
    lists = land(kinds.groupBy("fid", F.pmod("q", F.lit(parts)).alias("part")).agg(F.collect_list(F.struct("q", "words_terms", "near_flags")).alias("hits"))
                 .select("fid", "hits"), "match-lists")

    is_term = F.col("kind").isin("term", "near")
    as_run = is_term & F.lit(whole_word)
    place = F.when(F.col("kind") == "title", TITLE).when(F.col("kind") == "place", PLACE).when(F.col("kind") == "near", PROBE).otherwise(FULL)
    value = F.when(as_run, _run(F.col("value"))).otherwise(F.col("value"))
    plain = (F.col("kind") == "word") | F.col("value").rlike(f"^(?:{t.TOKEN})\\z")  # lies in the text exactly if it lies in a token
    needles = kinds.select("kind", "value", "fid").distinct().where(~as_run | (value != "")).select(
        F.when(plain, F.col("value")).otherwise(_longest(value)).alias("needle"), ((F.col("kind") == "word") | as_run).alias("whole"),
        place.alias("place"), "fid", as_run.alias("as_run"), F.when(~plain, value).alias("value"))
    return QueryIndex(info, lists, land(needles, "match-needles"), whole_word)


def _contexts(postings: DataFrame, key: list[str]) -> DataFrame:
    """Per posting the strings that queries are compared with, and the distinct tokens of each."""
    lists = F.concat(F.coalesce("required_skills", F.array()), F.coalesce("preferred_skills", F.array())).cast("array<string>")
    domains = F.array_join(F.coalesce("domain_signals", F.array().cast("array<string>")), " ")
    skills = F.array_join(lists, " ")
    title, place = t.text_or_empty("title"), t.text_or_empty("location")
    full = F.concat_ws(" ", title, t.text_or_empty("company"), place, domains, skills, t.text_or_empty("description"))
    rows = postings.select(*key, t.normalize_text(title).alias("_title"), t.normalize_text(place).alias("_place"),
                           t.normalize_text(domains).alias("_domains"), t.normalize_text(skills).alias("_skills"), t.normalize_text(full).alias("_full"))
    words = lambda c: F.regexp_extract_all(c, F.lit(t.TOKEN), F.lit(0))
    # no token has a space
    marked = lambda ws, mark: F.when(F.size(ws) > 0, F.split(F.concat(F.lit(mark), F.array_join(ws, f" {mark}")), " ")).otherwise(F.array().cast("array<string>"))
    rows = rows.withColumns({"_full_words": F.array_distinct(words(F.col("_full"))), "_title_words": F.array_distinct(words(F.col("_title")))})
    rows = rows.withColumn("_probe_words", F.array_distinct(F.concat("_title_words", words(F.col("_domains")), words(F.col("_skills")))))
    rows = rows.select(*key, "_title", "_place", F.concat_ws("\x00", "_domains", "_title", "_skills").alias("_probe"), "_full",
                       F.size("_full_words").alias("_n_tokens"), "_full_words", F.concat(
                           marked(F.col("_probe_words"), PROBE), marked(F.col("_title_words"), TITLE),
                           marked(F.array_distinct(words(F.col("_place"))), PLACE)).alias("_marked"))
    return spread_input(land(rows, "match-postings"))


def _by_token(contexts: DataFrame, needles: DataFrame) -> DataFrame:
    """Per marked token: fids that finding it settles, and strings still to be compared.

    The needles of a token are found once for all postings that have it. What a title, a place or the rest has
    for tokens, the whole text has too.
    """
    vocabulary = contexts.select(F.explode("_full_words").alias("word")).distinct()
    inner, whole = needles.where("not whole").drop("whole"), needles.where("whole").drop("whole")
    sizes = inner.agg(F.collect_set(F.length("needle")).alias("sizes"), F.coalesce(F.max(F.length("needle")), F.lit(1)).alias("most"))
    cut = vocabulary.join(F.broadcast(sizes)).select("word", "sizes", F.explode(F.when(
        F.length("word") <= WINDOW, F.array("word")).otherwise(F.transform(
            F.sequence(F.lit(0), F.floor((F.length("word") - 1) / WINDOW).cast("int")),
            lambda i: F.substr(F.col("word"), i * WINDOW + 1, F.col("most") + F.lit(WINDOW - 1))))).alias("piece"))
    sized = cut.select("word", "piece", F.explode("sizes").alias("n")).where(F.col("n") <= F.length("piece"))
    subs = sized.select("word", "n", "piece", F.explode(F.sequence(F.lit(1), F.length("piece") - F.col("n") + 1)).alias("i")).select(
        "word", F.substr(F.col("piece"), F.col("i"), F.col("n")).alias("needle"))
    size = F.length("needle") + F.length(F.coalesce("value", F.lit(""))) + 64
    found = subs.join(_small(inner, size), "needle").unionByName(vocabulary.select("word", F.col("word").alias("needle")).join(_small(whole, size), "needle"))
    return land(found.groupBy(F.concat("place", "word").alias("token")).agg(
        F.collect_list(F.when(F.col("value").isNull(), F.col("fid"))).alias("fids"),
        F.collect_list(F.when(F.col("value").isNotNull(), F.struct("place", "fid", "as_run", "value"))).alias("strings")), "match-tokens")


def _holds(s: Column, whole_word: bool) -> Column:
    """Whether the posting holds a string where it is looked for."""
    at = lambda place, text: ~s["as_run"] & (s["place"] == place) & F.contains(text, s["value"])
    out = at(FULL, F.col("_full")) | at(PROBE, F.col("_probe")) | at(TITLE, F.col("_title")) | at(PLACE, F.col("_place"))
    if whole_word:
        runs = F.array_join(F.transform(F.split("_probe", "\x00"), _run), "\x00")
        at = lambda place, text: s["as_run"] & (s["place"] == place) & F.contains(text, s["value"])
        out = out | at(FULL, _run(F.col("_full"))) | at(PROBE, runs)
    return out


def _verified(contexts: DataFrame, key: list[str], maybe: DataFrame, index: QueryIndex) -> DataFrame:
    """key, _n_tokens, verified: the features of a posting that hold whole strings."""
    weight = F.length("token") + F.aggregate("strings", F.lit(48), lambda n, s: n + 32 + F.length(s["value"]))
    asked = (contexts.select(*key, F.explode(F.concat("_full_words", "_marked")).alias("token")).join(_small(maybe, weight), "token")
             .select(*key, F.explode("strings").alias("s")).groupBy(*key).agg(F.collect_set("s").alias("asked")))
    texts = contexts.select(*key, "_n_tokens", "_title", "_place", "_probe", "_full")
    fids = lambda c: F.transform(F.filter(c, lambda s: _holds(s, index.whole_word)), lambda s: s["fid"])
    out = texts.join(asked, key).select(*key, "_n_tokens", fids("asked").alias("verified"))
    # strings without a token, if any, have no needle: they are compared with every posting in its row
    always = index.needles.where("needle is null")
    if not always.isEmpty():
        one = always.agg(F.collect_list(F.struct("place", "fid", "as_run", "value")).alias("strings"))
        out = out.unionByName(texts.join(F.broadcast(one)).select(*key, "_n_tokens", fids("strings").alias("verified")))
    return out.where(F.size("verified") > 0)


def _pairs(contexts: DataFrame, key: list[str], index: QueryIndex) -> DataFrame:
    """key, _n_tokens, q, words_terms, near_flags: what every query hits in every posting, where it hits anything.

    words_terms holds whole words in its lower and terms in its upper half; near_flags holds title, place and
    phrase as bits, and terms in the title, skills and domains in its upper half.
    """
    by_token = _by_token(contexts, index.needles.where("needle is not null"))
    sure, maybe = by_token.where(F.size("fids") > 0).select("token", "fids"), by_token.where(F.size("strings") > 0).select("token", "strings")
    verified = land(_verified(contexts, key, maybe, index), "match-verified")
    tokens = contexts.select(*key, "_n_tokens", F.explode(F.concat("_full_words", "_marked")).alias("token"))
    found = tokens.join(_small(sure, F.length("token") + 48 + 8 * F.size("fids")), "token").select(*key, "_n_tokens", "fids").unionByName(
        verified.select(*key, "_n_tokens", F.col("verified").alias("fids")))
    # by posting from here on, one row per token until then: what follows needs no further exchange while the index travels
    features = found.repartition(*key).select(*key, "_n_tokens", F.explode("fids").alias("fid")).groupBy(*key, "fid").agg(
        F.max("_n_tokens").alias("_n_tokens"))
    hits = features.join(_small(index.lists, 32 + 24 * F.size("hits")), "fid").select(*key, "_n_tokens", F.explode("hits").alias("h"))
    return hits.groupBy(*key, F.col("h.q").alias("q")).agg(
        F.max("_n_tokens").alias("_n_tokens"), F.sum("h.words_terms").alias("words_terms"), F.sum("h.near_flags").alias("near_flags"))


def _total(row) -> Column:
    """The weighted sum of one pair."""
    return (row("title_s") * 0.35 + row("domain_s") * 0.25 + row("place_s") * 0.10 + row("overlap_s") * 0.20 + row("similar_s") * 0.10
            + row("phrase_s") * 0.10)


def _features(pairs: DataFrame) -> DataFrame:
    """Pairs with their query's figures, as shares."""
    low = lambda c: F.col(c).bitwiseAND(COUNT - 1).cast("double")
    high = lambda c: F.shiftright(F.col(c), 32).cast("double")
    hit = lambda bit: F.when(F.col("near_flags").bitwiseAND(bit) != 0, 1.0).otherwise(0.0)
    words = low("words_terms")
    return pairs.withColumns({
        "title_s": hit(TITLE_HIT), "place_s": hit(PLACE_HIT), "phrase_s": hit(PHRASE_HIT), "domain_s": high("near_flags") / F.col("n_terms"),
        "overlap_s": high("words_terms") / F.col("n_terms"),
        "similar_s": F.when(words == 0, 0.0).otherwise(words / (F.col("n_tokens") + F.col("_n_tokens") - words))})


def _score(pairs: DataFrame) -> DataFrame:
    """Pairs with `_best`: the score, then the first query; what else is known of the pair comes along."""
    rows = _features(pairs)
    return rows.withColumn("_best", F.struct(
        (F.rint(_total(F.col) * 100.0 * 100.0) / 100.0).alias("best_query_score"), (-F.col("query_ord")).alias("neg_ord"), "q",
        "title_s", "place_s", "phrase_s", "domain_s", "overlap_s", "similar_s"))


def _public(best: Column, text: Column, s: Settings) -> Column:
    passed = _total(best.getField) >= s.match_score
    matched = passed | ((best["title_s"] >= 1) & (best["overlap_s"] >= s.match_title_overlap)) | (best["overlap_s"] >= s.match_overlap)
    return F.struct(
        matched.alias("matched"), text.alias("best_query"), (-best["neg_ord"]).alias("query_ord"), best["best_query_score"].alias("best_query_score"),
        t.round_to(best["similar_s"], 4).alias("best_query_similarity"), best["title_s"].alias("best_query_title_score"),
        t.round_to(best["domain_s"], 4).alias("best_query_domain_score"), best["place_s"].alias("best_query_location_score"),
        t.round_to(best["overlap_s"], 4).alias("best_query_term_overlap"),
        F.when(passed, "passed threshold").otherwise("below threshold").alias("decision_reason"))


def match_by_index(postings: DataFrame, index: QueryIndex, key: list[str], settings: Settings, matched_only: bool = False) -> DataFrame:
    """Postings with the evaluation of their best query in `query_match` and its profile in `_pid`; see `match_queries`."""
    info = _small(index.queries, F.length(F.coalesce("text", F.lit(""))) + F.length("pid") + 64)
    figures = info.select("q", "pid", "query_ord", "n_terms", "n_tokens")
    pairs = _pairs(_contexts(postings, key), key, index)
    best = _score(pairs.join(figures, "q")).groupBy(*key, "pid").agg(F.max("_best").alias("_best"))
    texts = info.select(F.col("q").alias("_q"), "text")
    if matched_only:
        rows = postings.join(best, key)
    else:
        zero = F.lit(0).cast("long")
        firsts = _score(index.queries.where("first").withColumns({"words_terms": zero, "near_flags": zero, "_n_tokens": F.lit(0)}))
        every = firsts.agg(F.collect_list(F.struct("pid", F.col("_best").alias("_first"))).alias("_firsts"))
        rows = postings.join(F.broadcast(every)).withColumn("_f", F.explode("_firsts"))
        rows = rows.select(*postings.columns, F.col("_f.pid").alias("pid"), F.col("_f._first").alias("_first")).join(best, [*key, "pid"], "left")
        # at a score of 0 the first query wins even if it was hit nowhere
        hit = F.col("_best").isNotNull() & ((F.col("_best.best_query_score") > 0) | (F.col("_best.neg_ord") >= F.col("_first.neg_ord")))
        rows = rows.withColumn("_best", F.when(hit, F.col("_best")).otherwise(F.col("_first")))
    rows = rows.join(texts, F.col("_best.q") == F.col("_q")).withColumn("query_match", _public(F.col("_best"), F.col("text"), settings))
    if matched_only:
        rows = rows.where("query_match.matched")
    return rows.select(*postings.columns, F.col("pid").alias("_pid"), "query_match")
