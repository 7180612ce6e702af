"""Best search query per posting.

A naive form pairs every posting with every query as rows. Query sets of a bounded, checked size travel to the
tasks instead: each posting is evaluated in its own row, in Arrow batches, with no join and no shuffle of texts.
Terms are tested against the posting's distinct tokens instead of its whole text, which finds the same
substrings because a term made of token characters can only lie inside one token. Larger sets are never
collected: they become an inverted index (`query_index`) that meets the postings' tokens in joins. Both ways
read the postings' texts once and give the same rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from rolescope.functions import text as t
from rolescope.functions.batches import in_slices
from rolescope.functions.query_kernel import Limits, query_set
from rolescope.operators.query_index import match_by_index, prepare_queries
from rolescope.settings import Settings

BLOCK_QUERIES = 4096        # queries that may travel to the tasks
BLOCK_BYTES = 8 << 20        # and the bytes of their texts, terms, titles and locations
SLICE = 256                 # postings that are Python objects at a time


def _query_structs(queries: DataFrame) -> DataFrame:
    columns = queries.columns
    profile = F.col("profile_id") if "profile_id" in columns else F.lit("")
    terms = F.coalesce(F.col("terms"), F.array().cast("array<string>"))
    terms = F.when(F.size(terms) > 0, terms).otherwise(t.tokenise("text"))

    def probe(name: str) -> Column:
        if name not in columns:
            return F.lit(None).cast("string")
        return F.when(F.col(name) != "", t.normalize_text(name))

    return queries.select(
        profile.cast("string").alias("pid"),
        F.col("query_ord").cast("long").alias("query_ord"),
        F.struct(
            F.col("query_ord").cast("long").alias("ord"),
            F.col("text"),
            t.normalize_text("text").alias("text_n"),
            probe("title").alias("title_n"),
            probe("location").alias("location_n"),
            terms.alias("terms"),
            F.array_distinct(terms).alias("term_set"),
            t.token_set("text").alias("tokens"),
        ).alias("q"),
    )


def _posting_context() -> Column:
    lists = F.concat(
        F.coalesce(F.col("required_skills"), F.array()), F.coalesce(F.col("preferred_skills"), F.array())
    ).cast("array<string>")
    domains = F.array_join(F.coalesce(F.col("domain_signals"), F.array().cast("array<string>")), " ")
    skills = F.array_join(lists, " ")
    title, place = t.text_or_empty("title"), t.text_or_empty("location")
    full = F.concat_ws(
        " ", title, t.text_or_empty("company"), place, domains, skills, t.text_or_empty("description")
    )
    probe = F.concat_ws("\x00", t.normalize_text(domains), t.normalize_text(title), t.normalize_text(skills))
    return t.let(
        t.normalize_text(full),
        lambda text: t.let(
            F.array_distinct(F.regexp_extract_all(text, F.lit(t.TOKEN), F.lit(0))),
            lambda tokens: F.struct(
                t.normalize_text(title).alias("title"),
                t.normalize_text(place).alias("location"),
                probe.alias("probe"),
                text.alias("full"),
                F.concat(F.lit(" "), F.array_join(tokens, " "), F.lit(" ")).alias("words"),
                F.size(tokens).alias("n_tokens"),
            ),
        ),
    )


BEST = (
    "best_query_score double, neg_ord bigint, matched boolean, best_query string, "
    "best_query_similarity double, best_query_title_score double, best_query_domain_score double, "
    "best_query_location_score double, best_query_term_overlap double, decision_reason string"
)


def _evaluator(block: DataFrame, whole_word: bool, s: Settings):
    """Arrow UDF over the context columns for a bounded set of queries."""
    rows = [{"pid": r.pid, **r.q.asDict()} for r in block.collect()]
    shared = block.sparkSession.sparkContext.broadcast(rows)
    limits = Limits(s.match_score, s.match_title_overlap, s.match_overlap)

    token = uuid.uuid4().hex

    def evaluate(batches):
        known = query_set(token, shared.value, limits, whole_word)
        return in_slices(batches, SLICE, known.best, FOUND)

    # annotations as objects: the evaluator is chosen from them
    evaluate.__annotations__ = {
        "batches": Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array, pa.Array, pa.Array]],
        "return": Iterator[pa.Array],
    }
    return F.arrow_udf(evaluate, f"array<struct<pid: string, best: struct<{_typed(BEST)}>>>")


def _typed(columns: str) -> str:
    return ", ".join(": ".join(part.strip().split(" ")) for part in columns.split(","))


_ARROW = {"double": pa.float64(), "bigint": pa.int64(), "boolean": pa.bool_(), "string": pa.string()}
FOUND = pa.list_(pa.struct({"pid": pa.string(), "best": pa.struct(
    [(name, _ARROW[kind]) for name, kind in (part.strip().split(" ") for part in BEST.split(","))])}))


def _unfiltered(postings: DataFrame) -> DataFrame:
    return postings.withColumn(
        "query_match",
        F.struct(
            F.lit(True).alias("matched"), F.lit(None).cast("string").alias("best_query"),
            F.lit(None).cast("long").alias("query_ord"),
            F.lit(100.0).alias("best_query_score"), F.lit(1.0).alias("best_query_similarity"),
            F.lit(100.0).alias("best_query_title_score"), F.lit(100.0).alias("best_query_domain_score"),
            F.lit(100.0).alias("best_query_location_score"), F.lit(1.0).alias("best_query_term_overlap"),
            F.lit("no queries configured").alias("decision_reason"),
        ),
    )


def _public(best: Column) -> Column:
    return F.struct(
        best["matched"].alias("matched"), best["best_query"].alias("best_query"),
        (-best["neg_ord"]).alias("query_ord"),
        *[best[n].alias(n) for n in (
            "best_query_score", "best_query_similarity", "best_query_title_score",
            "best_query_domain_score", "best_query_location_score", "best_query_term_overlap",
            "decision_reason")],
    )


class PreparedQueries(NamedTuple):
    """A query set made ready once, for any number of posting tables or batches of a stream."""

    find: Callable[[DataFrame, list[str], Settings, bool], DataFrame] | None  # None without queries
    per_profile: bool


def prepare(queries: DataFrame, settings: Settings = Settings(), whole_word: bool = False, block_queries: int = BLOCK_QUERIES) -> PreparedQueries:
    """What `match_queries` needs of a query table: a bounded set is sent to the tasks, a larger one is indexed."""
    per_profile = "profile_id" in queries.columns
    bytes_of = lambda c: F.coalesce(F.octet_length(c), F.lit(0)) if c in queries.columns else F.lit(0)
    each = bytes_of("text") + bytes_of("title") + bytes_of("location") + F.coalesce(
        F.aggregate("terms", F.lit(0), lambda n, x: n + F.coalesce(F.octet_length(x), F.lit(0))), F.lit(0))
    n_queries, n_bytes = queries.agg(F.count("*"), F.coalesce(F.sum(each), F.lit(0))).first()
    if n_queries == 0:
        return PreparedQueries(None, per_profile)
    if n_queries > block_queries or n_bytes > BLOCK_BYTES:
        index = prepare_queries(queries, whole_word, block_queries)
        return PreparedQueries(lambda postings, key, s, matched_only: match_by_index(postings, index, key, s, matched_only), per_profile)
    evaluator = _evaluator(_query_structs(queries), whole_word, settings)

    def in_row(postings: DataFrame, key: list[str], s: Settings, matched_only: bool) -> DataFrame:
        found = postings.withColumn("_ctx", _posting_context()).withColumn("_found", evaluator(*[
            F.col(f"_ctx.{n}") for n in ("title", "location", "probe", "full", "words", "n_tokens")]))
        # explode_outer: plain explode would infer a filter that evaluates the expression again
        return found.withColumn("_f", F.explode_outer("_found")).select(
            *postings.columns, F.col("_f.pid").alias("_pid"), _public(F.col("_f.best")).alias("query_match"))

    return PreparedQueries(in_row, per_profile)


def match_queries(
    postings: DataFrame,
    queries: DataFrame | PreparedQueries,
    key: list[str],
    settings: Settings = Settings(),
    whole_word: bool = False,
    matched_only: bool = False,
    block_queries: int = BLOCK_QUERIES,
) -> DataFrame:
    """Postings with the evaluation of their best query in `query_match`.

    Of equal scores the first query wins; a posting that no query hits has its first query with a score of 0.
    With a `profile_id` column in `queries`, one row per (posting, profile); with `matched_only` only those
    that pass. `key` names the columns that identify a posting row. Sets of more than `block_queries` queries
    or BLOCK_BYTES take the index. A set that `prepare` made ready has its options fixed there.
    """
    ready = queries if isinstance(queries, PreparedQueries) else prepare(queries, settings, whole_word, block_queries)
    if ready.find is None:
        out = _unfiltered(postings)
        return out.withColumn("profile_id", F.lit(None).cast("string")) if ready.per_profile else out
    rows = ready.find(postings, key, settings, matched_only)
    rows = rows.withColumnRenamed("_pid", "profile_id") if ready.per_profile else rows.drop("_pid")
    return rows.where("query_match.matched") if matched_only else rows


def split_by_match(evaluated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, rejected) postings; persist the input first when both sides are read."""
    return evaluated.where("query_match.matched"), evaluated.where(~F.col("query_match.matched"))
