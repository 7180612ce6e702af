"""A caller's model asked about shortlisted rows in batches; answers checked, failed rows asked again one by one."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from rolescope.operators.ranking import attach_assessments, final_scores, preliminary, score_table, shortlist
from rolescope.plans.spread import first_per_key, rank_rows
from rolescope.settings import Settings

Client = Callable[[list[dict]], list]  # rows in, one answer per row out: a JSON text, a dict or None
ANSWER = "payload string, attempts int, error string, seconds double"


def _checked(answer) -> tuple[str | None, str | None]:
    """(payload, error): only a JSON object counts as an answer."""
    if isinstance(answer, dict):
        return json.dumps(answer), None
    try:
        whole = isinstance(json.loads(answer), dict)
    except (TypeError, ValueError):
        whole = False
    return (answer, None) if whole else (None, "answer is no JSON object")


def _called(client: Client, rows: list[dict]) -> list[tuple[str | None, str | None]]:
    """Answers of one call; an exception or a wrong number of answers counts against all of its rows."""
    try:
        answers = list(client(rows))
    except Exception as e:  # the client is the caller's code: its failure is a row's result, not the job's
        return [(None, f"{type(e).__name__}: {e}")] * len(rows)
    if len(answers) != len(rows):
        return [(None, f"{len(answers)} answers to {len(rows)} rows")] * len(rows)
    return [_checked(a) for a in answers]


def _asked(client: Client, rows: list[dict], retries: int) -> list[tuple]:
    """(payload, attempts, error, seconds) per row: one call for all, then up to `retries` calls per failed row."""
    began = time.perf_counter()
    first = _called(client, rows)
    share = (time.perf_counter() - began) / max(len(rows), 1)
    out = []
    for row, (payload, error) in zip(rows, first):
        attempts, began = 1, time.perf_counter()
        while payload is None and attempts <= retries:
            payload, error = _called(client, [row])[0]
            attempts += 1
        out.append((payload, attempts, error, share + time.perf_counter() - began))
    return out


def ask_model(rows: DataFrame, client: Client, key: list[str], columns: list[str], batch: int = 16, retries: int = 2) -> DataFrame:
    """(key, payload, attempts, error, seconds) per row: what the client made of the row's `columns`.

    `client` travels to the tasks with the plan. It gets at most `batch` rows as dicts (nulls as None, arrays as
    lists) and never sees another column. A row without a usable answer has a null payload and the last error.
    No rows in, no call.
    """
    def answer(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), batch):
                piece = frame.iloc[at:at + batch]
                said = _asked(client, [json.loads(x) for x in piece["_row"]], retries)
                made = pd.DataFrame(said, columns=["payload", "attempts", "error", "seconds"], index=piece.index)
                yield pd.concat([piece[key], made], axis=1)

    asked = rows.select(*key, F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("_row"))
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in key)
    return asked.mapInPandas(answer, f"{kinds}, {ANSWER}")


def ask_in_parts(
    rows: DataFrame, client: Client, key: list[str], columns: list[str], target: str, parts: int = 8, batch: int = 16,
    retries: int = 2, on_partial: Callable[[DataFrame, int], None] | None = None,
) -> DataFrame:
    """`ask_model` with its answers written below `target` part by part; a later run asks only what has no answer there.

    Rows fall into parts by a hash of their key. `on_partial` is called with the written answers of each part and its
    number. A part that was cut off left nothing that is read: a part shows up when its write is committed.
    `target` belongs to one client and one set of columns.
    """
    spark = rows.sparkSession
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in key)
    schema = f"{kinds}, {ANSWER}"
    marked = rows.withColumn("_part", F.pmod(F.xxhash64(*key), F.lit(parts)))
    spark.createDataFrame([], schema).write.mode("append").parquet(target)  # so that the first read finds a table
    for part in range(parts):
        known = spark.read.schema(schema).parquet(target).where("payload IS NOT NULL").select(*key)
        own = marked.where(F.col("_part") == part)
        open_rows = own.join(known, key, "left_anti").drop("_part").repartition(*key)
        ask_model(open_rows, client, key, columns, batch, retries).write.mode("append").parquet(target)
        if on_partial is not None:
            answers = _last_answers(spark.read.schema(schema).parquet(target), key)
            on_partial(answers.join(own.select(*key), key, "left_semi"), part)
    return _last_answers(spark.read.schema(schema).parquet(target), key).join(rows.select(*key), key, "left_semi")


def _last_answers(answers: DataFrame, key: list[str]) -> DataFrame:
    """One row per key: its answer where some run got one, else an error. One key has as many rows as runs."""
    return first_per_key(answers, key, [F.col("payload").isNull(), "payload", "error"])


def rank_with_model(
    scored: DataFrame, client: Client, columns: list[str], target: str, settings: Settings = Settings(), ord_col: str = "ord",
    parts: int = 8, batch: int = 16, retries: int = 2, on_partial: Callable[[DataFrame, int], None] | None = None,
) -> DataFrame:
    """`ranking.rank_postings` with the shortlist's answers from a client; rows without one keep the heuristic label.

    `on_partial` gets the scored rows of each part's postings as soon as they have answers.
    """
    prelim = preliminary(score_table(scored))
    short = shortlist(prelim, settings, ord_col)
    asked = first_per_key(prelim.join(short, ["profile_id", "id"], "left_semi"), ["profile_id", "id"], [ord_col])

    def partial(answers: DataFrame, part: int) -> None:
        rows = prelim.join(answers.select("profile_id", "id"), ["profile_id", "id"], "left_semi")
        on_partial(final_scores(attach_assessments(rows, short, answers)), part)

    answers = ask_in_parts(asked, client, ["profile_id", "id"], columns, target, parts, batch, retries, partial if on_partial else None)
    rows = final_scores(attach_assessments(prelim, short, answers))
    return rank_rows(rows, ["profile_id"], [("overall_score", True), ("preliminary_score", True)], ord_col)
