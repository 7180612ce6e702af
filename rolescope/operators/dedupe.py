"""First-wins deduplication, near-duplicate removal, freshness and change detection."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from rolescope.functions import text as t
from rolescope.plans.spread import first_per_key, salted_join, spread_input
from rolescope.session import land


def first_per_value(rows: DataFrame, group: list[str], value: str, ord_col: str) -> DataFrame:
    """Table form of the ordered distinct: first row per normalized value, blanks dropped."""
    keyed = rows.withColumn("_key", t.normalize_text(value)).where(F.col("_key") != "")
    return first_per_key(keyed, [*group, "_key"], [ord_col]).drop("_key").withColumn(value, t.strip(value))



def dedupe_postings(postings: DataFrame, order: list[str]) -> DataFrame:
    """First posting per source, id and application (or source) url; other sources keep theirs."""
    keyed = postings.withColumn("_url", F.coalesce(t.first_filled("application_url", "source_url"), F.lit("")))
    return first_per_key(keyed, ["source", "id", "_url"], order).drop("_url")


def merge_by_url(existing: DataFrame, incoming: DataFrame, ord_col: str = "ord") -> DataFrame:
    """Existing rows, then incoming rows with a source_url not seen before."""
    rows = existing.withColumn("_late", F.lit(0)).unionByName(incoming.withColumn("_late", F.lit(1)))
    fresh = rows.where("_late = 1").join(existing.select("source_url"), "source_url", "left_anti")
    first = first_per_key(fresh.select(*rows.columns), ["source_url"], [ord_col])
    return rows.where("_late = 0").unionByName(first).drop("_late")


def _overlap_bound(n: str, at: str, other_n: str, other_at: str) -> Column:
    """Most tokens two sets can share if the token at these places, counted from 1, is the first that they share."""
    return F.lit(1) + F.least(F.col(n) - F.col(at), F.col(other_n) - F.col(other_at))


def _near(left: DataFrame, right: DataFrame, by: list[str], threshold: float) -> DataFrame:
    """(by, _a, _b): pairs of an earlier row of `left` and a later one of `right` whose token sets are near.

    Rows are prefix entries (by, _t, ord, _n, _at, _set). Sizes and places exclude most pairs before sets are
    compared, and a pair is compared at its first common prefix token only.
    """
    a, b = ([F.col(c) for c in by] + [F.col("_t")] + [F.col(c).alias(c + x) for c in ("_ord", "_n", "_at", "_set")] for x in "ab")
    pairs = left.select(*a).join(right.select(*b), [*by, "_t"]).where(F.col("_orda") < F.col("_ordb"))
    least = F.ceil((F.col("_na") + F.col("_nb")) * (threshold / (1.0 + threshold)) - 1e-9)
    fits = (F.least("_na", "_nb") >= F.ceil(F.greatest("_na", "_nb") * threshold - 1e-9)) & (_overlap_bound("_na", "_ata", "_nb", "_atb") >= least)
    # sets list their tokens rarest first, so the slices before the token are what the prefixes hold before it
    first = ~F.arrays_overlap(F.slice("_seta", F.lit(1), F.col("_ata") - 1), F.slice("_setb", F.lit(1), F.col("_atb") - 1))
    common = F.size(F.array_intersect("_seta", "_setb")).cast("double")
    found = pairs.where(fits).where(first).where(common / (F.col("_na") + F.col("_nb") - common) >= threshold)
    return found.select(*by, F.col("_orda").alias("_a"), F.col("_ordb").alias("_b"))


def _first_independent(pairs: DataFrame, by: list[str]) -> DataFrame:
    """(by, _b): the rows that go if rows come in order and each goes that is near an earlier one that stays.

    A round keeps every row without an earlier neighbour that is still open, and drops the neighbours of those.
    """
    open_pairs, gone = land(pairs, "near-pairs"), []
    while not open_pairs.isEmpty():  # the earliest open row is always kept, so every round settles some
        later = open_pairs.select(*by, F.col("_b").alias("_a")).distinct()
        kept = open_pairs.select(*by, "_a").distinct().join(later, [*by, "_a"], "left_anti")
        dropped = land(open_pairs.join(kept, [*by, "_a"], "left_semi").select(*by, "_b").distinct(), "near-dropped")
        gone.append(dropped)
        # pairs of a dropped row are settled on either side; a kept row's pairs all end in dropped rows
        open_pairs = land(open_pairs.join(dropped, [*by, "_b"], "left_anti")
                          .join(dropped.withColumnRenamed("_b", "_a"), [*by, "_a"], "left_anti"), "near-pairs")
    out = pairs.limit(0).select(*by, "_b")
    for part in gone:
        out = out.unionByName(part)
    return out


def near_duplicates(rows: DataFrame, text: str, ord_col: str, group: list[str] = (), threshold: float = 0.82) -> DataFrame:
    """Greedy near-duplicate removal over a whole table, as if rows came one by one in order.

    Equal token sets collapse first (the earliest always stands for them), so a large group of
    copies becomes one row. Two sets with Jaccard >= threshold share a token among their rarest
    ones, the prefix; rows meet by those. First every row that is the earliest of all it meets is
    kept and what is near it goes, so groups of near copies are settled without pairs among
    themselves. The rest is joined into true pairs, each compared once, and the rows that stay are
    the first independent set of that graph, found in rounds as long as its chains.
    Tokens are told apart by 64-bit hashes. Null texts are empty; rows without a token go only if
    an earlier one has the same text.
    """
    by = list(group)
    tokens = F.array_sort(F.transform(t.token_set(t.text_or_empty(text)), lambda x: F.xxhash64(x)))
    read = rows.select(*by, F.col(ord_col).alias("_ord"), t.normalize_text(t.text_or_empty(text)).alias("_norm"), tokens.alias("_set"))
    # equal texts have equal sets, so only rows without a token are told apart by their text
    read = read.withColumn("_norm", F.when(F.size("_set") == 0, F.col("_norm")).otherwise(""))
    firsts = land(first_per_key(read, [*by, "_set", "_norm"], ["_ord"]).drop("_norm"), "near-sets")
    # two different sets of n or more tokens share at most n / (n + 1); shorter sets are alone
    smallest = threshold / (1.0 - threshold) if threshold < 1.0 else float("inf")
    sets = spread_input(firsts.where(F.size("_set") >= F.lit(smallest) - 1e-9).where(F.size("_set") > 0))
    tokens = sets.select(*by, "_ord", F.explode("_set").alias("_t"))
    frequency = tokens.groupBy(*by, "_t").agg(F.count("*").alias("_df"))
    ordered = (salted_join(tokens, frequency, [*by, "_t"], ["_ord"]).groupBy(*by, "_ord")
               .agg(F.transform(F.array_sort(F.collect_list(F.struct("_df", "_t"))), lambda x: x["_t"]).alias("_set")))
    size = F.size("_set")
    prefix = F.slice("_set", F.lit(1), size - F.ceil(size * threshold - 1e-9).cast("int") + 1)  # a product of doubles may lie just above a whole number
    entries = land(ordered.select(*by, "_ord", size.alias("_n"), "_set", F.posexplode(prefix).alias("_at", "_t"))
                   .withColumn("_at", F.col("_at") + 1), "near-prefixes")

    first = entries.groupBy(*by, "_t").agg(F.min("_ord").alias("_first"))
    leads = (salted_join(entries.select(*by, "_t", "_ord"), first, [*by, "_t"], ["_ord"])
             .groupBy(*by, "_ord").agg(F.min((F.col("_first") == F.col("_ord")).cast("int")).alias("_lead")).where("_lead = 1").select(*by, "_ord"))
    leads = land(leads, "near-leads")
    of_leads, others = entries.join(leads, [*by, "_ord"], "left_semi"), entries.join(leads, [*by, "_ord"], "left_anti")
    near_leads = land(_near(of_leads, others, by, threshold).select(*by, F.col("_b").alias("_ord")).distinct(), "near-of-leads")
    rest = others.join(near_leads, [*by, "_ord"], "left_anti")
    dropped = _first_independent(_near(rest, rest, by, threshold), by).withColumnRenamed("_b", "_ord")
    keep = firsts.select(*by, "_ord").join(near_leads.unionByName(dropped), [*by, "_ord"], "left_anti").withColumnRenamed("_ord", ord_col)
    return rows.join(keep, [*by, ord_col], "left_semi")


def latest_within_ttl(rows: DataFrame, key: list[str], created: str, now: Column, ttl_hours: int,
                      tie: list[str] = ()) -> DataFrame:
    """Newest copy per key, if it is not older than the time to live."""
    fresh = rows.where(F.col(created) >= now - F.make_interval(hours=F.lit(ttl_hours)))
    return first_per_key(fresh, key, [F.col(created).desc(), *[F.col(c).desc() for c in tie]])


def fingerprint(*columns: str | Column, config: str = "") -> Column:
    parts = [F.coalesce(t.as_col(c).cast("string"), F.lit("\x00")) for c in columns]
    return F.sha2(F.concat_ws("\x1f", *parts, F.lit(config)), 256)


def changed_inputs(inputs: DataFrame, state: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose (key, fingerprint) is not in the state table of finished work."""
    return inputs.join(state, [*key, "fingerprint"], "left_anti")


def fresh_requests(rows: DataFrame, key: list[str], ts: str, gap_seconds: float) -> DataFrame:
    """Times kept per key when a request within the gap after the last kept one is suppressed.

    Whether a time is kept depends on the last kept one, so a key's times are walked in order:
    they are brought together, sorted on disk where needed, and streamed in Arrow batches that
    jump from kept time to kept time. A task holds one batch and one number, however long a key is.
    """
    seconds = F.col(ts).cast("timestamp").cast("double").alias("_s")
    ordered = (
        rows.select(*key, seconds).distinct().repartition(*key).sortWithinPartitions(*key, "_s")
    )

    def walk(batches):
        current, last = None, -np.inf
        for batch in batches:
            parts = []
            for k, times in batch.groupby(key, sort=False, dropna=False)["_s"]:
                if k != current:
                    current, last = k, -np.inf
                values, kept = times.to_numpy(), []
                at = np.searchsorted(values, last + gap_seconds)
                while at < len(values):
                    last = values[at]
                    kept.append(times.index[at])
                    at = max(at + 1, np.searchsorted(values, last + gap_seconds))
                parts.extend(kept)
            yield batch.loc[parts]

    return ordered.mapInPandas(walk, ordered.schema).select(*key, F.timestamp_seconds("_s").alias(ts))


def dedupe_fields(fields: Column) -> Column:
    """First form field per name, type and label."""
    return _first_by(fields, lambda f: F.concat_ws("::", f["name"], f["type"], F.coalesce(f["label"], F.lit(""))))


def dedupe_plans(plans: Column) -> Column:
    """First plan per set of (kind, value) pairs."""
    return _first_by(plans, lambda p: F.to_json(F.array_sort(F.map_entries(p))))


def dedupe_snapshots(rows: DataFrame, columns: list[str], ord_col: str = "ord") -> DataFrame:
    """First row per full equality of the snapshot columns."""
    return first_per_key(rows, columns, [ord_col])


def _first_by(items: Column, key) -> Column:
    return t.let(items, lambda rows: t.let(F.transform(rows, key), lambda keys: F.filter(
        rows, lambda _, i: F.array_position(keys, F.get(keys, i)) == i + 1)))
