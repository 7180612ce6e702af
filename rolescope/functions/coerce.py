"""Lenient reading of model output held as VARIANT."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from rolescope import fixed_values as V
from rolescope.functions import text as t


def _items(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "array<variant>")


def _kind(v: Column, path: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(v, path, "variant"))


def _scalar_text(value: Column) -> Column:
    return F.coalesce(F.try_variant_get(value, "$", "string"), F.to_json(value))


def as_list(v: Column, path: str) -> Column:
    """List of trimmed non-empty texts; a scalar becomes a list of one."""
    items = F.transform(_items(v, path), lambda x: t.strip(_scalar_text(x)))
    one = t.strip(F.try_variant_get(v, path, "string"))
    return (
        F.when(_items(v, path).isNotNull(), F.filter(items, lambda x: x.isNotNull() & (x != "")))
        .when(one.isNotNull() & (one != ""), F.array(one))
        .otherwise(F.array().cast("array<string>"))
    )


def as_text(v: Column, path: str) -> Column:
    """Trimmed text; a list is joined with "; "; null becomes ""."""
    listed = _items(v, path)
    return F.when(listed.isNotNull(), F.array_join(as_list(v, path), "; ")).otherwise(
        F.coalesce(t.strip(F.try_variant_get(v, path, "string")), F.lit("")))


def as_status(v: Column, path: str) -> Column:
    """One of the four statuses through the alias table, null when unknown."""
    key = F.lower(t.strip(F.try_variant_get(v, path, "string")))
    names = F.create_map(*[F.lit(x) for pair in V.STATUS_ALIASES.items() for x in pair])
    return F.when(_kind(v, path) == "STRING", F.try_element_at(names, key))


def as_confidence(v: Column, path: str, fallback: Column) -> Column:
    number = F.try_variant_get(v, path, "double")
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(number, fallback)))


def pick_evidence(evidence: Column, v: Column, path: str, most: int = 3) -> Column:
    """Evidence items named by zero-based indices; an index equal to the count is read one-based."""
    wanted = F.filter(
        F.transform(_items(v, path), lambda x: F.try_variant_get(x, "$", "int")),
        lambda i: i.isNotNull() & (i >= 0) & (i <= F.size(evidence)) & (F.size(evidence) > 0),
    )
    picked = F.transform(wanted, lambda i: F.get(
        evidence, F.when(i < F.size(evidence), i).otherwise(i - 1)))
    return F.when(_items(v, path).isNull(), F.slice(evidence, 1, most)).otherwise(F.slice(picked, 1, most))
