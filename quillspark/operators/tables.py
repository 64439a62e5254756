"""Table maintenance without MERGE: the new state of a table as a DataFrame; ``sources.versioned`` keeps such states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordering import first_per_key, latest_per_key


def upsert(base: DataFrame, changes: DataFrame, keys: list[str], order: list[Column] | None = None) -> DataFrame:
    """Changed rows replace those of equal keys; others are added. Of changes with one key the last by ``order`` counts.

    Without an order that is the one with the greatest other values, so that the outcome does not depend on the plan.
    """
    changes = latest_per_key(changes, keys, order or [F.col(c) for c in changes.columns if c not in keys])
    return base.join(changes.select(*keys).distinct(), keys, "left_anti").unionByName(changes)


def replace_groups(base: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """All rows of every key in ``rows`` are replaced (delete, then insert)."""
    return base.join(rows.select(key).distinct(), key, "left_anti").unionByName(rows)


def insert_or_ignore(base: DataFrame, rows: DataFrame, keys: list[str], must_exist: DataFrame | None = None, on: str | None = None) -> DataFrame:
    """Adds rows of new keys, each once; with ``must_exist``, only those whose ``on`` it knows. Of rows with one key the first by
    the other values stays."""
    if must_exist is not None:
        rows = rows.join(must_exist.select(on).distinct(), on, "left_semi")
    rest = [F.col(c) for c in rows.columns if c not in keys]
    once = first_per_key(rows, keys, rest) if rest else rows.distinct()
    return base.unionByName(once.join(base.select(*keys), keys, "left_anti"))


def patch(base: DataFrame, changes: DataFrame, key: str, columns: list[str], null_is_value: bool = False) -> DataFrame:
    """Partial update of whitelisted columns; a null of the patch is ignored unless it is a value. Of patches with one key
    that with the greatest values counts."""
    changes = latest_per_key(changes.select(key, *columns), [key], [F.col(c) for c in columns])
    renamed = changes.select(key, F.lit(True).alias("_hit"), *(F.col(c).alias(f"_{c}") for c in columns))
    out = base.join(renamed, key, "left")

    def value(c: str) -> Column:
        if null_is_value:
            return F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c))
        return F.coalesce(f"_{c}", c)

    return out.withColumns({c: value(c) for c in columns}).select(*base.columns)


def delete_cascade(parents: DataFrame, children: DataFrame, gone: DataFrame, key: str, link: str) -> tuple[DataFrame, DataFrame]:
    """Parents without those of the keys in ``gone``, and children without those of deleted parents."""
    dead = parents.join(gone.select(key).distinct(), key, "left_semi").select(link).distinct()
    return parents.join(dead, link, "left_anti"), children.join(dead, link, "left_anti")
