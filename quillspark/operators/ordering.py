"""First-wins, latest-wins and neighbour operators; the order is always explicit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key by the order (min_by over a struct combines before the shuffle)."""
    rank = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), rank).alias("_row"))
    return best.select(*keys, "_row.*").select(*df.columns)


def latest_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key by the order."""
    rank = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), rank).alias("_row"))
    return best.select(*keys, "_row.*").select(*df.columns)


def top(df: DataFrame, n: int, order: list[Column]) -> DataFrame:
    """The first n rows (each task keeps n, then they merge)."""
    return df.orderBy(*order).limit(n)


def rank_score(position: Column) -> Column:
    """1.00, 0.99, ... from a position that starts at 1."""
    return F.round(1.0 - 0.01 * (position - 1), 2)


def with_neighbours(df: DataFrame, keys: list[str], order: list[Column], column: str) -> DataFrame:
    """Adds previous_<column> and next_<column> within a key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumns({f"previous_{column}": F.lag(column).over(w), f"next_{column}": F.lead(column).over(w)})


def next_number(existing: DataFrame, key: str, number: str) -> DataFrame:
    """(key, next): MAX + 1 per key."""
    return existing.groupBy(key).agg((F.coalesce(F.max(number), F.lit(0)) + 1).cast("long").alias("next_number"))


def upper_median(values: Column) -> Column:
    """Element floor(n / 2) of the sorted values; not the interpolated percentile."""
    return F.get(F.sort_array(values), F.floor(F.size(values) / 2).cast("int"))


def within_budget(df: DataFrame, key: str, order: list[Column], size: Column, budget: int) -> DataFrame:
    """Rows of each key until the running size reaches the budget; ``room`` is what a row may still take."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(size).over(w), F.lit(0))
    return df.withColumn("room", (F.lit(budget) - before).cast("long")).where("room > 0")


def running_mean_clusters(values: Column, tolerance: Column) -> Column:
    """array<int>: cluster number of each value of an ascending array.

    A value joins the current cluster while it lies within the tolerance of that cluster's mean so far, which moves, so
    this is a fold and not a gap session.
    """
    zero = F.struct(F.array().cast("array<int>").alias("ids"), F.lit(-1).alias("at"), F.lit(0.0).alias("total"), F.lit(0).alias("n"))

    def step(acc: Column, x: Column) -> Column:
        new = (acc["n"] == 0) | (F.abs(x - acc["total"] / F.greatest(acc["n"], F.lit(1))) > tolerance)
        at = acc["at"] + new.cast("int")
        return F.struct(
            F.concat(acc["ids"], F.array(at)).alias("ids"), at.alias("at"),
            F.when(new, x).otherwise(acc["total"] + x).alias("total"), F.when(new, 1).otherwise(acc["n"] + 1).alias("n"),
        )

    return F.aggregate(F.transform(values, lambda x: x.cast("double")), zero, step, lambda acc: acc["ids"])
