"""Columns by their exact names, whatever further columns a table has."""

from __future__ import annotations

from pyspark.sql import DataFrame


def place(df: DataFrame, name: str) -> int:
    """Position of the column ``name``: the first of exactly that name, else the only one that differs in case."""
    if name in df.columns:
        return df.columns.index(name)
    like = [i for i, c in enumerate(df.columns) if c.lower() == name.lower()]
    if len(like) != 1:
        raise ValueError(f"no column {name} in {df.columns}")
    return like[0]


def pick(df: DataFrame, *names: str) -> DataFrame:
    """These columns only. Other columns may differ from them in case alone, repeat, or hold dots and backticks."""
    marks = [f"c{i}" for i in range(len(df.columns))]
    return df.toDF(*marks).select(*[marks[place(df, name)] for name in names]).toDF(*names)
