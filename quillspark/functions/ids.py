"""Identifiers from content, so that repeated tasks and runs give the same ones."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def content_id(prefix: str, *parts: Column | str) -> Column:
    """PREFIX-xxxxxxxxxxxx from the parts' values; null parts count as empty."""
    cols = [F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("")) for p in parts]
    return F.concat(F.lit(f"{prefix}-"), F.substring(F.sha2(F.concat_ws("|", *cols), 256), 1, 12))
