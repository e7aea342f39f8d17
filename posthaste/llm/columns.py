"""Carrying a caller's columns through an operator, whatever they are called."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def by_place(df: DataFrame, *needed: str) -> tuple[DataFrame, list[str]]:
    """The frame with its columns named ``c0, c1, ...``, and the new names of ``needed``."""
    lower = [c.lower() for c in df.columns]
    missing = [n for n in needed if n.lower() not in lower]
    if missing:
        raise ValueError(f"no column {', '.join(missing)}")
    return df.toDF(*[f"c{i}" for i in range(len(lower))]), [f"c{lower.index(n.lower())}" for n in needed]


def by_name(df: DataFrame, names: list[str], added: list[str]) -> DataFrame:
    """The first names back, and the added columns; of equal names the added one stays."""
    new = {a.lower() for a in added}
    return df.select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(names) if n.lower() not in new], *added)
