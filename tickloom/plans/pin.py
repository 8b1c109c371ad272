"""Columns computed once per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pin(rows: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that later steps read as they are.

    A filter on an ordinary computed column is rewritten in terms of its inputs and moved
    down; chains of long text expressions then multiply. The columns are computed in a plain
    projection, and a one-row ``inline`` above it keeps filters from moving below.
    """
    computed = rows.withColumns(columns)
    row = F.struct(*[F.col(name) for name in columns])
    kept = [c for c in rows.columns if c not in columns]
    return computed.select(*kept, F.inline(F.array(row)))
