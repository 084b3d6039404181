"""Column names that no column of a table has."""

from __future__ import annotations

from pyspark.sql import DataFrame


def free(base: str, *frames: DataFrame) -> str:
    """base, with as many underscores after it as it takes to differ (whatever the case) from all columns."""
    taken = {c.lower() for f in frames for c in f.columns}
    while base.lower() in taken:
        base += "_"
    return base
