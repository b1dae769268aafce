"""A contiguous range of a table's rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def row_range(df: DataFrame, start: int = 0, num: int | None = None, order: list[str] | None = None) -> DataFrame:
    """Rows start .. start + num - 1 of the order given, or of the files as they are stored (path, then place in the file)."""
    if start < 0 or (num is not None and num < 1):
        raise ValueError("a row range starts at 0 or later and has at least one row")
    if start == 0 and num is None:
        return df
    if order:
        out = df.orderBy(*order)
    else:
        cols = df.columns
        out = df.select("*", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.row_index").alias("_row")).orderBy("_path", "_row").select(*cols)
    out = out.offset(start) if start else out
    return out.limit(num) if num is not None else out


def effective_rows(total: int, start: int, num: int | None) -> int:
    left = max(total - start, 0)
    return left if num is None else min(left, num)
