"""Clustering by key: global order, balanced ranges, and checks of both."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def order_column(df: DataFrame, key: str, *ties: str) -> DataFrame:
    """df in one global order, by a range shuffle: never one task for all rows."""
    return df.orderBy(F.col(key).asc_nulls_last(), *ties)


def boundaries(df: DataFrame, key: str, parts: int, accuracy: int = 10000, exact: bool = False) -> list[int]:
    """The smallest key and the lower bounds of the other ranges, sorted; quantiles of the key from one aggregate. exact: true quantiles, which need all keys of the aggregate in memory."""
    if parts <= 1:
        return []
    shares = F.array(*(F.lit(i / parts) for i in range(1, parts)))
    if exact:
        cuts = F.array(*(F.expr(f"percentile_disc({i / parts!r}) within group (order by `{key}`)").cast("long") for i in range(1, parts)))
    else:
        cuts = F.percentile_approx(F.col(key), shares, accuracy)
    row = df.agg(F.min(key).alias("least"), cuts.alias("cuts")).first()
    if row["least"] is None:
        return []
    return [int(row["least"]), *sorted(int(c) for c in row["cuts"])]


def _by_range(key: str | Column, lower: list[int], values: list[int]) -> Column:
    """The value of the range that a key falls in; the first range takes all that is below the second."""
    key = F.col(key) if isinstance(key, str) else key
    if not lower:
        return F.lit(0)
    found = F.lit(values[0])
    if len(lower) > 1:
        found = F.when(key < lower[1], values[0])
        for k in range(2, len(lower)):
            found = found.when(key < lower[k], values[k - 1])
        found = found.otherwise(values[-1])
    return found


def range_column(key: str | Column, lower: list[int]) -> Column:
    """The lower bound of the range that a key falls in."""
    return _by_range(key, lower, lower).cast("long")


def partitioned_sort(df: DataFrame, key: str, lower: list[int], column: str) -> DataFrame:
    """df with its range column, each range whole in a task of its own and sorted there: one shuffle, no global sort."""
    number = _by_range(key, lower, list(range(len(lower)))).cast("int")
    return df.withColumn(column, range_column(key, lower)).repartitionById(max(len(lower), 1), number).sortWithinPartitions(column, key)


def order_violations(df: DataFrame, key: str, group: list[str], position: str) -> DataFrame:
    """Rows whose key is below that of the row before, in the order of position within a group (a file)."""
    before = F.lag(key).over(Window.partitionBy(*group).orderBy(position))
    return df.withColumn("previous", before).where(F.col(key) < F.col("previous"))


def bound_violations(df: DataFrame, key: str, lower: str) -> DataFrame:
    """Partitions (by lower bound) with a key below their bound or not below the next partition's."""
    parts = df.groupBy(F.col(lower).alias("lower")).agg(F.min(key).alias("least"), F.max(key).alias("most"))
    # One row a partition: the window is over the partitions, not the data.
    parts = parts.withColumn("next_lower", F.lead("lower").over(Window.orderBy("lower")))
    return parts.where((F.col("least") < F.col("lower")) | (F.col("most") >= F.col("next_lower")))


def range_overlaps(files: DataFrame) -> DataFrame:
    """files: file, minimum, maximum (one row a file). Those whose range begins at or below the largest maximum of the files before, in order."""
    w = Window.orderBy("minimum", "maximum", "file").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("before", F.max("maximum").over(w)).where(F.col("minimum") <= F.col("before"))
