"""Sessions of log lines by gaps in time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def bursts(lines: DataFrame, session: str, offset: str, ts: str, gap: Column) -> DataFrame:
    """Adds burst_id: the offset of the first line of the run of lines with times that do not go back and gaps below ``gap``."""
    w = Window.partitionBy(session).orderBy(offset)
    before = F.lag(ts).over(w)
    joined = (F.col(ts) >= before) & (F.col(ts) - before < gap)
    marked = lines.withColumn("_first", F.when(F.coalesce(joined, F.lit(False)), F.lit(None)).otherwise(F.col(offset)))
    return marked.withColumn("burst_id", F.last("_first", ignorenulls=True).over(w)).drop("_first")
