"""The batch twin of the request throttle: sliding counts and error streaks by windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def sliding_counts(requests: DataFrame, by: str = "client", per_minute: int = 60, burst: int = 10) -> DataFrame:
    """Requests (by, ts, id) with the number of earlier ones within 60 s and 10 s, and whether that is too many."""
    micros = F.unix_micros("ts")
    within = lambda s: F.count(F.lit(1)).over(Window.partitionBy(by).orderBy(micros).rangeBetween(-s * 1_000_000 + 1, -1))
    found = requests.withColumn("last_minute", within(60)).withColumn("last_ten", within(10))
    return found.withColumn("throttled", (F.col("last_minute") >= per_minute) | (F.col("last_ten") >= burst))


def error_streaks(requests: DataFrame, by: str = "client") -> DataFrame:
    """Requests (by, ts, id, ok, status) with the run of counted errors (429 or 5xx) since the last success, and the wait."""
    order = Window.partitionBy(by).orderBy("ts", "id")
    island = F.sum(F.col("ok").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    counted = (~F.col("ok") & ((F.col("status") == 429) | (F.col("status") >= 500))).cast("int")
    found = requests.withColumn("_island", island)
    streak = F.sum(counted).over(Window.partitionBy(by, "_island").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, 0))
    found = found.withColumn("errors", streak).drop("_island")
    return found.withColumn("backoff_s", F.when(F.col("errors") > 0, F.least(F.pow(F.lit(2.0), F.least("errors", F.lit(10))), F.lit(30.0))).otherwise(F.lit(0.0)))
