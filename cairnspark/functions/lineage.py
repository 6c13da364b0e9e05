"""Running totals over an explicit order, without a single-task sort of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET = 65_536


def running(df: DataFrame, order: str, sums: dict[str, Column | str], bucket: int = BUCKET) -> DataFrame:
    """``df`` with exclusive running sums in the order of a unique, non-negative long column.

    Rows are bucketed by ``order``; each bucket is summed in a task of its own, and only one row per bucket meets in
    one task for the sums before each bucket.
    """
    values = {f"_v_{k}": F.expr(v) if isinstance(v, str) else v for k, v in sums.items()}
    rows = df.withColumn("_bucket", F.floor(F.col(order) / bucket)).withColumns(values)
    totals = rows.groupBy("_bucket").agg(*(F.sum(f"_v_{k}").alias(f"_t_{k}") for k in sums))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("_bucket", *(F.coalesce(F.sum(f"_t_{k}").over(before), F.lit(0)).alias(f"_b_{k}") for k in sums))
    inside = Window.partitionBy("_bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    out = rows.withColumns({f"_w_{k}": F.coalesce(F.sum(f"_v_{k}").over(inside), F.lit(0)) for k in sums}).join(totals, "_bucket")
    return out.withColumns({k: F.col(f"_w_{k}") + F.col(f"_b_{k}") for k in sums}).drop("_bucket", *(f"_{x}_{k}" for k in sums for x in "vwb"))
