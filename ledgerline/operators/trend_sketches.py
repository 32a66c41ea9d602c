"""A5 by stored sketches: days are sketched once and merged to weeks, months or any other spans of days.

A day's row holds its additive columns and one HyperLogLog sketch each of its customers and sessions; a rollup adds the
columns and merges the sketches, so it reads one row a day and never the conversations. The folder is partitioned by
day; ``refresh_days`` sketches the days from a given one on and replaces just these, so that a repeated run (after a
failure, or for late rows) gives the same table.

Estimates err by about 1.04 / sqrt(2 ** lg_k) (one standard deviation; 1.6 % at 12) and are exact for small counts.
Defined results: rows without a time are one day NULL in ``day_sketches`` and are left out by ``refresh_days``; NULL
customers and sessions don't count; an empty table gives no rows.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.functions.core import count_if, pct, ts_ntz

LG_K = 12


def day_sketches(conversations: DataFrame, lg_k: int = LG_K) -> DataFrame:
    """One row a day; sketches are partial aggregates, so a hot day is combined before the shuffle."""
    return conversations.groupBy(F.to_date("created_at").alias("day")).agg(
        F.count(F.lit(1)).alias("total"), count_if(F.col("escalated") == F.lit(True)).alias("escalated"),
        F.sum("response_time_ms").alias("response_ms"), F.count("response_time_ms").alias("responses"),
        F.hll_sketch_agg(F.col("sender_id").cast("string"), lg_k).alias("customers"),
        F.hll_sketch_agg(F.col("session_id").cast("string"), lg_k).alias("sessions"))


def refresh_days(conversations: DataFrame, path: str, first_day: dt.date | str, lg_k: int = LG_K) -> None:
    """Sketch the days from ``first_day`` on into the folder, in place of what it has of these days."""
    rows = conversations.where(F.col("created_at") >= ts_ntz(first_day))
    (day_sketches(rows, lg_k).repartition("day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("day").parquet(path))


def stored_days(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).withColumn("day", F.col("day").cast("date"))


def rollup(days: DataFrame, unit: str) -> DataFrame:
    """Trends by ``unit`` (DAY, WEEK, MONTH, ...) from day rows alone; NULL days are one NULL span."""
    def estimate(c):
        return F.hll_sketch_estimate(F.hll_union_agg(c))

    total, escalated = F.sum("total"), F.sum("escalated")
    return days.groupBy(F.date_trunc(unit, F.col("day").cast("timestamp_ntz")).cast("date").alias("span")).agg(
        total.alias("total"), escalated.alias("escalated"), pct(escalated, total).alias("escalation_pct"),
        F.round(F.sum("response_ms").cast("double") / F.sum("responses"), 2).alias("avg_response_ms"),
        estimate("customers").alias("unique_customers"), estimate("sessions").alias("unique_sessions"))


def within_error(conversations: DataFrame, days: DataFrame, unit: str, error: float) -> DataFrame:
    """Exact distinct counts of each span, and whether the sketches' estimates are within ``error`` of them."""
    exact = conversations.groupBy(F.date_trunc(unit, F.to_date("created_at").cast("timestamp_ntz")).cast("date").alias("at")).agg(
        F.count_distinct("sender_id").alias("customers_exact"), F.count_distinct("session_id").alias("sessions_exact"))
    near = F.lit(True)
    for c in ("customers", "sessions"):
        near = near & (F.abs(F.col(f"unique_{c}") - F.col(f"{c}_exact")) <= error * F.col(f"{c}_exact"))
    return (rollup(days, unit).join(exact, F.col("at").eqNullSafe(F.col("span")))
            .select("span", "total", "escalated", "escalation_pct", "avg_response_ms", "customers_exact", "sessions_exact",
                    near.alias("within_error")))
