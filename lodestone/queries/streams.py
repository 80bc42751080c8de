"""Queries of the streaming family over a table."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.queries.registry import query
from lodestone.streaming import metering


@query()
def session_tokens(t, spark):
    """Requests that a token bucket lets through (state machine, tested on a fixture)."""
    out = metering.token_bucket_batch(t("events"), rate=1 / 14400, cap=5.0)
    return out.groupBy("tenant").agg(F.count("*").alias("n"), F.count_if("accepted").alias("accepted"))


@query("select user_id as tenant, ts::date::varchar as day, count(*)::bigint as n from events group by 1, 2")
def metered_days(t, spark):
    """The streaming daily sum, run over the table."""
    return metering.daily_usage(t("events")).withColumn("day", F.col("day").cast("string"))
