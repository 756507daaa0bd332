"""Event-time windows over the events as a stream: an extension."""

from __future__ import annotations

from pyspark.sql import functions as F

from lattica.plans.catalog import query
from lattica.streaming import events


@query("SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_tumbling(spark, sf):
    df = events.source(spark, sf, "events.parquet")
    out = events.drained(events.tumbling(df, "ts", "1 hour", "30 days", ["event_type"]), "tumbling")
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n")


@query(
    """SELECT strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, user_id, count(*) AS n FROM (
       SELECT user_id, ts, sum(f) OVER (PARTITION BY user_id ORDER BY ts) AS g FROM (
       SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS f FROM events)) GROUP BY user_id, g"""
)
def stream_sessions(spark, sf):
    df = events.source(spark, sf, "events.parquet")
    out = events.drained(events.sessions(df, "ts", "6 hours", "30 days", ["user_id"]), "sessions")
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "user_id", "n")
