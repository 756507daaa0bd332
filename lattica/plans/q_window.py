"""Window functions (WN-*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lattica.operators import ranges, windows
from lattica.plans.catalog import query
from lattica.tables import load

_BASE = "SELECT user_id, event_id, value, CASE WHEN event_id % 4 = 0 THEN NULL ELSE event_id % 10 END AS v FROM events"


def _rows(spark, sf):
    e = F.col("event_id")
    return load(spark, sf, "events").select("user_id", "event_id", "value", F.when(e % 4 != 0, e % 10).alias("v"))


def _add(name, sql, make):
    query(f"SELECT user_id, event_id, {sql} AS r FROM ({_BASE})", name)(lambda spark, sf: _rows(spark, sf).select("user_id", "event_id", make().alias("r")))


_P = "PARTITION BY user_id ORDER BY"
_RUN = f"({_P} event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
_ALL = f"({_P} event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
_BY = ["user_id"]
_by_id = lambda: windows.ordered(_BY, "event_id")
_by_v = lambda: windows.ordered(_BY, "v")
_run = lambda: windows.running(_BY, "event_id")
_whole = lambda: windows.whole(_BY, "event_id")
_v = lambda: F.col("v")

_add("wn_01", f"row_number() OVER ({_P} v NULLS FIRST, event_id)", lambda: F.row_number().over(windows.ordered(_BY, "v", "event_id")).cast("bigint"))
_add("wn_02", f"rank() OVER ({_P} v NULLS FIRST)", lambda: F.rank().over(_by_v()).cast("bigint"))
_add("wn_03", f"dense_rank() OVER ({_P} v NULLS FIRST)", lambda: F.dense_rank().over(_by_v()).cast("bigint"))
_add("wn_04", f"lag(v, 2) OVER ({_P} event_id)", lambda: F.lag("v", 2).over(_by_id()))
_add("wn_05", f"lead(v, 2) OVER ({_P} event_id)", lambda: F.lead("v", 2).over(_by_id()))
_add("wn_06", f"coalesce(sum(v) OVER {_RUN}, 0)::BIGINT", lambda: windows.running_sum(_v(), _run()))
_add("wn_07", f"count(v) OVER {_RUN}", lambda: F.count("v").over(_run()))
_add("wn_08", f"min(v) OVER {_RUN}", lambda: F.min("v").over(_run()))
_add("wn_09", f"max(v) OVER {_RUN}", lambda: F.max("v").over(_run()))
_add("wn_10", f"round(coalesce(avg(v) OVER {_RUN}, 0), 6)", lambda: F.round(windows.running_avg(_v(), _run()), 6))
_add("wn_11", f"first_value(v) OVER {_ALL}", lambda: F.first("v").over(_whole()))
_add("wn_12", f"last_value(v) OVER {_ALL}", lambda: F.last("v").over(_whole()))
_add("wn_13", f"nth_value(v, 3) OVER {_ALL}", lambda: windows.nth_value(_v(), 3, _whole()))
_add("wn_14", f"round(percent_rank() OVER ({_P} v NULLS FIRST), 9)", lambda: F.round(F.percent_rank().over(_by_v()), 9))
_add("wn_15", f"round(cume_dist() OVER ({_P} v NULLS FIRST), 9)", lambda: F.round(F.cume_dist().over(_by_v()), 9))
_add("wn_16", f"ntile(7) OVER ({_P} event_id)", lambda: F.ntile(7).over(_by_id()).cast("bigint"))


@query("SELECT user_id, min(r)::BIGINT AS first, max(r)::BIGINT AS last FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id % 10 ORDER BY user_id, event_id) AS r FROM events) GROUP BY 1")
def wn_17(spark, sf):
    r = F.row_number().over(windows.ordered(["d"], "user_id", "event_id"))
    return load(spark, sf, "events").withColumn("d", F.col("user_id") % 10).select("user_id", r.alias("r")).groupBy("user_id").agg(F.min("r").cast("bigint").alias("first"), F.max("r").cast("bigint").alias("last"))


@query(f"SELECT user_id, event_id, v FROM (SELECT *, lag(v) OVER w AS p, row_number() OVER w AS n FROM ({_BASE}) WINDOW w AS ({_P} event_id)) WHERE n = 1 OR p IS DISTINCT FROM v")
def wn_18(spark, sf):
    return windows.dedup_adjacent(_rows(spark, sf).drop("value"), "v", _BY, "event_id")


@query("""SELECT user_id, min(lo) AS lo, max(hi) AS hi FROM (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS g FROM (
          SELECT *, CASE WHEN lo <= max(hi) OVER (PARTITION BY user_id ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS f
          FROM (SELECT user_id, event_id AS lo, event_id + 150 AS hi FROM events))) GROUP BY user_id, g""")
def wn_19(spark, sf):
    r = load(spark, sf, "events").select("user_id", F.col("event_id").alias("lo"), (F.col("event_id") + 150).alias("hi"))
    return ranges.islands(r, ["user_id"], width=2000)
