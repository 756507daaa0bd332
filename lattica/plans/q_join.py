"""Joins, set operations, sorting and limits (JN-*, ST-*, SL-*)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lattica.operators import joins, ranges, sketches
from lattica.operators.ordering import with_position
from lattica.plans.catalog import query
from lattica.tables import load


def _sides(spark, sf):
    """All orders and all items: every third order's key is negated, so that it has no match, as have the items of these orders."""
    k = F.col("o_orderkey")
    o = load(spark, sf, "orders").select(F.when(k % 3 == 0, -k).otherwise(F.nullif(k, F.lit(4))).cast("bigint").alias("ok"), "o_custkey")
    i = load(spark, sf, "lineitem").select(F.nullif("l_orderkey", F.lit(5)).cast("bigint").alias("lk"), "l_partkey")
    return o, i


_O = "(SELECT CASE WHEN o_orderkey % 3 = 0 THEN -o_orderkey ELSE nullif(o_orderkey, 4) END AS ok, o_custkey FROM orders) o"
_I = "(SELECT nullif(l_orderkey, 5) AS lk, l_partkey FROM lineitem) i"


@query("""SELECT user_id, event_id, next_event_id, event_type FROM (
          SELECT user_id, event_id, event_type, lead(event_id) OVER w AS next_event_id, lead(event_type) OVER w AS k FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
          WHERE next_event_id IS NOT NULL AND k IS NOT DISTINCT FROM event_type""")
def jn_01(spark, sf):
    return joins.adjacent_pairs(load(spark, sf, "events"), "event_type", "event_id", ["user_id"]).select("user_id", "event_id", "next_event_id", "event_type")


for _id, _kind, _sql in (("jn_02", "inner", "JOIN"), ("jn_03", "left", "LEFT JOIN"), ("jn_04", "right", "RIGHT JOIN"), ("jn_05", "full", "FULL JOIN")):
    query(f"SELECT ok, o_custkey, lk, l_partkey FROM {_O} {_sql} {_I} ON o.ok = i.lk", _id)(lambda spark, sf, k=_kind: joins.equi_join(*_sides(spark, sf), [("ok", "lk")], k))


@query(f"SELECT ok, o_custkey FROM {_O} WHERE EXISTS (SELECT 1 FROM {_I} WHERE o.ok = i.lk)")
def jn_06(spark, sf):
    return joins.equi_join(*_sides(spark, sf), [("ok", "lk")], "left_semi")


@query(f"SELECT ok, o_custkey FROM {_O} WHERE NOT EXISTS (SELECT 1 FROM {_I} WHERE o.ok = i.lk)")
def jn_07(spark, sf):
    return joins.equi_join(*_sides(spark, sf), [("ok", "lk")], "left_anti")


@query("SELECT n_nationkey, r_regionkey FROM nation JOIN region ON n_regionkey < r_regionkey")
def jn_08(spark, sf):
    return joins.theta_join(load(spark, sf, "nation"), load(spark, sf, "region"), "n_regionkey", "<", "r_regionkey").select("n_nationkey", "r_regionkey")


@query("SELECT c_custkey, o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey")
def jn_09(spark, sf):
    return joins.equi_join(load(spark, sf, "customer"), load(spark, sf, "orders"), [("c_custkey", "o_custkey")], hint="merge").select("c_custkey", "o_orderkey")


@query("SELECT n_name, r_name FROM nation CROSS JOIN region")
def jn_10(spark, sf):
    return load(spark, sf, "nation").crossJoin(load(spark, sf, "region")).select("n_name", "r_name")


@query("""SELECT c_custkey, n_name, r_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_nationkey < 20 JOIN region ON n_regionkey = r_regionkey""")
def jn_11(spark, sf):
    views = {t: load(spark, sf, t) for t in ("customer", "nation", "region")}
    return spark.sql("SELECT c_custkey, n_name, r_name FROM {customer} LEFT JOIN {nation} ON c_nationkey = n_nationkey AND n_nationkey < 20 JOIN {region} ON n_regionkey = r_regionkey", **views)


_SPAN = "SELECT user_id, event_id, least(epoch_us(ts) // 1000000, epoch_us(ts) // 1000000 + (event_id % 7 - 3) * 3600) AS lo, greatest(epoch_us(ts) // 1000000, epoch_us(ts) // 1000000 + (event_id % 7 - 3) * 3600) AS hi FROM events"


def _spans(spark, sf):
    second = F.timestamp_diff("SECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("ts"))
    lo, hi = ranges.normalized(second, second + (F.col("event_id") % 7 - 3) * 3600)
    return load(spark, sf, "events").select("user_id", "event_id", "event_type", lo.alias("lo"), hi.alias("hi"))


@query(f"SELECT a.event_id AS l, b.event_id AS r FROM ({_SPAN}) a JOIN ({_SPAN}) b ON a.user_id = b.user_id AND a.lo <= b.hi AND b.lo <= a.hi AND a.event_id < b.event_id")
def jn_12(spark, sf):
    s = _spans(spark, sf).select("user_id", "event_id", "lo", "hi")
    return ranges.overlap_join(s, s, ["user_id"], 6 * 3600).where("event_id < r_event_id").select(F.col("event_id").alias("l"), F.col("r_event_id").alias("r"))


@query(f"SELECT e.event_id AS point, s.event_id AS held_by FROM events e JOIN ({_SPAN}) s ON e.user_id = s.user_id AND epoch_us(e.ts) // 1000000 BETWEEN s.lo AND s.hi WHERE e.event_type = 'click'")
def jn_13(spark, sf):
    s = _spans(spark, sf)
    second = F.timestamp_diff("SECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("ts"))
    points = load(spark, sf, "events").where("event_type = 'click'").select("user_id", F.col("event_id").alias("point"), second.alias("at"))
    return ranges.stab_join(points, s.select("user_id", "event_id", "lo", "hi"), ["user_id"], "at", 6 * 3600).select("point", F.col("r_event_id").alias("held_by"))


@query("SELECT true AS together, count(*)::BIGINT AS pairs FROM orders JOIN customer ON o_custkey = c_custkey")
def jn_14(spark, sf):
    o, c = joins.copartitioned(load(spark, sf, "orders"), load(spark, sf, "customer"), 8, "o_custkey", "c_custkey")
    o, c = o.withColumn("po", F.spark_partition_id()), c.withColumn("pc", F.spark_partition_id())
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).agg(F.bool_and(F.col("po") == F.col("pc")).alias("together"), F.count("*").alias("pairs"))


@query("SELECT true AS none_lost, true AS some_dropped")
def jn_15(spark, sf):
    build = load(spark, sf, "part").where("p_size < 3").select("p_partkey")
    probe = load(spark, sf, "lineitem").select("l_partkey")
    kept = joins.bloom_prefilter(probe, build, F.col("l_partkey"), F.col("p_partkey"))
    true = probe.join(build, F.col("l_partkey") == F.col("p_partkey"), "left_semi").agg(F.count("*").alias("t"))
    both = kept.join(build, F.col("l_partkey") == F.col("p_partkey"), "left_semi").agg(F.count("*").alias("b"))
    counts = true.crossJoin(both).crossJoin(kept.agg(F.count("*").alias("k"))).crossJoin(probe.agg(F.count("*").alias("p")))  # one row each
    return counts.select((F.col("t") == F.col("b")).alias("none_lost"), (F.col("k") < F.col("p")).alias("some_dropped"))


@query("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def st_01(spark, sf):
    return load(spark, sf, "lineitem").select("l_returnflag", "l_linestatus").distinct()


@query("SELECT n_name AS name, n_regionkey AS region FROM nation UNION ALL SELECT r_name, NULL FROM region")
def st_02(spark, sf):
    n, r = load(spark, sf, "nation"), load(spark, sf, "region")
    return n.select(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region")).unionByName(r.select(F.col("r_name").alias("name")), allowMissingColumns=True)


@query("""SELECT 'union' AS op, k FROM (SELECT o_custkey AS k FROM orders UNION SELECT l_suppkey FROM lineitem)
          UNION ALL SELECT 'intersect', k FROM (SELECT o_custkey AS k FROM orders INTERSECT SELECT l_suppkey FROM lineitem)
          UNION ALL SELECT 'except', k FROM (SELECT o_custkey AS k FROM orders EXCEPT SELECT l_suppkey FROM lineitem)""")
def st_03(spark, sf):
    a, b = load(spark, sf, "orders").select(F.col("o_custkey").alias("k")), load(spark, sf, "lineitem").select(F.col("l_suppkey").alias("k"))
    made = {"union": a.union(b).distinct(), "intersect": a.intersect(b), "except": a.subtract(b)}
    one, two, three = (df.select(F.lit(op).alias("op"), "k") for op, df in made.items())
    return one.unionAll(two).unionAll(three)


@query("""SELECT NOT EXISTS (SELECT l_orderkey FROM lineitem EXCEPT SELECT o_orderkey FROM orders) AS subset,
          NOT EXISTS (SELECT l_suppkey FROM lineitem INTERSECT SELECT -s_suppkey FROM supplier) AS disjoint""")
def st_04(spark, sf):
    o, i, s = load(spark, sf, "orders"), load(spark, sf, "lineitem"), load(spark, sf, "supplier")
    missing = i.join(o, F.col("l_orderkey") == F.col("o_orderkey"), "left_anti").agg((F.count("*") == 0).alias("subset"))
    common = i.join(s, F.col("l_suppkey") == -F.col("s_suppkey"), "left_semi").agg((F.count("*") == 0).alias("disjoint"))
    return missing.crossJoin(common)  # one row each


_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"]


@query("""SELECT row_number() OVER (ORDER BY c_nationkey DESC, c_acctbal ASC NULLS FIRST, c_custkey) AS position, c_custkey FROM customer""")
def sl_01(spark, sf):
    return with_position(load(spark, sf, "customer"), [F.desc("c_nationkey"), F.asc("c_acctbal"), F.asc("c_custkey")]).select("position", "c_custkey")


@query("SELECT row_number() OVER (ORDER BY c_acctbal * -2 DESC, c_custkey) AS position, c_custkey FROM customer")
def sl_02(spark, sf):
    return with_position(load(spark, sf, "customer"), [(F.col("c_acctbal") * -2).desc(), F.asc("c_custkey")]).select("position", "c_custkey")


@query("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 5")
def sl_03(spark, sf):
    return load(spark, sf, "orders").orderBy("o_orderkey").offset(5).limit(10).select("o_orderkey")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def sl_04(spark, sf):
    return load(spark, sf, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20).select("o_orderkey", "o_totalprice")


@query("""SELECT row_number() OVER (ORDER BY v, side, k) AS position, v, side FROM (SELECT c_acctbal AS v, 0 AS side, c_custkey AS k FROM customer UNION ALL SELECT s_acctbal, 1, s_suppkey FROM supplier)""")
def sl_06(spark, sf):
    a = load(spark, sf, "customer").select(F.col("c_acctbal").alias("v"), F.lit(0).alias("side"), F.col("c_custkey").alias("k"))
    b = load(spark, sf, "supplier").select(F.col("s_acctbal").alias("v"), F.lit(1).alias("side"), F.col("s_suppkey").alias("k"))
    return with_position(a.unionAll(b), [F.col("v"), F.col("side"), F.col("k")]).select("position", "v", "side")


@query("""SELECT row_number() OVER (ORDER BY v, run) AS position, v, run FROM (SELECT c_custkey AS v, 0 AS run FROM customer UNION ALL SELECT s_suppkey, 1 FROM supplier UNION ALL SELECT p_partkey, 2 FROM part)""")
def sl_07(spark, sf):
    runs = [load(spark, sf, t).select(F.col(k).alias("v"), F.lit(i).alias("run")) for i, (t, k) in enumerate((("customer", "c_custkey"), ("supplier", "s_suppkey"), ("part", "p_partkey")))]
    return with_position(runs[0].unionAll(runs[1]).unionAll(runs[2]), [F.col("v"), F.col("run")]).select("position", "v", "run")


@query("""SELECT user_id, bool_and(coalesce(p <= value, true)) AS sorted FROM (SELECT user_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events) GROUP BY user_id""")
def sl_09(spark, sf):
    p = F.lag("value").over(W.partitionBy("user_id").orderBy("event_id"))
    return load(spark, sf, "events").select("user_id", "value", p.alias("p")).groupBy("user_id").agg(F.bool_and(F.coalesce(F.col("p") <= F.col("value"), F.lit(True))).alias("sorted"))


@query("SELECT k, count(*) AS n FROM (SELECT p_size AS k FROM part WHERE p_size BETWEEN 10 AND 20) GROUP BY k")
def btree_range(spark, sf):
    return load(spark, sf, "part").where("p_size BETWEEN 10 AND 20").groupBy(F.col("p_size").alias("k")).agg(F.count("*").alias("n"))


@query("SELECT min(o_orderkey) AS ceiling FROM orders WHERE o_orderkey >= 100")
def skiplist_ceiling(spark, sf):
    return load(spark, sf, "orders").where("o_orderkey >= 100").agg(F.min("o_orderkey").alias("ceiling"))


@query("""SELECT user_id, event_id, array_to_string(list(event_id) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), ',') AS last3 FROM events""")
def ring_last_n(spark, sf):
    w = W.partitionBy("user_id").orderBy("event_id").rowsBetween(-2, 0)
    return load(spark, sf, "events").select("user_id", "event_id", F.array_join(F.collect_list("event_id").over(w).cast("array<string>"), ",").alias("last3"))
