"""Aggregation, statistics and sketches (AG-*, OP-*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lattica.operators import aggregate, sketches, stats
from lattica.plans.catalog import query
from lattica.sources import diag
from lattica.tables import load


def _items(spark, sf):
    return load(spark, sf, "lineitem")


@query("SELECT count(v)::BIGINT AS count, sum(trunc(v))::BIGINT AS sum, min(v) AS min, max(v) AS max FROM (SELECT nullif(c_acctbal, 0) AS v FROM customer)")
def ag_01(spark, sf):
    return aggregate.script_agg(load(spark, sf, "customer").select(F.nullif("c_acctbal", F.lit(0)).alias("v")), "v")


@query("SELECT l_linenumber::BIGINT AS g, count(*) AS n, sum(l_partkey)::BIGINT AS s, min(l_partkey) AS lo, max(l_partkey) AS hi FROM lineitem GROUP BY 1")
def ag_02(spark, sf):
    return _items(spark, sf).groupBy(F.col("l_linenumber").cast("bigint").alias("g")).agg(F.count("*").alias("n"), F.sum("l_partkey").alias("s"), F.min("l_partkey").alias("lo"), F.max("l_partkey").alias("hi"))


@query("""SELECT l_returnflag, l_linestatus, sum(l_quantity::DECIMAL(18,2))::DOUBLE AS qty, round(avg(l_discount), 6) AS disc, count(DISTINCT l_suppkey) AS supps, min(l_shipdate)::DATE::VARCHAR AS d0 FROM lineitem GROUP BY 1, 2""")
def ag_03(spark, sf):
    return _items(spark, sf).groupBy("l_returnflag", "l_linestatus").agg(aggregate.exact_sum(F.col("l_quantity")).alias("qty"), F.round(F.avg("l_discount"), 6).alias("disc"), F.countDistinct("l_suppkey").alias("supps"), F.min("l_shipdate").cast("date").cast("string").alias("d0"))


@query("SELECT count(*) AS n FROM lineitem")
def ag_04(spark, sf):
    return _items(spark, sf).agg(F.count("*").alias("n"))


@query("SELECT p_brand, count(nullif(p_size, 7)) AS n FROM part GROUP BY 1")
def ag_05(spark, sf):
    return load(spark, sf, "part").groupBy("p_brand").agg(F.count(F.nullif("p_size", F.lit(7))).alias("n"))


@query("SELECT sum(l_partkey)::BIGINT AS whole, sum(l_extendedprice::DECIMAL(18,2))::DOUBLE AS real, sum(l_partkey) FILTER (WHERE false)::BIGINT AS empty FROM lineitem")
def ag_06(spark, sf):
    return _items(spark, sf).agg(F.sum("l_partkey").alias("whole"), aggregate.exact_sum(F.col("l_extendedprice")).alias("real"), F.sum(F.when(F.lit(False), F.col("l_partkey"))).alias("empty"))


@query("SELECT o_orderstatus, round(avg(o_custkey), 6) AS mean FROM orders GROUP BY 1")
def ag_07(spark, sf):
    return load(spark, sf, "orders").groupBy("o_orderstatus").agg(F.round(F.avg("o_custkey"), 6).alias("mean"))


@query("SELECT p_brand, min(p_name) AS a, max(p_name) AS z, min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part GROUP BY 1")
def ag_08(spark, sf):
    return load(spark, sf, "part").groupBy("p_brand").agg(F.min("p_name").alias("a"), F.max("p_name").alias("z"), F.min("p_retailprice").alias("lo"), F.max("p_retailprice").alias("hi"))


@query("""SELECT user_id, min_by(v, event_id) FILTER (WHERE v IS NOT NULL) AS first, max_by(v, event_id) FILTER (WHERE v IS NOT NULL) AS last FROM (SELECT user_id, event_id, nullif(event_type, 'click') AS v FROM events) GROUP BY 1""")
def ag_09(spark, sf):
    v = F.nullif("event_type", F.lit("click"))
    return load(spark, sf, "events").groupBy("user_id").agg(aggregate.first_by(v, F.col("event_id")).alias("first"), aggregate.last_by(v, F.col("event_id")).alias("last"))


@query("SELECT l_returnflag, count(DISTINCT nullif(l_suppkey, 3)) AS n FROM lineitem GROUP BY 1")
def ag_10(spark, sf):
    return _items(spark, sf).groupBy("l_returnflag").agg(F.countDistinct(F.nullif("l_suppkey", F.lit(3))).alias("n"))


@query("SELECT p_brand, count(DISTINCT p_size) AS n, sum(DISTINCT p_size)::BIGINT AS s, min(DISTINCT p_size)::BIGINT AS lo, max(DISTINCT p_size)::BIGINT AS hi, avg(DISTINCT p_size) AS mean FROM part GROUP BY 1")
def ag_11(spark, sf):
    return spark.sql("SELECT p_brand, count(DISTINCT p_size) AS n, sum(DISTINCT p_size) AS s, min(DISTINCT p_size)::BIGINT AS lo, max(DISTINCT p_size)::BIGINT AS hi, avg(DISTINCT p_size) AS mean FROM {part} GROUP BY p_brand", part=load(spark, sf, "part"))


@query("SELECT (p_size % 5)::BIGINT AS m, length(p_type)::BIGINT AS k, count(*) AS n FROM part GROUP BY 1, 2")
def ag_13(spark, sf):
    return load(spark, sf, "part").groupBy((F.col("p_size") % 5).cast("bigint").alias("m"), F.length("p_type").cast("bigint").alias("k")).agg(F.count("*").alias("n"))


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 12")
def ag_14(spark, sf):
    return load(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")).where("n > 12")


@query("SELECT n_regionkey, min(r)::BIGINT AS first, max(r)::BIGINT AS last FROM (SELECT n_regionkey, row_number() OVER (ORDER BY n_regionkey, n_nationkey) AS r FROM nation) GROUP BY 1")
def ag_15(spark, sf):
    return aggregate.group_bounds(load(spark, sf, "nation"), ["n_regionkey"], [F.col("n_nationkey")])


@query("""SELECT o_custkey, round(var_pop(x), 4) AS vp, round(coalesce(var_samp(x), 0), 4) AS vs, round(stddev_pop(x), 4) AS sp, round(coalesce(stddev_samp(x), 0), 4) AS ss FROM (SELECT o_custkey, o_totalprice / 1000 AS x FROM orders) GROUP BY 1""")
def ag_16(spark, sf):
    x = F.col("o_totalprice") / 1000
    made = (("vp", aggregate.var_pop), ("vs", aggregate.var_samp), ("sp", aggregate.stddev_pop), ("ss", aggregate.stddev_samp))
    return load(spark, sf, "orders").groupBy("o_custkey").agg(*(F.round(f(x), 4).alias(n) for n, f in made))


_M = "avg((x - m)^3) AS m3, avg((x - m)^2) AS m2 FROM (SELECT g, x, avg(x) OVER (PARTITION BY g) AS m FROM (SELECT p_brand AS g, p_size::DOUBLE AS x FROM part)) GROUP BY g"


@query(f"SELECT g, round(CASE WHEN m2 = 0 THEN 0 ELSE m3 / m2^1.5 END, 6) AS skew FROM (SELECT g, {_M})")
def ag_17(spark, sf):
    return load(spark, sf, "part").groupBy(F.col("p_brand").alias("g")).agg(F.round(aggregate.skewness(F.col("p_size").cast("double")), 6).alias("skew"))


@query("SELECT p_brand AS g, round(coalesce(kurtosis_pop(p_size), 0), 6) AS kurt FROM part GROUP BY 1")
def ag_18(spark, sf):
    return load(spark, sf, "part").groupBy(F.col("p_brand").alias("g")).agg(F.round(aggregate.kurtosis(F.col("p_size").cast("double")), 6).alias("kurt"))


@query("SELECT l_returnflag, round(covar_pop(l_quantity, l_tax), 6) AS cp, round(covar_samp(l_quantity, l_tax), 6) AS cs FROM lineitem GROUP BY 1")
def ag_20(spark, sf):
    x, y = F.col("l_quantity"), F.col("l_tax")
    return _items(spark, sf).groupBy("l_returnflag").agg(F.round(aggregate.covar_pop(x, y), 6).alias("cp"), F.round(aggregate.covar_samp(x, y), 6).alias("cs"))


@query("SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 6) AS r, 0::DOUBLE AS flat FROM lineitem GROUP BY 1")
def ag_21(spark, sf):
    x, y = F.col("l_quantity"), F.col("l_extendedprice")
    return _items(spark, sf).groupBy("l_returnflag").agg(F.round(aggregate.correlation(x, y), 6).alias("r"), aggregate.correlation(x, F.lit(1.0)).alias("flat"))


@query("SELECT true AS single_near, true AS merged_near")
def ag_22(spark, sf):
    df = _items(spark, sf)
    # apart: beside a distinct count, Spark keeps and shuffles a sketch for each distinct key
    one, exact = df.agg(sketches.approx_distinct(F.col("l_partkey"), 12).alias("a")), df.agg(F.countDistinct("l_partkey").alias("n"))
    both = one.crossJoin(exact).crossJoin(sketches.merged_distinct(df, "l_returnflag", "l_partkey"))  # one row each
    near = lambda c: F.abs(F.col(c) - F.col("n")) <= 0.08 * F.col("n") + 2
    return both.select(near("a").alias("single_near"), near("estimate").alias("merged_near"))


@query("SELECT min(l_quantity) AS least, max(l_quantity) AS most, true AS middle_near FROM lineitem")
def ag_23(spark, sf):
    q = F.col("l_quantity")
    mid = sketches.quantile(q, 0.5)
    return _items(spark, sf).agg(sketches.quantile(q, 0).alias("least"), sketches.quantile(q, 1).alias("most"), F.abs(mid - F.median(q)).alias("d")).select("least", "most", (F.col("d") <= 1).alias("middle_near"))


@query("SELECT x AS value FROM (SELECT o_totalprice AS x, row_number() OVER (ORDER BY o_totalprice) AS r, count(*) OVER () AS n FROM orders) WHERE r = floor((n - 1) * 0.9 + 0.5) + 1")
def ag_24(spark, sf):
    return stats.nearest_rank(load(spark, sf, "orders"), "o_totalprice", 0.9)


@query("SELECT true AS size_right, true AS all_known")
def ag_25(spark, sf):
    df = load(spark, sf, "orders")
    sample = sketches.reservoir(df, F.col("o_orderkey"), 100)
    return sample.join(df.select("o_orderkey"), "o_orderkey").agg((F.count("*") == 100).alias("size_right"), (F.countDistinct("o_orderkey") == 100).alias("all_known"))


@query("SELECT l_suppkey AS value, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def ag_26(spark, sf):
    return sketches.heavy_hitters(_items(spark, sf), "l_suppkey", 10)


@query("SELECT p_size AS value, count(*) AS n FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 7")
def ag_27(spark, sf):
    return stats.most_frequent(load(spark, sf, "part"), "p_size", 7)


_STATS = """count(*) AS count, count(*) FILTER (WHERE x IS NULL) AS null_count, count(DISTINCT x) AS "distinct", min(x)::BIGINT AS min, max(x)::BIGINT AS max, sum(x)::BIGINT AS sum, round(avg(x), 6) AS avg, round(var_pop(x), 6) AS var_pop, round(stddev_pop(x), 6) AS stddev_pop"""


@query(f"SELECT {_STATS} FROM (SELECT nullif(p_size, 7) AS x FROM part)")
def ag_28(spark, sf):
    out = stats.column_stats(load(spark, sf, "part").select(F.nullif("p_size", F.lit(7)).cast("bigint").alias("x")), "x")
    return out.select("count", "null_count", "distinct", "min", "max", "sum", *(F.round(c, 6).alias(c) for c in ("avg", "var_pop", "stddev_pop")))


@query("""WITH r AS (SELECT min(p_size)::DOUBLE AS a, max(p_size)::DOUBLE AS b FROM part), w AS (SELECT a, (b - a) / 8 AS w FROM r),
          f AS (SELECT least(floor((p_size - a) / w), 7)::BIGINT AS bucket, count(*) AS n FROM part, w GROUP BY 1)
          SELECT i AS bucket, round(a + i * w, 6) AS lo, round(a + (i + 1) * w, 6) AS hi, coalesce(n, 0) AS n FROM w, range(8) t(i) LEFT JOIN f ON f.bucket = i""")
def ag_29(spark, sf):
    return stats.equi_width(load(spark, sf, "part"), "p_size", 8).select("bucket", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"), "n")


@query("""SELECT b AS bucket, min(x) AS lo, max(x) AS hi, count(*) AS n, count(DISTINCT x) AS "distinct" FROM
          (SELECT x, (row_number() OVER (ORDER BY x) - 1) // ceil(count(*) OVER () / 10.0)::BIGINT AS b FROM (SELECT l_partkey AS x FROM lineitem)) GROUP BY b""")
def ag_30(spark, sf):
    return stats.equi_depth(_items(spark, sf), "l_partkey", 10)


@query("""SELECT 'top' AS part, p_size::BIGINT AS k, count(*) AS n FROM part GROUP BY p_size HAVING count(*) >= (SELECT max(c) FROM (SELECT count(*) AS c FROM part GROUP BY p_size))
          UNION ALL SELECT 'rows', 0, count(*) FROM part UNION ALL SELECT 'depth', b, count(*) FROM (SELECT (row_number() OVER (ORDER BY p_size) - 1) // ceil(count(*) OVER () / 4.0)::BIGINT AS b FROM part) GROUP BY b""")
def ag_31(spark, sf):
    df = load(spark, sf, "part").select(F.col("p_size").cast("bigint").alias("x"))
    counts = df.groupBy(F.col("x").alias("k")).agg(F.count("*").alias("n"))
    most = counts.agg(F.max("n").alias("m"))
    top = counts.join(F.broadcast(most), F.col("n") == F.col("m")).select(F.lit("top").alias("part"), "k", "n")  # one row
    rows = stats.column_stats(df, "x").select(F.lit("rows").alias("part"), F.lit(0).cast("bigint").alias("k"), F.col("count").alias("n"))
    return top.unionAll(rows).unionAll(stats.equi_depth(df, "x", 4).select(F.lit("depth"), "bucket", "n"))


@query("SELECT 'p_size' AS \"column\", count(*) AS rows, 0::BIGINT AS nulls, true AS near FROM part UNION ALL SELECT 'p_brand', count(*), 0, true FROM part")
def ag_32(spark, sf):
    df = load(spark, sf, "part").select("p_size", "p_brand")
    exact = df.agg(F.countDistinct("p_size").alias("p_size"), F.countDistinct("p_brand").alias("p_brand")).unpivot([], ["p_size", "p_brand"], "column", "exact")
    return stats.profile(df).join(exact, "column").select("column", "rows", "nulls", (F.abs(F.col("distinct") - F.col("exact")) <= 0.1 * F.col("exact")).alias("near"))


@query("SELECT coalesce(sum(p_size), 0)::BIGINT AS s, min(p_size)::BIGINT AS lo, max(p_size)::BIGINT AS hi, 0::BIGINT AS empty FROM part")
def ag_33(spark, sf):
    x = F.col("p_size").cast("bigint")
    return load(spark, sf, "part").agg(F.coalesce(F.sum(x), F.lit(0)).alias("s"), F.min(x).alias("lo"), F.max(x).alias("hi"), F.coalesce(F.sum(F.when(F.lit(False), x)), F.lit(0)).alias("empty"))


@query("""WITH s AS (SELECT user_id, list_distinct(list(event_id % 20)) AS e FROM events GROUP BY 1)
          SELECT a.user_id, round(len(list_intersect(a.e, b.e)) / len(list_distinct(list_concat(a.e, b.e))), 6) AS exact, true AS near FROM s a JOIN s b ON b.user_id = a.user_id + 1""")
def ag_34(spark, sf):
    s = load(spark, sf, "events").groupBy("user_id").agg(F.collect_set(F.col("event_id") % 20).alias("e")).withColumn("m", sketches.minhash(F.col("e"), 256))
    b = s.select((F.col("user_id") - 1).alias("user_id"), F.col("e").alias("f"), F.col("m").alias("o"))
    exact = sketches.jaccard(F.col("e"), F.col("f"))
    return s.join(b, "user_id").select("user_id", F.round(exact, 6).alias("exact"), (F.abs(sketches.estimated_jaccard(F.col("m"), F.col("o")) - exact) < 0.2).alias("near"))


@query("""SELECT 'equal' AS probe, count(*) AS n, min(event_id) AS lo FROM events WHERE event_type = 'click' UNION ALL SELECT 'and', count(*), min(event_id) FROM events WHERE event_type = 'click' AND user_id < 20
          UNION ALL SELECT 'or', count(*), min(event_id) FROM events WHERE event_type IN ('click', 'error')""")
def ag_35(spark, sf):
    df = load(spark, sf, "events")
    click, err = F.col("event_type") == "click", F.col("event_type") == "error"
    probes = {"equal": click, "and": click & (F.col("user_id") < 20), "or": click | err}
    bit, bucket = F.bitmap_bit_position("event_id"), F.bitmap_bucket_number("event_id")
    out = None
    for name, cond in probes.items():
        hit = df.where(cond)
        maps = hit.groupBy(bucket.alias("b")).agg(F.bitmap_construct_agg(bit).alias("m"), F.min("event_id").alias("lo"))
        one = maps.agg(F.lit(name).alias("probe"), F.sum(F.bitmap_count("m")).alias("n"), F.min("lo").alias("lo"))
        out = one if out is None else out.unionAll(one)
    return out


@query("""WITH a AS (SELECT DISTINCT user_id AS k FROM events WHERE event_type = 'click'), b AS (SELECT DISTINCT user_id AS k FROM events WHERE event_type = 'signup')
          SELECT 'union' AS op, k FROM (SELECT k FROM a UNION SELECT k FROM b) UNION ALL SELECT 'intersect', k FROM (SELECT k FROM a INTERSECT SELECT k FROM b) UNION ALL SELECT 'difference', k FROM (SELECT k FROM a EXCEPT SELECT k FROM b)""")
def ag_36(spark, sf):
    df = load(spark, sf, "events")
    a, b = (df.where(F.col("event_type") == t).select(F.col("user_id").alias("k")).distinct() for t in ("click", "signup"))
    tagged = lambda op, x: x.select(F.lit(op).alias("op"), "k")
    return tagged("union", a.union(b).distinct()).unionAll(tagged("intersect", a.intersect(b))).unionAll(tagged("difference", a.subtract(b)))


@query("""SELECT round(1.0 / count(DISTINCT p_size), 6) AS eq, round(least(greatest((25.0 - min(p_size)) / (max(p_size) - min(p_size)), 0), 1), 6) AS below, count(*) FILTER (WHERE p_size < 25) AS actual FROM part""")
def op_01(spark, sf):
    df = load(spark, sf, "part").select(F.col("p_size").cast("double").alias("x"))
    s = stats.column_stats(df, "x").crossJoin(df.agg(F.count_if(F.col("x") < 25).alias("actual")))  # one row each
    return s.select(F.round(stats.eq_selectivity(F.col("distinct")), 6).alias("eq"), F.round(stats.range_selectivity(F.col("min"), F.col("max"), F.lit(25.0)), 6).alias("below"), "actual")


@query("""SELECT * FROM (VALUES ('a = 1', 0.1::DOUBLE), ('a > 1', 0.3333), ('a between', 0.25), ('a in 3', 0.3), ('like', 0.2), ('null', 0.05), ('not null', 0.95), ('and', 0.02), ('or', 0.28), ('not', 0.9)) t(predicate, selectivity)""")
def op_02(spark, sf):
    from lattica.plans import cost

    p = {"a = 1": cost.eq(10), "a > 1": cost.RANGE, "a between": cost.BETWEEN, "a in 3": cost.in_list(3), "like": cost.LIKE, "null": cost.IS_NULL, "not null": 1 - cost.IS_NULL, "and": cost.both(cost.eq(10), cost.LIKE), "or": cost.either(cost.eq(10), cost.LIKE), "not": cost.negated(cost.eq(10))}
    return spark.createDataFrame([(k, round(v, 6)) for k, v in p.items()], "predicate string, selectivity double")


@query("SELECT true AS has_rows, true AS has_size")
def op_03(spark, sf):
    text = diag.explain(load(spark, sf, "part").where("p_size > 10").groupBy("p_brand").count(), "cost")
    return spark.createDataFrame([("Statistics" in text, "sizeInBytes" in text)], "has_rows boolean, has_size boolean")


@query("SELECT true AS scans, true AS pushed, true AS pruned")
def op_04(spark, sf):
    text = diag.explain(load(spark, sf, "part").where("p_size > 10").select("p_partkey"))
    return spark.createDataFrame([("Scan parquet" in text, "GreaterThan(p_size,10)" in text, "p_name" not in text)], "scans boolean, pushed boolean, pruned boolean")


@query("SELECT 8::BIGINT AS partitions, true AS even")
def op_05(spark, sf):
    return diag.balance(load(spark, sf, "orders"), 8, "o_orderkey").select("partitions", (F.col("skew") < 1.5).alias("even"))
