"""Query-visible parts of what Spark itself subsumes: batches, pruning, merges, sorts, coding, transactions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lattica.functions import text
from lattica.operators import transactions
from lattica.operators.ordering import with_position
from lattica.plans.catalog import query
from lattica.plans.durable import staged
from lattica.plans.session import Session
from lattica.sources import diag
from lattica.tables import load

_c = F.col


@query("SELECT i::BIGINT AS k, (i * i)::BIGINT AS v FROM range(10) t(i)")
def sc_06(spark, sf):
    batches = [spark.createDataFrame([(i, i * i) for i in range(a, a + 5)], "k bigint, v bigint") for a in (0, 5)]
    return reduce(DataFrame.unionAll, batches)


@query("SELECT event_id, user_id FROM events WHERE event_id BETWEEN 300 AND 320")
def sc_09(spark, sf):
    df = load(spark, sf, "events").withColumn("zone", _c("event_id").cast("bigint").bitwiseAND(~63))
    near = diag.zones(df, "zone", "event_id").where(diag.candidate(">=", F.lit(300)) & diag.candidate("<=", F.lit(320)))
    return df.join(near.select("zone"), "zone", "left_semi").where("event_id BETWEEN 300 AND 320").select("event_id", "user_id")


@query("SELECT count(*) + 4 AS lines, true AS framed FROM region")
def sc_20(spark, sf):
    shown = diag.rendered(load(spark, sf, "region"), 20, 40).strip().split("\n")
    return spark.createDataFrame([(len(shown), shown[0].startswith("+"))], "lines bigint, framed boolean")


@query("SELECT count(*) FILTER (WHERE p_size > 10 AND p_size < 30) AS both, count(*) FILTER (WHERE p_size > 40 OR p_size < 5) AS either, count(*) FILTER (WHERE NOT p_size > 10) AS neither FROM part")
def pf_22(spark, sf):
    s = _c("p_size")
    return load(spark, sf, "part").agg(F.count_if((s > 10) & (s < 30)).alias("both"), F.count_if((s > 40) | (s < 5)).alias("either"), F.count_if(~(s > 10)).alias("neither"))


@query("SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def jn_16(spark, sf):
    nation = load(spark, sf, "nation")
    return load(spark, sf, "supplier").join(nation, _c("s_nationkey") == _c("n_nationkey")).select("s_suppkey", "n_name")


@query("SELECT l_returnflag, count(*) AS n, sum(l_partkey)::BIGINT AS s, min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem GROUP BY 1")
def ag_12(spark, sf):
    part = load(spark, sf, "lineitem").groupBy("l_returnflag", "l_suppkey").agg(F.count("*").alias("n"), F.sum("l_partkey").alias("s"), F.min("l_quantity").alias("lo"), F.max("l_quantity").alias("hi"))
    return part.groupBy("l_returnflag").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))


@query("SELECT l_returnflag, count(*) AS n, round(avg(l_quantity), 6) AS mean, round(var_pop(l_quantity), 4) AS var FROM lineitem GROUP BY 1")
def ag_19(spark, sf):
    q = _c("l_quantity")
    part = load(spark, sf, "lineitem").groupBy("l_returnflag", "l_suppkey").agg(F.count(q).alias("n"), F.avg(q).alias("m"), F.var_pop(q).alias("v"))
    merged = part.groupBy("l_returnflag").agg(F.sum("n").alias("n"), (F.sum(_c("n") * _c("m")) / F.sum("n")).alias("mean"), F.sum(_c("n") * (_c("v") + _c("m") * _c("m"))).alias("squares"))
    return merged.select("l_returnflag", "n", F.round("mean", 6).alias("mean"), F.round(_c("squares") / _c("n") - _c("mean") * _c("mean"), 4).alias("var"))


@query("SELECT row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS position, o_orderkey FROM orders")
def sl_05(spark, sf):
    return with_position(load(spark, sf, "orders"), [_c("o_totalprice"), _c("o_orderkey")]).select("position", "o_orderkey")


@query("SELECT row_number() OVER (ORDER BY -o_custkey, o_orderkey) AS position, o_orderkey FROM orders")
def sl_08(spark, sf):
    return with_position(load(spark, sf, "orders"), [-_c("o_custkey"), _c("o_orderkey")]).select("position", "o_orderkey")


@query("SELECT row_number() OVER (ORDER BY o_orderpriority, o_orderkey) AS turn, o_orderkey FROM orders WHERE o_orderstatus = 'O'")
def sl_10(spark, sf):
    waiting = load(spark, sf, "orders").where("o_orderstatus = 'O'")
    return with_position(waiting, [_c("o_orderpriority"), _c("o_orderkey")], "turn").select("turn", "o_orderkey")


@query("SELECT row_number() OVER (ORDER BY round(c_acctbal * 100)::BIGINT, c_custkey) AS position, c_custkey FROM customer")
def sl_11(spark, sf):
    cents = F.round(_c("c_acctbal") * 100).cast("bigint")
    sortable = F.lpad(F.hex(cents.bitwiseXOR(F.lit(-(2**63)))), 16, "0")  # the sign turned: text order is number order
    return with_position(load(spark, sf, "customer").withColumn("s", sortable), [_c("s"), _c("c_custkey")]).select("position", "c_custkey")


@query("""SELECT p_brand, p_name, (SELECT coalesce(max(i), 0) FROM range(1, 40) r(i) WHERE i <= length(p_name) AND i <= length(p) AND p_name[1:i] = p[1:i]) AS shared
          FROM (SELECT p_brand, p_name, coalesce(lag(p_name) OVER (PARTITION BY p_brand ORDER BY p_name), '') AS p FROM (SELECT DISTINCT p_brand, p_name FROM part))""")
def tx_30(spark, sf):
    names = load(spark, sf, "part").select("p_brand", "p_name").distinct()
    before = F.coalesce(F.lag("p_name").over(W.partitionBy("p_brand").orderBy("p_name")), F.lit(""))
    return names.withColumn("p", before).select("p_brand", "p_name", text.common_prefix(_c("p_name"), _c("p")).alias("shared"))


@query("SELECT count(DISTINCT c_name) AS names, count(DISTINCT c_name) AS hashes FROM customer")
def cd_05(spark, sf):
    return load(spark, sf, "customer").agg(F.countDistinct("c_name").alias("names"), F.countDistinct(F.xxhash64("c_name")).alias("hashes"))


@query("SELECT count(*) AS rows, sum(strlen(text))::BIGINT AS bytes FROM benchmark")
def cd_08(spark, sf):
    back = staged(load(spark, sf, "benchmark"), "compressed")
    return back.agg(F.count("*").alias("rows"), F.sum(F.octet_length("text")).alias("bytes"))


_REGION = "SELECT r_regionkey::BIGINT AS id, r_name AS s FROM region"


def _store(spark, sf):
    return transactions.Store(load(spark, sf, "region").select(_c("r_regionkey").cast("bigint").alias("id"), _c("r_name").alias("s")))


@query(f"SELECT 'now' AS seen, id, CASE WHEN id = 1 THEN 'x' ELSE s END AS s FROM ({_REGION}) UNION ALL SELECT 'then', id, s FROM ({_REGION})")
def tr_01(spark, sf):
    store = _store(spark, sf)
    reader, writer, late = store.begin(), store.begin(), store.begin("serializable")
    writer.update({"s": F.lit("x")}, _c("id") == 1)
    late.delete(_c("id") == 2)
    writer.commit()
    try:
        late.commit()
        raise AssertionError("the later commit must fail")
    except transactions.TransactionError:
        pass
    return store.current.select(F.lit("now").alias("seen"), "id", "s").unionAll(reader.read().select(F.lit("then"), "id", "s"))


@query(f"SELECT id, s FROM ({_REGION}) WHERE id <> 3")
def tr_06(spark, sf):
    t = _store(spark, sf).begin()
    t.delete(_c("id") == 3)
    t.savepoint("a")
    t.delete(_c("id") > 0)
    t.rollback_to("a")
    t.commit()
    return t.store.current


@query("SELECT 'autocommit' AS key, 'true' AS value UNION ALL SELECT 'max_rows', '10000' UNION ALL SELECT 'own', '5'")
def se_02(spark, sf):
    s = Session(spark)
    s.set("own", "5")
    return spark.createDataFrame([(k, s.get(k)) for k in ("autocommit", "max_rows", "own")], "key string, value string")
