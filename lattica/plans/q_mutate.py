"""Mutation, versions, sessions, scripts and graphs (MU-*, TR-*, SE-*, SX-*, GR-*)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lattica.functions.nulls import script_compare
from lattica.operators import graph, mutate, versions
from lattica.plans.catalog import query
from lattica.plans.metastore import CatalogError, Metastore
from lattica.plans.script import run_script
from lattica.plans.session import Session
from lattica.tables import load

_c = F.col
_PART = "SELECT p_partkey, nullif(p_size, 9)::BIGINT AS p_size, p_brand FROM part"


def _part(spark, sf):
    return load(spark, sf, "part").select("p_partkey", F.nullif("p_size", F.lit(9)).cast("bigint").alias("p_size"), "p_brand")


@query(f"SELECT * FROM ({_PART}) UNION ALL SELECT max(p_partkey) + 1, 5, 'new' FROM part UNION ALL SELECT 9000000, NULL, 'far' FROM region WHERE r_regionkey = 0")
def mu_01(spark, sf):
    return mutate.insert(_part(spark, sf), [(0, 5, "new"), (9000000, None, "far")], id_col="p_partkey")


@query(f"SELECT p_partkey, CASE WHEN p_brand = 'Brand#11' THEN 0 ELSE p_size END AS p_size, p_brand FROM ({_PART})")
def mu_02(spark, sf):
    return mutate.update(_part(spark, sf), {"p_size": F.lit(0)}, script_compare("=", _c("p_brand"), F.lit("Brand#11")))


@query(f"SELECT * FROM ({_PART}) WHERE NOT (p_size <> 4 OR p_size IS NULL)")
def mu_03(spark, sf):
    return mutate.delete(_part(spark, sf), script_compare("!=", _c("p_size"), F.lit(4)))


@query("SELECT count(*) AS n FROM part WHERE p_size <= 25")
def mu_04(spark, sf):
    return mutate.delete(load(spark, sf, "part"), _c("p_size") > 25).agg(F.count("*").alias("n"))


@query("SELECT count(*) AS n, sum(p_partkey)::BIGINT AS s, 2::BIGINT AS partitions FROM part")
def mu_05(spark, sf):
    df = mutate.compacted(load(spark, sf, "part"), 2)
    return df.select("p_partkey", F.spark_partition_id().alias("p")).agg(F.count("*").alias("n"), F.sum("p_partkey").alias("s"), F.countDistinct("p").alias("partitions"))


@query("SELECT r_regionkey, r_name FROM region")
def mu_06(spark, sf):
    _, own = run_script(load(spark, sf, "region"), "checkpoint; scan")
    return own.results[0]


@query(f"SELECT * FROM ({_PART}) UNION ALL SELECT * FROM (VALUES (9000001::BIGINT, NULL::BIGINT, 'a'), (9000002, NULL, 'b'))")
def mu_07(spark, sf):
    return mutate.insert(_part(spark, sf), [("a", 9000001), ("b", 9000002)], ["p_brand", "p_partkey"])


@query(f"SELECT p_partkey, CASE WHEN p_size > 20 THEN p_size * 2 ELSE p_size END AS p_size, CASE WHEN p_size > 20 THEN p_brand || '*' ELSE p_brand END AS p_brand FROM ({_PART})")
def mu_08(spark, sf):
    return mutate.update(_part(spark, sf), {"p_size": _c("p_size") * 2, "p_brand": F.concat("p_brand", F.lit("*"))}, _c("p_size") > 20)


@query(f"SELECT * FROM ({_PART}) WHERE p_size IS NULL OR NOT (p_size <> 4)")
def mu_09(spark, sf):
    return mutate.delete(_part(spark, sf), _c("p_size") != 4)


@query("SELECT 'id bigint, name string, v double' AS columns, true AS gone")
def mu_10(spark, sf):
    df = spark.createDataFrame([], "id bigint NOT NULL, name string NOT NULL, v double")
    df.createOrReplaceTempView("lattica_mu_10")
    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in spark.table("lattica_mu_10").schema)
    gone = spark.catalog.dropTempView("lattica_mu_10")
    return spark.createDataFrame([(kept, gone and not spark.catalog.tableExists("lattica_mu_10"))], "columns string, gone boolean")


@query("SELECT true AS refused, 2::BIGINT AS next, 'SELECT 1' AS view")
def mu_11(spark, sf):
    m = Metastore()
    m.create_table("t", ["id", "x"])
    m.create_index("i", "t", "x")
    m.create_sequence("s")
    m.next_value("s")
    m.create_view("v", "SELECT 1")
    try:
        m.drop_table("t")
        refused = False
    except CatalogError:
        refused = True
    return spark.createDataFrame([(refused, m.next_value("s"), m.views["v"])], "refused boolean, next bigint, view string")


_V = """SELECT user_id AS row_id, event_id AS value, event_id AS begin_ts, coalesce(lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id), 9223372036854775807) AS end_ts,
        event_id % 11 <> 0 AS committed, event_type = 'error' AS deleted, event_id % 5 AS writer FROM events"""


def _versions(spark, sf):
    from pyspark.sql import Window as W

    end = F.coalesce(F.lead("event_id").over(W.partitionBy("user_id").orderBy("event_id")), F.lit(versions.INFINITE))
    return load(spark, sf, "events").select(_c("user_id").alias("row_id"), _c("event_id").alias("value"), _c("event_id").alias("begin_ts"), end.alias("end_ts"), (_c("event_id") % 11 != 0).alias("committed"), (_c("event_type") == "error").alias("deleted"), (_c("event_id") % 5).alias("writer"))


@query(f"SELECT row_id, value FROM ({_V}) WHERE NOT deleted AND ((committed AND begin_ts <= 500 AND end_ts > 500) OR (NOT committed AND writer = 2 AND end_ts = 9223372036854775807))")
def tr_02(spark, sf):
    return versions.visible(_versions(spark, sf), 500, 2).select("row_id", "value")


@query(f"SELECT row_id, value FROM ({_V}) WHERE NOT committed OR end_ts = 9223372036854775807 OR end_ts >= 700")
def tr_03(spark, sf):
    return versions.collected(_versions(spark, sf), 700).select("row_id", "value")


@query(f"SELECT DISTINCT 1::BIGINT AS txn, r.row_id FROM (SELECT DISTINCT user_id AS row_id FROM events) r JOIN ({_V}) v USING (row_id) WHERE committed AND begin_ts > 900 AND writer <> 1")
def tr_04(spark, sf):
    reads = load(spark, sf, "events").select(F.lit(1).cast("bigint").alias("txn"), F.lit(900).cast("bigint").alias("begin"), _c("user_id").alias("row_id")).distinct()
    return versions.conflicts(reads, _versions(spark, sf))


@query("SELECT true AS deadlock, false AS chain")
def tr_05(spark, sf):
    cyclic = graph.has_cycle(spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 1)], "src bigint, dst bigint")).select(_c("has_cycle").alias("deadlock"))
    return cyclic.crossJoin(graph.has_cycle(spark.createDataFrame([(1, 2), (2, 3)], "src bigint, dst bigint")).select(_c("has_cycle").alias("chain")))  # one row each


@query("""WITH w AS (SELECT event_id AS lsn, user_id % 37 AS txn, CASE event_type WHEN 'error' THEN 'delete' WHEN 'signup' THEN 'commit' ELSE 'put' END AS type, user_id AS row_id, event_id AS value FROM events),
          l AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY lsn DESC) AS n FROM w WHERE type <> 'commit' AND txn IN (SELECT txn FROM w WHERE type = 'commit'))
          SELECT row_id, value FROM l WHERE n = 1 AND type = 'put'""")
def tr_07(spark, sf):
    kind = F.when(_c("event_type") == "error", "delete").when(_c("event_type") == "signup", "commit").otherwise("put")
    return versions.replay(load(spark, sf, "events").select(_c("event_id").alias("lsn"), (_c("user_id") % 37).alias("txn"), kind.alias("type"), _c("user_id").alias("row_id"), _c("event_id").alias("value")))


def _pages(spark, sf):
    return load(spark, sf, "events").select(_c("user_id").alias("page"), _c("event_id").alias("version"), _c("event_type").alias("data"))


@query("SELECT user_id AS page, max_by(event_type, event_id) AS data FROM events WHERE event_id <= 600 GROUP BY 1")
def tr_08(spark, sf):
    return versions.snapshot(_pages(spark, sf), 600)


@query("SELECT user_id AS page, event_id AS version FROM events e WHERE event_id > 600 OR event_id = (SELECT max(event_id) FROM events f WHERE f.user_id = e.user_id AND f.event_id <= 600)")
def tr_09(spark, sf):
    return versions.snapshot_gc(_pages(spark, sf), 600).select("page", "version")


@query("SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 2 AND n_name <> '?'")
def se_01(spark, sf):
    s = Session(spark)
    s.prepare("q", "SELECT n_nationkey, n_name FROM lattica_nation WHERE n_regionkey = ? AND n_name <> '?'")
    return s.execute("q", 2, lattica_nation=load(spark, sf, "nation"))


_TABLE = "SELECT r_regionkey::BIGINT AS id, r_regionkey::BIGINT * 10 AS x, r_name AS s FROM region"


def _script(spark, sf, script):
    df = load(spark, sf, "region").select(_c("r_regionkey").cast("bigint").alias("id"), (_c("r_regionkey").cast("bigint") * 10).alias("x"), _c("r_name").alias("s"))
    return run_script(df, script)[1]


@query(f"SELECT * FROM ({_TABLE}) UNION ALL SELECT 5, 50, 'NEW; REGION'")
def sx_01(spark, sf):
    return _script(spark, sf, 'insert 0 50 "NEW; REGION"').table


@query(f"SELECT id, CASE WHEN id > 2 THEN 7 ELSE x END AS x, s FROM ({_TABLE})")
def sx_02(spark, sf):
    return _script(spark, sf, "update set x 7 where id > 2").table


@query(f"SELECT * FROM ({_TABLE}) WHERE x = 20")
def sx_03(spark, sf):
    return _script(spark, sf, "delete where 1 != 20").table


@query(_TABLE)
def sx_04(spark, sf):
    return _script(spark, sf, "scan").results[0]


@query(f"SELECT * FROM ({_TABLE}) WHERE x >= 20")
def sx_05(spark, sf):
    return _script(spark, sf, "scan where x >= 20").results[0]


@query(f"SELECT * FROM ({_TABLE}) WHERE s = 'ASIA'")
def sx_06(spark, sf):
    return _script(spark, sf, 'index_scan s "ASIA"').results[0]


@query("SELECT 3::BIGINT AS id, 4::BIGINT AS next_id, 1::BIGINT AS x")
def sx_07(spark, sf):
    return _script(spark, sf, "update set x 1 where id > 2; join").results[0].select("id", "next_id", "x")


@query(_TABLE)
def sx_08(spark, sf):
    return _script(spark, sf, "compact").table


@query(_TABLE)
def sx_09(spark, sf):
    return _script(spark, sf, "checkpoint").table


@query(f"SELECT count(x) AS count, sum(x)::BIGINT AS sum, min(x) AS min, max(x) AS max FROM ({_TABLE})")
def sx_10(spark, sf):
    return _script(spark, sf, "agg x").results[0]


# The graph of all orders: an order leads to its customer's next one; the last one leads to the first
# for even customers, which makes a cycle, and to the customer (a negative vertex) for odd ones, which makes a chain.
_E = """SELECT o_orderkey::BIGINT AS src, coalesce(lead(o_orderkey) OVER w, CASE WHEN o_custkey % 2 = 0 THEN first_value(o_orderkey) OVER w ELSE -o_custkey END)::BIGINT AS dst
              FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)"""
_CLOSURE = f"WITH RECURSIVE e AS ({_E}), t(src, dst) AS (SELECT src, dst FROM e UNION SELECT t.src, e.dst FROM t JOIN e ON t.dst = e.src)"


def _graph(spark, sf):
    w = W.partitionBy("o_custkey").orderBy("o_orderkey")
    last = F.when(_c("o_custkey") % 2 == 0, F.first("o_orderkey").over(w)).otherwise(-_c("o_custkey"))
    return load(spark, sf, "orders").select(_c("o_orderkey").cast("bigint").alias("src"), F.coalesce(F.lead("o_orderkey").over(w), last).cast("bigint").alias("dst"))


@query("SELECT true AS forward, 25::BIGINT + 5 AS vertices")
def gr_01(spark, sf):
    n = load(spark, sf, "nation")
    edges = n.select((_c("n_regionkey") + 100).cast("bigint").alias("src"), _c("n_nationkey").cast("bigint").alias("dst"))
    at = graph.levels(edges)
    a, b = at.select(_c("v").alias("src"), _c("level").alias("a")), at.select(_c("v").alias("dst"), _c("level").alias("b"))
    ahead = edges.join(a, "src").join(b, "dst").agg(F.bool_and(_c("a") < _c("b")).alias("forward"))
    return ahead.crossJoin(at.agg(F.count("*").alias("vertices")))  # one row each


@query(f"{_CLOSURE} SELECT bool_or(src = dst) AS has_cycle FROM t")
def gr_02(spark, sf):
    return graph.has_cycle(_graph(spark, sf))


@query(f"{_CLOSURE} SELECT dst AS v FROM t WHERE src = 1 UNION SELECT 1")
def gr_03(spark, sf):
    return graph.reachable(_graph(spark, sf), 1)


@query(f"{_CLOSURE}, v AS (SELECT src AS v FROM e UNION SELECT dst FROM e), m AS (SELECT a.src AS v, min(a.dst) AS m FROM t a JOIN t b ON a.src = b.dst AND a.dst = b.src GROUP BY 1) SELECT v, least(v, coalesce(m, v)) AS component FROM v LEFT JOIN m USING (v)")
def gr_04(spark, sf):
    return graph.strong_components(_graph(spark, sf))


@query(f"SELECT v, sum(i)::BIGINT AS in_degree, sum(o)::BIGINT AS out_degree FROM (SELECT src AS v, 0 AS i, 1 AS o FROM ({_E}) UNION ALL SELECT dst, 1, 0 FROM ({_E})) GROUP BY v")
def gr_05(spark, sf):
    return graph.degrees(_graph(spark, sf))


@query(f"{_CLOSURE} SELECT src, dst FROM t")
def gr_06(spark, sf):
    return graph.closure(_graph(spark, sf))


@query(f"WITH RECURSIVE e AS ({_E}), b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), t(src, dst) AS (SELECT src, dst FROM b UNION SELECT t.src, b.dst FROM t JOIN b ON t.dst = b.src) SELECT src AS v, least(src, min(dst)) AS component FROM t GROUP BY src")
def gr_07(spark, sf):
    return graph.components(_graph(spark, sf))
