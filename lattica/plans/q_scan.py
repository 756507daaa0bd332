"""Scans, projections, filters and predicates (SC-*, PF-*)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lattica.functions import nulls, scalar, text
from lattica.operators import ranges
from lattica.plans.catalog import query
from lattica.plans.durable import shared_dir
from lattica.sources import batchio, csvio, diag, jsonio, quality
from lattica.tables import load


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def sc_01(spark, sf):
    return load(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")


@query("""SELECT p_partkey, p_size FROM (SELECT p_partkey, nullif(p_size, 7) AS p_size FROM part) WHERE p_size <> 3 OR p_size IS NULL""")
def sc_02(spark, sf):
    df = load(spark, sf, "part").select("p_partkey", F.nullif("p_size", F.lit(7)).alias("p_size"))
    return df.where(nulls.script_compare("!=", F.col("p_size"), F.lit(3)))


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey = 42")
def sc_03(spark, sf):
    return load(spark, sf, "customer").where("c_custkey = 42").select("c_custkey", "c_name")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment = 'BUILDING'")
def sc_04(spark, sf):
    return load(spark, sf, "customer").where(F.col("c_mktsegment") == "BUILDING").select("c_custkey", "c_mktsegment")


@query("SELECT * FROM (VALUES (1::BIGINT, 10::BIGINT), (2, 20), (3, 30), (1, 40)) t(a, b)")
def sc_05(spark, sf):
    return spark.createDataFrame([(1, 10), (2, 20), (3, 30), (1, 40)], "a bigint, b bigint")


@query("SELECT * FROM (VALUES (1::BIGINT, 'x'), (2, NULL)) t(k, s)")
def sc_07(spark, sf):
    return spark.sql("SELECT * FROM VALUES (1L, 'x'), (2L, CAST(NULL AS STRING)) AS t(k, s)")


@query("SELECT (1 + 2)::BIGINT AS three, 'a' AS letter")
def sc_08(spark, sf):
    return spark.sql("SELECT 1L + 2L AS three, 'a' AS letter")


@query("""SELECT r AS probe, count(*) FILTER (WHERE lo <= r AND r <= hi) > 0 AS candidate FROM
          (SELECT l_returnflag, min(l_quantity) lo, max(l_quantity) hi FROM lineitem GROUP BY 1), (VALUES (-1.0::DOUBLE), (25.0), (1000.0)) v(r) GROUP BY r""")
def sc_10(spark, sf):
    zones = diag.zones(load(spark, sf, "lineitem"), "l_returnflag", "l_quantity")
    probes = [F.struct(F.lit(p).alias("probe"), F.coalesce(F.bool_or(diag.candidate("=", F.lit(p))), F.lit(False)).alias("candidate")) for p in (-1.0, 25.0, 1000.0)]
    return zones.agg(*(p.alias(f"p{i}") for i, p in enumerate(probes))).select(F.inline(F.array("p0", "p1", "p2")))


_CSV = 'id,flag,x,name\r\n1,true,1.5,"a,b"\r\n2,false,,"say ""hi"""\r\n3,true,2.0,"two\nlines"\r\n\r\n4,false,7\r\n'


@query("""SELECT * FROM (VALUES (1::BIGINT, true, 1.5::DOUBLE, 'a,b'), (2, false, NULL, 'say "hi"'), (3, true, 2.0, 'two
lines'), (4, false, 7.0, NULL)) t(id, flag, x, name)""")
def sc_11(spark, sf):
    path = f"{shared_dir(spark)}/lattica-csv-{uuid.uuid4().hex}"
    spark.createDataFrame([(_CSV,)], "value string").coalesce(1).write.option("lineSep", "\n").text(path)
    return csvio.read_csv(spark, path)


@query("""SELECT * FROM (VALUES (1::BIGINT, 'id', 'flag'), (2, '1', 'true'), (3, '2', 'false'), (4, '3', 'true'), (5, '4', 'false')) t(record, first, second)""")
def sc_12(spark, sf):
    rows = csvio.records(_CSV)
    return spark.createDataFrame([(i, r[0], r[1]) for i, r in enumerate(rows, 1)], "record bigint, first string, second string")


@query("""SELECT * FROM (VALUES ('a', 'bigint'), ('b', 'double'), ('c', 'boolean'), ('d', 'string'), ('e', 'string')) t(name, kind)""")
def sc_13(spark, sf):
    samples = {"a": ["1", "-2", None], "b": ["1", "2.5"], "c": ["true", "0"], "d": ["x", "1"], "e": [None, None]}
    return spark.createDataFrame([(k, csvio.infer_kind(v)) for k, v in samples.items()], "name string, kind string")


@query("""SELECT r_regionkey::BIGINT AS k, r_regionkey::VARCHAR || ',' || CASE WHEN r_name LIKE '%"%' OR r_name LIKE '%,%' THEN '"' || replace(r_name, '"', '""') || '"' ELSE r_name END AS line FROM region""")
def sc_14(spark, sf):
    df = load(spark, sf, "region")
    return df.select(F.col("r_regionkey").cast("bigint").alias("k"), csvio.line(["r_regionkey", "r_name"]).alias("line"))


@query("SELECT event_id, (props->>'k')::BIGINT AS k FROM events")
def sc_15(spark, sf):
    return load(spark, sf, "events").select("event_id", jsonio.parsed("props", "k bigint")["k"].alias("k"))


@query("SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def sc_16(spark, sf):
    return batchio.round_trip(load(spark, sf, "supplier").select("s_suppkey", "s_name", "s_nationkey", "s_acctbal"), "supplier")


@query("""SELECT 'unique o_orderkey' AS rule, (SELECT count(*) FROM (SELECT o_orderkey FROM orders GROUP BY 1 HAVING count(*) > 1))::BIGINT AS violations
          UNION ALL SELECT 'not null o_custkey', (SELECT count(*) FROM orders WHERE o_custkey IS NULL)::BIGINT
          UNION ALL SELECT 'foreign o_custkey', (SELECT count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer))::BIGINT""")
def sc_18(spark, sf):
    orders, customer = load(spark, sf, "orders"), load(spark, sf, "customer")
    return quality.verify(orders, unique=["o_orderkey"], not_null=["o_custkey"], foreign={"o_custkey": (customer, "c_custkey")})


@query("SELECT 'nation' AS name, 3::BIGINT AS columns, count(*)::BIGINT AS rows FROM nation")
def sc_21(spark, sf):
    return diag.summary(load(spark, sf, "nation"), "nation")


@query("""SELECT 'scan' AS statement, 5::BIGINT AS rows""")
def sc_22(spark, sf):
    from lattica.plans.script import run_script

    report, _ = run_script(load(spark, sf, "region"), "scan")
    return spark.createDataFrame([("scan", report.rows_scanned)], "statement string, rows bigint")


@query("SELECT p_partkey FROM part WHERE p_size > 10 AND p_retailprice < 950")
def pf_01(spark, sf):
    return load(spark, sf, "part").where("p_size > 10 AND p_retailprice < 950").select("p_partkey")


@query("SELECT p_partkey FROM part WHERE p_size % 5 <> 0 AND 100 // nullif(p_size % 5, 0) > 30")
def pf_02(spark, sf):
    five = F.col("p_size").cast("bigint") % 5
    return load(spark, sf, "part").where(scalar.int_div(F.lit(100).cast("bigint"), five) > 30).select("p_partkey")


@query("SELECT l_orderkey, round(l_extendedprice * (1 - l_discount), 4) AS net FROM lineitem")
def pf_03(spark, sf):
    return load(spark, sf, "lineitem").select("l_orderkey", F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4).alias("net"))


@query("SELECT n_name, n_nationkey FROM nation")
def pf_04(spark, sf):
    return load(spark, sf, "nation").select("n_name", "n_nationkey")


@query("SELECT p_partkey, TRY_CAST(split_part(p_name, ' ', 1) AS BIGINT) AS n FROM part")
def pf_05(spark, sf):
    return load(spark, sf, "part").withColumn("n", text.split_part(F.col("p_name"), " ", 0).try_cast("bigint")).select("p_partkey", "n")


@query("SELECT c_custkey, trunc(c_acctbal)::BIGINT AS whole, c_acctbal <> 0 AS any_left FROM customer")
def pf_06(spark, sf):
    return load(spark, sf, "customer").select("c_custkey", scalar.to_int(F.col("c_acctbal")).alias("whole"), F.col("c_acctbal").cast("boolean").alias("any_left"))


@query("SELECT p_partkey, p_size = 10 AS eq, p_size <> 10 AS ne, p_size < 10 AS lt, p_size <= 10 AS le, p_size > 10 AS gt, p_size >= 10 AS ge FROM part")
def pf_07(spark, sf):
    names = {"eq": "=", "ne": "!=", "lt": "<", "le": "<=", "gt": ">", "ge": ">="}
    return load(spark, sf, "part").select("p_partkey", *(nulls.compare(op, F.col("p_size"), F.lit(10)).alias(n) for n, op in names.items()))


_AB = "SELECT p_partkey, nullif(p_size % 3, 0) > 1 AS a, nullif(p_size % 4, 1) > 1 AS b FROM part"


def _flags(spark, sf):
    c = F.col("p_size")
    return load(spark, sf, "part").select("p_partkey", (F.nullif(c % 3, F.lit(0)) > 1).alias("a"), (F.nullif(c % 4, F.lit(1)) > 1).alias("b"))


@query(f"SELECT p_partkey, a AND b AS both, a OR b AS either, NOT a AS neither FROM ({_AB})")
def pf_08(spark, sf):
    return _flags(spark, sf).select("p_partkey", (F.col("a") & F.col("b")).alias("both"), (F.col("a") | F.col("b")).alias("either"), (~F.col("a")).alias("neither"))


@query(f"SELECT p_partkey, coalesce(a, false) AND coalesce(b, false) AS both, coalesce(a, false) OR coalesce(b, false) AS either, NOT coalesce(a, false) AS neither FROM ({_AB})")
def pf_09(spark, sf):
    a, b = F.col("a"), F.col("b")
    return _flags(spark, sf).select("p_partkey", nulls.and2(a, b).alias("both"), nulls.or2(a, b).alias("either"), nulls.not2(a).alias("neither"))


@query("""SELECT p_partkey, (p_size + 7)::BIGINT AS plus, (p_size - 25)::BIGINT AS minus, (p_size * 3)::BIGINT AS times,
          ((p_size - 25) // nullif(p_size % 4, 0))::BIGINT AS quotient, ((p_size - 25) % nullif(p_size % 4, 0))::BIGINT AS rest FROM part""")
def pf_10(spark, sf):
    c = F.col("p_size").cast("bigint")
    return load(spark, sf, "part").select("p_partkey", F.try_add(c, F.lit(7).cast("bigint")).alias("plus"), F.try_subtract(c, F.lit(25).cast("bigint")).alias("minus"), F.try_multiply(c, F.lit(3).cast("bigint")).alias("times"), scalar.int_div(c - 25, c % 4).alias("quotient"), F.try_mod(c - 25, c % 4).alias("rest"))


@query("SELECT c_custkey, -c_acctbal AS owed FROM customer")
def pf_11(spark, sf):
    return load(spark, sf, "customer").select("c_custkey", (-F.col("c_acctbal")).alias("owed"))


@query("SELECT p_partkey, nullif(p_size, 5) IS NULL AS gone, nullif(p_size, 5) IS NOT NULL AS there FROM part")
def pf_12(spark, sf):
    c = F.nullif(F.col("p_size"), F.lit(5))
    return load(spark, sf, "part").select("p_partkey", c.isNull().alias("gone"), c.isNotNull().alias("there"))


@query("SELECT p_partkey, nullif(p_size, 12) BETWEEN 10 AND 20 AS inside FROM part")
def pf_13(spark, sf):
    return load(spark, sf, "part").select("p_partkey", F.nullif(F.col("p_size"), F.lit(12)).between(10, 20).alias("inside"))


@query("SELECT p_partkey, p_size IN (1, 2, 3, NULL) AS listed FROM part")
def pf_14(spark, sf):
    return load(spark, sf, "part").select("p_partkey", F.expr("p_size IN (1, 2, 3, NULL)").alias("listed"))


@query(r"SELECT p_partkey, p_type FROM part WHERE p_type LIKE '%E_' OR p_name LIKE 'a%' ")
def pf_15(spark, sf):
    return load(spark, sf, "part").where(F.col("p_type").like("%E_") | F.col("p_name").like("a%")).select("p_partkey", "p_type")


@query("SELECT p_partkey, p_brand FROM part WHERE p_brand GLOB 'Brand?[1-3]*'")
def pf_16(spark, sf):
    return load(spark, sf, "part").where(text.glob(F.col("p_brand"), "Brand?[1-3]*")).select("p_partkey", "p_brand")


@query("SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name, '^[a-m].*e')")
def pf_17(spark, sf):
    return load(spark, sf, "part").where(text.regex(F.col("p_name"), "^[a-m].*e")).select("p_partkey", "p_name")


@query("SELECT p_partkey FROM part WHERE p_size NOT IN (1, 2, 3) AND p_name NOT LIKE 'a%' AND p_size NOT BETWEEN 10 AND 40")
def pf_18(spark, sf):
    c = F.col("p_size")
    return load(spark, sf, "part").where(~c.isin(1, 2, 3) & ~F.col("p_name").like("a%") & ~c.between(10, 40)).select("p_partkey")


@query("SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'middle' ELSE 'large' END AS class FROM part")
def pf_19(spark, sf):
    c = F.col("p_size")
    return load(spark, sf, "part").select("p_partkey", F.when(c < 10, "small").when(c < 30, "middle").otherwise("large").alias("class"))


@query("SELECT n.n_name AS nation, r.*, 1::BIGINT AS one FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey")
def pf_20(spark, sf):
    n, r = load(spark, sf, "nation").alias("n"), load(spark, sf, "region").alias("r")
    return n.join(r, F.col("n.n_regionkey") == F.col("r.r_regionkey")).select(F.col("n.n_name").alias("nation"), "r.*", F.lit(1).cast("bigint").alias("one"))


@query("""SELECT n_nationkey, n_name FROM (SELECT n_nationkey, n_name FROM nation ORDER BY n_nationkey LIMIT 5 OFFSET 3)
          UNION ALL SELECT n_nationkey, n_name FROM nation WHERE n_nationkey % 7 = 0""")
def pf_21(spark, sf):
    df = load(spark, sf, "nation").select("n_nationkey", "n_name")
    return df.orderBy("n_nationkey").offset(3).limit(5).unionByName(df.where("n_nationkey % 7 = 0"))


@query("""WITH r AS (SELECT user_id, event_id // 10 AS lo, event_id // 10 + event_id % 5 AS hi FROM events),
          f AS (SELECT *, CASE WHEN lo <= max(hi) OVER (PARTITION BY user_id ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS f FROM r),
          g AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS g FROM f),
          m AS (SELECT user_id, min(lo) AS lo, max(hi) AS hi FROM g GROUP BY user_id, g),
          n AS (SELECT user_id, hi + 1 AS lo, lead(lo) OVER (PARTITION BY user_id ORDER BY lo) - 1 AS hi FROM m)
          SELECT 'in' AS side, user_id, lo::BIGINT AS lo, hi::BIGINT AS hi FROM m UNION ALL SELECT 'out', user_id, lo::BIGINT, hi::BIGINT FROM n WHERE hi IS NOT NULL""")
def pf_23(spark, sf):
    e = F.col("event_id")
    r = load(spark, sf, "events").select("user_id", F.expr("event_id div 10").alias("lo"), (F.expr("event_id div 10") + e % 5).alias("hi"))
    merged = ranges.islands(r, ["user_id"], width=500)
    side = lambda df, s: df.select(F.lit(s).alias("side"), "user_id", "lo", "hi")
    return side(merged, "in").unionAll(side(ranges.gaps(merged, ["user_id"]), "out"))
