"""Graph and join queries read every row of their tables."""

from lattica import registry

SF = "/root/testdata/sf0.001"


def test_graph_reads_every_order(spark):
    orders = {r["o_orderkey"]: r["o_custkey"] for r in spark.read.parquet(f"{SF}/orders.parquet").collect()}
    run = registry.queries()
    out = {r["v"]: r["out_degree"] for r in run["gr_05"](spark, SF).collect()}
    assert {v for v, n in out.items() if n == 1} == set(orders) and sum(out.values()) == len(orders)
    own: dict = {}
    for k, c in orders.items():
        own.setdefault(c, []).append(k)
    strong = {k: min(own[c]) if c % 2 == 0 else k for k, c in orders.items()} | {-c: -c for c in own if c % 2}
    assert {r["v"]: r["component"] for r in run["gr_04"](spark, SF).collect()} == strong
    weak = {k: min(own[c]) if c % 2 == 0 else -c for k, c in orders.items()} | {-c: -c for c in own if c % 2}
    assert {r["v"]: r["component"] for r in run["gr_07"](spark, SF).collect()} == weak


def test_joins_read_every_row_and_fan_out(spark):
    run = registry.queries()
    orders, items = (spark.read.parquet(f"{SF}/{t}.parquet").count() for t in ("orders", "lineitem"))
    inner, left, right, full = (run[f"jn_0{n}"](spark, SF) for n in (2, 3, 4, 5))
    assert right.count() == items and inner.groupBy("ok").count().where("count > 1").count() > 0
    assert left.count() - inner.count() == run["jn_07"](spark, SF).count() > 0
    assert run["jn_06"](spark, SF).count() + run["jn_07"](spark, SF).count() == orders
    assert full.count() == left.count() + right.count() - inner.count()


def test_no_sketch_for_each_distinct_key(spark):
    """Beside a distinct count in one aggregate, a sketch of 3 KB is kept and shuffled for every key."""
    plan = registry.queries()["ag_22"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    keyed = [line for line in plan.splitlines() if "Aggregate(keys=[l_partkey" in line]
    assert keyed and not any("approx_count_distinct" in line or "hll_" in line for line in keyed)
