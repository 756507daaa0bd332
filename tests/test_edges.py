"""Edge cases that the fixture tables lack: NULLs, ties, empty tables, odd numbers and texts."""

import math
import random

import pytest
from pyspark.sql import functions as F

from lattica.functions import codecs, dates, decimals, jsons, nulls, scalar, text
from lattica.operators import aggregate, graph, joins, mutate, ranges, stats, udx, versions, windows
from lattica.operators.ordering import with_position
from lattica.plans import durable
from lattica.plans.script import run_script, statements
from lattica.plans.session import Session, SessionError
from lattica.sources import csvio


def one(spark, *cols):
    return list(spark.range(1).select(*cols).first())


@pytest.fixture(scope="module")
def t_nulls(spark):
    return spark.createDataFrame([(1, 1, 1.5, "a"), (2, None, None, None), (3, None, 2.5, "b"), (4, 1, None, "a")], "id bigint, k bigint, v double, s string")


def test_script_comparison_with_nulls(spark):
    n, x = F.lit(None).cast("int"), F.lit(1)
    assert one(spark, *(nulls.script_compare(op, a, b) for op in ("=", "!=", "<") for a, b in ((n, x), (n, n)))) == [False, False, True, True, False, False]


def test_two_valued_logic(spark):
    n = F.lit(None).cast("boolean")
    assert one(spark, nulls.and2(n, F.lit(True)), nulls.or2(n, F.lit(True)), nulls.not2(n)) == [False, True, True]


def test_numbers(spark):
    x = F.lit
    assert one(spark, scalar.round_half_away(x(1.005), 2), scalar.round_half_away(x(-2.5)), scalar.sqrt(x(-1.0)), scalar.mod(x(7), x(0)), scalar.int_div(x(-7).cast("bigint"), x(2).cast("bigint")), scalar.sign(x(-0.5))) == [1.0, -3.0, None, None, -3, -1]
    n = x(None).cast("int")
    assert one(spark, scalar.iif(n > 1, x(1), x(2)), scalar.min2(n, x(1)), scalar.clamp(x(5), x(9), x(3)), F.least(n, x(1)), scalar.min_nulls_smallest(n, x(1))) == [None, None, 3, 1, None]


def test_registry(spark):
    r = scalar.Registry()
    r.register(scalar.Scalar("twice", 1, 1, lambda x: x * 2))
    assert one(spark, r.call("TWICE", F.lit(4)), r.call("nothing", F.lit(1)), r.call("abs")) == [8, None, None] and "twice" in r.names()


def test_substr_and_trim(spark):
    s = F.lit("hello")
    assert one(spark, text.substr(s, 0, 3), text.substr(s, -2, 2), text.substr(s, 2), text.substr(s, -1), text.substr(s, 9)) == ["he", "", "ello", "hello", ""]
    assert one(spark, text.trim(F.lit("\t  é x  "))) == ["é x"]


@pytest.mark.parametrize(("pattern", "s", "hit"), [("a*c", "abbc", True), ("?b", "ab", True), ("[!a]x", "ax", False), ("[a-c]x", "bx", True), ("a\\*", "a*", True), ("a\\*", "ab", False), ("a.c", "abc", False)])
def test_glob(spark, pattern, s, hit):
    assert one(spark, text.glob(F.lit(s), pattern)) == [hit]


def test_small_regex(spark):
    assert one(spark, text.regex(F.lit("a+b"), "^a+b$"), text.regex(F.lit("aab"), "^a+b$"), text.regex(F.lit("abc"), "^a.c$")) == [True, False, True]


def test_fuzzy(spark):
    a, b = F.lit("ca"), F.lit("abc")
    assert one(spark, text.similarity(F.lit(""), F.lit("")), text.common_prefix(F.lit("abx"), F.lit("aby")), text.common_prefix(F.lit(""), b), text.bounded_levenshtein(a, b, 1)) == [1.0, 2, 0, None]
    assert udx.osa("ca", "abc") == 3 and udx.osa("ab", "ba") == 1 and udx.osa("", "xy") == 2
    assert one(spark, text.offsets(F.lit("éaaa"), "aa"), text.offsets(F.lit("a"), "aa")) == [[2, 3], []]


def test_dates(spark):
    d = lambda s: F.lit(s).cast("date")
    got = one(spark, dates.add(d("2024-01-31"), 1, "month").cast("string"), dates.diff_months(d("2024-01-31"), d("2024-02-29")), dates.extract("weekday", d("2024-01-07")), dates.parse_date(F.lit("2023-02-30")).cast("string"), dates.truncate(d("1969-12-31"), "week").cast("string"), dates.add(d("2024-01-31"), 1, "era").cast("string"))
    assert got == ["2024-02-29", 0, 6, None, "1969-12-29", "2024-01-31"]
    t = lambda s: dates.parse_timestamp(F.lit(s)).cast("string")
    assert one(spark, t("2024-01-02T03"), t("2024-01-02 03:04"), t("2024-01-02"), t("x"), t("2024-01-02 03:04:05.1234567")) == ["2024-01-02 03:00:00", "2024-01-02 03:04:00", "2024-01-02 00:00:00", None, "2024-01-02 03:04:05.123456"]


def test_decimals(spark):
    x = lambda s: F.lit(s).cast("decimal(12,3)")
    got = one(spark, *(decimals.rescale(x("2.5"), 0, m).cast("int") for m in decimals.MODES), decimals.rescale(x("-2.7"), 0, "down").cast("int"), decimals.divide(x("1"), x("0"), 2), decimals.parse(F.lit("1_000.5"), 1).cast("string"), decimals.parse(F.lit("x"), 1))
    assert got == [3, 2, 2, -2, None, "1000.5", None]


def test_json(spark):
    j = F.lit('{"a":[{"b":1.5}],"x/y":2,"m~n":true}')
    assert one(spark, jsons.lookup(j, "/a/0/b"), jsons.lookup(j, "/x~1y"), jsons.lookup(j, "/m~0n"), jsons.typed(j, "/a/0/b", "bigint"), jsons.typed(j, "/x~1y", "bigint"), jsons.valid(F.lit("{"))) == ["1.5", "2", "true", None, 2, False]


def test_codecs(spark):
    assert one(spark, codecs.hex_decode(F.lit("abc")), codecs.base64_decode(F.lit("YQ")), codecs.base64_decode(F.lit("Y Q==")), codecs.adler32(F.lit("Wikipedia")), codecs.adler32(F.lit(""))) == [None, None, b"a", 300286872, 1]


def test_joins_skip_null_keys(spark):
    left = spark.createDataFrame([(1, 1), (1, 2), (2, 3), (None, 4)], "k bigint, v bigint")
    right = spark.createDataFrame([(1, 10), (1, 11), (3, 12), (None, 13)], "k bigint, v bigint")
    counts = {k: joins.equi_join(left, right, [("k", "k")], k).count() for k in joins.KINDS}
    assert counts == {"inner": 4, "left": 6, "right": 6, "full": 8, "left_semi": 2, "left_anti": 2}


def test_aggregates_on_nulls_and_nothing(spark, t_nulls):
    row = t_nulls.agg(F.count("v").alias("n"), aggregate.first_by(F.col("v"), F.col("id")).alias("f"), aggregate.last_by(F.col("v"), F.col("id")).alias("l"), aggregate.correlation(F.col("v"), F.lit(1.0)).alias("c")).first()
    assert list(row) == [2, 1.5, 2.5, 0.0]
    empty = t_nulls.where("false")
    assert list(aggregate.script_agg(empty, "v").first()) == [0, None, None, None]
    assert stats.column_stats(empty, "v").first()["count"] == 0 and stats.equi_width(empty, "v", 4).count() == 0
    assert stats.equi_depth(empty, "v", 4).count() == 0 and stats.nearest_rank(empty, "v", 0.5).count() == 0


def test_histogram_of_one_value(spark):
    rows = stats.equi_width(spark.createDataFrame([(5.0,), (5.0,)], "x double"), "x", 3).orderBy("bucket").collect()
    assert [r["n"] for r in rows] == [2, 0, 0]


def test_positions(spark):
    df = spark.range(100).repartition(7).withColumn("x", F.col("id") % 10)
    got = with_position(df, [F.desc("x"), F.asc("id")]).orderBy("position").collect()
    assert [r["position"] for r in got] == list(range(1, 101)) and [r["id"] for r in got] == sorted(range(100), key=lambda i: (-(i % 10), i))


def test_islands_touch_nest_and_repeat(spark):
    r = spark.createDataFrame([(1, 3), (4, 5), (4, 5), (2, 2), (9, 10)], "lo bigint, hi bigint").withColumn("g", F.lit(1))
    merged = ranges.islands(r, ["g"])
    assert sorted((x["lo"], x["hi"]) for x in merged.collect()) == [(1, 5), (9, 10)]
    assert sorted(map(tuple, ranges.islands(r, ["g"], width=3).collect())) == sorted(map(tuple, merged.collect()))
    assert [(x["lo"], x["hi"]) for x in ranges.gaps(merged, ["g"]).collect()] == [(6, 8)]
    again = ranges.overlap_join(r, r, ["g"], 2)
    assert again.count() == sum(a[0] <= b[1] and b[0] <= a[1] for a in r.select("lo", "hi").collect() for b in r.select("lo", "hi").collect())


def test_runs_with_nulls(spark):
    df = spark.createDataFrame([(1, 1, None), (1, 2, None), (1, 3, "a"), (1, 4, None)], "g bigint, i bigint, v string")
    rows = ranges.runs(df, ["g"], "v", [F.col("i")]).orderBy("run").collect()
    assert [(r["v"], r["n"]) for r in rows] == [(None, 2), ("a", 1), (None, 1)]
    assert windows.dedup_adjacent(df, "v", ["g"], "i").count() == 3


def test_graph(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (6, 6), (7, 8)], "src bigint, dst bigint")
    assert graph.has_cycle(e).first()[0] and not graph.has_cycle(e.where("src = 7")).first()[0]
    assert {r["v"]: r["component"] for r in graph.strong_components(e).collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 6: 6, 7: 7, 8: 8}
    assert {r["v"]: r["component"] for r in graph.components(e).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 6: 6, 7: 7, 8: 7}
    assert sorted(r["v"] for r in graph.reachable(e, 7).collect()) == [7, 8]
    assert graph.closure(e.where("false")).count() == 0


def test_mutations(spark):
    t = spark.createDataFrame([(1, 10, "a"), (2, None, "b")], "id bigint, x bigint, s string")
    assert mutate.insert(t, [(0, 5, "c"), (9, 1, "d")], id_col="id").where("id IN (3, 9)").count() == 2
    with pytest.raises(mutate.MutationError):
        mutate.insert(t, [(2, 5, "c")], id_col="id")
    with pytest.raises(mutate.MutationError):
        mutate.insert(t, [(2, 5)])
    assert mutate.delete(t, F.col("x") > 5).count() == 1
    assert mutate.update(t, {"x": F.col("id")}, F.col("x").isNull()).orderBy("id").collect()[1]["x"] == 2


def test_versions(spark):
    v = spark.createDataFrame([(1, 1, 1, 5, True, False, 1), (1, 2, 5, versions.INFINITE, True, False, 1), (2, 3, 2, versions.INFINITE, False, False, 7), (3, 4, 1, versions.INFINITE, True, True, 1)], "row_id bigint, value bigint, begin_ts bigint, end_ts bigint, committed boolean, deleted boolean, writer bigint")
    assert [r["value"] for r in versions.visible(v, 4).collect()] == [1]
    assert sorted(r["value"] for r in versions.visible(v, 6, 7).collect()) == [2, 3]
    log = spark.createDataFrame([(1, 1, "put", 1, 5), (2, 1, "commit", None, None), (3, 2, "put", 1, 6), (4, 3, "delete", 1, None), (5, 3, "abort", None, None)], "lsn bigint, txn bigint, type string, row_id bigint, value bigint")
    assert [tuple(r) for r in versions.replay(log).collect()] == [(1, 5)]


def test_script_skips_what_fails(spark):
    t = spark.createDataFrame([(1, 10), (2, 10)], "id bigint, x bigint")
    report, own = run_script(t, "insert 0 20; nonsense; scan where x = 10; agg x; scan where y = 1; join")
    assert (report.statements, report.executed, report.errors, report.rows_scanned) == (6, 4, 2, 3)
    assert own.results[1].first()["count"] == 3
    assert statements('a "x;y"; b') == ['a "x;y"', "b"]


def test_session(spark):
    s = Session(spark)
    assert s.prepare("q", "SELECT ? AS a, '?' AS b") == 1 and list(s.execute("q", 3).first()) == [3, "?"]
    with pytest.raises(SessionError):
        s.execute("q")
    s.deallocate("q")
    with pytest.raises(SessionError):
        s.execute("q", 1)
    assert s.get_int("max_rows") == 10000


def test_csv(spark, tmp_path):
    df = csvio.read_text(spark, "a,b\n1,x\n2\n")
    assert df.dtypes == [("a", "bigint"), ("b", "string")] and df.orderBy("a").collect()[1]["b"] is None
    with pytest.raises(csvio.CsvError):
        csvio.records('a,"b\n')
    (tmp_path / "x.csv").write_text('n,flag,s\n1,true,"a,""q"""\n2,false,"line\nbreak"\n')
    back = csvio.read_csv(spark, f"file://{tmp_path}/x.csv")
    assert back.dtypes == [("n", "bigint"), ("flag", "boolean"), ("s", "string")]
    assert [r["s"] for r in back.orderBy("n").collect()] == ['a,"q"', "line\nbreak"]


def test_csv_kinds_come_from_all_rows(spark, tmp_path):
    late = ["2.5,n/a,2,9223372036854775808,x", ",,,,"]
    (tmp_path / "x.csv").write_text("\n".join(["a,b,c,d,e", *["1,1,1,1,"] * 1500, *late]) + "\n")
    df = csvio.read_csv(spark, f"file://{tmp_path}/x.csv")
    assert [t for _, t in df.dtypes] == ["double", "string", "bigint", "double", "string"]
    row = df.where("a > 2").first()
    assert list(row) == [2.5, "n/a", 2, 9223372036854775808.0, "x"] and df.where("a IS NULL").count() == 1
    (tmp_path / "y.csv").write_text("a,b,c\n1,True,1d\n0,0,2\ntrue,1,3\n")
    assert [t for _, t in csvio.read_csv(spark, f"file://{tmp_path}/y.csv").dtypes] == ["boolean", "boolean", "string"]


def test_streaming_windows(spark):
    from lattica.streaming import events

    df = events.source(spark, "/root/testdata/sf0.001", "events.parquet")
    out = events.drained(events.tumbling(df, "ts", "1 day", "1 hour", ["event_type"]), "tumbled")
    assert out.agg(F.sum("n")).first()[0] == 1000


def test_transactions(spark):
    from lattica.operators.transactions import Store, TransactionError

    store = Store(spark.createDataFrame([(1, "a"), (2, "b")], "id bigint, s string"))
    low, high = store.begin("read_committed"), store.begin()
    other = store.begin()
    other.insert([(3, "c")])
    other.commit()
    assert (low.read().count(), high.read().count(), store.current.count()) == (3, 2, 3)
    low.delete(F.col("id") == 1)
    low.commit()
    assert sorted(r["id"] for r in store.current.collect()) == [2, 3]
    high.rollback()
    with pytest.raises(TransactionError):
        high.read()
    with pytest.raises(TransactionError):
        store.begin().rollback_to("nothing")


def test_cuts_come_back_after_an_insertion():
    data = random.Random(4).randbytes(40_000)
    spots = lambda x: {x[max(0, e - 16) : e] for e in udx.chunk_ends(x, 16, 31, 128)}
    before, after = spots(data), spots(data[:9000] + b"inserted" + data[9000:])
    assert len(before - after) <= 12 and len(before) > 600
    ends = udx.chunk_ends(data, 16, 31, 128)
    assert ends[-1] == len(data) and all(16 <= b - a <= 128 for a, b in zip([0, *ends], ends[:-1], strict=False))
    assert udx.chunk_ends(b"", 16, 31, 128) == [] and udx.chunk_ends(b"short", 16, 31, 128) == [5]


def test_window_hashes_equal_each_window_alone():
    data = random.Random(5).randbytes(300)
    for n in (1, 8, 300, 301):
        assert udx.window_hashes(data, n).tolist() == [udx.window_hashes(data[i : i + n], n)[0] for i in range(len(data) - n + 1)]


def test_overlaps_of_narrow_and_very_wide_intervals(spark):
    rng = random.Random(6)
    sides = [[(i, lo, lo + rng.choice([0, 1, 3, 40, 900, 10**7, 10**12])) for i in range(60) for lo in [rng.randrange(-3000, 3000)]] for _ in range(2)]
    a, b = (spark.createDataFrame([("g", *x) for x in s], "g string, id bigint, lo bigint, hi bigint") for s in sides)
    got = sorted((r["id"], r["r_id"]) for r in ranges.overlap_join(a, b, ["g"], 4).collect())
    assert got == sorted((i, j) for i, lo, hi in sides[0] for j, x, y in sides[1] if lo <= y and x <= hi)


def test_strong_components_of_random_graphs(spark):
    rng = random.Random(7)
    pairs = {(rng.randrange(30), rng.randrange(30)) for _ in range(45)}
    reach = {v: {v} for e in pairs for v in e}
    for _ in reach:
        for a, b in pairs:
            reach[a] |= reach[b]
    got = {r["v"]: r["component"] for r in graph.strong_components(spark.createDataFrame(sorted(pairs), "src bigint, dst bigint")).collect()}
    assert got == {v: min(w for w in reach if w in reach[v] and v in reach[w]) for v in reach} and len(set(got.values())) > 1


@pytest.mark.parametrize("q", [0.0, 0.37, 0.5, 0.9, 1.0])
def test_ranks_and_buckets_with_a_hot_value(spark, q):
    rng = random.Random(8)
    values = sorted([5.0] * 700 + [rng.random() * 10 for _ in range(1300)])
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double").repartition(5)
    assert stats.nearest_rank(df, "v", q).first()["value"] == values[math.floor((len(values) - 1) * q + 0.5)]
    size = math.ceil(len(values) / 7)
    want = [(k, x[0], x[-1], len(x), len(set(x))) for k in range(7) if (x := values[k * size : (k + 1) * size])]
    assert sorted(tuple(r) for r in stats.equi_depth(df, "v", 7).collect()) == want


def test_bloom_filter_grows_with_its_build_side(spark):
    probe, build = spark.range(0, 400_000).toDF("k"), spark.range(0, 100_000).toDF("b")
    kept = joins.bloom_prefilter(probe, build, F.col("k"), F.col("b"))
    assert kept.where("k < 100000").count() == 100_000 and kept.count() < 130_000


def test_storage_off_a_local_master():
    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

    class Session:
        sparkContext, conf = Context(), type("Conf", (), {"get": lambda self, k, d: d})()

    with pytest.raises(ValueError):
        durable.shared_dir(Session())


def test_discarded_tables_are_gone(spark):
    kept = durable.staged(spark.range(3).toDF("x"), "kept")
    assert kept.count() == 3
    durable.discard(kept)
    with pytest.raises(Exception):
        spark.read.parquet(kept._staged_at)


@pytest.mark.parametrize("parts", [1, 7])
def test_components_of_random_graphs_in_pieces(spark, parts):
    rng = random.Random(11)
    pairs = [(rng.randrange(-90, 90), rng.randrange(-90, 90)) for _ in range(80)] + [(k, k + 1) for k in range(200, 230)]
    want = {v: v for e in pairs for v in e}
    for _ in want:
        for a, b in pairs:
            want[a] = want[b] = min(want[a], want[b])
    e = spark.createDataFrame([*pairs, (500, None), (None, 501), (None, None)], "src bigint, dst bigint").repartition(parts)
    rows = graph.components(e).collect()
    assert {r["v"]: r["component"] for r in rows} == want | {500: 500, 501: 501} and len(rows) == len(want) + 2


@pytest.fixture
def tables_written(monkeypatch):
    """The names of the tables that the graph operators stage."""
    names = []
    monkeypatch.setattr(graph, "staged", lambda df, name, f=graph.staged: names.append(name) or f(df, name))
    return names


def _chains(spark):
    """Four chains of 25 edges, in order."""
    return spark.range(0, 100, 1, 4).selectExpr("id AS src", "CASE WHEN id % 25 = 24 THEN -id ELSE id + 1 END AS dst")


def test_components_of_edges_in_order_take_no_rounds(spark, tables_written):
    found = graph.components(_chains(spark)).groupBy("component").count().collect()
    assert {(r["component"], r["count"]) for r in found} == {(-24 - 25 * k, 26) for k in range(4)} and len(tables_written) <= 3


@pytest.mark.parametrize(("parts", "closed"), [(1, 1 << 12), (7, 1 << 12), (3, 20)])
def test_closure_of_random_graphs(spark, monkeypatch, parts, closed):
    rng = random.Random(12)
    pairs = [(rng.randrange(-60, 60), rng.randrange(-60, 60)) for _ in range(70)] + [(k, k + 1) for k in range(200, 215)] + [(300, 300), (300, None), (None, 200), (214, None), (None, None)]
    want = set(pairs)
    while more := {(a, d) for a, b in want for c, d in pairs if b == c and b is not None} - want:
        want |= more
    monkeypatch.setattr(graph, "CLOSED", closed)
    rows = graph.closure(spark.createDataFrame(pairs, "src bigint, dst bigint").repartition(parts)).collect()
    assert {tuple(r) for r in rows} == want and len(rows) == len(want)


def test_closure_of_chains_takes_no_rounds(spark, tables_written):
    assert graph.closure(_chains(spark)).count() == 4 * 25 * 26 / 2 and len(tables_written) <= 5


@pytest.mark.parametrize(("parts", "walked"), [(1, 1 << 19), (7, 1 << 19), (3, 25)])
def test_strong_components_in_tasks_and_in_rounds(spark, monkeypatch, parts, walked):
    rng = random.Random(13)
    pairs = [(rng.randrange(-40, 40), rng.randrange(-40, 40)) for _ in range(110)] + [(k, k + 1) for k in range(200, 215)] + [(215, 209), (300, 300), (301, 302), (302, 301)]
    reach = {v: {v} for e in pairs for v in e}
    for _ in reach:
        for a, b in pairs:
            reach[a] |= reach[b]
    want = {v: min(w for w in reach[v] if v in reach[w]) for v in reach} | {400: 400, None: None}
    monkeypatch.setattr(graph, "WALKED", walked)
    rows = graph.strong_components(spark.createDataFrame([*pairs, (400, None), (None, 200)], "src bigint, dst bigint").repartition(parts)).collect()
    assert {r["v"]: r["component"] for r in rows} == want and len(rows) == len(want)


def test_strong_components_of_chains_take_no_rounds(spark, tables_written):
    found = graph.strong_components(_chains(spark))
    assert found.where("v = component").count() == found.count() == 4 * 26 and len(tables_written) <= 5


@pytest.mark.parametrize(("walked", "more", "cycle"), [(1 << 19, [(7, 3), (7, None)], True), (1 << 19, [(7, None), (None, 0)], False), (1 << 19, [(60, 60)], True), (5, [], False), (5, [(7, 25), (32, 0)], True)])
def test_cycles_within_and_across_tasks(spark, monkeypatch, walked, more, cycle):
    monkeypatch.setattr(graph, "WALKED", walked)
    assert graph.has_cycle(_chains(spark).where("src % 25 < 7").unionAll(spark.createDataFrame(more, "src bigint, dst bigint"))).first()[0] is cycle


def test_cycles_of_chains_take_no_rounds(spark, tables_written):
    assert graph.has_cycle(_chains(spark)).first()[0] is False and len(tables_written) <= 5
