"""Scalar, text, date, decimal, JSON and codec functions (FN-*, TX-*, DT-*, DC-*, JS-*, CD-*)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lattica.functions import codecs, dates, decimals, jsons, scalar, text
from lattica.operators import ranges, udx
from lattica.plans.catalog import query
from lattica.tables import load

_c, _l = F.col, F.lit


def _on(table, key, source):
    """Register queries of one expression over a prepared table."""

    def add(name, sql, make):
        query(f"SELECT {key}, {sql} AS r FROM ({source[0]})", name)(lambda spark, sf: source[1](load(spark, sf, table)).select(key, make().alias("r")))

    return add


_num = _on("customer", "c_custkey", (
    "SELECT c_custkey, c_acctbal AS x, nullif(c_nationkey, 3)::BIGINT AS k, c_nationkey::BIGINT AS n FROM customer",
    lambda d: d.select("c_custkey", _c("c_acctbal").alias("x"), F.nullif("c_nationkey", _l(3)).cast("bigint").alias("k"), _c("c_nationkey").cast("bigint").alias("n")),
))
_reg = scalar.Registry()
_num("fn_01", "abs(x)", lambda: _reg.call("ABS", _c("x")))
_num("fn_02", "sign(x)::BIGINT", lambda: _reg.call("sign", _c("x")))
_num("fn_03", "ceil(x)::BIGINT", lambda: _reg.call("ceil", _c("x")))
_num("fn_04", "floor(x)::BIGINT", lambda: _reg.call("floor", _c("x")))
_num("fn_05", "sign(x * 10) * floor(abs(x * 10) + 0.5) / 10", lambda: scalar.round_half_away(_c("x"), 1))
_num("fn_06", "CASE WHEN x >= 0 THEN round(sqrt(x), 9) END", lambda: F.round(_reg.call("sqrt", _c("x")), 9))
_num("fn_07", "round(pow(k, 2), 6)", lambda: F.round(_reg.call("pow", _c("k"), _l(2.0)), 6))
_num("fn_08", "trunc(x)::BIGINT % nullif(n % 4, 0)", lambda: _reg.call("mod", _c("x"), _c("n") % 4))
_num("fn_09", "greatest(k, 5, n - 2)", lambda: _reg.call("greatest", _c("k"), _l(5).cast("bigint"), _c("n") - 2))
_num("fn_10", "least(k, 5, n - 2)", lambda: _reg.call("least", _c("k"), _l(5).cast("bigint"), _c("n") - 2))
_num("fn_11", "coalesce(k, n * 100)", lambda: _reg.call("coalesce", _c("k"), _c("n") * 100))
_num("fn_12", "nullif(n, 5)", lambda: _reg.call("nullif", _c("n"), _l(5).cast("bigint")))
_num("fn_13", "coalesce(k, -1)", lambda: _reg.call("ifnull", _c("k"), _l(-1).cast("bigint")))
_num("fn_14", "CASE WHEN k > 10 THEN 'a' WHEN NOT k > 10 THEN 'b' END", lambda: _reg.call("iif", _c("k") > 10, _l("a"), _l("b")))
_num("fn_15", "NOT (k > 10)", lambda: _reg.call("not", _c("k") > 10))
_num("fn_16", "trunc(x)::BIGINT", lambda: _reg.call("to_int", _c("x")))
_num("fn_17", "k::DOUBLE", lambda: _reg.call("to_real", _c("k")))
_num("fn_18", "k IS NULL", lambda: _reg.call("is_null", _c("k")))
_num("fn_19", "CASE WHEN k IS NOT NULL THEN least(k, 7) END", lambda: _reg.call("min2", _c("k"), _l(7).cast("bigint")))
_num("fn_20", "CASE WHEN k IS NOT NULL THEN greatest(k, 7) END", lambda: _reg.call("max2", _c("k"), _l(7).cast("bigint")))
_num("fn_21", "CASE WHEN k IS NOT NULL THEN least(greatest(k, 5), 15) END", lambda: _reg.call("clamp", _c("k"), _l(5).cast("bigint"), _l(15).cast("bigint")))
_num("fn_22", "k IS NOT NULL", lambda: _c("k").isNotNull())
_num("fn_23", "coalesce(CASE WHEN k IS NOT NULL THEN least(k, 7) END, -1) * 1000 + greatest(k, 7)", lambda: F.coalesce(scalar.min_nulls_smallest(_c("k"), _l(7).cast("bigint")), _l(-1)) * 1000 + scalar.max_nulls_smallest(_c("k"), _l(7).cast("bigint")))
_num("fn_24", "k::VARCHAR", lambda: _c("k").cast("string"))

_txt = _on("part", "p_partkey", (
    r"SELECT p_partkey, p_name AS s, p_type AS t, p_brand AS b, chr(9) || ' é' || p_name || chr(160) || ' ' AS w FROM part",
    lambda d: d.select("p_partkey", _c("p_name").alias("s"), _c("p_type").alias("t"), _c("p_brand").alias("b"), F.concat(_l("\t é"), _c("p_name"), _l("  ")).alias("w")),
))
_BLANK = r"[\t\n\x0B\f\r \x{85}\x{A0}]"
_txt("tx_01", "length(w)", lambda: F.char_length("w").cast("bigint"))
_txt("tx_02", "strlen(w)", lambda: F.octet_length("w").cast("bigint"))
_txt("tx_03", "upper(w)", lambda: F.upper("w"))
_txt("tx_04", "lower(upper(w))", lambda: F.lower(F.upper("w")))
_txt("tx_05", f"regexp_replace(regexp_replace(w, '^{_BLANK}+', ''), '{_BLANK}+$', '')", lambda: text.trim(_c("w")))
_txt("tx_06", f"regexp_replace(w, '^{_BLANK}+', '')", lambda: text.ltrim(_c("w")))
_txt("tx_07", f"regexp_replace(w, '{_BLANK}+$', '')", lambda: text.rtrim(_c("w")))
_txt("tx_08", "substr(s, 1, 2) || '|' || substr(s, 3, 4) || '|' || s || '|' || substr(s, 4)", lambda: F.concat_ws("|", text.substr(_c("s"), 0, 3), text.substr(_c("s"), 3, 4), text.substr(_c("s"), -1), text.substr(_c("s"), 4)))
_txt("tx_09", "strpos(s, 'e')", lambda: text.position(_c("s"), "e"))
_txt("tx_10", "s || t", lambda: F.concat("s", "t"))
_txt("tx_11", "concat_ws('-', s, t, b)", lambda: F.concat_ws("-", "s", "t", "b"))
_txt("tx_12", "replace(s, 'a', '<>')", lambda: F.replace(_c("s"), _l("a"), _l("<>")))
_txt("tx_13", "repeat(b, 3)", lambda: F.repeat("b", 3))
_txt("tx_14", "reverse(s)", lambda: F.reverse("s"))
_txt("tx_15", "lpad(s, 12, '*-')", lambda: F.lpad("s", 12, "*-"))
_txt("tx_16", "rpad(s, 12, '*-')", lambda: F.rpad("s", 12, "*-"))
_txt("tx_17", "starts_with(b, 'Brand#1')", lambda: F.startswith(_c("b"), _l("Brand#1")))
_txt("tx_18", "ends_with(t, 'L')", lambda: F.endswith(_c("t"), _l("L")))
_txt("tx_19", "split_part(s, ' ', 2) || '|' || split_part(s, ' ', 9)", lambda: F.concat_ws("|", text.split_part(_c("s"), " ", 1), text.split_part(_c("s"), " ", 8)))
_txt("tx_20", "levenshtein(s, t)", lambda: F.levenshtein("s", "t").cast("bigint"))
_txt("tx_21", "CASE WHEN levenshtein(lower(t), s) <= 8 THEN levenshtein(lower(t), s) END", lambda: text.bounded_levenshtein(F.lower("t"), _c("s"), 8))
_txt("tx_23", "round(1 - levenshtein(s, t) / greatest(length(s), length(t)), 9)", lambda: F.round(text.similarity(_c("s"), _c("t")), 9))
_txt("tx_24", "CASE WHEN s[1] <> 'a' THEN 0 ELSE (SELECT coalesce(max(i), 0) FROM range(1, 20) r(i) WHERE i <= length(s) AND i <= 6 AND s[1:i] = 'almond'[1:i]) END", lambda: text.common_prefix(_c("s"), _l("almond")))
_txt("tx_26", "array_to_string(list_filter(range(0, length(s)), lambda i: s[i + 1:i + 1] = 'e'), ',')", lambda: F.array_join(text.offsets(_c("s"), "e").cast("array<string>"), ","))
_txt("tx_31", "starts_with(s, 'b')", lambda: F.startswith(_c("s"), _l("b")))


_SWAP = "CASE WHEN i > 1 AND x[1] > 1 AND a[i] = b[x[1] - 1] AND a[i - 1] = b[x[1]] THEN st[1][x[1] - 1] + 1 ELSE 9999 END"
_ROW = f"""list_reduce(list_prepend([i], list_transform(range(1, length(b) + 1), lambda j: [j])), lambda row, x: list_append(row,
           least(st[2][x[1] + 1] + 1, row[-1] + 1, st[2][x[1]] + CASE WHEN a[i] = b[x[1]] THEN 0 ELSE 1 END, {_SWAP})))"""


@query(f"""WITH p AS (SELECT DISTINCT p_name AS a, lower(p_type) AS b, p_type FROM part),
           d AS (SELECT a, p_type, list_reduce(list_prepend([range(0, length(b) + 1), range(0, length(b) + 1)], list_transform(range(1, length(a) + 1), lambda k: [[k]])),
                 lambda st, e: [st[2], {_ROW.replace("a[i", "a[e[1][1]").replace("[i]", "[e[1][1]]").replace("i > 1", "e[1][1] > 1")}])[2][-1] AS r FROM p)
           SELECT p_partkey, r FROM part JOIN d ON p_name = d.a AND part.p_type = d.p_type""")
def tx_22(spark, sf):
    return load(spark, sf, "part").select("p_partkey", udx.damerau("p_name", F.lower("p_type")).alias("r"))


@query("""SELECT w, c FROM (SELECT w, c, row_number() OVER (PARTITION BY w ORDER BY levenshtein(w, c), i) AS n FROM (SELECT DISTINCT lower(p_type) AS w FROM part) CROSS JOIN (VALUES (1, 'brass'), (2, 'steel'), (3, 'copper')) t(i, c)) WHERE n = 1""")
def tx_25(spark, sf):
    words = load(spark, sf, "part").select(F.lower("p_type").alias("w")).distinct()
    near = [F.struct(F.levenshtein("w", _l(c)).alias("d"), _l(i).alias("i"), _l(c).alias("c")) for i, c in enumerate(("brass", "steel", "copper"))]
    return words.select("w", F.array_min(F.array(*near))["c"].alias("c"))


_BYTES = "SELECT item_id, list_transform(range(0, len(h) // 2), lambda i: ('0x' || h[2 * i + 1:2 * i + 2])::BIGINT) AS b FROM (SELECT item_id, hex(encode(text)) AS h FROM benchmark)"
_HORNER = "list_reduce(list_prepend(0::BIGINT, b[{}]), lambda h, x: (h * 257 + x) % 1000000007)"


@query(f"""SELECT item_id, len(h)::BIGINT AS windows, list_sum(h)::BIGINT AS total, h[-1] AS last FROM
           (SELECT item_id, list_transform(range(1, len(b) - 6), lambda i: {_HORNER.format("i:i + 7")}) AS h FROM ({_BYTES}))""")
def tx_27(spark, sf):
    h = F.col("h")
    total = F.aggregate(h, _l(0).cast("bigint"), lambda a, x: a + x)
    out = load(spark, sf, "benchmark").select("item_id", udx.rolling_hashes("text", _l(8)).alias("h"))
    return out.select("item_id", F.size(h).cast("bigint").alias("windows"), F.when(F.size(h) > 0, total).alias("total"), F.try_element_at(h, _l(-1)).alias("last"))


@query(f"""WITH c AS (SELECT item_id, len(b) AS n, list_reduce(list_prepend([0::BIGINT], list_transform(range(1, len(b) + 1), lambda i: [CASE WHEN i >= 16 THEN {_HORNER.format("i - 15:i")} ELSE 1 END, i])),
               lambda e, x: CASE WHEN (x[2] - e[-1] >= 16 AND x[1] % 32 = 0) OR x[2] - e[-1] >= 128 THEN list_append(e, x[2]) ELSE e END) AS e FROM ({_BYTES})),
           d AS (SELECT item_id, CASE WHEN e[-1] < n THEN list_append(e, n) ELSE e END AS e FROM c)
           SELECT item_id, unnest(e[:-2]) AS start, unnest(list_transform(range(1, len(e)), lambda i: e[i + 1] - e[i])) AS size FROM d""")
def tx_28(spark, sf):
    return udx.chunked(load(spark, sf, "benchmark"), "item_id", "text", 16, 31, 128).withColumnRenamed("key", "item_id")


@query("SELECT count(DISTINCT p_name) AS names, count(DISTINCT p_name) AS prints FROM part")
def tx_29(spark, sf):
    return load(spark, sf, "part").select("p_name", udx.fnv("p_name").alias("h")).agg(F.countDistinct("p_name").alias("names"), F.countDistinct("h").alias("prints"))


@query("SELECT row_number() OVER (ORDER BY f) - 1 AS id, v AS s FROM (SELECT p_name AS v, min(p_partkey) AS f FROM part GROUP BY 1)")
def tx_32(spark, sf):
    from lattica.operators.ordering import with_position

    firsts = load(spark, sf, "part").groupBy(F.col("p_name").alias("s")).agg(F.min("p_partkey").alias("f"))
    return with_position(firsts, [F.col("f")]).select((F.col("position") - 1).alias("id"), "s")


_day = _on("orders", "o_orderkey", (
    "SELECT o_orderkey, o_orderdate::DATE AS d, (o_orderdate::DATE + (o_orderkey % 400)::INTEGER) AS e, o_orderdate + to_seconds(o_orderkey) AS ts FROM orders",
    lambda x: x.select("o_orderkey", _c("o_orderdate").cast("date").alias("d"), F.date_add(_c("o_orderdate").cast("date"), (_c("o_orderkey") % 400).cast("int")).alias("e"), (_c("o_orderdate") + F.expr("make_dt_interval(0, 0, 0, o_orderkey)")).alias("ts")),
))
_day("dt_01", "year(d) * 10000 + month(d) * 100 + day(d)", lambda: dates.extract("year", _c("d")) * 10000 + dates.extract("month", _c("d")) * 100 + dates.extract("day", _c("d")))
_day("dt_02", "isodow(d) - 1", lambda: dates.extract("weekday", _c("d")))
_day("dt_03", "dayofyear(d)", lambda: dates.extract("day_of_year", _c("d")))
_day("dt_04", "quarter(d)", lambda: dates.extract("quarter", _c("d")))
_day("dt_05", "hour(ts) * 10000 + minute(ts) * 100 + second(ts)", lambda: dates.extract("hour", _c("ts")) * 10000 + dates.extract("minute", _c("ts")) * 100 + dates.extract("second", _c("ts")))
_day("dt_06", "concat_ws(' ', date_trunc('year', d)::DATE, date_trunc('quarter', d)::DATE, date_trunc('month', d)::DATE, date_trunc('week', d)::DATE)", lambda: F.concat_ws(" ", *(dates.truncate(_c("d"), u).cast("string") for u in ("year", "quarter", "month", "week"))))
_day("dt_07", "concat_ws(' ', (d + 5)::DATE, (d + 14)::DATE, (d + INTERVAL 1 MONTH)::DATE, (d + INTERVAL 12 MONTH)::DATE)", lambda: F.concat_ws(" ", *(dates.add(_c("d"), n, u).cast("string") for n, u in ((5, "day"), (2, "week"), (1, "month"), (1, "year")))))
_day("dt_08", "date_diff('day', d, e)", lambda: dates.diff_days(_c("d"), _c("e")))
_day("dt_09", "(year(e) - year(d)) * 12 + month(e) - month(d) - CASE WHEN day(e) < day(d) THEN 1 ELSE 0 END", lambda: dates.diff_months(_c("d"), _c("e")))
_day("dt_10", "last_day(d)::VARCHAR", lambda: F.last_day("d").cast("string"))
_day("dt_11", "isodow(d) >= 6", lambda: dates.is_weekend(_c("d")))
_day("dt_12", "strftime(d, '%Y-%m-%d') || CASE WHEN TRY_CAST('2023-02-' || (day(d) + 10)::VARCHAR AS DATE) IS NULL THEN ' bad' ELSE ' good' END", lambda: F.concat(dates.parse_date(_c("d").cast("string")).cast("string"), F.when(dates.parse_date(F.concat(_l("2023-02-"), (F.day("d") + 10).cast("string"))).isNull(), " bad").otherwise(" good")))
_day("dt_13", "strftime(ts, '%Y-%m-%d %H:%M:%S')", lambda: F.date_format(dates.parse_timestamp(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")), "yyyy-MM-dd HH:mm:ss"))
_day("dt_14", "epoch_us(ts + INTERVAL 90 SECOND) - epoch_us(d::TIMESTAMP)", lambda: dates.micros_until(_c("d").cast("timestamp_ntz"), dates.add_seconds(_c("ts"), 90)))
_day("dt_15", "ts::DATE::VARCHAR || ' ' || second(ts)::VARCHAR", lambda: F.concat_ws(" ", F.to_date("ts").cast("string"), F.second("ts").cast("string")))
_day("dt_16", "day(last_day(d)) * 10 + CASE WHEN (year(d) % 4 = 0 AND year(d) % 100 <> 0) OR year(d) % 400 = 0 THEN 1 ELSE 0 END", lambda: dates.days_in_month(F.year("d"), F.month("d")) * 10 + dates.is_leap(F.year("d")).cast("bigint"))
_day("dt_17", "date_diff('day', DATE '1970-01-01', d)", lambda: F.unix_date(F.date_from_unix_date(F.unix_date("d"))).cast("bigint"))

_dec = _on("customer", "c_custkey", (
    "SELECT c_custkey, c_acctbal::DECIMAL(12,2) AS a, (c_nationkey - 7)::DECIMAL(12,3) AS b FROM customer",
    lambda d: d.select("c_custkey", _c("c_acctbal").cast("decimal(12,2)").alias("a"), (_c("c_nationkey") - 7).cast("decimal(12,3)").alias("b")),
))
_dec("dc_01", "((a + b)::VARCHAR || ' ' || (a - b)::VARCHAR)", lambda: F.concat_ws(" ", (_c("a") + _c("b")).cast("string"), (_c("a") - _c("b")).cast("string")))
_dec("dc_02", "(a * b)::DECIMAL(30,5)::VARCHAR", lambda: (_c("a") * _c("b")).cast("decimal(30,5)").cast("string"))
_dec("dc_03", "CASE WHEN b <> 0 THEN (CASE WHEN (a < 0) <> (b < 0) THEN -1 ELSE 1 END * ((((abs(a) * 100)::BIGINT * 1000000) // nullif((abs(b) * 1000)::BIGINT, 0) + 5) // 10)) END", lambda: (decimals.divide(_c("a"), _c("b"), 4) * 10000).cast("bigint"))
_dec("dc_04", "round(a, 1)::DECIMAL(12,1)::VARCHAR || ' ' || trunc(a)::BIGINT::VARCHAR", lambda: F.concat_ws(" ", decimals.rescale(_c("a"), 1).cast("decimal(12,1)").cast("string"), decimals.rescale(_c("a"), 0, "down").cast("bigint").cast("string")))
_dec("dc_05", "(-a)::DOUBLE + abs(b)::DOUBLE * 1000 + sign(b)", lambda: (-_c("a")).cast("double") + F.abs("b").cast("double") * 1000 + F.signum(_c("b").cast("double")))
_dec("dc_06", "a::VARCHAR", lambda: decimals.parse(F.concat(F.regexp_replace(_c("a").cast("string"), r"(\d)(\d\d\d\.)", "$1_$2")), 2).cast("decimal(12,2)").cast("string"))

_js = _on("events", "event_id", (
    "SELECT event_id, '{\"a\": [{\"b\": ' || event_id || '}, true], \"x/y\": \"' || event_type || '\", \"k\": ' || (props->>'k') || '}' AS j FROM events",
    lambda d: d.select("event_id", F.concat(_l('{"a": [{"b": '), _c("event_id").cast("string"), _l('}, true], "x/y": "'), _c("event_type"), _l('", "k": '), F.get_json_object("props", "$.k"), _l("}")).alias("j")),
))
_js("js_01", "event_id::VARCHAR || ' ' || (j->>'x/y')", lambda: F.concat_ws(" ", jsons.lookup(_c("j"), "/a/0/b"), jsons.lookup(_c("j"), "/x~1y")))
_js("js_02", "(j->>'$.a[1]') || ' ' || (j->>'k')", lambda: F.concat_ws(" ", jsons.lookup(_c("j"), "/a/1"), jsons.lookup(_c("j"), "/k")))
_js("js_03", "(j->>'k')::BIGINT * 10 + CASE WHEN (j->>'$.a[1]') = 'true' THEN 1 ELSE 0 END", lambda: jsons.typed(_c("j"), "/k", "bigint") * 10 + jsons.typed(_c("j"), "/a/1", "boolean").cast("bigint"))
_js("js_04", "event_id % 3 <> 0", lambda: jsons.valid(F.when(_c("event_id") % 3 == 0, F.substring("j", 1, 9)).otherwise(_c("j"))))

_txt("cd_01", "lower(hex(encode(w))) || ' ' || w", lambda: F.concat_ws(" ", codecs.hex_encode(_c("w")), codecs.hex_decode(codecs.hex_encode(_c("w"))).cast("string")))
_txt("cd_02", "to_base64(encode(w)) || ' ' || w", lambda: F.concat_ws(" ", codecs.base64_encode(_c("w")), codecs.base64_decode(codecs.base64_encode(_c("w"))).cast("string")))


@query(
    """WITH t AS (SELECT list(v ORDER BY b) AS t FROM (SELECT b, list_reduce(list_prepend(b, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(b)))
       SELECT p_partkey, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(p_name) + 1), lambda i: ascii(p_name[i])::BIGINT)), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295::BIGINT) AS r
       FROM part, t"""
)
def cd_03(spark, sf):
    return load(spark, sf, "part").select("p_partkey", F.crc32(F.col("p_name").cast("binary")).alias("r"))


@query(
    """SELECT p_partkey, ((n + list_sum(list_transform(range(1, n + 1), lambda i: (n - i + 1) * ascii(s[i])))) % 65521 * 65536
              + (1 + list_sum(list_transform(range(1, n + 1), lambda i: ascii(s[i])))) % 65521)::BIGINT AS r
       FROM (SELECT p_partkey, p_name AS s, length(p_name) AS n FROM part)"""
)
def cd_04(spark, sf):
    return load(spark, sf, "part").select("p_partkey", codecs.adler32(F.col("p_name")).alias("r"))


@query("""SELECT user_id, event_type AS v, count(*) AS n FROM (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY event_id) AS g FROM (
          SELECT user_id, event_id, event_type, CASE WHEN lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) = event_type THEN 0 ELSE 1 END AS f FROM events)) GROUP BY user_id, g, event_type""")
def cd_07(spark, sf):
    coded = ranges.runs(load(spark, sf, "events"), ["user_id"], "event_type", [_c("event_id")])
    again = ranges.expand(coded).groupBy("user_id", "run", "event_type").agg(F.count("*").alias("n"))
    return again.select("user_id", _c("event_type").alias("v"), "n")


@query("SELECT event_id, user_id - lag(user_id) OVER w AS delta, user_id - min(user_id) OVER () AS frame, (2 * user_id) AS zigzag FROM events WINDOW w AS (PARTITION BY event_type ORDER BY event_id)")
def cd_06(spark, sf):
    df = load(spark, sf, "events")
    least = df.agg(F.min("user_id").alias("m"))
    delta = _c("user_id") - F.lag("user_id").over(W.partitionBy("event_type").orderBy("event_id"))
    zigzag = F.shiftleft("user_id", 1).bitwiseXOR(F.shiftright("user_id", 63))
    return df.crossJoin(F.broadcast(least)).select("event_id", delta.alias("delta"), (_c("user_id") - _c("m")).alias("frame"), zigzag.alias("zigzag"))  # one row
