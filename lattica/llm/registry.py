"""Queries of the ten operators, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lattica.llm import queries as q


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: getattr(q, k) for k in sorted(vars(q)) if k.startswith("op")}


_ESCAPED = r"replace(replace(replace({}, '\', '\b'), '</turn>', '\e'), '### ', '\h')"
_SAID = r"'\### Assistant: </turn> ok'"
_ORDER = "'' ORDER BY turn NULLS FIRST, role, text"

ORACLES = {
    # windows are read from a block of 400 bytes and the one after it
    "op1_suffix_array_dedup": r"""
        WITH b AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
        l AS (SELECT r, len(h) // 2 AS n, regexp_extract_all(h, '.{1,800}') AS l FROM b),
        d AS (SELECT r, n, 400 * (k - 1) AS lo, l[k] || coalesce(l[k + 1], '') AS x FROM (SELECT r, n, l, unnest(range(1, len(l) + 1)) AS k FROM l)),
        o AS (SELECT r, n, lo, x, unnest(range(least(400, len(x) // 2))) AS o FROM d),
        v AS (SELECT r, size, lo + o AS i, md5_number(substr(x, (2 * o + 1)::INT, 2 * size)) AS k FROM o CROSS JOIN (VALUES (400), (250)) z(size) WHERE lo + o + size <= n),
        w AS (SELECT r, size, i FROM v WHERE (size, k) IN (SELECT (size, k) FROM v GROUP BY size, k HAVING count(*) > 1)),
        s AS (SELECT r, size, i, CASE WHEN i <= lag(i) OVER p + size THEN 0 ELSE 1 END AS fresh FROM w WINDOW p AS (PARTITION BY r, size ORDER BY i)),
        g AS (SELECT r, size, min(i) AS a, max(i) + size AS z FROM (SELECT *, sum(fresh) OVER (PARTITION BY r, size ORDER BY i) AS k FROM s) GROUP BY r, size, k),
        t AS (SELECT r, coalesce(sum(z - a) FILTER (WHERE size = 400), 0)::BIGINT AS n_removed, count(*) FILTER (WHERE size = 400) AS n_spans,
                     coalesce(sum(z - a) FILTER (WHERE size = 250), 0)::BIGINT AS passage_bytes, count(*) FILTER (WHERE size = 250) AS passage_spans FROM g GROUP BY r),
        e AS (SELECT r, a, lag(z, 1, 0) OVER (PARTITION BY r ORDER BY a, z NULLS LAST) AS upto FROM (SELECT r, a, z FROM g WHERE size = 400 UNION ALL SELECT r, len(h) // 2, NULL FROM b)),
        k AS (SELECT r, string_agg(substr(h, (2 * upto + 1)::INT, (2 * (a - upto))::INT), '' ORDER BY a, upto) AS kept FROM e JOIN b USING (r) GROUP BY r)
        SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(kept)) AS kept_sha256,
               coalesce(passage_bytes, 0) AS passage_bytes, coalesce(passage_spans, 0) AS passage_spans
        FROM b JOIN k USING (r) LEFT JOIN t USING (r)
    """,
    # a WAV file of 8-bit mono samples at 8000 a second: header, then the padded text
    "op2_media_columns": r"""
        WITH b AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
        p AS (SELECT r, doc_id, len(h) // 2 AS n_bytes, greatest(1, (len(h) + 127) // 128) * 64 AS n, rpad(h, (greatest(1, (len(h) + 127) // 128) * 128)::INT, '0') AS x FROM b),
        f AS (SELECT *, list_transform([36 + n, n], lambda v: list_aggregate(list_transform([0, 8, 16, 24], lambda s: printf('%02X', (v >> s) & 255)), 'string_agg', '')) AS le,
                     list_transform(regexp_extract_all(x, '..'), lambda c: (16 * (instr('0123456789ABCDEF', c[1]) - 1) + instr('0123456789ABCDEF', c[2]) - 1)::BIGINT) AS v FROM p),
        m AS (SELECT *, unhex('52494646' || le[1] || '57415645666D74201000000001000100401F0000401F00000100080064617461' || le[2] || x) AS media FROM f),
        y AS (SELECT r, n, i, y, lag(y) OVER (PARTITION BY r ORDER BY i) AS was FROM (SELECT r, n, unnest(v) AS y, unnest(range(n)) AS i FROM f)),
        q AS (SELECT r, n, 4 * i // n AS q, sum(y)::BIGINT AS s, sum(y * y)::BIGINT AS squares, count(*) FILTER (WHERE y > was) AS up FROM y GROUP BY ALL),
        a AS (SELECT r, n, sum(s)::DOUBLE / n AS mean, sum(squares)::DOUBLE / n AS square, sum(up)::DOUBLE / n AS rises, string_agg((s // (n // 4))::VARCHAR, ',' ORDER BY q) AS quarters FROM q GROUP BY r, n),
        c AS (SELECT list(v ORDER BY b) AS t FROM (SELECT b, list_reduce(list_prepend(b, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(b)))
        SELECT doc_id, n_bytes::BIGINT AS n_bytes, m.n::BIGINT AS payload_bytes, sha256(unhex(x)) AS payload_sha256,
               xor(list_reduce(list_prepend(4294967295::BIGINT, v[-64:]), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295::BIGINT) AS tail_crc32,
               (44 + m.n)::BIGINT AS media_bytes, sha256(media) AS media_sha256,
               printf('%.4f|%.4f|%.4f|%s', mean, sqrt(greatest(0, square - mean * mean)), rises, quarters) AS feature
        FROM m JOIN a USING (r), c
    """,
    "op3_minhash_near_dedup": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT doc_id, CASE WHEN len(w) < 2 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM w),
        e AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
        p AS (SELECT a.doc_id AS u, b.doc_id AS v, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS c FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
        l AS (SELECT u, v FROM p WHERE 100 * c >= 80 * (n + m - c)),
        b AS (SELECT u, v FROM l UNION SELECT v, u FROM l),
        t(u, v) AS (SELECT u, v FROM b UNION SELECT t.u, b.v FROM t JOIN b ON t.v = b.u),
        c AS (SELECT u, min(v) AS v FROM t GROUP BY u)
        SELECT doc_id, len(s)::BIGINT AS n_shingles, least(doc_id, coalesce(c.v, doc_id)) AS component_id, doc_id <= coalesce(c.v, doc_id) AS kept
        FROM s LEFT JOIN c ON c.u = doc_id
    """,
    "op6_chat_formatting": f"""
        WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                   UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', {_SAID}), (-7, 1, 'assistant', {_SAID})))
        SELECT conv_id::BIGINT AS conv_id, count(*)::BIGINT AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), {_ORDER})) AS turns_sha256,
               coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
               sha256(coalesce(string_agg(text, {_ORDER}) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
               sum(14 + length(replace({_ESCAPED.format("role")}, ': ', '{chr(92)}c')) + length({_ESCAPED.format("text")}))::BIGINT AS formatted_chars
        FROM c GROUP BY conv_id
    """,
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
