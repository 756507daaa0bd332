"""Secret scans by multipart credential linking.

Strong spans come from three fixed patterns.  Weak candidates are what these drop or do not
know: access identifiers that are too short, user names and mail addresses; assigned values of
under six characters, hexadecimal runs of 12 to 23 with letters and digits, mixed values; addresses of
services by URL, name or number.  They are reported only where complementary parts
co-occur: an interval join within each document pairs parts whose scopes, the
spans widened by ``reach`` code points, overlap.  The join sorts one side by
start and keeps the running maximum of the ends, so it is n log n and never
lists pairs.  A link is one secret with the nearest identifier and the nearest endpoint in its scope.

Null and empty texts have no spans; repeated rows are scanned one by one; a very
long text is scanned whole.  Spans that start together are listed in the order of ``KINDS``, of two parts
equally near a secret the one before it counts.  Empty tables give no rows; other columns, whatever their names,
are not looked at, and carried along by ``redact``.  Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import keyed_text, lean, slices, table

#: Fixed patterns; ASSIGN is matched against text whose A-Z are in lower case.
ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([a-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
WEAK_ID = re.compile(r"""(?:user(?:name|_?id)?|login|account|client_?id|access_?key(?:_?id)?)["']?\x20*[:=]\x20*["']?([a-z0-9._@+-]{3,})""")
MAIL = re.compile(r"(?<![a-z0-9._%+-])[a-z0-9._%+-]{1,64}@[a-z0-9-]{1,63}(?:\.[a-z0-9-]{1,63}){1,8}")
WEAK_KEY = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
SHORT_HEX = re.compile(r"(?<![0-9A-Za-z])[0-9a-f]{12,23}(?![0-9A-Za-z])")
ENDPOINT = re.compile(r"""(?<![a-z0-9+.-])[a-z][a-z0-9+.-]{0,30}://[^\s"'<>]+|(?:host|endpoint|server|dsn)["']?\x20*[:=]\x20*["']?([^\s"',;]+)""")
ADDRESS = re.compile(r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![0-9]|\.[0-9])")
#: Kinds in the order in which spans that start together are listed; the last three are the weak ones.
KINDS = ("assign", "access", "hex", "id", "key", "endpoint")
#: The part that each kind plays, and what must lie near a weak part of a kind.
PART = {"assign": "key", "access": "id", "hex": "key", "id": "id", "key": "key", "endpoint": "endpoint"}
NEEDS = {"id": ("key",), "key": ("id", "endpoint"), "endpoint": ("key",)}
REACH = 200

SPAN = "struct<kind:string,start:bigint,end:bigint>"
LINK = f"struct<secret:{SPAN},id:{SPAN},endpoint:{SPAN}>"
_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("spans", pa.list_(_SPAN)), ("links", pa.list_(pa.struct([(k, _SPAN) for k in ("secret", "id", "endpoint")])))])

Span = tuple[int, int, int]  # start, kind's rank, end


def strong(text: str, lower: str) -> list[Span]:
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(lower) if m.end(1) - m.start(1) >= 6]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return found + [(m.start(), 2, m.end()) for m in HEX.finditer(text)]


def _mixed(value: str) -> bool:
    """Letters in both cases and digits: as keys have and words have not."""
    return any(c.isdigit() for c in value) and any(c.islower() for c in value) and any(c.isupper() for c in value)


def _apart(spans: list[Span]) -> list[Span]:
    """Without spans that lie within one that starts before them or is longer."""
    out, end = [], -1
    for s in sorted(spans, key=lambda s: (s[0], -s[2])):
        if s[2] > end:
            out.append(s)
            end = s[2]
    return out


def weak(text: str, lower: str, base: list[Span]) -> list[Span]:
    """Weak candidates clear of ``base``.  Keys are looked for only where something could complete them."""
    ids = [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() < 20]
    ends = [(m.start(), 5, m.end()) for m in ADDRESS.finditer(text)] if "." in text else []
    keys = []
    if ":" in text or "=" in text:
        ids += [(m.start(), 3, m.end()) for m in WEAK_ID.finditer(lower)]
        ends += [(m.start(), 5, m.end()) for m in ENDPOINT.finditer(lower)]
    if "@" in text:
        ids += [(m.start(), 3, m.end()) for m in MAIL.finditer(lower)]
    if ids or ends or any(k == 1 for _, k, _ in base):
        keys = [(m.start(), 4, m.end()) for m in ASSIGN.finditer(lower) if m.end(1) - m.start(1) < 6]
        keys += [(m.start(), 4, m.end()) for p in (WEAK_KEY, SHORT_HEX) for m in p.finditer(text) if (_mixed if p is WEAK_KEY else _coded)(m.group())]
    taken = _Near(base)
    return [(s, rank, e) for rank, spans in ((3, ids), (4, keys), (5, ends)) for s, _, e in _apart(spans) if not taken.overlaps(s, e - 1)]


def _coded(value: str) -> bool:
    """Letters and digits: as hexadecimal codes have, and numbers and words have not."""
    return any(c.isdigit() for c in value) and any(c.isalpha() for c in value)


class _Near:
    """Which of a set of intervals lies near another: starts in order, and where the ends reach furthest so far."""

    def __init__(self, spans: list[Span]):
        self.spans = sorted(spans)
        self.starts = [s for s, _, _ in self.spans]
        self.furthest = list(accumulate(range(len(self.spans)), lambda i, j: j if self.spans[j][2] > self.spans[i][2] else i))

    def overlaps(self, lo: int, hi: int) -> bool:
        """Whether one of them starts at ``hi`` at the latest and ends after ``lo``."""
        k = bisect_right(self.starts, hi)
        return k > 0 and self.spans[self.furthest[k - 1]][2] > lo

    def nearest(self, span: Span, reach: int) -> Span | None:
        """The one within ``reach`` with the least gap to ``span``."""
        k = bisect_right(self.starts, span[0])
        sides = [self.spans[self.furthest[k - 1]]] if k else []
        sides += self.spans[k : k + 1]
        gap = lambda s: max(0, s[0] - span[2], span[0] - s[2])
        return min((s for s in sides if gap(s) <= reach), key=gap, default=None)


def _by_part(spans: list[Span]) -> dict[str, _Near]:
    return {part: _Near([s for s in spans if PART[KINDS[s[1]]] == part]) for part in ("id", "key", "endpoint")}


def link(base: list[Span], candidates: list[Span], reach: int) -> list[Span]:
    """The weak candidates that have a complementary part within reach."""
    near = _by_part([*base, *candidates])
    return [s for s in candidates if any(near[p].overlaps(s[0] - reach - 1, s[2] + reach) for p in NEEDS[KINDS[s[1]]])]


def groups(spans: list[Span], reach: int = REACH) -> list[tuple[Span, Span | None, Span | None]]:
    """(secret, identifier, endpoint) for each secret, of those within one another the outer, that has either within reach."""
    near = _by_part(spans)
    found = ((s, near["id"].nearest(s, reach), near["endpoint"].nearest(s, reach)) for s in _apart(near["key"].spans))
    return [x for x in found if x[1] or x[2]]


def spans_of(text: str, reach: int = REACH) -> list[Span]:
    lower = text.encode().lower().decode()  # A-Z only, so that offsets stay
    base = strong(text, lower)
    return sorted(base + link(base, weak(text, lower, base), reach))


def find_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = REACH) -> DataFrame:
    """One row per input row: doc_id, spans (kind, start, end) in order, links (secret, id, endpoint; either of the latter may be null)."""
    named = lambda s: s and {"kind": KINDS[s[1]], "start": s[0], "end": s[2]}

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            found = [spans_of(t, reach) for t in part.column(1).to_pylist()]
            links = [[dict(zip(("secret", "id", "endpoint"), map(named, g), strict=True)) for g in groups(x, reach)] for x in found]
            yield table(_SCHEMA, part.column(0), [[*map(named, x)] for x in found], links)

    return keyed_text(df, id_col, text_col).mapInArrow(lean(scan), f"doc_id bigint, spans array<{SPAN}>, links array<{LINK}>")


def redact(df: DataFrame, text_col: str = "text", mask: str = "[REDACTED]", reach: int = REACH) -> DataFrame:
    """``df`` with each span of secrets in ``text_col`` replaced by ``mask``; overlapping spans by one. Null stays null."""

    def clean(text: str) -> str:
        out, at = [], 0
        for start, _, end in spans_of(text, reach):
            if start >= at:
                out += [text[at:start], mask]
            at = max(at, end)
        return "".join(out) + text[at:] if out else text

    names, k = df.columns, df.columns.index(text_col)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text_col):
            texts = pa.array([t if t is None else clean(t) for t in part.column(k).to_pylist()], type=part.schema.field(k).type)
            yield pa.RecordBatch.from_arrays([texts if i == k else part.column(i) for i in range(len(names))], names=names)

    return df.mapInArrow(lean(scan), df.schema)


def secret_digest(df: DataFrame) -> DataFrame:
    """The digest columns of ``find_secrets``, from its spans, and its links as secret>identifier>endpoint."""
    one = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    joined = lambda spans: F.array_join(F.transform(spans, one), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(*KINDS[:3]))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    links = F.array_join(F.transform("links", lambda g: F.concat(one(g["secret"]), F.lit(">"), one(g["id"]), F.lit(">"), one(g["endpoint"]))), ",")
    return find_secrets(df).select("doc_id", *(count(k) for k in KINDS[:3]), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), F.size("links").cast("long").alias("n_links"), links.alias("links"))
