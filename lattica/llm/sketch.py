"""Threshold-scaled document fingerprints.

The sketch of a text holds every distinct shingle hash below a fixed fraction of the
hash range.  Sketches of the same fraction can be merged by union, and the share of
the smaller sketch that the other holds estimates containment, also between very
unequal documents.

A fingerprint is the text form of a sketch: the scale, the number of distinct shingles, a
check of all of them and, in base 64, the retained hashes in order, each cut to 40
bits.  Equal texts have equal fingerprints.  A text without words has no
shingles; two sketches that retain nothing are alike only if their checks are equal.

A null text is an empty one, repeated rows have equal fingerprints, and texts of any length are read whole.
Empty tables give no rows; other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import keyed_text, lean, packed, slices, table
from lattica.llm.shingles import mix, shingle_sets

#: A hash is retained below 1/SCALE of the range; words a shingle.
SCALE, WORDS = 4, 5


def sketches(texts: list[bytes], words: int = WORDS, scale: int = SCALE) -> list[tuple[str, np.ndarray]]:
    """(fingerprint, retained hashes in order) of each text."""
    of, hashes = shingle_sets(texts, words)
    hashes = mix(hashes)
    n = np.bincount(of, minlength=len(texts))
    total = np.zeros(len(texts), np.uint64)
    np.add.at(total, of, mix(hashes))
    keep = hashes < np.uint64(2**64 // scale)
    of, hashes = of[keep], hashes[keep] >> np.uint64(24 - (scale.bit_length() - 1))
    at = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(texts)))])
    out = []
    for i in range(len(texts)):
        own = np.unique(hashes[at[i] : at[i + 1]])
        data = own.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 3:].tobytes()
        out.append((f"{scale}:{n[i]}:{int(total[i]):016x}:{base64.b64encode(data).decode()}", own))
    return out


def parse(fingerprint: str) -> tuple[int, int, str, np.ndarray]:
    """scale, number of shingles, check and retained hashes."""
    scale, n, check, data = fingerprint.split(":")
    raw = np.frombuffer(base64.b64decode(data), np.uint8).reshape(-1, 5)
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, 3:] = raw
    return int(scale), int(n), check, wide.view(">u8").ravel().astype(np.uint64)


def containment(a: str, b: str, ha: np.ndarray | None = None, hb: np.ndarray | None = None) -> float:
    """Estimated share of the smaller of two documents' shingles that the other has, 0 to 1."""
    if a == b:
        return 1.0
    if ha is None or hb is None:
        ha, hb = parse(a)[3], parse(b)[3]
    least = min(len(ha), len(hb))
    return len(np.intersect1d(ha, hb, assume_unique=True)) / least if least else 0.0


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, scale: int = SCALE) -> DataFrame:
    """One row per input row: doc_id, fingerprint."""
    schema = pa.schema([("doc_id", pa.int64()), ("fingerprint", pa.string())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, most=2 << 20):
            found = sketches([t.encode() for t in part.column(1).to_pylist()], words, scale)
            yield table(schema, part.column(0), [f for f, _ in found])

    return keyed_text(df, id_col, text_col).mapInArrow(lean(scan), "doc_id bigint, fingerprint string")


def edited(text: str, following: str) -> str:
    """``text`` with its last half replaced by as much of the start of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_ROWS = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_OUT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


_FIRST = pa.schema([("range", pa.int32()), ("known", pa.bool_()), ("first", pa.int64())])
_SENT = pa.schema([("range", pa.int32()), ("extra", pa.bool_()), ("doc_id", pa.int64()), ("data", pa.binary())])


def _range_of(keys: pa.Array, bounds: np.ndarray) -> np.ndarray:
    """Number of the range of each key, by binary search; null keys are in the first."""
    at = np.searchsorted(bounds, pc.fill_null(keys, 0).to_numpy(zero_copy_only=False), "right")
    return np.where(pc.is_null(keys).to_numpy(zero_copy_only=False), 0, at).astype(np.int32)


def _firsts(bounds):
    """The first key of each range that a task sees, null keys first."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: dict[int, tuple[bool, int]] = {}
        for b in batches:
            for r, key in zip(_range_of(b.column(0), bounds.value).tolist(), b.column(0).to_pylist(), strict=True):
                own = (key is not None, key or 0)
                if own < least.get(r, (True, 1 << 64)):
                    least[r] = own
        yield table(_FIRST, list(least), [k for k, _ in least.values()], [v if k else None for k, v in least.values()])

    return scan


def _sent(bounds, before):
    """Each packed row to its range, and rows of a range's first key to the range before as well."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, data = b.column(0).to_pylist(), b.column(1).to_pylist()
            rows = list(zip(_range_of(b.column(0), bounds.value).tolist(), [False] * len(keys), keys, data, strict=True))
            rows += [(before.value[k], True, k, x) for k, x in zip(keys, data, strict=True) if k in before.value]
            yield table(_SENT, *(list(c) for c in zip(*rows, strict=True))) if rows else table(_SENT, [], [], [], [])

    return scan


def compared_with_next(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's fingerprint against its edited text's and its follower's.

    The follower comes next in ascending key, after the last the first; null keys come
    first, equal keys by text.  Rows go, compressed and once, to ranges of keys; the
    first row of each range goes to the range before it as well.  Only the bounds and the
    first keys of the ranges, as many as there are partitions, come to the driver, and go to the
    tasks beside the plan, which does not grow with them.
    """
    spark = df.sparkSession
    texts = keyed_text(df, id_col, text_col)
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    found = texts.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("double").alias("k")).approxQuantile("k", [i / parts for i in range(1, parts)], 0.2 / parts) if parts > 1 else []
    bounds = spark.sparkContext.broadcast(np.array(sorted({int(b) for b in found}), np.int64))  # a number for each partition
    firsts = texts.select("doc_id").mapInArrow(lean(_firsts(bounds)), "range int, known boolean, first bigint").groupBy("range").agg(F.min(F.struct("known", "first")).alias("k")).orderBy("range").collect()
    before = spark.sparkContext.broadcast({r["k"]["first"]: firsts[i - 1]["range"] for i, r in enumerate(firsts)})
    ranged = packed(texts).mapInArrow(lean(_sent(bounds, before)), "range int, extra boolean, doc_id bigint, data binary").repartitionById(parts, "range").sortWithinPartitions("range", "extra", F.asc_nulls_first("doc_id"), "data")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        range_, last, ended, waiting, size = None, None, False, [], 0

        def out() -> pa.RecordBatch:
            pieces, spots = [], []
            for _, t, nxt in waiting:
                if not pieces or pieces[-1] is not t:  # else it followed the one before and is there already
                    pieces.append(t)
                pieces += [edited(t, nxt), nxt]
                spots.append((len(pieces) - 3, len(pieces) - 2, len(pieces) - 1))
            data = [x.encode() for x in pieces]
            found, got = sketches(data), []
            for (key, t, _), (a, b, c) in zip(waiting, spots, strict=True):
                (f, h), (g, k), (e, m) = found[a], found[b], found[c]
                got.append((key, len(t), hashlib.sha256(data[b]).hexdigest(), f, g, containment(f, g, h, k), containment(f, e, h, m)))
            return table(_OUT, *(list(c) for c in zip(*got, strict=True)))

        for part in slices(batches, "data", 1 << 20):
            for own_range, extra, key, data in zip(*(part.column(i).to_pylist() for i in range(4)), strict=True):
                if own_range != range_:
                    range_, last, ended = own_range, None, False
                if ended:
                    continue  # of several rows with the first key only one follows
                text = unpack.decompress(data).decode()
                if last is not None:
                    waiting.append((*last, text))
                    size += len(last[1]) + len(text)
                    if size >= 1 << 20:
                        yield out()
                        waiting, size = [], 0
                last, ended = (key, text), extra
        if waiting:
            yield out()

    return ranged.select("range", "extra", "doc_id", "data").mapInArrow(lean(scan), _ROWS)
