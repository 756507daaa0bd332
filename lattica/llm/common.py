"""What several operators share: bounded slices of Arrow batches and content-defined cuts."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def keyed_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the key and the text, renamed, so that no other column can clash."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def slices(batches: Iterator[pa.RecordBatch], sized: str = "text", most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut so that column ``sized`` holds at most ``most`` bytes a slice (one row at least)."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(sized)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            upto = max(at + 1, int(np.searchsorted(ends, base + most, "right")))
            yield batch.slice(at, upto - at)
            at = upto


def lean(scan):
    """``scan`` for mapInArrow, after which the worker gives its free memory back, as idle workers live on beside busy ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from scan(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
            if trim is not None:
                trim(0)

    return run


def table(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


#: Byte table of the gear hash, from a fixed seed: equal on every machine.
_GEAR = np.random.Generator(np.random.PCG64(20240229)).integers(0, 2**64, 256, dtype=np.uint64)


def gear(data: np.ndarray) -> np.ndarray:
    """The gear hash at each byte: the sum over the last 64 bytes of table entry << age.

    Doubling gives all windows at once: H[2m](i) = H[m](i) + (H[m](i - m) << m).
    """
    h = _GEAR[data]
    m = 1
    while m < 64 and m < len(h):
        nxt = h.copy()
        nxt[m:] += h[:-m] << np.uint64(m)
        h, m = nxt, m * 2
    return h


def cuts(data: bytes, least: int, bits: int, most: int) -> list[int]:
    """Ends of content-defined chunks of ``data``: the last is its length; [] for no data.

    A cut falls after a byte whose gear hash has ``bits`` upper zero bits, not before
    ``least`` bytes of the chunk, and at ``most`` bytes at the latest.
    """
    n = len(data)
    if n <= least:
        return [n] if n else []
    marks = np.flatnonzero(gear(np.frombuffer(data, np.uint8)) >> np.uint64(64 - bits) == 0) + 1
    out, at = [], 0
    while n - at > least:
        k = int(np.searchsorted(marks, at + least))
        end = min(int(marks[k]) if k < len(marks) else n, at + most, n)
        out.append(end)
        at = end
    if at < n:
        out.append(n)
    return out


def packed(texts: DataFrame, level: int = 6) -> DataFrame:
    """(key, data): the texts of (key, text) compressed, for a shuffle; the key is a long or binary, the text a string or its bytes."""
    key, kind = texts.dtypes[0]
    schema = pa.schema([(key, pa.int64() if kind == "bigint" else pa.binary()), ("data", pa.binary())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=level)
        for part in slices(batches):
            yield table(schema, part.column(0), [pack.compress(t.encode() if isinstance(t, str) else t) for t in part.column(1).to_pylist()])

    return texts.mapInArrow(lean(scan), f"{key} {kind}, data binary")


def unpacked(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) again, from at most about ``most`` packed bytes at a time."""
    unpack = zstandard.ZstdDecompressor()
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])
    for part in slices(batches, "data", most):
        yield table(schema, part.column(0), [unpack.decompress(x).decode() for x in part.column(1).to_pylist()])


def grouped(batches: Iterator[pa.RecordBatch], key: str, named=lambda k: k) -> Iterator[tuple]:
    """(key, iterator of the other columns' values) for each run of rows of equal ``key``, in sorted input.

    Rows are read as they are needed, so a group may be larger than memory.
    """

    def rows() -> Iterator[tuple]:
        for b in batches:
            k = b.schema.get_field_index(key)
            cols = [b.column(i).to_pylist() for i in range(b.num_columns)]
            yield from zip(map(named, cols[k]), zip(*(c for i, c in enumerate(cols) if i != k), strict=True), strict=True)

    for own, members in groupby(rows(), itemgetter(0)):
        yield own, (r for _, r in members)
