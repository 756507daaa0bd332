"""The few functions that built-in expressions cannot state; Arrow batches only."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed constants of the rolling hash and of the buffer fingerprint.
BASE, MODULUS = 257, 1_000_000_007
FNV_PRIME, FNV_OFFSET = 0x100000001B3, 0xCBF29CE484222325


def osa(a: str, b: str) -> int:
    """Edits, with swaps of neighbours that are not edited again."""
    rows = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            best = min(rows[-1][j] + 1, row[-1] + 1, rows[-1][j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, rows[-2][j - 2] + 1)
            row.append(best)
        rows = [rows[-1], row]
    return rows[-1][-1]


@F.pandas_udf(T.LongType())
def damerau(a: pd.Series, b: pd.Series) -> pd.Series:
    """Restricted Damerau-Levenshtein distance; NULL for a NULL."""
    return pd.Series([None if x is None or y is None else osa(x, y) for x, y in zip(a, b, strict=True)], dtype="Int64")


def window_hashes(data: bytes, window: int) -> np.ndarray:
    """Polynomial hash of every window of bytes, all windows at once, a byte of each a step."""
    x = np.frombuffer(data, np.uint8).astype(np.int64)
    n = max(len(x) - window + 1, 0)
    h = np.zeros(n, np.int64)
    for k in range(window if n else 0):
        h = (h * BASE + x[k : k + n]) % MODULUS
    return h


@F.pandas_udf(T.ArrayType(T.LongType()))
def rolling_hashes(s: pd.Series, window: pd.Series) -> pd.Series:
    """Polynomial hashes of every window of bytes; NULL for a NULL."""
    return pd.Series([None if t is None else window_hashes(t.encode(), int(n)).tolist() for t, n in zip(s, window, strict=True)])


@F.pandas_udf(T.LongType())
def fnv(s: pd.Series) -> pd.Series:
    """64-bit FNV-1a of the bytes, as a signed integer."""

    def one(text: str | None) -> int | None:
        if text is None:
            return None
        h = FNV_OFFSET
        for x in text.encode():
            h = (h ^ x) * FNV_PRIME % 2**64
        return h - 2**64 if h >= 2**63 else h

    return pd.Series([one(t) for t in s], dtype="Int64")


def chunk_ends(data: bytes, least: int, mask: int, most: int, window: int = 16) -> list[int]:
    """Ends of chunks of ``data``, cut where the hash of the last ``window`` bytes has no bit of ``mask``.

    What lies before the window has no say, so cuts come back soon after an insertion.  Each chunk has
    ``most`` bytes at most and, but for the last, ``least`` at least.
    """
    marks = np.flatnonzero(window_hashes(data, window) & mask == 0) + window
    out, at = [], 0
    while at < len(data):
        k = int(np.searchsorted(marks, at + least))
        at = min(int(marks[k]) if k < len(marks) else len(data), at + most, len(data))
        out.append(at)
    return out


def chunked(df: DataFrame, key: str, text: str, least: int, mask: int, most: int, window: int = 16) -> DataFrame:
    """key, start, size: content-defined chunks that tile the text's bytes; none for a null or empty text."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k, t in zip(b[key], b[text], strict=True):
                ends = chunk_ends((t or "").encode(), least, mask, most, window)
                out += [(k, a, e - a) for a, e in zip([0, *ends], ends, strict=False)]
            yield pd.DataFrame(out, columns=["key", "start", "size"])

    return df.select(key, text).mapInPandas(cut, "key bigint, start bigint, size bigint")


#: Edges that a task takes at a time, where components need not be whole.
HELD = 1 << 20
#: Edges after which a task works on the whole components it has read, and rows that it returns at a time.
BLOCK, ROWS = 1 << 18, 1 << 17
#: Places for paths that a task has at a time, besides those of one component.
PLACES = 1 << 23


def _index(src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct vertices in order, and the edges by their places among them."""
    v, at = np.unique(np.concatenate([src, dst]), return_inverse=True)
    return v, at[: len(src)], at[len(src) :]


def roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For each of n vertices the least one joined with it: roots hook to lesser ones, then pointers jump to the end."""
    up = np.arange(n)
    while True:
        x, y = up[a], up[b]
        if not (apart := x != y).any():
            return up
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(up, np.maximum(x, y), np.minimum(x, y))
        while ((nxt := up[up]) != up).any():
            up = nxt


def _numbers(c: pa.ChunkedArray) -> np.ndarray:
    return c.combine_chunks().to_numpy(zero_copy_only=False)


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """src, dst, piece: the least vertex joined with the edge among ``HELD`` edges of the task; a NULL end joins nothing."""

    def out() -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held)
        src, dst = pc.coalesce(t["src"], t["dst"], 0), pc.coalesce(t["dst"], t["src"], 0)
        v, a, b = _index(_numbers(src), _numbers(dst))
        yield from t.append_column("piece", pa.array(v[roots(a, b, len(v))][a])).to_batches(ROWS)

    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= HELD:
            yield from out()
            held, n = [], 0
    if n:
        yield from out()


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """src, dst, component of whole components, from edges in order of component."""
    held, n = [], 0
    for batch in batches:
        cols = [c.to_numpy(zero_copy_only=False) for c in (batch["src"], batch["dst"], batch["component"])]
        held.append(cols)
        n += batch.num_rows
        if n >= BLOCK:
            cols = [np.concatenate(c) for c in zip(*held, strict=True)]
            cut = int(np.searchsorted(cols[2], cols[2][-1]))  # the last component may go on
            if cut:
                yield tuple(c[:cut] for c in cols)
            held, n = [[c[cut:] for c in cols]], n - cut
    if n:
        yield tuple(np.concatenate(c) for c in zip(*held, strict=True))


def _sliced(*columns: np.ndarray, names: list[str]) -> Iterator[pa.RecordBatch]:
    for k in range(0, len(columns[0]), ROWS):
        yield pa.RecordBatch.from_arrays([pa.array(c[k : k + ROWS]) for c in columns], names=names)


def _strong(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For each of n vertices the least one of its strong component, by Tarjan's method without recursion."""
    order = np.argsort(a, kind="stable")
    to, start = b[order].tolist(), np.searchsorted(a[order], np.arange(n + 1)).tolist()
    at, end = start[:-1], start[1:]
    seen, low, least, stack, count = [0] * n, [0] * n, [-1] * n, [], 0
    for top in range(n):
        if seen[top]:
            continue
        path = [top]
        while path:
            v = path[-1]
            if not seen[v]:
                count += 1
                seen[v] = low[v] = count
                stack.append(v)
            k, stop, down = at[v], end[v], False
            while k < stop:
                w = to[k]
                k += 1
                if not seen[w]:
                    path.append(w)
                    down = True
                    break
                if least[w] < 0 and seen[w] < low[v]:
                    low[v] = seen[w]
            at[v] = k
            if down:
                continue
            path.pop()
            if low[v] == seen[v]:
                i = len(stack) - 1
                while stack[i] != v:
                    i -= 1
                mine = stack[i:]
                del stack[i:]
                m = min(mine)
                for w in mine:
                    least[w] = m
            if path and least[v] < 0 and low[v] < low[path[-1]]:
                low[path[-1]] = low[v]
    return np.array(least, dtype=np.int64)


def strong_components(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """v, component: the least vertex of the strong component, from edges in order of weak component."""
    for src, dst, _ in _blocks(batches):
        v, a, b = _index(src, dst)
        yield from _sliced(v, v[_strong(a, b, len(v))], names=["v", "component"])


def cyclic(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """cyclic: whether a block has a cycle: an edge within a strong component; from edges in order of weak component."""
    for src, dst, _ in _blocks(batches):
        v, a, b = _index(src, dst)
        of = _strong(a, b, len(v))
        yield pa.RecordBatch.from_arrays([pa.array([bool((of[a] == of[b]).any())])], names=["cyclic"])


def paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """src, dst of every path, from edges in order of weak component.

    A component of n vertices has n x n places for its paths, so what a block holds is bounded by its
    edges times the vertices of its largest component.
    """
    for src, dst, component in _blocks(batches):
        # whole components of a block, in runs of bounded places
        first = np.flatnonzero(np.r_[True, component[1:] != component[:-1]])
        edges = np.diff(np.r_[first, len(component)])
        places = np.cumsum((edges + 1).astype(np.int64) ** 2)
        run = places // PLACES
        for k in np.flatnonzero(np.r_[True, run[1:] != run[:-1]]):
            last = int(np.searchsorted(run, run[k], side="right")) - 1
            yield from _paths(src[first[k] : first[last] + edges[last]], dst[first[k] : first[last] + edges[last]], component[first[k] : first[last] + edges[last]])


def _paths(src: np.ndarray, dst: np.ndarray, component: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A vertex is the place of its component among all and its own within; paths grow by one edge a round."""
    v, a, b = _index(src, dst)
    own = np.empty(len(v), np.int64)
    own[a] = own[b] = np.cumsum(np.r_[0, component[1:] != component[:-1]])
    size = np.bincount(own)
    order = np.argsort(own, kind="stable")
    rank = np.empty(len(v), np.int64)
    rank[order] = np.arange(len(v)) - (np.cumsum(size) - size)[own[order]]
    row = np.cumsum(size[own]) - size[own]  # where a source's places begin
    there = np.zeros(int(row[-1] + size[own[-1]]), bool)
    by = np.argsort(a, kind="stable")
    to, start = b[by], np.searchsorted(a[by], np.arange(len(v) + 1))
    x, y = a, b
    while len(x):
        place = row[x] + rank[y]
        fresh = np.unique(place, return_index=True)[1]
        fresh = fresh[~there[place[fresh]]]
        x, y = x[fresh], y[fresh]
        there[place[fresh]] = True
        n = start[y + 1] - start[y]
        k = np.repeat(start[y] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        x, y = np.repeat(x, n), to[k]
    found = np.flatnonzero(there)
    x = np.searchsorted(row, found, side="right") - 1
    begin = np.cumsum(size) - size
    yield from _sliced(v[x], v[order[begin[own[x]] + found - row[x]]], names=["src", "dst"])
