"""Connected components of an edge table, by alternating stars after union-find in each partition.

What union-find leaves is merged by a single task once it is no more than ``FEW`` links, as every
round of stars takes many small stages.  No link or label ever goes to the driver; hubs are
aggregated before they are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import lean, table
from lattica.plans.durable import staged

_EDGES = pa.schema([("u", pa.int64()), ("v", pa.int64())])
#: Links that a task merges at a time.
HELD = 1 << 20
#: Links that a single task merges to the end; more go through rounds of stars.
FEW = 1 << 17


class UnionFind:
    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        root = x
        while (p := self.up.get(root, root)) != root:
            root = p
        while (p := self.up.get(x, x)) != root:
            self.up[x] = root
            x = p
        return root

    def union(self, a: int, b: int) -> None:
        """The smaller root stays."""
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def forest(self) -> list[tuple[int, int]]:
        return [(x, r) for x in list(self.up) if (r := self.find(x)) != x]


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A forest with the same components as the links of this task, at most ``HELD`` at a time."""
    own = UnionFind()

    def out() -> Iterator[pa.RecordBatch]:
        if links := own.forest():
            yield table(_EDGES, *(list(c) for c in zip(*links, strict=True)))

    for b in batches:
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            own.union(u, v)
        if len(own.up) > HELD:
            yield from out()
            own = UnionFind()
    yield from out()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (u, v) that is not its component's smallest.

    Links with a null end and links of a node with itself say nothing and are left out.
    """
    links = edges.select(F.greatest("u", "v").cast("long").alias("u"), F.least("u", "v").cast("long").alias("v"), (F.col("u") != F.col("v")).alias("ok")).where("ok").select("u", "v")
    e = staged(links.mapInArrow(lean(_merged), "u bigint, v bigint"), "links")
    while e.count() > FEW:
        # small star: a node's smaller neighbours and itself go to the smallest of them
        least = e.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        state = least.agg(F.coalesce(F.max("n"), F.lit(0)).alias("most")).first()["most"]
        if state <= 1 and e.select(F.col("v").alias("u")).join(e.select("u"), "u", "left_semi").isEmpty():
            return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
        small = e.join(least, "u")
        e = small.select("u", F.col("m").alias("v")).union(small.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()
        # large star: a node's larger neighbours go to the smallest of its neighbours and itself
        e = staged(e, "links")
        least = e.groupBy("u").agg(F.min("v").alias("m"))
        moved = e.join(least.withColumnRenamed("u", "v"), "v", "left").select("u", F.coalesce("m", "v").alias("v"))
        e = staged(moved.distinct(), "links")
    merged = staged(e.coalesce(1).mapInArrow(lean(_merged), "u bigint, v bigint"), "links")
    return merged.select(F.col("u").alias("node"), F.col("v").alias("component"))
