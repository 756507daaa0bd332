"""Intervals: islands, range sets, overlap and stabbing joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def normalized(lo: Column, hi: Column) -> tuple[Column, Column]:
    """Bounds in order."""
    return F.least(lo, hi), F.greatest(lo, hi)


def islands(df: DataFrame, by: list[str], lo: str = "lo", hi: str = "hi", width: int | None = None) -> DataFrame:
    """Closed integer ranges merged where they overlap or touch, for each value of ``by``.

    With ``width``, ranges are first merged within bins of their lower bounds, so that a key with very
    many ranges spreads over tasks, and only what is left is merged by key.
    """
    if width:
        df = islands(df.withColumn("_bin", F.floor(F.col(lo) / width)), [*by, "_bin"], lo, hi)
    order = W.partitionBy(*by).orderBy(lo, hi)
    reach = F.max(hi).over(order.rowsBetween(W.unboundedPreceding, -1))
    starts = F.when(F.col(lo) <= reach + 1, F.lit(0)).otherwise(F.lit(1))
    numbered = df.select(*by, lo, hi, starts.alias("_new")).withColumn("_island", F.sum("_new").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
    return numbered.groupBy(*by, "_island").agg(F.min(lo).alias(lo), F.max(hi).alias(hi)).drop("_island")


def gaps(df: DataFrame, by: list[str], lo: str = "lo", hi: str = "hi") -> DataFrame:
    """The complement between the first and the last range of merged ones."""
    nxt = F.lead(lo).over(W.partitionBy(*by).orderBy(lo))
    return df.select(*by, (F.col(hi) + 1).alias(lo), (nxt - 1).alias(hi)).where(F.col(hi).isNotNull())


def intersected(a: DataFrame, b: DataFrame, by: list[str], width: int) -> DataFrame:
    """Common parts of two range sets."""
    pairs = overlap_join(a, b, by, width)
    return pairs.select(*by, F.greatest("lo", "r_lo").alias("lo"), F.least("hi", "r_hi").alias("hi"))


#: Levels of bins, and how many bins of a level make one of the next.
LEVELS, FACTOR = 4, 64


def _binned(df: DataFrame, width: int, own: bool, above: bool) -> DataFrame:
    """``df`` once for each bin (_level, _bin) that a row touches on its own level, the first whose bins are as wide as it, and on those above."""
    widths = [width * FACTOR**k for k in range(LEVELS)]
    level = F.lit(LEVELS - 1)
    for k in reversed(range(LEVELS - 1)):
        level = F.when(F.col("hi") - F.col("lo") < widths[k], F.lit(k)).otherwise(level)
    levels = F.filter(F.array(*map(F.lit, range(LEVELS))), lambda x: ((x == level) & F.lit(own)) | ((x > level) & F.lit(above)))
    wide = F.element_at(F.array(*(F.lit(w).cast("bigint") for w in widths)), F.col("_level") + 1)
    each = df.withColumn("_level", F.explode(levels))
    return each.withColumn("_wide", wide).withColumn("_bin", F.explode(F.sequence(F.floor(F.col("lo") / F.col("_wide")), F.floor(F.col("hi") / F.col("_wide")))))


def overlap_join(left: DataFrame, right: DataFrame, by: list[str], width: int) -> DataFrame:
    """Pairs of overlapping closed intervals with equal ``by``: equi-joins on bins of several levels.

    An interval's own level has bins as wide as it, so it touches two there at most; a pair meets on the
    level of its wider interval.  So rows grow with the levels, not with the intervals' widths (the last level's bins are
    FACTOR ** (LEVELS - 1) times ``width``).  A pair is kept in the first bin that both touch, so none comes
    twice.  The right columns other than ``by`` are named r_.
    """
    names, out = left.columns, None
    # the left one as wide as the level and the right one that or narrower, then the left one narrower and the right one as wide
    for wider in (True, False):
        a, b = _binned(left, width, wider, not wider), _binned(right, width, True, wider)
        r = b.select(*by, "_level", "_bin", *(F.col(c).alias(f"r_{c}") for c in right.columns if c not in by))
        both = a.join(r, [*by, "_level", "_bin"])
        first = F.floor(F.greatest("lo", "r_lo") / F.col("_wide"))
        kept = both.where((F.col("lo") <= F.col("r_hi")) & (F.col("r_lo") <= F.col("hi")) & (F.col("_bin") == first)).select(*names, *(c for c in r.columns if c.startswith("r_")))
        out = kept if out is None else out.unionAll(kept)
    return out


def stab_join(points: DataFrame, ranges: DataFrame, by: list[str], point: str, width: int) -> DataFrame:
    """Pairs of a point and a range that holds it."""
    return overlap_join(points.withColumn("lo", F.col(point)).withColumn("hi", F.col(point)), ranges, by, width).drop("lo", "hi")


def runs(df: DataFrame, by: list[str], value: str, order: list[Column]) -> DataFrame:
    """Run-length encoding: by, run (from 1), value, n of rows in a row with equal values."""
    w = W.partitionBy(*by).orderBy(*order)
    changed = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    marked = df.select(*by, value, *(c.alias(f"_o{i}") for i, c in enumerate(order)), changed.alias("_new"))
    again = W.partitionBy(*by).orderBy(*(f"_o{i}" for i in range(len(order)))).rowsBetween(W.unboundedPreceding, W.currentRow)
    return marked.withColumn("run", F.sum("_new").over(again)).groupBy(*by, "run").agg(F.first(value).alias(value), F.count("*").alias("n"))


def expand(df: DataFrame, n: str = "n") -> DataFrame:
    """Run-length decoding: each row n times."""
    return df.withColumn("_i", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col(n)))).drop("_i")
