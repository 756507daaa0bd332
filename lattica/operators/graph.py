"""Graph operators over an edge table (src, dst) by bounded driver loops."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica import tables
from lattica.operators import udx
from lattica.plans.durable import staged


def vertices(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("v")).union(edges.select("dst")).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """v, in_degree, out_degree; vertices without edges of a direction have 0."""
    each = edges.select(F.col("src").alias("v"), F.lit(0).alias("i"), F.lit(1).alias("o")).unionAll(edges.select("dst", F.lit(1), F.lit(0)))
    return each.groupBy("v").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))


#: Edges of a component whose closure is one task's work; it has the square of its vertices as bytes.
CLOSED = 1 << 12
#: Edges of a component that one task walks, for cycles and strong components.
WALKED = 1 << 19


def closure(edges: DataFrame) -> DataFrame:
    """All (src, dst) with a path of one edge at least; a NULL end leads nowhere.

    Components of up to ``CLOSED`` edges are closed whole, each in one task, and larger ones by rounds over all tasks.
    """
    pieces = _pieces(edges)
    small, large = _whole(pieces.where("src IS NOT NULL AND dst IS NOT NULL"), CLOSED)
    found = _in_tasks(small, udx.paths, "src bigint, dst bigint")
    if large is not None:
        found = found.unionAll(_closed_by_rounds(large))
    odd = staged(pieces.where("src IS NULL OR dst IS NULL").select("src", "dst").distinct(), "odd")
    if odd.isEmpty():
        return found
    found = staged(found, "paths")
    before, behind = odd.where("dst IS NULL"), odd.where("src IS NULL")
    to = found.join(before.select(F.col("src").alias("dst")), "dst").select("src", F.lit(None).cast("bigint").alias("dst"))
    away = behind.select(F.col("dst").alias("src")).join(found, "src").select(F.lit(None).cast("bigint").alias("src"), "dst")
    through = away.join(before.select(F.col("src").alias("dst")), "dst").unionAll(behind.join(before.select(F.col("src").alias("dst")), "dst"))
    return found.unionAll(odd.union(to).union(away).union(through.select("src", F.lit(None).cast("bigint").alias("dst"))).distinct())


def _whole(pieces: DataFrame, most: int) -> tuple[DataFrame, DataFrame | None]:
    """src, dst, component of components of at most ``most`` edges, and of the others; None if there are none."""
    ends = _ends(pieces)
    placed = _renamed(pieces.withColumnRenamed("piece", "component"), _joined(ends, _spans(ends)))
    large = staged(placed.groupBy("component").count().where(F.col("count") > most).select("component"), "large")
    if large.isEmpty():
        return placed, None
    large = F.broadcast(large)  # one row for every ``most`` edges at most
    return placed.join(large, "component", "left_anti"), staged(placed.join(large, "component", "left_semi"), "edges")


def _in_tasks(edges: DataFrame, work, schema: str) -> DataFrame:
    """``work`` on whole components, one after another."""
    return edges.select("src", "dst", "component").repartition("component").sortWithinPartitions("component").mapInArrow(work, schema)


def _closed_by_rounds(edges: DataFrame) -> DataFrame:
    """Semi-naive rounds until nothing is new."""
    step = staged(edges.select("src", "dst").distinct(), "edges")
    found, new = step, step
    while not new.isEmpty():
        longer = new.join(step.select(F.col("src").alias("dst"), F.col("dst").alias("to")), "dst").select("src", F.col("to").alias("dst")).distinct()
        new = staged(longer.join(found, ["src", "dst"], "left_anti"), "paths")
        found = found.unionAll(new)
    return found


def reachable(edges: DataFrame, src: int) -> DataFrame:
    """v of every vertex that src reaches, itself included: a frontier at a time."""
    spark = edges.sparkSession
    seen = spark.createDataFrame([(src,)], "v bigint")
    front = seen
    while not front.isEmpty():
        front = staged(edges.join(front, edges["src"] == front["v"]).select(F.col("dst").alias("v")).distinct().join(seen, "v", "left_anti"), "front")
        seen = seen.unionAll(front)
    return seen


def has_cycle(edges: DataFrame) -> DataFrame:
    """One row: has_cycle; a NULL end leads nowhere.

    Weak components of up to ``WALKED`` edges are walked whole, each in one task. Of larger ones, vertices
    without incoming edges are peeled until none is left or none can be.
    """
    small, large = _whole(_pieces(edges).where("src IS NOT NULL AND dst IS NOT NULL"), WALKED)
    found = _in_tasks(small, udx.cyclic, "cyclic boolean")
    if large is not None:
        found = found.unionAll(levels(large).select(F.col("level").isNull()))
    return found.agg(F.coalesce(F.bool_or("cyclic"), F.lit(False)).alias("has_cycle"))


def levels(edges: DataFrame) -> DataFrame:
    """v, level: the round in which a vertex loses its last incoming edge; NULL on and behind cycles."""
    left, todo, done, level = staged(edges.select("src", "dst").distinct(), "edges"), staged(vertices(edges), "vertices"), None, 0
    while True:
        free = staged(todo.join(left.select(F.col("dst").alias("v")).distinct(), "v", "left_anti").withColumn("level", F.lit(level).cast("bigint")), "free")
        if free.isEmpty():
            rest = todo.withColumn("level", F.lit(None).cast("bigint"))
            return rest if done is None else done.unionAll(rest)
        done = free if done is None else done.unionAll(free)
        todo = staged(todo.join(free, "v", "left_anti"), "vertices")
        left = staged(left.join(free.select(F.col("v").alias("src")), "src", "left_anti"), "edges")
        level += 1


def strong_components(edges: DataFrame) -> DataFrame:
    """v, component: the smallest vertex that it reaches and that reaches it.

    Weak components of up to ``WALKED`` edges are walked whole, each in one task, and larger ones by rounds over all tasks.
    """
    pieces = _pieces(edges)
    ends = F.coalesce("src", "dst").alias("src"), F.coalesce("dst", "src").alias("dst")
    small, large = _whole(pieces.where("src IS NOT NULL OR dst IS NOT NULL").select(*ends, "piece"), WALKED)
    found = _in_tasks(small, udx.strong_components, "v bigint, component bigint")
    if large is not None:
        found = found.unionAll(_strong_by_rounds(large))
    return found.unionAll(pieces.where("src IS NULL OR dst IS NULL").limit(1).selectExpr("CAST(NULL AS bigint) AS v", "CAST(NULL AS bigint) AS component"))


def _strong_by_rounds(edges: DataFrame) -> DataFrame:
    """v, component in rounds over all tasks.

    Vertices without edges in or out are alone.  Others take the largest vertex that reaches them as
    colour; those that reach a vertex of its own colour within the colour are its component.  What is found
    goes, until nothing is left.  Only labels of vertices are kept, never pairs.
    """
    inner = staged(edges.where("src <> dst").select("src", "dst").distinct(), "edges")
    left, done = staged(vertices(edges), "vertices"), []
    while True:
        core = staged(inner.select(F.col("src").alias("v")).intersect(inner.select("dst")), "core")
        done.append(left.join(core, "v", "left_anti").select("v", F.col("v").alias("component")))
        if core.isEmpty():
            return staged(reduce(DataFrame.unionAll, done), "strong")
        inner = staged(_between(inner, core), "edges")
        colour = core.withColumn("c", F.col("v"))
        while True:
            most = inner.join(colour.withColumnRenamed("v", "src"), "src").groupBy(F.col("dst").alias("v")).agg(F.max("c").alias("m"))
            step = staged(colour.join(most, "v", "left").select("v", F.greatest("c", "m").alias("c"), F.col("c").alias("was")), "colours")
            colour = step.select("v", "c")
            if step.where("c <> was").isEmpty():
                break
        ends = colour.select(F.col("v").alias("src"), F.col("c").alias("a")), colour.select(F.col("v").alias("dst"), F.col("c").alias("b"))
        same = staged(inner.join(ends[0], "src").join(ends[1], "dst").where("a = b").select("src", "dst"), "same")
        front = found = staged(colour.where("v = c"), "found")
        while not front.isEmpty():
            back = same.join(front.withColumnRenamed("v", "dst"), "dst").select(F.col("src").alias("v"), "c").distinct()
            front = staged(back.join(found, "v", "left_anti"), "front")
            found = staged(found.unionAll(front), "found")
        done.append(found.join(found.groupBy("c").agg(F.min("v").alias("component")), "c").select("v", "component"))
        left = staged(core.join(found, "v", "left_anti"), "vertices")
        inner = staged(_between(inner, left), "edges")


def _between(edges: DataFrame, some: DataFrame) -> DataFrame:
    """The edges with both ends among ``some`` vertices."""
    return edges.join(some.select(F.col("v").alias("src")), "src", "left_semi").join(some.select(F.col("v").alias("dst")), "dst", "left_semi")


def components(edges: DataFrame) -> DataFrame:
    """v, component: the smallest vertex joined with it, by pieces found within tasks; a NULL end is no vertex."""
    ends = _ends(_pieces(edges))
    found = staged(_spans(ends), "labels")
    return _renamed(found.select("v", F.col("least").alias("component")), _joined(ends, found))


def _pieces(edges: DataFrame) -> DataFrame:
    """src, dst, piece: edges of a piece are joined, and named by its smallest vertex; pieces may share vertices.

    Every task joins the edges it has, which are few pieces if they come in the order of their components.
    """
    tables.reachable(edges.sparkSession)
    return staged(edges.select(F.col("src").cast("bigint"), F.col("dst").cast("bigint")).mapInArrow(udx.pieces, "src bigint, dst bigint, piece bigint"), "pieces")


def _ends(pieces: DataFrame) -> DataFrame:
    return pieces.select(F.col("src").alias("v"), "piece").unionAll(pieces.select("dst", "piece")).where("v IS NOT NULL")


def _spans(ends: DataFrame) -> DataFrame:
    """v, least, most: the first and the last of the pieces that a vertex is in."""
    return ends.groupBy("v").agg(F.min("piece").alias("least"), F.max("piece").alias("most"))


def _joined(ends: DataFrame, spans: DataFrame) -> DataFrame | None:
    """piece, whole: the smallest vertex of all that a piece is joined with, for pieces that share vertices; None if none does."""
    shared = staged(spans.where("least < most").select("v", "least"), "shared")
    if shared.isEmpty():
        return None
    links = ends.join(shared, "v").where("piece > least").select(F.col("piece").alias("src"), F.col("least").alias("dst"))
    return _labels(links).select(F.col("v").alias("piece"), F.col("component").alias("whole"))


def _renamed(df: DataFrame, joined: DataFrame | None) -> DataFrame:
    """``df`` with pieces in ``component`` replaced by what they are joined to."""
    if joined is None:
        return df
    both = df.join(joined.withColumnRenamed("piece", "component"), "component", "left")
    return both.select(*(F.coalesce("whole", c).alias(c) if c == "component" else c for c in df.columns))


def _labels(edges: DataFrame) -> DataFrame:
    """v, component, by minimum labels and pointer jumping."""
    both = staged(edges.select("src", "dst").union(edges.select("dst", "src")).distinct(), "edges")
    labels = staged(both.select(F.col("src").alias("v")).distinct().withColumn("component", F.col("v")), "labels")
    while True:
        near = both.join(labels.select(F.col("v").alias("dst"), "component"), "dst").groupBy(F.col("src").alias("v")).agg(F.min("component").alias("m"))
        lower = labels.join(near, "v", "left").select("v", F.least("component", F.coalesce("m", "component")).alias("component"), F.col("component").alias("was"))
        jumped = lower.join(labels.select(F.col("v").alias("component"), F.col("component").alias("up")), "component").select("v", F.least("component", "up").alias("component"), "was")
        nxt = staged(jumped, "labels")
        labels = nxt.select("v", "component")
        if nxt.where("component <> was").isEmpty():
            return labels
