"""Near-duplicate groups by SuperMinHash.

A shingle set's signature: each element walks through the slots by a random
permutation of its own, and the value it offers its j-th slot is j plus a random
fraction.  The ranks are correlated, which lowers the variance, and as values
grow with j a set is finished as soon as every slot has a value below the next j.

Equal sets form a class with one representative.  Bands of signatures put
representatives in buckets.  The few pairs of a small bucket are first held against the
signatures, then against the full sets of 64-bit shingle hashes.  Documents that large
buckets join are a group and are dealt into blocks of bounded size; a task compares the full sets of a
block by products of indicator matrices and hands on a forest of the links, never the
pairs.  Of each component of a block the document with most links, its hub, goes on to a next round
of blocks, as long as rounds halve a group, so that n near copies of one text are one
component after log n rounds in which each set is sent once.  What is left are buckets whose
documents are in different components: only blocks that share such a bucket meet, and
only documents of different components are compared there.  So every pair that shares a
bucket is confirmed, refuted or joined by other links.  Groups are found by union-find and stars over the links.

``n_shingles`` is the size of the set.  Texts without words (null, empty, white space)
have an empty set and are linked with nothing.  Repeated rows have equal sets. Rows
without a key keep a null component of their own if nothing smaller is in it.  Texts of any
length are taken whole, one that exceeds a slice alone; pairs at exactly the threshold are
links, ties between heads go to the smallest key, then row.  Empty tables give
empty results; other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import grouped, lean, packed, slices, table, unpacked
from lattica.llm.components import components
from lattica.llm.shingles import mix, shingle_sets
from lattica.plans.durable import staged

#: 40 bands of 5 rows miss a pair at 0.8 once in ten million.
BANDS, ROWS = 40, 5
#: Largest small bucket; documents and elements of a block.
SMALL, DOCS, ELEMENTS = 8, 1024, 500_000
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def signatures(of: np.ndarray, elements: np.ndarray, n: int, m: int) -> np.ndarray:
    """SuperMinHash signatures (n sets x m slots) of sets given as sorted (set's index, element).

    A value is j << 32 plus 32 random bits; slots of empty sets hold the largest integer.
    """
    top = np.uint64(2**64 - 1)
    best = np.full(n * m, top, np.uint64)
    live_of, live, walk = of, elements, None
    for j in range(m):
        if not len(live):
            break
        bits = mix(live + np.uint64((j + 1) * int(_GOLD) % 2**64))
        pick = j + (((bits & np.uint64(0xFFFFFFFF)) * np.uint64(m - j)) >> np.uint64(32)).astype(np.int64)
        if walk is None:
            slot = pick
        else:
            row = np.arange(len(live))
            slot = walk[row, pick].astype(np.int64)
            walk[row, pick] = walk[:, j]
        np.minimum.at(best, live_of * m + slot, (np.uint64(j) << np.uint64(32)) | (bits >> np.uint64(32)))
        open_ = (best.reshape(n, m) >> np.uint64(32)).max(1) > j
        stay = open_[live_of]
        if walk is None:
            live_of, live, pick = live_of[stay], live[stay], pick[stay]
            walk = np.tile(np.arange(m, dtype=np.uint16 if m > 256 else np.uint8), (len(live), 1))
            walk[np.arange(len(live)), pick] = 0
        elif not stay.all():
            live_of, live, walk = live_of[stay], live[stay], walk[stay]
    return best.reshape(n, m)


_SIGNED = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_digest", pa.binary()), ("bands", pa.list_(pa.int64())), ("slots", pa.binary()), ("id", pa.int64())])
_SETS = pa.schema([("doc_id", pa.int64()), ("elements", pa.binary())])


def _sets(part: pa.RecordBatch, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    texts = [t.encode() for t in part.column(1).to_pylist()]
    of, elements = shingle_sets(texts, words)
    return of, elements, np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(texts)))])


def signed(texts: DataFrame, words: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, set_digest, a hash for each band and a byte of each slot, of (doc_id, text, id), and id; set_digest to slots are null for empty sets."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, most=1 << 20):
            of, elements, at = _sets(part, words)
            sig = signatures(of, elements, part.num_rows, bands * rows).reshape(part.num_rows, bands, rows)
            keys = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=np.uint64)), sig.shape[:2])
            for r in range(rows):
                keys = mix(keys * _GOLD + sig[:, :, r])
            sizes = np.diff(at)
            digests = [hashlib.blake2b(elements[a:b].tobytes(), digest_size=16).digest() if b > a else None for a, b in zip(at[:-1], at[1:], strict=True)]
            lists = keys.view(np.int64).tolist()
            slots = sig.reshape(part.num_rows, -1).astype(np.uint8)
            yield table(_SIGNED, part.column(0), sizes, digests, [x if n else None for x, n in zip(lists, sizes, strict=True)], [x.tobytes() if n else None for x, n in zip(slots, sizes, strict=True)], part.column(2))

    return texts.mapInArrow(lean(scan), "doc_id bigint, n_shingles bigint, set_digest binary, bands array<bigint>, slots binary, id bigint")


def full_sets(bodies: DataFrame, words: int) -> DataFrame:
    """doc_id and its set as sorted 64-bit hashes, from packed texts."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in unpacked(batches, 1 << 20):
            _, elements, at = _sets(part, words)
            yield table(_SETS, part.column(0), [elements[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)])

    return bodies.mapInArrow(lean(scan), "doc_id bigint, elements binary")


_LINKS = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def likely(pairs: DataFrame, marks: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose signatures do not rule the similarity out: by seven standard deviations and more."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            u, v, a, b = (part.column(i) for i in range(4))
            x, y = (np.frombuffer(b"".join(c.to_pylist()), np.uint8).reshape(part.num_rows, -1) for c in (a, b)) if part.num_rows else (np.zeros((0, 1)),) * 2
            m, p = x.shape[1], percent / 100
            keep = pa.array((x == y).sum(1) >= m * p - 7 * (m * p * (1 - p)) ** 0.5 - 1)
            yield pa.RecordBatch.from_arrays([u.filter(keep), v.filter(keep)], schema=_LINKS)

    own = pairs.join(marks.select(F.col("doc_id").alias("u"), F.col("slots").alias("a")), "u").join(marks.select(F.col("doc_id").alias("v"), F.col("slots").alias("b")), "v")
    return own.select("u", "v", "a", "b").mapInArrow(lean(scan), "u bigint, v bigint")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose full sets have 100 * intersection >= percent * union."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "a"):
            out = []
            for u, v, a, b in zip(*(part.column(i).to_pylist() for i in range(4)), strict=True):
                x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= percent * (len(x) + len(y) - both):
                    out.append((u, v))
            yield table(_LINKS, [u for u, _ in out], [v for _, v in out])

    own = pairs.join(sets.select(F.col("doc_id").alias("u"), F.col("elements").alias("a")), "u").join(sets.select(F.col("doc_id").alias("v"), F.col("elements").alias("b")), "v")
    return own.select("u", "v", "a", "b").mapInArrow(lean(scan), "u bigint, v bigint")


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections: products of indicator blocks for frequent elements, pairs for rare ones."""
    n = len(sets)
    of = np.repeat(np.arange(n), [len(x) for x in sets])
    _, code, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    out = np.zeros((n, n), np.float32)
    order = np.argsort(code, kind="stable")
    of, code = of[order], code[order]
    rare = (times > 1) & (times <= 8)
    for size in range(2, 9):
        own = of[(rare & (times == size))[code]].reshape(-1, size)
        for i in range(size):
            for j in range(i):
                np.add.at(out, (own[:, i], own[:, j]), 1)
                np.add.at(out, (own[:, j], own[:, i]), 1)
    often = np.flatnonzero(times > 8)
    for k in range(0, len(often), 2048):
        some = often[k : k + 2048]
        place = np.full(len(times), -1)
        place[some] = np.arange(len(some))
        hit = place[code] >= 0
        has = np.zeros((n, len(some)), np.float32)
        has[of[hit], place[code[hit]]] = 1
        out += has @ has.T
    return out


_JOINED = pa.schema([("doc_id", pa.int64()), ("root", pa.int64()), ("hub", pa.bool_())])


def _joined(sets: list[np.ndarray], percent: int, label: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(first document of its component, whether it is its component's hub) for each set; those of equal ``label`` are not compared."""
    n, sizes = len(sets), np.array([len(x) for x in sets])
    both = common_counts(sets).astype(np.int64)
    near = 100 * both >= percent * (sizes[:, None] + sizes - both)
    np.fill_diagonal(near, False)
    if label is not None:
        near &= label[:, None] != label
    root = np.arange(n)
    for k in range(1, n):
        roots = np.unique(np.append(root[:k][near[k, :k]], root[k]))
        if len(roots) > 1:
            root[np.isin(root, roots[1:])] = roots[0]
    order = np.lexsort((-near.sum(1), root))
    hub = np.zeros(n, bool)
    hub[order[np.flatnonzero(np.diff(root[order], prepend=-1))]] = True
    return root, hub


def _blocks_joined(percent: int):
    """Components within blocks, or between the components that two blocks bring along as ``label``."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in grouped(slices(batches, "elements", 1 << 20), "place", lambda p: tuple(p.values())):
            docs, data, *label = zip(*rows, strict=True)
            root, hub = _joined([np.frombuffer(x, np.uint64) for x in data], percent, np.array(label[0]) if label else None)
            yield table(_JOINED, docs, np.array(docs)[root], hub)

    return scan


def _compared(placed: DataFrame, percent: int) -> DataFrame:
    """doc_id, root, hub of (place, doc_id, elements) or (place, doc_id, elements, label)."""
    return placed.repartition("place").sortWithinPartitions("place", "doc_id").mapInArrow(lean(_blocks_joined(percent)), "doc_id bigint, root bigint, hub boolean")


def _parts() -> Column:
    """Blocks that rows with a ``size`` need."""
    return F.greatest(F.ceil(F.count("*") / DOCS), F.ceil(F.sum("size") / ELEMENTS)).cast("int")


def _hub_rounds(member: DataFrame, sets: DataFrame, percent: int) -> tuple[list[DataFrame], DataFrame]:
    """Links within blocks and between hubs, round by round; and the groups (g) of several blocks, whose other pairs are open."""
    links, wide, todo = [], None, member
    while True:
        blocks = staged(todo.groupBy("g").agg(F.count("*").alias("n"), _parts().alias("blocks")), "blocks")
        several = blocks.where("blocks > 1")
        wide = several.select("g") if wide is None else wide
        dealt = todo.join(blocks, "g").withColumn("block", F.pmod(F.xxhash64("doc_id"), "blocks").cast("int"))
        found = staged(_compared(dealt.join(sets, "doc_id").select(F.struct("g", "block").alias("place"), "doc_id", "elements"), percent), "joined")
        links.append(found.where("doc_id <> root").select(F.col("doc_id").alias("u"), F.col("root").alias("v")))
        hubs = found.where("hub").select("doc_id").join(todo, "doc_id").join(several.select("g", "n"), "g")
        fewer = hubs.groupBy("g").agg(F.count("*").alias("m"), F.first("n").alias("was")).where("2 * m <= was").select("g")
        todo = staged(hubs.drop("n").join(fewer, "g", "left_semi"), "hubs")
        if todo.isEmpty():
            return links, wide


def _open_pairs(member: DataFrame, wide: DataFrame, labels: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between documents that share a large bucket of a wide group and are in different components so far."""
    own = member.join(wide, "g", "left_semi").join(labels, F.col("doc_id") == F.col("node"), "left").select("doc_id", "g", "size", F.coalesce("component", "doc_id").alias("label"), "buckets")
    placed = own.withColumn("bucket", F.explode("buckets")).drop("buckets")
    split = placed.groupBy("bucket").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a < b").select("bucket")
    rest = placed.join(split, "bucket", "left_semi").groupBy("doc_id", "g", "size", "label").agg(F.collect_list("bucket").alias("open"))
    docs = staged(rest, "open")
    # small components share blocks, large ones are cut into blocks of their own
    by_group = docs.groupBy("g").agg(_parts().alias("blocks"))
    by_label = docs.groupBy("label").agg(_parts().alias("cuts"))
    alone = F.col("cuts") > 1
    block = F.when(alone, F.xxhash64("label", F.pmod(F.xxhash64("doc_id"), "cuts"))).otherwise(F.xxhash64("g", F.pmod(F.xxhash64("label"), "blocks")))
    dealt = staged(docs.join(by_group, "g").join(by_label, "label").select("doc_id", "label", block.alias("block"), F.when(alone, F.col("label")).alias("only"), "open"), "dealt")
    there = dealt.select(F.explode("open").alias("bucket"), "block", "only").distinct()
    other = there.select("bucket", F.col("block").alias("j"), F.col("only").alias("other"))
    same = F.coalesce(F.col("only") == F.col("other"), F.lit(False))
    meets = there.join(other, "bucket").where((F.col("block") <= F.col("j")) & ~same).select(F.col("block").alias("i"), "j").distinct()
    ends = meets.select("i", "j", F.col("i").alias("block")).union(meets.where("i <> j").select("i", "j", F.col("j").alias("block")))
    met = dealt.drop("open").join(sets, "doc_id").join(ends, "block").select(F.struct("i", "j").alias("place"), "doc_id", "elements", "label")
    return _compared(met, percent).where("doc_id <> root").select(F.col("doc_id").alias("u"), F.col("root").alias("v"))


def linked(buckets: DataFrame, marks: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (u, v) that join the same documents as all links between documents that share a bucket do.

    buckets: a row for each document and bucket, with the bucket's number n of documents and the smallest of them, its centre.
    """
    small = buckets.where(F.col("n") <= SMALL)
    close = F.lit(100) * F.least("nu", "size") >= F.lit(percent) * F.greatest("nu", "size")
    pairs = small.select("bucket", F.col("doc_id").alias("u"), F.col("size").alias("nu")).join(small.select("bucket", F.col("doc_id").alias("v"), "size"), "bucket").where((F.col("u") < F.col("v")) & close)
    few = confirmed(likely(pairs.select("u", "v").distinct(), marks, percent), sets, percent)
    large = buckets.where(F.col("n") > SMALL)
    coarse = components(large.select(F.col("doc_id").alias("u"), F.col("centre").alias("v")))
    # a row for each document with all its large buckets, at most as many as there are bands
    member = large.groupBy("doc_id", "size").agg(F.collect_list("bucket").alias("buckets")).join(coarse.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    member = staged(member.select("doc_id", "size", F.coalesce("component", "doc_id").alias("g"), "buckets"), "members")
    links, wide = _hub_rounds(member.drop("buckets"), sets, percent)
    found = staged(reduce(DataFrame.unionAll, links, few), "found")
    if wide.isEmpty():
        return found
    return found.unionAll(_open_pairs(member, wide, components(found), sets, percent))


def _row_key(id_col: str, text_col: str) -> Column:
    """64 bits that name a row: equal for rows of equal key and text."""
    return F.xxhash64(F.col(id_col).cast("long"), F.coalesce(F.col(text_col), F.lit("")))


def _grouped(df: DataFrame, words: int, percent: int, id_col: str, text_col: str, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per input row: row (its key), doc_id, n_shingles, first (the smallest doc_id linked and its row)."""
    texts = df.select(_row_key(id_col, text_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(id_col).cast("long").alias("id"))
    marks = staged(signed(texts, words, bands, rows), "signed")
    named = marks.where("set_digest IS NOT NULL AND id IS NOT NULL")
    # staged, so that a join with it can split the rows of one class over tasks
    classes = staged(named.groupBy("set_digest").agg(F.min("doc_id").alias("rep"), F.min("id").alias("least")), "classes")
    reps = marks.join(classes, (marks["set_digest"] == classes["set_digest"]) & (marks["doc_id"] == classes["rep"]), "left_semi").dropDuplicates(["doc_id"])
    placed = reps.select(F.explode("bands").alias("bucket"), "doc_id", F.col("n_shingles").alias("size"))
    shared = placed.groupBy("bucket").agg(F.count("*").alias("n"), F.min("doc_id").alias("centre")).where("n > 1")
    buckets = staged(placed.join(shared, "bucket"), "buckets")
    wanted = buckets.select("doc_id").distinct()
    sets = staged(full_sets(packed(texts.select("doc_id", "text")).join(wanted, "doc_id", "left_semi").dropDuplicates(["doc_id"]), words), "sets")
    slots = marks.select("doc_id", "slots").join(wanted, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    labels = components(linked(buckets, slots, sets, percent))
    # nodes are hashes: the smallest doc_id of a group, then its row of the least key
    group = F.coalesce("component", "rep").alias("group")
    of = staged(classes.join(labels, F.col("rep") == F.col("node"), "left").select("set_digest", "least", group), "groups")
    least = of.groupBy("group").agg(F.min("least").alias("id"))
    heads = staged(of.join(least, "group").select("set_digest", "group", "id"), "heads")
    first = named.join(heads, ["set_digest", "id"]).groupBy("group").agg(F.min("doc_id").alias("head"))
    known = staged(heads.join(first, "group").select("set_digest", F.col("id").alias("first_id"), "head"), "known")
    out = marks.select(F.col("doc_id").alias("row"), F.col("id").alias("doc_id"), "n_shingles", "set_digest").join(known, "set_digest", "left")
    return out.drop("set_digest").withColumn("head", F.when(F.col("doc_id").isNotNull(), F.col("head"))).withColumn("first_id", F.coalesce("first_id", "doc_id"))


def near_duplicates(df: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (the smallest key linked, itself included), kept.

    Rows are told apart by key and text, so that every text of a key that repeats is compared.
    """
    found = _grouped(df, words, percent, id_col, text_col, bands, rows)
    return found.select("doc_id", "n_shingles", F.col("first_id").alias("component_id"), F.col("doc_id").eqNullSafe(F.col("first_id")).alias("kept"))


def without_near_duplicates(df: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with one row of each group, that of the smallest key; rows without a key stay, as do texts of one key that are not alike."""
    gone = _grouped(df, words, percent, id_col, text_col).where("row <> head").select(F.col("row").alias("_gone")).distinct()
    rest = df.withColumn("_row", _row_key(id_col, text_col)).join(gone, F.col("_row") == F.col("_gone"), "left_anti")
    return rest.where(F.col(id_col).isNotNull()).dropDuplicates([id_col, "_row"]).unionByName(rest.where(F.col(id_col).isNull())).drop("_row")
