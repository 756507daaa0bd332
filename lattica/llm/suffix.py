"""Removal of repeated byte strings by a column-wise multi-document suffix construction.

Every window of ``length`` bytes is given to an anchor, the gram of 32 bytes in it with the
least hash (the leftmost of equals).  Neighbouring windows of one anchor make a fragment; equal
windows have equal anchors at equal places, so windows are equal only within the fragments
of one anchor, lined up at it.  Anchors that occur once, the bulk, end there, and equal
fragments are counted, not compared.

The distinct fragments of an anchor are the documents of the construction: from the
right, each round inserts one symbol of every document.  The column of symbols, in
the order of the suffixes that follow them, is the collection's Burrows-Wheeler column; a
stable sort by it gives the order of the longer suffixes, and the common prefix of neighbours
grows by one or starts anew, with range minima over the former ones.  A window is
repeated if its suffix has ``length`` symbols in common with a neighbour's.  Columns are
read strictly in sequence; they are held in memory, as a task works on a bounded block
of anchors at a time (files of its own would lie on one machine only).

An anchor with more than ``HOT`` distinct fragments is dealt over several blocks.
Windows repeated within a block are settled there; what stays single, and one of each
settled class, is compared over the blocks by 128-bit digests in a Spark aggregation.

The construction is over distinct texts: a text of several rows, equal keys or not, stands in
several places, so all of it is repeated if it has ``length`` bytes.  A report at two lengths
runs the construction at the shorter one, and at the longer one only over the spans found
there that are long enough: a repeated string's own substrings are repeated, too, so no longer
string is missed.

A null text is an empty one, texts shorter than ``length`` have nothing removed; texts of any length are cut
into blocks that overlap, whose windows are all the text's windows.  Rows without a key are
rows like others.  An empty table gives an empty result.  Columns of other names, also those
used inside, are carried along by ``dedup_text`` and not looked at; strings that tie are equal
and all go, none is preferred.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import lean, packed, slices, table
from lattica.llm.shingles import mix
from lattica.plans.durable import discard, staged

#: Bytes of a repeated string; of a passage of fifty words of four letters and a space.
LENGTH, PASSAGE = 400, 250
#: Bytes of a gram; most distinct fragments of an anchor, and bytes of fragments, in a block.
#: Dealing an anchor out costs a digest for each of its windows, so one is dealt only where it outgrows a block.
GRAM, HOT, BLOCK = 32, 20_000, 12 << 20
#: Bytes searched for fragments at a time; places in them fit in PLACE bits.
PLACE = 20


def _grams(data: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from each byte on."""
    h = mix(data.astype(np.uint64) + np.uint64(1))
    factor, m = 0xD6E8FEB86659FD93, 1
    while m < GRAM:
        h = h[:-m] * np.uint64(factor) + h[m:]
        factor, m = factor * factor % 2**64, m * 2
    return mix(h)


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum over ``width`` values from each on."""
    m = 1
    while 2 * m <= width:
        x = np.minimum(x[:-m], x[m:])
        m *= 2
    return np.minimum(x[: len(x) - (width - m)], x[width - m :]) if width > m else x


def fragments(data: np.ndarray, bounds: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """(start, windows, anchor's place in it, anchor's hash) of the fragments of texts laid end to end; bounds: each text's end."""
    if len(data) < length:
        return tuple(np.zeros(0, np.int64) for _ in range(3)) + (np.zeros(0, np.uint64),)
    grams = _grams(data)
    low = np.uint64((1 << PLACE) - 1)
    packed = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    anchor = (_least(packed, length - GRAM + 1) & low).astype(np.int64)
    start = np.arange(len(anchor))
    end_of = bounds[np.searchsorted(bounds, start, "right")]
    valid = start + length <= end_of
    new = np.ones(len(anchor), bool)
    new[1:] = anchor[1:] != anchor[:-1]
    new[1:] |= ~valid[:-1]
    first = np.flatnonzero(new & valid)
    if not len(first):
        return first, first, first, grams[:0]
    stop = np.flatnonzero(np.concatenate([(new | ~valid)[1:], [True]])) + 1
    windows = stop[np.searchsorted(stop, first, "right")] - first
    return first, windows, anchor[first] - first, grams[anchor[first]]


def _blocks(docs: list[bytes], length: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """Texts, or overlapping parts of long ones, gathered up to 2 ** PLACE bytes: (text's index, offset, bytes) of each."""
    most, held, size = (1 << PLACE) - 1, [], 0
    for i, d in enumerate(docs):
        if len(d) < length:
            continue
        step = most - length + 1
        for at in range(0, len(d) - length + 1, step):
            part = d[at : at + most]
            if size + len(part) > most:
                yield held
                held, size = [], 0
            held.append((i, at, part))
            size += len(part)
    if held:
        yield held


_FOUND = pa.schema([("doc", pa.binary()), ("key", pa.int64()), ("digest", pa.binary()), ("start", pa.int64()), ("upto", pa.int64()), ("anchor", pa.int32()), ("multi", pa.bool_())])


def found_fragments(texts: DataFrame, length: int = LENGTH) -> DataFrame:
    """Fragments (doc, key, digest, start, upto, anchor, multi) of (doc, text as bytes), and rows without a key: spans repeated within one document.

    Of equal fragments of a document one stays, marked ``multi``; the spans of all are settled.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, most=1 << 20):
            names = part.column(0).to_pylist()
            for held in _blocks(part.column(1).to_pylist(), length):
                joined = b"".join(p for _, _, p in held)
                bounds = np.cumsum([len(p) for _, _, p in held])
                first, windows, anchor, grams = fragments(np.frombuffer(joined, np.uint8), bounds, length)
                of = np.searchsorted(bounds, first, "right")
                base = (np.array([at for _, at, _ in held]) - np.concatenate([[0], bounds[:-1]]))[of]
                upto = first + windows - 1 + length
                digests = [hashlib.blake2b(joined[a:b], digest_size=16).digest() for a, b in zip(first.tolist(), upto.tolist(), strict=True)]
                places = list(zip([held[i][0] for i in of.tolist()], digests, strict=True))
                times = Counter(places)
                rows, spans, seen = [], [], set()
                for place, k, a, b, c in zip(places, grams.view(np.int64).tolist(), (first + base).tolist(), (upto + base).tolist(), anchor.tolist(), strict=True):
                    many = times[place] > 1
                    if many:
                        if spans and spans[-1][0] == place[0] and a <= spans[-1][2]:
                            spans[-1][2] = max(spans[-1][2], b)
                        else:
                            spans.append([place[0], a, b])
                        if place in seen:
                            continue
                        seen.add(place)
                    rows.append((names[place[0]], k, place[1], a, b, c, many))
                rows += [(names[i], None, None, a, b, 0, False) for i, a, b in spans]
                if rows:
                    yield table(_FOUND, *(list(c) for c in zip(*rows, strict=True)))

    return texts.mapInArrow(lean(scan), "doc binary, key bigint, digest binary, start bigint, upto bigint, anchor int, multi boolean")


def repeated(parts: list[bytes], anchors: list[int], groups: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Column-wise construction over fragments of several anchors; groups: the anchor of each, ascending.

    (fragments x windows) whether the window is repeated among the group's fragments, and whether it is the
    first of its class or single; windows count from each fragment's start.
    """
    n, lead = len(parts), max(anchors)
    sizes = np.array([len(p) for p in parts])
    left = lead - np.array(anchors)
    width = int((left + sizes).max())
    columns = np.zeros((n, width), np.uint16)
    for i, p in enumerate(parts):
        columns[i, left[i] : left[i] + len(p)] = np.frombuffer(p, np.uint8)
        columns[i, left[i] : left[i] + len(p)] += 1
    columns = np.ascontiguousarray(columns.T)
    counts = sizes - length + 1
    again, head = np.zeros((n, int(counts.max())), bool), np.zeros((n, int(counts.max())), bool)
    order, slot = np.arange(n), np.unique(groups, return_inverse=True)[1].astype(np.int64) << 9
    common = np.zeros(n + 1, np.int32)
    for c in range(width - 1, -1, -1):
        symbols = columns[c][order]
        code = slot + symbols  # groups keep their places, so ``slot`` needs no reordering
        move = np.argsort(code, kind="stable")
        order, code = order[move], code[move]
        same = np.flatnonzero(code[1:] == code[:-1])
        longer = np.zeros(n + 1, np.int32)
        if len(same):
            pairs = np.empty(2 * len(same), np.int64)
            pairs[0::2], pairs[1::2] = move[same] + 1, move[same + 1] + 1
            longer[same + 1] = 1 + np.minimum.reduceat(common, pairs)[0::2]
        common = longer
        if c + length <= width:
            window = c - left[order]
            valid = (window >= 0) & (window < counts[order])
            before, after = common[:-1] >= length, common[1:] >= length
            again[order[valid], window[valid]] = (before | after)[valid]
            head[order[valid], window[valid]] = ~before[valid]
    return again, head


_PARTS = pa.schema([("key", pa.int64()), ("deal", pa.int32()), ("dealt", pa.int32()), ("doc", pa.binary()), ("start", pa.int64()), ("anchor", pa.int32()), ("settled", pa.bool_()), ("part", pa.binary())])
_SPANS = pa.schema([("doc", pa.binary()), ("start", pa.int64()), ("upto", pa.int64()), ("window", pa.binary()), ("open", pa.bool_())])


def _runs(flags: np.ndarray) -> Iterator[tuple[int, int]]:
    edge = np.diff(np.concatenate([[0], flags.view(np.int8), [0]]))
    yield from zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True)


def _compared(length: int):
    """Blocks of whole groups go through ``repeated``: spans, and digests of windows of groups that were dealt out."""

    def block(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        ids: dict[tuple, int] = {}
        groups = np.array([ids.setdefault(r[:2], len(ids)) for r in rows])
        again, head = repeated([r[7] for r in rows], [r[5] for r in rows], groups, length)
        out = []
        for r, repeats, first in zip(rows, again, head, strict=True):
            _, _, dealt, doc, start, _, settled, part = r
            if not settled:
                out += [(doc, start + a, start + b - 1 + length, None, False) for a, b in _runs(repeats)]
            if dealt > 1:
                for w in np.flatnonzero(first[: len(part) - length + 1]).tolist():
                    out.append((doc, start + w, start + w + length, hashlib.blake2b(part[w : w + length], digest_size=16).digest(), not settled and not repeats[w]))
            if len(out) > 100_000:
                yield table(_SPANS, *(list(c) for c in zip(*out, strict=True)))
                out = []
        if out:
            yield table(_SPANS, *(list(c) for c in zip(*out, strict=True)))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size, group = [], 0, None
        for b in slices(batches, "part", 1 << 20):
            for r in zip(*(b.column(i).to_pylist() for i in range(8)), strict=True):
                if r[:2] != group and size >= BLOCK:
                    yield from block(rows)
                    rows, size = [], 0
                group = r[:2]
                rows.append(r)
                size += len(r[7])
        if rows:
            yield from block(rows)

    return scan


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the fragments asked of each document."""
    unpack = zstandard.ZstdDecompressor()
    for b in slices(batches, "data", 1 << 20):
        out = []
        for doc, data, wanted in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            text = unpack.decompress(data)
            out += [(w["key"], w["deal"], w["dealt"], doc, w["start"], w["anchor"], w["settled"], text[w["start"] : w["upto"]]) for w in wanted]
        if out:
            yield table(_PARTS, *(list(c) for c in zip(*out, strict=True)))


_KEPT = pa.schema([("doc", pa.binary()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.string())])
_PIECES = pa.schema([("doc", pa.binary()), ("first", pa.bool_()), ("removed", pa.int64()), ("spans", pa.int64()), ("n", pa.int64()), ("start", pa.int64()), ("piece", pa.binary()), ("text", pa.binary())])


def merged(spans: list[dict]) -> list[tuple[int, int]]:
    """Maximal runs covered by the spans, in order; those that touch are one."""
    out: list[list[int]] = []
    for start, upto in sorted((s["start"], s["upto"]) for s in spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], upto)
        else:
            out.append([start, upto])
    return [(a, b) for a, b in out]


def _cut(keep_text: bool):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for b in slices(batches, "data", 1 << 20):
            out = []
            for doc, data, spans in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                text, runs = unpack.decompress(data), merged(spans)
                rest = b"".join(text[a:b] for a, b in zip([0, *(b for _, b in runs)], [*(a for a, _ in runs), len(text)], strict=True))
                out.append((doc, len(text) - len(rest), len(runs), hashlib.sha256(rest).hexdigest(), rest.decode(errors="ignore") if keep_text else None))
            yield table(_KEPT, *(list(c) for c in zip(*out, strict=True)))

    return scan


def _pieces(length: int):
    """A row for each run of ``length`` bytes at least, or one without a piece; totals of all runs stand in a text's first row."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for b in slices(batches, "data", 1 << 20):
            out = []
            for doc, data, spans, n in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                text, runs = unpack.decompress(data), merged(spans)
                own = [(a, hashlib.blake2b(text[a:b], digest_size=16).digest(), text[a:b]) for a, b in runs if b - a >= length] or [(None, None, None)]
                out += [(doc, k == 0, sum(b - a for a, b in runs), len(runs), n, *x) for k, x in enumerate(own)]
            yield table(_PIECES, *(list(c) for c in zip(*out, strict=True)))

    return scan


def repeated_spans(texts: DataFrame, copies: DataFrame, length: int = LENGTH, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """bodies (doc, data) and lists (doc, spans) of the texts of (doc, text as bytes) that have repeated windows.

    doc is a digest of the text; ``copies`` (doc, size) are those that stand in several places.
    """
    found = staged(found_fragments(texts, length), "fragments")
    named = found.where("key IS NOT NULL")
    spot = F.xxhash64("doc", "start")  # rows of one text give the same places
    repeats = named.groupBy("key").agg(F.min(spot).alias("a"), F.max(spot).alias("b")).where("a < b").select("key")
    candidates = staged(named.join(repeats, "key", "left_semi"), "candidates")
    place = F.struct("doc", "start", "upto", "anchor")
    classes = staged(candidates.groupBy("key", "digest").agg((F.max("multi") | (F.min(place) < F.max(place))).alias("settled"), F.min(place).alias("at")), "classes")
    # anchors whose fragments are not all equal are compared
    several = classes.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").withColumn("dealt", F.ceil(F.col("n") / hot).cast("int"))
    compared = classes.join(several, "key").withColumn("deal", F.pmod(F.xxhash64("digest"), "dealt").cast("int"))
    wanted = compared.groupBy(F.col("at.doc").alias("doc")).agg(F.collect_list(F.struct("key", "deal", "dealt", "at.start", "at.upto", "at.anchor", "settled")).alias("wanted"))
    copies = copies.where(F.col("size") >= length)
    suspects = found.select("doc").where("key IS NULL").union(candidates.select("doc")).union(copies.select("doc")).distinct()
    bodies = staged(packed(texts).join(suspects, "doc", "left_semi").dropDuplicates(["doc"]), "bodies")
    parts = bodies.join(wanted, "doc").mapInArrow(lean(_fetch), "key bigint, deal int, dealt int, doc binary, start bigint, anchor int, settled boolean, part binary")
    spans = staged(parts.repartition("key", "deal").sortWithinPartitions("key", "deal").mapInArrow(lean(_compared(length)), "doc binary, start bigint, upto bigint, window binary, open boolean"), "spans")
    over = spans.where("window IS NOT NULL").groupBy("window").agg(F.count("*").alias("n")).where("n > 1").select("window")
    equal = candidates.join(classes.where("settled").select("key", "digest"), ["key", "digest"], "left_semi")
    every = [found.where("key IS NULL"), equal, spans.where("window IS NULL"), spans.where("open").join(over, "window", "left_semi"), copies.select("doc", F.lit(0).cast("long").alias("start"), F.col("size").alias("upto"))]
    every = reduce(DataFrame.union, [x.select("doc", "start", "upto") for x in every])
    lists = staged(every.groupBy("doc").agg(F.collect_set(F.struct("start", "upto")).alias("spans")), "lists")
    discard(found, candidates, classes, spans)
    return bodies, lists


def _removed(bodies: DataFrame, lists: DataFrame, keep_text: bool = False) -> DataFrame:
    """doc, n_removed, n_spans, kept_sha256, kept for each text that loses bytes."""
    return bodies.join(lists, "doc").select("doc", "data", "spans").mapInArrow(lean(_cut(keep_text)), "doc binary, n_removed bigint, n_spans bigint, kept_sha256 string, kept string")


def _texts(df: DataFrame, text_col: str) -> DataFrame:
    """``df`` with a digest, _doc, and bytes, _text, of each text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return df.withColumn("_doc", F.unhex(F.md5(text))).withColumn("_text", text.cast("binary"))


def _copies(texts: DataFrame) -> DataFrame:
    """doc, n, size of the texts of several rows."""
    return staged(texts.select("doc", F.octet_length("text").cast("long").alias("size")).groupBy("doc").agg(F.count("*").alias("n"), F.max("size").alias("size")).where("n > 1"), "copies")


def dedup_report(df: DataFrame, length: int = LENGTH, passage: int = PASSAGE, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256 for strings of ``length``, and passage_bytes, passage_spans, what would go for strings of ``passage``, at most ``length``."""
    if passage > length:
        raise ValueError("a passage is as long as length at most")
    rows = _texts(df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), "text")
    texts = rows.select(F.col("_doc").alias("doc"), F.col("_text").alias("text"))
    copies = _copies(texts)
    bodies, lists = repeated_spans(texts, copies, passage, hot)
    counted = bodies.join(lists, "doc").join(copies.select("doc", "n"), "doc", "left").select("doc", "data", "spans", F.coalesce("n", F.lit(1).cast("long")).alias("n"))
    found = staged(counted.mapInArrow(lean(_pieces(length)), "doc binary, first boolean, removed bigint, spans bigint, n bigint, start bigint, piece binary, text binary"), "pieces")
    pieces = found.where("piece IS NOT NULL")
    again = pieces.select("piece", "n", F.octet_length("text").cast("long").alias("size")).groupBy(F.col("piece").alias("doc")).agg(F.sum("n").alias("n"), F.max("size").alias("size")).where("n > 1")
    parts, inner = repeated_spans(pieces.select(F.col("piece").alias("doc"), "text"), staged(again, "again"), length, hot)
    discard(parts)
    moved = pieces.select("doc", "start", "piece").join(inner.withColumnRenamed("doc", "piece"), "piece").select("doc", F.transform("spans", lambda s: F.struct((s["start"] + F.col("start")).alias("start"), (s["upto"] + F.col("start")).alias("upto"))).alias("spans"))
    lost = _removed(bodies, moved.groupBy("doc").agg(F.flatten(F.collect_list("spans")).alias("spans")))
    totals = found.where("first").select("doc", F.col("removed").alias("passage_bytes"), F.col("spans").alias("passage_spans"))
    whole = rows.select("doc_id", F.col("_doc").alias("doc"), F.octet_length("_text").cast("long").alias("n_bytes"), F.sha2("_text", 256).alias("all"))
    both = staged(totals.join(lost.drop("kept"), "doc", "left"), "lost")
    counts = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_removed", "n_spans", "passage_bytes", "passage_spans")]
    return whole.join(both, "doc", "left").select("doc_id", "n_bytes", *counts[:2], F.coalesce("kept_sha256", "all").alias("kept_sha256"), *counts[2:])


def dedup_text(df: DataFrame, length: int = LENGTH, text_col: str = "text") -> DataFrame:
    """``df`` with repeated byte strings cut out of ``text_col``; bytes of a character that was cut in two go as well. Null stays null."""
    rows = _texts(df, text_col)
    texts = rows.select(F.col("_doc").alias("doc"), F.col("_text").alias("text"))
    lost = _removed(*repeated_spans(texts, _copies(texts), length), keep_text=True).select(F.col("doc").alias("_doc"), F.col("kept").alias("_kept"))
    own = rows.join(lost, "_doc", "left")
    return own.select(*(F.coalesce("_kept", text_col).alias(text_col) if c == text_col else F.col(c) for c in df.columns))
