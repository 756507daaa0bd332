"""Vector bin packing of tokenized examples into sequences.

A sequence has simultaneous limits on tokens, segments and loss-bearing tokens.
One sequence is filled at a time: of the pieces that fit all limits, the one with
the greatest dot product between its demands and the room left, each in parts of
the limit and weighted by the mean demand, goes in next.  When nothing fits, the
piece of which most can be cut off for the room left is cut there.  Pieces of equal demands are one type, so
a choice looks at types, not at pieces.

The first line of a document of several lines is its prompt, what follows, or a text of one line, its
answer, whose tokens and end mark bear loss.  A sequence holds somewhat fewer of them
than tokens, so prompts are dealt out over the sequences.

Every partition packs its own rows in windows of bounded size and carries its open
sequence over, so nothing is shuffled; sequence ids are unique as they hold the
partition's number.  Only the last sequence of a partition can be much under full.

Repeated rows are packed one by one.  A null text is an empty one and gives its end mark alone; an
example without ids gives no piece.  Very long texts are cut into whole sequences' worth.  Types
that tie go in order of arrival.  Empty tables give no pieces; other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import keyed_text, lean, slices, table
from lattica.llm.tokens import scanner as tokenizing


@dataclass(frozen=True)
class Limits:
    tokens: int = 2048
    segments: int = 32
    loss: int = 1984
    #: Shortest piece that is cut to fill a gap.
    least_cut: int = 8


@dataclass
class Item:
    """A piece still to be placed: ids[start:end] of an example; tokens from ``answer`` on bear loss."""

    owner: int
    start: int
    end: int
    answer: int

    def loss(self) -> int:
        return max(0, self.end - max(self.start, self.answer))


@dataclass
class Packer:
    """Places items; ``done`` gets (item, sequence, offset, segment, loss before it). The open sequence has the number ``sequence``."""

    limits: Limits
    done: list = field(default_factory=list)
    sequence: int = 0
    following: int = 0
    room: list = field(default_factory=list)
    pool: dict = field(default_factory=lambda: defaultdict(list))

    def __post_init__(self):
        self._open()

    def _number(self) -> int:
        self.following += 1
        return self.following - 1

    def _open(self) -> None:
        self.sequence = self._number()
        self.room = [self.limits.tokens, self.limits.segments, self.limits.loss]

    def _close(self) -> None:
        if self.room[0] < self.limits.tokens:
            self._open()

    def _place(self, item: Item) -> None:
        n = item.end - item.start
        self.done.append((item, self.sequence, *(most - left for most, left in zip((self.limits.tokens, self.limits.segments, self.limits.loss), self.room, strict=True))))
        self.room = [self.room[0] - n, self.room[1] - 1, self.room[2] - item.loss()]

    def add(self, item: Item) -> None:
        """Whole sequences' worth goes to sequences of its own, the rest to the pool."""
        whole = min(self.limits.tokens, self.limits.loss)
        while item.end - item.start >= whole:
            piece = Item(item.owner, item.start, item.start + whole, item.answer)
            if whole == self.limits.tokens:
                self.done.append((piece, self._number(), 0, 0, 0))
            else:
                self.pool[(whole, piece.loss())].append(piece)
            item = Item(item.owner, piece.end, item.end, item.answer)
        if item.end > item.start:
            self.pool[(item.end - item.start, item.loss())].append(item)

    def _fill(self) -> None:
        kinds = list(self.pool)
        at, remaining = {k: i for i, k in enumerate(kinds)}, sum(map(len, self.pool.values()))
        size = 2 * len(kinds) + 64  # room for types that cuts bring
        tokens, loss, left = (np.zeros(size, np.int64) for _ in range(3))
        tokens[: len(kinds)], loss[: len(kinds)] = np.array(kinds, np.int64).T
        left[: len(kinds)] = [len(x) for x in self.pool.values()]
        # weight of a limit: the mean demand in parts of it; each demand again in parts, for the dot product
        most = self.limits
        heavy = (tokens * left).sum() / remaining / most.tokens**3, (loss * left).sum() / remaining / most.loss**3
        while remaining:
            n = len(kinds)
            own_tokens, own_loss, own_left = tokens[:n], loss[:n], left[:n]
            fits = (own_tokens <= self.room[0]) & (own_loss <= self.room[2]) & (own_left > 0)
            if self.room[1] > 0 and fits.any():
                # the segments' part of the product is the same for all
                product = own_tokens * (heavy[0] * self.room[0]) + own_loss * (heavy[1] * self.room[2])
                k = int(np.where(fits, product, -1.0).argmax())
                self._place(self.pool[kinds[k]].pop())
                left[k] -= 1
                remaining -= 1
                continue
            # a prompt comes before its answer, so as much can be cut off as is prompt and finds room for its loss
            part = np.where(own_left > 0, np.minimum(self.room[0], own_tokens - own_loss + self.room[2]), 0)
            k = int(part.argmax())
            if self.room[1] > 0 and part[k] >= most.least_cut:
                item = self.pool[kinds[k]].pop()
                left[k] -= 1
                cut = Item(item.owner, item.start, item.start + int(part[k]), item.answer)
                rest = Item(item.owner, cut.end, item.end, item.answer)
                self._place(cut)
                key = (rest.end - rest.start, rest.loss())
                if key not in at:
                    if n == size:
                        size *= 2
                        tokens, loss, left = (np.concatenate([x, np.zeros(n, np.int64)]) for x in (tokens, loss, left))
                    at[key] = n
                    kinds.append(key)
                    tokens[n], loss[n] = key
                self.pool[key].append(rest)
                left[at[key]] += 1
                continue
            self._close()
        self.pool.clear()

    def fill(self, last: bool) -> None:
        """Place the pool's items; the open sequence stays open unless ``last``."""
        if self.pool:
            self._fill()
        if last:
            self._close()


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("loss", pa.int64()), ("segment", pa.int64()), ("loss_before", pa.int64())])
_KINDS = "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint, loss bigint, segment bigint, loss_before bigint"
#: Tokens packed at a time by a task.
WINDOW = 1 << 20


def scanner(limits: Limits, window: int):
    """For batches of (doc_id, ids, answer start): batches of packed pieces."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 32
        packer = Packer(limits)
        keys: list = []
        ids: list[bytes] = []
        held = 0

        def out(last: bool) -> Iterator[pa.RecordBatch]:
            packer.fill(last)
            rows = packer.done
            packer.done = []
            got = []
            for item, sequence, offset, segment, before in rows:
                own = ids[item.owner]
                got.append((keys[item.owner], item.start, item.end - item.start, own[4 * item.start : 4 * item.end], len(own) // 4, base + sequence, offset, item.loss(), segment, before))
            if got:
                yield table(_SCHEMA, *(list(c) for c in zip(*got, strict=True)))

        for part in slices(batches, "ids", 2 << 20):
            for key, data, answer in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
                packer.add(Item(len(keys), 0, len(data) // 4, answer))
                keys.append(key)
                ids.append(data)
                held += len(data) // 4
                if held >= window:
                    yield from out(False)
                    keys, ids, held = [], [], 0
        yield from out(True)

    return scan


def pack(examples: DataFrame, limits: Limits = Limits(), window: int = WINDOW) -> DataFrame:
    """Pieces of ``examples`` (doc_id, ids as little-endian 32-bit, optional answer_start): one row each.

    doc_id, start, length, ids, doc_tokens, sequence_id, offset, loss (tokens of the piece that bear loss), and
    segment and loss_before, the pieces and loss-bearing tokens ahead of it in its sequence.  Tokens from
    ``answer_start`` on bear loss, all where it is absent or null.
    """
    answers = F.coalesce(F.col("answer_start").cast("long"), F.lit(0)) if "answer_start" in examples.columns else F.lit(0).cast("long")
    picked = examples.select("doc_id", F.coalesce("ids", F.lit(b"")).alias("ids"), answers.alias("answer"))
    return picked.mapInArrow(lean(scanner(limits, window)), _KINDS)


def pack_texts(df: DataFrame, path: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", limits: Limits = Limits(), window: int = WINDOW) -> DataFrame:
    """``pack`` of whole texts, each closed by ``end_id``, its first line the prompt; one Python worker a task tokenizes and packs."""
    ids, placed = tokenizing(path, end_id, answers=True), scanner(limits, window)
    return keyed_text(df, id_col, text_col).mapInArrow(lean(lambda batches: placed(ids(batches))), _KINDS)


def packed_documents(df: DataFrame, path: str, end_id: int = 1) -> DataFrame:
    """Whole documents, each closed by ``end_id``, packed: pieces with the CRC-32 of their ids."""
    pieces = pack_texts(df, path, end_id)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "loss", "segment", "loss_before")
