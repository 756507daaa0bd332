"""BPE encoding and decoding with content-defined chunk reuse.

Texts are cut by a rolling hash, so that documents which share passages share
chunks.  A chunk is encoded once in a task, whatever number of texts have it, and texts
are ordered over the cluster by their least chunk digest, so that texts with common
chunks meet in a task.  The order is by ranges of (digest of chunk, digest of text): the texts of
one chunk, however many, spread over as many tasks as they need.

A document's ids are those of its chunks put together in order; where a cut went
through a word, the join is repaired: the word on both sides is re-encoded, widening
over further chunks until both neighbours agree, which they do at white space.  Equal
texts are put together once, and decoded from their ids.

A null text is an empty one; repeated rows give a row each.  A chunk without white
space is one word and is carried into the repair as text, however long the run is.
Empty tables give no rows; other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import cuts, keyed_text, lean, slices, table
from lattica.llm.tokens import WORD, Encoder, encoder

#: Sizes of chunks in bytes: least, 2**BITS more on average, most.
LEAST, BITS, MOST = 256, 9, 4096
#: Chunks that a task keeps, and the level of compression of shuffled texts.
KEEP, LEVEL = 50_000, 6
_HEAD, _TAIL = re.compile(f"{WORD}+"), re.compile(f"{WORD}+$")


def chunks_of(data: bytes) -> list[bytes]:
    """Chunks of UTF-8 bytes, with each cut moved to the start of a character."""
    out, at = [], 0
    for end in cuts(data, LEAST, BITS, MOST):
        while end < len(data) and data[end] & 0xC0 == 0x80:
            end += 1
        if end > at:
            out.append(data[at:end])
            at = end
    return out


def digest(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=16).digest()


_NAMED = pa.schema([("doc_id", pa.int64()), ("text_digest", pa.binary())])
_BODY = pa.schema([("least", pa.binary()), ("text_digest", pa.binary()), ("data", pa.binary())])
_TEXT = pa.schema([("text_digest", pa.binary()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("ids", pa.binary())])


def named(texts: DataFrame) -> DataFrame:
    """doc_id, text_digest."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            yield table(_NAMED, part.column(0), [digest(t.encode()) for t in part.column(1).to_pylist()])

    return texts.mapInArrow(lean(scan), "doc_id bigint, text_digest binary")


def ordered(texts: DataFrame) -> DataFrame:
    """least, text_digest, data: distinct texts, compressed, in order of their least chunk digest. A task sends a text once at most.

    The digest is hashed again, as long texts, having many chunks, would else gather at the low end.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack, seen = zstandard.ZstdCompressor(level=LEVEL), set()
        for part in slices(batches):
            rows = []
            for t in part.column(1).to_pylist():
                data = t.encode()
                if (d := digest(data)) not in seen:
                    if len(seen) >= 1 << 20:
                        seen.clear()
                    seen.add(d)
                    rows.append((digest(min(map(digest, chunks_of(data)), default=b"")), d, pack.compress(data)))
            yield table(_BODY, *([r[i] for r in rows] for i in range(3)))

    bodies = texts.mapInArrow(lean(scan), "least binary, text_digest binary, data binary")
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return bodies.repartitionByRange(parts, "least", "text_digest").sortWithinPartitions("least", "text_digest")


class Chunks:
    """Encoded chunks of a task: (ids, ids of the first word, of the last one, those words).

    The first word counts where the chunk starts with it, the last where it ends with it;
    a chunk that is one word has it in both places.
    """

    def __init__(self, own: Encoder):
        self.own, self.known = own, {}

    def learn(self, chunks: dict[bytes, bytes]) -> None:
        """Encode those of the chunks, by digest, that are new."""
        new = {d: c for d, c in chunks.items() if d not in self.known}
        if len(self.known) + len(new) > KEEP:
            self.known.clear()
            new = chunks
        texts = [c.decode() for c in new.values()]
        heads = [m.group() if (m := _HEAD.match(t)) else "" for t in texts]
        tails = [m.group() if (m := _TAIL.search(t)) else "" for t in texts]
        n_heads, n_tails = ([len(x) // 4 for x in self.own.texts(edge)] for edge in (heads, tails))
        for d, ids, *edges in zip(new, self.own.texts(texts), n_heads, n_tails, heads, tails, strict=True):
            self.known[d] = (np.frombuffer(ids, "<u4"), *edges)


class Joiner:
    """Puts chunks together in order; ``open`` is the text since the last sure word end."""

    def __init__(self, encode):
        self.encode, self.parts, self.open, self.open_ids = encode, [], "", None

    def add(self, ids: np.ndarray, n_head: int, n_tail: int, head: str, tail: str) -> None:
        if len(ids) == 0 and not head:  # white space only
            self.close()
            return
        if head and head == tail and n_head == len(ids):  # one word, open at both ends
            self.open_ids = None if self.open else ids
            self.open += head
            return
        if head:
            if self.open:
                self.open, self.open_ids = self.open + head, None
            else:
                self.open, self.open_ids = head, ids[:n_head]
        self.close()
        self.parts.append(ids[n_head : len(ids) - n_tail])
        if tail:
            self.open, self.open_ids = tail, ids[len(ids) - n_tail :]

    def close(self) -> None:
        if self.open:
            self.parts.append(self.open_ids if self.open_ids is not None else np.frombuffer(self.encode(self.open), "<u4"))
        self.open, self.open_ids = "", None

    def ids(self) -> np.ndarray:
        self.close()
        return np.concatenate([p.astype("<u4") for p in self.parts]) if self.parts else np.zeros(0, "<u4")


def put_together(texts: DataFrame, path: str, keep_ids: bool = False) -> DataFrame:
    """For each distinct text: n_tokens, digests of the ids and of the text decoded from them, and the ids if asked for."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, unpack, last = encoder(path), zstandard.ZstdDecompressor(), None
        known = Chunks(own)
        for part in slices(batches, "data", 3 << 20):
            lists = []
            for name, data in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                if name != last:  # equal texts of several tasks follow one another
                    lists.append((name, [(digest(c), c) for c in chunks_of(unpack.decompress(data))]))
                last = name
            known.learn({d: c for _, chunks in lists for d, c in chunks})
            out = []
            for name, chunks in lists:
                text = Joiner(own.alone)
                for d, _ in chunks:
                    text.add(*known.known[d])
                ids = text.ids()
                raw = ids.tobytes()
                out.append((name, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(own.decode(ids).encode()).hexdigest(), raw if keep_ids else None))
            if out:
                yield table(_TEXT, *(list(c) for c in zip(*out, strict=True)))

    return ordered(texts).select("text_digest", "data").mapInArrow(lean(scan), "text_digest binary, n_tokens bigint, ids_sha256 string, decoded_sha256 string, ids binary")


def encode_documents(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids."""
    texts = keyed_text(df, id_col, text_col)
    done = put_together(texts, path, keep_ids)  # equal texts are in one range, so each comes once
    out = named(texts).join(done, "text_digest").drop("text_digest")
    return out if keep_ids else out.drop("ids")
