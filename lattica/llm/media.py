"""Media columns with content-defined payload chunking.

A payload becomes an 8-bit mono PCM WAV file, its media.  Gear-hash cuts divide the
media into chunks; the chunk store keeps each distinct chunk once (a Spark
aggregation by digest), and an ordered list of digests, the recipe, describes each
distinct media.  Reading joins recipes to the store, puts the chunks together
in order, verifies the digest of the whole and decodes the samples.

Media that are equal share a recipe and are rebuilt once, so copies cost one row.
Chunks travel compressed.  Repeated rows give a row each; a null text is an
empty one.  Very long texts have as many chunks as they need and are put together whole, so a medium must fit in a
task's memory.  Rows without a key are rows like others, an empty table gives none; other columns, whatever
their names, are not looked at.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import cuts, grouped, keyed_text, lean, slices, table

#: Sizes of chunks in bytes: least, 2**BITS more on average, most.
LEAST, BITS, MOST = 2048, 12, 32768
LEVEL = 12
#: Texts, characters of each and bytes that the compression dictionary is made of.
SAMPLE, SAMPLE_CHARS, DICT_BYTES = 1000, 20_000, 64 << 10
RATE, BLOCK = 8000, 64


def pad(data: bytes) -> bytes:
    """Zero bytes up to a positive multiple of 64."""
    return data + bytes(-len(data) % BLOCK if data else BLOCK)


def encode_media(payload: bytes) -> bytes:
    """A WAV file of 8-bit mono samples that are the payload's bytes."""
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(payload))
    return head + payload


def decode_media(media: bytes) -> bytes:
    """The samples of ``encode_media``'s file; an error where the header is not its."""
    riff, size, wave, fmt, _, kind, channels, rate, _, _, bits, data, n = struct.unpack_from("<4sI4s4sIHHIIHH4sI", media)
    if (riff, wave, fmt, data, kind, channels, rate, bits) != (b"RIFF", b"WAVE", b"fmt ", b"data", 1, 1, RATE, 8) or size != 36 + n or len(media) != 44 + n:
        raise ValueError("not an 8-bit mono WAV file")
    return media[44:]


def feature(payload: bytes) -> str:
    """Mean and deviation of the samples, share of rises, and energy in four quarters, as text."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64)
    n = len(x)
    mean, square = x.sum() / n, (x * x).sum() / n
    rises = int((np.diff(x) > 0).sum())
    quarters = [int(q.sum()) // len(q) for q in np.array_split(x, 4)]
    return f"{mean:.4f}|{max(0.0, square - mean * mean) ** 0.5:.4f}|{rises / n:.4f}|" + ",".join(map(str, quarters))


def chunks_of(media: bytes) -> list[bytes]:
    ends = cuts(media, LEAST, BITS, MOST)
    return [media[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def _loaded(shared: bytes) -> zstandard.ZstdCompressionDict | None:
    if not shared:
        return None
    own = zstandard.ZstdCompressionDict(shared)
    own.precompute_compress(level=LEVEL)
    return own


def digest(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=16).digest()


_RECIPE = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media_sha256", pa.binary()), ("recipe", pa.list_(pa.binary()))])
_STORE = pa.schema([("digest", pa.binary()), ("data", pa.binary())])


def recipes(texts: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media_sha256, recipe: digests of the media's chunks in order."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            out = []
            for t in part.column(1).to_pylist():
                data = t.encode()
                media = encode_media(pad(data))
                out.append((len(data), hashlib.sha256(media).digest(), [digest(c) for c in chunks_of(media)]))
            yield table(_RECIPE, part.column(0), *([x[i] for x in out] for i in range(3)))

    return texts.mapInArrow(lean(scan), "doc_id bigint, n_bytes bigint, media_sha256 binary, recipe array<binary>")


def dictionary(texts: DataFrame, sample: int = SAMPLE, size: int = DICT_BYTES) -> bytes:
    """A compression dictionary from about ``sample`` texts chosen by a hash; empty where they are too few.

    Chunks are restored exactly whatever it holds; it only makes them smaller.
    """
    n = texts.count()
    share = min(1 << 30, sample * (1 << 30) // max(n, 1) + 1)
    rows = texts.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share).orderBy("doc_id", F.xxhash64("text")).select(F.substring("text", 1, SAMPLE_CHARS).alias("text")).collect()
    try:
        return zstandard.train_dictionary(size, [r["text"].encode() for r in rows]).as_bytes()
    except zstandard.ZstdError:
        return b""


def chunk_store(texts: DataFrame, shared: bytes = b"") -> DataFrame:
    """digest, data: each distinct chunk once, compressed with ``shared``.  A task sends a chunk once at most."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack, seen = zstandard.ZstdCompressor(level=LEVEL, dict_data=_loaded(shared)), set()
        for part in slices(batches):
            keys, data = [], []
            for t in part.column(1).to_pylist():
                for c in chunks_of(encode_media(pad(t.encode()))):
                    if (d := digest(c)) not in seen:
                        if len(seen) >= 1 << 20:
                            seen.clear()
                        seen.add(d)
                        keys.append(d)
                        data.append(pack.compress(c))
            yield table(_STORE, keys, data)

    return texts.mapInArrow(lean(scan), "digest binary, data binary").groupBy("digest").agg(F.first("data").alias("data"))


_READ = pa.schema([("media_sha256", pa.binary()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("feature", pa.string())])


def read_back(lists: DataFrame, store: DataFrame, shared: bytes = b"") -> DataFrame:
    """Rebuild each distinct media from its recipe and the store, verify it and describe its samples."""
    wanted = lists.groupBy("media_sha256").agg(F.first("recipe").alias("recipe")).select("media_sha256", F.size("recipe").alias("n"), F.posexplode("recipe").alias("at", "digest"))
    found = wanted.join(store, "digest", "left")

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, out = zstandard.ZstdDecompressor(dict_data=_loaded(shared)), []
        for key, chunks in grouped(slices(batches, "data", 1 << 20), "media_sha256"):
            media = b"".join(unpack.decompress(c) for (c,) in chunks)
            if hashlib.sha256(media).digest() != key:
                raise ValueError("media differ from their digest")
            payload = decode_media(media)
            out.append((key, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-BLOCK:]), len(media), feature(payload)))
            if len(out) == 1000:
                yield table(_READ, *(list(c) for c in zip(*out, strict=True)))
                out = []
        if out:
            yield table(_READ, *(list(c) for c in zip(*out, strict=True)))

    kinds = "media_sha256 binary, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, feature string"
    # media of one chunk are whole where their chunk is; the others' chunks are brought together
    one = found.where("n = 1").select("media_sha256", "data").mapInArrow(lean(rebuild), kinds)
    many = found.where("n > 1").repartition("media_sha256").sortWithinPartitions("media_sha256", "at").select("media_sha256", "data")
    return one.unionAll(many.mapInArrow(lean(rebuild), kinds))


def media_columns(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: what was read back for its text's media."""
    texts = keyed_text(df, id_col, text_col)
    lists = recipes(texts)
    shared = dictionary(texts)
    seen = read_back(lists, chunk_store(texts, shared), shared)
    own = lists.select("doc_id", "n_bytes", "media_sha256")
    return own.join(seen, "media_sha256").select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", F.lower(F.hex("media_sha256")).alias("media_sha256"), "feature")
