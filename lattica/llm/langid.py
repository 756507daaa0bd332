"""Language identification by compression.

Each language gets a raw-content zstandard dictionary: passages and frequent words of
a bounded sample of its training rows.  A text is compressed whole with each
dictionary, in lower case and with a space for what is no letter, as neither tells
languages apart; the smallest result names the language.  Narrow margins are
rejected: ``confident`` is false there.

Null texts and texts without letters are ``und`` with score 0.  Without any
training rows, as from an empty table, every text is ``und``.  Ties go to the language with more training
rows, then to the smaller name.  Repeated rows get equal answers, very long texts are compressed whole.
Other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lattica.llm.common import lean, slices, table

LETTER, OTHERS = re.compile(r"[^\W\d_]"), re.compile(r"[\W\d_]+")
#: Bounds of what is learned: training rows a language, bytes of a dictionary, and the languages that get as much; more share what these would get.
ROWS, DICT_BYTES, LANGS = 300, 96 << 10, 200
#: Characters of a training text that are learned from.
LEARNED = 50_000
LEVEL = 7
#: Bytes of difference that halve a language's weight; least margin, in parts of the text's size, of a confident answer.
SOFT, MARGIN = 4.0, 0.01

_SCHEMA = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("confident", pa.bool_())])


def plain(text: str) -> str:
    """Letters in lower case, single spaces between."""
    return OTHERS.sub(" ", text.lower())


def content(texts: list[str], size: int = DICT_BYTES) -> bytes:
    """Dictionary content: a third passages, then words, the most frequent last, where matches are cheapest."""
    texts = [plain(t) for t in texts]
    words = Counter(w for t in texts for w in t.split())
    chosen, room = [], size * 2 // 3
    for w, _ in sorted(words.items(), key=lambda x: (-x[1], x[0])):
        room -= len(w.encode()) + 1
        if room < 0:
            break
        chosen.append(w)
    share = size // 3 // max(1, len(texts))
    passages = "\n".join(t[: max(share, 40)] for t in texts).encode()[: size // 3]
    return passages + " ".join(["", *reversed(chosen), ""]).encode()


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each (lang, at) once a task, with the least of its texts seen there."""
    found: dict[tuple[str, int], str] = {}
    for part in slices(batches):
        for lang, at, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
            found[lang, at] = min(text, found.get((lang, at), text))
    for (lang, at), text in found.items():
        yield table(_SAMPLE, [lang], [at], [text])


_SAMPLE = pa.schema([("lang", pa.string()), ("at", pa.int64()), ("text", pa.string())])


def fit(df: DataFrame, text_col: str = "text", lang_col: str = "lang", rows: int = ROWS, size: int = DICT_BYTES) -> dict[str, bytes]:
    """Dictionaries from the ``rows`` distinct texts a language, or all if it has fewer, of the least hashes.

    The counts of rows a language are taken over all rows; copies of a text count there but
    are one text of the sample, so it has the size it can have however the copies are dealt,
    and what comes to the driver is LEARNED characters of ``rows`` texts a language at most.  Every language is learned:
    with over LANGS of them, texts and bytes a language shrink, to one text at least.
    """
    known = df.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.xxhash64(F.col(text_col)).alias("at")).where("text IS NOT NULL AND lang IS NOT NULL")
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").collect()}
    if not counts:
        return {}
    over = max(LANGS, len(counts))
    rows, size = max(1, rows * LANGS // over), max(1, size * LANGS // over)
    # distinct by hash, without the texts; the limit of the rank is applied in each task before the shuffle, too
    nth = F.row_number().over(W.partitionBy("lang").orderBy("at"))
    least = known.select("lang", "at").distinct().withColumn("nth", nth).where(F.col("nth") <= rows).select("lang", "at")
    chosen = known.select("lang", "at", F.substring("text", 1, LEARNED).alias("text")).join(F.broadcast(least), ["lang", "at"], "left_semi")  # rows * LANGS hashes at most, or one a language
    each = chosen.mapInArrow(lean(_once), "lang string, at bigint, text string").groupBy("lang", "at").agg(F.min("text").alias("text"))
    sample: dict[str, list] = {lang: [] for lang in counts}
    for r in each.orderBy("lang", "at").collect():
        sample[r["lang"]].append(r["text"])
    return {lang: content(texts, size) for lang, texts in sample.items()}


class Scorer:
    """Compressed sizes under each language's dictionary."""

    def __init__(self, dictionaries: dict[str, bytes], level: int = LEVEL):
        self.langs = list(dictionaries)
        self.with_dict = []
        for data in dictionaries.values():
            own = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            own.precompute_compress(level=level)
            self.with_dict.append(zstandard.ZstdCompressor(dict_data=own, write_content_size=False, write_dict_id=False))

    def __call__(self, text: str | None) -> tuple[str, float, bool]:
        if not self.langs or text is None or not LETTER.search(text):
            return "und", 0.0, False
        data = plain(text).encode()
        sizes = np.array([len(c.compress(data)) for c in self.with_dict], float)
        best = int(sizes.argmin())
        score = 1 / np.exp2((sizes[best] - sizes) / SOFT).sum()
        margin = np.partition(sizes, 1)[1] - sizes[best] if len(sizes) > 1 else np.inf
        return self.langs[best], float(score), bool(margin >= max(2, MARGIN * len(data)))


def identify(df: DataFrame, dictionaries: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, lang_pred, score, confident."""
    own = df.sparkSession.sparkContext.broadcast(dictionaries)  # LANGS * DICT_BYTES at most

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = Scorer(own.value)
        for part in slices(batches):
            found = [score(t) for t in part.column(1).to_pylist()]
            yield table(_SCHEMA, part.column(0), *(list(c) for c in zip(*found, strict=True))) if found else table(_SCHEMA, [], [], [], [])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(lean(scan), "doc_id bigint, lang_pred string, score double, confident boolean")


def predict_held_out(df: DataFrame) -> DataFrame:
    """Learn from the documents whose crc32(doc_id) mod 5 is not 0, predict all."""
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    found = identify(df, fit(df.where(~held_out)))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "confident")
