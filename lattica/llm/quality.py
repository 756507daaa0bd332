"""Quality classifier by weak labels.

Overlapping heuristic labellers vote good, bad or abstain on every text that has the words
their measure needs, and are missing on others.  Counts of
their vote patterns over all rows, at most 4 ** labellers of them, feed an
expectation-maximisation that estimates each labeller's accuracy on either class
and the classes' shares; a missing vote says nothing.  The posterior of a text's pattern is its weak label.
A hashed linear scorer, trained on the posteriors of a bounded sample, scores
every whole text from byte trigrams and the labellers' measures.

The scorer's trigrams are a mean over the text, so their evidence grows with their number n: the
log-odds of the scorer count n / (n + ``EVEN``) and those of the posterior the rest.  A long
text is judged by the scorer, a very short one by its votes; no length is a case of its own.

Null and empty texts, on which all votes are missing, have the share of good texts as posterior; very long ones are read whole.
Repeated rows get equal scores and are one row of the sample, ties with the threshold are kept.  Without rows, or where the sample has one class
only, the score is the posterior.  An empty table gives no rows; other columns, whatever their names, are
not looked at, and carried along by ``accepted``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import keyed_text, lean, slices, table
from lattica.llm.shingles import word_hashes

#: Bound of the training sample, dimensions of the hashed features, steps of training.
SAMPLE, DIMS, STEPS = 3000, 4096, 200
ABSTAIN, BAD, GOOD, MISSING = 0, 1, 2, 3

#: Common function words of the languages to expect.
FUNCTION_WORDS = (
    "the of and to in is that it for was on with as be by at this have from or an are not "
    "der die das und in zu den von mit sich des auf für ist im dem nicht ein eine als auch es "
    "le la les de des et en un une du que est pour qui dans par sur au pas avec ce il "
    "el la los las de que y en un una del se por con para al es lo como más"
)


@dataclass(frozen=True)
class Labeller:
    """Votes bad from ``bad`` on, good up to ``good`` (both turned round where bad < good), else abstains; missing on texts of fewer words."""

    name: str
    good: float
    bad: float
    words: int


#: A measure of 0 to 1, or a length, for each; see ``measures``.  A good limit of -1 is never
#: met: such a labeller knows one kind of bad text, and its silence says little.
LABELLERS = (
    Labeller("symbols", -1, 0.10, 4),  # marks such as # $ % & * | among all characters
    Labeller("capitals", -1, 0.50, 8),  # upper case among ASCII letters
    Labeller("repeats", -1, 0.15, 8),  # words equal to the word before
    Labeller("function_words", 0.12, 0.04, 20),  # words that any prose has
    Labeller("bare_marks", -1, 0.15, 4),  # words without a letter or digit
    Labeller("exclamations", -1, 0.30, 4),  # words that end in !
    Labeller("variety", 0.50, 0.15, 20),  # distinct words, against what so many words would have
)
_KINDS = np.zeros(256, np.uint8)
_KINDS[list(b"#$%&*|<>{}[]^~=_+@\\")] = 1
_KINDS[ord("A") : ord("Z") + 1] = 2
_KINDS[ord("a") : ord("z") + 1] = 3
_KINDS[ord("0") : ord("9") + 1] = 4
_KINDS[128:] = 5
_KINDS[ord("!")] = 6
#: Trigrams at which the scorer and the votes weigh the same.
EVEN = 100.0


def measures(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(texts x labellers) measures, and each text's number of words."""
    n = len(texts)
    sizes = np.array([len(t) for t in texts], np.int64)
    of_byte = np.repeat(np.arange(n), sizes)
    data = np.frombuffer(b"".join(texts), np.uint8)
    kinds = np.bincount(of_byte * 8 + _KINDS[data], minlength=8 * n).reshape(n, 8).astype(float)
    owner, hashes, lengths = word_hashes(texts)
    count = np.bincount(owner, minlength=n).astype(float)
    each = lambda flag: np.bincount(owner[flag], minlength=n) / np.maximum(count, 1)
    same = np.zeros(len(owner), bool)
    same[1:] = (owner[1:] == owner[:-1]) & (hashes[1:] == hashes[:-1])
    _, common, _ = word_hashes([" ".join(sorted(set(FUNCTION_WORDS.split()))).encode()])
    # words without letters and digits, and ends of words, from the bytes in place
    joined = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    alnum = np.concatenate([[0], np.cumsum(np.isin(_KINDS[joined], (2, 3, 4, 5)))])
    space = np.isin(joined, [32, *range(9, 14)])
    starts = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    ends = starts + lengths
    order = np.lexsort((hashes, owner))
    new = np.ones(len(order), bool)
    new[1:] = (owner[order][1:] != owner[order][:-1]) | (hashes[order][1:] != hashes[order][:-1])
    distinct = np.bincount(owner[order][new], minlength=n)
    out = np.column_stack([
        kinds[:, 1] / np.maximum(sizes, 1),
        kinds[:, 2] / np.maximum(kinds[:, 2] + kinds[:, 3], 1),
        each(same),
        each(np.isin(hashes, common)),
        each(alnum[ends] == alnum[starts]) if len(starts) else np.zeros(n),
        each(joined[ends - 1] == ord("!")) if len(starts) else np.zeros(n),
        distinct / np.maximum(np.sqrt(count * 40), 1),  # distinct words grow slower than words do
    ])
    return out, count.astype(np.int64)


def votes(values: np.ndarray, words: np.ndarray) -> np.ndarray:
    """(texts x labellers) votes of the measures."""
    good, bad = (np.array([getattr(x, k) for x in LABELLERS]) for k in ("good", "bad"))
    turned = np.where(bad < good, -1.0, 1.0)
    v = values * turned
    out = np.where(v >= bad * turned, BAD, np.where(v <= good * turned, GOOD, ABSTAIN))
    return np.where(words[:, None] >= np.array([x.words for x in LABELLERS]), out, MISSING)


#: First guess of how often a labeller abstains, says bad and says good on texts of either class, and its weight in parts of the rows.
GUESS = np.array([[0.50, 0.40, 0.10], [0.60, 0.02, 0.38]])
TRUST = 0.02


def estimate(patterns: np.ndarray, counts: np.ndarray, steps: int = 100) -> tuple[np.ndarray, np.ndarray, float]:
    """Expectation-maximisation over vote patterns.

    (posterior of good for each pattern, accuracy of each labeller's votes on bad and on good
    texts, share of good texts).  Starts from ``GUESS``, which says which class is good, and
    holds on to it as to ``TRUST`` of the rows.
    """
    said = np.stack([patterns == v for v in (ABSTAIN, BAD, GOOD)], axis=2)
    chance, share, total = np.repeat(GUESS[:, None, :], patterns.shape[1], 1), 0.8, counts.sum()
    good = np.zeros(len(counts))
    for _ in range(steps):
        like = [(np.log(chance[y]) * said).sum((1, 2)) + np.log(share if y else 1 - share) for y in (0, 1)]
        good = 1 / (1 + np.exp(np.clip(like[0] - like[1], -500, 500)))
        for y, weight in ((0, counts * (1 - good)), (1, counts * good)):
            seen = (weight[:, None, None] * said).sum(0) + (TRUST * total + 1) * GUESS[y]
            chance[y] = np.maximum(seen / seen.sum(1, keepdims=True), 1e-4)
        share = float(np.clip((counts * good).sum() / max(total, 1), 0.02, 0.98))
    accuracy = np.stack([chance[0][:, BAD], chance[1][:, GOOD]]) / np.maximum(chance[:, :, BAD] + chance[:, :, GOOD], 1e-9)
    return good, accuracy, share


def trigrams(data: np.ndarray) -> np.ndarray:
    """Hashed bucket of the three bytes that start at each byte but the last two."""
    x = data.astype(np.uint32)
    return ((x[:-2] * np.uint32(0x9E3779B1) ^ x[1:-1] * np.uint32(0x85EBCA77) ^ x[2:] * np.uint32(0xC2B2AE3D)) * np.uint32(0x27D4EB2F) >> np.uint32(32 - DIMS.bit_length() + 1)).astype(np.int64)


def _dense(values: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.column_stack([np.minimum(values, 2.0), votes(values, words) == BAD, votes(values, words) == GOOD]).astype(np.float32)


@dataclass
class Scorer:
    weights: np.ndarray
    dense: np.ndarray
    bias: float

    def __call__(self, texts: list[bytes], values: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Log-odds of good, of texts and their measures."""
        raw = _dense(values, words) @ self.dense + self.bias
        for i, t in enumerate(texts):
            if len(t) > 2:
                raw[i] += self.weights[trigrams(np.frombuffer(t, np.uint8))].mean() * DIMS**0.5
        return np.clip(raw, -30, 30)


def train(grams: np.ndarray, dense: np.ndarray, target: np.ndarray, steps: int = STEPS) -> Scorer:
    """Logistic regression on soft targets by full-batch gradients with momentum; classes weigh the same."""
    scale = np.float32(DIMS**0.5)  # of the grams, which are not copied for it
    w, v, b = np.zeros(grams.shape[1], np.float32), np.zeros(dense.shape[1], np.float32), 0.0
    moves = [np.zeros_like(w), np.zeros_like(v), 0.0]
    weight = np.where(target >= 0.5, 0.5 / max(1, (target >= 0.5).sum()), 0.5 / max(1, (target < 0.5).sum()))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(grams @ (scale * w) + dense @ v + b, -30, 30)))
        g = ((p - target) * weight).astype(np.float32)
        grads = (scale * (g @ grams) + 1e-4 * w, g @ dense + 1e-4 * v, g.sum())
        moves = [0.9 * m + d for m, d in zip(moves, grads, strict=True)]
        w, v, b = w - 0.5 * moves[0], v - 0.5 * moves[1], b - 0.5 * moves[2]
    return Scorer(w, v, float(b))


_VOTED = pa.schema([("doc_id", pa.int64()), ("pattern", pa.int64())])
_SAMPLE = pa.schema([("pattern", pa.int64()), ("grams", pa.binary()), ("dense", pa.binary())])
_BASE = 4 ** np.arange(len(LABELLERS))


def _patterns(values: np.ndarray, words: np.ndarray) -> np.ndarray:
    return votes(values, words) @ _BASE


def voted(texts: DataFrame) -> DataFrame:
    """doc_id, pattern: the votes in base 4."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, most=1 << 19):
            yield table(_VOTED, part.column(0), _patterns(*measures([t.encode() for t in part.column(1).to_pylist()])))

    return texts.mapInArrow(lean(scan), "doc_id bigint, pattern bigint")


def featured(texts: DataFrame) -> DataFrame:
    """pattern, and features as 32-bit floats, those of the trigrams compressed."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1)
        for part in slices(batches, most=1 << 19):
            data = [t.encode() for t in part.column(1).to_pylist()]
            values, words = measures(data)
            grams = ((np.bincount(trigrams(np.frombuffer(t, np.uint8)), minlength=DIMS) / (len(t) - 2) if len(t) > 2 else np.zeros(DIMS)).astype(np.float32) for t in data)
            yield table(_SAMPLE, _patterns(values, words), [pack.compress(x.tobytes()) for x in grams], [x.tobytes() for x in _dense(values, words)])

    return texts.mapInArrow(lean(scan), "pattern bigint, grams binary, dense binary")


@dataclass
class Model:
    posterior: dict[int, float]
    accuracy: np.ndarray
    share: float
    scorer: Scorer | None


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Model:
    """Labellers' accuracies from all rows, the scorer from about ``sample`` rows chosen by a hash of key and text.

    Rows equal in both fall in or out together, so of those chosen one is kept: however often a row
    is repeated, no more than about ``sample`` come to the driver.
    """
    texts = keyed_text(df, id_col, text_col)
    found = voted(texts).groupBy("pattern").agg(F.count("*").alias("n")).orderBy("pattern").collect()  # 4 ** labellers rows at most
    if not found:
        return Model({}, np.full((2, len(LABELLERS)), 0.8), 0.8, None)
    codes, counts = (np.array([r[k] for r in found], np.int64) for k in ("pattern", "n"))
    good, accuracy, share = estimate(codes[:, None] // _BASE % 4, counts.astype(float))
    posterior = dict(zip(codes.tolist(), good.tolist(), strict=True))
    part = min(1.0, sample / int(counts.sum()))
    chosen = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < int(part * (1 << 30)) + 1
    rows = sorted(featured(texts.where(chosen).dropDuplicates()).collect())  # in one order, however they were dealt
    target = np.array([posterior[r["pattern"]] for r in rows])
    if not len(rows) or (target >= 0.5).all() or (target < 0.5).all():
        return Model(posterior, accuracy, share, None)
    dense = np.stack([np.frombuffer(r["dense"], np.float32) for r in rows])
    grams, unpack = np.empty((len(rows), DIMS), np.float32), zstandard.ZstdDecompressor()
    for own, r in zip(grams, rows, strict=True):
        own[:] = np.frombuffer(unpack.decompress(r["grams"]), np.float32)
    del rows
    return Model(posterior, accuracy, share, train(grams, dense, target))


def _scores(m: Model, texts: list[str | None]) -> tuple[list[float], np.ndarray]:
    """Posterior and score of each text."""
    data = [(t or "").encode() for t in texts]
    values, words = measures(data)
    weak = np.array([m.posterior.get(c, m.share) for c in _patterns(values, words).tolist()])
    if m.scorer is None:
        return weak.tolist(), weak
    odds = np.clip(np.log(np.maximum(weak, 1e-12) / np.maximum(1 - weak, 1e-12)), -30, 30)
    n = np.maximum([len(t) - 2 for t in data], 0)
    part = n / (n + EVEN)
    return weak.tolist(), 1 / (1 + np.exp(-(part * m.scorer(data, values, words) + (1 - part) * odds)))


def scored(df: DataFrame, model: Model, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, weak_label (posterior of good), score, kept (score of the threshold at least)."""
    own = df.sparkSession.sparkContext.broadcast(model)  # DIMS weights and 4 ** labellers posteriors at most

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, most=1 << 19):
            weak, score = _scores(own.value, part.column(1).to_pylist())
            yield table(_FULL, part.column(0), weak, score, score >= threshold)

    return keyed_text(df, id_col, text_col).mapInArrow(lean(scan), "doc_id bigint, weak_label double, score double, kept boolean")


_FULL = pa.schema([("doc_id", pa.int64()), ("weak_label", pa.float64()), ("score", pa.float64()), ("kept", pa.bool_())])


def accepted(df: DataFrame, model: Model, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``df`` whose text scores the threshold at least, with all their columns."""
    own, k = df.sparkSession.sparkContext.broadcast(model), df.columns.index(text_col)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text_col, 1 << 19):
            yield part.filter(pa.array(_scores(own.value, part.column(k).to_pylist())[1] >= threshold))

    return df.mapInArrow(lean(scan), df.schema)


def classified(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    return scored(df, fit(df), threshold)
