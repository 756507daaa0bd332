"""Fast exact encoding with a tokenizer that drops white space.

Such a tokenizer's ids for a text are those of its words one after another, and those of
a word of plain letters, digits and marks are those of its pieces in lower case.  The
distinct words of a batch, and their distinct pieces, are found column-wise; the
library encodes each piece once, many at a time, parted by spaces, where each piece ends with
the next end-of-word token.  Any other word is encoded alone.  ``headed`` keeps the ids of a bounded
number of words and pieces from batch to batch, those that came again before others; nothing else is kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from lattica.llm.common import keyed_text, lean, slices, table

#: White space by Unicode; splitting at it otherwise also takes these four controls for it.
_ODD = re.compile("[\x1c-\x1f]")
WORD = "[^\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_WORD = re.compile(f"{WORD}+")
#: Characters of plain words: letters whose lower case is one letter, digits, and marks but for the apostrophe and <.
_UPPER, _LOWER, _MARKS = "A-ZÀ-ÖØ-Þ", "a-zß-öø-ÿ", r"!\"#$%&()*+,\-./:;=>?@\[\\\]^_`{|}~"
_PLAIN = f"^[{_UPPER}{_LOWER}0-9{_MARKS}]+$"
_PIECE = f"([{_LOWER}]+|[0-9]|[{_MARKS}]+)"
#: Pieces that the library encodes at a time.
BLOCK = 1000
#: Runs of ids that are put together at a time.
RUNS = 1 << 16
#: Words, and pieces, whose ids a worker keeps, and the most bytes of each.
KEEP, LONGEST = 400_000, 64


def words(text: str) -> list[str]:
    return _WORD.findall(text) if _ODD.search(text) else text.split()


def _gathered(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs of ``data`` one after another; found ``RUNS`` at a time, so that the places take little memory."""
    out, at = np.empty(int(sizes.sum()), data.dtype), 0
    for k in range(0, len(sizes), RUNS):
        n = sizes[k : k + RUNS]
        ends = np.cumsum(n)
        upto = at + int(ends[-1])
        out[at:upto] = data[np.repeat(starts[k : k + RUNS] - ends + n, n) + np.arange(upto - at)]
        at = upto
    return out


def _offsets(lists: pa.Array) -> np.ndarray:
    """Bounds of the lists in their flattened values."""
    own = lists.offsets.to_numpy()
    return own - own[0]


class Kept:
    """ids of strings that came before, of ``KEEP`` at most."""

    def __init__(self):
        self.strings, self.ids = pa.array([], pa.large_string()), np.zeros(0, "<u4")
        self.n, self.again = np.zeros(0, np.int64), np.zeros(0, bool)

    def through(self, distinct: pa.Array, encode) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all, start of each, number of each) for distinct strings; ``encode``, which gives the same, gets only those not kept."""
        distinct = distinct.cast(pa.large_string())
        found = pc.index_in(distinct, value_set=self.strings)
        fresh = pc.is_null(found).to_numpy(zero_copy_only=False)
        new = distinct.filter(pa.array(fresh))
        ids, starts, n = encode(new)
        place = pc.fill_null(found, 0).to_numpy(zero_copy_only=False).astype(np.int64)
        self.again[place[~fresh]] = True
        place[fresh] = len(self.strings) + np.arange(len(new))
        ids = np.concatenate([self.ids, ids])
        starts = np.concatenate([np.cumsum(self.n) - self.n, len(self.ids) + starts])
        n = np.concatenate([self.n, n])
        self._keep(pa.concat_arrays([self.strings, new]), ids, starts, n, np.concatenate([self.again, np.zeros(len(new), bool)]))
        return ids, starts[place], n[place]

    def _keep(self, strings: pa.Array, ids: np.ndarray, starts: np.ndarray, n: np.ndarray, again: np.ndarray) -> None:
        """The short ones of these; if they are too many, those that came again, the first of them up to half the room."""
        stay = pc.less_equal(pc.binary_length(strings), LONGEST).to_numpy(zero_copy_only=False)
        if stay.sum() > KEEP:
            stay &= again
            stay[np.flatnonzero(stay)[KEEP // 2 :]] = False
            again = np.zeros(len(again), bool)
        self.strings, self.ids = strings.filter(pa.array(stay)), _gathered(ids, starts[stay], n[stay])
        self.n, self.again = n[stay], again[stay]


class Encoder:
    """ids of texts, as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        size = self.library.get_vocab_size(with_added_tokens=True)
        self.strings = [self.library.id_to_token(i) or "" for i in range(size)]
        self.ends = np.array([s.endswith("</w>") for s in self.strings])
        self.words, self.pieces = Kept(), Kept()
        probe = ["Ab", "c'd", "12", "é.", "!?"]
        if self.alone("\n ".join([*probe, ""])) != b"".join(map(self.alone, probe)):
            raise ValueError("the tokenizer does not drop white space")

    def alone(self, text: str) -> bytes:
        """By the library itself."""
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _pieces(self, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all, start of each, number of each)."""
        pieces, data, sizes = distinct.to_pylist(), [np.zeros(0, "<u4")], [np.zeros(0, np.int64)]
        for k in range(0, len(pieces), BLOCK):
            block = pieces[k : k + BLOCK]
            ids = np.array(self.library.encode(" ".join(block), add_special_tokens=False).ids, "<u4")
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) != len(block) or stops[-1] != len(ids):
                own = [np.frombuffer(self.alone(p), "<u4") for p in block]
                ids, stops = np.concatenate(own), np.cumsum([len(x) for x in own])
            data.append(ids)
            sizes.append(np.diff(stops, prepend=0))
        n = np.concatenate(sizes)
        return np.concatenate(data), np.cumsum(n) - n, n

    def _words(self, distinct: pa.Array, keep: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all, start of each, number of each) for distinct words without white space."""
        plain = pc.match_substring_regex(distinct, _PLAIN)
        parted = pc.utf8_rtrim(pc.replace_substring_regex(pc.utf8_lower(distinct.filter(plain)), _PIECE, r"\1 "), " ")
        lists = pc.split_pattern(parted, " ")
        coded = lists.flatten().dictionary_encode()
        ids, begins, sizes = self.pieces.through(coded.dictionary, self._pieces) if keep else self._pieces(coded.dictionary)
        which = coded.indices.to_numpy()
        split = _gathered(ids, begins[which], sizes[which])
        ends = np.concatenate([[0], np.cumsum(sizes[which])])[_offsets(lists)]
        rest = [np.frombuffer(self.alone(w), "<u4") for w in distinct.filter(pc.invert(plain)).to_pylist()]
        more = np.array([len(x) for x in rest], np.int64)
        data = np.concatenate([split, *rest]).astype("<u4")
        flag = plain.to_numpy(zero_copy_only=False).astype(bool)
        starts, n = np.zeros(len(flag), np.int64), np.zeros(len(flag), np.int64)
        starts[flag], n[flag] = ends[:-1], np.diff(ends)
        starts[~flag], n[~flag] = len(split) + np.cumsum(more) - more, more
        return data, starts, n

    def _spread(self, texts: list[str], heads: list[str], keep: bool = False) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
        """ids of all, ends of the words in them, bounds of the texts in words, and words of each head."""
        odd = any(map(_ODD.search, texts))
        parted = (lambda x: pa.array([words(t) for t in x], pa.list_(pa.string()))) if odd else (lambda x: pc.utf8_split_whitespace(pa.array(x, pa.large_string())))
        lists = parted(texts)
        coded = lists.flatten().dictionary_encode()
        data, starts, n = self.words.through(coded.dictionary, lambda new: self._words(new, True)) if keep else self._words(coded.dictionary)
        which, bounds = coded.indices.to_numpy(), _offsets(lists)
        del lists, coded
        sizes = n[which]
        raw = _gathered(data, starts[which], sizes).tobytes()
        ahead = pc.list_value_length(parted(heads)).to_numpy(zero_copy_only=False).astype(np.int64)
        return raw, np.concatenate([[0], np.cumsum(sizes)]), bounds, ahead

    def headed(self, texts: list[str]) -> tuple[list[bytes], np.ndarray]:
        """The ids of each text, and how many of them are those of its first line; 0 for a text of one line."""
        at = [t.find("\n") for t in texts]
        heads = [t[:k].rstrip() if k > 0 else "" for t, k in zip(texts, at, strict=True)]
        raw, ends, bounds, ahead = self._spread(texts, heads, keep=True)
        stops = (4 * ends[bounds]).tolist()
        first = ends[bounds[:-1] + np.minimum(ahead, np.diff(bounds))] - ends[bounds[:-1]]
        return [raw[a:b] for a, b in zip(stops, stops[1:], strict=False)], np.where([bool(h) for h in heads], first, 0)

    def texts(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text."""
        raw, ends, bounds, _ = self._spread(texts, [])
        stops = (4 * ends[bounds]).tolist()
        for a, b in zip(stops, stops[1:], strict=False):
            yield raw[a:b]

    def decode(self, ids: np.ndarray) -> str:
        """As the library's decode(ids, skip_special_tokens=False) for a tokenizer without a decoder."""
        return " ".join(map(self.strings.__getitem__, ids.tolist()))


@lru_cache(1)
def encoder(path: str) -> Encoder:
    """One for each Python worker and path."""
    return Encoder(path)


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())])
_ANSWERS = _SCHEMA.append(pa.field("answer_start", pa.int64()))


def scanner(path: str, last: int | None = None, answers: bool = False):
    """For batches of (doc_id, text): batches of (doc_id, ids), with ``answers`` also answer_start."""
    tail = b"" if last is None else int(last).to_bytes(4, "little")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for part in slices(batches, most=3 << 20):
            texts = part.column(1).to_pylist()
            if answers:
                ids, starts = own.headed(texts)
                yield table(_ANSWERS, part.column(0), [x + tail for x in ids], starts)
            else:
                yield table(_SCHEMA, part.column(0), [x + tail for x in own.texts(texts)])

    return scan


def tokenized(df: DataFrame, path: str, last: int | None = None, id_col: str = "doc_id", text_col: str = "text", answers: bool = False) -> DataFrame:
    """(doc_id, ids): each whole text's ids, then ``last``. A null text is an empty one.

    With ``answers`` also answer_start, the number of ids of the first line, 0 for a text of one line.
    """
    return keyed_text(df, id_col, text_col).mapInArrow(lean(scanner(path, last, answers)), "doc_id bigint, ids binary" + ", answer_start bigint" * answers)
