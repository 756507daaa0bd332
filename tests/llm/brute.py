"""Plain versions of the operators, one text or pair at a time."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(x) -> str:
    return hashlib.sha256(x.encode() if isinstance(x, str) else bytes(x)).hexdigest()


def words(text):
    return WORD.findall((text or "").encode().lower().decode())


def shingle_set(text, k):
    w = words(text)
    return frozenset(tuple(w[i : i + k]) for i in range(max(len(w) - k + 1, 1))) if w else frozenset()


def near_groups(rows, k, percent=80):
    """doc_id -> smallest doc_id linked, by all pairs."""
    sets = [(i, shingle_set(t, k)) for i, t in rows]
    up = {i: i for i, _ in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                up[max(x, y)] = min(x, y)
    return {i: find(i) for i in up}


def without_repeats(rows, length):
    """(doc_id, text) -> (bytes removed, spans, kept bytes); every row counts, also one equal to another."""
    docs = [(i, t or "") for i, t in rows]
    seen = Counter()
    for _, t in docs:
        b = t.encode()
        seen.update(b[k : k + length] for k in range(len(b) - length + 1))
    out = {}
    for i, t in set(docs):
        b = t.encode()
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        out[i, t] = (sum(gone), sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1])), bytes(x for x, g in zip(b, gone, strict=True) if not g))
    return out


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]+"), re.compile(r"[0-9a-f]+")


def base_secrets(text):
    t = text or ""
    found = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(t) if len(m.group(2)) >= 6]
    found += [(m.start(), 1, "access", m.end()) for m in ACCESS.finditer(t) if len(m.group()) >= 20]
    found += [(m.start(), 2, "hex", m.end()) for m in HEX.finditer(t) if len(m.group()) >= 24]
    return [f"{k}:{s}:{e}" for s, _, k, e in sorted(found)]


def feature(payload):
    """Mean and deviation, share of rises, and quarters, sample by sample."""
    n, rises = len(payload), sum(b > a for a, b in zip(payload, payload[1:]))
    mean, square = sum(payload) / n, sum(x * x for x in payload) / n
    size, more, quarters, at = n // 4, n % 4, [], 0
    for k in range(4):
        own = payload[at : at + size + (k < more)]
        quarters.append(sum(own) // len(own))
        at += len(own)
    return f"{mean:.4f}|{max(0.0, square - mean * mean) ** 0.5:.4f}|{rises / n:.4f}|" + ",".join(map(str, quarters))


def containment(a, b, k=5):
    """Share of the smaller set of shingles that the other has."""
    a, b = shingle_set(a, k), shingle_set(b, k)
    return len(a & b) / min(len(a), len(b)) if a and b else 0.0


def posteriors(rows, guess, trust, steps):
    """Posterior of good of each row of votes (0 abstain, 1 bad, 2 good, 3 missing), row by row."""
    n, kinds = len(rows), range(len(rows[0]))
    chance = [[list(guess[y]) for _ in kinds] for y in (0, 1)]
    share, good = 0.8, [0.0] * n
    for _ in range(steps):
        for i, row in enumerate(rows):
            p = [1 - share, share]
            for y in (0, 1):
                for k, v in enumerate(row):
                    if v != 3:
                        p[y] *= chance[y][k][v]
            good[i] = p[1] / (p[0] + p[1])
        for y in (0, 1):
            for k in kinds:
                seen = [(trust * n + 1) * g for g in guess[y]]
                for row, g in zip(rows, good, strict=True):
                    if row[k] != 3:
                        seen[row[k]] += g if y else 1 - g
                chance[y][k] = [max(x / sum(seen), 1e-4) for x in seen]
        share = min(max(sum(good) / n, 0.02), 0.98)
    return good


def language(text, dictionaries, level):
    """Language of the smallest compressed size, the first of equals."""
    import unicodedata

    import zstandard

    if text is None or not any(unicodedata.category(c)[0] == "L" for c in text):
        return "und"
    letters = re.sub(r"[\W\d_]+", " ", text.lower()).encode()
    best = None
    for lang, data in dictionaries.items():
        own = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        own.precompute_compress(level=level)
        size = len(zstandard.ZstdCompressor(dict_data=own, write_content_size=False, write_dict_id=False).compress(letters))
        if best is None or size < best[0]:
            best = (size, lang)
    return best[1]
