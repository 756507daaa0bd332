"""Text, pattern and fuzzy-matching functions on Unicode strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space by Unicode, as a character class.
SPACE = r"[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def ltrim(s: Column) -> Column:
    return F.regexp_replace(s, f"^{SPACE}+", "")


def rtrim(s: Column) -> Column:
    return F.regexp_replace(s, f"{SPACE}+$", "")


def trim(s: Column) -> Column:
    return ltrim(rtrim(s))


def substr(s: Column, start: Column | int, length: Column | int | None = None) -> Column:
    """1-based; a start before 1 uses up the length."""
    start = F.lit(start) if isinstance(start, int) else start
    if length is None:
        return F.when(start < 1, s).otherwise(F.substring(s, start, F.char_length(s)))
    length = F.lit(length) if isinstance(length, int) else length
    return F.when(start < 1, F.substring(s, F.lit(1), F.greatest(length + start - 1, F.lit(0)))).otherwise(F.substring(s, start, F.greatest(length, F.lit(0))))


def position(haystack: Column, needle: str) -> Column:
    """1-based place of the needle, 0 if absent, 1 for an empty one."""
    return F.locate(needle, haystack).cast("bigint") if needle else F.when(haystack.isNotNull(), F.lit(1)).cast("bigint")


def split_part(s: Column, sep: str, n: int) -> Column:
    """The n-th part, from 0; empty where there is none."""
    return F.split_part(s, F.lit(sep), F.lit(n + 1))


def bounded_levenshtein(a: Column, b: Column, most: int) -> Column:
    """NULL beyond the bound."""
    return F.nullif(F.levenshtein(a, b, most), F.lit(-1)).cast("bigint")


def similarity(a: Column, b: Column) -> Column:
    """1 less the distance in parts of the longer length; 1 for two empty strings."""
    longer = F.greatest(F.char_length(a), F.char_length(b))
    return F.when(longer == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / F.nullif(longer, F.lit(0)))


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the longest common prefix in characters."""
    shorter = F.least(F.char_length(a), F.char_length(b))
    grown = F.aggregate(F.sequence(F.lit(1), F.greatest(shorter, F.lit(1))), F.lit(0), lambda n, i: F.when((n == i - 1) & (i <= shorter) & (F.substring(a, i, F.lit(1)) == F.substring(b, i, F.lit(1))), i).otherwise(n))
    return grown.cast("bigint")


def offsets(s: Column, needle: str) -> Column:
    """All places, from 0, where the needle starts, overlaps included: byte offsets."""
    raw, n = F.hex(s.cast("binary")), len(needle.encode())
    size = F.octet_length(s)
    wanted = F.lit(needle.encode().hex().upper())
    spots = F.when(size >= n, F.sequence(F.lit(0), F.greatest(size - n, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    return F.filter(spots, lambda i: F.substring(raw, i * 2 + 1, F.lit(2 * n)) == wanted)


def glob_regex(pattern: str) -> str:
    """The regular expression of a glob: ``*``, ``?``, ``[a-z]``, ``[!a]`` or ``[^a]``, and backslash."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[" and (end := pattern.find("]", i + 2 + (pattern[i + 1 : i + 2] in "!^"))) > 0:
            body, turned = pattern[i + 1 : end], pattern[i + 1] in "!^"
            out.append("[" + "^" * turned + _quoted(body[turned:], "-") + "]")
            i = end
        elif c == "\\" and i + 1 < len(pattern):
            i += 1
            out.append(_quoted(pattern[i]))
        else:
            out.append(_quoted(c))
        i += 1
    return "(?s)^" + "".join(out) + "$"


def small_regex(pattern: str) -> str:
    """A regular expression of the small dialect (. * ^ $ classes backslash) in Java's: other marks are literal."""
    out, i, inside = [], 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            out.append(_quoted(pattern[i + 1]))
            i += 1
        elif inside:
            inside = c != "]"
            out.append(c)
        elif c in "+?{}()|":
            out.append("\\" + c)
        else:
            inside = c == "["
            out.append(c)
        i += 1
    return "".join(out)


def _quoted(text: str, plain: str = "") -> str:
    return "".join(c if c.isalnum() or c in plain or c in " _" else f"\\{c}" for c in text)


def glob(s: Column, pattern: str) -> Column:
    return s.rlike(glob_regex(pattern))


def regex(s: Column, pattern: str) -> Column:
    return s.rlike(small_regex(pattern))
