"""CSV: parsing, type inference, import and export."""

from __future__ import annotations

import csv
import io

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class CsvError(ValueError):
    """Text that is no CSV."""


def records(text: str, delimiter: str = ",", quote: str = '"') -> list[list[str]]:
    """Records of a small text; blank lines are skipped, an open quote is an error."""
    if text.count(quote) % 2:
        raise CsvError("a quote is not closed")
    return [r for r in csv.reader(io.StringIO(text, newline=""), delimiter=delimiter, quotechar=quote) if r]


def infer_kind(samples: list[str | None], null: str = "") -> str:
    """bigint, double, boolean or string: the first that fits all samples; string without any."""
    known = [s.strip() for s in samples if s is not None and s != null]

    def fits(cast) -> bool:
        try:
            return bool([cast(s) for s in known])
        except ValueError:
            return False

    if not known:
        return "string"
    if fits(int):
        return "bigint"
    if fits(float):
        return "double"
    return "boolean" if all(s.lower() in ("true", "false", "0", "1") for s in known) else "string"


def read_csv(spark: SparkSession, path: str, header: bool = True, delimiter: str = ",", quote: str = '"', null: str = "") -> DataFrame:
    """A CSV file or folder with types inferred from all rows; missing names become colN, short records are padded."""
    raw = spark.read.csv(path, header=header, sep=delimiter, quote=quote, escape=quote, multiLine=True, nullValue=null, mode="PERMISSIVE")
    raw = raw.toDF(*(c if header and c else f"col{i}" for i, c in enumerate(raw.columns)))
    fits = raw.agg(*(F.bool_and(fit).alias(f"{i} {kind}") for i, c in enumerate(raw.columns) for kind, fit in _fits(F.when(F.col(c) != null, F.col(c))).items())).first()
    return typed(raw, {c: next((k for k in KINDS if fits[f"{i} {k}"]), "string") for i, c in enumerate(raw.columns)})


#: In the order of preference, before string; and what a number looks like, as a cast also takes 1d or 0x1p3.
KINDS = ("bigint", "double", "boolean")
_DOUBLE = r"(?i)^\s*[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?|inf|infinity|nan)\s*$"


def _fits(c: Column) -> dict[str, Column]:
    """Whether a text is of each kind; NULL for NULL."""
    number, truth = c.rlike(_DOUBLE) & F.trim(c).try_cast("double").isNotNull(), F.lower(F.trim(c)).isin("true", "false", "0", "1")
    return {k: F.when(c.isNotNull(), v) for k, v in zip(KINDS, (F.trim(c).try_cast("bigint").isNotNull(), number, truth), strict=True)}


def typed(raw: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Text columns as the kinds; what does not fit is NULL."""
    return raw.select(*(F.trim(F.col(c)).try_cast(k).alias(c) if k != "string" else F.col(c) for c, k in kinds.items()))


def read_text(spark: SparkSession, text: str, header: bool = True, delimiter: str = ",", quote: str = '"', null: str = "") -> DataFrame:
    """A CSV text in memory."""
    rows = records(text, delimiter, quote)
    width = max(map(len, rows), default=0)
    names = rows[0] if header and rows else []
    names = [names[i] if i < len(names) and names[i] else f"col{i}" for i in range(width)]
    body = [[r[i] if i < len(r) and r[i] != null else None for i in range(width)] for r in rows[header:]]
    kinds = {n: infer_kind([r[i] for r in body], null) for i, n in enumerate(names)}
    return typed(spark.createDataFrame(body, ", ".join(f"`{n}` string" for n in names)), kinds)


def line(columns: list[str], delimiter: str = ",", quote: str = '"') -> Column:
    """One CSV record; fields are quoted only where they must be, NULL is empty."""

    def field(c: str) -> Column:
        s = F.coalesce(F.col(c).cast("string"), F.lit(""))
        odd = F.contains(s, F.lit(delimiter)) | F.contains(s, F.lit(quote)) | F.contains(s, F.lit("\n")) | F.contains(s, F.lit("\r"))
        return F.when(odd, F.concat(F.lit(quote), F.replace(s, F.lit(quote), F.lit(quote * 2)), F.lit(quote))).otherwise(s)

    return F.concat_ws(delimiter, *map(field, columns))


def write_csv(df: DataFrame, path: str, delimiter: str = ",") -> None:
    df.write.csv(path, header=True, sep=delimiter, quote='"', escape='"')
