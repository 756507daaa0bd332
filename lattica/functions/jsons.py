"""JSON lookup by pointer, typed access and validity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pointer_path(pointer: str) -> str:
    """A JSON pointer as a path of Spark: ``/a/0/b~1c`` is ``$['a'][0]['b/c']``."""
    if pointer and not pointer.startswith("/"):
        raise ValueError("a pointer starts with /")
    parts = [p.replace("~1", "/").replace("~0", "~") for p in pointer.split("/")[1:]]
    return "$" + "".join(f"[{p}]" if p.isdigit() else "['" + p + "']" for p in parts)


def lookup(s: Column, pointer: str) -> Column:
    return F.get_json_object(s, pointer_path(pointer))


def valid(s: Column) -> Column:
    return F.try_parse_json(s).isNotNull()


def typed(s: Column, pointer: str, kind: str) -> Column:
    """The value as ``kind``; NULL if it is of another type. Whole numbers only for bigint."""
    value = F.try_parse_json(s)
    if kind == "bigint":
        number = F.try_variant_get(value, pointer_path(pointer), "double")
        return F.when(number == F.floor(number), number.cast("bigint"))
    return F.try_variant_get(value, pointer_path(pointer), kind)
