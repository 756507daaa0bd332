"""The operation script: ten statement forms over one table.

The table's state is an immutable DataFrame; a statement makes a new one or rows.
A malformed or failing statement is counted and skipped.  Rows are returned, not only counted.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from lattica.functions.nulls import OPERATORS, script_compare
from lattica.operators import aggregate, joins, mutate

_TOKEN = re.compile(r'\s*("(?:[^"\\]|\\.)*"|[^\s"]+)')


class ScriptError(ValueError):
    """A statement that cannot be parsed or run."""


@dataclass
class Report:
    statements: int = 0
    executed: int = 0
    errors: int = 0
    rows_scanned: int = 0


def statements(script: str) -> list[str]:
    """Parts between semicolons; those inside quotes do not part."""
    out, held, quoted = [], [], False
    for c in script:
        quoted ^= c == '"'
        if c == ";" and not quoted:
            out.append("".join(held))
            held = []
        else:
            held.append(c)
    return [s.strip() for s in [*out, "".join(held)] if s.strip()]


def tokens(statement: str) -> list[str]:
    return [m.group(1) for m in _TOKEN.finditer(statement)]


def literal(token: str):
    """int, real, bool, null or a quoted string."""
    if token.startswith('"'):
        return token[1:-1].replace('\\"', '"')
    named = {"null": None, "true": True, "false": False}
    if token in named:
        return named[token]
    for kind in (int, float):
        try:
            return kind(token)
        except ValueError:
            pass
    raise ScriptError(f"no value: {token}")


class Script:
    """Runs statements over a table; the first column is the row id."""

    def __init__(self, table: DataFrame):
        self.table, self.report, self.results = table, Report(), []

    def column(self, token: str) -> str:
        if token.isdigit():
            if int(token) >= len(self.table.columns):
                raise ScriptError(f"no column {token}")
            return self.table.columns[int(token)]
        if token not in self.table.columns:
            raise ScriptError(f"no column {token}")
        return token

    def value(self, column: str, token: str):
        v, kind = literal(token), self.table.schema[column].dataType.simpleString()
        if isinstance(v, str) and kind != "string":
            raise ScriptError("text for a column of another type")
        if v is not None and not isinstance(v, bool) and kind in ("bigint", "int"):
            v = int(v)
        return F.lit(v).cast(kind)

    def condition(self, parts: list[str]):
        if len(parts) != 4 or parts[0] != "where" or parts[2] not in OPERATORS:
            raise ScriptError("where <column> <operator> <value>")
        c = self.column(parts[1])
        return script_compare(parts[2], F.col(c), self.value(c, parts[3]))

    def run(self, script: str) -> None:
        for s in statements(script):
            self.report.statements += 1
            try:
                self.statement(tokens(s))
                self.report.executed += 1
            except (ScriptError, mutate.MutationError, AnalysisException):
                self.report.errors += 1

    def rows(self, df: DataFrame) -> None:
        self.report.rows_scanned += df.count()
        self.results.append(df)

    def statement(self, t: list[str]) -> None:
        match t:
            case ["insert", *values] if len(values) == len(self.table.columns):
                self.table = mutate.insert(self.table, [tuple(map(literal, values))], id_col=self.table.columns[0])
            case ["update", "set", column, value, *rest]:
                c = self.column(column)
                self.table = mutate.update(self.table, {c: self.value(c, value)}, self.condition(rest))
            case ["delete", *rest] if rest:
                self.table = mutate.delete(self.table, self.condition(rest))
            case ["scan"]:
                self.rows(self.table)
            case ["scan", *rest]:
                self.rows(self.table.where(self.condition(rest)))
            case ["index_scan", column, value]:
                c = self.column(column)
                self.rows(self.table.where(F.col(c).eqNullSafe(self.value(c, value))))
            case ["join"]:
                if len(self.table.columns) < 2:
                    raise ScriptError("nothing to join by")
                self.rows(joins.adjacent_pairs(self.table, self.table.columns[1], self.table.columns[0]))
            case ["compact"]:
                self.table = mutate.compacted(self.table, 1)
            case ["checkpoint"]:
                from lattica.plans.durable import staged

                self.table = staged(self.table, "table")
            case ["agg", column]:
                self.results.append(aggregate.script_agg(self.table, self.column(column)))
            case _:
                raise ScriptError("unknown statement")


def run_script(table: DataFrame, script: str) -> tuple[Report, Script]:
    own = Script(table)
    own.run(script)
    return own.report, own
