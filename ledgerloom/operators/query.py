"""A query on two tables: a key, inputs, expressions over them, named outputs.

    q = JoinQuery()
    key = q.join_on(orders, "o_custkey", customer, "c_custkey")
    price, balance = q.input("left", "o_totalprice"), q.input("right", "c_acctbal")
    q.output("key", key)
    q.output("sum", price + balance)
    q.no_reveal("matched")       # all left rows, and a flag
    df = q.run()
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalar as S
from . import joins


def width_of(kind: T.DataType) -> int | None:
    """Bits of a column: 1 for a flag; None where no width is declared."""
    return {T.BooleanType: 1, T.ByteType: 8, T.ShortType: 16, T.IntegerType: 32, T.LongType: 64}.get(type(kind))


@dataclass(frozen=True, eq=False)
class Expr:
    """An expression and its width in bits; widths must agree for | and &, and + and * keep the left's.
    == and != give expressions, too."""

    column: Column
    bits: int | None

    def _same(self, other: "Expr") -> None:
        if self.bits is not None and other.bits is not None and self.bits != other.bits:
            raise ValueError(f"widths differ: {self.bits} and {other.bits}")

    def __or__(self, other: "Expr") -> "Expr":
        self._same(other)
        return Expr(self.column | other.column if self.bits == 1 else self.column.bitwiseOR(other.column), self.bits)

    def __and__(self, other: "Expr") -> "Expr":
        self._same(other)
        return Expr(self.column & other.column if self.bits == 1 else self.column.bitwiseAND(other.column), self.bits)

    def __lt__(self, other: "Expr") -> "Expr":
        return Expr(self.column < other.column, 1)

    def __eq__(self, other: "Expr") -> "Expr":  # type: ignore[override]
        return Expr(self.column == other.column, 1)

    def __ne__(self, other: "Expr") -> "Expr":  # type: ignore[override]
        return Expr(self.column != other.column, 1)

    __hash__ = object.__hash__

    def apply(self, fn: Callable[..., Column], *others: "Expr", bits: int | None = None) -> "Expr":
        """Any function of columns, a pandas UDF among them, of this expression and others."""
        return Expr(fn(self.column, *(o.column for o in others)), bits)

    def __invert__(self) -> "Expr":
        return Expr(~self.column if self.bits == 1 else F.bitwise_not(self.column), self.bits)

    def __mul__(self, other: "Expr") -> "Expr":
        """A product; by a flag, the value where it is set and else 0."""
        if other.bits == 1:
            return Expr(F.when(other.column, self.column).otherwise(F.lit(0)), self.bits)
        return Expr(self.column * other.column if self.bits is None else S.mul(self.column, other.column, self.bits), self.bits)

    def __add__(self, other: "Expr") -> "Expr":
        return Expr(self.column + other.column if self.bits is None else S.add(self.column, other.column, self.bits), self.bits)


class JoinQuery:
    def __init__(self, *, unique: bool = True):
        self.unique, self.flag, self.where = unique, None, None
        self.tables: dict[str, DataFrame] = {}
        self.inputs: dict[tuple[str, str], str] = {}
        self.tests: dict[tuple[str, str], str] = {}
        self.outputs: list[tuple[str, Expr]] = []

    def join_on(self, left: DataFrame, left_key: str, right: DataFrame, right_key: str) -> Expr:
        """Sets both tables and the key, once; gives the left key."""
        if self.tables:
            raise ValueError("join_on has been called")
        self.tables, self.keys = {"left": left, "right": right}, {"left": left_key, "right": right_key}
        return self.input("left", left_key)

    def input(self, side: str, column: str) -> Expr:
        """A source column. The right key reads as the left one, matched or not."""
        if side not in self.tables:
            raise ValueError("join_on comes first; sides are left and right")
        kind = self.tables[side].schema[column].dataType
        if side == "right" and column == self.keys["right"]:
            side, column = "left", self.keys["left"]
        name = self.inputs.setdefault((side, column), f"_in{len(self.inputs)}")
        return Expr(F.col(name), width_of(kind))

    def is_not_null(self, side: str, column: str) -> Expr:
        """Whether a source column holds a value: false in rows without a match, which read as zero
        elsewhere. The right key tells whether a row matched."""
        if side not in self.tables:
            raise ValueError("join_on comes first; sides are left and right")
        self.tables[side].schema[column]
        return Expr(F.col(self.tests.setdefault((side, column), f"_has{len(self.tests)}")), 1)

    @staticmethod
    def case(*branches: tuple[Expr, Expr], otherwise: Expr) -> Expr:
        """CASE WHEN condition THEN value ... ELSE otherwise END; the width is that of the last."""
        out = F.when(branches[0][0].column, branches[0][1].column)
        for condition, value in branches[1:]:
            out = out.when(condition.column, value.column)
        return Expr(out.otherwise(otherwise.column), otherwise.bits)

    @staticmethod
    def constant(value, bits: int | None = 64) -> Expr:
        return Expr(F.lit(value), bits)

    def output(self, name: str, expr: Expr) -> None:
        if name in [n for n, _ in self.outputs]:
            raise ValueError(f"output {name} is there already")
        self.outputs.append((name, expr))

    def no_reveal(self, flag: str) -> None:
        """Keeps all left rows; `flag`, the last column, tells the matched ones."""
        self.flag = flag

    def filter(self, predicate: Expr) -> None:
        """Rows for which the predicate does not hold count as unmatched."""
        self.where = predicate if self.where is None else self.where & predicate

    def run(self) -> DataFrame:
        left, right = self.tables["left"], self.tables["right"]
        if self.unique:
            joins.check_unique(right, self.keys["right"])
        own = lambda side: [F.col(f"`{c}`").alias(n) for (s, c), n in self.inputs.items() if s == side] + [F.col(f"`{c}`").isNotNull().alias(n) for (s, c), n in self.tests.items() if s == side]
        a = left.select(F.col(self.keys["left"]).alias("_lk"), *own("left"))
        b = right.select(F.col(self.keys["right"]).alias("_rk"), *own("right"), F.lit(True).alias("_hit"))
        both = a.join(b, F.col("_lk") == F.col("_rk"), "left" if self.flag else "inner")
        if self.flag:
            for (s, c), n in self.inputs.items():
                if s == "right":
                    both = both.withColumn(n, F.when(F.col("_hit"), F.col(n)).otherwise(joins.zero_of(right.schema[c].dataType)))
            for (s, _), n in self.tests.items():
                if s == "right":
                    both = both.withColumn(n, F.coalesce(F.col(n), F.lit(False)))
        hit = F.coalesce(F.col("_hit"), F.lit(False))
        if self.where is not None:
            hit = hit & F.coalesce(self.where.column, F.lit(False))
            if not self.flag:
                both = both.where(self.where.column)
        return both.select(*(e.column.alias(n) for n, e in self.outputs), *([hit.alias(self.flag)] if self.flag else []))
