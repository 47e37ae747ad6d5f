"""Expressions as Spark columns, directed by the types of their operands."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import EngineError, TypeMismatch
from . import ast

AGGREGATES = frozenset({"COUNT", "SUM", "AVG", "MIN", "MAX"})


@dataclass(frozen=True)
class Typed:
    """A column and its type: int, real, text, vector, null, bool or other."""

    column: Column
    type: str
    literal: object = None


def type_of(spark_type: T.DataType) -> str:
    if isinstance(spark_type, T.IntegralType):
        return "int"
    if isinstance(spark_type, (T.DoubleType, T.FloatType)):
        return "real"
    if isinstance(spark_type, T.StringType):
        return "text"
    if isinstance(spark_type, T.ArrayType) and isinstance(spark_type.elementType, (T.DoubleType, T.FloatType)):
        return "vector"
    if isinstance(spark_type, T.NullType):
        return "null"
    return "bool" if isinstance(spark_type, T.BooleanType) else "other"


def literal(value) -> Typed:
    if value is None:
        return Typed(F.lit(None), "null", None)
    if isinstance(value, bool):
        raise TypeMismatch("there is no boolean type")
    if isinstance(value, int):
        return Typed(F.lit(value).cast("long"), "int", value)
    if isinstance(value, float):
        return Typed(F.lit(value), "real", value)
    if isinstance(value, str):
        return Typed(F.lit(value), "text", value)
    if isinstance(value, (tuple, list)):
        return Typed(F.array(*[F.lit(float(x)) for x in value]).cast("array<double>"), "vector", tuple(value))
    raise TypeMismatch(f"no type for {value!r}")


class Compiler:
    """Compiles expressions over the columns of a table (or of none)."""

    def __init__(self, registry, table: DataFrame | None = None, params: tuple = ()):
        self.registry, self.params = registry, params
        self.fields = {f.name.lower(): f for f in table.schema.fields} if table is not None else {}

    def __call__(self, node) -> Typed:
        return getattr(self, f"_{type(node).__name__.lower()}")(node)

    def value(self, node):
        """The constant that a literal or parameter is."""
        if isinstance(node, ast.Literal):
            return node.value
        if isinstance(node, ast.Param):
            return self._bound(node)
        raise EngineError("a constant is needed here")

    def _bound(self, node: ast.Param):
        if node.index > len(self.params):
            raise EngineError(f"no value for parameter ?{node.index}")
        return self.params[node.index - 1]

    def _literal(self, node):
        return literal(node.value)

    def _param(self, node):
        return literal(self._bound(node))

    def _name(self, node):
        field = self.fields.get(node.name.lower())
        if field is None:
            raise EngineError(f"unknown column {node.name}")
        return Typed(F.col(f"`{field.name}`"), type_of(field.dataType))

    def _call(self, node):
        if node.name in AGGREGATES:
            raise EngineError(f"{node.name} is only allowed as an item of a SELECT list")
        return self.registry.call(node.name, [self(a) for a in node.args])

    def _binary(self, node):
        if node.op in ("and", "or"):
            left, right = self(node.left).column, self(node.right).column
            return Typed(left & right if node.op == "and" else left | right, "bool")
        left, right = self(node.left), self(node.right)
        if node.op in ("+", "-", "*", "/", "%"):
            return arithmetic(node.op, left, right)
        return Typed(compare(node.op, left, right), "bool")

    def _like(self, node):
        pattern = self.value(node.pattern)
        value = self(node.value)
        if pattern is None or value.type == "null":
            return Typed(F.lit(None).cast("boolean"), "bool")
        if value.type != "text" or not isinstance(pattern, str):
            raise TypeMismatch("LIKE compares texts")
        return Typed(like(value.column, pattern), "bool")

    def _between(self, node):
        value, low, high = self(node.value), self(node.low), self(node.high)
        return Typed(compare(">=", value, low) & compare("<=", value, high), "bool")

    def _isnull(self, node):
        column = self(node.value).column
        return Typed(column.isNotNull() if node.negated else column.isNull(), "bool")


def like(value: Column, pattern: str) -> Column:
    """Only a % at either end is a wildcard; % elsewhere and _ stand for themselves."""
    if pattern == "%":
        return value.isNotNull()
    start, end = pattern.startswith("%"), pattern.endswith("%") and len(pattern) > 1
    body = pattern[start : len(pattern) - end]
    if start and end:
        return value.contains(body)
    if end:
        return value.startswith(body)
    return value.endswith(body) if start else value == F.lit(body)


def arithmetic(op: str, left: Typed, right: Typed) -> Typed:
    types = {left.type, right.type}
    if op == "+" and "text" in types and types <= {"text", "null"}:
        return Typed(F.concat(left.column.cast("string"), right.column.cast("string")), "text")
    if not types <= {"int", "real", "null"}:
        raise TypeMismatch(f"{left.type} {op} {right.type} has no meaning")
    whole = "real" not in types
    a, b = (x.column.cast("long" if whole else "double") for x in (left, right))
    if op == "+":
        out = a + b
    elif op == "-":
        out = a - b
    elif op == "*":
        out = a * b
    else:
        # A zero divisor raises for reals too, and only for rows that get here.
        safe = F.when(b == 0, F.raise_error(F.lit("division by zero")).cast("long" if whole else "double")).otherwise(b)
        out = a % safe if op == "%" else F.call_function("div", a, safe) if whole else a / safe
    return Typed(out, "null" if types == {"null"} else "int" if whole else "real")


def compare(op: str, left: Typed, right: Typed) -> Column:
    """Numbers with numbers, otherwise like with like; values of unlike types are unequal and in no order."""
    group = lambda t: "number" if t in ("int", "real") else t
    a, b = left.column, right.column
    if "null" not in (left.type, right.type) and group(left.type) != group(right.type) and "other" not in (left.type, right.type):
        known = F.when(a.isNotNull() & b.isNotNull(), F.lit(op == "!="))
        return known
    if "real" in (left.type, right.type) and left.type != right.type and "null" not in (left.type, right.type):
        # A whole number beside a real column is compared as a real, so the column is left bare for pushdown.
        a, b = a.cast("double") if left.type == "int" else a, b.cast("double") if right.type == "int" else b
    return {"=": a == b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]
