"""SELECT as a DataFrame.

The plan is declared and left to Catalyst: filters and columns reach the scan,
and ORDER BY with LIMIT becomes a top-k.  Two things are settled here, as Spark
has no order of rows: a LIMIT without ORDER BY takes the smallest keys, and the
key breaks ties of ORDER BY.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import EngineError
from . import ast
from .expressions import AGGREGATES, Compiler, Typed


def plan_select(spark: SparkSession, registry, select: ast.Select, table: DataFrame | None, key: str | None, params: tuple = ()) -> DataFrame:
    """The result of ``select`` over ``table``, whose primary key is ``key`` if it has one."""
    compile_ = Compiler(registry, table, params)
    source = table if table is not None else spark.range(1)
    if table is None and any(i.expr is None for i in select.items):
        raise EngineError("* needs a table")
    if select.where is not None:
        source = source.where(compile_(select.where).column)
    limit = None if select.limit is None else compile_.value(select.limit)
    if limit is not None and (not isinstance(limit, int) or limit < 0):
        raise EngineError("LIMIT needs a whole number")
    if any(i.expr is not None and _aggregate(registry, i.expr) for i in select.items):
        out = _aggregated(registry, compile_, select, source, key)
        return out if limit is None else out.limit(limit)

    items = []
    for position, item in enumerate(select.items):
        if item.expr is None:
            items += [(f.name, F.col(f"`{f.name}`")) for f in table.schema.fields]
        else:
            items.append((_label(item, position), compile_(item.expr).column))
    if table is None:
        return source.select(*[c.alias(n) for n, c in items]) if limit is None else source.select(*[c.alias(n) for n, c in items]).limit(limit)

    labels = {i.alias.lower(): i.expr for i in select.items if i.alias}
    keys = []
    for order in select.order:
        expr = order.expr
        # A column of the table goes before an alias of the same name.
        if isinstance(expr, ast.Name) and expr.name.lower() not in compile_.fields:
            expr = labels.get(expr.name.lower(), expr)
        column = compile_(expr).column
        keys.append(column.desc_nulls_last() if order.descending else column.asc_nulls_first())
    if keys or limit is not None:
        if key:
            keys.append(F.col(f"`{key}`").asc())
        elif not keys:
            raise EngineError("LIMIT on a table without primary key needs ORDER BY")
    # Rows are ordered before the projection, since keys need not be selected.
    if keys:
        source = source.orderBy(*keys)
    if limit is not None:
        source = source.limit(limit)
    return source.select(*[c.alias(n) for n, c in items])


def _label(item: ast.Item, position: int) -> str:
    if item.alias:
        return item.alias
    return item.expr.name if isinstance(item.expr, ast.Name) else f"expr_{position}"


def _aggregate(registry, expr) -> bool:
    """Whether an aggregate stands anywhere in an expression."""
    if isinstance(expr, ast.Call) and (expr.name in AGGREGATES or registry.has_aggregate(expr.name)):
        return True
    return any(_aggregate(registry, c) for c in ast.children(expr))


class _Folding(Compiler):
    """Compiles items of an aggregation: plain columns are those of the row with the smallest key."""

    def __init__(self, rows: Compiler, key: str | None, source: DataFrame):
        self.rows, self.key, self.source = rows, key, source
        self.registry, self.params, self.fields = rows.registry, rows.params, rows.fields

    def _name(self, node):
        if self.key is None:
            raise EngineError("a plain column beside an aggregate needs a primary key")
        value = self.rows(node)
        return Typed(F.min_by(value.column, F.col(f"`{self.key}`")), value.type)

    def _call(self, node):
        if node.name in AGGREGATES or self.registry.has_aggregate(node.name):
            return _fold(self.registry, self.rows, node, self.source)
        return super()._call(node)


def _aggregated(registry, compile_: Compiler, select: ast.Select, source: DataFrame, key: str | None) -> DataFrame:
    """One row; ORDER BY has no effect on it."""
    if any(i.expr is None for i in select.items):
        raise EngineError("* beside an aggregate")
    fold = _Folding(compile_, key, source)
    return source.agg(*[fold(i.expr).column.alias(_label(i, position)) for position, i in enumerate(select.items)])


def _fold(registry, compile_: Compiler, call: ast.Call, source: DataFrame) -> Typed:
    if call.star:
        if call.name != "COUNT":
            raise EngineError(f"{call.name}(*) has no meaning")
        return Typed(F.count(F.lit(1)), "int")
    args: list[Typed] = [compile_(a) for a in call.args]
    if registry.has_aggregate(call.name):
        return Typed(registry.aggregate(call.name, args, source), registry.aggregates[call.name].result)
    if len(args) != 1:
        raise EngineError(f"{call.name} takes one argument")
    value = args[0]
    if call.name == "COUNT":
        return Typed(F.count(value.column), "int")
    if call.name in ("SUM", "AVG"):
        # What is no number is skipped, and sums are real.
        column = value.column.cast("double") if value.type in ("int", "real", "null") else F.lit(None).cast("double")
        return Typed(F.sum(column) if call.name == "SUM" else F.avg(column), "real")
    return Typed(F.min(value.column) if call.name == "MIN" else F.max(value.column), value.type)
