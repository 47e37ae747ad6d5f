"""INSERT, UPDATE and DELETE as new parts of a table.

An insert adds a part.  Updates and deletes rewrite only the parts that hold
rows they match.  Everything is checked before a state is given back, so a
statement that fails changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ConstraintError, EngineError, TypeMismatch
from ..plans import ast
from ..plans.expressions import Compiler, Typed
from ..sources.storage import Storage, schema_of

_WANTED = {"INTEGER": ("int",), "REAL": ("int", "real"), "TEXT": ("text",), "VECTOR": ("vector",)}
#: Keys that are looked up by an IN list, which reaches the scan.
_FEW_KEYS = 1000


def insert(storage: Storage, state: dict, registry, statement: ast.Insert, params: tuple) -> int:
    columns = storage.columns(state, statement.table)
    by_name = {c.name.lower(): c for c in columns}
    names = [n.lower() for n in statement.columns] or [c.name.lower() for c in columns]
    for n in names:
        if n not in by_name:
            raise EngineError(f"unknown column {n}")
    if len(set(names)) < len(names):
        raise EngineError("a column is named twice")
    compile_ = Compiler(registry, None, params)
    constants = all(isinstance(v, (ast.Literal, ast.Param)) for row in statement.rows for v in row)
    rows, made = [], []
    for row in statement.rows:
        if len(row) != len(names):
            raise EngineError(f"{len(row)} values for {len(names)} columns")
        typed = {n: compile_(v) for n, v in zip(names, row)}
        for n, t in typed.items():
            _fits(by_name[n], t)
        if constants:
            given = {n: compile_.value(v) for n, v in zip(names, row)}
            rows.append(tuple(_plain(c, given.get(c.name.lower())) for c in columns))
        else:
            made.append(F.struct(*[_stored(c, typed.get(c.name.lower())).alias(c.name) for c in columns]))
    if constants:
        new = storage.spark.createDataFrame(rows, schema_of(columns))
    else:
        new = storage.spark.range(1).select(F.inline(F.array(*made)))
    return add_rows(storage, state, statement.table, new)


def _plain(column: ast.Column, value):
    if value is None:
        return None
    return float(value) if column.type == "REAL" else list(map(float, value)) if column.type == "VECTOR" else value


def add_rows(storage: Storage, state: dict, table: str, new: DataFrame) -> int:
    """Append rows of the table's columns, checked against it and each other; returns their number."""
    columns = storage.columns(state, table)
    part = storage.write_part(state, table, new)
    try:
        written = storage.read(state, table, [part])
        count = _check_rows(columns, written)
        for name in _unique(state, table, columns):
            _check_unique(storage, state, table, name, written, state["tables"][table]["parts"])
    except Exception:
        storage.files.delete(f"{storage.path}/{part}")
        raise
    state["tables"][table]["parts"].append(part)
    return count


def update(storage: Storage, state: dict, registry, statement: ast.Update, params: tuple) -> int:
    table, columns = statement.table, storage.columns(state, statement.table)
    by_name = {c.name.lower(): c for c in columns}
    before = storage.read(state, table)
    where = _where(registry, before, statement.where, params)
    parts, count = _touched(storage, state, table, where)
    if not count:
        _compile_sets(registry, before, statement, by_name, params)
        return 0
    rows = storage.read(state, table, parts).withColumn("_hit", F.coalesce(where, F.lit(False)))
    # Assignments go from left to right, each seeing those before it.
    for name, expr in statement.sets:
        column = _column(by_name, name)
        typed = Compiler(registry, rows, params)(expr)
        _fits(column, typed)
        rows = rows.withColumn(column.name, F.when(F.col("_hit"), _stored(column, typed)).otherwise(F.col(f"`{column.name}`")))
    part = storage.write_part(state, table, rows.drop("_hit"))
    rest = [p for p in state["tables"][table]["parts"] if p not in parts]
    try:
        written = storage.read(state, table, [part])
        _check_rows(columns, written)
        changed = {n.lower() for n, _ in statement.sets}
        for name in _unique(state, table, columns):
            if name.lower() in changed:
                _check_unique(storage, state, table, name, written, rest)
    except Exception:
        storage.files.delete(f"{storage.path}/{part}")
        raise
    state["tables"][table]["parts"] = [*rest, part]
    return count


def delete(storage: Storage, state: dict, registry, statement: ast.Delete, params: tuple) -> int:
    table = statement.table
    where = _where(registry, storage.read(state, table), statement.where, params)
    parts, count = _touched(storage, state, table, where)
    if count:
        rest = [p for p in state["tables"][table]["parts"] if p not in parts]
        kept = storage.read(state, table, parts).where(~F.coalesce(where, F.lit(False)))
        state["tables"][table]["parts"] = [*rest, storage.write_part(state, table, kept)]
    return count


def check_unique_column(storage: Storage, state: dict, table: str, name: str) -> None:
    rows = storage.read(state, table)
    if not rows.where(F.col(f"`{name}`").isNotNull()).groupBy(f"`{name}`").count().where("count > 1").isEmpty():
        raise ConstraintError(f"{table}.{name} has repeated values")


def _where(registry, rows: DataFrame, where, params):
    return F.lit(True) if where is None else Compiler(registry, rows, params)(where).column


def _compile_sets(registry, rows, statement, by_name, params) -> None:
    for name, expr in statement.sets:
        _fits(_column(by_name, name), Compiler(registry, rows, params)(expr))


def _column(by_name, name: str) -> ast.Column:
    if name.lower() not in by_name:
        raise EngineError(f"unknown column {name}")
    return by_name[name.lower()]


def _touched(storage: Storage, state: dict, table: str, where) -> tuple[list[str], int]:
    """The parts that hold rows to change, and the number of such rows: a count for each part."""
    parts = state["tables"][table]["parts"]
    if not parts:
        return [], 0
    of_part = F.element_at(F.split(F.input_file_name(), "/"), -2)
    found = storage.read(state, table).where(where).groupBy(of_part.alias("part")).count().collect()
    hit = {r["part"]: r["count"] for r in found}
    return [p for p in parts if p.rpartition("/")[2] in hit], sum(hit.values())


def _fits(column: ast.Column, value: Typed) -> None:
    if value.type != "null" and value.type not in _WANTED[column.type]:
        raise TypeMismatch(f"{column.name} is {column.type}, not {value.type}")


def _stored(column: ast.Column, value: Typed | None):
    to = {"INTEGER": "long", "REAL": "double", "TEXT": "string", "VECTOR": "array<double>"}[column.type]
    return (F.lit(None) if value is None else value.column).cast(to)


def _unique(state: dict, table: str, columns: list[ast.Column]) -> list[str]:
    indexed = {i["column"].lower() for i in state["indexes"].values() if i["table"] == table and i["unique"]}
    return [c.name for c in columns if c.primary_key or c.unique or c.name.lower() in indexed]


def _check_rows(columns: list[ast.Column], rows: DataFrame) -> int:
    """Nulls, lengths and dimensions in one pass; returns the number of rows."""
    checks = {}
    for c in columns:
        col = F.col(f"`{c.name}`")
        if c.primary_key or c.not_null:
            checks[f"{c.name} must not be NULL"] = col.isNull()
        if c.type == "TEXT":
            checks[f"{c.name} is longer than {c.size} bytes"] = F.octet_length(col) > c.size
        if c.type == "VECTOR":
            checks[f"{c.name} has another dimension than {c.size}"] = F.size(col) != c.size
    found = rows.agg(F.count(F.lit(1)), *[F.count(F.when(bad, 1)) for bad in checks.values()]).first()
    for message, bad in zip(checks, found[1:]):
        if bad:
            raise ConstraintError(message)
    return found[0]


def _check_unique(storage: Storage, state: dict, table: str, name: str, rows: DataFrame, parts: list[str]) -> None:
    column = F.col(f"`{name}`")
    keys = rows.where(column.isNotNull()).groupBy(column.alias("k")).count()
    if not keys.where("count > 1").isEmpty():
        raise ConstraintError(f"{table}.{name} would be repeated")
    if not parts:
        return
    there = storage.read(state, table, parts).select(column.alias("k"))
    few = keys.select("k").limit(_FEW_KEYS + 1).collect()
    if len(few) <= _FEW_KEYS and not isinstance(keys.schema["k"].dataType, T.ArrayType):
        clash = there.where(F.col("k").isin([r["k"] for r in few]))
    else:
        clash = there.join(keys.select("k"), "k", "left_semi")
    if not clash.isEmpty():
        raise ConstraintError(f"{table}.{name} would be repeated")
