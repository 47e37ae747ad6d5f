"""Statements and expressions as parsed."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Literal:
    value: object  # int, float, str, None or a tuple of floats


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Param:
    index: int  # from 1


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple
    star: bool = False


@dataclass(frozen=True)
class Binary:
    op: str  # + - * / % = != < <= > >= and or
    left: object
    right: object


@dataclass(frozen=True)
class Like:
    value: object
    pattern: object


@dataclass(frozen=True)
class Between:
    value: object
    low: object
    high: object


@dataclass(frozen=True)
class IsNull:
    value: object
    negated: bool


@dataclass(frozen=True)
class Item:
    expr: object  # None stands for *
    alias: str | None = None


@dataclass(frozen=True)
class Order:
    expr: object
    descending: bool = False


@dataclass(frozen=True)
class Select:
    items: tuple[Item, ...]
    table: str | None
    where: object = None
    order: tuple[Order, ...] = ()
    limit: object = None


@dataclass(frozen=True)
class Insert:
    table: str
    columns: tuple[str, ...]
    rows: tuple[tuple, ...]


@dataclass(frozen=True)
class Update:
    table: str
    sets: tuple[tuple[str, object], ...]
    where: object = None


@dataclass(frozen=True)
class Delete:
    table: str
    where: object = None


@dataclass(frozen=True)
class Column:
    name: str
    type: str  # INTEGER, REAL, TEXT or VECTOR; OTHER for columns of outside tables
    size: int | None = None
    primary_key: bool = False
    not_null: bool = False
    unique: bool = False


@dataclass(frozen=True)
class CreateTable:
    table: str
    columns: tuple[Column, ...]


@dataclass(frozen=True)
class DropTable:
    table: str
    if_exists: bool = False


@dataclass(frozen=True)
class CreateIndex:
    name: str
    table: str
    column: str
    unique: bool = False
    kind: str | None = None


@dataclass(frozen=True)
class DropIndex:
    name: str
    if_exists: bool = False


@dataclass(frozen=True)
class CreateExtension:
    name: str
    path: str | None = None


@dataclass(frozen=True)
class DropExtension:
    name: str


@dataclass(frozen=True)
class Transaction:
    action: str  # begin, commit, rollback


def children(node) -> list:
    """Expressions directly below an expression."""
    if isinstance(node, Call):
        return list(node.args)
    if isinstance(node, Binary):
        return [node.left, node.right]
    if isinstance(node, Like):
        return [node.value, node.pattern]
    if isinstance(node, Between):
        return [node.value, node.low, node.high]
    if isinstance(node, IsNull):
        return [node.value]
    return []


def parameters(statement) -> int:
    """The highest parameter number of a statement."""
    if isinstance(statement, Param):
        return statement.index
    if isinstance(statement, (tuple, list)):
        return max(map(parameters, statement), default=0)
    fields = getattr(statement, "__dataclass_fields__", {})
    return max((parameters(getattr(statement, f)) for f in fields), default=0)


__all__ = [n for n in globals() if n[0].isupper()] + ["children", "field", "parameters"]
