"""Built-in functions: vectors, text and numbers.

All are JVM expressions; null arguments give null.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import TypeMismatch
from ..plans.expressions import Typed
from .registry import Extension, ScalarFunction


def _all(name: str, args: list[Typed], *types: str) -> None:
    for a in args:
        if a.type not in (*types, "null"):
            raise TypeMismatch(f"{name} takes {' or '.join(types)}, not {a.type}")


def _real(x: Typed) -> Column:
    return x.column.cast("double")


# Vectors


def _vectors(name: str, args: list[Typed]) -> list[Column]:
    _all(name, args, "vector")
    sizes = {len(a.literal) for a in args if isinstance(a.literal, tuple)}
    if len(sizes) > 1:
        raise TypeMismatch(f"{name} takes vectors of one dimension")
    return [a.column.cast("array<double>") for a in args]


def _checked(a: Column, b: Column, out: Column) -> Column:
    unlike = F.raise_error(F.lit("vectors of unlike dimensions")).cast("double")
    return F.when(F.size(a) != F.size(b), unlike).otherwise(out)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def _not_zero(length: Column) -> Column:
    return F.when(length == 0, F.raise_error(F.lit("a zero vector has no direction")).cast("double")).otherwise(length)


def _vector_norm(x: Typed, column: Column) -> Column:
    """A literal's norm is a constant, not a fold for each row."""
    if isinstance(x.literal, tuple) and any(x.literal):
        return F.lit(math.sqrt(sum(float(v) * float(v) for v in x.literal)))
    return _not_zero(norm(column))


def _cosine(args):
    a, b = _vectors("COSINE_SIMILARITY", args)
    return Typed(_checked(a, b, dot(a, b) / (_vector_norm(args[0], a) * _vector_norm(args[1], b))), "real")


def _euclid(args):
    a, b = _vectors("EUCLIDEAN_DISTANCE", args)
    squares = F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    return Typed(_checked(a, b, F.sqrt(squares)), "real")


def _dot(args):
    a, b = _vectors("DOT_PRODUCT", args)
    return Typed(_checked(a, b, dot(a, b)), "real")


def _normalize(args):
    (a,) = _vectors("L2_NORMALIZE", args)
    length = _not_zero(norm(a))
    return Typed(F.transform(a, lambda x: x / length), "vector")


def cosine_similarity(a: list[float], b: list[float]) -> float:
    """The library function, which unlike the SQL one gives 0 for empty and zero vectors."""
    if len(a) != len(b):
        raise ValueError("vectors of unlike dimensions")
    lengths = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
    return sum(x * y for x, y in zip(a, b)) / lengths if lengths else 0.0


# Text


def _text(name, make, type_="text"):
    def build(args):
        _all(name, args, "text")
        return Typed(make(*[a.column.cast("string") for a in args]), type_)

    return build


def _substr(args):
    """From 1 in characters; start 0 is start 1, a negative start gives '', a negative length the rest."""
    _all("SUBSTR", args[:1], "text")
    _all("SUBSTR", args[1:], "int")
    text, start = args[0].column.cast("string"), args[1].column.cast("int")
    length = args[2].column.cast("int") if len(args) > 2 else F.length(text)
    length = F.when(length < 0, F.length(text)).otherwise(length)
    first = F.greatest(start, F.lit(1))
    known = text.isNotNull() & start.isNotNull() & length.isNotNull()
    return Typed(F.when(known, F.when(start < 0, F.lit("")).otherwise(F.substring(text, first, length))), "text")


def _concat(args):
    """Nulls are skipped; whole reals are written without a fraction."""
    parts = []
    for a in args:
        if a.type == "real":
            c = a.column
            parts.append(F.when((c == F.floor(c)) & (F.abs(c) < 1e15), c.cast("long").cast("string")).otherwise(c.cast("string")))
        elif a.type == "vector":
            parts.append(F.concat(F.lit("["), F.array_join(F.transform(a.column, lambda x: x.cast("string")), ", "), F.lit("]")))
        else:
            parts.append(a.column.cast("string"))
    return Typed(F.concat_ws("", *parts), "text")


# Numbers


def _number(name, make, type_=None):
    def build(args):
        _all(name, args, "int", "real")
        kinds = {a.type for a in args}
        return Typed(make(*args), type_ or ("real" if "real" in kinds else "int"))

    return build


def _round(args):
    """Half away from zero in binary: (x * 10^d) rounded, over 10^d."""
    _all("ROUND", args, "int", "real")
    scale = F.pow(F.lit(10.0), _real(args[1])) if len(args) > 1 else F.lit(1.0)
    scaled = F.abs(_real(args[0]) * scale)
    down = F.floor(scaled).cast("double")
    # Beyond 2^52 reals are whole.
    whole = F.when(scaled >= 4503599627370496.0, scaled).otherwise(down + F.when(scaled - down >= 0.5, 1.0).otherwise(0.0))
    return Typed(F.signum(_real(args[0])) * whole / scale, "real")


def _sqrt(x: Typed) -> Column:
    c = _real(x)
    return F.when(c < 0, F.raise_error(F.lit("square root of a negative number")).cast("double")).otherwise(F.sqrt(c))


def _mod(a: Typed, b: Typed) -> Column:
    from ..plans.expressions import arithmetic

    return arithmetic("%", a, b).column


VECTOR = Extension("vector", "1.0", [
    ScalarFunction("COSINE_SIMILARITY", 2, 2, _cosine),
    ScalarFunction("EUCLIDEAN_DISTANCE", 2, 2, _euclid),
    ScalarFunction("DOT_PRODUCT", 2, 2, _dot),
    ScalarFunction("L2_NORMALIZE", 1, 1, _normalize),
])

TEXT = Extension("text", "1.0", [
    ScalarFunction("UPPER", 1, 1, _text("UPPER", F.upper)),
    ScalarFunction("LOWER", 1, 1, _text("LOWER", F.lower)),
    ScalarFunction("LENGTH", 1, 1, _text("LENGTH", lambda x: F.length(x).cast("long"), "int")),
    ScalarFunction("TRIM", 1, 1, _text("TRIM", lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+\z", ""))),
    ScalarFunction("LTRIM", 1, 1, _text("LTRIM", lambda x: F.regexp_replace(x, r"(?U)^\s+", ""))),
    ScalarFunction("RTRIM", 1, 1, _text("RTRIM", lambda x: F.regexp_replace(x, r"(?U)\s+\z", ""))),
    ScalarFunction("SUBSTR", 2, 3, _substr),
    ScalarFunction("REPLACE", 3, 3, _text("REPLACE", F.replace)),
    ScalarFunction("CONCAT", 1, None, _concat),
    ScalarFunction("REVERSE", 1, 1, _text("REVERSE", F.reverse)),
])

MATH = Extension("math", "1.0", [
    ScalarFunction("ABS", 1, 1, _number("ABS", lambda x: F.abs(x.column.cast("double" if x.type == "real" else "long")))),
    ScalarFunction("CEIL", 1, 1, _number("CEIL", lambda x: F.ceil(x.column).cast("long"), "int")),
    ScalarFunction("FLOOR", 1, 1, _number("FLOOR", lambda x: F.floor(x.column).cast("long"), "int")),
    ScalarFunction("ROUND", 1, 2, _round),
    ScalarFunction("SQRT", 1, 1, _number("SQRT", _sqrt, "real")),
    ScalarFunction("POW", 2, 2, _number("POW", lambda a, b: F.pow(_real(a), _real(b)), "real")),
    ScalarFunction("MOD", 2, 2, _number("MOD", _mod)),
    ScalarFunction("SIGN", 1, 1, _number("SIGN", lambda x: F.signum(_real(x)).cast("long"), "int")),
])
