"""Extensions: named packs of scalar and aggregate functions."""

from __future__ import annotations

import importlib.util
import pickle
from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import EngineError, TypeMismatch
from ..plans.expressions import AGGREGATES, Typed

#: Spark's names of the result types of user functions.
_RESULTS = {"int": "long", "real": "double", "text": "string", "vector": "array<double>"}


@dataclass(frozen=True)
class ScalarFunction:
    """``build`` makes a typed column of typed columns; None as ``most`` is any number."""

    name: str
    least: int
    most: int | None
    build: Callable[[list[Typed]], Typed]
    deterministic: bool = True
    description: str = ""


def vectorised(name: str, function: Callable[..., pd.Series], args: tuple[str, ...], result: str, deterministic: bool = True) -> ScalarFunction:
    """A scalar function of pandas Series; ``args`` are types, of which "number" and "any" are groups."""
    udf = F.pandas_udf(function, _RESULTS[result])
    udf = udf if deterministic else udf.asNondeterministic()

    def build(given: list[Typed]) -> Typed:
        for a, want in zip(given, args):
            fits = want == "any" or a.type in (want, "null") or want == "number" and a.type in ("int", "real")
            if not fits:
                raise TypeMismatch(f"{name} takes {want}, not {a.type}")
        return Typed(udf(*[a.column for a in given]), result)

    return ScalarFunction(name.upper(), len(args), len(args), build, deterministic)


@dataclass(frozen=True)
class AggregateFunction:
    """States are made by ``create``, fed by ``accumulate(state, *values)``, joined by ``merge`` and read by ``finalize``.

    With ``merge`` each partition makes a state of its rows, and only states
    are gathered; they are pickled on the way.  Without it all values are
    gathered in one task.
    """

    name: str
    arguments: int
    create: Callable[[], object]
    accumulate: Callable[..., object]
    finalize: Callable[[object], object]
    merge: Callable[[object, object], object] | None = None
    result: str = "real"

    def column(self, given: list[Typed], source: DataFrame) -> Column:
        """The aggregate of the rows of ``source``."""
        create, accumulate, finalize, merge = self.create, self.accumulate, self.finalize, self.merge

        def fold(batches):
            state = create()
            for batch in batches:
                for values in zip(*(c.to_pylist() for c in batch.columns)):
                    state = accumulate(state, *(None if v is None or v != v else v for v in values))
            return state

        def partial(batches):
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fold(batches))], pa.binary())], names=["state"])

        def join(batches):
            state = create()
            for batch in batches:
                for other in batch.column(0).to_pylist():
                    state = merge(state, pickle.loads(other))
            yield result(finalize(state))

        def whole(batches):
            yield result(finalize(fold(batches)))

        type_ = {"int": pa.int64(), "real": pa.float64(), "text": pa.string(), "vector": pa.list_(pa.float64())}[self.result]
        result = lambda value: pa.RecordBatch.from_arrays([pa.array([value], type_)], names=["value"])
        schema = f"value {_RESULTS[self.result]}"
        values = source.select(*[a.column.alias(f"a{i}") for i, a in enumerate(given)])
        if merge is None:
            return values.repartition(1).mapInArrow(whole, schema).scalar()
        return values.mapInArrow(partial, "state binary").repartition(1).mapInArrow(join, schema).scalar()


@dataclass
class Extension:
    name: str
    version: str
    scalar_functions: list[ScalarFunction] = field(default_factory=list)
    aggregate_functions: list[AggregateFunction] = field(default_factory=list)
    dependencies: tuple[str, ...] = ()
    on_load: Callable[[], None] = lambda: None
    on_unload: Callable[[], None] = lambda: None


class Registry:
    """Functions by name, and the extensions they come from."""

    def __init__(self):
        self.extensions: dict[str, Extension] = {}
        self.scalars: dict[str, ScalarFunction] = {}
        self.aggregates: dict[str, AggregateFunction] = {}

    def register(self, extension: Extension) -> None:
        if extension.name in self.extensions:
            raise EngineError(f"extension {extension.name} is already there")
        for needed in extension.dependencies:
            if needed not in self.extensions:
                raise EngineError(f"extension {extension.name} needs {needed}")
        names = [f.name.upper() for f in (*extension.scalar_functions, *extension.aggregate_functions)]
        for name in names:
            if name in self.scalars or name in self.aggregates or name in AGGREGATES or names.count(name) > 1:
                raise EngineError(f"function {name} is already there")
        extension.on_load()
        self.extensions[extension.name] = extension
        self.scalars |= {f.name.upper(): f for f in extension.scalar_functions}
        self.aggregates |= {f.name.upper(): f for f in extension.aggregate_functions}

    def unregister(self, name: str) -> None:
        extension = self.extensions.get(name)
        if extension is None:
            raise EngineError(f"no extension {name}")
        users = [e.name for e in self.extensions.values() if name in e.dependencies]
        if users:
            raise EngineError(f"extension {name} is needed by {', '.join(users)}")
        extension.on_unload()
        del self.extensions[name]
        for f in extension.scalar_functions:
            del self.scalars[f.name.upper()]
        for f in extension.aggregate_functions:
            del self.aggregates[f.name.upper()]

    def has_function(self, name: str) -> bool:
        return name.upper() in self.scalars or name.upper() in self.aggregates

    def has_aggregate(self, name: str) -> bool:
        return name.upper() in self.aggregates

    def call(self, name: str, args: list[Typed]) -> Typed:
        f = self.scalars.get(name.upper())
        if f is None:
            raise EngineError(f"unknown function {name}")
        if len(args) < f.least or f.most is not None and len(args) > f.most:
            raise EngineError(f"{name} takes {f.least}{'' if f.most == f.least else f' to {f.most}' if f.most else ' or more'} arguments, not {len(args)}")
        return f.build(args)

    def aggregate(self, name: str, args: list[Typed], source: DataFrame) -> Column:
        f = self.aggregates[name.upper()]
        if len(args) != f.arguments:
            raise EngineError(f"{name} takes {f.arguments} arguments, not {len(args)}")
        return f.column(args, source)


def load(name: str, path: str) -> Extension:
    """An extension from a Python file that has ``create_extension()``."""
    spec = importlib.util.spec_from_file_location(f"extension_{name}", path)
    if spec is None:
        raise EngineError(f"no Python file at {path}")
    module = importlib.util.module_from_spec(spec)
    try:
        spec.loader.exec_module(module)
    except OSError as error:
        raise EngineError(f"extension {name}: {error}") from error
    if not hasattr(module, "create_extension"):
        raise EngineError(f"{path} has no create_extension()")
    return module.create_extension()
