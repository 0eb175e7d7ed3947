"""The Python path: an operator and its handlers run row by row in Arrow-fed workers.

Used where a function can't be an expression.  The worker sees whole batches, calls
the function as the expression path would, and returns values, or the raised class as data.
"""

from __future__ import annotations

import ast
import enum
import functools
import itertools
import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyspark.sql.pandas.types import to_arrow_type

from rowsmith import errors
from rowsmith import types as ty
from rowsmith.plans.source import Udf
from rowsmith.types import Ty



class Signal(enum.Enum):
    """Pickles by name, so that it stays itself in a worker."""

    DROP = 0


DROP = Signal.DROP


class PyRow(tuple):
    """A row that can be read by position or by column name. Rows of the same columns are of one class, which knows the names' places."""

    __slots__ = ()
    names: tuple = ()
    places: dict = {}  # noqa: RUF012

    def __getitem__(self, key: Any) -> Any:
        return _at(self, self.places[key] if isinstance(key, str) else key)

    def __reduce__(self) -> tuple:
        return (tuple, (tuple(self),))

    def keys(self) -> list:
        return list(self.names)


_at = tuple.__getitem__


@functools.lru_cache(64)
def row_class(names: tuple) -> type[PyRow]:
    places = {n: i for i, n in reversed(list(enumerate(names)))}
    return type("PyRow", (PyRow,), {"__slots__": (), "names": names, "places": places})


@dataclass
class Handler:
    """``resolve`` (a function) or ``ignore`` (none) for a class."""

    cls: type
    function: Callable | None
    udf: Udf | None = None


@dataclass
class Group:
    """One operator with its handlers. kind: map, filter, column (value of the row) or cell (value of one cell)."""

    kind: str
    function: Callable
    by_name: bool
    cell: int | None
    handlers: list[tuple[type, Callable | None]] = field(default_factory=list)

    def caller(self, f: Callable, names: list) -> Callable[[tuple], Any]:
        """The function as one of a row of values; how it takes them is settled once."""
        if (at := self.cell) is not None:
            return lambda row: f(row[at])
        if getattr(getattr(f, "__code__", None), "co_argcount", 1) != 1:
            return lambda row: f(*row)
        if len(names) == 1 and not self.by_name:
            return lambda row: f(row[0])
        kind = row_class(tuple(names))
        return lambda row: f(kind(row))

    def bound(self, names: list) -> Callable[[tuple], tuple[Any, str | None]]:
        """A function from a row to (value, error); DROP where the row is ignored. Of an exception its class alone is kept, so that no row stays behind in a traceback."""
        main, handlers = self.caller(self.function, names), [(cls, None if f is None else self.caller(f, names)) for cls, f in self.handlers]

        def run(row: tuple) -> tuple[Any, str | None]:
            try:
                return main(row), None
            except Exception as e:
                raised = type(e)
            for cls, f in handlers:
                if issubclass(raised, cls):
                    if f is None:
                        return DROP, None
                    try:
                        return f(row), None
                    except Exception as e:
                        raised = type(e)
            return None, errors.chain(raised)

        return run


def reads_by_name(udf: Udf, name: str | None) -> bool:
    """Whether a one-parameter function subscripts its row with the only column's name."""
    if not udf.params or len(udf.params) != 1 or udf.body is None or name is None:
        return False
    return any(
        isinstance(n, ast.Subscript) and isinstance(n.value, ast.Name) and n.value.id == udf.params[0] and isinstance(n.slice, ast.Constant) and n.slice.value == name
        for b in udf.body
        for n in ast.walk(b)
    )


def flatten(value: Any) -> tuple[tuple, list[str | None]]:
    """A map's result as columns: a dict with string keys names them, a tuple spreads."""
    if isinstance(value, dict) and value and all(isinstance(k, str) for k in value):
        return tuple(value.values()), list(value)
    if isinstance(value, tuple):
        return tuple(value), [None] * len(value)
    return (value,), [None]


def inexact(v: Any) -> bool:
    """Whether a value holds an integer that no float column holds exactly."""
    if isinstance(v, int):
        return abs(v) > 1 << 53
    if isinstance(v, dict):
        return any(map(inexact, v)) or any(map(inexact, v.values()))
    return isinstance(v, tuple | list) and any(map(inexact, v))


def holds_float(t: Ty) -> bool:
    return t == "f64" or (isinstance(t, tuple) and any(map(holds_float, t[1:])))


#: Plain values by their class, and classes by type.
PLAIN = {type(None): "null", bool: "bool", int: "i64", float: "f64", str: "str"}
CLASSES = {t: c for c, t in PLAIN.items() if t != "null"}


def cells(column: pa.Array, t: Ty) -> list:
    """A column as the Python values it stands for; plain ones are taken from its buffers at once."""
    kind = column.type
    if pa.types.is_string(kind) or pa.types.is_large_string(kind):
        out = column.to_numpy(zero_copy_only=False).tolist()
    elif pa.types.is_boolean(kind) or pa.types.is_integer(kind) or pa.types.is_float64(kind):
        if not column.null_count:
            out = column.to_numpy(zero_copy_only=False).tolist()
        else:
            out = column.fill_null(False if pa.types.is_boolean(kind) else 0).to_numpy(zero_copy_only=False).tolist()
            for i in column.is_null().to_numpy(zero_copy_only=False).nonzero()[0].tolist():
                out[i] = None
    else:
        out = column.to_pylist()
    return out if t == "null" or ty.base(t) in CLASSES else [ty.decode(v, t) for v in out]


def rows_of(batch: pa.RecordBatch, inputs: list[str], types: list[Ty], has_err: bool) -> tuple[Iterator[tuple], list | None]:
    """The rows of a batch, and their earlier errors if there are any."""
    rows = zip(*(cells(batch.column(batch.schema.get_field_index(c)), t) for c, t in zip(inputs, types, strict=True)), strict=True) if inputs else itertools.repeat((), batch.num_rows)
    err = batch.column(batch.schema.get_field_index("_err")) if has_err else None
    return rows, None if err is None or err.null_count == len(err) else cells(err, "str")


def columns_of(values: list, spread: bool, name: str | None) -> tuple[tuple, list] | None:
    """Results of one shape as (names, columns), what flatten gives of each; None for others."""
    kinds = set(map(type, values)) if spread else ()
    if kinds == {dict}:
        shapes = set(map(tuple, values))
        names = shapes.pop()
        return (names, list(zip(*map(dict.values, values), strict=True))) if not shapes and names and all(isinstance(k, str) for k in names) else None
    if kinds and all(issubclass(k, tuple) for k in kinds):
        widths = set(map(len, values))
        return ((None,) * len(values[0]), list(zip(*values, strict=True))) if len(widths) == 1 and 0 not in widths else None
    return None if any(issubclass(k, tuple | dict) for k in kinds) else ((name,), [values])


def within(ints: Any, low: int, high: int) -> bool:
    return low <= min(ints) and max(ints) <= high


def plain_type(column: Any, upcast: bool) -> tuple[Ty, bool] | None:
    """The common type of plain values and whether one is inexact; None if there are others, or integers beyond 64 bits."""
    kinds, wide = set(map(type, column)), False
    if not kinds <= PLAIN.keys():
        return None
    if int in kinds:
        ints = column if len(kinds) == 1 else [v for v in column if type(v) is int]
        if not within(ints, -(1 << 63), (1 << 63) - 1):
            return None
        wide = not within(ints, -(1 << 53), 1 << 53)
    return ty.unify_all([PLAIN[k] for k in kinds], upcast), wide


def encoded(column: Any, t: Ty) -> Any:
    """A column's values as Arrow takes them, None if one doesn't fit."""
    kinds = set(map(type, column))
    given = column
    if type(None) in kinds and ty.nullable(t):
        kinds.discard(type(None))
        given = [v for v in column if v is not None]
    if t != "pyobj" and kinds <= {CLASSES.get(ty.base(t))} and (int not in kinds or within(given, -(1 << 63), (1 << 63) - 1)):
        return column
    return [ty.encode(v, t) for v in column] if all(ty.fits(v, t) for v in column) else None


class Seen:
    """The shapes and types of results. shapes: (count, names) to the columns' types and whether one is inexact; two shapes are as good as more."""

    def __init__(self, upcast: bool):
        self.upcast, self.shapes = upcast, {}

    def add(self, shape: tuple, types: list[Ty], wide: list[bool]) -> None:
        if shape not in self.shapes:
            if len(self.shapes) < 2:
                self.shapes[shape] = (types, wide)
            return
        old, was = self.shapes[shape]
        self.shapes[shape] = ([x if x == y else ty.unify_all([x, y], self.upcast) for x, y in zip(old, types, strict=True)], [a or b for a, b in zip(was, wide, strict=True)])

    def value(self, value: Any, spread: bool, name: str | None) -> None:
        parts, names = flatten(value) if spread else ((value,), [name])
        if not too_large(parts):
            self.add((len(parts), tuple(names)), [ty.of_value(p) for p in parts], [inexact(p) for p in parts])

    def values(self, values: list, spread: bool, name: str | None) -> None:
        """Results at once where they are plain and of one shape, else one by one."""
        found = columns_of(values, spread, name) if values else None
        plain = [plain_type(c, self.upcast) for c in found[1]] if found else [None]
        if None not in plain:
            self.add((len(plain), found[0]), [t for t, _ in plain], [w for _, w in plain])
            return
        for v in values:
            self.value(v, spread, name)

    def merge(self, other: Seen) -> None:
        for shape, (types, wide) in other.shapes.items():
            self.add(shape, types, wide)

    def columns(self) -> tuple[list[Ty], list[str | None], bool] | None:
        """(nullable types or pickles, names, whether values are spread), None if there was no result; several shapes are one column of pickles."""
        if not self.shapes:
            return None
        if len(self.shapes) > 1:
            return ["pyobj"], [None], False
        ((_, names), (types, wide)), *_ = self.shapes.items()
        return ["pyobj" if t in ("pyobj", "null") or (w and holds_float(t)) else ty.opt(t) for t, w in zip(types, wide, strict=True)], list(names), True


def seen_by(df: Any, each: Callable[[pa.RecordBatch], Iterator[list]], spread: bool, name: str | None, upcast: bool, before: Callable | None = None) -> Seen:
    """What ``each`` gives over all rows, as lists of results: every partition sends one small record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Seen(upcast)
        for batch in batches:
            for values in each(batch):
                seen.values(values, spread, name)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(seen)], pa.binary())], names=["seen"])

    out = Seen(upcast)
    for r in df.mapInArrow(after(before, run), "seen binary").collect():
        out.merge(pickle.loads(r.seen))
    return out


def after(before: Callable | None, run: Callable) -> Callable:
    """Two mapInArrow functions as one, so that batches stay in the worker between them."""
    return run if before is None else lambda batches: run(before(batches))


def results(group: Group, names: list, types: list[Ty], inputs: list[str], has_err: bool) -> Callable[[pa.RecordBatch], Iterator[list]]:
    """The good results of an operator over a batch."""

    def each(batch: pa.RecordBatch) -> Iterator[list]:
        rows, prior = rows_of(batch, inputs, types, has_err)
        found = map(group.bound(names), rows if prior is None else (row for row, p in zip(rows, prior, strict=True) if p is None))
        yield [value for value, error in found if error is None and value is not DROP]

    return each


def too_large(v: Any) -> bool:
    """Whether a value holds an integer beyond 64 bits, which no column does."""
    if isinstance(v, int):
        return not -(1 << 63) <= v < 1 << 63
    if isinstance(v, dict):
        return any(map(too_large, v)) or any(map(too_large, v.values()))
    return isinstance(v, tuple | list) and any(map(too_large, v))


def apart(values: list, failed: list[str | None], types: list[Ty], spread: bool) -> tuple[list[list], list[str | None]]:
    """Columns and errors of a batch, row by row: results that no column of their types holds are set aside."""
    made, errs, good = [[] for _ in types], [], iter(values)
    for error in failed:
        parts: tuple = ()
        if error is None:
            value = next(good)
            parts = flatten(value)[0] if spread else (value,)
            if len(parts) != len(types) or not all(map(ty.fits, parts, types)):
                error = errors.chain(OverflowError if any(map(too_large, parts)) else TypeError)
        errs.append(error)
        for k, t in enumerate(types):
            made[k].append(None if error is not None else ty.encode(parts[k], t))
    return made, errs


def filled(column: Any, failed: list[str | None]) -> Any:
    """A column of the good rows' values, with None at the others."""
    if len(column) == len(failed):
        return column
    good = iter(column)
    return [next(good) if error is None else None for error in failed]


def worker(group: Group, names: list, types: list[Ty], inputs: list[str], out: list[str], out_types: list[Ty], carried: list[str], schema: pa.Schema, has_err: bool, spread: bool = True):
    """A mapInArrow function from (inputs, carried, _err) to (carried, out, _err)."""
    spread, is_filter = spread and group.kind == "map", group.kind == "filter"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        call = group.bound(names)
        for batch in batches:
            rows, prior = rows_of(batch, inputs, types, has_err)
            keep, values, failed = [], [], []
            for i, row in enumerate(rows):
                if prior is not None and prior[i] is not None:
                    keep.append(i)
                    failed.append(prior[i])
                    continue
                value, error = call(row)
                if value is DROP or (is_filter and error is None and not value):
                    continue
                keep.append(i)
                failed.append(error)
                if error is None:
                    values.append(value)
            made: list = []
            if not is_filter:
                found = columns_of(values, spread, None) if values else ((), [()] * len(out))
                made = [encoded(c, t) for c, t in zip(found[1], out_types, strict=True)] if found and len(found[1]) == len(out) else [None]
                if any(c is None for c in made):
                    made, failed = apart(values, failed, out_types, spread)
                else:
                    made = [filled(c, failed) for c in made]
            arrays = [batch.column(batch.schema.get_field_index(c)) for c in carried]
            if len(keep) < batch.num_rows:
                index = pa.array(keep, pa.int64())
                arrays = [a.take(index) for a in arrays]
            arrays += [pa.array(v, schema.field(c).type) for v, c in zip(made, out, strict=True)]
            arrays.append(pa.array(failed, pa.string()))
            yield pa.RecordBatch.from_arrays([a.cast(f.type) if a.type != f.type else a for a, f in zip(arrays, schema, strict=True)], schema=schema)

    return run


def arrow_schema(spark_schema) -> pa.Schema:
    return pa.schema([pa.field(f.name, to_arrow_type(f.dataType)) for f in spark_schema.fields])
