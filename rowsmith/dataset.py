"""DataSet: a lazy chain of operators over a Spark DataFrame."""

from __future__ import annotations

import ast
import difflib
import itertools
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace
from typing import TYPE_CHECKING, Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowsmith import errors
from rowsmith import types as ty
from rowsmith.operators import python_rows as pr
from rowsmith.plans import folds, source
from rowsmith.plans.translate import Translated, Unsupported, V, arguments, column, translate
from rowsmith.types import Ty, to_spark

if TYPE_CHECKING:
    from rowsmith.context import Context

_ids = itertools.count()


def fresh(prefix: str = "c") -> str:
    return f"{prefix}{next(_ids)}"


@dataclass
class Frame:
    """df holds cols (in order), the order columns, and _err where a row may have failed.

    stage: (a df, one that it was made from in Python workers, and their function), for the next operator to join them; of no use for another df.
    """

    df: DataFrame
    cols: list[str]
    types: list[Ty]
    names: list[str | None]
    may_fail: bool = False
    order: list[str] = field(default_factory=list)
    failed: list[DataFrame] = field(default_factory=list)
    stage: tuple[DataFrame, DataFrame, Callable] | None = None

    def workers(self) -> tuple[DataFrame, Callable | None]:
        """Where Python workers begin, and what they do to make df."""
        return self.stage[1:] if self.stage is not None and self.stage[0] is self.df else (self.df, None)

    def values(self) -> list[V]:
        return [V(t, F.col(c)) for c, t in zip(self.cols, self.types, strict=True)]

    def main(self) -> Frame:
        """The rows without an error; rows with one go to ``failed``."""
        if not self.may_fail:
            return self
        bad = self.df.where("_err is not null").select("_err")
        return replace(self, df=self.df.where("_err is null").select(*self.order, *self.cols), may_fail=False, failed=[*self.failed, bad])


@dataclass
class _Handler:
    cls: type
    function: Callable | None


@dataclass
class _Pending:
    """An operator that may still get handlers."""

    kind: str  # map, filter, with, cell
    function: Callable
    name: str | int | None = None
    handlers: list[_Handler] = field(default_factory=list)


class DataSet:
    """A dataset. An error dataset carries a message instead of rows, and stays one."""

    def __init__(self, context: Context, frame: Frame | None, pending: _Pending | None = None, error: str | None = None):
        self._context, self._frame, self._pending, self._error = context, frame, pending, error
        self._done: Frame | None = None

    # -- plumbing -----------------------------------------------------------------

    def _fail(self, message: str) -> DataSet:
        return DataSet(self._context, None, error=message)

    def _lowered(self) -> Frame:
        if self._done is None:
            self._done = self._frame if self._pending is None else _lower(self._context, self._frame, self._pending)
        return self._done

    def _apply(self, kind: str, function: Callable, name: str | int | None = None) -> DataSet:
        if self._error is not None:
            return self
        if not callable(function):
            raise TypeError("a function is needed")
        frame = self._lowered()
        count = getattr(getattr(function, "__code__", None), "co_argcount", 1)
        if kind == "cell":
            if name not in frame.names:
                return self._fail(_unknown(name, frame.names))
        elif count not in (1, len(frame.cols)):
            return self._fail(f"the function takes {count} parameters, the dataset has {len(frame.cols)} columns")
        return DataSet(self._context, frame, _Pending(kind, function, name))

    def _handled(self, cls: type, function: Callable | None) -> DataSet:
        if self._error is not None:
            return self
        if not (isinstance(cls, type) and issubclass(cls, Exception)):
            raise TypeError("an exception class is needed")
        if self._pending is None:
            return self._fail("resolve and ignore must follow an operator with a function")
        return DataSet(self._context, self._frame, replace(self._pending, handlers=[*self._pending.handlers, _Handler(cls, function)]))

    # -- operators ----------------------------------------------------------------

    def map(self, ftor: Callable) -> DataSet:
        """Each row to a value; a tuple gives columns, a dict with string keys names them."""
        return self._apply("map", ftor)

    def filter(self, ftor: Callable) -> DataSet:
        """Keeps the rows for which the function is true."""
        return self._apply("filter", ftor)

    def withColumn(self, column: str, ftor: Callable) -> DataSet:
        """Replaces the named column in place, or appends it; the function sees the row."""
        if not isinstance(column, str):
            raise TypeError("a column name is needed")
        return self._apply("with", ftor, column)

    def mapColumn(self, column: str, ftor: Callable) -> DataSet:
        """Replaces the named column; the function sees its cell alone."""
        return self._apply("cell", ftor, column)

    def resolve(self, eclass: type, ftor: Callable) -> DataSet:
        """For rows whose preceding operator raised the class or a subclass, takes the function's result instead."""
        return self._handled(eclass, ftor)

    def ignore(self, eclass: type) -> DataSet:
        """Drops rows whose preceding operator raised the class or a subclass."""
        return self._handled(eclass, None)

    def selectColumns(self, columns: str | int | Sequence[str | int]) -> DataSet:
        """Columns by name or position, negative ones from the end."""
        if self._error is not None:
            return self
        frame = self._lowered()
        picked = []
        for c in [columns] if isinstance(columns, str | int) else columns:
            at = _position(c, frame.names)
            if at is None:
                return self._fail(_unknown(c, frame.names))
            picked.append(at)
        new = [fresh() for _ in picked]
        extra = ["_err"] if frame.may_fail else []
        df = frame.df.select(*frame.order, *(F.col(frame.cols[i]).alias(n) for i, n in zip(picked, new, strict=True)), *extra)
        return DataSet(self._context, replace(frame, df=df, cols=new, types=[frame.types[i] for i in picked], names=[frame.names[i] for i in picked]))

    def renameColumn(self, key: str | int, newColumnName: str) -> DataSet:
        """Renames a column by name or position."""
        if self._error is not None:
            return self
        frame = self._lowered()
        at = _position(key, frame.names)
        if at is None:
            return self._fail(_unknown(key, frame.names))
        names = list(frame.names)
        names[at] = newColumnName
        return DataSet(self._context, replace(frame, names=names))

    def unique(self) -> DataSet:
        """Distinct rows, in no order."""
        if self._error is not None:
            return self
        frame = self._lowered().main()
        return DataSet(self._context, replace(frame, df=frame.df.select(*frame.cols).distinct(), order=[]))

    def join(self, dsRight: DataSet, leftKeyColumn: str | int, rightKeyColumn: str | int, prefixes: Sequence[str | None] | None = None, suffixes: Sequence[str | None] | None = None) -> DataSet:
        """Inner join on one key; None equals None. Left columns, the key under its left name, right columns."""
        return self._join(dsRight, leftKeyColumn, rightKeyColumn, prefixes, suffixes, "inner")

    def leftJoin(self, dsRight: DataSet, leftKeyColumn: str | int, rightKeyColumn: str | int, prefixes: Sequence[str | None] | None = None, suffixes: Sequence[str | None] | None = None) -> DataSet:
        """As join, with every left row; columns of a missing right row are None."""
        return self._join(dsRight, leftKeyColumn, rightKeyColumn, prefixes, suffixes, "left")

    def _join(self, other: DataSet, left_key: str | int, right_key: str | int, prefixes: Any, suffixes: Any, how: str) -> DataSet:
        for ds in (self, other):
            if ds._error is not None:
                return ds
        a, b = self._lowered().main(), other._lowered().main()
        i, j = _position(left_key, a.names), _position(right_key, b.names)
        if i is None or j is None:
            return self._fail(_unknown(left_key, a.names) if i is None else _unknown(right_key, b.names))
        ka, kb = ty.base(a.types[i]), ty.base(b.types[j])
        if ka != kb and "null" not in (ka, kb):
            raise TypeError(f"join keys of types {ka} and {kb}")
        la = [(a.cols[k], fresh()) for k in range(len(a.cols))]
        lb = [(b.cols[k], fresh()) for k in range(len(b.cols))]
        left = a.df.select(*(F.col(x).alias(y) for x, y in la))
        right = b.df.select(*(F.col(x).alias(y) for x, y in lb))
        key, other_key = la[i][1], lb[j][1]
        plain = not ty.nullable(a.types[i]) and not ty.nullable(b.types[j])
        cond = left[key] == right[other_key] if plain else left[key].eqNullSafe(right[other_key])
        cols = [y for k, (_, y) in enumerate(la) if k != i] + [key] + [y for k, (_, y) in enumerate(lb) if k != j]
        joined = left.join(right, cond, how).select(*cols)
        pre, suf = [*(prefixes or (None, None))], [*(suffixes or (None, None))]

        def named(n: str | None, side: int) -> str | None:
            return None if n is None else f"{pre[side] or ''}{n}{suf[side] or ''}"

        types = [t for k, t in enumerate(a.types) if k != i] + [a.types[i]] + [ty.opt(t) if how == "left" else t for k, t in enumerate(b.types) if k != j]
        names = [named(n, 0) for k, n in enumerate(a.names) if k != i] + [named(a.names[i], 0)] + [named(n, 1) for k, n in enumerate(b.names) if k != j]
        return DataSet(self._context, Frame(joined, cols, types, names, failed=a.failed + b.failed))

    def aggregate(self, combine: Callable, aggregate: Callable, initial_value: Any) -> DataSet:
        """One row: the fold of all rows."""
        return self._fold(combine, aggregate, initial_value, [])

    def aggregateByKey(self, combine: Callable, aggregate: Callable, initial_value: Any, key_columns: Sequence[str | int] | str | int) -> DataSet:
        """A fold for each key; the keys, then the aggregate's parts."""
        return self._fold(combine, aggregate, initial_value, [key_columns] if isinstance(key_columns, str | int) else list(key_columns))

    def _fold(self, combine: Callable, aggregate: Callable, initial: Any, keys: list[str | int]) -> DataSet:
        if self._error is not None:
            return self
        frame = self._lowered()
        at = [_position(k, frame.names) for k in keys]
        if None in at:
            return self._fail(_unknown(keys[at.index(None)], frame.names))
        c, a = source.of(combine), source.of(aggregate)
        parts = folds.recognise(c, a, initial)
        if parts is None and (swapped := folds.recognise(a, c, initial)) is not None:
            parts, c, a = swapped, a, c
        if parts is not None:
            try:
                return DataSet(self._context, _native_fold(self._context, frame, a, parts, initial, at))
            except Unsupported:
                pass
        from rowsmith.operators.python_folds import python_fold

        return DataSet(self._context, python_fold(self._context, frame, combine, aggregate, initial, at))

    def cache(self, store_specialized: bool = True) -> DataSet:
        """Computes now and keeps the rows, those with errors too."""
        if self._error is not None:
            return self
        frame = self._lowered()
        kept = replace(frame, df=frame.df.persist(), stage=None)
        kept.df.count()
        return DataSet(self._context, kept)

    # -- metadata -----------------------------------------------------------------

    @property
    def columns(self) -> list[str] | None:
        """Names, None if no column has one."""
        if self._error is not None:
            return None
        names = self._lowered().names
        return None if all(n is None for n in names) else [n if n is not None else "" for n in names]

    @property
    def types(self) -> list | None:
        return None if self._error is not None else [ty.name(t) for t in self._lowered().types]

    @property
    def exception_counts(self) -> dict[str, int] | None:
        """How many rows are missing from the result, by the class raised."""
        if self._error is not None:
            return None
        frame = self._lowered().main()
        if not frame.failed:
            return {}
        bad = frame.failed[0]
        for df in frame.failed[1:]:
            bad = bad.unionAll(df)
        return {r["e"]: r["n"] for r in bad.groupBy(errors.class_name(F.col("_err")).alias("e")).agg(F.count("*").alias("n")).collect()}

    # -- actions ------------------------------------------------------------------

    def _rows(self, limit: int | None = None) -> list:
        frame = self._lowered().main()
        df = frame.df.orderBy(*frame.order) if frame.order else frame.df
        df = df.select(*frame.cols)
        rows = df.collect() if limit is None else df.limit(limit).collect()
        out = [tuple(ty.decode(v, t) for v, t in zip(r, frame.types, strict=True)) for r in rows]
        self._context.metrics._count(self)
        return [r[0] for r in out] if len(frame.cols) == 1 else out

    def collect(self) -> list:
        """All rows as tuples, bare values for one column; an error dataset gives its message."""
        return [self._error] if self._error is not None else self._rows()

    def take(self, nrows: int = 5) -> list:
        if not isinstance(nrows, int) or nrows <= 0:
            raise AssertionError("nrows must be an integer greater than zero")
        return [self._error] if self._error is not None else self._rows(nrows)

    def show(self, nrows: int | None = None) -> None:
        """Prints rows as an ASCII table, all where nrows is None or negative."""
        if self._error is not None:
            print(self._error)
            return
        frame = self._lowered()
        rows = self._rows(nrows if nrows is not None and nrows >= 0 else None)
        table = [[n if n is not None else f"Column_{i}" for i, n in enumerate(frame.names)]]
        table += [[repr(v) for v in (r if len(frame.cols) > 1 else (r,))] for r in rows]
        widths = [max(map(len, c)) for c in zip(*table, strict=True)]
        bar = "+".join(["", *("-" * (w + 2) for w in widths), ""])
        lines = [bar]
        for k, r in enumerate(table):
            lines.append("|".join(["", *(f" {v:<{w}} " for v, w in zip(r, widths, strict=True)), ""]))
            if k == 0 or k == len(table) - 1:
                lines.append(bar)
        print("\n".join(lines))

    def to_df(self) -> DataFrame:
        """The rows as a Spark DataFrame, with the columns' names (or column_0, ...)."""
        if self._error is not None:
            raise ValueError(self._error)
        frame = self._lowered().main()
        return frame.df.select(*frame.cols).toDF(*(n if n is not None else f"column_{i}" for i, n in enumerate(frame.names)))

    def tocsv(self, path: str, part_size: int = 0, num_rows: int | None = None, num_parts: int = 0, part_name_generator: Callable | None = None, null_value: str | None = None, header: bool | Sequence[str] = True) -> None:
        """Writes CSV parts. header: whether, or which, names to write."""
        from rowsmith.sources import sinks

        sinks.write(self, "csv", path, part_size, num_rows, num_parts, part_name_generator, null_value, header)

    def toorc(self, path: str, part_size: int = 0, num_rows: int | None = None, num_parts: int = 0, part_name_generator: Callable | None = None) -> None:
        """Writes ORC parts."""
        from rowsmith.sources import sinks

        sinks.write(self, "orc", path, part_size, num_rows, num_parts, part_name_generator, None, True)


def _position(key: str | int, names: list[str | None]) -> int | None:
    if isinstance(key, str):
        return names.index(key) if key in names else None
    return key % len(names) if -len(names) <= key < len(names) else None


def _unknown(key: Any, names: list[str | None]) -> str:
    near = difflib.get_close_matches(str(key), [n for n in names if n], 1)
    return f"no column {key!r}" + (f", did you mean {near[0]!r}?" if near else "")


# -- lowering -----------------------------------------------------------------------


def _flat(v: V) -> tuple[list[V], list[str | None]]:
    """A map's value as columns with names."""
    if v.keys is not None and v.parts is not None and isinstance(v.type, tuple) and v.type[0] == "dict":
        return v.parts, list(v.keys)
    if isinstance(v.type, tuple) and v.type[0] == "tuple":
        members = v.parts if v.parts is not None else [V(t, v.col.getField(f"_{i + 1}")) for i, t in enumerate(v.type[1:])]
        if not members:
            raise Unsupported("an empty row")
        return members, [None] * len(members)
    if v.special is not None:
        raise Unsupported("a value that is no row")
    return [v], [None]


def _one(context: Context, frame: Frame, op: _Pending, f: Callable) -> Translated:
    udf = source.of(f)
    if udf.params is None:
        raise Unsupported("no source")
    if "pyobj" in frame.types:
        raise Unsupported("pickled values")
    values = frame.values()
    if op.kind == "cell":
        if len(udf.params) != 1:
            raise Unsupported("number of parameters")
        env = {udf.params[0]: values[frame.names.index(op.name)]}
    else:
        env = arguments(udf.params, values, frame.names)
    return translate(udf.params, udf.body, udf.outer, env, context.flag("autoUpcast"), context.flag("allowUndefinedBehavior"))


def _lower(context: Context, frame: Frame, op: _Pending) -> Frame:
    if context.flag("forcePython"):
        return _python(context, frame, op)
    try:
        return _native(context, frame, op)
    except Unsupported:
        return _python(context, frame, op)


def _native(context: Context, frame: Frame, op: _Pending) -> Frame:
    main = _one(context, frame, op, op.function)
    handlers = [(h, None if h.function is None else _one(context, frame, op, h.function)) for h in op.handlers] if main.err is not None else []
    df = frame.df
    for t in (main, *(t for _, t in handlers if t is not None)):
        for name, c in t.lets:
            df = df.withColumn(name, c)

    def shaped(t: Translated) -> tuple[list[V], list[str | None]]:
        if op.kind == "map":
            return _flat(t.value)
        if op.kind == "filter":
            from rowsmith.plans.translate import Translator

            return [V("bool", Translator({}).truth(t.value))], [None]
        if t.value.type == "pyobj" or (t.value.col is None and t.value.parts is None):
            raise Unsupported("cell")
        return [V(t.value.type, column(t.value))], [op.name]

    values, names = shaped(main)
    types = [v.type for v in values]
    for _, t in handlers:
        if t is None:
            continue
        other, _ = shaped(t)
        never = main.value.known and main.value.const is None and main.err is not None
        joined = [ty.unify(x, y.type, context.flag("autoUpcast")) for x, y in zip(types, other, strict=False)]
        if len(other) != len(values) or None in joined:
            if not never:
                raise Unsupported("a resolver of another type")
            joined = [v.type for v in other]
        types = joined
    for t in types:
        if not isinstance(t, str | tuple) or t in ("match", "constdict", "dict0", "pyobj") or (isinstance(t, tuple) and len(t) == 1):
            raise Unsupported(f"a column of {t}")
    kinds = [to_spark(t) for t in types]
    cols = [column(v).cast(k) for v, k in zip(values, kinds, strict=True)]
    err: Column | None = main.err
    drop: Column | None = None
    for h, t in handlers:
        raised = errors.matches(err, h.cls)
        if t is None:
            drop = raised if drop is None else drop | raised
            err = F.when(~raised, err)
            continue
        other, _ = shaped(t)
        cols = [F.when(raised, column(v).cast(k)).otherwise(c) for v, k, c in zip(other, kinds, cols, strict=True)]
        err = F.when(raised, t.err if t.err is not None else F.lit(None)).otherwise(err)
    if err is not None and frame.may_fail:
        err = F.coalesce(F.col("_err"), err)
    elif err is None and frame.may_fail:
        err = F.col("_err")
    prior = F.col("_err").isNotNull() if frame.may_fail else F.lit(False)

    if op.kind == "filter":
        if err is None:
            kept = df.where(cols[0])
            return replace(frame, df=kept.select(*frame.order, *frame.cols))
        keep = cols[0] if drop is None else cols[0] & ~(drop & ~prior)
        mine = fresh("_e")
        df = df.withColumn(mine, err)
        df = df.where(F.col(mine).isNotNull() | F.coalesce(keep, F.lit(False)))
        return replace(frame, df=df.select(*frame.order, *frame.cols, F.col(mine).alias("_err")), may_fail=True)
    if drop is not None:
        df = df.where(prior | ~drop)
    new = [fresh() for _ in cols]
    extra = [] if err is None else [err.cast("string").alias("_err")]
    made = [c.alias(n) for c, n in zip(cols, new, strict=True)]
    if op.kind == "map":
        return replace(frame, df=df.select(*frame.order, *made, *extra), cols=new, types=types, names=names, may_fail=err is not None)
    return _placed(frame, df, op, made, new, types, extra, err is not None)


def _placed(frame: Frame, df: DataFrame, op: _Pending, made: list[Column], new: list[str], types: list[Ty], extra: list, fails: bool) -> Frame:
    """Puts one computed column in its place among the others."""
    at = frame.names.index(op.name) if op.name in frame.names else len(frame.cols)
    cols, kinds, names = list(frame.cols), list(frame.types), list(frame.names)
    cols[at : at + 1], kinds[at : at + 1], names[at : at + 1] = new, types, [op.name]
    others = [F.col(c) for c in cols if c not in new]
    return replace(frame, df=df.select(*frame.order, *others, *made, *extra), cols=cols, types=kinds, names=names, may_fail=fails)


def _python(context: Context, frame: Frame, op: _Pending) -> Frame:
    udf = source.of(op.function)
    cell = frame.names.index(op.name) if op.kind == "cell" else None
    by_name = cell is None and len(frame.cols) == 1 and pr.reads_by_name(udf, frame.names[0])
    group = pr.Group({"with": "column", "cell": "column"}.get(op.kind, op.kind), op.function, by_name, cell, [(h.cls, h.function) for h in op.handlers])
    types, names, spread = _shape(context, frame, group, op)
    new = [fresh() for _ in types]
    if op.kind == "map":
        carried = list(frame.order)
    elif op.kind == "filter":
        carried = [*frame.order, *frame.cols]
    else:
        carried = [*frame.order, *(c for c, n in zip(frame.cols, frame.names, strict=True) if n != op.name)]
    fields = {f.name: f for f in frame.df.schema.fields}
    schema = T.StructType([T.StructField(c, fields[c].dataType) for c in carried] + [T.StructField(n, to_spark(t)) for n, t in zip(new, types, strict=True)] + [T.StructField("_err", T.StringType())])
    run = pr.worker(group, frame.names, frame.types, frame.cols, new, types, carried, pr.arrow_schema(schema), frame.may_fail, spread)
    base, before = frame.workers()
    run = pr.after(before, run)
    df = base.mapInArrow(run, schema)
    if op.kind == "filter":
        made = replace(frame, df=df, may_fail=True)
    elif op.kind == "map":
        made = replace(frame, df=df, cols=new, types=types, names=names, may_fail=True)
    else:
        made = _placed(frame, df, op, [F.col(n) for n in new], new, types, [F.col("_err")], True)
    return replace(made, stage=(made.df, base, run))


def _shape(context: Context, frame: Frame, group: pr.Group, op: _Pending) -> tuple[list[Ty], list[str | None], bool]:
    """Result types and names from running the operator on all rows: on the driver where they are few, else in a pass of its own."""
    if op.kind == "filter":
        return [], [], True
    spread, name, upcast = group.kind == "map", op.name if op.kind != "map" else None, context.flag("autoUpcast")
    good = frame.df.where("_err is null") if frame.may_fail else frame.df
    rows = good.select(*frame.cols).limit(context.number("sampleRows") + 1).collect()
    seen = pr.Seen(upcast)
    if len(rows) > context.number("sampleRows"):
        base, before = frame.workers()
        df = base if before is not None else base.select(*frame.cols, *(["_err"] if frame.may_fail else []))
        seen = pr.seen_by(df, pr.results(group, frame.names, frame.types, frame.cols, frame.may_fail), spread, name, upcast, before)
    else:
        call = group.bound(frame.names)
        for r in rows:
            value, error = call(tuple(ty.decode(v, t) for v, t in zip(r, frame.types, strict=True)))
            if value is not pr.DROP and error is None:
                seen.value(value, spread, name)
    return seen.columns() or (["pyobj"], [name], True)


def _native_fold(context: Context, frame: Frame, udf: source.Udf, parts: list[folds.Part], initial: Any, keys: list[int]) -> Frame:
    """A recognised fold as Spark aggregates; rows whose expression fails are set aside."""
    if "pyobj" in frame.types:
        raise Unsupported("pickled values")
    env = arguments(udf.params[1:], frame.values(), frame.names)
    body = [ast.Return(ast.Tuple([p.expression for p in parts], ast.Load()))]
    t = translate(udf.params[1:], body, udf.outer, env, context.flag("autoUpcast"), context.flag("allowUndefinedBehavior"))
    df = frame.df
    for name, c in t.lets:
        df = df.withColumn(name, c)
    values = t.value.parts
    for v in values:
        if v.type not in ("bool", "i64", "f64"):
            raise Unsupported("a fold of other values")
    err = t.err
    if err is not None and frame.may_fail:
        err = F.coalesce(F.col("_err"), err)
    elif frame.may_fail:
        err = F.col("_err")
    names = [fresh() for _ in parts]
    computed = df.select(*frame.cols, *(v.col.cast("long" if v.type == "bool" else to_spark(v.type)).alias(n) for v, n in zip(values, names, strict=True)), *([] if err is None else [err.alias("_err")]))
    inner = replace(frame, df=computed, cols=[*frame.cols, *names], types=[*frame.types, *(v.type for v in values)], names=[*frame.names, *[None] * len(names)], may_fail=err is not None, order=[]).main()
    aggs, types, lost = [], [], F.lit(False)
    for p, n, v in zip(parts, names, values, strict=True):
        kind = "f64" if "f64" in (v.type, ty.of_value(p.initial)) else "i64"
        start = F.lit(p.initial).cast(to_spark(kind))
        c = F.col(n).cast(to_spark(kind))
        if p.how == "sum":
            total = F.when(F.count(c) == 0, start).otherwise(F.try_add(F.try_sum(c), start))
            lost = lost | (total.isNull() if kind == "i64" else F.lit(False))
        else:
            total = (F.least if p.how == "min" else F.greatest)(F.coalesce({"min": F.min, "max": F.max}[p.how](c), start), start)
        aggs.append(total.alias(fresh()))
        types.append(kind)
    # A sum beyond 64 bits is set aside like any value that no column holds.
    sums = any(p.how == "sum" and t == "i64" for p, t in zip(parts, types, strict=True))
    grouped = inner.df.groupBy(*(frame.cols[i] for i in keys)).agg(*aggs, *([F.when(lost, errors.literal("OverflowError")).alias("_err")] if sums else []))
    cols = [c for c in grouped.columns if c != "_err"]
    return Frame(grouped, cols, [*(frame.types[i] for i in keys), *types], [*(frame.names[i] for i in keys), *[None] * len(types)], may_fail=sums, failed=inner.failed)
