"""General folds in Python workers: partial folds in each partition, then a merge.

Global fold: a partition gives one partial; these (one for each partition) are merged in a
tree of tasks.  Fold by key: rows are brought together by key and sorted, so a worker
holds one accumulator at a time, whatever the number of keys or rows; a key that holds a large
share of the rows is first folded under salts, so its rows need not meet in one task.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import TYPE_CHECKING, Any

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import functions as F

from rowsmith import errors
from rowsmith import types as ty
from rowsmith.operators.python_rows import flatten, row_class, seen_by, too_large
from rowsmith.types import to_spark

if TYPE_CHECKING:
    from rowsmith.context import Context
    from rowsmith.dataset import Frame

SALTS = 16


def _step(frame: Frame, aggregate: Callable):
    """How a fold takes its rows, settled in the worker: a class of rows doesn't travel."""
    names, count = frame.names, getattr(getattr(aggregate, "__code__", None), "co_argcount", 2)

    def step() -> Callable[[Any, tuple], Any]:
        if count != 2:
            return lambda acc, row: aggregate(acc, *row)
        if len(names) == 1:
            return lambda acc, row: aggregate(acc, row[0])
        kind = row_class(tuple(names))
        return lambda acc, row: aggregate(acc, kind(row))

    return step


def _partials(frame: Frame, aggregate: Callable, initial: Any, keys: list[str]):
    """Rows sorted by (salt, keys) to one row (keys, partial, _err) a run of equal keys; failing rows give (null, null, _err)."""
    make, types, cols, has_err = _step(frame, aggregate), frame.types, frame.cols, frame.may_fail
    fresh = pickle.dumps(initial)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current: tuple | None = None
        acc, any_row = None, False
        schema, step = None, make()
        for batch in batches:
            index = [batch.schema.get_field_index(c) for c in cols]
            if schema is None:
                schema = pa.schema([*(batch.schema.field(k) for k in keys), pa.field("_partial", pa.binary()), pa.field("_err", pa.string())])
            data = [batch.column(i).to_pylist() for i in index]
            ids = list(zip(*(batch.column(batch.schema.get_field_index(k)).to_pylist() for k in keys), strict=True)) if keys else [()] * batch.num_rows
            prior = batch.column(batch.schema.get_field_index("_err")).to_pylist() if has_err else [None] * batch.num_rows
            out: list[tuple] = []
            for i in range(batch.num_rows):
                if prior[i] is not None:
                    out.append((*[None] * len(keys), None, prior[i]))
                    continue
                if not any_row or ids[i] != current:
                    if any_row:
                        out.append((*current, cloudpickle.dumps(acc), None))
                    current, acc, any_row = ids[i], pickle.loads(fresh), True
                try:
                    acc = step(acc, tuple(ty.decode(c[i], t) for c, t in zip(data, types, strict=True)))
                except Exception as e:
                    out.append((*[None] * len(keys), None, errors.chain(type(e))))
            yield _batch(out, schema)
        if any_row:
            yield _batch([(*current, cloudpickle.dumps(acc), None)], schema)

    return run


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def _merge(combine: Callable, initial: Any, keys: list[str]):
    """Partials sorted by keys to one row a key."""
    fresh = pickle.dumps(initial)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, acc, any_row, schema = None, None, False, None
        for batch in batches:
            schema = schema or pa.schema([*(batch.schema.field(k) for k in keys), pa.field("_partial", pa.binary())])
            ids = list(zip(*(batch.column(i).to_pylist() for i in range(len(keys))), strict=True)) if keys else [()] * batch.num_rows
            out = []
            for i, p in enumerate(batch.column(len(keys)).to_pylist()):
                if not any_row or ids[i] != current:
                    if any_row:
                        out.append((*current, cloudpickle.dumps(acc)))
                    current, acc, any_row = ids[i], pickle.loads(fresh), True
                acc = combine(acc, pickle.loads(p))
            yield _batch(out, schema)
        if any_row:
            yield _batch([(*current, cloudpickle.dumps(acc))], schema)

    return run


def _spread(types: list, n: int, keys: list[str], spread: bool):
    """(keys, values, _err): an aggregate that no column of its types holds is set aside as an error."""
    from pyspark.sql.pandas.types import to_arrow_type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, failed = [], []
            for p in batch.column(len(keys)).to_pylist():
                value = pickle.loads(p)
                parts = flatten(value)[0] if spread else (value,)
                good = len(parts) == n and all(map(ty.fits, parts, types))
                failed.append(None if good else errors.chain(OverflowError if any(map(too_large, parts)) else TypeError))
                rows.append([ty.encode(x, t) for x, t in zip(parts, types, strict=True)] if good else [None] * n)
            arrays = [batch.column(i) for i in range(len(keys))]
            arrays += [pa.array([r[i] for r in rows], to_arrow_type(to_spark(types[i]))) for i in range(n)]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(failed, pa.string())], names=[*keys, *(f"_v{i}" for i in range(n)), "_err"])

    return run


def _aggregates(batch: pa.RecordBatch) -> Iterator[list]:
    yield from ([pickle.loads(p)] for p in batch.column(batch.schema.get_field_index("_partial")).to_pylist())


def python_fold(context: Context, frame: Frame, combine: Callable, aggregate: Callable, initial: Any, key_at: list[int]) -> Frame:
    from rowsmith.dataset import Frame as _Frame
    from rowsmith.dataset import fresh as name_of

    keys = [name_of("k") for _ in key_at]
    df = frame.df.select(*frame.cols, *(F.col(frame.cols[i]).alias(k) for i, k in zip(key_at, keys, strict=True)), *(["_err"] if frame.may_fail else []))
    if keys:
        df = df.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))).repartition("_salt", *keys).sortWithinPartitions("_salt", *keys)
    fields = {f.name: f for f in df.schema.fields}
    key_ddl = ", ".join(f"{k} {fields[k].dataType.simpleString()}" for k in keys)
    head = f"{key_ddl}, " if keys else ""
    partial = df.mapInArrow(_partials(frame, aggregate, initial, keys), f"{head}_partial binary, _err string").persist()
    bad = partial.where("_err is not null").select("_err")
    good = partial.where("_err is null").select(*keys, "_partial")
    if keys:
        merged = good.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_merge(combine, initial, keys), f"{head}_partial binary")
    else:
        parts = good.rdd.getNumPartitions()
        while parts > 1:  # a tree of merges: no task meets more than a few partials
            parts = max(1, parts // 16)
            good = good.coalesce(parts).mapInArrow(_merge(combine, initial, keys), "_partial binary")
        merged = good
        if merged.limit(1).count() == 0:
            merged = context.spark.createDataFrame([(bytearray(cloudpickle.dumps(initial)),)], "_partial binary")
    seen = seen_by(merged.select("_partial"), _aggregates, True, None, context.flag("autoUpcast"))
    if not seen.shapes:
        seen.value(initial, True, None)
    types, _, spread = seen.columns() or (["pyobj"], [None], False)
    n = len(types)
    out = merged.mapInArrow(_spread(types, n, keys, spread), head + "".join(f"_v{i} {to_spark(t).simpleString()}, " for i, t in enumerate(types)) + "_err string")
    return _Frame(out, [*keys, *(f"_v{i}" for i in range(n))], [*(frame.types[i] for i in key_at), *types], [*(frame.names[i] for i in key_at), *[None] * n], may_fail=True, failed=[*frame.failed, bad])
