"""Writing parts under their documented names."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Sequence
from typing import TYPE_CHECKING

from pyspark.sql import functions as F

from rowsmith.sources.files import _fs
from rowsmith.types import base

if TYPE_CHECKING:
    from rowsmith.dataset import DataSet


def _part(path: str, n: int, kind: str) -> str:
    """``part<N>.csv`` in a folder, ``a.part<N>.csv`` for a file ``a.csv``."""
    end = f".{kind}"
    return f"{path[: -len(end)]}.part{n}{end}" if path.endswith(end) else f"{path.rstrip('/')}/part{n}{end}"


def write(ds: DataSet, kind: str, path: str, part_size: int, num_rows: int | None, num_parts: int, generator: Callable | None, null_value: str | None, header: bool | Sequence[str]) -> None:
    if ds._error is not None:
        raise ValueError(ds._error)
    context = ds._context
    frame = ds._lowered().main()
    names = [n if n is not None else f"column_{i}" for i, n in enumerate(frame.names)]
    if not isinstance(header, bool):
        if len(header) != len(names):
            raise ValueError(f"{len(header)} header names for {len(names)} columns")
        names = list(header)
    shown = header if isinstance(header, bool) else True
    if shown and isinstance(header, bool) and all(n is None for n in frame.names):
        shown = kind == "orc"
    df = frame.df.orderBy(*frame.order) if frame.order else frame.df
    df = df.select(*frame.cols)
    if num_rows is not None:
        df = df.limit(num_rows)
    if kind == "csv":
        # Booleans as Python writes them; nested values as their text.
        df = df.select(*(F.when(F.col(c), "True").when(~F.col(c), "False").alias(c) if base(t) == "bool" else F.to_json(c).alias(c) if isinstance(base(t), tuple) else F.col(c) for c, t in zip(frame.cols, frame.types, strict=True)))
    unique = [n if names.index(n) == i else f"{n}_{i}" for i, n in enumerate(names)] if kind == "orc" else names
    df = df.toDF(*unique) if len(set(unique)) == len(unique) else df.toDF(*(f"{n}​{i}" for i, n in enumerate(unique)))
    if num_parts > 0:
        df = df.coalesce(1) if num_parts == 1 else df.repartition(num_parts)
    temporary = f"{path.rstrip('/')}.{uuid.uuid4().hex}.tmp"
    writer = df.write
    if part_size > 0:  # bytes: through an estimate of rows
        writer = writer.option("maxRecordsPerFile", max(1, part_size // max(16, 16 * len(names))))
    if kind == "csv":
        writer.option("header", shown).option("nullValue", "" if null_value is None else null_value).option("emptyValue", "" if null_value is None else '""').option("escape", '"').csv(temporary)
    else:
        writer.orc(temporary)
    source, fs = _fs(context, temporary)
    parts = sorted((s.getPath() for s in fs.listStatus(source) if s.getPath().getName().startswith("part-")), key=lambda p: p.getName())
    jvm = context.spark.sparkContext._jvm
    if not path.endswith(f".{kind}"):
        folder, _ = _fs(context, path)
        fs.mkdirs(folder)
    # Parts of an earlier write that this one doesn't replace would be read with its own.
    name = re.escape(path.rstrip("/").rsplit("/", 1)[-1][: -len(kind) - 1]) + r"\." if path.endswith(f".{kind}") else ""
    where = _fs(context, path)[0].getParent() if name else _fs(context, path)[0]
    for s in fs.listStatus(where) if fs.exists(where) else ():
        if s.isFile() and re.fullmatch(rf"{name}part\d+\.{kind}", s.getPath().getName()):
            fs.delete(s.getPath(), False)
    for n, p in enumerate(parts):
        target = jvm.org.apache.hadoop.fs.Path(generator(n) if generator is not None else _part(path, n, kind))
        fs.delete(target, False)
        fs.rename(p, target)
    fs.delete(source, True)
