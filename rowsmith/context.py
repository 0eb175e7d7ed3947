"""Context: the entry point, its options and sources."""

from __future__ import annotations

import logging
import time
from collections import Counter
from typing import TYPE_CHECKING, Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from rowsmith import types as ty
from rowsmith.dataset import DataSet, Frame, fresh
from rowsmith.types import Ty, to_spark

if TYPE_CHECKING:
    from rowsmith.dataset import DataSet as _DataSet

DEFAULTS: dict[str, Any] = {
    "autoUpcast": True, "allowUndefinedBehavior": False, "normalcaseThreshold": 0.9, "optionalThreshold": 0.7, "sampleRows": 500, "forcePython": False,
    "csv.maxDetectionMemory": 256 << 10, "csv.maxDetectionRows": 10_000, "csv.separators": [",", ";", "|", "\t"], "csv.comments": ["#", "~"], "csv.multiLine": False, "csv.quotechar": '"',
    "optimizer.filterPushdown": True, "optimizer.mergeExceptionsInOrder": True, "optimizer.nullValueOptimization": False, "optimizer.selectionPushdown": True,
}
_SIZES = {"KB": 1 << 10, "MB": 1 << 20, "GB": 1 << 30, "B": 1}


class Metrics:
    """What the last action of a context measured."""

    def __init__(self) -> None:
        self._last: _DataSet | None = None
        self._began = time.time()

    def _count(self, ds: _DataSet) -> None:
        self._last = ds

    @property
    def totalExceptionCount(self) -> int:
        counts = None if self._last is None else self._last.exception_counts
        return sum(counts.values()) if counts else 0

    @property
    def logicalOptimizationTime(self) -> float:
        """Seconds Spark spent on optimizing the last plan."""
        if self._last is None:
            return 0.0
        phases = self._last._lowered().df._jdf.queryExecution().tracker().phases()
        found = phases.get("optimization")
        return found.get().durationMs() / 1000 if found.isDefined() else 0.0

    # Code generation is Spark's own and not measured apart.
    LLVMOptimizationTime = LLVMCompilationTime = totalCompilationTime = generateLLVMTime = property(lambda self: 0.0)

    def as_dict(self) -> dict[str, Any]:
        return {"totalExceptionCount": self.totalExceptionCount, "logicalOptimizationTime": self.logicalOptimizationTime, "totalCompilationTime": 0.0}

    def as_json(self) -> str:
        import json

        return json.dumps(self.as_dict())


def _nested(d: dict, prefix: str = "") -> dict[str, Any]:
    out = {}
    for k, v in d.items():
        key = f"{prefix}{k}"
        out.update(_nested(v, f"{key}.") if isinstance(v, dict) else {key: v})
    return out


class Context:
    """Makes datasets. conf: options as a dict (nested or dotted) or the path of a YAML file."""

    def __init__(self, conf: dict | str | None = None, spark: SparkSession | None = None, **kwargs: Any):
        given: dict[str, Any] = {}
        if isinstance(conf, str):
            given = _nested(_read_yaml(conf))
        elif conf:
            given = _nested(conf)
        given |= _nested(kwargs)
        self.spark = spark or SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
        self.options_: dict[str, Any] = dict(DEFAULTS)
        for k, v in given.items():
            if k.startswith("spark."):
                self.spark.conf.set(k, v)
            elif k in DEFAULTS:
                self.options_[k] = v
            else:
                self.options_[k] = v
                logging.getLogger("rowsmith").info("option %s has no effect: Spark manages it", k)
        self._metrics = Metrics()

    def flag(self, key: str) -> bool:
        v = self.options_[key]
        return v.lower() == "true" if isinstance(v, str) else bool(v)

    def number(self, key: str) -> int:
        v = self.options_[key]
        if isinstance(v, str):
            for unit, size in _SIZES.items():
                if v.upper().endswith(unit):
                    return int(float(v[: -len(unit)]) * size)
        return int(v)

    @property
    def metrics(self) -> Metrics:
        return self._metrics

    @property
    def uiWebURL(self) -> str | None:
        return self.spark.sparkContext.uiWebUrl

    def options(self, nested: bool = False) -> dict:
        if not nested:
            return dict(self.options_)
        out: dict = {}
        for k, v in self.options_.items():
            at = out
            *path, last = k.split(".")
            for p in path:
                at = at.setdefault(p, {})
            at[last] = v
        return out

    def optionsToYAML(self, file_path: str = "config.yaml") -> None:
        with open(file_path, "w") as f:
            for k, v in sorted(self.options_.items()):
                import json

                f.write(f"{k}: {json.dumps(v)}\n")

    # -- sources ------------------------------------------------------------------

    def _made(self, frame: Frame | str) -> DataSet:
        return DataSet(self, None, error=frame) if isinstance(frame, str) else DataSet(self, frame)

    def parallelize(self, value_list: list, columns: list[str] | None = None, schema: Any = None, auto_unpack: bool = True) -> DataSet:
        """A list as a dataset; tuples become columns, dicts with string keys named columns."""
        if not isinstance(value_list, list | tuple | range):
            raise TypeError("a list is needed")
        values = list(value_list)
        if not values:
            return self._made(Frame(self.spark.createDataFrame([], T.StructType([T.StructField("c0", T.StringType())])), ["c0"], ["null"], [columns[0] if columns else None]))
        names: list[str | None] | None = list(columns) if columns is not None else None
        threshold = float(self.options_["optionalThreshold"])
        if auto_unpack and all(isinstance(v, dict) and v and all(isinstance(k, str) for k in v) for v in values) and schema is None:
            keys = list(dict.fromkeys(k for v in values for k in v))
            same = all(set(v) == set(keys) for v in values)
            if same:
                names, values = names or keys, [tuple(v[k] for k in keys) for v in values]
                if len(keys) == 1:
                    values = [v[0] for v in values]
        widths = Counter(len(v) if isinstance(v, tuple) and v else 0 for v in values)
        width = widths.most_common(1)[0][0]
        if width and len(widths) == 1:
            types: list[Ty] = [_column([v[i] for v in values], threshold) for i in range(width)]
            rows = values
        else:
            types, rows = [_column(values, threshold)], [(v,) for v in values]
            width = 1
        if schema is not None:
            hinted = ty.from_hint(schema)
            types = list(hinted[1:]) if isinstance(hinted, tuple) and hinted[0] == "tuple" and len(hinted) - 1 == width else [hinted]
            types = [t if all(ty.fits(r[i], t) for r in rows) else "pyobj" for i, t in enumerate(types)]
        if names is not None and len(names) != width:
            return self._made(f"{len(names)} column names for {width} columns")
        cols = [fresh() for _ in range(width)]
        st = T.StructType([T.StructField(c, to_spark(t)) for c, t in zip(cols, types, strict=True)])
        data = [tuple(_given(ty.encode(x, t)) for x, t in zip(r, types, strict=True)) for r in rows]
        return self._made(Frame(self.spark.createDataFrame(data, st), cols, types, names or [None] * width))

    def csv(self, pattern: str, columns: list[str] | None = None, header: bool | None = None, delimiter: str | None = None, quotechar: str = '"', null_values: list[str] | None = None, type_hints: dict | None = None) -> DataSet:
        """CSV files by comma-separated globs."""
        from rowsmith.sources import files

        return self._made(files.csv(self, pattern, columns, header, delimiter, quotechar, [""] if null_values is None else [null_values] if isinstance(null_values, str) else list(null_values), type_hints or {}))

    def text(self, pattern: str, null_values: list[str] | str | None = None) -> DataSet:
        """Lines of text files."""
        from rowsmith.sources import files

        return self._made(files.text(self, pattern, [null_values] if isinstance(null_values, str) else null_values))

    def orc(self, pattern: str, columns: list[str] | None = None) -> DataSet:
        from rowsmith.sources import files

        paths = files.glob(self, pattern)
        return self._made(files.table(self, self.spark.read.orc(paths), columns) if paths else f"no file matches {pattern}")

    def parquet(self, pattern: str, columns: list[str] | None = None, required: list[str] | None = None) -> DataSet:
        """Parquet files or folders, an addition to the original sources. required: columns that hold no null."""
        from rowsmith.sources import files

        return self._made(files.parquet(self, pattern, columns, required))

    def from_df(self, df: DataFrame) -> DataSet:
        """A Spark DataFrame as a dataset."""
        from rowsmith.sources import files

        return self._made(files.table(self, df, None))

    # -- files --------------------------------------------------------------------

    def ls(self, pattern: str) -> list[str]:
        from rowsmith.sources import files

        return files.listed(self, pattern)

    def cp(self, pattern: str, target_uri: str) -> None:
        from rowsmith.sources import files

        files.copy(self, pattern, target_uri)

    def rm(self, pattern: str) -> None:
        from rowsmith.sources import files

        files.remove(self, pattern)


def _given(v: Any) -> Any:
    if isinstance(v, dict):
        return tuple(_given(x) for x in v.values())
    if isinstance(v, list) and v and isinstance(v[0], tuple):
        return dict(v)
    return [_given(x) for x in v] if isinstance(v, list) else bytearray(v) if isinstance(v, bytes) else v


def _column(values: list, threshold: float) -> Ty:
    """The common type of all values, pickles if there is none.

    None makes an option whatever its share: unlike a sampled engine this one has seen every
    row, so there is no general case to leave rare rows to.
    """
    del threshold
    kinds: dict = {}
    for v in values:
        t = ty.of_value(v)
        kinds[t if not isinstance(t, list) else tuple(t)] = None
    t = ty.unify_all(list(kinds), upcast=False)
    return t if t != "pyobj" or len(kinds) == 1 else ("pyobj" if not _numbers(kinds) else ty.unify_all(list(kinds)))


def _numbers(kinds: dict) -> bool:
    return set(map(ty.base, kinds)) <= {"i64", "f64", "null"}


def _read_yaml(path: str) -> dict:
    """``key: value`` lines, nested by indentation; values as JSON or plain text."""
    import json

    out: dict = {}
    stack: list[tuple[int, dict]] = [(-1, out)]
    with open(path) as f:
        for line in f:
            if not line.strip() or line.lstrip().startswith("#"):
                continue
            depth = len(line) - len(line.lstrip())
            key, _, value = line.strip().lstrip("- ").partition(":")
            while stack[-1][0] >= depth:
                stack.pop()
            if not value.strip():
                stack[-1][1][key] = {}
                stack.append((depth, stack[-1][1][key]))
                continue
            try:
                stack[-1][1][key] = json.loads(value)
            except ValueError:
                stack[-1][1][key] = value.strip()
    return out


