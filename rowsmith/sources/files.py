"""Files: globbing on any Hadoop file system, CSV sampling, and the readers."""

from __future__ import annotations

import csv as _csv
import io
import re
from typing import TYPE_CHECKING, Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowsmith import errors
from rowsmith import types as ty
from rowsmith.dataset import Frame, fresh
from rowsmith.types import Ty, opt

if TYPE_CHECKING:
    from rowsmith.context import Context

SAMPLE_ROWS = 10_000
#: Files, spread evenly over those given, whose first bytes are sampled.
SAMPLE_FILES = 64
_TRUE, _FALSE = ("true", "t", "yes", "y"), ("false", "f", "no", "n")
_INT = re.compile(r"\s*[+-]?\d{1,19}\s*\Z")
_FLOAT = re.compile(r"\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*\Z|\s*[+-]?(inf|nan)\s*\Z", re.I)


def _fs(context: Context, path: str) -> Any:
    sc = context.spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(sc._jsc.hadoopConfiguration())


def glob(context: Context, pattern: str) -> list[str]:
    """Paths of comma-separated patterns, in order; a folder stands for its files."""
    out: list[str] = []
    for part in pattern.split(","):
        p, fs = _fs(context, part.strip())
        for status in fs.globStatus(p) or []:
            if status.isDirectory():
                inner = sorted(s.getPath().toString() for s in fs.listStatus(status.getPath()) if s.isFile() and not s.getPath().getName().startswith(("_", ".")))
                out += inner
            else:
                out.append(status.getPath().toString())
    return out


def listed(context: Context, pattern: str) -> list[str]:
    out = []
    for part in pattern.split(","):
        p, fs = _fs(context, part.strip())
        out += [s.getPath().toString() for s in fs.globStatus(p) or []]
    return out


def copy(context: Context, pattern: str, target: str) -> None:
    sc = context.spark.sparkContext
    found = listed(context, pattern)
    to, to_fs = _fs(context, target)
    if len(found) > 1 or target.endswith("/"):
        to_fs.mkdirs(to)
    for f in found:
        p, fs = _fs(context, f)
        sc._jvm.org.apache.hadoop.fs.FileUtil.copy(fs, p, to_fs, to, False, True, sc._jsc.hadoopConfiguration())


def remove(context: Context, pattern: str) -> None:
    for f in listed(context, pattern):
        p, fs = _fs(context, f)
        fs.delete(p, True)


def head(context: Context, path: str, size: int) -> str:
    """The first bytes of a file as text, cut at the last full line."""
    p, fs = _fs(context, path)
    n = min(size, fs.getFileStatus(p).getLen())
    stream = fs.open(p)
    try:
        raw = bytes(stream.readNBytes(n))
    finally:
        stream.close()
    text = raw.decode("utf-8", "ignore")
    return text if n < size or "\n" not in text else text[: text.rindex("\n") + 1]


def _kind(cell: str) -> str:
    if _INT.match(cell):
        return "i64"
    if _FLOAT.match(cell):
        return "f64"
    return "bool" if cell.strip().lower() in ("true", "false") else "str"


def separator(text: str, candidates: list[str], quote: str) -> str:
    """The candidate that cuts most lines into the same number of cells."""
    lines = [x for x in text.splitlines()[:200] if x]
    best, score = candidates[0], (0.0, 0)
    for c in candidates:
        widths = [len(r) for r in _csv.reader(lines, delimiter=c, quotechar=quote)]
        if widths:
            common = max(set(widths), key=widths.count)
            if common > 1 and (widths.count(common) / len(widths), common) > score:
                best, score = c, (widths.count(common) / len(widths), common)
    return best


def _column_type(cells: list[str | None], t: float) -> Ty:
    """By majority of the sampled cells; None's share decides between a type, an option and null."""
    present = [c for c in cells if c is not None]
    share = 1 - len(present) / max(1, len(cells))
    if not present:
        return "null"
    kinds = {_kind(c) for c in present}
    kind = next(iter(kinds)) if len(kinds) == 1 else "f64" if kinds <= {"i64", "f64"} else "str"
    if len(kinds) > 1 and kind == "str":  # a majority of one kind leaves the others to the error path
        for k, ok in (("i64", {"i64"}), ("f64", {"i64", "f64"}), ("bool", {"bool"})):
            if sum(_kind(c) in ok for c in present) >= t * len(present):
                kind = k
                break
    return opt(kind) if share > 0 else kind


def quoted_feeds(context: Context, paths: list[str], quotechar: str, comments: list[str]) -> bool:
    """Whether a line of any file has an odd number of quotes, as every line has in which a quoted line feed begins or ends a cell."""
    if not quotechar:
        return False
    line = F.col("value")
    odd = F.length(F.regexp_replace(line, "[^" + "".join("\\" + q if not q.isalnum() else q for q in quotechar) + "]", "")) % 2 == 1
    for x in comments[:1]:
        odd = odd & ~line.startswith(x)
    return bool(context.spark.read.text(paths).where(odd).take(1))


def csv(context: Context, pattern: str, columns: list[str] | None, header: bool | None, delimiter: str | None, quotechar: str, null_values: list[str], type_hints: dict) -> Frame | str:
    paths = glob(context, pattern)
    if not paths:
        return f"no file matches {pattern}"
    comments = context.options_["csv.comments"]
    limit, most = context.number("csv.maxDetectionMemory"), min(SAMPLE_ROWS, context.number("csv.maxDetectionRows"))
    sampled = paths[:: max(1, -(-len(paths) // SAMPLE_FILES))]
    heads = [t for t in (head(context, p, limit) for p in sampled) if t.strip()]
    if comments:
        heads = ["\n".join(x for x in t.split("\n") if not x.startswith(tuple(comments))) for t in heads]
    if not heads:
        return f"{paths[0]} is empty"
    sep = delimiter or separator(max(heads, key=len), context.options_["csv.separators"], quotechar)
    files = [[r for r in _csv.reader(io.StringIO(t), delimiter=sep, quotechar=quotechar) if r][:most] for t in heads]
    files = [f for f in files if f]
    if not files:
        return f"{paths[0]} is empty"
    # Of each file the first line may be the header; the rows of all files tell the types.
    rows = files[0] + [r for f in files[1:] for r in (f[1:] if f[0] == files[0][0] else f)]
    whole_seen = len(sampled) == len(paths) and sum(map(len, files)) < most and all(_fs(context, p)[1].getFileStatus(_fs(context, p)[0]).getLen() <= limit for p in paths)
    width = max(set(map(len, rows)), key=[len(r) for r in rows].count)
    first = rows[0]
    if header is None:
        if columns is not None:
            header = first == list(columns)
        else:
            rest = rows[1:]
            words = all(_kind(c) == "str" for c in first if c) and len(first) == width
            other = any(_kind(r[i]) != "str" for r in rest for i in range(min(len(r), width)) if r[i])
            header = words and (other or not rest or (len(set(first)) == width and all(first[i] not in {r[i] for r in rest if len(r) > i} for i in range(width) if first[i])))
    names: list[str | None] = list(columns) if columns is not None else [n.strip() for n in first] if header else [None] * width
    if len(names) != width:
        return f"{len(names)} column names for {width} columns"
    body = [r for r in (rows[1:] if header else rows) if len(r) == width]
    nulls = list(null_values)
    kinds = [_column_type([None if r[i] in nulls else r[i] for r in body], context.options_["normalcaseThreshold"]) for i in range(width)]
    if not whole_seen:  # a column of which no cell was seen may hold anything
        kinds = [opt("str") if k == "null" else k for k in kinds]
    elif not body:
        kinds = [opt("str")] * width
    for key, hint in (type_hints or {}).items():
        at = names.index(key) if isinstance(key, str) else key
        kinds[at] = ty.from_hint(hint)

    raw = [f"r{i}" for i in range(width)]
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*raw, "_extra"]])
    whole = context.flag("csv.multiLine") or any("\n" in c for r in rows for c in r) or quoted_feeds(context, paths, quotechar, comments)
    reader = context.spark.read.schema(schema).option("sep", sep).option("quote", quotechar).option("escape", quotechar).option("header", False).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_extra")
    # Quoted line feeds make a file unsplittable: only where some file has them or the option says so.
    reader = reader.option("multiLine", bool(whole)).option("emptyValue", "").option("nullValue", "\u0000").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
    if comments:
        reader = reader.option("comment", comments[0])
    df = reader.csv(paths)
    order: list[str] = []
    if len(paths) > 1:
        df, order = ordered(df, paths)
    if header:
        same = F.lit(True)
        for c, n in zip(raw, first, strict=True):
            same = same & F.col(c).eqNullSafe(F.lit(n))
        df = df.where(~same)
    err = F.when(F.col("_extra").isNotNull(), errors.literal("ValueError"))
    cols, made = [fresh() for _ in raw], []
    empty = F.lit(True)
    for c, k in zip(raw, kinds, strict=True):
        cell = F.when(~F.col(c).isin(nulls), F.col(c)) if nulls else F.col(c)
        value, bad = _cell(cell, k)
        empty = empty & cell.isNull()
        made.append(value)
        if bad is not None:
            err = F.coalesce(err, F.when(F.coalesce(bad, F.lit(False)), errors.literal("ValueError")))
    df = df.select(*order, *(m.alias(n) for m, n in zip(made, cols, strict=True)), err.alias("_err"))
    return Frame(df, cols, kinds, names, may_fail=True, order=order)


def _cell(cell: Column, kind: Ty) -> tuple[Column, Column | None]:
    """A cell's value, and where it is no such value."""
    base = ty.base(kind)
    missing = None if ty.nullable(kind) else cell.isNull()
    if base in ("str", "null"):
        return cell, (cell.isNotNull() if base == "null" else missing)
    text = F.btrim(cell)
    if base == "bool":
        low = F.lower(text)
        value = F.when(low.isin(list(_TRUE)), True).when(low.isin(list(_FALSE)), False)
    elif base == "i64":
        value = F.when(text.rlike("^[+-]?\\d+$"), text.try_cast("long"))
    else:
        value = F.when(text.rlike("(?i)^[+-]?((\\d+\\.?\\d*|\\.\\d+)(e[+-]?\\d+)?|inf|infinity|nan)$"), F.regexp_replace(text, "(?i)^([+-]?)inf$", "$1Infinity").try_cast("double"))
    bad = cell.isNotNull() & value.isNull()
    return value, bad if missing is None else bad | missing


def ordered(df: DataFrame, paths: list[str]) -> tuple[DataFrame, list[str]]:
    """Adds columns that sort rows by file in the given order, block, and place."""
    table = F.create_map(*(F.lit(x) for i, p in enumerate(paths) for x in (_name(p), i))) if len(paths) <= 1000 else None
    at = F.element_at(table, F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "/")) if table is not None else F.col("_metadata.file_path")
    names = [fresh("o") for _ in range(3)]
    return df.select("*", at.alias(names[0]), F.col("_metadata.file_block_start").alias(names[1]), F.monotonically_increasing_id().alias(names[2])), names


def _name(path: str) -> str:
    return re.sub(r"^file:/+", "/", path)


def text(context: Context, pattern: str, null_values: list[str] | None) -> Frame | str:
    paths = glob(context, pattern)
    if not paths:
        return f"no file matches {pattern}"
    df = context.spark.read.text(paths)
    order: list[str] = []
    if len(paths) > 1:
        df, order = ordered(df, paths)
    col = fresh()
    value = F.when(~F.col("value").isin(list(null_values)), F.col("value")) if null_values else F.col("value")
    return Frame(df.select(*order, value.alias(col)), [col], [opt("str") if null_values else "str"], [None], order=order)


#: Files whose footers are read to see which columns hold no null.
FOOTERS = 64


def without_nulls(context: Context, paths: list[str]) -> set[str]:
    """Columns that the Parquet footers prove free of null; none where there are too many files to ask."""
    import pyarrow.fs as pafs
    import pyarrow.parquet as pq

    if not 0 < len(paths) <= FOOTERS:
        return set()
    out: set[str] | None = None
    for p in paths:
        try:
            fs, local = (pafs.LocalFileSystem(), _name(p)) if p.startswith(("file:", "/")) else pafs.FileSystem.from_uri(p)
            meta = pq.read_metadata(local, filesystem=fs)
        except (OSError, ValueError):
            return set()
        full = set()
        for i in range(meta.num_columns):
            stats = [meta.row_group(g).column(i).statistics for g in range(meta.num_row_groups)]
            name = meta.schema.column(i).path
            if "." not in name and all(s is not None and s.has_null_count and s.null_count == 0 for s in stats):
                full.add(name)
        out = full if out is None else out & full
    return out or set()


def parquet(context: Context, pattern: str, columns: list[str] | None, required: list[str] | None) -> Frame | str:
    """required: columns known to hold no null; otherwise a few files' footers tell."""
    paths = glob(context, pattern)
    if not paths:
        return f"no file matches {pattern}"
    df = context.spark.read.parquet(*[p.strip() for p in pattern.split(",")])
    full = set(required) if required is not None else without_nulls(context, paths)
    return table(context, df, columns, full)


def table(context: Context, df: DataFrame, columns: list[str] | None, required: set[str] | None = None) -> Frame | str:
    """Any DataFrame as a frame: integers widened, dates and timestamps as integers (days, microseconds)."""
    names = list(columns) if columns is not None else df.columns
    if len(names) != len(df.columns):
        return f"{len(names)} column names for {len(df.columns)} columns"
    cols, types, made = [], [], []
    for f in df.schema.fields:
        c: Column = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DateType):
            c = F.unix_date(c).cast("long")
        elif isinstance(f.dataType, T.TimestampType):
            c = F.unix_micros(c)
        elif isinstance(f.dataType, T.TimestampNTZType):
            c = F.timestamp_diff("MICROSECOND", F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00")), c)
        kind = ty.from_spark(f.dataType, f.nullable and f.name not in (required or ()))
        cols.append(fresh())
        types.append(kind)
        made.append(c.cast(ty.to_spark(kind)).alias(cols[-1]))
    return Frame(df.select(*made), cols, types, names)
