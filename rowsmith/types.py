"""Value types of datasets, their unification, and their Spark counterparts.

A type is a string (``bool i64 f64 str null pyobj match``) or a tuple headed by
``opt``, ``tuple``, ``list`` or ``dict``.  ``pyobj`` is a pickled Python value, for rows
that no common type fits.
"""

from __future__ import annotations

import pickle
import typing
from typing import Any

from pyspark import cloudpickle
from pyspark.sql import types as T

Ty = Any
LADDER = ("bool", "i64", "f64")


def opt(t: Ty) -> Ty:
    return t if t in ("null", "pyobj") or is_opt(t) else ("opt", t)


def is_opt(t: Ty) -> bool:
    return isinstance(t, tuple) and t[0] == "opt"


def base(t: Ty) -> Ty:
    return t[1] if is_opt(t) else t


def nullable(t: Ty) -> bool:
    return t == "null" or is_opt(t)


def of_value(v: Any) -> Ty:
    """The type of a Python value; pyobj where there is no other."""
    if v is None:
        return "null"
    if isinstance(v, bool):
        return "bool"
    if isinstance(v, int):
        return "i64" if -(1 << 63) <= v < 1 << 63 else "pyobj"
    if isinstance(v, float):
        return "f64"
    if isinstance(v, str):
        return "str"
    if isinstance(v, tuple) and v:
        return ("tuple", *map(of_value, v))
    if isinstance(v, list):
        return ("list", unify_all([of_value(x) for x in v]) if v else "null")
    if isinstance(v, dict) and v:
        k, w = unify_all([of_value(x) for x in v]), unify_all([of_value(x) for x in v.values()])
        return "pyobj" if "pyobj" in (k, w) or nullable(k) else ("dict", k, w)
    return "pyobj"


def unify(a: Ty, b: Ty, upcast: bool = True) -> Ty | None:
    """The least common type, or None."""
    if a == b:
        return a
    if "pyobj" in (a, b):
        return None
    if a == "null" or b == "null":
        return opt(b if a == "null" else a)
    if is_opt(a) or is_opt(b):
        u = unify(base(a), base(b), upcast)
        return None if u is None else opt(u)
    if a in LADDER and b in LADDER:
        return LADDER[max(LADDER.index(a), LADDER.index(b))] if upcast else None
    if isinstance(a, tuple) and isinstance(b, tuple) and a[0] == b[0] and len(a) == len(b):
        parts = [unify(x, y, upcast) for x, y in zip(a[1:], b[1:], strict=True)]
        return None if None in parts else (a[0], *parts)
    return None


def unify_all(types: list[Ty], upcast: bool = True) -> Ty:
    """The common type of all, pyobj if there is none."""
    out = types[0] if types else "null"
    for t in types[1:]:
        if (out := unify(out, t, upcast)) is None:
            return "pyobj"
    return out


def to_spark(t: Ty) -> T.DataType:
    t = base(t)
    simple = {"bool": T.BooleanType(), "i64": T.LongType(), "f64": T.DoubleType(), "str": T.StringType(), "null": T.StringType(), "pyobj": T.BinaryType()}
    if isinstance(t, str):
        return simple[t]
    if t[0] == "tuple":
        return T.StructType([T.StructField(f"_{i + 1}", to_spark(x)) for i, x in enumerate(t[1:])])
    if t[0] == "list":
        return T.ArrayType(to_spark(t[1]))
    return T.MapType(to_spark(t[1]), to_spark(t[2]))


def from_spark(t: T.DataType, null: bool = True) -> Ty:
    if isinstance(t, T.BooleanType):
        out: Ty = "bool"
    elif isinstance(t, T.ByteType | T.ShortType | T.IntegerType | T.LongType | T.DateType | T.TimestampType | T.TimestampNTZType):
        out = "i64"
    elif isinstance(t, T.FloatType | T.DoubleType | T.DecimalType):
        out = "f64"
    elif isinstance(t, T.StringType):
        out = "str"
    elif isinstance(t, T.ArrayType):
        out = ("list", from_spark(t.elementType, t.containsNull))
    elif isinstance(t, T.MapType):
        out = ("dict", from_spark(t.keyType, False), from_spark(t.valueType, t.valueContainsNull))
    elif isinstance(t, T.StructType):
        out = ("tuple", *(from_spark(f.dataType, f.nullable) for f in t.fields))
    elif isinstance(t, T.NullType):
        return "null"
    else:
        raise TypeError(f"no dataset type for {t.simpleString()}")
    return opt(out) if null else out


_HINTS = {bool: "bool", int: "i64", float: "f64", str: "str", type(None): "null"}


def from_hint(hint: Any) -> Ty:
    """A typing annotation, tuple or list of types as a type."""
    if hint in _HINTS if isinstance(hint, type) or hint is None else False:
        return _HINTS[hint]
    if hint is None:
        return "null"
    if isinstance(hint, tuple):
        return ("tuple", *map(from_hint, hint))
    if isinstance(hint, list) and len(hint) == 1:
        return ("list", from_hint(hint[0]))
    origin, args = typing.get_origin(hint), typing.get_args(hint)
    if origin is tuple:
        return ("tuple", *map(from_hint, args))
    if origin is list:
        return ("list", from_hint(args[0]))
    if origin is dict:
        return ("dict", from_hint(args[0]), from_hint(args[1]))
    if type(None) in args and len(args) == 2:
        return opt(from_hint(next(a for a in args if a is not type(None))))
    raise TypeError(f"no dataset type for {hint!r}")


def fits(v: Any, t: Ty) -> bool:
    """Whether a Python value can be stored as t without change of meaning."""
    if t == "pyobj":
        return True
    if v is None:
        return nullable(t)
    t = base(t)
    if t == "bool":
        return isinstance(v, bool)
    if t == "i64":
        return isinstance(v, int) and -(1 << 63) <= v < 1 << 63
    if t == "f64":
        return isinstance(v, int | float) and (isinstance(v, float) or abs(v) <= 1 << 53)
    if t == "str":
        return isinstance(v, str)
    if t == "null":
        return False
    if t[0] == "tuple":
        return isinstance(v, tuple) and len(v) == len(t) - 1 and all(map(fits, v, t[1:]))
    if t[0] == "list":
        return isinstance(v, list) and all(fits(x, t[1]) for x in v)
    return isinstance(v, dict) and all(fits(k, t[1]) and fits(x, t[2]) for k, x in v.items())


def encode(v: Any, t: Ty) -> Any:
    """A Python value as Arrow takes it."""
    if t == "pyobj":
        return cloudpickle.dumps(v)
    if v is None:
        return None
    t = base(t)
    if t == "f64":
        return float(v)
    if t == "i64":
        return int(v)
    if isinstance(t, tuple):
        if t[0] == "tuple":
            return {f"_{i + 1}": encode(x, u) for i, (x, u) in enumerate(zip(v, t[1:], strict=True))}
        if t[0] == "list":
            return [encode(x, t[1]) for x in v]
        return [(encode(k, t[1]), encode(x, t[2])) for k, x in v.items()]
    return v


def decode(v: Any, t: Ty) -> Any:
    """A value from Arrow or a collected row as the Python value it stands for."""
    if v is None:
        return None
    if t == "pyobj":
        return pickle.loads(v)
    t = base(t)
    if isinstance(t, tuple):
        if t[0] == "tuple":
            values = v.values() if isinstance(v, dict) else v
            return tuple(decode(x, u) for x, u in zip(values, t[1:], strict=True))
        if t[0] == "list":
            return [decode(x, t[1]) for x in v]
        return {decode(k, t[1]): decode(x, t[2]) for k, x in (v.items() if isinstance(v, dict) else v)}
    return v


def name(t: Ty) -> Any:
    """The type as Python shows it: int, Optional[str], Tuple[...]."""
    simple = {"bool": bool, "i64": int, "f64": float, "str": str, "null": type(None), "pyobj": object}
    if isinstance(t, str):
        return simple[t]
    if t[0] == "opt":
        return typing.Optional[name(t[1])]  # noqa: UP045
    if t[0] == "tuple":
        return tuple[tuple(map(name, t[1:]))]
    return list[name(t[1])] if t[0] == "list" else dict[name(t[1]), name(t[2])]
