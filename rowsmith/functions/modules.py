"""Built-in functions and the math, re, random and string modules as Spark expressions."""

from __future__ import annotations

import math
import re
import sys
import unicodedata
from itertools import islice
from typing import TYPE_CHECKING

from pyspark.sql import Column
from pyspark.sql import functions as F

from rowsmith import types as ty
from rowsmith.types import base

if TYPE_CHECKING:
    from rowsmith.plans.translate import Scope, Translator, V

_PLAIN = {"sin": F.sin, "tan": F.tan, "atan": F.atan, "cos": F.cos, "tanh": F.tanh, "asinh": F.asinh, "radians": F.radians, "degrees": F.degrees}
_OVERFLOW = {"sinh": F.sinh, "cosh": F.cosh, "exp": F.exp, "expm1": F.expm1}
#: Functions of a restricted domain: (Spark's function, where Python raises ValueError).
_DOMAIN = {
    "asin": (F.asin, lambda x: F.abs(x) > 1), "acos": (F.acos, lambda x: F.abs(x) > 1), "acosh": (F.acosh, lambda x: x < 1), "atanh": (F.atanh, lambda x: F.abs(x) >= 1),
    "sqrt": (F.sqrt, lambda x: x < 0), "log": (F.ln, lambda x: x <= 0), "log2": (F.log2, lambda x: x <= 0), "log10": (F.log10, lambda x: x <= 0), "log1p": (F.log1p, lambda x: x <= -1),
}
#: Every decimal digit of Unicode, and what it stands for.
_DIGITS = tuple("".join(x) for x in zip(*((chr(c), str(unicodedata.digit(chr(c)))) for c in range(128, sys.maxunicode + 1) if unicodedata.category(chr(c)) == "Nd"), strict=True))
_UNBOUND = {"sin": False, "tan": False, "cos": False}


def _null(kind: str) -> V:
    from rowsmith.plans.translate import V

    return V(kind, F.lit(None).cast(ty.to_spark(kind)))


def builtin(t: Translator, name: str, args: list[V], s: Scope, guard: Column | None) -> V:
    from rowsmith.plans.translate import MAX_NODES, MAX_UNROLL, Unsupported, V, const

    if name != "range" and any(a.special and a.special[0] == "range" for a in args):
        raise Unsupported(f"{name}() of a long range")
    foldable = ("int", "float", "bool", "str", "len", "abs", "range", "reversed", "enumerate", "zip", "min", "max", "sum", "round", "list", "tuple", "sorted", "ord", "chr")
    if name in foldable and args and all(a.known for a in args):
        try:
            out = getattr(__import__("builtins"), name)(*(a.const for a in args))
            if isinstance(out, range | enumerate | zip) or name == "reversed":
                if isinstance(out, range) and len(out) > MAX_UNROLL:
                    return V(("list", "i64"), special=("range", out))
                items = list(islice(out, MAX_NODES + 1))
                if len(items) > MAX_NODES:
                    raise Unsupported(f"{name}() of many items")
                return V(("list", "i64"), special=("seq", [const(x) for x in items]))
            return const(out)
        except Unsupported:
            raise
        except Exception as e:
            t.fail(s, guard, None, type(e).__name__)
            return _null("i64")
    if name == "dict" and not args:
        return const({})
    if name in ("int", "float") and len(args) == 1:
        return _parse(t, name, args[0], s, guard)
    if name == "bool" and len(args) == 1:
        return V("bool", t.truth(args[0]))
    if name == "str" and len(args) == 1:
        return t.text(args[0])
    if name == "len" and len(args) == 1:
        v = args[0]
        if v.parts is not None:
            return const(len(v.parts))
        kind = base(v.type)
        if kind == "str":
            return V("i64", F.length(t.demand(v, ("str",), s, guard).col).cast("long"))
        if isinstance(kind, tuple) and kind[0] in ("list", "dict"):
            return V("i64", F.size(t.demand(v, (kind[0],), s, guard).col).cast("long"))
        if isinstance(kind, tuple):
            return const(len(kind) - 1)
        t.fail(s, guard, None, "TypeError")
        return _null("i64")
    if name == "abs" and len(args) == 1:
        x = t.number(args[0], s, guard)
        return V("f64", F.abs(x.col)) if x.type == "f64" else t.checked(F.when(x.col < 0, F.try_subtract(F.lit(0).cast("long"), x.col)).otherwise(x.col), [x.col], s, guard)
    if name in ("min", "max") and len(args) > 1 and {base(a.type) for a in args} in ({"i64"}, {"f64"}, {"str"}):
        if base(args[0].type) == "f64":
            raise Unsupported("min and max of floats depend on the order of NaN")
        cols = [t.demand(a, ("str", "i64"), s, guard).col for a in args]
        return V(base(args[0].type), F.least(*cols) if name == "min" else F.greatest(*cols))
    if name == "reversed" and len(args) == 1 and args[0].parts is not None and not args[0].keys:
        return V(args[0].type, special=("seq", args[0].parts[::-1]))
    if name == "enumerate" and len(args) == 1:
        return V(("list", "i64"), special=("seq", [V(("tuple", "i64", x.type), None, [const(i), x]) for i, x in enumerate(t.items(args[0]))]))
    if name == "zip":
        rows = zip(*(t.items(a) for a in args), strict=False)
        return V(("list", "i64"), special=("seq", [V(("tuple", *(x.type for x in r)), None, list(r)) for r in rows]))
    raise Unsupported(f"{name}()")


def _parse(t: Translator, name: str, v: V, s: Scope, guard: Column | None) -> V:
    from rowsmith.plans.translate import _FLOAT, _INT, WS, V

    kind = base(v.type)
    if kind == "str":
        text = t.keep_column(F.btrim(t.demand(v, ("str",), s, guard).col, F.lit(WS)))
        text = t.keep_column(F.when(text.rlike("[^\\x00-\\x7f]"), F.translate(text, *_DIGITS)).otherwise(text))
        good = text.rlike(_INT if name == "int" else _FLOAT)
        t.fail(s, guard, ~good, "ValueError")
        plain = F.replace(text, F.lit("_"), F.lit(""))
        if name == "int":
            out = t.keep_column(F.when(good, plain.try_cast("long")))
            t.fail(s, guard, good & out.isNull(), "OverflowError")
            return V("i64", out)
        return V("f64", F.when(good, F.regexp_replace(plain, "(?i)^([+-]?)inf$", "$1Infinity").try_cast("double")))
    x = t.demand(v, ("bool", "i64", "f64"), s, guard)
    if name == "float":
        return V("f64", x.col.cast("double"))
    if x.type != "f64":
        return V("i64", x.col.cast("long"))
    t.fail(s, guard, F.isnan(x.col), "ValueError")
    t.fail(s, guard, F.abs(x.col) >= 2.0**63, "OverflowError")
    return V("i64", F.when(F.abs(x.col) < 2.0**63, x.col).try_cast("long"))


def call(t: Translator, module: str, name: str, args: list[V], named: dict[str, V], s: Scope, guard: Column | None) -> V:
    from rowsmith.plans.translate import Unsupported, V, const

    if module == "math" and all(a.known for a in args) and not named and args:
        try:
            return const(getattr(math, name)(*(a.const for a in args)))
        except (ValueError, OverflowError, TypeError) as e:
            t.fail(s, guard, None, type(e).__name__)
            return _null("f64")
    if module == "math":
        return _math(t, name, args, named, s, guard)
    if module == "re" and name == "search" and len(args) == 2 and args[0].known:
        _same_dialect(t, args[0].const, s, guard)
        return V("match", special=("match", args[0].const, t.demand(args[1], ("str",), s, guard).col))
    if module == "re" and name == "sub" and len(args) == 3 and args[0].known and args[1].known:
        _same_dialect(t, args[0].const, s, guard)
        if re.search(args[0].const, ""):
            raise Unsupported("a pattern that matches nothing")
        new = re.sub(r"\\(\d)", r"$\1", args[1].const.replace("$", "\\$")) if "\\" not in re.sub(r"\\\d", "", args[1].const) else None
        if new is None:
            raise Unsupported("replacement")
        return V("str", F.regexp_replace(t.demand(args[2], ("str",), s, guard).col, java(args[0].const), new))
    if module == "random" and name == "choice" and len(args) == 1 and not t.pure:
        v = args[0]
        if v.parts and v.type[0] == "list":
            v = V(v.type, F.array(*(p.col for p in v.parts)))
        array, element = (F.split(v.col, ""), "str") if base(v.type) == "str" else (v.col, base(v.type)[1])
        size = F.length(v.col) if base(v.type) == "str" else F.size(v.col)
        t.fail(s, guard, size == 0, "IndexError")
        return V(element, F.get(array, F.floor(F.rand() * size).cast("int")))
    if module == "string" and name == "capwords" and len(args) == 1:
        from rowsmith.plans.translate import WS

        c = t.demand(args[0], ("str",), s, guard, "AttributeError").col
        found = F.filter(F.split(c, "[" + WS.replace(" ", "\\x20", 1) + "]+"), lambda x: x != "")
        return V("str", F.array_join(F.transform(found, lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.lower(F.substring(x, F.lit(2), F.length(x))))), " "))
    raise Unsupported(f"{module}.{name}")


def _same_dialect(t: Translator, pattern: str, s: Scope, guard: Column | None) -> None:
    """Lets through only patterns that Java and Python read alike."""
    from rowsmith.plans.translate import Unsupported

    try:
        re.compile(pattern)
    except re.error as e:
        raise Unsupported("bad pattern") from e
    if re.search(r"\(\?P|\(\?[aiLmsux]|\\[AZzGQEhHvVRXpP]|\[\[|&&", pattern) or re.search(r"(?<!\\)\$(?!$)", pattern):
        raise Unsupported("regex dialect")


def java(pattern: str) -> str:
    """The pattern with Python's Unicode meaning of shorthand classes."""
    return "(?U)" + pattern if re.search(r"\\[dDsSwWbB]", pattern) else pattern


def _math(t: Translator, name: str, args: list[V], named: dict[str, V], s: Scope, guard: Column | None) -> V:
    from rowsmith.plans.translate import Unsupported, V

    x = t.number(args[0], s, guard)
    c = x.col.cast("double")
    if name in _PLAIN and len(args) == 1:
        if name in _UNBOUND:
            t.fail(s, guard, F.abs(c) == float("inf"), "ValueError")
        return V("f64", _PLAIN[name](c))
    if name in _OVERFLOW and len(args) == 1:
        out = t.keep_column(_OVERFLOW[name](c))
        t.fail(s, guard, (F.abs(out) == float("inf")) & (F.abs(c) < float("inf")), "OverflowError")
        return V("f64", out)
    if name in _DOMAIN and len(args) == 1:
        f, bad = _DOMAIN[name]
        t.fail(s, guard, bad(c) & ~F.isnan(c), "ValueError")
        return V("f64", F.when(F.isnan(c), c).when(~bad(c), f(c)))
    if name in ("ceil", "floor") and len(args) == 1:
        if x.type == "i64":
            return x
        t.fail(s, guard, F.isnan(c), "ValueError")
        t.fail(s, guard, F.abs(c) >= 2.0**63, "OverflowError")
        safe = F.when(F.abs(c) < 2.0**63, c)
        return V("i64", F.ceil(safe) if name == "ceil" else F.floor(safe))
    if name == "isnan":
        return V("bool", F.isnan(c))
    if name == "isinf":
        return V("bool", F.abs(c) == float("inf"))
    if name in ("atan2", "pow") and len(args) == 2:
        y = t.number(args[1], s, guard).col.cast("double")
        if name == "atan2":
            return V("f64", F.atan2(c, y))
        t.fail(s, guard, ((c == 0) & (y < 0)) | ((c < 0) & (y != F.rint(y)) & (F.abs(y) < float("inf"))), "ValueError")
        out = t.keep_column(F.when((c == 1) | (y == 0), F.lit(1.0)).otherwise(F.pow(c, y)))
        t.fail(s, guard, (F.abs(out) == float("inf")) & (F.abs(c) < float("inf")) & (F.abs(y) < float("inf")) & (c != 0), "OverflowError")
        return V("f64", out)
    if name == "isclose" and 2 <= len(args) <= 4:
        given = dict(zip(("rel_tol", "abs_tol"), args[2:], strict=False)) | named
        y = t.number(args[1], s, guard).col.cast("double")
        rel = given["rel_tol"].col.cast("double") if "rel_tol" in given else F.lit(1e-9)
        least = given["abs_tol"].col.cast("double") if "abs_tol" in given else F.lit(0.0)
        inf = float("inf")
        near = F.abs(c - y) <= F.greatest(rel * F.greatest(F.abs(c), F.abs(y)), least)
        nan = F.isnan(c) | F.isnan(y)
        return V("bool", F.when(nan, False).when(c == y, True).when((F.abs(c) == inf) | (F.abs(y) == inf), False).otherwise(near))
    raise Unsupported(f"math.{name}")
