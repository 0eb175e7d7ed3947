"""String, list and dict methods as Spark expressions."""

from __future__ import annotations

import re
import string as _string
from typing import TYPE_CHECKING

from pyspark.sql import Column
from pyspark.sql import functions as F

from rowsmith.types import base, nullable

if TYPE_CHECKING:
    from rowsmith.plans.translate import Scope, Translator, V

_FOLDED = ("lower", "upper", "swapcase", "center", "strip", "lstrip", "rstrip", "find", "rfind", "index", "rindex", "replace", "split", "join", "startswith", "endswith", "count", "isdecimal", "isdigit", "isalpha", "isalnum", "format")
_CLASSES = {"isdecimal": "^\\p{Nd}+$", "isdigit": "^[\\p{Nd}\u00b2\u00b3\u00b9\u2070\u2074-\u2079\u2080-\u2089]+$", "isalpha": "^\\p{L}+$", "isalnum": "^[\\p{L}\\p{N}]+$"}


def _quoted(sep: str) -> str:
    return re.sub(r"([^A-Za-z0-9 ])", r"\\\1", sep)


def rfind(c: Column, part: Column) -> Column:
    """The last position of a part, or -1."""
    at = F.instr(F.reverse(c), F.reverse(part)) if not isinstance(part, str) else None
    return F.when(at > 0, F.length(c) - at - F.length(part) + 1).otherwise(F.lit(-1))


def method(t: Translator, owner: V, name: str, args: list[V], s: Scope, guard: Column | None) -> V:
    from rowsmith.plans.translate import WS, Unsupported, V, const

    if owner.known and all(a.known for a in args) and name in _FOLDED and isinstance(owner.const, str):
        try:
            return const(getattr(owner.const, name)(*(a.const for a in args)))
        except Exception as e:
            t.fail(s, guard, None, type(e).__name__)
            return V("i64", F.lit(None).cast("long"))
    if base(owner.type) == "null" or (base(owner.type) != "str" and owner.type in ("bool", "i64", "f64")):
        t.fail(s, guard, None, "AttributeError")
        return V("str", F.lit(None).cast("string"))
    if base(owner.type) != "str":
        raise Unsupported(f"{name} of {owner.type}")
    if nullable(owner.type):
        t.fail(s, guard, owner.col.isNull(), "AttributeError")
    c = owner.col
    text = lambda i: t.demand(args[i], ("str",), s, guard).col
    n = len(args)
    match name:
        case "lower" | "upper" if n == 0:
            return V("str", F.lower(c) if name == "lower" else F.upper(c))
        case "swapcase" if n == 0:
            if t.pure:
                raise Unsupported(name)
            letters = F.transform(F.split(c, ""), lambda x: F.when(x == F.upper(x), F.lower(x)).otherwise(F.upper(x)))
            return V("str", F.array_join(letters, ""))
        case "strip" | "lstrip" | "rstrip" if n <= 1:
            if n and base(args[0].type) != "null" and not args[0].known:
                raise Unsupported("strip from data")
            chars = F.lit(WS if n == 0 or args[0].const is None else args[0].const)
            return V("str", {"strip": F.btrim, "lstrip": F.ltrim, "rstrip": F.rtrim}[name](c, chars))
        case "find" | "index" if n == 1:
            at = t.keep_column((F.instr(c, text(0)) - 1).cast("long"))
            if name == "index":
                t.fail(s, guard, at < 0, "ValueError")
            return V("i64", at)
        case "rfind" | "rindex" if n == 1:
            if args[0].known and not args[0].const:
                at = F.length(c).cast("long")
            else:
                at = t.keep_column(rfind(c, text(0)).cast("long"))
            if name == "rindex":
                t.fail(s, guard, at < 0, "ValueError")
            return V("i64", at)
        case "replace" if n == 2:
            if not (args[0].known and args[0].const):
                raise Unsupported("replace of data or of nothing")
            return V("str", F.replace(c, text(0), text(1)))
        case "split" if n == 1:
            if not (args[0].known and isinstance(args[0].const, str)):
                raise Unsupported("split from data")
            if not args[0].const:
                t.fail(s, guard, None, "ValueError")
                return V(("list", "str"), F.array(F.lit("")))
            return V(("list", "str"), F.split(c, _quoted(args[0].const), -1))
        case "join" if n == 1:
            if args[0].parts is not None and args[0].type[0] in ("list", "tuple"):
                parts = [t.demand(p, ("str",), s, guard).col for p in args[0].parts]
                return V("str", F.concat_ws(owner.const, *parts) if owner.known else F.array_join(F.array(*parts), owner.const)) if parts and owner.known else const("")
            if args[0].type == ("list", "str") and owner.known:
                return V("str", F.array_join(args[0].col, owner.const))
            raise Unsupported("join")
        case "startswith" | "endswith" if n == 1 and base(args[0].type) == "str":
            return V("bool", c.startswith(text(0)) if name == "startswith" else c.endswith(text(0)))
        case "count" if n == 1:
            if not (args[0].known and args[0].const):
                raise Unsupported("count of data or of nothing")
            return V("i64", ((F.length(c) - F.length(F.replace(c, text(0), F.lit("")))) / len(args[0].const)).cast("long"))
        case "center" if 1 <= n <= 2 and args[0].known and (n == 1 or args[1].known):
            width, fill = args[0].const, args[1].const if n == 2 else " "
            gap = F.lit(width) - F.length(c)
            left = F.floor(gap / 2) + F.when((gap % 2 == 1) & (F.lit(width) % 2 == 1), 1).otherwise(0)
            padded = F.concat(F.repeat(F.lit(fill), left.cast("int")), c, F.repeat(F.lit(fill), (gap - left).cast("int")))
            return V("str", F.when(gap > 0, padded).otherwise(c))
        case "isdecimal" | "isdigit" | "isalpha" | "isalnum" if n == 0:
            return V("bool", c.rlike(_CLASSES[name]))
        case "format" if owner.known:
            return _format(t, owner.const, args)
    raise Unsupported(f"str.{name}")


def _format(t: Translator, template: str, args: list[V]) -> V:
    from rowsmith.plans.translate import Unsupported, V

    parts, auto = [], 0
    for literal, name, spec, conversion in _string.Formatter().parse(template):
        if literal:
            parts.append(F.lit(literal))
        if name is None:
            continue
        if conversion or (spec and not re.fullmatch(r"0?\d*d", spec)):
            raise Unsupported("format spec")
        if name == "":
            at, auto = auto, auto + 1
        elif name.isdigit():
            at = int(name)
        else:
            raise Unsupported("format field")
        if at >= len(args):
            raise Unsupported("format arguments")
        if spec:
            if args[at].type not in ("i64",):
                raise Unsupported("format spec")
            parts.append(F.format_string(f"%{spec}", args[at].col))
        else:
            parts.append(t.text(args[at]).col)
    return V("str", F.concat(*parts) if parts else F.lit(""))
