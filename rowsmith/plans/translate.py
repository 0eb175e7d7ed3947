"""Python functions as Catalyst expressions.

:func:`translate` evaluates a function's syntax tree symbolically.  Each value carries a
column, its type and a condition under which Python would raise.  Nothing raises
inside Spark: arithmetic uses forms that give null, and the error column, the first
error in Python's order of evaluation, says why.  What can't be kept exactly raises
:class:`Unsupported`, and the function then runs in a Python worker.
"""

from __future__ import annotations

import ast
import builtins
import math
import random
import re
import string
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from rowsmith import errors
from rowsmith import types as ty
from rowsmith.types import Ty, base, is_opt, nullable, opt, to_spark


class Unsupported(Exception):
    """The expression path can't keep this function's meaning."""


_NONE = object()
MAX_UNROLL, MAX_NODES = 64, 4000


@dataclass
class V:
    """A symbolic value. parts: a tuple's or row's members, keys: their names; const: a value known now."""

    type: Ty = "null"
    col: Column | None = None
    parts: list[V] | None = None
    keys: list[str | None] | None = None
    const: Any = _NONE
    special: Any = None  # ("match", pattern, subject), ("module", m), ("function", f), ("range"|"seq", list of V)

    @property
    def known(self) -> bool:
        return self.const is not _NONE


@dataclass
class Scope:
    """What a run of statements has done so far."""

    env: dict[str, V]
    errors: list[tuple[Column | None, Column]] = field(default_factory=list)
    returns: list[tuple[Column | None, V]] = field(default_factory=list)
    done: Column | None = None  # rows that have returned or raised
    finished: bool = False  # on every path


def const(v: Any) -> V:
    if isinstance(v, tuple):
        return V(ty.of_value(v) if v else ("tuple",), None, [const(x) for x in v], const=v)
    if isinstance(v, list):
        return V(ty.of_value(v), F.array(*(const(x).col for x in v)) if v and all(isinstance(x, int | float | str) for x in v) else None, [const(x) for x in v], const=v)
    if isinstance(v, dict):
        if all(isinstance(k, str) for k in v):
            return V(("dict", "str", ty.unify_all([ty.of_value(x) for x in v.values()])) if v else "dict0", None, [const(x) for x in v.values()], list(v), const=v)
        return V("constdict", None, const=v)
    t = ty.of_value(v)
    if t == "pyobj":
        raise Unsupported(f"constant {v!r}")
    return V(t, F.lit(v).cast(to_spark(t)), const=v)


def both(a: Column | None, b: Column | None) -> Column | None:
    return b if a is None else a if b is None else a & b


def column(v: V) -> Column:
    """The value as one Spark column of to_spark(v.type)."""
    if v.col is not None:
        return v.col
    if v.parts is not None and isinstance(v.type, tuple) and v.type[0] == "tuple" and len(v.type) > 1:
        return F.struct(*(column(p).cast(to_spark(t)).alias(f"_{i + 1}") for i, (p, t) in enumerate(zip(v.parts, v.type[1:], strict=True))))
    if v.parts and isinstance(v.type, tuple) and v.type[0] == "list":
        return F.array(*(column(p).cast(to_spark(v.type[1])) for p in v.parts))
    if v.parts and v.keys and isinstance(v.type, tuple) and v.type[0] == "dict" and v.type[2] != "pyobj":
        return F.create_map(*(c for k, p in zip(v.keys, v.parts, strict=True) for c in (F.lit(k), column(p).cast(to_spark(v.type[2])))))
    raise Unsupported("a value without a column form")


WS = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0                　"
_INT = "^[+-]?\\d+(_\\d+)*$"
_FLOAT = "^(?i)[+-]?((\\d+(_\\d+)*)?\\.?(\\d+(_\\d+)*)?(?<=[\\d.])(e[+-]?\\d+(_\\d+)*)?|inf|infinity|nan)$"
_NUMERIC = ("bool", "i64", "f64")


class Translator:
    def __init__(self, outer: dict[str, Any], upcast: bool = True, unchecked: bool = False):
        self.outer, self.upcast, self.unchecked = outer, upcast, unchecked
        self.lets: list[tuple[str, Column]] = []
        self.nodes = 0
        self.prefix = f"_let{random.getrandbits(40):x}_"
        self.pure = 0  # inside a lambda over array elements nothing may fail or be kept

    # -- statements ---------------------------------------------------------------

    def live(self, s: Scope, guard: Column | None) -> Column | None:
        return guard if s.done is None else both(guard, ~s.done)

    def fail(self, s: Scope, guard: Column | None, when: Column | None, name: str) -> None:
        """Records that the class is raised where ``when`` holds (None: everywhere)."""
        if self.unchecked and name in ("ZeroDivisionError", "OverflowError"):
            return
        if self.pure:
            raise Unsupported("an error inside a comprehension")
        live = self.live(s, guard)
        cond = both(live, None if when is None else F.coalesce(when, F.lit(False)))
        s.errors.append((cond, errors.literal(name)))

    def block(self, body: list[ast.stmt], s: Scope, guard: Column | None) -> None:
        for stmt in body:
            if s.finished:
                return
            self.statement(stmt, s, guard)

    def statement(self, n: ast.stmt, s: Scope, guard: Column | None) -> None:
        match n:
            case ast.Return():
                v = self.expr(n.value, s, guard) if n.value is not None else const(None)
                live = self.live(s, guard)
                s.returns.append((live, v))
                self.stop(s, guard)
            case ast.Assign(targets=[target]):
                self.assign(target, self.keep(self.expr(n.value, s, guard)), s)
            case ast.AnnAssign(target=target, value=ast.expr() as value):
                self.assign(target, self.keep(self.expr(value, s, guard)), s)
            case ast.AugAssign(target=ast.Name(id=name)):
                v = self.binary(n.op, self.name(name, s), self.expr(n.value, s, guard), s, guard)
                s.env[name] = self.keep(v)
            case ast.If():
                self.branch(n, s, guard)
            case ast.Raise():
                cls = n.exc.func if isinstance(n.exc, ast.Call) else n.exc
                found = self.outer.get(cls.id, getattr(builtins, cls.id, None)) if isinstance(cls, ast.Name) else None
                if not (isinstance(found, type) and issubclass(found, Exception)):
                    raise Unsupported("raise")
                if self.pure:
                    raise Unsupported("raise in a comprehension")
                s.errors.append((self.live(s, guard), F.lit(errors.chain(found))))
                self.stop(s, guard)
            case ast.Assert():
                t = self.truth(self.expr(n.test, s, guard))
                self.fail(s, guard, ~t, "AssertionError")
            case ast.Expr(value=ast.Constant()) | ast.Pass():
                pass
            case ast.Expr():
                self.expr(n.value, s, guard)
            case ast.For(target=target, orelse=[]):
                items = self.items(self.expr(n.iter, s, guard))
                if any(isinstance(x, ast.Break | ast.Continue) for b in n.body for x in ast.walk(b)):
                    raise Unsupported("break or continue")
                if len(items) > MAX_UNROLL:
                    raise Unsupported("a long loop")
                for item in items:
                    self.assign(target, item, s)
                    self.block(n.body, s, guard)
                    if s.finished:
                        return
            case ast.FunctionDef():
                s.env[n.name] = V(special=("local", [a.arg for a in n.args.args], n.body))
            case _:
                raise Unsupported(type(n).__name__)

    def stop(self, s: Scope, guard: Column | None) -> None:
        if guard is None:
            s.finished = True
        else:
            s.done = guard if s.done is None else s.done | guard

    def branch(self, n: ast.If, s: Scope, guard: Column | None) -> None:
        test = self.expr(n.test, s, guard)
        if test.known or base(test.type) == "null":
            self.block(n.body if test.known and test.const else n.orelse, s, guard)
            return
        t = self.keep_column(self.truth(test))
        yes, no = Scope(dict(s.env), s.errors, s.returns, s.done), Scope(dict(s.env), s.errors, s.returns, s.done)
        self.block(n.body, yes, both(guard, t))
        no.done = s.done
        self.block(n.orelse, no, both(guard, ~t))
        ended = [d for d in (yes.done, no.done) if d is not None and d is not s.done]
        if yes.finished and no.finished:
            s.finished = True
            return
        s.done = s.done if not ended else ended[0] if len(ended) == 1 else ended[0] | ended[1]
        names = set(yes.env) | set(no.env)
        merged = {}
        for name in names:
            a, b = yes.env.get(name), no.env.get(name)
            if a is None or b is None:
                found = a or b
                # Unbound on one path: only where that path has ended can it be used.
                if (a is None and yes.done is not None) or (b is None and no.done is not None):
                    merged[name] = found
                continue
            merged[name] = a if a is b else self.keep(self.choose(t, a, b, yes.done is not s.done and yes.done is not None, no.done is not s.done and no.done is not None))
        s.env = merged

    def choose(self, t: Column, a: V, b: V, a_gone: bool = False, b_gone: bool = False) -> V:
        """``a if t else b``; a type that doesn't fit is let pass where its path has ended."""
        if a.known and b.known and type(a.const) is type(b.const) and a.const == b.const:
            return a
        if a.parts is not None and b.parts is not None and len(a.parts) == len(b.parts) and a.keys == b.keys and a.col is None and b.col is None:
            parts = [self.choose(t, x, y) for x, y in zip(a.parts, b.parts, strict=True)]
            kind = a.type[0] if isinstance(a.type, tuple) else a.type
            if kind == "tuple":
                return V(("tuple", *(p.type for p in parts)), None, parts)
            return V(("dict", "str", ty.unify_all([p.type for p in parts])) if kind == "dict" else ("list", ty.unify_all([p.type for p in parts])), None, parts, a.keys)
        u = ty.unify(a.type, b.type, self.upcast) if isinstance(a.type, str | tuple) and isinstance(b.type, str | tuple) else None
        if u is None:
            if a_gone:
                return b
            if b_gone:
                return a
            raise Unsupported(f"branches of {a.type} and {b.type}")
        kind = to_spark(u)
        return V(u, F.when(t, column(a).cast(kind)).otherwise(column(b).cast(kind)))

    def keep(self, v: V) -> V:
        """Gives a computed value a column of its own, so that later uses don't repeat it."""
        if v.col is None or v.known or self.pure or v.special is not None or v.type == "null":
            return v
        return replace(v, col=self.keep_column(v.col))

    def keep_column(self, c: Column) -> Column:
        if self.pure:
            return c
        name = f"{self.prefix}{len(self.lets)}"
        self.lets.append((name, c))
        return F.col(name)

    def assign(self, target: ast.expr, v: V, s: Scope) -> None:
        if isinstance(target, ast.Name):
            s.env[target.id] = v
        elif isinstance(target, ast.Tuple) and (parts := self.members(v)) is not None and len(parts) == len(target.elts):
            for t, p in zip(target.elts, parts, strict=True):
                self.assign(t, self.keep(p), s)
        else:
            raise Unsupported("assignment target")

    def members(self, v: V) -> list[V] | None:
        if v.parts is not None:
            return v.parts
        if isinstance(v.type, tuple) and v.type[0] == "tuple" and v.col is not None:
            return [V(t, v.col.getField(f"_{i + 1}")) for i, t in enumerate(v.type[1:])]
        return None

    def items(self, v: V) -> list[V]:
        if v.special is not None and v.special[0] == "seq":
            return v.special[1]
        if v.known and isinstance(v.const, str):
            return [const(c) for c in v.const]
        if v.keys is not None and v.parts is not None:
            return [const(k) for k in v.keys]
        if v.parts is not None:
            return v.parts
        raise Unsupported("loop over data")

    # -- expressions --------------------------------------------------------------

    def name(self, name: str, s: Scope) -> V:
        if name in s.env:
            return s.env[name]
        if name in self.outer:
            return self.global_(self.outer[name])
        if hasattr(builtins, name):
            return V(special=("builtin", name))
        raise Unsupported(f"name {name}")

    def global_(self, v: Any) -> V:
        if v is math or v is re or v is random or v is string:
            return V(special=("module", v.__name__))
        if callable(v) and getattr(builtins, getattr(v, "__name__", ""), None) is v:
            return V(special=("builtin", v.__name__))
        if callable(v):
            from rowsmith.plans import source

            if getattr(v, "__module__", None) in ("math", "re", "random", "string"):
                return V(special=("call", v.__module__, v.__name__))
            udf = source.of(v)
            if udf.body is not None:
                return V(special=("outer", udf))
            raise Unsupported(f"function {v!r}")
        return const(v)

    def expr(self, n: ast.expr, s: Scope, guard: Column | None) -> V:
        self.nodes += 1
        if self.nodes > MAX_NODES:
            raise Unsupported("too large")
        match n:
            case ast.Constant():
                return const(n.value)
            case ast.Name():
                return self.name(n.id, s)
            case ast.BinOp():
                left = self.expr(n.left, s, guard)
                return self.binary(n.op, left, self.expr(n.right, s, guard), s, guard)
            case ast.UnaryOp():
                return self.unary(n.op, self.expr(n.operand, s, guard), s, guard)
            case ast.BoolOp():
                return self.logic(n, s, guard)
            case ast.Compare():
                return self.comparison(n, s, guard)
            case ast.IfExp():
                test = self.expr(n.test, s, guard)
                if test.known:
                    return self.expr(n.body if test.const else n.orelse, s, guard)
                t = self.keep_column(self.truth(test))
                return self.choose(t, self.expr(n.body, s, both(guard, t)), self.expr(n.orelse, s, both(guard, ~t)))
            case ast.Tuple():
                parts = [self.expr(e, s, guard) for e in n.elts]
                return V(("tuple", *(p.type for p in parts)), None, parts, const=tuple(p.const for p in parts) if parts and all(p.known for p in parts) else _NONE)
            case ast.List():
                parts = [self.expr(e, s, guard) for e in n.elts]
                element = ty.unify_all([p.type for p in parts])
                if element == "pyobj":
                    raise Unsupported("a mixed list")
                return V(("list", element), None, parts, const=[p.const for p in parts] if parts and all(p.known for p in parts) else _NONE)
            case ast.Dict() if all(isinstance(k, ast.Constant) and isinstance(k.value, str) for k in n.keys):
                parts = [self.expr(e, s, guard) for e in n.values]
                return V(("dict", "str", ty.unify_all([p.type for p in parts])), None, parts, [k.value for k in n.keys])
            case ast.Subscript():
                return self.subscript(self.expr(n.value, s, guard), n.slice, s, guard)
            case ast.Call():
                return self.call(n, s, guard)
            case ast.Attribute():
                v = self.expr(n.value, s, guard)
                if v.special and v.special[0] == "module":
                    found = getattr({"math": math, "re": re, "random": random, "string": string}[v.special[1]], n.attr)
                    return V(special=("call", v.special[1], n.attr)) if callable(found) else const(found)
                raise Unsupported(f"attribute {n.attr}")
            case ast.ListComp(generators=[ast.comprehension(target=ast.Name(id=name), ifs=ifs, is_async=0) as g]):
                return self.comprehension(n, name, g, ifs, s, guard)
            case ast.JoinedStr():
                return self.fstring(n, s, guard)
            case ast.Lambda():
                return V(special=("local", [a.arg for a in n.args.args], [ast.Return(n.body)]))
        raise Unsupported(type(n).__name__)

    def truth(self, v: V) -> Column:
        """Truthiness, never null."""
        if v.known:
            return F.lit(bool(v.const))
        if v.special and v.special[0] == "match":
            return F.coalesce(v.special[2].rlike(_java(v.special[1])), F.lit(False))
        if v.special and v.special[0] in ("seq", "range"):
            return F.lit(bool(v.special[1]))
        if v.parts is not None:
            return F.lit(len(v.parts) > 0)
        t, c = base(v.type), v.col
        if t == "null":
            return F.lit(False)
        if t == "bool":
            out = c
        elif t in ("i64", "f64"):
            out = c != 0
        elif t == "str":
            out = c != ""
        elif isinstance(t, tuple) and t[0] in ("list", "dict"):
            out = F.size(c) > 0
        elif isinstance(t, tuple):
            out = F.lit(True) if not nullable(v.type) else c.isNotNull()
        else:
            raise Unsupported(f"truth of {t}")
        return F.coalesce(out, F.lit(False)) if nullable(v.type) else out

    def demand(self, v: V, kinds: tuple[str, ...], s: Scope, guard: Column | None, name: str = "TypeError") -> V:
        """The value without None; None is recorded as an error. A type that never fits raises always."""
        if v.type == "null":
            self.fail(s, guard, None, name)
            return V(kinds[-1], F.lit(None).cast(to_spark(kinds[-1])))
        if is_opt(v.type):
            self.fail(s, guard, v.col.isNull(), name)
            v = replace(v, type=base(v.type))
        if v.type not in kinds:
            if v.special or not isinstance(v.type, str) or v.type in ("pyobj", "constdict", "dict0"):
                if isinstance(v.type, tuple) and v.type[0] in kinds:
                    return v
                raise Unsupported(f"{v.type} where {kinds} is needed")
            self.fail(s, guard, None, name)
            return V(kinds[-1], F.lit(None).cast(to_spark(kinds[-1])))
        return v

    def number(self, v: V, s: Scope, guard: Column | None) -> V:
        v = self.demand(v, _NUMERIC, s, guard)
        return V("i64", v.col.cast("long")) if v.type == "bool" else v

    def checked(self, out: Column, args: list[Column], s: Scope, guard: Column | None) -> V:
        """An integer result that is null beyond 64 bits."""
        present = args[0].isNotNull()
        for a in args[1:]:
            present = present & a.isNotNull()
        out = self.keep_column(out)
        if not self.pure:
            self.fail(s, guard, out.isNull() & present, "OverflowError")
        return V("i64", out)

    def binary(self, op: ast.operator, a: V, b: V, s: Scope, guard: Column | None) -> V:
        if a.known and b.known and not isinstance(a.const, dict):
            try:
                return const(_FOLD[type(op)](a.const, b.const))
            except Unsupported:
                raise
            except Exception as e:
                self.fail(s, guard, None, type(e).__name__)
                return V("i64", F.lit(None).cast("long"))
        ta, tb = base(a.type), base(b.type)
        if isinstance(op, ast.Add) and ta == tb == "str":
            return V("str", F.concat(self.demand(a, ("str",), s, guard).col, self.demand(b, ("str",), s, guard).col))
        if isinstance(op, ast.Add) and isinstance(ta, tuple) and isinstance(tb, tuple) and ta[0] == tb[0] and ta[0] in ("tuple", "list") and a.parts is not None and b.parts is not None:
            parts = a.parts + b.parts
            return V(("tuple", *(p.type for p in parts)) if ta[0] == "tuple" else ("list", ty.unify_all([p.type for p in parts])), None, parts)
        if isinstance(op, ast.Mult) and {ta, tb} <= {"str", "i64", "bool"} and "str" in (ta, tb) and ta != tb:
            text, times = (a, b) if ta == "str" else (b, a)
            return V("str", F.repeat(self.demand(text, ("str",), s, guard).col, F.greatest(F.lit(0), self.number(times, s, guard).col).cast("int")))
        if isinstance(op, ast.Mod) and ta == "str":
            return self.percent(a, b, s, guard)
        if isinstance(op, ast.BitAnd | ast.BitOr | ast.BitXor) and ta == tb == "bool":
            x, y = self.demand(a, ("bool",), s, guard).col, self.demand(b, ("bool",), s, guard).col
            return V("bool", x & y if isinstance(op, ast.BitAnd) else x | y if isinstance(op, ast.BitOr) else x != y)
        if not {ta, tb} <= {*_NUMERIC, "null", "str"}:
            raise Unsupported(f"{type(op).__name__} of {ta}, {tb}")
        x, y = self.number(a, s, guard), self.number(b, s, guard)
        whole = x.type == y.type == "i64"
        if not whole and isinstance(op, ast.LShift | ast.RShift | ast.BitAnd | ast.BitOr | ast.BitXor):
            self.fail(s, guard, None, "TypeError")
            return V("i64", F.lit(None).cast("long"))
        p, q = (x.col, y.col) if whole else (x.col.cast("double"), y.col.cast("double"))
        match op:
            case ast.Add() | ast.Sub() | ast.Mult():
                if whole:
                    f = {ast.Add: F.try_add, ast.Sub: F.try_subtract, ast.Mult: F.try_multiply}[type(op)]
                    return self.checked(f(p, q), [p, q], s, guard)
                return V("f64", p + q if isinstance(op, ast.Add) else p - q if isinstance(op, ast.Sub) else p * q)
            case ast.Div():
                self.zero(q, b, s, guard)
                return V("f64", F.try_divide(p.cast("double"), q.cast("double")))
            case ast.FloorDiv() | ast.Mod():
                self.zero(q, b, s, guard)
                safe = q if b.known and b.const else F.when(q != 0, q)
                rest = p % safe
                adjust = (rest != 0) & ((rest < 0) != (safe < 0))
                if isinstance(op, ast.Mod):
                    return V("i64" if whole else "f64", F.when(adjust, rest + safe).otherwise(rest))
                if whole:
                    least = (p == -(1 << 63)) & (safe == -1)  # the one quotient beyond 64 bits
                    down = F.call_function("div", F.when(~least, p - rest), safe)
                    if not (b.known and b.const != -1):
                        self.fail(s, guard, least, "OverflowError")
                    return V("i64", F.when(adjust, down - 1).otherwise(down))
                down = F.rint((p - rest) / safe)
                return V("f64", F.when(adjust, down - 1).otherwise(down))
            case ast.Pow():
                return self.power(x, y, b, p, q, whole, s, guard)
            case ast.LShift() | ast.RShift():
                if not (b.known and 0 <= b.const < 63):
                    raise Unsupported("shift by data")
                if isinstance(op, ast.RShift):
                    return V("i64", F.shiftright(p, b.const))
                return self.checked(F.try_multiply(p, F.lit(1 << b.const)) if b.const < 62 else F.lit(None).cast("long"), [p], s, guard)
            case ast.BitAnd():
                return V("i64", p.bitwiseAND(q))
            case ast.BitOr():
                return V("i64", p.bitwiseOR(q))
            case ast.BitXor():
                return V("i64", p.bitwiseXOR(q))
        raise Unsupported(type(op).__name__)

    def zero(self, q: Column, b: V, s: Scope, guard: Column | None) -> None:
        if not (b.known and b.const):
            self.fail(s, guard, q == 0, "ZeroDivisionError")

    def power(self, x: V, y: V, b: V, p: Column, q: Column, whole: bool, s: Scope, guard: Column | None) -> V:
        if whole and b.known and 0 <= b.const <= 8:
            out = V("i64", F.lit(1).cast("long"))
            for _ in range(b.const):
                out = self.checked(F.try_multiply(out.col, p), [out.col, p], s, guard)
            return out
        if whole and not (b.known and b.const < 0):
            raise Unsupported("int power of data")
        p, q = p.cast("double"), q.cast("double")
        self.fail(s, guard, (p == 0) & (q < 0), "ZeroDivisionError")
        if not (b.known and float(b.const).is_integer()):
            raise Unsupported("a power that may be complex")
        out = F.pow(p, q)
        self.fail(s, guard, (F.abs(out) == float("inf")) & (F.abs(p) < float("inf")) & (p != 0), "OverflowError")
        return V("f64", out)

    def unary(self, op: ast.unaryop, v: V, s: Scope, guard: Column | None) -> V:
        if isinstance(op, ast.Not):
            return V("bool", ~self.truth(v))
        if v.known:
            return const({ast.USub: lambda x: -x, ast.UAdd: lambda x: +x, ast.Invert: lambda x: ~x}[type(op)](v.const))
        x = self.number(v, s, guard)
        if isinstance(op, ast.USub):
            return V("f64", -x.col) if x.type == "f64" else self.checked(F.try_subtract(F.lit(0).cast("long"), x.col), [x.col], s, guard)
        if isinstance(op, ast.UAdd):
            return x
        if x.type != "i64":
            raise Unsupported("~float")
        return V("i64", F.bitwise_not(x.col))

    def logic(self, n: ast.BoolOp, s: Scope, guard: Column | None) -> V:
        out = self.expr(n.values[0], s, guard)
        for e in n.values[1:]:
            if out.known:
                if bool(out.const) == isinstance(n.op, ast.Or):
                    return out
                out = self.expr(e, s, guard)
                continue
            t = self.keep_column(self.truth(out))
            right = self.expr(e, s, both(guard, t if isinstance(n.op, ast.And) else ~t))
            if out.type == right.type == "bool" and out.col is not None:
                out = V("bool", (t & right.col) if isinstance(n.op, ast.And) else (t | right.col))
            else:
                out = self.choose(t, right, out) if isinstance(n.op, ast.And) else self.choose(t, out, right)
        return out

    def comparison(self, n: ast.Compare, s: Scope, guard: Column | None) -> V:
        left, out = self.expr(n.left, s, guard), None
        for op, e in zip(n.ops, n.comparators, strict=True):
            right = self.expr(e, s, both(guard, out))
            one = self.compare(op, left, right, s, both(guard, out))
            out = one if out is None else out & one
            left = right
        return V("bool", out)

    def compare(self, op: ast.cmpop, a: V, b: V, s: Scope, guard: Column | None) -> Column:
        if isinstance(op, ast.In | ast.NotIn):
            found = self.contains(a, b, s, guard)
            return ~found if isinstance(op, ast.NotIn) else found
        if isinstance(op, ast.Is | ast.IsNot):
            if not (a.known and a.const in (None, True, False)) and not (b.known and b.const in (None, True, False)):
                raise Unsupported("is")
            found = self.equal(a, b) if base(a.type) == base(b.type) or "null" in (a.type, b.type) else F.lit(False)
            return ~found if isinstance(op, ast.IsNot) else found
        if isinstance(op, ast.Eq | ast.NotEq):
            found = self.equal(a, b)
            return ~found if isinstance(op, ast.NotEq) else found
        ta, tb = base(a.type), base(b.type)
        f = {ast.Lt: lambda x, y: x < y, ast.LtE: lambda x, y: x <= y, ast.Gt: lambda x, y: x > y, ast.GtE: lambda x, y: x >= y}[type(op)]
        if a.known and b.known:
            return F.lit(f(a.const, b.const))
        if ta == tb == "str":
            return f(self.demand(a, ("str",), s, guard).col, self.demand(b, ("str",), s, guard).col)
        if not {ta, tb} <= {*_NUMERIC, "null", "str"}:
            raise Unsupported(f"order of {ta}, {tb}")
        if "str" in (ta, tb) and ta != tb:
            self.fail(s, guard, None, "TypeError")
            return F.lit(False)
        x, y = self.number(a, s, guard).col, self.number(b, s, guard).col
        if "f64" in (ta, tb):  # Spark holds NaN greatest; Python holds every comparison false
            return f(x, y) & ~F.isnan(x.cast("double")) & ~F.isnan(y.cast("double"))
        return f(x, y)

    def equal(self, a: V, b: V) -> Column:
        if a.special and a.special[0] == "match" and b.type == "null":
            return ~self.truth(a)
        if a.known and b.known:
            return F.lit(a.const == b.const)
        if "null" in (a.type, b.type):
            other = b if a.type == "null" else a
            return F.lit(other.type == "null") if not nullable(other.type) or other.type == "null" else other.col.isNull()
        ma, mb = self.members(a), self.members(b)
        if ma is not None and mb is not None and not a.keys and not b.keys:
            if len(ma) != len(mb):
                return F.lit(False)
            out = F.lit(True)
            for x, y in zip(ma, mb, strict=True):
                out = out & self.equal(x, y)
            return out
        ta, tb = base(a.type), base(b.type)
        if ta == tb == "str" or (ta in _NUMERIC and tb in _NUMERIC):
            x, y = a.col, b.col
            if ta != tb:
                kind = to_spark(ty.unify(ta, tb))
                x, y = x.cast(kind), y.cast(kind)
            out = x.eqNullSafe(y) if nullable(a.type) or nullable(b.type) else x == y
            return out & ~F.isnan(x.cast("double")) if "f64" in (ta, tb) and not (a.known or b.known) else out
        if ta in ("str", *_NUMERIC) and tb in ("str", *_NUMERIC):
            return F.lit(False) if not (nullable(a.type) and nullable(b.type)) else a.col.isNull() & b.col.isNull()
        raise Unsupported(f"== of {ta}, {tb}")

    def contains(self, a: V, b: V, s: Scope, guard: Column | None) -> Column:
        if b.special and b.special[0] == "range":
            return self.in_range(a, b.special[1])
        if base(b.type) == "str" and b.parts is None:
            text, part = self.demand(b, ("str",), s, guard), self.demand(a, ("str",), s, guard)
            return text.col.contains(part.col)
        if b.keys is not None:
            return self.contains(a, const(tuple(b.keys)), s, guard)
        if b.known and isinstance(b.const, dict):
            return self.contains(a, const(tuple(b.const)), s, guard)
        if b.parts is not None or (b.special and b.special[0] == "seq"):
            out = F.lit(False)
            for x in self.items(b):
                out = out | self.equal(a, x)
            return out
        if isinstance(base(b.type), tuple) and base(b.type)[0] == "list":
            if nullable(base(b.type)[1]) or base(b.type)[1] != base(a.type) or base(a.type) == "f64":
                raise Unsupported("in a list of data")
            return F.coalesce(F.array_contains(self.demand(b, ("list",), s, guard).col, a.col), F.lit(False))
        if isinstance(base(b.type), tuple) and base(b.type)[0] == "dict" and base(b.type)[1] == base(a.type):
            return F.coalesce(F.map_contains_key(self.demand(b, ("dict",), s, guard).col, a.col), F.lit(False))
        raise Unsupported("in")

    def in_range(self, a: V, r: range) -> Column:
        """Membership in a constant range that isn't empty, by its bounds and step."""
        kind = base(a.type)
        if a.known:
            return F.lit(a.const in r)
        if kind in ("null", "str"):
            return F.lit(False)
        if kind not in ("bool", "i64") or a.col is None or not all(-(1 << 62) <= x < 1 << 62 for x in (r[0], r[-1], r.step)):
            raise Unsupported(f"{kind} in a range")
        x, low, high = a.col.cast("long"), min(r[0], r[-1]), max(r[0], r[-1])
        found = F.when(x.between(low, high), F.pmod(x - F.lit(low).cast("long"), F.lit(abs(r.step)).cast("long")) == 0)
        return F.coalesce(found, F.lit(False))

    def subscript(self, v: V, index: ast.expr, s: Scope, guard: Column | None) -> V:
        if isinstance(index, ast.Slice):
            return self.slice(v, index, s, guard)
        i = self.expr(index, s, guard)
        if v.special and v.special[0] == "range":
            raise Unsupported("subscript of a long range")
        if v.special and v.special[0] == "match":
            if not (i.known and isinstance(i.const, int) and 0 <= i.const <= re.compile(v.special[1]).groups):
                raise Unsupported("match group")
            self.fail(s, guard, ~self.truth(v), "TypeError")
            return V("str", F.regexp_extract(v.special[2], _java(v.special[1]), i.const))
        if v.keys is not None and i.known and isinstance(i.const, str):
            if v.keys.count(i.const) == 0:
                self.fail(s, guard, None, "KeyError")
                return V("i64", F.lit(None).cast("long"))
            return v.parts[v.keys.index(i.const)]
        if v.known and isinstance(v.const, dict) and not i.known:
            return self.lookup(v.const, i, s, guard)
        if v.known and i.known:
            try:
                return const(v.const[i.const])
            except (LookupError, TypeError) as e:
                self.fail(s, guard, None, type(e).__name__)
                return V("i64", F.lit(None).cast("long"))
        t = base(v.type)
        members = self.members(v)
        if members is not None and not (isinstance(t, tuple) and t[0] == "dict"):
            if i.known and isinstance(i.const, int):
                if -len(members) <= i.const < len(members):
                    return members[i.const]
                self.fail(s, guard, None, "IndexError")
                return V("i64", F.lit(None).cast("long"))
            if t[0] == "list":
                v = V(v.type, column(v))
            else:
                raise Unsupported("tuple index from data")
        if t == "str":
            c = self.demand(v, ("str",), s, guard).col
            at = self.demand(i, ("bool", "i64"), s, guard).col.cast("long")
            n = F.length(c)
            self.fail(s, guard, (at >= n) | (at < -n), "IndexError")
            return V("str", F.substring(c, F.when(at >= 0, at + 1).otherwise(at + n + 1).cast("int"), F.lit(1)))
        if isinstance(t, tuple) and t[0] == "list":
            c = self.demand(v, ("list",), s, guard).col
            at = self.demand(i, ("bool", "i64"), s, guard).col.cast("long")
            n = F.size(c)
            self.fail(s, guard, (at >= n) | (at < -n), "IndexError")
            return V(t[1], F.get(c, F.when(at >= 0, at).otherwise(at + n).cast("int")))
        if isinstance(t, tuple) and t[0] == "dict" and v.col is not None and base(i.type) == t[1]:
            c = self.demand(v, ("dict",), s, guard).col
            self.fail(s, guard, ~F.map_contains_key(c, i.col), "KeyError")
            return V(t[2], F.try_element_at(c, i.col))
        raise Unsupported(f"subscript of {t}")

    def lookup(self, table: dict, i: V, s: Scope, guard: Column | None, default: V | None = None) -> V:
        """A constant dict read with a key from data."""
        if len(table) > 1000 or not table:
            raise Unsupported("dict size")
        values = ty.unify_all([ty.of_value(x) for x in table.values()])
        if base(values) not in ("bool", "i64", "f64", "str") or {ty.of_value(k) for k in table} != {base(i.type)}:
            raise Unsupported("dict of mixed types")
        m = F.create_map(*(F.lit(x) for kv in table.items() for x in kv))
        found = F.try_element_at(m, i.col).cast(to_spark(values))
        has = F.coalesce(F.map_contains_key(m, F.coalesce(i.col, F.lit(next(iter(table))))), F.lit(False)) & i.col.isNotNull()
        if default is None:
            self.fail(s, guard, ~has, "KeyError")
            return V(values, found)
        return self.choose(has, V(values, found), default)

    def slice(self, v: V, index: ast.Slice, s: Scope, guard: Column | None) -> V:
        step = self.expr(index.step, s, guard).const if index.step is not None else 1
        bounds = [None if e is None else self.expr(e, s, guard) for e in (index.lower, index.upper)]
        bounds = [None if b is not None and b.type == "null" else b for b in bounds]
        if v.parts is not None and all(b is None or b.known for b in bounds) and not v.keys and isinstance(step, int):
            parts = v.parts[slice(*(None if b is None else b.const for b in bounds), step)]
            kind = v.type[0]
            return V(("tuple", *(p.type for p in parts)) if kind == "tuple" else v.type, None, parts)
        if v.known and all(b is None or b.known for b in bounds):
            return const(v.const[slice(*(None if b is None else b.const for b in bounds), step)])
        if base(v.type) != "str":
            raise Unsupported("slice of data")
        c = self.demand(v, ("str",), s, guard).col
        if step == -1 and bounds == [None, None]:
            return V("str", F.reverse(c))
        if step != 1:
            raise Unsupported("slice step")
        n = F.length(c).cast("long")

        def bound(b: V | None, missing: Column) -> Column:
            if b is None:
                return missing
            if b.known:
                return F.least(F.lit(b.const).cast("long"), n) if b.const >= 0 else F.greatest(n + b.const, F.lit(0).cast("long"))
            at = self.demand(b, ("bool", "i64"), s, guard).col.cast("long")
            return F.when(at < 0, F.greatest(at + n, F.lit(0).cast("long"))).otherwise(F.least(at, n))

        lo, hi = bound(bounds[0], F.lit(0).cast("long")), bound(bounds[1], n)
        if bounds[0] is None:
            return V("str", F.substring(c, F.lit(1), hi.cast("int")))
        lo = self.keep_column(lo)
        return V("str", F.substring(c, (lo + 1).cast("int"), F.greatest(hi - lo, F.lit(0).cast("long")).cast("int")))

    def comprehension(self, n: ast.ListComp, name: str, g: ast.comprehension, ifs: list[ast.expr], s: Scope, guard: Column | None) -> V:
        it = self.expr(g.iter, s, guard)
        if it.parts is not None or it.special or it.known:
            if ifs or len(self.items(it)) > MAX_UNROLL:
                raise Unsupported("a filtered or long comprehension")
            parts = [self.expr(n.elt, _with(s, name, x), guard) for x in self.items(it)]
            element = ty.unify_all([p.type for p in parts])
            if element == "pyobj":
                raise Unsupported("a mixed list")
            return V(("list", element), None, parts)
        t = base(it.type)
        if t == "str":
            array, element = F.split(self.demand(it, ("str",), s, guard).col, ""), "str"
            array = F.filter(array, lambda x: x != "")
        elif isinstance(t, tuple) and t[0] == "list":
            array, element = self.demand(it, ("list",), s, guard).col, t[1]
        else:
            raise Unsupported("comprehension over data")
        found: list[Ty] = []

        def body(x: Column) -> Column:
            v = self.expr(n.elt, _with(s, name, V(element, x)), guard)
            found.append(v.type)
            return column(v)

        self.pure += 1
        try:
            for e in ifs:
                array = F.filter(array, self.keeps(e, name, element, s, guard))
            out = F.transform(array, body)
        finally:
            self.pure -= 1
        return V(("list", found[0]), out)

    def keeps(self, e: ast.expr, name: str, element: Ty, s: Scope, guard: Column | None):
        return lambda x: self.truth(self.expr(e, _with(s, name, V(element, x)), guard))

    # -- calls --------------------------------------------------------------------

    def call(self, n: ast.Call, s: Scope, guard: Column | None) -> V:
        from rowsmith.functions import modules, strings

        if n.keywords and not (isinstance(n.func, ast.Attribute) and n.func.attr in ("isclose",)):
            raise Unsupported("keyword arguments")
        if isinstance(n.func, ast.Attribute):
            owner = self.expr(n.func.value, s, guard)
            if owner.special and owner.special[0] == "module":
                args = [self.expr(a, s, guard) for a in n.args]
                named = {k.arg: self.expr(k.value, s, guard) for k in n.keywords}
                return modules.call(self, owner.special[1], n.func.attr, args, named, s, guard)
            args = [self.expr(a, s, guard) for a in n.args]
            if owner.special and owner.special[0] == "match":
                if n.func.attr == "group":
                    return self.subscript(owner, n.args[0] if n.args else ast.Constant(0), s, guard)
                raise Unsupported(n.func.attr)
            if owner.keys is not None and n.func.attr == "keys":
                return const(tuple(owner.keys))
            if n.func.attr == "get" and owner.known and isinstance(owner.const, dict) and args:
                return self.lookup(owner.const, args[0], s, guard, args[1] if len(args) > 1 else const(None))
            return strings.method(self, owner, n.func.attr, args, s, guard)
        f = self.expr(n.func, s, guard)
        args = [self.expr(a, s, guard) for a in n.args]
        match f.special:
            case ("builtin", name):
                return modules.builtin(self, name, args, s, guard)
            case ("call", module, name):
                return modules.call(self, module, name, args, {}, s, guard)
            case ("local", params, body):
                return self.inline(params, body, args, s, guard, dict(s.env))
            case ("outer", udf):
                inner = Translator(udf.outer, self.upcast, self.unchecked)
                inner.lets, inner.prefix, inner.pure, inner.nodes = self.lets, self.prefix, self.pure, self.nodes
                return inner.inline(udf.params, udf.body, args, s, guard, {})
        raise Unsupported("call")

    def inline(self, params: list[str], body: list[ast.stmt], args: list[V], s: Scope, guard: Column | None, env: dict[str, V]) -> V:
        if len(params) != len(args) or self.nodes > MAX_NODES:
            raise Unsupported("call of a function")
        self.nodes += 50
        inner = Scope({**env, **dict(zip(params, args, strict=True))}, s.errors, [], s.done)
        self.block(body, inner, guard)
        return self.returned(inner)

    def returned(self, s: Scope) -> V:
        if not s.finished:
            s.returns.append((None, const(None)))
        if not s.returns:
            return const(None)
        out = s.returns[-1][1]
        for cond, v in reversed(s.returns[:-1]):
            out = v if cond is None else self.choose(cond, v, out)
        return out

    def percent(self, a: V, b: V, s: Scope, guard: Column | None) -> V:
        args = b.parts if b.parts is not None and isinstance(b.type, tuple) and b.type[0] == "tuple" else [b]
        if not a.known:
            raise Unsupported("format from data")
        specs = re.findall(r"%(?:%|[-0 +]*\d*[ds])", a.const)
        if re.sub(r"%(?:%|[-0 +]*\d*[ds])", "", a.const).count("%") or len([x for x in specs if x != "%%"]) != len(args):
            raise Unsupported("format")
        given = []
        for spec, v in zip([x for x in specs if x != "%%"], args, strict=True):
            given.append(self.demand(v, ("bool", "i64"), s, guard).col.cast("long") if spec.endswith("d") else self.text(v).col)
        return V("str", F.format_string(a.const, *given))

    def text(self, v: V) -> V:
        """str(v) for types that Spark can show as Python does."""
        t = base(v.type)
        if v.known:
            return const(str(v.const))
        if t == "str":
            out = v.col
        elif t == "i64":
            out = v.col.cast("string")
        elif t == "bool":
            out = F.when(v.col, "True").when(~v.col, "False")
        else:
            raise Unsupported(f"str of {t}")
        return V("str", F.coalesce(out, F.lit("None")) if nullable(v.type) else out)

    def fstring(self, n: ast.JoinedStr, s: Scope, guard: Column | None) -> V:
        parts = []
        for p in n.values:
            if isinstance(p, ast.FormattedValue):
                if p.format_spec is not None or p.conversion not in (-1, 115):
                    raise Unsupported("format spec")
                parts.append(self.text(self.expr(p.value, s, guard)).col)
            else:
                parts.append(F.lit(p.value))
        return V("str", F.concat(*parts) if parts else F.lit(""))


def _with(s: Scope, name: str, v: V) -> Scope:
    return Scope({**s.env, name: v}, s.errors, s.returns, s.done)


def _java(pattern: str) -> str:
    from rowsmith.functions.modules import java

    return java(pattern)


_FOLD = {
    ast.Add: lambda a, b: a + b, ast.Sub: lambda a, b: a - b, ast.Mult: lambda a, b: a * b, ast.Div: lambda a, b: a / b, ast.FloorDiv: lambda a, b: a // b, ast.Mod: lambda a, b: a % b,
    ast.Pow: lambda a, b: a**b, ast.LShift: lambda a, b: a << b, ast.RShift: lambda a, b: a >> b, ast.BitAnd: lambda a, b: a & b, ast.BitOr: lambda a, b: a | b, ast.BitXor: lambda a, b: a ^ b,
}


@dataclass
class Translated:
    """value: the result; err: the error chain or None where nothing can fail; lets: columns to add first, in order."""

    value: V
    err: Column | None
    lets: list[tuple[str, Column]]


def arguments(params: list[str], columns: list[V], names: list[str | None]) -> dict[str, V]:
    """Binds a row to parameters: one gets the row (the bare value of one column), n get n columns."""
    if len(params) == 1:
        if len(columns) == 1:
            v = columns[0]
            bare = V(v.type, v.col, v.parts, v.keys, v.const, v.special)
            if names[0] is not None and v.parts is None:
                bare.keys, bare.parts = [names[0]], [v]
            return {params[0]: bare}
        return {params[0]: V(("tuple", *(c.type for c in columns)), None, columns, names)}
    if len(params) != len(columns):
        raise Unsupported("number of parameters")
    return dict(zip(params, columns, strict=True))


def translate(params: list[str], body: list[ast.stmt], outer: dict[str, Any], env: dict[str, V], upcast: bool = True, unchecked: bool = False) -> Translated:
    t = Translator(outer, upcast, unchecked)
    s = Scope(dict(env))
    t.block(body, s, None)
    value = t.returned(s)
    err = None
    if s.errors:
        err = F.coalesce(*(e if cond is None else F.when(cond, e) for cond, e in s.errors))
    return Translated(value, err, t.lets)
