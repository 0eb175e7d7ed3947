"""Every expression on both paths against CPython, over a grid of values."""

from __future__ import annotations

import math
import random
import re
import string

import pytest

from rowsmith import Context

INTS = [(7, 3), (-7, 3), (7, -3), (-7, -3), (0, 5), (5, 0), (1, None), (None, 1), (2**62, 4), (-(2**63), -1)]
FLOATS = [(1.5, 2.0), (-7.5, 2.0), (7.25, -2.0), (0.0, 0.0), (float("inf"), 1.0), (float("nan"), 1.0), (1e300, 1e300), (2.0, 0.5), (None, 1.0)]
STRINGS = ["", "abc", "Hello World", "  pad\t", "12", "-7", "1_000", "1.5", "nan", " 42 ", "x,y,,z", "ünïcödé Straße", "AAA", "a1", "٣", "%", "a\nb", None]

INT_FUNCTIONS = [
    lambda a, b: a + b, lambda a, b: a - b, lambda a, b: a * b, lambda a, b: a / b, lambda a, b: a // b, lambda a, b: a % b, lambda a, b: a**2, lambda a, b: -a, lambda a, b: ~a, lambda a, b: a & b, lambda a, b: a | b,
    lambda a, b: a ^ b, lambda a, b: a >> 2, lambda a, b: a < b, lambda a, b: a <= b < 10, lambda a, b: a == b, lambda a, b: a != b, lambda a, b: a is None, lambda a, b: b is not None, lambda a, b: a and b, lambda a, b: a or b,
    lambda a, b: not a, lambda a, b: a if b else 9, lambda a, b: a in (7, 0, None), lambda a, b: a not in [7, 0], lambda a, b: abs(a), lambda a, b: str(a), lambda a, b: bool(a), lambda a, b: float(a), lambda a, b: "%d-%05d" % (a, b),
    lambda a, b: "{}/{}".format(a, b), lambda a, b: f"{a}:{b}", lambda a, b: (a, b)[0], lambda a, b: {"x": a, "y": b}["y"], lambda a, b: [i * 2 for i in (1, 2)], lambda a, b: min(a, b), lambda a, b: max(a, b), lambda a, b: a == 1.0, lambda a, b: "x" * b,
    lambda a, b: {7: "s", -7: "m"}.get(a, "none"), lambda a, b: {7: 1, 0: 2}[a], lambda a, b: math.floor(a), lambda a, b: (1, 2, 3)[5] if a == 7 else 1, lambda a, b: len((a, b)), lambda a, b: a + True,
]
FLOAT_FUNCTIONS = [
    lambda a, b: a + b, lambda a, b: a * b, lambda a, b: a / b, lambda a, b: a // b, lambda a, b: a % b, lambda a, b: a**2, lambda a, b: a**-1, lambda a, b: a < b, lambda a, b: a > b, lambda a, b: a == b, lambda a, b: int(a), lambda a, b: bool(a),
    lambda a, b: math.sqrt(a), lambda a, b: math.log(a), lambda a, b: math.log10(a), lambda a, b: math.log1p(a), lambda a, b: math.exp(a), lambda a, b: math.sin(a), lambda a, b: math.acos(a), lambda a, b: math.atanh(a), lambda a, b: math.acosh(a),
    lambda a, b: math.ceil(a), lambda a, b: math.floor(a), lambda a, b: math.isnan(a), lambda a, b: math.isinf(a), lambda a, b: math.isclose(a, b), lambda a, b: math.isclose(a, b, rel_tol=0.5), lambda a, b: math.pow(a, b), lambda a, b: math.atan2(a, b),
    lambda a, b: abs(a), lambda a, b: a + 1, lambda a, b: math.pi * a, lambda a, b: math.sinh(a), lambda a, b: math.degrees(a),
]
STRING_FUNCTIONS = [
    lambda s: s.lower(), lambda s: s.upper(), lambda s: s.swapcase(), lambda s: s.center(9), lambda s: s.center(8, "*"), lambda s: s.strip(), lambda s: s.lstrip(), lambda s: s.rstrip("cd "), lambda s: s.find("l"), lambda s: s.rfind("l"),
    lambda s: s.index("b"), lambda s: s.rindex("b"), lambda s: s.replace("a", "<>"), lambda s: s.split(","), lambda s: s.split("||"), lambda s: "-".join(s.split(",")), lambda s: s.startswith("a"), lambda s: s.endswith("d"), lambda s: s.count("A"),
    lambda s: s.isdecimal(), lambda s: s.isdigit(), lambda s: s.isalpha(), lambda s: s.isalnum(), lambda s: int(s), lambda s: float(s), lambda s: bool(s), lambda s: len(s), lambda s: s[0], lambda s: s[-1], lambda s: s[2], lambda s: s[1:3],
    lambda s: s[-3:], lambda s: s[:-1], lambda s: s[::-1], lambda s: s[5:2], lambda s: s + "!", lambda s: s * 2, lambda s: s == "abc", lambda s: s < "b", lambda s: "b" in s, lambda s: s if s else "empty", lambda s: s or "none", lambda s: [c for c in s],
    lambda s: [c.upper() for c in s if c != "a"], lambda s: re.sub("[aeiou]+", "_", s), lambda s: re.sub("(l)(o)", r"\2\1", s), lambda s: re.search("[0-9]+", s)[0], lambda s: re.search("(a)(b)", s) is None, lambda s: re.search(r"\w+", s)[0],
    lambda s: string.capwords(s), lambda s: s.split(",")[1], lambda s: s.lower().strip().replace("l", "L"), lambda s: "%s|" % s, lambda s: s[s.find("l") :], lambda s: s[: s.rfind("o")], lambda s: s > 1, lambda s: s.split(""), lambda s: s.nosuch(),
]


def expected(f, rows, spread):
    out, counts = [], {}
    for i, r in enumerate(rows):
        try:
            v = f(*r) if spread else f(r)
            if isinstance(v, int) and not isinstance(v, bool) and not -(2**63) <= v < 2**63:
                raise OverflowError
            out.append((i, v))
        except Exception as e:
            counts[type(e).__name__] = counts.get(type(e).__name__, 0) + 1
    return out, counts


def same(a, b):
    if isinstance(a, float) and isinstance(b, float | int) and not isinstance(b, bool):
        return (math.isnan(a) and math.isnan(b)) or a == b or math.isclose(a, b, rel_tol=1e-12)
    if isinstance(a, tuple) and isinstance(b, tuple):
        return len(a) == len(b) and all(map(same, a, b))
    return a == b and isinstance(a, bool) == isinstance(b, bool)


def check(spark, f, rows, spread, name, python):
    """One dataset for each function: i rides along, so that rows can be told apart."""
    c = Context({"forcePython": True} if python else None, spark=spark)
    data = [(i, *r) if spread else (i, r) for i, r in enumerate(rows)]
    columns = ["i", "a", "b"] if spread else ["i", "a"]
    ds = c.parallelize(data, columns=columns)
    ds = ds.withColumn("out", lambda x: f(x["a"], x["b"]) if spread else f(x["a"])) if python else _with(ds, f, spread)
    got = {r[0]: r[-1] for r in ds.collect()}
    want, counts = expected(f, rows, spread)
    assert set(got) == {i for i, _ in want}, (name, got, want, ds.exception_counts, counts)
    for i, v in want:
        assert same(got[i], v), (name, rows[i], got[i], v)
    assert ds.exception_counts == counts, name
    return ds


def _with(ds, f, spread):
    return ds.withColumn("out", (lambda x: f(x["a"], x["b"])) if spread else (lambda x: f(x["a"])))


@pytest.mark.parametrize("f", INT_FUNCTIONS, ids=range(len(INT_FUNCTIONS)))
def test_ints(spark, f):
    check(spark, f, INTS, True, "int", False)


@pytest.mark.parametrize("f", FLOAT_FUNCTIONS, ids=range(len(FLOAT_FUNCTIONS)))
def test_floats(spark, f):
    check(spark, f, FLOATS, True, "float", False)


@pytest.mark.parametrize("f", STRING_FUNCTIONS, ids=range(len(STRING_FUNCTIONS)))
def test_strings(spark, f):
    check(spark, f, STRINGS, False, "string", False)


def test_both_paths_agree_on_some(spark):
    for f in (INT_FUNCTIONS[4], INT_FUNCTIONS[5]):
        check(spark, f, INTS, True, "python", True)
    for f in (STRING_FUNCTIONS[9], STRING_FUNCTIONS[23]):
        check(spark, f, STRINGS, False, "python", True)


def test_random_choice(spark):
    c = Context(spark=spark)
    assert set(c.parallelize([1] * 50).map(lambda x: random.choice("abc")).collect()) <= set("abc")
    assert set(c.parallelize([1] * 50).map(lambda x: random.choice([4, 5])).collect()) <= {4, 5}


def test_long_ranges(spark):
    values = [-5, -1, 0, 1, 63, 64, 999, 1000, 1001, 2500, 4998, 4999, 5000, 2**62]
    c = Context(spark=spark)
    for f in (lambda x: x in range(5000), lambda x: x not in range(1, 5000, 2), lambda x: x in range(4999, -3, -4), lambda x: x in list(range(3000)), lambda x: x in range(3000)[:2000]):
        assert c.parallelize(values).filter(f).collect() == [x for x in values if f(x)]
        assert c.parallelize([None, *values]).map(f).collect() == [f(x) for x in [None, *values]]
    assert c.parallelize([1, 2]).map(lambda x: len(range(5000)) + x).collect() == [5001, 5002]
    assert c.parallelize([1, 2]).map(lambda x: range(5000)[-1] + x).collect() == [5000, 5001]
    assert c.parallelize([1.5, 2500.0, 5000.0]).filter(lambda x: x in range(5000)).collect() == [2500.0]
