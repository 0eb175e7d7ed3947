"""The Python path's worker on single batches, without Spark."""

from __future__ import annotations

import pickle
from collections import Counter

import pyarrow as pa
import pytest

from rowsmith import errors
from rowsmith import types as ty
from rowsmith.operators import python_rows as pr

N = 4000
ARROW = {"i64": pa.int64(), "f64": pa.float64(), "bool": pa.bool_(), "str": pa.string(), "pyobj": pa.binary()}


@pytest.fixture
def calls(monkeypatch):
    """How often the functions of single values are called."""
    count = Counter()
    for module, name in ((ty, "decode"), (ty, "of_value"), (ty, "fits"), (ty, "encode")):
        monkeypatch.setattr(module, name, lambda *a, f=getattr(module, name), n=name: (count.update([n]), f(*a))[1])
    return count


def ran(f, columns, handlers=(), err=None):
    """(types, rows) of a map over one batch, its types from a pass over all results as in a query."""
    names, data = list(columns), [pa.array(v) for v in columns.values()]
    types = [ty.opt({a: t for t, a in ARROW.items()}[c.type]) for c in data]
    batch = pa.RecordBatch.from_arrays([*data, *([pa.array(err, pa.string())] if err else [])], names=[*names, *(["_err"] if err else [])])
    group, seen = pr.Group("map", f, False, None, list(handlers)), pr.Seen(True)
    for values in pr.results(group, names, types, names, bool(err))(batch):
        seen.values(values, True, None)
    out, _, spread = seen.columns()
    cols = [f"v{i}" for i in range(len(out))]
    schema = pa.schema([*((c, ARROW[ty.base(t)]) for c, t in zip(cols, out, strict=True)), ("_err", pa.string())])
    (made,) = pr.worker(group, names, types, names, cols, out, [], schema, bool(err), spread)(iter([batch]))
    return out, [tuple(pickle.loads(v) if isinstance(v, bytes) else v for v in r.values()) for r in made.to_pylist()]


def test_batches_are_taken_by_columns(calls):
    """Plain values cost no call of their own: not to unpack, type, check or pack them."""
    k = list(range(N))
    types, rows = ran(lambda k, p: {"d": (k - 3000) // -7, "half": p % 100.0 < 50, "s": None if k % 3 else "x"}, {"k": k, "p": [x * 1.5 for x in k]})
    assert types == [("opt", "i64"), ("opt", "bool"), ("opt", "str")]
    assert rows == [((x - 3000) // -7, x * 1.5 % 100.0 < 50, None if x % 3 else "x", None) for x in k]
    assert calls.total() < N / 10


def test_odd_values_among_columns():
    """What doesn't fit is set aside by row; numbers mix, subclasses and None stay what they are."""
    k = list(range(N))
    types, rows = ran(lambda k: (2**63 if k == 7 else k, True if k % 2 else k, 0.5 if k == 9 else k), {"k": k})
    assert types == [("opt", "i64"), ("opt", "i64"), ("opt", "f64")]
    assert rows[7] == (None, None, None, errors.chain(OverflowError)) and rows[9] == (9, 1, 0.5, None)
    assert all(r == (x, 1 if x % 2 else x, float(x), None) for x, r in enumerate(rows) if x not in (7, 9))
    types, rows = ran(lambda k: k if k != 7 else {"a": 1} if k is not None else (), {"k": k})
    assert types == ["pyobj"] and rows[7] == ({"a": 1}, None) and rows[8] == (8, None)
    types, rows = ran(lambda k, f, b, s: (s, b, f, k), {"k": [1, None, -(2**63)], "f": [None, float("inf"), -0.0], "b": [True, False, None], "s": ["é", None, ""]})
    assert rows == [("é", True, None, 1, None), (None, False, float("inf"), None, None), ("", None, -0.0, -(2**63), None)]
    assert types == [("opt", "str"), ("opt", "bool"), ("opt", "f64"), ("opt", "i64")]
    types, rows = ran(lambda k: 1 << k, {"k": [1, 62, 60, 1]}, err=[None, "KeyError|Exception", None, None])
    assert rows == [(2, None), (None, "KeyError|Exception"), (1 << 60, None), (2, None)]


def test_errors_leave_no_rows_behind():
    """What a row raised is freed without the garbage collector."""
    import gc
    import weakref

    class Big:
        pass

    kept = []

    def f(k):
        big = Big()
        kept.append(weakref.ref(big))
        raise KeyError(big)

    gc.disable()
    try:
        call = pr.Group("map", f, False, None, [(ValueError, None)]).bound(["k"])
        assert call((1,)) == (None, "KeyError|LookupError|Exception|BaseException") and kept[0]() is None
    finally:
        gc.enable()


def test_handlers_of_many_rows(calls):
    """Each handler takes what those before it left; plain results cost no call of their own."""

    def second(k, n):
        assert n != 2
        return {"k": k, "n": n, "v": -1.0}

    def first(k, n):
        return {"k": k, "n": n, "v": 8.0 / (n - 3) if n != 2 else 1 // (n - n)} if n != 5 else [][n]

    n = [x % 7 for x in range(N)]
    types, rows = ran(first, {"k": list(range(N)), "n": n}, [(ArithmeticError, second), (AssertionError, lambda k, n: {"k": k, "n": n, "v": -2.0}), (ArithmeticError, None)])
    assert calls.total() < N / 10
    want = [(None, None, None, "IndexError|LookupError|Exception|BaseException") if x == 5 else (k, x, {2: -2.0, 3: -1.0}[x] if x in (2, 3) else 8.0 / (x - 3), None) for k, x in enumerate(n)]
    assert rows == want and types == [("opt", "i64"), ("opt", "i64"), ("opt", "f64")]
    _, rows = ran(lambda k, n: 1 // n, {"k": n, "n": n}, [(LookupError, None), (ZeroDivisionError, None)])
    assert rows == [(1 // x, None) for x in n if x]


def test_rows_by_name(calls):
    """A row holds its values alone; the places of names belong to all rows of the columns."""
    rows = []
    call = pr.Group("map", rows.append, False, None).bound(["a", None, "b", "a"])
    assert call((1, 2, 3, 4)) == call((5, 6, 7, 8)) == (None, None)
    row = rows[0]
    assert type(row) is type(rows[1]) and not hasattr(row, "__dict__")
    assert (row["a"], row["b"], row[1], row[-1], row[1:3], row.keys()) == (1, 3, 2, 4, (2, 3), ["a", None, "b", "a"])
    assert row == (1, 2, 3, 4) and type(pickle.loads(pickle.dumps(row))) is tuple
    for key, cls in (("c", KeyError), (4, IndexError), (None, TypeError)):
        with pytest.raises(cls):
            row[key]
    k = list(range(N))
    types, got = ran(lambda x: {"k": x["k"], "size": "low" if x["q"] < 10 else "high"}, {"k": k, "q": [x * 0.5 for x in k]})
    assert got == [(x, "low" if x < 20 else "high", None) for x in k] and types == [("opt", "i64"), ("opt", "str")] and calls.total() < N / 10
    assert ran(lambda x: x, {"k": [1, 2], "s": ["u", None]})[1] == [(1, "u", None), (2, None, None)]
