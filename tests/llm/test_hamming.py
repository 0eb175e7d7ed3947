from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from rowsmith.llm import hamming


def brute(rows, queries, k):
    out = set()
    for qid, q in queries:
        found = sorted((((q ^ c) % (1 << 64)).bit_count(), i) for i, c in rows)[:k]
        out |= {(qid, i, d, n + 1) for n, (d, i) in enumerate(found)}
    return out


def signed(v):
    return v - (1 << 64) if v >> 63 else v


@pytest.mark.parametrize(("seed", "n"), [(1, 30), (2, 600)])
def test_matches_brute_force(spark, monkeypatch, seed, n):
    monkeypatch.setattr(hamming, "CROWD", 16)
    monkeypatch.setattr(hamming, "FLIPS", 100)
    rnd = random.Random(seed)
    base = [rnd.getrandbits(64) for _ in range(6)]
    rows = [(i, signed(rnd.choice(base) ^ sum(1 << b for b in rnd.sample(range(64), rnd.choice([0, 0, 2, 9, 20]))))) for i in range(n)]
    df = spark.createDataFrame([*rows, (None, 5), (10**6, None)], "id long, code long")
    queries = df.where("id % 25 = 0")
    got = {tuple(r) for r in hamming.top_k(df, queries, 7).select("query_id", "id", "distance", "rank").collect()}
    assert got == brute(rows, [r for r in rows if r[0] % 25 == 0], 7)


def test_few_rows_and_copies(spark):
    df = spark.createDataFrame([(1, 0), (2, 0), (2, 0), (3, -1)], "id long, code long")
    got = sorted((r.query_id, r.id, r.distance) for r in hamming.top_k(df, df.where("id = 3"), 9).collect())
    assert got == [(3, 1, 64), (3, 2, 64), (3, 2, 64), (3, 3, 0)]
    assert hamming.top_k(df.limit(0), df.limit(0)).count() == 0
    assert hamming.top_k(df, df.limit(0)).count() == 0


def test_codes(spark):
    rnd = random.Random(1)
    long = [rnd.uniform(-1, 1) for _ in range(100)]
    df = spark.createDataFrame([(1, [0.5, -1.0, 2.0]), (2, None), (3, []), (4, long), (5, [1.0] * 64)], "id long, e array<float>")
    got = {r.id: r.c for r in df.select("id", hamming.code(F.col("e")).alias("c")).collect()}
    folded = sum(1 << i for i in range(64) if long[i] + (long[i + 64] if i + 64 < 100 else 0) > 0)
    assert (got[1], got[2], got[3], got[4], got[5]) == (5, None, None, signed(folded), -1)
