from __future__ import annotations

import hashlib
import random

from pyspark.sql import functions as F

from rowsmith.llm import simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def study(spark, rows):
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA).repartition(3)
    return simhash.edit_study(df.selectExpr("*", "1 as row", "2 as n", "3 as f")).collect()


def test_edits_and_likeness(spark):
    rnd = random.Random(1)
    rows = [(i * 7, " ".join(rnd.choice("abcdéßñ日🙂xyz") * rnd.randint(1, 5) for _ in range(rnd.choice([0, 1, 2, 50, 300])))) for i in range(60)]
    rows += [(1000, None), (1001, ""), (1002, " \n\t"), (1003, rows[5][1]), (1004, "a" * 100_001)]
    texts = {i: t or "" for i, t in rows}
    ids = sorted(texts, reverse=True)
    got = {r.doc_id: r for r in study(spark, rows)}
    assert set(got) == set(texts)
    by_text = {}
    for at, i in enumerate(ids):
        nxt = texts[ids[(at + 1) % len(ids)]]
        t, r = texts[i], got[i]
        k = len(t) // 2
        edited = t[: len(t) - k] + nxt[:k]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        by_text.setdefault(t, set()).add(r.fingerprint)
        by_text.setdefault(edited, set()).add(r.edited_fingerprint)
        f, e, n = (int(x, 16) for x in (r.fingerprint, r.edited_fingerprint, got[ids[(at + 1) % len(ids)]].fingerprint))
        assert r.near_edited == 1 - (f ^ e).bit_count() / 64 and r.near_next == 1 - (f ^ n).bit_count() / 64
    assert all(len(x) == 1 for x in by_text.values())
    long = [r for r in got.values() if 50_000 > r.n_chars > 500]
    assert sum(r.near_edited for r in long) > sum(r.near_next for r in long)
    distinct = {r.fingerprint for r in got.values()}
    for r in got.values():
        f = int(r.fingerprint, 16)
        assert r.n_near == sum((f ^ int(x, 16)).bit_count() <= 3 for x in distinct if x != r.fingerprint)
        assert r.class_id == min(x.doc_id for x in got.values() if x.fingerprint == r.fingerprint)


def test_votes_are_the_weighted_majority(spark):
    df = spark.createDataFrame([(1, "a b a b a b c d")], "doc_id long, text string")
    f = simhash.fingerprints(df, ["doc_id"], "text", "f").first().f
    hashes = [r.h for r in df.select(F.explode(simhash.terms(F.col("text"))).alias("h")).collect()]
    assert len(hashes) == 7
    expected = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > 7)
    assert f % (1 << 64) == expected


def test_all_pairs_within_radius(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CROWD", 7)
    rnd = random.Random(2)
    base = [rnd.getrandbits(64) for _ in range(5)]
    values = {b ^ sum(1 << k for k in rnd.sample(range(64), rnd.randint(0, 4))) for b in base for _ in range(40)}
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in values]
    got = {(r.x % (1 << 64), r.y % (1 << 64), r.distance) for r in simhash.near_pairs(spark.createDataFrame(signed, "f long"), "f").collect()}
    expected = {(x[0] % (1 << 64), y[0] % (1 << 64), (x[0] ^ y[0]).bit_count() if x[0] >= 0 <= y[0] else ((x[0] ^ y[0]) % (1 << 64)).bit_count()) for x in signed for y in signed if x[0] < y[0]}
    assert got == {e for e in expected if e[2] <= 3} and got


def test_empty_repeated_and_null_ids(spark):
    assert study(spark, []) == []
    out = study(spark, [(1, "x y z")])
    assert [(r.doc_id, r.near_next) for r in out] == [(1, 1.0)]
    out = study(spark, [(1, "x y z"), (1, "x y z"), (None, "q"), (None, None)])
    assert len(out) == 4 and {r.fingerprint for r in out if r.doc_id == 1}.__len__() == 1
