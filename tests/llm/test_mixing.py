from __future__ import annotations

import random

import numpy as np
import pytest

from pyspark.sql import functions as F

from rowsmith.llm import mixing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(spark, n=300, seed=1):
    rnd = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        good = rnd.random() < 0.6
        words = ["".join(rnd.choices("abcdefgh", k=rnd.randint(2, 7))) for _ in range(rnd.randint(5, 80))]
        text = " ".join(words) if good else "%% ".join(words).upper()
        rows.append((i, text, "en", "src0" if i % 3 else "src1", len(text)))
        if i % 2:
            labels.append((i, "good" if good else "poor"))
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, domain string")


def totals(rows):
    out = {}
    for r in rows:
        for d, p in r.posterior.items():
            out[d] = out.get(d, 0.0) + r.rate * r.n_tokens * p
    return out


@pytest.mark.parametrize("weights", [{"good": 0.8, "poor": 0.2}, {"good": 0.2, "poor": 0.8}, {"good": 1.0}])
def test_expected_totals_match_targets(spark, weights):
    docs, labels = corpus(spark)
    rows = mixing.mix(docs, labels, weights).collect()
    assert len(rows) == 300 and all(r.rate >= 0 and abs(sum(r.posterior.values()) - 1) < 1e-9 for r in rows)
    tokens = sum(r.n_tokens for r in rows)
    reached = totals(rows)
    slack = 0.03 if len(weights) == 1 else 1e-4  # nothing but soft members carries the last crumbs of an excluded domain
    for d in ("good", "poor"):
        assert abs(reached[d] - weights.get(d, 0.0) * tokens) < slack * tokens
    assert all(r.copies in (int(r.rate), int(r.rate) + 1) for r in rows)
    # Brute force: the same projected steps with plain arrays reach the same residual or worse.
    p = np.array([[r.posterior["good"], r.posterior["poor"]] for r in rows])
    t = np.array([r.n_tokens for r in rows])
    target = np.array([weights.get("good", 0), weights.get("poor", 0)]) * tokens
    rate = np.ones(len(t))
    for _ in range(20_000):
        rate = np.maximum(0, rate + 0.5 / tokens * p @ (target - p.T @ (t * rate)))
    brute = np.abs(target - p.T @ (t * rate)).sum()
    assert np.abs(target - np.array([reached["good"], reached["poor"]])).sum() <= brute + 1e-3 * tokens


def test_classifier_is_right_on_unlabelled_rows(spark):
    docs, labels = corpus(spark, seed=2)
    rows = mixing.mix(docs, labels, factors={"poor": 0.5}).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert sum((r.posterior["poor"] > 0.5) == ("%%" in texts[r.doc_id] or texts[r.doc_id].isupper()) for r in rows) > 290


def test_edge_cases_and_copies(spark):
    docs, labels = corpus(spark, 60)
    odd = spark.createDataFrame([(None, None, None, None, None), (1000, "", "en", "s", 0), (1000, "", "en", "s", 0), (1001, "word " * 50_000, "en", "s", 0)], SCHEMA)
    docs = docs.unionByName(odd).selectExpr("*", "1 as rate", "2 as row", "3 as draw", "4 as x")
    rows = mixing.mix(docs, labels.unionByName(spark.createDataFrame([(None, "good"), (3, None), (9999, "odd")], labels.schema)), {"good": 0.5, "poor": 0.5}).collect()
    assert len(rows) == 64 and all(np.isfinite(r.rate) for r in rows)
    assert next(r for r in rows if r.doc_id == 1001).n_tokens == 50_000
    none = mixing.mix(docs, labels.limit(0)).collect()
    assert {(r.rate, r.copies) for r in none} == {(1.0, 1)} and len(none) == 64
    assert mixing.mix(docs.limit(0), labels).count() == 0
    mixed = mixing.mix(docs, labels, factors={"good": 2.0, "poor": 0.0})
    out = mixing.apply_copies(docs, mixed)
    assert out.columns == docs.columns and out.count() == sum(r.copies for r in mixed.collect())


def test_more_domains_than_are_kept(spark, monkeypatch):
    """The rarer domains are one, "other", with the sum of their targets."""
    monkeypatch.setattr(mixing, "DOMAINS", 3)
    rows = [(i, "ABC " * 20 if i % 5 == 0 else "12 34 " * 15 if i % 5 == 1 else "abc def " * 10) for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labelled = spark.createDataFrame([(i, "up" if i % 5 == 0 else "num" if i % 5 == 1 else f"rare{i % 7}") for i in range(100)], "doc_id long, domain string")
    domains, weights, _ = mixing.fit(docs.select("doc_id", F.array(*mixing.statistics(F.col("text"))).alias("x")).join(labelled, "doc_id"))
    assert len(domains) == 3 and mixing.OTHER in domains and len(weights) == 3
    out = mixing.mix(docs, labelled, weights={"up": 0.5, "num": 0.25, "rare1": 0.15, "rare2": 0.1})
    total = out.selectExpr("sum(rate * n_tokens * posterior['other']) / sum(rate * n_tokens)").first()[0]
    assert out.count() == 100 and abs(total - 0.25) < 0.02
    assert all(abs(r.rate - 1) < 1e-3 for r in mixing.mix(docs, labelled, factors=lambda d: 1.0).collect())


def test_copies_keep_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, "a b", 7, 8, 9), (2, "c", 7, 8, 9)], "doc_id long, text string, _copies int, copies int, draw int")
    mixed = mixing.mix(docs, spark.createDataFrame([], "doc_id long, domain string"))
    out = mixing.apply_copies(docs, mixed)
    assert out.columns == docs.columns and sorted(map(tuple, out.collect())) == [(1, "a b", 7, 8, 9), (2, "c", 7, 8, 9)]
