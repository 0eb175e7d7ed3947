from __future__ import annotations

import itertools
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from rowsmith.llm import _kernels as K
from rowsmith.llm import toxicity as tx

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_forward_backward_is_exact():
    rng = np.random.default_rng(1)
    length = np.array([1, 2, 3, 6])
    node = np.where(np.arange(6) < length[:, None], rng.normal(size=(4, 6)), 0.0)
    enter, leave, stay = moves = np.array([0.3, -0.7, 1.1])
    log_z, marginal, counts = tx.forward_backward(node, length, moves)
    total = np.zeros(3)
    for i, n in enumerate(length):
        weights, tags = [], list(itertools.product([0, 1], repeat=int(n)))
        for t in tags:
            s = sum(node[i, k] for k in range(n) if t[k])
            s += sum({(0, 0): 0.0, (0, 1): enter, (1, 0): leave, (1, 1): stay}[p] for p in itertools.pairwise(t))
            weights.append(np.exp(s))
        z = sum(weights)
        assert np.isclose(log_z[i], np.log(z))
        for k in range(n):
            assert np.isclose(marginal[i, k], sum(w for w, t in zip(weights, tags) if t[k]) / z)
        for j, move in enumerate([(0, 1), (1, 0), (1, 1)]):
            total[j] += sum(w * sum(p == move for p in itertools.pairwise(t)) for w, t in zip(weights, tags)) / z
    assert np.allclose(counts, total)


def corpus(seed, n):
    rnd = random.Random(seed)
    vocabulary = ["".join(rnd.choices("abcdefgh", k=rnd.randint(2, 8))) for _ in range(600)]
    rows = []
    for i in range(n):
        lines = [rnd.choices(vocabulary, k=rnd.randint(1, 30)) for _ in range(rnd.randint(1, 5))]
        toxic = rnd.random() < 0.2
        if toxic:
            for _ in range(rnd.randint(1, 3)):
                rnd.choice(lines).insert(0, rnd.choice(["idiot", "Moron!", "zqwxk" + rnd.choice(vocabulary)]))
        rows.append((i, "\n".join(map(" ".join, lines)), toxic))
    return rows


@pytest.fixture(scope="module")
def model():
    rows = corpus(1, 800)
    return tx.fit([t.encode() for _, t, _ in rows], np.array([x for *_, x in rows]), 0.2)


def score(model, texts):
    data, offsets = K.string_buffers(pa.array(texts, pa.string()))
    evidence, spans = tx.score_texts(model, data, offsets)
    return 1 / (1 + np.exp(-(model.curve[0] * tx._logit(evidence) + model.curve[1]))), spans


def test_held_out_accuracy_and_spans(model):
    rows = corpus(2, 500)
    p, spans = score(model, [t for _, t, _ in rows])
    toxic = np.array([x for *_, x in rows])
    assert ((p >= 0.5) == toxic).mean() > 0.98
    found = [t.encode()[a:b].decode().lower() for (_, t, _), s in zip(rows, spans) for a, b, _ in s]
    assert found and all(any(w in f for w in ("idiot", "moron", "zqwxk")) for f in found)


def test_plain_chains_and_batches_agree(model):
    texts = ["ab cd " * 300, "", "idiot", "ab\n\ncd idiot", "x" * 1000, "ab"]
    together, _ = score(model, texts)
    alone = np.array([score(model, [t])[0][0] for t in texts])
    assert np.allclose(together, alone)
    for n in (1, 2, 7, 500):
        node = np.full((1, n), model.weights[-1])
        assert np.isclose(tx._plain_log_z(model, n), tx.forward_backward(node, np.array([n]), model.moves)[0][0])


def test_over_tables(spark):
    rows = corpus(3, 300)
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t, _ in rows] + [(None, "Idiot é Moron", None, None, None), (900, None, "", "", 0), (900, None, "", "", 0), (901, "\n" * 5000, "", "", 0)], SCHEMA).selectExpr("*", "1 as score", "0 as toxic")
    labels = spark.createDataFrame([(i, 1, int(x)) for i, _, x in rows] + [(None, None, None), (5000, None, 1)], "doc_id long, quality int, toxic int")
    field = tx.train(docs, labels)
    out = tx.toxicity(docs, field).collect()
    assert len(out) == 304 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)
    assert {r.predicted for r in out if r.doc_id == 900} == {0}
    odd = next(r for r in out if r.doc_id is None)
    assert [("Idiot é Moron"[s.start : s.end]) for s in odd.spans][0].startswith("Idiot")
    held = {r.doc_id for r in docs.where(tx.held_out(docs.doc_id, 5, 0)).collect()}
    assert held == {r.doc_id for r in out if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0}
    kept = tx.drop_toxic(docs, field)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in out if not r.predicted)
    assert tx.toxicity(docs.limit(0), field).count() == 0 and tx.drop_toxic(docs.limit(0), field).count() == 0


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "a", "", "", 0)], SCHEMA)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert tx.train(docs, labels) is None
    assert [(r.score, r.predicted) for r in tx.toxicity(docs, None).collect()] == [(0.0, 0)]


def test_fit_without_tokens_or_telling_features(spark):
    assert tx.fit([b"!!!", b"???"], np.array([True, False]), 0.5).hashes.size == 0
    docs = spark.createDataFrame([(1, "!!!"), (2, "???"), (3, None), (4, "word")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 2)) for i in (1, 2, 3, 4)], "doc_id long, toxic int")
    out = tx.toxicity(docs, tx.train(docs, labels)).collect()
    assert len(out) == 4 and len({r.score for r in out}) == 1 and not any(r.spans for r in out)


def test_gradient_of_the_documents_likelihood():
    """The expected counts, weighted as in the fit, are the derivative of the labels' likelihood."""
    rng = np.random.default_rng(3)
    length = np.array([3, 5, 2, 4])
    owner, toxic = np.array([0, 0, 1, 2]), np.array([True, False, True])
    inside = np.arange(5) < length[:, None]
    node = np.where(inside, rng.normal(-1, 1, (4, 5)), 0.0)
    moves = np.array([0.4, -0.6, 0.9])

    def likelihood(node, moves):
        quiet = -np.bincount(owner, weights=tx.forward_backward(node, length, moves)[0], minlength=3)
        return np.where(toxic, np.log(-np.expm1(quiet)), quiet).sum()

    log_z, marginal, counts = tx.forward_backward(node, length, moves, each=True)
    some = np.exp(-np.bincount(owner, weights=log_z, minlength=3))
    pull = np.where(toxic, some / (1 - some), -1.0)[owner]
    for i, t in ((0, 0), (1, 4), (2, 1), (3, 2)):
        d = np.zeros_like(node)
        d[i, t] = 1e-5
        assert np.isclose((likelihood(node + d, moves) - likelihood(node - d, moves)) / 2e-5, pull[i] * marginal[i, t], rtol=1e-4)
    for j in range(3):
        d = 1e-5 * np.eye(3)[j]
        assert np.isclose((likelihood(node, moves + d) - likelihood(node, moves - d)) / 2e-5, (pull * counts[:, j]).sum(), rtol=1e-4)


def test_phrases_that_no_single_word_tells():
    """Toxic where two harmless words meet: only the pair's feature tells, and the span may hold both."""
    rnd = random.Random(5)
    vocabulary = ["".join(rnd.choices("abcdefgh", k=5)) for _ in range(60)] + ["green", "frog"] * 8
    rows = []
    for i in range(900):
        words = " ".join(rnd.choices(vocabulary, k=40)).replace("green frog", "green").split()
        toxic = i % 4 == 0
        if toxic:
            at = rnd.randint(0, len(words))
            words[at:at] = ["green", "frog"]
        rows.append((" ".join(words), toxic))
    model = tx.fit([t.encode() for t, _ in rows[:600]], np.array([x for _, x in rows[:600]]), 0.25)
    p, spans = score(model, [t for t, _ in rows[600:]])
    toxic = np.array([x for _, x in rows[600:]])
    assert ((p >= 0.5) == toxic).mean() > 0.95  # without a pair: 0.75
    assert sum("frog" in t[a:b] for (t, _), s in zip(rows[600:], spans) for a, b, _ in s) >= 0.9 * toxic.sum()
