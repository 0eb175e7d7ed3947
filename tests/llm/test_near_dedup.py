from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from rowsmith.llm import _kernels as K
from rowsmith.llm import near_dedup as nd

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def brute(rows, k=4, percent=80):
    def shingle_set(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        if not words:
            return set()
        return {tuple(words)} if len(words) < k else {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}

    sets = {}
    for i, text in rows:
        sets.setdefault(i, []).append(shingle_set(text))
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    return {i: (sorted(map(len, sets[i])), find(i)) for i in ids}


def corpus(seed, n=60):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    out = []
    for i in range(n):
        if out and rnd.random() < 0.6:
            words = rnd.choice(out)[1].split()
            for _ in range(rnd.randint(0, max(1, len(words) // 25))):
                words[rnd.randrange(len(words))] = rnd.choice(vocabulary)
        else:
            words = rnd.choices(vocabulary, k=rnd.choice([1, 2, 3, 4, 5, 8, 30, 100, 400]))
        out.append((i * 3, " ".join(words)))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_components_match_brute_force(spark, seed):
    rows = corpus(seed)
    rows += [(1000, None), (1001, ""), (1002, " \t\n"), (1003, "One TWO"), (1004, "one two"), (1005, rows[0][1].upper()), (1006, "é É x y z"), (1007, "É é x y z")]
    rnd = random.Random(seed)
    rnd.shuffle(rows)
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA)
    got = {r.doc_id: ([r.n_shingles], r.component_id) for r in nd.near_duplicates(df, k=4).collect()}
    assert got == brute(rows)


def test_hot_bucket_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(nd, "BLOCK", 8)
    rnd = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(80):
        words = list(base)
        for _ in range(rnd.randint(1, 5)):
            words[rnd.randrange(len(words))] = f"n{rnd.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA)
    got = {r.doc_id: ([r.n_shingles], r.component_id) for r in nd.near_duplicates(df, k=4).collect()}
    assert got == brute(rows)


def test_edge_cases_and_dedup(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert nd.near_duplicates(empty).count() == 0 and nd.deduplicate(empty).count() == 0
    text = " ".join(f"a{i}" for i in range(50))
    rows = [(5, text, None, None, None), (3, text, "en", "s", 1), (3, text, "en", "s", 1), (None, text, "en", "s", 1), (None, None, None, None, None), (7, "x " * 200_000, "en", "s", 1)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as n_shingles", "2 as rep", "3 as component")
    out = nd.deduplicate(df)
    assert out.columns == df.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in out.collect()) == [(False, 3), (False, 7), (True, 0), (True, 0)]


def test_same_id_with_two_texts_is_one_document(spark):
    a, b = " ".join(f"a{i}" for i in range(50)), " ".join(f"b{i}" for i in range(50))
    df = spark.createDataFrame([(1, a, "", "", 0), (2, a, "", "", 0), (2, b, "", "", 0), (4, b, "", "", 0), (5, "z", "", "", 0)], SCHEMA)
    assert {r.doc_id: r.component_id for r in nd.near_duplicates(df).collect()} == {1: 1, 2: 1, 4: 1, 5: 5}


def test_word_hashes_do_not_depend_on_place():
    texts = ["Abc déf\x0bghi abc", "", "   ", "abc", "x" * 100_000 + " abc"]
    data, offsets = K.string_buffers(pa.array(texts))
    starts, ends, hashes, word_offsets = K.words(data, offsets)
    found = [bytes(data[s:e]).decode().lower() for s, e in zip(starts, ends)]
    assert found == [w for t in texts for w in re.findall(r"[^\x20\x09-\x0D]+", t.lower())]
    assert len(set(zip(found, hashes.tolist()))) == len(set(found)) == len(set(hashes.tolist()))
    assert word_offsets.tolist() == [0, 4, 4, 4, 5, 7]


def test_estimate_is_close():
    rng = np.random.default_rng(3)
    base = np.sort(rng.integers(0, 2**63, 4000, dtype=np.uint64) * np.uint64(2))
    other = np.sort(np.concatenate([base[:3200], rng.integers(0, 2**63, 800, dtype=np.uint64)]))
    x, y = nd.sketches([base, other])
    assert abs(nd.likeness(x, y) - 3200 / 4800) < 0.2 and nd.likeness(x, x) > 0.99


def test_deduplicate_keeps_columns_of_any_name(spark):
    text = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(1, text, 5, 6), (2, text, 5, 6), (2, "other words here", 5, 6), (None, text, 5, 6)], "doc_id long, text string, _row int, kept int")
    out = nd.deduplicate(docs)
    assert out.columns == docs.columns and sorted((r.doc_id or 0) for r in out.collect()) in ([0, 1], [0, 1, 2])


def test_family_of_edits_confirms_few_pairs(spark, monkeypatch):
    """Edits of one text that are less alike than the threshold don't become candidates by the pair."""
    rnd = random.Random(9)
    vocabulary = [f"v{i}" for i in range(2)]
    base = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(rnd.choice(vocabulary) if rnd.random() < 0.033 else w for w in base)) for i in range(150)]
    rows += [(1000 + i, t.replace("w200 ", "z ")) for i, t in rows[:10]]
    put, stored = nd.Store.put, {}

    def counted(self, df, name):
        out = put(self, df, name)
        stored[name] = out.count()
        return out

    monkeypatch.setattr(nd.Store, "put", counted)
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA)
    got = {r.doc_id: ([r.n_shingles], r.component_id) for r in nd.near_duplicates(df, k=4).collect()}
    assert got == brute(rows)
    assert stored["rest-pairs"] < 3 * len(rows)


def test_fine_estimate_loses_no_link():
    rng = np.random.default_rng(4)
    alike = nd._likely_alike(80)
    for size in (1, 2, 5, 10, 40, 400, 3000, 20000):
        for _ in range(40):
            shared = rng.integers(0, 2**64, -(-8 * size // 10), dtype=np.uint64)
            more = rng.integers(0, 2**64, size - len(shared), dtype=np.uint64)
            x, y = np.sort(np.concatenate([shared, more[::2]])), np.sort(np.concatenate([shared, more[1::2]]))
            a, b = (nd._fine_registers(pa.array([r.tobytes() for r in nd.fine_sketches([s])], pa.binary())) for s in (x, y))
            assert alike(a, b, np.array([len(x) + len(y)])).all()
    x, y = (np.sort(rng.integers(0, 2**64, 400, dtype=np.uint64)) for _ in range(2))
    x[:290] = y[:290]
    a, b = (nd._fine_registers(pa.array([r.tobytes() for r in nd.fine_sketches([np.sort(s)])], pa.binary())) for s in (x, y))
    assert not alike(a, b, np.array([800])).any()
