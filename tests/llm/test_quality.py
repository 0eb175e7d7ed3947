from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow as pa

from rowsmith.llm import _kernels as K
from rowsmith.llm import quality as q

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def brute(text):
    """Some of the statistics, by plain Python."""
    raw = text.encode()
    words = raw.split()
    lines = text.split("\n") if not text.endswith("\n") else text[:-1].split("\n")
    n, w = max(1, len(raw)), max(1, len(words))
    low = [x.lower() for x in words]
    return {
        "log_bytes": np.log1p(len(raw)), "log_words": np.log1p(len(words)), "word_bytes": sum(map(len, words)) / w, "upper": sum(65 <= b <= 90 for b in raw) / n, "pipe": raw.count(b"|") / n,
        "distinct_words": len(set(low)) / w, "repeated_next": sum(a == b for a, b in zip(low, low[1:])) / w, "top_word": max((low.count(x) for x in low), default=0) / w, "distinct_lines": len(set(map(str.lower, lines))) / len(lines),
    }


def test_statistics_match_plain_python():
    texts = ["", "One two two\nthree | x", "a\na\nb", "ÄÖ ü!! ÄÖ", "x", "AAA BBB ccc\n", "\n\n", "%%% $$$ the The the"]
    data, offsets = K.string_buffers(pa.array([*texts, None]))
    got = q.statistics(data, offsets)
    assert np.isfinite(got).all() and (got[0] == 0).all() and (got[-1] == 0).all()
    for row, text in zip(got[1:], texts[1:]):
        for name, value in brute(text).items():
            assert np.isclose(row[q.STATISTICS.index(name)], value), (text, name)
    for i, text in enumerate(texts):
        assert np.allclose(q.statistics(*K.string_buffers(pa.array([text])))[0], got[i])


def test_pooling_is_the_isotonic_fit():
    x, ones, count = np.arange(6.0), np.array([1, 0, 3, 2, 9, 9.0]), np.array([4, 5, 5, 6, 10, 9.0])
    at, rate = q.pool(x, ones, count)
    assert (np.diff(at) > 0).all() and (np.diff(rate) >= 0).all()
    # Pools of the brute-force solution: {0, 1}, {2, 3}, {4}, {5}.
    assert np.allclose(rate[1:-1], [1.5 / 10, 5.5 / 12, 9.5 / 11, 9.5 / 10])


def junk(rnd, text):
    kind = rnd.randrange(3)
    return text.upper().replace(" ", "!! ") if kind == 0 else text.replace(" ", " | ") if kind == 1 else " ".join(w for w in text.split() for _ in range(5))


def test_held_out_accuracy(spark):
    rnd = random.Random(1)
    rows = []
    for i in range(600):
        text = " ".join("".join(rnd.choices("abcdefgh", k=rnd.randint(1, 9))) for _ in range(rnd.randint(10, 150))) + "."
        good = rnd.random() < 0.7
        rows.append((i, text if good else junk(rnd, text), int(good)))
    docs = spark.createDataFrame([(i, t, "", "", 0) for i, t, _ in rows] + [(None, None, None, None, None), (1, "", "", "", 0)], SCHEMA).selectExpr("*", "1 as stats", "1 as y", "1 as fold")
    labels = spark.createDataFrame([(i, y, 0) for i, _, y in rows] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    out = q.quality(docs, labels).collect()
    assert len(out) == 602 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in out)
    truth = {i: y for i, _, y in rows}
    held = [r for r in out if r.doc_id not in (None, 1) and zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.95
    assert q.quality(docs.limit(0), labels).count() == 0


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "a", "", "", 0)], SCHEMA)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert q.quality(docs, labels).first().score == 0.5
