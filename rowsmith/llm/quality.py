"""Document quality by random Fourier features, ridge scores and isotonic calibration.

Each whole text becomes a vector of ``len(STATISTICS)`` document statistics, scaled by the
labelled rows' moments.  ``FEATURES`` random Fourier features approximate a Gaussian
kernel over these vectors; every partition of the labelled rows sums its own normal
equations, by fold, and a few small matrices are added up on the driver, which solves
the ridge system.  Scores of each fold under the other folds' solution, in
``BINS`` bins counted by Spark, give an isotonic curve, by pooling adjacent violators.

All labelled rows that aren't held out take part; what reaches the driver is bounded by
``SUMS`` matrices and ``BINS`` counts, whatever the data.

Defined cases: null and empty texts have zero statistics and are scored as such; with no
labelled row every score is 0.5; repeated rows score alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowsmith.llm import _kernels as K
from rowsmith.llm._store import Store
from rowsmith.llm.toxicity import held_out

STATISTICS = (
    "log_bytes", "log_words", "word_bytes", "word_bytes_sd", "letters", "upper", "digits", "high_bytes", "space", "comma", "stop", "exclaim", "pipe",
    "hash", "money", "percent", "ampersand", "star", "other_symbols", "distinct_words", "repeated_next", "top_word", "line_words", "distinct_lines", "upper_words", "symbol_words",
)
FEATURES, FOLDS, RIDGE, SEED = 128, 4, 1e-3, 20240229
SUMS, BINS, THRESHOLD = 64, 512, 0.7
_MARKS = [",", ".", "!", "|", "#", "$", "%", "&", "*"]
_SYMBOLS = [b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in _MARKS]


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of document statistics for each text, from its whole bytes."""
    n = len(offsets) - 1
    size = np.diff(offsets).astype(float)
    total = np.maximum(size, 1)
    out = np.zeros((n, len(STATISTICS)))
    if not len(data):
        return out
    owner = np.repeat(np.arange(n), np.diff(offsets))
    counts = np.bincount(owner * 256 + data, minlength=n * 256).reshape(n, 256).astype(float)
    share = counts / total[:, None]
    upper, lower, digit = share[:, 65:91].sum(1), share[:, 97:123].sum(1), share[:, 48:58].sum(1)
    starts, ends, hashes, word_offsets = K.words(data, offsets)
    words = np.diff(word_offsets)
    many = np.maximum(words, 1).astype(float)
    w_owner = np.repeat(np.arange(n), words)
    length = (ends - starts).astype(float)
    mean = np.bincount(w_owner, length, n) / many
    spread = np.sqrt(np.maximum(np.bincount(w_owner, length**2, n) / many - mean**2, 0))
    distinct, top = np.zeros(n), np.zeros(n)
    if len(hashes):
        order = np.lexsort((hashes, w_owner))
        h, o = hashes[order], w_owner[order]
        first = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (o[1:] != o[:-1]))))
        run = np.diff(np.append(first, len(h)))
        distinct = np.bincount(o[first], minlength=n) / many
        np.maximum.at(top, o[first], run / many[o[first]])
    again = np.zeros(n)
    if len(hashes) > 1:
        again = np.bincount(w_owner[1:], (hashes[1:] == hashes[:-1]) & (w_owner[1:] == w_owner[:-1]), n) / many
    first_byte, last_byte, second = data[starts], data[ends - 1], data[np.minimum(starts + 1, len(data) - 1)]
    is_upper = (first_byte >= 65) & (first_byte <= 90) & (length > 1) & (second >= 65) & (second <= 90)
    bare = (last_byte >= 33) & (last_byte < 48) & (last_byte != 44) & (last_byte != 46)
    # Lines: hashed by their bytes, as ranges between line feeds and text bounds.
    feeds = np.flatnonzero(data == 10)
    line_start = np.union1d(offsets[:-1][size > 0], feeds + 1)
    line_start = line_start[line_start < len(data)]
    l_owner = owner[line_start]
    line_end = np.append(line_start[1:], len(data))
    lines = np.bincount(l_owner, minlength=n).astype(float)
    lh = K.range_hash(K.prefix_sums(data), line_start, line_end - (data[line_end - 1] == 10))
    pair = np.lexsort((lh, l_owner))
    fresh = np.concatenate(([True], (lh[pair][1:] != lh[pair][:-1]) | (l_owner[pair][1:] != l_owner[pair][:-1])))
    distinct_lines = np.bincount(l_owner[pair][fresh], minlength=n) / np.maximum(lines, 1)
    out[:] = np.stack(
        [np.log1p(size), np.log1p(words), mean, spread, upper + lower, upper, digit, share[:, 128:].sum(1), share[:, [9, 10, 11, 12, 13, 32]].sum(1)]
        + [share[:, ord(c)] for c in _MARKS]
        + [share[:, _SYMBOLS].sum(1), distinct, again, top, words / np.maximum(lines, 1), distinct_lines, np.bincount(w_owner, is_upper, n) / many, np.bincount(w_owner, bare, n) / many],
        1,
    )
    out[:, STATISTICS.index("line_words")] = np.log1p(out[:, STATISTICS.index("line_words")])
    out[size == 0] = 0
    return out


@dataclass
class Model:
    """Scaling, random features, ridge weights and the calibration's knots."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    knots: tuple[np.ndarray, np.ndarray]

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.interp(fourier((stats - self.mean) / self.scale) @ self.weights, *self.knots)


def fourier(x: np.ndarray) -> np.ndarray:
    """Random Fourier features of a Gaussian kernel of bandwidth sqrt(dimensions), and a constant."""
    rng = np.random.default_rng(SEED)
    frequencies = rng.standard_normal((x.shape[1], FEATURES)) / np.sqrt(x.shape[1])
    phase = rng.uniform(0, 2 * np.pi, FEATURES)
    return np.hstack([np.sqrt(2 / FEATURES) * np.cos(np.clip(x, -8, 8) @ frequencies + phase), np.ones((len(x), 1))])


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, ...) to (doc_id, statistics, ...)."""
    for batch in batches:
        data, offsets = K.string_buffers(batch.column(1))
        for lo, hi in K.chunks(offsets):
            stats = statistics(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            rows = batch.slice(lo, hi - lo)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(list(stats), pa.list_(pa.float64())), *(rows.column(i) for i in range(2, rows.num_columns))], names=["doc_id", "stats", *rows.schema.names[2:]])


def _matrix(column: pa.Array) -> np.ndarray:
    return np.array(column.to_pylist(), float).reshape(len(column), len(STATISTICS))


def _sums(mean: np.ndarray, scale: np.ndarray):
    """A partition's normal equations: one row for each fold, of the flat matrix [Z y]' [Z y]."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((FOLDS, FEATURES + 2, FEATURES + 2))
        for batch in batches:
            if batch.num_rows:
                z = np.column_stack([fourier((_matrix(batch.column(0)) - mean) / scale), batch.column(1).to_numpy(zero_copy_only=False)])
                fold = batch.column(2).to_numpy(zero_copy_only=False)
                for f in range(FOLDS):
                    total[f] += z[fold == f].T @ z[fold == f]
        yield pa.RecordBatch.from_arrays([pa.array(range(FOLDS), pa.int32()), pa.array([t.tobytes() for t in total], pa.binary())], names=["fold", "sums"])

    return run


def _solve(total: np.ndarray) -> np.ndarray:
    gram, target = total[:-1, :-1], total[:-1, -1]
    n = max(total[-2, -2], 1.0)
    ridge = np.full(len(gram), RIDGE * n)
    ridge[-1] = 1e-9 * n
    return np.linalg.solve(gram + np.diag(ridge), target)


def pool(x: np.ndarray, ones: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression by pooling adjacent violators; knots at the pools' means, rates shrunk off 0 and 1."""
    pools: list[list[float]] = []
    for a, b, c in zip(x * count, ones, count, strict=True):
        pools.append([a, b, c])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [p + q for p, q in zip(pools[-1], last, strict=True)]
    table = np.array(pools)
    at, rate = table[:, 0] / table[:, 2], (table[:, 1] + 0.5) / (table[:, 2] + 1)
    rate = np.maximum.accumulate(rate)
    # Beyond the outer pools the curve still rises a little, so that ranks stay.
    return np.concatenate(([at[0] - 1.0], at, [at[-1] + 1.0])), np.concatenate(([rate[0] * 0.5], rate, [1 - (1 - rate[-1]) * 0.5]))


def measure(docs: DataFrame, store: Store) -> DataFrame:
    """(doc_id, stats) of every row, written: texts are read once and never shuffled."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return store.put(source.mapInArrow(_measure, "doc_id long, stats array<double>"), "measured")


def train(statistics_of: DataFrame, labels: DataFrame, store: Store) -> Model | None:
    """Fits on all labelled rows of (doc_id, stats) that aren't held out (crc32 mod 4 is 2)."""
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.when(F.col("quality") > 0, 1.0).otherwise(0.0).alias("y")).where("doc_id is not null and quality is not null").where(~held_out(F.col("doc_id"), 4, 2)).distinct()
    measured = store.put(statistics_of.join(marked, "doc_id").withColumn("fold", F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int")), "labelled")
    moments = measured.agg(F.count("*").alias("n"), *(f(F.get("stats", F.lit(i))).alias(f"{f.__name__}{i}") for i in range(len(STATISTICS)) for f in (F.avg, F.stddev_pop))).first()
    if not moments.n:
        return None
    mean = np.array([moments[f"avg{i}"] for i in range(len(STATISTICS))])
    scale = np.array([max(moments[f"stddev_pop{i}"], 1e-6) for i in range(len(STATISTICS))])
    sums = measured.select("stats", "y", "fold").coalesce(SUMS).mapInArrow(_sums(mean, scale), "fold int, sums binary").collect()
    total = np.zeros((FOLDS, FEATURES + 2, FEATURES + 2))
    for r in sums:
        total[r.fold] += np.frombuffer(bytes(r.sums)).reshape(FEATURES + 2, -1)
    everything = total.sum(0)
    others = [_solve(everything - total[f]) for f in range(FOLDS)]

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                z, fold = fourier((_matrix(batch.column(0)) - mean) / scale), batch.column(2).to_numpy(zero_copy_only=False)
                s = np.stack([z @ w for w in others])[fold, np.arange(len(fold))]
                yield pa.RecordBatch.from_arrays([pa.array(np.clip(np.floor((s + 0.5) / 2 * BINS), 0, BINS - 1).astype(np.int64)), pa.array(s), batch.column(1)], names=["bin", "s", "y"])

    bins = measured.select("stats", "y", "fold").mapInArrow(binned, "bin long, s double, y double").groupBy("bin").agg(F.avg("s").alias("s"), F.sum("y").alias("y"), F.count("*").alias("n")).orderBy("bin").collect()
    knots = pool(np.array([b.s for b in bins]), np.array([b.y for b in bins]), np.array([float(b.n) for b in bins]))
    store.drop("labelled")
    return Model(mean, scale, _solve(everything), knots)


def score(statistics_of: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, score, predicted) for every row of (doc_id, stats)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = np.full(batch.num_rows, 0.5)
            if model is not None and batch.num_rows:
                s = np.clip(model.score(_matrix(batch.column(1))), 0, 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return statistics_of.mapInArrow(run, "doc_id long, score double, predicted int")


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, score, predicted) for every row of ``docs``, from its whole text, as the labelled rows teach."""
    store = Store(docs.sparkSession, "quality")
    measured = measure(docs, store)
    return score(measured, train(measured, labels, store))
