"""Toxic spans and document scores by a linear-chain conditional random field.

Tokens are runs of letters and digits; each line of a text is one chain with the tags O
(other) and T (toxic).  A token's features are hashes of the word, of its prefixes and of the
word with the one before it, and whether the token before or after it has any such feature.

Fit, on at most ``SAMPLE`` labelled rows of each class (least hash first) of at most
``SAMPLE_BYTES`` bytes each.  Labels mark documents, not tokens, so tags are hidden: a toxic
document has some T, a clean one none.  Features whose share among toxic documents is
significantly greater (a G test) are kept; from half their log-odds on, which the penalty draws
to, weights and transitions then ascend the penalised likelihood of the documents' labels.  Forward-backward gives its gradient: the tags' expected
counts in clean documents are pushed down, and those of toxic documents move towards
their expectations given that some token is toxic, which re-estimates tags at every step.
A logistic curve maps a document's evidence to a probability.

Score: every token of every whole text takes part.  Forward-backward gives marginals;
chains without any known feature share a closed table by length.  The document's
evidence is the probability that any of its tokens is toxic, its offending offsets are the
runs of tokens with a marginal of one half or more.

Defined cases: null and empty texts have no token and get the score of no evidence;
without labelled rows of both classes every score is 0, without any telling feature it is the share of
toxic labels; repeated rows score alike; a doc_id with labels of both kinds counts as both, and
of several texts of one id each is a row of the sample; very long texts are scored whole, in
chunks of whole texts; of extra columns :func:`drop_toxic` keeps all, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowsmith.llm import _kernels as K

SAMPLE, SAMPLE_BYTES, FEATURES = 3000, 50_000, 2048
PREFIXES = (4, 5, 6, 8)
#: Chains are cut into pieces of this length for the fit alone; no token is left out.
CHAIN = 64
STEPS, RATE, RIDGE = 60, 0.25, 0.1
#: Features are kept from this value of the G statistic on, and this many times as frequent in toxic documents.
TELLING, TIMES = 16.0, 5.0
THRESHOLD = 0.5
_TABLE = 20


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, features[n, kinds], chain number): tokens in order; chains are lines within texts."""
    data = _folded(data)
    starts, ends, whole, _ = K.words(data, offsets, separators="symbols")
    summed = K.prefix_sums(data)
    kinds = [whole]
    for k in PREFIXES:
        at = np.minimum(starts + k, ends)
        kinds.append(K.range_hash(summed, starts, at) ^ np.uint64(0x1000193 * k))
    breaks = np.zeros(len(data) + 1, np.int64)
    np.add.at(breaks, offsets[:-1], 1)
    breaks[1:][data == 10] += 1
    chain = np.cumsum(breaks)[starts] if len(starts) else np.empty(0, np.int64)
    if not len(starts):
        return starts, ends, np.empty((0, 2 + len(PREFIXES)), np.uint64), chain
    before = np.concatenate((whole[:1], whole[:-1]))
    kinds.append(np.where(np.concatenate(([False], chain[1:] == chain[:-1])), K.mix(before * np.uint64(0x9E3779B97F4A7C15) ^ whole), whole))
    return starts, ends, np.stack(kinds, 1), chain


def _folded(data: np.ndarray) -> np.ndarray:
    """The bytes with the capitals of Latin-1 (C3 80 to C3 9E) as small letters; A-Z are folded with the hashes."""
    lead = np.flatnonzero(data[:-1] == 0xC3) + 1
    lead = lead[(data[lead] >= 0x80) & (data[lead] <= 0x9E) & (data[lead] != 0x97)]
    if not len(lead):
        return data
    data = data.copy()
    data[lead] += 0x20
    return data


@dataclass
class Field:
    """hashes (sorted); weights of features, of the token before having one, of the token after, and the bias; transitions O-T, T-O, T-T (O-O is 0); the final curve."""

    hashes: np.ndarray
    weights: np.ndarray
    moves: np.ndarray
    curve: tuple[float, float]

    def __post_init__(self) -> None:
        self.plain: dict[int, float] = {}
        self.table = np.zeros(1 << _TABLE, bool)
        self.table[(self.hashes >> np.uint64(64 - _TABLE)).astype(np.int64)] = True

    def find(self, features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(token, feature number) for each known feature of a token."""
        maybe = np.flatnonzero(self.table[(features.reshape(-1) >> np.uint64(64 - _TABLE)).astype(np.int64)])
        h = features.reshape(-1)[maybe]
        at = np.minimum(np.searchsorted(self.hashes, h), max(0, len(self.hashes) - 1))
        good = self.hashes[at] == h if len(self.hashes) else np.zeros(len(h), bool)
        return maybe[good] // features.shape[1], at[good]


def _around(token: np.ndarray, known: np.ndarray, chain: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (token, feature number) with those of neighbours in the chain: feature f of the token before is n + f, after 2n + f."""
    after, before = token + 1, token - 1
    x = (after < len(chain)) & (chain[np.minimum(after, len(chain) - 1)] == chain[token])
    y = (before >= 0) & (chain[np.maximum(before, 0)] == chain[token])
    return np.concatenate([token, after[x], before[y]]), np.concatenate([known, known[x] + n, known[y] + 2 * n])


def forward_backward(node: np.ndarray, length: np.ndarray, moves: np.ndarray, each: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(log of Z over the all-O score, marginals of T, expected counts of O-T, T-O, T-T) of padded chains.

    node[i, t]: log-odds of T at place t of chain i, moves: the three transition weights.
    The counts are of all chains together, or of ``each``.
    """
    n, width = node.shape
    enter, leave, stay = moves
    forward, log_z = np.empty_like(node), np.zeros(n)
    r = node[:, 0] if width else np.empty(n)
    forward[:, :1] = r[:, None]
    for t in range(1, width):
        norm = np.logaddexp(r + leave, 0.0)
        nxt = node[:, t] + np.logaddexp(r + stay, enter) - norm
        alive = t < length
        log_z += np.where(alive, norm, 0.0)
        r = np.where(alive, nxt, r)
        forward[:, t] = r
    log_z += np.logaddexp(0.0, r)
    back = np.zeros_like(node)
    b = np.zeros(n)
    counts = np.zeros((n, 3))
    for t in range(width - 2, -1, -1):
        alive = t + 1 < length
        x = node[:, t + 1] + b
        if alive.any():
            f, y = forward[alive, t], x[alive]
            scores = np.stack([np.zeros_like(f), y + enter, f + leave, f + y + stay])
            p = np.exp(scores - np.logaddexp.reduce(scores, 0))
            counts[alive] += p[1:].T
        b = np.where(alive, np.logaddexp(leave, x + stay) - np.logaddexp(0.0, x + enter), 0.0)
        back[:, t] = b
    inside = np.arange(width) < length[:, None]
    return log_z, np.where(inside, 1 / (1 + np.exp(-np.clip(forward + back, -700, 700))), 0.0), counts if each else counts.sum(0)


def _padded(node: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
    width = int(length.max())
    at = first[:, None] + np.minimum(np.arange(width), length[:, None] - 1)
    return np.where(np.arange(width) < length[:, None], node[at], 0.0)


def _groups(length: np.ndarray, cells: int = 400_000) -> Iterator[np.ndarray]:
    """Chains of like length together, in groups of bounded padded size."""
    order = np.argsort(length, kind="stable")
    lo = 0
    while lo < len(order):
        hi = lo + 1
        while hi < len(order) and (hi - lo + 1) * length[order[min(len(order) - 1, hi)]] <= cells:
            hi += 1
        yield order[lo:hi]
        lo = hi


def _chains(chain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First token and length of each chain that has tokens."""
    if not len(chain):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    first = np.flatnonzero(np.concatenate(([True], chain[1:] != chain[:-1])))
    return first, np.diff(np.append(first, len(chain)))


def score_texts(field: Field, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[list[tuple[int, int, float]]]]:
    """(probability that any token is toxic, spans as byte ranges within the text) of each text."""
    texts = len(offsets) - 1
    starts, ends, features, chain = tokens(data, offsets)
    spans: list[list[tuple[int, int, float]]] = [[] for _ in range(texts)]
    quiet = np.zeros(texts)  # log of the probability that no token is toxic
    if len(starts):
        token, known = _around(*field.find(features), chain, len(field.hashes))
        node = np.full(len(starts), field.weights[-1])
        np.add.at(node, token, field.weights[known])
        first, length = _chains(chain)
        owner = np.searchsorted(offsets, starts[first], side="right") - 1
        loud = np.zeros(len(first), bool)
        loud[np.searchsorted(first, token, side="right") - 1] = True
        plain = np.flatnonzero(~loud)
        for n in np.unique(length[plain]):
            log_z = _plain_log_z(field, int(n))
            np.add.at(quiet, owner[plain[length[plain] == n]], -log_z)
        noisy = np.flatnonzero(loud)
        for group in _groups(length[noisy]):
            rows = noisy[group]
            log_z, marginal, _ = forward_backward(_padded(node, first[rows], length[rows]), length[rows], field.moves)
            np.add.at(quiet, owner[rows], -log_z)
            for i in np.flatnonzero((marginal >= THRESHOLD).any(1)):
                row = rows[i]
                hot = np.flatnonzero(marginal[i] >= THRESHOLD)
                for run in np.split(hot, np.flatnonzero(np.diff(hot) > 1) + 1):
                    base = offsets[owner[row]]
                    spans[owner[row]].append((int(starts[first[row] + run[0]] - base), int(ends[first[row] + run[-1]] - base), float(marginal[i, run].max())))
    return -np.expm1(np.minimum(quiet, 0.0)), [sorted(s) for s in spans]


def _plain_log_z(field: Field, n: int) -> float:
    """log Z of a chain of n tokens without features: the fixed point is reached within a few tokens."""
    if n not in field.plain:
        if len(field.plain) > 100_000:
            field.plain.clear()
        enter, leave, stay = field.moves
        r, total = field.weights[-1], 0.0
        for t in range(1, n):
            norm = np.logaddexp(r + leave, 0.0)
            nxt = field.weights[-1] + np.logaddexp(r + stay, enter) - norm
            total += norm
            if nxt == r:
                total += norm * (n - 1 - t)
                break
            r = nxt
        field.plain[n] = float(total + np.logaddexp(0.0, r))
    return field.plain[n]


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def _choose(texts: list[bytes], toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, log-odds) of at most FEATURES telling features, by hash.

    Only toxic documents' features are kept; clean documents are counted as they pass.
    """

    def distinct(rows: np.ndarray) -> Iterator[np.ndarray]:
        """Each text's distinct features."""
        for lo in range(0, len(rows), 100):
            part = [texts[i] for i in rows[lo : lo + 100]]
            offsets = np.cumsum([0, *map(len, part)])
            starts, _, features, _ = tokens(np.frombuffer(b"".join(part), np.uint8), offsets)
            bounds = np.searchsorted(starts, offsets)
            for x, y in zip(bounds[:-1], bounds[1:], strict=True):
                yield np.unique(features[x:y])

    hashes, count = np.unique(np.concatenate(list(distinct(np.flatnonzero(toxic)))), return_counts=True)
    hashes, count = hashes[count >= 2], count[count >= 2]
    clean = np.zeros(len(hashes))
    for u in distinct(np.flatnonzero(~toxic)):
        at = np.minimum(np.searchsorted(hashes, u), max(0, len(hashes) - 1))
        clean[at[hashes[at] == u] if len(hashes) else at[:0]] += 1
    n, m = int(toxic.sum()), int((~toxic).sum())
    share = (count + clean) / (n + m)

    def part(seen: np.ndarray, rows: int) -> np.ndarray:
        """A class's part of the G statistic."""
        rest = rows - seen
        return seen * np.log(np.maximum(seen, 1e-300) / (rows * share)) + rest * np.log(np.maximum(rest, 1e-300) / np.maximum(rows * (1 - share), 1e-300))

    g = 2 * (part(count.astype(float), n) + part(clean, m))
    odds = np.log((count + 0.5) / (n + 1)) - np.log((clean + 0.5) / (m + 1))
    keep = np.flatnonzero((g >= TELLING) & (odds >= np.log(TIMES)))
    keep = np.sort(keep[np.argsort(-g[keep], kind="stable")][:FEATURES])
    return hashes[keep], odds[keep]


def fit(texts: list[bytes], toxic: np.ndarray, prior: float) -> Field | None:
    """The field of labelled texts; prior: the share of toxic rows among all labelled."""
    if not toxic.any() or toxic.all():
        return None
    hashes, odds = _choose(texts, toxic)
    n = len(hashes)
    if not n:
        return Field(hashes, np.array([-6.0]), np.zeros(3), (0.0, float(np.log(prior / (1 - prior)))))
    field = Field(hashes, np.zeros(3 * n + 1), np.zeros(3), (1.0, 0.0))
    # Pieces of chains: those with a feature token by token, the others by length (doc, length).
    lengths, owners, pairs, plain, base = [], [], [], [], 0
    for lo in range(0, len(texts), 200):
        part = texts[lo : lo + 200]
        offsets = np.cumsum([0, *map(len, part)])
        starts, _, features, chain = tokens(np.frombuffer(b"".join(part), np.uint8), offsets)
        if not len(starts):
            continue
        token, known = _around(*field.find(features), chain, n)
        first, length = _chains(chain)
        place = np.arange(len(starts)) - np.repeat(first, length)
        first, length = _chains(np.cumsum(place % CHAIN == 0))
        owner = lo + np.searchsorted(offsets, starts[first], side="right") - 1
        loud = np.zeros(len(first), bool)
        loud[np.searchsorted(first, token, side="right") - 1] = True
        plain.append(np.stack([owner[~loud], length[~loud]]))
        renumber = np.cumsum(np.repeat(loud, length)) - 1 + base
        pairs.append(np.stack([renumber[token], known]))
        lengths.append(length[loud])
        owners.append(owner[loud])
        base += int(length[loud].sum())
    length, owner, (token, known), plain = np.concatenate(lengths), np.concatenate(owners), np.concatenate(pairs, axis=1), np.concatenate(plain, axis=1)
    first, size = np.cumsum(length) - length, 3 * n + 1
    groups = list(_groups(length, 100_000))
    kinds, kind = np.unique(plain[1], return_inverse=True)
    weight = np.where(toxic, prior / toxic.mean(), (1 - prior) / (1 - toxic.mean())) / len(texts)
    prior_mean = np.concatenate([np.clip(odds, 0.0, 4.0) / 2, np.zeros(2 * n), [-7.0], np.zeros(3)])
    state = prior_mean.copy()
    m, v = np.zeros_like(state), np.zeros_like(state)
    for step in range(1, STEPS + 1):
        node = np.full(base, state[size - 1])
        np.add.at(node, token, state[known])
        log_z, expected, counts = np.empty(len(length)), np.empty(base), np.empty((len(length), 3))
        for g in groups:
            log_z[g], marginal, counts[g] = forward_backward(_padded(node, first[g], length[g]), length[g], state[size:], each=True)
            inside = np.arange(marginal.shape[1]) < length[g][:, None]
            expected[(first[g][:, None] + np.arange(marginal.shape[1]))[inside]] = marginal[inside]
        quiet = -np.bincount(owner, weights=log_z, minlength=len(texts))
        if len(kinds):
            z, marginal, moved = forward_backward(np.full((len(kinds), int(kinds.max())), state[size - 1]), kinds, state[size:], each=True)
            quiet -= np.bincount(plain[0], weights=z[kind], minlength=len(texts))
        # The weight of a document's expected counts in the gradient: down where clean, towards "some" where toxic.
        some = np.exp(np.minimum(quiet, -1e-9))
        pull = weight * np.where(toxic, some / (1 - some), -1.0)
        each = expected * np.repeat(pull[owner], length)
        grad = np.concatenate([np.bincount(known, weights=each[token], minlength=size - 1), [each.sum()], (counts * pull[owner][:, None]).sum(0)])
        if len(kinds):
            by = np.bincount(kind, weights=pull[plain[0]], minlength=len(kinds))
            grad[size - 1] += by @ marginal.sum(1)
            grad[size:] += by @ moved
        grad -= RIDGE / len(texts) ** 0.5 * (state - prior_mean)
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        state = state + RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    field = Field(hashes, state[:size], state[size:], (1.0, 0.0))
    evidence = np.concatenate([score_texts(field, np.frombuffer(b"".join(texts[lo : lo + 200]), np.uint8), np.cumsum([0, *map(len, texts[lo : lo + 200])]))[0] for lo in range(0, len(texts), 200)])
    return Field(hashes, state[:size], state[size:], _curve(_logit(evidence), toxic, prior))


def _curve(x: np.ndarray, y: np.ndarray, prior: float) -> tuple[float, float]:
    """Penalised logistic regression of y on x, classes weighted to the prior."""
    weight = np.where(y, prior / y.mean(), (1 - prior) / (1 - y.mean()))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -500, 500)))
        g = np.array([(weight * (y - p) * x).sum() - 1e-2 * (a - 1), (weight * (y - p)).sum() - 1e-2 * b])
        w = weight * p * (1 - p)
        h = np.array([[(w * x * x).sum() + 1e-2, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-2]])
        step = np.linalg.solve(h, g)
        a, b = a + np.clip(step[0], -1, 1), b + np.clip(step[1], -2, 2)
    return float(max(a, 0.0)), float(b)


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id's decimal text leaves the remainder; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("long").cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Field | None:
    """Fits on a bounded sample of the labelled rows that aren't held out (crc32 mod 5 is 0)."""
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("toxic") > 0).alias("toxic")).where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id"), 5, 0)).distinct()
    share = marked.agg(F.avg(F.col("toxic").cast("int"))).first()[0]
    if not share or share >= 1:
        return None
    # Ids first: at most 2 * sample of them go to the scan of the texts, which isn't shuffled.
    chosen = [r for flag in (True, False) for r in marked.where(F.col("toxic") == flag).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).collect()]
    picked = F.broadcast(docs.sparkSession.createDataFrame([(r.doc_id, r.toxic, i) for i, r in enumerate(chosen)], "doc_id long, toxic boolean, at int"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(f"octet_length(text) between 1 and {SAMPLE_BYTES}").join(picked, "doc_id")
    found = sorted(rows.select("at", "text", "toxic").toLocalIterator(), key=lambda r: (r["at"], r.text))
    return fit([r.text.encode() for r in found], np.array([r.toxic for r in found], bool), float(share))


def _characters(text: bytes, spans: list[tuple[int, int, float]]) -> list[dict]:
    raw = np.frombuffer(text, np.uint8)
    count = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
    return [{"start": int(count[a]), "end": int(count[b]), "marginal": p} for a, b, p in spans]


def toxicity(docs: DataFrame, field: Field | None) -> DataFrame:
    """(doc_id, score, predicted, spans) for every row; spans in code points of the text."""
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("marginal", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = K.string_buffers(batch.column(1))
            for lo, hi in K.chunks(offsets):
                part, own = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                if field is None:
                    score, found = np.zeros(hi - lo), [[] for _ in range(hi - lo)]
                else:
                    evidence, found = score_texts(field, part, own)
                    score = 1 / (1 + np.exp(-np.clip(field.curve[0] * _logit(evidence) + field.curve[1], -500, 500)))
                spans = [_characters(part[own[i] : own[i + 1]].tobytes(), s) if s else [] for i, s in enumerate(found)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32)), pa.array(spans, span)], names=["doc_id", "score", "predicted", "spans"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, score double, predicted int, spans array<struct<start: long, end: long, marginal: double>>")


def drop_toxic(docs: DataFrame, field: Field | None) -> DataFrame:
    """The rows of ``docs`` that aren't predicted toxic, all columns kept, in one pass."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(names.index("text"))
            data, offsets = K.string_buffers(text)
            keep = []
            for lo, hi in K.chunks(offsets):
                evidence, _ = score_texts(field, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                keep.append(field.curve[0] * _logit(evidence) + field.curve[1] < 0)
            yield batch.filter(pa.array(np.concatenate(keep))) if keep else batch

    return docs if field is None else docs.mapInArrow(run, docs.schema)
