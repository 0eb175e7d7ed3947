"""Near-duplicate components of documents by HyperMinHash.

Each text becomes the set of its distinct word shingles.  The set is sketched in
``BUCKETS`` registers that hold, for the least hash of a bucket, its count of
leading zeros and ``MANTISSA`` further bits.  Bands of ``ROWS`` registers
select candidates, a collision-corrected Jaccard estimate drops the hopeless ones,
and the rest are confirmed on the full sets, so that no link reported is wrong.

With 32 bands of four registers a pair at a Jaccard likeness of exactly 0.8 is
missed with probability (1 - 0.8**4)**32 = 5e-8.  The estimate's bound
(``SLACK`` = 0.2 below the threshold) is over five standard errors away.

Groups of any size: equal sets collapse to one class first; each bucket then
links to its smallest member; only classes of *different* components that still
share a bucket are compared again, by size and sketch, inside tasks, in blocks of about
``BLOCK``; the ids of those that have a partner leave the task.  These get a finer sketch,
``2**FINE_BITS`` registers of four bits, and are compared once more in their buckets; of a
large family of edits of one text, which the first sketch can't tell from links, few pairs
are left.  Pairs within ``ERRORS`` standard errors of the threshold, or above it, are
confirmed on their texts.  No bucket is capped.

Defined cases: a null or blank text has an empty set and links with nothing; a
text of fewer than k words has its whole sequence as only shingle; rows that
share a doc_id are one document; a null doc_id is its own component (null).
Extra columns are ignored by :func:`near_duplicates` and kept by :func:`deduplicate`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rowsmith.llm import _kernels as K
from rowsmith.llm._store import Store
from rowsmith.llm.components import components

BITS, MANTISSA, ROWS = 7, 10, 4
BUCKETS = 1 << BITS
BANDS = BUCKETS // ROWS
SLACK, BLOCK = 0.2, 4096
FINE_BITS, ERRORS = 11, 5.66
#: Bytes of the sketches that are compared at once.
COMPARED = 1 << 19
#: Expected share of accidental register collisions (Yu and Weber, 2022) for sets of like size.
COLLISIONS = 0.1699194871597391 / (1 << MANTISSA)


def _least(sets: list[np.ndarray], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(cell, hash) of the least hash of each bucket of sorted sets that isn't empty."""
    flat = np.concatenate([np.empty(0, np.uint64), *sets])
    cell = np.repeat(np.arange(len(sets)) << bits, [len(s) for s in sets]) + (flat >> np.uint64(64 - bits)).astype(np.int64)
    least = np.flatnonzero(np.diff(cell, prepend=-1))  # sets are sorted: first is least
    return cell[least], flat[least]


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """HyperMinHash registers, one row of BUCKETS uint16 for each sorted set; 0 marks an empty bucket."""
    out = np.zeros((len(sets), BUCKETS), np.uint16)
    cell, least = _least(sets, BITS)
    rest = least << np.uint64(BITS)
    zeros = np.clip(63 - np.log2(np.maximum(rest, 1).astype(np.float64)).astype(np.int64), 0, 62)
    mantissa = (rest << (zeros + 1).astype(np.uint64)) >> np.uint64(64 - MANTISSA)
    out.reshape(-1)[cell] = ((zeros + 1) << MANTISSA) | ((1 << MANTISSA) - 1 - mantissa.astype(np.int64))
    return out


def fine_sketches(sets: list[np.ndarray]) -> np.ndarray:
    """One row of 2**FINE_BITS registers, two in a byte, for each sorted set: 1 to 15 by the least hash of a bucket, 0 for an empty one."""
    out = np.zeros((len(sets), 1 << FINE_BITS), np.uint8)
    cell, least = _least(sets, FINE_BITS)
    out.reshape(-1)[cell] = (least & np.uint64(0xFFFFFFFF)) % np.uint64(15) + np.uint64(1)
    return out[:, ::2] | out[:, 1::2] << 4


def _count(mask: np.ndarray) -> np.ndarray:
    return np.bitwise_count(mask.view(np.uint64)).sum(-1, dtype=np.int64)


def likeness(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Collision-corrected Jaccard estimates of sketches, broadcast over leading axes."""
    filled = _count((x | y) != 0)
    same = _count((x == y) & (x != 0))
    share = same / np.maximum(filled, 1)
    return np.maximum(0.0, (share - COLLISIONS) / (1 - COLLISIONS))


def _features(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for lo, sets in K.text_shingles(batch.column(1), k):
                n = len(sets)
                registers = sketches(sets)
                a, b = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
                for i, s in enumerate(sets):
                    if len(s):
                        a[i], b[i] = np.bitwise_xor.reduce(s), K.mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, n), pa.array([len(s) for s in sets], pa.int64()), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array([r.tobytes() for r in registers], pa.binary())],
                    names=["doc_id", "n_shingles", "sig_a", "sig_b", "registers"],
                )

    return run


def _band_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.int64).reshape(-1, BANDS)
        rep, band = np.repeat(batch.column(0).to_numpy(), BANDS), np.tile(np.arange(BANDS, dtype=np.int32), len(keys))
        keys = keys.reshape(-1)
        some = keys != 0
        yield pa.RecordBatch.from_arrays([pa.array(rep[some]), pa.array(band[some]), pa.array(keys[some])], names=["rep", "band", "key"])


def _registers(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, BUCKETS)


def _fine_registers(column: pa.Array) -> np.ndarray:
    packed = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)
    out = np.empty((len(packed), 1 << FINE_BITS), np.uint8)
    out[:, ::2], out[:, 1::2] = packed & 15, packed >> 4
    return out


def _maybe_alike(percent: int):
    """Whether sets may be as alike as ``percent``, by their sketches and the sum of their sizes."""
    return lambda x, y, n: likeness(x, y) >= percent / 100 - SLACK


def _likely_alike(percent: int):
    """As :func:`_maybe_alike`, by fine sketches: not ERRORS standard errors below.

    Registers filled in one of two sets are drawn without replacement from their union. Unlike
    hashes have equal codes once in 15 times.
    """
    share = percent / 100

    def run(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
        filled, both, equal = np.maximum(_count((x | y) != 0), 1), _count((x != 0) & (y != 0)), _count((x == y) & (x != 0))
        left = 1 - filled / np.maximum(filled, n / (1 + share))
        error = np.sqrt(share * (1 - share) * left / filled + (both - equal) / (14 * filled**2))
        return (15 * equal - both) / (14 * filled) >= share - ERRORS * error - 1e-9

    return run


def _estimated(percent: int):
    """Keeps pairs (a, b, ra, rb) whose sketches may be alike enough."""
    alike = _maybe_alike(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch.select([0, 1]).filter(pa.array(alike(_registers(batch.column(2)), _registers(batch.column(3)), None)))

    return run


def _within(percent: int, fine: bool):
    """Rows (cell, n, side, component, rep, registers) sorted by cell and n, to the reps alike enough to one of another component.

    side 0: a whole bucket or a block of it against itself; sides 1 and 2: two blocks.
    Sets whose sizes ``n`` alone rule a link out aren't compared. By fine sketches: the pairs (a, b).
    """
    unpacked, alike = (_fine_registers, _likely_alike(percent)) if fine else (_registers, _maybe_alike(percent))

    def partners_of(cell: np.ndarray, n: np.ndarray, side: np.ndarray, comp: np.ndarray, regs: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The pairs of rows of whole cells that are alike enough."""
        rows = np.arange(len(cell))
        number = np.cumsum(np.concatenate(([0], cell[1:] != cell[:-1]))) << 40
        partners = np.searchsorted(number + n, number + 100 * n // percent, side="right") - rows - 1
        before = np.concatenate(([0], np.cumsum(partners)))
        lo, step = 0, max(1, COMPARED // regs[0].nbytes)
        while lo < len(cell):
            hi = max(lo + 1, int(np.searchsorted(before, before[lo] + step, side="right")) - 1)
            i = np.repeat(rows[lo:hi], partners[lo:hi])
            j = i + 1 + np.arange(len(i)) - (before[i] - before[lo])
            some = (comp[i] != comp[j]) & ((side[i] == 0) | (side[i] != side[j]))
            i, j = i[some], j[some]
            for at in range(0, len(i), step):
                x, y = i[at : at + step], j[at : at + step]
                good = alike(regs[x], regs[y], n[x] + n[y])
                yield x[good], y[good]
            lo = hi

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(rows: pa.RecordBatch) -> pa.RecordBatch:
            rep, pairs = rows.column(4).to_numpy(), partners_of(*(rows.column(i).to_numpy().astype(np.int64) for i in range(4)), unpacked(rows.column(5)))
            if fine:
                ends = np.concatenate([np.empty((2, 0), np.int64), *(np.sort([rep[x], rep[y]], axis=0) for x, y in pairs)], axis=1)
                return pa.RecordBatch.from_arrays([pa.array(end, pa.int64()) for end in ends], names=["a", "b"])
            hit = np.zeros(len(rep), bool)
            for x, y in pairs:
                hit[x] = hit[y] = True
            return pa.RecordBatch.from_arrays([pa.array(np.unique(rep[hit]), pa.int64())], names=["rep"])

        open_ = []  # rows of a cell that may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            cell = batch.column(0).to_numpy()
            last = int(np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))[-1])
            if open_ and (last or cell[0] != open_[-1].column(0)[0].as_py()):
                yield found(pa.concat_batches([*open_, batch.slice(0, last)]))
                open_ = []
            elif last:
                yield found(batch.slice(0, last))
            open_.append(batch.slice(last))
        if open_:
            yield found(pa.concat_batches(open_))

    return run


def _fine(k: int):
    """Rows (rep, text) to (rep, registers), those of the fine sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, sets in K.text_shingles(batch.column(1), k):
                for at in range(0, len(sets), 1024):
                    part = sets[at : at + 1024]
                    registers = pa.array([r.tobytes() for r in fine_sketches(part)], pa.binary())
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo + at, len(part)), registers], names=["rep", "registers"])

    return run


def _confirm(k: int, percent: int):
    """Rows (a, b, text a, text b) to the pairs with 100 * intersection >= percent * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                sets = [[s for _, chunk in K.text_shingles(part.column(i), k) for s in chunk] for i in (2, 3)]
                good = []
                for x, y in zip(*sets, strict=True):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    good.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
                yield part.select([0, 1]).filter(pa.array(good, pa.bool_()))

    return run


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, class_id, component_id, kept) for every row of ``docs``."""
    spark = docs.sparkSession
    store = Store(spark, "near")
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    features = store.put(source.mapInArrow(_features(k), "doc_id long, n_shingles long, sig_a long, sig_b long, registers binary"), "features")
    full = features.where("n_shingles > 0 and doc_id is not null")
    repeated = repeats(features, "doc_id")
    classes = store.put(full.groupBy("n_shingles", "sig_a", "sig_b").agg(F.min("doc_id").alias("rep"), F.min_by("registers", "doc_id").alias("registers")), "classes")
    reps = classes.select("rep", "registers")
    sizes = classes.select("rep", F.col("n_shingles").alias("n"))

    # Buckets with two classes or more.
    rows = reps.mapInArrow(_band_rows, "rep long, band int, key long")
    shared = rows.groupBy("band", "key").agg(F.count("*").alias("size"), F.min("rep").alias("centre")).where("size > 1")
    members = store.put(rows.join(shared, ["band", "key"]), "members")

    # Stars: every member to its bucket's smallest; the estimate first, then the full sets.
    def texts_of(ids: DataFrame) -> DataFrame:
        found = source.join(ids, "doc_id")
        return found.groupBy("doc_id").agg(F.min("text").alias("text")) if repeated else found

    def confirmed(pairs: DataFrame, name: str) -> DataFrame:
        pairs = store.put(pairs, f"{name}-pairs")
        texts = texts_of(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
        both = pairs.join(texts.toDF("a", "ta"), "a").join(texts.toDF("b", "tb"), "b").select("a", "b", "ta", "tb")
        return store.put(both.mapInArrow(_confirm(k, percent), "a long, b long"), f"{name}-links")

    stars = members.where("rep <> centre").select(F.col("centre").alias("a"), F.col("rep").alias("b")).distinct()
    stars = stars.join(reps.toDF("a", "ra"), "a").join(reps.toDF("b", "rb"), "b").select("a", "b", "ra", "rb")
    links = confirmed(stars.mapInArrow(_estimated(percent), "a long, b long"), "star")
    # Rows of one doc_id with different texts are one document.
    links = links.unionAll(classes.select("rep").join(full.join(classes, ["n_shingles", "sig_a", "sig_b"]).select("doc_id", "rep").distinct(), "rep").where("rep <> doc_id").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))) if repeated else links
    first = store.put(components(store, links, "cc-star"), "cc-star")

    # Buckets that still hold several components: compare across them, in blocks.
    labelled = members.join(first.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    mixed = labelled.groupBy("band", "key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("band", "key")
    rest = labelled.join(mixed, ["band", "key"]).join(sizes, "rep")

    def compared(drawn: DataFrame, fine: bool, out: str) -> DataFrame:
        """The reps, or by fine sketches the pairs, of buckets that hold several components that are alike by their sketches."""
        blocked = rest.join(drawn, "rep").withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int")).withColumn("block", F.pmod(F.xxhash64("rep"), "blocks").cast("int"))
        grid = F.when(F.col("blocks") == 1, F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("side")))).otherwise(
            F.transform(
                F.sequence(F.lit(0), F.col("blocks") - 1),
                lambda o: F.struct(F.least(o, F.col("block")).alias("i"), F.greatest(o, F.col("block")).alias("j"), F.when(o == F.col("block"), 0).when(F.col("block") < o, 1).otherwise(2).alias("side")),
            )
        )
        cells = blocked.select("band", "key", "n", "component", "rep", "registers", F.explode(grid).alias("g"))
        cells = cells.select(F.xxhash64("band", "key", "g.i", "g.j").alias("cell"), "n", F.col("g.side").alias("side"), "component", "rep", "registers")
        return cells.repartition("cell").sortWithinPartitions("cell", "n").mapInArrow(_within(percent, fine), out).distinct()

    close = store.put(compared(reps, False, "rep long"), "close")
    texts = texts_of(close.select(F.col("rep").alias("doc_id"))).select("doc_id", "text")
    fine = store.put(texts.mapInArrow(_fine(k), "rep long, registers binary"), "fine")
    more = confirmed(compared(fine, True, "a long, b long"), "rest")
    last = store.put(components(store, links.unionAll(more), "cc"), "component")

    named = features.join(classes.select("n_shingles", "sig_a", "sig_b", "rep"), ["n_shingles", "sig_a", "sig_b"], "left")
    named = named.withColumn("class_id", F.coalesce("rep", "doc_id")).join(last.withColumnRenamed("node", "class_id"), "class_id", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "class_id"))
    return named.select("doc_id", "n_shingles", "class_id", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def repeats(df: DataFrame, id_col: str) -> bool:
    """Whether any id has several rows."""
    return df.where(F.col(id_col).isNotNull()).groupBy(id_col).count().where("count > 1").limit(1).count() > 0


def deduplicate(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` whose document is the smallest of its component.

    Of rows that share a doc_id one stays (the least text hash); rows without one all stay.
    """
    kept = near_duplicates(docs, k, percent).where("kept and doc_id is not null").select(F.col("doc_id").alias("kept_id")).distinct()
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("h"))
    out = rows.join(kept, F.col("id") == F.col("kept_id"), "left_semi")
    if repeats(docs, "doc_id"):
        out = out.withColumn("nth", F.row_number().over(Window.partitionBy("id").orderBy("h"))).where("nth = 1")
    return out.select("doc").unionByName(rows.where("id is null").select("doc")).select("doc.*")
