"""Exact top-k search over binary codes by incremental multi-index hashing.

A code of 64 bits is cut into m segments of about log2(number of codes) bits.  Round r looks up,
for each unfinished query and segment, the codes whose segment differs in exactly r bits; each
candidate is verified on its whole code, in the first round and segment that reach it.  A
code not yet found differs by r + 1 bits or more in every segment, so by m (r + 1) in all:
a query ends when its k-th verified distance is below that.

Equal codes are one entry with a count and its k smallest ids, so copies are not searched
again; crowded segment values are cut into cells; query sets and candidates stay distributed.

Defined cases: rows without a code (null or empty embedding, null id) are neither found nor
answered; with fewer than k rows all are returned; ties go to the smaller id; of rows
that repeat each counts.
"""

from __future__ import annotations

from itertools import combinations
from math import comb, log2

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowsmith.llm._store import Store

BITS, CROWD = 64, 4096
#: Beyond this many flips a round compares a query's segment with the segment values in use instead.
FLIPS = 20_000


def code(embedding: Column) -> Column:
    """The signs of an embedding's components as 64 bits; components 64 apart are added first."""
    n = F.size(embedding)
    folded = F.transform(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda i: F.aggregate(F.filter(embedding, lambda _, at: at % BITS == i), F.lit(0.0), lambda a, x: a + x.cast("double")))
    parts = F.when(n <= BITS, F.transform(embedding, lambda x: x.cast("double"))).otherwise(folded)
    one = F.lit(1).cast("long")
    bits = F.transform(parts, lambda x, i: F.when(x > 0, F.call_function("shiftleft", one, i)).otherwise(F.lit(0).cast("long")))
    return F.when(n > 0, F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b)))


def _segments(codes: int) -> list[tuple[int, int]]:
    """(shift, width) of each segment."""
    m = max(2, min(8, round(BITS / max(1.0, log2(max(2, codes))))))
    edges = [BITS * i // m for i in range(m + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def _part(c: Column, shift: int, width: int) -> Column:
    return F.shiftrightunsigned(c, shift).bitwiseAND((1 << width) - 1)


def top_k(rows: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, id, distance, rank): the k nearest rows of each query; both are (id, code)."""
    spark = rows.sparkSession
    store = Store(spark, "hamming")
    rows = store.put(rows.where("id is not null and code is not null").select("id", "code"), "rows")
    queries = store.put(queries.where("id is not null and code is not null").select(F.col("id").alias("query_id"), F.col("code").alias("q")), "queries")
    nearest = Window.partitionBy("code").orderBy("id")
    ids = store.put(rows.withColumn("nth", F.row_number().over(nearest)).where(F.col("nth") <= k).select("code", "id", "nth"), "ids")
    codes = store.put(rows.groupBy("code").agg(F.least(F.count("*"), F.lit(k)).alias("n")), "codes")
    segments = _segments(codes.count())
    m = len(segments)
    entry = F.explode(F.array(*(F.struct(F.lit(j).alias("segment"), _part(F.col("code"), s, w).alias("value")) for j, (s, w) in enumerate(segments))))
    index = codes.select("code", "n", entry.alias("e")).select("code", "n", "e.*")
    used = index.groupBy("segment", "value").agg(F.ceil(F.count("*") / F.lit(CROWD)).cast("int").alias("cells"))
    index = store.put(index.join(used, ["segment", "value"]).withColumn("cell", F.pmod(F.xxhash64("code"), F.col("cells")).cast("int")), "index")
    used = store.put(used, "used")

    pending = store.put(queries.select("q").distinct(), "pending-0")
    found: DataFrame | None = None
    for r in range(max(w for _, w in segments) + 1):
        few = [j for j, (_, w) in enumerate(segments) if r <= w and comb(w, r) <= FLIPS]
        many = [j for j, (_, w) in enumerate(segments) if r <= w and comb(w, r) > FLIPS]
        own = pending.select("q", F.explode(F.array(*(F.struct(F.lit(j).alias("segment"), _part(F.col("q"), s, w).alias("own")) for j, (s, w) in enumerate(segments) if j in few or j in many))).alias("e")).select("q", "e.*")
        probe = None
        if few:
            masks = F.broadcast(spark.createDataFrame([(j, [sum(1 << b for b in c) for c in combinations(range(segments[j][1]), r)]) for j in few], "segment int, masks array<long>"))
            flips = own.join(masks, "segment").select("q", "segment", "own", F.explode("masks").alias("mask"))
            probe = flips.select("q", "segment", F.col("own").bitwiseXOR(F.col("mask")).alias("value")).join(used, ["segment", "value"]).select("q", "segment", "value", "cells")
        if many:  # so many flips that the values in use are fewer: a stated query set against them
            found_by_value = own.where(F.col("segment").isin(many)).join(used, "segment").where(F.bit_count(F.col("own").bitwiseXOR(F.col("value"))) == r).select("q", "segment", "value", "cells")
            probe = found_by_value if probe is None else probe.unionByName(found_by_value)
        if probe is None:
            break
        probe = probe.withColumn("cell", F.explode(F.sequence(F.lit(0), F.col("cells") - 1))).select("q", "segment", "value", "cell")
        apart = F.col("q").bitwiseXOR(F.col("code"))
        per = [F.bit_count(_part(apart, s, w)) for s, w in segments]
        first = F.lit(m)
        for j in reversed(range(m)):
            first = F.when(per[j] == r, F.lit(j)).otherwise(first)
        fresh = probe.join(index, ["segment", "value", "cell"]).where((F.least(*per) == r) & (first == F.col("segment"))).select("q", "code", "n", F.bit_count(apart).alias("distance"))
        fresh = store.put(fresh, f"found-{r}")
        found = fresh if found is None else found.unionByName(fresh)
        # The k-th distance of each query from a histogram of its verified distances.
        running = Window.partitionBy("q").orderBy("distance")
        kth = found.groupBy("q", "distance").agg(F.sum("n").alias("n")).withColumn("upto", F.sum("n").over(running)).where(F.col("upto") >= k).groupBy("q").agg(F.min("distance").alias("kth"))
        done = store.put(kth.where(F.col("kth") < m * (r + 1)), f"done-{r}")
        pending = store.put(pending.join(done, "q", "left_anti"), f"pending-{r + 1}")
        if not pending.limit(1).count():
            break
    if found is None:
        found = codes.select(F.col("code").alias("q"), "code", "n", F.lit(0).alias("distance")).limit(0)
    running = Window.partitionBy("q").orderBy("distance")
    bound = found.groupBy("q", "distance").agg(F.sum("n").alias("n")).withColumn("upto", F.sum("n").over(running) - F.col("n")).where(F.col("upto") < k).select("q", "distance")
    near = found.join(bound, ["q", "distance"]).select("q", "code", "distance").join(ids.select("code", "id"), "code").join(queries, "q")
    order = Window.partitionBy("query_id").orderBy("distance", "id")
    return near.select("query_id", "id", "distance", F.row_number().over(order).alias("rank")).where(F.col("rank") <= k)
