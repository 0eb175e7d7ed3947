"""Connected components over a table of links, by label contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowsmith.llm._store import Store


def components(store: Store, links: DataFrame, name: str = "cc", max_rounds: int = 60) -> DataFrame:
    """Labels every node of ``links(a, b)`` with the smallest node it can reach.

    Alternates large-star and small-star steps (Kiveris et al., 2014), so that
    each round is two grouped minima over an edge table that never outgrows the
    input.  Minima pre-aggregate before the shuffle: a node with very many links
    costs no task more.  Returns (node, component); nodes without links are absent.
    Null ends and loops are ignored.
    """
    edges = store.put(
        links.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
        .where("a is not null and b is not null and a <> b")
        .distinct(),
        f"{name}-0",
    )
    before = None
    for i in range(1, max_rounds + 1):
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionAll(edges.select(F.col("lo"), F.col("hi")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).where("hi <> lo").distinct()
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(low, "hi").select(F.explode(F.array(F.struct(F.col("hi"), F.col("m").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")))).alias("e")).select("e.*").where("hi <> lo").distinct()
        edges = store.put(small, f"{name}-{i}")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo") % 1_000_000_007)).first()
        if i > 1:
            store.drop(f"{name}-{i - 1}")
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components: not settled after {max_rounds} rounds")
    labelled = edges.groupBy("hi").agg(F.min("lo").alias("component")).withColumnRenamed("hi", "node")
    return labelled.unionAll(edges.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct().join(labelled.select("node"), "node", "left_anti"))
