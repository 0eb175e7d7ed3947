"""SimHash document fingerprints and search by permuted block tables, in DataFrame operations only.

Terms are pairs of neighbouring words (a lone word stands for itself), weighted by how
often they occur.  Each of the 64 bits of a term's hash votes; a bit is set where the
ones hold the majority, so equal texts always have equal fingerprints.  Votes are counted
two bits to a 64-bit sum, in 32 sums: partial aggregation leaves one row for each document
and partition, whatever the length of a text.

Search: fingerprints within Hamming distance r share, of r + ``EXTRA`` equal blocks, at
least ``EXTRA`` unchanged.  Each choice of ``EXTRA`` blocks is one permuted table keyed by
these blocks; tables are joined on their keys and pairs verified.  Documents of equal
fingerprint are one class first, so copies are never expanded into pairs, and crowded
keys are cut into salted cells.

Defined cases: a null or blank text has no terms and fingerprint 0; very long texts are
counted whole; repeated rows each have their result.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowsmith.llm._store import Store

HALVES = 32
EXTRA = 3
#: Fingerprints of one table key that are compared in one cell.
CROWD = 1000
_LANE = 0x0000000100000001
WORDS = "[^\\x20\\x09-\\x0D]+"


def terms(text: Column) -> Column:
    """Hashes of neighbouring words, once for each occurrence."""
    words = F.regexp_extract_all(text, F.lit(f"({WORDS})"), F.lit(1))

    def pairs(w: Column) -> Column:
        return F.when(F.size(w) < 2, F.transform(w, lambda x: F.xxhash64(x))).otherwise(F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w)), lambda a, b: F.xxhash64(a, b)))

    return F.get(F.transform(F.array(words), pairs), F.lit(0))  # binds the words once


def fingerprints(texts: DataFrame, keys: list[str], text: str, out: str) -> DataFrame:
    """(*keys, out): the 64-bit fingerprint of each row's text; keys identify rows."""
    exploded = texts.select(*keys, F.explode_outer(terms(F.coalesce(F.col(text), F.lit("")))).alias("h"))
    counts = exploded.groupBy(*keys).agg(F.count("h").alias("terms"), *(F.sum(F.shiftrightunsigned("h", i).bitwiseAND(_LANE)).alias(f"c{i}") for i in range(HALVES)))
    bits = F.lit(0).cast("long")
    for i in range(HALVES):
        low, high = F.col(f"c{i}").bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned(f"c{i}", 32)
        bits = bits.bitwiseOR(F.when(low * 2 > F.col("terms"), F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
        top = (1 << (i + 32)) - (1 << 64 if i + 32 == 63 else 0)
        bits = bits.bitwiseOR(F.when(high * 2 > F.col("terms"), F.lit(top)).otherwise(F.lit(0)).cast("long"))
    return counts.select(*keys, bits.alias(out))


def hexadecimal(fingerprint: Column) -> Column:
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))


def alike(x: Column, y: Column) -> Column:
    """1 less the share of bits that differ."""
    return 1 - F.bit_count(x.bitwiseXOR(y)) / F.lit(64.0)


def near_pairs(fingerprinted: DataFrame, fingerprint: str, radius: int = 3) -> DataFrame:
    """(x, y, distance) for all pairs of distinct fingerprints x < y within ``radius``, once each."""
    blocks = radius + EXTRA
    edges = [64 * i // blocks for i in range(blocks + 1)]
    distinct = fingerprinted.select(F.col(fingerprint).alias("f")).where("f is not null").distinct()

    def key(chosen: tuple[int, ...]) -> Column:
        mask = sum(((1 << (edges[b + 1] - edges[b])) - 1) << edges[b] for b in chosen)
        return F.col("f").bitwiseAND(mask - (1 << 64) if mask >= 1 << 63 else mask)

    entries = F.array(*(F.struct(F.lit(t).alias("table"), key(c).alias("key")) for t, c in enumerate(combinations(range(blocks), EXTRA))))
    tables = distinct.select("f", F.explode(entries).alias("e")).select("f", "e.*")
    # Most keys have one fingerprint; crowded ones are cut into cells of about CROWD.
    shared = tables.groupBy("table", "key").count().where("count > 1").select("table", "key", F.ceil(F.col("count") / F.lit(CROWD)).cast("int").alias("cells"))
    tables = tables.join(shared, ["table", "key"])
    left = tables.select("table", "key", F.pmod(F.xxhash64("f"), F.col("cells")).cast("int").alias("cell"), F.col("f").alias("x"))
    right = tables.select("table", "key", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("cell"), F.col("f").alias("y"))
    distance = F.bit_count(F.col("x").bitwiseXOR(F.col("y")))
    return left.join(right, ["table", "key", "cell"]).where((F.col("x") < F.col("y")) & (distance <= radius)).select("x", "y", distance.alias("distance")).distinct()


def _following(rows: DataFrame, store: Store) -> DataFrame:
    """(row, n, next_row): the row next by descending (doc_id, row); after the last, the first.

    Ids alone are range-partitioned; what crosses a boundary comes from a table with one
    row for each partition.
    """
    ids = rows.select("row", "doc_id", "n").repartitionByRange("doc_id", "row").withColumn("part", F.spark_partition_id())
    ids = store.put(ids, "ids")
    ends = ids.groupBy("part").agg(F.max(F.struct("doc_id", "row")).alias("top"))
    order = Window.orderBy("part")
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = ends.select("part", F.coalesce(F.lag("top").over(order), F.last("top").over(everything))["row"].alias("before"))
    within = Window.partitionBy("part").orderBy("doc_id", "row")
    linked = ids.withColumn("lower", F.lag("row").over(within)).join(ends, "part")
    return store.put(linked.select("row", "n", F.coalesce("lower", "before").alias("next_row")), "linked")


def edit_study(docs: DataFrame, radius: int = 3) -> DataFrame:
    """Fingerprints of whole texts, of their edited texts and of the next documents, with likenesses.

    The edited text has its last floor(n/2) code points replaced by the first as many of
    the next document by descending doc_id.  Only first halves and heads travel to the
    join, not whole texts.  class_id is the smallest doc_id of equal fingerprint, n_near
    the number of other fingerprints within ``radius``.  Rows that share a doc_id follow
    each other in the table's order; rows without one come last.
    """
    store = Store(docs.sparkSession, "simhash")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    if own.groupBy("doc_id").count().where("count > 1 or doc_id is null").limit(1).count():
        own = store.put(own.withColumn("row", F.monotonically_increasing_id()), "rows")
    else:
        own = own.withColumn("row", F.col("doc_id"))
    own = own.withColumn("n", F.length("text").cast("long"))
    linked = _following(own, store)
    whole = store.put(fingerprints(own, ["row", "doc_id"], "text", "f"), "whole")

    half = F.floor(F.col("n") / 2).cast("int")
    # Both sides grow with the documents: a merge join at every size, never a broadcast.
    wanted = linked.select(F.col("next_row").alias("row"), F.col("row").alias("for_row"), half.alias("take")).hint("merge")
    heads = own.select("row", "text").join(wanted, "row")
    heads = heads.select(F.col("for_row").alias("row"), F.left("text", F.col("take")).alias("head"))
    edited = own.select("row", "n", F.left("text", (F.col("n") - half).cast("int")).alias("kept")).join(heads, "row").select("row", "n", F.concat("kept", "head").alias("text"))
    edited = fingerprints(edited.withColumn("edited_sha256", F.sha2("text", 256)), ["row", "n", "edited_sha256"], "text", "e")

    pairs = store.put(near_pairs(whole, "f", radius), "pairs")
    near = pairs.select(F.explode(F.array("x", "y")).alias("f")).groupBy("f").agg(F.count("*").alias("n_near"))
    classes = whole.groupBy("f").agg(F.min("doc_id").alias("class_id")).join(near, "f", "left")
    named = whole.join(edited, "row").join(linked.select("row", "next_row"), "row").join(whole.select(F.col("row").alias("next_row"), F.col("f").alias("next_f")), "next_row").join(classes, "f")
    return named.select(
        "doc_id", F.col("n").alias("n_chars"), "edited_sha256",
        hexadecimal(F.col("f")).alias("fingerprint"), hexadecimal(F.col("e")).alias("edited_fingerprint"),
        alike(F.col("f"), F.col("e")).alias("near_edited"), alike(F.col("f"), F.col("next_f")).alias("near_next"),
        "class_id", F.coalesce("n_near", F.lit(0)).alias("n_near"),
    )
