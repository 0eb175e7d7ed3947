"""Line deduplication by winnowing over line hashes, in DataFrame operations only.

A document is its sequence of non-blank trimmed lines.  At each line begins a
gram, the shortest run of lines with ``GRAM_WORDS`` words; a line is a fingerprint
if its gram's hash is least in some window of grams that begin within
``WINDOW_WORDS`` words.  Both depend only on the lines themselves, so two copies of any
run of ``GRAM_WORDS + WINDOW_WORDS`` (50) words or more share a fingerprint for certain,
be it one long line or many short ones.

Where a fingerprint occurs in several positions, the match is extended both ways: to
every shortest run of ``RUN_WORDS`` words that begins before it or ends after it and
contains it.  Runs with equal lines are grouped; all but the first (least row, then least
line) are deleted.  Together these runs cover each repeated run of that size to its very
ends, whichever of several earlier places it was copied from.  A deleted line always
has an equal line in an earlier place, so the first copy of a line is never deleted.

Skew: grouped minima pre-aggregate, joins on a fingerprint or run are salted, what a
fingerprint carries is bounded (at most 100 runs), and no group is gathered.

Defined cases: null and empty texts pass unchanged; blank lines go with the deleted
line before them; where doc_ids repeat or are null, the order of the table's rows
stands for the order of ids.  Extra columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowsmith.llm._store import Store

GRAM_WORDS, WINDOW_WORDS, RUN_WORDS = 25, 25, 50
SALTS = 8
_ROW = "__row"


def _keyed(docs: DataFrame, store: Store) -> DataFrame:
    """Adds a unique row key: doc_id itself where that is one."""
    ids = docs.select(F.col("doc_id").cast("long").alias("i"))
    unique = ids.groupBy("i").count().where("count > 1 or i is null").limit(1).count() == 0
    if unique:
        return docs.withColumn(_ROW, F.col("doc_id").cast("long"))
    return store.put(docs.withColumn(_ROW, F.monotonically_increasing_id()), "rows")


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def repeated_runs(keyed: DataFrame, store: Store) -> DataFrame:
    """(row, first, last): later repeated runs, by line number from 0."""
    lines = keyed.where("text is not null").select(F.col(_ROW).alias("row"), F.posexplode(_lines(F.col("text"))).alias("at", "line"))
    lines = lines.select("row", "at", F.btrim("line", F.lit(" \t\r\x0b\x0c")).alias("line")).where("line <> ''")
    lines = lines.select("row", "at", F.xxhash64("line").alias("h"), F.regexp_count("line", F.lit("\\S+")).cast("long").alias("w"))
    by = Window.partitionBy("row")
    order = by.orderBy("at")
    seq = lines.withColumn("e", F.sum("w").over(order)).withColumn("s", F.col("e") - F.col("w"))
    ahead, back = by.orderBy("s"), by.orderBy("e")

    def run(frame: Window, words: int, *more: Column) -> Column:
        """The run's hash and bounds, null where the text ends before it has its words."""
        return F.when(F.sum("w").over(frame) >= words, F.struct(F.xxhash64(F.collect_list("h").over(frame)).alias("r"), *more))

    later, earlier = ahead.rangeBetween(0, RUN_WORDS - 1), back.rangeBetween(1 - RUN_WORDS, 0)
    seq = seq.withColumn("g", run(ahead.rangeBetween(0, GRAM_WORDS - 1), GRAM_WORDS)["r"])
    seq = seq.withColumn("from", run(later, RUN_WORDS, F.col("at").alias("first"), F.max("at").over(later).alias("last")))
    seq = seq.withColumn("to", run(earlier, RUN_WORDS, F.min("at").over(earlier).alias("first"), F.col("at").alias("last")))
    least = F.min("g").over(ahead.rangeBetween(0, WINDOW_WORDS - 1))
    seq = seq.withColumn("least", least)
    chosen = F.max("least").over(ahead.rangeBetween(1 - WINDOW_WORDS, 0)) == F.col("g")
    around = F.concat(F.collect_list("from").over(ahead.rangeBetween(1 - RUN_WORDS, 0)), F.collect_list("to").over(back.rangeBetween(0, RUN_WORDS - 1)))
    prints = store.put(seq.select("row", "g", chosen.alias("chosen"), around.alias("runs")).where("chosen").drop("chosen"), "prints")

    salts, salt = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int").alias("salt")
    several = prints.groupBy("g").count().where("count > 1").select("g", salts)
    runs = prints.select("*", salt).join(several, ["g", "salt"]).select("row", F.explode("runs").alias("x")).select("row", "x.*").distinct()
    runs = store.put(runs, "runs")
    firsts = runs.groupBy("r").agg(F.count("*").alias("times"), F.min(F.struct("row", "first")).alias("source")).where("times > 1").select("r", "source", salts)
    return runs.select("*", salt).join(firsts, ["r", "salt"]).where(F.struct("row", "first") > F.col("source")).select("row", "first", "last").distinct()


def line_dedup(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with later repeated runs deleted from text; adds n_lines_removed."""
    store = Store(docs.sparkSession, "lines")
    keyed = _keyed(docs, store)
    runs = repeated_runs(keyed, store)
    gone = runs.select("row", F.explode(F.sequence("first", "last")).alias("at")).distinct().groupBy("row").agg(F.collect_list("at").alias("__gone"))
    out = keyed.join(gone.withColumnRenamed("row", _ROW), _ROW, "left")
    # The one-element outer array binds the split lines once for the inner lambda.
    kept = F.array_except(F.sequence(F.lit(0), F.size(_lines(F.col("text"))) - 1), F.col("__gone"))
    text = F.get(F.transform(F.array(F.struct(_lines(F.col("text")).alias("l"), kept.alias("k"))), lambda x: F.array_join(F.transform(x["k"], lambda i: F.get(x["l"], i)), "\n")), F.lit(0))
    fixed = F.when(F.col("__gone").isNull(), F.col("text")).otherwise(text)
    removed = F.coalesce(F.size("__gone"), F.lit(0)).alias("n_lines_removed")
    return out.select(*(fixed.alias(c) if c == "text" else F.col(c) for c in docs.columns if c != "n_lines_removed"), removed)
