"""Deduplication of repeated passages by winnowing over word hashes, in DataFrame operations only.

A document is its sequence of words ``\\S+``; line feeds are white space like any other, so a
passage is found wherever in a line it begins or ends.  Fingerprints are the words that
every window of ``WINDOW`` words ranks first: those of a sample by hash, in windows without one those
of a second sample, then of a third, and the first word of windows without any; a fingerprint's gram is the
``GRAM`` words from it on.  All depend only on the words
themselves, so every run of ``RUN_WORDS`` (50) words has a gram within, the same in each copy.

Positions of equal grams are joined: each learns an earlier position, where there is one.  Grams
that follow each other at the same distance from their earlier positions overlap, so their
matches extend each other into chains, and a chain of ``RUN_WORDS`` words or more is a repeated
passage without further proof.  Its ends, and wherever a copy changes its model, are found by
extending to every run of ``RUN_WORDS`` words whose own fingerprints (those that its words alone
settle) all occur elsewhere too and that isn't inside a chain: equal runs are compared, and all but the first (least row, then least word) are
deleted.  Chains and runs together cover each repeated passage of that size to its very ends,
whichever of several earlier places it was copied from.  A deleted word always stands in an
earlier place too, so the first copy is never deleted.  (A run inside a chain needn't be
compared: the earliest place with its words is in no chain, and is compared.)

Deleted lines take their line feeds with them; of a line deleted in part the rest stays,
joined where the passage was cut out.

Skew: all rows of a gram pass through one task to be counted, unsorted and not held; most occur
once and end there.  A gram that occurs again, or a run, that very many documents hold meets in ``SALTS``
windows, which look at neighbours and hold nothing; their first rows alone, at most SALTS a gram, meet again.

Hashes of grams and runs have 64 bits: two different ones are taken for equal with probability
2**-64 a pair; nothing else is left to chance.

Defined cases: null and empty texts pass unchanged; blank lines inside a deleted run go
with it; where doc_ids repeat or are null, the order of the table's rows
stands for the order of ids.  Very long texts are read whole.  Extra columns pass through
whatever their names, but for n_lines_removed, which is replaced.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowsmith.llm._store import Store

RUN_WORDS, GRAM, WINDOW = 50, 26, 25
#: Samples of the words whose hashes are below LOW (a quarter), by the last two bits of these.
SAMPLES, LOW = ((0,), (1,), (2, 3)), -(1 << 62)
#: Windows over which positions of one gram or run are spread.
SALTS = 32


def _put(store: Store, df: DataFrame, name: str, *by: str) -> DataFrame:
    """Stores a table, by two values of a column at most, without sorting; what was shuffled for it goes with its end, not with the session's."""
    conf, keys = store.spark.conf, {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.maxConcurrentOutputFileWriters": "2"}
    before = {key: conf.get(key) for key in keys}
    for key, value in keys.items():
        conf.set(key, value)
    try:
        return store.put(df, name, *by)
    finally:
        for key, value in before.items():
            conf.set(key, value)


def _bind(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once, however often inner lambdas read it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def keyed(docs: DataFrame, store: Store) -> DataFrame:
    """(doc, row, text): a row's other columns as one struct, and a unique key, doc_id itself where that is one."""
    ids = docs.select(F.col("doc_id").cast("long").alias("i"))
    unique = ids.groupBy("i").count().where("count > 1 or i is null").limit(1).count() == 0
    out = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("doc"), F.col("doc_id").cast("long").alias("row"), F.col("text").cast("string").alias("text"))
    return out if unique else store.put(out.withColumn("row", F.monotonically_increasing_id()), "rows")


def _hashes(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit("\\S++"), F.lit(0)), lambda w: F.xxhash64(w))


def _at(code: Column) -> Column:
    """The word of a fingerprint's code."""
    return F.shiftright(code, 20).cast("int")


def _five(code: Column, low: int) -> Column:
    """The number in five bits of a code."""
    return F.shiftright(code, low).bitwiseAND(F.lit(31)).cast("int")


def _prints(h: Column) -> Column:
    """The fingerprints, in order: words of the first sample that a window has, and the first word of windows without any; before them -1.

    Each is the word's number and, in five bits below, how many words before it the last window
    begins that makes it one (none for the first sample): that window and the gram settle it.
    """
    def code(at: Column, back: Column) -> Column:
        return F.shiftleft(at.cast("long"), 5).bitwiseOR(back.cast("long"))

    def place(w: Column) -> Column:
        return F.shiftright(w, 2).cast("int")

    def chosen(w: Column, level: int) -> Column:
        return w.bitwiseAND(F.lit(3)).isin(*SAMPLES[level])

    def cover(x: Column, own: Column, end: Column, words: Column, level: int) -> Column:
        """``own``, the code of word x, and those of windows that begin after x and end before ``end``, all without earlier samples' words; ``words``: all samples' words there."""
        if level == len(SAMPLES):
            return F.when(x < end - WINDOW, F.concat(F.array(own), F.transform(F.sequence(x + 1, end - WINDOW), lambda j: code(j, F.lit(0))))).otherwise(F.array(own))

        def each(c: Column, i: Column, q: Column) -> Column:
            return cover(i, F.when(q == 0, own).otherwise(code(i, i - F.least(i, end - WINDOW))), F.get(c, q + 1), words, level + 1)

        here = F.transform(F.filter(words, lambda w: chosen(w, level) & (place(w) > x) & (place(w) < end)), place)
        gap = _bind(F.concat(F.array(x), here, F.array(end)), lambda c: F.flatten(F.transform(F.slice(c, 1, F.size(c) - 1), lambda i, q: each(c, i, q))))
        return F.when(x < end - WINDOW, gap).otherwise(F.array(own))

    def gaps(c: Column, firsts: Column) -> Column:
        """The codes between words of the first sample, which are those numbered ``firsts`` in c, the samples' words."""

        def each(k: Column, q: Column) -> Column:
            to = F.get(firsts, q + 1)
            x, end = F.coalesce(place(F.get(c, k)), F.lit(-1)), F.coalesce(place(F.get(c, to)), F.size(h))
            return _bind(x, lambda x: _bind(end, lambda end: cover(x, code(x, F.lit(0)), end, F.slice(c, k + 2, to - k - 1), 1)))

        return F.flatten(F.transform(F.slice(firsts, 1, F.size(firsts) - 1), each))

    sampled = F.array_remove(F.transform(h, lambda w, i: F.when(w < LOW, F.shiftleft(i.cast("long"), 2).bitwiseOR(w.bitwiseAND(F.lit(3)))).otherwise(-1)), -1)
    return _bind(sampled, lambda c: _bind(F.concat(F.array(F.lit(-1)), F.array_remove(F.transform(c, lambda w, k: F.when(chosen(w, 0), k).otherwise(-1)), -1), F.array(F.size(c))), lambda firsts: gaps(c, firsts)))


def _hash(words: Column, first: Column, n: int) -> Column:
    """Of n words from ``first``; outside lambdas, where code is generated for it: a short loop, which is compiled at once."""
    return F.xxhash64(F.slice(words, first + 1, n))


def _grams(rows: DataFrame) -> DataFrame:
    """(row, code, g): the fingerprints of texts of RUN_WORDS words or more, and the hashes of their grams.

    A code holds the word and, in five bits each: its ``back``; how far before it the last fingerprint (or -1)
    is; that one's ``back``; how far after it the next fingerprint is (or the first word without a gram).
    """
    hashed = rows.where("text is not null").select("row", _hashes(F.col("text")).alias("h"))
    prints = hashed.select("row", "h", F.when(F.size("h") >= RUN_WORDS, _prints(F.col("h"))).alias("c"))
    each = prints.select("row", "h", "c", F.posexplode(F.slice("c", 2, F.size("c"))).alias("k", "own"))

    def word(c: Column) -> Column:
        return F.shiftright(c, 5).cast("int")

    def back(c: Column) -> Column:
        return c.bitwiseAND(F.lit(31)).cast("int")

    own, last, end = F.col("own"), F.get("c", F.col("k")), F.size("h") - GRAM + 1
    fields = back(own), word(own) - word(last), back(last), F.least(F.coalesce(word(F.get("c", F.col("k") + 2)), end), end) - word(own)
    code = word(own).cast("long")
    for x in fields:
        code = F.shiftleft(code, 5).bitwiseOR(x.cast("long"))
    return each.where(word(own) < end).select("row", code.alias("code"), _hash(F.col("h"), word(own), GRAM).alias("g"))


def _several(prints: DataFrame) -> DataFrame:
    """The rows whose gram occurs more than once.  They are shuffled once, for the counts and for the rows; no task holds a gram's rows."""
    prints = prints.repartition("g")
    one = F.when((F.col("code") < 0) & F.col("row").isNull(), 0).otherwise(1)  # always 1: it keeps all columns, so that both shuffles are one
    counts = prints.groupBy("g").agg(F.sum(one).alias("n")).where("n > 1").select("g")
    return prints.join(counts.hint("shuffle_hash"), "g")


def _linked(df: DataFrame, key: str, at: str, place: Callable[[Column], Column] = lambda c: c) -> DataFrame:
    """(row, at, way, again) of the positions (row, at) of each key; ``place`` gives the word that ``at`` stands for.

    way: a hash of an earlier position of the key, by its row and its distance from this one, null
    if there is none; again: whether there is a later one.  Positions meet under a salt of their
    row; then the first of each salt, in a window of their own.
    """
    salt = F.pmod(F.xxhash64(F.col("row"), F.lit(7)), F.lit(SALTS)).cast("int")

    def way(order: Window) -> Column:
        return F.when(F.lag("row").over(order).isNotNull(), F.xxhash64(F.lag("row").over(order), place(F.col(at)) - place(F.lag(at).over(order))))

    within = Window.partitionBy(key, "salt").orderBy("row", at)
    near = df.withColumn("salt", salt).repartition(key, "salt").withColumn("way", way(within)).withColumn("again", F.lead("row").over(within).isNotNull())
    across = Window.partitionBy(key, "salt").orderBy("row", at)
    near = near.withColumn("salt", F.when(F.col("way").isNull(), -1).otherwise(F.col("salt")))
    return near.select("row", at, F.coalesce("way", way(across)).alias("way"), (F.col("again") | ((F.col("salt") == -1) & F.lead("row").over(across).isNotNull())).alias("again"))


def _groups(prints: Column, follows: Callable[[Column, Column], Column]) -> Column:
    """(x, y) the first and last of the stretches of ``prints`` of which each follows the one before it."""
    begins = F.array_remove(F.transform(prints, lambda y, k: F.when(F.coalesce(follows(F.get(prints, k - 1), y), F.lit(False)), -1).otherwise(k)), -1)
    return _bind(begins, lambda b: F.zip_with(b, F.concat(F.slice(b, 2, F.size(b)), F.array(F.size(prints))), lambda i, j: F.struct(F.get(prints, i).alias("x"), F.get(prints, j - 1).alias("y"))))


def _chains(prints: Column) -> Column:
    """(a, b) of words a to b - 1 that chains of ``prints`` (code, way) prove to repeat, in order: each extends the match of the one before it."""
    groups = _groups(prints, lambda x, y: (x["way"] == y["way"]) & (_at(y["code"]) - _at(x["code"]) <= GRAM))
    return F.filter(F.transform(groups, lambda c: F.struct(_at(c["x"]["code"]).alias("a"), (_at(c["y"]["code"]) + GRAM).alias("b"))), lambda c: c["b"] - c["a"] >= RUN_WORDS)


def _ranges(numbers: Column) -> Column:
    """(lo, hi) of the stretches of consecutive numbers, of numbers in order."""

    def of(s: Column) -> Column:
        lo = F.filter(s, lambda i, k: F.coalesce(F.get(s, k - 1) < i - 1, F.lit(True)))
        hi = F.filter(s, lambda i, k: F.coalesce(F.get(s, k + 1) > i + 1, F.lit(True)))
        return F.zip_with(lo, hi, lambda x, y: F.struct(x.alias("lo"), y.alias("hi")))

    return _bind(numbers, of)


def _starts(prints: Column, chains: Column) -> Column:
    """(lo, hi) of the first words of runs whose own fingerprints are all among ``prints``, and that aren't inside a chain."""

    def bounds(x: Column, y: Column) -> Column:
        """Of stretches without other fingerprints between: runs without the one before, as their words settle it, nor the one after."""
        return F.struct((_at(x) - _five(x, 10) - _five(x, 5) + 1).alias("lo"), (_at(y) + _five(y, 0) - WINDOW).alias("hi"))

    def outside(found: Column) -> Column:
        starts = F.flatten(F.transform(found, lambda r: F.sequence(r["lo"], r["hi"])))
        return _ranges(F.array_except(starts, F.flatten(F.transform(chains, lambda c: F.sequence(c["a"], c["b"] - RUN_WORDS)))))

    groups = _groups(prints, lambda x, y: _at(x["code"]) + _five(x["code"], 0) == _at(y["code"]))
    found = F.filter(F.transform(groups, lambda c: bounds(c["x"]["code"], c["y"]["code"])), lambda r: r["lo"] <= r["hi"])
    return _bind(found, lambda r: F.when(F.size(chains) == 0, r).otherwise(outside(r)))


def marked(rows: DataFrame, store: Store) -> DataFrame:
    """The table with chains, and the first words (lo, hi) of runs to compare; null where no gram occurs elsewhere too: apart, by ``some``."""
    shared = _linked(_several(_grams(rows)), "g", "code", _at).where("way is not null or again")
    places = shared.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("code", "way"))).alias("p"))
    places = places.select("row", "p", _chains(F.col("p")).alias("chains"))
    places = _put(store, places.select("row", "chains", _starts(F.col("p"), F.col("chains")).alias("starts")), "places")
    found = rows.join(places.hint("shuffle_hash"), "row", "left")  # texts needn't be sorted
    return _put(store, found.withColumn("some", F.col("chains").isNotNull()), "marked", "some")


def repeated(found: DataFrame, store: Store) -> DataFrame:
    """(row, a, b): words a to b - 1 of a row occur in earlier places; of a marked table."""
    def pieces(h: Column) -> Column:
        return F.transform("starts", lambda r: F.struct(r["lo"].alias("lo"), F.slice(h, r["lo"] + 1, r["hi"] - r["lo"] + RUN_WORDS).alias("h")))

    words = found.where("some and size(starts) > 0").select("row", F.inline(_bind(_hashes(F.col("text")), pieces)))
    runs = words.select("row", "lo", "h", F.explode(F.sequence(F.lit(0), F.size("h") - RUN_WORDS)).alias("i"))
    runs = runs.select("row", (F.col("lo") + F.col("i")).alias("first"), _hash(F.col("h"), F.col("i"), RUN_WORDS).alias("r"))
    later = _linked(runs, "r", "first").where("way is not null")
    chains = found.where("some").select("row", F.inline("chains"))
    return _put(store, later.select("row", F.col("first").alias("a"), (F.col("first") + RUN_WORDS).alias("b")), "runs").unionAll(chains)


def _cuts(spans: DataFrame) -> DataFrame:
    """(row, cuts): overlapping and adjoining spans as one (a, b), words a to b - 1, in order."""
    order = Window.partitionBy("row").orderBy("a", "b")
    reached = F.max("b").over(order.rowsBetween(Window.unboundedPreceding, -1))
    pieces = spans.withColumn("begins", F.coalesce(F.col("a") > reached, F.lit(True)).cast("int")).withColumn("cut", F.sum("begins").over(order))
    pieces = pieces.groupBy("row", "cut").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    return pieces.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("cuts"))


def _without(text: Column, cuts: Column) -> Column:
    """The text without the cuts' words."""

    def space(piece: Column) -> Column:
        return F.regexp_replace(piece, "^\\S++", "")

    def glue(lead: Column, trail: Column, begin: Column, end: Column) -> Column:
        """What stands for a cut, from the white space before and after it."""
        starts, ends = begin | lead.contains("\n"), end | trail.contains("\n")
        before = F.regexp_replace(lead, "[^\n]*$", "")  # the lines above, with their feeds
        whole = F.when(trail.contains("\n"), F.concat(before, F.regexp_replace(trail, "^[^\n]*\n", ""))).otherwise(F.regexp_replace(before, "\n$", ""))
        return F.when(starts & ends, whole).when(ends, trail).otherwise(lead)

    def cut(p: Column, head: Column, since: Column, c: Column) -> Column:
        """The text from the last cut's end to this cut's, with this cut's glue."""
        a, b = c["a"], c["b"]
        last = F.coalesce(F.get(p, a - 1), F.lit(""))
        lead = F.when(a == 0, head).otherwise(space(last))
        kept = F.array_join(F.slice(p, since + 1, F.greatest(a - since - 1, F.lit(0))), "")
        return F.concat(F.when((since == 0) & (a > 0), head).otherwise(""), kept, F.regexp_extract(last, "^\\S*+", 0), glue(lead, space(F.get(p, b - 1)), a == 0, b == F.size(p)))

    def of(p: Column) -> Column:
        head = F.regexp_extract(text, "^\\s*+", 0)
        parts = F.transform(cuts, lambda c, i: cut(p, head, F.when(i == 0, 0).otherwise(F.get(cuts, i - 1)["b"]), c))
        rest = F.slice(p, F.element_at(cuts, -1)["b"] + 1, F.size(p))
        return F.concat(F.array_join(parts, ""), F.array_join(rest, ""))

    return _bind(F.regexp_extract_all(text, F.lit("\\S++\\s*+"), F.lit(0)), of)


def passage_dedup(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with later repeated runs deleted from text; adds n_lines_removed, by how many lines the text is shorter."""
    store = Store(docs.sparkSession, "passages")
    found = marked(keyed(docs, store), store)
    cuts = _put(store, _cuts(repeated(found, store)), "cuts")
    whole = found.where("not some").select("doc", "text", F.lit(None).cast(cuts.schema["cuts"].dataType).alias("cuts"))
    out = whole.unionByName(found.where("some").join(cuts.hint("shuffle_hash"), "row", "left").select("doc", "text", "cuts"))
    out = out.withColumn("left", F.when(F.col("cuts").isNotNull(), _without(F.col("text"), F.col("cuts"))))

    def lines(text: Column) -> Column:
        return F.when(text != "", F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).otherwise(0)

    fixed = F.coalesce("left", "text")
    removed = F.when(F.col("cuts").isNull(), 0).otherwise(lines(F.col("text")) - lines(F.col("left"))).cast("int").alias("n_lines_removed")
    return out.select(*(fixed.alias(c) if c == "text" else F.col("doc")[c].alias(c) for c in docs.columns if c != "n_lines_removed"), removed)
