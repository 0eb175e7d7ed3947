"""Packing token sequences by concatenate-and-cut.

The first pass tokenises each text once and writes its ids with the running token
count inside its partition.  Prefix sums over the partitions' totals then turn these
into offsets in the one long stream of all ids, and the second pass cuts the stream
every ``width`` ids: a document that crosses a cut gives one piece on each side.  Every
sequence but the last is full.  Nothing is shuffled.

Defined cases: a null text counts as empty and gives the end id alone; rows that
repeat are packed as often as they come; an empty table gives no piece.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rowsmith.llm._store import Store

#: Documents in a batch that goes back to Spark.
ROWS = 256
#: A partition's offset is 16 bytes; beyond this many partitions the offsets are joined by a shuffle.
BROADCAST_PARTITIONS = 1 << 20

#: Words of these characters alone are normalised alike by Python and by the tokenizer's own steps.
_PLAIN = re.compile(r"[\x21-\x7e\u00c0-\u012f\u0131-\u0148\u014a-\u017f]+")
_PRETOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Entries each cache holds before it is emptied.
CACHE = 1 << 20


def _byte_letters() -> dict[int, str]:
    """The printable stand-in for each byte in a byte-level vocabulary."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


_LETTERS = str.maketrans({chr(b): c for b, c in _byte_letters().items()})


class Encoder:
    """Token ids of texts as little-endian uint32, exactly those of the tokenizer file.

    The tokenizer drops white space and never joins across it, so a text's ids are
    those of its blank-separated words in turn.  Ids of words, and of the parts of words
    that the tokenizer merges on its own, are cached.  A word with any character outside
    a plain Latin set, or with the name of a special token, goes to the tokenizer itself.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one thread for each task's core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merge = self.tokenizer.model.tokenize
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.words: dict[bytes, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def _part(self, part: str) -> bytes:
        found = self.parts.get(part)
        if found is None:
            letters = part if part.isascii() else part.encode().decode("latin-1").translate(_LETTERS)
            found = self.parts[part] = struct.pack(f"<{len(tokens := self.merge(letters))}I", *[t.id for t in tokens])
        return found

    def _word(self, word: bytes) -> bytes:
        text = word.decode()
        if word.isalpha():  # ASCII letters only
            return self._part(text.lower())
        if _PLAIN.fullmatch(text) and not ("|" in text and any(s in text for s in self.special)):
            return b"".join([self._part(part) for part in _PRETOKEN.findall(text.lower())])
        return b"".join(i.to_bytes(4, "little") for i in self.tokenizer.encode(text, add_special_tokens=False).ids)

    def ids(self, text: str | bytes) -> bytes:
        if isinstance(text, str):
            text = text.encode()
        words = text.split()
        known = self.words
        try:
            return b"".join(map(known.__getitem__, words))
        except KeyError:
            if len(known) + len(words) > CACHE:
                known.clear()
            if len(self.parts) > CACHE:
                self.parts.clear()
            for w in words:
                if w not in known:
                    known[w] = self._word(w)
            return b"".join([known[w] for w in words])


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The Python worker's encoder for a tokenizer file; its caches last as long as the worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _tokenise(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, start, tail = encoder(path).ids, TaskContext.get().partitionId(), 0, end_id.to_bytes(4, "little")
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            for lo in range(0, batch.num_rows, ROWS):
                ids = [encode(t.as_py() or b"") + tail for t in texts.slice(lo, ROWS)]
                n = np.array([len(x) // 4 for x in ids], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(n), part, np.int64)), batch.column(0).slice(lo, ROWS), pa.array(start + np.cumsum(n) - n), pa.array(n), pa.array(ids, pa.binary())],
                    names=["part", "doc_id", "begin", "doc_tokens", "ids"],
                )
                start += int(n.sum())

    return run


def pack(docs: DataFrame, tokenizer: str, width: int = 4096, end_id: int = 2) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids (little-endian uint32)."""
    store = Store(docs.sparkSession, "pack")
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    tokens = store.put(source.mapInArrow(_tokenise(tokenizer, end_id), "part long, doc_id long, begin long, doc_tokens long, ids binary"), "tokens")
    totals = tokens.groupBy("part").agg(F.max(F.col("begin") + F.col("doc_tokens")).alias("total"))
    # One row for each partition of the input: the window's single task sees no document.
    window = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = store.put(totals.select("part", F.coalesce(F.sum("total").over(window), F.lit(0)).alias("before")), "offsets")
    if offsets.count() <= BROADCAST_PARTITIONS:
        offsets = F.broadcast(offsets)
    placed = tokens.join(offsets, "part").withColumn("at", F.col("before") + F.col("begin"))
    last = F.floor((F.col("at") + F.col("doc_tokens") - 1) / F.lit(width))
    cut = placed.withColumn("sequence_id", F.explode(F.sequence(F.floor(F.col("at") / F.lit(width)), last)))
    lo = F.greatest(F.col("sequence_id") * width, F.col("at"))
    hi = F.least((F.col("sequence_id") + 1) * width, F.col("at") + F.col("doc_tokens"))
    cut = cut.withColumn("start", lo - F.col("at")).withColumn("length", hi - lo).withColumn("offset", lo - F.col("sequence_id") * width)
    ids = F.substring("ids", (F.col("start") * 4 + 1).cast("int"), (F.col("length") * 4).cast("int"))
    return cut.select("doc_id", "start", "length", F.crc32(ids).alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", ids.alias("ids"))
