from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from rowsmith.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("width", [7, 4096])
def test_pieces_rebuild_every_document(spark, width):
    t = Tokenizer.from_file(PATH)
    rows = [(i, t_, "en", "s", 0) for i, t_ in enumerate(["Hello world, it's 2024!", "", None, "Ünï cödé ßtraße ñandú " * 40, "a", "word " * 3000, "  \n ", "a"])]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3).selectExpr("*", "1 as part", "2 as ids", "3 as before")
    out = packing.pack(df, PATH, width).collect()
    expected = {i: [*t.encode(x or "", add_special_tokens=False).ids, 2] for i, x, *_ in rows}
    found = {}
    for r in sorted(out, key=lambda r: (r.doc_id, r.start)):
        assert r.start == len(found.get(r.doc_id, [])) and r.doc_tokens == len(expected[r.doc_id])
        assert r.length >= 1 and zlib.crc32(bytes(r.ids)) == r.ids_crc32
        found.setdefault(r.doc_id, []).extend(np.frombuffer(bytes(r.ids), "<u4").tolist())
        assert len(r.ids) == 4 * r.length
    assert found == expected
    sequences = {}
    for r in sorted(out, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == sequences.get(r.sequence_id, 0)
        sequences[r.sequence_id] = r.offset + r.length
    assert sorted(sequences) == list(range(len(sequences)))
    assert all(n == width for s, n in sequences.items() if s < len(sequences) - 1)


def test_ids_are_the_tokenizers_own(monkeypatch):
    t = Tokenizer.from_file(PATH)
    monkeypatch.setattr(packing, "CACHE", 50)
    rnd = random.Random(1)
    alphabet = "abcXYZ'sdéÉßçñĀžſ019.,;!?-_#%&<|>ΣσςİıŉÅ日本語한글🙂e\u0301\u200b\u00a0\u1e9e\x1c\x85ªºµ×²½ \t\n\r\x0b\x0c"
    texts = ["".join(rnd.choices(alphabet, k=rnd.randint(0, 200))) for _ in range(400)]
    texts += ["The quick Brown fox's tail\n\njumps; ÀÉ 123 it'll I'VE", "a<|endoftext|>b <|startoftext|>", "ΟΔΟΣ ΟΔΟΣ.", "x" * 5000]
    e = packing.Encoder(PATH)
    for text in texts * 2:
        assert np.frombuffer(e.ids(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids, repr(text)


def test_empty_table_and_repeated_rows(spark):
    assert packing.pack(spark.createDataFrame([], SCHEMA), PATH).count() == 0
    out = packing.pack(spark.createDataFrame([(1, "a", "", "", 1)] * 3 + [(None, None, None, None, None)], SCHEMA), PATH)
    assert sorted((r.doc_id or 0, r.doc_tokens) for r in out.collect()) == [(0, 1), (1, 2), (1, 2), (1, 2)]
