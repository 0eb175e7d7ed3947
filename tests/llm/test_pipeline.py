from __future__ import annotations

import random
import sys
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).parent))
import corpus_pipeline as cp  # noqa: E402
from test_line_dedup import brute_runs  # noqa: E402
from test_near_dedup import brute  # noqa: E402

BAD = ("idiot", "moron", "scum")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents with planted toxic words, repeated passages, near copies and junk; labels for most."""
    rnd = random.Random(4)
    vocabulary = ["".join(rnd.choices("abcdefgh", k=rnd.randint(2, 8))) for _ in range(500)]
    passage = " ".join(rnd.choices(vocabulary, k=60))
    rows, labels = [], []
    for i in range(240):
        lines = [" ".join(rnd.choices(vocabulary, k=rnd.randint(5, 40))) for _ in range(rnd.randint(1, 5))]
        good, toxic = rnd.random() < 0.8, rnd.random() < 0.2
        if rows and rnd.random() < 0.2:  # a near copy, one word of many changed, without long equal lines
            words = rnd.choice(rows)[1].split()
            words[rnd.randrange(len(words))] = "changed"
            lines = [" ".join(words)]
            good, toxic = True, any(w in words for w in BAD)
        if rnd.random() < 0.2:
            lines.insert(rnd.randint(0, len(lines)), passage)
        if toxic and not any(b in " ".join(lines) for b in BAD):
            lines[0] += " " + rnd.choice(BAD)
        text = "\n".join(lines) if good else "!! ".join("\n".join(lines).upper().split(" "))
        rows.append((i, text, "en", "src0" if i % 3 else "src1", len(text)))
        if rnd.random() < 0.9:
            labels.append((i, int(good), int(any(b in text.lower() for b in BAD))))
    out = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    return str(out)


def test_stages_against_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, t = docs.columns, Tokenizer.from_file(public_tokenizers.path(cp.TOKENIZER))
    assert [n for n, _ in cp.STAGES] == ["toxicity", "line_dedup", "near_dedup", "mixing", "packing"]
    for k, (name, stage) in enumerate(cp.STAGES):
        before = {r.doc_id: r for r in docs.collect()}
        out = stage(spark, docs, folder)
        if name != "packing":
            assert out.columns == columns
            out.write.mode("overwrite").parquet(f"{folder}/stage{k}")
            out = spark.read.parquet(f"{folder}/stage{k}")
        rows = out.collect()
        ids = sorted(r.doc_id for r in rows)
        if name == "toxicity":
            assert ids == sorted(i for i, r in before.items() if not any(b in r.text.lower() for b in BAD))
        elif name == "line_dedup":
            gone = brute_runs([(i, r.text) for i, r in before.items()])
            want = {i: "\n".join(x for n, x in enumerate(r.text.split("\n")) if (i, n) not in gone) for i, r in before.items()}
            touched = {i for i, _ in gone}
            assert touched and {r.doc_id: r.text for r in rows} == {i: x for i, x in want.items() if i not in touched or x.strip()}
            assert all(r.n_chars == len(r.text) for r in rows)
        elif name == "near_dedup":
            groups = brute([(i, r.text) for i, r in before.items()], k=5)
            assert ids == sorted(i for i, (_, c) in groups.items() if c == i) and len(ids) < len(before)
        elif name == "mixing":
            good = {i for i, r in before.items() if "!!" not in r.text and not r.text.isupper()}
            assert len(good - set(ids)) <= 0.03 * len(good) and sum(i not in good for i in ids) < 0.6 * len(before.keys() - good)
            assert all(r.text == before[r.doc_id].text for r in rows)
        else:
            pieces: dict = {}
            for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
                pieces.setdefault(r.doc_id, []).append(np.frombuffer(bytes(r.ids), "<u4"))
            copies = {r.doc_id: 0 for r in rows}
            for r in docs.collect():
                copies[r.doc_id] += 1
            for i, got in pieces.items():
                ids_ = [*t.encode(before[i].text, add_special_tokens=False).ids, 2]
                assert sum(map(len, got)) == copies[i] * len(ids_) and sorted(np.concatenate(got).tolist()) == sorted(ids_ * copies[i])
        docs = out
    again = cp.run(spark, folder)
    assert again.count() == docs.count()


def test_stages_on_odd_tables(spark, folder):
    """Every stage on nulls in any column, empty and repeated rows, no rows, and extra columns of clashing names."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    long = "word " * 30_000
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (None, "some words", "en", "s", 10), (3, " \n\n", "en", None, 3), (4, long, "en", "s", len(long)), (5, "a tie", "en", "s", 5), (6, "a tie", "en", "s", 5)]
    odd = spark.createDataFrame(rows, schema).selectExpr("*", "1 as row", "2 as _err", "3 as copies", "4 as __gone")
    for docs in (odd, odd.limit(0)):
        for name, stage in cp.STAGES:
            out = stage(spark, docs, folder)
            n = out.count()
            assert name == "packing" or out.columns == list(cp.COLUMNS)
            assert (n == 0) == (docs.limit(1).count() == 0)
            if name == "toxicity" and n:
                assert sorted(str(r.doc_id) for r in out.collect()) == sorted(str(r[0]) for r in rows)
            if name == "near_dedup" and n:
                assert {r.doc_id for r in out.collect()} == {None, 1, 2, 3, 4, 5}
