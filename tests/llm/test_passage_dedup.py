from __future__ import annotations

import random

import pytest
from test_line_dedup import frame, sentence, texts

from rowsmith.llm import passage_dedup as pd


def brute_words(rows, least=50):
    """The words each text has left without those in a run of ``least`` words that occurs in an earlier place."""
    seen, out = set(), {}
    for i, t in sorted(rows):
        words = t.split()
        gone = set()
        for a in range(len(words) - least + 1):
            key = tuple(words[a : a + least])
            if key in seen:
                gone.update(range(a, a + least))
            seen.add(key)
        out[i] = [w for n, w in enumerate(words) if n not in gone]
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_passages_inside_lines_go(spark, seed):
    rnd = random.Random(seed)
    passages = [sentence(rnd, n).split() for n in (49, 50, 51, 80, 200)]
    rows = []
    for i in range(60):
        words = sentence(rnd, rnd.randint(20, 150)).split()
        for p in rnd.sample(passages, rnd.randint(0, 3)):
            at = rnd.randint(0, len(words))
            words[at:at] = p
        if i % 2:  # one long line
            text = " ".join(words)
        else:  # lines that break anywhere
            text = "".join(w + rnd.choice(("\n", "\n\n", " \r\n") if rnd.random() < 0.1 else (" ",)) for w in words)
        rows.append((i, text))
    want = brute_words(rows)
    got = texts(pd.passage_dedup(frame(spark, rows)))
    assert {i: t.split() for i, t in got.items()} == want
    assert sum(len(want[i]) < len(t.split()) for i, t in rows) > 20
    assert all(got[i] == t for i, t in rows if len(want[i]) == len(t.split()))


def test_white_space_around_cuts(spark):
    p = " ".join(f"p{i}" for i in range(60))
    two = p.replace("p30 ", "p30\n\n")
    rows = [(1, p), (2, f"c2 {p} d2"), (3, f"a3\n  c3 {p}\nb3"), (4, f"a4\n{p} c4\r\nb4"), (5, f"a5\n{p}\nb5"), (6, f"c6 {two} d6"), (7, f"a7\n{p}"), (8, f"  {p} b8  "), (9, f"a9\n\n{p}\n\nb9 {p}\n")]
    out = {r.doc_id: (r.text, r.n_lines_removed) for r in pd.passage_dedup(frame(spark, rows)).collect()}
    assert out[1] == (p, 0) and out[2] == ("c2 d2", 0) and out[3] == ("a3\n  c3\nb3", 0) and out[4] == ("a4\nc4\r\nb4", 0) and out[5] == ("a5\nb5", 1)
    assert out[6] == ("c6 d6", 2) and out[7] == ("a7", 1) and out[8] == ("  b8  ", 0) and out[9] == ("a9\n\n\nb9\n", 1)


def test_edge_cases(spark):
    p = " ".join(f"p{i}" for i in range(55))
    rows = [(1, None), (2, ""), (3, "\n\n"), (4, f"a\n{p}\n\nb"), (5, f"{p}\r\n\nc"), (6, p), (7, "x y\n" * 3000), (8, "tiny")]
    df = frame(spark, rows).selectExpr("*", "1 as row", "2 as g", "3 as at")
    out = pd.passage_dedup(df)
    assert out.columns == [*df.columns, "n_lines_removed"]
    got = texts(out)
    assert got[1] is None and got[2] == "" and got[3] == "\n\n" and got[4] == rows[3][1] and got[8] == "tiny"
    assert got[5] == "\nc" and got[6] == "" and len(got[7].split("\n")) < 70
    again = pd.passage_dedup(frame(spark, [(1, p), (1, p), (None, p), (None, "q")])).collect()
    assert sorted(r.text for r in again) == ["", "", p, "q"]


def test_texts_are_stored_once_and_never_sorted(spark):
    rows = [(i, sentence(random.Random(i % 3), 60)) for i in range(9)]
    df = frame(spark, rows).selectExpr("*", "1 as more")
    store = pd.Store(spark, "test")
    found = pd.marked(pd.keyed(df, store), store)
    assert [f.name for f in found.schema["doc"].dataType] == [c for c in df.columns if c != "text"]
    out = pd.passage_dedup(df)
    assert out.columns == [*df.columns, "n_lines_removed"]
    assert "SortMergeJoin" not in out._jdf.queryExecution().executedPlan().toString()
    assert {r.doc_id: (r.text, r.more) for r in out.collect()} == {i: (t if i < 3 else "", 1) for i, t in rows}


def test_only_grams_that_occur_twice_go_on_and_texts_without_any_lie_apart(spark):
    rows = [(i, sentence(random.Random(i % 6), 120)) for i in range(9)] + [(9, "short"), (10, None)]
    store = pd.Store(spark, "test")
    keyed = pd.keyed(frame(spark, rows), store)
    several = pd._several(pd._grams(keyed))
    words = {i: t.split() for i, t in rows if t}
    grams = {i: {tuple(w[a : a + pd.GRAM]) for a in range(len(w) - pd.GRAM + 1)} for i, w in words.items()}
    got = several.select("row", pd._at(several["code"]).alias("at")).collect()
    assert {r.row for r in got} == {0, 1, 2, 6, 7, 8}
    assert all(sum(tuple(words[r.row][r.at : r.at + pd.GRAM]) in g for g in grams.values()) == 2 for r in got)
    plan = several._jdf.queryExecution()
    assert plan.toRdd().count() == len(got) and "ReusedExchange" in plan.executedPlan().toString()  # grams are computed and shuffled once
    found = pd.marked(keyed, store)
    assert {r.row: r.some for r in found.collect()} == {i: i in {0, 1, 2, 6, 7, 8} for i in range(11)}
    read = found.where("some")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(some" in read
    empty = frame(spark, rows).where("false")
    assert pd.passage_dedup(empty).collect() == []
