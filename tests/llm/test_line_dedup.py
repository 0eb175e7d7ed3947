from __future__ import annotations

import random

import pytest

from rowsmith.llm import line_dedup as ld

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA)


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def brute_runs(rows, least=50):
    """Lines (doc, line) inside a run of ``least`` words or more that occurs in an earlier place."""
    docs = [(i, [line.strip(" \t\r\x0b\x0c") for line in (t or "").split("\n")]) for i, t in sorted(rows)]
    flat = {}
    must = set()
    for d, lines in docs:
        solid = [(n, x) for n, x in enumerate(lines) if x]
        for a in range(len(solid)):
            words = 0
            for b in range(a, len(solid)):
                words += len(solid[b][1].split())
                if words >= least:
                    key = tuple(x for _, x in solid[a : b + 1])
                    if key in flat:
                        must |= {(d, n) for n, _ in solid[a : b + 1]}
                    else:
                        flat[key] = d
    return must


def sentence(rnd, n):
    return " ".join(f"w{rnd.randrange(5000)}" for _ in range(n))


@pytest.mark.parametrize("seed", [1, 2])
def test_repeated_passages_go_and_the_rest_stays(spark, seed):
    rnd = random.Random(seed)
    passages = [[sentence(rnd, 60)], [sentence(rnd, 12) for _ in range(6)], [sentence(rnd, 3) for _ in range(30)], [sentence(rnd, 30), sentence(rnd, 25)]]
    short = sentence(rnd, 13)
    rows = []
    for i in range(40):
        lines = [sentence(rnd, rnd.randint(1, 40)) for _ in range(rnd.randint(1, 8))]
        for p in rnd.sample(passages, rnd.randint(0, 2)):
            at = rnd.randint(0, len(lines))
            lines[at:at] = p
        if rnd.random() < 0.5:
            lines.insert(rnd.randint(0, len(lines)), short)
        rows.append((i, "\n".join(lines)))
    got = texts(ld.line_dedup(frame(spark, rows)))
    must = brute_runs(rows)
    seen = set()
    for i, text in sorted(rows):
        kept = got[i].split("\n")
        lines = text.split("\n")
        it = iter(kept)
        nxt = next(it, None)
        gone = []
        for n, line in enumerate(lines):
            if line == nxt:
                nxt = next(it, None)
            else:
                gone.append(n)
        assert nxt in (None, "")  # kept lines are a subsequence
        assert {(i, n) for n in gone} == {x for x in must if x[0] == i}  # every repeated run went, and nothing else
        assert all(lines[n] in seen or lines[n] in lines[:n] for n in gone)  # only copies of earlier lines went
        seen |= set(lines)
    # A short common line stays, but where it stands beside a repeated passage in both places.
    assert 2 * sum(short in t for t in got.values()) > sum(short in t for _, t in rows)


def test_edge_cases(spark):
    p = " ".join(f"p{i}" for i in range(55))
    rows = [(1, None), (2, ""), (3, "\n\n"), (4, f"a\n{p}\n\nb"), (5, f"{p}\r\n\nc"), (6, p), (7, "x y\n" * 3000), (8, "tiny")]
    df = frame(spark, rows).selectExpr("*", "1 as row", "2 as g", "3 as at")
    out = ld.line_dedup(df)
    assert out.columns == [*df.columns, "n_lines_removed"]
    got = texts(out)
    assert got[1] is None and got[2] == "" and got[3] == "\n\n" and got[4] == rows[3][1] and got[8] == "tiny"
    assert got[5] == "\nc" and got[6] == "" and len(got[7].split("\n")) < 70
    assert ld.line_dedup(frame(spark, [])).count() == 0


def test_repeated_and_null_ids(spark):
    p = " ".join(f"p{i}" for i in range(55))
    out = ld.line_dedup(frame(spark, [(1, p), (1, p), (None, p), (None, "q")])).collect()
    assert sorted(r.text for r in out) == ["", "", p, "q"]
