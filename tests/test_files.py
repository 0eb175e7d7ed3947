from __future__ import annotations

import pytest

from rowsmith import Context


@pytest.fixture
def c(spark):
    return Context(spark=spark)


def put(path, text):
    path.write_text(text, encoding="utf-8", newline="")
    return str(path)


def test_csv_types_header_nulls_and_quotes(c, tmp_path):
    p = put(tmp_path / "a.csv", 'id,name,score,flag,none\n1,"x, ""y""",1.5,true,\n2,,2,false,\n3,z,,true,\n')
    ds = c.csv(p)
    assert ds.columns == ["id", "name", "score", "flag", "none"]
    assert ds.collect() == [(1, 'x, "y"', 1.5, True, None), (2, None, 2.0, False, None), (3, "z", None, True, None)]
    assert c.csv(p, null_values=["", "z"]).selectColumns("name").collect() == ['x, "y"', None, None]
    assert c.csv(p, type_hints={"id": str}).types[0] is str


def test_csv_separators_headerless_and_hints(c, tmp_path):
    p = put(tmp_path / "b.tbl", "1|a|2.5\n2|b|3.5\n")
    assert c.csv(p, columns=["x", "y", "z"]).collect() == [(1, "a", 2.5), (2, "b", 3.5)]
    assert c.csv(p).columns is None and c.csv(p, delimiter="|").take(1) == [(1, "a", 2.5)]
    q = put(tmp_path / "c.csv", "A:N/a:1\nB:x:2\n")
    assert c.csv(q, delimiter=":", columns=["k", "v", "n"], null_values=["N/a"]).collect() == [("A", None, 1), ("B", "x", 2)]


def test_csv_line_feeds_in_quotes_crlf_and_utf8(c, tmp_path):
    assert c.csv(put(tmp_path / "d.csv", 'a,b\n1,"x\ny"\n2,z\n')).collect() == [(1, "x\ny"), (2, "z")]
    assert c.csv(put(tmp_path / "e.csv", "a,b\r\n1,ʤ\r\n2,é\r\n")).collect() == [(1, "ʤ"), (2, "é")]


def test_bad_cells_and_arity_are_errors_as_data(c, tmp_path):
    p = put(tmp_path / "f.csv", "a,b\n" + "".join(f"{i},{i}\n" for i in range(30)) + "x,1\n5\n6,7,8\n")
    ds = c.csv(p)
    assert len(ds.collect()) == 30 and ds.exception_counts == {"ValueError": 3}


def test_many_files_keep_order(c, tmp_path):
    for name, n in (("b", 500), ("a", 3), ("c", 50)):
        put(tmp_path / f"{name}.csv", "v\n" + "".join(f"{i}\n" for i in range(n)))
    got = c.csv(",".join(str(tmp_path / f"{n}.csv") for n in "bac")).collect()
    assert got == [*range(500), *range(3), *range(50)]


def test_text(c, tmp_path):
    p = put(tmp_path / "t.txt", "one\n\ntwo\n")
    assert c.text(p).collect() == ["one", "", "two"] and c.text(p, null_values=[""]).collect() == ["one", None, "two"]
    assert c.text(str(tmp_path / "none*")).collect()[0].startswith("no file")


def test_sinks(c, tmp_path):
    ds = c.parallelize([(1, "a,b", True, 1.5), (2, None, False, 2.5)], columns=["i", "s", "b", "f"])
    ds.tocsv(str(tmp_path / "out"), num_parts=1)
    assert (tmp_path / "out" / "part0.csv").read_text().splitlines() == ["i,s,b,f", '1,"a,b",True,1.5', "2,,False,2.5"]
    ds.tocsv(str(tmp_path / "x.csv"), num_parts=1, header=["p", "q", "r", "t"], null_value="NULL", num_rows=2)
    assert (tmp_path / "x.part0.csv").read_text().splitlines()[0] == "p,q,r,t"
    assert c.csv(str(tmp_path / "out" / "*.csv")).collect() == ds.collect()
    with pytest.raises(ValueError):
        ds.tocsv(str(tmp_path / "y"), header=["one"])
    ds.toorc(str(tmp_path / "orc"))
    back = c.orc(str(tmp_path / "orc" / "*.orc"))
    assert back.columns == ["i", "s", "b", "f"] and sorted(back.collect()) == ds.collect()


def test_helpers_and_options(c, spark, tmp_path):
    p = put(tmp_path / "a.txt", "x")
    c.cp(p, str(tmp_path / "b.txt"))
    assert len(c.ls(str(tmp_path / "*.txt"))) == 2
    c.rm(str(tmp_path / "b.txt"))
    assert len(c.ls(str(tmp_path / "*.txt"))) == 1
    c.optionsToYAML(str(tmp_path / "o.yaml"))
    again = Context(str(tmp_path / "o.yaml"), spark=spark)
    assert again.options() == c.options() and again.options(nested=True)["csv"]["comments"] == ["#", "~"]
    assert Context({"csv": {"maxDetectionMemory": "64KB"}}, spark=spark).number("csv.maxDetectionMemory") == 65536


def test_late_quoted_line_feeds(c, tmp_path):
    rows = [(i, f"text {i}") for i in range(30000)]
    body = "".join(f"{i},{t}\n" for i, t in rows)
    p = put(tmp_path / "g.csv", f'a,b\n{body}30000,"x\n""y""\n\nz"\n30001,w\n')
    got = c.csv(p)
    assert got.collect() == [*rows, (30000, 'x\n"y"\n\nz'), (30001, "w")] and not got.exception_counts
    put(tmp_path / "h1.csv", "a,b\n1,u\n2,v\n")
    put(tmp_path / "h2.csv", 'a,b\n3,"x\ny"\n')
    assert c.csv(f"{tmp_path}/h*.csv").collect() == [(1, "u"), (2, "v"), (3, "x\ny")]


def test_first_file_of_a_header_only(spark, tmp_path):
    (tmp_path / "a.csv").write_text("k,v\n")
    (tmp_path / "b.csv").write_text("k,v\nz,1\nw,2\n")
    got = Context(spark=spark).csv(str(tmp_path / "*.csv"))
    assert got.columns == ["k", "v"] and got.collect() == [("z", 1), ("w", 2)]


def test_types_come_from_all_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("k,v\nx,1\n")
    (tmp_path / "b.csv").write_text("k,v\nz,hello\nw,3.5\n")
    assert Context(spark=spark).csv(str(tmp_path / "*.csv")).collect() == [("x", "1"), ("z", "hello"), ("w", "3.5")]


def test_a_second_write_replaces_all_parts(spark, tmp_path):
    ctx, out = Context(spark=spark), str(tmp_path / "out")
    ctx.parallelize(list(range(100)), columns=["n"]).tocsv(out, num_parts=4)
    ctx.parallelize([7], columns=["n"]).tocsv(out, num_parts=1)
    assert ctx.csv(f"{out}/*.csv").collect() == [7]


def test_sums_beyond_64_bits_are_set_aside(spark):
    ds = Context(spark=spark).parallelize([(1, 2**62)] * 4 + [(2, 5)], columns=["k", "v"])
    total = ds.aggregateByKey(lambda a, b: a + b, lambda a, x: a + x["v"], 0, ["k"])
    assert total.collect() == [(2, 5)] and total.exception_counts == {"OverflowError": 1}
    assert ds.filter(lambda x: x["k"] > 5).aggregate(lambda a, b: a + b, lambda a, x: a + x["v"], 0).collect() == [0]
