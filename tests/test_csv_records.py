"""CSV records with line breaks in quoted cells: every split of a file, against Python's reader."""

import csv
import io
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from cohort.sources import csv_records
from cohort.sources.readers import load_table, read_csv


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def write(path, text, encoding="utf-8"):
    path.write_bytes(text.encode(encoding))
    return str(path)


def made(n, seed, breaks=True):
    """Rows of three cells with quotes, separators and line breaks."""
    r = random.Random(seed)
    cell = lambda: "".join(r.choice(["a", "b", "é", " ", ",", '"', "\n" if breaks else "c", "\n\n" if breaks else "d", "x" * r.randint(1, 9)]) for _ in range(r.randint(1, 6)))
    return [(f"k{i}", cell(), f"z{cell()}") for i in range(n)]


def as_csv(table, header=("key", "first", "second")):
    out = io.StringIO()
    csv.writer(out, lineterminator="\n").writerows([header, *table])
    return out.getvalue()


def blank(cell):
    return cell if cell.strip() else None


def test_breaks_are_kept_by_default(spark, tmp_path):
    path = write(tmp_path / "probe.csv", 'name,note,mark\nann,"two\nlines",5\nbob,plain,6\ncid,"x, ""y""",7\n')
    assert rows(load_table(spark, path)) == [("ann", "two\nlines", 5), ("bob", "plain", 6), ("cid", 'x, "y"', 7)]
    assert load_table(spark, path, multi_line=True).count() == 3


@pytest.mark.parametrize("size, n", [(7, 4), (60, 30), (1 << 20, 120)])
def test_splits_of_any_size(spark, tmp_path, size, n):
    table = made(n, 5)
    path = write(tmp_path / "many.csv", as_csv(table))
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", 1)
        got = read_csv(spark, path)
        assert spark.read.text(path).rdd.getNumPartitions() > 10 or size > 1000
        assert rows(got) == sorted(((a, b, c) for a, b, c in table), key=repr)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_files_of_several_kinds(spark, tmp_path):
    (tmp_path / "in").mkdir()
    write(tmp_path / "in" / "a plain.csv", "k,v\n1,one\n2,two\n")
    write(tmp_path / "in" / "b.csv", 'k,v\n3,"th\nree"\n')
    write(tmp_path / "in" / "c.csv", '"long\nname",k\n"é\n",4\n', "latin-1")
    write(tmp_path / "in" / "d.csv", '\n  \nk,v\n5,"""\n"""\n\n6,six\n')
    write(tmp_path / "in" / "e.csv", "\n\n")
    got = read_csv(spark, str(tmp_path / "in"))
    assert got.columns == ["k", "v", "long\nname"]
    assert rows(got) == sorted([("1", "one", None), ("2", "two", None), ("3", "th\nree", None), ("4", None, "é\n"), ("5", '"\n"', None), ("6", "six", None)], key=repr)


def test_ragged_and_stray_quotes(spark, tmp_path):
    text = 'a,b,c\n5" disk,x,1\n"p\nq",2\n"p\nq",2,3,4\nx"y,"z""\n",3\n"ab"c"d,e,4\n'
    got = rows(read_csv(spark, write(tmp_path / "stray.csv", text)))
    assert got == sorted([('5" disk', "x", "1"), ("p\nq", "2", None), ('x"y', 'z"\n', "3"), ('"ab"c"d', "e", "4")], key=repr)


def test_an_open_cell_takes_the_rest(spark, tmp_path):
    got = read_csv(spark, write(tmp_path / "open.csv", 'a,b\n1,2\n3,"never\nclosed\n'))
    assert ("1", "2") in rows(got) and got.count() == 2


def slow_open(line, inside):
    """Character by character."""
    state = "quoted" if inside else "start"
    k = 0
    while k < len(line):
        c = line[k]
        if state == "quoted":
            if c == '"':
                if line[k + 1:k + 2] == '"':
                    k += 1
                else:
                    state = "text"
        elif c == ",":
            state = "start"
        elif state == "start" and c == '"':
            state = "quoted"
        else:
            state = "text"
        k += 1
    return state == "quoted"


@settings(max_examples=500, deadline=None)
@given(st.text('a,"', max_size=12), st.booleans())
def test_states_of_lines(line, inside):
    assert csv_records.leaves_open(line.encode(), inside) == slow_open(line, inside)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text('a,"', max_size=6), max_size=12), st.booleans())
def test_composed_states(lines, state):
    got = csv_records._states(*csv_records._steps(pa.array([x.encode() for x in lines], pa.binary())), state)
    want = [state]
    for line in lines:
        want.append(slow_open(line, want[-1]))
    assert got.tolist() == want


def test_plain_lines(spark):
    texts = ["a,b", '"a","b, c"', '"a"",b"', '"a', 'b"', 'a"b', '"x""y","z"', '"a,"b', ',"",""', '"a"b', "", '"' * 7, '"x, ""y""",1']
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    from pyspark.sql import functions as F

    got = {r["t"]: r["p"] for r in df.select("t", csv_records.plain_line(F.col("t")).alias("p")).collect()}
    assert all(not slow_open(t, False) for t, p in got.items() if p)
    assert got["a,b"] and got['"a","b, c"'] and got['"x, ""y""",1'] and not got['"a'] and not got['a"b']


def test_a_long_cell_does_not_overflow(spark, tmp_path):
    long = '""'.join("x" * 50 for _ in range(20_000))
    got = read_csv(spark, write(tmp_path / "long.csv", f'a,b\n"{long}",1\n"s\n{long}",2\n')).collect()
    assert sorted(len(r["a"]) for r in got) == [len(long) - 19_999, len(long) - 19_999 + 2]


def test_other_splits_are_noticed():
    batch = pa.RecordBatch.from_arrays([pa.array(["f"]), pa.array([9]), pa.array([b"x"])], names=["file", "block", "line"])
    with pytest.raises(RuntimeError):
        list(csv_records._pieces([batch], {("f", 0): (False, None)}))


def test_numbers_of_a_text_that_has_none():
    assert csv_records._states(np.zeros(0, bool), np.ones(0, bool), True).tolist() == [True]


def test_headers_are_found_without_sorting_lines(spark, tmp_path, capsys):
    """Over texts an aggregate would sort every line of a split; it only meets a row for each split."""
    from cohort.sources.readers import _files

    (tmp_path / "a.csv").write_text(" \n\nk,v\n1,x\n")
    (tmp_path / "b.csv").write_bytes('k,w\n2,"é\nopen"\n'.encode("latin-1"))
    (tmp_path / "c.csv").write_text("\n \n")
    files = _files(spark, str(tmp_path), "auto")
    got = sorted((r["file"][-5:], r["header"], r["charset"], r["plain"]) for r in files.collect())
    assert got == [("a.csv", "k,v", "UTF-8", True), ("b.csv", "k,w", "ISO-8859-1", False)]
    files.explain()
    below = capsys.readouterr().out.rsplit("MapInArrow", 1)[1]
    assert "Sort" not in below and "Exchange" not in below


def test_the_first_record_of_each_file_is_the_least_place():
    rows = [("f", 5, 0, "later", True), ("g", 0, 2, "g2", True), ("f", 0, 7, "f7", False), ("f", 0, 3, "f3", True), ("g", 0, 1, "g1", True)]
    names = ["file", "block", "seq", "text", "valid"]
    batches = [pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in part]) for part in (rows[:2], rows[2:], []) if part]
    got = [tuple(r.values()) for b in csv_records.first_records(batches) for r in b.to_pylist()]
    assert sorted(got) == [("f", 0, 3, "f3", False), ("g", 0, 1, "g1", True)]
