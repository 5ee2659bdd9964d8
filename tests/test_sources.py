import json

import pytest

from cohort.sources import cleaning, writers
from cohort.sources.readers import load_table


def load(spark, path, text, **kwargs):
    path.write_bytes(text if isinstance(text, bytes) else text.encode())
    return load_table(spark, str(path), **kwargs)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_ragged_rows(spark, tmp_path):
    text = 'a,b,c\n1,2\n1,2,3\n1,2,3,4\n1,2,3,4,5\n,,\n7,"8,8",9\n4,5,6,,\n\n'
    df = load(spark, tmp_path / "ragged.csv", text)
    assert rows(df) == [(1.0, "2", 3.0), (1.0, "2", None), (7.0, "8,8", 9.0)]
    assert df.count() == 3 and df.select("b").count() == 3 and df.where("c = 9").count() == 1


def test_types_and_missing_cells(spark, tmp_path):
    text = "n,f,g,t,b,m,e\n1,1,1.5,x,true,NA,\n2,,2.5,NULL,False,n/a,\n3,3,1e3,z,TRUE,q,\n"
    df = load(spark, tmp_path / "types.csv", text)
    assert dict(df.dtypes) == {"n": "bigint", "f": "double", "g": "double", "t": "string", "b": "boolean", "m": "string"}
    gaps = load(spark, tmp_path / "gaps.csv", "n,b\n1,True\n2,\n")
    assert dict(gaps.dtypes)["b"] == "boolean"
    assert [r["m"] for r in df.orderBy("n").collect()] == [None, None, "q"]


def test_latin1_beside_utf8(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "one file.csv").write_bytes("name,x\nJosé,1\n".encode("latin-1"))
    (tmp_path / "in" / "two.csv").write_bytes("name,x\nÉcole,2\n".encode())
    assert rows(load_table(spark, str(tmp_path / "in"), "csv")) == [("José", 1), ("École", 2)]
    assert rows(load(spark, tmp_path / "l1.csv", "né,x\nJosé,1\n".encode("latin-1"))) == [("José", 1)]
    assert load_table(spark, str(tmp_path / "l1.csv")).columns == ["né", "x"]


def test_repeated_headers(spark, tmp_path):
    df = load(spark, tmp_path / "dup.csv", "a, a,b,a\n1,2,3,4\n")
    assert df.columns == ["a", "b", "a.1"] and rows(df) == [(1, 3, 4)]


def test_quoted_line_breaks(spark, tmp_path):
    df = load(spark, tmp_path / "lines.csv", 'a,b\n"x\ny",1\n', multi_line=True)
    assert rows(df) == [("x\ny", 1)]


@pytest.mark.parametrize("name, text", [("empty.csv", "a,b\n"), ("nothing.csv", ""), ("x.txt", "a"), ("bad.json", "3")])
def test_errors(spark, tmp_path, name, text):
    with pytest.raises(ValueError):
        load(spark, tmp_path / name, text)


def test_json_layouts(spark, tmp_path):
    records = [{"name": "a", "z": 1, "c": 1.5}, {"name": "b", "z": 2, "c": None}, {"name": "c", "z": 3, "c": 2.5}]
    columns = {c: {str(i): r[c] for i, r in enumerate(records)} for c in ("name", "z", "c")}
    index = {str(i): r for i, r in enumerate(records)}
    lists = {c: [r[c] for r in records] for c in ("name", "z", "c")}
    expected = [("a", 1, 1.5), ("b", 2, None), ("c", 3, 2.5)]
    for name, doc, orient in [("r", records, None), ("c", columns, None), ("i", index, "index"), ("l", lists, "columns")]:
        df = load(spark, tmp_path / f"{name}.json", json.dumps(doc, indent=1), orient=orient)
        assert df.columns == ["name", "z", "c"] and rows(df) == expected, name
    lines = "\n".join(json.dumps(r) for r in records)
    assert rows(load(spark, tmp_path / "lines.jsonl", lines)) == expected


def test_blank_rows_and_columns(spark):
    df = spark.createDataFrame([(1, None, None), (None, None, None), (2, "x", None)], "a int, b string, c string")
    assert rows(cleaning.drop_blank(df)) == [(1, None), (2, "x")]


def test_profile(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "a int, b string")
    assert rows(cleaning.dataset_profile(df)) == [(0, "a", "int", 2, 2), (1, "b", "string", 1, 2)]


def test_write_and_preview(spark, tmp_path):
    df = spark.createDataFrame([(2, 'say "hi", x'), (1, "plain"), (3, None)], "k long, t string")
    writers.write_table(df, str(tmp_path / "out"))
    assert rows(load_table(spark, str(tmp_path / "out"), "csv")) == rows(df)
    assert [r["k"] for r in writers.preview(df, ["k"], 2).collect()] == [1, 2]
    lines = [r["text"] for r in writers.preview_text(df, ["k"], 1).orderBy("line").collect()]
    assert lines == ["k,t", "1,plain"]
    with pytest.raises(ValueError):
        writers.write_table(df, str(tmp_path / "x"), "xml")
