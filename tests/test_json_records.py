"""Large JSON documents: every split, against Python's reader."""

import json
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from cohort.sources import json_records as J
from cohort.sources.readers import load_table


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


AWKWARD = ['a,b', 'q"u,o"te', "back\\slash\\", '[{,}]', "é日,", "", "x" * 40, '\\",', "line\nbreak,"]


def records(n, seed):
    r = random.Random(seed)
    return [{"key": i, "name": r.choice(AWKWARD) + str(i), "more": {"deep": [1, {"x": r.choice(AWKWARD)}]}, "mark": r.choice([None, 1.5, -2.0])} for i in range(n)]


class Sizes:
    """Splits of a few bytes, so that a small file has many."""

    def __init__(self, spark, size):
        self.spark, self.size = spark, size

    def __enter__(self):
        names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
        self.before = {k: self.spark.conf.get(k) for k in names}
        for k, v in zip(names, (self.size, 1)):
            self.spark.conf.set(k, v)

    def __exit__(self, *_):
        for k, v in self.before.items():
            self.spark.conf.set(k, v)


@pytest.mark.parametrize("size, n, indent", [(15, 3, None), (200, 30, 1), (1 << 20, 300, None)])
def test_arrays_in_splits_of_any_size(spark, tmp_path, size, n, indent):
    (tmp_path / "a.json").write_text(json.dumps(records(n, 3), indent=indent, ensure_ascii=False), encoding="utf-8")
    with Sizes(spark, size):
        found = J.array_elements(spark, str(tmp_path / "a.json"))
        assert found.count() == n and (size > 1000 or spark.read.option("lineSep", ",").text(str(tmp_path / "a.json")).rdd.getNumPartitions() > 10)
        got = [json.loads(r["value"]) for r in found.orderBy("file", "block", "seq").collect()]
    assert got == records(n, 3)


def flat(n, seed):
    return [{k: v for k, v in r.items() if k != "more"} for r in records(n, seed)]


@pytest.mark.parametrize("form, size, n", [("columns", 15, 2), ("columns", 200, 30), ("lists", 150, 30), ("index", 150, 30), ("index", 1 << 20, 200)])
def test_nested_documents_in_splits_of_any_size(spark, tmp_path, form, size, n):
    table = flat(n, 4)
    names = ("key", "name", "mark")
    doc = {"columns": {c: {str(i): r[c] for i, r in enumerate(table)} for c in names}, "lists": {c: [r[c] for r in table] for c in names},
           "index": {f"row,{i}": r for i, r in enumerate(table)}}[form]
    (tmp_path / "d.json").write_text(json.dumps(doc, indent=1 if n == 30 else None))
    with Sizes(spark, size):
        got = load_table(spark, str(tmp_path / "d.json"), orient="index" if form == "index" else None)
        assert sorted(got.columns) == sorted(c for c in names if any(r[c] is not None for r in table))
        got = rows(got.select("key", "name"))
    assert got == sorted(((r["key"], r["name"]) for r in table), key=repr)


def test_several_files_and_empty_parts(spark, tmp_path):
    (tmp_path / "a.json").write_text('[]')
    (tmp_path / "b.json").write_text('﻿ [ {"x": 1, "y": "a"}\n,{"y": "b", "x": 2} ] \n')
    (tmp_path / "c.json").write_text('[{"x": 3}]')
    got = load_table(spark, str(tmp_path / "*.json"), "json")
    assert got.columns == ["x", "y"] and rows(got) == [(1, "a"), (2, "b"), (3, None)]
    (tmp_path / "n").mkdir()
    (tmp_path / "n" / "a.json").write_text('{"x": {}, "y": {"0": 5, "1": 6}, "z": []}')
    assert rows(load_table(spark, str(tmp_path / "n"), "json")) == [(5,), (6,)]


@pytest.mark.parametrize("text", ['[{"a": 1}', '[{"a": "x]', '{"a": {"0": 1}', "[{]", "3", "", "{}"])
def test_what_is_no_table(spark, tmp_path, text):
    (tmp_path / "bad.json").write_text(text)
    with pytest.raises(Exception):
        load_table(spark, str(tmp_path / "bad.json")).collect()


def slow_scan(pieces, bit):
    """Depth change and string bit before each piece and behind the last, character by character."""
    out, depth, inside, quotes = [(0, 0)], 0, bool(bit), 0
    for piece in pieces:
        k = 0
        while k < len(piece):
            if piece[k] == "\\" and piece[k + 1:k + 2] in ('"', "\\"):
                k += 2
                continue
            if piece[k] == '"':
                inside, quotes = not inside, quotes + 1
            elif not inside:
                depth += (piece[k] in "[{") - (piece[k] in "]}")
            k += 1
        out.append((depth, quotes))
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text('a"\\[]{}', max_size=8), min_size=1, max_size=8))
def test_scan(pieces):
    array = pa.array([b"junk\\", *[p.encode() for p in pieces]], pa.binary()).slice(1)
    quotes, *depths = J.scan(array)
    for bit in (0, 1):
        assert list(zip(depths[bit].tolist(), quotes.tolist())) == slow_scan(pieces, bit)
    assert isinstance(quotes, np.ndarray)


def test_parts_in_which_rows_meet_grow_with_the_splits(spark, tmp_path):
    from cohort.sources.readers import PARTS_OF_A_SPLIT, _read_nested_json

    doc = {f"row,{i}": r for i, r in enumerate(flat(30, 4))}
    path = str(tmp_path / "d.json")
    (tmp_path / "d.json").write_text(json.dumps(doc))
    with Sizes(spark, 300):
        splits = spark.read.option("lineSep", ",").text(path).rdd.getNumPartitions()
        got = _read_nested_json(spark, path, "index")
        assert splits > 3 and got.rdd.getNumPartitions() >= PARTS_OF_A_SPLIT * splits
        assert sorted(r["name"] for r in got.collect()) == sorted(r["name"] for r in flat(30, 4))
