"""Large JSON documents cut into records by many tasks: an array's elements, or the cells of an object of objects or arrays.

A document is read in pieces between commas, so its layout over lines does not matter. Whether a comma separates records depends
on what is open before it: a string or not, and how many brackets. A piece changes the depth by its brackets outside strings and
turns the string bit at every quote that is not escaped, so pieces, and whole splits of a file, compose. Each split is summed up
on its own from both bits; one row for each split tells then, in file order, what is open where it begins.
With that every split cuts its pieces at the wanted depths, and records that cross splits are put together by a small aggregate.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from cohort.session import written
from cohort.sources.csv_records import splits

cloudpickle.register_pickle_by_value(sys.modules[__name__])

OPEN, CLOSE, QUOTE, ESCAPE = (tuple(b"[{"), tuple(b"]}"), ord('"'), ord("\\"))


def scan(pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Before each piece and behind the last one: quotes so far, depth change if no string was open at first, and if one was."""
    joined = pieces.cast(pa.large_binary())
    offsets = np.frombuffer(joined.buffers()[1], np.int64)[joined.offset:joined.offset + len(joined) + 1]
    data = np.frombuffer(joined.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]] if len(joined) else np.zeros(0, np.uint8)
    edges = offsets - offsets[0]
    quotes = data == QUOTE
    slashes = data == ESCAPE
    if slashes.any():
        at = np.flatnonzero(quotes)
        # the unbroken backslashes before a quote, within its piece
        last = np.maximum.accumulate(np.where(slashes, -1, np.arange(len(data))))
        begins = edges[np.searchsorted(edges, at, "right") - 1]
        before = np.where(at > 0, last[np.maximum(at - 1, 0)], -1)
        run = at - 1 - np.maximum(before, begins - 1)
        quotes[at[run % 2 == 1]] = False
    so_far = np.concatenate([[0], np.cumsum(quotes)])
    turn = np.isin(data, OPEN).astype(np.int64) - np.isin(data, CLOSE)
    inside = so_far[:-1] % 2 == 1
    depths = [np.concatenate([[0], np.cumsum(np.where(part, turn, 0))])[edges] for part in (~inside, inside)]
    return so_far[edges], *depths


def _summaries(batches) -> Iterator[pa.RecordBatch]:
    """For each split the parity of its quotes, and for either bit the depth change and the depths at which pieces begin outside strings."""
    found: list[list] = []
    for file, block, first, pieces in splits(batches):
        if first:
            found.append([file, block, 0, 0, 0, set(), set()])
        now = found[-1]
        quotes, *depths = scan(pieces)
        for bit in (0, 1):
            # where the split began with this bit, this batch begins with the bit turned by the quotes so far
            here = depths[bit ^ now[2]] + now[3 + bit]
            outside = (quotes + now[2] + bit) % 2 == 0
            now[5 + bit].update(np.unique(here[:-1][outside[:-1]]).tolist())
            now[3 + bit] = int(here[-1])
        now[2] = int(now[2] + quotes[-1]) % 2
    if found:
        columns = list(zip(*[[*r[:5], sorted(r[5]), sorted(r[6])] for r in found]))
        kinds = [pa.string(), *[pa.int64()] * 4, *[pa.list_(pa.int64())] * 2]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["file", "block", "odd", "by0", "by1", "at0", "at1"])


KINDS = [("file", pa.string()), ("block", pa.int64()), ("seq", pa.int64()), ("split", pa.int64()), ("whole", pa.bool_()), ("run", pa.int64()),
         ("place", pa.int64()), ("starts", pa.int64()), ("ends", pa.int64()), ("text", pa.binary())]


def _cut(batches, known: dict, depths: tuple[int, ...]) -> Iterator[pa.RecordBatch]:
    """Records, and the parts of those that cross splits under the block they begin in.

    run counts the records that begin at depth 1 or less in a split, place those that follow one.
    """
    out, held = [], 0
    key, parts, owner, seq, run, place, starts, begun = None, [], None, -1, 0, -1, None, False
    bit = depth = 0

    def close(ends: int, whole: bool):
        nonlocal held
        if parts:
            held += sum(map(len, parts))
            mine = (seq, run, place, starts) if begun else (None,) * 4
            out.append((key[0], owner, mine[0], key[1], whole and begun, *mine[1:], ends, b",".join(parts)))

    def end():
        close(depth, not bit and (depth in depths or depth == 0))

    for file, block, first, pieces in splits(batches):
        if first:
            end()
            if (file, block) not in known:
                raise RuntimeError(f"{file} is split differently than before at {block}; the number of cores or the file has changed")
            key, (bit, depth, owner) = (file, block), known[file, block]
            parts, seq, run, place, begun = [], -1, 0, -1, False
        quotes, *by_bit = scan(pieces)
        here = by_bit[bit] + depth
        outside = (quotes + bit) % 2 == 0
        cuts = outside[:-1] & np.isin(here[:-1], depths)
        if first and block == 0:
            cuts[0] = True
        at = np.flatnonzero(cuts).tolist()
        texts = pieces.to_pylist()
        parts += texts[:at[0] if at else len(texts)]
        for a, b in zip(at, [*at[1:], len(texts)]):
            close(int(here[a]), True)
            parts, owner, seq, starts, begun = texts[a:b], block, seq + 1, int(here[a]), True
            if starts <= 1:
                run, place = run + 1, 0
            else:
                place += 1
        bit, depth = int(quotes[-1] + bit) % 2, int(here[-1])
        if len(out) >= 10_000 or held > 1 << 22:
            yield _batch(out)
            out, held = [], 0
    end()
    if out:
        yield _batch(out)


def _batch(rows: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), KINDS)], names=[n for n, _ in KINDS])


def _check_closed(file: str | None, bit: int, depth: int) -> None:
    if bit or depth:
        raise ValueError(f"{file} is no JSON document: its strings or brackets are not closed")


def _records(spark: SparkSession, path: str, depths: tuple[int, ...]) -> DataFrame:
    """(file, block, seq, run, place, starts, ends, text): what begins at the given depths, with the depths before and behind it."""
    pieces = spark.read.option("lineSep", ",").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("piece"))
    sums = pieces.mapInArrow(_summaries, "file string, block long, odd long, by0 long, by1 long, at0 array<long>, at1 array<long>").collect()
    known, file, bit, depth, owner = {}, None, 0, 0, None
    for row in sorted(sums, key=lambda r: (r["file"], r["block"])):
        if row["file"] != file:
            _check_closed(file, bit, depth)
            file, bit, depth, owner = row["file"], 0, 0, None
        known[file, row["block"]] = bit, depth, owner
        if row["block"] == 0 or any(depth + d in depths for d in row[f"at{bit}"]):
            owner = row["block"]
        bit, depth = bit ^ row["odd"], depth + row[f"by{bit}"]
    _check_closed(file, bit, depth)
    sent = spark.sparkContext.broadcast(known)
    schema = "file string, block long, seq long, split long, whole boolean, run long, place long, starts long, ends long, text binary"
    cut = written(pieces.mapInArrow(lambda batches: _cut(batches, sent.value, depths), schema), "pieces")
    parts = cut.where("not whole").groupBy("file", "block").agg(
        F.max("seq").alias("seq"), F.max("run").alias("run"), F.max("place").alias("place"), F.max("starts").alias("starts"),
        F.max_by("ends", "split").alias("ends"), F.array_sort(F.collect_list(F.struct("split", F.hex("text").alias("text")))).alias("parts"))
    fields = ["file", "block", "seq", "run", "place", "starts", "ends"]
    joined = parts.select(*fields, F.unhex(F.array_join(F.transform("parts", lambda p: p["text"]), "2C")).alias("text"))
    return cut.where("whole").select(*fields, "text").unionAll(joined).withColumn("text", F.col("text").cast("string"))


def array_elements(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, seq, value): the elements of documents that are arrays, each on one line.

    A file is read twice in splits of Spark's choice, whatever its size, and written once; two numbers for each split come to the driver. What is
    no JSON comes out as it is, so the parser of the elements meets it.
    """
    found = _records(spark, path, (1,))
    bare = F.trim(F.translate(F.col("text"), "\r\n\ufeff", "  "))
    bare = F.when(F.col("starts") == 0, F.regexp_replace(bare, r"^\[", "")).otherwise(bare)
    bare = F.when(F.col("ends") == 0, F.regexp_replace(bare, r"\]$", "")).otherwise(bare)
    return found.select("file", "block", "seq", F.trim(bare).alias("value")).where("value <> ''")


def _key(text: Column) -> Column:
    return F.from_json(F.concat(F.lit("["), text, F.lit("]")), "array<string>", {"mode": "FAILFAST"})[0]


def nested_cells(spark: SparkSession, path: str) -> DataFrame:
    """(file, outer, outer_place, inner, place, value): the cells of documents of the form {outer: {inner: value}} or {outer: [value]}.

    inner is null in arrays; place counts the cells under an outer key, outer_place orders the outer keys of a file. Values are texts, nested
    ones as JSON. No document, and no outer key's object, is ever in one task: cells meet their outer key by a join.
    """
    found = written(_records(spark, path, (1, 2)), "cells")
    head = r'(?s)^[\s\x{FEFF}]*+\{?\s*+("[^"\\]*+(?:\\.[^"\\]*+)*+")\s*+:\s*+([\[{])(.*)$'
    opens = F.col("starts") <= 1
    outers = found.where(opens & F.col("text").rlike(head)).select(
        "file", F.col("block").alias("outer_block"), F.col("run").alias("outer_run"), _key(F.regexp_extract("text", head, 1)).alias("outer"),
        (F.regexp_extract("text", head, 2) == "[").alias("is_list"))
    # per split: the last outer key, and the cells behind it (or all, where none begins)
    splits_ = found.groupBy("file", "block").agg(F.max("run").alias("runs"), F.max_by("place", "seq").alias("last"))
    order = Window.partitionBy("file").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    carried = splits_.select(
        "file", "block", F.last(F.when(F.col("runs") > 0, F.struct("block", "runs")), True).over(before).alias("outer"),
        F.sum(F.when(F.col("runs") > 0, 1).otherwise(0)).over(before).alias("group"), "runs", (F.col("last") + 1).alias("cells"))
    # a split without an outer key adds its cells to those behind the last one
    group = F.sum(F.when(F.col("runs") > 0, 1).otherwise(0)).over(order)
    counted = carried.withColumn("own_group", group)
    tail = F.sum("cells").over(Window.partitionBy("file", "own_group").orderBy("block"))
    ends = counted.withColumn("behind", tail)
    carried = ends.select("file", "block", F.col("outer.block").alias("from_block"), F.col("outer.runs").alias("from_run"),
                          F.lag("behind").over(order).alias("ahead"))
    carried = written(carried, "carried")
    cells = found.join(carried, ["file", "block"]).select(
        "file", F.when(F.col("run") > 0, F.col("block")).otherwise(F.col("from_block")).alias("outer_block"),
        F.when(F.col("run") > 0, F.col("run")).otherwise(F.col("from_run")).alias("outer_run"),
        F.when(F.col("run") > 0, F.col("place")).otherwise(F.col("place") + F.col("ahead")).alias("place"),
        F.when(opens, F.regexp_extract("text", head, 3)).otherwise(F.col("text")).alias("text"), "ends")
    closed = r"\s*+[\]}]\s*+$"
    bare = F.when(F.col("ends") < 2, F.regexp_replace("text", closed, "")).otherwise(F.col("text"))
    bare = F.when(F.col("ends") < 1, F.regexp_replace(bare, closed, "")).otherwise(bare)
    joined = cells.withColumn("text", bare).where(F.trim("text") != "").join(outers, ["file", "outer_block", "outer_run"])
    strict = {"mode": "FAILFAST"}
    value = F.when(F.col("is_list"), F.from_json(F.concat(F.lit("["), "text", F.lit("]")), "array<string>", strict)[0])
    entry = F.map_entries(F.from_json(F.when(~F.col("is_list"), F.concat(F.lit("{"), "text", F.lit("}"))), "map<string,string>", strict))[0]
    return joined.withColumn("entry", entry).select(
        "file", "outer", F.struct("outer_block", "outer_run").alias("outer_place"), F.col("entry.key").alias("inner"), "place",
        F.coalesce(value, F.col("entry.value")).alias("value"))
