"""CSV records whose quoted cells hold line breaks, found by many tasks per file.

Whether a line begins a record depends on all lines before it in its file, but only through one bit: whether a quoted cell is open.
A line maps that bit to that of the next line; lines compose, so each split of a file is summed up as such a map on its own.
One row for each split tells then, summed up in file order, what is open where it begins. With it every split cuts its lines
into records; what crosses splits (one piece for each at most) is put together by a small aggregate.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cohort.session import written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

FIELD = rb'(?:"[^"]*+(?:""[^"]*+)*+"[^,]*+|[^",][^,]*+)?+'
CLOSED = re.compile(FIELD + rb"(?:," + FIELD + rb")*+")
# a quoted cell that ends on its line
QUOTED_CELL = r'(^|,)"[^"]*+(?:""[^"]*+)*+"(?=,|$)'


def plain_line(line: Column) -> Column:
    """Whether every quote of a line belongs to a cell that is quoted as a whole and ends there. Such lines are records."""
    quote = F.lit('"')
    return ~F.contains(line, quote) | ~F.contains(F.regexp_replace(line, QUOTED_CELL, "$1"), quote)


def leaves_open(line: bytes, inside: bool) -> bool:
    """Whether a quoted cell is open behind a line. A quote opens a cell only as its first character, a doubled one stays text."""
    return not CLOSED.fullmatch(b'"' + line if inside else line)


def _steps(lines: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """For each line the state behind it (1: a cell is open) if the state before it is 0, and if it is 1."""
    zero, one = np.zeros(len(lines), bool), np.ones(len(lines), bool)
    quoted = np.asarray(pc.fill_null(pc.match_substring(lines, '"'), False))
    for i in np.flatnonzero(quoted):
        line = lines[i].as_py()
        zero[i], one[i] = leaves_open(line, False), leaves_open(line, True)
    return zero, one


def _states(zero: np.ndarray, one: np.ndarray, state: bool) -> np.ndarray:
    """The state before each line, and behind the last one."""
    out = np.empty(len(zero) + 1, bool)
    out[0] = state
    # between lines that are not the identity the state stays
    changes = np.flatnonzero(zero | ~one)
    at = 0
    for i in changes.tolist():
        out[at:i + 1] = state
        state = bool((one if state else zero)[i])
        at = i + 1
    out[at:] = state
    return out


def splits(batches) -> Iterator[tuple[str, int, bool, pa.Array]]:
    """(file, block, first, lines): consecutive lines of one split; first when it has just begun."""
    last = None
    for batch in batches:
        file, block = batch.column(0), batch.column(1).to_numpy()
        names = file.dictionary_encode() if not pa.types.is_dictionary(file.type) else file
        kind = names.indices.to_numpy()
        edges = np.flatnonzero((kind[1:] != kind[:-1]) | (block[1:] != block[:-1])) + 1
        for start, stop in zip([0, *edges.tolist()], [*edges.tolist(), len(block)]):
            if stop > start:
                key = names.dictionary[int(kind[start])].as_py(), int(block[start])
                yield *key, key != last, batch.column(2).slice(start, stop - start)
                last = key


def _summaries(batches) -> Iterator[pa.RecordBatch]:
    """For each split its state behind the last line, and whether a record begins in it, from either state before."""
    now, found = None, []
    for file, block, first, lines in splits(batches):
        if first:
            now = [file, block, False, True, False, False]
            found.append(now)
        zero, one = _steps(lines)
        for state in (0, 1):
            path = _states(zero, one, now[2 + state])
            now[4 + state] |= not path[:-1].all()
            now[2 + state] = bool(path[-1])
    if found:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found)], names=["file", "block", "after0", "after1", "starts0", "starts1"])


def _pieces(batches, known: dict) -> Iterator[pa.RecordBatch]:
    """(file, block, seq, split, whole, text): records, and the parts of those that cross splits under the block they begin in."""
    out, held = [], 0   # bytes in out
    key, open_lines, owner, seq, state, begun = None, [], None, -1, False, False

    def close(ends_open):
        nonlocal held   # the other names are read where they are now
        if open_lines:
            held += sum(map(len, open_lines))
            whole = begun and not ends_open
            out.append((key[0], owner, seq if begun else None, key[1], whole, b"\n".join(open_lines)))

    for file, block, first, lines in splits(batches):
        if first:
            close(state)
            if (file, block) not in known:
                raise RuntimeError(f"{file} is split differently than before at {block}; the number of cores or the file has changed")
            key, (state, owner) = (file, block), known[file, block]
            open_lines, seq, begun = [], -1, False
        states = _states(*_steps(lines), state)
        texts = lines.to_pylist()
        starts = np.flatnonzero(~states[:-1]).tolist()
        open_lines += texts[:starts[0] if starts else len(texts)]
        for a, b in zip(starts, [*starts[1:], len(texts)]):
            close(False if begun else True)
            open_lines, owner, seq, begun = texts[a:b], block, seq + 1, True
        state = bool(states[-1])
        if len(out) >= 10_000 or held > 1 << 22:
            yield _batch(out)
            out, held = [], 0
    close(state)
    if out:
        yield _batch(out)


def _batch(rows: list) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["file", "block", "seq", "split", "whole", "text"])


def first_lines(batches) -> Iterator[pa.RecordBatch]:
    """One row for each split: its first line that is not blank, and whether all its lines are valid and plain.

    The lines are structs of (text, shown, valid, plain).
    """
    found: list[list] = []
    for file, block, first, lines in splits(batches):
        if first:
            found.append([file, block, None, True, True])
        now, shown = found[-1], np.asarray(lines.field("shown"))
        if now[2] is None and shown.any():
            now[2] = lines.field("text")[int(shown.argmax())].as_py()
        now[3] &= bool(np.asarray(lines.field("valid")).all())
        now[4] &= bool(np.asarray(lines.field("plain")).all())
    if found:
        kinds = [pa.string(), pa.int64(), pa.string(), pa.bool_(), pa.bool_()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), kinds)], names=["file", "block", "header", "valid", "plain"])


def first_records(batches) -> Iterator[pa.RecordBatch]:
    """Of (file, block, seq, text, valid), one row for each file of a task: its first record, and whether all are valid."""
    found: dict[str, list] = {}
    for batch in batches:
        names = batch.column(0).dictionary_encode()
        kind, block, seq, valid = names.indices.to_numpy(), *(np.asarray(batch.column(i)) for i in (1, 2, 4))
        order = np.lexsort((seq, block, kind))
        for begin, stop in zip(*(np.searchsorted(kind[order], np.arange(len(names.dictionary)), side) for side in ("left", "right"))):
            least, file = int(order[begin]), names.dictionary[int(kind[order[begin]])].as_py()
            now, all_valid = (int(block[least]), int(seq[least])), bool(valid[order[begin:stop]].all())
            known = found.setdefault(file, [now, None, True])
            if known[1] is None or now < known[0]:
                known[:2] = now, batch.column(3)[least].as_py()
            known[2] &= all_valid
    if found:
        rows = [(file, *place, text, valid) for file, (place, text, valid) in found.items()]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["file", "block", "seq", "header", "valid"])


def broken_records(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file, block, seq, text): the records of files with line breaks in quoted cells, as bytes; blank lines are records, too.

    The lines of a file are read twice in splits of Spark's choice, whatever the size of the file, and written once. What comes to the driver
    and goes to the tasks is two numbers for each split. Line breaks within cells become line feeds. A cell that is never closed
    takes the rest of its file.
    """
    lines = spark.read.text(paths).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("line"))
    sums = lines.mapInArrow(_summaries, "file string, block long, after0 boolean, after1 boolean, starts0 boolean, starts1 boolean").collect()
    known, file, state, owner = {}, None, False, None
    for row in sorted(sums, key=lambda r: (r["file"], r["block"])):
        if row["file"] != file:
            file, state, owner = row["file"], False, None
        known[file, row["block"]] = state, owner
        if row["starts1" if state else "starts0"]:
            owner = row["block"]
        state = row["after1" if state else "after0"]
    sent = spark.sparkContext.broadcast(known)
    pieces = written(lines.mapInArrow(
        lambda batches: _pieces(batches, sent.value), "file string, block long, seq long, split long, whole boolean, text binary"), "records")
    parts = pieces.where("not whole").groupBy("file", "block").agg(
        F.max("seq").alias("seq"), F.array_sort(F.collect_list(F.struct("split", F.hex("text").alias("text")))).alias("parts"))
    joined = parts.select("file", "block", "seq", F.unhex(F.array_join(F.transform("parts", lambda p: p["text"]), "0A")).alias("text"))
    return pieces.where("whole").select("file", "block", "seq", "text").unionAll(joined)
