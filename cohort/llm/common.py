"""Helpers shared by the document operators: text batches, word memos, components of a graph."""

from __future__ import annotations

import gc
import sys
import types
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from cohort.session import written

PIECE_BYTES = 2 << 20   # text that a Python worker holds as objects at once, unless one text is longer
PIECE_ROWS = 2_000
MEMO_WORDS = 300_000    # words whose encoding a worker remembers; later words are encoded each time they come
MEMO_CHARS = 64


def once(key: str, make: Callable):
    """A value made once in each Python worker process and kept for its later tasks.

    The first word of the key names a family; a worker keeps the values of one family, so those of an earlier stage go.
    """
    store = sys.modules.setdefault("_cohort_llm_store", types.ModuleType("_cohort_llm_store")).__dict__
    family = key.split(" ", 1)[0]
    if store.get("family") != family:
        store.clear()
        gc.collect()   # memos and their encoders refer to each other
        store["family"] = family
    if key not in store:
        store[key] = make()
    return store[key]


def named(name: str) -> Column:
    """A column by its exact name."""
    return F.col("`" + name.replace("`", "``") + "`")


def texts_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The two needed columns as (id, text), whatever else the table holds."""
    return docs.select(named(id_col).alias("id"), named(text_col).cast("string").alias("text"))


def pieces(batch: pa.RecordBatch, column: str, most: int = PIECE_BYTES, rows: int = PIECE_ROWS) -> Iterator[pa.RecordBatch]:
    """The batch in slices of a bounded number of rows and, beyond single long texts, of bytes."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start = held = 0
    for i, n in enumerate(sizes):
        if i > start and (held + n > most or i - start >= rows):
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if len(sizes) > start:
        yield batch.slice(start)


def utf8(column: pa.Array) -> list[bytes]:
    """Texts as UTF-8; null as empty."""
    wide = pa.types.is_large_string(column.type)
    return pc.fill_null(column.cast(pa.large_binary() if wide else pa.binary()), b"").to_pylist()


def map_texts(docs: DataFrame, id_col: str, text_col: str, measure: Callable, fields: str) -> DataFrame:
    """(id column, fields): measure(list of UTF-8 texts) gives one list per field, in the order of fields."""
    schema = StructType([StructField(id_col, docs.schema[id_col].dataType), *_parse_datatype_string(fields).fields])

    def run(batches):
        for batch in batches:
            for part in pieces(batch, "text"):
                columns = measure(utf8(part.column("text")))
                yield pa.RecordBatch.from_arrays([part.column("id"), *[pa.array(c) if not isinstance(c, pa.Array) else c
                                                                       for c in columns]], names=schema.names)

    return texts_of(docs, id_col, text_col).mapInArrow(run, schema)


def keep_texts(docs: DataFrame, text_col: str, wanted: Callable) -> DataFrame:
    """The rows, with all their columns, whose text passes; wanted(list of UTF-8 texts) gives a list of booleans."""
    if docs.schema[text_col].dataType.simpleString() != "string":
        raise ValueError(f"{text_col} must be a string column")
    at = docs.columns.index(text_col)
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])

    def run(batches):
        for batch in batches:
            for part in pieces(batch, f"c{at}"):
                yield part.filter(pa.array(wanted(utf8(part.column(at))), pa.bool_()))

    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)


class Memo(dict):
    """word -> code; a bounded number of short words is remembered."""

    def __init__(self, encode: Callable, most: int = MEMO_WORDS):
        self.encode, self.most = encode, most   # list of words -> list of codes

    def codes(self, texts: list[list]) -> Callable:
        """A lookup that knows every word of these texts; unknown ones are encoded together, once."""
        new = list(set().union(*texts).difference(self))
        if not new:
            return self.__getitem__
        fresh = dict(zip(new, self.encode(new)))
        if len(self) < self.most:
            self.update((w, c) for w, c in fresh.items() if len(w) <= MEMO_CHARS)
            fresh = {w: c for w, c in fresh.items() if w not in self}
            if not fresh:
                return self.__getitem__
        get = self.get
        return lambda w: fresh[w] if w in fresh else get(w)

    def each(self, words: list) -> list:
        """The codes of distinct words, in their order; unknown ones are encoded together, once."""
        out = list(map(self.get, words))
        places = [i for i, c in enumerate(out) if c is None]
        if not places:
            return out
        new, collects = [words[i] for i in places], gc.isenabled()
        gc.disable()   # codes come by the ten thousand and hold no cycles, so collections in between find nothing
        try:
            fresh = self.encode(new)
        finally:
            if collects:
                gc.enable()
        for i, c in zip(places, fresh):
            out[i] = c
        if len(self) < self.most:
            self.update((w, c) for w, c in zip(new, fresh) if len(w) <= MEMO_CHARS)
        return out


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that has an edge to another one; root is the smallest node of its component.

    edges: (u, v), both long. Alternating large-star and small-star steps: each round is a few joins and aggregates over
    the remaining edges, written to the shared folder, and rounds are logarithmic in practice. Nulls and loops are ignored.
    """
    def canonical(e: DataFrame) -> DataFrame:
        return e.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()

    def state(e: DataFrame):
        return e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    now = written(canonical(edges), "edges")
    last = state(now)
    while True:
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # a table, so that AQE can split the edges of a hub in the join
        least = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = written(canonical(small.unionAll(lowest.select("u", F.col("m").alias("v")))), "edges")
        new = state(now)
        if new == last:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(
                now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        last = new
