"""Batch retrieval: many queries against many chunks or vectors.

The query side is the small one. It travels to the executors, in blocks of a bounded size, and the chunks stay where they are;
tasks keep only their k best rows per query before the final shuffle.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext, cloudpickle
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column, DataFrame, Window, functions as F

from cohort import fixed_values as fv
from cohort.functions import exprs as X
from cohort.functions.exprs import col
from cohort.operators.prepare import Dataset
from cohort.operators.reports import _in_department
from cohort.session import written

# functions that run in Python workers travel with their code, so executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BROADCAST_VOCABULARY = 500_000  # terms that are sent to every executor
BLOCK_CELLS = 8_000_000         # of the matrix of terms and queries that is sent at once
COUNTED_TOKENS = 500_000        # words of texts that a task counts at once
SCORED_ROWS = 1_000             # chunks that are scored at once
MAX_KEYWORDS = 100_000          # words of queries that are sent to the chunks at once
SHORT_CHARS = 1_000             # of a chunk that is searched as it stands, with its repeated words
HELD_WORDS = 500_000            # found words of chunks that a task holds before it scores them
SCORED_PAIRS = 500_000          # pairs of a query and a chunk that a task holds before it keeps the best
BROADCAST_NUMBERS = 4_000_000   # numbers of all query vectors together that are sent to every executor
PIVOTS = 256                    # vectors around which cells are made
CELL_NUMBERS = 1_000_000        # of the vectors that are compared at once
CELL_QUERIES = 500              # queries that they are compared with at once
CLOSE_POINTS = 4_096            # queries whose distances from all pivots are held at once
BROADCAST_ROWS = 1_000_000      # ranked rows that are sent to every executor
LARGE_SAMPLE = 20               # a corpus of so many times the sample is cut down by a bound first
SCORE_PLACES = 9                # scores are compared at this precision, so exact copies of a chunk tie


# Chunks --------------------------------------------------------------------------------------------------------------

def row_chunks(ds: Dataset, key: str | None = None) -> DataFrame:
    """One text per row: chunk_id, kind, text.

    key names a column that tells rows apart (default: roll). Where its values repeat, rows of the same value are told apart by
    their text as well, and equal texts by a number, so every row keeps a chunk of its own. Without any key, rows get
    numbers that are written to the shared folder once, so they stay the same when a task runs again.
    """
    parts = []
    if ds.name:
        parts.append(F.concat(F.lit("Student: "), col(ds.name).cast("string")))
    if ds.department:
        parts.append(F.concat(F.lit("Department: "), col(ds.department).cast("string")))
    if ds.attendance:
        parts.append(F.concat(F.lit("Attendance: "), col(ds.attendance).cast("string"), F.lit("%")))
    shown = [*ds.subjects, *[c for c in ("Average", "Grade") if c in ds.df.columns]]
    parts += [F.concat(F.lit(f"{c}: "), col(c).cast("string")) for c in shown]
    # every part starts with a label and preparation leaves no gap, so a text is empty only when there are no parts
    text = F.concat_ws(" | ", *parts)
    key = key or ds.roll
    number = col(key).cast("string") if key else F.monotonically_increasing_id().cast("string")
    rows = ds.df.select(F.concat(F.lit("row:"), number).alias("chunk_id"), F.lit("row").alias("kind"), text.alias("text"))
    if not parts:
        return rows.limit(0)
    if key is None:
        return written(rows, "chunks")
    # by the key itself, as numbers are cheaper to shuffle than ids
    if ds.df.groupBy(col(key)).agg(F.count("*").alias("size")).agg(F.max("size")).first()[0] in (None, 1):
        return rows
    sizes = rows.groupBy("chunk_id").agg(F.count("*").alias("size"))
    # equal rows are counted before the shuffle, so a value that many rows share is spread by its texts
    repeated = rows.groupBy("chunk_id", "kind", "text").agg(F.count("*").alias("copies")).join(sizes, "chunk_id")
    place = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("place")
    own = F.when(F.col("size") == 1, F.col("chunk_id")).otherwise(
        F.concat_ws("#", "chunk_id", F.md5("text"), F.when(F.col("place") > 1, F.col("place").cast("string"))))
    return repeated.select("chunk_id", "kind", "text", "size", place).select(own.alias("chunk_id"), "kind", "text")


def group_chunks(ds: Dataset) -> DataFrame:
    """One summary text per department over all its rows."""
    df, dept = _in_department(ds, None)
    parts = [F.concat(F.lit("Department summary: "), F.col("department")), F.concat(F.lit("Count: "), F.col("count"))]
    aggs = [F.count("*").alias("count")]
    for i, s in enumerate(ds.subjects):
        aggs.append(F.avg(col(s)).alias(f"m{i}"))
        parts.append(F.concat(F.lit(f"Avg {s}: "), X.one_decimal(F.col(f"m{i}"))))
    if ds.attendance:
        aggs.append(F.avg(col(ds.attendance)).alias("attendance"))
        parts.append(F.concat(F.lit("Avg Attendance: "), X.one_decimal(F.col("attendance")), F.lit("%")))
    return df.groupBy(dept).agg(*aggs).select(
        F.concat(F.lit("department:"), F.col("department")).alias("chunk_id"),
        F.lit("department").alias("kind"), F.concat_ws(" | ", *parts).alias("text"),
    )


def sample_rows(chunks: DataFrame, n: int = fv.MAX_SAMPLE, seed: int = fv.SAMPLE_SEED) -> DataFrame:
    """A seeded sample of at most n chunks without replacement, the same under any partitioning.

    The n lowest hashes win. Over a large corpus only hashes below a bound can win, so tasks hand on few rows; the bound
    is used only after a count has shown that enough rows lie below it.
    """
    place = F.md5(F.concat(F.col("chunk_id").cast("string"), F.lit(f"#{seed}")))
    rows = chunks
    total = chunks.count()
    if total > LARGE_SAMPLE * n:
        share = (n + 10 * math.sqrt(n) + 10) / total
        low = chunks.where(place < F.lit(f"{int(share * 2**32):08x}"))
        if not _at_most(low, n - 1):
            rows = low
    return rows.orderBy(place, "chunk_id").limit(n)


def chunk_corpus(ds: Dataset, key: str | None = None, max_rows: int | None = None) -> DataFrame:
    """Row chunks, all of them or a sample, and the department summaries."""
    rows = row_chunks(ds, key)
    if max_rows is not None:
        rows = sample_rows(rows, max_rows)
    return rows.unionByName(group_chunks(ds)) if ds.department else rows


# Top k ---------------------------------------------------------------------------------------------------------------

def _best(scored: DataFrame, k: int, order: Column) -> DataFrame:
    """Rank the rows of every query and keep k; partitions drop the rest before the shuffle."""
    ranked = Window.partitionBy("query_id").orderBy(order, "chunk_id")
    return scored.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)


def _at_most(df: DataFrame, n: int) -> bool:
    return df.count() <= n      # partial counts; a limit would send its rows to one task


# Best rows of a task -------------------------------------------------------------------------------------------------

class Best:
    """The k best (query, id, value) rows of a task so far, smallest values first, ties by id."""

    def __init__(self, n_queries: int, k: int):
        self.k, self.limit = k, np.full(n_queries, np.inf)
        self.query, self.id, self.value = np.empty(0, np.int64), None, np.empty(0)

    def add_scores(self, ids: np.ndarray, values: np.ndarray) -> None:
        """Rows for a matrix of values, whose rows are in the order of their ids; positive values do not count."""
        i, q = np.nonzero((values < 0) & (values <= self.limit))
        if len(i) > 4 * self.k * values.shape[1]:
            # many rows tie: the first k of each query, found by a stable sort, are all that can stay
            first = np.argsort(values, axis=0, kind="stable")[:self.k]
            i, q = first.T.reshape(-1), np.repeat(np.arange(values.shape[1]), len(first))
            live = values[i, q] < 0
            i, q = i[live], q[live]
        self.add(q, ids[i], values[i, q])

    def add(self, query: np.ndarray, ids: np.ndarray, value: np.ndarray) -> None:
        query, value = np.concatenate([self.query, query]), np.concatenate([self.value, value])
        ids = ids if self.id is None else np.concatenate([self.id, ids])
        order = np.lexsort((ids, value, query))
        query, ids, value = query[order], ids[order], value[order]
        first = np.searchsorted(query, query)               # where each row's query begins
        kept = np.arange(len(query)) - first < self.k
        self.query, self.id, self.value = query[kept], ids[kept], value[kept]
        full = (np.arange(len(query)) - first == self.k - 1)
        self.limit[query[full]] = value[full]

    def frame(self, query_ids: np.ndarray, names: tuple[str, str, str], sign: float = 1.0) -> pd.DataFrame:
        ids = np.empty(0, object) if self.id is None else self.id.astype(object)
        return pd.DataFrame(dict(zip(names, (query_ids[self.query], ids, sign * self.value))))


def _ids(column: pd.Series) -> np.ndarray:
    """Ids as an array that sorts without Python: numbers, or texts of one width."""
    found = column.to_numpy()
    return found.astype(str) if found.dtype == object else found


# TF-IDF --------------------------------------------------------------------------------------------------------------

@dataclass(frozen=True)
class TfidfIndex:
    """Vocabulary of a corpus as a written table (term, df, total, idf), and its sizes."""

    terms: DataFrame
    n_terms: int
    n_chunks: int

    def weights(self, texts: DataFrame, key: str) -> DataFrame:
        """Key, term and normalised weight of every term of every text."""
        named = self.terms.select(F.col("term"), F.col("term").alias("place"))
        rows = self._rows(texts, key, named)
        return rows.select(key, F.inline("cells")).withColumnRenamed("place", "term")

    def _rows(self, texts: DataFrame, key: str, wanted: DataFrame, limit: int = BROADCAST_VOCABULARY) -> DataFrame:
        """Key and cells (place, weight) of every text, for the terms of wanted (term, place); norms are over all terms.

        A vocabulary within the checked size travels to the texts. Beyond it the texts' terms meet it in a shuffle, with one row for
        each term of a text, and the cells of a text come together again.
        """
        place = wanted.schema["place"].dataType.simpleString()
        tokens = texts.select(col(key).alias(key), X.tokens(F.coalesce("text", F.lit(""))).alias("t"))
        if self.n_terms <= limit:
            sent = _sent_terms(self.terms.join(wanted, "term", "left"))

            def count(batches):
                number, idf, places = sent.value
                for part in _token_slices(batches):
                    row, at, n, _ = _counted(part.column(1), number)
                    raw = n * idf[at]
                    norm = np.sqrt(np.bincount(row, raw * raw, part.num_rows))
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0), _cells(part.num_rows, row, places.take(pa.array(at)), raw / norm[row], "weight")], names=[key, "cells"])

            kind = texts.schema[key].dataType.simpleString()
            return tokens.mapInArrow(count, f"`{key}` {kind}, cells array<struct<place: {place}, weight: double>>")
        pairs = tokens.select(key, F.explode("t").alias("term")).groupBy(key, "term").agg(F.count("*").alias("n"))
        found = pairs.join(self.terms.select("term", "idf"), "term").join(wanted, "term", "left")
        raw = F.col("n") * F.col("idf")
        whole = found.groupBy(key).agg(
            F.sqrt(F.sum(raw * raw)).alias("norm"),
            F.collect_list(F.when(F.col("place").isNotNull(), F.struct("place", raw.alias("raw")))).alias("cells"))
        return whole.select(key, F.transform("cells", lambda c: F.struct(
            c["place"].alias("place"), (c["raw"] / F.col("norm")).alias("weight"))).alias("cells"))

    def _asked_rows(self, texts: DataFrame, key: str, asked: DataFrame, limit: int) -> DataFrame:
        """As _rows, for few wanted terms and many texts; of a large vocabulary texts without any wanted term are left out.

        The wanted and the most frequent terms of a large vocabulary, about limit of them, travel to the texts. Only the other terms of a text meet
        their idf in a shuffle; they add to its norm and to nothing else.
        """
        if self.n_terms <= limit:
            return self._rows(texts, key, asked, limit)
        level = F.floor(F.log2("df") * 8)
        bound = _frequent(self.terms.groupBy(level.alias("level")).count().collect(), limit)
        sent = _sent_terms(self.terms.join(asked, "term", "left").where((level >= bound) | F.col("place").isNotNull()))
        tokens = texts.select(col(key).alias(key), X.tokens(F.coalesce("text", F.lit(""))).alias("t"))

        def count(batches):
            number, idf, places = sent.value
            task, seen = TaskContext.get().partitionId(), 0
            for part in _token_slices(batches):
                size = part.num_rows
                row, at, n, (other, words, times) = _counted(part.column(1), number)
                raw = n * idf[at]
                cells = _cells(size, row, places.take(pa.array(at)), raw, "raw")
                rare = pa.ListArray.from_arrays(pa.array(np.searchsorted(other, np.arange(size + 1)), pa.int32()),
                                                pa.StructArray.from_arrays([words, pa.array(times)], names=["term", "n"]))
                found = pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(seen, seen + size) + (task << 33)), part.column(0), pa.array(np.bincount(row, raw * raw, size)), cells, rare],
                    names=["row", key, "squares", "cells", "rare"])
                seen += size
                found = found.filter(pc.greater(pc.list_value_length(cells), 0))
                if found.num_rows:
                    yield found

        kind, place = texts.schema[key].dataType.simpleString(), asked.schema["place"].dataType.simpleString()
        rows = written(tokens.mapInArrow(
            count, f"row long, `{key}` {kind}, squares double, cells array<struct<place: {place}, raw: double>>, rare array<struct<term: string, n: long>>"), "vectors")
        raw = F.col("n") * F.col("idf")
        more = rows.select("row", F.inline("rare")).join(self.terms.select("term", "idf"), "term").groupBy("row").agg(F.sum(raw * raw).alias("more"))
        norm = F.sqrt(F.col("squares") + F.coalesce("more", F.lit(0.0)))
        return rows.drop("rare").join(more, "row", "left").select(col(key).alias(key), norm.alias("norm"), "cells").select(
            key, F.transform("cells", lambda c: F.struct(c["place"].alias("place"), (c["raw"] / F.col("norm")).alias("weight"))).alias("cells"))


def _frequent(levels: list, most: int) -> float:
    """The lowest level from which on at most so many terms lie; levels are rows of (level, count)."""
    bound, held = math.inf, 0
    for r in sorted(levels, key=lambda r: -r["level"]):
        held += r["count"]
        if held > most:
            break
        bound = r["level"]
    return bound


def _sent_terms(terms: DataFrame):
    """A broadcast of the number of each term, and by number its idf and place (null: not wanted)."""
    known = terms.select("term", "idf", "place").toArrow()
    number = {t: i for i, t in enumerate(known["term"].to_pylist())}
    return terms.sparkSession.sparkContext.broadcast(
        (number, np.array(known["idf"].to_pylist(), float), pa.concat_arrays(known["place"].chunks) if number else pa.nulls(0, known["place"].type)))


def _token_slices(batches) -> Iterator[pa.RecordBatch]:
    """(key, tokens) in slices of a bounded number of tokens, unless one text has more."""
    for batch in batches:
        ends = np.cumsum(np.asarray(pc.list_value_length(batch.column(1)), np.int64))
        start = 0
        while start < len(ends):
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + COUNTED_TOKENS, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def _counted(texts: pa.ListArray, number: dict) -> tuple:
    """Row, number and count of the known words of each text, by row and number; (row, word, count) of its other words."""
    sizes = np.asarray(pc.list_value_length(texts), np.int64)
    coded = texts.flatten().dictionary_encode()
    known = np.array([number.get(w, -1) for w in coded.dictionary.to_pylist()], np.int64)
    code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    row, at = np.repeat(np.arange(len(sizes)), sizes), known[code]

    def pairs(live, value, values):
        pair, n = np.unique(row[live] * max(1, values) + value[live], return_counts=True)
        return pair // max(1, values), pair % max(1, values), n

    other, words, times = pairs(at < 0, code, len(known))
    return *pairs(at >= 0, at, len(number)), (other, coded.dictionary.take(pa.array(words)), times)


def _cells(size: int, row: np.ndarray, places: pa.Array, values: np.ndarray, name: str) -> pa.ListArray:
    """Lists of (place, value), one for each of so many rows, without those that have no place."""
    wanted = np.asarray(places.is_valid())
    cells = pa.StructArray.from_arrays([places.filter(pa.array(wanted)), pa.array(values[wanted])], names=["place", name])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row[wanted], np.arange(size + 1)), pa.int32()), cells)


def tfidf_index(chunks: DataFrame, max_terms: int | None = None, stop_words: list[str] | None = None) -> TfidfIndex:
    """Count the terms of a corpus, all of them or the max_terms most frequent ones, with their smoothed idf.

    Stop words default to Spark's English list. One pass counts terms and chunks as partial sums per task; the vocabulary is
    written to the shared folder and only its size comes to the driver.
    """
    stop = StopWordsRemover.loadDefaultStopWords("english") if stop_words is None else stop_words
    found = chunks.select(X.tokens(F.coalesce("text", F.lit(""))).alias("t"))
    every = F.transform("t", lambda t: F.struct(t.alias("term"), F.lit(0).alias("first")))
    # the empty term, which no text has, counts the chunks
    once = F.transform(F.concat(F.array_distinct("t"), F.array(F.lit(""))), lambda t: F.struct(t.alias("term"), F.lit(1).alias("first")))
    counts = written(found.select(F.inline(F.concat(every, once))).where(~F.col("term").isin(stop)).groupBy("term").agg(
        F.sum("first").alias("df"), F.count_if(F.col("first") == 0).alias("total")), "terms")
    size = counts.where("term = ''").first()
    n = size["df"] if size else 0
    idf = F.log((F.lit(n) + 1) / (F.col("df") + 1)) + 1
    terms = counts.where("term <> ''").select("term", "df", "total", idf.alias("idf"))
    if max_terms is not None:
        terms = written(terms.orderBy(F.desc("total"), "term").limit(max_terms), "terms")
    return TfidfIndex(terms, terms.count(), n)


def _blocks(rows: DataFrame, n: int):
    """The rows of queries in n parts by query; a query is whole in one of them."""
    for i in range(n):
        yield rows if n == 1 else rows.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == i)


def tfidf_topk(
    index: TfidfIndex, chunks: DataFrame, queries: DataFrame, k: int = fv.TOP_K, block_cells: int = BLOCK_CELLS,
    vocabulary: int = BROADCAST_VOCABULARY,
) -> DataFrame:
    """The k most similar chunks per query with a positive cosine: query_id, rank, chunk_id, score.

    chunks has a unique chunk_id and text, queries a unique query_id and text. Queries are sent to the chunks in blocks of a
    bounded size; tasks score chunks where they are and hand on k rows per query.
    """
    spark = chunks.sparkSession
    ids = chunks.schema["chunk_id"].dataType.simpleString(), queries.schema["query_id"].dataType.simpleString()
    schema = f"query_id {ids[1]}, chunk_id {ids[0]}, score double"
    named = index.terms.select(F.col("term"), F.col("term").alias("place"))
    wanted = written(index._rows(queries, "query_id", named, vocabulary).select("query_id", F.inline("cells")), "query-terms")
    cells, n_queries = wanted.agg(F.count("*"), F.count_distinct("query_id")).first()
    n_blocks = max(1, math.ceil(math.sqrt(cells * n_queries / block_cells)))
    parts = []
    for block in _blocks(wanted, n_blocks) if cells else ():
        rows = block.toArrow()
        if not rows.num_rows:
            continue
        kind, rows = rows.schema.field("query_id").type, rows.to_pylist()
        query_ids = np.array(sorted({r["query_id"] for r in rows}), object)
        at = {q: i for i, q in enumerate(query_ids)}
        terms = sorted({r["place"] for r in rows})
        row = {t: i for i, t in enumerate(terms)}
        matrix = np.zeros((len(terms), len(query_ids)))
        for r in rows:
            matrix[row[r["place"]], at[r["query_id"]]] = r["weight"]
        sent = spark.sparkContext.broadcast((query_ids, matrix, kind))
        asked = spark.createDataFrame(list(row.items()), "term string, place int")
        vectors = index._asked_rows(chunks, "chunk_id", asked, vocabulary)

        def search(batches, sent=sent):
            query_ids, matrix, kind = sent.value
            best, names = Best(len(query_ids), k), None
            for batch in batches:
                names = names or pa.schema([("query_id", kind), ("chunk_id", batch.schema.field("chunk_id").type), ("score", pa.float64())])
                chunk_ids, cells = _ids(batch.column("chunk_id").to_pandas()), batch.column("cells")
                edges, place, weight = (np.asarray(x) for x in (cells.offsets, cells.values.field("place"), cells.values.field("weight")))
                order = np.argsort(chunk_ids, kind="stable")
                for start in range(0, len(order), SCORED_ROWS):
                    some = order[start:start + SCORED_ROWS]
                    scores = np.zeros((len(some), len(query_ids)))
                    for i, (a, b) in enumerate(zip(edges[some], edges[some + 1])):
                        if b > a:
                            scores[i] = weight[a:b] @ matrix[place[a:b]]
                    best.add_scores(chunk_ids[some], -np.round(scores, SCORE_PLACES))
            if names is not None:
                yield pa.RecordBatch.from_pandas(best.frame(query_ids, ("query_id", "chunk_id", "score"), -1.0), names, preserve_index=False)

        parts.append(vectors.mapInArrow(search, schema))
    scored = reduce(DataFrame.unionAll, parts) if parts else spark.createDataFrame([], schema)
    return _best(scored, k, F.desc("score")).select("query_id", "rank", "chunk_id", "score")


# Keywords ------------------------------------------------------------------------------------------------------------

def keyword_topk(
    chunks: DataFrame, queries: DataFrame, k: int = fv.TOP_K, pad: bool = False, max_keywords: int = MAX_KEYWORDS
) -> DataFrame:
    """The k chunks that contain most words of each query as plain substrings: query_id, rank, chunk_id, score.

    A word that a query repeats counts as often. With pad, queries with fewer than k matches are filled up with
    unmatched chunks in the order of their ids, score 0.

    Queries are sent to the chunks in blocks of a bounded number of words. A task makes one automaton of the words of all queries of a block, which
    finds every word in one pass over a chunk, whatever their number, and hands on k rows per query. Chunks that hold the same words are
    scored together.
    """
    spark = chunks.sparkSession
    ids = chunks.schema["chunk_id"].dataType.simpleString(), queries.schema["query_id"].dataType.simpleString()
    schema = f"query_id {ids[1]}, chunk_id {ids[0]}, score double"
    asked = queries.select("query_id", F.explode(X.words(F.col("text"))).alias("word"))
    asked = written(asked.groupBy("query_id", "word").agg(F.count("*").alias("times")), "keywords")
    # words hold no white space, so the distinct parts of a chunk stand for it; in a short one they are not worth finding
    distinct = F.array_join(F.array_distinct(X.words(F.col("text"))), " ")
    parts = chunks.select("chunk_id", F.when(F.length("text") <= SHORT_CHARS, F.lower("text")).otherwise(distinct).alias("text"))
    found = []
    n_blocks = math.ceil(asked.count() / max(1, max_keywords))
    for block in _blocks(asked, n_blocks) if n_blocks else ():
        rows = block.collect()
        if rows:
            sent = spark.sparkContext.broadcast(_keyword_table(rows))
            found.append(parts.mapInPandas(lambda batches, sent=sent: _keyword_search(batches, *sent.value, k), schema))
    scored = reduce(DataFrame.unionAll, found) if found else spark.createDataFrame([], schema)
    scored = scored.withColumn("score", F.col("score").cast("long"))
    best = _best(scored, k, F.desc("score")).select("query_id", "rank", "chunk_id", "score")
    return _padded(best, chunks, queries, k) if pad else best


def _keyword_table(rows: list) -> tuple:
    """Query ids, words, and for each word where its queries begin among (queries, times)."""
    query_ids = np.array(sorted({r["query_id"] for r in rows}), object)
    at = {q: i for i, q in enumerate(query_ids)}
    words = sorted({r["word"] for r in rows})
    place = {w: i for i, w in enumerate(words)}
    order = sorted((place[r["word"]], at[r["query_id"]], r["times"]) for r in rows)
    first, asking, times = np.array(order, np.int64).T
    return query_ids, words, np.searchsorted(first, np.arange(len(words) + 1)), asking, times


def _keyword_search(batches: Iterator[pd.DataFrame], query_ids, words, starts, asking, times, k: int) -> Iterator[pd.DataFrame]:
    automaton = ahocorasick.Automaton()
    for i, word in enumerate(words):
        automaton.add_word(word, i)
    automaton.make_automaton()
    best = Best(len(query_ids), k)

    def rank(groups: dict, chunk_ids: np.ndarray) -> None:
        held, count = [], 0
        for hits, rows in groups.items():
            rows = np.array(rows)
            if len(rows) > k:
                rows = rows[np.argsort(chunk_ids[rows], kind="stable")[:k]]   # they tie for every query
            reach = np.concatenate([np.arange(starts[i], starts[i + 1]) for i in hits])
            query, where = np.unique(asking[reach], return_inverse=True)
            value = -np.bincount(where, times[reach])
            live = value <= best.limit[query]
            held.append((query[live].repeat(len(rows)), np.tile(rows, int(live.sum())), value[live].repeat(len(rows))))
            count += len(held[-1][0])
            if count >= SCORED_PAIRS:
                query, rows, value = map(np.concatenate, zip(*held))
                best.add(query, chunk_ids[rows], value)
                held, count = [], 0
        if held:
            query, rows, value = map(np.concatenate, zip(*held))
            best.add(query, chunk_ids[rows], value)

    for batch in batches:
        chunk_ids, groups, size = _ids(batch["chunk_id"]), {}, 0
        for chunk, text in enumerate(batch["text"]):
            hits = frozenset([i for _, i in automaton.iter(text)]) if text else ()
            if not hits:
                continue
            if hits in groups:
                groups[hits].append(chunk)
                continue
            groups[hits] = [chunk]
            size += len(hits)
            if size >= HELD_WORDS:
                rank(groups, chunk_ids)
                groups, size = {}, 0
        rank(groups, chunk_ids)
    yield best.frame(query_ids, ("query_id", "chunk_id", "score"), -1.0)


def _padded(best: DataFrame, chunks: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    # among the k lowest ids enough are unmatched for any query with fewer than k matches
    lowest = chunks.select("chunk_id").orderBy("chunk_id").limit(k).agg(F.collect_list("chunk_id")).scalar()
    filler = queries.select("query_id", lowest.alias("lowest")).select(
        "query_id", F.explode("lowest").alias("chunk_id"), F.lit(0).cast("long").alias("score")
    )
    # a filler that is a match as well keeps the score of the match
    both = best.drop("rank").unionByName(filler).groupBy("query_id", "chunk_id").agg(F.max("score").alias("score"))
    return _best(both, k, F.desc("score")).select("query_id", "rank", "chunk_id", "score")


# Dense vectors -------------------------------------------------------------------------------------------------------

def _matrix(embeddings) -> np.ndarray:
    return np.stack([np.asarray(e, dtype="float64") for e in embeddings])


def _near(block: np.ndarray, points: np.ndarray, limit: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, query and exact distance of all pairs within the limits that can be among the k nearest, ties included.

    Distances by a matrix product pick the candidates, with room for its rounding; exact ones decide.
    """
    rows, asked = np.square(block).sum(axis=1), np.square(points).sum(axis=1)
    # the product gives the squared distance less the query's own square and the room for the row
    about = np.column_stack([block, rows * (1 - 1e-9)]) @ np.column_stack([-2 * points, np.ones(len(points))]).T
    most = limit + 1e-9 * (1 + asked) - asked
    hits = np.flatnonzero(about <= most)
    if len(hits) > 4 * k * len(points) and len(block) > k:
        most = np.minimum(most, np.partition(about, k - 1, axis=0)[k - 1] + 3e-9 * (1 + rows.max() + asked))
        hits = np.flatnonzero(about <= most)
    i, q = np.divmod(hits, len(points))
    exact = np.concatenate([np.square(block[i[a:a + SCORED_ROWS]] - points[q[a:a + SCORED_ROWS]]).sum(axis=1)
                            for a in range(0, len(i), SCORED_ROWS)] or [np.empty(0)])
    exact = np.round(exact, SCORE_PLACES)
    live = exact <= limit[q]
    return i[live], q[live], exact[live]


def _without_spare(found: np.ndarray, far: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the vectors without copies that have k equal ones of lower ids: no query can want them.

    far is the same for equal vectors of a cell.
    """
    _, group, count = np.unique(far, return_inverse=True, return_counts=True)
    if count.max() <= k:
        return np.arange(len(found))
    _, group = np.unique(np.ascontiguousarray(found).view(f"V{found.itemsize * found.shape[1]}").ravel(), return_inverse=True)
    order = np.lexsort((ids, group))
    return np.sort(order[np.arange(len(order)) - np.searchsorted(group[order], group[order]) < k])


def _apart(points: np.ndarray, squares: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distance of each point, whose sum of squares is known, from each pivot, and the room for its rounding."""
    a, b = squares[:, None], np.square(pivots).sum(axis=1)
    return np.sqrt(np.maximum(0, a + b - 2 * (points @ pivots.T))), 1e-6 * (1 + np.sqrt(a) + np.sqrt(b))


@dataclass(frozen=True)
class Cells:
    """Vectors by their nearest pivot (chunk_id, cell, far, embedding), and what is known of each cell."""

    rows: DataFrame
    pivots: np.ndarray
    held: np.ndarray      # vectors in each cell
    near: np.ndarray      # least and greatest distance of a vector in it from its pivot
    far: np.ndarray

    def close(self, points: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Distance of each point from the pivot next to it, and the cells next to it, as many as hold k vectors; -1 fills up."""
        nearest, first = [np.empty(0)], [np.empty((0, k), "int32")]
        for start in range(0, len(points), CLOSE_POINTS):
            some = points[start:start + CLOSE_POINTS]
            d, _ = _apart(some, np.square(some).sum(axis=1), self.pivots)
            order = np.argsort(d, axis=1, kind="stable")[:, :k]       # a cell holds its pivot at least
            before = np.cumsum(self.held[order], axis=1) - self.held[order]
            chosen = np.full((len(d), k), -1, "int32")
            chosen[:, :order.shape[1]] = np.where(before < k, order, -1)
            nearest.append(d.min(axis=1))
            first.append(chosen)
        return np.concatenate(nearest), np.concatenate(first)


def cells(vectors: DataFrame, pivots: int = PIVOTS) -> Cells | None:
    """Voronoi cells around a bounded sample of the vectors (by a hash of their ids), written once; None without vectors.

    Vectors of a cell lie together, and a cell of many vectors in several files.
    """
    vectors = vectors.where(F.col("embedding").isNotNull()).select("chunk_id", "embedding")
    chosen = vectors.orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(pivots).collect()
    if not chosen:
        return None
    points = np.unique(_matrix([r["embedding"] for r in chosen]), axis=0)
    sent = vectors.sparkSession.sparkContext.broadcast(points)

    def place(batches):
        points = sent.value
        for batch in batches:
            found = _matrix(batch["embedding"]) if len(batch) else np.zeros((0, points.shape[1]))
            about = np.square(points).sum(axis=1) - 2 * found @ points.T
            cell = about.argmin(axis=1)
            yield batch.assign(cell=cell.astype("int32"), far=np.sqrt(np.square(found - points[cell]).sum(axis=1)))

    schema = f"{vectors.select('chunk_id').schema.simpleString()[7:-1].replace(':', ' ', 1)}, embedding {vectors.schema['embedding'].dataType.simpleString()}, cell int, far double"
    spark = vectors.sparkSession
    files = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = written(vectors.mapInPandas(place, schema).repartitionByRange(files, "cell", F.xxhash64("chunk_id")), "cells")
    held, near, far = np.zeros(len(points)), np.full(len(points), np.inf), np.zeros(len(points))
    for r in rows.groupBy("cell").agg(F.count("*").alias("n"), F.min("far").alias("near"), F.max("far").alias("far")).collect():
        held[r["cell"]], near[r["cell"]], far[r["cell"]] = r["n"], r["near"], r["far"]
    return Cells(rows, points, held, np.where(held > 0, near, 0), far)


def _search_cells(batches, points: np.ndarray, known: tuple, nearest: np.ndarray, first: np.ndarray, limit: np.ndarray | None, k: int, compared) -> Best:
    """The k nearest vectors of a task to each query: without limits in the cells next to it, else in all cells whose bounds are within its limit."""
    pivots, near, far = known
    best, held, count = Best(len(points), k), [], 0
    most = np.full(len(points), np.inf) if limit is None else limit
    squares = np.square(points).sum(axis=1)
    for batch in batches:
        ids, embeddings, distance, cell = _ids(batch["chunk_id"]), batch["embedding"].to_numpy(), batch["far"].to_numpy(), batch["cell"].to_numpy()
        order = np.argsort(cell, kind="stable")
        edges = np.flatnonzero(np.diff(cell[order], prepend=-1, append=-1))
        for start, stop in zip(edges[:-1], edges[1:]):
            own, c = order[start:stop], int(cell[order[start]])
            now = np.minimum(most, best.limit)
            if limit is None:
                asked = np.flatnonzero((first == c).any(axis=1))
            else:
                # a vector is between near and far from its pivot, and no nearer to the pivot next to the query than to its own
                (d,), (room,) = (x.T for x in _apart(points, squares, pivots[c:c + 1]))
                low = np.maximum(np.maximum(d - far[c], near[c] - d), (d - nearest) / 2) - room
                asked = np.flatnonzero(np.square(np.maximum(0, low)) <= now + 10.0 ** -SCORE_PLACES)
            if not len(asked):
                continue
            found = _matrix(embeddings[own])
            some = _without_spare(found, distance[own], ids[own], k)
            own, found = own[some], found[some]
            compared.add(len(own) * len(asked))
            at_once = max(1, CELL_NUMBERS // points.shape[1])
            for start in range(0, len(own), at_once):
                for q0 in range(0, len(asked), CELL_QUERIES):
                    part = asked[q0:q0 + CELL_QUERIES]
                    i, q, exact = _near(found[start:start + at_once], points[part], now[part], k)
                    held.append((part[q], ids[own[start + i]], exact))
                    count += len(i)
                    if count >= SCORED_PAIRS:
                        best.add(*map(np.concatenate, zip(*held)))
                        held, count = [], 0
                        now = np.minimum(most, best.limit)
    if held:
        best.add(*map(np.concatenate, zip(*held)))
    return best


def knn_topk(vectors: DataFrame | Cells, queries: DataFrame, k: int = fv.TOP_K, broadcast_numbers: int = BROADCAST_NUMBERS, compared=None) -> DataFrame:
    """Exact nearest vectors by squared Euclidean distance: query_id, rank, chunk_id, distance.

    vectors has chunk_id and embedding, or is what cells(...) made of it for several searches; queries has query_id and embedding.
    Queries are sent to the vectors in blocks of a bounded size, and the rows of a block are written before the next one. A first pass compares
    each query with the cells next to it that hold k vectors together; with the distance that it found, a second pass compares it with those
    cells only that can hold a nearer vector by the triangle inequality. Tasks hand on k rows per query. compared, an accumulator, counts the pairs.
    Where no cell can be left out, as among points that are all about equally far from each other, all pairs are compared, by matrix products.
    """
    spark = queries.sparkSession
    index = vectors if isinstance(vectors, Cells) else cells(vectors)
    query_type = queries.schema["query_id"].dataType.simpleString()
    id_type = (vectors if index is None else index.rows).schema["chunk_id"].dataType.simpleString()
    nothing = spark.createDataFrame([], f"query_id {query_type}, rank int, chunk_id {id_type}, distance double")
    if index is None:
        return nothing
    schema = f"query_id {query_type}, chunk_id {id_type}, distance double"
    compared = compared if compared is not None else spark.sparkContext.accumulator(0)
    queries = queries.where(F.col("embedding").isNotNull()).select("query_id", "embedding")
    numbers = queries.agg(F.coalesce(F.sum(F.size("embedding")), F.lit(0))).first()[0]
    known, parts = (index.pivots, index.near, index.far), []
    for block in _blocks(queries, max(1, -(-numbers // broadcast_numbers))):
        rows = block.toArrow()
        if not rows.num_rows:
            continue
        query_ids, points = np.array(rows.column("query_id").to_pylist(), object), _matrix(rows.column("embedding").to_pandas())
        nearest, first = index.close(points, k)
        sent = spark.sparkContext.broadcast((points, known, nearest, first))

        def closest(batches, sent=sent):
            best = _search_cells(batches, *sent.value, None, k, compared)
            yield pd.DataFrame({"place": best.query.astype("int32"), "distance": best.value})

        reached = index.rows.mapInPandas(closest, "place int, distance double").groupBy("place").agg(
            F.get(F.sort_array(F.collect_list("distance")), F.lit(k - 1)).alias("limit")).where("limit IS NOT NULL").toArrow()
        limit = np.full(len(points), np.inf)
        limit[reached.column("place").to_numpy()] = reached.column("limit").to_numpy() + 10.0 ** -SCORE_PLACES
        bounds = spark.sparkContext.broadcast((query_ids, limit))

        def search(batches, sent=sent, bounds=bounds):
            query_ids, limit = bounds.value
            yield _search_cells(batches, *sent.value, limit, k, compared).frame(query_ids, ("query_id", "chunk_id", "distance"))

        found = _best(index.rows.mapInPandas(search, schema), k, F.asc("distance"))
        parts.append(written(found.select("query_id", "rank", "chunk_id", "distance"), "nearest"))
        sent.destroy()
        bounds.destroy()
    return reduce(DataFrame.unionAll, parts) if parts else nothing


# Context -------------------------------------------------------------------------------------------------------------

def context_blocks(queries: DataFrame, best: DataFrame, chunks: DataFrame, k: int = fv.TOP_K) -> DataFrame:
    """Per query the text of its ranked chunks as a list of lines, or the text for no match: query_id, context.

    best holds at most k ranked chunks per query.
    """
    # within the checked size the ranked ids travel and the chunk texts are not shuffled
    if _at_most(queries, BROADCAST_ROWS // k):
        best = F.broadcast(best)
    texts = best.join(chunks.select("chunk_id", "text"), "chunk_id").select("query_id", "rank", "text")
    lines = F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda r: F.concat(F.lit("- "), r["text"]))
    blocks = texts.groupBy("query_id").agg(F.array_join(lines, "\n").alias("context"))
    return queries.select("query_id").join(blocks, "query_id", "left").select(
        "query_id", F.coalesce("context", F.lit(fv.NO_CONTEXT)).alias("context")
    )


def augmented_prompts(queries: DataFrame, contexts: DataFrame, max_chars: int = fv.CONTEXT_CHARS) -> DataFrame:
    """Query text followed by its context, cut to max_chars; just the text when there is no context."""
    has_context = F.col("context").isNotNull() & (F.col("context") != "") & (F.col("context") != fv.NO_CONTEXT)
    extended = F.concat(F.col("text"), F.lit(f"\n\n{fv.CONTEXT_HEADER}\n"), X.truncate(F.col("context"), max_chars))
    return queries.join(contexts, "query_id", "left").select(
        "query_id", F.when(has_context, extended).otherwise(F.col("text")).alias("prompt")
    )
