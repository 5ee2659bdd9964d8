"""Benchmark decontamination: every passage of every document queries a BM25 index of the test items.

The index keeps, for each term, its upper bound, the highest score in each block of items and the scores of its items,
all as shares of an item's score against its own text. As all items above a fixed threshold are wanted, block-max WAND
goes term set by term set: without enough upper bounds there is no pivot and the passage is done; block maxima are
added up next, and only where a block can reach the threshold are full scores computed. What is retrieved is verified on the
word shingles of question and answer.

Documents stay where they are. Distinct item texts are indexed in blocks of bounded size, each sent to the executors in turn;
document frequencies, lengths and numbers are those of all items, so the blocks change no score. Ids are joined back.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StringType, StructField, StructType, _parse_datatype_string

from cohort.llm.common import keep_texts, named, pieces, texts_of, utf8
from cohort.session import written

WORD = re.compile(r"\w+")
K1, B = 1.2, 0.75
SEGMENT = 64               # longer items are indexed in segments of so many words
BLOCK = 2                  # segments in a block of the index
INDEX_CHARS = 32 << 20     # characters of items that are indexed and sent at once
SHINGLE = 5
THRESHOLD = 0.5            # of an item's own score
OVERLAP = 0.8              # of the shingles of question and answer
FIELDS = """score double, bm25 double, passage_start long, n_passages long, question_overlap double,
    answer_overlap double"""


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def shingles(words: list[str]) -> set[tuple]:
    """The word 5-tuples of a text; of a shorter text, all its words."""
    k = min(SHINGLE, len(words))
    return set(zip(*(words[i:] for i in range(k)))) if k else set()


def segments(question: list[str], answer: list[str]) -> list[list[str]]:
    """The words of an item in segments; an item without a question is searched by its answer."""
    words = question or answer
    return [words[i:i + SEGMENT] for i in range(0, len(words), SEGMENT)]


def statistics(parts: list[tuple]) -> dict:
    """What scores need of (segment, how many items have it): document frequencies, number, words, longest segment."""
    df: Counter = Counter()
    for part, times in parts:
        for w in set(part):
            df[w] += times
    return {"df": df, "n": sum(t for _, t in parts), "words": sum(len(p) * t for p, t in parts),
            "span": max((len(p) for p, _ in parts), default=1)}


def build_index(items: list[tuple], whole: dict | None = None) -> dict:
    """The index of (id, question, answer) rows; texts may be None.

    whole: the statistics of all items, when these are a part of them; by default these are all.
    """
    texts = [(words_of(q or ""), words_of(a or "")) for _, q, a in items]
    parts = [(j, p) for j, (q, a) in enumerate(texts) for p in segments(q, a)]
    whole = whole or statistics([(p, 1) for _, p in parts])
    df = whole["df"]
    # neighbours in the order of their most common word score alike, which keeps block maxima tight
    parts.sort(key=lambda x: (max((df[w], w) for w in x[1]), x[0]))
    n, mean = whole["n"], whole["words"] / max(1, whole["n"])
    terms: dict[str, int] = {}
    postings: list[list[tuple]] = []
    own = []
    for at, (_, part) in enumerate(parts):
        scores = {w: math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * f * (K1 + 1) / (f + K1 * (1 - B + B * len(part) / mean))
                  for w, f in Counter(part).items()}
        own.append(sum(scores.values()))
        for w, s in scores.items():
            if w not in terms:
                terms[w] = len(postings)
                postings.append([])
            postings[terms[w]].append((at, s / own[-1]))
    index = {"terms": terms, "of": [j for j, _ in parts], "own": own, "upper": [max(s for _, s in p) for p in postings],
             "span": whole["span"], "ids": [i for i, _, _ in items],
             "questions": [shingles(q) for q, _ in texts], "answers": [shingles(a) for _, a in texts]}
    index["parts"] = [(np.array([a for a, _ in p]), np.array([s for _, s in p])) for p in postings]
    index["blocks"] = []
    for ids, scores in index["parts"]:
        blocks, first = np.unique(ids // BLOCK, return_index=True)
        index["blocks"].append((blocks, np.maximum.reduceat(scores, first)))
    return index


def _sums(lists: list, terms: list[int]) -> np.ndarray:
    found = [lists[t] for t in terms]
    return np.bincount(np.concatenate([i for i, _ in found]), np.concatenate([s for _, s in found]))


def retrieve(words: list[str], index: dict, threshold: float = THRESHOLD) -> dict[int, tuple]:
    """item -> (best score, start of that passage, passages) of all passages of a text that score the threshold or more.

    Passages are as long as two segments and start a segment apart, so each stretch of a segment's length lies in one.
    """
    get, upper, span = index["terms"].get, index["upper"], index["span"]
    codes = list(map(get, words))
    found: dict[int, tuple] = {}
    for start in range(0, max(1, len(codes) - span), span):
        terms = set(codes[start:start + 2 * span])
        terms.discard(None)
        if sum([upper[t] for t in terms]) < threshold - 1e-9:
            continue                                       # no pivot
        terms = list(terms)
        bounds = _sums(index["blocks"], terms)
        if bounds.max() < threshold - 1e-9:
            continue                                       # no block can reach it
        scores = _sums(index["parts"], terms)
        for part in np.flatnonzero(scores >= threshold - 1e-9).tolist():
            item, score = index["of"][part], float(scores[part])
            best, at, n, last, own = found.get(item, (0.0, 0, 0, -1, 0.0))
            if score > best + 1e-9:    # sums of equal terms may differ in their last bits
                best, at, own = score, start, index["own"][part]
            found[item] = (best, at, n + (last != start), start, own)
    return found


def leaks(text: bytes, index: dict, threshold: float = THRESHOLD, overlap: float = OVERLAP) -> list[tuple]:
    """(item id, FIELDS) of the verified items of one text, in the order of the items."""
    words = words_of(text.decode())
    found = retrieve(words, index, threshold) if words and index["ids"] else {}
    if not found:
        return []
    there, out = shingles(words), []
    short = {len(s) for j in found for side in ("questions", "answers") for s in index[side][j] if len(s) < min(SHINGLE, len(words))}
    for k in short:
        there |= set(zip(*(words[i:] for i in range(k))))
    for item in sorted(found):
        shares = [len(s & there) / len(s) if s else None for s in (index["questions"][item], index["answers"][item])]
        if all(s is None or s >= overlap for s in shares):
            best, at, n, _, own = found[item]
            out.append((index["ids"][item], best, best * own, at, n, *shares))
    return out


def _rows(items: DataFrame, item_id: str, question: str, answer: str | None) -> DataFrame:
    """(id, q, a, key): the key stands for both texts, null and empty ones told apart."""
    q = named(question).cast("string")
    a = named(answer).cast("string") if answer else F.lit(None).cast("string")
    rows = items.select(named(item_id).alias("id"), q.alias("q"), a.alias("a"))
    length = lambda c: F.coalesce(F.char_length(c), F.lit(-1)).cast("string")
    return rows.withColumn("key", F.sha2(F.concat(
        length("q"), F.lit(" "), length("a"), F.lit(" "), F.coalesce("q", F.lit("")), F.coalesce("a", F.lit(""))), 256))


def _statistics(texts: DataFrame):
    """(block, word, n) of (block, q, a, times): how many segments of a block's items hold a word; and the other statistics."""
    def run(batches):
        for batch in batches:
            found: dict = {}
            for block, q, a, times in zip(*(c.to_pylist() for c in batch.columns)):
                found.setdefault(block, []).extend((p, times) for p in segments(words_of(q or ""), words_of(a or "")))
            for block, parts in found.items():
                own = statistics(parts)
                rows = [*own["df"].items()]
                k = len(rows)
                # the row without a word holds the number of segments, their words and the longest one
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block] * (k + 1), pa.int64()), pa.array([w for w, _ in rows] + [None], pa.string()),
                     pa.array([c for _, c in rows] + [own["n"]], pa.int64()), pa.array([None] * k + [own["words"]], pa.int64()),
                     pa.array([None] * k + [own["span"] if parts else 1], pa.int64())], names=["block", "word", "n", "words", "span"])

    made = written(texts.select("block", "q", "a", "times").mapInArrow(
        run, "block long, word string, n long, words long, span long"), "item-words")
    zero = F.lit(0)
    n, words, span = made.where("word IS NULL").agg(
        F.coalesce(F.sum("n"), zero), F.coalesce(F.sum("words"), zero), F.coalesce(F.max("span"), F.lit(1))).first()
    totals = written(made.where("word IS NOT NULL").groupBy("word").agg(F.sum("n").alias("df")), "item-df")
    return made.where("word IS NOT NULL").select("block", "word"), totals, {"n": n, "words": words, "span": span}


def _indexes(rows: DataFrame):
    """Broadcast indexes of all distinct texts of items, by their keys, one block after the other."""
    texts = written(rows.groupBy("key").agg(F.first("q").alias("q"), F.first("a").alias("a"), F.count("*").alias("times")), "items")
    size = F.coalesce(F.char_length("q"), F.lit(0)) + F.coalesce(F.char_length("a"), F.lit(0)) + 64
    total = texts.agg(F.sum(size.cast("long"))).first()[0] or 0
    n = -(-total * 3 // (2 * INDEX_CHARS)) or 1     # hashed blocks differ in size, so they are planned at two thirds
    texts = texts.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(n)).cast("long"))
    words, totals, rest = _statistics(texts)
    for i in range(n):
        found = sorted(tuple(r) for r in texts.where(F.col("block") == i).select("key", "q", "a").collect())
        of_block = totals.join(words.where(F.col("block") == i).select("word").distinct(), "word").select("word", "df")
        whole = {**rest, "df": {w: c for w, c in of_block.collect()}}
        yield rows.sparkSession.sparkContext.broadcast(build_index(found, whole))


def find_leaks(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id",
    question: str = "text", answer: str | None = None, threshold: float = THRESHOLD, overlap: float = OVERLAP
) -> DataFrame:
    """(id, item id, FIELDS): one row for each document and item whose question, and answer if it has one, it contains.

    score is the share of the item's own BM25 score that the best passage reaches; an overlap is null when that side of the
    item has no words. An item without a question is searched by its answer. Items or documents without words, null
    texts included, are never found. A repeated document has its rows each time, items with the same text are all
    found, rows with null ids take part. Empty tables give an empty table; further columns are not read.
    """
    item_name = item_id if item_id != id_col else f"item_{item_id}"
    schema = StructType([StructField("__doc", docs.schema[id_col].dataType), StructField("__key", StringType()),
                         *_parse_datatype_string(FIELDS).fields])
    source = texts_of(docs, id_col, text_col)

    def search(index) -> DataFrame:
        def run(batches):
            for batch in batches:
                for part in pieces(batch, "text"):
                    rows, at = [], []
                    for i, text in enumerate(utf8(part.column("text"))):
                        got = leaks(text, index.value, threshold, overlap)
                        rows += got
                        at += [i] * len(got)
                    if rows:
                        columns = list(zip(*rows))
                        kinds = [pa.float64(), pa.float64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
                        yield pa.RecordBatch.from_arrays(
                            [part.column("id").take(pa.array(at)), pa.array(columns[0], pa.string()),
                             *[pa.array(c, t) for c, t in zip(columns[1:], kinds)]], names=schema.names)

        return source.mapInArrow(run, schema)

    rows = _rows(items, item_id, question, answer)
    # a table, so that AQE can split the ids of a text that many items have
    ids = written(rows.select(F.col("key").alias("__key"), F.col("id").alias("__item")), "item-ids")
    found = reduce(DataFrame.unionAll, [search(i) for i in _indexes(rows)])
    measures = [f.name for f in schema.fields[2:]]
    return found.join(ids, "__key").select("__doc", "__item", *measures).toDF(id_col, item_name, *measures)


def keep_clean(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", question: str = "text",
               answer: str | None = None, threshold: float = THRESHOLD, overlap: float = OVERLAP) -> DataFrame:
    """The rows of docs, with all their columns, that contain no item."""
    for index in _indexes(_rows(items, item_id, question, answer)):
        docs = keep_texts(docs, text_col, lambda texts, index=index: [not leaks(t, index.value, threshold, overlap) for t in texts])
    return docs
