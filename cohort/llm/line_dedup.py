"""Lines that repeat across documents are dropped, except in the first document that holds them.

DataFrame operations only. Lines are exploded, normalised and hashed to 128 bits; each hash counts its distinct documents;
hashes over the threshold are joined back by hash, which gives every document the positions to drop, and each document is
reassembled from its own lines by position. Texts are shuffled once; a line that a large share of the documents holds
is one row per document, spread by (hash, document) before it is counted, and split by AQE in the join back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cohort.session import written

STRIPPED = " \t\n\v\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _key(line: Column) -> Column:
    bare = F.btrim(line, F.lit(STRIPPED))
    ascii_only = F.octet_length(bare) == F.char_length(bare)   # lower() is the faster way, and the same for ASCII
    return F.when(ascii_only, F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select("*", F.col(id_col).alias("__id"), text.alias("__text"), F.xxhash64(text).alias("__t1"),
                       F.xxhash64(F.lit(1), text).alias("__t2"))


def _drops(docs: DataFrame, id_col: str, text_col: str, min_docs: int, min_chars: int) -> DataFrame:
    lines = _rows(docs, id_col, text_col).select(
        "__id", "__t1", "__t2", F.posexplode(F.split("__text", "\n")).alias("pos", "line")
    ).withColumn("key", _key(F.col("line"))).where(F.char_length("key") >= min_chars)
    lines = written(lines.select("__id", "__t1", "__t2", "pos", F.xxhash64("key").alias("h1"),
                                 F.xxhash64(F.lit(1), "key").alias("h2")), "lines")
    shared = (lines.select("h1", "h2", "__id").distinct().groupBy("h1", "h2")
              .agg(F.count(F.lit(1)).alias("n"), F.min("__id").alias("first")).where(F.col("n") >= min_docs))
    # read from a table, so that both sides of the join are plain exchanges and AQE can split a line of many documents
    shared = written(shared.select("h1", "h2", "first"), "shared-lines")
    found = lines.join(shared, ["h1", "h2"]).where(~F.col("__id").eqNullSafe(F.col("first")))
    at = found.groupBy("__id", "__t1", "__t2").agg(F.sort_array(F.collect_set("pos")).alias("p"))
    gaps = F.transform("p", lambda x, i: F.concat(
        F.repeat(F.lit("0"), x - F.when(i > 0, F.get("p", i - 1)).otherwise(-1) - 1), F.lit("1")))
    # one byte for each line up to the last dropped one, so that a position is looked up in constant time
    return at.select("__id", "__t1", "__t2", F.size("p").alias("__n"),
                     F.array_join(gaps, "").cast("binary").alias("__mask"))


def _shortened(docs: DataFrame, id_col: str, text_col: str, min_docs: int, min_chars: int) -> DataFrame:
    """The columns of docs as c0, c1, ..., and __new (the text that is kept), __n (lines before) and __k (dropped lines)."""
    if min_docs < 2:
        raise ValueError("min_docs must be at least 2")
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    own_id, own_text = (f"c{docs.columns.index(c)}" for c in (id_col, text_col))
    drops = _drops(plain, own_id, own_text, min_docs, min_chars)
    rows = _rows(plain, own_id, own_text)
    same = rows["__id"].eqNullSafe(drops["__id"]) & (rows["__t1"] == drops["__t1"]) & (rows["__t2"] == drops["__t2"])
    both = rows.join(drops.withColumnsRenamed({"__mask": "__m", "__n": "__k"}), same, "left")
    kept = F.filter(F.split("__text", "\n"),
                    lambda x, i: F.coalesce(F.substring(F.col("__m"), i + 1, F.lit(1)), F.lit(b"")) != F.lit(b"1"))
    n_lines = F.char_length("__text") - F.char_length(F.replace(F.col("__text"), F.lit("\n"), F.lit(""))) + 1
    return both.select(
        *plain.columns, F.when(F.col("__m").isNull(), F.col("__text")).otherwise(F.array_join(kept, "\n")).alias("__new"),
        n_lines.cast("long").alias("__n"), F.coalesce("__k", F.lit(0)).cast("long").alias("__k"))


def line_report(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 2, min_chars: int = 10
) -> DataFrame:
    """(id, text, n_lines, n_dropped) of every row: the text that is kept, its lines before, and how many went.

    A line's key is the line without ASCII white space at its ends, with A-Z lower-cased. Keys of at least min_chars
    characters that occur in at least min_docs documents lose all their lines outside the smallest id that holds them.

    A null or empty text is one empty line and gives an empty text. Rows that share an id count as one document, each is
    shortened by itself, and repeated rows stay repeated. A null id is one more document that never is the first. When
    all lines go, the text is empty. An empty table gives an empty table; further columns are not returned.
    """
    own_id = f"c{docs.columns.index(id_col)}"
    return _shortened(docs, id_col, text_col, min_docs, min_chars).select(
        F.col(own_id).alias(id_col), F.col("__new").alias("text"), F.col("__n").alias("n_lines"), F.col("__k").alias("n_dropped"))


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 2, min_chars: int = 10
) -> DataFrame:
    """The rows and columns of docs, with the texts that line_report keeps; null texts become empty."""
    short = _shortened(docs, id_col, text_col, min_docs, min_chars)
    return short.select(*[F.col("__new" if c == text_col else f"c{i}").alias(c) for i, c in enumerate(docs.columns)])
