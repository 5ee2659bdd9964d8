"""Near-duplicate groups by SimHash fingerprints and multi-index hashing.

Fingerprints are computed where the texts are; only (id, fingerprint) goes on. Linking works on distinct fingerprints, so
groups of exact copies cost one row. A fingerprint is stored once under each of its two 32-bit halves; as at most
3 bits differ, one half differs in at most 1, so each fingerprint looks up the ball of radius 1 around its
halves (66 keys), and complete distances are checked on what it finds. Links become components by star rounds.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F
from xxhash import xxh64_intdigest

from cohort.llm.common import components, map_texts, named
from cohort.session import written

SEED = 42
BLOCK = 1 << 16   # shingles that are counted at once


def fingerprint(text: bytes, words_in_shingle: int = 3) -> int:
    """64 bits, as a signed number: a bit is set when more than half of the shingles' XXH64 hashes have it; no words: 0."""
    words = text.lower().split()
    if not words:
        return 0
    k = min(words_in_shingle, len(words))
    n = len(words) - k + 1
    counts = np.zeros(64, np.int64)
    for start in range(0, n, BLOCK):
        stop = min(n, start + BLOCK)
        parts = [words[start + i:stop + i] for i in range(k)]
        hashes = np.array([xxh64_intdigest(b" ".join(s), SEED) for s in zip(*parts)], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(counts * 2 > n, bitorder="little")
    return int.from_bytes(bits.tobytes(), "little", signed=True)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(id, fp): the fingerprint of every whole text. A null text counts as empty."""
    return map_texts(docs, id_col, text_col, lambda texts: ([fingerprint(t, words) for t in texts],), "fp long")


def links(fps: DataFrame, distance: int = 3) -> DataFrame:
    """(u, v), u < v: all pairs of different fingerprints with at most so many differing bits (3 at most)."""
    if not 0 <= distance <= 3:
        raise ValueError("two segments and balls of radius 1 find distances up to 3")
    halves = F.array(F.struct(F.lit(0).alias("seg"), F.shiftrightunsigned("fp", 32).alias("half")),
                     F.struct(F.lit(1).alias("seg"), F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)).alias("half")))
    stored = fps.select("fp", F.inline(halves)).select("seg", F.col("half").alias("key"), F.col("fp").alias("v"))
    ball = F.array(F.lit(0).cast("long"), *[F.lit(1 << i).cast("long") for i in range(32)])
    asked = fps.select("fp", F.inline(halves)).select("seg", F.col("fp").alias("u"), "half", F.explode(ball).alias("flip"))
    asked = asked.select("seg", F.col("half").bitwiseXOR(F.col("flip")).alias("key"), "u")
    # Spark takes the exploded side for as small as what it comes from, and would send it to all tasks
    found = stored.join(asked.hint("merge"), ["seg", "key"]).where(
        (F.col("u") < F.col("v")) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= distance))
    return found.select("u", "v").distinct()


def _groups(docs: DataFrame, id_col: str, text_col: str, distance: int, words: int) -> DataFrame:
    """(key, fp, component_id) of every row; key is its id and a hash of its text."""
    keyed = docs.select(F.struct(named(id_col).alias("id"), F.xxhash64(named(text_col)).alias("h")).alias("key"), named(text_col).alias("text"))
    # texts are hashed once; the rounds below read a few numbers for each row
    prints = written(fingerprints(keyed, "key", "text", words), "prints")
    firsts = written(prints.groupBy("fp").agg(F.min("key.id").alias("first")), "firsts")
    roots = components(links(firsts.select("fp"), distance)).withColumnRenamed("node", "fp")
    joined = roots.join(firsts, "fp")
    smallest = joined.groupBy("root").agg(F.min("first").alias("component_id"))
    linked = joined.join(smallest, "root").select("fp", "component_id")
    # a table, so that AQE can split a fingerprint of many documents in the last join
    groups = written(firsts.join(linked, "fp", "left").select(
        "fp", F.coalesce("component_id", "first").alias("component_id")), "groups")
    return prints.join(groups, "fp")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = 3, words: int = 3
) -> DataFrame:
    """(id, fingerprint, component_id) of every row: 16 hex digits, and the smallest id that links reach.

    Null and empty texts, and texts of white space, have fingerprint zero and are linked like any other. Shorter texts
    than a shingle are one shingle, texts of any length are hashed whole, block by block. Repeated rows stay repeated. A null id has
    a row too and never is a component's id, unless no row of the component has one: then it is null. An empty table gives an
    empty table. Other columns are not read.
    """
    return _groups(docs, id_col, text_col, distance, words).select(
        F.col("key.id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = 3, words: int = 3) -> DataFrame:
    """The rows of docs, with all their columns, whose group holds no smaller id; rows without an id stay.

    Rows are told apart by id and text: of rows that share an id, only those go whose own text is in a group with a smaller id. Exact
    repeats of a row that stays all stay. Nulls, empty and very long texts are treated as in near_duplicates.
    """
    gone = _groups(docs, id_col, text_col, distance, words).where("key.id <> component_id").select(
        F.col("key.id").alias("gone"), F.col("key.h").alias("gone_h")).distinct()
    names = [f"c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names)
    own_id, text = (F.col(names[docs.columns.index(c)]) for c in (id_col, text_col))
    return plain.join(gone, (own_id == F.col("gone")) & (F.xxhash64(text) == F.col("gone_h")), "left_anti").toDF(*docs.columns)
