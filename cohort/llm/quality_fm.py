"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

The pairwise weight of two features is the product of their factor vectors. A text is scored in time linear in its
features, as the sum over all pairs is half of the squared sum less the sum of squares, factor by factor.

The model is fitted on the driver from a bounded number of labelled rows (SAMPLE, by the order of a hash of their ids), whose
features are computed by the executors; scoring is one pass over all texts.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, IntegerType, StructField, StructType

from cohort.llm.common import Memo, named, once, pieces, utf8

SAMPLE = 8_000      # labelled rows that the model is fitted on, at most
WORDS = 1 << 16     # hashed words
FACTORS = 8
EPOCHS = 6
CUT = 0.7
SYMBOLS = re.compile(rb"[#*$%&|<>~^={}\[\]\\@_+]")
STATISTICS = ("words length upper digits marks symbols wide distinct repeated lines same_lines longest loud ended "
              "marked_words").split()


def statistics(text: bytes, words: list[bytes]) -> list[float]:
    """Shares and sizes of a whole text, all finite; an empty text has zeros."""
    n, size = len(words), max(1, len(text))
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    lines = [x for x in text.split(b"\n") if x.strip()]
    marks = int(counts[0x21:0x30].sum() + counts[0x3A:0x41].sum() + counts[0x5B:0x61].sum() + counts[0x7B:0x7F].sum())
    per_word = 1 / max(1, n)
    return [
        math.log1p(n), math.log1p(sum(map(len, words)) * per_word), counts[0x41:0x5B].sum() / size, counts[0x30:0x3A].sum() / size,
        marks / size, len(SYMBOLS.findall(text)) / size, counts[0xC0:].sum() / size, len(set(words)) * per_word,
        sum(map(bytes.__eq__, words, words[1:])) * per_word, math.log1p(len(lines)), 1 - len(set(lines)) / max(1, len(lines)),
        math.log1p(max(map(len, words), default=0)), text.count(b"!") * per_word, (text.count(b".") + text.count(b"?")) * per_word,
        sum(not w[-1:].isalnum() and w[-1] < 0x80 for w in words) * per_word,
    ]


def _codes() -> Memo:
    return once("quality words", lambda: Memo(lambda ws: [zlib.crc32(w.lower()) % WORDS for w in ws]))


def features(texts: list[bytes]) -> list[tuple[np.ndarray, list[float]]]:
    """For each text the places of its hashed words, each once, and its statistics."""
    split = [t.split() for t in texts]
    code = _codes().codes(split)
    return [(np.array(sorted(set(map(code, words))), np.int64), statistics(t, words)) for t, words in zip(texts, split)]


@dataclass
class Machine:
    """Weights, factors and the scaling of the dense features."""

    bias: float
    weights: np.ndarray    # (WORDS + dense,)
    factors: np.ndarray    # (WORDS + dense, FACTORS)
    mean: np.ndarray
    scale: np.ndarray

    def dense(self, rows: np.ndarray) -> np.ndarray:
        """Standardised within three deviations; a missing value is the mean."""
        return np.clip(np.nan_to_num((rows - self.mean) / self.scale), -3, 3)

    def score(self, found: list[tuple[np.ndarray, list[float]]]) -> np.ndarray:
        """Probabilities of label 1."""
        if not found:
            return np.zeros(0)
        d = self.dense(np.array([s for _, s in found], float))
        own_w, own_v = self.weights[WORDS:], self.factors[WORDS:]
        linear, sums, squares = self.bias + d @ own_w, d @ own_v, (d * d) @ (own_v * own_v)
        for i, (words, _) in enumerate(found):
            if len(words):
                x, v = 1 / math.sqrt(len(words)), self.factors[words]
                linear[i] += x * self.weights[words].sum()
                sums[i] += x * v.sum(axis=0)
                squares[i] += x * x * np.einsum("ij,ij->j", v, v)
        z = linear + 0.5 * (sums * sums - squares).sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(found: list[tuple[np.ndarray, list[float]]], labels: Sequence[int], seed: int = 7) -> Machine:
    """Logistic loss, minibatches, step sizes by Adagrad. Without rows, a machine that scores one half."""
    n_dense = len(found[0][1]) if found else len(STATISTICS)
    rows = np.array([s for _, s in found], float).reshape(len(found), n_dense)
    present = ~np.isnan(rows)
    mean = np.where(present, rows, 0).sum(axis=0) / np.maximum(1, present.sum(axis=0))
    scale = np.sqrt((np.where(present, rows - mean, 0) ** 2).sum(axis=0) / np.maximum(1, present.sum(axis=0)))
    rng = np.random.default_rng(seed)
    size = WORDS + n_dense
    m = Machine(0.0, np.zeros(size), rng.normal(0, 0.05, (size, FACTORS)), mean, np.where(scale > 1e-9, scale, 1.0))
    if not found:
        m.factors[:] = 0
        return m
    y, dense = np.asarray(labels, float), m.dense(rows)
    share = min(max(y.mean(), 0.01), 0.99)
    m.bias = math.log(share / (1 - share))
    seen_w, seen_v, seen_b = np.full(size, 1e-6), np.full((size, FACTORS), 1e-6), 1e-6
    everywhere = np.arange(WORDS, size)
    for _ in range(EPOCHS):
        order = rng.permutation(len(found))
        for start in range(0, len(order), 64):
            batch = order[start:start + 64]
            words = [np.concatenate([found[i][0], everywhere]) for i in batch]
            values = [np.concatenate([np.full(len(found[i][0]), 1 / math.sqrt(max(1, len(found[i][0])))), dense[i]]) for i in batch]
            sizes = [len(w) for w in words]
            at, x = np.concatenate(words), np.concatenate(values)
            edge = np.cumsum([0, *sizes[:-1]])
            v = m.factors[at] * x[:, None]
            sums = np.add.reduceat(v, edge)
            z = m.bias + np.add.reduceat(m.weights[at] * x, edge) + 0.5 * (sums ** 2 - np.add.reduceat(v * v, edge)).sum(axis=1)
            wrong = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[batch]) / len(batch)
            g = np.repeat(wrong, sizes) * x
            place, inverse = np.unique(at, return_inverse=True)
            gw = np.bincount(inverse, g) + 1e-6 * m.weights[place]
            full = g[:, None] * (np.repeat(sums, sizes, axis=0) - v)
            gv = np.stack([np.bincount(inverse, full[:, f]) for f in range(FACTORS)], axis=1) + 1e-5 * m.factors[place]
            seen_w[place] += gw ** 2
            seen_v[place] += gv ** 2
            seen_b += wrong.sum() ** 2
            m.weights[place] -= 0.3 * gw / np.sqrt(seen_w[place])
            m.factors[place] -= 0.05 * gv / np.sqrt(seen_v[place])
            m.bias -= 0.1 * wrong.sum() / math.sqrt(seen_b)
    return m


def _extra(metadata: Sequence[str]) -> Column:
    return F.array(*[named(c).cast("double") for c in metadata]).cast("array<double>")


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "quality",
          metadata: Sequence[str] = (), sample: int = SAMPLE) -> Machine:
    """A machine fitted on labelled documents, at most sample of them. Labels are 0 or 1; null labels and ids are left out.

    Rows of one id with different labels count as label 1. An id without a document gives no row.
    """
    marked = labels.select(named(id_col).alias("id"), named(label).cast("int").alias("y")).dropna().groupBy("id").agg(F.max("y").alias("y"))
    chosen = F.broadcast(marked.orderBy(F.xxhash64("id"), "id").limit(sample))
    texts = docs.select(named(id_col).alias("id"), named(text_col).cast("string").alias("text"), _extra(metadata).alias("extra"))
    rows = texts.join(chosen, "id")

    def describe(batches):
        for batch in batches:
            for part in pieces(batch, "text"):
                found = _with_extra(part)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("y"), pa.array([w.astype("<u4").tobytes() for w, _ in found], pa.binary()),
                     pa.array([s for _, s in found], pa.list_(pa.float64()))], names=["id", "y", "words", "dense"])

    schema = StructType([StructField("id", docs.schema[id_col].dataType), StructField("y", IntegerType()),
                         StructField("words", BinaryType()), StructField("dense", ArrayType(DoubleType()))])
    got = rows.mapInArrow(describe, schema).collect()
    got.sort(key=lambda r: (zlib.crc32(str(r["id"]).encode()), str(r["id"]), bytes(r["words"])))
    return fit([(np.frombuffer(bytes(r["words"]), "<u4").astype(np.int64), list(r["dense"])) for r in got], [r["y"] for r in got])


def _with_extra(part: pa.RecordBatch) -> list[tuple[np.ndarray, list[float]]]:
    """Features of the texts of a batch, with its metadata on a log scale."""
    extra = [[math.nan if v is None else math.copysign(math.log1p(abs(v)), v) for v in row] for row in part.column("extra").to_pylist()]
    return [(w, s + e) for (w, s), e in zip(features(utf8(part.column("text"))), extra)]


def score(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text", metadata: Sequence[str] = ()) -> DataFrame:
    """(id, score) of every row: the probability of label 1, for whole texts; null texts count as empty.

    Missing metadata count as their mean. Repeated rows stay repeated, null ids have rows too, an empty table gives an
    empty table; columns other than id, text and metadata are not read.
    """
    model = docs.sparkSession.sparkContext.broadcast(
        (machine.bias, machine.weights, machine.factors, machine.mean, machine.scale))
    schema = StructType([StructField(id_col, docs.schema[id_col].dataType), StructField("score", DoubleType())])

    def run(batches):
        own = Machine(*model.value)
        for batch in batches:
            for part in pieces(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(own.score(_with_extra(part)), pa.float64())], names=schema.names)

    texts = docs.select(named(id_col).alias("id"), named(text_col).cast("string").alias("text"), _extra(metadata).alias("extra"))
    return texts.mapInArrow(run, schema)


def held_out(id_col: str = "doc_id", parts: int = 4, part: int = 2) -> Column:
    """Whether crc32 of the id as text falls into the part that is kept from learning; a null id does not."""
    return F.coalesce(F.crc32(named(id_col).cast("string")) % parts == part, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "quality",
             metadata: Sequence[str] = ("n_chars",), sample: int = SAMPLE, cut: float = CUT) -> DataFrame:
    """(id, held_out, score, predicted) of every row, by a machine that learns from labels outside the held-out part only."""
    machine = train(docs, labels.where(~held_out(id_col)), id_col, text_col, label, metadata, sample)
    scored = score(docs, machine, id_col, text_col, metadata)
    return scored.select(named(id_col), held_out(id_col).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))
