"""Toxicity by non-negative positive-unlabelled learning: confirmed toxic texts against texts without labels.

Some of the unlabelled texts are toxic too, so they are no negative examples. With the share p of toxic texts (the class
prior) the risk of a classifier on clean texts is its risk on unlabelled texts less p times that on toxic ones, both taken as if
they were clean. That difference cannot be negative for a true share; where a minibatch makes it so, the classifier has begun to
learn the unlabelled texts by heart, and the step goes the other way.

The classifiers are logistic over words and beginnings of words that occur once or more often, fitted with numpy on the driver on
a bounded sample (CONFIRMED, UNLABELLED, FEATURES) whose words the executors hash. A feature takes part once its slope in the risk
is beyond chance and most texts that have it are toxic by estimate. No weight is negative, so clean text around a toxic passage
cannot outweigh it. The mean of the classifiers is one short list of weights; scoring is one pass over all texts.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import BinaryType, StructField, StructType
from xxhash import xxh64_intdigest

from cohort.llm.common import Memo, map_texts, named, once, pieces, texts_of, utf8
from cohort.session import written

CONFIRMED = 3_000       # confirmed texts of the sample, at most
UNLABELLED = 6_000      # unlabelled texts of the sample, at most
FEATURES = 1 << 23      # the sample ends at so many features of its texts together
CUT = 0.5
MEMBERS = 3             # classifiers whose mean is taken
ROUNDS = 3              # times that features are chosen and the classifiers fitted
EPOCHS = 100
BATCH = 64              # confirmed texts of a minibatch, with a like share of the unlabelled ones
RATE = 1.0
LEAST = 3               # texts of the sample that hold a feature which may get a weight
SURE = 2.5              # deviations from chance that a feature's slope needs
LIKELY = 0.5            # share of toxic texts, by estimate, among those with a feature that may get a weight
STEMS = range(3, 8)     # characters of a word's beginnings, the whole word left out
TIMES = (1, 2, 4)       # a feature for each number of times that a word or beginning occurs at least
MARKS = b".,;:!?\"'()[]{}<>*_-~#%&$|/\\"


def _places(word: bytes) -> list[int]:
    """64-bit hashes of a word without marks around it, A-Z in lower case, and of its beginnings; the last two bits are free."""
    bare = word.strip(MARKS).lower()
    letters = bare.decode()
    names = [b"=" + bare, *[b"^" + letters[:k].encode() for k in STEMS if k < len(letters)]]
    return [xxh64_intdigest(n) & ~3 for n in names] if bare else []


def features(texts: list[bytes]) -> list[np.ndarray]:
    """For each text the sorted numbers of what its words show: a place, with the last two bits telling the TIMES it occurs."""
    split = [t.split() for t in texts]
    code = once("toxic places", lambda: Memo(lambda words: [np.array(_places(w), np.uint64) for w in words])).codes(split)
    out = []
    for words in split:
        places, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *map(code, words)]), return_counts=True)
        out.append(np.sort(np.concatenate([places[n >= times] | np.uint64(k) for k, times in enumerate(TIMES)])))
    return out


def _sums(weights: np.ndarray, words: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """The summed weights of the words of each text; edges are the texts' ends among the words."""
    return np.diff(np.concatenate([[0.0], np.cumsum(weights[words])])[edges])


def risk(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> tuple[float, float, np.ndarray, np.ndarray]:
    """The risk on toxic texts and that on clean texts, from logits, and the gradients by the logits for the step to take.

    Logistic loss. The second risk is an estimate that may come out negative; then the gradients are those that raise it.
    """
    soft = lambda z: np.logaddexp(0, z)
    half = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    toxic = prior * soft(-positive).mean()
    clean = soft(unlabelled).mean() - prior * soft(positive).mean()
    up = half(unlabelled) / len(unlabelled)
    if clean < 0:
        return toxic, clean, prior * half(positive) / len(positive), -up
    # the loss of a toxic text as toxic less its loss as clean is minus its logit
    return toxic, clean, np.full(len(positive), -prior / len(positive)), up


@dataclass
class Texts:
    """Word places of several texts in a row."""

    words: np.ndarray
    edges: np.ndarray     # text i has words[edges[i]:edges[i + 1]]

    @classmethod
    def of(cls, texts: list[np.ndarray]) -> Texts:
        return cls(np.concatenate([np.zeros(0, np.int64), *texts]), np.cumsum([0, *map(len, texts)]))

    def __len__(self):
        return len(self.edges) - 1

    def shares(self, size: int) -> np.ndarray:
        """The share of the texts that hold each word."""
        return np.bincount(self.words, minlength=size) / max(1, len(self))

    def only(self, chosen: np.ndarray) -> Texts:
        """The chosen words, numbered in their order."""
        number = np.cumsum(chosen) - 1
        kept = chosen[self.words]
        return Texts(number[self.words[kept]], np.concatenate([[0], np.cumsum(kept)])[self.edges])

    def some(self, which: np.ndarray) -> Texts:
        return Texts.of([self.words[self.edges[i]:self.edges[i + 1]] for i in which])

    def slopes(self, by_logit: np.ndarray, size: int) -> np.ndarray:
        return np.bincount(self.words, np.repeat(by_logit, np.diff(self.edges)), minlength=size)


@dataclass
class Model:
    """The logit of a text is the bias and the weights of its features."""

    bias: float
    hashes: np.ndarray
    weights: np.ndarray

    def score(self, texts: list[bytes], memo: Memo | None = None) -> np.ndarray:
        """Probabilities of label 1. Only places with a weight are counted; of most words there are none."""
        weight = dict(zip(self.hashes.tolist(), self.weights.tolist()))
        split = [t.split() for t in texts]
        code = (memo or self.memo()).codes(split)
        z = []
        for words in split:
            n = Counter(chain.from_iterable(map(code, words)))
            z.append(self.bias + sum(weight.get(place | k, 0.0) for place in sorted(n) for k, times in enumerate(TIMES) if n[place] >= times))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def memo(self) -> Memo:
        """word -> its places that have a weight."""
        used = {h & ~3 for h in self.hashes.tolist()}
        return Memo(lambda words: [tuple(used.intersection(_places(w))) for w in words])


def _descend(positive: Texts, unlabelled: Texts, size: int, prior: float, seed: list[int]) -> tuple[float, np.ndarray]:
    """A classifier over so many words: minibatch steps down the non-negative risk, sized by Adagrad."""
    rng = np.random.default_rng(seed)
    bias, weights, seen, seen_bias = math.log(prior / (1 - prior)), np.zeros(size), np.full(size, 1e-8), 1e-8
    steps = max(1, len(positive) // BATCH)
    for _ in range(EPOCHS):
        orders = [np.array_split(rng.permutation(len(t)), steps) for t in (positive, unlabelled)]
        for own, others in zip(*orders):
            if not len(own) or not len(others):
                continue
            p, u = positive.some(own), unlabelled.some(others)
            *_, gp, gu = risk(bias + _sums(weights, p.words, p.edges), bias + _sums(weights, u.words, u.edges), prior)
            slope = p.slopes(gp, size) + u.slopes(gu, size)
            along = gp.sum() + gu.sum()
            seen += slope ** 2
            seen_bias += along ** 2
            weights = np.maximum(0, weights - RATE * slope / np.sqrt(seen))
            bias -= RATE * along / math.sqrt(seen_bias)
    return bias, weights


def _numbered(words: np.ndarray, sizes: np.ndarray, hashes: np.ndarray) -> Texts:
    """Texts of so many features each, as numbers of those in hashes (sorted); a million at a time, as they are many."""
    places, kept = [], []
    for start in range(0, len(words), 1 << 20):
        some = words[start:start + (1 << 20)]
        at = np.minimum(np.searchsorted(hashes, some), max(0, len(hashes) - 1)).astype(np.int32)
        known = hashes[at] == some if len(hashes) else np.zeros(len(some), bool)
        places.append(at[known])
        kept.append(known)
    kept = np.concatenate([np.zeros(0, bool), *kept])
    return Texts(np.concatenate([np.zeros(0, np.int32), *places]), np.concatenate([[0], np.cumsum(kept)])[np.cumsum([0, *sizes])])


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, seed: int = 11) -> Model:
    """The mean of MEMBERS classifiers, from features(texts). Without examples of one kind the prior is all that is known."""
    none = np.zeros(0, np.uint64)
    return _fit(*[(np.concatenate([none, *t]), np.array([len(x) for x in t], np.int64)) for t in (positive, unlabelled)], prior, seed)


def _fit(positive: tuple[np.ndarray, np.ndarray], unlabelled: tuple[np.ndarray, np.ndarray], prior: float, seed: int = 11) -> Model:
    """fit for texts that are given as all their features and their sizes."""
    prior = min(max(prior, 1e-3), 1 - 1e-3)
    model = Model(math.log(prior / (1 - prior)), np.zeros(0, np.uint64), np.zeros(0))
    if not len(positive[1]) or not len(unlabelled[1]):
        return model
    hashes, held = np.unique(np.concatenate([positive[0], unlabelled[0]]), return_counts=True)
    hashes = hashes[held >= LEAST]
    size = len(hashes)
    p, u = _numbered(*positive, hashes), _numbered(*unlabelled, hashes)
    share = np.maximum(u.shares(size), 1 / len(u))
    chance = prior * SURE * (np.sqrt(share * (1 - share) / len(p)) + 1 / len(p))
    chosen, bias, weights = np.zeros(size, bool), model.bias, np.zeros(size)
    for _ in range(ROUNDS):
        *_, gp, gu = risk(bias + _sums(weights, p.words, p.edges), bias + _sums(weights, u.words, u.edges), prior)
        gain, cost = -p.slopes(gp, size), u.slopes(gu, size)
        more = (gain - cost > chance) & (prior * gain > LIKELY * cost)
        if not (more & ~chosen).any():
            break
        chosen |= more
        members = [_descend(p.only(chosen), u.only(chosen), int(chosen.sum()), prior, [seed, k]) for k in range(MEMBERS)]
        bias = float(np.mean([b for b, _ in members]))
        weights[chosen] = np.mean([w for _, w in members], axis=0)
    return Model(bias, hashes[chosen], weights[chosen])


# Spark ---------------------------------------------------------------------------------------------------------------

def held_out(id_col: str = "doc_id", parts: int = 5, part: int = 0) -> Column:
    """Whether crc32 of the id as text falls into the part that is kept from learning; a null id does not."""
    return F.coalesce(F.crc32(named(id_col).cast("string")) % parts == part, F.lit(False))


def _sampled(texts: DataFrame, ids: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """All features, and how many of them each has, of one text for each of at most so many ids, in the order of a hash; of rows with one id the least text counts."""
    chosen = F.broadcast(ids.distinct().orderBy(F.xxhash64("id"), "id").limit(most))
    rows = texts.join(chosen, "id").groupBy("id").agg(F.min("text").alias("text"))

    def describe(batches):
        for batch in batches:
            for part in pieces(batch, "text"):
                words = [w.astype("<u8").tobytes() for w in features(utf8(part.column("text")))]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(words, pa.binary())], names=["id", "words"])

    made = rows.mapInArrow(describe, StructType([rows.schema["id"], StructField("words", BinaryType())]))
    # at most `most` rows, so their order needs no more than one task
    order = Window.orderBy(F.xxhash64("id"), "id")
    held = F.sum(F.length("words") / 8).over(order)
    kept = written(made, "sample").withColumn("held", held).where(F.col("held") <= FEATURES).orderBy(F.xxhash64("id"), "id")
    found = kept.select("words").toArrow().column("words").combine_chunks()
    sizes = np.array(pc.binary_length(found).to_pylist(), np.int64) // 8
    data = np.frombuffer(found.buffers()[2] or b"", "<u8") if len(found) else np.zeros(0, np.uint64)
    return data[:int(sizes.sum())], sizes


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic",
          prior: float | None = None, confirmed: int = CONFIRMED, unlabelled: int = UNLABELLED) -> Model:
    """A classifier from the labels 1 and from documents of which no label is read.

    The class prior is the share of ids with label 1 among those with a label, unless it is given. Ids with both labels count as 1; null
    ids and labels, and ids without a document, are left out.
    """
    marked = labels.select(named(id_col).alias("id"), (named(label).cast("int") == 1).alias("toxic")).dropna().groupBy("id").agg(
        F.bool_or("toxic").alias("toxic"))
    n, hits = marked.agg(F.count("*"), F.count_if("toxic")).first()
    texts = texts_of(docs, id_col, text_col).where("id IS NOT NULL")
    return _fit(_sampled(texts, marked.where("toxic").select("id"), confirmed), _sampled(texts, texts.select("id"), unlabelled),
                prior if prior is not None else hits / max(1, n))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row: the probability of a toxic text. Null texts count as empty, whole texts are read; repeated rows stay
    repeated, null ids have rows too, other columns are not read, an empty table gives an empty table."""
    sent = docs.sparkSession.sparkContext.broadcast((model.bias, model.hashes, model.weights))

    key = f"toxic {zlib.crc32(model.hashes.tobytes() + model.weights.tobytes())}"

    def measure(texts):
        own = Model(*sent.value)
        return [pa.array(own.score(texts, once(key, own.memo)), pa.float64())]

    return map_texts(docs, id_col, text_col, measure, "score double")


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic",
             prior: float | None = None, confirmed: int = CONFIRMED, unlabelled: int = UNLABELLED, cut: float = CUT) -> DataFrame:
    """(id, held_out, score, predicted) of every row; labels and texts of the held-out part teach nothing."""
    model = train(docs.where(~held_out(id_col)), labels.where(~held_out(id_col)), id_col, text_col, label, prior, confirmed, unlabelled)
    scored = score(docs, model, id_col, text_col)
    return scored.select(named(id_col), held_out(id_col).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))
