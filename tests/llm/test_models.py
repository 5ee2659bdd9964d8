"""The factorisation machine and the mixing model: identities, held-out accuracy, brute force for the base model."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from cohort.llm import context_mixing as M, quality_fm as Q
from tests.llm.cases import as_bag, docs, empty, rows


def held(i, parts, part):
    return i is not None and zlib.crc32(str(i).encode()) % parts == part


# Factorisation machine -----------------------------------------------------------------------------------------------

def test_linear_time_form_is_the_sum_over_pairs():
    rng = np.random.default_rng(1)
    n = len(Q.STATISTICS)
    m = Q.Machine(0.3, rng.normal(size=Q.WORDS + n), rng.normal(size=(Q.WORDS + n, Q.FACTORS)) * 0.1, np.zeros(n), np.ones(n))
    words, stats = np.array([3, 70, 500, 9000]), rng.normal(size=n)
    x = {**{int(w): 0.5 for w in words}, **{Q.WORDS + j: min(3, max(-3, v)) for j, v in enumerate(stats)}}
    z = m.bias + sum(m.weights[i] * v for i, v in x.items())
    places = list(x)
    z += sum(x[a] * x[b] * float(m.factors[a] @ m.factors[b]) for k, a in enumerate(places) for b in places[:k])
    assert m.score([(words, list(stats))])[0] == pytest.approx(1 / (1 + math.exp(-z)))


def test_pairs_are_learned():
    """Label 1 when both or none of two words occur: no linear model can tell."""
    rng = random.Random(3)
    found, labels = [], []
    for _ in range(1500):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        found.append((np.array(sorted([1] * a + [2] * b + [10 + rng.randint(0, 3)])), [0.0] * len(Q.STATISTICS)))
        labels.append(int(a == b))
    m = Q.fit(found[:1000], labels[:1000])
    right = (m.score(found[1000:]) > 0.5) == np.array(labels[1000:])
    assert right.mean() > 0.9


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    d, marks = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    got = {r["doc_id"]: r for r in Q.classify(d, marks).collect()}
    assert len(got) == d.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got.values())
    assert all(r["held_out"] == held(i, 4, 2) for i, r in got.items())
    pairs = [(got[r["doc_id"]]["score"], r["quality"]) for r in marks.collect() if held(r["doc_id"], 4, 2)]
    good, bad = [s for s, y in pairs if y == 1], [s for s, y in pairs if y == 0]
    assert np.mean([(a > b) + 0.5 * (a == b) for a in good for b in bad]) > 0.95


def test_labels_of_the_held_out_part_change_nothing(spark):
    from pyspark.sql import functions as F

    folder = "/root/testdata/sf0.001"
    d, marks = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    turned = marks.withColumn("quality", F.when(Q.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert as_bag(map(tuple, Q.classify(d, marks).collect())) == as_bag(map(tuple, Q.classify(d, turned).collect()))


def test_classifier_edge_cases(spark):
    marks = spark.createDataFrame([(1, 1), (2, 0), (3, None), (None, 1), (999, 1), (5, 1), (5, 0), (9, 0)], "doc_id long, quality int")
    got = Q.classify(docs(spark), marks, metadata=["pos", "fp"]).collect()
    assert as_bag(r["doc_id"] for r in got) == as_bag(i for i, *_ in rows()) and all(math.isfinite(r["score"]) for r in got)
    assert Q.classify(empty(spark), marks, metadata=["pos"]).count() == 0
    none = Q.classify(docs(spark), marks.limit(0), metadata=()).collect()
    assert {r["score"] for r in none} == {0.5}


# Context mixing ------------------------------------------------------------------------------------------------------

def brute_base(table):
    words = {k: M.words_of((t or "").encode()) for k, (_, t, *_) in enumerate(table)}
    train = [k for k, r in enumerate(table) if not held(r[0], 7, 2)]
    counts = Counter(w for k in train for w in [*words[k], None])
    total, distinct = sum(counts.values()), len(counts)
    return [(r[0], held(r[0], 7, 2), len(words[k]) + 1, sum(counts[w] > 0 for w in [*words[k], None]), total,
             round(sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in [*words[k], None]), 6)) for k, r in enumerate(table)]


@pytest.mark.parametrize("heavy", [0, 5, 10 ** 6])
def test_base_model_against_brute_force(spark, heavy):
    got = M.score(docs(spark), heavy=heavy).collect()
    assert as_bag((*tuple(r)[:5], round(r["base_score"], 6)) for r in got) == as_bag(brute_base(rows()))
    assert all(r["score"] < 0 and r["bits_per_byte"] > 0 for r in got)


def slow_cost(tables, text, weights):
    """Bit by bit, with the weights refined after each block."""
    data = b"\0" * M.BACK + text + bytes([M.END])
    w, total = weights.astype(np.float64) * M.SCALE, 0.0
    n = len(text) + 1
    block = M.BLOCK << max(0, (n - 1).bit_length() - 15)
    for start in range(0, n, block):
        stop, change = min(n, start + block), np.zeros_like(w)
        for p in range(start, stop):
            key = np.array([sum(int(data[p + M.BACK - k]) << 8 * k for k in range(M.BACK + 1))], np.uint64)
            at, node = [int(r[0]) for r in M.contexts(key)], 1
            for d in range(8):
                bit = data[p + M.BACK] >> (7 - d) & 1
                x = np.array([float(t[a + node]) for t, a in zip(tables, at)])
                z = max(-15.0, min(15.0, float(w[d] @ x)))
                p1 = 1 / (1 + math.exp(-z))
                total -= math.log(p1 if bit else 1 - p1)
                change[d] += (bit - p1) * x
                node = node * 2 + bit
        w += change * M.RATE * M.SCALE / (stop - start) * min((stop - start) / M.BLOCK, 1)
    return total


def test_cost_against_bit_by_bit():
    texts = [(t or "").encode().lower() for _, t, *_ in rows()][:12] + [b"", "é日".encode()]
    counts = [np.zeros(n, np.uint32) for n in M.TABLES]
    M.count(counts, texts[:8])
    tables = [M.predictions(c) for c in counts]
    weights = np.tile(np.array(M.START, np.float32), (8, 1))
    got, _ = M.cost(tables, texts, weights)
    for t, c in list(zip(texts, got))[::3]:
        assert c == pytest.approx(slow_cost(tables, t, weights), rel=2e-4)
    alone, _ = M.cost(tables, texts[3:4], weights)
    assert alone[0] == got[3]


def test_counts_are_those_of_the_contexts():
    text = b"abab abab"
    counts = [np.zeros(n, np.uint32) for n in M.TABLES]
    M.count(counts, [text, text])
    assert all(int(c.sum()) == 2 * (len(text) + 1) for c in counts)
    key = np.array([ord("b") | ord("a") << 8 | ord("b") << 16 | ord("a") << 24 | ord(" ") << 32], np.uint64)
    row = int(M.contexts(key)[0][0])
    assert counts[0][row + ord("b")] == 4   # "aba" comes twice in each text, and "b" follows each time


def test_chances_of_all_texts_sum_to_one():
    """Over one byte: the chances of the 256 values that can follow add up to one."""
    counts = [np.zeros(n, np.uint32) for n in M.TABLES]
    M.count(counts, [b"the cat sat on the mat"])
    tables = [M.predictions(c) for c in counts]
    inputs = M._inputs(tables, np.array([b | ord("a") << 8 | ord("c") << 16 for b in range(256)], np.uint64)).astype(float)
    z = (inputs * np.array(M.START) * M.SCALE).sum(axis=2)
    assert (1 / (1 + np.exp(-M.SIGNS * z))).prod(axis=1).sum() == pytest.approx(1)


def test_tree_of_sums(spark, monkeypatch):
    monkeypatch.setattr(M, "FAN", 2)
    few = M.score(docs(spark).repartition(7)).collect()
    monkeypatch.undo()
    assert as_bag((r["doc_id"], round(r["score"], 3)) for r in few) == as_bag((r["doc_id"], round(r["score"], 3)) for r in M.score(docs(spark)).collect())


def test_mixing_edge_cases(spark):
    from pyspark.sql import functions as F

    assert M.score(empty(spark)).count() == 0
    none = M.score(docs(spark), held=F.lit(True)).collect()
    assert {r["train_tokens"] for r in none} == {0} and {r["n_known"] for r in none} == {0}
    assert all(r["bits_per_byte"] == pytest.approx(8) for r in none)


def test_more_text_is_learned_from(spark):
    folder = "/root/testdata/sf0.01"
    d = spark.read.parquet(f"{folder}/documents.parquet")
    got = M.score(d).where("held_out").collect()
    assert sum(r["bits_per_byte"] for r in got) / len(got) < 2.6




def test_all_contexts_are_counted():
    assert M.ORDERS == (3, 4, 5, 7) and M.BACK == 7 and len(M.BITS) == len(M.START) == 5
    # seven bytes of a word tell apart what six do not
    keys = [np.array([sum(b << 8 * k for k, b in enumerate(t[::-1]))], np.uint64) for t in (b"aabcdefg", b"babcdefg")]
    assert int(M.contexts(keys[0])[3][0]) != int(M.contexts(keys[1])[3][0])
    assert int(M.contexts(keys[0])[4][0]) != int(M.contexts(keys[1])[4][0])


def test_long_texts_are_refined_as_often_as_short_ones():
    import random

    r = random.Random(4)
    words = [bytes(r.choice(b"abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(60)]
    text = b" ".join(r.choice(words) for _ in range(7_000))[:33_500]
    counts = [np.zeros(n, np.uint32) for n in M.TABLES]
    M.count(counts, [text[:3_000]])
    tables = [M.predictions(c) for c in counts]
    start = np.tile(np.array(M.START, np.float32), (8, 1))
    got, final = M.cost(tables, [text, b"short"], start)
    data = b"\0" * M.BACK + text + bytes([M.END])
    n = len(text) + 1
    keys = np.array([sum(data[p + M.BACK - k] << 8 * k for k in range(M.BACK + 1)) for p in range(n)], np.uint64)
    x = M._inputs(tables, keys).astype(np.float64)
    sign = M.SIGNS[np.frombuffer(data[M.BACK:], np.uint8)].astype(np.float64)
    w, total = start.astype(np.float64) * M.SCALE, 0.0
    for at in range(0, n, 64):
        stop = min(n, at + 64)
        p = 1 / (1 + np.exp(-np.clip(sign[at:stop] * (x[at:stop] * w).sum(axis=2), -15, 15)))
        total -= np.log(p).sum()
        wrong = sign[at:stop] * (1 - p)
        w += (wrong[:, :, None] * x[at:stop]).sum(axis=0) * M.RATE * M.SCALE / (stop - at) * min((stop - at) / 64, 1)
    assert got[0] == pytest.approx(total, rel=2e-4)
    assert final[0] == pytest.approx(w / M.SCALE, rel=2e-2, abs=2e-3)


def test_every_training_text_is_counted_and_fits_the_first_weights(spark, monkeypatch):
    """No text is left out of the counts or of the fit, however many there are."""
    texts = [f"text number {i} of many that are all alike but for {i * 7919 % 1000}" for i in range(300)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    tables, slopes = [], []
    solve, finished = np.linalg.solve, M._tables

    def seen(chunks, tasks):
        sums = [np.zeros(n, np.int64) for n in M.TABLES]
        for r in chunks.collect():
            np.add.at(sums[r["kind"] // 2], r["n"] * M.CHUNK + np.frombuffer(bytes(r["key"]), "<u2").astype(int), np.frombuffer(bytes(r["data"]), "<u4"))
        tables.append(sums)
        return finished(chunks, tasks)

    monkeypatch.setattr(M, "_tables", seen)
    monkeypatch.setattr(np.linalg, "solve", lambda a, b: slopes.append((a, b)) or solve(a, b))
    M.score(d).count()
    train = [t.encode() for i, t in enumerate(texts) if not held(i, 7, 2)]
    whole = [np.zeros(n, np.uint32) for n in M.TABLES]
    M.count(whole, train)
    assert all((a == b).all() for a, b in zip(tables[0], whole))
    # the same halves by hand
    half = {r["text"].encode(): r["h"] for r in d.selectExpr("text", "pmod(xxhash64(text), 2) h").collect()}
    made = []
    for h in (0, 1):
        counts = [np.zeros(n, np.uint32) for n in M.TABLES]
        M.count(counts, [t for t in train if half[t] == h])
        made.append([M.predictions(c) for c in counts])
    start = np.tile(np.array(M.START), (8, 1))
    total = sum(M.moments(made[1 - h], [t for t in train if half[t] == h], start) for h in (0, 1))
    assert np.allclose(slopes[0][1][:, :, 0], total[:, :, 0], rtol=1e-3, atol=1e-2)
    assert np.allclose(slopes[0][0] - M.PULL * np.eye(5), total[:, :, 1:], rtol=1e-3, atol=1e-2)


def test_derivatives_of_the_costs():
    texts = [b"the cat sat on the mat", b"a cat sat"]
    counts = [np.zeros(n, np.uint32) for n in M.TABLES]
    M.count(counts, [b"the cat and the mat", b"a rat sat on it"])
    tables = [M.predictions(c) for c in counts]
    start = np.tile(np.array(M.START), (8, 1))

    def fixed(w):
        keys = M._keys([(b"", t + bytes([M.END])) for t in texts])
        z = (M._signed(tables, keys).astype(float) * M.SCALE * w).sum(axis=2)
        return np.log1p(np.exp(-z)).sum()

    got = M.moments(tables, texts, start)
    for d, c in [(0, 0), (3, 1), (7, 4)]:
        e = np.zeros_like(start)
        e[d, c] = 1e-3
        assert got[d, c, 0] == pytest.approx(-(fixed(start + e) - fixed(start - e)) / 2e-3, rel=1e-2, abs=1e-3)
        assert got[d, c, 1 + c] == pytest.approx((fixed(start + e) - 2 * fixed(start) + fixed(start - e)) / 1e-6, rel=2e-2, abs=1e-2)


def test_sparse_counts_are_those_of_whole_tables():
    r = np.random.default_rng(2)
    whole, got = np.zeros(1000, np.int64), M.Counts()
    for _ in range(30):
        at, n = r.integers(0, 1000, 50_000), r.integers(1, 9, 50_000)
        np.add.at(whole, at, n)
        got.add(at, n)
    got.settle()
    assert (got.at == np.flatnonzero(whole)).all() and (got.n == whole[got.at]).all()
    empty_one = M.Counts()
    empty_one.settle()
    assert len(empty_one.at) == 0


def test_texts_of_unlike_lengths_are_coded_in_one_group():
    """Groups are bounded by their bytes, not by the longest text times their number, so bytes that repeat are looked up once."""
    texts = [b"short"] * 500 + [b"x" * 100_000]
    assert [len(places) for places, _ in M._lanes(texts)] == [501]
    many = [b"x" * 300_000] * 7 + [b"y" * (3 * M.LANE_BYTES)]
    assert [len(places) for places, _ in M._lanes(many)] == [3, 3, 1, 1]


def test_entries_by_columns_are_those_of_whole_rows():
    """Tables by the nodes of the tree give the same entries and costs as tables by rows, for keys in any order."""
    texts = [b"the cat sat on the mat", "é日 the cat".encode(), b""]
    counts = [np.zeros(n, np.uint32) for n in M.TABLES]
    M.count(counts, texts[:2])
    rows_ = [M.predictions(c) for c in counts]
    columns = [np.ascontiguousarray(r.reshape(-1, 256).T) for r in rows_]
    keys = M._keys([(b"", t + bytes([M.END])) for t in texts])
    places = M.contexts(keys)
    by_hand = np.array([[[int(t[at[i] + (1 << d | (int(k) & 255) >> 8 - d)]) for t, at in zip(rows_, places)] for d in range(8)]
                        for i, k in enumerate(keys)])
    assert (M._inputs(columns, keys) == by_hand).all() and (M._inputs(rows_, keys) == by_hand).all()
    distinct, at = M._numbered(keys)
    assert (distinct[at] == keys).all() and (M._inputs(columns, distinct)[at] == by_hand).all()
    assert (M._signed(columns, distinct)[at] == by_hand * M.SIGNS[(keys & np.uint64(255)).astype(int)][:, :, None]).all()
    start = np.tile(np.array(M.START, np.float32), (8, 1))
    assert (M.cost(columns, texts, start)[0] == M.cost(rows_, texts, start)[0]).all()


def test_texts_longer_than_a_group_keep_their_costs(monkeypatch):
    texts = [b"the cat sat on the mat " * 60, b"a rat", b"the mat " * 30]
    counts = [np.zeros(n, np.uint32) for n in M.TABLES]
    M.count(counts, texts[1:])
    tables = [M.predictions(c) for c in counts]
    start = np.tile(np.array(M.START, np.float32), (8, 1))
    whole = M.cost(tables, texts, start)[0]
    monkeypatch.setattr(M, "LANE_BYTES", 4 * M.BLOCK)
    monkeypatch.setattr(M, "NEAR", 50)
    assert M.cost(tables, texts, start)[0] == pytest.approx(whole, rel=1e-6)
