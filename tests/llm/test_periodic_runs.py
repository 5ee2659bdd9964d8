"""Periodic runs against every stretch and period of small texts, extensions against word by word."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from cohort.llm import periodic_runs as P
from tests.llm.cases import as_bag, docs, empty, rows


def slow_runs(words, exponent=4, shortest=6):
    n, out = len(words), []
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            smallest = next(p for p in range(1, q + 1) if all(words[k] == words[k + p] for k in range(i, i + length - p)))
            if length >= max(shortest, exponent * q) and smallest == q:
                out.append((i, length, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def slow_collapsed(words, runs):
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    return " ".join(w for k, w in enumerate(words) if k not in gone)


def made(seed=3, n=150):
    r = random.Random(seed)
    texts = []
    for _ in range(n):
        words = []
        while len(words) < r.choice([0, 5, 30, 120]):
            block = [r.choice("abc") for _ in range(r.randint(1, 6))]
            words += block * r.choice([1, 1, 4, 5, 9]) + block[:r.randint(0, len(block))]
        texts.append(" ".join(words))
    return texts


def as_rows(columns):
    return [(n, [(r["start"], r["length"], r["period"]) for r in runs], text) for n, runs, text in zip(*[c.to_pylist() for c in columns])]


def expected(text, exponent=4, shortest=6):
    words = text.split()
    runs = slow_runs(words, exponent, shortest)
    return len(words), runs, slow_collapsed(words, runs)


@pytest.mark.parametrize("exponent, shortest", [(4, 6), (2, 2), (3, 9)])
def test_runs_against_all_stretches(exponent, shortest):
    texts = made() + ["", "a", " ".join("a" * 500), " ".join("ab" * 300 + "ba" * 200)]
    got = as_rows(P.measure([t.encode() for t in texts], exponent, shortest))
    assert got == [expected(t, exponent, shortest) for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab ", max_size=60), max_size=5))
def test_any_texts(texts):
    assert as_rows(P.measure([t.encode() for t in texts])) == [expected(t) for t in texts]


def test_questions_in_chunks(monkeypatch):
    texts = [t.encode() for t in made(9, 40)]
    whole = as_rows(P.measure(texts))
    monkeypatch.setattr(P, "QUESTIONS", 7)
    assert as_rows(P.measure(texts)) == whole


@pytest.mark.parametrize("kind", ["random", "periodic", "one"])
def test_extensions(kind):
    rng = np.random.default_rng(2)
    n = 700
    words = {"random": rng.integers(0, 3, n), "periodic": np.arange(n) % 17, "one": np.zeros(n, int)}[kind].astype(np.int64)
    words = np.append(words, 99)
    i = rng.integers(0, n, 3000)
    j = rng.integers(0, n, 3000)
    i, j = np.minimum(i, j)[i != j], np.maximum(i, j)[i != j]

    def slow(a, b):
        k = 0
        while words[a + k] == words[b + k]:
            k += 1
        return k

    assert P.Extensions(words).common(i, j).tolist() == [slow(a, b) for a, b in zip(i, j)]


def test_a_very_long_text():
    text = " ".join(["x y z"] * 70_000 + [f"w{k}" for k in range(100_000)])
    (n, runs, collapsed), = as_rows(P.measure([text.encode()]))
    assert n == 310_000 and runs == [(0, 210_000, 3)] and len(collapsed.split()) == 100_003


def slow_planted(i, text):
    words = (text or "").split()
    h = zlib.crc32(str(i).encode()) if i is not None else 1
    if h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]


def report(i, words):
    runs = slow_runs(words)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    four = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    digest = [hashlib.sha256(t.encode()).hexdigest() for t in ("".join(f"{a},{b},{c}\n" for a, b, c in runs), slow_collapsed(words, runs))]
    return (i, len(runs), *four, *digest)


def test_the_query_against_plain_python(spark):
    table = [r for r in rows() if r[0] != 105] + [(k, t, 1, "a", None, 7) for k, t in enumerate(made(8, 80), 1000)]
    df = spark.createDataFrame(table, "doc_id long, text string, id long, row string, pos int, fp long").repartition(3)
    got = P.run_digests(P.periodic_runs(P.planted(df)))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    want = [report(i, slow_planted(i, t)) for i, t, *_ in table]
    assert as_bag(map(tuple, got.collect())) == as_bag(want)
    assert sum(w[1] > 0 for w in want) > 20


def test_edge_cases(spark):
    got = P.periodic_runs(docs(spark)).collect()
    assert as_bag(r["doc_id"] for r in got) == as_bag(i for i, *_ in rows())
    assert [r["runs"][0]["length"] for r in got if r["doc_id"] == 105] == [3000]
    assert P.run_digests(P.periodic_runs(P.planted(empty(spark)))).count() == 0
    with pytest.raises(ValueError):
        P.periodic_runs(docs(spark), exponent=1)
