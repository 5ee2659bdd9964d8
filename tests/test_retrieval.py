import math
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cohort.operators import retrieval as V
from cohort.operators.prepare import prepare

TEXTS = [
    "Red apple, green apple!", "École de la ville; école", "a b c", "red red red wine", "Green tea and red wine",
    "", "red apple green apple", "wine_bar 2024 über",
]
QUESTIONS = ["red apple", "école", "nothing known", "wine red red", "green"]


@pytest.fixture(scope="module")
def chunks(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "chunk_id long, text string").repartition(3)


@pytest.fixture(scope="module")
def queries(spark):
    return spark.createDataFrame(list(enumerate(QUESTIONS)), "query_id long, text string")


def found(df, value="score"):
    return sorted((r["query_id"], r["rank"], r["chunk_id"], round(r[value], 6)) for r in df.collect())


def expected_cosines(max_terms, stop, k):
    tokens = [[t for t in re.findall(r"\w{2,}", x.lower()) if t not in stop] for x in TEXTS]
    total = Counter(t for ts in tokens for t in ts)
    kept = sorted(total, key=lambda t: (-total[t], t))[:max_terms]
    idf = {t: math.log((1 + len(TEXTS)) / (1 + sum(t in ts for ts in tokens))) + 1 for t in kept}

    def vector(ts):
        raw = {t: n * idf[t] for t, n in Counter(ts).items() if t in idf}
        norm = math.sqrt(sum(w * w for w in raw.values()))
        return {t: w / norm for t, w in raw.items()} if norm else {}

    out = []
    for q, text in enumerate(QUESTIONS):
        qv = vector(re.findall(r"\w{2,}", text.lower()))
        scores = [(round(sum(w * vector(ts).get(t, 0) for t, w in qv.items()), 9), c) for c, ts in enumerate(tokens)]
        best = sorted(((-s, c) for s, c in scores if s > 0))[:k]
        out += [(q, r + 1, c, round(-s, 6)) for r, (s, c) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("way", [{}, {"block_cells": 8}, {"vocabulary": 0}, {"vocabulary": 0, "block_cells": 1}])
@pytest.mark.parametrize("terms", [8, None])
def test_tfidf_against_brute_force(chunks, queries, way, terms):
    index = V.tfidf_index(chunks, max_terms=terms, stop_words=["and"])
    assert index.n_terms == (terms or index.terms.count()) and index.n_chunks == len(TEXTS)
    assert found(V.tfidf_topk(index, chunks, queries, 2, **way)) == expected_cosines(terms, {"and"}, 2)


def test_only_the_best_rows_are_shuffled(chunks, queries, capsys):
    V.tfidf_topk(V.tfidf_index(chunks), chunks, queries, 2).explain()
    text = capsys.readouterr().out
    assert text.count("Exchange hashpartitioning") == 1 and "Join" not in text


def test_empty_vocabulary(spark, chunks, queries):
    index = V.tfidf_index(spark.createDataFrame([(1, "a")], "chunk_id long, text string"))
    assert index.n_terms == 0 and V.tfidf_topk(index, chunks, queries).count() == 0


def test_every_chunk_finds_itself(book):
    rows = V.row_chunks(book).limit(20)
    index = V.tfidf_index(rows, stop_words=[])
    own = V.tfidf_topk(index, rows, rows.select(F.col("chunk_id").alias("query_id"), "text"), 1)
    assert own.where(F.col("query_id") != F.col("chunk_id")).isEmpty()


@pytest.mark.parametrize("way", [{}, {"max_keywords": 4}])
def test_keywords_against_brute_force(chunks, queries, way):
    expected = []
    for q, text in enumerate(QUESTIONS):
        scores = [(-sum(w in t.lower() for w in text.lower().split()), c) for c, t in enumerate(TEXTS)]
        expected += [(q, r + 1, c, -s) for r, (s, c) in enumerate(sorted(x for x in scores if x[0])[:3])]
    assert found(V.keyword_topk(chunks, queries, 3, **way)) == sorted(expected)


def test_many_keywords_in_one_pass(spark):
    """Fifty thousand words, overlapping ones too, against plain substring tests of a few chunks."""
    rng = np.random.default_rng(5)
    letters = np.array(list("abcde"))
    words = ["".join(rng.choice(letters, rng.integers(1, 9))) for _ in range(50_000)]
    asked = [(q, " ".join(words[q * 50:(q + 1) * 50])) for q in range(1000)]
    texts = [(c, " ".join("".join(rng.choice(letters, 30)) for _ in range(5))) for c in range(12)] + [(50, ""), (51, None), (52, "ABCDE abcde")]
    got = V.keyword_topk(spark.createDataFrame(texts, "chunk_id long, text string"), spark.createDataFrame(asked, "query_id long, text string"), 3)
    expected = []
    for q, text in asked:
        scores = [(-sum(w in (t or "").lower() for w in text.split()), c) for c, t in texts]
        expected += [(q, r + 1, c, -s) for r, (s, c) in enumerate(sorted(x for x in scores if x[0])[:3])]
    assert found(got) == sorted(expected)


@pytest.mark.parametrize("held", [1, 500_000])
def test_chunks_with_the_same_words_are_scored_together(monkeypatch, held):
    import pandas as pd

    ranked = []
    add = V.Best.add
    monkeypatch.setattr(V.Best, "add", lambda self, query, ids, value: ranked.append(len(query)) or add(self, query, ids, value))
    monkeypatch.setattr(V, "HELD_WORDS", held)
    rows = [{"query_id": q, "word": w, "times": n} for q, w, n in ((7, "ab", 1), (7, "b", 2), (8, "b", 1), (9, "zz", 1))]
    texts = ["x ab", "b b", None, "", "c"] * 400
    batches = [pd.DataFrame({"chunk_id": [f"c{n}" for n in range(k, len(texts), 2)], "text": texts[k::2]}) for k in (1, 0)]
    got = pd.concat(V._keyword_search(iter(batches), *V._keyword_table(rows), 3))
    score = {7: [("ab", 1), ("b", 2)], 8: [("b", 1)]}
    for q, words in score.items():
        best = sorted((-sum(n for w, n in words if w in (t or "")), f"c{c}") for c, t in enumerate(texts))[:3]
        assert got[got["query_id"] == q][["score", "chunk_id"]].values.tolist() == [[-s, c] for s, c in best]
    assert len(got) == 6 and (held == 1 or max(ranked) <= 3 * 3 * 2)   # of chunks that tie only the first k are ranked


def test_keywords_of_short_and_long_chunks(spark, monkeypatch):
    monkeypatch.setattr(V, "SHORT_CHARS", 10)
    texts = ["Ab cd", "AB\tcd " * 9, "ab\u00a0cd, é" * 5, "  ", None, "xABx " * 2, "ÉCOLE école école"]
    asked = ["ab cd, école", "b\u00a0c école école"]
    expected = []
    for q, text in enumerate(asked):
        words = [w for w in re.split(r"[ \t\n\x0b\f\r]+", text.lower()) if w]
        scores = [(-sum(w in (t or "").lower() for w in words), c) for c, t in enumerate(texts)]
        expected += [(q, r + 1, c, -s) for r, (s, c) in enumerate(sorted(x for x in scores if x[0])[:4])]
    got = V.keyword_topk(spark.createDataFrame(list(enumerate(texts)), "chunk_id long, text string"),
                         spark.createDataFrame(list(enumerate(asked)), "query_id long, text string"), 4)
    assert found(got) == sorted(expected)


def test_a_query_without_words(spark, chunks):
    none = spark.createDataFrame([(1, " "), (2, None)], "query_id long, text string")
    assert V.keyword_topk(chunks, none, 2).count() == 0 and V.keyword_topk(chunks, none, 2, pad=True).count() == 4


def test_padded_keywords(chunks, queries):
    expected = []
    for q, text in enumerate(QUESTIONS):
        scores = [(-sum(w in t.lower() for w in text.lower().split()), c) for c, t in enumerate(TEXTS)]
        expected += [(q, r + 1, c, -s) for r, (s, c) in enumerate(sorted(scores)[:5])]
    assert found(V.keyword_topk(chunks, queries, 5, pad=True)) == sorted(expected)


@pytest.mark.parametrize("way", [{}, {"broadcast_numbers": 12}])
def test_nearest_against_brute_force(spark, way):
    rng = np.random.default_rng(1)
    points = rng.integers(0, 4, (60, 4)).astype(float)
    points[7] = points[3]           # a tie
    rows = [(i, [float(x) for x in p]) for i, p in enumerate(points)]
    vectors = spark.createDataFrame(rows, "chunk_id long, embedding array<double>").repartition(3)
    queries = spark.createDataFrame(rows[:10], "query_id long, embedding array<double>")
    expected = []
    for q in range(10):
        order = sorted((float(((p - points[q]) ** 2).sum()), i) for i, p in enumerate(points))[:4]
        expected += [(q, r + 1, i, round(d, 6)) for r, (d, i) in enumerate(order)]
    assert found(V.knn_topk(vectors, queries, 4, **way), "distance") == sorted(expected)


@pytest.mark.parametrize("pivots", [1, 7, 60])
def test_cells_give_the_exact_neighbours(spark, pivots):
    """Repeated points, ties, a far point, queries outside all cells, more neighbours asked than there are."""
    rng = np.random.default_rng(2)
    points = np.concatenate([rng.normal(size=(40, 3)), np.zeros((12, 3)), [[50.0, 0, 0]], rng.integers(0, 2, (20, 3))])
    vectors = spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(points)] + [(900, None)], "chunk_id long, embedding array<double>")
    asked = np.concatenate([points[::9], [[9.0, 9, 9], [-100.0, 0, 0]]])
    queries = spark.createDataFrame([(q, [float(x) for x in p]) for q, p in enumerate(asked)] + [(99, None)], "query_id long, embedding array<double>")
    index = V.cells(vectors.repartition(4), pivots)
    for k in (1, 5, 100):
        expected = []
        for q, p in enumerate(asked):
            order = sorted((round(float(((x - p) ** 2).sum()), 9), i) for i, x in enumerate(points))[:k]
            expected += [(q, r + 1, i, round(d, 6)) for r, (d, i) in enumerate(order)]
        assert found(V.knn_topk(index, queries, k), "distance") == sorted(expected)


def test_few_pairs_are_compared(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 8)) * 20
    points = centres[rng.integers(0, 40, 4000)] + rng.normal(size=(4000, 8))
    vectors = spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(points)], "chunk_id long, embedding array<double>").repartition(4)
    queries = vectors.where("chunk_id % 20 = 0").withColumnRenamed("chunk_id", "query_id")
    seen = spark.sparkContext.accumulator(0)
    got = V.knn_topk(V.cells(vectors, 200), queries, 5, compared=seen).collect()
    assert len(got) == 1000 and all(r["chunk_id"] == r["query_id"] for r in got if r["rank"] == 1)
    assert 0 < seen.value < 0.1 * 200 * 4000
    assert V.knn_topk(vectors.limit(0), queries).count() == 0


def test_sample_does_not_depend_on_partitions(book):
    rows = V.row_chunks(book)
    a = {r[0] for r in V.sample_rows(rows, 50).select("chunk_id").collect()}
    b = {r[0] for r in V.sample_rows(rows.repartition(7), 50).select("chunk_id").collect()}
    c = {r[0] for r in V.sample_rows(rows, 50, seed=1).select("chunk_id").collect()}
    assert a == b and len(a) == 50 and a != c
    assert V.sample_rows(rows, 10**6).count() == book.n_rows
    # 50 of 1,473 rows go by the bound; they are the 50 lowest of all
    place = F.md5(F.concat("chunk_id", F.lit("#42")))
    assert a == {r[0] for r in rows.orderBy(place, "chunk_id").limit(50).select("chunk_id").collect()}
    assert V.chunk_corpus(book, max_rows=10).count() == 15


def test_chunks_without_a_key_keep_their_numbers(spark):
    ds = prepare(spark.createDataFrame([("a", 1.0), ("a", 1.0)], "name string, maths double"))
    rows = V.row_chunks(ds)
    assert rows.select("chunk_id").distinct().count() == 2
    assert rows.first()["text"] == "Student: a | maths: 1.0 | Average: 1.0 | Grade: F"


def test_context_and_prompt(chunks, queries):
    index = V.tfidf_index(chunks, stop_words=[])
    contexts = V.context_blocks(queries, V.tfidf_topk(index, chunks, queries, 2), chunks, 2)
    by_query = {r["query_id"]: r["context"] for r in contexts.collect()}
    assert by_query[1] == "- École de la ville; école" and by_query[2] == "No relevant data found."
    prompts = {r["query_id"]: r["prompt"] for r in V.augmented_prompts(queries, contexts, 10).collect()}
    assert prompts[2] == "nothing known"
    assert prompts[1] == "école\n\n[Retrieved dataset context]\n- École de…"


def test_nearest_of_wide_vectors_and_ties(spark, monkeypatch):
    rng = np.random.default_rng(2)
    points = rng.normal(size=(300, 700))
    points[250:] = points[:50]
    rows = [(i, [float(x) for x in p]) for i, p in enumerate(points)]
    vectors = spark.createDataFrame(rows, "chunk_id long, embedding array<double>").repartition(3)
    queries = spark.createDataFrame(rows[:20], "query_id long, embedding array<double>")
    monkeypatch.setattr(V, "CELL_NUMBERS", 7_000)
    monkeypatch.setattr(V, "CELL_QUERIES", 7)
    expected = []
    for q in range(20):
        order = sorted((round(float(((p - points[q]) ** 2).sum()), 9), i) for i, p in enumerate(points))[:3]
        expected += [(q, r + 1, i, round(d, 6)) for r, (d, i) in enumerate(order)]
    assert found(V.knn_topk(vectors, queries, 3), "distance") == sorted(expected)


def test_rows_with_the_same_roll_keep_their_own_chunk(spark):
    rows = [(7, "a", 1.0), (7, "b", 2.0), (7, "b", 2.0), (8, "c", 3.0)]
    chunks = V.row_chunks(prepare(spark.createDataFrame(rows, "roll long, name string, maths double")))
    ids = [r["chunk_id"] for r in chunks.collect()]
    assert len(set(ids)) == len(ids) == 4 and "row:8" in ids
    index = V.tfidf_index(chunks, stop_words=[])
    best = V.tfidf_topk(index, chunks, chunks.selectExpr("chunk_id AS query_id", "text"), 1).collect()
    assert all(r["score"] <= 1 for r in best)


def test_every_copy_asks_but_few_pairs_are_compared(spark):
    """Many equal vectors, and ids that occur twice: the k lowest ids of equal vectors are enough for all queries."""
    rng = np.random.default_rng(5)
    points = rng.permutation(np.concatenate([np.ones((900, 4)), np.full((300, 4), 1 + 1e-7), rng.normal(size=(60, 4))]))
    rows = [(i // 2 if i < 20 else i, [float(x) for x in p]) for i, p in enumerate(points)]
    vectors = spark.createDataFrame(rows, "chunk_id long, embedding array<double>").repartition(3)
    seen = spark.sparkContext.accumulator(0)
    got = V.knn_topk(V.cells(vectors, 30), vectors.withColumnRenamed("chunk_id", "query_id"), 3, compared=seen)
    best = {}
    for q, p in rows:
        apart = np.round(np.square(points - np.array(p)).sum(axis=1), 9)
        best.setdefault(q, []).extend(sorted(zip(apart.tolist(), [i for i, _ in rows]))[:3])
    expected = [(q, r + 1, i, round(d, 6)) for q, near in best.items() for r, (d, i) in enumerate(sorted(near)[:3])]
    assert found(got, "distance") == sorted(expected)
    assert 0 < seen.value < 0.1 * len(rows) ** 2


def test_knn_query_asks_for_every_vector(spark, tmp_path):
    """The query and its SQL; the ids begin anywhere and none of them need be divisible by anything."""
    from cohort.plans.oracles import ORACLE_SQL
    from cohort.plans.queries import QUERIES

    points = np.random.default_rng(4).normal(size=(70, 5)).astype("float32")
    vectors = spark.createDataFrame([(3 * i + 7, [float(x) for x in p]) for i, p in enumerate(points)], "vec_id long, embedding array<float>")
    vectors.write.parquet(f"{tmp_path}/embeddings.parquet")
    got = QUERIES["knn_topk"](spark, str(tmp_path)).collect()
    assert {r["query_id"] for r in got} == {3 * i + 7 for i in range(70)} and len(got) == 6 * 70
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    expected = con.execute(ORACLE_SQL["knn_topk"]).fetchall()
    assert sorted((r["query_id"], r["rank"], r["chunk_id"], r["distance"]) for r in got) == sorted(expected)


@pytest.mark.parametrize("vocabulary", [0, 3, 100])
def test_texts_are_counted_in_slices_of_few_tokens(chunks, queries, monkeypatch, vocabulary):
    """Whatever the rows of a batch; of a large vocabulary the most frequent terms and those of the queries travel to the texts."""
    sizes = [0, 2, 9, 1, 1, 1, 3, 0]
    batch = pa.RecordBatch.from_arrays([pa.array(range(8)), pa.array([["w"] * n for n in sizes])], names=["key", "t"])
    monkeypatch.setattr(V, "COUNTED_TOKENS", 4)
    slices = [s.column(1).to_pylist() for s in V._token_slices([batch])]
    assert [len(t) for s in slices for t in s] == sizes and all(len(s) == 1 or sum(map(len, s)) <= 4 for s in slices)
    index = V.tfidf_index(chunks, stop_words=["and"])
    assert found(V.tfidf_topk(index, chunks, queries, 2, vocabulary=vocabulary)) == expected_cosines(None, {"and"}, 2)
