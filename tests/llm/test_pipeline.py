"""The pipeline against a brute-force version of its stages, and the registered queries of the package."""

import hashlib

import pytest

import corpus_pipeline
from cohort.llm import bpe, decontaminate, fertility, registry
from cohort.session import written
from tests.llm.cases import as_bag
from tests.llm.test_lines_and_groups import brute_groups, brute_lines
from tests.oracle_check import database, difference


def brute(sf):
    import duckdb

    docs = duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet' ORDER BY doc_id").fetchall()
    items = duckdb.sql(f"SELECT item_id, text FROM '{sf}/benchmark.parquet'").fetchall()
    keep = fertility.measure([(t or "").encode() for _, t in docs])[6]
    docs = [d for d, k in zip(docs, keep) if k]
    docs = [(i, t) for i, t, *_ in brute_lines(docs)]
    docs = [d for d, (i, _, c) in zip(docs, brute_groups(docs)) if i == c]
    shingled = [decontaminate.shingles(decontaminate.words_of(t)) for _, t in items]
    docs = [(i, t) for i, t in docs for there in [decontaminate.shingles(decontaminate.words_of(t))]
            if not any(s and len(s & there) >= 0.8 * len(s) for s in shingled)]
    tool = bpe.Codec(bpe.VOCABULARY).whole
    out = []
    for i, t in docs:
        ids = tool.encode(t, add_special_tokens=False).ids
        out.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                    hashlib.sha256(tool.decode(ids, skip_special_tokens=False).encode()).hexdigest(), tuple(ids)))
    return out


def test_pipeline_against_brute_force(spark, sf_dir):
    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert as_bag((*tuple(r)[:4], tuple(r["ids"])) for r in got) == as_bag(brute(sf_dir))


def test_stages_return_the_columns_of_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    n = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = written(stage(spark, docs, sf_dir))
        assert out.columns == docs.columns and 0 < out.count() <= n, name
        docs, n = out, out.count()


def test_stages_of_an_empty_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_registered(spark, sf_dir, name):
    got = registry.QUERIES[name](spark, sf_dir)
    if name in registry.ORACLE_SQL:
        assert difference(spark, database(sf_dir), sf_dir, name, registry.QUERIES[name], registry.ORACLE_SQL[name]) is None
    else:
        assert got.count() > 0


def test_near_dedup_is_the_simhash_operator_with_its_three_bits(spark, sf_dir):
    """Exact copies and texts within three bits go, more distant edits stay."""
    import random

    r = random.Random(3)
    made = []
    for g in range(25):
        words = [f"w{r.randrange(5000)}" for _ in range(r.randint(300, 900))]
        for copy in range(4):
            now = list(words)
            for _ in range(copy):
                now[r.randrange(len(now))] = f"new{r.randrange(5000)}"
            made.append((len(made), " ".join(now), "en", "made", 0))
    table = spark.createDataFrame(made, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    want = [i for i, _, c in brute_groups(made) if i == c]
    assert sorted(x["doc_id"] for x in corpus_pipeline.near_dedup(spark, table, sf_dir).collect()) == want
    assert 25 <= len(want) < 100
