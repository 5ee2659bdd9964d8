"""Decontamination: the blocks in which items are indexed change no row."""

from cohort.llm import decontaminate as D
from tests.llm.cases import made_texts


def test_blocks_give_the_same_rows(spark, monkeypatch):
    texts = made_texts(40, seed=8)
    items = [(i, t[5:5 + 40 * (1 + i % 9)]) for i, t in enumerate(texts) if len(t) > 100] + [(100 + i, texts[0]) for i in range(30)]
    items += [(200, None), (201, ""), (None, texts[1])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    table = spark.createDataFrame(items, "item_id long, text string")

    def found():
        return sorted((r["doc_id"], str(r["item_id"]), round(r["score"], 9), round(r["bm25"], 7), *tuple(r)[4:])
                      for r in D.find_leaks(docs, table).collect())

    one, kept = found(), sorted(r[0] for r in D.keep_clean(docs, table).collect())
    assert sum(r[0] == 0 and r[1].startswith("1") and len(r[1]) == 3 for r in one) == 30
    monkeypatch.setattr(D, "INDEX_CHARS", 1_500)
    assert len(list(D._indexes(D._rows(table, "item_id", "text", None)))) > 2
    assert found() == one
    assert sorted(r[0] for r in D.keep_clean(docs, table).collect()) == kept
