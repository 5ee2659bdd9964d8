"""Line dedup and SimHash groups against brute force."""

import hashlib
from collections import defaultdict

import pytest
from hypothesis import given, settings, strategies as st
from xxhash import xxh64_intdigest

from cohort.llm import common, line_dedup, simhash
from tests.llm.cases import as_bag, docs, empty, rows


def key(line):
    return "".join(c.lower() if c.isascii() else c for c in line.strip(" \t\n\v\f\r"))


def brute_lines(table, min_docs=2, min_chars=10):
    holders = defaultdict(set)
    for i, t, *_ in table:
        for line in (t or "").split("\n"):
            if len(key(line)) >= min_chars:
                holders[key(line)].add(i)
    out = []
    for i, t, *_ in table:
        lines = (t or "").split("\n")
        first = {k: min((x for x in h if x is not None), default=None) for k, h in holders.items() if len(h) >= min_docs}
        kept = [x for x in lines if key(x) not in first or first[key(x)] == i]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


def test_lines_against_brute_force(spark):
    assert as_bag(map(tuple, line_dedup.line_report(docs(spark)).collect())) == as_bag(brute_lines(rows()))


def test_lines_keep_columns_and_empty_tables(spark):
    out = line_dedup.dedup_lines(docs(spark))
    assert out.columns == docs(spark).columns and out.count() == len(rows())
    assert line_dedup.line_report(empty(spark)).count() == 0


def test_lines_case_folding_is_ascii_only(spark):
    table = [(1, "Été à la plage"), (2, "été À LA PLAGE"), (3, "Été à LA plage"), (4, "Kelvin degrees"), (5, "kelvin degrees")]
    got = {r[0]: r[3] for r in line_dedup.line_report(spark.createDataFrame(table, "doc_id long, text string")).collect()}
    assert got == {1: 0, 2: 0, 3: 1, 4: 0, 5: 0}


def test_lines_threshold(spark):
    table = [(i, "a line in three documents\nunique line number %d" % i) for i in range(3)]
    df = spark.createDataFrame(table, "doc_id long, text string")
    assert sum(r[3] for r in line_dedup.line_report(df, min_docs=3).collect()) == 2
    assert sum(r[3] for r in line_dedup.line_report(df, min_docs=4).collect()) == 0
    with pytest.raises(ValueError):
        line_dedup.line_report(df, min_docs=1)


def test_lines_stay_in_the_engine(spark, capsys):
    line_dedup.line_report(docs(spark)).explain()
    text = capsys.readouterr().out
    assert not any(w in text for w in ("Python", "Arrow", "CartesianProduct", "BroadcastNestedLoop"))


def slow_print(text, k=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    n = max(1, len(words) - k + 1)
    hashes = [xxh64_intdigest(b" ".join(words[i:i + k]), 42) for i in range(n)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > n)


def brute_groups(table):
    prints = [slow_print(t) for _, t, *_ in table]
    group = list(range(len(table)))
    for a in range(len(table)):
        for b in range(a):
            if bin(prints[a] ^ prints[b]).count("1") <= 3 and group[a] != group[b]:
                group = [group[b] if g == group[a] else g for g in group]
    ids = {g: min((table[i][0] for i in range(len(table)) if group[i] == g and table[i][0] is not None), default=None) for g in group}
    return [(table[i][0], f"{prints[i]:016x}", ids[group[i]]) for i in range(len(table))]


def test_groups_against_brute_force(spark):
    assert as_bag(map(tuple, simhash.near_duplicates(docs(spark)).collect())) == as_bag(brute_groups(rows()))


def test_groups_edge_cases(spark):
    assert simhash.near_duplicates(empty(spark)).count() == 0
    kept = simhash.keep_first(docs(spark))
    assert kept.columns == docs(spark).columns
    ids = [r[0] for r in kept.collect()]
    assert 103 not in ids and 101 not in ids and 5 in ids and 100 in ids and ids.count(None) == 2


def test_rows_that_share_an_id_are_judged_by_their_own_text(spark):
    a, b, c = ("one two three four five six seven", "eight nine ten eleven twelve", "red green blue black white grey")
    table = [(5, a, 1, "a", None, 7), (103, a, 1, "a", None, 7), (103, b, 1, "b", 3, 8), (103, b, 1, "b", 3, 8), (None, a, 1, "a", 0, 0),
             (200, b, 2, None, 0, 0), (201, c, 2, None, 0, 0), (7, c, 2, None, 0, 0), (7, a, 2, None, 0, 0), (9, None, 0, "", 0, 0), (8, "", 0, "", 0, 0)]
    kept = simhash.keep_first(spark.createDataFrame(table, "doc_id long, text string, id long, row string, pos int, fp long"))
    ids = {(i, t): component for (i, t, *_), (_, _, component) in zip(table, brute_groups(table))}
    want = [r for r in table if r[0] is None or ids[r[0], r[1]] == r[0]]
    assert as_bag(map(tuple, kept.collect())) == as_bag(want)
    assert (103, b, 1, "b", 3, 8) in want and (103, a, 1, "a", None, 7) not in want


def test_a_very_long_text_has_one_print(spark):
    text = "alpha beta gamma " * 60_000
    got = simhash.near_duplicates(spark.createDataFrame([(1, text), (2, text + "delta"), (3, "other words here")], "doc_id long, text string"))
    assert {r[0]: r[2] for r in got.collect()} == {1: 1, 2: 1, 3: 3}


def test_spark_hash_is_the_same(spark):
    got = spark.sql("SELECT xxhash64('ab cd é') AS h").first()["h"]
    assert got % 2 ** 64 == xxh64_intdigest("ab cd é".encode(), 42)


def test_links_find_every_distance(spark):
    base = 0x0123456789ABCDEF
    near = [base] + [base ^ (1 << a) ^ (1 << b) ^ (1 << c) for a, b, c in ((0, 1, 2), (31, 32, 33), (61, 62, 63), (5, 40, 60), (0, 0, 9))]
    far = [base ^ 0b1111 << 20]
    signed = [x - 2 ** 64 if x >= 2 ** 63 else x for x in near + far]
    found = {frozenset((r["u"], r["v"])) for r in simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long")).collect()}
    want = {frozenset((a, b)) for a in signed for b in signed if a != b and bin((a ^ b) & (2 ** 64 - 1)).count("1") <= 3}
    assert found == want


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, j) for j in range(101, 140)] + [(7, 7), (200, 201)]
    got = {r["node"]: r["root"] for r in common.components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{j: 100 for j in range(100, 140)}, 200: 200, 201: 200}


@settings(max_examples=30, deadline=None)
@given(st.text(max_size=60))
def test_print_of_any_text(text):
    assert simhash.fingerprint(text.encode("utf-8", "ignore")) % 2 ** 64 == slow_print(text.encode("utf-8", "ignore").decode())


def test_hashes_of_kept_text(spark):
    from pyspark.sql import functions as F

    got = line_dedup.line_report(docs(spark)).select(F.sha2("text", 256), "text").collect()
    assert all(a == hashlib.sha256(t.encode()).hexdigest() for a, t in got)
