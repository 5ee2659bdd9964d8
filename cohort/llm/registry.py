"""The registered queries of this package and, where SQL can express them, their counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cohort.llm import (
    bpe, context_mixing, decontaminate, fertility, html_layout, license_templates, line_dedup, periodic_runs, pu_toxicity, quality_fm,
    simhash, token_records, turn_repair,
)
from cohort.plans.tables import table
from cohort.session import shared_folder

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(f):
    """Register a function under its name."""
    QUERIES[f.__name__] = f
    return f


def _documents(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents")


@query
def op1_token_records(spark, sf_dir):
    return token_records.token_digests(_documents(spark, sf_dir), shared_folder(spark, "records"))


@query
def op2_quality_fm(spark, sf_dir):
    return quality_fm.classify(_documents(spark, sf_dir), table(spark, sf_dir, "labels"))


@query
def op3_bpe(spark, sf_dir):
    return bpe.digests(_documents(spark, sf_dir))


@query
def op4_context_mixing(spark, sf_dir):
    return context_mixing.score(_documents(spark, sf_dir))


@query
def op5_line_dedup(spark, sf_dir):
    kept = line_dedup.line_report(_documents(spark, sf_dir))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLE_SQL["op5_line_dedup"] = """
WITH lines AS (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
           generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
    FROM documents
), keyed AS (
    SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
    FROM lines
), shared AS (
    SELECT k, min(doc_id) AS first_doc FROM keyed WHERE length(k) >= 10
    GROUP BY k HAVING count(DISTINCT doc_id) >= 2
), marked AS (
    SELECT keyed.*, coalesce(doc_id <> first_doc, FALSE) AS gone FROM keyed LEFT JOIN shared USING (k)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


@query
def op6_html_layout(spark, sf_dir):
    return html_layout.extract(table(spark, sf_dir, "pages"))


@query
def op7_simhash(spark, sf_dir):
    return simhash.near_duplicates(_documents(spark, sf_dir))


@query
def op8_decontaminate(spark, sf_dir):
    return decontaminate.find_leaks(_documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


@query
def op9_fertility_rules(spark, sf_dir):
    return fertility.fertility_rules(_documents(spark, sf_dir))


@query
def op10_license_templates(spark, sf_dir):
    return license_templates.license_scan(_documents(spark, sf_dir))


@query
def op11_periodic_runs(spark, sf_dir):
    return periodic_runs.run_digests(periodic_runs.periodic_runs(periodic_runs.planted(_documents(spark, sf_dir))))


@query
def op12_pu_toxicity(spark, sf_dir):
    return pu_toxicity.classify(_documents(spark, sf_dir), table(spark, sf_dir, "labels"))


@query
def op13_turn_repair(spark, sf_dir):
    return turn_repair.structure_repair(table(spark, sf_dir, "conversations"))


ORACLE_SQL["op13_turn_repair"] = """
WITH RECURSIVE plain AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
           list_concat([4294967295::UBIGINT], list_transform(string_split(
               coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: ord(c)::UBIGINT)) AS bytes
    FROM conversations
), marked AS (
    SELECT *, xor(4294967295::UBIGINT, list_reduce(bytes, lambda x, b: list_reduce([xor(x, b), 0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[],
           lambda y, z: CASE WHEN y % 2 = 1 THEN xor(y // 2, 3988292384::UBIGINT) ELSE y // 2 END))) % 20 AS kind
    FROM plain
), hurt AS (
    SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
           CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
           unnest(CASE WHEN kind = 3 THEN [1, 2] ELSE [1] END) AS copy
    FROM marked WHERE kind <> 0
), ordered AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS pos,
           rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS shown
    FROM hurt
), judged AS (
    SELECT conv_id, turn, role, text, pos, left(role, 1) AS i,
           left(lag(role) OVER (PARTITION BY conv_id ORDER BY pos), 1) || left(role, 1) AS pair,
           CASE WHEN shown = '' THEN 'blank'
                WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'duplicate'
                WHEN right(shown, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault
    FROM ordered
), steps(f, t, i) AS (VALUES ('0', 's', 's'), ('0', 'u', 'u'), ('s', 'u', 'u'), ('u', 'a', 'a'), ('a', 'u', 'u')),
inserts(f, t, cost, letters, lines) AS (
    VALUES ('0', '0', 0, '', []), ('s', 's', 0, '', []), ('u', 'u', 0, '', []), ('a', 'a', 0, '', []),
           ('0', 'u', 3, 'I', ['user:']), ('s', 'u', 3, 'I', ['user:']), ('a', 'u', 3, 'I', ['user:']), ('u', 'a', 3, 'I', ['assistant:']),
           ('0', 'a', 6, 'II', ['user:', 'assistant:']), ('s', 'a', 6, 'II', ['user:', 'assistant:'])
), edits AS (
    SELECT conv_id, pos, f, f AS t, 4 AS cost, 'D' AS letter, []::VARCHAR[] AS lines FROM judged, (VALUES ('0'), ('s'), ('u'), ('a')) AS p(f)
    UNION ALL
    SELECT conv_id, pos, f, t, CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END, 'K', [role || ':' || text]
    FROM judged JOIN steps USING (i) WHERE fault IN ('', 'truncated')
    UNION ALL
    SELECT conv_id, pos, f, t, CASE WHEN fault = 'truncated' THEN 6 ELSE 3 END, 'R', [CASE steps.i WHEN 'u' THEN 'user:' ELSE 'assistant:' END || text]
    FROM judged, steps WHERE fault IN ('', 'truncated') AND steps.i <> 's'
), parse(conv_id, pos, state, best) AS (
    SELECT conv_id, 0::BIGINT, '0', {'cost': 0, 'audit': '', 'lines': []::VARCHAR[]} FROM (SELECT DISTINCT conv_id FROM hurt)
    UNION ALL
    SELECT parse.conv_id, parse.pos + 1, edits.t, min({'cost': best.cost + inserts.cost + edits.cost, 'audit': best.audit || inserts.letters || edits.letter,
               'lines': list_concat(list_concat(best.lines, inserts.lines), edits.lines)})
    FROM parse JOIN inserts ON inserts.f = parse.state
    JOIN edits ON edits.conv_id IS NOT DISTINCT FROM parse.conv_id AND edits.pos = parse.pos + 1 AND edits.f = inserts.t
    GROUP BY parse.conv_id, parse.pos, edits.t
), whole AS (
    SELECT conv_id, min({'cost': best.cost + inserts.cost, 'audit': best.audit || inserts.letters, 'lines': list_concat(best.lines, inserts.lines)}) AS best
    FROM parse JOIN inserts ON inserts.f = parse.state JOIN (SELECT conv_id AS c, max(pos) AS n FROM judged GROUP BY 1) AS sizes
        ON c IS NOT DISTINCT FROM parse.conv_id AND n = parse.pos
    WHERE inserts.t IN ('0', 'a') GROUP BY conv_id
), counted AS (
    SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank,
           count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated,
           count(*) FILTER (WHERE pos > 1 AND pair NOT IN ('su', 'ua', 'au')) AS illegal
    FROM judged GROUP BY conv_id
)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, coalesce(best.cost, 0)::BIGINT AS cost, coalesce(best.audit, '') AS audit,
       sha256(coalesce(array_to_string(best.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) AS o
LEFT JOIN counted ON counted.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN whole ON whole.conv_id IS NOT DISTINCT FROM o.conv_id
"""
