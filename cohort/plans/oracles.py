"""SQL counterparts of the registered queries, for DuckDB over the same tables."""

from __future__ import annotations

from cohort.plans.questions import SAMPLE_QUESTIONS

# Spark's English stop words.
STOP_WORDS = """
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its
itself they them their theirs themselves what which who whom this that these those am is are was were be been being have
has had having do does did doing a an the and but if or because as until while of at by for with about against between
into through during before after above below to from up down in out on off over under again further then once here there
when where why how all any both each few more most other some such no nor not only own same so than too very s t can will
just don should now i'll you'll he'll she'll we'll they'll i'd you'd he'd she'd we'd they'd i'm you're he's she's it's
we're they're i've we've you've they've isn't aren't wasn't weren't haven't hasn't hadn't don't doesn't didn't won't
wouldn't shan't shouldn't mustn't can't couldn't cannot could here's how's let's ought that's there's what's when's
where's who's why's would
""".split()

SUBJECTS = ("algebra", "networks", "rhetoric")
GRADES = ("A+", "A", "B", "C", "D", "F")


def text(value: str) -> str:
    """A SQL text literal."""
    return "'" + value.replace("'", "''") + "'"


RAW = """
per_order AS (
  SELECT l_orderkey,
         floor(CAST(100 AS DOUBLE) * count(*) FILTER (WHERE l_linestatus = 'F') / count(*)) AS attendance,
         2 * max(l_quantity) FILTER (WHERE l_returnflag = 'A') AS algebra,
         2 * max(l_quantity) FILTER (WHERE l_returnflag = 'N') AS networks,
         2 * max(l_quantity) FILTER (WHERE l_returnflag = 'R') AS rhetoric
  FROM lineitem GROUP BY l_orderkey),
raw AS (
  SELECT 'Order#' || lpad(CAST(o_orderkey AS VARCHAR), 9, '0') AS student_name, o_orderkey AS roll,
         o_orderpriority AS department, year(o_orderdate) AS year, attendance, algebra, networks, rhetoric
  FROM orders JOIN per_order ON o_orderkey = l_orderkey)"""

BOOK = RAW + """,
medians AS (SELECT median(algebra) AS m1, median(networks) AS m2, median(rhetoric) AS m3 FROM raw),
filled AS (
  SELECT student_name, roll, department, year, attendance, coalesce(algebra, m1) AS algebra,
         coalesce(networks, m2) AS networks, coalesce(rhetoric, m3) AS rhetoric
  FROM raw, medians),
sums AS (
  SELECT *, algebra + networks + rhetoric AS total, round((algebra + networks + rhetoric) / 3, 2) AS average FROM filled),
book AS (
  SELECT *, CASE WHEN average >= 90 THEN 'A+' WHEN average >= 80 THEN 'A' WHEN average >= 70 THEN 'B'
                 WHEN average >= 60 THEN 'C' WHEN average >= 50 THEN 'D' ELSE 'F' END AS grade
  FROM sums)"""

MARKS = "(avg(algebra) + avg(networks) + avg(rhetoric)) / 3"
FOUND = "contains(lower(student_name), 'order#00000012')"
PERFORMANCE = """CASE WHEN average >= 80 AND attendance >= 80 THEN 'Excellent'
                      WHEN average >= 65 AND attendance >= 70 THEN 'Good'
                      WHEN average >= 50 THEN 'Average' ELSE 'At Risk' END"""


def book(select: str, more: str = "") -> str:
    """A query over the prepared gradebook."""
    return f"WITH {BOOK}{more}\n{select}"


def per_subject(columns: str, source: str = "book") -> str:
    """One row per subject; {s} stands for its column and {i} for its position."""
    return " UNION ALL ".join(
        f"SELECT {columns.format(s=s, i=i)} FROM {source}" for i, s in enumerate(SUBJECTS)
    )


SCORES = ",\nscores AS (" + per_subject("{i} AS position, '{s}' AS subject, student_name, roll, {s} AS score") + ")"
STATS = (
    "{i} AS position, '{s}' AS subject, round(avg({s}), 2) AS average, max({s}) AS max, min({s}) AS min, "
    "round(stddev_samp({s}), 2) AS std"
)
TOP3 = SCORES + """,
best AS (
  SELECT subject, row_number() OVER (PARTITION BY subject ORDER BY score DESC, roll) AS rank, student_name AS name, score
  FROM scores QUALIFY rank <= 3)"""


def attendance_stats(threshold: str) -> str:
    return book(f"""
SELECT round(avg(attendance), 2) AS average_attendance, max(attendance) AS max_attendance,
       min(attendance) AS min_attendance, count(*) FILTER (WHERE attendance < {threshold}) AS students_below_threshold,
       CAST({threshold} AS DOUBLE) AS threshold_used, count(*) FILTER (WHERE attendance >= 90) AS excellent,
       count(*) FILTER (WHERE attendance >= 75 AND attendance < 90) AS good,
       count(*) FILTER (WHERE attendance < 75) AS low
FROM book""")


def with_grades(where: str) -> str:
    return book(f"""
SELECT s.department, s.count, s.avg_marks, s.avg_attendance, g.grade, g.grade_count
FROM (SELECT department, count(*) AS count, round({MARKS}, 2) AS avg_marks,
             round(avg(attendance), 2) AS avg_attendance FROM book WHERE {where} GROUP BY department) s
JOIN (SELECT department, grade, count(*) AS grade_count FROM book GROUP BY department, grade) g USING (department)""")


def compared(wanted: list[tuple[int, str]], match: str) -> str:
    rows = ", ".join(f"({i}, {text(name)})" for i, name in wanted)
    return f""",
wanted(position, student) AS (VALUES {rows}),
hits AS (
  SELECT w.position, w.student, algebra, networks, rhetoric, average, attendance
  FROM wanted w JOIN book ON {match}
  QUALIFY row_number() OVER (PARTITION BY w.position ORDER BY roll) = 1)"""


PARTIAL = "contains(lower(student_name), lower(w.student))"
SIDE_BY_SIDE = "SELECT * FROM hits WHERE (SELECT count(*) FROM hits) >= 2"
COMPARED = compared(list(enumerate(["order#00000012", "ORDER#000000346", ".", "nobody"])), PARTIAL)

FIT = """,
fit AS (
  SELECT regr_slope(average, algebra) AS b, regr_intercept(average, algebra) AS a FROM book WHERE year < 2000)"""

# three features: covariances of the training rows, and the normal equations by determinants
FIT3 = """,
train AS (SELECT algebra AS x1, networks AS x2, attendance AS x3, rhetoric AS y FROM book WHERE year < 2000),
cov AS (
  SELECT var_pop(x1) AS s11, covar_pop(x1, x2) AS s12, covar_pop(x1, x3) AS s13, var_pop(x2) AS s22,
         covar_pop(x2, x3) AS s23, var_pop(x3) AS s33, covar_pop(x1, y) AS c1, covar_pop(x2, y) AS c2,
         covar_pop(x3, y) AS c3, avg(x1) AS m1, avg(x2) AS m2, avg(x3) AS m3, avg(y) AS my
  FROM train),
det AS (
  SELECT *, s11 * (s22 * s33 - s23 * s23) - s12 * (s12 * s33 - s23 * s13) + s13 * (s12 * s23 - s22 * s13) AS d FROM cov),
slopes AS (
  SELECT *, (c1 * (s22 * s33 - s23 * s23) - s12 * (c2 * s33 - s23 * c3) + s13 * (c2 * s23 - s22 * c3)) / d AS b1,
         (s11 * (c2 * s33 - s23 * c3) - c1 * (s12 * s33 - s23 * s13) + s13 * (s12 * c3 - c2 * s13)) / d AS b2,
         (s11 * (s22 * c3 - c2 * s23) - s12 * (s12 * c3 - c2 * s13) + c1 * (s12 * s23 - s22 * s13)) / d AS b3
  FROM det),
fit3 AS (SELECT b1, b2, b3, my - b1 * m1 - b2 * m2 - b3 * m3 AS a FROM slopes)"""

CHUNKS = """,
chunks AS (
  SELECT 'row:' || roll AS chunk_id, 'row' AS kind,
         'Student: ' || student_name || ' | Department: ' || department || ' | Attendance: ' || attendance || '%'
         || ' | algebra: ' || algebra || ' | networks: ' || networks || ' | rhetoric: ' || rhetoric
         || ' | Average: ' || average || ' | Grade: ' || grade AS text
  FROM book
  UNION ALL
  SELECT 'department:' || department, 'department',
         'Department summary: ' || department || ' | Count: ' || count(*)
         || printf(' | Avg algebra: %.1f | Avg networks: %.1f | Avg rhetoric: %.1f | Avg Attendance: %.1f%%',
                   round(avg(algebra), 1), round(avg(networks), 1), round(avg(rhetoric), 1), round(avg(attendance), 1))
  FROM book GROUP BY department)"""

TOKENS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')"
STOP = ", ".join(text(w) for w in STOP_WORDS)


def tfidf(chunks: str, queries: str = "SELECT NULL AS query_id, '' AS text WHERE false", limit: str = "LIMIT 5000") -> str:
    """Vocabulary, chunk weights, query weights and cosines of a corpus given by two selects."""
    return f"""
corpus AS ({chunks}),
asked AS ({queries}),
tf AS (
  SELECT chunk_id, term, count(*) AS tf FROM (SELECT chunk_id, unnest({TOKENS}) AS term FROM corpus)
  WHERE term NOT IN ({STOP}) GROUP BY chunk_id, term),
terms AS (
  SELECT term, df, total, ln((1.0 + n) / (1 + df)) + 1 AS idf
  FROM (SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS total FROM tf GROUP BY term
        ORDER BY total DESC, term {limit}), (SELECT count(*) AS n FROM corpus)),
weighted AS (SELECT chunk_id, term, tf * idf AS w FROM tf JOIN terms USING (term)),
weights AS (SELECT chunk_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY chunk_id)) AS w FROM weighted),
asked_weighted AS (
  SELECT query_id, term, count(*) * any_value(idf) AS w
  FROM (SELECT query_id, unnest({TOKENS}) AS term FROM asked) JOIN terms USING (term) GROUP BY query_id, term),
asked_weights AS (
  SELECT query_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY query_id)) AS w FROM asked_weighted),
cosines AS (
  SELECT query_id, chunk_id, round(sum(a.w * c.w), 9) AS score
  FROM asked_weights a JOIN weights c USING (term) GROUP BY query_id, chunk_id)"""


def best(k: int) -> str:
    return f"""
best AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank, chunk_id, score
  FROM cosines QUALIFY rank <= {k})"""


def contexts(order: str = "rank") -> str:
    return f"""
contexts AS (
  SELECT query_id, coalesce(context, 'No relevant data found.') AS context
  FROM asked LEFT JOIN (
    SELECT query_id, string_agg('- ' || corpus.text, chr(10) ORDER BY {order}) AS context
    FROM best JOIN corpus USING (chunk_id) GROUP BY query_id) USING (query_id))"""


DOCUMENTS = "SELECT doc_id AS chunk_id, text FROM documents"
PASSAGES = "SELECT item_id AS query_id, text FROM benchmark"
SAMPLES = "SELECT * FROM (VALUES " + ", ".join(
    f"('sample:{i:02d}', {text(q)})" for i, q in enumerate(SAMPLE_QUESTIONS)
) + ") AS t(query_id, text)"
ASKED = f"""{SAMPLES}
  UNION ALL SELECT DISTINCT 'group:' || department, 'Compare algebra and grade of ' || department FROM raw
  UNION ALL SELECT 'turn:' || conv_id || ':' || turn, text FROM conversations WHERE role = 'user'"""

# The words of each intent, in the order in which they are tried.
INTENT_WORDS = {
    "summary": ["summary", "overview", "about"],
    "count": ["total", "how many", "count"],
    "department": ["department", "dept", "branch"],
    "top": ["top", "best", "highest", "topper"],
    "attendance": ["attendance", "absent", "present"],
    "subject": ["subject", "marks", "score"],
}
INTENT = "CASE " + " ".join(
    "WHEN " + " OR ".join(f"contains(lower(text), {text(w)})" for w in group) + f" THEN '{name}'"
    for name, group in INTENT_WORDS.items()
) + " ELSE 'retrieval' END"


def keyword(chunks: str) -> str:
    return f"""
corpus AS ({chunks}),
asked AS ({SAMPLES}),
words AS (
  SELECT query_id, word, count(*) AS times
  FROM (SELECT query_id, unnest(regexp_split_to_array(lower(text), '\\s+')) AS word FROM asked)
  WHERE word <> '' GROUP BY query_id, word),
scored AS (
  SELECT query_id, chunk_id, CAST(sum(times) AS BIGINT) AS score
  FROM corpus JOIN words ON contains(lower(corpus.text), word) GROUP BY query_id, chunk_id)"""


HEADS = """
heads AS (
  SELECT conv_id, turn, role, text FROM conversations
  QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) = 1 AND role = 'system')"""


def kept(n: int) -> str:
    """The last n messages, or the first system message and the last n - 1."""
    return f"""
WITH ranked AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back,
         min(turn) FILTER (WHERE role = 'system') OVER (PARTITION BY conv_id) AS head
  FROM conversations),
placed AS (SELECT *, max(turn) FILTER (WHERE back = {n}) OVER (PARTITION BY conv_id) AS oldest FROM ranked)
SELECT conv_id, turn, role, text FROM placed
WHERE CASE WHEN head < oldest THEN back < {n} OR turn = head ELSE back <= {n} END"""


DOCUMENTS_BY_INTENT = f"""
documents_by_intent AS (
  SELECT 'summary' AS intent, CAST(json_object(
    'total_students', count(*), 'total_columns', 11, 'columns', ['student_name', 'roll', 'department', 'year',
      'attendance', 'algebra', 'networks', 'rhetoric', 'Total', 'Average', 'Grade'],
    'n_departments', count(DISTINCT department), 'departments', list_sort(list(DISTINCT department)),
    'subject_columns', ['algebra', 'networks', 'rhetoric'], 'has_attendance', true, 'has_subjects', true,
    'average_marks', round({MARKS}, 2), 'average_attendance', round(avg(attendance), 2),
    'class_average', CAST(round(avg(CAST(average AS DECIMAL(10, 2))), 2) AS DOUBLE)) AS VARCHAR) AS answer FROM book
  UNION ALL SELECT 'count', CAST(json_object('total_students', count(*)) AS VARCHAR) FROM book
  UNION ALL
  SELECT 'department', '[' || string_agg('{{"department":"' || department || '","count":' || n || ',"avg_marks":' || marks
    || ',"avg_attendance":' || att || ',"grade_dist":{{' || dist || '}}}}', ',' ORDER BY department) || ']'
  FROM (SELECT department, count(*) AS n, round({MARKS}, 2) AS marks, round(avg(attendance), 2) AS att
        FROM book GROUP BY department)
  JOIN (SELECT department, string_agg('"' || grade || '":' || n, ',' ORDER BY list_position(['A+', 'A', 'B', 'C', 'D', 'F'], grade)) AS dist
        FROM (SELECT department, grade, count(*) AS n FROM book GROUP BY department, grade) GROUP BY department)
    USING (department)
  UNION ALL
  SELECT 'top', '[' || string_agg(CAST(json_object('name', student_name, 'score', average, 'department', department,
    'attendance', attendance) AS VARCHAR), ',' ORDER BY average DESC, roll) || ']'
  FROM (SELECT * FROM book ORDER BY average DESC, roll LIMIT 5)
  UNION ALL
  SELECT 'attendance', CAST(json_object('average_attendance', round(avg(attendance), 2),
    'max_attendance', max(attendance), 'min_attendance', min(attendance),
    'students_below_threshold', count(*) FILTER (WHERE attendance < 75), 'threshold_used', CAST(75 AS DOUBLE),
    'excellent', count(*) FILTER (WHERE attendance >= 90),
    'good', count(*) FILTER (WHERE attendance >= 75 AND attendance < 90),
    'low', count(*) FILTER (WHERE attendance < 75)) AS VARCHAR) FROM book
  UNION ALL
  SELECT 'subject', '[' || string_agg('{{"subject":"' || s.subject || '","position":' || position || ',"average":' || average
    || ',"max":' || max || ',"min":' || min || ',"std":' || std || ',"top_3":[' || top_3 || ']}}', ',' ORDER BY position) || ']'
  FROM ({per_subject(STATS)}) s
  JOIN (SELECT subject, string_agg(CAST(json_object('name', name, 'score', score) AS VARCHAR), ',' ORDER BY rank) AS top_3
        FROM best3 GROUP BY subject) b ON s.subject = b.subject)"""

ORDERS = "listed AS (SELECT o_orderkey AS roll, o_orderpriority AS department, o_orderkey % 101 AS marks FROM orders)"

RAW_TABLE = f"WITH {RAW} SELECT * FROM raw"

# least squares by taking one feature after the other out of the rest, on the training rows; e is what is left of the target
ORTHOGONAL = """,
marked AS (SELECT *, md5(roll || '|' || student_name || '|42') < '33333333' AS test FROM book),
means AS (SELECT avg(algebra) AS a, avg(networks) AS b, avg(rhetoric) AS c, avg(attendance) AS d, avg(average) AS y FROM marked WHERE NOT test),
d0 AS (SELECT test, algebra - a AS x1, networks - b AS x2, rhetoric - c AS x3, attendance - d AS x4, average - y AS y, average - y AS e FROM marked, means),
p1 AS (SELECT sum(x1 * x2) / sum(x1 * x1) AS b2, sum(x1 * x3) / sum(x1 * x1) AS b3, sum(x1 * x4) / sum(x1 * x1) AS b4, sum(x1 * e) / sum(x1 * x1) AS be
       FROM d0 WHERE NOT test),
d1 AS (SELECT test, x2 - b2 * x1 AS x2, x3 - b3 * x1 AS x3, x4 - b4 * x1 AS x4, y, e - be * x1 AS e FROM d0, p1),
p2 AS (SELECT sum(x2 * x3) / sum(x2 * x2) AS b3, sum(x2 * x4) / sum(x2 * x2) AS b4, sum(x2 * e) / sum(x2 * x2) AS be FROM d1 WHERE NOT test),
d2 AS (SELECT test, x3 - b3 * x2 AS x3, x4 - b4 * x2 AS x4, y, e - be * x2 AS e FROM d1, p2),
p3 AS (SELECT sum(x3 * x4) / sum(x3 * x3) AS b4, sum(x3 * e) / sum(x3 * x3) AS be FROM d2 WHERE NOT test),
d3 AS (SELECT test, x4 - b4 * x3 AS x4, y, e - be * x3 AS e FROM d2, p3),
p4 AS (SELECT sum(x4 * e) / sum(x4 * x4) AS be FROM d3 WHERE NOT test),
d4 AS (SELECT test, y, e - be * x4 AS e FROM d3, p4)"""


ORACLE_SQL: dict[str, str] = {
    "prepared_rows": book("SELECT * FROM book"),
    "infer_types": """
WITH cells AS (
  SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'absent' ELSE CAST(value AS VARCHAR) END AS mostly_num,
         CASE WHEN event_id % 10 < 3 THEN 'x' ELSE CAST(value AS VARCHAR) END AS edge_num,
         CASE WHEN event_id % 2 = 0 THEN 'x' ELSE CAST(value AS VARCHAR) END AS few_num, event_type
  FROM events),
shares AS (
  SELECT avg(CASE WHEN try_cast(mostly_num AS DOUBLE) IS NULL THEN 0 ELSE 1 END) AS s1,
         avg(CASE WHEN try_cast(edge_num AS DOUBLE) IS NULL THEN 0 ELSE 1 END) AS s2,
         avg(CASE WHEN try_cast(few_num AS DOUBLE) IS NULL THEN 0 ELSE 1 END) AS s3,
         median(try_cast(mostly_num AS DOUBLE)) AS m1, median(try_cast(edge_num AS DOUBLE)) AS m2,
         median(try_cast(few_num AS DOUBLE)) AS m3
  FROM cells)
SELECT 0 AS position, 'event_id' AS column, 'bigint' AS dtype, count(*) AS present,
       CAST(sum(event_id) AS DOUBLE) AS total FROM cells
UNION ALL
SELECT 1, 'mostly_num', CASE WHEN any_value(s1) > 0.7 THEN 'double' ELSE 'string' END, count(*),
       CASE WHEN any_value(s1) > 0.7 THEN round(sum(coalesce(try_cast(mostly_num AS DOUBLE), m1)), 4) END FROM cells, shares
UNION ALL
SELECT 2, 'edge_num', CASE WHEN any_value(s2) > 0.7 THEN 'double' ELSE 'string' END, count(*),
       CASE WHEN any_value(s2) > 0.7 THEN round(sum(coalesce(try_cast(edge_num AS DOUBLE), m2)), 4) END FROM cells, shares
UNION ALL
SELECT 3, 'few_num', CASE WHEN any_value(s3) > 0.7 THEN 'double' ELSE 'string' END, count(*),
       CASE WHEN any_value(s3) > 0.7 THEN round(sum(coalesce(try_cast(few_num AS DOUBLE), m3)), 4) END FROM cells, shares
UNION ALL
SELECT 4, 'event_type', 'string', count(*), NULL FROM cells""",
    "subject_detection": book(" UNION ALL ".join(
        f"SELECT '{shown}' AS column, CAST(min({c}) AS DOUBLE) AS low, CAST(max({c}) AS DOUBLE) AS high, "
        f"({'true' if c in SUBJECTS else 'false'} AND min({c}) >= 0 AND max({c}) <= 150) AS is_subject FROM book"
        for c, shown in [("roll", "roll"), ("year", "year"), ("attendance", "attendance"), ("algebra", "algebra"),
                         ("networks", "networks"), ("rhetoric", "rhetoric"), ("total", "Total"), ("average", "Average")]
    )),
    "column_mapping": """
SELECT * FROM (VALUES
  (0, 'Student Name', 'student_name'), (1, 'Department', 'department'), (2, 'Attendance', 'attendance'),
  (3, 'Roll No', 'roll'), (4, 'Year/Semester', 'year'), (5, 'Subject Columns', 'algebra, networks, rhetoric')
) AS t(position, role, "column")""",
    "dataset_profile": f"WITH {RAW} " + " UNION ALL ".join(
        f"SELECT {i} AS position, '{c}' AS column, '{t}' AS dtype, count({c}) AS non_null, count(*) AS rows FROM raw"
        for i, (c, t) in enumerate([
            ("student_name", "string"), ("roll", "bigint"), ("department", "string"), ("year", "int"),
            ("attendance", "double"), ("algebra", "double"), ("networks", "double"), ("rhetoric", "double"),
        ])
    ),
    "departments": book("SELECT DISTINCT department FROM book"),
    "preview_rows": book(
        'SELECT roll, student_name, department, attendance, average AS "Average" FROM book ORDER BY roll LIMIT 20'
    ),
    "preview_csv": book("""
SELECT 0 AS line, 'student_name,roll,department,year,attendance,algebra,networks,rhetoric,Total,Average,Grade' AS text
UNION ALL
SELECT row_number() OVER (ORDER BY roll), concat_ws(',', student_name, roll, department, year, attendance, algebra,
       networks, rhetoric, total, average, grade)
FROM (SELECT * FROM book ORDER BY roll LIMIT 50)"""),
    "text_functions": """
SELECT doc_id, contains(lower(text), 'the.') AS found,
       CASE WHEN length(text) > 100 THEN left(text, 100) || '…' ELSE text END AS short
FROM documents""",
    "number_functions": f"""WITH {RAW}
SELECT department, round(coalesce(avg(algebra), 0.0), 2) AS mean_algebra,
       coalesce(avg(CASE WHEN attendance > 1000 THEN algebra END), 0.0) AS mean_of_none,
       round(100.0 * count(*) FILTER (WHERE attendance < 75) / count(*), 2) AS low_share,
       CAST(0 AS DOUBLE) AS share_of_none, printf('%.1f', round(avg(attendance), 1)) AS attendance_text
FROM raw GROUP BY department""",
    "dataset_summary": book(f"""
SELECT count(*) AS total_students, 11 AS total_columns,
       'student_name,roll,department,year,attendance,algebra,networks,rhetoric,Total,Average,Grade' AS columns,
       count(DISTINCT department) AS n_departments,
       array_to_string(list_sort(list(DISTINCT department)), ',') AS departments,
       'algebra,networks,rhetoric' AS subject_columns, true AS has_attendance, true AS has_subjects,
       round({MARKS}, 2) AS average_marks, round(avg(attendance), 2) AS average_attendance,
       CAST(round(avg(CAST(average AS DECIMAL(10, 2))), 2) AS DOUBLE) AS class_average
FROM book"""),
    "row_count": book("SELECT count(*) AS total_students FROM book"),
    "department_stats": with_grades("true"),
    "department_stats_filtered": with_grades("contains(lower(department), 'i')"),
    "department_grades": book("SELECT department, grade, count(*) AS count FROM book GROUP BY department, grade"),
    "department_table": book(f"""
SELECT department, count(*) AS count, round({MARKS}, 2) AS avg_marks, round(avg(attendance), 2) AS avg_attendance
FROM book GROUP BY department ORDER BY count DESC, department"""),
    "top_rows": book("""
SELECT student_name AS name, average AS score, department, attendance FROM book ORDER BY average DESC, roll LIMIT 5"""),
    "name_search": book(f"""
SELECT student_name, roll, department, attendance, average, (SELECT count(*) FROM book WHERE {FOUND}) AS match_count
FROM book WHERE {FOUND} ORDER BY roll LIMIT 3"""),
    "matching_rows": book(f"SELECT roll, student_name, grade FROM book WHERE {FOUND}"),
    "subject_stats": book(per_subject(STATS)),
    "subject_metrics": book("""
SELECT round(avg(networks), 2) AS average, max(networks) AS max, min(networks) AS min,
       round(stddev_samp(networks), 2) AS std FROM book"""),
    "subject_table": book(f"SELECT subject, average, max, min, std FROM ({per_subject(STATS)}) ORDER BY average DESC, subject"),
    "subject_top3": book("SELECT * FROM best", TOP3),
    "subject_analysis": book(f"""
SELECT s.subject, position, average, max, min, std, top_3 FROM ({per_subject(STATS)}) s
JOIN (SELECT subject, string_agg(name || '=' || score, ',' ORDER BY rank) AS top_3 FROM best GROUP BY subject) b
  ON s.subject = b.subject""", TOP3),
    "attendance_stats": attendance_stats("75"),
    "attendance_stats_at_60": attendance_stats("60"),
    "attendance_bands": book("""
SELECT 'excellent (>=90%)' AS band, count(*) FILTER (WHERE attendance >= 90) AS count FROM book
UNION ALL SELECT 'good (75-90%)', count(*) FILTER (WHERE attendance >= 75 AND attendance < 90) FROM book
UNION ALL SELECT 'low (<75%)', count(*) FILTER (WHERE attendance < 75) FROM book"""),
    "attendance_low_by_dept": book("""
SELECT department, count(*) AS count FROM book WHERE attendance < 75 GROUP BY department
ORDER BY count DESC, department LIMIT 5"""),
    "performance_class": book(f"""
SELECT roll, student_name AS student, {PERFORMANCE} AS predicted_performance, average AS average_marks,
       'rule-based' AS method FROM book"""),
    "predict_by_rule": book(f"""
SELECT student_name AS student, {PERFORMANCE} AS predicted_performance, average AS average_marks, 'rule-based' AS method
FROM book WHERE {FOUND} ORDER BY roll LIMIT 1"""),
    "predict_by_model": book(f"""
SELECT student_name AS student, round(a + b * algebra, 2) AS predicted_value, 'ML regression' AS method
FROM book, fit WHERE {FOUND} ORDER BY roll LIMIT 1""", FIT),
    "profiles": book(f"""
SELECT (SELECT count(*) FROM book WHERE {FOUND}) AS match_count, student_name AS name, department, roll, year, attendance,
       average, grade, round(a + b * algebra, 2) AS predicted_average,
       CAST(json_object('student_name', student_name, 'roll', CAST(roll AS DOUBLE), 'department', department,
         'year', CAST(year AS DOUBLE), 'attendance', attendance, 'algebra', algebra, 'networks', networks,
         'rhetoric', rhetoric, 'Total', total, 'Average', average, 'Grade', grade) AS VARCHAR) AS record
FROM book, fit WHERE {FOUND} ORDER BY roll LIMIT 5""", FIT),
    "student_names": book("SELECT DISTINCT student_name AS name FROM book"),
    "compare": book(SIDE_BY_SIDE, COMPARED),
    "compare_exact": book(SIDE_BY_SIDE, compared(
        list(enumerate(["Order#000000012", "Order#000000346", "order#000000067"])), "student_name = w.student"
    )),
    "compare_too_few": book(SIDE_BY_SIDE, compared(list(enumerate(["order#000000346", "nobody"])), PARTIAL)),
    "subject_means": book(per_subject("{i} AS position, '{s}' AS subject, round(avg({s}), 6) AS average_marks")),
    "department_share": book("""
SELECT department, count(*) AS count, round(count(*) * 100.0 / (SELECT count(*) FROM book), 2) AS percent
FROM book GROUP BY department"""),
    "attendance_histogram": book("""
SELECT bin, low, high, count(attendance) AS count, low <= 75 AND 75 < high AS holds_marker
FROM (SELECT i AS bin, lo + (i - 1) * ((hi - lo) / 20) AS low, lo + i * ((hi - lo) / 20) AS high
      FROM (SELECT unnest(range(1, 21)) AS i),
           (SELECT min(attendance) AS lo, max(attendance) AS hi FROM book)) bins
LEFT JOIN (SELECT attendance, least(CAST(floor(20 * (attendance - lo) / (hi - lo)) AS BIGINT) + 1, 20) AS b
           FROM book, (SELECT min(attendance) AS lo, max(attendance) AS hi FROM book)) ON b = bin
GROUP BY bin, low, high"""),
    "dept_marks": book(f"SELECT department, round({MARKS}, 6) AS average_marks FROM book GROUP BY department"),
    "grade_counts": book("""
SELECT grade, count(*) AS count, list_position(['A+', 'A', 'B', 'C', 'D', 'F'], grade) AS position
FROM book GROUP BY grade"""),
    "student_scores": book(f"""
SELECT s.student_name AS name, roll, position, subject, score
FROM scores s JOIN (SELECT roll FROM book WHERE {FOUND} ORDER BY roll LIMIT 5) USING (roll)""", SCORES),
    "comparison_scores": book(
        "SELECT * FROM (" + per_subject(
            "position, student, {i} AS subject_position, '{s}' AS subject, coalesce({s}, 0) AS score", "hits"
        ) + ") WHERE (SELECT count(*) FROM hits) >= 2", COMPARED,
    ),
    "subject_top_n": book("SELECT student_name AS name, rhetoric AS score FROM book ORDER BY rhetoric DESC, roll LIMIT 10"),
    "score_quartiles": book("""
SELECT any_value(s.position) AS position, s.subject, min(score) AS min, any_value(q1) AS q1, any_value(q2) AS median,
       any_value(q3) AS q3, max(score) AS max, min(score) FILTER (WHERE score >= q1 - 1.5 * (q3 - q1)) AS whisker_low,
       max(score) FILTER (WHERE score <= q3 + 1.5 * (q3 - q1)) AS whisker_high
FROM scores s JOIN (SELECT subject, quantile_cont(score, 0.25) AS q1, quantile_cont(score, 0.5) AS q2,
                           quantile_cont(score, 0.75) AS q3 FROM scores GROUP BY subject) q ON s.subject = q.subject
GROUP BY s.subject""", SCORES),
    "regression_one_feature": book("""
SELECT round(1 - sum((average - a - b * algebra) ** 2) FILTER (WHERE year >= 2000)
         / (var_pop(average) FILTER (WHERE year >= 2000) * count(*) FILTER (WHERE year >= 2000)), 4) AS r2,
       round(avg(abs(average - a - b * algebra)) FILTER (WHERE year >= 2000), 4) AS mae,
       count(*) FILTER (WHERE year < 2000) AS train_samples, count(*) FILTER (WHERE year >= 2000) AS test_samples
FROM book, fit""", FIT),
    "predict_one_feature": book("SELECT roll, round(a + b * algebra, 4) AS predicted_average FROM book, fit", FIT),
    "batch_predict": book("SELECT roll, round(a + b1 * algebra + b2 * networks + b3 * attendance, 4) AS predicted_rhetoric FROM book, fit3", FIT3),
    "chunk_corpus": book("SELECT * FROM chunks", CHUNKS),
    "tfidf_terms": f"WITH {tfidf(DOCUMENTS)} SELECT term, df, total, round(idf, 6) AS idf FROM terms",
    "tfidf_weights": f"""WITH {tfidf(DOCUMENTS)}
SELECT chunk_id, count(*) AS terms, round(sum(w), 6) AS sum_weight, round(max(w), 6) AS max_weight
FROM weights GROUP BY chunk_id""",
    "tfidf_topk": f"""WITH {tfidf(DOCUMENTS, PASSAGES)},{best(6)}
SELECT query_id, rank, chunk_id, round(score, 6) AS score FROM best""",
    "tfidf_topk_all_terms": f"""WITH {tfidf(DOCUMENTS, PASSAGES, "")},{best(6)}
SELECT query_id, rank, chunk_id, round(score, 6) AS score FROM best""",
    "keyword_topk": f"""WITH {keyword(DOCUMENTS)}
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank, chunk_id, score
FROM scored QUALIFY rank <= 6""",
    "keyword_topk_padded": f"""WITH {BOOK}{CHUNKS},{keyword("SELECT chunk_id, text FROM chunks")}
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank, chunk_id, score
FROM (SELECT query_id, chunk_id, coalesce(score, 0) AS score
      FROM (SELECT query_id, chunk_id FROM asked, corpus) LEFT JOIN scored USING (query_id, chunk_id))
QUALIFY rank <= 6""",
    "knn_topk": """
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(d, 9), chunk_id) AS rank, chunk_id,
       round(d, 6) AS distance
FROM (SELECT a.vec_id AS query_id, b.vec_id AS chunk_id,
             list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) ** 2 AS d
      FROM embeddings a, embeddings b)
QUALIFY rank <= 6""",
    "context_blocks": f"WITH {tfidf(DOCUMENTS, PASSAGES)},{best(6)},{contexts()} SELECT * FROM contexts",
    "augmented_prompts": f"""WITH {tfidf(DOCUMENTS, PASSAGES)},{best(6)},{contexts()}
SELECT query_id, CASE WHEN context = 'No relevant data found.' THEN text
  ELSE text || chr(10) || chr(10) || '[Retrieved dataset context]' || chr(10)
       || CASE WHEN length(context) > 1500 THEN left(context, 1500) || '…' ELSE context END END AS prompt
FROM asked JOIN contexts USING (query_id)""",
    "buffer_last_n": kept(4),
    "buffer_default": kept(12),
    "buffer_stream": kept(4),
    "set_system": f"""WITH {HEADS},
starts AS (SELECT conv_id, min(turn) AS start FROM conversations GROUP BY conv_id)
SELECT conv_id, turn, role, CASE WHEN turn = start AND role = 'system' THEN 'Answer briefly.' ELSE text END AS text
FROM conversations JOIN starts USING (conv_id)
UNION ALL
SELECT conv_id, start - 1, 'system', 'Answer briefly.' FROM starts WHERE conv_id NOT IN (SELECT conv_id FROM heads)""",
    "messages_in_order": "SELECT conv_id, turn, role, text FROM conversations ORDER BY conv_id, turn",
    "recent_n": """
SELECT conv_id, turn, role, text, 0 AS part FROM conversations WHERE role = 'system'
UNION ALL
SELECT conv_id, turn, role, text, 1 FROM (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations WHERE role <> 'system')
WHERE back <= 3""",
    "prompt_text": """
SELECT conv_id, string_agg(CASE role WHEN 'user' THEN 'User: ' ELSE 'Assistant: ' END || text, chr(10) ORDER BY turn) AS prompt
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations WHERE role <> 'system')
WHERE back <= 10 GROUP BY conv_id""",
    "cleared": "SELECT conv_id, turn, role, text FROM conversations WHERE role = 'system'",
    "history": "SELECT conv_id, turn, role, text FROM conversations WHERE role <> 'system'",
    "history_counts": """
SELECT conv_id, count(*) AS messages, count(*) FILTER (WHERE role <> 'system') AS history FROM conversations GROUP BY conv_id""",
    "transcripts": """
SELECT conv_id, turn // 1000 AS segment,
       string_agg(CASE role WHEN 'user' THEN 'User: ' ELSE 'Agent: ' END || text, chr(10) || chr(10) ORDER BY turn) AS transcript
FROM conversations WHERE role <> 'system' GROUP BY conv_id, segment""",
    "route_intents": f"""WITH {RAW},
asked AS (SELECT 'document:' || doc_id AS query_id, text FROM documents UNION ALL {ASKED})
SELECT query_id, {INTENT} AS intent FROM asked""",
    "answers": f"""WITH {BOOK}{TOP3.replace("best AS", "best3 AS")}{CHUNKS},{DOCUMENTS_BY_INTENT},
routed AS (SELECT query_id, text, {INTENT} AS intent FROM ({ASKED})),
{tfidf("SELECT chunk_id, text FROM chunks", "SELECT query_id, text FROM routed WHERE intent = 'retrieval'")},{best(5)},{contexts()}
SELECT query_id, intent, answer FROM routed JOIN documents_by_intent USING (intent)
UNION ALL SELECT query_id, 'retrieval', context FROM contexts""",
    "csv_round_trip": RAW_TABLE,
    "json_round_trip": RAW_TABLE,
    "parquet_round_trip": RAW_TABLE,
    "search_export": book(f"SELECT roll, student_name, attendance, total FROM book WHERE {FOUND}"),
    "wide_departments": book(f"""
SELECT 'D' || roll AS department, 1 AS count, round((algebra + networks + rhetoric) / 3, 2) AS avg_marks,
       round(attendance, 2) AS avg_attendance, grade, 1 AS grade_count FROM book"""),
    "wide_summary": book("""
SELECT count(*) AS total_students, count(*) AS n_departments, md5(string_agg('D' || roll, ',' ORDER BY 'D' || roll)) AS departments_md5
FROM book"""),
    "text_gaps": f"""WITH {RAW}
SELECT CASE WHEN roll % 7 > 0 THEN department ELSE 'Unknown' END AS department, count(*) AS count FROM raw GROUP BY 1""",
    "regression_default": book("""
SELECT round(1 - sum(e * e) FILTER (WHERE test) / (var_pop(y) FILTER (WHERE test) * count(*) FILTER (WHERE test)), 4) AS r2,
       round(avg(abs(e)) FILTER (WHERE test), 4) AS mae,
       count(*) FILTER (WHERE NOT test) AS train_samples, count(*) FILTER (WHERE test) AS test_samples
FROM d4""", ORTHOGONAL),
    "regression_split": book("""
SELECT round(1 - sum((average - a - b * algebra) ** 2) FILTER (WHERE test)
         / (var_pop(average) FILTER (WHERE test) * count(*) FILTER (WHERE test)), 4) AS r2,
       round(avg(abs(average - a - b * algebra)) FILTER (WHERE test), 4) AS mae,
       count(*) FILTER (WHERE NOT test) AS train_samples, count(*) FILTER (WHERE test) AS test_samples
FROM marked, split_fit""", """,
marked AS (SELECT *, md5(roll || '|' || student_name || '|42') < '33333333' AS test FROM book),
split_fit AS (SELECT regr_slope(average, algebra) AS b, regr_intercept(average, algebra) AS a FROM marked WHERE NOT test)"""),
    "predict_with_gaps": book("""
SELECT roll, round(a + b * CASE WHEN roll % 10 IN (1, 2) THEN 0 ELSE algebra END, 4) AS predicted_average FROM book, fit""", FIT),
    "sample_chunks": book("""
SELECT chunk_id, kind, text FROM chunks WHERE kind = 'row' ORDER BY md5(chunk_id || '#42'), chunk_id LIMIT 2000""", CHUNKS),
    "repeated_rolls": book("""
SELECT CASE WHEN count(*) OVER (PARTITION BY shown) > 1 THEN md5(text) END AS own, text
FROM (SELECT CASE WHEN roll % 11 > 0 THEN CAST(roll // 10 AS DOUBLE) ELSE middle END AS shown,
             'Student: ' || student_name || ' | Department: ' || department || ' | Attendance: ' || attendance || '%'
             || ' | algebra: ' || algebra || ' | networks: ' || networks || ' | rhetoric: ' || rhetoric
             || ' | Average: ' || average || ' | Grade: ' || grade AS text
      FROM book, (SELECT median(roll // 10) AS middle FROM book WHERE roll % 11 > 0))"""),
    "reset_conversations": """
WITH found AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM conversations WHERE role = 'system')
SELECT conv_id, turn, role, CASE WHEN place = 1 THEN 'Answer briefly.' ELSE text END AS text FROM found
UNION ALL
SELECT DISTINCT conv_id, CAST(0 AS BIGINT), 'system', 'Answer briefly.' FROM conversations
WHERE conv_id NOT IN (SELECT conv_id FROM found)""",
    "long_buffers": kept(12).replace("WITH ranked", """
WITH long_log AS (
  SELECT conv_id // 40 AS conv_id, row_number() OVER (PARTITION BY conv_id // 40 ORDER BY conv_id, turn) - 1 AS turn, role, text
  FROM conversations),
ranked""").replace("FROM conversations),\nplaced", "FROM long_log),\nplaced"),
    "csv_ragged": f"""WITH {ORDERS}
SELECT roll, CASE WHEN roll % 4 = 0 THEN 'x' ELSE 'x, y' END AS word, CASE WHEN roll % 4 = 1 THEN CAST(marks AS DOUBLE) END AS marks
FROM listed WHERE roll % 4 < 2""",
    "csv_mixed_headers": f"""WITH {ORDERS}
SELECT roll, marks, CASE WHEN roll % 2 = 1 THEN department END AS department FROM listed""",
    "csv_latin1": f"WITH {ORDERS} SELECT roll, 'José Ñandú ' || roll AS name FROM listed",
    "csv_line_breaks": f"""WITH {ORDERS}
SELECT roll, 'first ' || roll || chr(10) || 'second, "quoted"' || chr(10) || chr(10) || department AS note, marks FROM listed""",
    "csv_header_duplicates": f"WITH {ORDERS} SELECT roll, department FROM listed",
    "long_ids": f"""WITH {ORDERS}
SELECT '12345678901' || lpad(CAST(roll AS VARCHAR), 8, '0') AS fits, '98765432109' || lpad(CAST(roll AS VARCHAR), 8, '0') AS beyond
FROM listed""",
    "json_array": f"WITH {ORDERS} SELECT roll, department, marks FROM listed",
    "json_columns": f"WITH {ORDERS} SELECT roll, department, marks FROM listed",
    "json_index": f"WITH {ORDERS} SELECT roll, department, marks FROM listed",
}
ORACLE_SQL["transcript_files"] = ORACLE_SQL["transcripts"]
