"""Results depend on these exact words and numbers, so they are stated once, here."""

# Accepted column names per role, in order of preference.
ROLE_ALIASES = {
    "student_name": [
        "name", "student", "student_name", "studentname", "full_name",
        "fullname", "sname", "student name", "s_name",
    ],
    "department": [
        "dept", "department", "faculty", "branch", "stream",
        "program", "course", "division", "dep",
    ],
    "attendance": [
        "attendance", "attend", "attendance_pct", "attendance_%",
        "attendance_percent", "att", "present", "presence",
    ],
    "roll_no": [
        "roll", "roll_no", "rollno", "roll_number", "id",
        "student_id", "sid", "reg_no", "regno", "registration",
    ],
    "year": [
        "year", "yr", "semester", "sem", "batch", "grade",
        "class", "level", "section",
    ],
    "gender": ["gender", "sex", "g"],
    "cgpa": ["cgpa", "gpa", "grade_point", "gradepoint"],
}

# The roles that preparation looks for, and their labels in the mapping report.
DETECTED_ROLES = {
    "student_name": "Student Name",
    "department": "Department",
    "attendance": "Attendance",
    "roll_no": "Roll No",
    "year": "Year/Semester",
}

# Numeric columns with these names are never subjects.
NOT_SUBJECTS = {
    "name", "student", "roll", "id", "department", "dept",
    "attendance", "year", "semester", "gender", "cgpa", "gpa",
    "branch", "section", "batch", "class", "stream", "program",
    "grade", "level", "status", "result", "pass", "fail",
    "total", "average", "avg", "percentage", "percent", "remarks",
    "division", "rank", "serial", "no", "sr", "s.no", "index",
    "faculty", "course",
}

# The range a subject's scores must lie in.
SUBJECT_RANGE = (0, 150)

# A text column turns numeric when more than this share of all rows parses.
NUMERIC_SHARE = 0.7

# The text that replaces missing text.
MISSING_TEXT = "Unknown"

# Lowest average of each grade, best first; anything else is the last grade.
GRADE_BOUNDS = {"A+": 90, "A": 80, "B": 70, "C": 60, "D": 50}
LOWEST_GRADE = "F"
GRADE_ORDER = ["A+", "A", "B", "C", "D", "F"]

# Lowest average and attendance of each performance class, best first.
PERFORMANCE_BOUNDS = {"Excellent": (80, 80), "Good": (65, 70), "Average": (50, None)}
LOWEST_PERFORMANCE = "At Risk"
DEFAULT_ATTENDANCE = 75

# Attendance threshold and the lower edges of the upper two attendance bands.
ATTENDANCE_THRESHOLD = 75.0
BAND_EDGES = (75, 90)
BAND_LABELS = {"excellent": "excellent (>=90%)", "good": "good (75-90%)", "low": "low (<75%)"}

# Intent word groups, the first group with a word inside the lower-cased text wins.
INTENT_WORDS = {
    "summary": ["summary", "overview", "about"],
    "count": ["total", "how many", "count"],
    "department": ["department", "dept", "branch"],
    "top": ["top", "best", "highest", "topper"],
    "attendance": ["attendance", "absent", "present"],
    "subject": ["subject", "marks", "score"],
}
OTHER_INTENT = "retrieval"

# Texts of the retrieval context and of the prompt built from it.
NO_CONTEXT = "No relevant data found."
CONTEXT_HEADER = "[Retrieved dataset context]"
ELLIPSIS = "…"

# Sizes.
MAX_TERMS = 5000
MAX_SAMPLE = 2000
SAMPLE_SEED = 42
TOP_K = 6
ANSWER_TOP_K = 5
CONTEXT_CHARS = 1500
TEXT_CHARS = 2000
BUFFER_MESSAGES = 12
RECENT_MESSAGES = 6
PROMPT_MESSAGES = 10
MIN_TRAIN_ROWS = 20
HISTOGRAM_BINS = 20

# Cell texts that mean "missing" in a CSV file (the pandas reader's documented defaults).
MISSING_CELLS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# Texts of errors that callers see.
NO_DEPARTMENT = "No department column detected."
NO_ATTENDANCE = "No attendance column detected."
NO_SUBJECTS = "No subject/marks columns detected."
NO_MARKS = "No numeric marks columns found."
NO_NAME = "No student name column detected."
NO_GRADE = "No Grade column (need subject marks)"
NO_NAME_OR_SUBJECT = "Missing name or subject column"
