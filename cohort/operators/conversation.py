"""Conversation logs as tables (conv_id, turn, role, text); (conv_id, turn) is unique.

A conversation may hold a large share of all rows. Message limits are window limits that every partition applies before
the shuffle, first turns are partial aggregates over two narrow columns, and no operator gathers a whole conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from cohort import fixed_values as fv
from cohort.functions import exprs as X
from cohort.operators import reports as R
from cohort.operators import retrieval
from cohort.operators.prepare import Dataset

COLUMNS = ["conv_id", "turn", "role", "text"]

def _system(messages: DataFrame) -> DataFrame:
    return messages.where(F.col("role") == "system").select(*COLUMNS)


def _not_system(messages: DataFrame) -> DataFrame:
    return messages.where(F.col("role").isNull() | (F.col("role") != "system")).select(*COLUMNS)


def _last(messages: DataFrame, n: int) -> DataFrame:
    newest = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return messages.withColumn("back", F.row_number().over(newest)).where(F.col("back") <= n)


def _first_system(messages: DataFrame) -> DataFrame:
    """The first system message of every conversation that has one."""
    oldest = Window.partitionBy("conv_id").orderBy("turn")
    return _system(messages).withColumn("place", F.row_number().over(oldest)).where(F.col("place") == 1).drop("place")


def _leading_system(messages: DataFrame) -> DataFrame:
    """The system message of every conversation that starts with one."""
    starts = messages.groupBy("conv_id").agg(F.min("turn").alias("start"))
    return _first_system(messages).join(starts, "conv_id").where(F.col("turn") == F.col("start")).select(*COLUMNS)


def buffer(messages: DataFrame, n: int = fv.BUFFER_MESSAGES) -> DataFrame:
    """What a buffer of n messages holds after a conversation.

    The buffer drops its oldest message when it is full, but never a system message that has become its oldest. So the
    first system message stays in one of the n places, the last messages fill the others.
    """
    if n < 2:
        raise ValueError("A buffer needs at least 2 places.")
    last = _last(messages.select(*COLUMNS), n)
    head = _first_system(messages).withColumn("back", F.lit(None).cast("int"))
    # at most n + 1 candidates per conversation are left
    whole = Window.partitionBy("conv_id")
    candidates = last.unionByName(head).select(
        "*",
        F.max(F.when(F.col("back") == n, F.col("turn"))).over(whole).alias("oldest"),
        F.max(F.when(F.col("back").isNull(), F.col("turn"))).over(whole).alias("head"),
    )
    displaced = F.coalesce(F.col("head") < F.col("oldest"), F.lit(False))
    kept = F.when(F.col("back").isNull(), displaced).otherwise((F.col("back") < n) | ~displaced)
    return candidates.where(kept).select(*COLUMNS)


def set_system(messages: DataFrame, system: str | DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """Replace the leading system message, or put one in front; system is one text or a table (conv_id, text).

    One text goes to all conversations of the log and of conversations (conv_id), if given; a table to those it names. A
    conversation without any message gets its system message as turn 0.

    Only system messages and one row per conversation are shuffled; all other messages pass straight through.
    """
    starts = messages.groupBy("conv_id").agg(F.min("turn").alias("start"))
    if isinstance(system, str):
        everyone = starts if conversations is None else starts.join(conversations.select("conv_id").distinct(), "conv_id", "full")
        wanted = everyone.withColumn("new_text", F.lit(system))
    else:
        wanted = system.select("conv_id", F.col("text").alias("new_text")).join(starts, "conv_id", "left")
    head = _leading_system(messages).select("conv_id", F.col("turn").alias("head_turn"))
    fresh = wanted.join(head, "conv_id", "left").select(
        "conv_id", F.coalesce(F.col("head_turn"), F.col("start") - 1, F.lit(0)).alias("turn"),
        F.lit("system").alias("role"), F.col("new_text").alias("text"),
    )
    old_system = _system(messages).join(fresh.select("conv_id", "turn"), ["conv_id", "turn"], "left_anti")
    return _not_system(messages).unionByName(old_system.select(*COLUMNS)).unionByName(fresh)


def in_order(messages: DataFrame) -> DataFrame:
    """All messages in order."""
    return messages.select(*COLUMNS).orderBy("conv_id", "turn")


def history(messages: DataFrame) -> DataFrame:
    """Messages without system messages."""
    return _not_system(messages)


def recent(messages: DataFrame, n: int = fv.RECENT_MESSAGES) -> DataFrame:
    """All system messages and the last n other messages, with their place in the result order."""
    system = _system(messages).withColumn("part", F.lit(0))
    last = _last(history(messages), n).select(*COLUMNS, F.lit(1).alias("part"))
    return system.unionByName(last)


def prompt_text(messages: DataFrame, n: int = fv.PROMPT_MESSAGES) -> DataFrame:
    """The last n non-system messages of every conversation as one text: conv_id, prompt."""
    speaker = F.when(F.col("role") == "user", "User").otherwise("Assistant")
    line = F.concat(speaker, F.lit(": "), F.col("text"))
    lines = _last(history(messages), n).select("conv_id", "turn", line.alias("line"))
    return lines.groupBy("conv_id").agg(F.array_join(_texts("turn", "line"), "\n").alias("prompt"))


def _texts(order: str, text: str) -> Column:
    return F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda r: r[text])


def clear(messages: DataFrame, system: str | DataFrame | None = None) -> DataFrame:
    """Drop everything but system messages; with a text, set it as the system message of every conversation afterwards."""
    kept = _system(messages)
    return kept if system is None else set_system(kept, system, messages.select("conv_id"))


def history_counts(messages: DataFrame) -> DataFrame:
    """Messages per conversation, all and without system messages."""
    return messages.groupBy("conv_id").agg(
        F.count("*").alias("messages"), F.count_if(F.col("role").isNull() | (F.col("role") != "system")).alias("history"),
    )


def transcript_lines(messages: DataFrame) -> DataFrame:
    """One block of transcript text per message that is no system message: conv_id, turn, block."""
    speaker = F.when(F.col("role") == "user", "User").otherwise("Agent")
    return _not_system(messages).select("conv_id", "turn", F.concat(speaker, F.lit(": "), F.col("text")).alias("block"))


def transcripts(messages: DataFrame, turns: int = 1000) -> DataFrame:
    """Transcripts with blank lines between messages: conv_id, segment, transcript.

    A segment covers a range of `turns` turn numbers, so no row or task has to hold a whole long conversation; shorter
    conversations are one row, and the segments of longer ones follow each other.
    """
    lines = transcript_lines(messages).withColumn("segment", F.floor(F.col("turn") / turns).cast("long"))
    return lines.groupBy("conv_id", "segment").agg(F.array_join(_texts("turn", "block"), "\n\n").alias("transcript"))


def write_transcripts(
    messages: DataFrame, path: str, mode: str = "errorifexists", turns: int = 1000, folders: bool = False
) -> None:
    """Write transcripts as JSON lines (conv_id, segment, transcript), in files of many conversations.

    With folders, as text in one folder per conversation, its parts in order: for a log of few conversations.
    """
    if not folders:
        transcripts(messages, turns).write.mode(mode).json(path)
        return
    text = transcripts(messages, turns).select("conv_id", "segment", F.concat("transcript", F.lit("\n")).alias("value"))
    placed = text.repartitionByRange("conv_id", "segment").sortWithinPartitions("conv_id", "segment")
    placed.drop("segment").write.mode(mode).partitionBy("conv_id").text(path)


def route(questions: DataFrame) -> DataFrame:
    """All columns and the intent of the text."""
    return questions.withColumn("intent", X.intent(F.col("text")))


def _document(df: DataFrame, entry: Column, *order: str) -> DataFrame:
    """A short report as one JSON text."""
    rows = F.array_sort(F.collect_list(F.struct(*order, F.to_json(entry).alias("entry"))))
    entries = F.array_join(F.transform(rows, lambda r: r["entry"]), ",")
    return df.agg(F.concat(F.lit("["), entries, F.lit("]")).alias("answer"))


def report_documents(ds: Dataset) -> DataFrame:
    """The reports that answer routed questions, one JSON text per intent: intent, answer."""
    def all_columns(df: DataFrame) -> Column:
        return F.struct(*[F.col(c) for c in df.columns])

    documents = {}
    summary = R.dataset_summary(ds)
    documents["summary"] = summary.select(F.to_json(all_columns(summary)).alias("answer"))
    documents["count"] = R.row_count(ds).select(F.to_json(F.struct("total_students")).alias("answer"))
    if ds.department:
        stats = R.department_stats(ds)
        documents["department"] = _document(stats, all_columns(stats), "department")
    if ds.subjects:
        top = R.top_rows(ds)
        documents["top"] = _document(top.withColumn("down", -F.col("score")), all_columns(top), "down", "name")
        subjects = R.subject_analysis(ds)
        documents["subject"] = _document(subjects, all_columns(subjects), "position")
    if ds.attendance:
        stats = R.attendance_stats(ds)
        documents["attendance"] = stats.select(F.to_json(all_columns(stats)).alias("answer"))
    # an intent without its columns gets the text of the error
    missing = {"department": R.NO_DEPARTMENT, "top": R.NO_MARKS, "subject": R.NO_SUBJECTS, "attendance": R.NO_ATTENDANCE}
    for name, text in missing.items():
        if name not in documents:
            documents[name] = ds.df.sparkSession.range(1).select(F.to_json(F.struct(F.lit(text).alias("error"))).alias("answer"))
    parts = [df.select(F.lit(name).alias("intent"), "answer") for name, df in documents.items()]
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    return union


def answers(questions: DataFrame, ds: Dataset, chunks: DataFrame, index: retrieval.TfidfIndex) -> DataFrame:
    """Answer questions without a language model: query_id, intent, answer.

    Routed questions get the JSON text of a report, the others the context of their best chunks.
    """
    routed = route(questions.select("query_id", "text"))
    # six short texts
    reported = routed.where(F.col("intent") != fv.OTHER_INTENT).join(F.broadcast(report_documents(ds)), "intent", "left")
    open_questions = routed.where(F.col("intent") == fv.OTHER_INTENT)
    best = retrieval.tfidf_topk(index, chunks, open_questions, fv.ANSWER_TOP_K)
    contexts = retrieval.context_blocks(open_questions, best, chunks, fv.ANSWER_TOP_K)
    found = contexts.select("query_id", F.lit(fv.OTHER_INTENT).alias("intent"), F.col("context").alias("answer"))
    return reported.select("query_id", "intent", "answer").unionByName(found)
