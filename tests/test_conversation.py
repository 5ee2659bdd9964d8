import os
import time
from datetime import timedelta

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from cohort.operators import conversation as H
from cohort.plans.questions import SAMPLE_QUESTIONS, sample_questions
from cohort.plans.tables import table
from cohort.streaming import buffers

# a leading system message, a later one, none, only system
LOGS = {
    1: ["system", "user", "assistant", "user", "assistant", "user"],
    2: ["user", "system", "assistant", "user", "user", "assistant", "user"],
    3: ["user", "assistant"],
    4: ["system"],
    5: ["system", "system", "user", "system", "user"],
}
SCHEMA = "conv_id long, turn long, role string, text string"
ROWS = [(c, t, role, f"{role} {c}/{t}") for c, roles in LOGS.items() for t, role in enumerate(roles)]


@pytest.fixture(scope="module")
def log(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


def replayed(n):
    """The buffer after adding one message after the other."""
    out = []
    for c in LOGS:
        held = []
        for row in (r for r in ROWS if r[0] == c):
            held.append(row)
            if len(held) > n:
                held = [held[0], *held[-(n - 1):]] if held[0][2] == "system" else held[-n:]
        out += held
    return sorted(out)


def rows(df):
    return sorted(tuple(r) for r in df.select(*H.COLUMNS).collect())


@pytest.mark.parametrize("n", [2, 3, 4, 12])
def test_buffer_is_a_replay(log, n):
    assert rows(H.buffer(log, n)) == replayed(n)


def test_buffer_needs_two_places(log):
    for call in (H.buffer, buffers.buffer_stream):
        with pytest.raises(ValueError):
            call(log, 1)


def test_set_system(spark, log):
    fresh = {(c, t) for c, t, r, x in rows(H.set_system(log, "new")) if x == "new"}
    assert fresh == {(1, 0), (2, -1), (3, -1), (4, 0), (5, 0)}
    assert H.set_system(log, "new").count() == len(ROWS) + 2
    some = spark.createDataFrame([(2, "two")], "conv_id long, text string")
    assert [r for r in rows(H.set_system(log, some)) if r[3] == "two"] == [(2, -1, "system", "two")]
    assert rows(H.set_system(H.set_system(log, "a"), "b")) == rows(H.set_system(log, "b"))


def test_clear_and_recent(log):
    system = [r for r in ROWS if r[2] == "system"]
    assert rows(H.clear(log)) == sorted(system)
    heads = {c: min(r[1] for r in system if r[0] == c) for c in {r[0] for r in system}}
    reset = [(c, t, r, "x" if heads[c] == t else x) for c, t, r, x in system] + [(c, 0, "system", "x") for c in LOGS if c not in heads]
    assert rows(H.clear(log, "x")) == sorted(reset)
    last = [r for c in LOGS for r in [x for x in ROWS if x[0] == c and x[2] != "system"][-2:]]
    assert rows(H.recent(log, 2)) == sorted(system + last)
    assert rows(H.history(log)) == sorted(r for r in ROWS if r[2] != "system")


def test_prompt_text(log):
    prompts = {r["conv_id"]: r["prompt"] for r in H.prompt_text(log, 2).collect()}
    assert prompts[3] == "User: user 3/0\nAssistant: assistant 3/1" and 4 not in prompts


def test_transcript_segments(log):
    whole = {r["conv_id"]: r["transcript"] for r in H.transcripts(log).collect()}
    assert whole[3] == "User: user 3/0\n\nAgent: assistant 3/1"
    parts = sorted(tuple(r) for r in H.transcripts(log, turns=2).where("conv_id = 2").collect())
    assert [p[1] for p in parts] == [0, 1, 2, 3] and "\n\n".join(p[2] for p in parts) == whole[2]


def test_transcript_files(spark, log, tmp_path):
    H.write_transcripts(log, str(tmp_path / "lines"))
    assert spark.read.json(str(tmp_path / "lines")).where("conv_id = 3").first()["transcript"] == "User: user 3/0\n\nAgent: assistant 3/1"
    H.write_transcripts(log, str(tmp_path / "out"), folders=True)
    text = "".join(f.read_text() for f in sorted((tmp_path / "out" / "conv_id=3").glob("*.txt")))
    assert text.strip() == "User: user 3/0\n\nAgent: assistant 3/1"


def test_routing(spark):
    intents = [r["intent"] for r in H.route(sample_questions(spark)).orderBy("query_id").collect()]
    assert len(intents) == len(SAMPLE_QUESTIONS) and intents == [
        "department", "attendance", "top", "retrieval", "subject", "department", "retrieval", "department",
        "attendance", "subject", "summary", "count", "summary", "count",
    ]


@pytest.mark.parametrize("late", [False, True])
def test_stream_ends_like_the_batch(spark, sf_dir, log, tmp_path, late):
    # the made-up conversations have later system messages, the test table many conversations
    log = log.selectExpr("-conv_id AS conv_id", "turn", "role", "text").unionByName(table(spark, sf_dir, "conversations"))
    for i in range(3):
        part = log.where((log["turn"] >= 3 * i) & (log["turn"] < 3 * i + 3))
        part.coalesce(1).write.parquet(str(tmp_path / "in" / f"step={2 - i if late else i}"))
    folders = sorted((tmp_path / "in").glob("step=*"))
    names = []
    for i, folder in enumerate(folders):
        (source,) = folder.glob("*.parquet")
        target = tmp_path / "flat" / f"{i}.parquet"
        target.parent.mkdir(exist_ok=True)
        target.write_bytes(source.read_bytes())
        os.utime(target, (1_700_000_000 + i, 1_700_000_000 + i))
        names.append(target)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "flat"))
    assert rows(buffers.replay(stream, 4)) == rows(H.buffer(log, 4))


def _files(folder):
    return sorted(str(p.relative_to(folder)) for p in folder.rglob("part-*.parquet") if "_staged" not in str(p))


def _batches(spark, folder, table):
    """One file for each row, in the order of the rows."""
    folder.mkdir()
    for i, (conv, turn, role, text) in enumerate(table):
        row = pa.table({"conv_id": pa.array([conv], pa.int64()), "turn": pa.array([turn], pa.int64()), "role": [role], "text": [text]})
        pq.write_table(row, folder / f"{i:03}.parquet")
        os.utime(folder / f"{i:03}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder))


def test_many_batches_leave_one_file_a_bucket(spark, tmp_path):
    table = [(i % 2, i // 2, "system" if i in (0, 3) else "user", f"m{i}") for i in range(6)]
    stream, path = _batches(spark, tmp_path / "in", table), tmp_path / "out"
    buffers.start_buffer_table(buffers.buffer_stream(stream, 2), str(path), str(tmp_path / "ck"), 4).awaitTermination()
    buckets = {f.split("/")[0] for f in _files(path)}
    assert len(_files(path)) == len(buckets) <= 4
    assert len([p for p in (path / "_staged").iterdir() if p.name.startswith("batch")]) == 1
    assert rows(buffers.current_buffers(spark, str(path))) == rows(H.buffer(spark.createDataFrame(table, SCHEMA), 2))


def test_a_repeated_batch_changes_nothing_and_brings_a_lost_bucket_back(spark, tmp_path):
    def batch(turn, convs):
        return spark.createDataFrame([(c, turn, [{"turn": turn, "role": "user", "text": f"{c}/{turn}"}]) for c in convs], buffers.BUFFERS)

    path = str(tmp_path / "t")
    buffers._merge(batch(1, range(20)), path, 4, 0)
    buffers._merge(batch(2, [3, 7, None]), path, 4, 1)
    want = sorted((c, 2 if c in (3, 7, -1) else 1) for c in [*range(20), -1])
    def now():
        return sorted((-1 if r["conv_id"] is None else r["conv_id"], r["turn"]) for r in buffers.current_buffers(spark, path).collect())
    assert now() == want
    for lost in [f for f in _files(tmp_path / "t") if f.startswith("bucket=")][:1]:
        (tmp_path / "t" / lost).unlink()
    buffers._merge(batch(2, [3, 7, None]), path, 4, 1)
    restored = now()
    assert [x for x in restored if x[1] == 2] == [x for x in want if x[1] == 2]
    buffers._merge(batch(3, range(20)), path, 4, 2)
    assert [t for _, t in now() if t != 2] == [3] * 20 and len(_files(tmp_path / "t")) <= 4


def test_idle_state_expires(spark, tmp_path):
    """What comes after the pause begins a new buffer, as nothing is remembered."""
    stream, path = _batches(spark, tmp_path / "in", [(1, 0, "user", "old")]), str(tmp_path / "out")
    made = buffers.buffer_stream(stream, 3, idle=timedelta(seconds=2))
    query = buffers.start_buffer_table(made, path, str(tmp_path / "ck"), 2, processingTime="500 milliseconds")
    try:
        _until(lambda: rows(buffers.current_buffers(spark, path)) == [(1, 0, "user", "old")])
        time.sleep(4)
        pq.write_table(pa.table({"conv_id": [1], "turn": [1], "role": ["user"], "text": ["new"]}), tmp_path / "in" / "900.parquet")
        _until(lambda: (1, 1, "user", "new") in rows(buffers.current_buffers(spark, path)))
    finally:
        query.stop()
    assert rows(buffers.current_buffers(spark, path)) == [(1, 1, "user", "new")]


def _until(holds, seconds=60):
    """Wait for a stream; the table may be between two states when it is read."""
    end = time.time() + seconds
    while time.time() < end:
        try:
            if holds():
                return
        except Exception:
            pass
        time.sleep(0.5)
    raise AssertionError("it did not come")


def test_no_table_yet(spark, tmp_path):
    assert buffers.current_buffers(spark, str(tmp_path / "none")).count() == 0
