"""Conversation structure repair: weighted CYK interval parsing over spans of turns.

The grammar of a sound conversation is (s?(ua)+)? over the initials of roles. In Chomsky normal form it has one symbol X[p,q] for
each pair of places in that pattern (start, after s, after u, after a), with the rules X[p,q] -> X[p,r] X[r,q]; a turn is a
terminal that may be kept, given another role or deleted, and insertions are closed into the cells of single turns.
A cell holds the cheapest (cost, audit) of its span, ties by the ASCII order of the audit. Cells combine bottom-up by span
length. As the symbols name all places a split can have, every split of a span gives the same cells, so one split a span
is enough and a parse is linear, not cubic. Of two audits of equal cost none begins with the other (the rest could only
insert, which costs), so the least cell stays least in front of any other.

Turns are sorted by range, so a conversation of any length is parsed in blocks by many tasks; blocks of a conversation meet
FAN at a time. Texts stay out of that: they are read once more, in order, to write the repaired conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StringType, StructField, StructType, _parse_datatype_string

from cohort.llm.common import named
from cohort.session import written

SPACES = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 3, 4, 3, 3   # costs; CUT_OFF is added for a truncated turn that stays
BLOCK = 4096      # leaves of a block
FAN = 16          # blocks of a conversation that are combined at once
ROLES = {"u": "user", "a": "assistant"}

# places in the pattern and the roles that lead from one to the next
STEPS = {("0", "s"): "s", ("0", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
PLACES = "0sua"
SYMBOLS = [("0", "0"), ("0", "s"), ("0", "u"), ("0", "a"), ("s", "s"), ("s", "u"), ("s", "a"), ("u", "u"), ("u", "a"), ("a", "u"), ("a", "a")]
RULES = [(SYMBOLS.index((p, q)), SYMBOLS.index((p, r)), SYMBOLS.index((r, q)))
         for p, q in SYMBOLS for r in PLACES if (p, r) in SYMBOLS and (r, q) in SYMBOLS]
ENDS = [SYMBOLS.index(("0", "0")), SYMBOLS.index(("0", "a"))]

Cells = list   # for each symbol (cost, audit) or None


def join(left: Cells, right: Cells) -> Cells:
    """The cells of a span from those of its two parts."""
    out: Cells = [None] * len(SYMBOLS)
    for whole, first, second in RULES:
        a, b = left[first], right[second]
        if a is None or b is None:
            continue
        cost, best = a[0] + b[0], out[whole]
        if best is None or cost < best[0]:
            out[whole] = (cost, a[1] + b[1])
        elif cost == best[0]:
            out[whole] = (cost, min(best[1], a[1] + b[1]))
    return out


def _closure() -> Cells:
    """Cells of no turn at all: the cheapest insertions that lead from one place to another."""
    one: Cells = [(0, "") if p == q else None for p, q in SYMBOLS]
    for place, role in STEPS.items():
        if role in ROLES:
            one[SYMBOLS.index(place)] = (INSERT, "I")
    return join(join(one, one), one)


CLOSURE = _closure()


def leaf(token: str, n: int = 1) -> Cells:
    """Cells of n turns that must be deleted ("-"), or of one turn: the initial of its role ("x" for others), a capital if truncated."""
    one: Cells = [(DELETE * n, "D" * n) if p == q else None for p, q in SYMBOLS]
    if token != "-":
        more = CUT_OFF if token.isupper() else 0
        for place, role in STEPS.items():
            ways = [(KEEP + more, "K")] if role == token.lower() else []
            ways += [(REROLE + more, "R")] if role in ROLES else []
            if ways:
                one[SYMBOLS.index(place)] = min(ways)
    return join(join(CLOSURE, one), CLOSURE)


LEAVES = {token: leaf(token) for token in "suaxSUAX-"}


def parse(spans: list) -> Cells:
    """The cells of a sequence of spans, bottom-up by span length."""
    spans = list(spans) or [CLOSURE]
    while len(spans) > 1:
        spans = [join(spans[i], spans[i + 1]) if i + 1 < len(spans) else spans[i] for i in range(0, len(spans), 2)]
    return list(spans[0])


def answer(cells: Cells) -> tuple[int, str]:
    """(cost, audit) of a whole conversation."""
    return min(cells[i] for i in ENDS if cells[i] is not None)


def replay(audit: str) -> Iterator[tuple[str, str]]:
    """(edit, role initial that a rerole or an insertion gives) of each edit; send the initial of a kept turn's role."""
    last = ""
    for edit in audit:
        due = "a" if last == "u" else "u"
        kept = yield edit, due
        last = {"K": kept, "D": last}.get(edit, due)


# Spark ---------------------------------------------------------------------------------------------------------------

BLOCK_FIELDS = ("low long, high long, turns long, blank long, duplicate long, truncated long, illegal long, first string, last string, "
                "costs array<long>, audits array<string>")
REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def turns_of(table: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", live: Column | None = None) -> DataFrame:
    """The four columns by their usual names; null roles and texts are one space. Rows that are not live only name their conversation."""
    return table.select(
        named(conv).alias("conv"), named(turn).cast("long").alias("turn"), F.coalesce(named(role).cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(named(text).cast("string"), F.lit(" ")).alias("text"), (F.lit(True) if live is None else live).alias("live"))


def _faults(turns: DataFrame) -> DataFrame:
    """One row for equal turns: their number, whether they are blank or cut off, and whether they are the first with this role and text."""
    ends = F.rtrim("text", F.lit(SPACES))
    light = turns.select(
        "conv", "turn", "role", F.sha2("text", 256).alias("h"), F.col("live").cast("long").alias("n"), (ends == "").alias("blank"),
        (~F.right(ends, F.lit(1)).isin(".", "!", "?")).alias("open"))
    light = written(light.groupBy("conv", "turn", "role", "h").agg(
        F.sum("n").alias("n"), F.first("blank").alias("blank"), F.first("open").alias("open")), "turns")
    place = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn"))
    again = written(light.where("n > 0").groupBy("conv", "role", "h").agg(
        F.count("*").alias("times"), F.min(place).alias("earliest")).where("times > 1").select(
        F.col("conv").alias("c"), F.col("role").alias("r"), F.col("h").alias("k"), F.col("earliest.turn").alias("earliest")), "again")
    same = F.col("conv").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("h") == F.col("k"))
    return light.join(again, same, "left").select(
        "conv", "turn", "role", "h", "n", "blank", "open", (F.col("k").isNull() | F.col("turn").eqNullSafe(F.col("earliest"))).alias("fresh"))


class _Block:
    """Counts and leaves of consecutive turns of a conversation."""

    def __init__(self):
        self.low = self.high = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.first = self.last = None
        self.leaves: list = []

    def add(self, turn, role, n, blank, cut, fresh):
        if not n:
            return
        if turn is not None:
            self.turns += turn != self.high
            self.low = turn if self.low is None else self.low
            self.high = turn
        initial = role[:1]
        if self.first is None:
            self.first = initial
        else:
            self.illegal += self.last + initial not in ("su", "ua", "au")
        self.illegal += n - 1
        self.last = initial
        if blank:
            self.blank += n
            self.leaves.append(leaf("-", n) if n > 1 else LEAVES["-"])
            return
        self.duplicate += n - fresh
        if fresh:
            self.truncated += cut
            token = initial if initial in "sua" and initial else "x"
            self.leaves.append(LEAVES[token.upper() if cut else token])
        if n > fresh:
            self.leaves.append(leaf("-", n - fresh))

    def values(self) -> list:
        cells = parse(self.leaves)
        return [self.low, self.high, self.turns, self.blank, self.duplicate, self.truncated, self.illegal, self.first, self.last,
                [c and c[0] for c in cells], [c and c[1] for c in cells]]


def _combine(blocks: list[dict]) -> dict:
    """Consecutive blocks of a conversation as one."""
    out = dict(blocks[0])
    for b in blocks[1:]:
        if b["first"] is not None:
            if out["last"] is not None:
                out["illegal"] += out["last"] + b["first"] not in ("su", "ua", "au")
            else:
                out["first"] = b["first"]
            out["last"] = b["last"]
        if b["low"] is not None:
            out["turns"] -= b["low"] == out["high"]
            out["low"] = b["low"] if out["low"] is None else out["low"]
            out["high"] = b["high"]
        for name in ("turns", "blank", "duplicate", "truncated", "illegal"):
            out[name] += b[name]
    cells = parse([[None if c is None else (c, a) for c, a in zip(b["costs"], b["audits"])] for b in blocks])
    return out | {"costs": [c and c[0] for c in cells], "audits": [c and c[1] for c in cells]}


def _arrow(rows: list, schema: StructType) -> pa.RecordBatch:
    kinds = to_arrow_schema(schema)
    return pa.RecordBatch.from_arrays(
        [pa.array([r[i] for r in rows], kinds.field(i).type) for i in range(len(kinds))], names=schema.names)


def _blocks(sorted_turns: DataFrame, size: int) -> DataFrame:
    """(conv, part, seq, counts, cells): blocks of at most size leaves, in the order of the turns."""
    schema = StructType([StructField("conv", sorted_turns.schema["conv"].dataType), *_parse_datatype_string(f"part long, seq long, {BLOCK_FIELDS}").fields])

    def run(batches):
        part, seq, now, block, out = TaskContext.get().partitionId(), 0, None, None, []
        for batch in batches:
            for conv, *rest in zip(*[c.to_pylist() for c in batch.columns]):
                if block is None or conv != now or len(block.leaves) >= size:
                    if block is not None:
                        out.append([now, part, seq, *block.values()])
                        seq += 1
                    now, block = conv, _Block()
                block.add(*rest)
                if len(out) >= 1000:
                    yield _arrow(out, schema)
                    out = []
        if block is not None:
            out.append([now, part, seq, *block.values()])
        if out:
            yield _arrow(out, schema)

    return sorted_turns.select("conv", "turn", "role", "n", "blank", "open", "fresh").mapInArrow(run, schema)


def repair(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit) of every conversation of turns_of(...).

    Turns are taken by turn (nulls first), then role and the SHA-256 of the text. The first fault of a turn counts: blank (white space
    only), duplicate (role and text of an earlier turn), truncated (the last other character is none of .!?). gaps are numbers
    missing between the least and the greatest turn, illegal counts neighbours whose role initials are not su, ua or au.
    audit has the initial of each edit: Keep, Rerole, Delete (the only edit of blank and duplicate turns), Insert.
    A conversation without live turns has zeros and an empty audit, a null conversation is one like any other, repeated rows are
    duplicates, very long texts cost one hash, an empty table gives an empty table.
    """
    parts = max(1, int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    light = written(_faults(turns), "faults")
    ordered = light.repartitionByRange(parts, "conv", "turn", "role", "h").sortWithinPartitions("conv", "turn", "role", "h")
    blocks = written(_blocks(ordered, block), "blocks")
    fields = [f.name for f in _parse_datatype_string(BLOCK_FIELDS)]
    count = blocks.groupBy("conv").agg(F.count("*").alias("pieces"))
    several = written(count.where("pieces > 1").select(F.col("conv").alias("c")), "several")
    on = F.col("conv").eqNullSafe(F.col("c"))
    whole = blocks.join(several, on, "left_anti").select("conv", *fields)
    rest = blocks.join(several, on, "left_semi")
    # one row for some thousand turns, so no conversation is gathered here
    rest = written(rest.withColumn("place", F.row_number().over(Window.partitionBy("conv").orderBy("part", "seq")) - 1).select(
        "conv", F.col("place").cast("long").alias("place"), *fields), "rest")
    most = rest.agg(F.max("place")).first()[0]
    schema = StructType([turns.schema["conv"], *_parse_datatype_string(f"place long, {BLOCK_FIELDS}").fields])

    def meet(batches):
        for batch in batches:
            rows = zip(*[c.to_pylist() for c in batch.columns])
            yield _arrow([[conv, place, *map(_combine(group).get, fields)] for conv, place, group in rows], schema)

    while most:
        grouped = rest.groupBy("conv", F.expr(f"place div {FAN}").alias("place")).agg(
            F.sort_array(F.collect_list(F.struct(F.col("place").alias("at"), *fields))).alias("group"))
        rest = written(grouped.mapInArrow(meet, schema), "rest")
        most //= FAN
    return _reported(whole.unionAll(rest.select("conv", *fields)))


def _reported(blocks: DataFrame) -> DataFrame:
    schema = StructType([blocks.schema["conv"], *_parse_datatype_string(REPORT).fields])

    def run(batches):
        for batch in batches:
            out = []
            for b in batch.to_pylist():
                cost, audit = answer([None if c is None else (c, a) for c, a in zip(b["costs"], b["audits"])])
                if b["first"] is None:
                    cost, audit = 0, ""
                gaps = 0 if b["low"] is None else b["high"] - b["low"] + 1 - b["turns"]
                out.append([b["conv"], gaps, b["blank"], b["duplicate"], b["truncated"], b["illegal"], cost, audit])
            yield _arrow(out, schema)

    return blocks.mapInArrow(run, schema)


def _in_order(turns: DataFrame, repairs: DataFrame) -> DataFrame:
    """Each conversation's report, then its turns, in the order in which they were parsed."""
    reports = [f for f in _parse_datatype_string(REPORT).names]
    head = repairs.select("conv", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("role"),
                          F.lit(None).cast("string").alias("text"), *reports)
    body = turns.where("live").select("conv", F.lit(1).alias("kind"), "turn", "role", "text",
                                      *[F.lit(None).cast(repairs.schema[c].dataType).alias(c) for c in reports])
    both = head.unionAll(body).withColumn("h", F.sha2("text", 256))
    return both.repartition("conv").sortWithinPartitions("conv", "kind", "turn", "role", "h").drop("h")


def _walk(batches) -> Iterator[tuple]:
    """(report row, None) where a conversation begins and (None, (edit, turn, role, text)) for each edit of it."""
    edits = step = None

    def inserted(step):
        while step is not None and step[0] == "I":
            yield None, ("I", None, ROLES[step[1]], "")
            step = advance(None)
        return step

    def advance(kept):
        try:
            return edits.send(kept)
        except StopIteration:
            return None

    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns]):
            conv, kind, turn, role, text, *report = row
            if kind == 0:
                if edits is not None:
                    yield from inserted(step)
                yield (conv, *report), None
                edits = replay(report[-1])
                step = advance(None)
                continue
            step = yield from inserted(step)
            edit, due = step
            yield None, (edit, turn, ROLES[due] if edit == "R" else role, text)
            step = advance(role[:1])
    if edits is not None:
        yield from inserted(step)


def repaired_turns(turns: DataFrame, repairs: DataFrame) -> DataFrame:
    """(conv, position, edit, turn, role, text): the repaired conversations; inserted turns have no number and an empty text."""
    schema = StructType([turns.schema["conv"], *_parse_datatype_string("position long, edit string, turn long, role string, text string").fields])

    def run(batches):
        out, held, conv, position = [], 0, None, 0
        for report, edit in _walk(batches):
            if report is not None:
                conv, position = report[0], 0
            elif edit[0] != "D":
                out.append([conv, position, *edit])
                position, held = position + 1, held + len(edit[3])
                if len(out) >= 10_000 or held > 1 << 22:
                    yield _arrow(out, schema)
                    out, held = [], 0
        if out:
            yield _arrow(out, schema)

    return _in_order(turns, repairs).mapInArrow(run, schema)


def repaired_digests(turns: DataFrame, repairs: DataFrame) -> DataFrame:
    """The report of each conversation with repaired_sha256, of its repaired "role:text" lines; texts are hashed as they come, none is held."""
    schema = StructType([*repairs.schema.fields, StructField("repaired_sha256", StringType())])

    def run(batches):
        out, now, digest, lines = [], None, None, 0
        for report, edit in _walk(batches):
            if report is not None:
                if now is not None:
                    out.append([*now, digest.hexdigest()])
                now, digest, lines = report, hashlib.sha256(), 0
                if len(out) >= 1000:
                    yield _arrow(out, schema)
                    out = []
            elif edit[0] != "D":
                digest.update((("\n" if lines else "") + f"{edit[2]}:{edit[3]}").encode())
                lines += 1
        if now is not None:
            out.append([*now, digest.hexdigest()])
        if out:
            yield _arrow(out, schema)

    return _in_order(turns, repairs).mapInArrow(run, schema)


def damaged(table: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", parts: int = 20) -> DataFrame:
    """turns_of(table) with planted damage, by the crc32 of "conversation:turn" (nulls: a space): of parts remainders, 0 drops the row,
    1 empties the text, 2 removes its .!? marks, 3 repeats the row, 4 makes it the user's."""
    plain = turns_of(table, conv, turn, role, text)
    shown = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv", "turn")]
    kind = F.crc32(F.concat(shown[0], F.lit(":"), shown[1])) % parts
    hurt = plain.withColumn("kind", kind).select(
        "conv", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        (F.col("kind") != 0).alias("live"), F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))).alias("copies"))
    return hurt.select("conv", "turn", "role", "text", "live", F.explode("copies").alias("copy")).drop("copy")


def structure_repair(table: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The report and the digest of the repaired text of every conversation after planted damage, see damaged and repair."""
    turns = damaged(table, conv, turn, role, text)
    return repaired_digests(turns, repair(turns)).withColumnRenamed("conv", conv)
