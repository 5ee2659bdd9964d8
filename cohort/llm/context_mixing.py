"""Language-model scores by online logistic context mixing.

A text is predicted bit by bit. Hashed contexts - the last 3, 4, 5 and 7 bytes, and the begun word - each keep how often every
byte followed them in the training texts; along the bits of a byte these counts give each context a prediction. A mixer adds the
predictions in the logistic domain with weights gated by the bit's place in its byte, and refines the weights while it
reads the text. The sum of the coding costs gives the bits per byte and the log-probability of the whole text.

Counts are gathered from all training texts: tasks send what is not zero, and sums are taken in rounds
of at most FAN rows a group, so no group grows with the number of tasks. The finished tables have a fixed size and are sent to
the executors. The first weights are fitted to all training texts, too: to each half of them with the counts of the other half,
as a text's own counts would make every context look surer than it is for a new text. The unigram base model needs the count of every word of every text: frequent words, a number bounded
by HEAVY, are sent as well, and only the others meet their counts in a shuffle.
"""

from __future__ import annotations

import math
from collections import Counter
from itertools import compress
from operator import not_

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from cohort.llm.common import named, pieces, utf8
from cohort.session import written

BITS = (15, 15, 15, 16, 15)      # log2 of the rows of each context's table
ORDERS = (3, 4, 5, 7)           # bytes of the plain contexts; the last table is the begun word's
BACK = 7                     # bytes that any context looks back
END = 0xFF                   # coded after each text; no byte of UTF-8
PRIOR = 0.03                 # added to the counts of zeros and ones
SCALE = 0.1                  # of a table entry, in the logistic domain
CHUNK = 1 << 16              # table entries that travel together
FAN = 64                     # rows of a chunk that are summed in one group
HEAVY = 200_000              # words whose counts are sent to the executors, at most
BLOCK = 64                   # bytes between refinements of the weights, in texts of any length
LANE_BYTES = 1 << 20         # of the texts that are coded side by side
STEPS = 1                    # of fitting the first weights, each over all training texts
PULL = 10.0                  # of START on the first weights
FAR = 0.2                    # that a step changes a weight, at most
WORDS = 300_000              # words that a task counts at once
LANES = 64                   # texts whose weights are refined together
NEAR = 1 << 14               # keys that are looked up together
RATE = 0.02
START = (0.2, 0.3, 0.2, 0.35, 0.1)
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
TABLES = [(1 << b) * 256 for b in BITS]
EACH = lambda byte: np.uint64(byte * 0x0101010101010101)
LOWER = np.arange(7, -1, -1, dtype=np.uint8)[:, None]      # bits below each bit of a byte
SIGNS = np.array([[((b >> (7 - d)) & 1) * 2 - 1 for d in range(8)] for b in range(256)], np.float32)


def _own(keys: np.ndarray) -> list[np.ndarray]:
    """For each context what it is told by. A key holds a byte in its low bits and the BACK bytes before it above."""
    back = keys >> np.uint64(8)
    # the top bit of every byte that is white space, by sums that stay within a byte; the byte above all others ends a word, too
    low = back & EACH(0x7F)
    other = ((low ^ EACH(32)) + EACH(0x7F)) & ~((low + EACH(0x80 - 9)) & ~(low + EACH(0x80 - 14)))
    space = (~(other | back) & EACH(0x80)) | np.uint64(1 << 63)
    inside = ((space & (~space + np.uint64(1))) >> np.uint64(7)) - np.uint64(1)     # all bits of the bytes before the first white space
    length = np.bitwise_count(inside).astype(np.uint64) >> np.uint64(3)
    return [back & np.uint64((1 << 8 * o) - 1) for o in ORDERS] + [(back & inside) ^ (length << np.uint64(59))]


def _rows(own: np.ndarray, bits: int) -> np.ndarray:
    """The table places of the rows of a context."""
    # the multiplier mixes low bits up; folding lets high bits count as well
    return ((((own ^ (own >> np.uint64(29))) * MULTIPLIER) >> np.uint64(64 - bits)) << np.uint64(8)).view(np.int64)


def contexts(keys: np.ndarray) -> list[np.ndarray]:
    """For each context the table place of its row."""
    return [_rows(own, bits) for own, bits in zip(_own(keys), BITS)]


def _runs(keys: np.ndarray):
    """For each context, over neighbouring keys that agree in it and in their byte: where they begin, their row and their byte."""
    last = (keys & np.uint64(255)).astype(np.int64)
    other = last[1:] != last[:-1]
    for own, bits in zip(_own(keys), BITS):
        heads = np.flatnonzero(np.concatenate([[True], other | (own[1:] != own[:-1])]))[:len(keys)]
        yield heads, _rows(own[heads], bits), last[heads]


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys and how often they occur; those that agree in their latest bytes side by side, as most contexts are told by these."""
    found, n = np.unique(keys.byteswap(), return_counts=True)
    return found.byteswap(), n


def _numbered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, and for each key its place among them."""
    order = np.argsort(keys.byteswap())
    keys = keys[order]
    new = np.concatenate([[True], keys[1:] != keys[:-1]])[:len(keys)]
    at = np.empty(len(keys), np.int32)
    at[order] = np.cumsum(new, dtype=np.int32) - np.int32(1)
    return keys[new], at


def _keys(parts: list[tuple[bytes, bytes]]) -> np.ndarray:
    """The keys of all bytes of stretches (bytes before, bytes), one after the other."""
    data = b"".join(x for before, part in parts for x in (before[-BACK:].rjust(BACK, b"\0"), part))
    keys = np.ndarray(max(0, len(data) - BACK), ">u8", data, strides=(1,))      # the eight bytes from each position on
    # positions are those of the data less BACK, so each stretch is followed by the BACK bytes before the next one
    real = np.repeat(np.tile([True, False], len(parts)), [x for _, part in parts for x in (len(part), BACK)])[:len(keys)]
    return keys[real].astype(np.uint64)


def _lanes(texts: list[bytes]):
    """Groups of (places, length of the longest) of texts that are coded side by side, short ones first: of LANE_BYTES, or one longer text."""
    sizes = [len(t) + 1 for t in texts]
    order = sorted(range(len(texts)), key=lambda i: sizes[i])
    start = 0
    while start < len(order):
        stop, held = start + 1, sizes[order[start]]
        while stop < len(order) and held + sizes[order[stop]] <= LANE_BYTES:
            held += sizes[order[stop]]
            stop += 1
        yield order[start:stop], sizes[order[stop - 1]]
        start = stop


def _part(text: bytes, start: int, n: int) -> tuple[bytes, bytes]:
    """A stretch of a text with its end, and what stands before it."""
    return text[max(0, start - BACK):start], text[start:start + n] + (bytes([END]) if start <= len(text) < start + n else b"")


def _sums(n: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """The sums of runs that begin at heads, the first at 0."""
    return n if len(heads) == len(n) else np.add.reduceat(n, heads)


def _stretches(texts: list[bytes]):
    """All bytes of lower-cased texts with their ends as distinct keys and their numbers, in groups of a bounded size."""
    held: list[tuple[bytes, bytes]] = []
    size = 0
    for i, text in enumerate(texts):
        for start in range(0, len(text) + 1, LANE_BYTES):
            held.append(_part(text, start, LANE_BYTES))
            size += len(held[-1][1])
            if size >= LANE_BYTES or i == len(texts) - 1 and start + LANE_BYTES > len(text):
                yield _distinct(_keys(held))   # most keys repeat, so tables are touched less often
                held, size = [], 0


def _counted(texts: list[bytes]):
    """For groups of bytes and each context: (context, table entries, how often); an entry may come again."""
    for keys, n in _stretches(texts):
        for start in range(0, len(keys), NEAR):   # few enough for the processor's cache
            for i, (heads, rows, last) in enumerate(_runs(keys[start:start + NEAR])):
                yield i, rows + last, _sums(n[start:start + NEAR], heads)


def count(tables: list[np.ndarray], texts: list[bytes]) -> None:
    """Add what follows the contexts of lower-cased texts to the tables."""
    for i, at, n in _counted(texts):
        np.add.at(tables[i], at, n.astype(np.uint32))


class Counts:
    """What is not zero in a table: sorted entries and their counts, so that a task holds no more than its texts need."""

    def __init__(self):
        self.at, self.n = np.zeros(0, np.uint32), np.zeros(0, np.uint32)
        self.more: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, at: np.ndarray, n: np.ndarray) -> None:
        self.more.append((at.astype(np.uint32), n.astype(np.uint32)))
        self.size += len(at)
        if self.size > max(CHUNK * 8, len(self.at)):
            self.settle()

    def settle(self) -> None:
        """Put the new counts to the others."""
        both = np.concatenate([(a.astype(np.uint64) << np.uint64(32)) | n for a, n in [(self.at, self.n), *self.more]])
        self.more, self.size = [], 0
        both.sort()
        at = (both >> np.uint64(32)).astype(np.uint32)
        heads = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))[:len(at)]
        sums = _sums(both & np.uint64(0xFFFFFFFF), heads)
        self.at, self.n = at[heads], np.minimum(sums, 0xFFFFFFFF).astype(np.uint32)


def predictions(counts: np.ndarray) -> np.ndarray:
    """Table entries for counts of bytes, 256 for each row: for each node of the tree of bits, ln(ones / zeros), scaled."""
    level = counts.reshape(-1, 256).astype(np.float64)
    out = np.zeros(level.shape, np.int8)
    for depth in range(7, -1, -1):
        pairs = level.reshape(len(level), -1, 2)
        level = pairs[:, :, 0] + pairs[:, :, 1]
        row, node = np.nonzero(level)   # the others are zero
        found = pairs[row, node]
        odds = np.log((found[:, 1] + PRIOR) / (found[:, 0] + PRIOR))
        out[row, (1 << depth) + node] = np.clip(np.rint(odds / SCALE), -127, 127)
    return out.reshape(-1)


def _columns(table: np.ndarray) -> np.ndarray:
    """A table by the nodes of the tree of bits: 256 columns of few enough entries for the processor's cache."""
    return table if table.ndim == 2 else table.reshape(-1, 256).T


def _entries(tables: list[np.ndarray], keys: np.ndarray, signed: bool):
    """For each context of keys in the order of their bytes: their table entries by bits, of runs of keys, and the run of each key (None: its own).

    The keys of a node are neighbours, so one column is met after the other. signed: a positive entry speaks for the bit that came.
    """
    byte = keys.astype(np.uint8)
    signs = ((byte >> LOWER & np.uint8(1)) * np.uint8(2) - np.uint8(1)).view(np.int8)
    first = np.concatenate([[0], np.flatnonzero(byte[1:] != byte[:-1]) + 1])
    bytes_ = byte[first].tolist()
    for table, (heads, rows, _) in zip(tables, _runs(keys)):
        columns = _columns(table)
        rows >>= 8
        lows = np.searchsorted(heads, first).tolist()
        found = np.empty((8, len(heads)), np.int8)
        for d in range(8):
            nodes: dict[int, int] = {}
            for b, low in zip(bytes_, lows):
                nodes.setdefault((1 << d) + (b >> 8 - d), low)
            for (node, low), high in zip(nodes.items(), [*nodes.values(), len(heads)][1:]):
                columns[node].take(rows[low:high], out=found[d, low:high], mode="clip")
        alone = len(heads) == len(keys)
        if signed:
            found *= signs if alone else signs.take(heads, axis=1)
        yield found, None if alone else np.repeat(np.arange(len(heads)), np.diff(heads, append=len(keys)))


def _inputs(tables: list[np.ndarray], keys: np.ndarray, signed: bool = False) -> np.ndarray:
    """(keys, 8 bits, contexts) table entries; of keys in the order of their bytes the bits of a context lie side by side in memory."""
    byte = keys & np.uint64(255)
    if (byte[1:] < byte[:-1]).any():
        order = np.argsort(byte, kind="stable")
        return _inputs(tables, keys[order], signed)[np.argsort(order)]
    out = np.empty((len(keys), len(tables)), np.int64)
    for start in range(0, len(keys), NEAR):   # few enough for the processor's cache
        for i, (found, run) in enumerate(_entries(tables, keys[start:start + NEAR], signed)):
            entries = np.ascontiguousarray(found.T).view(np.int64)[:, 0]
            out[start:start + NEAR, i] = entries if run is None else entries.take(run)
    return out.view(np.int8).reshape(*out.shape, 8).transpose(0, 2, 1)


def _signed(tables: list[np.ndarray], keys: np.ndarray) -> np.ndarray:
    """Table entries turned such that a positive one speaks for the bit that came."""
    return _inputs(tables, keys, signed=True)


def cost(tables: list[np.ndarray], texts: list[bytes], weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Natural-log coding costs of lower-cased texts with their ends, and the weights each text ended with.

    weights: (8, contexts). Texts are read side by side; the result of a text does not depend on the texts beside it.
    """
    total = np.zeros(len(texts))
    final = np.zeros((len(texts), *weights.shape), np.float32)
    against = weights.T.astype(np.float32) * np.float32(-SCALE)
    n_contexts, block = len(against), np.arange(BLOCK)[:, None]
    # of bytes, texts and bits; places are reused, as new memory is dear
    codes_ = np.empty((BLOCK * LANES, n_contexts), np.int64)
    inputs_, odds_, inverse_ = (np.empty(n * BLOCK * LANES * 8, np.float32) for n in (n_contexts, 1, 1))
    for places, longest in _lanes(texts):
        w = np.repeat(against[:, None], len(places), axis=1)    # context, text, bit
        own = np.zeros(len(places))
        for start in range(0, longest, LANE_BYTES):
            parts = [_part(texts[i], start, LANE_BYTES) for i in places]
            sizes = np.array([len(p) for _, p in parts])     # in ascending order
            first = np.cumsum(sizes) - sizes
            keys, at = _numbered(_keys(parts))
            inputs = _signed(tables, keys).transpose(0, 2, 1).view(np.int64)[:, :, 0]
            for low in range(0, len(places), LANES):   # few enough for the processor's cache
                high = min(low + LANES, len(places))
                for from_ in range(0, int(sizes[high - 1]), BLOCK):
                    lanes = slice(low + int(np.searchsorted(sizes[low:high], from_, "right")), high)
                    where = block + (first[lanes] + from_)
                    past, rate = None, np.float32(RATE * SCALE / BLOCK)
                    if sizes[lanes.start] < from_ + BLOCK:
                        n = np.minimum(sizes[lanes] - from_, BLOCK)
                        past = block >= n
                        where[past] = 0
                        rate = (RATE * SCALE / n * np.minimum(n / BLOCK, 1)).astype(np.float32)[:, None]
                    found = at.take(where)
                    shape = (BLOCK, found.shape[1] * 8)
                    x = inputs_[:n_contexts * found.size * 8].reshape(n_contexts, *shape)
                    odds, inverse = odds_[:found.size * 8].reshape(shape), inverse_[:found.size * 8].reshape(shape)
                    codes = inputs.take(found.reshape(-1), axis=0, out=codes_[:found.size], mode="clip")
                    for i in range(n_contexts):
                        x[i] = codes[:, i].copy().view(np.int8).reshape(shape)
                    if past is not None:
                        x.reshape(n_contexts, *found.shape, 8)[:, past] = 0
                    np.einsum("cbi,ci->bi", x, w[:, lanes].reshape(n_contexts, -1), out=odds)    # against the bit that came
                    np.exp(np.clip(odds, -15, 15, out=odds), out=odds)
                    np.add(odds, 1, out=inverse)
                    wrong = np.divide(odds, inverse, out=odds)
                    w[:, lanes] -= np.einsum("bi,cbi->ci", wrong, x).reshape(n_contexts, -1, 8) * rate
                    if past is not None:
                        inverse.reshape(*found.shape, 8)[past] = 1
                    # products of four inverse chances stay within float32
                    chances = inverse.reshape(4, BLOCK // 4, -1)
                    bits = np.log(chances[0] * chances[1] * (chances[2] * chances[3]))
                    own[lanes] += bits.sum(axis=0, dtype=np.float64).reshape(-1, 8).sum(axis=1)
        total[places] = own
        final[places] = w.transpose(1, 2, 0) / np.float32(-SCALE)
    return total, final


def moments(tables: list[np.ndarray], texts: list[bytes], weights: np.ndarray) -> np.ndarray:
    """(8, contexts, 1 + contexts): the first and second derivatives, by the weights, of minus the coding costs and of the costs of texts."""
    total, w = np.zeros((*weights.shape, 1 + weights.shape[1])), (weights * SCALE).astype(np.float32)
    for keys, n in _stretches(texts):
        for start in range(0, len(keys), NEAR):
            some = keys[start:start + NEAR]
            x = np.empty((*weights.shape, len(some)), np.float32)      # bit, context, key
            for i, (found, run) in enumerate(_entries(tables, some, signed=True)):
                x[:, i] = found if run is None else found.take(run, axis=1)
            odds = (-w[:, None] @ x)[:, 0]
            np.exp(np.clip(odds, -15, 15, out=odds), out=odds)
            wrong = odds / (odds + 1)
            slope = wrong * n[start:start + NEAR].astype(np.float32)
            total[:, :, 0] += (x @ slope[..., None])[..., 0]
            slope -= slope * wrong
            total[:, :, 1:] += x @ (x * slope[:, None]).transpose(0, 2, 1)
    return total * np.concatenate([[SCALE], [SCALE ** 2] * weights.shape[1]])


def words_of(text: bytes) -> list[bytes]:
    return text.lower().split()


def held_out(id_col: str = "doc_id", parts: int = 7, part: int = 2) -> Column:
    """Whether crc32 of the id as text falls into the part that is kept from learning; a null id does not."""
    return F.coalesce(F.crc32(named(id_col).cast("string")) % parts == part, F.lit(False))


def _gather(texts: DataFrame) -> DataFrame:
    """(kind, key, n, task, data): kind -1 is a word and its training count; kind 2 t + half a chunk of table t, of one half of the texts."""
    names = ["kind", "key", "n", "task", "data"]

    def of_words(words: Counter, task: int):
        items = list(words.items())
        for start in range(0, len(items), 50_000):
            some = items[start:start + 50_000]
            n = len(some)
            yield pa.RecordBatch.from_arrays(
                [pa.array([-1] * n, pa.int32()), pa.array([w for w, _ in some], pa.binary()), pa.array([c for _, c in some], pa.int64()),
                 pa.array([task] * n, pa.int64()), pa.nulls(n, pa.binary())], names=names)

    def run(batches):
        words: Counter = Counter()
        tables = [Counts() for _ in range(2 * len(TABLES))]
        task = TaskContext.get().partitionId()
        for batch in batches:
            for part in pieces(batch, "text"):
                found = [t.lower() for t in utf8(part.column("text"))]
                for t in found:
                    words.update(t.split())
                if len(words) > WORDS:
                    yield from of_words(words, task)
                    words.clear()
                halves = part.column("half").to_pylist()
                for half in (0, 1):
                    for i, at, n in _counted([t for t, h in zip(found, halves) if h == half]):
                        tables[2 * i + half].add(at, n)
        yield from of_words(words, task)
        for kind, table in enumerate(tables):
            table.settle()
            edges = np.searchsorted(table.at, np.arange(0, TABLES[kind // 2] + 1, CHUNK))
            for chunk in np.flatnonzero(np.diff(edges)).tolist():
                own = slice(edges[chunk], edges[chunk + 1])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([kind], pa.int32()), pa.array([(table.at[own] % CHUNK).astype("<u2").tobytes()], pa.binary()),
                     pa.array([chunk], pa.int64()), pa.array([task], pa.int64()), pa.array([table.n[own].astype("<u4").tobytes()], pa.binary())],
                    names=names)

    return texts.where("NOT held").select("text", "half").mapInArrow(run, "kind int, key binary, n long, task long, data binary")


def _summed(rows: pd.DataFrame) -> np.ndarray:
    total = np.zeros(CHUNK, np.uint64)
    for key, data in zip(rows["key"], rows["data"]):
        total[np.frombuffer(key, "<u2")] += np.frombuffer(data, "<u4")
    return np.minimum(total, 0xFFFFFFFF)


def _tables(chunks: DataFrame, tasks: int) -> DataFrame:
    """(kind, n, zero, one, both): chunks of the finished tables of either half and of both; their size is fixed by BITS."""
    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        total = _summed(rows)
        at = np.flatnonzero(total)
        first = rows.iloc[0]
        return pd.DataFrame({"kind": [first["kind"]], "key": [at.astype("<u2").tobytes()], "n": [first["n"]],
                             "task": [first["task"] // FAN], "data": [total[at].astype("<u4").tobytes()]})

    def finish(rows: pd.DataFrame) -> pd.DataFrame:
        first = rows.iloc[0]
        halves = [_summed(rows[rows["kind"] % 2 == half]) for half in (0, 1)]
        made = [predictions(counts).tobytes() for counts in (*halves, np.minimum(halves[0] + halves[1], 0xFFFFFFFF))]
        return pd.DataFrame({"kind": [first["kind"] // 2], "n": [first["n"]], "zero": made[:1], "one": made[1:2], "both": made[2:]})

    while tasks > FAN:
        chunks = chunks.groupBy("kind", "n", F.floor(F.col("task") / FAN)).applyInPandas(merge, chunks.schema)
        tasks = -(-tasks // FAN)
    return written(chunks.groupBy(F.floor(F.col("kind") / 2), "n").applyInPandas(
        finish, "kind int, n long, zero binary, one binary, both binary"), "tables")


def _sent(finished: DataFrame, of: str):
    """The finished tables of one half or of both by their columns, sent to the executors."""
    tables = [np.zeros((256, n // 256), np.int8) for n in TABLES]
    rows = CHUNK // 256
    for r in finished.select("kind", "n", of).toLocalIterator():
        tables[r["kind"]][:, r["n"] * rows:(r["n"] + 1) * rows] = _columns(np.frombuffer(bytes(r[of]), np.int8))
    return finished.sparkSession.sparkContext.broadcast(tables)


def _heavy(counts: DataFrame, most: int) -> dict[bytes, int]:
    """The counts of the most frequent words: all that occur at least so often, with the smallest bound that most allows."""
    bins = counts.groupBy(F.floor(F.log2("c") * 8).alias("bin")).count().collect()   # at most a few hundred
    bound, held = None, 0
    for b in sorted(bins, key=lambda r: -r["bin"]):
        held += b["count"]
        if held > most:
            break
        bound = b["bin"]
    if bound is None:
        return {}
    rows = counts.where(F.floor(F.log2("c") * 8) >= bound).select("word", "c")
    return {bytes(r["word"]): r["c"] for r in rows.toLocalIterator()}


def _first_weights(texts: DataFrame, finished: DataFrame) -> np.ndarray:
    """START after STEPS steps of Newton's method towards the weights of least cost for all training texts, each with the tables of the other half.

    A step sums derivatives over all texts, so it does not depend on how they lie in partitions; PULL holds the weights near START
    where texts are few, and no weight moves more than FAR in a step. The halves are read one after the other, so executors hold the tables of one.
    """
    start = np.tile(np.array(START), (8, 1))
    weights = start.copy()

    def derivatives(tables):
        def step(batches):
            total = np.zeros((*weights.shape, 1 + weights.shape[1]))
            for batch in batches:
                for part in pieces(batch, "text"):
                    total += moments(tables.value, [t.lower() for t in utf8(part.column("text"))], weights)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["place", "part"])

        return step

    for _ in range(STEPS):
        total = np.zeros((*weights.shape, 1 + weights.shape[1]))
        for half, other in ((0, "one"), (1, "zero")):
            tables = _sent(finished, other)
            parts = texts.where(~F.col("held") & (F.col("half") == half)).select("text").mapInArrow(derivatives(tables), "place long, part double")
            for r in parts.groupBy("place").agg(F.sum("part").alias("sum")).collect():
                total.flat[r["place"]] += r["sum"]
            tables.destroy()
        slope = total[:, :, 0] - PULL * (weights - start)
        weights = weights + np.clip(np.linalg.solve(total[:, :, 1:] + PULL * np.eye(weights.shape[1]), slope[..., None])[..., 0], -FAR, FAR)
    # rounded, as sums differ in their last digits by the order of their parts
    return np.round(weights, 3).astype(np.float32)


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held: Column | None = None, heavy: int = HEAVY) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) of every row.

    held: which rows are kept from learning; by default a part of the ids' checksums. Texts are lower-cased (A-Z). base_score is the
    unigram model with one added to each count, over the words and one end of each text; score is the mixed
    model's log10 probability of all bytes and the end. All training rows are counted and fit the first weights; the halves for
    this go by a hash of the texts, so copies fall into one.

    A null or empty text has its end only. Repeated rows are learned and scored each time; rows with null ids are learned
    from. Without any training row counts are zero and all contexts predict one half. An empty table gives an empty
    table; further columns are not read.
    """
    held = held_out(id_col) if held is None else held
    spark = docs.sparkSession
    flagged = docs.select(named(id_col).alias("id"), F.coalesce(named(text_col).cast("string"), F.lit("")).alias("text"),
                          F.coalesce(held, F.lit(False)).alias("held"))
    flagged = flagged.withColumn("half", F.pmod(F.xxhash64("text"), F.lit(2)).cast("int"))
    n_docs = flagged.where("NOT held").count()

    gathered = written(_gather(flagged), "gathered")
    counts = written(gathered.where("kind = -1").groupBy(F.col("key").alias("word")).agg(F.sum("n").alias("c")), "words")
    n_words, n_distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    known_end = int(n_docs > 0)
    total, distinct = n_words + n_docs, n_distinct + known_end
    chunks = gathered.where("kind >= 0")
    tasks = (chunks.agg(F.max("task")).first()[0] or 0) + 1
    finished = _tables(chunks, tasks)
    weights = _first_weights(flagged, finished)
    tables = _sent(finished, "both")
    frequent = spark.sparkContext.broadcast({w: (math.log10(c + 1)) for w, c in _heavy(counts, heavy).items()})

    def run(batches):
        log_count = frequent.value
        task, row = TaskContext.get().partitionId(), 0
        for batch in batches:
            for part in pieces(batch, "text"):
                texts = [t.lower() for t in utf8(part.column("text"))]
                costs, _ = cost(tables.value, texts, weights)
                n, known, base, rare, times, ends = [], [], [], [], [], [0]
                for t in texts:
                    words = t.split()
                    found = list(map(log_count.get, words))
                    n.append(len(words))
                    base.append(math.fsum(filter(None, found)))     # none is zero
                    known.append(len(words) - found.count(None))
                    own = Counter(compress(words, map(not_, found)))
                    rare += own
                    times += own.values()
                    ends.append(len(rare))
                keys = np.arange(row, row + len(texts), dtype=np.int64) + (task << 33)
                row += len(texts)
                yield pa.RecordBatch.from_arrays([
                    pa.array(keys), part.column("id"), part.column("held"), pa.array(n, pa.int64()), pa.array(known, pa.int64()),
                    pa.array(base, pa.float64()), pa.array(costs, pa.float64()), pa.array([len(t) + 1 for t in texts], pa.int64()),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(
                        [pa.array(rare, pa.binary()), pa.array(times, pa.int64())], names=["word", "tf"]))],
                    names=["row", "id", "held", "words", "known", "base", "cost", "bytes", "rare"])

    kind = docs.schema[id_col].dataType.simpleString()
    scored = written(flagged.select("id", "text", "held").mapInArrow(
        run, f"row long, id {kind}, held boolean, words long, known long, base double, cost double, bytes long, "
             "rare array<struct<word: binary, tf: long>>"), "scored")
    rare = scored.select("row", F.inline("rare")).join(counts, "word")
    more = rare.groupBy("row").agg(F.sum("tf").alias("known2"), F.sum(F.col("tf") * F.log10(F.col("c") + 1)).alias("base2"))
    zero = F.lit(0)
    return scored.drop("rare").join(more, "row", "left").select(
        F.col("id").alias(id_col), F.col("held").alias("held_out"), (F.col("words") + 1).alias("n_tokens"),
        (F.col("known") + F.coalesce("known2", zero) + known_end).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("base2", zero) + math.log10(n_docs + 1)
         - (F.col("words") + 1) * math.log10(total + distinct + 1)).alias("base_score"),
        (-F.col("cost") / math.log(10)).alias("score"), (F.col("cost") / math.log(2) / F.col("bytes")).alias("bits_per_byte"))
