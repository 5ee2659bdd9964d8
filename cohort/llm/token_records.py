"""Token ids as length-delimited binary records, with an offset index for shuffled reads.

A data file holds frames: length (8 bytes), masked CRC-32C of the length (4), payload, masked CRC-32C of the payload (4),
all little-endian. A payload is the width of an id in bytes (1 byte: 2 or 4), the length of the row's key (4 bytes;
0xFFFFFFFF for a null key), the key as text, and the ids. The index is a Parquet table with one row per record:
shard, offset, length, n_tokens, and the tokens before it in its shard. Rows are ordered by key over all shards, so the
data files are one stream of tokens; readers take any part of the index, in any order.

Texts are sorted over range partitions and encoded in the task that writes their shard; a repeated task writes the same
bytes and moves them to the same name.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from cohort.llm.bpe import VOCABULARY, Codec, codec
from cohort.llm.checksums import masked
from cohort.llm.common import Memo, once, pieces, texts_of

INDEX = "shard string, offset long, length long, n_tokens long, before long"
READ_BYTES = 8 << 20
WRITE_BYTES, WRITE_ROWS = 8 << 20, 8_000   # of texts that are encoded and written at once; the more, the fewer distinct runs a byte
NO_KEY = 0xFFFFFFFF


def _frames(payloads: list[bytes]) -> list[bytes]:
    heads = [struct.pack("<Q", len(p)) for p in payloads]
    return [b"".join((h, struct.pack("<I", a), p, struct.pack("<I", b)))
            for h, a, p, b in zip(heads, masked(heads).tolist(), payloads, masked(payloads).tolist())]


def _encoder(path: str, end_id: int | None):
    def make():
        tool = codec(path)
        width, kind = (2, "H") if max(len(tool.tokens), (end_id or 0) + 1) <= 1 << 16 else (4, "I")

        def encode(runs):
            ids = tool.encode_runs(runs)
            ends = (np.cumsum([len(i) for i in ids]) * width).tolist()
            data = np.fromiter(chain.from_iterable(ids), f"<u{width}").tobytes()
            return [data[a:b] for a, b in zip([0, *ends], ends)]

        return tool, Memo(encode), width, b"" if end_id is None else struct.pack(f"<{kind}", end_id)

    return once(f"bpe records {path} {end_id}", make)


def _packed(texts: pa.Array, tool: Codec, memo: Memo, width: int) -> list[bytes]:
    """The ids of each text as bytes. Every distinct run of the texts is looked up once, and numbers are put in its places."""
    texts = pc.fill_null(texts, "")
    if tool.by_run:
        split = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")   # as Codec.runs; a run between two spaces has no ids
        first, runs = split.offsets.to_numpy(), split.values
    else:
        first, runs = np.arange(len(texts) + 1), texts
    runs = runs.dictionary_encode()
    words, at = runs.dictionary.to_pylist(), runs.indices.to_numpy()
    known = memo.each(words)
    sizes = np.fromiter(map(len, known), np.int64, len(known)) // width
    n = sizes[at]
    ends = np.cumsum(n)
    places = np.repeat((np.cumsum(sizes) - sizes)[at] - (ends - n), n)
    places += np.arange(len(places))
    data = np.frombuffer(b"".join(known), f"<u{width}")[places].tobytes()
    bounds = (np.concatenate([[0], ends])[first] * width).tolist()
    return [data[a:b] for a, b in zip(bounds, bounds[1:])]


def write_records(
    docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", path: str = VOCABULARY,
    end_id: int | None = None, shards: int | None = None
) -> DataFrame:
    """Encode whole texts, write them in ascending order of the id, and return the index that was written beside them.

    folder: one that all executors share, as a path or URI that pyarrow.fs opens. end_id is appended to each text. There
    are as many shards as the scan of docs has partitions, unless given. A null or empty text is a record of end_id alone;
    rows with null ids come first, repeated rows are repeated records, an empty table gives an empty index. Further columns
    are not read.
    """
    n = shards or max(1, docs.rdd.getNumPartitions())
    rows = texts_of(docs, id_col, text_col).select(F.col("id").cast("string").alias("key"), "text", "id",
                                                   F.xxhash64("text").alias("tie"))
    ordered = rows.repartitionByRange(n, "id", "tie").sortWithinPartitions("id", "tie").select("key", "text")

    def write(batches):
        tool, memo, width, end = _encoder(path, end_id)
        shard = f"part-{TaskContext.get().partitionId():06d}.records"
        disk, base = fs.FileSystem.from_uri(folder)
        disk.create_dir(base, recursive=True)
        own, out, offset, before = f"{base}/_{shard}-{uuid.uuid4().hex}", None, 0, 0
        for batch in batches:
            for part in pieces(batch, "text", WRITE_BYTES, WRITE_ROWS):
                keys = part.column("key").to_pylist()
                ids = [i + end for i in _packed(part.column("text"), tool, memo, width)]
                framed = _frames([b"".join((
                    struct.pack("<BI", width, NO_KEY if k is None else len(k.encode())), (k or "").encode(), i))
                    for k, i in zip(keys, ids)])
                out = out or disk.open_output_stream(own)
                out.write(b"".join(framed))
                lengths, counts = [len(f) for f in framed], [len(i) // width for i in ids]
                ends, sums = np.cumsum([offset, *lengths]), np.cumsum([before, *counts])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in ([shard] * len(ids), ends[:-1], lengths, counts, sums[:-1])],
                    names=["shard", "offset", "length", "n_tokens", "before"])
                offset, before = int(ends[-1]), int(sums[-1])
        if out:
            out.close()
            disk.move(own, f"{base}/{shard}")

    ordered.mapInArrow(write, INDEX).write.parquet(f"{folder}/index")
    return read_index(docs.sparkSession, folder)


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(INDEX).parquet(f"{folder}/index")


def _parsed(frames: list[bytes]) -> list[tuple]:
    """(key, ids) of each frame, after its lengths and checksums were verified."""
    heads, bodies = [f[:8] for f in frames], [f[12:-4] for f in frames]
    sums = b"".join([f[8:12] for f in frames] + [f[-4:] for f in frames])
    if masked(heads + bodies).astype("<u4").tobytes() != sums or any(
            struct.unpack("<Q", h)[0] != len(b) for h, b in zip(heads, bodies)):
        raise ValueError("a record is damaged")
    out = []
    for b in bodies:
        width, n = struct.unpack_from("<BI", b)
        key = None if n == NO_KEY else b[5:5 + n].decode()
        out.append((key, np.frombuffer(b, f"<u{width}", offset=5 + (0 if key is None else n))))
    return out


def read_records(index: DataFrame, folder: str, digest: bool = False) -> DataFrame:
    """Records of any rows of an index: (key, shard, before, n_tokens, ids), or with digest ids_crc32 in place of ids.

    Rows are read where they lie in a task: neighbouring records of a shard come in one read. For a shuffled read,
    pass the index in random order and partitions; for one stream, in its own order.
    """
    last = "ids_crc32 long" if digest else "ids array<int>"

    def read(batches):
        disk, base = fs.FileSystem.from_uri(folder)
        name, file = None, None
        for batch in batches:
            rows = list(zip(*[batch.column(c).to_pylist() for c in ("shard", "offset", "length", "before")]))
            start = 0
            while start < len(rows):
                stop, size = start + 1, rows[start][2]
                while (stop < len(rows) and rows[stop][0] == rows[start][0]
                       and rows[stop][1] == rows[stop - 1][1] + rows[stop - 1][2] and size + rows[stop][2] <= READ_BYTES):
                    size += rows[stop][2]
                    stop += 1
                if rows[start][0] != name:
                    if file:
                        file.close()
                    name = rows[start][0]
                    file = disk.open_input_file(f"{base}/{name}")
                first = rows[start][1]
                data = file.read_at(size, first)
                found = _parsed([data[o - first:o - first + n] for _, o, n, _ in rows[start:stop]])
                yield pa.RecordBatch.from_arrays([
                    pa.array([k for k, _ in found], pa.string()), batch.column("shard").slice(start, stop - start),
                    batch.column("before").slice(start, stop - start), pa.array([len(i) for _, i in found], pa.int64()),
                    pa.array([zlib.crc32(i.astype("<u4").tobytes()) for _, i in found], pa.int64()) if digest else
                    pa.array([i.astype(np.int32) for _, i in found], pa.list_(pa.int32())),
                ], names=["key", "shard", "before", "n_tokens", last.split()[0]])
                start = stop
        if file:
            file.close()

    return index.mapInArrow(read, f"key string, shard string, before long, n_tokens long, {last}")


def shard_starts(index: DataFrame) -> DataFrame:
    """(shard, base): the tokens in all shards before each; a table of one row per shard."""
    sums = index.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    return sums.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("base"))


def token_digests(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", path: str = VOCABULARY,
                  end_id: int | None = 1) -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every row, from the files that write_records makes; edge cases as there."""
    index = write_records(docs, folder, id_col, text_col, path, end_id)
    n = max(1, docs.rdd.getNumPartitions())
    spread = index.repartitionByRange(n, "shard", "offset").sortWithinPartitions("shard", "offset")
    got = read_records(spread, folder, digest=True).join(shard_starts(index), "shard")
    return got.select(F.col("key").cast(docs.schema[id_col].dataType).alias(id_col),
                      (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
