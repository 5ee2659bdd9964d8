"""BPE by tree concatenation, record files and checksums against the library and exact round trips."""

import random
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from cohort.llm import bpe, checksums, token_records
from tests.llm.cases import as_bag, docs, empty, rows


@pytest.fixture(scope="module")
def small():
    return bpe.Codec(bpe.VOCABULARY, leaf=8, window=1)   # every longer word takes the tree


@pytest.fixture(scope="module")
def library():
    return bpe.Codec(bpe.VOCABULARY).whole


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("abcdetion thES'é!?12<|>"), st.characters(codec="utf-8")), max_size=120))
def test_any_text_as_the_library(small, library, text):
    assert small.ids([text])[0] == library.encode(text, add_special_tokens=False).ids


def test_long_unsplit_texts(small, library):
    r = random.Random(1)
    for letters in ("ab", "etaoinshrdlu", "aaaaaaaaab", "é日"):
        text = "".join(r.choice(letters) for _ in range(3000))
        assert small.ids([text])[0] == library.encode(text, add_special_tokens=False).ids


def test_special_strings(small, library):
    for text in ("a<|endoftext|>b" * 20, "<|startoftext|>", "x" * 30 + "<|endoftext|>" + "y" * 30):
        assert small.ids([text])[0] == library.encode(text, add_special_tokens=False).ids


def test_new_words_take_the_model_alone(library, monkeypatch):
    import types

    codec = bpe.Codec(bpe.VOCABULARY, remembered=3)
    monkeypatch.setattr(codec, "merges", types.SimpleNamespace(model=codec.merges.model))   # nothing makes an encoding for a word
    r = random.Random(3)
    texts = [" ".join("".join(r.choice("abtéß'1,") for _ in range(r.randint(1, 80))) for _ in range(30)) for _ in range(20)]
    for text in texts + texts:
        assert codec.ids([text])[0] == library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_packed_ids_of_distinct_runs(name):
    import public_tokenizers
    import pyarrow as pa

    tool, memo, width, _ = token_records._encoder(public_tokenizers.path(name), None)
    texts = ["", None, " ", "\n", "a  b\nc", " x ", "word " * 5, "\u3000é\t日 \r\n", "a<|endoftext|> b", "", "&&& tion&&&"]
    asked = []
    encode, memo.encode = memo.encode, lambda runs: asked.extend(runs) or encode(runs)
    for kind in (pa.string(), pa.large_string()):
        column = pa.array([*texts, *texts], kind)
        for part in (column, column.slice(3, 7), column.slice(1, 0)):
            got = [np.frombuffer(i, f"<u{width}").tolist() for i in token_records._packed(part, tool, memo, width)]
            assert got == [tool.whole.encode(t or "", add_special_tokens=False).ids for t in part.to_pylist()]
    assert len(asked) == len(set(asked))


def test_codes_of_distinct_words():
    from cohort.llm.common import MEMO_CHARS, Memo

    asked = []
    memo = Memo(lambda words: asked.append(words) or [w.upper() for w in words], most=2)
    long = "x" * (MEMO_CHARS + 1)
    for words in (["a", "b", long], ["a", "c", "d"], [], ["c", long, "b"]):
        assert memo.each(words) == [w.upper() for w in words] and set(memo) <= {"a", "b"}
    assert asked == [["a", "b", long], ["c", "d"], ["c", long]]


def test_other_vocabularies(library):
    import public_tokenizers

    codec = bpe.Codec(public_tokenizers.path("byte_bpe_50k.json"))
    assert not codec.by_run
    for text in ("a  b\n c", " x", "word " * 50):
        ids = codec.ids([text])[0]
        assert ids == codec.whole.encode(text, add_special_tokens=False).ids and codec.decode(ids) == text


def test_encode_decode_digests(spark, library):
    import hashlib

    want = []
    for i, t, *_ in rows():
        ids = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert as_bag(map(tuple, bpe.digests(docs(spark)).collect())) == as_bag(want)
    encoded = bpe.encode(docs(spark))
    assert as_bag((r["doc_id"], r["n_tokens"]) for r in encoded.collect()) == as_bag((a, b) for a, b, *_ in want)
    texts = as_bag(r["text"] for r in bpe.decode(encoded).collect())
    assert texts == as_bag(library.decode(library.encode(t or "", add_special_tokens=False).ids, skip_special_tokens=False) for _, t, *_ in rows())
    assert bpe.digests(empty(spark)).count() == 0 and bpe.encode(empty(spark)).count() == 0


def test_checksums():
    assert hex(checksums.crc32c([b"123456789"])[0]) == "0xe3069283"
    assert [hex(x) for x in checksums.crc32c([b"", b"\0" * 32, b"\xff" * 32])] == ["0x0", "0x8a9136aa", "0x62a8ab43"]

    def slow(data):
        r = 0xFFFFFFFF
        for c in data:
            r ^= c
            for _ in range(8):
                r = r >> 1 ^ (0x82F63B78 if r & 1 else 0)
        return r ^ 0xFFFFFFFF

    rng = np.random.default_rng(2)
    parts = [rng.bytes(n) for n in (0, 1, 2, 255, 256, 257, 512, 513, 3000, 70_000)]
    assert [int(x) for x in checksums.crc32c(parts)] == [slow(p) for p in parts]
    crc = slow(b"abc")
    assert int(checksums.masked([b"abc"])[0]) == ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def brute_records(library):
    """In the order of the files: null ids first, ids ascending; equal ids hold equal texts here or are told apart by bags."""
    out = []
    for i, t, *_ in sorted(rows(), key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = library.encode(t or "", add_special_tokens=False).ids + [1]
        out.append((i, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
    return out


def test_record_files(spark, library, tmp_path):
    got = token_records.token_digests(docs(spark), str(tmp_path / "a")).orderBy("start").collect()
    want = brute_records(library)
    assert as_bag((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == as_bag(want)
    assert [r["doc_id"] for r in got] == [i for i, *_ in want]
    start = 0
    for r in got:
        assert r["start"] == start
        start += r["n_tokens"]


def test_files_are_frames_and_any_order_reads(spark, tmp_path):
    from pyspark.sql import functions as F

    folder = str(tmp_path / "b")
    index = token_records.write_records(docs(spark), folder, shards=4)
    names = [r["shard"] for r in index.select("shard").distinct().collect()]
    n = 0
    for name in names:
        data = (tmp_path / "b" / name).read_bytes()
        at = 0
        while at < len(data):
            (size,) = struct.unpack_from("<Q", data, at)
            payload = data[at + 12:at + 12 + size]
            assert struct.unpack_from("<I", data, at + 8)[0] == int(checksums.masked([data[at:at + 8]])[0])
            assert struct.unpack_from("<I", data, at + 12 + size)[0] == int(checksums.masked([payload])[0])
            at += size + 16
            n += 1
    assert n == len(rows()) and 1 < len(names) <= 4
    straight = token_records.read_records(index, folder)
    shuffled = token_records.read_records(index.orderBy(F.xxhash64("shard", "offset")), folder)
    assert as_bag((r["key"], tuple(r["ids"])) for r in straight.collect()) == as_bag((r["key"], tuple(r["ids"])) for r in shuffled.collect())
    part = token_records.read_records(index.where("n_tokens > 50"), folder)
    assert part.count() == index.where("n_tokens > 50").count() > 0


def test_damage_is_found(spark, tmp_path):
    folder = str(tmp_path / "c")
    index = token_records.write_records(docs(spark), folder, shards=1)
    path = next(p for p in (tmp_path / "c").iterdir() if p.name.endswith(".records"))
    data = bytearray(path.read_bytes())
    data[len(data) // 2] ^= 1
    path.write_bytes(data)
    with pytest.raises(Exception, match="damaged"):
        token_records.read_records(index, folder).collect()


def test_no_records(spark, tmp_path):
    assert token_records.token_digests(empty(spark), str(tmp_path / "d")).count() == 0
