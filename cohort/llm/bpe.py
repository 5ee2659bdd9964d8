"""BPE encoding and decoding of whole texts with files of the tokenizers library.

A tokenizer that drops white space treats the runs between spaces by themselves, so runs are encoded once and remembered. A run
without any split point may be as long as a text: its encoding is put together by tree concatenation. Leaves are
encoded in parallel by the library; where two encoded halves meet, a window of tokens around the join is encoded again and
grows until its outer tokens are those of both sides. A sequence of tokens is the encoding of its text when every two
neighbours are the encoding of theirs, so sides that agree on a token can be joined at it.
"""

from __future__ import annotations

import hashlib
import json
import re
import string
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StringType, StructField, StructType
from tokenizers import Tokenizer

from cohort.llm.common import MEMO_CHARS, MEMO_WORDS, Memo, map_texts, once

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
# Characters that normalisation leaves alone but for their case, which is the same in every library.
PLAIN = re.compile("[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u0137\u0139-\u0148\u014a-\u017e]+")
MARKS = string.punctuation + string.digits
MARK_RUNS = 10_000   # runs of marks and digits whose parts a worker remembers
LEAF = 4_096     # symbols of a leaf of the tree; longer words are put together
WINDOW = 8       # tokens on each side of a join that are encoded again at first
DIGESTED = 120_000   # words that a worker remembers with their digests' parts, which take more memory than ids


class Codec:
    """A tokenizer file with padding and truncation off, and without special tokens added."""

    def __init__(self, path: str, leaf: int = LEAF, window: int = WINDOW, remembered: int = MEMO_WORDS):
        self.leaf, self.window = leaf, window
        self.whole = Tokenizer.from_file(path)
        self.whole.no_padding()
        self.whole.no_truncation()
        spec = json.loads(self.whole.to_str())
        self.special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        # the merges alone, on a word that is normalised and split off already
        self.merges = Tokenizer.from_str(json.dumps(spec | {
            "normalizer": None, "pre_tokenizer": None, "post_processor": None, "decoder": None, "added_tokens": []}))
        self.by_run = self._drops_space()
        self.pattern = self._pattern(spec) if self.by_run else None
        self.marks = lru_cache(MARK_RUNS)(self.words_of)
        self.words = Memo(self._merge_words, remembered)
        # the printable form of each byte in a byte-level vocabulary: itself, or the next free code point from 256 on
        kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        others = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in kept)}
        self.printable = [chr(others.get(b, b)) for b in range(256)]
        self.tokens = [self.whole.id_to_token(i) for i in range(self.whole.get_vocab_size())]
        self.memo = Memo(self.encode_runs)

    def _drops_space(self) -> bool:
        ids = lambda t: self.whole.encode(t, add_special_tokens=False).ids
        return all(ids(s.join("aB9")) == ids("a") + ids("B") + ids("9") for s in (" ", "\n", " \n  ")) and not ids(" \n")

    def runs(self, text: str) -> list[str]:
        """The parts of a text that are encoded by themselves."""
        return [r for r in text.replace("\n", " ").split(" ") if r] if self.by_run else [text] if text else []

    def run(self, run: str) -> list[int]:
        """The ids of one part."""
        if len(run) <= self.leaf or not self.by_run:
            return self.whole.encode(run, add_special_tokens=False).ids
        out: list[int] = []
        for part in re.split("(" + "|".join(map(re.escape, self.special)) + ")", run) if self.special else [run]:
            if part in self.special:
                out.append(self.whole.token_to_id(part))
            elif part:
                normal = self.whole.normalizer.normalize_str(part) if self.whole.normalizer else part
                for word, _ in self.whole.pre_tokenizer.pre_tokenize_str(normal):
                    out += self.tree(word)
        return out

    def _pattern(self, spec: dict):
        """The splitting pattern, when the file lower-cases, splits by a pattern and maps bytes, and does nothing else."""
        form = lambda x, *names: [s.get("type") for s in (x or {}).get(names[0], [])] == list(names[1:])
        if not (form(spec["normalizer"], "normalizers", "NFC", "Replace", "Lowercase")
                and form(spec["pre_tokenizer"], "pretokenizers", "Split", "ByteLevel")):
            return None
        space, (split, level) = spec["normalizer"]["normalizers"][1], spec["pre_tokenizer"]["pretokenizers"]
        known = (space["pattern"] == {"Regex": "\\s+"} and space["content"] == " " and split["invert"] and split["behavior"] == "Removed"
                 and "Regex" in split["pattern"] and not level["add_prefix_space"] and not level["use_regex"])
        pattern = regex.compile(split["pattern"]["Regex"]) if known else None
        # most runs are a word, or one with marks or digits behind, and are told without the pattern but for these
        usual = {"ab": ["ab"], "ab,": ["ab", ","], "ab1": ["ab", "1"], "ab'": ["ab", "'"], "é-": ["é", "-"],
                 "ab&&&": ["ab", "&&&"], "ab12,": ["ab", "1", "2", ","], "ab',1": ["ab", "',", "1"]}
        return pattern if known and all(pattern.findall(t) == words for t, words in usual.items()) else None

    def words_of(self, plain: str) -> list[int]:
        """The ids of a plain run that the pattern splits."""
        words = self.pattern.findall(plain.lower())
        code = dict(zip(own := list(set(words)), self.words.each(own)))
        return [i for w in words for i in code[w]]

    def _merge_words(self, words: list[str]) -> list[list[int]]:
        mapped = [w if w.isascii() else "".join([self.printable[b] for b in w.encode()]) for w in words]
        tokens = self.merges.model.tokenize   # a word is one piece, so the model alone gives its ids, without an encoding around them
        return [[t.id for t in tokens(w)] for w in mapped]

    def encode_runs(self, runs: list[str]) -> list[list[int]]:
        """The ids of each run. Plain runs are split here and their words, which repeat more than runs, are remembered."""
        everything = "\n".join(runs)
        special = any(t in everything for t in self.special)
        out, at, words, rests, other = [None] * len(runs), [], [], [], []
        leaf, plain = self.leaf, PLAIN.fullmatch
        for i, r in enumerate(runs):
            if len(r) > leaf:
                out[i] = self.run(r)
            elif self.pattern is None or not plain(r) or special and any(t in r for t in self.special):
                other.append(i)
            else:
                word = r.rstrip(MARKS)
                n = len(r) - len(word)
                if n <= MEMO_CHARS and word.isalpha():
                    at.append(i)
                    words.append(word.lower())
                    rests.append(self.marks(r[-n:]) if n else None)
                else:
                    out[i] = self.words_of(r)
        distinct = list(set(words))
        code = dict(zip(distinct, self.words.each(distinct)))
        for i, w, rest in zip(at, words, rests):
            out[i] = code[w] + rest if rest else code[w]
        if other:
            for i, e in zip(other, self.whole.encode_batch_fast([runs[i] for i in other], add_special_tokens=False)):
                out[i] = e.ids
        return out

    def tree(self, word: str) -> list[int]:
        """The ids of one word, which the splitting pattern does not cut."""
        if len(word) <= self.leaf:
            return self.merges.encode(word, add_special_tokens=False).ids
        cuts = [*range(0, len(word), self.leaf), len(word)]
        nodes = []
        for start, e in zip(cuts, self.merges.encode_batch([word[a:b] for a, b in zip(cuts, cuts[1:])], add_special_tokens=False)):
            nodes.append([(i, start + a, start + b) for i, (a, b) in zip(e.ids, e.offsets)])
        while len(nodes) > 1:
            joined = [self.join(word, a, b) for a, b in zip(nodes[::2], nodes[1::2])]
            nodes = joined + nodes[len(joined) * 2:]
        return [i for i, _, _ in nodes[0]]

    def join(self, word: str, left: list, right: list) -> list:
        """The tokens (id, start, stop) of two neighbouring stretches of a word, from those of each."""
        size = self.window
        while True:
            a, b = max(0, len(left) - size), min(len(right), size)
            start, stop = left[a][1], right[b - 1][2]
            e = self.merges.encode(word[start:stop], add_special_tokens=False)
            new = [(i, start + x, start + y) for i, (x, y) in zip(e.ids, e.offsets)]
            place = {t: k for k, t in enumerate(new)}
            # the first common token on the left and the last one on the right; a side that is all in needs none
            p = next((i for i in range(a, len(left)) if left[i] in place), None) if a else 0
            q = next((i for i in range(b - 1, -1, -1) if right[i] in place), None) if b < len(right) else b - 1
            if p is not None and q is not None:
                first = place[left[p]] if a else 0
                last = place[right[q]] if b < len(right) else len(new) - 1
                if first <= last:
                    return left[:p if a else 0] + new[first:last + 1] + right[q + 1:]
            size *= 2

    def decode(self, ids: list[int]) -> str:
        return self.whole.decode(ids, skip_special_tokens=False)

    def ids(self, texts: list[str]) -> list[list[int]]:
        """The ids of each text."""
        split = [self.runs(t) for t in texts]
        code = self.memo.codes(split)
        return [[i for r in runs for i in code(r)] for runs in split]


def codec(path: str = VOCABULARY, remembered: int = MEMO_WORDS) -> Codec:
    """The codec of a worker process."""
    return once(f"bpe codec {path} {remembered}", lambda: Codec(path, remembered=remembered))


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = VOCABULARY) -> DataFrame:
    """(id, ids, n_tokens) of every whole text; a null or empty text has no ids.

    No special tokens are added; strings of special tokens in a text become their ids, as in the library. Repeated rows
    stay repeated, null ids have rows too, an empty table gives an empty table, further columns are not read.
    """
    def measure(texts):
        ids = codec(path).ids([t.decode() for t in texts])
        return [pa.array(ids, pa.list_(pa.int32())), [len(i) for i in ids]]

    return map_texts(docs, id_col, text_col, measure, "ids array<int>, n_tokens long")


def decode(tokens: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str = VOCABULARY) -> DataFrame:
    """(id, text) for rows of token ids, special tokens included; null or no ids: an empty text."""
    schema = StructType([StructField(id_col, tokens.schema[id_col].dataType), StructField("text", StringType())])

    def run(batches):
        for b in batches:
            texts = [codec(path).decode(list(x or [])) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(texts, pa.string())], names=schema.names)

    return tokens.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{ids_col}`").alias("ids")).mapInArrow(run, schema)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = VOCABULARY,
            with_ids: bool = False) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): encode and decode in one pass; with_ids adds the ids.

    ids are hashed as decimal numbers joined by spaces. Edge cases as in encode.
    """
    def measure(texts):
        tool = codec(path, DIGESTED)
        plain = tool.whole.decoder is None   # then decoding joins the tokens by spaces, so runs decode by themselves

        def forms(runs):
            return [(len(ids), " ".join(map(str, ids)), " ".join([tool.tokens[i] for i in ids]),
                     np.array(ids, "<i4").tobytes())[:3 if plain and not with_ids else 4]
                    for ids in tool.encode_runs(runs)]

        memo = once(f"bpe digests {path} {with_ids}", lambda: Memo(forms, DIGESTED))
        split = [tool.runs(t.decode()) for t in texts]
        code = memo.codes(split)
        n, hashed, decoded, ids = [], [], [], []
        for runs in split:
            got = [g for g in map(code, runs) if g[0]]
            n.append(sum([g[0] for g in got]))
            hashed.append(hashlib.sha256(" ".join([g[1] for g in got]).encode()).hexdigest())
            text = " ".join([g[2] for g in got]) if plain else tool.decode(np.frombuffer(b"".join([g[3] for g in got]), "<i4").tolist())
            decoded.append(hashlib.sha256(text.encode()).hexdigest())
            if with_ids:
                ids.append(np.frombuffer(b"".join([g[3] for g in got]), "<i4"))
        return [n, hashed, decoded] + ([pa.array(ids, pa.list_(pa.int32()))] if with_ids else [])

    fields = "n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else "")
    return map_texts(docs, id_col, text_col, measure, fields)
