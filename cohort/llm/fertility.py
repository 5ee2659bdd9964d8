"""Quality rules on tokeniser fertility: how a public vocabulary with byte fallback breaks a text up.

Characters per token, the share of byte-fallback tokens and the entropy of the tokens are compared with bands for the
text's script. Every word is encoded on its own, so the measures do not depend on how a table is split into tasks.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import public_tokenizers
from pyspark.sql import DataFrame

from cohort.llm.common import Memo, keep_texts, map_texts, once

VOCABULARY = public_tokenizers.path("piece_bpe_32k.model")
SYMBOLS = [bytes([c]) for c in b"#*$%&|<>"]
PUNCTUATION = bytes(c for c in range(0x21, 0x7F) if not chr(c).isalnum())
MIN_WORDS = 50
MAX_REPEATED = 50   # percent of the words that lie in repeated windows
FIELDS = """n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean,
    kept boolean, script string, n_tokens long, chars_per_token double, fallback_share double, token_entropy double"""


@dataclass(frozen=True)
class Band:
    """What texts of a script are expected to keep within."""

    min_chars_per_token: float   # ASCII punctuation not counted
    max_chars_per_token: float
    max_fallback: float
    min_entropy: float   # bits; for texts of few tokens, at most three quarters of what their number allows


# The vocabulary knows Latin and Cyrillic letters well, others by few pieces or only by bytes.
BANDS = {
    "latin": Band(1.5, 12.0, 0.05, 4.0),
    "cyrillic": Band(1.0, 12.0, 0.10, 4.0),
    "greek": Band(0.5, 8.0, 0.50, 3.5),
    "semitic": Band(0.5, 8.0, 0.60, 3.5),
    "cjk": Band(0.25, 4.0, 0.97, 4.0),
    "other": Band(0.2, 8.0, 1.0, 3.0),
}
# UTF-8 lead bytes of the letters of each script
LEADS = {
    "latin": [*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC3, 0xCA)], "greek": [0xCD, 0xCE, 0xCF],
    "cyrillic": [*range(0xD0, 0xD4)], "semitic": [*range(0xD6, 0xDC)], "cjk": [*range(0xE3, 0xEE)],
    "other": [*range(0xDC, 0xE3), *range(0xF0, 0xF5)],
}


def script_of(text: bytes) -> str:
    """The script with most letters, by lead bytes; without letters: other."""
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    totals = {s: int(counts[leads].sum()) for s, leads in LEADS.items()}
    best = max(totals, key=totals.get)
    return best if totals[best] else "other"


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of three words found at least twice, first places included."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    counts = Counter(windows)
    hit = np.array([counts[w] > 1 for w in windows])
    inside = np.zeros(len(words), bool)
    for k in range(3):
        inside[k:k + len(hit)] |= hit
    return int(inside.sum())


def repeated_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


def _encoder(path: str):
    def make():
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        # words come as UTF-8; bytes that are no UTF-8 cannot come from a string column
        encode = lambda words: [np.array(x, "<u2").tobytes() for x in model.encode([w.decode() for w in words], num_threads=1)]
        return Memo(encode), np.array([model.is_byte(i) for i in range(model.vocab_size())])

    return once(f"fertility {path}", make)


def in_band(script: str, n_tokens: int, per_token: float, fallback: float, entropy: float, bands=BANDS) -> bool:
    """The method's verdict on a text with at least one token."""
    band = bands[script]
    least = min(band.min_entropy, 0.75 * math.log2(max(n_tokens, 2)))
    return band.min_chars_per_token <= per_token <= band.max_chars_per_token and fallback <= band.max_fallback and entropy >= least


def measure(texts: list[bytes], path: str = VOCABULARY, bands=BANDS) -> list[list]:
    """One list for each of FIELDS."""
    memo, is_byte = _encoder(path)
    split = [t.split() for t in texts]
    code = memo.codes(split)
    rows = []
    for text, words in zip(texts, split):
        n_repeat = repeated_words(words)
        failed = len(words) < MIN_WORDS or 100 * n_repeat > MAX_REPEATED * len(words)
        # UTF-8 continuation bytes are no characters of their own
        joined = b"".join(words)
        chars = len(joined) if joined.isascii() else len(joined.decode())
        ids = np.frombuffer(b"".join(map(code, words)), "<u2")
        counts = np.bincount(ids) if len(ids) < 20_000 else np.bincount(ids, minlength=len(is_byte))
        counts = counts[counts > 0]
        # ASCII punctuation takes tokens but carries no text, so it does not count as characters here
        letters = joined.translate(None, PUNCTUATION)
        per_token = (len(letters) if letters.isascii() else len(letters.decode())) / len(ids) if len(ids) else None
        fallback = float(is_byte[ids].mean()) if len(ids) else None
        entropy = float(math.log2(len(ids)) - (counts * np.log2(counts)).sum() / len(ids)) if len(ids) else None
        script = script_of(text)
        kept = not failed and len(ids) > 0 and in_band(script, len(ids), per_token, fallback, entropy, bands)
        rows.append((len(words), chars, sum(map(text.count, SYMBOLS)), repeated_lines(text), n_repeat, failed, kept,
                     script, len(ids), per_token, fallback, entropy))
    return [list(c) for c in zip(*rows)] if rows else [[] for _ in range(12)]


def fertility_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = VOCABULARY,
                    bands=BANDS) -> DataFrame:
    """(id, FIELDS) of every row: base counts, the method's measures, and whether the text is kept.

    A null or empty text has no words: it fails, and its ratios are null. Repeated rows stay repeated, null ids have rows
    too, an empty table gives an empty table, further columns are not read.
    """
    return map_texts(docs, id_col, text_col, lambda texts: measure(texts, path, bands), FIELDS)


def keep_fertile(docs: DataFrame, text_col: str = "text", path: str = VOCABULARY, bands=BANDS) -> DataFrame:
    """The rows of docs, with all their columns, whose texts are kept."""
    return keep_texts(docs, text_col, lambda texts: measure(texts, path, bands)[6])
