"""Quality rules: plain text counts, and how well a public vocabulary fits the text.

Fertility of a text under two public vocabularies. Under a SentencePiece one of 32,000 pieces: characters and
words per token, share of byte pieces, and entropy of its tokens in bits; under a byte-level one for many
languages: characters per token, which tells words from letters at random in scripts of which the first
vocabulary knows only single letters. A text outside the band of its language, or of its script where the
language has no band, is rejected. As entropy rises with length, its floor is a line through points over log2
of the number of tokens. In scripts that neither vocabulary knows more of than letters (Thai, Georgian,
Devanagari and the like) fertility can't tell, and the wide band for all others holds.

Defined cases: a null text is an empty one, which fails the base rules; an unknown or null language
takes the band of the script that most letters have; repeated rows are judged alike; an empty table
gives an empty result; other columns are ignored or kept as the function says. Nothing is judged against other documents.
"""

from __future__ import annotations

import base64
import functools
import math
import unicodedata
from collections import Counter
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import text_slices
from ledgerlens.llm.sentencepiece_codec import codec

SYMBOLS = b"#*$%&|<>"
BLANKS = b" \t\n\v\f\r"
#: Base rules: at least so many words, and at most so many percent of them in repeated three-word windows.
LEAST_WORDS, MOST_REPEATED = 50, 50


@dataclass(frozen=True)
class Band:
    """What is accepted: ranges, and entropy floors as (log2 of tokens, bits) points joined by lines."""

    chars_per_token: tuple[float, float] = (0.5, 12.0)
    most_tokens_per_word: float = 12.0
    most_byte_share: float = 0.5
    entropy_floor: tuple[tuple[float, float], ...] = ((0.0, 0.0), (6.0, 2.0), (10.0, 3.0))
    #: Least characters per token of the vocabulary for many languages.
    least_wide: float = 0.0

    def accepts(self, chars: float, tokens_per_word: float, byte_share: float, entropy: float, tokens: int, wide: float = math.inf) -> bool:
        at, bits = zip(*self.entropy_floor, strict=True)
        floor = np.interp(np.log2(max(tokens, 1)), at, bits)
        return bool(self.chars_per_token[0] <= chars <= self.chars_per_token[1] and tokens_per_word <= self.most_tokens_per_word and byte_share <= self.most_byte_share and entropy >= floor and wide >= self.least_wide)


ENGLISH = ((0.0, 0.0), (6.0, 5.15), (7.0, 5.5), (8.0, 5.85), (9.0, 6.15), (10.0, 6.4), (11.0, 6.55), (12.0, 6.6))
EUROPEAN = ((0.0, 0.0), (6.0, 5.1), (7.0, 5.4), (8.0, 5.75), (9.0, 5.95), (10.0, 6.2), (11.0, 6.45), (12.0, 6.5))
#: Production bands: of the four languages set on a labelled sample, of the scripts set between plain prose
#: and the same letters at random.
BANDS = {
    "en": Band((1.95, 6.0), 3.4, 0.12, ENGLISH),
    "de": Band((1.9, 6.0), 3.7, 0.12, EUROPEAN),
    "fr": Band((1.8, 6.0), 3.7, 0.12, EUROPEAN),
    "es": Band((1.8, 6.0), 3.85, 0.12, EUROPEAN),
    "LATIN": Band((1.5, 6.0), 4.5, 0.2, ((0.0, 0.0), (6.0, 4.5), (10.0, 5.5))),
    "CYRILLIC": Band(least_wide=1.9),
    "GREEK": Band(least_wide=1.45),
    "ARABIC": Band(least_wide=1.5),
    "HEBREW": Band(least_wide=1.55),
    "HANGUL": Band(most_tokens_per_word=20.0, least_wide=1.3),
    "CJK": Band((0.3, 12.0), 4096.0, 0.6, least_wide=0.7),
    "HIRAGANA": Band((0.3, 12.0), 4096.0, 0.6),
    "KATAKANA": Band((0.3, 12.0), 4096.0, 0.6),
    "": Band(),
}


@functools.lru_cache(maxsize=2)
def wide_encoding(path: str) -> tiktoken.Encoding:
    """A byte-level vocabulary from its file of ranks."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("wide", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def script_of(text: str) -> str:
    """The script of most letters, by the first word of their Unicode names; "" without letters."""
    found: Counter[str] = Counter()
    for char, times in Counter(text).items():
        if char.isalpha():
            found[unicodedata.name(char, "").partition(" ")[0]] += times
    return max(found, key=lambda s: (found[s], s), default="")


@dataclass
class Measures:
    """The columns of one document."""

    n_words: int = 0
    word_chars: int = 0
    n_symbols: int = 0
    n_dup_lines: int = 0
    n_repeat_words: int = 0
    base_failed: bool = True
    kept: bool = False
    n_tokens: int = 0
    chars_per_token: float = 0.0
    byte_share: float = 0.0
    entropy: float = 0.0
    wide_chars_per_token: float = 0.0


def repeated_words(words: list[bytes]) -> int:
    """Words inside three-word windows that the text has twice or more."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    counts = Counter(windows)
    covered, until = 0, 0
    for k, window in enumerate(windows):
        if counts[window] > 1:
            covered += k + 3 - max(until, k)
            until = k + 3
    return covered


def base_measures(text: str) -> tuple[Measures, list[bytes]]:
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # the ASCII white space that bytes.split() knows is \x20 and \x09-\x0D
    blanks = len(raw) - len(raw.translate(None, BLANKS))
    seen, repeats = set(), 0
    for line in raw.split(b"\n"):
        if line.strip():
            repeats += line in seen
            seen.add(line)
    n_repeat = repeated_words(words)
    failed = len(words) < LEAST_WORDS or 100 * n_repeat > MOST_REPEATED * len(words)
    return Measures(len(words), len(text) - blanks, len(raw) - len(raw.translate(None, SYMBOLS)), repeats, n_repeat, failed), words


def fertility(ids: np.ndarray, is_byte: np.ndarray) -> tuple[float, float]:
    """Share of byte pieces and entropy in bits."""
    if not len(ids):
        return 0.0, 0.0
    counts = np.unique(ids, return_counts=True)[1]
    share = counts / len(ids)
    return float(is_byte[ids].mean()), float(-(share * np.log2(share)).sum())


COLUMNS = [("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("n_tokens", pa.int64()), ("chars_per_token", pa.float64()), ("byte_share", pa.float64()), ("entropy", pa.float64()), ("wide_chars_per_token", pa.float64())]
SPARK = {pa.int64(): "bigint", pa.bool_(): "boolean", pa.float64(): "double"}


def judge(text: str | None, lang: str | None, model_file: str, wide_file: str, bands: dict[str, Band]) -> Measures:
    out, _ = base_measures(text or "")
    own = codec(model_file)
    ids = own.ids(text or "")[0]
    out.n_tokens = len(ids)
    out.byte_share, out.entropy = fertility(ids, own.is_byte)
    out.chars_per_token = len(text or "") / max(1, len(ids))
    out.wide_chars_per_token = len(text or "") / max(1, len(wide_encoding(wide_file).encode_ordinary(text or "")))
    if not out.base_failed:
        band = bands.get(lang or "") if lang else None
        band = band or bands.get(script_of(text)) or bands.get("") or Band()
        out.kept = band.accepts(out.chars_per_token, len(ids) / out.n_words, out.byte_share, out.entropy, len(ids), out.wide_chars_per_token)
    return out


def measure_quality(docs: DataFrame, model_file: str, wide_file: str, bands: dict[str, Band] = BANDS, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """One row a document: key, the counts, the fertility figures, base_failed and kept."""
    kinds = dict(docs.dtypes)

    def run(batches):
        for batch in text_slices(batches):
            found = [judge(t, n, model_file, wide_file, bands) for t, n in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([getattr(x, c) for x in found], kind) for c, kind in COLUMNS)], names=[key, *(c for c, _ in COLUMNS)])

    language = F.col(lang) if lang in kinds else F.lit(None).cast("string")
    return docs.select(key, F.col(text).alias("text"), language.cast("string").alias("lang")).mapInArrow(run, f"`{key}` {kinds[key]}, " + ", ".join(f"{c} {SPARK[kind]}" for c, kind in COLUMNS))


def keep_good(docs: DataFrame, model_file: str, wide_file: str, bands: dict[str, Band] = BANDS, text: str = "text", lang: str = "lang") -> DataFrame:
    """The documents that pass, with all their columns, in one pass without a join."""
    at_text, at_lang = docs.columns.index(text), docs.columns.index(lang) if lang in docs.columns else None

    def run(batches):
        for batch in text_slices(batches, text=text):
            languages = batch.column(at_lang).to_pylist() if at_lang is not None else [None] * batch.num_rows
            yield batch.filter(pa.array([judge(t, n, model_file, wide_file, bands).kept for t, n in zip(batch.column(at_text).to_pylist(), languages, strict=True)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
