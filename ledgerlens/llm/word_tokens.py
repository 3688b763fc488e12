"""Token ids of a word-level BPE tokenizer file, with what was learnt about a word reused.

The library encodes every distinct word once while it stays in a bounded cache. A text is cut where
the tokenizer itself cuts it, so the ids are those that the library gives for the whole text.
"""

from __future__ import annotations

import functools
import os
import re
from array import array

import numpy as np

from ledgerlens.llm.common import ChunkCache

#: Characters for which lower-casing, NFC and the letter class need no look at their neighbours: ASCII
#: without controls but white space, and the Latin-1 letters.
PLAIN = re.compile(r"[\x20-\x7e\t\n\r\x0b\x0cÀ-ÖØ-öø-ÿ]*")
WORD = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|[^\x20\t\n\r\x0b\x0ca-z0-9ß-öø-ÿ]+")
SPACES = re.compile(r"[\x20\t\n\r\x0b\x0c]+")


class WordTokenizer:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel part
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.is_end = np.zeros(self.library.get_vocab_size(), dtype=bool)
        for token, i in self.library.get_vocab().items():
            self.is_end[i] = token.endswith("</w>")
        self.words = ChunkCache(self._words, entries=400_000)
        self.chunks = ChunkCache(self._each, entries=50_000)

    def _each(self, chunks: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.library.encode_batch_fast(chunks, add_special_tokens=False)]

    def _words(self, words: list[str]) -> list[bytes]:
        """One call for all: a token that ends a word shows where the next begins."""
        (one,) = self.library.encode_batch_fast([" ".join(words)], add_special_tokens=False)
        ids = np.array(one.ids, dtype="<u4")
        ends = (np.flatnonzero(self.is_end[ids]) + 1) * 4
        if len(ends) != len(words) or ends[-1] != 4 * len(ids):
            return self._each(words)
        raw, ends = ids.tobytes(), ends.tolist()
        return [raw[s:e] for s, e in zip([0, *ends[:-1]], ends, strict=True)]

    def encode(self, text: str) -> bytes:
        """The ids of the text as little-endian unsigned 32-bit integers."""
        if "'" not in text and "<|" not in text and PLAIN.fullmatch(text):
            return b"".join(self.words.lookup(WORD.findall(text.lower())))
        # White space of ASCII always parts words; what lies between goes to the library as it is.
        return b"".join(self.chunks.lookup([c for c in SPACES.split(text) if c]))


@functools.lru_cache(maxsize=2)
def word_tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)
