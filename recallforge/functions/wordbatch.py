"""The words of many texts at once, as numbers of distinct words; equal to ``text.stemmed`` word by word."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa

from recallforge.functions.text import term

#: Bytes of words: ASCII letters, digits and apostrophes, and all of longer characters (others are blanked before).
_WORD = np.array([b >= 128 or chr(b).isalnum() or b == 39 for b in range(256)])
_OTHER = re.compile(r"[^\w\x00-\x7f]+")


def word_numbers(texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(distinct words, the number of each word of all texts in order, where each text's words begin, and the end)."""
    parts = [t if t is not None and t.isascii() else _OTHER.sub(" ", t or "") for t in texts]
    held = [p.encode() for p in parts]
    data = np.frombuffer(b"\n".join(held), np.uint8)
    word = _WORD[data]
    starts = np.flatnonzero(word & ~np.r_[False, word[:-1]])
    if not len(starts):
        return [], np.empty(0, np.int64), np.zeros(len(texts) + 1, np.int64)
    ends = np.flatnonzero(word & ~np.r_[word[1:], False]) + 1
    text_ends = np.cumsum([len(h) + 1 for h in held]) - 1
    offsets = np.r_[0, np.cumsum(ends - starts)]
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[word])]).dictionary_encode()
    return [w.decode() for w in words.dictionary.to_pylist()], words.indices.to_numpy().astype(np.int64), np.r_[0, np.searchsorted(starts, text_ends)]


class TermBatches:
    """Terms of batches of texts; each word is stemmed once as long as it is remembered, in bounded memory."""

    def __init__(self, most: int = 150_000):
        self.most, self.known = most, {}

    def of(self, word: str) -> str:
        found = self.known.get(word)
        if found is None:
            if len(self.known) >= self.most:
                self.known.clear()
            found = self.known[word] = term.__wrapped__(word)
        return found

    def encode(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(distinct terms, sorted, the number of each token's term, where each text's tokens begin, and the end)."""
        words, numbers, bounds = word_numbers(texts)
        terms = [self.of(w) for w in words]
        distinct = sorted(set(terms))
        at = {t: k for k, t in enumerate(distinct)}
        return distinct, np.array([at[t] for t in terms], np.int64)[numbers] if words else numbers, bounds
