"""Hashed word shingles of whole texts, a batch of documents at a time."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np

from cohortia.llm.common import Hashes, mix, stream


class Shingler:
    """Distinct ``k``-word shingles as 64-bit hashes.

    Words are what bytes.split() finds after bytes.lower(): A-Z lower-cased, cut at blank, tab and the other ASCII
    white space. A text with fewer than ``k`` words gives its whole word sequence as one shingle; without words it
    gives the empty set, and so does a null text.
    """

    def __init__(self, k: int):
        self.k = k
        self.words = Hashes()
        self.coef = mix(np.array([stream(i) for i in range(k)])) | np.uint64(1)

    def word_hashes(self, text: str | None) -> np.ndarray:
        words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
        return np.fromiter(map(self.words.__getitem__, words), np.uint64, len(words))

    def sequence(self, w: np.ndarray) -> np.ndarray:
        """A hash for each shingle, in order of their places."""
        return self.windows(w, min(len(w), self.k))

    def windows(self, w: np.ndarray, n: int) -> np.ndarray:
        """The hash of every window of ``n`` words, at most ``k``, as a text of these words alone has it."""
        many = len(w) - n + 1
        if n == 0 or many <= 0:
            return np.empty(0, np.uint64)
        s = w[:many] * self.coef[0]
        for i in range(1, n):
            s = s + w[i : many + i] * self.coef[i]
        return mix(s + np.uint64(n) if n < self.k else s)

    def sets(self, texts: Iterable[str | None]) -> list[np.ndarray]:
        """Sorted distinct shingle hashes of each text."""
        return [np.unique(self.sequence(self.word_hashes(t))) for t in texts]
