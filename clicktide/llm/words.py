"""What a word, a line and a shingle are, for all operators on texts."""

from __future__ import annotations

import numpy as np
import xxhash

# The characters between words, U+0020 and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"
# The same as a pattern for Spark and DuckDB.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

SHINGLE_WORDS = 5

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    """The words of a text in UTF-8; bytes.split() splits at exactly the characters of SPACES."""
    return text.encode().split() if text else []


def mixed(values: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly over all bits."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


class Shingler:
    """Hashes of the word shingles of texts; word hashes are kept between texts, up to a bound."""

    def __init__(self, width: int = SHINGLE_WORDS, known_words: int = 200_000) -> None:
        self.width, self.known_words = width, known_words
        self._known: dict[bytes, int] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        """Sorted distinct 64-bit hashes.

        A text with fewer words than a shingle has one shingle, of all its words; a text without
        words has none.
        """
        words = words_of(text)
        if not words:
            return np.empty(0, dtype=np.uint64)
        known = self._known
        if len(known) > self.known_words:
            known.clear()
        hashes = []
        for word in words:
            value = known.get(word)
            if value is None:
                value = known[word] = xxhash.xxh3_64_intdigest(word)
            hashes.append(value)
        values = np.array(hashes, dtype=np.uint64)
        width = min(self.width, len(values))
        rolled = np.full(len(values) - width + 1, width, dtype=np.uint64)
        for at in range(width):
            rolled = mixed(rolled * _MULTIPLIER + values[at : at + len(rolled)])
        return np.unique(rolled)
