"""Words of many texts at once, in ASCII lower case, as one buffer in which each word is followed by one space.

A word is a maximal run of digits, ASCII letters (A-Z lower-cased, nothing else is) and non-ASCII characters. A run of
consecutive words joined by one space is then a slice of the buffer, and so is a run of words with a space after it.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .text import buffers

_PART = np.zeros(256, bool)
_PART[128:] = True
_PART[[*b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"]] = True
#: Each byte as it stands in the buffer: lower case, and a space for what separates words.
_KEPT = np.where(_PART, np.arange(256), 32).astype(np.uint8)
_KEPT[65:91] += 32


@dataclass
class PlainWords:
    data: np.ndarray   # the buffer
    start: np.ndarray  # first byte of each word, and at the end the size of the buffer
    first: np.ndarray  # index of each text's first word, and at the end the number of words
    raw: np.ndarray    # byte of its text at which each word begins

    @property
    def count(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def text(self) -> np.ndarray:
        """Index of the text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.count)


def plain_words(texts: pa.Array) -> PlainWords:
    """Words of a string column (null: no words)."""
    # one separator after each text, so that no word touches the next text's
    spaced = pc.binary_join_element_wise(pc.fill_null(texts, ""), "", " ")
    data, offsets = buffers(spaced)
    part = _PART[data]
    after = np.zeros(len(part), bool)
    after[1:] = part[:-1]
    at = np.flatnonzero(part | after)
    kept = _KEPT[data[at]]
    begins = np.flatnonzero((kept != 32) & np.concatenate(([True], kept[:-1] == 32))) if len(kept) else np.zeros(0, np.int64)
    raw = at[begins]
    first = np.searchsorted(raw, offsets)
    return PlainWords(kept, np.append(begins, len(kept)), first, raw - np.repeat(offsets[:-1], np.diff(first)))
