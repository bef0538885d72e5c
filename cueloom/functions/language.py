"""Counts of letters and words in texts, over the bytes of whole Arrow columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

# Words that tell sounds from speech, and common English words; "s?" is with and without.
SDH = "music|applause|laughs?|laughing|sighs?|breathing|gasps?|crowd|audience|door|phone|ringing|beeping"
COMMON = (
    "the|and|you|that|this|with|for|have|are|not|but|what|when|where|why|how|more|from|into|your|they|their|there|about|would|could|should|"
    "think|going|because|really|want|need|know|mean|make|take|look|right|yeah|okay|well|then|than"
)
COUNTS = ("noise", "ascii", "cjk", "words", "common")
#: Bytes of text that are counted at a time, but for a single longer text.
PART = 4 << 20


def _number(word: str) -> int:
    number = 0
    for c in word:
        number = number * 27 + ord(c) - 96
    return number


def _listed(pattern: str) -> set[str]:
    return {form for w in pattern.split("|") for form in ([w[:-2], w[:-1]] if w.endswith("?") else [w])}


_LISTED = sorted((_number(w), w in _listed(SDH)) for w in _listed(SDH) | _listed(COMMON))
_NUMBERS, _NOISE = np.array([n for n, _ in _LISTED]), np.array([noise for _, noise in _LISTED])
_LONGEST = max(map(len, _listed(SDH) | _listed(COMMON)))  # 27 to that power fits into 64 bits


def counts(offsets: np.ndarray, data: np.ndarray) -> list[np.ndarray]:
    """COUNTS of the UTF-8 texts that lie between offsets (from 0) of data: music notes and listed noises, ASCII letters,
    characters from U+3400 to U+9FFF, words of two ASCII letters or more, and listed common words. A word is a whole run
    of ASCII letters, digits and underscores."""
    n, size = len(offsets) - 1, len(data)
    upto = lambda mask: np.concatenate([[0], np.cumsum(mask, dtype=np.int32)])
    each = lambda mask: np.diff(upto(mask)[offsets])
    low = data | 0x20
    letter = (low - np.uint8(97)) < 26
    inside = letter | ((data - np.uint8(48)) < 10) | (data == 95)
    padded = np.concatenate([data, np.zeros(2, np.uint8)])
    after, then = padded[1:-1], padded[2:]
    cjk = ((data >= 0xE4) & (data <= 0xE9)) | ((data == 0xE3) & (after >= 0x90))
    notes = (data == 0xE2) & (after == 0x99) & ((then == 0xAA) | (then == 0xAB))
    edge = np.zeros(size + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside & (edge[:-1] | ~np.concatenate([[False], inside[:-1]])))
    ends = np.flatnonzero(inside & (edge[1:] | ~np.concatenate([inside[1:], [False]]))) + 1
    before = upto(letter)
    word = (ends - starts >= 2) & (before[ends] - before[starts] == ends - starts)
    starts, ends = starts[word], ends[word]
    text = np.searchsorted(offsets, starts, "right") - 1
    words = np.bincount(text, minlength=n)
    short = ends - starts <= _LONGEST
    starts, ends, text = starts[short], ends[short], text[short]
    number = np.zeros(len(starts), np.int64)
    for k in range(_LONGEST):
        at = starts + k
        on = at < ends
        number = np.where(on, number * 27 + low[np.where(on, at, 0)] - 96, number)
    found = np.minimum(np.searchsorted(_NUMBERS, number), len(_NUMBERS) - 1)
    listed = _NUMBERS[found] == number
    noise = listed & _NOISE[found]
    return [each(notes) + np.bincount(text[noise], minlength=n), each(letter), each(cjk), words, np.bincount(text[listed & ~noise], minlength=n)]


@F.arrow_udf(StructType([StructField(c, IntegerType()) for c in COUNTS]))
def language_counts(texts: pa.Array) -> pa.Array:
    """COUNTS of texts, null for a null."""
    texts = texts.cast(pa.large_string())
    n = len(texts)
    _, places, content = texts.buffers()
    offsets = np.frombuffer(places, np.int64, n + 1, texts.offset * 8) if n else np.zeros(1, np.int64)
    data = np.frombuffer(content, np.uint8) if content is not None else np.zeros(0, np.uint8)
    parts, a = [], 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + PART, "right")) - 1)
        parts.append(counts(offsets[a : b + 1] - offsets[a], data[offsets[a] : offsets[b]]))
        a = b
    found = [pa.array(np.concatenate([p[k] for p in parts]) if parts else [], pa.int32()) for k in range(len(COUNTS))]
    return pa.StructArray.from_arrays(found, COUNTS, mask=texts.is_null())
