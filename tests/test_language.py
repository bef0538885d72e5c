"""Counts of letters and words against the patterns that say what they are."""

import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cueloom.functions import language as L
from cueloom.functions import text as T

EDGES = r"(?<![A-Za-z0-9_])(?:%s)(?![A-Za-z0-9_])"
PATTERNS = {
    "noise": (rf"(?ai){EDGES % L.SDH}", "[♪♫]"),
    "ascii": ("[A-Za-z]",),
    "cjk": ("[㐀-鿿]",),
    "words": (EDGES % "[A-Za-z]{2,}",),
    "common": (rf"(?ai){EDGES % L.COMMON}",),
}
PIECES = ["the", "The", "AND", "thee", "laugh", "Laughs", "laughss", "music", "x", "_", "7", " ", ",", "♪", "♫", "♩", "你", "好", "㏿", "㐀", "鿿", "ꀀ", "é", "ſ", "K", "😀", "breathing", "beepingx", "internationalization"]


def _plain(text):
    return [sum(len(re.findall(p, text)) for p in PATTERNS[c]) for c in L.COUNTS]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=12).map("".join), min_size=1, max_size=8))
def test_counts_follow_the_patterns(texts):
    data = [t.encode() for t in texts]
    offsets = np.cumsum([0, *map(len, data)])
    got = L.counts(offsets, np.frombuffer(b"".join(data), np.uint8))
    assert [list(map(int, row)) for row in zip(*got)] == [_plain(t) for t in texts]


def test_nulls_parts_and_slices(spark, monkeypatch):
    monkeypatch.setattr(L, "PART", 10)
    texts = ["", None, "the music plays", "♪ la la ♪", None, "你好 and you", "a" * 50, ""]
    func = L.language_counts.func
    for rows in (texts, texts[2:], [], [None], [""]):
        array = pa.array(texts, pa.string()).slice(2) if rows == texts[2:] else pa.array(rows, pa.string())
        assert [r and [r[c] for c in L.COUNTS] for r in func(array).to_pylist()] == [None if t is None else _plain(t) for t in rows]
    df = spark.createDataFrame([(t,) for t in texts], "text string").select(T.english_score(F.col("text")).alias("s"), T.english_confidence(F.col("text")).alias("c"))
    assert [r.s is None for r in df.collect()] == [t is None for t in texts]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("language_counts(text") == 1 and "regexp" not in plan  # every text is gone through once
