"""Quality rules: fixed measures of a text and a calibrated classifier over hashed n-grams."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cueloom.llm.common import mix64, text_udf

#: Slots of each feature family: byte 4-grams, words, word pairs.
SLOTS = 1 << 15
FAMILIES = 3
#: The classifier is fitted on at most so many labelled documents, chosen by a hash of doc_id.
TRAIN_ROWS = 1200
#: Fixed thresholds: a document is kept from this calibrated probability of good quality on.
KEEP_FROM = 0.5
MIN_WORDS, MAX_REPEATED = 20, 0.30
WINDOW = 8
SEPARATORS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"

MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, quality double, kept boolean"


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # FAMILIES x SLOTS
    bias: float
    slope: float  # calibration: probability = sigmoid(slope * score + shift)
    shift: float

    def probability(self, slots: list[np.ndarray]) -> float:
        score = self.bias + sum(float(w[s].mean()) for w, s in zip(self.weights, slots) if len(s))
        return float(1 / (1 + np.exp(-np.clip(self.slope * score + self.shift, -60, 60))))


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """How many words lie in a window of words that occurs at least twice."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    seen = mix64(np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64))
    keys = np.zeros(n, np.uint64)
    for k in range(window):
        keys = keys * np.uint64(0x9E3779B97F4A7C15) + seen[k : k + n]
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    same = ranked[1:] == ranked[:-1]
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    steps = np.zeros(len(words) + 1, np.int64)
    steps[:n] += twice
    steps[window : window + n] -= twice
    return int((np.cumsum(steps) > 0).sum())


def duplicate_lines(text: str) -> int:
    seen: set[str] = set()
    repeats = 0
    for line in text.split("\n"):
        if line.strip(SEPARATORS):
            repeats += line in seen
            seen.add(line)
    return repeats


def slots(raw: bytes, words: list[bytes]) -> list[np.ndarray]:
    """Feature slots of a text, one array per family, repeats included."""
    b = np.frombuffer(raw, np.uint8).astype(np.uint32)
    grams = (b[:-3] << 24) | (b[1:-2] << 16) | (b[2:-1] << 8) | b[3:] if len(b) > 3 else b[:0]
    single = np.fromiter(map(zlib.crc32, words), np.uint32, len(words))
    pairs = single[:-1] * np.uint32(0x85EBCA6B) + single[1:]
    return [((x * np.uint32(0x9E3779B1)) >> np.uint32(17)).astype(np.int32) for x in (grams, single, pairs)]


def measure(text: str | None, model: Model | None) -> tuple:
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    repeats = repeated_words(words)
    failed = n < MIN_WORDS or 100 * repeats > round(100 * MAX_REPEATED) * n
    good = model.probability(slots(raw, words)) if model else None
    return (
        n,
        len(text) - sum(map(text.count, SEPARATORS)),
        sum(map(text.count, SYMBOLS)),
        duplicate_lines(text),
        repeats,
        failed,
        good,
        not failed and (good is None or good >= KEEP_FROM),
    )


def _sparse(docs: DataFrame) -> pd.DataFrame:
    """Mean slot counts of the chosen labelled documents: a bounded number of rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, label, text in zip(batch["doc_id"], batch["quality"], batch["text"]):
                raw = (text or "").encode("utf-8", "surrogatepass")
                at, share = [], []
                for k, s in enumerate(slots(raw, raw.split())):
                    if len(s):
                        slot, count = np.unique(s, return_counts=True)
                        at.append(slot + k * SLOTS)
                        share.append((count / len(s)).astype(np.float32))
                rows.append((doc, label, np.concatenate(at or [np.zeros(0, np.int32)]), np.concatenate(share or [np.zeros(0, np.float32)])))
            yield pd.DataFrame(rows, columns=["doc_id", "quality", "at", "share"])

    return docs.select("doc_id", "quality", "text").mapInPandas(run, "doc_id long, quality int, at array<int>, share array<float>").toArrow().to_pandas()


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model | None:
    """Logistic regression on at most `rows` labelled documents, calibrated on every fifth of them.

    A document with several labels counts with its lowest; labels other than 0 and 1, and ids
    without a document, are ignored. Without both classes there is no model: the measures decide.
    """
    known = labels.filter("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sample = _sparse(texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "quality").agg(F.max("text").alias("text")))
    sample = sample.sort_values("doc_id").reset_index(drop=True)
    y = sample["quality"].to_numpy(float) if len(sample) else np.zeros(0)
    held = np.arange(len(y)) % 5 == 4
    if len(set(y[~held])) < 2:
        return None
    row = np.repeat(np.arange(len(y), dtype=np.int32), sample["at"].map(len))
    at, share = np.concatenate(sample.pop("at").to_list()).astype(np.int32), np.concatenate(sample.pop("share").to_list())
    used = ~held[row]
    r, a, s = row[used], at[used], share[used]
    size = FAMILIES * SLOTS
    w, bias, m, v = np.zeros(size + 1), 0.0, np.zeros(size + 1), np.zeros(size + 1)
    each = np.where(y == 1, 0.5 / max(1, (y[~held] == 1).sum()), 0.5 / max(1, (y[~held] == 0).sum())) * ~held
    for step in range(1, 61):  # Adam over the whole sample
        p = 1 / (1 + np.exp(-np.clip(np.bincount(r, s * w[a], len(y)) + w[size], -60, 60)))
        off = (p - y) * each
        g = np.append(np.bincount(a, s * off[r], size), off.sum()) + 1e-7 * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.5 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
    bias = float(w[size])
    score = np.bincount(row, share * w[at], len(y)) + bias
    fold = held if len(set(y[held])) == 2 else np.ones(len(y), bool)
    slope, shift = _calibrate(score[fold], y[fold])
    return Model(w[:size].reshape(FAMILIES, SLOTS).astype(np.float32), bias, slope, shift)


def _calibrate(score: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Platt scaling by Newton steps, with smoothed targets."""
    scale = max(1e-9, float(np.abs(score).mean()))
    x = np.stack([score / scale, np.ones_like(score)], 1)
    n1 = y.sum()
    t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (len(y) - n1 + 2))
    b = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        b += np.linalg.solve(h, x.T @ (t - p) - 1e-3 * b)
    return float(b[0] / scale), float(b[1])


def rate(docs: DataFrame, model: Model | None) -> DataFrame:
    """`docs` with the columns of MEASURES added; those replace columns of the same names.

    A null or empty text has no words and fails the base rule. Any other column, null ids, repeated
    and very long rows pass through. Narrow: one Arrow pass over the whole texts, no shuffle.
    """
    names = [c.split()[0] for c in MEASURES.split(", ")]
    rest = [c for c in docs.columns if c.lower() not in names]

    kind = pa.struct([(n, pa.bool_() if n in ("base_failed", "kept") else pa.float64() if n == "quality" else pa.int64()) for n in names])
    measured = text_udf(lambda texts: [dict(zip(names, measure(t, model))) for t in texts], MEASURES, kind)
    return docs.select(*rest, measured(F.col("text").cast("string")).alias("_measured")).select(*rest, "_measured.*")
