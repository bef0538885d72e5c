"""Document fingerprints: quartile codes of hashed byte triplets with the length, and a bounded likeness."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cueloom.llm.common import slices, stored

#: Counters of triplets.
BUCKETS = 256
#: A triplet is a byte and the bytes so much further on, around the text's end; wide gaps tell texts apart that share
#: a language and its syllables.
GAPS = ((7, 12), (5, 13))
FACTOR, SALT = 0x9E3779B1, 0x7F4A7C15
#: Steps of the length code in an octave.
STEPS = 8
#: What unrelated codes differ in on average, 1.25 a bucket, makes a likeness of 0.
APART = BUCKETS * 5 // 4
#: What a step of the length code adds to the difference, for at most so many steps.
STEP_COST, MOST_STEPS = 8, 32

RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_FIELDS = [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
_OUT = pa.schema([*_FIELDS, ("role", pa.string()), ("part", pa.int32()), ("text", pa.string())])


def digest(raw: bytes) -> np.ndarray:
    """The length code, then a code from 0 to 3 for each bucket: the quartile of its count among all counts."""
    n = len(raw)
    counts = np.zeros(BUCKETS, np.int64)
    if n:
        b = np.resize(np.frombuffer(raw, np.uint8), n + max(map(max, GAPS))).astype(np.uint32)
        for k, (i, j) in enumerate(GAPS):
            v = b[:n] | (b[i : n + i] << np.uint32(8)) | (b[j : n + j] << np.uint32(16))
            counts += np.bincount((v * np.uint32(FACTOR) + np.uint32(k * SALT & 0xFFFFFFFF)) >> np.uint32(24), minlength=BUCKETS)
    low, middle, high = np.sort(counts)[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    codes = (counts > low).astype(np.int16) + (counts > middle) + (counts > high)
    return np.concatenate(([min(255, int(STEPS * np.log2(1 + n)))], codes)).astype(np.int16)


def written(d: np.ndarray) -> str:
    """A digest as hexadecimal: two digits of length, then a digit for every two buckets."""
    return f"{d[0]:02x}" + (d[1::2] * 4 + d[2::2]).astype(np.uint8).tobytes().translate(b"0123456789abcdef".ljust(256)).decode()


def read(fingerprint: str) -> np.ndarray:
    """The digest that `written` gave."""
    pairs = np.array([int(c, 16) for c in fingerprint[2:]], np.int16)
    return np.concatenate(([int(fingerprint[:2], 16)], np.stack((pairs // 4, pairs % 4), 1).ravel())).astype(np.int16)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """From 0 to 1: one less the difference of codes and lengths, in parts of what unrelated texts differ in."""
    apart = int(np.abs(a[1:] - b[1:]).sum()) + STEP_COST * min(MOST_STEPS, abs(int(a[0]) - int(b[0])))
    return max(0, APART - apart) / APART


def edited(text: str, other: str) -> str:
    """`text` with its last third, rounded down, replaced by as many first code points of `other`, or by all."""
    k = len(text) // 3
    return text[: len(text) - k] + other[:k]


def _result(doc_id: int | None, text: str, own: np.ndarray, other: str, others: np.ndarray) -> dict:
    raw = edited(text, other).encode("utf-8", "surrogatepass")
    new = digest(raw)
    return {"doc_id": doc_id, "n_chars": len(text), "edited_sha256": hashlib.sha256(raw).hexdigest(), "fingerprint": written(own), "edited_fingerprint": written(new), "near_edited": likeness(own, new), "near_next": likeness(own, others)}


def _digest(text: str) -> np.ndarray:
    return digest(text.encode("utf-8", "surrogatepass"))


def _followed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Results of the sorted rows of a partition, each with the row behind it; its first row (head) and last row
    (last) leave with their texts, to meet those of the neighbouring partitions."""
    part, held = TaskContext.get().partitionId(), None
    ends = lambda role, doc_id, text: pa.RecordBatch.from_pylist([{"role": role, "part": part, "doc_id": doc_id, "text": text}], _OUT)
    for cut in slices(batches, 64):
        out = []
        for doc_id, text in zip(cut["doc_id"], cut["text"]):
            own = _digest(text)
            if held is None:
                yield ends("head", doc_id, text)
            else:
                out.append(_result(*held, text, own))
            held = doc_id, text, own
        yield pa.RecordBatch.from_pylist(out, _OUT)
    if held is not None:
        yield ends("last", *held[:2])


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for cut in slices(batches, 64):
        out = [_result(doc_id, text, _digest(text), other, _digest(other)) for doc_id, text, other in zip(cut["doc_id"], cut["text"], cut["other"])]
        yield pa.RecordBatch.from_pylist(out, pa.schema(_FIELDS))


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """Per row of `docs(doc_id, text)`: fingerprints of the text and of its edited text, and likenesses.

    A null text counts as empty. The next row is the one behind in descending doc_id, null ids last; rows that
    share a doc_id go in the order of xxhash64 of their texts; behind the last row comes the first. A lone row is
    its own next. Texts of fewer bytes than the gaps are read around their end; an empty text has all counts
    equal. Other columns are ignored; an empty table gives no rows.

    The whole texts are shuffled once, by ranges of doc_id and hash; copies of one row are spread by their place.
    A row meets the next one in its partition. Only the rows at the ends of partitions are joined to each other,
    by the numbers of their partitions, which alone pass the driver.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    order = [F.desc_nulls_last("doc_id"), F.asc("hash"), F.asc("place")]
    dealt = rows.select("*", F.xxhash64("text").alias("hash"), F.monotonically_increasing_id().alias("place")).repartitionByRange(*order).sortWithinPartitions(*order)
    found = stored(dealt.select("doc_id", "text").mapInArrow(_followed, f"{RESULT}, role string, part int, text string"))
    spark, names = docs.sparkSession, [f[0] for f in _FIELDS]
    heads = found.filter("role = 'head'").select(F.col("part").alias("behind"), F.col("text").alias("other"))
    parts = sorted(r.behind for r in heads.select("behind").collect())
    behind = spark.createDataFrame(list(zip(parts, parts[1:] + parts[:1])), "part int, behind int")
    lasts = found.filter("role = 'last'").select("doc_id", "text", "part").join(F.broadcast(behind), "part").join(heads, "behind")
    met = lasts.select("doc_id", "text", "other").mapInArrow(_met, RESULT)
    return found.filter("role IS NULL").select(*names).unionByName(met)
