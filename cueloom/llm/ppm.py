"""Code length by prediction by partial matching over bytes, learned from a corpus.

The context trie is a set of tables: how often a byte followed its last 0 to ORDER bytes. A text's
bytes are predicted from their longest known context; a byte not seen there costs an escape
(method C: one for each distinct byte of the context) and is predicted from the next shorter
context, without the bytes already excluded by the longer one.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cueloom.llm.common import _ASCII_LOWER, discard, slices, stored
from cueloom.llm.ngram_join import word_hashes

ORDER = 5
#: Bytes that UTF-8 never holds: before the first byte of a text, and after its last.
BEFORE, END = 0xFE, 0xFF
#: Entries of the trie and words whose costs are broadcast, the most frequent, at 16 bytes each; the rest are joined.
FREQUENT, FREQUENT_WORDS = 1 << 21, 1 << 19
#: Distinct entries that a task holds before it hands its counts on, rows of a frame, and bytes handled at a time.
HELD, FRAME, SLICE = 1 << 20, 1 << 17, 1 << 20
BYTES, WORDS = 0, 1
END_WORD = np.array([0x7F4A7C159E3779B9], np.uint64)


def lowered(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").translate(_ASCII_LOWER)


def _pieces(texts: list[bytes]) -> Iterator[list[tuple[int, bytes, bytes]]]:
    """Lists of (text's number, bytes before, bytes) of about SLICE bytes, longer texts in several."""
    held, size = [], 0
    for i, t in enumerate(texts):
        data = bytes([BEFORE] * ORDER) + t + bytes([END])
        for at in range(ORDER, len(data), SLICE):
            body = data[at : at + SLICE]
            held.append((i, data[at - ORDER : at], body))
            size += len(body)
            if size >= SLICE:
                yield held
                held, size = [], 0
    if held:
        yield held


def byte_keys(pieces: list[tuple[int, bytes, bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Packed (context, byte) of every position of the pieces; where each piece begins."""
    sizes = np.array([len(body) for *_, body in pieces])
    b = np.frombuffer(b"".join(x for _, *both in pieces for x in both), np.uint8).astype(np.int64)
    key = b.copy()
    for k in range(1, ORDER + 1):
        key[ORDER:] |= b[ORDER - k : -k] << (8 * k)
    starts = np.cumsum(sizes + ORDER) - sizes
    keep = np.ones(len(b), bool)
    for k in range(1, ORDER + 1):
        keep[starts - k] = False
    return key[keep], np.cumsum(sizes) - sizes


def _words(text: bytes) -> np.ndarray:
    return np.concatenate((word_hashes(text), END_WORD)).view(np.int64)


class _Counts:
    """Counts by key, merged when many have gathered."""

    def __init__(self):
        self.keys, self.n, self.loose, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0

    def add(self, keys: np.ndarray) -> None:
        k, n = np.unique(keys, return_counts=True)
        self.loose.append((k, n))
        self.size += len(k)
        if self.size > HELD:
            self.merge()

    def merge(self) -> None:
        keys = np.concatenate([self.keys, *(k for k, _ in self.loose)])
        n = np.concatenate([self.n, *(n for _, n in self.loose)])
        order = np.argsort(keys, kind="stable")
        keys, n = keys[order], n[order]
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, int)
        self.keys, self.n, self.loose, self.size = keys[first], np.add.reduceat(n, first) if len(first) else n, [], 0

    def take(self, kind: int, least: int = 0) -> Iterator[pa.RecordBatch]:
        """The counts so far if they are more than `least`; they start anew then."""
        self.merge()
        if len(self.keys) <= least:
            return
        keys, n, self.keys, self.n = self.keys, self.n, self.keys[:0], self.n[:0]
        for at in range(0, len(keys), FRAME):
            some = slice(at, at + FRAME)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys[some]), kind, np.int8)), pa.array(keys[some]), pa.array(n[some])], names=["kind", "key", "n"])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """This task's counts of byte contexts and words."""
    counts = [_Counts(), _Counts()]
    for part in slices(batches):
        texts = [lowered(t) for t in part["text"]]
        for pieces in _pieces(texts):
            counts[BYTES].add(byte_keys(pieces)[0])
        counts[WORDS].add(np.concatenate([_words(t) for t in texts]))
        for kind, c in enumerate(counts):
            if c.size + len(c.keys) > HELD:
                yield from c.take(kind, HELD // 2)
    for kind, c in enumerate(counts):
        yield from c.take(kind)


class Costs:
    """Open-addressing table from distinct int64 keys to their costs."""

    def __init__(self, keys: np.ndarray, costs: np.ndarray):
        bits = max(4, int(np.ceil(np.log2(max(len(keys), 1) * 1.5))))
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        at = np.full(1 << bits, -1, np.int32)
        wait, slot = np.arange(len(keys), dtype=np.int32), self._slot(keys)
        while len(wait):
            free = at[slot] < 0
            at[slot[free]] = wait[free]
            lost = at[slot] != wait
            wait, slot = wait[lost], (slot[lost] + 1) & self.mask
        held = np.flatnonzero(at >= 0)
        self.keys, self.costs = np.zeros(1 << bits, np.int64), np.full(1 << bits, np.nan)
        self.keys[held], self.costs[held] = keys[at[held]], costs[at[held]]

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Costs of keys, NaN where absent."""
        slot = self._slot(keys)
        out = self.costs[slot]
        wait = np.flatnonzero((self.keys[slot] != keys) & ~np.isnan(out))
        slot = slot[wait]
        while len(wait):
            slot = (slot + 1) & self.mask
            cost = self.costs[slot]
            out[wait] = cost
            on = (self.keys[slot] != keys[wait]) & ~np.isnan(cost)
            wait, slot = wait[on], slot[on]
        return out


_BUILT: dict[str, Costs] = {}


def _once(known) -> list[Costs]:
    """The tables of a broadcast (name, tables), built once in each Python worker and kept until the next."""
    name, tables = known.value
    if name not in _BUILT:
        _BUILT.clear()
        _BUILT[name] = [Costs(*t) for t in tables]
    return _BUILT[name]


SCORED = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, rare array<struct<kind:tinyint,key:bigint,times:bigint>>"


def _scored(known):
    """Sums of the broadcast costs over every text, and the entries and words that have none, with their
    numbers. Rows are numbered by task and place, which holds because they are stored before they are used."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, words = _once(known)
        number = count(TaskContext.get().partitionId() << 40)
        for part in slices(batches):
            texts = [lowered(t) for t in part["text"]]
            score, misses = np.zeros(len(texts)), []
            for pieces in _pieces(texts):
                keys, starts = byte_keys(pieces)
                cost = trie.find(keys)
                lost = np.flatnonzero(np.isnan(cost))
                cost[lost] = 0
                of = np.array([i for i, *_ in pieces])
                np.add.at(score, of, np.add.reduceat(cost, starts))
                misses.append((of[np.searchsorted(starts, lost, side="right") - 1], keys[lost]))
            owner, missed = (np.concatenate(x) for x in zip(*misses)) if misses else (np.zeros(0, int), np.zeros(0, int))
            ends = np.searchsorted(owner, np.arange(len(texts) + 1))
            lists, n_tokens, n_known, base = [], [], [], []
            for i, t in enumerate(texts):
                w = _words(t)
                cost = words.find(w)
                new = np.isnan(cost)
                n_tokens.append(len(w))
                n_known.append(int((~new).sum()))
                base.append(float(cost[~new].sum()))
                lists.append([np.unique(x, return_counts=True) for x in (missed[ends[i] : ends[i + 1]], w[new])])
            sizes = [len(a[0]) + len(b[0]) for a, b in lists]
            rare = pa.StructArray.from_arrays(
                [
                    pa.array(np.concatenate([np.repeat(np.array([BYTES, WORDS], np.int8), [len(a[0]), len(b[0])]) for a, b in lists])),
                    pa.array(np.concatenate([x[0] for both in lists for x in both])),
                    pa.array(np.concatenate([x[1] for both in lists for x in both])),
                ],
                names=["kind", "key", "times"],
            )
            columns = [pa.array([next(number) for _ in texts]), pa.array(part["doc_id"], pa.int64()), pa.array(part["held_out"]), pa.array(n_tokens), pa.array(n_known), pa.array(base), pa.array(score), pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), rare)]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in SCORED.split(", ")])

    return run


def _suffix(k: int):
    """The last k bytes of a key."""
    return F.col("key").bitwiseAND((1 << (8 * k)) - 1)


def _escaped(new: DataFrame, top: DataFrame) -> DataFrame:
    """(key, cost) of keys that were never counted, by escapes to shorter contexts.

    top(key, n) is the longest level. Level by level a key meets the statistics of its context of so
    many bytes: its count, how many distinct bytes it was followed by, and what these count one level
    down, which is excluded there; and its own count. Every table has a row for each context or entry
    of the trie, the two shortest at most 65,536; nothing is gathered by key.
    """
    levels = {ORDER + 1: top}
    for k in range(ORDER, 0, -1):
        levels[k] = stored(levels[k + 1].groupBy(_suffix(k).alias("key")).agg(F.sum("n").alias("n")))
    state = new.select("key", F.lit(0.0).alias("cost"), F.lit(0).cast("long").alias("excluded"), F.lit(0).cast("long").alias("longer"), F.lit(False).alias("settled"))
    small = lambda df, k: F.broadcast(df) if k <= 2 else df
    for k in range(ORDER + 1, 0, -1):
        entries = levels[k].withColumn("context", F.shiftright("key", 8))
        wanted = state.filter("NOT settled").select(F.shiftright(_suffix(k), 8).alias("context")).distinct()
        if k > 2:
            entries = entries.join(wanted, "context", "left_semi")
        entries = entries.withColumn("key", _suffix(k - 1))
        if k > 1:
            entries = entries.join(small(levels[k - 1].withColumnRenamed("n", "below"), k - 1), "key", "left")
        else:
            entries = entries.withColumn("below", F.lit(0).cast("long"))
        contexts = entries.groupBy("context").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("distinct"), F.sum("below").alias("below"))
        state = state.withColumn("context", F.shiftright(_suffix(k), 8)).join(small(contexts, k), "context", "left")
        if k <= ORDER:
            state = state.withColumn("entry", _suffix(k)).join(small(levels[k].withColumnRenamed("key", "entry"), k), "entry", "left")
        else:
            state = state.withColumn("n", F.lit(None).cast("long"))
        novel = F.col("distinct") - F.col("longer")
        whole = F.col("total") - F.col("excluded") + novel
        step = F.when(F.col("settled"), 0.0).when(F.col("n").isNotNull(), F.log10(F.col("n") / whole)).when(novel > 0, F.log10(novel / whole)).otherwise(0.0)
        state = state.select(
            "key",
            (F.col("cost") + step).alias("cost"),
            F.coalesce("below", F.lit(0)).alias("excluded"),
            F.coalesce("distinct", F.lit(0)).alias("longer"),
            (F.col("settled") | F.col("n").isNotNull()).alias("settled"),
        )
        if k == ORDER - 1:
            state = stored(state)
    return state.select("key", (F.col("cost") - F.when(F.col("settled"), 0.0).otherwise(F.log10(F.greatest(F.lit(1), 256 - F.col("longer"))))).alias("cost"))


def _frequent(counts: DataFrame, most: int) -> DataFrame:
    """The most frequent rows of counts(n, ...), by steps of their counts and at most `most`."""
    step = F.floor(4 * F.log2("n")).cast("int")
    steps = counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("v")).orderBy(F.desc("step")).collect()  # at most 4 for each power of two
    least = None
    for r in steps:
        most -= r["v"]
        if most < 0:
            break
        least = r["step"]
    return counts.filter(step >= least if least is not None else F.lit(False))


def _arrays(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Keys and costs of a table of bounded size, by Arrow whatever the session's settings."""
    table = df.select("key", "cost").toArrow()
    return tuple(table[c].to_numpy() for c in ("key", "cost"))


def score_documents(docs: DataFrame, frequent: int = FREQUENT, frequent_words: int = FREQUENT_WORDS) -> DataFrame:
    """Per row of `docs(doc_id, text)`: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Rows whose crc32(doc_id as text) mod 5 is not 1 are learned from; a null doc_id counts as an
    empty name, a null text as empty. score is the log10 probability of the lower-cased text and its
    end, base_score that of its words by smoothed counts. Repeated rows are learned from and scored
    each. Without training rows every byte and word has the uniform probability of the model. Words
    are told apart by 64-bit hashes. Other columns are ignored; an empty table gives no rows; a very
    long text is read in pieces.

    The texts are read twice, to count and to score, whatever the size of the trie. Counting is a
    partial aggregate of one row per distinct entry and task. Costs of the `frequent` most common
    entries and `frequent_words` words are broadcast; the others of a text, and those never counted,
    are joined by key and summed by row.
    """
    spark = docs.sparkSession
    text, name = F.coalesce(F.col("text").cast("string"), F.lit("")), F.col("doc_id").cast("long")
    held_out = F.crc32(F.coalesce(name.cast("string"), F.lit("")).cast("binary")) % 5 == 1
    rows = docs.select(name.alias("doc_id"), text.alias("text"), held_out.alias("held_out"))
    counts = stored(rows.filter(~F.col("held_out")).select("text").mapInArrow(_counted, "kind byte, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n")))
    trie = counts.filter(F.col("kind") == BYTES).select("key", "n")
    of_context = Window.partitionBy(F.shiftright("key", 8))
    direct = F.log10(F.col("n") / (F.sum("n").over(of_context) + F.count(F.lit(1)).over(of_context)))
    words = counts.filter(F.col("kind") == WORDS).select("key", "n")
    costs = stored(trie.withColumn("cost", direct).withColumn("kind", F.lit(BYTES).cast("byte")).unionByName(words.withColumn("cost", F.log10(F.col("n") + 0.5)).withColumn("kind", F.lit(WORDS).cast("byte"))))
    train_tokens, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    norm = float(np.log10(train_tokens + 0.5 * (distinct + 1)))
    tables = [_arrays(_frequent(costs.filter(F.col("kind") == kind), most)) for kind, most in ((BYTES, frequent), (WORDS, frequent_words))]
    known = spark.sparkContext.broadcast((uuid.uuid4().hex, tables))
    scored = stored(rows.mapInArrow(_scored(known), SCORED))
    known.destroy()  # what it was needed for is stored
    del tables
    pa.default_memory_pool().release_unused()
    rare = scored.select("row", F.explode("rare").alias("rare")).select("row", "rare.*")
    met = stored(rare.select("kind", "key").distinct().join(costs, ["kind", "key"], "left").select("kind", "key", "n", "cost"))
    new = met.filter((F.col("kind") == BYTES) & F.col("n").isNull()).select("key")
    escaped = _escaped(new, trie).select(F.lit(BYTES).cast("byte").alias("kind"), "key", F.lit(None).cast("long").alias("n"), "cost")
    others = met.filter((F.col("kind") == WORDS) | F.col("n").isNotNull()).withColumn("cost", F.coalesce("cost", F.lit(float(np.log10(0.5)))))
    priced = stored(others.unionByName(escaped))
    discard(counts, costs, met)
    sums = rare.join(priced, ["kind", "key"]).groupBy("row").agg(
        F.sum(F.when((F.col("kind") == WORDS) & (F.col("n") > 0), F.col("times")).otherwise(0)).alias("rare_known"),
        F.sum(F.when(F.col("kind") == WORDS, F.col("times") * F.col("cost")).otherwise(0.0)).alias("rare_base"),
        F.sum(F.when(F.col("kind") == BYTES, F.col("times") * F.col("cost")).otherwise(0.0)).alias("rare_score"),
    )
    return scored.join(sums, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(train_tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rare_base", F.lit(0.0)) - F.col("n_tokens") * F.lit(norm)).alias("base_score"),
        (F.col("score") + F.coalesce("rare_score", F.lit(0.0))).alias("score"),
    )


def adaptive_bits(text: str | None, order: int = ORDER) -> float:
    """Code length in bits of one text by a trie that starts empty and learns as it reads."""
    data, seen, bits = lowered(text) + bytes([END]), {}, 0.0
    for i, byte in enumerate(data):
        excluded: set[int] = set()
        contexts = [data[i - k : i] for k in range(min(order, i), -1, -1)]
        for c in contexts:
            counts = {b: n for b, n in seen.get(c, {}).items() if b not in excluded}
            if not counts:
                continue
            total = sum(counts.values()) + len(counts)
            if byte in counts:
                bits -= np.log2(counts[byte] / total)
                break
            bits -= np.log2(len(counts) / total)
            excluded |= counts.keys()
        else:
            bits += np.log2(256 - len(excluded))
        for c in contexts:
            own = seen.setdefault(c, {})
            own[byte] = own.get(byte, 0) + 1
    return float(bits)


def adaptive_code_length(docs: DataFrame) -> DataFrame:
    """doc_id and adaptive_bits of every row: each text by itself, null as empty; narrow, one Arrow pass."""

    @F.pandas_udf("double")
    def bits(texts: pd.Series) -> pd.Series:
        return texts.map(adaptive_bits, na_action=None).astype(float)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), bits(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("adaptive_bits"))
