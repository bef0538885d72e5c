"""Near-duplicate embeddings: random-hyperplane sign hashing, exact verification, components."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cueloom.llm.common import discard, stored
from cueloom.llm.components import connected

THRESHOLD = 0.95
#: Chance that a pair exactly at the threshold shares a bucket of some table; closer pairs have more.
RECALL = 0.99
#: Distinct vectors of a bucket that are compared as one block; larger buckets become pairs of blocks.
BLOCK = 512
#: Signs that go to the buckets with a vector, at most.
SKETCH = 256
SEED = 20


def plan_tables(n: int, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int]:
    """(bits, tables) for n distinct vectors: about eight vectors to a random bucket, recall as asked."""
    bits = min(30, max(6, math.ceil(math.log2(max(n, 2) / 8))))
    same = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log(1 - same)))


def most_differing(bits: int, threshold: float = THRESHOLD) -> int:
    """Of so many signs, how many a pair at the threshold may differ in: six deviations over the mean, which
    one pair in 10^9 exceeds."""
    p = math.acos(threshold) / math.pi
    return math.ceil(bits * p + 6 * math.sqrt(bits * p * (1 - p)))


@functools.lru_cache(4)
def _planes(width: int, n: int) -> np.ndarray:
    return np.random.default_rng([SEED, width]).standard_normal((width, n))


def signs_of(unit: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """Sides (row x table x bit) of seeded random hyperplanes that unit vectors lie on."""
    return (unit @ _planes(unit.shape[1], tables * bits) >= 0).reshape(len(unit), tables, bits)


def codes_of(signs: np.ndarray) -> np.ndarray:
    """Buckets (row x table) of sign patterns."""
    return signs @ (1 << np.arange(signs.shape[2], dtype=np.int64))


def _unit(vectors: pd.Series) -> np.ndarray:
    x = np.stack(vectors.to_list()).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # against overflow of the squares
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _hashed(bits: int, tables: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for width, part in batch.groupby(batch["embedding"].map(len)):
                signs = signs_of(_unit(part["embedding"]), bits, tables)
                codes, packed = codes_of(signs), np.packbits(signs.reshape(len(part), -1)[:, :SKETCH], axis=1)
                sketch = [r.tobytes() for r in packed]
                for t in range(tables):
                    yield pd.DataFrame({"width": int(width), "table": t, "code": codes[:, t], "class": part["class"].to_numpy(), "sketch": sketch})

    return run


def _words(sketches: pd.Series) -> np.ndarray:
    """Sketches as rows of 64-bit words."""
    size = len(sketches.iloc[0])
    x = np.zeros((len(sketches), -(-size // 8) * 8), np.uint8)
    x[:, :size] = np.frombuffer(b"".join(sketches), np.uint8).reshape(len(sketches), size)
    return x.view(np.uint64)


def _whole_runs(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """(rows, number of the run of each) of batches sorted by keys; a run never lies in two of them."""
    held = None
    for batch in batches:
        rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
        new = np.zeros(len(rows), bool)
        for k in keys:
            v = rows[k].to_numpy()
            new[1:] |= v[1:] != v[:-1]
        run = np.cumsum(new)
        last = int(np.searchsorted(run, run[-1])) if len(rows) else 0
        if last:
            yield rows.iloc[:last], run[:last]
        held = rows.iloc[last:].reset_index(drop=True)
    if held is not None and len(held):
        yield held, np.zeros(len(held), np.int64)


def _maybe_near(limit: int):
    """Rows whose sketch differs in at most `limit` bits from that of another row of their block."""
    keys = ["width", "table", "code", "low", "high"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, block in _whole_runs(batches, keys):
            words = _words(rows["sketch"])
            part, apart = rows["part"].to_numpy(), (rows["low"] != rows["high"]).to_numpy()
            near = np.zeros(len(rows), bool)
            at, step = np.arange(len(rows)), 0
            while True:  # every row beside the one `step` further on in its block
                step += 1
                at = at[at < len(rows) - step]
                at = at[block[at] == block[at + step]]
                if not len(at):
                    break
                close = np.bitwise_count(words[at] ^ words[at + step]).sum(axis=1) <= limit
                close &= ~apart[at] | (part[at] != part[at + step])
                near[at[close]] = near[at[close] + step] = True
            yield rows[near]

    return run


def _runs(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Whole runs of equal keys from batches sorted by them."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        same = np.ones(len(batch), bool)
        for k in keys:
            v = batch[k].to_numpy()
            same[1:] &= v[1:] == v[:-1]
            same[0] &= bool(held) and held[-1][k].iloc[-1] == v[0]
        starts = np.flatnonzero(~same)
        if not len(starts):
            held.append(batch)
            continue
        if held or starts[0] > 0:
            yield pd.concat([*held, batch.iloc[: starts[0]]])
        for a, b in zip(starts[:-1], starts[1:]):
            yield batch.iloc[a:b]
        held = [batch.iloc[starts[-1] :]]
    if held:
        yield pd.concat(held)


def _linked(threshold: float, bits: int, tables: int):
    keys = ["width", "table", "code", "low", "high"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows: list[pd.DataFrame] = []
        for block in _runs(batches, keys):
            if len(block) < 2:
                continue
            unit = _unit(block["embedding"])
            near = unit @ unit.T >= threshold
            np.fill_diagonal(near, False)
            if block["low"].iloc[0] != block["high"].iloc[0]:  # two parts of a bucket: pairs across them
                part = block["part"].to_numpy()
                near &= part[:, None] != part[None, :]
            if not near.any():
                continue
            codes = codes_of(signs_of(unit, bits, tables))
            ids, copies = block["class"].to_numpy(), block["copies"].to_numpy()
            i, j = np.nonzero(near)
            t = int(block["table"].iloc[0])
            first = ~(codes[i, :t] == codes[j, :t]).any(axis=1)  # counted in the first table they share
            links = np.bincount(i[first], copies[j[first]], len(ids)).astype(np.int64)
            root = ids.copy()
            while True:  # smallest class reachable inside the block
                low = root.copy()
                np.minimum.at(low, i, root[j])
                if (low == root).all():
                    break
                root = low
            some = near.any(axis=1)
            rows.append(pd.DataFrame({"class": ids[some], "links": links[some], "root": root[some]}))
            if len(rows) >= 500:
                yield pd.concat(rows)
                rows = []
        if rows:
            yield pd.concat(rows)

    return run


def link_vectors(vectors: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """Per row of `vectors(vec_id, embedding)`: vec_id, n_links, component_id, kept.

    Equal vectors form one class that is hashed and compared once; its rows count as linked with
    each other. Vectors that are null, empty, zero or hold null or non-finite components, and rows
    without vec_id, link with nothing (component_id is then vec_id). Vectors of different lengths
    never link. Rows that share a vec_id are told apart. Other columns are ignored.

    Bits and tables follow the number of distinct vectors. A bucket of more than `block` vectors is
    compared as pairs of parts, so no task holds an unbounded bucket; only counts and one edge per
    vector and block leave a task, never all pairs. Vectors first go to their buckets as packed signs;
    only those that differ from another in no more signs than `most_differing` follow whole, and their
    cosines decide. Components are found by `connected`.
    """
    number = lambda x: F.isnull(x) | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    sound = F.col("vec_id").isNotNull() & F.coalesce(~F.exists("embedding", number) & F.exists("embedding", lambda x: x != 0), F.lit(False))
    hashes = [F.when(sound, F.xxhash64(F.lit(k), "embedding")).alias(f"hash{k}") for k in (1, 2)]
    by = ["hash1", "hash2"]
    classes = rows.filter(sound).select("vec_id", "embedding", *hashes).groupBy(*by).agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("copies"), F.first("embedding").alias("embedding"))
    classes = stored(classes.withColumn("class", F.monotonically_increasing_id()))
    bits, tables = plan_tables(classes.count(), threshold, recall)
    dealt_rows = "width int, table int, code long, class long, sketch binary"
    hashed = stored(classes.select("class", "embedding").mapInPandas(_hashed(bits, tables), dealt_rows))
    bucket = ["width", "table", "code"]
    keys = [*bucket, "low", "high"]
    large = hashed.groupBy(*bucket).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > block).select(*bucket, F.ceil(F.col("n") / block).cast("int").alias("parts"))
    dealt = hashed.join(large, bucket, "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("part", F.pmod(F.hash("class"), "parts"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(*bucket, "class", "sketch", "part", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"))
    sorted_rows = lambda df: df.repartition(*keys).sortWithinPartitions(*keys)
    near = stored(sorted_rows(dealt).mapInPandas(_maybe_near(most_differing(min(SKETCH, bits * tables), threshold)), f"{dealt_rows}, part int, low int, high int"))
    compared = near.drop("sketch").join(classes.select("class", "copies", "embedding"), "class")
    linked = stored(sorted_rows(compared).mapInPandas(_linked(threshold, bits, tables), "class long, links long, root long"))
    discard(hashed, near)
    links = linked.groupBy("class").agg(F.sum("links").alias("links"))
    found = connected(linked.select(F.col("class").alias("a"), F.col("root").alias("b")))
    labelled = classes.select("class", "first", "copies", *by).join(links, "class", "left").join(found.withColumnRenamed("node", "class"), "class", "left").withColumn("component", F.coalesce("component", "class"))
    smallest = labelled.groupBy("component").agg(F.min("first").alias("component_id"))
    labelled = labelled.join(smallest, "component").select(*by, "component_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    return (
        rows.select("vec_id", *hashes)
        .join(labelled, by, "left")
        .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
        .withColumn("kept", F.col("vec_id") == F.col("component_id"))
    )
