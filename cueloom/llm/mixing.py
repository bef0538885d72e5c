"""Mixing sources to target weights: exact block quotas per output shard by a splitting tree.

Every source is cut into blocks of documents by a keyed hash. A source's target in words is met by
whole passes over it and a drawn part of one more pass: its blocks in permuted order, the last one
by documents. A splitting tree deals each source's drawn blocks to the output shards: at every node
the blocks of all sources are divided between the two halves of its shards by a
multivariate-hypergeometric draw, so that the shards' block counts are exact and their composition
is that of a random permutation. Shards then take disjoint runs of a source's permuted blocks and
are shuffled locally.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cueloom.llm.common import WORD


@dataclass(frozen=True)
class Mix:
    weights: tuple[float, ...] = (1, 2, 3)  # repeating over the sources in code-point order, null last
    most_repeats: int = 3
    blocks: int = 1024  # of each source
    shards: int = 16
    spread: int = 64  # parts of a shard, so that more tasks than shards can write
    seed: int = 17
    split_documents: bool = True  # whether the last document drawn may give a part of its words


def shared_out(sizes: np.ndarray, weights: np.ndarray, most: float) -> np.ndarray:
    """Targets that share sum(sizes) by weight, none above most * its size; the excess is reshared."""
    limit, total = most * sizes.astype(float), float(sizes.sum())
    target, free = np.zeros(len(sizes)), np.ones(len(sizes), bool)
    while free.any():
        share = (total - target[~free].sum()) * weights / weights[free].sum()
        over = free & (share > limit)
        if not over.any():
            target[free] = share[free]
            break
        target[over] = limit[over]
        free &= ~over
    return target


def splitting_tree(blocks: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """Quotas (source x shard) of blocks: shard sums differ by one at most, source sums are exact."""
    if shards == 1:
        return blocks[:, None]
    left = shards // 2
    total = int(blocks.sum())
    even = [total * (k + 1) // shards - total * k // shards for k in range(shards)]
    need, rest, drawn = sum(even[:left]), total, np.zeros_like(blocks)
    for k, n in enumerate(blocks):  # the multivariate draw, one conditional draw for each source
        drawn[k] = rng.hypergeometric(int(n), int(rest - n), int(need)) if need and n else 0
        rest, need = rest - n, need - drawn[k]
    return np.hstack([splitting_tree(drawn, left, rng), splitting_tree(blocks - drawn, shards - left, rng)])


def _plan(mix: Mix):
    """One row per source: target, whole passes and words of the last pass."""

    def run(sources: pd.DataFrame) -> pd.DataFrame:
        s = sources.sort_values(["missing", "source_key"]).reset_index(drop=True)
        weights = np.array([mix.weights[k % len(mix.weights)] for k in range(len(s))], float)
        target = shared_out(s["source_size"].to_numpy(), weights, mix.most_repeats)
        size = s["source_size"].to_numpy()
        words = np.minimum(np.floor(target + 0.5).astype(np.int64), mix.most_repeats * size)
        s["target"], s["passes"] = target, np.where(size > 0, words // np.maximum(size, 1), 0)
        s["last_words"] = words - s["passes"] * size
        return s[["missing", "source_key", "source_size", "target", "passes", "last_words"]]

    return run


def _deal(mix: Mix):
    """Quotas of every source's blocks by shard, as ends of its runs of permuted blocks."""

    def run(sources: pd.DataFrame) -> pd.DataFrame:
        s = sources.sort_values(["missing", "source_key"]).reset_index(drop=True)
        quotas = splitting_tree(s["drawn_blocks"].to_numpy(np.int64), mix.shards, np.random.default_rng(mix.seed))
        s["run_ends"] = list(np.cumsum(quotas, axis=1))
        return s[["missing", "source_key", "run_ends"]]

    return run


def mix_sources(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """Per row of `docs(doc_id, text, source)`: doc_id, size, source_size, target, taken, and
    `copies ARRAY<STRUCT<shard, words, shuffle>>`, the row's places in the mix.

    size counts words, 0 for a null text. Rows with repeated ids are drawn separately but alike.
    Copies of a block are drawn into places of their own, so that those of a document spread over the
    shards. Sources of size 0 have target 0. Other columns are ignored; an empty table gives no rows.
    Reruns agree: every choice is a hash of doc_id or a seeded draw.

    Texts are read once and only ids and sizes are shuffled, by (source, block), so a source with a
    third of all rows is spread over `mix.blocks` keys. Tables of one row per source are planned in
    one small task; nothing goes through the driver.
    """
    key = [F.col("source").isNull().alias("missing"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source_key")]
    by = ["missing", "source_key"]
    order = F.xxhash64(F.lit(mix.seed), F.col("doc_id"))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64("doc_id", "source", "text").alias("row"),
        *key,
        F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        order.alias("shuffle"),
        F.pmod(F.shiftright(order, 20), F.lit(mix.blocks)).cast("int").alias("block"),
    )
    in_block = Window.partitionBy(*by, "block").orderBy("shuffle", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("before", F.coalesce(F.sum("size").over(in_block), F.lit(0)))
    blocks = rows.groupBy(*by, "block").agg(F.sum("size").alias("block_size"))
    totals = blocks.groupBy(*by).agg(F.sum("block_size").alias("source_size"))
    one = lambda df, run, schema: df.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(run, schema)
    plan = one(totals, _plan(mix), "missing boolean, source_key string, source_size long, target double, passes long, last_words long")
    upto = Window.partitionBy(*by).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    drawn = (
        blocks.join(plan, by)
        .withColumn("left", F.col("last_words") - F.coalesce(F.sum("block_size").over(upto), F.lit(0)))
        .withColumn("left", F.greatest(F.lit(0), F.least("left", "block_size")))
    )
    count = drawn.groupBy(*by).agg(F.sum(F.col("passes") + (F.col("left") > 0).cast("long")).alias("drawn_blocks"))
    runs = one(count, _deal(mix), "missing boolean, source_key string, run_ends array<long>")
    # The permuted blocks of a source: every copy of every block in one drawn order, at most blocks * (most_repeats + 1) rows.
    permuted = Window.partitionBy(*by).orderBy(F.xxhash64(F.lit(mix.seed + 1), "block", "k"), "block", "k")
    copies = (
        drawn.withColumn("n", F.col("passes") + (F.col("left") > 0).cast("long"))
        .filter("n > 0")
        .select(*by, "block", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("k"))
        .withColumn("at", F.row_number().over(permuted) - 1)
        .join(runs, by)
        .select(*by, "block", F.struct("k", F.size(F.filter("run_ends", lambda end: end <= F.col("at"))).alias("shard"), "at").alias("c"))
        .groupBy(*by, "block")
        .agg(F.sort_array(F.collect_list("c")).alias("dealt"))
    )
    drawn = drawn.join(copies, [*by, "block"], "left").select(*by, "block", "source_size", "target", "passes", "left", "dealt")
    room = F.col("left") - F.col("before")
    if mix.split_documents:
        part = F.greatest(F.lit(0), F.least(room, F.col("size")))
    else:
        part = F.when(2 * room >= F.col("size"), F.col("size")).otherwise(0)
    words = lambda c: F.when(c["k"] <= F.col("passes"), F.col("size")).otherwise(F.col("part"))
    place = lambda c: F.struct(c["shard"].alias("shard"), words(c).alias("words"), F.xxhash64("shuffle", c["at"]).alias("shuffle"))
    held = F.filter(F.transform("dealt", lambda c: F.struct(place(c).alias("p"), (c["k"] <= F.col("passes")).alias("whole"))), lambda x: x["whole"] | (x["p"]["words"] > 0))
    nowhere = F.array().cast("array<struct<shard:int,words:bigint,shuffle:bigint>>")
    return (
        rows.join(drawn, [*by, "block"])
        .withColumn("part", part.cast("long"))
        .select("doc_id", "size", "source_size", "target", (F.col("passes") * F.col("size") + F.col("part")).alias("taken"), F.coalesce(F.transform(held, lambda x: x["p"]), nowhere).alias("copies"), "row")
    )


def mixed_rows(docs: DataFrame, mix: Mix = Mix(split_documents=False)) -> DataFrame:
    """`docs` with every row as often as the mix takes it, dealt to `mix.shards` partitions by shard and
    shuffled inside each; rows that the mix leaves out are gone. Whole documents only.

    Rows are matched with their places by a hash of doc_id, source and text, so rows equal in these are
    taken alike; null ids, sources and texts are values like others, and a text without words, which
    weighs nothing, is taken as often as the whole passes over its source. All columns stay, whatever
    their names; an empty table gives no rows.
    """
    plan = mix_sources(docs, mix).filter(F.size("copies") > 0).groupBy("row").agg(F.first("copies").alias("copies"))
    whole = docs.select(F.xxhash64("doc_id", "source", "text").alias("row"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    placed = whole.join(plan, "row").select("doc", F.explode("copies").alias("copy"))
    spread = F.pmod(F.hash("copy.shuffle"), F.lit(mix.spread))
    return placed.repartition(F.col("copy.shard"), spread).sortWithinPartitions("copy.shard", "copy.shuffle").select("doc.*")
