"""Clustering around centroids with norm-of-sum bounds: exact rounds that evaluate few distances.

The history of all centroids is kept. A vector stores, for every centroid, their distance when it was last
evaluated and the round of that. Later the distance can't have changed by more than the norm of the
centroid's total displacement since that round, which is less than the sum of its moves from round to round.
While the loosened bounds keep the vector's own centroid ahead, nothing is evaluated; else its own distance is,
and then those whose bounds still reach it, in exact integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cueloom.llm.common import discard, stored

WIDTH, SCALE = 64, 1024
#: Scaled components beyond this count as this, so that squared distances are exact in 64 bits.
MOST = 1 << 27
#: Bounds are computed in double precision and widened by this share against rounding.
SLACK = 1e-9

STATE = "vec_id long, x array<int>, own int, at array<double>, since array<int>, cluster int, n long, sums array<long>"
_ROWS = pa.schema([("vec_id", pa.int64()), ("x", pa.list_(pa.int32())), ("own", pa.int32()), ("at", pa.list_(pa.float64())), ("since", pa.list_(pa.int32())), ("cluster", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))])
_FINAL = pa.schema([("vec_id", pa.int64()), ("cluster", pa.int32()), ("distance", pa.int64())])


@dataclass
class Bounds:
    """What is known of some vectors; `evaluated` counts the distances computed for them."""

    own: np.ndarray  # number of the nearest centroid, -1 before the first round
    at: np.ndarray  # distance to each centroid when last evaluated
    since: np.ndarray  # the round of that
    evaluated: int = field(default=0)


def squared(x: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    apart = x.astype(np.int64) - centroid
    return np.einsum("ij,ij->i", apart, apart)


def displacements(history: np.ndarray) -> np.ndarray:
    """(round x centroid) norm of the way from where a centroid was in that round to where it is now, rounded up."""
    way = (history[-1] - history).astype(np.float64)
    return np.sqrt((way * way).sum(axis=2)) * (1 + SLACK)


def assign(x: np.ndarray, known: Bounds, history: np.ndarray) -> None:
    """Bring `known` up to the last round of `history` (round x centroid x component): exact nearest centroids,
    the smaller number among equals."""
    now, k, moved = len(history) - 1, history.shape[1], displacements(history)
    each = np.arange(k)
    bound = known.at - moved[known.since, each]  # lower bounds; the own one is not used
    bound = bound * (1 - SLACK) - SLACK
    new = known.own < 0
    bound[new] = -1
    own = np.maximum(known.own, 0)
    rows = np.arange(len(x))
    up = (known.at[rows, own] + moved[known.since[rows, own], own]) * (1 + SLACK)
    others = bound.copy()
    others[rows, own] = np.inf
    open_ = np.flatnonzero(new | (others.min(axis=1) <= up))
    if not len(open_):
        return
    exact = np.full((len(open_), k), np.iinfo(np.int64).max)
    first = own[open_]
    for c in range(k):  # the own distance anew
        at = np.flatnonzero(first == c)
        exact[at, c] = squared(x[open_[at]], history[-1, c])
    reach = np.sqrt(exact[np.arange(len(open_)), first].astype(np.float64)) * (1 + SLACK)
    for c in range(k):  # then those that could be as near
        at = np.flatnonzero((bound[open_, c] <= reach) & (first != c))
        exact[at, c] = squared(x[open_[at]], history[-1, c])
    r, c = np.nonzero(exact != np.iinfo(np.int64).max)
    known.at[open_[r], c] = np.sqrt(exact[r, c].astype(np.float64))
    known.since[open_[r], c] = now
    known.own[open_] = exact.argmin(axis=1)
    known.evaluated += len(r)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]), pa.array(values.ravel(), kind))


def _known(batch: pa.RecordBatch, k: int) -> Bounds:
    n = batch.num_rows
    if "own" not in batch.schema.names:
        return Bounds(np.full(n, -1, np.int32), np.zeros((n, k)), np.zeros((n, k), np.int32))
    return Bounds(batch["own"].to_numpy().copy(), _matrix(batch["at"], k).copy(), _matrix(batch["since"], k).copy())


def _moves(history: np.ndarray):
    """A round: rows with their bounds, and for each task what its vectors' moves add to the clusters' counts and sums."""
    k = history.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = np.zeros(k, np.int64), np.zeros((k, WIDTH), np.int64)
        for batch in batches:
            x, known = _matrix(batch["x"], WIDTH), _known(batch, k)
            before = known.own.copy()
            assign(x, known, history)
            moved = np.flatnonzero(before != known.own)
            for c in range(k):
                come, gone = moved[known.own[moved] == c], moved[before[moved] == c]
                n[c] += len(come) - len(gone)
                sums[c] += x[come].sum(axis=0, dtype=np.int64) - x[gone].sum(axis=0, dtype=np.int64)
            empty = [pa.nulls(len(x), _ROWS.field(f).type) for f in ("cluster", "n", "sums")]
            yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["x"], pa.array(known.own), _lists(known.at, pa.float64()), _lists(known.since, pa.int32()), *empty], schema=_ROWS)
        some = np.flatnonzero((n != 0) | sums.any(axis=1))
        yield pa.RecordBatch.from_pylist([{"cluster": int(c), "n": int(n[c]), "sums": sums[c].tolist()} for c in some], _ROWS)

    return run


def _final(history: np.ndarray):
    k = history.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, known = _matrix(batch["x"], WIDTH), _known(batch, k)
            assign(x, known, history)
            distance = np.zeros(len(x), np.int64)
            for c in range(k):
                at = np.flatnonzero(known.own == c)
                distance[at] = squared(x[at], history[-1, c])
            yield pa.RecordBatch.from_arrays([batch["vec_id"], pa.array(known.own), pa.array(distance)], schema=_FINAL)

    return run


def _added(found: DataFrame) -> list:
    """(cluster, position, sum) of what a round's tasks add; position -1 has the counts: at most k * 65 rows."""
    parts = found.filter("cluster IS NOT NULL").select("cluster", F.posexplode(F.concat(F.array("n"), "sums")))
    return parts.groupBy("cluster", "pos").agg(F.sum("col").alias("v")).collect()


def scaled(vectors: DataFrame) -> DataFrame:
    """vec_id and x, floor(1024 * component), of the rows whose embedding has 64 finite components."""
    number = lambda v: F.coalesce(F.abs(v.cast("double")) < float("inf"), F.lit(False)) & ~F.isnan(v.cast("double"))
    whole = lambda v: F.floor(F.greatest(F.least(v.cast("double") * SCALE, F.lit(float(MOST))), F.lit(float(-MOST)))).cast("int")
    sound = (F.size("embedding") == WIDTH) & F.forall("embedding", number)
    return vectors.filter(F.coalesce(sound, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", whole).alias("x"))


def cluster_vectors(vectors: DataFrame, k: int = 8, rounds: int = 10, seed: int = 3) -> DataFrame:
    """Per kept row of `vectors(vec_id, embedding)`: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Kept are rows whose embedding has exactly 64 components, none null or non-finite; an all-zero one is a vector
    like others. Scaled components beyond 2^27 count as 2^27. The first centroids are the k rows with the smallest
    sha256 of `seed:vec_id`, those that share a vec_id in the order of their vectors; rows without vec_id start
    none. Fewer rows make fewer centroids, and if no row starts one, or the table is empty, there are no rows.
    Repeated rows count as often as they come; equal distances go to the smaller number; empty clusters stay where
    they are; an inertia beyond 64 bits is null. Other columns are ignored.

    A round reads and writes one table of vectors and bounds in the shared folder. Tasks add up the moves of their
    own vectors, so however large a cluster is, a task sends at most k sums; only those, and centroids, pass the
    driver. The rounds end early once no centroid moves, as later ones would change nothing.
    """
    rows = scaled(vectors)
    spark = vectors.sparkSession
    first = rows.filter("vec_id IS NOT NULL").select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).alias("hash"), "x")
    starts = [r.x for r in first.orderBy("hash", "x").limit(k).collect()]
    if not starts:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    history = np.array([starts], np.int64)
    k = len(starts)
    n, sums, state = [0] * k, [[0] * WIDTH for _ in range(k)], None
    for _ in range(rounds):
        found = stored((rows if state is None else state.filter("cluster IS NULL").select("vec_id", "x", "own", "at", "since")).mapInArrow(_moves(history), STATE))
        if state is not None:
            discard(state)
        state = found
        for r in _added(found):
            if r.pos:
                sums[r.cluster][r.pos - 1] += r.v
            else:
                n[r.cluster] += r.v
        new = [[s // n[c] for s in sums[c]] if n[c] else history[-1, c].tolist() for c in range(k)]
        history = np.concatenate((history, np.array([new], np.int64)))
        if (history[-1] == history[-2]).all():
            break
    last = state.filter("cluster IS NULL").select("vec_id", "x", "own", "at", "since") if state is not None else rows
    final = stored(last.mapInArrow(_final(history), "vec_id long, cluster int, distance long"))
    if state is not None:
        discard(state)
    inertia = {r.cluster: r.s for r in final.groupBy("cluster").agg(F.try_sum("distance").alias("s")).collect()}
    total = None if None in inertia.values() or sum(inertia.values()) >= 1 << 63 else sum(inertia.values())
    told = [(c, s, total, hashlib.sha256(",".join(map(str, history[-1, c].tolist())).encode()).hexdigest()) for c, s in inertia.items()]
    return final.join(F.broadcast(spark.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")), "cluster")
