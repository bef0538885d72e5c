"""N-gram Jaccard join by PartEnum signatures.

Two sets with Jaccard similarity of 3/4 or more differ in at most (|A|+|B|)/7 elements. Within a band
of sizes the feature domain (64-bit shingle hashes) is cut into more partitions than sets of the
band may differ in; a set's signatures are hashes of its content in single partitions. Of the
non-empty partitions, in a fixed order, a set enumerates one more than the most it may differ from
any partner in: the first partition that both sets have, untouched by differences, is among those
of both, so every similar pair shares a signature. Shingles are ranked by the number of documents they
are found in, and a document first enumerates partitions of its shingles of the lowest rank. If those
partitions are too few, it enumerates every one of these shingles by itself as well, and goes on to
partitions of its shingles of the lowest two ranks, and so on. Two sets that have a shingle of the
lower ranks in common meet there; two that have none share at most the rest of either set, which makes
them candidates only if the smaller rest can hold the intersection of a similar pair; a document whose
rest is too small for any partner stops. A set near the upper end of its band joins the next band too.

Documents with equal sets are one class and are compared once.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cueloom.llm.common import _ASCII_LOWER, discard, mix64, slices, stored
from cueloom.llm.components import connected

WORDS = 5
#: Links have NUM/DEN of the union in common or more.
NUM, DEN = 75, 100
#: Sizes of a band differ by this factor at most.
BAND = (4 / 3) ** 3
#: Partitions for each element by which two sets of the band may differ.
SPREAD = 1.25
#: Slots of the count sketch by which shingles are ranked, and rows it comes in.
SLOTS, CHUNKS = 1 << 22, 64
#: Documents from which a shingle has rank 1, and the factor from one rank to the next, up to TOP.
COMMON_FROM, STEP, TOP = 32, 4, 12
#: Classes that share a signature are all compared up to this many; beyond it with drawn centres first.
SMALL = 8
CENTRES, TURNS = 4, 2
#: Signatures that a task hands on at a time, and names of classes that it remembers.
FRAME, SEEN = 1 << 17, 1 << 20
#: Bits of a packed row that hold the signature, and those of a rounded number above them.
SIG_BITS, CODE_BITS = 43, 10
#: Keys of the broadcast semi-join that keeps most texts out of the exact join: at most so many rows.
KEYS = 1 << 20

_LOWER = np.frombuffer(_ASCII_LOWER, np.uint8)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_ODD = 0x9E3779B97F4A7C15
_INVERSE = pow(_ODD, -1, 1 << 64)
#: Bytes of a text whose words are hashed together.
PIECE = 1 << 16
_UP, _DOWN = (np.multiply.accumulate(np.array([1] + [x] * PIECE, np.uint64)) for x in (_ODD, _INVERSE))


def _hashed(raw: np.ndarray) -> np.ndarray:
    """Hashes of the words of at most PIECE bytes."""
    gap = _SPACE[raw]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], gap, [True])).view(np.int8)))
    start, end = edge[::2], edge[1::2]
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((_LOWER[raw].astype(np.uint64) + np.uint64(1)) * _UP[: len(raw)], out=total[1:])
    return mix64((total[end] - total[start]) * _DOWN[start] + (end - start).astype(np.uint64))


def word_hashes(text: str | bytes | None) -> np.ndarray:
    """64-bit hashes of a text's lower-cased words, in order; memory is a few times the text's bytes."""
    data = (text or "").encode("utf-8", "surrogatepass") if not isinstance(text, bytes) else text
    raw = np.frombuffer(data, np.uint8)
    if len(raw) < PIECE:
        return _hashed(raw)
    found, at = [], 0
    while at < len(raw):
        upto = at + PIECE
        if upto <= len(raw):
            gaps = np.flatnonzero(_SPACE[raw[at:upto]])
            if not len(gaps):  # inside a word longer than a piece, which is hashed by itself
                upto = at + PIECE
                while upto < len(raw) and not len(gaps := np.flatnonzero(_SPACE[raw[upto : upto + PIECE]])):
                    upto += PIECE
                upto = min(len(raw), upto + (int(gaps[0]) if len(gaps) else 0))
                digest = hashlib.blake2b(data[at:upto].translate(_ASCII_LOWER), digest_size=8).digest()
                found.append(np.frombuffer(digest, np.uint64))
                at = upto
                continue
            upto = at + int(gaps[-1]) + 1
        found.append(_hashed(raw[at:upto]))
        at = upto
    return np.concatenate(found)


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted hashes of the distinct 5-word shingles; of the whole sequence where words are fewer."""
    w = word_hashes(text)
    if not len(w):
        return w
    n = max(1, len(w) - WORDS + 1)
    h = np.full(n, min(len(w), WORDS), np.uint64)
    for k in range(min(WORDS, len(w))):
        h = mix64(h * np.uint64(_ODD) + w[k : k + n])
    return np.unique(h)


def set_class(s: np.ndarray) -> int:
    """A 64-bit name of a set."""
    with np.errstate(over="ignore"):
        total = mix64(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) + np.uint64(len(s))
    return int(mix64(np.array([total]))[0].astype(np.int64))


def band(size: int) -> int:
    """Number of the band that holds a size."""
    k = max(0, int(np.log(max(size, 1)) / np.log(BAND)) - 1)
    while BAND ** (k + 1) <= size:
        k += 1
    return k


def fits(size, other, rest):
    """Whether sets of these sizes (numbers or columns) can be similar if `rest` elements may be common."""
    return NUM * (size + other) <= (NUM + DEN) * rest


def enumerate_signatures(s: np.ndarray, ranks: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of a sorted set and, for each, how many shingles are of its rank or higher; ranks
    has the rank of each sketch slot.
    """
    size, found, rests = len(s), [], []
    own = band(size)
    low_edge = BAND ** (own + 1)
    rank = np.zeros(size, np.uint8) if ranks is None else ranks[(s & np.uint64(SLOTS - 1)).astype(np.int64)]
    held = np.bincount(rank, minlength=1)
    for b in (own, own + 1):
        if b > own and size < 0.75 * low_edge:
            break
        top = min(size * DEN // NUM, int(np.ceil(BAND ** (b + 1))) - 1)
        most = (size + top) * (DEN - NUM) // (DEN + NUM)  # elements that a pair may differ in
        if most == 0:
            continue  # only equal sets
        parts = np.uint64(max(2, int(SPREAD * 2 * (DEN - NUM) / (DEN + NUM) * BAND ** (b + 1))))
        rest = size
        for r in np.flatnonzero(held):
            if not fits(size, -(-size * NUM // DEN), rest):
                break
            of = s[rank <= r]
            part = ((of >> np.uint64(32)) * parts) >> np.uint64(32)  # ascending, as the set is
            first = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
            groups = [np.add.reduceat(mix64(of), first)[: most + 1]]
            if len(first) <= most:
                groups.append(mix64(s[rank == r]))
            for alone, content in enumerate(groups):
                found.append(mix64(content ^ np.uint64((((b * (TOP + 1) + int(r)) * 2 + alone + 1) * _ODD) & (2**64 - 1))))
                rests.append(np.full(len(content), rest, np.int32))
            if len(first) > most:
                break
            rest -= int(held[r])
    return (np.concatenate(found), np.concatenate(rests)) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int32))


def _code(n: np.ndarray) -> np.ndarray:
    """Numbers rounded down to six leading bits and a shift, in CODE_BITS bits; those under 64 as they are."""
    n = n.astype(np.int64)
    shift = np.maximum(np.frexp(n.astype(np.float64))[1].astype(np.int64) - 6, 0)
    return shift * 32 + (n >> shift)


def _number(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The smallest and the largest number with a code."""
    shift = np.maximum(code // 32 - 1, 0)
    low = (code - 32 * shift) << shift
    return low, low + (1 << shift) - 1


def pack_signatures(x: np.ndarray, size: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """A signature, a set's size and its shingles of lower ranks (size - rest) in one number, both rounded down.

    Unpacked, a size is never larger and a rest never smaller than before. Signatures that differ in their dropped
    bits only, or numbers that round to the same, add candidates, which are compared in full later; none is lost.
    """
    low = (x & np.uint64((1 << SIG_BITS) - 1)).astype(np.int64)
    return low | (_code(size) << SIG_BITS) | (_code(size - rest) << (SIG_BITS + CODE_BITS))


def unpack_signatures(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(sig, class, size, rest) of packed rows (key, class)."""
    for batch in batches:
        key = batch["key"].to_numpy()
        (size, most), (own, _) = (_number((key >> at) & ((1 << CODE_BITS) - 1)) for at in (SIG_BITS, SIG_BITS + CODE_BITS))
        yield pd.DataFrame({"sig": key & ((1 << SIG_BITS) - 1), "class": batch["class"].to_numpy(), "size": size.astype(np.int32), "rest": (most - own).astype(np.int32)})


def jaccard(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """Sizes of intersection and union of two sorted sets."""
    both = np.concatenate((a, b))
    both.sort(kind="stable")
    inter = int((both[1:] == both[:-1]).sum())
    return inter, len(both) - inter


DESCRIBED = pa.schema({"doc_id": pa.int64(), "n_shingles": pa.int64(), "class": pa.int64(), "sketch": pa.binary(), "chunk": pa.int32(), "counts": pa.binary()})


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document, and this task's counts by sketch slot."""
    counts = np.zeros(SLOTS, np.uint32)
    for part in slices(batches):
        rows = []
        for doc, text in zip(part["doc_id"], part["text"]):
            s = shingle_set(text)
            if len(s):
                counts[(s & np.uint64(SLOTS - 1)).astype(np.int64)] += 1
            rows.append({"doc_id": doc, "n_shingles": len(s), "class": set_class(s) if len(s) else None, "sketch": parity_sketch(s) if len(s) else None})
        yield pa.RecordBatch.from_pylist(rows, DESCRIBED)
    for k, part in enumerate(np.split(np.minimum(counts, 255).astype(np.uint8), CHUNKS)):
        if part.any():
            yield pa.RecordBatch.from_pylist([{"n_shingles": 0, "chunk": k, "counts": zlib.compress(part.tobytes(), 1)}], DESCRIBED)


def _summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sums of the chunks that came to this task."""
    totals: dict[int, np.ndarray] = {}
    for batch in batches:
        for chunk, x in zip(batch["chunk"], batch["counts"]):
            totals[chunk] = totals.get(chunk, 0) + np.frombuffer(zlib.decompress(x), np.uint8).astype(np.uint64)
    for chunk, total in totals.items():
        yield pd.DataFrame({"chunk": [chunk], "total": [int(total.sum())], "counts": [zlib.compress(total.tobytes(), 1)]})


def _slot_ranks(sketches: DataFrame) -> bytes | None:
    """Ranks of the slots of the sketch, summed over all tasks: SLOTS bytes, compressed."""
    merged = sketches.select("chunk", "counts").repartition("chunk").mapInPandas(_summed, "chunk int, total long, counts binary").collect()
    least = max(COMMON_FROM, 8 * sum(row["total"] for row in merged) / SLOTS)
    edges, ranks = least * float(STEP) ** np.arange(TOP), np.zeros((CHUNKS, SLOTS // CHUNKS), np.uint8)
    for row in merged:  # CHUNKS rows of a bounded size
        ranks[row["chunk"]] = np.searchsorted(edges, np.frombuffer(zlib.decompress(row["counts"]), np.uint64), side="right")
    return zlib.compress(ranks.tobytes(), 1) if ranks.any() else None


def _signed(packed: bytes | None):
    """Signatures of the classes that a task meets, each class once as long as SEEN names are held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = None if packed is None else np.frombuffer(zlib.decompress(packed), np.uint8)
        seen: set[int] = set()
        held: list[tuple[np.ndarray, ...]] = []

        def gathered() -> pa.RecordBatch:
            columns = [np.concatenate(c) for c in zip(*held)]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "class"])

        for part in slices(batches):
            for text in part["text"]:
                s = shingle_set(text)
                if not len(s) or (name := set_class(s)) in seen:
                    continue
                seen.add(name)
                x, rest = enumerate_signatures(s, ranks)
                for at in range(0, len(x), FRAME):
                    some = x[at : at + FRAME]
                    held.append((pack_signatures(some, np.full(len(some), len(s)), rest[at : at + FRAME]), np.full(len(some), name, np.int64)))
                    if sum(len(h[0]) for h in held) >= FRAME:
                        yield gathered()
            if len(seen) > SEEN:
                seen.clear()
        if held:
            yield gathered()

    return run


def _met(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What classes with the same signature have to do with each other, from rows sorted by (sig, class).

    Of at most SMALL classes all pairs (a, b) that may be similar leave; of more, each class as (hub, class, size,
    rest), where the hub is the smallest class. A row is held only until its run is known to be a large one, or ends.
    """
    held, hub = None, None  # the rows of the last run so far; of a large one only the last row, and its hub
    for batch in batches:
        rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
        sig, names = rows["sig"].to_numpy(), rows["class"].to_numpy()
        new = np.concatenate(([True], (sig[1:] != sig[:-1]) | (names[1:] != names[:-1])))
        rows, sig, names = rows[new], sig[new], names[new]
        size, rest = rows["size"].to_numpy(), rows["rest"].to_numpy()
        starts = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1])))
        counts = np.diff(np.append(starts, len(sig)))
        run = np.repeat(np.arange(len(starts)), counts)
        open_run = len(starts) - 1  # may go on in the next batch
        large = counts > SMALL
        hubs = names[starts]
        told = np.zeros(len(sig), bool)  # members of large runs that left before
        if hub is not None:
            large[0], hubs[0], told[0] = True, hub, True
        whole = large[run] & ~told
        yield pd.DataFrame({"a": hubs[run][whole], "b": names[whole], "size": size[whole], "rest": rest[whole]})
        yield _pairs(names, size, rest, run, ~large[run] & (run < open_run))
        if large[open_run]:
            held, hub = rows.iloc[-1:], int(hubs[open_run])
        else:
            held, hub = rows.iloc[starts[open_run] :], None
    if held is not None and hub is None:
        one = np.zeros(len(held), np.int64)
        yield _pairs(*(held[c].to_numpy() for c in ("class", "size", "rest")), one, one == 0)


def _pairs(names: np.ndarray, size: np.ndarray, rest: np.ndarray, run: np.ndarray, wanted: np.ndarray) -> pd.DataFrame:
    """Pairs of the wanted rows of a run that may be similar."""
    at, found = np.flatnonzero(wanted), []
    for step in range(1, SMALL):
        at = at[at < len(run) - step]
        at = at[run[at] == run[at + step]]
        x, y = size[at].astype(np.int64), size[at + step].astype(np.int64)
        fit = fits(x, y, np.minimum(rest[at], rest[at + step]))
        found.append(np.stack((names[at[fit]], names[at[fit] + step]), 1))
    pairs = np.concatenate(found) if found else np.zeros((0, 2), np.int64)
    none = pd.array([None] * len(pairs), dtype="Int32")
    return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1], "size": none, "rest": none})


def parity_sketch(s: np.ndarray) -> bytes:
    """Whether an odd number of elements falls in each of at least 2 * len(s) slots, a power of two."""
    bits = max(256, 1 << int(2 * len(s) - 1).bit_length())
    return np.packbits(np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1, bitorder="little").tobytes()


def least_difference(x: bytes, y: bytes) -> int:
    """At most as many elements as two sets differ in: every one of them flips one slot."""
    a, b = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    n = min(len(a), len(b))
    a, b = (np.bitwise_xor.reduce(v.reshape(-1, n), axis=0) for v in (a, b))
    return int(np.bitwise_count(a ^ b).sum())


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs that may be similar enough by their sketches."""
    for p in slices(batches):
        most = [(x + y) * (DEN - NUM) // (DEN + NUM) for x, y in zip(p["size_a"], p["size_b"])]
        near = [k for k, (m, x, y) in enumerate(zip(most, p["sketch_a"], p["sketch_b"])) if least_difference(x, y) <= m]
        yield pa.RecordBatch.from_arrays([pa.array([p[c][k] for k in near], pa.int64()) for c in ("a", "b")], names=["a", "b"])


COMPARED = pa.schema({"a": pa.int64(), "b": pa.int64(), "similarity": pa.float64(), "linked": pa.bool_()})


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for p in slices(batches):
        rows = []
        for a, b, x, y in zip(p["a"], p["b"], p["set_a"], p["set_b"]):
            inter, union = jaccard(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64))
            rows.append({"a": a, "b": b, "similarity": inter / union, "linked": DEN * inter >= NUM * union})
        yield pa.RecordBatch.from_pylist(rows, COMPARED)


def _slot(c: Column) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(KEYS)).cast("int").alias("slot")


def _prefiltered(df: DataFrame, column: str, wanted: DataFrame) -> DataFrame:
    """Rows of df that may have a key of `wanted`, by a broadcast of at most KEYS slots: most others stay unshuffled."""
    slots = wanted.select(_slot(wanted[wanted.columns[0]])).distinct()
    return df.join(F.broadcast(slots), _slot(df[column]) == slots["slot"], "left_semi")


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(class, set) of the wanted (class, doc_id): only those texts are shuffled and read into sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in slices(batches):
            sets = list(map(shingle_set, p["text"]))
            own = [k for k, (s, c) in enumerate(zip(sets, p["class"])) if len(s) and set_class(s) == c]  # a repeated doc_id may bring other texts
            yield pa.RecordBatch.from_arrays([pa.array([p["class"][k] for k in own], pa.int64()), pa.array([sets[k].tobytes() for k in own], pa.binary())], names=["class", "set"])

    near = _prefiltered(docs, "doc_id", wanted.select("doc_id")).join(wanted.select("doc_id", "class"), "doc_id")
    once = near.groupBy("doc_id", "class", F.xxhash64("text")).agg(F.first("text").alias("text"))
    return stored(once.select("class", "text").mapInArrow(run, "class long, set binary"))


def _near_pairs(pairs: DataFrame, about: DataFrame) -> DataFrame:
    """Those distinct pairs a < b whose sizes and sketches allow a link."""
    asked = pairs = stored(pairs)
    for side in ("a", "b"):
        some = _prefiltered(about, "class", asked.select(side))
        pairs = pairs.join(some.select(F.col("class").alias(side), F.col("size").alias(f"size_{side}"), F.col("sketch").alias(f"sketch_{side}")), side)
    fit = (DEN * F.least("size_a", "size_b") >= NUM * F.greatest("size_a", "size_b")) & (F.col("a") < F.col("b"))
    near = stored(pairs.filter(fit).select("a", "b", "size_a", "size_b", "sketch_a", "sketch_b").mapInArrow(_near, "a long, b long"))
    discard(asked)
    return near


def _verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, similarity, linked) of pairs, from their whole sets."""
    for side in ("a", "b"):
        some = _prefiltered(sets, "class", pairs.select(side))
        pairs = pairs.join(some.select(F.col("class").alias(side), F.col("set").alias(f"set_{side}")), side)
    return stored(pairs.select("a", "b", "set_a", "set_b").mapInArrow(_compared, "a long, b long, similarity double, linked boolean"))


def _pair(x: Column, y: Column) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _draws(turn: int) -> list[list[Column]]:
    """Orders by which a group's centres are drawn: one of a set with few shingles of its own, others at random."""
    draws = [[F.xxhash64(F.lit(CENTRES * turn + k), "class").alias("draw")] for k in range(CENTRES)]
    draws[0].insert(0, (F.col("size") - F.col("rest")).alias("own"))
    return draws


def link_documents(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, links): rows of doc_id, n_shingles and class for `docs(doc_id, text)`, and the verified
    links (a, b) between classes, enough of them to connect every two classes that are connected.

    The texts are read twice and once more for the candidates only; shuffled are signatures, about
    0.4 for each shingle, and the sets of candidates. Tables between the steps are removed. Signatures of more than SMALL
    classes are settled by drawn centres first: classes linked with one are connected and need no
    further comparison with each other; whatever is still apart afterwards is compared in full, by sketches first.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    described = stored(texts.mapInArrow(_described, "doc_id long, n_shingles long, class long, sketch binary, chunk int, counts binary"))
    rows = described.filter("chunk IS NULL").select("doc_id", "n_shingles", "class")
    ranks = _slot_ranks(described.filter("chunk IS NOT NULL"))
    signed = texts.filter("doc_id IS NOT NULL").select("text").mapInArrow(_signed(ranks), "key long, class long")
    sig = F.col("key").bitwiseAND(F.lit((1 << SIG_BITS) - 1))  # of a class's rows with the same one, that of the largest rest comes first and stays
    ordered = signed.repartition(sig).sortWithinPartitions(sig, "class", "key")
    met = stored(ordered.mapInPandas(lambda batches: _met(unpack_signatures(batches)), "a long, b long, size int, rest int"))
    some = met.select(F.explode(F.array("a", "b")).alias("class")).distinct()
    named = described.filter("chunk IS NULL AND doc_id IS NOT NULL").join(some, "class", "left_semi")
    about = stored(named.groupBy("class").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("size"), F.first("sketch").alias("sketch")))

    near = _near_pairs(met.filter("size IS NULL").select("a", "b").distinct(), about)
    # Large signatures with the same hub have nearly the same members: one group for all of them.
    # A member's size is known exactly from here on, and its shingles of lower ranks as they were packed.
    own = F.expr("size + shiftleft(1, greatest(length(bin(size)) - 6, 0)) - 1 - rest")
    hubs = met.filter("size IS NOT NULL").groupBy(F.col("a").alias("hub"), F.col("b").alias("class")).agg(F.min(own).alias("own"))
    large = stored(hubs.join(about.select("class", "size"), "class").select("hub", "class", F.col("size").cast("int").alias("size"), (F.col("size") - F.col("own")).cast("int").alias("rest")))
    discard(met)
    wanted = near.select(F.col("a").alias("class")).unionByName(near.select(F.col("b").alias("class"))).unionByName(large.select("class")).distinct()
    chosen = stored(about.join(wanted, "class", "left_semi").select("class", "doc_id"))
    sets = _sets(texts, chosen)
    links = [_verify(near, sets)]
    discard(near, chosen)
    if not large.isEmpty():
        rest = large
        for turn in range(TURNS):
            drawn = rest.groupBy("hub").agg(*[F.min(F.struct(*of, "class", "size", "rest")).alias(f"c{k}") for k, of in enumerate(_draws(turn))])
            drawn = drawn.select("hub", F.explode(F.array_distinct(F.array(*[F.struct(*[F.col(f"c{k}.{x}").alias(f"centre_{x}") for x in ("class", "size", "rest")]) for k in range(CENTRES)]))).alias("c"))
            tries = rest.join(drawn.select("hub", "c.*"), "hub").withColumnRenamed("centre_class", "centre")
            tries = tries.filter((F.col("class") != F.col("centre")) & fits(F.col("size"), F.col("centre_size"), F.least("rest", "centre_rest")))
            seen = _verify(_near_pairs(tries.select(*_pair(F.col("class"), F.col("centre"))).distinct(), about), sets)
            links.append(seen)
            linked = seen.filter("linked").select("a", "b")
            both = linked.unionByName(linked.select(F.col("b").alias("a"), F.col("a").alias("b")))
            done = tries.join(both, (F.col("class") == F.col("a")) & (F.col("centre") == F.col("b")), "left_semi").select("hub", "class").distinct()
            rest = stored(rest.join(done, ["hub", "class"], "left_anti"))
        links.append(_verify(_still_apart(large, links, about), sets))
    discard(about, sets, large)
    found = links[0]
    for more in links[1:]:
        found = found.unionByName(more)
    return rows, found.filter("linked").select("a", "b")


def _still_apart(large: DataFrame, links: list[DataFrame], about: DataFrame) -> DataFrame:
    """Pairs of a group that lie in different components so far, haven't been compared and may be similar by their
    sizes and sketches: one of the two is outside the group's largest component.

    Such pairs can be as many as a group's size squared. Sketches go to the groups with their members, so a pair
    is judged where its members meet, and only one that passes is shuffled.
    """
    tried = links[0]
    for more in links[1:]:
        tried = tried.unionByName(more)
    parts = connected(tried.filter("linked").select("a", "b"))
    placed = stored(large.join(parts.withColumnRenamed("node", "class"), "class", "left").withColumn("component", F.coalesce("component", "class")))
    by_part = placed.groupBy("hub", "component").agg(F.count(F.lit(1)).alias("n"))
    main = by_part.groupBy("hub").agg(F.count(F.lit(1)).alias("parts"), F.max_by("component", F.struct("n", "component")).alias("main")).filter("parts > 1")
    open_ = stored(placed.join(main, "hub").select("hub", "class", "component", "rest", (F.col("component") != F.col("main")).alias("minor")))
    some = _prefiltered(about, "class", open_.select("class")).select("class", "size", "sketch")
    whole = open_.join(some, "class")
    x, y = (side.select("hub", *[F.col(c).alias(f"{c}_{end}") for c in ("class", "component", "rest", "minor", "size", "sketch")]) for side, end in ((whole.filter("minor"), "a"), (whole, "b")))
    once = ~F.col("minor_b") | (F.col("class_a") < F.col("class_b"))
    fit = fits(F.col("size_a"), F.col("size_b"), F.least("rest_a", "rest_b"))
    met = x.join(y, "hub").filter((F.col("component_a") != F.col("component_b")) & once & fit)
    near = met.select(F.col("class_a").alias("a"), F.col("class_b").alias("b"), "size_a", "size_b", "sketch_a", "sketch_b").mapInArrow(_near, "a long, b long")
    pairs = near.select(*_pair(F.col("a"), F.col("b"))).distinct().join(tried.select("a", "b"), ["a", "b"], "left_anti")
    pairs = stored(pairs)
    discard(placed, open_)
    return pairs


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per row of `docs(doc_id, text)`: doc_id, n_shingles, component_id.

    Texts without words (null, empty, white space) have no shingles and link with nothing; rows
    without doc_id link with nothing and have a null component_id. Rows that share a doc_id are
    rows of one document: what any links with, all link with. Other columns are ignored.
    """
    rows, links = link_documents(docs)
    held = rows.filter("doc_id IS NOT NULL AND class IS NOT NULL")
    first = stored(held.groupBy("class").agg(F.min("doc_id").alias("first")))  # a class goes by its smallest doc_id from here on
    for side in ("a", "b"):
        links = links.join(first.select(F.col("class").alias(side), F.col("first").alias(f"{side}_id")), side)
    own = held.join(first, "class").groupBy("doc_id").agg(F.min("first").alias("least"), F.max("first").alias("most")).filter("least <> most")
    several = held.join(own.select("doc_id"), "doc_id").join(first, "class").select(F.col("doc_id").alias("a"), F.col("first").alias("b"))
    found = connected(links.select(F.col("a_id").alias("a"), F.col("b_id").alias("b")).unionByName(several))
    named = first.join(found.withColumnRenamed("node", "first"), "first", "left").select("class", F.coalesce("component", "first").alias("component_id"))
    return rows.join(named, "class", "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
