"""Ordered cue tables: features, splitting, grouping, segments, windows, timings.

Cue tables have video_id, cue_id, pos, start_us, end_us, text. Everything is keyed by video_id;
windows share one exchange on it. Nothing collects more than one segment of a video.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from cueloom.functions import text as T

# Limits of grouping, windows and display.
MERGE_GAP_US, MAX_SEGMENT_US, MAX_SEGMENT_CHARS = 200_000, 30_000_000, 320
SAFETY_GAP_US, OVERLONG_US = 50_000, 6_000_000
CHUNK, OVERLAP = 40, 4


def _by_video(*order: str):
    return Window.partitionBy("video_id").orderBy(*order)


def cue_features(cues: DataFrame, chunk: str | None = None) -> DataFrame:
    """Gap to the previous cue (of the chunk), duration, and how the text ends and starts."""
    w = Window.partitionBy("video_id", *([chunk] if chunk else [])).orderBy("pos")
    text = T.trim_ws(F.col("text"))
    strong = text.rlike(r"""[.?!。！？]+["')\]]*$""")
    ms = lambda us: F.greatest(F.lit(0), T.js_round(us / 1000)).cast("long")
    return cues.select(
        "*",
        ms(F.col("start_us") - F.coalesce(F.lag("end_us").over(w), F.col("start_us"))).alias("gap_ms"),
        ms(F.col("end_us") - F.col("start_us")).alias("dur_ms"),
        strong.alias("ends_strong"),
        (~strong & text.rlike(r"""[,;:，；：\-–—]+["')\]]*$""")).alias("ends_soft"),
        text.rlike(r"""^["'(\[]*[a-z]""").alias("starts_lower"),
    )


def allocate_timings(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Share each key's span (start_us, end_us) over its parts (idx from 0, text) by text length.

    The clamp chain of ends is a running maximum: end_i = i + max over j<=i of (target_j - j).
    """
    w = Window.partitionBy(*keys).orderBy("idx")
    whole = Window.partitionBy(*keys)
    n = F.count(F.lit(1)).over(whole)
    weight = F.greatest(F.lit(1), T.u16len(F.col("text"))).cast("long")
    end = F.greatest(F.col("end_us"), F.col("start_us") + n)
    rows = parts.withColumn("_n", n).withColumn("_end", end).withColumn("_upto", F.sum(weight).over(w)).withColumn("_all", F.sum(weight).over(whole))
    target = F.when(F.col("idx") == F.col("_n") - 1, F.col("_end")).otherwise(F.col("start_us") + T.js_round((F.col("_end") - F.col("start_us")) * F.col("_upto") / F.col("_all")))
    rows = rows.withColumn("_chain", F.greatest(F.col("start_us") + 1, F.max(target - F.col("idx")).over(w)) + F.col("idx"))
    rows = rows.withColumn("part_end_us", F.when(F.col("_n") == 1, F.col("end_us")).otherwise(F.col("_chain")).cast("long"))
    return rows.withColumn("part_start_us", F.coalesce(F.lag("part_end_us").over(w), F.col("start_us")).cast("long")).drop("_n", "_end", "_upto", "_all", "_chain")


def split_overlong_cues(cues: DataFrame) -> DataFrame:
    """Cut cues over six seconds at two or more inner sentence ends; new ids follow the video's largest."""
    mark = F.regexp_replace("text", r"""([.?!]["')\]]*)""" + T.WS + "+(?=[A-Z])", "$1\u0001")
    pieces = F.filter(F.transform(F.split(mark, "\u0001"), T.trim_ws), lambda p: p != "")
    long = (F.col("end_us") - F.col("start_us") > OVERLONG_US) & (F.regexp_count(mark, F.lit("\u0001")) >= 2) & (F.size(pieces) >= 2)
    rows = cues.withColumn("_split", long).withColumn("_pieces", F.when(long, pieces).otherwise(F.array("text")))
    rows = rows.withColumn("_last", F.max("cue_id").over(Window.partitionBy("video_id")))
    each = rows.select("video_id", "cue_id", "pos", "start_us", "end_us", "_split", "_last", F.posexplode("_pieces").alias("idx", "text"))
    timed = allocate_timings(each, ["video_id", "pos"])
    order = Window.partitionBy("video_id").orderBy("pos", "idx")
    new = F.greatest(F.col("_last"), F.lit(0)) + F.sum(F.col("_split").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return timed.select(
        "video_id",
        F.when(F.col("_split"), new).otherwise(F.col("cue_id")).cast("long").alias("cue_id"),
        (F.row_number().over(order) - 1).cast("long").alias("pos"),
        F.when(F.col("_split"), F.col("part_start_us")).otherwise(F.col("start_us")).alias("start_us"),
        F.when(F.col("_split"), F.col("part_end_us")).otherwise(F.col("end_us")).alias("end_us"),
        "text",
    )


def _numbered_groups(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Group numbers of rows (video_id, start_us, end_us, far) that come sorted by video, start and pos: a new group
    where a cue is far from the one before, or would stretch its group over the longest span."""
    video, group, first = None, 0, 0
    for rows in batches:
        out = []
        for v, a, b, far in zip(*(rows.field(k).to_pylist() for k in range(4))):
            if v != video:
                video, group, first = v, 0, a
            elif far or b - first > MAX_SEGMENT_US:
                group, first = group + 1, a
            out.append(group)
        yield pa.array(out, pa.int64())


def group_by_gap(cues: DataFrame) -> DataFrame:
    """cues with group_no (from 0): a gap over 200 ms to the previous end starts a group, and so does a cue that ends
    over 30 s behind its group's start.

    The window leaves a video's cues in one partition, in order; the numbers are counted along them, from four small
    columns, and nothing is gathered. Counting isn't deterministic to the optimizer, so that no step moves below it.
    To the optimizer a Python function loses the layout, too, so the rows are dealt by video_id once more: what follows
    by video, group or segment keeps that layout and joins in it, without a shuffle for each step."""
    far = F.coalesce(F.col("start_us") - F.lag("end_us").over(_by_video("start_us", "pos")) > MERGE_GAP_US, F.lit(False))
    rows = cues.withColumn("_far", far)
    counted = F.arrow_udf(_numbered_groups, "long").asNondeterministic()
    return rows.withColumn("group_no", counted(F.struct("video_id", "start_us", "end_us", "_far"))).drop("_far").repartition("video_id")


def split_large_groups(groups: DataFrame) -> DataFrame:
    """Halve groups at their largest gap while they span over 30 s or read over 320 characters."""
    cue = F.struct("start_us", "pos", *[c for c in groups.columns if c not in ("video_id", "group_no", "start_us", "pos")])
    rows = groups.groupBy("video_id", "group_no").agg(F.sort_array(F.collect_list(cue)).alias("cues"))
    n = F.size("cues")
    span = F.element_at("cues", -1)["end_us"] - F.element_at("cues", 1)["start_us"]
    fails = (n > 1) & ((span > MAX_SEGMENT_US) | (T.u16len(T.join_for_translation(F.col("cues.text"))) > MAX_SEGMENT_CHARS))
    halves = F.when(fails, _halved("cues.start_us", "cues.end_us", "cues.text")).otherwise(F.transform("cues", lambda c: F.lit(0)))
    flat = rows.withColumn("h", halves).select("video_id", "group_no", F.explode(F.arrays_zip("cues", "h")).alias("z")).select("video_id", F.col("group_no").alias("_g"), "z.cues.*", F.col("z.h").alias("_h"))
    dense = F.dense_rank().over(_by_video("_g", "_h")) - 1
    return flat.withColumn("group_no", dense.cast("long")).select(*groups.columns)


def _cut_tree(gaps: list[int]) -> tuple[list[int], list[int], int]:
    """The Cartesian tree of gaps: of every range the first largest gap, above those to its left and right."""
    left, right, path = [-1] * len(gaps), [-1] * len(gaps), []
    for k, g in enumerate(gaps):
        below = -1
        while path and gaps[path[-1]] < g:
            below = path.pop()
        left[k] = below
        if path:
            right[path[-1]] = k
        path.append(k)
    return left, right, path[0] if path else -1


_BLANK, _DANGLING = re.compile(r"[\s\ufeff]+"), re.compile(r"[,;:\-–—]+$")


def halves(starts: list[int], ends: list[int], texts: list[str]) -> list[int]:
    """Numbers of the parts that a group's cues fall into when it is cut at its first largest gap, and its parts
    again, as long as they span over 30 s or read over 320 units. Lengths come from sums, so a group of n cues takes n
    steps but for its depth in small steps."""
    n = len(starts)
    units = lambda t: len(t.encode("utf-16-be")) // 2
    tidy = lambda t: _BLANK.sub(" ", t).strip()
    inner = [units(tidy(_DANGLING.sub("", t.rstrip()))) for t in texts]  # not the last of a part
    outer = [units(tidy(t)) for t in texts]
    size, some = [0], [0]
    for m in inner:
        size.append(size[-1] + m)
        some.append(some[-1] + (m > 0))

    def over(a: int, b: int) -> bool:
        last = outer[b - 1]
        words = some[b - 1] - some[a] + (last > 0)
        return ends[b - 1] - starts[a] > MAX_SEGMENT_US or size[b - 1] - size[a] + last + max(0, words - 1) > MAX_SEGMENT_CHARS

    left, right, root = _cut_tree([max(-1, starts[k] - ends[k - 1]) for k in range(1, n)])
    out, number, todo = [0] * n, 0, [(0, n, root)]
    while todo:
        a, b, at = todo.pop()
        if b - a > 1 and over(a, b):
            todo += [(at + 1, b, right[at]), (a, at + 1, left[at])]
        else:
            out[a:b] = [number] * (b - a)
            number += 1
    return out


@F.pandas_udf(ArrayType(IntegerType()))
def _halved(starts: pd.Series, ends: pd.Series, texts: pd.Series) -> pd.Series:
    return pd.Series([halves(list(s), list(e), list(t)) for s, e, t in zip(starts, ends, texts)])


def build_segments(groups: DataFrame, times: bool = False) -> DataFrame:
    """One row per group: segment_id from 0, cue_ids, first start, the last cue's end, joined English; with `times`
    also `cues`, an array of the cues' ids, places and times."""
    cue = F.struct("start_us", "pos", "cue_id", "end_us", "text")
    rows = groups.groupBy("video_id", "group_no").agg(F.sort_array(F.collect_list(cue)).alias("cues"))
    return rows.select(
        "video_id",
        (F.row_number().over(_by_video("group_no")) - 1).cast("long").alias("segment_id"),
        F.col("cues.cue_id").alias("cue_ids"),
        F.element_at("cues", 1)["start_us"].alias("start_us"),
        F.element_at("cues", -1)["end_us"].alias("end_us"),
        T.join_for_translation(F.col("cues.text")).alias("text_en"),
        *([F.transform("cues", lambda c: F.struct(c["cue_id"].alias("cue_id"), c["pos"].alias("pos"), c["start_us"].alias("start_us"), c["end_us"].alias("end_us"))).alias("cues")] if times else []),
    )


def time_windows(segments: DataFrame, videos: DataFrame) -> DataFrame:
    """deadline_us and window_us: up to the next start (or the video's end) less a safety gap."""
    until = F.coalesce(F.lead("start_us").over(_by_video("segment_id")), F.col("duration_us"))
    rows = segments.join(videos.select("video_id", "duration_us"), "video_id")
    rows = rows.withColumn("deadline_us", F.greatest(until - SAFETY_GAP_US, F.col("start_us") + SAFETY_GAP_US).cast("long"))
    return rows.withColumn("window_us", F.col("deadline_us") - F.col("start_us")).drop("duration_us")


def budget_chars(window_us: Column, cps: Column) -> Column:
    return F.greatest(F.lit(1), F.floor((window_us / 1_000_000 - 0.15) * cps * 0.9)).cast("long")


def segment_risk(window_us: Column, text_en: Column, n_cues: Column) -> Column:
    rate = T.u16len(text_en) / F.greatest(window_us / 1_000_000, F.lit(0.1))
    tokens = T.tech_tokens(text_en)
    score = F.when(window_us <= 1_800_000, 3).when(window_us <= 2_800_000, 2).when(window_us <= 4_000_000, 1).otherwise(0)
    score += F.when(rate >= 18, 2).when(rate >= 12, 1).otherwise(0) + F.when(tokens >= 4, 2).when(tokens >= 2, 1).otherwise(0) + F.when(n_cues >= 4, 1).otherwise(0)
    return F.when(score >= 5, "high").when(score >= 3, "medium").otherwise("low")


def translation_budget(budget: Column, risk: Column) -> Column:
    ratio = F.when(risk == "high", 0.02).when(risk == "medium", 0.05).otherwise(0.1)
    most = F.when(risk == "high", 2).when(risk == "medium", 4).otherwise(6)
    return F.greatest(F.lit(1), budget + F.least(most, F.greatest(F.lit(1), F.ceil(budget * ratio)))).cast("long")


def chunk_cues(cues: DataFrame, size: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """cues with chunk_no: chunks of `size` that overlap, until one reaches the video's end."""
    step = size - overlap
    n = F.count(F.lit(1)).over(Window.partitionBy("video_id"))
    rank = F.row_number().over(_by_video("pos")) - 1
    rows = cues.withColumn("_n", n).withColumn("_p", rank)
    last = F.when(F.col("_n") <= size, 0).otherwise(F.ceil((F.col("_n") - size) / step)).cast("int")
    low = F.greatest(F.lit(0), F.ceil((F.col("_p") - size + 1) / step)).cast("int")
    return rows.withColumn("chunk_no", F.explode(F.sequence(low, F.least(F.floor(F.col("_p") / step).cast("int"), last)))).drop("_n", "_p")


def validate_chunk_groups(responses: DataFrame, chunks: DataFrame) -> DataFrame:
    """responses(video_id, chunk_no, groups ARRAY<ARRAY<BIGINT>>) with valid: all ids in order, no empty group."""
    expected = chunks.groupBy("video_id", "chunk_no").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "cue_id"))), lambda c: c["cue_id"]).alias("expected"))
    fine = F.coalesce((F.flatten("groups") == F.col("expected")) & F.forall("groups", lambda g: F.size(g) > 0), F.lit(False))
    return expected.join(responses, ["video_id", "chunk_no"], "left").withColumn("valid", fine)


def chunk_votes(chunks: DataFrame, responses: DataFrame) -> DataFrame:
    """chunks with ends_group: as the groups of a valid response say, else as the gaps of the chunk's own
    cues do; `valid` tells which."""
    key = ["video_id", "chunk_no"]
    checked = validate_chunk_groups(responses, chunks).select(*key, "valid", F.transform("groups", lambda g: F.element_at(g, F.lit(-1))).alias("_ends"))
    rows = chunks.join(checked, key)
    said = rows.filter("valid").withColumn("ends_group", F.array_contains("_ends", F.col("cue_id"))).drop("_ends")
    apart = group_by_gap(rows.filter("NOT valid").drop("_ends").withColumn("video_id", F.struct("video_id", "chunk_no")).drop("chunk_no"))
    then = F.lead("group_no").over(_by_video("start_us", "pos"))
    apart = apart.withColumn("ends_group", F.coalesce(then != F.col("group_no"), F.lit(True))).select("*", F.col("video_id.chunk_no").alias("chunk_no"))
    return said.unionByName(apart.withColumn("video_id", F.col("video_id.video_id")).drop("group_no"))


def merge_chunk_votes(votes: DataFrame) -> DataFrame:
    """votes(video_id, pos, cue_id, chunk_no, ends_group) to group_no: a cue ends its group only if every
    chunk that holds it says so; the last cue always does."""
    cues = votes.groupBy("video_id", "pos", "cue_id").agg(F.min(F.col("ends_group").cast("int")).alias("all_say"))
    before = F.coalesce(F.sum("all_say").over(_by_video("pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return cues.select("video_id", "pos", "cue_id", before.cast("long").alias("group_no"))


def group_by_votes(cues: DataFrame, responses: DataFrame) -> DataFrame:
    """(video_id, pos, cue_id, group_no) by the votes of all chunks of cues on responses(video_id, chunk_no,
    groups); a video without a valid response is grouped by its gaps."""
    votes = chunk_votes(chunk_cues(cues), responses)
    heard = votes.filter("valid").select("video_id").distinct()
    voted = merge_chunk_votes(votes.join(heard, "video_id", "left_semi"))
    return voted.unionByName(group_by_gap(cues.join(heard, "video_id", "left_anti")).select(*voted.columns))


def timeline_checks(cues: DataFrame) -> DataFrame:
    """Per video: cues that start before an earlier one ends, and cues under 400 ms."""
    w = _by_video("start_us", "pos")
    before = F.max("end_us").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = cues.select("video_id", (F.col("start_us") < before).alias("overlaps"), (F.col("end_us") - F.col("start_us") < 400_000).alias("short"))
    return rows.groupBy("video_id").agg(F.count(F.lit(1)).alias("n_cues"), F.count_if("overlaps").alias("n_overlaps"), F.count_if("short").alias("n_short"))


def overlapping_pairs(cues: DataFrame) -> DataFrame:
    """(video_id, first_id, second_id, from_us, overlap_us): every pair of cues of a video of which the second starts,
    in order of start and pos, before the first one ends. Cues without ids or times pair with nothing; one that
    ends no later than it starts can only be a second.

    An equality join over buckets of time. Cues are in classes by duration, and a class has buckets about as wide
    as its cues are long: a cue lies in one or two of them, and in each class of its video every cue is a second
    in the one bucket that it starts in. So a pair meets once, and a cue meets little more than what it overlaps,
    however dense the cues or long a few of them."""
    rows = cues.select("video_id", "cue_id", "pos", "start_us", "end_us").filter("video_id IS NOT NULL AND cue_id IS NOT NULL AND start_us IS NOT NULL AND end_us IS NOT NULL")
    wide = F.length(F.bin(F.col("end_us") - F.col("start_us")))  # buckets of 2^wide microseconds, over the duration
    bucket = lambda at, wide: F.floor(at / F.pow(F.lit(2.0), wide)).cast("long")
    firsts = rows.filter("end_us > start_us").withColumn("wide", wide)
    classes = firsts.groupBy("video_id").agg(F.collect_set("wide").alias("classes"))  # 64 at most
    spans = F.sequence(bucket(F.col("start_us"), F.col("wide")), bucket(F.col("end_us") - 1, F.col("wide")))
    firsts = firsts.select("video_id", "wide", F.explode(spans).alias("bucket"), F.col("cue_id").alias("first_id"), F.struct("start_us", "pos", "cue_id").alias("first"), F.col("end_us").alias("first_end"))
    seconds = rows.join(classes, "video_id").select("video_id", "cue_id", "pos", "start_us", "end_us", F.explode("classes").alias("wide"))
    seconds = seconds.select("video_id", "wide", bucket(F.col("start_us"), F.col("wide")).alias("bucket"), F.col("cue_id").alias("second_id"), F.struct("start_us", "pos", "cue_id").alias("second"), F.col("end_us").alias("second_end"))
    pairs = firsts.join(seconds, ["video_id", "wide", "bucket"]).filter((F.col("first") < F.col("second")) & (F.col("second.start_us") < F.col("first_end")))
    overlap = F.greatest(F.lit(0), F.least("first_end", "second_end") - F.col("second.start_us")).cast("long")
    return pairs.select("video_id", "first_id", "second_id", F.col("second.start_us").alias("from_us"), overlap.alias("overlap_us"))
