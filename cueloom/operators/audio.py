"""Speech takes: choice, fitting, boundaries, track layout and PCM blocks (16-bit mono at 48 kHz)."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from cueloom.functions import text as T

# Sample rate, silence level, fades and over-length steps.
RATE, FRAME, SILENCE = 48_000, 960, 32768 * 10 ** (-40 / 20)
FADE, SLIGHT_OVER, TAIL = 480, 1.18, 3
# White space, characters that a text may be cut behind or before, and those that hold together.
BLANK = "\t\n\x0b\x0c\r \xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
CUT_BEHIND = set(BLANK + ",.;:!?)]}，。；：！？、）")
CUT_BEFORE = set(BLANK + "([{（")
TOGETHER = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_./#+-")
# Shares of a part that must be heard for any text, for whole ASCII words, and for others.
HEARD, HEARD_WORD, HEARD_OTHER = 0.2, 0.75, 0.4
SEG = ["video_id", "segment_id"]


def voice_cps(takes: DataFrame) -> DataFrame:
    """Characters per second of every voice over takes(voice, text, duration_us); 5 without duration."""
    rows = takes.groupBy("voice").agg(F.sum(T.u16len(F.col("text"))).alias("n"), F.sum("duration_us").alias("us"))
    return rows.select("voice", F.when(F.col("us") > 0, F.col("n") * 1_000_000 / F.col("us")).otherwise(5.0).alias("cps"))


def select_take(takes: DataFrame, segments: DataFrame) -> DataFrame:
    """The first take in order of tries that fits the window, else the shortest, flagged for clipping."""
    rows = takes.join(segments.select(*SEG, "window_us"), SEG)
    fits = F.when(F.col("duration_us") <= F.col("window_us"), F.col("attempt_no"))
    rows = rows.groupBy(*SEG, "window_us").agg(F.min(F.when(fits.isNotNull(), F.struct("attempt_no", "duration_us"))).alias("fit"), F.min(F.struct("duration_us", "attempt_no")).alias("short"))
    return rows.select(*SEG, F.coalesce("fit.attempt_no", "short.attempt_no").alias("attempt_no"), F.coalesce("fit.duration_us", "short.duration_us").alias("duration_us"), F.col("fit").isNull().alias("clip"))


def fallback_plan(takes: DataFrame, segments: DataFrame) -> DataFrame:
    """For first takes over their window: the rate steps allowed and the characters to compress to."""
    rows = takes.filter("attempt_no = 1").join(segments.select(*SEG, "window_us", "n_chars", "risk"), SEG).filter("duration_us > window_us")
    over = F.col("duration_us") / F.col("window_us")
    steps = F.when(over <= 1.04, "+4%").when(over <= 1.08, "+4%,+6%").when(over <= SLIGHT_OVER, "+4%,+6%,+8%").otherwise("")
    factor = F.when(F.col("risk") == "high", 0.84).when(F.col("risk") == "medium", 0.87).otherwise(0.9)
    return rows.select(*SEG, over.alias("over_ratio"), steps.alias("rate_steps"), F.greatest(F.lit(2), F.floor(F.col("n_chars") / over * factor)).cast("long").alias("target_chars"))


def alignment_segments(segments: DataFrame, takes: DataFrame, layout: DataFrame | None = None, gap_us: int = 0) -> DataFrame:
    """Per segment with a take: overrun_us, over the window; utilization, the part of the window that is spoken (null
    for an empty window); runs_on, whether it ends later than `gap_us` before the next such segment starts; and
    start_error_us, how far the start is from the planned one.

    With layout(video_id, segment_id, place, written) starts and ends are those of the track, in samples, else the
    planned starts and the takes' lengths; then there is no start error."""
    rows = segments.join(takes.select(*SEG, "duration_us"), SEG)
    at, end = F.col("start_us"), F.col("start_us") + F.col("duration_us")
    if layout is not None:
        rows = rows.join(layout.select(*SEG, "place", "written"), SEG)
        at, end = F.col("place") * 1_000_000 / RATE, (F.col("place") + F.col("written")) * 1_000_000 / RATE
    rows = rows.withColumn("_at", T.js_round(at).cast("long")).withColumn("_end", T.js_round(end).cast("long"))
    nxt = F.lead("_at").over(Window.partitionBy("video_id").orderBy("segment_id"))
    return rows.select(
        *SEG,
        "duration_us",
        "window_us",
        F.abs(F.col("_at") - F.col("start_us")).alias("start_error_us"),
        F.greatest(F.lit(0), F.col("duration_us") - F.col("window_us")).alias("overrun_us"),
        F.when(F.col("window_us") > 0, F.col("duration_us") / F.col("window_us")).alias("utilization"),
        F.coalesce(F.col("_end") > nxt - gap_us, F.lit(False)).alias("runs_on"),
    )


def alignment_metrics(segments: DataFrame, takes: DataFrame, layout: DataFrame | None = None, gap_us: int = 0) -> DataFrame:
    """Per video: overruns, use of the windows, takes that would run into the next segment, and quantiles of overrun,
    start error and utilization. Quantiles are exact, of n known values the one of rank ceil(p * n): a video's values
    are ranked where its rows already are, in sorts that spill."""
    rows = alignment_segments(segments, takes, layout, gap_us)
    whole = Window.partitionBy("video_id")
    ranked = ["start_error_us", "overrun_us", "utilization"]
    rows = rows.withColumns({f"_n_{c}": F.count(c).over(whole) for c in ranked})
    rows = rows.withColumns({f"_r_{c}": F.row_number().over(whole.orderBy(F.asc_nulls_last(c))) for c in ranked})
    quantile = lambda c, percent: F.max(F.when(F.col(f"_r_{c}") == F.expr(f"(_n_{c} * {percent} + 99) div 100"), F.col(c)))
    return rows.groupBy("video_id").agg(
        F.count(F.lit(1)).alias("n_segments"),
        F.max("overrun_us").alias("max_overrun_us"),
        F.count_if(F.col("overrun_us") > 0).alias("n_overruns"),
        F.sum("duration_us").alias("spoken_us"),
        F.sum("window_us").alias("window_us"),
        F.count_if("runs_on").alias("n_run_on"),
        F.max("start_error_us").alias("max_start_error_us"),
        quantile("start_error_us", 95).alias("p95_start_error_us"),
        quantile("overrun_us", 95).alias("p95_overrun_us"),
        quantile("utilization", 50).alias("p50_utilization"),
        quantile("utilization", 95).alias("p95_utilization"),
    )


#: Of a sketch; a quantile's rank is off by 1.33 % at most, with a chance of 99 %.
SKETCH_K = 200


def alignment_sketches(alignment: DataFrame, by: list[str] = ["video_id"]) -> DataFrame:
    """Mergeable summaries of `alignment_segments`' start errors, overruns and utilizations (in thousandths) by the given
    columns, a few hundred bytes each, to be kept and merged into those of wider groups by `merged_sketches`."""
    sketch = lambda c: F.kll_sketch_agg_bigint(c.cast("long"), SKETCH_K)
    return alignment.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_segments"),
        sketch(F.col("start_error_us")).alias("start_error_us"),
        sketch(F.col("overrun_us")).alias("overrun_us"),
        sketch(T.js_round(F.coalesce("utilization", F.lit(0.0)) * 1000)).alias("utilization"),
    )


def merged_sketches(sketches: DataFrame, by: list[str], quantiles: list[float]) -> DataFrame:
    """Quantiles of groups of sketches: n_segments, and arrays named like the sketches."""
    found = sketches.groupBy(*by).agg(F.sum("n_segments").alias("n_segments"), *[F.kll_merge_agg_bigint(c).alias(c) for c in ("start_error_us", "overrun_us", "utilization")])
    each = lambda c: F.array(*[F.kll_sketch_get_quantile_bigint(c, F.lit(q)) for q in quantiles])
    return found.select(*by, "n_segments", *[each(c).alias(c) for c in ("start_error_us", "overrun_us")], F.transform(each("utilization"), lambda u: u / 1000).alias("utilization"))


def cached_takes(segments: DataFrame, takes: DataFrame) -> DataFrame:
    """Takes usable again: same signature and text hash, sound numbers; the latest for each segment."""
    wanted = segments.select("video_id", "segment_id", "signature", T.content_hash(F.col("text")).alias("text_hash"))
    rows = takes.join(wanted, ["video_id", "segment_id", "signature", "text_hash"]).filter("duration_us > 0 AND lead_trim_us >= 0")
    return rows.groupBy(*SEG).agg(F.max(F.struct("attempt_no", "duration_us", "lead_trim_us")).alias("t")).select(*SEG, "t.*")


def normalize_boundaries(boundaries: DataFrame) -> DataFrame:
    """Shift by lead_trim_us, clamp to [0, duration_us], drop what is empty and, where there is a column
    `part`, blank parts."""
    if "part" in boundaries.columns:
        boundaries = boundaries.filter(T.trim_ws(F.col("part")) != "")
    at = lambda c: F.greatest(F.lit(0), F.least(F.col(c) - F.col("lead_trim_us"), F.col("duration_us"))).cast("long")
    return boundaries.withColumn("_s", at("start_us")).withColumn("_e", at("end_us")).filter("_e > _s").withColumn("start_us", F.col("_s")).withColumn("end_us", F.col("_e")).drop("_s", "_e")


def pcm_duration_us(pcm: Column) -> Column:
    return T.js_round(F.octet_length(pcm) / 2 / RATE * 1_000_000).cast("long")


def samples_of(us: Column) -> Column:
    return T.js_round(us * RATE / 1_000_000).cast("long")


def total_samples(us: Column) -> Column:
    """Samples of a whole track, a begun one included."""
    return F.ceil(us / 1_000_000 * RATE).cast("long")


def track_layout(segments: DataFrame, takes: DataFrame, videos: DataFrame) -> DataFrame:
    """Where each take's samples go: place and written, so that nothing overlaps or passes the end.
    A segment without a take writes nothing and still holds its place up to its deadline.

    cursor = max(cursor, start) + length, then max(cursor, deadline), is a max-plus scan: with S the
    running sum of lengths, cursor - S is a running maximum of start_j - S_(j-1) and deadline_j - S_j.
    """
    rows = segments.join(takes.select(*SEG, "n_samples"), SEG, "left").join(videos.select("video_id", total_samples(F.col("duration_us")).alias("total")), "video_id")
    rows = rows.withColumn("n_samples", F.coalesce("n_samples", F.lit(0)))
    rows = rows.withColumn("s", samples_of(F.col("start_us"))).withColumn("d", samples_of(F.col("deadline_us")))
    w = Window.partitionBy("video_id").orderBy("segment_id")
    rows = rows.withColumn("sum", F.sum("n_samples").over(w))
    step = F.greatest(F.lit(0), F.col("s") - F.col("sum") + F.col("n_samples"), F.col("d") - F.col("sum"))
    rows = rows.withColumn("cursor", F.col("sum") + F.max(step).over(w))
    place = F.greatest(F.col("s"), F.coalesce(F.lag("cursor").over(w), F.lit(0)))
    rows = rows.withColumn("place", place)
    return rows.select(*SEG, "place", F.greatest(F.lit(0), F.least("n_samples", F.col("total") - F.col("place"))).cast("long").alias("written"))


def _faded(x: np.ndarray, head: bool = True, tail: bool = True) -> np.ndarray:
    n = min(FADE, len(x) // 2)
    y = x.astype(np.float64)
    if n:
        ramp = np.arange(n) / n
        if head:
            y[:n] *= ramp
        if tail:
            y[-n:] *= ramp[::-1]
    return np.floor(y + 0.5).astype("<i2")


def _loud(x: np.ndarray) -> bool:
    return len(x) > 0 and float(np.sqrt(np.mean(x.astype(np.float64) ** 2))) > SILENCE


def trimmed(pcm: bytes | None) -> tuple[int, int]:
    """(first, last) sample to keep. Frames count from the start up to the first loud one, before which
    one is kept, and from the end back to the last loud one, behind which one is kept; a tail of TAIL
    silent frames loses all of them but the earliest. All silence gives the length twice."""
    x = np.frombuffer(pcm or b"", "<i2")
    n = len(x)
    first = next((at for at in range(0, n, FRAME) if _loud(x[at : at + FRAME])), None)
    if first is None:
        return n, n
    start = max(0, first - FRAME)
    ends = [n - k * FRAME for k in range(TAIL) if n - k * FRAME > start]
    for end in ends:
        if _loud(x[max(0, end - FRAME) : end]):
            return start, min(n, end + FRAME)
    return start, max(start, ends[-1]) if len(ends) == TAIL else n


@F.pandas_udf(StructType([StructField("pcm", BinaryType()), StructField("first_sample", LongType()), StructField("last_sample", LongType())]))
def trim_silence(pcms: pd.Series) -> pd.DataFrame:
    rows = [(a, b, (p or b"")[2 * a : 2 * b]) for p in pcms for a, b in [trimmed(p)]]
    return pd.DataFrame({"pcm": [r[2] for r in rows], "first_sample": [r[0] for r in rows], "last_sample": [r[1] for r in rows]})


def heard_part(part: str, start_us: int, end_us: int, clip_us: int) -> str:
    """What of a part's text is heard if the sound ends at clip_us: up to the cut nearest to its share of
    the time, the earlier of two; nothing if too little is heard for any cut."""
    if clip_us >= end_us or not part:
        return part
    share = min(1.0, max(0, clip_us - start_us) / max(1, end_us - start_us))
    want = int(len(part) * share)
    if want <= 0 or share < HEARD:
        return ""
    may = lambda k: part[k - 1] in CUT_BEHIND or part[k] in CUT_BEFORE or not (part[k - 1] in TOGETHER and part[k] in TOGETHER)
    cuts = [k for k in range(1, len(part)) if may(k)]
    if cuts:
        return part[: min(cuts, key=lambda k: (abs(k - want), k))].rstrip(BLANK)
    words = any(c.isascii() and c.isalpha() for c in part)
    return "" if share < (HEARD_WORD if words else HEARD_OTHER) else part[:want].rstrip(BLANK)


def clipped(pcm: bytes | None, window_us: int, text: str | None, boundaries: list[dict] | None) -> tuple[bytes, int, str, list[dict]]:
    """(pcm, duration_us, spoken_text, boundaries) of a take cut to a window; one that fits is left as it is."""
    x = np.frombuffer(pcm or b"", "<i2")
    us = lambda n: int(np.floor(n / RATE * 1_000_000 + 0.5))
    n, bounds = int(np.floor(window_us / 1_000_000 * RATE + 0.5)), list(boundaries if boundaries is not None else [])
    if len(x) <= n:
        return pcm or b"", us(len(x)), text or "", bounds
    y, fade = x[:n].astype(np.float64), min(3 * FADE, n // 4)
    if fade:
        y[n - fade :] *= (np.arange(fade) / fade)[::-1]
    length, kept = us(n), []
    for b in bounds:
        part, start, end = heard_part(b["part"] or "", b["start_us"], b["end_us"], length), min(b["start_us"], length), min(b["end_us"], length)
        if part.strip(BLANK) and end > start:
            kept.append({"part": part, "start_us": int(start), "end_us": int(end)})
    spoken = "".join(b["part"] for b in kept) or ("" if bounds else text or "")
    return np.floor(y + 0.5).astype("<i2").tobytes(), length, spoken, kept


def clip_to_window(takes: DataFrame) -> DataFrame:
    """takes(video_id, segment_id, pcm, window_us, spoken_text, boundaries ARRAY<STRUCT<part, start_us,
    end_us>>) cut to their windows, with duration_us; spoken_text may be absent. Narrow."""
    schema = "video_id long, segment_id long, pcm binary, duration_us long, spoken_text string, boundaries array<struct<part:string,start_us:long,end_us:long>>"
    given = takes if "spoken_text" in takes.columns else takes.withColumn("spoken_text", F.lit(""))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [clipped(*r) for r in zip(b["pcm"], b["window_us"], b["spoken_text"], b["boundaries"])]
            done = pd.DataFrame(rows, columns=["pcm", "duration_us", "spoken_text", "boundaries"])
            yield pd.concat([b[["video_id", "segment_id"]].reset_index(drop=True), done], axis=1)

    return given.select("video_id", "segment_id", "pcm", "window_us", "spoken_text", "boundaries").mapInPandas(run, schema)


#: Bytes of finished blocks that a task holds before it hands them on.
HELD = 8 << 20


@lru_cache(maxsize=FADE + 1)
def _ramp(n: int) -> np.ndarray:
    return np.arange(n) / n


def _fade_in_place(x: np.ndarray, first: int, length: int) -> None:
    """What `_faded` does, to the samples from `first` on of a take of `length` samples."""
    n = min(FADE, length // 2)
    if first < n:
        head = x[: n - first]
        head[:] = np.floor(head * _ramp(n)[first : first + len(head)] + 0.5)
    if n and first + len(x) > length - n:
        at = max(0, length - n - first)
        from_end = length - first - at
        x[at:] = np.floor(x[at:] * _ramp(n)[from_end - len(x) + at : from_end][::-1] + 0.5)


def _written(batches: Iterator[pa.RecordBatch], out: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Blocks of rows (video_id, block, at, samples, first, pcm) in order: a block's first row, with an `at` of -1, has
    its number of samples; the others are pieces of takes. Pieces of no block are left out."""
    key, track = None, None
    done: tuple[list, list, list] = ([], [], [])
    held = 0
    for batch in batches:
        for video, block, at, samples, first, pcm in zip(*(c.to_pylist() for c in batch.columns)):
            if at < 0:
                if track is not None:
                    for column, value in zip(done, (*key, track.tobytes())):
                        column.append(value)
                    held += track.nbytes
                if held >= HELD:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(done, out)], schema=out)
                    done, held = ([], [], []), 0
                key, track = (video, block), np.zeros(samples, "<i2")
            elif key == (video, block):
                piece = track[at : at + len(pcm) // 2]
                piece[:] = np.frombuffer(pcm, "<i2")
                _fade_in_place(piece, first, samples)
    if track is not None:
        for column, value in zip(done, (*key, track.tobytes())):
            column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(done, out)], schema=out)


def assemble_track(layout: DataFrame, takes: DataFrame, videos: DataFrame, block_s: int = 60) -> DataFrame:
    """(video_id, block, pcm): faded takes written at their places, in blocks of fixed length so that no
    row holds a whole track. Silence fills the rest; only samples that a block needs are shuffled to it, once and as
    they are: takes are faded where they are written, so that even sound takes little room on the way."""
    size = block_s * RATE
    ends = videos.select("video_id", total_samples(F.col("duration_us")).alias("total")).filter("total > 0")
    grid = ends.select("video_id", "total", F.explode(F.expr(f"sequence(0L, (total - 1) div {size})")).alias("block"))
    long = lambda c: c.cast("long")
    grid = grid.select("video_id", "block", F.lit(-1).cast("long").alias("at"), long(F.least(F.lit(size), F.col("total") - F.col("block") * size)).alias("samples"), F.lit(0).cast("long").alias("first"), F.lit(None).cast("binary").alias("pcm"))
    rows = layout.filter("written > 0").join(takes.select(*SEG, "pcm"), SEG)
    parts = rows.select("*", F.explode(F.expr(f"sequence(place div {size}, (place + written - 1) div {size})")).alias("block"))
    start = F.greatest(F.lit(0), F.col("block") * size - F.col("place"))
    stop = F.least(F.col("written"), (F.col("block") + 1) * size - F.col("place"))
    piece = F.substring("pcm", (2 * start + 1).cast("int"), (2 * (stop - start)).cast("int"))
    parts = parts.select("video_id", "block", long(F.col("place") + start - F.col("block") * size).alias("at"), F.expr("CAST(octet_length(pcm) div 2 AS BIGINT)").alias("samples"), long(start).alias("first"), piece.alias("pcm"))
    # as many partitions as are set, also where what is shuffled is far smaller than what is written
    n = int(layout.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sent = grid.unionByName(parts.filter("pcm IS NOT NULL")).repartition(n, "video_id", "block").sortWithinPartitions("video_id", "block", "at")
    schema = StructType([sent.schema["video_id"], StructField("block", LongType()), StructField("pcm", BinaryType())])
    arrow = to_arrow_schema(schema)
    return sent.mapInArrow(lambda batches: _written(batches, arrow), schema)
