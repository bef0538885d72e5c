"""Rules for sound, against plain versions and fixed cases."""

from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from cueloom.operators import audio as A


def _plain_trim(x):
    """The rule written over single frames: head frames from the start, tail frames from the end."""
    n, loud = len(x), lambda a, b: b > a and np.sqrt((x[a:b].astype(float) ** 2).mean()) > 32768 * 0.01
    at = 0
    while at < n and not loud(at, min(n, at + 960)):
        at += 960
    if at >= n:
        return n, n
    start, end, k = max(0, at - 960), n, n
    for silent in (1, 2, 3):
        if k <= start:
            break
        if loud(max(0, k - 960), k):
            end = min(n, k + 960)
            break
        if silent == 3:
            end = max(start, k)
        k -= 960
    return start, end


def test_trim_follows_the_rule_on_random_signals():
    rng = np.random.default_rng(1)
    for _ in range(300):
        frames = rng.integers(1, 14)
        x = np.concatenate([rng.normal(0, rng.choice([0, 20, 2000]), 960) for _ in range(frames)])[: int(rng.integers(1, frames * 960 + 1))].astype("<i2")
        assert A.trimmed(x.tobytes()) == _plain_trim(x)
    assert A.trimmed(b"") == A.trimmed(None) == (0, 0) and A.trimmed(bytes(9600)) == (4800, 4800)


@pytest.mark.parametrize(
    ("part", "window", "want"),
    [("Hello world", 500_000, "Hello"), ("ABCDEFGH", 500_000, ""), ("ABCDEFGH", 800_000, "ABCDEF"), ("Hello world", 100_000, ""), ("你好世界", 500_000, "你好"), ("one, two", 600_000, "one,")],
)
def test_text_of_a_clipped_take(part, window, want):
    pcm, us, spoken, bounds = A.clipped(bytes(2 * A.RATE), window, part, [{"part": part, "start_us": 0, "end_us": 1_000_000}])
    assert (spoken, us, len(pcm)) == (want, window, 2 * window * A.RATE // 1_000_000)
    assert [b["part"] for b in bounds] == ([want] if want else [])


def test_takes_that_fit_stay_and_others_fade():
    x = np.full(4800, 1000, "<i2")
    bounds = [{"part": " ", "start_us": 5, "end_us": 1}]
    assert A.clipped(x.tobytes(), 100_000, "t", bounds) == (x.tobytes(), 100_000, "t", bounds)
    pcm, us, spoken, none = A.clipped(x.tobytes(), 50_000, "t", None)
    y = np.frombuffer(pcm, "<i2")
    assert us == 50_000 and spoken == "t" and none == [] and len(y) == 2400
    fade = min(3 * A.FADE, 600)
    assert (y[: 2400 - fade] == 1000).all() and y[-1] == 0 and y[-fade] == np.floor(1000 * (fade - 1) / fade + 0.5)


def test_track_against_a_plain_writer(spark):
    rng = np.random.default_rng(2)
    starts = [0, 30_000, 60_000, 61_000, 140_000]
    pcms = [rng.integers(-3000, 3000, n).astype("<i2") for n in (1000, 4000, 0, 2000, 9000)]
    segments = spark.createDataFrame([(1, k, s, s + 25_000) for k, s in enumerate(starts)], "video_id long, segment_id long, start_us long, deadline_us long")
    takes = spark.createDataFrame([(1, k, p.tobytes(), len(p)) for k, p in enumerate(pcms) if len(p)], "video_id long, segment_id long, pcm binary, n_samples long")
    videos = spark.createDataFrame([(1, 200_001)], "video_id long, duration_us long")
    total = int(np.ceil(200_001 / 1e6 * A.RATE))
    want, cursor = np.zeros(total, "<i2"), 0
    for s, p in zip(starts, pcms):
        cursor = max(cursor, round(s * A.RATE / 1e6))
        if len(p):
            f = A._faded(p)[: max(0, total - cursor)]
            want[cursor : cursor + len(f)] = f
            cursor += len(f)
        cursor = max(cursor, round((s + 25_000) * A.RATE / 1e6))
    layout = A.track_layout(segments, takes, videos)
    blocks = A.assemble_track(layout, takes, videos, block_s=1).orderBy("block").collect()
    assert np.array_equal(np.frombuffer(b"".join(b.pcm for b in blocks), "<i2"), want)


def test_alignment_by_segment_and_its_quantiles(spark):
    rng = np.random.default_rng(5)
    segments, takes, layout, at = [], [], [], 0
    for k in range(400):
        window = int(rng.integers(1, 5)) * 500_000 if k % 50 else 0
        segments.append((k % 4, k, at, window))
        takes.append((k % 4, k, int(rng.integers(200_000, 2_600_000))))
        layout.append((k % 4, k, at * 48_000 // 1_000_000 + (480 if k % 10 == 0 else 0), takes[-1][2] * 48 // 1000))
        at += window + 10_000
    seg = spark.createDataFrame(segments, "video_id long, segment_id long, start_us long, window_us long")
    tk = spark.createDataFrame(takes, "video_id long, segment_id long, duration_us long")
    lay = spark.createDataFrame(layout, "video_id long, segment_id long, place long, written long")
    rows = A.alignment_segments(seg, tk, lay, 20_000)
    got = {r.segment_id: r for r in rows.collect()}
    for k in range(400):
        start, end = layout[k][2] / 0.048, (layout[k][2] + layout[k][3]) / 0.048
        assert abs(got[k].start_error_us - abs(start - segments[k][2])) <= 1
        assert got[k].overrun_us == max(0, takes[k][2] - segments[k][3]) and (got[k].utilization is None) == (segments[k][3] == 0)
        assert got[k].runs_on == (k + 4 < 400 and end + 20_000 > layout[k + 4][2] / 0.048 + (abs(end + 20_000 - layout[k + 4][2] / 0.048) <= 1))
    by_video = {r.video_id: r for r in A.alignment_metrics(seg, tk, lay, 20_000).collect()}
    over = sorted(max(0, takes[k][2] - segments[k][3]) for k in range(0, 400, 4))
    assert by_video[0].p95_overrun_us == over[94] and by_video[0].max_start_error_us >= 10_000
    whole = A.merged_sketches(A.alignment_sketches(rows), [], [0.5, 0.95]).first()
    every = sorted(got[k].overrun_us for k in range(400))
    for q, v in zip((0.5, 0.95), whole.overrun_us):
        assert every[int(400 * q) - 12] <= v <= every[min(399, int(400 * q) + 12)]
    assert whole.n_segments == 400 and len(whole.utilization) == 2


def test_quantiles_of_a_long_video_are_exact(spark):
    n = 30_011
    seg = spark.range(n).select(F.lit(1).cast("long").alias("video_id"), F.col("id").alias("segment_id"), (F.col("id") * 1_000_000).alias("start_us"), F.when(F.col("id") % 1000 == 0, 0).otherwise(500_000).cast("long").alias("window_us"))
    takes = spark.range(n).select(F.lit(1).cast("long").alias("video_id"), F.col("id").alias("segment_id"), (500_000 + F.col("id") * 7919 % n).alias("duration_us"))
    (row,) = A.alignment_metrics(seg, takes).collect()
    spoken = [500_000 + k * 7919 % n for k in range(n)]
    over = sorted(s - (0 if k % 1000 == 0 else 500_000) for k, s in enumerate(spoken))
    used = sorted(s / 500_000 for k, s in enumerate(spoken) if k % 1000)
    at = lambda values, p: values[-(-len(values) * p // 100) - 1]
    assert (row.p95_overrun_us, row.p50_utilization, row.p95_utilization, row.p95_start_error_us) == (at(over, 95), at(used, 50), at(used, 95), 0)


def test_even_sound_takes_little_room_on_its_way_into_blocks(spark):
    """Takes travel once and unfaded; faded ones, all ramps here, don't compress."""
    local = Path(spark.conf.get("spark.local.dir"))
    shuffled = lambda: {p: p.stat().st_size for p in local.rglob("shuffle_*.data")}
    n, k = 3000, F.col("id")
    seg = spark.range(n).select(F.lit(1).cast("long").alias("video_id"), k.alias("segment_id"), (k * 20_000).alias("start_us"), (k * 20_000 + 20_000).alias("deadline_us"))
    takes = seg.select("video_id", "segment_id", F.lit(960).cast("long").alias("n_samples"), F.expr("unhex(repeat(lpad(hex(segment_id + 5000), 4, '0'), 960))").alias("pcm"))
    videos = seg.groupBy("video_id").agg(F.max("deadline_us").alias("duration_us"))
    before = shuffled()
    blocks = A.assemble_track(A.track_layout(seg, takes, videos), takes, videos, block_s=1).collect()
    assert sum(size for p, size in shuffled().items() if p not in before) < 1_500_000 < len(blocks) * 2 * A.RATE
    level = lambda k: np.frombuffer((k + 5000).to_bytes(2, "big") * 960, "<i2")
    assert b"".join(b.pcm for b in sorted(blocks, key=lambda b: b.block)) == b"".join(A._faded(level(k)).tobytes() for k in range(n))


def test_pieces_fade_as_whole_takes_do():
    rng = np.random.default_rng(3)
    for length in (0, 1, 2, 3, 7, 959, 960, 961, 1500):
        x = rng.integers(-32768, 32768, length).astype("<i2")
        for cuts in ([0, length], sorted([0, length, *rng.integers(0, length + 1, 5).tolist()])):
            parts = [x[a:b].copy() for a, b in zip(cuts, cuts[1:])]
            for at, part in zip(cuts, parts):
                A._fade_in_place(part, at, length)
            assert np.array_equal(np.concatenate(parts), A._faded(x))
