"""The three workloads: plan (cues to windows and requests), resolve (attempts to texts), finish (takes to layout)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cueloom.functions import text as T
from cueloom.operators import audio, cues as C, match, translate


def plan_segments(cues: DataFrame, videos: DataFrame, cps: float = 5.0) -> DataFrame:
    """Segments with deadline, window, budgets and risk. One exchange of the cues by video_id; every
    step after it keeps that layout."""
    rows = C.build_segments(C.split_large_groups(C.group_by_gap(cues)))
    return with_budgets(C.time_windows(rows, videos), cps)


def with_budgets(windows: DataFrame, cps: float = 5.0) -> DataFrame:
    rows = windows.withColumn("budget_chars", C.budget_chars(F.col("window_us"), F.lit(cps)))
    rows = rows.withColumn("risk", C.segment_risk(F.col("window_us"), F.col("text_en"), F.size("cue_ids")))
    return rows.withColumn("max_chars", C.translation_budget(F.col("budget_chars"), F.col("risk")))


def requests(segments: DataFrame, cache: DataFrame) -> DataFrame:
    """Translation request batches of the segments that aren't cached and are translatable."""
    items = segments.withColumn("src", F.col("text_en")).filter(~T.is_untranslatable_source(F.col("text_en")))
    open_ = translate.pending_translations(items, cache)
    return translate.request_batches(open_.select("video_id", "segment_id", F.col("src").alias("text"), "max_chars"))


def resolve(items: DataFrame, attempts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(texts, issues)."""
    texts = translate.resolve_attempts(items, attempts)
    issues = texts.filter("is_issue").select("video_id", "segment_id").join(items.select("video_id", "segment_id", F.col("src").alias("text"), "max_chars"), ["video_id", "segment_id"])
    return texts, issues


def finish(segments: DataFrame, takes: DataFrame, videos: DataFrame) -> DataFrame:
    """Chosen takes, clipped to their windows where needed, at their places in the track."""
    chosen = audio.select_take(takes, segments).join(segments.select("video_id", "segment_id", "window_us"), ["video_id", "segment_id"])
    length = F.when(F.col("clip"), F.least("duration_us", "window_us")).otherwise(F.col("duration_us"))
    sized = chosen.select("video_id", "segment_id", "attempt_no", "clip", audio.samples_of(length).alias("n_samples"))
    layout = audio.track_layout(segments, sized, videos)
    return sized.join(layout, ["video_id", "segment_id"])


def choose_subtitles(videos: DataFrame, files: DataFrame) -> DataFrame:
    """The subtitle of every video that has one: best candidate, else the directory's lone English file. Names are
    matched once, and files scored once."""
    names = files.select("dir", "filename", "ext")
    candidates = match.match_subtitles(videos, names).unionByName(match.lone_pairs(videos, names))
    scored = match.score_files(files).select("dir", "filename", "language_score", "language_confidence")
    return match.pick_subtitle(candidates.join(scored, ["dir", "filename"])).select("dir", "stem", "filename", "match_kind")
