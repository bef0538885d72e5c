"""Splitting of sentences for display and retiming: small row-local helpers on pandas columns."""

from __future__ import annotations

import bisect
import re
import unicodedata
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from cueloom.functions import text as T
from cueloom.operators.cues import allocate_timings

# Display limits, boundary characters, retiming margins.
MAX_CHARS, MIN_CHARS, MIN_PART_US = 40, 6, 800_000
MIN_CUE_US, MIN_GAP_US = 80_000, 20_000
_END = re.compile(r"[。！？!?…]+")
_SOFT = "，、；：,;:"
_WORD = re.compile(r"[A-Za-z0-9_./#+-]")
_AFTER, _BEFORE = set(",.;:!?，。；：！？、）)]}"), set("（([{")
_HALF = re.compile("[\ud800-\udfff]")
_SPACE = re.compile(r"[\s﻿]+")


def _units(text: str) -> str:
    """A text as UTF-16 code units, which the lengths and places here are in."""
    return text if text.isascii() or max(text) <= "\uffff" else "".join(map(chr, np.frombuffer(text.encode("utf-16-le"), "<u2").tolist()))


def _text(units: str) -> str:
    """The text of code units; a half of a cut pair becomes U+FFFD."""
    return units if units.isascii() or not _HALF.search(units) else units.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")


def _tidy(text: str | None) -> str:
    return _SPACE.sub(" ", text or "").strip()


def _glued(a: str, b: str) -> str:
    """Two sentences as one: the first one's end gives way to a comma."""
    if not a or not b:
        return a or b
    bare = re.sub(r"[。！？!?…]+$", "", a).rstrip()
    return b if not bare else bare + b if bare[-1] in _SOFT else f"{bare}，{b}"


def partition_text(text: str | None, most: int = MAX_CHARS, least: int = MIN_CHARS) -> list[str]:
    """Sentences of a text; short ones are joined on, long ones cut at soft punctuation near the middle."""
    text = _units(_tidy(text))
    ends = [m.end() for m in _END.finditer(text)]
    bounds = [0, *ends, *([len(text)] if not ends or ends[-1] < len(text) else [])]
    sentences = [s for a, b in zip(bounds, bounds[1:]) if (s := text[a:b].strip())]
    joined: list[str] = []
    waiting = ""
    if len(sentences) <= 1:
        joined = sentences
    else:
        for s in sentences:
            s = _glued(waiting, s)
            if len(s) < least:
                waiting = s
            else:
                joined.append(s)
                waiting = ""
        if waiting:
            joined[-1:] = [_glued(joined[-1], waiting)] if joined else [waiting]
    return [_text(piece) for s in joined for piece in _soft_pieces(s, most, least)]


def _soft_pieces(s: str, most: int, least: int) -> list[str]:
    if len(s) <= most:
        return [s]
    cuts = [k + 1 for k, c in enumerate(s) if c in _SOFT and k + 1 >= least and len(s) - k - 1 >= least]
    if not cuts:
        return [s]
    at = min(cuts, key=lambda k: (abs(k - len(s) // 2), k))
    left, right = s[:at].strip(), s[at:].strip()
    if min(len(left), len(right)) < least or max(len(left), len(right)) >= len(s):
        return [s]
    return _soft_pieces(left, most, least) + _soft_pieces(right, most, least)


def balanced(parts: list[str], span_us: int, least_us: int = MIN_PART_US) -> list[str]:
    """Merge the shortest part into a neighbour until every part has its least duration on average."""
    parts = list(parts)
    room = max(1, span_us // least_us)
    while span_us > 0 and len(parts) > room and len(parts) > 1:
        k = min(range(len(parts)), key=lambda i: (len(_units(parts[i])), i))
        k = min(k, len(parts) - 2)
        parts[k : k + 2] = [_glued(parts[k], parts[k + 1])]
    return parts


def _good_cuts(text: str) -> list[int]:
    """Places where a text may be cut: beside punctuation and white space, and not between letters of an ASCII word."""
    sticks = [bool(_WORD.match(c)) for c in text]
    free = [c.isspace() for c in text]
    return [k for k in range(1, len(text)) if text[k - 1] in _AFTER or free[k - 1] or text[k] in _BEFORE or free[k] or not (sticks[k - 1] and sticks[k])]


def _nearest(places: list[int], goal: int, low: int, high: int) -> int | None:
    """Of sorted places from low to high the nearest to goal, the lower of two."""
    k = bisect.bisect_right(places, goal)
    below = places[k - 1] if k and places[k - 1] >= low else None
    above = places[k] if k < len(places) and places[k] <= high else None
    if below is None or (above is not None and above - goal < goal - below):
        return above
    return below


def split_over(text: str | None, durations: list[int]) -> list[str]:
    """Cut a text into as many pieces as durations, near their shares, not inside ASCII words if avoidable."""
    text, n = _units(_tidy(text)), len(durations)
    if n <= 1:
        return [_text(text)][:n]
    if not text:
        return [""] * n
    weights = [max(1, d) for d in durations]
    good, whole = _good_cuts(text), sum(weights)
    cuts, done = [0], 0
    for i in range(n - 1):
        done += weights[i]
        low, high = cuts[-1] + 1, len(text) - (n - i - 1)
        goal = max(low, min(high, int(len(text) * done / whole + 0.5)))
        at = goal if goal >= len(text) else _nearest(good, goal, max(1, low), high)  # the text's end is a good place, too
        cuts.append(goal if at is None else at)
    return [_text(text[a:b].strip()) for a, b in zip(cuts, [*cuts[1:], len(text)])]


@F.pandas_udf(ArrayType(StringType()))
def partition_sentences(texts: pd.Series) -> pd.Series:
    return texts.map(partition_text, na_action=None)


@F.pandas_udf(ArrayType(StringType()))
def balance_parts(parts: pd.Series, spans: pd.Series) -> pd.Series:
    return pd.Series([balanced(list(p), int(s)) for p, s in zip(parts, spans)])


@F.pandas_udf(ArrayType(StringType()))
def split_text_across_cues(texts: pd.Series, durations: pd.Series) -> pd.Series:
    return pd.Series([split_over(t, [int(x) for x in d]) for t, d in zip(texts, durations)])


def repartition_cues(cues: DataFrame, segments: DataFrame, splits: DataFrame | None = None) -> DataFrame:
    """Display cues: each segment's text cut anew (or by `splits(video_id, segment_id, lines)`) and timed
    by length; cues of no segment pass through; a segment without text loses its cues."""
    each = segments.select("video_id", "segment_id", F.posexplode("cue_ids").alias("k", "cue_id"))
    top = F.greatest(F.lit(0), F.max("cue_id").over(Window.partitionBy("video_id")))
    lone = F.col("segment_id").isNull()
    # one join gives both the segments' cues and, as groups of their own, those of none
    rows = cues.select("video_id", "cue_id", "start_us", "end_us", "text", top.alias("top")).join(each, ["video_id", "cue_id"], "left")
    rows = rows.groupBy("video_id", "segment_id", F.when(lone, F.col("cue_id")).alias("own")).agg(F.sort_array(F.collect_list(F.struct("k", "start_us", "end_us", "text"))).alias("c"), F.max("top").alias("top"))
    rows = rows.withColumn("start_us", F.element_at("c", 1)["start_us"]).withColumn("end_us", F.element_at("c", -1)["end_us"])
    parts = partition_sentences(F.when(~lone, T.join_for_speech(F.col("c.text"))))
    if splits is not None:
        rows = rows.join(splits.select("video_id", "segment_id", "lines"), ["video_id", "segment_id"], "left")
        parts = F.when(F.size("lines") > 0, F.col("lines")).otherwise(parts)
    rows = rows.withColumn("p", balance_parts(parts, F.greatest(F.lit(0), F.col("end_us") - F.col("start_us"))))
    part = lambda text, start, end: F.struct(text.alias("text"), start.alias("start_us"), end.alias("end_us"))
    shown = F.when(lone, F.transform("c", lambda x: part(x["text"], x["start_us"], x["end_us"]))).otherwise(F.transform("p", lambda t: part(t, F.col("start_us"), F.col("end_us"))))
    key = ["video_id", "segment_id", "own"]
    rows = allocate_timings(rows.select(*key, "top", F.posexplode(shown).alias("idx", "x")).select(*key, "top", "idx", "x.*"), key)
    number = F.row_number().over(Window.partitionBy("video_id").orderBy(F.asc_nulls_last("segment_id"), "idx"))
    fresh = lambda own, new: F.when(lone, own).otherwise(new)
    return rows.select(
        "video_id",
        fresh(F.col("own"), F.col("top") + number).cast("long").alias("cue_id"),
        fresh(F.col("start_us"), F.col("part_start_us")).alias("start_us"),
        fresh(F.col("end_us"), F.col("part_end_us")).alias("end_us"),
        "text",
    )


_WEAK = re.compile(r"[\W_]", re.U)


class _Folds(dict):
    """For `str.translate`: NFKC and lower case of single characters, white space goes."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        self[code] = folded = "" if c.isspace() or c == "\ufeff" else unicodedata.normalize("NFKC", c).lower()
        return folded


_FOLDS = _Folds()


def _matchable(text: str, weak: bool) -> str:
    folded = text.translate(_FOLDS)
    return folded if weak else _WEAK.sub("", folded)


def retimed(cues: list[tuple[int, int, str]], boundaries: list[tuple[int, int, str]], start: int, deadline: int, duration: int) -> list[tuple[int, int]]:
    """New (start, end) of a segment's cues from where their texts stand in the spoken boundaries; both are
    (start_us, end_us, text)."""
    old = [c[:2] for c in cues]
    if not cues or not boundaries or duration <= 0:
        return old
    folded = [_matchable(b[2], True) for b in boundaries]
    exact = "".join(folded)
    if not exact:
        return old
    ends = list(accumulate(map(len, folded)))  # the boundary of a place is the first that ends behind it
    of = lambda place: boundaries[bisect.bisect_right(ends, place)]
    strong, reduced = None, ""
    end = min(deadline, start + duration)
    spans, cursor, floor = [], 0, start
    for cue in cues:
        full = _matchable(cue[2], True)
        if not full:
            spans.append((floor, floor))
            continue
        at = exact.find(full, cursor)
        if at >= 0:
            first, last = at, at + len(full) - 1
        else:
            if strong is None:
                strong = [k for k, c in enumerate(exact) if not _WEAK.match(c)]
                reduced = "".join([exact[k] for k in strong])
            bare = _WEAK.sub("", full)
            found = reduced.find(bare, bisect.bisect_left(strong, cursor)) if bare and strong else -1
            if found < 0:
                return _clamped(_proportional(cues, len(exact), of, start, end), end)
            first, last = strong[found], strong[found + len(bare) - 1]
        s = max(floor, min(start + of(first)[0], end))
        spans.append((s, max(s, min(start + of(last)[1], end))))
        floor, cursor = s, max(cursor, last + 1)
    return _clamped(spans, end)


def _proportional(cues: list[tuple[int, int, str]], n: int, of, start: int, end: int) -> list[tuple[int, int]]:
    sizes = [len(_matchable(c[2], False)) or len(_matchable(c[2], True)) for c in cues]
    total = sum(sizes)
    if not total:
        return [c[:2] for c in cues]
    spans, done, floor = [], 0, start
    for size in sizes:
        if not size:
            spans.append((floor, floor))
            continue
        a = max(0, min(done * n // total, n - 1))
        b = max(a + 1, min(-(-(done + size) * n // total), n))
        s = max(floor, min(start + of(a)[0], end))
        spans.append((s, max(s, min(start + of(b - 1)[1], end))))
        done, floor = done + size, s
    return spans


def _clamped(spans: list[tuple[int, int]], end: int) -> list[tuple[int, int]]:
    """Cues of 80 ms and gaps of 20 ms where there is room; the last one reaches the segment's end."""
    out, pushed = [], None
    for k, (s, e) in enumerate(spans):
        s = s if pushed is None else pushed
        after = spans[k + 1][0] if k + 1 < len(spans) else None
        limit = end if after is None else max(s, after - MIN_GAP_US)
        e = max(s, min(max(e, s + MIN_CUE_US), limit))
        pushed = min(end, e + MIN_GAP_US) if after is not None and after < e + MIN_GAP_US else None
        out.append((s, max(s, end) if after is None else e))
    return out


@F.arrow_udf(ArrayType(StructType([StructField("start_us", LongType()), StructField("end_us", LongType())])))
def _fitted(cs: pa.Array, ce: pa.Array, ct: pa.Array, bs: pa.Array, be: pa.Array, bt: pa.Array, ws: pa.Array, wd: pa.Array, d: pa.Array) -> pa.Array:
    """`retimed` for rows of lists, which Arrow turns into Python lists and back as whole columns."""
    spans, sizes = [], [0]
    for cue, spoken, p, q, r in zip(zip(*(x.to_pylist() for x in (cs, ce, ct))), zip(*(x.to_pylist() for x in (bs, be, bt))), *(x.to_pylist() for x in (ws, wd, d))):
        spans += retimed(list(zip(*cue)), [] if spoken[0] is None else list(zip(*spoken)), p, q, r)
        sizes.append(len(spans))
    fields = [pa.array([s[k] for s in spans], pa.int64()) for k in (0, 1)]
    return pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.StructArray.from_arrays(fields, ["start_us", "end_us"]))


def retime_cues(cues: DataFrame, windows: DataFrame, boundaries: DataFrame) -> DataFrame:
    """Retime cues(video_id, segment_id, pos, start_us, end_us, text) by spoken
    boundaries(video_id, segment_id, idx, part, start_us, end_us) inside
    windows(video_id, segment_id, start_us, deadline_us, duration_us). One nested row per segment."""
    key = ["video_id", "segment_id"]
    nested = cues.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("pos", "start_us", "end_us", "text"))).alias("c"))
    spoken = boundaries.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("idx", "start_us", "end_us", "part"))).alias("b"))
    rows = nested.join(windows.select(*key, F.col("start_us").alias("ws"), "deadline_us", "duration_us"), key).join(spoken, key, "left")
    lists = [F.col(f"{x}.{f}") for x, fields in (("c", ("start_us", "end_us", "text")), ("b", ("start_us", "end_us", "part"))) for f in fields]
    timed = rows.withColumn("t", _fitted(*lists, "ws", "deadline_us", "duration_us"))
    return timed.select(*key, F.explode(F.arrays_zip("c", "t")).alias("z")).select(*key, "z.c.pos", "z.t.start_us", "z.t.end_us", "z.c.text")
