"""Subtitle files, snapshots and caches as tables, and cue tables as SRT and ASS documents."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from cueloom.functions import text as T
from cueloom.sources.keyed import KeyedTable

CUES = ArrayType(StructType([StructField("cue_id", LongType()), StructField("start_us", LongType()), StructField("end_us", LongType()), StructField("text", StringType()), StructField("raw_style", StringType())]))
# Time lines of SRT and VTT, stamps of ASS, what is removed from texts, and white space of JavaScript.
_TIMES = re.compile(r"^((?:\d{1,}:)?\d{1,2}:\d{1,2}[,.]\d{1,3}) --> ((?:\d{1,}:)?\d{1,2}:\d{1,2}[,.]\d{1,3})(?: (.*))?\Z", re.A)
_ASS_STAMP = r"^(\d+):(\d{2}):(\d{2})\.(\d{2})"
_BLANKS = "\t\n\x0b\x0c\r \xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
# Task states and the fields of snapshots.
STATUSES = "waiting queued parsing translating reviewing synthesizing assembling encoding completed error paused".split()


def read_subtitle_files(spark: SparkSession, path: str) -> DataFrame:
    """(dir, filename, ext, content) of the .srt, .vtt, .ass and .ssa files under path, in any letter case."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.{[sS][rR][tT],[vV][tT][tT],[aA][sS][sS],[sS][sS][aA]}").text(path, wholetext=True)
    full = F.url_decode(F.regexp_replace(F.col("_metadata.file_path"), r"\+", "%2B"))
    rows = files.select(full.alias("p"), F.col("value").alias("content"))
    return rows.select(F.regexp_extract("p", r"([^/]*)/[^/]*$", 1).alias("dir"), F.substring_index("p", "/", -1).alias("filename"), F.lower(F.regexp_extract("p", r"(\.[^.]*)$", 1)).alias("ext"), "content")


def _srt_us(stamp: str) -> int:
    """Microseconds of a stamp; the digits after the comma are a number of milliseconds, however many there are."""
    whole, ms = re.split("[,.]", stamp)
    parts = [0, *map(int, whole.split(":"))][-3:]
    return ((parts[0] * 60 + parts[1]) * 60 + parts[2]) * 1_000_000 + int(ms) * 1000


def parse_srt_text(content: str | None) -> list[dict]:
    """Cues of an SRT or VTT document: text runs from a time line to a blank line. What comes before a time line,
    such as numbers, names of cues and notes, is no text. Tags go, but for an empty <>."""
    out: list[dict] = []
    lines = re.split(r"\r?\n", (content or "").removeprefix("\ufeff"))
    k = 0
    while k < len(lines):
        m = _TIMES.match(lines[k])
        k += 1
        if not m:
            continue
        body = []
        while k < len(lines) and lines[k].strip(_BLANKS):
            body.append(lines[k])
            k += 1
        text = re.sub(r"<[^>]+>", "", "\n".join(body)).strip(_BLANKS)
        out.append({"cue_id": len(out), "start_us": _srt_us(m[1]), "end_us": _srt_us(m[2]), "text": text, "raw_style": None})
    return out


def _ass_us(stamp: str) -> int:
    m = re.match(_ASS_STAMP + r"\Z", stamp, re.A)
    return ((int(m[1]) * 60 + int(m[2])) * 60 + int(m[3])) * 1_000_000 + int(m[4]) * 10_000 if m else 0


def parse_ass_text(content: str | None) -> list[dict]:
    """Dialogue of an ASS or SSA document's [Events], by its Format line; without one nothing is read. Sorted by
    start, ids by file order."""
    inside, fields, out = False, [], []
    for line in re.split(r"\r?\n", content or ""):
        line = line.strip(_BLANKS)
        kind = line.lower()
        if line.startswith("[") and line.endswith("]"):
            inside = kind == "[events]"
        elif inside and kind.startswith("format:"):
            fields = [f.strip(_BLANKS).lower() for f in line[7:].split(",")]
        elif inside and kind.startswith("dialogue:") and {"start", "end", "text"} <= set(fields):
            values = line[9:].split(",", len(fields) - 1)
            value = lambda name: values[k].strip(_BLANKS) if name in fields and (k := fields.index(name)) < len(values) else None  # noqa: B023, E731
            text = re.sub(r"\\[Nn]", " ", re.sub(r"\{[^}]*\}", "", value("text") or "")).strip(_BLANKS)
            if text:
                out.append({"cue_id": len(out), "start_us": _ass_us(value("start") or ""), "end_us": _ass_us(value("end") or ""), "text": text, "raw_style": value("style")})
    return sorted(out, key=lambda c: c["start_us"])


@F.pandas_udf(CUES)
def parsed_cues(contents: pd.Series, exts: pd.Series) -> pd.Series:
    """Cues of subtitle documents by their extensions."""
    return pd.Series([parse_ass_text(c) if e in (".ass", ".ssa") else parse_srt_text(c) for c, e in zip(contents, exts)])


def parse_files(files: DataFrame) -> DataFrame:
    """One row per cue of files(…, ext, content): the files' other columns, pos and the cue. A malformed
    file yields none; see rejected_files."""
    keep = [c for c in files.columns if c not in ("content", "ext")]
    cues = files.withColumn("c", parsed_cues("content", "ext")).select(*keep, F.posexplode("c").alias("pos", "c"))
    return cues.select(*keep, F.col("c.cue_id").alias("cue_id"), F.col("pos").cast("long").alias("pos"), "c.start_us", "c.end_us", "c.text", "c.raw_style")


def rejected_files(files: DataFrame) -> DataFrame:
    return files.filter(F.size(parsed_cues("content", "ext")) == 0).select("dir", "filename", "ext")


def parse_ass_time(c: Column) -> Column:
    """Microseconds of h:mm:ss.cc, with white space around it; 0 for anything else."""
    stamp = T.trim_ws(c)
    part = lambda k: F.regexp_extract(stamp, _ASS_STAMP + r"\z", k).try_cast("long")
    return F.coalesce((part(1) * 3600 + part(2) * 60 + part(3)) * 1_000_000 + part(4) * 10_000, F.lit(0))


def render_srt(cues: DataFrame) -> DataFrame:
    """(video_id, srt): the cues of a video in order of pos."""
    number = F.struct("pos", T.srt_time(F.col("start_us")).alias("a"), T.srt_time(F.col("end_us")).alias("b"), "text")
    docs = cues.groupBy("video_id").agg(F.sort_array(F.collect_list(number)).alias("c"))
    block = lambda c, i: F.concat((i + 1).cast("string"), F.lit("\n"), c["a"], F.lit(" --> "), c["b"], F.lit("\n"), c["text"], F.lit("\n"))
    return docs.select("video_id", F.array_join(F.transform("c", block), "\n").alias("srt"))


@dataclass(frozen=True)
class AssStyle:
    """How subtitles look; sizes are for a height of 1080 and a width of 1920, opacity is in percent."""

    # The style of a new configuration.
    font: str = "Arial"
    size: int = 42
    bold: bool = False
    italic: bool = False
    text_color: str = "#F3D43B"
    outline: bool = False
    outline_width: int = 3
    outline_color: str = "#000000"
    background: bool = True
    background_color: str = "#000000"
    background_opacity: int = 70
    background_padding: int = 6
    top: bool = False
    margin: int = 72
    wrap: int = 20


_ASS_STYLES = "Name, Fontname, Fontsize, PrimaryColour, SecondaryColour, OutlineColour, BackColour, Bold, Italic, Underline, StrikeOut, ScaleX, ScaleY, Spacing, Angle, BorderStyle, Outline, Shadow, Alignment, MarginL, MarginR, MarginV, Encoding"
_ASS_EVENTS = "Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text"


def _ass_heads(videos: DataFrame, style: AssStyle) -> DataFrame:
    """(video_id, head): all of a document but its events."""
    size = lambda c, default: F.when(F.col(c) > 0, T.js_round(F.col(c)).cast("long")).otherwise(F.lit(default))
    sizes = videos.select("video_id", size("width", 1920).alias("w"), size("height", 1080).alias("h"))
    high = lambda n, least: F.greatest(F.lit(least), T.js_round(F.lit(n) * F.col("h") / 1080)).cast("long")
    font = F.lit(style.font.strip().replace(",", " ") or "Arial")
    px, outline = high(style.size, 20), high(style.outline_width, 0) if style.outline else F.lit(0)
    side, below = F.greatest(F.lit(24), T.js_round(F.lit(120) * F.col("w") / 1920)).cast("long"), high(style.margin, 24)
    shadow = F.greatest(F.lit(2), T.js_round(px * 0.08)).cast("long") if style.outline and style.background else F.lit(0)
    text_color, clear, black = T.ass_color(F.lit(style.text_color)), F.lit("&HFF000000"), F.lit("&H00000000")
    face = [F.lit(-1 if style.bold else 0), F.lit(-1 if style.italic else 0), F.lit("0,0,100,100,0,0")]
    place = [F.lit(8 if style.top else 2), side, side, below, F.lit(1)]
    row = lambda name, *values: F.concat(F.lit("Style: "), F.concat_ws(",", F.lit(name), font, *[v.cast("string") for v in (px, *values, *place)]))
    text = row("Text", text_color, text_color, T.ass_color(F.lit(style.outline_color)), black, *face, F.lit(1), outline, shadow)
    box = row("Bg", clear, clear, black, T.ass_color(F.lit(style.background_color), style.background_opacity), *face, F.lit(3), high(style.background_padding, 0) + outline, F.lit(0))
    head = F.concat_ws(
        "\n",
        F.lit("[Script Info]\nScriptType: v4.00+"),
        F.concat(F.lit("PlayResX: "), F.col("w").cast("string")),
        F.concat(F.lit("PlayResY: "), F.col("h").cast("string")),
        F.lit(f"ScaledBorderAndShadow: yes\nWrapStyle: 2\n\n[V4+ Styles]\nFormat: {_ASS_STYLES}"),
        *([box] if style.background else []),
        text,
        F.lit(f"\n[Events]\nFormat: {_ASS_EVENTS}"),
    )
    return sizes.select("video_id", head.alias("head"))


def _ass_lines(cues: DataFrame, style: AssStyle) -> DataFrame:
    """(video_id, pos, lines): the events of the cues that have a duration and a text."""
    shown = T.ass_escape(T.soft_wrap(F.col("text"), style.wrap) if style.wrap > 0 else F.col("text"))
    line = lambda layer, name: F.concat(F.lit(f"Dialogue: {layer},"), T.ass_time(F.col("start_us")), F.lit(","), T.ass_time(F.col("end_us")), F.lit(f",{name},,0,0,0,,"), shown)
    lines = F.concat(line(0, "Bg"), F.lit("\n"), line(1, "Text")) if style.background else line(0, "Text")
    return cues.filter((F.col("end_us") > F.col("start_us")) & (T.trim_ws(F.col("text")) != "")).select("video_id", "pos", lines.alias("lines"))


def render_ass(cues: DataFrame, videos: DataFrame, style: AssStyle = AssStyle()) -> DataFrame:
    """(video_id, ass) for cues, scaled to videos(video_id, width, height), 1920 by 1080 where unknown.

    With a background every cue is two lines, a box (Bg) under the text (Text). Cues without duration or
    text are dropped, a video without cues keeps its header. A `wrap` of 0 breaks no lines."""
    docs = _ass_lines(cues, style).groupBy("video_id").agg(F.sort_array(F.collect_list(F.struct("pos", "lines"))).alias("c"))
    events = F.coalesce(F.array_join(F.col("c.lines"), "\n"), F.lit(""))
    return _ass_heads(videos, style).join(docs, "video_id", "left").select("video_id", F.concat("head", F.lit("\n"), events, F.lit("\n")).alias("ass"))


def ass_rows(cues: DataFrame, videos: DataFrame, style: AssStyle = AssStyle()) -> DataFrame:
    """(video_id, pos, text): what `render_ass` gives, as rows in order of pos; the first of a video is its header.
    Cues of videos that aren't given are left out."""
    heads = _ass_heads(videos, style).select("video_id", F.lit(None).cast("long").alias("pos"), F.concat("head", F.lit("\n")).alias("text"))
    lines = _ass_lines(cues, style).select("video_id", "pos", F.concat("lines", F.lit("\n")).alias("text"))
    rows = heads.unionByName(lines.join(videos.select("video_id").distinct(), "video_id", "left_semi"))
    alone = F.count(F.lit(1)).over(Window.partitionBy("video_id")) == 1
    return rows.withColumn("text", F.when(alone, F.concat("text", F.lit("\n"))).otherwise(F.col("text")))


_ISSUES = "array<struct<id:long,text:string,max_chars:int>>"


def read_task_snapshots(snapshots: DataFrame, column: str = "json") -> DataFrame:
    """Tasks of version-1 snapshots: id, path and name must be texts that aren't empty, the subtitle a text
    or null, the status known and the progress a number; other entries are skipped. Fields of another type
    and empty details and errors count as absent, and so do lists without a whole issue."""
    each = snapshots.select(F.from_json(column, "version int, tasks array<string>").alias("s")).filter("s.version = 1")
    each = each.select(F.explode("s.tasks").alias("raw")).select("raw", F.try_parse_json("raw").alias("t"))
    kind = lambda v, path: F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    number = lambda v, path: F.when(kind(v, path).rlike("^(BIGINT|DOUBLE|DECIMAL)"), F.try_variant_get(v, path, "double"))
    string = lambda v, path: F.when(kind(v, path) == "STRING", F.try_variant_get(v, path, "string"))
    some = lambda path: F.when(string(F.col("t"), path) != "", string(F.col("t"), path))
    issues = F.filter(F.when(kind(F.col("t"), "$.translationIssues").startswith("ARRAY"), F.try_variant_get("t", "$.translationIssues", "array<variant>")), lambda i: number(i, "$.id").isNotNull() & string(i, "$.text").isNotNull())
    issue = lambda i: F.struct(number(i, "$.id").cast("long").alias("id"), string(i, "$.text").alias("text"), number(i, "$.max_chars").cast("int").alias("max_chars"))
    tasks = each.select(
        some("$.id").alias("id"),
        some("$.videoPath").alias("videoPath"),
        some("$.videoName").alias("videoName"),
        string(F.col("t"), "$.subtitlePath").alias("subtitlePath"),
        string(F.col("t"), "$.status").alias("status"),
        number(F.col("t"), "$.progress").alias("progress"),
        some("$.detail").alias("detail"),
        number(F.col("t"), "$.countdownRemaining").alias("countdownRemaining"),
        some("$.error").alias("error"),
        some("$.errorDetail").alias("errorDetail"),
        F.when(F.size(issues) > 0, F.transform(issues, issue)).alias("translationIssues"),
        (F.array_contains(F.json_object_keys("raw"), "subtitlePath") & kind(F.col("t"), "$.subtitlePath").isin("STRING", "VOID")).alias("_subtitle"),
    )
    return tasks.filter(F.col("id").isNotNull() & F.col("videoPath").isNotNull() & F.col("videoName").isNotNull() & F.col("_subtitle") & F.col("status").isin(STATUSES) & F.col("progress").isNotNull()).drop("_subtitle")


def read_cue_snapshots(snapshots: DataFrame, column: str = "json") -> DataFrame:
    """Cues of version 1 and 2 snapshots, tagged en or zh; other columns of snapshots are kept."""
    cue = "array<struct<id:long,startUs:long,endUs:long,text:string,rawStyle:string>>"
    keep = [c for c in snapshots.columns if c != column]
    parsed = snapshots.select(*keep, F.from_json(column, f"version int, englishCues {cue}, chineseCues {cue}").alias("s")).filter("s.version IN (1, 2)")
    side = lambda lang, field: parsed.select(*keep, F.lit(lang).alias("lang"), F.posexplode(f"s.{field}").alias("pos", "c"))
    rows = side("en", "englishCues").unionByName(side("zh", "chineseCues"))
    rows = rows.select(*keep, "lang", F.col("pos").cast("long").alias("pos"), F.col("c.id").alias("cue_id"), F.col("c.startUs").alias("start_us"), F.col("c.endUs").alias("end_us"), F.col("c.text").alias("text"), F.col("c.rawStyle").alias("raw_style"))
    return rows.filter("cue_id IS NOT NULL AND start_us IS NOT NULL AND end_us IS NOT NULL AND text IS NOT NULL")


def read_probe_metadata(probes: DataFrame, column: str = "json") -> DataFrame:
    """Duration, streams and display size: pixel aspect first, then the rotation's swap."""
    stream = "struct<codec_type:string,codec_name:string,sample_rate:string,channels:int,width:int,height:int,sample_aspect_ratio:string,tags:struct<rotate:string>,side_data_list:array<struct<rotation:double>>>"
    keep = [c for c in probes.columns if c != column]
    rows = probes.select(*keep, F.from_json(column, f"format struct<duration:string>, streams array<{stream}>").alias("p"))
    first = lambda kind: F.get(F.filter("p.streams", lambda s: s["codec_type"] == kind), F.lit(0))
    rows = rows.withColumn("a", first("audio")).withColumn("v", first("video"))
    ratio = F.split(F.col("v.sample_aspect_ratio"), ":")
    num, den = F.get(ratio, F.lit(0)).try_cast("double"), F.get(ratio, F.lit(1)).try_cast("double")
    width = F.when((num > 0) & (den > 0), T.js_round(F.col("v.width") * num / den)).otherwise(F.col("v.width")).cast("int")
    side = F.get(F.filter("v.side_data_list", lambda s: s["rotation"].isNotNull()), F.lit(0))["rotation"]
    turned = F.coalesce(F.col("v.tags.rotate").try_cast("double"), side, F.lit(0.0))
    rotation = F.pmod(T.js_round(turned / 90) * 90, F.lit(360)).cast("int")
    swap = rotation.isin(90, 270)
    return rows.select(
        *keep,
        T.js_round(F.col("p.format.duration").try_cast("double") * 1_000_000).cast("long").alias("duration_us"),
        F.col("a.codec_name").alias("audio_codec"),
        F.col("a.sample_rate").try_cast("int").alias("sample_rate"),
        F.col("a.channels").alias("channels"),
        F.col("v.width").alias("width"),
        F.col("v.height").alias("height"),
        F.when(swap, F.col("v.height")).otherwise(width).alias("display_width"),
        F.when(swap, width).otherwise(F.col("v.height")).alias("display_height"),
        rotation.alias("rotation"),
    )


def read_boundaries(takes: DataFrame, column: str = "json") -> DataFrame:
    """Word boundaries with a text that isn't blank and a duration; parts that aren't texts count as '', times that
    aren't numbers as 0, and fractions of milliseconds as they are. A list that isn't one, or holds a null, has none."""
    keep = [c for c in takes.columns if c != column]
    kind = lambda v, path="$": F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    items = F.try_variant_get(F.try_parse_json(column), "$", "array<variant>")
    rows = takes.select(*keep, items.alias("_items")).filter(~F.exists("_items", lambda v: F.coalesce(kind(v), F.lit("VOID")) == "VOID")).select(*keep, F.posexplode("_items").alias("idx", "b"))
    b = F.col("b")
    us = lambda path: F.coalesce(F.when(kind(b, path).rlike("^(BIGINT|DOUBLE|DECIMAL)"), F.try_variant_get(b, path, "double")) * 1000, F.lit(0.0))
    part = F.coalesce(F.when(kind(b, "$.part") == "STRING", F.try_variant_get(b, "$.part", "string")), F.lit(""))
    rows = rows.select(*keep, "idx", part.alias("part"), us("$.start").alias("s"), us("$.end").alias("e")).filter((T.trim_ws(F.col("part")) != "") & (F.col("e") > F.col("s")))
    return rows.select(*keep, "idx", "part", T.js_round(F.col("s")).cast("long").alias("start_us"), T.js_round(F.col("e")).cast("long").alias("end_us"))


def _cache(spark: SparkSession, path: str, schema, version: str, signature: str, keys: list[str] | None) -> KeyedTable:
    return KeyedTable(spark, f"{path}/version={quote(version, '')}/signature={quote(signature, '')}", schema, keys or [])


def write_cache(df: DataFrame, path: str, version: str, signature: str) -> None:
    """Add df as entries of one version and signature; `read_cache` lets later entries replace earlier ones."""
    _cache(df.sparkSession, path, df.schema, version, signature, None).upsert(df)


def read_cache(spark: SparkSession, path: str, schema: str, version: str, signature: str, valid: Column | None = None, keys: list[str] | None = None, owners: DataFrame | None = None) -> DataFrame:
    """Entries of exactly this version and signature; no others are read.

    `valid` skips malformed entries. With `keys` the entry written last counts for each key, of those that aren't
    skipped. With owners(…, task_id), entries count only where the columns they share with owners agree: what
    another task wrote isn't read."""
    return _cache(spark, path, schema, version, signature, keys).read(valid, owners)


def compact_cache(spark: SparkSession, path: str, schema: str, version: str, signature: str, keys: list[str], valid: Column | None = None) -> None:
    """Let go of entries that later ones replace, or that aren't `valid`; readers at work still see theirs."""
    cache = _cache(spark, path, schema, version, signature, keys)
    cache.compact(valid)
    cache.vacuum()


def explode_aliases(fonts: DataFrame) -> DataFrame:
    """Names of fonts(ord, name) split at '&', without a trailing parenthesis, each once in any letter case."""
    rows = fonts.select("ord", F.posexplode(F.split("name", "&")).alias("k", "alias"))
    rows = rows.withColumn("alias", T.normalize_spaces(F.regexp_replace("alias", r"\s*\([^)]*\)\s*$", ""))).filter("alias <> ''")
    first = F.row_number().over(Window.partitionBy(F.lower("alias")).orderBy("ord", "k"))
    return rows.withColumn("r", first).filter("r = 1").select("alias").orderBy("alias")
