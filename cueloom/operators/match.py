"""Matching subtitle files to videos: keys exploded per file and an equi-join, never a theta join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cueloom.functions import text as T
from cueloom.sources.subtitles import parsed_cues


def match_subtitles(videos: DataFrame, files: DataFrame) -> DataFrame:
    """Candidates of videos(dir, stem) among files(dir, filename, ext, …): exact base, stem and tags in
    any case, or the same lesson key; the first kind that holds. Content isn't needed."""
    base = T.subtitle_base(F.col("filename"))
    rows = files.withColumn("base", base)
    cut = F.filter(F.sequence(F.lit(1), F.length("base")), lambda i: F.substr(F.col("base"), i, F.lit(1)).rlike(r"[._-]") & (i > 1))
    prefixes = F.transform(cut, lambda i: F.concat(F.lit("p:"), F.lower(F.substr(F.col("base"), F.lit(1), i - 1))))
    keys = F.array_distinct(F.concat(F.array(F.concat(F.lit("p:"), F.lower("base")), F.concat(F.lit("k:"), T.normalize_lesson_key(F.col("base"))), F.concat(F.lit("k:"), T.normalize_lesson_key(T.strip_lang_tag(F.col("base"))))), prefixes))
    keyed = rows.withColumn("key", F.explode(keys))
    wanted = videos.select("dir", "stem").distinct().withColumn("key", F.explode(F.array(F.concat(F.lit("p:"), F.lower("stem")), F.concat(F.lit("k:"), T.normalize_lesson_key(F.col("stem"))))))
    pairs = wanted.join(keyed, ["dir", "key"]).drop("key").dropDuplicates(["dir", "stem", "filename"])
    tags = F.substr(F.col("base"), F.length("stem") + 1)
    pattern = (F.lower(F.substr(F.col("base"), F.lit(1), F.length("stem"))) == F.lower("stem")) & tags.rlike(r"^(?:[._-][a-zA-Z0-9-]+)+$")
    lesson = T.normalize_lesson_key(F.col("stem"))
    fuzzy = (T.normalize_lesson_key(F.col("base")) == lesson) | (T.normalize_lesson_key(T.strip_lang_tag(F.col("base"))) == lesson)
    kind = F.when(F.col("base") == F.col("stem"), "exact").when(pattern, "pattern").when(fuzzy, "fuzzy")
    distance = F.abs(T.u16len(F.col("base")) - T.u16len(F.col("stem"))).cast("long")
    return pairs.withColumn("match_kind", kind).filter("match_kind IS NOT NULL").withColumn("name_distance", distance)


# Lines of SRT and VTT files that aren't text, and how many others may be sampled.
NO_TEXT = r"^$|^\d+$|^\d{2}:\d{2}:\d{2}[.,]\d{3}\s*-->|^\d{2}:\d{2}\.\d{3}\s*-->"
HEADINGS, SAMPLED = r"(?i)^(WEBVTT|NOTE|STYLE|REGION)(?![A-Za-z0-9_])", 24


def sample_lines(files: DataFrame) -> DataFrame:
    """Rows (dir, filename, ext, lines): what may be sampled, the first lines of text of SRT and VTT files
    and the texts of all cues of ASS and SSA files."""
    scripted = F.coalesce(F.col("ext").isin(".ass", ".ssa"), F.lit(False))
    trimmed = F.transform(F.split("content", r"\r?\n"), T.trim_ws)
    plain = F.slice(F.filter(trimmed, lambda x: ~(x.rlike(NO_TEXT) | x.rlike(HEADINGS))), 1, SAMPLED)
    cues = F.transform(parsed_cues("content", "ext"), lambda c: c["text"])
    kept = ["dir", "filename", "ext"]
    return files.filter(~scripted).select(*kept, plain.alias("lines")).unionByName(files.filter(scripted).select(*kept, cues.alias("lines")))


def sample_of(lines: Column) -> Column:
    """A sample of a list of lines: first, middle and last line of three buckets, then the others in order up to
    16 lines; blank or letterless lines don't count; at most 8 parts, ending with the one that reaches 320 characters."""
    n = F.size(lines)
    size = F.greatest(F.lit(1), F.ceil(n / 3)).cast("int")

    def turn(i: Column) -> Column:
        bucket = F.floor(i / size).cast("int")
        start = bucket * size
        end = F.least(n, start + size).cast("int")
        spot = F.when(i == start, 0).when(i - start == F.floor((end - start) / 2), 1).when(i == end - 1, 2)
        return F.when((bucket < 3) & spot.isNotNull(), bucket * 3 + spot).otherwise(9)

    ordered = F.sort_array(F.transform(lines, lambda line, i: F.struct(turn(i).alias("turn"), i.alias("i"), line.alias("line"))))
    kept = F.filter(ordered, lambda x, r: (x["turn"] < 9) | (r < 16))
    parts = F.filter(F.transform(kept, lambda x: T.sanitize_sample(x["line"])), lambda part: part.rlike("[A-Za-z]|" + T.CJK))
    first = F.struct(F.lit(0).alias("n"), F.lit("").alias("text"))
    joined = lambda a, p: F.concat(a["text"], F.when(a["text"] == "", "").otherwise(" "), p)
    grown = lambda a, p: F.when(a["n"] < 320, F.struct((a["n"] + T.u16len(p)).cast("int").alias("n"), joined(a, p).alias("text"))).otherwise(a)
    return F.coalesce(F.aggregate(F.slice(parts, 1, 8), first, grown, lambda a: a["text"]), F.lit(""))


def score_files(files: DataFrame) -> DataFrame:
    """(dir, filename, ext, sample, language_score, language_confidence) of files; without lines the scores are 0. Narrow."""
    samples = sample_lines(files).select("dir", "filename", "ext", sample_of(F.col("lines")).alias("sample"))
    counted = samples.withColumns({f"_{k}": n for k, n in T.language_counts(F.col("sample")).items()})
    counts = {k: F.col(f"_{k}") for k in T.language_counts(F.lit(""))}
    return counted.select(*samples.columns, T.english_score(counts).alias("language_score"), T.english_confidence(counts).alias("language_confidence"))


def lone_pairs(videos: DataFrame, files: DataFrame) -> DataFrame:
    """Candidates of kind `lone`: the only video of a directory and its only file, whatever their names."""
    one_video = videos.select("dir", "stem").distinct().groupBy("dir").agg(F.count(F.lit(1)).alias("v"), F.min("stem").alias("stem")).filter("v = 1").select("dir", "stem")
    one_file = files.groupBy("dir").agg(F.count(F.lit(1)).alias("f"), F.min(F.struct("filename", "ext")).alias("s")).filter("f = 1").select("dir", "s.*")
    return one_video.join(one_file, "dir").withColumn("base", T.subtitle_base(F.col("filename"))).withColumn("match_kind", F.lit("lone")).withColumn("name_distance", F.lit(None).cast("long"))


def pick_subtitle(candidates: DataFrame) -> DataFrame:
    """The best candidate of every (dir, stem); one of kind `lone` only if there is no other and its file is
    confidently English."""
    ext = F.when(F.col("ext") == ".vtt", 3).when(F.col("ext") == ".srt", 2).when(F.col("ext").isin(".ass", ".ssa"), 1).otherwise(0)
    kind = F.when(F.col("match_kind") == "exact", 4).when(F.col("match_kind") == "pattern", 3).otherwise(2)
    tagged = lambda f: f(F.col("base")).cast("int")
    lone = F.col("match_kind") == "lone"
    order = [lone.asc(), F.desc("language_score"), F.desc("language_confidence"), tagged(T.english_tag).desc(), tagged(T.chinese_tag).asc(), ext.desc(), kind.desc(), F.asc("name_distance"), F.lower("filename"), F.asc("filename")]
    able = candidates.filter(~lone | T.is_confident_english(F.col("language_score"), F.col("language_confidence")))
    return able.withColumn("r", F.row_number().over(Window.partitionBy("dir", "stem").orderBy(*order))).filter("r = 1").drop("r")
