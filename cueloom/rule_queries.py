"""Registered queries of parsers, snapshots, text rules, votes and task logs, and the SQL that checks them.

Documents, snapshots and logs are written from the fixtures by Spark and read back by the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cueloom.functions import text as T
from cueloom.operators import audio as A
from cueloom.operators import cues as C
from cueloom.operators import tasks as K
from cueloom.operators import translate as X
from cueloom.plans.fixtures import table
from cueloom.queries import _GROUPS, _SEGMENTS, _segments, query
from cueloom.sources import subtitles as S

_PLAIN = S.AssStyle(background=False, wrap=0)


def _hd(cues: DataFrame) -> DataFrame:
    return cues.select("video_id").distinct().select("video_id", F.lit(1280).alias("width"), F.lit(720).alias("height"))


@query(["cues"], "SELECT video_id, cue_id, pos, start_us, end_us, text FROM cues")
def parse_srt(spark, sf_dir):
    """SRT documents of all cues, read back."""
    docs = S.render_srt(table(spark, sf_dir, "cues")).select("video_id", F.lit(".srt").alias("ext"), F.col("srt").alias("content"))
    return S.parse_files(docs).drop("raw_style")


@query(["cues"], "SELECT video_id, cue_id, pos, start_us, end_us, text, 'Text' AS raw_style FROM cues")
def parse_ass(spark, sf_dir):
    """ASS documents of all cues, read back."""
    cues = table(spark, sf_dir, "cues")
    docs = S.render_ass(cues, _hd(cues), _PLAIN).select("video_id", F.lit(".ass").alias("ext"), F.col("ass").alias("content"))
    return S.parse_files(docs)


@query(
    ["cues"],
    """k AS (SELECT *, pos % 6 AS kind, start_us // 1000 AS a, end_us // 1000 AS b FROM cues WHERE video_id % 4 = 0),
s AS (SELECT *, CASE kind WHEN 1 THEN a // 60000 * 60000000 + a // 1000 % 60 * 1000000 + a % 10 * 1000 ELSE a * 1000 END AS s_us FROM k WHERE kind <> 5)
SELECT video_id, CAST(row_number() OVER (PARTITION BY video_id ORDER BY pos) - 1 AS BIGINT) AS cue_id, CAST(s_us AS BIGINT) AS start_us, b * 1000 AS end_us,
  CASE kind WHEN 2 THEN text || chr(10) || 'second <> line' WHEN 3 THEN 'a' || chr(8232) || text ELSE text END AS text FROM s""",
)
def parse_odd_srt(spark, sf_dir):
    """Documents with named cues, notes, settings behind the times, tags, one to three digits of milliseconds and one of
    minutes, line separators inside of texts, and a sixth of time lines that aren't any."""
    cues = table(spark, sf_dir, "cues").filter("video_id % 4 = 0")
    kind, a, b = F.col("pos") % 6, F.expr("start_us div 1000"), F.expr("end_us div 1000")
    minutes = lambda ms, digits: F.format_string(f"%d:%02d,%0{digits}d", F.floor(ms / 60000), F.floor(ms / 1000) % 60, ms % (10**digits))
    full = lambda ms: F.format_string("%d:%d:%02d.%03d", F.floor(ms / 3600000), F.floor(ms / 60000) % 60, F.floor(ms / 1000) % 60, ms % 1000)
    times = F.concat(F.when(kind == 1, minutes(a, 1)).otherwise(full(a)), F.when(kind == 5, " -> ").otherwise(" --> "), full(b), F.when(kind == 4, " align:start").otherwise(""))
    before = F.when(kind == 0, F.concat(F.lit("cue-"), F.col("pos").cast("string"), F.lit("\r\n"))).when(kind == 2, "NOTE x\n\n12\n").otherwise("")
    text = F.when(kind == 2, F.concat("text", F.lit("\nsecond <> <i class='x'>line</i>"))).when(kind == 3, F.concat(F.lit(" <b>a</b> "), "text")).otherwise(F.col("text"))
    block = F.concat(before, times, F.lit("\r\n"), text, F.lit("\n\n"))
    docs = cues.groupBy("video_id").agg(F.sort_array(F.collect_list(F.struct("pos", block.alias("b")))).alias("c"))
    docs = docs.select("video_id", F.lit(".vtt").alias("ext"), F.concat(F.lit("﻿WEBVTT\n\n"), F.array_join("c.b", "")).alias("content"))
    return S.parse_files(docs).select("video_id", "cue_id", "start_us", "end_us", "text")


@query(
    ["cues"],
    """k AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY pos) - 1 AS id FROM cues WHERE video_id % 4 = 1 AND pos % 7 <> 3)
SELECT video_id, CAST(id AS BIGINT) AS cue_id, CASE WHEN pos % 7 = 2 THEN 0 ELSE start_us // 10000 * 10000 END AS start_us, end_us // 10000 * 10000 AS end_us,
  CASE pos % 7 WHEN 1 THEN 'x, y ' || text WHEN 5 THEN 'a' || chr(8232) || text ELSE text END AS text, CASE WHEN pos % 7 = 4 THEN '' ELSE 'Main' END AS raw_style FROM k WHERE video_id % 8 = 1""",
)
def parse_odd_ass(spark, sf_dir):
    """Documents with fields in another order, overrides, line breaks of both kinds, commas and separators in texts, empty
    styles, stamps that aren't any, and sections behind; half of the videos have no Format line."""
    cues = table(spark, sf_dir, "cues").filter("video_id % 4 = 1")
    kind = F.col("pos") % 7
    stamp = F.when(kind == 2, F.concat(T.ass_time(F.col("start_us")), F.lit("0"))).otherwise(T.ass_time(F.floor(F.col("start_us") / 10_000) * 10_000))
    text = F.when(kind == 1, F.concat(F.lit("x, {\\b1}y\\N"), "text")).when(kind == 3, "{\\i1}").when(kind == 5, F.concat(F.lit("a "), "text")).otherwise(F.col("text"))
    line = F.concat(F.lit("dialogue: "), T.ass_time(F.floor(F.col("end_us") / 10_000) * 10_000), F.lit(","), F.when(kind == 4, " ").otherwise(" Main "), F.lit(", "), stamp, F.lit(" ,"), text, F.lit("\r\n"))
    docs = cues.groupBy("video_id").agg(F.sort_array(F.collect_list(F.struct("pos", line.alias("b")))).alias("c"))
    head = F.concat(F.lit("﻿[Script Info]\nDialogue: 1,2,3,no\n[EVENTS]\n"), F.when(F.col("video_id") % 8 == 1, "Format: End, Style, Start, Text\n").otherwise(""))
    docs = docs.select("video_id", F.lit(".ssa").alias("ext"), F.concat(head, F.array_join("c.b", ""), F.lit("[Fonts]\nDialogue: 0:00:01.00,M,0:00:00.00,no\n")).alias("content"))
    return S.parse_files(docs).select("video_id", "cue_id", "start_us", "end_us", "text", "raw_style")


@query(["cues"], "SELECT video_id, cue_id, CASE WHEN cue_id % 7 IN (1, 6) THEN start_us // 10000 * 10000 ELSE 0 END AS start_us FROM cues")
def parse_ass_time(spark, sf_dir):
    """Whole stamps, some in white space, and stamps with a letter, a line end, another separator, or one or three digits."""
    stamp, kind = T.ass_time(F.floor(F.col("start_us") / 10_000) * 10_000), F.col("cue_id") % 7
    stamp = F.when(kind == 0, F.concat(stamp, F.lit("x"))).when(kind == 1, F.concat(F.lit(" "), stamp, F.lit(" "))).when(kind == 2, F.expr("'0:00:01.5'")).when(kind == 3, F.lit("0:00:01:50")).when(kind == 4, F.lit("0:00:01.500")).when(kind == 5, F.concat(stamp, F.lit("\n1"))).otherwise(stamp)
    return table(spark, sf_dir, "cues").select("video_id", "cue_id", S.parse_ass_time(stamp).alias("start_us"))


def _wrapped_sql(text: str) -> str:
    """SQL of soft_wrap at 20: the cut nearest to the middle, the first of two."""
    cuts = f"list_filter(range(1, length({text}) + 1), lambda i: regexp_matches(substring({text}, i, 1), '[，、；：，;:,\\s]'))"
    return f"""w1 AS (SELECT *, length({text}) // 2 AS mid, {cuts} AS cuts FROM cues),
w2 AS (SELECT *, CASE WHEN len(cuts) > 0 THEN list_sort(list_transform(cuts, lambda i: abs(i - mid) * 1000000 + i))[1] % 1000000 ELSE mid END AS cut FROM w1),
w3 AS (SELECT *, rtrim(substring({text}, 1, cut)) AS l, ltrim(substring({text}, cut + 1)) AS r FROM w2),
wrapped AS (SELECT *, CASE WHEN length({text}) <= 20 OR l = '' OR r = '' THEN {text} ELSE l || chr(10) || r END AS lines FROM w3)"""


_ASS_TIME = "printf('%d:%02d:%02d.%02d', {0} // 3600000000, {0} // 60000000 % 60, {0} // 1000000 % 60, {0} // 10000 % 100)"


@query(
    ["cues"],
    _wrapped_sql("text") + f" SELECT video_id, cue_id, lines AS wrapped, {_ASS_TIME.format('start_us')} AS ass_start, printf('%02d:%02d:%02d.%03d', start_us // 3600000000, start_us // 60000000 % 60, start_us // 1000000 % 60, start_us // 1000 % 1000) AS shown FROM wrapped",
)
def soft_wrap(spark, sf_dir):
    return table(spark, sf_dir, "cues").select("video_id", "cue_id", T.soft_wrap(F.col("text"), 20).alias("wrapped"), T.ass_time(F.col("start_us")).alias("ass_start"), T.display_time(F.col("start_us")).alias("shown"))


_HEAD = rf"""[Script Info]
ScriptType: v4.00+
PlayResX: 1280
PlayResY: 720
ScaledBorderAndShadow: yes
WrapStyle: 2

[V4+ Styles]
Format: {S._ASS_STYLES}
Style: Bg,Arial,28,&HFF000000,&HFF000000,&H00000000,&H4D000000,0,0,0,0,100,100,0,0,3,4,0,2,80,80,48,1
Style: Text,Arial,28,&H003BD4F3,&H003BD4F3,&H00000000,&H00000000,0,0,0,0,100,100,0,0,1,0,0,2,80,80,48,1

[Events]
Format: {S._ASS_EVENTS}
"""


@query(
    ["cues"],
    _wrapped_sql("text")
    + f""",
tx AS (SELECT video_id, pos, {_ASS_TIME.format('start_us')} || ',' || {_ASS_TIME.format('end_us')} AS span, replace(lines, chr(10), '\\N') AS t FROM wrapped)
SELECT video_id, '{_HEAD}' || string_agg('Dialogue: 0,' || span || ',Bg,,0,0,0,,' || t || chr(10) || 'Dialogue: 1,' || span || ',Text,,0,0,0,,' || t, chr(10) ORDER BY pos) || chr(10) AS ass FROM tx GROUP BY 1""",
)
def render_ass(spark, sf_dir):
    cues = table(spark, sf_dir, "cues")
    return S.render_ass(cues, _hd(cues))


@query(["cues"], "SELECT video_id, cue_id, '&H' || printf('%02X', CAST(floor((100 - cue_id % 101) / 100 * 255 + 0.5) AS INT)) || CASE WHEN cue_id % 4 = 0 THEN 'FFFFFF' ELSE printf('%02X', CAST(cue_id % 7 * 9 AS INT)) || '3412' END AS color FROM cues")
def ass_color(spark, sf_dir):
    rgb = F.when(F.col("cue_id") % 4 == 0, "#12345").otherwise(F.concat(F.lit(" #1234"), F.format_string("%02X", F.col("cue_id") % 7 * 9)))
    return table(spark, sf_dir, "cues").select("video_id", "cue_id", T.ass_color(rgb, F.col("cue_id") % 101).alias("color"))


@query(
    ["task_events"],
    """f1 AS (SELECT task_id, max(seq) AS seq, arg_max(progress, seq) AS progress, arg_max(status, seq) AS status FROM task_events GROUP BY 1)
SELECT 't' || task_id AS id, CASE WHEN task_id % 3 = 0 THEN 's' END AS subtitle, status, CAST(progress AS DOUBLE) AS progress, CASE WHEN task_id % 2 = 0 THEN 'd' END AS detail, CAST(CASE WHEN task_id % 4 = 0 THEN 1 END AS INT) AS n_issues, CASE WHEN task_id % 4 = 0 THEN seq END AS issue FROM f1
WHERE task_id % 11 <> 0 AND task_id % 13 <> 0 AND task_id % 17 <> 0 AND task_id % 19 <> 0 AND task_id % 23 <> 0""",
)
def task_snapshots(spark, sf_dir):
    """Snapshots of the tasks' last states, some with an empty id, no subtitle field, an unknown status, a
    progress in quotes or another version."""
    state = table(spark, sf_dir, "task_events").groupBy("task_id").agg(F.max("seq").alias("seq"), F.max_by("progress", "seq").alias("progress"), F.max_by("status", "seq").alias("status"))
    odd = lambda n: F.col("task_id") % n == 0
    issue = F.concat(F.lit('[{"id":'), F.col("seq").cast("string"), F.lit(',"text":"a"},{"id":"x","text":"b"},{"id":2}]'))
    fields = [
        F.concat(F.lit('"id":"'), F.when(odd(11), "").otherwise(F.concat(F.lit("t"), F.col("task_id").cast("string"))), F.lit('"')),
        F.lit('"videoPath":"p","videoName":"n"'),
        F.when(~odd(13), F.when(odd(3), '"subtitlePath":"s"').otherwise('"subtitlePath":null')),
        F.concat(F.lit('"status":"'), F.when(odd(17), "odd").otherwise(F.col("status")), F.lit('"')),
        F.concat(F.lit('"progress":'), F.when(odd(19), '"5"').otherwise(F.col("progress").cast("string"))),
        F.when(odd(2), '"detail":"d"').otherwise('"detail":""'),
        F.concat(F.lit('"translationIssues":'), F.when(odd(4), issue).otherwise("[]")),
    ]
    json = F.concat(F.lit('{"version":'), F.when(odd(23), "2").otherwise("1"), F.lit(',"tasks":[{'), F.concat_ws(",", *fields), F.lit("}]}"))
    tasks = S.read_task_snapshots(state.select(json.alias("json")))
    return tasks.select("id", F.col("subtitlePath").alias("subtitle"), "status", "progress", "detail", F.when(F.col("translationIssues").isNotNull(), F.size("translationIssues")).alias("n_issues"), F.col("translationIssues")[0]["id"].alias("issue"))


@query(
    ["cues"],
    "SELECT video_id, lang, pos, cue_id, start_us, end_us, text FROM cues, (VALUES ('en'), ('zh')) AS l(lang) WHERE video_id % 3 > 0 AND (lang = 'en' OR video_id % 2 = 0)",
)
def cue_snapshots(spark, sf_dir):
    """Snapshots of versions 0 to 2 with English cues, and Chinese ones for every other video."""
    cue = F.struct(F.col("pos"), F.col("cue_id").alias("id"), F.col("start_us").alias("startUs"), F.col("end_us").alias("endUs"), F.col("text"))
    rows = table(spark, sf_dir, "cues").groupBy("video_id").agg(F.sort_array(F.collect_list(cue)).alias("c"))
    whole = F.struct((F.col("video_id") % 3).alias("version"), F.col("c").alias("englishCues"), F.when(F.col("video_id") % 2 == 0, F.col("c")).alias("chineseCues"))
    return S.read_cue_snapshots(rows.select("video_id", F.to_json(whole).alias("json"))).drop("raw_style")


@query(
    ["segments"],
    """k AS (SELECT video_id, segment_id, window_us, segment_id % 4 AS turn, 640 + segment_id % 1281 AS w, 360 + segment_id % 721 AS h FROM segments),
d AS (SELECT *, CAST(CASE WHEN segment_id % 3 = 0 THEN floor(w * 16.0 / 11.0 + 0.5) ELSE w END AS INT) AS dw, turn % 2 = 1 AS swap FROM k)
SELECT video_id, segment_id, window_us AS duration_us, CASE WHEN segment_id % 5 > 0 THEN 'aac' END AS audio_codec, CAST(CASE WHEN segment_id % 5 > 0 THEN 48000 END AS INT) AS sample_rate, CAST(CASE WHEN segment_id % 5 > 0 THEN 2 END AS INT) AS channels,
CAST(w AS INT) AS width, CAST(h AS INT) AS height, CAST(CASE WHEN swap THEN h ELSE dw END AS INT) AS display_width, CAST(CASE WHEN swap THEN dw ELSE h END AS INT) AS display_height, CAST(turn * 90 AS INT) AS rotation FROM d""",
)
def probe_metadata(spark, sf_dir):
    """Probe reports with pixel aspects, turned by a tag or by side data."""
    i = F.col("segment_id")
    turned = F.when(i % 2 == 0, F.format_string('"tags":{"rotate":"%d"}', i % 4 * 90)).otherwise(F.format_string('"side_data_list":[{"x":1},{"rotation":%d}]', i % 4 * 90 - 360))
    video = F.concat(F.format_string('{"codec_type":"video","width":%d,"height":%d,"sample_aspect_ratio":"%s",', 640 + i % 1281, 360 + i % 721, F.when(i % 3 == 0, "16:11").otherwise("0:1")), turned, F.lit("}"))
    audio = F.when(i % 5 > 0, '{"codec_type":"audio","codec_name":"aac","sample_rate":"48000","channels":2}')
    json = F.concat(F.lit('{"format":{"duration":"'), (F.col("window_us") / 1_000_000).cast("string"), F.lit('"},"streams":['), F.concat_ws(",", video, audio), F.lit("]}"))
    return S.read_probe_metadata(table(spark, sf_dir, "segments").select("video_id", "segment_id", json.alias("json")))


@query(
    ["takes"],
    """SELECT video_id, segment_id, attempt_no, CAST(0 AS INT) AS idx, 'a' AS part, CAST(500 AS BIGINT) AS start_us, duration_us // 1000 * 1000 + 250 AS end_us FROM takes WHERE attempt_no % 4 <> 1 AND segment_id % 9 > 0
UNION ALL SELECT video_id, segment_id, attempt_no, 4, 'd', 0, 7 FROM takes WHERE segment_id % 9 > 0""",
)
def word_boundaries(spark, sf_dir):
    """Boundaries with fractional times; blank ones, ones whose part is a number, without times, or whose times are
    texts; lists with a null and lists that are objects."""
    first = F.when(F.col("attempt_no") % 4 == 1, " ").otherwise("a")
    json = F.format_string('[{"part":"%s","start":0.5,"end":%d.25},{"part":5,"start":1,"end":9},{"part":"c","start":"x"},{"start":0,"end":"9"},{"part":"d","start":"0","end":0.007},7]', first, F.expr("duration_us div 1000"))
    broken = F.when(F.col("segment_id") % 2 == 0, '[{"part":"a","start":0,"end":1},null]').otherwise('{"part":"a","start":0,"end":1}')
    json = F.when(F.col("segment_id") % 9 == 0, broken).otherwise(json)
    return S.read_boundaries(table(spark, sf_dir, "takes").select("video_id", "segment_id", "attempt_no", json.alias("json")))


_ALIAS_SQL = """n2 AS (SELECT doc_id AS ord, source || ' &  ' || upper(lang) || '   Sans (Bold) & ' || lang || ' sans' AS name FROM documents),
a2 AS (SELECT ord, generate_subscripts(string_split(name, '&'), 1) AS k, unnest(string_split(name, '&')) AS part FROM n2),
b2 AS (SELECT ord, k, trim(regexp_replace(regexp_replace(part, '\\s*\\([^)]*\\)\\s*$', ''), '\\s+', ' ', 'g')) AS alias FROM a2)
SELECT arg_min(alias, ord * 10 + k) AS alias FROM b2 WHERE alias <> '' GROUP BY lower(alias)"""


@query([], "WITH " + _ALIAS_SQL)
def font_aliases(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return S.explode_aliases(docs.select(F.col("doc_id").alias("ord"), F.concat("source", F.lit(" &  "), F.upper("lang"), F.lit("   Sans (Bold) & "), "lang", F.lit(" sans")).alias("name")))


@query(
    ["attempts"],
    r"""r AS (SELECT *, '[' || segment_id || '] ' || substring(raw, 1, 40) || ' (x) {' || src || '}  end' AS noisy, CASE WHEN segment_id % 3 = 0 THEN '... !' WHEN segment_id % 3 = 1 THEN src ELSE raw END AS said FROM attempts)
SELECT video_id, segment_id, attempt_no, regexp_matches(said, '[\p{L}\p{N}]') AS speakable, trim(said) <> '' AND trim(src) <> trim(said) AND (NOT regexp_matches(src, '[㐀-鿿]') OR regexp_matches(said, '[㐀-鿿]')) AS rewrites,
  trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(noisy, '\[[^\]]*\]', ' ', 'g'), '\([^)]*\)', ' ', 'g'), '\{[^}]*\}', ' ', 'g'), '\s+', ' ', 'g')) AS sample, segment_id % 30 >= 18 AND segment_id % 20 >= 12 AS confident FROM r""",
)
def text_rules(spark, sf_dir):
    rows = table(spark, sf_dir, "attempts")
    said = F.when(F.col("segment_id") % 3 == 0, "... !").when(F.col("segment_id") % 3 == 1, F.col("src")).otherwise(F.col("raw"))
    noisy = F.concat(F.lit("["), F.col("segment_id").cast("string"), F.lit("] "), F.substring("raw", 1, 40), F.lit(" (x) {"), "src", F.lit("}  end"))
    return rows.select("video_id", "segment_id", "attempt_no", T.has_speakable_content(said).alias("speakable"), T.should_apply_spoken_rewrite(F.col("src"), said).alias("rewrites"), T.sanitize_sample(noisy).alias("sample"), T.is_confident_english(F.col("segment_id") % 20, F.col("segment_id") % 30).alias("confident"))


_MESSAGES = ["connect ETIMEDOUT 1.2.3.4", "getaddrinfo ENOTFOUND host", "socket hang up", "LLM API 401: no", "LLM API 403", "LLM API 429", "LLM API 503", "bad gateway", "未选择 TTS 声音", "未填写 LLM 模型", "未选择输出目录", "subtitle broken", "spawn ffprobe ENOENT", "ffprobe exited", "ffmpeg exited", "AbortError", "", "AggregateError", "odd", "TTS websocket closed: fetch failed", "Error", "error: odd"]


def _errors_sql() -> str:
    listed = ", ".join(f"'{m}'" for m in _MESSAGES)
    return rf"""e1 AS (SELECT task_id, seq, status, [{listed}][CAST(seq % {len(_MESSAGES)} AS INT) + 1] AS said, detail FROM task_events),
e2 AS (SELECT *, CASE WHEN said IN ('Error', 'AggregateError') THEN '' ELSE said END AS message, lower(CASE WHEN said IN ('Error', 'AggregateError') THEN '' ELSE said END) AS m, coalesce(TRY_CAST(regexp_extract(lower(said), 'llm api\s+(\d{{3}})', 1) AS INT), 0) AS code FROM e1),
e3 AS (SELECT *, CASE WHEN status = 'translating' OR regexp_matches(m, 'llm|translation|chat/completions') THEN 'translation' WHEN status = 'synthesizing' OR regexp_matches(m, 'tts|speech\.platform\.bing\.com|readaloud|websocket') THEN 'synthesis'
 WHEN status = 'assembling' THEN 'audio assembly' WHEN status = 'encoding' THEN 'video packaging' WHEN status = 'parsing' OR regexp_matches(m, 'subtitle|srt|ass|vtt') THEN 'subtitle parsing' WHEN regexp_matches(m, 'ffprobe') THEN 'video analysis' WHEN regexp_matches(m, 'ffmpeg') THEN 'video processing' ELSE 'processing' END AS a FROM e2),
e4 AS (SELECT *, CASE WHEN m LIKE '%etimedout%' OR m LIKE '%timed out%' THEN 1 WHEN m LIKE '%enotfound%' OR m LIKE '%getaddrinfo%' THEN 2 WHEN m LIKE '%fetch failed%' OR m LIKE '%socket hang up%' THEN 3
 WHEN code = 401 THEN 4 WHEN code = 403 THEN 5 WHEN code = 429 THEN 6 WHEN code >= 500 OR m LIKE '%bad gateway%' THEN 7 WHEN m LIKE '%未选择 tts 声音%' THEN 8 WHEN m LIKE '%未填写 llm 模型%' THEN 9 WHEN m LIKE '%未选择输出目录%' THEN 10
 WHEN m LIKE '%subtitle%' THEN 11 WHEN m LIKE '%ffprobe%' AND m LIKE '%enoent%' THEN 12 WHEN m LIKE '%ffprobe%' THEN 13 WHEN m LIKE '%ffmpeg%' THEN 14 WHEN m LIKE '%abort%' THEN 15 WHEN m = '' THEN 16 ELSE 17 END AS k FROM e3)
SELECT task_id, seq,
  CASE k WHEN 4 THEN 'translation' WHEN 5 THEN 'translation' WHEN 6 THEN 'translation' WHEN 7 THEN CASE WHEN a = 'synthesis' THEN a ELSE 'translation' END WHEN 8 THEN 'synthesis' WHEN 9 THEN 'translation' WHEN 10 THEN 'video packaging' WHEN 11 THEN 'subtitle parsing'
    WHEN 12 THEN 'video processing' WHEN 13 THEN 'video analysis' WHEN 14 THEN CASE WHEN a = 'video packaging' THEN a ELSE 'video processing' END ELSE a END AS area,
  CASE WHEN k = 17 THEN message ELSE ['timeout', 'no connection', 'no connection', 'bad key', 'refused', 'too many requests', 'service down', 'no voice', 'not configured', 'no output folder', 'bad subtitle', 'tool missing', 'analysis failed', 'processing failed', 'timeout', 'failed'][k] END AS reason,
  CASE WHEN k = 1 AND a IN ('translation', 'synthesis') THEN 'check network' WHEN k < 17 THEN ['try again later', 'check network or DNS', 'check network or proxy', 'check configuration', 'check rights or network', 'try again later', 'try again later', 'choose a voice', 'complete the configuration', 'set an output folder', 'check the subtitle''s format', 'install the tool', 'check the video or the tool', 'check the video or the tool', 'try again later', 'see the log'][k] END AS action,
  status || ' | ' || detail AS detail FROM e4"""


@query(["task_events"], _errors_sql())
def classify_errors(spark, sf_dir):
    events = table(spark, sf_dir, "task_events")
    message = F.element_at(F.array(*[F.lit(m) for m in _MESSAGES]), (F.col("seq") % len(_MESSAGES) + 1).cast("int"))
    return events.select("task_id", "seq", T.classify_error(F.col("status"), message).alias("c"), T.error_detail(F.array("status", "detail", "status")).alias("detail")).select("task_id", "seq", "c.*", "detail")


_CHUNKS = """c2 AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY pos) - 1 AS p, count(*) OVER (PARTITION BY video_id) AS n FROM cues),
kk AS (SELECT unnest(range(0, 100000)) AS chunk_no),
ck AS (SELECT video_id, CAST(chunk_no AS INT) AS chunk_no, pos, cue_id, start_us, end_us, text FROM c2 JOIN kk ON chunk_no >= greatest(0, ceil((p - 39) / 36)) AND chunk_no <= least(p // 36, CASE WHEN n <= 40 THEN 0 ELSE ceil((n - 40) / 36) END))"""


def _answers(cues: DataFrame) -> DataFrame:
    """Answers to chunks: cues in threes by pos; some videos' chunks lack their first group or an answer."""
    rows = C.chunk_cues(cues).groupBy("video_id", "chunk_no", (F.col("pos") / 3).cast("long").alias("third")).agg(F.sort_array(F.collect_list("cue_id")).alias("ids"))
    groups = rows.groupBy("video_id", "chunk_no").agg(F.sort_array(F.collect_list(F.struct("third", "ids"))).alias("g"))
    kind = (F.col("video_id") + F.col("chunk_no")) % 4
    whole = F.transform("g", lambda g: g["ids"])
    return groups.filter(kind != 3).select("video_id", "chunk_no", F.when(kind == 2, F.slice(whole, 2, 1000)).otherwise(whole).alias("groups"))


@query(["cues"], _CHUNKS + " SELECT video_id, chunk_no, (video_id + chunk_no) % 4 < 2 AS valid FROM ck GROUP BY 1, 2")
def validate_chunk_groups(spark, sf_dir):
    cues = table(spark, sf_dir, "cues")
    return C.validate_chunk_groups(_answers(cues), C.chunk_cues(cues)).select("video_id", "chunk_no", "valid")


_BY_CHUNK = (
    _GROUPS.replace("o AS (", "oc AS (").replace("g AS (", "gc AS (").replace("FROM cues", "FROM (SELECT video_id * 100000 + chunk_no AS video_id, pos, cue_id, start_us, end_us, text FROM ck WHERE (video_id + chunk_no) % 4 >= 2)")
    .replace("FROM o ", "FROM oc ").replace("FROM g JOIN o ON o.video_id = g.video_id AND o.i = g.i + 1", "FROM gc g JOIN oc o ON o.video_id = g.video_id AND o.i = g.i + 1")
)


@query(
    ["cues"],
    _CHUNKS + ",\n" + _BY_CHUNK + ",\n" + _GROUPS
    + """,
vt AS (SELECT video_id, chunk_no, pos, cue_id, coalesce(pos // 3 <> lead(pos // 3) OVER (PARTITION BY video_id, chunk_no ORDER BY pos), TRUE) AS e FROM ck WHERE (video_id + chunk_no) % 4 < 2
  UNION ALL SELECT video_id // 100000, video_id % 100000, pos, cue_id, coalesce(group_no <> lead(group_no) OVER (PARTITION BY video_id ORDER BY start_us, pos), TRUE) FROM gc),
hv AS (SELECT DISTINCT video_id FROM ck WHERE (video_id + chunk_no) % 4 < 2),
ag AS (SELECT video_id, pos, cue_id, min(CAST(e AS INT)) AS s FROM vt WHERE video_id IN (SELECT video_id FROM hv) GROUP BY 1, 2, 3)
SELECT video_id, pos, cue_id, CAST(coalesce(sum(s) OVER (PARTITION BY video_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS group_no FROM ag
UNION ALL SELECT video_id, pos, cue_id, group_no FROM g WHERE video_id NOT IN (SELECT video_id FROM hv)""",
    True,
)
def group_by_votes(spark, sf_dir):
    cues = table(spark, sf_dir, "cues")
    return C.group_by_votes(cues, _answers(cues))


@query(
    ["cues"],
    _GROUPS
    + r""",
pc AS (SELECT video_id, group_no, i, trim(text) AS t FROM g WHERE trim(text) <> ''),
gl AS (SELECT *, lag(t) OVER (PARTITION BY video_id, group_no ORDER BY i) AS b FROM pc)
SELECT video_id, group_no AS segment_id, string_agg(CASE WHEN regexp_matches(b, '[A-Za-z0-9_./#+-]$') AND regexp_matches(t, '^[A-Za-z0-9_./#+-]') THEN ' ' ELSE '' END || t, '' ORDER BY i) AS text FROM gl GROUP BY 1, 2""",
    True,
)
def segment_text_from_review(spark, sf_dir):
    return X.segment_text_from_review(table(spark, sf_dir, "cues"), _segments(spark, sf_dir))


@query(["cues"], _SEGMENTS + " SELECT g.video_id, g.cue_id FROM g WHERE g.group_no % 5 = 0", True)
def unmapped_cues(spark, sf_dir):
    return X.unmapped_cues(table(spark, sf_dir, "cues"), _segments(spark, sf_dir).filter("segment_id % 5 <> 0"))


_CONFIG = {"model": "m", "voice": "v", "strategy": "1"}
_WORDS = [(" the ", "这"), ("and", "与 "), ("x", "单")]


@query(
    ["cues"],
    """sg AS (SELECT video_id, '1:' || substring(sha256(string_agg(cue_id || chr(0) || start_us || chr(0) || end_us || chr(0) || text, chr(10) ORDER BY pos) || chr(10)), 1, 16) AS signature FROM cues GROUP BY 1)
SELECT video_id, '{"model":"m","strategy":"1","voice":"v","glossary":[{"en":"the","zh":"这"},{"en":"and","zh":"与"},{"en":"x","zh":"单"}],"grouping":"' || CASE WHEN video_id % 3 = 0 THEN 'naive' ELSE signature END || '"}' AS signature FROM sg""",
)
def translation_signature(spark, sf_dir):
    known = X.grouping_signature(table(spark, sf_dir, "cues")).withColumn("signature", F.when(F.col("video_id") % 3 != 0, F.col("signature")))
    return X.translation_signature(known, _CONFIG, _WORDS)


@query(["task_events"], "SELECT task_id, seq, least(1.0, progress * 1000000 / 80000000) AS ratio, CAST(floor(88 + 7 * least(1.0, progress * 1000000 / 80000000) + 0.5) AS BIGINT) AS percent FROM task_events WHERE seq % 3 > 0")
def encoding_progress(spark, sf_dir):
    line = F.concat(F.when(F.col("seq") % 3 > 0, "out_time_us=").otherwise("frame="), (F.col("progress") * 1_000_000).cast("string"))
    return K.encoding_progress(table(spark, sf_dir, "task_events").select("task_id", "seq", line.alias("line"), F.lit(80_000_000).alias("duration_us"))).drop("line", "duration_us")


@query(["takes"], "SELECT video_id, segment_id, attempt_no, CAST(floor((duration_us // 1000) / 48000 * 1000000 + 0.5) AS BIGINT) AS us FROM takes")
def pcm_duration(spark, sf_dir):
    pcm = F.expr("unhex(repeat('0010', CAST(duration_us div 1000 AS INT)))")
    return table(spark, sf_dir, "takes").select("video_id", "segment_id", "attempt_no", A.pcm_duration_us(pcm).alias("us"))


@query(["attempts"], "SELECT video_id, segment_id, attempt_no, CASE WHEN segment_id % 4 <> 3 THEN length(raw) END AS json FROM (SELECT video_id, segment_id, attempt_no, raw FROM attempts) t")
def run_batches(spark, sf_dir):
    """A function over requests that raises for every fourth one."""

    def measure(batches):
        for rows in batches:
            if any(k % 4 == 3 for k in rows["segment_id"]):
                raise ValueError("no answer")
            yield rows.assign(json=[None if t is None else len(t) for t in rows["raw"]])

    requests = table(spark, sf_dir, "attempts").select("video_id", "segment_id", "attempt_no", "raw")
    return X.run_batches(requests, measure, "video_id long, segment_id long, attempt_no long, json long", tries=2)


@query(
    ["task_events"],
    """th AS (SELECT task_id, seq, progress / 100 AS ratio, row_number() OVER (PARTITION BY task_id ORDER BY seq) AS i FROM task_events),
st AS (SELECT task_id, seq, ratio, i, ratio AS last, TRUE AS go FROM th WHERE i = 1
  UNION ALL SELECT th.task_id, th.seq, th.ratio, th.i, CASE WHEN th.ratio - st.last >= 0.05 THEN th.ratio ELSE st.last END, th.ratio - st.last >= 0.05 FROM st JOIN th ON th.task_id = st.task_id AND th.i = st.i + 1)
SELECT task_id, seq, ratio FROM st WHERE go""",
    True,
)
def throttle_progress(spark, sf_dir):
    return K.throttle_progress(table(spark, sf_dir, "task_events").withColumn("ratio", F.col("progress") / 100), 0.05)


def _log(spark, sf_dir) -> DataFrame:
    """The events as a task log of all kinds."""
    kind = F.element_at(F.array(*[F.lit(k) for k in K.LOG_KINDS]), (F.col("seq") * 7 % 13 % 6 + 1).cast("int"))
    issue = F.struct(F.col("seq").alias("id"), F.lit("t").alias("text"), F.lit(9).alias("max_chars"))
    status = F.when(F.col("seq") % 5 == 0, "reviewing").otherwise(F.col("status"))
    issues = F.when(F.col("seq") % 2 == 0, F.array(issue)).otherwise(F.array().cast("array<struct<id:long,text:string,max_chars:int>>"))
    rows = table(spark, sf_dir, "task_events")
    return rows.select("task_id", "seq", kind.alias("kind"), status.alias("status"), "progress", F.lit("broken").alias("text"), "detail", issues.alias("issues"), (F.col("seq") % 60).alias("countdown"), F.concat(F.lit("s"), F.col("seq").cast("string")).alias("path"))


@query(
    ["task_events"],
    """lg AS (SELECT task_id, seq, ['status', 'error', 'issues', 'countdown', 'subtitle', 'replace'][CAST(seq * 7 % 13 % 6 + 1 AS INT)] AS kind, CASE WHEN seq % 5 = 0 THEN 'reviewing' ELSE status END AS status, progress, detail FROM task_events),
pt AS (SELECT task_id, max(seq) AS seq, max(seq) FILTER (kind IN ('status', 'error', 'replace')) AS m, max(seq) FILTER (kind IN ('error', 'replace') OR kind = 'status' AND status <> 'error') AS e,
  max(seq) FILTER (kind IN ('issues', 'replace')) AS i, max(seq) FILTER (kind IN ('countdown', 'error', 'replace') OR kind = 'status' AND status <> 'reviewing') AS c, max(seq) FILTER (kind IN ('subtitle', 'replace')) AS p FROM lg GROUP BY 1)
SELECT pt.task_id, pt.seq, CASE m.kind WHEN 'error' THEN 'error' WHEN 'replace' THEN 'waiting' ELSE m.status END AS status, CASE m.kind WHEN 'status' THEN m.progress WHEN 'error' THEN 0 WHEN 'replace' THEN 0 END AS progress, CASE m.kind WHEN 'status' THEN m.detail END AS detail,
  CASE e.kind WHEN 'error' THEN 'broken' END AS error, CASE e.kind WHEN 'error' THEN e.detail END AS error_detail, CASE i.kind WHEN 'issues' THEN CASE WHEN i.seq % 2 = 0 THEN i.seq END END AS issue, CASE c.kind WHEN 'countdown' THEN c.seq % 60 END AS countdown, 's' || p.seq AS subtitle_path
FROM pt LEFT JOIN lg m ON m.seq = pt.m LEFT JOIN lg e ON e.seq = pt.e LEFT JOIN lg i ON i.seq = pt.i LEFT JOIN lg c ON c.seq = pt.c LEFT JOIN lg p ON p.seq = pt.p""",
)
def fold_task_log(spark, sf_dir):
    return K.fold_task_log(_log(spark, sf_dir)).withColumn("issue", F.col("issues")[0]["id"]).drop("issues")


@query(
    [],
    """WITH v AS (SELECT doc_id AS ord, 'src' || doc_id % 20 AS root, CASE WHEN doc_id % 20 > 0 AND doc_id % 2 = 1 THEN 'lesson ' ELSE 'Lesson ' END || lang AS stem, CASE WHEN doc_id % 3 = 0 THEN '.mkv' ELSE '.mp4' END AS ext FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY root, lower(stem) ORDER BY ord) + CASE WHEN root = 'src0' THEN 1 ELSE 0 END AS k FROM v),
m AS (SELECT *, stem || CASE WHEN k > 1 THEN ' (' || k || ')' ELSE '' END AS name FROM r)
SELECT ord, name, root || '/' || name || ext AS video_path, root || '/' || name || '.srt' AS subtitle_path FROM m""",
)
def output_names(spark, sf_dir):
    """Names by language; in src0 the subtitles of every first name exist."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    home = F.concat(F.lit("src"), (F.col("doc_id") % 20).cast("string"))
    word = F.when((F.col("doc_id") % 20 > 0) & (F.col("doc_id") % 2 == 1), "lesson ").otherwise("Lesson ")
    videos = docs.select(F.col("doc_id").alias("ord"), home.alias("root"), F.concat(word, "lang").alias("stem"), F.when(F.col("doc_id") % 3 == 0, ".mkv").otherwise(".mp4").alias("ext"))
    there = videos.filter("root = 'src0'").select("root", F.concat("stem", F.lit(".srt")).alias("name")).distinct()
    return K.output_names(videos, there).select("ord", "name", "video_path", "subtitle_path")
