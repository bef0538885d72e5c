"""Text rules as Column expressions.

Lengths count UTF-16 units (`u16len`), white space is Unicode's (WS), word edges are ASCII; all
rounding is floor(x + 0.5).
"""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cueloom.functions import language
from cueloom.functions.language import COMMON, SDH  # noqa: F401  what the SQL looks for

# Character classes and word lists of the rules.
WS = r"[\s\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"
CJK = r"[\u3400-\u9FFF]"
EDGE, EDGE_END = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
EN_TAG = r"(?i)(?:^|[._-])(en|eng|en-us|en-gb|english)(?:$|[._-])"
ZH_TAG = r"(?i)(?:^|[._-])(zh|zho|chi|chs|cht|cn|zh-cn|zh-hans|zh-hant|chinese)(?:$|[._-])"
TECH = r"(?:[A-Z][A-Za-z0-9_]*|[A-Za-z]+(?:[./#_-][A-Za-z0-9_]+)+|[A-Za-z]+\d+)"


def js_round(x: Column) -> Column:
    return F.floor(x + 0.5)


def u16len(c: Column) -> Column:
    return (F.octet_length(F.encode(c, "UTF-16BE")) / 2).cast("int")


def count_of(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern))


def trim_ws(c: Column) -> Column:
    return F.regexp_replace(c, f"^{WS}+|{WS}+$", "")


def rtrim_ws(c: Column) -> Column:
    return F.regexp_replace(c, f"{WS}+$", "")


def normalize_spaces(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, f"{WS}+", " "), "^ | $", "")


def has_cjk(c: Column) -> Column:
    return c.rlike(CJK)


def looks_like_sentence(c: Column) -> Column:
    return (u16len(c) >= 20) | (c.rlike("[A-Za-z]{3,}") & (c.rlike(WS) | c.rlike(r"[,.!?;:。，？！；：]")))


def english_words(c: Column) -> Column:
    return count_of(c, "[A-Za-z]+(?:'[A-Za-z]+)?")


def visible_chars(c: Column) -> Column:
    return u16len(F.regexp_replace(c, f"{WS}+", ""))


@dataclass(frozen=True)
class Measured:
    """A text with its spaces normalised, and what the guards below ask of it."""

    text: Column
    visible: Column
    words: Column
    letters: Column
    cjk: Column
    sentence: Column

    @classmethod
    def of(cls, text: Column) -> Measured:
        """Measures of a normalised text."""
        return cls(text, visible_chars(text), english_words(text), count_of(text, "[A-Za-z]"), has_cjk(text), looks_like_sentence(text))


def with_measures(df: DataFrame, *columns: str) -> DataFrame:
    """df with the measures of text columns, each computed once in a projection of its own; see `measures`."""
    df = df.withColumns({f"_{c}_text": normalize_spaces(F.col(c)) for c in columns})
    found = {c: Measured.of(F.col(f"_{c}_text")) for c in columns}
    return df.withColumns({f"_{c}_{k.name}": getattr(m, k.name) for c, m in found.items() for k in fields(Measured) if k.name != "text"})


def measures(column: str) -> Measured:
    """The measures that `with_measures` added for a column."""
    return Measured(*[F.col(f"_{column}_{k.name}") for k in fields(Measured)])


def _measured(x: Column | Measured) -> Measured:
    return x if isinstance(x, Measured) else Measured.of(normalize_spaces(x))


def is_mostly_english(target: Column | Measured) -> Column:
    t = _measured(target)
    share = t.letters / F.greatest(t.visible, F.lit(1))
    return (t.visible > 0) & ~t.cjk & (((t.words >= 2) & (share >= 0.45)) | ((t.words >= 1) & (t.visible >= 20) & (share >= 0.6)))


def is_over_compressed(source: Column | Measured, target: Column | Measured, max_chars: Column | None = None) -> Column:
    src, dst = _measured(source), _measured(target)
    concerns = (src.text != "") & (dst.text != "") & src.sentence & dst.cjk
    copula = src.text.rlike(r"(?i)^(?:so\s+)?(?:this|that|it|there)\s+(?:is|was|are|were|means|refers\s+to)(?![A-Za-z0-9_])")
    article = src.text.rlike(r"(?i)^this\s+is\s+(?:the|a|an)(?![A-Za-z0-9_])")
    short = (src.words >= 4) & ((copula & (dst.visible <= 4)) | (article & (dst.visible <= 6)))
    if max_chars is not None:
        enough = (F.coalesce(max_chars, F.lit(0)) > 0) & (dst.visible >= F.greatest(F.lit(2), F.ceil(F.coalesce(max_chars, F.lit(0)) * 0.3)))
        short = short & ~enough
    return concerns & short


def is_untranslated(source: Column | Measured, target: Column | Measured) -> Column:
    src, dst = _measured(source), _measured(target)
    return (dst.text == "") | F.when(src.text == dst.text, ~src.cjk & src.sentence).otherwise(src.sentence & is_mostly_english(dst))


def is_acceptable_translation(source: Column | Measured, target: Column | Measured, max_chars: Column | None = None) -> Column:
    src, dst = _measured(source), _measured(target)
    return F.coalesce((dst.text != "") & ~is_untranslated(src, dst) & ~is_over_compressed(src, dst, max_chars), F.lit(False))


def is_acceptable_compression(source: Column | Measured, target: Column | Measured) -> Column:
    src, dst = _measured(source), _measured(target)
    return F.coalesce((dst.text != "") & (~src.cjk | dst.cjk | ~is_mostly_english(dst)), F.lit(False))


def is_untranslatable_source(source: Column | Measured) -> Column:
    src = _measured(source)
    return (src.text == "") | ~(src.text.rlike("[A-Za-z]{3,}") | src.cjk)


def has_speakable_content(c: Column) -> Column:
    return c.rlike(r"[\p{L}\p{N}]")


def should_apply_spoken_rewrite(original: Column, spoken: Column) -> Column:
    a, b = trim_ws(original), trim_ws(spoken)
    return (b != "") & (a != b) & (~has_cjk(a) | has_cjk(b))


def sanitize_sample(c: Column) -> Column:
    for pattern in (r"\[[^\]]*\]", r"\([^)]*\)", r"\{[^}]*\}"):
        c = F.regexp_replace(c, pattern, " ")
    return normalize_spaces(c)


def language_counts(c: Column) -> dict[str, Column]:
    """What `english_score` and `english_confidence` ask of a text; they take these counts as columns, too."""
    found = language.language_counts(c)
    return {k: found[k] for k in language.COUNTS}


def english_score(c: Column | dict[str, Column]) -> Column:
    n = c if isinstance(c, dict) else language_counts(c)
    letters = n["ascii"] + n["cjk"]
    of = F.greatest(letters, F.lit(1))
    score = js_round(n["ascii"] / of * 100) - js_round(n["cjk"] / of * 120)
    score += F.least(n["words"] * 2, F.lit(24)) + F.least(n["common"] * 4, F.lit(24)) - F.least(n["noise"] * 5, F.lit(20))
    score += F.when((n["ascii"] >= 18) & (n["cjk"] == 0), 20).otherwise(0) - F.when((n["cjk"] >= 12) & (n["ascii"] == 0), 20).otherwise(0)
    score -= F.when((n["ascii"] >= 10) & (n["cjk"] >= 10), 18).when((n["ascii"] >= 8) & (n["cjk"] >= 4), 10).otherwise(0)
    return F.when((letters == 0) & (n["words"] == 0), 0).otherwise(score).cast("long")


def english_confidence(c: Column | dict[str, Column]) -> Column:
    n = c if isinstance(c, dict) else language_counts(c)
    letters = n["ascii"] + n["cjk"]
    less = lambda x, cut: F.greatest(F.lit(0), x - cut)
    v = F.least(letters + n["words"] * 4, F.lit(100))
    v = less(v, F.when((n["ascii"] >= 10) & (n["cjk"] >= 10), 30).when((n["ascii"] >= 8) & (n["cjk"] >= 4), 18).otherwise(0))
    v = less(v, F.when(n["noise"] >= 2, 12).otherwise(0))
    v = less(v, F.when((n["words"] <= 1) & (n["common"] == 0), 10).otherwise(0))
    return F.when((letters == 0) & (n["words"] == 0), 0).otherwise(v).cast("long")


def is_confident_english(score: Column, confidence: Column) -> Column:
    return (confidence >= 18) & (score >= 12)


def replace_terms(zh: Column, terms: Column) -> Column:
    """Replace every literal occurrence of every term of `terms ARRAY<STRUCT<en, zh>>`, in order, in any letter case."""

    def swap(text: Column, t: Column) -> Column:
        literal = F.regexp_replace(trim_ws(t["en"]), r"([.*+?^${}()|\[\]\\])", r"\\$1")
        return F.regexp_replace(text, F.concat(F.lit("(?i)"), literal), F.regexp_replace(trim_ws(t["zh"]), r"([\\$])", r"\\$1"))

    return F.aggregate(terms, zh, swap)


def apply_terminology(en: Column, zh: Column, terms: Column) -> Column:
    """Replace, in order, every term of `terms ARRAY<STRUCT<en, zh>>` that the English text contains. Every text is
    tested for every term; see `apply_glossary` for many."""
    lower = F.lower(en)
    used = F.filter(terms, lambda t: (F.length(trim_ws(t["en"])) >= 2) & (trim_ws(t["zh"]) != "") & F.contains(lower, F.lower(trim_ws(t["en"]))))
    return replace_terms(zh, used)


def join_for_translation(pieces: Column) -> Column:
    last = F.size(pieces) - 1
    cut = F.transform(pieces, lambda t, i: F.when(i < last, rtrim_ws(F.regexp_replace(rtrim_ws(t), r"[,;:\-–—]+$", ""))).otherwise(rtrim_ws(t)))
    return normalize_spaces(F.array_join(F.filter(cut, lambda t: t != ""), " "))


def join_for_speech(pieces: Column) -> Column:
    word = r"[A-Za-z0-9_./#+-]"
    glue = lambda a, t: F.when(a.rlike(f"{word}$") & t.rlike(f"^{word}"), F.concat(a, F.lit(" "), t)).otherwise(F.concat(a, t))
    return F.aggregate(F.filter(F.transform(pieces, trim_ws), lambda t: t != ""), F.lit(""), glue)


def soft_wrap(text: Column, most: int) -> Column:
    """One line break after the soft punctuation or space nearest the middle, the first of two as near."""
    n = u16len(text)
    mid = F.floor(n / 2).cast("int")
    soft = rf"(?:[，、；：,;:]|{WS})"
    before = F.length(F.regexp_extract(F.substr(text, F.lit(1), mid), rf"(?s)^(.*{soft})", 1))  # the last cut up to the middle
    after = F.length(F.regexp_extract(F.substr(text, mid + 1), rf"(?s)^(.*?{soft})", 1))  # how far on the next one is
    at = F.when((before > 0) & ((after == 0) | (mid - before <= after)), before).when(after > 0, mid + after).otherwise(mid)
    left, right = rtrim_ws(F.substr(text, F.lit(1), at)), F.regexp_replace(F.substr(text, at + 1), f"^{WS}+", "")
    return F.when((n <= most) | (left == "") | (right == ""), text).otherwise(F.concat(left, F.lit("\n"), right))


def ass_escape(text: Column) -> Column:
    text = F.regexp_replace(text, r"\\", r"\\\\")
    return F.regexp_replace(F.regexp_replace(text, r"\r?\n", r"\\N"), r"([{}])", r"\\$1")


def ass_time(us: Column) -> Column:
    cs = js_round(F.greatest(us, F.lit(0)) / 10000).cast("long")
    return F.format_string("%d:%02d:%02d.%02d", F.floor(cs / 360000), F.floor(cs / 6000) % 60, F.floor(cs / 100) % 60, cs % 100)


def display_time(us: Column) -> Column:
    ms = F.floor(F.greatest(us, F.lit(0)) / 1000).cast("long")
    return F.format_string("%02d:%02d:%02d.%03d", F.floor(ms / 3600000), F.floor(ms / 60000) % 60, F.floor(ms / 1000) % 60, ms % 1000)


def srt_time(us: Column) -> Column:
    ms = js_round(us / 1000).cast("long")
    return F.format_string("%02d:%02d:%02d,%03d", F.floor(ms / 3600000), F.floor(ms / 60000) % 60, F.floor(ms / 1000) % 60, ms % 1000)


def ass_color(rgb: Column, percent: Column | float = 100) -> Column:
    """&HAABBGGRR of '#RRGGBB', white where that is malformed; the alpha byte is what `percent` leaves."""
    bare = F.regexp_replace(trim_ws(rgb), "^#", "")
    safe = F.when(bare.rlike("^[0-9a-fA-F]{6}$"), bare).otherwise("FFFFFF")
    opacity = percent if isinstance(percent, Column) else F.lit(percent)
    alpha = F.lpad(F.hex(js_round((100 - opacity) / 100 * 255).cast("long")), 2, "0")
    return F.concat(F.lit("&H"), alpha, F.substring(safe, 5, 2), F.substring(safe, 3, 2), F.substring(safe, 1, 2))


def error_detail(parts: Column) -> Column:
    lines = F.array_distinct(F.filter(F.transform(parts, lambda p: trim_ws(F.element_at(F.split(p, r"\r?\n"), 1))), lambda p: p != ""))
    text = F.array_join(lines, " | ")
    return F.when(F.length(text) > 500, F.concat(F.substring(text, 1, 497), F.lit("..."))).otherwise(text)


def error_area(status: Column, message: Column) -> Column:
    # What tells areas apart.
    m = F.lower(message)
    return (
        F.when((status == "translating") | m.rlike(r"llm|translation|chat/completions"), "translation")
        .when((status == "synthesizing") | m.rlike(r"tts|speech\.platform\.bing\.com|readaloud|websocket"), "synthesis")
        .when(status == "assembling", "audio assembly")
        .when(status == "encoding", "video packaging")
        .when((status == "parsing") | m.rlike("subtitle|srt|ass|vtt"), "subtitle parsing")
        .when(m.rlike("ffprobe"), "video analysis")
        .when(m.rlike("ffmpeg"), "video processing")
        .otherwise("processing")
    )


@dataclass(frozen=True)
class ErrorRule:
    """What a rule looks for in a lower-cased message, or an answer's code, and what it says."""

    pattern: str
    reason: str
    action: str
    area: str | None = None  # where the rule puts the error, whatever its own area
    unless: str | None = None  # an own area that stays
    codes: tuple[int, int] | None = None  # from, to
    service_action: str | None = None  # for services


# The rules in order.
ERROR_RULES = [
    ErrorRule("etimedout|timed out|超时", "timeout", "try again later", service_action="check network"),
    ErrorRule("enotfound|eai_again|getaddrinfo", "no connection", "check network or DNS"),
    ErrorRule("econnrefused|econnreset|network error|fetch failed|socket hang up|proxy", "no connection", "check network or proxy"),
    ErrorRule("invalid api key|unauthorized|authentication", "bad key", "check configuration", "translation", codes=(401, 401)),
    ErrorRule("forbidden", "refused", "check rights or network", "translation", codes=(403, 403)),
    ErrorRule("too many requests|rate limit", "too many requests", "try again later", "translation", codes=(429, 429)),
    ErrorRule("bad gateway|service unavailable|gateway timeout", "service down", "try again later", "translation", "synthesis", (500, 999)),
    ErrorRule("未选择 tts 声音", "no voice", "choose a voice", "synthesis"),
    ErrorRule(r"未填写?\s*llm\s*(?:base url|模型|api key)", "not configured", "complete the configuration", "translation"),
    ErrorRule("未选择输出目录", "no output folder", "set an output folder", "video packaging"),
    ErrorRule("subtitle|字幕.*解析", "bad subtitle", "check the subtitle's format", "subtitle parsing"),
    ErrorRule(r"^(?=.*(?:ffmpeg|ffprobe))(?=.*(?:enoent|not recognized|not found))", "tool missing", "install the tool", "video processing"),
    ErrorRule("ffprobe", "analysis failed", "check the video or the tool", "video analysis"),
    ErrorRule("ffmpeg", "processing failed", "check the video or the tool", "video processing", "video packaging"),
    ErrorRule("aborterror|aborted", "timeout", "try again later"),
    ErrorRule("^$", "failed", "see the log"),
]


def classify_error(status: Column, message: Column) -> Column:
    """STRUCT<area, reason, action>: the first rule that matches the status and message decides; without
    one the message is the reason and there is no action. A null message, and the bare names Error and
    AggregateError, count as no message."""
    message = F.when(message.rlike(r"(?i)^(aggregateerror|error)\z"), "").otherwise(F.coalesce(message, F.lit("")))
    m, area = F.lower(message), error_area(status, message)
    code = F.coalesce(F.regexp_extract(m, r"llm api\s+(\d{3})", 1).try_cast("int"), F.lit(0))
    result = lambda a, reason, action: F.struct(a.alias("area"), reason.alias("reason"), action.alias("action"))
    out = result(area, message, F.lit(None).cast("string"))
    for rule in reversed(ERROR_RULES):
        test = m.rlike(f"(?s){rule.pattern}") | (code.between(*rule.codes) if rule.codes else F.lit(False))
        where = area if rule.area is None else F.when(area == rule.unless, area).otherwise(rule.area) if rule.unless else F.lit(rule.area)
        action = F.when(area.isin("translation", "synthesis"), rule.service_action).otherwise(rule.action) if rule.service_action else F.lit(rule.action)
        out = F.when(test, result(where, F.lit(rule.reason), action)).otherwise(out)
    return out


def content_hash(*parts: Column) -> Column:
    joined = F.concat(*[x for p in parts for x in (F.chr(F.lit(0)), p.cast("string"))][1:])
    return F.substring(F.sha2(joined, 256), 1, 16)


def punct_insensitive_equal(a: Column, b: Column) -> Column:
    bare = lambda c: F.regexp_replace(c, rf"(?:{WS}|\p{{P}})+", "")
    return bare(a) == bare(b)


def normalize_lesson_key(c: Column) -> Column:
    return F.lower(trim_ws(F.regexp_replace(c, rf"^\d+\.{WS}*", "")))


def strip_lang_tag(c: Column) -> Column:
    return F.regexp_replace(c, r"(?i)[._-]([a-z]{2}(?:-[a-zA-Z0-9]{2,8})?)$", "")


def subtitle_base(c: Column) -> Column:
    return F.regexp_replace(c, r"(?i)\.(srt|vtt|ass|ssa)$", "")


def english_tag(base: Column) -> Column:
    return base.rlike(EN_TAG)


def chinese_tag(base: Column) -> Column:
    return base.rlike(ZH_TAG)


def tech_tokens(c: Column) -> Column:
    return count_of(c, f"{EDGE}{TECH}{EDGE_END}")
