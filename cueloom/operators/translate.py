"""Translation requests, attempts and their resolution, and the way back to cues."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cueloom.functions import text as T
from cueloom.operators.repartition import split_text_across_cues

# Batch sizes and tries.
BATCH, SPLIT_BATCH, BATCH_TRIES, SINGLE_TRIES = 15, 12, 3, 2
SEG = ["video_id", "segment_id"]


def grouping_signature(cues: DataFrame, version: str = "1") -> DataFrame:
    """(video_id, signature): version and 16 hex digits over every cue's id, times and text, in order."""
    line = F.concat_ws("\0", F.col("cue_id").cast("string"), F.col("start_us").cast("string"), F.col("end_us").cast("string"), "text")
    rows = cues.groupBy("video_id").agg(F.sort_array(F.collect_list(F.struct("pos", line.alias("l")))).alias("c"))
    whole = F.concat(F.array_join(F.transform("c", lambda c: c["l"]), "\n"), F.lit("\n"))
    return rows.select("video_id", F.concat(F.lit(f"{version}:"), F.substring(F.sha2(whole, 256), 1, 16)).alias("signature"))


def translation_signature(groupings: DataFrame, config: dict[str, str], glossary: list[tuple[str, str]]) -> DataFrame:
    """(video_id, signature): what a cached translation depends on, as JSON in a fixed order of fields."""
    terms = F.array(*[F.struct(F.lit(e.strip()).alias("en"), F.lit(z.strip()).alias("zh")) for e, z in glossary]) if glossary else F.array().cast("array<struct<en:string,zh:string>>")
    fields = [F.lit(config[k]).alias(k) for k in sorted(config)]
    return groupings.select("video_id", F.to_json(F.struct(*fields, terms.alias("glossary"), F.coalesce("signature", F.lit("naive")).alias("grouping"))).alias("signature"))


def pending_translations(segments: DataFrame, cache: DataFrame) -> DataFrame:
    """Segments whose cached text, cache(video_id, segment_id, text), is missing or not acceptable."""
    rows = segments.join(cache.select(*SEG, F.col("text").alias("cached")), SEG, "left")
    return rows.filter(~T.is_acceptable_translation(F.col("src"), F.col("cached"))).drop("cached")


def missing_translations(segments: DataFrame, translations: DataFrame) -> DataFrame:
    return segments.join(translations.filter(T.trim_ws(F.col("text")) != "").select(*SEG), SEG, "left_anti")


def unmapped_cues(cues: DataFrame, segments: DataFrame) -> DataFrame:
    """Cues that belong to no segment of their video."""
    held = segments.select("video_id", F.explode("cue_ids").alias("cue_id"))
    return cues.select("video_id", "cue_id").join(held, ["video_id", "cue_id"], "left_anti")


def request_batches(items: DataFrame, size: int = BATCH) -> DataFrame:
    """(video_id, batch_no, n_items, payload) of items(video_id, segment_id, text, max_chars)."""
    rank = F.row_number().over(Window.partitionBy("video_id").orderBy("segment_id")) - 1
    item = F.struct(F.col("segment_id").alias("id"), F.col("text"), F.when(F.col("max_chars") > 0, F.col("max_chars")).alias("max_chars"))
    rows = items.withColumn("batch_no", F.floor(rank / size).cast("long")).groupBy("video_id", "batch_no").agg(F.sort_array(F.collect_list(item)).alias("items"))
    return rows.select("video_id", "batch_no", F.size("items").cast("long").alias("n_items"), F.to_json(F.struct("items")).alias("payload"))


def parse_translation_responses(responses: DataFrame, items: DataFrame) -> DataFrame:
    """(video_id, segment_id, attempt_no, raw) of known ids with text; the last of repeated ids counts."""
    parsed = responses.select("video_id", "attempt_no", F.posexplode(F.from_json("json", "translations array<struct<id:long,text:string>>")["translations"]).alias("k", "t"))
    rows = parsed.select("video_id", "attempt_no", "k", F.col("t.id").alias("segment_id"), F.col("t.text").alias("raw")).filter("segment_id IS NOT NULL AND raw IS NOT NULL")
    rows = rows.join(items.select(*SEG), SEG, "left_semi")
    return rows.groupBy(*SEG, "attempt_no").agg(F.max_by("raw", "k").alias("raw"))


def resolve_attempts(items: DataFrame, attempts: DataFrame) -> DataFrame:
    """One text per item of items(video_id, segment_id, batch_no, src, max_chars) from
    attempts(video_id, segment_id, attempt_no, raw): tries 1-3 are of the whole batch, 4-5 of single items.

    The first try in which every item of the batch is acceptable decides; else the third try's
    acceptable items, then the first acceptable single; else the last non-empty raw or the source, as
    an issue."""
    rows = T.with_measures(items.join(attempts.select(*SEG, "attempt_no", "raw"), SEG, "left"), "src", "raw")
    src, raw = T.measures("src"), T.measures("raw")
    rows = rows.select(*items.columns, "attempt_no", raw.text.alias("clean"), T.is_acceptable_translation(src, raw, F.col("max_chars")).alias("ok"))
    batch = ["video_id", "batch_no"]
    size = items.groupBy(*batch).agg(F.count(F.lit(1)).alias("n"))
    tries = rows.filter(F.col("attempt_no") <= BATCH_TRIES).groupBy(*batch, "attempt_no").agg(F.count_if("ok").alias("good")).join(size, batch)
    whole = tries.filter("good = n").groupBy(*batch).agg(F.min("attempt_no").alias("whole"))
    rows = rows.join(whole, batch, "left")
    last_batch = F.coalesce("whole", F.lit(BATCH_TRIES))
    texts = rows.groupBy(*SEG, *batch[1:], "src", "whole").agg(
        F.max(F.when((F.col("attempt_no") == last_batch) & F.col("ok"), F.col("clean"))).alias("by_batch"),
        F.min_by("clean", F.when((F.col("attempt_no") > BATCH_TRIES) & F.col("ok"), F.col("attempt_no"))).alias("by_single"),
        F.min(F.when((F.col("attempt_no") > BATCH_TRIES) & F.col("ok"), F.col("attempt_no"))).alias("single"),
        F.max_by("clean", F.when(F.col("clean") != "", F.col("attempt_no"))).alias("last_raw"),
    )
    single = F.when(F.col("single").isNotNull(), F.col("by_single"))
    return texts.select(*SEG, F.coalesce("by_batch", single, "last_raw", T.normalize_spaces(F.col("src"))).alias("text"), (F.col("by_batch").isNull() & F.col("single").isNull()).alias("is_issue"))


def resolve_compression(items: DataFrame, attempts: DataFrame, tries: int = 3) -> DataFrame:
    """The first of three candidates that keeps the script of the text, else the text itself."""
    rows = T.with_measures(items.join(attempts.filter(F.col("attempt_no") <= tries).select(*SEG, "attempt_no", "raw"), SEG, "left"), "src", "raw")
    clean = T.measures("raw").text
    good = F.when(T.is_acceptable_compression(T.measures("src"), T.measures("raw")), F.col("attempt_no"))
    rows = rows.groupBy(*SEG, "src").agg(F.min_by(clean, good).alias("first"), F.min(good).alias("k"))
    return rows.select(*SEG, F.when(F.col("k").isNotNull(), F.col("first")).otherwise(F.col("src")).alias("text"))


def validate_split_responses(lines: DataFrame, items: DataFrame | None) -> DataFrame:
    """Of lines(video_id, segment_id, k, lines): the first split of each known item whose lines all have
    text and lose nothing but punctuation and spaces. Without items the lines come with their items' texts in a column
    `text`, and nothing is joined; their other columns are kept, of the row that is chosen."""
    rows = lines.withColumnRenamed("text", "whole") if items is None else lines.join(items.select(*SEG, F.col("text").alias("whole")), SEG)
    fine = F.forall("lines", lambda s: F.coalesce(T.trim_ws(s) != "", F.lit(False))) & (F.size("lines") > 0) & T.punct_insensitive_equal(F.array_join("lines", ""), F.col("whole"))
    kept = ["lines"] if items is not None else [c for c in rows.columns if c not in (*SEG, "k", "whole")]
    return rows.filter(fine).groupBy(*SEG).agg(F.min_by(F.struct(*kept), "k").alias("s")).select(*SEG, "s.*")


#: Terms that one automaton finds.
TERMS = 200_000


def _found_terms(terms: list[tuple[str, str, str]]):
    """An Arrow UDF: which of the terms (lower case, English, Chinese) a lower-cased text contains, in their order. The
    texts go through one automaton of all terms, so their number doesn't matter to a text."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import ahocorasick

        machine = ahocorasick.Automaton()
        places: dict[str, list[int]] = {}
        for k, (low, _, _) in enumerate(terms):
            places.setdefault(low, []).append(k)
        for low, at in places.items():
            machine.add_word(low, at)
        machine.make_automaton()
        for batch in batches:
            found = [sorted({k for _, at in machine.iter(text) for k in at}) if text else [] for text in batch.to_pylist()]
            yield pa.array([[{"en": terms[k][1], "zh": terms[k][2]} for k in at] for at in found], pa.list_(pa.struct([("en", pa.string()), ("zh", pa.string())])))

    return F.arrow_udf(run, "array<struct<en:string,zh:string>>")


def apply_glossary(rows: DataFrame, glossary: DataFrame, en: str, zh: str, out: str, part: int = TERMS) -> DataFrame:
    """`rows` with `out`: the text `zh` where every term of glossary(ord, en, zh) that the text `en` contains, in any
    letter case, is replaced, in order. Terms of one letter, and those without a translation, are left out.

    The glossary goes to the tasks whole, as automata of at most `part` terms; a text's found terms alone are then
    replaced, by the same expressions as in `apply_terminology`. A null in `en` finds nothing."""
    terms = glossary.select("ord", T.trim_ws(F.col("en")).alias("en"), T.trim_ws(F.col("zh")).alias("zh")).filter((F.length("en") >= 2) & (F.col("zh") != ""))
    listed = [(r.low, r.en, r.zh) for r in terms.orderBy("ord", "en", "zh").select(F.lower("en").alias("low"), "en", "zh").toLocalIterator()]
    low = F.coalesce(F.lower(F.col(en)), F.lit(""))
    found = [_found_terms(listed[k : k + part])(low) for k in range(0, len(listed), part)]
    if not found:
        return rows.withColumn(out, F.col(zh))
    return rows.withColumn("_terms", F.concat(*found)).withColumn(out, T.replace_terms(F.col(zh), F.col("_terms"))).drop("_terms")


def map_translations_to_cues(cues: DataFrame | None, segments: DataFrame, translations: DataFrame | None, terms: Column | DataFrame) -> DataFrame:
    """Segment texts, with the glossary applied (an array of terms, or a table of them), cut over the segment's cues;
    the cues keep their times. Texts stay with the segments: only ids and times go by cue. Segments with their cues'
    times (`build_segments(groups, times=True)`) need no cues, and those with a column `text` no translations: then
    nothing is shuffled."""
    if cues is None:
        rows = segments.withColumnRenamed("cues", "c")
    else:
        each = segments.select(*SEG, F.posexplode("cue_ids").alias("k", "cue_id")).join(cues.select("video_id", "cue_id", "pos", "start_us", "end_us"), ["video_id", "cue_id"])
        rows = each.groupBy(*SEG).agg(F.sort_array(F.collect_list(F.struct("k", "cue_id", "pos", "start_us", "end_us"))).alias("c"))
        rows = rows.join(segments.select(*SEG, "text_en", *(["text"] if translations is None else [])), SEG)
    if translations is not None:
        rows = rows.select(*SEG, "text_en", "c").join(translations.select(*SEG, "text"), SEG)
    rows = apply_glossary(rows, terms, "text_en", "text", "zh") if isinstance(terms, DataFrame) else rows.withColumn("zh", T.apply_terminology(F.col("text_en"), F.col("text"), terms))
    rows = rows.withColumn("p", split_text_across_cues("zh", F.transform("c", lambda x: x["end_us"] - x["start_us"])))
    flat = rows.select("video_id", F.explode(F.arrays_zip("c", "p")).alias("z"))
    return flat.select("video_id", "z.c.cue_id", "z.c.pos", "z.c.start_us", "z.c.end_us", F.col("z.p").alias("text"))


def segment_text_from_review(cues: DataFrame, segments: DataFrame) -> DataFrame:
    """Segment texts rebuilt from reviewed cues."""
    each = segments.select(*SEG, F.posexplode("cue_ids").alias("k", "cue_id")).join(cues.select("video_id", "cue_id", "text"), ["video_id", "cue_id"])
    rows = each.groupBy(*SEG).agg(F.sort_array(F.collect_list(F.struct("k", "text"))).alias("c"))
    return rows.select(*SEG, T.join_for_speech(F.col("c.text")).alias("text"))


def bilingual_rows(en: DataFrame, zh: DataFrame) -> DataFrame:
    """Row i of English beside row i of Chinese; the time shown is the Chinese row's if there is one."""
    rank = (F.row_number().over(Window.partitionBy("video_id").orderBy("pos")) - 1).cast("long")
    left = en.select("video_id", rank.alias("row_no"), F.col("text").alias("text_en"), F.col("start_us").alias("s_en"))
    right = zh.select("video_id", rank.alias("row_no"), F.col("text").alias("text_zh"), F.col("start_us").alias("s_zh"))
    return left.join(right, ["video_id", "row_no"], "full").select("video_id", "row_no", "text_en", "text_zh", T.display_time(F.coalesce("s_zh", "s_en")).alias("shown"))


def cached_splits(segments: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with lines where cached, distinct requests for the rest) by content and duration."""
    key = T.content_hash(F.col("text"), T.js_round((F.col("end_us") - F.col("start_us")) / 1000).cast("long"))
    rows = segments.withColumn("key", key).join(cache.select("key", "lines"), "key", "left")
    return rows, rows.filter("lines IS NULL").select("key", "text").dropDuplicates(["key"])


#: Requests that a user's function gets at a time.
REQUESTS = 64


def run_batches(requests: DataFrame, fn: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str, tries: int = 1, rows: int = REQUESTS) -> DataFrame:
    """Apply a user's function to requests, `rows` of them at a time. Where that raises, each of them is tried alone,
    up to `tries` times; one that raises every time becomes a row of nulls with the request's keys, never a failed job.
    What single requests give is handed on together."""
    names = [c.split()[0] for c in schema.split(", ")]

    def joined(frames: list[pd.DataFrame]) -> pd.DataFrame:
        out = frames[0] if len(frames) == 1 else pd.concat(frames)
        if missing := set(names) - set(out.columns):
            raise KeyError(*missing)
        return out

    def alone(some: pd.DataFrame, k: int) -> pd.DataFrame | None:
        for _ in range(tries):
            try:
                return joined(list(fn(iter([some.iloc[k : k + 1].reset_index(drop=True)]))))
            except Exception:  # noqa: BLE001, S112  a user's function may fail in any way
                continue
        return None

    def each(some: pd.DataFrame) -> Iterator[pd.DataFrame]:
        made: dict[tuple, list[pd.DataFrame]] = {}  # of the same columns and types, so that none changes another's values
        lost = []
        for k in range(len(some)):
            if (out := alone(some, k)) is None:
                lost.append(k)
            else:
                made.setdefault((*out.columns, *out.dtypes), []).append(out)
        for same in made.values():
            yield pd.concat(same)[names]
        if lost:
            left = some.iloc[lost]
            yield pd.DataFrame({n: left[n] if n in left else pd.Series([None] * len(lost), left.index, dtype=object) for n in names})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), rows):
                some = batch.iloc[at : at + rows].reset_index(drop=True)
                try:
                    out = list(fn(iter([some.copy()])))
                    whole = joined(out)[names] if out else pd.DataFrame(columns=names)
                except Exception:  # noqa: BLE001  as above
                    yield from each(some)
                else:
                    yield whole

    return requests.mapInPandas(run, schema)
