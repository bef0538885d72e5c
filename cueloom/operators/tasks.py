"""Task tables and event logs: current state, plans, summaries and output names."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Statuses in which a task works, and those that a restart interrupts.
WORK = ["parsing", "translating", "reviewing", "synthesizing", "assembling", "encoding"]


def fold_task_events(events: DataFrame) -> DataFrame:
    """Latest state of every task of events(task_id, seq, status, progress, detail): the last event decides;
    an error sets progress to 0, keeps its text as error and clears the detail."""
    last = events.groupBy("task_id").agg(F.max_by(F.struct("status", "progress", "detail"), "seq").alias("e"), F.max("seq").alias("seq"))
    error = F.col("e.status") == "error"
    return last.select("task_id", "seq", F.col("e.status").alias("status"), F.when(error, 0).otherwise(F.col("e.progress")).cast("long").alias("progress"), F.when(~error, F.col("e.detail")).alias("detail"), F.when(error, F.col("e.detail")).alias("error"))


# Kinds of a task log's rows.
LOG_KINDS = "status error issues countdown subtitle replace".split()
LOG = "task_id long, seq long, kind string, status string, progress long, text string, detail string, issues array<struct<id:long,text:string,max_chars:int>>, countdown long, path string"


def _matters() -> dict[str, Column]:
    """Which rows of a log set a field, or a group of fields that are set together."""
    kind, reset = F.col("kind"), F.col("kind") == "replace"
    clears = (kind == "status") & ~F.col("status").isin("reviewing", "paused")
    return {
        "status": kind.isin("status", "error", "replace"),
        "error": kind.isin("error", "replace") | ((kind == "status") & (F.col("status") != "error")),
        "issues": (kind == "issues") | reset,
        "countdown": kind.isin("countdown", "error", "replace") | clears,
        "path": (kind == "subtitle") | reset,
    }


def deciding_fields() -> Column:
    """The names of what a log's row sets, with commas; every row sets `any`. Of a task, the last row for each
    name, at most six in all, give by `fold_task_log` what all its rows give, so a stream needs to keep no others."""
    return F.concat_ws(",", *[F.when(F.coalesce(test, F.lit(False)), name) for name, test in _matters().items()], F.lit("any"))


def fold_task_log(log: DataFrame) -> DataFrame:
    """State of every task of a log of the columns LOG.

    `status` rows set status, progress and detail, end an error unless they say error themselves, and a
    countdown unless they say reviewing or paused; `error` rows (text, detail) set progress to 0; `issues`,
    `countdown` and `subtitle` rows set their own field, and `replace` rows (path) start the task anew with
    another subtitle."""
    kind = F.col("kind")
    latest = lambda value, test: F.max_by(value, F.when(F.coalesce(test, F.lit(False)), F.col("seq")))
    main = kind.isin("status", "error", "replace")
    ends_error = kind.isin("error", "replace") | ((kind == "status") & (F.col("status") != "error"))
    ends_countdown = kind.isin("countdown", "error", "replace") | ((kind == "status") & ~F.col("status").isin("reviewing", "paused"))
    only = lambda name, column: F.when(kind == name, F.col(column))
    return log.groupBy("task_id").agg(
        F.max("seq").alias("seq"),
        latest(F.when(kind == "error", "error").when(kind == "replace", "waiting").otherwise(F.col("status")), main).alias("status"),
        latest(F.when(kind == "status", F.col("progress")).otherwise(0), main).cast("long").alias("progress"),
        latest(only("status", "detail"), main).alias("detail"),
        latest(only("error", "text"), ends_error).alias("error"),
        latest(only("error", "detail"), ends_error).alias("error_detail"),
        latest(F.when((kind == "issues") & (F.size("issues") > 0), F.col("issues")), kind.isin("issues", "replace")).alias("issues"),
        latest(only("countdown", "countdown"), ends_countdown).alias("countdown"),
        latest(F.col("path"), kind.isin("subtitle", "replace")).alias("subtitle_path"),
    )


def merge_cue_snapshots(updates: DataFrame, fields: list[str]) -> DataFrame:
    """Per task and field the latest value that isn't null; an empty list is a value. Tasks without any are left out."""
    merged = updates.groupBy("task_id").agg(*[F.max_by(f, F.when(F.col(f).isNotNull(), F.col("seq"))).alias(f) for f in fields])
    return merged.filter(F.coalesce(*[F.when(F.col(f).isNotNull(), True) for f in fields]))


def recover_interrupted(tasks: DataFrame) -> DataFrame:
    """After a restart: queued tasks wait again from 0, tasks at work are paused."""
    return tasks.withColumn("progress", F.when(F.col("status") == "queued", 0).otherwise(F.col("progress"))).withColumn("status", F.when(F.col("status") == "queued", "waiting").when(F.col("status").isin(WORK), "paused").otherwise(F.col("status")))


def changed_only(events: DataFrame) -> DataFrame:
    """Events that differ from the one before them."""
    w = Window.partitionBy("task_id").orderBy("seq")
    now = F.struct("status", "progress", "detail")
    return events.withColumn("_before", F.lag(now).over(w)).filter(F.col("_before").isNull() | ~now.eqNullSafe(F.col("_before"))).drop("_before")


def last_work_status(events: DataFrame) -> DataFrame:
    return events.filter(F.col("status").isin(WORK)).groupBy("task_id").agg(F.max_by("status", "seq").alias("last_work"))


def throttle_progress(events: DataFrame, step: float = 0.005) -> DataFrame:
    """Progress rows (task_id, seq, ratio) at least `step` above the last one that was let through. Tasks
    are read in order, a batch at a time; only the last ratio is carried on, so a long task needs no more."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, last = None, None
        for pdf in batches:
            keep = []
            for t, r in zip(pdf["task_id"], pdf["ratio"]):
                if t != task:
                    task, last = t, None
                go = last is None or r - last >= step
                keep.append(go)
                last = r if go else last
            yield pdf[keep]

    rows = events.select("task_id", "seq", "ratio").repartition("task_id").sortWithinPartitions("task_id", "seq")
    return rows.mapInPandas(run, "task_id long, seq long, ratio double")


def encoding_progress(lines: DataFrame) -> DataFrame:
    """Ratio and percent (88 to 95) of out_time_us lines of lines(…, line, duration_us)."""
    us = F.regexp_extract("line", r"out_time_us=(\d+)", 1).try_cast("long")
    ratio = F.greatest(F.lit(0.0), F.least(F.lit(1.0), us / F.col("duration_us")))
    return lines.filter((F.col("duration_us") > 0) & us.isNotNull()).withColumn("ratio", ratio).withColumn("percent", F.floor(88 + 7 * ratio + 0.5).cast("long"))


def has_subtitle() -> Column:
    """An empty path is none."""
    return F.coalesce(F.col("subtitle_path"), F.lit("")) != ""


def task_summary(tasks: DataFrame) -> DataFrame:
    """Counts of tasks(status, subtitle_path) by status, and what is among them: tasks that can start, be
    paused, work, are paused, or have failed and can be tried again."""
    status, ready = F.col("status"), has_subtitle()
    flags = {"startable": (status == "waiting") & ready, "pausable": status.isin("queued", *WORK), "running": status.isin(WORK), "paused": status == "paused", "failed": (status == "error") & ready}
    return tasks.groupBy("status").agg(F.count(F.lit(1)).alias("n"), *[F.bool_or(test).alias(name) for name, test in flags.items()])


def new_tasks(paths: DataFrame, tasks: DataFrame) -> DataFrame:
    """Unseen paths of paths(ord, path), each once."""
    first = paths.groupBy("path").agg(F.min("ord").alias("ord"))
    return first.join(tasks.select(F.col("video_path").alias("path")), "path", "left_anti")


def retry_plan(tasks: DataFrame, issues: DataFrame) -> DataFrame:
    """Failed tasks with a subtitle: retry their issues where they have some, else plainly."""
    failed = tasks.filter((F.col("status") == "error") & has_subtitle()).select("task_id")
    has = issues.select("task_id").distinct()
    return failed.join(has, "task_id", "left_semi").withColumn("plan", F.lit("issues")).unionByName(failed.join(has, "task_id", "left_anti").withColumn("plan", F.lit("plain")))


def startable_tasks(tasks: DataFrame) -> DataFrame:
    return tasks.filter((F.col("status") == "waiting") & has_subtitle())


def rejected_starts(tasks: DataFrame) -> DataFrame:
    """Waiting tasks that cannot start, as error rows."""
    return tasks.filter((F.col("status") == "waiting") & ~has_subtitle()).withColumn("status", F.lit("error")).withColumn("error", F.lit("no subtitle"))


#: Positions that are numbered in one task.
BLOCK = 1_000_000


def numbered(rows: DataFrame, keys: list[str], name: str, block: int = BLOCK) -> DataFrame:
    """`rows` with their number from 1 by `ord` within keys. However many rows a key has, a task numbers those of
    `block` positions: numbers within blocks, and for each block what the key's blocks before it hold."""
    rows = rows.withColumn("_block", F.floor(F.col("ord") / block).cast("long"))
    part = [*keys, "_block"]
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*part).agg(F.count(F.lit(1)).alias("_n")).select(*part, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy(*part).orderBy("ord"))
    return rows.withColumn("_own", own).join(sums, part).withColumn(name, F.col("_own") + F.col("_before")).drop("_own", "_before", "_block")


def _free(place: Column, taken: Column) -> Column:
    """The place-th number from 1 that isn't among the sorted `taken`: of the taken numbers those count that have
    fewer free ones below them than place."""
    gaps = F.transform(taken, lambda t, k: t - k - 1)  # free numbers below each
    return place + F.coalesce(F.size(F.filter(gaps, lambda g: g < place)), F.lit(0))


class _Names:
    """Names of one family, in order: for each stem, in any case, the numbers that are given, all up to a pointer
    and a few beyond it. 'a (2)' is number 2 of 'a' and number 1 of 'a (2)'."""

    NUMBERED = re.compile(r"^(.*) \(([1-9]\d*)\)$", re.S)

    def __init__(self, folders: bool, subtitles: bool):
        self.folders, self.subtitles = folders, subtitles
        self.exists: set[str] = set()
        self.upto: dict[tuple[str, str], int] = {}
        self.beyond: dict[tuple[str, str], set[int]] = {}
        self.tried: dict[tuple[str, str], int] = {}

    def _take(self, chain: tuple[str, str], k: int) -> None:
        upto, beyond = self.upto.get(chain, 0), self.beyond.setdefault(chain, set())
        beyond.add(k)
        while upto + 1 in beyond:
            upto += 1
            beyond.remove(upto)
        self.upto[chain] = upto

    def _given(self, chain: tuple[str, str], k: int) -> bool:
        return k <= self.upto.get(chain, 0) or k in self.beyond.get(chain, ())

    def give(self, stem: str, ext: str) -> str:
        low, apart = stem.lower(), "" if self.folders or self.subtitles else ext.lower()
        k = self.tried.get((stem, ext), 1)  # all before it are gone for this stem
        while True:
            name = f"{stem} ({k})" if k > 1 else stem
            files = [name] if self.folders else [name + ext] + ([f"{name}.srt"] if self.subtitles else [])
            if not self._given((low, apart), k) and not any(f in self.exists for f in files):
                break
            k += 1
        self.tried[stem, ext] = k + 1
        self._take((low, apart), k)
        if k > 1:
            self._take((f"{low} ({k})", apart), 1)
        elif (m := self.NUMBERED.match(low)) and int(m[2]) > 1:
            self._take((m[1], apart), int(m[2]))
        return name


def output_names(videos: DataFrame, existing: DataFrame, folders: bool = False, subtitles: bool = True, block: int = BLOCK) -> DataFrame:
    """Where the output of every row of videos(ord, root, stem, ext) goes, in order: name is the stem, or
    'stem (2)', ... where that is taken in root, with output_dir, video_path and subtitle_path.

    With `folders` a name is that of a folder, and the files in it keep their stems; else the video and,
    with `subtitles`, its .srt must be free. Names of existing(root, name) are taken as they are written,
    names given here in any letter case. Names can meet only within a family (the stem without ' (n)').

    Families of one stem, in any case, get their numbers from ranks, against the sorted numbers that exist; that
    takes no task with a whole family (see `numbered`). What is left are families with numbered stems of their own,
    or with names that exist for some of their spellings and extensions only: they pass through a task in order,
    of which it holds the numbers given and not the rows."""
    family = lambda c: F.lower(F.regexp_replace(c, r"( \(\d+\))+$", ""))
    apart = F.lit("") if folders or subtitles else F.lower("ext")
    key = ["root", "family"]
    rows = videos.select("ord", "root", "stem", "ext", family(F.col("stem")).alias("family"), apart.alias("apart"))
    there = existing.select("root", "name", F.col("name") if folders else F.regexp_replace("name", r"\.[^.]*$", ""))
    there = there.toDF("root", "name", "bare").select("root", "name", "bare", family(F.col("bare")).alias("family")).distinct()
    met = there.join(rows.select(*key).distinct(), key, "left_semi")
    # the spellings and extensions of a family, and the numbers that exist for each of them
    kinds = rows.select(*key, "stem", "ext", "apart").distinct()
    stems = kinds.groupBy(*key).agg((F.count_if(F.lower("stem") != F.col("family")) > 0).alias("several"))
    number = F.when(F.col("bare") == F.col("stem"), 1).when(
        F.startswith("bare", F.concat("stem", F.lit(" ("))) & F.endswith("bare", F.lit(")")),
        F.regexp_extract(F.expr("substr(bare, length(stem) + 1)"), r"^ \(([1-9][0-9]{0,17})\)$", 1).try_cast("long"),
    )
    hits = met.join(kinds, key).withColumn("number", number).filter(F.col("number").isNotNull() & ((F.col("number") == 1) == (F.col("bare") == F.col("stem"))))
    if not folders:
        hits = hits.filter((F.col("name") == F.concat("bare", "ext")) | (F.lit(subtitles) & (F.col("name") == F.concat("bare", F.lit(".srt")))))
    hits = hits.select(*key, "apart", "stem", "ext", "number").distinct()
    kinds_in = kinds.groupBy(*key, "apart").agg(F.count(F.lit(1)).alias("kinds"))
    each = hits.groupBy(*key, "apart", "number").agg(F.count(F.lit(1)).alias("n")).join(kinds_in, [*key, "apart"])
    uneven = each.filter(F.col("n") < F.col("kinds")).select(*key).distinct()
    mixed = stems.filter("several").select(*key).unionByName(uneven).distinct()
    taken = each.groupBy(*key, "apart").agg(F.sort_array(F.collect_list("number")).alias("taken"))  # as many as names exist
    even = numbered(rows.join(mixed, key, "left_anti"), [*key, "apart"], "place", block).join(taken, [*key, "apart"], "left")
    slot = _free(F.col("place"), F.col("taken"))
    even = even.select("ord", "root", "stem", "ext", F.when(slot > 1, F.concat("stem", F.lit(" ("), slot.cast("string"), F.lit(")"))).otherwise(F.col("stem")).alias("name"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, names = None, None
        for pdf in batches:
            out = []
            for root, fam, o, stem, ext, name in zip(*(pdf[c] for c in ("root", "family", "ord", "stem", "ext", "name"))):
                if (root, fam) != at:
                    at, names = (root, fam), _Names(folders, subtitles)
                if pd.isna(o):
                    names.exists.add(name)
                else:
                    out.append((int(o), root, stem, ext, names.give(stem, ext)))
            yield pd.DataFrame(out, columns=["ord", "root", "stem", "ext", "name"])

    nothing = [F.lit(None).cast(t).alias(c) for c, t in (("ord", "long"), ("stem", "string"), ("ext", "string"))]
    both = rows.select(*key, "ord", "stem", "ext", F.lit(None).cast("string").alias("name")).unionByName(met.select(*key, "name", *nothing))
    both = both.join(mixed, key, "left_semi").repartition(*key).sortWithinPartitions(*key, F.asc_nulls_first("ord"))
    named = even.unionByName(both.mapInPandas(run, "ord long, root string, stem string, ext string, name string"))
    home = F.concat_ws("/", "root", "name") if folders else F.col("root")
    file = lambda ext: F.concat(home, F.lit("/"), F.col("stem") if folders else F.col("name"), ext)
    return named.select("ord", "root", "stem", "ext", "name", home.alias("output_dir"), file(F.col("ext")).alias("video_path"), F.when(F.lit(subtitles), file(F.lit(".srt"))).alias("subtitle_path"))
