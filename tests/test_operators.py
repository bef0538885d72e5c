import duckdb
import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cueloom import file_queries, queries as Q, rule_queries  # noqa: F401
from cueloom.functions import text as T
from cueloom.operators import audio, cues as C, repartition as R, tasks as K, translate as X
from cueloom.plans.fixtures import table
from cueloom.sources import subtitles as S

TABLES = ["documents", "conversations", "orders", "lineitem", "events"]


@pytest.mark.parametrize("name", ["group_by_gap", "segment_budgets", "split_overlong_cues", "merge_chunk_votes", "text_guards", "resolve_attempts", "track_layout", "match_subtitles", "render_srt", "fold_task_events", "render_ass", "parse_ass", "task_snapshots", "probe_metadata", "group_by_votes", "fold_task_log", "output_names", "classify_errors", "throttle_progress", "subtitle_files", "read_subtitle_files", "cache_entries", "overlapping_pairs", "parse_odd_srt", "parse_odd_ass", "parse_ass_time", "word_boundaries", "merge_cue_snapshots", "retry_plan", "startable_tasks", "task_summary", "alignment_segments", "alignment_metrics", "apply_glossary", "run_batches", "sample_text", "choose_subtitles", "english_scores", "finish_track", "assemble_track", "split_large_groups"])
def test_same_rows_as_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = con.execute(Q.ORACLE[name]).df()
    got = Q.QUERIES[name](spark, sf_dir).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    plain = lambda v: "null" if pd.isna(v) else str(v) if isinstance(v, (bool, np.bool_, str)) else f"{float(v):.9g}"
    rows = lambda df: sorted(tuple(map(plain, r)) for r in df[sorted(df.columns)].astype(object).values.tolist())
    assert rows(got) == rows(want)


def _cues(spark, spans, text="x"):
    return spark.createDataFrame([(1, k, k, a * 1000, b * 1000, text) for k, (a, b) in enumerate(spans)], "video_id long, cue_id long, pos long, start_us long, end_us long, text string")


def test_gaps_and_long_spans_start_groups(spark):
    rows = C.group_by_gap(_cues(spark, [(0, 1000), (1200, 2000), (2201, 3000), (3000, 33000), (33000, 34000)])).orderBy("pos").collect()
    assert [r.group_no for r in rows] == [0, 0, 1, 2, 3]


def test_large_groups_split_at_the_largest_gap(spark):
    cues = _cues(spark, [(0, 1000), (1100, 2000), (2200, 3000)], "y" * 200).withColumn("group_no", F.lit(0).cast("long"))
    assert [r.group_no for r in C.split_large_groups(cues).orderBy("pos").collect()] == [0, 1, 2]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("ab，。！ c", min_size=0, max_size=60), max_size=4))
def test_partition_keeps_all_letters(parts):
    text = "".join(parts)
    bare = lambda s: [c for c in s if c in "abc"]
    assert bare("".join(R.partition_text(text))) == bare(text)


@settings(max_examples=200, deadline=None)
@given(st.text("ab c,.", max_size=80), st.lists(st.integers(1, 10**7), min_size=1, max_size=6))
def test_split_over_keeps_order(text, durations):
    pieces = R.split_over(text, durations)
    assert len(pieces) == len(durations)
    assert "".join(pieces).replace(" ", "") == text.replace(" ", "") or len(text.strip()) < len(durations)


def test_retimed_cues_stay_in_the_window():
    cues = [(0, 10, "Hello there"), (10, 20, "你好 𠮷")]
    words = [(k * 300_000, k * 300_000 + 250_000, w) for k, w in enumerate(["Hello", "there", "你好", "𠮷"])]
    out = R.retimed(cues, words, 1_000_000, 2_500_000, 1_200_000)
    assert out == [(1_000_000, 1_550_000), (1_600_000, 2_200_000)]
    lost = R.retimed([(0, 10, "other")], words, 0, 2_000_000, 1_000_000)
    assert 0 <= lost[0][0] < lost[0][1] <= 1_000_000
    assert R.retimed(cues, [], 0, 1, 1) == [(0, 10), (10, 20)]
    loose = R.retimed([(0, 1, "ＨＥＬＬＯ, th-ere"), (1, 2, "\ufeff 你 好!")], words, 0, 3_000_000, 1_200_000)
    assert loose == [(0, 550_000), (600_000, 1_200_000)]


def _plain_split(text, durations):
    """Every place from the goal outwards, one after the other."""
    text, out, at, done = " ".join(text.split()), [], 0, 0
    word, n = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_./#+-"), len(durations)
    good = lambda k: k >= len(text) or text[k - 1] in ",.;:!?，。；：！？、）)]} " or text[k] in "（([{ " or not (text[k - 1] in word and text[k] in word)
    for i in range(n - 1):
        done += max(1, durations[i])
        low, high = at + 1, len(text) - (n - i - 1)
        goal = max(low, min(high, int(len(text) * done / sum(max(1, d) for d in durations) + 0.5)))
        near = [k for r in range(len(text) + 1) for k in (goal - r, goal + r) if max(1, low) <= k <= high and good(k)]
        out.append(text[at : (cut := near[0] if near else goal)].strip())
        at = cut
    return [*out, text[at:].strip()]


@settings(max_examples=300, deadline=None)
@given(st.text("abC,。 (", min_size=1, max_size=50), st.lists(st.integers(0, 10**6), min_size=2, max_size=7))
def test_split_over_takes_the_nearest_good_cuts(text, durations):
    if text.strip():
        assert R.split_over(text, durations) == _plain_split(text, durations)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 9), st.integers(1, 60), st.sampled_from(["a", "", "word, ", " ,;", "\ufeff", "😀 😀  —", "x" * 90])), min_size=1, max_size=40))
def test_halves_equal_cutting_one_after_the_other(cues):
    rows, at = [], 0
    for gap, length, text in cues:
        at += gap * 1_000_000
        rows.append((at, at + length * 100_000, text))
        at += length * 100_000
    got = C.halves(*map(list, zip(*rows)))
    want = [k for k, part in enumerate(_halved(rows)) for _ in part]
    assert got == want


def test_timings_share_by_length(spark):
    parts = spark.createDataFrame([(1, k, t, 0, 6_000_000) for k, t in enumerate(["a" * 10, "a" * 20, "a" * 30])], "k long, idx int, text string, start_us long, end_us long")
    got = [(r.part_start_us, r.part_end_us) for r in C.allocate_timings(parts, ["k"]).orderBy("idx").collect()]
    assert got == [(0, 1_000_000), (1_000_000, 3_000_000), (3_000_000, 6_000_000)]


def test_srt_and_ass_documents(spark):
    srt = "﻿WEBVTT\n\nNOTE x\n\nintro\n00:01.000 --> 00:02.500\n<i>Hi</i>\nyou\n\n2\n00:00:03,000 --> 00:00:04,000\nBye\n"
    assert [(c["start_us"], c["end_us"], c["text"]) for c in S.parse_srt_text(srt)] == [(1_000_000, 2_500_000, "Hi\nyou"), (3_000_000, 4_000_000, "Bye")]
    ass = "[Script Info]\nDialogue: 0,no\n[Events]\nFormat: Start, End, Text\nDialogue: 0:00:05.00,0:00:06.00,{\\b1}Later, yes\\Nso\nDialogue: 0:00:01.50,0:00:02.00,First\nDialogue: x,y,\n"
    assert [(c["cue_id"], c["start_us"], c["text"]) for c in S.parse_ass_text(ass)] == [(1, 1_500_000, "First"), (0, 5_000_000, "Later, yes so")]
    files = spark.createDataFrame([("d", "a.srt", ".srt", srt), ("d", "b.ass", ".ass", ass), ("d", "c.srt", ".srt", None)], "dir string, filename string, ext string, content string")
    assert S.parse_files(files).count() == 4 and S.rejected_files(files).count() == 1
    cues = S.parse_files(files).filter("filename = 'a.srt'").withColumn("video_id", F.lit(1))
    assert [c["text"] for c in S.parse_srt_text(S.render_srt(cues).first().srt)] == ["Hi\nyou", "Bye"]


def test_read_files_and_cache(spark, tmp_path):
    (tmp_path / "x y").mkdir()
    (tmp_path / "x y" / "a.SRT").write_text("1\n00:00:01,000 --> 00:00:02,000\nHi\n")
    (tmp_path / "x y" / "a.mp4").write_text("")
    row = S.read_subtitle_files(spark, str(tmp_path)).first()
    assert (row.dir, row.filename, row.ext) == ("x y", "a.SRT", ".srt")
    path, schema = str(tmp_path / "cache"), "video_id long, task_id string, v string"
    for v in ("old", "new"):
        S.write_cache(spark.createDataFrame([(1, "t", v), (2, "t", None)], schema), path, "1", "s")
    read = lambda v, s, **kw: sorted((r.video_id, r.v) for r in S.read_cache(spark, path, schema, v, s, **kw).collect())
    assert (len(read("1", "s")), read("2", "s"), read("1", "t")) == (4, [], [])
    assert read("1", "s", keys=["video_id"], valid=F.col("v").isNotNull()) == [(1, "new")]
    owners = spark.createDataFrame([(1, "t"), (2, "other")], "video_id long, task_id string")
    assert read("1", "s", keys=["video_id"], owners=owners) == [(1, "new")]


def test_snapshots_and_probes(spark):
    one = lambda text: spark.createDataFrame([(text,)], "json string")
    tasks = '{"version":1,"tasks":[{"id":"a","videoPath":"p","videoName":"n","subtitlePath":null,"status":"waiting","progress":1,"errorDetail":"e","countdownRemaining":3,"translationIssues":[{"id":1,"text":"t"},{"id":2}]},{"id":"b","videoPath":"p","videoName":"n","subtitlePath":null,"status":"odd","progress":1},{"id":"c","videoPath":"p","videoName":"n","status":"waiting","progress":1},{"id":"","videoPath":"p","videoName":"n","subtitlePath":null,"status":"waiting","progress":1},7]}'
    got = S.read_task_snapshots(one(tasks)).collect()
    assert len(got) == 1 and len(got[0].translationIssues) == 1 and (got[0].errorDetail, got[0].countdownRemaining) == ("e", 3)
    cues = '{"version":2,"englishCues":[{"id":0,"startUs":1,"endUs":2,"text":"a"}],"chineseCues":[{"id":0,"startUs":1,"endUs":2,"text":"b"},{"id":1}]}'
    assert sorted(r.lang for r in S.read_cue_snapshots(one(cues)).collect()) == ["en", "zh"]
    probe = '{"format":{"duration":"1.5"},"streams":[{"codec_type":"video","width":720,"height":576,"sample_aspect_ratio":"16:11","tags":{"rotate":"90"}},{"codec_type":"audio","codec_name":"aac"}]}'
    r = S.read_probe_metadata(one(probe)).first()
    assert (r.duration_us, r.display_width, r.display_height, r.rotation, r.audio_codec) == (1_500_000, 576, 1047, 90, "aac")
    assert S.read_boundaries(one('[{"part":"a","start":1,"end":2},{"part":" ","start":1,"end":2},{"part":"b"}]')).count() == 1


def _names_in_order(videos, existing, folders, subtitles):
    """Output names one video after the other."""
    given, out = set(), {}
    for o, root, stem, ext in sorted(videos):
        k = 1
        while True:
            name = stem if k == 1 else f"{stem} ({k})"
            files = [name] if folders else [name + ext] + ([name + ".srt"] if subtitles else [])
            if not any((root, f) in existing or (root, f.lower()) in given for f in files):
                break
            k += 1
        given |= {(root, f.lower()) for f in files}
        out[o] = name
    return out


@pytest.mark.parametrize("folders,subtitles", [(True, True), (False, True), (False, False)])
def test_output_names(spark, folders, subtitles):
    rng = np.random.default_rng(3)
    stems = ["a", "A", "a (2)", "b", "b (2)", "b (2) (2)", "c", "C", "d", "lone", "x (y)", "e", "e (02)", "f"]
    videos = [(int(o), f"r{rng.integers(3)}", str(rng.choice(stems)), str(rng.choice([".mp4", ".mkv"]))) for o in range(260)]
    videos += [(int(o), "r3", "big", ".mp4") for o in range(300, 420)]
    existing = {("r0", n) for n in ("a.mp4", "a (3).srt", "b", "b (3)", "A", "e (3).srt", "E.srt")} | {("r1", n) for n in ("c.srt", "d", "d (4)", "d (4).srt", "d (5).srt", "d.srt", "d (12345678901234567890).srt")}
    existing |= {("r3", n) for n in ("big", "big.srt", "big (3)", "big (3).mp4", "big (50)", "big (50).srt", "BIG (7)", "big (07)", "other.srt")}
    made = K.output_names(spark.createDataFrame(videos, "ord long, root string, stem string, ext string"), spark.createDataFrame(sorted(existing), "root string, name string"), folders, subtitles, block=16)
    rows = made.collect()
    assert len(rows) == len(videos) and {r.ord: r.name for r in rows} == _names_in_order(videos, existing, folders, subtitles)
    r = rows[0]
    assert r.video_path == (f"{r.root}/{r.name}/{r.stem}{r.ext}" if folders else f"{r.root}/{r.name}{r.ext}")
    assert (r.subtitle_path is not None) == subtitles


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["a", "A", "a (2)", "a (3)", "a (2) (2)", "a (02)", "a (1)"]), st.sampled_from([".mp4", ".MKV"])), max_size=25), st.sets(st.sampled_from(["a", "a.mp4", "A (2).srt", "a (2).MKV", "a (3)", "a (2) (2).srt"])), st.booleans(), st.booleans())
def test_names_of_a_family_go_in_order(rows, exists, folders, subtitles):
    names = K._Names(folders, subtitles)
    names.exists = exists
    want = _names_in_order([(k, "r", *r) for k, r in enumerate(rows)], {("r", e) for e in exists}, folders, subtitles)
    assert [names.give(*r) for r in rows] == [want[k] for k in range(len(rows))]


def test_numbers_by_blocks(spark):
    rows = [(int(o), int(o) % 3) for o in np.random.default_rng(1).permutation(500)]
    got = K.numbered(spark.createDataFrame(rows, "ord long, k long"), ["k"], "n", 7).collect()
    assert len(got) == 500 and all(r.n == r.ord // 3 + 1 for r in got)


def test_ass_styles_and_margins(spark):
    cues = spark.createDataFrame([(1, 1, 1, 0, 1_500_000, "one"), (1, 2, 2, 5, 5, "gone"), (1, 3, 3, 0, 9, "  ")], "video_id long, cue_id long, pos long, start_us long, end_us long, text string")
    videos = spark.createDataFrame([(1, None, None), (2, 1280, 720)], "video_id long, width int, height int")
    text = lambda style: {r.video_id: r.ass for r in S.render_ass(cues, videos, style).collect()}
    plain = text(S.AssStyle(size=48, outline=True, background=False, top=True, bold=True))
    assert "PlayResX: 1920\nPlayResY: 1080\nScaledBorderAndShadow: yes" in plain[1] and "Style: Bg" not in plain[1]
    assert ",-1,0,0,0,100,100,0,0,1,3,0,8,120,120,72,1" in plain[1]
    assert plain[1].endswith("Effect, Text\nDialogue: 0,0:00:00.00,0:00:01.50,Text,,0,0,0,,one\n") and plain[2].endswith("Effect, Text\n\n")
    boxed = text(S.AssStyle(size=48, outline=True, background_opacity=55, font="A,b"))
    assert "Style: Bg,A b,48,&HFF000000,&HFF000000,&H00000000,&H73000000,0,0,0,0,100,100,0,0,3,9,0,2,120,120,72,1" in boxed[1]
    assert "1,3,4,2,120,120,72,1" in boxed[1] and "Dialogue: 1,0:00:00.00,0:00:01.50,Text,,0,0,0,,one" in boxed[1]
    assert "Style: Bg,A b,32," in boxed[2] and ",80,80,48,1" in boxed[2]


def _halved(cues):
    """Groups of (start, end, text) split one after the other while they are too long."""
    pieces = [c[2].rstrip() if k == len(cues) - 1 else c[2].rstrip().rstrip(",;:-–—").rstrip() for k, c in enumerate(cues)]
    n = len(" ".join(" ".join(p for p in pieces if p).split()).encode("utf-16-be")) // 2
    if len(cues) == 1 or (cues[-1][1] - cues[0][0] <= 30_000_000 and n <= 320):
        return [cues]
    gaps = [b[0] - a[1] for a, b in zip(cues, cues[1:])]
    at = gaps.index(max(gaps)) + 1
    return _halved(cues[:at]) + _halved(cues[at:])


def test_large_groups_of_a_table_split_as_one_by_one(spark, sf_dir):
    groups = C.group_by_gap(table(spark, sf_dir, "cues"))
    groups = groups.withColumn("group_no", (F.col("group_no") / 6).cast("long"))  # long ones, too
    before, after, want, got = {}, {}, {}, {}
    for rows, seen in ((groups.collect(), before), (C.split_large_groups(groups).collect(), after)):
        for r in sorted(rows, key=lambda r: (r.start_us, r.pos)):
            seen.setdefault(r.video_id, {}).setdefault(r.group_no, []).append((r.start_us, r.end_us, r.text))
    for v, by_group in before.items():
        want[v] = [part for g in sorted(by_group) for part in _halved(by_group[g])]
        got[v] = [after[v][g] for g in sorted(after[v])]
    assert got == want and any(len(after[v]) > len(before[v]) for v in before)


def test_run_batches_turns_errors_into_nulls(spark):
    def fn(batches):
        for b in batches:
            if (b["k"] % 3 == 2).any():
                raise ValueError("no")
            yield b.assign(json=str(len(b)))[["k", "json"]]

    requests = spark.range(9).coalesce(1).select(F.col("id").alias("k"))
    rows = X.run_batches(requests, fn, "k long, json string", tries=2, rows=4).collect()
    assert sorted((r.k, r.json) for r in rows) == [(k, None if k % 3 == 2 else "1") for k in range(9)]  # every part has a bad one
    rows = X.run_batches(requests.filter("k % 3 < 2"), fn, "k long, json string", rows=4).collect()
    assert sorted((r.k, r.json) for r in rows) == [(k, "4" if k < 6 else "2") for k in range(9) if k % 3 < 2]
    silent = X.run_batches(requests, lambda batches: (b.iloc[:0].assign(json="") for b in batches), "k long, json string")
    assert silent.count() == 0


def test_single_requests_are_handed_on_together():
    def fn(batches):
        for b in batches:
            if b["k"].isin([5, 40, 41]).any():
                raise ValueError
            yield b.assign(n=b["k"] + 2**60 if b["k"][0] % 2 else b["k"] + 0.5)

    caught = []
    X.run_batches(type("Requests", (), {"mapInPandas": lambda self, run, schema: caught.append(run)})(), fn, "k long, n long")
    sent = list(caught[0](iter([pd.DataFrame({"k": range(64)})])))
    assert len(sent) == 3 and sorted(k for f in sent for k in f["k"]) == list(range(64))  # one by one: 64 frames
    (exact,) = [f for f in sent if f["n"].dtype == "int64"]
    assert sorted(exact["n"]) == [k + 2**60 for k in range(1, 64, 2) if k not in (5, 41)]  # not by way of doubles


def test_glossary_of_ten_thousand_terms(spark):
    import re

    rng = np.random.default_rng(4)
    words = ["".join(rng.choice(list("abcdE+$"), int(rng.integers(1, 6)))) for _ in range(10_000)]
    terms = [(k, f" {w} " if k % 5 else w.upper(), f"[{k}$1\\]" if k % 7 else "") for k, w in enumerate(words)]
    texts = [("".join(rng.choice(list("abcDe+$ "), 60)), "".join(rng.choice(list("abcDE+$ "), 60))) for _ in range(20)]
    texts += [(None, "ab"), ("ab", None), ("", "")]
    rows = spark.createDataFrame([(k, *t) for k, t in enumerate(texts)], "k long, en string, zh string")
    glossary = spark.createDataFrame(terms, "ord long, en string, zh string")
    want = []
    for k, (en, zh) in enumerate(texts):
        for _, e, z in terms:
            if en and zh is not None and z and len(e.strip()) > 1 and e.strip().lower() in en.lower():
                zh = re.sub(re.escape(e.strip()), lambda _, z=z: z.strip(), zh, flags=re.I)
        want.append((k, zh))
    for part in (3000, X.TERMS):
        got = X.apply_glossary(rows, glossary, "en", "zh", "out", part).select("k", "out").collect()
        assert sorted(map(tuple, got)) == want
    assert X.apply_glossary(rows, glossary.limit(0), "en", "zh", "out").filter("NOT (zh <=> out)").count() == 0


def test_pcm(spark):
    tone = (np.sin(np.arange(9600) / 5) * 9000).astype("<i2")
    pcm = np.concatenate((np.zeros(4800, "<i2"), tone, np.zeros(4800, "<i2"))).tobytes()
    assert audio.trimmed(pcm) == (3840, 19200 - 2 * 960)
    assert audio.trimmed(b"") == (0, 0) and audio.trimmed(bytes(9600)) == (4800, 4800)
    layout = spark.createDataFrame([(1, 0, 100, 9600)], "video_id long, segment_id long, place long, written long")
    takes = spark.createDataFrame([(1, 0, bytearray(tone.tobytes()))], "video_id long, segment_id long, pcm binary")
    videos = spark.createDataFrame([(1, 1_500_000)], "video_id long, duration_us long")
    blocks = audio.assemble_track(layout, takes, videos, block_s=1).orderBy("block").collect()
    assert [len(b.pcm) // 2 for b in blocks] == [48000, 24000]
    assert (np.frombuffer(bytes(blocks[0].pcm), "<i2")[700:9000] == tone[600:8900]).all()


def test_terms_are_literal_and_ordered(spark):
    df = spark.createDataFrame([("the C++ (x)", "the C++ (x)")], "en string, zh string")
    terms = F.array(*[F.struct(F.lit(e).alias("en"), F.lit(z).alias("zh")) for e, z in [("c++", "$1\\x"), ("x", "y"), ("(x)", "z")]])
    assert df.select(T.apply_terminology(F.col("en"), F.col("zh"), terms)).first()[0] == "the $1\\x z"


def test_overlapping_pairs_match_all_pairs(spark):
    rng = np.random.default_rng(2)
    rows = [(int(rng.integers(3)), k, k, int(a), int(a + rng.choice([-5, 0, 1, 3, 40, 700, 10**7]))) for k, a in enumerate(rng.integers(-200, 3000, 300))] + [(1, 400, 400, 2**52, 2**52 + 1), (1, 401, 401, 2**52, 2**52 + 2)]
    got = C.overlapping_pairs(spark.createDataFrame([*rows, (1, None, 0, 0, 9), (None, 7, 7, 0, 9), (2, 500, 5, None, 9)], "video_id long, cue_id long, pos long, start_us long, end_us long")).collect()
    want = [(a[0], a[1], b[1], b[3], max(0, min(a[4], b[4]) - b[3])) for a in rows for b in rows if a[0] == b[0] and (a[3], a[2]) < (b[3], b[2]) and b[3] < a[4]]
    assert sorted(map(tuple, got)) == sorted(want)


def test_odd_stamps_and_lines_of_documents():
    srt = lambda text: [(c["start_us"], c["end_us"], c["text"]) for c in S.parse_srt_text(text)]
    assert srt("0:00:01,5 --> 0:00:02,50\na\n\n1:02,500 --> 101:2:3.004\nb<>\n") == [(1_005_000, 2_050_000, "a"), (62_500_000, 363_723_004_000, "b<>")]
    assert srt("00:01.000-->00:02.000\na\n\n 00:01.000 --> 00:02.000\na\n\n00:01.0000 --> 00:02.000\na\n\n١:01.000 --> 00:02.000\na") == []
    assert [c["text"] for c in S.parse_srt_text("1\r\n00:01.000 --> 00:02.000\r\na\u2028b\x85c\rd\r\n\u3000\r\nno")] == ["a\u2028b\x85c\rd"]
    ass = lambda text: [(c["start_us"], c["text"], c["raw_style"]) for c in S.parse_ass_text(text)]
    assert ass("[Events]\nDialogue: 0,0:00:01.00,0:00:02.00,D,,0,0,0,,no") == []
    assert ass("[events]\r\nFormat: Text, Start, End, Text\nDialogue: a,0:00:01.00,0:00:02.00,x,y\n[Fonts]\nDialogue: b,0:00:01.00,0,x") == [(1_000_000, "a", None)]
    assert ass("[Events]\nFormat: Start, End, Style, Text\nDialogue: 0:00:01.5,0:00:02.00, ,a\u2028b\x0bc\nDialogue: 0:00:00.50") == [(0, "a\u2028b\x0bc", "")]


def test_lengths_are_in_utf16_units():
    assert len(R.partition_text("😀" * 25 + "，" + "😀" * 25)) == 2  # 101 units
    assert R.partition_text("😀" * 3) == ["😀" * 3] and R.partition_text("😀😀😀。好。") == ["😀😀😀。好。"[:3] + "，好。"]
    assert R.balanced(["😀😀", "abc", "defgh"], 1_700_000) == ["😀😀", "abc，defgh"]
    assert R.split_over("😀😀 ab", [1, 1]) == ["😀", "😀 ab"] or "".join(R.split_over("😀😀 ab", [1, 1])).replace(" ", "") == "😀😀ab"
    assert R.split_over("😀", [1, 1]) == ["\ufffd", "\ufffd"]


def test_errors_without_a_message(spark):
    rows = spark.createDataFrame([(m,) for m in ("Error", "error", "AggregateError", "", None, "Error: x")], "m string")
    got = [(r.c.reason, r.c.action) for r in rows.select(T.classify_error(F.lit("odd"), F.col("m")).alias("c")).collect()]
    assert got == [("failed", "see the log")] * 5 + [("Error: x", None)]


def test_lone_files_are_taken_only_if_they_are_english_and_nothing_matches(spark):
    from cueloom.plans import jobs

    english, other = "The lesson goes on with what you know.\n" * 12, "这是一个句子没有英文\n" * 12
    files = [("a", "x.srt", ".srt", english), ("b", "x.srt", ".srt", other), ("c", "v.zh.srt", ".srt", other), ("d", "x.srt", ".srt", english), ("d", "y.srt", ".srt", english), ("e", "x.srt", ".srt", english), ("f", "v.srt", ".srt", None)]
    videos = [(d, "v") for d in "abcdf"] + [("e", "v"), ("e", "w")]
    made = jobs.choose_subtitles(spark.createDataFrame(videos, "dir string, stem string"), spark.createDataFrame(files, "dir string, filename string, ext string, content string"))
    assert sorted(map(tuple, made.collect())) == [("a", "v", "x.srt", "lone"), ("c", "v", "v.zh.srt", "pattern"), ("f", "v", "v.srt", "exact")]


def test_repartitioned_cues_match_a_plain_version(spark):
    rng = np.random.default_rng(11)
    words = ["你好。", "这是一个句子，", "很长的一句话没有标点", "hello ", "world. ", "", "😀！", "吗？"]
    cues, segments, at = [], [], 0
    for k in range(90):
        length = int(rng.integers(1, 60)) * 100_000
        cues.append((k % 3, k * 2 - 20, k, at, at + length, "".join(rng.choice(words, int(rng.integers(0, 9))))))
        at += length
    cues += [(0, 500, 90, 5, 9, "twice"), (0, 500, 91, 5, 9, "twice")]  # of no segment
    for v in range(3):
        ids = [c[1] for c in cues[:90] if c[0] == v]
        segments += [(v, k // 4, ids[k : k + 4] + ([9999] if k == 8 else [])) for k in range(0, 24, 4)]
    got = R.repartition_cues(spark.createDataFrame(cues, "video_id long, cue_id long, pos long, start_us long, end_us long, text string"), spark.createDataFrame(segments, "video_id long, segment_id long, cue_ids array<long>"))
    want, claimed = [], {(v, c) for v, _, ids in segments for c in ids}
    for v in range(3):
        by_id, number = {c[1]: c for c in cues if c[0] == v}, max(0, *[c[1] for c in cues if c[0] == v])
        for _, _, ids in sorted(s for s in segments if s[0] == v):
            own = [by_id[i] for i in ids if i in by_id]
            joined = ""
            for t in (c[5].strip() for c in own):
                stick = joined and t and R._WORD.match(joined[-1]) and R._WORD.match(t[0])
                joined += (" " if stick else "") + t
            parts = R.balanced(R.partition_text(joined), own[-1][4] - own[0][3])
            sizes, done = [len(p.encode("utf-16-le")) // 2 for p in parts], 0
            for k, p in enumerate(parts):
                number += 1
                span = own[-1][4] - own[0][3]
                a, done = done, done + sizes[k]
                want.append((v, number, own[0][3] + int(span * a / sum(sizes) + 0.5), own[-1][4] if k == len(parts) - 1 else own[0][3] + int(span * done / sum(sizes) + 0.5), p))
        want += [(v, c[1], c[3], c[4], c[5]) for c in cues if c[0] == v and (v, c[1]) not in claimed]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_segments_that_carry_times_and_texts_map_without_a_shuffle(spark, sf_dir):
    cues = table(spark, sf_dir, "cues")
    terms = F.array(F.struct(F.lit("the").alias("en"), F.lit("这").alias("zh")))
    segments = C.build_segments(C.group_by_gap(cues), times=True).withColumn("text", F.translate("text_en", "aeiou", "的一是在不"))
    apart = X.map_translations_to_cues(cues, segments.drop("text", "cues"), segments.select("video_id", "segment_id", "text"), terms)
    carried = X.map_translations_to_cues(None, segments, None, terms)
    assert sorted(carried.collect()) == sorted(apart.collect()) == sorted(X.map_translations_to_cues(cues, segments.drop("cues"), None, terms).collect())
    plan = Q.QUERIES["map_translations_to_cues"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 2 and "Join" not in plan  # the cues' own, and one after their groups are counted


def _shuffles(spark, name, sf_dir):
    """How many shuffles of a query write rows."""
    from pathlib import Path

    found = lambda: {p.name.split("_")[1] for p in Path(spark.conf.get("spark.local.dir")).rglob("shuffle_*.data") if p.stat().st_size}
    before = found()
    Q.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return len(found() - before)


def test_retimed_cues_are_dealt_by_segment_once(spark, sf_dir):
    assert _shuffles(spark, "retime_cues", sf_dir) <= 3  # lines by video, cues by segment, their times for the spans; 4 before


def test_splits_that_carry_their_texts_are_validated_without_a_join(spark, sf_dir):
    items = spark.createDataFrame([(1, k, t) for k, t in enumerate(["a b, c.", "a b", "", "x"])], "video_id long, segment_id long, text string")
    lines = spark.createDataFrame([(1, 0, 1, ["a b", "c"]), (1, 0, 0, ["a b c"]), (1, 1, 0, ["a", " "]), (1, 1, 1, ["a"]), (1, 2, 0, []), (1, 3, 0, ["x", None]), (1, 3, 2, ["x"]), (1, 9, 0, ["x"])], "video_id long, segment_id long, k long, lines array<string>")
    apart = X.validate_split_responses(lines, items)
    carried = X.validate_split_responses(lines.join(items, ["video_id", "segment_id"]).withColumn("key", F.col("k") * 10), None)
    assert sorted(map(tuple, apart.collect())) == [(1, 0, ["a b c"]), (1, 3, ["x"])]
    assert sorted((*r[:2], r.lines, r.key) for r in carried.collect()) == [(1, 0, ["a b c"], 0), (1, 3, ["x"], 20)]
    assert _shuffles(spark, "display_splits", sf_dir) <= 5  # 11 or 12 before
