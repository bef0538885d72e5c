"""The subtitle data source in batch, as a stream and as a sink."""

import os
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cueloom.plans.fixtures import table
from cueloom.sources import files as FS
from cueloom.sources import subtitles as S


@pytest.fixture(autouse=True)
def registered(spark):
    FS.register(spark)


def _folder(tmp_path):
    names = {"a/x.SRT": "1\n00:00:01,000 --> 00:00:02,000\nHi\n", "a/y.ass": "[Events]\n", "b c/é +%20.vtt": "WEBVTT\n", "b c/z.mp4": "", "_temporary-1/q.srt": "no", ".hid/r.srt": "no", "b c/plain": ""}
    for name, text in names.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    (tmp_path / "a" / "bad.ssa").write_bytes(b"\xff\xfe[Events]")
    return str(tmp_path)


def test_reads_subtitle_files_by_size_and_extension(spark, tmp_path):
    path = _folder(tmp_path)
    read = lambda **o: spark.read.format("subtitles").options(path=path, **o).load()
    got = {(r.dir, r.filename): (r.ext, r.content) for r in read().collect()}
    assert sorted(got) == [("a", "bad.ssa"), ("a", "x.SRT"), ("a", "y.ass"), ("b c", "é +%20.vtt")]
    assert got["a", "x.SRT"][0] == ".srt" and got["a", "bad.ssa"][1] == "��[Events]"
    assert read(partFiles="1").rdd.getNumPartitions() == 4 and read().rdd.getNumPartitions() == 1
    assert read(partBytes="50").rdd.getNumPartitions() == 2
    assert [r.filename for r in read().filter("ext = '.ass'").collect()] == ["y.ass"]
    assert sorted(r.filename for r in read().filter("ext IN ('.ass', '.vtt') AND dir <> 'q'").collect()) == ["y.ass", "é +%20.vtt"]
    same = S.read_subtitle_files(spark, path).filter("ext <> '.ssa' AND content <> 'no'").collect()
    assert {(r.dir, r.filename): (r.ext, r.content) for r in same} == {k: v for k, v in got.items() if k[1] != "bad.ssa"}
    assert spark.read.format("subtitles").load(str(tmp_path / "nothing")).count() == 0


def test_filters_on_extensions_never_open_other_files(tmp_path):
    reader = FS.Reader(FS._Options({"path": _folder(tmp_path)}))
    rest = list(reader.pushFilters([FS.EqualTo(("ext",), ".ass"), FS.EqualTo(("dir",), "a"), FS.In(("ext",), (".ass", ".srt"))]))
    assert rest == [FS.EqualTo(("dir",), "a")] and [f.rpartition("/")[2] for p in reader.partitions() for f in p.files] == ["y.ass"]


def test_stream_takes_each_file_once_also_after_a_restart(spark, tmp_path):
    path, out, checkpoint = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "c")
    os.mkdir(path)

    def add(*names):
        for n in names:
            (tmp_path / "in" / n).write_text(n)
        time.sleep(0.05)

    def run():
        rows = spark.readStream.format("subtitles").option("path", path).option("settleSeconds", "0").load()
        rows.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out).awaitTermination(60)

    add("1.srt", "2.vtt", "no.txt")
    run()
    add("3.ass")
    run()
    run()
    assert sorted(r.content for r in spark.read.parquet(out).collect()) == ["1.srt", "2.vtt", "3.ass"]


def test_files_still_being_written_wait(tmp_path):
    (tmp_path / "1.srt").write_text("x")
    reader = FS.StreamReader(FS._Options({"path": str(tmp_path), "settleSeconds": "60"}))
    assert reader.latestOffset() == reader.initialOffset()


def test_documents_written_and_read_back(spark, tmp_path, sf_dir):
    cues = table(spark, sf_dir, "cues").filter("video_id < 40")
    path = str(tmp_path / "out")
    name = F.concat(F.lit("v"), F.col("video_id").cast("string"), F.lit("/subs.srt"))
    FS.write_documents(FS.srt_rows(cues), path, name)
    want = {f"v{r.video_id}": r.srt for r in S.render_srt(cues).collect()}
    assert {r.dir: r.content for r in spark.read.format("subtitles").load(path).collect()} == want
    videos = cues.select("video_id").distinct().withColumn("width", F.lit(1280)).withColumn("height", F.lit(720)).unionByName(spark.createDataFrame([(10**6, 0, 0)], "video_id long, width int, height int"))
    FS.write_documents(S.ass_rows(cues, videos), path, F.concat(F.col("video_id").cast("string"), F.lit(".ass")), overwrite=True)
    got = {r.filename: r.content for r in spark.read.format("subtitles").load(path).collect()}
    assert got == {f"{r.video_id}.ass": r.ass for r in S.render_ass(cues, videos).collect()}


def _batch(*rows):
    return pa.RecordBatch.from_pylist([{"filename": a, "text": b} for a, b in rows], pa.schema([("filename", pa.string()), ("text", pa.string())]))


def test_retried_and_failed_tasks_leave_no_file(tmp_path):
    writer = FS.Writer(FS._Options({"path": str(tmp_path)}), overwrite=False)
    (tmp_path / "old.srt").write_text("old")
    first = writer.write(iter([_batch(("a.srt", "1"), ("a.srt", "2")), _batch(("a.srt", "3"), ("b.srt", None))]))
    again = writer.write(iter([_batch(("a.srt", "1"), ("a.srt", "2"), ("a.srt", "3"), ("b.srt", ""))]))  # the same task once more
    with pytest.raises(RuntimeError):
        writer.write(_failing())
    assert [f.path.rpartition("/")[2] for f in FS.subtitle_files(str(tmp_path))] == ["old.srt"]  # nothing is seen before the commit
    writer.commit([again, None])
    assert first.folder != again.folder
    assert {p.name: p.read_text() for p in tmp_path.rglob("*") if p.is_file()} == {"old.srt": "old", "a.srt": "123", "b.srt": ""}
    assert not any(p.name.startswith("_temporary") for p in tmp_path.iterdir())


def _failing():
    yield _batch(("c.srt", "half"))
    raise RuntimeError("lost")


def test_aborted_jobs_and_names_in_two_places(tmp_path):
    writer = FS.Writer(FS._Options({"path": str(tmp_path)}), overwrite=True)
    (tmp_path / "old.srt").write_text("old")
    writer.abort([writer.write(iter([_batch(("a.srt", "1"))]))])
    assert [p.name for p in tmp_path.iterdir()] == ["old.srt"]
    for rows in ([("a.srt", "1"), ("b.srt", "2"), ("a.srt", "3")], [("../a.srt", "1")], [("", "1")]):
        with pytest.raises(ValueError):
            writer.write(iter([_batch(*rows)]))
    writer.abort([])
    with pytest.raises(ValueError):
        writer.commit([writer.write(iter([_batch(("a.srt", "1"))])) for _ in range(2)])
    assert [p.name for p in tmp_path.iterdir()] == ["old.srt"]
    writer.commit([writer.write(iter([_batch(("a.srt", "1"))]))])
    assert [p.name for p in tmp_path.iterdir()] == ["a.srt"]
