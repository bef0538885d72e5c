"""Streams over keyed state, keyed tables and the cache."""

import json
import time

import pytest
from pyspark.sql import functions as F

from cueloom import rule_queries
from cueloom.operators import tasks as K
from cueloom.sources.keyed import KeyedTable
from cueloom.streaming import tasks as ST


@pytest.fixture(autouse=True)
def few_partitions(spark):
    """A state store for each partition and micro-batch takes its time."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def _texts(df):
    return sorted(json.dumps(r.asDict(True), sort_keys=True, default=str) for r in df.select(*sorted(df.columns)).collect())


def _add(spark, rows, schema, path):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(path))


def test_event_stream_stopped_and_started_again_equals_batch(spark, tmp_path):
    rows = [(k % 7, k, ["parsing", "error", "paused"][k % 3], k, f"d{k}") for k in range(90)]
    parts = [rows[60:75], rows[0:30], rows[75:90], rows[30:60]]  # late rows come, too
    for k, part in enumerate(parts):
        _add(spark, part, ST.EVENTS, tmp_path / "in")
        if k % 2:
            ST.fold_events_stream(ST.read_events(spark, str(tmp_path / "in")), str(tmp_path / "state"), str(tmp_path / "c")).awaitTermination(120)
    assert _texts(ST.folded(spark, str(tmp_path / "state"))) == _texts(K.fold_task_events(spark.read.parquet(str(tmp_path / "in"))))


def test_a_micro_batch_writes_only_its_own_tasks(spark, tmp_path):
    source, state = tmp_path / "in", str(tmp_path / "state")
    run = lambda: ST.fold_events_stream(ST.read_events(spark, str(source)), state, str(tmp_path / "c")).awaitTermination(120)
    _add(spark, [(k, k, "parsing", 1, "d") for k in range(50)], ST.EVENTS, source)
    run()
    _add(spark, [(7, 100, "completed", 100, "d"), (8, 1, "paused", 0, "late")], ST.EVENTS, source)
    run()
    table = KeyedTable(spark, state, ST.EVENT_STATE, ["task_id"])
    assert table.entries().count() == 52 and table.parts() == 2
    got = {r.task_id: (r.seq, r.status) for r in table.read().collect()}
    assert len(got) == 50 and got[7] == (100, "completed") and got[8] == (8, "parsing")


def test_log_stream_equals_batch_and_is_compacted(spark, tmp_path, sf_dir, monkeypatch):
    monkeypatch.setattr(ST, "PARTS", 2)
    log = rule_queries._log(spark, sf_dir)
    rows = log.orderBy("seq").collect()
    for part in range(4):
        _add(spark, rows[part::4], K.LOG, tmp_path / "in")
        source = spark.readStream.schema(K.LOG).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        ST.fold_log_stream(source, str(tmp_path / "state"), str(tmp_path / "c")).awaitTermination(120)
    assert _texts(ST.folded_log(spark, str(tmp_path / "state"))) == _texts(K.fold_task_log(log))
    assert KeyedTable(spark, str(tmp_path / "state"), ST.LOG_STATE, ["task_id"]).parts() <= 2


def _let_through(out, name, checkpoint):
    out.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(checkpoint)).start().awaitTermination(120)
    return sorted(map(tuple, out.sparkSession.table(name).collect()))


def test_progress_stream_equals_batch(spark, tmp_path):
    rows = [(k % 3, k, "encoding", (k * 7) % 100, "d") for k in range(60)]
    for part in range(3):
        _add(spark, rows[part * 20 : part * 20 + 20], ST.EVENTS, tmp_path / "in")
    with_ratio = lambda df: df.withColumn("ratio", F.when(F.col("seq") != 31, F.col("progress") / 100))
    want = sorted(map(tuple, K.throttle_progress(with_ratio(spark.read.parquet(str(tmp_path / "in"))).filter("ratio IS NOT NULL"), 0.1).collect()))
    assert _let_through(ST.throttle_progress_stream(with_ratio(ST.read_events(spark, str(tmp_path / "in"), 10)), 0.1), "kept", tmp_path / "c") == want


def _within(seconds, test):
    until = time.time() + seconds
    while not test() and time.time() < until:
        time.sleep(0.3)
    return test()


@pytest.mark.parametrize("idle_ms,seen", [(3_600_000, 1), (1, 2)])
def test_idle_tasks_are_forgotten(spark, tmp_path, idle_ms, seen):
    """The same ratio again is let through only after the task's state is gone."""
    _add(spark, [(1, 1, "encoding", 50, "d")], ST.EVENTS, tmp_path / "in")
    ratios = ST.read_events(spark, str(tmp_path / "in")).withColumn("ratio", F.col("progress") / 100)
    out = ST.throttle_progress_stream(ratios, 0.1, idle_ms=idle_ms)
    query = out.writeStream.format("memory").queryName(f"idle_{idle_ms}").outputMode("append").trigger(processingTime="0 seconds").option("checkpointLocation", str(tmp_path / "c")).start()
    batches = lambda: len({p["batchId"] for p in query.recentProgress})
    taken = lambda: sum(p["numInputRows"] for p in query.recentProgress)
    try:
        assert _within(40, lambda: taken() == 1)
        before = batches()
        assert _within(40, lambda: batches() >= before + 2)  # batches without rows run the timers
        _add(spark, [(1, 2, "encoding", 50, "d")], ST.EVENTS, tmp_path / "in")
        assert _within(40, lambda: taken() == 2)
    finally:
        query.stop()
    assert spark.table(f"idle_{idle_ms}").count() == seen


SCHEMA = "k long, task string, v string"


def _table(spark, path):
    return KeyedTable(spark, str(path), SCHEMA, ["k"])


def test_keyed_table_replaces_compacts_and_vacuums(spark, tmp_path):
    table, other = _table(spark, tmp_path), _table(spark, tmp_path)
    frame = lambda *rows: spark.createDataFrame(list(rows), SCHEMA)
    read = lambda **kw: sorted((r.k, r.v) for r in table.read(**kw).collect())
    assert read() == [] and table.upsert(frame((1, "t", "a"), (2, "t", "b")), "one") and not table.upsert(frame((1, "t", "x")), "one")
    table.upsert(frame((1, "u", "c"), (3, "t", None)))
    assert read() == [(1, "c"), (2, "b"), (3, None)]
    assert read(valid=F.col("v").isNotNull()) == [(1, "c"), (2, "b")]
    assert read(owners=spark.createDataFrame([("t",)], "task string")) == [(1, "a"), (2, "b"), (3, None)]
    open_before = table.entries()
    other.compact()
    assert read() == [(1, "c"), (2, "b"), (3, None)] and table.parts() == 1 and table.entries().count() == 3
    assert open_before.count() == 4  # a reader of the manifest before still has its parts
    table.upsert(frame((2, "t", "d")))
    other.compact()
    other.vacuum(0)
    assert read() == [(1, "c"), (2, "d"), (3, None)] and len(list((tmp_path / "parts").iterdir())) == 1
    assert len(list((tmp_path / "manifest").glob("*.json"))) == 1


def test_a_writer_that_dies_or_is_late_harms_no_reader(spark, tmp_path):
    table, late = _table(spark, tmp_path), _table(spark, tmp_path)
    frame = lambda *rows: spark.createDataFrame(list(rows), SCHEMA)
    table.upsert(frame((1, "t", "a")))
    (tmp_path / "manifest" / f"{2:020d}.json").write_text('{"parts": [["half')  # died while it wrote its manifest
    spark.createDataFrame([(9, "t", "lost")], SCHEMA).write.parquet(str(tmp_path / "parts" / "part-dead"))  # and its part
    assert [r.v for r in table.read().collect()] == ["a"]
    # another write gets in between reading the manifest and publishing the next one
    publish, seen = late._publish, []

    def second(change):
        if not seen:
            seen.append(table.upsert(frame((2, "t", "b"))))
        return publish(change)

    late._publish = second
    late.compact()
    assert sorted((r.k, r.v) for r in table.read().collect()) == [(1, "a"), (2, "b")]
    assert table.vacuum(0)


@pytest.mark.parametrize("n", [0, 5])
def test_empty_writes_are_writes(spark, tmp_path, n):
    table = _table(spark, tmp_path)
    table.upsert(spark.createDataFrame([(k, "t", "v") for k in range(n)], SCHEMA))
    table.compact()
    assert table.read().count() == n
