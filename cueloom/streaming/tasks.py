"""Task events as streams: the same folds as the batch operators, over keyed state.

The state of a task lies in the state store (RocksDB, see `cueloom.session`), so a micro-batch reads and writes only
the tasks that it has rows of. What changed leaves the stateful operator as rows and is added to a keyed table.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from cueloom.operators.tasks import LOG, deciding_fields, fold_task_events, fold_task_log
from cueloom.sources.keyed import KeyedTable

EVENTS = "task_id long, seq long, status string, progress long, detail string"
EVENT_STATE = "task_id long, seq long, status string, progress long, detail string, error string"
LOG_STATE = "task_id long, seq long, status string, progress long, detail string, error string, error_detail string, issues array<struct<id:long,text:string,max_chars:int>>, countdown long, subtitle_path string"
#: Parts that a table of states gathers before they are written as one.
PARTS = 16


def read_events(spark, path: str, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


class _Idle(StatefulProcessor):
    """A task that has had no rows for `idle_ms` loses its state, so the store holds live tasks only; None keeps
    all. Timers go by processing time, as events have no time of their own; a query with timers runs until stopped."""

    def __init__(self, idle_ms: int | None):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle

    def wait(self, timer_values) -> None:
        if self.idle_ms is None:
            return
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at if isinstance(at, int) else at[0])
        self.handle.registerTimer(timer_values.getCurrentProcessingTimeInMs() + self.idle_ms)

    def forget(self) -> None:
        raise NotImplementedError

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.forget()
        return iter([])


class _Throttle(_Idle):
    """Rows whose ratio is `step` above the last one let through; the state is that ratio."""

    def __init__(self, step: float, idle_ms: int | None):
        super().__init__(idle_ms)
        self.step = step

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.last = handle.getValueState("last", "ratio double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values("seq")
        last = self.last.get()[0] if self.last.exists() else None
        keep = []
        for r in batch["ratio"]:
            go = last is None or r - last >= self.step
            keep.append(go)
            last = r if go else last
        self.last.update((float(last),))
        self.wait(timerValues)
        yield batch[keep]

    def forget(self) -> None:
        self.last.clear()


class _Deciding(_Idle):
    """For every field of a task the row of the greatest seq that sets it; the rows of a task that came up are
    handed on. The state is a map from fields to rows."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.rows = handle.getMapState("deciding", "field string", "seq long, row string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        best: dict[str, tuple[int, str]] = {}
        for batch in rows:
            for seq, fields, row in zip(batch["seq"], batch["fields"], batch["row"]):
                for f in fields.split(","):
                    if f not in best or best[f] < (seq, row):
                        best[f] = int(seq), row
        held = {k[0]: (int(v[0]), v[1]) for k, v in self.rows.iterator()}
        for f, found in best.items():
            if f not in held or held[f] < found:
                self.rows.updateValue((f,), found)
                held[f] = found
        self.wait(timerValues)
        yield pd.DataFrame({"row": sorted({row for _, row in held.values()})})

    def forget(self) -> None:
        self.rows.clear()


def _mode(idle_ms: int | None) -> str:
    return "None" if idle_ms is None else "ProcessingTime"


def throttle_progress_stream(events: DataFrame, step: float = 0.005, idle_ms: int | None = None) -> DataFrame:
    """Progress rows (task_id, seq, ratio) at least `step` above the last one let through. Within a
    micro-batch rows go in order of seq; rows without ratio are dropped."""
    chosen = events.select("task_id", "seq", "ratio").filter("ratio IS NOT NULL").groupBy("task_id")
    return chosen.transformWithStateInPandas(_Throttle(step, idle_ms), "task_id long, seq long, ratio double", "Append", _mode(idle_ms))


def _changes(rows: DataFrame, schema: str, fields, idle_ms: int | None) -> DataFrame:
    """The deciding rows of the tasks that a micro-batch has rows of; `fields` names what a row sets."""
    sent = rows.select("task_id", "seq", fields.alias("fields"), F.to_json(F.struct(*rows.columns)).alias("row"))
    held = sent.groupBy("task_id").transformWithStateInPandas(_Deciding(idle_ms), "row string", "Update", _mode(idle_ms))
    return held.select(F.from_json("row", schema).alias("r")).select("r.*")


def _kept(changes: DataFrame, fold, path: str, schema: str, checkpoint: str, idle_ms: int | None):
    """Add the folded states of each micro-batch's tasks to the keyed table at `path`; a repeated batch adds nothing.

    The query takes in what is there and ends; with `idle_ms` it goes on until it is stopped, for its timers."""
    trigger = {"availableNow": True} if idle_ms is None else {"processingTime": "10 seconds"}

    def upsert(batch: DataFrame, version: int) -> None:
        table = KeyedTable(batch.sparkSession, path, schema, ["task_id"])
        table.upsert(fold(batch), f"{checkpoint}#{version}")
        if table.parts() > PARTS:
            table.compact()
            table.vacuum()

    return changes.writeStream.foreachBatch(upsert).outputMode("update").option("checkpointLocation", checkpoint).trigger(**trigger).start()


def fold_events_stream(events: DataFrame, path: str, checkpoint: str, idle_ms: int | None = None):
    """Keep the current state of every task at `path`, as `fold_task_events` gives it. Returns the started query.

    Only states of tasks with new events are written. A task forgotten after `idle_ms` starts anew with its next
    event; its last state stays at `path` until then."""
    return _kept(_changes(events, EVENTS, F.lit("status"), idle_ms), fold_task_events, path, EVENT_STATE, checkpoint, idle_ms)


def folded(spark: SparkSession, path: str) -> DataFrame:
    return KeyedTable(spark, path, EVENT_STATE, ["task_id"]).read()


def fold_log_stream(log: DataFrame, path: str, checkpoint: str, idle_ms: int | None = None):
    """Keep the current state of every task of a log (LOG's columns) at `path`, as `fold_task_log` gives it,
    whatever the order its rows come in. Returns the started query; the rest as `fold_events_stream`."""
    return _kept(_changes(log, LOG, deciding_fields(), idle_ms), fold_task_log, path, LOG_STATE, checkpoint, idle_ms)


def folded_log(spark: SparkSession, path: str) -> DataFrame:
    return KeyedTable(spark, path, LOG_STATE, ["task_id"]).read()
