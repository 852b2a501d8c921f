"""Job events to the latest state of each job, as a batch and as a stream; expiry after a restart."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .states import plain_rows, stored, use_state_store

STATE = "job_id bigint, status string, stage string, progress_percent int, progress_message string, error_message string, cost_usd double, completed_at timestamp"
INTERRUPTED = "interrupted by a restart"


def job_state(events: DataFrame) -> DataFrame:
    """The state of each job after its events (job_id, seq, event_time, event_type, stage, percent, message, cost_usd).

    `progress` sets stage, percent and message; the first `result` completes and the first `error` fails the job, and nothing
    after it counts. One pass of maxima: no job's events are gathered.
    """
    order = F.struct("event_time", "seq")
    terminal = F.col("event_type").isin("result", "error")
    end = events.where(terminal).groupBy("job_id").agg(F.min_by(F.struct("event_type", "message", "cost_usd", "event_time"), order).alias("end"), F.min(order).alias("at"))
    live = events.where(~terminal).join(end.select("job_id", "at"), "job_id", "left").where(F.col("at").isNull() | (order < F.col("at")))
    latest = live.groupBy("job_id").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), order)).alias(c) for c in ("stage", "percent", "message")])
    rows = events.select("job_id").distinct().join(latest, "job_id", "left").join(end, "job_id", "left")
    kind = F.col("end.event_type")
    return rows.select(
        "job_id",
        F.when(kind == "result", "completed").when(kind == "error", "failed").otherwise("running").alias("status"),
        "stage",
        F.when(kind == "result", 100).otherwise(F.col("percent")).cast("int").alias("progress_percent"),
        F.col("message").alias("progress_message"),
        F.when(kind == "error", F.col("end.message")).alias("error_message"),
        F.when(kind == "result", F.col("end.cost_usd")).alias("cost_usd"),
        F.col("end.event_time").alias("completed_at"),
    )


#: The state of a job under way, and of one that has ended.
LIVE, DONE = "stage string, percent int, message string", "status string"
START = (None, None, None)


class _Jobs(StatefulProcessor):
    """Two variables for each job: `live` while it is under way, and `done`, which lets late events pass by until it expires. A timer ends silent jobs."""

    def __init__(self, silence_ms: int | None, keep_ms: int | None):
        self.silence_ms, self.keep_ms = silence_ms, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.live = handle.getValueState("live", LIVE)
        self.done = handle.getValueState("done", DONE, self.keep_ms)

    def close(self) -> None:
        pass

    def _row(self, job, status, live, error=None, cost=None, at=None) -> pd.DataFrame:
        stage, percent, message = live
        return pd.DataFrame({"job_id": [job], "status": [status], "stage": [stage], "progress_percent": pd.array([percent], "Int32"), "progress_message": [message], "error_message": [error], "cost_usd": [cost], "completed_at": [at]})

    def _wait(self, timers) -> None:
        for t in self.handle.listTimers():
            self.handle.deleteTimer(t)
        if self.silence_ms and timers:
            self.handle.registerTimer(timers.getCurrentProcessingTimeInMs() + self.silence_ms)

    def _end(self, status: str) -> None:
        self.live.clear()
        self.done.update((status,))
        if self.silence_ms:
            self._wait(None)

    def handleInitialState(self, key, initialState, timerValues) -> None:  # noqa: N802, N803
        r = plain_rows([initialState], [])[0]
        if r["status"] == "running":
            self.live.update((r["stage"], None if r["progress_percent"] is None else int(r["progress_percent"]), r["progress_message"]))
            if self.silence_ms:
                self._wait(timerValues)
        else:
            self.done.update((r["status"],))

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        events = plain_rows(rows, ["event_time", "seq"])
        if self.done.exists():
            return
        stage, percent, message = self.live.get() if self.live.exists() else START
        for r in events:
            if r["event_type"] in ("result", "error"):
                fine = r["event_type"] == "result"
                status = "completed" if fine else "failed"
                self._end(status)
                yield self._row(key[0], status, (stage, 100 if fine else percent, message), None if fine else r["message"], r["cost_usd"] if fine else None, r["event_time"])
                return
            stage, message = (x if x is not None else old for x, old in ((r["stage"], stage), (r["message"], message)))
            percent = percent if r["percent"] is None else int(r["percent"])
        self.live.update((stage, percent, message))
        if self.silence_ms:
            self._wait(timerValues)
        yield self._row(key[0], "running", (stage, percent, message))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        if self.live.exists():
            live = self.live.get()
            self._end("failed")
            yield self._row(key[0], "failed", live, INTERRUPTED)


def job_state_stream(events: DataFrame, silence_ms: int | None = None, keep_ms: int | None = None, initial: DataFrame | None = None) -> DataFrame:
    """The stream twin of job_state in update mode: a row for each job that had events, until its last one.

    With silence_ms a job that is silent for so long fails; such a stream needs a trigger that goes on, as it waits for the clock. With keep_ms the state
    of an ended job is dropped so long after its end; an event that comes later still would open the job again. Without it that state, one word, stays. initial: states (STATE, one row for each job) that the stream
    begins with, as job_state or stored_jobs gives them.
    """
    use_state_store(events.sparkSession)
    mode = "processingTime" if silence_ms or keep_ms else "none"
    begin = None if initial is None else initial.groupBy("job_id")
    return events.groupBy("job_id").transformWithStateInPandas(_Jobs(silence_ms, keep_ms), STATE, "update", mode, begin)


def stored_jobs(spark: SparkSession, checkpoint: str) -> DataFrame:
    """STATE of the jobs that were under way when their stream stopped."""
    null = lambda c, kind: F.lit(None).cast(kind).alias(c)
    live = stored(spark, checkpoint, "live")
    return live.select(F.col("job_id").cast("bigint").alias("job_id"), F.lit("running").alias("status"), "stage", F.col("percent").alias("progress_percent"), F.col("message").alias("progress_message"), null("error_message", "string"), null("cost_usd", "double"), null("completed_at", "timestamp"))


def reconcile_after_restart(jobs: DataFrame, videos: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Running jobs are failed; videos being analysed are `analyzed` if they have an analysis, else `pending`."""
    running = F.col("status") == "running"
    j = jobs.withColumn("error_message", F.when(running, INTERRUPTED).otherwise(F.col("error_message"))).withColumn("status", F.when(running, "failed").otherwise(F.col("status")))
    busy = F.col("status") == "analyzing"
    status = F.when(busy & F.col("analyzed_at").isNotNull(), "analyzed").when(busy, "pending").otherwise(F.col("status"))
    return j, videos.withColumn("pipeline_stage", F.when(busy, F.lit(None)).otherwise(F.col("pipeline_stage"))).withColumn("status", status)


def latest_rows(rows: DataFrame, key: str, order: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
