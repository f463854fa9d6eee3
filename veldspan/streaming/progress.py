"""Structured Streaming forms of the monitoring operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def stream_table(spark: SparkSession, path: str, per_batch: int | None = None) -> DataFrame:
    """A stream of the Parquet table at ``path``, whole: a file, a folder of files or a partitioned table.

    Files come in the order they were written, ``per_batch`` of them a batch, or all that are there.
    """
    schema = spark.read.parquet(path).schema
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    name = at.getName()
    one_file = not at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory()
    reader = spark.readStream.schema(schema)
    if per_batch:
        reader = reader.option("maxFilesPerTrigger", per_batch)
    # a stream reads folders: of a table that is one file, the folder with the file's name as a filter
    return reader.option("pathGlobFilter", name).parquet(str(at.getParent())) if one_file else reader.parquet(path)


def daily_totals(events: DataFrame, ts: str, key: str, value: str, late: str = "1 day") -> DataFrame:
    """Tumbling one-day windows per key; rows later than ``late`` are dropped when streaming."""
    timed = events.withColumn(ts, F.col(ts).cast("timestamp"))
    return (
        timed.withWatermark(ts, late)
        .groupBy(F.window(ts, "1 day"), key)
        .agg(F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col(value) * 100).cast("long")).alias("cents"))
        .select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), key, "n", "cents")
    )


def run_lengths(events: DataFrame, key: str, bad: str, alert_at: int) -> DataFrame:
    """(key, run, alert) for each micro-batch: the current run of bad points; alerts once, on reaching ``alert_at``.

    Points of a key are taken in the order they arrive; ``run_alerts`` orders them.
    """
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    def step(group, parts, state):
        run = state.get[0] if state.exists else 0
        alert = False
        for part in parts:
            for value in part[bad]:
                run = run + 1 if value else 0
                alert |= run == alert_at
        state.update((run,))
        yield pd.DataFrame({"key": [str(group[0])], "run": [run], "alert": [alert]})

    return events.groupBy(key).applyInPandasWithState(step, "key string, run long, alert boolean", "run long", "append", GroupStateTimeout.NoTimeout)


def run_alerts(points: DataFrame, key: str, ts: str, order: str, bad: str, alert_at: int, late: str, idle: str | None = None) -> DataFrame:
    """(key, order, at, run): one row each time a run of bad points of a key reaches ``alert_at``, in the order of event time.

    Points may arrive in any order within ``late``: a point waits in the key's state until the watermark has
    passed it, and then joins the run by (ts, order), whole numbers; a null flag is not bad.  Points that come later than that, and
    points without a time, are dropped.  A key that is silent for ``idle`` forgets its run.  Needs the state store ``ROCKS``.
    """
    import pandas as pd
    from pyspark.sql.streaming import StatefulProcessor

    pause = int(pd.Timedelta(idle).total_seconds() * 1000) if idle else None

    class Runs(StatefulProcessor):
        def init(self, handle):
            self.handle = handle
            self.waiting = handle.getListState("waiting", "us long, place long, bad boolean")
            self.run = handle.getValueState("run", "run long, last long")
            self.now, self.settled = None, set()  # keys that have been brought up to this watermark

        def handleInputRows(self, key, rows, timerValues):
            fresh = []
            for part in rows:
                fresh.extend(zip(part["point_us"].tolist(), part["point_place"].tolist(), part["point_bad"].tolist()))
            self.waiting.appendList(fresh)
            self.wake(fresh)
            return iter(())

        def wake(self, points):
            """A timer for the first bad point: a point that is not bad ends in no alert, and what is due is taken all at once."""
            first = min((us for us, _, is_bad in points if is_bad), default=None)
            if first is not None:
                self.handle.registerTimer(first // 1000 + 1)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            now = timerValues.getCurrentWatermarkInMs() * 1000
            if now != self.now:
                self.now, self.settled = now, set()
            if key in self.settled:
                return
            self.settled.add(key)
            held = sorted(self.waiting.get())
            due = [p for p in held if p[0] < now]
            if not due:
                return
            later = held[len(due) :]
            self.waiting.put(later) if later else self.waiting.clear()
            self.wake(later)
            run, last = self.run.get() or (0, None)
            alerts = []
            for us, place, is_bad in due:
                if pause is not None and last is not None and us - last > pause * 1000:
                    run = 0
                run, last = run + 1 if is_bad else 0, us
                if run == alert_at:
                    alerts.append((None if key[0] is None else str(key[0]), place, us, run))
            self.run.update((run, last))
            if alerts:
                yield pd.DataFrame(alerts, columns=["key", "place", "us", "run"])

        def close(self):
            pass

    at = F.col(ts).cast("timestamp")
    plain = [F.unix_micros(at).alias("point_us"), F.col(order).cast("long").alias("point_place"), F.coalesce(F.col(bad), F.lit(False)).alias("point_bad")]
    timed = points.filter(F.col(ts).isNotNull()).select(key, at.alias(ts), *plain).withWatermark(ts, late)
    out = timed.groupBy(key).transformWithStateInPandas(Runs(), "key string, place long, us long, run long", "Append", "EventTime")
    return out.select("key", F.col("place").alias(order), F.timestamp_micros("us").alias("at"), "run")


def drain(spark: SparkSession, stream: DataFrame, mode: str = "complete", store: str | None = None) -> DataFrame:
    """Runs a stream over what is there now and returns the sink's rows; ``store`` is the state store to use (``ROCKS`` for timers and lists)."""
    name = f"drain_{uuid.uuid4().hex}"
    had = spark.conf.get(PROVIDER, None)
    if store:
        spark.conf.set(PROVIDER, store)
    try:
        stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start().awaitTermination()
    finally:
        if store:
            spark.conf.set(PROVIDER, had) if had else spark.conf.unset(PROVIDER)
    return spark.table(name)


def is_written(spark: SparkSession, path: str) -> bool:
    """Whether a job that wrote ``path`` came to its end."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def once(root: str, make: Callable[[DataFrame], DataFrame] = lambda batch: batch):
    """A function for foreachBatch that writes ``make(batch)`` to ``root/batch=N``, once however often the batch runs.

    A batch that runs again after its write was finished is skipped; one whose write broke off is written anew.
    """

    def write(batch: DataFrame, number: int) -> None:
        path = f"{root.rstrip('/')}/batch={number}"
        if not is_written(batch.sparkSession, path):
            make(batch).write.mode("overwrite").parquet(path)

    return write


def publish(stream: DataFrame, dashboard: str, history: str, checkpoint: str, mode: str = "complete", every: str | None = None):
    """Starts a query that writes each micro-batch as the dashboard's next version and adds a line (rows) to the history.

    Both are written once a batch, so a restart from ``checkpoint`` changes nothing that is there; ``latest`` reads the newest
    dashboard.  ``every`` polls at that interval until the query is stopped; without it what is there now is processed.
    """
    board = once(dashboard)

    def write(batch: DataFrame, number: int) -> None:
        board(batch, number)
        written = batch.sparkSession.read.parquet(f"{dashboard.rstrip('/')}/batch={number}")
        once(history, lambda rows: rows.agg(F.count(F.lit(1)).alias("rows")))(written, number)

    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(write)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def latest(spark: SparkSession, dashboard: str) -> DataFrame:
    """The dashboard as the last finished batch has left it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(dashboard)
    names = [f.getPath().getName() for f in at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at)]
    done = [int(n.split("=")[1]) for n in names if n.startswith("batch=") and is_written(spark, f"{dashboard.rstrip('/')}/{n}")]
    return spark.read.parquet(f"{dashboard.rstrip('/')}/batch={max(done)}")


def log_states(lines: DataFrame, run: str, at: str, line: str) -> DataFrame:
    """(run, lines, last_line, crashes, finished): the state of each run from its log lines so far; for streams in complete mode."""
    from ..functions.text import crashed

    return lines.groupBy(run).agg(
        F.count(F.lit(1)).alias("lines"),
        F.max_by(line, at).alias("last_line"),
        F.count_if(crashed(F.col(line))).alias("crashes"),
        F.max(F.col(line).startswith("Training finished")).alias("finished"),
    )
