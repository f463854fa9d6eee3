"""Queries that run as streams over a table until it is read."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.scratch import scratch
from ..streaming import progress
from .registry import query


@query("""SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, sum(round(value * 100)::BIGINT)::BIGINT AS cents FROM events GROUP BY 1, 2""")
def daily_window_stream(t):
    stream = progress.stream_table(t.spark, t.path("events"))
    return progress.drain(t.spark, progress.daily_totals(stream, "ts", "event_type", "value"))


def in_batches(rows, path: str, batch, number: int) -> None:
    """Writes the rows as ``number`` files one after the other, those of batch i as the i-th; all tasks read, one writes the file."""
    for i in range(number):
        rows.filter(batch == i).repartition(1).write.mode("append").parquet(path)


@query("""WITH e AS (SELECT *, max(ts) OVER () AS latest, sum((event_type <> 'error')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id, island ORDER BY ts, event_id) AS run FROM e WHERE event_type = 'error')
SELECT user_id::VARCHAR AS key, event_id, ts AS at, 3::BIGINT AS run FROM r WHERE run = 3 AND epoch_ms(ts) < epoch_ms(latest) - 86400000 * 4""")
def run_alert_stream(t):
    """Alerts in the order of event time, from points that arrive up to three days late in three batches."""
    rows = t("events").withColumn("bad", F.col("event_type") == "error")
    first, last = rows.agg(F.min("ts"), F.max("ts")).first()
    days = F.datediff(F.col("ts"), F.lit(first)) + F.pmod(F.xxhash64("event_id"), F.lit(4))  # a point arrives up to three days after its time
    span = (last - first).days + 4
    path = scratch(t.spark, "late-points")
    in_batches(rows.select("user_id", "ts", "event_id", "bad"), path, F.least(F.floor(days * 3 / F.lit(span)), F.lit(2)), 3)
    stream = progress.stream_table(t.spark, path, 1)
    alerts = progress.drain(t.spark, progress.run_alerts(stream, "user_id", "ts", "event_id", "bad", 3, "4 days"), "append", progress.ROCKS)
    return alerts.withColumn("at", F.col("at").cast("timestamp_ntz"))


class Stopped(Exception):
    """Ends a stream in the middle of its work."""


@query("""SELECT event_id % 4 AS batch, count(*) AS n, sum(round(value * 100)::BIGINT)::BIGINT AS cents, 1::BIGINT AS files FROM events GROUP BY 1""")
def restarted_history(t):
    """A history of four batches; the stream is ended after a batch is written but not committed, and goes on from its checkpoint."""
    source, history, checkpoint = (scratch(t.spark, name) for name in ("batches", "history", "checkpoint"))
    in_batches(t("events"), source, F.col("event_id") % 4, 4)
    line = progress.once(history, lambda batch: batch.agg(F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents")))

    def broken(batch, number):
        line(batch, number)
        if number == 1:
            raise Stopped

    for write in (broken, line):
        stream = progress.stream_table(t.spark, source, 1)
        run = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()
        try:
            run.awaitTermination()
        except Exception as error:  # noqa: BLE001  Spark wraps what foreachBatch raises
            if "Stopped" not in str(error):
                raise
    rows = t.spark.read.parquet(history)
    return rows.groupBy(F.col("batch").cast("long").alias("batch")).agg(F.max("n").alias("n"), F.max("cents").alias("cents"), F.count(F.lit(1)).alias("files"))


@query("""SELECT user_id AS run, count(*) AS lines, 'it ' || max(event_id) || CASE arg_max(event_type, event_id) WHEN 'error' THEN ' loss:nan' ELSE ' loss:0.5' END AS last_line,
count(*) FILTER (WHERE event_type = 'error') AS crashes, false AS finished FROM events GROUP BY user_id""")
def log_dashboard(t):
    """Log lines polled in three batches: states of runs, the newest version of the dashboard."""
    said = F.concat(F.lit("it "), "event_id", F.when(F.col("event_type") == "error", F.lit(" loss:nan")).otherwise(F.lit(" loss:0.5")))
    source, board, history, checkpoint = (scratch(t.spark, name) for name in ("log-lines", "board", "board-history", "checkpoint"))
    in_batches(t("events").select(F.col("user_id").alias("run"), "event_id", said.alias("line")), source, F.col("event_id") % 3, 3)
    stream = progress.stream_table(t.spark, source, 1)
    progress.publish(progress.log_states(stream, "run", "event_id", "line"), board, history, checkpoint).awaitTermination()
    return progress.latest(t.spark, board)
