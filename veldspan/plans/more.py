"""Queries on coverage, dispersion, timing, batches and signals."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import signal, sketches
from ..functions import vectors as V
from ..functions.ordering import seeded_unit, with_position
from ..operators import series
from ..sources import shards
from ..sources.scratch import scratch
from .captions import unit
from .registry import query


@query("""SELECT 'all' AS ref_kind, o.o_orderkey, c.c_name AS ref FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
UNION ALL SELECT 'rich', o.o_orderkey, c.c_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE c.c_acctbal > 5000""")
def dual_reference(t):
    orders, customers = t("orders").select("o_orderkey", "o_custkey"), t("customer")
    kinds = F.when(F.col("c_acctbal") > 5000, F.array(F.lit("all"), F.lit("rich"))).otherwise(F.array(F.lit("all")))
    both = customers.select("c_custkey", F.col("c_name").alias("ref"), F.explode(kinds).alias("ref_kind"))  # one join serves both references
    return orders.join(both, F.col("o_custkey") == F.col("c_custkey")).select("ref_kind", "o_orderkey", "ref")


@query("SELECT source, count(*) AS items, count(DISTINCT md5(text)) AS texts, round(100.0 * count(DISTINCT md5(text)) / count(*), 6)::DOUBLE AS percent FROM documents GROUP BY source")
def distinct_coverage(t):
    rows = t("documents").select("source", F.md5("text").alias("d"))
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("items"), F.countDistinct("d").alias("texts")).withColumn("percent", F.round(F.lit(100.0) * F.col("texts") / F.col("items"), 6))


@query("SELECT event_type, round(stddev_samp(CASE WHEN user_id % 2 = 0 THEN value END) / stddev_samp(CASE WHEN user_id % 2 = 1 THEN value END), 6) AS ratio FROM events GROUP BY event_type")
def dispersion_ratio(t):
    side = lambda k: F.stddev_samp(F.when(F.col("user_id") % 2 == k, F.col("value")))
    return t("events").groupBy("event_type").agg(F.round(F.try_divide(side(0), side(1)), 6).alias("ratio"))


@query("SELECT label, sum(len(embedding))::BIGINT AS elements, sum(len(embedding)) FILTER (WHERE vec_id % 2 = 0)::BIGINT AS trained FROM embeddings GROUP BY label")
def parameter_counts(t):
    n = F.size("embedding").cast("long")
    return t("embeddings").groupBy("label").agg(F.sum(n).alias("elements"), F.sum(F.when(F.col("vec_id") % 2 == 0, n)).alias("trained"))


@query("SELECT user_id, rn // 20 AS win, round((max(us) - min(us)) / 1e6 / count(*), 2) AS seconds_per_step FROM (SELECT user_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS rn FROM events) GROUP BY 1, 2")
def step_timing(t):
    return series.interval_rates(t("events"), "user_id", ["ts", "event_id"], "ts", 20).withColumnRenamed("interval", "win")


@query(f"""SELECT event_id, greatest(value, v2) AS t, CASE WHEN rn <= floor(0.75 * n) THEN greatest(value, v2) ELSE least(value, v2) END AS r
FROM (SELECT event_id, value, 500 - value AS v2, row_number() OVER (ORDER BY {unit('flow', 'event_id')}, event_id) AS rn, count(*) OVER () AS n FROM events)""")
def flow_pairs(t):
    rows = t("events").select("event_id", "value", (500 - F.col("value")).alias("v2"), seeded_unit("flow", F.col("event_id")).alias("u"))
    high, low = F.greatest("value", "v2"), F.least("value", "v2")
    placed = with_position(rows, "u", "event_id", total="n")
    return placed.select("event_id", high.alias("t"), F.when(F.col("pos") < F.floor(0.75 * F.col("n")), high).otherwise(low).alias("r"))


@query("SELECT event_id, round(value * 0.95 ** 10, 6) AS x FROM events")
def euler_fold(t):
    return t("events").select("event_id", F.round(V.euler(F.col("value"), lambda x, _: x * 0.5, 10), 6).alias("x"))


@query("SELECT l_returnflag, round(min(l_discount), 6) AS low, round(max(l_discount), 6) AS high, count(*) FILTER (WHERE l_discount BETWEEN 0.02 AND 0.05) AS inside, count(*) FILTER (WHERE NOT l_discount BETWEEN 0.02 AND 0.05) AS outside FROM lineitem GROUP BY 1")
def support_gating(t):
    inside = F.col("l_discount").between(0.02, 0.05)
    return t("lineitem").groupBy("l_returnflag").agg(F.round(F.min("l_discount"), 6).alias("low"), F.round(F.max("l_discount"), 6).alias("high"), F.count_if(inside).alias("inside"), F.count_if(~inside).alias("outside"))


def numbers(x) -> str:
    """A list of numbers, or of lists, in SQL; names of doubles, not decimals."""
    return "[" + ", ".join(numbers(v) if np.ndim(v) else f"{v!r}::DOUBLE" for v in np.asarray(x).tolist()) + "]"


#: The same sums as the matrix products: taps, window, Fourier sums and mel triangles, written out.
SPECTROGRAM = f"""WITH c AS (SELECT {numbers(signal.sinc_filter(2, 1))} AS taps, {numbers(signal.hann(32))} AS hann, {numbers(signal.mel_filters(128, 32, 8))} AS mel,
  list_transform(range(17), lambda k: list_transform(range(32), lambda n: cos(2 * pi() * k * n / 32))) AS re, list_transform(range(17), lambda k: list_transform(range(32), lambda n: sin(2 * pi() * k * n / 32))) AS im),
y AS (SELECT vec_id, list_transform(range(128), lambda m: list_sum(list_transform(range(64), lambda i: CASE WHEN m - 2 * i BETWEEN -32 AND 32 THEN embedding[i + 1]::DOUBLE * taps[m - 2 * i + 33] ELSE 0 END))) AS y FROM embeddings, c),
p AS (SELECT vec_id, list_concat(list_reverse(y[2:17]), y, list_reverse(y[112:127])) AS p FROM y),
f AS (SELECT vec_id, unnest(range(9)) AS f, p FROM p),
w AS (SELECT vec_id, f, list_transform(range(1, 33), lambda n: p[16 * f + n] * hann[n]) AS x FROM f, c),
g AS (SELECT vec_id, f, list_transform(range(1, 18), lambda k: sqrt(list_dot_product(x, re[k]) ** 2 + list_dot_product(x, im[k]) ** 2)) AS g FROM w, c),
l AS (SELECT vec_id, f, list_transform(mel, lambda b: log10(greatest(list_dot_product(b, g), 1e-5))) AS l FROM g, c)
SELECT vec_id, any_value(len(l))::INTEGER AS bands, count(*)::INTEGER AS frames, round(max(list_max(l)), 6) AS top, round(sum(list_sum(l)), 4) AS total FROM l GROUP BY vec_id"""


@query(SPECTROGRAM)
def spectrogram_frames(t):
    mel = signal.log_mel_spectrogram(signal.resampled(F.col("embedding"), 64, 128), 128, 32, 16, 8)
    rows = t("embeddings").select("vec_id", mel.alias("mel"))
    total = F.aggregate(F.flatten("mel"), F.lit(0.0), lambda s, v: s + v)
    return rows.select("vec_id", F.size("mel").alias("bands"), F.size(F.get("mel", F.lit(0))).alias("frames"), F.round(F.array_max(F.flatten("mel")), 6).alias("top"), F.round(total, 4).alias("total"))


@query("SELECT grouping(l_returnflag) AS g, l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def std_rollup(t):
    return t("lineitem").rollup("l_returnflag", "l_linestatus").agg(F.grouping("l_returnflag").cast("long").alias("g"), F.count(F.lit(1)).alias("n"))


@query("""SELECT user_id, count(*) AS sessions, max(n) AS longest FROM (SELECT user_id, s, count(*) AS n FROM (
SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM (
SELECT user_id, ts, event_id, (coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id), 999999999999) >= 21600000000)::INTEGER AS new FROM events)) GROUP BY 1, 2) GROUP BY 1""")
def std_sessions(t):
    events = t("events").withColumn("ts", F.col("ts").cast("timestamp"))
    sessions = events.groupBy("user_id", F.session_window("ts", "6 hours")).agg(F.count(F.lit(1)).alias("n"))
    return sessions.groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"), F.max("n").alias("longest"))


@query("""SELECT event_type, count(*) AS rows, count(DISTINCT user_id) AS users, true AS users_near, true AS median_near, true AS late_near FROM events GROUP BY event_type""")
def daily_sketches(t):
    """Sketches a day and type, put together a type, held against exact figures: users within 5 %, ranks within 2 %."""
    rows = t("events").withColumn("day", F.to_date("ts"))
    path = scratch(t.spark, "sketches")
    sketches.summarised(rows, ["day", "event_type"], {"users": F.col("user_id")}, {"value": F.col("value")}).write.parquet(path)
    whole = sketches.merged(t.spark.read.parquet(path), ["event_type"], ["users"], ["value"])
    told = whole.select("event_type", "rows", sketches.distinct_estimate("users").alias("about"), *[sketches.quantile_estimate("value", q).alias(f"q{int(100 * q)}") for q in (0.5, 0.9)])
    below = lambda q: F.avg((F.col("value") <= F.col(q)).cast("double"))
    exact = rows.join(told, "event_type").groupBy("event_type").agg(
        F.first("rows").alias("rows"), F.countDistinct("user_id").alias("users"), F.first("about").alias("about"), below("q50").alias("r50"), below("q90").alias("r90")
    )
    near = lambda rank, at: F.abs(F.col(rank) - at) <= 0.02
    return exact.select("event_type", "rows", "users", (F.abs(F.col("about") - F.col("users")) <= F.greatest(F.lit(0.05) * F.col("users"), F.lit(1))).alias("users_near"), near("r50", 0.5).alias("median_near"), near("r90", 0.9).alias("late_near"))


@query("""WITH o AS (SELECT *, o_orderkey % 8 AS shard FROM orders), m AS (SELECT shard, count(*) AS n FROM o GROUP BY 1)
SELECT shard, CASE shard WHEN 2 THEN 'short' WHEN 5 THEN 'missing' WHEN 6 THEN 'repeated' WHEN 7 THEN 'long' ELSE 'ok' END AS status,
  CASE shard WHEN 2 THEN (SELECT count(*) FROM o WHERE shard = 2 AND o_orderkey <> (SELECT min(o_orderkey) + 8 FROM o WHERE shard = 2)) WHEN 5 THEN NULL WHEN 6 THEN (SELECT n FROM m WHERE shard = 1) WHEN 7 THEN n + 1 ELSE n END AS rows,
  n AS expected, CASE shard WHEN 2 THEN (SELECT count(*) FROM o WHERE shard = 2 AND o_orderkey <> (SELECT min(o_orderkey) + 8 FROM o WHERE shard = 2)) WHEN 6 THEN (SELECT n FROM m WHERE shard = 1) WHEN 7 THEN n END AS distinct_keys FROM m""")
def shard_verification(t):
    """Shards of orders of which one lost a row, one is gone, one holds another's rows and one a row twice."""
    orders = t("orders").select("o_orderkey", "o_totalprice", (F.col("o_orderkey") % 8).alias("shard"))
    low = F.min("o_orderkey").over(Window.partitionBy("shard"))  # the shards of this query are small
    marked = orders.withColumn("_low", low)
    lost = (F.col("shard") == 2) & (F.col("o_orderkey") == F.col("_low") + 8) | F.col("shard").isin(5, 6)
    kept = marked.filter(~lost).unionByName(marked.filter((F.col("shard") == 7) & (F.col("o_orderkey") == F.col("_low"))))
    kept = kept.unionByName(marked.filter("shard = 1").withColumn("shard", F.lit(6).cast("long"))).drop("_low")
    path = scratch(t.spark, "shards")
    shards.write_sharded(kept, path, "shard", "o_orderkey")
    return shards.verify_shards(t.spark, path, shards.manifest_of(orders, "shard", "o_orderkey"), "shard", "o_orderkey")
