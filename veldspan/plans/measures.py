"""Queries on metrics, rankings, vectors and series."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors as V
from ..functions.text import learning_rate
from ..operators import candidates, intervals, metrics, series
from ..sources.scratch import scratch
from .registry import query

UNIT = "SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS u FROM embeddings"
CONSENSUS = f"""SELECT a.label, a.vec_id, round(avg(list_dot_product(a.u, b.u)), 6) AS consensus
FROM ({UNIT}) a JOIN ({UNIT}) b ON a.label = b.label AND a.vec_id <> b.vec_id GROUP BY a.label, a.vec_id"""
YEARLY = """SELECT l_returnflag AS exp, year(l_shipdate)::INTEGER AS bench, round(avg(l_discount), 6) AS score, round(avg(l_quantity), 4) AS qty
FROM lineitem GROUP BY 1, 2"""


def scored(t):
    return candidates.consensus(t("embeddings").select("vec_id", "label", "embedding"), "label", "embedding").select("label", "vec_id", "consensus")


@query(f"SELECT label, vec_id, consensus FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY consensus DESC, vec_id) AS r FROM ({CONSENSUS})) WHERE r = 1")
def candidate_best(t):
    return candidates.pick_one(scored(t), "label", F.col("consensus"), "vec_id")


@query(f"SELECT label, vec_id, consensus FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY consensus, vec_id) AS r FROM ({CONSENSUS})) WHERE r = 1")
def candidate_worst(t):
    return candidates.pick_one(scored(t), "label", F.col("consensus"), "vec_id", best=False)


@query(f"""SELECT a.label, count(DISTINCT a.vec_id) AS members, round(avg(list_dot_product(a.u, b.u)), 6) AS mean_similarity
FROM ({UNIT}) a JOIN ({UNIT}) b ON a.label = b.label AND a.vec_id <> b.vec_id GROUP BY a.label""")
def mean_similarity(t):
    return candidates.mean_similarity(t("embeddings"), "label", "embedding")


@query("""SELECT event_type, round(avg(m), 6) AS mean_of_means, round(sum(s) / sum(n), 6) AS plain_mean
FROM (SELECT event_type, user_id % 4 AS rank, avg(value) AS m, sum(value) AS s, count(value) AS n FROM events GROUP BY 1, 2) GROUP BY 1""")
def rank_mean_two_level(t):
    return metrics.mean_of_rank_means(t("events"), "event_type", F.pmod("user_id", F.lit(4)), "value")


@query("""WITH f AS (SELECT floor((epoch_us(ts) % 86400000000) / 86400000000.0 * 25)::INTEGER AS bin, count(*) AS n, avg(value) AS mean FROM events GROUP BY 1)
SELECT b.bin::INTEGER AS bin, coalesce(n, 0) AS n, coalesce(round(mean, 6), 'NaN'::DOUBLE) AS mean FROM (SELECT unnest(range(25)) AS bin) b LEFT JOIN f ON b.bin = f.bin""")
def binned_mean(t):
    day = F.pmod(F.unix_micros(F.col("ts").cast("timestamp")), F.lit(86_400_000_000)) / F.lit(86_400_000_000.0)
    return metrics.binned_mean(t("events"), day, "value")


@query("SELECT event_type, event_id // 50 AS interval, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2")
def interval_metrics(t):
    return metrics.interval_means(t("events"), "event_type", "event_id", 50, "value")


@query("""SELECT user_id, len(v)::INTEGER AS points, CASE WHEN len(v) > 1 THEN round(list_reduce(v[2:], lambda a, b: a * 0.7::DOUBLE + b * (1 - 0.7::DOUBLE)), 6) END AS average
FROM (SELECT user_id, list(value ORDER BY ts, event_id) AS v FROM events GROUP BY user_id)""")
def ema_step_time(t):
    return series.running_average(t("events"), "user_id", ["ts", "event_id"], "value")


@query("""SELECT event_id, user_id, round(epoch_us(ts) / 1e6 - lag(epoch_us(ts) / 1e6) OVER (PARTITION BY user_id ORDER BY ts, event_id), 3) AS seconds FROM events""")
def step_durations(t):
    return series.step_durations(t("events"), "user_id", ["ts", "event_id"], "ts").select("event_id", "user_id", "seconds")


@query("""WITH m AS (SELECT *, sum((event_type <> 'error')::INTEGER) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM events),
r AS (SELECT user_id, island, count(*) AS n FROM m WHERE event_type = 'error' GROUP BY 1, 2)
SELECT user_id, count(*) AS runs, max(n) AS longest, count(*) FILTER (WHERE n >= 3) AS alerts FROM r GROUP BY 1""")
def bad_run_alert(t):
    return series.bad_runs(t("events"), "user_id", ["ts", "event_id"], F.col("event_type") == "error", 3)


@query("""SELECT event_id, sum((value < 10)::INTEGER) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) >= 2 AS alert FROM events""")
def recent_flag_window(t):
    return series.trailing_flags(t("events"), "user_id", ["ts", "event_id"], F.col("value") < 10).select("event_id", "alert")


@query("""SELECT event_id, s AS step, round(CASE WHEN s < 100 THEN (s + 1) / 101.0::DOUBLE ELSE pow(1 - s / 1000.0::DOUBLE, 0.9) END, 9) AS poly,
round(CASE WHEN s < 100 THEN (s + 1) / 101.0::DOUBLE WHEN s >= 900 THEN 0.01 WHEN s >= 800 THEN 0.1 ELSE 1 END, 9)::DOUBLE AS step_decay, (s + 1) % 50 = 0 AS logs
FROM (SELECT event_id, event_id % 1000 AS s FROM events)""")
def lr_schedule(t):
    rows = t("events").select("event_id", (F.col("event_id") % 1000).alias("step"))
    s = F.col("step")
    return rows.select(
        "event_id",
        "step",
        F.round(learning_rate(s, 1000, 100, "poly"), 9).alias("poly"),
        F.round(learning_rate(s, 1000, 100, "step"), 9).alias("step_decay"),
        (F.pmod(s + 1, F.lit(50)) == 0).alias("logs"),
    )


def yearly(t):
    return (
        t("lineitem")
        .groupBy(F.col("l_returnflag").alias("exp"), F.year("l_shipdate").alias("bench"))
        .agg(F.round(F.avg("l_discount"), 6).alias("score"), F.round(F.avg("l_quantity"), 4).alias("qty"))
    )


@query(f"SELECT exp, bench, score, qty, rank() OVER (PARTITION BY bench ORDER BY score DESC)::INTEGER AS rank FROM ({YEARLY})")
def metric_rank(t):
    return metrics.ranked(yearly(t), ["bench"], "score")


@query(f"""SELECT a.exp, a.rank AS rank_1996, b.rank AS rank_1997, b.rank - a.rank AS moved
FROM (SELECT exp, rank() OVER (ORDER BY score DESC)::INTEGER AS rank FROM ({YEARLY}) WHERE bench = 1996) a
JOIN (SELECT exp, rank() OVER (ORDER BY score DESC)::INTEGER AS rank FROM ({YEARLY}) WHERE bench = 1997) b USING (exp)""")
def cross_rank(t):
    ranked = metrics.ranked(yearly(t), ["bench"], "score").filter(F.col("bench").isin(1996, 1997))
    wide = metrics.long_to_wide(ranked.withColumn("bench", F.concat(F.lit("rank_"), "bench")), ["exp"], "bench", "rank", ["rank_1996", "rank_1997"])
    return wide.withColumn("moved", F.col("rank_1997") - F.col("rank_1996"))


@query(f"""SELECT exp, bench, score, round(score - first_value(score) OVER w, 6) AS delta, round(100 * (score - first_value(score) OVER w) / first_value(score) OVER w, 6) AS percent
FROM ({YEARLY}) WINDOW w AS (PARTITION BY exp ORDER BY bench)""")
def baseline_delta(t):
    return metrics.against_baseline(yearly(t).drop("qty"), ["exp"], "bench", "score")


@query("""SELECT exp, max(CASE WHEN metric = 'score' THEN v END) AS score, max(CASE WHEN metric = 'qty' THEN v END) AS qty
FROM (SELECT exp, 'score' AS metric, score AS v FROM (%s) WHERE bench = 1996 UNION ALL SELECT exp, 'qty', qty FROM (%s) WHERE bench = 1996) GROUP BY exp""" % (YEARLY, YEARLY))
def metric_table(t):
    long = yearly(t).filter("bench = 1996").unpivot("exp", ["score", "qty"], "metric", "v")
    return metrics.long_to_wide(long, ["exp"], "metric", "v", ["score", "qty"])


@query("""WITH c AS (SELECT conv_id, role, avg(length(text)) AS n FROM conversations WHERE role IN ('user', 'assistant') GROUP BY 1, 2)
SELECT count(*) AS pairs, round(avg(a.n - b.n), 6) AS mean_delta, count(*) FILTER (WHERE a.n > b.n) AS wins
FROM c a JOIN c b USING (conv_id) WHERE a.role = 'assistant' AND b.role = 'user'""")
def paired_ab(t):
    turns = t("conversations").groupBy("conv_id", "role").agg(F.avg(F.length("text")).alias("n"))
    return metrics.paired(turns.filter("role = 'assistant'"), turns.filter("role = 'user'"), "conv_id", "n")


@query(f"""WITH u AS ({UNIT}),
p AS (SELECT a.vec_id AS q, a.label AS ql, b.label AS il, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_dot_product(a.u, b.u), 6) DESC, b.vec_id) AS r
  FROM u a JOIN u b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0),
h AS (SELECT q, max((ql = il)::INTEGER) AS hit FROM p WHERE r <= 10 GROUP BY q)
SELECT count(*) AS queries, round(avg(hit), 6) AS recall FROM h""")
def recall_at_k(t):
    rows = t("embeddings")
    return metrics.recall_at_k(rows.filter("vec_id % 20 = 0"), rows, "vec_id", "label", "embedding", 10)


@query("""WITH e AS (SELECT vec_id % 2 AS side, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings),
m AS (SELECT i, side, avg(v) AS m, stddev_samp(v) AS s FROM e GROUP BY 1, 2)
SELECT round(sum((a.m - b.m) ** 2 + (a.s - b.s) ** 2), 6) AS frechet, count(*) AS dims FROM m a JOIN m b USING (i) WHERE a.side = 0 AND b.side = 1""")
def frechet_diag(t):
    rows = t("embeddings")
    return metrics.frechet_diagonal(rows.filter("vec_id % 2 = 0"), rows.filter("vec_id % 2 = 1"), "embedding")


@query("""SELECT vec_id, len(p) AS size, round(p[1], 6) AS first_pool, round(p[8], 6) AS last_pool, round(list_sum(p), 6) AS total FROM (
SELECT vec_id, list_concat(list_transform(range(8), lambda g: list_sum(embedding[g * 8 + 1 : g * 8 + 8]::DOUBLE[]) / 8), embedding::DOUBLE[]) AS p FROM embeddings)""")
def vector_pool_concat(t):
    joined = F.concat(V.average_pool(F.col("embedding"), 8), V.doubles(F.col("embedding")))
    rows = t("embeddings").select("vec_id", joined.alias("p"))
    total = F.aggregate("p", F.lit(0.0), lambda s, v: s + v)
    return rows.select("vec_id", F.size("p").cast("long").alias("size"), F.round(F.get("p", F.lit(0)), 6).alias("first_pool"), F.round(F.get("p", F.lit(7)), 6).alias("last_pool"), F.round(total, 6).alias("total"))


@query("""SELECT vec_id, len(embedding) AS dims, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 5) AS norm,
list_bool_and(list_transform(embedding::DOUBLE[], lambda x: abs(x / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) - x) <= 1e-4 + 1e-4 * abs(x))) AS unchanged FROM embeddings""")
def vector_normalize_check(t):
    e = F.col("embedding")
    return t("embeddings").select(
        "vec_id", F.size(e).cast("long").alias("dims"), F.round(V.norm(e), 5).alias("norm"), V.close(V.normalised(e), V.doubles(e), 1e-4, 1e-4).alias("unchanged")
    )


@query("""SELECT vec_id, len(list_resize(embedding, greatest(80, len(embedding)), 0)) AS padded, len(embedding[5:12]) AS sliced, round(embedding[5]::DOUBLE, 6) AS first_sliced, round(list_aggregate(list_transform(embedding, lambda x: abs(x::DOUBLE)), 'max'), 6) AS peak FROM embeddings""")
def pad_slice(t):
    e = F.col("embedding")
    padded, cut = V.slice_or_pad(e, 4, 80), V.slice_or_pad(e, 4, 12)
    return t("embeddings").select(
        "vec_id", F.size(padded).cast("long").alias("padded"), F.size(cut).cast("long").alias("sliced"), F.round(F.get(cut, F.lit(0)), 6).alias("first_sliced"), F.round(V.max_abs(e), 6).alias("peak")
    )


@query("""WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings),
s AS (SELECT i, avg(v) AS m, stddev_samp(v) AS d FROM e GROUP BY i)
SELECT vec_id, round(avg((v - m) / d), 5) AS mean_z, round(max(abs((v - m) / d)), 5) AS max_z FROM e JOIN s USING (i) GROUP BY vec_id""")
def latent_stats_norm(t):
    e = t("embeddings").select("vec_id", F.posexplode("embedding").alias("i", "v")).withColumn("v", F.col("v").cast("double"))
    stats = e.groupBy("i").agg(F.avg("v").alias("m"), F.stddev_samp("v").alias("d"))
    folded = stats.agg(F.array_sort(F.collect_list(F.struct("i", "m", "d"))).alias("stats"))  # one row: a vector's width
    z = F.zip_with(V.doubles(F.col("embedding")), "stats", lambda v, s: (v - s["m"]) / s["d"])
    rows = t("embeddings").crossJoin(F.broadcast(folded)).select("vec_id", z.alias("z"))
    total = F.aggregate("z", F.lit(0.0), lambda s, v: s + v)
    return rows.select("vec_id", F.round(total / F.size("z"), 5).alias("mean_z"), F.round(V.max_abs(F.col("z")), 5).alias("max_z"))


@query("""WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings),
s AS (SELECT i, avg(v) AS m, stddev_samp(v) AS d FROM e GROUP BY i)
SELECT vec_id, round(avg((v - m) / d), 5) AS mean_z, round(max(abs((v - m) / d)), 5) AS max_z FROM e JOIN s USING (i) GROUP BY vec_id""")
def stored_stats_norm(t):
    """Means and deviations are stored, loaded as literals (a vector's width) and applied."""
    e = t("embeddings").select(F.posexplode("embedding").alias("i", "v")).groupBy("i").agg(F.avg(F.col("v").cast("double")).alias("m"), F.stddev_samp(F.col("v").cast("double")).alias("d"))
    path = scratch(t.spark, "stats")
    e.write.parquet(path)
    stats = t.spark.read.parquet(path).orderBy("i").collect()
    mean, deviation = (F.array(*[F.lit(r[c]) for r in stats]) for c in ("m", "d"))
    z = F.zip_with(F.zip_with(V.doubles(F.col("embedding")), mean, lambda v, m: v - m), deviation, lambda x, d: x / d)
    rows = t("embeddings").select("vec_id", z.alias("z"))
    return rows.select("vec_id", F.round(F.aggregate("z", F.lit(0.0), lambda s, v: s + v) / F.size("z"), 5).alias("mean_z"), F.round(V.max_abs(F.col("z")), 5).alias("max_z"))


@query("""SELECT vec_id, round(list_sum(list_transform(range(64), lambda i: pow(0.25 * embedding[i + 1]::DOUBLE + 0.75 * embedding[64 - i]::DOUBLE - embedding[i + 1]::DOUBLE, 2))) / 64, 6) AS mse,
round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE + exp(least(greatest(x::DOUBLE, -30), 20)) - 1 - x::DOUBLE)) / 2, 5) AS kl FROM embeddings""")
def vector_math(t):
    e = V.doubles(F.col("embedding"))
    blended = V.mix(e, F.reverse(e), F.lit(0.25))
    return t("embeddings").select("vec_id", F.round(V.mean_square_error(blended, e), 6).alias("mse"), F.round(V.gaussian_kl(e, e), 5).alias("kl"))


@query("""WITH f AS (SELECT user_id AS stream, epoch_us(ts) / 1e6 - 1704067200 AS t FROM events),
s AS (SELECT stream, t, coalesce(floor(lag(t) OVER (PARTITION BY stream ORDER BY t) / 3600) + 1, 0)::BIGINT AS a, floor(t / 3600)::BIGINT AS b FROM f)
SELECT stream, count(*) AS ticks, round(sum(t - tick * 3600), 3) AS lag FROM (SELECT stream, t, unnest(generate_series(a, b)) AS tick FROM s WHERE a <= b) GROUP BY stream""")
def frame_hold(t):
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 - F.lit(1704067200)
    frames = t("events").select(F.col("user_id").alias("stream"), (at / 3600).alias("hours"))
    held = series.frame_hold(frames, "stream", "hours", 1)
    return held.groupBy("stream").agg(F.count(F.lit(1)).alias("ticks"), F.round(F.sum((F.col("at") - F.col("tick")) * 3600), 3).alias("lag"))


@query("""WITH r AS (SELECT user_id, ts, max(event_id) AS purchase FROM events WHERE event_type = 'purchase' GROUP BY ALL)
SELECT e.event_id, e.user_id, r.purchase, round(epoch_us(e.ts) / 1e6 - epoch_us(r.ts) / 1e6, 3) AS seconds
FROM (FROM events WHERE event_type = 'error') e ASOF LEFT JOIN r ON e.user_id = r.user_id AND e.ts >= r.ts""")
def asof_last_purchase(t):
    timed = t("events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    errors = timed.filter("event_type = 'error'").select("event_id", "user_id", "us")
    purchases = timed.filter("event_type = 'purchase'").select("user_id", F.col("event_id").alias("purchase"), F.col("us").alias("at"))
    met = intervals.asof_join(errors, purchases, ["user_id"], "us", "at", ["purchase", "at"], tie="purchase")
    return met.select("event_id", "user_id", "purchase", F.round(F.col("us") / 1e6 - F.col("at") / 1e6, 3).alias("seconds"))


@query("""WITH o AS (SELECT o_orderkey, (o_orderkey * 7919) % 1000003 AS place FROM orders),
p AS (SELECT p_partkey, (p_partkey * 104729) % 1000003 AS low, (p_partkey * 104729) % 1000003 + (p_partkey % 97) * (p_partkey % 13) AS high FROM part)
SELECT o_orderkey, p_partkey FROM o JOIN p ON place >= low AND place < high""")
def interval_hits(t):
    points = t("orders").select("o_orderkey", ((F.col("o_orderkey") * 7919) % 1000003).alias("at"))
    low = (F.col("p_partkey") * 104729) % 1000003
    spans = t("part").select("p_partkey", low.alias("low"), (low + F.col("p_partkey") % 97 * (F.col("p_partkey") % 13)).alias("high"))
    return intervals.interval_join(points, spans, "at", "low", "high").select("o_orderkey", "p_partkey")
