"""Metric aggregation, ranking and comparison."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def mean_of_rank_means(points: DataFrame, key: str, rank: Column, value: str) -> DataFrame:
    """(key, mean_of_means, plain_mean): each rank's mean counts the same, however many points it has."""
    by_rank = points.groupBy(key, rank.alias("_rank")).agg(F.avg(value).alias("_mean"), F.sum(value).alias("_sum"), F.count(value).alias("_n"))
    return by_rank.groupBy(key).agg(F.round(F.avg("_mean"), 6).alias("mean_of_means"), F.round(F.sum("_sum") / F.sum("_n"), 6).alias("plain_mean"))


def binned_mean(points: DataFrame, t: Column, value: str, bins: int = 25) -> DataFrame:
    """(bin, n, mean) of all bins; t in [0, 1), other t are left out; the mean of an empty bin is NaN."""
    spine = points.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    filled = points.filter((t >= 0) & (t < 1)).groupBy(F.floor(t * bins).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"))
    return spine.join(filled, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce(F.round("mean", 6), F.lit(float("nan"))).alias("mean"))


def interval_means(points: DataFrame, key: str, step: str, every: int, value: str) -> DataFrame:
    """Means of count-based intervals: sums start anew every ``every`` steps."""
    return points.groupBy(key, F.expr(f"`{step}` div {every}").alias("interval")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(value), 6).alias("mean"))


def ranked(metrics: DataFrame, by: list[str], value: str, descending: bool = True) -> DataFrame:
    order = F.desc(value) if descending else F.asc(value)
    return metrics.withColumn("rank", F.rank().over(Window.partitionBy(*by).orderBy(order)))


def top_ranked(metrics: DataFrame, by: list[str], value: str, k: int, descending: bool = True) -> DataFrame:
    """The rows of rank 1 to ``k`` of each group; equal values share a rank."""
    return ranked(metrics, by, value, descending).filter(F.col("rank") <= k)


def with_hooks(metrics: DataFrame, *hooks) -> DataFrame:
    """Adds what each hook, a function of the aggregated table, derives from it."""
    for hook in hooks:
        metrics = metrics.transform(hook)
    return metrics


def against_baseline(metrics: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """Difference of each row to the first of its group, absolute and in percent."""
    base = F.first(value).over(Window.partitionBy(*by).orderBy(order))
    return metrics.withColumn("delta", F.round(F.col(value) - base, 6)).withColumn("percent", F.round(F.try_divide(100 * (F.col(value) - base), base), 6))


def long_to_wide(metrics: DataFrame, keys: list[str], name: str, value: str, names: list[str]) -> DataFrame:
    return metrics.groupBy(*keys).pivot(name, names).agg(F.first(value))


def paired(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """One row: pairs, mean difference and wins of a over b, on keys that both have."""
    both = a.select(key, F.col(value).alias("_a")).join(b.select(key, F.col(value).alias("_b")), key)
    return both.agg(
        F.count(F.lit(1)).alias("pairs"), F.round(F.avg(F.col("_a") - F.col("_b")), 6).alias("mean_delta"), F.count_if(F.col("_a") > F.col("_b")).alias("wins")
    )


def frechet_diagonal(a: DataFrame, b: DataFrame, vector: str) -> DataFrame:
    """One row: squared distance of means plus squared distance of standard deviations, per dimension."""

    def moments(df: DataFrame, name: str) -> DataFrame:
        e = df.select(F.posexplode(vector).alias("i", "v"))
        return e.groupBy("i").agg(F.avg(F.col("v").cast("double")).alias(f"m{name}"), F.stddev_samp(F.col("v").cast("double")).alias(f"s{name}"))

    d = moments(a, "a").join(moments(b, "b"), "i")
    part = F.pow(F.col("ma") - F.col("mb"), F.lit(2)) + F.pow(F.col("sa") - F.col("sb"), F.lit(2))
    return d.agg(F.round(F.sum(part), 6).alias("frechet"), F.count(F.lit(1)).alias("dims"))


def moments(vectors: DataFrame, vector: str) -> tuple[int, np.ndarray, np.ndarray]:
    """(rows, mean, sample covariance): tasks add up sums and products, so width * width numbers a task are all that moves."""
    import pyarrow as pa

    def sums(batches):
        total = None
        for batch in batches:
            column = batch.column(0).drop_null()
            if not len(column):
                continue
            x = column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)
            x = np.column_stack([np.ones(len(x)), x])
            total = x.T @ x + (0 if total is None else total)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.reshape(-1))], names=["i", "s"])

    rows = vectors.select(vector).mapInArrow(sums, "i long, s double").groupBy("i").agg(F.sum("s").alias("s")).orderBy("i").toPandas()
    width = int(round(len(rows) ** 0.5))
    total = rows["s"].to_numpy().reshape(width, width)
    n, first = total[0, 0], total[0, 1:]
    return int(n), first / n, (total[1:, 1:] - np.outer(first, first) / n) / (n - 1)


def frechet_full(a: DataFrame, b: DataFrame, vector: str) -> DataFrame:
    """One row: |mean difference|^2 + trace(Ca + Cb - 2 sqrt(Ca Cb)) of two sets of vectors.

    The sets meet only as moments; what the driver holds has the size of the vectors' width squared.
    """
    (_, ma, ca), (_, mb, cb) = moments(a, vector), moments(b, vector)
    value, base = np.linalg.eigh(ca)
    root = base * np.sqrt(np.maximum(value, 0)) @ base.T
    cross = np.sqrt(np.maximum(np.linalg.eigvalsh(root @ cb @ root), 0)).sum()
    distance = float(((ma - mb) ** 2).sum() + np.trace(ca) + np.trace(cb) - 2 * cross)
    return a.sparkSession.createDataFrame([(round(distance, 6), len(ma))], "frechet double, dims long")


def _best(k: int, width: int, chunk: int):
    """The k best items of each query in a part; rows (part, item, id, label, vector) come sorted, queries first."""
    import pyarrow as pa

    def matrix(column) -> tuple[np.ndarray, np.ndarray]:
        """Unit vectors of the rows whose vector has a length, and which rows these are."""
        whole = np.flatnonzero(np.asarray(column.value_lengths().fill_null(0)) == width)
        x = column.take(pa.array(whole)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(whole), -1)
        length = np.sqrt((x * x).sum(1, keepdims=True))
        good = (length[:, 0] > 0) & np.isfinite(x).all(1)
        return x[good] / length[good], whole[good]

    class Part:
        def __init__(self):
            self.q, self.ids, self.labels = [], [], []
            self.best = None

        def add(self, ids, labels, vectors):
            x, rows = matrix(vectors)
            if len(rows):
                self.q.append(x)
                self.ids.append(np.asarray(ids)[rows])
                self.labels.append(labels.take(pa.array(rows)))

        def meet(self, ids, labels, vectors):
            x, rows = matrix(vectors)
            if self.best is None:
                if not self.q:
                    return
                self.q, self.ids, self.labels = np.concatenate(self.q), np.concatenate(self.ids), pa.concat_arrays(self.labels)
                none = np.zeros(0, np.int64)
                self.best, self.worst = (none, np.zeros(0), none, labels.slice(0, 0)), np.full(len(self.q), -np.inf)
            ids = np.asarray(ids)[rows]
            for lo in range(0, len(rows), chunk):
                score = np.round(self.q @ x[lo : lo + chunk].T, 6)
                # equal scores go by id, so what equals the worst may still enter
                row, col = np.nonzero((score >= self.worst[:, None]) & (self.ids[:, None] != ids[lo : lo + chunk]))
                q, s, i, g = self.best
                q, s, i = np.concatenate([q, row]), np.concatenate([s, score[row, col]]), np.concatenate([i, ids[lo + col]])
                order = np.lexsort((i, -s, q))
                q = q[order]
                start = np.searchsorted(q, np.arange(len(self.q)))
                keep = np.arange(len(q)) - start[q] < k
                order, q = order[keep], q[keep]
                g = pa.concat_arrays([g, labels.take(pa.array(rows[lo + col]))]).take(pa.array(order))
                self.best = q, s[order], i[order], g
                full = np.bincount(q, minlength=len(self.q)) == k
                last = np.searchsorted(q, np.arange(len(self.q)), "right") - 1
                self.worst = np.where(full, self.best[1][last] if len(q) else -np.inf, -np.inf)

        def rows(self, names):
            if self.best is None or not len(self.best[0]):
                return None
            q, s, i, g = self.best
            return pa.RecordBatch.from_arrays([pa.array(self.ids[q]), self.labels.take(pa.array(q)), pa.array(i), g, pa.array(s)], names=names)

    def run(batches):
        names, now, part = ["q", "ql", "i", "il", "score"], None, None
        for batch in batches:
            parts, items = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            cut = np.flatnonzero((np.diff(parts) != 0) | (np.diff(items) != 0)) + 1
            for lo, hi in zip([0, *cut], [*cut, len(parts)]):
                if hi == lo:
                    continue
                if parts[lo] != now:
                    if part is not None and (out := part.rows(names)) is not None:
                        yield out
                    now, part = parts[lo], Part()
                columns = [batch.column(c).slice(lo, hi - lo) for c in (2, 3, 4)]
                (part.meet if items[lo] else part.add)(*columns)
        if part is not None and (out := part.rows(names)) is not None:
            yield out

    return run


def nearest_items(queries: DataFrame, items: DataFrame, id_col: str, label: str, vector: str, k: int, query_rows: int = 4096, item_rows: int = 65_536) -> DataFrame:
    """(q, ql, i, il, score): the k items nearest to each query by cosine (six decimals; ties by id), the query itself left out.

    Queries and items are dealt into groups of about ``query_rows`` and ``item_rows`` rows, whose number grows with
    the tables; each pair of groups is a part, in which a task holds the queries and takes the items as they
    come, as one matrix product a chunk.  A part gives k rows a query, never a row for a pair, and these are ranked together.
    Ids are whole numbers; rows whose vector is null, zero, not finite or of another length than most items' are left out.
    """
    number, width = items.agg(F.count(F.lit(1)), F.mode(F.size(vector))).first()
    g, h = max(1, -(-queries.count() // query_rows)), max(1, -(-number // item_rows))
    side = lambda rows, item: rows.select(F.lit(item).alias("item"), F.col(id_col).cast("long").alias("id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("vector"))
    group = lambda n: F.pmod(F.xxhash64("id"), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    q = side(queries, 0).withColumns({"_g": group(g), "_h": every(h)})
    i = side(items, 1).withColumns({"_h": group(h), "_g": every(g)})
    parts = q.unionByName(i).select((F.col("_g") * h + F.col("_h")).alias("part"), "item", "id", "label", "vector")
    kind = items.schema[label].dataType.simpleString()
    schema = f"q long, ql {kind}, i long, il {kind}, score double"
    near = parts.repartition("part").sortWithinPartitions("part", "item").mapInArrow(_best(k, max(width or 1, 1), 1024), schema)
    if h == 1:
        return near
    return near.withColumn("_r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "i"))).filter(F.col("_r") <= k).drop("_r")


def recall_at_k(queries: DataFrame, items: DataFrame, id_col: str, label: str, vector: str, k: int, **sizes: int) -> DataFrame:
    """One row: queries (with any neighbour) and the share of them with an item of their label among the k nearest others by cosine."""
    hits = nearest_items(queries, items, id_col, label, vector, k, **sizes).groupBy("q").agg(F.max((F.col("ql") == F.col("il")).cast("int")).alias("hit"))
    return hits.agg(F.count(F.lit(1)).alias("queries"), F.round(F.avg("hit"), 6).alias("recall"))
