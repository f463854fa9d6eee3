"""Queries on array functions, each with the same arithmetic in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from ..operators import metrics
from .registry import query

E = "embedding::DOUBLE[]"


def elements(column, *places, digits: int = 5):
    return [F.round(F.get(column, F.lit(i)), digits).alias(f"x{i}") for i in places]


def rows_of(t):
    return t("embeddings"), V.doubles(F.col("embedding"))


@query(f"""SELECT vec_id, list_bool_and(list_transform(range(1, 65), lambda i: abs(a[i] - b[i]) <= 1e-8 + 1e-5 * abs(b[i]))) AS near
FROM (SELECT vec_id, {E} AS a, list_transform({E}, lambda x: x + (vec_id % 2) * 0.001) AS b FROM embeddings)""")
def array_close(t):
    rows, e = rows_of(t)
    return rows.select("vec_id", V.close(e, F.transform(e, lambda x: x + (F.col("vec_id") % 2) * 0.001)).alias("near"))


@query(f"""SELECT vec_id, list_bool_and(list_transform(list_append({E}, CASE vec_id % 7 WHEN 0 THEN 'inf'::DOUBLE WHEN 1 THEN 'nan'::DOUBLE ELSE 0 END), lambda x: isfinite(x))) AS finite FROM embeddings""")
def array_finite(t):
    rows, e = rows_of(t)
    kind = F.col("vec_id") % 7
    last = F.when(kind == 0, F.lit(float("inf"))).when(kind == 1, F.lit(float("nan"))).otherwise(F.lit(0.0))
    return rows.select("vec_id", V.finite(F.concat(e, F.array(last))).alias("finite"))


@query(f"SELECT vec_id, round((e[1] + e[64]) / 2, 5) AS x0, round((e[10] + e[55]) / 2, 5) AS x9 FROM (SELECT vec_id, {E} AS e FROM embeddings)")
def channel_mean(t):
    rows, e = rows_of(t)
    return rows.select("vec_id", *elements(V.mono(e, F.reverse(e)), 0, 9))


@query(f"SELECT vec_id, round(e[1] / top * 0.95, 5) AS x0, round(e[64] / top * 0.95, 5) AS x63 FROM (SELECT vec_id, {E} AS e, list_max(list_transform({E}, lambda x: abs(x))) AS top FROM embeddings)")
def peak_scaled(t):
    rows, e = rows_of(t)
    return rows.select("vec_id", *elements(V.peak_normalised(e), 0, 63))


@query(f"SELECT vec_id, round(CASE WHEN w < 1 THEN e[1] ELSE w * e[1] + (1 - w) * e[64] END, 5) AS x0 FROM (SELECT vec_id, {E} AS e, (vec_id % 3) * 0.9 AS w FROM embeddings)")
def guidance_mix(t):
    rows, e = rows_of(t)
    return rows.select("vec_id", *elements(V.guided(e, F.reverse(e), (F.col("vec_id") % 3) * F.lit(0.9)), 0))


@query("SELECT vec_id, round((vec_id % 11) / 10.0 * 3 - 1, 5)::DOUBLE AS x FROM embeddings")
def linspace_steps(t):
    return t("embeddings").select("vec_id", F.round(F.get(V.linspace(-1.0, 2.0, 10), (F.col("vec_id") % 11).cast("int")), 5).alias("x"))


@query(f"SELECT vec_id, round(e[1] + abs(e[1]) * e[64], 5) AS x0, round(e[30] + abs(e[30]) * e[35], 5) AS x29 FROM (SELECT vec_id, {E} AS e FROM embeddings)")
def reparameterised_sample(t):
    rows, e = rows_of(t)
    return rows.select("vec_id", *elements(V.reparameterised(e, F.transform(e, F.abs), F.reverse(e)), 0, 29))


@query(f"SELECT vec_id, 64 AS n, round(e[4], 5) AS x0, round(e[61], 5) AS x1 FROM (SELECT vec_id, {E} AS e FROM embeddings)")
def transposed_axes(t):
    rows, e = rows_of(t)
    turned = V.transposed(F.array(e, F.reverse(e)))
    return rows.select("vec_id", F.size(turned).alias("n"), *elements(F.get(turned, F.lit(3)), 0, 1))


@query(f"SELECT vec_id, round(e[1] * cos(a) - e[2] * sin(a), 5) AS x0, round(e[1] * sin(a) + e[2] * cos(a), 5) AS x1, round(e[63] * cos(a) - e[64] * sin(a), 5) AS x62 FROM (SELECT vec_id, {E} AS e, label * 0.1::DOUBLE AS a FROM embeddings)")
def rotary_rotation(t):
    rows, e = rows_of(t)
    return rows.select("vec_id", *elements(V.rotated(e, F.col("label") * F.lit(0.1)), 0, 1, 62))


@query("SELECT vec_id, round(cos(label), 5) AS x0, round(cos(label * exp(-ln(10000) / 4)), 5) AS x1, round(sin(label * exp(-3 * ln(10000) / 4)), 5) AS x7 FROM embeddings")
def timestep_waves(t):
    return t("embeddings").select("vec_id", *elements(V.timestep_embedding(F.col("label").cast("double"), 8), 0, 1, 7))


@query(f"SELECT vec_id, round((e[1] * 0.7 + e[64] * 0.3) / sqrt(0.58), 5) AS x0 FROM (SELECT vec_id, {E} AS e FROM embeddings)")
def magnitude_preserving_sum(t):
    rows, e = rows_of(t)
    return rows.select("vec_id", *elements(V.preserving_sum(e, F.reverse(e), 0.3), 0))


@query(f"SELECT vec_id, round(d / pow(d + 0.001, 1.0), 6) AS whole, round(d / pow(d + 0.001, 0.5), 6) AS half FROM (SELECT vec_id, list_sum(list_transform({E}, lambda x: x * x)) / 64 AS d FROM embeddings)")
def adaptive_l2(t):
    rows, e = rows_of(t)
    d = V.mean_square_error(e, F.transform(e, lambda x: x * 0))
    return rows.select("vec_id", F.round(V.adaptive_weight(d), 6).alias("whole"), F.round(V.adaptive_weight(d, 0.5), 6).alias("half"))


@query(f"SELECT vec_id, round(e[1] * 2 - 1, 5) AS x0, round((e[2] + 1) / 2, 5) AS y1 FROM (SELECT vec_id, {E} AS e FROM embeddings)")
def range_scaling(t):
    rows, e = rows_of(t)
    return rows.select("vec_id", *elements(V.signed_range(e), 0), F.round(F.get(V.unit_range(e), F.lit(1)), 5).alias("y1"))


@query(f"SELECT vec_id, round(1 / (1 + exp(-(e[1] * 0.4 - 0.4))), 6) AS t FROM (SELECT vec_id, {E} AS e FROM embeddings)")
def lognormal_times(t):
    rows, e = rows_of(t)
    return rows.select("vec_id", F.round(T.sigmoid(F.get(e, F.lit(0)) * 0.4 - 0.4), 6).alias("t"))  # the noise is data


@query(f"""SELECT vec_id, 11 AS long, 6 AS short, round(list_sum(e), 4) AS kept, round(list_sum(e[1:48]), 4) AS cut FROM (SELECT vec_id, {E} AS e FROM embeddings)""")
def padded_matrix(t):
    rows, e = rows_of(t)
    matrix = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice(e, i * 8 + 1, 8))
    long, short = V.padded_rows(matrix, 11, 8), V.padded_rows(matrix, 6, 8)
    total = lambda m: F.round(F.aggregate(F.flatten(m), F.lit(0.0), lambda s, v: s + v), 4)
    return rows.select("vec_id", F.size(long).alias("long"), F.size(short).alias("short"), total(long).alias("kept"), total(short).alias("cut"))


@query(f"""SELECT vec_id, 4 AS rows, round(e[1], 5) AS first, round((e[5] + e[9]) / 2, 5) AS pooled, round((e[24] + e[28]) / 2, 5) AS last FROM (SELECT vec_id, {E} AS e FROM embeddings)""")
def class_row_pooling(t):
    rows, e = rows_of(t)
    matrix = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice(e, i * 4 + 1, 4))  # 8 rows: the first, 3 pairs, one left over
    got = V.pooled_with_first(matrix, 2)
    at = lambda r, c: F.round(F.get(F.get(got, F.lit(r)), F.lit(c)), 5)
    return rows.select("vec_id", F.size(got).alias("rows"), at(0, 0).alias("first"), at(1, 0).alias("pooled"), at(3, 3).alias("last"))


@query(f"""SELECT vec_id, i, round(a, 5) AS a, round(b, 5) AS b FROM (SELECT vec_id, unnest(range(64)) AS i, unnest({E}) AS a, unnest(list_reverse({E})) AS b FROM embeddings)""")
def batch_unpack(t):
    rows = t("embeddings")
    e = V.doubles(F.col("embedding"))
    zipped = rows.select("vec_id", F.posexplode(F.arrays_zip(e.alias("a"), F.reverse(e).alias("b"))).alias("i", "x"))
    return zipped.select("vec_id", F.col("i").cast("long").alias("i"), F.round("x.a", 5).alias("a"), F.round("x.b", 5).alias("b"))


@query(f"""SELECT label, round(avg(list_dot_product(e, list_reverse(e)) / list_dot_product(e, e)), 6) AS mean_cosine FROM (SELECT label, {E} AS e FROM embeddings) GROUP BY label""")
def mean_cosine(t):
    rows, e = rows_of(t)
    return rows.groupBy("label").agg(F.round(F.avg(V.cosine(e, F.reverse(e))), 6).alias("mean_cosine"))


#: The trace of the root of a product of covariances, by Newton's iteration for matrix roots (40 steps).
FRECHET = """WITH RECURSIVE e AS (SELECT vec_id, vec_id % 2 AS side, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings),
m AS (SELECT side, i, avg(v) AS m, count(*) AS n FROM e GROUP BY 1, 2),
x AS (SELECT vec_id, side, i, v - m AS v, n FROM e JOIN m USING (side, i)),
c AS (SELECT a.side, a.i AS i, b.i AS j, sum(a.v * b.v) / (any_value(a.n) - 1) AS v FROM x a JOIN x b USING (vec_id) GROUP BY 1, 2, 3),
p AS (SELECT a.i, b.j, sum(a.v * b.v) AS v FROM c a JOIN c b ON a.j = b.i WHERE a.side = 0 AND b.side = 1 GROUP BY 1, 2),
s AS (SELECT sqrt(sum(v * v)) AS s FROM p),
it AS (SELECT 0 AS k, 'y' AS kind, i, j, v / s AS v FROM p, s UNION ALL SELECT 0, 'z', i, j, (i = j)::INT FROM p
  UNION ALL SELECT * FROM (WITH zy AS (SELECT z.k, z.i, y.j, sum(z.v * y.v) AS v FROM it z JOIN it y ON z.j = y.i WHERE z.kind = 'z' AND y.kind = 'y' AND z.k < 40 GROUP BY 1, 2, 3),
    t AS (SELECT k, i, j, ((CASE WHEN i = j THEN 3 ELSE 0 END) - v) / 2 AS v FROM zy)
    SELECT t.k + 1, 'y', y.i, t.j, sum(y.v * t.v) FROM it y JOIN t ON y.j = t.i WHERE y.kind = 'y' GROUP BY 1, 2, 3, 4
    UNION ALL SELECT t.k + 1, 'z', t.i, z.j, sum(t.v * z.v) FROM t JOIN it z ON t.j = z.i WHERE z.kind = 'z' GROUP BY 1, 2, 3, 4))
SELECT round((SELECT sum((a.m - b.m) ** 2) FROM m a JOIN m b USING (i) WHERE a.side = 0 AND b.side = 1) + (SELECT sum(v) FROM c WHERE i = j)
  - 2 * (SELECT sum(v) FROM it WHERE k = 40 AND kind = 'y' AND i = j) * (SELECT sqrt(s) FROM s), 6) AS frechet, (SELECT count(DISTINCT i) FROM m) AS dims"""


@query(FRECHET)
def frechet_full(t):
    rows = t("embeddings")
    return metrics.frechet_full(rows.filter("vec_id % 2 = 0"), rows.filter("vec_id % 2 = 1"), "embedding")
