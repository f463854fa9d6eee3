"""Queries on text, JSON, maps and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from .registry import query


@query("SELECT page_id, substr(translate(url, ' /.', '__'), 1, 196) AS name FROM pages")
def safe_filename(t):
    return t("pages").select("page_id", T.safe_name(F.col("url")).alias("name"))


@query(r"""SELECT event_id, regexp_extract(props, '"k": *(\d+)', 1)::INTEGER AS k, event_type = 'error' OR regexp_matches(props, 'Traceback|CRITICAL|CUDA out of memory|OOM|Killed|loss:[nN][aA][nN]') AS crashed FROM events""")
def log_markers(t):
    k = F.get_json_object("props", "$.k").cast("int")
    return t("events").select("event_id", k.alias("k"), ((F.col("event_type") == "error") | T.crashed(F.col("props"))).alias("crashed"))


@query(r"""SELECT page_id, regexp_extract(url, '^(https?)://', 1) AS scheme, regexp_extract(url, '^https?://([^/]+)', 1) AS host,
regexp_extract(url, '/(\d+)(\?|#|$)', 1) AS item, regexp_replace(regexp_extract(url, '([^/]*)$', 1), '\.[^.]*$', '') AS stem FROM pages""")
def url_parts(t):
    u = F.col("url")
    return t("pages").select(
        "page_id", F.regexp_extract(u, r"^(https?)://", 1).alias("scheme"), F.regexp_extract(u, r"^https?://([^/]+)", 1).alias("host"),
        F.regexp_extract(u, r"/(\d+)(\?|#|$)", 1).alias("item"), T.stem(u).alias("stem"),
    )


@query("""SELECT o_orderkey, CASE WHEN s >= 86400 THEN s // 86400 || 'd ' || (s // 3600 - s // 86400 * 24) || 'h' ELSE s // 3600 || 'h ' || (s // 60 - s // 3600 * 60) || 'm' END AS eta
FROM (SELECT o_orderkey, floor(o_totalprice)::BIGINT AS s FROM orders)""")
def eta_format(t):
    return t("orders").select("o_orderkey", T.duration(F.floor("o_totalprice")).alias("eta"))


@query("""SELECT lang || '-' || source || '-' || coalesce(quality::VARCHAR, 'none') AS name, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1""")
def structured_names(t):
    rows = t("documents").select("doc_id", "lang", "source").join(t("labels").select("doc_id", "quality"), "doc_id", "left")
    name = F.concat_ws("-", "lang", "source", F.coalesce(F.col("quality").cast("string"), F.lit("none")))
    return rows.groupBy(name.alias("name")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT event_type, '{"n":' || count(*) || ',"top":' || max(event_id) || '}' AS metrics FROM events GROUP BY event_type""")
def metrics_json(t):
    agg = t("events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("top"))
    return agg.select("event_type", F.to_json(F.struct("n", "top")).alias("metrics"))


@query("SELECT event_id, round(1 / (1 + exp(-(value / 100 - 2))), 9) AS sigmoid, round((1 + cos(3.141592653589793 * value / 500)) / 2, 9) AS annealed, round(log10(greatest(value / 1e6, 1e-5)), 9) AS log_floor, round(least(greatest(value, 5), 100), 6) AS clamped FROM events")
def schedule_math(t):
    v = F.col("value")
    return t("events").select(
        "event_id",
        F.round(T.sigmoid(v / 100 - 2), 9).alias("sigmoid"),
        F.round(T.cosine_anneal(v, 500), 9).alias("annealed"),
        F.round(F.log10(F.greatest(v / 1e6, F.lit(1e-5))), 9).alias("log_floor"),
        F.round(F.least(F.greatest(v, F.lit(5.0)), F.lit(100.0)), 6).alias("clamped"),
    )


@query("SELECT n_nationkey, 'net.' || replace(n_name, 'NATION', 'block') AS key FROM nation")
def renamed_weights(t):
    weights = F.create_map(F.concat(F.lit("module.net."), F.col("n_name")), F.col("n_nationkey"))
    return t("nation").select("n_nationkey", F.map_keys(T.renamed_keys(weights, "module\\.", "NATION", "block"))[0].alias("key"))


@query("""SELECT vec_id, list_aggregate(list_transform(embedding, lambda x: abs(x::DOUBLE)), 'max') >= 0.3 AS loud, len(embedding) >= 64 AS whole, list_bool_and(list_transform(embedding, lambda x: isfinite(x))) AS finite FROM embeddings""")
def signal_filters(t):
    e = F.col("embedding")
    return t("embeddings").select("vec_id", (V.max_abs(e) >= 0.3).alias("loud"), (F.size(e) >= 64).alias("whole"), V.finite(e).alias("finite"))


@query("SELECT doc_id, CASE WHEN toxic = 1 THEN 10 WHEN quality = 1 THEN 9 ELSE 0 END::INTEGER AS flag FROM labels")
def policy_flags(t):
    return t("labels").select("doc_id", F.when(F.col("toxic") == 1, 10).when(F.col("quality") == 1, 9).otherwise(0).alias("flag"))


@query("SELECT doc_id, md5(text) AS digest, substr(text, 1, 60) AS preview FROM documents")
def preview_digest(t):
    return t("documents").select("doc_id", F.md5("text").alias("digest"), F.substring("text", 1, 60).alias("preview"))


@query("""SELECT conv_id, turn, list_concat(w[1:77], list_transform(range(greatest(77 - len(w), 0)), lambda i: ''))[77] AS last_token, least(len(w), 77)::INTEGER AS tokens
FROM (SELECT conv_id, turn, string_split(text, ' ') AS w FROM conversations)""")
def padded_tokens(t):
    w = F.split("text", " ")
    padded = F.concat(F.slice(w, 1, 77), F.array_repeat(F.lit(""), F.greatest(F.lit(77) - F.size(w), F.lit(0))))
    return t("conversations").select("conv_id", "turn", padded[76].alias("last_token"), F.least(F.size(w), F.lit(77)).alias("tokens"))
