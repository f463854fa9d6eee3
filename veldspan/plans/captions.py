"""Queries on items, captions, lookups and sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.ordering import with_position
from ..functions.text import alignment_prompt
from ..operators import lookup, sampling, segment, validate
from .registry import query

SEGMENTS = """
  SELECT doc_id, lang, n, CASE WHEN n > 1 THEN (n_chars - 500) // (n - 1) ELSE 0 END AS step, unnest(range(n)) AS i
  FROM (SELECT doc_id, lang, n_chars, least(5, greatest(n_chars // 500, 1)) AS n FROM documents WHERE n_chars >= 250)"""


def unit(seed: str, key: str) -> str:
    return f"(('0x' || substr(md5('{seed}:' || coalesce({key}::VARCHAR, '')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE)"


@query(f"""SELECT doc_id || '_' || i AS clip_id, doc_id::VARCHAR AS name, (i * step)::BIGINT AS start_sample, (i * step + 500)::BIGINT AS end_sample
FROM ({SEGMENTS})""")
def seg_clips(t):
    return segment.clip_segments(t("documents"), "doc_id", "n_chars", 500)


@query(f"""SELECT s.lang, count(DISTINCT s.doc_id) AS items, count(*) AS segments, count(l.quality) AS labelled,
  coalesce(sum(l.quality), 0)::BIGINT AS good, max(i * step + 500)::BIGINT AS last_end
FROM ({SEGMENTS}) s LEFT JOIN labels l USING (doc_id) GROUP BY s.lang""")
def seg_profile(t):
    docs = t("documents").select("doc_id", "lang", "n_chars")
    clips = segment.clip_segments(docs, "doc_id", "n_chars", 500).withColumn("doc_id", F.col("name").cast("long"))
    per_item = clips.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.max("end_sample").alias("last"))
    labelled = docs.join(per_item, "doc_id").join(t("labels"), "doc_id", "left")
    return labelled.groupBy("lang").agg(
        F.count(F.lit(1)).alias("items"),
        F.sum("n").alias("segments"),
        F.coalesce(F.sum(F.when(F.col("quality").isNotNull(), F.col("n"))), F.lit(0)).alias("labelled"),
        F.coalesce(F.sum(F.col("n") * F.col("quality")), F.lit(0)).alias("good"),
        F.max("last").alias("last_end"),
    )


@query("SELECT doc_id || '_0' AS clip_id, doc_id::VARCHAR AS name, 0::BIGINT AS start_sample, 160000::BIGINT AS end_sample FROM documents")
def seg_fixed(t):
    return segment.fixed_segment(t("documents"), "doc_id", 160000)


@query("""SELECT d.doc_id, c.text AS caption FROM documents d
JOIN (SELECT conv_id, arg_max(text, turn) AS text FROM conversations GROUP BY conv_id) c ON d.doc_id = c.conv_id""")
def clip_caption_single(t):
    docs, captions = t("documents").select("doc_id"), t("conversations")
    return lookup.attach_captions(docs, captions, "doc_id", "conv_id", "turn", "text").select("doc_id", F.col("text").alias("caption"))


@query("SELECT d.doc_id, c.turn, c.text AS caption FROM documents d JOIN conversations c ON d.doc_id = c.conv_id")
def clip_caption_multi(t):
    docs, captions = t("documents").select("doc_id"), t("conversations")
    return lookup.attach_captions(docs, captions, "doc_id", "conv_id", "turn", "text", "all").select("doc_id", "turn", F.col("text").alias("caption"))


@query("SELECT conv_id, count(*) AS n, string_agg(md5(text), ',' ORDER BY turn) AS captions FROM conversations GROUP BY conv_id")
def caption_slots(t):
    lists = lookup.caption_list(t("conversations"), "conv_id", "turn", "text")
    return lists.select("conv_id", F.size("captions").cast("long").alias("n"), F.array_join(F.transform("captions", F.md5), ",").alias("captions"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT conv_id FROM conversations)")
def missing_captions(t):
    return lookup.without_match(t("documents").select("doc_id"), t("conversations"), "doc_id", "conv_id")


@query("SELECT count(*) AS total, count(l.doc_id) AS written, count(*) - count(l.doc_id) AS missing FROM documents d LEFT JOIN labels l USING (doc_id)")
def attach_score_report(t):
    return lookup.match_report(t("documents").select("doc_id"), t("labels"), "doc_id")


@query("""SELECT d.pos, doc_id, vec_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS pos FROM documents) d
JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS pos FROM embeddings) e ON d.pos = e.pos""")
def positional_zip(t):
    docs = with_position(t("documents").select("doc_id"), "doc_id")
    return docs.join(with_position(t("embeddings").select("vec_id"), "vec_id"), "pos")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def resume_pending(t):
    return lookup.without_match(t("orders").select("o_orderkey"), t("lineitem"), "o_orderkey", "l_orderkey")


@query("SELECT vec_id, label FROM embeddings WHERE vec_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def listed_only(t):
    return lookup.with_match(t("embeddings").select("vec_id", "label"), t("labels").filter("quality = 1"), "vec_id", "doc_id")


@query("""SELECT p_partkey, 'id_' || lpad(p_partkey::VARCHAR, 6, '0') || '.mp4' AS file FROM part
WHERE 'id_' || lpad(p_partkey::VARCHAR, 6, '0') || '.mp4' IN (SELECT 'id_' || lpad(s_suppkey::VARCHAR, 6, '0') || '.mp4' FROM supplier)""")
def composite_key_lookup(t):
    parts = t("part").select("p_partkey", lookup.padded_key(F.col("p_partkey"), 6, "id_", ".mp4").alias("file"))
    present = t("supplier").select(lookup.padded_key(F.col("s_suppkey"), 6, "id_", ".mp4").alias("file"))
    return lookup.with_match(parts, present, "file", "file")


@query("SELECT d.doc_id, coalesce(l.quality, 9)::INTEGER AS q_level, coalesce(l.toxic, 0)::INTEGER AS toxic FROM documents d LEFT JOIN labels l USING (doc_id)")
def override_merge(t):
    old = t("documents").select("doc_id", F.lit(9).alias("q_level"), F.lit(0).alias("toxic"))
    return lookup.override(old, t("labels").withColumnRenamed("quality", "q_level"), "doc_id", ["q_level", "toxic"])


@query("""WITH s AS (SELECT doc_id AS source, coalesce(n_chars, 0) AS size FROM documents),
e AS (SELECT source, size, sum(size) OVER (ORDER BY source ROWS UNBOUNDED PRECEDING) AS e, sum(size) OVER () AS total FROM s),
i AS (SELECT o_orderkey, (o_orderkey * 104729) % (2 * total + 2000) - total - 1000 AS idx FROM orders, (SELECT any_value(total) AS total FROM e)),
p AS (SELECT o_orderkey, idx, CASE WHEN idx < 0 THEN total + idx ELSE idx END AS pos FROM i, (SELECT any_value(total) AS total FROM e))
SELECT o_orderkey, idx::BIGINT AS idx, source, (pos - (e - size))::BIGINT AS local_index FROM p JOIN e ON pos >= e - size AND pos < e""")
def global_index_lookup(t):
    docs = t("documents").select(F.col("doc_id").alias("source"), F.col("doc_id").alias("ordinal"), F.coalesce("n_chars", F.lit(0)).cast("long").alias("size"))
    total = docs.agg(F.sum("size").alias("total"))
    wanted = t("orders").crossJoin(F.broadcast(total)).select("o_orderkey", (F.col("o_orderkey") * 104729 % (2 * F.col("total") + 2000) - F.col("total") - 1000).alias("idx"))
    found = lookup.locate(wanted.select("idx").distinct(), docs, "idx")
    return wanted.join(found, "idx").select("o_orderkey", "idx", "source", "local_index")


@query("SELECT conv_id, arg_min(turn, md5('7:' || conv_id || ':' || turn)) AS turn, arg_min(text, md5('7:' || conv_id || ':' || turn)) AS text FROM conversations GROUP BY conv_id")
def candidate_random(t):
    from ..operators.candidates import pick_random

    return pick_random(t("conversations").select("conv_id", "turn", "text"), "conv_id", F.concat_ws(":", "conv_id", "turn"), "7")


@query("SELECT doc_id, n_chars, (ntile(10) OVER (ORDER BY n_chars, doc_id) - 1)::INTEGER AS q_level FROM documents")
def q_level_equal_freq(t):
    return sampling.levels(t("documents").select("doc_id", "n_chars"), "n_chars", "doc_id")


@query("""SELECT q_level, count(*) AS items, round(avg((lang = 'en')::INTEGER), 6) AS share_en, count(toxic) AS labelled, round(avg(toxic), 6) AS share_toxic
FROM (SELECT doc_id, lang, (ntile(10) OVER (ORDER BY n_chars, doc_id) - 1)::INTEGER AS q_level FROM documents) LEFT JOIN labels USING (doc_id) GROUP BY q_level""")
def q_level_profile(t):
    levels = sampling.levels(t("documents").select("doc_id", "lang", "n_chars"), "n_chars", "doc_id")
    return levels.join(t("labels"), "doc_id", "left").groupBy("q_level").agg(
        F.count(F.lit(1)).alias("items"),
        F.round(F.avg((F.col("lang") == "en").cast("int")), 6).alias("share_en"),
        F.count("toxic").alias("labelled"),
        F.round(F.avg("toxic"), 6).alias("share_toxic"),
    )


@query(f"""WITH l AS (SELECT d.doc_id, n_chars, quality FROM documents d JOIN labels USING (doc_id)),
k AS (SELECT count(*) AS k FROM l WHERE quality = 1),
r AS (SELECT *, row_number() OVER (ORDER BY {unit('half', 'doc_id')}, doc_id) AS rn FROM l)
SELECT 'filtered' AS kind, count(*) AS items, round(avg(n_chars), 6) AS mean_chars FROM l WHERE quality = 1
UNION ALL SELECT 'random', count(*), round(avg(n_chars), 6) FROM r, k WHERE rn <= k""")
def hard_filter_vs_random(t):
    rows = t("documents").select("doc_id", "n_chars").join(t("labels").select("doc_id", "quality"), "doc_id")
    kept = rows.filter("quality = 1")
    control = sampling.sample_exactly(rows, kept.count(), "half", "doc_id")
    measure = [F.count(F.lit(1)).alias("items"), F.round(F.avg("n_chars"), 6).alias("mean_chars")]
    return kept.agg(F.lit("filtered").alias("kind"), *measure).unionByName(control.agg(F.lit("random").alias("kind"), *measure))


@query("SELECT event_id, printf('Text alignment is %.2f. ', value / 500) || event_type AS caption FROM events")
def prefix_prompt(t):
    return t("events").select("event_id", alignment_prompt("value / 500", F.col("event_type")).alias("caption"))


@query("""SELECT idx, e.text AS expected_text, f.text AS found_text FROM (SELECT item_id AS idx, md5(text) AS text FROM benchmark) e
FULL OUTER JOIN (SELECT item_id + 1 AS idx, md5(text) AS text FROM benchmark) f USING (idx) WHERE e.text IS DISTINCT FROM f.text""")
def manifest_diff(t):
    items = t("benchmark").select(F.col("item_id").alias("idx"), F.md5("text").alias("text"))
    shifted = items.select((F.col("idx") + 1).alias("idx"), "text")
    return validate.manifest_mismatches(items, shifted, "idx", ["text"])


@query("SELECT md5(text) AS digest, count(*) AS n FROM documents GROUP BY md5(text) HAVING count(*) > 1")
def dup_ids(t):
    return validate.duplicates(t("documents").select(F.md5("text").alias("digest")), "digest")


@query("SELECT count(*) AS vectors, count(*) FILTER (WHERE embedding IS NULL OR len(embedding) <> 64) AS wrong FROM embeddings")
def dim_check(t):
    rows = t("embeddings")
    wrong = validate.wrong_size(rows, "embedding", 64).agg(F.count(F.lit(1)).alias("wrong"))
    return rows.agg(F.count(F.lit(1)).alias("vectors")).crossJoin(F.broadcast(wrong))


@query("""WITH b AS (SELECT DISTINCT item_id, line FROM (SELECT item_id, unnest(string_split(text, chr(10))) AS line FROM benchmark) WHERE length(line) >= 40),
d AS (SELECT DISTINCT doc_id, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE length(line) >= 40)
SELECT item_id, doc_id, count(*) AS lines FROM b JOIN d USING (line) GROUP BY item_id, doc_id""")
def leakage_overlap(t):
    return validate.shared_lines(t("benchmark"), t("documents"), "item_id", "doc_id", "text")


@query("""SELECT 0 AS source, unnest([0, 1, 2]) AS repeat, item_id AS id, length(text)::BIGINT AS chars FROM benchmark
UNION ALL SELECT 1, 0, doc_id, length(text)::BIGINT FROM documents""")
def oversample_union(t):
    narrow = lambda df, key: df.select(F.col(key).alias("id"), F.length("text").cast("long").alias("chars"))
    return sampling.concatenated([(narrow(t("benchmark"), "item_id"), 3), (narrow(t("documents"), "doc_id"), 1)])


@query(f"""SELECT doc_id, pos, (pos % 4)::INTEGER AS shard
FROM (SELECT doc_id, row_number() OVER (ORDER BY {unit('epoch3', 'doc_id')}, doc_id) - 1 AS pos FROM documents)""")
def epoch_shuffle_shard(t):
    return sampling.shuffled_shards(t("documents").select("doc_id"), 3, 4, "doc_id")


@query(f"SELECT doc_id, CASE WHEN {unit('drop', 'doc_id')} < 0.1 THEN '' ELSE md5(text) END AS condition FROM documents")
def cond_dropout(t):
    gone = sampling.dropped(F.col("doc_id"), "drop", 0.1)
    return t("documents").select("doc_id", F.when(gone, F.lit("")).otherwise(F.md5("text")).alias("condition"))


@query("SELECT q.q::INTEGER AS q, r_name AS benchmark FROM (SELECT unnest(range(10)) AS q) q, region")
def sweep_grid(t):
    return t("region").select(F.explode(F.sequence(F.lit(0), F.lit(9))).alias("q"), F.col("r_name").alias("benchmark"))


@query("SELECT (pos // 64)::BIGINT AS batch, count(*) AS items, min(doc_id) AS first FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS pos FROM documents) GROUP BY 1")
def fixed_batches(t):
    placed = segment.batches(with_position(t("documents").select("doc_id"), "doc_id"), "pos", 64)
    return placed.groupBy("batch").agg(F.count(F.lit(1)).alias("items"), F.min("doc_id").alias("first"))


@query("SELECT doc_id, n_chars FROM (SELECT doc_id, n_chars, row_number() OVER (ORDER BY doc_id) - 1 AS pos FROM documents) WHERE pos IN (0, 1, 100, 1000, 10000)")
def probe_rows(t):
    placed = with_position(t("documents").select("doc_id", "n_chars"), "doc_id")
    return placed.filter(F.col("pos").isin(0, 1, 100, 1000, 10000)).select("doc_id", "n_chars")
