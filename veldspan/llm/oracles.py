"""DuckDB SQL for the corpus queries that SQL can express."""

WORDS = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"


def unit(seed: str) -> str:
    return f"(('0x' || substr(md5('{seed}:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE)"


MIX = f"""
WITH d AS (SELECT doc_id, source, {WORDS}::BIGINT AS size, {unit('mix-2024')} AS u FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS kind FROM d GROUP BY source),
w AS (SELECT *, (kind + 1)::DOUBLE AS weight, 3 * source_size AS cap, sum(source_size) OVER () AS total FROM s),
o AS (SELECT *, cap / weight AS ratio,
  coalesce(sum(cap) OVER (ORDER BY cap / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent,
  sum(weight) OVER (ORDER BY cap / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight FROM w),
l AS (SELECT arg_min((total - spent) / open_weight, ratio) FILTER (WHERE (total - spent) / open_weight <= ratio) AS level FROM o),
t AS (SELECT source, source_size, kind, least(cap::DOUBLE, weight * level) AS target FROM w, l),
c AS (SELECT d.doc_id, d.size, t.source_size, t.kind, t.target,
  (sum(d.size) OVER (PARTITION BY d.source ORDER BY u, doc_id, d.size ROWS UNBOUNDED PRECEDING) - d.size)::BIGINT AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
k AS (SELECT *, floor(target)::BIGINT AS budget, start / target AS share FROM c),
p AS (SELECT *, least(size, greatest(0, budget - start)) + least(size, greatest(0, budget - start - source_size)) + least(size, greatest(0, budget - start - 2 * source_size)) AS taken FROM k)
SELECT doc_id, size, source_size, target, taken::BIGINT AS taken,
  CASE WHEN size = 0 THEN 0 ELSE (start + size / 2 < target)::INTEGER + (start + source_size + size / 2 < target)::INTEGER + (start + 2 * source_size + size / 2 < target)::INTEGER END AS copies,
  CASE WHEN taken > 0 THEN round(CASE WHEN share >= 1 THEN 1.0
    WHEN kind = 0 THEN (sqrt(2.25 - 2 * share) - 1.5) / -1 WHEN kind = 1 THEN share
    WHEN share < 0.375 THEN (sqrt(2.25 + 6 * share * 3) - 1.5) / 3
    ELSE 0.5 + (sqrt(9 + 6 * (share - 0.375) * 3) - 3) / 3 END, 9) END AS position
FROM p
"""

JOIN = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
sh AS (SELECT DISTINCT doc_id, s FROM (
  SELECT doc_id, unnest(list_transform(range(len(w) - $words + 1), lambda i: array_to_string(w[i + 1 : i + $words], ' '))) AS s FROM w WHERE len(w) >= $words
  UNION ALL SELECT doc_id, '/' || array_to_string(w, ' ') FROM w WHERE len(w) BETWEEN 1 AND $words - 1)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= $percent * (x.n + y.n - k)),
sym AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, sym.b FROM r JOIN sym ON r.b = sym.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.b AS component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(b) AS b FROM r GROUP BY a) c ON c.a = d.doc_id
"""
LINKS = JOIN.replace("$words", "5").replace("$percent", "75")
NEAR = f"SELECT *, doc_id = component_id AS kept FROM ({JOIN.replace('$words', '4').replace('$percent', '80')})"

#: CRC-32 by its table, which is made from the polynomial.
SHARDS = f"""
WITH t AS (SELECT list(list_reduce(list_prepend(i::BIGINT, range(8)),
  lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS crc FROM range(256) r(i)),
b AS (SELECT doc_id, source, {unit('shard-2024')} AS u, (strlen(coalesce(text, '')) + 16)::BIGINT AS size,
  list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT) AS bytes FROM documents),
c AS (SELECT doc_id, source, u, size,
  xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda c, x: xor(c >> 8, crc[(xor(c, x) & 255) + 1])), 4294967295)::BIGINT AS text_crc32 FROM b, t),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY u, doc_id, size) - 1 AS place, count(*) OVER (PARTITION BY source) AS n_source FROM c),
p AS (SELECT *, row_number() OVER (ORDER BY (2 * place + 1)::DOUBLE / (2 * n_source)::DOUBLE, u, doc_id, size) - 1 AS pos, count(*) OVER () AS n FROM r)
SELECT doc_id, size, text_crc32, 'rows' AS law, ((pos * 40) // n)::INTEGER AS shard,
  (pos - (((pos * 40) // n) * n + 39) // 40)::BIGINT AS slot, NULL::INTEGER AS grown_shard
FROM p
"""


RULES = r"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
lines AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
grams AS (SELECT doc_id, i, w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] AS g FROM (SELECT doc_id, w, unnest(range(len(w) - 2)) AS i FROM d WHERE len(w) > 2)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM grams) WHERE n > 1),
repeated AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY doc_id),
base AS (SELECT d.doc_id, d.lang, text, w, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
  len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words
  FROM d JOIN lines USING (doc_id) LEFT JOIN repeated r ON r.doc_id = d.doc_id),
judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base),
seven AS (SELECT doc_id, lang, base_failed, length(text) AS chars, list_transform(['[a-z]', '[A-Z]', '[0-9]', '[ \t\x0B\x0C\r]', '\n', '[.,;:?''"()-]', '[#*$%&|<>]', '[^\x00-\x7F]'],
  lambda x: len(regexp_extract_all(text, x))) AS c FROM judged),
classes AS (SELECT doc_id, lang, base_failed, list_append(c, chars - list_sum(c))::DOUBLE[] AS c FROM seven),
class_bins AS (SELECT doc_id, lang, base_failed, unnest(range(9)) AS i, unnest(c) AS n FROM classes),
class_ref AS (SELECT lang, i, sum(n) / sum(sum(n)) OVER (PARTITION BY lang) AS q FROM class_bins WHERE NOT base_failed AND lang IS NOT NULL GROUP BY lang, i),
class_doc AS (SELECT doc_id, i, n / greatest(sum(n) OVER (PARTITION BY doc_id), 1) AS p FROM class_bins),
class_js AS (SELECT doc_id, lang, sqrt(least(greatest(sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2, 0), 1)) AS dc
  FROM class_doc JOIN class_ref USING (i) GROUP BY doc_id, lang),
word_count AS (SELECT doc_id, x, count(*) AS n FROM (SELECT doc_id, unnest(w) AS x FROM judged) GROUP BY doc_id, x),
lang_words AS (SELECT lang, sum(n_words) AS total FROM judged WHERE NOT base_failed AND lang IS NOT NULL GROUP BY lang),
common AS (SELECT lang, x, n / total AS q FROM (SELECT lang, x, sum(n) AS n FROM word_count JOIN judged USING (doc_id) WHERE NOT base_failed AND lang IS NOT NULL GROUP BY lang, x)
  JOIN lang_words USING (lang) WHERE n >= 0.004 * total),
rest AS (SELECT lang, 1 - sum(q) AS q FROM common GROUP BY lang),
bins AS (SELECT k.doc_id, r.lang, r.x, r.q, coalesce(c.n, 0) / greatest(k.n_words, 1) AS p FROM judged k CROSS JOIN common r LEFT JOIN word_count c ON c.doc_id = k.doc_id AND c.x = r.x),
all_bins AS (SELECT doc_id, lang, q, p FROM bins UNION ALL
  SELECT b.doc_id, b.lang, any_value(r.q), CASE WHEN any_value(k.n_words) > 0 THEN 1 - sum(b.p) ELSE 0 END FROM bins b JOIN rest r ON r.lang = b.lang JOIN judged k ON k.doc_id = b.doc_id GROUP BY b.doc_id, b.lang),
word_js AS (SELECT doc_id, lang, sqrt(least(greatest(sum(CASE WHEN p > 1e-12 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2, 0), 1)) AS dw
  FROM all_bins GROUP BY doc_id, lang),
none_js AS (SELECT lang, sqrt((1 * log2(1 / ((1 + r.q) / 2)) + r.q * log2(r.q / ((1 + r.q) / 2)) + (1 - r.q)) / 2) AS d0 FROM rest r),
near AS (SELECT doc_id, dc, CASE WHEN n_words * (1 - rest.q) < 5 THEN 0 ELSE dw / d0 END AS dw
  FROM class_js JOIN word_js USING (doc_id, lang) JOIN none_js USING (lang) JOIN rest USING (lang) JOIN judged USING (doc_id)),
best AS (SELECT doc_id, worst, dc, dw FROM (SELECT *, round(greatest(dc / 0.3, dw / 0.98), 9) AS worst FROM near) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY worst, dc) = 1)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND worst <= 1 AS kept,
  round(dc, 4) AS class_distance, round(dw, 4) AS word_distance
FROM judged JOIN best USING (doc_id)
"""

CRC_TABLE = """SELECT list(list_reduce(list_prepend(i::BIGINT, range(8)),
  lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS crc FROM range(256) r(i)"""


def crc32(text: str) -> str:
    """The unsigned CRC-32 of a text, beside the column ``crc`` of CRC_TABLE."""
    raw = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: ('0x' || h)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {raw}), lambda c, x: xor(c >> 8, crc[(xor(c, x) & 255) + 1])), 4294967295)::BIGINT"


def field(value: str) -> str:
    return f"coalesce(strlen({value}::VARCHAR) || ':' || {value}::VARCHAR, '-')"


LEAF = " || ".join(map(field, ("doc_id", "source", "lang", "n_chars")))
MANIFEST = f"""
WITH RECURSIVE t AS ({CRC_TABLE}),
l AS (SELECT doc_id, lang, sha256({LEAF} || {field('text')}) AS leaf,
  CASE WHEN {crc32('doc_id::VARCHAR')} % 3 = 0 THEN sha2_low ELSE sha256({LEAF} || {field('text')}) END AS seen
  FROM (SELECT *, sha256({LEAF} || {field("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}) AS sha2_low FROM documents), t),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM l),
a AS (SELECT lang, 0 AS level, pos, leaf AS h, n FROM r
  UNION ALL SELECT lang, level + 1, pos // 8, sha256(string_agg(h, '' ORDER BY pos)), (n + 7) // 8 FROM a WHERE n > 1 GROUP BY lang, level, pos // 8, n),
s AS (SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM a WHERE n = 1),
b AS (SELECT 0 AS level, pos, subroot AS h, n FROM s
  UNION ALL SELECT level + 1, pos // 8, sha256(string_agg(h, '' ORDER BY pos)), (n + 7) // 8 FROM b WHERE n > 1 GROUP BY level, pos // 8, n),
nodes AS (SELECT coalesce('1' || lang, '0') AS tree, level AS step, level, pos, h FROM a WHERE n > 1 UNION ALL SELECT '', 100 + level, level, pos, h FROM b WHERE n > 1),
leaves AS (SELECT r.doc_id, r.leaf, r.seen, r.pos AS pos, s.pos AS place, coalesce('1' || r.lang, '0') AS tree, s.subroot, row_number() OVER () AS leaf_no
  FROM r JOIN s ON r.lang IS NOT DISTINCT FROM s.lang),
spots AS (SELECT leaf_no, tree, pos FROM leaves UNION ALL SELECT leaf_no, '', place FROM leaves),
beside AS (SELECT leaf_no, step, coalesce(string_agg(h, '' ORDER BY n.pos) FILTER (WHERE n.pos < spots.pos // (8 ** level)::BIGINT), '') AS l,
  coalesce(string_agg(h, '' ORDER BY n.pos) FILTER (WHERE n.pos > spots.pos // (8 ** level)::BIGINT), '') AS r
  FROM spots JOIN nodes n ON n.tree = spots.tree AND n.pos // 8 = spots.pos // (8 ** (level + 1))::BIGINT GROUP BY leaf_no, step),
steps AS (SELECT *, row_number() OVER (PARTITION BY leaf_no ORDER BY step) AS i FROM beside),
fold AS (SELECT leaf_no, 0 AS i, seen AS h FROM leaves UNION ALL SELECT f.leaf_no, f.i + 1, sha256(x.l || f.h || x.r) FROM fold f JOIN steps x ON x.leaf_no = f.leaf_no AND x.i = f.i + 1),
folded AS (SELECT leaf_no, arg_max(h, i) AS h FROM fold GROUP BY leaf_no),
proof AS (SELECT leaf_no, string_agg(l || r, '' ORDER BY i) AS p FROM steps GROUP BY leaf_no)
SELECT doc_id, leaf, subroot, root.h AS root, sha256(coalesce(p, '')) AS proof_sha256, folded.h AS folded_root, folded.h = root.h AS verified
FROM leaves JOIN folded USING (leaf_no) LEFT JOIN proof USING (leaf_no) CROSS JOIN (SELECT h FROM b WHERE n = 1) root
"""

TRIE = f"""
WITH t AS ({CRC_TABLE}),
w AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
p AS (SELECT conv_id, length(text) AS chars, strlen(role) || ':' || role || strlen(text) || ':' || text AS step,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(strlen(role) || ':' || role || text)) - 1 AS place FROM w),
c AS (SELECT conv_id, conv_id - conv_id % 100 AS base, {crc32('conv_id::VARCHAR')} % 6 AS h FROM (SELECT DISTINCT conv_id FROM w), t),
r AS (SELECT c.conv_id, 0 AS part, place, step, chars FROM c JOIN p ON p.conv_id = c.base AND place < h
  UNION ALL SELECT p.conv_id, 1, place, step, chars FROM p JOIN c USING (conv_id) WHERE place >= h),
s AS (SELECT conv_id, chars, step, row_number() OVER (PARTITION BY conv_id ORDER BY part, place) AS depth FROM r),
way AS (SELECT conv_id, depth, chars, md5(string_agg(step, '') OVER (PARTITION BY conv_id ORDER BY depth)) AS node FROM s
  UNION ALL SELECT conv_id, 0, 0, '' FROM c),
ending AS (SELECT conv_id, max(depth) AS depth FROM way GROUP BY conv_id),
nodes AS (SELECT depth, node, min(conv_id) AS conv_id, count(*) AS n, any_value(chars) AS chars FROM way GROUP BY depth, node),
up AS (SELECT n.*, w.node AS above, a.conv_id AS parent FROM nodes n LEFT JOIN way w ON w.conv_id = n.conv_id AND w.depth = n.depth - 1
  LEFT JOIN nodes a ON a.node = w.node AND a.depth = w.depth),
kids AS (SELECT depth - 1 AS depth, above AS node, count(*) AS k FROM up WHERE above IS NOT NULL GROUP BY ALL),
full_nodes AS (SELECT up.*, coalesce(k, 0) AS k FROM up LEFT JOIN kids USING (depth, node)),
sums AS (SELECT w.depth, w.node, sum((u.k = 0)::INT) AS leaves, sum((u.n - 1) * u.chars) AS saved FROM full_nodes u JOIN way w ON w.conv_id = u.conv_id AND w.depth <= u.depth GROUP BY ALL),
ends AS (SELECT depth, node, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends FROM way JOIN ending USING (conv_id, depth) GROUP BY ALL)
SELECT conv_id, depth::BIGINT AS depth, parent AS parent_conv_id, n AS n_convs, k AS n_children, leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, coalesce(ends, sha256('')) AS ends_sha256
FROM full_nodes JOIN sums USING (depth, node) LEFT JOIN ends USING (depth, node)
"""

SQL: dict[str, str] = {
    "op1_curriculum_mix": MIX,
    "op5_divergence_rules": RULES,
    "op8_stratified_shards": SHARDS,
    "op9_divide_skip_join": LINKS,
    "op11_superminhash": NEAR,
    "op12_prefix_trie": TRIE,
    "op13_merkle_manifest": MANIFEST,
}
