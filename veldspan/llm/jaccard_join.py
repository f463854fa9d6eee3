"""Exact n-gram Jaccard join by T-occurrence search.

A document is the set of its distinct five-word shingles (64-bit hashes).  Documents with
equal sets are one node.  Two nodes link when 100 |A and B| >= 75 |A or B|.

Candidates.  If A and B link, they share a shingle among the first n - ceil(0.75 n) + 1 of
each, in any order common to all; here shingles that are frequent in a sample come last,
so that common passages make no long lists.  Prefix shingles meet by hash bucket.  Nodes
of a list are paired if their sizes allow a link; a pair is dropped where the parity
bitmaps of the two sets differ in more bits than two linked sets can have different
shingles (each differing bit needs one).  Lists of over PAIR_LIST nodes are compared as a
whole, bitmap against bitmap, in the task they meet in, and only join what may link; lists
of over BLOCK nodes are not compared, their nodes stay together.  Components of what
remains are clusters; linked nodes are always in one cluster.

Search.  Within a cluster, each node queries an inverted index of the others: its short
lists are merged by counting, the longest are set aside as DivideSkip does, nodes reached
often enough are probed in the long ones by binary search, and those that reach the
required overlap are links.  Nodes already joined are not probed again.  Clusters over
BLOCK nodes are searched in blocks, twice with different blocks; nodes that are then not in
the cluster's largest component query all blocks, so no link is lost and no task holds a
whole large cluster.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .components import Forest, connected_components
from .shared import map_text, materialise, seeded_unit, shuffle_width, workers_find_package

WORDS = 5
PERCENT = 75
SEED = "jaccard-2024"
SAMPLE_DOCS, SAMPLE_SHARE = 4_000, 0.03
FREQUENT_COUNT, MAX_FREQUENT = 3, 500_000
PAIR_LIST = 64
PAIR, STAR, MEMBER = 0, 1, 2
BLOCK = 512
MU = 0.0085  # DivideSkip's cost ratio of merging and probing


def needed(a, b):
    """Least overlap at which sets of sizes a and b link: ceil(75 (a + b) / 175)."""
    return -(-PERCENT * (a + b) // (100 + PERCENT))


def set_keys(h: np.ndarray, o: np.ndarray) -> np.ndarray:
    """One number for each set; the same for equal sets."""
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(K.mix(h ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64, out=total[1:])
    return K.mix((total[o[1:]] - total[o[:-1]]) ^ (np.diff(o).astype(np.uint64) << np.uint64(40)))


def parity_bitmaps(h: np.ndarray, o: np.ndarray) -> pa.Array:
    """For each set, a power of two of at least twice its size bits: the parity of what falls on each."""
    n = np.diff(o)
    bits = np.maximum(64, 1 << np.ceil(np.log2(np.maximum(2 * n, 2))).astype(np.int64))
    first = np.concatenate([[0], np.cumsum(bits)])
    owner = np.repeat(np.arange(len(n)), n)
    at = first[owner] + ((h >> np.uint64(9)).astype(np.int64) & (bits[owner] - 1))
    raw = np.packbits((np.bincount(at, minlength=first[-1]) & 1).astype(np.uint8))
    return K.packed(raw, first // 8)


def bitmap_distance(a: bytes, b: bytes) -> int:
    """A lower bound of how many elements are in one set only."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    if len(x) < len(y):
        x, y = y, x
    while len(x) > len(y):
        half = len(x) // 2
        x = x[:half] ^ x[half:]
    return int(np.bitwise_count(x ^ y).sum())


def all_sets(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, key, n, node, bitmap) of every row; node is null for empty sets."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def task():
        def each(s, rest):
            h, o = K.shingle_sets(K.words(s.data, s.offsets), s.hi - s.lo, WORDS)
            n = np.diff(o)
            node = pa.array(set_keys(h, o).view(np.int64), pa.int64(), mask=n == 0)
            return {"doc_id": rest[0], "key": rest[1], "n": n, "node": node, "bitmap": parity_bitmaps(h, o)}

        return each, None

    return map_text(keyed(docs, id_col, text_col), f"doc_id {id_type}, key string, n long, node long, bitmap binary", task, limit=K.LEAN_BYTES)


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(text, doc_id, key): the key is the id, or for a null id a digest of the text."""
    key = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("~"), F.md5(F.col(text_col))), F.lit("~"))
    return docs.select(F.col(text_col).alias("text"), F.col(id_col).alias("doc_id"), key.alias("key"))


def frequent_shingles(docs: DataFrame, rows: int, id_col: str, text_col: str) -> np.ndarray:
    """Shingles of several documents of a sample; they only set the order, never the result."""
    share = max(SAMPLE_SHARE, SAMPLE_DOCS / max(rows, 1))
    sample = docs.filter(seeded_unit(SEED, F.col(id_col)) < share).select(F.col(text_col).alias("text"))

    def task():
        def each(s, rest):
            h, _ = K.shingle_sets(K.words(s.data, s.offsets), s.hi - s.lo, WORDS)
            h, n = np.unique(h, return_counts=True)
            return {"hash": h.view(np.int64), "n": n}

        return each, None

    counted = map_text(sample, "hash long, n long", task, limit=K.LEAN_BYTES).groupBy("hash").agg(F.sum("n").alias("n")).filter(F.col("n") >= FREQUENT_COUNT)
    top = counted.orderBy(F.desc("n"), "hash").limit(MAX_FREQUENT)
    return np.sort(np.array([r["hash"] for r in top.collect()], np.int64).view(np.uint64))


def prefix_postings(docs: DataFrame, frequent: np.ndarray, buckets: int, text_col: str) -> DataFrame:
    """(bucket, keys, nodes, sizes): the prefix shingles of each slice's distinct sets, by hash bucket."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def task():
        def each(s, rest):
            late_ones = shared.value
            h, o = K.shingle_sets(K.words(s.data, s.offsets), s.hi - s.lo, WORDS)
            n = np.diff(o)
            node = set_keys(h, o)
            _, once = np.unique(node, return_index=True)
            use = np.zeros(len(n), bool)
            use[once] = True
            use &= n > 0
            owner = np.repeat(np.arange(len(n)), n)
            keep = use[owner]
            h, owner = h[keep], owner[keep]
            if not len(h):
                return None
            late = np.zeros(len(h), bool)
            if len(late_ones):
                at = np.minimum(np.searchsorted(late_ones, h), len(late_ones) - 1)
                late = late_ones[at] == h
            order = np.argsort(owner * 2 + late, kind="stable")  # within a row, hashes are sorted already
            h, owner = h[order], owner[order]
            start = np.searchsorted(owner, np.arange(len(n)))
            place = np.arange(len(h)) - start[owner]
            first = n - -(-PERCENT * n // 100) + 1
            keep = place < first[owner]
            h, owner = h[keep], owner[keep]
            bucket = ((h >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            bucket, h, owner = bucket[order], h[order], owner[order]
            cut = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]])
            return {
                "bucket": bucket[cut[:-1]],
                "keys": K.packed(h.astype(np.uint32), cut),
                "nodes": K.packed(node[owner], cut),
                "sizes": K.packed(n[owner].astype(np.int32), cut),
            }

        return each, None

    return map_text(docs.select(F.col(text_col).alias("text")), "bucket int, keys binary, nodes binary, sizes binary", task, limit=2 * K.LEAN_BYTES)


def _lists(batches):
    """Candidate pairs, stars of very long lists and members of long ones, of the buckets of a partition."""
    held: dict[int, list] = {}
    for batch in batches:
        for b, *raw in zip(*(batch.column(i).to_pylist() for i in range(4))):
            held.setdefault(b, []).append(raw)
    for parts in held.values():
        key = np.frombuffer(b"".join(p[0] for p in parts), np.uint32)
        node = np.frombuffer(b"".join(p[1] for p in parts), np.int64)
        size = np.frombuffer(b"".join(p[2] for p in parts), np.int32)
        order = np.lexsort((node, key))
        key, node, size = key[order], node[order], size[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
        key, node, size = key[new], node[new], size[new].astype(np.int64)
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        count = np.diff(np.append(start, len(key)))
        found_a, found_b = [], []
        pairable = (count > 1) & (count <= PAIR_LIST)
        for m in np.unique(count[pairable]):  # all lists of one length at once
            at = start[count == m][:, None] + np.arange(m)
            i, j = np.triu_indices(m, 1)
            a, b = at[:, i].ravel(), at[:, j].ravel()
            fits = np.minimum(size[a], size[b]) * 100 >= PERCENT * np.maximum(size[a], size[b])
            found_a.append(node[a[fits]])
            found_b.append(node[b[fits]])
        rest: dict[int, tuple[list, list]] = {STAR: ([], []), MEMBER: ([], [])}
        for s, m in zip(start[count > PAIR_LIST], count[count > PAIR_LIST]):
            # nodes whose sizes differ too much cannot link: a list for each run of sizes
            by_size = s + np.argsort(size[s : s + m], kind="stable")
            gap = np.flatnonzero(size[by_size][1:] * PERCENT > size[by_size][:-1] * 100) + 1
            for part in np.split(by_size, gap):
                here = np.sort(node[part])
                if len(part) > BLOCK:
                    rest[STAR][0].append(np.full(len(part) - 1, here[0]))
                    rest[STAR][1].append(here[1:])
                elif len(part) > 1:  # the list's name: equal lists are compared once
                    rest[MEMBER][0].append(np.full(len(part), K.mix(K.mix(here.view(np.uint64)).sum(keepdims=True)).view(np.int64)[0]))
                    rest[MEMBER][1].append(here)
        for kind, (xs, ys) in {PAIR: (found_a, found_b), **rest}.items():
            if xs:
                pairs = np.unique(np.column_stack([np.concatenate(xs), np.concatenate(ys)]), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.array(np.full(len(pairs), kind, np.int32))], names=["a", "b", "kind"])


def _near_lists(batches):
    """Joins the nodes of each list, sorted by list and size, that may link."""

    def joined(nodes, sizes, maps):
        forest, out = Forest(len(nodes)), []
        width = [len(m) for m in maps]
        for w in sorted(set(width)):  # a size class against itself and the next
            use = [i for i in range(len(nodes)) if w <= width[i] <= 2 * w]
            x = np.stack([m if len(m) == w else m[:w] ^ m[w:] for m in (maps[i] for i in use)])
            n = np.array([sizes[i] for i in use])
            for i in range(len(use) - 1):
                distance = np.bitwise_count(x[i] ^ x[i + 1 :]).sum(1)
                total = n[i] + n[i + 1 :]
                for j in (np.flatnonzero(distance <= total - 2 * needed(n[i], n[i + 1 :])) + i + 1).tolist():
                    if forest.union(use[i], use[j]):
                        out.append((nodes[use[i]], nodes[use[j]]))
        return pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

    name, nodes, sizes, maps = None, [], [], []
    for batch in batches:
        for g, b, n, raw in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if g != name and nodes:
                yield joined(nodes, sizes, maps)
                nodes, sizes, maps = [], [], []
            name = g
            nodes.append(b)
            sizes.append(n)
            maps.append(np.frombuffer(raw, np.uint64))
    if nodes:
        yield joined(nodes, sizes, maps)


def _near(batches):
    """Pairs whose bitmaps allow a link."""
    for batch in batches:
        a, b, na, nb, xa, xb = (batch.column(i).to_pylist() for i in range(6))
        keep = []
        for i in range(len(a)):
            allowed = na[i] + nb[i] - 2 * needed(na[i], nb[i])
            if bitmap_distance(xa[i], xb[i]) <= allowed:
                keep.append(i)
        yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in keep], pa.int64()), pa.array([b[i] for i in keep], pa.int64())], names=["a", "b"])


def divide_skip(sets: list[np.ndarray], queries: range | list[int]) -> list[tuple[int, int]]:
    """Links that join the trees of ``sets``: T-occurrence search of each query among all sets.

    A query looks at sets that are not larger (ties by number), so that every pair is
    looked at once; with outside queries, at all others.
    """
    size = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), size)
    order = np.lexsort((owner, flat))
    flat, owner = flat[order], owner[order]
    start = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
    keys, length = flat[start], np.diff(np.append(start, len(flat)))
    forest, links = Forest(len(sets)), []
    for q in queries:
        mine = np.searchsorted(keys, sets[q])
        lists = mine[length[mine] > 1]
        least = -(-PERCENT * int(size[q]) // 100)  # the overlap any partner needs
        if len(lists) < least:
            continue
        longest = int(length[lists].max())
        aside = min(len(lists) - 1, int(least / (MU * math.log2(longest + 1) * longest + 1))) if longest > 8 else 0
        by_length = lists[np.argsort(length[lists], kind="stable")]
        short, long = by_length[: len(by_length) - aside], by_length[len(by_length) - aside :]
        reps = length[short]
        at = np.repeat(start[short] - (np.cumsum(reps) - reps), reps) + np.arange(reps.sum())
        seen = np.bincount(owner[at], minlength=len(sets))
        seen[q] = 0
        reached = np.flatnonzero((seen >= needed(size[q], size) - aside) & (seen > 0) & (np.minimum(size, size[q]) * 100 >= PERCENT * np.maximum(size, size[q])))
        probe = keys[long]
        for c in reached.tolist():
            if forest.find(c) == forest.find(q):
                continue
            overlap = int(seen[c])
            if aside:
                place = np.minimum(np.searchsorted(sets[c], probe), len(sets[c]) - 1)
                overlap += int((sets[c][place] == probe).sum())
            if 100 * overlap >= PERCENT * (int(size[q]) + int(size[c]) - overlap):
                forest.union(q, c)
                links.append((q, c))
    return links


def _search(batches):
    """Links within the groups of a partition; rows (group, node, query, shingles) come sorted by group."""
    group, nodes, sets, asks = None, [], [], []

    def links():
        distinct = {}
        for i, n in enumerate(nodes):  # a node may come as a query and as a member
            distinct.setdefault(n, i)
        use = sorted(distinct.values(), key=lambda i: (len(sets[i]), nodes[i]))
        names = [nodes[i] for i in use]
        ask = {nodes[i] for i in range(len(nodes)) if asks[i]}
        some = [j for j, n in enumerate(names) if n in ask] if ask else range(len(names))
        found = divide_skip([sets[i] for i in use], some) if len(use) > 1 else []
        return [names[i] for i, _ in found], [names[j] for _, j in found]

    for batch in batches:
        for g, n, q, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
            if g != group and nodes:
                a, b = links()
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
                nodes, sets, asks = [], [], []
            group = g
            nodes.append(n)
            asks.append(q)
            sets.append(np.frombuffer(raw.as_buffer(), np.uint64))
    if nodes:
        a, b = links()
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def search(groups: DataFrame) -> DataFrame:
    """Links of rows (part string, node, query, shingles), each part searched in one task."""
    width = 4 * shuffle_width(groups.sparkSession)
    return groups.select("part", "node", "query", "shingles").repartition(width, "part").sortWithinPartitions("part").mapInArrow(_search, "a long, b long")


def link_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id.

    Null, empty and blank texts have no shingles and are alone.  A null id takes part in
    links but gives no component id; a component of null ids only has none.  Repeated rows
    are one node.  An empty table gives an empty table; other columns are ignored.
    """
    sets, class_of = link_classes(docs, id_col, text_col)
    lowest = class_of.filter("label is not null").groupBy("class").agg(F.min("low").alias("component_id"))
    node_class = class_of.join(lowest, "class", "left").select("node", F.coalesce("component_id", "low").alias("component_id"))
    return (
        sets.select("doc_id", F.col("n").alias("n_shingles"), "node")
        .join(node_class, "node", "left")
        .select("doc_id", "n_shingles", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
    )


def link_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows of ``all_sets``, (node, low, key, label, class) of every distinct set); label is null where nothing links."""
    spark = docs.sparkSession
    workers_find_package(spark)
    sets = materialise(all_sets(docs, id_col, text_col), "jaccard-sets")
    rows = sets.count()
    nodes = materialise(
        sets.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("low"), F.min("key").alias("key"), F.max("n").alias("n"), F.max("bitmap").alias("bitmap")),
        "jaccard-nodes",
    )
    buckets = 4 * shuffle_width(spark)
    postings = prefix_postings(docs, frequent_shingles(docs, rows, id_col, text_col), buckets, text_col)
    found = materialise(postings.repartition(buckets, "bucket").mapInArrow(_lists, "a long, b long, kind int").distinct(), "jaccard-pairs")
    side = lambda x: nodes.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("bitmap").alias(f"x{x}"))
    pairs = found.filter(F.col("kind") == PAIR).join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "xa", "xb")
    lists = found.filter(F.col("kind") == MEMBER).join(side("b"), "b").select("a", "b", "nb", "xb")
    lists = lists.repartition(buckets, "a").sortWithinPartitions("a", "nb", "b").mapInArrow(_near_lists, "a long, b long")
    near = pairs.mapInArrow(_near, "a long, b long").union(lists).union(found.filter(F.col("kind") == STAR).select("a", "b"))
    clusters = connected_components(near).withColumnRenamed("label", "cluster")
    sizes = clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
    members = materialise(clusters.join(sizes, "cluster").join(nodes.select("node", "key", "low"), "node"), "jaccard-members")

    def shingles():
        def each(s, rest):
            h, o = K.shingle_sets(K.words(s.data, s.offsets), s.hi - s.lo, WORDS)
            mine = set_keys(h, o).view(np.int64)
            node = rest[0].to_numpy(zero_copy_only=False)
            same = np.flatnonzero(mine == node)  # a repeated id may stand on another text
            packed = K.packed(h, o).take(pa.array(same))
            return {"node": node[same], "cluster": rest[1].take(pa.array(same)), "size": rest[2].take(pa.array(same)), "shingles": packed}

        return each, None

    texts = keyed(docs, id_col, text_col).select("text", "key").join(
        members.select("key", "node", "cluster", "size").hint("merge"), "key"  # members grow with the corpus: never broadcast
    )
    full = materialise(map_text(texts.select("text", "node", "cluster", "size"), "node long, cluster long, size long, shingles binary", shingles, limit=K.LEAN_BYTES), "jaccard-full")
    part = lambda salt: F.concat_ws(
        ":", F.col("cluster"), F.when(F.col("size") > BLOCK, F.pmod(F.xxhash64("node", F.lit(salt)), F.ceil(F.col("size") / BLOCK))).otherwise(F.lit(0))
    )
    links = search(full.withColumn("part", part(0)).withColumn("query", F.lit(False)))
    large = full.filter(F.col("size") > BLOCK)
    if large.limit(1).count():
        again = search(large.withColumn("part", part(1)).withColumn("query", F.lit(False)))
        links = materialise(links.union(again), "jaccard-links")
        links = materialise(links.union(outside_links(large, links)), "jaccard-links")
    classes = connected_components(links)
    class_of = nodes.select("node", "low", "key").join(classes, "node", "left").withColumn("class", F.coalesce("label", "node"))
    return sets, class_of


def outside_links(large: DataFrame, links: DataFrame) -> DataFrame:
    """Links of the nodes of large clusters that are not in their cluster's largest component so far, to all others."""
    labels = connected_components(links)
    placed = large.select("cluster", "size", "node").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    counts = placed.groupBy("cluster", "label").agg(F.count(F.lit(1)).alias("n"))
    main = counts.groupBy("cluster").agg(F.max_by("label", F.struct("n", "label")).alias("main"))
    outside = placed.join(main, "cluster").filter("label <> main").select("cluster", "node")
    asking = large.join(outside, ["cluster", "node"])
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    block = F.pmod(F.xxhash64("node", F.lit(2)), F.ceil(F.col("size") / BLOCK))
    chunk = F.pmod(F.xxhash64("node", F.lit(3)), F.col("chunks"))
    chunks = outside.groupBy("cluster").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("chunks"))
    ask = (
        asking.join(chunks, "cluster")
        .withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .select(F.concat_ws(":", "cluster", "block", chunk).alias("part"), "node", F.lit(True).alias("query"), "shingles")
    )
    member = (
        large.join(chunks, "cluster")
        .withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks").cast("int") - 1)))
        .select(F.concat_ws(":", "cluster", block, "chunk").alias("part"), "node", F.lit(False).alias("query"), "shingles")
    )
    return search(ask.union(member))


def with_node(docs: DataFrame, text_col: str) -> DataFrame:
    """Adds ``_node``, the number of the row's set of shingles; null where it has none."""
    at = docs.columns.index(text_col)
    out = docs.select("*", F.lit(None).cast("long").alias("_node"))

    def run(batches):
        for batch in batches:
            for s in K.text_slices(batch.column(at), K.LEAN_BYTES):
                h, o = K.shingle_sets(K.words(s.data, s.offsets), s.hi - s.lo, WORDS)
                number = pa.array(set_keys(h, o).view(np.int64), pa.int64(), mask=np.diff(o) == 0)
                yield pa.RecordBatch.from_arrays([*batch.slice(s.lo, s.hi - s.lo).columns[:-1], number], names=batch.schema.names)

    return out.mapInArrow(run, out.schema)


def keep_one_of_each(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs``, all columns: one of each group of linked documents.

    The row with the smallest id stays; a group of null ids only keeps one row as well.  Rows
    alike in id and shingles count as one, any of them stays.  Rows without shingles (null,
    empty and blank texts) link with nothing and all stay.  An empty table gives an empty table.
    """
    sets, class_of = link_classes(docs, id_col, text_col)
    sets = sets.select("doc_id", "key", "node")
    # the first row of each component, by id with nulls last; the rest of its rows go
    first = (
        sets.join(class_of.select("node", "class").hint("merge"), "node")
        .groupBy("class")
        .agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key", "node")).alias("first"))
        .select("first.key", "first.node")
    )
    rows_of = sets.groupBy("key").agg(F.count(F.lit(1)).alias("rows"), F.max(F.col("node").isNull()).alias("bare"))
    state = materialise(rows_of.join(first.hint("merge"), "key", "left").select("key", "rows", "bare", "node"), "jaccard-kept")
    key = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("~"), F.md5(F.col(text_col))), F.lit("~"))
    named = docs.withColumn("_key", key)
    # most documents are kept: never broadcast their keys
    single = named.join(state.filter("rows = 1 and (bare or node is not null)").select(F.col("key").alias("_key")).hint("merge"), "_key", "left_semi")
    several = state.filter("rows > 1")
    if several.limit(1).count():  # an id on several rows: the text tells which of them stays
        again = with_node(named.join(several.select(F.col("key").alias("_key")).distinct(), "_key", "left_semi").select(*docs.columns, "_key"), text_col)
        stays = several.filter("node is not null").select(F.col("key").alias("_key"), F.col("node").alias("_node"))
        one = again.join(stays, ["_key", "_node"], "left_semi").dropDuplicates(["_key", "_node"])
        single = single.select(*docs.columns).unionByName(one.select(*docs.columns)).unionByName(again.filter("_node is null").select(*docs.columns))
    return single.select(*docs.columns)
