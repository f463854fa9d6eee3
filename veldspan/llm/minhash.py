"""Near-duplicate groups by SuperMinHash signatures, banding, exact verification and union-find.

A document is the set of its distinct four-word shingles (64-bit hashes); equal sets are one node.
Two nodes link when 100 |A and B| >= 80 |A or B|.

Signature.  Each element has a random permutation of the M components; in round j it offers the
value j + r to the j-th of them and a component keeps the least offer.  A set is done once all its
components are filled, as later rounds only offer more: sets of many elements stop after a round or two.

Banding.  ROWS components in a row make a band; nodes alike in a band are candidates.  At a similarity of
0.8, a pair of nodes shares none of the bands with a probability of 5e-8, less above.  A group of nodes
alike in a band is compared with its smallest node first; pairs whose signatures agree in fewer than LEAST of the
M components (more than five deviations below 0.8) are dropped, and the others are verified on their full sets.
What the links join needs no more comparing.  Groups that still hold several components are compared in one task
up to GROUP nodes, by signature, by a bitmap of the set and at last by full sets; larger ones are first split by
a second band, and where that leaves groups as large, dealt into pairs of chunks, so that no task holds a
large group.  No pair of one component is ever looked at, and only links that join components are written.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .components import Forest, connected_components
from .jaccard_join import bitmap_distance, keyed, parity_bitmaps
from .shared import map_text, materialise, workers_find_package

WORDS = 4
PERCENT = 80
M, ROWS = 128, 4
LEAST = 77
GROUP = 4096
STAR = 256  # sets that are compared with one copy of a star's centre
REPLAY = 4  # rounds without a table of permutations

_ROUND = K.mix(np.arange(1, 2 * M + 1, dtype=np.uint64))
EMPTY = np.uint64(2**64 - 1)


def needed(a, b):
    """Least overlap at which sets of sizes a and b link."""
    return -(-PERCENT * (a + b) // (100 + PERCENT))


def signatures(h: np.ndarray, o: np.ndarray) -> np.ndarray:
    """SuperMinHash signatures (rows x M, 64 bits) of sets given as hashes and row offsets; empty sets are all EMPTY."""
    n = len(o) - 1
    out = np.full(n * M, EMPTY)
    owner, x, past, table = np.repeat(np.arange(n), np.diff(o)), h, [], None
    for j in range(M):
        if not len(x):
            break
        value = (np.uint64(j) << np.uint64(56)) | (K.mix(x ^ _ROUND[j]) >> np.uint64(8))
        pick = (j + K.mix(x ^ _ROUND[M + j]) % np.uint64(M - j)).astype(np.uint8)
        if table is None:  # where the element's earlier swaps have put what stands at ``pick``
            slot = pick.copy()
            for t in range(j - 1, -1, -1):
                slot[slot == past[t]] = t
            past.append(pick)
        else:
            rows = np.arange(len(x))
            slot = table[rows, pick]
            table[rows, pick] = table[:, j]
        np.minimum.at(out, owner * M + slot, value)
        open_rows = (out.reshape(n, M) == EMPTY).any(1)
        keep = open_rows[owner]
        if not keep.all():
            owner, x = owner[keep], x[keep]
            past = [p[keep] for p in past]
            table = table[keep] if table is not None else None
        if j == REPLAY - 1:
            table, rows = np.tile(np.arange(M, dtype=np.uint8), (len(x), 1)), np.arange(len(x))
            for t, p in enumerate(past):
                moved = table[rows, p]
                table[rows, p] = table[:, t]
                table[:, t] = moved
            past = []
    return out.reshape(n, M)


def bands_of(sig: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of ROWS components."""
    key = np.zeros((len(sig), M // ROWS), np.uint64)
    for r in range(ROWS):
        key = K.mix(key ^ sig[:, r::ROWS])
    return K.mix(key ^ _ROUND[: M // ROWS])


def sketches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, key, n, digest, sketch, bitmap, bands) of every row; those of the set but n are null for empty sets."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def task():
        def each(s, rest):
            h, o = K.shingle_sets(K.words(s.data, s.offsets), s.hi - s.lo, WORDS)
            n, sig = np.diff(o), signatures(h, o)
            none = n == 0
            bands = pa.ListArray.from_arrays(np.arange(0, (len(n) + 1) * (M // ROWS), M // ROWS, dtype=np.int32), bands_of(sig).view(np.int64).ravel())
            maps = parity_bitmaps(h, o)
            low = sig.astype(np.uint8)  # equal components are equal in their last byte
            pick = pa.array(np.where(none, None, np.arange(len(n))), pa.int64())
            return {
                "doc_id": rest[0],
                "key": rest[1],
                "n": n,
                "digest": set_digests(h, o),
                "sketch": K.packed(low.ravel(), np.arange(len(n) + 1) * M).take(pick),
                "bitmap": maps.take(pick),
                "bands": bands.take(pick),
            }

        return each, None

    return map_text(keyed(docs, id_col, text_col), f"doc_id {id_type}, key string, n long, digest binary, sketch binary, bitmap binary, bands array<long>", task)


def set_digests(h: np.ndarray, o: np.ndarray) -> pa.Array:
    """The 128-bit digest of each set; null for empty ones."""
    raw = memoryview(h.view(np.uint8))
    return pa.array([hashlib.blake2b(raw[8 * a : 8 * b], digest_size=16).digest() if b > a else None for a, b in zip(o[:-1].tolist(), o[1:].tolist())], pa.binary())


def _alike(batches):
    """Pairs (a, b, size, x, y) whose sketches agree in at least LEAST bytes."""
    for batch in batches:
        x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, M) for i in (3, 4))
        ok = (x == y).sum(1) >= LEAST
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(ok)], names=["a", "b", "size", "ok"])


def may_link(label: np.ndarray, n: np.ndarray, x: np.ndarray, maps: list[bytes]):
    """(i, others): for each node of a part, the later ones of other components that it may link with.

    Sketches are compared first, then parity bitmaps: two sets that link cannot differ in more bits than in elements.
    """
    for i in range(len(n) - 1):
        rest = np.flatnonzero(label[i + 1 :] != label[i]) + i + 1
        rest = rest[(x[rest] == x[i]).sum(1) >= LEAST]
        if len(rest):
            different = n[rest] + n[i] - 2 * needed(n[rest], n[i])
            rest = rest[[bitmap_distance(maps[i], maps[j]) <= most for j, most in zip(rest.tolist(), different.tolist())]]
            if len(rest):
                yield i, rest


def _parts(batches, columns: int):
    """(part, columns) of each part; rows come sorted by part, each node once."""
    part, held = None, [[] for _ in range(columns)]
    for batch in batches:
        for p, *row in zip(batch.column(0).to_pylist(), *(batch.column(i).to_pylist() for i in range(1, columns + 1))):
            if p != part and held[0]:
                yield part, held
                held = [[] for _ in range(columns)]
            part = p
            for out, value in zip(held, row):
                out.append(value)
    if held[0]:
        yield part, held


def _may_link(batches):
    """The nodes of each part (part, node, label, n, sketch, bitmap) that may link with one of another component."""
    for part, (node, label, n, sketch, maps) in _parts(batches, 5):
        hit = np.zeros(len(node), bool)
        for i, rest in may_link(np.array(label), np.array(n), np.frombuffer(b"".join(sketch), np.uint8).reshape(-1, M), maps):
            hit[i] = True
            hit[rest] = True
        if hit.any():
            found = np.array(node)[hit]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), part), pa.int64()), pa.array(found, pa.int64())], names=["part", "node"])


def _link(batches):
    """Links that join components within each part (part, node, label, n, sketch, bitmap, shingles); none within a component."""
    for _, (node, label, n, sketch, maps, raw) in _parts(batches, 6):
        names, label = np.unique(label, return_inverse=True)
        forest, sets, a, b = Forest(len(names)), [np.frombuffer(r, np.uint64) for r in raw], [], []
        for i, rest in may_link(label, np.array(n), np.frombuffer(b"".join(sketch), np.uint8).reshape(-1, M), maps):
            for j in rest.tolist():
                if forest.find(int(label[i])) == forest.find(int(label[j])):
                    continue
                place = np.minimum(np.searchsorted(sets[i], sets[j]), n[i] - 1)
                both = int((sets[i][place] == sets[j]).sum())
                if 100 * both >= PERCENT * (n[i] + n[j] - both):
                    forest.union(int(label[i]), int(label[j]))
                    a.append(node[i])
                    b.append(node[j])
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _verify(batches):
    """Links of stars: rows (a, salt, b, shingles) come sorted, the centre's own (null b) first."""
    at, centre = None, None
    for batch in batches:
        a, b = [], []
        for x, salt, y, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
            mine = np.frombuffer(raw.as_buffer(), np.uint64)
            if y is None:
                at, centre = (x, salt), mine.copy()
            elif (x, salt) == at:
                place = np.minimum(np.searchsorted(centre, mine), len(centre) - 1)
                both = int((centre[place] == mine).sum())
                if 100 * both >= PERCENT * (len(centre) + len(mine) - both):
                    a.append(x)
                    b.append(y)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def verified(pairs: DataFrame, full: DataFrame, name: str) -> DataFrame:
    """The pairs (a, b) that link by their full sets (node, shingles).  A centre's set travels once for each STAR others."""
    counts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / STAR).alias("_chunks"))
    dealt = pairs.join(counts, "a").select("a", F.pmod(F.xxhash64("b"), F.col("_chunks")).alias("salt"), "b")
    others = dealt.join(full.select(F.col("node").alias("b"), "shingles").hint("merge"), "b").select("a", "salt", "b", "shingles")
    centres = counts.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_chunks") - 1)).alias("salt"))
    centres = centres.join(full.select(F.col("node").alias("a"), "shingles").hint("merge"), "a").select("a", "salt", F.lit(None).cast("long").alias("b"), "shingles")
    rows = others.unionByName(centres).repartition("a", "salt").sortWithinPartitions("a", "salt", F.asc_nulls_first("b"))
    return materialise(rows.mapInArrow(_verify, "a long, b long"), name)


def full_sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(node, shingles) of the nodes ``wanted`` (key, digest, node), shingled from their texts."""

    def task():
        def each(s, rest):
            h, o = K.shingle_sets(K.words(s.data, s.offsets), s.hi - s.lo, WORDS)
            own = set_digests(h, o).to_pylist()
            same = pa.array([i for i, (x, y) in enumerate(zip(own, rest[0].to_pylist())) if x == y], pa.int64())  # a repeated id may stand on another text
            return {"node": rest[1].take(same), "shingles": K.packed(h, o).take(same)}

        return each, None

    # nodes grow with the corpus: never broadcast
    texts = keyed(docs, id_col, text_col).select("text", "key").join(wanted.hint("merge"), "key").select("text", "digest", "node")
    return materialise(map_text(texts, "node long, shingles binary", task).dropDuplicates(["node"]), "minhash-sets")


def labelled(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """Adds the node's component; its own number where it links with nothing."""
    return nodes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))


def open_parts(members: DataFrame) -> DataFrame:
    """(part, size, main) of the parts of ``members`` (part, node, label) that hold several components, alike parts once."""
    name = [F.bit_xor(F.xxhash64("node", F.lit(i))).alias(f"_name{i}") for i in (0, 1)]
    counts = members.groupBy("part").agg(F.count(F.lit(1)).alias("size"), F.min("label").alias("main"), F.max("label").alias("_most"), *name)
    return counts.filter("main <> _most").groupBy("size", "_name0", "_name1").agg(F.min("part").alias("part"), F.any_value("main").alias("main")).select("part", "size", "main")


def open_links(met: DataFrame, labels: DataFrame, facts: DataFrame, full: DataFrame, group: int) -> DataFrame:
    """Links that join components in groups of more than two nodes that have several.

    A task gets the facts (node, n, sketch, bitmap) of a part of at most ``group`` nodes; only nodes that may link with another
    component are met again with their full sets, and only links that join components come out.
    """
    members = labelled(met.filter("size > 2").select(F.col("key").alias("part"), "node"), labels)
    members = materialise(members.join(open_parts(members).hint("merge"), "part"), "minhash-open")
    parts = [members.filter(F.col("size") <= group).select("part", "node", "label")]
    large = members.filter(F.col("size") > group)
    if large.limit(1).count():
        # two bands in common: the pairs of a node's large groups; only those that hold a node outside a group's main component count
        several = large.groupBy("node").agg(F.first("label").alias("label"), F.sort_array(F.collect_list("part")).alias("parts"), F.max(F.col("label") != F.col("main")).alias("outside"))
        twice = F.expr("flatten(transform(parts, (x, i) -> transform(slice(parts, i + 2, size(parts)), y -> xxhash64(x, y))))")
        split = several.select("node", "label", "outside", F.explode(twice).alias("part"))
        outside = split.filter("outside").select("part").distinct()
        split = materialise(split.join(outside, "part", "left_semi").select("part", "node", "label"), "minhash-split")
        again = split.join(open_parts(split).hint("merge"), "part")
        parts.append(again.filter(F.col("size") <= group).select("part", "node", "label"))
        chunks = F.ceil(2 * F.col("size") / group)
        mine = F.pmod(F.xxhash64("node"), chunks)
        dealt = again.filter(F.col("size") > group).withColumns({"_mine": mine, "_other": F.explode(F.sequence(F.lit(0).cast("long"), chunks - 1))})
        parts.append(dealt.select(F.xxhash64("part", F.least("_mine", "_other"), F.greatest("_mine", "_other")).alias("part"), "node", "label"))
    rows = parts[0]
    for more in parts[1:]:
        rows = rows.unionByName(more)
    columns = ["part", "node", "label", "n", "sketch", "bitmap"]
    rows = materialise(rows.join(facts.hint("merge"), "node").select(columns), "minhash-parts")
    near = rows.repartition("part").sortWithinPartitions("part", "node").mapInArrow(_may_link, "part long, node long")
    again = materialise(rows.join(near.hint("merge"), ["part", "node"]), "minhash-again")
    sets = again.join(full.hint("merge"), "node").select(*columns, "shingles")
    return materialise(sets.repartition("part").sortWithinPartitions("part", "node").mapInArrow(_link, "a long, b long"), "minhash-links")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", group: int = GROUP) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    Null, empty and blank texts have no shingles and are alone.  Texts of fewer than four words are one
    shingle.  A null id takes part in links but gives no component id; a component of null ids only has
    none and keeps all its rows, other rows of null ids are kept only where they link with nothing.  Repeated
    rows are one node and have equal results.  An empty table gives an empty table; other columns are ignored.
    """
    workers_find_package(docs.sparkSession)
    rows = materialise(sketches(docs, id_col, text_col), "minhash-rows")
    nodes = rows.filter("digest is not null").groupBy("digest").agg(
        F.min("doc_id").alias("low"), F.min("key").alias("key"), F.max("n").alias("n"), *[F.any_value(c).alias(c) for c in ("sketch", "bitmap", "bands")]
    )
    nodes = materialise(nodes.withColumn("node", F.monotonically_increasing_id()), "minhash-nodes")
    sketch = nodes.select("node", "sketch")
    band = nodes.select("node", F.explode("bands").alias("key"))
    groups = band.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("first")).filter("size > 1")
    met = materialise(band.join(groups.hint("merge"), "key"), "minhash-met")

    side = lambda x, y: sketch.select(F.col("node").alias(x), F.col("sketch").alias(y)).hint("merge")
    stars = met.filter("node <> first").groupBy(F.col("first").alias("a"), F.col("node").alias("b")).agg(F.max("size").alias("size"))
    stars = materialise(stars.join(side("b", "y"), "b").join(side("a", "x"), "a").select("a", "b", "size", "x", "y").mapInArrow(_alike, "a long, b long, size long, ok boolean"), "minhash-stars")
    some = stars.filter("ok or size > 2")
    wanted = some.select(F.col("a").alias("node")).union(some.select("b")).distinct()
    full = full_sets(docs, nodes.select("node", "key", "digest").join(wanted.hint("merge"), "node"), id_col, text_col)

    tried = stars.filter("ok").select("a", "b")
    links = verified(tried.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), full, "minhash-links")
    labels = connected_components(links)
    ends = lambda x: labels.select(F.col("node").alias(x), F.col("label").alias(f"_{x}"))
    apart = tried.join(ends("a"), "a", "left").join(ends("b"), "b", "left").filter("coalesce(_a, a) <> coalesce(_b, b)").select("a", "b")
    links = links.union(verified(materialise(apart, "minhash-apart"), full, "minhash-links"))
    labels = connected_components(links)
    more = open_links(met, labels, nodes.select("node", "n", "sketch", "bitmap"), full, group)
    if more.limit(1).count():
        labels = connected_components(links.union(more))

    classes = nodes.select("node", "digest", "low").join(labels, "node", "left")
    lowest = classes.filter("label is not null").groupBy("label").agg(F.min("low").alias("component_id"))
    of_node = classes.join(lowest, "label", "left").select("digest", F.when(F.col("label").isNull(), F.col("low")).otherwise(F.col("component_id")).alias("component_id"))
    out = rows.select("doc_id", F.col("n").alias("n_shingles"), "digest").join(of_node, "digest", "left")
    component = F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose id is their component's; null ids as ``near_duplicates`` says."""
    kept = near_duplicates(docs, id_col, text_col).filter("kept").select(F.col("doc_id").alias("_id")).distinct()
    return docs.join(kept.hint("merge"), docs[id_col].eqNullSafe(kept["_id"]), "left_semi")
