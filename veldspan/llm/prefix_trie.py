"""Prefix trie of conversations by Patricia construction.

A conversation is a sequence of turns; each distinct sequence of first d turns is a node at depth d.

Sort.  Turns are digests of 128 bits.  A conversation is cut into segments of SEGMENT turns, so that
no conversation is one row however long it is; a segment starts at the node the turns before it lead
to (its anchor, a 128-bit digest).  Equal segments are counted first; distinct ones are range-sorted by
anchor and turns, so that no anchor or turn, however many start with it, fills a task.

Build.  A task reads its range in order and keeps a stack of one path: a point is created only where
two neighbours part (branch), where a segment ends, and at the leaves; the turns between two points
are an edge.  Each range is given the last segment of the range before and the first of the one
after: nodes on the way to those are shared by ranges and stand alone, their figures are added up.

Aggregate and expand.  Points carry members, smallest member, children, leaves and saved tokens of
what is below them.  What lies below a segment's end comes from the sums that its conversations have
there.  Nodes inside an edge have the figures of the point below and the suffix sums of the edge.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import arrow_schema, materialise, running_before, running_sums, workers_find_package

SEGMENT = 128
HEADS, FAMILY = 6, 100
WIDE = 16  # bytes of a turn's digest
ROOT = "00" * WIDE
CHUNK = 1 << 20  # bytes of ids that travel in one row

POINTS = (
    "id binary, parent binary, depth long, conv_id long, n_convs long, n_children long, n_leaves long, "
    "saved long, ended boolean, shared boolean, suffix array<long>"
)


def md5_bytes(value: Column) -> Column:
    return F.unhex(F.md5(value))


def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, digest, chars) of every row that has a conv_id; a null role or text is empty."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = md5_bytes(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))
    return conversations.filter("conv_id is not null").select("conv_id", "turn", digest.alias("digest"), F.length(text).cast("long").alias("chars"))


def rebuilt(turns: DataFrame, heads: int = HEADS, family: int = FAMILY) -> DataFrame:
    """(conv_id, at, digest, chars): every conversation rebuilt on its family's first turns, and one row without ``at`` for each.

    Conversation c takes the first h = crc32(c) % heads turns of conversation c - c % family, then its own
    after its first h.  Turns come by turn (nulls first), those alike in turn by their digest.
    """
    rows = materialise(turns, "trie-turns")
    placed = materialise(running_before(rows, ["conv_id"], ["turn", "digest"], F.lit(1), "at", rows.count()).drop("turn"), "trie-placed")
    first = placed.filter(F.col("at") < heads - 1).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("at", "digest", "chars"))).alias("head"))
    h = (F.crc32(F.encode(F.col("conv_id").cast("string"), "UTF-8")) % heads).cast("int")
    convs = placed.select("conv_id").distinct().select("conv_id", (F.col("conv_id") - F.col("conv_id") % family).alias("base"), h.alias("h"))
    convs = convs.join(first.select(F.col("conv_id").alias("base"), "head"), "base", "left").withColumn("head", F.slice(F.coalesce("head", F.array()), F.lit(1), F.col("h")))
    convs = materialise(convs.drop("base"), "trie-heads")
    own = placed.join(convs.select("conv_id", "h", F.size("head").alias("_k")).hint("merge"), "conv_id").filter("at >= h")
    return (
        own.select("conv_id", (F.col("at") - F.col("h") + F.col("_k")).alias("at"), "digest", "chars")
        .unionByName(convs.select("conv_id", F.inline("head")))
        .unionByName(convs.select("conv_id", F.lit(None).cast("long").alias("at"), F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("long").alias("chars")))
    )


def segments_of(sequences: DataFrame, size: int) -> DataFrame:
    """(conv_id, seg, key, chars, total, more, anchor, beyond, chars_before): the segments of each conversation.

    ``key`` is the turns' digests in a row, ``chars`` their code points; ``more`` tells whether a segment follows;
    ``beyond`` is the id of the node a full segment ends at, which is the next one's anchor.
    """
    turn = F.when(F.col("at").isNotNull(), F.struct("at", "digest", "chars"))
    seg = F.coalesce(F.expr(f"at div {size}"), F.lit(0))
    # dealt by conversation and segment, as the rows of one conversation may be a third of all
    cut = sequences.withColumn("seg", seg).repartition("conv_id", "seg").groupBy("conv_id", "seg").agg(F.sort_array(F.collect_list(turn)).alias("items"))
    cut = materialise(
        cut.select(
            "conv_id",
            "seg",
            F.expr("aggregate(items, cast('' AS binary), (a, x) -> concat(a, x.digest))").alias("key"),
            F.expr("transform(items, x -> x.chars)").alias("chars"),
            F.expr("aggregate(items, 0L, (a, x) -> a + x.chars)").alias("total"),
        ),
        "trie-cut",
    )
    later = cut.filter("seg > 0").select("conv_id", (F.col("seg") - 1).alias("seg"), F.lit(True).alias("more"))
    cut = cut.join(later, ["conv_id", "seg"], "left").withColumn("more", F.coalesce("more", F.lit(False)))
    full = F.length("key") == size * WIDE
    alone = cut.filter(~full & (F.col("seg") == 0)).withColumns({"anchor": F.unhex(F.lit(ROOT)), "beyond": F.lit(None).cast("binary"), "chars_before": F.lit(0).cast("long")})
    chained = cut.filter(full | (F.col("seg") > 0))
    number = chained.count()
    if not number:
        return materialise(alone, "trie-segments")
    # an anchor is named by four sums of 32 bits over the segments before it, each salted with its place
    own = chained.withColumn("_md5", F.md5(F.concat(F.col("key"), F.encode(F.col("seg").cast("string"), "UTF-8"))))
    lanes = {f"_lane{i}": F.conv(F.substring("_md5", 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)}
    sums = running_sums(own.withColumns({f"_own{i}": lane for i, lane in enumerate(lanes.values())}), ["conv_id"], ["seg"], {**{k: F.col(f"_own{i}") for i, k in enumerate(lanes)}, "chars_before": F.col("total")}, number)
    after = [F.col(f"_lane{i}") + F.col(f"_own{i}") for i in range(4)]
    name = lambda sums, at: md5_bytes(F.concat_ws(",", *[F.pmod(s, F.lit(1 << 32)) for s in sums], at))
    chained = sums.select(
        *cut.columns,
        F.when(F.col("seg") == 0, F.unhex(F.lit(ROOT))).otherwise(name([F.col(k) for k in lanes], F.col("seg"))).alias("anchor"),
        F.when(full, name(after, F.col("seg") + 1)).alias("beyond"),
        "chars_before",
    )
    return materialise(alone.unionByName(chained), "trie-segments")


def end_node(key: str = "key") -> Column:
    """The id of the node a segment ends at: its anchor, the node beyond a full one, or the digest of the way."""
    return F.when(F.length(key) == 0, F.col("anchor")).otherwise(F.coalesce("beyond", md5_bytes(F.concat(F.col("anchor"), F.col(key)))))


def common_turns(a: bytes, b: bytes) -> int:
    most = min(len(a), len(b))
    at = 0
    while at < most and a[at : at + WIDE] == b[at : at + WIDE]:
        at += WIDE
    return at // WIDE


class Point:
    """A point on the path that the stack holds, with what it has gathered from below."""

    __slots__ = ("depth", "n", "conv", "children", "leaves", "saved", "ended", "more", "beyond")

    def __init__(self, depth: int):
        self.depth, self.n, self.conv, self.children, self.leaves, self.saved = depth, 0, None, 0, 0, 0
        self.ended, self.more, self.beyond = False, False, None

    def gather(self, n, conv, leaves, saved):
        self.n += n
        self.conv = conv if self.conv is None else min(self.conv, conv)
        self.leaves += leaves
        self.saved += saved


class Builder:
    """Points of one range of distinct segments that come sorted by anchor and turns."""

    def __init__(self, size: int):
        self.size, self.rows = size, []
        self.anchor = self.key = None

    def begin(self, before):
        """``before``: (anchor, key) of the range before, or None."""
        self.before, self.anchor, self.key = before, None, None

    def node(self, depth: int, beyond) -> bytes:
        if depth == 0:
            return self.anchor
        return beyond if depth == self.size else hashlib.md5(self.anchor + self.key[: depth * WIDE]).digest()

    def add(self, anchor, base, key, chars, n, conv, n_end, n_more, beyond, below_leaves, below_saved):
        if anchor != self.anchor:
            self.finish(None)
            met = common_turns(self.before[1], key) if self.before and self.before[0] == anchor else -1
            self.stack = [Point(0)]
        else:
            common = common_turns(self.key, key)
            self.unwind(common, self.met)
            met = min(self.met, common)
        self.anchor, self.base, self.key, self.chars, self.met = anchor, base, key, chars, met
        depth = len(key) // WIDE
        if depth > self.stack[-1].depth:
            self.stack.append(Point(depth))
        top = self.stack[-1]
        top.ended, top.more, top.beyond = n_end > 0, n_more > 0, beyond
        top.gather(n, conv, below_leaves, below_saved)

    def unwind(self, to: int, shared: int) -> None:
        """Closes what lies deeper than ``to`` on the path; nodes at ``shared`` and above are also in other ranges."""
        while self.stack[-1].depth > to:
            point = self.stack.pop()
            if self.stack[-1].depth < to:
                self.stack.append(Point(to))
            self.close(point, self.stack[-1], shared)

    def finish(self, after) -> None:
        """The last path of an anchor; ``after``: (anchor, key) of the range after, or None."""
        if self.anchor is None:
            return
        next_met = common_turns(self.key, after[1]) if after and after[0] == self.anchor else -1
        shared = max(self.met, next_met)
        if next_met == self.stack[-1].depth:  # what follows goes on from here: no leaf
            self.stack[-1].more = True
        self.unwind(0, shared)
        root = self.stack.pop()
        if self.base:  # the anchor's figures are those of the segment that leads to it
            self.rows.append((self.anchor, None, self.base, None, 0, root.children, 0, 0, False, True, [0]))
        else:
            self.emit(root, 0, 0, None, shared, root.saved)
        self.anchor = None

    def close(self, point: Point, parent: Point, shared: int) -> None:
        top = parent.depth + 1
        saved = self.emit(point, top, point.depth, None, shared, point.saved)
        parent.gather(point.n, point.conv, point.leaves, saved)
        parent.children += top > self.met  # else the range before has counted it

    def emit(self, point: Point, top: int, bottom: int, _, shared: int, saved: int) -> int:
        """Rows of the edge from ``top`` to ``bottom``; gives the saved tokens at its top."""
        if not point.children and not point.more and point.ended:
            point.leaves += 1
        n, children, ended = point.n, point.children, point.ended
        depth = bottom
        first = point.more and bottom == self.size  # stands alone, as its children are elsewhere
        while depth >= top:
            # each node adds its turn for every member but the first, who is counted where the node comes first
            cost = lambda d: (n - (d > self.met)) * self.chars[d - 1] if d else 0  # noqa: B023, E731
            alone = depth <= shared or first
            lowest = depth if alone else max(top, shared + 1)
            saved += cost(depth)
            suffix = [0]
            for d in range(depth - 1, lowest - 1, -1):
                suffix.append(suffix[-1] + cost(d))
            parent = self.node(lowest - 1, None) if lowest else None
            self.rows.append(
                (self.node(depth, point.beyond), parent, self.base + depth, point.conv, n, children, point.leaves, saved, ended, alone, suffix[::-1])
            )
            saved += suffix[-1]
            children, ended, first = int(lowest > self.met), False, False
            depth = lowest - 1
        return saved


def _build(size: int):
    schema = arrow_schema(POINTS)

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)

    def run(batches):
        builder, now, after = Builder(size), None, None
        for b in batches:
            columns = [b.column(i).to_pylist() for i in range(b.num_columns)]
            for place, kind, anchor, key, *rest in zip(*columns):
                if place != now:
                    builder.finish(after)
                    now, after = place, None
                    builder.begin(None)
                if kind < 0:
                    builder.begin((anchor, key))
                elif kind > 0:
                    after = (anchor, key)
                else:
                    builder.add(anchor, rest[0], key, *rest[1:])
                if len(builder.rows) >= 8192:
                    yield batch(builder.rows)
                    builder.rows = []
        builder.finish(after)
        if builder.rows:
            yield batch(builder.rows)

    return run


def points_of(distinct: DataFrame, size: int) -> DataFrame:
    """The points of the compressed tree over distinct segments, one row each."""
    ranged = materialise(distinct.repartitionByRange("anchor", "key").withColumn("_range", F.spark_partition_id()), "trie-ranges")
    ends = ranged.groupBy("_range").agg(F.min(F.struct("anchor", "key")).alias("first"), F.max(F.struct("anchor", "key")).alias("last"))
    order = Window.orderBy("_range")  # one row a range
    ends = ends.select("_range", F.lag("last").over(order).alias("before"), F.lead("first").over(order).alias("after"))
    columns = ["base", "chars", "n", "conv_id", "n_end", "n_more", "beyond", "below_leaves", "below_saved"]
    empty = [F.lit(None).cast(ranged.schema[c].dataType).alias(c) for c in columns]
    marks = [
        ends.filter(F.col(side).isNotNull()).select("_range", F.lit(kind).alias("kind"), f"{side}.anchor", f"{side}.key", *empty) for side, kind in (("before", -1), ("after", 1))
    ]
    rows = ranged.select("_range", F.lit(0).alias("kind"), "anchor", "key", *columns)
    stream = rows.unionByName(marks[0]).unionByName(marks[1]).repartition("_range").sortWithinPartitions("_range", "kind", "anchor", "key")
    points = materialise(stream.mapInArrow(_build(size), POINTS), "trie-points")
    one = ["parent", "depth", "conv_id"]
    merged = points.filter("shared").groupBy("id").agg(
        F.min("parent").alias("parent"),
        F.max("depth").alias("depth"),
        F.min("conv_id").alias("conv_id"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved")],
        F.max("ended").alias("ended"),
        F.array(F.lit(0).cast("long")).alias("suffix"),
    )
    return points.filter("not shared").drop("shared").select("id", *one, "n_convs", "n_children", "n_leaves", "saved", "ended", "suffix").unionByName(merged)


def below_segments(segments: DataFrame, points: DataFrame, size: int) -> DataFrame:
    """(beyond, leaves, saved): what the tree has below each node that a segment ends at and another goes on from.

    A conversation is the smallest member of its nodes from some depth on.  At a node above, it adds the
    code points between there and that depth, all of them if it never is; a leaf is added by its smallest member.
    """
    many = segments.filter("more or seg > 0").select("conv_id", "seg", "anchor", "chars", "chars_before")
    owned = points.groupBy("conv_id").agg(F.min(F.col("depth") - F.size("suffix") + 1).alias("_from"), F.max(F.col("n_children") == 0).alias("_leaf"))
    met = many.join(owned.hint("merge"), "conv_id", "left")
    met = met.withColumn("_turns", F.when(F.col("_from").isNull(), F.lit(1 << 62)).otherwise(F.greatest(F.col("_from") - 1, F.lit(0))) - F.col("seg") * size)
    part = F.expr("aggregate(slice(chars, 1, cast(greatest(0L, least(_turns, cast(size(chars) AS bigint))) AS int)), 0L, (a, x) -> a + x)")
    upto = met.groupBy("conv_id").agg(F.sum(part).alias("_upto"), F.max(F.coalesce("_leaf", F.lit(False))).alias("_leaf"))
    later = many.filter("seg > 0").join(upto.hint("merge"), "conv_id")
    return later.groupBy(F.col("anchor").alias("beyond")).agg(
        F.sum(F.col("_leaf").cast("long")).alias("leaves"), F.sum(F.greatest(F.col("_upto") - F.col("chars_before"), F.lit(0))).alias("saved")
    )


def _join_ids(batches):
    """Sorted rows (id, conv_id) to texts of ids: (id, first, whole, text), ``whole`` if no other task can have the same id."""
    schema = pa.schema([("id", pa.binary()), ("first", pa.int64()), ("whole", pa.bool_()), ("text", pa.binary())])
    name, first, parts, length, pieces, opening, out = None, None, [], 0, 0, True, []

    def row(whole):
        return name, first, whole, ",".join(map(str, parts)).encode()

    def batch():
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(schema)], schema=schema)

    for b in batches:
        for at, conv in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if at != name or length >= CHUNK:
                if name is not None:
                    out.append(row(at != name and not opening and not pieces))
                    opening = opening and at == name
                pieces = pieces + 1 if at == name else 0
                name, first, parts, length = at, conv, [], 0
            parts.append(conv)
            length += 12
        if len(out) >= 4096:
            yield batch()
            out.clear()
    if name is not None:
        out.append(row(False))
        yield batch()


def _hash_texts(batches):
    """The SHA-256 of each id's texts, which come sorted, with commas between."""
    name, digest, ids, hashes = None, None, [], []
    for b in batches:
        for at, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if at != name:
                if name is not None:
                    ids.append(name)
                    hashes.append(digest.hexdigest())
                name, digest = at, hashlib.sha256(text)
            else:
                digest.update(b"," + text)
    if name is not None:
        ids.append(name)
        hashes.append(digest.hexdigest())
    if ids:
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), pa.array(hashes)], names=["id", "ends_sha256"])


def end_digests(ends: DataFrame) -> DataFrame:
    """(id, ends_sha256): the SHA-256 of the ascending ids that end at a node, joined by commas.

    Ids are sorted in ranges that a hot node cannot fill and joined to texts there; what a range has of the nodes
    at its borders, in pieces of a megabyte, is hashed in order (a SHA-256 has no parallel form).
    """
    texts = materialise(ends.select("id", "conv_id").repartitionByRange("id", "conv_id").sortWithinPartitions("id", "conv_id").mapInArrow(_join_ids, "id binary, first long, whole boolean, text binary"), "trie-ends")
    cut = texts.filter("not whole").select("id", "first", "text").repartition("id").sortWithinPartitions("id", "first").select("id", "text")
    return texts.filter("whole").select("id", F.sha2("text", 256).alias("ends_sha256")).unionByName(cut.mapInArrow(_hash_texts, "id binary, ends_sha256 string"))


def prefix_trie(sequences: DataFrame, size: int = SEGMENT) -> DataFrame:
    """One row per node of the trie of ``sequences`` (conv_id, at, digest, chars; a row without ``at`` for each conversation).

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    """
    workers_find_package(sequences.sparkSession)
    segments = segments_of(sequences, size)
    distinct = segments.groupBy("anchor", "seg", "key").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("conv_id").alias("conv_id"),
        F.count_if(~F.col("more")).alias("n_end"),
        F.count_if("more").alias("n_more"),
        F.max("beyond").alias("beyond"),
        F.max("chars").alias("chars"),
    )
    distinct = materialise(distinct.withColumn("base", F.col("seg") * size).drop("seg"), "trie-distinct")
    nothing = F.lit(0).cast("long")
    points = materialise(points_of(distinct.withColumns({"below_leaves": nothing, "below_saved": nothing}), size), "trie-tree")
    if distinct.filter("n_more > 0").limit(1).count():
        below = below_segments(segments, points, size).withColumnsRenamed({"leaves": "below_leaves", "saved": "below_saved"})
        again = distinct.join(below, "beyond", "left").withColumns({c: F.when(F.col("n_more") > 0, F.coalesce(c, nothing)).otherwise(nothing) for c in ("below_leaves", "below_saved")})
        points = materialise(points_of(again, size), "trie-tree")
    ends = end_digests(segments.filter("not more").select(end_node().alias("id"), "conv_id"))
    above = points.select(F.col("id").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    figured = points.join(above, "parent", "left").join(ends, "id", "left")
    nodes = figured.select("*", F.posexplode("suffix").alias("_i", "_rest"))
    last = F.col("_i") == F.size("suffix") - 1
    return nodes.select(
        "conv_id",
        (F.col("depth") - F.size("suffix") + 1 + F.col("_i")).alias("depth"),
        F.when(F.col("_i") == 0, F.col("parent_conv_id")).otherwise(F.col("conv_id")).alias("parent_conv_id"),
        "n_convs",
        F.when(last, F.col("n_children")).otherwise(F.lit(1)).cast("long").alias("n_children"),
        "n_leaves",
        (F.col("saved") + F.col("_rest")).alias("saved_tokens"),
        F.when(last & F.col("ended"), F.col("ends_sha256")).otherwise(F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations, one row per node.

    Rows without a conv_id belong to no conversation and are left out.  Turns come by turn, nulls
    first; those alike in turn, repeated rows too, by the MD5 of role and text.  A null role or text is
    empty and counts no code points.  A rebuilt conversation may have no turns: it ends at the root.  An
    empty table has no conversation and gives an empty table.  Other columns are ignored.
    """
    return prefix_trie(rebuilt(turns_of(conversations)))
