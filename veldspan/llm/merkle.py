"""Merkle manifest of a table: one digest for all rows, and for each row the proof that it is under it.

Every row is a leaf: the SHA-256 of its fields.  The leaves of a group (a language) are ordered by
id; RUN consecutive nodes become one, until one is left, the group's subroot.  Subroots, ordered by
group, likewise give the root.

Levels are collapsed in blocks of RUN**DEPTH consecutive nodes: one row holds a block as an ordered
array, and SQL's higher-order functions (sequence, slice, transform, aggregate) make its levels.
Block roots are the nodes of the next round, which works on them in the same way, so a tree of n
leaves takes log(n) / log(512) rounds, each over a 512th of the rows of the round before.  Proofs
come down the same blocks: a block's members get the siblings inside it and then those of the block.
Positions in a group come from ranges that a hot group cannot fill; no Python runs on the executors.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import group_key, materialise, running_before

RUN = 8
DEPTH = 3
BLOCK = RUN**DEPTH
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Tree(NamedTuple):
    """Blocks of each round (``_group, _block, height, members, levels``), leaves first, and ``(_group, root)``."""

    blocks: list[DataFrame]
    roots: DataFrame


def field(value: Column) -> Column:
    """``-`` for null, else the value's bytes in UTF-8, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(*values: Column) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def height_of(n: Column) -> Column:
    """How often RUN nodes become one until one of ``n`` is left: the octal digits of n - 1, 0 for one node."""
    return F.when(n < 2, F.lit(0)).otherwise(F.length(F.conv((n - 1).cast("string"), 10, RUN))).cast("int")


_LEVELS = f"""aggregate(
  CASE WHEN height > 0 THEN sequence(1, least({DEPTH}, height)) ELSE cast(array() AS array<int>) END,
  array(transform(members, m -> m.node)),
  (done, k) -> concat(done, array(transform(
    sequence(0, cast((size(element_at(done, -1)) - 1) div {RUN} AS int)),
    i -> sha2(array_join(slice(element_at(done, -1), i * {RUN} + 1, {RUN}), ''), 256)))))"""

# the nodes beside member i in its run at each level of its block, from the leaves up
_BESIDE = f"""CASE WHEN size(levels) > 1 THEN transform(sequence(1, size(levels) - 1), k -> named_struct(
  'left', array_join(slice(levels[k - 1], cast(i div cast(pow({RUN}, k) AS int) * {RUN} + 1 AS int), cast(i div cast(pow({RUN}, k - 1) AS int) % {RUN} AS int)), ''),
  'right', array_join(slice(levels[k - 1], cast(i div cast(pow({RUN}, k - 1) AS int) + 2 AS int), cast({RUN} - 1 - i div cast(pow({RUN}, k - 1) AS int) % {RUN} AS int)), '')))
  ELSE cast(array() AS array<struct<left: string, right: string>>) END"""


def grow(nodes: DataFrame, rounds: int, name: str) -> Tree:
    """The tree over ``(_group, _pos, node, height, ...)``; positions are gapless from 0 in each group."""
    blocks = []
    carried = [c for c in nodes.columns if c not in ("_group", "_pos", "node", "height")]
    for number in range(rounds):
        member = F.struct("_pos", "node", *(carried if number == 0 else ()))
        block = nodes.groupBy("_group", F.expr(f"_pos div {BLOCK}").alias("_block")).agg(
            F.sort_array(F.collect_list(member)).alias("members"), F.max("height").alias("height")
        )
        block = materialise(block.withColumn("levels", F.expr(_LEVELS)), f"{name}-{number}")
        blocks.append(block)
        nodes = block.select(
            "_group", F.col("_block").alias("_pos"), F.expr("element_at(levels, -1)[0]").alias("node"), F.greatest(F.col("height") - DEPTH, F.lit(0)).alias("height")
        )
    return Tree(blocks, nodes.select("_group", F.col("node").alias("root")))


def descend(tree: Tree, above: DataFrame, member: str, name: str) -> DataFrame:
    """One row for each leaf: the struct ``member`` makes of ``m`` (the leaf), ``path`` and what ``above`` carries.

    ``above`` has for each group (_group, path, ...): the siblings from the group's root up.
    """
    carried = [c for c in above.columns if c not in ("_group", "path")]
    above = above.withColumn("_block", F.lit(0).cast("long"))
    for number, block in reversed(list(enumerate(tree.blocks))):
        # blocks grow with the corpus and keys are even: never broadcast
        met = block.join(above.hint("merge"), ["_group", "_block"])
        path = f"concat({_BESIDE}, path)"
        if number == 0:
            return met.select(F.expr(f"inline(transform(transform(members, (m, i) -> named_struct('m', m, 'path', {path})), x -> {member}))"))
        down = met.select("_group", *carried, F.expr(f"inline(transform(members, (m, i) -> named_struct('_block', m._pos, 'path', {path})))"))
        above = materialise(down, f"{name}-{number}")
    raise ValueError("a tree has at least one round")


def _rounds(nodes: DataFrame) -> int:
    """Rounds that the tallest group takes."""
    tallest = nodes.agg(F.max("height")).first()[0] or 0
    return max(1, -(-tallest // DEPTH))


def leaves_of(docs: DataFrame, fields: tuple[str, ...] = FIELDS, id_col: str = "doc_id", group_col: str = "lang", seen: Column | None = None) -> DataFrame:
    """(doc_id, _group, node, seen): each row's leaf, and that of the row as ``seen`` later (a text; default: the same)."""
    leaf = leaf_digest(*[F.col(f) for f in fields])
    again = leaf if seen is None else F.when(seen.isNull(), leaf).otherwise(leaf_digest(*[seen if f == fields[-1] else F.col(f) for f in fields]))
    return docs.select(F.col(id_col).alias("doc_id"), group_key(F.col(group_col)).alias("_group"), leaf.alias("node"), again.alias("seen"))


def placed(leaves: DataFrame, order: list[str]) -> DataFrame:
    """Adds ``_pos``, the position in the group, and ``height``, the levels of the group's tree."""
    rows = materialise(leaves, "merkle-leaves")
    ranked = running_before(rows, ["_group"], order, F.lit(1), "_pos", rows.count())
    sizes = rows.groupBy("_group").agg(height_of(F.count(F.lit(1))).alias("height"))
    return ranked.join(sizes, "_group")


def manifest(leaves: DataFrame) -> tuple[Tree, Tree]:
    """The trees of the groups (leaves by doc_id, then digest) and of their subroots."""
    nodes = placed(leaves, ["doc_id", "node"])
    groups = grow(nodes, _rounds(nodes), "merkle-blocks")
    subroots = materialise(groups.roots, "merkle-subroots")
    one = running_before(subroots.select(F.col("_group").alias("_name"), F.col("root").alias("node")), [], ["_name"], F.lit(1), "_pos", n := subroots.count())
    one = one.withColumn("_group", F.lit("")).withColumn("height", height_of(F.lit(n)))
    return groups, grow(one, max(1, -(-(len(oct(n - 1)) - 2 if n > 1 else 0) // DEPTH)), "merkle-top")


def prove(groups: Tree, top: Tree) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every leaf.

    folded_root is the root that follows from the leaf as ``seen`` and the siblings of the manifest.
    """
    start = top.roots.select("_group", "root", F.expr("cast(array() AS array<struct<left: string, right: string>>)").alias("path"))
    with_root = descend(top, start, "named_struct('_group', x.m._name, 'subroot', x.m.node, 'root', root, 'path', x.path)", "merkle-top-paths")
    result = """named_struct('doc_id', x.m.doc_id, 'leaf', x.m.node, 'subroot', subroot, 'root', root,
      'proof_sha256', sha2(array_join(transform(x.path, p -> concat(p.left, p.right)), ''), 256),
      'folded_root', aggregate(x.path, x.m.seen, (h, p) -> sha2(concat(p.left, h, p.right), 256)))"""
    out = descend(groups, materialise(with_root, "merkle-top-paths"), result, "merkle-paths")
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def audit_documents(docs: DataFrame) -> DataFrame:
    """The manifest of ``docs`` and an audit against a copy in which a third of the texts are lower-cased.

    One row per input row: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.  Null
    fields are leaves' ``-``; a null lang is a group of its own, before all others; a null id comes
    first in its group and is not tampered with.  Rows alike in id come in the order of their
    leaves; repeated rows are leaves of their own, side by side.  A lone leaf is its own subroot, a lone
    group's subroot the root.  Texts of any length count whole.  An empty table gives an empty table;
    other columns are ignored.
    """
    hit = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 3 == 0
    return prove(*manifest(leaves_of(docs, seen=F.when(hit, F.translate("text", UPPER, LOWER)))))
