"""Benchmark decontamination by pigeonhole edit matching.

A test item of m characters (lower-cased, white space collapsed) may occur with up to k
edits, k an odd number near ERROR_RATE * m.  Cut into k + 1 pieces, at least one piece is
untouched by k edits, and of the (k + 1) / 2 pairs of neighbouring pieces at least one
has at most one edit.  An automaton finds all exact piece hits in the whole text; a hit
whose pair fails the one-edit test is dropped; what remains is verified with Myers'
bit-parallel distance over the item's window.

Items under SHORT_CHARS characters are allowed no edits: they are one piece, found
where it stands between spaces, punctuation or the ends of the text.

Documents are scanned where they are read: there is no shuffle.  Items are scanned for in
blocks of BLOCK_CHARS characters, so that the automaton of a pass has a size bound.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .shared import arrow_schema, workers_find_package

ERROR_RATE = 0.10
SHORT_CHARS = 20
BLOCK_CHARS = 2_000_000


def normalise(text: str) -> str:
    return " ".join(text.split()).lower()


def budget(length: int) -> int:
    """Errors allowed: odd, so that pieces pair up, at least one; none for short items."""
    return 0 if length < SHORT_CHARS else max(1, int(length * ERROR_RATE) - 1 | 1)


def pieces(item: str, k: int) -> list[tuple[int, int]]:
    """k + 1 spans of nearly equal length."""
    n = len(item)
    cuts = [n * i // (k + 1) for i in range(k + 2)]
    return list(zip(cuts, cuts[1:]))


def one_edit(a: str, b: str) -> bool:
    """Whether two strings are at most one insertion, deletion or substitution apart."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    short = min(len(a), len(b))
    head = 0
    while head < short and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < short - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    return head + tail >= max(len(a), len(b)) - 1


def near_pair(text: str, at: int, sibling: str, before: bool) -> bool:
    """Whether the sibling piece ends (before) or starts at ``at`` with at most one edit."""
    n = len(sibling)
    for size in (n, n - 1, n + 1):
        part = text[max(0, at - size) : at] if before else text[at : at + size]
        if one_edit(part, sibling):
            return True
    return False


def myers(pattern: str, text: str) -> tuple[int, int]:
    """(least edit distance of the pattern to any substring of text, where the first such one ends)."""
    m = len(pattern)
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, end = full, 0, m, m, 0
    for i, c in enumerate(text):
        eq = masks.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (~(xh | pv) & full)
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = ph << 1 & full
        mh = mh << 1 & full
        pv = mh | (~(xv | ph) & full)
        mv = ph & xv
        if score < best:
            best, end = score, i + 1
    return best, end


class Matcher:
    """Finds all items of a block in a text."""

    def __init__(self, items: list[tuple[object, str]]):
        import ahocorasick

        self.items = items
        self.automaton = ahocorasick.Automaton()
        homes: dict[str, list[tuple[int, int]]] = {}
        self.cuts = []
        for n, (_, item) in enumerate(items):
            spans = pieces(item, budget(len(item)))
            self.cuts.append(spans)
            for j, (a, b) in enumerate(spans):
                homes.setdefault(item[a:b], []).append((n, j))
        for piece, where in homes.items():
            self.automaton.add_word(piece, (len(piece), where))
        if homes:
            self.automaton.make_automaton()
        self.empty = not homes

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item number, distance, start, end) of the best occurrence of each item that occurs."""
        if self.empty:
            return []
        windows: dict[int, list[int]] = {}
        for last, (size, where) in self.automaton.iter(text):
            start = last + 1 - size
            for n, j in where:
                item, spans = self.items[n][1], self.cuts[n]
                if len(spans) == 1:
                    if not text[max(start - 1, 0) : start].isalnum() and not text[last + 1 : last + 2].isalnum():
                        windows.setdefault(n, []).append(start)
                    continue
                a, b = spans[j ^ 1]
                if near_pair(text, start if j & 1 else last + 1, item[a:b], bool(j & 1)):
                    windows.setdefault(n, []).append(start - spans[j][0])
        out = []
        for n, starts in windows.items():
            item = self.items[n][1]
            k = budget(len(item))
            if not k:
                out.append((n, 0, min(starts), min(starts) + len(item)))
                continue
            best = None
            starts.sort()
            lo = starts[0]
            for at, nxt in zip(starts, [*starts[1:], None]):
                if nxt is not None and nxt - at <= 2 * k:
                    continue  # windows that overlap nearly whole are verified as one
                a, b = max(0, lo - k), at + len(item) + k
                distance, end = myers(item, text[a:b])
                if distance <= k and (best is None or distance < best[1]):
                    _, back = myers(item[::-1], text[a : a + end][::-1])
                    best = (n, distance, a + end - back, a + end)
                lo = nxt
            if best:
                out.append(best)
        return out


def item_blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text"):
    """Blocks of (id, normalised item) of about BLOCK_CHARS characters; items that are null or blank are left out."""
    items = benchmark.filter(F.length(text_col) > 0).select(F.col(id_col).alias("item_id"), F.col(text_col).alias("text"))
    chars = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks = -(-chars // BLOCK_CHARS)
    for i in range(blocks):
        part = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("text", "item_id"), F.lit(blocks)) == i)
        found = [(r["item_id"], normalise(r["text"])) for r in part.collect()]
        found = sorted(((a, b) for a, b in found if b), key=lambda x: (x[1], str(x[0])))
        if found:
            yield found


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document and item that occurs in it: doc_id, item_id, distance, budget, start, end.

    ``start`` and ``end`` are character positions of the best occurrence in the normalised
    text.  Null and empty texts hold nothing; items that are null or blank are not searched
    for; items under SHORT_CHARS characters are found without edits, at word boundaries; repeated documents and items give repeated rows; an
    empty table on either side gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    workers_find_package(spark)
    ddl = "doc_id {}, item_id {}, distance int, budget int, start int, end int".format(
        docs.schema[id_col].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()
    )
    schema = arrow_schema(ddl)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    out = spark.createDataFrame([], ddl)
    for block in item_blocks(benchmark):
        shared = spark.sparkContext.broadcast(block)

        def scan(batches, shared=shared):
            matcher = Matcher(shared.value)
            for batch in batches:
                ids, texts = batch.column(0), batch.column(1)
                found = []
                for i in range(batch.num_rows):
                    text = texts[i].as_py()
                    if text:
                        doc = ids[i].as_py()
                        found += [
                            (doc, matcher.items[n][0], d, budget(len(matcher.items[n][1])), a, b) for n, d, a, b in matcher.find(normalise(text))
                        ]
                yield pa.RecordBatch.from_arrays([pa.array([f[j] for f in found], t.type) for j, t in enumerate(schema)], schema=schema)

        out = out.unionByName(rows.mapInArrow(scan, ddl))
    return out


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose text holds no item.

    Null and empty texts stay; rows that repeat are judged one by one; an empty table on either side
    drops nothing; null, blank and short items are treated as in ``find_leaks``.
    """
    workers_find_package(docs.sparkSession)
    at = docs.columns.index(text_col)
    for block in item_blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def keep(batches, shared=shared):
            matcher = Matcher(shared.value)
            for batch in batches:
                for s in K.text_slices(batch.column(at), K.LEAN_BYTES):
                    part = batch.slice(s.lo, s.hi - s.lo)
                    clean = []
                    for text in part.column(at):
                        text = text.as_py()
                        clean.append(not text or not matcher.find(normalise(text)))
                    yield part.filter(pa.array(clean, pa.bool_()))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs
