"""Quality rules: base counts, then divergence from language references.

A document that passes the base rules is compared with the reference of every language:
the Jensen-Shannon distance (base 2, square root of the divergence, 0 to 1) between its
and the language's histograms of character classes, and of common words, the latter as
a share of the distance of a text without any common word.  It is kept if for some
language both are within their limits.  A guard leaves out the comparison of common words
for documents too short to expect ``MIN_EXPECTED`` of a language's common words, where chance
alone makes the histograms differ.

References are learned from all documents that pass the base rules, by their ``lang``, and
cover every language.  A word is common if it makes up at least ``COMMON_SHARE`` of a
language's words, so there are 250 at most; words are counted exactly over all documents.  A task holds the references of
about LANG_BLOCK languages; with more, texts are compared with one block after the other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .shared import map_text, materialise

MIN_WORDS = 50
REPEAT_PERCENT = 50
COMMON_SHARE = 0.004
LANG_BLOCK = 256  # languages whose references are held at a time
MIN_EXPECTED = 5
MAX_CLASS_DISTANCE = 0.3
MAX_WORD_DISTANCE = 0.98  # 1 is a text without any common word

SYMBOLS = b"#*$%&|<>"
#: Character classes by byte: fixed values.
CLASSES = ("lower", "upper", "digit", "space", "newline", "stop", "symbol", "other", "high")
_CLASS = np.full(256, CLASSES.index("other"), np.int64)
_CLASS[97:123] = CLASSES.index("lower")
_CLASS[65:91] = CLASSES.index("upper")
_CLASS[48:58] = CLASSES.index("digit")
_CLASS[[32, 9, 11, 12, 13]] = CLASSES.index("space")
_CLASS[10] = CLASSES.index("newline")
_CLASS[list(b".,;:?'\"()-")] = CLASSES.index("stop")
_CLASS[list(SYMBOLS)] = CLASSES.index("symbol")
_CLASS[192:256] = CLASSES.index("high")  # lead bytes: one per character
_DROP = len(CLASSES)  # continuation bytes are not counted
_CLASS[128:192] = _DROP

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True


def base_counts(s: K.Slice) -> tuple[dict[str, np.ndarray], K.Words]:
    """The counts of the base rules for each row of a slice."""
    rows = s.hi - s.lo
    w = K.words(s.data, s.offsets, lower=False)
    n_words = np.diff(w.first)
    row = K.row_of_byte(s.offsets)
    lead = (s.data & 0xC0) != 0x80
    char = np.zeros(len(s.data) + 1, np.int64)
    np.cumsum(lead & ~K._SPACE[s.data], out=char[1:])
    symbol = np.zeros(len(s.data) + 1, np.int64)
    np.cumsum(_SYMBOL[s.data], out=symbol[1:])

    # lines with a word, equal to an earlier line of the row
    breaks = np.flatnonzero(s.data == 10)
    starts = np.unique(np.concatenate([s.offsets[:-1][np.diff(s.offsets) > 0], breaks + 1]))
    starts = starts[starts < len(s.data)]
    ends = np.empty_like(starts)
    if len(starts):
        row_end = s.offsets[1:][row[starts]]
        nxt = np.searchsorted(breaks, starts)
        ends = np.minimum(row_end, np.append(breaks, len(s.data))[nxt])
        worded = np.searchsorted(w.start, ends) > np.searchsorted(w.start, starts)
        starts, ends = starts[worded], ends[worded]
    line_row = row[starts] if len(starts) else np.zeros(0, np.int64)
    key = K.span_hash(s.data, starts, ends) ^ K.mix(line_row + 1)
    order = np.argsort(key, kind="stable")
    again = np.zeros(len(key), bool)
    again[1:] = key[order][1:] == key[order][:-1]
    dup_lines = np.bincount(line_row[order][again], minlength=rows)

    # words in windows of three that occur twice or more in the row
    win = K.window_hash(w.hash, 3)
    covered = np.zeros(len(w.hash), bool)
    if len(win):
        at = np.flatnonzero(w.doc[: len(win)] == w.doc[2 : 2 + len(win)])
        key = win[at] ^ K.mix(w.doc[at] + 1)
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(key), bool)
        twice[1:] |= same
        twice[:-1] |= same
        hit = at[order[twice]]
        for j in range(3):
            covered[hit + j] = True
    repeat = np.bincount(w.doc[covered], minlength=rows)
    out = {
        "n_words": n_words,
        "word_chars": char[s.offsets[1:]] - char[s.offsets[:-1]],
        "n_symbols": symbol[s.offsets[1:]] - symbol[s.offsets[:-1]],
        "n_dup_lines": dup_lines,
        "n_repeat_words": repeat,
        "base_failed": (n_words < MIN_WORDS) | (100 * repeat > REPEAT_PERCENT * n_words),
    }
    return out, w


def class_counts(s: K.Slice) -> np.ndarray:
    width = len(CLASSES) + 1
    flat = K.row_of_byte(s.offsets) * width + _CLASS[s.data]
    return np.bincount(flat, minlength=(s.hi - s.lo) * width).reshape(-1, width)[:, :_DROP]


def common_counts(w: K.Words, rows: int, common: np.ndarray) -> np.ndarray:
    """Counts of the common words (sorted hashes) of each row."""
    if not len(common):
        return np.zeros((rows, 0), np.int64)
    at = np.minimum(np.searchsorted(common, w.hash), len(common) - 1)
    hit = common[at] == w.hash
    return np.bincount(w.doc[hit] * len(common) + at[hit], minlength=rows * len(common)).reshape(rows, -1)


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance, base 2, of rows of counts p to one distribution q."""
    p = p / np.maximum(p.sum(1, keepdims=True), 1)
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        a = np.where(p > 0, p * np.log2(p / m), 0).sum(1)
        b = np.where(q > 0, q * np.log2(q / m), 0).sum(1)
    return np.sqrt(np.clip((a + b) / 2, 0, 1))


def _langs(column) -> tuple[list[str], np.ndarray]:
    d = column.dictionary_encode()
    return d.dictionary.to_pylist(), d.indices.fill_null(-1).to_numpy(zero_copy_only=False)


References = dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]
WORD, CLASS, TOTAL = 0, 1, 2


def language_references(docs: DataFrame, text_col: str, lang_col: str) -> Iterator[References]:
    """Blocks of lang -> (distribution of classes, common word hashes, their distribution with the rest last)."""
    cols = docs.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))

    def count():
        def each(s, rest):
            base, w = base_counts(s)
            names, code = _langs(rest[0])
            classes = class_counts(s)
            good = ~base["base_failed"] & (code >= 0)
            out = {"lang": [], "kind": [], "key": [], "n": []}
            for i, name in enumerate(names):
                rows = good & (code == i)
                if rows.any():
                    value, n = np.unique(w.hash[rows[w.doc]], return_counts=True)
                    kind = [WORD] * len(value) + [CLASS] * len(CLASSES) + [TOTAL]
                    out["lang"] += [name] * len(kind)
                    out["kind"].append(kind)
                    out["key"] += [value.view(np.int64), np.arange(len(CLASSES)), [0]]
                    out["n"] += [n, classes[rows].sum(0), [n.sum()]]
            return {k: v if k == "lang" else np.concatenate(v) for k, v in out.items()} if out["lang"] else None

        return each, None

    counted = map_text(cols, "lang string, kind int, key long, n long", count).groupBy("lang", "kind", "key").agg(F.sum("n").alias("n"))
    counted = materialise(counted, "rules-counts")
    sizes = counted.filter(F.col("kind") == TOTAL).select("lang", F.col("n").alias("total"))
    blocks = -(-sizes.count() // LANG_BLOCK)
    for i in range(blocks):
        here = F.pmod(F.xxhash64("lang"), F.lit(blocks)) == i
        total = {r["lang"]: r["total"] for r in sizes.filter(here).collect()}
        rows = counted.filter(here & (F.col("kind") != TOTAL)).join(F.broadcast(sizes.filter(here)), "lang")
        found: dict[str, dict[int, list]] = {}
        for r in rows.filter((F.col("kind") == CLASS) | (F.col("n") >= F.lit(COMMON_SHARE) * F.col("total"))).collect():
            found.setdefault(r["lang"], {WORD: [], CLASS: []})[r["kind"]].append((r["key"], r["n"]))
        out: References = {}
        for name, kinds in sorted(found.items()):
            classes = np.zeros(len(CLASSES))
            for k, n in kinds[CLASS]:
                classes[k] = n
            hashes = np.array([k for k, _ in kinds[WORD]], np.int64).view(np.uint64)
            counts = np.array([n for _, n in kinds[WORD]], float)
            order = np.argsort(hashes)
            counts = counts[order]
            out[name] = (classes / classes.sum(), hashes[order], np.append(counts, total[name] - counts.sum()) / total[name])
        yield out


class Nearest:
    """The language each row is nearest to so far."""

    def __init__(self, worst: np.ndarray, class_d: np.ndarray, word_d: np.ndarray):
        self.worst, self.class_d, self.word_d = worst, class_d, word_d

    def compare(self, s: K.Slice, w: K.Words, references: References) -> None:
        rows = s.hi - s.lo
        classes, n_words = class_counts(s), np.diff(w.first)
        for ref_class, hashes, ref_words in references.values():
            dc = js_distance(classes, ref_class)
            counts = common_counts(w, rows, hashes)
            dw = js_distance(np.column_stack([counts, n_words - counts.sum(1)]), ref_words)
            none = js_distance(np.append(np.zeros(len(hashes)), 1.0)[None], ref_words)[0]
            dw = np.where(n_words * (1 - ref_words[-1]) < MIN_EXPECTED, 0.0, dw / max(none, 1e-9))
            worst = np.round(np.maximum(dc / MAX_CLASS_DISTANCE, dw / MAX_WORD_DISTANCE), 9)
            better = (worst < self.worst) | ((worst == self.worst) & (dc < self.class_d))
            for mine, new in ((self.worst, worst), (self.class_d, dc), (self.word_d, dw)):
                mine[better] = new[better]


def apply_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per document: the base counts, base_failed, both distances and kept.

    A null or empty text has zero counts and fails the base rules.  Documents without a
    language are judged like all others but teach no reference.  Where no reference could
    be learned (an empty table, or no document with a language) the base rules alone decide.
    Repeated rows are judged one by one; other columns are ignored.
    """
    spark = docs.sparkSession
    blocks = [spark.sparkContext.broadcast(r) for r in language_references(docs, text_col, lang_col)]
    id_type = docs.schema[id_col].dataType.simpleString()
    ddl = (
        f"doc_id {id_type}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
        "base_failed boolean, kept boolean, class_distance double, word_distance double"
    )
    carried = ("worst", "class_d", "word_d")

    def state(rest):
        return Nearest(*(x.to_numpy(zero_copy_only=False).copy() for x in rest[-3:]))

    def step(shared):
        def task():
            def each(s, rest):
                near = state(rest)
                near.compare(s, K.words(s.data, s.offsets, lower=False), shared.value)
                return {"text": rest[1], "doc_id": rest[0]} | {k: getattr(near, k) for k in carried}

            return each, None

        return task

    def judge():
        def each(s, rest):
            base, w = base_counts(s)
            near = state(rest)
            if blocks:
                near.compare(s, w, blocks[-1].value)
            kept = ~base["base_failed"] & ((near.worst <= 1) | (not blocks))
            return base | {"doc_id": rest[0], "kept": kept, "class_distance": np.round(near.class_d, 4), "word_distance": np.round(near.word_d, 4)}

        return each, None

    start = [F.lit(x).cast("double").alias(k) for k, x in zip(carried, (float("inf"), 1.0, 1.0))]
    rows = docs.select(F.col(text_col).alias("text"), F.col(id_col).alias("doc_id"), *start)
    for shared in blocks[:-1]:
        rows = rows.select("text", "doc_id", F.col("text").alias("again"), *carried)
        rows = map_text(rows, f"text string, doc_id {id_type}, worst double, class_d double, word_d double", step(shared))
    return map_text(rows.select("text", "doc_id", *carried), ddl, judge)
