"""Exact substring removal with suffix arrays.

A byte is removed if a ``WINDOW``-byte string that covers it also starts in a document with
a smaller id.  Every window has an anchor, the k-byte string in it with the smallest hash
(the leftmost of equals), so equal windows have equal anchors at equal places.  Runs of
windows with one anchor make a fragment.

1. Anchors meet by hash bucket; those of at least two documents are shared.  What a task
   sees in several documents itself it sends once.
2. Documents, dealt by id, turn their shared anchors into fragments; equal fragments of a
   bucket of documents are sent once, with the smallest and the largest id they stand in.
3. In each shard of anchors, fragments that stand under one anchor with different bytes are
   joined to one text.  Its suffix array is induced (suffix_array.py); suffixes whose
   permuted common prefix is a window or more form runs, and the smallest id of a run is
   the smallest id of all documents with that window.
4. Back at the documents, windows whose smallest id is below the document's are marked and
   their bytes removed.

No task holds all fragments of a hot passage: tasks send each distinct fragment once.  An anchor
in more documents than a HOT_PART of its bucket (a common phrase with other words around it)
is hot: its windows are fragments of their own, under a hash of their bytes, so that they
spread over the buckets and equal ones still meet.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .shared import arrow_schema, discard, materialise, running_before, scratch_path, shuffle_width, workers_find_package
from .suffix_array import common_prefixes, suffix_array

WINDOW = 50
ANCHOR = 24
FLUSH_BYTES = 16 << 20
PIECE_BYTES = 1 << 20
NULL_ID = 1 << 62
ROW = "deal int, kind int, a binary, b binary, c binary"
ANCHORS, SHARED, RESULTS, TEXTS, HOT = 0, 1, 2, 3, 4
BUCKET_BYTES = 16 << 20  # of text, for a bucket of anchors
TURN_BYTES = 24 << 20  # of fragments that a task unpacks, or holds before it sends them
SORT_BYTES = 1 << 18  # of fragments whose suffixes are sorted together: that takes some 100 times their bytes
HOT_PART, HOT_LEAST = 16, 1024  # a sixteenth of a bucket's anchors, and so many documents at least


def squeeze(x: np.ndarray) -> bytes:
    raw = np.ascontiguousarray(x).tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def expand(raw: bytes, dtype) -> np.ndarray:
    size = int.from_bytes(raw[:8], "little")
    return np.frombuffer(pa.decompress(raw[8:], size, "zstd", asbytes=True), dtype) if size else np.zeros(0, dtype)


def deal_of(ids: np.ndarray, deals: int) -> np.ndarray:
    return ((K.mix(ids.astype(np.int64).view(np.uint64)) >> np.uint64(20)) % np.uint64(deals)).astype(np.int64)


def fragments(data: np.ndarray, offsets: np.ndarray, total: np.ndarray | None = None):
    """(row, first window, last window, anchor hash) of each run of windows with one anchor, in order; ``total`` may pass in the prefix sums."""
    windows, span = len(data) - WINDOW + 1, WINDOW - ANCHOR + 1
    none = np.zeros(0, np.int64)
    if windows <= 0:
        return none, none, none, none.view(np.uint64)
    if total is None:
        total = K.prefix_sums(data)
    h = K.mix((total[ANCHOR:] - total[:-ANCHOR]) * K.powers(len(data) + 1, K._BASE_INV)[: len(data) - ANCHOR + 1])
    low = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    size = 1
    while 2 * size <= span:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    if size < span:
        low = np.minimum(low[: len(low) - (span - size)], low[span - size :])
    place = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
    row = K.row_of_byte(offsets)
    inside = row[:windows] == row[WINDOW - 1 :]
    first = np.flatnonzero(inside & np.concatenate([[True], (place[1:] != place[:-1]) | (row[1:windows] != row[: windows - 1]) | ~inside[:-1]]))
    # a run ends where the next begins, or with the last window of its row
    end = np.append(first[1:], windows) - 1
    end = np.minimum(end, offsets[1:][row[first]] - WINDOW)
    return row[first], first, end, h[place[first]]


def split_hot(data: np.ndarray, row, first, last, h, hot: np.ndarray):
    """The fragments, those under hot anchors (sorted, 32 bits) window by window under a hash of the window."""
    key = h.astype(np.uint32)
    is_hot = hot[np.minimum(np.searchsorted(hot, key), len(hot) - 1)] == key if len(hot) else np.zeros(len(h), bool)
    if not is_hot.any():
        return row, first, last, h
    n = np.where(is_hot, last - first + 1, 1)
    of = np.repeat(np.arange(len(n)), n)
    start = first[of] + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    each = is_hot[of]
    h = h[of]
    h[each] = content_numbers(data, start[each], start[each] + WINDOW)
    return row[of], start, np.where(each, start, last[of]), h


def _match_key(ids: np.ndarray, key32: np.ndarray) -> np.ndarray:
    return K.mix(ids.astype(np.int64).view(np.uint64)) + key32.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def _by_part(part: np.ndarray):
    """Slices of equal values of a sorted array."""
    cut = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(part)]]) if len(part) else np.zeros(1, np.int64)
    return [(int(part[a]), slice(int(a), int(b))) for a, b in zip(cut, cut[1:])]


def _places(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places of spans, one after the other."""
    total = int(size.sum())
    kind = np.int32 if max(total, int(start.max(initial=0)) + total) < 1 << 31 else np.int64
    at = np.repeat((start - (np.cumsum(size) - size)).astype(kind), size)
    at += np.arange(total, dtype=kind)
    return at


def _blocks(size: np.ndarray, limit: int) -> list[slice]:
    """Slices of neighbours that add up to about ``limit`` each, or of one."""
    return [s for _, s in _by_part((np.cumsum(size) - size) // limit)]


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["deal", "kind", "a", "b", "c"])


def find_anchors(texts: DataFrame, buckets: int, deals: int) -> DataFrame:
    """Rows of kind ANCHORS (by anchor bucket: ids, keys) and SHARED (by document deal: ids, keys)."""

    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def flush():
            h = np.concatenate([x[0] for x in held])
            ids = np.concatenate([x[1] for x in held])
            order = np.lexsort((ids, h))
            h, ids = h[order], ids[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (ids[1:] != ids[:-1])
            h, ids = h[new], ids[new]
            first = np.ones(len(h), bool)
            first[1:] = h[1:] != h[:-1]
            many = np.diff(np.append(np.flatnonzero(first), len(h)))[np.cumsum(first) - 1]
            several = many > 1
            out = []
            for kind, use in ((ANCHORS, first), (SHARED, several)):
                key, who, times = h[use], ids[use], many[use]
                deal = ((key >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64) if kind == ANCHORS else deal_of(who, deals)
                order = np.lexsort((who, deal))
                key, who, deal, times = key[order].astype(np.uint32), who[order], deal[order], times[order].astype(np.uint32)
                for d, s in _by_part(deal):
                    out.append((d, kind, squeeze(np.diff(who[s], prepend=0)), key[s].tobytes(), squeeze(times[s]) if kind == ANCHORS else None))
            return _rows(out)

        for batch in batches:
            for s in K.text_slices(batch.column(0), PIECE_BYTES):
                ids = batch.column(1).slice(s.lo, s.hi - s.lo).to_numpy(zero_copy_only=False)
                row, _, _, h = fragments(s.data, s.offsets)
                held.append((h, ids[row]))
                size += len(s.data)
                if size >= FLUSH_BYTES:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return texts.mapInArrow(run, ROW)


def share_anchors(batches, deals: int):
    """Anchors of several documents, sent on to the documents' deals, and the hot ones."""
    held: dict[int, list] = {}
    for batch in batches:
        for d, a, b, c in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4))):
            held.setdefault(d, []).append((np.cumsum(expand(a, np.int64)), np.frombuffer(b, np.uint32), expand(c, np.uint32)))
    for parts in held.values():
        ids, key, times = (np.concatenate([p[i] for p in parts]) for i in range(3))
        order = np.lexsort((ids, key))
        ids, key, times = ids[order], key[order], times[order].astype(np.int64)
        start = np.concatenate([[True], key[1:] != key[:-1]])
        hot = np.add.reduceat(times, np.flatnonzero(start)) > max(HOT_LEAST, int(times.sum()) // HOT_PART)
        if hot.any():
            yield _rows([(0, HOT, None, key[np.flatnonzero(start)[hot]].tobytes(), None)])
        low = ids[np.flatnonzero(start)][np.cumsum(start) - 1]
        differs = np.bincount(np.cumsum(start) - 1, ids != low) > 0
        use = differs[np.cumsum(start) - 1]
        ids, key = ids[use], key[use]
        deal = deal_of(ids, deals)
        order = np.lexsort((ids, deal))
        ids, key, deal = ids[order], key[order], deal[order]
        if len(ids):
            yield _rows([(d, SHARED, squeeze(np.diff(ids[s], prepend=0)), key[s].tobytes(), None) for d, s in _by_part(deal)])


def deal_texts(texts: DataFrame, deals: int) -> DataFrame:
    """Rows of kind TEXTS: ids, lengths and compressed bytes by document deal."""

    def run(batches):
        for batch in batches:
            for s in K.text_slices(batch.column(0), FLUSH_BYTES // 2, 20_000):  # large pieces compress better
                ids = batch.column(1).slice(s.lo, s.hi - s.lo).to_numpy(zero_copy_only=False)
                deal = deal_of(ids, deals)
                order = np.argsort(deal, kind="stable")
                out = []
                for d, part in _by_part(deal[order]):
                    mine = order[part]
                    raw = np.concatenate([s.data[s.offsets[i] : s.offsets[i + 1]] for i in mine])
                    out.append((d, TEXTS, ids[mine].tobytes(), np.diff(s.offsets)[mine].tobytes(), squeeze(raw)))
                yield _rows(out)

    return texts.mapInArrow(run, ROW)


def _deals(batches):
    """(deal, shared keys, results, texts) of a partition sorted by deal and kind, texts about a megabyte at a time.

    Keys are in order, and results (contents, spans, ids) by content.
    """
    deal, shared, results, known, texts, size = None, [], [], None, [], 0
    for batch in batches:
        for d, kind, a, b, c in zip(*(batch.column(i).to_pylist() for i in range(5))):
            if d != deal or size >= PIECE_BYTES:
                if texts:
                    yield deal, *known, texts
                texts, size = [], 0
            if d != deal:
                deal, shared, results, known = d, [], [], None
            if kind == SHARED:
                shared.append(_match_key(np.cumsum(expand(a, np.int64)), np.frombuffer(b, np.uint32)))
            elif kind == RESULTS:
                results.append((expand(a, np.uint64), expand(b, np.uint8).reshape(-1, 3), expand(c, np.int64)))
            else:
                if known is None:  # texts come last
                    known = np.sort(np.concatenate([np.zeros(0, np.uint64), *shared])), _by_content(results)
                    shared, results = [], []
                texts.append((np.frombuffer(a, np.int64), np.frombuffer(b, np.int64), expand(c, np.uint8)))
                size += len(texts[-1][2])
    if texts:
        yield deal, *known, texts


def _by_content(results: list):
    none = np.zeros(0, np.uint64), np.zeros((0, 3), np.uint8), np.zeros(0, np.int64)
    content, span, low = (np.concatenate(x) for x in zip(none, *results))
    order = np.argsort(content, kind="stable")
    return content[order], span[order], low[order]


def content_numbers(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The same number for equal fragments: their bytes decide their anchor too."""
    out = np.zeros(len(starts), np.uint64)
    lo = 0
    while lo < len(starts):  # a megabyte at a time: hashing needs many times the bytes
        hi = max(lo + 1, int(np.searchsorted(starts, starts[lo] + PIECE_BYTES)))
        a, b = int(starts[lo]), int(ends[lo:hi].max())
        out[lo:hi] = K.span_hash(data[a:b], starts[lo:hi] - a, ends[lo:hi] - a)
        lo = hi
    return out


def _shared_fragments(shared: np.ndarray, hot: np.ndarray, ids: np.ndarray, data: np.ndarray, offsets: np.ndarray):
    """(row, first window, last window, anchor, content number) of the fragments under shared anchors."""
    total = K.prefix_sums(data)
    row, first, last, h = fragments(data, offsets, total)
    if len(shared) and len(row):
        key = _match_key(ids[row], h.astype(np.uint32))
        at = np.minimum(np.searchsorted(shared, key), len(shared) - 1)
        use = shared[at] == key
    else:
        use = np.zeros(len(row), bool)
    row, first, last, h = split_hot(data, row[use], first[use], last[use], h[use], hot)
    return row, first, last, h, K.span_hash(data, first, last + WINDOW, total)


def _joined(texts: list):
    ids = np.concatenate([t[0] for t in texts])
    offsets = np.concatenate([[0], np.cumsum(np.concatenate([t[1] for t in texts]))])
    return ids, np.concatenate([t[2] for t in texts]), offsets


def send_fragments(batches, buckets: int, hot: np.ndarray):
    """Distinct fragments of each deal of documents by anchor bucket: anchors, smallest and largest ids, sizes, bytes.

    They are sent whenever TURN_BYTES have gathered, so a fragment may go out a few times from one deal.
    """
    kept: list = []
    deal_now, held = None, 0

    def flush():
        h, content, low, high, size, raw = (np.concatenate([k[i] for k in kept]) for i in range(6))
        kept.clear()
        spans = np.concatenate([[0], np.cumsum(size)])
        _, one, inverse = np.unique(content, return_index=True, return_inverse=True)
        lows, highs = np.full(len(one), np.iinfo(np.int64).max), np.full(len(one), np.iinfo(np.int64).min)
        np.minimum.at(lows, inverse, low)
        np.maximum.at(highs, inverse, high)
        bucket = ((h[one] >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        out = []
        for d, part in _by_part(bucket[order]):
            pick = order[part]
            src = one[pick]
            body = np.concatenate([raw[spans[i] : spans[i + 1]] for i in src])
            head = np.stack([(h[src] & np.uint64(0xFFFFFFFF)).view(np.int64), lows[pick], highs[pick], size[src]])
            out.append((d, deal_now, squeeze(head), squeeze(body), None))
        return _rows(out)

    for deal, shared, _, texts in _deals(batches):
        if deal != deal_now and kept:
            yield flush()
            held = 0
        deal_now = deal
        ids, data, offsets = _joined(texts)
        row, first, last, h, content = _shared_fragments(shared, hot, ids, data, offsets)
        if not len(row):
            continue
        order = np.lexsort((ids[row], content))
        row, first, last, h, content = row[order], first[order], last[order], h[order], content[order]
        start = np.flatnonzero(np.concatenate([[True], content[1:] != content[:-1]]))
        end = np.append(start[1:], len(content)) - 1
        size = (last - first + WINDOW)[start]
        for s in _blocks(size, TURN_BYTES // 4):
            a = start[s]
            kept.append((h[a], content[a], ids[row[a]], ids[row[end[s]]], size[s], data[_places(first[a], size[s])]))
            held += len(kept[-1][5])
            if held >= TURN_BYTES:
                yield flush()
                held = 0
    if kept:
        yield flush()


def match_fragments(batches):
    """For each fragment, the smallest id of each of its windows; rows (deal, RESULTS, contents, runs, ids).

    A bucket's fragments wait as they were sent, compressed.  They are matched in turns, each
    with a share of the anchors, so that what a task unpacks does not grow with its bucket.
    """
    held: dict[int, list] = {}
    for batch in batches:
        for bucket, deal, a, b in zip(*(batch.column(i).to_pylist() for i in range(4))):
            held.setdefault(bucket, []).append((deal, a, b))
    while held:
        parts = held.popitem()[1]
        turns = -(-sum(int.from_bytes(b[:8], "little") for _, _, b in parts) // TURN_BYTES)
        for turn in range(turns):
            rows = _match_turn(parts, turn, turns)
            if rows:
                yield _rows(rows)


def _match_turn(parts: list, turn: int, turns: int) -> list[tuple]:
    """The results of the anchors whose turn it is."""
    heads, contents, raws, deals = [], [], [], []
    for d, a, b in parts:
        head, raw = expand(a, np.int64).reshape(4, -1), expand(b, np.uint8)
        if turns > 1:
            mine = np.flatnonzero(K.mix(head[0].view(np.uint64)) % np.uint64(turns) == turn)
            start = (np.cumsum(head[3]) - head[3])[mine]
            head = head[:, mine]
            raw = raw[_places(start, head[3])]
        spans = np.concatenate([[0], np.cumsum(head[3])])
        heads.append(head)
        contents.append(content_numbers(raw, spans[:-1], spans[1:]))
        raws.append(raw)
        deals.append(np.full(head.shape[1], d, np.int64))
    anchor, low, high, size = np.concatenate(heads, axis=1)
    content, raw, deal = np.concatenate(contents), np.concatenate(raws), np.concatenate(deals)
    del heads, contents, raws, deals
    start = np.cumsum(size) - size
    _, one, inverse = np.unique(content, return_index=True, return_inverse=True)
    lows = np.full(len(one), np.iinfo(np.int64).max)
    np.minimum.at(lows, inverse, low)
    # an anchor with one fragment needs no sorting: all its windows have the fragment's smallest id
    _, group = np.unique(anchor[one], return_inverse=True)
    alone = np.bincount(group)[group] == 1
    runs = [np.column_stack([np.flatnonzero(alone), np.zeros(alone.sum(), np.int64), (size[one] - WINDOW)[alone], lows[alone]])]
    mixed = np.flatnonzero(~alone)
    mixed = mixed[np.argsort(group[mixed], kind="stable")]
    ends = np.flatnonzero(np.diff(group[mixed], append=-1)) + 1  # of groups, which are sorted whole
    cuts = np.concatenate([[0], ends])
    for part in _blocks(np.diff(np.concatenate([[0], np.cumsum(size[one[mixed]])])[cuts]), SORT_BYTES):
        which = mixed[cuts[part.start] : cuts[part.stop]]
        runs.append(_suffix_runs(which, raw[_places(start[one[which]], size[one[which]])], size[one[which]], lows[which]))
    del raw
    runs = np.concatenate(runs)
    runs = runs[np.argsort(runs[:, 0], kind="stable")]
    first = np.searchsorted(runs[:, 0], np.arange(len(one) + 1))
    count = first[inverse + 1] - first[inverse]
    which, at = np.repeat(np.arange(len(inverse)), count), _places(first[inverse], count)
    useful = runs[at, 3] < high[which]  # some document of the deal has a larger id
    which, at = which[useful], at[useful]
    order = np.argsort(deal[which], kind="stable")
    which, at = which[order], at[order]
    rows = []
    for d, s in _by_part(deal[which]):
        r = runs[at[s]]
        span = np.column_stack([r[:, 1], r[:, 2], np.zeros(len(r), np.int64)]).astype(np.uint8)
        rows.append((d, RESULTS, squeeze(content[which[s]]), squeeze(span), squeeze(r[:, 3])))
    return rows


def _suffix_runs(number: np.ndarray, data: np.ndarray, size: np.ndarray, low: np.ndarray) -> np.ndarray:
    """(fragment, first window, last window, smallest id) from the suffix array of all fragments, whose bytes are ``data``."""
    start = np.concatenate([[0], np.cumsum(size + 1)])
    text = np.ones(start[-1], np.int16)  # 1 parts the pieces, bytes are 2..257
    body = np.ones(start[-1], bool)
    body[start[1:] - 1] = False
    text[body] = data.astype(np.int16) + 2
    sa = suffix_array(text)
    same = common_prefixes(text, sa, WINDOW) >= WINDOW
    of = np.repeat(np.arange(len(size)), size + 1)  # the piece of each place
    piece = of[sa]
    window = sa - start[piece] + WINDOW <= size[piece]
    # windows hold no parting mark, so equal ones are neighbours and all entries between are windows too
    run = np.cumsum(~(same & window))
    smallest = np.full(int(run[-1]) + 1, np.iinfo(np.int64).max)
    np.minimum.at(smallest, run[window], low[piece[window]])
    best = np.full(len(text), -1, np.int64)
    best[sa[window]] = smallest[run[window]]
    place = np.sort(sa[window])
    owner, value = of[place], best[place]
    new = np.concatenate([[True], (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(place)) - 1
    return np.column_stack([number[owner[first]], place[first] - start[owner[first]], place[last] - start[owner[first]], value[first]])


def cut_texts(batches, schema: pa.Schema, hot: np.ndarray):
    """The result of every document."""
    for _, _, results, texts in _deals(batches):
        ids, data, offsets = _joined(texts)
        total = K.prefix_sums(data)
        row, first, last, _ = split_hot(data, *fragments(data, offsets, total), hot)
        content = K.span_hash(data, first, last + WINDOW, total)
        depth = np.zeros(len(data) + 1, np.int32)
        c, span, low = results
        if len(c) and len(row):
            a, b = np.searchsorted(c, content, "left"), np.searchsorted(c, content, "right")
            which = np.repeat(np.arange(len(row)), b - a)
            at = np.arange(len(which)) + np.repeat(a - (np.cumsum(b - a) - (b - a)), b - a)
            use = low[at] < ids[row[which]]
            which, at = which[use], at[use]
            span = span[at].astype(np.int64)
            np.add.at(depth, first[which] + span[:, 0], 1)
            np.add.at(depth, first[which] + span[:, 1] + WINDOW, -1)
        removed = np.cumsum(depth[:-1]) > 0
        rows = len(ids)
        of = K.row_of_byte(offsets)
        begins = removed.copy()
        begins[1:] &= ~removed[:-1] | (of[1:] != of[:-1])
        digest = [hashlib.sha256(data[offsets[i] : offsets[i + 1]][~removed[offsets[i] : offsets[i + 1]]].tobytes()).hexdigest() for i in range(rows)]
        yield K.table({
            "id": ids, "n_bytes": np.diff(offsets), "n_removed": np.bincount(of[removed], minlength=rows),
            "n_spans": np.bincount(of[begins], minlength=rows), "kept_sha256": digest,
        }, schema)


def numbered(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame | None, int | None, int]:
    """(text and a number with the order of ids, (number, id) where numbers are not ids less a shift, the shift or None without null ids, bytes of text).

    Null ids get numbers from NULL_ID on, by a hash of their text.  Ids are numbers as they
    are where there is no null, or none reaches NULL_ID; else they are shifted down, or where
    they fill the whole range, ranked.
    """
    text, number = F.col(text_col).alias("text"), F.col(id_col).cast("long")
    nulls, low, high, size = docs.agg(F.max(number.isNull()), F.min(number), F.max(number), F.coalesce(F.sum(F.octet_length(F.col(text_col))), F.lit(0))).first()
    hashed = F.lit(NULL_ID) + F.pmod(F.xxhash64(F.col(text_col)), F.lit(NULL_ID // 2))
    if not nulls:
        return docs.select(text, number.alias("id")), None, None, size
    if high is None or high < NULL_ID:
        return docs.select(text, F.coalesce(number, hashed).alias("id")), None, 0, size
    if low >= -NULL_ID:
        return docs.select(text, F.coalesce(number - F.lit(NULL_ID), hashed).alias("id")), None, NULL_ID, size
    ids = docs.select(number.alias("own")).filter("own is not null").distinct()
    ranks = materialise(running_before(ids, [], ["own"], F.lit(1), "id", docs.count()), "suffix-ranks")
    met = docs.select(text, number.alias("own")).join(ranks.hint("merge"), "own", "left")
    return met.select("text", F.coalesce("id", F.lit(NULL_ID) + F.pmod(F.xxhash64("text"), F.lit(NULL_ID // 2))).alias("id")), ranks, 0, size


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    A null text is empty; texts shorter than a window lose nothing.  Rows with the same id
    do not count as smaller than each other.  Ids may be any long; null ids are larger than all others and are
    ordered among themselves by a hash of their text.  An empty table gives an empty table;
    other columns are ignored.
    """
    spark = docs.sparkSession
    workers_find_package(spark)
    id_type = docs.schema[id_col].dataType.simpleString()
    texts, ranks, shift, size = numbered(docs, id_col, text_col)
    buckets = max(shuffle_width(spark), -(-size // BUCKET_BYTES))  # what a task holds follows neither the input nor the shuffle partitions
    deals = 2 * buckets
    ddl = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    schema = arrow_schema(ddl)

    path = scratch_path(spark, "suffix-anchors")
    anchors = materialise(find_anchors(texts, buckets, deals), "suffix-anchors", path, "none")
    met = anchors.filter(F.col("kind") == ANCHORS).repartitionById(buckets, F.col("deal")).mapInArrow(lambda b: share_anchors(b, deals), ROW)
    shared = materialise(met.union(anchors.filter(F.col("kind") == SHARED)), "suffix-shared", compression="none")
    del anchors, met
    discard(spark, path)
    keys = [np.frombuffer(r["b"], np.uint32) for r in shared.filter(F.col("kind") == HOT).select("b").collect()]  # few: see HOT_PART
    hot = np.unique(np.concatenate([np.zeros(0, np.uint32), *keys]))
    shared = shared.filter(F.col("kind") == SHARED)
    dealt = lambda df: df.repartitionById(deals, F.col("deal")).sortWithinPartitions("deal", "kind")
    found = dealt(shared.union(deal_texts(texts, deals))).mapInArrow(lambda b: send_fragments(b, buckets, hot), ROW)
    results = materialise(found.repartitionById(buckets, F.col("deal")).mapInArrow(match_fragments, ROW), "suffix-results", compression="none")
    done = dealt(results.union(deal_texts(texts, deals))).mapInArrow(lambda b: cut_texts(b, schema, hot), ddl)
    columns = ["n_bytes", "n_removed", "n_spans", "kept_sha256"]
    if ranks is not None:
        return done.join(ranks.hint("merge"), "id", "left").select(F.col("own").cast(id_type).alias("doc_id"), *columns)
    own = F.col("id") if shift is None else F.when(F.col("id") < NULL_ID, F.col("id") + F.lit(shift))
    return done.select(own.cast(id_type).alias("doc_id"), *columns)
