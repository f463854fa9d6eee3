"""Language-model scores by logistic context mixing of bit predictors.

Tokens are lower-cased words and one end per text.  A token is coded in bits: frequent
words (the head, by counts over all training documents) and the end have Huffman codes; all other
words take an escape code and are then spelled.  Each bit is predicted by several predictors, each a table of
counts addressed by a hash of its context and the code node: no word, the word before, the
two words before.  Their stretched probabilities are added with weights gated by how often
the two words were seen and by the node's depth, learned online; an adaptive map then refines
the sum.  A word after the escape is a mixture of its share among all non-head training
tokens (exact counts) and of a letter model of the same kind, whose contexts are the one to
four letters before; the letter model has the share of new words, the words seen once among
all non-head training tokens.

The context tables are not one broadcast model: every token goes to the bucket of the word
before it, and each bucket counts its own contexts, so that what the predictors gather grows
with the corpus.  A word before too many tokens (hot) is split by the two words before; the counts
of hot words, and of pairs that are hot themselves, are in tables of a fixed size that are broadcast.
Tokens after a hot pair are scored where they are read, by a mixer that all tasks learn in part.
Each bucket learns the weights and the map from all its training tokens, each bit being left
out of its own counts, some contexts at a time, and scores those contexts after it has learned from them.
So all tokens under a context are scored by one model, whose probabilities add up to one.  The number of buckets follows
from the bytes of training text, and held-out texts have no part in any count, code, chunk or order of learning.

The score is the log10 probability over the events of the base score: training words, one
class of all unknown words, and the end.  ``bits_per_byte`` are the bits that tell the text's
lower-cased words, unknown ones spelled, for each byte of text.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .shared import arrow_schema, map_text, materialise, shuffle_width, workers_find_package

MODULUS, HELD_OUT = 5, 1
DISTINCT = 1 << 20  # words a task counts before it sends them on
HEAD = 32_768
BUCKET_BYTES, MOST_BYTES, BUCKETS = 6 << 20, 32 << 20, (8, 256)
MANY = 4
MIN_HEAD_COUNT = 3
HOT_BITS = (20, 18)  # table sizes for hot words and hot pairs of words
HOT_SHARE = 4  # a context is hot if it has more than a quarter of a bucket's mean
LETTER_BITS = 20
LETTER_ORDERS = (1, 2, 3, 4)
TOKENS, LETTERS = 1 << 14, 1 << 13  # tokens and letters whose bits are expanded at a time: they fit a processor's cache
SLICE_BYTES, SLICE_ROWS = 4 << 20, 8192
BLOCK = 1 << 16
CONFIDENCE = 8
GATES = 16
FIND_BITS = 18  # first bits of a hash by which head words are looked up
STEPS = 24
FINE = 64
BATCH = 4096
END, ESCAPE = 0, 1
HEADS, LOGS, TAIL, STATS = 0, 1, 2, 3
LETTER_MARK = -1  # among the counts of pairs: counts of letters, 0 being the end of a word
PARTS = ("a", "b", "c", "d", "e", "f", "g")

_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def held_out(id_col: Column) -> Column:
    """Whether crc32 of the id as text is 1 modulo 5; false for a null id."""
    return F.coalesce(F.crc32(F.encode(id_col.cast("string"), "UTF-8")) % MODULUS == HELD_OUT, F.lit(False))


def huffman(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes as (first, node, bit): symbol s has the entries first[s]:first[s+1], from the root down."""
    n = len(counts)
    heap = [(int(c), i) for i, c in enumerate(counts)]
    heapq.heapify(heap)
    parent, side = np.zeros(2 * n, np.int64), np.zeros(2 * n, np.int64)
    node = n
    while len(heap) > 1:
        (a, i), (b, j) = heapq.heappop(heap), heapq.heappop(heap)
        parent[i] = parent[j] = node
        side[j] = 1
        heapq.heappush(heap, (a + b, node))
        node += 1
    root, first, nodes, bits = node - 1, [0], [], []
    for s in range(n):
        path = []
        while s != root:
            path.append((parent[s] - n, side[s]))
            s = parent[s]
        nodes += [p for p, _ in reversed(path)]
        bits += [b for _, b in reversed(path)]
        first.append(len(nodes))
    return np.array(first), np.array(nodes, np.int64), np.array(bits, np.int64)


def squeeze(x: np.ndarray) -> bytes:
    """An array as zstd bytes after its size: most are small numbers."""
    raw = np.ascontiguousarray(x).tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def expand(raw: bytes, dtype) -> np.ndarray:
    size = int.from_bytes(raw[:8], "little")
    return np.frombuffer(pa.decompress(raw[8:], size, "zstd", asbytes=True), dtype) if size else np.zeros(0, dtype)


class Tree:
    """The Huffman code of some symbols."""

    def __init__(self, counts: np.ndarray):
        self.first, self.node, self.bit = huffman(counts)
        self.size = np.diff(self.first)
        depth = np.arange(len(self.bit)) - np.repeat(self.first[:-1], self.size)
        self.step = (depth << 17 | self.node << 1 | self.bit).astype(np.int32)  # one look-up for all three

    def expand(self, sym: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(token, node, bit, depth) of every code bit."""
        size = self.size[sym]
        token = np.repeat(np.arange(len(sym)), size)
        at = np.arange(len(token))
        at += (self.first[sym] - (np.cumsum(size) - size)).take(token)
        step = self.step.take(at).astype(np.int64)
        return token, step >> 1 & 0xFFFF, step & 1, step >> 17


class Code(Tree):
    """Head words and their bit codes."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, escapes: int, ends: int):
        order = np.argsort(words)
        self.words = words[order]
        # where the words begin that share their first bits, and a word after the last
        self.start = np.searchsorted(self.words, np.arange(1 << FIND_BITS, dtype=np.uint64) << np.uint64(64 - FIND_BITS))
        self.padded = np.append(self.words, ~np.uint64(0))
        super().__init__(np.concatenate([[max(ends, 1), max(escapes, 1)], counts[order]]) + 1)
        self.nodes = len(self.words) + 2
        # code words from the left of 64 bits, and their order
        symbol = np.repeat(np.arange(len(self.size)), self.size)
        place = np.arange(len(self.bit)) - self.first[symbol]
        self.left = np.zeros(len(self.size), np.uint64)
        np.bitwise_or.at(self.left, symbol, self.bit.astype(np.uint64) << (np.uint64(63) - place.astype(np.uint64)))
        self.rank = np.argsort(np.argsort(self.left)).astype(np.uint64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The symbol of each hash, as a binary search would find it: most stand where their first bits begin."""
        at = self.start.take((h >> np.uint64(64 - FIND_BITS)).view(np.int64))
        word = self.padded.take(at)
        behind = np.flatnonzero(word < h)
        while len(behind):
            at[behind] += 1
            word[behind] = self.padded[at[behind]]
            behind = behind[word[behind] < h[behind]]
        return np.where((word == h) & (at < len(self.words)), at + 2, ESCAPE)

    def symbols(self, w: K.Words, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(symbol, row, first) of all tokens of a slice, ends included."""
        n = np.diff(w.first)
        row = np.repeat(np.arange(rows), n + 1)
        first = np.concatenate([[0], np.cumsum(n + 1)])
        sym = np.full(len(row), END, np.int64)
        body = np.ones(len(row), bool)
        body[first[1:] - 1] = False
        sym[body] = self.find(w.hash)
        return sym, row, first


def slots(context: np.ndarray, token: np.ndarray, node: np.ndarray, bits: int) -> np.ndarray:
    h = node.astype(np.uint64)
    h *= _M3
    h += context.take(token)
    h ^= h >> np.uint64(31)
    h *= _M2
    h >>= np.uint64(64 - bits)
    return h.view(np.int64)


class Tables:
    """One task's counts of zeros and ones by slot, one table per predictor; 32 bits hold a task's tokens, not the corpus's."""

    def __init__(self, sizes: list[int]):
        self.counts = [np.zeros(2 * n, np.uint32) for n in sizes]

    def add(self, i: int, slot: np.ndarray, bit: np.ndarray) -> None:
        np.add.at(self.counts[i], 2 * slot + bit, np.uint32(1))

    def rows(self):
        """(block number, compressed counts) of all non-empty blocks."""
        number = 0
        for c in self.counts:
            for lo in range(0, len(c), BLOCK):
                part = c[lo : lo + BLOCK]
                if part.any():
                    yield number, squeeze(part)
                number += 1


def sum_tables(parts: DataFrame, sizes: list[int]) -> tuple[list[np.ndarray], np.ndarray | None]:
    """Adds up blocks, in 64 bits, in the tasks they meet in; the sums, of fixed size, come to the driver.

    Block -1 holds real numbers (what mixers have learned), which are added as such.
    """

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for number, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                part = expand(raw.as_py(), np.uint32 if number >= 0 else np.float64)
                total[number] = total[number] + part if number in total else part.astype(np.uint64 if number >= 0 else np.float64)
        for number, part in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([squeeze(part)], pa.binary())], names=["block", "counts"])

    out = [np.zeros(2 * n, np.uint32) for n in sizes]  # 64 bits only where a sum needs them, for the driver's memory
    where = [(i, lo) for i, c in enumerate(out) for lo in range(0, len(c), BLOCK)]
    width, learned = max(shuffle_width(parts.sparkSession), len(where) // 8), None
    for r in parts.repartition(width, "block").mapInArrow(add, "block int, counts binary").collect():
        if r["block"] < 0:
            learned = expand(bytes(r["counts"]), np.float64)
            continue
        i, lo = where[r["block"]]
        part = expand(bytes(r["counts"]), np.uint64)
        if part.max() >> np.uint64(32):
            out[i] = out[i].astype(np.uint64)
        out[i][lo : lo + len(part)] = part
    return out, learned


def packed(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Pairs of counts as 16 bits: zeros * 256 + ones, scaled down to 255 where larger."""
    out = (zeros * 256 + ones).astype(np.uint16)
    top = np.maximum(zeros, ones)
    large = np.flatnonzero(top > 255)
    if len(large):
        scale = 255 / top[large]
        # the product may lie a rounding above 255, and 256 would not fit
        zeros, ones = (np.minimum(np.ceil(x[large] * scale), 255).astype(np.uint16) for x in (zeros, ones))
        out[large] = zeros * np.uint16(256) + ones
    return out


def pack(counts: np.ndarray) -> np.ndarray:
    """A table of counts, packed piece by piece for the driver's memory."""
    out = np.empty(len(counts) // 2, np.uint16)
    for lo in range(0, len(out), BLOCK):
        x = counts[2 * lo : 2 * lo + 2 * BLOCK].reshape(-1, 2)
        out[lo : lo + BLOCK] = x[:, 0] * x.dtype.type(256) + x[:, 1]
        large = np.flatnonzero(np.maximum(x[:, 0], x[:, 1]) > 255)
        if len(large):
            out[lo + large] = packed(*x[large].astype(np.int64).T)
    return out


def _evidence_of_states() -> np.ndarray:
    zeros, ones = np.divmod(np.arange(1 << 16), 256)
    n = zeros + ones
    p = (ones + 0.05) / (n + 0.1)
    stretch = np.clip(np.round(np.log(p / (1 - p)) * 14) + 128, 0, 255)
    sure = np.searchsorted([1, 2, 3, 5, 9, 17, 65], n, "right")
    return (sure * 256 + stretch).astype(np.uint16)


#: Packed counts as 16 bits: confidence (0..CONFIDENCE-1) and stretched probability (0..255, 128 even).
EVIDENCE = _evidence_of_states()
SUREST = 1 / (1 + np.exp([12.0, -12.0]))  # the least and the most the adaptive map gives


def stretch_of(evidence: np.ndarray) -> np.ndarray:
    return ((evidence & 255).view(np.int16) - np.int16(128)).astype(np.float32) / np.float32(14)


def _left_out() -> np.ndarray:
    """Evidence of packed counts less a bit: of 0 in the first half, of 1 in the second; scaled counts stay."""
    state = np.arange(1 << 16)
    mine = np.concatenate([state >> 8, state & 255])
    step = np.repeat([256, 1], 1 << 16)
    return EVIDENCE[np.tile(state, 2) - np.where((mine > 0) & (mine < 255), step, 0)]


LEFT_OUT = _left_out()


class Mixer:
    """Gated weights and the adaptive map after them."""

    def __init__(self, inputs: int):
        """Starts from the mean of the predictors."""
        self.weights = np.full((inputs, GATES, CONFIDENCE), 1.0 / inputs)
        self.bias = np.zeros(GATES)
        self.power, self.bias_power = np.full(self.weights.shape, 1e-6), np.full(GATES, 1e-6)
        self.map = np.tile(np.linspace(-8, 8, STEPS + 1), (GATES, 1))
        self.seen = np.ones((GATES, STEPS + 1))

    def learned(self) -> np.ndarray:
        """Weights, biases and map in proportion to what they have seen, so that several mixers' can be added."""
        n = float(self.seen.sum())
        return np.concatenate([[n], n * self.weights.reshape(-1), n * self.bias, self.seen.reshape(-1), (self.seen * self.map).reshape(-1)])

    def settle(self, total: np.ndarray) -> None:
        """Takes over the mean of several mixers."""
        at = np.cumsum([1, self.weights.size, self.bias.size, self.map.size])
        self.weights = (total[1 : at[1]] / total[0]).reshape(self.weights.shape)
        self.bias = total[at[1] : at[2]] / total[0]
        self.map = (total[at[3] : at[3] + self.map.size] / total[at[2] : at[3]]).reshape(self.map.shape)

    def luts(self) -> np.ndarray:
        """Weighted input by predictor, gate and evidence."""
        stretch = (np.arange(256) - 128) / 14.0
        return (self.weights[..., None] * stretch).reshape(len(self.weights), -1).astype(np.float32)

    def predict(self, inputs: list[np.ndarray], gate: np.ndarray, luts: np.ndarray | None = None):
        luts = self.luts() if luts is None else luts
        flat = gate * (CONFIDENCE * 256)
        z = self.bias.astype(np.float32).take(gate)
        for i, e in enumerate(inputs):
            z += luts[i].take(flat + e)
        return np.clip(z, -7.99, 7.99)

    def costs(self) -> np.ndarray:
        """log10 probability of a bit by gate, mixed logit (in steps of 1 / FINE) and bit."""
        z = np.tile((np.arange(16 * FINE) + 0.5) / FINE - 8, GATES)
        z = self.refine(z, np.repeat(np.arange(GATES), 16 * FINE))
        one = -np.log1p(np.exp(-z))
        return (np.stack([one - z, one], 1) / np.log(10)).reshape(-1).astype(np.float32)

    def refine(self, z: np.ndarray, gate: np.ndarray) -> np.ndarray:
        """Logit after the adaptive map: half the mixer, half the map."""
        at = (z + 8) * (STEPS / 16)
        lo = at.astype(np.int64)
        part = at - lo
        flat = self.map.astype(np.float32).reshape(-1)
        lo += gate * (STEPS + 1)
        return (z + flat[lo] * (1 - part) + flat[lo + 1] * part) / 2

    def log_of(self, inputs: list[np.ndarray], gate: np.ndarray, bit: np.ndarray, luts: np.ndarray, costs: np.ndarray) -> np.ndarray:
        """log10 probability of each bit."""
        out = np.empty(len(bit), np.float32)
        for lo in range(0, len(bit), 4 * BATCH):
            part = slice(lo, lo + 4 * BATCH)
            g = gate[part]
            z = self.predict([e[part] for e in inputs], g, luts)
            place = ((z + np.float32(8)) * np.float32(FINE)).astype(np.int64) + g * (16 * FINE)
            out[part] = costs.take(2 * place + bit[part])
        return out

    def learn(self, inputs: list[np.ndarray], gate: np.ndarray, bit: np.ndarray, times: np.ndarray, rate: float = 0.04, batch: int = BATCH) -> None:
        """One pass in order: predict a batch, then move the weights and the map towards it; a bit counts ``times`` times."""
        times, many = times.astype(np.float32), len(inputs)
        own = (np.arange(many) * (GATES * CONFIDENCE))[:, None]  # the weights of all inputs in one row
        p = 1 / (1 + np.exp(-self.map))
        for lo in range(0, len(bit), batch):
            part = slice(lo, lo + batch)
            g, b, n = gate[part], bit[part], times[part]
            e = np.stack([x[part] for x in inputs])
            key, x = own + g * CONFIDENCE + (e >> 8), stretch_of(e)
            z = self.bias.astype(np.float32).take(g)
            for each in self.weights.astype(np.float32).take(key) * x:
                z += each
            z = np.clip(z, np.float32(-7.99), np.float32(7.99))
            error = (b.astype(np.float32) - 1 / (1 + np.exp(-z))) * n
            total = n.sum()
            step = np.bincount(g, error, minlength=GATES) / total
            self.bias_power += step * step
            self.bias += rate * step / np.sqrt(self.bias_power)
            x *= error
            step = np.bincount(key.reshape(-1), x.reshape(-1), minlength=self.weights.size).reshape(self.weights.shape) / total
            self.power += step * step
            self.weights += rate * step / np.sqrt(self.power)
            # the adaptive map moves towards what was coded, less and less
            place = g * (STEPS + 1) + ((z + np.float32(8)) * np.float32(STEPS / 16) + np.float32(0.5)).astype(np.int64)
            coded = np.bincount(2 * place + b, n, minlength=2 * self.map.size).reshape(*self.map.shape, 2)
            ones, met = coded[..., 1], coded[..., 0] + coded[..., 1]
            p += met / (self.seen + met + 64) * (ones / np.maximum(met, 1) - p)
            p = np.clip(p, *SUREST)
            self.seen += met
        self.map = np.log(p / (1 - p)).clip(-12, 12)


def token_ids(w: K.Words, sym: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The one and two tokens before each token: 0 before the text, a head word's symbol, or 2**32 and 32 bits of a hash."""
    value = sym.astype(np.uint64)
    body = np.ones(len(sym), bool)
    body[first[1:] - 1] = False
    tail = sym == ESCAPE
    value[tail] = (w.hash[tail[body]] >> np.uint64(32)) | np.uint64(1 << 32)
    one, two = np.zeros(len(sym), np.uint64), np.zeros(len(sym), np.uint64)
    one[1:] = value[:-1]
    two[2:] = value[:-2]
    start = first[:-1]
    one[start] = two[start] = 0
    two[start[np.diff(first) > 1] + 1] = 0
    return one, two


def contexts(one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return K.mix(one * _M1), K.mix(one * _M1 + K.mix(two + np.uint64(1)) * _M2)


def is_in(values: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Whether each value is in a sorted array."""
    if not len(found):
        return np.zeros(len(values), bool)
    return found[np.minimum(np.searchsorted(found, values), len(found) - 1)] == values


def pack_ids(ids: np.ndarray) -> tuple[bytes, bytes]:
    """Tokens as 16-bit symbols, with the hashes of those outside the head."""
    tail = ids >> np.uint64(32) > 0
    return squeeze(np.where(tail, ESCAPE, ids).astype(np.uint16)), squeeze((ids[tail] & np.uint64(0xFFFFFFFF)).astype(np.uint32))


def unpack_ids(symbols: bytes, hashes: bytes) -> np.ndarray:
    out = expand(symbols, np.uint16).astype(np.uint64)
    out[out == ESCAPE] = expand(hashes, np.uint32).astype(np.uint64) | np.uint64(1 << 32)
    return out


class Shared:
    """What all tasks know: the codes of words and letters, the hot contexts and their tables, the letter tables."""

    def __init__(self, code: Code, letter_code: Tree, hot_words: np.ndarray, hot_pairs: np.ndarray, buckets: int):
        self.letter_code = letter_code
        self.code, self.hot_words, self.hot_pairs, self.buckets = code, hot_words, hot_pairs, buckets
        self.tables: list[np.ndarray] = []  # packed counts: no word, hot words, hot pairs
        self.letters: list[np.ndarray] = []  # evidence by letters

    def level(self, one: np.ndarray, pair: np.ndarray) -> np.ndarray:
        """0, 1 where the word before is hot, 2 where both words before are."""
        hot = is_in(one, self.hot_words)
        return hot.astype(np.int8) + (hot & is_in(pair, self.hot_pairs))

    def bucket_of(self, level: np.ndarray, single: np.ndarray, pair: np.ndarray) -> np.ndarray:
        """Tokens meet by the word before, under hot words by both; those under hot pairs (-1) stay where they are."""
        bucket = (np.where(level == 0, single, pair) >> np.uint64(20)) % np.uint64(self.buckets)
        return np.where(level == 2, -1, bucket.astype(np.int64))


def node_states(code: Code, context: np.ndarray, sym: np.ndarray, times: np.ndarray, expanded: tuple | None = None) -> np.ndarray:
    """Packed counts of every code bit under its context and node, for distinct (context, symbol) in the order of contexts and codes.

    Symbols that share a node are neighbours in that order, so the counts of a depth are sums of runs.
    ``expanded`` may pass in the symbols' (token, bit): bits no neighbour shares, most under two words, are then filled in at once.
    """
    size, word = code.size[sym].astype(np.int8), code.left[sym]
    at = np.cumsum(size, dtype=np.int64) - size  # where the bit of this depth stands
    common = np.full(len(sym), -1, np.int8)  # bits shared with the entry before
    same = np.flatnonzero(context[1:] == context[:-1]) + 1
    common[same] = 53 - np.frexp(((word[same] ^ word[same - 1]) >> np.uint64(11)).astype(np.float64))[1]
    if expanded is None:
        out = np.zeros(int(size.sum(dtype=np.int64)), np.uint16)
    else:
        own = np.minimum(times, 255).astype(np.uint16)
        out = np.stack([own * np.uint16(256), own], 1).reshape(-1).take(2 * expanded[0] + expanded[1])
        size = np.maximum(common, np.append(common[1:], np.int8(-1))) + np.int8(1)
    depth, least, word, times = 0, size.min() if len(size) else 0, word.view(np.int64), times.astype(np.float64)
    while True:
        if depth >= least:  # an entry that ends shares no more with others, so runs stay as they are
            go_on = np.flatnonzero(size > depth)
            size, word, at, times, common = (x.take(go_on) for x in (size, word, at, times, common))
        if not len(at):
            return out
        run = np.cumsum(common < depth)  # from 1
        both = np.bincount(2 * run + (word >> (63 - depth) & 1), times, minlength=2 * int(run[-1]) + 2).astype(np.int64)
        out[at] = packed(both[::2], both[1::2]).take(run)
        depth += 1
        at += 1


def order_of(keys: np.ndarray, low: int = 0) -> np.ndarray:
    """The order of keys whose upper bits are a hash: first bits of the hash, the ``low`` last bits and the place are sorted as one number.

    Keys whose hashes differ only in the bits left out are rare; where there are any, the keys are sorted as they are.
    """
    n = len(keys).bit_length()
    cut, place = np.uint64(low + n), np.uint64(n)
    both = keys >> cut << cut | np.arange(len(keys), dtype=np.uint64)
    if low:
        both |= (keys & np.uint64((1 << low) - 1)) << place
    both.sort()
    order = (both & np.uint64((1 << n) - 1)).view(np.int64)
    found = keys.take(order)
    return np.argsort(keys, kind="stable") if (found[1:] < found[:-1]).any() else order


def distinct(keys: np.ndarray, low: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """(first places of the distinct keys in their order, number of each key), as np.unique has them."""
    order = order_of(keys, low)
    found = keys.take(order)
    new = np.ones(len(keys), bool)
    new[1:] = found[1:] != found[:-1]
    number = np.empty(len(keys), np.int64)
    number[order] = np.cumsum(new) - 1
    return order[new], number


def whole_runs(keys: np.ndarray, size: int) -> list[int]:
    """Where to cut sorted keys so that a part has at least ``size`` of them and no key is in two; the first is 0, the last all."""
    starts, cuts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])), [0]
    while cuts[-1] < len(keys):
        at = np.searchsorted(starts, cuts[-1] + size)
        cuts.append(int(starts[at]) if at < len(starts) else len(keys))
    return cuts


def mix_tokens(shared: Shared, mixer: Mixer, one: np.ndarray, two: np.ndarray, sym: np.ndarray, training: np.ndarray) -> np.ndarray:
    """log10 probability of each token of a bucket, none under a hot pair; the mixer learns on the way.

    Chunks are cut by training tokens alone, so other tokens change nothing of what is learned, nor when.
    """
    single, pair = contexts(one, two)
    level = shared.level(one, pair)
    group = np.where(level == 0, single, pair)  # contexts whose counts are made here stay together
    order = order_of(group)
    group, learns = group[order], training[order] > 0
    mine = group[learns]
    edges = mine[whole_runs(mine, TOKENS)[1:-1]]
    cuts = [0, *np.searchsorted(group, edges).tolist(), len(group)]
    log = np.zeros(len(sym))

    def chunk(use: np.ndarray, rounds: int) -> np.ndarray:
        return _mix_chunk(shared, mixer, single[use], pair[use], sym[use], training[use], level[use], rounds)

    for number, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
        rounds, use = 1 if number else 2, order[lo:hi]
        if hi - lo > MANY * TOKENS:  # mostly tokens that are not learned from: these are scored in pieces
            if learns[lo:hi].any():
                chunk(use[learns[lo:hi]], rounds)
            pieces = whole_runs(group[lo:hi], TOKENS)
            for a, b in zip(pieces, pieces[1:]):
                log[use[a:b]] = chunk(use[a:b], 0)
        elif hi > lo:
            log[use] = chunk(use, rounds)
    return log


def _mix_chunk(shared: Shared, mixer: Mixer, single, pair, sym, training, level, rounds: int) -> np.ndarray:
    """Counts, learns from, and scores tokens of which all with the same context are here."""
    code, low = shared.code, np.uint64(0xFFFF)
    at, entry = distinct((pair & ~low) | code.rank[sym])
    times = np.bincount(entry, training, minlength=len(at))
    single, pair, sym, level = single[at], pair[at], sym[at], level[at]
    token, node, bit, depth = code.expand(sym)
    at, of = distinct((single & ~low) | code.rank[sym])
    by_word = node_states(code, single[at] & ~low, sym[at], np.bincount(of, times, minlength=len(at)))
    first = np.cumsum(code.size[sym[at]]) - code.size[sym[at]]
    states = [shared.tables[0].take(node), by_word.take(first[of].take(token) + depth), node_states(code, pair & ~low, sym, times, (token, bit))]
    if level.any():
        hot = np.flatnonzero(level[token] == 1)
        states[1][hot] = shared.tables[1][slots(single, token[hot], node[hot], HOT_BITS[0])]
    known = slice(None) if times.all() else np.flatnonzero((times > 0)[token])
    if rounds and times.any():
        n, side = times[token[known]], bit[known] << 16
        inputs = [LEFT_OUT.take(s[known] + side) for s in states]
        gate = gate_of(inputs[-1], depth[known])
        for _ in range(rounds):
            mixer.learn(inputs, gate, bit[known], n)
    log = mixer.log_of(*gated(states, depth), bit, mixer.luts(), mixer.costs())
    return np.bincount(token, log, minlength=len(sym))[entry]


def gated(states: list[np.ndarray], depth: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Evidence of packed counts, and the gate: how often both words were seen, and whether the code has run for some bits."""
    inputs = [EVIDENCE.take(s) for s in states]
    return inputs, gate_of(inputs[-1], depth)


def gate_of(evidence: np.ndarray, depth: np.ndarray) -> np.ndarray:
    return (evidence >> 8).astype(np.int64) * 2 + (depth >= 4)


def score_hot_pairs(shared: Shared, mixer: Mixer, luts, costs, single, pair, sym) -> np.ndarray:
    """log10 probability of tokens under hot pairs, by the broadcast tables."""
    log = np.zeros(len(sym))
    for lo in range(0, len(sym), TOKENS):
        some = slice(lo, lo + TOKENS)
        token, node, bit, depth = shared.code.expand(sym[some])
        states = [shared.tables[0][node], *(t[slots(c[some], token, node, b)] for t, c, b in zip(shared.tables[1:], (single, pair), HOT_BITS))]
        log[some] = np.bincount(token, mixer.log_of(*gated(states, depth), bit, luts, costs), minlength=len(sym[some]))
    return log


def letter_contexts(data: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """(bytes with a 0 after each word, hashes of letters before, place in the word)."""
    n = np.diff(first)
    ends = np.cumsum(n + 1) - 1
    out = np.zeros(len(data) + len(n), np.uint8)
    body = np.ones(len(out), bool)
    body[ends] = False
    out[body] = data
    start = np.repeat(np.concatenate([[0], ends[:-1] + 1]) if len(ends) else np.zeros(0, np.int64), n + 1)
    place = np.arange(len(out)) - start
    hashes, h = [], np.zeros(len(out), np.uint64)
    for j in range(1, max(LETTER_ORDERS) + 1):
        before = np.zeros(len(out), np.uint64)
        before[j:] = out[:-j] if j else out
        before[place < j] = 256
        h = h * _M1 + before + np.uint64(1)
        if j in LETTER_ORDERS:
            hashes.append(K.mix(h))
    return out, hashes, place


def letter_bits(code: Tree, data: np.ndarray, first: np.ndarray):
    """(word, slots by order, bit, gate) of the code bits of every letter and word end, some letters at a time."""
    out, hashes, _ = letter_contexts(data, first)
    words = np.repeat(np.arange(len(first) - 1), np.diff(first) + 1)
    for lo in range(0, len(out), LETTERS):
        some = slice(lo, lo + LETTERS)
        at, node, bit, depth = code.expand(out[some].astype(np.int64))
        yield words[some][at], [slots(h[some], at, node, LETTER_BITS) for h in hashes], bit, np.minimum(depth, GATES - 1)


def gather_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the spans, concatenated, and their offsets."""
    size = end - start
    first = np.concatenate([[0], np.cumsum(size)])
    at = np.arange(first[-1]) + np.repeat(start - first[:-1], size)
    return data[at], first


def new_words(w: K.Words, sym: np.ndarray, first: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Places of the words of a slice that are neither in the head nor in ``seen`` (sorted), each word once, in the order of hashes."""
    at = np.flatnonzero(np.delete(sym, first[1:] - 1) == ESCAPE)
    at = at[~is_in(w.hash[at], seen)]
    return at[np.unique(w.hash[at], return_index=True)[1]]


def bucket_count(n_bytes: int) -> int:
    """Buckets by the bytes of training text alone: what is learned doesn't change with the cluster.

    A bucket has 6 MB, beyond 256 buckets up to 32 MB.
    """
    return max(BUCKETS[0], min(-(-n_bytes // BUCKET_BYTES), BUCKETS[1]), -(-n_bytes // MOST_BYTES))


def new_share(once: int, tokens: int) -> float:
    """The share of new words among tokens outside the head: of those seen once, half a token added to either side."""
    return (once + 0.5) / (tokens + 1)


def hot_pairs_of(w: K.Words, first: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word before, word before that, count) of pairs before at least ``least`` tokens of a slice; 0 before the text."""
    n = int(first[-1])
    value = np.zeros(n, np.uint64)
    body = np.ones(n, bool)
    body[first[1:] - 1] = False
    value[body] = w.hash
    one, two = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    one[1:], two[2:] = value[:-1], value[:-2]
    start = first[:-1]
    one[start] = two[start] = 0
    two[start[np.diff(first) > 1] + 1] = 0
    h = K.mix(one * _M1 + two * _M2)
    often = np.flatnonzero(np.bincount((h >> np.uint64(48)).astype(np.int64), minlength=1 << 16)[(h >> np.uint64(48)).astype(np.int64)] >= least)
    _, at, count = np.unique(h[often], return_index=True, return_counts=True)
    at = often[at[count >= least]]
    return one[at], two[at], count[count >= least]


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    Null and empty texts are one end token.  A document with a null id is scored and is
    training material.  Rows with the same id are scored one by one.  Training documents
    are scored with themselves among the training counts, as in the base score.  An empty
    table gives an empty table; other columns are ignored.  ``docs`` should be read from a table, so
    that a task that runs again sees the same rows.
    """
    spark = docs.sparkSession
    workers_find_package(spark)
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(text_col).alias("text"), F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"))
    train = rows.filter(~F.col("held_out"))
    n_train, n_bytes = train.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    buckets = bucket_count(n_bytes)

    # all training words counted (the head are the frequent ones), and the pairs of words many tokens follow
    def count_words():
        held = [np.zeros(0, np.uint64), np.zeros(0, np.int64)]
        letters = np.zeros(256, np.int64)

        def add(h, n):
            both = np.concatenate([held[0], h])
            first, at = distinct(both, 0)
            held[:] = [both[first], np.bincount(at, np.concatenate([held[1], n]), minlength=len(first)).astype(np.int64)]

        def flush():
            out = {"hash": held[0].view(np.int64), "before": pa.nulls(len(held[0]), pa.int64()), "n": held[1]}
            held[:] = [np.zeros(0, np.uint64), np.zeros(0, np.int64)]
            return out

        def each(s, rest):
            data = K.LOWER[s.data]
            w = K.words(data, s.offsets, lower=False)
            letters[:] += np.bincount(data, minlength=256)
            letters[0] += len(w.hash)
            first = np.concatenate([[0], np.cumsum(np.diff(w.first) + 1)])
            add(*np.unique(w.hash, return_counts=True))
            one, two, n = hot_pairs_of(w, first, max(2, int(first[-1]) // (HOT_SHARE * buckets)))
            words = flush() if len(held[0]) >= DISTINCT else None
            pairs = {"hash": one.view(np.int64), "before": pa.array(two.view(np.int64)), "n": n}
            if words is None:
                return pairs if len(n) else None
            as_array = lambda x: x if isinstance(x, pa.Array) else pa.array(x, pa.int64())
            return {k: pa.concat_arrays([as_array(words[k]), as_array(pairs[k])]) for k in words}

        def last():
            words = flush()
            both = {"hash": (words["hash"], np.arange(256)), "before": (words["before"], np.full(256, LETTER_MARK)), "n": (words["n"], letters)}
            return {k: pa.concat_arrays([x if isinstance(x, pa.Array) else pa.array(x, pa.int64()) for x in v]) for k, v in both.items()}

        return each, last

    counted = map_text(train.select("text"), "hash long, before long, n long", count_words).groupBy("hash", "before").agg(F.sum("n").alias("n"))
    counted = materialise(counted, "lm-counts")
    words_of = counted.filter("before is null")
    head = words_of.filter(F.col("n") >= MIN_HEAD_COUNT).orderBy(F.desc("n"), "hash").limit(HEAD).select("hash", "n").toPandas()
    everything, once, n_words = words_of.agg(
        F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum((F.col("n") == 1).cast("long")), F.lit(0)), F.count(F.lit(1))
    ).first()
    words, counts = head["hash"].to_numpy(np.int64).view(np.uint64), head["n"].to_numpy(np.int64)
    tail_total = everything - int(counts.sum())
    train_tokens = everything + n_train
    novel = new_share(once, tail_total)
    vocabulary = n_words + (n_train > 0)
    code = Code(words, counts, tail_total, n_train)
    by_hash = np.argsort(words)
    symbol_counts = np.concatenate([[n_train, 0], counts[by_hash]]).astype(np.int64)

    # hot contexts: few, as each has more than a share of all tokens
    least = max(2, train_tokens // (HOT_SHARE * buckets))
    hot_words = np.concatenate([[0], np.flatnonzero(symbol_counts[2:] >= least) + 2]).astype(np.uint64)
    pairs = counted.filter((F.col("before") != LETTER_MARK) & (F.col("n") >= least)).select("hash", "before").toPandas()
    letters = np.zeros(256, np.int64)
    for r in counted.filter(F.col("before") == LETTER_MARK).collect():
        letters[r["hash"]] = r["n"]
    letters[[0x20, *range(0x09, 0x0E)]] = 0  # never inside a word

    def ids_of(column: str) -> np.ndarray:
        h = pairs[column].to_numpy(np.int64).view(np.uint64)
        at = np.minimum(np.searchsorted(code.words, h), max(len(code.words) - 1, 0))
        inside = code.words[at] == h if len(code.words) else np.zeros(len(h), bool)
        return np.where(h == 0, 0, np.where(inside, at.astype(np.uint64) + np.uint64(2), (h >> np.uint64(32)) | np.uint64(1 << 32))).astype(np.uint64)

    model = Shared(code, Tree(letters + 1), hot_words, np.sort(contexts(ids_of("hash"), ids_of("before"))[1]), buckets)
    _, node, bit, _ = code.expand(np.arange(len(symbol_counts)))
    each_code = np.repeat(np.concatenate([[n_train, tail_total], symbol_counts[2:]]), np.diff(code.first))
    order_zero = np.bincount(2 * node + bit, each_code, minlength=2 * code.nodes).astype(np.int64)
    model.tables = [pack(order_zero)]
    first_model = spark.sparkContext.broadcast(model)
    sizes = [*(1 << b for b in HOT_BITS), *[1 << LETTER_BITS] * len(LETTER_ORDERS)]

    # counts under hot contexts, and of letters, over all training documents
    def count_bits():
        model, tables, letter_mixer, pair_mixer = first_model.value, Tables(sizes), Mixer(len(LETTER_ORDERS)), Mixer(1 + len(HOT_BITS))
        seen, so_far, slices = [np.zeros(0, np.uint64)], [], [0, 0]

        def each(s, rest):
            data = K.LOWER[s.data]
            w = K.words(data, s.offsets, lower=False)
            sym, _, first = model.code.symbols(w, s.hi - s.lo)
            one, two = token_ids(w, sym, first)
            if slices[0] >= slices[1]:  # now and then: packing takes all slots
                so_far[:], slices[1] = [pack(t) for t in tables.counts], slices[0] * 3 // 2 + 1
                so_far[len(HOT_BITS) :] = [EVIDENCE.take(t) for t in so_far[len(HOT_BITS) :]]
            slices[0] += 1
            hot = np.flatnonzero(is_in(one, model.hot_words))
            for lo in range(0, len(hot), TOKENS):
                some = hot[lo : lo + TOKENS]
                single, pair = contexts(one[some], two[some])
                use = is_in(pair, model.hot_pairs)
                if use.any():  # coded by the slices before
                    token, node, bit, depth = model.code.expand(sym[some][use])
                    states = [model.tables[0][node], *(t[slots(c[use], token, node, b)] for t, c, b in zip(so_far, (single, pair), HOT_BITS))]
                    pair_mixer.learn(*gated(states, depth), bit, np.ones(len(bit)))
                for i, (context, mine) in enumerate(((single, sym[some]), (pair[use], sym[some][use]))):
                    token, node, bit, _ = model.code.expand(mine)
                    tables.add(i, slots(context, token, node, HOT_BITS[i]), bit)
            # letters: each word that is not in the head, once a task; coded by the slices before
            at = new_words(w, sym, first, seen[0])
            seen[0] = np.sort(np.concatenate([seen[0], w.hash[at]]), kind="stable")  # two sorted runs; a task's input bounds them
            for lo in range(0, len(at), TOKENS):
                some = at[lo : lo + TOKENS]
                letters, spans = gather_spans(data, w.start[some], w.end[some])
                for _, found, lbit, gate in letter_bits(model.letter_code, letters, spans):
                    inputs = [t.take(slot) for t, slot in zip(so_far[len(HOT_BITS) :], found)]
                    letter_mixer.learn(inputs, gate, lbit, np.ones(len(lbit), np.float32), batch=4 * BATCH)
                    for i, slot in enumerate(found):
                        tables.add(len(HOT_BITS) + i, slot, lbit)

        def last():
            parts = [*tables.rows(), (-1, squeeze(np.concatenate([letter_mixer.learned(), pair_mixer.learned()])))]
            return {"block": [p[0] for p in parts], "counts": [p[1] for p in parts]}

        return each, last

    tables, learned = sum_tables(map_text(train.select("text"), "block int, counts binary", count_bits), sizes)
    letter_mixer, pair_mixer = Mixer(len(LETTER_ORDERS)), Mixer(1 + len(HOT_BITS))
    if learned is not None:
        letter_mixer.settle(learned)
        pair_mixer.settle(learned[len(letter_mixer.learned()) :])
    packed = []
    while tables:
        packed.append(pack(tables.pop(0)))
    model.tables, model.letters = [*model.tables, *packed[: len(HOT_BITS)]], [EVIDENCE.take(t) for t in packed[len(HOT_BITS) :]]
    whole = spark.sparkContext.broadcast((model, letter_mixer, pair_mixer))
    del packed, model

    # tokens go to the bucket of their context, other words besides to their own
    row_ddl = f"bucket int, tag long, kind int, {', '.join(f'{p} binary' for p in PARTS)}, ids array<{id_type}>"
    row_schema = arrow_schema(row_ddl)
    id_arrow = row_schema.field("ids").type.value_type

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        """Rows of (bucket, tag, kind, parts, ids)."""
        ids = [r[4] for r in rows]
        given = [i.cast(id_arrow) for i in ids if i is not None]
        offsets = np.cumsum([0] + [0 if i is None else len(i) for i in ids])
        values = pa.concat_arrays(given) if given else pa.nulls(0, id_arrow)
        arrays = [pa.array([r[k] for r in rows], row_schema.field(k).type) for k in range(3)]
        arrays += [pa.array([r[3][k] if k < len(r[3]) else None for r in rows], pa.binary()) for k in range(len(PARTS))]
        return pa.RecordBatch.from_arrays([*arrays, pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values).cast(row_schema.field("ids").type)], schema=row_schema)

    def deal(batches):
        model, _, mixer = whole.value
        luts, costs = mixer.luts(), mixer.costs()
        base_log = np.log10(symbol_counts + 0.5)
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for s in K.text_slices(batch.column(0), SLICE_BYTES, SLICE_ROWS):
                tag, number = number, number + 1
                n_rows = s.hi - s.lo
                data = K.LOWER[s.data]
                w = K.words(data, s.offsets, lower=False)
                sym, row, first = model.code.symbols(w, n_rows)
                training = ~np.asarray(batch.column(2).slice(s.lo, n_rows).to_numpy(zero_copy_only=False), bool)
                inside = sym != ESCAPE
                known = inside & (symbol_counts[sym] > 0)
                numbers = np.stack([np.diff(first), np.bincount(row[known], minlength=n_rows), np.diff(s.offsets)])
                base = np.bincount(row[inside], base_log[sym[inside]], minlength=n_rows)
                one, two = token_ids(w, sym, first)
                single, pair = contexts(one, two)
                level = model.level(one, pair)
                hot = np.flatnonzero(level == 2)
                hot_log = np.bincount(row[hot], score_hot_pairs(model, mixer, luts, costs, single[hot], pair[hot], sym[hot]), minlength=n_rows)
                heads = (squeeze(numbers), squeeze(base), squeeze(~training), squeeze(hot_log))
                out = [((tag * 40503 >> 12) % model.buckets, tag, HEADS, heads, batch.column(1).slice(s.lo, n_rows))]
                bucket = model.bucket_of(level, single, pair)
                order = np.argsort(bucket.astype(np.int16 if model.buckets < 1 << 15 else np.int64), kind="stable")[len(hot) :]
                one, two, sym16, row16 = one[order], two[order], sym[order].astype(np.uint16), row[order].astype(np.uint16)
                for b, part in by_part(bucket[order]):
                    parts = (squeeze(np.diff(row16[part], prepend=np.uint16(0))), squeeze(sym16[part]), squeeze(np.packbits(training[row16[part]])), *pack_ids(one[part]), *pack_ids(two[part]))
                    out.append((b, tag, LOGS, parts, None))
                yield batch_of(out + [(b, tag, TAIL, parts, None) for b, parts in tail_messages(w, data, np.delete(sym, first[1:] - 1), training, model.buckets)])

    def answer(batches):
        model, letter_mixer, _ = whole.value
        held: dict[tuple[int, int], list] = {}
        for batch in batches:
            cols = [batch.column(i).to_pylist() for i in range(3 + len(PARTS))]
            for i, (b, tag, kind) in enumerate(zip(*cols[:3])):
                if kind == HEADS:
                    yield batch.slice(i, 1)
                else:
                    held.setdefault((kind, b), []).append((tag, [c[i] for c in cols[3:]]))
        for kind, b in sorted(held):
            group = held.pop((kind, b))
            out = answer_tokens(group, model) if kind == LOGS else answer_words(group, model, letter_mixer, tail_total, novel)
            yield batch_of([(b, tag, k, parts, None) for tag, k, parts in out])

    out_ddl = f"doc_id {id_type}, held_out boolean, n_tokens long, n_known long, n_unknown long, n_bytes long, base_log double, log double, text_log double, spelled double"
    out_schema = arrow_schema(out_ddl)

    def gather(batches):
        """Adds up what the buckets say about the rows of each slice; rows come sorted by slice, heads first."""
        now, head, sums = None, None, None

        def done():
            (tokens, known, n_bytes), base, held, ids = head
            return K.table({
                "doc_id": ids, "held_out": held, "n_tokens": tokens, "n_known": known + np.round(sums[3]).astype(np.int64), "n_unknown": np.round(sums[4]).astype(np.int64),
                "n_bytes": n_bytes, "base_log": base + sums[0], "log": sums[1], "text_log": sums[2] + sums[1], "spelled": pa.nulls(len(base), pa.float64()),
            }, out_schema)

        for batch in batches:
            cols = [batch.column(i).to_pylist() for i in range(1, 3 + len(PARTS))]
            for i, (tag, kind) in enumerate(zip(*cols[:2])):
                parts = [c[i] for c in cols[2:]]
                if kind == STATS:
                    none = {f.name: pa.nulls(1, f.type) for f in out_schema}
                    yield K.table(none | {"spelled": expand(parts[0], np.float64)}, out_schema)
                    continue
                if kind == HEADS:
                    if head is not None:
                        yield done()
                    now, head = tag, (expand(parts[0], np.int64).reshape(3, -1), expand(parts[1], np.float64), expand(parts[2], bool), batch.column(3 + len(PARTS))[i].values)
                    sums = np.zeros((5, len(head[1])))
                    sums[1] = expand(parts[3], np.float64)
                    continue
                if tag != now:
                    raise RuntimeError("a slice of documents changed while it was scored; read docs from a table")
                rows = expand(parts[0], np.uint16)
                if kind == LOGS:
                    sums[1][rows] += expand(parts[1], np.float32)
                else:
                    for j, dtype in enumerate((np.float64, np.float32, np.float32, np.int32, np.int32)):
                        sums[j][rows] += expand(parts[1 + j], dtype)
        if head is not None:
            yield done()

    dealt = rows.mapInArrow(deal, row_ddl).repartitionById(buckets, F.col("bucket")).mapInArrow(answer, row_ddl)
    slices = dealt.repartition(shuffle_width(spark), "tag").sortWithinPartitions("tag", "kind")
    scored = materialise(slices.mapInArrow(gather, out_ddl), "lm-scores")
    spelled = scored.agg(F.coalesce(F.sum("spelled"), F.lit(0.0))).first()[0]
    # what the letter model gives to training words is not left for the class of unknown words
    unknown = float(np.log10(max(1 - spelled, 1e-9)))
    scale = float(np.log10(train_tokens + 0.5 * (vocabulary + 1)))
    return scored.filter("n_tokens is not null").select(
        "doc_id",
        "held_out",
        "n_tokens",
        "n_known",
        F.lit(train_tokens).cast("long").alias("train_tokens"),
        (F.col("base_log") - F.col("n_tokens") * F.lit(scale)).alias("base_score"),
        (F.col("log") + F.col("n_unknown") * F.lit(unknown)).alias("score"),
        (-F.col("text_log") / F.lit(float(np.log10(2))) / F.greatest(F.col("n_bytes"), F.lit(1))).alias("bits_per_byte"),
    )


def by_part(part: np.ndarray):
    """Slices of equal values of a sorted array."""
    cut = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(part)]]) if len(part) else np.zeros(1, np.int64)
    return [(int(part[a]), slice(int(a), int(b))) for a, b in zip(cut, cut[1:])]


def tail_messages(w: K.Words, data: np.ndarray, body: np.ndarray, training: np.ndarray, buckets: int):
    """(bucket, letters, sizes, rows a word, rows, times, training) of the words outside the head: each word once, with its rows."""
    at = np.flatnonzero(body == ESCAPE)
    bucket = ((w.hash[at] >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((w.hash[at], bucket))  # rows stay in order
    at, bucket = at[order], bucket[order]
    h, d = w.hash[at], w.doc[at]
    pair = np.ones(len(at), bool)
    pair[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    pair_at = np.flatnonzero(pair)
    times = np.diff(np.append(pair_at, len(at)))
    ph, pd_, pb = h[pair_at], d[pair_at], bucket[pair_at]
    new = np.ones(len(ph), bool)
    new[1:] = ph[1:] != ph[:-1]
    word_at = np.flatnonzero(new)
    used = np.diff(np.append(word_at, len(ph)))
    letters, spans = gather_spans(data, w.start[at[pair_at[word_at]]], w.end[at[pair_at[word_at]]])
    ends = np.append(word_at, len(ph))
    for b, s in by_part(pb[word_at]):
        p = slice(int(ends[s.start]), int(ends[s.stop]))
        yield b, (
            squeeze(letters[spans[s.start] : spans[s.stop]]), squeeze(np.diff(spans)[s].astype(np.int32)), squeeze(used[s].astype(np.int32)),
            squeeze(pd_[p].astype(np.uint16)), squeeze(times[p].astype(np.int32)), squeeze(training[pd_[p]]),
        )


def answer_tokens(group: list, model: Shared):
    """(tag, LOGS, rows and their logarithms) for the messages of a bucket."""
    rows = [np.cumsum(expand(m[0], np.uint16), dtype=np.uint16) for _, m in group]
    sizes = [len(r) for r in rows]
    sym = np.concatenate([expand(m[1], np.uint16) for _, m in group]).astype(np.int64)
    training = np.concatenate([np.unpackbits(expand(m[2], np.uint8), count=n) for n, (_, m) in zip(sizes, group)])
    one = np.concatenate([unpack_ids(m[3], m[4]) for _, m in group])
    two = np.concatenate([unpack_ids(m[5], m[6]) for _, m in group])
    log = mix_tokens(model, Mixer(3), one, two, sym, training)
    at = 0
    for (tag, _), row in zip(group, rows):
        start = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        yield tag, LOGS, (squeeze(row[start]), squeeze(np.add.reduceat(log[at : at + len(row)], start).astype(np.float32)))
        at += len(row)


def answer_words(group: list, model: Shared, mixer: Mixer, tail_total: int, novel: float):
    """(tag, TAIL, rows and sums) for the messages of a bucket, whose words are counted and spelled here."""
    luts, costs = mixer.luts(), mixer.costs()
    letters = np.concatenate([expand(m[0], np.uint8) for _, m in group])
    first = np.concatenate([[0], np.cumsum(np.concatenate([expand(m[1], np.int32) for _, m in group]), dtype=np.int64)])
    used = np.concatenate([expand(m[2], np.int32) for _, m in group])
    rows = [expand(m[3], np.uint16) for _, m in group]
    times = np.concatenate([expand(m[4], np.int32) for _, m in group]).astype(np.int64)
    training = np.concatenate([expand(m[5], bool) for _, m in group])
    # in pieces: the sums behind a hash are as long as the letters
    hashes = [np.zeros(0, np.uint64)]
    for lo in range(0, len(first) - 1, TOKENS):
        at = first[lo : lo + TOKENS + 1]
        hashes.append(K.span_hash(letters[at[0] : at[-1]], at[:-1] - at[0], at[1:] - at[0]))
    one, where, word = np.unique(np.concatenate(hashes), return_index=True, return_inverse=True)
    of = np.repeat(word, used)  # the word of every (word, row) pair
    count = np.bincount(of, times * training, minlength=len(one))
    spell = np.zeros(len(one))
    for lo in range(0, len(one), TOKENS):
        some = where[lo : lo + TOKENS]
        data, spans = gather_spans(letters, first[some], first[some + 1])
        for at, found, bit, gate in letter_bits(model.letter_code, data, spans):
            log = mixer.log_of([t.take(f) for t, f in zip(model.letters, found)], gate, bit, luts, costs)
            spell[lo : lo + len(some)] += np.bincount(at, log, minlength=len(some))
    seen = count > 0
    share = (1 - novel) * count / max(tail_total, 1)
    # over all strings, new words spelled; in the score all unknown words are one class
    text_log = np.where(seen, np.log10(np.where(seen, share, 1) + novel * 10.0 ** np.maximum(spell, -300)), spell + np.log10(novel))
    log = np.where(seen, text_log, np.log10(novel))
    values = (np.log10(count + 0.5), log, text_log - log, seen.astype(float), (~seen).astype(float))
    at = 0
    for (tag, _), row in zip(group, rows):
        mine, n = of[at : at + len(row)], times[at : at + len(row)]
        there, inverse = np.unique(row, return_inverse=True)
        sums = [np.bincount(inverse, n * v[mine], minlength=len(there)) for v in values]
        yield tag, TAIL, (squeeze(there), *(squeeze(x.astype(t)) for x, t in zip(sums, (np.float64, np.float32, np.float32, np.int32, np.int32))))
        at += len(row)
    yield -1, STATS, (squeeze(np.array([(10.0 ** spell[seen]).sum()])),)
