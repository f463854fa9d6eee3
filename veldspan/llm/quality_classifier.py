"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or abstain on two questions, junk and
toxicity; where the labels table covers a document, its entry is one more labeller.
Expectation-maximisation over the counts of vote patterns estimates each labeller's
accuracies and the posterior of every pattern.  Posteriors of a bounded sample of
documents (SAMPLE, a parameter) train a hashed linear scorer for each question, which judges every
document: of words and bins of ratios for junk, of words and word beginnings for toxicity.

One labeller is a lexicon: hashed words and word beginnings whose log-odds between toxic
and other labelled documents of the sample are high.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .quality_rules import _SYMBOL, base_counts
from .shared import map_text, seeded_unit, workers_find_package

SAMPLE = 6_000
SAMPLE_CHARS = 10_000  # longer documents are judged but do not teach
SEED = "classifier-2024"
BITS = 21
PREFIXES = (4, 5, 6)
LEXICON_LOG_ODDS = 4.0
LEXICON_COUNT = 3  # at least, and at least this share of the toxic documents:
LEXICON_SHARE = 0.01
EPOCHS, MIN_STEPS = 25, 1500
LIFT = 5.0
MAX_JUNK = 0.5
MAX_TOXIC = 0.3  # one toxic word in a short text scores about a third

_BREAK = np.ones(256, bool)  # words here are runs of ASCII letters, digits and non-ASCII bytes
_BREAK[48:58] = _BREAK[65:91] = _BREAK[97:123] = _BREAK[128:] = False
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LOWER = np.zeros(256, bool)
_LOWER[97:123] = True
_MARK = np.zeros(256, bool)
_MARK[33] = True

#: (ratio, bad from, good below) of each junk labeller.
JUNK_RULES = (
    ("symbols", 0.10, 0.03),
    ("upper", 0.50, 0.20),
    ("marks", 0.10, 0.03),
    ("repeats", 0.30, 0.15),
    ("bare", 0.10, 0.03),
    ("lines", 0.30, 0.10),
)
LABELLERS = (*(r[0] for r in JUNK_RULES), "junk_label")
TOXIC_LABELLERS = ("lexicon", "prefixes", "toxic_label")
BINS = 8


class Terms(NamedTuple):
    doc: np.ndarray  # row of each distinct word of a row
    columns: np.ndarray  # feature numbers, one row for words and one for each prefix length; -1 where too short


class Model(NamedTuple):
    index: np.ndarray  # of each feature number, its column in weights; column 0 is of those that weigh nothing
    weights: np.ndarray  # one row for junk, one for toxicity
    bias: list[float]


def terms(s: K.Slice) -> Terms:
    data = K.LOWER[s.data]
    w = K.words(data, s.offsets, lower=False, space=_BREAK)
    key = w.hash ^ K.mix(w.doc + 1)
    _, first = np.unique(key, return_index=True)
    first.sort()
    doc, start, end = w.doc[first], w.start[first], w.end[first]
    total = K.prefix_sums(data)
    mask = np.uint64((1 << BITS) - 1)
    out = [(w.hash[first] & mask).astype(np.int64)]
    for n in PREFIXES:
        h = K.mix(K.span_hash(data, start, np.minimum(start + n, end), total) + np.uint64(n))
        out.append(np.where(end - start >= n, (h & mask).astype(np.int64), -1))
    return Terms(doc, np.stack(out))


def ratios(s: K.Slice) -> np.ndarray:
    """The junk labellers' ratios, rows x rules."""
    rows = s.hi - s.lo
    base, w = base_counts(s)
    row = K.row_of_byte(s.offsets)
    count = lambda table: np.bincount(row[table[s.data]], minlength=rows)
    n = np.maximum(base["n_words"], 1)
    letters = count(_UPPER) + count(_LOWER)
    solid = np.zeros(len(s.data) + 1, np.int64)
    np.cumsum(~_BREAK[s.data], out=solid[1:])
    bare = np.bincount(w.doc[solid[w.end] == solid[w.start]], minlength=rows)
    lines = np.bincount(row[s.data == 10], minlength=rows) + 1
    return np.column_stack([
        count(_SYMBOL) / n,
        count(_UPPER) / np.maximum(letters, 1),
        count(_MARK) / n,
        base["n_repeat_words"] / n,
        bare / n,
        base["n_dup_lines"] / lines,
    ])


def junk_votes(ratio: np.ndarray) -> np.ndarray:
    """-1 abstains, 0 good, 1 bad."""
    out = np.full(ratio.shape, -1, np.int8)
    for j, (_, bad, good) in enumerate(JUNK_RULES):
        out[ratio[:, j] < good, j] = 0
        out[ratio[:, j] >= bad, j] = 1
    return out


def toxic_votes(t: Terms, rows: int, lexicon: np.ndarray) -> np.ndarray:
    """Votes of the lexicon of words and of the lexicon of beginnings; abstains without a lexicon."""
    out = np.full((rows, 2), -1, np.int8)
    for j, cols in enumerate((t.columns[:1], t.columns[1:])):
        flags = lexicon[j]
        if flags.any():
            hit = (flags[np.maximum(cols, 0)] & (cols >= 0)).any(0)
            out[:, j] = np.bincount(t.doc[hit], minlength=rows) > 0
    return out


def expectation_maximisation(votes: np.ndarray, counts: np.ndarray, rounds: int = 60) -> dict[str, np.ndarray]:
    """Prior and vote rates of labellers from vote patterns (rows) and how often each occurs.

    rates[y, j, v + 1] is the estimated probability that labeller j votes v (-1 abstains,
    0 good, 1 bad) on a document of class y (1 bad): rates[1, j, 2] and rates[0, j, 1] are
    its accuracies.  Starts from "bad if anyone says so".
    """
    p = np.where((votes == 1).any(1), 0.9, 0.02)
    for _ in range(rounds):
        prior = float(np.clip(((counts * p).sum() + 1) / (counts.sum() + 4), 1e-4, 0.5))
        rates = np.stack([np.stack([[(w * (votes[:, j] == v)).sum() + 0.1 for v in (-1, 0, 1)] for j in range(votes.shape[1])]) for w in (counts * (1 - p), counts * p)])
        rates /= rates.sum(2, keepdims=True)
        p = posterior(votes, prior, rates)
    return {"prior": prior, "rates": rates}


def posterior(votes: np.ndarray, prior: float, rates: np.ndarray) -> np.ndarray:
    odds = np.log(rates[1] / rates[0])
    z = np.log(prior / (1 - prior)) + sum(odds[j, votes[:, j].astype(int) + 1] for j in range(votes.shape[1]))
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def ratio_slots(ratio: np.ndarray) -> np.ndarray:
    """One feature number per ratio, by the hash of its bin: bins are fine near zero, where good and bad meet."""
    bins = np.minimum(np.sqrt(np.maximum(ratio, 0)) * BINS, BINS - 1).astype(np.int64) + np.arange(ratio.shape[1]) * BINS
    return (K.mix(bins.astype(np.uint64) + np.uint64(1 << 40)) & np.uint64((1 << BITS) - 1)).astype(np.int64)


def telling(doc: np.ndarray, slot: np.ndarray, target: np.ndarray) -> np.ndarray:
    """True for the slots of words that teach: rare ones, or those about as frequent in good documents, are only noise."""
    seen = np.bincount(slot, target[doc], minlength=1 << BITS)
    other = np.bincount(slot, minlength=1 << BITS) - seen
    lift = seen * (len(target) - target.sum()) >= LIFT * other * target.sum()
    return lift & (seen >= max(LEXICON_COUNT, LEXICON_SHARE * target.sum()))


def train_linear(doc: np.ndarray, feature: np.ndarray, target: np.ndarray, width: int) -> tuple[np.ndarray, float]:
    """Logistic regression on soft targets by AdaGrad over small batches of documents; doc is sorted."""
    weights, bias, g2, b2 = np.zeros(width), 0.0, np.full(width, 1e-2), 1e-2
    n = len(target)
    at = np.searchsorted(doc, np.arange(n + 1))
    rng = np.random.default_rng(7)
    for _ in range(max(EPOCHS, -(-MIN_STEPS * 64 // max(n, 1)))):
        order = rng.permutation(n)
        for lo in range(0, n, 64):
            batch = order[lo : lo + 64]
            idx = np.concatenate([feature[at[b] : at[b + 1]] for b in batch])
            who = np.repeat(np.arange(len(batch)), at[batch + 1] - at[batch])
            z = np.bincount(who, weights[idx], minlength=len(batch)) + bias
            error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - target[batch]
            used, inverse = np.unique(idx, return_inverse=True)
            g = np.bincount(inverse, error[who]) / len(batch) + 1e-5 * weights[used]
            g2[used] += g * g
            weights[used] -= 0.1 * g / np.sqrt(g2[used])
            gb = error.mean()
            b2 += gb * gb
            bias -= 0.1 * gb / np.sqrt(b2)
    return weights, bias


def learn_lexicon(t: Terms, toxic_label: np.ndarray) -> np.ndarray:
    """Flags of hashed words (row 0) and beginnings (row 1) that tell toxic from other labelled documents."""
    lexicon = np.zeros((2, 1 << BITS), bool)
    known = toxic_label >= 0
    if known.any():
        n_bad, n_good = (toxic_label == 1).sum(), (toxic_label == 0).sum()
        for j, picked_cols in enumerate((t.columns[:1], t.columns[1:])):
            n = np.zeros((2, 1 << BITS), np.float32)
            for v in (0, 1):
                rows_here = (toxic_label == v)[t.doc]
                pairs = np.unique(np.concatenate([(t.doc[m] << BITS) + c[m].astype(np.int64) for c in picked_cols for m in [rows_here & (c >= 0)]]))
                n[v] = np.bincount(pairs & ((1 << BITS) - 1), minlength=1 << BITS)
            odds = np.log((n[1] + 0.5) / (n_bad + 1)) - np.log((n[0] + 0.5) / (n_good + 1))
            lexicon[j] = (odds > LEXICON_LOG_ODDS) & (n[1] >= max(LEXICON_COUNT, LEXICON_SHARE * n_bad))
    return lexicon


def fit(docs: DataFrame, labels: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text"):
    """The two linear scorers (junk, toxicity) as a broadcast Model."""
    spark = docs.sparkSession
    workers_find_package(spark)
    id_type = docs.schema[id_col].dataType.simpleString()
    docs = docs.select(F.col(text_col).alias("text"), F.col(id_col).alias("doc_id"))
    if labels is None:
        labels = spark.createDataFrame([], f"doc_id {id_type}, quality int, toxic int")
    # votes: 1 bad, 0 good, -1 none
    marks = labels.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.coalesce(1 - F.min("quality"), F.lit(-1)).cast("int").alias("junk_label"), F.coalesce(F.max("toxic"), F.lit(-1)).cast("int").alias("toxic_label")
    )
    labelled = marks.count()
    unit = seeded_unit(SEED, F.col("doc_id"))
    if labelled:
        picked = F.broadcast(marks.filter(unit < SAMPLE / labelled))
        sample = docs.join(picked, "doc_id").select("text", "doc_id", "junk_label", "toxic_label")
    else:
        sample = docs.filter(unit < SAMPLE / max(1, docs.count())).select("text", "doc_id", F.lit(-1).alias("junk_label"), F.lit(-1).alias("toxic_label"))

    # one text of each id, so that an id of very many rows cannot fill the sample
    sample = sample.filter(F.coalesce(F.length("text"), F.lit(0)) <= SAMPLE_CHARS)
    sample = sample.groupBy("doc_id", "junk_label", "toxic_label").agg(F.min("text").alias("text")).select("text", "doc_id", "junk_label", "toxic_label")

    def gather():
        def each(s, rest):
            t, ratio = terms(s), ratios(s)
            order = np.argsort(t.doc, kind="stable")
            off = np.searchsorted(t.doc[order], np.arange(s.hi - s.lo + 1))
            flat = t.columns.T[order].astype(np.int32).reshape(-1)
            return {
                "doc_id": rest[0], "junk_label": rest[1], "toxic_label": rest[2],
                "terms": K.packed(flat, off * len(t.columns)), "ratios": K.packed(ratio.reshape(-1), np.arange(len(ratio) + 1) * ratio.shape[1]),
            }

        return each, None

    rows = map_text(sample, f"doc_id {id_type}, junk_label int, toxic_label int, terms binary, ratios binary", gather, limit=K.LEAN_BYTES).collect()
    rows.sort(key=lambda r: (str(r["doc_id"]), r["ratios"], r["terms"]))
    cols = [np.frombuffer(r["terms"], np.int32).reshape(-1, 1 + len(PREFIXES)) for r in rows]
    ratio = np.array([np.frombuffer(r["ratios"], np.float64) for r in rows]).reshape(len(rows), len(JUNK_RULES))
    junk_label = np.array([r["junk_label"] for r in rows], np.int8)
    toxic_label = np.array([r["toxic_label"] for r in rows], np.int8)
    t = Terms(np.repeat(np.arange(len(rows)), [len(c) for c in cols]), np.concatenate(cols).T if cols else np.zeros((1 + len(PREFIXES), 0), np.int32))
    n_rows = len(rows)
    del cols, rows  # the driver keeps only arrays

    lexicon = learn_lexicon(t, toxic_label)
    shared = spark.sparkContext.broadcast(lexicon)

    names = [*(r[0] for r in JUNK_RULES), *TOXIC_LABELLERS[:2]]

    def vote():
        def each(s, rest):
            v = np.column_stack([junk_votes(ratios(s)), toxic_votes(terms(s), s.hi - s.lo, shared.value)])
            return {"doc_id": rest[0]} | {n: v[:, j].astype(np.int32) for j, n in enumerate(names)}

        return each, None

    ballots = map_text(docs, f"doc_id {id_type}, " + ", ".join(f"{n} int" for n in names), vote, limit=K.LEAN_BYTES)
    ballots = ballots.join(marks, "doc_id", "left").fillna(-1, ["junk_label", "toxic_label"])
    questions = [
        (LABELLERS, np.column_stack([junk_votes(ratio), junk_label])),
        (TOXIC_LABELLERS, np.column_stack([toxic_votes(t, n_rows, lexicon), toxic_label])),
    ]
    scorers = []
    patterns = ballots.groupBy(*LABELLERS, *TOXIC_LABELLERS).agg(F.count(F.lit(1)).alias("n")).collect()
    counts = np.array([r["n"] for r in patterns], float)
    for kind, (group, votes_here) in enumerate(questions):
        if not n_rows:
            scorers.append((np.zeros(1 << BITS), -5.0))
            continue
        pattern = np.array([[r[g] for g in group] for r in patterns], np.int8)
        target = posterior(votes_here, **expectation_maximisation(pattern, counts))
        if kind == 0:
            used = telling(t.doc, t.columns[0], target)[t.columns[0]]
            doc = np.concatenate([np.repeat(np.arange(n_rows), ratio.shape[1]), t.doc[used]])
            feature = np.concatenate([ratio_slots(ratio).reshape(-1), t.columns[0][used]])
            order = np.argsort(doc, kind="stable")
            scorers.append(train_linear(doc[order], feature[order], target, 1 << BITS))
        else:
            flat = t.columns.T.reshape(-1)
            doc = np.repeat(t.doc.astype(np.int32), len(t.columns))
            used = (flat >= 0) & telling(doc[flat >= 0], flat[flat >= 0], target)[flat]
            scorers.append(train_linear(doc[used], flat[used], target, 1 << BITS))
    return spark.sparkContext.broadcast(pack(scorers))


def pack(scorers: list[tuple[np.ndarray, float]]) -> Model:
    """The scorers as one table, as most slots weigh nothing."""
    used = np.flatnonzero(np.any([w != 0 for w, _ in scorers], 0))
    index = np.zeros(1 << BITS, np.int32)
    index[used] = np.arange(1, len(used) + 1)
    weights = np.zeros((len(scorers), len(used) + 1), np.float32)
    for j, (w, _) in enumerate(scorers):
        weights[j, 1:] = w[used]
    return Model(index, weights, [b for _, b in scorers])


def judge(model, s: K.Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(junk score, toxicity score, kept) of the rows of a slice."""
    index, (for_junk, for_toxic), (junk_bias, toxic_bias) = model
    rows = s.hi - s.lo
    r, t = ratios(s), terms(s)
    at = np.where(t.columns >= 0, index[np.maximum(t.columns, 0)], 0)
    junk = for_junk[index[ratio_slots(r)]].sum(1) + np.bincount(t.doc, for_junk[at[0]], minlength=rows) + junk_bias
    toxic = np.bincount(t.doc, for_toxic[at].sum(0), minlength=rows) + toxic_bias
    junk, toxic = 1 / (1 + np.exp(-np.clip(junk, -30, 30))), 1 / (1 + np.exp(-np.clip(toxic, -30, 30)))
    empty = np.diff(K.words(s.data, s.offsets).first) == 0
    junk = np.where(empty, 1.0, junk)
    return junk, toxic, (junk < MAX_JUNK) & (toxic < MAX_TOXIC)


def kept_rows(batches, at: int, model: Model):
    """The rows to keep of batches with texts in column ``at``, slice by slice: whole rows are held once, not once more as a result."""
    for batch in batches:
        for s in K.text_slices(batch.column(at), K.LEAN_BYTES):
            yield batch.slice(s.lo, s.hi - s.lo).filter(pa.array(judge(model, s)[2]))


def classify(docs: DataFrame, labels: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, junk_score, toxic_score (0 to 1), kept.

    Null and empty texts have no features; they are junk by definition and not kept.
    Labels may be missing, null, repeated (the worse entry counts) or about unknown
    documents.  With no labels at all the heuristics alone teach, and nothing is toxic.
    Repeated rows are judged alike; an empty table gives an empty table; other columns
    are ignored.
    """
    model = fit(docs, labels, id_col, text_col)

    def score():
        def each(s, rest):
            junk, toxic, kept = judge(model.value, s)
            return {"doc_id": rest[0], "junk_score": np.round(junk, 6), "toxic_score": np.round(toxic, 6), "kept": kept}

        return each, None

    ddl = f"doc_id {docs.schema[id_col].dataType.simpleString()}, junk_score double, toxic_score double, kept boolean"
    return map_text(docs.select(F.col(text_col).alias("text"), F.col(id_col).alias("doc_id")), ddl, score, limit=K.LEAN_BYTES)


def keep_good(docs: DataFrame, labels: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that ``classify`` keeps."""
    model, at = fit(docs, labels, id_col, text_col), docs.columns.index(text_col)

    return docs.mapInArrow(lambda batches: kept_rows(batches, at, model.value), docs.schema)
