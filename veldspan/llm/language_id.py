"""Language identification by nearest centroid.

Texts become normalised TF-IDF vectors of hashed byte n-grams (one to four bytes, ASCII
and Latin-1 letters lower-cased, other ASCII bytes as gaps between words).  Each language has several centroids, found by spherical
k-means on a bounded sample of its training documents (SAMPLE_PER_LANG, a parameter); the
inverse document frequencies count all training documents.  Every language is learned; a task
holds the centroids of about LANG_BLOCK languages, and with more, texts are compared with one
block after the other.  A text gets the language of
the centroid with the highest cosine; ``rejected`` is true where the cosine distance is
above that language's limit, the REJECT_QUANTILE quantile of its own sample.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .shared import map_text, materialise, seeded_unit

DIM = 1 << 13
NGRAMS = (1, 2, 3, 4)
CLUSTERS = 4
ROUNDS = 8
SAMPLE_PER_LANG = 400
LANG_BLOCK = 500  # languages whose centroids are held at a time
REJECT_QUANTILE = 0.999
SEED = "langid-2024"
MODULUS, HELD_OUT = 5, 0
UNKNOWN = "und"
SLICE_ROWS = 256

_MULT = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_GAP = ~_LETTER  # every run of other ASCII bytes is one gap between words
_GAP[128:] = False


def held_out(id_col: Column) -> Column:
    """Whether crc32 of the id as text is 0 modulo 5; false for a null id."""
    return F.coalesce(F.crc32(F.encode(id_col.cast("string"), "UTF-8")) % MODULUS == HELD_OUT, F.lit(False))


def has_letter(s: K.Slice) -> np.ndarray:
    """Rows with at least one letter of any script."""
    rows = s.hi - s.lo
    out = np.bincount(K.row_of_byte(s.offsets)[_LETTER[s.data]], minlength=rows) > 0
    for i in np.flatnonzero(~out):
        raw = s.data[s.offsets[i] : s.offsets[i + 1]]
        if (raw >= 0xC0).any():
            out[i] = any(c.isalpha() for c in raw.tobytes().decode("utf-8", "replace"))
    return out


def term_counts(s: K.Slice, dim: int = DIM) -> np.ndarray:
    """Hashed n-gram counts, rows x dim."""
    rows = s.hi - s.lo
    data = K.LOWER[s.data]
    upper = np.zeros(len(data), bool)
    upper[1:] = (s.data[:-1] == 0xC3) & (s.data[1:] >= 0x80) & (s.data[1:] <= 0x9E)
    data = np.where(upper, data + 0x20, data).astype(np.uint32)
    gap = _GAP[s.data]
    data[gap] = 0x20
    row = K.row_of_byte(s.offsets)
    wide = np.zeros(len(data) + 1, np.int64)  # pairs of gaps so far: no n-gram holds two in a row
    np.cumsum(np.append(gap[1:] & gap[:-1], False) if len(gap) else gap, out=wide[1:])
    out = np.zeros(rows * dim, np.int64)
    for n in NGRAMS:
        m = len(data) - n + 1
        if m <= 0:
            continue
        h = np.full(m, n * 0x1B873593 & 0xFFFFFFFF, np.uint32)
        for j in range(n):
            h = (h ^ data[j : j + m]) * _MULT[j]
        h ^= h >> np.uint32(15)
        flat = row[:m] * dim + (h & np.uint32(dim - 1))
        whole = (row[:m] == row[n - 1 :]) & (wide[n - 1 :][:m] == wide[:m]) & ~((n == 1) & gap[:m])
        out += np.bincount(flat[whole], minlength=rows * dim)
    return out.reshape(rows, dim)


def vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(counts).astype(np.float32) * idf
    return v / np.maximum(np.sqrt((v * v).sum(1, keepdims=True)), 1e-12)


def centroids(v: np.ndarray) -> tuple[np.ndarray, float]:
    """Spherical k-means from spread-out starts, and the distance that all but a few of v keep."""
    start = [0]
    for _ in range(1, min(CLUSTERS, len(v))):
        start.append(int((v @ v[start].T).max(1).argmin()))
    c = v[start]
    for _ in range(ROUNDS):
        near = (v @ c.T).argmax(1)
        c = np.stack([v[near == k].sum(0) if (near == k).any() else c[k] for k in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c, float(np.quantile(1 - (v @ c.T).max(1), REJECT_QUANTILE))


Model = dict[str, tuple[np.ndarray, float]]


def fit(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> tuple[np.ndarray, Iterator[Model]]:
    """(idf, blocks of lang -> (centroids, rejection distance)) from the training documents with text and lang.

    The sample has about SAMPLE_PER_LANG ids a language, taken by a seeded number, and one text
    of each id and language; repeated rows of an id do not lower the share of the others.
    """
    train = docs.filter(~held_out(F.col(id_col)) & F.col(id_col).isNotNull() & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"), F.col(id_col).alias("id"), seeded_unit(SEED, F.col(id_col)).alias("unit")
    )

    def frequencies():
        total = np.zeros(DIM + 1, np.int64)

        def each(s, rest):
            total[:DIM] += (term_counts(s) > 0).sum(0)
            total[DIM] += s.hi - s.lo

        return each, lambda: {"i": np.arange(DIM + 1), "n": total} if total[DIM] else None

    df = np.zeros(DIM + 1)
    for r in map_text(train.select("text"), "i int, n long", frequencies, SLICE_ROWS).groupBy("i").agg(F.sum("n").alias("n")).collect():
        df[r["i"]] = r["n"]
    idf = np.log((1 + df[DIM]) / (1 + df[:DIM])).astype(np.float32)
    idf = np.maximum(idf, 0.05).astype(np.float32)
    counts = train.select("lang", "id").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    counts = materialise(counts, "language-counts")
    blocks = -(-counts.count() // LANG_BLOCK)

    def embed():
        def each(s, rest):
            v = vectors(term_counts(s), idf).astype(np.float16)
            off = np.arange(len(v) + 1) * DIM
            return {"lang": rest[0], "unit": rest[1], "vector": K.packed(v.reshape(-1), off)}

        return each, None

    def learn(pdf):
        v = np.stack([np.frombuffer(x, np.float16) for x in pdf.sort_values(["unit", "vector"])["vector"]]).astype(np.float32)
        c, limit = centroids(v)
        return pdf.iloc[:1][["lang"]].assign(centroids=[c.tobytes()], distance=[limit])

    def models():
        for i in range(blocks):
            here = F.pmod(F.xxhash64("lang"), F.lit(blocks)) == i
            n = {r["lang"]: r["n"] for r in counts.filter(here).collect()}
            share = F.create_map(*[F.lit(x) for k, v in n.items() for x in (k, min(1.0, SAMPLE_PER_LANG / v))]) if n else None
            if share is None:
                continue
            picked = train.filter(here & (F.col("unit") < F.element_at(share, F.col("lang"))))
            sample = picked.groupBy("lang", "unit").agg(F.min("text").alias("text")).select("text", "lang", "unit")
            fitted = map_text(sample, "lang string, unit double, vector binary", embed, SLICE_ROWS).groupBy("lang").applyInPandas(
                learn, "lang string, centroids binary, distance double"
            )
            yield {r["lang"]: (np.frombuffer(r["centroids"], np.float32).reshape(-1, DIM), r["distance"]) for r in fitted.collect()}

    return idf, models()


class Centroids:
    """The centroids of a block of languages as one matrix."""

    def __init__(self, model: Model):
        self.names = sorted(model)
        self.matrix = np.concatenate([model[n][0] for n in self.names])
        self.owner = np.concatenate([[i] * len(model[n][0]) for i, n in enumerate(self.names)]).astype(int)
        self.limits = np.array([model[n][1] for n in self.names])

    def compare(self, v: np.ndarray, pred: np.ndarray, score: np.ndarray, rejected: np.ndarray) -> None:
        """Updates language, cosine and rejection of rows where this block has a nearer centroid (of equals the first name)."""
        cosine = v @ self.matrix.T
        best = cosine.argmax(1)
        top = np.clip(cosine[np.arange(len(v)), best], 0, 1).astype(float)
        name = np.array(self.names, object)[self.owner[best]]
        better = (top > score) | ((top == score) & (name < pred))
        pred[better], score[better] = name[better], top[better]
        rejected[better] = (1 - top > self.limits[self.owner[best]])[better]


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score (cosine, 0 to 1), rejected.

    Texts that are null or have no letter get ``und`` with score 0.  A document with a null
    id is predicted like any other but not learned from.  If no language can be learned
    (empty table, no lang) every text gets ``und``.  Repeated rows give repeated results;
    other columns are ignored.
    """
    spark = docs.sparkSession
    idf, models = fit(docs, id_col, text_col, lang_col)
    blocks = [spark.sparkContext.broadcast((idf, Centroids(m))) for m in models]
    id_type = docs.schema[id_col].dataType.simpleString()
    carried = "lang_pred string, score double, rejected boolean"

    def task(shared, last: bool):
        def predict():
            def each(s, rest):
                known = has_letter(s) & s.valid
                pred, score, rejected = (x.to_numpy(zero_copy_only=False).copy() for x in rest[2:5])
                if shared is not None and known.any():
                    idf, centroids = shared.value
                    centroids.compare(vectors(term_counts(s), idf), pred, score, rejected)
                if not last:
                    return {"text": rest[5], "doc_id": rest[0], "held_out": rest[1], "lang_pred": pred, "score": score, "rejected": rejected}
                known &= shared is not None
                pred, score = np.where(known, pred, UNKNOWN), np.where(known, np.round(score, 6), 0.0)
                return {"doc_id": rest[0], "held_out": rest[1], "lang_pred": pred, "score": score, "rejected": rejected | ~known}

            return each, None

        return predict

    rows = docs.select(
        F.col(text_col).alias("text"), F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"),
        F.lit(UNKNOWN).alias("lang_pred"), F.lit(-1.0).alias("score"), F.lit(True).alias("rejected"),
    )
    for shared in blocks[:-1]:
        rows = map_text(rows.select("*", F.col("text").alias("again")), f"text string, doc_id {id_type}, held_out boolean, {carried}", task(shared, False), SLICE_ROWS)
    return map_text(rows, f"doc_id {id_type}, held_out boolean, {carried}", task(blocks[-1] if blocks else None, True), SLICE_ROWS)
