"""License scans: TF-IDF cosine of notices to templates, then inheritance from directories.

Every line of a file, and every window of as many words as a notice has, across line
breaks, is compared with short notices of known licences, and the file as a whole with
full licence texts.  Vectors are sparse: the words of the templates with their inverse
document frequency over the whole corpus, and one weight for all other words.  Versions and names must
agree: the words with digits, and those that name a licence (MARKS), of a line or window are just those of the
notice, and the number after the first "version" of a file is that of the full text.  Headings and SPDX tags
(LINES) count as whole lines only.  A file's
own licence is that of the full text it equals (cosine of MIN_FILE_COSINE), else that of
its best line or window, if the cosine reaches MIN_COSINE.  A licence file (a full text, or
a licence was found and the file has few words besides, or its name says so) speaks for
its directory; a file without a
licence of its own inherits from the nearest ancestor directory that has one.  Ancestors
are resolved once per directory, not per file, so that a root directory with a third of
all files is one row.
"""

from __future__ import annotations

from pathlib import Path
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .shared import map_text, materialise

MIN_COSINE = 0.7
MIN_FILE_COSINE = 0.9
FILE_ROWS = 128  # files compared as a whole at a time
SPANS = 1 << 14  # lines or windows compared exactly at a time
MIN_LINE_WORDS = 3
LICENSE_FILE_WORDS = 60
LICENSE_NAMES = r"(?i)(^|/)(licen[cs]e|copying|unlicense)([.-][^/]*)?$"

#: Notices of common licences, as their stewards publish them.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
        "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    (
        "GPL-2.0",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License "
        "as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    *[
        (
            name,
            f"This {kind} is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License "
            f"as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version.",
        )
        for name, version in (("LGPL-2.1", "2.1"), ("LGPL-3.0", "3"))
        for kind in ("library", "program")
    ],
    (
        "AGPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License "
        "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    ("LGPL-2.1", "Licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-3.0", "Licensed under CC BY 3.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Proprietary", "All rights reserved."),
)

#: Identifiers of the SPDX list.
SPDX = (
    "MIT", "Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "MPL-2.0",
    "CC-BY-3.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0", "CC-BY-NC-ND-4.0", "CC0-1.0", "Unlicense",
)

#: Headings and tags: they count as whole lines only, as text may speak of any licence.
LINES = (
    *[(name, f"SPDX-License-Identifier: {name}{more}") for name in SPDX for more in (("", "-only", "-or-later") if "GPL" in name else ("",))],
    *[("MIT", x) for x in ("MIT License", "The MIT License", "The MIT License (MIT)")],
    ("ISC", "ISC License"),
    ("Apache-2.0", "Apache License, Version 2.0"),
    ("Apache-2.0", "Apache License 2.0"),
    ("BSD-2-Clause", "BSD 2-Clause License"),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("GPL-2.0", "GNU General Public License version 2"),
    ("GPL-3.0", "GNU General Public License version 3"),
    ("LGPL-2.1", "GNU Lesser General Public License version 2.1"),
    ("LGPL-3.0", "GNU Lesser General Public License version 3"),
    ("AGPL-3.0", "GNU Affero General Public License version 3"),
)

#: Words that name a licence or a kind of it.
MARKS = (
    "affero agpl apache artistic boost by-nc by-nc-nd by-nc-sa by-nd by-sa cddl eclipse epl eupl european general gpl isc lesser lgpl library "
    "mit mozilla mpl openssl postgresql proprietary python spdx-license-identifier unlicense wtfpl zlib"
).split()

GENERAL = ("GPL", "BSD")  # notices that tell no version: they count where no other notice is found

#: Full texts by licence, read on the driver.
TEXTS = Path(__file__).parent / "licence_texts"

_BREAK = np.ones(256, bool)  # words are runs of ASCII letters, digits, dots and hyphens, and non-ASCII bytes
_BREAK[48:58] = _BREAK[65:91] = _BREAK[97:123] = _BREAK[128:] = False
_BREAK[[45]] = False
_MARKS = np.sort(K.words(np.frombuffer(" ".join(MARKS).encode(), np.uint8), np.array([0, len(" ".join(MARKS))]), space=_BREAK).hash)
_VERSION = K.words(np.frombuffer(b"version", np.uint8), np.array([0, 7])).hash[0]


def _line_words(data: np.ndarray, offsets: np.ndarray):
    """(words, line of each word, row of each line): lines numbered over the slice."""
    w = K.words(data, offsets, space=_BREAK)
    starts = np.zeros(len(data) + 1, bool)
    starts[offsets[:-1]] = True
    starts[1:] |= data == 10
    starts[-1] = False
    begins = np.flatnonzero(starts)
    line = np.searchsorted(begins, w.start, "right") - 1
    rows = np.searchsorted(offsets, begins, "right") - 1
    return w, line, rows


def number_words(data: np.ndarray, w: K.Words) -> np.ndarray:
    """A number for each word with a digit, from its hash; 0 for other words."""
    digits = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data >= 48) & (data <= 57), out=digits[1:])
    return np.where(digits[w.end] > digits[w.start], K.mix(w.hash) | np.uint64(1), np.uint64(0))


def mark_words(w: K.Words, numbers: np.ndarray) -> np.ndarray:
    """``numbers``, and a number for each of MARKS as well."""
    return np.where(_MARKS[np.minimum(np.searchsorted(_MARKS, w.hash), len(_MARKS) - 1)] == w.hash, K.mix(w.hash) | np.uint64(1), numbers)


def first_versions(w: K.Words, numbers: np.ndarray) -> np.ndarray:
    """For each row, the number word after its first "version" that has one; 0 without."""
    said = np.flatnonzero((w.hash[:-1] == _VERSION) & (numbers[1:] > 0) & (w.doc[1:] == w.doc[:-1]))
    row, at = np.unique(w.doc[said], return_index=True)
    out = np.zeros(len(w.first) - 1, np.uint64)
    out[row] = numbers[said[at] + 1]
    return out


class Templates(NamedTuple):
    vocabulary: np.ndarray  # all words
    words: list[np.ndarray]  # of each template: the notices, the lines, then the full texts
    names: list[str]
    marks: np.ndarray  # sum of the marks of each
    versions: np.ndarray


def templates() -> Templates:
    full = [(f.stem, f.read_bytes()) for f in sorted(TEXTS.glob("*.txt"))]
    short = [*TEMPLATES, *LINES]
    raw = [t.encode() for _, t in short] + [t for _, t in full]
    data = np.frombuffer(b"".join(raw), np.uint8)
    w = K.words(data, np.cumsum([0, *map(len, raw)]), space=_BREAK)
    numbers = number_words(data, w)
    return Templates(
        np.unique(w.hash), [w.hash[w.first[i] : w.first[i + 1]] for i in range(len(raw))], [n for n, _ in [*short, *full]],
        np.diff(_running(mark_words(w, numbers))[w.first]), first_versions(w, numbers),
    )


def _template_matrix(vocabulary, lists, idf) -> np.ndarray:
    m = np.zeros((len(lists), len(vocabulary)))
    for i, h in enumerate(lists):
        np.add.at(m[i], np.searchsorted(vocabulary, h), 1)
    m *= idf
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def _running(x: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)])


def _sums(x: np.ndarray) -> np.ndarray:
    return np.concatenate([[0.0], np.cumsum(x)])


def _exact(at: np.ndarray, lo: np.ndarray, hi: np.ndarray, dot: np.ndarray, idf: np.ndarray, rare: float) -> np.ndarray:
    """Cosines of spans of words, ``at`` being each word's place in the vocabulary (its size: none)."""
    size = hi - lo
    span = np.repeat(np.arange(len(lo)), size)
    word = at[np.arange(len(span)) + np.repeat(lo - np.cumsum(size) + size, size)]
    key, n = np.unique(span * (len(idf) + 1) + word, return_counts=True)
    span, word = key // (len(idf) + 1), key % (len(idf) + 1)
    other = word == len(idf)
    square = np.where(other, n * rare * rare, (n * idf[np.minimum(word, len(idf) - 1)]) ** 2)
    return dot / np.sqrt(np.bincount(span, square, minlength=len(lo)))


def best_spans(at: np.ndarray, doc: np.ndarray, lo: np.ndarray, hi: np.ndarray, matrix: np.ndarray, sizes: list[int], windows: int, idf: np.ndarray,
               rare: float, marks: np.ndarray, wanted: np.ndarray):
    """(row, template, cosine) of all spans that reach MIN_COSINE: the given ones (lines), and all windows of a template's length.

    ``marks`` are the words that must agree, ``wanted`` their sum in each template; the first ``windows`` templates are
    looked for in windows, in lines of MIN_LINE_WORDS and more too, the others in lines.

    A template with marks is only compared where they agree.  For others, sums up to each word give a span's
    product with the template, and a bound of its length that is exact unless a word repeats; only spans
    whose bound passes are counted.
    """
    weight = np.append(idf, rare)
    square, counted = _sums((weight * weight)[at]), _running(marks)
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    long = hi - lo >= MIN_LINE_WORDS
    in_line = counted[hi] - counted[lo]
    for t, size in enumerate(sizes):
        weighted = np.append(idf * matrix[t], 0)
        begin, use = np.arange(0), np.flatnonzero((in_line == wanted[t]) & (long if t < windows else hi > lo))
        if t < windows and len(at) >= size:
            begin = np.flatnonzero(counted[size:] - counted[:-size] == wanted[t])
            begin = begin[doc[begin] == doc[begin + size - 1]]
        product = None if wanted[t] else _sums(weighted[at])
        for a, b in ((lo[use], hi[use]), (begin, begin + size)):
            if product is not None:
                dot = product[b] - product[a]
                some = np.flatnonzero(dot * dot >= (MIN_COSINE * MIN_COSINE - 1e-9) * (square[b] - square[a]))
                a, b = a[some], b[some]
            for k in range(0, len(a), SPANS):
                start, end = a[k : k + SPANS], b[k : k + SPANS]
                n = end - start
                word = np.arange(n.sum()) + np.repeat(start - np.cumsum(n) + n, n)
                dot = np.bincount(np.repeat(np.arange(len(n)), n), weighted[at[word]], minlength=len(n))
                cosine = _exact(at, start, end, dot, idf, rare)
                good = cosine >= MIN_COSINE
                found.append((doc[start[good]], np.full(good.sum(), t), cosine[good]))
    return [np.concatenate(x) for x in zip(*found)]


def best_texts(at: np.ndarray, first: np.ndarray, matrix: np.ndarray, idf: np.ndarray, rare: float, version: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(template, cosine) of the nearest full text of every row, as a whole; cosine 0 where too few words are known or another version is named."""
    rows = len(first) - 1
    template, value = np.zeros(rows, np.int64), np.zeros(rows)
    size = np.diff(first)
    known = np.diff(np.concatenate([[0], np.cumsum(at < len(idf))])[first])
    some = np.flatnonzero((size > 0) & (2 * known >= size))
    for k in range(0, len(some), FILE_ROWS):
        part = some[k : k + FILE_ROWS]
        n = size[part]
        row = np.repeat(np.arange(len(part)), n)
        word = at[np.arange(len(row)) + np.repeat(first[part] - np.cumsum(n) + n, n)]
        hit = word < len(idf)
        v = np.bincount(row[hit] * len(idf) + word[hit], minlength=len(part) * len(idf)).reshape(len(part), -1) * idf
        norm = np.sqrt((v * v).sum(1) + (n - known[part]) * rare * rare)
        cosine = (v @ matrix.T) / norm[:, None]
        cosine[(version[part][:, None] != wanted) & (version[part][:, None] > 0) & (wanted > 0)] = 0
        template[part] = cosine.argmax(1)
        value[part] = cosine.max(1)
    return template, value


def scan_licenses(files: DataFrame, id_col: str = "doc_id", path: Column | None = None, text_col: str = "text") -> DataFrame:
    """One row per file: doc_id, path, own_license, cosine, license, inherited_from.

    ``license`` is the file's own or the inherited one, null if there is none;
    ``inherited_from`` is the directory it came from.  Null and empty texts have no licence
    of their own; a null path has no directory and neither gives nor inherits.  Where
    several licence files share a directory, the one with the highest cosine speaks, then
    the first name.  Repeated rows give repeated results; an empty table gives an empty
    table; other columns are ignored.
    """
    path = F.col("path") if path is None else path
    rows = files.select(F.col(text_col).alias("text"), F.col(id_col).alias("doc_id"), path.alias("path"))
    vocabulary, lists, names, wanted, versions = templates()
    notices = len(TEMPLATES) + len(LINES)

    def frequencies():
        total = np.zeros(len(vocabulary) + 1, np.int64)

        def each(s, rest):
            w = K.words(s.data, s.offsets, space=_BREAK)
            at = np.minimum(np.searchsorted(vocabulary, w.hash), len(vocabulary) - 1)
            hit = vocabulary[at] == w.hash
            pairs = np.unique(w.doc[hit] * len(vocabulary) + at[hit])
            total[:-1] += np.bincount(pairs % len(vocabulary), minlength=len(vocabulary))
            total[-1] += s.hi - s.lo

        return each, lambda: {"i": np.arange(len(total)), "n": total} if total[-1] else None

    df = np.zeros(len(vocabulary) + 1)
    for r in map_text(rows.select("text"), "i int, n long", frequencies).groupBy("i").agg(F.sum("n").alias("n")).collect():
        df[r["i"]] = r["n"]
    rare = float(np.log(1 + df[-1])) + 1
    idf = np.log((1 + df[-1]) / (1 + df[:-1])) + 1
    matrix = _template_matrix(vocabulary, lists, idf)
    names = np.array(names, object)
    sizes = [len(x) for x in lists[:notices]]
    general = np.isin(names, GENERAL)
    ddl = "doc_id {}, path string, own_license string, cosine double, words long, whole boolean".format(files.schema[id_col].dataType.simpleString())

    def match():
        def each(s, rest):
            n_rows = s.hi - s.lo
            w, line, line_row = _line_words(s.data, s.offsets)
            best, name = np.zeros(n_rows), np.full(n_rows, None, object)
            at = np.minimum(np.searchsorted(vocabulary, w.hash), len(vocabulary) - 1)
            at[vocabulary[at] != w.hash] = len(vocabulary)
            edge = np.searchsorted(line, np.arange(len(line_row) + 1))
            numbers = number_words(s.data, w)
            row, template, value = best_spans(at, w.doc, edge[:-1], edge[1:], matrix[:notices], sizes, len(TEMPLATES), idf, rare, mark_words(w, numbers), wanted)
            order = np.lexsort((-template, np.round(value, 9), ~general[template]))
            best[row[order]] = value[order]
            name[row[order]] = names[template[order]]
            template, value = best_texts(at, w.first, matrix[notices:], idf, rare, first_versions(w, numbers), versions[notices:])
            whole = value >= MIN_FILE_COSINE
            best[whole], name[whole] = value[whole], names[notices + template[whole]]
            return {"doc_id": rest[0], "path": rest[1], "own_license": name, "cosine": np.round(best, 6), "words": np.diff(w.first), "whole": whole}

        return each, None

    own = materialise(map_text(rows, ddl, match), "license-own").withColumn("_dir", F.regexp_extract("path", r"^(.*)/[^/]*$", 1))
    own = own.withColumn("_dir", F.when(F.col("path").isNull(), None).otherwise(F.col("_dir")))
    speaks = F.col("own_license").isNotNull() & (F.col("whole") | (F.col("words") <= LICENSE_FILE_WORDS) | F.col("path").rlike(LICENSE_NAMES))
    given = (
        own.filter(speaks & F.col("_dir").isNotNull())
        .groupBy("_dir")
        .agg(F.max_by("own_license", F.struct("cosine", "own_license")).alias("given"))
        .withColumnRenamed("_dir", "ancestor")
    )
    # each directory with all its ancestors, itself first (depth = number of parts)
    parts = F.split("_dir", "/")
    directories = own.select("_dir").distinct().filter(F.col("_dir").isNotNull())
    chain = directories.select("_dir", F.explode(F.sequence(F.lit(1), F.size(parts))).alias("depth"), parts.alias("parts")).select(
        "_dir", "depth", F.array_join(F.slice("parts", F.lit(1), F.col("depth")), "/").alias("ancestor")
    )
    nearest = chain.join(given, "ancestor").groupBy("_dir").agg(F.max_by(F.struct("given", "ancestor"), "depth").alias("from"))
    return own.join(nearest, "_dir", "left").select(
        "doc_id",
        "path",
        "own_license",
        "cosine",
        F.coalesce("own_license", "from.given").alias("license"),
        F.when(F.col("own_license").isNull(), F.col("from.ancestor")).alias("inherited_from"),
    )


def document_path(block: int = 64) -> Column:
    """Where a document would lie in a tree of sources, languages and blocks of ids."""
    part = lambda c: F.coalesce(F.regexp_replace(c.cast("string"), "/", "_"), F.lit("none"))
    return F.concat_ws("/", part(F.col("source")), part(F.col("lang")), part(F.expr(f"doc_id div {block}")), F.concat(part(F.col("doc_id")), F.lit(".txt")))
