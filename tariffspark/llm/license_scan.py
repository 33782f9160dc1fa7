"""Operator 4, license scans by a positional rare-token index over licence templates.

1. One pass counts in how many documents each word of the templates occurs, which gives its IDF.
2. The seeds of a template are its words of highest IDF, two more than it may miss, so whatever covers enough of it has
   two of them in place. All their places in a file are looked up in the template postings; postings that agree on the
   relative position of file and template are candidates (two agreeing words at least).
3. A candidate counts when COVER of the template's words stand at their relative places and a mandatory phrase of the
   licence stands inside or next to the aligned stretch.

Base labels (phrases standing word for word) are found beside that and always stay. The index is a constant of the
templates below, so it is shipped to every task; documents are never shuffled.

Defined results: null and empty texts have no words, no labels and score 0; each input row gives one output row; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._core import PLAIN, Words, chunks, lists, ragged, signed, table, word_hash

#: Fixed values of the contract: label and phrase.
BASE = (("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc"))

#: Label, template, mandatory phrases (one of them must stand).
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ("permission is hereby granted free of charge",)),
    ("mit", "released under the mit license", ("mit license",)),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", ("apache license",)),
    ("apache-2", "licensed under the apache license version 2 0", ("apache license",)),
    ("gpl-3", "this work is licensed under the gnu general public license version 3", ("general public license version 3", "general public license v3")),
    ("gpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", ("gnu general public license",)),
    ("bsd-3", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", ("creative commons attribution noncommercial", "creative commons attribution non commercial")),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4", "creative commons attribution international")),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", ("this permission notice shall be included",)),
    ("mit", "licensed under the mit license see license in the project root for license information", ("mit license",)),
    ("mit", "spdx license identifier mit", ("license identifier mit",)),
    ("apache-2", "spdx license identifier apache 2 0", ("license identifier apache 2",)),
    ("apache-2", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied", ("unless required by applicable law",)),
    ("gpl-3", "spdx license identifier gpl 3 0", ("license identifier gpl 3",)),
    ("gpl-2", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation", ("general public license version 2", "general public license v2")),
    ("lgpl-3", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license", ("gnu lesser general public license",)),
    ("agpl-3", "it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license", ("gnu affero general public license",)),
    ("bsd-3", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ("neither the name",)),
    ("bsd-3", "spdx license identifier bsd 3 clause", ("license identifier bsd 3",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", ("permission to use copy modify",)),
    ("mpl-2", "if a copy of the mpl was not distributed with this file you can obtain one at mozilla org mpl 2 0", ("copy of the mpl",)),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license", ("creative commons attribution sharealike", "creative commons attribution share alike")),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", ("waived all copyright",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
    ("proprietary", "all rights reserved no part of this publication may be reproduced without the prior written permission of the publisher", ("all rights reserved",)),
)
COVER, NEAR, BLOCK = 0.6, 4, 1 << 15


class _Index:
    def __init__(self, templates=TEMPLATES):
        self.labels = [t[0] for t in templates]
        words = [t[1].split() for t in templates]
        vocab = sorted({w for x in words for w in x} | {w for t in templates for p in t[2] for w in p.split()} | {w for _, p in BASE for w in p.split()})
        h = np.array([word_hash(w) for w in vocab], np.uint64)
        order = np.argsort(h)
        self.hash = h[order]
        number = {vocab[j]: i for i, j in enumerate(order)}
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[(self.hash & np.uint64(0xFFFF)).astype(np.int64)] = True
        self.templates = [np.array([number[w] for w in x]) for x in words]
        self.phrases = [[np.array([number[w] for w in p.split()]) for p in t[2]] for t in templates]
        self.base = [(label, np.array([number[w] for w in p.split()])) for label, p in BASE]
        self.by_idf({})

    def by_idf(self, counts: dict[int, int]) -> None:
        """Postings of the seeds: of each template the places of its words from the highest IDF down."""
        df = np.array([counts.get(int(x), 0) for x in signed(self.hash)])
        posts = []
        for i, x in enumerate(self.templates):
            missing = sum(n / len(x) >= COVER for n in range(len(x)))
            posts += [(x[p], i, p) for p in np.argsort(df[x], kind="stable")[: missing + 2].tolist()]
        posts.sort()
        self.post_template, self.post_at = np.array([p[1] for p in posts]), np.array([p[2] for p in posts])
        self.from_ = np.searchsorted([p[0] for p in posts], np.arange(len(self.hash) + 1))

    def terms(self, h: np.ndarray) -> np.ndarray:
        out = np.full(len(h), -1, np.int32)
        at = np.flatnonzero(self.maybe[(h & np.uint64(0xFFFF)).astype(np.int64)])
        t = np.minimum(np.searchsorted(self.hash, h[at]), len(self.hash) - 1)
        ok = self.hash[t] == h[at]
        out[at[ok]] = t[ok]
        return out


def _stand(term: np.ndarray, doc: np.ndarray, phrase: np.ndarray) -> np.ndarray:
    """Starts of a phrase, all its words in one document."""
    at = np.flatnonzero(term[: max(len(term) - len(phrase) + 1, 0)] == phrase[0])
    for i, t in enumerate(phrase[1:], 1):
        at = at[term[at + i] == t]
    return at[doc[at] == doc[at + len(phrase) - 1]]


def _count(index: _Index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(index.hash), np.int64)
        for b in chunks(batches):
            w = Words(b.column("text"), PLAIN, lower=True)
            t = index.terms(w.hash)
            at = np.flatnonzero(t >= 0)
            seen = np.unique((np.searchsorted(w.first, at, "right") - 1) * len(index.hash) + t[at])
            total += np.bincount(seen % len(index.hash), minlength=len(total))
        yield pa.record_batch({"term": signed(index.hash), "n": total})

    return run


def _aligned(index: _Index, t: np.ndarray, w: Words, at: np.ndarray, d: np.ndarray) -> list[tuple[int, int, float]]:
    """(document, template, share of its words that stand in place) of the verified alignments. at, d: places of licence words."""
    src, nth = ragged(index.from_[t[at] + 1] - index.from_[t[at]])
    post = index.from_[t[at[src]]] + nth
    rel, tem = at[src] - index.post_at[post], index.post_template[post]
    big = len(t) + 4096
    key, votes = np.unique((d[src] * len(index.templates) + tem) * big + rel + 2048, return_counts=True)
    key = key[votes >= 2]
    (doc_, tem), start = np.divmod(key // big, len(index.templates)), key % big - 2048
    out = []
    for i, words in enumerate(index.templates):
        mine = np.flatnonzero(tem == i)
        for some in np.split(mine, range(BLOCK, len(mine), BLOCK)):
            at = start[some, None] + np.arange(len(words))
            inside = (at >= w.first[doc_[some], None]) & (at < w.first[doc_[some] + 1, None])
            cover = ((t[np.where(inside, at, 0)] == words) & inside).sum(1) / len(words)
            for j in np.flatnonzero(cover >= COVER).tolist():
                doc, first = int(doc_[some[j]]), int(start[some[j]])
                a, z = max(w.first[doc], first - NEAR), min(w.first[doc + 1], first + len(words) + NEAR)
                if any(len(_stand(t[a:z], np.zeros(z - a, np.int8), p)) for p in index.phrases[i]):
                    out.append((doc, i, float(cover[j])))
    return out


def _scan(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for b in chunks(batches):
            w = Words(b.column("text"), PLAIN, lower=True)
            t = index.terms(w.hash)
            doc, n = w.doc_of(), len(w.n)
            base: list[set] = [set() for _ in range(n)]
            places = []
            for label, phrase in index.base:
                s = _stand(t, doc, phrase)
                places.append(s)
                for x in np.unique(doc[s]).tolist():
                    base[x].add(label)
            p = np.sort(np.concatenate(places))
            hits = np.bincount(doc[p], minlength=n)
            first, last = np.zeros(n, np.int64), np.zeros(n, np.int64)
            last[doc[p]] = p - w.first[doc[p]]
            first[doc[p[::-1]]] = (p - w.first[doc[p]])[::-1]
            score = np.array([1.0 if x else 0.0 for x in base])
            labels = [set(x) for x in base]
            at = np.flatnonzero(t >= 0)
            for x, i, cover in _aligned(index, t, w, at, doc[at]):
                labels[x].add(index.labels[i])
                score[x] = max(score[x], cover)
            text = pa.list_(pa.string())
            yield pa.record_batch(
                {
                    "id": b.column("id"),
                    "n_words": w.n.astype(np.int64),
                    "n_base": hits.astype(np.int64),
                    "first_word": pa.array(first, mask=hits == 0),
                    "last_word": pa.array(last, mask=hits == 0),
                    "base_labels": pa.array([sorted(x) for x in base], text),
                    "labels": pa.array([sorted(x) for x in labels], text),
                    "score": score,
                }
            )

    return run


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, n_base, first_word, last_word, base_labels, labels (arrays), score: 1 with a base label, else the best cover."""
    slim = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    kind = slim.schema["id"].dataType.simpleString()
    index = _Index()
    counts = slim.select("text").mapInArrow(_count(index), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()  # one row for each word of the templates
    index.by_idf({r["term"]: r["n"] for r in counts})
    shared = docs.sparkSession.sparkContext.broadcast(index)
    return slim.mapInArrow(_scan(shared), f"id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels array<string>, labels array<string>, score double")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan_licenses(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_base", "first_word", "last_word", F.concat_ws(",", "base_labels").alias("base_labels"), F.concat_ws(",", "labels").alias("labels"), "score")
