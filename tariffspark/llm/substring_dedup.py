"""Operator 1, substring dedup by level-wise doubling.

A window of W words (35) is removed where its word sequence also starts anywhere else.

1. Anchors of 9 words. Among the 9-word runs of every W-word window the one of least hash is chosen, so equal
   windows choose equal anchors and about one position in fourteen is indexed. Anchors found once end here.
2. Windows of W words that start at repeated anchors are compared; those that repeat are extended to twice that length,
   those that repeat again to four times, and so on until no candidate survives. A level reads only the documents that
   hold a survivor of the level before with room for more. Repeated spans settle the words they cover, and of each
   span of 2 W words or more one occurrence stands for all.
3. Words not settled yet (the edges of repeated stretches): every window with a repeated anchor and an unsettled word is
   compared one by one.

All levels are counts by hash with map-side sums, and joins to written tables, which Spark can split where a key
is hot. Positions are gathered per document only, never per hash.

Defined results: null and empty texts have no words; nothing is removed from texts under W words; identical rows
count as each other's copies; every input row gives one output row; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ._core import Spans, Words, chunks, cut, key_cols, mix, ragged, sequences, signed, table

WINDOW, ANCHOR = 35, 9


def _chosen(h: np.ndarray, first: np.ndarray, n: np.ndarray, window: int, k: int) -> tuple[np.ndarray, np.ndarray, Spans]:
    """Starts of all windows inside documents, and the anchor that each of them chooses."""
    spans = Spans(h)
    doc, at = ragged(np.maximum(n - window + 1, 0))
    starts = first[:-1][doc] + at
    if not len(starts):
        return starts, starts, spans
    g = spans.at(np.arange(len(h) - k + 1), k)
    least = sliding_window_view(g, window - k + 1).argmin(1)
    return starts, starts + least[starts], spans


def _half(h: np.ndarray) -> np.ndarray:
    """32 bits of an independent hash."""
    return (h >> np.uint64(33)).astype(np.int32)


def _anchors(window: int, k: int):
    """Of each anchor: its hash g, where it stands and how many words follow; and the hash of the window there (h, h2), if
    it fits. A whole text is one more row, at -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            w = Words(b.column("text"))
            starts, chosen, spans = _chosen(w.hash, w.first, w.n, window, k)
            if not len(starts):
                continue
            a = np.unique(chosen)
            doc = np.searchsorted(w.first, a, "right") - 1
            fit = a + window <= w.first[doc + 1]
            second = w.second()
            h, h2 = np.zeros(len(a), np.uint64), np.zeros(len(a), np.uint64)
            h[fit], h2[fit] = spans.at(a[fit], window), Spans(second).at(a[fit], window)
            whole = np.flatnonzero(w.n >= window)
            words = np.repeat(w.n >= window, w.n)
            all_h, all_2 = sequences(w.hash[words], w.n[whole]), sequences(second[words], w.n[whole])
            d, none = np.concatenate([doc, whole]), np.zeros(len(whole), bool)
            yield pa.record_batch(
                {
                    "g": signed(np.concatenate([spans.at(a, k), mix(all_h, 3)])),
                    "h": pa.array(signed(np.concatenate([h, all_h])), mask=np.concatenate([~fit, none])),
                    "h2": _half(np.concatenate([h2, all_2])),
                    "pos": np.concatenate([a - w.first[doc], none - 1]).astype(np.int32),
                    "room": np.concatenate([w.first[doc + 1] - a, none * 0]).astype(np.int32),
                    "kd": b.column("kd").take(pa.array(d)),
                    "kh": b.column("kh").take(pa.array(d)),
                }
            )

    return run


def _longer(length: int):
    """Windows of this length at the places `at` of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            w, at = Words(b.column("text")), b.column("at")
            doc = np.repeat(np.arange(len(at)), at.value_lengths().to_numpy(zero_copy_only=False))
            pos = np.asarray(at.flatten())
            a, take = pos + w.first[doc], pa.array(doc)
            yield pa.record_batch(
                {
                    "h": signed(Spans(w.hash).at(a, length)),
                    "h2": _half(Spans(w.second()).at(a, length)),
                    "pos": pos,
                    "room": (w.first[doc + 1] - a).astype(np.int32),
                    "kd": b.column("kd").take(take),
                    "kh": b.column("kh").take(take),
                }
            )

    return run


def _marks(v: np.ndarray, n: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of one document, from its level rows (pos + 1, level, flag): repeated anchors, settled words, and the windows that
    lie in a longer repeated span whose standing occurrence is elsewhere (away) or here."""
    pos, level, flag = (v >> 7) - 1, (v >> 2) & 31, v & 3
    size = n - window + 1
    rep = np.zeros(n, bool)
    rep[pos[pos >= 0]] = True
    word, away, here = np.zeros(n + 1, np.int64), np.zeros(size + 1, np.int64), np.zeros(size + 1, np.int64)
    on = flag > 0
    p, length = np.maximum(pos[on], 0), np.where(pos[on] < 0, n, window << level[on])
    np.add.at(word, p, 1)
    np.add.at(word, p + length, -1)
    wide = (level[on] > 0) | (pos[on] < 0)
    for mask, to in ((wide & (flag[on] == 1), away), (wide & (flag[on] == 2), here)):
        np.add.at(to, p[mask], 1)
        np.add.at(to, p[mask] + length[mask] - window + 1, -1)
    return rep, np.cumsum(word)[:n] > 0, np.cumsum(away)[:size] > 0, np.cumsum(here)[:size] > 0


def _windows(window: int, k: int):
    """Windows still open: with the row's key where their own words are unsettled, else as bare evidence for others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            w = Words(b.column("text"))
            starts, chosen, spans = _chosen(w.hash, w.first, w.n, window, k)
            second = Spans(w.second())
            marks, at = b.column("marks"), 0
            ask, show, doc_of = [], [], []
            for d, n in enumerate(w.n):
                size = max(int(n) - window + 1, 0)
                own, at = slice(at, at + size), at + size
                v = marks[d].values
                if not size or v is None:
                    continue
                rep, settled, away, here = _marks(np.asarray(v), int(n), window)
                open_ = rep[chosen[own] - w.first[d]]
                done = np.concatenate([[0], np.cumsum(settled)])
                mine = open_ & (done[window:] - done[:-window] < window)
                ask.append(starts[own][mine])
                doc_of.append(np.full(int(mine.sum()), d))
                show.append(starts[own][open_ & ~mine & (here | ~away)])
            if not ask:
                continue
            q, s, d = np.concatenate(ask), np.concatenate(show), np.concatenate(doc_of)
            both, none = np.concatenate([q, s]), len(s)
            take = pa.array(np.concatenate([d, np.zeros(none, np.int64)]), mask=np.concatenate([np.zeros(len(q), bool), np.ones(none, bool)]))
            yield pa.record_batch(
                {
                    "w1": signed(spans.at(both, window)),
                    "w2": _half(second.at(both, window)),
                    "pos": pa.array(np.concatenate([q - w.first[d], np.zeros(none, np.int64)]).astype(np.int32)),
                    "kd": b.column("kd").take(take),
                    "kh": b.column("kh").take(take),
                }
            )

    return run


def _kept(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            w = Words(b.column("text"), hashes=False)
            marks, found = b.column("marks"), b.column("found")
            removed, text = [], []
            for d, n in enumerate(w.n):
                v, f, n = marks[d].values, found[d].values, int(n)
                gone = _marks(np.asarray(v), n, window)[1] if v is not None and n >= window else np.zeros(n, bool)
                if f is not None:
                    at = np.zeros(n + 1, np.int64)
                    np.add.at(at, np.asarray(f), 1)
                    np.add.at(at, np.asarray(f) + window, -1)
                    gone = gone | (np.cumsum(at)[:n] > 0)
                removed.append(int(gone.sum()))
                lo = w.first[d]
                keep = np.flatnonzero(~gone) + lo
                raw = w.buf
                text.append(b" ".join(raw[s:e].tobytes() for s, e in zip(w.start[keep].tolist(), w.end[keep].tolist(), strict=True)) if removed[-1] else None)
                if text[-1] is None:
                    text[-1] = b" ".join(raw[w.off[d] : w.off[d + 1]].tobytes().split())
            yield pa.record_batch(
                {
                    "row": b.column("row"),
                    "n_words": w.n.astype(np.int64),
                    "n_removed": pa.array(removed, pa.int64()),
                    "kept_text": pa.array(text, pa.binary()).cast(pa.string()),
                }
            )

    return run


def levels(slim: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> tuple[DataFrame, list[DataFrame]]:
    """Repeated anchors (kd, kh, pos), and for each level the spans at them that repeat (kd, kh, pos, flag); flag 2 is the
    occurrence that stands for all, 1 the others. Level i has spans of window * 2**i words; pos -1 is a whole text."""
    rows = slim.mapInArrow(_anchors(window, anchor), "g long, h long, h2 int, pos int, room int, kd long, kh long")
    again = cut(rows.groupBy("g").agg(F.count("*").alias("m")).where("m > 1").select("g"), "anchors")
    anchors = cut(rows.join(again, "g", "left_semi"), "repeated")
    found, length, spans = [], window, anchors.where("h is not null").drop("g")
    while True:
        held = cut(spans.groupBy("h", "h2").agg(F.count("*").alias("m"), F.min(F.struct("kd", "kh", "pos")).alias("one")).where("m > 1").drop("m"), "held")
        flag = F.when(F.struct("kd", "kh", "pos") == F.col("one"), 2).otherwise(1)
        repeated = cut(spans.join(held, ["h", "h2"]).select("kd", "kh", "pos", "room", flag.alias("flag")), f"spans-{length}")
        found.append(repeated.drop("room"))
        length *= 2
        more = repeated.where(F.col("room") >= length)
        if more.isEmpty():
            return anchors.select("kd", "kh", "pos"), found
        at = more.groupBy("kd", "kh").agg(F.collect_set("pos").alias("at"))
        spans = cut(slim.join(at, ["kd", "kh"]).mapInArrow(_longer(length), "h long, h2 int, pos int, room int, kd long, kh long"), f"windows-{length}")


def _coded(anchors: DataFrame, found: list[DataFrame]) -> DataFrame:
    """kd, kh, marks: of each document with repeated anchors, its level rows as (pos + 1) * 128 + level * 4 + flag."""
    place = (F.col("pos").cast("long") + 1) * 128
    rows = anchors.select("kd", "kh", place.alias("code"))
    for level, spans in enumerate(found):
        rows = rows.unionByName(spans.select("kd", "kh", (place + level * 4 + F.col("flag")).alias("code")))
    return rows.groupBy("kd", "kh").agg(F.collect_list("code").alias("marks"))


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """row (a struct of the input's columns but the text), n_words, n_removed, kept_text (kept words joined by one
    space): one row per input row."""
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col])
    slim = docs.select(rest.alias("row"), F.col(f"`{text_col}`").alias("text"), *key_cols(id_col, text_col))
    marks = cut(_coded(*levels(slim.select("text", "kd", "kh"), window, anchor)), "marks")
    open_ = cut(slim.select("text", "kd", "kh").join(marks, ["kd", "kh"]).mapInArrow(_windows(window, anchor), "w1 long, w2 int, pos int, kd long, kh long"), "windows")
    again = cut(open_.groupBy("w1", "w2").agg(F.count("*").alias("m")).where("m > 1").drop("m"), "windows-again")
    found = open_.where("kd is not null").join(again, ["w1", "w2"], "left_semi").groupBy("kd", "kh").agg(F.collect_list("pos").alias("found"))
    cover = cut(marks.join(found, ["kd", "kh"], "full"), "cover")
    out = slim.join(cover, ["kd", "kh"], "left").select("row", "text", "marks", "found")
    kinds = StructType([slim.schema["row"], StructField("n_words", LongType()), StructField("n_removed", LongType()), StructField("kept_text", StringType())])
    return out.mapInArrow(_kept(window), kinds)


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """id, pos, n_words: the longest doubled length window * 2**i at which the span starting at an anchor still repeats."""
    slim = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), *key_cols(id_col, text_col))
    _, found = levels(slim.select("text", "kd", "kh"), window)
    rows = [x.where("pos >= 0").select("kd", "kh", "pos", F.lit(window << i).alias("n_words")) for i, x in enumerate(found)]
    best = reduce(DataFrame.unionByName, rows).groupBy("kd", "kh", "pos").agg(F.max("n_words").alias("n_words"))
    return slim.select("id", "kd", "kh").join(best, ["kd", "kh"]).select("id", "pos", "n_words")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_substrings(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(F.col("row.doc_id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


#: Windows compared as strings; nothing of the hashing above.
OP1_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
wins AS (SELECT doc_id, s, array_to_string(ws[s:s + 34], ' ') AS win
         FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS s FROM w WHERE len(ws) >= 35)),
rep AS (SELECT win FROM wins GROUP BY win HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 35)) AS p FROM wins WHERE win IN (SELECT win FROM rep)),
words AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w WHERE len(ws) > 0),
kept AS (SELECT a.doc_id, count(*) AS n_kept, string_agg(a.word, ' ' ORDER BY a.p) AS t
         FROM words a LEFT JOIN gone g ON a.doc_id = g.doc_id AND a.p = g.p WHERE g.p IS NULL GROUP BY a.doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n_kept, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept k ON w.doc_id = k.doc_id
"""
