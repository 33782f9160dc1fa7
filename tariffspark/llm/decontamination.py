"""Operator 2, benchmark decontamination by a distributed positional inverted index.

1. Test items give windows of 13 consecutive words (a shorter item is one window). Pairs of window and item are read in
   blocks of about BLOCK pairs, and each block is broadcast; a larger benchmark takes more blocks, not larger ones.
2. One pass counts the test terms in all training texts, so each window knows its terms from rarest to most frequent.
3. One pass stores the inverted index in segments of some thousand documents: for each test term its postings, documents
   and positions in order. Documents in which no window has its two rarest terms hold no match and store no postings.
4. In every segment the offset-adjusted lists are intersected from the rarest term on; what is left after the
   last term is an exact phrase match. Windows whose two rarest terms come within SLOP window lengths are near matches.

Documents are never shuffled, so no term, document or passage can overload a task.

Defined results: null and empty texts have no words and are clean; items without words are ignored; an item whose id is
null is matched but not listed; repeated items count once; each input row gives one output row; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._core import PLAIN, Words, chunks, cut, key_cols, lists, ragged, sequences, signed, table

WINDOW, BLOCK, SLOP = 13, 100_000, 2


def _test_windows(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            w = Words(b.column("text"), PLAIN, lower=True)
            if not len(w.start):
                continue
            size = np.minimum(w.n, window)
            doc, at = ragged(np.where(w.n > 0, w.n - size + 1, 0))
            start, n = w.first[:-1][doc] + at, size[doc]
            flat, place = ragged(n)
            words = w.hash[start[flat] + place]
            yield pa.record_batch({"item": b.column("item").take(pa.array(doc)), "h": signed(sequences(words, n)), "terms": lists(signed(words), n)})

    return run


class _Block:
    """Windows of one block: terms (sorted hashes), and per window its terms and their order, rarest first."""

    def __init__(self, rows: list):
        self.items = [sorted({i for i in r["items"] if i is not None}) for r in rows]
        words = [np.array(r["terms"], np.int64).view(np.uint64) for r in rows]
        self.terms = np.unique(np.concatenate(words))
        self.n = np.array([len(x) for x in words])
        self.ids = np.full((len(rows), max(self.n)), -1, np.int32)
        for i, x in enumerate(words):
            self.ids[i, : len(x)] = np.searchsorted(self.terms, x)

    def rank(self, counts: dict[int, int]) -> None:
        c = np.array([counts.get(int(t), 0) for t in self.terms.view(np.int64)] + [2**62])
        cost = c[self.ids]
        self.order = np.argsort(cost, axis=1, kind="stable")
        live = cost.min(axis=1) > 0
        second = np.minimum(1, self.n - 1)
        rows = np.arange(len(self.n))
        self.t1, self.t2 = self.ids[rows, self.order[:, 0]], self.ids[rows, self.order[rows, second]]
        self.o1, self.o2 = self.order[:, 0], self.order[rows, second]
        by = np.flatnonzero(live)
        by = by[np.argsort(self.t1[by], kind="stable")]
        self.by_term = by
        self.from_ = np.searchsorted(self.t1[by], np.arange(len(self.terms) + 1))

    def seek(self) -> None:
        """A table that rules out most words by 20 bits of their hash."""
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.terms & np.uint64(0xFFFFF)).astype(np.int64)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of test terms among h, and which term each is."""
        at = np.flatnonzero(self.maybe[(h & np.uint64(0xFFFFF)).astype(np.int64)])
        t = np.minimum(np.searchsorted(self.terms, h[at]), len(self.terms) - 1)
        ok = self.terms[t] == h[at]
        return at[ok], t[ok]


def _count(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, total = shared.value, None
        for b in chunks(batches):
            _, t = block.find(Words(b.column("text"), PLAIN, lower=True).hash)
            c = np.bincount(t, minlength=len(block.terms))
            total = c if total is None else total + c
        if total is not None:
            some = np.flatnonzero(total)
            yield pa.record_batch({"term": signed(block.terms[some]), "n": total[some]})

    return run


def _candidates(block: _Block, at: np.ndarray, t: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(window, place of its rarest term) for the windows whose second term is somewhere in the same document."""
    per = block.from_[t + 1] - block.from_[t]
    src, place = ragged(per)
    win = block.by_term[block.from_[t[src]] + place]
    key = doc.astype(np.int64) * len(block.terms)
    ok = np.isin(key[src] + block.t2[win], np.unique(key + t))
    return win[ok], src[ok]


def _postings(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        for b in chunks(batches):
            w = Words(b.column("text"), PLAIN, lower=True)
            at, t = block.find(w.hash)
            doc = np.searchsorted(w.first, at, "right") - 1
            _, src = _candidates(block, at, t, doc)
            held = np.zeros(len(w.n), bool)
            held[doc[src]] = True
            keep = held[doc]
            at, t, doc = at[keep], t[keep], doc[keep]
            order = np.lexsort((at, doc, t))
            at, t, doc = at[order], t[order], doc[order]
            terms, starts = np.unique(t, return_index=True)
            one = {"ids": b.column("id"), "kds": b.column("kd"), "khs": b.column("kh"), "n_words": w.n, "terms": terms, "starts": starts, "docs": doc, "places": at - w.first[doc]}
            yield pa.record_batch({c: _whole(x) for c, x in one.items()})

    return run


def _whole(x) -> pa.ListArray:
    """All values as the list of one row."""
    x = x if isinstance(x, pa.Array) else pa.array(x.astype(np.int32))
    return pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)


def _match(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                yield one(shared.value, {c: b.column(c)[i].values for c in b.schema.names})

    def one(block: _Block, seg: dict) -> pa.RecordBatch:
        n, at, doc = (np.asarray(seg[c]).astype(np.int64) for c in ("n_words", "places", "docs"))
        first = np.concatenate([[0], np.cumsum(n)])
        t = np.repeat(np.asarray(seg["terms"]).astype(np.int64), np.diff(np.append(np.asarray(seg["starts"]), len(at))))
        at = at + first[doc]
        term_at = np.full(first[-1], -1, np.int32)
        term_at[at] = t
        win, src = _candidates(block, at, t, doc)
        d, start = doc[src], at[src] - block.o1[win]
        # near: the closest place of the second term, by search in the sorted postings
        big = int(first[-1]) + 1
        keys = (t * len(n) + doc) * big + at
        want = (block.t2[win].astype(np.int64) * len(n) + d) * big + at[src]
        pos = np.searchsorted(keys, want)
        gap = np.full(len(win), big)
        if len(keys):
            for side in (np.minimum(pos, len(keys) - 1), np.maximum(pos - 1, 0)):
                gap = np.minimum(gap, np.where(keys[side] // big == want // big, np.abs(keys[side] % big - at[src]), big))
        near = gap <= SLOP * block.n[win]
        near_at = d[near], win[near]
        # exact: intersect from the rarest term on
        ok = (start >= first[d]) & (start + block.n[win] <= first[d + 1])
        win, d, start = win[ok], d[ok], start[ok]
        for r in range(block.ids.shape[1]):
            off = block.order[win, r]
            go = block.n[win] > r
            same = ~go
            same[go] = term_at[start[go] + off[go]] == block.ids[win[go], off[go]]
            win, d, start = win[same], d[same], start[same]
        cover = np.zeros(first[-1] + 1, np.int64)
        np.add.at(cover, start, 1)
        np.add.at(cover, start + block.n[win], -1)
        hit = np.flatnonzero(np.cumsum(cover)[:-1] > 0) if first[-1] else np.zeros(0, np.int64)
        hit_doc = np.searchsorted(first, hit, "right") - 1
        items: list[set] = [set() for _ in n]
        close: list[set] = [set() for _ in n]
        for to, (dd, ww) in ((items, (d, win)), (close, near_at)):
            for x, y in set(zip(dd.tolist(), ww.tolist(), strict=True)):
                to[x].update(block.items[y])
        text = pa.list_(pa.string())
        return pa.record_batch({"id": seg["ids"], "kd": seg["kds"], "kh": seg["khs"], "n_words": n, "hit": lists((hit - first[hit_doc]).astype(np.int32), np.bincount(hit_doc, minlength=len(n))), "items": pa.array([sorted(x) for x in items], text), "near": pa.array([sorted(x - y) for x, y in zip(close, items, strict=True)], text)})

    return run


def contamination(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """id, kd, kh (the row's key), n_words, hit (word numbers in occurrences of windows), items (their ids as sorted strings), near (items with near matches only)."""
    spark = docs.sparkSession
    slim = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), *key_cols(id_col, text_col))
    kind = slim.schema["id"].dataType.simpleString()
    tests = bench.select(F.col(f"`{item_col}`").cast("string").alias("item"), F.col("text")).dropDuplicates()
    pairs = cut(tests.mapInArrow(_test_windows(window), "item string, h long, terms array<long>").distinct(), "test-windows")
    blocks = max(1, -(-pairs.count() // block))
    parts = []
    for i in range(blocks):
        mine = pairs.where(F.pmod(F.xxhash64("h", "item"), F.lit(blocks)) == i)
        rows = mine.groupBy("h", "terms").agg(F.collect_set("item").alias("items")).orderBy("h", "terms").collect()  # about `block` pairs
        if not rows:
            continue
        x = _Block(rows)
        x.seek()
        seen = spark.sparkContext.broadcast(x)
        counts = slim.select("text").mapInArrow(_count(seen), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()  # test terms of one block
        x.rank({r["term"]: r["n"] for r in counts})
        ready = spark.sparkContext.broadcast(x)
        index = cut(slim.mapInArrow(_postings(ready), f"ids array<{kind}>, kds array<long>, khs array<long>, n_words array<int>, terms array<int>, starts array<int>, docs array<int>, places array<int>"), "postings")
        parts.append(index.mapInArrow(_match(ready), f"id {kind}, kd long, kh long, n_words long, hit array<int>, items array<string>, near array<string>"))
    if not parts:
        empty = F.array().cast("array<string>")
        counted = slim.mapInArrow(_only_words, f"id {kind}, kd long, kh long, n_words long")
        return counted.select("id", "kd", "kh", "n_words", F.array().cast("array<int>").alias("hit"), empty.alias("items"), empty.alias("near"))
    if len(parts) == 1:
        return parts[0]
    out = parts[0].withColumn("rows", F.lit(1))
    for p in parts[1:]:
        out = out.unionByName(p.withColumn("rows", F.lit(0)))
    merged = out.groupBy("kd", "kh").agg(F.first("id").alias("id"), F.first("n_words").alias("n_words"), F.array_distinct(F.flatten(F.collect_list("hit"))).alias("hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"), F.sum("rows").alias("rows"))
    return merged.select("id", "kd", "kh", "n_words", "hit", "items", F.array_sort(F.array_except("near", "items")).alias("near"), F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))).alias("_")).drop("_")


def _only_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in chunks(batches):
        yield pa.record_batch({"id": b.column("id"), "kd": b.column("kd"), "kh": b.column("kh"), "n_words": Words(b.column("text"), PLAIN, lower=True, hashes=False).n.astype(np.int64)})


def judged(found: DataFrame) -> DataFrame:
    """n_hit and contaminated: at least one hit, and hits are a twentieth of the words or more."""
    return found.withColumn("n_hit", F.size("hit").cast("long")).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def clean(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """The documents that are not contaminated, as they are."""
    bad = judged(contamination(docs, bench)).where("contaminated").select("kd", "kh").distinct()
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *key_cols("doc_id", "text"))
    return keyed.join(cut(bad, "contaminated"), ["kd", "kh"], "left_anti").select("row.*")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judged(contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


OP2_SQL = r"""
WITH lower_az AS (SELECT doc_id AS id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
d AS (SELECT id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM lower_az),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
bw AS (SELECT DISTINCT item, n, array_to_string(ws[s:s + n - 1], ' ') AS win
       FROM (SELECT item, ws, least(13, len(ws)) AS n, unnest(range(1, len(ws) - least(13, len(ws)) + 2)) AS s FROM b WHERE len(ws) > 0)),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT id, s, n, array_to_string(ws[s:s + n - 1], ' ') AS win
       FROM (SELECT id, ws, n, unnest(range(1, len(ws) - n + 2)) AS s FROM d, lens WHERE len(ws) >= n)),
m AS (SELECT id, s, dw.n, item FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n),
hits AS (SELECT id, count(DISTINCT p) AS n_hit FROM (SELECT id, unnest(range(s, s + n)) AS p FROM m) GROUP BY id),
its AS (SELECT id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT id, item FROM m) GROUP BY id)
SELECT d.id AS doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN hits ON d.id = hits.id LEFT JOIN its ON d.id = its.id
"""
