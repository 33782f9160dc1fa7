"""Operator 13, ranked lexical search by presence-mask grouping.

1. Items give pairs of item and term, taken in blocks of at most about BLOCK pairs, each broadcast; more items take more blocks.
2. One pass over the documents counts them and all their terms, and writes the postings of the block's terms: segments of
   some thousand documents with, term by term, the documents that hold it and how often.
3. In each segment, for each item, the bits of its terms over the segment's documents are put together into one mask a
   document: which terms it holds. Documents of equal masks form a group, whose score is at most the sum of the largest
   shares of its terms. Groups are scored by descending bound until no group left can reach the ten best scores so far,
   ties included; what was found in earlier segments of the task counts.
4. The best ten of each task meet in two window steps, so no task sees more than some thousand rows of an item.

Documents are never shuffled. Scores are 64-bit integers, so their order is exact; weights are floors of doubles.

Defined results: null and empty texts have no terms and are not counted in N; items without terms, or whose terms no document
holds, give no rows; texts of one item id are one item; a null item id is an item too; repeated documents rank one by
one; null document ids stand after others of equal score; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._core import PLAIN, Words, chunks, cut, lists, ragged, signed, table

TOP, BLOCK = 10, 100_000
#: Shares of terms that are held as one matrix (documents x terms of a segment): bounds a task's memory.
CELLS = 1 << 23


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in chunks(batches):
        w = Words(b.column("text"), PLAIN, lower=True)
        yield pa.record_batch({"item": b.column("item").take(pa.array(w.doc_of())), "term": signed(w.hash), "check": signed(w.second())})


class _Block:
    """Items of one block and their terms, numbered in order of their hashes."""

    def __init__(self, rows: list):
        self.items = [r["item"] for r in rows]
        pairs = [np.array([(t["term"], t["check"]) for t in r["terms"]], np.int64).reshape(-1, 2).view(np.uint64) for r in rows]
        both = np.unique(np.concatenate(pairs), axis=0)
        self.terms, self.checks = both[:, 0], both[:, 1]
        self.of = [np.sort(self._numbers(p[:, 0], p[:, 1])) for p in pairs]
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.terms & np.uint64(0xFFFFF)).astype(np.int64)] = True

    def _numbers(self, h: np.ndarray, check: np.ndarray) -> np.ndarray:
        """Term of each word, -1 for none; terms that share a hash stand side by side."""
        at = np.searchsorted(self.terms, h)
        out = np.full(len(h), -1)
        while True:
            ok = (at < len(self.terms)) & (self.terms[np.minimum(at, len(self.terms) - 1)] == h)
            if not ok.any():
                return out
            hit = ok & (self.checks[np.minimum(at, len(self.terms) - 1)] == check)
            out[hit] = at[hit]
            at = np.where(ok, at + 1, len(self.terms))

    def find(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """Document and term of each word that is a term."""
        at = np.flatnonzero(self.maybe[(w.hash & np.uint64(0xFFFFF)).astype(np.int64)])
        t = self._numbers(w.hash[at], w.second()[at])
        return w.doc_of()[at[t >= 0]], t[t >= 0]


def _postings(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        for b in chunks(batches):
            w = Words(b.column("text"), PLAIN, lower=True)
            doc, term = block.find(w)
            key, tf = np.unique(term.astype(np.int64) * len(w.n) + doc, return_counts=True)
            one = {"ids": b.column("id"), "sizes": w.n.astype(np.int64), "terms": (key // len(w.n)).astype(np.int32), "docs": (key % len(w.n)).astype(np.int32), "tf": tf.astype(np.int64)}
            yield pa.record_batch({c: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x if isinstance(x, pa.Array) else pa.array(x)) for c, x in one.items()})

    return run


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents that hold each term."""
    total = np.zeros(0, np.int64)
    for b in batches:
        n = np.bincount(np.asarray(b.column("terms").flatten()))
        if len(n) < len(total):
            n, total = total, n
        n[: len(total)] += total
        total = n
    some = np.flatnonzero(total)
    yield pa.record_batch({"term": some, "n": total[some]})


class _Best:
    """The best documents of one item so far: scores and rows, best first (ties by id, nulls last)."""

    def __init__(self, k: int):
        self.k, self.rows = k, []

    def least(self) -> int:
        """What a document must score to come in; ties may."""
        return self.rows[-1][0] if len(self.rows) == self.k else 1

    def add(self, scores: np.ndarray, ids: list) -> None:
        self.rows += [(s, i) for s, i in zip(scores.tolist(), ids, strict=True) if s >= self.least()]
        self.rows.sort(key=lambda x: (-x[0], x[1] is None, 0 if x[1] is None else x[1]))
        del self.rows[self.k :]


def by_masks(best: _Best, share: np.ndarray, held: np.ndarray, weight: np.ndarray, ids: pa.Array) -> int:
    """Add the documents of a segment to the best of an item; returns how many were scored. share, held: one row a term of
    the item, one column a document."""
    some = np.flatnonzero(held.any(axis=0))
    if not len(some):
        return 0
    masks = np.packbits(held[:, some], axis=0).T.copy()
    _, first, group, size = np.unique(masks.view(f"V{masks.shape[1]}").ravel(), return_index=True, return_inverse=True, return_counts=True)
    bound = (weight * share.max(axis=1)) @ held[:, some[first]]
    order = np.argsort(-bound, kind="stable")
    docs = some[np.argsort(group, kind="stable")]
    from_ = np.cumsum(size) - size
    at, step, scored = 0, 1, 0
    while at < len(order) and bound[order[at]] >= best.least():
        now = order[at : at + step]
        now = now[bound[now] >= best.least()]
        which, place = ragged(size[now])
        d = docs[from_[now][which] + place]
        score = weight @ share[:, d]
        good = score >= best.least()
        best.add(score[good], ids.take(pa.array(d[good])).to_pylist())
        scored, at, step = scored + len(d), at + step, step * 2
    return scored


def _rank(shared, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, weight, n_docs, n_terms = shared.value
        best, kind = [_Best(k) for _ in block.items], None
        for b in batches:
            kind = b.schema.field("ids").type.value_type
            for i in range(b.num_rows):
                seg = {c: b.column(c)[i].values for c in b.schema.names}
                n, t, d, tf = (np.asarray(seg[c]).astype(np.int64) for c in ("sizes", "terms", "docs", "tf"))
                m = 10 + 90 * n * n_docs // n_terms
                width = max(1, CELLS // max(1, len(np.unique(t))))
                for lo in range(0, len(n), width):
                    _segment(block, weight, best, seg["ids"].slice(lo, width), m[lo : lo + width], *(x[(d >= lo) & (d < lo + width)] for x in (t, d - lo, tf)))
        got = [(q, s, x) for q, held in enumerate(best) for s, x in held.rows]
        if got:
            q, s, x = zip(*got, strict=True)
            yield pa.record_batch({"q": pa.array(q, pa.int32()), "score": pa.array(s, pa.int64()), "id": pa.array(x, kind), "part": pa.array([TaskContext.get().partitionId() % 64] * len(q), pa.int32())})

    return run


def _segment(block: _Block, weight: np.ndarray, best: list[_Best], ids: pa.Array, m: np.ndarray, t: np.ndarray, d: np.ndarray, tf: np.ndarray) -> None:
    """All items over some documents of a segment."""
    terms, row = np.unique(t, return_inverse=True)
    share, held = np.zeros((len(terms), len(m)), np.int64), np.zeros((len(terms), len(m)), bool)
    share[row, d] = 1_000_000_000 * tf // (1000 * tf + 8 * m[d])
    held[row, d] = True
    for q, mine in zip(best, block.of, strict=True):
        mine = mine[np.isin(mine, terms, assume_unique=True) & (weight[mine] > 0)]
        if len(mine):
            at = np.searchsorted(terms, mine)
            by_masks(q, share[at], held[at], weight[mine], ids)


def search(docs: DataFrame, items: DataFrame, k: int = TOP, block: int = BLOCK, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item, rank (from 1), id, score: the k best documents of each item, by the contract's integer weights and shares."""
    spark = docs.sparkSession
    slim = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    asked = items.select(F.col(f"`{item_col}`").alias("item"), F.col(f"`{text_col}`").alias("text"))
    kind, asked_kind = (x.schema[0].dataType.simpleString() for x in (slim, asked))
    pairs = cut(asked.mapInArrow(_terms, f"item {asked_kind}, term long, check long").distinct(), "item-terms")
    blocks, found = max(1, -(-pairs.count() // block)), []
    for i in range(blocks):
        rows = pairs.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == i).groupBy("item").agg(F.collect_list(F.struct("term", "check")).alias("terms")).collect()  # about `block` pairs
        if not rows:
            continue
        x = _Block(rows)
        index = cut(slim.mapInArrow(_postings(spark.sparkContext.broadcast(x)), f"ids array<{kind}>, sizes array<long>, terms array<int>, docs array<int>, tf array<long>"), "postings")
        n_docs, n_terms = index.agg(F.sum(F.size(F.filter("sizes", lambda n: n > 0))), F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, b: a + b))).first()
        df = np.zeros(len(x.terms), np.int64)
        for r in index.select("terms").mapInArrow(_frequencies, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():  # terms of one block
            df[r["term"]] = r["n"]
        weight = np.floor(1000 * np.log((2 * (n_docs or 0) + 2) / (2 * df + 1))).astype(np.int64)
        seen = spark.sparkContext.broadcast((x, weight, n_docs or 0, n_terms or 1))
        named = spark.createDataFrame([(q, r["item"]) for q, r in enumerate(rows)], f"q int, item {asked_kind}")
        best = _first(index.mapInArrow(_rank(seen, k), f"q int, score long, id {kind}, part int"), ["q", "part"], k)
        found.append(_first(best, ["q"], k).join(F.broadcast(named), "q").select("item", "rank", "id", "score"))  # one row an item of the block
    if not found:
        return slim.select(F.lit(None).cast(asked_kind).alias("item"), F.lit(0).alias("rank"), "id", F.lit(0).cast("long").alias("score")).limit(0)
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def _first(rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select(F.col("item").alias("item_id"), "rank", F.col("id").alias("doc_id"), "score")


_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
OP13_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS ws FROM documents),
b AS (SELECT DISTINCT item_id, unnest({_WORDS}) AS term FROM benchmark),
c AS (SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(len(ws)) AS BIGINT) AS l FROM d WHERE len(ws) > 0),
t AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(ws) AS term FROM d) WHERE term IN (SELECT term FROM b) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * n + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM t, c GROUP BY term, n),
m AS (SELECT r, doc_id, 10 + (90 * len(ws) * n) // l AS m FROM d, c),
s AS (SELECT item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
      FROM b JOIN t USING (term) JOIN w USING (term) JOIN m USING (r) GROUP BY ALL HAVING sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 10
"""
