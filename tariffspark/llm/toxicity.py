"""Operator 3, toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features: words (ASCII letters lower-cased), pairs of neighbours, and pairs with one word between, hashed to 2**20
places, each counted once a document. The trainer keeps a step size for every coordinate; L1 leaves few weights,
which are broadcast (2**20 numbers at most, whatever the input).

Training reads labelled rows only, and at most about SAMPLE of them, chosen by a hash of the id; scoring reads all.

Defined results: null and empty texts score by the bias alone; a null id is never held out and never labelled; of labels
that differ for one id the larger counts; without any training rows every score is 0; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ._core import PLAIN, Words, chunks, crc_mod, lists, mix, table

BITS, SAMPLE, PASSES, THRESHOLD = 20, 12_000, 4, 0.3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 10.0, 1.0


def _features(arr: pa.Array) -> tuple[np.ndarray, np.ndarray, int]:
    """Feature numbers and their documents, in no order and with repeats."""
    w = Words(arr, PLAIN, lower=True)
    doc, h = w.doc_of(), w.hash
    idx, docs = [mix(h, 21)], [doc]
    for gap, salt in ((1, 22), (2, 23)):
        same = doc[gap:] == doc[:-gap]
        idx.append(mix(h[:-gap][same] * np.uint64(3) + mix(h[gap:][same], 5), salt))
        docs.append(doc[gap:][same])
    return (np.concatenate(idx) >> np.uint64(64 - BITS)).astype(np.int64), np.concatenate(docs), len(w.n)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in chunks(batches):
        idx, doc, n = _features(b.column("text"))
        key = np.unique((doc << BITS) | idx)
        yield pa.record_batch({"place": b.column("place"), "label": b.column("label"), "x": lists((key & ((1 << BITS) - 1)).astype(np.int32), np.bincount(key >> BITS, minlength=n))})


def ftrl(rows: list[tuple[np.ndarray, int]], passes: int = PASSES, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2) -> tuple[np.ndarray, float]:
    """Weights and bias (which bears no L1) after the given passes over (features, label) rows in order."""
    size = 1 << BITS
    z, n = np.zeros(size), np.zeros(size)
    bz = bn = 0.0
    for _ in range(passes):
        for x, y in rows:
            zx, nx = z[x], n[x]
            root = np.sqrt(nx)
            w = np.where(np.abs(zx) > l1, (np.sign(zx) * l1 - zx) / ((beta + root) / alpha + l2), 0.0)
            bias = -bz / ((beta + bn**0.5) / alpha)
            g = 1 / (1 + np.exp(-np.clip(w.sum() + bias, -30, 30))) - y
            new = nx + g * g
            z[x] = zx + g - (np.sqrt(new) - root) / alpha * w
            n[x] = new
            bz += g - ((bn + g * g) ** 0.5 - bn**0.5) / alpha * bias
            bn += g * g
    w = np.where(np.abs(z) > l1, (np.sign(z) * l1 - z) / ((beta + np.sqrt(n)) / alpha + l2), 0.0)
    return w, -bz / ((beta + bn**0.5) / alpha)


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = []
    for b in batches:
        x = b.column("x")
        rows += [(p, np.array(x[i].values, np.int32), y) for i, (p, y) in enumerate(zip(b.column("place").to_pylist(), b.column("label").to_pylist(), strict=True))]
    if rows:
        rows.sort(key=lambda r: (r[0], len(r[1]), r[2]))
        w, bias = ftrl([r[1:] for r in rows])
        at = np.flatnonzero(w)
        yield pa.record_batch({"at": pa.array([at.astype(np.int32)], pa.list_(pa.int32())), "w": pa.array([w[at]], pa.list_(pa.float64())), "bias": pa.array([bias])})


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray, float] | None:
    """(places, weights, bias), or None without labelled rows. The labels given here are all that is learned from."""
    known = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("label")).where("id is not null and label in (0, 1)").groupBy("id").agg(F.max("label").alias("label"))
    count = known.count()
    place = F.crc32(F.concat(F.lit("sample-"), F.col("id").cast("string")).cast("binary"))
    known = known.withColumn("place", place).where(F.col("place") < F.lit(int(2**32 * min(1.0, sample / max(count, 1)))))
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    rows = texts.join(F.broadcast(known), "id").select("text", "place", "label").mapInArrow(_rows, "place long, label int, x array<int>")  # `sample` rows of two numbers
    got = rows.repartition(1).mapInArrow(_fit, "at array<int>, w array<double>, bias double").collect()  # `sample` rows; 2**20 weights
    return (np.array(got[0]["at"]), np.array(got[0]["w"]), got[0]["bias"]) if got else None


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float] | None, text_col: str = "text") -> DataFrame:
    """row (a struct of the input's columns), score."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{text_col}`").alias("text"))
    if model is None:
        return rows.select("row", F.lit(0.0).alias("score"))
    dense = np.zeros(1 << BITS, np.float32)
    dense[model[0]] = model[1]
    shared, bias = docs.sparkSession.sparkContext.broadcast(dense), model[2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            idx, doc, n = _features(b.column("text"))
            some = np.flatnonzero(shared.value[idx])
            key = np.unique((doc[some] << BITS) | idx[some])
            total = np.bincount(key >> BITS, shared.value[key & ((1 << BITS) - 1)], minlength=n) + bias
            yield pa.record_batch({"row": b.column("row"), "score": 1 / (1 + np.exp(-np.clip(total, -30, 30)))})

    return rows.mapInArrow(run, StructType([rows.schema["row"], StructField("score", DoubleType())]))


def held_out(col):
    return F.coalesce(crc_mod(col, 4) == 2, F.lit(False))


def scored(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """row, score: learned from this table's labels outside the held-out quarter."""
    labels = table(spark, sf_dir, "labels")
    return score(docs, train(docs, labels.where(~held_out(F.col("doc_id")))))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = scored(spark, docs, sf_dir).select(F.col("row.doc_id").alias("doc_id"), "score")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
