"""Operator 8, token-id output: frequency-ranked ids in a byte-aligned code with separate control bytes.

Ids are numbered from the most frequent down (ties: smaller id first), so most take one byte. Of every four numbers a
control byte holds the lengths (two bits each: 1 to 4 bytes), and their bytes follow in a stream of their own. A folder
holds `blocks`, Parquet parts in ascending id order (null first), and `ranks`, the table of ids by rank, so the files
can be read by themselves. A block holds whole documents: their ids, token counts, control and data streams. numpy
decodes a block by looking up each control byte's four lengths in a table.

Texts are encoded once, into a written table of plain ids; counting reads that, and only the ids are shuffled, by range of
document id.

Defined results: null and empty texts give the end id alone; repeated ids stand together; extra columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._core import CLEANUP, chunks, cut, lists, shared_dir, table, utf8
from .tokens import Encoder, cached

VOCABULARY, END = "byte_bpe_50k.json", 0
BLOCK_IDS = 1 << 18
#: Lengths of the four numbers of each control byte.
_LENGTHS = np.array([[(c >> s & 3) + 1 for s in (0, 2, 4, 6)] for c in range(256)])


def pack(v: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data streams of numbers below 2**32."""
    v = v.astype("<u4")
    n = 1 + (v > 0xFF).astype(np.uint8) + (v > 0xFFFF) + (v > 0xFFFFFF)
    code = np.zeros(-(-len(v) // 4) * 4, np.uint8)
    code[: len(v)] = n - 1
    code = code.reshape(-1, 4)
    control = code[:, 0] | code[:, 1] << 2 | code[:, 2] << 4 | code[:, 3] << 6
    raw = v.view(np.uint8).reshape(-1, 4)
    return control.astype(np.uint8).tobytes(), raw[np.arange(4) < n[:, None]].tobytes()


def unpack(control: bytes, data: bytes, count: int) -> np.ndarray:
    n = _LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:count]
    at = np.cumsum(n) - n
    raw = np.frombuffer(data + b"\0\0\0", np.uint8)
    out = np.zeros(count, np.uint32)
    for k in range(4):
        more = n > k
        out[more] |= raw[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def _binary(data: bytes, lengths: np.ndarray) -> pa.Array:
    off = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=off[1:])
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(off), pa.py_buffer(data)])


def _coded(path: str, end: int):
    """Every document's ids, the end id last, as unsigned numbers of two bytes, or four for a larger vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = cached(Encoder, path)
        kind = _width(max(tool.size, end + 1))
        for b in chunks(batches):
            ids, n = tool.encode(b.column("text"))
            full = np.insert(ids, np.cumsum(n), end).astype(kind)
            yield pa.record_batch({"id": b.column("id"), "n": n + 1, "raw": _binary(full.tobytes(), (n + 1) * full.itemsize)})

    return run


def _width(size: int) -> str:
    return "<u2" if size <= 1 << 16 else "<u4"


def _tally(kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for b in batches:
            t = np.bincount(utf8(b.column("raw"))[0].view(kind))
            if len(t) < len(total):
                t, total = total, t
            t[: len(total)] += total
            total = t
        some = np.flatnonzero(total)
        yield pa.record_batch({"token": some, "n": total[some]})

    return run


def _blocks(shared, kind: str):
    """Consecutive documents in blocks, ids by rank; before: ids of earlier blocks of this file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, part, before = shared.value, TaskContext.get().partitionId(), 0
        for b in batches:
            n = np.asarray(b.column("n"))
            ids, ends = utf8(b.column("raw"))[0].view(kind), np.concatenate([[0], np.cumsum(n)])
            lo = 0
            while lo < len(n):
                hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + BLOCK_IDS, "right")) - 1)
                count = int(ends[hi] - ends[lo])
                control, data = pack(rank[ids[ends[lo] : ends[hi]]])
                yield pa.record_batch({"part": [part], "before": [before], "count": [count], "ids": pa.ListArray.from_arrays(pa.array([0, hi - lo], pa.int32()), b.column("id").slice(lo, hi - lo)), "lengths": lists(n[lo:hi].astype(np.int64), np.array([hi - lo])), "control": pa.array([control], pa.binary()), "data": pa.array([data], pa.binary())})
                before, lo = before + count, hi

    return run


def write_tokens(docs: DataFrame, path: str, out: str, id_col: str = "doc_id", text_col: str = "text", end: int = END) -> None:
    """Write the files under `out`."""
    spark = docs.sparkSession
    slim = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    kind = slim.schema["id"].dataType.simpleString()
    coded = cut(slim.mapInArrow(_coded(path, end), f"id {kind}, n long, raw binary"), "coded")
    width = _width(max(cached(Encoder, path).size, end + 1))
    counts = coded.select("raw").mapInArrow(_tally(width), "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()  # one row a token of the vocabulary
    freq = np.zeros(max([end, *(r["token"] for r in counts)]) + 1, np.int64)
    for r in counts:
        freq[r["token"]] = r["n"]
    by_rank = np.argsort(-freq, kind="stable").astype(np.uint32)
    rank = np.empty(len(by_rank), np.uint32)
    rank[by_rank] = np.arange(len(by_rank), dtype=np.uint32)
    files = coded.repartitionByRange("id").sortWithinPartitions("id", "n", "raw").mapInArrow(_blocks(spark.sparkContext.broadcast(rank), width), f"part long, before long, count long, ids array<{kind}>, lengths array<long>, control binary, data binary")
    saved = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        files.write.option("compression", "none").parquet(f"{out}/blocks")
    finally:
        spark.conf.set(CLEANUP, saved)
    # As many rows as the vocabulary has ids.
    spark.createDataFrame(pa.table({"rank": np.arange(len(by_rank)), "token": by_rank.astype(np.int64)})).write.parquet(f"{out}/ranks")


def ranks(spark: SparkSession, out: str) -> np.ndarray:
    """Ids by rank, as many as the vocabulary has."""
    rows = spark.read.parquet(f"{out}/ranks").orderBy("rank").toArrow()
    return np.asarray(rows["token"].combine_chunks()).astype(np.uint32)


def placed(spark: SparkSession, out: str) -> DataFrame:
    """The blocks of the files, each with the number of ids in all files before its own."""
    blocks = spark.read.parquet(f"{out}/blocks")
    whole = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    parts = blocks.groupBy("part").agg(F.sum("count").alias("in_part")).select("part", F.coalesce(F.sum("in_part").over(whole), F.lit(0)).alias("base"))
    return blocks.join(F.broadcast(parts), "part")


def _documents(shared):
    """Blocks -> documents: id, start (ids of all documents before), ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                n = np.asarray(b.column("lengths")[i].values)
                ids = shared.value[unpack(b.column("control")[i].as_py(), b.column("data")[i].as_py(), int(n.sum()))]
                start = b.column("base")[i].as_py() + b.column("before")[i].as_py() + np.cumsum(n) - n
                yield pa.record_batch({"id": b.column("ids")[i].values, "start": start, "ids": lists(ids.astype(np.int32), n)})

    return run


def read_tokens(spark: SparkSession, out: str) -> DataFrame:
    """id, start, ids: one row a document."""
    blocks = placed(spark, out)
    kind = blocks.schema["ids"].dataType.elementType.simpleString()
    return blocks.mapInArrow(_documents(spark.sparkContext.broadcast(ranks(spark, out))), f"id {kind}, start long, ids array<int>")


def digests(spark: SparkSession, out: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of what `read_tokens` gives, without carrying the ids out of the task."""
    blocks = placed(spark, out)
    kind = blocks.schema["ids"].dataType.elementType.simpleString()
    read = _documents(spark.sparkContext.broadcast(ranks(spark, out)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in read(batches):
            n = b.column("ids").value_lengths().to_numpy(zero_copy_only=False)
            raw = memoryview(np.asarray(b.column("ids").flatten()).astype("<u4").tobytes())
            ends = np.concatenate([[0], np.cumsum(n)]) * 4
            yield pa.record_batch({"doc_id": b.column("id"), "start": b.column("start"), "n_tokens": n.astype(np.int64), "ids_crc32": pa.array([zlib.crc32(raw[x:y]) for x, y in zip(ends.tolist(), ends[1:].tolist(), strict=False)], pa.int64())})

    return blocks.mapInArrow(run, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), out)
    return digests(spark, out)
