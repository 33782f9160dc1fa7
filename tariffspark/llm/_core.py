"""Shared pieces: written tables that cut lineage, and vectorised word hashing over Arrow text buffers.

Words are found on UTF-8 bytes: every separator used here is ASCII, so byte rules and character rules agree.
A word hash mixes eight bytes at a time without any linear step across them, and a window hash pairs the hashes of its
halves, so no family of texts collides by its form. Results that rest on the identity of long texts use two
independent word hashes, 96 bits at least.
"""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes handled by one round of numpy work: bounds a Python worker's memory (a longer document goes alone).
CHUNK_BYTES = 1 << 21
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares (spark.checkpoint.dir); a temporary one only on a local master that sets none."""
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir")
    if path is None and sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return (path or sc.getCheckpointDir()).rstrip("/")


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, and the shuffle files behind it are released."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def key_cols(id_col: str, text_col: str) -> list[Column]:
    """kd, kh: 128 bits that name a row by id and text; rows equal in both share the key and, by design, their fate."""
    return [F.xxhash64(F.col(f"`{id_col}`")).alias("kd"), F.xxhash64(F.col(f"`{text_col}`"), F.lit("k")).alias("kh")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- text buffers -------------------------------------------------------------------------------------------

_M = 2**64


def mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """Finaliser of 64-bit hashes (splitmix)."""
    h = h + np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) % _M)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _lut(bad: str) -> np.ndarray:
    return np.isin(np.arange(256), np.frombuffer(bad.encode("latin-1"), np.uint8), invert=True)


#: Bytes of words that white space ends: [^\x20\x09-\x0D]+
SPACED = _lut("\x20\x09\x0a\x0b\x0c\x0d")
#: Bytes of words of ASCII letters, digits and everything beyond ASCII: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing
PLAIN = np.array([chr(b) in "0123456789abcdefghijklmnopqrstuvwxyz" or b >= 128 for b in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def utf8(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string array and the offsets of its values; null is empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if not len(arr):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if arr.null_count:
        arr = arr.fill_null("")
    wide = pa.types.is_large_string(arr.type)
    _, offs, data = arr.buffers()
    off = np.frombuffer(offs, np.int64 if wide else np.int32)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most CHUNK_BYTES of text each, one document at least."""
    for b in batches:
        n = b.num_rows
        _, off = utf8(b.column(column))
        i = 0
        while i < n:
            j = max(i + 1, int(np.searchsorted(off, off[i] + CHUNK_BYTES, "right")) - 1)
            yield b.slice(i, min(j, n) - i)
            i = min(j, n)


class Words:
    """Words of a slice of documents: start, end (byte offsets in buf), first (of each document, and the total), hash and,
    on demand, an independent second hash."""

    def __init__(self, arr: pa.Array, inside: np.ndarray = SPACED, lower: bool = False, hashes: bool = True):
        buf, off = utf8(arr)
        self.buf, self.off = (_LOWER[buf] if lower else buf), off
        isw = inside[self.buf]
        head = np.zeros(len(buf) + 1, bool)
        head[off] = True
        st, en = isw.copy(), isw.copy()
        if len(buf):
            st[1:] &= ~isw[:-1] | head[1:-1]
            en[:-1] &= ~isw[1:] | head[1:-1]
        self.start, self.end = np.flatnonzero(st), np.flatnonzero(en) + 1
        self.first = np.searchsorted(self.start, off)
        self.n = np.diff(self.first)
        if hashes:
            self.hash = span_hash(self.buf, self.start, self.end)

    def second(self) -> np.ndarray:
        return span_hash(self.buf, self.start, self.end, 1)

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.n)), self.n)


#: Bytes of a word that are mixed eight at a time; what is longer is hashed by blake2b.
SHORT = 64
_MASK = np.array([(1 << 8 * i) - 1 for i in range(8)] + [_M - 1], np.uint64)


def pair(a: np.ndarray, b: np.ndarray, salt: int = 0) -> np.ndarray:
    """Hash of two 64-bit hashes in order."""
    return mix(a * np.uint64(0xD1342543DE82EF95) + (b ^ b >> np.uint64(29)) * np.uint64(0xAF251AF3B0F025B5), salt)


def span_hash(buf: np.ndarray, start: np.ndarray, end: np.ndarray, salt: int = 0) -> np.ndarray:
    """64-bit hash of each byte span; hashes of two salts are independent."""
    n = end - start
    h = mix(n.astype(np.uint64), 101 + salt)
    eight = np.ndarray(len(buf), "<u8", np.concatenate([buf, np.zeros(8, np.uint8)]).tobytes(), strides=(1,))
    at, todo = 0, np.flatnonzero((n > 0) & (n <= SHORT))
    while len(todo):
        lane = eight[start[todo] + at] & _MASK[np.minimum(n[todo] - at, 8)]
        h[todo] = pair(h[todo], lane, salt)
        at += 8
        todo = todo[n[todo] > at]
    for i in np.flatnonzero(n > SHORT).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(buf[start[i] : end[i]], digest_size=8, salt=salt.to_bytes(8, "little")).digest(), "little")
    return h


def word_hash(word: str) -> int:
    b = np.frombuffer(word.encode(), np.uint8)
    return int(span_hash(b, np.array([0]), np.array([len(b)]))[0])


class Spans:
    """Hashes of k consecutive entries of h, for any start and k: halves are hashed in pairs, level by level."""

    def __init__(self, h: np.ndarray):
        self.levels = [h]

    def at(self, start: np.ndarray, k: int) -> np.ndarray:
        top = k.bit_length() - 1
        while len(self.levels) <= top:
            x, w = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(pair(x[:-w], x[w:], 51) if len(x) > w else x[:0])
        x = self.levels[top]
        return mix(x[start], 53) if k == 1 << top else pair(x[start], x[start + k - (1 << top)], 54 + k)


def sequences(h: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """One hash of each of the runs of these lengths (over 0) that h is laid out in, order included."""
    place = ragged(lengths)[1].astype(np.uint64)
    return pair(np.add.reduceat(mix(pair(h, place, 57)), np.cumsum(lengths) - lengths), lengths.astype(np.uint64), 58) if len(lengths) else np.zeros(0, np.uint64)


def ragged(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For groups of these lengths laid end to end: each entry's group and its place in the group."""
    group = np.repeat(np.arange(len(lengths)), lengths)
    return group, np.arange(len(group)) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def lists(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType | None = None) -> pa.ListArray:
    off = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=off[1:])
    return pa.ListArray.from_arrays(pa.array(off), pa.array(values, kind))


def crc_mod(col: Column, m: int) -> Column:
    """crc32 of the id as text, modulo m (null: null)."""
    return F.crc32(col.cast("string").cast("binary")) % F.lit(m)
