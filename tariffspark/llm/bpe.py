"""Operator 6, BPE encoding and decoding by forced-boundary splitting (see `tokens`).

Defined results: null and empty texts have no ids and decode to the empty text; each input row gives one output row;
extra columns are ignored. Documents are neither shuffled nor gathered.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._core import chunks, lists, table
from .tokens import Decoder, Encoder, cached

VOCABULARY = "word_bpe_49k.json"


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ids (array<int>), decoded (the text that these ids decode to)."""
    slim = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, back = cached(Encoder, path), cached(Decoder, path)
        for b in chunks(batches):
            ids, n = tool.encode(b.column("text"))
            yield pa.record_batch({"id": b.column("id"), "ids": lists(ids, n), "decoded": back.decode(ids, n)})

    return slim.mapInArrow(run, f"id {slim.schema['id'].dataType.simpleString()}, ids array<int>, decoded string")


def digests(found: DataFrame) -> DataFrame:
    return found.select(
        F.col("id").alias("doc_id"),
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(encode(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY)))
