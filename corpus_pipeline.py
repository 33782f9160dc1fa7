"""Documents through five stages: toxicity, near-duplicates, repeated substrings, benchmark passages, tokens.

Each stage reads all that the one before kept, as Parquet. The first four return the columns of documents; the last
returns, for each document that is left, its token count and digests of its ids and of the text they decode to.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tariffspark.llm import bpe, decontamination, near_dedup, substring_dedup, toxicity
from tariffspark.llm._core import cut, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold; the model learns from labelled documents of the input."""
    return toxicity.scored(spark, docs, sf_dir).where(F.col("score") < toxicity.THRESHOLD).select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (0.8 or more of shingles of five words), the one of least id."""
    return near_dedup.one_of_each(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated windows; a text that loses nothing stays as it is. n_chars follows the text."""
    whole = "_" + max(docs.columns, key=len)  # no column of docs has this name
    out = substring_dedup.dedup_substrings(docs.withColumn(whole, F.col("text")))
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col(f"row.`{whole}`"))
    chars = F.when(F.col("n_removed") > 0, F.length("kept_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    new = {"text": text, "n_chars": chars}
    return out.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a substantial part in the benchmark."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and the text they decode to, as digests."""
    import public_tokenizers

    return bpe.digests(bpe.encode(docs, public_tokenizers.path(bpe.VOCABULARY)))


STAGES = [
    ("toxicity", drop_toxic),
    ("near-duplicates", drop_near_copies),
    ("repeated substrings", cut_repeats),
    ("decontamination", drop_contaminated),
    ("bpe", encode),
]

#: SQL cannot express the first stage; tests compare the rows with a plain version of every stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
