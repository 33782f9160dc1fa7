"""Operator 7, sharding by extendible hashing.

Every row has BITS hash bits of its id and text. The directory starts with one bucket (no bits); only buckets over the
byte limit split on their next bit, until each fits or holds rows of one hash only. Bytes are summed once, by prefixes
about SPREAD times finer than the shards need; the directory is split on those sums, level by level. Only rows of a prefix
that is still too large are summed again, by longer ones. Rows then join their bucket by prefix (the
buckets are broadcast if they are few), and `write_shards` writes each shard by itself.

Defined results: null and empty texts count OVERHEAD bytes; a row larger than the limit gets a shard of its own with rows
of the same hash, if any; each input row gives one output row; extra columns are ignored, and written.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._core import cut, shared_dir, table

LIMIT, OVERHEAD, BITS, SPREAD = 64 << 20, 16, 60, 64
#: Buckets that are broadcast at most (two numbers each); of more, rows and buckets are dealt by hash.
BROADCAST = 200_000


def _hash(id_col: str, text_col: str):
    """BITS bits of the md5 of id and text, as a number."""
    name = F.concat(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")))
    return F.conv(F.substring(F.md5(name.cast("binary")), 1, BITS // 4), 16, 10).cast("long")


def _prefix(h, depth):
    """The first bits of a hash as a number."""
    return F.shiftrightunsigned(h, BITS - depth) if depth else F.lit(0).cast("long")


def _bits():
    """A bucket's prefix as text."""
    return F.when(F.col("depth") > 0, F.substring(F.lpad(F.bin("prefix"), BITS, "0"), BITS + 1 - F.col("depth"), F.col("depth"))).otherwise("")


def directory(rows: DataFrame, limit: int = LIMIT) -> DataFrame:
    """depth, prefix (a number of so many bits), shard_bytes: the buckets. rows: h, n_bytes."""
    total = rows.agg(F.coalesce(F.sum("n_bytes"), F.lit(0)).alias("n")).collect()[0]["n"]
    top, deep, out = 0, min(BITS, max(1, (total * SPREAD // limit).bit_length())), []
    while True:
        fine = cut(rows.groupBy(_prefix(F.col("h"), deep).alias("fine")).agg(F.sum("n_bytes").alias("n_bytes"), F.min("h").alias("lo"), F.max("h").alias("hi")), "prefix-sums")
        for depth in range(top, deep + 1):
            sums = fine.groupBy(F.shiftrightunsigned("fine", deep - depth).alias("prefix")).agg(F.sum("n_bytes").alias("shard_bytes"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
            over = (F.col("shard_bytes") > limit) & (F.col("lo") != F.col("hi"))
            sums = cut(sums.withColumn("splits", over), "directory")
            out.append(sums.where("not splits").select(F.lit(depth).alias("depth"), "prefix", "shard_bytes"))
            splits = sums.where("splits").select("prefix")
            if splits.isEmpty():
                buckets = out[0]
                for more in out[1:]:
                    buckets = buckets.unionByName(more)
                return cut(buckets, "buckets")
            if depth < deep:
                fine = fine.join(splits, F.shiftrightunsigned("fine", deep - depth) == F.col("prefix"), "left_semi")
        rows = rows.join(splits, _prefix(F.col("h"), deep) == F.col("prefix"), "left_semi")
        top, deep = deep + 1, min(BITS, deep + 8)


def _placed(docs: DataFrame, limit: int, id_col: str, text_col: str) -> tuple[DataFrame, int]:
    """(what `shard` gives, the number of shards)."""
    size = F.coalesce(F.octet_length(F.col(f"`{text_col}`")), F.lit(0)).cast("long") + OVERHEAD
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), _hash(id_col, text_col).alias("h"), size.alias("n_bytes"))
    buckets = directory(rows.select("h", "n_bytes"), limit)
    # Buckets are ranges of hashes in order: a row's bucket is the one of its own prefix, at one of the depths in use.
    depths = [r["depth"] for r in buckets.select("depth").distinct().collect()]  # BITS + 1 at most
    names = F.array(*[F.struct(F.lit(d).alias("depth"), _prefix(F.col("h"), d).alias("prefix")) for d in sorted(depths)]) if depths else F.array().cast("array<struct<depth:int,prefix:bigint>>")
    n = buckets.count()
    if n <= BROADCAST:
        placed = rows.select("row", "n_bytes", F.explode(names).alias("x")).select("row", "n_bytes", "x.*").join(F.broadcast(buckets), ["depth", "prefix"])
        return placed.select("row", _bits().alias("shard"), "depth", "n_bytes", "shard_bytes"), n
    keys = rows.select("h").distinct().select("h", F.explode(names).alias("x")).select("h", "x.*")
    of = cut(keys.join(buckets, ["depth", "prefix"]), "buckets-of-hashes")
    return rows.join(of, "h").select("row", _bits().alias("shard"), "depth", "n_bytes", "shard_bytes"), n


def shard(docs: DataFrame, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row (a struct of the input's columns), shard (hash-prefix bits as text), depth (their number), n_bytes, shard_bytes."""
    return _placed(docs, limit, id_col, text_col)[0]


def write_shards(docs: DataFrame, out: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write one folder a shard (named by its bits, "all" for none) under `out`; gives what `read_shards` reads. There are
    as many tasks as shards, so a task writes one shard or a few, however large the corpus."""
    placed, n = _placed(docs, limit, id_col, text_col)
    named = placed.select("row", F.when(F.col("depth") == 0, "all").otherwise(F.concat(F.lit("b"), "shard")).alias("shard"))
    named.repartition(max(1, n), "shard").write.partitionBy("shard").option("compression", "zstd").parquet(out)
    return read_shards(docs.sparkSession, out, placed.schema["row"])


def read_shards(spark: SparkSession, out: str, row) -> DataFrame:
    """row, shard of each written row."""
    from pyspark.sql.types import StringType, StructField, StructType

    named = spark.read.schema(StructType([row, StructField("shard", StringType())])).parquet(out)
    return named.withColumn("shard", F.when(F.col("shard") == "all", "").otherwise(F.substring("shard", 2, BITS)))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = write_shards(docs, f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}")
    size = F.coalesce(F.octet_length("row.text"), F.lit(0)).cast("long") + OVERHEAD
    rows = rows.select(F.col("row.doc_id").alias("doc_id"), "shard", F.length("shard").alias("depth"), size.alias("n_bytes"))
    sums = rows.groupBy("shard").agg(F.sum("n_bytes").alias("shard_bytes"))
    return rows.join(sums, "shard").select("doc_id", "shard", "depth", "n_bytes", "shard_bytes")


def oracle(limit: int = LIMIT) -> str:
    """Every prefix of every document's bits; a document's shard is its shortest prefix that fits."""
    return f"""
WITH d AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) + {OVERHEAD} AS n_bytes,
                  right(lpad(bin(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, {BITS // 4}) AS BIGINT)), 64, '0'), {BITS}) AS bits
           FROM documents),
p AS (SELECT doc_id, n_bytes, bits, depth, substr(bits, 1, depth) AS shard FROM d, range({BITS + 1}) AS r(depth)),
sums AS (SELECT depth, shard, sum(n_bytes) AS shard_bytes FROM p GROUP BY depth, shard HAVING sum(n_bytes) <= {limit} OR min(bits) = max(bits)),
fits AS (SELECT p.doc_id, p.bits, min(p.depth) AS depth FROM p JOIN sums s ON p.depth = s.depth AND p.shard = s.shard GROUP BY p.doc_id, p.bits)
SELECT p.doc_id, p.shard, CAST(p.depth AS INTEGER) AS depth, CAST(p.n_bytes AS BIGINT) AS n_bytes, CAST(s.shard_bytes AS BIGINT) AS shard_bytes
FROM fits f JOIN p ON p.doc_id IS NOT DISTINCT FROM f.doc_id AND p.bits = f.bits AND p.depth = f.depth
JOIN sums s ON s.depth = p.depth AND s.shard = p.shard
"""


OP7_SQL = oracle()
