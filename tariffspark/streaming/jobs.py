"""Structured Streaming jobs (T01 - T06). Every source is a file stream; with availableNow they end by themselves."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..data import shared_dir, written
from ..functions import text as T
from ..operators.dedup import dedup_min_price, upsert_prices
from ..operators.match import normalize

#: How long a key's last price is kept, in days of record time: beyond the freshness horizon.
HORIZON_DAYS = 400


def ingest(stream: DataFrame, services: DataFrame, prices: PriceTable, checkpoint: str):
    """Each micro-batch of items (item_id, clinic_id, raw_name, source_type, price, valid_from) is normalized against
    the catalog snapshot, deduplicated and upserted by source priority, once: the table remembers the batch it has."""

    def one(batch: DataFrame, number: int) -> None:
        if number <= prices.last():
            return  # committed before the stream stopped; it is only delivered again
        matched, _, _ = normalize(batch.select("item_id", "raw_name"), services)
        rows = batch.join(matched.select("item_id", "service_id", F.col("confidence").alias("match_confidence")), "item_id").withColumnRenamed("item_id", "id")
        prices.upsert(dedup_min_price(rows), number)

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class PriceTable:
    """Prices under a shared folder, a row set a bucket of (clinic_id, service_id), changed by numbered batches.

    A batch rewrites only the buckets that it touches, under its own number (`data/batch=N/bucket=B`), and then writes one
    small file that says which batch holds each bucket (`commits/batch=N`); Spark puts its _SUCCESS mark there last. The
    highest marked commit is the table. A batch that was cut off leaves files that no commit names, and its next run
    overwrites them; a batch that is delivered again after its commit changes nothing."""

    KIND = "id long, clinic_id long, service_id long, source_type string, price decimal(12,2), match_confidence double, valid_from date"

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64, kind: str = KIND):
        self.spark, self.path, self.buckets, self.kind = spark, path, buckets, kind

    def commits(self) -> list[int]:
        """Numbers of the committed batches, in order."""
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/commits/batch=*/_SUCCESS")
        found = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at)
        return sorted(int(x.getPath().getParent().getName().split("=")[1]) for x in found or [])

    def last(self) -> int:
        return max(self.commits(), default=-1)

    def held(self) -> dict[int, int]:
        """Bucket -> batch that holds it (at most as many as there are buckets)."""
        n = self.last()
        return {r["bucket"]: r["batch"] for r in self.spark.read.parquet(f"{self.path}/commits/batch={n}").collect()} if n >= 0 else {}

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        paths = [f"{self.path}/data/batch={n}/bucket={b}" for b, n in self.held().items() if buckets is None or b in buckets]
        return self.spark.read.schema(self.kind).parquet(*paths) if paths else self.spark.createDataFrame([], self.kind)

    def upsert(self, batch: DataFrame, number: int) -> None:
        bucket = F.pmod(F.xxhash64("clinic_id", "service_id"), F.lit(self.buckets)).cast("int")
        batch = written(batch, f"batch-{number}")  # made once: it is asked for its buckets, then joined
        touched = [r[0] for r in batch.select(bucket).distinct().collect()]
        if touched:
            rows = upsert_prices(self.read(touched), batch).withColumn("bucket", bucket).drop("change")
            rows.repartition(len(touched), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/batch={number}")
        self.commit(self.held() | {b: number for b in touched}, number)

    def commit(self, held: dict[int, int], number: int) -> None:
        rows = self.spark.createDataFrame(sorted(held.items()), "bucket int, batch long").coalesce(1)
        rows.write.mode("overwrite").parquet(f"{self.path}/commits/batch={number}")


class _Kept(StatefulProcessor):
    """State of a key with one timer, which drops it `days` of event time after the last row."""

    def __init__(self, days: float = HORIZON_DAYS):
        self.days = days

    def renew(self, last) -> None:
        at = int(pd.Timestamp(last, tz="UTC").timestamp() * 1000 + self.days * 86_400_000)
        old = list(self.handle.listTimers())
        if not old or max(old) < at:
            for t in old:
                self.handle.deleteTimer(t)
            self.handle.registerTimer(at)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.known.clear()
        return iter(())

    def close(self) -> None:
        pass


#: Parts that the keys of T02 are dealt to. A part's keys are worked on together: a call and a look at the state a part.
BUCKETS = 1024


class _LastPrice(StatefulProcessor):
    """The last price of each key of a part and its time, dropped by one timer a part, that of the first key to go."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.known = handle.getValueState("known", "k array<string>, at array<bigint>, price array<double>")

    def held(self) -> pd.DataFrame:
        k, at, price = self.known.get() if self.known.exists() else ([], [], [])
        return pd.DataFrame({"k": pd.Series(list(k), dtype=object), "at": np.array(list(at), "int64"), "price": np.array(list(price), float)})

    def hold(self, held: pd.DataFrame) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if held.empty:
            self.known.clear()
        else:
            self.known.update((held["k"].tolist(), held["at"].tolist(), held["price"].tolist()))
            self.handle.registerTimer(int(held["at"].min()) // 1000 + HORIZON_DAYS * 86_400_000)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(rows)).sort_values(["k", "recorded_at", "id", "price"])
        rows = rows.assign(at=rows["recorded_at"].to_numpy().astype("datetime64[us]").astype("int64"))
        held = self.held()
        old = rows[["k"]].merge(held, on="k", how="left")
        kept = ~(rows["at"].to_numpy() < old["at"].to_numpy(dtype=float))  # later than what is known: ignored
        rows, old = rows[kept], old[kept]
        if rows.empty:
            return
        k, now = rows["k"].to_numpy(dtype=object), rows["price"].to_numpy(dtype=float)
        first = np.r_[True, k[1:] != k[:-1]]
        out = rows.loc[now != np.where(first, old["price"].to_numpy(dtype=float), np.r_[np.nan, now[:-1]]), ["k", "recorded_at", "price"]]
        self.hold(pd.concat([held, rows[["k", "at", "price"]]]).drop_duplicates("k", keep="last"))
        yield out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held, now = self.held(), timerValues.getCurrentWatermarkInMs()
        self.hold(held[held["at"] // 1000 + HORIZON_DAYS * 86_400_000 > now])
        return iter(())

    def close(self) -> None:
        pass


def on_rocksdb(spark: SparkSession) -> None:
    """Keyed state lives in RocksDB: on local disk with change logs at the checkpoint, not on the JVM heap."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def change_history(stream: DataFrame) -> DataFrame:
    """Of price updates (clinic_id, service_id, id, recorded_at, price) those that change the price of their key. One
    value a key is kept; it is dropped long after the freshness horizon. Keys are dealt to parts, whose values lie together."""
    on_rocksdb(stream.sparkSession)
    # The key as one text: the clinic, then the service, each empty where it is null.
    k = F.concat(F.coalesce(F.col("clinic_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.concat(F.lit("="), "service_id"), F.lit("")))
    bucket = F.pmod(F.xxhash64("clinic_id", "service_id"), F.lit(BUCKETS)).cast("int")
    keyed = stream.select(bucket.alias("bucket"), k.alias("k"), "id", F.col("recorded_at").cast("timestamp").alias("recorded_at"), F.col("price").cast("double").alias("price")).withWatermark("recorded_at", f"{HORIZON_DAYS} days")
    out = keyed.groupBy("bucket").transformWithStateInPandas(_LastPrice(), "k string, recorded_at timestamp, price double", "Append", "EventTime")
    clinic, service = F.substring_index("k", ":", 1), F.expr("substring(k, locate(':', k) + 1)")
    return out.select(F.nullif(clinic, F.lit("")).cast("long").alias("clinic_id"), F.when(service != "", F.expr("substring(k, locate(':', k) + 2)")).alias("service_id"), "recorded_at", "price")


def drops(prices: np.ndarray, base: float | None, least: float = 0.001) -> tuple[list[tuple[float, float]], float | None]:
    """(alerts as (old, new), last baseline) of prices in order. The baseline follows every step of more than `least`, so
    prices within it of the one before are looked at one by one only where small steps add up."""
    if not len(prices):
        return [], base
    steps = np.abs(np.diff(prices, prepend=np.inf if base is None else base))
    if not ((steps > 0) & (steps <= least)).any():  # each price is the next one's baseline
        before = np.r_[np.nan if base is None else base, prices[:-1]]
        at = np.flatnonzero(prices < before - least)
        return list(zip(before[at].tolist(), prices[at].tolist(), strict=True)), float(prices[-1])
    out = []
    for p in prices.tolist():
        if base is not None and p < base - least:
            out.append((base, p))
        if base is None or abs(p - base) > least:
            base = p
    return out, base


class _Baseline(_Kept):
    """The baseline price of a subscription."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.known = handle.getValueState("base", "price double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(rows)).sort_values(["recorded_at", "price"])
        base = self.known.get()[0] if self.known.exists() else None
        given = rows["last_price"].dropna()
        if base is None and len(given):
            base = float(given.iloc[0])
        found, base = drops(rows["price"].to_numpy(dtype=float), base)
        self.known.update((base,))
        self.renew(rows["recorded_at"].iloc[-1])
        yield pd.DataFrame([(key[0], a, b) for a, b in found], columns=["subscription_id", "old_price", "new_price"])


def price_drops(stream: DataFrame, subs: DataFrame, days: float = HORIZON_DAYS, late: str = "30 days") -> DataFrame:
    """Alerts of subscriptions (id, service_id, last_price) as prices (service_id, recorded_at, price) arrive, up to
    `late` late. A baseline that no price has renewed for `days` is dropped; the next price then starts from last_price again."""
    on_rocksdb(stream.sparkSession)
    s = subs.select(F.col("id").alias("subscription_id"), "service_id", F.col("last_price").cast("double").alias("last_price"))
    rows = stream.select("service_id", F.col("recorded_at").cast("timestamp").alias("recorded_at"), F.col("price").cast("double").alias("price")).where("price is not null").withWatermark("recorded_at", late).join(s, "service_id")
    return rows.groupBy("subscription_id").transformWithStateInPandas(_Baseline(days), "subscription_id long, old_price double, new_price double", "Append", "EventTime")


def daily_prices(stream: DataFrame, late: str = "30 days", accuracy: int = 10_000, exact: bool = False) -> DataFrame:
    """Per service and day, number, least and median of the prices. Records up to `late` late still count; a day comes
    out once, when the watermark has passed it, and its state goes. The median is a mergeable sketch of about `accuracy`
    values at most a service and day (exact up to that many), or, if `exact`, the middle of all distinct values with their
    counts. In complete mode every day comes out, open ones too, and no record is late."""
    timed = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    out = timed.groupBy(F.window("ts", "1 day").alias("w"), "service_id").agg(F.count("*").alias("n"), F.min("price").alias("min_price"), (F.median("price") if exact else F.percentile_approx("price", 0.5, accuracy)).alias("median_price"))
    return out.select(F.col("w.start").alias("day"), "service_id", "n", "min_price", "median_price")


def once_only(stream: DataFrame, content: list[str], late: str = "7 days") -> DataFrame:
    """A file or row that is delivered again within the horizon passes once, by a hash of its content."""
    marked = stream.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("content_hash", F.sha2(F.concat_ws("\u0001", *[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in content]), 256))
    return marked.withWatermark("ts", late).dropDuplicatesWithinWatermark(["content_hash"])


def isolate(batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows, bad rows with the reason). Rows: raw_name, price_text."""
    p = T.col_parse_price("price_text")
    why = F.when(F.coalesce(F.length(F.trim("raw_name")), F.lit(0)) < 3, "name").when(p.isNull(), "price")
    out = batch.withColumn("price", p).withColumn("error", why)
    return out.where("error is null").drop("error"), out.where("error is not null")


def drained(spark: SparkSession, df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """What a stream has written when all input at hand is done: Parquet in the shared folder, a part a micro-batch (a
    batch that runs again replaces its own), or the last whole result in complete mode."""
    base = f"{shared_dir(spark)}/{name}"

    def put(batch: DataFrame, i: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/rows" if mode == "complete" else f"{base}/rows/batch={i}")

    df.writeStream.foreachBatch(put).option("checkpointLocation", f"{base}/checkpoint").outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{base}/rows").select(df.columns)


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of price updates."""
    kind = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(kind).parquet(f"{sf_dir}/events.parque[t]")
