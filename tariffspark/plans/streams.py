"""Queries of the streaming jobs (T01 - T06): each runs over all that its input holds and gives the final rows."""

import uuid

from pyspark.sql import functions as F

from ..data import raw, shared_dir
from ..streaming import jobs as S
from .registry import query


def _name(q):
    return f"{q}_{uuid.uuid4().hex}"


@query(
    "t02_change_history",
    "SELECT user_id AS clinic_id, event_type AS service_id, value AS price, ts AS recorded_at FROM (SELECT *, lag(value) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id, value) AS b FROM events) WHERE b IS NULL OR b <> value",
)
def t02(spark, d):
    e = S.read_events(spark, d).select(F.col("user_id").alias("clinic_id"), F.col("event_type").alias("service_id"), F.col("event_id").alias("id"), F.col("ts").alias("recorded_at"), F.col("value").alias("price"))
    return S.drained(spark, S.change_history(e), _name("t02")).select("clinic_id", "service_id", "price", F.col("recorded_at").cast("timestamp_ntz").alias("recorded_at"))


@query(
    "t03_price_drops",
    """WITH e AS (SELECT 'u' || CAST(user_id AS VARCHAR) AS service_id, ts, value, event_id FROM events),
    s AS (SELECT c_custkey AS id, 'u' || CAST(c_custkey AS VARCHAR) AS service_id FROM customer)
    SELECT subscription_id, count(*) AS alerts FROM (SELECT s.id AS subscription_id, value, lag(value) OVER (PARTITION BY s.id ORDER BY ts, value) AS b FROM e JOIN s ON e.service_id = s.service_id) WHERE value < b - 0.001 GROUP BY ALL""",
)
def t03(spark, d):
    e = S.read_events(spark, d).select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("service_id"), F.col("ts").alias("recorded_at"), F.col("value").alias("price"))
    c = raw(spark, d, "customer")
    subs = c.select(F.col("c_custkey").alias("id"), F.concat(F.lit("u"), F.col("c_custkey").cast("string")).alias("service_id"), F.lit(None).cast("double").alias("last_price"))
    return S.drained(spark, S.price_drops(e, subs), _name("t03")).groupBy("subscription_id").agg(F.count("*").alias("alerts"))


@query(
    "t04_daily_prices",
    "SELECT CAST(ts AS DATE) AS day, event_type AS service_id, count(*) AS n, min(value) AS min_price, round(median(value), 6) AS median_price FROM events GROUP BY ALL",
)
def t04(spark, d):
    """Every day of the input, the last ones too, which the watermark has not passed: the whole result once the input ends."""
    e = S.read_events(spark, d).select("ts", F.col("event_type").alias("service_id"), F.col("value").alias("price"))
    return S.drained(spark, S.daily_prices(e, exact=True), _name("t04"), "complete").select(F.col("day").cast("date").alias("day"), "service_id", "n", "min_price", F.round("median_price", 6).alias("median_price"))


@query("t05_once_only", "SELECT user_id, event_type, props, count(*) AS n FROM (SELECT DISTINCT user_id, event_type, props FROM events) GROUP BY ALL")
def t05(spark, d):
    out = S.once_only(S.read_events(spark, d), ["user_id", "event_type", "props"], "4000 days")
    return S.drained(spark, out.select("user_id", "event_type", "props"), _name("t05")).groupBy("user_id", "event_type", "props").agg(F.count("*").alias("n"))


@query("t06_isolate", "SELECT CASE WHEN length(trim(p_name)) < 3 THEN 'name' WHEN p_partkey % 4 = 0 THEN 'price' ELSE 'ok' END AS error, count(*) AS n FROM part GROUP BY ALL")
def t06(spark, d):
    b = raw(spark, d, "part").select(F.col("p_name").alias("raw_name"), F.when(F.col("p_partkey") % 4 == 0, "по запросу").otherwise("1 500 ₸").alias("price_text"))
    good, bad = S.isolate(b)
    return good.select(F.lit("ok").alias("error")).unionByName(bad.select("error")).groupBy("error").agg(F.count("*").alias("n"))


@query("t01_ingest", "SELECT user_id AS clinic_id, event_type AS name, CAST(min(CAST(value AS DECIMAL(12, 2))) AS DOUBLE) AS price FROM events GROUP BY ALL")
def t01(spark, d):
    """Events as items of a clinic: raw name = event type, matched against a catalog of event types seen in the table; one
    file is one micro-batch, so the cheapest price of a clinic and service is left."""
    e = S.read_events(spark, d)
    types = raw(spark, d, "events").select("event_type").distinct()
    services = types.select(F.xxhash64("event_type").alias("id"), F.col("event_type").alias("canonical_name"), F.lit("Прочее").alias("category"), F.array().cast("array<string>").alias("synonyms"))
    stream = e.select(F.col("event_id").alias("item_id"), F.col("user_id").alias("clinic_id"), F.upper("event_type").alias("raw_name"), F.lit("api").alias("source_type"), F.col("value").cast("decimal(12,2)").alias("price"), F.col("ts").cast("date").alias("valid_from"))
    base = f"{shared_dir(spark)}/{_name('t01')}"
    prices = S.PriceTable(spark, f"{base}/prices")
    S.ingest(stream, services, prices, f"{base}/checkpoint").awaitTermination()
    return prices.read().join(services.select(F.col("id").alias("service_id"), F.col("canonical_name").alias("name")), "service_id").select("clinic_id", "name", F.col("price").cast("double").alias("price"))
