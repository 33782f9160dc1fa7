"""Queries of the deduplication and summary operators."""

from pyspark.sql import functions as F

from ..data import AS_OF, FRESH_DAYS, canon, raw, with_canon
from ..operators import compare as C
from ..operators import dedup as D
from .registry import query

dbl = lambda c: F.col(c).cast("double").alias(c)
FRESH = "coalesce(is_active, true) AND coalesce(coalesce(parsed_at, valid_from) >= DATE '2000-06-30', true)"
OFFERS = f"(SELECT p.*, c.name AS clinic_name, c.city, c.lat, c.lng, c.rating, c.online_booking FROM prices p JOIN clinics c ON p.clinic_id = c.id WHERE is_public AND service_id IS NOT NULL AND {FRESH})"


def items(spark, d):
    return canon(spark, d, "prices")


@query("a01_dedup_min_price", with_canon("SELECT clinic_id, service_id, CAST(min(price) AS DOUBLE) AS price FROM prices GROUP BY ALL"))
def a01(spark, d):
    return D.dedup_min_price(items(spark, d)).select("clinic_id", "service_id", dbl("price"))


@query("a01_match_counts", with_canon("SELECT clinic_id, count(*) AS items_found, count(*) FILTER (match_confidence >= 0.78) AS matched, count(*) FILTER (NOT match_confidence >= 0.78) AS needs_review FROM prices GROUP BY ALL"))
def a01_counts(spark, d):
    return D.match_counts(items(spark, d))


_BATCH = "(SELECT clinic_id, service_id, 'api' AS source_type, min(price) AS price FROM prices WHERE service_id IS NOT NULL AND id % 3 = 0 GROUP BY ALL)"


@query(
    "a02_upsert_prices",
    with_canon(f"""WITH o AS (SELECT *, CASE WHEN service_id IS NOT NULL THEN row_number() OVER (PARTITION BY clinic_id, service_id ORDER BY valid_from DESC, id DESC, price) END AS r FROM prices WHERE id % 3 <> 0),
    m AS (SELECT coalesce(o.clinic_id, b.clinic_id) AS clinic_id, CASE WHEN b.price IS NULL THEN 'kept' WHEN o.id IS NULL THEN 'inserted' WHEN o.source_type <> 'upload' THEN 'updated' ELSE 'kept' END AS change
          FROM o FULL JOIN {_BATCH} b ON o.clinic_id = b.clinic_id AND o.service_id = b.service_id AND o.r = 1)
    SELECT clinic_id, change, count(*) AS n FROM m GROUP BY ALL"""),
)
def a02(spark, d):
    p = items(spark, d)
    batch = D.dedup_min_price(p.where("service_id is not null and id % 3 = 0")).withColumn("source_type", F.lit("api"))
    return D.upsert_prices(p.where("id % 3 <> 0"), batch).groupBy("clinic_id", "change").agg(F.count("*").alias("n"))


@query("a03_archive_dedup", with_canon("SELECT run_id, coalesce(CAST(service_id AS VARCHAR), 'raw::' || lower(raw_name)) AS dedup_key, CAST(min(price_resident) AS DOUBLE) AS primary_price FROM prices WHERE price_resident > 0 GROUP BY ALL"))
def a03(spark, d):
    return D.archive_dedup(items(spark, d)).select("run_id", "dedup_key", dbl("primary_price"))


@query(
    "a04_archive_upsert",
    with_canon("""WITH o AS (SELECT *, CASE WHEN service_id IS NOT NULL THEN row_number() OVER (PARTITION BY clinic_id, service_id ORDER BY valid_from DESC, id DESC, price) END AS r FROM prices WHERE id % 3 <> 0),
    b AS (SELECT clinic_id, service_id, min(price) AS price FROM prices WHERE service_id IS NOT NULL AND id % 3 = 0 GROUP BY ALL),
    m AS (SELECT CASE WHEN b.price IS NULL THEN 'kept' WHEN o.id IS NULL THEN 'inserted' ELSE 'updated' END AS change FROM o FULL JOIN b ON o.clinic_id = b.clinic_id AND o.service_id = b.service_id AND o.r = 1
          UNION ALL SELECT 'inserted' FROM prices WHERE service_id IS NULL AND id % 3 = 0)
    SELECT change, count(*) AS n FROM m GROUP BY ALL"""),
)
def a04(spark, d):
    p = items(spark, d)
    return D.archive_upsert(p.where("id % 3 <> 0"), p.where("id % 3 = 0")).groupBy("change").agg(F.count("*").alias("n"))


@query(
    "a05_document_metrics",
    with_canon("""WITH k AS (SELECT *, row_number() OVER (PARTITION BY run_id, coalesce(CAST(service_id AS VARCHAR), 'raw::' || lower(raw_name)) ORDER BY price_resident, id) AS r FROM prices WHERE price_resident > 0),
    s AS (SELECT run_id, count(*) AS services FROM k WHERE r = 1 GROUP BY ALL),
    t AS (SELECT run_id, count(*) AS items, count(*) FILTER (price_resident > 0 AND service_id IS NOT NULL AND match_confidence >= 0.78) AS matched, count(*) FILTER (price_resident > 0) AS ok FROM prices GROUP BY ALL)
    SELECT t.run_id, items, matched, ok - matched AS needs_review, items - ok AS skipped, coalesce(services, 0) AS services, CASE WHEN ok > 0 THEN round_even(100.0 * matched / ok, 1) ELSE 0 END AS auto_rate, CASE WHEN ok = 0 THEN 'empty' ELSE 'ok' END AS status FROM t LEFT JOIN s ON t.run_id = s.run_id"""),
)
def a05(spark, d):
    return D.document_metrics(items(spark, d)).select("run_id", "items", "matched", "needs_review", "skipped", "services", dbl("auto_rate"), "status")


@query(
    "a06_archive_quality",
    with_canon("""SELECT count(DISTINCT run_id) AS documents, count(*) AS positions, count(*) FILTER (p.service_id IS NOT NULL AND match_confidence >= 0.78) AS matched, count(tarificator_code) AS with_code
    FROM prices p LEFT JOIN services s ON p.service_id = s.id WHERE run_id IN (SELECT id FROM runs WHERE file_name <> '')"""),
)
def a06(spark, d):
    return D.archive_quality(canon(spark, d, "runs"), items(spark, d), canon(spark, d, "services")).select("documents", "positions", "matched", "with_code")


@query("a07_coverage_report", with_canon("SELECT source_type, count(*) AS n, count(DISTINCT service_id) AS services, count(DISTINCT city) AS cities, count(*) FILTER (match_confidence < 0.78) AS open_review FROM prices p JOIN clinics c ON p.clinic_id = c.id GROUP BY ALL"))
def a07(spark, d):
    return D.coverage_report(items(spark, d), canon(spark, d, "clinics"))


@query(
    "a07_quality_report",
    with_canon("""WITH k AS (SELECT *, row_number() OVER (PARTITION BY run_id, coalesce(CAST(service_id AS VARCHAR), 'raw::' || lower(raw_name)) ORDER BY price_resident, id) AS r FROM prices WHERE price_resident > 0),
    t AS (SELECT count(DISTINCT run_id) AS documents, count(*) AS items, count(*) FILTER (price_resident > 0 AND service_id IS NOT NULL AND match_confidence >= 0.78) AS matched, count(*) FILTER (price_resident > 0) AS ok, count(*) FILTER (service_id IS NULL) AS queue FROM prices)
    SELECT documents, items, matched, ok - matched AS needs_review, items - ok AS skipped, (SELECT count(*) FROM k WHERE r = 1) AS services, (SELECT count(*) FROM k WHERE r = 1 AND price_nonresident < price_resident) AS anomalies, round_even(100.0 * matched / greatest(ok, 1), 1) >= 70 AS goal_met, queue FROM t"""),
)
def a07_quality(spark, d):
    rows = items(spark, d)
    return D.quality_report(D.document_metrics(rows), rows).select("documents", "items", "matched", "needs_review", "skipped", "services", "anomalies", "goal_met", "queue")


@query(
    "a08_ingest_stats",
    with_canon("""SELECT (SELECT count(*) FROM clinics) AS clinics, (SELECT count(DISTINCT nullif(trim(city), '')) FROM clinics) AS cities, (SELECT count(*) FROM services) AS services, (SELECT count(*) FROM prices) AS prices,
    (SELECT count(*) FROM prices WHERE match_confidence < 0.78) AS below_threshold, (SELECT count(*) FROM prices WHERE source_type = 'upload') AS from_upload, (SELECT count(*) FROM prices WHERE source_type = 'api') AS from_api,
    (SELECT count(*) FROM prices WHERE source_type = 'web_scrape') AS from_web_scrape, (SELECT count(*) FROM runs WHERE items_found = 0 OR status = 'F') AS bad_runs, (SELECT count(*) FROM reports WHERE status = 'new') AS new_reports"""),
)
def a08(spark, d):
    return D.ingest_stats(*[canon(spark, d, t) for t in ("clinics", "services", "prices", "runs", "reports")])


@query("a09_service_summary", with_canon(f"SELECT service_id, count(*) AS offers_count, CAST(min(price) AS DOUBLE) AS min_price, CAST(max(price) AS DOUBLE) AS max_price, CAST(sum(price) AS DOUBLE) / count(*) AS avg_price, CAST(floor((CAST(max(price) AS DOUBLE) - CAST(min(price) AS DOUBLE)) / CAST(max(price) AS DOUBLE) * 100 + 0.5) AS BIGINT) AS spread_pct FROM {OFFERS} GROUP BY ALL"))
def a09(spark, d):
    found = C.offers(items(spark, d), canon(spark, d, "clinics"), AS_OF, FRESH_DAYS)
    return D.service_summary(found).select("service_id", "offers_count", dbl("min_price"), dbl("max_price"), "avg_price", "spread_pct")


@query(
    "a10_variant_siblings",
    with_canon("""WITH p AS (SELECT service_id, lower(canonical_name) AS k, count(*) AS offers_count, CAST(min(price) AS DOUBLE) AS min_price FROM prices JOIN services s ON s.id = service_id GROUP BY ALL),
    r AS (SELECT *, count(*) OVER (PARTITION BY k) - 1 AS siblings, first_value(service_id) OVER w AS c1, nth_value(service_id, 2) OVER w AS c2 FROM p WINDOW w AS (PARTITION BY k ORDER BY min_price, service_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
    SELECT service_id, offers_count, min_price, siblings, CASE WHEN c1 = service_id THEN c2 ELSE c1 END AS cheapest_sibling FROM r"""),
)
def a10(spark, d):
    return D.variant_families(canon(spark, d, "services"), items(spark, d)).select("service_id", "offers_count", dbl("min_price"), "siblings", "cheapest_sibling")


@query("a11_categories_present", with_canon("SELECT DISTINCT 'лаборатория' AS category_enum, 1 AS place FROM services"))
def a11(spark, d):
    return D.categories_present(canon(spark, d, "services")).select("category_enum", F.col("place").cast("int").alias("place"))


@query("a12_cities_with_prices", with_canon("SELECT DISTINCT city FROM clinics c WHERE is_public AND id IN (SELECT clinic_id FROM prices)"))
def a12(spark, d):
    return D.cities_with_prices(canon(spark, d, "clinics"), items(spark, d))


@query("a13_city_coverage", with_canon("WITH h AS (SELECT city, count(*) AS n FROM clinics WHERE is_public AND id IN (SELECT clinic_id FROM prices) GROUP BY ALL) SELECT coalesce(n_name, city) AS city, n_name IS NOT NULL AS listed, coalesce(n, 0) AS clinics, coalesce(n, 0) > 0 AS has_data FROM (SELECT n_name FROM nation WHERE n_nationkey % 2 = 0) FULL JOIN h ON n_name = city"))
def a13(spark, d):
    cities = raw(spark, d, "nation").where("n_nationkey % 2 = 0").select(F.col("n_name").alias("name"))
    return D.city_coverage(canon(spark, d, "clinics"), items(spark, d), cities)


@query("a14_partners", with_canon("SELECT c.id, name, city, count(p.id) AS prices FROM clinics c LEFT JOIN prices p ON p.clinic_id = c.id WHERE contains(lower(city), 'nation_1') GROUP BY ALL"))
def a14(spark, d):
    return D.partners(canon(spark, d, "clinics"), items(spark, d), "NATION_1")


@query("a15_source_runs", with_canon("WITH s AS (SELECT DISTINCT c_custkey % 100 AS id FROM customer) SELECT s.id, s.id % 2 = 0 AS enabled, count(r.id) AS runs FROM s LEFT JOIN runs r ON r.source_id = s.id WHERE s.id % 3 <> 0 GROUP BY ALL"))
def a15(spark, d):
    s = raw(spark, d, "customer").select((F.col("c_custkey") % 100).alias("id")).distinct().withColumn("enabled", F.col("id") % 2 == 0).withColumn("type", F.when(F.col("id") % 3 == 0, "upload").otherwise("api"))
    return D.source_runs(s, canon(spark, d, "runs")).select("id", "enabled", "runs")


@query(
    "a16_price_trend",
    with_canon("""WITH m AS (SELECT service_id, recorded_at, round(median(CAST(price AS DOUBLE)), 2) AS median FROM price_history GROUP BY ALL),
    f AS (SELECT service_id, count(*) AS points, arg_min(median, recorded_at) AS first, arg_max(median, recorded_at) AS last FROM m GROUP BY ALL HAVING count(*) >= 2)
    SELECT service_id, points, round(first, 1) AS first, round(last, 1) AS last, CASE WHEN (last - first) / first * 100 > 1.05 THEN 'up' WHEN (last - first) / first * 100 < -1.05 THEN 'down' ELSE 'flat' END AS direction FROM f"""),
)
def a16(spark, d):
    return D.price_trend(canon(spark, d, "price_history")).select("service_id", "points", F.round("first", 1).alias("first"), F.round("last", 1).alias("last"), "direction")


@query("a17_curate", with_canon("SELECT clinic_id, CASE WHEN raw_name LIKE '%1%' THEN 'one' WHEN raw_name LIKE '%2%' AND raw_name NOT LIKE '%3%' THEN 'two' END AS canonical, CAST(min(price) AS DOUBLE) AS price FROM prices WHERE canonical IS NOT NULL GROUP BY ALL"))
def a17(spark, d):
    from ..functions.classify import classify_by_rules

    rules = [("one", "n", ("1",), (), ()), ("two", "n", ("2",), (), ("3",))]
    return D.curate(classify_by_rules(items(spark, d), rules)).select("clinic_id", "canonical", dbl("price"))


@query("a18_dedup_items", with_canon("SELECT lower(raw_name) AS name, CAST(price AS DOUBLE) AS price, min(id) AS id FROM prices GROUP BY ALL"))
def a18(spark, d):
    return D.dedup_items(items(spark, d)).select(F.lower("raw_name").alias("name"), dbl("price"), "id")


@query(
    "a19_duplicate_runs",
    with_canon("""WITH n AS (SELECT clinic_id, run_id % 200 AS run_id, 'n' || CAST(service_id % 3 AS VARCHAR) AS raw_name, id % 5 = 0 AS ok FROM prices WHERE service_id IS NOT NULL),
    s AS (SELECT clinic_id, run_id, md5(string_agg(DISTINCT raw_name, ',' ORDER BY raw_name)) AS h, count(DISTINCT raw_name) AS names FROM n WHERE NOT ok GROUP BY ALL),
    m AS (SELECT clinic_id, run_id, count(*) FILTER (ok) AS matched FROM n GROUP BY ALL)
    SELECT clinic_id, run_id, names, matched FROM (SELECT s.*, matched, row_number() OVER (PARTITION BY s.clinic_id, h ORDER BY matched DESC, s.run_id DESC) AS r FROM s JOIN m ON s.clinic_id = m.clinic_id AND s.run_id = m.run_id) WHERE r > 1"""),
)
def a19(spark, d):
    p = items(spark, d).where("service_id is not null")
    p = p.select("clinic_id", (F.col("run_id") % 200).alias("run_id"), F.concat(F.lit("n"), (F.col("service_id") % 3).cast("string")).alias("raw_name"), F.when(F.col("id") % 5 == 0, 1).alias("service_id"))
    return D.duplicate_runs(p)
