"""Queries of review, history and catalog-change operators."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..data import AS_OF, FRESH_DAYS, canon, raw, with_canon
from ..operators import dedup as D
from ..operators import review as V
from ..sources import catalog as K
from ..sources import files as X
from .dedups import FRESH, dbl
from .registry import query

P = lambda spark, d: canon(spark, d, "prices")


@query("r01_review_queue", with_canon("SELECT p.id, CAST(price AS DOUBLE) AS price, round(match_confidence, 6) AS confidence, (SELECT count(*) FROM prices WHERE match_confidence < 0.78) AS total FROM prices p WHERE match_confidence < 0.78 ORDER BY match_confidence, p.id, price LIMIT 200"))
def r01(spark, d):
    return V.review_queue(P(spark, d), canon(spark, d, "clinics"), canon(spark, d, "services")).select("id", dbl("price"), F.round("match_confidence", 6).alias("confidence"), "total")


@query("r01_review_page", with_canon("""SELECT 'price' AS kind, CAST(place AS INTEGER) AS place, id FROM (SELECT id, row_number() OVER (ORDER BY match_confidence, id, price) AS place FROM prices WHERE match_confidence < 0.78) WHERE place <= 150
    UNION ALL SELECT 'report', CAST(place AS INTEGER), id FROM (SELECT id, row_number() OVER (ORDER BY created_at DESC, id DESC) AS place FROM reports WHERE status = 'new') WHERE place <= 150"""))
def r01_page(spark, d):
    return V.review_page(P(spark, d), canon(spark, d, "clinics"), canon(spark, d, "services"), canon(spark, d, "reports"), limit=150).select("kind", "place", "id")


@query("r02_unmatched", with_canon("SELECT id, CAST(price AS DOUBLE) AS price FROM prices WHERE service_id IS NULL ORDER BY match_confidence, id, price LIMIT 200"))
def r02(spark, d):
    return V.unmatched(P(spark, d), canon(spark, d, "clinics")).select("id", dbl("price"))


DECISIONS = "(SELECT DISTINCT id, CASE id % 5 WHEN 0 THEN 'confirm' WHEN 1 THEN 'reassign' WHEN 2 THEN 'new' WHEN 3 THEN 'reject' ELSE 'odd' END AS action, CASE WHEN id % 2 = 0 THEN id % 100 ELSE -1 END AS target_id, (id % 11) / 10.0E0 AS confidence, id % 4 = 0 AS verified FROM prices WHERE id % 3 = 0)"


def _decisions(spark, d):
    i = F.col("id")
    act = F.when(i % 5 == 0, "confirm").when(i % 5 == 1, "reassign").when(i % 5 == 2, "new").when(i % 5 == 3, "reject").otherwise("odd")
    return P(spark, d).where(i % 3 == 0).select("id", act.alias("action"), F.when(i % 2 == 0, i % 100).otherwise(F.lit(-1)).cast("long").alias("target_id"), ((i % 11) / 10.0).cast("double").alias("confidence"), (i % 4 == 0).alias("verified")).distinct()


@query(
    "r03_apply_decisions",
    with_canon(f"""SELECT p.id, CAST(price AS DOUBLE) AS price, CASE WHEN action = 'confirm' OR action = 'new' OR (action = 'reassign' AND t.id IS NOT NULL) THEN 1.0 ELSE round(match_confidence, 6) END AS confidence,
    CASE WHEN action = 'new' THEN -1 WHEN action = 'reassign' AND t.id IS NOT NULL THEN t.id ELSE service_id END AS service_id FROM prices p LEFT JOIN {DECISIONS} q ON p.id = q.id LEFT JOIN services t ON t.id = q.target_id WHERE coalesce(action, '') <> 'reject'"""),
)
def r03(spark, d):
    services = canon(spark, d, "services").select("id", "canonical_name")
    out, made = V.apply_decisions(P(spark, d), services, _decisions(spark, d).drop("confidence", "verified"))
    new = made.select(F.col("id").alias("service_id"), F.lit(True).alias("made"))
    return out.join(new, "service_id", "left").select("id", dbl("price"), F.round("match_confidence", 6).alias("confidence"), F.when(F.col("made"), -1).otherwise(F.col("service_id")).alias("service_id"))


@query(
    "r04_gate_decisions",
    with_canon(f"""WITH q AS (SELECT DISTINCT id FROM (SELECT id FROM prices WHERE match_confidence < 0.78 AND service_id IS NOT NULL ORDER BY match_confidence, id, price LIMIT 50))
    SELECT id, action, action IN ('confirm', 'reject') AND confidence >= 0.8 AS applied FROM {DECISIONS} WHERE id IN (SELECT id FROM q)"""),
)
def r04(spark, d):
    return V.gate_decisions(P(spark, d), _decisions(spark, d), auto=("confirm", "reject")).select("id", "action", "applied")


@query("r05_manual_match", with_canon("SELECT target AS id, count(DISTINCT raw_name) AS n FROM (SELECT id % 50 AS target, raw_name FROM prices WHERE id % 7 = 0) GROUP BY ALL"))
def r05(spark, d):
    pairs = P(spark, d).where("id % 7 = 0").select("id", (F.col("id") % 50).alias("target_id")).distinct()
    services = canon(spark, d, "services").withColumn("synonyms", F.array().cast("array<string>"))
    _, learned = V.manual_match(P(spark, d), services, pairs)
    return learned.where("size(synonyms) > 0").select("id", F.size("synonyms").cast("long").alias("n"))


@query("r06_run_detail", with_canon("SELECT run_id, count(*) AS positions, count(*) FILTER (service_id IS NOT NULL AND match_confidence >= 0.78) AS matched, count(*) FILTER (service_id IS NOT NULL AND match_confidence < 0.78) AS review, count(*) FILTER (service_id IS NULL) AS unmatched FROM prices GROUP BY ALL"))
def r06(spark, d):
    return V.run_detail(P(spark, d), canon(spark, d, "services"))


@query("r07_rollback", with_canon("SELECT r.id, CASE WHEN r.id % 9 = 0 THEN 'rolled_back' ELSE status END AS status, count(p.id) FILTER (r.id % 9 <> 0) AS left_rows FROM runs r LEFT JOIN prices p ON p.run_id = r.id GROUP BY r.id, status"))
def r07(spark, d):
    runs = canon(spark, d, "runs")
    left, marked = V.rollback(P(spark, d), runs, runs.where("id % 9 = 0").select(F.col("id").alias("run_id")))
    n = left.groupBy(F.col("run_id").alias("id")).agg(F.count("*").alias("left_rows"))
    return marked.join(n, "id", "left").select("id", "status", F.coalesce("left_rows", F.lit(0)).alias("left_rows"))


@query(
    "r08_append_history",
    with_canon("""WITH h AS (SELECT clinic_id, service_id, arg_max(price, (recorded_at, id, price)) AS last_price FROM price_history WHERE recorded_at < DATE '2000-01-01' GROUP BY ALL),
    u AS (SELECT u.*, coalesce(lag(price) OVER (PARTITION BY u.clinic_id, u.service_id ORDER BY recorded_at, id, price), last_price) AS before FROM price_history u LEFT JOIN h ON u.clinic_id = h.clinic_id AND u.service_id = h.service_id WHERE recorded_at >= DATE '2000-01-01')
    SELECT clinic_id, service_id, CAST(price AS DOUBLE) AS price, id FROM u WHERE before IS NULL OR before <> price"""),
)
def r08(spark, d):
    h = canon(spark, d, "price_history")
    day = F.lit("2000-01-01").cast("date")
    return V.append_history(h.where(F.col("recorded_at") < day), h.where(F.col("recorded_at") >= day)).select("clinic_id", "service_id", dbl("price"), "id")


MIN = f"""f AS (SELECT service_id, clinic_id, city, min(price) AS p FROM (SELECT p.*, c.city FROM prices p JOIN clinics c ON p.clinic_id = c.id WHERE service_id IS NOT NULL AND {FRESH}) GROUP BY ALL),
    m AS (SELECT s.*, CASE WHEN s.clinic_id IS NOT NULL THEN (SELECT min(p) FROM f WHERE f.service_id = s.service_id AND f.clinic_id = s.clinic_id) WHEN s.city <> '' THEN (SELECT min(p) FROM f WHERE f.service_id = s.service_id AND f.city = s.city) ELSE (SELECT min(p) FROM f WHERE f.service_id = s.service_id) END AS cur FROM subscriptions s)"""


@query("r09_current_min", with_canon(f"WITH {MIN} SELECT id, CAST(cur AS DOUBLE) AS current_price FROM m"))
def r09(spark, d):
    return V.current_min(canon(spark, d, "subscriptions"), P(spark, d), canon(spark, d, "clinics"), AS_OF, FRESH_DAYS).select("id", dbl("current_price"))


@query("r10_check_subscriptions", with_canon(f"WITH {MIN} SELECT id, CASE WHEN cur IS NULL THEN 'no_price' WHEN last_price IS NULL THEN 'baseline' WHEN CAST(cur AS DOUBLE) - CAST(last_price AS DOUBLE) < -0.001 THEN 'alert' WHEN CAST(cur AS DOUBLE) - CAST(last_price AS DOUBLE) > 0.001 THEN 'raised' ELSE 'same' END AS event, CAST(coalesce(cur, last_price) AS DOUBLE) AS new_last_price FROM m WHERE active"))
def r10(spark, d):
    return V.check_subscriptions(canon(spark, d, "subscriptions"), P(spark, d), canon(spark, d, "clinics"), AS_OF, FRESH_DAYS).select("id", "event", dbl("new_last_price"))


@query("r11_subscribe", with_canon("WITH r AS (SELECT '+7700' || CAST(1000000 + c_custkey // 2 AS VARCHAR) AS phone, c_custkey // 2 AS service_id, CASE WHEN (c_custkey // 2) % 3 = 0 AND c_custkey % 2 = 0 THEN (c_custkey // 2) % 100 END AS clinic_id FROM customer), q AS (SELECT DISTINCT phone, service_id, clinic_id FROM r WHERE service_id IN (SELECT id FROM services)) SELECT phone, service_id, clinic_id FROM q WHERE NOT EXISTS (SELECT 1 FROM subscriptions s WHERE active AND s.phone = q.phone AND s.service_id = q.service_id AND s.clinic_id IS NOT DISTINCT FROM q.clinic_id)"))
def r11(spark, d):
    c = raw(spark, d, "customer").withColumn("k", F.floor(F.col("c_custkey") / 2).cast("long"))
    r = c.select(F.concat(F.lit("+7 (700) "), (F.lit(1000000) + F.col("k")).cast("string")).alias("phone"), F.col("k").alias("service_id"), F.when((F.col("k") % 3 == 0) & (F.col("c_custkey") % 2 == 0), F.col("k") % 100).alias("clinic_id"), F.lit("").alias("city"))
    return V.subscribe(canon(spark, d, "subscriptions"), r, canon(spark, d, "services"), P(spark, d), canon(spark, d, "clinics"), AS_OF, FRESH_DAYS).select("phone", "service_id", "clinic_id")


@query("r12_apply_edits", with_canon("SELECT clinic_id, CASE WHEN id % 10 = 0 AND id % 20 <> 0 THEN 'upload' ELSE source_type END AS source_type, count(*) AS n, CAST(sum(CASE WHEN id % 10 = 0 AND id % 20 <> 0 THEN 777 ELSE price END) AS DOUBLE) AS total FROM prices GROUP BY ALL"))
def r12(spark, d):
    e = P(spark, d).where("id % 10 = 0").select("id", "clinic_id", F.when(F.col("id") % 20 == 0, 0).otherwise(777).cast("decimal(12,2)").alias("new_price")).distinct()
    return V.apply_edits(P(spark, d), e, AS_OF).groupBy("clinic_id", "source_type").agg(F.count("*").alias("n"), F.sum("price").cast("double").alias("total"))


@query("r13_merge_canons", with_canon("SELECT CASE WHEN service_id % 10 IN (3, 4) THEN service_id - service_id % 10 + (1 - id % 2) ELSE service_id END AS service_id, count(*) AS n FROM prices WHERE NOT (coalesce(service_id % 10 IN (3, 4), false) AND id % 2 = 0 AND price >= 50000) GROUP BY ALL"))
def r13(spark, d):
    plan = _plan(spark, d)
    p = P(spark, d).withColumn("raw_name", F.when(F.col("id") % 2 == 0, "Глюкоза в моче").otherwise("Глюкоза"))
    return V.merge_canons(p, plan).groupBy("service_id").agg(F.count("*").alias("n"))


@query("r13_merge_history", with_canon("SELECT CASE WHEN service_id % 10 IN (3, 4) THEN service_id - service_id % 10 ELSE service_id END AS service_id, count(*) AS n, CAST(sum(price) AS DOUBLE) AS total FROM price_history WHERE NOT (service_id % 10 IN (3, 4) AND price >= 50000) GROUP BY ALL"))
def r13_history(spark, d):
    out = V.merge_followers(canon(spark, d, "price_history"), _plan(spark, d), 50_000)
    return out.groupBy("service_id").agg(F.count("*").alias("n"), F.sum("price").cast("double").alias("total"))


@query("r13_merge_subscriptions", with_canon("SELECT id, CASE WHEN service_id % 10 IN (3, 4) AND service_id IN (SELECT id FROM services) THEN service_id - service_id % 10 ELSE service_id END AS service_id FROM subscriptions"))
def r13_subscriptions(spark, d):
    return V.merge_followers(canon(spark, d, "subscriptions"), _plan(spark, d)).select("id", "service_id")


@query("r13_merge_services", with_canon("""WITH raws AS (SELECT service_id - service_id % 10 AS id, 'Item ' || CAST(service_id AS VARCHAR) AS name FROM prices WHERE service_id % 10 IN (3, 4) UNION SELECT id - id % 10, canonical_name FROM services WHERE id % 10 IN (3, 4)),
    news AS (SELECT r.id, r.name FROM raws r JOIN services s ON s.id = r.id WHERE lower(r.name) <> lower(s.canonical_name))
    SELECT s.id, coalesce(string_agg(n.name, '|' ORDER BY n.name), '') AS synonyms FROM services s LEFT JOIN news n ON n.id = s.id WHERE s.id % 10 NOT IN (3, 4) GROUP BY s.id"""))
def r13_services(spark, d):
    s = canon(spark, d, "services").withColumn("synonyms", F.array().cast("array<string>"))
    return V.merge_services(s, _plan(spark, d), P(spark, d)).select("id", F.array_join("synonyms", "|").alias("synonyms"))


def _plan(spark, d):
    """Chains of two links (4 -> 3 -> 0 in each ten), whose first link has no urine service of its own, and cycles (7 <-> 8),
    which merge nothing."""
    k = F.col("id") % 10
    s = canon(spark, d, "services").where("id % 10 in (3, 4, 7, 8)")
    to = F.col("id") + F.when(k == 3, -3).when(k == 4, -1).when(k == 7, 1).otherwise(-1)
    return s.select(F.col("id").alias("from_id"), to.alias("to_id"), F.when(k == 3, F.col("id") - 2).alias("urine_id"))


def _dear(spark, d):
    """Prices of the dearest rows alone, so that services without any are left."""
    return P(spark, d).where("price > 90000")


@query("r14_prune_orphans", with_canon("SELECT id FROM services WHERE id NOT IN (SELECT service_id FROM prices WHERE service_id IS NOT NULL)"))
def r14(spark, d):
    return V.prune_orphans(canon(spark, d, "services"), P(spark, d))[0].select("id")


@query("r14_prune_followers", with_canon("SELECT 'history' AS kind, id FROM price_history WHERE service_id NOT IN (SELECT id FROM services) OR service_id IN (SELECT service_id FROM prices WHERE price > 90000) UNION ALL SELECT 'subscriptions', id FROM subscriptions WHERE service_id NOT IN (SELECT id FROM services) OR service_id IN (SELECT service_id FROM prices WHERE price > 90000)"))
def r14_followers(spark, d):
    _, h, u = V.prune_orphans(canon(spark, d, "services"), _dear(spark, d), canon(spark, d, "price_history"), canon(spark, d, "subscriptions"))
    return h.select(F.lit("history").alias("kind"), "id").unionByName(u.select(F.lit("subscriptions").alias("kind"), "id"))


@query("r12_edit_history", with_canon("SELECT clinic_id, service_id, CAST(777 AS DOUBLE) AS price FROM prices WHERE id % 10 = 0 AND id % 20 <> 0 AND service_id IS NOT NULL"))
def r12_history(spark, d):
    e = P(spark, d).where("id % 10 = 0").select("id", "clinic_id", F.when(F.col("id") % 20 == 0, 0).otherwise(777).cast("decimal(12,2)").alias("new_price")).distinct()
    return V.edit_history(V.apply_edits(P(spark, d), e, AS_OF), AS_OF).select("clinic_id", "service_id", dbl("price"))


@query("r12_confirm_all", with_canon("SELECT id, clinic_id, CASE WHEN clinic_id % 3 = 0 THEN 'upload' ELSE source_type END AS source_type, CASE WHEN clinic_id % 3 = 0 THEN DATE '2001-06-30' ELSE valid_from END AS valid_from, clinic_id % 3 = 0 AS confirmed FROM prices"))
def r12_confirm(spark, d):
    c = canon(spark, d, "clinics").where("id % 3 = 0").select(F.col("id").alias("clinic_id"))
    return V.confirm_all(P(spark, d), c, AS_OF).select("id", "clinic_id", "source_type", "valid_from", "confirmed")


@query("r04_gate_counts", with_canon(f"""WITH q AS (SELECT DISTINCT id FROM (SELECT id FROM prices WHERE match_confidence < 0.78 AND service_id IS NOT NULL ORDER BY match_confidence, id, price LIMIT 50))
    SELECT count(*) FILTER (action IN ('confirm', 'reject') AND confidence >= 0.8) AS applied, count(*) FILTER (NOT (action IN ('confirm', 'reject') AND confidence >= 0.8)) AS remaining FROM {DECISIONS} WHERE id IN (SELECT id FROM q)"""))
def r04_counts(spark, d):
    return V.gate_counts(V.gate_decisions(P(spark, d), _decisions(spark, d), auto=("confirm", "reject")))


@query("r06_run_positions", with_canon("SELECT p.run_id, p.id, canonical_name, p.service_id, CASE WHEN p.service_id IS NULL THEN 'unmatched' WHEN match_confidence >= 0.78 THEN 'matched' ELSE 'review' END AS status FROM prices p LEFT JOIN services s ON s.id = p.service_id"))
def r06_positions(spark, d):
    return V.run_positions(P(spark, d), canon(spark, d, "services")).select("run_id", "id", "canonical_name", "service_id", "status")


@query("r15_set_status", with_canon("SELECT id, CASE WHEN id % 2 = 0 THEN 'reviewed' ELSE status END AS status FROM reports"))
def r15_set(spark, d):
    t = canon(spark, d, "reports")
    return V.set_status(t, t.where("id % 2 = 0").select("id", F.lit("reviewed").alias("new_status"))).select("id", "status")


@query("r15_subscriptions", with_canon("SELECT u.id, canonical_name AS service_name, c.name AS clinic_name FROM subscriptions u LEFT JOIN services s ON s.id = u.service_id LEFT JOIN clinics c ON c.id = u.clinic_id"))
def r15_subscriptions(spark, d):
    return V.named_subscriptions(*[canon(spark, d, t) for t in ("subscriptions", "services", "clinics")]).select("id", "service_name", "clinic_name")


@query("r15_by_status", with_canon("SELECT id, note FROM reports WHERE status = 'new' ORDER BY created_at DESC, id DESC LIMIT 100"))
def r15(spark, d):
    return V.by_status(canon(spark, d, "reports"), "new").select("id", "note")


@query("r16_worklist_services", with_canon("SELECT id, id IN (SELECT service_id FROM prices p JOIN clinics c ON p.clinic_id = c.id WHERE is_public AND service_id IS NOT NULL) AS offered FROM services WHERE id % 4 = 0"))
def r16(spark, d):
    s = canon(spark, d, "services").withColumn("description", F.when(F.col("id") % 4 == 0, " ").otherwise("text"))
    return V.worklist_services(s, P(spark, d), canon(spark, d, "clinics"), "description").select("id", "offered")


@query("r16_worklist_clinics", with_canon("SELECT id, address || ', ' || city || ', Казахстан' AS query FROM clinics WHERE lat IS NULL AND address <> 'сеть клиник'"))
def r16_clinics(spark, d):
    return V.worklist_clinics(canon(spark, d, "clinics")).select("id", "query")


@query("r17_flag_anonymous", with_canon("SELECT id, is_public AND id % 6 <> 0 AS is_public FROM clinics"))
def r17(spark, d):
    c = canon(spark, d, "clinics").withColumn("name", F.when(F.col("id") % 6 == 0, F.concat(F.lit("Клиника "), F.col("id").cast("string"))).otherwise(F.col("name")))
    return V.flag_anonymous(c).select("id", "is_public")


@query(
    "s11_load_catalog",
    with_canon("""WITH r AS (SELECT CASE WHEN l % 2 = 0 THEN 'svc ' || CAST(l % 500 AS VARCHAR) ELSE 'new ' || CAST(l % 300 AS VARCHAR) END AS name FROM (SELECT o_orderkey AS l FROM orders))
    SELECT change, count(*) AS n FROM (SELECT CASE WHEN s.id IS NULL THEN 'created' WHEN r.name IS NOT NULL THEN 'updated' ELSE 'kept' END AS change
      FROM (SELECT p_partkey AS id, 'svc ' || CAST(p_partkey AS VARCHAR) AS name FROM part) s FULL JOIN (SELECT DISTINCT name FROM r) r ON s.name = r.name) GROUP BY ALL"""),
)
def s11(spark, d):
    o = raw(spark, d, "orders")
    k = F.col("o_orderkey")
    rows = o.select(k.alias("place"), F.when(k % 2 == 0, F.concat(F.lit("Svc "), (k % 500).cast("string"))).otherwise(F.concat(F.lit("new "), (k % 300).cast("string"))).alias("name"), F.lit("УЗИ").alias("specialty"), F.lit("В02.110.002").alias("code"))
    s = raw(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("svc "), F.col("p_partkey").cast("string")).alias("canonical_name"), F.lit("Прочее").alias("category"), F.array().cast("array<string>").alias("synonyms"), F.lit(None).cast("string").alias("tarificator_code"), F.lit("").alias("specialty"))
    return K.load_catalog(s, rows).groupBy("change").agg(F.count("*").alias("n"))


@query("s12_collected_records", with_canon(f"SELECT id, CAST(price AS DOUBLE) AS price, service_name_norm, category, is_active FROM (SELECT p.id, price, canonical_name AS service_name_norm, 'лаборатория' AS category, {FRESH} AS is_active FROM prices p JOIN clinics c ON p.clinic_id = c.id JOIN services s ON p.service_id = s.id ORDER BY p.id DESC, price OFFSET 50 LIMIT 500) WHERE is_active"))
def s12(spark, d):
    out = K.collected_records(P(spark, d), canon(spark, d, "clinics"), canon(spark, d, "services"), AS_OF, FRESH_DAYS, limit=500, offset=50, active_only=True)
    return out.select("id", dbl("price"), "service_name_norm", F.col("category"), "is_active")


@query("s13_export_catalog", with_canon("SELECT s.category, canonical_name, coalesce(tarificator_code, '') AS code, c.name AS clinic_name, CAST(price AS DOUBLE) AS price, CASE source_type WHEN 'upload' THEN 'Загрузка' WHEN 'api' THEN 'API' ELSE 'Сайт' END AS source, CAST(round_even(match_confidence * 100, 0) AS INTEGER) AS confidence_pct FROM prices p JOIN services s ON p.service_id = s.id JOIN clinics c ON p.clinic_id = c.id"))
def s13(spark, d):
    return K.export_catalog(P(spark, d), canon(spark, d, "services"), canon(spark, d, "clinics")).select("category", "canonical_name", "code", "clinic_name", dbl("price"), "source", "confidence_pct")


@query("s12_service_records", with_canon("SELECT p.id, CAST(price AS DOUBLE) AS price, canonical_name AS service_name_norm FROM prices p JOIN clinics c ON p.clinic_id = c.id JOIN services s ON p.service_id = s.id WHERE p.service_id = 42 ORDER BY p.id DESC LIMIT 100"))
def s12_service(spark, d):
    """The newest hundred records of one service."""
    return K.collected_records(P(spark, d), canon(spark, d, "clinics"), canon(spark, d, "services"), AS_OF, FRESH_DAYS, service_id=42).select("id", dbl("price"), "service_name_norm")


_KEYS = {"clinics": {"id": "clinics"}, "services": {"id": "services"}, "prices": {"clinic_id": "clinics", "service_id": "services"}, "price_history": {"clinic_id": "clinics", "service_id": "services"}, "subscriptions": {"clinic_id": "clinics", "service_id": "services"}, "runs": {"clinic_id": "clinics"}, "reports": {"clinic_id": "clinics"}}


@query("s14_remap_ids", with_canon("SELECT md5('clinics|' || CAST(clinic_id AS VARCHAR)) AS clinic_id, CASE WHEN service_id IS NOT NULL THEN md5('services|' || CAST(service_id AS VARCHAR)) END AS service_id, id FROM prices"))
def s14(spark, d):
    return K.remap_ids({"prices": P(spark, d)}, _KEYS)["prices"].select("clinic_id", "service_id", "id")


@query("s14_remap_counts", with_canon(" UNION ALL ".join(f"""SELECT '{t}' AS "table", count(*) AS "rows", count(*) AS copied, 0 AS lost FROM {t}""" for t in _KEYS)))
def s14_counts(spark, d):
    """All tables with references to clinics and services."""
    old = {t: canon(spark, d, t) for t in _KEYS}
    return K.remap_counts(old, K.remap_ids(old, _KEYS), _KEYS)


@query("s14_joined", with_canon("SELECT p.id, s.canonical_name, c.name FROM prices p JOIN services s ON p.service_id = s.id JOIN clinics c ON p.clinic_id = c.id"))
def s14_joined(spark, d):
    """References still meet after the change of ids."""
    t = K.remap_ids({x: canon(spark, d, x) for x in ("prices", "services", "clinics")}, _KEYS)
    s, c = t["services"].select(F.col("id").alias("service_id"), "canonical_name"), t["clinics"].select(F.col("id").alias("clinic_id"), "name")
    return t["prices"].join(s, "service_id").join(c, "clinic_id").select("id", "canonical_name", "name")


@query("s15_purge_raw", with_canon("SELECT id, CASE WHEN created_at < DATE '2001-04-01' THEN '' ELSE substr(raw_content, 1, 4) END AS raw_content FROM runs"))
def s15(spark, d):
    return V.purge_raw(canon(spark, d, "runs"), AS_OF, 90, 4).select("id", "raw_content")


@query(
    "s16_flatten_api",
    with_canon("""WITH b AS (SELECT o_orderkey AS place, o_custkey % 100 AS clinic_id, o_orderkey % 25 AS city_id, 'addr ' || CAST(o_orderkey AS VARCHAR) AS address FROM orders),
    r AS (SELECT b.*, n_name AS city, row_number() OVER (PARTITION BY clinic_id ORDER BY (n_name = 'NATION_3') DESC, place) AS r FROM b JOIN nation ON n_nationkey = city_id)
    SELECT c.id, r.city, coalesce(r.address, '') AS address, CASE WHEN r.place % 2 = 0 THEN 'p' || CAST(r.place AS VARCHAR) ELSE c.phone END AS phone FROM clinics c LEFT JOIN r ON r.clinic_id = c.id AND r = 1"""),
)
def s16(spark, d):
    k = F.col("o_orderkey")
    b = raw(spark, d, "orders").select(k.alias("place"), (F.col("o_custkey") % 100).alias("clinic_id"), (k % 25).cast("int").alias("city_id"), F.concat(F.lit("addr "), k.cast("string")).alias("address"), F.when(k % 2 == 0, F.array(F.concat(F.lit("p"), k.cast("string")))).otherwise(F.array().cast("array<string>")).alias("phones"), F.lit(1.0).alias("lat"), F.lit(2.0).alias("lng"))
    cities = raw(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    c = canon(spark, d, "clinics").select("id", "name", F.col("phone").alias("direct_phone"), F.col("rating").cast("string").alias("rating"))
    return X.flatten_api(c, b, cities, "NATION_3").select("id", "city", "address", "phone")


@query(
    "r18_reprocess",
    with_canon("""WITH line AS (SELECT l_orderkey AS run_id, l_linenumber AS n, 'B' || lpad(CAST(l_partkey % 90 AS VARCHAR), 2, '0') || '.' || lpad(CAST(l_partkey // 90 AS VARCHAR), 3, '0') || '.00' || CAST(l_linenumber AS VARCHAR) AS code, floor(l_extendedprice) AS price FROM lineitem WHERE floor(l_extendedprice) > 0),
    hit AS (SELECT r.clinic_id, l.run_id, s.id AS service_id, l.price FROM line l JOIN runs r ON r.id = l.run_id JOIN (SELECT min(p_partkey) AS id, 'B' || lpad(CAST(p_partkey % 90 AS VARCHAR), 2, '0') || '.' || lpad(CAST(p_partkey // 90 AS VARCHAR), 3, '0') || '.00' || CAST(p_partkey % 7 + 1 AS VARCHAR) AS code FROM part GROUP BY code) s ON s.code = l.code WHERE r.file_name <> '')
    SELECT clinic_id, service_id, min(price) AS price FROM hit GROUP BY ALL"""),
)
def r18(spark, d):
    """Originals of the runs that came from a file: a grid a run, with codes. What the current catalog has by code: of
    several services with one code the most similar name. These names differ only by their number, which no line has, so
    that is the shortest number and, of equals, the smallest: the smallest id."""
    none = _archive_prices(spark, d).limit(0)
    out, services = _reprocessed(spark, d, none, F.lit(False))
    return out.join(services.select(F.col("id").alias("service_id")), "service_id", "left_semi").where("change = 'inserted'").select("clinic_id", "service_id", dbl("price"))


def _archive_prices(spark, d):
    return P(spark, d).select("id", "clinic_id", "service_id", "raw_name", "price", "price_resident", "price_nonresident", "valid_from")


def _reprocessed(spark, d, prices, named):
    """(prices after reprocessing, catalog): lines where `named` holds have no code but the name of their service."""
    runs = canon(spark, d, "runs").where("file_name != ''").select(F.col("id").alias("run_id"), "clinic_id", F.col("created_at").alias("valid_from"))
    k = lambda x, n: F.lpad(x.cast("string"), n, "0")
    lines = raw(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.floor("l_extendedprice").alias("price")).where("price > 0")
    items = lines.join(runs.select(F.col("run_id").alias("l_orderkey")), "l_orderkey", "left_semi")
    items = items.withColumn("n", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "price")))
    of = lambda x, letter, n: F.concat(F.lit(letter), k(x % 90, 2), F.lit("."), k(F.floor(x / 90), 3), F.lit(".00"), n.cast("string"))
    title = lambda x: F.concat(F.lit("Тест гормона "), x.cast("string"))
    code = F.when(named, "").otherwise(of(F.col("l_partkey"), "В", F.col("l_linenumber")))
    name = F.when(named, title(F.col("l_partkey"))).otherwise("Услуга лаборатории")
    row = lambda i, *cells: F.struct(i.alias("row_idx"), F.array(*cells).alias("cells"))
    head, line = row(F.lit(1), F.lit("Код"), F.lit("Наименование услуг"), F.lit("Цена, тенге")), row(F.col("n") + 9, code, name, F.col("price").cast("string"))
    # The first line brings the header, so lines are read and dealt by run once.
    grid = items.select(F.col("l_orderkey").alias("run_id"), F.lit("s").alias("sheet"), F.inline(F.when(F.col("n") == 1, F.array(head, line)).otherwise(F.array(line))))
    p = F.col("p_partkey")
    services = raw(spark, d, "part").select(p.alias("id"), title(p).alias("canonical_name"), F.lit("Прочее").alias("category"), F.array().cast("array<string>").alias("synonyms"), of(p, "B", p % 7 + 1).alias("tarificator_code"), F.lit("").alias("specialty"))
    return V.reprocess(runs, grid, services, prices), services


@query(
    "r18_existing_prices",
    with_canon("""WITH line AS (SELECT l_orderkey AS run_id, l_linenumber AS n, l_partkey, 'B' || lpad(CAST(l_partkey % 90 AS VARCHAR), 2, '0') || '.' || lpad(CAST(l_partkey // 90 AS VARCHAR), 3, '0') || '.00' || CAST(l_linenumber AS VARCHAR) AS code, floor(l_extendedprice) AS price FROM lineitem WHERE floor(l_extendedprice) > 0),
    part_codes AS (SELECT p_partkey AS id, 'B' || lpad(CAST(p_partkey % 90 AS VARCHAR), 2, '0') || '.' || lpad(CAST(p_partkey // 90 AS VARCHAR), 3, '0') || '.00' || CAST(p_partkey % 7 + 1 AS VARCHAR) AS code FROM part),
    hit AS (SELECT r.clinic_id, s.id AS service_id, l.price FROM line l JOIN runs r ON r.id = l.run_id AND r.file_name <> '' JOIN part_codes s ON s.code = l.code AND l.n <> 7
      UNION ALL SELECT r.clinic_id, s.id, l.price FROM line l JOIN runs r ON r.id = l.run_id AND r.file_name <> '' JOIN part_codes s ON s.id = l.l_partkey AND l.n = 7),
    news AS (SELECT clinic_id, service_id, min(price) AS price FROM hit GROUP BY ALL)
    SELECT n.clinic_id, n.service_id, n.price, CASE WHEN EXISTS (SELECT 1 FROM prices p WHERE p.clinic_id = n.clinic_id AND p.service_id = n.service_id) THEN 'updated' ELSE 'inserted' END AS change FROM news n"""),
)
def r18_existing(spark, d):
    """Originals met by code, or by name where a line has no code, over the prices there are: those overwritten and added."""
    out, services = _reprocessed(spark, d, _archive_prices(spark, d), F.col("l_linenumber") == 7)
    return out.join(services.select(F.col("id").alias("service_id")), "service_id", "left_semi").where("change != 'kept'").select("clinic_id", "service_id", dbl("price"), "change")
