"""Queries of the comparison operators."""

from pyspark.sql import functions as F

from ..data import AS_OF, FRESH_DAYS, canon, raw, with_canon
from ..operators import compare as C
from .dedups import FRESH, OFFERS, dbl
from .registry import query

USER = (43.2, 76.9)
FAR = "2 * 6371.0 * asin(sqrt(pow(sin(radians(lat - 43.2) / 2), 2) + cos(radians(43.2)) * cos(radians(lat)) * pow(sin(radians(lng - 76.9) / 2), 2)))"


def _offers(spark, d, **k):
    return C.offers(canon(spark, d, "prices"), canon(spark, d, "clinics"), AS_OF, FRESH_DAYS, **k)


def _cheapest(spark, d):
    return C.cheapest_by_clinic(canon(spark, d, "prices"), canon(spark, d, "clinics"), AS_OF, FRESH_DAYS)


CHEAP = f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY service_id, clinic_id ORDER BY price, id) AS rn FROM {OFFERS}) WHERE rn = 1)"
WANTED = "(SELECT o_custkey % 200 AS basket, o_orderkey % 100 AS service_id, min(o_orderkey) AS place FROM orders GROUP BY ALL)"


def _wanted(spark, d):
    return raw(spark, d, "orders").groupBy((F.col("o_custkey") % 200).alias("basket"), (F.col("o_orderkey") % 100).alias("service_id")).agg(F.min("o_orderkey").alias("place"))


def _ranked_wanted(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("basket").orderBy("place")
    return _wanted(spark, d).withColumn("place", F.row_number().over(w))


RANKED = f"(SELECT basket, service_id, row_number() OVER (PARTITION BY basket ORDER BY place) AS place FROM {WANTED})"


@query("w01_fresh", with_canon(f"SELECT source_type, {FRESH} AS is_fresh, count(*) AS n FROM prices GROUP BY ALL"))
def w01(spark, d):
    return C.with_fresh(canon(spark, d, "prices"), AS_OF, FRESH_DAYS).groupBy("source_type", "is_fresh").agg(F.count("*").alias("n"))


@query("w02_mark_stale", with_canon("SELECT clinic_id, coalesce(is_active AND parsed_at < DATE '2000-06-30', false) AS was_stale, CASE WHEN is_active AND parsed_at < DATE '2000-06-30' THEN false ELSE is_active END AS is_active, count(*) AS n FROM prices GROUP BY ALL"))
def w02(spark, d):
    return C.mark_stale(canon(spark, d, "prices"), AS_OF, FRESH_DAYS).groupBy("clinic_id", "was_stale", "is_active").agg(F.count("*").alias("n"))


@query("w03_offers", with_canon(f"SELECT id, service_id, clinic_id, CAST(price AS DOUBLE) AS price, round({FAR}, 3) AS distance_km FROM {OFFERS} WHERE price BETWEEN 5000 AND 60000 AND rating >= 2 AND online_booking"))
def w03(spark, d):
    return _offers(spark, d, min_price=5000, max_price=60000, min_rating=2, online=True, user=USER).select("id", "service_id", "clinic_id", dbl("price"), F.round("distance_km", 3).alias("distance_km"))


@query("w03_offer_order", with_canon(f"SELECT service_id, place, CAST(price AS DOUBLE) AS price FROM (SELECT *, row_number() OVER (PARTITION BY service_id ORDER BY price, id) AS place FROM {OFFERS})"))
def w03_order(spark, d):
    return C.ranked(_offers(spark, d)).select("service_id", F.col("place").cast("long").alias("place"), dbl("price"))


@query(
    "w04_comparison",
    with_canon(f"""WITH o AS (SELECT service_id, count(*) AS offers_count, CAST(min(price) AS DOUBLE) AS min_price FROM {OFFERS} GROUP BY ALL),
    f AS (SELECT service_id, clinic_id, CAST(price AS DOUBLE) AS price, row_number() OVER (PARTITION BY service_id ORDER BY price, id) AS place FROM {OFFERS})
    SELECT s.id AS service_id, canonical_name, lower(canonical_name) AS base_key, coalesce(offers_count, 0) AS offers_count, min_price, CAST(place AS INTEGER) AS place, clinic_id, price
    FROM services s LEFT JOIN o ON o.service_id = s.id LEFT JOIN f ON f.service_id = s.id"""),
)
def w04(spark, d):
    t = [canon(spark, d, x) for x in ("prices", "clinics", "services", "price_history")]
    out = C.comparison(*t, AS_OF, FRESH_DAYS)
    rows = C.ranked(C.offers(t[0], t[1], AS_OF, FRESH_DAYS)).select("service_id", "place", "clinic_id", dbl("price"))
    return out.select("service_id", "canonical_name", "base_key", "offers_count", dbl("min_price")).join(rows, "service_id", "left")


@query(
    "w04_documents",
    with_canon(f"""WITH o AS (SELECT service_id, count(*) AS offers_count FROM {OFFERS} GROUP BY ALL),
    f AS (SELECT service_id, string_agg(CAST(clinic_id AS VARCHAR) || ':' || CAST(price AS VARCHAR), ' ' ORDER BY place) AS offers FROM (SELECT service_id, clinic_id, price, row_number() OVER (PARTITION BY service_id ORDER BY price DESC, id) AS place FROM {OFFERS}) WHERE place <= 5 GROUP BY ALL)
    SELECT s.id AS service_id, CASE s.id % 3 WHEN 0 THEN 'қызмет ' || CAST(s.id AS VARCHAR) ELSE canonical_name END AS shown_name, coalesce(offers_count, 0) AS offers_count, coalesce(offers, '') AS offers
    FROM services s LEFT JOIN o ON o.service_id = s.id LEFT JOIN f ON f.service_id = s.id"""),
)
def w04_documents(spark, d):
    """The five dearest offers nested in each document, under the second-language name where there is one."""
    t = [canon(spark, d, x) for x in ("prices", "clinics", "services", "price_history")]
    k = F.col("id")
    t[2] = t[2].withColumn("name_kk", F.when(k % 3 == 0, F.concat(F.lit("қызмет "), k.cast("string"))).when(k % 3 == 1, ""))
    out = C.comparison_documents(*t, AS_OF, FRESH_DAYS, sort="price_desc", most=5, locale="kk")
    text = F.transform(F.coalesce("offers", F.array().cast(out.schema["offers"].dataType)), lambda o: F.concat(o["clinic_id"].cast("string"), F.lit(":"), o["price"].cast("string")))
    return out.select("service_id", "shown_name", "offers_count", F.array_join(text, " ").alias("offers"))


@query("w06_list_services", with_canon("SELECT id, canonical_name FROM services WHERE category = 'Brand#7'"))
def w06(spark, d):
    return C.list_services(canon(spark, d, "services"), "Brand#7").select("id", "canonical_name")


@query("w07_cheapest_by_clinic", with_canon(f"SELECT service_id, clinic_id, CAST(price AS DOUBLE) AS price, id FROM {CHEAP}"))
def w07(spark, d):
    return _cheapest(spark, d).select("service_id", "clinic_id", dbl("price"), "id")


MATRIX = f"""a AS (SELECT * FROM {RANKED} WHERE place <= 8), k AS (SELECT basket, count(*) AS n_services FROM a GROUP BY ALL),
    h AS (SELECT basket, a.service_id, clinic_id, price FROM a JOIN {CHEAP} c ON a.service_id = c.service_id),
    t AS (SELECT basket, clinic_id, count(*) AS found_count, sum(price) AS total FROM h GROUP BY ALL),
    r AS (SELECT t.*, n_services, row_number() OVER (PARTITION BY t.basket ORDER BY found_count DESC, total, clinic_id) AS col FROM t JOIN k ON t.basket = k.basket),
    x AS (SELECT * FROM r WHERE col <= 4),
    m AS (SELECT x.basket, x.clinic_id, a.service_id, x.total, found_count = n_services AS covers_all, max(x.total) OVER (PARTITION BY x.basket) - x.total AS savings, h.price, min(h.price) OVER (PARTITION BY x.basket, a.service_id) AS best, x.col, round_even({FAR}, 1) AS distance_km, max(x.total) OVER (PARTITION BY x.basket) AS max_total
          FROM x JOIN a ON x.basket = a.basket JOIN clinics c ON c.id = x.clinic_id LEFT JOIN h ON h.basket = x.basket AND h.service_id = a.service_id AND h.clinic_id = x.clinic_id)"""


def _matrix(spark, d):
    return C.compare_clinics(_cheapest(spark, d), canon(spark, d, "clinics"), _ranked_wanted(spark, d), user=USER, as_of=AS_OF)


@query("w08_compare_clinics", with_canon(f"WITH {MATRIX} SELECT basket, clinic_id, service_id, CAST(price AS DOUBLE) AS price, coalesce(price = best, false) AS is_best, covers_all, CAST(total AS DOUBLE) AS total, CAST(savings AS DOUBLE) AS savings_vs_max FROM m"))
def w08(spark, d):
    return _matrix(spark, d).select("basket", "clinic_id", "service_id", dbl("price"), "is_best", "covers_all", dbl("total"), dbl("savings_vs_max"))


@query(
    "w09_recommend",
    with_canon(f"""WITH {MATRIX}, u AS (SELECT DISTINCT basket, clinic_id, col, total, max_total, covers_all, distance_km FROM m),
    v AS (SELECT *, covers_all OR NOT bool_or(covers_all) OVER (PARTITION BY basket) AS pool FROM u)
    SELECT basket, arg_min(clinic_id, (total, col)) FILTER (pool) AS cheapest, arg_min(clinic_id, (distance_km, col)) FILTER (distance_km IS NOT NULL) AS nearest FROM v GROUP BY ALL"""),
)
def w09(spark, d):
    return C.recommend(_matrix(spark, d)).select("basket", "cheapest", "nearest")


@query("w10_leaders", with_canon(f"SELECT service_id, clinic_id, CAST(price AS DOUBLE) AS price FROM (SELECT *, min(price) OVER (PARTITION BY service_id) AS b, count(price) OVER (PARTITION BY service_id) AS n FROM {CHEAP}) WHERE n >= 2 AND price = b"))
def w10(spark, d):
    return C.leaders(_cheapest(spark, d), ["service_id"], "price").select("service_id", "clinic_id", dbl("price"))


@query("w11_nearest", with_canon(f"SELECT service_id, round(min({FAR}), 3) AS nearest_km FROM {OFFERS} GROUP BY ALL"))
def w11(spark, d):
    return C.order_by_nearest(_offers(spark, d, user=USER)).select("service_id", F.round("nearest_km", 3).alias("nearest_km"))


_LINES = "(SELECT basket, CASE WHEN service_id % 10 <> 0 THEN service_id END AS service_id, 'line ' || CAST(service_id AS VARCHAR) AS text FROM " + WANTED + ")"


def _lines(spark, d):
    w = _wanted(spark, d)
    return w.select("basket", F.when(F.col("service_id") % 10 != 0, F.col("service_id")).alias("service_id"), F.concat(F.lit("line "), F.col("service_id").cast("string")).alias("text"))


@query(
    "w12_basket_mixed",
    with_canon(f"""WITH l AS (SELECT * FROM {_LINES}), b AS (SELECT service_id, min(price) AS price FROM {OFFERS} GROUP BY ALL),
    m AS (SELECT basket, count(*) AS recognized, count(price) AS priced, CAST(sum(price) AS DOUBLE) AS total FROM (SELECT DISTINCT basket, service_id FROM l WHERE service_id IS NOT NULL) q LEFT JOIN b ON q.service_id = b.service_id GROUP BY ALL),
    n AS (SELECT basket, string_agg(DISTINCT text, ',' ORDER BY text) AS lost FROM l WHERE service_id IS NULL GROUP BY ALL)
    SELECT coalesce(m.basket, n.basket) AS basket, recognized, priced, total, lost FROM m FULL JOIN n ON m.basket = n.basket"""),
)
def w12(spark, d):
    return C.basket_mixed(_lines(spark, d), _cheapest(spark, d)).select("basket", "recognized", "priced", dbl("total"), F.array_join("not_recognized", ",").alias("lost"))


@query(
    "w13_basket_single",
    with_canon(f"""WITH q AS (SELECT DISTINCT basket, service_id FROM {_LINES} WHERE service_id IS NOT NULL), k AS (SELECT basket, count(*) AS n FROM q GROUP BY ALL),
    t AS (SELECT q.basket, clinic_id, count(*) AS covered, sum(price) AS total FROM q JOIN {CHEAP} c ON q.service_id = c.service_id GROUP BY ALL)
    SELECT t.basket, clinic_id, covered, CAST(total AS DOUBLE) AS total, CAST(n - covered AS INTEGER) AS missing, row_number() OVER (PARTITION BY t.basket ORDER BY covered DESC, total, clinic_id) = 1 AS is_best FROM t JOIN k ON t.basket = k.basket"""),
)
def w13(spark, d):
    return C.basket_single(_lines(spark, d), _cheapest(spark, d)).select("basket", "clinic_id", "covered", dbl("total"), F.size("missing").alias("missing"), "is_best")


@query(
    "w14_answer_offers",
    with_canon(f"""WITH q AS (SELECT o_orderkey AS question, o_orderkey % 1000 AS service_id FROM orders),
    o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY service_id ORDER BY price, id) AS place FROM (SELECT service_id, clinic_id, price, min(id) AS id FROM {OFFERS} GROUP BY ALL)) WHERE place <= 6)
    SELECT question, q.service_id, clinic_id, CAST(price AS DOUBLE) AS price, place = 1 AS is_cheapest FROM q JOIN o ON q.service_id = o.service_id"""),
)
def w14(spark, d):
    q = raw(spark, d, "orders").select(F.col("o_orderkey").alias("question"), (F.col("o_orderkey") % 1000).alias("service_id"), F.lit(1).alias("place"))
    return C.answer_offers(q, _offers(spark, d)).select("question", "service_id", "clinic_id", dbl("price"), "is_cheapest")


@query("w15_partner_services", with_canon("SELECT p.id, clinic_id, coalesce(canonical_name, raw_name) AS service_name, coalesce(tarificator_code, '') AS code, CAST(price AS DOUBLE) AS price FROM prices p LEFT JOIN services s ON p.service_id = s.id"))
def w15(spark, d):
    return C.partner_services(canon(spark, d, "prices"), canon(spark, d, "services")).select("id", "clinic_id", "service_name", "code", dbl("price"))


@query("w16_service_partners", with_canon("SELECT service_id, clinic_id, CAST(price_resident AS DOUBLE) AS tariff FROM prices WHERE service_id IS NOT NULL"))
def w16(spark, d):
    return C.service_partners(canon(spark, d, "prices"), canon(spark, d, "clinics")).select("service_id", "clinic_id", dbl("tariff"))


@query("w17_clinic_profile", with_canon("SELECT c.id, count(p.id) AS prices, CAST(min(price) AS DOUBLE) AS min_price, coalesce(nullif(website, ''), arg_min(source_url, (p.id, source_url)) FILTER (source_url <> ''), '') AS website FROM clinics c LEFT JOIN prices p ON p.clinic_id = c.id GROUP BY c.id, website"))
def w17(spark, d):
    return C.clinic_profile(canon(spark, d, "clinics"), canon(spark, d, "prices")).select("id", "prices", dbl("min_price"), "website")


@query("w18_clinic_sheet", with_canon("SELECT clinic_id, p.id, coalesce(canonical_name, raw_name) AS service_name, source_type = 'upload' AND match_confidence >= 1.0 AS confirmed, count(*) FILTER (source_type = 'upload' AND match_confidence >= 1.0) OVER (PARTITION BY clinic_id) AS confirmed_count FROM prices p LEFT JOIN services s ON p.service_id = s.id"))
def w18(spark, d):
    return C.clinic_sheet(canon(spark, d, "prices"), canon(spark, d, "services")).select("clinic_id", "id", "service_name", "confirmed", "confirmed_count")


@query("w18_list_clinics", with_canon("SELECT id, name FROM clinics WHERE is_public"))
def w18_list(spark, d):
    return C.list_clinics(canon(spark, d, "clinics")).select("id", "name")


@query("w19_cap_per_key", with_canon("SELECT city, id FROM (SELECT *, row_number() OVER (PARTITION BY city ORDER BY id) AS r FROM clinics) WHERE r <= 3"))
def w19(spark, d):
    return C.cap_per_key(canon(spark, d, "clinics"), ["city"], 3, "id").select("city", "id")
