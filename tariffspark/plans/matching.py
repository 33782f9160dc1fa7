"""Queries of the matching operators."""

from pyspark.sql import functions as F

from ..data import AS_OF, FRESH_DAYS, canon, raw, with_canon
from ..functions import text as T
from ..operators import match as M
from ..operators import compare as C
from .comparisons import OFFERS
from .registry import query


def services(spark, d):
    """One catalog service a distinct name, with the plain name as synonym (the catalog is small; the names are many)."""
    return canon(spark, d, "services").groupBy("canonical_name").agg(F.min("id").alias("id"), F.min("category").alias("category"), F.min("specialty").alias("specialty"), F.min("tarificator_code").alias("tarificator_code"), F.array_sort(F.collect_set("synonym")).alias("synonyms"))


SERVICES = "(SELECT canonical_name, min(id) AS id, min(category) AS category, min(tarificator_code) AS tarificator_code, min(synonym) AS synonym FROM services GROUP BY ALL)"
KEYS = f"(SELECT key, max(id) AS service_id FROM (SELECT id, lower(canonical_name) AS key FROM {SERVICES} UNION ALL SELECT id, lower(synonym) FROM {SERVICES}) GROUP BY ALL)"


def items(spark, d):
    """Noisy part names: word order, case, brackets and typos by key."""
    p = raw(spark, d, "part")
    k = F.col("p_partkey") % 4
    name = F.when(k == 0, F.upper("p_name")).when(k == 1, F.concat(F.initcap("p_type"), F.lit(" (x) "), "p_name")).when(k == 2, F.concat(F.substring("p_name", 1, 5), F.lit("x"), F.substring("p_name", 6, 50))).otherwise(F.concat("p_name", F.lit(" "), "p_brand"))
    return p.select(F.col("p_partkey").alias("item_id"), name.alias("raw_name"))


def vectors(spark, d):
    e = raw(spark, d, "embeddings")
    return e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("q"), F.col("embedding").alias("v")), e.select(F.col("vec_id").alias("c"), F.col("embedding").alias("v"))


@query("m01_dictionary", with_canon(f"SELECT key, service_id FROM {KEYS}"))
def m01(spark, d):
    return M.build_dictionary(services(spark, d)).select("key", "service_id")


@query("m02_match_by_code", with_canon(f"SELECT o_orderkey AS item_id, code, sole FROM (SELECT o_orderkey, 'B' || lpad(CAST(o_orderkey % 40 AS VARCHAR), 2, '0') || '.' || lpad(CAST(o_orderkey % 600 AS VARCHAR), 3, '0') || '.001' AS code FROM orders) JOIN (SELECT tarificator_code AS code, CASE WHEN count(*) = 1 THEN min(id) END AS sole FROM {SERVICES} GROUP BY ALL) USING (code)"))
def m02(spark, d):
    """Items with the code found, which their service must bear, and the service where it alone has that code (SQL has no
    name similarity to choose among several)."""
    k = F.col("o_orderkey")
    it = raw(spark, d, "orders").select(k.alias("item_id"), F.col("o_orderpriority").alias("raw_name"), F.concat(F.lit("B"), F.lpad((k % 40).cast("string"), 2, "0"), F.lit("."), F.lpad((k % 600).cast("string"), 3, "0"), F.lit(".001")).alias("code"))
    s = services(spark, d)
    codes = s.groupBy(F.col("tarificator_code").alias("code")).agg(F.count("*").alias("n"))
    got = M.match_by_code(it, s).join(s.select(F.col("id").alias("service_id"), F.col("tarificator_code").alias("code")), "service_id")
    return got.join(codes, "code").select("item_id", "code", F.when(F.col("n") == 1, F.col("service_id")).alias("sole"))


@query("m03_match_fuzzy")
def m03(spark, d):
    return M.match_fuzzy(items(spark, d), M.build_dictionary(services(spark, d)))


@query(
    "m03_token_subset",
    with_canon(f"""WITH i AS (SELECT p_partkey AS item_id, list_distinct(string_split(lower(CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN p_type || ' ' || p_name WHEN 2 THEN substr(p_name, 1, 5) || 'x' || substr(p_name, 6) ELSE p_name || ' ' || replace(p_brand, '#', ' ') END), ' ')) AS a FROM part),
    k AS (SELECT key, arg_max(service_id, service_id) AS service_id, min(place) AS place FROM (SELECT lower(canonical_name) AS key, id AS service_id, id * 1024 AS place FROM {SERVICES} UNION ALL SELECT lower(synonym), id, id * 1024 + 1 FROM {SERVICES}) GROUP BY ALL)
    SELECT item_id, arg_min(service_id, place) AS service_id, 1.0E0 AS confidence FROM i, k WHERE list_has_all(a, string_split(key, ' ')) OR list_has_all(string_split(key, ' '), a) GROUP BY ALL"""),
)
def m03_exact(spark, d):
    """The tier of score 100: all words of the item or of a key are in the other. Every item is asked."""
    return M.match_fuzzy(items(spark, d), M.build_dictionary(services(spark, d))).where("confidence = 1")


@query("m04_match_guarded")
def m04(spark, d):
    s = services(spark, d)
    return M.match_guarded(items(spark, d), M.build_dictionary(s), s).select("item_id", "service_id", "confidence")


@query("m05_top_candidates")
def m05(spark, d):
    return M.top_candidates(items(spark, d), M.build_dictionary(services(spark, d)))


@query(
    "m06_semantic_topk",
    """WITH s AS (SELECT a.vec_id AS q, b.vec_id AS c, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS s FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0)
    SELECT q, c, round(s, 4) AS score, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY s DESC, c) AS r FROM s) WHERE r <= 3""",
)
def m06(spark, d):
    return M.semantic_topk(*vectors(spark, d), 3).select("q", "c", F.round("score", 4).alias("score"), "rank")


def _vecs(spark, d):
    """Vectors of the items and of the services: of each part two rows of the embeddings."""
    e = raw(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("v"))
    n = F.lit(max(1, e.count()))
    p = raw(spark, d, "part").select("p_partkey", (F.col("p_partkey") % n).alias("a"), (F.col("p_partkey") * 7 % n).alias("b"))
    of = lambda at, name: p.join(e, F.col(at) == F.col("vec_id")).select(F.col("p_partkey").alias(name), "v")
    return of("a", "q"), of("b", "c")


@query("m07_match_one")
def m07(spark, d):
    s = services(spark, d)
    return M.match_one(items(spark, d), M.build_dictionary(s), s, _vecs(spark, d), floor=0.72, sem_floor=0.85)


@query("m08_match")
def m08(spark, d):
    s = services(spark, d)
    return M.match(items(spark, d), M.build_dictionary(s), s, _vecs(spark, d))


@query("m09_analyze_lines")
def m09(spark, d):
    s = services(spark, d)
    lines = raw(spark, d, "part").select(F.col("p_partkey").alias("line_id"), F.when(F.col("p_partkey") % 3 == 0, F.concat("p_name", F.lit(", "), "p_type", F.lit(" x"))).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("Липидограмма "), "p_name")).otherwise(F.concat("p_name", F.lit(" "), "p_type")).alias("text"))
    asked, catalog = _vecs(spark, d)
    whole = asked.select(F.xxhash64("q", F.lit(-1)).alias("q"), "v")  # lines as a whole have part -1
    return M.analyze_lines(lines, M.build_dictionary(s), s, (whole, catalog))


@query("m10_normalize")
def m10(spark, d):
    return M.normalize(items(spark, d), services(spark, d).where("id % 3 <> 0"), _vecs(spark, d))[0]


@query("m11_preview")
def m11(spark, d):
    s = services(spark, d)
    return M.preview(items(spark, d), M.build_dictionary(s), s, _vecs(spark, d))


@query("m12_sanitize_synonyms", with_canon("SELECT id, CASE WHEN id % 3 = 0 THEN 2 WHEN id % 3 = 1 THEN 1 ELSE 0 END AS removed, CASE WHEN id % 3 = 2 THEN 'syn ' || CAST(id AS VARCHAR) ELSE 'keep' END AS synonyms FROM (SELECT p_partkey AS id FROM part)"))
def m12(spark, d):
    k = F.col("p_partkey")
    own = F.concat(F.lit("svc "), k.cast("string"))
    other = F.concat(F.lit("SVC (x) "), F.when(k == 0, 1).otherwise(0).cast("string"))
    s = raw(spark, d, "part").select(k.alias("id"), own.alias("canonical_name"), F.when(k % 3 == 0, F.array(own, F.lit(" "), F.lit("keep"))).when(k % 3 == 1, F.array(F.lit("keep"), other)).otherwise(F.array(F.concat(F.lit("syn "), k.cast("string")))).alias("synonyms"))
    return M.sanitize_synonyms(s).select("id", F.col("removed").cast("int").alias("removed"), F.array_join("synonyms", "|").alias("synonyms"))


@query(
    "m13_semantic_backfill",
    with_canon("""WITH v AS (SELECT 'Item ' || CAST(vec_id AS VARCHAR) AS q, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), c AS (SELECT vec_id AS c, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
    b AS (SELECT q, arg_max(c, (s, -c)) AS c, max(s) AS s FROM (SELECT q, c, list_cosine_similarity(v.v, c.v) AS s FROM v, c) GROUP BY ALL HAVING max(s) >= 0.85)
    SELECT id, c AS new_service_id FROM prices JOIN b ON raw_name = q WHERE match_confidence < 0.78"""),
)
def m13(spark, d):
    e = raw(spark, d, "embeddings")
    names = e.select(F.concat(F.lit("Item "), F.col("vec_id").cast("string")).alias("q"), F.col("embedding").alias("v"))
    cat = e.select(F.col("vec_id").alias("c"), F.col("embedding").alias("v"))
    return M.semantic_backfill(canon(spark, d, "prices"), names, cat).select("id", "new_service_id")


@query(
    "m14_suspect_bindings",
    with_canon("""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)
    SELECT p.id, round(list_cosine_similarity(a.v, b.v), 6) AS cosine FROM (SELECT id, id % (SELECT count(*) FROM embeddings) AS n, id * 7 % (SELECT count(*) FROM embeddings) AS s FROM prices WHERE match_confidence >= 0.78 AND service_id IS NOT NULL) p JOIN e a ON a.vec_id = n JOIN e b ON b.vec_id = s WHERE list_cosine_similarity(a.v, b.v) < 0.55"""),
)
def m14(spark, d):
    return _suspects(spark, d)


def _suspects(spark, d, **page):
    e = raw(spark, d, "embeddings")
    n = F.lit(max(1, e.count()))
    p = canon(spark, d, "prices").where("service_id is not null").withColumn("raw_name", (F.col("id") % n).cast("string")).withColumn("service_id", F.col("id") * 7 % n)
    names = e.select(F.col("vec_id").cast("string").alias("q"), F.col("embedding").alias("v"))
    return M.suspect_bindings(p, names, e.select(F.col("vec_id").alias("c"), F.col("embedding").alias("v")), **page).select("id", F.round("cosine", 6).alias("cosine"))


@query("m15_review_candidates")
def m15(spark, d):
    it = items(spark, d).withColumn("service_id", F.col("item_id"))
    return M.review_candidates(it, services(spark, d), _vecs(spark, d))


def _queries(spark, d):
    p = raw(spark, d, "part")
    k = F.col("p_partkey") % 4
    q = F.when(k == 0, F.concat("p_name", F.lit(" "), "p_type")).when(k == 1, F.col("p_name")).when(k == 2, F.substring_index("p_name", " ", 1)).otherwise(F.substring("p_name", 1, 3))
    return p.select(F.col("p_partkey").alias("query_id"), q.alias("query"))


_TOKENS = "string_split(lower(canonical_name), ' ')"


@query(
    "m16_relevance",
    with_canon(f"""WITH q AS (SELECT p_partkey AS query_id, lower(trim(CASE p_partkey % 4 WHEN 0 THEN p_name || ' ' || p_type WHEN 1 THEN p_name WHEN 2 THEN string_split(p_name, ' ')[1] ELSE substr(p_name, 1, 3) END)) AS ql FROM part),
    s AS (SELECT id, lower(canonical_name) AS ck, lower(synonym) AS sk, {_TOKENS} AS ct, string_split(lower(synonym), ' ') AS st FROM {SERVICES})
    SELECT query_id, id AS service_id, score FROM (SELECT query_id, id, CAST(CASE WHEN ql = ck THEN 1.0 WHEN ql = sk THEN 0.97 WHEN list_contains(ct, ql) THEN 0.92 WHEN list_contains(st, ql) THEN 0.88
      WHEN len(ql) >= 3 AND len(list_filter(ct, lambda t: starts_with(t, ql))) > 0 THEN 0.84 WHEN len(ql) >= 3 AND len(list_filter(st, lambda t: starts_with(t, ql))) > 0 THEN 0.78 WHEN len(ql) >= 5 AND (contains(ck, ql) OR contains(sk, ql)) THEN 0.72 ELSE 0 END AS DOUBLE) AS score FROM q, s) WHERE score >= 0.7"""),
)
def m16(spark, d):
    return M.relevance(_queries(spark, d), services(spark, d), typos=False)


@query("m16_relevance_typos")
def m16_typos(spark, d):
    return M.relevance(_queries(spark, d), services(spark, d))


@query("m17_suggest")
def m17(spark, d):
    return M.suggest(_queries(spark, d), services(spark, d))


@query(
    "m17_suggest_plain",
    with_canon(f"""WITH q AS (SELECT p_partkey AS query_id, lower(trim(CASE p_partkey % 4 WHEN 0 THEN p_name || ' ' || p_type WHEN 1 THEN p_name WHEN 2 THEN string_split(p_name, ' ')[1] ELSE substr(p_name, 1, 3) END)) AS ql FROM part),
    s AS (SELECT id, canonical_name, lower(canonical_name) AS ck, lower(synonym) AS sk, {_TOKENS} AS ct, string_split(lower(synonym), ' ') AS st FROM {SERVICES}),
    r AS (SELECT query_id, id, canonical_name, ck, CAST(CASE WHEN ql = ck THEN 1.0 WHEN ql = sk THEN 0.97 WHEN list_contains(ct, ql) THEN 0.92 WHEN list_contains(st, ql) THEN 0.88
      WHEN len(ql) >= 3 AND len(list_filter(ct, lambda t: starts_with(t, ql))) > 0 THEN 0.84 WHEN len(ql) >= 3 AND len(list_filter(st, lambda t: starts_with(t, ql))) > 0 THEN 0.78 WHEN len(ql) >= 5 AND (contains(ck, ql) OR contains(sk, ql)) THEN 0.72 ELSE 0 END AS DOUBLE) AS score FROM q, s WHERE len(ql) >= 2),
    once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, ck ORDER BY score DESC, id) AS n FROM r WHERE score >= 0.7) WHERE n = 1)
    SELECT query_id, canonical_name, score, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, len(canonical_name), canonical_name) AS place FROM once) WHERE place <= 8"""),
)
def m17_plain(spark, d):
    """Without the typo tier, which SQL cannot express."""
    return M.suggest(_queries(spark, d), services(spark, d), typos=False)


@query("m18_rank_services")
def m18(spark, d):
    s = services(spark, d)
    q = raw(spark, d, "part").select(F.col("p_partkey").alias("question"), F.concat(F.lit("how much is "), "p_name", F.lit(" "), "p_type", F.lit("?")).alias("text"))
    return M.rank_services(q, s, M.build_dictionary(s))


def _search_sql(category: str = "TRUE") -> str:
    """Places of the services that have offers, by relevance without the typo tier, or by name where there is no query."""
    return with_canon(f"""WITH q AS (SELECT p_partkey AS query_id, CASE WHEN p_partkey % 10 <> 9 THEN lower(trim(CASE p_partkey % 4 WHEN 0 THEN p_name || ' ' || p_type WHEN 1 THEN p_name WHEN 2 THEN string_split(p_name, ' ')[1] ELSE substr(p_name, 1, 3) END)) END AS ql FROM part),
    o AS (SELECT service_id, count(*) AS offers_count FROM {OFFERS} GROUP BY ALL),
    s AS (SELECT id, canonical_name, offers_count, lower(canonical_name) AS ck, lower(synonym) AS sk, {_TOKENS} AS ct, string_split(lower(synonym), ' ') AS st FROM {SERVICES} JOIN o ON service_id = id WHERE {category}),
    r AS (SELECT query_id, id, canonical_name, offers_count, CAST(CASE WHEN ql = ck THEN 1.0 WHEN ql = sk THEN 0.97 WHEN list_contains(ct, ql) THEN 0.92 WHEN list_contains(st, ql) THEN 0.88
      WHEN len(ql) >= 3 AND len(list_filter(ct, lambda t: starts_with(t, ql))) > 0 THEN 0.84 WHEN len(ql) >= 3 AND len(list_filter(st, lambda t: starts_with(t, ql))) > 0 THEN 0.78 WHEN len(ql) >= 5 AND (contains(ck, ql) OR contains(sk, ql)) THEN 0.72 ELSE 0 END AS DOUBLE) AS score FROM q, s WHERE ql IS NOT NULL)
    SELECT query_id, id AS service_id, score, CAST(place AS INTEGER) AS place, offers_count FROM (
      SELECT query_id, id, score, offers_count, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, canonical_name, id) AS place FROM r WHERE score >= 0.7
      UNION ALL SELECT query_id, id, NULL, offers_count, place FROM q, (SELECT id, offers_count, row_number() OVER (ORDER BY canonical_name, id) AS place FROM s) WHERE ql IS NULL) WHERE place <= 20""")


def _search(spark, d, catalog, category=None, typos=False):
    t = [canon(spark, d, x) for x in ("prices", "clinics", "services", "price_history")]
    t[2] = t[2].withColumn("specialty", F.when(F.col("id") % 2 == 0, "МРТ").otherwise(F.col("specialty")))
    asked = _queries(spark, d).withColumn("query", F.when(F.col("query_id") % 10 != 9, F.col("query")))
    return M.search(asked, catalog, C.comparison(*t, AS_OF, FRESH_DAYS), category=category, typos=typos).select("query_id", "service_id", "score", "place", "offers_count")


@query("w05_search", _search_sql())
def w05(spark, d):
    return _search(spark, d, services(spark, d))


@query("w05_search_category", _search_sql("(id % 2 = 0 OR contains(lower(category), 'диагностика'))"))
def w05_category(spark, d):
    """Every second service is a scan by its specialty: found by the enum, not by the catalog's own category."""
    return _search(spark, d, services(spark, d), "диагностика")


@query("w05_search_part", _search_sql("contains(lower(category), 'brand#1')"))
def w05_part(spark, d):
    return _search(spark, d, services(spark, d), "Brand#1")


@query("w05_search_typos")
def w05_typos(spark, d):
    return _search(spark, d, services(spark, d), typos=True)


@query("m19_upsert_clinics", with_canon("WITH c AS (SELECT n, arg_min(city, place) AS city FROM (SELECT o_orderkey AS place, CASE WHEN o_custkey % 2 = 0 THEN 'Supplier#' || lpad(CAST(o_custkey % 200 AS VARCHAR), 9, '0') ELSE 'new ' || CAST(o_custkey % 50 AS VARCHAR) END AS n, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE o_orderpriority END AS city FROM orders) GROUP BY ALL) SELECT coalesce(k.name, n) AS name, coalesce(nullif(trim(c.city), ''), k.city, '') AS city, k.id IS NULL AS created FROM clinics k FULL JOIN c ON k.name = n"))
def m19(spark, d):
    o, k = raw(spark, d, "orders"), F.col("o_custkey")
    cards = o.select(F.col("o_orderkey").alias("place"), F.when(k % 2 == 0, F.concat(F.lit("Supplier#"), F.lpad((k % 200).cast("string"), 9, "0"))).otherwise(F.concat(F.lit("new "), (k % 50).cast("string"))).alias("name"), F.when(F.col("o_orderkey") % 3 == 0, "").otherwise(F.col("o_orderpriority")).alias("city"), F.lit("").alias("address"), F.lit(None).cast("string").alias("phone"))
    return M.upsert_clinics(canon(spark, d, "clinics"), cards).select("name", "city", "created")


_CITIES = ("Алматы", "Астана", "Усть-Каменогорск", "Семей")
_CARD_CITY = "CASE o_orderkey % 8 WHEN 0 THEN 'almaty' WHEN 1 THEN ' АСТАНА ' WHEN 2 THEN 'nur-sultan' WHEN 3 THEN 'uk' WHEN 4 THEN 'semei' WHEN 5 THEN '' WHEN 6 THEN 'new-town on hill' ELSE 'ust-kamenogorsk' END"


@query("m19_canonical_city", with_canon("""WITH c AS (SELECT 'clinic ' || CAST(o_custkey AS VARCHAR) AS name, arg_min(o_orderkey % 8, o_orderkey) AS k FROM orders GROUP BY ALL)
    SELECT name, CASE k WHEN 0 THEN 'Алматы' WHEN 1 THEN 'Астана' WHEN 2 THEN 'Астана' WHEN 3 THEN 'Усть-Каменогорск' WHEN 4 THEN 'Семей' WHEN 5 THEN '' WHEN 6 THEN 'New-Town On Hill' ELSE 'Усть-Каменогорск' END AS city FROM c
    UNION ALL SELECT name, city FROM clinics"""))
def m19_city(spark, d):
    """Cities of cards as names, slugs and other slugs of sources become those of the directory."""
    cards = raw(spark, d, "orders").select(F.col("o_orderkey").alias("place"), F.concat(F.lit("clinic "), F.col("o_custkey").cast("string")).alias("name"), F.expr(_CARD_CITY).alias("city"), F.lit("").alias("address"), F.lit("").alias("phone"))
    cities = spark.createDataFrame([(x,) for x in _CITIES], "name string")
    return M.upsert_clinics(canon(spark, d, "clinics"), cards, cities).select("name", "city")


@query(
    "m13_backfill_codes",
    with_canon("""WITH v AS (SELECT 'Item ' || CAST(vec_id AS VARCHAR) AS q, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), c AS (SELECT vec_id AS c, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
    b AS (SELECT q, arg_max(c, (s, -c)) AS c, max(s) AS s FROM (SELECT q, c, list_cosine_similarity(v.v, c.v) AS s FROM v, c) GROUP BY ALL HAVING max(s) >= 0.85),
    w AS (SELECT p.id, raw_name, CASE WHEN p.id % 3 = 0 THEN 'own' END AS own FROM prices p WHERE match_confidence < 0.78),
    f AS (SELECT w.id, coalesce(own, tarificator_code) AS code FROM w JOIN b ON raw_name = q LEFT JOIN services s ON s.id = b.c)
    SELECT (SELECT count(*) FROM w) AS checked, (SELECT count(DISTINCT raw_name) FROM w) AS unique_names, count(*) AS assigned, count(code) AS with_code, sum(CASE WHEN code <> 'own' THEN 1 ELSE 0 END)::BIGINT AS filled FROM f"""),
)
def m13_codes(spark, d):
    """Counters of the second pass, and how many empty codes it filled."""
    e = raw(spark, d, "embeddings")
    names = e.select(F.concat(F.lit("Item "), F.col("vec_id").cast("string")).alias("q"), F.col("embedding").alias("v"))
    p = canon(spark, d, "prices").withColumn("tarificator_code", F.when(F.col("id") % 3 == 0, "own").otherwise(""))
    out = M.semantic_backfill(p, names, e.select(F.col("vec_id").alias("c"), F.col("embedding").alias("v")), canon(spark, d, "services"))
    filled = out.agg(F.sum((F.col("tarificator_code") != "own").cast("long")).alias("filled"))
    return M.backfill_counts(p, out).crossJoin(filled)  # one row each


@query(
    "m14_suspect_window",
    with_canon("""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)
    SELECT p.id, round(list_cosine_similarity(a.v, b.v), 6) AS cosine FROM (SELECT id, id % (SELECT count(*) FROM embeddings) AS n, id * 7 % (SELECT count(*) FROM embeddings) AS s FROM prices WHERE match_confidence >= 0.78 AND service_id IS NOT NULL ORDER BY id LIMIT 400 OFFSET 800) p JOIN e a ON a.vec_id = n JOIN e b ON b.vec_id = s WHERE list_cosine_similarity(a.v, b.v) < 0.55"""),
)
def m14_window(spark, d):
    """The third window of 400 sure rows by id."""
    return _suspects(spark, d, offset=800, window=400)


@query("m20_upsert_sources", "SELECT DISTINCT o_custkey % 100 AS clinic_id, o_orderpriority AS url FROM orders WHERE o_orderpriority NOT LIKE '1%'")
def m20(spark, d):
    o = raw(spark, d, "orders").select((F.col("o_custkey") % 100).alias("clinic_id"), F.lit("api").alias("type"), F.col("o_orderpriority").alias("url"))
    return M.upsert_sources(o.where("url like '1%'").distinct(), o).select("clinic_id", "url")


@query("m21_enrich_clinics", with_canon("WITH f AS (SELECT o_custkey % 100 AS id, arg_min(o_orderpriority, o_orderkey) AS w FROM orders GROUP BY ALL) SELECT c.id, CASE WHEN website = '' THEN coalesce(w, website) ELSE website END AS website, website = '' AND w IS NOT NULL AS filled_website FROM clinics c LEFT JOIN f ON c.id = f.id"))
def m21(spark, d):
    cards = raw(spark, d, "orders").select(F.col("o_orderkey").alias("place"), (F.col("o_custkey") % 100).alias("clinic_id"), F.lit("p").alias("phone"), F.col("o_orderpriority").alias("website"), F.lit("a").alias("address"))
    return M.enrich_clinics(canon(spark, d, "clinics"), cards).select("id", "website", "filled_website")
