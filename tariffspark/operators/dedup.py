"""Deduplication, upserts, quality counts and summaries of prices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import text as T


def first_by(df: DataFrame, keys: list[str], *order) -> DataFrame:
    """The first row of every key in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def priority(source: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in R.SOURCE_PRIORITY.items() for x in kv])
    return F.coalesce(F.try_element_at(known, source), F.lit(0))


def dedup_min_price(items: DataFrame, keys=("clinic_id", "service_id")) -> DataFrame:
    """The cheapest item of each clinic and service; of equals the first."""
    return first_by(items, list(keys), "price", "id")


def match_counts(items: DataFrame, keys=("clinic_id",), threshold: float = R.MATCH) -> DataFrame:
    """Counted before dedup: positions at or above the threshold, and the rest."""
    ok = F.col("match_confidence") >= threshold
    return items.groupBy(*keys).agg(F.count("*").alias("items_found"), F.count_if(ok).alias("matched"), F.count_if(~ok | ok.isNull()).alias("needs_review"))


def upsert_prices(prices: DataFrame, batch: DataFrame) -> DataFrame:
    """One row a clinic and service of the batch overwrites the latest existing row unless its source ranks lower.
    Other existing rows stay. Batch columns: clinic_id, service_id, source_type, price, match_confidence, valid_from."""
    keys = ["clinic_id", "service_id"]
    w = Window.partitionBy(*keys).orderBy(F.desc("valid_from"), F.desc("id"))
    loose = prices.where("service_id is null")  # never overwritten, and many under one clinic
    old = prices.where("service_id is not null").withColumn("_r", F.row_number().over(w))
    new = batch.select(*keys, *[F.col(c).alias(f"n_{c}") for c in ("source_type", "price", "match_confidence", "valid_from")], F.lit(1).alias("_r"))
    both = old.join(new, [*keys, "_r"], "full")
    take = F.col("n_price").isNotNull() & (F.col("price").isNull() | (priority(F.col("n_source_type")) >= priority(F.col("source_type"))))
    pick = lambda c: F.when(take, F.col(f"n_{c}")).otherwise(F.col(c)).alias(c)
    state = F.when(take & F.col("price").isNull(), "inserted").when(take, "updated").otherwise("kept")
    cols = ("source_type", "price", "match_confidence", "valid_from")
    return both.select("id", *keys, *[pick(c) for c in cols], state.alias("change")).unionByName(loose.select("id", *keys, *cols, F.lit("kept").alias("change")))


def archive_valid(items: DataFrame) -> DataFrame:
    """Rows with a price and a name; adds primary_price."""
    price = F.coalesce(F.col("price_resident"), F.col("price_nonresident"))
    return items.where((price > 0) & (F.trim("raw_name") != "")).withColumn("primary_price", price)


def archive_dedup(items: DataFrame, doc: str = "run_id") -> DataFrame:
    """Rows without a price or a name go; per document the cheapest row of each service, or of each raw name where unmatched."""
    key = F.when(F.col("service_id").isNotNull(), F.col("service_id").cast("string")).otherwise(F.concat(F.lit("raw::"), F.lower("raw_name")))
    warned = F.coalesce(F.col("price_nonresident") < F.col("price_resident"), F.lit(False))
    return first_by(archive_valid(items).withColumn("dedup_key", key).withColumn("is_anomaly", warned), [doc, "dedup_key"], "primary_price", "id")


#: What A04 takes from a row.
ARCHIVED = ["price", "price_resident", "price_nonresident", "valid_from", "raw_name"]


def archive_overwrite(prices: DataFrame, matched: DataFrame) -> DataFrame:
    """A04 for matched rows: the cheapest of a clinic and service overwrites its latest row, the other rows there are stay."""
    keys = ["clinic_id", "service_id"]
    w = Window.partitionBy(*keys).orderBy(F.desc("valid_from"), F.desc("id"))
    loose = prices.where("service_id is null").select(*keys, *ARCHIVED, F.lit("kept").alias("change"))
    old = prices.where("service_id is not null").select("id", *keys, *ARCHIVED, F.row_number().over(w).alias("_r"))
    new = first_by(matched, keys, "price", "id").select(*keys, *[F.col(c).alias(f"n_{c}") for c in ARCHIVED])
    # Joined by the keys alone, as both sides lie by them: only the latest row is hit.
    merged = old.join(new, keys, "full")
    hit = F.col("n_price").isNotNull() & (F.coalesce("_r", F.lit(1)) == 1)
    state = F.when(~hit, "kept").when(F.col("_r").isNull(), "inserted").otherwise("updated")
    return merged.select(*keys, *[F.when(hit, F.col(f"n_{c}")).otherwise(F.col(c)).alias(c) for c in ARCHIVED], state.alias("change")).unionByName(loose)


def archive_add(unmatched: DataFrame) -> DataFrame:
    """A04 for unmatched rows: they are always added."""
    return unmatched.select("clinic_id", "service_id", *ARCHIVED, F.lit("inserted").alias("change"))


def archive_upsert(prices: DataFrame, batch: DataFrame) -> DataFrame:
    """Matched rows overwrite the clinic's latest row of the service, unmatched rows are always added."""
    return archive_overwrite(prices, batch.where("service_id is not null")).unionByName(archive_add(batch.where("service_id is null")))


def document_metrics(items: DataFrame, doc: str = "run_id") -> DataFrame:
    """Per document, positions, services, matches, review, skipped, anomalies (after dedup), coded and automatic rate."""
    kept = archive_dedup(items, doc).groupBy(doc).agg(F.count_if("is_anomaly").alias("anomalies"), F.count("*").alias("services"))
    price = F.coalesce(F.col("price_resident"), F.col("price_nonresident"))
    valid = F.coalesce((price > 0) & (F.trim("raw_name") != ""), F.lit(False))
    ok = valid & F.col("service_id").isNotNull() & (F.col("match_confidence") >= R.MATCH)
    all_ = items.groupBy(doc).agg(F.count("*").alias("items"), F.count_if(ok).alias("matched"), F.count_if(valid & ~ok).alias("needs_review"), F.count_if(~valid).alias("skipped"))
    out = all_.join(kept, doc, "left").fillna(0, ["anomalies", "services"])
    done = F.col("items") - F.col("skipped")
    rate = F.when(done > 0, F.bround(100.0 * F.col("matched") / done, 1)).otherwise(0.0)
    return out.withColumn("auto_rate", rate).withColumn("status", F.when(done == 0, "empty").otherwise("ok"))


def archive_quality(runs: DataFrame, prices: DataFrame, codes: DataFrame) -> DataFrame:
    """Documents, positions and automatic rate over runs that came from a file, and rows of coded services."""
    ours = prices.join(runs.where("file_name != ''").select(F.col("id").alias("run_id")), "run_id", "left_semi")
    coded = codes.where("tarificator_code is not null").select(F.col("id").alias("service_id"), F.lit(1).alias("coded"))
    ours = ours.join(coded, "service_id", "left")
    ok = F.col("service_id").isNotNull() & (F.col("match_confidence") >= R.MATCH)
    out = ours.agg(F.countDistinct("run_id").alias("documents"), F.count("*").alias("positions"), F.count_if(ok).alias("matched"), F.count("coded").alias("with_code"))
    rate = F.when(F.col("positions") > 0, F.bround(100.0 * F.col("matched") / F.col("positions"), 1)).otherwise(0.0)
    return out.withColumn("auto_rate", rate).withColumn("goal_met", rate >= 70)


def coverage_report(prices: DataFrame, clinics: DataFrame) -> DataFrame:
    """Per source, rows, priced services and cities; open review rows."""
    return prices.join(clinics.select(F.col("id").alias("clinic_id"), "city"), "clinic_id").groupBy("source_type").agg(F.count("*").alias("n"), F.countDistinct("service_id").alias("services"), F.countDistinct("city").alias("cities"), F.count_if(F.col("match_confidence") < R.MATCH).alias("open_review"))


def quality_report(metrics: DataFrame, prices: DataFrame) -> DataFrame:
    """Totals over documents (A05's rows): positions, services, matched, review, skipped, anomalies, the automatic
    rate of positions and whether it meets the goal; and the rows of `prices` that wait for an operator."""
    names = ("items", "services", "matched", "needs_review", "skipped", "anomalies")
    total = metrics.agg(F.count("*").alias("documents"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names])
    rate = F.bround(100.0 * F.col("matched") / F.greatest(F.col("matched") + F.col("needs_review"), F.lit(1)), 1)
    queue = prices.agg(F.count_if(F.col("service_id").isNull()).alias("queue"))
    return total.withColumn("auto_rate", rate).withColumn("goal_met", rate >= 70).withColumn("_one", F.lit(1)).join(queue.withColumn("_one", F.lit(1)), "_one").drop("_one")  # single rows


def ingest_stats(clinics: DataFrame, services: DataFrame, prices: DataFrame, runs: DataFrame, reports: DataFrame) -> DataFrame:
    """One row of counters."""
    c = clinics.agg(F.count("*").alias("clinics"), F.countDistinct(F.nullif(F.trim("city"), F.lit(""))).alias("cities"))
    s = services.agg(F.count("*").alias("services"))
    sources = [F.count_if(F.col("source_type") == x).alias(f"from_{x}") for x in R.SOURCE_PRIORITY]
    p = prices.agg(F.count("*").alias("prices"), F.count_if(F.col("match_confidence") < R.MATCH).alias("below_threshold"), *sources)
    r = runs.agg(F.count_if((F.col("items_found") == 0) | (F.col("status") == "F")).alias("bad_runs"))
    n = reports.agg(F.count_if(F.col("status") == "new").alias("new_reports"))
    one = lambda d: d.withColumn("_one", F.lit(1))  # noqa: E731  each side is a single row
    out = one(c)
    for d in (s, p, r, n):
        out = out.join(one(d), "_one")
    return out.drop("_one")


def service_summary(offers: DataFrame) -> DataFrame:
    """Per service, offers, least, largest and mean price, and spread in percent."""
    out = offers.groupBy("service_id").agg(F.count("*").alias("offers_count"), F.min("price").alias("min_price"), F.max("price").alias("max_price"), (F.sum("price").cast("double") / F.count("*")).alias("avg_price"))
    lo, hi = F.col("min_price").cast("double"), F.col("max_price").cast("double")
    return out.withColumn("spread_pct", F.when(hi > 0, F.floor((hi - lo) / hi * 100 + 0.5)).otherwise(0).cast("long"))


def variant_families(services: DataFrame, prices: DataFrame) -> DataFrame:
    """A10: every priced service with its base key, label, offers and least price; how many other priced services have
    the key (siblings) and the cheapest of them. Rows grow with the services, not with pairs of them."""
    priced = prices.where("service_id is not null").groupBy("service_id").agg(F.count("*").alias("offers_count"), F.min("price").alias("min_price"))
    rows = services.select(F.col("id").alias("service_id"), "canonical_name", T.col_base_key("canonical_name").alias("base_key"), T.col_variant_label("canonical_name").alias("label")).join(priced, "service_id")
    # The cheapest sibling is the cheapest of the family, or the next one for that service itself.
    at = F.struct("min_price", "service_id")
    key, same = F.col("base_key").alias("_key"), F.col("base_key").eqNullSafe(F.col("_key"))
    family = rows.groupBy(key).agg((F.count("*") - 1).alias("siblings"), F.min(at).alias("_first"))
    rows = rows.join(family, same).drop("_key")
    rest = rows.where(at != F.col("_first")).groupBy(key).agg(F.min(at).alias("_second"))
    rows = rows.join(rest, same, "left").drop("_key")
    return rows.withColumn("cheapest_sibling", F.when(at == F.col("_first"), F.col("_second.service_id")).otherwise(F.col("_first.service_id"))).drop("_first", "_second")


def variant_siblings(services: DataFrame, prices: DataFrame, asked: DataFrame) -> DataFrame:
    """A10: for the asked services (id), the other priced services of the same base key."""
    family = variant_families(services, prices).select("service_id", "canonical_name", "base_key", "label", "offers_count", "min_price")
    want = services.join(asked.select("id").distinct(), "id", "left_semi").select("id", T.col_base_key("canonical_name").alias("base_key"))
    return want.join(family, "base_key").where("id != service_id").drop("base_key")


def categories_present(services: DataFrame) -> DataFrame:
    """Enum values that occur, in enum order."""
    order = F.array(*[F.lit(x) for x in R.CATEGORY_ENUM])
    c = T.col_category_enum("category", "specialty", "canonical_name")
    return services.select(c.alias("category_enum")).distinct().withColumn("place", F.array_position(order, F.col("category_enum"))).orderBy("place")


def cities_with_prices(clinics: DataFrame, prices: DataFrame) -> DataFrame:
    """Cities of public clinics that have prices."""
    open_ = clinics.where("is_public and city is not null and city != ''").select(F.col("id").alias("clinic_id"), "city")
    return open_.join(prices.select("clinic_id"), "clinic_id", "left_semi").select("city").distinct().orderBy("city")


def city_coverage(clinics: DataFrame, prices: DataFrame, cities: DataFrame) -> DataFrame:
    """Every directory city with its clinics that have prices, and cities beyond the directory."""
    have = clinics.where("is_public").join(prices.select(F.col("clinic_id").alias("id")), "id", "left_semi").groupBy("city").agg(F.count("*").alias("clinics"))
    out = cities.select(F.col("name").alias("city"), F.lit(True).alias("listed")).join(have, "city", "full")
    return out.select("city", F.coalesce("listed", F.lit(False)).alias("listed"), F.coalesce("clinics", F.lit(0)).alias("clinics"), (F.coalesce("clinics", F.lit(0)) > 0).alias("has_data"))


def partners(clinics: DataFrame, prices: DataFrame, city: str | None = None) -> DataFrame:
    """Clinics with their price counts, most first."""
    n = prices.groupBy(F.col("clinic_id").alias("id")).agg(F.count("*").alias("prices"))
    found = clinics.where(F.lower("city").contains(city.lower())) if city else clinics
    return found.join(n, "id", "left").select("id", "name", "city", F.coalesce("prices", F.lit(0)).alias("prices")).orderBy(F.desc("prices"), "name")


def source_runs(sources: DataFrame, runs: DataFrame) -> DataFrame:
    """Sources that pull, enabled first, with run counts."""
    n = runs.groupBy(F.col("source_id").alias("id")).agg(F.count("*").alias("runs"), F.max("created_at").alias("last_run"))
    return sources.where("type != 'upload'").join(n, "id", "left").withColumn("runs", F.coalesce("runs", F.lit(0))).orderBy(F.desc("enabled"), "id")


def price_trend(history: DataFrame) -> DataFrame:
    """Exact daily median a service; change in percent from the first to the last of at least two days."""
    day = history.groupBy("service_id", "recorded_at").agg(F.round(F.median(F.col("price").cast("double")), 2).alias("median"))
    out = day.groupBy("service_id").agg(F.count("*").alias("points"), F.min_by("median", "recorded_at").alias("first"), F.max_by("median", "recorded_at").alias("last")).where("points >= 2")
    change = F.when(F.col("first") != 0, F.bround((F.col("last") - F.col("first")) / F.col("first") * 100, 1)).otherwise(0.0)
    return out.withColumn("change_pct", change).withColumn("direction", F.when(change > 1, "up").when(change < -1, "down").otherwise("flat"))


def curate(items: DataFrame) -> DataFrame:
    """Classified items only; the cheapest row of each clinic and canonical name."""
    return first_by(items.where("canonical is not null"), ["clinic_id", "canonical"], "price", "id")


def dedup_items(items: DataFrame) -> DataFrame:
    """One item a lower-cased name and price, the first."""
    return first_by(items.withColumn("_n", F.lower("raw_name")), ["_n", "price"], "id").drop("_n")


def duplicate_runs(prices: DataFrame) -> DataFrame:
    """Runs of a clinic whose sets of unmatched names are equal: all but the best matched one, to be rolled back.

    The set is named by order-free sums of two hashes over distinct names, so no run's names are gathered."""
    open_ = prices.where("service_id is null").select("clinic_id", "run_id", "raw_name").distinct()
    marks = open_.groupBy("clinic_id", "run_id").agg(F.count("*").alias("names"), F.sum(F.xxhash64("raw_name").cast("decimal(38,0)")).alias("h1"), F.sum(F.crc32(F.col("raw_name").cast("binary"))).alias("h2"))
    ok = prices.groupBy("clinic_id", "run_id").agg(F.count_if(F.col("service_id").isNotNull()).alias("matched"))
    w = Window.partitionBy("clinic_id", "names", "h1", "h2").orderBy(F.desc("matched"), F.desc("run_id"))
    return marks.join(ok, ["clinic_id", "run_id"]).withColumn("_r", F.row_number().over(w)).where("_r > 1").select("clinic_id", "run_id", "names", "matched")
