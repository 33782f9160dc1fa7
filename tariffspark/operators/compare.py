"""Offers, comparisons, rankings, matrices and baskets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .dedup import first_by, price_trend, service_summary, variant_families


def with_fresh(prices: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """Active (null counts as active) and parsed within the window, or valid within it where never parsed."""
    cutoff = F.date_sub(F.lit(as_of).cast("date"), days)
    active = F.coalesce("is_active", F.lit(True))
    seen = F.coalesce(F.col("parsed_at").cast("date"), F.col("valid_from"))
    return prices.withColumn("is_fresh", active & F.coalesce(seen >= cutoff, F.lit(True)))


def mark_stale(prices: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """Rows that are active by word and parsed before the window become inactive; null stays null."""
    old = F.col("is_active") & (F.col("parsed_at").cast("date") < F.date_sub(F.lit(as_of).cast("date"), days))
    return prices.withColumn("was_stale", F.coalesce(old, F.lit(False))).withColumn("is_active", F.when(F.col("was_stale"), False).otherwise(F.col("is_active")))


def offers(prices: DataFrame, clinics: DataFrame, as_of: str, days: int = 30, *, city=None, min_price=None, max_price=None, min_rating=None, online=None, include_stale=False, user=None) -> DataFrame:
    """Fresh prices of public clinics that pass the filters, with distance from the user's (lat, lng)."""
    c = clinics.where("is_public")
    if city is not None:
        c = c.where(F.col("city") == city)
    if min_rating is not None:
        c = c.where(F.col("rating") >= min_rating)
    if online is not None:
        c = c.where(F.col("online_booking") == online)
    p = with_fresh(prices.where("service_id is not null"), as_of, days)
    if not include_stale:
        p = p.where("is_fresh")
    if min_price is not None:
        p = p.where(F.col("price") >= min_price)
    if max_price is not None:
        p = p.where(F.col("price") <= max_price)
    out = p.join(c.select(F.col("id").alias("clinic_id"), F.col("name").alias("clinic_name"), "city", "district", "lat", "lng", "rating", "online_booking", "website"), "clinic_id")
    far = T.col_haversine(F.lit(user[0]), F.lit(user[1]), "lat", "lng") if user else F.lit(None).cast("double")
    return out.withColumn("distance_km", far).withColumn("source_url", F.coalesce(F.nullif("source_url", F.lit("")), F.col("website"), F.lit("")))


def ranked(found: DataFrame, sort: str = "price_asc") -> DataFrame:
    """place of each offer within its service; ties keep input order."""
    order = {"price_asc": F.asc("price"), "price_desc": F.desc("price"), "updated": F.desc_nulls_last("parsed_at"), "distance": F.asc_nulls_last("distance_km")}[sort]
    return found.withColumn("place", F.row_number().over(Window.partitionBy("service_id").orderBy(order, "id", "price")))


def comparison(prices: DataFrame, clinics: DataFrame, services: DataFrame, history: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """A document a service: summary, attributes, siblings (their number, the cheapest, and the base key by which
    `variant_families` lists them) and trend. `ranked(offers(...))` has its offers, one a row."""
    found = offers(prices, clinics, as_of, days)
    near = variant_families(services, prices).select("service_id", "siblings", "cheapest_sibling")
    trend = price_trend(history).select("service_id", F.struct("points", "change_pct", "direction").alias("trend"))
    return services.select(F.col("id").alias("service_id"), "canonical_name", "category", T.col_category_enum("category", "specialty", "canonical_name").alias("category_enum"), T.col_attributes("canonical_name").alias("attributes"), T.col_base_key("canonical_name").alias("base_key")).join(service_summary(found), "service_id", "left").join(near, "service_id", "left").join(trend, "service_id", "left").fillna(0, ["offers_count"])


def localized(services: DataFrame, locale: str | None) -> DataFrame:
    """Services under their names and descriptions in a second language (columns name_<locale>, description_<locale>)
    where they have them."""
    own = {"canonical_name": f"name_{locale}", "description": f"description_{locale}"}
    filled = lambda c: F.coalesce(F.nullif(F.col(own[c]), F.lit("")), F.col(c))
    return services.withColumns({c: filled(c) for c in own if c in services.columns and own[c] in services.columns})


def comparison_documents(prices: DataFrame, clinics: DataFrame, services: DataFrame, history: DataFrame, as_of: str, days: int = 30, *, sort: str = "price_asc", most: int = 50, locale: str | None = None, **filters) -> DataFrame:
    """W04 as one document a service: `comparison` with its first `most` offers nested in the order asked for (they are cut
    before they are gathered, so a service with many offers stays small; offers_count counts all), and shown under the
    name of a locale. Attributes, category and siblings go by the canonical name."""
    found = ranked(offers(prices, clinics, as_of, days, **filters), sort).where(F.col("place") <= most)
    fields = ("place", "clinic_id", "clinic_name", "city", "price", "source_type", "parsed_at", "source_url", "distance_km")
    nested = found.groupBy("service_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("offers"))
    shown = localized(services, locale).select(F.col("id").alias("service_id"), F.col("canonical_name").alias("shown_name"))
    return comparison(prices, clinics, services, history, as_of, days).join(nested, "service_id", "left").join(shown, "service_id", "left")


def cheapest_by_clinic(prices: DataFrame, clinics: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """The cheapest fresh price of each public clinic for each service."""
    return first_by(offers(prices, clinics, as_of, days), ["service_id", "clinic_id"], "price", "id")


def compare_clinics(cheapest: DataFrame, clinics: DataFrame, wanted: DataFrame, *, clinic_ids: DataFrame | None = None, most: int = 4, user=None, require_all=False, as_of: str | None = None) -> DataFrame:
    """Cells of the matrix of wanted services (basket, service_id) by at most `most` clinics a basket: those given,
    or the ones that cover most, then the cheapest in total. Baskets are independent, so all are answered at once."""
    ask = first_by(wanted.where("place <= 8"), ["basket", "service_id"], "place")
    size = ask.groupBy("basket").agg(F.count("*").alias("n_services"))
    hits = ask.join(cheapest.select("service_id", "clinic_id", "price", "parsed_at"), "service_id")
    totals = hits.groupBy("basket", "clinic_id").agg(F.count("*").alias("found_count"), F.sum("price").alias("total"))
    if clinic_ids is None:
        w = Window.partitionBy("basket").orderBy(F.desc("found_count"), "total", "clinic_id")
        chosen = totals.withColumn("column", F.row_number().over(w)).where(F.col("column") <= most)
    else:
        given = first_by(clinic_ids, ["basket", "clinic_id"], "place")
        given = given.withColumn("column", F.row_number().over(Window.partitionBy("basket").orderBy("place"))).where(F.col("column") <= most)
        chosen = given.select("basket", "clinic_id", "column").join(totals, ["basket", "clinic_id"], "left").fillna(0, ["found_count"])
    chosen = chosen.join(size, "basket").withColumn("covers_all", F.col("found_count") == F.col("n_services"))
    if require_all:
        chosen = chosen.where("covers_all")
    c = clinics.where("is_public").select(F.col("id").alias("clinic_id"), F.col("name").alias("clinic_name"), "lat", "lng")
    far = F.bround(T.col_haversine(F.lit(user[0]), F.lit(user[1]), "lat", "lng"), 1) if user else F.lit(None).cast("double")
    chosen = chosen.join(c, "clinic_id").withColumn("distance_km", far).withColumn("total", F.coalesce("total", F.lit(0)))
    chosen = chosen.withColumn("max_total", F.max("total").over(Window.partitionBy("basket"))).withColumn("savings_vs_max", F.col("max_total") - F.col("total"))
    cells = chosen.join(ask, "basket").join(hits.select("basket", "service_id", "clinic_id", "price", "parsed_at"), ["basket", "service_id", "clinic_id"], "left")
    best = F.min("price").over(Window.partitionBy("basket", "service_id"))
    days = F.date_diff(F.lit(as_of).cast("date"), F.col("parsed_at").cast("date")) if as_of else F.lit(None).cast("int")
    return cells.withColumn("found", F.col("price").isNotNull()).withColumn("is_best", F.coalesce(F.col("price") == best, F.lit(False))).withColumn("freshness_days", days)


def recommend(matrix: DataFrame) -> DataFrame:
    """Per basket the cheapest (of full covers, else of all), the nearest, and the best balance of both."""
    cols = matrix.select("basket", "clinic_id", "column", "total", "max_total", "covers_all", "distance_km").distinct()
    b = Window.partitionBy("basket")
    cols = cols.withColumn("any_full", F.max("covers_all").over(b))
    pool = F.col("covers_all") | ~F.col("any_full")
    cols = cols.withColumn("in_pool", pool).withColumn("pool_far", F.max(F.when(pool, F.col("distance_km").isNotNull())).over(b))
    near = F.col("distance_km").isNotNull() & (F.col("in_pool") | ~F.col("pool_far")) & (F.col("max_total") > 0)
    far = F.max(F.when(near, F.col("distance_km"))).over(b)
    score = F.when(near, 0.6 * F.col("total").cast("double") / F.col("max_total").cast("double") + 0.4 * F.col("distance_km") / F.when(far > 0, far).otherwise(1.0))
    cols = cols.withColumn("balance", score)
    return cols.groupBy("basket").agg(F.min_by("clinic_id", F.when(F.col("in_pool"), F.struct("total", "column"))).alias("cheapest"), F.min_by("clinic_id", F.when(F.col("distance_km").isNotNull(), F.struct("distance_km", "column"))).alias("nearest"), F.min_by("clinic_id", F.when(F.col("balance").isNotNull(), F.struct("balance", "column"))).alias("best_balance"))


def leaders(df: DataFrame, group: list[str], metric: str, mode: str = "min") -> DataFrame:
    """Rows that tie for the least or largest value, where at least two values are present."""
    best = (F.min if mode == "min" else F.max)(metric).alias("_b")
    top = df.groupBy(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)]).agg(F.count(metric).alias("_n"), best).where("_n >= 2")
    same = [df[g].eqNullSafe(top[f"_g{i}"]) for i, g in enumerate(group)]
    return df.join(top, [*same, df[metric] == top["_b"]]).select(*[df[c] for c in df.columns])


def order_by_nearest(found: DataFrame) -> DataFrame:
    """Services by distance to their closest offer, missing last."""
    return found.groupBy("service_id").agg(F.min("distance_km").alias("nearest_km")).orderBy(F.asc_nulls_last("nearest_km"), "service_id")


def list_services(services: DataFrame, category: str | None = None, limit: int | None = None) -> DataFrame:
    """Services of a category by name."""
    out = services.where(F.col("category") == category) if category else services
    out = out.orderBy("canonical_name", "id")
    return out.limit(limit) if limit else out


def basket_mixed(lines: DataFrame, cheapest: DataFrame) -> DataFrame:
    """Per basket the cheapest offer of each recognised service, the total, and what was not recognised."""
    best = first_by(cheapest, ["service_id"], "price", "clinic_id").select("service_id", "clinic_id", "price")
    ask = lines.where("service_id is not null").select("basket", "service_id").distinct().join(best, "service_id", "left")
    out = ask.groupBy("basket").agg(F.count("*").alias("recognized"), F.count("price").alias("priced"), F.sum("price").alias("total"))
    lost = lines.where("service_id is null").groupBy("basket").agg(F.array_sort(F.collect_set("text")).alias("not_recognized"))
    return out.join(lost, "basket", "full")


def basket_single(lines: DataFrame, cheapest: DataFrame) -> DataFrame:
    """Per basket and clinic the services covered, their total and those missing; best: covers most, then costs least."""
    ask = lines.where("service_id is not null").select("basket", "service_id").distinct()
    size = ask.groupBy("basket").agg(F.array_sort(F.collect_set("service_id")).alias("wanted"))
    out = ask.join(cheapest.select("service_id", "clinic_id", "price"), "service_id").groupBy("basket", "clinic_id").agg(F.count("*").alias("covered"), F.sum("price").alias("total"), F.collect_set("service_id").alias("have"))
    w = Window.partitionBy("basket").orderBy(F.desc("covered"), "total", "clinic_id")
    return out.join(size, "basket").select("basket", "clinic_id", "covered", "total", F.array_except("wanted", "have").alias("missing"), (F.row_number().over(w) == 1).alias("is_best"))


def answer_offers(matched: DataFrame, found: DataFrame, services: int = 3, most: int = 6) -> DataFrame:
    """Per question its first services with their first offers, one of them marked as the cheapest."""
    top = matched.where(F.col("place") <= services).select("question", "service_id", F.col("place").alias("service_place"))
    once = first_by(found, ["service_id", "clinic_id", "price"], "id")
    listed = ranked(once).where(F.col("place") <= most).select("service_id", "clinic_id", "price", "place")
    return top.join(listed, "service_id").withColumn("is_cheapest", F.col("place") == 1)


def partner_services(prices: DataFrame, services: DataFrame) -> DataFrame:
    """All prices with names and codes, falling back on the raw name."""
    s = services.select(F.col("id").alias("service_id"), "canonical_name", "tarificator_code")
    return prices.join(s, "service_id", "left").select("id", "clinic_id", F.coalesce("canonical_name", "raw_name").alias("service_name"), F.coalesce("tarificator_code", F.lit("")).alias("code"), "price")


def service_partners(prices: DataFrame, clinics: DataFrame) -> DataFrame:
    """Who offers a service, by resident tariff, else price, else last."""
    key = F.coalesce(F.nullif("price_resident", F.lit(0).cast("decimal(12,2)")), F.nullif("price", F.lit(0).cast("decimal(12,2)")))
    w = Window.partitionBy("service_id").orderBy(F.asc_nulls_last("tariff"), "clinic_id", "id")
    out = prices.where("service_id is not null").withColumn("tariff", key).join(clinics.select(F.col("id").alias("clinic_id"), F.col("name").alias("clinic_name")), "clinic_id")
    return out.withColumn("place", F.row_number().over(w)).select("service_id", "clinic_id", "clinic_name", "tariff", "place", "id")


def clinic_profile(clinics: DataFrame, prices: DataFrame) -> DataFrame:
    """Price count, least price, and the website or else the first source address."""
    p = prices.groupBy(F.col("clinic_id").alias("id")).agg(F.count("*").alias("prices"), F.min("price").alias("min_price"), F.min_by(F.nullif("source_url", F.lit("")), F.when(F.nullif("source_url", F.lit("")).isNotNull(), F.struct("id", "source_url"))).alias("first_url"))
    return clinics.join(p, "id", "left").select("id", "name", F.coalesce("prices", F.lit(0)).alias("prices"), "min_price", F.coalesce(F.nullif("website", F.lit("")), "first_url", F.lit("")).alias("website"))


def clinic_sheet(prices: DataFrame, services: DataFrame) -> DataFrame:
    """A clinic's own rows with the confirmed flag, and its confirmed count."""
    s = services.select(F.col("id").alias("service_id"), "canonical_name")
    ok = (F.col("source_type") == "upload") & (F.col("match_confidence") >= 1.0)
    out = prices.join(s, "service_id", "left").withColumn("confirmed", ok)
    n = prices.groupBy(F.col("clinic_id").alias("_clinic")).agg(F.count_if(ok).alias("confirmed_count"))
    out = out.join(n, F.col("clinic_id").eqNullSafe(F.col("_clinic")))
    return out.select("clinic_id", "id", F.coalesce("canonical_name", "raw_name").alias("service_name"), "price", "confirmed", "confirmed_count")


def list_clinics(clinics: DataFrame, city: str | None = None) -> DataFrame:
    """Public clinics by name."""
    out = clinics.where("is_public")
    return (out.where(F.col("city") == city) if city else out).orderBy("name", "id")


def cap_per_key(df: DataFrame, key: list[str], n: int, *order) -> DataFrame:
    """At most n rows a key, in order."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("_r") <= n).drop("_r")
