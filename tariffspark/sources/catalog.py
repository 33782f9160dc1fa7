"""Catalog loading, exports and id changes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import text as T
from ..operators.compare import with_fresh
from ..operators.dedup import first_by


def load_catalog(services: DataFrame, rows: DataFrame) -> DataFrame:
    """Services (id, canonical_name, category, synonyms, tarificator_code, specialty) after the official rows (place,
    name, specialty, code), with `change`: created, updated, alias or kept.

    Rows meet services by lower-cased name; an alias row is folded into its canon as a synonym; codes and specialties are
    taken where given and different; the category only where empty or "other"."""
    alias = F.create_map(*[F.lit(x) for kv in R.CANON_ALIASES.items() for x in kv])
    r = rows.select("place", F.trim("name").alias("r_name"), F.coalesce(F.trim("specialty"), F.lit("")).alias("r_spec"), T.col_norm_code("code").alias("r_code")).where("r_name != ''")
    old = services.withColumn("key", F.lower(F.trim("canonical_name")))
    have = old.groupBy("key").agg(F.max("id").alias("target"))
    r = r.withColumn("own", F.lower("r_name")).withColumn("to", F.try_element_at(alias, F.lower("r_name")))
    r = r.join(have.select(F.col("key").alias("to"), F.lit(True).alias("folds")), "to", "left")
    plain = first_by(r.where("folds is null"), ["own"], F.desc("place")).select(F.col("own").alias("key"), "r_name", "r_spec", "r_code")
    folded = r.where("folds").groupBy(F.col("to").alias("key")).agg(F.array_sort(F.collect_set("r_name")).alias("more"), F.min_by("r_code", F.when(F.col("r_code").isNotNull(), F.col("place"))).alias("a_code"))
    plain = plain.join(have, "key", "left").withColumn("target", F.coalesce("target", F.xxhash64("key")))
    folded = folded.join(have, "key").select("target", "more", "a_code")
    out = services.join(plain.drop("key").withColumnRenamed("target", "id"), "id", "full").join(folded.withColumnRenamed("target", "id"), "id", "left")
    fresh = F.col("canonical_name").isNull()
    category = T.col_category_for("r_spec", "r_name")
    code = F.coalesce("r_code", "tarificator_code", "a_code")
    spec = F.coalesce(F.nullif("r_spec", F.lit("")), "specialty", F.lit(""))
    cat = F.when(F.col("r_name").isNotNull() & F.coalesce(F.col("category").isin("", R.OTHER), F.lit(True)), category).otherwise(F.col("category"))
    syn = F.array_union(F.coalesce("synonyms", F.array().cast("array<string>")), F.coalesce("more", F.array().cast("array<string>")))
    changed = ~code.eqNullSafe(F.col("tarificator_code")) | ~spec.eqNullSafe(F.col("specialty")) | ~cat.eqNullSafe(F.col("category"))
    change = F.when(fresh, "created").when(F.col("more").isNotNull(), "alias").when(F.col("r_name").isNotNull() & changed, "updated").otherwise("kept")
    return out.select("id", F.coalesce("canonical_name", "r_name").alias("canonical_name"), cat.alias("category"), syn.alias("synonyms"), code.alias("tarificator_code"), spec.alias("specialty"), change.alias("change"))


def collected_records(prices: DataFrame, clinics: DataFrame, services: DataFrame, as_of: str, days: int = 30, *, limit: int = 100, offset: int = 0, active_only: bool = False, city: str | None = None, service_id=None) -> DataFrame:
    """Flat records, newest id first, of a city and a service where asked. The page is cut first; active_only then drops rows of it."""
    c = clinics.select(F.col("id").alias("clinic_id"), F.col("name").alias("clinic_name"), "city", "address", "website")
    if city:
        c = c.where(F.col("city") == city)
    s = services.select(F.col("id").alias("service_id"), "canonical_name", "category", "specialty")
    if service_id is not None:
        prices = prices.where(F.col("service_id") == service_id)
    page = prices.join(c, "clinic_id").join(s, "service_id").orderBy(F.desc("id"), "price").offset(offset).limit(limit)
    out = with_fresh(page, as_of, days)
    out = out.where("is_fresh") if active_only else out
    return out.select("id", "clinic_name", "city", "address", F.col("canonical_name").alias("service_name_norm"), "raw_name", T.col_category_enum("category", "specialty", "canonical_name").alias("category"), "price", T.col_currency("currency").alias("currency"), "source_type", "match_confidence", "valid_from", "duration_days", F.col("is_fresh").alias("is_active"), F.coalesce(F.nullif("source_url", F.lit("")), "website", F.lit("")).alias("source_url"))


def export_catalog(prices: DataFrame, services: DataFrame, clinics: DataFrame) -> DataFrame:
    """The catalog file's rows, by category, name and price; write with .write.csv."""
    s = services.select(F.col("id").alias("service_id"), "canonical_name", "category", "tarificator_code")
    c = clinics.select(F.col("id").alias("clinic_id"), F.col("name").alias("clinic_name"), "city")
    label = F.create_map(*[F.lit(x) for kv in {"upload": "Загрузка", "api": "API", "web_scrape": "Сайт"}.items() for x in kv])
    out = prices.join(s, "service_id").join(c, "clinic_id")
    return out.select("category", "canonical_name", F.coalesce("tarificator_code", F.lit("")).alias("code"), "clinic_name", "city", "price", "price_resident", "price_nonresident", "currency", F.coalesce(F.try_element_at(label, F.col("source_type")), F.col("source_type")).alias("source"), F.bround(F.col("match_confidence") * 100).cast("int").alias("confidence_pct"), "raw_name", "valid_from").orderBy("category", "canonical_name", "price")


def to_kzt(df: DataFrame, rate: float = R.USD_RATE, price: str = "price", currency: str = "currency") -> DataFrame:
    """prices in tenge, the original price and currency kept where converted."""
    usd = T.col_currency(currency) == "USD"
    return df.withColumn("price_original", F.when(usd, F.col(price))).withColumn("currency_original", F.when(usd, "USD").otherwise("")).withColumn(price, F.when(usd, F.bround(F.col(price).cast("double") * rate, 2)).otherwise(F.col(price).cast("double"))).withColumn(currency, F.lit("KZT"))


def remap_ids(tables: dict[str, DataFrame], keys: dict[str, dict[str, str]]) -> dict[str, DataFrame]:
    """Ids become deterministic strings in every table. keys: table -> {column: table that the column refers to}."""
    new = lambda kind, c: F.when(F.col(c).isNotNull(), F.md5(F.concat_ws("|", F.lit(kind), F.col(c).cast("string"))))
    return {t: df.withColumns({c: new(kind, c) for c, kind in keys.get(t, {}).items()}) for t, df in tables.items()}


def remap_counts(old: dict[str, DataFrame], new: dict[str, DataFrame], keys: dict[str, dict[str, str]]) -> DataFrame:
    """Per table, rows before and after the change of ids, and how many references became null (none should)."""
    one = lambda t, df, side: df.select(F.lit(t).alias("table"), F.lit(side).alias("side"), reduce(lambda a, b: a + b, [F.col(c).isNull().cast("long") for c in keys.get(t, {})], F.lit(0).cast("long")).alias("nulls"))
    rows = reduce(lambda a, b: a.unionByName(b), [one(t, df, s) for s, side in (("old", old), ("new", new)) for t, df in side.items()])
    of = lambda s, x: F.coalesce(F.sum(F.when(F.col("side") == s, x)), F.lit(0))
    return rows.groupBy("table").agg(of("old", F.lit(1).cast("long")).alias("rows"), of("new", F.lit(1).cast("long")).alias("copied"), (of("new", F.col("nulls")) - of("old", F.col("nulls"))).alias("lost"))
