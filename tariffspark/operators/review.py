"""Review queues, decisions, history, subscriptions, merges: changes of rows as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..data import written
from ..functions import rules as R
from ..functions import text as T
from .compare import with_fresh
from .dedup import first_by


def new_id(*cols):
    """A deterministic id for a new row: a hash of what names it."""
    return F.xxhash64(*cols)


def review_queue(prices: DataFrame, clinics: DataFrame, services: DataFrame, *, limit: int = 200, anomalies: bool = False, run_id=None) -> DataFrame:
    """Rows to check, lowest confidence first, with the total before the limit."""
    p = prices.where("is_anomaly") if anomalies else prices.where(F.col("match_confidence") < R.MATCH)
    if run_id is not None:
        p = p.where(F.col("run_id") == run_id)
    c = clinics.select(F.col("id").alias("clinic_id"), F.col("name").alias("clinic_name"))
    s = services.select(F.col("id").alias("service_id"), "canonical_name")
    rows = p.join(c, "clinic_id")
    total = rows.agg(F.count("*").alias("total"))
    top = rows.orderBy("match_confidence", "id", "price").limit(limit).join(s, "service_id", "left")
    return top.crossJoin(total)  # one row of one number


def review_page(prices: DataFrame, clinics: DataFrame, services: DataFrame, reports: DataFrame, *, limit: int = 200, **which) -> DataFrame:
    """R01 with what users report: kind ("price", "report"), place within it, id and a struct of either. Rows to check come
    lowest confidence first, new reports newest first, at most `limit` of each."""
    low = review_queue(prices, clinics, services, limit=limit, **which)
    new = by_status(reports, "new", limit)
    at = lambda *order: F.row_number().over(Window.orderBy(*order))  # noqa: E731  over `limit` rows
    one = low.select(F.lit("price").alias("kind"), at("match_confidence", "id", "price").alias("place"), "id", F.struct(*low.columns).alias("price"))
    two = new.select(F.lit("report").alias("kind"), at(F.desc("created_at"), F.desc("id")).alias("place"), "id", F.struct(*new.columns).alias("report"))
    return one.unionByName(two, allowMissingColumns=True)


def unmatched(prices: DataFrame, clinics: DataFrame, limit: int = 200) -> DataFrame:
    """Rows without a service, lowest confidence first."""
    c = clinics.select(F.col("id").alias("clinic_id"), F.col("name").alias("clinic_name"))
    return prices.where("service_id is null").join(c, "clinic_id").orderBy("match_confidence", "id", "price").limit(limit)


def apply_decisions(prices: DataFrame, services: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(prices, new services). decisions: id, action, target_id. Unknown actions and targets change nothing."""
    known = services.select(F.col("id").alias("target_id"), F.lit(True).alias("exists"))
    d = decisions.join(known, "target_id", "left").withColumn("exists", F.coalesce("exists", F.lit(False)))
    rows = prices.join(d, "id", "left")
    raw_name = F.coalesce(F.nullif(F.substring(F.trim("raw_name"), 1, 255), F.lit("")), F.lit("Без названия"))
    rows = rows.withColumn("_name", F.when(F.col("action") == "new", raw_name))
    named = services.groupBy(F.col("canonical_name").alias("_name")).agg(F.min("id").alias("found_id"))
    rows = rows.join(named, "_name", "left")
    created = rows.where("_name is not null and found_id is null").select("_name").distinct().select(new_id("_name").alias("id"), F.col("_name").alias("canonical_name"), F.lit(R.OTHER).alias("category"))
    act = F.coalesce("action", F.lit(""))
    sure = (act == "confirm") | (act == "new") | ((act == "reassign") & F.col("exists"))
    service = F.when((act == "reassign") & F.col("exists"), F.col("target_id")).when(act == "new", F.coalesce("found_id", new_id("_name"))).otherwise(F.col("service_id"))
    out = rows.where(act != "reject").withColumn("service_id", service).withColumn("match_confidence", F.when(sure, 1.0).otherwise(F.col("match_confidence")))
    return out.select(prices.columns), created


def gate_decisions(prices: DataFrame, decisions: DataFrame, *, auto=("confirm", "junk"), least: float = 0.8, limit: int = 50) -> DataFrame:
    """Of the `limit` least sure rows, the decisions that may be applied at once; junk is a rejection."""
    queue = prices.where((F.col("match_confidence") < R.MATCH) & F.col("service_id").isNotNull()).orderBy("match_confidence", "id", "price").limit(limit).select("id").distinct()
    d = decisions.join(queue, "id", "left_semi")
    ok = F.col("action").isin(*auto) & (F.col("confidence") >= least) & ((F.col("action") != "reassign") | F.coalesce("verified", F.lit(False)))
    return d.withColumn("applied", F.coalesce(ok, F.lit(False))).withColumn("action", F.when(F.col("action") == "junk", "reject").otherwise(F.col("action")))


def gate_counts(gated: DataFrame) -> DataFrame:
    """How many decisions were applied and how many remain."""
    return gated.agg(F.count_if("applied").alias("applied"), F.count_if(~F.col("applied")).alias("remaining"))


def manual_match(prices: DataFrame, services: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(prices, services) after pairs (id, target_id); each raw name is learned once."""
    s = services.select(F.col("id").alias("target_id"), "tarificator_code")
    hit = prices.join(pairs.join(s, "target_id"), "id", "left")
    done = hit.withColumn("service_id", F.coalesce("target_id", "service_id")).withColumn("match_confidence", F.when(F.col("target_id").isNotNull(), 1.0).otherwise(F.col("match_confidence")))
    names = hit.where("target_id is not null").groupBy(F.col("target_id").alias("id")).agg(F.array_sort(F.collect_set("raw_name")).alias("learned"))
    return done.select(*prices.columns), services.join(names, "id", "left").withColumn("synonyms", F.array_union("synonyms", F.coalesce("learned", F.array().cast("array<string>")))).drop("learned")


def run_detail(prices: DataFrame, services: DataFrame) -> DataFrame:
    """Positions of runs with their status."""
    s = services.select(F.col("id").alias("service_id"), "canonical_name")
    status = F.when(F.col("service_id").isNull(), "unmatched").when(F.col("match_confidence") >= R.MATCH, "matched").otherwise("review")
    return prices.join(s, "service_id", "left").withColumn("status", status).groupBy("run_id").agg(F.count("*").alias("positions"), *[F.count_if(F.col("status") == x).alias(x) for x in ("matched", "review", "unmatched")])


def run_positions(prices: DataFrame, services: DataFrame) -> DataFrame:
    """The positions of runs, raw name beside normalized name, with their status."""
    s = services.select(F.col("id").alias("service_id"), "canonical_name")
    status = F.when(F.col("service_id").isNull(), "unmatched").when(F.col("match_confidence") >= R.MATCH, "matched").otherwise("review")
    return prices.join(s, "service_id", "left").withColumn("status", status).select("run_id", "id", "raw_name", "canonical_name", "service_id", F.round("match_confidence", 2).alias("match_confidence"), "price_resident", "price_nonresident", "status")


def rollback(prices: DataFrame, runs: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(prices without those runs' rows, runs marked)."""
    gone = ids.select("run_id").distinct()
    marked = runs.join(gone.withColumn("_gone", F.lit(True)).withColumnRenamed("run_id", "id"), "id", "left")
    return prices.join(gone, "run_id", "left_anti"), marked.withColumn("status", F.when(F.col("_gone"), "rolled_back").otherwise(F.col("status"))).drop("_gone")


def append_history(history: DataFrame, updates: DataFrame) -> DataFrame:
    """The updates that change a price: first against the last recorded one, then against each other."""
    keys = ["clinic_id", "service_id"]
    last = history.groupBy(*keys).agg(F.max_by("price", F.struct("recorded_at", "id", "price")).alias("last_price"))
    w = Window.partitionBy(*keys).orderBy("recorded_at", "id", "price")
    before = F.lag("price").over(w)
    out = updates.join(last, keys, "left").withColumn("before", F.coalesce(before, F.col("last_price")))
    return out.where("before is null or before != price").drop("before", "last_price")


def current_min(subs: DataFrame, prices: DataFrame, clinics: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """Least fresh price of each subscription, at its clinic, else in its city, else anywhere. Minima are taken once
    for each grain and joined."""
    p = with_fresh(prices.where("service_id is not null"), as_of, days).where("is_fresh").join(clinics.select(F.col("id").alias("clinic_id"), "city"), "clinic_id")
    fine = p.groupBy("service_id", "clinic_id", "city").agg(F.min("price").alias("p"))
    s = subs.withColumn("_city", F.when(F.col("clinic_id").isNull(), F.nullif("city", F.lit(""))))
    a = fine.groupBy("service_id", "clinic_id").agg(F.min("p").alias("at_clinic"))
    b = fine.groupBy("service_id", F.col("city").alias("_city")).agg(F.min("p").alias("in_city"))
    c = fine.groupBy("service_id").agg(F.min("p").alias("anywhere"))
    out = s.join(a, ["service_id", "clinic_id"], "left").join(b, ["service_id", "_city"], "left").join(c, "service_id", "left")
    best = F.when(F.col("clinic_id").isNotNull(), F.col("at_clinic")).when(F.col("_city").isNotNull(), F.col("in_city")).otherwise(F.col("anywhere"))
    return out.withColumn("current_price", best).drop("_city", "at_clinic", "in_city", "anywhere")


def check_subscriptions(subs: DataFrame, prices: DataFrame, clinics: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """What happens to each active subscription (baseline, alert, raised, same, no price) and its new baseline."""
    s = current_min(subs.where("active"), prices, clinics, as_of, days)
    d = F.col("current_price").cast("double") - F.col("last_price").cast("double")
    event = F.when(F.col("current_price").isNull(), "no_price").when(F.col("last_price").isNull(), "baseline").when(d < -0.001, "alert").when(d > 0.001, "raised").otherwise("same")
    return s.withColumn("event", event).withColumn("new_last_price", F.when(event.isin("baseline", "alert", "raised"), F.col("current_price")).otherwise(F.col("last_price")))


def subscribe(subs: DataFrame, requests: DataFrame, services: DataFrame, prices: DataFrame, clinics: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """The rows to add: valid phone, known service, one active row a phone, service and clinic."""
    r = requests.withColumn("phone", T.col_phone("phone")).where(T.col_phone_ok("phone")).join(services.select(F.col("id").alias("service_id")), "service_id", "left_semi")
    r = first_by(r.withColumn("city", F.when(F.col("clinic_id").isNull(), F.coalesce("city", F.lit(""))).otherwise("")), ["phone", "service_id", "clinic_id"], "city")
    have = subs.where("active").select(F.col("phone").alias("_p"), F.col("service_id").alias("_s"), F.col("clinic_id").alias("_c"))
    fresh = r.join(have, (F.col("phone") == F.col("_p")) & (F.col("service_id") == F.col("_s")) & F.col("clinic_id").eqNullSafe(F.col("_c")), "left_anti")
    return current_min(fresh, prices, clinics, as_of, days).withColumnRenamed("current_price", "last_price")


def apply_edits(prices: DataFrame, edits: DataFrame, as_of: str) -> DataFrame:
    """Positive edits (id, clinic_id, new_price) by the clinic itself become confirmed uploads."""
    e = edits.where("new_price > 0")
    out = prices.join(e, ["id", "clinic_id"], "left")
    hit = F.col("new_price").isNotNull()
    return out.withColumn("price", F.when(hit, F.col("new_price")).otherwise(F.col("price"))).withColumn("source_type", F.when(hit, "upload").otherwise(F.col("source_type"))).withColumn("match_confidence", F.when(hit, 1.0).otherwise(F.col("match_confidence"))).withColumn("valid_from", F.when(hit, F.lit(as_of).cast("date")).otherwise(F.col("valid_from"))).withColumn("edited", hit).drop("new_price")


def edit_history(edited: DataFrame, as_of: str) -> DataFrame:
    """What the edits add to the price history."""
    return edited.where("edited and service_id is not null").select("clinic_id", "service_id", "price", F.lit(as_of).cast("date").alias("recorded_at"))


def confirm_all(prices: DataFrame, clinics: DataFrame, as_of: str) -> DataFrame:
    """All prices of these clinics (clinic_id) become uploads of today, confirmed."""
    hit = F.coalesce("_hit", F.lit(False))
    out = prices.join(clinics.select("clinic_id", F.lit(True).alias("_hit")).distinct(), "clinic_id", "left")
    new = {"source_type": F.lit("upload"), "match_confidence": F.lit(1.0), "valid_from": F.lit(as_of).cast("date")}
    return out.select(*[F.when(hit, new[c]).otherwise(F.col(c)).alias(c) if c in new else c for c in prices.columns], hit.alias("confirmed"))


def _urine(c: str = "raw_name"):
    return F.coalesce(T.col_specimen(c) == "urine", F.lit(False))


def close_plan(plan: DataFrame) -> DataFrame:
    """A merge plan (from_id, to_id, urine_id) with each duplicate sent to the end of its chain (a -> b, b -> c sends a
    to c), by pointer jumping: each round doubles how far a link reaches, so a chain of n links takes log2(n) rounds. Rows
    in a cycle, or that lead into one, have no end and are left out: nothing of theirs is merged. Of several rows for one
    duplicate the smallest target counts. A duplicate without a urine service takes that of the next one on its chain."""
    links = written(first_by(plan.where("from_id is not null and to_id is not null"), ["from_id"], "to_id", "urine_id").select("from_id", "to_id", "urine_id"), "plan")
    for _ in range(max(1, links.count()).bit_length() + 1):
        nxt = links.select(F.col("from_id").alias("_f"), F.col("to_id").alias("_t"), F.col("urine_id").alias("_u"))
        joined = links.join(nxt.hint("merge"), F.col("to_id") == F.col("_f"), "left")
        open_ends = joined.where("_f is not null").limit(1).count()
        if not open_ends:
            break
        links = written(joined.select("from_id", F.coalesce("_t", "to_id").alias("to_id"), F.coalesce("urine_id", "_u").alias("urine_id")), "plan")
    froms = links.select(F.col("from_id").alias("to_id"))
    good = links.join(froms.hint("merge"), "to_id", "left_anti")
    ends = good.select(F.col("from_id").alias("urine_id"), F.col("to_id").alias("_end"))  # a urine service may be a duplicate itself
    # A plan grows with the catalog: no join may send it through the driver, however small its files look.
    return good.join(ends.hint("merge"), "urine_id", "left").select("from_id", "to_id", F.coalesce("_end", "urine_id").alias("urine_id")).hint("merge")


def merge_canons(prices: DataFrame, plan: DataFrame, absurd: float = 50_000) -> DataFrame:
    """Prices of duplicate services move to the one kept (plan: from_id, to_id, urine_id); rows about urine move to
    the urine service, and of these absurd prices go."""
    plan = close_plan(plan)
    out = prices.join(plan.withColumnRenamed("from_id", "service_id"), "service_id", "left")
    to = F.when(F.col("to_id").isNull(), F.col("service_id")).when(_urine(), F.coalesce("urine_id", "to_id")).otherwise(F.col("to_id"))
    bad = F.col("to_id").isNotNull() & _urine() & (F.col("price") >= absurd)
    return out.withColumn("moved", F.col("to_id").isNotNull()).withColumn("new_service_id", to).where(~bad).withColumn("service_id", F.col("new_service_id")).drop("to_id", "urine_id", "new_service_id")


def merge_followers(rows: DataFrame, plan: DataFrame, absurd: float | None = None) -> DataFrame:
    """History (absurd prices of duplicates go) or subscriptions of duplicate services move to the one kept."""
    plan = close_plan(plan)
    out = rows.join(plan.select(F.col("from_id").alias("service_id"), F.col("to_id").alias("_to")), "service_id", "left")
    if absurd is not None:
        out = out.where(F.col("_to").isNull() | (F.col("price") < absurd))
    return out.select(*[F.coalesce("_to", "service_id").alias(c) if c == "service_id" else c for c in rows.columns])


def merge_services(services: DataFrame, plan: DataFrame, prices: DataFrame, longest: int = 40) -> DataFrame:
    """The services left when duplicates are gone; those kept learn the duplicates' names and the raw names of their
    prices, but for urine and long ones, each once whatever its case."""
    plan = close_plan(plan)
    names = services.join(plan.select(F.col("from_id").alias("id"), "to_id"), "id").select("to_id", F.col("canonical_name").alias("name"))
    raws = prices.join(plan.select(F.col("from_id").alias("service_id"), "to_id"), "service_id").where(~_urine() & (F.length("raw_name") <= longest)).select("to_id", F.col("raw_name").alias("name"))
    have = services.select(F.col("id").alias("to_id"), F.explode(F.concat(F.array("canonical_name"), F.coalesce("synonyms", F.array().cast("array<string>")))).alias("h")).select("to_id", F.lower("h").alias("low"))
    new = first_by(names.unionByName(raws).withColumn("low", F.lower("name")), ["to_id", "low"], "name").join(have.hint("merge"), ["to_id", "low"], "left_anti")
    new = new.groupBy(F.col("to_id").alias("id")).agg(F.array_sort(F.collect_list("name")).alias("_new"))
    left = services.join(plan.select(F.col("from_id").alias("id")), "id", "left_anti").join(new.hint("merge"), "id", "left")
    none = F.array().cast("array<string>")
    return left.select(*[F.concat(F.coalesce("synonyms", none), F.coalesce("_new", none)).alias(c) if c == "synonyms" else c for c in services.columns])


def prune_orphans(services: DataFrame, prices: DataFrame, *followers: DataFrame) -> tuple[DataFrame, ...]:
    """Services without prices; and each follower table (history, subscriptions) without their rows."""
    gone = services.join(prices.select(F.col("service_id").alias("id")), "id", "left_anti")
    ids = gone.select(F.col("id").alias("service_id"))
    return gone, *[f.join(ids, "service_id", "left_anti").select(f.columns) for f in followers]


def by_status(df: DataFrame, status: str | None = None, limit: int = 100) -> DataFrame:
    """Rows of a status, newest first."""
    return (df.where(F.col("status") == status) if status else df).orderBy(F.desc("created_at"), F.desc("id")).limit(limit)


def set_status(df: DataFrame, changes: DataFrame) -> DataFrame:
    """Rows with the status that changes (id, new_status) give them."""
    return df.join(changes, "id", "left").select(*[F.coalesce("new_status", "status").alias(c) if c == "status" else c for c in df.columns])


def named_subscriptions(subs: DataFrame, services: DataFrame, clinics: DataFrame) -> DataFrame:
    """Subscriptions with the names of their service and clinic."""
    s = services.select(F.col("id").alias("service_id"), F.col("canonical_name").alias("service_name"))
    c = clinics.select(F.col("id").alias("clinic_id"), F.col("name").alias("clinic_name"))
    return subs.join(s, "service_id", "left").join(c, "clinic_id", "left")


def worklist_services(services: DataFrame, prices: DataFrame, clinics: DataFrame, text_col: str) -> DataFrame:
    """Services whose text is empty, those with public offers first, then by name."""
    open_ = prices.join(clinics.where("is_public").select(F.col("id").alias("clinic_id")), "clinic_id", "left_semi").select(F.col("service_id").alias("id")).distinct().withColumn("offered", F.lit(True))
    todo = services.where(F.coalesce(F.trim(text_col), F.lit("")) == "")
    return todo.join(open_, "id", "left").withColumn("offered", F.coalesce("offered", F.lit(False))).orderBy(F.desc("offered"), "canonical_name", "id")


def worklist_clinics(clinics: DataFrame) -> DataFrame:
    """Clinics with an address to geocode and no coordinates."""
    return clinics.where(F.col("lat").isNull() & T.col_is_geocodable("address")).withColumn("query", T.col_geo_query("address", "city")).orderBy("id")


def apply_texts(services: DataFrame, texts: DataFrame, text_col: str) -> DataFrame:
    """Generated texts (id, value) where the field is empty."""
    return services.join(texts, "id", "left").withColumn(text_col, F.coalesce(F.nullif(F.trim(text_col), F.lit("")), "value", text_col)).drop("value")


def flag_anonymous(clinics: DataFrame, pattern: str = r"^Клиника \d+$") -> DataFrame:
    """Clinics named by number alone are not public."""
    return clinics.withColumn("is_public", F.when(F.col("name").rlike(pattern), False).otherwise(F.col("is_public")))


def purge_raw(runs: DataFrame, as_of: str, days: int = 90, most: int = 200_000) -> DataFrame:
    """Raw content cut to its limit, and blanked in runs older than the retention."""
    old = F.col("created_at") < F.date_sub(F.lit(as_of).cast("date"), days)
    return runs.withColumn("raw_content", F.when(old, "").otherwise(F.substring("raw_content", 1, most)))


def reprocess(runs: DataFrame, originals: DataFrame, services: DataFrame, prices: DataFrame) -> DataFrame:
    """Stored originals once more, as new runs of the same clinic, file and date. runs: run_id, clinic_id, valid_from;
    originals: run_id, sheet, row_idx, cells. They are extracted, matched with the current catalog (by code, else by
    name), deduplicated and upserted into prices."""
    from ..sources.files import items_from_grid
    from .dedup import archive_add, archive_dedup, archive_overwrite, archive_valid
    from .match import match_by_code, normalize

    items = items_from_grid(originals.withColumnRenamed("run_id", "doc_id")).withColumnRenamed("doc_id", "run_id").withColumnRenamed("name", "raw_name")
    items = written(items.join(runs.select("run_id", "clinic_id", "valid_from"), "run_id"), "extracted")
    # Each distinct name with its code is matched once, each distinct name without a service of its code once.
    pairs = written(items.select("raw_name", "code").distinct().withColumn("item_id", F.monotonically_increasing_id()), "pairs")
    coded = written(match_by_code(pairs, services), "coded")
    rest = pairs.join(coded.select("item_id"), "item_id", "left_anti")
    once = written(rest.groupBy("raw_name").agg(F.min("item_id").alias("item_id")).select("item_id", "raw_name"), "unnamed")
    by_name, _, _ = normalize(once, services)
    by_name = written(by_name.select("raw_name", "service_id", "confidence"), "named")
    named = rest.select("item_id", "raw_name").join(by_name, "raw_name").drop("raw_name")
    found = written(pairs.join(coded.unionByName(named), "item_id").drop("item_id"), "found").withColumnsRenamed({"raw_name": "f_name", "code": "f_code"})
    money = prices.schema["price"].dataType

    primary = F.coalesce("price_resident", "price_nonresident")
    lines = archive_valid(items).drop("primary_price")
    of = lambda found: lines.join(found, (F.col("raw_name") == F.col("f_name")) & F.col("code").eqNullSafe(F.col("f_code")))
    named_id = lambda rows: rows.withColumns({"id": F.xxhash64("run_id", "sheet", "row_idx"), "primary_price": primary})
    to_batch = lambda rows: rows.select("id", F.xxhash64("run_id", F.lit("again")).alias("run_id"), "clinic_id", "service_id", "raw_name", F.col("primary_price").cast(money).alias("price"), F.col("price_resident").cast(money).alias("price_resident"), F.col("price_nonresident").cast(money).alias("price_nonresident"), "valid_from")

    # Of a clinic's rows of a service only the cheapest can stay, and no run's cheapest is lost with the others. They are
    # cut before they are dealt; the cheapest of each run (A03) is then found where they lie.
    keys = ["clinic_id", "service_id"]
    cheap = F.rank().over(Window.partitionBy(*keys).orderBy(primary.cast(money)))
    known = of(found.where("service_id is not null")).withColumn("_r", cheap).where("_r = 1").drop("_r")
    known = first_by(named_id(known), [*keys, "run_id"], "primary_price", "id")
    loose = found.where("service_id is null").withColumn("service_id", F.lit(None).cast(found.schema["service_id"].dataType))
    loose = archive_dedup(named_id(of(loose)))
    return archive_overwrite(prices, to_batch(known)).unionByName(archive_add(to_batch(loose)))
