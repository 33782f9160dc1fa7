"""Scalar functions over columns (names, prices, codes, categories, variants, places). All stay in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules as R

U = "(?U)"  # \w, \b and \s over all of Unicode
UI = "(?iU)"
LETTER = "[A-Za-zА-Яа-яЁё]"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def spaced(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, U + r"\s+", " "))


def col_clean(c) -> Column:
    """Lower case without brackets and punctuation, single spaces."""
    return spaced(F.regexp_replace(F.regexp_replace(F.lower(_c(c)), r"\([^)]*\)", " "), U + r"[^\w\s]", " "))


def has_any(c: Column, words) -> Column:
    return reduce(lambda a, b: a | b, [c.contains(w) for w in words])


def first_rule(c: Column, rules, default) -> Column:
    out = reduce(lambda acc, r: acc.when(has_any(c, r[0]), r[1]), rules[1:], F.when(has_any(c, rules[0][0]), rules[0][1]))
    return out.otherwise(default)


def bound(c: Column, f) -> Column:
    """f of a value that is worked out once, however often f looks at it (else each look repeats it in the plan)."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def _positive(token: Column, most: float | None = None) -> Column:
    some = F.filter(F.array(token), lambda t: t != "")  # a cast that fails costs more than all the rest
    return F.get(F.filter(F.transform(some, lambda t: t.try_cast("double")), lambda v: (v > 0) & (v <= most if most else F.lit(True))), F.lit(0))


def _first_digits(c) -> Column:
    """The first run of digits and separators, without spaces."""
    return F.regexp_replace(F.regexp_extract(_c(c).cast("string"), "[0-9][0-9\\s .,]*", 0), "[\\s ]", "")


def col_parse_price(c) -> Column:
    """Retail files: the first run of digits; with both separators the dot marks thousands; a lone comma is decimal
    before one or two last digits."""
    def number(t):
        both = t.contains(",") & t.contains(".")
        return F.when(both, F.replace(F.replace(t, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).when(t.rlike(r",\d{1,2}$"), F.replace(t, F.lit(","), F.lit("."))).otherwise(F.replace(t, F.lit(","), F.lit("")))

    return _positive(bound(_first_digits(c), number))


def col_parse_price_archive(c) -> Column:
    """Archive files: of both separators the last is decimal; repeated ones and those before three digits mark thousands."""
    drop = lambda s, x: F.replace(s, F.lit(x), F.lit(""))

    def number(t):
        dot, comma = t.contains("."), t.contains(",")
        last_dot = F.locate(".", F.reverse(t)) < F.locate(",", F.reverse(t))
        many = lambda x: F.length(t) - F.length(drop(t, x)) > 1
        return (
            F.when(dot & comma & last_dot, drop(t, ","))
            .when(dot & comma, F.replace(drop(t, "."), F.lit(","), F.lit(".")))
            .when(many("."), drop(t, "."))
            .when(many(","), drop(t, ","))
            .when(t.rlike(r"[.,]\d{3}$"), drop(drop(t, "."), ","))
            .otherwise(F.replace(t, F.lit(","), F.lit(".")))
        )

    return _positive(bound(_first_digits(c), number), 100_000_000)


def col_norm_code(c) -> Column:
    """Tariff code like B02.110.002, look-alike letters made Latin; null where none stands."""
    t = F.translate(F.upper(_c(c).cast("string")), *R.LOOKALIKE)
    return F.nullif(F.regexp_extract(t, r"[A-ZА-Я]\d{2}\.\d{3}\.\d{3}", 0), F.lit(""))


def col_is_noise(c) -> Column:
    n = F.trim(F.coalesce(_c(c), F.lit("")))
    return (F.length(n) < 4) | n.rlike(UI + R.NOISE_NAME) | ~n.rlike(f"(?s)(?:{LETTER}.*?){{4}}")


def col_classify_line(c) -> Column:
    """struct(kind, reason): seven ordered rules say that a line is no service."""
    s = F.trim(F.coalesce(_c(c), F.lit("")))
    hint, letters = s.rlike(UI + R.SERVICE_HINT), F.regexp_replace(s, "[^A-Za-zА-Яа-яЁё]", "")
    left = F.substring_index(s, ":", 1)
    key = F.concat(F.lit("метаданные бланка ("), F.substring(F.trim(left), 1, 30), F.lit(")"))
    reason = (
        F.when(F.length(s) < 2, "пусто/слишком коротко")
        .when(s.rlike(UI + R.DIRECTIVE), "заголовок направления")
        .when(s.rlike(UI + R.HEADER_WORD) & ~hint, "заголовок")
        .when(s.rlike(U + R.DATE) & ~hint, "дата")
        .when(s.contains(":") & left.rlike(UI + R.NOISE_KEY), key)
        .when(s.rlike(UI + R.INSTRUCTION) & ~hint, "инструкция")
        .when((F.length(letters) >= 8) & (letters == F.upper(letters)) & ~hint, "заголовок")
    )
    return F.struct(F.when(reason.isNull(), "service").otherwise("noise").alias("kind"), F.coalesce(reason, F.lit("")).alias("reason"))


def col_currency(c) -> Column:
    known = F.create_map(*[F.lit(x) for kv in R.CURRENCIES.items() for x in kv])
    return F.coalesce(F.try_element_at(known, F.trim(F.upper(F.coalesce(_c(c), F.lit(""))))), F.lit("KZT"))


def col_category_enum(category, specialty, name) -> Column:
    blob = F.lower(F.concat_ws(" ", *[F.nullif(_c(x), F.lit("")) for x in (category, specialty, name)]))
    named = [((x,), x) for x in R.CATEGORY_ENUM]
    return F.when(F.trim(blob) == "", R.CATEGORY_ENUM[0]).otherwise(first_rule(blob, [*R.CATEGORY_RULES, *named], R.CATEGORY_ENUM[0]))


def col_category_for(specialty, name) -> Column:
    return first_rule(F.lower(F.concat(F.coalesce(_c(specialty), F.lit("")), F.lit(" "), F.coalesce(_c(name), F.lit("")))), R.SPECIALTY_RULES, R.OTHER)


def col_visit_modifier(c) -> Column:
    t = F.coalesce(_c(c), F.lit(""))
    return reduce(lambda acc, r: acc.when(t.rlike(UI + r[1]), r[0]), R.VISIT[1:], F.when(t.rlike(UI + R.VISIT[0][1]), R.VISIT[0][0]))


def col_derive_visit_name(canonical, modifier) -> Column:
    spec = F.regexp_replace(F.trim(_c(canonical)), UI + r"^при[её]м\s+", "")
    spec = F.trim(F.regexp_replace(spec, UI + r"^консультация\s+", ""))
    m = _c(modifier)
    return F.when(m == "repeat", F.concat(F.lit("Повторный приём "), spec)).when(m == "online", F.concat(F.lit("Онлайн-консультация "), spec)).when(m == "pediatric", F.concat(F.lit("Приём детского "), spec)).otherwise(_c(canonical))


def col_analyte_variant(raw, canonical) -> Column:
    low, cl = F.lower(_c(raw)), F.lower(_c(canonical))
    base = F.trim(F.regexp_replace(_c(canonical), r"\s*\([^)]*\)\s*$", ""))
    base = F.trim(F.regexp_replace(base, UI + r"\s+в\s+крови$", ""))
    return F.when(cl.contains("глюкоз") & low.rlike("толерант|глюкозотолер|нагрузочн|с нагрузкой"), "Глюкозотолерантный тест").when(low.contains("моч") & ~cl.contains("моч"), F.concat(base, F.lit(" в моче")))


def col_prefer_blood(raw, canonical) -> Column:
    low, cl = F.lower(F.coalesce(_c(raw), F.lit(""))), F.lower(F.coalesce(_c(canonical), F.lit("")))
    base = F.regexp_replace(F.regexp_replace(_c(canonical), UI + r"\s*в\s*моче\b", ""), r"\s{2,}", " ")
    return F.when(~low.rlike("моч|urine") & cl.contains("моч"), F.nullif(F.btrim(base, F.lit(" ,;")), F.lit("")))


def col_specimen(c) -> Column:
    t = F.lower(F.coalesce(_c(c), F.lit("")))
    return F.when(t.rlike(UI + R.STOOL), "stool").when(t.rlike(UI + R.SPUTUM), "sputum").when(t.rlike(UI + R.URINE), "urine")


def urine_base(canonical) -> Column:
    """What is left of a urine service's name without the urine words."""
    return spaced(F.regexp_replace(F.lower(_c(canonical)), UI + R.URINE, " "))


def col_base_key(c) -> Column:
    k = F.trim(F.lower(F.coalesce(_c(c), F.lit(""))))
    for pattern, to in ((r"^повторный при[её]м\s+", "приём "), (r"^онлайн-консультация\s+", "приём "), (r"^при[её]м детского\s+", "приём "), (r"\s+в моче$", ""), (r"\s*\(в\s+крови\)\s*$", ""), ("глюкозотолерантный тест", "глюкоза")):
        k = F.regexp_replace(k, U + pattern, to)
    return spaced(k)


def col_attributes(c) -> Column:
    low = F.lower(F.trim(F.coalesce(_c(c), F.lit(""))))
    visit = F.when(low.rlike("^повторный при[её]м"), "repeat").when(low.startswith("онлайн-консультация"), "online").when(low.rlike("^при[её]м детского"), "pediatric").when(low.rlike(U + r"^при[её]м\b"), "primary")
    fluid = F.when(low.endswith(" в моче") | low.rlike(U + r"\bв моче$"), "urine").when(low.contains("(в крови)"), "blood")
    kind = F.when(low.contains("толерантн"), "tolerance")
    label = lambda x, names: F.create_map(*[F.lit(v) for kv in names.items() for v in kv])[x]
    tags = F.array(label(visit, {"repeat": "повторный", "online": "онлайн", "pediatric": "детский", "primary": "первичный"}), label(fluid, {"urine": "моча", "blood": "кровь"}), F.when(kind.isNotNull(), "нагрузочный тест"))
    return F.struct(col_base_key(c).alias("base_key"), visit.alias("visit"), fluid.alias("biomaterial"), kind.alias("variant"), F.array_compact(tags).alias("tags"))


def col_variant_label(c) -> Column:
    tags = col_attributes(c)["tags"]
    return F.when(F.size(tags) > 0, F.array_join(tags, ", ")).otherwise(_c(c))


def col_ontology_key(c) -> Column:
    k = F.trim(F.lower(F.coalesce(_c(c), F.lit(""))))
    for pattern, to in ((r"^повторный при[её]м\s+", "приём "), (r"^онлайн-консультация\s+", "приём "), (r"^при[её]м детского\s+", "приём "), (r"\s+в моче$", "")):
        k = F.regexp_replace(k, U + pattern, to)
    k = F.when(k.contains("глюкозотолерантный"), k).otherwise(F.regexp_replace(k, r"\s*\([^)]*\)", ""))
    k = spaced(k)
    return F.when(k.startswith("эхокардиограф"), "эхокг").otherwise(k)


def col_decompose(c) -> Column:
    """Parts of a panel; null where the line is one service."""
    key = F.lower(F.coalesce(_c(c), F.lit("")))
    fixed = lambda parts: F.array(*[F.lit(x) for x in parts])
    tail = F.regexp_extract(key, UI + r"^\s*(?:панель|профиль|комплекс|обследование)[^:]*:\s*(.+)", 1)
    listed = F.filter(F.transform(F.split(tail, "[;,/]| и "), lambda x: F.trim(x)), lambda x: x != "")
    out = reduce(lambda acc, p: acc.when(key.contains(p[0]), fixed(p[1])), R.PANELS[1:], F.when(key.contains(R.PANELS[0][0]), fixed(R.PANELS[0][1])))
    return out.when(key.contains("билирубин") & key.contains("прям") & key.contains("непрям"), fixed(R.BILIRUBIN)).when(F.size(listed) >= 2, listed)


def col_haversine(lat1, lng1, lat2, lng2) -> Column:
    a, b, c, d = (F.radians(_c(x)) for x in (lat1, lng1, lat2, lng2))
    h = F.pow(F.sin((c - a) / 2), 2) + F.cos(a) * F.cos(c) * F.pow(F.sin((d - b) / 2), 2)
    return 2 * 6371.0 * F.asin(F.sqrt(h))


def col_slugify(c) -> Column:
    t = F.lower(_c(c))
    for a, b in R.TRANSLIT.items():
        t = F.replace(t, F.lit(a), F.lit(b))
    t = F.regexp_replace(F.translate(t, *R.TRANSLIT_ONE), r"[^\p{L}\p{N}-]", "")
    return F.btrim(t, F.lit("-"))


def col_title(c) -> Column:
    """Upper case after anything that is no letter, hyphens included."""
    parts = F.split(F.initcap(F.regexp_replace(_c(c), "-", " \u0001 ")), " \u0001 ")
    return F.array_join(parts, "-")


def col_partner_name(c) -> Column:
    n = F.regexp_replace(F.element_at(F.split(_c(c), "/"), -1), r"\.[A-Za-z]{3,4}$", "")
    n = F.regexp_replace(F.regexp_replace(n, "[_]+", " "), U + r"\b(19|20)\d{2}\b", " ")
    return F.btrim(spaced(n), F.lit(" -"))


def col_effective_date(name, as_of: str) -> Column:
    """January 1 of the year in the name if that is not after as_of's year, else as_of."""
    y = F.regexp_extract(_c(name), r"((?:19|20)\d{2})", 1).try_cast("int")
    day = F.lit(as_of).cast("date")
    return F.when(y <= F.year(day), F.make_date(y, F.lit(1), F.lit(1))).otherwise(day)


def col_clinic_prefix(c) -> Column:
    return F.nullif(F.regexp_extract(_c(c), r"^(\d+)[_-]", 1), F.lit("")).cast("long")


def col_is_geocodable(c) -> Column:
    a = F.trim(F.coalesce(_c(c), F.lit("")))
    return (a != "") & ~F.lower(a).rlike(r"^(сеть|г\.|город)") & a.rlike(r"\d")


def col_geo_query(address, city, country: str = "Казахстан") -> Column:
    a = F.trim(F.coalesce(_c(address), F.lit("")))
    a = F.when(~F.lower(a).rlike(r"^(сеть|г\.|город)"), F.nullif(a, F.lit("")))
    return F.concat_ws(", ", a, F.nullif(F.trim(F.coalesce(_c(city), F.lit(""))), F.lit("")), F.lit(country))


def col_phone(c) -> Column:
    return F.regexp_replace(F.coalesce(_c(c), F.lit("")), "[^0-9+]", "")


def col_phone_ok(c) -> Column:
    return F.length(F.regexp_replace(F.coalesce(_c(c), F.lit("")), "[^0-9]", "")) >= 10


def col_host(url) -> Column:
    return F.lower(F.regexp_extract(_c(url), r"^[a-zA-Z]+://([^/:?#]+)", 1))


def col_parse_ref(c) -> Column:
    """struct(scheme, city, clinic) of refs like scheme://city/clinic."""
    part = lambda i: F.nullif(F.regexp_extract(_c(c), r"^(\w+)://([^/]+)(?:/([^/?#]+))?", i), F.lit(""))
    return F.struct(part(1).alias("scheme"), part(2).alias("city"), part(3).alias("clinic"))


def col_file_format(name, head=None) -> Column:
    """From the extension, else from the first bytes."""
    n = F.lower(_c(name))
    known = (("xlsx", "xlsx|xlsm"), ("xls", "xls"), ("docx", "docx"), ("pdf", "pdf"), ("csv", "csv|tsv|txt"), ("json", "json"), ("html", "html?"), ("zip", "zip"), ("image", "png|jpe?g|webp|tiff?"))
    out = reduce(lambda acc, k: acc.when(n.rlike(rf"\.({k[1]})$"), k[0]), known[1:], F.when(n.rlike(rf"\.({known[0][1]})$"), known[0][0]))
    if head is None:
        return out.otherwise("unknown")
    h = F.hex(F.substring(_c(head), 1, 4))
    return out.when(h == "25504446", "pdf").when(h == "504B0304", "zip").when(h == "D0CF11E0", "xls").when(h.startswith("7B") | h.startswith("5B"), "json").when(h.startswith("3C"), "html").otherwise("unknown")
