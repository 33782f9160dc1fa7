"""Queries of the sources (S01 - S09) over texts made from the driver's tables, and over its pages."""

import io
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from ..data import raw
from ..sources import files as X
from .registry import query

ORDERS = lambda spark, d: raw(spark, d, "orders")


def _name():
    return F.concat(F.lit("Услуга "), F.translate(F.col("o_orderpriority"), "0123456789-", "abcdefghij "))


NAME = "'Услуга ' || translate(o_orderpriority, '0123456789-', 'abcdefghij ')"


def _price():
    return F.format_string("%d", F.floor("o_totalprice"))


PRICE = "floor(o_totalprice)"
OK = f"{PRICE} > 0"


def _texts(spark, d, line, by="o_custkey"):
    lines = F.array_sort(F.collect_list(F.struct("o_orderkey", line.alias("l"))))
    return ORDERS(spark, d).where(F.floor("o_totalprice") > 0).groupBy(F.col(by).alias("doc_id")).agg(F.array_join(F.transform(lines, lambda x: x["l"]), "\n").alias("text"))


@query("s01_csv_pricelists", f"SELECT o_custkey AS doc_id, trim({NAME}) AS raw_name, {PRICE} AS price FROM orders WHERE {OK}")
def s01(spark, d):
    sep = F.when(F.col("o_custkey") % 3 == 0, ";").when(F.col("o_custkey") % 3 == 1, ",").otherwise("\t")
    line = F.concat(F.lit("x"), sep, _name(), sep, _price())
    return X.items_from_csv_text(_texts(spark, d, line)).select("doc_id", "raw_name", "price")


@query("s02_json_payloads", f"SELECT o_custkey AS doc_id, trim({NAME}) AS raw_name, {PRICE} AS price FROM orders WHERE {OK}")
def s02(spark, d):
    rows = F.collect_list(F.struct(_name().alias("Name"), F.col("o_totalprice").cast("long").alias("price")))
    j = ORDERS(spark, d).where(F.floor("o_totalprice") > 0).groupBy(F.col("o_custkey").alias("doc_id")).agg(rows.alias("items"))
    payload = F.when(F.col("doc_id") % 2 == 0, F.to_json("items")).otherwise(F.to_json(F.struct("items")))
    return X.items_from_json(j.select("doc_id", payload.alias("payload"))).select("doc_id", "raw_name", "price")


@query("s03_html_pages", f"SELECT DISTINCT o_custkey AS page_id, trim({NAME}) AS raw_name, {PRICE} AS price FROM orders WHERE {OK}")
def s03(spark, d):
    t = _texts(spark, d, F.concat(F.lit("<tr><td>1</td><td>"), _name(), F.lit("</td><td>"), _price(), F.lit(" ₸</td></tr>")))
    pages = t.select(F.col("doc_id").alias("page_id"), F.concat(F.lit("<html><table><tr><th>N</th><th>Название</th></tr>"), "text", F.lit("</table></html>")).alias("html"))
    return X.items_from_html(pages.where(F.col("page_id").isNotNull())).select(F.col("id").alias("page_id"), "raw_name", "price")


@query("s03_page_nodes")
def s03_nodes(spark, d):
    return X.html_nodes(raw(spark, d, "pages")).groupBy("id", "kind").agg(F.count("*").alias("nodes"))


@query("s04_site_cards", f"SELECT o_custkey AS page_id, trim({NAME}) AS raw_name, {PRICE} AS price, CAST(o_orderkey % 9 + 1 AS INTEGER) AS duration_days FROM orders WHERE {OK}")
def s04(spark, d):
    card = F.concat(F.lit('<div class="card"><span class="t name">'), _name(), F.lit('</span><b class="cost">от '), _price(), F.lit('</b><i class="days">'), (F.col("o_orderkey") % 9 + 1).cast("string"), F.lit(" дн.</i></div>"))
    pages = _texts(spark, d, card).select(F.col("doc_id").alias("page_id"), F.concat(F.lit("https://"), F.when(F.col("doc_id") % 2 == 0, "lab.example.com").otherwise("www.lab.example.com"), F.lit("/x")).alias("url"), F.concat(F.lit("<html><body>"), "text", F.lit("</body></html>")).alias("html"))
    rules = spark.createDataFrame([("lab.example.com", "name", "cost", "days"), ("example.com", "zzz", "zzz", "zzz")], "host string, name_class string, price_class string, days_class string")
    return X.items_from_cards(pages, rules).select(F.col("id").alias("page_id"), "raw_name", "price", "duration_days")


@query("s05_business_cards", "SELECT s_suppkey AS page_id, s_name AS name, '+7' || CAST(s_suppkey AS VARCHAR) AS phone, CAST(s_suppkey % 5 AS DOUBLE) + 0.5 AS rating, CASE s_suppkey % 3 WHEN 0 THEN 'Пн–Ср 08:00–1' || CAST(s_suppkey % 10 AS VARCHAR) || ':00, Сб 10:00–14:00' WHEN 1 THEN 'Круглосуточно' ELSE '' END AS working_hours FROM supplier")
def s05(spark, d):
    s = raw(spark, d, "supplier")
    k = F.col("s_suppkey")
    early = F.concat(F.lit('{"dayOfWeek":["https://schema.org/Monday","Tuesday","Wednesday"],"opens":"08:00:00","closes":"1'), (k % 10).cast("string"), F.lit(':00"},{"dayOfWeek":"Saturday","opens":"09:00","closes":"12:00"},{"dayOfWeek":"http://schema.org/Saturday/","opens":"10:00","closes":"14:00"},{"dayOfWeek":"Sunday","closes":"14:00"}'))
    always = '{"dayOfWeek":["Monday","Tuesday","Wednesday","Thursday","Friday","Saturday","Sunday"],"opens":"00:00","closes":"23:59"}'
    spec = F.concat(F.lit("["), F.when(k % 3 == 0, early).when(k % 3 == 1, always).otherwise(""), F.lit("]"))
    j = F.concat(F.lit('{"@type":"MedicalClinic","name":"'), "s_name", F.lit('","telephone":["+7'), k.cast("string"), F.lit('","x"],"openingHoursSpecification":'), spec, F.lit(',"aggregateRating":{"ratingValue":"'), (k % 5).cast("string"), F.lit(',5"}}'))
    pages = s.select(k.alias("page_id"), F.concat(F.lit('<script type="application/ld+json">'), j, F.lit("</script>")).alias("html"))
    return X.business_cards(pages).select("page_id", "name", "phone", "rating", "working_hours")


@query("s06_text_lines", f"SELECT o_custkey AS doc_id, trim({NAME}) AS raw_name, {PRICE} AS price FROM orders WHERE {OK}")
def s06(spark, d):
    return X.items_from_text(_texts(spark, d, F.concat(_name(), F.lit(" ...... "), _price(), F.lit(" тг")))).select("doc_id", "raw_name", "price")


@query("s07_cell_grids", f"SELECT o_custkey AS doc_id, trim({NAME}) AS name, 'B' || lpad(CAST(o_orderkey % 90 AS VARCHAR), 2, '0') || '.001.002' AS code, {PRICE} AS price_resident, {PRICE} + 10 AS price_nonresident FROM orders WHERE {OK}")
def s07(spark, d):
    o = ORDERS(spark, d).where(F.floor("o_totalprice") > 0)
    code = F.concat(F.lit("В"), F.lpad((F.col("o_orderkey") % 90).cast("string"), 2, "0"), F.lit(".001.002"))
    body = o.select(F.col("o_custkey").alias("doc_id"), F.lit("s").alias("sheet"), (F.col("o_orderkey") + 10).cast("int").alias("row_idx"), F.array(code, _name(), _price(), F.format_string("%d", F.floor("o_totalprice") + 10)).alias("cells"))
    ids = o.select(F.col("o_custkey").alias("doc_id")).distinct()
    head = ids.select("doc_id", F.lit("s").alias("sheet"), F.explode(F.array(F.struct(F.lit(1).alias("row_idx"), F.array(F.lit("Прайс"), F.lit(""), F.lit(""), F.lit("")).alias("cells")), F.struct(F.lit(2).alias("row_idx"), F.array(F.lit("Код"), F.lit("Наименование услуг"), F.lit("Цена для граждан РК"), F.lit("Цена для нерезидентов")).alias("cells")))).alias("x")).select("doc_id", "sheet", "x.*")
    return X.items_from_grid(head.unionByName(body)).select("doc_id", "name", "code", "price_resident", "price_nonresident")


@query("s08_two_columns", f"SELECT o_custkey AS doc_id, trim({NAME}) AS raw_name, {PRICE} AS price FROM orders WHERE {OK}")
def s08(spark, d):
    o = ORDERS(spark, d).where(F.floor("o_totalprice") > 0)
    grid = o.select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").cast("int").alias("row_idx"), F.when(F.col("o_custkey") % 2 == 0, F.array(_name(), _price())).otherwise(F.array(_price(), _name())).alias("cells"))
    return X.items_from_table(grid).select("doc_id", "raw_name", "price")


@query("s09_archive", "SELECT page_id % 20 AS archive, 'page' || CAST(page_id AS VARCHAR) || '.csv' AS name, octet_length(encode(coalesce(html, ''))) AS length, 'csv' AS format FROM pages")
def s09(spark, d):
    """Pages packed into twenty archives, every second one in a zip inside, beside read-mes; then listed."""

    def pack(key, rows: pd.DataFrame) -> pd.DataFrame:
        outer, inner = io.BytesIO(), io.BytesIO()
        with zipfile.ZipFile(outer, "w", zipfile.ZIP_DEFLATED) as a, zipfile.ZipFile(inner, "w") as b:
            a.writestr("readme.txt", "x")
            for i, html in zip(rows["page_id"], rows["html"], strict=True):
                (a if i % 2 else b).writestr(f"dir/page{i}.csv", html or "")
            b.close()
            a.writestr("more/inner.zip", inner.getvalue())
        data = outer.getvalue()
        return pd.DataFrame({"path": [f"{key[0]}.zip"], "name": [f"{key[0]}.zip"], "length": [len(data)], "content": [data]})

    files = raw(spark, d, "pages").groupBy(F.col("page_id") % 20).applyInPandas(pack, "path string, name string, length long, content binary")
    listed = X.price_files(X.archive_members(files))
    return listed.select(F.regexp_extract("path", r"^(\d+)\.zip", 1).cast("long").alias("archive"), "name", "length", "format")
