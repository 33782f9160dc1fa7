"""The canonical tables (clinics, services, prices, ...) over the driver's tables.

Each mapping is one SQL text that Spark and DuckDB both run, so a query and its oracle start from the same rows.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

AS_OF, FRESH_DAYS, CUTOFF = "2001-06-30", 365, "2000-06-30"
NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

CANON = {
    "clinics": """SELECT s_suppkey AS id, s_name AS name, n_name AS city, r_name AS district,
        CASE WHEN s_suppkey % 5 = 0 THEN 'сеть клиник' ELSE 'street ' || CAST(s_suppkey AS STRING) END AS address,
        CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE 43.0E0 + s_suppkey * 0.01E0 END AS lat,
        CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE 76.0E0 + s_suppkey * 0.02E0 END AS lng,
        '+7 (700) ' || CAST(1000000 + s_suppkey AS STRING) AS phone, '' AS working_hours,
        CASE WHEN s_suppkey % 4 = 0 THEN '' ELSE 'http://c' || CAST(s_suppkey AS STRING) || '.example.com' END AS website,
        CAST(s_suppkey % 11 AS DOUBLE) / 2 AS rating,
        CASE s_suppkey % 3 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END AS online_booking,
        s_suppkey % 10 <> 0 AS is_public
        FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey""",
    "services": """SELECT p_partkey AS id, p_name || ' ' || p_type AS canonical_name, p_brand AS category, p_name AS synonym,
        CASE WHEN p_partkey % 3 = 0 THEN 'B' || LPAD(CAST(p_partkey % 40 AS STRING), 2, '0') || '.' || LPAD(CAST(p_partkey % 600 AS STRING), 3, '0') || '.001' END AS tarificator_code,
        p_type AS specialty FROM {part}""",
    "prices": """SELECT l_orderkey * 8 + l_linenumber AS id, l_suppkey AS clinic_id,
        CASE WHEN l_linenumber = 7 THEN NULL ELSE l_partkey END AS service_id, l_orderkey AS run_id,
        CASE l_returnflag WHEN 'A' THEN 'upload' WHEN 'N' THEN 'api' ELSE 'web_scrape' END AS source_type,
        'Item ' || CAST(l_partkey AS STRING) AS raw_name, CAST(l_extendedprice AS DECIMAL(12, 2)) AS price, 'KZT' AS currency,
        1 - l_discount * 5 AS match_confidence, CAST(l_shipdate AS DATE) AS valid_from,
        CASE WHEN l_quantity < 3 THEN NULL ELSE CAST(l_shipdate AS DATE) END AS parsed_at,
        CASE WHEN l_linestatus = 'O' THEN TRUE WHEN l_linenumber % 2 = 0 THEN FALSE END AS is_active,
        CAST(l_extendedprice AS DECIMAL(12, 2)) AS price_resident,
        CAST(CAST(l_extendedprice AS DECIMAL(12, 2)) + (l_linenumber - 2) AS DECIMAL(12, 2)) AS price_nonresident,
        l_linenumber < 2 AS is_anomaly, l_linenumber AS duration_days,
        CASE WHEN l_linenumber % 2 = 0 THEN 'http://src.example.com/' || CAST(l_orderkey AS STRING) ELSE '' END AS source_url
        FROM {lineitem}""",
    "runs": """SELECT o_orderkey AS id, o_custkey % 100 AS source_id, o_custkey % 50 AS clinic_id, o_orderstatus AS status,
        CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE 'file_' || CAST(o_orderkey AS STRING) || '.xlsx' END AS file_name,
        CAST(o_orderdate AS DATE) AS created_at, o_orderpriority AS raw_content,
        CASE WHEN o_orderstatus = 'P' THEN 0 ELSE o_custkey % 9 END AS items_found FROM {orders}""",
    "price_history": """SELECT l_orderkey * 8 + l_linenumber AS id, l_suppkey AS clinic_id, l_partkey AS service_id,
        CAST(l_extendedprice AS DECIMAL(12, 2)) AS price, CAST(l_shipdate AS DATE) AS recorded_at FROM {lineitem}""",
    "subscriptions": """SELECT c_custkey AS id, c_custkey AS service_id,
        CASE WHEN c_custkey % 3 = 0 THEN c_custkey % 100 END AS clinic_id,
        CASE WHEN c_custkey % 3 = 1 THEN n_name ELSE '' END AS city, '+7700' || CAST(1000000 + c_custkey AS STRING) AS phone,
        CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE CAST(20000 + c_acctbal AS DECIMAL(12, 2)) END AS last_price,
        c_custkey % 7 <> 0 AS active FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey""",
    "reports": """SELECT o_orderkey AS id, o_custkey % 100 AS clinic_id, o_orderpriority AS note,
        CASE o_orderstatus WHEN 'O' THEN 'new' WHEN 'F' THEN 'reviewed' ELSE 'fixed' END AS status, CAST(o_orderdate AS DATE) AS created_at FROM {orders}""",
}


def canon(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = CANON[name]
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in NAMES if f"{{{t}}}" in sql}
    return spark.sql(sql, **used)


def raw(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_canon(sql: str) -> str:
    """DuckDB SQL with the canonical tables that it names as common table expressions."""
    need = [n for n in CANON if re.search(rf"\b{n}\b", sql)]
    ctes = ", ".join(f"{n} AS ({re.sub(r'{(\w+)}', r'\1', CANON[n])})" for n in need)
    body = sql.strip()
    if not need:
        return body
    return f"WITH {ctes}, {body[5:]}" if body[:5].upper() == "WITH " else f"WITH {ctes} {body}"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares (spark.checkpoint.dir); a temporary one only on a local master that sets none."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if path is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="spark-")
    return path.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: what several readers need is made once, and its lineage ends there."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
