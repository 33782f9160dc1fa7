"""Queries against their SQL where the given tables are too small to tell them apart."""

import datetime

import duckdb
import pytest

from tariffspark.plans import registry

DAY = datetime.datetime(1997, 3, 1)


@pytest.fixture
def against_sql(spark, tmp_path):
    def run(name, **tables):
        """Rows of the query and of its SQL; tables: (columns, rows)."""
        db = duckdb.connect()
        for t, (kind, rows) in tables.items():
            spark.createDataFrame(rows, kind).coalesce(1).write.parquet(f"{tmp_path}/{t}.parquet")
            db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
        rows = db.execute(registry.oracle_sql()[name]).fetchall()
        df = registry.queries()[name](spark, str(tmp_path))
        names = [x[0] for x in db.description]
        plain = lambda r: tuple(x.date() if isinstance(x, datetime.datetime) and x.time() == datetime.time() else x for x in r)
        return sorted(plain(r) for r in df.select(*names).collect()), sorted(plain(r) for r in rows)

    return run


ORDERS = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string"
LINES = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp"
PARTS = "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"


def order(key, customer):
    return (key, customer, "O", 1.0, DAY, "1-URGENT")


def test_clinics_numbered_like_years(against_sql):
    got, want = against_sql("f19_file_names", orders=(ORDERS, [order(i, c) for i, c in enumerate((7, 1995, 2010, 119951, 19, 2099))]))
    assert got == want
    assert [(r[1], r[2].year) for r in got[:4]] == [("Clinic 7", 1997), ("Clinic", 1995), ("Clinic", 2000), ("Clinic 119951", 1995)]


def test_codes_that_services_share(against_sql):
    parts = [(i, "n", "b", "t", 1, 1.0) for i in (11971, 119701, 119708, 119764, 12)]  # B01.133.002 is that of the first and the third
    lines = [(1, p, 1, p % 7 + 1, 5.0, 100.0 + i, 0.0, 0.0, "A", "F", DAY) for i, p in enumerate((119701, 11971, 12, 119764, 119708))]
    got, want = against_sql("r18_reprocess", orders=(ORDERS, [order(1, 3)]), lineitem=(LINES, lines), part=(PARTS, parts))
    assert got == want and len(got)


def test_last_days_come_out_too(against_sql):
    kind = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    rows = [(i, DAY + datetime.timedelta(days=i // 4, hours=i % 4), 1, "a", float(i * i % 7), "") for i in range(40)]
    got, want = against_sql("t04_daily_prices", events=(kind, rows))
    assert got == want and len(got) == 10
