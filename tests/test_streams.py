"""Streams over several micro-batches: replays and crashes, late rows, state that is dropped."""

from datetime import datetime, timedelta
from decimal import Decimal

import numpy as np
import pytest

from tariffspark.streaming import jobs as S

DAY0 = datetime(2024, 1, 1)
PRICES = "id long, clinic_id long, service_id long, source_type string, price decimal(12,2), match_confidence double, valid_from date"


def at(days, **more):
    return DAY0 + timedelta(days=days, **more)


def batches(spark, tmp_path, kind, *rows):
    """One file, and so one micro-batch, a list of rows, in order."""
    for n, some in enumerate(rows):
        spark.createDataFrame(some, kind).coalesce(1).write.parquet(str(tmp_path / f"b{n}"))
    files = [next((tmp_path / f"b{n}").glob("*.parquet")) for n in range(len(rows))]
    (tmp_path / "in").mkdir()
    for n, f in enumerate(files):
        f.rename(tmp_path / "in" / f"{n}.parquet")
        import os

        os.utime(tmp_path / "in" / f"{n}.parquet", (1_000_000 + n, 1_000_000 + n))
    return spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def drained(spark, tmp_path, df):
    def put(batch, i):
        batch.write.mode("overwrite").parquet(str(tmp_path / f"out/batch={i}"))

    q = df.writeStream.foreachBatch(put).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
    q.awaitTermination()
    rows = [tuple(r) for r in spark.read.schema(df.schema).parquet(str(tmp_path / "out")).select(df.columns).collect()]
    state = [o["numRowsTotal"] for p in q.recentProgress for o in p["stateOperators"]]
    return sorted(rows), state


def test_changes_and_expiry(spark, tmp_path):
    kind = "clinic_id long, service_id string, id long, recorded_at timestamp, price double"
    one = [(1, "a", i, at(d), p) for i, (d, p) in enumerate([(3, 2.0), (1, 1.0), (2, 1.0), (4, 2.0)])]
    two = [(1, "a", i, at(d), p) for i, (d, p) in enumerate([(3, 7.0), (4, 2.0), (5, 3.0)])] + [(2, "b", 9, at(1000), 1.0)]
    three = [(2, "b", 10, at(1001), 1.0), (3, "c", 11, at(1002), 4.0)]
    rows, state = drained(spark, tmp_path, S.change_history(batches(spark, tmp_path, kind, one, two, three)))
    assert [(k, (d - DAY0).days, p) for k, _, d, p in rows] == [(1, 1, 1.0), (1, 3, 2.0), (1, 5, 3.0), (2, 1000, 1.0), (3, 1002, 4.0)]


def test_drops_step_by_step():
    def plain(prices, base):
        out = []
        for p in prices:
            if base is not None and p < base - 0.001:
                out.append((base, p))
            if base is None or abs(p - base) > 0.001:
                base = p
        return out, base

    rnd = np.random.default_rng(2)
    for n in range(200):
        prices = rnd.choice([10.0, 10.0005, 9.9996, 9.0, 11.0, 8.9991] if n % 2 else [1.0, 2.0, 3.0, 3.0], rnd.integers(0, 12))
        for base in (None, 10.0, 1.0):
            assert S.drops(prices, base) == plain(prices.tolist(), base)


def test_baseline_is_dropped_after_its_days(spark, tmp_path):
    kind = "service_id string, recorded_at timestamp, price double"
    subs = spark.createDataFrame([(1, "a", 100.0), (2, "b", None)], "id long, service_id string, last_price double")
    one = [("a", at(0), 90.0), ("b", at(0), 50.0)]
    two = [("b", at(100), 40.0)]  # passes the timer of a (10 days), not of b, which it renews
    three = [("b", at(101), 40.0)]  # timers fire at the end of a batch
    four = [("a", at(102), 95.0), ("b", at(103), 30.0)]
    rows, _ = drained(spark, tmp_path, S.price_drops(batches(spark, tmp_path, kind, one, two, three, four), subs, days=10, late="1 day"))
    # a is measured against its given price again, not against 90
    assert rows == [(1, 100.0, 90.0), (1, 100.0, 95.0), (2, 40.0, 30.0), (2, 50.0, 40.0)]


def test_days_close_and_late_rows(spark, tmp_path):
    kind = "ts timestamp, service_id string, price double"
    one = [(at(0, hours=h), "a", p) for h, p in ((1, 5.0), (2, 1.0), (3, 3.0))] + [(at(4), "a", 9.0)]
    two = [(at(0, hours=5), "a", 2.0), (at(8), "a", 9.0)]  # day 0 is four days back: still counted
    three = [(at(9), "a", 9.0)]
    four = [(at(0, hours=6), "a", 0.5), (at(20), "a", 9.0)]  # day 0 has been closed: not counted
    rows, state = drained(spark, tmp_path, S.daily_prices(batches(spark, tmp_path, kind, one, two, three, four), "5 days"))
    assert [(d.day, n, lo, mid) for d, _, n, lo, mid in rows] == [(1, 4, 1.0, 2.0), (5, 1, 9.0, 9.0), (9, 1, 9.0, 9.0), (10, 1, 9.0, 9.0)]
    assert state[-1] == 1 < max(state)


def _batch(spark, *rows):
    return spark.createDataFrame([(i, c, s, t, Decimal(p), 1.0, DAY0.date()) for i, c, s, t, p in rows], PRICES)


def _rows(table):
    return sorted((r.clinic_id, r.service_id, float(r.price), r.source_type) for r in table.read().collect())


def test_crash_between_write_and_commit(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "prices")
    table = S.PriceTable(spark, path, buckets=4)
    table.upsert(_batch(spark, (1, 1, 1, "api", 10), (2, 2, 2, "api", 20)), 0)
    before = _rows(table)

    def killed(*_):
        raise RuntimeError("killed")

    with monkeypatch.context() as m:
        m.setattr(table, "commit", killed)
        with pytest.raises(RuntimeError):
            table.upsert(_batch(spark, (3, 1, 1, "upload", 15), (4, 3, 3, "api", 30)), 1)
    again = S.PriceTable(spark, path, buckets=4)  # a new driver finds the last commit
    assert again.last() == 0 and _rows(again) == before
    again.upsert(_batch(spark, (3, 1, 1, "upload", 15), (4, 3, 3, "api", 30)), 1)
    assert again.commits() == [0, 1]
    assert _rows(again) == [(1, 1, 15.0, "upload"), (2, 2, 20.0, "api"), (3, 3, 30.0, "api")]
    # only buckets that the batch touches are written anew
    held = again.held()
    assert 0 in held.values() and len(set(held.values())) == 2


def test_replayed_batch_changes_nothing(spark, tmp_path):
    kind = "item_id long, clinic_id long, raw_name string, source_type string, price decimal(12,2), valid_from date"
    services = spark.createDataFrame([(1, "Blood", "x", ["b"])], "id long, canonical_name string, category string, synonyms array<string>")
    stream = batches(spark, tmp_path, kind, [(1, 7, "blood", "api", Decimal(5), DAY0.date())], [(2, 7, "blood", "api", Decimal(9), DAY0.date())])
    table = S.PriceTable(spark, str(tmp_path / "prices"))
    S.ingest(stream, services, table, str(tmp_path / "c1")).awaitTermination()
    assert _rows(table) == [(7, 1, 9.0, "api")] and table.commits() == [0, 1]
    S.ingest(stream, services, table, str(tmp_path / "c2")).awaitTermination()  # a lost checkpoint: all batches come again
    assert _rows(table) == [(7, 1, 9.0, "api")] and table.commits() == [0, 1]


def test_no_rows(spark, tmp_path):
    table = S.PriceTable(spark, str(tmp_path / "prices"))
    assert table.last() == -1 and table.read().collect() == []
    table.upsert(_batch(spark), 0)
    assert table.commits() == [0] and table.read().collect() == []


def test_keys_of_a_part_share_its_state(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "BUCKETS", 1)
    kind = "clinic_id long, service_id string, id long, recorded_at timestamp, price double"
    one = [(1, "a", 1, at(1), 1.0), (1, "a:b", 2, at(1), 1.0), (None, None, 3, at(2), 5.0), (2, "", 4, at(1), 7.0), (2, None, 5, at(1), 8.0)]
    two = [(1, "a", 6, at(2), 1.0), (1, "a:b", 7, at(2), 2.0), (None, None, 8, at(1), 6.0), (2, "", 9, at(2), 8.0), (9, "z", 10, at(1000), 1.0)]
    three = [(9, "z", 11, at(1001), 1.0)]
    four = [(9, "z", 12, at(1002), 2.0)]
    rows, state = drained_by(spark, tmp_path, S.change_history(batches(spark, tmp_path, kind, one, two, three, four)))
    assert rows == sorted([(1, "a", 1, 1.0), (1, "a:b", 1, 1.0), (None, None, 2, 5.0), (2, "", 1, 7.0), (2, None, 1, 8.0), (1, "a:b", 2, 2.0), (2, "", 2, 8.0), (9, "z", 1000, 1.0), (9, "z", 1002, 2.0)], key=str)
    assert max(state) <= 4  # one value and one timer for all keys


def drained_by(spark, tmp_path, df):
    q = df.writeStream.foreachBatch(lambda b, i: b.write.mode("overwrite").parquet(str(tmp_path / f"out/batch={i}"))).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
    q.awaitTermination()
    rows = [(r.clinic_id, r.service_id, (r.recorded_at - DAY0).days, r.price) for r in spark.read.schema(df.schema).parquet(str(tmp_path / "out")).collect()]
    return sorted(rows, key=str), [o["numRowsTotal"] for p in q.recentProgress for o in p["stateOperators"]]
