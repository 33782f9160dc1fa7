"""Extendible hashing: shards and their files against SQL, on small fixtures with small limits."""

import duckdb
import pytest

from tariffspark.llm import sharding


@pytest.mark.parametrize("limit,most", [(1, 200_000), (40, 200_000), (400, 3), (10**9, 0)])
def test_shards(spark, tmp_path, monkeypatch, limit, most):
    monkeypatch.setattr(sharding, "BROADCAST", most)
    texts = ["x" * (7 * i % 50) for i in range(120)] + [None, "", "y" * 900, "é" * 30]
    rows = [*enumerate(texts), (3, texts[3]), (None, "no id")]
    d = spark.createDataFrame([(*r, "z", 1) for r in rows], "doc_id long, text string, shard string, depth int")
    got = [(r.row.doc_id, r.shard, r.depth, r.n_bytes, r.shard_bytes) for r in sharding.shard(d, limit).collect()]
    documents = d.select("doc_id", "text").toPandas().astype({"doc_id": "Int64"})  # noqa: F841
    want = duckdb.sql(sharding.oracle(limit)).fetchall()
    key = lambda r: [str(x) for x in r]
    assert sorted(set(got), key=key) == sorted(set(want), key=key) and len(got) == len(rows)
    by = {}
    for _, s, _, n, total in got:
        by.setdefault((s, total), []).append(n)
    assert all(sum(n) == total and (total <= limit or len(set(n)) == 1) for (_, total), n in by.items())
    files = sharding.write_shards(d, str(tmp_path / "s"), limit).collect()
    assert sorted(((r.row.doc_id, r.shard) for r in files), key=key) == sorted(((r[0], r[1]) for r in got), key=key)
    assert all(r.row.shard == "z" for r in files)
    assert sharding.shard(d.limit(0), limit).count() == 0
