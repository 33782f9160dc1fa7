"""Every registered query of the library is analysed; those that no SQL checks also run on a few rows of each table."""

import pytest

from tariffspark.plans import registry

DATA = "/root/testdata/sf0.001"
STREAMS = sorted(n for n in registry.queries() if n.startswith("t0"))


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(STREAMS)))
def test_analysed(spark, name):
    assert registry.queries()[name](spark, DATA).columns


@pytest.fixture(scope="module")
def few(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("few")
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        spark.read.parquet(f"{DATA}/{t}.parquet").limit(40).coalesce(1).write.parquet(f"{base}/{t}.parquet")
    return str(base)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs(spark, few, name):
    registry.queries()[name](spark, few).write.format("noop").mode("overwrite").save()
