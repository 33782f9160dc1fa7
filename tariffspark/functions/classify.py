"""keyword rules, and F14: the ontology, as joins and expressions over rule tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import rules as R
from . import text as T


def classify_by_rules(df: DataFrame, rules, raw: str = "raw_name") -> DataFrame:
    """rules: (canonical, category, keywords, require, exclude) in order; the first that fits names the item."""
    low = F.lower(raw)

    def fits(r):
        ok = T.has_any(low, r[2])
        if r[3]:
            ok = ok & T.has_any(low, r[3])
        return ok & ~T.has_any(low, r[4]) if r[4] else ok

    pick = lambda i: reduce(lambda acc, r: acc.when(fits(r), r[i]), rules[1:], F.when(fits(rules[0]), rules[0][i]))
    return df.withColumn("canonical", pick(0)).withColumn("rule_category", pick(1))


def with_rule_confidence(df: DataFrame, raw: str = "raw_name") -> DataFrame:
    """Display confidence of a classified item: its similarity to the canonical name, between 0.82 and 1."""
    from .similarity import col_token_set_ratio

    s = col_token_set_ratio(T.col_clean(raw), T.col_clean("canonical")) / 100
    return df.withColumn("confidence", F.when(F.col("canonical").isNotNull(), F.greatest(F.lit(0.82), F.least(F.lit(1.0), s))))


def with_ontology(services: DataFrame, name: str = "canonical_name") -> DataFrame:
    """Adds code, ontology_group and insured where the service's base key is known."""
    known = services.sparkSession.createDataFrame(list(R.ONTOLOGY), "okey string, code string, ontology_group string, insured boolean")
    return services.withColumn("okey", T.col_ontology_key(name)).join(F.broadcast(known), "okey", "left")  # a table of 31 rows


def ontology_groups(spark) -> DataFrame:
    return spark.createDataFrame(list(R.ONTOLOGY), "okey string, code string, ontology_group string, insured boolean").select("ontology_group").distinct().orderBy("ontology_group")
