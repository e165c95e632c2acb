"""Checks of tables against each other. A check returns the rows that break it; an empty result passes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n) of keys that occur more than once. A null key counts as a value."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def unordered_duplicates(df: DataFrame, a: str, b: str) -> DataFrame:
    """(low, high, n) of pairs that occur more than once in either order."""
    return df.groupBy(F.least(a, b).alias("low"), F.greatest(a, b).alias("high")).agg(F.count("*").alias("n")).where("n > 1")


def missing_targets(df: DataFrame, key: str, target: DataFrame, target_key: str) -> DataFrame:
    """Rows whose key is not among the target's; null keys refer to nothing."""
    there = target.select(F.col(target_key).alias(key)).distinct()
    return df.where(F.col(key).isNotNull()).join(there, key, "left_anti")


def foreign_owners(df: DataFrame, key: str, owner: str, target: DataFrame, target_key: str, target_owner: str) -> DataFrame:
    """Rows whose target exists but belongs to another owner only."""
    owners = target.select(F.col(target_key).alias(key), F.col(target_owner).alias(owner)).distinct()
    exists = df.join(owners.select(key).distinct(), key, "left_semi")
    return exists.join(owners, [key, owner], "left_anti")


def coverage(parents: DataFrame, key: str, children: dict[str, DataFrame]) -> DataFrame:
    """(key, one count a child table): 0 where a parent has none. Children are counted before they are joined, so that
    no two of them multiply."""
    out = parents.select(key).distinct()
    for name, df in children.items():
        out = out.join(df.groupBy(key).agg(F.count("*").alias(name)), key, "left")
    return out.fillna(0, list(children))


def uncovered(parents: DataFrame, key: str, children: dict[str, DataFrame]) -> DataFrame:
    """Parents that lack a child in any of the tables."""
    return coverage(parents, key, children).where(reduce(lambda a, b: a | b, [F.col(n) == 0 for n in children]))


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows with ``side`` (left, right) that one side has more often than the other; empty if both are equal as bags."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def rule_counts(checks: dict[str, DataFrame]) -> DataFrame:
    """(rule, violations), a row for each check, 0 where nothing breaks it."""
    return reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("violations")).select(F.lit(name).alias("rule"), "violations") for name, df in checks.items()])


def attached(parents: DataFrame, key: str, children: dict[str, DataFrame]) -> DataFrame:
    """Parents with each child table as a sorted array of structs, an empty one where there are none. Each child is
    aggregated before it is joined. An array holds one parent's rows."""
    out = parents
    for name, df in children.items():
        rest = [c for c in df.columns if c != key]
        lists = df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*rest))).alias(name))
        out = out.join(lists, key, "left").withColumn(name, F.coalesce(name, F.array().cast(lists.schema[name].dataType)))
    return out


def first_of(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in an explicit order."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*keys, "r.*")


def latest(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The last row of each key in an explicit order: the state of an append-only log."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*keys, "r.*")
