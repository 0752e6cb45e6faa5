"""Deterministic splits by hash of a group, so that a group never falls apart and stays where it is as data grow."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import hash_bucket

DEFAULT = {"train": 0.8, "calib": 0.1, "test": 0.1}


def hash_split(df: DataFrame, group: str, fractions: dict[str, float] | None = None, seed: int = 0) -> DataFrame:
    """Add `split` by the group's bucket; rows without a group are `unassigned`. The last split takes what rounding leaves."""
    fractions = fractions or DEFAULT
    total, edge, names = sum(fractions.values()), 0.0, list(fractions)
    bucket = hash_bucket(group, seed)
    out = F.when(F.col(group).isNull() | (F.col(group).cast("string") == ""), "unassigned")
    for name in names[:-1]:
        edge += fractions[name] / total
        out = out.when(bucket <= edge, name)
    return df.withColumn("split", out.otherwise(names[-1]))


def donate_split(df: DataFrame, group: str, fractions: dict[str, float] | None = None, seed: int = 0) -> DataFrame:
    """As hash_split, but a missing group is in the first split, and while a split has no group it takes the least bucket of the split with most groups (of those with two or more). The table of groups is metadata: one row a group."""
    fractions = fractions or DEFAULT
    names = list(fractions)
    split = hash_split(df.select(group).distinct(), group, fractions, seed).withColumn("split", F.when(F.col("split") == "unassigned", names[0]).otherwise(F.col("split"))).withColumn("_b", F.coalesce(hash_bucket(group, seed), F.lit(0.0)))
    count = {r["split"]: r["count"] for r in split.groupBy("split").count().collect()}
    for name in names:
        if not count.get(name):
            donor = max((n for n in names if count.get(n, 0) > 1), key=lambda n: count[n], default=None)
            if donor is None:
                break
            given = split.where(F.col("split") == donor).orderBy("_b", group).first()[group]
            split = split.withColumn("split", F.when(F.col(group).eqNullSafe(F.lit(given)), name).otherwise(F.col("split")))
            count[donor] -= 1
            count[name] = 1
    return df.join(split.select(F.col(group).alias("_g"), "split"), F.col(group).eqNullSafe(F.col("_g")), "left").drop("_g")


def assert_disjoint(df: DataFrame, group: str) -> DataFrame:
    """Groups that are in more than one split (none if all is well)."""
    return df.groupBy(group).agg(F.collect_set("split").alias("splits")).where(F.size("splits") > 1)
