"""Which exercise an item leads to, and what a learner's level allows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .joins import lookup_pattern

LEVELS = ["beginner", "intermediate", "advanced"]


def level_index(level: Column) -> Column:
    """0, 1, 2; NULL for an unknown level."""
    return F.when(level.isin(*LEVELS), F.array_position(F.array(*[F.lit(x) for x in LEVELS]), level) - 1)


def exercise_of(items: DataFrame, mapping: DataFrame) -> DataFrame:
    """items(attribute, status, magnitude) with `exercise`: by attribute:status, else attribute:sign, else attribute, else the first pattern that fits.

    mapping: pos, pattern, exercise; a small table.
    """
    sign = F.when(F.col("magnitude") < 0, "-").otherwise("+")
    keyed = items.withColumns({"_k1": F.concat_ws(":", "attribute", "status"), "_k2": F.concat_ws(":", "attribute", sign)})
    exact = mapping.groupBy("pattern").agg(F.min_by("exercise", "pos").alias("_e"))
    for k in ("_k1", "_k2"):
        keyed = keyed.join(exact.select(F.col("pattern").alias(k), F.col("_e").alias(f"{k}_e")), k, "left")
    out = lookup_pattern(keyed, mapping, "attribute")
    return out.withColumn("exercise", F.coalesce("_k1_e", "_k2_e", "exercise")).select(*items.columns, "exercise")


def allowed(exercises: DataFrame, level: str, avoid: list[str]) -> DataFrame:
    """Exercises up to the level that share no tag with those to avoid. exercises: level, tags."""
    clash = F.arrays_overlap("tags", F.array(*[F.lit(x) for x in avoid])) if avoid else F.lit(False)
    return exercises.where((level_index(F.col("level")) <= LEVELS.index(level)) & ~F.coalesce(clash, F.lit(False)))


def check_mapping(mapping: DataFrame, exercises: DataFrame) -> DataFrame:
    """Problems: mapped exercises that do not exist, and exercises of an unknown level."""
    lost = mapping.join(exercises.select(F.col("id").alias("exercise")), "exercise", "left_anti").select(F.concat(F.lit("no such exercise: "), "exercise").alias("problem"))
    odd = exercises.where(level_index(F.col("level")).isNull()).select(F.concat(F.lit("unknown level of "), "id").alias("problem"))
    return lost.unionByName(odd).distinct()
