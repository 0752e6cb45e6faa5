"""Consent as an event log: the latest event of a purpose decides; tokens hold a set of purposes; rows expire by age."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest_state(log: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Last event of each key and purpose. log: keys, purpose, granted, seq."""
    return log.groupBy(*keys, "purpose").agg(F.max_by(F.struct("granted", "seq"), "seq").alias("_s")).select(*keys, "purpose", "_s.granted", "_s.seq")


def valid_tokens(tokens: DataFrame, log: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Tokens with `valid`: not revoked, and all purposes are granted still. tokens: keys, token, purposes (array), revoked."""
    granted = latest_state(log, keys).where("granted").groupBy(*keys).agg(F.collect_set("purpose").alias("_g"))
    ok = ~F.coalesce("revoked", F.lit(False)) & (F.size(F.array_except("purposes", F.coalesce("_g", F.array().cast("array<string>")))) == 0)
    return tokens.join(granted, [*keys], "left").withColumn("valid", ok).drop("_g")


def revoke(tokens: DataFrame, purpose: Column | str) -> DataFrame:
    """Tokens that hold the purpose are revoked."""
    p = F.lit(purpose) if isinstance(purpose, str) else purpose
    return tokens.withColumn("revoked", F.coalesce("revoked", F.lit(False)) | F.array_contains("purposes", p))


def expired(rows: DataFrame, stamp: str, now: float, max_age: float) -> DataFrame:
    """Rows strictly older than max_age, and rows without a stamp, whose age nobody can vouch for."""
    return rows.where(F.coalesce(F.lit(now) - F.col(stamp) > max_age, F.lit(True)))


def retained(rows: DataFrame, stamp: str, now: float, max_age: float) -> DataFrame:
    """The other rows: each row is either expired or retained."""
    return rows.where(F.coalesce(F.lit(now) - F.col(stamp) <= max_age, F.lit(False)))


def without_users(rows: DataFrame, gone: DataFrame, user: str) -> DataFrame:
    """Cascade: rows of deleted users leave."""
    return rows.join(gone.select(user).distinct(), user, "left_anti")


def upsert(store: DataFrame, new: DataFrame, keys: Sequence[str], log: DataFrame, user: str, purpose: str) -> DataFrame:
    """Keyed upsert; new rows of users without a granted purpose are refused. Of new rows with one key one stays, the greatest as a row."""
    ok = latest_state(log, [user]).where((F.col("purpose") == purpose) & F.col("granted")).select(user)
    rest = [F.col(x) for x in store.columns if x not in keys]
    one = new.select(*store.columns).groupBy(*keys).agg(F.max(F.struct(*rest)).alias("_row")) if rest else new.select(*keys).distinct()
    admitted = one.join(ok, user, "left_semi").select(*[F.col(x) if x in keys else F.col(f"_row.{x}") for x in store.columns])
    return store.join(admitted.select(*keys), [*keys], "left_anti").unionByName(admitted)
