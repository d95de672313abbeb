"""Folds of observation logs into entities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def last_wins(df: DataFrame, keys: Sequence[str], order: Sequence[str], tombstone) -> DataFrame:
    """The last row of each key, unless that is a tombstone. A grouped maximum: nothing is sorted."""
    last = df.groupBy(*keys).agg(F.max_by(F.struct(*df.columns, tombstone.alias("_gone")), F.struct(*order)).alias("r"))
    return last.where(~F.col("r._gone")).select("r.*").drop("_gone")


def change_events(df: DataFrame, key: str, order: Sequence[str], tracked: Sequence[str]) -> DataFrame:
    """first_seen, seen or changed for each observation, with the tracked fields that differ from the one before."""
    w = Window.partitionBy(key).orderBy(*order)
    at = df.withColumn("_first", F.row_number().over(w) == 1).withColumns({f"_old_{c}": F.lag(c).over(w) for c in tracked})
    changed = F.filter(F.array(*[F.when(~F.col(c).eqNullSafe(F.col(f"_old_{c}")), F.lit(c)) for c in tracked]), lambda x: x.isNotNull())
    at = at.withColumn("changes", F.when(F.col("_first"), F.array().cast("array<string>")).otherwise(changed))
    kind = F.when(F.col("_first"), "first_seen").when(F.size("changes") > 0, "changed").otherwise("seen")
    return at.withColumn("type", kind).drop("_first", *[f"_old_{c}" for c in tracked])


def entity_index(df: DataFrame, key: str, order: Sequence[str], facts: Sequence[str], at: str, seq: str) -> DataFrame:
    """One row of each entity: last facts, first and last time, least sequence number and number of observations."""
    place = F.struct(*order)
    return df.groupBy(key).agg(
        *[F.max_by(F.struct(F.col(c)), place)[c].alias(c) for c in facts],
        F.min(at).alias("first_seen"), F.max(at).alias("last_seen"), F.min(seq).alias("seq"), F.count("*").alias("observations"),
    )


def incremental(old: DataFrame, log: DataFrame, delta: DataFrame, key: str, fold) -> DataFrame:
    """The fold of log and delta: only the keys of the delta are folded anew, the others are carried over. The log is the
    whole history before the delta, so late rows are put in their place."""
    touched = delta.select(key).distinct()
    return old.join(touched, key, "left_anti").unionByName(fold(log.join(touched, key, "left_semi").unionByName(delta)))


def canonical_order(df: DataFrame, key: str, at: str, tie: str) -> DataFrame:
    """Observations of each key with their ``place`` in canonical order: by time, then by id, missing ones first. It does not depend on the order of
    arrival, so a fold in this order is a function of the set. Rows without a key belong to nothing and are left out."""
    order = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (at, tie)]
    return df.where(F.col(key).isNotNull()).withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(*order)))


def pending(manifests: DataFrame, ledger: DataFrame, key: str) -> DataFrame:
    return manifests.join(ledger.select(key), key, "left_anti")


def clock_regressions(df: DataFrame, by: str, seq: str, at: str) -> DataFrame:
    """Rows whose time lies before that of the row before in sequence."""
    w = Window.partitionBy(by).orderBy(seq)
    return df.withColumn("previous", F.lag(at).over(w)).where(F.col("previous") > F.col(at))


def inventory_diff(old: DataFrame, new: DataFrame, key: str, facts: Sequence[str]) -> DataFrame:
    """insert, update, same or tombstone for each key of either."""
    a = old.select(key, F.struct(*facts).alias("_a"))
    b = new.select(key, F.struct(*facts).alias("_b"))
    action = F.when(F.col("_a").isNull(), "insert").when(F.col("_b").isNull(), "tombstone").when(F.col("_a") == F.col("_b"), "same").otherwise("update")
    return a.join(b, key, "full_outer").select(key, action.alias("action"))
