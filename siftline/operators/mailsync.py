"""One synchronisation of mailboxes, and what a message's absence from it may mean.

A full listing of a folder is its inventory: what it held before and does not list now is absent, unless the message has aged out
of the rolling window or stands in another folder. A delta lists only changes: there a message is absent only if its removal was
reported, and whatever it does not mention is carried over. An absent message is read back by its provider id: if that is gone the message is
deleted, and otherwise only out of scope. An expired token makes all folders of its account list in full, so that moves between
folders stay whole. Mail without a time counts as inside the window.

All steps are joins by (account, key) or (account, folder, key): an account of any size splits.

Defined results: a message that several folders list is in the first of them by name; a removal of an unknown provider id is nothing; an
account or folder without listing is empty, not absent, in delta mode; rows that a listing repeats count once, the latest of
them; a message that was deleted and is listed again is live again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FULL, DELTA = "full", "delta"


def modes(folders: DataFrame, fields: int, force: bool = False) -> DataFrame:
    """(account, folder, mode). folders: account, folder, token, fields (version of the fields that the state has), expired."""
    whole = F.lit(force) | F.col("token").isNull() | ~F.col("fields").eqNullSafe(F.lit(fields))
    spoilt = folders.groupBy("account").agg(F.max(F.col("expired") & ~whole).alias("_spoilt"))
    at = folders.join(spoilt, "account")
    return at.select("account", "folder", F.when(whole | F.coalesce("_spoilt", F.lit(False)), FULL).otherwise(DELTA).alias("mode"))


def inside(at: str, cutoff: Column | None) -> Column:
    return F.lit(True) if cutoff is None else F.col(at).isNull() | (F.col(at) >= cutoff)


def absences(messages: DataFrame, inventory: DataFrame, folder_modes: DataFrame, listed: DataFrame, removed: DataFrame, cutoff: Column | None) -> DataFrame:
    """(account, key) of known messages that are to be read back."""
    seen = listed.select("account", "key").distinct()
    held = inventory.join(folder_modes.where(F.col("mode") == FULL).select("account", "folder"), ["account", "folder"])
    missing = held.join(listed.select("account", "folder", "key"), ["account", "folder", "key"], "left_anti").select("account", "key")
    missing = missing.join(messages.select("account", "key", "at"), ["account", "key"]).where(inside("at", cutoff)).select("account", "key")
    reported = removed.join(messages.select("account", "provider_id", "key"), ["account", "provider_id"]).select("account", "key")
    return missing.union(reported).distinct().join(seen, ["account", "key"], "left_anti")


def synced(messages: DataFrame, inventory: DataFrame, folder_modes: DataFrame, listing: DataFrame, removed: DataFrame, readable: DataFrame, cutoff: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """The messages after the sync, with ``outcome`` (upserted, tombstoned, out_of_scope or kept), and the inventory.

    messages: account, key, provider_id, folder, at, deleted, in_scope. inventory: account, folder, key. listing: account, folder, key,
    provider_id, at. removed, readable: account, provider_id."""
    latest = F.row_number().over(Window.partitionBy("account", "folder", "key").orderBy(F.desc_nulls_last("at"), "provider_id"))
    listed = listing.where(inside("at", cutoff)).withColumn("_n", latest).where("_n = 1").drop("_n")
    away = absences(messages, inventory, folder_modes, listed, removed, cutoff)
    fate = away.join(messages.select("account", "key", "provider_id"), ["account", "key"]).join(readable.select("account", "provider_id").distinct().withColumn("_there", F.lit(True)), ["account", "provider_id"], "left")
    fate = fate.groupBy("account", "key").agg(F.max(F.coalesce("_there", F.lit(False))).alias("_there"))
    new = listed.groupBy("account", "key").agg(F.min(F.struct("folder", "provider_id", "at")).alias("new"))
    at = messages.join(new, ["account", "key"], "full_outer").join(fate, ["account", "key"], "left")
    outcome = F.when(F.col("new").isNotNull(), "upserted").when(F.col("_there"), "out_of_scope").when(~F.col("_there"), "tombstoned").otherwise("kept")
    here, gone = F.col("new").isNotNull(), F.col("_there").isNotNull()
    after = at.select(
        "account", "key", F.when(here, F.col("new.provider_id")).otherwise(F.col("provider_id")).alias("provider_id"), F.when(here, F.col("new.folder")).when(~gone, F.col("folder")).alias("folder"),
        F.when(here, F.col("new.at")).otherwise(F.col("at")).alias("at"), F.when(here, False).when(gone, ~F.col("_there")).otherwise(F.col("deleted")).alias("deleted"),
        F.when(here, True).when(gone, False).otherwise(F.col("in_scope")).alias("in_scope"), outcome.alias("outcome"),
    )
    observed = listed.select("account", "folder", "key").distinct()
    carried = inventory.join(folder_modes.where(F.col("mode") == DELTA).select("account", "folder"), ["account", "folder"])
    carried = carried.join(observed.select("account", "key").distinct(), ["account", "key"], "left_anti").join(away, ["account", "key"], "left_anti")
    return after, carried.select("account", "folder", "key").union(observed).distinct()


def stale(folders: DataFrame, threshold: int) -> DataFrame:
    """(account, folder, reason): why a folder's store is behind the provider; null if it is not. folders: account, folder, synced, stored_at, live_at, held."""
    reason = F.when(~F.coalesce("synced", F.lit(False)), "never synced").when(F.col("live_at").isNotNull() & F.col("stored_at").isNull(), "no watermark")
    reason = reason.when(F.col("live_at").isNull() & (F.col("stored_at").isNotNull() | (F.col("held") > 0)), "provider is empty").when(F.col("live_at") > F.col("stored_at") + threshold, "provider is newer")
    return folders.select("account", "folder", reason.alias("reason"))
