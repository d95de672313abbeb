"""Which stored blobs may go: a tree of rules per tier over blobs, the manifests that refer to them, their fetches and the
entities that these fed.

A rule is ``never``, one filter, or ``all_of`` / ``any_of`` of rules, nested at will; it compiles to one column. A blob may go
only if every operation that refers to it lies in a tier whose rule holds for its dates: the latest posting date of all entities that it
fed and the latest time that it was observed. One reference of a tier that never prunes, or one date that is missing, keeps it.
A store in which any manifest or entity is damaged has an empty plan, as what refers to what is not known there.

Everything is grouped by blob, equal rows without a step of their own: operations are flags of few kinds, entities meet manifests by fetch, damage is one row for each store.

Defined results: an operation without a tier, or a tier without a rule, never prunes; a missing date is older than nothing; a blob without
references is an orphan; a reference to bytes that are not here is ``absent``; equal rows of a manifest count once.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NEVER, ALL_OF, ANY_OF = "never", "all_of", "any_of"
FILTERS = {"posting_older_than_days": "posting_date", "observed_older_than_days": "last_observed"}


def compiled(rule, now: Column, where: str = "rule") -> Column:
    """A rule as a column over posting_date and last_observed; ValueError says where a rule is none."""
    if rule == NEVER:
        return F.lit(False)
    if not isinstance(rule, Mapping) or len(rule) != 1:
        raise ValueError(f"{where}: expected {NEVER!r}, a filter or one of {ALL_OF}, {ANY_OF}, got {rule!r}")
    (key, value), = rule.items()
    if key in (ALL_OF, ANY_OF):
        if not isinstance(value, list) or not value:
            raise ValueError(f"{where}.{key}: expected rules, got {value!r}")
        parts = [compiled(r, now, f"{where}.{key}[{i}]") for i, r in enumerate(value)]
        out = parts[0]
        for p in parts[1:]:
            out = out & p if key == ALL_OF else out | p
        return out
    if key not in FILTERS:
        raise ValueError(f"{where}: unknown filter {key!r}")
    if not isinstance(value, int) or isinstance(value, bool) or value < 0:
        raise ValueError(f"{where}.{key}: expected days, got {value!r}")
    return F.coalesce(F.col(FILTERS[key]) < now - F.make_interval(days=F.lit(value)), F.lit(False))


def described(rule) -> str:
    if rule == NEVER:
        return NEVER
    (key, value), = rule.items()
    if key in FILTERS:
        return f"{FILTERS[key].replace('_', ' ')} older than {value}d"
    return "(" + (" AND " if key == ALL_OF else " OR ").join(map(described, value)) + ")"


def plan(blobs: DataFrame, manifests: DataFrame, entities: DataFrame, tiers: Mapping[str, str], rules: Mapping[str, object], now: Column) -> DataFrame:
    """(store, sha, status, tier, reason, size, posting_date, last_observed, n_refs, n_entities).

    status: prunable, vetoed, absent, orphan, suspended. blobs: store, sha, size. manifests: store, sha, fetch_id, operation, fetched_at, damaged.
    entities: store, key, fetch_id, posted_at, damaged."""
    harm = manifests.where("damaged").select("store").union(entities.where("damaged").select("store")).distinct().withColumn("_harm", F.lit(True))
    refs = manifests.where("sha is not null and not damaged").select("store", "sha", "fetch_id", "operation", "fetched_at")
    # kinds of operations as flags: a collected set of each blob would be sorted and copied row by row
    kinds = {f"_of{i}": F.col("operation") == operation for i, operation in enumerate(tiers)}
    kinds["_untiered"] = ~F.col("operation").isin(*tiers) if tiers else F.col("operation").isNotNull()
    seen = refs.groupBy("store", "sha").agg(
        F.max("fetched_at").alias("last_observed"), F.max(F.lit(True)).alias("_seen"), *[F.coalesce(F.max(c), F.lit(False)).alias(n) for n, c in kinds.items()], F.count_distinct(F.struct("fetch_id", "operation", "fetched_at")).alias("n_refs"), F.min_by("operation", F.struct("fetched_at", "fetch_id", "operation")).alias("_first")
    )
    fed = refs.select("store", "sha", "fetch_id").repartition("store", "fetch_id").distinct().join(entities.where("not damaged").select("store", "fetch_id", "key", "posted_at"), ["store", "fetch_id"])
    fed = fed.groupBy("store", "sha").agg(F.max("posted_at").alias("posting_date"), F.count_distinct("key").alias("n_entities"))
    at = blobs.select("store", "sha", "size", F.lit(True).alias("_here")).join(seen, ["store", "sha"], "full_outer").join(fed, ["store", "sha"], "left").join(harm, "store", "left")
    gone, tier, reason = F.lit(True), F.lit(None).cast("string"), F.lit(NEVER)
    for i, (operation, name) in enumerate(tiers.items()):
        rule = rules.get(name, NEVER)
        gone = gone & (~F.col(f"_of{i}") | compiled(rule, now, name))
        tier, reason = F.when(F.col("_first") == operation, name).otherwise(tier), F.when(F.col("_first") == operation, described(rule)).otherwise(reason)
    status = F.when(F.col("_harm"), "suspended").when(F.col("_seen").isNull(), "orphan").when(F.col("_here").isNull(), "absent").when(gone & ~F.col("_untiered"), "prunable").otherwise("vetoed")
    return at.select("store", "sha", status.alias("status"), tier.alias("tier"), reason.alias("reason"), "size", "posting_date", "last_observed", F.coalesce("n_refs", F.lit(0)).alias("n_refs"), F.coalesce("n_entities", F.lit(0)).alias("n_entities"))


def swept(before: DataFrame, after: DataFrame, orphans: bool = False) -> DataFrame:
    """What of a plan is still to be done once manifests were read again: (store, sha, action), action delete, re_vetoed or blocked."""
    wanted = before.where(F.col("status").isin("prunable", *(["orphan"] if orphans else []))).select("store", "sha", F.col("status").alias("was"))
    now = after.select("store", "sha", F.col("status").alias("is"))
    action = F.when(F.col("is") == "suspended", "blocked").when(F.col("is") == F.col("was"), "delete").otherwise("re_vetoed")
    return wanted.join(now, ["store", "sha"], "left").select("store", "sha", action.alias("action"))


def frozen(actions: DataFrame, manifests: DataFrame, entities: DataFrame) -> DataFrame:
    """Entities whose facts are to be kept before anything is deleted: each once, whichever of its blobs go."""
    going = actions.where("action = 'delete'").select("store", "sha")
    fetches = manifests.join(going, ["store", "sha"], "left_semi").select("store", "fetch_id").distinct()
    return entities.join(fetches, ["store", "fetch_id"], "left_semi").select("store", "key").distinct()
