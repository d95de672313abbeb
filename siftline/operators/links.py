"""Joins of the library: aliases, anti-joins, ladders and dimension matches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def considered(df: DataFrame, seen: DataFrame, *key_sets: Sequence[str]) -> DataFrame:
    """Rows that no key set finds in ``seen``: one anti-join for each, never one with OR."""
    for keys in key_sets:
        df = df.join(seen.select(*keys).distinct(), list(keys), "left_anti")
    return df


def resolve_alias(df: DataFrame, name: Column, aliases: DataFrame) -> DataFrame:
    """``canonical`` by alias; one that several companies own gives none. aliases: (alias, canonical)."""
    sole = aliases.groupBy("alias").agg(F.min("canonical").alias("canonical"), F.count_distinct("canonical").alias("_n")).where("_n = 1").drop("_n")
    return df.withColumn("_alias", name).join(sole.withColumnRenamed("alias", "_alias"), "_alias", "left").drop("_alias")


def longest_pattern(df: DataFrame, column: str, patterns: Sequence[str]) -> Column:
    """The longest of the patterns that a column has; the first of equal ones."""
    order = sorted(enumerate(patterns), key=lambda x: (-len(x[1]), x[0]))
    return F.coalesce(*[F.when(F.contains(F.lower(F.col(column)), F.lit(p)), F.lit(p)) for _, p in order])


def provenance_winner(facts: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """The value of override first, then the lowest tier, the latest date and the first in order."""
    place = F.struct(F.col("override").cast("int"), -F.col("tier"), F.col("dated"), -F.col("ord"))
    return facts.groupBy(*by).agg(F.max_by(value, place).alias(value), F.count("*").alias("candidates"))


def needs_reply(messages: DataFrame, thread: str, turn: str, inbound: Column) -> DataFrame:
    """Threads whose last inbound message has no outbound one after it: two grouped maxima, no range join."""
    last = messages.groupBy(thread).agg(F.max(F.when(inbound, F.col(turn))).alias("last_in"), F.max(F.when(~inbound, F.col(turn))).alias("last_out"))
    return last.where(F.col("last_in").isNotNull() & (F.col("last_out").isNull() | (F.col("last_out") < F.col("last_in"))))


def sole_match(df: DataFrame, on: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """``name``: the value that the keys find if it is the only one. A rung of a ladder."""
    one = on.groupBy(*keys).agg(F.min(value).alias(name), F.count_distinct(value).alias("_n")).where("_n = 1").drop("_n")
    return df.join(one, list(keys), "left")


def full_outer_counts(a: DataFrame, b: DataFrame, key: str, names: tuple[str, str]) -> DataFrame:
    x, y = (d.groupBy(key).agg(F.count("*").alias(n)) for d, n in zip((a, b), names))
    return x.join(y, key, "full_outer").select(key, *[F.coalesce(n, F.lit(0)).alias(n) for n in names])
