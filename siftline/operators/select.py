"""Row selection: deduplication, ranking, gates and their accounts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dedupe(df: DataFrame, keys: Sequence[str], score: str, order: str) -> DataFrame:
    """The first row of the greatest score of each key; ``position`` is that of the key's first row."""
    row = F.struct(*df.columns)
    best = df.groupBy(*keys).agg(F.max_by(row, F.struct(score, -F.col(order))).alias("_r"), F.min(order).alias("position"))
    return best.select("_r.*", "position")


def diversify(df: DataFrame, by: Sequence[str], score: str, order: str, cap: int, top: int) -> DataFrame:
    """The ``top`` rows by score of which no group gives more than ``cap``."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), F.asc(order)))
    return df.withColumn("_n", rank).where(F.col("_n") <= cap).drop("_n").orderBy(F.desc(score), F.asc(order)).limit(top)


def disposition(gates: Sequence[tuple[str, Column]], kept: str = "kept") -> Column:
    """Name of the first gate that fails; null conditions fail."""
    out = None
    for name, passes in gates:
        fails = ~F.coalesce(passes, F.lit(False))
        out = F.when(fails, name) if out is None else out.when(fails, name)
    return out.otherwise(kept)


def funnel(df: DataFrame, names: Sequence[str], column: str = "disposition") -> DataFrame:
    """A row for each name, zero included, and the total, which the others sum to."""
    labels = df.sparkSession.createDataFrame([(i, n) for i, n in enumerate(names)], "step int, disposition string")
    counts = df.groupBy(F.col(column).alias("disposition")).agg(F.count("*").alias("n"))
    out = labels.join(counts, "disposition", "left").select("step", "disposition", F.coalesce("n", F.lit(0)).alias("n"))
    return out.union(df.agg(F.lit(len(names)).alias("step"), F.lit("total").alias("disposition"), F.count("*").alias("n")))


def census(df: DataFrame, family: str, key: str, k: int) -> DataFrame:
    """k rows of each family in order of a hash of the key, with the family's size."""
    sizes = df.groupBy(family).agg(F.count("*").alias("family_rows"))
    # Spark keeps k rows of a family in each task before it deals them out
    place = F.row_number().over(Window.partitionBy(family).orderBy(F.sha2(F.col(key).cast("string"), 256), key))
    return df.withColumn("place", place).where(F.col("place") <= k).join(sizes, family)


def sampled_once(df: DataFrame, key: str, combos: Sequence[tuple[str, Column]], each: int, seed: str) -> DataFrame:
    """(combo, key, place): up to ``each`` rows for each combo, in order of the combos and of a seeded hash within each; a row that one combo
    took serves no later one.

    Combos before the n-th take at most (n - 1) * each rows, so its own rows lie among its first n * each: Spark keeps these while it
    reads, and the allocation runs over that list, whose size depends on the combos alone."""
    n = len(combos)
    marks = F.array_compact(F.array(*[F.when(F.coalesce(fits, F.lit(False)), F.struct(F.lit(i).alias("i"), F.sha2(F.concat_ws("|", F.lit(f"{seed}:{i}:{name}"), F.col(key).cast("string")), 256).alias("h"))) for i, (name, fits) in enumerate(combos)]))
    at = df.select(F.col(key).alias("_key"), F.explode(marks).alias("m")).select("_key", "m.i", "m.h").distinct()
    nth = F.row_number().over(Window.partitionBy("i").orderBy("h", "_key"))
    at = at.withColumn("_n", nth).where(F.col("_n") <= n * each).where(F.col("_n") <= (F.col("i") + 1) * each)
    kind = df.schema[key].dataType.simpleString()
    listed = at.groupBy().agg(F.array_sort(F.collect_list(F.struct("i", "_n", "_key"))).alias("l"))
    start = F.array().cast(f"array<struct<i:int,key:{kind}>>")

    def allot(taken: Column, x: Column) -> Column:
        free = ~F.exists(taken, lambda t: t.key.eqNullSafe(x["_key"])) & (F.size(F.filter(taken, lambda t: t.i == x.i)) < each)
        return F.when(free, F.concat(taken, F.array(F.struct(x.i.alias("i"), x["_key"].alias("key"))))).otherwise(taken)

    names = F.array(*[F.lit(name) for name, _ in combos])
    picked = listed.select(F.posexplode(F.aggregate("l", start, allot)).alias("pos", "t"))
    place = F.row_number().over(Window.partitionBy("i").orderBy("pos"))
    return picked.select("pos", "t.i", F.col("t.key").alias(key)).withColumn("place", place).select(F.get(names, F.col("i")).alias("combo"), key, "place")


#: Flags of a tracker filter: membership in a list, a part of the text from a list, and bounds.
MEMBERS, PARTS = ("status", "phase", "progress_state", "workplace", "sponsorship", "fit"), ("company", "role", "location", "slug", "channel")
BOUNDS = ("min_level", "max_level", "min_salary", "max_yoe", "posted_after", "since")


def matching(flags: dict) -> Column:
    """One column for all active flags: AND across flags, OR within a list, case aside. Unknown levels, pay and dates fail their bound, unknown
    years pass theirs. A level range has to overlap the wanted one; pay counts by its upper end, or else its lower. Columns that
    compare to a value reach the scan. ValueError for a flag that there is not."""
    if unknown := set(flags) - {*MEMBERS, *PARTS, *BOUNDS}:
        raise ValueError(f"no such flag: {sorted(unknown)}")
    given = {k: v for k, v in flags.items() if v is not None}
    out = F.lit(True)
    for name in MEMBERS:
        if name in given:
            out &= F.coalesce(F.lower(name).isin([v.lower() for v in given[name]]), F.lit(False))
    for name in PARTS:
        if name in given:
            hit = F.lit(False)
            for v in given[name]:
                hit |= F.coalesce(F.contains(F.lower(name), F.lit(v.lower())), F.lit(False))
            out &= hit
    if "min_level" in given or "max_level" in given:
        out &= F.col("level_min").isNotNull() | F.col("level_max").isNotNull()
        if "min_level" in given:
            out &= F.coalesce(F.col("level_max") >= given["min_level"], F.lit(True))
        if "max_level" in given:
            out &= F.coalesce(F.col("level_min") <= given["max_level"], F.lit(True))
    if "min_salary" in given:
        out &= F.coalesce(F.coalesce("salary_max", "salary_min") >= given["min_salary"], F.lit(False))
    if "max_yoe" in given:
        out &= F.coalesce(F.col("yoe_min") <= given["max_yoe"], F.lit(True))
    for name, column in (("posted_after", "posted"), ("since", "researched")):
        if name in given:
            out &= F.coalesce(F.col(column) >= F.lit(given[name]).cast("date"), F.lit(False))
    return out
