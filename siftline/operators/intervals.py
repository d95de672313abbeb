"""Interval and session analytics over (begin, finish) columns of whole seconds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def sessions(df: DataFrame, by: str, at: str, tie: str, idle: int) -> DataFrame:
    """``session`` counts the gaps of more than ``idle`` seconds before each row."""
    w = Window.partitionBy(by).orderBy(at, tie)
    new = (F.col(at) - F.lag(at).over(w) > idle).cast("int")
    return df.withColumn("session", F.sum(F.coalesce(new, F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def running_clock(df: DataFrame, by: str, at: str, tie: str, most: int) -> DataFrame:
    """Sum of the steps so far, each at least 0 and at most ``most``."""
    w = Window.partitionBy(by).orderBy(at, tie)
    step = F.least(F.greatest(F.coalesce(F.col(at) - F.lag(at).over(w), F.lit(0)), F.lit(0)), F.lit(most))
    return df.withColumn("_step", step).withColumn("clock", F.sum("_step").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_step")


def merged(df: DataFrame, by: Sequence[str], begin: str, finish: str) -> DataFrame:
    """Overlapping or touching intervals as one."""
    w = Window.partitionBy(*by).orderBy(begin, finish)
    before = F.max(finish).over(w.rowsBetween(Window.unboundedPreceding, -1))
    at = df.withColumn("_new", F.coalesce((F.col(begin) > before).cast("int"), F.lit(1)))
    at = at.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return at.groupBy(*by, "_island").agg(F.min(begin).alias(begin), F.max(finish).alias(finish), F.count("*").alias("parts")).drop("_island")


def free_windows(busy: DataFrame, by: Sequence[str], begin: str, finish: str, least: int) -> DataFrame:
    """Gaps of at least ``least`` between merged intervals."""
    w = Window.partitionBy(*by).orderBy(begin)
    gaps = merged(busy, by, begin, finish).withColumn("_next", F.lead(begin).over(w))
    return gaps.where(F.col("_next") - F.col(finish) >= least).select(*by, F.col(finish).alias("free_from"), F.col("_next").alias("free_to"))


def conflicts(df: DataFrame, by: Sequence[str], key: str, begin: str, finish: str, bucket: int) -> DataFrame:
    """Pairs that overlap, found in buckets of time; each pair comes from the bucket in which its overlap begins."""
    span = F.sequence(F.floor(F.col(begin) / bucket), F.floor((F.greatest(F.col(finish) - 1, F.col(begin))) / bucket))
    at = df.select(*by, F.col(key).alias("a"), F.col(begin).alias("s"), F.col(finish).alias("e"), F.explode(span).alias("bucket"))
    other = at.select(*by, F.col("a").alias("b"), F.col("s").alias("s2"), F.col("e").alias("e2"), "bucket")
    first = F.floor(F.greatest("s", "s2") / bucket) == F.col("bucket")
    return at.join(other, [*by, "bucket"]).where((F.col("a") < F.col("b")) & (F.col("s") < F.col("e2")) & (F.col("s2") < F.col("e")) & first).select(*by, "a", "b")


def tiling(df: DataFrame, by: str, begin: str, finish: str, rank: str, ranks: Sequence[int] | None = None) -> DataFrame:
    """Elementary segments between all bounds, each with the least rank that covers it (null: none). Where all ``ranks`` are named, their running
    sums stand side by side, and each interval moves once, as two bounds."""
    if ranks is not None:
        ends = F.array(F.struct(F.col(begin).alias("t"), F.lit(1).alias("step")), F.struct(F.col(finish).alias("t"), F.lit(-1).alias("step")))
        each = df.select(by, F.col(rank).alias("_rank"), F.explode(ends).alias("_end")).select(by, "_rank", "_end.t", "_end.step").repartition(by)
        names = {r: f"_open{i}" for i, r in enumerate(sorted(ranks))}
        steps = each.groupBy(by, "t").agg(*[F.sum(F.when(F.col("_rank") == r, F.col("step")).otherwise(0)).alias(n) for r, n in names.items()])
        ordered = Window.partitionBy(by).orderBy("t")
        so_far = ordered.rowsBetween(Window.unboundedPreceding, 0)
        at = steps.select(by, "t", F.lead("t").over(ordered).alias("t2"), *[F.sum(n).over(so_far).alias(n) for n in names.values()]).where("t2 is not null")
        least = F.coalesce(*[F.when(F.col(n) > 0, F.lit(r)) for r, n in names.items()])
        return at.select(by, "t", "t2", least.cast(df.schema[rank].dataType).alias("rank"))
    bounds = df.select(by, F.col(begin).alias("t")).union(df.select(by, F.col(finish).alias("t"))).distinct()
    segments = bounds.withColumn("t2", F.lead("t").over(Window.partitionBy(by).orderBy("t"))).where("t2 is not null")
    # open claims of each rank at each bound, by running sums: ranks are few, claims may be many
    steps = df.select(by, F.col(begin).alias("t"), F.lit(1).alias("step"), rank).union(df.select(by, F.col(finish), F.lit(-1), rank)).groupBy(by, "t", rank).agg(F.sum("step").alias("step"))
    levels = df.select(by, rank).distinct()
    open_at = segments.join(levels, by).join(steps, [by, "t", rank], "left")
    running = F.sum(F.coalesce("step", F.lit(0))).over(Window.partitionBy(by, rank).orderBy("t").rowsBetween(Window.unboundedPreceding, 0))
    best = open_at.withColumn("_open", running).groupBy(by, "t", "t2").agg(F.min(F.when(F.col("_open") > 0, F.col(rank))).alias("rank"))
    return best


def attributed(segments: DataFrame, phases: DataFrame, by: str, begin: str, finish: str, label: str, groups: Sequence[str], labels: Sequence[str], rest: str, bucket: int, unit: int) -> DataFrame:
    """A row for each group of phases of a run: occurrences, elapsed, the time of each of ``labels`` and ``rest``, in whole ``unit``\\ s that sum to
    ``elapsed``: what rounding down leaves goes to the largest remainders, the first by name among equal ones.

    Phases of a run do not overlap. Segments tile a run; both are cut at multiples of ``bucket`` and joined there, so a run of any length
    splits, and a part is counted where it lies and nowhere else."""
    cut = F.sequence(F.floor(F.col(begin) / bucket), F.floor(F.greatest(F.col(finish) - 1, F.col(begin)) / bucket))
    a = segments.where(F.col(label).isin(*labels)).select(by, F.col(begin).alias("_s"), F.col(finish).alias("_e"), label, F.explode(cut).alias("_cell"))
    b = phases.select(by, *groups, F.col(begin).alias("_b"), F.col(finish).alias("_f"), F.explode(cut).alias("_cell"))
    low, high = F.greatest("_s", "_b", F.col("_cell") * bucket), F.least("_e", "_f", (F.col("_cell") + 1) * bucket)
    shares = b.join(a, [by, "_cell"]).where(low < high).groupBy(by, *groups).agg(*[F.sum(F.when(F.col(label) == x, high - low).otherwise(0)).alias(x) for x in labels])
    whole = phases.groupBy(by, *groups).agg(F.count("*").alias("occurrences"), F.sum(F.col(finish) - F.col(begin)).alias("elapsed"))
    at = whole.join(shares, [by, *groups], "left").na.fill(0, list(labels))
    at = at.withColumn(rest, F.col("elapsed") - sum((F.col(x) for x in labels), F.lit(0)))
    names = [*labels, rest]
    down = {x: F.floor(F.col(x) / unit) for x in names}
    left = F.floor(F.col("elapsed") / unit) - sum(down.values(), F.lit(0))
    order = F.array_sort(F.array(*[F.struct((-F.pmod(x, F.lit(unit))).alias("r"), F.lit(x).alias("x")) for x in names]))
    at = at.withColumn("_more", F.transform(F.slice(order, F.lit(1), F.greatest(left.cast("int"), F.lit(0))), lambda o: o.x))
    return at.select(by, *groups, "occurrences", F.floor(F.col("elapsed") / unit).alias("elapsed"), *[(down[x] + F.array_contains("_more", x).cast("int")).alias(x) for x in names])


def workdays(people: DataFrame, day: str, zone: str, weekdays: Sequence[int], count: int, opens: str, closes: str) -> DataFrame:
    """``people`` with a row for each of the next ``count`` working days after ``day`` (Monday is 0): date, and opens and closes as seconds,
    by the clock of ``zone`` (a column of zone names)."""
    ahead = F.sequence(F.date_add(F.col(day), 1), F.date_add(F.col(day), 7 * count))
    days = F.slice(F.filter(ahead, lambda x: F.weekday(x).isin(*weekdays)), F.lit(1), F.lit(count))
    local = lambda clock: F.unix_seconds(F.convert_timezone(F.col(zone), F.lit("UTC"), F.to_timestamp_ntz(F.concat(F.col("date").cast("string"), F.lit(f" {clock}:00")))).cast("timestamp"))
    return people.withColumn("date", F.explode(days)).withColumns({"opens": local(opens), "closes": local(closes)})


def availability(busy: DataFrame, days: DataFrame, by: str, begin: str, finish: str, buffer: int, least: int) -> DataFrame:
    """Free windows of at least ``least`` seconds within each working day, ``buffer`` before and after what is busy: days without anything busy are
    free from end to end. A day has a marker at both of its ends, so its gaps are those between merged intervals."""
    edges = days.select(by, "date", F.col("opens").alias(begin), F.col("opens").alias(finish)).union(days.select(by, "date", "closes", "closes"))
    padded = busy.where(F.col(begin).isNotNull() & F.col(finish).isNotNull()).select(by, (F.col(begin) - buffer).alias("_s"), (F.col(finish) + buffer).alias("_e"))
    inside = padded.join(days.select(by, "date", "opens", "closes"), by).where("_e > opens and _s < closes")
    clipped = inside.select(by, "date", F.greatest("_s", "opens").alias(begin), F.least("_e", "closes").alias(finish))
    return free_windows(clipped.unionByName(edges), [by, "date"], begin, finish, least)
