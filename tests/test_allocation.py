"""Attribution to phases, availability by the clock, samples that share no row: each against plain loops."""

import datetime as dt
import hashlib
import random
from zoneinfo import ZoneInfo

from pyspark.sql import functions as F

from siftline.operators import intervals, select

LABELS = ["external", "local"]


def test_attribution_sums_to_the_phase(spark):
    rnd = random.Random(4)
    segments, phases, want = [], [], {}
    for run in range(5):
        t = 0
        for _ in range(60):
            n = rnd.randrange(1, 9000)
            segments.append((run, t, t + n, rnd.choice([*LABELS, "other"])))
            t += n
        at = rnd.randrange(500)
        while at < t - 5000:
            n = rnd.randrange(0, 40000)
            phases.append((run, rnd.choice("pqr"), rnd.choice(["x", None]), at, at + n))
            at += n + rnd.choice([0, 700])
    for run, p, role, b, f in phases:
        row = want.setdefault((run, p, role), [0, 0, dict.fromkeys(LABELS, 0)])
        row[0], row[1] = row[0] + 1, row[1] + f - b
        for r, s, e, label in segments:
            if r == run and label in LABELS:
                row[2][label] += max(0, min(e, f) - max(s, b))
    got = intervals.attributed(
        spark.createDataFrame(segments, "run int, s long, e long, label string"), spark.createDataFrame(phases, "run int, phase string, role string, s long, e long").na.fill("-", ["role"]),
        "run", "s", "e", "label", ["phase", "role"], LABELS, "active", 7000, 100,
    ).collect()
    assert len(got) == len(want)
    for r in got:
        n, elapsed, parts = want[r.run, r.phase, None if r.role == "-" else r.role]
        parts = {**parts, "active": elapsed - sum(parts.values())}
        down = {x: v // 100 for x, v in parts.items()}
        for x in sorted(parts, key=lambda x: (-(parts[x] % 100), x))[: elapsed // 100 - sum(down.values())]:
            down[x] += 1
        assert (r.occurrences, r.elapsed, {x: r[x] for x in parts}) == (n, elapsed // 100, down)
        assert r.elapsed == r.external + r.local + r.active


def test_availability_by_the_clock(spark):
    rnd = random.Random(2)
    zones = {"a": "America/New_York", "b": "Europe/Berlin", "c": "Asia/Kolkata", "d": "UTC"}
    today = dt.date(2024, 3, 7)  # a Thursday; clocks change in New York on the Sunday after
    busy = []
    for who in "abc":
        for _ in range(25):
            s = int(dt.datetime(2024, 3, 7, tzinfo=dt.timezone.utc).timestamp()) + rnd.randrange(7 * 86400)
            busy.append((who, s, s + rnd.randrange(0, 20000)))
    busy += [("a", None, 5), ("a", 5, None)]
    want = set()
    for who, zone in zones.items():
        days = [d for k in range(1, 20) if (d := today + dt.timedelta(days=k)).weekday() < 5][:4]
        for day in days:
            at = lambda h: int(dt.datetime.combine(day, dt.time(h, 30), tzinfo=ZoneInfo(zone)).timestamp())
            opens, closes = at(9), at(17)
            parts = sorted((max(s - 900, opens), min(e + 900, closes)) for w, s, e in busy if w == who and s and e and e + 900 > opens and s - 900 < closes)
            cursor = opens
            for s, e in [*parts, (closes, closes)]:
                if s - cursor >= 1800:
                    want.add((who, day, cursor, s))
                cursor = max(cursor, e)
    people = spark.createDataFrame([(w, today, z) for w, z in zones.items()], "who string, today date, zone string")
    days = intervals.workdays(people, "today", "zone", [0, 1, 2, 3, 4], 4, "09:30", "17:30")
    got = intervals.availability(spark.createDataFrame(busy, "who string, s long, e long"), days, "who", "s", "e", 900, 1800)
    assert {tuple(r) for r in got.select("who", "date", "free_from", "free_to").collect()} == want
    assert len([w for w in want if w[0] == "d"]) == 4  # nothing busy: whole days


def test_samples_share_no_row(spark):
    rows = [(k, k % 2, k % 3) for k in range(60)] + [(3, 1, 0)] * 3
    df = spark.createDataFrame(rows, "id long, a int, b int")
    combos = [("even", F.col("a") == 0), ("all", F.lit(True)), ("third", F.col("b") == 0), ("none", F.col("a") == 9), ("few", F.col("id") < 7)]
    fits = {"even": lambda r: r[1] == 0, "all": lambda r: True, "third": lambda r: r[2] == 0, "none": lambda r: False, "few": lambda r: r[0] < 7}
    taken, want = set(), []
    for i, (name, _) in enumerate(combos):
        order = sorted({r[0] for r in rows if fits[name](r)}, key=lambda k: (hashlib.sha256(f"9:{i}:{name}|{k}".encode()).hexdigest(), k))
        mine = [k for k in order if k not in taken][:10]
        taken |= set(mine)
        want += [(name, k, n) for n, k in enumerate(mine, 1)]
    got = [tuple(r) for r in select.sampled_once(df, "id", combos, 10, "9").collect()]
    assert sorted(got) == sorted(want) and len({g[1] for g in got}) == len(got)
    assert select.sampled_once(df.limit(0), "id", combos, 10, "9").collect() == []
