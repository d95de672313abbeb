"""The rule language and the plan against a plain evaluation."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from siftline.operators import retention as R

NOW = dt.datetime(2026, 1, 1)
TIERS = {"fetch": "board", "search": "board", "mail": "mail", "note": "human"}
RULES = {"board": {"any_of": [{"posting_older_than_days": 90}, {"all_of": [{"observed_older_than_days": 30}, {"posting_older_than_days": 10}]}]}, "mail": {"observed_older_than_days": 60}, "human": "never"}


def holds(rule, posting, observed):
    if rule == "never":
        return False
    (key, value), = rule.items()
    if key == "all_of":
        return all(holds(r, posting, observed) for r in value)
    if key == "any_of":
        return any(holds(r, posting, observed) for r in value)
    date = posting if key.startswith("posting") else observed
    return date is not None and NOW - date > dt.timedelta(days=value)


def brute(blobs, manifests, entities):
    harmed = {m[0] for m in manifests if m[5]} | {e[0] for e in entities if e[4]}
    out = {}
    for key in {b[:2] for b in blobs} | {m[:2] for m in manifests if m[1] and not m[5]}:
        refs = {m for m in manifests if m[:2] == key and not m[5]}
        ops = {m[3] for m in refs}
        fetches = {m[2] for m in refs}
        dates = [e[3] for e in entities if e[0] == key[0] and e[2] in fetches and not e[4] and e[3]]
        observed = max((m[4] for m in refs if m[4]), default=None)
        here = key in {b[:2] for b in blobs}
        ok = all(holds(RULES.get(TIERS.get(o), "never"), max(dates, default=None), observed) for o in ops)
        out[key] = "suspended" if key[0] in harmed else "orphan" if not refs else "absent" if not here else "prunable" if ok else "vetoed"
    return out


def frames(spark, blobs, manifests, entities):
    return (
        spark.createDataFrame(blobs, "store int, sha string, size long"),
        spark.createDataFrame(manifests, "store int, sha string, fetch_id int, operation string, fetched_at timestamp_ntz, damaged boolean"),
        spark.createDataFrame(entities, "store int, key string, fetch_id int, posted_at timestamp_ntz, damaged boolean"),
    )


def world(seed):
    rnd = random.Random(seed)
    day = lambda: None if rnd.random() < 0.1 else NOW - dt.timedelta(days=rnd.randrange(0, 150))
    manifests = [(rnd.randrange(4), f"b{rnd.randrange(60)}", k, rnd.choice(["fetch"] * 5 + ["search", "mail", "note", "other"]), day(), False) for k in range(200)]
    manifests += manifests[:5] + [(3, "b1", 999, "fetch", day(), True)]
    entities = [(rnd.randrange(3), f"e{k % 50}", k, day(), False) for k in range(150)] + [(2, "bad", 5, None, True)]
    blobs = [(s, f"b{k}", k * 10) for s in range(4) for k in range(70) if rnd.random() < 0.8]
    return blobs, manifests, entities


def test_equals_plain_evaluation(spark):
    kinds = set()
    for seed in range(3):
        at = world(seed)
        got = R.plan(*frames(spark, *at), TIERS, RULES, F.lit(NOW).cast("timestamp_ntz")).collect()
        assert {(r.store, r.sha): r.status for r in got} == brute(*at) and len(got) == len({(r.store, r.sha) for r in got})
        kinds |= {r.status for r in got}
    assert kinds == {"prunable", "vetoed", "absent", "orphan", "suspended"}


def test_sweep_reads_references_again(spark):
    day = lambda n: NOW - dt.timedelta(days=n)
    blobs = [(1, "a", 1), (1, "b", 1), (1, "c", 1)]
    manifests = [(1, "a", 1, "fetch", day(99), False), (1, "b", 2, "fetch", day(99), False)]
    entities = [(1, "e1", 1, day(120), False), (1, "e1", 2, day(120), False), (1, "e2", 2, day(120), False)]
    now = F.lit(NOW).cast("timestamp_ntz")
    b, m, e = frames(spark, blobs, manifests, entities)
    later = frames(spark, blobs, manifests + [(1, "b", 3, "note", day(0), False), (1, "c", 4, "fetch", day(0), False)], entities)[1]
    before, after = R.plan(b, m, e, TIERS, RULES, now), R.plan(b, later, e, TIERS, RULES, now)
    actions = R.swept(before, after, orphans=True)
    assert {tuple(r) for r in actions.collect()} == {(1, "a", "delete"), (1, "b", "re_vetoed"), (1, "c", "re_vetoed")}
    assert [tuple(r) for r in R.frozen(actions, m, e).collect()] == [(1, "e1")]
    harmed = frames(spark, blobs, manifests + [(1, None, 9, "fetch", None, True)], entities)[1]
    assert {r.action for r in R.swept(before, R.plan(b, harmed, e, TIERS, RULES, now)).collect()} == {"blocked"}


@pytest.mark.parametrize("rule", ["always", {}, {"all_of": []}, {"all_of": [], "any_of": []}, {"age": 3}, {"observed_older_than_days": -1}, {"observed_older_than_days": True}, {"any_of": [{"x": 1}]}, 5])
def test_wrong_rules(spark, rule):
    with pytest.raises(ValueError):
        R.compiled(rule, F.lit(NOW))


def test_description():
    assert R.described(RULES["board"]) == "(posting date older than 90d OR (last observed older than 30d AND posting date older than 10d))"
