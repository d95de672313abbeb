"""Several syncs in a row against plain sets."""

import random

from pyspark.sql import functions as F

from siftline.operators import mailsync as M

MESSAGES, LISTING = "account string, key string, provider_id string, folder string, at long, deleted boolean, in_scope boolean", "account string, folder string, key string, provider_id string, at long"
FOLDERS = ["archive", "inbox", "sent"]


def plain(messages, inventory, modes, listing, removed, readable, cutoff):
    within = lambda at: cutoff is None or at is None or at >= cutoff
    by = {f: {(a, k): (p, t) for a, g, k, p, t in listing if g == f and within(t)} for f in FOLDERS}
    seen = {x for f in FOLDERS for x in by[f]}
    away = set()
    for (a, f), mode in modes.items():
        if mode == "full":
            away |= {(a, k) for b, g, k in inventory if (b, g) == (a, f) and (a, k) not in by[f] and (a, k) in messages and within(messages[a, k][2])}
    away |= {key for key, m in messages.items() if (key[0], m[0]) in removed}
    away -= seen
    out = {}
    for key in set(messages) | seen:
        if key in seen:
            f = min(f for f in FOLDERS if key in by[f])
            out[key] = (by[f][key][0], f, by[f][key][1], False, True, "upserted")
        elif key in away:
            there = (key[0], messages[key][0]) in readable
            out[key] = (messages[key][0], None, messages[key][2], not there, False, "out_of_scope" if there else "tombstoned")
        else:
            out[key] = (*messages[key][:5], "kept")
    inv = {(a, f, k) for f in FOLDERS for a, k in by[f]}
    inv |= {(a, f, k) for a, f, k in inventory if modes.get((a, f)) == "delta" and (a, k) not in seen and (a, k) not in away}
    return out, inv


def test_many_syncs(spark):
    rnd = random.Random(3)
    box = {(a, f"k{i}"): [f"p{i}", rnd.choice(FOLDERS), rnd.choice([None, *range(100)])] for a in ("x", "y") for i in range(30)}  # what the provider has
    messages, inventory, token, outcomes = {}, set(), {}, set()
    for step in range(6):
        cutoff = 30 if step in (2, 4) else None
        expired = {("x", "inbox")} if step == 3 else set()
        folders = [(a, f, token.get((a, f)), 1, (a, f) in expired) for a in ("x", "y") for f in FOLDERS]
        modes = {(r.account, r.folder): r.mode for r in M.modes(spark.createDataFrame(folders, "account string, folder string, token string, fields int, expired boolean"), 1, force=step == 4).collect()}
        assert set(modes.values()) == ({"full"} if step in (0, 4) else {"delta", "full"} if step == 3 else {"delta"})
        changed, gone = set(), set()
        for key in list(box):
            if step and rnd.random() < 0.15:
                gone.add((key[0], box.pop(key)[0]))
            elif rnd.random() < 0.25:
                box[key][1] = rnd.choice([*FOLDERS, "elsewhere"])
                changed.add(key)
        listing = [(a, f, k, p, t) for (a, k), (p, f, t) in box.items() if f in FOLDERS and (modes[a, f] == "full" or (a, k) in changed)]
        moved = {(a, p) for (a, k), (p, f, t) in box.items() if f == "elsewhere" and (a, k) in changed}
        removed = {x for x in gone | moved if rnd.random() < 0.8}
        readable = {(a, p) for (a, _), (p, _, _) in box.items()}
        table = spark.createDataFrame([(*k, *v[:5]) for k, v in messages.items()], MESSAGES)
        after, inv = M.synced(
            table, spark.createDataFrame(sorted(inventory), "account string, folder string, key string"), spark.createDataFrame([(*k, v) for k, v in modes.items()], "account string, folder string, mode string"),
            spark.createDataFrame(listing + listing[:3], LISTING), spark.createDataFrame(sorted(removed), "account string, provider_id string"), spark.createDataFrame(sorted(readable), "account string, provider_id string"),
            None if cutoff is None else F.lit(cutoff),
        )
        want, want_inv = plain(messages, inventory, modes, listing, removed, readable, cutoff)
        assert {(r.account, r.key): tuple(r)[2:] for r in after.collect()} == want, step
        assert {tuple(r) for r in inv.collect()} == want_inv and inv.count() == len(want_inv), step
        messages, inventory, token = {k: v[:5] for k, v in want.items()}, want_inv, {k: "t" for k in modes}
        outcomes |= {v[5] for v in want.values()}
    assert outcomes == {"upserted", "kept", "tombstoned", "out_of_scope"}


def test_staleness(spark):
    rows = [("a", "never", None, 5, 5, 0), ("a", "nomark", True, None, 5, 0), ("a", "empty", True, 5, None, 0), ("a", "emptied", True, None, None, 3), ("a", "behind", True, 5, 70, 1), ("a", "fine", True, 5, 65, 1), ("a", "quiet", True, None, None, 0)]
    got = M.stale(spark.createDataFrame(rows, "account string, folder string, synced boolean, stored_at long, live_at long, held int"), 60)
    assert {r.folder: r.reason for r in got.collect()} == {"never": "never synced", "nomark": "no watermark", "empty": "provider is empty", "emptied": "provider is empty", "behind": "provider is newer", "fine": None, "quiet": None}
