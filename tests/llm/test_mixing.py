"""op10 against a plain recursion over the tree and a plain order of hashes."""

import hashlib
import random

from siftline.llm import mixing

SEED = 20
TREE = ["domain", "lang", "source"]
WEIGHTS = {"domain": {"a": 3, "b": 1}, "lang": {"x": 2, "y": 0, "*": 1}, "source": {"*": 1}}


def split(pool, nodes):
    """nodes: name -> (weight, capacity); shares by weight, what one cannot supply goes to the others."""
    budget, left, open_ = {}, pool, {k: v for k, v in nodes.items() if v[0] > 0}
    budget = {k: 0 for k in nodes}
    for k in sorted(open_, key=lambda k: (open_[k][1] / open_[k][0], k)):
        total = sum(w for j, (w, _) in open_.items() if j not in done_of(budget, k, open_))
        w, c = open_[k]
        if c * total >= w * left:
            for j, (v, d) in open_.items():
                if j not in done_of(budget, k, open_):
                    budget[j] = min(d, v * left // total)
            return budget
        budget[k] = c
        left = max(0, left - c)
    return budget


def done_of(budget, k, open_):
    order = sorted(open_, key=lambda j: (open_[j][1] / open_[j][0], j))
    return set(order[: order.index(k)])


def key(doc, epoch):
    return hashlib.md5(f"{SEED}|{epoch}|{'' if doc is None else doc}".encode()).hexdigest()


def brute(rows, share, epochs):
    leaves = {}
    for doc, *path, n in rows:
        leaves.setdefault(tuple(path), []).append((doc, n))
    size = {p: sum(n for _, n in v) for p, v in leaves.items()}
    pools = {(): sum(size.values()) * share[0] // share[1]}
    for depth in range(1, 4):
        nxt = {}
        for parent, pool in pools.items():
            names = {p[:depth] for p in size if p[: depth - 1] == parent}
            of = WEIGHTS[TREE[depth - 1]]
            nxt |= split(pool, {c: (of.get(c[-1], of.get("*", 1)), epochs * sum(n for p, n in size.items() if p[:depth] == c)) for c in names})
        pools = nxt
    out = []
    for p, docs in leaves.items():
        whole, rest = divmod(pools[p], size[p]) if size[p] else (0, 0)
        out += [(d, *p, e) for d, _ in docs for e in range(whole)]
        run = 0
        if rest:
            threshold = None
            for d, n in sorted(docs, key=lambda x: key(x[0], whole)):
                run += n
                if run > rest:
                    break
                threshold = key(d, whole)
            out += [(d, *p, whole) for d, _ in docs if threshold is not None and key(d, whole) <= threshold]
    return sorted(out)


def test_equals_recursion(spark):
    for seed in range(1):
        rnd = random.Random(seed)
        rows = [(i, rnd.choice("aab"), rnd.choice("xxxyz"), rnd.choice("stu"), rnd.randrange(0, 50)) for i in range(300)]
        rows += [(1000 + i, "c", "x", "only", rnd.randrange(5)) for i in range(5)]
        df = spark.createDataFrame(rows, "doc_id long, domain string, lang string, source string, n_tokens long")
        for share, epochs in (((3, 5), 2), ((1, 1), 1), ((1, 7), 1), ((3, 2), 3)):
            plan = mixing.leaf_plan(df, TREE, WEIGHTS, share, epochs, SEED, "doc_id")
            got = sorted((r.doc_id, r.domain, r.lang, r.source, r.epoch) for r in mixing.picked(df, plan, TREE, SEED, "doc_id").collect())
            assert got == brute(rows, share, epochs)
            tokens = {r[0]: r[4] for r in rows}
            assert sum(tokens[g[0]] for g in got) <= sum(tokens.values()) * share[0] // share[1]


def test_large_leaf_uses_buckets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "ROWS_IN_BUCKET", 4)
    rows = [(i, "a", "x", "s", i % 9) for i in range(700)]
    df = spark.createDataFrame(rows, "doc_id long, domain string, lang string, source string, n_tokens long")
    plan = mixing.leaf_plan(df, TREE, WEIGHTS, (2, 5), 1, SEED, "doc_id")
    got = sorted((r.doc_id, r.domain, r.lang, r.source, r.epoch) for r in mixing.picked(df, plan, TREE, SEED, "doc_id").collect())
    assert got == brute(rows, (2, 5), 1)


def test_null_ids_clashing_columns_and_empty_table(spark):
    rows = [(None, "a", "x", "s", 5, "k", 9), (3, "a", "x", "s", 5, "l", 9), (3, "a", "x", "s", 5, "m", 9)]
    df = spark.createDataFrame(rows, "doc_id long, domain string, lang string, source string, n_tokens long, threshold string, epoch int")
    plan = mixing.leaf_plan(df, TREE, WEIGHTS, (1, 1), 1, SEED, "doc_id")
    got = mixing.picked(df, plan, TREE, SEED, "doc_id")
    assert got.columns == df.columns and sorted(r.threshold for r in got.collect()) == ["k", "l", "m"]
    plan = mixing.leaf_plan(df.limit(0), TREE, WEIGHTS, (1, 1), 1, SEED, "doc_id")
    assert mixing.picked(df.limit(0), plan, TREE, SEED, "doc_id").count() == 0
