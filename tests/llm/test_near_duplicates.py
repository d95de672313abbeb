"""op6 against all pairs by brute force."""

import itertools
import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from siftline.llm import near_duplicates as nd
from siftline.llm.components import components


def shingles(text, size):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return frozenset()
    return frozenset([tuple(w)] if len(w) < size else [tuple(w[i : i + size]) for i in range(len(w) - size + 1)])


def brute(rows, size, percent):
    sets = {}
    for i, t in rows:
        sets.setdefault(i, []).append(shingles(t, size))
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in itertools.combinations(sets, 2):
        for x, y in itertools.product(sets[a], sets[b]):
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((root(a), root(b)))
                up[q] = p
    return sorted((i, len(shingles(t, size)), root(i), root(i) == i) for i, t in rows)


def corpus(seed, n, n_words):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, texts = [], []
    for i in range(n):
        if texts and rnd.random() < 0.6:
            w = rnd.choice(texts)[:]
            for _ in range(rnd.randrange(0, max(2, len(w) // 8))):
                w[rnd.randrange(len(w))] = rnd.choice(vocabulary)
        else:
            w = [rnd.choice(vocabulary) for _ in range(rnd.randrange(1, n_words))]
        texts.append(w)
        rows.append((i * 7 % n, " ".join(x.upper() if rnd.random() < 0.1 else x for x in w)))
    return rows


def test_equals_all_pairs(spark):
    for size, percent, n_words in ((2, 80, 60), (5, 80, 200)):
        rows = corpus(size, 160, n_words) + [(900, None), (901, ""), (902, " \t\n"), (903, "One"), (904, "one"), (905, "  a"), (906, "a ")]
        df = spark.createDataFrame(rows, "doc_id long, text string")
        got = nd.near_duplicates(df, size, percent)
        assert sorted(map(tuple, got.collect())) == brute(rows, size, percent)


def test_many_pairs_just_under_the_threshold_in_one_bucket(spark):
    """Members that share most of a passage but are no links of each other, and a few that are."""
    rnd = random.Random(3)
    core = [f"c{i}" for i in range(60)]
    rows = [(i, " ".join(core + [f"u{i}x{j}" for j in range(12)])) for i in range(60)]
    rows += [(100 + i, rows[i][1] + f" extra{i}") for i in range(10)]
    rnd.shuffle(rows)
    got = nd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2, 80)
    assert sorted(map(tuple, got.collect())) == brute(rows, 2, 80)


def test_copies_and_chains_are_one_component(spark):
    base = [f"x{i}" for i in range(100)]
    rows = [(k + 10, " ".join(base[: 100 - k] + [f"y{i}" for i in range(k)])) for k in range(0, 100, 5)] + [(500 + i, " ".join(base)) for i in range(30)]
    got = nd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2, 80)
    assert sorted(map(tuple, got.collect())) == brute(rows, 2, 80)


def test_repeated_ids_null_ids_and_empty_table(spark):
    rows = [(1, "a b c d e"), (1, "a b c d e"), (2, "a b c d e"), (None, "a b c d e")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, nd.near_duplicates(df, 2).collect()), key=str)
    assert got == sorted([(1, 4, 1, True), (1, 4, 1, True), (2, 4, 1, False), (None, 4, 1, True)], key=str) or (None, 4, None, True) in got
    assert nd.near_duplicates(df.limit(0), 2).count() == 0


@given(st.lists(st.integers(0, nd.SYMBOLS - 1), min_size=0, max_size=nd.LIMIT, unique=True), st.integers(0, 2**32 - 1))
@settings(max_examples=60, deadline=None)
def test_pigeonhole_any_pair_within_the_limit_shares_a_key(places, seed):
    rnd = np.random.default_rng(seed)
    a = rnd.integers(0, 2**16, nd.SYMBOLS).astype(np.uint16)
    b = a.copy()
    b[places] ^= 1
    assert len(places) <= nd.LIMIT
    ka, kb = nd.chunk_keys(np.stack([a, b]))
    assert set(ka) & set(kb)


def test_components_of_random_links(spark):
    rnd = random.Random(1)
    links = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1200)]
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    up = {}
    for a, b in links:
        up.setdefault(a, {a}), up.setdefault(b, {b})
        if up[a] is not up[b]:
            up[a] |= up[b]
            for x in up[b]:
                up[x] = up[a]
    want = {x: min(s) for x, s in up.items() if len(s) > 1}
    assert got == want
