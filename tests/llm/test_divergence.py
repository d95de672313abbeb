"""op13 against sums over all kept terms of all pairs."""

import random
import re
from collections import Counter, defaultdict

from siftline.llm import divergence


def brute(docs, least, top):
    groups, with_term = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in docs:
        lang, source = lang or "", source or ""
        text = "".join(c.lower() if c.isascii() else c for c in text or "")
        words = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text)
        groups[lang, source].update(words)
        with_term[lang].update(set(words))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in with_term[lang].items() if n >= least]
        of = {s: c for (x, s), c in groups.items() if x == lang}
        whole = sum(of.values(), Counter())

        def share(c):
            n = sum(c[t] for t in kept)
            return {t: 1 + 1000000000 * (c[t] + 5) // (n + 5 * len(kept)) for t in kept}

        p, q = {s: share(c) for s, c in of.items()}, share(whole)
        for s in of:
            pairs = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in of if o != s]
            terms = [(q[t] - p[s][t], t.encode()) for t in kept if of[s][t] and p[s][t] > q[t]]
            out += [(lang, s, "pair", i.decode(), -v, k) for k, (v, i) in enumerate(sorted(pairs), 1)]
            out += [(lang, s, "term", i.decode(), -v, k) for k, (v, i) in enumerate(sorted(terms)[:top], 1)]
    return sorted(out)


def corpus(seed, n=300):
    rnd = random.Random(seed)
    words = [w + x for w in ("a", "The", "é", "日本", "Zoo", "q") for x in ("", "b", "É", "cc", "1x")]
    docs = []
    for _ in range(n):
        lang, source = rnd.choice(["en", "en", "de", None]), rnd.choice(["s0", "s0", "s1", "s2", "s3", None])
        own = words[: 4 + 5 * len(source or "") + (hash_of(source) % 13)]
        docs.append((lang, source, "".join(rnd.choice(own) + rnd.choice(" -\n.\x00") for _ in range(rnd.randrange(25)))))
    return docs + [("xx", "s0", ""), ("xx", "s1", None), ("en", "only", "123"), ("de", "long", "Zoo a " * 4000)]


def hash_of(s):
    return sum(map(ord, s or ""))


def frame(spark, docs):
    rows = [(i % 9, text, lang, source, "clash", 1) for i, (lang, source, text) in enumerate(docs)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, term string, zero int").repartition(4)


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_equals_sums_over_all_terms(spark):
    for seed, least, top in ((1, 5, 4), (2, 30, 50), (3, 10**6, 3)):
        docs = corpus(seed)
        got = rows_of(divergence.audit(frame(spark, docs), least, top))
        assert got and got == brute(docs, least, top)


def test_small_slices_and_held_words(spark, monkeypatch):
    docs = corpus(4, 40)
    whole = rows_of(divergence.term_counts(frame(spark, docs)))
    assert rows_of(divergence.term_counts(frame(spark, docs), held_words=5)) == whole


def test_empty_table(spark):
    assert divergence.audit(frame(spark, corpus(1)).limit(0)).collect() == []
