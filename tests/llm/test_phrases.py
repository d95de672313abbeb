"""op12 against plain counting, at several slice and batch sizes."""

import random
import re
from collections import Counter, defaultdict

from siftline.llm import phrases, term_ids


def brute(docs, min_n, max_n, least, top, percent):
    counts, total = defaultdict(Counter), Counter()
    for lang, text in docs:
        text = "".join(c.lower() if c.isascii() else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            w = re.findall("[^\x20\x09]+", piece)
            total[lang or "und" if lang != "" else ""] += len(w)
            for size in range(1, max_n + 1):
                counts[lang if lang is not None else "und"].update(tuple(w[i : i + size]) for i in range(len(w) - size + 1))
    out = []
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) >= min_n and a >= least}
        rows = []
        for p, a in candidates.items():
            if any(100 * b >= percent * a and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in candidates.items()):
                continue
            score, k = min((1000000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        n = sum(a for p, a in f.items() if len(p) == 1)
        out += [(lang, i, p.decode(), -a, l, r, n, -s) for i, (s, a, p, l, r) in enumerate(sorted(rows)[:top], 1)]
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def corpus(seed, n=200):
    rnd = random.Random(seed)
    words = ["a", "The", "the", "é", "É", "x1", "\x00", "zz", "go-go", "\u00a0", "日本"]
    ends = [" ", "  ", "\t", ". ", ",", "\n", "\r\n", "!", "\x0b", " ; "]
    docs = [(rnd.choice(["en", "de", None, "und", "", "a\tb%09"]), "".join(rnd.choice(words) + rnd.choice([" "] * 6 + ends) for _ in range(rnd.randrange(60)))) for _ in range(n)]
    return docs + [("en", None), ("en", ""), ("en", " . , "), ("en", "w" * 5000), ("en", "a the " * 3000), ("fr", "un seul")]


def frame(spark, docs):
    rows = [(i % 7, text, lang, "s", 99, "w") for i, (lang, text) in enumerate(docs)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n long, phrase string").repartition(5)


def test_equals_plain_counting(spark):
    for seed, (min_n, max_n, least, top, percent) in enumerate([(2, 3, 10, 2000, 50), (2, 4, 3, 40, 80)]):
        docs = corpus(seed)
        got = rows_of(phrases.collocations(frame(spark, docs), min_n, max_n, least, top, percent))
        assert got and got == brute(docs, min_n, max_n, least, top, percent)


def test_small_slices_and_batches(spark, monkeypatch):
    docs = corpus(5, 60)
    found = phrases.suffixes(frame(spark, docs), 3, held_words=7).groupBy("suffix").agg({"n": "sum"})
    whole = phrases.suffixes(frame(spark, docs), 3).groupBy("suffix").agg({"n": "sum"})
    assert rows_of(found) == rows_of(whole)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert rows_of(phrases.collocations(frame(spark, docs), 2, 3, 4, 50, 50)) == brute(docs, 2, 3, 4, 50, 50)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_slices_keep_words_whole():
    data = b"ab cd " * 50 + b"x" * 100 + b" tail"
    for most in (1, 7, 64, 1000):
        parts = list(term_ids.slices(data, b" \n", most))
        assert b"".join(parts) == data and sum((p.split() for p in parts), []) == data.split()


def test_products_beyond_64_bits(spark):
    big = 10**13
    counts = spark.createDataFrame([("en", "a", 1, big), ("en", "b", 1, big + 1), ("en", "a b", 2, big - 7)], "lang string, phrase string, size int, n long")
    row = phrases.scored(counts, 2, 10).collect()
    assert [(r.l, r.r, r.score) for r in row] == [(big, big + 1, 1000000 * (big - 7) ** 2 // (big * (big + 1)))]


def test_empty_table(spark):
    assert phrases.collocations(frame(spark, corpus(1)).limit(0)).collect() == []
