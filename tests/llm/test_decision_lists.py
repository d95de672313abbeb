"""op7: statistics against plain Python, and rules on labelled rows."""

import random
import re

from pyspark.sql import functions as F

from siftline.llm import decision_lists as D

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    t = text or ""
    w = WORD.findall(t)
    seen, dup = set(), 0
    for x in t.split("\n"):
        if WORD.search(x):
            dup += x in seen
            seen.add(x)
    where = {}
    for i in range(len(w) - 4):
        where.setdefault(tuple(w[i : i + 5]), []).append(i)
    covered = {j for v in where.values() if len(v) > 1 for i in v for j in range(i, i + 5)}
    base = len(w) < 10 or 100 * len(covered) > 20 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(covered), base


def texts(seed):
    rnd = random.Random(seed)
    out = [None, "", " \n\t", "a", "a b c d e", "a b c d e a b c d e", "x " * 3000, "é\x85b c \U0001f600 d", "l\nl\n \nl\n\nm\nl ", "#*$%&|<> #", "\0 a", "a\x0bb\x0cc\rd"]
    for _ in range(150):
        out.append("".join(rnd.choice(["a", "b", "c#", "é"]) + rnd.choice([" ", "\n", "  ", "\t"]) for _ in range(rnd.randrange(0, 60))))
    return out


def test_statistics(spark):
    found = texts(1)
    rows = [(i, t) for i, t in enumerate(found)] + [(None, "a b")]
    got = D.text_statistics(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(found[r.doc_id] if r.doc_id is not None else "a b")[:5]


def test_rules_find_planted_thresholds(spark):
    rnd = random.Random(7)
    docs, labels = [], []
    for i in range(900):
        bad = i % 3 == 0
        words = [rnd.choice("alpha beta gamma delta".split()) + str(rnd.randrange(10**6)) for _ in range(rnd.randrange(20, 60))]
        docs.append((i, " ".join(w + "#$" if bad else w for w in words)))
        labels.append((i, 0 if bad else 1))
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, n_words int")
    got = {r.doc_id: r for r in D.quality_verdicts(df, spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    wrong = sum(got[i].kept != bool(y) for i, y in labels)
    assert wrong <= 9
    assert all(r.base_failed == brute(dict(docs)[i])[5] and not (r.base_failed and r.kept) for i, r in got.items())


def test_learning_is_ordered_and_pruned():
    cuts = {f: [1.0] for f in D.FEATURES}
    row = lambda on, y, n, prune: {**{f: 0 for f in D.FEATURES}, "n_words": on, "y": y, "count": n, "prune": prune}
    rows = [row(1, 0, 50, p) for p in (True, False)] + [row(0, 1, 200, p) for p in (True, False)]
    assert D.learn(rows, cuts) == [(D.Test("n_words", True, 1.0),)]
    assert D.learn([row(1, y, 50, p) for y in (0, 1) for p in (True, False)], cuts) == []


def test_edges(spark):
    df = spark.createDataFrame([(1, None), (1, "a " * 12), (None, "b c d e f g h i j k l m"), (2**60 + 1, "")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = D.quality_verdicts(df, none).collect()
    assert sorted((r.kept, r.base_failed) for r in got) == [(False, True)] * 3 + [(True, False)]
    odd = spark.createDataFrame([(None, 1), (1, None), (1, 0), (1, 1)], "doc_id long, quality int")
    assert len(D.quality_verdicts(df, odd).collect()) == 4
    assert D.quality_verdicts(df.limit(0), none).count() == 0


def test_main_path_is_native(spark):
    d = "/root/testdata/sf0.001"
    out = D.quality_verdicts(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet"))
    stats = D.text_statistics(spark.read.parquet(f"{d}/documents.parquet"))
    for x in (out, stats):
        plan = x._jdf.queryExecution().toString()
        assert "Python" not in plan and "Arrow" not in plan
    assert out.select(F.count("*")).first()[0] == 200
