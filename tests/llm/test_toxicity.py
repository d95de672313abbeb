"""op5: the model against a plain recursion, held-out accuracy, and edge cases."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow.parquet as pq

from siftline.llm import toxicity as T


def kneser_ney(counts, pooled, word, letters):
    """Log-likelihood of a word by plain recursion over its letters."""
    def chance(gram, k):
        if k == 0:
            return 1 / letters
        of = counts if k > T.SHARED else pooled
        n = Counter()
        if k == T.ORDER:
            n.update({g: c for g, c in of.items() if len(g) == k})
        else:
            n.update(g[1:] for g in {g[-k - 1 :] for g in of if len(g) > k})
            for g, c in of.items():
                if len(g) == k and g[0] == "\x02":
                    n[g] += c
        here = gram[-k:]
        rows = {g: c for g, c in n.items() if g[:-1] == here[:-1]}
        lower = chance(gram, k - 1)
        if not rows:
            return None if lower is None else lower
        total = sum(rows.values())
        return max(rows.get(here, 0) - T.DISCOUNT, 0) / total + T.DISCOUNT * len(rows) / total * lower

    return sum(math.log(chance(g, len(g))) for g in T.grams(word))


def plain_shared(pooled):
    """For lengths 1 to SHARED: different letters before each sequence; of a beginning, its number."""
    out = []
    for k in range(1, T.SHARED + 1):
        n = Counter(g[1:] for g in {g[-k - 1 :] for g in pooled if len(g) > k})
        n.update({g: c for g, c in pooled.items() if len(g) == k and g[0] == "\x02"})
        out.append(dict(n))
    return out


def test_shared_counts_of_all_documents(spark):
    texts = ["Calm walk, calm sea", None, "", "vile scum Walk", "a", "été 日本 x1y", "calm walk"]
    pooled = Counter(g for t in texts for w in T.expressions(t) for g in T.grams(w))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    assert T.shared_counts(df) == plain_shared(pooled)


def test_model_equals_plain_recursion():
    rnd = random.Random(2)
    words = [["".join(rnd.choice("abcd") for _ in range(rnd.randrange(1, 7))) for _ in range(40)] for _ in range(2)]
    frames, by = [], []
    for y in (0, 1):
        c = Counter(g for w in words[y] for g in T.grams(w))
        by.append(dict(c))
        frames.append(pd.DataFrame({"y": y, "gram": list(c), "n": list(c.values())}))
    pooled = Counter(by[0])
    pooled.update(by[1])
    model = T.Model.of(pd.concat(frames), plain_shared(pooled))
    asked = words[0][:15] + words[1][:15]
    got = model.differences(asked)
    for w, d in zip(asked, got):
        want = (kneser_ney(by[1], pooled, w, model.letters) - kneser_ney(by[0], pooled, w, model.letters)) / (len(w) + 1)
        assert abs(want - d) < 1e-3, (w, want, d)


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    rows = {r.doc_id: r for r in T.toxicity(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")).collect()}
    assert len(rows) == pq.read_metadata(f"{d}/documents.parquet").num_rows
    marks = [x for x in pq.read_table(f"{d}/labels.parquet").to_pylist() if zlib.crc32(str(x["doc_id"]).encode()) % 4 == 2]
    y = np.array([x["toxic"] for x in marks])
    s = np.array([rows[x["doc_id"]].score for x in marks])
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in s[y == 1] for b in s[y == 0]])
    said = s >= 0.3
    assert auc > 0.9 and (said & (y == 1)).sum() >= 0.7 * (y == 1).sum() and (said & (y == 0)).sum() <= 0.1 * (y == 0).sum()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in rows.values())


def test_edges(spark):
    docs = [(i, ("vile rotten scum " if i % 3 == 0 else "calm pleasant walk ") * (1 + i % 5)) for i in range(90)]
    docs += [(1000, None), (1001, ""), (1002, " \n"), (1003, "x" * 100_000), (None, "vile"), (2**60 + 1, "calm"), (5, "calm pleasant walk")]
    labels = [(i, int(i % 3 == 0)) for i in range(90)] + [(None, 1), (4, None)]
    df, marks = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = T.toxicity(df, marks).collect()
    assert sorted((r.doc_id for r in got), key=str) == sorted((d for d, _ in docs), key=str)
    empty = {round(r.score, 12) for r in got if r.doc_id in (1000, 1001, 1002)}
    assert len(empty) == 1
    by = {r.doc_id: r.score for r in got}
    assert by[0] > by[1]
    # without both classes every score is 0; an empty table gives an empty result
    assert {r.score for r in T.toxicity(df, marks.where("toxic = 0")).collect()} == {0.0}
    assert T.toxicity(df.limit(0), marks).count() == 0
    wide = df.selectExpr("*", "'k' as score", "array(doc_id) as extra")
    open_rows = T.fit(df, marks, df)
    out = T.scored(wide, open_rows)
    assert out.columns == wide.columns and {type(r.score) for r in out.collect()} == {float}


def test_score_takes_no_other_column(spark):
    rows = [(i, "calm walk" if i % 2 else "vile scum", "en", "s") for i in range(40)]
    a = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    b = a.selectExpr("doc_id", "text", "'xx' as lang", "'zz' as source")
    marks = a.selectExpr("doc_id", "cast(doc_id % 2 = 0 as int) as toxic")
    assert sorted(T.toxicity(a, marks).collect()) == sorted(T.toxicity(b, marks).collect())
