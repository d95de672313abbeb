"""Toxicity by class-conditional Kneser-Ney models over the letters of expressions (words).

Two interpolated Kneser-Ney models of ORDER letters, one of toxic and one of ordinary documents, score each
expression by the difference of its log-likelihoods over its length. Up to SHARED letters both back off to the same
continuation counts, pooled over the classes: an expression that neither class has seen is told apart only by
what its longer letter sequences show, not by sparse counts. A document is as toxic as its strongest
expressions and its mean: a logistic fit on held-back rows of the sample turns those differences into a
probability. Only the text is an input.

The shared counts are those of all documents: Spark finds their letter sequences of SHARED + 1 letters and counts, for each
sequence of SHARED letters or fewer, what different letters stand before it. Their number is bounded by the letters that
there are. Bound of the fit: at most ``max_docs`` labelled documents of each class, chosen by hash of the id, and of these
one third for the logistic. Spark counts the letter sequences of the sample; the model (their number is bounded
by the sample) goes to the tasks, and every text is scored whole.

Defined results: null, empty and blank texts have no expressions and get the probability at mean 0 (that of no
evidence); label rows with a null id or label are not learned from, nor are conflicting ones told apart (each
counts); without labels of both classes every score is 0; repeated rows score alike; an empty table gives an
empty result; further columns are handed on by ``scored``, but for one of the score's name.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import itemgetter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .tables import give_back, lean, stored

ORDER, SHARED, DISCOUNT = 5, 2, 0.75
TOP = 3
HEADS = [itemgetter(slice(i)) for i in range(1, SHARED)]  # the first letters of a word, for sequences that begin one
KEPT_WORDS = 300_000  # expressions, or their differences, that a task remembers
KEPT_GRAMS = 500_000  # short letter sequences that a task remembers
BLOCK = 256  # texts whose new expressions are scored at once
LONGEST = 40  # letters of an expression that one look-up holds; longer ones are scored in pieces
EXPRESSION = re.compile(r"[^\W\d_]+")
THRESHOLD = 0.3


def expressions(text: str | None) -> list[str]:
    found = EXPRESSION.findall((text or "").lower())
    if any(len(w) > LONGEST for w in found):
        found = [w[i : i + LONGEST] for w in found for i in range(0, len(w), LONGEST)]
    return found


def grams(word: str) -> list[str]:
    """For each letter and the end, the letter with up to ORDER - 1 before it; \\x02 begins and \\x03 ends a word."""
    s = f"\x02{word}\x03"
    return [s[max(0, i - ORDER + 1) : i + 1] for i in range(1, len(s))]


def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(y, gram, n) of each batch of (y, text)."""
    for b in batches:
        for y, texts in b.groupby("y")["text"]:
            found: Counter[str] = Counter()
            for word, n in Counter(w for t in texts for w in expressions(t)).items():
                for g in grams(word):
                    found[g] += n
            yield pd.DataFrame({"y": y, "gram": list(found), "n": list(found.values())})


def short_grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(gram, n) of each batch of (text): all sequences of SHARED + 1 letters or, at a word's beginning, fewer. Those of which the
    number counts, that begin a word and are shorter, come with how often; the others once for each task that has them."""
    known: set[str] = set()
    told: set[str] = set()
    for b in batches:
        begins: list[Counter[str]] = [Counter() for _ in HEADS]
        found: set[str] = set()
        for k in range(0, len(b), BLOCK):
            new: set[str] = set()
            for t in b["text"].iloc[k : k + BLOCK]:
                words = expressions(t)
                for head, heads in zip(HEADS, begins):
                    heads.update(map(head, words))
                new.update(words)
            new -= known
            for word in new:
                s = f"\x02{word}\x03"
                found.update([s[i - SHARED : i + 1] for i in range(SHARED, len(s))])
            if len(known) > KEPT_WORDS:
                known.clear()
            known |= new
        if len(told) > KEPT_GRAMS:
            told.clear()
        found -= told
        told |= found
        # a word of i - 1 letters ends its sequence of i; of a shorter one there is none
        first = [(f"\x02{w}" if len(w) == i else f"\x02{w}\x03", n) for i, heads in enumerate(begins, 1) for w, n in heads.items() if len(w) >= i - 1]
        yield pd.DataFrame([*first, *((g, 0) for g in found)], columns=["gram", "n"])


def shared_counts(docs: DataFrame) -> list[dict[str, int]]:
    """For lengths 1 to SHARED, how many different letters stand before each sequence in all documents."""
    made = docs.select("text").where(F.col("text").isNotNull()).mapInPandas(lean(short_grams), "gram string, n long")
    grams = stored(made.groupBy("gram").agg(F.sum("n").alias("n")), "grams")
    out = []
    for k in range(1, SHARED + 1):
        wider = grams.where(F.length("gram") > k).select(F.substring("gram", -(k + 1), k + 1).alias("w")).distinct()
        kinds = wider.groupBy(F.substring("w", 2, k).alias("gram")).agg(F.count("*").alias("n"))
        # nothing can stand before a beginning: there its own number counts
        begins = grams.where((F.length("gram") == k) & F.startswith("gram", F.lit("\x02")))
        out.append({g: n for g, n in kinds.union(begins.select("gram", "n")).groupBy("gram").agg(F.sum("n")).collect()})
    return out


STEP = np.uint64(0x9E3779B97F4A7C15)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def _keys(strings: list[str]) -> np.ndarray:
    """Keys of strings: their letters, from the last to the first, times powers of STEP."""
    out = np.empty(len(strings), np.uint64)
    sizes = np.fromiter(map(len, strings), int, len(strings))
    for k in np.unique(sizes):
        at = np.flatnonzero(sizes == k)
        powers = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(0, k - 1), STEP)]))[::-1][:k]
        out[at] = (_codes("".join(strings[i] for i in at)).reshape(len(at), k) * powers).sum(axis=1, dtype=np.uint64)
    return out


BITS = 20


class Table:
    """A pair of values, one for each class, by key; keys are sorted and found from an index of their first BITS bits."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        o = np.argsort(keys)
        self.keys, self.values = keys[o], values[o].astype(np.float32)
        self.index = None

    def get(self, keys: np.ndarray, default: np.ndarray | float) -> np.ndarray:
        if self.index is None:
            self.index = np.searchsorted(self.keys, np.arange(2**BITS, dtype=np.uint64) << np.uint64(64 - BITS)).astype(np.int32)
            self.keys = np.append(self.keys, np.uint64(0))  # a last place to look at
        at = self.index[keys >> np.uint64(64 - BITS)]
        out = np.empty((len(keys), 2), np.float32)
        out[:] = default
        rest = np.arange(len(keys))
        while len(rest):
            here = self.keys[at]
            hit = here == keys
            out[rest[hit]] = self.values[at[hit]]
            more = np.flatnonzero(here < keys) if len(rest) else rest
            more = more[at[more] < len(self.keys) - 2]
            rest, keys, at = rest[more], keys[more], at[more] + 1
        return out

    def __getstate__(self):
        return {"keys": self.keys[: len(self.values)], "values": self.values, "index": None}


def salted(keys: np.ndarray, k: int) -> np.ndarray:
    """Keys spread over all bits, apart for each length."""
    x = (keys + np.uint64(k)) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)


def levels(counts: dict[str, int], shared: list[dict[str, int]]) -> list[tuple[dict[str, float], dict[str, float]]]:
    """Discounted probability of each gram and weight of what lies below each context, for lengths 1 to ORDER.
    Short lengths come from ``shared``."""
    out = []
    for k in range(1, ORDER + 1):
        n: Counter[str] = Counter()
        if k <= SHARED:
            n.update(shared[k - 1])
        elif k == ORDER:
            n.update({g: c for g, c in counts.items() if len(g) == ORDER})
        else:
            seen = {g[-k - 1 :] for g in counts if len(g) > k}
            n.update(g[1:] for g in seen)  # continuations: different letters before it
            for g, c in counts.items():
                if len(g) == k and g[0] == "\x02":  # nothing can stand before a beginning
                    n[g] += c
        total, kinds = Counter(), Counter()
        for g, c in n.items():
            total[g[:-1]] += c
            kinds[g[:-1]] += 1
        out.append(({g: max(c - DISCOUNT, 0) / total[g[:-1]] for g, c in n.items()}, {v: DISCOUNT * kinds[v] / total[v] for v in total}))
    return out


@dataclass
class Model:
    """Probabilities of grams and weights of contexts for both classes; weights of the logistic."""

    chances: Table
    backoffs: Table
    letters: int
    weights: np.ndarray | None = None

    @classmethod
    def of(cls, counts: pd.DataFrame, shared: list[dict[str, int]]) -> Model:
        by = [dict(zip(p["gram"], p["n"])) for p in (counts[counts["y"] == y] for y in (0, 1))]
        made = [levels(c, shared) for c in by]
        tables = []
        for part, missing in ((0, 0.0), (1, 1.0)):
            keys, values = [], []
            for k in range(1, ORDER + 1):
                names = sorted(set(made[0][k - 1][part]) | set(made[1][k - 1][part]))
                keys.append(salted(_keys(names), k))
                values.append(np.array([[m[k - 1][part].get(g, missing) for m in made] for g in names], np.float32).reshape(-1, 2))
            tables.append(Table(np.concatenate(keys), np.concatenate(values)))
        return cls(*tables, len(shared[0]) + 1)

    def differences(self, words: list[str]) -> np.ndarray:
        """Of each word: toxic minus ordinary log-likelihood, over its length."""
        parts = [f"\x02{w}\x03" for w in words]
        sizes = np.array([len(p) - 1 for p in parts])
        codes = _codes("".join(parts))
        starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
        first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        place = np.arange(sizes.sum()) - np.repeat(first, sizes) + 1
        at = np.repeat(starts, sizes) + place
        chance = np.full((len(at), 2), 1.0 / self.letters, np.float32)
        # keys of the k letters that end at a place, and of the k - 1 before it
        whole, before, power = np.zeros(len(at), np.uint64), np.zeros(len(at), np.uint64), np.ones(1, np.uint64)
        rows = np.arange(len(at))  # places whose context is known so far: a longer one is unknown if a shorter one is
        for k in range(1, ORDER + 1):
            letter = codes[np.maximum(at - k + 1, 0)]
            whole = whole + letter * power
            if k > 1:
                before = before + letter * last
            last, power = power, power * STEP
            rows = rows[place[rows] >= k - 1]
            weight = self.backoffs.get(salted(before[rows], k), -1.0)
            found = weight[:, 0] >= 0
            rows, weight = rows[found], weight[found]
            chance[rows] = self.chances.get(salted(whole[rows], k), 0.0) + weight * chance[rows]
        log = np.log(chance[:, 1]) - np.log(chance[:, 0])
        return np.add.reduceat(log, first) / sizes

    def features(self, texts, known: dict[str, float]) -> np.ndarray:
        """Mean difference, greatest, mean of the TOP greatest (all at most 3 away from 0) and 1 for each text."""
        out = np.zeros((len(texts), 4))
        out[:, 3] = 1
        texts = list(texts)
        for k in range(0, len(texts), BLOCK):
            block = [expressions(t) for t in texts[k : k + BLOCK]]
            if len(known) > KEPT_WORDS:
                known.clear()
            new = list(set().union(*block).difference(known))
            for j in range(0, len(new), 20_000):
                known.update(zip(new[j : j + 20_000], self.differences(new[j : j + 20_000]).clip(-3, 3).tolist()))
            for i, found in enumerate(block, k):
                if found:
                    d = list(map(known.__getitem__, found))
                    top = heapq.nlargest(TOP, d)
                    out[i, :3] = sum(d) / len(d), top[0], sum(top) / TOP
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Weights by Newton's method."""
    b = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(b))
        step = np.linalg.solve(h, x.T @ (weight * (y - p)) - ridge * b)
        b += step
        if np.abs(step).max() < 1e-8:
            break
    return b


def fit(docs: DataFrame, labels: DataFrame, corpus: DataFrame, max_docs: int = 4000) -> Model | None:
    """The model for ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic); both have only rows to learn from. ``corpus`` has
    all texts, for the shared counts."""
    known = labels.where("doc_id is not null and toxic in (0, 1)").select("doc_id", F.col("toxic").cast("int").alias("y"))
    shares = dict(known.groupBy("y").count().collect())
    if set(shares) != {0, 1}:
        return None
    h = F.xxhash64("doc_id", F.lit(5))
    # a bounded choice: at most max_docs ids of each class
    chosen = [known.where(F.col("y") == y).orderBy(h, "doc_id").limit(max_docs) for y in (0, 1)]
    ids = chosen[0].union(chosen[1])
    sample = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(ids), "doc_id").withColumn("hold", F.pmod(F.xxhash64("doc_id", F.lit(6)), F.lit(3)) == 0)
    counts = sample.where("not hold").select("y", "text").mapInPandas(lean(counted), "y int, gram string, n long").groupBy("y", "gram").agg(F.sum("n").alias("n")).toPandas()
    if set(counts["y"]) != {0, 1}:
        return None
    model = Model.of(counts, shared_counts(corpus))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[str, float] = {}
        for b in batches:
            x = sent.value.features(b["text"], seen)
            yield pd.DataFrame({"y": b["y"], "a": x[:, 0], "b": x[:, 1], "c": x[:, 2]})

    held = sample.where("hold").select("y", "text").mapInPandas(lean(measure), "y int, a double, b double, c double").toPandas()
    y = held["y"].to_numpy()
    if len(set(y)) < 2:
        return None
    whole = sum(shares.values())
    weight = np.where(y == 1, shares[1] / whole / max(1, (y == 1).sum()), shares[0] / whole / max(1, (y == 0).sum())) * len(y)
    model.weights = logistic(np.column_stack([held[["a", "b", "c"]].to_numpy(), np.ones(len(y))]), y, weight)
    return model


def scored(docs: DataFrame, model: Model | None, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the probability of label 1 in column ``name``."""
    if model is None:
        return docs.withColumn(name, F.lit(0.0))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(DoubleType())
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        seen: dict[str, float] = {}
        try:
            for texts in batches:
                yield pd.Series(sent.value.probability(sent.value.features(texts, seen)))
        finally:
            seen.clear()
            give_back()

    return docs.withColumn(name, score(F.col(text)))


def held_out(key: str = "doc_id") -> Column:
    """Rows that are never learned from."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2


def toxicity(docs: DataFrame, labels: DataFrame, max_docs: int = 4000) -> DataFrame:
    """doc_id, held_out, score and predicted of each row."""
    open_rows = ~F.coalesce(held_out(), F.lit(False))
    model = fit(docs.where(open_rows), labels.where(open_rows), docs, max_docs)
    out = scored(docs.select("doc_id", "text"), model)
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
