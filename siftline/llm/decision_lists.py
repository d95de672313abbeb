"""Quality rules learned as a decision list, in DataFrame operations only.

Sequential covering: each rule is a conjunction of thresholds on document statistics, grown by
information gain on two thirds of the labelled rows and pruned on the rest; rows it covers are taken
away and the next rule is learned. The outcome is an ordered conditional expression.

What the learner sees is the contingency table of the labelled rows over threshold intervals. It covers
every labelled row and has at most (2 * CUTS + 1) ** len(FEATURES) rows, whatever the corpus holds, so the
covering loop itself is small driver work on counts.

Defined results: a null or empty text has no words and fails the base rule; a label row with a null
doc_id or label is not learned from; several labels of one document vote once each; an empty label table
gives an empty list, which keeps all; repeated document rows each get their own result; further columns
are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import SPACE, stored, words

FEATURES = ("n_words", "chars_per_word", "symbols_per_word", "dup_lines_per_word", "repeat_share")
CUTS = 8  # thresholds for each feature and class
WINDOW = 5


def text_statistics(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each row."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.translate(x, " \t\n\x0b\f\r", "")) > 0)
    one = docs.select(
        F.col(key),
        words(F.col(text)).alias("w"),
        F.length(F.translate(t, " \t\n\x0b\f\r", "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        lines.alias("lines"),
    )
    two = one.select(
        key, "w", "word_chars", "n_symbols",
        F.size("w").cast("long").alias("n_words"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("w") >= WINDOW, F.transform(F.sequence(F.lit(0), F.size("w") - WINDOW), lambda i: F.xxhash64(*[F.col("w")[i + k] for k in range(WINDOW)]))).otherwise(F.array().cast("array<bigint>")).alias("h"),
    )
    # most texts repeat nothing: the sort below is then not evaluated
    three = two.withColumn(
        "s",
        F.when(F.size(F.array_distinct("h")) < F.size("h"), F.array_sort(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("p"))))),
    )
    last = F.size("s") - 1
    four = three.withColumn(
        "p",
        F.when(
            F.col("s").isNotNull(),
            F.array_sort(
                F.filter(
                    F.transform("s", lambda x, k: F.when(((k > 0) & (x["h"] == F.get("s", k - 1)["h"])) | ((k < last) & (x["h"] == F.get("s", k + 1)["h"])), x["p"])),
                    lambda q: q.isNotNull(),
                )
            ),
        ),
    )
    covered = F.aggregate(
        F.transform("p", lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get("p", k + 1) - x, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x
    )
    return four.select(
        key, "n_words", "word_chars", "n_symbols", "n_dup_lines",
        F.coalesce(F.when(F.col("p").isNotNull(), covered), F.lit(0)).cast("long").alias("n_repeat_words"),
    )


def with_features(stats: DataFrame) -> DataFrame:
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return stats.withColumns({
        "chars_per_word": F.col("word_chars") / n,
        "symbols_per_word": F.col("n_symbols") / n,
        "dup_lines_per_word": F.col("n_dup_lines") / n,
        "repeat_share": F.col("n_repeat_words") / n,
    })


@dataclass(frozen=True)
class Test:
    feature: str
    above: bool
    cut: float

    def column(self) -> Column:
        return F.col(self.feature) > F.lit(self.cut) if self.above else F.col(self.feature) <= F.lit(self.cut)


def contingency(labelled: DataFrame, cuts: dict[str, list[float]], label: str, key: str) -> DataFrame:
    """Counts of (interval of each feature, fold, label); interval k of a feature lies above k of its cuts."""
    bins = [sum(((F.col(f) > F.lit(c)).cast("int") for c in cuts[f]), F.lit(0)).alias(f) for f in FEATURES]
    fold = (F.pmod(F.xxhash64(key), F.lit(3)) == 2).alias("prune")
    return labelled.groupBy(*bins, fold, F.col(label).cast("int").alias("y")).count()


def covers(rule: tuple[Test, ...], row: dict, cuts: dict[str, list[float]]) -> bool:
    return all((row[t.feature] > cuts[t.feature].index(t.cut)) == t.above for t in rule)


def learn(rows: list[dict], cuts: dict[str, list[float]], bad: int = 0, min_precision: float = 0.9, min_cover: float = 0.002, max_rules: int = 12) -> list[tuple[Test, ...]]:
    """Rules that mark label ``bad``, in order, from a contingency table."""
    rules: list[tuple[Test, ...]] = []
    tests = [Test(f, above, c) for f in FEATURES for c in cuts[f] for above in (True, False)]
    left = list(rows)
    total = sum(r["count"] for r in rows if r["y"] == bad)

    def weigh(part: list[dict]) -> tuple[int, int]:
        p = sum(r["count"] for r in part if r["y"] == bad)
        return p, sum(r["count"] for r in part) - p

    while len(rules) < max_rules:
        grow, prune = [r for r in left if not r["prune"]], [r for r in left if r["prune"]]
        rule: tuple[Test, ...] = ()
        inside = grow
        while True:
            p, n = weigh(inside)
            if not p or not n:
                break
            gains = []
            for t in tests:
                q, m = weigh([r for r in inside if covers((t,), r, cuts)])
                if q:
                    gains.append((q * (math.log2(q / (q + m)) - math.log2(p / (p + n))), t))
            best = max(gains, key=lambda x: x[0], default=(0, None))
            if best[0] <= 1e-9:
                break
            rule += (best[1],)
            inside = [r for r in inside if covers((best[1],), r, cuts)]
        if not rule:
            break

        def worth(k: int) -> float:
            p, n = weigh([r for r in prune if covers(rule[:k], r, cuts)])
            return (p - n) / (p + n) if p + n else -1.0

        rule = rule[: max(range(1, len(rule) + 1), key=lambda k: (worth(k), -k))]
        held = weigh([r for r in prune if covers(rule, r, cuts)])
        whole = weigh([r for r in left if covers(rule, r, cuts)])
        precise = all(p >= min_precision * (p + n) for p, n in (held, whole))
        if not precise or whole[0] < max(1, min_cover * total):
            break
        rules.append(rule)
        left = [r for r in left if not covers(rule, r, cuts)]
    return rules


def fit(labelled: DataFrame, label: str, key: str = "doc_id", **options) -> list[tuple[Test, ...]]:
    """The decision list for rows that have FEATURES and a 0/1 label; one pass for the cuts, one for the counts."""
    steps = [k / CUTS for k in range(CUTS)] + [0.98]
    picks = labelled.groupBy(F.col(label).cast("int").alias("y")).agg(*[F.percentile_approx(f, F.array(*map(F.lit, steps)), 10_000).alias(f) for f in FEATURES]).collect()
    cuts = {f: sorted({float(v) for r in picks for v in r[f] or []}) for f in FEATURES}
    rows = [r.asDict() for r in contingency(labelled, cuts, label, key).collect()]
    return learn(rows, cuts, **options)


def expression(rules: list[tuple[Test, ...]]) -> Column:
    """Ordered conditional: the number of the first rule that holds, null if none does."""
    out = None
    for i, rule in enumerate(rules, 1):
        test = rule[0].column()
        for t in rule[1:]:
            test = test & t.column()
        out = F.when(test, F.lit(i)) if out is None else out.when(test, F.lit(i))
    return F.lit(None).cast("int") if out is None else out


def quality_verdicts(docs: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality", **options) -> DataFrame:
    """The statistics of each row, base_failed, rule (number of the rule that rejects it) and kept."""
    stats = stored(text_statistics(docs, key=key), "statistics")
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    rows = with_features(stats).withColumn("base_failed", base)
    marks = labels.select(F.col(key), F.col(label)).where(F.col(key).isNotNull() & F.col(label).isNotNull())
    rules = fit(rows.where(~base).join(marks, key), label, key, **options)
    return rows.withColumn("rule", F.when(~base, expression(rules))).select(
        key, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "rule", (~base & F.col("rule").isNull()).alias("kept")
    )
