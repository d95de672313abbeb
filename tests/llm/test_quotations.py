"""op3 against a plain walk over each conversation."""

import random
import re

from pyspark.sql import functions as F

from siftline.llm import quotations as Q


def norm(s):
    return re.sub(r"[\s ]+", " ", s.lower()).strip(" ")


def units(s):
    return {x for x in [norm(s), *(norm(x) for x in s.split("\n") if len(norm(x)) >= Q.LEAST)] if x}


def parse(text):
    """Own words and passages (depth, words)."""
    if text is None or not re.search(Q.QUOTED, text):
        return text, []
    lines = []
    for x in text.split("\n"):
        m = re.match(Q.MARKS, x)
        lines.append((m[0].count(">"), x[m.end() :]) if m else (0, x))
    passages, own = [], []
    for i, (d, w) in enumerate(lines):
        if d and i and lines[i - 1][0] == d:
            passages[-1][1].append(w)
        elif d:
            passages.append((d, [w]))
        elif not (re.search(Q.SAID, w) and i + 1 < len(lines) and lines[i + 1][0] > 0):
            own.append(w)
    return re.sub(r"\A\s+|\s+\Z", "", "\n".join(own)), [(d, "\n".join(w)) for d, w in passages if "\n".join(w).strip(" ")]


def brute(rows):
    said = {}
    for s, t, text in rows:
        own, _ = parse(text)
        if s is not None and t is not None and own:
            for u in units(own):
                said[s, u] = min(t, said.get((s, u), t))
    parent = {}
    for s, t, text in rows:
        found = [(-d, said[s, u]) for d, p in parse(text)[1] for u in units(p) if said.get((s, u), t) is not None and t is not None and said.get((s, u), t) < t]
        if found:
            best = max(found)
            parent[s, t] = max(best, parent.get((s, t), best))
    out, chain = [], {}
    for (s, t) in parent:
        root, depth = t, 0
        while (s, root) in parent:
            root, depth = parent[s, root][1], depth + 1
        chain[s, t] = (parent[s, t][1], root, depth)
    for s, t, text in rows:
        own, passages = parse(text)
        p, root, depth = chain.get((s, t), (None, t, 0))
        position = sorted(x for (q, x), c in chain.items() if q == s and c[1] == root).index(t) + 1 if p is not None else 0
        out.append((s, t, own, len(passages), p, root, depth, position))
    return sorted(out, key=str)


def messages(seed):
    rnd = random.Random(seed)
    rows = []
    for c in range(8):
        texts = []
        for t in range(rnd.randrange(1, 14)):
            lines = [" ".join(rnd.choice("red green blue brown grey black".split()) for _ in range(rnd.randrange(1, 8))) for _ in range(rnd.randrange(1, 3))]
            if texts and rnd.random() < 0.7:
                quoted = rnd.choice(texts)
                head = ["On Monday Ann wrote:"] if rnd.random() < 0.3 else []
                lines = head + ["> " + x for x in quoted.split("\n")] + lines + (["", ">> " + rnd.choice(texts).split("\n")[0]] if rnd.random() < 0.3 else [])
            texts.append("\n".join(lines))
            rows.append((c, t, texts[-1] if rnd.random() < 0.95 else None))
    return rows


def test_equals_plain_walk(spark):
    rows = [r for seed in range(3) for r in ((c + 10 * seed, t, x) for c, t, x in messages(seed))]
    rows += [(900, 0, "Hello there everyone"), (900, 1, "> hello   THERE everyone\nyes"), (900, 2, "> yes\nno"), (900, 3, ">"), (900, 4, "> nobody said this"), (901, None, "> a"), (None, 1, "> a"), (902, 0, "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, text string")
    got = sorted((tuple(r[c] for c in ("conv_id", "turn", "text", "n_passages", "parent", "root", "depth", "position")) for r in Q.linked(df).collect()), key=str)
    assert got == brute(rows)


def test_a_long_chain_and_a_common_root(spark):
    rows = [(1, 0, "start of all")] + [(1, t, f"> {'start of all' if t == 1 else f'message number {t - 1}'}\nmessage number {t}") for t in range(1, 130)]
    rows += [(2, 0, "opening words")] + [(2, t, f"> opening words\nreply {t}") for t in range(1, 3000)]
    got = {(r.conv_id, r.turn): r for r in Q.linked(spark.createDataFrame(rows, "conv_id long, turn long, text string")).where("turn in (129, 2999)").collect()}
    assert (got[1, 129].root, got[1, 129].depth, got[1, 129].position) == (0, 129, 129)
    assert (got[2, 2999].parent, got[2, 2999].depth, got[2, 2999].position) == (0, 1, 2999)


def test_clashing_columns_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([(1, 0, "first words here"), (1, 1, "> first words here\nok"), (1, 1, "> first words here\nok")], "conv_id long, turn long, text string")
    wide = df.withColumns({c: F.lit(c) for c in ("s", "t", "own", "passages", "row", "root", "role", "_lines")})
    out = Q.linked(wide)
    assert len(out.columns) == len(set(out.columns)) == len(wide.columns) + 4
    rows = out.where("turn = 1").collect()
    assert [(r.s, r.own, r.root, r.parent, r.text) for r in rows] == [("s", "own", 0, 0, "ok")] * 2
    assert Q.linked(df.limit(0)).count() == 0


def test_main_path_is_native(spark):
    plan = Q.linked(spark.read.parquet("/root/testdata/sf0.001/conversations.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def first_with(said, passage, before):
    """Turn of the first message that has the passage as a run of whole lines or sentences, by trying all."""
    for t, own in sorted(said):
        parts = [norm(x) for x in re.split(r"\n|(?<=[.!?…])[\s ]+", own)]
        parts = [x for x in parts if x]
        if t < before and any(" ".join(parts[i:j]) == norm(passage) for i in range(len(parts)) for j in range(i + 1, len(parts) + 1)):
            return t
    return None


def test_excerpts_of_lines_and_sentences(spark):
    one = [(1, 0, "Thanks for the note.\nYes, let's do it"), (1, 1, "> Yes, let's do it\nfine")]
    two = [
        (2, 0, "We could meet on\nMonday at noon. Bring tea.\nOr not.\nBye"),
        (2, 1, "> We could meet on Monday\n> at noon.\nyes"),
        (2, 2, "> Bring tea.\n> Or not.\nno"),
        (2, 3, "> tea.\nhalf a sentence is none"),
        (2, 4, "> We could meet on Monday at noon. Bring tea. Or not. Bye\nall"),
        (2, 5, ">> Or   NOT.\n> yes\nboth"),
    ]
    rnd = random.Random(3)
    many = []
    for t in range(80):
        lines = [" ".join(rnd.choice("ab") for _ in range(rnd.randrange(1, 4))) + rnd.choice(("", ".", "!")) for _ in range(rnd.randrange(1, 5))]
        quote = "\n".join("> " + " ".join(rnd.choice("ab") for _ in range(rnd.randrange(1, 4))) + rnd.choice(("", ".")) for _ in range(rnd.randrange(1, 3)))
        many.append((3, t, (quote + "\n" if t % 2 else "") + "\n".join(lines)))
    df = spark.createDataFrame(one + two + many, "conv_id long, turn long, text string")
    got = {(r.conv_id, r.turn): r.parent for r in Q.linked(df, excerpts=True).collect()}
    assert got[1, 1] == 0
    assert [got[2, t] for t in range(6)] == [None, 0, 0, None, 0, 1]
    old = {(r.conv_id, r.turn): r.parent for r in Q.linked(df).collect()}
    said = [(t, parse(x)[0]) for _, t, x in many]
    for _, t, x in many:
        passages = parse(x)[1]
        assert got[3, t] == (old[3, t] if old[3, t] is not None or not passages else first_with(said, passages[0][1], t)), x
    assert any(got[3, t] is not None and old[3, t] is None for t in range(80))


def test_query_finds_excerpts(spark, tmp_path):
    from siftline.llm import queries

    spark.createDataFrame([(1, 0, "u", "Thanks for the note.\nYes, let's do it"), (1, 1, "v", "> Yes, let's do it\nfine")], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    out = queries.op3_quotation_links(spark, str(tmp_path))
    assert {r.turn: r.parent for r in out.collect()} == {0: None, 1: 0}
    plan = out._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
