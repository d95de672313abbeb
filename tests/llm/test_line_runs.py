"""op8 against a plain search for repeated line runs."""

import random

from siftline.llm import line_runs


def n_words(line):
    return len(line.encode().split())


def brute(rows, least):
    """For each text: its lines that a later copy of a shortest sufficient run covers."""
    full = [[x for x in (t or "").split("\n") if n_words(x)] for _, t in rows]
    first, gone = {}, [set() for _ in rows]
    order = sorted(range(len(rows)), key=lambda i: rows[i][0])
    for i in order:
        for at in range(len(full[i])):
            n = k = 0
            while at + k < len(full[i]) and n < least:
                n += n_words(full[i][at + k])
                k += 1
            if n >= least:
                run = tuple(full[i][at : at + k])
                if run in first:
                    gone[i] |= set(range(at, at + k))
                else:
                    first[run] = i
    out = []
    for (doc, t), g in zip(rows, gone):
        if t is None:
            out.append((doc, None, 0))
            continue
        kept, k = [], 0
        for x in t.split("\n"):
            if n_words(x):
                if k not in g:
                    kept.append(x)
                k += 1
            else:
                kept.append(x)
        out.append((doc, "\n".join(kept), len(g)))
    return sorted(out, key=str)


def test_equals_brute_force(spark):
    for seed in range(2):
        rnd = random.Random(seed)
        lines = [" ".join(rnd.choice("abcdefgh") + str(rnd.randrange(4)) for _ in range(rnd.randrange(0, 14))) for _ in range(25)]
        rows = []
        for i in range(60):
            t = [rnd.choice(lines) for _ in range(rnd.randrange(0, 30))]
            if i and rnd.random() < 0.5:
                other = (rows[rnd.randrange(i)][1] or "").split("\n")
                at = rnd.randrange(len(other))
                t[rnd.randrange(len(t) + 1) : 0] = other[at : at + rnd.randrange(1, 12)]
            rows.append((i, "\n".join(t)))
        rows += [(100, None), (101, ""), (102, "\n\n"), (103, "one long line " * 20), (104, "one long line " * 20), (105, "same\n" * 60)]
        rnd.shuffle(rows)
        got = line_runs.drop_repeated_runs(spark.createDataFrame(rows, "doc_id long, text string"), 20)
        assert sorted(map(tuple, got.collect()), key=str) == brute(rows, 20)


def test_other_columns_clashing_names_and_empty_table(spark):
    run = "w " * 30
    df = spark.createDataFrame([(1, run, "a", 7, "q"), (2, run + "\nmore", "b", 8, "r"), (2, run + "\nmore", "b", 8, "r")], "doc_id long, text string, rid string, n_removed int, row string")
    got = sorted(map(tuple, line_runs.drop_repeated_runs(df, 20).collect()))
    assert got == [(1, run, "a", 0, "q"), (2, "more", "b", 1, "r"), (2, "more", "b", 1, "r")]
    assert line_runs.drop_repeated_runs(df.limit(0), 20).columns == df.columns
    assert line_runs.drop_repeated_runs(df.limit(0), 20).count() == 0


def brute_whole(rows, least):
    """For each text: its lines in any run of enough words that an earlier place has, too."""
    full = [[x for x in (t or "").split("\n") if n_words(x)] for _, t in rows]
    first, gone = set(), [set() for _ in rows]
    for i in sorted(range(len(rows)), key=lambda i: rows[i][0]):
        for at in range(len(full[i])):
            for end in range(at + 1, len(full[i]) + 1):
                if sum(map(n_words, full[i][at:end])) >= least:
                    run = tuple(full[i][at:end])
                    if run in first:
                        gone[i] |= set(range(at, end))
                    first.add(run)
    return {doc: (len(g), [x for k, x in enumerate(f) if k not in g]) for (doc, _), f, g in zip(rows, full, gone)}


def test_whole_maximal_runs(spark):
    line = lambda name, n: " ".join(f"{name}{i}" for i in range(n))
    run = [line("a", 60), line("b", 20), line("c", 20)]
    rows = [(1, "\n".join(["x", *run, "y"])), (2, "\n".join(["p", *run, "q"])), (3, "\n".join(run)), (4, "\n".join(run[::-1])), (5, "\n".join(["z", *run[::-1]]))]
    rows += [(6, "\n".join(line("d" + str(k), n) for k, n in enumerate((10, 22, 93, 2)))), (7, "\n".join(line("d" + str(k), n) for k, n in enumerate((10, 22, 93, 2))))]
    rnd = random.Random(4)
    lines = [" ".join(rnd.choice("abcdefgh") + str(rnd.randrange(4)) for _ in range(rnd.randrange(1, 40))) for _ in range(30)]
    for i in range(10, 60):
        t = [rnd.choice(lines) for _ in range(rnd.randrange(0, 20))]
        other = rnd.choice(rows)[1].split("\n")
        at = rnd.randrange(len(other))
        t[rnd.randrange(len(t) + 1) : 0] = other[at : at + rnd.randrange(1, 9)]
        rows.append((i, "\n".join(t)))
    got = line_runs.drop_repeated_runs(spark.createDataFrame(rows, "doc_id long, text string"), 50, whole=True).collect()
    by = {r.doc_id: (r.n_removed, [x for x in (r.text or "").split("\n") if n_words(x)]) for r in got}
    assert by == brute_whole(rows, 50)
    assert by[2] == (3, ["p", "q"]) and by[3] == (3, []) and by[7] == (4, [])


def test_queries_take_whole_runs(spark, tmp_path):
    import corpus_pipeline
    from siftline.llm import queries

    run = "\n".join(" ".join(f"{name}{i}" for i in range(n)) for name, n in (("a", 60), ("b", 20), ("c", 20)))
    docs = spark.createDataFrame([(1, run, len(run)), (2, run + "\nend", len(run) + 4)], "doc_id long, text string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.doc_id: r.text for r in queries.op8_line_runs(spark, str(tmp_path)).collect()}[2] == "end"
    assert {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.drop_repeated_lines(spark, docs, "").collect()}[2] == ("end", 3)
