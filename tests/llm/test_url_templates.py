"""op11: addresses and rules against plain code, the tree against plain dictionaries, and planted hosts."""

import random
import re
from collections import Counter, defaultdict

from siftline.llm import url_templates as ut
from siftline.llm.queries import URL_RULES

PAGES, LABELS = "page_id long, url string, html string, template string", "doc_id long, quality int, toxic int"


def address(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    return ("".join(c.lower() if c.isascii() else c for c in m[1]), m[2]) if m else ("", "")


def of_rules(host, path):
    fit = [(len(h + p), h + p, v) for v, h, p in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit)[1:] if fit else (None, None)


def form(s):
    return "end" if s is None else next((k for k, v in ut.FORMS.items() if re.search(v, s)), "mixed")


def chi(a, b, na, nb):
    both, out = a + b, 0.0
    if not na or not nb:
        return 0.0
    for x, n in ((a, na), (b, nb)):
        e = both * n / (na + nb)
        out += (x - e) ** 2 / e if e > 0 else 0.0
    return out


def plain_tree(pages):
    """pages: (host, path, labelled, bad) -> (host, path) -> template."""
    at = {}
    for host, path, labelled, bad in pages:
        n = at.setdefault((host, path), [(), [s for s in path.split("/") if s], 0, 0, 0])
        n[2], n[3], n[4] = n[2] + 1, n[3] + labelled, n[4] + bad
    while any(n[1] for n in at.values()):
        size, child = Counter(), Counter()
        for (host, _), n in at.items():
            if n[1]:
                size[host, n[0]] += n[2]
                child[host, n[0], n[1][0]] += n[2]
        stats = defaultdict(Counter)
        branch = {}
        for key, n in at.items():
            if not n[1]:
                continue
            node = (key[0], n[0])
            seg = n[1][0]
            c = child[*node, seg]
            name = "**" if size[node] < ut.LEAST else seg if c >= ut.LEAST and c >= ut.SHARE * size[node] else f"<{form(seg)}>"
            branch[key] = name
            if name != "**":
                stats[*node, name].update({"pages": n[2], "labelled": n[3], "bad": n[4], form(n[1][1] if len(n[1]) > 1 else None): n[2]})
        names = {}
        for node in {k[:2] for k in stats}:
            most = lambda s: max((s[x], x) for x in ut.NEXT)[1]
            order = sorted((k for k in stats if k[:2] == node), key=lambda k: (most(stats[k]), (stats[k]["bad"] + 0.5) / (stats[k]["labelled"] + 1), k[2]))
            groups = [[order[0]]]
            for a, b in zip(order, order[1:]):
                x, y = stats[b], stats[a]
                labels = chi(x["bad"], y["bad"], x["labelled"], y["labelled"]) + chi(x["labelled"] - x["bad"], y["labelled"] - y["bad"], x["labelled"], y["labelled"])
                forms = sum(chi(x[f], y[f], x["pages"], y["pages"]) for f in ut.NEXT)
                groups.append([b]) if labels > ut.LABEL_LIMIT or forms > ut.FORM_LIMIT else groups[-1].append(b)
            for g in groups:
                names |= {k: "|".join(sorted(x[2] for x in g)) for k in g}
        for key, name in branch.items():
            n = at[key]
            node = (key[0], n[0])
            n[0], n[1] = n[0] + (names.get((*node, name), name),), [] if name == "**" else n[1][1:]
    return {k: n[0] for k, n in at.items()}


def urls(seed, n=600):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        host = rnd.choice(["a.com", "A.com", "big.net", "big.net", "big.net", "x.example.org", "example.org", "tiny.net"])
        path = rnd.choice([f"/en/{i}", f"/fr/{i}.html", f"/de/{i}/", f"/user/{rnd.choice('abc')}/post/{i}", f"/x{i}/y", "/same/page", "//en//1", "", "/", f"/{'deep/' * 12}{i}"])
        out.append(rnd.choice(["http://", "https://", "HTTPS://"]) + host + path + rnd.choice(["", "?a=/b", "#t/u", "?q#r"]))
    return out + [None, "", "no scheme/x", "://", "http://h?x://y/z", "http://big.net/" + "s" * 20000, "http://e.org\n/a b/ü"]


def test_equals_plain_tree(spark):
    rows = [(i if i % 11 else None, u, "<p>", "clash") for i, u in enumerate(urls(1))]
    labels = [(i, int(i % 3 > 0) if i % 4 else None, 0) for i in range(0, 700, 2)] + [(4, 1, 0), (4, 0, 0), (None, 0, 0)]
    got = {}
    for r in ut.judged(spark.createDataFrame(rows, PAGES), spark.createDataFrame(labels, LABELS), URL_RULES).collect():
        got.setdefault(r.page_id, []).append(r)
    assert sum(map(len, got.values())) == len(rows)
    marks = defaultdict(list)
    for d, q, _ in labels:
        if d is not None and q is not None:
            marks[d].append(q == 0)
    tree = plain_tree([(*address(u), len(marks[i]), sum(marks[i])) for i, u, *_ in rows])
    total = [sum(map(len, (marks[r[0]] for r in rows))), sum(sum(marks[r[0]]) for r in rows)]
    sums = defaultdict(lambda: [0, 0])
    for i, u, *_ in rows:
        host, path = address(u)
        for k in range(len(tree[host, path]) + 1):
            s = sums[host, tree[host, path][:k]]
            s[0], s[1] = s[0] + len(marks[i]), s[1] + sum(marks[i])
    kinds = set()
    for i, u, *_ in rows:
        host, path = address(u)
        t = tree[host, path]
        p = total[1] / total[0]
        for k in range(len(t) + 1):
            p = (sums[host, t[:k]][1] + ut.PRIOR * p) / (sums[host, t[:k]][0] + ut.PRIOR)
        rule, verdict = of_rules(host, path)
        want = (host, path, rule, verdict or ("block" if p >= ut.REJECT else "allow"), "/" + "/".join(t))
        kinds.add((rule, want[3]))
        assert any((r.host, r.path, r.rule, r.verdict, r.template) == want and abs(r.p_bad - p) < 1e-9 for r in got[i]), (u, want, got[i])
    assert {None, "org/", "example.org/es/", "com/fr/", "com/de/"} >= {k[0] for k in kinds} - {"example.org/en/1"}


def test_planted_branches(spark):
    """A host of good articles and bad tag pages: the tag pages go, also those without a label, and the rest stays."""
    rows = [(i, f"http://h.net/{'tag' if i % 3 == 0 else 'news'}/{i}", "", "") for i in range(300)]
    labels = [(i, int(i % 3 > 0), 0) for i in range(0, 300, 2)]
    got = ut.judged(spark.createDataFrame(rows, PAGES), spark.createDataFrame(labels, LABELS), []).collect()
    assert {(r.template, r.verdict) for r in got} == {("/tag/<number>", "block"), ("/news/<number>", "allow")}


def test_large_tables_join_by_parts(spark, monkeypatch):
    rows = [(i, u, "", "") for i, u in enumerate(urls(2, 200))]
    pages, labels = spark.createDataFrame(rows, PAGES), spark.createDataFrame([(i, i % 2, 0) for i in range(150)], LABELS)
    want = sorted(map(repr, ut.judged(pages, labels, URL_RULES).collect()))
    monkeypatch.setattr(ut, "MOST_SENT", 0)
    assert sorted(map(repr, ut.judged(pages, labels, URL_RULES).collect())) == want


def test_longest_rule_wins(spark):
    urls_ = ["http://example.org/en/12", "http://a.example.org/es/", "http://notexample.org/es/x", "http://example.org", "http://x.com/de/1", "http://com/fr/"]
    got = ut.judged(spark.createDataFrame([(i, u, "", "") for i, u in enumerate(urls_)], PAGES), spark.createDataFrame([], LABELS), URL_RULES).collect()
    assert {r.page_id: (r.rule, r.verdict) for r in got} == {
        0: ("example.org/en/1", "block"), 1: ("example.org/es/", "block"), 2: ("org/", "allow"), 3: (None, "allow"), 4: ("com/de/", "block"), 5: ("com/fr/", "allow")
    }


def test_empty_table(spark):
    assert ut.judged(spark.createDataFrame([], PAGES), spark.createDataFrame([], LABELS), URL_RULES).collect() == []
