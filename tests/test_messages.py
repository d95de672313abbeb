"""The link ladder against a walk through the messages in order of time."""

import random
import re

from siftline.operators import messages as M

VENDORS = ("greenhouse.io", "lever.co")


def walk(messages, jobs, domains, confirmations):
    """One message after another, as a person would."""
    apps, threads, out = {}, {}, {}
    for j in jobs:
        apps.setdefault(j[1], []).append(j)
    for key, thread, at, direction, sender, recipients, text in sorted(messages, key=lambda m: (m[2], m[0])):
        seen = lambda d, of: d == of or d.endswith("." + of)
        said = [c for c in confirmations if c[0] == key and c[1] in apps]
        link = None
        sides = [d for d in ((recipients or []) if direction == "outbound" else [sender]) if d]
        found = set()
        for d in sides:
            owners = {c for x, c in domains if seen(d, x)}
            if len(owners) == 1:
                found |= owners
        company = found.pop() if len(found) == 1 else None
        of = {s: js for s, js in apps.items() if company is not None and js[0][0] == company}
        shown = company if of else None
        if said:
            _, slug, index, role = said[0]
            fit = [j for j in apps[slug] if j[2] == index] if index is not None else [j for j in apps[slug] if j[3].lower() == (role or "").lower()]
            link = (apps[slug][0][0], slug, fit[0][2] if len(fit) == 1 else None, "human_confirmed", "exact", [])
        elif any(seen(d, v) for d in sides for v in VENDORS):
            link = (None, None, None, "shared_ats_vendor", "none", [])
        else:
            urls = [u.rstrip(".,;)").lower() for u in re.findall(r"https?://[^\s<>()\[\]{}]+", text or "", re.I)]
            ids = {x.lower() for x in re.findall(M.REQUISITION, text or "")}
            hit = []
            for js in of.values():
                for _, slug, index, _, _, url, store, req in js:
                    u, bare = (url or "").lower().rstrip(".,;)"), re.sub(r"^req(?:uisition)?\s*[-#:]*\s*", "", (req or "").lower())
                    if (u and any(x == u or x.startswith(u + "?") for x in urls)) or (store and any(re.search(rf"(?<![a-z0-9]){re.escape(store)}(?![a-z0-9])", x) for x in urls)) or ({(req or "").lower(), bare} - {""}) & ids:
                        hit.append((slug, index))
            if len(hit) == 1:
                link = (company, *hit[0], "direct_rule", "exact", [])
            elif hit:
                link = (shown, None, None, "structured_token_ambiguous", "weak", sorted({s for s, _ in hit}))
            else:
                prior = list(dict.fromkeys(x for x in threads.get(thread, []) if company is None or x[0] == company)) if thread is not None else []
                active = sorted(s for s, js in of.items() if any(j[4] in M.ACTIVE for j in js))
                if len(prior) == 1:
                    link = (shown or prior[0][0], prior[0][1], prior[0][2], "thread_inheritance", "strong", [])
                elif prior:
                    link = (shown, None, None, "thread_ambiguous", "weak", sorted({p[1] for p in prior[:2]}))
                elif len(active) == 1:
                    link = (company, active[0], None, "temporal_correlation", "strong", [])
                elif active:
                    link = (company, None, None, "temporal_correlation", "weak", active)
                else:
                    link = (shown, None, None, "unresolved", "none", [])
        if link[1] and thread is not None:
            threads.setdefault(thread, []).append(link[:3])
        role = next((j[3] for j in apps.get(link[1], []) if link[2] is not None and j[2] == link[2]), None)
        out[key] = (*link[:3], role, *link[3:])
    return out


def world(seed, n=400):
    rnd = random.Random(seed)
    jobs = []
    for c in range(12):
        for a in range(rnd.choice([1, 1, 2, 3])):
            for i in range(rnd.choice([1, 1, 2])):
                status = rnd.choice(["applied", "rejected", "rejected", "in_progress", "ignored"])
                x = f"{c}{a}{i}"
                jobs.append((f"co{c}", f"app-{c}-{a}", i, rnd.choice(["Engineer", "Analyst"]), status, f"https://jobs.ex/{x}" if c % 3 else None, f"ex-{x}", f"REQ-9{x}"))
    domains = [(f"c{c}.com", f"co{c}") for c in range(13)] + [("c1.com", "co2"), ("both.com", "co3"), ("both.com", "co4"), ("eu.c5.com", "co6")]
    texts = ["", None, "hello", "see https://jobs.ex/{x}?ref=1.", "Job ID: 9{x}", "requisition REQ-9{x}", "https://a.b/path/ex-{x}/apply, thanks", "https://jobs.ex/{x} or https://jobs.ex/{y}", "ex-{x} 9{x}", "https://jobs.ex/{x}0"]
    messages = []
    for k in range(n):
        c = rnd.randrange(13)
        x, y = ("".join(j[6][3:]) for j in rnd.sample([j for j in jobs if j[0] == f"co{c}"] * 2 or jobs, 2))
        domain = rnd.choice([f"c{c}.com", f"mail.c{c}.com", "both.com", "x.eu.c5.com", "other.org", None, "boards.greenhouse.io"] + [f"c{c}.com"] * 4)
        text = rnd.choice(texts)
        messages.append((f"m{k:04}", rnd.choice([f"t{c}", f"t{c}", f"t{k % 9}", None]), k // 3, rnd.choice(["inbound", "inbound", "outbound"]), domain, [domain, f"c{c}.com"] if k % 5 else [domain], text and text.format(x=x, y=y)))
    confirmations = [(f"m{k:04}", rnd.choice(jobs)[1], rnd.choice([0, 1, 7, None]), rnd.choice(["engineer", None])) for k in range(0, n, 23)] + [("m0001", "app-none", 0, None)]
    return messages, jobs, domains, confirmations


def test_equals_walk(spark):
    kinds = set()
    for seed in (1, 2):
        messages, jobs, domains, confirmations = world(seed)
        got = M.linked(
            spark.createDataFrame(messages, "message_key string, thread string, at int, direction string, sender_domain string, recipient_domains array<string>, text string"),
            spark.createDataFrame(jobs, "company_key string, slug string, job_index int, role string, status string, url string, store_key string, requisition string"),
            spark.createDataFrame(domains, "domain string, company_key string"), spark.createDataFrame(confirmations, "message_key string, slug string, job_index int, role string"), VENDORS,
        ).collect()
        want = walk(messages, jobs, domains, confirmations)
        assert len(got) == len(messages)
        for r in got:
            assert (*tuple(r)[1:7], r.candidates) == (*want[r.message_key][:6], want[r.message_key][6]), (r, want[r.message_key], [m for m in messages if m[0] == r.message_key])
        kinds |= {r.derivation for r in got}
    assert kinds == {"human_confirmed", "shared_ats_vendor", "direct_rule", "structured_token_ambiguous", "thread_inheritance", "thread_ambiguous", "temporal_correlation", "unresolved"}


def test_empty_tables(spark):
    e = lambda s: spark.createDataFrame([], s)
    got = M.linked(
        e("message_key string, thread string, at int, direction string, sender_domain string, recipient_domains array<string>, text string"),
        e("company_key string, slug string, job_index int, role string, status string, url string, store_key string, requisition string"),
        e("domain string, company_key string"), e("message_key string, slug string, job_index int, role string"), VENDORS,
    )
    assert got.count() == 0
