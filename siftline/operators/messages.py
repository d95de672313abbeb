"""Messages linked to applications by a ladder that guesses neither company nor role.

Rungs, first that decides: a person's confirmation; a shared vendor's domain, which vetoes; tokens of a job (its URL, its
store key inside a URL, its requisition id) in mail of a recognised company, which link one job or, if they fit several, none;
what the thread was linked to before; the company's only active application. A thread is inherited only while it has one
link, and never from another company.

Nothing is compared row by row: tokens of messages meet an inverted index of jobs' tokens within the company; domains meet
the suffixes of a sender's domain. The thread rung depends on order, but not on a walk: a thread gets new links only from
the other rungs, and from the last one only at a company's first undecided message, so two grouped minima give each
thread's first two links, and a message is inherited between them.

Defined results: null texts and domains have no tokens; a confirmation of an unknown application is none; equal times go by message key;
a message of no thread inherits nothing; a job without tokens is only found through its application; rows of one message key are one message to the
thread, so keys must be unique.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.shared import stored

URL = r"(?i)https?://[^ \t\r\n<>()\[\]{}]+"
REQUISITION = r"(?i)\b(?:req(?:uisition)?(?:\s*(?:id|number|#|no\.?)\s*)?|(?:job|posting)\s*(?:id|number|#|no\.?)\s*)[:#-]?\s*([a-z][a-z0-9._-]{2,}|[0-9]{3,})\b"
#: Statuses of an open application; hyphenated parts that a store key may have.
ACTIVE, KEY_PARTS = ("drafted", "applied", "in_progress"), 8


def _clean(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), r"\s+", " "))


def _url(x: Column) -> Column:
    return F.rtrim(_clean(x), F.lit(".,;)"))


def message_tokens(text: Column) -> Column:
    """Tokens of a text: its URLs whole and up to each ``?``, the keys inside them, and its requisition ids."""
    urls = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(URL), F.lit(0)), _url)
    cut = F.flatten(F.transform(urls, lambda u: F.transform(F.sequence(F.lit(1), F.size(F.split(u, r"\?"))), lambda n: F.concat(F.lit("url "), F.array_join(F.slice(F.split(u, r"\?"), F.lit(1), n), "?")))))

    def keys(run: Column) -> Column:
        parts = F.split(run, "-")
        spans = F.flatten(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(KEY_PARTS), F.size(parts) - i + 1)), lambda n: F.array_join(F.slice(parts, i, n), "-"))))
        return F.transform(spans, lambda k: F.concat(F.lit("key "), k))

    inside = F.flatten(F.transform(F.flatten(F.transform(urls, lambda u: F.regexp_extract_all(u, F.lit("[a-z0-9-]+"), F.lit(0)))), keys))
    ids = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(REQUISITION), F.lit(1)), lambda x: F.concat(F.lit("req "), _clean(x)))
    return F.array_distinct(F.concat(cut, inside, ids))


def job_tokens(url: Column, key: Column, requisition: Column) -> Column:
    """Tokens that name a job; a requisition with and without its marker."""
    bare = F.regexp_replace(_clean(requisition), r"^req(?:uisition)?\s*[-#:]*\s*", "")
    named = F.array(F.concat(F.lit("url "), _url(url)), F.concat(F.lit("key "), _clean(key)), F.concat(F.lit("req "), _clean(requisition)), F.concat(F.lit("req "), bare))
    return F.array_distinct(F.filter(named, lambda t: F.length(t) > 4))


def suffixes(domain: Column) -> Column:
    """A domain and all above it."""
    parts = F.split(F.lower(F.trim(domain)), r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def companies_of(messages: DataFrame, domains: DataFrame) -> DataFrame:
    """(message_key, company_key): the one company that the domains of the other side stand for. Suffixes are looked up once for each
    domain, not for each message: the shortest ones are common to most messages."""
    at = messages.select("message_key", F.explode(sides()).alias("domain")).where("domain <> ''")
    owner = at.select("domain").distinct().select("domain", F.explode(suffixes(F.col("domain"))).alias("suffix")).join(domains.select(F.lower("domain").alias("suffix"), "company_key").distinct(), "suffix")
    owner = owner.groupBy("domain").agg(F.min("company_key").alias("company_key"), F.count_distinct("company_key").alias("n")).where("n = 1").drop("n")
    owner = at.join(owner, "domain").groupBy("message_key")
    return owner.agg(F.min("company_key").alias("company_key"), F.count_distinct("company_key").alias("n")).where("n = 1").drop("n")


def sides() -> Column:
    """Domains of a message's other side."""
    found = F.when(F.col("direction") == "outbound", F.coalesce("recipient_domains", F.array().cast("array<string>"))).otherwise(F.array("sender_domain"))
    return F.array_distinct(F.transform(found, lambda d: F.lower(F.trim(d))))


def vetoed(vendors: Sequence[str]) -> Column:
    """Whether any domain of a message's other side is a shared vendor's or lies below one."""
    def under(d: Column) -> Column:
        out = F.lit(False)
        for v in vendors:
            out = out | (d == v) | F.endswith(d, F.lit(f".{v}"))
        return out & (d != "")

    return F.coalesce(F.exists(sides(), under), F.lit(False))


def linked(messages: DataFrame, jobs: DataFrame, domains: DataFrame, confirmations: DataFrame, vendors: Sequence[str]) -> DataFrame:
    """(message_key, company_key, slug, job_index, role, derivation, confidence, candidates).

    messages: message_key, thread, at, direction, sender_domain, recipient_domains, text. jobs: company_key, slug, job_index, role,
    status, url, store_key, requisition. domains: domain, company_key. confirmations: message_key, slug, job_index, role."""
    applications = jobs.groupBy("slug").agg(F.min("company_key").alias("company_key"), F.max(F.col("status").isin(*ACTIVE)).alias("active"))
    known = applications.groupBy("company_key").agg(F.sum(F.col("active").cast("int")).alias("n_active"), F.min(F.when(F.col("active"), F.col("slug"))).alias("active_slug"))

    of_role = jobs.groupBy("slug", F.lower(F.trim("role")).alias("_role")).agg(F.min("job_index").alias("by_role"), F.count("*").alias("_n")).where("_n = 1").drop("_n")
    said = confirmations.join(applications.select("slug", F.col("company_key").alias("h_company")), "slug").withColumn("_role", F.lower(F.trim("role"))).drop("role")
    by_index = jobs.select("slug", "job_index", F.lit(True).alias("_there"))
    said = said.join(by_index, ["slug", "job_index"], "left").join(of_role, ["slug", "_role"], "left")
    said = said.withColumn("h_index", F.when(F.col("_there"), F.col("job_index")).when(F.col("job_index").isNull(), F.col("by_role")))
    said = said.groupBy("message_key").agg(F.min(F.struct(F.col("slug").alias("slug"), "h_company", "h_index")).alias("h"))

    at = messages.withColumn("vetoed", vetoed(vendors)).join(companies_of(messages, domains), "message_key", "left")
    index = jobs.select("company_key", "slug", "job_index", F.explode(job_tokens(F.col("url"), F.col("store_key"), F.col("requisition"))).alias("token"))
    found = at.where("company_key is not null and not vetoed").select("message_key", "company_key", F.explode(message_tokens(F.col("text"))).alias("token"))
    found = found.join(index, ["company_key", "token"]).groupBy("message_key", "slug", "job_index").agg(F.first("company_key").alias("company_key"))
    found = found.groupBy("message_key").agg(F.min(F.struct("slug", "job_index")).alias("t"), F.count("*").alias("n_jobs"), F.array_sort(F.collect_set("slug")).alias("t_slugs"))

    at = at.select("message_key", "thread", F.struct("at", "message_key").alias("place"), "company_key", "vetoed").join(said, "message_key", "left").join(found, "message_key", "left").join(known, "company_key", "left")
    own = F.when(F.col("h").isNotNull(), "human_confirmed").when(F.col("vetoed"), "shared_ats_vendor").when(F.col("n_jobs") == 1, "direct_rule").when(F.col("n_jobs") > 1, "structured_token_ambiguous")
    human = F.col("h").isNotNull()
    at = at.withColumn("own", own).withColumns({
        "o_company": F.when(human, F.col("h.h_company")).otherwise(F.col("company_key")), "o_slug": F.when(human, F.col("h.slug")).otherwise(F.when(own == "direct_rule", F.col("t.slug"))),
        "o_index": F.when(human, F.col("h.h_index")).otherwise(F.when(own == "direct_rule", F.col("t.job_index"))),
    })

    at = stored(at, "messages")

    # links of a thread by where they first stand: those of the upper rungs, and the last rung's at a company's first open message
    link = [F.col("o_company").alias("l_company"), F.col("o_slug").alias("l_slug"), F.col("o_index").alias("l_index")]
    sure = at.where("thread is not null and o_slug is not null").groupBy("thread", *link).agg(F.min("place").alias("first"))
    begins = sure.groupBy("thread", F.col("l_company").alias("company_key")).agg(F.min("first").alias("sure_from"))
    open_ = at.where("thread is not null and own is null and n_active = 1").groupBy("thread", "company_key").agg(F.min("place").alias("first"), F.first("active_slug").alias("l_slug"))
    active = open_.join(begins, ["thread", "company_key"], "left").where("sure_from is null or first < sure_from")
    links = sure.unionByName(active.select("thread", F.col("company_key").alias("l_company"), "l_slug", F.lit(None).cast(jobs.schema["job_index"].dataType).alias("l_index"), "first"))
    links = links.groupBy("thread", "l_company", "l_slug", "l_index").agg(F.min("first").alias("first"))

    def first_two(keys: list[str], name: str) -> DataFrame:
        nth = F.row_number().over(Window.partitionBy(*keys).orderBy("first"))
        two = links.withColumn("_n", nth).where("_n <= 2").withColumn("l", F.struct("first", "l_company", "l_slug", "l_index"))
        return two.groupBy(*keys).agg(F.max(F.when(F.col("_n") == 1, F.col("l"))).alias(f"{name}1"), F.max(F.when(F.col("_n") == 2, F.col("l"))).alias(f"{name}2"))

    at = at.join(first_two(["thread"], "any"), "thread", "left")
    at = at.join(first_two(["thread", "l_company"], "own").withColumnRenamed("l_company", "company_key"), ["thread", "company_key"], "left")
    one, two = (F.when(F.col("company_key").isNull(), F.col(f"any{n}")).otherwise(F.col(f"own{n}")) for n in "12")
    at = at.withColumn("one", F.when(one["first"] < F.col("place"), one)).withColumn("two", F.when(two["first"] < F.col("place"), two))

    rung = F.coalesce("own", F.when(F.col("two").isNotNull(), "thread_ambiguous").when(F.col("one").isNotNull(), "thread_inheritance").when(F.col("n_active") > 0, "temporal_correlation").otherwise("unresolved"))
    at = at.withColumn("derivation", rung)
    inherits, alone = F.col("derivation") == "thread_inheritance", (F.col("derivation") == "temporal_correlation") & (F.col("n_active") == 1)
    slug = F.coalesce("o_slug", F.when(inherits, F.col("one.l_slug")).when(alone, F.col("active_slug")))
    confidence = F.when(F.col("derivation").isin("human_confirmed", "direct_rule"), "exact").when(inherits | alone, "strong").when(F.col("derivation").isin("shared_ats_vendor", "unresolved"), "none").otherwise("weak")
    company = F.when(F.col("derivation") == "shared_ats_vendor", F.lit(None)).when(inherits, F.coalesce(F.when(F.col("n_active").isNotNull(), F.col("company_key")), F.col("one.l_company"))).otherwise(F.when(human, F.col("o_company")).when(F.col("n_active").isNotNull(), F.col("company_key")))
    several = applications.where("active").groupBy("company_key").agg(F.array_sort(F.collect_set("slug")).alias("active_slugs"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    at = at.join(several, "company_key", "left")
    candidates = F.when(F.col("derivation") == "structured_token_ambiguous", F.col("t_slugs")).when(F.col("derivation") == "thread_ambiguous", F.array_sort(F.array_distinct(F.array("one.l_slug", "two.l_slug"))))
    candidates = candidates.when((F.col("derivation") == "temporal_correlation") & ~alone, F.col("active_slugs"))
    at = at.select("message_key", company.alias("company_key"), slug.alias("slug"), F.coalesce("o_index", F.when(inherits, F.col("one.l_index"))).alias("job_index"), "derivation", confidence.alias("confidence"), F.coalesce(candidates, F.array().cast("array<string>")).alias("candidates"))
    return at.join(jobs.select("slug", "job_index", "role"), ["slug", "job_index"], "left").select("message_key", "company_key", "slug", "job_index", "role", "derivation", "confidence", "candidates")
