"""Names of all queries of the core library and of the SQL that gives the same rows."""

from __future__ import annotations


def queries():
    from siftline.plans import allocation, keeping, mail, more, pages, postings, rules, stores, tracker  # noqa: F401  (they register their queries)
    from siftline.plans.queries import QUERIES
    from siftline.streaming.queries import STREAMS

    return QUERIES | STREAMS


def oracle_sql():
    from siftline.plans import allocation, keeping, mail, more, pages, postings, rules, stores, tracker  # noqa: F401
    from siftline.plans.queries import ORACLE
    from siftline.streaming.queries import ORACLE as STREAM_ORACLE

    return ORACLE | STREAM_ORACLE
