"""Every core query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from siftline import registry

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{name}'")
    return con


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_same_rows(spark, db, name):
    df = registry.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    found = db.execute(registry.oracle_sql()[name])
    at = [[x[0] for x in found.description].index(c) for c in columns]
    assert got == sorted((tuple(plain(float(r[i]) if type(r[i]).__name__ == "Decimal" else r[i]) for i in at) for r in found.fetchall()), key=repr)


@pytest.fixture(scope="module")
def larger():
    con, at = duckdb.connect(), DATA.replace("sf0.001", "sf0.01")
    for name in os.listdir(at):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{at}/{name}'")
    return con


#: Columns that decide; a query whose rows all agree in one of them would show nothing.
DECIDING = {
    "decision", "status", "outcome", "derivation", "confidence", "verdict", "kind", "level", "reason", "action", "disposition", "state", "phase", "worst", "rung", "source", "label", "type", "canonical", "tier", "dead", "workplace", "category",
}
#: One value by their nature: the reader of logs that have one type, and columns that a filter fixes.
ONE_VALUED = {("event_idempotence", "event_type")}


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_shows_something(larger, name):
    found = larger.execute(registry.oracle_sql()[name])
    kinds, rows = found.description, found.fetchall()
    assert rows
    if len(rows) < 3:
        return
    for i, (column, kind, *_) in enumerate(kinds):
        if (str(kind) == "BOOLEAN" or column in DECIDING) and (name, column) not in ONE_VALUED:
            assert len({str(r[i]) for r in rows}) > 1, column
