"""Every query with SQL gives the same rows in Spark and in DuckDB."""

import decimal
import glob
import os

import duckdb
import pytest

from arbiterlake.plans import queries as library

FOLDER = "/root/testdata/sf0.001"


def plain(x):
    return round(float(x), 9) if isinstance(x, (float, decimal.Decimal)) else x


@pytest.fixture(scope="module")
def views():
    con = duckdb.connect()
    for f in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(library.QUERIES))
def test_query(spark, views, name):
    df = library.QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = sorted([tuple(plain(r[c]) for c in columns) for r in df.collect()], key=str)
    if name not in library.ORACLE_SQL:
        assert columns
        return
    cursor = views.cursor().execute(library.ORACLE_SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    want = sorted([tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall()], key=str)
    assert got == want


def test_append_is_offered_every_event(spark, monkeypatch):
    offered, append = [], library.assets.append_once
    monkeypatch.setattr(library.assets, "append_once", lambda log, new, key: offered.append((log.count(), new.count())) or append(log, new, key))
    library.append_new_events(spark, FOLDER)
    events = spark.read.parquet(f"{FOLDER}/events.parquet")
    assert offered == [(events.filter("event_id % 8 <> 4").count(), events.count())]


def test_contexts_of_conversations_hold_every_turn(spark):
    turns = spark.read.parquet(f"{FOLDER}/conversations.parquet")
    want = {}
    for r in turns.orderBy("conv_id", "turn").collect():
        want[r.conv_id] = want.get(r.conv_id, []) + [f"[{r.turn}] {r.text.strip()}"]
    got = {r.run_id: r.context for r in library.QUERIES["context_blocks"](spark, FOLDER).collect()}
    assert turns.count() > len(want) and got == {k: "\n".join(v) for k, v in want.items()}
