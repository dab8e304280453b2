"""Registered queries against their SQL, on the smallest tables."""

import os

import pytest

duckdb = pytest.importorskip("duckdb")

from tessera.plans import registry  # noqa: E402

DATA = "/root/testdata/sf0.001"
SOME = ("f3_dsl_events", "k1_upsert_symbols", "a2_rollup_findings", "a15_bus_factor", "j15_snapshot_reconcile", "t3_bm25", "w2_round_robin_balance", "t20_task_route", "a19_trimmed_mean", "j10_call_chain_bfs")


def cells(rows):
    def cell(v):
        return f"{v:.6g}" if isinstance(v, float) else str(v)

    return sorted(tuple(cell(v) for v in r) for r in rows)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
@pytest.mark.parametrize("name", SOME)
def test_query(spark, name):
    q = registry.load()[name]
    con = duckdb.connect()
    for t in os.listdir(DATA):
        con.sql(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{DATA}/{t}'")
    got = q.run(registry.Tables(spark, DATA))
    want = con.sql(q.sql)
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    assert cells(tuple(r[n] for n in names) for r in got.collect()) == cells(want.select(*[f'"{n}"' for n in names]).fetchall())


def test_every_oracle_has_a_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())
