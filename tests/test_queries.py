"""Queries against the other engine, on the smallest tables."""

import os
import re

import duckdb
import pytest

from tidemerge.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
NAMES = ["merge_full", "merge_delta", "write_ops_last_wins", "push_outcomes", "sync_report", "mutate_edit", "mutate_move", "add_collision", "upgrade_full_dedup", "rekey_rebuild", "hub_project_left", "hub_absorb_manual", "hub_absorb_incoming", "soft_delete_load", "enumerate_delta", "unified_view", "merge_vanished_first", "sync_event_order", "push_remote_server", "store_load", "store_objects", "store_checkpoints", "sync_full_override", "rekey_unlinked", "stream_sync", "mutate_in_order", "upgrade_without_body"]


@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"create view {f[:-8]} as select * from '{SF}/{f}'")
    told = con.sql(SQL[name])
    names = sorted(d[0] for d in told.description)
    want = sorted((tuple(r[[d[0] for d in told.description].index(c)] for c in names) for r in told.fetchall()), key=repr)
    df = QUERIES[name](spark, SF)
    assert sorted(df.columns) == names
    assert sorted((tuple(r) for r in df.select(*names).collect()), key=repr) == want


def test_full_and_delta_give_the_same_replica(spark):
    from tidemerge import fixtures as fx
    from tidemerge.operators.ops import apply_ops
    from tidemerge.plans import merge

    rows = fx.replica(spark, SF)
    full = merge.decide(merge.full_candidates(rows, fx.remote_items(spark, SF))).checkpoint()
    delta = merge.decide(merge.delta_candidates(rows, *fx.delta(spark, SF))).checkpoint()
    a, b = (apply_ops(rows, merge.write_ops(d)).checkpoint() for d in (full, delta))
    assert a.count() == b.count() and a.exceptAll(b).count() == 0


def test_every_outcome_occurs():
    """Each arm that a query is there to show has rows in it, at the scale at which results are compared."""
    con = duckdb.connect()
    for f in os.listdir(SF.replace("0.001", "0.01")):
        con.sql(f"create view {f[:-8]} as select * from '{SF.replace('0.001', '0.01')}/{f}'")
    seen = lambda name, column: {r[0] for r in con.sql(f"SELECT DISTINCT {column} FROM ({SQL[name]})").fetchall()}
    assert seen("merge_vanished_first", "arm") >= {"M12", "M07", "M08"}
    assert seen("rekey_rebuild", "outcome") == {"carried", "fresh", "resurrected", "lost", "gone", "moved"}
    assert seen("rekey_rebuild", "CASE WHEN outcome = 'carried' THEN status || (object LIKE 'e%') END") >= {"Dirtytrue", "Dirtyfalse", "Conflicttrue", "Tombstonefalse", "Cleanfalse"}
    assert seen("hub_project_left", "status") == {"Clean", "Dirty", "Tombstone", "Conflict", "Created"}
    assert seen("upgrade_without_body", "level") == {1, 2}
    assert seen("push_unmatched", '"case"') >= {"P1", "P2", "P3", "P4", "P5", "P6", "P8"}
    assert con.sql(SQL["stale_dedup"]).fetchall() and con.sql(SQL["lingering"]).fetchall()
    assert {r[0] for r in con.sql(f"SELECT DISTINCT outcome FROM ({SQL['push_remote']})").fetchall()} == {"Accepted", "Rejected"}


@pytest.mark.parametrize("conflict", ["manual", "keep_both"])
def test_decisions_applied_beside_their_rows(spark, conflict):
    """As apply_ops, without its join and aggregation (only copies of KEEP_BOTH need these)."""
    from tidemerge import fixtures as fx
    from tidemerge.model import SyncOptions
    from tidemerge.operators.ops import apply_ops, apply_own
    from tidemerge.plans import merge

    rows, options = fx.replica(spark, SF), SyncOptions(conflict=conflict)
    d = merge.decide(merge.full_candidates(rows, fx.remote_items(spark, SF)), options).checkpoint()
    want, got = apply_ops(rows, merge.write_ops(d)), apply_own(d, options)
    assert want.count() == got.count() > 0 and want.exceptAll(got.select(*want.columns)).isEmpty()
    if conflict == "manual":
        assert not {"Aggregate", "Join"} & set(re.findall("Aggregate|Join", got._jdf.queryExecution().executedPlan().toString()))


def test_stale_dedup_applies_once(spark):
    """The merge is neither joined a second time nor folded by key: one table of the applied replica, read by all that follow."""
    plan = QUERIES["stale_dedup"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "max_by" not in plan and "orders.parquet" not in plan and "FullOuter" not in plan
