"""What the outcomes of pushed changes mean for the replica."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import DROP, EVENT, OP
from ..plans import text as x
from ..plans.merge import rebase

KEY = ["collection", "handle"]


def confirm(decisions: DataFrame, results: DataFrame) -> DataFrame:
    """(collection, handle, case, ops, events, pushed, rejected) for each result (collection, handle, outcome, assigned, revision,
    and position seq). What isn't reported stays as it is and is pushed again by the next sync."""
    each = decisions.select(*KEY, F.explode_outer(F.array(F.struct("push", "stash"))).alias("x"))
    waiting = each.where("x.push IS NOT NULL").select(*KEY, "x.push", "x.stash")
    d = results.join(waiting, KEY, "left")
    ok = "outcome = 'Accepted' AND push IS NOT NULL"
    case = x.case(("outcome = 'Rejected'", "'P6'"), (f"{ok} AND push.kind = 'SetFlags'", "'P1'"), (f"{ok} AND push.kind = 'Update'", "'P2'"), (f"{ok} AND push.kind = 'Remove'", "'P3'"), (f"{ok} AND push.kind = 'Add'", "IF(assigned IS NOT NULL, 'P4', 'P5')"), otherwise="'P8'")
    old = "coalesce(stash.base.flags, CAST(array() AS array<string>))"
    status = x.case(("stash.status = 'Tombstone'", "'Tombstone'"), (f"stash.flags = {old}", "'Clean'"), otherwise="'Dirty'")
    put = lambda handle, row: x.op("UpsertPlacement", "collection", handle, row)
    updated = x.with_("stash", status=status, base=x.base_of(old, "revision", "stash.object"))
    placed = x.with_("stash", handle="assigned", status="'Clean'", origin="NULL", base=x.base_of("stash.flags", "revision", "stash.object"))
    drop = x.op(DROP, "collection", "handle")
    ops = x.case(("case = 'P1'", x.array_of(OP, put("handle", rebase("stash", "stash.flags")))), ("case = 'P2'", x.array_of(OP, put("handle", updated))), ("case IN ('P3', 'P5')", x.array_of(OP, drop)), ("case = 'P4'", x.array_of(OP, drop, put("assigned", placed))), otherwise=x.array_of(OP))
    told = lambda k, h: x.array_of(EVENT, x.event(k, h))
    events = x.case(("case = 'P1'", told("FlagsChanged", "handle")), ("case = 'P2'", told("ContentChanged", "handle")), ("case = 'P3'", told("Vanished", "handle")), ("case = 'P4'", told("Created", "assigned")), ("case = 'P5'", told("Created", "handle")), otherwise=x.array_of(EVENT))
    d = d.selectExpr("*", f"{case} AS case")
    return d.selectExpr(*KEY, "seq", "case", f"{ops} AS ops", f"{events} AS events", "IF(outcome = 'Accepted', 1L, 0L) AS pushed", "IF(outcome = 'Rejected', 1L, 0L) AS rejected")


def confirm_events(confirmed: DataFrame) -> DataFrame:
    """Events of the push, after those of the merge, in order of the results."""
    each = confirmed.select("collection", "seq", F.explode_outer("events").alias("e")).where("e IS NOT NULL")
    return each.select(F.lit(1).alias("phase"), "collection", "seq", "e.*")


def confirm_ops(confirmed: DataFrame) -> DataFrame:
    """The write operations, after those of the merge."""
    each = confirmed.select(F.col("handle").alias("of"), "seq", F.posexplode_outer("ops").alias("k", "op")).where("op IS NOT NULL")
    return each.select(F.lit(1).alias("phase"), "of", (F.col("seq") * 2 + F.col("k")).cast("int").alias("seq"), "op.*")


def report(decisions: DataFrame, confirmed: DataFrame | None = None) -> DataFrame:
    """One row: pulled, pushed, conflicts, rejected, refreshed, by collection."""
    merged = decisions.groupBy("collection").agg(*[F.sum(x).alias(x) for x in ("pulled", "conflicts", "refreshed")])
    zero = F.lit(0).cast("long")
    if confirmed is None:
        return merged.select("collection", "pulled", zero.alias("pushed"), "conflicts", zero.alias("rejected"), "refreshed")
    done = confirmed.groupBy("collection").agg(F.sum("pushed").alias("pushed"), F.sum("rejected").alias("rejected"))
    both = merged.join(done, "collection", "full_outer")
    return both.select("collection", *[F.coalesce(F.col(x), zero).alias(x) for x in ("pulled", "pushed", "conflicts", "rejected", "refreshed")])
