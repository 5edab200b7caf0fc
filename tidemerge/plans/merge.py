"""The three-way merge: candidates, one decision for each handle, and what follows from it.

``decide`` is a projection over the joined sides. It names the arm taken on membership, content and flags, and gives the ordered
write operations, the change to push, the events and the counters. It holds column expressions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import flags as fl
from ..model import CHANGE, CLEAN, DROP, EVENT, FULL, KEEP_BOTH, MANUAL, MARK, OP, ORIGIN, PLACEMENT, PREFER_LOCAL, PREFER_REMOTE, PROBED, REMOTE_ITEM, SyncOptions, as_row, null, struct
from . import text as x

KEY = ["collection", "handle"]


def latest(items: DataFrame, order: Column) -> DataFrame:
    """One row for each key; of several the last in order stands."""
    rest = [c for c in items.columns if c not in KEY]
    return items.groupBy(*KEY).agg(F.max_by(F.struct(*rest), order).alias("x")).select(*KEY, "x.*")


def _local(placements: DataFrame) -> DataFrame:
    return placements.select(*KEY, as_row().alias("l"))


def _remote(items: DataFrame) -> DataFrame:
    return items.select(*KEY, struct(REMOTE_ITEM, handle=F.col("handle"), flags=fl.canonical(F.col("flags")), revision=F.col("revision")).alias("r"))


def full_candidates(placements: DataFrame, items: DataFrame) -> DataFrame:
    """(collection, handle, l, r) against a complete snapshot: what isn't listed is gone. One full outer join on the key."""
    return _local(placements).join(_remote(items), KEY, "full_outer")


def delta_candidates(placements: DataFrame, items: DataFrame, vanished: DataFrame) -> DataFrame:
    """(collection, handle, l, r) against an incremental snapshot.

    Candidates are what is listed, what vanished and what waits to be pushed. Vanished goes before listed. A waiting row that isn't
    listed is held against its own base, at the revision last seen, so nothing seems to have changed remotely.
    """
    gone = vanished.select(*KEY).distinct().withColumn("gone", F.lit(True))
    told = _remote(items).join(gone, KEY, "full_outer").withColumn("told", F.lit(True))
    local = _local(placements)
    # The snapshot is the small side: it can be sent to the replica's rows, and of these only candidates are ever shuffled.
    known = local.join(told, KEY, "left").where(F.col("told") | (F.col("l.status") != CLEAN))
    new = told.join(local.select(*KEY).join(told.select(*KEY), KEY, "left_semi"), KEY, "left_anti").withColumn("l", null(PLACEMENT))
    own = x.item(handle="handle", flags="l.base.flags", revision="coalesce(l.conflict_revision, l.base.revision)")
    remote = F.expr(f"CASE WHEN gone THEN NULL WHEN told THEN r WHEN l.base IS NOT NULL THEN {own} END")
    return known.unionByName(new).select(*KEY, "l", remote.alias("r"))


def settled(row: str) -> str:
    return f"IF({row}.status = 'Conflict', 'Conflict', 'Clean')"


def pull_flags(row: str, flags: str) -> str:
    """flags become current and base."""
    return x.with_(row, flags=flags, status=settled(row), base=x.base_of(flags, f"{row}.base.revision", f"{row}.base.object"))


def rebase(row: str, flags: str) -> str:
    """flags become the base."""
    return x.with_(row, status=settled(row), base=x.base_of(flags, f"{row}.base.revision", f"{row}.base.object"))


def pull_content(row: str, revision: str) -> str:
    """The old body goes; the base takes the new revision."""
    base = f"IF({row}.base IS NOT NULL, {x.base_of(f'{row}.base.flags', revision, 'NULL')}, NULL)"
    return x.with_(row, object="NULL", level=str(PROBED), base=base)


def probed(collection: str, item: str) -> str:
    """The row of a newly seen item."""
    return x.placement(collection=collection, handle=f"{item}.handle", level=str(PROBED), sort_key="''", flags=f"{item}.flags", status="'Clean'", base=x.base_of(f"{item}.flags", f"{item}.revision", "NULL"))


def _arms(options: SyncOptions) -> str:
    return x.case(
        ("tomb AND based AND listed AND newer", "'M01'"),
        (f"tomb AND based AND listed AND {not options.push}", "'M02'"),
        ("tomb AND based AND listed AND edited AND l.origin IS NOT NULL", "'M03'"),
        ("tomb AND based AND listed", "'M04'"),
        ("tomb AND NOT listed", "'M05'"),
        ("present AND based AND NOT listed AND l.status IN ('Dirty', 'Conflict') AND edited", "'M06'"),
        ("present AND based AND NOT listed", "'M07'"),
        ("NOT present AND NOT based AND listed", "'M08'"),
        ("present AND listed", "'M09'"),
        (f"present AND l.status = 'Created' AND {options.may('add')}", "'M10'"),
        ("present", "'M11'"),
        otherwise="'M12'",
    )


def _content_arms(options: SyncOptions) -> str:
    clash = {MANUAL: "C08a", PREFER_REMOTE: "C08b", PREFER_LOCAL: "C08c" if options.may("content") else "C08a", KEEP_BOTH: "C08d"}[options.conflict]
    ours = "l.status = 'Dirty' AND edited"
    arms = x.case(
        ("NOT based AND l.object IS NOT NULL AND r.revision IS NOT NULL", "'C01'"),
        ("NOT based", "'C02'"),
        ("l.status = 'Conflict' AND r.revision IS NOT NULL AND NOT r.revision <=> l.conflict_revision", "'C03'"),
        ("l.status = 'Conflict'", "'C04'"),
        (f"{ours} AND newer", f"'{clash}'"),
        (ours, "'C07'"),
        ("newer", "'C06'"),
        otherwise="'C05'",
    )
    return f"IF(arm = 'M09', {arms}, NULL)"


def decide(candidates: DataFrame, options: SyncOptions = SyncOptions()) -> DataFrame:
    """(collection, handle, l, r, arm, content_arm, flag_arm, merged, ops, push, stash, events and the counters pulled, conflicts,
    refreshed) for each candidate. stash is the row that an accepted push settles."""
    may = options.may
    steps: list[dict[str, str]] = [
        {
            "tomb": "coalesce(l.status = 'Tombstone', false)",
            "present": "coalesce(l.status <> 'Tombstone', false)",
            "based": "l.base IS NOT NULL",
            "listed": "r IS NOT NULL",
            "newer": "r.revision IS NOT NULL AND NOT r.revision <=> l.base.revision",
            "edited": "l.base IS NOT NULL AND l.object IS NOT NULL AND NOT l.object <=> l.base.object",
        },
        {"arm": _arms(options)},
        {"content_arm": _content_arms(options)},
        {
            "pulls": "coalesce(content_arm IN ('C06', 'C08b', 'C08d'), false)",
            "marks": "coalesce(content_arm IN ('C01', 'C08a'), false)",
            "content_push": f"coalesce((content_arm = 'C07' AND {may('content')}) OR content_arm = 'C08c', false)",
        },
        {"row": x.case(("marks", x.with_("l", status="'Conflict'", conflict_revision="r.revision")), ("content_arm = 'C03'", x.with_("l", conflict_revision="r.revision")), ("pulls", pull_content("l", "r.revision")), otherwise="l")},
        {"flagged": "arm = 'M09' AND NOT content_push"},
        {"merged": f"IF(flagged AND based, {fl.merge_text('row.base.flags', 'row.flags', 'r.flags')}, NULL)"},
        {
            "flag_arm": "IF(flagged, "
            + x.case(
                ("NOT based", "'F00'"),
                ("merged = row.flags AND merged = r.flags", "IF(row.flags <> row.base.flags OR (row.status = 'Dirty' AND NOT (row.object IS NOT NULL AND NOT row.object <=> row.base.object)), 'F01', 'F01-')"),
                ("merged = r.flags", "'F02'"),
                ("merged = row.flags", "'F03'"),
                otherwise="'F04'",
            )
            + ", NULL)"
        },
    ]
    raised = x.with_("l", status="'Created'", conflict_revision="NULL", base="NULL", origin="NULL")
    double = x.with_("l", handle=f"concat(handle, '{MARK}keepboth')", link_id="NULL", level=str(FULL), status="'Created'", conflict_revision="NULL", base="NULL", origin="NULL")
    folded = x.with_("row", flags="merged")
    put = lambda row: x.op("UpsertPlacement", "collection", "handle", row)
    ops = x.case(
        ("arm IN ('M01', 'M08')", x.array_of(OP, put(probed("collection", "r")))),
        ("arm IN ('M02', 'M05', 'M07')", x.array_of(OP, x.op(DROP, "collection", "handle"))),
        ("arm = 'M06'", x.array_of(OP, put(raised))),
        otherwise="concat("
        + ", ".join([
            x.case(("content_arm = 'C08d'", x.array_of(OP, x.op("UpsertPlacement", "collection", f"concat(handle, '{MARK}keepboth')", double))), otherwise=x.array_of(OP)),
            x.case(("marks OR pulls OR content_arm = 'C03'", x.array_of(OP, put("row"))), otherwise=x.array_of(OP)),
            x.case(("flag_arm = 'F00'", x.array_of(OP, put(pull_flags("row", "r.flags")))), ("flag_arm = 'F01'", x.array_of(OP, put(rebase("row", "merged")))), ("flag_arm = 'F02'", x.array_of(OP, put(pull_flags("row", "merged")))), ("flag_arm = 'F04'", x.array_of(OP, put(folded))), otherwise=x.array_of(OP)),
        ])
        + ")",
    )
    change = lambda kind, **given: x.change(kind, handle="handle", **given)
    update = lambda match: change("Update", object="l.object", if_match=match)
    pushed = [
        ("arm = 'M03'", may("content"), update("l.base.revision")),
        ("arm = 'M04'", may("remove"), change("Remove", to="l.origin.collection", if_match="l.base.revision")),
        ("arm = 'M06'", may("add"), change("Add", link_id="l.link_id", flags="l.flags", object="l.object")),
        ("arm = 'M10'", True, change("Add", link_id="l.link_id", flags="l.flags", origin="l.origin", object="l.object")),
        ("content_arm = 'C07'", may("content"), update("l.base.revision")),
        ("content_arm = 'C08c'", True, update("r.revision")),
        ("flag_arm IN ('F03', 'F04')", may("flags"), change("SetFlags", flags="merged")),
    ]
    told = lambda kind: x.array_of(EVENT, x.event(kind, "handle"))
    silent = x.array_of(EVENT)
    moved = x.case(("marks", told("Conflicted")), ("pulls", told("ContentChanged")), otherwise=silent)
    flags = x.case(("flag_arm IN ('F00', 'F02', 'F04')", told("FlagsChanged")), otherwise=silent)
    steps.append({
        "ops": ops,
        "push": x.case(*[(c, v) for c, allowed, v in pushed if allowed], otherwise=x.null(CHANGE)),
        "events": x.case(("arm IN ('M01', 'M08')", told("Added")), ("arm = 'M07'", told("Vanished")), otherwise=f"concat({moved}, {flags})"),
        "pulled": "IF(arm IN ('M01', 'M07', 'M08') OR coalesce(flag_arm IN ('F00', 'F02', 'F04'), false), 1L, 0L)",
        "conflicts": "IF(marks, 1L, 0L)",
        "refreshed": "IF(pulls, 1L, 0L)",
    })
    steps.append({"stash": "IF(push IS NOT NULL, " + x.case(("arm = 'M06'", raised), ("flag_arm IN ('F03', 'F04')", folded), otherwise="l") + ", NULL)"})
    d = candidates
    for step in steps:
        d = d.selectExpr("*", *[f"{v} AS {k}" for k, v in step.items()])
    return d.select(*KEY, "l", "r", "arm", "content_arm", "flag_arm", "merged", "ops", "push", "stash", "events", "pulled", "conflicts", "refreshed")


def pushes(decisions: DataFrame, *also: str) -> DataFrame:
    """Changes to push, with the collection and further columns.

    Rows are chosen behind an explode_outer here and below. A plain filter would be pushed under the projections of decide(), where
    its column is replaced by its definition again and again, which makes planning grow beyond bounds.
    """
    each = decisions.select("collection", *also, F.explode_outer(F.array("push")).alias("p"))
    return each.where("p IS NOT NULL").select("collection", *also, "p.*")


def write_ops(decisions: DataFrame) -> DataFrame:
    """The write operations of the merge, with (phase, seq) as their order within a key's batch."""
    each = decisions.select(F.col("handle").alias("of"), F.posexplode_outer("ops").alias("seq", "op"))
    return each.where("op IS NOT NULL").select(F.lit(0).alias("phase"), "of", "seq", "op.*")


def events(decisions: DataFrame) -> DataFrame:
    """Events of the merge; their order within a collection is that of (phase, handle, seq)."""
    each = decisions.select("collection", F.posexplode_outer("events").alias("seq", "e"))
    return each.where("e IS NOT NULL").select(F.lit(0).alias("phase"), "collection", "seq", "e.*")


def ordered(merged: DataFrame, pushed: DataFrame | None = None) -> DataFrame:
    """(collection, phase, seq, kind, handle) of all events of a sync, each collection's in order: those of the merge by handle, then
    those of the push in order of the results."""
    every = merged if pushed is None else merged.unionByName(pushed)
    return every.orderBy("collection", "phase", F.when(F.col("phase") == 0, F.col("handle")), "seq").select("collection", "phase", "seq", "kind", "handle")
