"""Several sources behind one hub: project a source's view, and absorb a source's write operations.

items: link_id, flags, object, meta, sort_key, level, deleted, conflicted, conflict_object.
bindings: link_id, source, handle, base, conflicted, conflict_revision; one row for each source that holds an item.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.handles import staged_by_hub
from ..model import BASE, CLEAN, CONFLICT, CREATED, DIRTY, DROP, FULL, HUB_EXISTING, HUB_INCOMING, HUB_MANUAL, PLACEMENT, TOMBSTONE, UPSERT, differs, null, struct
from ..sources.storage import shared_folder

ITEM = (
    T.StructType().add("flags", T.ArrayType(T.StringType())).add("object", "string").add("meta", "string").add("sort_key", "string").add("level", "integer").add("deleted", "boolean").add("conflicted", "boolean").add("conflict_object", "string")
)
BINDING = T.StructType().add("handle", "string").add("base", BASE).add("conflicted", "boolean").add("conflict_revision", "string")
STATE = T.StructType().add("item", ITEM).add("binding", BINDING)


def project(items: DataFrame, bindings: DataFrame, source: str, collection: str) -> DataFrame:
    """The placements that a source is shown: bound rows, deletions still held there, and rows to create where it has none."""
    c = F.col
    own = bindings.where(c("source") == source).select("link_id", struct(BINDING, **{f: c(f) for f in BINDING.names}).alias("b"))
    d = items.join(own, "link_id", "left")
    bound = c("b").isNotNull()
    d = d.where((bound | ~c("deleted")) & (bound | c("object").isNotNull()))
    agrees = c("b.base").isNotNull() & (c("b.base.flags") == c("flags")) & c("b.base.object").eqNullSafe(c("object"))
    status = F.when(~bound, CREATED).when(c("deleted"), TOMBSTONE).when(c("b.conflicted"), CONFLICT).when(agrees, CLEAN).otherwise(DIRTY)
    row = struct(
        PLACEMENT, collection=F.lit(collection), handle=F.when(bound, c("b.handle")).otherwise(staged_by_hub(c("link_id"))), link_id=c("link_id"), object=c("object"), level=F.when(bound, c("level")).otherwise(FULL),
        meta=c("meta"), sort_key=c("sort_key"), flags=c("flags"), status=status, conflict_revision=F.when(~c("deleted"), c("b.conflict_revision")), base=c("b.base"),
    )
    return d.select(row.alias("p")).select("p.*")


def _resolve(content: Column, item: Column, binding: Column, policy: str) -> Column:
    """The item's content after an upsert with this body, as struct<object, conflicted, conflict_object>."""
    out = lambda o, k, x: F.struct(o.alias("object"), k.alias("conflicted"), x.cast("string").alias("conflict_object"))
    before, shared, none, no = binding["base"]["object"], item["object"], F.lit(None), F.lit(False)
    edited, moved = differs(content, before), differs(shared, before)
    diverged = edited & moved & differs(content, shared) & content.isNotNull() & shared.isNotNull()
    settled = {HUB_MANUAL: out(shared, F.lit(True), content), HUB_INCOMING: out(content, no, none), HUB_EXISTING: out(shared, no, none)}[policy]
    return F.when(diverged, settled).when(edited & ~moved, out(content, no, none)).otherwise(out(shared, item["conflicted"], item["conflict_object"]))


def _step(state: Column, x: Column, policy: str) -> Column:
    """One operation on one item; drops carry the handle they remove."""
    p = x["placement"]
    had, bound = state["item"], state["binding"]
    first = struct(ITEM, flags=p["flags"], object=p["object"], meta=p["meta"], sort_key=p["sort_key"], level=p["level"], deleted=F.lit(False), conflicted=F.lit(False))
    item = F.coalesce(had, first)
    conflicted = p["status"] == CONFLICT
    binding = struct(BINDING, handle=p["handle"], base=p["base"], conflicted=conflicted, conflict_revision=F.when(conflicted, p["conflict_revision"]))
    content = _resolve(p["object"], item, bound, policy)
    live = struct(
        ITEM, flags=p["flags"], object=content["object"], meta=F.coalesce(p["meta"], item["meta"]), sort_key=F.when(p["sort_key"] == "", item["sort_key"]).otherwise(p["sort_key"]), level=F.greatest(item["level"], p["level"]),
        deleted=F.lit(False), conflicted=content["conflicted"], conflict_object=content["conflict_object"],
    )
    gone = lambda i: struct(ITEM, **{f: i[f] for f in ITEM.names if f != "deleted"}, deleted=F.lit(True))
    dropped = F.when(bound.isNotNull() & (bound["handle"] == x["handle"]), F.struct(gone(had).alias("item"), null(BINDING).alias("binding"))).otherwise(state)
    upserted = F.struct(F.when(p["status"] == TOMBSTONE, gone(item)).otherwise(live).alias("item"), binding.alias("binding"))
    return F.when(x["kind"] == DROP, dropped).otherwise(upserted).cast(STATE)


def absorb(items: DataFrame, bindings: DataFrame, ops: DataFrame, source: str, policy: str = HUB_MANUAL) -> tuple[DataFrame, DataFrame]:
    """(items, bindings) after a source's operations (phase, seq, kind, handle, placement), in order.

    A drop names a handle; the items it may meet are those bound to it before and those that an upsert of the batch binds to it.
    Operations are folded for each link id on its own. Unlinked upserts are ignored; items that no source holds are pruned.
    """
    c = F.col
    named = ops.where(c("kind").isin(UPSERT, DROP)).select(F.struct("phase", "seq").alias("at"), "kind", "handle", "placement")
    upserts = named.where((c("kind") == UPSERT) & c("placement.link_id").isNotNull()).select(c("placement.link_id").alias("link_id"), "at", "kind", "handle", "placement")
    own = bindings.where(c("source") == source)
    holders = own.select("link_id", "handle").unionByName(upserts.select("link_id", "handle")).distinct()
    drops = named.where(c("kind") == DROP).join(holders, "handle").select("link_id", "at", "kind", "handle", "placement")
    by_link = upserts.unionByName(drops).groupBy("link_id").agg(F.array_sort(F.collect_list(F.struct("at", "kind", "handle", "placement"))).alias("ops"))

    states = items.select("link_id", struct(ITEM, **{f: c(f) for f in ITEM.names}).alias("item"))
    bound = own.select("link_id", struct(BINDING, **{f: c(f) for f in BINDING.names}).alias("binding"))
    touched = states.join(by_link, "link_id", "left_semi")  # the others are passed on as they are, not shuffled through the fold
    d = touched.join(bound, "link_id", "left").join(by_link, "link_id", "full_outer")
    start = F.struct(c("item").alias("item"), c("binding").alias("binding")).cast(STATE)
    folded = F.when(c("ops").isNull(), start).otherwise(F.aggregate("ops", start, lambda s, x: _step(s, x, policy)))
    shared_folder(items.sparkSession)
    done = d.select("link_id", folded.alias("s")).checkpoint()  # folded once for the items and the bindings that follow from it
    new = done.where(c("s.binding").isNotNull()).select("link_id", F.lit(source).alias("source"), "s.binding.*")
    still = own.join(by_link, "link_id", "left_anti")
    out = bindings.where(c("source") != source).unionByName(still.select(*bindings.columns)).unionByName(new)
    rest = items.join(by_link, "link_id", "left_anti").select("link_id", *ITEM.names)
    kept = rest.unionByName(done.where(c("s.item").isNotNull()).select("link_id", "s.item.*")).join(out.select("link_id").distinct(), "link_id", "left_semi")
    return kept, out
