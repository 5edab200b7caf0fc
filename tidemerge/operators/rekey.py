"""Rebuild a collection whose handles were all assigned anew, by the link ids of its items."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import flags as fl
from ..model import BASE, CLEAN, CONFLICT, CREATED, DIRTY, DROP, META, ORIGIN, PLACEMENT, PROBED, TOMBSTONE, as_row, base_of, differs, null, op, struct, upsert, with_

KEY = ["collection", "handle"]


def rebuild(placements: DataFrame, items: DataFrame, fetched: DataFrame, prefer_known_sort_key: bool = True) -> DataFrame:
    """A row for each item and each unmatched old row: collection, handle, outcome (carried, fresh, resurrected, lost, gone), ops.

    items: collection, handle, flags, revision, pos (order in the snapshot). fetched: collection, handle, link_id, meta, sort_key.
    Links match one to one: of old rows with one link the last by handle counts, of new items the first in the snapshot. With
    prefer_known_sort_key an empty fetched key (or absent summary) gives way to the known one.
    """
    c = F.col
    old = placements.where(c("status") != CREATED).select("collection", "handle", "link_id", as_row().alias("o"))
    last = Window.partitionBy("collection", "link_id").orderBy(c("handle").desc())
    claimed = old.where("link_id IS NOT NULL").withColumn("n", F.row_number().over(last)).where("n = 1").drop("n", "handle")
    named = fetched.select(*KEY, c("link_id").alias("link"), "meta", "sort_key")
    new = items.select(*KEY, fl.canonical(c("flags")).alias("flags"), "revision", "pos").join(named, KEY, "left")
    first = Window.partitionBy("collection", "link").orderBy("pos", "handle")
    new = new.withColumn("n", F.when(c("link").isNotNull(), F.row_number().over(first))).withColumn("claim", F.when(c("n") == 1, c("link")))
    both = new.join(claimed.withColumnRenamed("link_id", "claim"), ["collection", "claim"], "left")
    o, empty = c("o"), F.array().cast("array<string>")
    flags = fl.merge(F.coalesce(o["base"]["flags"], empty), o["flags"], c("flags"))
    edited = (o["status"] == DIRTY) & o["object"].isNotNull() & (o["base"].isNull() | differs(o["object"], o["base"]["object"]))
    status = F.when(o["status"].isin(TOMBSTONE, CONFLICT), o["status"]).when(edited | (c("merged") != c("flags")), DIRTY).otherwise(CLEAN)
    key = F.when(c("sort_key") == "", o["sort_key"]).otherwise(c("sort_key")) if prefer_known_sort_key else c("sort_key")
    meta = F.coalesce(c("meta"), o["meta"]) if prefer_known_sort_key else c("meta")
    carried = with_(o, handle=c("handle"), sort_key=key, meta=meta, flags=c("merged"), status=status, conflict_revision=F.when(o["status"] == CONFLICT, c("revision")), base=base_of(c("flags"), c("revision"), o["base"]["object"]))
    fresh = struct(PLACEMENT, collection=c("collection"), handle=c("handle"), link_id=c("link"), level=F.when(c("link").isNotNull(), META).otherwise(PROBED), meta=c("meta"), sort_key=F.coalesce(c("sort_key"), F.lit("")), flags=c("flags"), status=F.lit(CLEAN), base=base_of(c("flags"), c("revision"), null(T.StringType())))
    placed = both.withColumn("merged", flags).withColumn("row", F.when(o.isNotNull(), carried).otherwise(fresh))
    made = placed.select("collection", "handle", F.when(o.isNotNull(), "carried").otherwise("fresh").alias("outcome"), F.array(upsert(c("row"))).alias("ops"))

    used = both.where(o.isNotNull()).select("collection", c("o.handle").alias("handle"))
    left = old.join(used.withColumn("used", F.lit(True)), KEY, "left")
    stays = c("used").isNull() & o["status"].isin(DIRTY, CONFLICT) & o["object"].isNotNull() & (o["base"].isNull() | differs(o["object"], o["base"]["object"]))
    raised = with_(o, status=F.lit(CREATED), conflict_revision=null(T.StringType()), base=null(BASE), origin=null(ORIGIN))
    outcome = F.when(c("used").isNotNull(), "moved").when(stays, "resurrected").when(o["status"] != CLEAN, "lost").otherwise("gone")
    drop = op(DROP, c("collection"), c("handle"))
    rest = left.select("collection", "handle", outcome.alias("outcome"), F.when(stays, F.array(drop, upsert(raised))).otherwise(F.array(drop)).alias("ops"))
    return made.unionByName(rest)


def write_ops(rebuilt: DataFrame) -> DataFrame:
    """Drops of the old rows first, then new and carried rows, then resurrected ones."""
    each = rebuilt.select(F.col("handle").alias("of"), "outcome", F.posexplode_outer("ops").alias("k", "op"))
    seq = F.when(F.col("op.kind") == DROP, 0).when(F.col("outcome") == "resurrected", 2).otherwise(1)
    return each.select(F.lit(0).alias("phase"), "of", seq.alias("seq"), "op.*")


def report(rebuilt: DataFrame) -> DataFrame:
    is_ = lambda *o: F.count_if(F.col("outcome").isin(*o))
    return rebuilt.agg(is_("carried", "resurrected").alias("rekeyed"), is_("fresh").alias("pulled"), is_("lost").alias("dropped"))
