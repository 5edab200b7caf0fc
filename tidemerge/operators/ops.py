"""Write operations: last one wins, apply to a table of placements, objects and their references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import DROP, KEEP_BOTH, UPSERT, SyncOptions

KEY = ["collection", "handle"]


def last_wins(ops: DataFrame, order: Column | None = None) -> DataFrame:
    """One operation for each key, the last in (phase, seq). max_by is combined before the shuffle."""
    order = F.struct("phase", "seq") if order is None else order
    last = F.max_by(F.struct("kind", "placement"), order)
    return ops.where(F.col("kind").isin(UPSERT, DROP)).groupBy(*KEY).agg(last.alias("x")).select(*KEY, "x.*")


def apply_ops(placements: DataFrame, ops: DataFrame) -> DataFrame:
    """placements after the operations: an upsert inserts or replaces, a drop of what is missing does nothing. One join."""
    return apply_last(placements, last_wins(ops))


def apply_ops_soft(placements: DataFrame, ops: DataFrame) -> DataFrame:
    """As apply_ops, but a dropped row stays, hidden from load; an upsert of its key shows it again. placements has hidden."""
    return apply_last_soft(placements, last_wins(ops))


def upserted(last: DataFrame) -> DataFrame:
    """The rows that last operations leave where there were none."""
    return last.where(F.col("kind") == UPSERT).select("placement.*")


def apply_last(placements: DataFrame, last: DataFrame) -> DataFrame:
    """apply_ops with the last operation of each key, as last_wins gives them; last is used twice."""
    kept = placements.join(last.select(*KEY), KEY, "left_anti").select(*placements.columns)
    new = upserted(last).select(*[c for c in placements.columns if c != "hidden"])
    return kept.unionByName(new, allowMissingColumns=True)


def apply_last_soft(placements: DataFrame, last: DataFrame) -> DataFrame:
    drops = last.where(F.col("kind") == DROP).select(*KEY, F.lit(True).alias("drop"))
    upserts = last.where(F.col("kind") == UPSERT)
    kept = placements.join(upserts.select(*KEY), KEY, "left_anti").join(drops, KEY, "left")
    kept = kept.withColumn("hidden", F.col("hidden") | F.coalesce("drop", F.lit(False))).select(*placements.columns)
    return kept.unionByName(upserts.select("placement.*").withColumn("hidden", F.lit(False)).select(*placements.columns))


def apply_own(decisions: DataFrame, options: SyncOptions = SyncOptions()) -> DataFrame:
    """The replica after the operations of decisions over all of it, without a further join: each decision has its row beside it, and
    its last operation on that stands. An operation on another handle (a copy that KEEP_BOTH makes) replaces what is there."""
    d = decisions.select(F.explode_outer(F.array(F.struct(*KEY, "l", "ops"))).alias("d")).select("d.*")
    own = "o.collection <=> collection AND o.handle <=> handle"
    mine = d.select("l", F.expr(f"try_element_at(filter(ops, o -> {own}), -1)").alias("o"))
    rows = mine.select(F.explode(F.expr(f"array_compact(array(CASE WHEN o IS NULL THEN l WHEN o.kind = '{UPSERT}' THEN o.placement END))")).alias("p")).select("p.*")
    if options.conflict != KEEP_BOTH:
        return rows
    other = d.select(F.lit(0).alias("phase"), F.posexplode(F.expr(f"filter(ops, o -> NOT ({own}))")).alias("seq", "o")).select("phase", "seq", "o.*")
    return apply_ops(rows, other)


def store_objects(objects: DataFrame, new: DataFrame) -> DataFrame:
    """objects (hash, size, bytes) with new ones; a body once known stays."""
    return objects.unionByName(new).groupBy("hash").agg(F.max("size").alias("size"), F.first("bytes", ignorenulls=True).alias("bytes"))


def references(placements: DataFrame) -> DataFrame:
    """(hash, refs): how often a placement or its base names an object."""
    named = placements.select(F.explode(F.array("object", "base.object")).alias("hash")).where("hash IS NOT NULL")
    return named.groupBy("hash").agg(F.count(F.lit(1)).alias("refs"))


def collectable(objects: DataFrame, placements: DataFrame) -> DataFrame:
    """Objects that nothing names."""
    return objects.join(references(placements), "hash", "left_anti")
