"""Hydration: raise rows to Meta or Full, fetching only bodies that no placement has yet."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import FULL, META, as_row, base_of, upsert, with_

KEY = ["collection", "handle"]


def lookup_objects(placements: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """(link_id, object): of the placements with a body, in any collection, the first by (collection, handle)."""
    known = placements.where("object IS NOT NULL AND link_id IS NOT NULL")
    if links is not None:
        known = known.join(links.select("link_id").distinct(), "link_id", "left_semi")
    return known.groupBy("link_id").agg(F.min_by("object", F.struct(*KEY)).alias("object"))


def pending(placements: DataFrame, handles: DataFrame, tier: int) -> DataFrame:
    """The requested rows below the tier; unknown handles are left out."""
    return placements.where(F.col("level") < tier).join(handles.select(*KEY).distinct(), KEY, "left_semi")


def split_known(rows: DataFrame, placements: DataFrame, stamp_base: bool = False) -> tuple[DataFrame, DataFrame]:
    """(ops for rows whose body is known, rows still to fetch). stamp_base pins the body in the base as a fetch would."""
    known = lookup_objects(placements, rows.where("link_id IS NOT NULL")).withColumnRenamed("object", "known")
    d = rows.join(known, "link_id", "left")
    row = as_row()
    base = F.when(F.col("base").isNotNull(), base_of(F.col("base.flags"), F.col("base.revision"), F.col("known"))) if stamp_base else F.col("base")
    hit = d.where("known IS NOT NULL").select(F.lit(0).alias("phase"), F.col("handle").alias("of"), F.lit(0).alias("seq"), upsert(with_(row, object=F.col("known"), level=F.lit(FULL), base=base)).alias("op"))
    return hit.select("phase", "of", "seq", "op.*"), d.where("known IS NULL").select(rows.columns)


def patched(rows: DataFrame, fetched: DataFrame, tier: int) -> DataFrame:
    """ops for fetched items; results are matched by handle, in any order, unknown ones are skipped."""
    f = fetched.select(*KEY, F.struct(*[c for c in fetched.columns if c not in KEY]).alias("f"))
    d = rows.join(f, KEY)
    row, body = as_row(), F.col("f.object").isNotNull() if tier == FULL else F.lit(False)
    base = F.when(body & F.col("base").isNotNull(), base_of(F.col("base.flags"), F.col("f.revision"), F.col("f.object"))).otherwise(F.col("base"))
    new = with_(row, link_id=F.coalesce(F.col("link_id"), F.col("f.link_id")), meta=F.col("f.meta"), sort_key=F.col("f.sort_key"), level=F.when(body, FULL).otherwise(META), object=F.when(body, F.col("f.object")).otherwise(F.col("object")), base=base)
    return d.select(F.lit(0).alias("phase"), F.col("handle").alias("of"), F.lit(0).alias("seq"), upsert(new).alias("op")).select("phase", "of", "seq", "op.*")


def report(known_ops: DataFrame | None, fetched_ops: DataFrame) -> DataFrame:
    """One row: upgraded, fetched, deduped. A Full fetch that brought no body still counts; its row rests at Meta."""
    got = fetched_ops.select(F.lit(0).alias("deduped"), F.lit(1).alias("fetched"), F.lit(1).alias("upgraded"))
    if known_ops is not None:
        got = got.unionByName(known_ops.select(F.lit(1).alias("deduped"), F.lit(0).alias("fetched"), F.lit(1).alias("upgraded")))
    return got.agg(*[F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in ("upgraded", "fetched", "deduped")])
