"""Read-side views: one row for each item across collections, pages in sort order, and diagnostics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import CREATED, TOMBSTONE

KEY = ["collection", "handle"]


def load(placements: DataFrame, collection: str | None = None) -> DataFrame:
    """What open shows: a collection's rows, without hidden ones."""
    rows = placements.where(~F.col("hidden")).drop("hidden") if "hidden" in placements.columns else placements
    return rows if collection is None else rows.where(F.col("collection") == collection)


def unified(placements: DataFrame) -> DataFrame:
    """(link_id, collections, members, level, object) over all collections; deletions are left out."""
    live = placements.where((F.col("status") != TOMBSTONE) & F.col("link_id").isNotNull())
    return live.groupBy("link_id").agg(F.array_sort(F.collect_set("collection")).alias("collections"), F.count(F.lit(1)).alias("members"), F.max("level").alias("level"), F.min_by("object", F.struct(F.col("object").isNull(), *KEY)).alias("object"))


def page(placements: DataFrame, n: int, newest: bool = True) -> DataFrame:
    """The first n rows by sort key; rows with no key come last. Ties go by collection and handle."""
    key = F.col("sort_key").desc() if newest else F.col("sort_key").asc()
    return placements.orderBy((F.col("sort_key") == "").asc(), key, *KEY).limit(n)


def lingering(placements: DataFrame) -> DataFrame:
    """Staged copies whose origin is gone."""
    origins = placements.select(F.col("collection").alias("oc"), F.col("handle").alias("oh"))
    staged = placements.where((F.col("status") == CREATED) & F.col("origin").isNotNull())
    return staged.join(origins, (F.col("origin.collection") == F.col("oc")) & (F.col("origin.handle") == F.col("oh")), "left_anti")


def stale_dedup(placements: DataFrame) -> DataFrame:
    """Rows that lost their body to a remote change while another row with their link still has one, which a hydration would take."""
    known = placements.where("object IS NOT NULL AND link_id IS NOT NULL").select("link_id").distinct()
    return placements.where("object IS NULL AND base IS NOT NULL AND link_id IS NOT NULL AND level = 0").join(known, "link_id", "left_semi")
