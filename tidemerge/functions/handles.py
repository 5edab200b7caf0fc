"""Handles and content hashes that the engine makes itself."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import MARK


def keep_both(handle: Column) -> Column:
    return F.concat(handle, F.lit(MARK + "keepboth"))


def staged_by_hub(link_id: Column) -> Column:
    return F.concat(link_id, F.lit(MARK + "hub"))


def content_hash(body: Column) -> Column:
    return F.sha2(body, 256)
