"""Incremental runs: each micro-batch of a change stream is a delta snapshot."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import SyncOptions
from ..operators import push as pu
from ..plans import merge
from ..sources.storage import TableStore

Push = Callable[[str, DataFrame], DataFrame]


def delta_of(batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(items, vanished) of change rows (collection, handle, flags, revision, removed, seq): the last for each key counts."""
    last = merge.latest(batch, F.col("seq"))
    items = last.where("NOT removed").select("collection", "handle", "flags", "revision")
    return items, last.where("removed").select("collection", "handle")


def sync_stream(changes: DataFrame, store: TableStore, checkpoint: str, push: Push | None = None, options: SyncOptions = SyncOptions(), name: str = "changes"):
    """Start a query that merges a stream of changes into the store, batch by batch.

    The batch's number is stored with its commit under the stream's name, beside those of other streams, and stays through other
    commits; a batch that is replayed after its commit is skipped. Decisions are materialised before anything is pushed. Pushes,
    push(collection, changes) for each collection that has any, happen before the commit and so at least once; they carry link ids
    and revisions by which a remote can tell repeats.
    """

    def run(batch: DataFrame, number: int) -> None:
        mark = f"batch-{number}"
        if store.last_batch(name) == mark or batch.isEmpty():
            return
        store.refresh()
        items, vanished = delta_of(batch)
        decided = merge.decide(merge.delta_candidates(store.placements, items, vanished), options).checkpoint()
        ops = merge.write_ops(decided)
        changed = merge.pushes(decided)
        if push is not None:
            for r in changed.select("collection").distinct().orderBy("collection").collect():  # no more than collections
                results = push(r["collection"], changed.where(F.col("collection") == r["collection"]))
                ops = ops.unionByName(pu.confirm_ops(pu.confirm(decided.where(F.col("collection") == r["collection"]), results).checkpoint()))
        store.write(ops, batch=mark, stream=name)

    return changes.writeStream.option("checkpointLocation", checkpoint).foreachBatch(run)
