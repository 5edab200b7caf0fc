"""The five verbs, over a store and a remote."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .model import FETCHED, FULL, META, LinkExists, RemoteError, ReplicaError, SyncOptions, UnknownHandle
from .operators import mutate as mu
from .operators import push as pu
from .operators import rekey as rk
from .operators import upgrade as up
from .plans import merge
from .sources.remote import Remote
from .sources.storage import Storage


class Report(dict):
    """Counters by name; events: what a sync did, in order (DataFrame of collection, phase, seq, kind, handle)."""

    events: DataFrame | None = None


@contextmanager
def asking() -> Iterator[None]:
    """What a remote raises comes out as RemoteError."""
    try:
        yield
    except ReplicaError:
        raise
    except Exception as e:
        raise RemoteError(str(e)) from e


@dataclass
class Engine:
    storage: Storage
    remote: Remote

    def open(self, collection: str) -> DataFrame:
        """The replica's rows; the remote is not asked."""
        self.storage.refresh()
        return self.storage.load(collection)[0]

    def sync(self, collection: str, options: SyncOptions = SyncOptions(), batch: str | None = None) -> Report:
        """Reconcile with the remote. The decision is materialised before anything is pushed, so that a plan that is run again
        cannot push again; the outcome is written in one commit, the checkpoint with it."""
        self.storage.refresh()
        placements, cursor = self.storage.load(collection)
        with asking():
            told = self.remote.enumerate(collection, None if options.full else cursor)
        items = merge.latest(told.items, F.col("pos"))
        found = merge.full_candidates(placements, items) if told.complete else merge.delta_candidates(placements, items, told.vanished)
        decided = merge.decide(found, options).checkpoint()
        ops, confirmed = merge.write_ops(decided), None
        changes = merge.pushes(decided)
        if not changes.isEmpty():
            with asking():
                results = self.remote.push(collection, changes)
            confirmed = pu.confirm(decided, results).checkpoint()
            ops = ops.unionByName(pu.confirm_ops(confirmed))
        self.storage.write(ops, checkpoint=(collection, told.checkpoint), batch=batch)
        row = pu.report(decided, confirmed).first()
        out = Report({k: (0 if row is None else row[k]) for k in ("pulled", "pushed", "conflicts", "rejected", "refreshed")})
        out.events = merge.ordered(merge.events(decided), None if confirmed is None else pu.confirm_events(confirmed))
        return out

    def mutate(self, batch: DataFrame, strict: bool = True) -> DataFrame:
        """Apply a batch of mutations; gives the rejects, and raises for the first of them if strict."""
        self.storage.refresh()
        names = {r["collection"] for r in batch.select("collection").distinct().collect()}  # a batch names few collections
        rows = None
        for name in sorted(names):
            own = self.storage.load(name)[0]
            rows = own if rows is None else rows.unionByName(own)
        if rows is None:
            return batch.limit(0)
        ops, rejects = mu.mutate(rows, batch)
        first = rejects.orderBy("seq").first() if strict else None
        if first is not None:
            raise (LinkExists if first["reason"] == "LinkExists" else UnknownHandle)(first["handle"])
        self.storage.write(ops, mu.bodies(batch))
        return rejects

    def upgrade(self, collection: str, handles: DataFrame, tier: int, stamp_base: bool = False) -> dict[str, int]:
        """Raise rows to META or FULL. Bodies that any placement has are not fetched."""
        self.storage.refresh()
        placements, _ = self.storage.load(collection)
        todo = up.pending(placements, handles.withColumn("collection", F.lit(collection)), tier)
        if todo.isEmpty():
            return {"upgraded": 0, "fetched": 0, "deduped": 0}
        known, miss = None, todo
        if tier == FULL:
            every = self.storage.lookup_objects(todo.where("link_id IS NOT NULL"))
            known, miss = up.split_known(todo, every.select(F.lit("").alias("collection"), F.lit("").alias("handle"), "link_id", "object"), stamp_base)
        with asking():  # bodies are asked for once; all that follows reads what came
            fetched = self.remote.fetch(collection, miss.select("handle"), tier == FULL).checkpoint()
        got = up.patched(miss, fetched.drop("bytes"), tier)
        objects = fetched.where("object IS NOT NULL").select(F.col("object").alias("hash"), "size", "bytes")
        report = up.report(known, got).first().asDict()
        self.storage.write(got if known is None else got.unionByName(known), objects)
        return report

    def rekey(self, collection: str, prefer_known_sort_key: bool = True) -> dict[str, int]:
        """Rebuild the collection under new handles."""
        self.storage.refresh()
        placements, _ = self.storage.load(collection)
        linked = not placements.where("link_id IS NOT NULL").isEmpty()
        with asking():
            told = self.remote.enumerate(collection, None)
            fetched = self.remote.fetch(collection, told.items.select("handle"), False) if linked else None
        empty = placements.sparkSession.createDataFrame([], FETCHED).withColumn("collection", F.lit(None).cast("string")) if fetched is None else fetched
        rebuilt = rk.rebuild(placements, merge.latest(told.items, F.col("pos")), empty, prefer_known_sort_key).checkpoint()
        self.storage.write(rk.write_ops(rebuilt), checkpoint=(collection, told.checkpoint))
        return rk.report(rebuilt).first().asDict()


__all__ = ["Engine", "Report", "META", "FULL"]
