"""Remotes: what the verbs need of one, and one kept in tables, with a change log."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import flags as fl
from ..model import ACCEPTED, REJECTED

KEY = ["collection", "handle"]
SERVER = T.StructType().add("collection", "string").add("handle", "string").add("link_id", "string").add("flags", T.ArrayType(T.StringType())).add("object", "string").add("size", "long").add("bytes", "binary").add("seq", "long").add("rev", "long").add("meta", "string").add("sort_key", "string")
LOG = T.StructType().add("collection", "string").add("handle", "string").add("seq", "long")


@dataclass(frozen=True)
class Snapshot:
    """items: collection, handle, flags, revision, pos. vanished: collection, handle. complete: what is not listed is gone."""

    items: DataFrame
    vanished: DataFrame
    complete: bool
    checkpoint: bytes


class Remote(Protocol):
    def enumerate(self, collection: str, cursor: bytes | None) -> Snapshot: ...
    def fetch(self, collection: str, handles: DataFrame, full: bool) -> DataFrame: ...
    def push(self, collection: str, changes: DataFrame) -> DataFrame: ...


def enumerate_items(server: DataFrame, log: DataFrame, cursor: int | None) -> tuple[DataFrame, DataFrame]:
    """(items, vanished) since the cursor; all items and no vanished ones without one. What exists again hasn't vanished."""
    rows = server if cursor is None else server.where(F.col("seq") > cursor)
    items = rows.select(*KEY, "flags", F.concat(F.lit("r"), "rev").alias("revision"), F.col("seq").alias("pos"))
    gone = log.where(F.lit(cursor is not None) & (F.col("seq") > F.lit(cursor or 0))).select(*KEY).distinct()
    return items, gone.join(server.select(*KEY), KEY, "left_anti")


def in_order(df: DataFrame, *by: str) -> DataFrame:
    """df with n, the place of each row (from 1) in the order of the columns by. Rows are dealt by ranges and numbered within these, so
    that no single task sees them all; the driver sees one count for each range."""
    spark = df.sparkSession
    dealt = df.repartitionByRange(*by).withColumn("__part", F.spark_partition_id()).checkpoint()
    counts = {r["__part"]: r["c"] for r in dealt.groupBy("__part").agg(F.count(F.lit(1)).alias("c")).collect()}
    ahead, rows = 0, []
    for part in sorted(counts):
        rows.append((part, ahead))
        ahead += counts[part]
    offsets = F.broadcast(spark.createDataFrame(rows, "__part int, __ahead long"))  # a row for each range
    own = F.row_number().over(Window.partitionBy("__part").orderBy(*by))
    return dealt.withColumn("n", own).join(offsets, "__part").withColumn("n", F.col("n") + F.col("__ahead")).drop("__part", "__ahead")


class TableRemote:
    """A server in two DataFrames, items and the log of removals. mutable: contents have revisions. calls counts what was asked.

    Each push replaces the DataFrames by new ones, cut from their lineage by a checkpoint in the cluster's shared folder.
    """

    def __init__(self, spark: SparkSession, server: DataFrame | None = None, mutable: bool = True):
        self.spark, self.mutable = spark, mutable
        self.server = server if server is not None else spark.createDataFrame([], SERVER)
        self.log = spark.createDataFrame([], LOG)
        self.clock = self.server.agg(F.max("seq")).first()[0] or 0
        self.calls = {"enumerate": 0, "fetch": 0, "push": 0}

    def enumerate(self, collection: str, cursor: bytes | None) -> Snapshot:
        """A cursor that can't be read gives a complete snapshot."""
        self.calls["enumerate"] += 1
        text = (cursor or b"").decode("utf-8", "replace")
        since = int(text) if text.isdecimal() else None
        own = F.col("collection") == collection
        items, gone = enumerate_items(self.server.where(own), self.log.where(own), since)
        if not self.mutable:
            items = items.withColumn("revision", F.lit(None).cast("string"))
        return Snapshot(items, gone, since is None, str(self.clock).encode())

    def fetch(self, collection: str, handles: DataFrame, full: bool) -> DataFrame:
        self.calls["fetch"] += 1
        rows = self.server.where(F.col("collection") == collection).join(handles.select("handle").distinct(), "handle", "left_semi")
        revision = F.concat(F.lit("r"), "rev") if self.mutable else F.lit(None).cast("string")
        body = [F.col(x) if full else F.lit(None).cast(SERVER[x].dataType).alias(x) for x in ("object", "size", "bytes")]
        return rows.select(*KEY, "link_id", "meta", "sort_key", *body, revision.alias("revision"))

    def push(self, collection: str, changes: DataFrame) -> DataFrame:
        """(collection, handle, outcome, assigned, revision, seq); the server and its log move on."""
        c = F.col
        self.calls["push"] += 1
        x = in_order(changes, "handle").withColumn("at", c("n") + F.lit(self.clock))
        s = self.server.select("collection", "handle", F.struct(*[f for f in SERVER.names if f not in KEY]).alias("s"))
        src = self.server.select(c("collection").alias("oc"), c("handle").alias("oh"), F.struct(*[f for f in SERVER.names if f not in KEY]).alias("o"))
        d = x.join(s, KEY, "left").join(src, (c("origin.collection") == c("oc")) & (c("origin.handle") == c("oh")), "left")
        stale = F.lit(self.mutable) & ~F.concat(F.lit("r"), c("s.rev")).eqNullSafe(c("if_match"))
        there = c("s").isNotNull()
        refused = ((c("kind") == "Update") & (~there | stale)) | ((c("kind") == "Remove") & there & stale) | ((c("kind") == "Add") & c("origin").isNotNull() & c("o").isNull())
        copies, appends = (c("kind") == "Add") & c("origin").isNotNull(), (c("kind") == "Add") & c("origin").isNull() & c("object").isNotNull()
        assigned = F.when(copies, F.concat(c("origin.handle"), F.lit("-copy"))).when(appends, F.concat(F.lit("app-"), c("at").cast("string")))
        rev = F.when(c("kind") == "Update", c("s.rev") + 1).when(copies, F.lit(1)).when(appends, F.lit(1)).otherwise(c("s.rev"))
        d = d.withColumns({"outcome": F.when(refused, REJECTED).otherwise(ACCEPTED), "assigned": F.when(~refused, assigned), "new_rev": F.when(~refused, rev)})
        d = d.checkpoint()
        good = d.where(c("outcome") == ACCEPTED)
        fields = lambda **g: [g.get(f.name, F.lit(None).cast(f.dataType)).cast(f.dataType).alias(f.name) for f in SERVER.fields]
        of = lambda p, **g: fields(**{f: c(f"{p}.{f}") for f in SERVER.names if f not in KEY}, **g) if not g else fields(**({f: c(f"{p}.{f}") for f in SERVER.names if f not in KEY} | g))
        key = {"collection": c("collection"), "handle": c("handle")}
        flags = good.where((c("kind") == "SetFlags") & there).select(*of("s", **key, flags=fl.canonical(c("flags")), seq=c("at")))
        updates = good.where(c("kind") == "Update").select(*of("s", **key, object=c("object"), rev=c("new_rev"), seq=c("at"), bytes=F.lit(None), size=F.lit(None)))
        moved = good.where((c("kind") == "Remove") & there & c("to").isNotNull()).select(*of("s", collection=c("to"), handle=F.concat("handle", F.lit("-moved")), seq=c("at")))
        copied = good.where(c("kind") == "Add").where(c("origin").isNotNull()).select(*of("o", collection=c("collection"), handle=c("assigned"), flags=fl.canonical(c("flags")), seq=c("at"), rev=F.lit(1)))
        appended = good.where((c("kind") == "Add") & c("origin").isNull() & c("object").isNotNull()).select(*fields(collection=c("collection"), handle=c("assigned"), link_id=F.coalesce(c("link_id"), c("assigned")), flags=fl.canonical(c("flags")), object=c("object"), seq=c("at"), rev=F.lit(1), sort_key=F.lit("")))
        removed = good.where((c("kind") == "Remove") & there).select(*KEY, c("at").alias("seq"))
        new = flags.unionByName(updates).unionByName(moved).unionByName(copied).unionByName(appended)
        gone = new.select(*KEY).unionByName(removed.select(*KEY))
        self.server = self.server.join(gone, KEY, "left_anti").select(*SERVER.names).unionByName(new).checkpoint()
        self.log = self.log.unionByName(removed.withColumn("seq", c("seq").cast("long"))).checkpoint()
        self.clock += d.count()
        return d.select("collection", "handle", "outcome", "assigned", F.when(c("new_rev").isNotNull() & F.lit(self.mutable), F.concat(F.lit("r"), "new_rev")).alias("revision"), c("n").cast("int").alias("seq"))
