"""Tables of a replica in a folder, with numbered manifests: every commit writes new files beside the old ones and then one manifest
that names them, so it is all or nothing.

Below root: ``data/<commit>/part=<hash>`` holds the placements of one collection as of that commit, ``objects/<commit>`` the bodies
that a commit brought, and ``manifests/<number>.json`` which of them make up a version, with the checkpoints of collections and the
last batch of each stream; ``staged/`` the operations of commits under way. Nothing is deleted or overwritten by a commit; the highest complete manifest counts. A commit rewrites the
collections it touches and no others, and appends bodies. ``vacuum`` removes what no kept version names.
"""

from __future__ import annotations

import base64
import json
import tempfile
import uuid
from typing import Any, Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import OBJECT, PLACEMENT, ConflictError, StorageError
from ..operators import ops as wo
from ..operators.upgrade import lookup_objects

EMPTY: dict[str, Any] = {"version": 0, "collections": {}, "objects": [], "checkpoints": {}, "batches": {}}


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir); a temporary one only where none is set and all of Spark is one process."""
    context = spark.sparkContext
    now = context._jsc.sc().getCheckpointDir()
    found = context.getConf().get("spark.checkpoint.dir") or (now.get() if now.isDefined() else None)
    if not found:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise StorageError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='tidemerge-')}"
    if not now.isDefined():
        context.setCheckpointDir(found)
    return found


def kept(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, computed once and read by all that follow; it goes when the application ends."""
    spark = df.sparkSession
    where = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    df.write.parquet(where)
    return spark.read.schema(df.schema).parquet(where)


def scratch_store(spark: SparkSession, **given) -> TableStore:
    """A store that goes when the application ends."""
    root = f"{shared_folder(spark)}/store-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return TableStore(spark, root, **given)


class Storage(Protocol):
    """What the verbs need of a store."""

    def refresh(self) -> None: ...
    def load(self, collection: str) -> tuple[DataFrame, bytes | None]: ...
    def lookup_objects(self, links: DataFrame) -> DataFrame: ...
    def write(self, ops: DataFrame, objects: DataFrame | None = None, checkpoint: tuple[str, bytes] | None = None, batch: str | None = None, stream: str = "") -> None: ...


class TableStore:
    """A store below root, in any file system that Spark knows.

    A writer builds on the version it read first after its last commit. If another has changed one of its collections since then,
    its commit is refused; changes to other collections are taken along. Renaming a manifest into place must fail where one of that
    number exists, as it does in HDFS.
    """

    def __init__(self, spark: SparkSession, root: str, soft_delete: bool = False):
        self.spark, self.root, self.soft = spark, root.rstrip("/"), soft_delete
        self.schema = T.StructType(PLACEMENT.fields + ([T.StructField("hidden", T.BooleanType())] if soft_delete else []))
        self._seen: dict | None = None
        if self.manifest()["version"] == 0 and self._names("data"):
            raise StorageError(f"{self.root} holds data but no manifest")

    # Files

    def _fs(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        path, fs = self._fs(folder)
        return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []

    def _read(self, name: str) -> dict | None:
        """A manifest, or None if it isn't complete."""
        path, fs = self._fs(f"manifests/{name}")
        stream = fs.open(path)
        try:
            return json.loads(str(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
        except json.JSONDecodeError:
            return None
        finally:
            stream.close()

    def manifest(self) -> dict:
        """The highest complete version."""
        for name in reversed([n for n in self._names("manifests") if n.endswith(".json")]):
            if (found := self._read(name)) is not None:
                return found
        return EMPTY

    def _put(self, manifest: dict) -> bool:
        """Whether the manifest's number was free and is now taken by it."""
        jvm = self.spark._jvm
        draft, fs = self._fs(f"manifests/draft-{uuid.uuid4().hex}")
        final, _ = self._fs(f"manifests/{manifest['version']:020d}.json")
        stream = fs.create(draft, True)
        stream.write(bytearray(json.dumps(manifest).encode()))
        stream.close()
        if fs.exists(final):
            fs.delete(draft, False)
            return False
        none = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri() if final.toUri().getScheme() else fs.getUri(), self.spark._jsc.hadoopConfiguration()).rename(draft, final, none)
        except Exception as e:
            if "FileAlreadyExists" in str(e):
                return False
            raise
        return True

    # Reading

    def _current(self) -> dict:
        if self._seen is None:
            self._seen = self.manifest()
        return self._seen

    def refresh(self) -> None:
        """Let the next read begin a new version."""
        self._seen = None

    def _rows(self, manifest: dict, names: list[str] | None = None) -> DataFrame:
        found = manifest["collections"] if names is None else {n: manifest["collections"][n] for n in names if n in manifest["collections"]}
        folders = [f"{self.root}/{f}" for f in sorted(set(found.values()))]
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*folders)

    @property
    def placements(self) -> DataFrame:
        return self._rows(self._current())

    @property
    def objects(self) -> DataFrame:
        """(hash, size, bytes), one row each; a body counts once it is known."""
        folders = [f"{self.root}/{f}" for f in self._current()["objects"]]
        if not folders:
            return self.spark.createDataFrame([], OBJECT)
        return wo.store_objects(self.spark.read.schema(OBJECT).parquet(*folders), self.spark.createDataFrame([], OBJECT))

    def last_batch(self, stream: str = "") -> str:
        return self.manifest()["batches"].get(stream, "")

    def load(self, collection: str) -> tuple[DataFrame, bytes | None]:
        now = self._current()
        rows = self._rows(now, [collection])
        rows = rows.where(~F.col("hidden")).drop("hidden") if self.soft else rows
        mark = now["checkpoints"].get(collection)
        return rows, None if mark is None else base64.b64decode(mark)

    def lookup_objects(self, links: DataFrame) -> DataFrame:
        return lookup_objects(self.placements, links)

    # Writing

    def write(self, ops: DataFrame, objects: DataFrame | None = None, checkpoint: tuple[str, bytes] | None = None, batch: str | None = None, stream: str = "") -> None:
        """Apply ops in order; of one key the last counts. batch names a stream's run, to tell a replay; it stays until the stream's
        next one. The plan of ops runs once: what it gives is staged below root until the commit is done."""
        staged = f"staged/{uuid.uuid4().hex}"
        try:
            base = self._current()
            last = self._stage(ops, staged)
            touched = sorted(r[0] for r in last.select("collection").distinct().collect())  # no more than collections
            written = self._write_placements(base, last, touched)
            bodies = None if objects is None else self._write_objects(base, objects)
            while True:
                now = self.manifest()
                mine = {*touched, *([checkpoint[0]] if checkpoint else [])}
                if any(now[part].get(c) != base[part].get(c) for part in ("collections", "checkpoints") for c in mine) or (batch is not None and now["batches"].get(stream) != base["batches"].get(stream)):
                    raise ConflictError(f"another writer has changed {sorted(mine)}")
                new = {**now, "version": now["version"] + 1, "collections": {k: v for k, v in now["collections"].items() if k not in touched} | written}
                if bodies:
                    new["objects"] = [*now["objects"], bodies]
                if checkpoint is not None:
                    new["checkpoints"] = now["checkpoints"] | {checkpoint[0]: base64.b64encode(checkpoint[1]).decode()}
                if batch is not None:
                    new["batches"] = now["batches"] | {stream: batch}
                if self._put(new):
                    break
        except StorageError:
            raise
        except Exception as e:
            raise StorageError(str(e)) from e
        finally:
            path, fs = self._fs(staged)
            fs.delete(path, True)
            self.refresh()

    def _stage(self, ops: DataFrame, folder: str) -> DataFrame:
        """The last operation of each key."""
        last = wo.last_wins(ops)
        last.write.parquet(f"{self.root}/{folder}")
        return self.spark.read.schema(last.schema).parquet(f"{self.root}/{folder}")

    def _write_placements(self, base: dict, last: DataFrame, touched: list[str]) -> dict[str, str]:
        """Folders of the touched collections that have rows after the last operations of keys."""
        if not touched:
            return {}
        if any(c in base["collections"] for c in touched):
            rows = (wo.apply_last_soft if self.soft else wo.apply_last)(self._rows(base, touched), last)
        else:  # nothing to join with
            rows = wo.upserted(last)
            rows = rows.withColumn("hidden", F.lit(False)) if self.soft else rows
        commit = f"data/{uuid.uuid4().hex}"
        part = F.md5("collection")
        rows.withColumn("part", part).hint("rebalance", F.col("part")).write.partitionBy("part").parquet(f"{self.root}/{commit}")
        made = {n.removeprefix("part="): f"{commit}/{n}" for n in self._names(commit) if n.startswith("part=")}
        keys = self.spark.range(1).select(*[F.md5(F.lit(c)).alias(f"c{i}") for i, c in enumerate(touched)]).first()
        return {c: made[k] for c, k in zip(touched, keys, strict=True) if k in made}

    def _write_objects(self, base: dict, objects: DataFrame) -> str | None:
        """The folder of those bodies that are new; known ones are told by their hashes alone."""
        new = objects.groupBy("hash").agg(F.max("size").alias("size"), F.first("bytes", ignorenulls=True).alias("bytes"))
        if base["objects"]:
            old = self.spark.read.schema(OBJECT).parquet(*[f"{self.root}/{f}" for f in base["objects"]]).select("hash", F.col("bytes").isNotNull().alias("has"))
            known = old.groupBy("hash").agg(F.max("has").alias("has"))
            new = new.join(known, "hash", "left").where(F.col("has").isNull() | (~F.col("has") & F.col("bytes").isNotNull())).drop("has")
        folder = f"objects/{uuid.uuid4().hex}"
        new.select(*OBJECT.names).write.parquet(f"{self.root}/{folder}")
        return folder

    def vacuum(self, keep: int = 1) -> int:
        """Remove what the last ``keep`` versions don't name, and older manifests. For a time without writers and readers of older
        versions. Gives the number of folders removed."""
        names = [n for n in self._names("manifests") if n.endswith(".json")]
        whole = [(n, m) for n in names if (m := self._read(n)) is not None][-keep:]
        used = {f for _, m in whole for f in [*m["collections"].values(), *m["objects"]]}
        gone = 0
        for kind in ("data", "objects", "staged"):
            for commit in self._names(kind):
                if kind != "data" or not any(f.startswith(f"{kind}/{commit}/") for f in used):
                    parts = [f"{kind}/{commit}"]
                else:
                    parts = [f"{kind}/{commit}/{n}" for n in self._names(f"{kind}/{commit}") if n.startswith("part=")]
                for folder in parts:
                    if folder not in used:
                        path, fs = self._fs(folder)
                        fs.delete(path, True)
                        gone += 1
        for name in self._names("manifests"):
            if name not in {n for n, _ in whole}:
                path, fs = self._fs(f"manifests/{name}")
                fs.delete(path, False)
        return gone
