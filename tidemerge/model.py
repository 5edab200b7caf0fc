"""Row types, options and the small vocabulary that all operators share."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

PROBED, META, FULL = 0, 1, 2
CLEAN, DIRTY, TOMBSTONE, CONFLICT, CREATED = "Clean", "Dirty", "Tombstone", "Conflict", "Created"
UPSERT, DROP, STORE, CHECKPOINT = "UpsertPlacement", "DropPlacement", "StoreObject", "SetCheckpoint"
ACCEPTED, REJECTED = "Accepted", "Rejected"
MARK = "\u0001"

_S = T.StringType()
FLAGS = T.ArrayType(_S)
BASE = T.StructType().add("flags", FLAGS).add("revision", _S).add("object", _S)
ORIGIN = T.StructType().add("collection", _S).add("handle", _S)
PLACEMENT = (
    T.StructType().add("collection", _S).add("handle", _S).add("link_id", _S).add("object", _S).add("level", T.IntegerType()).add("meta", _S)
    .add("sort_key", _S).add("flags", FLAGS).add("status", _S).add("conflict_revision", _S).add("base", BASE).add("origin", ORIGIN)
)
REMOTE_ITEM = T.StructType().add("handle", _S).add("flags", FLAGS).add("revision", _S)
FETCHED = T.StructType().add("handle", _S).add("link_id", _S).add("meta", _S).add("sort_key", _S).add("object", _S).add("size", T.LongType()).add("bytes", T.BinaryType()).add("revision", _S)
CHANGE = T.StructType().add("kind", _S).add("handle", _S).add("link_id", _S).add("flags", FLAGS).add("origin", ORIGIN).add("to", _S).add("object", _S).add("if_match", _S)
PUSH_RESULT = T.StructType().add("handle", _S).add("outcome", _S).add("assigned", _S).add("revision", _S)
OP = T.StructType().add("kind", _S).add("collection", _S).add("handle", _S).add("placement", PLACEMENT)
EVENT = T.StructType().add("kind", _S).add("handle", _S)
OBJECT = T.StructType().add("hash", _S).add("size", T.LongType()).add("bytes", T.BinaryType())


class ReplicaError(Exception):
    """Anything that a verb refuses or a seam fails at."""


class UnknownHandle(ReplicaError):
    pass


class LinkExists(ReplicaError):
    pass


class StorageError(ReplicaError):
    pass


class ConflictError(StorageError):
    """Another writer was first."""


class RemoteError(ReplicaError):
    pass


@dataclass(frozen=True)
class Rights:
    """What may be pushed."""

    add: bool = True
    remove: bool = True
    flags: bool = True
    content: bool = True


ALL_RIGHTS, NO_RIGHTS = Rights(), Rights(False, False, False, False)
MANUAL, PREFER_LOCAL, PREFER_REMOTE, KEEP_BOTH = "manual", "prefer_local", "prefer_remote", "keep_both"
HUB_MANUAL, HUB_INCOMING, HUB_EXISTING = "manual", "incoming", "existing"


@dataclass(frozen=True)
class SyncOptions:
    """Options become literals in the plan, so branches that they rule out are folded away."""

    push: bool = True
    rights: Rights = ALL_RIGHTS
    conflict: str = MANUAL
    full: bool = False

    def may(self, kind: str) -> bool:
        return self.push and getattr(self.rights, kind)

    def with_(self, **changes) -> SyncOptions:
        return replace(self, **changes)


def null(kind: T.DataType) -> Column:
    return F.lit(None).cast(kind)


def struct(kind: T.StructType, /, **given: Column) -> Column:
    """A struct of the type, with null for what isn't given."""
    return F.struct(*[(given[f.name].cast(f.dataType) if f.name in given else null(f.dataType)).alias(f.name) for f in kind.fields])


def base_of(flags: Column, revision: Column, obj: Column) -> Column:
    return struct(BASE, flags=flags, revision=revision, object=obj)


def op(kind: str, collection: Column, handle: Column, placement: Column | None = None) -> Column:
    return struct(OP, kind=F.lit(kind), collection=collection, handle=handle, **({} if placement is None else {"placement": placement}))


def with_(row: Column, **changes: Column) -> Column:
    """A placement with some fields replaced."""
    return F.struct(*[(changes[f.name].cast(f.dataType) if f.name in changes else row[f.name]).alias(f.name) for f in PLACEMENT.fields])


def upsert(placement: Column) -> Column:
    return op(UPSERT, placement["collection"], placement["handle"], placement)


def event(kind: str, handle: Column) -> Column:
    return struct(EVENT, kind=F.lit(kind), handle=handle)


def differs(a: Column, b: Column) -> Column:
    """Null-safe inequality."""
    return ~a.eqNullSafe(b)


def as_row(prefix: str = "") -> Column:
    """The placement struct of a row whose columns are a placement's."""
    return F.struct(*[F.col(prefix + f.name).alias(f.name) for f in PLACEMENT.fields])
