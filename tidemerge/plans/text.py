"""Structs as SQL text. A decision names hundreds of fields; as text it is parsed at once, where a call for each would take seconds."""

from __future__ import annotations

from pyspark.sql import types as T

from ..model import BASE, CHANGE, EVENT, OP, PLACEMENT, REMOTE_ITEM


def null(kind: T.DataType) -> str:
    return f"CAST(NULL AS {kind.simpleString()})"


def struct(kind: T.StructType, /, **given: str) -> str:
    """A struct of the type, with null for what isn't given."""
    return "named_struct(" + ", ".join(f"'{f.name}', CAST({given.get(f.name, 'NULL')} AS {f.dataType.simpleString()})" for f in kind.fields) + ")"


def with_(row: str, **changes: str) -> str:
    """A placement with some fields replaced."""
    return "named_struct(" + ", ".join(f"'{f.name}', " + (f"CAST({changes[f.name]} AS {f.dataType.simpleString()})" if f.name in changes else f"{row}.{f.name}") for f in PLACEMENT.fields) + ")"


def placement(**given: str) -> str:
    return struct(PLACEMENT, **given)


def base_of(flags: str, revision: str, obj: str) -> str:
    return struct(BASE, flags=flags, revision=revision, object=obj)


def item(**given: str) -> str:
    return struct(REMOTE_ITEM, **given)


def op(kind: str, collection: str, handle: str, placement: str = "NULL") -> str:
    return struct(OP, kind=f"'{kind}'", collection=collection, handle=handle, placement=placement)


def upsert(row: str) -> str:
    return op("UpsertPlacement", f"{row}.collection", f"{row}.handle", row)


def change(kind: str, **given: str) -> str:
    return struct(CHANGE, kind=f"'{kind}'", **given)


def event(kind: str, handle: str) -> str:
    return struct(EVENT, kind=f"'{kind}'", handle=handle)


def array_of(kind: T.StructType, *items: str) -> str:
    return f"CAST(array({', '.join(items)}) AS array<{kind.simpleString()}>)"


def case(*arms: tuple[str, str], otherwise: str = "NULL") -> str:
    """The value of the first condition that holds."""
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in arms) + f" ELSE {otherwise} END" if arms else otherwise
