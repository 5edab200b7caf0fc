"""Local mutations as batches: set flags, remove, edit, copy, move, add.

A batch has one row for each mutation: collection, handle, kind, seq and what the kind needs (flags; object, size, bytes, meta, sort_key;
to_collection, to_handle; link_id). The result is (ops, rejects): write operations in order of (phase, seq), and the mutations whose
handle is unknown or whose link is already live.

Mutations of one handle are folded in order of seq, so each sees what the ones before it left. What a copy, a move or an add of the
batch makes can be changed by later mutations of the batch: a batch with copies or moves is worked off in waves, each as far as it
depends on no earlier mutation that is still to come. A handle's mutations are gathered beside its row once; a wave is one table in the
shared folder, and the next one moves only what this one held back. Links are judged by the replica as it was before the batch and by
earlier adds of the batch.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import flags as fl
from ..model import CREATED, FULL, OP, ORIGIN, PLACEMENT, TOMBSTONE, UPSERT, as_row, null
from ..plans.text import base_of, placement, struct, with_
from ..sources.storage import kept

KEY = ["collection", "handle"]
MUTATION = (
    T.StructType().add("seq", "integer").add("kind", "string").add("collection", "string").add("handle", "string").add("flags", T.ArrayType(T.StringType())).add("object", "string").add("size", "long").add("bytes", "binary")
    .add("meta", "string").add("sort_key", "string").add("to_collection", "string").add("to_handle", "string").add("link_id", "string")
)
PLACE = "place"  # a row made by an earlier wave
GIVEN = ("flags", "object", "meta", "sort_key", "to_collection", "to_handle", "link_id")
MADE = T.ArrayType(T.StructType().add("seq", "long").add("placement", PLACEMENT))
REFUSED = T.ArrayType(T.StructType().add("seq", "integer").add("kind", "string").add("reason", "string"))
STATE = T.StructType().add("row", PLACEMENT).add("seq", "long").add("made", MADE).add("refused", REFUSED)


def _judged(placements: DataFrame, batch: DataFrame) -> DataFrame:
    """(collection, handle, e) with one struct for each mutation; taken says that an add's link is live."""
    c = F.col
    live = placements.where((c("status") != TOMBSTONE) & c("link_id").isNotNull()).select("collection", "link_id").distinct().withColumn("live", F.lit(True))
    add = (c("kind") == "add") & c("link_id").isNotNull()
    turn = F.row_number().over(Window.partitionBy("collection", "link_id").orderBy("seq", "handle"))
    adds = batch.where(add).withColumn("turn", turn).join(live, ["collection", "link_id"], "left").withColumn("taken", c("live").isNotNull() | (c("turn") > 1))
    rest = batch.where(~F.coalesce(add, F.lit(False))).withColumn("taken", F.lit(False))
    fields = ["seq", "kind", *GIVEN, "taken"]
    each = adds.select(*KEY, *fields[:2], *GIVEN, "taken").unionByName(rest.select(*KEY, *fields[:2], *GIVEN, "taken"))
    return each.withColumn("flags", fl.canonical(c("flags"))).select(*KEY, F.struct(*fields, null(PLACEMENT).alias("placement")).alias("e"))


def _step() -> str:
    """SQL: the state s after the mutation e of one handle."""
    row = "s.row"
    flagged = with_(row, flags="e.flags", status="IF(s.row.status = 'Clean', 'Dirty', s.row.status)")
    removed = with_(row, status="'Tombstone'")
    solved = "s.row.status = 'Conflict'"
    base = f"IF({solved} AND s.row.base IS NOT NULL, {base_of('s.row.base.flags', 's.row.conflict_revision', 's.row.base.object')}, s.row.base)"
    edited = with_(row, object="e.object", level=str(FULL), meta="coalesce(e.meta, s.row.meta)", sort_key="coalesce(e.sort_key, s.row.sort_key)", base=base, conflict_revision=f"IF({solved}, NULL, s.row.conflict_revision)", status="IF(s.row.status = 'Created', 'Created', 'Dirty')")
    origin = struct(ORIGIN, collection="s.row.collection", handle="s.row.handle")
    copied = with_(row, collection="e.to_collection", handle="e.to_handle", status="'Created'", conflict_revision="NULL", base="NULL", origin=origin)
    moved = with_(row, status="'Tombstone'", origin=struct(ORIGIN, collection="e.to_collection", handle="s.row.handle"))
    added = placement(collection="collection", handle="handle", link_id="e.link_id", object="e.object", level=str(FULL), meta="e.meta", sort_key="coalesce(e.sort_key, '')", flags="e.flags", status=f"'{CREATED}'")
    own = f"CASE e.kind WHEN 'set_flags' THEN {flagged} WHEN 'remove' THEN {removed} WHEN 'edit' THEN {edited} WHEN 'move' THEN {moved} WHEN 'add' THEN {added} WHEN '{PLACE}' THEN e.placement ELSE s.row END"
    reason = f"CASE WHEN e.kind = 'add' THEN IF(e.taken, 'LinkExists', NULL) WHEN e.kind <> '{PLACE}' AND s.row IS NULL THEN 'UnknownHandle' END"
    made = f"IF(e.kind IN ('copy', 'move'), concat(s.made, array(named_struct('seq', 2L * e.seq, 'placement', {copied}))), s.made)"
    seq = f"IF(e.kind IN ('copy', '{PLACE}'), s.seq, 2L * e.seq + 1)"
    refused = f"named_struct('row', s.row, 'seq', s.seq, 'made', s.made, 'refused', concat(s.refused, array(named_struct('seq', e.seq, 'kind', e.kind, 'reason', {reason}))))"
    return f"IF({reason} IS NOT NULL, {refused}, named_struct('row', {own}, 'seq', {seq}, 'made', {made}, 'refused', s.refused))"


def _listed(events: DataFrame) -> DataFrame:
    """(collection, handle, es): each handle's mutations in order."""
    return events.groupBy(*KEY).agg(F.sort_array(F.collect_list("e")).alias("es"))


def _folded(listed: DataFrame, of: str = "es", *also: str) -> DataFrame:
    """(collection, handle, s): what each handle's mutations make of its row l, in order."""
    start = f"cast(named_struct('row', l, 'seq', NULL, 'made', array(), 'refused', array()) AS {STATE.simpleString()})"
    fold = F.expr(f"aggregate({of}, {start}, (s, e) -> {_step()})")
    return listed.select(*KEY, F.explode_outer(F.array(fold)).alias("s"), *also)


def _ops(folded: DataFrame) -> DataFrame:
    own = "IF(s.seq IS NULL, array(), array(named_struct('seq', s.seq, 'placement', s.row)))"
    each = folded.select(F.col("handle").alias("of"), F.explode(F.expr(f"concat(cast({own} AS {MADE.simpleString()}), s.made)")).alias("m"))
    op = F.struct(F.lit(UPSERT).alias("kind"), F.col("m.placement.collection").alias("collection"), F.col("m.placement.handle").alias("handle"), F.col("m.placement").alias("placement")).cast(OP)
    return each.select(F.lit(0).alias("phase"), "of", F.col("m.seq").alias("seq"), op.alias("op")).select("phase", "of", "seq", "op.*")


def _rejects(folded: DataFrame) -> DataFrame:
    return folded.select(*KEY, F.explode("s.refused").alias("r")).select("r.seq", "r.kind", *KEY, "r.reason")


def _due(makers: DataFrame) -> DataFrame:
    """(collection, handle, due): where copies and moves (collection, handle, seq) put rows, and the first of them for each."""
    return makers.groupBy(*KEY).agg(F.min("seq").alias("due"))


def _wave(listed: DataFrame, due: DataFrame) -> DataFrame:
    """(collection, handle, s, later): each handle's mutations up to the first that makes a row there, folded, and those after it."""
    after = "coalesce(e.seq > due, false)"
    cut = listed.join(due, KEY, "left").select(*KEY, "l", F.expr(f"filter(es, e -> NOT {after})").alias("now"), F.expr(f"filter(es, e -> {after})").alias("later"))
    return kept(_folded(cut, "now", "later"), "wave")


def mutate(placements: DataFrame, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    makers = batch.where("kind IN ('copy', 'move')").selectExpr("to_collection AS collection", "to_handle AS handle", "seq")
    listed = _listed(_judged(placements, batch)).join(placements.select(*KEY, as_row().alias("l")), KEY, "left")
    if makers.isEmpty():
        folded = _folded(listed)
        return _ops(folded), _rejects(folded)
    waves = [_wave(listed, _due(makers))]
    nothing = [F.lit(None).cast(MUTATION[f].dataType).alias(f) for f in GIVEN]
    place = F.struct((F.col("m.seq") / 2).cast("int").alias("seq"), F.lit(PLACE).alias("kind"), *nothing, F.lit(False).alias("taken"), F.col("m.placement").alias("placement"))
    while not (held := waves[-1].where("size(later) > 0")).isEmpty():
        made = waves[-1].select(F.explode("s.made").alias("m")).select("m.placement.collection", "m.placement.handle", place.alias("e")).groupBy(*KEY).agg(F.collect_list("e").alias("places"))
        makers = held.select(F.explode("later").alias("e")).where("e.kind IN ('copy', 'move')").selectExpr("e.to_collection AS collection", "e.to_handle AS handle", "e.seq AS seq")
        every = F.expr("sort_array(IF(places IS NULL, later, concat(later, places)))")
        waves.append(_wave(held.join(made, KEY, "left").select(*KEY, F.col("s.row").alias("l"), every.alias("es")), _due(makers)))
    every = reduce(DataFrame.unionByName, [w.select(*KEY, "s") for w in waves])
    return _ops(every), _rejects(every)


def bodies(batch: DataFrame) -> DataFrame:
    """Objects that edits and adds bring along."""
    return batch.where("kind IN ('edit', 'add') AND object IS NOT NULL").select(F.col("object").alias("hash"), "size", "bytes")
