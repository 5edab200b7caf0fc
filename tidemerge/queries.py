"""Named queries over the test tables, each beside SQL that another engine runs for the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import fixtures as fx
from .engine import Engine
from .functions import flags as fl
from .functions.handles import content_hash
from .model import CHANGE, FULL, KEEP_BOTH, MANUAL, META, PREFER_LOCAL, PREFER_REMOTE, Rights, SyncOptions
from .operators import hub as hb
from .operators import mutate as mu
from .operators import ops as wo
from .operators import push as pu
from .operators import rekey as rk
from .operators import upgrade as up
from .operators import views
from .plans import merge
from .sources.remote import TableRemote, enumerate_items
from .sources.storage import kept, scratch_store, shared_folder
from .streaming.sync import sync_stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def keep(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql is not None:
            SQL[name or f.__name__] = sql
        return f

    return keep


def shown(p: str = "") -> list[Column]:
    """A placement in plain columns."""
    c = lambda x: F.col(p + x)
    return [c("status").alias("status"), c("level").alias("level"), c("link_id").alias("link_id"), c("object").alias("object"), fl.text(c("flags")).alias("flags"), c("conflict_revision").alias("conflict_revision"), fl.text(c("base.flags")).alias("base_flags"), c("base.revision").alias("base_revision"), c("base.object").alias("base_object"), c("origin.collection").alias("origin_collection"), c("origin.handle").alias("origin_handle")]


NAMES = "['answered','draft','flagged','seen']"


def _set(condition: str) -> str:
    return f"list_filter({NAMES}, lambda x, i: {condition})"


def _union(*parts: str) -> str:
    return f"list_sort(list_distinct(list_concat({parts[0]}, list_concat({parts[1]}, {parts[2]}))))"


def _merge(b: str, x: str, r: str) -> str:
    return _union(f"list_filter({x}, lambda f: list_contains({r}, f))", f"list_filter({x}, lambda f: NOT list_contains({b}, f))", f"list_filter({r}, lambda f: NOT list_contains({b}, f))")


SIDES = f"""
s0 AS (SELECT o_orderkey AS k, o_orderpriority AS collection, cast(o_orderkey AS varchar) AS handle, o_orderkey % 17 <> 3 AS has_local, o_orderkey % 13 <> 5 AS listed, o_orderkey % 11 <> 6 AS based,
  o_orderkey % 5 <> 0 AS has_obj, o_orderkey % 7 = 2 AS content_edit, o_orderkey % 4 = 0 AS is_move FROM orders),
s1 AS (SELECT *, CASE WHEN k % 19 = 4 THEN 'Tombstone' WHEN k % 29 = 8 AND based THEN 'Conflict' WHEN NOT based AND k % 2 = 0 THEN 'Created' WHEN k % 7 = 2 OR k % 3 = 1 THEN 'Dirty' ELSE 'Clean' END AS status FROM s0),
s2 AS (SELECT *, {_set("(k + (i - 1) * 3) % 5 < 2")} AS bf, {_set("((k + (i - 1) * 3) % 5 < 2) <> (status = 'Dirty' AND k % 3 = 1 AND (k * 3 + i - 1) % 7 = 0)")} AS lf,
  {_set("((k + (i - 1) * 3) % 5 < 2) <> ((k * 5 + (i - 1) * 7) % 23 = 0)")} AS rf, CASE WHEN has_obj THEN 'o' || handle END AS bobj, CASE WHEN has_obj THEN CASE WHEN content_edit THEN 'e' ELSE 'o' END || handle END AS obj,
  CASE WHEN status = 'Conflict' THEN CASE WHEN k % 10 = 1 THEN 'r2' ELSE 'r1' END WHEN k % 31 = 0 THEN NULL WHEN k % 10 = 1 THEN 'r1' ELSE 'r0' END AS rrev, CASE WHEN status = 'Conflict' THEN 'r1' END AS crev,
  CASE WHEN has_obj THEN 2 WHEN k % 3 = 0 THEN 0 ELSE 1 END AS level,
  CASE WHEN is_move AND status = 'Tombstone' THEN 'archive' WHEN is_move AND status = 'Created' THEN 'sent' END AS oc FROM s1),
sides AS (SELECT *, CASE WHEN level > 0 THEN 'l' || handle END AS link,
  listed AND (NOT has_local OR NOT based OR rf <> bf OR coalesce(rrev = 'r2', false) OR (status <> 'Conflict' AND coalesce(rrev = 'r1', false))) AS in_delta, has_local AND based AND NOT listed AS gone FROM s2)
"""
BOTH = "SELECT *, has_local AS lx, listed AS rx, rf AS xf, rrev AS xrev FROM sides WHERE has_local OR listed"
DELTA = """SELECT *, has_local AS lx, CASE WHEN gone THEN false WHEN in_delta THEN true ELSE has_local AND based END AS rx, CASE WHEN in_delta THEN rf ELSE bf END AS xf,
  CASE WHEN in_delta THEN rrev ELSE coalesce(crev, 'r0') END AS xrev FROM sides WHERE in_delta OR gone OR (has_local AND status <> 'Clean')"""


def decided(options: SyncOptions = SyncOptions(), source: str = BOTH) -> str:
    """CTEs up to dec, with a column for every decision."""
    may = lambda k: str(options.may(k)).lower()
    clash = {MANUAL: "C08a", PREFER_REMOTE: "C08b", PREFER_LOCAL: "C08c" if options.may("content") else "C08a", KEEP_BOTH: "C08d"}[options.conflict]
    return f"""WITH {SIDES}, x0 AS ({source}),
x1 AS (SELECT *, lx AND status = 'Tombstone' AS tomb, lx AND status <> 'Tombstone' AS present, lx AND based AS has_base, CASE WHEN lx AND based THEN 'r0' END AS brev FROM x0),
x2 AS (SELECT *, rx AND xrev IS NOT NULL AND xrev IS DISTINCT FROM brev AS newer, has_base AND obj IS NOT NULL AND obj IS DISTINCT FROM bobj AS edited FROM x1),
x3 AS (SELECT *, CASE WHEN tomb AND has_base AND rx AND newer THEN 'M01' WHEN tomb AND has_base AND rx AND NOT {str(options.push).lower()} THEN 'M02' WHEN tomb AND has_base AND rx AND edited AND oc IS NOT NULL THEN 'M03' WHEN tomb AND has_base AND rx THEN 'M04'
  WHEN tomb AND NOT rx THEN 'M05' WHEN present AND has_base AND NOT rx AND status IN ('Dirty', 'Conflict') AND edited THEN 'M06' WHEN present AND has_base AND NOT rx THEN 'M07' WHEN NOT present AND NOT has_base AND rx THEN 'M08' WHEN present AND rx THEN 'M09'
  WHEN present AND status = 'Created' AND {may("add")} THEN 'M10' WHEN present THEN 'M11' ELSE 'M12' END AS arm FROM x2),
x4 AS (SELECT *, CASE WHEN arm = 'M09' THEN CASE WHEN NOT has_base THEN CASE WHEN obj IS NOT NULL AND xrev IS NOT NULL THEN 'C01' ELSE 'C02' END WHEN status = 'Conflict' THEN CASE WHEN xrev IS NOT NULL AND xrev IS DISTINCT FROM crev THEN 'C03' ELSE 'C04' END
  WHEN status = 'Dirty' AND edited AND newer THEN '{clash}' WHEN status = 'Dirty' AND edited THEN 'C07' WHEN newer THEN 'C06' ELSE 'C05' END END AS ca FROM x3),
x5 AS (SELECT *, coalesce(ca IN ('C01', 'C08a'), false) AS marks, coalesce(ca IN ('C06', 'C08b', 'C08d'), false) AS pulls, coalesce((ca = 'C07' AND {may("content")}) OR ca = 'C08c', false) AS cpush FROM x4),
x6 AS (SELECT *, arm = 'M09' AND NOT cpush AS flagged, CASE WHEN marks THEN 'Conflict' ELSE status END AS st, CASE WHEN pulls THEN NULL ELSE obj END AS ob, CASE WHEN has_base THEN CASE WHEN pulls THEN NULL ELSE bobj END END AS bo, CASE WHEN pulls THEN xrev ELSE brev END AS br,
  CASE WHEN marks OR ca = 'C03' THEN xrev ELSE crev END AS cr, CASE WHEN pulls THEN 0 ELSE level END AS lv FROM x5),
x7 AS (SELECT *, CASE WHEN flagged AND has_base THEN {_merge("bf", "lf", "xf")} END AS merged FROM x6),
x8 AS (SELECT *, CASE WHEN flagged THEN CASE WHEN NOT has_base THEN 'F00' WHEN merged = lf AND merged = xf THEN CASE WHEN lf <> bf OR (st = 'Dirty' AND NOT (ob IS NOT NULL AND ob IS DISTINCT FROM bo)) THEN 'F01' ELSE 'F01-' END WHEN merged = xf THEN 'F02' WHEN merged = lf THEN 'F03' ELSE 'F04' END END AS fa FROM x7),
dec AS (SELECT *, CASE WHEN arm = 'M03' THEN CASE WHEN {may("content")} THEN 'Update' END WHEN arm = 'M04' THEN CASE WHEN {may("remove")} THEN 'Remove' END WHEN arm = 'M06' THEN CASE WHEN {may("add")} THEN 'Add' END WHEN arm = 'M10' THEN 'Add' WHEN cpush THEN 'Update' WHEN fa IN ('F03', 'F04') AND {may("flags")} THEN 'SetFlags' END AS push_kind,
  CASE WHEN arm IN ('M01', 'M07', 'M08') THEN 1 ELSE 0 END + CASE WHEN fa IN ('F00', 'F02', 'F04') THEN 1 ELSE 0 END AS pulled FROM x8)
"""


ARMS = "SELECT collection, handle, arm, ca AS content_arm, fa AS flag_arm, push_kind, CASE WHEN merged IS NOT NULL THEN array_to_string(merged, ',') END AS merged_flags FROM dec"


def _full(spark: SparkSession, sf: str, options: SyncOptions = SyncOptions()) -> DataFrame:
    return merge.decide(merge.full_candidates(fx.replica(spark, sf), fx.remote_items(spark, sf)), options)


def _delta(spark: SparkSession, sf: str) -> DataFrame:
    items, gone = fx.delta(spark, sf)
    return merge.decide(merge.delta_candidates(fx.replica(spark, sf), items, gone))


def _arms(d: DataFrame) -> DataFrame:
    return d.select("collection", "handle", "arm", "content_arm", "flag_arm", F.col("push.kind").alias("push_kind"), fl.text(F.col("merged")).alias("merged_flags"))


@query(f"WITH {SIDES} SELECT k, array_to_string({_merge('bf', 'lf', 'rf')}, ',') AS merged FROM sides")
def flag_merge(spark, sf):
    return fx._sides(spark, sf).select("k", fl.text(fl.merge(F.col("bf"), F.col("lf"), F.col("rf"))).alias("merged"))


@query(decided() + ARMS)
def merge_full(spark, sf):
    return _arms(_full(spark, sf))


@query(decided(source=DELTA) + ARMS)
def merge_delta(spark, sf):
    return _arms(_delta(spark, sf))


for _name, _options in {
    "policy_manual": SyncOptions(conflict=MANUAL), "policy_prefer_local": SyncOptions(conflict=PREFER_LOCAL), "policy_prefer_remote": SyncOptions(conflict=PREFER_REMOTE), "policy_keep_both": SyncOptions(conflict=KEEP_BOTH), "read_only_sync": SyncOptions(push=False),
}.items():
    query(decided(_options) + ARMS, _name)(lambda spark, sf, o=_options: _arms(_full(spark, sf, o)))

RIGHTS = {"all": Rights(), "none": Rights(False, False, False, False), "no_add": Rights(add=False), "no_remove": Rights(remove=False), "no_flags": Rights(flags=False), "no_content": Rights(content=False)}


@query(" UNION ALL ".join(f"SELECT * FROM ({decided(SyncOptions(rights=r))} SELECT '{n}' AS rights, push_kind, count(*) AS n FROM dec WHERE push_kind IS NOT NULL GROUP BY push_kind)" for n, r in RIGHTS.items()))
def rights_matrix(spark, sf):
    found = merge.full_candidates(fx.replica(spark, sf), fx.remote_items(spark, sf))
    sets = [merge.pushes(merge.decide(found, SyncOptions(rights=r))).groupBy("kind").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("rights"), F.col("kind").alias("push_kind"), "n") for name, r in RIGHTS.items()]
    return reduce(DataFrame.unionByName, sets)


@query(decided(SyncOptions(conflict=PREFER_LOCAL)) + """SELECT collection, handle, push_kind AS kind, CASE WHEN push_kind = 'Add' THEN link END AS link_id, CASE push_kind WHEN 'Add' THEN array_to_string(lf, ',') WHEN 'SetFlags' THEN array_to_string(merged, ',') END AS flags,
  CASE WHEN arm = 'M10' THEN oc END AS origin, CASE WHEN push_kind = 'Remove' THEN oc END AS destination, CASE WHEN push_kind IN ('Add', 'Update') THEN obj END AS object, CASE WHEN ca = 'C08c' THEN xrev WHEN push_kind IN ('Update', 'Remove') THEN brev END AS if_match FROM dec WHERE push_kind IS NOT NULL""")
def push_plan(spark, sf):
    p = merge.pushes(_full(spark, sf, SyncOptions(conflict=PREFER_LOCAL)))
    return p.select("collection", "handle", "kind", "link_id", fl.text(F.col("flags")).alias("flags"), F.col("origin.collection").alias("origin"), F.col("to").alias("destination"), "object", "if_match")


LAST = """, fin AS (
SELECT collection, handle, 'UpsertPlacement' AS kind, 'Clean' AS status, 0 AS level, NULL AS link_id, NULL AS object, xf AS flags, NULL AS conflict_revision, xf AS base_flags, xrev AS base_revision, NULL AS base_object, NULL AS origin_collection FROM dec WHERE arm IN ('M01', 'M08')
UNION ALL SELECT collection, handle, 'DropPlacement', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM dec WHERE arm IN ('M02', 'M05', 'M07')
UNION ALL SELECT collection, handle, 'UpsertPlacement', 'Created', level, link, obj, lf, NULL, NULL, NULL, NULL, NULL FROM dec WHERE arm = 'M06'
UNION ALL SELECT collection, handle || chr(1) || 'keepboth', 'UpsertPlacement', 'Created', 2, NULL, obj, lf, NULL, NULL, NULL, NULL, NULL FROM dec WHERE ca = 'C08d'
UNION ALL SELECT collection, handle, 'UpsertPlacement', CASE WHEN fa IN ('F00', 'F01', 'F02') AND st <> 'Conflict' THEN 'Clean' ELSE st END, lv, link, ob, CASE WHEN fa = 'F00' THEN xf WHEN fa IN ('F02', 'F04') THEN merged ELSE lf END, cr,
  CASE WHEN fa = 'F00' THEN xf WHEN fa IN ('F01', 'F02') THEN merged WHEN has_base THEN bf END, br, bo, oc FROM dec WHERE marks OR pulls OR ca = 'C03' OR fa IN ('F00', 'F01', 'F02', 'F04'))
SELECT collection, handle, kind, status, level, link_id, object, array_to_string(flags, ',') AS flags, conflict_revision, array_to_string(base_flags, ',') AS base_flags, base_revision, base_object, origin_collection, CASE WHEN origin_collection IS NOT NULL THEN split_part(handle, chr(1), 1) END AS origin_handle FROM fin"""


@query(decided(SyncOptions(conflict=KEEP_BOTH)) + LAST)
def write_ops_last_wins(spark, sf):
    last = wo.last_wins(merge.write_ops(_full(spark, sf, SyncOptions(conflict=KEEP_BOTH))))
    return last.select("collection", "handle", "kind", *shown("placement."))


@query(decided() + "SELECT collection, kind, handle FROM (SELECT collection, handle, unnest(list_concat(CASE WHEN arm IN ('M01', 'M08') THEN ['Added'] WHEN arm = 'M07' THEN ['Vanished'] WHEN marks THEN ['Conflicted'] WHEN pulls THEN ['ContentChanged'] ELSE []::varchar[] END, CASE WHEN fa IN ('F00', 'F02', 'F04') THEN ['FlagsChanged'] ELSE []::varchar[] END)) AS kind FROM dec)")
def sync_events(spark, sf):
    return merge.events(_full(spark, sf)).select("collection", "kind", "handle")


RESULTS = """, res AS (SELECT *, CASE WHEN k % 7 = 0 THEN 'P6' WHEN push_kind = 'SetFlags' THEN 'P1' WHEN push_kind = 'Update' THEN 'P2' WHEN push_kind = 'Remove' THEN 'P3' WHEN k % 2 = 0 THEN 'P4' ELSE 'P5' END AS p FROM dec WHERE push_kind IS NOT NULL AND k % 11 <> 0)"""


@query(decided() + RESULTS + """SELECT collection, handle, p AS "case", CASE WHEN p = 'P4' THEN 'srv-' || handle WHEN p IN ('P1', 'P2') THEN handle END AS placed, CASE WHEN p IN ('P1', 'P4') THEN CASE WHEN p = 'P1' AND st = 'Conflict' THEN 'Conflict' ELSE 'Clean' END WHEN p = 'P2' THEN CASE WHEN tomb THEN 'Tombstone' WHEN lf = bf THEN 'Clean' ELSE 'Dirty' END END AS status,
  array_to_string(CASE WHEN p = 'P1' THEN merged WHEN p = 'P2' THEN bf WHEN p = 'P4' THEN lf END, ',') AS base_flags, CASE WHEN p = 'P1' THEN br WHEN p IN ('P2', 'P4') THEN 'r9' END AS base_revision, CASE WHEN p = 'P1' THEN bo WHEN p IN ('P2', 'P4') THEN obj END AS base_object FROM res""")
def push_outcomes(spark, sf):
    d = _full(spark, sf)
    done = pu.confirm(d, fx.push_results(spark, sf, merge.pushes(d)))
    last = done.select("collection", "handle", "case", F.get("ops", F.size("ops") - 1)["placement"].alias("p"))
    return last.select("collection", "handle", "case", F.col("p.handle").alias("placed"), F.col("p.status").alias("status"), fl.text(F.col("p.base.flags")).alias("base_flags"), F.col("p.base.revision").alias("base_revision"), F.col("p.base.object").alias("base_object"))


@query(decided() + RESULTS + """SELECT d.collection, d.pulled, coalesce(r.pushed, 0) AS pushed, d.conflicts, coalesce(r.rejected, 0) AS rejected, d.refreshed FROM
  (SELECT collection, cast(sum(pulled) AS bigint) AS pulled, count(*) FILTER (marks) AS conflicts, count(*) FILTER (pulls) AS refreshed FROM dec GROUP BY collection) d LEFT JOIN
  (SELECT collection, count(*) FILTER (p <> 'P6') AS pushed, count(*) FILTER (p = 'P6') AS rejected FROM res GROUP BY collection) r ON d.collection = r.collection""")
def sync_report(spark, sf):
    d = _full(spark, sf)
    return pu.report(d, pu.confirm(d, fx.push_results(spark, sf, merge.pushes(d))))


LOG = """e AS (SELECT 'c' || (user_id % 4) AS collection, cast(user_id AS varchar) AS handle, event_id AS seq, event_type FROM events), srv AS (SELECT collection, handle, max(seq) AS seq, arg_max(event_type, seq) AS kind, count(*) FILTER (event_type = 'purchase') AS rev,
  CASE WHEN bool_or(event_type = 'click') AND bool_or(event_type = 'view') THEN 'flagged,seen' WHEN bool_or(event_type = 'click') THEN 'flagged' WHEN bool_or(event_type = 'view') THEN 'seen' ELSE '' END AS flags FROM e GROUP BY collection, handle)"""


@query(f"WITH {LOG}, cur AS (SELECT max(event_id) * 9 // 10 AS c FROM events) SELECT collection, handle, 'item' AS kind, flags, 'r' || rev AS revision FROM srv, cur WHERE kind <> 'error' AND seq > c UNION ALL SELECT DISTINCT e.collection, e.handle, 'vanished', NULL, NULL FROM e, cur WHERE event_type = 'error' AND seq > c AND NOT EXISTS (SELECT 1 FROM srv WHERE srv.kind <> 'error' AND srv.collection = e.collection AND srv.handle = e.handle)")
def enumerate_delta(spark, sf):
    server, log = fx.change_log(spark, sf)
    top = fx.table(spark, sf, "events").agg(F.max("event_id")).first()[0]
    items, gone = enumerate_items(server, log, top * 9 // 10)
    none = F.lit(None).cast("string")
    return items.select("collection", "handle", F.lit("item").alias("kind"), fl.text(F.col("flags")).alias("flags"), "revision").unionByName(gone.select("collection", "handle", F.lit("vanished").alias("kind"), none.alias("flags"), none.alias("revision")))


def _batch(spark: SparkSession, sf: str, kind: str) -> DataFrame:
    """A mutation for every order, unknown handles among them."""
    c, k = F.col, F.col("o_orderkey")
    d = fx.table(spark, sf, "orders")
    n = k.cast("string")
    given = {"flags": F.when(F.lit(kind in ("set_flags", "add")), F.array(F.lit("seen"), F.lit("draft"), F.lit("seen"))), "object": F.when(F.lit(kind in ("edit", "add")), F.concat(F.lit("n"), n)), "meta": F.when((k % 2 == 0) & F.lit(kind == "edit"), F.concat(F.lit("m"), n)), "sort_key": F.when((k % 2 == 0) & F.lit(kind in ("edit", "add")), F.lit("z")),
             "to_collection": F.when(F.lit(kind in ("copy", "move")), F.lit("archive")), "to_handle": F.when(F.lit(kind in ("copy", "move")), F.concat(F.lit("new-"), n)), "link_id": F.when(F.lit(kind == "add"), F.concat(F.lit("l"), n))}
    handle = F.concat(F.lit("tmp-"), n) if kind == "add" else n
    cols = {f.name: F.lit(None).cast(f.dataType) for f in mu.MUTATION.fields} | {"seq": k.cast("int"), "kind": F.lit(kind), "collection": c("o_orderpriority"), "handle": handle} | given
    return d.select(*[cols[f.name].cast(f.dataType).alias(f.name) for f in mu.MUTATION.fields])


def _mutated(kind: str) -> Query:
    def run(spark, sf):
        ops, _ = mu.mutate(fx.replica(spark, sf), _batch(spark, sf, kind))
        return ops.select("collection", "handle", F.col("placement.meta").alias("meta"), F.col("placement.sort_key").alias("sort_key"), *shown("placement."))

    return run


def _mutation_sql(rows: str) -> str:
    return f"""WITH {SIDES}, m AS (SELECT * FROM sides WHERE has_local), key AS (SELECT *, lpad(handle, 10, '0') AS sk FROM m), out AS ({rows})
SELECT collection, handle, meta, sort_key, status, level, link_id, object, array_to_string(flags, ',') AS flags, conflict_revision, CASE WHEN based THEN array_to_string(base_flags, ',') END AS base_flags, CASE WHEN based THEN base_revision END AS base_revision, CASE WHEN based THEN base_object END AS base_object, origin_collection, origin_handle FROM out"""


_ROW = "collection, handle, NULL AS meta, sk AS sort_key, {status} AS status, level, link AS link_id, obj AS object, {flags} AS flags, crev AS conflict_revision, based, bf AS base_flags, 'r0' AS base_revision, bobj AS base_object, oc AS origin_collection, CASE WHEN oc IS NOT NULL THEN handle END AS origin_handle"
_COPY = "SELECT 'archive' AS collection, 'new-' || handle AS handle, NULL AS meta, sk AS sort_key, 'Created' AS status, level, link AS link_id, obj AS object, lf AS flags, NULL AS conflict_revision, false AS based, bf AS base_flags, NULL AS base_revision, NULL AS base_object, collection AS origin_collection, handle AS origin_handle FROM key"
MUTATIONS = {
    "set_flags": "SELECT " + _ROW.format(status="CASE WHEN status = 'Clean' THEN 'Dirty' ELSE status END", flags="['draft', 'seen']") + " FROM key",
    "remove": "SELECT " + _ROW.format(status="'Tombstone'", flags="lf") + " FROM key",
    "edit": "SELECT collection, handle, CASE WHEN k % 2 = 0 THEN 'm' || handle END AS meta, CASE WHEN k % 2 = 0 THEN 'z' ELSE sk END AS sort_key, CASE WHEN status = 'Created' THEN 'Created' ELSE 'Dirty' END AS status, 2 AS level, link AS link_id, 'n' || handle AS object, lf AS flags, NULL AS conflict_revision, based, bf AS base_flags, CASE WHEN status = 'Conflict' THEN crev ELSE 'r0' END AS base_revision, bobj AS base_object, oc AS origin_collection, CASE WHEN oc IS NOT NULL THEN handle END AS origin_handle FROM key",
    "copy": _COPY,
    "move": _COPY + " UNION ALL SELECT collection, handle, NULL, sk, 'Tombstone', level, link, obj, lf, crev, based, bf, 'r0', bobj, 'archive', handle FROM key",
}
for _kind, _sql in MUTATIONS.items():
    query(_mutation_sql(_sql), f"mutate_{_kind}")(_mutated(_kind))

query(f"""WITH {SIDES}, live AS (SELECT DISTINCT collection, link FROM sides WHERE has_local AND status <> 'Tombstone' AND link IS NOT NULL), m AS (SELECT * FROM sides s WHERE NOT EXISTS (SELECT 1 FROM live WHERE live.collection = s.collection AND live.link = 'l' || s.handle))
SELECT collection, 'tmp-' || handle AS handle, NULL AS meta, CASE WHEN k % 2 = 0 THEN 'z' ELSE '' END AS sort_key, 'Created' AS status, 2 AS level, 'l' || handle AS link_id, 'n' || handle AS object, 'draft,seen' AS flags, NULL AS conflict_revision, NULL AS base_flags, NULL AS base_revision, NULL AS base_object, NULL AS origin_collection, NULL AS origin_handle FROM m""", "mutate_add")(_mutated("add"))


@query(f"""WITH {SIDES}, live AS (SELECT DISTINCT collection, link FROM sides WHERE has_local AND status <> 'Tombstone' AND link IS NOT NULL)
SELECT s.collection, 'tmp-' || handle AS handle, 'LinkExists' AS reason FROM sides s JOIN live ON live.collection = s.collection AND live.link = 'l' || s.handle
UNION ALL SELECT collection, handle, 'UnknownHandle' FROM sides WHERE NOT has_local""")
def add_collision(spark, sf):
    rows = fx.replica(spark, sf)
    rejects = [mu.mutate(rows, _batch(spark, sf, kind))[1] for kind in ("add", "remove")]
    return rejects[0].unionByName(rejects[1]).select("collection", "handle", "reason")


LIBRARY = f"""lib AS (SELECT source AS collection, cast(doc_id AS varchar) AS handle, doc_id AS k, cast(doc_id % 3 AS integer) AS level, sha256(text) AS hash, lang || ':' || n_chars AS full_meta, lpad(cast(n_chars AS varchar), 10, '0') AS key, {_set("(doc_id + i - 1) % 3 = 0")} AS flags FROM documents),
known AS (SELECT hash AS link_id, arg_min(hash, (collection, handle)) AS object FROM lib WHERE level = 2 GROUP BY hash)"""


@query(f"WITH {LIBRARY} SELECT link_id, object FROM known")
def lookup_objects(spark, sf):
    return up.lookup_objects(fx.library(spark, sf))


def _after(rows: DataFrame) -> DataFrame:
    return rows.select("collection", "handle", F.col("placement.level").alias("level"), F.col("placement.link_id").alias("link_id"), F.col("placement.meta").alias("meta"), F.col("placement.sort_key").alias("sort_key"), F.col("placement.object").alias("object"), F.col("placement.base.revision").alias("base_revision"), F.col("placement.base.object").alias("base_object"))


@query(f"WITH {LIBRARY} SELECT collection, handle, 1 AS level, hash AS link_id, full_meta AS meta, key AS sort_key, NULL AS object, 'r0' AS base_revision, NULL AS base_object FROM lib WHERE level = 0")
def upgrade_meta(spark, sf):
    rows = fx.library(spark, sf)
    asked = rows.select("collection", "handle").unionByName(rows.select("collection", F.concat(F.lit("nobody-"), "handle").alias("handle")))
    return _after(up.patched(up.pending(rows, asked, META), fx.library_fetched(spark, sf, False), META))


def _upgraded(spark, sf):
    rows = fx.library(spark, sf)
    known, miss = up.split_known(up.pending(rows, rows, FULL), rows)
    return known, up.patched(miss, fx.library_fetched(spark, sf, True), FULL)


@query(f"""WITH {LIBRARY}, t AS (SELECT lib.*, known.object AS have FROM lib LEFT JOIN known ON lib.level = 1 AND lib.hash = known.link_id WHERE level < 2)
SELECT collection, handle, CASE WHEN have IS NULL THEN 'fetched' ELSE 'deduped' END AS outcome, 2 AS level, hash AS link_id, full_meta AS meta, CASE WHEN have IS NOT NULL AND k % 8 = 0 THEN '' ELSE key END AS sort_key, hash AS object, CASE WHEN have IS NULL THEN 'r1' ELSE 'r0' END AS base_revision, CASE WHEN have IS NULL THEN hash END AS base_object FROM t""")
def upgrade_full_dedup(spark, sf):
    known, got = _upgraded(spark, sf)
    return _after(known).withColumn("outcome", F.lit("deduped")).unionByName(_after(got).withColumn("outcome", F.lit("fetched")))


@query(f"""WITH {LIBRARY}, t AS (SELECT known.object AS have FROM lib LEFT JOIN known ON lib.level = 1 AND lib.hash = known.link_id WHERE level < 2) SELECT count(*) AS upgraded, count(*) FILTER (have IS NULL) AS fetched, count(*) FILTER (have IS NOT NULL) AS deduped FROM t""")
def upgrade_report(spark, sf):
    return up.report(*_upgraded(spark, sf)).select(*[F.col(x).cast("long").alias(x) for x in ("upgraded", "fetched", "deduped")])


REKEY = f"""WITH {LIBRARY}, o0 AS (SELECT *, CASE (k // 3) % 9 WHEN 1 THEN 'Dirty' WHEN 7 THEN 'Dirty' WHEN 2 THEN 'Tombstone' WHEN 3 THEN 'Created' WHEN 4 THEN 'Conflict' WHEN 8 THEN 'Conflict' ELSE 'Clean' END AS status FROM lib),
o AS (SELECT *, CASE WHEN status = 'Dirty' AND k % 4 > 0 THEN {_set("((k + i - 1) % 3 = 0) <> ((k + i - 1) % 4 = 1)")} ELSE flags END AS lf, CASE WHEN level > 0 THEN hash END AS link, CASE WHEN level = 2 THEN CASE WHEN status IN ('Dirty', 'Conflict') AND k % 4 < 2 THEN 'e' || handle ELSE hash END END AS obj, CASE WHEN level = 2 THEN hash END AS bobj, CASE WHEN k % 8 = 0 OR level = 0 THEN '' ELSE key END AS okey, CASE WHEN level > 0 THEN full_meta END AS ometa FROM o0 WHERE status <> 'Created'),
ol AS (SELECT * FROM o WHERE link IS NOT NULL QUALIFY row_number() OVER (PARTITION BY collection, link ORDER BY handle DESC) = 1),
n0 AS (SELECT source AS collection, 'v1-' || doc_id AS handle, doc_id AS pos, sha256(text) AS link, lang || ':' || n_chars AS meta, lpad(cast(n_chars AS varchar), 10, '0') AS key FROM documents WHERE doc_id % 12 <> 5 UNION ALL SELECT 'src0', 'b-' || item_id, item_id + 1000000000, sha256(text), 'bench', '' FROM benchmark),
n AS (SELECT collection, handle, pos, link, meta, CASE WHEN pos % 6 = 0 THEN '' ELSE key END AS key, {_set("(pos + i - 1) % 4 = 0")} AS nf, row_number() OVER (PARTITION BY collection, link ORDER BY pos, handle) AS turn FROM n0),
j AS (SELECT n.*, ol.handle AS oh, ol.status AS os, ol.lf AS of, ol.obj, ol.bobj, ol.level AS ol, ol.okey, CASE WHEN ol.handle IS NOT NULL THEN {_merge("ol.flags", "ol.lf", "n.nf")} ELSE nf END AS mf FROM n LEFT JOIN ol ON n.turn = 1 AND n.collection = ol.collection AND n.link = ol.link),
u AS (SELECT o.*, NOT EXISTS (SELECT 1 FROM j WHERE j.collection = o.collection AND j.oh = o.handle) AS free, status IN ('Dirty', 'Conflict') AND obj IS NOT NULL AND obj IS DISTINCT FROM bobj AS staged FROM o)
"""


@query(REKEY + """SELECT collection, handle, CASE WHEN oh IS NULL THEN 'fresh' ELSE 'carried' END AS outcome, CASE WHEN oh IS NULL THEN 'Clean' WHEN os IN ('Tombstone', 'Conflict') THEN os WHEN (os = 'Dirty' AND obj IS NOT NULL AND obj IS DISTINCT FROM bobj) OR mf <> nf THEN 'Dirty' ELSE 'Clean' END AS status, CASE WHEN oh IS NULL THEN 1 ELSE ol END AS level, link AS link_id, obj AS object, array_to_string(mf, ',') AS flags,
  CASE WHEN os = 'Conflict' THEN 'r1' END AS conflict_revision, array_to_string(nf, ',') AS base_flags, 'r1' AS base_revision, bobj AS base_object, NULL AS origin_collection, NULL AS origin_handle, CASE WHEN oh IS NOT NULL AND key = '' THEN okey ELSE key END AS sort_key FROM j
UNION ALL SELECT collection, handle, CASE WHEN NOT free THEN 'moved' WHEN staged THEN 'resurrected' WHEN status <> 'Clean' THEN 'lost' ELSE 'gone' END, CASE WHEN free AND staged THEN 'Created' END, CASE WHEN free AND staged THEN level END, CASE WHEN free AND staged THEN link END, CASE WHEN free AND staged THEN obj END, CASE WHEN free AND staged THEN array_to_string(lf, ',') END, NULL, NULL, NULL, NULL, NULL, NULL, CASE WHEN free AND staged THEN okey END FROM u""")
def rekey_rebuild(spark, sf):
    d = rk.rebuild(*fx.rekeyed(spark, sf)).withColumn("p", F.element_at("ops", -1)["placement"])
    return d.select("collection", "handle", "outcome", *shown("p."), F.col("p.sort_key").alias("sort_key"))


@query(REKEY + "SELECT (SELECT count(*) FROM j WHERE oh IS NOT NULL) + (SELECT count(*) FROM u WHERE free AND staged) AS rekeyed, (SELECT count(*) FROM j WHERE oh IS NULL) AS pulled, (SELECT count(*) FROM u WHERE free AND NOT staged AND status <> 'Clean') AS dropped")
def rekey_report(spark, sf):
    return rk.report(rk.rebuild(*fx.rekeyed(spark, sf)))


HUB = f"""c AS (SELECT c_custkey AS k, cast(c_custkey AS varchar) AS link, c_mktsegment AS seg FROM customer),
items AS (SELECT k, link, {_set("(k + i - 1) % 3 = 0")} AS flags, CASE WHEN k % 13 = 0 THEN NULL WHEN k % 6 = 0 THEN 'er' ELSE 'o0' END AS object, seg AS meta, lpad(link, 10, '0') AS sort_key, 1 AS level, k % 9 = 4 AS deleted FROM c WHERE k % 4 <> 3),
bind AS (SELECT k, link, source, substr(source, 1, 1) || link AS handle, k % 8 <> 5 AS based, CASE WHEN k % 8 = 2 THEN []::varchar[] ELSE {_set("(k + i - 1) % 3 = 0")} END AS bf, k % 14 = 4 + off AS conflicted FROM c, (VALUES ('left', 0), ('right', 1)) s(source, off) WHERE k % 4 <> 3 AND k % 4 <> 1 + off)"""


def _projected(source: str) -> None:
    sql = f"""WITH {HUB} SELECT '{source}' AS collection, coalesce(b.handle, i.link || chr(1) || 'hub') AS handle, sort_key, meta, CASE WHEN b.link IS NULL THEN 'Created' WHEN deleted THEN 'Tombstone' WHEN conflicted THEN 'Conflict' WHEN based AND bf = flags AND object IS NOT DISTINCT FROM 'o0' THEN 'Clean' ELSE 'Dirty' END AS status, CASE WHEN b.link IS NULL THEN 2 ELSE level END AS level,
  i.link AS link_id, object, array_to_string(flags, ',') AS flags, CASE WHEN conflicted AND NOT deleted THEN 'r1' END AS conflict_revision, CASE WHEN based THEN array_to_string(bf, ',') END AS base_flags, CASE WHEN based THEN 'r0' END AS base_revision, CASE WHEN based THEN 'o0' END AS base_object, NULL AS origin_collection, NULL AS origin_handle
  FROM items i LEFT JOIN bind b ON i.link = b.link AND b.source = '{source}' WHERE b.link IS NOT NULL OR (NOT deleted AND object IS NOT NULL)"""
    query(sql, f"hub_project_{source}")(lambda spark, sf: hb.project(*fx.hub(spark, sf), source, source).select("collection", "handle", "sort_key", "meta", *shown()))


for _source in ("left", "right"):
    _projected(_source)


def _absorbed(policy: str) -> None:
    settled = {"manual": ("i.object", "true", "w.object"), "incoming": ("w.object", "false", "NULL"), "existing": ("i.object", "false", "NULL")}[policy]
    pick = lambda n, adopt, keep: f"CASE WHEN i.k IS NULL THEN {adopt} WHEN w.object IS DISTINCT FROM prev AND i.object IS DISTINCT FROM prev AND w.object IS DISTINCT FROM i.object AND w.object IS NOT NULL AND i.object IS NOT NULL THEN {settled[n]} WHEN w.object IS DISTINCT FROM prev AND i.object IS NOT DISTINCT FROM prev THEN {adopt} ELSE {keep} END"
    sql = f"""WITH {HUB}, w AS (SELECT k, link, 'l' || link AS handle, CASE WHEN k % 29 <> 0 THEN CASE WHEN k % 5 = 0 THEN 'el' ELSE 'o0' END END AS object, cast(k % 3 AS integer) AS level, CASE WHEN k % 2 = 0 THEN 'm' END AS meta, CASE WHEN k % 7 = 0 THEN '' ELSE 's' END AS sort_key, {_set("(k + i - 1) % 2 = 0")} AS flags,
  CASE WHEN k % 10 = 1 THEN 'Tombstone' WHEN k % 14 = 3 THEN 'Conflict' ELSE 'Clean' END AS status FROM c WHERE k % 3 <> 0 AND k % 23 <> 0),
lb AS (SELECT *, CASE WHEN based THEN 'o0' END AS prev FROM bind WHERE source = 'left'),
a AS (SELECT coalesce(w.link, i.link) AS link, coalesce(w.k, i.k) AS k, w.k IS NOT NULL AS up, i.k IS NOT NULL AS had, lb.k IS NOT NULL AS lbound, lb.conflicted AS lconf,
  CASE WHEN w.k IS NULL THEN i.flags WHEN w.status = 'Tombstone' THEN coalesce(i.flags, w.flags) ELSE w.flags END AS flags,
  CASE WHEN w.k IS NULL OR w.status = 'Tombstone' THEN CASE WHEN i.k IS NULL THEN w.object ELSE i.object END ELSE {pick(0, "w.object", "i.object")} END AS object,
  CASE WHEN w.k IS NULL OR w.status = 'Tombstone' THEN false ELSE {pick(1, "false", "false")} END AS conflicted, CASE WHEN w.k IS NOT NULL AND w.status <> 'Tombstone' THEN {pick(2, "NULL", "NULL")} END AS conflict_object,
  CASE WHEN w.k IS NULL OR (w.status = 'Tombstone' AND i.k IS NOT NULL) THEN i.meta ELSE coalesce(w.meta, i.meta) END AS meta, CASE WHEN w.k IS NULL OR (w.status = 'Tombstone' AND i.k IS NOT NULL) THEN i.sort_key WHEN w.sort_key = '' AND i.k IS NOT NULL THEN i.sort_key ELSE w.sort_key END AS sort_key,
  CASE WHEN w.k IS NULL OR (w.status = 'Tombstone' AND i.k IS NOT NULL) THEN i.level ELSE greatest(w.level, coalesce(i.level, w.level)) END AS level, CASE WHEN w.k IS NULL THEN i.deleted ELSE w.status = 'Tombstone' END AS deleted, w.status AS ws
  FROM w FULL JOIN items i ON w.link = i.link LEFT JOIN lb ON lb.link = coalesce(w.link, i.link)),
b AS (SELECT *, (up OR lbound) AND k % 11 = 7 AS dropped, (up OR lbound) AND k % 11 <> 7 AS on_left, EXISTS (SELECT 1 FROM bind WHERE source = 'right' AND bind.link = a.link) AS on_right FROM a)
SELECT link AS link_id, array_to_string(flags, ',') AS flags, object, meta, sort_key, level, deleted OR dropped AS deleted, conflicted, conflict_object, on_left, on_right, CASE WHEN on_left THEN CASE WHEN up THEN CASE WHEN ws = 'Conflict' THEN 'r2' END WHEN lconf THEN 'r1' END END AS left_conflict FROM b WHERE on_left OR on_right"""

    @query(sql, f"hub_absorb_{policy}")
    def run(spark, sf):
        items, bindings = hb.absorb(*fx.hub(spark, sf), fx.hub_ops(spark, sf), "left", policy)
        on = bindings.groupBy("link_id").agg(F.bool_or(F.col("source") == "left").alias("on_left"), F.bool_or(F.col("source") == "right").alias("on_right"), F.max(F.when(F.col("source") == "left", F.col("conflict_revision"))).alias("left_conflict"))
        return items.join(on, "link_id").withColumn("flags", fl.text(F.col("flags")))


for _policy in ("manual", "incoming", "existing"):
    _absorbed(_policy)


@query(f"WITH {SIDES}, r AS (SELECT obj AS hash FROM sides WHERE has_local UNION ALL SELECT bobj FROM sides WHERE has_local AND based) SELECT hash, count(*) AS refs FROM r WHERE hash IS NOT NULL GROUP BY hash")
def refcounts(spark, sf):
    return wo.references(fx.replica(spark, sf))


@query(f"WITH {SIDES}, r AS (SELECT obj AS hash FROM sides WHERE has_local UNION ALL SELECT bobj FROM sides WHERE has_local AND based) SELECT h AS hash FROM (SELECT DISTINCT bobj AS h FROM sides WHERE bobj IS NOT NULL) WHERE h NOT IN (SELECT hash FROM r WHERE hash IS NOT NULL)")
def gc_candidates(spark, sf):
    objects = fx._sides(spark, sf).where("bobj IS NOT NULL").select(F.col("bobj").alias("hash")).distinct()
    return wo.collectable(objects, fx.replica(spark, sf))


@query(f"WITH {LIBRARY} SELECT hash AS link_id, string_agg(DISTINCT collection, ',' ORDER BY collection) AS collections, count(*) AS members, max(level) AS level, max(CASE WHEN level = 2 THEN hash END) AS object FROM lib WHERE level > 0 GROUP BY hash")
def unified_view(spark, sf):
    return views.unified(fx.library(spark, sf)).withColumn("collections", F.array_join("collections", ","))


@query(f"WITH {LIBRARY}, s AS (SELECT collection, handle, CASE WHEN k % 8 = 0 OR level = 0 THEN '' ELSE key END AS sort_key FROM lib) SELECT * FROM s ORDER BY sort_key = '', sort_key DESC, collection, handle LIMIT 50")
def sorted_page(spark, sf):
    return views.page(fx.library(spark, sf), 50).select("collection", "handle", "sort_key")


@query(decided() + "SELECT collection, handle FROM sides WHERE has_local AND NOT (collection, handle) IN (SELECT (collection, handle) FROM dec WHERE arm IN ('M02', 'M05', 'M07')) UNION SELECT collection, handle FROM dec WHERE arm IN ('M01', 'M08')")
def soft_delete_load(spark, sf):
    rows = fx.replica(spark, sf).withColumn("hidden", F.lit(False))
    return views.load(wo.apply_ops_soft(rows, merge.write_ops(_full(spark, sf)))).select("collection", "handle")


# Snapshots that contradict themselves, duplicates, single functions

CONTRADICTED = DELTA.replace("WHEN gone THEN false", "WHEN gone OR (in_delta AND k % 41 IN (7, 20)) THEN false")


@query(decided(source=CONTRADICTED) + ARMS + " UNION ALL SELECT collection, 'ghost-' || handle, 'M12', NULL, NULL, NULL, NULL FROM sides WHERE k % 43 = 5")
def merge_vanished_first(spark, sf):
    return _arms(merge.decide(merge.delta_candidates(fx.replica(spark, sf), *fx.contradictory_delta(spark, sf))))


@query(f"WITH {SIDES} SELECT collection, handle, CASE WHEN k % 3 = 0 THEN 'r9' ELSE rrev END AS revision, array_to_string(CASE WHEN k % 3 = 0 THEN ['later'] ELSE rf END, ',') AS flags FROM sides WHERE listed")
def snapshot_last_wins(spark, sf):
    items = fx.remote_items(spark, sf).withColumn("pos", F.lit(1))
    again = items.where("cast(handle AS long) % 3 = 0").select("collection", "handle", F.array(F.lit("later")).alias("flags"), F.lit("r9").alias("revision"), F.lit(2).alias("pos"))
    return merge.latest(again.unionByName(items), F.col("pos")).select("collection", "handle", "revision", fl.text(F.col("flags")).alias("flags"))


@query(f"WITH {SIDES} SELECT k, array_to_string(list_filter(lf, lambda f: NOT list_contains(bf, f)), ',') AS added, array_to_string(list_filter(bf, lambda f: NOT list_contains(lf, f)), ',') AS removed, list_contains(lf, 'seen') AS seen, array_to_string(list_sort(list_distinct(list_concat(rf, ['seen', 'Seen']))), ',') AS canonical FROM sides")
def flag_functions(spark, sf):
    c = F.col
    dirty = fl.canonical(F.concat(F.array(F.lit("seen"), F.lit(None).cast("string"), F.lit("Seen")), F.reverse("rf"), c("rf")))
    return fx._sides(spark, sf).select("k", fl.text(fl.added(c("bf"), c("lf"))).alias("added"), fl.text(fl.removed(c("bf"), c("lf"))).alias("removed"), fl.contains(c("lf"), "seen").alias("seen"), fl.text(dirty).alias("canonical"))


@query("SELECT cast(doc_id AS varchar) AS handle, sha256(text) AS hash FROM documents")
def content_hashes(spark, sf):
    return fx.table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("handle"), content_hash(F.encode("text", "UTF-8")).alias("hash"))


@query(f"WITH {SIDES} SELECT collection, handle FROM sides WHERE has_local AND status = 'Created' AND oc IS NOT NULL AND k % 8 <> 0")
def lingering(spark, sf):
    rows = fx.replica(spark, sf)
    sent = fx._placement(fx._sides(spark, sf).where("k % 8 = 0").withColumn("collection", F.lit("sent")).withColumn("status", F.lit("Clean")), "'x'")
    return views.lingering(rows.unionByName(sent)).select("collection", "handle")


@query(decided() + "SELECT s.collection, s.handle FROM sides s JOIN dec d ON s.collection = d.collection AND s.handle = d.handle WHERE d.pulls AND s.has_local AND s.link IS NOT NULL AND s.based AND s.k % 3 = 0")
def stale_dedup(spark, sf):
    """What a later hydration would fill from another row with the link, after a sync took the bodies of changed items."""
    rows = kept(wo.apply_own(_full(spark, sf)).select("collection", "handle", "link_id", "object", "level", "base"), "replica")
    other = rows.where("link_id IS NOT NULL AND cast(handle AS long) % 3 = 0").withColumn("collection", F.lit("other")).withColumn("object", F.lit("kept"))
    return views.stale_dedup(rows.unionByName(other)).where("collection <> 'other'").select("collection", "handle")


@query(f"""WITH {LIBRARY}, t AS (SELECT *, k % 7 <> 0 AS got FROM lib WHERE level < 2) SELECT collection, handle, CASE WHEN got THEN 2 ELSE 1 END AS level, hash AS link_id, full_meta AS meta, key AS sort_key, CASE WHEN got THEN hash END AS object, CASE WHEN got THEN 'r1' ELSE 'r0' END AS base_revision, CASE WHEN got THEN hash END AS base_object FROM t""")
def upgrade_without_body(spark, sf):
    rows = fx.library(spark, sf)
    return _after(up.patched(up.pending(rows, rows, FULL), fx.library_fetched(spark, sf, True, some=True), FULL))


@query(REKEY + "SELECT collection, handle, key AS sort_key, meta FROM j WHERE oh IS NOT NULL")
def rekey_fetched_keys(spark, sf):
    """Rekey with the fetched sort key and summary taken as they are, empty ones too."""
    rebuilt = rk.rebuild(*fx.rekeyed(spark, sf), prefer_known_sort_key=False).where("outcome = 'carried'")
    return rebuilt.select("collection", "handle", F.col("ops")[0]["placement"]["sort_key"].alias("sort_key"), F.col("ops")[0]["placement"]["meta"].alias("meta"))


@query(decided() + RESULTS + """, p8 AS (SELECT collection, 'ghost-' || handle AS handle FROM dec WHERE k % 9 = 1)
SELECT collection, p AS "case", count(*) AS n, count(*) FILTER (p <> 'P6') AS pushed FROM res GROUP BY collection, p UNION ALL SELECT collection, 'P8', count(*), count(*) FROM p8 GROUP BY collection""")
def push_unmatched(spark, sf):
    """Outcomes of which some were never asked for: an accepted one counts and changes nothing."""
    d = _full(spark, sf)
    own = fx.push_results(spark, sf, merge.pushes(d))
    ghosts = d.where("cast(handle AS long) % 9 = 1").selectExpr("collection", "concat('ghost-', handle) AS handle", "'Accepted' AS outcome", "cast(NULL AS string) AS assigned", "'r9' AS revision", "0 AS seq")
    return pu.confirm(d, own.unionByName(ghosts)).groupBy("collection", "case").agg(F.count(F.lit(1)).alias("n"), F.sum("pushed").alias("pushed"))


@query(decided() + RESULTS + """, ev AS (
  SELECT collection, 0 AS phase, handle AS who, 0::bigint AS turn, handle, unnest(list_concat(CASE WHEN arm IN ('M01', 'M08') THEN ['Added'] WHEN arm = 'M07' THEN ['Vanished'] WHEN marks THEN ['Conflicted'] WHEN pulls THEN ['ContentChanged'] ELSE []::varchar[] END, CASE WHEN fa IN ('F00', 'F02', 'F04') THEN ['FlagsChanged'] ELSE []::varchar[] END)) AS kind FROM dec
  UNION ALL SELECT collection, 1, '', k, CASE WHEN p = 'P4' THEN 'srv-' || handle ELSE handle END, CASE p WHEN 'P1' THEN 'FlagsChanged' WHEN 'P2' THEN 'ContentChanged' WHEN 'P3' THEN 'Vanished' ELSE 'Created' END FROM res WHERE p <> 'P6')
SELECT collection, kind, handle, row_number() OVER (PARTITION BY collection ORDER BY phase, who, turn, CASE kind WHEN 'FlagsChanged' THEN 1 ELSE 0 END) AS place FROM ev""")
def sync_event_order(spark, sf):
    """Events of the merge by handle, then those of the push in order of its results, with their place in the collection's report."""
    d = _full(spark, sf)
    done = pu.confirm(d, fx.push_results(spark, sf, merge.pushes(d)))
    every = merge.events(d).unionByName(pu.confirm_events(done))
    at = Window.partitionBy("collection").orderBy("phase", F.when(F.col("phase") == 0, F.col("handle")), "seq")
    return every.select("collection", "kind", "handle", F.row_number().over(at).cast("long").alias("place"))


# Stores and remotes


@query(f"WITH {LOG} SELECT collection, handle, flags, 'r' || rev AS revision, 'complete' AS snapshot FROM srv WHERE kind <> 'error' UNION ALL SELECT collection, handle, flags, 'r' || rev, 'bad cursor' FROM srv WHERE kind <> 'error'")
def enumerate_complete(spark, sf):
    """Complete snapshots, asked for without a cursor and with one that can't be read; nothing is said to have vanished."""
    remote = TableRemote(spark, fx.logged(spark, sf)[0])
    remote.log = fx.logged(spark, sf)[1]
    parts = []
    for name, cursor in (("complete", None), ("bad cursor", b"\xff?")):
        for k in range(4):
            told = remote.enumerate(f"c{k}", cursor)
            parts.append(told.items.where(F.lit(told.complete)).select("collection", "handle", fl.text(F.col("flags")).alias("flags"), "revision", F.lit(name).alias("snapshot")))
            parts.append(told.vanished.select("collection", "handle", F.lit("vanished").alias("flags"), F.lit("").alias("revision"), F.lit(name).alias("snapshot")))
    return reduce(DataFrame.unionByName, parts)


def _fetched(full: bool) -> Query:
    def run(spark, sf):
        server = fx.server(spark, sf)
        asked = server.selectExpr("IF(seq % 5 = 0, concat('nobody-', handle), handle) AS handle").orderBy(F.desc("handle"))
        got = TableRemote(spark, server.withColumn("collection", F.lit("all"))).fetch("all", asked, full)
        return got.select("handle", "link_id", "meta", "sort_key", "object", "size", F.sha2("bytes", 256).alias("body"), "revision")

    return run


for _name, _body in (("fetch_meta", False), ("fetch_full", True)):
    _given = "sha256(text) AS object, cast(strlen(text) AS bigint) AS size, sha256(text) AS body" if _body else "NULL AS object, cast(NULL AS bigint) AS size, NULL AS body"
    query(f"SELECT cast(doc_id AS varchar) AS handle, sha256(text) AS link_id, lang || ':' || n_chars AS meta, lpad(cast(n_chars AS varchar), 10, '0') AS sort_key, {_given}, 'r' || (doc_id % 3) AS revision FROM documents WHERE (doc_id + 1) % 5 <> 0", _name)(_fetched(_body))


OUT = """WITH o AS (SELECT 'all' AS collection, doc_id AS k, cast(doc_id AS varchar) AS h, 'r' || (doc_id % 3) AS rev, doc_id % 10 AS m FROM documents), p AS (SELECT *, CASE WHEN m IN (1, 4, 6) THEN 'none-' || h WHEN m > 6 THEN 'new-' || h ELSE h END AS handle, k % 4 = 1 AND m IN (2, 3, 5) AS stale FROM o),
q AS (SELECT *, row_number() OVER (ORDER BY handle) AS n, (SELECT max(doc_id) + 1 FROM documents) AS clock, (m IN (2, 3, 5) AND stale) OR m = 6 OR (m = 7 AND k % 4 >= 2) AS refused FROM p),
r AS (SELECT *, CASE WHEN NOT refused THEN CASE m WHEN 7 THEN h || '-copy' WHEN 8 THEN 'app-' || (clock + n) END END AS assigned FROM q)
"""


def _pushed(spark, sf) -> tuple[TableRemote, DataFrame]:
    shared_folder(spark)
    remote = TableRemote(spark, fx.server(spark, sf).withColumn("collection", F.lit("all")))
    changes = fx.outgoing(spark, sf).withColumn("collection", F.lit("all")).withColumn("origin", F.when(F.col("origin").isNotNull(), F.col("origin").withField("collection", F.lit("all"))))
    return remote, remote.push("all", changes.select("collection", *[F.col(f.name).cast(f.dataType) for f in CHANGE.fields]))


@query(OUT + "SELECT handle, CASE WHEN refused THEN 'Rejected' ELSE 'Accepted' END AS outcome, assigned, CASE WHEN NOT refused THEN CASE WHEN m = 5 THEN 'r' || (k % 3 + 1) WHEN m IN (7, 8) THEN 'r1' WHEN m IN (0, 2, 3) THEN rev END END AS revision FROM r")
def push_remote(spark, sf):
    """What a remote answers to changes of every kind: stale ones, those of missing handles, moves, copies and appended items."""
    return _pushed(spark, sf)[1].select("handle", "outcome", "assigned", "revision")


@query(OUT + """SELECT 'all' AS collection, h AS handle, array_to_string(CASE WHEN m = 0 THEN ['draft', 'seen'] ELSE """ + _set("(k + i - 1) % 3 = 0") + """ END, ',') AS flags, CASE WHEN m = 5 AND NOT refused THEN 'body-' || h ELSE (SELECT sha256(text) FROM documents WHERE doc_id = k) END AS object, k % 3 + CASE WHEN m = 5 AND NOT refused THEN 1 ELSE 0 END AS rev, CASE WHEN m IN (0, 5) AND NOT refused THEN clock + n ELSE k + 1 END AS seq FROM r WHERE NOT (m IN (2, 3) AND NOT refused)
UNION ALL SELECT 'archive', h || '-moved', array_to_string(""" + _set("(k + i - 1) % 3 = 0") + """, ','), (SELECT sha256(text) FROM documents WHERE doc_id = k), k % 3, clock + n FROM r WHERE m = 2 AND NOT refused
UNION ALL SELECT 'all', assigned, 'draft,seen', CASE WHEN m = 7 THEN (SELECT sha256(text) FROM documents WHERE doc_id = k) ELSE 'body-' || h END, 1, clock + n FROM r WHERE assigned IS NOT NULL""")
def push_remote_server(spark, sf):
    """The server after those changes."""
    return _pushed(spark, sf)[0].server.select("collection", "handle", fl.text(F.col("flags")).alias("flags"), "object", "rev", "seq")


@query(decided() + LAST.split("SELECT collection, handle, kind, status")[0] + """, kept AS (SELECT * FROM sides s WHERE has_local AND NOT EXISTS (SELECT 1 FROM fin WHERE fin.collection = s.collection AND fin.handle = s.handle))
SELECT collection, handle, status, level, link AS link_id, obj AS object, array_to_string(lf, ',') AS flags, crev AS conflict_revision, CASE WHEN based THEN array_to_string(bf, ',') END AS base_flags, CASE WHEN based THEN 'r0' END AS base_revision, CASE WHEN based THEN bobj END AS base_object, oc AS origin_collection, CASE WHEN oc IS NOT NULL THEN handle END AS origin_handle FROM kept
UNION ALL SELECT collection, handle, status, level, link_id, object, array_to_string(flags, ','), conflict_revision, array_to_string(base_flags, ','), base_revision, base_object, origin_collection, CASE WHEN origin_collection IS NOT NULL THEN handle END FROM fin WHERE kind = 'UpsertPlacement'""")
def store_load(spark, sf):
    """A replica written to a store, a merge's operations written after it, and what open shows of each collection then."""
    store = scratch_store(spark)
    rows = fx.replica(spark, sf)
    store.write(rows.select(F.lit(0).alias("phase"), F.lit(0).alias("seq"), F.lit("UpsertPlacement").alias("kind"), "collection", "handle", F.struct(*rows.columns).alias("placement")))
    store.write(merge.write_ops(merge.decide(merge.full_candidates(store.placements, fx.remote_items(spark, sf)))))
    names = sorted(r[0] for r in store.placements.select("collection").distinct().collect())
    return reduce(DataFrame.unionByName, [store.load(n)[0] for n in names]).select("collection", "handle", *shown())


@query("SELECT sha256(text) AS hash, max(cast(strlen(text) AS bigint)) AS size, sha256(text) AS body FROM documents GROUP BY sha256(text)")
def store_objects(spark, sf):
    """Bodies told by hash in three commits: first some without bytes, then all with them, then all again."""
    store = scratch_store(spark)
    body = fx.server(spark, sf).selectExpr("object AS hash", "size", "bytes")
    none = merge.write_ops(_full(spark, sf)).limit(0)
    for given in (body.where("pmod(hash(hash), 2) = 0").withColumn("bytes", F.lit(None).cast("binary")), body, body):
        store.write(none, given)
    return store.objects.select("hash", "size", F.sha2("bytes", 256).alias("body"))


@query("SELECT DISTINCT o_orderpriority AS collection, 'second' AS mark, 'batch-2' AS batch FROM orders")
def store_checkpoints(spark, sf):
    """Checkpoints, set twice for each collection; the mark of a stream's batch stays through other commits."""
    store = scratch_store(spark)
    none = merge.write_ops(_full(spark, sf)).limit(0)
    names = sorted(r[0] for r in fx.table(spark, sf, "orders").select("o_orderpriority").distinct().collect())
    for mark in ("first", "second"):
        for k, name in enumerate(names):
            store.write(none, checkpoint=(name, mark.encode()), batch=None if k else f"batch-{1 + (mark == 'second')}", stream="s")
    rows = [(n, store.load(n)[1].decode(), store.last_batch("s")) for n in names]
    return spark.createDataFrame(rows, "collection string, mark string, batch string")


@query(f"""WITH {LOG}, s AS (SELECT * FROM srv WHERE kind <> 'error') SELECT run, count(*) FILTER (run = 'first' OR (run = 'full' AND cast(handle AS bigint) % 3 = 0)) AS pulled FROM s, (VALUES ('first'), ('delta'), ('full')) r(run) GROUP BY run""")
def sync_full_override(spark, sf):
    """Items that go without a trace in the server's log: a sync from the cursor can't see it, a full one does."""
    items = fx.logged(spark, sf)[0].withColumn("collection", F.lit("all"))
    engine = Engine(scratch_store(spark), TableRemote(spark, items))
    found = [("first", engine.sync("all")["pulled"])]
    engine.remote.server = items.where("cast(handle AS long) % 3 <> 0")
    found += [(run, engine.sync("all", options)["pulled"]) for run, options in (("delta", SyncOptions()), ("full", SyncOptions(full=True)))]
    return spark.createDataFrame(found, "run string, pulled long")


@query(f"""WITH {LOG} SELECT 'c0' AS collection, 0::bigint AS rekeyed, count(*) AS pulled, 0::bigint AS dropped, 0::bigint AS fetches FROM srv WHERE kind <> 'error' AND collection = 'c0'""")
def rekey_unlinked(spark, sf):
    """A collection of which no row has a link is rebuilt without a fetch."""
    items, _ = fx.logged(spark, sf)
    engine = Engine(scratch_store(spark), TableRemote(spark, items))
    engine.sync("c0")
    engine.remote.server = items.withColumn("handle", F.concat(F.lit("v1-"), "handle"))
    told = engine.rekey("c0")
    return spark.createDataFrame([("c0", told["rekeyed"], told["pulled"], told["dropped"], engine.remote.calls["fetch"])], "collection string, rekeyed long, pulled long, dropped long, fetches long")


@query("""WITH e AS (SELECT 'c' || (user_id % 4) AS collection, cast(user_id AS varchar) AS handle, arg_max(event_type, event_id) AS kind, max(event_id) AS seq FROM events GROUP BY ALL)
SELECT collection, handle, 'Clean' AS status, CASE kind WHEN 'view' THEN 'seen' WHEN 'click' THEN 'flagged,seen' WHEN 'signup' THEN 'draft' ELSE '' END AS flags, 'r' || seq AS base_revision FROM e WHERE kind <> 'error'""")
def stream_sync(spark, sf):
    """events as a stream of changes in four files, each a micro-batch, merged into a store; then the stream is started again."""
    store, root = scratch_store(spark), f"{shared_folder(spark)}/feed-{uuid.uuid4().hex}"
    rows = fx.feed(spark, sf)
    top = rows.agg(F.max("seq")).first()[0] + 1
    for k in range(4):
        rows.where((F.col("seq") * 4 / top).cast("int") == k).coalesce(1).write.mode("append").parquet(f"{root}/changes")
    changes = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/changes")
    for _ in range(2):
        sync_stream(changes, store, f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    store.refresh()
    return store.placements.select("collection", "handle", "status", fl.text(F.col("flags")).alias("flags"), F.col("base.revision").alias("base_revision"))


@query(f"""WITH {SIDES}, m AS (SELECT *, 'l' || handle AS l FROM sides)
SELECT collection, handle, 'Dirty' AS status, 'draft,seen' AS flags, 'n' || handle AS object, CASE WHEN oc IS NOT NULL THEN oc || '/' || handle END AS origin FROM m WHERE has_local AND status <> 'Created' UNION ALL SELECT collection, handle, 'Created', 'draft,seen', 'n' || handle, CASE WHEN oc IS NOT NULL THEN oc || '/' || handle END FROM m WHERE has_local AND status = 'Created'
UNION ALL SELECT 'archive', 'new-' || handle, 'Created', 'flagged', 'n' || handle, collection || '/' || handle FROM m WHERE has_local
UNION ALL SELECT collection, 'tmp-' || handle, 'Tombstone', '', 'a' || handle, NULL FROM m""")
def mutate_in_order(spark, sf):
    """On each handle flags, then a body, then a copy; then flags on the copy; two adds of one link, of which the second is refused,
    and a removal of the first: six mutations an order in one batch, each seeing what the ones before it left."""
    c, k = F.col, F.col("o_orderkey")
    n = k.cast("string")
    d = fx.table(spark, sf, "orders").withColumn("s", (k * 10).cast("int"))

    def of(seq: int, kind: str, handle: Column, collection: Column = F.col("o_orderpriority"), **given: Column) -> DataFrame:
        have = {"seq": c("s") + seq, "kind": F.lit(kind), "collection": collection, "handle": handle, **given}
        return d.select(*[(have.get(f.name, F.lit(None))).cast(f.dataType).alias(f.name) for f in mu.MUTATION.fields])

    new, tmp = F.concat(F.lit("new-"), n), F.concat(F.lit("tmp-"), n)
    link = F.concat(F.lit("fresh-"), n)
    parts = [
        of(1, "set_flags", n, flags=F.array(F.lit("seen"), F.lit("draft"))), of(2, "edit", n, object=F.concat(F.lit("n"), n)), of(3, "copy", n, to_collection=F.lit("archive"), to_handle=new), of(4, "set_flags", new, F.lit("archive"), flags=F.array(F.lit("flagged"))),
        of(5, "add", tmp, object=F.concat(F.lit("a"), n), link_id=link), of(6, "add", F.concat(F.lit("two-"), n), object=F.concat(F.lit("b"), n), link_id=link), of(7, "remove", tmp),
    ]
    shared_folder(spark)
    ops, _ = mu.mutate(fx.replica(spark, sf), reduce(DataFrame.unionByName, parts))
    last = wo.last_wins(ops).select("placement.*")
    origin = F.when(c("origin").isNotNull(), F.concat_ws("/", "origin.collection", "origin.handle"))
    return last.select("collection", "handle", "status", fl.text(c("flags")).alias("flags"), "object", origin.alias("origin"))
