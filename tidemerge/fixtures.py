"""Replicas, remotes and hubs derived from the test tables, in integer arithmetic that any engine can repeat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .model import DROP, ORIGIN, PLACEMENT, base_of, op, struct, upsert
from .plans import text as x
from .sources.remote import LOG, SERVER

FLAG_NAMES = ("answered", "draft", "flagged", "seen")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def flags_where(condition) -> Column:
    """The flags for whose number (0 to 3) the condition holds."""
    return F.filter(F.array(*[F.lit(x) for x in FLAG_NAMES]), lambda x, i: condition(i))


def flags_text(condition: str) -> str:
    """SQL: the flags for whose number i the condition holds."""
    return f"filter(array('answered', 'draft', 'flagged', 'seen'), (x, i) -> {condition})"


def _sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each order, with both sides' raw fields."""
    d = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS k", "o_orderpriority AS collection", "cast(o_orderkey AS string) AS handle")
    d = d.selectExpr("*", "k % 17 <> 3 AS has_local", "k % 13 <> 5 AS listed", "k % 11 <> 6 AS based", "k % 5 <> 0 AS has_obj", "k % 7 = 2 AS content_edit", "k % 4 = 0 AS is_move")
    d = d.selectExpr("*", "CASE WHEN k % 19 = 4 THEN 'Tombstone' WHEN k % 29 = 8 AND based THEN 'Conflict' WHEN NOT based AND k % 2 = 0 THEN 'Created' WHEN k % 7 = 2 OR k % 3 = 1 THEN 'Dirty' ELSE 'Clean' END AS status")
    base = "((k + i * 3) % 5 < 2)"
    d = d.selectExpr(
        "*", f"{flags_text(base)} AS bf", f"{flags_text(base + " <> (status = 'Dirty' AND k % 3 = 1 AND (k * 3 + i) % 7 = 0)")} AS lf", f"{flags_text(base + ' <> ((k * 5 + i * 7) % 23 = 0)')} AS rf",
        "IF(has_obj, concat('o', handle), NULL) AS bobj", "IF(has_obj, concat(IF(content_edit, 'e', 'o'), handle), NULL) AS obj",
        "CASE WHEN status = 'Conflict' THEN IF(k % 10 = 1, 'r2', 'r1') WHEN k % 31 = 0 THEN NULL WHEN k % 10 = 1 THEN 'r1' ELSE 'r0' END AS rrev", "IF(status = 'Conflict', 'r1', NULL) AS crev", "CASE WHEN has_obj THEN 2 WHEN k % 3 = 0 THEN 0 ELSE 1 END AS level",
    )
    return d


def _placement(d: DataFrame, link: str) -> DataFrame:
    origin = f"CASE WHEN status = 'Tombstone' AND is_move THEN {x.struct(ORIGIN, collection="'archive'", handle='handle')} WHEN status = 'Created' AND is_move THEN {x.struct(ORIGIN, collection="'sent'", handle='handle')} END"
    base = f"IF(based, {x.base_of('bf', "'r0'", 'bobj')}, NULL)"
    row = x.placement(collection="collection", handle="handle", link_id=f"IF(level > 0, {link}, NULL)", object="obj", level="level", sort_key="lpad(handle, 10, '0')", flags="lf", status="status", conflict_revision="crev", base=base, origin=origin)
    return d.where("has_local").selectExpr(f"{row} AS p").select("p.*")


def replica(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _placement(_sides(spark, sf_dir), "concat('l', handle)")


def remote_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sides(spark, sf_dir).where("listed").select("collection", "handle", F.col("rf").alias("flags"), F.col("rrev").alias("revision"))


def delta(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(items, vanished) that an incremental snapshot lists."""
    d = _sides(spark, sf_dir)
    changed = "NOT has_local OR NOT based OR rf <> bf OR coalesce(rrev = 'r2', false) OR (status <> 'Conflict' AND coalesce(rrev = 'r1', false))"
    items = d.where(f"listed AND ({changed})").selectExpr("collection", "handle", "rf AS flags", "rrev AS revision")
    return items, d.where("has_local AND based AND NOT listed").select("collection", "handle")


def contradictory_delta(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """As delta, but some of what is listed is said to have vanished too, as are handles that nobody knows."""
    items, gone = delta(spark, sf_dir)
    both = items.where("cast(handle AS long) % 41 IN (7, 20)").select("collection", "handle")
    ghosts = _sides(spark, sf_dir).where("k % 43 = 5").selectExpr("collection", "concat('ghost-', handle) AS handle")
    return items, gone.unionByName(both).unionByName(ghosts)


def push_results(spark: SparkSession, sf_dir: str, pushes: DataFrame) -> DataFrame:
    """Outcomes by the handle's number: some are refused, some never reported."""
    n = F.col("handle").cast("long")
    told = pushes.where(n % 11 != 0)
    return told.select("collection", "handle", F.when(n % 7 == 0, "Rejected").otherwise("Accepted").alias("outcome"), F.when(n % 2 == 0, F.concat(F.lit("srv-"), "handle")).alias("assigned"), F.lit("r9").alias("revision"), n.cast("int").alias("seq"))


def library(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as placements: sources are collections, exact copies share a link."""
    k, c = F.col("doc_id"), F.col
    d = table(spark, sf_dir, "documents").withColumn("hash", F.sha2("text", 256)).withColumn("level", (k % 3).cast("int"))
    flags = flags_where(lambda i: (k + i) % 3 == 0)
    obj = F.when(c("level") == 2, c("hash"))
    row = struct(PLACEMENT, collection=c("source"), handle=k.cast("string"), link_id=F.when(c("level") > 0, c("hash")), object=obj, level=c("level"), meta=F.when(c("level") > 0, F.concat_ws(":", "lang", "n_chars")),
                 sort_key=F.when((k % 8 == 0) | (c("level") == 0), "").otherwise(F.lpad(c("n_chars").cast("string"), 10, "0")), flags=flags, status=F.lit("Clean"), base=base_of(flags, F.lit("r0"), obj))
    return d.select(row.alias("p")).select("p.*")


def library_fetched(spark: SparkSession, sf_dir: str, full: bool, some: bool = False) -> DataFrame:
    """What a remote of documents answers to a fetch; with some, one body in seven is missing."""
    d = table(spark, sf_dir, "documents")
    body = F.sha2("text", 256) if full else F.lit(None).cast("string")
    if some:
        body = F.when(F.col("doc_id") % 7 != 0, body)
    return d.select(F.col("source").alias("collection"), F.col("doc_id").cast("string").alias("handle"), F.sha2("text", 256).alias("link_id"), F.concat_ws(":", "lang", "n_chars").alias("meta"), F.lpad(F.col("n_chars").cast("string"), 10, "0").alias("sort_key"), body.alias("object"), F.octet_length("text").cast("long").alias("size"), F.lit(None).cast("binary").alias("bytes"), F.lit("r1").alias("revision"))


def rekeyed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(old placements, new items, fetched summaries) of a library whose handles were assigned anew."""
    c, k = F.col, F.col("handle").cast("long")
    old = library(spark, sf_dir)
    old = old.withColumn("status", F.expr("element_at(array('Clean', 'Dirty', 'Tombstone', 'Created', 'Conflict', 'Clean', 'Clean', 'Dirty', 'Conflict'), cast(cast(handle AS long) div 3 % 9 + 1 AS int))"))
    old = old.withColumn("object", F.when(c("object").isNotNull() & c("status").isin("Dirty", "Conflict") & (k % 4 < 2), F.concat(F.lit("e"), "handle")).otherwise(c("object")))
    old = old.withColumn("flags", F.when((c("status") == "Dirty") & (k % 4 > 0), flags_where(lambda i: ((k + i) % 3 == 0) != ((k + i) % 4 == 1))).otherwise(c("flags")))
    docs = table(spark, sf_dir, "documents").where("doc_id % 12 <> 5").select(c("source").alias("collection"), F.concat(F.lit("v1-"), c("doc_id").cast("string")).alias("handle"), c("doc_id").alias("pos"), "text", F.concat_ws(":", "lang", "n_chars").alias("meta"), F.lpad(c("n_chars").cast("string"), 10, "0").alias("sort_key"))
    more = table(spark, sf_dir, "benchmark").select(F.lit("src0").alias("collection"), F.concat(F.lit("b-"), c("item_id").cast("string")).alias("handle"), (c("item_id") + 1_000_000_000).alias("pos"), "text", F.lit("bench").alias("meta"), F.lit("").alias("sort_key"))
    every = docs.unionByName(more)
    items = every.select("collection", "handle", flags_where(lambda i: (c("pos") + i) % 4 == 0).alias("flags"), F.lit("r1").alias("revision"), "pos")
    return old, items, every.select("collection", "handle", F.sha2("text", 256).alias("link_id"), "meta", F.when(c("pos") % 6 == 0, "").otherwise(c("sort_key")).alias("sort_key"))


def hub(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(items, bindings) of customers behind the sources left and right."""
    k, c = F.col("c_custkey"), F.col
    d = table(spark, sf_dir, "customer").withColumn("link_id", k.cast("string"))
    flags = flags_where(lambda i: (k + i) % 3 == 0)
    items = d.where(k % 4 != 3).select("link_id", flags.alias("flags"), F.when(k % 13 == 0, F.lit(None)).when(k % 6 == 0, "er").otherwise("o0").alias("object"), c("c_mktsegment").alias("meta"), F.lpad("link_id", 10, "0").alias("sort_key"), F.lit(1).alias("level"), (k % 9 == 4).alias("deleted"), F.lit(False).alias("conflicted"), F.lit(None).cast("string").alias("conflict_object"))
    own = F.when(k % 8 != 5, base_of(F.when(k % 8 == 2, F.array().cast("array<string>")).otherwise(flags), F.lit("r0"), F.lit("o0")))

    def bound(source: str, off: int) -> DataFrame:
        clash = k % 14 == 4 + off
        return d.where((k % 4 != 3) & (k % 4 != 1 + off)).select("link_id", F.lit(source).alias("source"), F.concat(F.lit(source[0]), "link_id").alias("handle"), own.alias("base"), clash.alias("conflicted"), F.when(clash, "r1").alias("conflict_revision"))

    return items, bound("left", 0).unionByName(bound("right", 1))


def hub_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a sync of left wrote: upserts, some followed by a drop."""
    k, c = F.col("c_custkey"), F.col
    d = table(spark, sf_dir, "customer").withColumn("link", k.cast("string")).withColumn("handle", F.concat(F.lit("l"), "link"))
    flags = flags_where(lambda i: (k + i) % 2 == 0)
    status = F.when(k % 10 == 1, "Tombstone").when(k % 14 == 3, "Conflict").otherwise("Clean")
    body = F.when(k % 5 == 0, "el").otherwise("o0")
    row = struct(PLACEMENT, collection=F.lit("left"), handle=c("handle"), link_id=F.when(k % 23 != 0, c("link")), object=F.when(k % 29 != 0, body), level=(k % 3).cast("int"), meta=F.when(k % 2 == 0, "m"), sort_key=F.when(k % 7 == 0, "").otherwise("s"), flags=flags, status=status, conflict_revision=F.when(status == "Conflict", "r2"), base=base_of(flags, F.lit("r1"), body))
    ups = d.where(k % 3 != 0).select(F.lit(0).alias("phase"), c("handle").alias("of"), F.lit(0).alias("seq"), upsert(row).alias("op"))
    drops = d.where(k % 11 == 7).select(F.lit(0).alias("phase"), c("handle").alias("of"), F.lit(1).alias("seq"), op(DROP, F.lit("left"), c("handle")).alias("op"))
    return ups.unionByName(drops).select("phase", "of", "seq", "op.*")


def change_log(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(server items, removals) that events leave: the last event of a user decides whether the item exists."""
    c = F.col
    e = table(spark, sf_dir, "events").select(F.concat(F.lit("c"), (c("user_id") % 4).cast("string")).alias("collection"), c("user_id").cast("string").alias("handle"), c("event_id").alias("seq"), "event_type")
    last = e.groupBy("collection", "handle").agg(F.max("seq").alias("seq"), F.max_by("event_type", "seq").alias("kind"), F.count_if(c("event_type") == "purchase").alias("rev"), F.array_sort(F.collect_set(F.when(c("event_type") == "view", "seen").when(c("event_type") == "click", "flagged"))).alias("flags"))
    return last.where("kind <> 'error'").select("collection", "handle", "flags", "seq", "rev"), e.where("event_type = 'error'").select("collection", "handle", "seq")


def server(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as the items of a server: sources are collections, bodies are the texts."""
    given = {"collection": "source", "handle": "cast(doc_id AS string)", "link_id": "sha2(text, 256)", "flags": flags_text("(doc_id + i) % 3 = 0"), "object": "sha2(text, 256)", "size": "octet_length(text)", "bytes": "encode(text, 'UTF-8')", "seq": "doc_id + 1", "rev": "doc_id % 3", "meta": "concat_ws(':', lang, n_chars)", "sort_key": "lpad(cast(n_chars AS string), 10, '0')"}
    return table(spark, sf_dir, "documents").selectExpr(*[f"cast({given[f.name]} AS {f.dataType.simpleString()}) AS {f.name}" for f in SERVER.fields])


def logged(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """change_log with all columns of a server and of its log."""
    items, log = change_log(spark, sf_dir)
    have = {"collection", "handle", "flags", "seq", "rev"}
    return items.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in SERVER.fields]), log.select(*[F.col(f.name).cast(f.dataType) for f in LOG.fields])


def outgoing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of every kind to the items of server(), due and stale, for handles that exist and that don't."""
    d = table(spark, sf_dir, "documents").selectExpr("source AS collection", "doc_id AS k", "cast(doc_id AS string) AS h", "concat('r', doc_id % 3) AS rev")
    handle = "CASE WHEN k % 10 IN (1, 4, 6) THEN concat('none-', h) WHEN k % 10 > 6 THEN concat('new-', h) ELSE h END"
    kind = "CASE WHEN k % 10 < 2 THEN 'SetFlags' WHEN k % 10 < 5 THEN 'Remove' WHEN k % 10 < 7 THEN 'Update' ELSE 'Add' END"
    origin = f"CASE WHEN k % 10 = 7 THEN {x.struct(ORIGIN, collection='collection', handle='IF(k % 4 < 2, h, concat("gone-", h))')} END".replace('"gone-"', "'gone-'")
    return d.selectExpr("collection", f"{kind} AS kind", f"{handle} AS handle", "IF(k % 10 = 8, concat('link-', h), NULL) AS link_id", "array('seen', 'draft') AS flags", f"{origin} AS origin", "IF(k % 10 = 2, 'archive', NULL) AS to", "IF(k % 10 IN (5, 6, 8), concat('body-', h), NULL) AS object", "IF(k % 4 = 1, 'r9', rev) AS if_match")


def feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as changes of a stream (collection, handle, flags, revision, removed, seq)."""
    flags = "CASE event_type WHEN 'view' THEN array('seen') WHEN 'click' THEN array('flagged', 'seen') WHEN 'signup' THEN array('draft') ELSE cast(array() AS array<string>) END"
    return table(spark, sf_dir, "events").selectExpr("concat('c', user_id % 4) AS collection", "cast(user_id AS string) AS handle", f"{flags} AS flags", "concat('r', event_id) AS revision", "event_type = 'error' AS removed", "event_id AS seq")
