"""The store: commits are all or nothing wherever a writer dies."""

import pytest
from pyspark.sql import functions as F

from tidemerge.model import OBJECT, OP, ConflictError, StorageError, T
from tidemerge.sources.storage import TableStore

ROW = ("link", "body", 2, "m", "k", ["seen"], "Clean", None, None, None)


def puts(spark, *keys, kind="UpsertPlacement"):
    rows = [(0, i, kind, c, h, (c, h, *ROW)) for i, (c, h) in enumerate(keys)]
    return spark.createDataFrame(rows, T.StructType().add("phase", "integer").add("seq", "integer").add("kind", "string").add("collection", "string").add("handle", "string").add("placement", OP["placement"].dataType))


def keys(store):
    store.refresh()
    return sorted((r.collection, r.handle) for r in store.placements.select("collection", "handle").collect())


class Died(BaseException):
    pass


def test_a_writer_may_die_at_any_step(spark, tmp_path):
    root = f"file://{tmp_path}/store"
    store = TableStore(spark, root)
    store.write(puts(spark, ("a", "1"), ("b", "2")), checkpoint=("a", b"c1"), batch="b1", stream="s")
    bodies = spark.createDataFrame([("h", 1, bytearray(b"x"))], OBJECT)

    def dies(*a):
        raise Died

    for step in ("_write_placements", "_write_objects", "_put"):
        for after in (False, True):
            if step == "_put" and after:
                continue
            writer = TableStore(spark, root)
            own = getattr(writer, step)
            setattr(writer, step, (lambda *a, own=own: (own(*a), dies())) if after else dies)
            with pytest.raises(Died):
                writer.write(puts(spark, ("a", "3")), bodies, checkpoint=("a", b"c2"), batch="b2", stream="s")
            again = TableStore(spark, root)
            assert keys(again) == [("a", "1"), ("b", "2")] and again.load("a")[1] == b"c1" and again.last_batch("s") == "b1" and again.objects.count() == 0
    (tmp_path / "store/manifests" / f"{9:020d}.json").write_text('{"version": 9, "coll')  # a manifest cut short
    assert keys(TableStore(spark, root)) == [("a", "1"), ("b", "2")]
    for f in (tmp_path / "store/manifests").glob("*.json"):
        f.unlink()
    with pytest.raises(StorageError, match="no manifest"):
        TableStore(spark, root)


def test_commits_touch_what_they_change_and_keep_marks(spark, tmp_path):
    store = TableStore(spark, f"file://{tmp_path}/store")
    store.write(puts(spark, ("a", "1"), ("b/x y", "2"), ("", "3")), batch="b1", stream="s")
    before = store.manifest()["collections"]
    store.write(puts(spark, ("a", "4")))
    after = store.manifest()
    assert after["collections"]["b/x y"] == before["b/x y"] and after["collections"]["a"] != before["a"] and store.last_batch("s") == "b1" and store.last_batch("other") == ""
    assert sorted(r.handle for r in store.load("a")[0].collect()) == ["1", "4"] and store.load("")[0].count() == 1
    store.write(puts(spark, ("b/x y", "2"), kind="DropPlacement"))
    assert keys(store) == [("", "3"), ("a", "1"), ("a", "4")] and store.load("b/x y")[0].count() == 0
    assert store.vacuum() == 3 and keys(store) == [("", "3"), ("a", "1"), ("a", "4")] and store.vacuum() == 0


def test_the_second_of_two_writers_is_refused(spark, tmp_path):
    root = f"file://{tmp_path}/store"
    one, two = TableStore(spark, root), TableStore(spark, root)
    one.write(puts(spark, ("a", "1"), ("b", "1")))
    for s in (one, two):
        s.refresh()
        s.load("a")
    one.write(puts(spark, ("a", "2")))
    with pytest.raises(ConflictError):
        two.write(puts(spark, ("a", "3")))
    one.load("a"), two.load("a")
    one.write(puts(spark, ("a", "4")))
    two.write(puts(spark, ("b", "5")))  # another collection: both stand
    assert keys(one) == [("a", "1"), ("a", "2"), ("a", "4"), ("b", "1"), ("b", "5")]


def test_soft_deletes_stay_hidden(spark, tmp_path):
    store = TableStore(spark, f"file://{tmp_path}/store", soft_delete=True)
    store.write(puts(spark, ("a", "1"), ("a", "2")))
    store.write(puts(spark, ("a", "1"), kind="DropPlacement"))
    assert [r.handle for r in store.load("a")[0].collect()] == ["2"] and store.placements.where(F.col("hidden")).count() == 1


def test_a_stream_skips_what_it_has_committed(spark, tmp_path):
    """A batch replayed after an interleaved commit is not applied, nor pushed, a second time; streams have marks of their own."""
    from tidemerge.streaming.sync import sync_stream

    store, pushed = TableStore(spark, f"file://{tmp_path}/store"), []
    schema = "collection string, handle string, flags array<string>, revision string, removed boolean, seq long"
    spark.createDataFrame([("a", "1", ["seen"], "r1", False, 1), ("a", "2", [], "r1", False, 2), ("a", "2", [], "r1", True, 3)], schema).write.parquet(f"file://{tmp_path}/in")
    changes = spark.readStream.schema(schema).parquet(f"file://{tmp_path}/in")

    def push(collection, rows):
        pushed.append((collection, sorted(r.handle for r in rows.collect())))
        return rows.selectExpr("collection", "handle", "'Accepted' AS outcome", "cast(NULL AS string) AS assigned", "'r2' AS revision", "0 AS seq")

    store.write(puts(spark, ("a", "1")))
    store.refresh()
    dirty = store.placements.withColumn("status", F.lit("Created")).withColumn("handle", F.lit("tmp"))
    store.write(dirty.select(F.lit(0).alias("phase"), F.lit(0).alias("seq"), F.lit("UpsertPlacement").alias("kind"), "collection", "handle", F.struct(*dirty.columns).alias("placement")))

    def run(checkpoint, name="changes"):
        sync_stream(changes, store, f"file://{tmp_path}/{checkpoint}", push, name=name).trigger(availableNow=True).start().awaitTermination()

    run("c1")
    assert pushed == [("a", ["tmp"])] and keys(store) == [("a", "1")]
    store.write(puts(spark, ("b", "9")))
    version = store.manifest()["version"]
    run("c2")  # a new checkpoint gives the same batch number again
    assert pushed == [("a", ["tmp"])] and store.manifest()["version"] == version
    run("c3", name="other")
    assert store.manifest()["version"] == version + 1 and store.last_batch() == "" and store.last_batch("changes") == "batch-0" == store.last_batch("other")


def test_a_commit_runs_the_plan_of_its_operations_once(spark, tmp_path):
    """Each row of the operations is computed once a commit, with and without rows to join, and nothing is left staged."""
    store, seen = TableStore(spark, f"file://{tmp_path}/store"), spark.sparkContext.accumulator(0)

    def counted(ops):
        def told(rows):
            for r in rows:
                seen.add(1)
                yield r

        return spark.createDataFrame(ops.rdd.mapPartitions(told), ops.schema)

    store.write(counted(puts(spark, ("a", "1"), ("b", "2"))))
    assert seen.value == 2
    store.write(counted(puts(spark, ("a", "3"), ("a", "1"))))
    assert seen.value == 4 and keys(store) == [("a", "1"), ("a", "3"), ("b", "2")] and not list((tmp_path / "store/staged").iterdir())
