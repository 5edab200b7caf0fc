import random

from pyspark.sql import functions as F

import pytest

from tidemerge.engine import FULL, META, Engine
from tidemerge.model import RemoteError, SyncOptions, UnknownHandle
from tidemerge.operators.mutate import MUTATION
from tidemerge.sources.remote import SERVER, TableRemote
from tidemerge.sources.storage import TableStore

QUIET = {"pulled": 0, "pushed": 0, "conflicts": 0, "rejected": 0, "refreshed": 0}


def change(spark, **given):
    return spark.createDataFrame([tuple(given.get(f.name, 0 if f.name == "seq" else None) for f in MUTATION.fields)], MUTATION)


@pytest.fixture
def engine(spark, tmp_path):
    body = lambda c, h, link, text, n: (c, h, link, [], text, 3, bytearray(text.encode()), n, 0, "meta", f"k{n}")
    server = spark.createDataFrame([body("in", "1", "a", "one", 1), body("in", "2", "b", "two", 2), body("old", "9", "a", "one", 3)], SERVER)
    return Engine(TableStore(spark, f"file://{tmp_path}/store"), TableRemote(spark, server))


def test_lifecycle(spark, engine):
    assert engine.sync("in")["pulled"] == 2 and engine.sync("old")["pulled"] == 1
    assert engine.sync("in") == QUIET
    handles = engine.open("in").select("handle")
    assert engine.upgrade("in", handles, META) == {"upgraded": 2, "fetched": 2, "deduped": 0}
    assert engine.upgrade("in", handles, FULL) == {"upgraded": 2, "fetched": 2, "deduped": 0}
    nine = engine.open("old").select("handle")
    engine.upgrade("old", nine, META)
    assert engine.upgrade("old", nine, FULL) == {"upgraded": 1, "fetched": 0, "deduped": 1}
    assert engine.upgrade("in", handles, FULL) == {"upgraded": 0, "fetched": 0, "deduped": 0}
    engine.mutate(change(spark, kind="set_flags", collection="in", handle="1", flags=["seen"]))
    engine.mutate(change(spark, kind="remove", collection="in", handle="2"))
    assert engine.sync("in")["pushed"] == 2
    assert [(r.handle, r.flags, r.status) for r in engine.open("in").collect()] == [("1", ["seen"], "Clean")]
    engine.sync("in")
    assert engine.sync("in") == QUIET
    with pytest.raises(UnknownHandle):
        engine.mutate(change(spark, kind="remove", collection="in", handle="nope"))
    assert engine.rekey("in") == {"rekeyed": 1, "pulled": 0, "dropped": 0}
    assert engine.open("in").where(F.col("status") == "Clean").count() == 1


def test_what_needs_no_call_makes_none(spark, engine):
    """Opening asks no remote; two collections that hold one body download it once; a sync with nothing new changes nothing."""
    assert engine.open("in").count() == 0 and engine.remote.calls == {"enumerate": 0, "fetch": 0, "push": 0}
    for name in ("in", "old"):
        engine.sync(name)
        engine.upgrade(name, engine.open(name).select("handle"), META)
    engine.upgrade("in", engine.open("in").select("handle"), FULL)
    before = engine.storage.objects.count()
    assert engine.upgrade("old", engine.open("old").select("handle"), FULL) == {"upgraded": 1, "fetched": 0, "deduped": 1}
    assert engine.storage.objects.count() == before == 2
    again = engine.sync("in")
    assert again == QUIET and again.events.count() == 0 and engine.remote.calls["push"] == 0


def test_events_come_in_order_and_errors_by_name(spark, engine):
    first = engine.sync("in")
    assert [(r.phase, r.kind, r.handle) for r in first.events.collect()] == [(0, "Added", "1"), (0, "Added", "2")]
    engine.mutate(change(spark, kind="set_flags", collection="in", handle="2", flags=["seen"]))
    engine.remote.server = engine.remote.server.where("handle <> '1'")
    assert [(r.phase, r.kind, r.handle) for r in engine.sync("in", SyncOptions(full=True)).events.collect()] == [(0, "Vanished", "1"), (1, "FlagsChanged", "2")]

    def broken(*a):
        raise OSError("down")

    engine.remote.enumerate = engine.remote.fetch = broken
    for call in (lambda: engine.sync("in"), lambda: engine.rekey("in"), lambda: engine.upgrade("in", engine.open("in").select("handle"), META)):
        with pytest.raises(RemoteError, match="down"):
            call()


def test_random_operations_converge(spark, engine):
    """After any run of local and remote changes, two syncs leave nothing to do and both sides alike."""
    rng = random.Random(5)
    engine.sync("in")
    for turn in range(2):
        kinds = ["set_flags", "edit", "remove", "add", "copy"]
        for k in range(rng.randint(1, 3)):
            live = [r.handle for r in engine.open("in").where("status <> 'Tombstone'").collect()]
            kind = rng.choice(kinds if live else ["add"])
            given = {"set_flags": {"flags": rng.sample(["seen", "draft", "flagged"], 2)}, "edit": {"object": f"x{turn}{k}"}, "remove": {}, "add": {"object": f"y{turn}{k}", "link_id": f"l{turn}{k}"}, "copy": {"to_collection": "in", "to_handle": f"c{turn}{k}"}}[kind]
            engine.mutate(change(spark, kind=kind, collection="in", handle=f"t{turn}{k}" if kind == "add" else rng.choice(live), **given))
        flags = F.when(F.col("handle") == rng.choice("12"), F.array(F.lit("answered"))).otherwise(F.col("flags"))
        top = engine.remote.clock = engine.remote.clock + 1
        engine.remote.server = engine.remote.server.withColumn("seq", F.when(flags != F.col("flags"), F.lit(top)).otherwise(F.col("seq")).cast("long")).withColumn("flags", flags).checkpoint()
        engine.sync("in")
        engine.sync("in")
        assert engine.sync("in") == QUIET
        ours = {(r.handle, ",".join(r.flags)) for r in engine.open("in").where("status <> 'Conflict'").collect()}
        theirs = {(r.handle, ",".join(sorted(r.flags))) for r in engine.remote.server.where("collection = 'in'").collect()}
        assert ours <= theirs
