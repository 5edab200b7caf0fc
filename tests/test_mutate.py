"""Batches whose mutations build on what earlier ones of the batch make."""

from pyspark.sql import functions as F

from tidemerge.model import PLACEMENT
from tidemerge.operators.mutate import MUTATION, mutate
from tidemerge.operators.ops import last_wins
from tidemerge.sources.storage import shared_folder


def change(seq, kind, handle, **given):
    given |= {"seq": seq, "kind": kind, "collection": "a", "handle": handle}
    return tuple(given.get(f.name) for f in MUTATION.fields)


def test_a_chain_is_one_table_a_wave(spark):
    """A copy of a copy, changed between: three waves. Each is written once, and only what it holds back goes on to the next."""
    from pathlib import Path

    shared = Path(shared_folder(spark).removeprefix("file:"))
    found = lambda: ({p for p in shared.glob("wave-*")}, {p for p in shared.glob("**/rdd-*")})
    row = ("a", "1", "l1", "o", 2, None, "k", ["x"], "Clean", None, None, None)
    batch = [
        change(6, "set_flags", "3", flags=["late"]), change(1, "copy", "1", to_collection="a", to_handle="2"), change(2, "set_flags", "1", flags=["own"]), change(3, "set_flags", "2", flags=["mid"]),
        change(4, "copy", "2", to_collection="a", to_handle="3"), change(5, "edit", "2", object="p"), change(0, "remove", "3"), change(7, "add", "9", link_id="l9"), change(8, "add", "8", link_id="l9"), change(9, "remove", "8"),
    ]
    before = found()
    ops, rejects = mutate(spark.createDataFrame([row], PLACEMENT), spark.createDataFrame(batch, MUTATION))
    got = {r.handle: (r.status, r.flags, r.object) for r in last_wins(ops).select("handle", F.col("placement.status").alias("status"), F.col("placement.flags").alias("flags"), F.col("placement.object").alias("object")).collect()}
    assert got == {"1": ("Dirty", ["own"], "o"), "2": ("Created", ["mid"], "p"), "3": ("Created", ["late"], "o"), "9": ("Created", [], None)}
    assert sorted((r.seq, r.reason) for r in rejects.collect()) == [(0, "UnknownHandle"), (8, "LinkExists"), (9, "UnknownHandle")]
    after = found()
    assert len(after[0] - before[0]) == 3 and after[1] == before[1]
