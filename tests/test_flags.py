from itertools import chain, combinations

from pyspark.sql import functions as F

from tidemerge.functions import flags as fl


def test_merge_agrees_with_the_boolean_form_for_all_triples(spark):
    sets = [list(x) for x in chain.from_iterable(combinations("abc", n) for n in range(4))]
    rows = [(b, x, y) for b in sets for x in sets for y in sets]
    got = spark.createDataFrame(rows, "b array<string>, l array<string>, r array<string>").select("b", "l", "r", fl.merge(F.col("b"), F.col("l"), F.col("r")).alias("m")).collect()
    assert len(got) == 512
    for b, x, y, m in got:
        assert m == sorted(f for f in "abc" if ((f in x and f in y) if f in b else (f in x or f in y)))


def test_canonical_sorts_and_drops_nulls(spark):
    row = spark.createDataFrame([(["b", None, "a", "b"],), (None,)], "f array<string>").select(fl.canonical(F.col("f")).alias("f")).collect()
    assert [r.f for r in row] == [["a", "b"], []]
