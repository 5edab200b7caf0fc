"""Near-duplicates: banded MinHash, sequential Bayesian pruning, exact verification, connected components.

1. Every text becomes a set of 64-bit hashes of its word shingles, a MinHash signature and a key for each band. Equal sets form a
   class; only its smallest id goes on, so copies cost one row each.
2. Classes that share a band key are candidates. No pairs within a bucket are listed: each member is paired with the bucket's hub,
   the member that meets most others over all bands. Pairs are compared signature batch by batch and dropped once the posterior
   probability of reaching the threshold falls below ``miss``; survivors are verified on their full sets.
3. Components of the verified links follow by alternating large-star and small-star steps.
4. A bucket whose members then lie in one component is done. In the others the pairs across components are compared in blocks of at
   most ``tile`` rows (and ``tile_shingles`` shingles, on average) a side, again by the signature first and exactly then, so no link
   is lost to the choice of a hub. A block reports links only as far as they join components, at most one for each row.
5. Mixed buckets of more than ``split`` members are first dealt anew, without loss: shingles are ordered by how many of these
   documents hold them, and two sets that reach the threshold share one of their rarest 100 - percent in a hundred. Documents meet
   only where they share such a rare shingle, so a passage that millions of else different texts share brings none of them together.

Band parameters: a pair at the query's threshold 0.85 shares no band with probability (1 - 0.85^6)^30, a pair at the pipeline's 0.80
with (1 - 0.80^6)^50; both are below one in a million.

Defined results: null, empty or blank text has no shingles and is linked with nothing. Fewer words than a shingle: the whole
sequence is the one shingle. Very long texts are hashed whole; signatures work in slices. Repeated rows are copies of one another;
rows with one id count as one document. A row without an id is a document of its own and stays. An empty table gives an empty
result. Only the id and text columns are read; ids may be of any type that has an order.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import col, discard, numbered, slices, table, written, written_at


@dataclass(frozen=True)
class Options:
    shingle: int = 5
    percent: int = 85
    bands: int = 30
    rows: int = 6
    batch: int = 30
    miss: float = 1e-6
    tile: int = 384
    tile_shingles: int = 1 << 20
    split: int = 2048
    seed: int = 20240229

    @property
    def hashes(self) -> int:
        return self.bands * self.rows


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """Distinct shingles of a text, as sorted 64-bit hashes."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    width = min(size, len(w))
    h = np.full(len(w) - width + 1, width, dtype=np.uint64)
    for k in range(width):
        h = (h ^ w[k : len(w) - width + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return np.unique(h)


class Sketcher:
    def __init__(self, options: Options):
        rng = np.random.default_rng(options.seed)
        self.options = options
        self.a = (rng.integers(0, 1 << 32, options.hashes, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)[:, None]
        self.b = rng.integers(0, 1 << 32, options.hashes, dtype=np.uint64).astype(np.uint32)[:, None]
        self.salt = rng.integers(0, 1 << 63, options.bands, dtype=np.uint64)

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        x = (shingles >> np.uint64(32)).astype(np.uint32)[None, :]
        out = np.full(self.options.hashes, 0xFFFFFFFF, dtype=np.uint32)
        for at in range(0, x.shape[1], 1024):
            np.minimum(out, (self.a * x[:, at : at + 1024] + self.b).min(axis=1), out=out)
        return out

    def keys(self, signatures: np.ndarray) -> np.ndarray:
        """Band keys, a row for each signature."""
        rows = signatures.reshape(-1, self.options.bands, self.options.rows)
        h = np.tile(self.salt, (len(rows), 1))
        for k in range(self.options.rows):
            h = (h ^ rows[:, :, k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(31)
        return h.view(np.int64)


def sketches(docs: DataFrame, id_col: str, text_col: str, options: Options) -> DataFrame:
    """doc_id, n_shingles, set_key and signature (16 bits of each hash)."""
    rows = docs.select(col(id_col).alias("doc_id"), F.coalesce(col(text_col), F.lit("")).alias("text"))
    schema = T.StructType([T.StructField("doc_id", rows.schema["doc_id"].dataType)]).add("n_shingles", "long").add("set_key", "binary").add("sig", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketcher = Sketcher(options)
        for batch in batches:
            for lo, hi in slices(batch, "text"):
                part = batch.slice(lo, hi - lo)
                count, key, sig = [], [], []
                for text in part.column("text").to_pylist():
                    found = shingle_hashes(text, options.shingle)
                    count.append(len(found))
                    if len(found):
                        key.append(xxhash.xxh3_128_digest(found.tobytes()))
                        sig.append(sketcher.signature(found).astype(np.uint16).tobytes())
                    else:
                        key.append(None)
                        sig.append(None)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(count, pa.int64()), pa.array(key, pa.binary()), pa.array(sig, pa.binary())], names=schema.names)

    return rows.mapInArrow(run, schema)


def _banded(reps: DataFrame, options: Options) -> DataFrame:
    """(id, key): the band keys of each class. They follow from the signatures, so they are made when read, not kept."""
    schema = T.StructType([T.StructField("id", reps.schema["rep"].dataType), T.StructField("keys", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketcher = Sketcher(options)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                keys = sketcher.keys(_signatures(part.column("sig")))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, options.bands, dtype=np.int32)), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([part.column("rep"), lists], names=schema.names)

    return reps.select("rep", "sig").mapInArrow(run, schema).select("id", F.explode("keys").alias("key"))


def fewest_matches(options: Options) -> list[tuple[int, int]]:
    """(hashes compared, least matches to go on): with fewer, the posterior that the similarity reaches the threshold, from a
    uniform prior, is below miss. That posterior is a binomial tail: P(Bin(n + 1, t) <= m)."""
    t, out = options.percent / 100, []
    for n in range(options.batch, options.hashes + 1, options.batch):
        tail, m = 0.0, -1
        while tail < options.miss:
            m += 1
            tail += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        out.append((n, m))
    return out


def plausible(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, steps: list[tuple[int, int]], percent: int) -> np.ndarray:
    """Which pairs of signatures survive all batches; sizes too unequal for the threshold are dropped first."""
    (live,) = (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)).nonzero()
    matches, done = np.zeros(len(live), dtype=np.int64), 0
    for n, least in steps:
        if not len(live):
            break
        matches = matches + (a[live, done:n] == b[live, done:n]).sum(axis=1)
        ok = matches >= least
        live, matches, done = live[ok], matches[ok], n
    return live


def _signatures(column: pa.Array) -> np.ndarray:
    got = column.to_pylist()
    return np.frombuffer(b"".join(got), dtype=np.uint16).reshape(len(got), -1)


def _codes(column: pa.ChunkedArray) -> np.ndarray:
    """A number for each distinct value."""
    return column.combine_chunks().dictionary_encode().indices.to_numpy()


def _prune(pairs: DataFrame, reps: DataFrame, options: Options) -> DataFrame:
    """Pairs (a, b) that the signatures don't rule out."""
    sig = reps.select("rep", "n_shingles", "sig")
    both = pairs.join(sig.toDF("a", "na", "sa"), "a").join(sig.toDF("b", "nb", "sb"), "b")
    steps = fewest_matches(options)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                live = plausible(_signatures(batch.column("sa")), _signatures(batch.column("sb")), batch.column("na").to_numpy(), batch.column("nb").to_numpy(), steps, options.percent)
                yield batch.select(["a", "b"]).take(pa.array(live))

    return both.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(run, pairs.schema)


def _sets(texts: DataFrame, ids: DataFrame, options: Options) -> DataFrame:
    """(id, shingles): full sets, made anew, only for the ids given."""
    rows = texts.join(ids, "id", "left_semi")
    schema = T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("shingles", T.BinaryType())])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in slices(batch, "text"):
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([shingle_hashes(t, options.shingle).tobytes() for t in part.column("text").to_pylist()], pa.binary())], names=schema.names)

    return written(rows.mapInArrow(sets, schema), "shingle-sets")


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets reach the threshold."""
    if not len(x) or not len(y):
        return False
    same = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
    return 100 * same >= percent * (len(x) + len(y) - same)


def _verify(pairs: DataFrame, texts: DataFrame, options: Options) -> DataFrame:
    """Pairs (a, b) whose full sets reach the threshold."""
    full = _sets(texts, pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), options)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = zip(batch.column("sa"), batch.column("sb"), strict=True)
            ok = [linked(*(np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in both), options.percent) for both in each]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    both = pairs.join(full.toDF("a", "sa"), "a").join(full.toDF("b", "sb"), "b").select("a", "b", "sa", "sb")
    return both.mapInArrow(compare, pairs.schema)


def components(links: DataFrame) -> DataFrame:
    """(id, component): the smallest id that can be reached over links (a, b); only ids with a link are listed. Rounds are taken until
    nothing changes, about as many as the logarithm of the longest chain."""
    edges, held = written_at(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.where("u <> m").select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        below = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = below.groupBy("u").agg(F.min("v").alias("m"))
        small = below.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct()
        edges, new = written_at(small, "edges")
        discard(edges.sparkSession, held)
        held = new
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(edges.select("v", "v").distinct())


def _by_rare_shingles(members: DataFrame, texts: DataFrame, options: Options) -> DataFrame:
    """Buckets (key, id, component, n_shingles) of members (id, component, n_shingles) that share one of their rarest shingles.

    The order of shingles, by how many members hold them and then by value, is one for all members; of a set of n, any other that
    reaches the threshold holds at least n * percent / 100, so it holds one of the first n - n * percent / 100 + 1."""
    full = _sets(texts, members.select("id"), options)
    kind = T.StructType([full.schema["id"], T.StructField("key", T.LongType())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, v in enumerate(batch.column("shingles")):
                found = np.frombuffer(v.as_buffer(), dtype=np.int64)
                for at in range(0, len(found), 1 << 16):
                    part = found[at : at + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(np.full(len(part), i))), pa.array(part)], names=["id", "key"])

    held = written(full.mapInArrow(each, kind), "shingles")
    shared = held.groupBy("key").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    ranked = held.join(shared, "key").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("df", "key"))).alias("k"))
    alone = F.col("n_shingles") - F.size("k")  # shingles of one member alone come first in the order and bring no one together
    first = F.col("n_shingles") - F.ceil(F.col("n_shingles") * options.percent / 100) + 1
    rare = members.join(ranked, "id").select("id", "component", "n_shingles", F.explode(F.slice("k", F.lit(1), F.greatest(F.lit(0), first - alone).cast("int"))).alias("x"))
    return rare.select("x.key", "id", "component", "n_shingles")


def _mixed(placed: DataFrame) -> DataFrame:
    """(key, n, w), w the shingles of all n members, of the buckets (key, id, component, n_shingles) that hold several components; of
    buckets with the same members, one."""
    marks = [F.bit_xor(F.xxhash64("id", F.lit(k))).alias(f"x{k}") for k in (1, 2)]
    sizes = F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("w")
    mixed = placed.groupBy("key").agg(*sizes, F.min("component").alias("lo"), F.max("component").alias("hi"), *marks).where("lo <> hi")
    return mixed.groupBy("n", "w", "x1", "x2").agg(F.min("key").alias("key")).select("key", "n", "w")


def _blocks(batches: Iterator[pa.RecordBatch], each: Callable[[pa.Table], pa.RecordBatch | None]) -> Iterator[pa.RecordBatch]:
    """What each() makes of every run of rows with one (key, i, j); only the run at hand and one batch are held."""
    held: list[pa.RecordBatch] = []
    for batch in chain(batches, [None]):
        if batch is not None:
            if batch.num_rows:
                held.append(batch)
            else:
                continue
        if not held:
            continue
        got = pa.Table.from_batches(held).combine_chunks()
        key, i, j = (got.column(c).to_numpy() for c in ("key", "i", "j"))
        cuts = [0, *((np.diff(key) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0)).nonzero()[0] + 1, len(key)]
        for s, e in zip(cuts[:-1], cuts[1:], strict=True):
            if (e < len(key) or batch is None) and (found := each(got.slice(s, e - s))) is not None:
                yield found
        held = [] if batch is None else got.slice(cuts[-2]).to_batches()


def _across(buckets: DataFrame, reps: DataFrame, texts: DataFrame, options: Options) -> DataFrame:
    """Links (a, b) across components within buckets (key, id, component, tiles).

    A bucket is dealt into blocks by rows and by shingles, and every pair of blocks meets once, in one group of bounded size: first by
    their signatures alone. If these leave no more pairs in a group than it has rows, the pairs are listed, and each is verified once
    for all groups. Otherwise the rows with such a pair meet again with their full sets, where pairs are verified the most alike first,
    and only while they lie in different components: a group gives at most one link a row.
    """
    own = buckets.join(reps.select(F.col("rep").alias("id"), "n_shingles", "sig"), "id").withColumn("t", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    rows = own.withColumn("o", other).select("key", F.least("t", "o").alias("i"), F.greatest("t", "o").alias("j"), "t", "id", "component", "n_shingles", "sig")
    steps = fewest_matches(options)
    kind = reps.schema["rep"].dataType
    schema = T.StructType([T.StructField("a", kind), T.StructField("b", kind)])

    def candidates(group: pa.Table) -> Iterator[tuple[int, np.ndarray]]:
        """Each row of a group with the later ones (of the other block, where there are two) that its signature doesn't rule out."""
        sig, size = _signatures(group.column("sig")), group.column("n_shingles").to_numpy()
        comp, t = _codes(group.column("component")), group.column("t").to_numpy()
        split = group.column("i")[0].as_py() != group.column("j")[0].as_py()
        for x in range(len(comp)):
            meets = comp != comp[x]
            meets &= (t > t[x]) if split else np.arange(len(comp)) > x
            (ys,) = meets.nonzero()
            if len(ys):
                ys = ys[plausible(np.broadcast_to(sig[x], (len(ys), sig.shape[1])), sig[ys], np.full(len(ys), size[x]), size[ys], steps, options.percent)]
                yield x, ys[np.argsort(-(sig[ys] == sig[x]).sum(axis=1), kind="stable")]

    def live_of(group: pa.Table) -> pa.RecordBatch | None:
        found = [(x, ys) for x, ys in candidates(group) if len(ys)]
        if not found:
            return None
        xs, ys = np.repeat([x for x, _ in found], [len(y) for _, y in found]), np.concatenate([y for _, y in found])
        ids = group.column("id").combine_chunks()
        few = len(ys) <= group.num_rows
        rows = group.take(pa.array(xs if few else np.union1d(xs, ys)))
        partner = ids.take(pa.array(ys)) if few else pa.nulls(len(rows), ids.type)
        if few:
            rows = rows.set_column(rows.schema.get_field_index("sig"), "sig", pa.nulls(len(rows), pa.binary()))
        return rows.append_column("partner", partner).combine_chunks().to_batches()[0]

    def links_of(group: pa.Table) -> pa.RecordBatch | None:
        comp = _codes(group.column("component"))
        sets = [np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in group.column("shingles").combine_chunks()]
        root: dict[int, int] = {}

        def find(c: int) -> int:
            while (up := root.get(c, c)) != c:
                root[c] = c = root.get(up, up)
            return c

        left, right = [], []
        for x, ys in candidates(group):
            for y in ys.tolist():
                a, b = find(int(comp[x])), find(int(comp[y]))
                if a != b and linked(sets[x], sets[y], options.percent):
                    root[max(a, b)] = min(a, b)
                    left.append(x)
                    right.append(y)
        ids = group.column("id").combine_chunks()
        return pa.RecordBatch.from_arrays([ids.take(pa.array(v, pa.int64())) for v in (left, right)], names=["a", "b"]) if left else None

    def dealt(rows: DataFrame) -> DataFrame:
        return rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "id")

    names = T.StructType([*rows.schema.fields, T.StructField("partner", kind)])
    live = written(dealt(rows).mapInArrow(lambda batches: _blocks(batches, live_of), names), "live")
    pairs = live.where("partner IS NOT NULL").select(F.least("id", "partner").alias("a"), F.greatest("id", "partner").alias("b")).distinct()
    links = _verify(written(pairs, "listed"), texts, options)
    many = live.where("partner IS NULL").drop("partner")
    if many.isEmpty():
        return links
    full = _sets(texts, many.select("id").distinct(), options)
    found = dealt(many.join(full, "id")).mapInArrow(lambda batches: _blocks(batches, links_of), schema)
    return links.unionByName(found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", options: Options = Options()) -> DataFrame:
    """A row for each row of docs: doc_id, n_shingles, component_id, kept."""
    spark = docs.sparkSession
    base, sketched = written_at(sketches(docs, id_col, text_col, options), "sketches")
    classes = base.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig"))
    reps = written(classes, "classes")
    known = written(base.select("doc_id", "n_shingles", "set_key"), "documents")
    discard(spark, sketched)

    banded = _banded(reps, options)
    shared = banded.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    multi = written(banded.join(shared, "key").select("key", "id", "n"), "buckets")
    met = written(reps.join(multi.select(F.col("id").alias("rep")).distinct(), "rep", "left_semi"), "met")
    mine = docs.select(col(id_col).alias("id"), col(text_col).alias("text")).where("text IS NOT NULL")
    # One plan at every size: a merge join leaves the rows as dropDuplicates needs them, and the ids outgrow any broadcast.
    texts = written(mine.join(met.select(F.col("rep").alias("id")).hint("merge"), "id", "left_semi").dropDuplicates(["id"]), "texts")
    central = multi.groupBy("id").agg(F.sum("n").alias("c"))
    hubs = multi.join(central, "id").groupBy("key").agg(F.min_by("id", F.struct(-F.col("c"), F.col("id"))).alias("hub"))
    pairs = multi.join(hubs, "key").where("id <> hub").select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct()
    links = written(_verify(written(_prune(pairs, met, options), "survivors"), texts, options), "links")
    joined = components(links)

    size = met.select(F.col("rep").alias("id"), "n_shingles")
    placed = multi.where("n > 2").select("key", "id").join(joined, "id", "left").join(size, "id").select("key", "id", F.coalesce("component", "id").alias("component"), "n_shingles")
    placed = written(placed, "placed")
    once = written(_mixed(placed), "mixed")
    whole = placed.select("key", "id", "component").join(once.where(F.col("n") <= options.split), "key")
    crowded = once.where(F.col("n") > options.split)
    if not crowded.isEmpty():
        members = placed.join(crowded.select("key"), "key", "left_semi").select("id", "component", "n_shingles").distinct()
        rare = written(_by_rare_shingles(written(members, "members"), texts, options), "rare-buckets")
        whole = whole.unionByName(rare.select("key", "id", "component").join(_mixed(rare), "key"))
    tiles = F.ceil(F.greatest(F.col("n") / F.lit(options.tile), F.col("w") / F.lit(options.tile_shingles))).cast("int")
    found = written(_across(whole.select("key", "id", "component", tiles.alias("tiles")), met, texts, options), "links")
    if not found.isEmpty():
        joined = components(links.unionByName(found))

    named = reps.select("set_key", "rep").join(joined.withColumnRenamed("id", "rep"), "rep", "left").select("set_key", F.coalesce("component", "rep").alias("component_id"))
    known = known.join(named, "set_key", "left")
    own: Column = F.when(F.col("doc_id").isNull(), F.col("doc_id")).otherwise(F.coalesce("component_id", "doc_id"))
    return known.select("doc_id", "n_shingles", own.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


#: The pipeline's stage links from 0.80 on; 0.85 is the contract of the query alone.
STAGE = Options(percent=80, bands=50)


def _one_of_each(rows: DataFrame, id_col: str, text_col: str, odd: DataFrame) -> DataFrame:
    """rows with a string key of their own: the id (whole numbers filled up with zeros) and a digest of the text. Of rows without an id,
    or with one of the ids of odd (id, repeated), those with one key are one; texts of other rows are not shuffled."""
    name = F.col(id_col).cast("string")
    whole = isinstance(rows.schema[id_col].dataType, T.IntegralType)
    sortable = F.lpad(name, 20, "0") if whole else name
    keyed = rows.withColumn("key", F.concat(F.coalesce(sortable, F.lit("")), F.lit(":"), F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)))
    known, again = keyed.where(F.col(id_col).isNotNull()), odd.where("id IS NOT NULL").select(F.col("id").alias(id_col))
    several = keyed.where(F.col(id_col).isNull()).unionByName(known.join(again, id_col, "left_semi"))
    return known.join(again, id_col, "left_anti").unionByName(several.dropDuplicates(["key"]))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that with the smallest id; columns stay as they are. Where ids are null or repeated, rows of
    one id and one text are one document, and different texts under one id are judged each by itself."""
    names, rows = docs.columns, numbered(docs)
    id_col, text_col = (rows.columns[names.index(c)] for c in ("doc_id", "text"))
    odd = written(rows.groupBy(F.col(id_col).alias("id")).agg(F.count(F.lit(1)).alias("n")).where("n > 1 OR id IS NULL").select("id"), "odd-ids")
    key = id_col
    if not odd.isEmpty():
        rows, key = _one_of_each(rows, id_col, text_col, odd), "key"
    judged = near_duplicates(rows, id_col=key, text_col=text_col, options=STAGE)
    gone = written(judged.where("NOT kept").select(F.col("doc_id").alias(key)), "dropped")
    return rows.join(gone, key, "left_anti").select(*[f"c{i}" for i in range(len(names))]).toDF(*names)


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


# The exact join over all pairs that share a shingle; the components by recursion over links.
OP8_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN []::varchar[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM d
), e AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s
), p AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), r(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT p.y, r.c FROM r JOIN p ON r.doc_id = p.x WHERE r.c < p.y)
SELECT s.doc_id, cast(len(s.s) AS bigint) AS n_shingles, m.c AS component_id, s.doc_id = m.c AS kept
FROM s JOIN (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id) m ON s.doc_id = m.doc_id
"""
