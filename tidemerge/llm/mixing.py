"""Mixing sources to target weights.

A source with token share p gets the weight p^a / sum of p^a. The exponent a between 0 (all alike) and 1 (as they are) is found by
bisection, sixteen parts at a time, each step one aggregate over the table of sources: the largest exponent that reaches the target
entropy, raised where a source would be repeated more often than the limit. Weights times the budget give each source a quota.

Quotas are realised as budgeted block permutations: a source's documents are dealt into blocks of about ``block_tokens`` by a hash,
blocks and the documents in them stand in hashed order, every document comes once for each whole pass, and the last, partial pass
takes whole blocks and then documents of one boundary block as long as the budget lasts. All that a row needs to know of this is a
handful of numbers for its source, so documents are not shuffled.

Defined results: a null source counts as the empty source. Null or empty texts have no tokens; a source without tokens has no weight
and is left out. Very long texts may pass the rest of a quota, which then stays unused. Repeated rows (rows with one id) are taken or
left together. Ties in hashed order count as one document. An empty table gives an empty result. Extra columns are kept, whatever
their names; only ``mix`` itself, which adds columns named __mix_*, refuses an input that has one of these.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import numbered, table, written

STEPS = 16
GRID = STEPS**3
SPAN_BITS = 48  # of the 60 bits that order the blocks, so many stay within a span: 4096 spans a source


@dataclass(frozen=True)
class Options:
    """entropy: target, as a share of the logarithm of the number of sources; repeat: most passes over a source; budget: tokens to
    give out, by default as many as there are; broadcast_sources: up to so many sources their table, of a few numbers each, is sent
    to all executors, beyond that it is joined."""

    entropy: float = 0.95
    repeat: float = 4.0
    budget: int | None = None
    block_tokens: int = 1 << 20
    broadcast_sources: int = 10_000
    seed: str = "mix"


def word_count(text: Column) -> Column:
    """Words parted by ASCII white space; 0 for null."""
    words = F.split(F.trim(F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\f\r", "     ")), " +")
    return F.when(words[0] == "", 0).otherwise(F.size(words)).cast("long")


def _hash(*parts: Column | str) -> Column:
    """60 bits of a digest that other engines have too."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])), 1, 15), 16, 10).cast("long")


def exponent(sources: DataFrame, options: Options, total: int, budget: int) -> float:
    """The exponent for sources (source, t), in steps of 1 / GRID."""
    n = sources.count()
    goal = options.entropy * math.log(n) - 1e-12
    p = F.col("t") / F.lit(float(total))

    def meets(ks: list[int]) -> list[tuple[bool, bool]]:
        """(entropy reached, repetition within its limit) at each exponent k / GRID."""
        cols = []
        for k in ks:
            a = k / GRID
            cols += [F.sum(F.pow(p, F.lit(a))), F.sum(F.pow(p, F.lit(a)) * F.log(p)), F.max(F.pow(p, F.lit(a - 1.0)))]
        row = list(sources.agg(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first())
        out = []
        for i, k in enumerate(ks):
            z, s, most = row[3 * i : 3 * i + 3]
            out.append((math.log(z) - k / GRID * s / z >= goal, most / z * budget / total <= options.repeat + 1e-12))
        return out

    def bisect(which: int, up: bool) -> int:
        """up: the largest k at which the condition holds, else the smallest; conditions are monotone. 0 or GRID if none does."""
        lo, hi = 0, GRID  # up: holds at lo
        while hi - lo > 1:
            step = max(1, (hi - lo) // STEPS)
            ks = list(range(lo + step, hi, step))
            ok = [x[which] for x in meets(ks)]
            if up:
                hi = next((k for k, y in zip(ks, ok, strict=True) if not y), hi)
                lo = max([lo, *(k for k, y in zip(ks, ok, strict=True) if y and k < hi)])
            else:
                hi = next((k for k, y in zip(ks, ok, strict=True) if y), hi)
                lo = max([lo, *(k for k, y in zip(ks, ok, strict=True) if not y and k < hi)])
        ends = meets([0, GRID])
        if up:
            return GRID if ends[1][which] else lo
        return 0 if ends[0][which] else hi

    return max(bisect(0, True), bisect(1, False)) / GRID


def plan(docs: DataFrame, *, source: Column, tokens: Column, key: Column, options: Options = Options()) -> tuple[DataFrame, int]:
    """A row for each source that gets anything (source, t, weight, quota, whole, blocks, cut_order, cut_block, cut_key), and their
    number. A document comes ``whole`` times, and once more if its block stands before the cut, or is the cut's and its key is at
    most cut_key."""
    rows = written(docs.select(F.coalesce(source, F.lit("")).alias("source"), tokens.alias("n"), _hash(options.seed, key).alias("k")), "mix-rows")
    sources = written(rows.groupBy("source").agg(F.sum("n").alias("t")).where("t > 0"), "mix-sources")
    got = sources.agg(F.count(F.lit(1)), F.sum("t")).first()
    if not got[0]:
        return sources.select("source", "t", F.lit(0.0).alias("weight"), *[F.lit(0).cast("long").alias(c) for c in ("quota", "whole", "blocks", "cut_order", "cut_block", "cut_key")]), 0
    total = int(got[1])
    budget = options.budget or total
    a = exponent(sources, options, total, budget)
    share = F.pow(F.col("t") / F.lit(float(total)), F.lit(a))
    z = sources.agg(F.sum(share)).first()[0]
    sized = sources.withColumn("weight", share / F.lit(z)).withColumn("quota", F.floor(F.round(F.col("weight") * F.lit(float(budget)), 3)).cast("long"))
    sized = sized.withColumn("whole", F.expr("quota div t")).withColumn("blocks", F.ceil(F.col("t") / F.lit(float(options.block_tokens))).cast("long"))
    sized = _send(sized, got[0], options)

    placed = rows.join(sized.select("source", "blocks"), "source").withColumn("block", F.pmod("k", F.col("blocks")))
    blocks = placed.groupBy("source", "block").agg(F.sum("n").alias("n")).withColumn("o", _hash(options.seed, F.col("source"), F.col("block")))
    # Blocks are summed in two levels, so that a source with many of them is no one task's work.
    blocks = written(blocks.withColumn("span", F.shiftright("o", SPAN_BITS)), "mix-blocks")
    earlier = Window.partitionBy("source").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    spans = blocks.groupBy("source", "span").agg(F.sum("n").alias("n")).select("source", "span", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("ahead"))
    before = Window.partitionBy("source", "span").orderBy("o", "block").rowsBetween(Window.unboundedPreceding, -1)
    summed = blocks.withColumn("own", F.coalesce(F.sum("n").over(before), F.lit(0))).join(spans, ["source", "span"]).withColumn("sum", F.col("ahead") + F.col("own"))
    cut = summed.join(sized.select("source", (F.col("quota") - F.col("whole") * F.col("t")).alias("rest")), "source").where("sum <= rest AND sum + n > rest")
    cut = written(cut.select("source", F.col("block").alias("cut_block"), F.col("o").alias("cut_order"), (F.col("rest") - F.col("sum")).alias("left")), "mix-cuts")
    inside = placed.select("source", "n", "k", F.col("block").alias("cut_block")).join(cut, ["source", "cut_block"]).groupBy("source", "k", "left").agg(F.sum("n").alias("n"))
    upto = Window.partitionBy("source").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    keys = inside.withColumn("sum", F.sum("n").over(upto)).where("sum <= left").groupBy("source").agg(F.max("k").alias("cut_key"))
    out = sized.join(cut.drop("left"), "source", "left").join(keys, "source", "left").withColumn("cut_key", F.coalesce("cut_key", F.lit(-1)))
    return written(out.select("source", "t", "weight", "quota", "whole", "blocks", "cut_order", "cut_block", "cut_key"), "mix-plan"), got[0]


def _send(sources: DataFrame, n: int, options: Options) -> DataFrame:
    return F.broadcast(sources) if n <= options.broadcast_sources else sources


ADDED = ("source", "epoch", "block", "order")


def _mixed(rows: DataFrame, source: str, key: str, tokens: Column, options: Options) -> DataFrame:
    """rows, whose columns are numbered(), as often as the mixture takes them, with the columns of ADDED as __mix_*."""
    sources, n = plan(rows, source=F.col(source), tokens=tokens, key=F.col(key), options=options)
    marked = rows.withColumn("__mix_source", F.coalesce(F.col(source), F.lit(""))).withColumn("__mix_order", _hash(options.seed, F.col(key)))
    numbers = _send(sources.select(F.col("source").alias("__mix_source"), *[F.col(c).alias(f"__mix_{c}") for c in ("whole", "blocks", "cut_order", "cut_block", "cut_key")]), n, options)
    both = marked.join(numbers, "__mix_source").withColumn("__mix_block", F.pmod("__mix_order", F.col("__mix_blocks")))
    at = F.struct(_hash(options.seed, F.col("__mix_source"), F.col("__mix_block")), F.col("__mix_block"))
    cut = F.struct(F.col("__mix_cut_order"), F.col("__mix_cut_block"))
    more = (at < cut) | ((at == cut) & (F.col("__mix_order") <= F.col("__mix_cut_key")))
    times = (F.col("__mix_whole") + F.when(F.col("__mix_cut_block").isNotNull() & more, 1).otherwise(0)).cast("int")
    out = both.withColumn("__mix_times", times).where("__mix_times > 0").withColumn("__mix_epoch", F.explode(F.sequence(F.lit(1), F.col("__mix_times"))))
    return out.select(*rows.columns, *[f"__mix_{c}" for c in ADDED])


def mix(docs: DataFrame, *, source_col: str = "source", id_col: str = "doc_id", text_col: str = "text", tokens_col: str | None = None, options: Options = Options()) -> DataFrame:
    """The rows of docs as often as the mixture takes them, with __mix_source, __mix_epoch (from 1), __mix_block and __mix_order.
    tokens_col names a column that counts tokens; without one, the words of text_col count."""
    extra = [f"__mix_{c}" for c in ADDED]
    if clash := set(extra) & set(docs.columns):
        raise ValueError(f"the input has columns named like results: {sorted(clash)}")
    return _taken(docs, source_col, id_col, text_col, tokens_col, options).toDF(*docs.columns, *extra)


def _taken(docs: DataFrame, source_col: str, id_col: str, text_col: str, tokens_col: str | None, options: Options) -> DataFrame:
    rows, at = numbered(docs), dict(zip(docs.columns, (f"c{i}" for i in range(len(docs.columns))), strict=True))
    tokens = word_count(F.col(at[text_col])) if tokens_col is None else F.col(at[tokens_col])
    return _mixed(rows, at[source_col], at[id_col], tokens, options)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them; the columns stay as they are."""
    return _taken(docs, "source", "doc_id", "text", None, Options()).drop(*[f"__mix_{c}" for c in ADDED]).toDF(*docs.columns)


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("tokens"))
    out = mix(docs, tokens_col="tokens")
    return out.select("doc_id", F.col("__mix_source").alias("source"), "tokens", F.col("__mix_epoch").alias("epoch"), F.col("__mix_block").alias("block"), F.col("__mix_order").alias("order_key"))


# Exponents are tried one by one here; the blocks and cuts are those of the operator.
OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS source, cast(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS bigint) AS tokens,
    cast('0x' || substr(md5('mix:' || doc_id), 1, 15) AS bigint) AS k FROM documents
), s AS (SELECT source, cast(sum(tokens) AS bigint) AS t FROM d GROUP BY source HAVING sum(tokens) > 0
), g AS (SELECT sum(t) AS total, count(*) AS n FROM s
), e AS (
  SELECT k / 4096.0::double AS a, sum(pow(t / total, k / 4096.0::double)) AS z, sum(pow(t / total, k / 4096.0::double) * ln(t / total)) AS l,
    max(pow(t / total, k / 4096.0::double - 1.0)) AS m FROM s, g, range(4097) r(k) GROUP BY k
), a AS (
  SELECT greatest((SELECT coalesce(max(a), 0) FROM e, g WHERE ln(z) - a * l / z >= 0.95 * ln(n) - 1e-12), (SELECT coalesce(min(a), 1) FROM e WHERE m / z <= 4.0 + 1e-12)) AS a
), w AS (
  SELECT source, t, cast(floor(round(pow(t / total, a) / (SELECT sum(pow(t / total, a)) FROM s, g, a) * total, 3)) AS bigint) AS quota, cast(ceil(t / 1048576.0) AS bigint) AS blocks FROM s, g, a
), p AS (SELECT d.*, w.t, w.quota, w.quota // w.t AS whole, w.quota % w.t AS rest, d.k % w.blocks AS block FROM d JOIN w ON d.source = w.source
), b AS (
  SELECT source, block, rest, sum(tokens) AS n, cast('0x' || substr(md5('mix:' || source || ':' || block), 1, 15) AS bigint) AS o FROM p GROUP BY source, block, rest
), c AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY source ORDER BY o, block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM b
), f AS (
  SELECT p.*, c.before, c.n, sum(p.tokens) OVER (PARTITION BY p.source, p.block ORDER BY p.k) AS upto FROM p JOIN c ON p.source = c.source AND p.block = c.block
)
SELECT doc_id, source, tokens, cast(unnest(range(1, cast(whole + CASE WHEN before + n <= rest OR (before <= rest AND before + upto <= rest) THEN 1 ELSE 0 END AS bigint) + 1)) AS integer) AS epoch, block, k AS order_key FROM f
"""
