"""URL filters: rules, and trust and distrust propagated over the link graph of hosts.

Links in the pages' markup give edges between hosts, counted before they are shuffled. Trust flows from trusted seeds along links
(personalised PageRank), distrust from blocked seeds against them: who links to a bad host is suspect. Both run in one iteration over
one table, keyed by direction and host. A host whose distrust, set against its trust, passes the threshold is blocked; a rule for
the url always goes first. Steps are taken until the ranks stand still; every few, the ranks are cut from their lineage in the shared
folder and compared with those a step before.

Defined results: a null url or one without :// has empty host and path, no rule fits it, and it is allowed unless the empty host is
blocked by the graph, which holds no empty host. Null or empty html gives no links. Repeated rows are judged alike; their links
count each time. A host links to itself without effect. Very long html is read by one regular expression, whole. An empty table
gives an empty result. Only page_id, url and html are read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, table, written, written_at


@dataclass(frozen=True)
class Rule:
    """verdict for a host, its subdomains, and paths that start with path."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


# The query's rules.
RULES = (Rule("block", "com", "/en/"), Rule("allow", "example.com", "/en/7"), Rule("allow", "net", "/de/"), Rule("block", "example.net", "/de/8"), Rule("block", "org", "/es/"))


@dataclass(frozen=True)
class Options:
    """damping: share that flows on, below one; tolerance: steps end when the summed change of the ranks of each kind is below this
    share of floor times the mean of a seed; steps: most rounds, if given; threshold: a host is blocked if its distrust is over
    threshold times its trust and at least floor times the mean of a seed; seed_share: a host is a seed if rules give that share of
    all its pages one verdict; broadcast_hosts: up to so many blocked hosts are sent to all executors, beyond that they are joined."""

    damping: float = 0.85
    tolerance: float = 1e-4
    steps: int | None = None
    cut_every: int = 4
    threshold: float = 2.0
    floor: float = 0.05
    seed_share: float = 0.9
    broadcast_hosts: int = 100_000


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty if there is none."""
    rest = F.substring_index(_rest(url), "/", 1)
    rest = F.substring_index(F.substring_index(rest, "?", 1), "#", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _rest(url: Column) -> Column:
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def path_of(url: Column) -> Column:
    """What follows the host, up to ? or #."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def by_rule(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """The longest rule that fits, as a struct<rule, verdict>; null if none does. Of rules of one length the first given wins."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: len(r.text)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        out = F.when(fits, F.struct(F.lit(rule.text).alias("rule"), F.lit(rule.verdict).alias("verdict"))).otherwise(out)
    return out


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, n): links between different hosts."""
    target = F.explode(F.regexp_extract_all("html", F.lit(r"(?i)href\s*=\s*[\"']?([a-z][a-z0-9+.-]*:)?(//[^\"'\s>]*)"), F.lit(2)))
    links = pages.where("html IS NOT NULL").select(host_of(F.col("url")).alias("src"), target.alias("to"))
    ends = links.select("src", host_of(F.concat(F.lit("x:"), "to")).alias("dst"))
    return ends.where("src <> dst AND src <> '' AND dst <> ''").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def propagate(edges: DataFrame, seeds: DataFrame, options: Options = Options()) -> DataFrame:
    """(host, trust, distrust) from seeds (host, trusted, blocked: weights of at least 0).

    Mass that reaches a host without further edges returns to the seeds: it is left out of the steps, and ranks are scaled to a sum
    of one for each kind in the end, which gives the same fixed point. Hosts that no mass reaches are not listed.
    """
    start = written(seeds.select("host", F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("trusted").cast("double").alias("w")), F.struct(F.lit(1).alias("kind"), F.col("blocked").cast("double").alias("w")))).alias("x")).select("x.kind", "host", "x.w").where("w > 0"), "seeds")
    seeded = start.groupBy("kind").agg(F.sum("w").alias("w"), F.count(F.lit(1)).alias("n")).collect()  # at most two rows
    total = {r["kind"]: r["w"] for r in seeded}
    least = max(options.tolerance * options.floor / max((r["n"] for r in seeded), default=1), 1e-14)  # below it, sums of doubles differ by their order
    share = F.when(F.col("kind") == 0, F.col("w") / F.lit(total.get(0, 1.0))).otherwise(F.col("w") / F.lit(total.get(1, 1.0)))
    home = start.select("kind", "host", share.alias("s"))
    flows = edges.select(F.lit(0).alias("kind"), F.col("src").alias("host"), F.col("dst").alias("to"), "n").unionByName(edges.select(F.lit(1).alias("kind"), F.col("dst").alias("host"), F.col("src").alias("to"), "n"))
    out_n = flows.groupBy("kind", "host").agg(F.sum("n").alias("out"))
    moves = written(flows.join(out_n, ["kind", "host"]).select("kind", "host", "to", (F.col("n") / F.col("out")).alias("part")), "host-edges")
    ranks, held = home.select("kind", "host", F.col("s").alias("r")), None
    step, settled, lost = 0, moves.isEmpty(), 1.0 - options.damping
    while not settled and step != options.steps:
        for _ in range(min(options.cut_every, (options.steps or step + options.cut_every) - step)):
            before, step = ranks, step + 1
            sent = ranks.join(moves, ["kind", "host"]).groupBy("kind", F.col("to").alias("host")).agg((options.damping * F.sum(F.col("r") * F.col("part"))).alias("r"))
            ranks = sent.unionByName(home.select("kind", "host", (F.lit(lost) * F.col("s")).alias("r"))).groupBy("kind", "host").agg(F.sum("r").alias("r"))
        both = ranks.withColumn("old", F.lit(0.0)).unionByName(before.select("kind", "host", F.lit(0.0).alias("r"), F.col("r").alias("old")))
        ranks, now = written_at(both.groupBy("kind", "host").agg(F.sum("r").alias("r"), F.sum("old").alias("old")), "ranks")
        discard(ranks.sparkSession, held)
        held = now
        settled = all(r["c"] < least for r in ranks.groupBy("kind").agg(F.sum(F.abs(F.col("r") - F.col("old"))).alias("c")).collect())
        ranks = ranks.drop("old")
    if not step:
        ranks = written(ranks, "ranks")
    whole = {r["kind"]: r["w"] for r in ranks.groupBy("kind").agg(F.sum("r").alias("w")).collect()}  # at most two rows
    of = lambda k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("r"))), F.lit(0.0)) / F.lit(whole.get(k, 1.0))
    return ranks.groupBy("host").agg(of(0).alias("trust"), of(1).alias("distrust"))


def blocked_hosts(ranks: DataFrame, seeds: DataFrame, options: Options = Options()) -> DataFrame:
    """Hosts whose distrust passes the thresholds."""
    n = seeds.where("blocked > 0").count()
    if not n:
        return ranks.where("false").select("host")
    least = options.floor / n
    return ranks.where((F.round("distrust", 12) >= least) & (F.round("distrust", 12) > options.threshold * F.round("trust", 12))).select("host")


def judge(pages: DataFrame, *, rules: tuple[Rule, ...] = RULES, seeds: DataFrame | None = None, options: Options = Options()) -> DataFrame:
    """page_id, host, path, rule, verdict. Without seeds, a host of whose pages rules block (allow) a share of
    seed_share or more is a blocked (trusted) seed, with the count of those pages as weight."""
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    parsed = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("by_rule", by_rule(F.col("host"), F.col("path"), rules))
    if seeds is None:
        each = parsed.where("host <> ''").groupBy("host").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("by_rule.verdict") == v).alias(v) for v in ("allow", "block")])
        weight = lambda v: F.when(F.col(v) >= options.seed_share * F.col("n"), F.col(v)).otherwise(0)
        seeds = each.select("host", weight("allow").alias("trusted"), weight("block").alias("blocked")).where("trusted + blocked > 0")
    seeds = written(seeds, "host-seeds")
    edges = written(host_edges(pages), "edges")
    bad = written(blocked_hosts(propagate(edges, seeds, options), seeds, options).select("host", F.lit(True).alias("bad")), "blocked-hosts")
    bad = F.broadcast(bad) if bad.count() <= options.broadcast_hosts else bad
    verdict = F.coalesce(F.col("by_rule.verdict"), F.when(F.col("bad"), "block").otherwise("allow"))
    return parsed.join(bad, "host", "left").select("page_id", "host", "path", F.col("by_rule.rule").alias("rule"), verdict.alias("verdict"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
