"""URL verdicts: explicit rules first, then trust and distrust propagated over host edges."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelloom.llm.common import LOWER, UPPER, text_of
from panelloom.session import stored


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty without `://`."""
    return F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest rule whose host is the url's or a domain above it, and whose path begins the url's."""
    found = None
    for rule in sorted(rules, key=lambda r: (-len(r.name), r.name)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        value = F.struct(F.lit(rule.name).alias("rule"), F.lit(rule.verdict).alias("verdict"))
        found = F.when(fits, value) if found is None else found.when(fits, value)
    return found if found is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


# Second labels under two-letter country domains below which names are registered.
SECOND_LEVEL = ("ac", "co", "com", "edu", "gov", "net", "org")


def domain_chain(host: Column) -> Column:
    """The host and the domains above it, up to the registrable one: two labels, or three as in `name.co.uk`."""
    parts = F.split(host, "\\.")
    size = F.size(parts)
    country = (F.char_length(F.element_at(parts, -1)) == 2) & (size > 2) & F.get(parts, size - 2).isin(*SECOND_LEVEL)
    least = F.when(country, 3).otherwise(2)
    whole = F.transform(parts, lambda _, i: F.struct((size - i).alias("n"), F.array_join(F.slice(parts, i + 1, size), ".").alias("name")))
    return F.transform(F.filter(whole, lambda x: x["n"] >= least), lambda x: x["name"])


def host_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(src, dst, weight): links between hosts counted over all pages, and each host joined with the domain above it both ways.

    Absolute `href` targets in the page's source are links; relative ones stay on their host and
    carry nothing. The domain edges let the hosts of one registered domain share its score; they
    stop there, so that no top-level domain ties unrelated hosts together.
    """
    host = host_of(F.col(url))
    targets = F.regexp_extract_all(text_of(html), F.lit(r"""(?i)href\s*=\s*["']?\s*(https?://[^"'\s>]+)"""), F.lit(1))
    links = pages.select(host.alias("src"), F.explode(targets).alias("target")).select("src", host_of(F.col("target")).alias("dst"))
    links = links.where("src <> '' and dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))
    hosts = pages.select(host.alias("host")).where("host <> ''").unionByName(links.select(F.col("dst").alias("host"))).distinct()
    above = hosts.select(domain_chain(F.col("host")).alias("chain")).where("size(chain) > 1").select(F.explode(F.zip_with(
        F.slice("chain", 1, F.size("chain") - 1), F.slice("chain", 2, F.size("chain") - 1),
        lambda low, high: F.struct(low.alias("low"), high.alias("high")))).alias("e")).select("e.*").distinct()
    up = above.select(F.col("low").alias("src"), F.col("high").alias("dst"), F.lit(1.0).alias("weight"))
    down = above.select(F.col("high").alias("src"), F.col("low").alias("dst"), F.lit(1.0).alias("weight"))
    return links.unionByName(up).unionByName(down).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


# Rounds between two written tables: plans stay short, and a lost executor re-reads the last one.
STEP = 5


def personalised_rank(edges: DataFrame, seeds: DataFrame, damping: float = 0.85, rounds: int | None = None,
                      tolerance: float = 1e-6) -> DataFrame:
    """(walk, host, rank) from edges (src, dst, weight) and seeds (host, weight); ranks of a walk add up to 1.

    Both tables may carry a column `walk`: each of its values is a graph of its own, walked in the
    same jobs. Rounds go on until the ranks move by no more than `tolerance` in sum; the change
    shrinks by the damping each round, whatever the graph, so the number of rounds is about
    log(tolerance) / log(damping). `rounds` fixes their number instead. A round moves one number
    per edge, summed before the shuffle. Weight that reaches a host without edges returns to the
    seeds; as every return starts the same walk again, that is one scaling at the end.
    Without seeds nothing is ranked.
    """
    edges, seeds = (t if "walk" in t.columns else t.withColumn("walk", F.lit(0)) for t in (edges, seeds))
    share = stored(edges.join(edges.groupBy("walk", "src").agg(F.sum("weight").alias("out")), ["walk", "src"]).select(
        "walk", "src", "dst", (F.col("weight") / F.col("out")).alias("share")), "edge-shares")
    start = stored(_scaled(seeds, "weight").withColumnRenamed("weight", "seed"), "seeds")
    back = start.select("walk", "host", (F.col("seed") * (1 - damping)).alias("rank"))
    rank, done = start.select("walk", "host", F.col("seed").alias("rank")), 0
    while rounds is None or done < rounds:
        before, step = rank, STEP if rounds is None else min(STEP, rounds - done)
        for _ in range(step):
            moved = share.join(rank.withColumnRenamed("host", "src"), ["walk", "src"]).select(
                "walk", F.col("dst").alias("host"), (F.col("rank") * F.col("share") * damping).alias("rank"))
            rank = moved.unionByName(back).groupBy("walk", "host").agg(F.sum("rank").alias("rank"))
        rank, done = stored(rank, "ranks"), done + step
        if rounds is None:
            change = rank.unionByName(before.withColumn("rank", -F.col("rank"))).groupBy("walk", "host").agg(
                F.abs(F.sum("rank")).alias("change")).agg(F.sum("change")).first()[0]
            if not change or change <= tolerance:
                break
    return _scaled(rank, "rank")


def _scaled(values: DataFrame, column: str) -> DataFrame:
    """(walk, host, column) with the column divided by its sum per walk. The sums are a row per walk."""
    total = values.groupBy("walk").agg(F.sum(column).alias("total"))
    return values.join(F.broadcast(total), "walk").select("walk", "host", (F.col(column) / F.col("total")).alias(column))


def judge(pages: DataFrame, rules: list[Rule], most_distrust: float = 0.5, damping: float = 0.85, rounds: int | None = None,
          url: str = "url", html: str = "html") -> DataFrame:
    """Adds host, path, rule, verdict, trust and distrust to the pages (columns so named are replaced, no other is touched).

    A page under a rule takes the longest rule's verdict; of rules of one length the first by name.
    Hosts of pages that a rule allows are trusted seeds, those of blocked pages distrusted ones, by
    their number of pages. Trust is the personalised PageRank along host edges, distrust the same
    along reversed edges. Any other page is blocked where its host's distrust is more than
    `most_distrust` of the two together; a host that neither reaches is allowed, as is a tie at one half.

    Null or malformed urls have no host and are allowed; null or empty sources have no links.
    Sources are searched whole and never shuffled. Repeated rows stay and count once each as
    seeds and links. An empty table gives no rows.
    """
    given = pages.drop("host", "path", "rule", "verdict", "trust", "distrust")
    addressed = given.select(F.struct(*[F.col(f"`{c}`") for c in given.columns]).alias("page"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    ruled = addressed.withColumn("found", matching_rule(F.col("host"), F.col("path"), rules))
    edges = stored(host_edges(pages, url, html), "host-edges")
    seeds = stored(ruled.where("found is not null").groupBy("host", F.col("found.verdict").alias("walk")).agg(
        F.count("*").cast("double").alias("weight")), "seed-pages")
    walks = edges.select(F.lit("allow").alias("walk"), "src", "dst", "weight").unionByName(
        edges.select(F.lit("block").alias("walk"), F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    scores = personalised_rank(walks, seeds, damping, rounds).groupBy("host").agg(*[
        F.sum(F.when(F.col("walk") == walk, F.col("rank")).otherwise(0.0)).alias(name) for walk, name in (("allow", "trust"), ("block", "distrust"))])
    scored = ruled.join(scores, "host", "left").na.fill(0.0, ["trust", "distrust"])
    part = F.round(F.col("distrust") / (F.col("trust") + F.col("distrust")), 9)
    own = F.when((F.col("trust") + F.col("distrust") > 0) & (part > most_distrust), "block").otherwise("allow")
    return scored.select("page.*", "host", "path", F.col("found.rule").alias("rule"),
                         F.coalesce("found.verdict", own).alias("verdict"), "trust", "distrust")
