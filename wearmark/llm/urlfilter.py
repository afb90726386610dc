"""URL filtering with DataFrame functions only: rules first, then trust and distrust over host links.

Rules name a host and a path prefix; the longest that fits decides. Urls
without a rule are decided by their host: trust flows along links from hosts
whose pages are mostly allowed, distrust flows against links from hosts whose
pages are mostly blocked (who links to a blocked host shares its distrust), both
as personalised PageRank. A host is blocked when distrust exceeds trust clearly.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .common import delete_written, small_side, written

# Rules as (verdict, host and path prefix).
RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)
DAMPING = 0.85
ROUNDS = 60
SETTLED = 1e-4  # largest change of a score that counts as none
MARGIN = 0.05  # distrust above trust from which a host is blocked
SEED_SHARE = 0.5  # part of a host's pages that rules must judge alike to make it a seed
LINK = r"""(?i)<a\s[^>]*?href\s*=\s*["']?\s*((?:https?:)?//[^"'\s>]+)"""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    """What follows the first ``://``; empty without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    """Host of a url, ASCII letters in lower case; empty for null or without ``://``."""
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """Path of a url up to ``?``, ``#`` or its end; empty for null or without ``://``."""
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> Column:
    """``struct(rule, verdict)`` of the longest rule that fits, else null.

    A rule fits its host and all subdomains when the path starts with its path.
    The rules are a list the caller wrote, a few hundred at most.
    """
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, _, prefix = rule.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit(f".{name}"))) & F.startswith(path, F.lit(f"/{prefix}"))
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def host_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``src, dst, weight``: distinct linking pages between different hosts."""
    targets = F.array_distinct(
        F.transform(
            F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit(LINK), F.lit(1)),
            lambda t: host_of(F.concat(F.lit("x:"), F.substring(t, F.instr(t, "//"), F.length(t)))),
        )
    )
    links = pages.select(host_of(F.col(url)).alias("src"), F.explode(targets).alias("dst"))
    return links.filter("src != dst and src != '' and dst != ''").groupBy("src", "dst").agg(
        F.count(F.lit(1)).alias("weight")
    )


def propagate(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """``host, score``: personalised PageRank of ``seeds(host, seed)`` along ``edges(src, dst, part)``.

    ``part`` is the share of the source's links that an edge holds. Scores stay
    unnormalised, so a threshold means the same at every number of hosts. Each
    round is written; contributions are summed before they are shuffled.
    """
    base = seeds.select("host", (F.col("seed") * (1 - DAMPING)).alias("score"))
    scores = written(base, "scores")
    if edges.isEmpty() or seeds.isEmpty():
        return scores
    for _ in range(ROUNDS):
        sent = edges.join(scores, F.col("src") == F.col("host")).select(
            F.col("dst").alias("host"), (F.col("score") * F.col("part") * DAMPING).alias("score")
        )
        new = written(base.unionByName(sent).groupBy("host").agg(F.sum("score").alias("score")), "scores")
        change = (
            new.select("host", F.col("score").alias("d"))
            .unionByName(scores.select("host", (-F.col("score")).alias("d")))
            .groupBy("host")
            .agg(F.abs(F.sum("d")).alias("d"))
            .agg(F.max("d"))
            .first()[0]
        )
        delete_written(scores)
        scores = new
        if change < SETTLED:
            break
    return scores


def judged(
    pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, key: str = "page_id", url: str = "url", html: str = "html"
) -> DataFrame:
    """``page_id, host, path, rule, verdict, trust, distrust`` of every page.

    A null url has no host and no rule and is allowed; so is a host that neither
    trust nor distrust reaches. Repeated rows each get a row and count in their
    host's shares. An empty table gives an empty one.
    """
    host, path = host_of(F.col(url)), path_of(F.col(url))
    rows = pages.select(F.col(key).alias("page_id"), host.alias("host"), path.alias("path")).withColumn(
        "_rule", rule_of(F.col("host"), F.col("path"), rules)
    )
    share = lambda v: F.avg(F.when(F.col("_rule.verdict") == v, 1.0).otherwise(0.0))
    hosts = written(
        rows.filter("host != ''").groupBy("host").agg(share("allow").alias("allowed"), share("block").alias("blocked")),
        "hosts",
    )
    links = written(host_links(pages, url, html), "links")

    def scores(column: str, src: str, dst: str, out: str) -> DataFrame:
        seeds = hosts.filter(F.col(column) > SEED_SHARE).select("host", F.col(column).alias("seed"))
        total = links.groupBy(F.col(src).alias("_s")).agg(F.sum("weight").alias("_all"))
        edges = links.join(total, F.col(src) == F.col("_s")).select(
            F.col(src).alias("src"), F.col(dst).alias("dst"), (F.col("weight") / F.col("_all")).alias("part")
        )
        return propagate(written(edges, "edges"), seeds).withColumnRenamed("score", out)

    both = written(
        scores("allowed", "src", "dst", "trust").join(scores("blocked", "dst", "src", "distrust"), "host", "full").select(
            "host", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("trust", "distrust")]
        ),
        "host_scores",
    )
    found = rows.join(small_side(both), "host", "left").withColumns(
        {c: F.coalesce(c, F.lit(0.0)) for c in ("trust", "distrust")}
    )
    by_host = F.when(F.col("distrust") - F.col("trust") > MARGIN, "block").otherwise("allow")
    return found.select(
        "page_id",
        "host",
        "path",
        F.col("_rule.rule").alias("rule"),
        F.coalesce(F.col("_rule.verdict"), by_host).alias("verdict"),
        "trust",
        "distrust",
    )
