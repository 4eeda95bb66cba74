"""URL verdicts: rules on hosts and paths, and trust that flows along links for all other pages.

A rule names a host and a path; it fits that host and its subdomains where the url's path starts with the rule's, and the longest
rule that fits decides. For pages that no rule fits, the verdict is that of their host:

* Hosts with pages that rules allow are trusted seeds, hosts with pages that rules block are distrusted seeds, each by the
  number of such pages.
* Trust is a PageRank that starts anew at the trusted seeds and follows the links between hosts; distrust starts anew
  at the blocked seeds and follows the links backwards, so a host is distrusted for what it links to.
* A host is blocked if its distrust for a page, against the mean of all pages, is above its trust so measured by
  ``least_excess`` or more.

All in Spark's own functions. Links are counted by pairs of hosts before anything is joined. Ranks are integers (shares of
2^40) and so do not depend on the order of sums; a link's part of a rank
is divided out exactly for hosts with more than ``MOST_SHARED`` links, and for others taken as a share of 2^20, which loses less
than a thousandth; rounds are written to the shared folder a few at a time and end when no
rank changes. Joins on a host with very many pages or links can be split, as one side has a row for each host.

Null urls and those without ``://`` have an empty host and path, no links and are allowed. Null html has no links; links within a host
are not counted. Repeated rows are judged alike; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm.registry import query, table
from lexloom.sources.store import materialise

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Links of ``a`` elements that name a host.
LINK = r"""(?i)<a\s[^>]*?href\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s<>]+)"""
MASS = 1 << 40
SHARES = 1 << 20
#: Weight of a host's links up to which each link's part is a rounded share.
MOST_SHARED = 1 << 10


@dataclass(frozen=True)
class Rule:
    """``text`` is host and path in one, as ``example.net/en/``."""

    action: str
    text: str

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return self.text[len(self.host):]


#: A short list of rules, which stands in the plan as literals.
RULES = (Rule("block", "net/"), Rule("allow", "example.net/en/"), Rule("block", "example.com/de/"), Rule("allow", "org/fr/"))


@dataclass(frozen=True)
class Flow:
    """Twentieths of the rank that follow links, rounds at most and between writes, excess of distrust that blocks."""

    follow: int = 17
    rounds: int = 20
    written_every: int = 4
    least_excess: float = 1.0


def after_scheme(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


def host_of(url: Column) -> Column:
    host = F.regexp_extract(after_scheme(url), r"^[^/?#]*", 0)
    return F.coalesce(F.translate(host, UPPER, UPPER.lower()), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def judged_by(rules: tuple[Rule, ...]) -> Column:
    """The longest rule that fits ``host`` and ``path``, as a struct, or null."""
    fits = []
    for rule in rules:
        host = (F.col("host") == rule.host) | F.endswith("host", F.lit(f".{rule.host}"))
        found = F.struct(F.lit(len(rule.text)).alias("n"), F.lit(rule.text).alias("rule"), F.lit(rule.action).alias("action"))
        fits.append(F.when(host & F.startswith("path", F.lit(rule.path)), found))
    return F.greatest(*fits, F.lit(None).cast("struct<n:int,rule:string,action:string>"))


def host_links(pages: DataFrame) -> DataFrame:
    """``source``, ``target``, ``weight``: on how many pages of one host a link to the other stands."""
    found = F.transform(
        F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(LINK), F.lit(1)),
        lambda h: F.translate(h, UPPER, UPPER.lower()),
    )
    links = pages.where("host <> ''").select(F.col("host").alias("source"), F.explode(F.array_distinct(found)).alias("target"))
    return links.where("source <> target").groupBy("source", "target").agg(F.count("*").alias("weight"))


def _spread(hosts: DataFrame, links: DataFrame, how: Flow) -> DataFrame:
    """``host``, ``kind`` (trust or distrust), ``rank`` from ``host``, ``allowed``, ``blocked``."""
    forward = links.select(F.lit("trust").alias("kind"), F.col("source").alias("host"), F.col("target").alias("to"), "weight")
    backward = links.select(F.lit("distrust").alias("kind"), F.col("target").alias("host"), F.col("source").alias("to"), "weight")
    ways = forward.unionByName(backward)
    out = ways.groupBy("kind", "host").agg(F.sum("weight").alias("all_out"))
    share = F.floor(F.col("weight") * SHARES / F.col("all_out"))
    ways = ways.join(out, ["kind", "host"]).select("kind", "host", "to", "weight", "all_out", share.alias("share"))
    ways = materialise(ways, "links")
    kinds = F.explode(F.array(
        F.struct(F.lit("trust").alias("kind"), F.col("allowed").alias("n")),
        F.struct(F.lit("distrust").alias("kind"), F.col("blocked").alias("n")),
    ))
    seeds = hosts.select("host", kinds.alias("k")).select("host", "k.*")
    total = seeds.groupBy("kind").agg(F.sum("n").alias("all_n"))
    seeds = seeds.join(total, "kind").select(
        "kind", "host", F.coalesce(F.floor(F.try_divide(F.col("n") * F.lit(float(MASS)), F.col("all_n"))), F.lit(0)).alias("seed")
    )
    ends = ways.select("kind", F.col("to").alias("host")).unionByName(ways.select("kind", "host")).distinct()
    seeds = ends.join(seeds, ["kind", "host"], "full").select("kind", "host", F.coalesce("seed", F.lit(0)).alias("seed"))
    ranks = materialise(seeds.withColumn("rank", F.col("seed")), "ranks")
    part = F.when(F.col("all_out") <= MOST_SHARED, F.shiftright(F.col("rank") * F.col("share"), 20)).otherwise(
        F.expr("CAST(rank AS decimal(19,0)) * CAST(weight AS decimal(18,0)) DIV CAST(all_out AS decimal(19,0))")
    )
    for done in range(0, how.rounds, how.written_every):
        before = ranks
        for _ in range(min(how.written_every, how.rounds - done)):
            sent = ranks.join(ways, ["kind", "host"]).groupBy("kind", F.col("to").alias("host")).agg(F.sum(part).alias("got"))
            rank = F.floor(F.col("seed") * (20 - how.follow) / 20) + F.floor(F.coalesce("got", F.lit(0)) * how.follow / 20)
            ranks = ranks.join(sent, ["kind", "host"], "left").select("kind", "host", "seed", rank.alias("rank"))
        ranks = materialise(ranks, "ranks")
        moved = ranks.join(before.withColumnRenamed("rank", "was"), ["kind", "host"]).where("rank <> was")
        if done and moved.isEmpty():
            break
    return ranks


def host_verdicts(pages: DataFrame, how: Flow) -> DataFrame:
    """``host``, ``trust``, ``distrust``, ``host_verdict`` for every host with pages."""
    hosts = materialise(pages.groupBy("host").agg(
        F.count("*").alias("n_pages"), F.count_if(F.col("action") == "allow").alias("allowed"),
        F.count_if(F.col("action") == "block").alias("blocked"),
    ), "hosts")
    ranks = _spread(hosts.where("host <> ''"), host_links(pages), how)
    rank = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("rank"))), F.lit(0))
    flat = ranks.groupBy("host").agg(rank("trust").alias("trust"), rank("distrust").alias("distrust"))
    rows = hosts.join(flat, "host", "left").na.fill(0, ["trust", "distrust"])
    total = rows.agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust"), F.sum("n_pages").alias("pages")).first()
    dense = lambda c: F.coalesce(F.try_divide(
        F.col(c).cast("double") * F.lit(total["pages"]), F.lit(float(total[c] or 0)) * F.col("n_pages")
    ), F.lit(0.0))
    verdict = F.when(dense("distrust") - dense("trust") >= how.least_excess, "block").otherwise("allow")
    return rows.select("host", "trust", "distrust", verdict.alias("host_verdict"))


def judge_urls(pages: DataFrame, rules: tuple[Rule, ...] = RULES, how: Flow = Flow()) -> DataFrame:  # noqa: B008
    """``page_id``, ``host``, ``path``, ``rule``, ``verdict``, and the host's ``trust`` and ``distrust``."""
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "html")
    rows = rows.withColumn("found", judged_by(rules)).select("page_id", "host", "path", "html", "found.rule", "found.action")
    hosts = materialise(host_verdicts(rows, how), "verdicts")
    return rows.join(hosts, "host").select(
        "page_id", "host", "path", "rule", F.coalesce("action", "host_verdict").alias("verdict"), "trust", "distrust"
    )


def _sql(rules: tuple[Rule, ...], how: Flow) -> str:
    fits = ", ".join(
        f"CASE WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') "
        f"THEN {{'n': {len(r.text)}, 'rule': '{r.text}', 'action': '{r.action}'}} END" for r in rules
    )
    low = f"translate(%s, '{UPPER}', '{UPPER.lower()}')"
    link = LINK.replace("'", "''")
    steps = []
    for i in range(how.rounds):
        steps.append(f"""
r{i + 1} AS MATERIALIZED (
  SELECT kind, host, seed, seed * {20 - how.follow} // 20 + coalesce(got, 0) * {how.follow} // 20 AS rank
  FROM r{i} LEFT JOIN (SELECT kind, dst AS host, sum((rank * share) >> 20)::BIGINT AS got
                       FROM r{i} JOIN w USING (kind, host) GROUP BY ALL) USING (kind, host)),""")
    return f"""
WITH u AS (SELECT page_id, html, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p0 AS (SELECT page_id, html, coalesce({low % "regexp_extract(rest, '^[^/?#]*')"}, '') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u),
p1 AS (SELECT *, list_sort([{fits}], 'DESC', 'NULLS LAST')[1] AS f FROM p0),
p AS (SELECT *, f.rule AS rule, f.action AS action FROM p1),
h AS (SELECT host, count(*) AS n_pages, count(*) FILTER (action = 'allow') AS allowed, count(*) FILTER (action = 'block') AS blocked
      FROM p GROUP BY host),
l0 AS (SELECT DISTINCT page_id, source, dst FROM (
         SELECT page_id, host AS source, {low % f"unnest(regexp_extract_all(coalesce(html, ''), '{link}', 1))"} AS dst
         FROM p WHERE host <> '')),
l AS (SELECT source, dst, count(*) AS weight FROM l0 WHERE source <> dst GROUP BY ALL),
w0 AS (SELECT 'trust' AS kind, source AS host, dst, weight FROM l UNION ALL SELECT 'distrust', dst, source, weight FROM l),
w AS MATERIALIZED (SELECT kind, host, dst, floor(weight * {SHARES} / sum(weight) OVER (PARTITION BY kind, host))::BIGINT AS share FROM w0),
s0 AS (SELECT 'trust' AS kind, host, allowed AS n FROM h WHERE host <> '' UNION ALL SELECT 'distrust', host, blocked FROM h WHERE host <> ''),
s1 AS (SELECT kind, host, coalesce(floor(n * {MASS}::DOUBLE / nullif(sum(n) OVER (PARTITION BY kind), 0))::BIGINT, 0) AS seed FROM s0),
e AS (SELECT kind, host FROM w UNION SELECT kind, dst FROM w),
r0 AS MATERIALIZED (SELECT kind, host, coalesce(seed, 0) AS seed, coalesce(seed, 0) AS rank FROM e FULL JOIN s1 USING (kind, host)),
{"".join(steps)}
t AS (SELECT h.host, n_pages, coalesce(sum(rank) FILTER (kind = 'trust'), 0)::BIGINT AS trust,
        coalesce(sum(rank) FILTER (kind = 'distrust'), 0)::BIGINT AS distrust
      FROM h LEFT JOIN r{how.rounds} USING (host) GROUP BY ALL),
v AS (SELECT host, trust, distrust,
        coalesce(distrust::DOUBLE * sum(n_pages) OVER () / nullif(sum(distrust) OVER ()::DOUBLE * n_pages, 0), 0)
        - coalesce(trust::DOUBLE * sum(n_pages) OVER () / nullif(sum(trust) OVER ()::DOUBLE * n_pages, 0), 0) AS excess FROM t)
SELECT page_id, p.host, path, rule, coalesce(action, CASE WHEN excess >= {how.least_excess} THEN 'block' ELSE 'allow' END) AS verdict,
       trust, distrust
FROM p JOIN v ON p.host = v.host
"""


@query("op1_url_trust", _sql(RULES, Flow()))
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))
