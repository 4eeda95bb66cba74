"""Parts of urls, rules, and trust on a small graph against a plain version."""

import random
import re

from lexloom.llm import url_trust as U


def page(i, url, links=(), html=""):
    return (i, url, html + "".join(f'<p><A class=x HREF="{x}">t</a>' for x in links))


def frame(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_parts_and_rules(spark):
    cases = {
        "http://WWW.Example.net/en/1?x#y": ("www.example.net", "/en/1", "example.net/en/", "allow"),
        "https://example.net/EN/": ("example.net", "/EN/", "net/", "block"),
        "http://net?q=/": ("net", "", None, None), "net/": ("", "", None, "allow"), None: ("", "", None, "allow"),
        "http://badexample.com/de/": ("badexample.com", "/de/", None, None),
        "a://x.example.com/de/://y": ("x.example.com", "/de/://y", "example.com/de/", "block"),
        "http://k.org/fr/é#a": ("k.org", "/fr/é", "org/fr/", "allow"), "": ("", "", None, "allow"),
    }
    got = {r.page_id: r for r in U.judge_urls(frame(spark, [(i, u, None) for i, u in enumerate(cases)])).collect()}
    for i, (host, path, rule, verdict) in enumerate(cases.values()):
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule)
        assert verdict is None or got[i].verdict == verdict


def plain(pages, how):
    """Trust and distrust of each host by loops."""
    host = lambda u: re.match(r"[^/?#]*", u.split("://", 1)[1]).group().lower()
    rules = {"a.org": "allow", "bad.net": "block"}
    n = {h: sum(host(u) == h for _, u, _ in pages) for h in {host(u) for _, u, _ in pages}}
    weight = {}
    for _, url, html in pages:
        for target in {t.lower() for t in re.findall(U.LINK, html)}:
            if target != host(url):
                weight[host(url), target] = weight.get((host(url), target), 0) + 1
    out = {}
    for kind, action in (("trust", "allow"), ("distrust", "block")):
        edges = weight if kind == "trust" else {(b, a): w for (a, b), w in weight.items()}
        total = {}
        for (a, _), w in edges.items():
            total[a] = total.get(a, 0) + w
        seeds = {h: n[h] if rules.get(h) == action else 0 for h in n}
        seed = {h: int(s * U.MASS / sum(seeds.values())) for h, s in seeds.items()}
        rank = {h: seed.get(h, 0) for h in {*n, *(x for e in edges for x in e)}}
        for _ in range(how.rounds):
            sent = dict.fromkeys(rank, 0)
            for (a, b), w in edges.items():
                sent[b] += (rank[a] * (w * U.SHARES // total[a])) >> 20
            rank = {h: seed.get(h, 0) * (20 - how.follow) // 20 + sent[h] * how.follow // 20 for h in rank}
        out[kind] = rank
    return {h: (out["trust"][h], out["distrust"][h]) for h in n}


def test_ranks_on_a_graph(spark):
    draw = random.Random(2)
    hosts = ["a.org", "bad.net", *[f"h{i}.com" for i in range(12)]]
    pages = []
    for i in range(80):
        source = hosts[i % len(hosts)]
        path = {"a.org": "/fr/", "bad.net": "/x"}.get(source, "/p")
        links = [f"{draw.choice(['http:', 'HTTPS:', ''])}//{draw.choice(hosts).upper()}/q" for _ in range(draw.randint(0, 3))]
        pages.append(page(i, f"http://{source}{path}{i}", [*links, "/same", "mailto:x"], "<b href='http://no.com'>"))
    how = U.Flow()
    got = U.judge_urls(frame(spark, pages), how=how).collect()
    assert {r.host: (r.trust, r.distrust) for r in got} == plain(pages, how)


def test_hosts_that_link_to_blocked_ones_are_blocked(spark):
    pages = [page(1, "http://bad.net/x"), page(2, "http://farm.com/", ["http://bad.net/"] * 2), page(3, "http://a.org/fr/1", ["//good.com"]),
             page(4, "http://good.com/"), page(5, "http://lone.com/"), page(5, "http://lone.com/")]
    got = sorted((r.host, r.verdict) for r in U.judge_urls(frame(spark, pages)).collect())
    assert got == [("a.org", "allow"), ("bad.net", "block"), ("farm.com", "block"), ("good.com", "allow"), ("lone.com", "allow"), ("lone.com", "allow")]


def test_empty_table_and_other_columns(spark):
    rows = spark.createDataFrame([(None, "http://x.com/a", None, 1, "z")], "page_id long, url string, html string, host int, rule string")
    (r,) = U.judge_urls(rows).collect()
    assert (r.page_id, r.host, r.rule, r.verdict) == (None, "x.com", None, "allow")
    assert U.judge_urls(rows.where("false")).count() == 0


def test_a_host_of_very_many_links_passes_its_rank_on(spark):
    n = U.SHARES + 10
    links = spark.range(n).selectExpr("concat('h', id, '.com') AS source", "'bad.net' AS target", "1L AS weight")
    links = links.unionByName(spark.createDataFrame([("a.org", "x.com", 3 * n), ("a.org", "y.com", 1)], links.schema))
    hosts = spark.createDataFrame([("bad.net", 0, 1), ("a.org", 1, 0)], "host string, allowed long, blocked long")
    ranks = U._spread(hosts, links, U.Flow(rounds=1, written_every=1)).where("rank > 0")
    got = {(r["kind"], r["rank"]): r["count"] for r in ranks.where("startswith(host, 'h')").groupBy("kind", "rank").count().collect()}
    assert got == {("distrust", U.MASS // n * 17 // 20): n}
    trust = {r.host: r["rank"] for r in ranks.where("kind = 'trust'").collect()}
    assert trust == {"a.org": U.MASS * 3 // 20, "x.com": U.MASS * 3 * n // (3 * n + 1) * 17 // 20, "y.com": U.MASS // (3 * n + 1) * 17 // 20}
