"""URL filters: fixed host and path rules, and trust propagated over the link graph, on built-in Spark functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ephemera.llm.common import checkpointed, lower_ascii, spread_left_join, stored

#: (host, path, verdict): a rule fits its host and all subdomains where the path starts with its path.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
DAMPING = 0.85
ROUNDS = 20
DISTRUST = 0.5  # share of distrust in all evidence of a host from which on it is blocked
LEAST = 0.25  # trust and distrust of less than this part of an even share over all hosts count as none
PARENT = 1.0  # weight of the edge between a host and its parent domain
# Labels under which two-letter domains register names, and domains that host many owners' sites.
REGISTRIES = ("ac", "asn", "co", "com", "edu", "firm", "gen", "go", "gob", "gouv", "gov", "gv", "id", "ind", "info", "ltd", "me", "mil", "ne", "net", "nhs", "nic", "nom", "or", "org", "plc", "police", "sch", "school", "web")
SHARED = (
    "amazonaws.com", "appspot.com", "azurewebsites.net", "blogspot.com", "cloudfront.net", "firebaseapp.com", "fly.dev", "github.io", "gitlab.io", "herokuapp.com", "myshopify.com", "neocities.org", "netlify.app",
    "onrender.com", "pages.dev", "readthedocs.io", "s3.amazonaws.com", "squarespace.com", "substack.com", "surge.sh", "tumblr.com", "vercel.app", "web.app", "weebly.com", "wixsite.com", "wordpress.com", "workers.dev",
)
#: Where a host follows: after a scheme anywhere (attributes and plain text), or after // at the start of an attribute.
LINK = "(?i)(?:[a-z][a-z0-9+.-]*:|=[ \\t\\r\\n]*[\"']?)//([^/?#\"'<>() \\t\\r\\n\\\\]+)"


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else ''."""
    return F.coalesce(lower_ascii(F.regexp_extract(_rest(url), "^[^/?#]*", 0)), F.lit(""))


def site_of(host: Column) -> Column:
    """A host without user, port and the marks that text puts behind it: what pages and links are joined by."""
    name = F.regexp_extract(F.regexp_replace(host, "^(?:[^@]*@)+", ""), "^[^:\\[\\]]*", 0)
    return F.regexp_replace(name, "[.,;!]+\\z", "")


def url_path(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end; else ''."""
    return F.coalesce(F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.char_length(url)))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest fitting rule as (rule, verdict), or null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for name, start, verdict in sorted(rules, key=lambda r: len(r[0]) + len(r[1])):
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(start)
        found = F.when(fits, F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def host_links(pages: DataFrame, html_col: str, host: Column) -> DataFrame:
    """(src, dst, weight): links between different sites (``site_of``), counted, from every attribute and the text of a page.

    Relative links, and a page's links to its own host, tie a host to itself only and are left out.
    """
    found = F.regexp_extract_all(F.col(html_col), F.lit(LINK), F.lit(1))
    links = pages.select(site_of(host).alias("src"), F.explode(found).alias("dst")).withColumn("dst", site_of(lower_ascii(F.col("dst"))))
    links = links.where("src <> '' and dst <> '' and src <> dst")
    return links.groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))


def parent_links(hosts: DataFrame, weight: float = PARENT, shared: tuple[str, ...] = SHARED) -> DataFrame:
    """(src, dst, weight): each host and its ancestors with its own parent domain, both ways, down to two labels.

    ``m.site.example`` and ``blog.site.example`` are parts of one site, whether or not their pages link to each other.
    Registries (``co.uk``: REGISTRIES under two letters) and domains whose names belong to many owners (``shared``) are
    nobody's parent, and addresses of numbers have none.
    """
    hosts = hosts.where("host not rlike '^[0-9.]+\\\\z'")
    registry = F.col("e.b").rlike(rf"^(?:{'|'.join(REGISTRIES)})\.[a-z]{{2}}\z") | F.col("e.b").isin(*shared)
    labels = F.split("host", "\\.")
    tails = F.transform(F.sequence(F.lit(1), F.size("p") - 1), lambda k: F.array_join(F.slice("p", k, F.size("p")), "."))
    chains = hosts.select(labels.alias("p")).where(F.size("p") > 2).select(F.explode(F.arrays_zip(tails.alias("a"), F.slice(tails, F.lit(2), F.size("p")).alias("b"))).alias("e"))
    pairs = chains.where("e.b is not null and e.a <> '' and e.b <> ''").where(~registry).select("e.a", "e.b").distinct()
    both = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst")))).alias("e"))
    return both.select("e.src", "e.dst", F.lit(weight).alias("weight"))


def personalised_pagerank(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """(node, score) of all nodes that seeds reach; ``seeds`` has node and a share, summing to 1.

    With a column kind in both tables each kind is a graph with seeds of its own, and the result has kind, too.  Each
    round is one join and one partial aggregation, whose result is checkpointed.  Nodes without links give their
    score back to the seeds.
    """
    kinds = ["kind"] if "kind" in edges.columns else []
    if not kinds:
        edges, seeds = edges.withColumn("kind", F.lit("")), seeds.withColumn("kind", F.lit(""))
    out = edges.groupBy("kind", "src").agg(F.sum("weight").alias("total"))
    steps = checkpointed(edges.join(out, ["kind", "src"]).select("kind", F.col("src").alias("node"), "dst", (F.col("weight") / F.col("total")).alias("p")))
    seeds = checkpointed(seeds.select("kind", "node", "share"))
    scores = seeds.withColumnRenamed("share", "score")
    if not steps.isEmpty():
        for _ in range(rounds):
            moved = scores.join(steps, ["kind", "node"]).groupBy("kind", "dst").agg((damping * F.sum(F.col("score") * F.col("p"))).alias("got"))
            moved = checkpointed(moved.select("kind", F.col("dst").alias("node"), "got"))
            kept = moved.groupBy("kind").agg(F.sum("got").alias("sum"))
            back = seeds.join(F.broadcast(kept), "kind", "left")  # a row per kind
            back = back.select("kind", "node", (F.col("share") * (1 - F.coalesce("sum", F.lit(0.0)))).alias("got"))
            scores = moved.unionByName(back).groupBy("kind", "node").agg(F.sum("got").alias("score"))
    return scores.select(*kinds, "node", "score")


def filter_urls(
    pages: DataFrame,
    url_col: str = "url",
    html_col: str = "html",
    id_col: str = "page_id",
    rules: list[tuple[str, str, str]] = RULES,
    damping: float = DAMPING,
    rounds: int = ROUNDS,
    threshold: float = DISTRUST,
    shared: tuple[str, ...] = SHARED,
) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust) for every row.

    The longest fitting rule decides.  Elsewhere the site does (the host without user and port): trusted seeds are sites
    most of whose pages a rule allows, blocked seeds those most of whose pages a rule blocks, each weighted by its pages.  Trust is a personalised
    PageRank from trusted seeds along the edges between hosts, distrust one from blocked seeds against them; edges are
    links in the pages (``host_links``) and those between a host and its parent domain (``parent_links``; names under a
    domain of ``shared`` owners have no common parent).  Scores
    under LEAST of an even share count as none; a host is blocked if distrust is ``threshold`` or more of the two.
    Hosts without evidence are allowed.

    Null urls, or without ``://``, have empty host and path, fit no rule and are allowed; null html has no links;
    urls and pages have any length; repeated rows are judged alike and count as pages; an empty table gives an empty
    result; other columns, whatever their names, are ignored.
    """
    host, path = url_host(F.col(url_col)), url_path(F.col(url_col))
    judged = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    judged = stored(judged.withColumns({"r": rule_of(F.col("host"), F.col("path"), rules), "site": site_of(F.col("host"))}))
    per_host = judged.where("site <> ''").groupBy(F.col("site").alias("host")).agg(
        F.count("*").alias("pages"), F.count_if(F.col("r.verdict") == "allow").alias("allowed"), F.count_if(F.col("r.verdict") == "block").alias("blocked")
    )
    per_host = checkpointed(per_host)
    links = host_links(pages, html_col, host)
    every = per_host.select("host").union(links.select("dst")).distinct()
    edges = checkpointed(links.unionByName(parent_links(every, shared=shared)).groupBy("src", "dst").agg(F.sum("weight").alias("weight")))
    trust_edges = edges.select(F.lit("allowed").alias("kind"), "src", "dst", "weight")
    both = trust_edges.unionByName(edges.select(F.lit("blocked").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    seeds = per_host.select("host", F.explode(F.array(F.lit("allowed"), F.lit("blocked"))).alias("kind"), "pages", "allowed", "blocked")
    seeds = seeds.select("kind", F.col("host").alias("node"), "pages", F.when(F.col("kind") == "allowed", F.col("allowed")).otherwise(F.col("blocked")).alias("n")).where("2 * n > pages")
    total = seeds.groupBy("kind").agg(F.sum("n").alias("total"))
    seeds = seeds.join(F.broadcast(total), "kind").select("kind", "node", (F.col("n") / F.col("total")).alias("share"))  # a row per kind
    scores = personalised_pagerank(both, seeds, damping, rounds)
    known = scores.groupBy(F.col("node").alias("host")).agg(*(F.sum(F.when(F.col("kind") == k, F.col("score")).otherwise(0.0)).alias(c) for k, c in (("allowed", "trust"), ("blocked", "distrust"))))
    least = per_host.agg((LEAST / F.count("*")).alias("least"))
    known = known.crossJoin(F.broadcast(least)).select(F.col("host").alias("site"), *(F.when(F.col(c) >= F.col("least"), F.col(c)).otherwise(0.0).alias(c) for c in ("trust", "distrust")))  # one row
    out = spread_left_join(judged, checkpointed(known), "site").na.fill(0.0, ["trust", "distrust"])
    bad = (F.col("distrust") > 0) & (F.col("distrust") >= threshold * (F.col("trust") + F.col("distrust")))
    verdict = F.coalesce(F.col("r.verdict"), F.when(bad, "block").otherwise("allow"))
    return out.select("page_id", "host", "path", F.col("r.rule").alias("rule"), verdict.alias("verdict"), "trust", "distrust")
