"""URL filters: host and path rules first, then a tree of path templates.

Templates. A path is cut into segments; a segment of digits is a number, one
with other variable parts (long hex, dates, mixed letters and digits) a
wildcard, a suffix such as ``.html`` is kept. A template is a host with the
generalised segments, and its prefixes are the nodes of a tree, the host's root
being the shortest.

Merging goes from the root down, and each level works on the merged prefixes of the one above.
Children of a node with fewer than ``support`` labelled urls (user names, slugs, unlabelled ones) are
pooled first. The pool and every other child are alike where they have at least ``support`` labelled urls and their bad
share lies within ``alike`` standard errors of the share of all the node's children; alike ones become one
wildcard ``{*}``. A pool that is not alike, or has too few labels itself, stays apart as ``{rare}``.

Verdict. The deepest node below the root with at least ``support`` labelled urls
decides by its smoothed purity, (bad + prior x weight) / (n + weight), the prior being its
parent's, at first the host's; from ``reject_at`` on it is rejected. Where a host has no such node, the
same tree over the paths of all hosts decides, with the url's own host as the prior; its templates begin
with ``*``. Home pages are left out of that, and urls without a node there either: they have no template, and are allowed.

Every count is a grouped sum over all urls; one host may have any share of them, as sums are combined before the
shuffle and verdicts are joined per template, not per url. A level is a round, and rounds end where no
node has enough labelled urls any more: deeper ones have no more than those above.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayframe.llm.common import ascii_lower, meet, written


@dataclass(frozen=True)
class Rule:
    """``host``: a domain that it and its subdomains end with. ``path``: what the url's path starts with."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: The rules of the registered query.
RULES = (Rule("net", "/", "block"), Rule("example.net", "/en/", "allow"), Rule("example.com", "/de/", "block"), Rule("org", "/fr/", "allow"))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def ruled(rules: tuple[Rule, ...], host: Column, path: Column) -> Column:
    """The name of the longest rule that fits (of equal length the first by name), or null."""
    found = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.name), [-ord(c) for c in r.name])):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        found = F.when(fits, F.lit(r.name)).otherwise(found)
    return found


def segment_kinds(path: Column) -> Column:
    """The path's segments with their variable parts generalised."""
    kind = lambda s: (
        F.when(s.rlike(r"^\d+$"), "{number}")
        .when(s.rlike(r"^\d{4}-\d{1,2}(-\d{1,2})?$"), "{date}")
        .when(s.rlike(r"^\d+\.\w{1,5}$"), F.concat(F.lit("{number}"), F.regexp_extract(s, r"(\.\w+)$", 1)))
        .when(s.rlike(r"^[0-9a-fA-F-]{16,}$"), "{id}")
        .when(s.rlike(r"\d") & (F.length(s) > 3), F.concat(F.lit("{*}"), F.regexp_extract(s, r"(\.\w{1,5})$", 1)))
        .otherwise(s)
    )
    return F.transform(F.split(F.regexp_replace(path, "^/", ""), "/", -1), kind)


def _joined(parts: Column, k: Column | int) -> Column:
    return F.concat(F.lit("/"), F.array_join(F.slice(parts, 1, k), "/"))


def template_tree(urls: DataFrame, alike: float = 2.0, weight: float = 8.0, support: int = 5) -> DataFrame:
    """``host, leaf, urls, bad, n, template, purity, labelled`` from ``host, leaf, path, label`` (1 bad, 0 good, null unlabelled).

    ``template`` is the deepest merged prefix with enough labelled urls, null where none has, and ``labelled`` their number;
    bad and n count the leaf's own labels.
    """
    bad, good = F.sum(F.when(F.col("label") == 1, 1).otherwise(0)), F.sum(F.when(F.col("label") == 0, 1).otherwise(0))
    now = urls.groupBy("host", "leaf", segment_kinds(F.col("path")).alias("parts")).agg(bad.alias("bad"), (bad + good).alias("n"), F.count("*").alias("urls"))
    start = {"prefix": F.lit(""), "template": F.lit(None).cast("string"), "purity": F.lit(None).cast("double"), "labelled": F.lit(None).cast("long")}
    now = written(now.withColumns(start), "url_leaves")
    deepest, leaves = now.agg(F.max(F.size("parts")), F.count("*")).first()
    for d in range(deepest or 0):
        level = now.withColumn("segment", F.when(F.size("parts") > d, F.get("parts", F.lit(d))))
        merged = written(_merged(level.filter("segment IS NOT NULL"), alike, weight, support), "url_nodes")
        if merged.filter(F.col("node_n") >= support).isEmpty():
            break
        at = F.struct("host", "prefix", "segment").alias("at")
        nodes = merged.select(at, "node", "node_n", "node_purity", "leaves")
        told = meet(level.filter("segment IS NOT NULL").select("*", at), nodes, "at", "leaves", leaves).drop("leaves", "at")  # a segment may have a third of all leaves
        told = told.unionByName(level.filter("segment IS NULL"), allowMissingColumns=True)
        enough = F.coalesce(F.col("node_n") >= support, F.lit(False))
        better = {"template": "node", "purity": "node_purity", "labelled": "node_n"}
        kept = {"prefix": F.coalesce("node", "prefix")} | {k: F.when(enough, F.col(c)).otherwise(F.col(k)) for k, c in better.items()}
        now = written(told.select("host", "leaf", "parts", "bad", "n", "urls", *[c.alias(k) for k, c in kept.items()]), "url_leaves")
    return now.select("host", "leaf", "urls", "bad", "n", "template", "purity", "labelled")


def decide(urls: DataFrame, alike: float = 2.0, weight: float = 8.0, support: int = 5) -> DataFrame:
    """``host, leaf, urls, template, purity``: each host's own tree, and the tree of all hosts where that has no node."""
    own = template_tree(urls, alike, weight, support)
    hosts = own.groupBy("host").agg(((F.sum("bad") + 0.5) / (F.sum("n") + 1)).alias("prior"), F.count("*").alias("leaves"))
    own = written(meet(own, written(hosts, "url_hosts"), "host", "leaves"), "url_trees")
    shared = template_tree(urls.withColumn("host", F.lit("*")), alike, weight, support)
    shared = shared.withColumns({c: F.when(F.col("leaf") != "/", F.col(c)) for c in ("template", "purity", "labelled")})  # home pages have nothing in common
    among = own.groupBy("leaf").agg(F.count("*").alias("among"))
    shared = shared.join(among, "leaf").select("leaf", "among", F.concat("host", "template").alias("shared"), F.col("purity").alias("shared_purity"), F.col("labelled").alias("shared_n"))
    both = meet(own.drop("labelled", "bad", "n"), written(shared, "url_shared"), "leaf", "among")
    backed = (F.col("shared_purity") * F.col("shared_n") + F.col("prior") * weight) / (F.col("shared_n") + weight)
    return both.select("host", "leaf", "urls", F.coalesce("template", "shared").alias("template"), F.when(F.col("template").isNotNull(), F.col("purity")).otherwise(backed).alias("purity"))


def _merged(level: DataFrame, alike: float, weight: float, support: int) -> DataFrame:
    """``host, prefix, segment, leaves, node, node_n, node_purity``: the node that each branch of a level belongs to, and its leaves."""
    branches = level.groupBy("host", "prefix", "segment").agg(F.sum("bad").alias("bad"), F.sum("n").alias("n"), F.count("*").alias("leaves"))
    thin = F.col("n") < support
    sums = {"all_bad": F.col("bad"), "all_n": F.col("n"), "ways": F.lit(1), "pool_bad": F.when(thin, F.col("bad")), "pool_n": F.when(thin, F.col("n")), "pool_ways": F.when(thin, 1)}
    whole = branches.groupBy("host", "prefix").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(k) for k, c in sums.items()])
    own = branches.join(whole, ["host", "prefix"])
    prior = (F.col("all_bad") + 0.5) / (F.col("all_n") + 1)
    pooled = thin & (F.col("pool_ways") > 1)
    n, bad = F.when(pooled, F.col("pool_n")).otherwise(F.col("n")), F.when(pooled, F.col("pool_bad")).otherwise(F.col("bad"))
    share, error = (bad + prior * weight) / (n + weight), F.sqrt(prior * (1 - prior) / (n + 1))
    same = (F.col("ways") > 1) & (n >= support) & (F.abs(share - prior) <= alike * error)
    name = F.when(same, "{*}").when(pooled, "{rare}").otherwise(F.col("segment"))
    own = own.select("host", "prefix", "segment", "leaves", "bad", "n", prior.alias("prior"), F.concat("prefix", F.lit("/"), name).alias("node"))
    nodes = own.groupBy("host", "prefix", "node").agg(F.sum("n").alias("node_n"), F.sum("bad").alias("node_bad"))
    purity = (F.col("node_bad") + F.col("prior") * weight) / (F.col("node_n") + weight)
    return own.join(nodes, ["host", "prefix", "node"]).select("host", "prefix", "segment", "leaves", "node", "node_n", purity.alias("node_purity"))


def judge(pages: DataFrame, rules: tuple[Rule, ...], labels: DataFrame | None = None, alike: float = 2.0, weight: float = 8.0, support: int = 5, reject_at: float = 0.5) -> DataFrame:
    """``page_id, host, path, rule, verdict, template, purity`` for every url.

    Labelled urls come from ``labels (page_id, label)``; where it is None the rules'
    own verdicts label the urls that they fit, and reach other hosts by templates that these share. Null urls and urls without ``://``
    have an empty host and path, a template of their own, and are allowed unless
    their template is rejected. Repeated rows give repeated rows.
    """
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("rule", ruled(rules, F.col("host"), F.col("path")))
    verdicts = F.create_map(*[F.lit(x) for r in rules for x in (r.name, r.verdict)]) if rules else None
    if verdicts is None:
        rows = rows.withColumn("ruled", F.lit(None).cast("string"))
    else:
        rows = rows.withColumn("ruled", verdicts[F.col("rule")])
    if labels is None:
        rows = rows.withColumn("label", F.when(F.col("ruled") == "block", 1).when(F.col("ruled") == "allow", 0))
    else:
        told = labels.groupBy(F.col("page_id").cast("long").alias("page_id")).agg(F.max("label").alias("label"))
        rows = rows.join(told, "page_id", "left")
    rows = written(rows.withColumn("leaf", _joined(segment_kinds(F.col("path")), F.size(segment_kinds(F.col("path"))))), "urls")

    tree = written(decide(rows, alike, weight, support), "url_verdicts")
    decided = tree.select(F.struct("host", "leaf").alias("of"), "urls", "template", "purity")
    out = meet(rows.withColumn("of", F.struct("host", "leaf")), decided, "of", "urls")
    rejected = F.coalesce(F.col("purity") >= reject_at, F.lit(False))
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(rejected, "block").otherwise("allow")).alias("verdict"), "template", "purity")
