"""URL filter: allow and block rules, carried over to the other addresses of the same page.

An address is a host and a path. Redirects and canonical links say that two addresses are one
page: links in the page itself (rel=canonical, meta refresh), a table of observed redirects if
there is one, and the redirects that servers make by themselves (a leading www. or m., a final
slash, .html). Addresses so linked, directly or not, form one component. An address that no rule
fits takes the decision of its component: allowed if an explicit allow rule fits a member, else
blocked if a block rule fits one, else allowed. A rule that fits an address itself always wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.llm.common import connected_components, written

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def _node(host: Column, path: Column) -> Column:
    return F.concat(host, F.lit("\n"), path)


def _served(host: Column, path: Column) -> Column:
    """The address to which a server redirects the usual variants of it."""
    bare = F.regexp_replace(host, r"^(?:www|m)\.", "")
    short = F.regexp_replace(F.regexp_replace(path, r"/index\.html?$|\.html?$", ""), r"(?<=.)/$", "")
    return _node(bare, F.when((short == "") & (path != ""), F.lit("/")).otherwise(short))


def _page_links(html: Column) -> Column:
    """Targets of rel=canonical links and of meta refreshes."""
    tags = F.regexp_extract_all(html, F.lit(r"(?i)<(?:link|meta)\b[^>]*>"), F.lit(0))
    canonical = F.transform(F.filter(tags, lambda t: t.rlike(r"""(?i)\srel\s*=\s*["']?canonical\b""")), lambda t: F.regexp_extract(t, r"""(?i)\shref\s*=\s*["']?([^"'\s>]+)""", 1))
    refresh = F.transform(F.filter(tags, lambda t: t.rlike(r"""(?i)\shttp-equiv\s*=\s*["']?refresh\b""")), lambda t: F.regexp_extract(t, r"""(?i)url\s*=\s*["']?([^"'\s>]+)""", 1))
    return F.when(html.rlike("(?i)canonical|refresh"), F.concat(canonical, refresh))


def rules_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rules, "action string, rule_host string, rule_path string")


def _best_rule(nodes: DataFrame, rules: DataFrame) -> DataFrame:
    """(node, rule, action): the longest rule that fits; of equally long ones the smallest, allow first.

    A host is exploded into its suffixes, so the join is on equal hosts whatever the number of rules.
    """
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    hosts = nodes.select("node", "path", F.explode(suffixes).alias("rule_host"))
    rules = rules.where(F.col("rule_host").isNotNull() & F.col("rule_path").isNotNull() & F.col("action").isin("allow", "block")).distinct()
    fits = hosts.join(rules, "rule_host").where(F.col("path").startswith(F.col("rule_path")))
    rule = F.concat("rule_host", "rule_path")
    best = fits.groupBy("node").agg(F.min(F.struct((-F.length(rule)).alias("rank"), rule.alias("rule"), "action")).alias("best"))
    return best.select("node", "best.rule", "best.action")


def judge(pages: DataFrame, rules: DataFrame, redirects: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str | None = "html") -> DataFrame:
    """(id, host, path, rule, verdict) for every row of `pages`.

    `rules` has (action, rule_host, rule_path); a rule fits a host and its subdomains where the
    path starts with the rule's. `redirects` may add (source, target) pairs of urls. A null url,
    or one without ://, has an empty host and path, fits no rule, has no aliases and is allowed.
    Repeated rows are judged alike; null ids are kept; rows of `rules` with nulls or an unknown
    action are ignored; other columns are ignored; empty tables give empty results.
    """
    url = F.col(url_col).cast("string")
    links = F.coalesce(_page_links(F.col(html_col)) if html_col else F.lit(None), F.array().cast("array<string>"))
    cut = pages.select(F.col(id_col).alias(id_col), host_of(url).alias("host"), path_of(url).alias("path"), url.alias("url"), links.alias("links"))
    cut = written(cut.withColumn("node", _node(F.col("host"), F.col("path"))), "urls")
    target = F.col("target")
    full = F.when(target.contains("://"), target).when(target.startswith("//"), F.concat(F.lit("http:"), target)).when(target.startswith("/"), F.concat(F.lit("http://"), F.col("host"), target))
    stated = cut.where(F.size("links") > 0).select("node", "host", F.explode("links").alias("target")).select("node", full.alias("target"))
    if redirects is not None:
        source = F.col("source").cast("string")
        stated = stated.unionByName(redirects.select(_node(host_of(source), path_of(source)).alias("node"), F.col("target").cast("string").alias("target")))
    stated = stated.where(F.col("target").contains("://")).select("node", host_of(F.col("target")).alias("host"), path_of(F.col("target")).alias("path"))
    stated = stated.withColumn("alias", _node(F.col("host"), F.col("path")))
    known = cut.select("node", "host", "path").unionByName(stated.select(F.col("alias").alias("node"), "host", "path"))
    if redirects is not None:
        known = known.unionByName(stated.select("node", F.split("node", "\n")[0].alias("host"), F.substring_index("node", "\n", -1).alias("path")))
    nodes = written(known.where("host <> ''").distinct(), "url-nodes")
    edges = stated.select(F.col("node").alias("a"), F.col("alias").alias("b")).unionByName(nodes.select(F.col("node").alias("a"), _served(F.col("host"), F.col("path")).alias("b")))
    edges = edges.where(~F.col("a").startswith("\n") & ~F.col("b").startswith("\n"))
    ruled = written(_best_rule(nodes, rules), "url-rules")
    roots = connected_components(edges, "url-aliases")
    members = nodes.select("node").join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root")).join(ruled, "node", "left")
    decided = members.groupBy("root").agg(F.coalesce(F.bool_or(F.col("action") == "allow"), F.lit(False)).alias("allowed"), F.coalesce(F.bool_or(F.col("action") == "block"), F.lit(False)).alias("blocked"))
    passed_on = F.when(F.col("blocked") & ~F.col("allowed"), "block").otherwise("allow")
    judged = members.join(decided, "root").select("node", "rule", F.coalesce("action", passed_on).alias("verdict"))
    return cut.join(judged, "node", "left").select(id_col, "host", "path", "rule", F.coalesce("verdict", F.lit("allow")).alias("verdict"))


def op1_url_equivalence(spark, sf_dir: str) -> DataFrame:
    """Every page's address, rule and verdict."""
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), rules_table(spark, RULES))


_RULE_SQL = ", ".join(f"('{a}', '{h}', '{p}')" for a, h, p in RULES)
#: Servers' own redirects only: the given pages state no canonical links and no refreshes.
OP1_SQL = rf"""
WITH cut AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), '{_UPPER}', '{_LOWER}') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
rules(action, rule_host, rule_path) AS (VALUES {_RULE_SQL}),
nodes AS (
  SELECT DISTINCT host, path, regexp_replace(host, '^(www|m)\.', '') || chr(10) || CASE WHEN short = '' AND path <> '' THEN '/' ELSE short END AS page
  FROM (SELECT *, CASE WHEN length(bare) > 1 AND bare LIKE '%/' THEN left(bare, length(bare) - 1) ELSE bare END AS short
        FROM (SELECT *, regexp_replace(path, '(/index\.html?|\.html?)$', '') AS bare FROM cut)) WHERE host <> ''),
fits AS (
  SELECT host, path, rule_host || rule_path AS rule, action,
         row_number() OVER (PARTITION BY host, path ORDER BY length(rule_host || rule_path) DESC, rule_host || rule_path, action) AS place
  FROM nodes JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)),
ruled AS (SELECT nodes.*, rule, action FROM nodes LEFT JOIN (SELECT * FROM fits WHERE place = 1) f USING (host, path)),
decided AS (SELECT page, coalesce(bool_or(action = 'allow'), false) AS allowed, coalesce(bool_or(action = 'block'), false) AS blocked FROM ruled GROUP BY page)
SELECT page_id, cut.host, cut.path, rule, coalesce(action, CASE WHEN blocked AND NOT allowed THEN 'block' END, 'allow') AS verdict
FROM cut LEFT JOIN ruled USING (host, path) LEFT JOIN decided USING (page)
"""
