"""URL filters: longest-prefix rules, then redirect equivalence.

Every url has a host and a path.  A rule fits its host and all subdomains when the path
starts with the rule's; the longest rule wins.  Rules are a short parameter and become
one expression, so no join is needed.

Pages without a rule take a verdict from their aliases.  A page's ``<link rel=canonical>``
and ``<meta http-equiv=refresh>`` targets, and any redirect table given, are edges between
urls (resolved against the page, fragments dropped, host in lower case); connected components of those edges are
aliases of one page.  A component with a blocked member blocks its members that have no
rule of their own; an allow rule on the page itself takes precedence; where no member is
blocked the verdict is allow.

Only urls with edges enter the component search; the others need no shuffle for it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .components import connected_components

RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...] = RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its action; null where none fits."""
    rule = action = F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, action = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(action)
    return rule, action


def normal_url(url: Column) -> Column:
    """The url without fragment and with host and scheme in lower case."""
    plain = F.regexp_replace(F.trim(url), r"#(?s:.*)$", "")
    start = F.regexp_extract(plain, r"(?s)^([^/?#]*://[^/?#]*)", 1)
    return F.concat(F.translate(start, _UPPER, _LOWER), F.substr(plain, F.length(start) + 1))


def resolved(to: Column, base: Column) -> Column:
    """The url that ``to`` means on a page at ``base``; null for other schemes and unusable bases."""
    scheme, origin = F.regexp_extract(base, r"(?s)^([^/?#:]+:)//", 1), F.regexp_extract(base, r"(?s)^([^/?#:]+://[^/?#]*)", 1)
    rest = F.regexp_extract(to, r"(?s)^[^?#]*(.*)$", 1)
    path = F.regexp_extract(to, r"(?s)^([^?#]*)", 1)
    joined = F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), F.regexp_extract(path_of(base), r"(?s)^/(.*/)?", 1), path))
    parts = F.split(F.regexp_replace(joined, r"(^|/)(\.\.?)$", "$1$2/"), "/")
    step = lambda done, x: F.when(x == "..", F.slice(done, 1, F.greatest(F.lit(1), F.size(done) - 1))).when(x == ".", done).otherwise(F.concat(done, F.array(x)))
    clean = F.array_join(F.aggregate(F.slice(parts, 2, F.size(parts)), F.array(F.lit("")), step), "/")
    local = F.when(path == "", F.concat(origin, path_of(base), rest)).otherwise(F.concat(origin, clean, rest))
    return F.when(to.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), to).when(to.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None)).when(origin == "", F.lit(None)).when(to.startswith("//"), F.concat(scheme, to)).otherwise(local)


def page_edges(pages: DataFrame) -> DataFrame:
    """(a, b): a page's url and a url that it names as canonical or refreshes to, resolved against
    the page's ``<base href>``, if any, and its own url."""
    html = F.col("html")
    tags = F.regexp_extract_all(html, F.lit(r"(?i)(<(?:link|meta)\b[^>]*>)"), F.lit(1))
    hinted = F.lower(html).contains("canonical") | F.lower(html).contains("refresh")
    tag = F.col("tag")
    plain = lambda c: F.replace(c, F.lit("&amp;"), F.lit("&"))
    canonical = F.when(tag.rlike(r"""(?i)^<link\b[^>]*\brel\s*=\s*["']?canonical\b"""), F.regexp_extract(tag, r"""(?i)\bhref\s*=\s*["']?([^"'\s>]+)""", 1))
    refresh = F.when(tag.rlike(r"""(?i)^<meta\b[^>]*\bhttp-equiv\s*=\s*["']?refresh\b"""), F.regexp_extract(tag, r"""(?i)\burl\s*=\s*["']?([^"'\s>]+)""", 1))
    named = F.regexp_extract(html, r"""(?i)<base\b[^>]*\bhref\s*=\s*["']?([^"'\s>]+)""", 1)
    base = F.when(named == "", F.col("url")).otherwise(F.coalesce(resolved(plain(named), F.col("url")), F.col("url")))
    found = pages.where(F.col("url").isNotNull() & hinted).select("url", base.alias("base"), F.explode(tags).alias("tag")).select("url", "base", plain(F.coalesce(canonical, refresh)).alias("to"))
    return found.where("to <> ''").select(normal_url(F.col("url")).alias("a"), normal_url(resolved(F.col("to"), F.col("base"))).alias("b")).where("b is not null")


def judge(pages: DataFrame, redirects: DataFrame | None = None, rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    """page_id, host, path, rule and verdict of every page.

    Null urls and urls without ``://`` have an empty host and path, no rule and no alias, so
    they are allowed.  Null html names no alias.  Repeated rows are judged each; extra columns
    are not read; an empty table gives no rows.  ``redirects`` (from_url, to_url) adds edges.
    """
    url = F.col("url")
    rule, action = rule_of(F.col("host"), F.col("path"), rules)
    base = pages.select("page_id", url, host_of(url).alias("host"), path_of(url).alias("path")).withColumns({"rule": rule, "action": action})
    edges = page_edges(pages)
    if redirects is not None:
        edges = edges.union(redirects.select(normal_url(F.col("from_url")), normal_url(F.col("to_url"))).dropna())
    edges = edges.where("a <> b").distinct()
    members = connected_components(edges)
    if members is None:
        return base.select("page_id", "host", "path", "rule", F.coalesce("action", F.lit("allow")).alias("verdict"))
    member_rule = rule_of(host_of(F.col("node")), path_of(F.col("node")), rules)[1]
    blocked = members.withColumn("bad", (member_rule == "block").cast("int")).groupBy("component").agg(F.max("bad").alias("bad")).where("bad = 1")
    bad_urls = members.join(blocked, "component", "left_semi").select(F.col("node").alias("normal"))
    open_pages = base.where("action is null").withColumn("normal", normal_url(url)).join(bad_urls.withColumn("hit", F.lit("block")), "normal", "left")
    judged = open_pages.select("page_id", "host", "path", "rule", F.coalesce("hit", F.lit("allow")).alias("verdict"))
    return base.where("action is not null").select("page_id", "host", "path", "rule", F.col("action").alias("verdict")).unionByName(judged)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))


ORACLE = r"""
WITH RECURSIVE u AS (
  SELECT page_id, url, html, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages
), j AS (
  SELECT *, CASE
    WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/') THEN 'com/' END AS rule FROM u
), n AS (
  SELECT page_id, host, path, rule, regexp_replace(trim(url), '#(?s:.*)$', '') AS node,
    regexp_extract_all(html, '(?i)<(?:link|meta)\b[^>]*>') AS tags FROM j
), t AS (SELECT node, unnest(tags) AS tag FROM n WHERE node IS NOT NULL
), e0 AS (
  SELECT node AS a, CASE WHEN regexp_matches(tag, '(?i)^<link\b[^>]*\brel\s*=\s*["'']?canonical\b') THEN regexp_extract(tag, '(?i)\bhref\s*=\s*["'']?([^"''\s>]+)', 1)
    WHEN regexp_matches(tag, '(?i)^<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b') THEN regexp_extract(tag, '(?i)\burl\s*=\s*["'']?([^"''\s>]+)', 1) END AS b FROM t
), e AS (SELECT a, regexp_replace(replace(b, '&amp;', '&'), '#(?s:.*)$', '') AS b FROM e0 WHERE contains(b, '://')
), two AS (SELECT a, b FROM e UNION SELECT b, a FROM e
), reach AS (SELECT a AS x, a AS y FROM two UNION SELECT r.x, two.b FROM reach r JOIN two ON r.y = two.a
), bad AS (
  SELECT DISTINCT x FROM reach WHERE regexp_matches(y, '(?i)://([^/?#]*\.)?net/(es|fr)/') OR (regexp_matches(y, '(?i)://([^/?#]*\.)?example\.com/en/') AND NOT regexp_matches(y, '(?i)://([^/?#]*\.)?www\.example\.com/en/'))
)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN bad.x IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict
FROM n LEFT JOIN bad ON n.node = bad.x
"""
