"""URL filter by redirect equivalence.

Rules decide single addresses; addresses that redirect to one another, or that name one another as canonical,
are one resource, so a block on one of them reaches its aliases.  An explicit rule of an address always wins
over what its aliases pass on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import connected_components, lower_ascii, stored

#: Query parameters that only track visits; pages answer the same without them.
TRACKING = "(?:utm_[a-z]+|ref|fbclid|gclid)"


def host_path(df: DataFrame, url: str = "url") -> DataFrame:
    """Add ``host`` and ``path``; both are empty for a null url or one without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)")).otherwise(F.lit(""))
    return df.withColumn("host", lower_ascii(F.regexp_extract(rest, "^([^/?#]*)", 1))).withColumn("path", F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1))


def _without_dots(path: Column) -> Column:
    """A path with its ``.`` and ``..`` segments taken; empty becomes ``/``."""
    segments = F.slice(F.split(path, "/"), F.lit(2), F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    up = lambda acc: F.regexp_replace(acc, "/[^/]*$", "")
    folded = F.aggregate(segments, F.lit(""), lambda acc, s: F.when(s == ".", acc).when(s == "..", up(acc)).otherwise(F.concat(acc, F.lit("/"), s)))
    closed = F.when(path.rlike(r"/\.\.?$"), F.concat(folded, F.lit("/"))).otherwise(folded)
    return F.when(path == "", "/").when(path.contains("/."), closed).otherwise(path)


def address(url: Column) -> Column:
    """An absolute address in one spelling: scheme and host lower-cased, no default port, no dot segments, no fragment;
    null for what has no ``://``."""
    rest = F.regexp_extract(url, r"^[^:/?#]+://(.*)$", 1)
    scheme = lower_ascii(F.regexp_extract(url, "^([^:/?#]+)://", 1))
    host = lower_ascii(F.regexp_extract(rest, "^([^/?#]*)", 1))
    port = F.when(scheme == "https", ":(?:443)?$").otherwise(":(?:80)?$")
    tail = F.concat(_without_dots(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)), F.regexp_extract(rest, r"^[^?#]*(\?[^#]*)", 1))
    return F.when((scheme != "") & (host != ""), F.concat(scheme, F.lit("://"), F.regexp_replace(host, port, F.lit("")), tail))


def absolute(url: Column, target: Column) -> Column:
    """The address that a link target names on the page of this url; null for other schemes than those with ``://``."""
    to = F.regexp_replace(F.trim(target), "(?i)&(?:amp|#38|#x26);", "&")
    origin, path = F.regexp_extract(url, "^([^:/?#]+://[^/?#]*)", 1), F.regexp_extract(url, "^[^:/?#]+://[^/?#]*([^?#]*)", 1)
    folder = F.coalesce(F.nullif(F.regexp_extract(path, "^(.*/)", 1), F.lit("")), F.lit("/"))
    return (
        F.when(to.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), to)
        .when(to.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None))
        .when(to.startswith("//"), F.concat(F.substring_index(url, "://", 1), F.lit(":"), to))
        .when(to.startswith("/"), F.concat(origin, to))
        .when((to == "") | to.startswith("#"), url)
        .when(to.startswith("?"), F.concat(origin, path, to))
        .otherwise(F.concat(origin, folder, to))
    )


def resource_key(url: Column, usual: bool = False) -> Column:
    """The node of an address.  With ``usual`` the permanent redirects that sites usually have are taken as done, though
    nobody declares them: scheme, ``www.``/``m.`` host prefix, closing slash, ``.html`` and tracking parameters go too."""
    key = address(url)
    if not usual:
        return key
    host, path = F.regexp_extract(key, "^[^:]+://([^/?]*)", 1), F.regexp_extract(key, r"^[^:]+://[^/?]*([^?]*)", 1)
    kept = F.array_join(F.filter(F.split(F.regexp_extract(key, r"\?(.*)$", 1), "&"), lambda q: (q != "") & ~q.rlike(f"^{TRACKING}(=|$)")), "&")
    bare = F.concat(F.regexp_replace(host, r"^(?:www|m)\.", ""), F.regexp_replace(F.regexp_replace(path, r"\.html?$", ""), "/+$", ""))
    return F.when(key.isNotNull(), F.concat(bare, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise("")))


def link_targets(html: Column) -> Column:
    """Targets of canonical links and of refresh redirects in a page's markup."""
    links = F.filter(F.regexp_extract_all(html, F.lit(r"(?i)<link\b[^>]*>"), F.lit(0)), lambda t: t.rlike(r"(?i)\brel\s*=\s*[\"']?canonical\b"))
    metas = F.filter(F.regexp_extract_all(html, F.lit(r"(?i)<meta\b[^>]*>"), F.lit(0)), lambda t: t.rlike(r"(?i)http-equiv\s*=\s*[\"']?refresh\b"))
    hrefs = F.transform(links, lambda t: F.regexp_extract(t, r"(?i)\bhref\s*=\s*[\"']?([^\"'\s>]+)", 1))
    moves = F.transform(metas, lambda t: F.regexp_extract(t, r"(?i)\burl\s*=\s*[\"']?([^\"'\s>]+)", 1))
    return F.filter(F.concat(hrefs, moves), lambda u: u != "")


def apply_rules(urls: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """``urls(url, host, path, ...)`` with ``rule`` and ``rule_verdict`` of the longest rule that fits.

    A rule ``(verdict, host, path)`` fits its host and all subdomains if the path starts with the rule's; of two
    equally long ones the lesser string wins.  The rules are joined on host suffixes, so their number hardly matters.
    """
    spark = urls.sparkSession
    table = spark.createDataFrame([(h, p, h + p, v) for v, h, p in rules], "rule_host string, rule_path string, rule string, rule_verdict string")
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fits = urls.select("url", "path", F.explode(F.array_distinct(suffixes)).alias("rule_host")).join(F.broadcast(table) if len(rules) <= 100_000 else table, "rule_host").where(F.expr("startswith(path, rule_path)"))
    best = fits.groupBy("url").agg(F.min_by(F.struct("rule", "rule_verdict"), F.struct(-F.length("rule"), "rule")).alias("best"))
    return urls.join(best, "url", "left").select(urls["*"], F.col("best.rule").alias("rule"), F.col("best.rule_verdict").alias("rule_verdict"))


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]], redirects: DataFrame | None = None, usual: bool = False) -> DataFrame:
    """Verdicts for ``pages(page_id, url, html)``; optional ``redirects(src, dst)`` of observed HTTP redirects.

    -> ``page_id, host, path, rule, verdict, alias_group``.  Verdict: the rule's; without a rule, ``block`` if any
    alias is blocked by a rule, else ``allow``.  alias_group is the least key of the alias group (null without host).
    Aliases are spellings of one address (see ``address``) and what redirects and canonical links join, relative targets
    included; ``usual`` adds the edges that ``resource_key`` describes.  Null or malformed urls have empty host and path,
    no rule and no aliases, and are allowed.  Null html has no links.  Of rules of one length the lesser string wins.
    Repeated pages each get their row.  Empty pages give an empty result; other columns of pages are not looked at.
    """
    pages = host_path(pages.select("page_id", F.col("url").alias("url"), "html"))
    found = pages.where("host <> ''").select("url", F.explode(F.array_distinct(link_targets(F.coalesce("html", F.lit(""))))).alias("to"))
    links = found.select(F.col("url").alias("src"), absolute(F.col("url"), F.col("to")).alias("dst"))
    if redirects is not None:
        links = links.union(redirects.select("src", "dst"))
    links = stored(links.where("src is not null and dst is not null").distinct())  # the markup is read once
    urls = pages.where("host <> ''").select("url").union(links.select("src")).union(links.select("dst")).distinct()
    ruled = apply_rules(host_path(urls), rules).withColumn("key", resource_key(F.col("url"), usual))
    edges = links.select(resource_key(F.col("src"), usual).alias("src"), resource_key(F.col("dst"), usual).alias("dst"))
    groups = connected_components(edges)
    ruled = ruled.join(groups.withColumnRenamed("node", "key"), "key", "left").withColumn("alias_group", F.coalesce("component", "key"))
    blocked = ruled.groupBy("alias_group").agg(F.bool_or(F.col("rule_verdict").eqNullSafe("block")).alias("any_blocked"))
    decided = ruled.select("url", "rule", "rule_verdict", "alias_group").join(blocked, "alias_group", "left")
    verdict = F.coalesce("rule_verdict", F.when(F.coalesce("any_blocked", F.lit(False)), "block").otherwise("allow"))
    return pages.join(decided, "url", "left").select("page_id", "host", "path", "rule", verdict.alias("verdict"), "alias_group")


def oracle_sql(rules: list[tuple[str, str, str]]) -> str:
    """DuckDB SQL with the rows of ``judge_urls`` over ``pages`` for these rules."""
    values = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in rules)
    low = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    host = low.format("regexp_extract(rest, '^([^/?#]*)', 1)")
    path = "regexp_extract(rest, '^[^/?#]*([^?#]*)', 1)"
    rest = "CASE WHEN contains(url, '://') THEN substr(url, position('://' IN url) + 3) ELSE '' END"
    return rf"""
WITH RECURSIVE rules(verdict, rh, rp) AS (VALUES {values}),
pg AS (SELECT page_id, url, html, {host} AS host FROM (SELECT *, {rest} AS rest FROM pages)),
tags AS (SELECT url, trim(regexp_replace(t, '(?i)&(?:amp|#38|#x26);', '&', 'g')) AS t FROM (SELECT url, unnest(list_concat(
    list_transform(list_filter(regexp_extract_all(coalesce(html, ''), '(?i)<link\b[^>]*>'), lambda t: regexp_matches(t, '(?i)\brel\s*=\s*["'']?canonical\b')), lambda t: regexp_extract(t, '(?i)\bhref\s*=\s*["'']?([^"''\s>]+)', 1)),
    list_transform(list_filter(regexp_extract_all(coalesce(html, ''), '(?i)<meta\b[^>]*>'), lambda t: regexp_matches(t, '(?i)http-equiv\s*=\s*["'']?refresh\b')), lambda t: regexp_extract(t, '(?i)\burl\s*=\s*["'']?([^"''\s>]+)', 1)))) AS t FROM pg WHERE host <> '') WHERE t <> ''),
bases AS (SELECT url, t, regexp_extract(url, '^([^:/?#]+://[^/?#]*)', 1) AS origin, regexp_extract(url, '^[^:/?#]+://[^/?#]*([^?#]*)', 1) AS p FROM tags),
links AS (SELECT DISTINCT url AS src, CASE WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN t WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL
    WHEN t[:2] = '//' THEN split_part(url, '://', 1) || ':' || t WHEN t[:1] = '/' THEN origin || t WHEN t = '' OR t[:1] = '#' THEN url WHEN t[:1] = '?' THEN origin || p || t
    ELSE origin || coalesce(nullif(regexp_extract(p, '^(.*/)', 1), ''), '/') || t END AS dst FROM bases),
urls AS (SELECT url FROM pg WHERE host <> '' UNION SELECT src FROM links WHERE dst IS NOT NULL UNION SELECT dst FROM links WHERE dst IS NOT NULL),
parts AS (SELECT url, {host} AS host, {path} AS path FROM (SELECT url, {rest} AS rest FROM urls)),
spelled AS (SELECT *, {low.format("regexp_extract(url, '^([^:/?#]+)://', 1)")} AS scheme, {low.format("regexp_extract(r, '^([^/?#]*)', 1)")} AS h, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS p, regexp_extract(r, '^[^?#]*(\?[^#]*)', 1) AS q
  FROM (SELECT *, regexp_extract(url, '^[^:/?#]+://(.*)$', 1) AS r FROM parts)),
folded AS (SELECT *, CASE WHEN p = '' THEN '/' WHEN contains(p, '/.') THEN
    list_reduce(string_split(p, '/')[2:], lambda acc, s: CASE WHEN s = '.' THEN acc WHEN s = '..' THEN regexp_replace(acc, '/[^/]*$', '') ELSE acc || '/' || s END, '') || CASE WHEN regexp_matches(p, '/\.\.?$') THEN '/' ELSE '' END ELSE p END AS tidy FROM spelled),
keyed AS (SELECT url, host, path, CASE WHEN scheme <> '' AND h <> '' THEN scheme || '://' || regexp_replace(h, CASE WHEN scheme = 'https' THEN ':(?:443)?$' ELSE ':(?:80)?$' END, '') || tidy || q END AS key FROM folded),
ruled AS (SELECT url, rh || rp AS rule, verdict, row_number() OVER (PARTITION BY url ORDER BY length(rh || rp) DESC, rh || rp) AS n FROM parts JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)),
named AS (SELECT k.url, k.key, r.rule, r.verdict FROM keyed k LEFT JOIN ruled r ON r.url = k.url AND n = 1),
edges AS (SELECT DISTINCT a.key AS a, b.key AS b FROM links JOIN keyed a ON a.url = src JOIN keyed b ON b.url = dst WHERE a.key <> b.key),
both_ways AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
reach(a, b) AS (SELECT DISTINCT key, key FROM named WHERE key IS NOT NULL UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON e.a = r.b),
groups AS (SELECT a AS key, min(b) AS g FROM reach GROUP BY a),
decided AS (SELECT url, rule, verdict, g, bool_or(coalesce(verdict = 'block', false)) OVER (PARTITION BY g) AS any_blocked FROM named LEFT JOIN groups USING (key))
SELECT page_id, x.host, x.path, d.rule, coalesce(d.verdict, CASE WHEN d.any_blocked THEN 'block' ELSE 'allow' END) AS verdict, d.g AS alias_group
FROM (SELECT page_id, url, {host} AS host, {path} AS path FROM (SELECT page_id, url, {rest} AS rest FROM pages)) x LEFT JOIN decided d ON d.url = x.url
"""
