"""URL filters with redirect equivalence, by DataFrame functions alone.

A url is judged by the longest rule that fits its host (or a parent domain) and path.
Where no rule fits, the url's aliases decide: pages and the targets of their redirects
(meta refresh) and canonical links are nodes, and connected components over those edges
are one resource.  A block of any member spreads to the members without a rule; an explicit
allow is kept by its own page and never overruled by a spread block.

Links are resolved against their page's url as browsers do: relative paths, dot segments, queries,
network paths, and ``&amp;`` in attributes.  Two urls are one node where they differ in the
fragment or in the case of scheme and host only.  A page or target that thousands of
pages name is a hub of the graph; joins take hubs by a bounded broadcast (``support.hot_join``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadmill.llm import support

#: Fixed values: (host, path prefix, verdict).
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
DEFAULT = "allow"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) after the first '://' up to '/', '?' or '#', and path up to '?' or '#'; both '' without '://' or for null."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^[^/?#]*", 0)
    host = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return host, path


def best_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls.

    Longest: by the rule's host, then by its path; a block wins between equals.
    """
    rule = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0]), len(r[1]), r[2] == "block")):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


#: The value of an attribute in a tag: in quotes of either kind, or bare.
_VALUE = r"""(?is)\b{}\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""
_ALIAS_TAG = r"(?is)rel\s*=[^>]*canonical|http-equiv\s*=[^>]*refresh"
_AMPERSAND = "(?i)&(amp|#38|#x26);"


def _attribute(tag: str, name: str) -> Column:
    """The trimmed value of a tag's attribute, '' where it is missing."""
    raw = F.regexp_extract(tag, _VALUE.format(name), 1)
    return F.trim(F.regexp_replace(F.regexp_replace(raw, r"""^["']|["']$""", ""), _AMPERSAND, "&"))


def without_dots(path: Column) -> Column:
    """A path that begins with '/' without '.' and '..' segments; '..' above the root is the root."""
    parts = F.split(path, "/")  # the first is empty
    last = F.element_at(parts, -1)
    step = lambda kept, p: F.when(p == "..", F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(1)))).when(p == ".", kept).otherwise(F.concat(kept, F.array(p)))
    kept = F.aggregate(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), F.array(F.lit("")), step)
    folded = F.concat(F.array_join(kept, "/"), F.when(last.isin(".", "..") | (F.size(kept) == 1), "/").otherwise(""))
    return F.when(path.rlike(r"(^|/)\.\.?(/|$)"), folded).otherwise(path)


def resolved(base: str, to: str) -> Column:
    """The target ``to`` as a url, seen from the page ``base``; null for other schemes, for '', and for a relative target of a base without '://'."""
    base, to = F.col(base), F.col(to)
    scheme = F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.\-]*:", 0)
    root = F.regexp_extract(base, r"(?s)^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*", 0)
    path = F.regexp_extract(base, r"(?s)^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)
    own_path, rest = F.regexp_extract(to, r"(?s)^[^?#]*", 0), F.regexp_extract(to, r"(?s)^[^?#]*(.*)", 1)
    folder = F.when(path == "", "/").otherwise(F.regexp_extract(path, r"(?s)^.*/", 0))
    return (
        F.when(to == "", None)
        .when(to.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://"), to)
        .when(to.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), None)
        .when(root == "", None)
        .when(to.startswith("//"), F.concat(scheme, to))
        .when(to.startswith("#"), F.concat(F.regexp_extract(base, "(?s)^[^#]*", 0), to))
        .when(to.startswith("?"), F.concat(root, path, to))
        .when(to.startswith("/"), F.concat(root, without_dots(own_path), rest))
        .otherwise(F.concat(root, without_dots(F.concat(folder, own_path)), rest))
    )


def node_of(url: Column) -> Column:
    """What names a url's node: the url without its fragment, its scheme and host lower-cased (A-Z)."""
    front = F.regexp_extract(url, r"(?s)^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*", 0)
    low = F.translate(front, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    whole = F.regexp_extract(url, r"(?s)^[^#]*", 0)
    return F.concat(low, F.substring(whole, F.length(front) + 1, F.length(whole)))


def alias_edges(pages: DataFrame) -> DataFrame:
    """(u, v): the nodes of a page's url and of the url that its html names as canonical or redirects to."""
    tags = F.regexp_extract_all("html", F.lit(r"(?is)(<(?:link|meta)\b[^>]*>)"), 1)
    tag = pages.where("url is not null and html is not null").where(F.col("html").rlike(_ALIAS_TAG)).select("url", F.explode(tags).alias("tag"))
    names = F.split(F.lower(_attribute("tag", "rel")), r"\s+")
    canonical = F.when(F.col("tag").rlike(r"(?is)^<link\b") & F.array_contains(names, "canonical"), _attribute("tag", "href"))
    refresh = F.col("tag").rlike(r"(?is)^<meta\b") & (F.lower(_attribute("tag", "http-equiv")) == "refresh")
    target = F.regexp_extract(_attribute("tag", "content"), r"(?is)\burl\s*=\s*(.*)$", 1)
    redirect = F.when(refresh, F.trim(F.regexp_replace(target, r"""^["']|["'].*$""", "")))
    links = tag.select("url", F.coalesce(canonical, redirect).alias("to"))
    found = links.select(node_of(F.col("url")).alias("u"), node_of(resolved("url", "to")).alias("v"))
    return found.where("v is not null and v <> ''")


def judge(pages: DataFrame, rules=RULES, default: str = DEFAULT) -> DataFrame:
    """page_id, host, path, rule, verdict of every row of ``pages`` (page_id, url, html); other columns are ignored.

    A null or malformed url has an empty host and path, fits no rule, has no aliases, and gets ``default``.
    A link to a url that no page has still connects the pages that name it, and its own rule counts for them.
    A url without '://' is a node by its whole text, and only absolute links lead from it.
    Urls that repeat are one node.  A very long url or html is read whole.  An empty table gives an empty result.
    """
    host, path = host_and_path(F.col("url"))
    parts = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    rule, verdict = best_rule(F.col("host"), F.col("path"), rules)
    ruled = parts.select("page_id", "url", "host", "path", rule.alias("rule"), verdict.alias("own"))
    edges = support.materialise(alias_edges(pages).where("u <> v").distinct(), "aliases")
    if edges.isEmpty():  # no page names an alias, so every component is one url
        return ruled.select("page_id", "host", "path", "rule", F.coalesce("own", F.lit(default)).alias("verdict"))
    comp = support.materialise(support.components(edges), "url-components")
    named = comp.withColumn("url", F.col("node"))
    h, p = host_and_path(F.col("url"))
    _, v = best_rule(h, p, rules)
    spread = named.select("node", "component", v.alias("own")).groupBy("component").agg(F.bool_or(F.col("own") == "block").alias("blocked"))
    blocked = support.hot_join(comp, spread.where("blocked"), "component", "inner").select("node", F.lit("block").alias("spread"))
    blocked = support.materialise(blocked, "blocked-urls")
    # only a page without a rule asks its aliases
    asks = support.materialise(ruled.withColumn("node", F.when(F.col("own").isNull(), node_of(F.col("url")))).drop("url"), "ruled-pages")
    return support.hot_join(asks, blocked, "node").select("page_id", "host", "path", "rule", F.coalesce("own", "spread", F.lit(default)).alias("verdict"))


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule and verdict of every page."""
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def _oracle() -> str:
    fits = lambda h, p: f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
    rules = sorted(RULES, key=lambda r: (-len(r[0]), -len(r[1]), r[2] != "block"))
    rule = " ".join(f"WHEN {fits(h, p)} THEN '{h + p}'" for h, p, _ in rules)
    own = lambda: " ".join(f"WHEN {fits(h, p)} THEN '{v}'" for h, p, v in rules)
    parts = r"""
  CASE WHEN contains(coalesce(url, ''), '://') THEN translate(regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*', 0, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
  CASE WHEN contains(coalesce(url, ''), '://') THEN regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*([^?#]*)', 1, 's') ELSE '' END AS path"""
    value = lambda name: rf"""replace(replace(replace(trim(regexp_replace(regexp_extract(tag, '(?is)\b{name}\s*=\s*("[^"]*"|''[^'']*''|[^\s"''>]+)', 1), '^["'']|["'']$', '', 'g')), '&amp;', '&'), '&#38;', '&'), '&#x26;', '&')"""
    node = lambda u: rf"""(translate(regexp_extract({u}, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*', 0, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || substr(regexp_extract({u}, '^[^#]*', 0, 's'), length(regexp_extract({u}, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*', 0, 's')) + 1))"""
    # dot segments fold by repeating one replacement as often as a path has segments
    return rf"""
WITH RECURSIVE tags AS (
  SELECT url, unnest(regexp_extract_all(html, '(?is)(<(?:link|meta)\b[^>]*>)', 1)) AS tag FROM pages WHERE url IS NOT NULL AND html IS NOT NULL),
links AS (
  SELECT url, CASE WHEN regexp_matches(tag, '(?is)^<link\b') AND list_contains(regexp_split_to_array(lower({value('rel')}), '\s+'), 'canonical') THEN {value('href')}
                   WHEN regexp_matches(tag, '(?is)^<meta\b') AND lower({value('http-equiv')}) = 'refresh'
                   THEN trim(regexp_replace(regexp_extract({value('content')}, '(?is)\burl\s*=\s*(.*)$', 1), '^["'']|["''].*$', '', 'g')) END AS x FROM tags),
bases AS (
  SELECT DISTINCT url, x, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*:', 0) AS scheme, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*', 0, 's') AS root,
         regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)', 1, 's') AS path, regexp_extract(x, '^[^?#]*', 0, 's') AS own, regexp_extract(x, '^[^?#]*(.*)', 1, 's') AS rest
  FROM links WHERE x <> ''),
cases AS (
  SELECT *, CASE WHEN regexp_matches(x, '^[A-Za-z][A-Za-z0-9+.\-]*:') OR root = '' OR starts_with(x, '//') OR starts_with(x, '#') OR starts_with(x, '?') THEN NULL
                 WHEN starts_with(x, '/') THEN own WHEN path = '' THEN '/' || own ELSE regexp_extract(path, '^.*/', 0, 's') || own END AS full_path FROM bases),
folding AS (
  SELECT url, x, full_path, string_split(full_path, '/')[2:] AS todo, CAST([] AS VARCHAR[]) AS kept FROM cases WHERE full_path IS NOT NULL
  UNION ALL
  SELECT url, x, full_path, todo[2:], CASE todo[1] WHEN '..' THEN kept[:len(kept) - 1] WHEN '.' THEN kept ELSE list_append(kept, todo[1]) END FROM folding WHERE len(todo) > 0),
folded AS (
  SELECT url, x, CASE WHEN regexp_matches(full_path, '(^|/)\.\.?(/|$)')
                      THEN '/' || array_to_string(kept, '/') || CASE WHEN len(kept) > 0 AND string_split(full_path, '/')[-1] IN ('.', '..') THEN '/' ELSE '' END ELSE full_path END AS p
  FROM folding WHERE len(todo) = 0),
targets AS (
  SELECT c.url, CASE WHEN regexp_matches(c.x, '^[A-Za-z][A-Za-z0-9+.\-]*://') THEN c.x WHEN regexp_matches(c.x, '^[A-Za-z][A-Za-z0-9+.\-]*:') OR root = '' THEN NULL
                     WHEN starts_with(c.x, '//') THEN scheme || c.x WHEN starts_with(c.x, '#') THEN regexp_extract(c.url, '^[^#]*', 0, 's') || c.x WHEN starts_with(c.x, '?') THEN root || path || c.x ELSE root || p || rest END AS target
  FROM cases c LEFT JOIN folded f ON c.url = f.url AND c.x = f.x),
absolute AS (SELECT {node('url')} AS u, {node('target')} AS v FROM targets WHERE target <> ''),
edges AS (SELECT u, v FROM absolute WHERE v <> '' AND u <> v UNION SELECT v, u FROM absolute WHERE v <> '' AND u <> v),
reach AS (SELECT u AS a, u AS b FROM edges UNION SELECT r.a, e.v FROM reach r JOIN edges e ON r.b = e.u),
urls AS (SELECT DISTINCT b AS url FROM reach),
url_parts AS (SELECT url, {parts} FROM urls),
url_own AS (SELECT url, CASE {own()} END AS own FROM url_parts),
spread AS (SELECT DISTINCT r.a AS url FROM reach r JOIN url_own o ON r.b = o.url WHERE o.own = 'block'),
page_parts AS (SELECT page_id, url, {parts} FROM pages),
page_own AS (SELECT *, CASE {rule} END AS rule, CASE {own()} END AS own FROM page_parts)
SELECT p.page_id, p.host, p.path, p.rule, coalesce(p.own, CASE WHEN s.url IS NOT NULL THEN 'block' END, '{DEFAULT}') AS verdict
FROM page_own p LEFT JOIN spread s ON {node('p.url')} = s.url
"""


ORACLE = _oracle()
