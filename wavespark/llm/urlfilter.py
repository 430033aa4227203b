"""URL rules whose block decisions reach aliases, over connected components of redirect and canonical-link edges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import UPPER, checkpoint, components, table

#: The rules of the query: host, start of the path, verdict.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: Query parameters that name a visit and not a page.
TRACKING = ("utm_[a-z]+", "gclid", "fbclid", "ref", "source", "sessionid")
#: Host labels under which sites serve a page again.
MIRRORS = ("www", "m", "mobile", "amp")

def _lower(c: Column) -> Column:
    return F.translate(c, UPPER, UPPER.lower())


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null and where there is no ://."""
    return F.coalesce(_lower(F.regexp_extract(_after_scheme(url), r"^([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end; empty for null and where there is no ://."""
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """The address that the usual redirects of a site lead to: https, no mirror label, no fragment, no tracking
    parameters, no index page, .html ending or slash at the end. Null where there is no host."""
    host = F.regexp_replace(host_of(url), rf"^(?:{'|'.join(MIRRORS)})\.(?=[^.]+\.)", "")
    path = F.regexp_replace(path_of(url), r"(?:/index)?\.(?:html?|php)$|/index$", "")
    path = F.regexp_replace(path, r"/+$", "")
    query = F.regexp_extract(_after_scheme(url), r"^[^?#]*\?([^#]*)", 1)
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(rf"^(?:{'|'.join(TRACKING)})(?:=|$)"))
    query = F.array_join(F.array_sort(kept), "&")
    return F.when(host != "", F.concat(F.lit("https://"), host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def plain(url: Column) -> Column:
    """The address without what never changes a page: scheme and host in lower case, no fragment, a slash for an empty path.
    Null where there is no host."""
    host, path = host_of(url), path_of(url)
    query = F.regexp_extract(_after_scheme(url), r"^[^?#]*(\?[^#]+)", 1)
    scheme = _lower(F.substring_index(url, "://", 1))
    return F.when(host != "", F.concat(scheme, F.lit("://"), host, F.when(path != "", path).otherwise("/"), query))


def _without_dots(path: Column) -> Column:
    """A path whose . and .. segments are carried out."""
    step = lambda done, s: F.when(s == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(1)))).when(s == ".", done).otherwise(F.concat(done, F.array(s)))
    kept = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step)
    return F.when(path.contains("/."), F.array_join(kept, "/")).otherwise(path)


def resolved(url: Column, link: Column) -> Column:
    """The address that a link on the page url names: absolute ones as they are, others against the page's scheme, host and
    folder. Null for empty links, mere fragments and other schemes (mailto: and the like)."""
    base = F.regexp_extract(url, r"^([^:/?#]+://[^/?#]*)", 1)
    folder = F.when(path_of(url) == "", "/").otherwise(F.regexp_extract(path_of(url), r"^(.*/)", 1))
    inner = F.when(link.startswith("/"), link).when(link.startswith("?"), F.concat(path_of(url), link)).otherwise(F.concat(folder, link))
    path = F.regexp_extract(inner, r"^([^?#]*)", 1)
    rest = F.regexp_extract(inner, r"^[^?#]*(.*)$", 1)
    return (
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), link).when(link.startswith("//"), F.concat(F.substring_index(url, "://", 1), F.lit(":"), link))
        .when((link == "") | link.startswith("#") | link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), None)
        .when(base != "", F.concat(base, _without_dots(path), rest))
    )


#: Where a page states an address of its own: canonical links, og:url and meta refreshes.
STATED = (
    r"(?is)<link\b(?=[^>]*\brel\s*=\s*[\"']?canonical\b)[^>]*?\bhref\s*=\s*[\"']?([^\"'\s>]+)",
    r"(?is)<meta\b(?=[^>]*\bproperty\s*=\s*[\"']?og:url\b)[^>]*?\bcontent\s*=\s*[\"']?([^\"'\s>]+)",
    r"(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b)[^>]*?\bcontent\s*=\s*[\"']?\s*[0-9.]*\s*[;,]\s*url\s*=\s*[\"']?([^\"'\s>]+)",
)


def page_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html", redirects: DataFrame | None = None, guesses: bool = False) -> DataFrame:
    """Edges (src, dst) between addresses that a page itself states: every canonical link, og:url and meta refresh, resolved
    against the page's address, and the plain form of its own address; with redirects, a table (src, dst) of observed ones,
    theirs too.

    guesses adds the address that the usual redirects of a site lead to (see canonical). That may take two pages for one, and
    pass a block from one to the other, so it is off.

    Defined results: a null url gives no edge, null html only the address's own; urls and html of any length are read
    whole; repeated rows give repeated edges, an empty table none; other columns are ignored. Redirects without one of their
    ends are left out."""
    url, html = F.col(url_col), F.coalesce(F.col(html_col), F.lit(""))
    links = F.flatten(F.array(*[F.regexp_extract_all(html, F.lit(pattern), F.lit(1)) for pattern in STATED]))
    stated = F.transform(links, lambda t: plain(resolved(url, F.replace(t, F.lit("&amp;"), F.lit("&")))))
    targets = F.concat(F.array(plain(url)), stated)
    if guesses:
        targets = F.concat(targets, F.array(canonical(url)), F.transform(stated, canonical))
    edges = pages.select(url.alias("src"), F.explode(F.array_compact(targets)).alias("dst")).where("src IS NOT NULL AND src <> dst")
    if redirects is not None:
        moved = redirects.where("src IS NOT NULL AND dst IS NOT NULL").select("src", "dst")
        edges = edges.unionAll(moved).unionAll(moved.select("src", plain(F.col("src")).alias("dst"))).unionAll(moved.select(F.col("dst").alias("src"), plain(F.col("dst")).alias("dst")))
        edges = edges.where("dst IS NOT NULL AND src <> dst")
    return edges


def _fit(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """The rule that fits best, as a struct of rule and verdict; null if none does. Longest host and path together win,
    of equals an allow, then the first in code-point order."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for name, start, verdict in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r[2] == "allow", [-ord(c) for c in r[0] + r[1]])):
        name = name.lower()
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        found = F.when(fits, F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]], edges: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Judges every page's url by the rules, and urls without a rule by those of their aliases.

    edges: (src, dst), redirects and canonical links between urls, which needn't be among pages. Urls are aliases if edges
    lead from one to the other in any direction, over any number of steps. A url's own rule decides it, so an allow on it
    stands against any block that would reach it. A url without a rule is blocked if an alias is blocked by rule and
    none is allowed by rule; else it is allowed.

    Returns id_col, host, path, rule (host and path of the rule; null if none fits), verdict, and aliases (how many
    other urls have the same component; 0 without edges).

    Urls are compared by 64-bit hashes. Components are found by contraction (see common.components); what they decide is
    an aggregate with map-side combining, so that one site or target may have any share of the pages.

    Defined results: null urls and ones without :// have empty host and path, no rule and no aliases, and are allowed.
    Repeated rows are judged alike. Rules are few and part of the plan. Empty tables give an empty result.
    """
    rows = pages.select(F.col(id_col), F.col(url_col).alias("_url"))
    host, path = host_of(F.col("_url")), path_of(F.col("_url"))
    rows = rows.select(id_col, "_url", host.alias("host"), path.alias("path"), F.when(host != "", F.xxhash64("_url")).alias("_node"))
    rows = rows.withColumn("_own", _fit(F.col("host"), F.col("path"), rules))
    # Written once: pages are not parsed again for each of their uses.
    ends = checkpoint(edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL"))
    named = components(ends.select(F.xxhash64("src").alias("a"), F.xxhash64("dst").alias("b")))
    # Rules fit urls that are no pages, too: a redirect's target is known by the edge alone.
    urls = ends.select("src").unionAll(ends.select("dst")).distinct()
    own = _fit(host_of(F.col("src")), path_of(F.col("src")), rules)["verdict"]
    judged = urls.select(F.xxhash64("src").alias("node"), own.alias("own")).join(named, "node")
    classes = judged.groupBy("root").agg(
        F.max(F.col("own") == "block").alias("_block"), F.max(F.col("own") == "allow").alias("_allow"), F.count("*").alias("_urls")
    )
    classes = named.join(checkpoint(classes), "root").select(F.col("node").alias("_node"), "_block", "_allow", "_urls")
    # Rows without a url go to the join under keys of their own, so that they don't meet in one task.
    spread = F.coalesce(F.concat(F.lit("n"), F.col("_node").cast("string")), F.concat(F.lit("-"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    rows = rows.withColumn("_key", spread)
    classes = classes.withColumn("_key", F.concat(F.lit("n"), F.col("_node").cast("string"))).drop("_node")
    reached = F.when(F.col("_block") & ~F.coalesce("_allow", F.lit(False)), "block").otherwise("allow")
    return rows.join(classes, "_key", "left").select(
        id_col, "host", "path", F.col("_own.rule").alias("rule"), F.coalesce("_own.verdict", reached).alias("verdict"),
        F.coalesce(F.col("_urls") - 1, F.lit(0)).alias("aliases"),
    )


def op1_redirect_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return judge(pages, RULES, page_edges(pages))


def redirects_of(pages: DataFrame) -> DataFrame:
    """Redirects made of the table's own pages: each page of three neighbours by page_id leads to the first of them."""
    first = F.floor(F.col("page_id") / 3)
    heads = pages.where("page_id % 3 = 0 AND url IS NOT NULL").select(first.alias("k"), F.col("url").alias("dst"))
    return pages.where("page_id % 3 <> 0").select(first.alias("k"), F.col("url").alias("src")).join(heads, "k").select("src", "dst")


def redirected_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages judged with redirects among them, so that blocks reach aliases and allows stop some."""
    pages = table(spark, sf_dir, "pages")
    return judge(pages, RULES, page_edges(pages, redirects=redirects_of(pages)))


#: The same in SQL. The links in html are looked for with rel, property or http-equiv before the address only, as they are
#: usually written, and dots in relative ones are left as they are. {moved} are further edges.
_SQL = f"""
WITH RECURSIVE stated AS (
  SELECT url AS src, url AS t FROM pages WHERE url IS NOT NULL
  UNION ALL SELECT url, unnest(regexp_extract_all(html, '(?is)<link\\b[^>]*\\brel\\s*=\\s*["'']?canonical\\b[^>]*?\\bhref\\s*=\\s*["'']?([^"''\\s>]+)', 1)) FROM pages
  UNION ALL SELECT url, unnest(regexp_extract_all(html, '(?is)<meta\\b[^>]*\\bproperty\\s*=\\s*["'']?og:url\\b[^>]*?\\bcontent\\s*=\\s*["'']?([^"''\\s>]+)', 1)) FROM pages
  UNION ALL SELECT url, unnest(regexp_extract_all(html, '(?is)<meta\\b[^>]*\\bhttp-equiv\\s*=\\s*["'']?refresh\\b[^>]*?\\bcontent\\s*=\\s*["'']?\\s*[0-9.]*\\s*[;,]\\s*url\\s*=\\s*["'']?([^"''\\s>]+)', 1)) FROM pages
), moved AS ({{moved}}), whole AS (
  SELECT src, CASE WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN t WHEN starts_with(t, '//') THEN split_part(src, '://', 1) || ':' || t
    WHEN t = '' OR starts_with(t, '#') OR regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL
    WHEN starts_with(t, '/') THEN regexp_extract(src, '^([^:/?#]+://[^/?#]*)', 1) || t WHEN contains(src, '://') THEN regexp_extract(src, '^([^:/?#]+://[^/?#]*[^?#]*/)', 1) || t END AS t
  FROM (SELECT src, replace(t, '&amp;', '&') AS t FROM stated WHERE src IS NOT NULL)
  UNION ALL SELECT src, src FROM moved UNION ALL SELECT dst, dst FROM moved
), rest AS (
  SELECT src, translate(split_part(t, '://', 1), '{UPPER}', '{UPPER.lower()}') AS scheme, substr(t, instr(t, '://') + 3) AS r FROM whole WHERE instr(t, '://') > 0
), parts AS (
  SELECT src, scheme, translate(regexp_extract(r, '^([^/?#]*)', 1), '{UPPER}', '{UPPER.lower()}') AS host,
         regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(r, '^[^?#]*(\\?[^#]+)', 1) AS query FROM rest
), edges AS (
  SELECT DISTINCT src, dst FROM (
    SELECT src, scheme || '://' || host || CASE WHEN path = '' THEN '/' ELSE path END || query AS dst FROM parts WHERE host <> '' UNION ALL SELECT src, dst FROM moved)
  WHERE src <> dst
), sym AS (SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges),
reach AS (SELECT a, a AS b FROM sym UNION SELECT r.a, e.b FROM reach r JOIN sym e ON e.a = r.b),
urls AS (SELECT url FROM pages WHERE url IS NOT NULL UNION SELECT a FROM sym),
split AS (
  SELECT url, translate(regexp_extract(r, '^([^/?#]*)', 1), '{UPPER}', '{UPPER.lower()}') AS host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path
  FROM (SELECT url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM urls)
), rules(rule_host, start, decision) AS (VALUES {', '.join(str(r) for r in RULES)}),
fits AS (
  SELECT url, max_by(rule_host || start, len(rule_host) + len(start)) AS rule, max_by(decision, len(rule_host) + len(start)) AS decision
  FROM split JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, start) GROUP BY url
), classes AS (
  SELECT r.a AS url, bool_or(decision = 'block') AS blocked, bool_or(decision = 'allow') AS allowed, count(*) - 1 AS aliases
  FROM reach r LEFT JOIN fits f ON f.url = r.b GROUP BY 1
)
SELECT p.page_id, coalesce(s.host, '') AS host, coalesce(s.path, '') AS path, f.rule,
       coalesce(f.decision, CASE WHEN c.blocked AND NOT coalesce(c.allowed, false) THEN 'block' ELSE 'allow' END) AS verdict,
       coalesce(c.aliases, 0) AS aliases
FROM pages p LEFT JOIN split s USING (url) LEFT JOIN fits f USING (url) LEFT JOIN classes c USING (url)
"""

OP1_SQL = _SQL.replace("{moved}", "SELECT NULL::VARCHAR AS src, NULL::VARCHAR AS dst WHERE false")
REDIRECTED_SQL = _SQL.replace("{moved}", "SELECT a.url AS src, b.url AS dst FROM pages a JOIN pages b ON b.page_id = a.page_id - a.page_id % 3 WHERE a.page_id % 3 <> 0 AND a.url IS NOT NULL AND b.url IS NOT NULL")
