"""URL filter with redirect equivalence.

Rules name a host and a path prefix; a rule fits its host and all subdomains,
and the longest fitting rule wins. URLs that no rule fits take the decision of
their aliases: redirect and canonical-link edges join URLs to classes by
distributed connected components, and a class is blocked if a rule blocks one
of its members and no rule explicitly allows one. Everything else is allowed.

Edges come from the pages' markup (``<link rel="canonical">`` and
``<meta http-equiv="refresh">``), from the canonical form of a URL (scheme,
fragment, tracking parameters and a final slash don't make a different page)
and from a table of redirects where there is one. Link targets are resolved
against their page. Rules judge the URLs as they stand, before their form is
made canonical. Nodes are 124 bits of the MD5 of the canonical form, of which
even 10^11 forms share one with a probability below 10^-14; the few rules are
literals.

Defined results: a null URL, or one without ``://``, has empty host and path,
fits no rule, has no aliases and is allowed; repeated rows give repeated
results, as do null ids; null markup has no links, and a target that is empty,
a mere fragment or of a scheme without ``//`` is none; extra columns are not
read, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written
from .components import connected_components


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: The rules of the registered query.
RULES = (
    Rule("com", "/en/", "block"),
    Rule("example.com", "/en/7", "allow"),
    Rule("net", "/de/", "allow"),
    Rule("example.net", "/de/8", "block"),
    Rule("org", "/es/", "block"),
)

_TRACKING = r"(?:utm_[a-z]+|ref|fbclid|gclid)=[^&]*"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1)
    return F.translate(rest, _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def _fits(rule: Rule, host: Column, path: Column) -> Column:
    return ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Name and verdict of the longest fitting rule, null where none fits."""
    order = sorted(rules, key=lambda r: (-len(r.name), r.name))
    pick = lambda value: reduce(lambda c, r: c.when(_fits(r, host, path), F.lit(value(r))), order[1:], F.when(_fits(order[0], host, path), F.lit(value(order[0])))) if order else F.lit(None).cast("string")
    return pick(lambda r: r.name), pick(lambda r: r.verdict)


def canonical_form(url: Column) -> Column:
    """host + path + the query without tracking; null without a host."""
    query = F.regexp_extract(url, r"^(?s:.*?)://[^?#]*\?([^#]*)", 1)
    kept = F.regexp_replace(F.regexp_replace(query, rf"(?:^|&){_TRACKING}(?=&|$)", ""), r"^&", "")
    path = F.regexp_replace(path_of(url), r"(?<=.)/$", "")
    form = F.concat(host_of(url), path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""))
    return F.when(url.contains("://"), form)


def _without_dots(path: Column) -> Column:
    """A path without ``.`` and ``..`` segments."""
    parts = F.split(path, "/")
    last = F.element_at(parts, -1)
    done = F.aggregate(
        F.slice(parts, 2, F.size(parts)),
        F.expr("cast(array() as array<string>)"),
        lambda out, x: F.when(x == ".", out).when(x == "..", F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0)))).otherwise(F.array_append(out, x)),
    )
    return F.concat(F.lit("/"), F.array_join(F.when(last.isin(".", ".."), F.array_append(done, "")).otherwise(done), "/"))


def absolute(target: Column, url: Column) -> Column:
    """A link target, resolved against its page; null if it names no page."""
    target = F.trim(F.regexp_replace(target, r"(?i)&(?:amp|#38|#x26);", "&"))
    origin = F.regexp_extract(url, r"^((?s:.*?)://[^/?#]*)", 1)
    scheme = F.regexp_extract(url, r"^((?s:.*?):)//", 1)
    here = F.when(path_of(url) == "", "/").otherwise(path_of(url))
    path, rest = F.regexp_extract(target, r"^([^?#]*)", 1), F.regexp_extract(target, r"^[^?#]*(\?[^#]*)?", 1)
    joined = F.when(path.startswith("/"), path).otherwise(F.concat(F.regexp_extract(here, r"^((?s:.*)/)", 1), path))
    return (
        F.when((target == "") | target.startswith("#") | ~F.coalesce(url, F.lit("")).contains("://"), F.lit(None))
        .when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://"), target)
        .when(target.startswith("//"), F.concat(scheme, target))
        .when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), F.lit(None))
        .when(target.startswith("?"), F.concat(origin, here, rest))
        .otherwise(F.concat(origin, _without_dots(joined), rest))
    )


def markup_links(html: Column) -> Column:
    """Targets of canonical links and refreshes in a page, as an array."""
    tags = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"(?i)<(?:link|meta)\b[^>]*>"), 0)
    canonical = F.filter(tags, lambda t: t.rlike(r"""(?i)^<link\b[^>]*\brel\s*=\s*["']?canonical\b"""))
    refresh = F.filter(tags, lambda t: t.rlike(r"""(?i)^<meta\b[^>]*\bhttp-equiv\s*=\s*["']?refresh\b"""))
    found = F.concat(
        F.transform(canonical, lambda t: F.regexp_extract(t, r"""(?i)\bhref\s*=\s*["']?([^"'\s>]+)""", 1)),
        F.transform(refresh, lambda t: F.regexp_extract(t, r"""(?i)\burl\s*=\s*["']?([^"'\s>]+)""", 1)),
    )
    return F.filter(found, lambda t: t != "")


def node_of(form: Column) -> Column:
    """124 bits of a form's MD5 as a decimal, which aggregates in fixed width."""
    part = lambda a, n: F.conv(F.substring(F.md5(form), a, n), 16, 10).cast("decimal(20,0)")
    return (part(1, 15) * F.lit(Decimal(2**64)).cast("decimal(20,0)") + part(16, 16)).cast("decimal(38,0)")


def links(pages: DataFrame, redirects: DataFrame | None = None, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(source, target): the URLs as they stand, of links in markup and of redirects."""
    url = F.col(url_col)
    found = pages.filter(F.col(html_col).isNotNull() & url.contains("://")).select(url.alias("source"), F.explode(markup_links(F.col(html_col))).alias("t"))
    found = found.select("source", absolute(F.col("t"), F.col("source")).alias("target"))
    if redirects is not None:
        found = found.unionByName(redirects.select("source", "target"))
    return found.filter("source is not null and target is not null").distinct()


def filter_urls(pages: DataFrame, rules=RULES, redirects: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, host, path, rule, verdict: one row per page."""
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    url = F.col(url_col)
    seen = pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"), canonical_form(url).alias("form"))
    seen = written(seen.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("own"), node_of(F.col("form")).alias("node")), "urls")

    ends = written(links(pages, redirects, url_col, html_col), "url-links")
    node = lambda c: node_of(canonical_form(F.col(c)))
    classes = connected_components(ends.select(node("source").alias("u"), node("target").alias("v")), "url-classes")
    # Votes: a rule's decision counts for the node of the URL that it judges, be it a page or the end of a link.
    far = ends.select(F.explode(F.array("source", "target")).alias("url"))
    far = far.select(node_of(canonical_form(F.col("url"))).alias("node"), rule_of(host_of(F.col("url")), path_of(F.col("url")), rules)[1].alias("own"))
    votes = seen.select("node", "own").unionByName(far).filter("own is not null and node is not null")
    said = votes.groupBy("node").agg(F.max(F.col("own") == "allow").alias("allow"), F.max(F.col("own") == "block").alias("block"))
    of = said.join(classes, "node", "left").select(F.coalesce("component", "node").alias("component"), "allow", "block")
    decided = of.groupBy("component").agg(F.max("allow").alias("allow"), F.max("block").alias("block"))
    blocked = written(decided.filter("block and not allow").select("component"), "url-blocked")
    # Nodes to block: members of blocked classes, and single nodes that are their own class.
    members = classes.join(blocked, "component").select("node").unionByName(blocked.select(F.col("component").alias("node"))).distinct()
    members = written(members.withColumn("hit", F.lit(True)), "url-members")

    out = ("page_id", "host", "path", "rule")
    ruled = seen.filter("own is not null").select(*out, F.col("own").alias("verdict"))
    alone = seen.filter("own is null and node is null").select(*out, F.lit("allow").alias("verdict"))
    rest = seen.filter("own is null and node is not null").join(members, "node", "left")
    return ruled.unionByName(alone).unionByName(rest.select(*out, F.when(F.col("hit"), "block").otherwise("allow").alias("verdict")))
