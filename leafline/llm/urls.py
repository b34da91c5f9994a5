"""URL filters with redirect equivalence, in DataFrame operations only.

A url's rule is the longest one that fits its host (or a parent domain) and
path.  Pages also name other addresses for themselves: canonical links and
refresh redirects.  Connected components over these edges are classes of
aliases; a class with an explicitly allowed address is allowed, else one with
a blocked address is blocked, for all its members that no rule names.

Defined results: a null url, or one without ``://``, has an empty host and
path, no rule and no alias, and is allowed; a null html names no alias; equal
urls get equal verdicts and a row each; links that cannot be resolved are left
out; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafline.llm.components import components
from leafline.llm.spread import keep

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LINK = r"""(?is)<link\s[^>]*\brel\s*=\s*["']?canonical\b[^>]*>"""
_HREF = r"""(?is)\bhref\s*=\s*["']?([^"'\s>]+)"""
_META = r"""(?is)<meta\s[^>]*\bhttp-equiv\s*=\s*["']?refresh\b[^>]*>"""
_GOTO = r"""(?is)\burl\s*=\s*['"]?([^"'\s>]+)"""


def rule_table(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    """(rule_host, rule_path, rule, verdict) of pairs like ("block", "example.com/de/")."""
    rows = []
    for verdict, rule in rules:
        host, slash, path = rule.partition("/")
        rows.append(F.struct(F.lit(host).alias("rule_host"), F.lit(slash + path).alias("rule_path"), F.lit(rule).alias("rule"), F.lit(verdict).alias("rule_verdict")))
    return spark.range(1).select(F.inline(F.array(*rows)))


def placed(rows: DataFrame, url: str = "url") -> DataFrame:
    """Add host, path and address (host, path, at least a slash, and query: what a server sees; null without a host)."""
    at = F.locate("://", F.col(url))
    after = F.when(at > 0, F.substring(F.col(url), at + 3, F.length(url)))
    rows = rows.withColumn("after", after)
    rows = rows.withColumns(
        {
            "host": F.coalesce(F.translate(F.regexp_extract("after", r"^[^/?#]*", 0), UPPER, LOWER), F.lit("")),
            "path": F.coalesce(F.regexp_extract("after", r"^[^/?#]*([^?#]*)", 1), F.lit("")),
            "query": F.regexp_extract("after", r"^[^?#]*(\?[^#]*)?", 1),
        }
    )
    address = F.when(F.col("host") != "", F.concat("host", F.when(F.col("path") == "", F.lit("/")).otherwise(F.col("path")), "query"))
    return rows.withColumn("address", address).drop("after", "query")


def _resolved() -> Column:
    """The column link as an absolute url; host and path of the page are the base."""
    link = F.col("link")
    base = F.concat(F.lit("http://"), "host")
    folder = F.regexp_extract("path", r"^(.*/)", 1)
    return (
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), link)
        .when(link.startswith("//"), F.concat(F.lit("http:"), link))
        .when(link.startswith("/"), F.concat(base, link))
        .when((link == "") | link.rlike(r"^([#?]|[A-Za-z][A-Za-z0-9+.-]*:)"), None)
        .otherwise(F.concat(base, F.when(folder == "", F.lit("/")).otherwise(folder), link))
    )


def alias_edges(pages: DataFrame) -> DataFrame:
    """(u, v): addresses that name each other, from canonical links and refresh redirects."""
    named = pages.select("url", "html").filter(F.col("html").rlike("(?i)canonical|http-equiv"))
    links = F.array(F.regexp_extract(F.regexp_extract("html", _LINK, 0), _HREF, 1), F.regexp_extract(F.regexp_extract("html", _META, 0), _GOTO, 1))
    each = named.select("url", F.explode(links).alias("link")).filter("link != ''").withColumn("link", F.replace("link", F.lit("&amp;"), F.lit("&")))
    targets = placed(each).withColumnRenamed("address", "u").withColumn("target", _resolved()).drop("host", "path")
    # written before the filter, which would else be pushed below all of the above and evaluate it again
    edges = keep(placed(targets, "target").withColumnRenamed("address", "v").select("u", "v").distinct())
    return edges.filter("u IS NOT NULL AND v IS NOT NULL AND u != v")


def match_rules(places: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path, rule, rule_verdict) of the distinct places (host, path) that a rule fits: the longest rule.

    Every host is dealt by its parent domains, so rules are found by equality
    whatever their number.
    """
    labels = F.split("host", r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    dealt = places.select("host", "path").distinct().select("host", "path", F.explode(parents).alias("rule_host"))
    fit = dealt.join(rules, "rule_host").filter(F.startswith("path", "rule_path"))
    best = fit.groupBy("host", "path").agg(F.max(F.struct(F.length("rule"), "rule", "rule_verdict")).alias("best"))
    return best.select("host", "path", "best.rule", "best.rule_verdict")


def filter_urls(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """page_id, host, path, rule and verdict of every page."""
    roots = components(alias_edges(pages))
    # the rules of all addresses in classes, whether or not a page has them
    members = placed(roots.withColumn("url", F.concat(F.lit("x://"), "node"))).select("root", "host", "path")
    ruled = members.join(match_rules(members, rules), ["host", "path"])
    verdicts = ruled.groupBy("root").agg(F.max(F.col("rule_verdict") == "allow").alias("allowed")).filter("NOT allowed")
    blocked = roots.join(verdicts, "root").select(F.col("node").alias("address"), F.lit(True).alias("alias_blocked"))
    places = placed(pages.select("page_id", "url"))
    found = places.join(match_rules(places, rules), ["host", "path"], "left").join(blocked, "address", "left")
    verdict = F.coalesce("rule_verdict", F.when(F.col("alias_blocked"), F.lit("block")), F.lit("allow"))
    return found.select("page_id", "host", "path", "rule", verdict.alias("verdict"))
