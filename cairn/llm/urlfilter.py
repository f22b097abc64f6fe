"""URL filters: allow and block rules, and block decisions that reach a page's aliases.

Pages that redirect to each other or name a canonical address are one page under several addresses.  Components over
these edges carry a block rule's verdict to all aliases that no rule fits; an allow rule among them takes precedence.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import fresh, written
from cairn.llm.graph import components


@dataclass(frozen=True)
class Rule:
    """Fits a host and its subdomains where the path starts with `path`."""

    verdict: str
    host: str
    path: str = "/"

    @property
    def text(self) -> str:
        return self.host + self.path


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without a ://."""
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path(url: Column) -> Column:
    """After the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def address(url: Column) -> Column:
    """What identifies a page: host, path and query; neither scheme nor fragment.  Null without a host."""
    found = F.concat(host(url), F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1))
    return F.when(host(url) != "", found)


def fits(rule: Rule, host: Column, path: Column) -> Column:
    return ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)


def matched(rules: list[Rule], host: Column, path: Column) -> Column:
    """The longest rule that fits, as struct(rule, verdict), or null; among equally long ones an allow rule wins.

    Rules are a configured list, compiled into one expression.
    """
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.text), r.verdict == "allow", r.text)):
        found = F.when(fits(r, host, path), F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(found)
    return found


def matched_by_table(places: DataFrame, rules: DataFrame) -> DataFrame:
    """As matched, for distinct host and path of places and rules of any number (columns verdict, host, path): host, path, match.

    Hosts meet rules by their suffixes, so this is an equi join; places that no rule fits are left out.
    """
    each = places.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    suffixes = F.transform(labels, lambda _, i: F.array_join(F.slice(labels, i + 1, F.size(labels)), "."))
    named = rules.select(F.col("host").alias("suffix"), F.col("path").alias("start"), "verdict")
    met = each.withColumn("suffix", F.explode(suffixes)).join(named, "suffix").where(F.col("path").startswith(F.col("start")))
    text = F.concat("suffix", "start")
    best = F.max_by(F.struct(text.alias("rule"), "verdict"), F.struct(F.length(text), F.col("verdict") == "allow", text))
    return met.groupBy("host", "path").agg(best.alias("match"))


def with_match(places: DataFrame, rules: list[Rule] | DataFrame, name: str) -> DataFrame:
    """places (host, path) with a column `name`: the rule that fits, as matched or matched_by_table says."""
    if isinstance(rules, list):
        return places.withColumn(name, matched(rules, F.col("host"), F.col("path")))
    found = matched_by_table(places, rules).withColumnRenamed("match", name)
    return places.join(found, ["host", "path"], "left").select(*places.columns, name)


#: A link or meta tag, and the attribute values in it that name another address.
_TAGS = r"(?is)<(?:link|meta)\b[^>]*>"
_CANONICAL = r"(?is)\brel\s*=\s*[\"']?[^\"'>]*\bcanonical\b"
_HREF = r"(?is)\bhref\s*=\s*[\"']?\s*([^\"'\s>]+)"
_REFRESH = r"(?is)\bhttp-equiv\s*=\s*[\"']?\s*refresh\b"
_TARGET = r"(?is)\bcontent\s*=\s*[\"'][^\"'>]*?\burl\s*=\s*([^\"'\s>]+)"


def resolved(target: Column, url: Column) -> Column:
    """A link's target as a full URL: absolute ones, those without a scheme, and those from the root or the folder."""
    site = F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1)
    folder = F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*(?:[^?#]*/)?)", 1)
    return (
        F.when(target.contains("://"), target)
        .when(target.startswith("//"), F.concat(F.lit("http:"), target))
        .when(target.startswith("/"), F.concat(site, target))
        .otherwise(F.concat(F.when(folder.endswith("/"), folder).otherwise(F.concat(folder, F.lit("/"))), target))
    )


def alias_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Edges a, b between the addresses of pages and those that their HTML names as canonical or refreshes to."""
    tags = F.filter(F.regexp_extract_all(F.col(html), F.lit(_TAGS), 0), lambda t: t.rlike(_CANONICAL) | t.rlike(_REFRESH))
    named = pages.where(F.col(html).rlike(r"(?i)canonical|refresh")).select(F.col(url).alias("url"), F.explode(tags).alias("tag"))
    target = F.when(F.col("tag").rlike(_CANONICAL), F.regexp_extract("tag", _HREF, 1)).otherwise(F.regexp_extract("tag", _TARGET, 1))
    linked = named.select("url", F.replace(target, F.lit("&amp;"), F.lit("&")).alias("to")).where("`to` <> ''")
    return linked.select(address(F.col("url")).alias("a"), address(resolved(F.col("to"), F.col("url"))).alias("b")).where("a is not null and b is not null and a <> b")


def judge(pages: DataFrame, rules: list[Rule] | DataFrame, redirects: DataFrame | None = None, default: str = "allow", url: str = "url", html: str = "html") -> DataFrame:
    """pages with host, path, rule and verdict.

    rules: a list, or for many rules a table (verdict, host, path).  redirects: further edges, columns a and b of URLs.  A page that a rule fits has the rule's verdict.  Any other is
    blocked if a page or named address of its component is blocked by a rule and none is allowed by one; else `default`.
    Pages without a host belong to no component.  Null and empty URLs and HTML are pages without links; repeated pages each
    have the same result, an empty table gives none.  Columns host, path, rule and verdict are replaced where pages has
    them, all others pass through.
    """
    edges = alias_edges(pages, url, html)
    if redirects is not None:
        edges = edges.unionByName(redirects.select(address(F.col("a")).alias("a"), address(F.col("b")).alias("b")))
    match, own, node, carries = (fresh(pages, n) for n in ("match_of", "address_of", "node_of", "carried_of"))
    judged = with_match(pages.withColumns({own: address(F.col(url)), "host": host(F.col(url)), "path": path(F.col(url))}), rules, match)
    found = components(edges)
    full = F.concat(F.lit("x://"), F.col("node"))  # an address's host and path, whether a page has it or not
    ruled = with_match(found.withColumns({"host": host(full), "path": path(full)}), rules, "match").withColumn("verdict", F.col("match")["verdict"])
    carried = ruled.groupBy("component").agg(F.max((F.col("verdict") == "allow").cast("int")).alias("allow"), F.max((F.col("verdict") == "block").cast("int")).alias("block"))
    blocked = carried.where("block = 1 and coalesce(allow, 0) = 0").select("component")
    aliases = written(found.join(blocked, "component").select(F.col("node").alias(node), F.lit("block").alias(carries)))
    joined = judged.join(aliases, F.col(own) == F.col(node), "left")
    verdict = F.coalesce(F.col(match)["verdict"], F.col(carries), F.lit(default))
    return joined.withColumns({"rule": F.col(match)["rule"], "verdict": verdict}).drop(match, own, node, carries)
