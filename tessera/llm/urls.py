"""URL filters: redirect equivalence, by DataFrame and SQL functions only.

Redirects and canonical links are edges between URLs; their connected components are one thing under several
names, so a decision about one name holds for its aliases. An explicit allow goes before a block.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, components

#: (host, path, verdict)
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def with_parts(df: DataFrame, url: str = "url") -> DataFrame:
    """df with host, path and key.

    host: what stands after the first :// up to / ? # or the end, A-Z lower-cased; path: then up to ? # or the
    end; both empty for null and where no :// is. key, a URL's name in the graph: host, path and query, without
    scheme and fragment; null where the host is empty.
    """
    keep = [c for c in df.columns if c not in ("host", "path", "key")]
    rest = df.select(*keep, F.coalesce(_rest(F.col(url)), F.lit("")).alias("_rest"))
    parts = rest.select(*keep, F.translate(F.regexp_extract("_rest", "^[^/?#]*", 0), UPPER, LOWER).alias("host"), F.regexp_extract("_rest", "^[^/?#]*([^?#]*)", 1).alias("path"), F.regexp_extract("_rest", "^[^?#]*(\\?[^#]*)", 1).alias("_query"))
    return parts.select(*keep, "host", "path", F.when(F.col("host") != "", F.concat("host", "path", "_query")).alias("key"))


def rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, nulls if none does. Of equally long rules an allow goes first."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r[2] == "allow", r[0] + r[1])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def links(pages: DataFrame) -> DataFrame:
    """Canonical links and refresh redirects in column html, as (src, dst) of absolute URLs. Comments are not read."""
    source = pages.where(F.col("html").rlike("(?i)canonical|http-equiv") & F.col("url").isNotNull())
    tags = F.regexp_extract_all(F.regexp_replace("html", "(?s)<!--.*?-->|(?i:<script\\b.*?</script>)", " "), F.lit("(?is)<(?:link|meta)\\b[^>]*>"), F.lit(0))
    found = source.select("url", F.explode(tags).alias("tag"))
    names = {"rel": "rel", "http-equiv": "equiv", "href": "href", "content": "content"}
    attribute = lambda name: F.regexp_extract("tag", rf"(?is)\s{name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", 0)
    value = lambda name: F.regexp_replace(F.regexp_replace(attribute(name), rf"(?is)^\s{name}\s*=\s*", ""), "^[\"']|[\"']$", "")
    found = found.select("url", "tag", *(value(a).alias(b) for a, b in names.items()))
    canonical = F.col("tag").rlike("(?is)^<link") & F.lower("rel").rlike("(^|\\s)canonical(\\s|$)")
    refresh = F.col("tag").rlike("(?is)^<meta") & (F.lower("equiv") == "refresh")
    to = F.when(canonical, F.col("href")).when(refresh, F.regexp_extract("content", "(?is)url\\s*=\\s*['\"]?([^'\"]*)", 1))
    to = F.replace(F.trim(to), F.lit("&amp;"), F.lit("&"))
    scheme = F.regexp_extract("url", "^([^:/?#]*:)//", 1)
    found = with_parts(found.where(canonical | refresh).select("url", scheme.alias("scheme"), to.alias("to")).where(F.length("to") > 0))
    to, base = F.col("to"), F.concat("scheme", F.lit("//"), "host")
    folder = F.regexp_replace(F.when(F.col("path") == "", "/").otherwise(F.col("path")), "[^/]*$", "")
    whole = F.when(to.contains("://"), to).when(F.startswith(to, F.lit("//")), F.concat("scheme", to)).when(F.startswith(to, F.lit("/")), F.concat(base, to)).otherwise(F.concat(base, folder, to))
    return found.select(F.col("url").alias("src"), whole.alias("dst"))


def judge(spark: SparkSession, pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, redirects: DataFrame | None = None) -> DataFrame:
    """One row for each page: page_id, host, path, rule, verdict, alias_of.

    pages needs page_id, url and html; redirects, if given, has more edges (src, dst). rules is a short list that
    becomes part of the plan. A page's own rule decides. A page without one takes the decision of its component:
    allow if a rule allows any URL of it (a target that is no page included), else block if a rule blocks one,
    else allow. alias_of is the component's smallest name, null for a page without links. A null URL or one
    without :// has an empty host and path, no rule and no aliases: it is allowed. Null html has no links.
    Repeated pages each return a row; an empty table returns an empty one; other columns are not read.
    """
    scratch = Scratch(spark)
    # A table, as else Spark puts the expressions over tags into those over their parts, and that code outgrows its compiler.
    edges = scratch.write(links(pages.select("url", "html")))
    if redirects is not None:
        edges = edges.unionByName(redirects.select("src", "dst"))
    edges = with_parts(with_parts(edges, "src").select("dst", F.col("key").alias("a")), "dst").select("a", F.col("key").alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    member = scratch.write(components(edges, scratch))
    named = with_parts(member.select("node", "root", F.concat(F.lit("://"), "node").alias("url")))
    h, p = F.col("host"), F.col("path")
    decided = named.select("root", rule(h, p, rules)[1].alias("v"))
    root = decided.groupBy("root").agg(F.max(F.col("v") == "allow").alias("allowed"), F.max(F.col("v") == "block").alias("blocked"))
    by_name = member.join(root, "root").select(F.col("node").alias("_key"), F.col("root").alias("alias_of"), "allowed", "blocked")
    own = with_parts(pages.select("page_id", "url")).select("page_id", "host", "path", F.col("key").alias("_key"))
    name, verdict = rule(h, p, rules)
    own = own.select("*", name.alias("rule"), verdict.alias("_own"))
    # Pages without a name have no aliases: they don't meet in the join, where they would all be one key.
    named, rest = own.where("_key IS NOT NULL"), own.where("_key IS NULL")
    both = named.join(by_name, "_key", "left").unionByName(rest, allowMissingColumns=True)
    judged = F.coalesce("_own", F.when(F.col("allowed"), "allow").when(F.col("blocked"), "block"), F.lit("allow"))
    return both.select("page_id", "host", "path", "rule", judged.alias("verdict"), "alias_of")
