"""URL filters: host and path rules, block decisions spread over aliases.

Two URLs are aliases when they differ only in scheme, fragment, tracking
parameters or a closing slash (one key), or when one page names the other as
its canonical link or redirects to it by a refresh, whatever its delay (an edge
between keys). Aliases are the connected components over these edges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, components, fresh, staged

# Fixed values: (verdict, rule) as host and path prefix.
RULES = [
    ("block", "net/"),
    ("allow", "example.net/en/"),
    ("block", "example.com/de/"),
    ("allow", "org/fr/"),
]
#: Rules become one expression; longer lists are refused.
MAX_RULES = 1000
TRACKING = r"(?i)^(utm_[^=]*|ref|fbclid|gclid)(=|$)"


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): both empty for null or a URL without ``://``."""
    at = F.locate("://", url) if isinstance(url, str) else F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(raw) + 1, F.length(rest)), r"^[^?#]*", 0)
    return ascii_lower(raw), path


def rule_of(host: Column, path: Column, rules=None) -> Column:
    """Struct (verdict, rule) of the longest rule that fits; null if none does."""
    rules = RULES if rules is None else rules
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    out = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, rule in sorted(rules, key=lambda x: (len(x[1]), x[0] == "allow")):
        name, slash, prefix = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + prefix)
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))).otherwise(out)
    return out


def alias_key(url: Column) -> Column:
    """Key shared by URLs that differ only in scheme, fragment, tracking or closing slash; null if no host."""
    host, path = split_url(url)
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    kept = F.filter(F.split(query, "&"), lambda x: (x != "") & ~x.rlike(TRACKING))
    tail = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit(""))
    return F.when(host != "", F.concat(host, F.regexp_replace(path, r"/+$", ""), tail))


def targets(url: Column, html: Column) -> Column:
    """Absolute URLs that a page names as canonical or redirects to (array, maybe empty).

    Comments and scripts do not count. Character references of ``&`` are
    decoded; relative targets are resolved against the page's URL.
    """
    clean = F.regexp_replace(html, r"(?is)<!--.*?(?:-->|\z)|<script\b.*?(?:</script\s*>|\z)", " ")
    tags = F.regexp_extract_all(clean, F.lit(r"(?is)<(?:link|meta)\b[^>]*>"), F.lit(0))
    canonical = F.transform(
        F.filter(tags, lambda t: t.rlike(r"(?is)^<link\b.*\brel\s*=\s*[\"']?[^\"'>]*\bcanonical\b")),
        lambda t: F.regexp_extract(t, r"(?is)\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", 0))
    canonical = F.transform(canonical, lambda t: F.regexp_replace(t, r"(?is)^href\s*=\s*[\"']?|[\"']$", ""))
    refresh = F.transform(
        F.filter(tags, lambda t: t.rlike(r"(?is)^<meta\b.*\bhttp-equiv\s*=\s*[\"']?refresh\b")),
        lambda t: F.regexp_extract(t, r"(?is)\burl\s*=\s*['\"]?([^\"'>\s]+)", 1))
    base = F.regexp_extract(url, r"^[^?#]*", 0)
    root = F.regexp_extract(url, r"^[^?#]*?://[^/?#]*", 0)
    folder = F.when(F.length(base) > F.length(root), F.regexp_replace(base, r"[^/]*$", "")).otherwise(
        F.concat(root, F.lit("/")))
    found = F.transform(F.concat(canonical, refresh), lambda x: F.trim(F.regexp_replace(x, "(?i)&amp;", "&")))
    found = F.transform(F.filter(found, lambda x: x != ""), lambda x: (
        F.when(x.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), x)
        .when(x.startswith("//"), F.concat(F.lit("http:"), x))
        .when(x.startswith("/"), F.concat(root, x))
        .otherwise(F.concat(folder, x))))
    named = F.lower(html).contains("canonical") | F.lower(html).contains("refresh")
    return F.when((root != "") & named, found).otherwise(F.array().cast("array<string>"))


def judge(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html",
          rules=None) -> DataFrame:
    """Host, path, rule and verdict of every row of ``pages``.

    A page with a rule of its own has that rule's verdict. Another page is
    allowed if a rule allows any of its aliases (explicit allow goes first),
    else blocked if a rule blocks any, else allowed. Link targets count as
    aliases even if no page has them. A null or hostless URL has no alias;
    null html names none. Repeated rows are each judged. Also returns
    alias_root (the smallest key of the component, null if hostless). An
    empty table gives an empty result; other columns are ignored.
    """
    pid = F.col(page_id)
    host, path = split_url(F.col(url))
    p = pages.select(pid.alias("page_id"), host.alias("host"), path.alias("path"), alias_key(F.col(url)).alias("key"),
                     F.coalesce(targets(F.col(url), F.col(html)), F.array().cast("array<string>")).alias("to"))
    p = staged(p.withColumn("own", rule_of(F.col("host"), F.col("path"), rules)), "url-pages")
    links = p.where(F.size("to") > 0).select("key", F.explode("to").alias("target"))
    t_host, t_path = split_url(F.col("target"))
    links = staged(links.select("key", alias_key(F.col("target")).alias("other"),
                                rule_of(t_host, t_path, rules).alias("own")).where("other is not null"), "url-links")
    roots = staged(components(links, "key", "other", "url-aliases"), "url-roots")
    member = p.drop("to").join(roots, p["key"] == roots["node"], "left")
    member = member.withColumn("root", F.coalesce("root", "key")).drop("node")
    named = links.join(roots, links["other"] == roots["node"]).select("root", "own")
    ruled = member.select("root", "own").where("own is not null").union(named.where("own is not null"))
    flags = ruled.where("root is not null").groupBy("root").agg(
        F.max(F.col("own.verdict") == "allow").alias("any_allow"),
        F.max(F.col("own.verdict") == "block").alias("any_block")).withColumnRenamed("root", "flag_root")
    out = member.join(flags, member["root"] == flags["flag_root"], "left")
    spread = F.when(F.coalesce("any_allow", F.lit(False)), "allow").when(
        F.coalesce("any_block", F.lit(False)), "block").otherwise("allow")
    return out.select(F.col("page_id").alias(page_id), "host", "path", F.col("own.rule").alias("rule"),
                      F.coalesce(F.col("own.verdict"), spread).alias("verdict"), F.col("root").alias("alias_root"))


