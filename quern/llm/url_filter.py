"""URL filters with equivalence of redirects, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import connected_components, saved

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MAX_LITERAL_RULES = 2_000


def url_host(url: Column) -> Column:
    """After the first ://, up to /, ?, # or the end, A-Z lower-cased; empty if there is none or url is null."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"://([^/?#]*)", 1), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """What follows the host, up to ?, # or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"://[^/?#]*([^?#]*)", 1)


def url_address(url: Column) -> Column:
    """What two urls of one page share: host, path and query, without scheme and fragment; null without ://."""
    rest = F.regexp_extract(url, r"://[^/?#]*([^#]*)", 1)
    return F.when(F.instr(url, "://") > 0, F.concat(url_host(url), rest))


def best_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, or null. rules: (host and path, block or allow).

    Of the same text given as both block and allow, allow holds. The rules are a literal map from host to rules,
    so that a page looks up only the suffixes of its host.
    """
    if len(rules) > MAX_LITERAL_RULES:
        raise ValueError(f"more than {MAX_LITERAL_RULES} rules: split the list, or join a table of them on the host's suffixes")
    by_host: dict[str, list[tuple[str, str]]] = {}
    for rule, verdict in rules:
        if verdict not in ("allow", "block") or "/" not in rule:
            raise ValueError(f"not a rule: {rule} {verdict}")
        by_host.setdefault(rule.partition("/")[0].translate(str.maketrans(UPPER, LOWER)), []).append((rule, verdict))
    if not by_host:
        return F.lit(None).cast("struct<rule: string, verdict: string>")
    known = F.create_map(*[x for h, own in by_host.items() for x in (F.lit(h), F.array(*[F.struct(F.lit(len(r)).alias("n"), F.lit(v == "allow").alias("allows"), F.lit("/" + r.partition("/")[2]).alias("path"), F.lit(r).alias("rule"), F.lit(v).alias("verdict")) for r, v in own]))])
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    found = F.flatten(F.filter(F.transform(suffixes, lambda s: known[s]), lambda x: x.isNotNull()))
    best = F.array_max(F.filter(found, lambda r: F.startswith(path, r["path"])))
    return F.when(best.isNotNull(), F.struct(best["rule"].alias("rule"), best["verdict"].alias("verdict")))


def page_links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(src, dst) addresses: canonical links and refresh redirects that pages state, relative ones resolved."""
    html, url = F.col("h"), F.col("u")
    tag = lambda name, attr: F.regexp_extract(html, rf"(?is)<{name}\b[^>]*?{attr}[^>]*>", 0)
    link = F.regexp_extract(tag("link", r"\brel\s*=\s*[\"']?canonical\b"), r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)", 1)
    meta = F.regexp_extract(tag("meta", r"\bhttp-equiv\s*=\s*[\"']?refresh\b"), r"(?is)\burl\s*=\s*[\"']?([^\"'\s>]+)", 1)
    stated = pages.select(F.col(url_col).alias("u"), F.col(html_col).alias("h")).where("u is not null and h is not null").where(F.lower(html).rlike("canonical|refresh"))
    found = stated.select("u", F.explode(F.array(link, meta)).alias("t")).where("t <> ''")
    t, base = F.col("t"), F.concat(F.regexp_extract(url, r"^(.*?://)", 1), F.regexp_extract(url, r"://([^/?#]*)", 1))
    whole = (
        F.when(F.instr(t, "://") > 0, t)
        .when(t.startswith("//"), F.concat(F.lit("http:"), t))
        .when(t.startswith("/"), F.concat(base, t))
        .when(t.startswith("?"), F.concat(base, url_path(url), t))
        .when(t.startswith("#"), url)
        .otherwise(F.concat(base, F.regexp_extract(F.concat(url_path(url), F.when(url_path(url) == "", "/").otherwise("")), r"^(.*/)", 1), t))
    )
    return found.select(url_address(url).alias("src"), url_address(whole).alias("dst")).where("src is not null and dst is not null")


def filter_urls(pages: DataFrame, rules: list[tuple[str, str]], redirects: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, host, path, rule, verdict, alias_verdict) of every page.

    A rule fits its host and all subdomains if the url's path starts with the rule's; the longest wins, and its
    verdict holds for the page. Pages without a rule take the verdict of their aliases: the connected component
    of their address over canonical links, refresh redirects and, if given, `redirects` (src and dst urls). A
    component with an address that a rule allows is allowed; else one with a blocked address is blocked; all
    other pages are allowed.

    Only addresses with a link enter the component rounds; html is read once and never shuffled. A null url or
    one without :// has empty host and path, no rule and no aliases, and is allowed. Repeated rows are judged
    each; an empty table gives no rows; other columns are not read.
    """
    own = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"))
    judged = own.withColumn("r", best_rule(F.col("host"), F.col("path"), rules))
    links = page_links(pages, url_col, html_col)
    if redirects is not None:
        links = links.unionByName(redirects.select(url_address(F.col("src")).alias("src"), url_address(F.col("dst")).alias("dst")))
    links = saved(links.distinct(), "links")
    if links.isEmpty():
        return judged.select(F.col("id").alias(id_col), "host", "path", F.col("r.rule").alias("rule"), F.coalesce("r.verdict", F.lit("allow")).alias("verdict"), F.lit(None).cast("string").alias("alias_verdict"))
    nodes = saved(connected_components(links), "aliases")
    as_url = F.concat(F.lit("x://"), F.col("node"))
    ruled = nodes.withColumn("v", best_rule(url_host(as_url), url_path(as_url), rules)["verdict"])
    by_component = ruled.groupBy("component").agg(F.max(F.col("v") == "allow").alias("allows"), F.max(F.col("v") == "block").alias("blocks"))
    said = nodes.join(by_component, "component").select(F.col("node").alias("address"), F.when(F.col("allows"), "allow").when(F.col("blocks"), "block").alias("alias_verdict"))
    both = judged.withColumn("address", url_address(F.col("url"))).join(said, "address", "left")
    return both.select(F.col("id").alias(id_col), "host", "path", F.col("r.rule").alias("rule"), F.coalesce("r.verdict", "alias_verdict", F.lit("allow")).alias("verdict"), "alias_verdict")
