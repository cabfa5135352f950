"""Decisions on domains, paths, robots texts and terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.functions import text, urls

# Path segments and title phrases of directories.
DIRECTORY_SEGMENTS = ["companies", "company-profile", "directory", "listing", "marketplace", "profile", "search"]
DIRECTORY_TITLES = ["business directory", "company directory", "find companies", "marketplace listing"]
# Parts of sites that are not crawled.
RESTRICTED_SEGMENTS = ["account", "accounts", "admin", "administrator", "api", "apis", "cart", "checkout", "customer", "customers", "graphql", "login", "logout", "search", "signin", "wp-admin", "wp-json"]
RESTRICTED_TOKENS = ["account", "admin", "api", "cart", "checkout", "graphql", "login", "search", "signin"]
SEARCH_KEYS = ["q", "query", "s", "search"]
RESTRICTED_PHRASES = ["customer-data", "customer_data", "internal-search", "internal_search"]
BINARY_EXTENSIONS = [".7z", ".avi", ".bin", ".bmp", ".csv", ".doc", ".docx", ".dmg", ".exe", ".gif", ".gz", ".ico", ".jpeg", ".jpg", ".mov", ".mp3", ".mp4", ".mpeg", ".pdf", ".png", ".ppt", ".pptx", ".rar", ".tar", ".webp", ".xls", ".xlsx", ".xml", ".zip"]
# Patterns of pages that ask for a human.
CHALLENGES = [r"\bcaptcha\b", r"verify (?:that )?you are (?:a )?human", "checking your browser before accessing", "cf-chl-(?:captcha|managed|jschl)", "cloudflare ray id", r"attention required[! ]*\|[ ]*cloudflare", "bot[- ]protection", "automated access (?:has been )?(?:blocked|denied)"]
# What marks terms, and what they say of automation.
TERMS_MARKERS = ["terms", "terms-of-use", "legal", "acceptable-use", "voorwaarden", "gebruiksvoorwaarden"]
AUTOMATION = r"\b(?:automated\s+(?:access|requests?)|scrap(?:e|ing|ers?)|spiders?|robots?|data\s+extraction)\b"
PROHIBITION = r"\b(?:prohibited|forbidden|not\s+permitted|may\s+not|must\s+not|shall\s+not|do\s+not)\b"
RISK_WINDOW = 180


def source_policy(sources: DataFrame, rules: DataFrame, source_col: str = "source") -> DataFrame:
    """sources with domain, decision, list and rule.

    rules: list (approved, blocked or candidate), kind (exact or subdomains), rule. malformed domains are rejected;
    then blocked, approved, candidate (manual) and unknown (manual). Within a list an exact rule, www. aside, beats
    a rule with subdomains, and of those the longest holds. The host's suffixes are exploded and joined by
    equality, so that many rules need no comparison of each pair; each distinct domain is matched once.
    """
    named = sources.withColumn("domain", urls.normalize_domain(F.col(source_col)))
    joined = named.join(best_rules(named.select("domain"), rules), "domain", "left")
    decision = F.when(F.col("domain").isNull() | (F.col("b.list") == "blocked"), "rejected").when(F.col("b.list") == "approved", "approved").otherwise("manual_review_required")
    reason = F.when(F.col("domain").isNull(), "malformed").otherwise(F.coalesce("b.list", F.lit("unknown")))
    return joined.select(*[F.col(c) for c in sources.columns], "domain", decision.alias("decision"), reason.alias("reason"), F.col("b.rule").alias("rule"))


def blocked_domains(domains: DataFrame, rules: DataFrame) -> DataFrame:
    """(domain): those of domains, each once, that source_policy rejects as blocked."""
    return best_rules(domains, rules).where("b.list = 'blocked'").select("domain")


def best_rules(domains: DataFrame, rules: DataFrame) -> DataFrame:
    """(domain, b): the rule that holds for each domain that has one, b with list and rule."""
    domains = domains.where("domain is not null").distinct()
    labels = F.split("domain", r"\.")
    tails = domains.select("domain", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))).alias("tail"))
    known = rules.select(F.col("list"), F.col("kind"), F.col("rule"), F.when(F.col("kind") == "exact", urls.without_www(F.col("rule"))).otherwise(F.col("rule")).alias("tail")).distinct()
    hits = tails.join(known, "tail").where((F.col("kind") == "subdomains") | (urls.without_www(F.col("domain")) == F.col("tail")))
    order = F.when(F.col("list") == "blocked", 3).when(F.col("list") == "approved", 2).otherwise(1)
    return hits.groupBy("domain").agg(F.max(F.struct(order.alias("o"), (F.col("kind") == "exact").alias("e"), F.length("rule").alias("n"), F.col("list"), F.col("rule"))).alias("b"))


def official_website(url: Column, domain: Column, title: Column) -> Column:
    """https://host/ if the domain is the url's, and neither path nor title is a directory's; else null."""
    named = text.compact(F.lower(F.coalesce(title, F.lit("")))).rlike("|".join(DIRECTORY_TITLES))

    def site(clean: Column) -> Column:
        same = urls.without_www(urls.normalize_domain(domain)) == urls.host(clean)
        listed = F.arrays_overlap(urls.path_segments(clean), F.array(*[F.lit(s) for s in DIRECTORY_SEGMENTS]))
        return F.when(same & ~listed & ~named, F.concat(F.lit("https://"), urls.authority(clean), F.lit("/")))

    return urls.let(urls.normalize_company_url(url), site)


def is_safe_path(url: Column) -> Column:
    """Whether a url is no account, shop, search, administration or API path, and no download."""
    p = urls.path(url)
    for _ in range(3):
        p = F.coalesce(F.try_url_decode(F.replace(p, F.lit("+"), F.lit("%2B"))), p)
    p = F.lower(p)
    segments = F.filter(F.transform(F.split(p, "/"), F.trim), lambda s: s != "")
    tokens = F.flatten(F.transform(segments, lambda s: F.split(s, "[^a-z0-9]+")))
    keys = F.transform(F.split(urls.query(url), "&"), lambda q: F.lower(F.split_part(q, F.lit("="), F.lit(1))))
    listed = lambda xs: F.array(*[F.lit(x) for x in xs])
    last = F.regexp_extract(F.regexp_replace(p, "/+$", ""), "([^/]*)$", 1)
    binary = last.rlike("(" + "|".join(e.replace(".", r"\.") for e in BINARY_EXTENSIONS) + ")$")
    return ~(F.arrays_overlap(segments, listed(RESTRICTED_SEGMENTS)) | F.arrays_overlap(tokens, listed(RESTRICTED_TOKENS)) | F.arrays_overlap(keys, listed(SEARCH_KEYS)) | p.rlike("|".join(RESTRICTED_PHRASES)) | binary)


def has_challenge(html: Column) -> Column:
    # the pattern is tried only where one of its first letters stands
    starts = "".join(sorted({c.removeprefix(r"\b")[0] for c in CHALLENGES}))
    return F.substring(html, 1, 250_000).rlike(f"(?i)(?=[{starts}])(" + "|".join(CHALLENGES) + ")")


def response_reason(status: Column, content_type: Column, length: Column, limit: int = 2_000_000) -> Column:
    """Why a response is not read; null if it is."""
    kind = F.lower(F.trim(F.split_part(content_type, F.lit(";"), F.lit(1))))
    return (
        F.when(status.isin(401, 403, 429), "blocked").when(~status.between(200, 299), "status")
        .when(~kind.isin("text/html", "application/xhtml+xml", "text/plain"), "content_type").when(length > limit, "oversize")
    )


def has_terms_marker(label: Column, url: Column) -> Column:
    marks = "|".join(TERMS_MARKERS)
    return F.lower(label).rlike(marks) | F.lower(F.coalesce(F.try_url_decode(urls.path(url)), urls.path(url))).rlike(marks)


def _starts(pattern: str, c: Column) -> Column:
    """1-based starts of all matches: the text is cut before each, and lengths are summed up."""
    marked = F.regexp_replace(c, f"(?i)({pattern})", "\u0001$1")
    parts = F.split(marked, "\u0001")
    return F.transform(F.slice(F.sequence(F.lit(1), F.size(parts)), 1, F.size(parts) - 1), lambda i: F.aggregate(F.slice(parts, 1, i), F.lit(1), lambda a, x: a + F.length(x)))


def terms_signal(c: Column) -> Column:
    """approved; potential_automated_access_prohibition where words of automation and of prohibition start within RISK_WINDOW characters; else ambiguous_automation_language."""
    c = F.replace(c, F.lit("\u0001"), F.lit(" "))
    a, b = _starts(AUTOMATION, c), _starts(PROHIBITION, c)
    near = F.exists(a, lambda x: F.exists(b, lambda y: F.abs(x - y) <= RISK_WINDOW))
    return F.when(~c.rlike(f"(?i){AUTOMATION}"), "approved").when(near, "potential_automated_access_prohibition").otherwise("ambiguous_automation_language")


def robots_rules(robots: DataFrame) -> DataFrame:
    """(origin, line, agents, kind, pattern): the rules of robots texts, each with the agents of its group.

    Neighbouring user-agent lines share a group; a rule closes it. An empty Disallow is no rule and closes
    nothing. Comments, a byte order mark and unknown lines are left out.
    """
    lines = robots.select("origin", F.posexplode(F.split(F.regexp_replace(F.coalesce("body", F.lit("")), "^﻿", ""), r"\r\n|\r|\n")).alias("line", "raw"))
    kept = lines.select("origin", "line", F.trim(F.regexp_replace("raw", "#.*$", "")).alias("raw"))
    parts = kept.select("origin", "line", F.lower(F.trim(F.regexp_extract("raw", "^([^:]*):", 1))).alias("key"), F.trim(F.regexp_extract("raw", "^[^:]*:(.*)$", 1)).alias("value"))
    used = parts.where((F.col("key") == "user-agent") | (F.col("key").isin("allow", "disallow") & (F.col("value") != "")))
    w = Window.partitionBy("origin").orderBy("line")
    opens = (F.col("key") == "user-agent") & (F.coalesce(F.lag("key").over(w), F.lit("")) != "user-agent")
    grouped = used.withColumn("g", F.sum(opens.cast("int")).over(w))
    agents = grouped.where("key = 'user-agent'").groupBy("origin", "g").agg(F.array_sort(F.collect_set(F.lower("value"))).alias("agents"))
    return grouped.where("key <> 'user-agent'").join(agents, ["origin", "g"]).select("origin", "line", "agents", F.col("key").alias("kind"), F.col("value").alias("pattern"))


def robots_pattern(pattern: Column) -> Column:
    """A rule's pattern as a regular expression: * is anything, a $ at the end ends the path."""
    quoted = F.regexp_replace(F.regexp_replace(pattern, r"([.+?^(){}\[\]|\\$])", r"\\$1"), r"\*", ".*")
    return F.concat(F.lit("^"), F.regexp_replace(quoted, r"\\\$$", r"\$"))


def robots_decisions(rules: DataFrame, targets: DataFrame) -> DataFrame:
    """(origin, agent, path, decision) for each target: of the groups that name the agent, else those of *, the longest matching rule holds, allow on a tie."""
    named = targets.select("origin", "agent", "path").distinct().join(rules, "origin", "left").withColumn("own", F.array_contains("agents", F.lower("agent"))).withColumn("any", F.array_contains("agents", F.lit("*")))
    w = Window.partitionBy("origin", "agent", "path")
    valid = named.withColumn("has_own", F.max(F.coalesce("own", F.lit(False))).over(w)).withColumn("fits", F.when(F.col("has_own"), F.col("own")).otherwise(F.col("any")) & F.rlike("path", robots_pattern(F.col("pattern"))))
    specific = F.length(F.regexp_replace("pattern", r"[*$]", ""))
    best = valid.groupBy("origin", "agent", "path").agg(F.max(F.when(F.col("fits"), F.struct(specific.alias("n"), (F.col("kind") == "allow").alias("a")))).alias("b"))
    return best.select("origin", "agent", "path", F.when(F.col("path") == "/robots.txt", "approved").when(F.col("b.a") == F.lit(False), "rejected").otherwise("approved").alias("decision"))


def robots_fetch(status: Column, transport_ok: Column, length: Column, strict: bool = True, limit: int = 512_000) -> Column:
    """What a robots response means before its rules are read: parse, approved, rejected or manual_review_required."""
    down = F.lit("rejected" if strict else "manual_review_required")
    return F.when(~transport_ok | (status >= 500), down).when(status.isin(404, 410), "approved").when(status.between(200, 299), F.when(length > limit, "manual_review_required").otherwise("parse")).otherwise("manual_review_required")


def preflight(checks: DataFrame) -> DataFrame:
    """checks with decision: domain, robots, page and terms decisions of a target in their order; truncated or manual terms need a review."""
    d = F.when(F.col("domain_decision") != "approved", F.col("domain_decision")).when(F.col("robots_decision") != "approved", F.col("robots_decision")).when(~F.col("page_ok"), "rejected")
    d = d.when(F.exists("terms_decisions", lambda t: t == "rejected"), "rejected").when(F.col("terms_truncated") | F.exists("terms_decisions", lambda t: t == "manual_review_required"), "manual_review_required").otherwise("approved")
    return checks.withColumn("decision", d)


def latest_reviews(log: DataFrame) -> DataFrame:
    """(domain, decision): the last decision on each domain of an append-only log with seq; removed ones go."""
    last = log.groupBy("domain").agg(F.max_by("decision", "seq").alias("decision"))
    return last.where("decision <> 'remove'")
