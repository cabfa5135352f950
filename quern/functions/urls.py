"""Functions on urls and domains. All are Column -> Column and stay in generated code."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query parameters that only track visitors.
TRACKING_PARAMETERS = ["_ga", "_gl", "dclid", "fbclid", "gad_source", "gclid", "hscid", "hsctatracking", "igshid", "mc_cid", "mc_eid", "mkt_tok", "msclkid", "ref", "referrer", "srsltid", "source", "vero_id", "yclid"]
TRACKING_PREFIXES = ["utm_", "pk_"]

#: Public suffixes known here; the functions take another list. Those in PRIVATE_SUFFIXES belong to companies.
SUFFIXES = ["com", "net", "org", "io", "nl", "de", "fr", "es", "be", "eu", "uk", "co.uk", "org.uk", "us", "dev", "app", "example"]
PRIVATE_SUFFIXES = ["github.io", "gitlab.io", "herokuapp.com", "blogspot.com", "netlify.app"]

DOMAIN = r"^([a-z0-9]([a-z0-9-]{0,61}[a-z0-9])?\.)+[a-z0-9]([a-z0-9-]{0,61}[a-z0-9])?$"
ADDRESS = r"^\d+(\.\d+){3}$"
PRIVATE_ADDRESS = r"^(0|10|127|100\.(6[4-9]|[7-9]\d|1[01]\d|12[0-7])|169\.254|172\.(1[6-9]|2\d|3[01])|192\.0\.[02]|192\.168|198\.1[89]|198\.51\.100|203\.0\.113|2(2[4-9]|[3-5]\d))\."
#: Addresses of version 6 that are public lie in 2000::/3, but for 2001::/23, the addresses for documents and 6to4.
GLOBAL_ADDRESS_6 = r"^[23][0-9a-f]{3}:(?!:*$)"
SPECIAL_ADDRESS_6 = r"^(2001:0?[01]?[0-9a-f]{0,2}:|2001:0?db8:|2002:)"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once: a column used many times in an expression is not copied."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def authority(url: Column) -> Column:
    """Between :// and the next /, ?, # or the end; empty without ://."""
    return F.regexp_extract(text_or_empty(url), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(text_or_empty(url), r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))


def host(url: Column) -> Column:
    """Lower-case host without user and port."""
    return F.lower(F.regexp_extract(authority(url), r"^(?:[^@]*@)?([^:]*)", 1))


def port(url: Column) -> Column:
    return F.regexp_extract(authority(url), r":(\d+)$", 1)


def path(url: Column) -> Column:
    return F.regexp_extract(text_or_empty(url), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def query(url: Column) -> Column:
    return F.regexp_extract(text_or_empty(url), r"^[^?#]*\?([^#]*)", 1)


def without_www(h: Column) -> Column:
    return F.regexp_replace(h, r"^www\.", "")


def normalize_domain(source: Column) -> Column:
    """A bare host or http(s) url as a lower-case domain; null if it is blank, an address, of one label, malformed, of another scheme or with a user. ASCII only."""
    part = F.regexp_extract(F.trim(text_or_empty(source)), r"(?i)^(?:https?://|//)?([^/?#]*)", 1)
    clean = F.regexp_replace(F.lower(F.regexp_replace(part, r":\d*$", "")), r"\.+$", "")
    return let(clean, lambda name: F.when(name.rlike(DOMAIN) & ~name.rlike(ADDRESS) & (F.length(name) <= 253), name))


def is_tracking(key: Column) -> Column:
    k = F.lower(key)
    return k.isin(TRACKING_PARAMETERS) | F.lit(False) | k.rlike("^(" + "|".join(TRACKING_PREFIXES) + ")")


def normalize_company_url(url: Column) -> Column:
    """https, no www., default port, trailing slashes, fragment or tracking parameters; the query sorted by (key, value). Null unless http(s) with a valid host and no user."""
    whole = F.when(url.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), url).otherwise(F.concat(F.lit("https://"), url))
    return let(whole, _company_url)


def _company_url(whole: Column) -> Column:
    pairs = F.filter(F.split(query(whole), "&"), lambda p: (p != "") & ~is_tracking(F.split_part(p, F.lit("="), F.lit(1))))
    keyed = F.array_sort(F.transform(pairs, lambda p: F.struct(F.lower(F.split_part(p, F.lit("="), F.lit(1))).alias("k"), F.split_part(p, F.lit("="), F.lit(2)).alias("v"), p.alias("p"))))
    asked = let(F.array_join(F.transform(keyed, lambda s: s["p"]), "&"), lambda q: F.when(q == "", "").otherwise(F.concat(F.lit("?"), q)))
    number = let(port(whole), lambda n: F.when(n.isin("", "80", "443"), "").otherwise(F.concat(F.lit(":"), n)))
    out = F.concat(F.lit("https://"), without_www(normalize_domain(host(whole))), number, F.regexp_replace(path(whole), "/+$", ""), asked)
    return F.when(scheme(whole).isin("http", "https") & ~F.contains(authority(whole), F.lit("@")), out)


def registrable_domain(name: Column, suffixes: list[str] | None = None, private: bool = True) -> Column:
    """The label before the longest public suffix, with it; the name itself if no suffix fits or it is one."""
    known = F.array(*[F.lit(s) for s in (suffixes if suffixes is not None else SUFFIXES + (PRIVATE_SUFFIXES if private else []))])

    def tail(labels: Column, i: Column) -> Column:
        return F.array_join(F.slice(labels, i, F.size(labels)), ".")

    def under(labels: Column) -> Column:
        at = F.array_min(F.filter(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_contains(known, tail(labels, i))))
        return let(at, lambda i: F.when(i > 1, tail(labels, i - 1)).otherwise(F.array_join(labels, ".")))

    return let(F.split(name, r"\."), under)


def same_registrable_domain(a: Column, b: Column, private: bool = True) -> Column:
    one, two = (registrable_domain(normalize_domain(x), private=private) for x in (a, b))
    return F.coalesce(one == two, F.lit(False))


def same_company_domain(a: Column, b: Column) -> Column:
    return F.coalesce(without_www(host(a)) == without_www(host(b)), F.lit(False))


def canonical_page_url(url: Column) -> Column:
    """Scheme, host and path without query and fragment; the path is / if empty. Null unless http(s) without a user."""
    s, number = scheme(url), port(url)
    default = (number == "") | ((s == "http") & (number == "80")) | ((s == "https") & (number == "443"))
    out = F.concat(s, F.lit("://"), host(url), F.when(default, "").otherwise(F.concat(F.lit(":"), number)), F.when(path(url) == "", "/").otherwise(path(url)))
    return F.when(s.isin("http", "https") & (host(url) != "") & ~F.contains(authority(url), F.lit("@")), out)


def page_identity(url: Column) -> Column:
    """Host without www. and path without trailing slashes: one string for pages that count as one."""
    p = F.regexp_replace(path(url), "/+$", "")
    return F.concat(without_www(host(url)), F.when(p == "", "/").otherwise(p))


def crawl_url(url: Column) -> Column:
    """Scheme, host, path and query without fragment; the path is / if empty."""
    return F.when(
        scheme(url).isin("http", "https") & (host(url) != ""),
        F.concat(scheme(url), F.lit("://"), host(url), F.when(port(url).isin("", "80", "443"), "").otherwise(F.concat(F.lit(":"), port(url))), F.when(path(url) == "", "/").otherwise(path(url)), F.when(query(url) == "", "").otherwise(F.concat(F.lit("?"), query(url)))),
    )


def http_link(base: Column, href: Column) -> Column:
    """href against base, without fragment; null unless http(s) without a user. Paths with .. are left as they are."""
    return let(F.struct(base.alias("base"), F.trim(href).alias("h")), lambda s: _http_link(s["base"], s["h"]))


def _http_link(base: Column, h: Column) -> Column:
    root = F.concat(scheme(base), F.lit("://"), authority(base))
    folder = F.regexp_extract(F.when(path(base) == "", "/").otherwise(path(base)), "^(.*/)", 1)
    whole = (
        F.when(h.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), h)
        .when(F.startswith(h, F.lit("//")), F.concat(scheme(base), F.lit(":"), h))
        .when(F.startswith(h, F.lit("/")), F.concat(root, h))
        .when((h == "") | F.startswith(h, F.lit("#")), base)
        .when(F.startswith(h, F.lit("?")), F.concat(root, path(base), h))
        .otherwise(F.concat(root, folder, h))
    )
    return let(F.regexp_replace(whole, "#.*$", ""), lambda clean: F.when(scheme(clean).isin("http", "https") & (host(clean) != "") & ~F.contains(authority(clean), F.lit("@")), clean))


def path_segments(url: Column) -> Column:
    """Decoded, lower-cased, non-empty segments of the path."""
    plain = F.coalesce(F.try_url_decode(F.replace(path(url), F.lit("+"), F.lit("%2B"))), path(url))
    return F.filter(F.split(F.lower(plain), "/"), lambda s: s != "")


def origin(url: Column) -> Column:
    return F.concat(scheme(url), F.lit("://"), F.lower(authority(url)))


def robots_url(url: Column) -> Column:
    return F.concat(origin(url), F.lit("/robots.txt"))


def path_and_query(url: Column) -> Column:
    return F.concat(F.when(path(url) == "", "/").otherwise(path(url)), F.when(query(url) == "", "").otherwise(F.concat(F.lit("?"), query(url))))


def same_website(a: Column, b: Column) -> Column:
    """Equal hosts without www., and equal paths or one of them empty."""
    pa, pb = (F.regexp_replace(path(x), "/+$", "") for x in (a, b))
    return F.coalesce((without_www(host(a)) == without_www(host(b))) & ((pa == pb) | (pa == "") | (pb == "")), F.lit(False))


def is_public_http(url: Column) -> Column:
    """http(s), no user, port 80 or 443, and neither a local name nor a private, loopback, link-local, multicast or reserved address."""
    h = host(url)
    six = F.lower(F.regexp_extract(authority(url), r"^(?:[^@]*@)?\[([^\]]*)\]", 1))
    bracketed = F.contains(authority(url), F.lit("["))
    public_six = six.rlike(GLOBAL_ADDRESS_6) & ~six.rlike(SPECIAL_ADDRESS_6)
    local = (bracketed & ~public_six) | h.isin("", "localhost") | h.rlike(r"\.(localhost|local|internal)$") | (h.rlike(ADDRESS) & h.rlike(PRIVATE_ADDRESS))
    return scheme(url).isin("http", "https") & ~F.contains(authority(url), F.lit("@")) & port(url).isin("", "80", "443") & ~local


def valid_http_url(url: Column, hosts: list[str] | None = None) -> Column:
    ok = scheme(url).isin("http", "https") & (host(url) != "")
    return F.when(ok & host(url).isin(hosts) if hosts else ok, url)


# Country names of hints.
COUNTRY_HINTS = {"belgium": "BE", "canada": "CA", "france": "FR", "germany": "DE", "ireland": "IE", "netherlands": "NL", "spain": "ES", "united kingdom": "GB", "united states": "US"}


def country_code_from_hint(hint: Column) -> Column:
    """Two letters, a trailing (XX), or a known name, as an upper-case code; else null."""
    t = F.trim(F.regexp_replace(hint, r"\s+", " "))
    named = F.create_map(*[F.lit(x) for kv in COUNTRY_HINTS.items() for x in kv])
    return F.when(t.rlike("^[A-Za-z]{2}$"), F.upper(t)).when(t.rlike(r"\([A-Za-z]{2}\)$"), F.upper(F.regexp_extract(t, r"\(([A-Za-z]{2})\)$", 1))).otherwise(named[F.lower(t)])
