"""Pieces of SQL for the queries of the catalogue, in DuckDB's dialect and written apart from the operators."""

from __future__ import annotations

from quern.functions import text as T
from quern.functions import urls as U


def quote(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def listed(xs) -> str:
    return "[" + ", ".join(quote(x) for x in xs) + "]"


#: Suffixes under which every host of the shared tables is a site of its own.
HOST_SUFFIXES = ["com", "net", "org", "example.com", "example.net", "example.org"]
FORMS = ["B.V.", "Holding GmbH", "Ltd.", "S.A.", "Company Limited", "Studio"]
COMPANIES = f"""select s_suppkey * 2 as id, replace(s_name, '#', ' & ') || ' ' || {listed(FORMS)}[(s_suppkey % {len(FORMS)})::int + 1] as name, s_nationkey as nationkey from supplier
    union all select c_custkey * 2 + 1, replace(c_name, '#', ' & ') || ' ' || {listed(FORMS)}[(c_custkey % {len(FORMS)})::int + 1], c_nationkey from customer"""
WIDE_URL = "regexp_replace(url || case when contains(url, '?') then '&' else '?' end || 'b=2&utm_medium=x&A=1&gclid=9&a=0&', '#[^?]*', '', 'g')"
TRACKING = "^(" + "|".join(U.TRACKING_PARAMETERS) + ")$|^(utm_|pk_)"
HREF_LIST = ["/about", "//cdn.example.org/x", "https://a.b/c#d", "team.html", "?p=2", "#top", "mailto:a@b.nl", " http://u@h.nl/ "]
HREFS = listed(HREF_LIST)
HOST_LIST = ["localhost", "127.0.0.1", "10.1.2.3", "172.20.0.1", "192.168.1.1", "8.8.8.8", "printer.local", "example.org:8080"]
HOSTS = listed(HOST_LIST)
SUFFIX_PATH_LIST = ["", "/wp-admin", "/my-cart/1", "/a/file.pdf", "/b?q=shoes", "/internal-search-page", "/Customers/", "/about-us/"]
SUFFIX_PATHS = listed(SUFFIX_PATH_LIST)
COUNTRY_MAP = "map {" + ", ".join(f"{quote(k)}: {quote(v)}" for k, v in U.COUNTRY_HINTS.items()) + "}"


def authority(u):
    return f"regexp_extract(coalesce({u}, ''), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)"


def scheme(u):
    return f"lower(regexp_extract(coalesce({u}, ''), '^([A-Za-z][A-Za-z0-9+.-]*)://', 1))"


def host(u):
    return f"lower(regexp_extract({authority(u)}, '^(?:[^@]*@)?([^:]*)', 1))"


def port(u):
    return f"regexp_extract({authority(u)}, ':([0-9]+)$', 1)"


def path(u):
    return f"regexp_extract(coalesce({u}, ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"


def query(u):
    return f"regexp_extract(coalesce({u}, ''), '^[^?#]*\\?([^#]*)', 1)"


def bare(u):
    return f"regexp_replace({host(u)}, '^www\\.', '')"


def domain(u):
    name = f"regexp_replace(lower(regexp_replace(regexp_extract(trim(coalesce({u}, '')), '(?i)^(?:https?://|//)?([^/?#]*)', 1), ':[0-9]*$', '')), '\\.+$', '')"
    return f"case when regexp_matches({name}, '{U.DOMAIN}') and not regexp_matches({name}, '{U.ADDRESS}') and length({name}) <= 253 then {name} end"


def company_url(u):
    pairs = f"list_filter(string_split({query(u)}, '&'), lambda p: p <> '' and not regexp_matches(lower(split_part(p, '=', 1)), '{TRACKING}'))"
    keyed = f"list_transform(list_sort(list_transform({pairs}, lambda p: struct_pack(k := lower(split_part(p, '=', 1)), v := split_part(p, '=', 2), p := p))), lambda s: s.p)"
    asked = f"array_to_string({keyed}, '&')"
    return f"""case when {scheme(u)} in ('http', 'https') and not contains({authority(u)}, '@') then 'https://' || regexp_replace({domain(host(u))}, '^www\\.', '') || case when {port(u)} in ('', '80', '443') then '' else ':' || {port(u)} end
        || regexp_replace({path(u)}, '/+$', '') || case when {asked} = '' then '' else '?' || {asked} end end"""


def registrable(d, private):
    known = private if isinstance(private, list) else U.SUFFIXES + (U.PRIVATE_SUFFIXES if private else [])
    labels = f"string_split({d}, '.')"
    tails = f"list_transform(range(1, len({labels}) + 1), lambda i: array_to_string({labels}[i:], '.'))"
    at = f"list_min(list_filter(range(1, len({labels}) + 1), lambda i: list_contains({listed(known)}, array_to_string({labels}[i:], '.'))))"
    return f"case when {at} > 1 then ({tails})[{at} - 1] else {d} end"


def slash(u):
    return f"case when {path(u)} = '' then '/' else {path(u)} end"


def canonical(u):
    return f"{scheme(u)} || '://' || {host(u)} || {slash(u)}"


def identity(u):
    return f"{bare(u)} || case when regexp_replace({path(u)}, '/+$', '') = '' then '/' else regexp_replace({path(u)}, '/+$', '') end"


def crawl(u):
    return f"{canonical(u)} || case when {query(u)} = '' then '' else '?' || {query(u)} end"


def path_query(u):
    return f"{slash(u)} || case when {query(u)} = '' then '' else '?' || {query(u)} end"


def link(u, h):
    h = f"trim({h})"
    root = f"{scheme(u)} || '://' || {authority(u)}"
    whole = f"""case when regexp_matches({h}, '^[A-Za-z][A-Za-z0-9+.-]*:') then {h} when starts_with({h}, '//') then {scheme(u)} || ':' || {h} when starts_with({h}, '/') then {root} || {h}
        when {h} = '' or starts_with({h}, '#') then {u} when starts_with({h}, '?') then {root} || {path(u)} || {h} else {root} || regexp_extract({slash(u)}, '^(.*/)', 1) || {h} end"""
    clean = f"regexp_replace({whole}, '#.*$', '')"
    return f"case when {scheme(clean)} in ('http', 'https') and {host(clean)} <> '' and not contains({authority(clean)}, '@') then {clean} end"


# --- text ---

SPACE = "[\\t\\n\\x0b\\f\\r ]+"


def compact(c):
    return f"trim(regexp_replace({c}, '\\s+', ' ', 'g'))"


def company_name(c):
    clean = f"trim(regexp_replace(replace(lower({c}), '&', ' and '), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
    return f"nullif(trim(regexp_replace(' ' || {clean}, '( ({'|'.join(T.LEGAL_SUFFIXES)}))+$', '')), '')"


def registry_name(c):
    clean = f"trim(regexp_replace(lower({c}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
    return f"trim(regexp_replace(' ' || {clean}, ' ({'|'.join(T.REGISTRY_SUFFIXES)})$', ''))"


def has_contact(c):
    return f"coalesce(regexp_matches({c}, '{T.EMAIL}') or regexp_matches({c}, '{T.PHONE}'), false)"


def fragment(c):
    return f"left(regexp_replace(regexp_replace({compact(c)}, '{T.EMAIL}', '[redacted]', 'g'), '{T.PHONE}', '\\1[redacted]', 'g'), 500)"


def words(c):
    return f"regexp_extract_all({c}, '[\\p{{L}}\\p{{N}}]+')"


def person(c):
    w = f"string_split({compact(c)}, ' ')"
    particles = listed(["van", "de", "der", "den", "von", "da", "di", "la", "le"])
    return f"""(len({w}) between 2 and 4 and len(list_filter({w}, lambda x: not (regexp_matches(x, '^\\p{{Lu}}[\\p{{L}}''-]*$') or list_contains({particles}, x)))) = 0
        and len(list_intersect(list_transform({w}, lambda x: lower(x)), {listed(T.BUSINESS_WORDS)})) = 0)"""


def plausible(c):
    w = words(f"lower({c})")
    labels = listed(["about", "contact", "diensten", "expertise", "home", "oplossingen", "services", "solutions", "welcome"])
    return f"(len({w}) > 0 and not list_contains({labels}, {w}[1]) and len(list_filter({w}, lambda x: not list_contains({listed([*T.GENERIC_WORDS, 'our', 'team', 'we'])}, x))) > 0 and not {has_contact(c)} and not {person(c)})"


def country_of(c):
    edge = "[^\\p{L}\\p{N}_]"
    return "coalesce(" + ", ".join(f"case when regexp_matches(lower({c}), '(^|{edge}){m}($|{edge})') then {quote(n)} end" for m, n in T.COUNTRY_MARKERS) + ")"


def tokens(c):
    return f"list_sort(list_distinct(list_filter({words(f'lower({c})')}, lambda w: length(w) > 1 and not list_contains({listed(T.SUMMARY_STOPWORDS)}, w))))"


def truncated(c, n):
    cut, back = f"left({c}, {n})", f"regexp_replace(left({c}, {n}), '[ \\n][^ \\n]*$', '')"
    return f"case when length({c}) <= {n} then {c} else regexp_replace(case when length({back}) < length({cut}) and length({back}) >= {int(n * 0.8)} then {back} else {cut} end, '\\s+$', '') end"


def cell(c, n):
    lines = f"array_to_string(list_transform(string_split(replace({c}, chr(13) || chr(10), chr(10)), chr(10)), lambda x: {compact('x')}), chr(10))"
    cut = f"left({lines}, {n})"
    return f"case when regexp_matches({cut}, '^[=+@-]') then left('''' || {cut}, {n}) else {cut} end"


def place(c):
    return f"regexp_replace({compact(f'lower({c})')}, '^the ', '')"


def unescape(c):
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        c = f"replace({c}, {quote(a)}, {quote(b)})"
    return c


def plain(c):
    return compact(unescape(f"regexp_replace({c}, '<[^>]+>', ' ', 'g')"))


RAW_TITLE = "regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)"
TITLE = plain(RAW_TITLE)


def without_noise(c):
    out = f"regexp_replace({c}, '(?is)<(script|style|noscript|template|svg|canvas|iframe)\\b[^>]*>.*?</(script|style|noscript|template|svg|canvas|iframe)>', ' ', 'g')"
    out = f"regexp_replace({out}, '(?s)<!--.*?-->', ' ', 'g')"
    return f"regexp_replace({out}, '(?is)<(nav|footer)\\b[^>]*>.*?</(nav|footer)>', ' ', 'g')"


HEADING = plain(f"regexp_extract({without_noise('html')}, '(?is)<h[1-6]\\b[^>]*>(.*?)</h[1-6]>', 1)")
NAV = f"""select page_id, url as base, unnest(regexp_extract_all(regexp_extract(html, '(?is)<nav\\b[^>]*>(.*?)</nav>', 1), '(?is)<a\\b[^>]*>.*?</a>')) as a,
    unnest(range(0, len(regexp_extract_all(regexp_extract(html, '(?is)<nav\\b[^>]*>(.*?)</nav>', 1), '(?is)<a\\b[^>]*>.*?</a>')))) as k from pages"""
LINKS = f"""select page_id, base, k, {link('base', unescape("regexp_extract(a, '(?is)href=\"([^\"]*)\"', 1)"))} as url, {plain('a')} as text from ({NAV})"""
NAVIGATION = f"select page_id, base, row_number() over (partition by page_id order by k) - 1 as pos, url, text from (select page_id, base, url, min(k) as k, arg_min(text, k) as text from ({LINKS}) where url is not null group by all)"
FACTS = f"""
    select {bare('url')} as entity_id, page_id as pos, 'company_name' as name, trim(regexp_extract({TITLE}, '^(.*?)(?:\\s+[|—–-]\\s+.*)?$', 1)) as value, url, 0.78::double as confidence from pages
    union all select {bare('url')}, page_id, 'company_name', {HEADING}, url, 0.70::double from pages
    union all select {bare('url')}, page_id, 'website_url', {scheme('url')} || '://' || lower({authority('url')}) || '/', url, 0.98::double from pages
    union all select {bare('url')}, page_id, 'country', {country_of(TITLE)}, url, 0.76::double from pages
    union all select {bare('base')}, page_id * 1000 + pos, 'services', text, base, 0.88::double from ({NAVIGATION})"""
FACT_ROWS = f"(select * from ({FACTS}) where value is not null and value <> '')"


KIND_LIST = ["/", "/about", "/services/web", "/over-ons", "/contact", "/than-x", "/blog/1", "/solutions?x=1", "/team/expertise"]
PATHS = {"about": ["about", "about-us", "company", "over-ons"], "services": ["services", "diensten"], "solutions": ["solutions", "oplossingen"], "expertise": ["expertise"], "contact": ["contact", "contact-us", "get-in-touch", "contacteer", "contactgegevens"]}
MARKERS = {"about": "about|about us|over ons", "services": "service|services|diensten", "solutions": "solution|solutions|oplossingen", "expertise": "expertise|specialisms|specialismen", "contact": "contact|contact us|get in touch|contacteer|contactgegevens"}
BONUS = {c: f"(case when regexp_matches(a, '{m}') then 20 else 0 end + case when regexp_matches(n, '{m}') then 15 else 0 end + case when regexp_matches(h, '{m}') then 10 else 0 end)" for c, m in MARKERS.items()}
CASES_PATH = "case when home then null " + " ".join(f"when len(list_intersect(seg, {listed(p)})) > 0 then '{c}'" for c, p in PATHS.items()) + " end"
CASES_TEXT = "case when home then null " + " ".join(f"when {b} > 0 then '{c}'" for c, b in BONUS.items()) + " end"
CASES_BONUS = "case category " + " ".join(f"when '{c}' then {b}" for c, b in BONUS.items()) + " else 0 end"
CASES_SCORE = "case category when 'homepage' then 1400 when 'about' then 1200 when 'services' then 1000 when 'solutions' then 800 when 'expertise' then 600 when 'contact' then 400 when 'relevant' then 200 else 0 end"


def conflict_key(name, value):
    low = f"lower({compact(value)})"
    url = f"{identity(value)} || case when {query(value)} = '' then '' else '?' || {query(value)} end"
    alias = "map {" + ", ".join(f"{quote(k)}: {quote(v)}" for k, v in T.COUNTRY_ALIASES.items()) + "}"
    return f"case when {name} in ('website_url', 'contact_page_url') then {url} when {name} = 'country' then coalesce(map_extract({alias}, {low})[1], {low}) when {name} = 'company_name' then regexp_replace({low}, '[^\\p{{L}}\\p{{N}}_]+', '', 'g') else {low} end"
