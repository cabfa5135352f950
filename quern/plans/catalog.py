"""Queries over the shared tables, one or more for each operator, named by inventory id; and SQL for the same rows.

Inputs stand in for the network: pages are crawled pages and search results, customers and suppliers are companies
and registries, nations and regions a gazetteer, events progress, documents texts of terms and evidence.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.functions import text, urls
from quern.operators import checks, enrich, entities, export, facts, pages, policy, scoring
from quern.plans import sql as S
from quern.sources import search
from quern.streaming import progress

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(oracle: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            SQL[f.__name__] = oracle
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def company_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers and customers as companies with names as people write them."""
    forms = F.array(*[F.lit(x) for x in S.FORMS])
    named = lambda t, k, n, nat, code: table(spark, sf_dir, t).select((F.col(k) * 2 + code).alias("id"), F.concat(F.replace(F.col(n), F.lit("#"), F.lit(" & ")), F.lit(" "), forms[(F.col(k) % len(S.FORMS)).cast("int")]).alias("name"), F.col(nat).alias("nationkey"))
    return named("supplier", "s_suppkey", "s_name", "s_nationkey", 0).union(named("customer", "c_custkey", "c_name", "c_nationkey", 1))


# --- urls ---------------------------------------------------------------------------------------------------


@query(f"""select page_id, {S.domain('url')} as domain, {S.domain("regexp_extract(url, '://(.*)$', 1)")} as bare, {S.domain("'ftp://' || url")} as other from pages""")
def url_01_normalize_domain(spark, sf_dir):
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", urls.normalize_domain(u).alias("domain"), urls.normalize_domain(F.regexp_extract(u, "://(.*)$", 1)).alias("bare"), urls.normalize_domain(F.concat(F.lit("ftp://"), u)).alias("other"))


@query(f"select page_id, {S.company_url('url')} as company_url, {S.company_url(S.WIDE_URL)} as wide from pages")
def url_03_normalize_company_url(spark, sf_dir):
    wide = F.concat(F.col("url"), F.when(F.contains("url", F.lit("?")), "&").otherwise("?"), F.lit("b=2&utm_medium=x&A=1&gclid=9&a=0&"))
    return table(spark, sf_dir, "pages").select("page_id", urls.normalize_company_url(F.col("url")).alias("company_url"), urls.normalize_company_url(F.regexp_replace(wide, "#[^?]*", "")).alias("wide"))


@query(f"select k, count(*) as n, bool_or(regexp_matches(k, '{S.TRACKING}')) as tracking from (select lower(split_part(unnest(string_split({S.query('url')}, '&')), '=', 1)) as k from pages) where k <> '' group by k")
def url_04_tracking_parameters(spark, sf_dir):
    keys = table(spark, sf_dir, "pages").select(F.explode(F.split(urls.query(F.col("url")), "&")).alias("p")).select(F.lower(F.split_part("p", F.lit("="), F.lit(1))).alias("k")).where("k <> ''")
    return keys.groupBy("k").agg(F.count("*").alias("n")).withColumn("tracking", urls.is_tracking(F.col("k")))


@query(f"select d as domain, {S.registrable('d', True)} as registrable, {S.registrable('d', False)} as public_only, n from (select {S.host('url')} as d, count(*) as n from pages group by 1 union all select 'tenant.github.io', 1 union all select 'shop.example.co.uk', 1)")
def url_05_registrable_domain(spark, sf_dir):
    hosts = table(spark, sf_dir, "pages").groupBy(urls.host(F.col("url")).alias("domain")).agg(F.count("*").alias("n"))
    more = spark.createDataFrame([("tenant.github.io", 1), ("shop.example.co.uk", 1)], "domain string, n long")
    return hosts.union(more).select("domain", urls.registrable_domain(F.col("domain")).alias("registrable"), urls.registrable_domain(F.col("domain"), private=False).alias("public_only"), "n")


@query(f"""select a.page_id, b.page_id as other, {S.registrable(S.host('a.url'), True)} = {S.registrable(S.host('b.url'), True)} as same_registrable, {S.bare('a.url')} = {S.bare('b.url')} as same_host
    from pages a join pages b on b.page_id = a.page_id + 1""")
def url_06_same_domain(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", "url")
    q = p.select((F.col("page_id") - 1).alias("page_id"), F.col("page_id").alias("other"), F.col("url").alias("b"))
    return p.join(q, "page_id").select("page_id", "other", urls.same_registrable_domain(F.col("url"), F.col("b")).alias("same_registrable"), urls.same_company_domain(F.col("url"), F.col("b")).alias("same_host"))


@query(f"select page_id, {S.canonical('url')} as canonical, {S.identity('url')} as identity, {S.crawl('url')} as crawl from pages")
def url_09_canonical_page_url(spark, sf_dir):
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", urls.canonical_page_url(u).alias("canonical"), urls.page_identity(u).alias("identity"), urls.crawl_url(u).alias("crawl"))


@query(f"""select page_id, k, {S.link('url', 'h')} as link from (select page_id, url, unnest({S.HREFS}) as h, unnest(range(1, 9)) as k from pages)""")
def url_11_http_link(spark, sf_dir):
    hrefs = F.array(*[F.lit(h) for h in S.HREF_LIST])
    each = table(spark, sf_dir, "pages").select("page_id", "url", F.posexplode(hrefs).alias("k", "h"))
    return each.select("page_id", (F.col("k") + 1).cast("long").alias("k"), urls.http_link(F.col("url"), F.col("h")).alias("link"))


@query(f"select page_id, array_to_string(list_filter(string_split(lower({S.path('url')}), '/'), lambda x: x <> ''), '|') as segments, {S.scheme('url')} || '://' || lower({S.authority('url')}) as origin, {S.scheme('url')} || '://' || lower({S.authority('url')}) || '/robots.txt' as robots, {S.path_query('url')} as target from pages")
def url_12_path_segments(spark, sf_dir):
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(urls.path_segments(u), "|").alias("segments"), urls.origin(u).alias("origin"), urls.robots_url(u).alias("robots"), urls.path_and_query(u).alias("target"))


@query(f"""select page_id, k, regexp_matches({S.scheme('u')}, '^https?$') and not contains({S.authority('u')}, '@') and {S.port('u')} in ('', '80', '443') and not ({S.host('u')} in ('', 'localhost') or regexp_matches({S.host('u')}, '\\.(localhost|local|internal)$')
    or (regexp_matches({S.host('u')}, '{urls.ADDRESS}') and regexp_matches({S.host('u')}, '{urls.PRIVATE_ADDRESS}'))) as public
    from (select page_id, k, replace(url, {S.host('url')}, h) as u from (select page_id, url, unnest({S.HOSTS}) as h, unnest(range(1, 9)) as k from pages))""")
def url_16_public_url(spark, sf_dir):
    each = table(spark, sf_dir, "pages").select("page_id", "url", F.posexplode(F.array(*[F.lit(h) for h in S.HOST_LIST])).alias("k", "h"))
    return each.select("page_id", (F.col("k") + 1).cast("long").alias("k"), urls.is_public_http(F.replace("url", urls.host(F.col("url")), F.col("h"))).alias("public"))


@query("select n_nationkey, h as hint, case when regexp_matches(h, '^[A-Za-z]{2}$') then upper(h) when regexp_matches(h, '\\([A-Za-z]{2}\\)$') then upper(regexp_extract(h, '\\(([A-Za-z]{2})\\)$', 1)) else map_extract(" + S.COUNTRY_MAP + ", lower(h))[1] end as code from (select n_nationkey, case n_nationkey % 3 when 0 then n_name when 1 then substr(n_name, 1, 2) else n_name || ' (' || lower(substr(n_name, 1, 2)) || ')' end as h from nation)")
def url_18_country_code(spark, sf_dir):
    hint = F.when(F.col("n_nationkey") % 3 == 0, F.col("n_name")).when(F.col("n_nationkey") % 3 == 1, F.substring("n_name", 1, 2)).otherwise(F.concat("n_name", F.lit(" ("), F.lower(F.substring("n_name", 1, 2)), F.lit(")")))
    return table(spark, sf_dir, "nation").select("n_nationkey", hint.alias("hint"), urls.country_code_from_hint(hint).alias("code"))


# --- text ---------------------------------------------------------------------------------------------------


@query("select p_partkey, nullif(regexp_replace(regexp_replace(lower(p_name || ' ' || p_type), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), '') as field from part")
def str_01_field_name(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", text.normalize_field_name(F.concat_ws(" ", "p_name", "p_type")).alias("field"))


@query(f"select doc_id, md5({S.compact('text')}) as compacted, md5({S.compact("replace(lower(text), '-', ' ')")}) as normalized from documents")
def str_02_compact(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.compact(F.col("text"))).alias("compacted"), F.md5(text.normalized_text(F.col("text"))).alias("normalized"))


@query(f"select id, {S.company_name('name')} as norm_name, {S.registry_name('name')} as registry from ({S.COMPANIES})")
def str_04_company_name(spark, sf_dir):
    c = company_names(spark, sf_dir)
    return c.select("id", text.normalize_company_name(F.col("name")).alias("norm_name"), text.registry_name(F.col("name")).alias("registry"))


@query(f"select doc_id, {S.has_contact('text')} as has_contact, md5({S.fragment('text')}) as fragment from documents")
def str_06_redacted_fragment(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.contains_contact(F.col("text")).alias("has_contact"), F.md5(text.compact_fragment(F.col("text"))).alias("fragment"))


@query("select p_partkey, len(list_filter(" + S.listed(text.PERSONAL_MARKERS) + ", lambda m: contains(f, m))) > 0 as personal from (select p_partkey, lower(p_name) || case p_partkey % 4 when 0 then '_owner_count' when 1 then '_phone' else '' end as f from part)")
def str_08_personal_field(spark, sf_dir):
    name = F.concat(F.lower("p_name"), F.when(F.col("p_partkey") % 4 == 0, "_owner_count").when(F.col("p_partkey") % 4 == 1, "_phone").otherwise(""))
    return table(spark, sf_dir, "part").select("p_partkey", text.is_personal_field(name).alias("personal"))


@query(f"select page_id, {S.person('t')} as person, {S.plausible('t')} as plausible from (select page_id, array_to_string(string_split({S.TITLE}, ' ')[1:(page_id % 4)::int + 1], ' ') as t from pages)")
def str_09_person_name(spark, sf_dir):
    t = F.array_join(F.slice(F.split(pages.title(F.col("html")), " "), F.lit(1), (F.col("page_id") % 4).cast("int") + 1), " ")
    return table(spark, sf_dir, "pages").select("page_id", text.looks_like_person_name(t).alias("person"), text.plausible_company_name(t).alias("plausible"))


@query("select n_nationkey, " + S.country_of("t") + " as country from (select n_nationkey, 'Offices in ' || lower(n_name) || case when n_nationkey % 5 = 0 then ', Duitsland' else '' end as t from nation)")
def str_11_country_from_text(spark, sf_dir):
    t = F.concat(F.lit("Offices in "), F.lower("n_name"), F.when(F.col("n_nationkey") % 5 == 0, ", Duitsland").otherwise(""))
    return table(spark, sf_dir, "nation").select("n_nationkey", text.country_from_text(t).alias("country"))


@query(f"select doc_id, len(t) as n, md5(array_to_string(t, ' ')) as tokens from (select doc_id, {S.tokens('text')} as t from documents)")
def str_12_content_tokens(spark, sf_dir):
    t = text.content_tokens(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(t).cast("long").alias("n"), F.md5(F.array_join(t, " ")).alias("tokens"))


@query("select p_partkey, array_to_string(list_filter(regexp_extract_all(lower(p_name || ' company of ' || p_type), '[\\p{L}\\p{N}]+'), lambda w: not list_contains(regexp_extract_all(lower(p_brand), '[\\p{L}\\p{N}]+'), w) and not list_contains(" + S.listed(text.TOPIC_STOPWORDS) + ", w)), ' ') as terms from part where len(list_distinct(regexp_extract_all(lower(p_name || ' ' || p_type), '[\\p{L}\\p{N}]+'))) = len(regexp_extract_all(lower(p_name || ' ' || p_type), '[\\p{L}\\p{N}]+'))")
def str_13_topic_terms(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    words = F.regexp_extract_all(F.lower(F.concat_ws(" ", "p_name", "p_type")), F.lit(text.WORD), 0)
    return p.where(F.size(F.array_distinct(words)) == F.size(words)).select("p_partkey", F.array_join(text.topic_terms(F.concat("p_name", F.lit(" company of "), "p_type"), F.col("p_brand")), " ").alias("terms"))


@query(f"select doc_id, length(c) as n, md5(c) as cut from (select doc_id, {S.truncated('text', 400)} as c from documents)")
def str_14_truncate(spark, sf_dir):
    c = text.truncate_text(F.col("text"), 400)
    return table(spark, sf_dir, "documents").select("doc_id", F.length(c).cast("long").alias("n"), F.md5(c).alias("cut"))


@query("select c_custkey, cast(floor((2 * 5 * part + total) / (2 * total)) as bigint) as points from (select c_custkey, c_custkey % 8 as part, 7 as total from customer)")
def str_19_round_ratio(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", text.round_ratio(5, F.col("c_custkey") % 8, F.lit(7)).cast("long").alias("points"))


@query("""select page_id, '"' || replace(replace(replace(replace(replace(t, '\\', '\\\\'), '"', '\\"'), chr(10), '\\n'), chr(13), '\\r'), chr(9), '\\t') || '"' as literal from (select page_id, html as t from pages)""")
def str_20_sparql_literal(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.sparql_string(F.col("html")).alias("literal"))


@query("select c_custkey, '[redacted]' as api_key, c_name as name from customer")
def str_21_redact_secrets(spark, sf_dir):
    m = text.redact_secrets(F.create_map(F.lit("Api_Key"), F.concat(F.lit("k"), "c_custkey"), F.lit("name"), F.col("c_name")))
    return table(spark, sf_dir, "customer").select("c_custkey", m["Api_Key"].alias("api_key"), m["name"].alias("name"))


@query("select page_id, sha256(html) as sha256 from pages")
def str_23_response_hash(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.sha2("html", 256).alias("sha256"))


@query("""select s_suppkey, case s_suppkey % 3 when 2 then null else 'Q' || s_suppkey end as wikidata, case s_suppkey % 3 when 2 then null else 'nl/' || s_suppkey end as registry from supplier""")
def str_25_identifiers(spark, sf_dir):
    k, n = F.col("s_suppkey") % 3, F.col("s_suppkey").cast("string")
    wiki = F.when(k == 0, F.concat(F.lit("https://www.wikidata.org/entity/q"), n)).when(k == 1, F.concat(F.lit(" q"), n)).otherwise(F.concat(F.lit("https://example.com/wiki/Q"), n))
    reg = F.when(k == 0, F.concat(F.lit("https://opencorporates.com/companies/NL/"), n)).when(k == 1, F.concat(F.lit("nl / "), n)).otherwise(F.concat(F.lit("nl-"), n))
    return table(spark, sf_dir, "supplier").select("s_suppkey", text.wikidata_id(wiki).alias("wikidata"), text.registry_id(reg).alias("registry"))


@query(f"select n_nationkey, {S.place("' The  ' || n_name")} as place from nation")
def str_26_normalized_place(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", text.normalized_place(F.concat(F.lit(" The  "), "n_name")).alias("place"))


@query(None)
def str_casefold_and_forms(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.md5(text.casefold(F.col("text"))).alias("folded"), F.md5(text.compatibility_form(F.col("text"))).alias("nfkc"))


# --- sources and sinks --------------------------------------------------------------------------------------


def responses(spark, sf_dir) -> DataFrame:
    """Search responses: twenty results each, a query a host name's first letter."""
    p = table(spark, sf_dir, "pages").select("page_id", "url", F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1).alias("title"))
    w = Window.partitionBy("query").orderBy("page_id")
    numbered = p.withColumn("query", F.substring(urls.without_www(urls.host(F.col("url"))), 1, 3)).withColumn("k", F.row_number().over(w) - 1)
    rows = F.transform(F.array_sort(F.collect_list(F.struct("k", "title", "url"))), lambda x: F.struct(x["title"].alias("title"), x["url"].alias("url")))
    return numbered.groupBy("query", F.floor(F.col("k") / 20).cast("int").alias("offset")).agg(F.to_json(rows).alias("body")).withColumn("count", F.lit(20))


@query(f"""select query, cast(k as int) as rank, title, url, domain, 'brave' as provider from (select {S.bare('url')}[1:3] as query, row_number() over (partition by {S.bare('url')}[1:3] order by page_id) as k, {S.TITLE} as title, url, {S.domain(S.host('url'))} as domain from pages) where title <> '' and domain is not null""")
def src_03_search_with_pages(spark, sf_dir):
    return search.resolve("brave")(responses(spark, sf_dir))


@query(f"""select query, cast(k as int) as rank, title, url, domain, 'tavily' as provider from (select {S.bare('url')}[1:3] as query, row_number() over (partition by {S.bare('url')}[1:3] order by page_id) as k, trim({S.RAW_TITLE}) as title, url, {S.domain(S.host('url'))} as domain from pages) where title <> '' and domain is not null and k <= 20""")
def src_02_search_without_pages(spark, sf_dir):
    return search.resolve(None)(responses(spark, sf_dir))


@query(f"""select query, cast(k as int) as rank, url from (select {S.bare('url')}[1:3] as query, row_number() over (partition by {S.bare('url')}[1:3] order by page_id) as k, {S.TITLE} as title, url, {S.domain(S.host('url'))} as d from pages) where title <> '' and d is not null and k between 6 and 10""")
def src_04_search_slice(spark, sf_dir):
    return search.in_memory(search.resolve("brave")(responses(spark, sf_dir)), 1, 5).select("query", "rank", "url")


@query("select event_id, event_type, epoch_us(ts) as us from events where user_id = (select min(user_id) from events)")
def src_12_records_of_run(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    first = e.agg(F.min("user_id").alias("user_id"))
    return e.join(F.broadcast(first), "user_id").orderBy("ts", "event_id").select("event_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))  # first: one row


@query("select s_suppkey as id, case when s_suppkey % 2 = 0 then s_acctbal + 1 else s_acctbal end as value, case when s_suppkey % 2 = 0 then 'old' else 'old' end as created_at from supplier union all select c_custkey + 1000000000, c_acctbal, 'new' from customer where c_custkey % 10 = 0")
def snk_01_upsert(spark, sf_dir):
    s, c = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "customer")
    now = s.select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("value"), F.lit("old").alias("created_at"))
    changes = now.where("id % 2 = 0").select("id", (F.col("value") + 1).alias("value"), F.lit("new").alias("created_at")).union(c.where("c_custkey % 10 = 0").select(F.col("c_custkey") + 1_000_000_000, "c_acctbal", F.lit("new")))
    return export.upserted(now, changes)


@query(f"""select {S.host('url')} as domain, url, case when regexp_matches(lower(r), 'blocked|rejected|not approved|not allowed') then 'rejected' else 'skipped' end as decision, r as reason,
    case when contains(lower(r), 'robot') then 'see reason' else 'not recorded' end as robots_status, case when contains(lower(r), 'term') then 'see reason' else 'not recorded' end as terms_status
    from (select url, case page_id % 4 when 0 then 'Domain is blocked.' when 1 then 'Robots: not allowed.' when 2 then 'Terms need a review.' else 'Fetch failed.' end as r from pages)""")
def snk_06_skipped_rows(spark, sf_dir):
    k = F.col("page_id") % 4
    reason = F.when(k == 0, "Domain is blocked.").when(k == 1, "Robots: not allowed.").when(k == 2, "Terms need a review.").otherwise("Fetch failed.")
    return export.skipped_rows(table(spark, sf_dir, "pages").select("url", reason.alias("reason")))


@query(f"select doc_id, md5({S.cell('t', 120)}) as cell, md5(case when regexp_matches(ltrim(t, chr(9) || chr(10) || chr(13) || ' '), '^[=+@-]') then '''' || t else t end) as guarded from (select doc_id, case doc_id % 3 when 0 then '=1+' || text when 1 then ' -' || text else text end as t from documents)")
def snk_08_cells(spark, sf_dir):
    k = F.col("doc_id") % 3
    t = F.when(k == 0, F.concat(F.lit("=1+"), "text")).when(k == 1, F.concat(F.lit(" -"), "text")).otherwise(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.spreadsheet_cell(t, 120)).alias("cell"), F.md5(text.csv_guard(t)).alias("guarded"))


@query("select unnest(['topic', 'requested result count', 'completed result count', 'generated queries', 'start time', 'completion time', 'providers', 'strict compliance mode', 'warnings']) as key, unnest(['agencies', '10', cast(n as varchar), 'a' || chr(10) || 'b', 's', 'e', 'tavily', 'true', '']) as value from (select count(*) as n from supplier)")
def snk_07_metadata_rows(spark, sf_dir):
    run = table(spark, sf_dir, "supplier").agg(F.count("*").alias("completed")).select(F.lit("agencies").alias("topic"), F.lit(10).alias("requested"), "completed", F.lit("a\nb").alias("queries"), F.lit("s").alias("started"), F.lit("e").alias("ended"), F.lit("tavily").alias("providers"), F.lit(True).alias("strict"), F.lit("").alias("warnings"))
    return export.metadata_rows(run)


# --- policy -------------------------------------------------------------------------------------------------

RULES = [("blocked", "subdomains", "spam-farm.example.org"), ("blocked", "exact", "therti.example.org"), ("approved", "subdomains", "example.net"), ("approved", "exact", "www.ththen.example.com"), ("approved", "subdomains", "tionsh.example.net"), ("candidate", "subdomains", "example.com")]


@query(f"""with rules(l, kind, rule) as (values {', '.join(str(r) for r in RULES)}),
    own as (select page_id, case page_id % 20 when 0 then 'localhost' when 1 then 'http://10.0.0.1/' else url end as source from pages),
    named as (select page_id, {S.domain('source')} as domain from own),
    hits as (select page_id, domain, l, kind, rule, case l when 'blocked' then 3 when 'approved' then 2 else 1 end as o, kind = 'exact' as e, length(rule) as n from named join rules on
        (kind = 'exact' and regexp_replace(domain, '^www\\.', '') = regexp_replace(rule, '^www\\.', '')) or (kind = 'subdomains' and (domain = rule or ends_with(domain, '.' || rule)))),
    best as (select page_id, arg_max(struct_pack(l := l, rule := rule), struct_pack(o := o, e := e, n := n)) as b from hits group by 1)
    select page_id, domain, case when domain is null or b.l = 'blocked' then 'rejected' when b.l = 'approved' then 'approved' else 'manual_review_required' end as decision, case when domain is null then 'malformed' else coalesce(b.l, 'unknown') end as reason, b.rule as rule
    from named left join best using (page_id)""")
def flt_01_source_policy(spark, sf_dir):
    k = F.col("page_id") % 20
    own = table(spark, sf_dir, "pages").select("page_id", F.when(k == 0, "localhost").when(k == 1, "http://10.0.0.1/").otherwise(F.col("url")).alias("source"))
    return policy.source_policy(own, spark.createDataFrame(RULES, "list string, kind string, rule string")).drop("source")


@query(f"""select page_id, case when regexp_replace({S.domain('d')}, '^www\\.', '') = {S.host(S.company_url('u'))} and len(list_intersect(list_filter(string_split(lower({S.path(S.company_url('u'))}), '/'), lambda x: x <> ''), {S.listed(policy.DIRECTORY_SEGMENTS)})) = 0
    and not regexp_matches(lower(t), 'business directory|company directory|find companies|marketplace listing') then 'https://' || {S.authority(S.company_url('u'))} || '/' end as website
    from (select page_id, {S.host('url')} as d, case page_id % 5 when 0 then replace(url, '/en/', '/directory/') else url end as u, case page_id % 7 when 0 then 'Company  Directory' else {S.TITLE} end as t from pages) where true""".replace("lower(t)", "regexp_replace(lower(t), '\\s+', ' ', 'g')"))
def flt_02_official_website(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    u = F.when(F.col("page_id") % 5 == 0, F.replace("url", F.lit("/en/"), F.lit("/directory/"))).otherwise(F.col("url"))
    t = F.when(F.col("page_id") % 7 == 0, "Company  Directory").otherwise(pages.title(F.col("html")))
    return p.select("page_id", policy.official_website(u, urls.host(F.col("url")), t).alias("website"))


@query(f"""select page_id, k, not (len(list_intersect(seg, {S.listed(policy.RESTRICTED_SEGMENTS)})) > 0 or len(list_intersect(flatten(list_transform(seg, lambda s: string_split_regex(s, '[^a-z0-9]+'))), {S.listed(policy.RESTRICTED_TOKENS)})) > 0
    or len(list_intersect(list_transform(string_split({S.query('u')}, '&'), lambda q: lower(split_part(q, '=', 1))), {S.listed(policy.SEARCH_KEYS)})) > 0 or regexp_matches(p, 'customer-data|customer_data|internal-search|internal_search')
    or regexp_matches(regexp_extract(regexp_replace(p, '/+$', ''), '([^/]*)$', 1), '(\\.7z|\\.pdf|\\.zip|\\.xml|\\.csv|\\.png|\\.jpg)$')) as safe
    from (select page_id, k, u, lower({S.path('u')}) as p, list_filter(list_transform(string_split(lower({S.path('u')}), '/'), lambda s: trim(s)), lambda s: s <> '') as seg
    from (select page_id, k, regexp_replace(url, '[?#].*$', '') || s as u from (select page_id, url, unnest({S.SUFFIX_PATHS}) as s, unnest(range(1, 9)) as k from pages)))""")
def flt_03_safe_path(spark, sf_dir):
    each = table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", "[?#].*$", "").alias("b"), F.posexplode(F.array(*[F.lit(x) for x in S.SUFFIX_PATH_LIST])).alias("k", "s"))
    return each.select("page_id", (F.col("k") + 1).cast("long").alias("k"), policy.is_safe_path(F.concat("b", "s")).alias("safe"))


@query("select page_id, regexp_matches(left(h, 250000), '(?i)(\\bcaptcha\\b|verify (?:that )?you are (?:a )?human|checking your browser before accessing|bot[- ]protection)') as challenge, case when st in (401, 403, 429) then 'blocked' when st not between 200 and 299 then 'status' when ct not in ('text/html', 'application/xhtml+xml', 'text/plain') then 'content_type' when length(h) > 5000 then 'oversize' end as reason from (select page_id, html || case page_id % 6 when 0 then 'please solve this CAPTCHA now' when 1 then 'Bot-protection' else '' end as h, case page_id % 7 when 0 then 403 when 1 then 500 else 200 end as st, case page_id % 5 when 0 then 'image/png' else 'text/html' end as ct from pages)")
def flt_04_responses(spark, sf_dir):
    k = F.col("page_id")
    h = F.concat("html", F.when(k % 6 == 0, "please solve this CAPTCHA now").when(k % 6 == 1, "Bot-protection").otherwise(""))
    status, kind = F.when(k % 7 == 0, 403).when(k % 7 == 1, 500).otherwise(200), F.when(k % 5 == 0, "image/png").otherwise("Text/HTML; charset=utf-8")
    return table(spark, sf_dir, "pages").select("page_id", policy.has_challenge(h).alias("challenge"), policy.response_reason(status, kind, F.length(h), 5000).alias("reason"))


TERMS_TEXT = "case doc_id % 4 when 0 then 'Scraping is prohibited here. ' || t when 1 then 'Robots welcome. ' || t || ' You must not copy.' when 2 then t else 'data extraction ' || left(t, 60) || ' is not permitted' end"


@query(f"""with d as (select doc_id, {TERMS_TEXT} as t from (select doc_id, text as t from documents)),
    m as (select doc_id, t, unnest(regexp_extract_all('x ' || t, '(?is)(.*?)(?:{policy.AUTOMATION})', 1)) as before from d),
    a as (select doc_id, sum(length(b) + length(w)) over (partition by doc_id order by k) - length(w) as at from (select doc_id, unnest(regexp_extract_all(t, '(?is)(.*?)({policy.AUTOMATION})', 1)) as b, unnest(regexp_extract_all(t, '(?is)(.*?)({policy.AUTOMATION})', 2)) as w, unnest(range(1, 1 + len(regexp_extract_all(t, '(?is)(.*?)({policy.AUTOMATION})', 1)))) as k from d)),
    p as (select doc_id, sum(length(b) + length(w)) over (partition by doc_id order by k) - length(w) as at from (select doc_id, unnest(regexp_extract_all(t, '(?is)(.*?)({policy.PROHIBITION})', 1)) as b, unnest(regexp_extract_all(t, '(?is)(.*?)({policy.PROHIBITION})', 2)) as w, unnest(range(1, 1 + len(regexp_extract_all(t, '(?is)(.*?)({policy.PROHIBITION})', 1)))) as k from d))
    select doc_id, case when not exists (select 1 from a where a.doc_id = d.doc_id) then 'approved' when exists (select 1 from a join p on a.doc_id = p.doc_id and abs(a.at - p.at) <= 180 where a.doc_id = d.doc_id) then 'potential_automated_access_prohibition' else 'ambiguous_automation_language' end as signal from d""")
def flt_13_terms_signal(spark, sf_dir):
    k, t = F.col("doc_id") % 4, F.col("text")
    made = F.when(k == 0, F.concat(F.lit("Scraping is prohibited here. "), t)).when(k == 1, F.concat(F.lit("Robots welcome. "), t, F.lit(" You must not copy."))).when(k == 2, t).otherwise(F.concat(F.lit("data extraction "), F.substring(t, 1, 60), F.lit(" is not permitted "), F.substr(t, F.lit(61))))
    return table(spark, sf_dir, "documents").select("doc_id", policy.terms_signal(made).alias("signal"))


ROBOTS = "User-agent: alpha\nUser-agent: beta\nDisallow: /en/*.html$\nAllow: /en/1\n\nUser-agent: *\nDisallow: /fr\nDisallow: /de/7*\nAllow: /fr/2 # note\nDisallow:\nUser-agent: gamma\nDisallow: /\n"


@query(f"""with t as (select distinct {S.scheme('url')} || '://' || lower({S.authority('url')}) as origin, unnest(['alpha', 'delta', 'gamma']) as agent, {S.path_query('url')} as path from pages)
    select origin, agent, path, case agent
        when 'alpha' then case when regexp_matches(path, '^/en/.*\\.html$') then 'rejected' else 'approved' end
        when 'delta' then case when starts_with(path, '/fr/2') then 'approved' when starts_with(path, '/fr') or starts_with(path, '/de/7') then 'rejected' else 'approved' end
        else 'rejected' end as decision from t""")
def tvf_14_robots_decisions(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    targets = p.select(urls.origin(F.col("url")).alias("origin"), F.explode(F.array(F.lit("alpha"), F.lit("delta"), F.lit("gamma"))).alias("agent"), urls.path_and_query(F.col("url")).alias("path"))
    robots = targets.select("origin").distinct().withColumn("body", F.lit(ROBOTS.replace("Disallow:\nUser-agent: gamma", "User-agent: gamma")))
    return policy.robots_decisions(policy.robots_rules(robots), targets)


@query("select c_custkey, case when not ok or st >= 500 then 'rejected' when st in (404, 410) then 'approved' when st between 200 and 299 then case when n > 512000 then 'manual_review_required' else 'parse' end else 'manual_review_required' end as decision from (select c_custkey, c_custkey % 11 <> 0 as ok, [200, 404, 410, 301, 503, 204][c_custkey % 6 + 1] as st, c_custkey * 1000 as n from customer)")
def dec_02_robots_fetch(spark, sf_dir):
    st = F.array(*[F.lit(x) for x in (200, 404, 410, 301, 503, 204)])[(F.col("c_custkey") % 6).cast("int")]
    return table(spark, sf_dir, "customer").select("c_custkey", policy.robots_fetch(st, F.col("c_custkey") % 11 != 0, F.col("c_custkey") * 1000).alias("decision"))


@query("select event_id, case when event_id % 5 = 0 then 'rejected' when event_id % 7 = 0 then 'manual_review_required' when event_id % 11 = 0 then 'rejected' when event_id % 13 = 0 or event_id % 3 = 0 then 'manual_review_required' else 'approved' end as decision from events")
def dec_01_preflight(spark, sf_dir):
    k = F.col("event_id")
    checks = table(spark, sf_dir, "events").select(
        "event_id", F.when(k % 5 == 0, "rejected").otherwise("approved").alias("domain_decision"), F.when(k % 7 == 0, "manual_review_required").otherwise("approved").alias("robots_decision"), (k % 11 != 0).alias("page_ok"),
        F.array(F.lit("approved"), F.when(k % 3 == 0, "manual_review_required").otherwise("approved")).alias("terms_decisions"), (k % 13 == 0).alias("terms_truncated"),
    )
    return policy.preflight(checks).select("event_id", "decision")


@query(f"""select domain, decision from (select {S.host('url')} as domain, arg_max(case page_id % 3 when 0 then 'approve' when 1 then 'reject' else 'remove' end, page_id) as decision from pages group by 1) where decision <> 'remove'""")
def rev_02_latest_reviews(spark, sf_dir):
    k = F.col("page_id") % 3
    log = table(spark, sf_dir, "pages").select(urls.host(F.col("url")).alias("domain"), F.when(k == 0, "approve").when(k == 1, "reject").otherwise("remove").alias("decision"), F.col("page_id").alias("seq"))
    return policy.latest_reviews(log)


# --- pages --------------------------------------------------------------------------------------------------


@query(f"select page_id, {S.TITLE} as title, {S.HEADING} as heading, md5({S.plain(S.without_noise('html'))}) as main_text, url as canonical from pages")
def tvf_02_page_content(spark, sf_dir):
    h = F.col("html")
    return table(spark, sf_dir, "pages").select("page_id", pages.title(h).alias("title"), F.get(pages.headings(h), F.lit(0)).alias("heading"), F.md5(pages.plain(pages.without_noise(h))).alias("main_text"), pages.canonical_url(h, F.col("url")).alias("canonical"))


@query("""with p as (select page_id, '<head><link href="/home" rel="canonical"><meta name="description" content="A &amp; B"><meta property="og:title" content="first"><meta property="og:title" content="t' || page_id || '"></head>' || html as html, url from pages)
    select page_id, """ + S.scheme("url") + " || '://' || " + S.authority("url") + """ || '/home' as canonical, 'A & B' as description, 't' || page_id as og_title from p""")
def tvf_04_meta(spark, sf_dir):
    head = F.concat(F.lit('<head><link href="/home" rel="canonical"><meta name="description" content="A &amp; B"><meta property="og:title" content="first"><meta property="og:title" content="t'), F.col("page_id").cast("string"), F.lit('"></head>'), F.col("html"))
    p = table(spark, sf_dir, "pages").withColumn("html", head)
    h = F.col("html")
    return p.select("page_id", pages.canonical_url(h, F.col("url")).alias("canonical"), pages.meta_content(h, "description").alias("description"), pages.open_graph(h)["title"].alias("og_title"))


@query(f"select page_id, pos, url, text from ({S.NAVIGATION})")
def tvf_05_navigation_links(spark, sf_dir):
    return pages.navigation_links(table(spark, sf_dir, "pages"))


@query(f"select page_id, count(*) as links from ({S.NAVIGATION}) group by page_id")
def tvf_11_discovered_links(spark, sf_dir):
    found = pages.navigation_links(table(spark, sf_dir, "pages"))
    return found.where(policy.is_safe_path(F.col("url"))).groupBy("page_id").agg(F.count("*").alias("links"))


@query(None)
def tvf_07_text_blocks(spark, sf_dir):
    b = pages.text_blocks(table(spark, sf_dir, "pages"))
    return b.groupBy("page_id").agg(F.count("*").alias("blocks"), F.sum((F.col("kind") == "heading").cast("long")).alias("headings"), F.sum(F.length("text")).alias("chars"))


@query(None)
def srt_08_bounded_blocks(spark, sf_dir):
    b = pages.bounded_blocks(pages.text_blocks(table(spark, sf_dir, "pages")), 600)
    return b.groupBy("page_id").agg(F.count("*").alias("blocks"), (F.sum(F.length("text") + 1) - 1).alias("chars"))


@query("""select conv_id, turn, greatest(0, least(length(text), 500 - coalesce(sum(length(text)) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding), 0)))::bigint as kept_chars from conversations""")
def srt_09_bounded_turns(spark, sf_dir):
    return pages.bounded_turns(table(spark, sf_dir, "conversations"), 500, "conv_id", "turn").select("conv_id", "turn", F.col("kept_chars").cast("long").alias("kept_chars"))


@query(f"select page_id, {S.TITLE} as title, md5(array_to_string([{S.HEADING}], '|')) as headings from pages")
def tvf_02_parser_pages(spark, sf_dir):
    p = pages.parsed_pages(table(spark, sf_dir, "pages"))
    return p.select("page_id", "title", F.md5(F.array_join(F.slice("headings", 1, 1), "|")).alias("headings"))


def page_candidates(spark, sf_dir) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    kinds = F.array(*[F.lit(x) for x in S.KIND_LIST])
    u = F.concat(urls.scheme(F.col("url")), F.lit("://"), urls.authority(F.col("url")), kinds[(F.col("page_id") % len(S.KIND_LIST)).cast("int")])
    return p.select(
        F.concat(F.lit("https://"), urls.without_www(urls.host(F.col("url"))), F.lit("/")).alias("homepage_url"), u.alias("url"), F.when(F.col("page_id") % 3 == 0, "Our Services").otherwise("more").alias("anchor_text"),
        pages.title(F.col("html")).alias("title"), pages.headings(F.col("html")).alias("headings"), F.when(F.col("page_id") % 2 == 0, (F.col("page_id") % 30).cast("int")).alias("navigation_position"), F.col("page_id").alias("pos"),
    )


@query(f"""with c as (select 'https://' || {S.bare('url')} || '/' as homepage_url, {S.scheme('url')} || '://' || {S.authority('url')} || {S.listed(S.KIND_LIST)}[(page_id % {len(S.KIND_LIST)})::int + 1] as url, page_id,
        case when page_id % 3 = 0 then 'Our Services' else 'more' end as anchor, {S.TITLE} as title, {S.HEADING} as head, case when page_id % 2 = 0 then (page_id % 30)::int end as nav from pages),
    m as (select homepage_url, {S.identity('url')} as identity, arg_min(url, page_id) as url, arg_max(anchor, (length(anchor), -page_id)) as anchor, arg_max(title, (length(title), -page_id)) as title, string_agg(head, ' ' order by page_id) as heads, min(nav) as nav from c group by 1, 2),
    t as (select *, list_filter(string_split(lower({S.path('url')}), '/'), lambda x: x <> '') as seg, {S.compact("replace(lower(anchor), '-', ' ')")} as a, {S.compact("replace(lower(title), '-', ' ')")} as n, {S.compact("replace(lower(heads), '-', ' ')")} as h, identity = {S.identity('homepage_url')} as home from m),
    p as (select *, {S.CASES_PATH} as by_path, {S.CASES_TEXT} as by_text, contains({S.compact("replace(lower(" + S.path('url') + " || ' ' || anchor || ' ' || title || ' ' || heads), '-', ' ')")}, 'than')::int as terms from t),
    k as (select *, case when home then 'homepage' else coalesce(by_path, by_text, case when terms > 0 then 'relevant' end, 'other') end as category from p),
    s as (select *, ({S.CASES_SCORE} + case when home then 0 when category = 'relevant' then least(40, 10 * terms) else {S.CASES_BONUS} + case when by_path is not null then 40 else 0 end end + case when nav is null then 0 else greatest(1, 25 - least(nav, 24)) end)::int as score from k)
    select homepage_url, identity, url, category, score, rank from (select *, row_number() over (partition by homepage_url order by score desc, url)::int as rank from s) where rank <= 5""")
def srt_02_ranked_pages(spark, sf_dir):
    return pages.ranked_pages(page_candidates(spark, sf_dir), ["than"], 5).select("homepage_url", "identity", "url", "category", "score", "rank")


# --- planning and runs --------------------------------------------------------------------------------------


@query("""with b as (select n_nationkey, n_name as loc, case n_nationkey % 3 when 0 then 'Shopify agency' when 1 then 'Web design companies in the ' || n_name else 'Data  consulting' end as topic from nation),
    t as (select *, trim(regexp_replace(topic, '\\s+', ' ', 'g')) as tp from b), u as (select *, trim(regexp_replace(tp, '(?i)\\s+in\\s+(the\\s+)?' || loc || '$', '')) as bare from t),
    v as (select *, coalesce(nullif(trim(regexp_replace(bare, '(?i)\\s+(agency|agencies|company|companies|provider|providers|services?)$', '')), ''), bare) as subj from u)
    select n_nationkey, unnest([case when bare <> tp then tp else tp || ' ' || loc end, case when lower(subj) = 'shopify' then subj || ' Plus agency ' || loc else subj || ' specialist agency ' || loc end, subj || ' development company ' || loc, subj || ' ecommerce agency ' || loc, 'site:.nl ' || subj || ' agency']) as query, unnest([0, 1, 2, 3, 4])::bigint as pos from v""")
def tvf_01_planned_queries(spark, sf_dir):
    from quern.plans import research

    k = F.col("n_nationkey") % 3
    briefs = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("location"), F.when(k == 0, "Shopify agency").when(k == 1, F.concat(F.lit("Web design companies in the "), "n_name")).otherwise("Data  consulting").alias("topic"))
    planned = research.planned_queries(F.col("topic"), F.col("location"), F.col("location"), F.lit(".NL"))
    return briefs.select("n_nationkey", F.posexplode(planned).alias("pos", "query")).select("n_nationkey", "query", F.col("pos").cast("long").alias("pos"))


@query("select user_id as run_id, count(*) as events, arg_max(event_type, (ts, event_id)) as stage, round(arg_max(value, (ts, event_id)), 6) as value from events group by 1")
def stm_01_latest_progress(spark, sf_dir):
    return progress.latest_by_run(table(spark, sf_dir, "events")).withColumn("value", F.round("value", 6))


@query("select epoch(date_trunc('hour', ts))::bigint as start, event_type as stage, count(*) as n from events group by all")
def stm_02_progress_windows(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return progress.counts_by_window(e).select(F.unix_timestamp("start").alias("start"), "stage", "n")


@query("select event_id, user_id, event_type from (select *, row_number() over (partition by user_id, event_type order by ts, event_id) as k from events) where k = 1")
def stm_06_first_seen(spark, sf_dir):
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").withColumn("k", F.row_number().over(w)).where("k = 1").select("event_id", "user_id", "event_type")


@query("select user_id, event_id, row_number() over (partition by user_id order by ts, event_id) as sequence from events")
def srt_10_event_sequence(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select("user_id", "event_id", F.row_number().over(w).cast("long").alias("sequence"))


@query("select event_id, case when s = 'completed' then 1.0 when s = 'unknown' then 0.02 else least(0.95, round((list_position(['planning', 'searching', 'crawling', 'scoring'], s)) / 5.0, 6)) end as fraction from (select event_id, ['planning', 'searching', 'crawling', 'scoring', 'completed', 'unknown'][event_id % 6 + 1] as s from events)")
def srt_11_progress_fraction(spark, sf_dir):
    names = ["planning", "searching", "crawling", "scoring"]
    s = F.array(*[F.lit(x) for x in [*names, "completed", "unknown"]])[(F.col("event_id") % 6).cast("int")]
    return table(spark, sf_dir, "events").select("event_id", F.round(scoring.progress_fraction(s, names, ["completed"]), 6).alias("fraction"))


@query("select user_id as run_id, count(distinct event_type) as kinds, count(*) filter (event_type = 'purchase') as completed, coalesce(nullif(count(*) filter (event_type = 'nothing'), 0), count(*)) as discovered from events group by 1")
def agg_14_run_counters(spark, sf_dir):
    n = lambda kind: F.count(F.when(F.col("event_type") == kind, 1))
    return table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("run_id")).agg(F.countDistinct("event_type").alias("kinds"), n("purchase").alias("completed"), F.coalesce(F.nullif(n("nothing"), F.lit(0)), F.count("*")).alias("discovered"))


@query("select c_custkey, c_name, total from (select c_custkey, c_name, (select count(*) from customer) as total, row_number() over (order by c_acctbal desc, c_custkey) as k from customer) where k between 11 and 30")
def srt_07_pagination(spark, sf_dir):
    return scoring.page(table(spark, sf_dir, "customer"), [F.desc("c_acctbal"), F.col("c_custkey")], 10, 20).select("c_custkey", "c_name", "total")


# --- facts --------------------------------------------------------------------------------------------------


@query(f"select entity_id, name, count(*) as n, count(distinct value) as vals, round(max(confidence), 4) as best from {S.FACT_ROWS} group by all")
def tvf_17_fact_candidates(spark, sf_dir):
    return facts.fact_candidates(table(spark, sf_dir, "pages")).groupBy("entity_id", "name").agg(F.count("*").alias("n"), F.countDistinct("value").alias("vals"), F.round(F.max("confidence"), 4).alias("best"))


@query(f"""with f as (select *, {S.conflict_key('name', 'value')} as key from {S.FACT_ROWS}), t as (select *, max(confidence) over (partition by entity_id, name) as top from f),
    g as (select entity_id, name, key, bool_or(confidence >= top - 0.02) as strong, max(struct_pack(c := confidence, p := -pos, v := value)) as best, count(distinct url) as n_urls from t group by all),
    e as (select entity_id, name, count(*) filter (strong) as keys, max(struct_pack(b := best, n := n_urls)) as b from g group by all)
    select entity_id, name, case when keys = 1 then b.b.v end as value, case when keys = 1 then round(least(0.99, b.b.c + case when b.n > 1 then 0.01 else 0 end), 4) end as confidence, case when keys = 1 then b.n else 0 end as n_urls, keys > 1 as conflict from e""")
def agg_01_resolved_facts(spark, sf_dir):
    return facts.resolved(facts.fact_candidates(table(spark, sf_dir, "pages")))


@query(f"""with f as (select entity_id, lower({S.compact('value')}) as low, max(struct_pack(c := confidence, p := -pos, v := value, u := url)) as b from {S.FACT_ROWS} where name = 'services' group by all),
    k as (select *, row_number() over (partition by entity_id order by b.c desc, b.p desc, low) as k from f)
    select entity_id, string_agg(b.v, '|' order by k) as services, count(distinct b.u) as n_urls from k where k <= 20 group by 1""")
def agg_02_resolved_services(spark, sf_dir):
    return facts.resolved_services(facts.fact_candidates(table(spark, sf_dir, "pages"))).withColumn("services", F.array_join("services", "|"))


@query(f"""select entity_id, case when count(distinct {S.registrable(S.host('value'), True)}) = 1 then min(struct_pack(s := length({S.path('value')}), l := length(value), v := value)).v end as value, count(distinct {S.registrable(S.host('value'), True)}) > 1 as conflict
    from {S.FACT_ROWS} where name = 'website_url' group by 1""")
def agg_03_resolved_website(spark, sf_dir):
    return facts.resolved_urls(facts.fact_candidates(table(spark, sf_dir, "pages")), "website_url")


@query(f"""with f as (select distinct entity_id from {S.FACT_ROWS}), n as (select unnest({S.listed([*facts.CORE_FIELDS, 'owner_email', 'services_offered'])}) as name),
    v as (select entity_id, name, min(value) as value from {S.FACT_ROWS} where name in ('company_name', 'country', 'website_url') group by all)
    select f.entity_id, n.name, v.value, 'rejected' as status from f cross join n left join v using (entity_id, name)""")
def flt_10_densified(spark, sf_dir):
    f = facts.fact_candidates(table(spark, sf_dir, "pages"))
    one = f.where("name in ('company_name', 'country', 'website_url')").groupBy("entity_id", "name").agg(F.min("value").alias("value"))
    base = f.select("entity_id").distinct().select("entity_id", F.lit("services").alias("name"), F.lit(None).cast("string").alias("value"))
    return facts.densified(one.unionByName(base), ["owner_email", "services_offered"])


@query(f"""with f as (select page_id, {S.bare('url')} || page_id as entity_id, case page_id % 4 when 0 then 'summary' else 'company_name' end as name, case page_id % 5 when 0 then 'nowhere to be found' when 1 then 'x@y.nl' else {S.TITLE} end as value,
        case page_id % 7 when 0 then 'https://unknown.example/' else url end as cited, case page_id % 3 when 0 then 'inference' else 'explicit' end as basis from pages),
    t as (select url, any_value({S.TITLE}) as page_text from pages group by 1)
    select entity_id, name, case when page_text is null then 'unknown_evidence' when {S.has_contact('value')} then 'personal_contact' when name = 'company_name' and basis <> 'explicit' then 'not_explicit'
        when basis = 'explicit' and not contains(lower({S.compact('page_text')}), lower({S.compact('value')})) then 'not_in_text' end as rejection from f left join t on t.url = f.cited""")
def flt_15_grounding(spark, sf_dir):
    p, k = table(spark, sf_dir, "pages"), F.col("page_id")
    t = pages.title(F.col("html"))
    f = p.select(
        F.concat(urls.without_www(urls.host(F.col("url"))), k.cast("string")).alias("entity_id"), F.when(k % 4 == 0, "summary").otherwise("company_name").alias("name"), F.when(k % 5 == 0, "nowhere to be found").when(k % 5 == 1, "x@y.nl").otherwise(t).alias("value"),
        F.array(F.when(k % 7 == 0, "https://unknown.example/").otherwise(F.col("url"))).alias("evidence_urls"), F.when(k % 3 == 0, "inference").otherwise("explicit").alias("basis"),
    )
    return facts.grounding(f, p.groupBy("url").agg(F.min(t).alias("main_text"))).select("entity_id", "name", "rejection")


@query("""with o as (select list(distinct item_id order by item_id) as items from benchmark),
    t as (select d.doc_id, b.item_id, d.text as s, b.text as c from documents d, o join benchmark b on b.item_id = o.items[d.doc_id % len(o.items) + 1]),
    w as (select *, """ + S.tokens("s") + " as a, " + S.tokens("c") + """ as z from t)
    select doc_id, item_id, case when length(s) >= 160 and contains(lower(""" + S.compact("c") + "), lower(" + S.compact("s") + """)) then 'long_copy' when len(list_filter(regexp_extract_all(s, '[0-9]+'), lambda x: not list_contains(regexp_extract_all(c, '[0-9]+'), x))) > 0 then 'numbers'
        when len(list_intersect(a, z)) * 10 < len(a) * 6 then 'unsupported' end as reason from w""")
def flt_15_summary_grounding(spark, sf_dir):
    d, b = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    order = b.agg(F.array_sort(F.collect_set("item_id")).alias("order"))  # one row; items are few
    cited = d.crossJoin(F.broadcast(order)).where("size(order) > 0").select("doc_id", F.col("text").alias("s"), F.get("order", F.pmod("doc_id", F.size("order")).cast("int")).alias("item_id"))
    both = cited.join(b.withColumnRenamed("text", "c"), "item_id")
    return both.select("doc_id", "item_id", facts.summary_grounding(F.col("s"), F.col("c")).alias("reason"))


@query("select coalesce(a.k, b.k) as entity_id, 'name' as name, coalesce(a.v, b.v) as value, case when a.k is not null then 'deterministic' else 'llm' end as method from (select s_suppkey as k, s_name as v from supplier) a full join (select c_custkey as k, c_name as v from customer) b on a.k = b.k")
def join_12_model_facts(spark, sf_dir):
    own = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("entity_id"), F.lit("name").alias("name"), F.col("s_name").alias("value"))
    llm = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("entity_id"), F.lit("name").alias("name"), F.col("c_name").alias("value"))
    return facts.merged_with_llm(own, llm)


# --- entities -----------------------------------------------------------------------------------------------


def companies(spark, sf_dir) -> DataFrame:
    """Pages as company records: the site, a name of the first words of its title, identifiers of some."""
    k = F.col("page_id")
    t = F.array_join(F.slice(F.split(pages.title(F.col("html")), " "), 1, 2), " ")
    return table(spark, sf_dir, "pages").select(
        k.alias("id"), F.concat(t, F.when(k % 2 == 0, " B.V.").otherwise("")).alias("name"), F.concat(F.lit("https://"), urls.without_www(urls.host(F.col("url")))).alias("website_url"), F.lit(None).cast("string").alias("canonical_url"),
        F.when(k % 9 == 0, F.array(F.concat(F.lit("wikidata:Q"), (k % 5).cast("string")))).otherwise(F.array().cast("array<string>")).alias("ids"), ((k % 7) / 10 + 0.3).alias("confidence"), (k % 11).alias("created_at"), (k % 13).alias("updated_at"), F.array(F.col("url")).alias("evidence_urls"),
    )


SIGNALS = f"""with c as (select page_id as id, array_to_string(string_split({S.TITLE}, ' ')[1:2], ' ') || case when page_id % 2 = 0 then ' B.V.' else '' end as name, {S.bare('url')} as domain, case when page_id % 9 = 0 then 'wikidata:Q' || page_id % 5 end as wid,
        (page_id % 7) / 10 + 0.3 as confidence, page_id % 11 as created_at, page_id % 13 as updated_at, url from pages),
    s as (select id, name, {S.company_name('name')} as norm, {S.registrable('domain', S.HOST_SUFFIXES)} as domain, wid from c)"""
DECISIONS = SIGNALS + """, d as (select a.id as a, b.id as b, a.domain = b.domain as same, a.wid <> b.wid as apart, a.wid = b.wid as shared, a.norm = b.norm as named,
        ((greatest(length(a.norm), length(b.norm)) - levenshtein(a.norm, b.norm)) * 100 // greatest(length(a.norm), length(b.norm)))::int as score from s a join s b on a.id < b.id),
    o as (select a, b, case when apart then 'separate' when same or shared then 'merge' when named or score >= 92 then 'manual_review' else 'separate' end as outcome,
        round(case when apart or same or shared then 0.99 when named then 0.94 when score >= 92 then score / 100 else greatest(0.5, 1 - coalesce(score, 0) / 100) end, 4) as confidence,
        case when apart then 'conflicting_identifiers' when same then 'domain' when shared then 'identifier' when named then 'exact_name' when score >= 92 then 'fuzzy_name' else 'different' end as reason from d where same or shared or named or score >= 92)"""


@query(DECISIONS + " select * from o")
def dec_03_entity_pairs(spark, sf_dir):
    s = entities.signals(companies(spark, sf_dir), S.HOST_SUFFIXES)
    return entities.entity_pairs(s)


CLUSTERS = DECISIONS.replace("with c as", "with recursive c as", 1) + """, m as (select a, b from o where outcome = 'merge' union select b, a from o where outcome = 'merge'),
    r(a, b) as (select id, id from c union select r.a, m.b from r join m on r.b = m.a), k as (select a as id, min(b) as cluster from r group by 1)"""


@query(CLUSTERS + " select * from k")
def dec_05_clusters(spark, sf_dir):
    c = companies(spark, sf_dir)
    s = entities.signals(c, S.HOST_SUFFIXES)
    return entities.clusters(c.select("id"), entities.merge_edges(s))


@query(CLUSTERS + """ select cluster, arg_max(name, (confidence, -id)) as name, arg_max('https://' || domain, (confidence, -id)) as website_url, min(created_at) as created_at, max(updated_at) as updated_at, string_agg(distinct url, '|' order by url) as evidence_urls, count(*) as members from k join c using (id) group by 1""")
def agg_06_merged_records(spark, sf_dir):
    c = companies(spark, sf_dir)
    s = entities.signals(c, S.HOST_SUFFIXES)
    merged = entities.merged_records(c, entities.clusters(c.select("id"), entities.merge_edges(s)))
    return merged.withColumn("evidence_urls", F.array_join("evidence_urls", "|"))


@query(f"""with v as (select entity_id, name, value, max(struct_pack(c := confidence, p := -pos)) as o, string_agg(distinct url, '|' order by url) as urls from {S.FACT_ROWS} group by all)
    select entity_id, name, arg_max(value, o) as value, count(*) - 1 as n_alternatives, arg_max(urls, o) as urls from v group by all""")
def agg_05_merged_fields(spark, sf_dir):
    return entities.merged_fields(facts.fact_candidates(table(spark, sf_dir, "pages"))).withColumn("urls", F.array_join("urls", "|"))


@query(f"""with f as (select *, case when pos % 3 = 0 then 'explicit' else 'inference' end as basis from {S.FACT_ROWS}), v as (select entity_id, name, value, max((basis = 'explicit')::int) as e, count(distinct url) as n_urls, min(pos) as pos from f group by all)
    select entity_id, name, arg_min(value, (-e, -n_urls, pos, value)) as value, arg_min(n_urls, (-e, -n_urls, pos, value)) as n_urls from v group by all""")
def agg_08_merged_extractions(spark, sf_dir):
    f = facts.fact_candidates(table(spark, sf_dir, "pages")).withColumn("basis", F.when(F.col("pos") % 3 == 0, "explicit").otherwise("inference"))
    return entities.merged_extractions(f)


# --- enrichment ---------------------------------------------------------------------------------------------


@query(f"""with c as ({S.COMPANIES}), own as (select id, {S.registry_name('name')} as key, case when id % 4 = 0 then lower(substr(n_name, 1, 2)) end as code from c join nation on n_nationkey = nationkey),
    r as (select distinct {S.registry_name("name || ' Ltd'")} as key, lower(substr(n_name, 1, 2)) as j, (id % 50)::varchar as rid from c join nation on n_nationkey = nationkey where id % 3 <> 0),
    h as (select own.id, rid from own join r using (key) where code is null or code = j), g as (select id, count(distinct rid) as n, min(rid) as one from h group by 1)
    select own.id, case when coalesce(n, 0) = 0 then 'unmatched' when n = 1 then 'matched' else 'ambiguous' end as status, case when n = 1 then one end as registry_id, coalesce(n, 0) as n from own left join g using (id)""")
def enr_01_registry(spark, sf_dir):
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nationkey"), F.lower(F.substring("n_name", 1, 2)).alias("code"))
    c = company_names(spark, sf_dir).join(F.broadcast(nations), "nationkey")  # 25 rows
    registry = c.where("id % 3 <> 0").select(F.concat("name", F.lit(" Ltd")).alias("name"), F.col("code").alias("jurisdiction"), (F.col("id") % 50).cast("string").alias("registry_id"))
    return enrich.from_registry(c.select("id", "name", F.when(F.col("id") % 4 == 0, F.col("code")).alias("country_code")), registry)


@query(f"""with c as (select page_id as id, lower({S.TITLE}) as key, 'https://' || {S.bare('url')} as w from pages), b as (select 'Q' || page_id % 200 as item, {S.TITLE} as label, url as website, substr({S.path('url')}, 2, 2) as country from pages),
    i as (select item, min(label) as label, list_sort(list_distinct(list(website))) as ws, string_agg(distinct country, ', ' order by country) as cs, count(distinct country) as nc from b group by 1),
    h as (select c.id, i.item, i.cs, i.nc from c join i on lower({S.compact('i.label')}) = c.key and len(list_filter(i.ws, lambda x: {S.bare('x')} = {S.host('c.w')})) > 0), g as (select id, count(*) as n, min(item) as item, arg_min(cs, item) as cs, arg_min(nc, item) as nc from h group by 1)
    select c.id, case when n = 1 then item end as item, case when n = 1 then cs end as countries, case when coalesce(n, 0) = 0 then 'no_match' when n > 1 then 'ambiguous' when nc > 1 then 'several_countries' end as warning from c left join g using (id)""")
def enr_02_knowledge_base(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    t = pages.title(F.col("html"))
    c = p.select(F.col("page_id").alias("id"), t.alias("name"), F.concat(F.lit("https://"), urls.without_www(urls.host(F.col("url")))).alias("website_url"))
    b = p.select(F.concat(F.lit("Q"), (F.col("page_id") % 200).cast("string")).alias("item"), t.alias("label"), F.col("url").alias("website"), F.substring(urls.path(F.col("url")), 2, 2).alias("country"))
    return enrich.from_knowledge_base(c, b)


@query("""with n as (select upper(substr(n_name, 1, 2)) || n_nationkey as cc, n_name, upper(substr(n_name, 1, 3)) || n_nationkey as iso, r_name, n_regionkey from nation join region on r_regionkey = n_regionkey),
    o as (select c_custkey as id, case c_custkey % 3 when 0 then lower(n.n_name) when 1 then n.cc else 'The ' || n.iso end as country, n.cc, case c_custkey % 4 when 0 then null when 1 then 'atlantis' when 2 then n.r_name else (select min(r_name) from region) end as city, n.n_regionkey as rk from customer join n on n.n_name = (select n_name from nation where n_nationkey = c_nationkey))
    select id, cc as country_code, case when city is null then 'no_city' when city = 'atlantis' then 'unknown_city' when city = (select r_name from region where r_regionkey = rk) then 'validated' else 'contradiction' end as city_status from o""")
def enr_03_gazetteer(spark, sf_dir):
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    k = F.col("n_nationkey").cast("string")
    countries = n.select(F.concat(F.upper(F.substring("n_name", 1, 2)), k).alias("country_code"), F.col("n_name").alias("country_name"), F.concat(F.upper(F.substring("n_name", 1, 3)), k).alias("iso_alpha3"), "n_nationkey", "r_name")
    lowest = table(spark, sf_dir, "region").agg(F.min("r_name").alias("lowest"))
    c = F.col("c_custkey")
    own = table(spark, sf_dir, "customer").join(countries, F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(lowest)).select(  # lowest: one row
        c.alias("id"), F.when(c % 3 == 0, F.lower("country_name")).when(c % 3 == 1, F.col("country_code")).otherwise(F.concat(F.lit("The "), "iso_alpha3")).alias("country"), F.when(c % 4 == 1, "atlantis").when(c % 4 == 2, F.col("r_name")).when(c % 4 == 3, F.col("lowest")).alias("city"),
    )
    return enrich.from_gazetteer(own, countries, countries.select(F.col("r_name").alias("name"), "country_code"))


@query("select c_custkey as id, 'segment' as name, c_mktsegment as value from customer where c_custkey % 3 <> 0")
def join_11_unoccupied(spark, sf_dir):
    add = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.lit("segment").alias("name"), F.col("c_mktsegment").alias("value"))
    return enrich.unoccupied(add, add.where("id % 3 = 0"))


@query("select c_custkey as id, 'segment' as name, c_mktsegment as value, 'BUILDING' as held from customer where c_custkey % 3 = 0 and c_mktsegment <> 'BUILDING'")
def join_11_contradictions(spark, sf_dir):
    add = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.lit("segment").alias("name"), F.col("c_mktsegment").alias("value"))
    return enrich.contradictions(add, add.where("id % 3 = 0").withColumn("value", F.lit("BUILDING")))


# --- scoring and export -------------------------------------------------------------------------------------


def score_facts(spark, sf_dir) -> DataFrame:
    f = facts.fact_candidates(table(spark, sf_dir, "pages"))
    return f.select("entity_id", "pos", "name", "value", F.when(F.col("pos") % 4 == 0, "inference").otherwise("explicit").alias("basis"), "confidence", F.array("url").alias("evidence_urls"))


def score_sites(spark, sf_dir) -> DataFrame:
    """Sites of all hosts, from the urls alone: the facts are not read for them."""
    e = urls.without_www(urls.host(F.col("url")))
    return table(spark, sf_dir, "pages").select(e.alias("entity_id")).distinct().withColumn("website_url", F.concat(F.lit("https://"), "entity_id", F.lit("/")))


SCORES = f"""with f as (select entity_id, pos, name, value, lower({S.compact('value')}) as low, case when pos % 4 = 0 then 'inference' else 'explicit' end as basis, confidence, url from {S.FACT_ROWS}),
    h as (select *, list_contains({S.words('low')}, 'than') or list_contains({S.words('low')}, 'the') as hit, {S.registrable(S.host('value'), True)} = {S.registrable(S.host('url'), True)} as own from f),
    x as (select entity_id, name from f group by all having count(distinct low) > 1),
    g as (select h.entity_id, case when bool_or(h.name = 'services' and hit and basis = 'explicit') then 30 when bool_or(h.name = 'services' and hit and basis = 'inference') then 10 when bool_or(h.name <> 'services' and hit and basis = 'explicit') then 8 else 0 end as topic,
        coalesce(arg_min(case when basis = 'explicit' then 15 else 5 end, pos) filter (h.name = 'services' and hit), 0) as services, case when bool_or(h.name = 'website_url' and basis = 'explicit' and own) then 10 else 0 end as website,
        bool_or(basis = 'inference') as inf, count(distinct {S.company_url('url')}) as docs, count(distinct x.name) as contraries, count(distinct h.name) filter (h.name in ('country', 'company_name')) as done
        from h left join x on x.entity_id = h.entity_id and x.name = h.name group by 1),
    s as (select entity_id, topic, 0 as location, services, website, 0 as contact, greatest(0, 8 + case when docs >= 2 then 2 else 0 end - case when inf then 2 else 0 end - case when contraries > 0 then 4 else 0 end) as evidence, (2 * 5 * done + 2) // 4 as completeness from g)"""


@query(SCORES + " select entity_id, topic::int as topic, location::int as location, services::int as services, website::int as website, contact::int as contact, evidence::int as evidence, completeness::int as completeness, (topic + services + website + evidence + completeness)::int as total from s")
def scr_01_component_scores(spark, sf_dir):
    f = score_facts(spark, sf_dir)
    sites = score_sites(spark, sf_dir)
    return scoring.component_scores(f, sites, ["than", "the"], "atlantis", ["country", "company_name"])


@query(SCORES + " select entity_id, c as component, m - v as points from (select entity_id, unnest(['topic', 'location', 'services', 'website', 'contact', 'evidence', 'completeness']) as c, unnest([30, 20, 15, 10, 10, 10, 5]) as m, unnest([topic, location, services, website, contact, evidence, completeness])::int as v from s) where v < m")
def scr_08_penalties(spark, sf_dir):
    return scoring.penalties(scr_01_component_scores(spark, sf_dir))


@query(SCORES + " select entity_id as name, total from (select entity_id, (topic + services + website + evidence + completeness)::int as total from s) order by total desc, name limit 10")
def srt_01_ranking(spark, sf_dir):
    s = scr_01_component_scores(spark, sf_dir).select(F.col("entity_id").alias("name"), "total", F.concat(F.lit("https://"), "entity_id").alias("website_url"))
    return scoring.ranking(s, 10).select("name", "total")


@query("""select left(c_name, 300) as company, '' as website, coalesce(n_name, '') as country, c_mktsegment || chr(10) || 'more' as services, '' as contact, '''=sum' as summary, c_custkey % 100 as score, 'a' || chr(10) || 'b' as explanation, 'http://a/' || chr(10) || 'http://b/' as evidence_urls, 'approved' as compliance_status,
    case when c_custkey = 3 then 'Skipped ' || c_name else '' end as warnings, '2024-01-02T03:04:05' as updated_at from customer join nation on n_nationkey = c_nationkey""")
def snk_05_research_rows(spark, sf_dir):
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    r = c.select(
        F.col("c_name").alias("name"), F.lit(None).cast("string").alias("website_url"), F.col("n_name").alias("country"), F.array("c_mktsegment", F.lit(" more ")).alias("services"), F.lit(None).cast("string").alias("contact"), F.lit("=sum").alias("summary"),
        (F.col("c_custkey") % 100).alias("total"), F.array(F.lit("a"), F.lit("b")).alias("explanation"), F.array(F.lit("http://b/"), F.lit("http://a/"), F.lit("http://b/")).alias("evidence_urls"), F.to_timestamp(F.lit("2024-01-02 03:04:05")).alias("updated_at"),
    )
    warnings = c.where("c_custkey = 3").select(F.lit(1).alias("k"), F.concat(F.lit("Skipped "), "c_name").alias("warning"))
    return export.research_rows(r, warnings)


@query(None)
def ctl_01_research_run(spark, sf_dir):
    from quern.plans import research

    return research.run(spark, sf_dir)


# --- checks -------------------------------------------------------------------------------------------------


def line_fields(spark, sf_dir) -> DataFrame:
    """Order lines as fields of their orders; pos is a struct, as keys of any size can't be packed in one number."""
    k = F.col("l_linenumber")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("entity_id"), F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("pos"), F.when(k == 1, "company_name").when(k == 2, "website_url").otherwise("city").alias("name"),
        F.when(F.col("l_returnflag") != "R", F.concat(F.lit("s"), (F.col("l_suppkey") % 3).cast("string"))).alias("value"), F.when(F.col("l_linestatus") == "O", "explicit").otherwise("inference").alias("basis"),
        F.when(F.col("l_partkey") % 5 > 0, F.array(F.concat(F.lit("p"), F.col("l_partkey").cast("string")))).otherwise(F.array().cast("array<string>")).alias("evidence_urls"),
    )


@query("""select l_orderkey as entity_id, count(distinct l_linenumber) filter (where l_linenumber in (1, 2) and l_returnflag <> 'R' and l_linestatus = 'O' and l_partkey % 5 > 0) = 2 as verified from lineitem group by 1""")
def flt_06_independently_verified(spark, sf_dir):
    return checks.independently_verified(line_fields(spark, sf_dir))


@query(f"""with t as (select page_id, url, unnest(['https://' || {S.bare('url')} || '/x', 'ftp://' || {S.bare('url')}, 'https://other.test/', null]) as v, unnest([1, 2, 3, 4]) as k from pages) select page_id, cast(k as bigint) as k, k = 1 as safe from t""")
def flt_07_safe_identity_url(spark, sf_dir):
    h = urls.without_www(urls.host(F.col("url")))
    made = F.array(F.concat(F.lit("https://"), h, F.lit("/x")), F.concat(F.lit("ftp://"), h), F.lit("https://other.test/"), F.lit(None).cast("string"))
    each = table(spark, sf_dir, "pages").select("page_id", "url", F.posexplode(made).alias("k", "v"))
    return each.select("page_id", (F.col("k") + 1).cast("long").alias("k"), checks.safe_identity_url(F.col("v"), F.col("url")).alias("safe"))


@query("select c_custkey, case when c_custkey % 9 > 0 then c_acctbal end as score from customer where case when c_custkey % 9 > 0 then c_acctbal else 0 end >= -100")
def flt_11_least_score(spark, sf_dir):
    made = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 9 > 0, F.col("c_acctbal")).alias("score"))
    return checks.at_least(made, F.lit(-100))


@query("""select l_orderkey as entity_id, min(l_linenumber * 1000000 + l_partkey)::bigint as pos, 's' || l_suppkey % 3 as source, l_returnflag as value, arg_max('p' || l_partkey, l_linenumber * 1000000 + l_partkey) as label from lineitem group by l_orderkey, l_suppkey % 3, l_returnflag""")
def agg_09_unique_identifiers(spark, sf_dir):
    made = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("entity_id"), (F.col("l_linenumber") * 1_000_000 + F.col("l_partkey")).cast("long").alias("pos"), F.concat(F.lit("s"), (F.col("l_suppkey") % 3).cast("string")).alias("source"), F.col("l_returnflag").alias("value"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("label"))
    return checks.unique_identifiers(made)


@query("""select l_orderkey as entity_id, (array_agg(case when l_returnflag <> 'R' then 's' || l_suppkey % 3 end order by l_linenumber, l_partkey, l_suppkey))[1] as value from lineitem where l_linenumber >= 2 and l_partkey % 5 > 0 group by 1""")
def flt_21_first_supported(spark, sf_dir):
    return checks.first_supported(line_fields(spark, sf_dir), ["website_url", "city"])


@query("""select c_custkey, case c_custkey % 5 when 0 then 7.5::double when 1 then 0 when 2 then null when 3 then 30 end as delay from customer""")
def stm_07_retry_delay(spark, sf_dir):
    k = F.col("c_custkey") % 5
    header = F.when(k == 0, " 7.5 , 100").when(k == 1, "-3").when(k == 2, "Wed, 21 Oct").when(k == 3, "")
    return table(spark, sf_dir, "customer").select("c_custkey", checks.retry_delay(header, F.when(k == 3, "30, 2000")).alias("delay"))


@query("""select page_id, case when page_id % 4 = 1 or page_id % 4 = 2 then 'identity' when page_id % 3 = 0 then 'evidence' end as rejection from pages""")
def enr_04_identity_guard(spark, sf_dir):
    k, u = F.col("page_id"), F.col("url")
    name = F.concat(F.lit("n"), k.cast("string"))
    renamed = F.when(k % 4 == 1, F.concat(name, F.lit(" Ltd"))).otherwise(name)
    moved = F.when(k % 4 == 2, F.lit("https://elsewhere.test/")).otherwise(F.concat(u, F.when(F.contains(u, F.lit("?")), "&utm_source=x").otherwise("?utm_source=x")))
    return table(spark, sf_dir, "pages").select("page_id", checks.enrichment_rejection(name, u, renamed, moved, k % 3 == 0).alias("rejection"))


@query(f"""with p as (select page_id, url, {S.company_url('url')} as k, {S.bare('url')} as site from pages), kept as (select site, k, max(page_id) as page from p group by 1, 2),
    met as (select p.site as entity_id, p.page_id as pos, kept.page from p join kept using (site, k) where p.page_id % 3 = 0 and kept.page % 2 = 0)
    select * from (select p.site as entity_id, p.page_id as pos, c.page from p join (select site, k, max(page_id) as page from p where page_id % 2 = 0 group by 1, 2) c using (site, k) where p.page_id % 3 = 0)
    union all select site, 0, min(page_id) from p where page_id % 2 = 0 and site not in (select a.site from p a join p b on a.site = b.site and a.k = b.k where a.page_id % 3 = 0 and b.page_id % 2 = 0) group by site""")
def join_02_clean_pages(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select(urls.without_www(urls.host(F.col("url"))).alias("entity_id"), "url", F.col("page_id").alias("pos"))
    cleaned = p.where("pos % 2 = 0").select("entity_id", "url", F.col("pos").alias("page"), F.col("pos").alias("seq"))
    return checks.clean_pages(p.where("pos % 3 = 0"), cleaned)


def domain_lists(spark, sf_dir) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(F.explode(F.array(
        F.struct(F.element_at(F.array(F.lit("approved"), F.lit("blocked"), F.lit("candidate")), (k % 3 + 1).cast("int")).alias("list"), F.when(k % 2 == 0, "exact").otherwise("recursive").alias("kind"), F.concat(F.lit("d"), (k % 40).cast("string"), F.lit(".test")).alias("rule")),
        F.struct(F.lit("blocked").alias("list"), F.lit("exact").alias("kind"), F.concat(F.lit("d"), (k % 7).cast("string"), F.lit(".test")).alias("rule")),
    )).alias("r")).select("r.*")


RULE_ROWS = """(select ['approved', 'blocked', 'candidate'][s_suppkey % 3 + 1] as list, case when s_suppkey % 2 = 0 then 'exact' else 'recursive' end as kind, 'd' || s_suppkey % 40 || '.test' as rule from supplier union all select 'blocked', 'exact', 'd' || s_suppkey % 7 || '.test' from supplier)"""


@query(f"""select rule as domain, array_to_string(list_filter(['approved exact', 'approved recursive', 'blocked exact', 'blocked recursive', 'candidate review'], lambda o: list_contains(list(case list when 'candidate' then 'candidate review' else list || ' ' || kind end), o)), ', ') as origins from {RULE_ROWS} group by rule""")
def agg_17_listed_domains(spark, sf_dir):
    return checks.listed_domains(domain_lists(spark, sf_dir))


@query(f"""select c_custkey, 'd' || c_custkey % 50 || '.test' as domain from customer where 'd' || c_custkey % 50 || '.test' in (select rule from {RULE_ROWS} where list = 'approved' and kind = 'exact')""")
def join_15_live_targets(spark, sf_dir):
    targets = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("d"), (F.col("c_custkey") % 50).cast("string"), F.lit(".test")).alias("domain"))
    return checks.live_targets(targets, domain_lists(spark, sf_dir))


@query(f"""select page_id as id, {S.host('url')} as domain, url, 'refused by [redacted] at ' || page_id as reason from pages""")
def flt_19_skipped_items(spark, sf_dir):
    made = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), "url", F.concat(F.lit("refused by a.b@c.example at "), F.col("page_id").cast("string")).alias("reason"))
    return checks.skipped_items(made)
