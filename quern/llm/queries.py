"""The queries of this subpackage: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import decontaminate, embedding_dedup, jaccard_join, language, licenses, line_dedup, packing, token_counts, token_store, url_filter
from quern.llm.common import new_path, read_table


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(read_table(spark, sf_dir, "embeddings"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(read_table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_digests(read_table(spark, sf_dir, "documents"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(read_table(spark, sf_dir, "documents"))


def language_model(docs: DataFrame) -> dict[str, bytes]:
    return language.train(docs.where(~language.held_out(F.col("doc_id"))))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    found = language.classify(docs, language_model(docs))
    return found.select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "token-store")
    token_store.write_store(read_table(spark, sf_dir, "documents"), path, tokenizer("byte_bpe_50k.json"))
    if not token_store.verify_store(spark, path):
        raise ValueError("the recipes read are not those of the manifest")
    return token_store.document_digests(spark, path).withColumnRenamed("id", "doc_id")


#: The rules of op9.
URL_RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(read_table(spark, sf_dir, "pages"), URL_RULES)


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(read_table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_embedding_dedup, op2_token_counts, op3_decontamination, op4_packing, op5_line_dedup, op6_jaccard_join, op7_language, op8_token_store, op9_url_filter, op10_license_scan, pipeline)}


def oracle_sql() -> dict[str, str]:
    return {
        "op5_line_dedup": r"""
            with t as (select doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents),
            l as (select doc_id, unnest(range(1, len(lines) + 1)) as k, unnest(lines) as line from t),
            s as (select doc_id, k, line, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l),
            d as (select key, max(doc_id) as keeper from s where length(key) >= 40 group by key having count(distinct doc_id) >= 5),
            m as (select s.doc_id, s.k, s.line, coalesce(s.doc_id < d.keeper, false) as gone from s left join d on s.key = d.key)
            select doc_id, cast(count(*) as bigint) as n_lines, cast(count(*) filter (where gone) as bigint) as n_dropped,
                   sha256(coalesce(string_agg(line, chr(10) order by k) filter (where not gone), '')) as kept_sha256
            from m group by doc_id""",
        "op6_jaccard_join": r"""
            with recursive w as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from documents),
            s as (select distinct doc_id, unnest(case when len(ws) = 0 then [] when len(ws) < 5 then [array_to_string(ws, ' ')]
                else list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) end) as g from w),
            n as (select doc_id, count(*) as n from s group by 1),
            o as (select a.doc_id as a, b.doc_id as b, count(*) as k from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
            l as (select a, b from o join n x on x.doc_id = a join n y on y.doc_id = b where 100 * k >= 75 * (x.n + y.n - k)),
            e as (select a, b from l union all select b, a from l),
            r(a, b) as (select doc_id, doc_id from documents union select r.a, e.b from r join e on r.b = e.a)
            select r.a as doc_id, coalesce(any_value(n.n), 0) as n_shingles, min(r.b) as component_id from r left join n on n.doc_id = r.a group by r.a""",
        "op9_url_filter": _url_sql(),
        "op10_license_scan": _license_sql(),
    }


def _url_sql() -> str:
    """Links are read from the pages, closed over, and each page takes its rule's verdict, its aliases' or allow."""
    rules = ", ".join(f"('{r.partition('/')[0]}', '/{r.partition('/')[2]}', '{r}', '{v}')" for r, v in URL_RULES)
    judged = lambda src, keys: f"""
        select {keys}, host, path, max_by(r.rule, length(r.rule)) as rule, max_by(r.verdict, length(r.rule)) as said
        from {src} s left join rules r on (s.host = r.h or ends_with(s.host, '.' || r.h)) and starts_with(s.path, r.p) group by all"""  # noqa: E731
    upper = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
    parts = lambda u: f"""translate(regexp_extract({u}, '://([^/?#]*)', 1), {upper}) as host, regexp_extract({u}, '://[^/?#]*([^?#]*)', 1) as path,
        case when contains({u}, '://') then translate(regexp_extract({u}, '://([^/?#]*)', 1), {upper}) || regexp_extract({u}, '://[^/?#]*([^#]*)', 1) end as address"""  # noqa: E731
    return rf"""
        with recursive rules(h, p, rule, verdict) as (values {rules}),
        own as (select row_number() over () as k, page_id, coalesce(url, '') as url, html, {parts("coalesce(url, '')")} from pages),
        stated as (select url, regexp_extract(regexp_extract(html, '(?is)<link[^>]*?rel\s*=\s*["'']?canonical[^>]*>'), '(?is)href\s*=\s*["'']?([^"''\s>]+)', 1) as t from own
            union all select url, regexp_extract(regexp_extract(html, '(?is)<meta[^>]*?http-equiv\s*=\s*["'']?refresh[^>]*>'), '(?is)url\s*=\s*["'']?([^"''\s>]+)', 1) from own),
        whole as (select url, case when contains(t, '://') then t when starts_with(t, '//') then 'http:' || t
                when starts_with(t, '/') then regexp_extract(url, '^(.*?://[^/?#]*)', 1) || t
                when starts_with(t, '?') then regexp_extract(url, '^(.*?://[^/?#]*[^?#]*)', 1) || t
                when starts_with(t, '#') then url
                else regexp_extract(url, '^(.*?://[^/?#]*)', 1) || regexp_extract(regexp_extract(url, '://[^/?#]*([^?#]*)', 1) || case when regexp_extract(url, '://[^/?#]*([^?#]*)', 1) = '' then '/' else '' end, '^(.*/)', 1) || t end as t
            from stated where t <> ''),
        links as (select a.address as src, b.address as dst from (select whole.t, x.address from whole, lateral (select {parts("whole.url")}) x) a, lateral (select {parts("a.t")}) b where a.address is not null and b.address is not null),
        both_ways as (select src, dst from links union select dst, src from links),
        reach(a, b) as (select src, src from both_ways union select reach.a, both_ways.dst from reach join both_ways on reach.b = both_ways.src),
        nodes as (select distinct a as address, translate(regexp_extract('://' || a, '://([^/?#]*)', 1), {upper}) as host, regexp_extract('://' || a, '://[^/?#]*([^?#]*)', 1) as path from reach),
        ruled as ({judged("nodes", "address")}),
        aliases as (select a as address, case when bool_or(said = 'allow') then 'allow' when bool_or(said = 'block') then 'block' end as alias_verdict from reach join ruled on reach.b = ruled.address group by a),
        pages_ruled as ({judged("own", "k, page_id, s.address")})
        select page_id, host, path, rule, coalesce(said, alias_verdict, 'allow') as verdict, alias_verdict from pages_ruled left join aliases using (address)"""


def _license_sql() -> str:
    quote = lambda x: "'" + x.replace("'", "''") + "'"

    def canonical(x: str) -> str:
        out = f"regexp_replace(regexp_replace(lower({x}), {quote(licenses.COPYRIGHT_LINE)}, '', 'g'), {quote(licenses.OTHER)}, ' ', 'g')"
        out = f"' ' || regexp_replace({out}, ' ?' || chr(10) || ' ?', ' ' || chr(10) || ' ', 'g') || ' '"
        for a, b in licenses.EQUIVALENT:
            for _ in range(2):
                out = f"replace({out}, ' {a} ', ' {b} ')"
        return out

    known = ", ".join(f"({quote(i)}, {quote(t)})" for i, t in licenses.KNOWN)
    one_line = lambda x: f"trim(regexp_replace({x}, '[ ' || chr(10) || ']+', ' ', 'g'))"
    return f"""
        with listed(license_id, text) as (values {known}),
        made as (select doc_id, {canonical("text")} as c from documents where text is not null),
        known as (select sha256({one_line("c")}) as digest, min(license_id) as license_id from (select license_id, {canonical("text")} as c from listed) group by 1),
        units as (select doc_id, 'text' as unit, {one_line("c")} as s from made union all select doc_id, 'line', trim(unnest(string_split(c, chr(10)))) from made)
        select doc_id, unit, license_id, count(*) as n from units join known on sha256(s) = digest where s <> '' group by all"""
