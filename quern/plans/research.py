"""The whole run: from briefs over candidates, policy, pages, facts and entities to scored companies."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import text, urls
from quern.operators import facts, pages, policy, scoring

#: Parts of a domain's pages, so that those of a large domain go to several tasks.
PARTS = 16


def planned_queries(topic: Column, location: Column, city: Column, country_tld: Column) -> Column:
    """Four or five distinct search queries of a brief."""
    t, place = text.compact(topic), text.compact(location)
    town, tld = F.coalesce(text.compact(city), place), F.regexp_replace(F.lower(F.trim(country_tld)), r"^\.", "")
    bare = F.trim(F.regexp_replace(t, F.concat(F.lit(r"(?i)\s+in\s+(?:the\s+)?\Q"), place, F.lit(r"\E$")), F.lit("")))
    core = F.trim(F.regexp_replace(bare, r"(?i)\s+(?:agency|agencies|company|companies|provider|providers|services?)$", ""))
    subject = F.when(core != "", core).when(bare != "", bare).otherwise(t)
    queries = F.array(
        F.when(bare != t, t).otherwise(F.concat_ws(" ", t, place)), F.concat_ws(" ", subject, F.when(F.lower(subject) == "shopify", "Plus agency").otherwise("specialist agency"), place),
        F.concat_ws(" ", subject, F.lit("development company"), place), F.concat_ws(" ", subject, F.lit("ecommerce agency"), town), F.when(tld.rlike("^[a-z]{2,63}$"), F.concat(F.lit("site:."), tld, F.lit(" "), subject, F.lit(" agency"))),
    )
    return F.array_distinct(F.array_compact(queries))


def page_reason(website: Column) -> Column:
    """Why a page (url, html) is not read whatever the policy and other pages say, or null."""
    return F.when(website.isNull(), "not an official website").when(~policy.is_safe_path(F.col("url")), "restricted path").when(policy.has_challenge(F.col("html")), "bot challenge")


def staged_candidates(candidates: DataFrame, rules: DataFrame) -> DataFrame:
    """candidates (page_id, url, html) with stage and reason: accepted, or where each stopped. Cheap native checks come first; one row a site is accepted, that of the smallest page_id."""
    judged = policy.source_policy(candidates, rules, "url").withColumnRenamed("reason", "policy_reason")
    site = policy.official_website(F.col("url"), F.col("domain"), pages.title(F.col("html")))
    checked = judged.withColumn("website", F.when(F.col("decision") != "rejected", site))
    first = checked.where("website is not null").groupBy("website").agg(F.min("page_id").alias("first"))
    reason = F.when(F.col("decision") == "rejected", F.concat(F.lit("policy: "), "policy_reason")).otherwise(F.coalesce(page_reason(F.col("website")), F.when(F.col("page_id") > F.col("first"), "seen")))
    staged = checked.join(first, "website", "left").withColumn("reason", reason)
    return staged.select(*judged.columns, "website", "reason", F.when(F.col("reason").isNull(), "accepted").otherwise("skipped").alias("stage"))


def readable_pages(candidates: DataFrame, rules: DataFrame) -> DataFrame:
    """The candidates (page_id, url, html) that staged_candidates accepts or has seen the site of, as facts.read_pages gives them. Their html is not shuffled, and no site goes to one task."""
    domain = urls.normalize_domain(F.col("url"))
    site = policy.official_website(F.col("url"), domain, pages.title(F.col("html")))
    read = facts.read_pages(candidates.where(page_reason(site).isNull())).withColumn("domain", domain).withColumn("part", F.pmod(F.hash("page_id", "url"), F.lit(PARTS)))
    blocked = policy.blocked_domains(candidates.select(domain.alias("domain")), rules).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    return read.join(blocked, ["domain", "part"], "left_anti").drop("domain", "part")


def run(spark: SparkSession, sf_dir: str, terms: tuple[str, ...] = ("than", "the"), location: str = "Netherlands", limit: int = 30) -> DataFrame:
    """(rank, name, website_url, total, services) over `pages` as candidates and as crawled pages."""
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    rules = spark.createDataFrame([("blocked", "subdomains", "spam-farm.example.org")], "list string, kind string, rule string")
    # read by three aggregations: kept in memory or on disk, so that pages are parsed once
    candidates = facts.read_candidates(readable_pages(p, rules)).drop("fragment", "method").persist(StorageLevel.MEMORY_AND_DISK)
    own = facts.resolved(candidates.where("name in ('website_url', 'company_name')")).where("not conflict")
    known = own.groupBy("entity_id").agg(F.max(F.when(F.col("name") == "website_url", F.col("value"))).alias("website_url"), F.max(F.when(F.col("name") == "company_name", F.col("value"))).alias("name"))
    services = facts.resolved_services(candidates).select("entity_id", F.array_join("services", ", ").alias("offered"))
    rows = candidates.select("entity_id", "pos", "name", "value", F.lit("explicit").alias("basis"), "confidence", F.array("url").alias("evidence_urls"))
    scores = scoring.component_scores(rows, known, list(terms), location, ["country"])
    whole = scores.join(known, "entity_id", "left").join(services, "entity_id", "left")
    best = scoring.ranking(whole.select(F.coalesce("name", "entity_id").alias("name"), F.coalesce("website_url", F.concat(F.lit("https://"), "entity_id", F.lit("/"))).alias("website_url"), "total", F.col("offered").alias("services")), limit)
    return best.select("name", "website_url", "total", "services")
