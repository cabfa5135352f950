"""Facts in long form: entity_id, pos, name, value, url, fragment, method, confidence; and their resolution.

Every operator groups by (entity, field), so a whole plan over facts shuffles on one key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.functions import text, urls
from quern.operators import pages as P

#: Candidates within this of the best confidence have a say.
AUTHORITY = 0.02
# Confidences of signals.
CONFIDENCE = {"canonical": 0.98, "contact": 0.96, "og_site_name": 0.90, "og_title": 0.84, "title": 0.78, "heading": 0.70, "service_section": 0.88, "description": 0.86, "country_text": 0.76}
CORE_FIELDS = ["company_name", "website_url", "summary", "services", "contact_page_url", "country"]


def _signals(source: DataFrame, entity: Column, pos: Column, url: Column, signals: list[tuple[str, Column, str]]) -> DataFrame:
    """The signals (name, value, method) of each row that have a value: all from one reading of the source."""
    each = F.array(*[F.struct(F.lit(n).alias("name"), v.alias("value"), F.lit(m).alias("method"), F.lit(CONFIDENCE[m]).alias("confidence")) for n, v, m in signals])
    found = source.select(entity.alias("entity_id"), pos.alias("pos"), url.alias("url"), F.explode(each).alias("s")).select("entity_id", "pos", "s.name", "s.value", "url", "s.method", "s.confidence").where("value is not null and value <> ''")
    return found.select("entity_id", "pos", "name", "value", "url", text.compact_fragment(F.col("value")).alias("fragment"), "method", "confidence")


def read_pages(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html) with what facts need of the html instead of it: all that a plan shuffles before the facts."""
    html, url = F.col("html"), F.col("url")
    return pages.select("page_id", "url", P.title(html).alias("page_title"), F.get(P.headings(html), F.lit(0)).alias("first_heading"), P.canonical_url(html, url).alias("canonical"), P.anchors(html).alias("anchors"))


def fact_candidates(pages: DataFrame) -> DataFrame:
    """Candidates from the signals of pages (page_id, url, html): names, site, services, contact and country. The entity is the host without www.

    Pages are read twice: for their own signals, and for their links.
    """
    return read_candidates(read_pages(pages))


def read_candidates(read: DataFrame) -> DataFrame:
    """fact_candidates of pages as read_pages gives them."""
    url = F.col("url")
    entity = lambda u: urls.without_www(urls.host(u))
    base = read.where("url is not null")
    name = F.trim(F.regexp_extract("page_title", r"^(.*?)(?:\s+[|—–-]\s+.*)?$", 1))
    own = [("company_name", name, "title"), ("company_name", F.col("first_heading"), "heading"), ("website_url", F.concat(urls.origin(F.col("canonical")), F.lit("/")), "canonical"), ("country", text.country_from_text(F.col("page_title")), "country_text")]
    nav = P.anchored_links(read)
    contact = F.when(F.col("url").rlike("(?i)/(contact|contact-us|get-in-touch|contacteer|contactgegevens)(/|$)"), F.col("url"))
    linked = [("services", F.col("text"), "service_section"), ("contact_page_url", contact, "contact")]
    return _signals(base, entity(url), F.col("page_id"), url, own).unionByName(_signals(nav, entity(F.col("base")), F.col("page_id") * 1000 + F.col("pos"), F.col("base"), linked))


def _raised(confidence: Column, n: Column) -> Column:
    return F.round(F.least(F.lit(0.99), confidence + F.when(n > 1, 0.01).otherwise(0.0)), 4)


def resolved(candidates: DataFrame) -> DataFrame:
    """(entity_id, name, value, confidence, n_urls, conflict): candidates by confidence; of those within AUTHORITY of the best, more than one conflict key is a conflict without a value; else the first, cited by all urls with its key.

    The two best keys of a field tell all: more than one is strong if the second is. Each task gives on two keys a field,
    so that no task gets all candidates, nor all keys, of a large field.
    """
    keyed = candidates.withColumn("key", text.conflict_key(F.col("name"), F.col("value")))
    by_key = keyed.groupBy("entity_id", "name", "key").agg(F.max(F.struct("confidence", (-F.col("pos")).alias("p"), F.col("value"))).alias("best"), F.countDistinct("url").alias("n_urls"))
    w = Window.partitionBy("entity_id", "name").orderBy(F.desc("best"), F.desc("n_urls"))
    two = by_key.withColumn("k", F.row_number().over(w)).where("k <= 2")
    per_field = two.groupBy("entity_id", "name").agg(F.max(F.when(F.col("k") == 1, F.struct("best", "n_urls"))).alias("b"), F.max(F.when(F.col("k") == 2, F.col("best.confidence"))).alias("second"))
    top = F.col("b.best.confidence")
    conflict = F.when(top.isNotNull(), F.coalesce(F.col("second") >= top - AUTHORITY, F.lit(False)))
    return per_field.select(
        "entity_id", "name", F.when(~conflict, F.col("b.best.value")).alias("value"), F.when(~conflict, _raised(F.col("b.best.confidence"), F.col("b.n_urls"))).alias("confidence"),
        F.when(~conflict, F.col("b.n_urls")).otherwise(0).alias("n_urls"), conflict.alias("conflict"),
    )


def resolved_services(candidates: DataFrame, limit: int = 20) -> DataFrame:
    """(entity_id, services, n_urls): the union of services by confidence, then place, each once whatever its case, at most `limit`; urls of those kept."""
    low = F.lower(text.compact(F.col("value")))
    first = candidates.where("name = 'services'").groupBy("entity_id", low.alias("low")).agg(F.max(F.struct("confidence", (-F.col("pos")).alias("p"), F.col("value"), F.col("url"))).alias("b"))
    w = Window.partitionBy("entity_id").orderBy(F.desc("b.confidence"), F.desc("b.p"), "low")
    kept = first.withColumn("k", F.row_number().over(w)).where(F.col("k") <= limit)
    return kept.groupBy("entity_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "b.value"))), lambda x: x["value"]).alias("services"), F.countDistinct("b.url").alias("n_urls"))


def resolved_urls(candidates: DataFrame, field: str) -> DataFrame:
    """(entity_id, value, conflict) of a url field: more than one registrable domain is a conflict (for contact pages among all candidates, else among the strong); else the shortest path, then the shortest url."""
    w = Window.partitionBy("entity_id")
    own = candidates.where(F.col("name") == field).withColumn("top", F.max("confidence").over(w))
    counted = own if field == "contact_page_url" else own.where(F.col("confidence") >= F.col("top") - AUTHORITY)
    size = F.size(urls.path_segments(F.col("value"))) if field == "contact_page_url" else F.length(urls.path(F.col("value")))
    out = counted.groupBy("entity_id").agg(F.countDistinct(urls.registrable_domain(urls.host(F.col("value")))).alias("n"), F.min(F.struct(size.alias("s"), F.length("value").alias("l"), F.col("value"))).alias("b"))
    return out.select("entity_id", F.when(F.col("n") == 1, F.col("b.value")).alias("value"), (F.col("n") > 1).alias("conflict"))


def densified(facts: DataFrame, requested: list[str]) -> DataFrame:
    """(entity_id, name, value, status): every entity with the core and the requested fields, null where it lacks one. An entity is rejected if a required field (company_name or requested) is null, or a personal one is asked for."""
    names = list(dict.fromkeys(CORE_FIELDS + requested))
    wanted = facts.select("entity_id").distinct().select("entity_id", F.explode(F.array(*[F.lit(n) for n in names])).alias("name"))
    full = wanted.join(facts.select("entity_id", "name", "value"), ["entity_id", "name"], "left")
    required = F.col("name").isin(["company_name", *requested])
    w = Window.partitionBy("entity_id")
    lacks = F.max(required & (F.col("value").isNull() | (F.col("name").isin(requested or [""]) & text.is_personal_field(F.col("name"))))).over(w)
    return full.withColumn("status", F.when(lacks, "rejected").otherwise("accepted")).select("entity_id", "name", F.when(~text.is_personal_field(F.col("name")), F.col("value")).alias("value"), "status")


def grounding(facts: DataFrame, pages: DataFrame) -> DataFrame:
    """facts (entity_id, name, value, evidence_urls, basis) with rejection, or null: a cited url that is no page, contact data, an inferred field that must be explicit, or a value not in the cited text."""
    cited = facts.select("entity_id", "name", "value", F.posexplode("evidence_urls").alias("k", "url")).join(pages.select("url", F.col("main_text").alias("page_text")), "url", "left")
    seen = cited.groupBy("entity_id", "name").agg(
        F.max(F.col("page_text").isNull()).alias("unknown"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "page_text"))), lambda x: x["page_text"]), "\n").alias("cited_text")
    )
    explicit = F.col("name").isin("company_name", "country", "services", "website_url", "contact_page_url")
    inside = F.contains(F.lower(text.compact(F.col("cited_text"))), F.lower(text.compact(F.col("value"))))
    why = (
        F.when(F.coalesce("unknown", F.lit(True)), "unknown_evidence").when(text.contains_contact(F.col("value")) & ~F.col("name").endswith("_url"), "personal_contact")
        .when(explicit & (F.col("basis") != "explicit"), "not_explicit").when((F.col("basis") == "explicit") & ~inside, "not_in_text")
    )
    return facts.join(seen, ["entity_id", "name"], "left").withColumn("rejection", why).drop("unknown", "cited_text")


def summary_grounding(value: Column, cited: Column) -> Column:
    """Why a summary is not grounded, or null: 160 characters copied, a number that is not cited, or fewer than 60 % of its words."""
    tokens, there = text.content_tokens(value), text.content_tokens(cited)
    numbers = lambda c: F.regexp_extract_all(c, F.lit(r"\d+"), 0)
    share = F.size(F.array_intersect(tokens, there)) * 10 >= F.size(tokens) * 6
    copied = (F.length(value) >= 160) & F.contains(F.lower(text.compact(cited)), F.lower(text.compact(value)))
    return F.when(copied, "long_copy").when(F.size(F.array_except(numbers(value), numbers(cited))) > 0, "numbers").when(~share, "unsupported")


def merged_with_llm(own: DataFrame, llm: DataFrame) -> DataFrame:
    """(entity_id, name, value, method): deterministic facts first, those of the model where there is none."""
    a, b = own.select("entity_id", "name", F.col("value").alias("a")), llm.select("entity_id", "name", F.col("value").alias("b"))
    both = a.join(b, ["entity_id", "name"], "full_outer")
    return both.select("entity_id", "name", F.coalesce("a", "b").alias("value"), F.when(F.col("a").isNotNull(), "deterministic").otherwise("llm").alias("method"))


def summaries(name: Column, services: Column, country: Column) -> Column:
    """"{name} provides a, b, c and is based in X." from at most three services."""
    first = F.array_join(F.slice(services, 1, 3), ", ")
    return F.when(name.isNotNull() & (F.size(services) > 0), F.concat(name, F.lit(" provides "), first, F.when(country.isNotNull(), F.concat(F.lit(" and is based in "), country)).otherwise(""), F.lit(".")))
