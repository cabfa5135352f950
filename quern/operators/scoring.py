"""Relevance of companies, 0 to 100, in seven components; and their ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import text, urls

# The most that each component gives, and the fields that they read.
MAXIMA = {"topic": 30, "location": 20, "services": 15, "website": 10, "contact": 10, "evidence": 10, "completeness": 5}
SERVICE_FIELDS = ["service", "services", "offerings"]
LOCATION_FIELDS = ["address", "country", "headquarters", "headquarters_location", "location", "registered_address"]
IGNORED_FIELDS = ["proposed_relevance_score", "relevance_score", "score"]
NL_MARKERS = ["nl", "nederland", "netherlands", "the netherlands"]
NL_CITIES = ["amsterdam", "den haag", "eindhoven", "groningen", "rotterdam", "the hague", "tilburg", "utrecht"]


def component_scores(facts: DataFrame, companies: DataFrame, terms: list[str], location: str, requested: list[str]) -> DataFrame:
    """One row an entity: topic, location, services, website, contact, evidence, completeness and total.

    facts: entity_id, pos, name, value, basis (explicit or inference), confidence, evidence_urls. companies:
    entity_id, website_url. Facts are read once: they are aggregated by entity and field, those rows by entity, and only
    then companies are joined. Each aggregate is of a fixed size but for the domains of an entity's own urls.
    """
    listed = lambda xs: F.array(*[F.lit(x) for x in xs]).cast("array<string>")
    name, value, low = F.col("name"), F.col("value"), F.col("low")
    rows = facts.withColumn("low", F.lower(text.compact(value))).withColumn("cited", (F.size(F.coalesce("evidence_urls", F.array().cast("array<string>"))) > 0) & value.isNotNull())
    cited = F.col("cited")
    supported = cited & ~name.isin(IGNORED_FIELDS)
    explicit, inferred = F.col("basis") == "explicit", F.col("basis") == "inference"
    service = name.isin(SERVICE_FIELDS)
    dutch = location.lower() in NL_MARKERS
    match = F.contains(low, F.lit(location.lower())) | (F.lit(dutch) & (low.isin(NL_MARKERS) | low.rlike("netherlands|nederland")))
    placed = supported & name.isin(LOCATION_FIELDS)
    city = F.lit(dutch) & low.rlike("|".join(NL_CITIES))
    kind = F.when(placed, F.when(explicit & match, "stated").when(inferred & match, "inferred").when(explicit & city, "city"))
    # a url's own domain, if one of its evidence has it, too: to be held against the company's
    own = F.when(supported & explicit & name.isin("website_url", "contact_page_url") & F.exists("evidence_urls", lambda u: urls.same_registrable_domain(value, u)), urls.registrable_domain(urls.normalize_domain(value)))
    seen = F.when(supported, F.transform("evidence_urls", urls.normalize_company_url))
    any_ = lambda c: F.max(F.coalesce(c, F.lit(False)))
    rows = rows.select(
        "entity_id", "pos", "name", "confidence", "low", "cited", supported.alias("supported"), explicit.alias("explicit"), inferred.alias("inferred"), service.alias("service"),
        (supported & F.arrays_overlap(F.regexp_extract_all(low, F.lit(text.WORD), 0), listed(terms))).alias("hit"), kind.alias("kind"), own.alias("own"), seen.alias("seen"),
    )
    c = F.col
    fields = rows.groupBy("entity_id", "name").agg(
        any_(c("service") & c("hit") & c("explicit")).alias("service_stated"), any_(c("service") & c("hit") & c("inferred")).alias("service_inferred"), any_(~c("service") & c("hit") & c("explicit")).alias("other_stated"),
        F.min_by("kind", F.when(c("kind").isNotNull(), c("pos"))).alias("kind"), F.min(F.when(c("kind").isNotNull(), c("pos"))).alias("place_pos"),
        F.min_by(F.when(c("explicit"), 15).otherwise(5), F.when(c("service") & c("hit"), c("pos"))).alias("service_points"), F.min(F.when(c("service") & c("hit"), c("pos"))).alias("service_pos"),
        F.collect_set("own").alias("own"), any_(c("supported")).alias("supported"), any_(c("supported") & c("inferred")).alias("inference"),
        # more than one of them: the least is not the greatest
        F.min(F.array_min("seen")).alias("first_seen"), F.max(F.array_max("seen")).alias("last_seen"),
        F.coalesce(F.min(F.when(c("cited"), c("low"))) != F.max(F.when(c("cited"), c("low"))), F.lit(False)).alias("contrary"),
        any_(name.isNotNull() & ((F.coalesce("confidence", F.lit(1.0)) < 0.5) | ~c("cited"))).alias("weak"), (any_(c("cited")) & name.isin(requested or [""])).alias("complete"),
    )
    points = F.when(c("kind") == "stated", F.when(c("contrary"), 10).otherwise(20)).when(c("kind") == "inferred", 5).when(c("kind") == "city", 10)
    domains = lambda n: F.flatten(F.collect_list(F.when(name == n, c("own"))))
    agg = fields.groupBy("entity_id").agg(
        F.when(F.max("service_stated"), 30).when(F.max("service_inferred"), 10).when(F.max("other_stated"), 8).otherwise(0).alias("topic"),
        F.coalesce(F.min_by(points, "place_pos"), F.lit(0)).alias("location"), F.coalesce(F.min_by("service_points", "service_pos"), F.lit(0)).alias("services"),
        domains("website_url").alias("sites"), domains("contact_page_url").alias("contacts"), F.max("supported").alias("supported"), F.max("inference").alias("inference"),
        F.coalesce(F.min("first_seen") != F.max("last_seen"), F.lit(False)).alias("documents"), F.max("contrary").alias("contrary"),
        F.sum(c("weak").cast("int")).alias("weak"), F.sum(c("complete").cast("int")).alias("complete"),
    )
    named = companies.groupBy("entity_id").agg(F.max("website_url").alias("company_url"), F.collect_set(urls.registrable_domain(urls.normalize_domain(F.col("website_url")))).alias("at"))
    met = agg.join(named, "entity_id", "left")
    held = lambda xs: F.coalesce(F.arrays_overlap(xs, "at"), F.lit(False))
    met = met.withColumn("website", F.when(F.when(c("company_url").isNull(), F.size("sites") > 0).otherwise(held("sites")), 10).otherwise(0))
    met = met.withColumn("contact", F.when(held("contacts"), 10).otherwise(0))
    evidence = 8 + F.when(c("documents"), 2).otherwise(0) - F.when(c("inference"), 2).otherwise(0) - F.when(c("contrary"), 4).otherwise(0) - F.least(F.lit(4), c("weak") * 2)
    out = met.withColumn("evidence", F.when(~c("supported"), 0).otherwise(F.greatest(F.lit(0), evidence)))
    done = text.round_ratio(5, F.col("complete"), F.lit(len(requested))).cast("int") if requested else F.lit(5)
    out = out.withColumn("completeness", done)
    return out.select("entity_id", *[F.col(c).cast("int").alias(c) for c in MAXIMA], sum((F.col(c) for c in MAXIMA), F.lit(0)).cast("int").alias("total"))


def penalties(scores: DataFrame) -> DataFrame:
    """(entity_id, component, points): what each component lacks of its most; none where it lacks nothing. Points of an entity and its total make 100."""
    parts = F.array(*[F.struct(F.lit(c).alias("component"), (F.lit(m) - F.col(c)).alias("points")) for c, m in MAXIMA.items()])
    return scores.select("entity_id", F.explode(F.filter(parts, lambda p: p["points"] > 0)).alias("p")).select("entity_id", "p.component", "p.points")


def ranking(scored: DataFrame, limit: int) -> DataFrame:
    """The best `limit` by total, then name whatever its case, then website."""
    return scored.orderBy(F.desc("total"), F.lower("name"), "website_url").limit(limit)


def page(rows: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """Rows offset to offset + limit of an order, with the number of all rows."""
    total = rows.agg(F.count("*").alias("total"))
    return rows.orderBy(*order).offset(offset).limit(limit).join(F.broadcast(total))  # one row


def progress_fraction(stage: Column, stages: list[str], terminal: list[str]) -> Column:
    at = F.array_position(F.array(*[F.lit(s) for s in stages]), stage)
    return F.when(stage.isin(terminal), 1.0).when(stage.isNull() | (at == 0), 0.02).otherwise(F.least(F.lit(0.95), at / (len(stages) + 1)))
