"""Enrichment of companies from registry, knowledge base and gazetteer tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions import text, urls


def from_registry(companies: DataFrame, registry: DataFrame) -> DataFrame:
    """(id, status, registry_id, n): companies by registry name, and by country code where one is known. One distinct registry id is a match, more are ambiguous, none is unmatched."""
    keyed = registry.select(text.registry_name(F.col("name")).alias("key"), F.lower("jurisdiction").alias("jurisdiction"), "registry_id").where("key <> ''").distinct()
    own = companies.select("id", text.registry_name(F.col("name")).alias("key"), F.lower("country_code").alias("code"))
    hits = own.join(keyed, "key", "left").where("code is null or jurisdiction is null or code = jurisdiction or jurisdiction like concat(code, '_%')")
    found = hits.groupBy("id").agg(F.countDistinct("registry_id").alias("n"), F.min("registry_id").alias("one"))
    return own.select("id").join(found, "id", "left").select("id", F.when(F.coalesce("n", F.lit(0)) == 0, "unmatched").when(F.col("n") == 1, "matched").otherwise("ambiguous").alias("status"), F.when(F.col("n") == 1, F.col("one")).alias("registry_id"), F.coalesce("n", F.lit(0)).alias("n"))


def from_knowledge_base(companies: DataFrame, bindings: DataFrame) -> DataFrame:
    """(id, item, countries, warning): items whose label is the company's name and whose website is its own. Bindings repeat an item for each combination of values; they are grouped first."""
    items = bindings.groupBy("item").agg(F.min("label").alias("label"), F.array_sort(F.collect_set("website")).alias("websites"), F.array_sort(F.collect_set("country")).alias("countries"))
    own = companies.select("id", F.lower(text.compact(F.col("name"))).alias("key"), "website_url")
    hits = own.join(items.withColumn("key", F.lower(text.compact(F.col("label")))), "key").where(F.exists("websites", lambda w: urls.same_website(w, F.col("website_url"))))
    found = hits.groupBy("id").agg(F.count("*").alias("n"), F.min_by("item", "item").alias("item"), F.min_by("countries", "item").alias("countries"))
    return own.select("id").join(found, "id", "left").select("id", F.when(F.col("n") == 1, F.col("item")).alias("item"), F.when(F.col("n") == 1, F.array_join("countries", ", ")).alias("countries"), F.when(F.coalesce("n", F.lit(0)) == 0, "no_match").when(F.col("n") > 1, "ambiguous").when(F.size("countries") > 1, "several_countries").alias("warning"))


def from_gazetteer(companies: DataFrame, countries: DataFrame, places: DataFrame) -> DataFrame:
    """(id, country_code, city_status): a country by name or code; a city that the gazetteer has in it, only in others (contradiction), or not."""
    names = countries.select("country_code", F.explode(F.array_distinct(F.array(text.normalized_place(F.col("country_name")), F.lower("country_code"), F.lower("iso_alpha3")))).alias("key")).groupBy("key").agg(F.min("country_code").alias("country_code"))
    towns = places.select(text.normalized_place(F.col("name")).alias("town"), F.col("country_code").alias("town_code")).distinct().groupBy("town").agg(F.array_sort(F.collect_set("town_code")).alias("codes"))
    own = companies.select("id", text.normalized_place(F.col("country")).alias("key"), text.normalized_place(F.col("city")).alias("town"))
    both = own.join(names, "key", "left").join(towns, "town", "left")
    status = F.when(F.col("town").isNull(), "no_city").when(F.col("codes").isNull(), "unknown_city").when(F.array_contains("codes", F.coalesce("country_code", F.lit("")) ), "validated").otherwise("contradiction")
    return both.select("id", "country_code", status.alias("city_status"))


def unoccupied(additions: DataFrame, fields: DataFrame) -> DataFrame:
    """Additions (id, name, value) to fields that the company has not."""
    return additions.join(fields.select("id", "name").distinct(), ["id", "name"], "left_anti")


def contradictions(additions: DataFrame, fields: DataFrame) -> DataFrame:
    """Additions whose field the company has with another value."""
    return additions.join(fields.select("id", "name", F.col("value").alias("held")), ["id", "name"]).where(F.lower("held") != F.lower("value"))
