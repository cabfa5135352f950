"""Checks of extracted fields, enrichments and settings of rules, and small views on results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import urls

#: The fields that must be explicit and cited for a company to count as verified.
IDENTITY = ["company_name", "website_url"]


def independently_verified(fields: DataFrame) -> DataFrame:
    """(entity_id, verified) from fields (entity_id, name, value, basis, evidence_urls): each field of IDENTITY has a value, is explicit and cited."""
    good = F.col("value").isNotNull() & (F.col("basis") == "explicit") & (F.size(F.coalesce("evidence_urls", F.array().cast("array<string>"))) > 0)
    held = [F.coalesce(F.max(F.when(F.col("name") == n, good)), F.lit(False)) for n in IDENTITY]
    return fields.groupBy("entity_id").agg((held[0] & held[1]).alias("verified"))


def safe_identity_url(value: Column, page_url: Column) -> Column:
    """An http(s) url with a host, of the registrable domain of the page that states it."""
    return F.coalesce(urls.scheme(value).isin("http", "https") & (urls.host(value) != "") & urls.same_registrable_domain(value, page_url), F.lit(False))


def at_least(results: DataFrame, least: Column, score: str = "score") -> DataFrame:
    """Rows whose score, 0 if null, is at least `least`."""
    return results.where(F.coalesce(score, F.lit(0)) >= least)


def unique_identifiers(identifiers: DataFrame) -> DataFrame:
    """(entity_id, pos, source, value, label): one row for each source and value, at its first place with its last label."""
    return identifiers.groupBy("entity_id", "source", "value").agg(F.min("pos").alias("pos"), F.max_by("label", "pos").alias("label")).select("entity_id", "pos", "source", "value", "label")


def first_supported(fields: DataFrame, names: list[str]) -> DataFrame:
    """(entity_id, value): the first field, by pos, of one of the names that has evidence."""
    cited = fields.where(F.col("name").isin(names) & (F.size("evidence_urls") > 0))
    return cited.groupBy("entity_id").agg(F.min_by("value", "pos").alias("value"))


def retry_delay(retry_after: Column, reset: Column | None = None) -> Column:
    """Seconds to wait: the first number of a Retry-After header, or of the reset header where that is null or empty; not below 0, null if it is no number."""
    value = retry_after if reset is None else F.coalesce(F.nullif(retry_after, F.lit("")), reset)
    return F.greatest(F.lit(0.0), F.split(value, ",")[0].try_cast("double")) + F.when(F.split(value, ",")[0].try_cast("double").isNull(), F.lit(None).cast("double")).otherwise(0.0)


def enrichment_rejection(name: Column, website: Column, new_name: Column, new_website: Column, uncited: Column) -> Column:
    """Why an enrichment is ignored: `identity` if it changes name or website, `evidence` if a field lacks evidence, else null."""
    same = new_name.eqNullSafe(name) & urls.normalize_company_url(new_website).eqNullSafe(urls.normalize_company_url(website))
    return F.when(~same, "identity").when(uncited, "evidence")


def clean_pages(ranked: DataFrame, cleaned: DataFrame) -> DataFrame:
    """(entity_id, pos, page): for each ranked url (entity_id, url, pos) the last cleaned page (entity_id, url, page, seq) of
    that url; an entity without any such page gets its first cleaned page, with pos 0."""
    key = lambda c: urls.normalize_company_url(F.col(c))
    last = cleaned.select("entity_id", key("url").alias("k"), "page", "seq").groupBy("entity_id", "k").agg(F.max_by("page", "seq").alias("page"))
    met = ranked.select("entity_id", key("url").alias("k"), "pos").join(last, ["entity_id", "k"]).select("entity_id", "pos", "page")
    first = cleaned.groupBy("entity_id").agg(F.min_by("page", "seq").alias("page"))
    alone = first.join(met.select("entity_id").distinct(), "entity_id", "left_anti").select("entity_id", F.lit(0).cast("long").alias("pos"), "page")
    return met.union(alone)


def listed_domains(rules: DataFrame) -> DataFrame:
    """(domain, origins) from rules (list, kind, rule): the lists that name each domain, in the order approved, blocked, candidate."""
    order = F.array(*[F.lit(x) for x in ("approved exact", "approved recursive", "blocked exact", "blocked recursive", "candidate review")])
    label = F.when(F.col("list") == "candidate", "candidate review").otherwise(F.concat_ws(" ", "list", F.when(F.col("kind") == "exact", "exact").otherwise("recursive")))
    named = rules.groupBy(F.col("rule").alias("domain")).agg(F.collect_set(label).alias("labels"))  # at most five labels
    return named.select("domain", F.array_join(F.array_intersect(order, "labels"), ", ").alias("origins"))


def live_targets(targets: DataFrame, rules: DataFrame) -> DataFrame:
    """The targets (domain, ...) that an approved exact rule names."""
    approved = rules.where("list = 'approved' and kind = 'exact'").select(F.col("rule").alias("domain"))
    return targets.join(approved, "domain", "left_semi")


def skipped_items(skipped: DataFrame) -> DataFrame:
    """(id, domain, url, reason) from skipped sources (id, url, reason): the url's host, and the reason without secrets."""
    from quern.functions import text

    return skipped.select("id", urls.host(F.col("url")).alias("domain"), "url", text.redact(F.col("reason")).alias("reason"))
