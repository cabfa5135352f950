"""Projections of results for spreadsheets, CSV and storage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import text, urls

RESEARCH_COLUMNS = ["Company", "Website", "Country", "Services", "Contact", "Summary", "Score", "Explanation", "Evidence URLs", "Compliance status", "Warnings", "Updated"]
# The words of a reason that make a skipped source rejected.
REJECTED = ["blocked", "rejected", "not approved", "not allowed"]


def research_rows(results: DataFrame, warnings: DataFrame | None = None) -> DataFrame:
    """results (name, website_url, country, services, contact, summary, total, explanation, evidence_urls, updated_at) as cells. Warnings (k, warning) that name the company or its website are joined in their order."""
    rows = results
    if warnings is None:
        rows = rows.withColumn("warnings", F.lit(""))
    else:
        said = F.contains(F.lower("warning"), F.lower("name")) | F.contains(F.lower("warning"), F.lower(F.coalesce("website_url", F.lit("\u0000"))))
        hits = results.select("name", "website_url").distinct().join(warnings, said).groupBy("name", "website_url").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "warning"))), lambda x: x["warning"]), "\n").alias("warnings"))
        rows = rows.join(hits, rows.name.eqNullSafe(hits.name) & rows.website_url.eqNullSafe(hits.website_url), "left").select(results["*"], F.coalesce(hits.warnings, F.lit("")).alias("warnings"))
    cell = text.spreadsheet_cell
    nothing = F.lit("")
    return rows.select(
        cell(F.col("name"), 300).alias("company"), cell(F.coalesce("website_url", nothing), 2048).alias("website"), cell(F.coalesce("country", nothing), 300).alias("country"),
        cell(F.array_join("services", "\n"), 2000).alias("services"), cell(F.coalesce("contact", nothing), 2048).alias("contact"), cell(F.coalesce("summary", nothing), 500).alias("summary"), F.col("total").alias("score"),
        cell(F.array_join("explanation", "\n"), 5000).alias("explanation"), cell(F.array_join(F.array_sort(F.array_distinct("evidence_urls")), "\n"), 5000).alias("evidence_urls"),
        F.lit("approved").alias("compliance_status"), cell(F.col("warnings"), 2000).alias("warnings"), F.date_format("updated_at", "yyyy-MM-dd'T'HH:mm:ss").alias("updated_at"),
    )


def skipped_rows(skipped: DataFrame) -> DataFrame:
    low = F.lower("reason")
    seen = lambda word: F.when(F.contains(low, F.lit(word)), "see reason").otherwise("not recorded")
    return skipped.select(
        text.spreadsheet_cell(urls.host(F.col("url")), 300).alias("domain"), text.spreadsheet_cell(F.col("url"), 2048).alias("url"), F.when(low.rlike("|".join(REJECTED)), "rejected").otherwise("skipped").alias("decision"),
        text.spreadsheet_cell(F.col("reason"), 1000).alias("reason"), seen("robot").alias("robots_status"), seen("term").alias("terms_status"),
    )


def metadata_rows(run: DataFrame) -> DataFrame:
    """One run as (key, value) rows."""
    keys = [("topic", "topic"), ("requested result count", "requested"), ("completed result count", "completed"), ("generated queries", "queries"), ("start time", "started"), ("completion time", "ended"), ("providers", "providers"), ("strict compliance mode", "strict"), ("warnings", "warnings")]
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), text.spreadsheet_cell(F.col(c).cast("string"), 5000).alias("value")) for k, c in keys])
    return run.select(F.explode(pairs).alias("p")).select("p.*")


def upserted(current: DataFrame, changes: DataFrame, key: str = "id", kept: str = "created_at") -> DataFrame:
    """current with changes by key: changed rows replaced but for `kept`, new ones added."""
    old = current.select(key, F.col(kept).alias("old_kept"))
    changed = changes.join(old, key, "left").withColumn(kept, F.coalesce("old_kept", kept)).drop("old_kept")
    return current.join(changes.select(key), key, "left_anti").unionByName(changed)


def write_csv(rows: DataFrame, path: str) -> None:
    """CSV with a header; formula signs of text columns are guarded."""
    guarded = rows.select(*[text.csv_guard(F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in rows.dtypes])
    guarded.write.mode("overwrite").option("header", True).csv(path)


def write_run_table(rows: DataFrame, path: str) -> None:
    """Rows appended to a table in folders by run, so that reads of a run see no other."""
    rows.write.mode("append").partitionBy("research_run_id").parquet(path)


#: Writers by format.
EXPORTERS = {"csv": write_csv, "table": write_run_table}


def export(spark: SparkSession, rows: DataFrame, fmt: str, path: str) -> dict:
    """Write rows; gives format, location and count."""
    if fmt not in EXPORTERS:
        raise ValueError(f"unknown format {fmt}")
    EXPORTERS[fmt](rows, path)
    return {"format": fmt, "location": path, "count": rows.count()}
