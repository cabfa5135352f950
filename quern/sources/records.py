"""Stored records, configuration and demo files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def run_records(table: DataFrame, run_id: str, order: list[str]) -> DataFrame:
    """Records of a run in their order; the filter reaches the scan."""
    return table.where(F.col("research_run_id") == run_id).orderBy(*order)


def from_columns(table: DataFrame, schema: dict[str, str]) -> DataFrame:
    """JSON text columns as nested ones."""
    return table.withColumns({c: F.from_json(c, s) for c, s in schema.items()})


def load_yaml(path: str) -> dict:
    """A YAML mapping; an empty file is an empty one."""
    import yaml

    with open(path, encoding="utf-8") as f:
        found = yaml.safe_load(f)
    if found is None:
        return {}
    if not isinstance(found, dict) or not all(isinstance(k, str) for k in found):
        raise ValueError(f"{path} must hold a mapping")
    return found


def domain_rules(spark: SparkSession, lists: dict[str, dict]) -> DataFrame:
    """(list, kind, rule) of approved, blocked and candidate lists with exact_domains and include_subdomains."""
    rows = [(name, kind, d.strip().lower()) for name, rules in lists.items() for kind, key in (("exact", "exact_domains"), ("subdomains", "include_subdomains")) for d in rules.get(key) or []]
    return spark.createDataFrame(rows, "list string, kind string, rule string").distinct()


def demo_results(spark: SparkSession, path: str) -> DataFrame:
    """The items of a demo file; its total must be their number."""
    whole = spark.read.option("multiLine", True).json(path)
    if not whole.where(F.col("total") != F.size("items")).isEmpty():
        raise ValueError("total and items differ")
    return whole.select(F.explode("items").alias("i")).select("i.*")
