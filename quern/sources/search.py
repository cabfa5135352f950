"""Search candidates from stored responses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions import urls
from quern.operators import pages

RESPONSE = "array<struct<title: string, url: string>>"


def candidates(responses: DataFrame, provider: str, paged: bool, tags: bool) -> DataFrame:
    """(query, rank, title, url, domain, provider) of responses (query, offset, count, body: JSON array).

    Blank titles and urls without a valid domain go, but count in rank = offset * count + place. A provider
    without pages gives nothing beyond offset 0; one with tags in titles has them cleaned.
    """
    rows = responses.select("query", "offset", "count", F.posexplode(F.from_json("body", RESPONSE)).alias("k", "r"))
    if not paged:
        rows = rows.where("offset = 0")
    title = pages.plain(F.col("r.title")) if tags else F.trim(F.col("r.title"))
    out = rows.select("query", (F.col("k") + 1 + F.col("offset") * F.col("count")).cast("int").alias("rank"), title.alias("title"), F.col("r.url").alias("url"), urls.normalize_domain(urls.host(F.col("r.url"))).alias("domain"), F.lit(provider).alias("provider"))
    return out.where("title <> '' and domain is not null")


def in_memory(rows: DataFrame, offset: int, count: int) -> DataFrame:
    """A slice of candidates by rank."""
    return rows.where((F.col("rank") > offset * count) & (F.col("rank") <= (offset + 1) * count))


#: Search providers by name.
PROVIDERS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "tavily": lambda r: candidates(r, "tavily", paged=False, tags=False),
    "brave": lambda r: candidates(r, "brave", paged=True, tags=True),
}


def resolve(name: str | None) -> Callable[[DataFrame], DataFrame]:
    key = (name or "tavily").casefold()
    if key not in PROVIDERS:
        raise ValueError(f"unknown search provider {name}")
    return PROVIDERS[key]
