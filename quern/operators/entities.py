"""Entity resolution: blocked pairs, the ladder of decisions, clusters and merged records."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import text, urls

#: Larger blocks are paired slice by slice. Slices of this size stay in memory (4,096 rows) where a join holds one of them.
SALT_ROWS = 2000
SOURCES = ("opencorporates", "wikidata")


def signals(companies: DataFrame, suffixes: list[str] | None = None) -> DataFrame:
    """companies (id, name, website_url, canonical_url, ids array<string>) with what pairs are judged by."""
    site = lambda c: F.nullif(urls.registrable_domain(urls.host(urls.normalize_company_url(F.col(c))), suffixes), F.lit(""))
    return companies.select(
        "id", "name", text.normalize_company_name(F.col("name")).alias("norm_name"), site("website_url").alias("domain"),
        site("canonical_url").alias("canonical"), F.coalesce("ids", F.array().cast("array<string>")).alias("ids"),
    )


def candidate_pairs(signals_: DataFrame, fuzzy: int = 92) -> DataFrame:
    """(a, b), a < b: records that share a domain, an identifier or a name, or have similar names. No other pair can merge or need a review."""
    return _met(signals_, fuzzy).select(F.least("a_id", "b_id").alias("a"), F.greatest("a_id", "b_id").alias("b")).distinct()


def entity_pairs(signals_: DataFrame, fuzzy: int = 92) -> DataFrame:
    """decided_pairs of all candidate_pairs, without a shuffle of pairs: only records are shuffled, with their signals, and each pair is judged where it is made."""
    return _judged(_met(signals_, fuzzy), F.least("a_id", "b_id"), F.greatest("a_id", "b_id"), fuzzy)


def _met(signals_: DataFrame, fuzzy: int) -> DataFrame:
    """Pairs of records as a_ and b_ columns, in any order, each once.

    Each block key is a join key and all pairs of a block are made. A pair is made under the first of the keys that both records have,
    and as a similar one only if they have none, so nothing is left to make distinct. Blocks of more than SALT_ROWS records are cut in
    slices by id, and each two slices meet under a key of their own, so that no task makes all pairs of a large block.
    """
    keys = F.array_union(F.array(F.concat(F.lit("d:"), "domain"), F.concat(F.lit("d:"), "canonical"), F.concat(F.lit("n:"), "norm_name")), F.transform("ids", lambda i: F.concat(F.lit("i:"), i)))
    rows = _with_sources(signals_).withColumn("keys", F.array_sort(F.array_distinct(F.array_compact(keys)))).where("id is not null")
    held = rows.drop("keys").columns
    blocks = rows.select(*held, F.posexplode("keys").alias("k", "key"), "keys").withColumn("before", F.slice("keys", 1, F.col("k"))).drop("k", "keys")
    # at most one row for each SALT_ROWS rows of blocks
    large = F.broadcast(blocks.groupBy("key").agg(F.ceil(F.count("*") / SALT_ROWS).cast("int").alias("slices")).where("slices > 1"))
    sized = blocks.join(large, "key", "left").withColumn("slices", F.coalesce("slices", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("id"), "slices").cast("int"))
    first = _side(sized.withColumn("s", F.col("own")).withColumn("t", F.explode(F.sequence("own", F.col("slices") - 1))), "a", [*held, "before"], ["key", "s", "t"])
    second = _side(sized.withColumn("t", F.col("own")).withColumn("s", F.explode(F.sequence(F.lit(0), "own"))), "b", [*held, "before"], ["key", "s", "t"])
    once = (F.col("a_id") < F.col("b_id")) | ((F.col("s") < F.col("t")) & (F.col("a_id") != F.col("b_id")))
    shared = first.join(second, ["key", "s", "t"]).where(once & ~F.arrays_overlap("a_before", "b_before"))
    # the same for records of similar names: slices of one name meet slices of the other
    counts = rows.groupBy("norm_name").agg(F.ceil(F.count("*") / SALT_ROWS).cast("int").alias("slices"))
    alike = similar_names(signals_, fuzzy)
    for c in "xy":
        alike = alike.join(counts.select(F.col("norm_name").alias(c), F.col("slices").alias(f"{c}_slices")), c)
    slot = lambda c: F.pmod(F.xxhash64("id"), f"{c}_slices").cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(f"{c}_slices") - 1))
    named = lambda c: rows.join(alike.withColumnRenamed(c, "norm_name").withColumn(c, F.col("norm_name")), "norm_name")
    first = _side(named("x").withColumn("s", slot("x")).withColumn("t", every("y")), "a", [*held, "keys"], ["x", "y", "s", "t"])
    second = _side(named("y").withColumn("t", slot("y")).withColumn("s", every("x")), "b", [*held, "keys"], ["x", "y", "s", "t"])
    similar = first.join(second, ["x", "y", "s", "t"]).where(~F.arrays_overlap("a_keys", "b_keys") & (F.col("a_id") != F.col("b_id")))
    columns = [f"{s}_{c}" for s in "ab" for c in held]
    return shared.select(*columns).union(similar.select(*columns))


def _side(rows: DataFrame, prefix: str, columns: list[str], on: list[str]) -> DataFrame:
    """Columns under a prefix, dealt by `on` to as many partitions as are set: few bytes make many pairs, so that partitions must not be joined by their bytes."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.select(*on, *[F.col(c).alias(f"{prefix}_{c}") for c in columns]).repartition(n, *on)


def similar_pairs(signals_: DataFrame, fuzzy: int = 92) -> DataFrame:
    """(a, b), a < b: records of names with a similarity_percent of at least fuzzy, whatever else they share."""
    left, right = (signals_.select(F.col("id").alias(c), F.col("norm_name").alias(n)) for c, n in (("a", "x"), ("b", "y")))
    return similar_names(signals_, fuzzy).join(left, "x").join(right, "y").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()


def similar_names(signals_: DataFrame, fuzzy: int = 92) -> DataFrame:
    """(x, y), x < y, distinct: names with a similarity_percent of at least fuzzy.

    Names of n and m <= n characters are similar at an edit distance of at most k = floor(n * (100 - fuzzy) / 100), and
    m >= n - k. The shorter name is cut in k + 1 segments; one of them is left whole and stands in the longer
    name within k characters of its place (PassJoin). Keys are (m, n, segment, its characters). Only pairs that
    pass are made distinct. With k = 0 names are similar to themselves alone.
    """
    names = signals_.where("norm_name <> ''").select("norm_name").distinct().withColumn("n", F.length("norm_name"))
    k = lambda n: F.floor(n * (100 - fuzzy) / 100).cast("int")
    start = lambda m, n, i: F.floor(m * i / (k(n) + 1)).cast("int")
    # a name as the shorter one, for each size that the longer may have
    top = F.ceil(F.col("n") * 100 / fuzzy).cast("int") + 1
    shorter = names.select(F.col("norm_name").alias("x"), F.col("n").alias("m"), F.explode(F.sequence("n", top)).alias("n")).where((k(F.col("n")) > 0) & (k(F.col("n")) >= F.col("n") - F.col("m")))
    shorter = shorter.select("x", "m", "n", F.explode(F.sequence(F.lit(0), k(F.col("n")))).alias("i"))
    shorter = shorter.select("x", "m", "n", "i", F.substr("x", start(F.col("m"), F.col("n"), F.col("i")) + 1, start(F.col("m"), F.col("n"), F.col("i") + 1) - start(F.col("m"), F.col("n"), F.col("i"))).alias("part"))
    longer = names.where(k(F.col("n")) > 0).select(F.col("norm_name").alias("y"), "n", F.explode(F.sequence(F.col("n") - k(F.col("n")), F.col("n"))).alias("m")).where("m > 0")
    longer = longer.select("y", "m", "n", F.explode(F.sequence(F.lit(0), k(F.col("n")))).alias("i")).select("y", "m", "n", "i", F.explode(F.sequence(-k(F.col("n")), k(F.col("n")))).alias("o"))
    at = start(F.col("m"), F.col("n"), F.col("i")) + F.col("o")
    size = start(F.col("m"), F.col("n"), F.col("i") + 1) - start(F.col("m"), F.col("n"), F.col("i"))
    longer = longer.where((at >= 0) & (at + size <= F.col("n"))).select("y", "m", "n", "i", F.substr("y", at + 1, size).alias("part")).distinct()
    met = shorter.join(longer, ["m", "n", "i", "part"]).where((F.col("m") < F.col("n")) & (F.col("x") != F.col("y")) | (F.col("x") < F.col("y")))
    alike = met.where(text.similarity_percent(F.col("x"), F.col("y")) >= fuzzy)
    return alike.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()


def _block_pairs(blocks: DataFrame) -> DataFrame:
    """(a, b), a < b, distinct: all pairs of the ids of each key of (id, key)."""
    sizes = blocks.groupBy("key").agg(F.ceil(F.count("*") / SALT_ROWS).cast("int").alias("slices"), F.count("*").alias("n")).where("n > 1")
    sized = blocks.join(sizes, "key").select("key", "id", "slices", F.pmod(F.xxhash64("id"), "slices").cast("int").alias("s"))
    first = sized.select("key", F.col("id").alias("a"), "s", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("t"))
    second = sized.select("key", F.col("id").alias("b"), F.col("s").alias("t"), F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("s"))
    return first.join(second, ["key", "s", "t"]).where("a < b").select("a", "b").distinct()


def merge_edges(signals_: DataFrame) -> DataFrame:
    """(a, b): edges that connect what the merges among all pairs of records connect, without making those pairs.

    Merges are decided by domain, canonical domain and identifiers only, so records equal in these are one kind. Kinds
    are judged by their smallest ids, each also against itself; where two merge, all records of one meet the
    smallest of the other, which connects all of both.
    """
    kinds = signals_.withColumn("kind", F.struct("domain", "canonical", F.array_sort("ids").alias("ids")))
    kinds = kinds.withColumn("kind", F.sha2(F.to_json("kind"), 256))
    low = kinds.groupBy("kind").agg(F.min("id").alias("low"))
    members = kinds.select("id", "kind").join(low, "kind").select("id", "low")
    ones = signals_.join(low.select(F.col("low").alias("id")), "id", "left_semi")
    keys = F.array_compact(F.array_union(F.array(F.concat(F.lit("d:"), "domain"), F.concat(F.lit("d:"), "canonical")), F.transform("ids", lambda i: F.concat(F.lit("i:"), i))))
    pairs = _block_pairs(ones.select("id", F.explode(F.array_distinct(keys)).alias("key"))).union(ones.select(F.col("id").alias("a"), F.col("id").alias("b")))
    merged = decided_pairs(ones, pairs).where("outcome = 'merge'").select("a", "b")
    left = merged.join(members, F.col("low") == F.col("a")).select(F.col("id").alias("a"), "b")
    right = merged.join(members, F.col("low") == F.col("b")).select("a", F.col("id").alias("b"))
    return left.union(right).where("a <> b").distinct()


def _ids_by_source(ids: Column, source: str) -> Column:
    return F.filter(ids, lambda i: F.startswith(i, F.lit(source + ":")))


def _with_sources(signals_: DataFrame) -> DataFrame:
    """With the identifiers of each source, read once a record and not once a pair."""
    return signals_.select("*", *[_ids_by_source(F.col("ids"), s).alias(s) for s in SOURCES])


def decided_pairs(signals_: DataFrame, pairs: DataFrame, fuzzy: int = 92) -> DataFrame:
    """(a, b, outcome, confidence, reason) by the first rule that fits."""
    rows = _with_sources(signals_)
    left, right = (rows.select(*[F.col(c).alias(f"{s}_{c}") for c in rows.columns]) for s in "ab")
    both = pairs.join(left, F.col("a") == F.col("a_id")).join(right, F.col("b") == F.col("b_id"))
    return _judged(both, F.col("a"), F.col("b"), fuzzy)


def _judged(both: DataFrame, a: Column, b: Column, fuzzy: int) -> DataFrame:
    """(a, b, outcome, confidence, reason) of pairs with a_ and b_ columns of their signals and sources."""
    ambiguous = conflicting = F.lit(False)
    for s in SOURCES:
        one, two = F.col(f"a_{s}"), F.col(f"b_{s}")
        ambiguous = ambiguous | (F.size(one) > 1) | (F.size(two) > 1)
        conflicting = conflicting | ((F.size(one) > 0) & (F.size(two) > 0) & ~F.arrays_overlap(one, two))
    score = text.similarity_percent(F.col("a_norm_name"), F.col("b_norm_name"))
    rules = [
        (ambiguous, "manual_review", F.lit(0.5), "ambiguous_identifiers"),
        (conflicting, "separate", F.lit(0.99), "conflicting_identifiers"),
        (F.col("a_domain") == F.col("b_domain"), "merge", F.lit(0.99), "domain"),
        ((F.coalesce("a_canonical", "a_domain") == F.coalesce("b_canonical", "b_domain")), "merge", F.lit(0.98), "canonical_domain"),
        (F.arrays_overlap("a_ids", "b_ids"), "merge", F.lit(0.99), "identifier"),
        (F.col("a_norm_name") == F.col("b_norm_name"), "manual_review", F.lit(0.94), "exact_name"),
        (score >= fuzzy, "manual_review", score / 100, "fuzzy_name"),
    ]
    # the rule first, so that conditions are tried once for all three columns
    rule = None
    for k, (fits, *_) in enumerate(rules):
        fits = F.coalesce(fits, F.lit(False))
        rule = F.when(fits, k) if rule is None else rule.when(fits, k)
    ruled = both.select(a.alias("a"), b.alias("b"), "a_norm_name", "b_norm_name", rule.otherwise(len(rules)).alias("rule"))
    outcome = confidence = reason = None
    for k, (_, o, c, r) in enumerate(rules):
        fits = F.col("rule") == k
        outcome = F.when(fits, o) if outcome is None else outcome.when(fits, o)
        confidence = F.when(fits, c) if confidence is None else confidence.when(fits, c)
        reason = F.when(fits, r) if reason is None else reason.when(fits, r)
    apart = F.greatest(F.lit(0.5), 1 - F.coalesce(score, F.lit(0)) / 100)
    return ruled.select("a", "b", outcome.otherwise("separate").alias("outcome"), F.round(confidence.otherwise(apart), 4).alias("confidence"), reason.otherwise("different").alias("reason"))


def clusters(ids: DataFrame, merges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(id, cluster): the smallest id that merges reach. Rounds of smallest neighbours with label jumping, each written to the folder in spark.checkpoint.dir."""
    spark = ids.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not folder:
        import tempfile

        folder = f"file://{tempfile.mkdtemp(prefix='quern-')}"

    def kept(df: DataFrame) -> DataFrame:
        at = f"{folder}/quern-clusters-{uuid.uuid4().hex}"
        df.write.parquet(at)
        return spark.read.schema(df.schema).parquet(at)

    edges = merges.select(F.col("a").alias("x"), F.col("b").alias("y"))
    edges = kept(edges.union(edges.select("y", "x")).distinct())
    labels = kept(ids.select("id", F.col("id").alias("cluster")).distinct())
    for _ in range(max_rounds):
        near = edges.join(labels, F.col("y") == F.col("id")).groupBy("x").agg(F.min("cluster").alias("m"))
        low = labels.join(near, F.col("id") == F.col("x"), "left").select("id", "cluster", F.least("cluster", F.coalesce("m", "cluster")).alias("new"))
        jump = low.select(F.col("id").alias("j"), F.col("new").alias("jumped"))
        new = kept(low.join(jump, F.col("new") == F.col("j"), "left").select("id", "cluster", F.least("new", F.coalesce("jumped", "new")).alias("new")))
        moved = new.where("new < cluster").isEmpty()
        labels = new.select("id", F.col("new").alias("cluster"))
        if moved:
            break
    return labels


def merged_records(companies: DataFrame, clustered: DataFrame) -> DataFrame:
    """One record a cluster: each field from the record with the highest confidence, the smaller id on a tie, null giving way; created earliest, updated latest, evidence united."""
    rows = companies.join(clustered, "id")
    best = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(F.coalesce("confidence", F.lit(0.5)), -F.col("id"))))
    evidence = F.array_sort(F.array_distinct(F.flatten(F.collect_list("evidence_urls"))))
    return rows.groupBy("cluster").agg(
        best("name").alias("name"), best("website_url").alias("website_url"), F.min("created_at").alias("created_at"), F.max("updated_at").alias("updated_at"), evidence.alias("evidence_urls"), F.count("*").alias("members")
    )


def merged_fields(fields: DataFrame) -> DataFrame:
    """(entity_id, name, value, n_alternatives, urls): the value of the highest confidence, the earliest on a tie; other values are alternatives; urls of the value united."""
    by_value = fields.groupBy("entity_id", "name", "value").agg(F.max(F.struct(F.coalesce("confidence", F.lit(0.0)).alias("c"), (-F.col("pos")).alias("p"))).alias("o"), F.array_sort(F.collect_set("url")).alias("urls"))
    return by_value.groupBy("entity_id", "name").agg(F.max_by(F.struct("value", "urls"), "o").alias("b"), (F.count("*") - 1).alias("n_alternatives")).select("entity_id", "name", F.col("b.value").alias("value"), "n_alternatives", F.col("b.urls").alias("urls"))


def merged_extractions(fields: DataFrame) -> DataFrame:
    """(entity_id, name, value, n_urls): explicit before inferred, then the most urls, then the earliest, then the smallest value; urls of one value united."""
    by_value = fields.groupBy("entity_id", "name", "value").agg(F.max((F.col("basis") == "explicit").cast("int")).alias("e"), F.countDistinct("url").alias("n_urls"), F.min("pos").alias("pos"))
    return by_value.groupBy("entity_id", "name").agg(F.min_by(F.struct("value", "n_urls"), F.struct(-F.col("e"), -F.col("n_urls"), "pos", "value")).alias("b")).select("entity_id", "name", F.col("b.value").alias("value"), F.col("b.n_urls").alias("n_urls"))
