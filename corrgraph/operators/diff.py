"""What changed between two graphs: one full outer join for each kind of record."""

from __future__ import annotations


from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corrgraph.operators.graph import Graph, more_of, row_set
from corrgraph.operators.issues import union


def fields(g: Graph, kind: str) -> DataFrame:
    """id, the record's top-level properties as text, null where absent, and `more`, its other members by name."""
    if kind == "entity":
        return g.entities.select("id", "kind", "label", "attributes", F.to_json("locators").alias("locators"), more_of(g.entities).alias("more"))
    if kind == "mapping":
        side = lambda s: row_set("pos", "entity_id", where=F.col("side") == s)
        ends = g.endpoints.groupBy(F.col("mapping_id").alias("id")).agg(side("source").alias("sources"), side("target").alias("targets"))
        return g.mappings.select("id", "relation", "cardinality", "lossiness", "transform", "attributes", more_of(g.mappings).alias("more")).join(ends, "id", "left")
    held = g.facts.groupBy(F.col("authority_id").alias("id")).agg(row_set("fact").alias("facts"))
    return g.authorities.select("id", "concept", "source", "mode", F.col("delegated_from").alias("delegatedFrom"), more_of(g.authorities).alias("more")).join(held, "id", "left")


def records(before: DataFrame, after: DataFrame, kind: str) -> DataFrame:
    """(kind, id, change, changed_properties) of one kind; properties in code-unit order."""
    names = sorted(c for c in before.columns if c not in ("id", "more"))
    old = before.select(F.col("id").alias("_old"), *[F.col(c).alias(f"_o_{c}") for c in [*names, "more"]])
    both = old.join(after, F.col("_old") == F.col("id"), "full_outer")
    differ = F.array_compact(F.array(*[F.when(~F.col(f"_o_{c}").eqNullSafe(F.col(c)), F.lit(c)) for c in names]))
    members = F.array_union(F.map_keys("_o_more"), F.map_keys("more"))
    others = F.filter(members, lambda k: ~F.col("_o_more")[k].eqNullSafe(F.col("more")[k]))
    differ = F.array_sort(F.array_union(differ, F.coalesce(others, F.array().cast("array<string>"))))
    change = F.when(F.col("id").isNull(), "removed").when(F.col("_old").isNull(), "added").when(F.size(differ) > 0, "changed")
    props = F.when(change == "changed", differ).otherwise(F.array().cast("array<string>"))
    return both.select(F.lit(kind).alias("kind"), F.coalesce("id", "_old").alias("id"), change.alias("change"), props.alias("changed_properties")).filter("change IS NOT NULL")


def empty(spark) -> DataFrame:
    """The diff of two equal graphs."""
    return spark.createDataFrame([], "kind string, id string, change string, changed_properties array<string>")


def diff(before: Graph, after: Graph) -> DataFrame:
    return union([records(fields(before, k), fields(after, k), k) for k in ("entity", "mapping", "authority")])


def counts(changes: DataFrame) -> DataFrame:
    """(change, n) with every change listed."""
    every = changes.sparkSession.createDataFrame([("added",), ("changed",), ("removed",)], "change string")
    return every.join(changes.groupBy("change").agg(F.count("*").alias("n")), "change", "left").fillna(0, ["n"])


def by_kind(changes: DataFrame) -> DataFrame:
    """(kind, change, n) with subtotals, where null stands for all."""
    return changes.rollup("kind", "change").agg(F.count("*").alias("n"))


def baseline_issues(changes: DataFrame, severity: str = "error") -> DataFrame:
    """One BASELINE_DRIFT issue for each change; severity `ignore` gives none."""
    from corrgraph.operators.issues import issues, say

    found = issues(changes, "BASELINE_DRIFT", F.col("id"), say(F.col("kind"), " ", F.col("id"), " was ", F.col("change")), severity)
    return found.filter(F.lit(severity != "ignore"))


