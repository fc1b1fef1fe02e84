"""Which authority holds for a fact of a concept."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corrgraph.operators.graph import Graph
from corrgraph.plans.scratch import is_empty, save


def resolve(g: Graph, asked: DataFrame) -> DataFrame:
    """(concept, fact, status, canonical, effective, chain) for each asked (concept, fact).

    Exactly one canonical declaration must apply. From it the one applicable child is followed, for all
    questions at once; more than one child, or a circle, is ambiguous. The wildcard applies to all facts.
    """
    asked = asked.select("concept", "fact").distinct()
    held = g.facts.select("authority_id", F.col("fact").alias("held"))
    rules = g.authorities.select("id", "concept", "mode")
    about = asked.join(rules, "concept").join(held, F.col("id") == F.col("authority_id")).filter((F.col("held") == "*") | (F.col("held") == F.col("fact")))
    about = about.select("concept", "fact", "id", "mode").distinct()
    counts = about.groupBy("concept", "fact").agg(F.count_if(F.col("mode") == "canonical").alias("c"), F.count("*").alias("n"), F.min(F.when(F.col("mode") == "canonical", F.col("id"))).alias("canonical"))
    state = save(asked.join(counts, ["concept", "fact"], "left"), "asked")
    none = F.lit(None).cast("string")
    empty = F.array().cast("array<string>")
    done = [
        state.filter("n IS NULL").select("concept", "fact", F.lit("unresolved").alias("status"), none.alias("canonical"), none.alias("effective"), empty.alias("chain")),
        state.filter("n IS NOT NULL AND c <> 1").select("concept", "fact", F.lit("ambiguous").alias("status"), none.alias("canonical"), none.alias("effective"), empty.alias("chain")),
    ]
    children = g.authorities.filter("delegated_from IS NOT NULL").select(F.col("delegated_from").alias("current"), F.col("id").alias("child"))
    children = children.join(held, F.col("child") == F.col("authority_id")).select("current", "child", "held")
    now = state.filter("c = 1").select("concept", "fact", "canonical", F.col("canonical").alias("current"), F.array("canonical").alias("chain"))
    while True:
        found = now.join(children, "current", "left").withColumn("child", F.when((F.col("held") == "*") | (F.col("held") == F.col("fact")), F.col("child")))
        step = found.groupBy("concept", "fact", "canonical", "current", "chain").agg(F.collect_set("child").alias("next"))
        step = save(step, "walk")
        circle = F.array_contains("chain", F.get("next", F.lit(0)))
        done.append(step.filter(F.size("next") == 0).select("concept", "fact", F.lit("resolved").alias("status"), "canonical", F.col("current").alias("effective"), "chain"))
        lost = (F.size("next") > 1) | (F.coalesce(circle, F.lit(False)))
        done.append(step.filter((F.size("next") > 0) & lost).select("concept", "fact", F.lit("ambiguous").alias("status"), none.alias("canonical"), none.alias("effective"), empty.alias("chain")))
        now = step.filter((F.size("next") == 1) & ~lost).select("concept", "fact", "canonical", F.get("next", F.lit(0)).alias("current"), F.concat("chain", "next").alias("chain"))
        if is_empty(now):
            break
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out
