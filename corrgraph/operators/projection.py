"""Projections: what each subject's slots resolve to, with the rules that reject them.

A slot is {name, relation, direction, cardinality, targetKinds?, allowLossy?}; slots are few, subjects
many, so slots are broadcast and subjects and edges joined once for all slots.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corrgraph.functions.shapes import findings
from corrgraph.operators.graph import Graph, edges
from corrgraph.operators.issues import union

#: Slot cardinality to whether none and whether more than one is an issue.
COUNTS = {"exactly-one": (True, True), "zero-or-one": (False, True), "one-or-more": (True, False), "many": (False, False)}


def spec_issues(spec) -> list[tuple[str, str]]:
    """(code, what) of a malformed specification: its form, or else slot names that it uses twice."""
    wrong = findings(spec, "projection-spec")
    if wrong:
        return wrong
    names = Counter(s["name"] for s in spec["slots"])
    return [("DUPLICATE_PROJECTION_SLOT", name) for name, n in names.items() for _ in range(n - 1)]


def slot_frame(spark, slots: list[dict]) -> DataFrame:
    """As many rows as the specification has slots."""
    rows = [(s["name"], s["relation"], s["direction"], s["cardinality"], s.get("targetKinds"), bool(s.get("allowLossy"))) for s in slots]
    return F.broadcast(spark.createDataFrame(rows, "slot string, relation string, direction string, cardinality string, target_kinds array<string>, allow_lossy boolean"))


def subjects(g: Graph, select: dict) -> DataFrame:
    """(id, kind) of the selected entities: ids and kinds, where both are given both must hold."""
    out = g.entities
    if select.get("ids"):
        out = out.filter(F.col("id").isin(select["ids"]))
    if select.get("kinds"):
        out = out.filter(F.col("kind").isin(select["kinds"]))
    return out.select("id", "kind").distinct()


def links(g: Graph, active: DataFrame, spec: dict) -> DataFrame:
    """(subject, slot, mapping_id, lossiness, target, kind, fits) of every link a slot looks at."""
    slots = slot_frame(g.spark, spec["slots"])
    live = g.only(active)
    heads = live.mappings.select(F.col("id").alias("mapping_id"), "lossiness")
    found = edges(live, sorted({s["relation"] for s in spec["slots"]})).select("mapping_id", "relation", "src", "dst").join(slots, "relation").join(heads, "mapping_id")
    out = F.col("direction") == "outgoing"
    found = found.select("slot", "mapping_id", "lossiness", "allow_lossy", "target_kinds", F.when(out, F.col("src")).otherwise(F.col("dst")).alias("subject"), F.when(out, F.col("dst")).otherwise(F.col("src")).alias("target"))
    found = found.join(subjects(g, spec["select"]).select(F.col("id").alias("subject")), "subject", "left_semi")
    kinds = g.entities.groupBy("id").agg(F.max_by("kind", "ord").alias("kind")).withColumnRenamed("id", "target")
    fits = F.coalesce(F.col("target_kinds").isNull() | F.array_contains("target_kinds", F.col("kind")), F.lit(False))
    return found.join(kinds, "target").withColumn("fits", fits)


def slots(g: Graph, active: DataFrame, spec: dict, found: DataFrame | None = None) -> DataFrame:
    """(subject, slot, cardinality, n, targets, mappings): distinct fitting targets of every subject and slot, none included."""
    found = found if found is not None else links(g, active, spec)
    hit = found.filter("fits").groupBy("subject", "slot").agg(F.sort_array(F.collect_set("target")).alias("targets"), F.sort_array(F.collect_set("mapping_id")).alias("mappings"))
    listed = F.array(*[F.struct(F.lit(s["name"]).alias("slot"), F.lit(s["cardinality"]).alias("cardinality")) for s in spec["slots"]])
    every = subjects(g, spec["select"]).select(F.col("id").alias("subject"), F.explode(listed).alias("s")).select("subject", "s.slot", "s.cardinality")
    none = F.array().cast("array<string>")
    out = every.join(hit, ["subject", "slot"], "left")
    return out.select("subject", "slot", "cardinality", F.coalesce(F.size("targets"), F.lit(0)).alias("n"), F.coalesce("targets", none).alias("targets"), F.coalesce("mappings", none).alias("mappings")).withColumn("n", F.greatest("n", F.lit(0)))


def projection_issues(g: Graph, active: DataFrame, spec: dict) -> DataFrame:
    """(code, subject_id, slot, target): lossy links and wrong kinds one by one, then slots with too few or too many."""
    found = links(g, active, spec)
    none = F.lit(None).cast("string")
    lossy = found.filter("lossiness = 'lossy' AND NOT allow_lossy").select("subject", "slot", "mapping_id").distinct().select(F.lit("LOSSY_PROJECTION_LINK").alias("code"), F.col("subject").alias("subject_id"), "slot", F.col("mapping_id").alias("target"))
    kinds = found.filter("NOT fits").select("subject", "slot", "mapping_id", "target").select(F.lit("PROJECTION_TARGET_KIND_MISMATCH").alias("code"), F.col("subject").alias("subject_id"), "slot", "target")
    filled = slots(g, active, spec, found)
    short = [c for c, (few, _) in COUNTS.items() if few]
    single = [c for c, (_, many) in COUNTS.items() if many]
    few = filled.filter((F.col("n") == 0) & F.col("cardinality").isin(short)).select(F.lit("REQUIRED_PROJECTION_TARGET_MISSING").alias("code"), F.col("subject").alias("subject_id"), "slot", none.alias("target"))
    many = filled.filter((F.col("n") > 1) & F.col("cardinality").isin(single)).select(F.lit("AMBIGUOUS_PROJECTION_TARGET").alias("code"), F.col("subject").alias("subject_id"), "slot", none.alias("target"))
    return union([lossy, kinds, few, many])


def selection_issues(g: Graph, select: dict) -> DataFrame:
    """Named subjects that are not entities; (code, subject_id)."""
    named = g.spark.createDataFrame([(i,) for i in select.get("ids", [])], "id string")
    return named.join(g.entities.select("id"), "id", "left_anti").select(F.lit("UNKNOWN_PROJECTION_SUBJECT").alias("code"), F.col("id").alias("subject_id"))


def pivot(filled: DataFrame, spec: dict) -> DataFrame:
    """One row per subject and a column for each slot: the one target or null for single slots, else all, comma-joined."""
    single = F.col("cardinality").isin("exactly-one", "zero-or-one")
    value = F.when(single, F.get("targets", F.lit(0))).otherwise(F.array_join("targets", ","))
    return filled.withColumn("value", value).groupBy("subject").pivot("slot", [s["name"] for s in spec["slots"]]).agg(F.first("value"))
