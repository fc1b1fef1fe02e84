"""Correspondence of structures that different sources describe: drift of fields and enumerations, coverage.

A catalogue holds structures (source_id, kind, name, structure) and their fields or values
(structure, name, data_type, presence, nullable, cardinality, relation, ord). Pairs and allowances are
small tables of the configuration.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corrgraph.functions.identifiers import types_compatible
from corrgraph.operators.issues import issues, say, union

FACTS = ("type", "presence", "nullability", "cardinality")


def resolve_structures(structures: DataFrame, references: DataFrame) -> tuple[DataFrame, DataFrame]:
    """references: (correspondence, side, source_id, kind, name). Those that name exactly one structure, and the issues."""
    found = references.join(structures, ["source_id", "kind", "name"], "left")
    counted = found.groupBy("correspondence", "side", "source_id", "kind", "name").agg(F.count("structure").alias("n"), F.min("structure").alias("structure"))
    code = F.concat(F.when(F.col("n") == 0, "MISSING").otherwise("AMBIGUOUS"), F.lit("_CORRESPONDENCE_"), F.upper("side"))
    return counted.filter("n = 1").drop("n"), issues(counted.filter("n <> 1"), code, F.col("correspondence"), say(F.col("kind"), " ", F.col("name"), " of ", F.col("source_id"), " names ", F.col("n"), " structures"))


def last_by_name(children: DataFrame) -> DataFrame:
    """Of children of a structure that share a name the last one counts."""
    columns = children.columns
    last = children.groupBy("structure", "name").agg(F.max_by(F.struct(*columns), "ord").alias("x"))
    return last.select(*[F.col(f"x.{c}").alias(c) for c in columns])


def field_drift(pairs: DataFrame, children: DataFrame) -> DataFrame:
    """(severity, code, correspondence, source, target, fact) of the facts in which paired fields differ.

    pairs: (correspondence, source_structure, target_structure, source, target, compare, allowed). A pair
    with a missing end is one issue and is compared no further.
    """
    fields = last_by_name(children)
    half = lambda s: fields.select(F.col("structure").alias(f"{s}_structure"), F.col("name").alias(s), *[F.col(c).alias(f"{s}_{c}") for c in ("data_type", "presence", "nullable", "cardinality")], F.lit(True).alias(f"{s}_there"))
    both = pairs.join(half("source"), ["source_structure", "source"], "left").join(half("target"), ["target_structure", "target"], "left")
    whole = F.col("source_there").isNotNull() & F.col("target_there").isNotNull()
    missing = both.filter(~whole).select(F.lit("error").alias("severity"), F.lit("MISSING_MAPPED_FIELD").alias("code"), "correspondence", "source", "target", F.lit(None).cast("string").alias("fact"))
    same = {"type": types_compatible(F.col("source_data_type"), F.col("target_data_type"))}
    same |= {fact: F.col(f"source_{c}").eqNullSafe(F.col(f"target_{c}")) for fact, c in (("presence", "presence"), ("nullability", "nullable"), ("cardinality", "cardinality"))}
    differ = F.array_compact(F.array(*[F.when(F.array_contains("compare", f) & ~same[f], F.lit(f)) for f in FACTS]))
    facts = both.filter(whole).select("correspondence", "source", "target", "allowed", F.explode(differ).alias("fact"))
    waived = F.array_contains("allowed", F.col("fact"))
    drift = facts.select(F.when(waived, "info").otherwise("error").alias("severity"), F.when(waived, "WAIVED_FIELD_DIFFERENCE").otherwise("FIELD_DRIFT").alias("code"), "correspondence", "source", "target", "fact")
    return missing.unionByName(drift)


def enum_drift(source: DataFrame, target: DataFrame, allowed: DataFrame) -> DataFrame:
    """(severity, code, name, side): values (name) that one side alone has; allowed: (name, side)."""
    both = source.select("name").distinct().withColumn("s", F.lit(True)).join(target.select("name").distinct().withColumn("t", F.lit(True)), "name", "full_outer")
    alone = both.filter("s IS NULL OR t IS NULL").select("name", F.when(F.col("t").isNull(), "source").otherwise("target").alias("side"))
    told = alone.join(allowed.withColumn("ok", F.lit(True)), ["name", "side"], "left")
    waived = F.coalesce("ok", F.lit(False))
    return told.select(F.when(waived, "info").otherwise("error").alias("severity"), F.when(waived, "WAIVED_ENUM_DIFFERENCE").otherwise("ENUM_VALUE_DRIFT").alias("code"), "name", "side")


def coverage(children: DataFrame, sides: DataFrame, mapped: DataFrame, ignored: DataFrame) -> DataFrame:
    """(severity, code, correspondence, side, name): fields that nothing maps or ignores, and ignores without a field.

    sides: (correspondence, side, structure, required); mapped and ignored: (correspondence, side, name).
    """
    names = sides.join(children.filter("relation IS NULL OR NOT relation"), "structure").select("correspondence", "side", "name", "required").distinct()
    keys = ["correspondence", "side", "name"]
    bare = names.filter("required").join(mapped, keys, "left_anti").join(ignored, keys, "left_anti")
    stale = ignored.join(names, keys, "left_anti")
    row = lambda df, severity, code: df.select(F.lit(severity).alias("severity"), F.lit(code).alias("code"), *keys)
    return row(bare, "error", "UNMAPPED_FIELD").unionByName(row(stale.distinct(), "warning", "STALE_COVERAGE_IGNORE"))


def unconfigured(structures: DataFrame, configured: DataFrame, most: int = 12) -> DataFrame:
    """(source_id, n, names): structures that no correspondence names, the first of them listed by name.

    Names are picked by a windowed rank within the source, so no list grows beyond `most`.
    """
    from pyspark.sql import Window

    bare = structures.join(configured, ["source_id", "kind", "name"], "left_anti")
    total = bare.groupBy("source_id").agg(F.count("*").alias("n"))
    ranked = bare.withColumn("r", F.row_number().over(Window.partitionBy("source_id").orderBy("name"))).filter(F.col("r") <= most)
    listed = ranked.groupBy("source_id").agg(F.array_join(F.sort_array(F.collect_list("name")), ", ").alias("names"))
    return total.join(listed, "source_id").select("source_id", "n", F.when(F.col("n") > most, F.concat("names", F.lit(", …"))).otherwise(F.col("names")).alias("names"))


def overlay(resolved: DataFrame, namespace: str, relation: str = "core:derives_from") -> DataFrame:
    """(id, relation, source, target, lossiness) that a resolved pair of structures adds to the graph; concepts implement both."""
    wide = resolved.groupBy("correspondence").pivot("side", ["source", "target"]).agg(F.first("structure"))
    concept = F.concat(F.lit(f"urn:{namespace}:concept:"), F.col("correspondence"))
    name = lambda what: F.concat(F.lit(f"urn:{namespace}:mapping:"), F.col("correspondence"), F.lit(f":{what}"))
    row = lambda what, rel, a, b: wide.select(name(what).alias("id"), F.lit(rel).alias("relation"), a.alias("source"), b.alias("target"), F.lit("unknown").alias("lossiness"))
    return union([row("implements-source", "core:implements", concept, F.col("source")), row("implements-target", "core:implements", concept, F.col("target")), row("structure", relation, F.col("source"), F.col("target"))])
