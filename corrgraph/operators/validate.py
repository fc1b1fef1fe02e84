"""Integrity rules over a graph. Each returns the issues it finds; validate() is their union.

Rules are anti-joins, grouped counts and equi-joins with a residue; none looks at all pairs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corrgraph.operators.graph import Graph, cyclic_nodes, first_by, relation_cycles
from corrgraph.operators.issues import issues, say, union
from corrgraph.plans.scratch import is_empty, save


def duplicate_ids(g: Graph) -> DataFrame:
    """Ids are unique over entities, mappings and authorities together; each later occurrence is one issue."""
    ids = union([x.select("id") for x in (g.entities, g.mappings, g.authorities)])
    again = ids.groupBy("id").count().filter("count > 1").select("id", F.explode(F.sequence(F.lit(2), F.col("count").cast("int"))).alias("n"))
    return issues(again, "DUPLICATE_ID", F.col("id"), say("occurrence ", F.col("n"), " of ", F.col("id")))


def duplicate_locators(g: Graph) -> DataFrame:
    found = g.entities.filter(F.size("locators") > F.size(F.array_distinct("locators")))
    return issues(found, "DUPLICATE_LOCATOR", F.col("id"), say(F.col("id"), " repeats a locator"), "warning")


def duplicate_endpoints(g: Graph) -> DataFrame:
    found = g.endpoints.groupBy("mapping_id", "side", "entity_id").count().filter("count > 1").select("mapping_id", "side").distinct()
    return issues(found, "DUPLICATE_ENDPOINT", F.col("mapping_id"), say(F.col("mapping_id"), " repeats a ", F.col("side")))


def unknown_relations(g: Graph) -> DataFrame:
    found = g.mappings.join(g.relations().select("relation"), "relation", "left_anti")
    return issues(found, "UNKNOWN_RELATION", F.col("id"), say(F.col("relation"), " is not registered"))


def unsupported_cardinalities(g: Graph) -> DataFrame:
    found = g.mappings.join(g.relations().select("relation", "cardinalities"), "relation").filter(F.col("cardinalities").isNotNull() & ~F.array_contains("cardinalities", F.col("cardinality")))
    return issues(found, "UNSUPPORTED_CARDINALITY", F.col("id"), say(F.col("relation"), " does not allow ", F.col("cardinality")))


def cardinality_mismatches(g: Graph) -> DataFrame:
    sizes = g.endpoints.groupBy("mapping_id").agg(F.count_if(F.col("side") == "source").alias("s"), F.count_if(F.col("side") == "target").alias("t"))
    known = g.mappings.join(g.relations().select("relation"), "relation", "left_semi").join(sizes, F.col("id") == F.col("mapping_id"))
    fits = (
        F.when(F.col("cardinality") == "one-to-one", (F.col("s") == 1) & (F.col("t") == 1))
        .when(F.col("cardinality") == "one-to-many", F.col("s") == 1)
        .when(F.col("cardinality") == "many-to-one", F.col("t") == 1)
        .otherwise(F.lit(True))
    )
    return issues(known.filter(~fits), "CARDINALITY_MISMATCH", F.col("id"), say(F.col("cardinality"), " with ", F.col("s"), " sources and ", F.col("t"), " targets"))


def unresolved_endpoints(g: Graph) -> DataFrame:
    found = g.endpoints.join(g.entities.select(F.col("id").alias("entity_id")), "entity_id", "left_anti")
    return issues(found, "UNRESOLVED_ENDPOINT", F.col("mapping_id"), say(F.col("side"), " ", F.col("entity_id"), " is unknown"))


def endpoint_kinds(g: Graph) -> DataFrame:
    """Kinds against what the relation allows; of entities that share an id the last one counts."""
    kinds = g.entities.groupBy("id").agg(F.max_by("kind", "ord").alias("kind")).withColumnRenamed("id", "entity_id")
    rules = g.relations().select("relation", "source_kinds", "target_kinds").filter("source_kinds IS NOT NULL OR target_kinds IS NOT NULL")
    heads = g.mappings.select(F.col("id").alias("mapping_id"), "relation").join(rules, "relation")
    allowed = F.when(F.col("side") == "source", F.col("source_kinds")).otherwise(F.col("target_kinds"))
    found = g.endpoints.join(heads, "mapping_id").join(kinds, "entity_id").withColumn("allowed", allowed)
    found = found.filter(F.col("allowed").isNotNull() & ~F.array_contains("allowed", "*") & ~F.array_contains("allowed", F.col("kind")))
    return issues(found, "INVALID_ENDPOINT_KIND", F.col("mapping_id"), say(F.col("relation"), " does not allow ", F.col("kind"), " ", F.col("entity_id"), " as ", F.col("side")))


def unresolved_authorities(g: Graph) -> DataFrame:
    known = g.entities.select(F.col("id").alias("_known"))
    concept = g.authorities.join(known, F.col("concept") == F.col("_known"), "left_anti")
    source = g.authorities.join(known, F.col("source") == F.col("_known"), "left_anti")
    return issues(concept, "UNRESOLVED_CONCEPT", F.col("id"), say("concept ", F.col("concept"), " is unknown")).unionByName(issues(source, "UNRESOLVED_AUTHORITY_SOURCE", F.col("id"), say("source ", F.col("source"), " is unknown")))


def duplicate_facts(g: Graph) -> DataFrame:
    found = g.facts.groupBy("authority_id", "fact").count().filter("count > 1").select("authority_id").distinct()
    return issues(found, "DUPLICATE_FACT", F.col("authority_id"), say(F.col("authority_id"), " repeats a fact"))


def candidate_authorities(g: Graph) -> DataFrame:
    return issues(g.authorities.filter("mode = 'candidate'"), "UNRESOLVED_AUTHORITY", F.col("id"), say(F.col("id"), " is a candidate"), "warning")


def overlapping(g: Graph, mode: str) -> DataFrame:
    """(concept, a, b): pairs of authorities of one mode and concept whose facts overlap, a before b."""
    named = g.authorities.filter(F.col("mode") == mode).select("id", "concept", "ord").join(g.facts, F.col("id") == F.col("authority_id"))
    left = named.select("concept", F.col("id").alias("a"), F.col("ord").alias("ao"), F.col("fact").alias("fa"))
    right = named.select("concept", F.col("id").alias("b"), F.col("ord").alias("bo"), F.col("fact").alias("fb"))
    same = left.join(right, (left.concept == right.concept) & (left.fa == right.fb) & (left.ao < right.bo)).select(left.concept, "a", "b")
    wild = left.join(right, (left.concept == right.concept) & ((left.fa == "*") | (right.fb == "*")) & (left.ao < right.bo)).select(left.concept, "a", "b")
    return same.unionByName(wild).distinct()


def authority_conflicts(g: Graph) -> DataFrame:
    return issues(overlapping(g, "canonical"), "AUTHORITY_CONFLICT", F.col("concept"), say(F.col("a"), " and ", F.col("b"), " are both canonical"))


def delegations(g: Graph) -> DataFrame:
    """(id, concept, parent, parent_concept, parent_mode) of delegated authorities; parent_mode is null without a parent."""
    child = g.authorities.filter("mode = 'delegated'").select("id", "concept", F.col("delegated_from").alias("parent"))
    parents = first_by(g.authorities, "id", F.col("ord").desc()).select(F.col("id").alias("parent"), F.col("concept").alias("parent_concept"), F.col("mode").alias("parent_mode"))
    return child.join(parents, "parent", "left")


def delegation_parents(g: Graph) -> DataFrame:
    d = delegations(g)
    return union([
        issues(d.filter("parent_mode IS NULL"), "UNRESOLVED_DELEGATION_PARENT", F.col("id"), say("parent ", F.col("parent"), " is unknown")),
        issues(d.filter("parent_mode = 'candidate'"), "INVALID_DELEGATION_PARENT", F.col("id"), say("parent ", F.col("parent"), " is a candidate")),
        issues(d.filter("parent_concept <> concept"), "DELEGATION_CONCEPT_MISMATCH", F.col("id"), say("parent ", F.col("parent"), " is for ", F.col("parent_concept"))),
    ])


def fact_widening(g: Graph) -> DataFrame:
    """Delegated facts that the parent does not hold; a wildcard covers all and is covered by itself alone."""
    d = delegations(g).filter("parent_mode IS NOT NULL").select("id", "parent")
    own = d.join(g.facts, F.col("id") == F.col("authority_id")).select("id", "parent", "fact")
    held = g.facts.select(F.col("authority_id").alias("parent"), F.col("fact").alias("held"))
    open_parents = held.filter("held = '*'").select("parent").distinct()
    wide = own.join(open_parents, "parent", "left_anti").join(held, (own.parent == held.parent) & (own.fact == held.held), "left_anti")
    return issues(wide.select("id").distinct(), "DELEGATION_FACT_WIDENING", F.col("id"), say(F.col("id"), " delegates facts that its parent lacks"))


def ancestry(g: Graph) -> DataFrame:
    """(id, ancestor), by doubling: each round joins what it has with itself, so rounds grow as the log of depth."""
    known = save(g.authorities.filter("delegated_from IS NOT NULL").select("id", F.col("delegated_from").alias("ancestor")).distinct(), "ancestry")
    while True:
        far = known.select(F.col("id").alias("m"), F.col("ancestor").alias("a"))
        new = known.join(far, F.col("ancestor") == F.col("m")).select("id", F.col("a").alias("ancestor")).distinct().join(known, ["id", "ancestor"], "left_anti")
        new = save(new, "ancestry")
        if is_empty(new):
            return known
        known = save(known.unionByName(new), "ancestry")


def branch_conflicts(g: Graph) -> DataFrame:
    pairs, up = overlapping(g, "delegated"), ancestry(g)
    first, second = up.select(F.col("id").alias("a"), F.col("ancestor").alias("b")), up.select(F.col("ancestor").alias("a"), F.col("id").alias("b"))
    found = pairs.join(first, ["a", "b"], "left_anti").join(second, ["a", "b"], "left_anti")
    return issues(found, "DELEGATION_BRANCH_CONFLICT", F.col("concept"), say(F.col("a"), " and ", F.col("b"), " delegate the same facts"))


def delegation_cycle_members(g: Graph) -> DataFrame:
    steps = g.authorities.filter("delegated_from IS NOT NULL").select(F.lit("delegation").alias("group"), F.col("id").alias("at"), F.col("delegated_from").alias("next"))
    return cyclic_nodes(steps, "group").select("id")


def delegation_cycles(g: Graph) -> DataFrame:
    """One issue if there is any cycle, as members are reported by delegation_cycle_members()."""
    found = delegation_cycle_members(g).agg(F.min("id").alias("id")).filter("id IS NOT NULL")
    return issues(found, "DELEGATION_CYCLE", F.col("id"), say("delegation runs in a circle through ", F.col("id")))


def forbidden_cycles(g: Graph) -> DataFrame:
    found = relation_cycles(g).groupBy("relation").agg(F.min("id").alias("id"))
    return issues(found, "FORBIDDEN_RELATION_CYCLE", F.col("relation"), say(F.col("relation"), " runs in a circle through ", F.col("id")))


RULES = [
    duplicate_ids, duplicate_locators, duplicate_endpoints, unknown_relations, unsupported_cardinalities, cardinality_mismatches, unresolved_endpoints, endpoint_kinds,
    unresolved_authorities, duplicate_facts, candidate_authorities, authority_conflicts, delegation_parents, fact_widening, branch_conflicts, delegation_cycles, forbidden_cycles,
]


def validate(g: Graph) -> DataFrame:
    """Every rule's issues; a graph is valid if none has severity error."""
    return union([rule(g) for rule in RULES])


def is_valid(found: DataFrame) -> bool:
    return is_empty(found.filter("severity = 'error'"))
