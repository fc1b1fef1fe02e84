"""Queries of integrity rules and authority, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from corrgraph.operators import authority, validate
from corrgraph.operators.graph import relation_cycles
from corrgraph.sources import lens


def rule(check, broken=True):
    return lambda spark, d: check(lens.graph(spark, d, broken)).groupBy("severity", "code", "subject_id").agg(F.count("*").alias("n"))


FACTS = ["price", "stock", "quality", "*"]


def authority_resolve(spark, d):
    asked = lens.table(spark, d, "nation").select(lens.urn("nation", "n_nationkey").alias("concept"), F.explode(F.array(*map(F.lit, FACTS))).alias("fact"))
    out = authority.resolve(lens.graph(spark, d), asked)
    return out.select("concept", "fact", "status", "canonical", "effective", F.array_join("chain", ">").alias("chain"))


def relation_cycle_members(spark, d):
    return relation_cycles(lens.graph(spark, d, True))


def delegation_cycle_members(spark, d):
    return validate.delegation_cycle_members(lens.graph(spark, d, True))


QUERIES = {
    "validate_duplicate_id": rule(validate.duplicate_ids),
    "validate_duplicate_endpoint": rule(validate.duplicate_endpoints),
    "validate_unknown_relation": rule(validate.unknown_relations),
    "validate_unsupported_cardinality": rule(validate.unsupported_cardinalities),
    "validate_cardinality_mismatch": rule(validate.cardinality_mismatches),
    "validate_unresolved_endpoint": rule(validate.unresolved_endpoints),
    "validate_endpoint_kind": rule(validate.endpoint_kinds),
    "validate_candidate": rule(validate.candidate_authorities),
    "validate_authority_conflict": rule(validate.authority_conflicts),
    "validate_delegation_parent": rule(validate.delegation_parents),
    "validate_fact_widening": rule(validate.fact_widening),
    "validate_branch_conflict": rule(validate.branch_conflicts),
    "validate_delegation_cycle": delegation_cycle_members,
    "validate_relation_cycle": relation_cycle_members,
    "authority_resolve": authority_resolve,
}


def _found(code: str, rows: str, severity: str = "error") -> str:
    """rows: one row (subject_id) for each issue."""
    return lens.lens_sql(f"SELECT '{severity}' AS severity, '{code}' AS code, subject_id, count(*) AS n FROM ({rows}) GROUP BY subject_id", True)


_FACT_PAIRS = """SELECT DISTINCT a.concept, a.id AS a, b.id AS b FROM authorities a JOIN authorities b ON a.concept = b.concept AND a.ord < b.ord
WHERE a.mode = '{mode}' AND b.mode = '{mode}' AND (list_contains(a.facts, '*') OR list_contains(b.facts, '*') OR list_has_any(a.facts, b.facts))"""
_UP = "up(id, anc) AS (SELECT id, delegated_from FROM authorities WHERE delegated_from IS NOT NULL UNION SELECT up.id, a.delegated_from FROM up JOIN authorities a ON a.id = up.anc WHERE a.delegated_from IS NOT NULL)"
_RAW = "SELECT 'urn:map:' || name || ':' || key AS mapping_id, name, key, src, dst FROM linked"

ORACLE = {
    "validate_duplicate_id": _found("DUPLICATE_ID", "SELECT id AS subject_id, unnest(generate_series(2, count(*))) FROM (SELECT id FROM entities UNION ALL SELECT id FROM mappings UNION ALL SELECT id FROM authorities) GROUP BY id HAVING count(*) > 1"),
    "validate_duplicate_endpoint": _found("DUPLICATE_ENDPOINT", f"SELECT DISTINCT mapping_id AS subject_id FROM (SELECT mapping_id, dst FROM ({_RAW}) GROUP BY ALL HAVING count(*) > 1)"),
    "validate_unknown_relation": _found("UNKNOWN_RELATION", "SELECT id AS subject_id FROM mappings WHERE relation NOT IN (SELECT relation FROM relations)"),
    "validate_unsupported_cardinality": _found("UNSUPPORTED_CARDINALITY", "SELECT id AS subject_id FROM mappings JOIN relations USING (relation) WHERE NOT list_contains(cards, cardinality)"),
    "validate_cardinality_mismatch": _found("CARDINALITY_MISMATCH", "SELECT id AS subject_id FROM mappings WHERE relation IN (SELECT relation FROM relations) AND ((cardinality = 'one-to-one' AND n <> 1) OR (cardinality = 'many-to-one' AND n <> 1))"),
    "validate_unresolved_endpoint": _found("UNRESOLVED_ENDPOINT", f"SELECT mapping_id AS subject_id FROM ({_RAW}) WHERE dst NOT IN (SELECT id FROM entities)"),
    "validate_endpoint_kind": _found("INVALID_ENDPOINT_KIND", "SELECT mapping_id AS subject_id FROM endpoints e JOIN mappings m ON m.id = e.mapping_id WHERE m.relation = 'routing:emits'"),
    "validate_candidate": _found("UNRESOLVED_AUTHORITY", "SELECT id AS subject_id FROM authorities WHERE mode = 'candidate'", "warning"),
    "validate_authority_conflict": _found("AUTHORITY_CONFLICT", "SELECT concept AS subject_id FROM (" + _FACT_PAIRS.format(mode="canonical") + ")"),
    "validate_delegation_parent": lens.lens_sql("""SELECT 'error' AS severity, code, id AS subject_id, count(*) AS n FROM (
SELECT 'UNRESOLVED_DELEGATION_PARENT' AS code, id FROM authorities WHERE mode = 'delegated' AND delegated_from NOT IN (SELECT id FROM authorities)
UNION ALL SELECT 'INVALID_DELEGATION_PARENT', c.id FROM authorities c JOIN authorities p ON p.id = c.delegated_from WHERE p.mode = 'candidate'
UNION ALL SELECT 'DELEGATION_CONCEPT_MISMATCH', c.id FROM authorities c JOIN authorities p ON p.id = c.delegated_from WHERE p.concept <> c.concept) GROUP BY ALL""", True),
    "validate_fact_widening": _found("DELEGATION_FACT_WIDENING", "SELECT c.id AS subject_id FROM authorities c JOIN authorities p ON p.id = c.delegated_from WHERE NOT list_contains(p.facts, '*') AND NOT list_has_all(p.facts, c.facts)"),
    "validate_branch_conflict": lens.lens_sql(f""", {_UP} SELECT 'error' AS severity, 'DELEGATION_BRANCH_CONFLICT' AS code, concept AS subject_id, count(*) AS n FROM ({_FACT_PAIRS.format(mode="delegated")}) p
WHERE NOT EXISTS (SELECT 1 FROM up WHERE up.id = p.a AND up.anc = p.b) AND NOT EXISTS (SELECT 1 FROM up WHERE up.id = p.b AND up.anc = p.a) GROUP BY concept""", True),
    "validate_delegation_cycle": lens.lens_sql(f", {_UP} SELECT DISTINCT id FROM up WHERE id = anc", True),
    "validate_relation_cycle": lens.lens_sql(""", contained AS (SELECT src, dst FROM edges WHERE relation = 'core:contains'),
walk(a, b) AS (SELECT src, dst FROM contained UNION SELECT a, dst FROM walk JOIN contained ON src = b)
SELECT DISTINCT 'core:contains' AS relation, a AS id FROM walk WHERE a = b""", True),
    "authority_resolve": lens.lens_sql(""", asked AS (SELECT 'urn:tpch:nation:' || n_nationkey AS concept, f AS fact FROM nation, (SELECT unnest(['price', 'stock', 'quality', '*']) AS f)),
app AS (SELECT q.concept, q.fact, a.id, a.mode FROM asked q JOIN authorities a ON a.concept = q.concept AND (list_contains(a.facts, '*') OR list_contains(a.facts, q.fact))),
cnt AS (SELECT q.concept, q.fact, count(*) FILTER (mode = 'canonical') AS c, count(id) AS n, min(id) FILTER (mode = 'canonical') AS can FROM asked q LEFT JOIN app USING (concept, fact) GROUP BY ALL),
kids AS (SELECT q.fact, a.delegated_from AS parent, count(*) AS k, min(a.id) AS child FROM (SELECT DISTINCT fact FROM asked) q JOIN authorities a ON a.delegated_from IS NOT NULL AND (list_contains(a.facts, '*') OR list_contains(a.facts, q.fact)) GROUP BY ALL),
walk(concept, fact, can, cur, chain, lost) AS (
  SELECT concept, fact, can, can, [can], false FROM cnt WHERE c = 1
  UNION SELECT w.concept, w.fact, w.can, k.child, list_append(w.chain, k.child), k.k > 1 OR list_contains(w.chain, k.child) FROM walk w JOIN kids k ON k.parent = w.cur AND k.fact = w.fact WHERE NOT w.lost),
last AS (SELECT *, row_number() OVER (PARTITION BY concept, fact ORDER BY len(chain) DESC) AS r FROM walk)
SELECT c.concept, c.fact, CASE WHEN n = 0 THEN 'unresolved' WHEN c <> 1 OR lost THEN 'ambiguous' ELSE 'resolved' END AS status,
  CASE WHEN c = 1 AND NOT lost THEN l.can END AS canonical, CASE WHEN c = 1 AND NOT lost THEN l.cur END AS effective, CASE WHEN c = 1 AND NOT lost THEN array_to_string(l.chain, '>') ELSE '' END AS chain
FROM cnt c LEFT JOIN last l ON l.concept = c.concept AND l.fact = c.fact AND l.r = 1"""),
}
