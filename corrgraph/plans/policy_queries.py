"""Queries of activation, policy checks, constraints and waivers, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from corrgraph.operators import policy
from corrgraph.operators.constraints import ConstraintRegistry, Scope
from corrgraph.sources import lens

DECLARATIONS = [
    {"select": {"relations": ["core:contains"], "targetKinds": ["tpch:nation", "tpch:customer"]}},
    {"select": {"relations": ["core:depends_on"]}, "applicability": {"when": {"key": "environment", "operator": "equals", "value": "production"}}, "determinism": "deterministic", "reversibility": "reversible"},
    {"select": {"relations": ["core:references"], "targetKinds": ["tpch:part"]}, "applicability": {"unless": {"key": "maintenance", "operator": "equals", "value": True}}},
    {"select": {"relations": ["core:references"], "targetKinds": ["tpch:supplier"]}, "applicability": {"when": {"key": "regions", "operator": "in", "values": ["asia"]}}},
    {"select": {"ids": ["urn:map:order-customer:1", "urn:map:order-customer:2", "urn:map:order-customer:0"]}},
    {"mapping": "urn:map:order-parts:3"},
    {"select": {"sourceKinds": ["tpch:region"], "relations": ["core:mirrors"]}},
]
CONTEXT = {"environment": "production", "maintenance": True, "regions": ["europe", "asia"]}
NOW = "2026-01-01T00:00:00Z"


def _resolved(spark, d):
    graph = lens.graph(spark, d)
    return graph, policy.resolve_declarations(graph, DECLARATIONS)


def activation_state(spark, d):
    return policy.activation(_resolved(spark, d)[1], DECLARATIONS, CONTEXT)


def policy_missing(spark, d):
    return policy.declaration_issues(_resolved(spark, d)[1]).filter("code = 'MAPPING_POLICY_MISSING'").select("code", "subject_id")


def policy_duplicate(spark, d):
    return policy.declaration_issues(_resolved(spark, d)[1]).filter("code = 'DUPLICATE_MAPPING_POLICY'").select("code", "subject_id")


def selector_counts(spark, d):
    return policy.selector_counts(_resolved(spark, d)[1], DECLARATIONS)


def selector_issues(spark, d):
    graph, resolved = _resolved(spark, d)
    return policy.selector_issues(graph, resolved, DECLARATIONS).select("code", "subject_id")


def context_missing(spark, d):
    return policy.context_issues(_resolved(spark, d)[1], DECLARATIONS, {"environment": "test"}).select("code", "subject_id")


def policy_semantics(spark, d):
    graph, resolved = _resolved(spark, d)
    return policy.semantic_issues(graph, resolved, DECLARATIONS).groupBy("code", "subject_id").agg(F.count("*").alias("n"))


def _scope(spark, d):
    """Active: all mappings but those of unknown lossiness."""
    graph = lens.graph(spark, d)
    return Scope(graph, graph.mappings.filter("lossiness <> 'unknown'").select("id"), lens.evidence(spark, d))


def _subjects(spark, d, kind):
    return lens.entities(spark, d).filter(F.col("kind") == f"tpch:{kind}").select("id")


def constraint(kind, parameters, subjects):
    def query(spark, d):
        rows = _subjects(spark, d, subjects) if subjects else None
        found = ConstraintRegistry().evaluate({"id": "urn:constraint:1", "kind": kind, "parameters": parameters}, _scope(spark, d), rows)
        return found.select("code", "subject_id")

    return query


def contradictions(spark, d):
    scope = _scope(spark, d)
    return policy.contradictions(scope.graph, scope.evidence, scope.active).groupBy("code", "subject_id").agg(F.count("*").alias("n"))


EVIDENCE = {"kinds": ["purchase"], "minimumConfidence": 0.5}


def _waived(spark, d):
    found = ConstraintRegistry().evaluate({"id": "urn:constraint:1", "kind": "core:requires-evidence", "parameters": EVIDENCE}, _scope(spark, d), _subjects(spark, d, "customer"))
    key = lens.table(spark, d, "customer").select("c_custkey", lens.urn("customer", "c_custkey").alias("subject_id"))
    waivers = spark.createDataFrame([("w1", 1, "2027-01-01T00:00:00Z"), ("w2", 2, "2027-06-01T00:00:00+02:00"), ("w3", 3, "2027-01-01T00:00:00Z"), ("w4", 4, "2025-01-01T00:00:00Z"), ("w5", 5, "2027-01-01")], "waiver string, ord int, expires_at string")
    steps = F.broadcast(spark.createDataFrame([("w1", 10), ("w2", 5), ("w3", 10), ("w4", 1), ("w5", 1)], "waiver string, step int"))
    subjects = key.join(steps, F.col("c_custkey") % F.col("step") == 0).select("waiver", F.lit("REQUIRED_EVIDENCE_MISSING").alias("code"), "subject_id")
    return policy.apply_waivers(found, waivers, subjects, NOW)


def waivers_applied(spark, d):
    return _waived(spark, d)[0].select("severity", "code", "subject_id", "waived_by")


def stale_waivers(spark, d):
    return _waived(spark, d)[1].select("severity", "code", "subject_id")


def supporting(spark, d):
    scope = _scope(spark, d)
    return policy.supporting(scope.graph, scope.evidence, scope.active)


def unknown_subjects(spark, d):
    graph = lens.graph(spark, d, True)
    return policy.unknown_subjects(graph, "urn:doc", lens.evidence(spark, d).select(F.col("subject").alias("id")).distinct(), "UNKNOWN_POLICY_SUBJECT").select("code", "subject_id")


def topology_context(spark, d):
    """Customers need a market; nations and regions are scopes; every third nation provides it, one region twice."""
    from corrgraph.operators.graph import Graph

    graph = lens.graph(spark, d)
    customer, nation, region = (lens.table(spark, d, t) for t in ("customer", "nation", "region"))
    need, market = "topology:requires_context", F.lit("urn:context:market")
    link = lambda df, name, key, relation, source, target: df.select(F.concat(F.lit(f"urn:map:{name}:"), F.col(key).cast("string")).alias("id"), F.lit(relation).alias("relation"), source.alias("s"), target.alias("t"))
    rows = link(customer, "need", "c_custkey", need, lens.urn("customer", "c_custkey"), market)
    for part in (
        link(customer, "in", "c_custkey", "topology:rendered_in", lens.urn("customer", "c_custkey"), lens.urn("nation", "c_nationkey")),
        link(nation, "wraps", "n_nationkey", "topology:wraps", lens.urn("region", "n_regionkey"), lens.urn("nation", "n_nationkey")),
        link(nation.filter("n_nationkey % 3 = 0"), "gives", "n_nationkey", "topology:provides_context", lens.urn("nation", "n_nationkey"), market),
        link(region.filter("r_regionkey = 1"), "rgives", "r_regionkey", "topology:provides_context", lens.urn("region", "r_regionkey"), market),
        link(region.filter("r_regionkey <= 2"), "hosts", "r_regionkey", "topology:hosts_provider", lens.urn("region", "r_regionkey"), F.concat(F.lit("urn:provider:"), F.col("r_regionkey").cast("string"))),
        link(region.filter("r_regionkey <= 2"), "pgives", "r_regionkey", "topology:provides_context", F.concat(F.lit("urn:provider:"), F.col("r_regionkey").cast("string")), market),
    ):
        rows = rows.unionByName(part)
    heads = rows.select("id", "relation", F.lit("one-to-one").alias("cardinality"), F.lit("lossless").alias("lossiness"), F.lit(None).cast("string").alias("transform"), F.lit("declared").alias("status"), F.lit("{}").alias("attributes"), F.lit(0).cast("long").alias("ord"))
    end = lambda side, c: rows.select(F.col("id").alias("mapping_id"), F.lit(side).alias("side"), F.lit(0).cast("long").alias("pos"), F.col(c).alias("entity_id"))
    made = Graph(graph.entities, heads, end("source", "s").unionByName(end("target", "t")), graph.authorities, graph.facts, graph.registry)
    parameters = {"subjectKinds": ["tpch:customer"], "requiresRelation": need, "providesRelation": "topology:provides_context", "renderedInRelation": "topology:rendered_in", "parentRelation": "topology:wraps", "hostsProviderRelation": "topology:hosts_provider"}
    found = ConstraintRegistry().evaluate({"id": "urn:constraint:1", "kind": "topology:context-satisfied", "parameters": parameters}, Scope(made, heads.select("id"), lens.evidence(spark, d)))
    return found.select("code", "subject_id")


TOTAL = {"subjectKinds": ["tpch:order"], "relation": "core:references", "direction": "source", "cardinality": "exactly-one", "counterpartKinds": ["tpch:part"]}

QUERIES = {
    "activation_state": activation_state,
    "policy_missing": policy_missing,
    "policy_duplicate": policy_duplicate,
    "selector_counts": selector_counts,
    "selector_issues": selector_issues,
    "context_missing": context_missing,
    "policy_semantics": policy_semantics,
    "policy_unknown_subjects": unknown_subjects,
    "constraint_requires_evidence": constraint("core:requires-evidence", EVIDENCE, "customer"),
    "constraint_requires_mapping": constraint("core:requires-mapping", {"relation": "core:references"}, "order"),
    "constraint_forbids_mapping": constraint("core:forbids-mapping", {"relation": "core:depends_on", "direction": "target"}, "customer"),
    "constraint_unique_target": constraint("core:unique-target", {"relation": "core:references"}, "order"),
    "constraint_requires_authority": constraint("core:requires-authority", {"fact": "price"}, "nation"),
    "topology_totality": constraint("topology:relation-totality", TOTAL, None),
    "topology_reachable": constraint("topology:reachable", {"subjectKinds": ["tpch:customer"], "root": "urn:tpch:region:0", "relation": "core:contains"}, None),
    "topology_context": topology_context,
    "contradictions": contradictions,
    "supporting_evidence": supporting,
    "waivers_applied": waivers_applied,
    "stale_waivers": stale_waivers,
}

_DECLARED = """, declared AS (
SELECT m.id, list_filter([
  CASE WHEN relation = 'core:contains' AND name IN ('region-nations', 'nation-customers') THEN 0 END,
  CASE WHEN relation = 'core:depends_on' THEN 1 END, CASE WHEN name = 'order-parts' THEN 2 END, CASE WHEN name = 'order-suppliers' THEN 3 END,
  CASE WHEN m.id IN ('urn:map:order-customer:1', 'urn:map:order-customer:2', 'urn:map:order-customer:0') THEN 4 END,
  CASE WHEN m.id = 'urn:map:order-parts:3' THEN 5 END], lambda x: x IS NOT NULL) AS p FROM mappings m)
"""
_ACTIVE = ", active AS (SELECT * FROM mappings WHERE lossiness <> 'unknown'), live AS (SELECT * FROM edges WHERE mapping_id IN (SELECT id FROM active))"
_BARE = """, good AS (SELECT subject FROM evidence WHERE result = 'supports' AND kind = 'purchase' AND confidence >= 0.5),
bare AS (SELECT c_custkey, 'urn:tpch:customer:' || c_custkey AS s FROM customer WHERE 'urn:tpch:customer:' || c_custkey NOT IN (SELECT subject FROM good))"""

ORACLE = {
    "activation_state": lens.lens_sql(_DECLARED + "SELECT id, p[1] <> 2 AS active, CASE WHEN p[1] = 2 THEN 'inhibited' END AS reason FROM declared WHERE len(p) = 1"),
    "policy_missing": lens.lens_sql(_DECLARED + "SELECT 'MAPPING_POLICY_MISSING' AS code, id AS subject_id FROM declared WHERE len(p) = 0"),
    "policy_duplicate": lens.lens_sql(_DECLARED + "SELECT 'DUPLICATE_MAPPING_POLICY' AS code, id AS subject_id FROM declared WHERE len(p) > 1"),
    "selector_counts": lens.lens_sql(_DECLARED + "SELECT d::INTEGER AS declaration, (SELECT count(*) FROM declared WHERE list_contains(p, d)) AS n FROM range(7) t(d)"),
    "selector_issues": lens.lens_sql(_DECLARED + """SELECT * FROM (
SELECT 'UNKNOWN_MAPPING_SELECTOR_ID' AS code, i AS subject_id FROM (SELECT unnest(['urn:map:order-customer:1', 'urn:map:order-customer:2', 'urn:map:order-customer:0']) AS i) WHERE i NOT IN (SELECT id FROM mappings)
UNION ALL SELECT 'UNKNOWN_MAPPING_DECLARATION', 'urn:map:order-parts:3' WHERE 'urn:map:order-parts:3' NOT IN (SELECT id FROM mappings)
UNION ALL SELECT 'EMPTY_MAPPING_SELECTOR', d::VARCHAR FROM range(7) t(d) WHERE d <> 5 AND (SELECT count(*) FROM declared WHERE list_contains(p, d)) = 0)"""),
    "context_missing": lens.lens_sql(_DECLARED + "SELECT 'CONTEXT_KEY_MISSING' AS code, id AS subject_id FROM (SELECT id, unnest(p) AS k FROM declared) WHERE k IN (2, 3)"),
    "policy_semantics": lens.lens_sql("""SELECT code, id AS subject_id, count(*) AS n FROM (
SELECT 'UNDECLARED_LOSSINESS' AS code, id FROM mappings WHERE lossiness = 'unknown'
UNION ALL SELECT 'REVERSIBLE_MAPPING_IS_LOSSY', id FROM mappings WHERE relation = 'core:depends_on' AND lossiness <> 'lossless') GROUP BY ALL"""),
    "policy_unknown_subjects": lens.lens_sql("SELECT DISTINCT 'UNKNOWN_POLICY_SUBJECT' AS code, subject AS subject_id FROM evidence WHERE subject NOT IN (SELECT id FROM entities)", True),
    "constraint_requires_evidence": lens.lens_sql(_BARE + " SELECT 'REQUIRED_EVIDENCE_MISSING' AS code, s AS subject_id FROM bare"),
    "constraint_requires_mapping": lens.lens_sql(_ACTIVE + " SELECT 'REQUIRED_MAPPING_MISSING' AS code, id AS subject_id FROM entities WHERE kind = 'tpch:order' AND id NOT IN (SELECT src FROM live WHERE relation = 'core:references')"),
    "constraint_forbids_mapping": lens.lens_sql(_ACTIVE + " SELECT DISTINCT 'FORBIDDEN_MAPPING_ACTIVE' AS code, dst AS subject_id FROM live WHERE relation = 'core:depends_on'"),
    "constraint_unique_target": lens.lens_sql(_ACTIVE + " SELECT 'NON_UNIQUE_MAPPING_TARGET' AS code, src AS subject_id FROM live WHERE relation = 'core:references' GROUP BY src HAVING count(DISTINCT dst) > 1"),
    "constraint_requires_authority": lens.lens_sql(""", c AS (SELECT concept, count(*) FILTER (mode = 'canonical' AND (list_contains(facts, '*') OR list_contains(facts, 'price'))) AS k FROM authorities GROUP BY concept)
SELECT 'REQUIRED_AUTHORITY_UNRESOLVED' AS code, e.id AS subject_id FROM entities e LEFT JOIN c ON c.concept = e.id WHERE e.kind = 'tpch:nation' AND coalesce(k, 0) <> 1"""),
    "topology_totality": lens.lens_sql(_ACTIVE + """, n AS (SELECT e.id, count(DISTINCT dst) AS n, count(DISTINCT dst) FILTER (dst NOT LIKE 'urn:tpch:part:%') AS wrong FROM entities e LEFT JOIN live l ON l.src = e.id AND l.relation = 'core:references' WHERE e.kind = 'tpch:order' GROUP BY e.id)
SELECT 'TOPOLOGY_COUNTERPART_KIND_MISMATCH' AS code, id AS subject_id FROM n WHERE wrong > 0 UNION ALL SELECT 'TOPOLOGY_REQUIRED_RELATION_MISSING', id FROM n WHERE n = 0 UNION ALL SELECT 'TOPOLOGY_RELATION_AMBIGUOUS', id FROM n WHERE n > 1"""),
    "topology_reachable": "SELECT 'TOPOLOGY_ENTITY_UNREACHABLE' AS code, 'urn:tpch:customer:' || c_custkey AS subject_id FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey <> 0",
    "topology_context": """SELECT CASE WHEN n_regionkey = 1 THEN 'TOPOLOGY_CONTEXT_PROVIDER_AMBIGUOUS' ELSE 'TOPOLOGY_CONTEXT_PROVIDER_MISSING' END AS code, 'urn:tpch:customer:' || c_custkey AS subject_id
FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_nationkey % 3 <> 0 AND n_regionkey NOT IN (0, 2)""",
    "contradictions": lens.lens_sql("SELECT 'CONTRADICTING_EVIDENCE' AS code, subject AS subject_id, count(*) AS n FROM evidence WHERE result = 'contradicts' GROUP BY subject"),
    "supporting_evidence": lens.lens_sql("SELECT id FROM evidence WHERE result = 'supports'"),
    "waivers_applied": lens.lens_sql(_BARE + " SELECT CASE WHEN c_custkey % 5 = 0 THEN 'warning' ELSE 'error' END AS severity, 'REQUIRED_EVIDENCE_MISSING' AS code, s AS subject_id, CASE WHEN c_custkey % 10 = 0 THEN 'w1' WHEN c_custkey % 5 = 0 THEN 'w2' END AS waived_by FROM bare"),
    "stale_waivers": "SELECT * FROM (VALUES ('warning', 'STALE_WAIVER', 'w3'), ('error', 'EXPIRED_WAIVER', 'w4'), ('error', 'INVALID_WAIVER_EXPIRY', 'w5')) t(severity, code, subject_id)",
}
