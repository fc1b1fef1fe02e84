"""Queries of composition, diff, correspondence, projection, path trees and reports, with their SQL."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from corrgraph.operators import compose, correspond, diff, pathtree, projection, report, validate
from corrgraph.sources import lens


def _versions(spark, d):
    """The graph before and after: orders come, go and change."""
    whole = lens.graph(spark, d)
    key = F.regexp_extract("id", r"(\d+)$", 1).cast("long")
    order = F.col("kind") == "tpch:order"
    head = F.col("id").startswith("urn:map:order-")
    before = replace(whole, entities=whole.entities.filter(~order | (key % 10 != 0)), mappings=whole.mappings.filter(~head | (key % 10 != 0)))
    after = replace(whole, entities=whole.entities.filter(~order | (key % 10 != 1)), mappings=whole.mappings.filter(~head | (key % 10 != 1)))
    changed = after.entities.withColumns({"attributes": F.when(order & (key % 7 == 0), '{"status":"X"}').otherwise(F.col("attributes")), "label": F.when(order & (key % 11 == 0), F.concat("label", F.lit(" (revised)"))).otherwise(F.col("label"))})
    return before, replace(after, entities=changed, mappings=after.mappings.withColumn("lossiness", F.when(head & (key % 13 == 0), "unknown").otherwise(F.col("lossiness"))))


def compose_merge(spark, d):
    merged = compose.compose(list(_versions(spark, d)), strict=False)
    return merged.entities.select("id", "kind", "label", "attributes")


def compose_conflicts(spark, d):
    return compose.conflicts(list(_versions(spark, d))).select("kind", "id", "n")


def _changes(spark, d):
    before, after = _versions(spark, d)
    return diff.diff(before, after)


def diff_records(spark, d):
    return _changes(spark, d).select("kind", "id", "change")


def diff_properties(spark, d):
    return _changes(spark, d).filter("change = 'changed'").select("kind", "id", F.array_join("changed_properties", ",").alias("changed_properties"))


FIELDS = [
    ("orders.model", "orderkey", "integer", True, False, "one", False), ("orders.model", "customer", "reference:Customer", True, False, "one", False),
    ("orders.model", "status", "enum:OrderStatus", True, False, "one", False), ("orders.model", "price", "number", True, True, "one", False),
    ("orders.model", "lines", "reference:Line", True, False, "many", True), ("orders.model", "note", "string", True, True, "one", False),
    ("orders.schema", "id", "integer", True, False, "one", False), ("orders.schema", "customer", "reference:customerSchema", True, False, "one", False),
    ("orders.schema", "status", "enum:inline", False, False, "one", False), ("orders.schema", "price", "string", True, False, "many", False),
    ("orders.schema", "tags", "array:string", False, False, "many", False),
]
PAIRS = [("orderkey", "id", ["type", "presence", "nullability", "cardinality"], []), ("customer", "customer", ["type"], []), ("status", "status", ["type", "presence"], ["presence"]), ("price", "price", ["type", "presence", "nullability", "cardinality"], ["type"]), ("ghost", "id", ["type"], [])]
IGNORED = [("source", "note"), ("source", "gone"), ("target", "nothing")]


def _catalogue(spark):
    return spark.createDataFrame([(*f, k) for k, f in enumerate(FIELDS)], "structure string, name string, data_type string, presence boolean, nullable boolean, cardinality string, relation boolean, ord int")


def field_drift(spark, d):
    pairs = spark.createDataFrame([("orders", "orders.model", "orders.schema", *p) for p in PAIRS], "correspondence string, source_structure string, target_structure string, source string, target string, compare array<string>, allowed array<string>")
    return correspond.field_drift(pairs, _catalogue(spark))


def coverage(spark, d):
    sides = spark.createDataFrame([("orders", "source", "orders.model", True), ("orders", "target", "orders.schema", True)], "correspondence string, side string, structure string, required boolean")
    mapped = spark.createDataFrame([("orders", side, p[k]) for p in PAIRS[:4] for k, side in enumerate(("source", "target"))], "correspondence string, side string, name string")
    ignored = spark.createDataFrame([("orders", *x) for x in IGNORED], "correspondence string, side string, name string")
    return correspond.coverage(_catalogue(spark), sides, mapped, ignored)


def enum_drift(spark, d):
    source = lens.table(spark, d, "events").select(F.col("event_type").alias("name"))
    target = spark.createDataFrame([("click",), ("view",), ("purchase",), ("refund",), ("return",)], "name string")
    return correspond.enum_drift(source, target, spark.createDataFrame([("signup", "source"), ("refund", "target")], "name string, side string"))


def unconfigured(spark, d):
    structures = lens.table(spark, d, "part").select(F.col("p_type").alias("source_id"), F.lit("model").alias("kind"), F.col("p_brand").alias("name")).distinct()
    return correspond.unconfigured(structures, structures.filter(F.col("name").endswith("1")))


SPEC = {
    "id": "urn:spec:orders",
    "select": {"kinds": ["tpch:order"]},
    "slots": [
        {"name": "customer", "relation": "core:depends_on", "direction": "outgoing", "cardinality": "exactly-one"},
        {"name": "supplier", "relation": "core:references", "direction": "outgoing", "cardinality": "zero-or-one", "targetKinds": ["tpch:supplier"], "allowLossy": True},
        {"name": "parts", "relation": "core:references", "direction": "outgoing", "cardinality": "one-or-more", "targetKinds": ["tpch:part"]},
    ],
}


def _active(graph):
    return graph.mappings.filter("lossiness <> 'unknown'").select("id")


def projection_slots(spark, d):
    graph = lens.graph(spark, d)
    return projection.slots(graph, _active(graph), SPEC).select("subject", "slot", F.col("n").cast("long").alias("n"), F.array_join("targets", ",").alias("targets"))


def projection_issues(spark, d):
    graph = lens.graph(spark, d)
    return projection.projection_issues(graph, _active(graph), SPEC).groupBy("code", "subject_id", "slot").agg(F.count("*").alias("n"))


def projection_pivot(spark, d):
    graph = lens.graph(spark, d)
    return projection.pivot(projection.slots(graph, _active(graph), SPEC), SPEC)


def _paths(spark, d):
    pages = lens.table(spark, d, "pages")
    return pages.select(F.concat(F.lit("urn:page:"), F.lpad(F.col("page_id").cast("string"), 12, "0")).alias("subject"), F.regexp_extract("url", r"^[a-z]+://[^/]+(/[^?#]*)", 1).alias("path"))


def path_nodes(spark, d):
    return pathtree.nodes(pathtree.occupied(_paths(spark, d))[0])


def path_collisions(spark, d):
    return pathtree.occupied(_paths(spark, d))[1]


def path_params(spark, d):
    keyed = lens.table(spark, d, "part").select(F.concat(F.lit("urn:part:"), F.col("p_partkey").cast("string")).alias("subject"), F.concat(F.lit("/parts/"), F.lower(F.replace("p_brand", F.lit("#"), F.lit("-"))), F.when(F.col("p_size") % 3 == 0, "/:size").when(F.col("p_size") % 3 == 1, "/*rest").otherwise("/*more?"), F.lit("/"), F.col("p_partkey").cast("string")).alias("path"))
    return pathtree.parameters(pathtree.occupied(keyed)[0])


def report_issue_groups(spark, d):
    return report.issue_groups(validate.unresolved_endpoints(lens.graph(spark, d, True)).unionByName(validate.cardinality_mismatches(lens.graph(spark, d, True))))


QUERIES = {
    "compose_merge": compose_merge,
    "compose_conflicts": compose_conflicts,
    "diff_records": diff_records,
    "diff_counts": lambda spark, d: diff.counts(_changes(spark, d)),
    "diff_by_kind": lambda spark, d: diff.by_kind(_changes(spark, d)),
    "diff_properties": diff_properties,
    "field_drift": field_drift,
    "enum_drift": enum_drift,
    "coverage": coverage,
    "unconfigured": unconfigured,
    "projection_slots": projection_slots,
    "projection_issues": projection_issues,
    "projection_pivot": projection_pivot,
    "path_nodes": path_nodes,
    "path_collisions": path_collisions,
    "path_params": path_params,
    "report_issue_groups": report_issue_groups,
    "kind_counts": lambda spark, d: report.kind_counts(lens.graph(spark, d)),
    "relation_counts": lambda spark, d: report.relation_counts(lens.graph(spark, d)),
}

_VERSIONS = """, keyed AS MATERIALIZED (SELECT *, CASE WHEN kind = 'tpch:order' THEN regexp_extract(id, '(\\d+)$', 1)::BIGINT END AS k FROM entities),
old AS MATERIALIZED (SELECT id, kind, label, attributes FROM keyed WHERE k IS NULL OR k % 10 <> 0),
new AS MATERIALIZED (SELECT id, kind, CASE WHEN k % 11 = 0 THEN label || ' (revised)' ELSE label END AS label, CASE WHEN k % 7 = 0 THEN '{"status":"X"}' ELSE attributes END AS attributes FROM keyed WHERE k IS NULL OR k % 10 <> 1),
oldm AS MATERIALIZED (SELECT id, lossiness FROM mappings WHERE name NOT LIKE 'order%' OR key % 10 <> 0),
newm AS MATERIALIZED (SELECT id, CASE WHEN name LIKE 'order%' AND key % 13 = 0 THEN 'unknown' ELSE lossiness END AS lossiness FROM mappings WHERE name NOT LIKE 'order%' OR key % 10 <> 1),
changes AS MATERIALIZED (
  SELECT 'entity' AS kind, coalesce(o.id, n.id) AS id, CASE WHEN n.id IS NULL THEN 'removed' WHEN o.id IS NULL THEN 'added' WHEN o.label <> n.label OR o.attributes <> n.attributes THEN 'changed' END AS change,
    array_to_string(list_filter([CASE WHEN o.attributes <> n.attributes THEN 'attributes' END, CASE WHEN o.label <> n.label THEN 'label' END], lambda x: x IS NOT NULL), ',') AS changed_properties
  FROM old o FULL JOIN new n ON o.id = n.id
  UNION ALL SELECT 'mapping', coalesce(o.id, n.id), CASE WHEN n.id IS NULL THEN 'removed' WHEN o.id IS NULL THEN 'added' WHEN o.lossiness <> n.lossiness THEN 'changed' END, 'lossiness' FROM oldm o FULL JOIN newm n ON o.id = n.id)
"""
_CATALOGUE = "WITH f(structure, name, data_type, presence, nullable, cardinality, relation) AS (VALUES " + ", ".join(f"('{a}', '{b}', '{c}', {p}, {n}, '{e}', {r})" for a, b, c, p, n, e, r in FIELDS) + "), p(source, target, compare, allowed) AS (VALUES " + ", ".join(f"('{s}', '{t}', {c}::VARCHAR[], {a}::VARCHAR[])" for s, t, c, a in PAIRS) + "), i(side, name) AS (VALUES " + ", ".join(f"('{s}', '{n}')" for s, n in IGNORED) + ")"
_LINKS = """, live AS (SELECT e.* FROM edges e WHERE lossiness <> 'unknown'),
hits AS (
  SELECT src AS subject, 'customer' AS slot, mapping_id, lossiness, dst, true AS fits, false AS ok FROM live WHERE relation = 'core:depends_on'
  UNION ALL SELECT src, 'supplier', mapping_id, lossiness, dst, dst LIKE 'urn:tpch:supplier:%', true FROM live WHERE relation = 'core:references'
  UNION ALL SELECT src, 'parts', mapping_id, lossiness, dst, dst LIKE 'urn:tpch:part:%', false FROM live WHERE relation = 'core:references'),
filled AS (
  SELECT e.id AS subject, s.slot, count(DISTINCT h.dst) AS n, coalesce(string_agg(DISTINCT h.dst, ',' ORDER BY h.dst), '') AS targets
  FROM entities e CROSS JOIN (VALUES ('customer'), ('supplier'), ('parts')) s(slot) LEFT JOIN hits h ON h.subject = e.id AND h.slot = s.slot AND h.fits
  WHERE e.kind = 'tpch:order' GROUP BY ALL)
"""
_PATHS = """WITH paths AS (SELECT 'urn:page:' || lpad(page_id::VARCHAR, 12, '0') AS subject, regexp_extract(url, '^[a-z]+://[^/]+(/[^?#]*)', 1) AS path FROM pages),
told AS (SELECT *, CASE WHEN path = '' THEN 'PATH_TREE_PATH_MISSING' WHEN path = '/' THEN NULL WHEN path LIKE '%/' OR path LIKE '%//%' THEN 'PATH_TREE_INVALID_PATH'
  WHEN NOT regexp_full_match(path, '(/([A-Za-z0-9._~-]+|:[A-Za-z][A-Za-z0-9_]*|[*][A-Za-z][A-Za-z0-9_]*[?]?))+') THEN 'PATH_TREE_INVALID_PATH' END AS code FROM paths),
first AS (SELECT path, min(subject) AS occupant FROM told WHERE code IS NULL GROUP BY path)
"""

ORACLE = {
    "compose_merge": lens.lens_sql(_VERSIONS + "SELECT * FROM old UNION ALL SELECT * FROM new WHERE id NOT IN (SELECT id FROM old)"),
    "compose_conflicts": lens.lens_sql(_VERSIONS + "SELECT kind, id, 2::BIGINT AS n FROM changes WHERE change = 'changed'"),
    "diff_records": lens.lens_sql(_VERSIONS + "SELECT kind, id, change FROM changes WHERE change IS NOT NULL"),
    "diff_counts": lens.lens_sql(_VERSIONS + "SELECT c.change, count(x.id) AS n FROM (VALUES ('added'), ('changed'), ('removed')) c(change) LEFT JOIN changes x ON x.change = c.change GROUP BY c.change"),
    "diff_by_kind": lens.lens_sql(_VERSIONS + "SELECT kind, change, count(*) AS n FROM changes WHERE change IS NOT NULL GROUP BY ROLLUP (kind, change)"),
    "diff_properties": lens.lens_sql(_VERSIONS + "SELECT kind, id, changed_properties FROM changes WHERE change = 'changed'"),
    "field_drift": _CATALOGUE + """, b AS (SELECT p.*, s.name AS sn, t.name AS tn, s.data_type AS st, t.data_type AS tt, s.presence AS sp, t.presence AS tp, s.nullable AS su, t.nullable AS tu, s.cardinality AS sc, t.cardinality AS tc
  FROM p LEFT JOIN f s ON s.structure = 'orders.model' AND s.name = p.source LEFT JOIN f t ON t.structure = 'orders.schema' AND t.name = p.target),
sym AS (SELECT *, lower(regexp_replace(regexp_replace(regexp_replace(st, '^(reference|enum):', ''), '(?i)schema$', ''), '[^A-Za-z0-9]', '', 'g')) AS ss, lower(regexp_replace(regexp_replace(regexp_replace(tt, '^(reference|enum):', ''), '(?i)schema$', ''), '[^A-Za-z0-9]', '', 'g')) AS ts FROM b),
d AS (SELECT source, target, allowed, unnest(list_filter([
  CASE WHEN list_contains(compare, 'type') AND NOT (st = tt OR (regexp_matches(st, '^(reference|enum):') AND regexp_matches(tt, '^(reference|enum):') AND ss = ts)) THEN 'type' END,
  CASE WHEN list_contains(compare, 'presence') AND sp <> tp THEN 'presence' END, CASE WHEN list_contains(compare, 'nullability') AND su <> tu THEN 'nullability' END,
  CASE WHEN list_contains(compare, 'cardinality') AND sc <> tc THEN 'cardinality' END], lambda x: x IS NOT NULL)) AS fact FROM sym WHERE sn IS NOT NULL AND tn IS NOT NULL)
SELECT 'error' AS severity, 'MISSING_MAPPED_FIELD' AS code, 'orders' AS correspondence, source, target, NULL AS fact FROM b WHERE sn IS NULL OR tn IS NULL
UNION ALL SELECT CASE WHEN list_contains(allowed, fact) THEN 'info' ELSE 'error' END, CASE WHEN list_contains(allowed, fact) THEN 'WAIVED_FIELD_DIFFERENCE' ELSE 'FIELD_DRIFT' END, 'orders', source, target, fact FROM d""",
    "enum_drift": """WITH s AS (SELECT DISTINCT event_type AS name FROM events), t(name) AS (VALUES ('click'), ('view'), ('purchase'), ('refund'), ('return'))
SELECT CASE WHEN name = 'signup' THEN 'info' ELSE 'error' END AS severity, CASE WHEN name = 'signup' THEN 'WAIVED_ENUM_DIFFERENCE' ELSE 'ENUM_VALUE_DRIFT' END AS code, name, 'source' AS side FROM s WHERE name NOT IN (SELECT name FROM t)
UNION ALL SELECT CASE WHEN name = 'refund' THEN 'info' ELSE 'error' END, CASE WHEN name = 'refund' THEN 'WAIVED_ENUM_DIFFERENCE' ELSE 'ENUM_VALUE_DRIFT' END, name, 'target' FROM t WHERE name NOT IN (SELECT name FROM s)""",
    "coverage": _CATALOGUE + """, n AS (SELECT CASE structure WHEN 'orders.model' THEN 'source' ELSE 'target' END AS side, name FROM f WHERE NOT relation),
m AS (SELECT 'source' AS side, source AS name FROM p WHERE source <> 'ghost' UNION SELECT 'target', target FROM p WHERE source <> 'ghost')
SELECT 'error' AS severity, 'UNMAPPED_FIELD' AS code, 'orders' AS correspondence, side, name FROM n WHERE (side, name) NOT IN (SELECT side, name FROM m) AND (side, name) NOT IN (SELECT side, name FROM i)
UNION ALL SELECT 'warning', 'STALE_COVERAGE_IGNORE', 'orders', side, name FROM i WHERE (side, name) NOT IN (SELECT side, name FROM n)""",
    "unconfigured": """WITH s AS (SELECT DISTINCT p_type AS source_id, p_brand AS name FROM part WHERE p_brand NOT LIKE '%1'), r AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY name) AS r, count(*) OVER (PARTITION BY source_id) AS n FROM s)
SELECT source_id, any_value(n) AS n, string_agg(name, ', ' ORDER BY name) || CASE WHEN any_value(n) > 12 THEN ', …' ELSE '' END AS names FROM r WHERE r <= 12 GROUP BY source_id""",
    "projection_slots": lens.lens_sql(_LINKS + "SELECT subject, slot, n, targets FROM filled"),
    "projection_issues": lens.lens_sql(_LINKS + """SELECT code, subject AS subject_id, slot, count(*) AS n FROM (
SELECT DISTINCT 'LOSSY_PROJECTION_LINK' AS code, subject, slot, mapping_id AS x FROM hits WHERE lossiness = 'lossy' AND NOT ok
UNION ALL SELECT 'PROJECTION_TARGET_KIND_MISMATCH', subject, slot, dst FROM hits WHERE NOT fits
UNION ALL SELECT 'REQUIRED_PROJECTION_TARGET_MISSING', subject, slot, NULL FROM filled WHERE n = 0 AND slot IN ('customer', 'parts')
UNION ALL SELECT 'AMBIGUOUS_PROJECTION_TARGET', subject, slot, NULL FROM filled WHERE n > 1 AND slot IN ('customer', 'supplier')) GROUP BY ALL"""),
    "projection_pivot": lens.lens_sql(_LINKS + "SELECT subject, max(CASE WHEN slot = 'customer' AND n > 0 THEN string_split(targets, ',')[1] END) AS customer, max(CASE WHEN slot = 'supplier' AND n > 0 THEN string_split(targets, ',')[1] END) AS supplier, max(CASE WHEN slot = 'parts' THEN targets END) AS parts FROM filled GROUP BY subject"),
    "path_nodes": _PATHS + """, parts AS (SELECT CASE WHEN path = '/' THEN [] ELSE string_split(path[2:], '/') END AS s FROM first),
pre AS (SELECT DISTINCT '/' || array_to_string(s[1:i], '/') AS path, CASE WHEN i > 0 THEN '/' || array_to_string(s[1:i-1], '/') END AS parent_path, CASE WHEN i > 0 THEN s[i] END AS segment, i::INTEGER AS depth FROM (SELECT s, unnest(generate_series(0, len(s))) AS i FROM parts))
SELECT pre.path, parent_path, segment, depth, occupant FROM pre LEFT JOIN first ON first.path = pre.path""",
    "path_collisions": _PATHS + "SELECT code, subject AS subject_id, path FROM told WHERE code IS NOT NULL UNION ALL SELECT 'PATH_TREE_COLLISION', subject, t.path FROM told t JOIN first f ON f.path = t.path WHERE code IS NULL AND subject <> occupant",
    "path_params": "SELECT DISTINCT CASE p_size % 3 WHEN 0 THEN ':size' WHEN 1 THEN '*rest' ELSE '*more?' END AS token, CASE p_size % 3 WHEN 0 THEN 'size' WHEN 1 THEN 'rest' ELSE 'more' END AS name FROM part",
    "report_issue_groups": lens.lens_sql(""", found AS (SELECT 'UNRESOLVED_ENDPOINT' AS code, 'urn:map:' || name || ':' || key AS s FROM linked WHERE dst NOT IN (SELECT id FROM entities)
UNION ALL SELECT 'CARDINALITY_MISMATCH', id FROM mappings WHERE relation IN (SELECT relation FROM relations) AND cardinality IN ('one-to-one', 'many-to-one') AND n <> 1),
r AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY s) AS r, count(*) OVER (PARTITION BY code) AS n FROM found)
SELECT 'error' AS severity, code, any_value(n) AS n, string_agg(s, ', ' ORDER BY s) AS examples FROM r WHERE r <= 3 GROUP BY code""", True),
    "kind_counts": lens.lens_sql("SELECT kind, count(*) AS n FROM entities GROUP BY kind"),
    "relation_counts": lens.lens_sql("SELECT relation, count(*) AS n FROM mappings GROUP BY relation"),
}
