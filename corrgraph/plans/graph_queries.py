"""Queries of composition and traversal over the lens, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from corrgraph.functions import canonical, identifiers
from corrgraph.operators import graph as g
from corrgraph.sources import lens

HUB = "urn:tpch:nation:3"
ROOT = "urn:tpch:region:1"


def _one(spark, value):
    return spark.createDataFrame([(value,)], "id string")


def neighbors(direction):
    return lambda spark, d: g.neighbors(lens.graph(spark, d), _one(spark, HUB), direction)


def mappings_for(spark, d):
    return g.mappings_for(lens.graph(spark, d), _one(spark, HUB), "incoming")


def trace(depth, start=ROOT, direction="outgoing"):
    return lambda spark, d: g.trace(lens.graph(spark, d), start, depth, direction).select("id", F.col("depth").cast("int").alias("depth"))


def trace_visits(spark, d):
    return g.trace(lens.graph(spark, d), HUB, 2, "both", ["core:contains"])


def reachable(spark, d):
    return g.reachable(lens.graph(spark, d), ROOT, "core:contains").select("id", F.col("hops").cast("int").alias("hops"))


def unreachable(spark, d):
    graph = lens.graph(spark, d)
    return graph.entities.filter(F.col("kind").isin("tpch:customer", "tpch:supplier")).select("id").join(g.reachable(graph, ROOT, "core:contains").select("id"), "id", "left_anti")


def impact(spark, d):
    found = g.impact(lens.graph(spark, d), _one(spark, "urn:tpch:customer:7"))
    return found.filter(~F.col("id").startswith("urn:map:")).select("id", F.col("hops").cast("int").alias("hops"))


def impact_mappings(spark, d):
    return g.impact(lens.graph(spark, d), _one(spark, "urn:tpch:part:5")).filter(F.col("id").startswith("urn:map:")).select("id")


def urn_encode(spark, d):
    parts = lens.table(spark, d, "part")
    name = F.concat_ws(" ", "p_name", F.lit("a!~*'()/:%é"), "p_brand")
    return parts.select("p_partkey", identifiers.make_urn("tpch", "part", name).alias("urn"))


def record_digest(spark, d):
    e = lens.entities(spark, d)
    return e.select("id", canonical.digest(canonical.record_json(id=F.col("id"), kind=F.col("kind"), label=F.col("label"))).alias("digest"))


QUERIES = {
    "neighbors_out": neighbors("outgoing"),
    "neighbors_in": neighbors("incoming"),
    "neighbors_both": neighbors("both"),
    "mappings_for": mappings_for,
    "trace_depth2": trace(2),
    "trace_depth3": trace(3, HUB, "both"),
    "trace_visits": trace_visits,
    "reachable": reachable,
    "unreachable_entities": unreachable,
    "impact_affected": impact,
    "impact_mappings": impact_mappings,
    "urn_encode": urn_encode,
    "record_digest": record_digest,
}

_OUT = f"SELECT src AS entity_id, mapping_id, dst AS neighbor_id FROM edges WHERE src = '{HUB}'"
_IN = f"SELECT dst AS entity_id, mapping_id, src AS neighbor_id FROM edges WHERE dst = '{HUB}'"


def _bfs(step: str, seed: str, column: str, limit: int | None = None) -> str:
    """Levels of a breadth-first search: a node's level is the least."""
    return f""", steps AS (SELECT DISTINCT here, next FROM ({step})),
walk(id, n) AS (SELECT '{seed}', 0 UNION SELECT s.next, w.n + 1 FROM walk w JOIN steps s ON s.here = w.id WHERE w.n < {limit or 6})
SELECT id, min(n) AS {column} FROM walk GROUP BY id"""


_FORWARD = "SELECT src AS here, dst AS next FROM edges"
_BOTH = "SELECT src AS here, dst AS next FROM edges UNION ALL SELECT dst, src FROM edges"
_CONTAINS = "SELECT src AS here, dst AS next FROM edges WHERE relation = 'core:contains'"
_SPREAD = "SELECT src AS here, dst AS next FROM edges JOIN relations USING (relation) WHERE impact IN ('both', 'source-to-target') UNION ALL SELECT dst, src FROM edges JOIN relations USING (relation) WHERE impact IN ('both', 'target-to-source')"

ORACLE = {
    "neighbors_out": lens.lens_sql(_OUT),
    "neighbors_in": lens.lens_sql(_IN),
    "neighbors_both": lens.lens_sql(f"{_OUT} UNION {_IN}"),
    "mappings_for": lens.lens_sql(f"SELECT DISTINCT dst AS entity_id, mapping_id FROM edges WHERE dst = '{HUB}'"),
    "trace_depth2": lens.lens_sql(_bfs(_FORWARD, ROOT, "depth", 2)),
    "trace_depth3": lens.lens_sql(_bfs(_BOTH, HUB, "depth", 3)),
    "trace_visits": lens.lens_sql(f""", near AS (SELECT 'urn:tpch:region:' || n_regionkey AS r FROM nation WHERE n_nationkey = 3)
SELECT '{HUB}' AS id, 0 AS depth, NULL AS via_mapping, NULL AS predecessor
UNION ALL SELECT dst, 1, mapping_id, src FROM edges WHERE relation = 'core:contains' AND src = '{HUB}'
UNION ALL SELECT src, 1, mapping_id, dst FROM edges WHERE relation = 'core:contains' AND dst = '{HUB}'
UNION ALL SELECT dst, 2, mapping_id, src FROM edges JOIN near ON src = r WHERE relation = 'core:contains' AND dst <> '{HUB}'"""),
    "reachable": lens.lens_sql(_bfs(_CONTAINS, ROOT, "hops")),
    "unreachable_entities": lens.lens_sql(f""", walk(id) AS (SELECT '{ROOT}' UNION SELECT dst FROM walk JOIN edges ON src = id WHERE relation = 'core:contains')
SELECT id FROM entities WHERE kind IN ('tpch:customer', 'tpch:supplier') AND id NOT IN (SELECT id FROM walk)"""),
    "impact_affected": lens.lens_sql(f""", steps AS (SELECT DISTINCT here, next FROM ({_SPREAD})), l0 AS (SELECT 'urn:tpch:customer:7' AS id), l1 AS (SELECT DISTINCT next AS id FROM steps JOIN l0 ON here = id WHERE next NOT IN (SELECT id FROM l0)),
l2 AS (SELECT DISTINCT next AS id FROM steps JOIN l1 ON here = id WHERE next NOT IN (SELECT id FROM l0 UNION SELECT id FROM l1)),
l3 AS (SELECT DISTINCT next AS id FROM steps JOIN l2 ON here = id WHERE next NOT IN (SELECT id FROM l0 UNION SELECT id FROM l1 UNION SELECT id FROM l2)),
s3 AS (SELECT id FROM l0 UNION SELECT id FROM l1 UNION SELECT id FROM l2 UNION SELECT id FROM l3),
l4 AS (SELECT DISTINCT next AS id FROM steps JOIN l3 ON here = id WHERE next NOT IN (SELECT id FROM s3)),
s4 AS (SELECT id FROM s3 UNION SELECT id FROM l4),
l5 AS (SELECT DISTINCT next AS id FROM steps JOIN l4 ON here = id WHERE next NOT IN (SELECT id FROM s4)),
s5 AS (SELECT id FROM s4 UNION SELECT id FROM l5),
l6 AS (SELECT DISTINCT next AS id FROM steps JOIN l5 ON here = id WHERE next NOT IN (SELECT id FROM s5))
SELECT id, 0 AS hops FROM l0 UNION ALL SELECT id, 1 FROM l1 UNION ALL SELECT id, 2 FROM l2 UNION ALL SELECT id, 3 FROM l3 UNION ALL SELECT id, 4 FROM l4 UNION ALL SELECT id, 5 FROM l5 UNION ALL SELECT id, 6 FROM l6"""),
    "impact_mappings": lens.lens_sql(f""", steps AS (SELECT DISTINCT here, next FROM ({_SPREAD})), walk(id) AS (SELECT 'urn:tpch:part:5' UNION SELECT next FROM walk JOIN steps ON here = id)
SELECT DISTINCT mapping_id AS id FROM edges JOIN relations USING (relation)
WHERE (impact IN ('both', 'source-to-target') AND src IN (SELECT id FROM walk)) OR (impact IN ('both', 'target-to-source') AND dst IN (SELECT id FROM walk))"""),
    "urn_encode": """SELECT p_partkey, 'urn:tpch:part:' || replace(replace(replace(replace(replace(url_encode(concat_ws(' ', p_name, 'a!~*''()/:%é', p_brand)), '%21', '!'), '%2A', '*'), '%27', ''''), '%28', '('), '%29', ')') AS urn FROM part""",
    "record_digest": lens.lens_sql("""SELECT id, 'sha256:' || sha256('{"id":"' || id || '","kind":"' || kind || '","label":"' || replace(replace(label, '\\', '\\\\'), '"', '\\"') || '"}' || chr(10)) AS digest FROM entities"""),
}
