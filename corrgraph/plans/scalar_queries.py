"""Queries of scalar functions and of the smaller operators, with their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from corrgraph.functions import context, identifiers
from corrgraph.operators import correspond, diff, pathtree, projection, validate
from corrgraph.operators.issues import union
from corrgraph.plans.shape_queries import _VERSIONS, SPEC, _versions
from corrgraph.sources import lens

#: Segment forms by the size of a part; every form of a route's folder name.
FORMS = ["[id]", "[...all]", "[[...rest]]", "@slot", "(group)", "(.)near", "plain"]


def _pick(values, by):
    return reduce(lambda c, k: c.when(by == k, F.lit(values[k])), range(1, len(values)), F.when(by == 0, F.lit(values[0])))


def _segments(spark, d):
    return lens.table(spark, d, "part").select("p_partkey", _pick(FORMS, F.col("p_size") % 7).alias("a"), _pick(FORMS, F.col("p_partkey") % 7).alias("b"))


def segment_kinds(spark, d):
    return _segments(spark, d).select("p_partkey", "a", identifiers.segment_kind(F.col("a")).alias("kind"), identifiers.url_segment(F.col("a")).alias("url"))


def route_paths(spark, d):
    return _segments(spark, d).select("p_partkey", identifiers.route_path(F.concat_ws("/", F.lit("app"), "a", "b")).alias("path"))


NAMES = ["urn:a:b", "core:contains", "Core:contains", "no colon", "x:y z", "a or b", "src/*.ts", "1:a", "repo://r/a b"]


def identifier_checks(spark, d):
    rows = lens.table(spark, d, "part").select("p_partkey", F.concat(_pick(NAMES, F.col("p_partkey") % 9), F.when(F.col("p_size") % 2 == 0, "").otherwise("[1]")).alias("s"))
    s = F.col("s")
    return rows.select("p_partkey", identifiers.reference_identifier(s).alias("reference"), identifiers.relation_identifier(s).alias("relation"), identifiers.has_ambiguous_language(s).alias("ambiguous"), identifiers.is_path_pattern(s).alias("pattern"))


def repository_uris(spark, d):
    rows = lens.table(spark, d, "part").select("p_partkey", F.concat(F.when(F.col("p_size") % 2 == 0, "./src\\").otherwise("src/"), F.replace("p_name", F.lit(" "), F.lit("/")), F.lit(" (é).ts")).alias("p"))
    return rows.select("p_partkey", identifiers.repository_uris("repo", F.col("p")).alias("uri"))


TYPES = ["string", "enum:State", "reference:StateSchema", "enum:inline", "integer", "reference:order_Schema", "reference:Order"]


def type_pairs(spark, d):
    rows = lens.table(spark, d, "part").select("p_partkey", _pick([*TYPES, None], F.col("p_size") % 8).alias("a"), _pick([*TYPES, None], F.col("p_partkey") % 8).alias("b"))
    return rows.select("p_partkey", identifiers.types_compatible(F.col("a"), F.col("b")).alias("same"))


TIMES = ["2026-01-02T03:04:05Z", "2026-01-02", "2026-01-02T03:04:05", "2026-13-02T03:04:05Z", "2026-01-02T03:04:05.5+02:00", "2026-01-02t03:04:05z x"]


def time_gate(spark, d):
    rows = lens.table(spark, d, "part").select("p_partkey", _pick(TIMES, F.col("p_partkey") % 6).alias("t"))
    return rows.select("p_partkey", identifiers.is_date_time(F.col("t")).alias("good"))


EXPRESSION = {"any": [{"all": [{"key": "type", "operator": "in", "values": ["error", "click"]}, {"not": {"key": "extra", "operator": "equals", "value": "1"}}]}, {"key": "user", "operator": "equals", "value": "7"}, {"key": "extra", "operator": "not-equals", "value": "1"}]}


def context_rows(spark, d):
    """An expression over a context of its own for each event; `extra` is missing from most."""
    e = lens.table(spark, d, "events")
    held = F.map_concat(F.create_map(F.lit("type"), F.col("event_type"), F.lit("user"), F.col("user_id").cast("string")), F.when(F.col("event_id") % 3 == 0, F.create_map(F.lit("extra"), (F.col("event_id") % 2).cast("string"))).otherwise(F.create_map().cast("map<string,string>")))
    return e.select("event_id", context.as_column(EXPRESSION, held).alias("holds"))


def unresolved_authorities(spark, d):
    graph = lens.graph(spark, d)
    from dataclasses import replace

    key = F.regexp_extract("id", r"(\d+)$", 1).cast("long")
    cut = replace(graph, entities=graph.entities.filter(~((F.col("kind") == "tpch:supplier") & (key % 3 == 0)) & ~((F.col("kind") == "tpch:nation") & (key % 5 == 0))))
    return validate.unresolved_authorities(cut).select("code", "subject_id")


def duplicates(spark, d):
    """Entities that repeat a locator and authorities that repeat a fact, by fixed rules."""
    from dataclasses import replace

    graph = lens.graph(spark, d)
    key = F.regexp_extract("id", r"(\d+)$", 1).cast("long")
    twice = F.when(key % 2 == 0, F.array("id", "id")).otherwise(F.array("id"))
    marked = replace(graph, entities=graph.entities.filter("kind = 'tpch:supplier'").withColumn("locators", twice), facts=graph.facts.unionByName(graph.facts.filter("fact = 'price'")))
    return union([validate.duplicate_locators(marked), validate.duplicate_facts(marked)]).select("severity", "code", "subject_id")


def projection_subjects(spark, d):
    graph = lens.graph(spark, d)
    select = {"ids": [f"urn:tpch:{kind}:{k}" for kind in ("nation", "region") for k in range(4)] + ["urn:none"], "kinds": ["tpch:nation"]}
    known = projection.subjects(graph, select).select("id", F.lit("selected").alias("code"))
    return known.unionByName(projection.selection_issues(graph, select).select(F.col("subject_id").alias("id"), "code"))


def projection_single(spark, d):
    """Slots with one target each, the form in which lookups are emitted."""
    graph = lens.graph(spark, d)
    spec = {**SPEC, "slots": SPEC["slots"][:1]}
    found = projection.slots(graph, graph.mappings.select("id"), spec)
    return found.select("subject", F.get("targets", F.lit(0)).alias("target"), F.get("mappings", F.lit(0)).alias("mapping"))


def baseline_drift(spark, d):
    before, after = _versions(spark, d)
    return diff.baseline_issues(diff.diff(before, after), "warning").groupBy("severity", "code").agg(F.count("*").alias("n"))


def structure_resolution(spark, d):
    """References to parts' brands as structures: named once, never, or many times."""
    part = lens.table(spark, d, "part")
    structures = part.select(F.lit("brands").alias("source_id"), F.lit("model").alias("kind"), "p_brand", "p_type").distinct().select("source_id", "kind", F.col("p_brand").alias("name"), F.concat_ws("/", "p_type", "p_brand").alias("structure"))
    types = part.select("p_type").distinct().select(F.lit("types").alias("source_id"), F.lit("model").alias("kind"), F.col("p_type").alias("name"), F.col("p_type").alias("structure"))
    asked = part.select("p_type").distinct().select(F.col("p_type").alias("correspondence"), F.lit("source").alias("side"), F.lit("types").alias("source_id"), F.lit("model").alias("kind"), F.col("p_type").alias("name"))
    asked = asked.unionByName(asked.select("correspondence", F.lit("target").alias("side"), F.lit("none").alias("source_id"), "kind", "name"))
    good, bad = correspond.resolve_structures(structures.unionByName(types), asked)
    return good.select("correspondence", F.lit("resolved").alias("code")).unionByName(bad.select(F.col("subject_id").alias("correspondence"), "code"))


def overlay(spark, d):
    part = lens.table(spark, d, "part").select("p_type").distinct()
    sides = F.array(F.struct(F.lit("source").alias("side"), F.concat(F.lit("s/"), "p_type").alias("structure")), F.struct(F.lit("target").alias("side"), F.concat(F.lit("t/"), "p_type").alias("structure")))
    resolved = part.select(F.col("p_type").alias("correspondence"), F.explode(sides).alias("x")).select("correspondence", "x.*")
    return correspond.overlay(resolved, "tpch")


def hydrated_paths(spark, d):
    keyed = lens.table(spark, d, "part").select(F.concat(F.lit("urn:part:"), F.col("p_partkey").cast("string")).alias("subject"), F.concat(F.lit("/parts/:brand/"), F.col("p_partkey").cast("string"), F.when(F.col("p_size") % 2 == 0, "/*rest?").otherwise("")).alias("path"))
    tree = pathtree.nodes(pathtree.occupied(keyed)[0])
    return pathtree.hydrate(tree, {"brand": "acme"}).filter("occupant IS NOT NULL").select("occupant", "path")


QUERIES = {
    "segment_kinds": segment_kinds, "route_paths": route_paths, "identifier_checks": identifier_checks, "repository_uris": repository_uris, "type_pairs": type_pairs, "time_gate": time_gate,
    "context_rows": context_rows, "validate_unresolved_authority": unresolved_authorities, "validate_duplicates": duplicates, "projection_subjects": projection_subjects, "projection_single": projection_single,
    "baseline_drift": baseline_drift, "structure_resolution": structure_resolution, "correspondence_overlay": overlay, "hydrated_paths": hydrated_paths,
}


def _case(values, by):
    return f"CASE {by} " + " ".join(f"WHEN {k} THEN " + ("NULL" if v is None else f"'{v}'") for k, v in enumerate(values)) + " END"


_URL = ["':id'", "'*all'", "'*rest?'", "NULL", "NULL", "'(.)near'", "'plain'"]
_KINDS = ["dynamic", "catch-all", "optional-catch-all", "parallel", "group", "intercepted", "static"]
_url = lambda by: f"CASE {by} " + " ".join(f"WHEN {k} THEN {v}" for k, v in enumerate(_URL)) + " END"
_symbol = lambda c: f"lower(regexp_replace(regexp_replace(regexp_replace({c}, '^(reference|enum):', ''), '(?i)schema$', ''), '[^A-Za-z0-9]', '', 'g'))"
_fix = lambda c: f"replace(replace(replace(replace(replace(url_encode({c}), '%21', '!'), '%2A', '*'), '%27', ''''), '%28', '('), '%29', ')')"

ORACLE = {
    "segment_kinds": f"SELECT p_partkey, {_case(FORMS, 'p_size % 7')} AS a, {_case(_KINDS, 'p_size % 7')} AS kind, {_url('p_size % 7')} AS url FROM part",
    "route_paths": f"SELECT p_partkey, '/' || concat_ws('/', 'app', {_url('p_size % 7')}, {_url('p_partkey % 7')}) AS path FROM part",
    "identifier_checks": f"""WITH s AS (SELECT p_partkey, {_case(NAMES, 'p_partkey % 9')} || CASE WHEN p_size % 2 = 0 THEN '' ELSE '[1]' END AS s FROM part)
SELECT p_partkey, regexp_matches(s, '^[A-Za-z][A-Za-z0-9+.-]*:\\S+$') AS reference, regexp_matches(s, '^[a-z][a-z0-9._-]*:[a-z][a-z0-9._-]*$') AS relation, regexp_matches(s, '(?i)\\s+or\\s+') AS ambiguous, regexp_matches(s, '[*?{{}}\\[\\]]') AS pattern FROM s""",
    "repository_uris": f"SELECT p_partkey, 'repo://repo/src/' || array_to_string(list_transform(string_split(replace(p_name, ' ', '/') || ' (é).ts', '/'), lambda x: {_fix('x')}), '/') AS uri FROM part",
    "type_pairs": f"""WITH t AS (SELECT p_partkey, {_case([*TYPES, None], 'p_size % 8')} AS a, {_case([*TYPES, None], 'p_partkey % 8')} AS b FROM part)
SELECT p_partkey, coalesce(a IS NOT DISTINCT FROM b OR (regexp_matches(a, '^(reference|enum):') AND regexp_matches(b, '^(reference|enum):') AND {_symbol('a')} = {_symbol('b')}), false) AS same FROM t""",
    "time_gate": "SELECT p_partkey, p_partkey % 6 IN (0, 4) AS good FROM part",
    "context_rows": """SELECT event_id, (event_type IN ('error', 'click') AND NOT (event_id % 3 = 0 AND event_id % 2 = 1)) OR user_id = 7 OR (event_id % 3 = 0 AND event_id % 2 <> 1) AS holds FROM events""",
    "validate_unresolved_authority": lens.lens_sql("""SELECT 'UNRESOLVED_CONCEPT' AS code, id AS subject_id FROM authorities WHERE regexp_extract(concept, '(\\d+)$', 1)::BIGINT % 5 = 0
UNION ALL SELECT 'UNRESOLVED_AUTHORITY_SOURCE', id FROM authorities WHERE regexp_extract(source, '(\\d+)$', 1)::BIGINT % 3 = 0"""),
    "validate_duplicates": lens.lens_sql("""SELECT 'warning' AS severity, 'DUPLICATE_LOCATOR' AS code, 'urn:tpch:supplier:' || s_suppkey AS subject_id FROM supplier WHERE s_suppkey % 2 = 0
UNION ALL SELECT 'error', 'DUPLICATE_FACT', id FROM authorities WHERE list_contains(facts, 'price')"""),
    "projection_subjects": "SELECT 'urn:tpch:nation:' || n_nationkey AS id, 'selected' AS code FROM nation WHERE n_nationkey < 4 UNION ALL SELECT 'urn:none', 'UNKNOWN_PROJECTION_SUBJECT'",
    "projection_single": "SELECT 'urn:tpch:order:' || o_orderkey AS subject, 'urn:tpch:customer:' || o_custkey AS target, 'urn:map:order-customer:' || o_orderkey AS mapping FROM orders",
    "structure_resolution": "SELECT DISTINCT p_type AS correspondence, c.code FROM part, (VALUES ('resolved'), ('MISSING_CORRESPONDENCE_TARGET')) c(code)",
    "correspondence_overlay": """WITH t AS (SELECT DISTINCT p_type AS t FROM part)
SELECT 'urn:tpch:mapping:' || t || ':implements-source' AS id, 'core:implements' AS relation, 'urn:tpch:concept:' || t AS source, 's/' || t AS target, 'unknown' AS lossiness FROM t
UNION ALL SELECT 'urn:tpch:mapping:' || t || ':implements-target', 'core:implements', 'urn:tpch:concept:' || t, 't/' || t, 'unknown' FROM t
UNION ALL SELECT 'urn:tpch:mapping:' || t || ':structure', 'core:derives_from', 's/' || t, 't/' || t, 'unknown' FROM t""",
    "hydrated_paths": "SELECT 'urn:part:' || p_partkey AS occupant, '/parts/acme/' || p_partkey AS path FROM part",
}
ORACLE["baseline_drift"] = lens.lens_sql(_VERSIONS + "SELECT 'warning' AS severity, 'BASELINE_DRIFT' AS code, count(*) AS n FROM changes WHERE change IS NOT NULL")
