"""Constraints over active mappings and evidence, and the registry that custom ones join.

A constraint is a dict with id, kind and parameters. Subjects come as a DataFrame (id), so a rule over
a billion subjects is one join. Evaluators return issues; a bad parameter is the only issue then.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corrgraph.functions.identifiers import is_relation_identifier
from corrgraph.operators import authority
from corrgraph.operators.graph import Graph, edges, reachable, side_of
from corrgraph.operators.issues import SCHEMA, issues, say, union
from corrgraph.plans.scratch import is_empty, save


@dataclass(frozen=True)
class Scope:
    """What a constraint may look at; active: (id) of the active mappings; evidence: (id, subject, kind, result, confidence)."""

    graph: Graph
    active: DataFrame
    evidence: DataFrame

    @property
    def live(self) -> Graph:
        return self.graph.only(self.active)


def nothing(scope: Scope) -> DataFrame:
    return scope.graph.spark.createDataFrame([], SCHEMA)


def invalid(scope: Scope, constraint: dict, why: str) -> DataFrame:
    return scope.graph.spark.createDataFrame([("error", "INVALID_CONSTRAINT_PARAMETERS", f"{constraint['id']}: {why}", constraint["id"])], SCHEMA)


def strings(value) -> bool:
    return isinstance(value, list) and all(isinstance(v, str) for v in value)


def check(constraint: dict, allowed: dict[str, Callable], needed: tuple[str, ...] = ()) -> str | None:
    """What is wrong with a constraint's parameters, if anything."""
    given = constraint.get("parameters") or {}
    for k, v in given.items():
        if k not in allowed:
            return f"unexpected parameter {k}"
        if not allowed[k](v):
            return f"parameter {k} is malformed"
    return next((f"parameter {k} is required" for k in needed if k not in given), None)


def text(v) -> bool:
    return isinstance(v, str)


def requires_evidence(constraint: dict, subjects: DataFrame, scope: Scope) -> DataFrame:
    number = lambda v: isinstance(v, int | float) and not isinstance(v, bool) and 0 <= v <= 1
    if why := check(constraint, {"minimumConfidence": number, "kinds": strings}):
        return invalid(scope, constraint, why)
    p = constraint.get("parameters") or {}
    good = scope.evidence.filter((F.col("result") == "supports") & (F.coalesce("confidence", F.lit(0.0)) >= p.get("minimumConfidence", 0)))
    if "kinds" in p:
        good = good.filter(F.col("kind").isin(p["kinds"]))
    idle = scope.graph.mappings.select("id").join(scope.active.select("id"), "id", "left_anti")
    bare = subjects.select("id").join(idle, "id", "left_anti").join(good.select(F.col("subject").alias("id")), "id", "left_anti")
    return issues(bare, "REQUIRED_EVIDENCE_MISSING", F.col("id"), say(F.col("id"), " lacks supporting evidence"))


MATCH = {"relation": text, "target": text, "direction": lambda v: v in ("source", "target", "either")}


def matching(constraint: dict, subjects: DataFrame, scope: Scope) -> DataFrame:
    """(id, mapping_id, side) of the active mappings with a subject on the side asked for."""
    p = constraint.get("parameters") or {}
    live = scope.live
    heads = live.mappings.select(F.col("id").alias("mapping_id"), "relation")
    if "relation" in p:
        heads = heads.filter(F.col("relation") == p["relation"])
    if "target" in p:
        heads = heads.join(side_of(live.endpoints, "target", "t", "tp").filter(F.col("t") == p["target"]), "mapping_id", "left_semi")
    ends = live.endpoints
    if p.get("direction", "source") != "either":
        ends = ends.filter(F.col("side") == p.get("direction", "source"))
    ends = ends.select("mapping_id", "side", F.col("entity_id").alias("id")).distinct()
    return ends.join(subjects.select("id"), "id", "left_semi").join(heads.select("mapping_id"), "mapping_id", "left_semi")


def requires_mapping(constraint: dict, subjects: DataFrame, scope: Scope) -> DataFrame:
    if why := check(constraint, MATCH):
        return invalid(scope, constraint, why)
    bare = subjects.select("id").join(matching(constraint, subjects, scope), "id", "left_anti")
    return issues(bare, "REQUIRED_MAPPING_MISSING", F.col("id"), say(F.col("id"), " has no active mapping for ", constraint["id"]))


def forbids_mapping(constraint: dict, subjects: DataFrame, scope: Scope) -> DataFrame:
    if why := check(constraint, MATCH):
        return invalid(scope, constraint, why)
    hit = matching(constraint, subjects, scope).groupBy("id").agg(F.count_distinct("mapping_id").alias("n"))
    return issues(hit, "FORBIDDEN_MAPPING_ACTIVE", F.col("id"), say(F.col("id"), " has ", F.col("n"), " forbidden mappings"))


def unique_target(constraint: dict, subjects: DataFrame, scope: Scope) -> DataFrame:
    if why := check(constraint, MATCH):
        return invalid(scope, constraint, why)
    hit = matching(constraint, subjects, scope).groupBy("mapping_id", "id").agg(F.max((F.col("side") == "source").cast("int")).alias("s"))
    other = hit.join(scope.live.endpoints.select("mapping_id", "side", "entity_id"), "mapping_id").filter(((F.col("s") == 1) & (F.col("side") == "target")) | ((F.col("s") == 0) & (F.col("side") == "source")))
    many = other.groupBy("id").agg(F.count_distinct("entity_id").alias("n")).filter("n > 1")
    return issues(many, "NON_UNIQUE_MAPPING_TARGET", F.col("id"), say(F.col("id"), " maps to ", F.col("n"), " counterparts"))


def requires_authority(constraint: dict, subjects: DataFrame, scope: Scope) -> DataFrame:
    if why := check(constraint, {"fact": text}, ("fact",)):
        return invalid(scope, constraint, why)
    asked = subjects.select(F.col("id").alias("concept"), F.lit(constraint["parameters"]["fact"]).alias("fact"))
    found = authority.resolve(scope.graph, asked).filter("status <> 'resolved'")
    return issues(found, "REQUIRED_AUTHORITY_UNRESOLVED", F.col("concept"), say(F.col("concept"), " has ", F.col("status"), " authority for ", F.col("fact")))


# --- topology: subjects are selected from the graph ---------------------------------------------

#: Cardinality to whether none and whether more than one is an issue.
COUNTS = {"exactly-one": (True, True), "zero-or-one": (False, True), "one-or-more": (True, False), "many": (False, False)}


def selected(constraint: dict, scope: Scope) -> DataFrame:
    """(id, kind, attributes) by kinds and, if given, by the exact JSON text of attributes."""
    p = constraint["parameters"]
    found = scope.graph.entities.filter(F.col("kind").isin(p["subjectKinds"]))
    for key, value in (p.get("subjectAttributes") or {}).items():
        import json

        wanted = value if isinstance(value, str) else json.dumps(value, separators=(",", ":"))
        found = found.filter(F.get_json_object("attributes", f"$['{key}']") == wanted)
    return found.select("id", "kind", "attributes")


def excluded(relation: str | None = None):
    """Whether an entity's attributes take it out of a relation: an exclusion without a list is of all."""
    off = F.get_json_object("attributes", "$.topologyDisposition") == "excluded"
    listed = F.from_json(F.get_json_object("attributes", "$.exclusionRelations"), "array<string>")
    scoped = F.lit(True) if relation is None else F.get_json_object("attributes", "$.exclusionRelations").isNull() | F.coalesce(F.array_contains(listed, relation), F.lit(False))
    return F.coalesce(off & scoped, F.lit(False))


def exclusion_issues(rows: DataFrame) -> DataFrame:
    out = rows.filter(excluded())
    filled = lambda k: F.coalesce(F.length(F.get_json_object("attributes", f"$.{k}")) > 0, F.lit(False))
    raw = F.get_json_object("attributes", "$.exclusionRelations")
    listed = F.from_json(raw, "array<string>")
    bad = raw.isNotNull() & ~F.coalesce((F.size(listed) > 0) & F.forall(listed, lambda r: F.coalesce(r.rlike(r"^[a-z][a-z0-9._-]*:[a-z][a-z0-9._-]*$"), F.lit(False))), F.lit(False))
    return issues(out.filter(~(filled("exclusionReason") & filled("exclusionOwner")) | bad), "INVALID_TOPOLOGY_EXCLUSION", F.col("id"), say(F.col("id"), " is excluded without reason, owner or proper relations"))


def no_subjects(constraint: dict, scope: Scope) -> DataFrame:
    return scope.graph.spark.createDataFrame([("error", "EMPTY_TOPOLOGY_SELECTION", f"{constraint['id']} selects nothing", constraint["id"])], SCHEMA)


def relation_totality(constraint: dict, subjects: DataFrame | None, scope: Scope) -> DataFrame:
    """Each selected entity has as many counterparts over the relation as the cardinality allows, of the right kinds."""
    allowed = {"subjectKinds": lambda v: strings(v) and v, "subjectAttributes": lambda v: isinstance(v, dict), "relation": is_relation_identifier, "direction": lambda v: v in ("source", "target"), "cardinality": lambda v: v in COUNTS, "counterpartKinds": lambda v: strings(v) and v, "allowExcluded": lambda v: isinstance(v, bool)}
    if why := check(constraint, allowed, ("subjectKinds", "relation", "direction", "cardinality")):
        return invalid(scope, constraint, why)
    p = constraint["parameters"]
    rows = save(selected(constraint, scope), "selected")
    if is_empty(rows):
        return no_subjects(constraint, scope)
    near, far = ("src", "dst") if p["direction"] == "source" else ("dst", "src")
    pairs = edges(scope.live, [p["relation"]]).select(F.col(near).alias("id"), F.col(far).alias("other")).distinct()
    kinds = scope.graph.entities.groupBy("id").agg(F.max_by("kind", "ord").alias("other_kind")).withColumnRenamed("id", "other")
    right = F.coalesce(F.col("other_kind").isin(p["counterpartKinds"]), F.lit(False)) if p.get("counterpartKinds") else F.lit(True)
    counted = pairs.join(rows.select("id"), "id", "left_semi").join(kinds, "other", "left").groupBy("id").agg(F.count("*").alias("n"), F.count_if(~right).alias("wrong"))
    counted = rows.withColumn("out", excluded(p["relation"])).join(counted, "id", "left").fillna(0, ["n", "wrong"])
    none, more = COUNTS[p["cardinality"]]
    of = lambda cond, code, message: issues(counted.filter(cond), code, F.col("id"), message)
    inside = ~F.col("out")
    out_rule = ("EXCLUDED_TOPOLOGY_SUBJECT_MAPPED", F.col("out") & (F.col("n") > 0)) if p.get("allowExcluded", True) else ("TOPOLOGY_EXCLUSION_NOT_ALLOWED", F.col("out"))
    return union([
        exclusion_issues(rows),
        of(out_rule[1], out_rule[0], say(F.col("id"), " is excluded")),
        of(inside & (F.col("wrong") > 0), "TOPOLOGY_COUNTERPART_KIND_MISMATCH", say(F.col("id"), " has ", F.col("wrong"), " counterparts of other kinds")),
        of(inside & F.lit(none) & (F.col("n") == 0), "TOPOLOGY_REQUIRED_RELATION_MISSING", say(F.col("id"), " has no counterpart")),
        of(inside & F.lit(more) & (F.col("n") > 1), "TOPOLOGY_RELATION_AMBIGUOUS", say(F.col("id"), " has ", F.col("n"), " counterparts")),
    ])


def topology_reachable(constraint: dict, subjects: DataFrame | None, scope: Scope) -> DataFrame:
    allowed = {"subjectKinds": lambda v: strings(v) and v, "subjectAttributes": lambda v: isinstance(v, dict), "root": text, "relation": is_relation_identifier}
    if why := check(constraint, allowed, ("subjectKinds", "root", "relation")):
        return invalid(scope, constraint, why)
    p = constraint["parameters"]
    rows = selected(constraint, scope)
    if is_empty(rows):
        return no_subjects(constraint, scope)
    found = rows.join(reachable(scope.live, p["root"], p["relation"]).select("id"), "id", "left_anti")
    return issues(found, "TOPOLOGY_ENTITY_UNREACHABLE", F.col("id"), say(F.col("id"), " is not reached from ", p["root"]))


CONTEXT_RELATIONS = ("requiresRelation", "providesRelation", "renderedInRelation", "parentRelation", "hostsProviderRelation")


def context_satisfied(constraint: dict, subjects: DataFrame | None, scope: Scope) -> DataFrame:
    """For each subject and context it requires: one provider at the nearest scope level that has any.

    All (subject, context) pairs walk outwards together, a level a round; those decided leave.
    """
    allowed = {"subjectKinds": lambda v: strings(v) and v, "subjectAttributes": lambda v: isinstance(v, dict), **dict.fromkeys(CONTEXT_RELATIONS, is_relation_identifier)}
    if why := check(constraint, allowed, ("subjectKinds", *CONTEXT_RELATIONS)):
        return invalid(scope, constraint, why)
    p = constraint["parameters"]
    rows = selected(constraint, scope).filter(~excluded(p["requiresRelation"]))
    if is_empty(rows):
        return no_subjects(constraint, scope)
    over = lambda k: edges(scope.live, [p[k]]).select("src", "dst").distinct()
    provides = over("providesRelation").select(F.col("src").alias("provider"), F.col("dst").alias("context"))
    hosted = over("hostsProviderRelation").select(F.col("src").alias("scope"), F.col("dst").alias("provider")).join(provides, "provider").select("scope", "context", "provider")
    offers = save(provides.select(F.col("provider").alias("scope"), "context", "provider").unionByName(hosted).distinct(), "offers")
    parents = save(over("parentRelation").select(F.col("dst").alias("scope"), F.col("src").alias("parent")), "parents")
    pairs = save(over("requiresRelation").join(rows.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("src").alias("id"), F.col("dst").alias("context")), "pairs")
    level = pairs.join(over("renderedInRelation").select(F.col("src").alias("id"), F.col("dst").alias("scope")), "id")
    level, visited, settled = save(level, "level"), None, []
    while not is_empty(level):
        counts = save(level.join(offers, ["scope", "context"]).groupBy("id", "context").agg(F.count_distinct("provider").alias("n")), "counts")
        settled.append(counts)
        rest = level.join(counts.select("id", "context"), ["id", "context"], "left_anti")
        visited = level if visited is None else visited.unionByName(level)
        up = rest.join(parents, "scope").select("id", "context", F.col("parent").alias("scope")).distinct()
        level = save(up.join(visited, ["id", "context", "scope"], "left_anti"), "level")
    found = settled[0] if settled else pairs.filter("false").withColumn("n", F.lit(0))
    for part in settled[1:]:
        found = found.unionByName(part)
    many = issues(found.filter("n > 1"), "TOPOLOGY_CONTEXT_PROVIDER_AMBIGUOUS", F.col("id"), say(F.col("id"), " resolves ", F.col("context"), " to ", F.col("n"), " providers"))
    none = issues(pairs.join(found.select("id", "context"), ["id", "context"], "left_anti"), "TOPOLOGY_CONTEXT_PROVIDER_MISSING", F.col("id"), say("nothing provides ", F.col("context"), " around ", F.col("id")))
    return many.unionByName(none)


class ConstraintRegistry:
    """Evaluators by kind. A kind is registered once; unknown and malformed kinds are issues, never skipped."""

    def __init__(self):
        self.known: dict[str, Callable] = {
            "core:requires-evidence": requires_evidence,
            "core:requires-mapping": requires_mapping,
            "core:forbids-mapping": forbids_mapping,
            "core:unique-target": unique_target,
            "core:requires-authority": requires_authority,
            "topology:relation-totality": relation_totality,
            "topology:reachable": topology_reachable,
            "topology:context-satisfied": context_satisfied,
        }

    def register(self, kind: str, evaluator: Callable) -> None:
        if kind in self.known:
            raise ValueError(f"constraint kind {kind} is registered already")
        self.known[kind] = evaluator

    def get(self, kind: str) -> Callable | None:
        return self.known.get(kind)

    def evaluate(self, constraint: dict, scope: Scope, subjects: DataFrame | None = None) -> DataFrame:
        spark = scope.graph.spark
        if not is_relation_identifier(constraint.get("kind")):
            return spark.createDataFrame([("error", "INVALID_CONSTRAINT_KIND", f"{constraint['id']} has no proper kind", constraint["id"])], SCHEMA)
        if self.get(constraint["kind"]) is None:
            return spark.createDataFrame([("error", "UNKNOWN_CONSTRAINT_KIND", f"{constraint['kind']} is unknown", constraint["id"])], SCHEMA)
        if subjects is None:
            subjects = spark.createDataFrame([(s,) for s in constraint.get("subjects", [])], "id string")
        return self.get(constraint["kind"])(constraint, subjects, scope)
