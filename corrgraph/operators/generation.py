"""Compiling a graph under a policy into a content-addressed generation, and promoting it.

Rules run as DataFrame plans; what a generation lists (active mappings, evidence, waivers) is gathered
at the end, since a generation is one document by definition.
"""

from __future__ import annotations

import json
import os
import uuid
from collections import Counter
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corrgraph.functions import shapes
from corrgraph.functions.canonical import collation_key, stable_json, value_digest
from corrgraph.functions.context import parse_context
from corrgraph.functions.identifiers import is_date_time
from corrgraph.functions.relations import RelationRegistry, all_packs
from corrgraph.operators import policy as rules
from corrgraph.operators import projection, validate
from corrgraph.operators.constraints import ConstraintRegistry, Scope
from corrgraph.operators.graph import impact
from corrgraph.operators.issues import SCHEMA, union
from corrgraph.plans.scratch import save
from corrgraph.sources import documents

VERSION = "1.0.0"


@dataclass
class Compilation:
    status: str
    issues: DataFrame
    impact: DataFrame
    generation: dict | None = None
    quarantined: DataFrame | None = field(default=None)


def policy_issues(policy) -> list[tuple[str, str]]:
    """(code, what): the form of a policy, and ids that it uses twice."""
    wrong = shapes.findings(policy, "policy")
    if wrong:
        return wrong
    ids = Counter([policy["id"], *(x["id"] for k in ("constraints", "evidence", "waivers") for x in policy.get(k, []))])
    return [("DUPLICATE_POLICY_ID", i) for i, n in ids.items() for _ in range(n - 1)]


def with_paths(found: DataFrame, spread: DataFrame) -> DataFrame:
    """Issues with causal_path: the way on which a change reached their subject, null where none did."""
    ways = spread.select(F.col("id").alias("subject_id"), F.col("path").alias("causal_path"))
    return found.join(ways, "subject_id", "left").select("severity", "code", "message", "subject_id", "causal_path")


def binding_issues(document: dict, policy: dict) -> list[tuple[str, str]]:
    bound, out = policy["graph"], []
    if bound.get("id") != document["id"]:
        out.append(("GRAPH_BINDING_MISMATCH", policy["id"]))
    if "revision" in bound and bound["revision"] != document.get("revision"):
        out.append(("GRAPH_REVISION_MISMATCH", policy["id"]))
    if "digest" in bound and bound["digest"] != value_digest(document):
        out.append(("GRAPH_DIGEST_MISMATCH", policy["id"]))
    return out


def compile_graph(spark: SparkSession, document: dict, policy: dict, context: dict, evaluated_at: str, changed: list[str] | None = None, registry: RelationRegistry | None = None, constraints: ConstraintRegistry | None = None) -> Compilation:
    """Viable with a generation, or rejected with reasons and what they affect."""
    registry, constraints = registry or all_packs(), constraints or ConstraintRegistry()
    made = lambda rows: spark.createDataFrame([("error", c, c, s) for c, s in rows], SCHEMA)
    ids = lambda xs: spark.createDataFrame([(x,) for x in sorted(set(xs))], "id string")
    timed = spark.createDataFrame([(evaluated_at,)], "t string").filter(is_date_time(F.col("t"))).count()
    late = [] if timed else [("INVALID_EVALUATION_TIME", policy.get("id") if isinstance(policy, dict) else None)]
    shape = documents.shape_issues(document)
    if shape:
        found = made([(c, p) for c, p in shape] + policy_issues(policy) + late)
        nobody = spark.createDataFrame([], "id string, hops int, path array<string>")
        return Compilation("rejected", with_paths(found, nobody), nobody, quarantined=nobody.select("id"))
    g = documents.graph(spark, document, registry)
    wrong = policy_issues(policy)
    sound = not any(code == "INVALID_VIABILITY_POLICY" for code, _ in wrong)
    subjects = [(s, x["id"], k) for f in ("constraints", "evidence") for x in (policy[f] if sound else []) for k, s in enumerate(x["subjects"])]
    stood = spark.createDataFrame(subjects, "id string, of string, n long")
    integrity = save(validate.validate(g), "validation")
    if wrong or not validate.is_valid(integrity):
        spread = save(impact(g, ids(changed or []), None, stood), "impact")
        return Compilation("rejected", with_paths(integrity.unionByName(made(wrong + late)), spread), spread, quarantined=spread.select("id"))

    context = parse_context(context)
    declarations, evidence = policy["mappings"], documents.evidence_of(spark, policy)
    resolved = save(rules.resolve_declarations(g, declarations), "declared")
    state = save(rules.activation(resolved, declarations, context), "state")
    active = state.filter("active").select("id")
    scope = Scope(g, active, evidence)
    named = ids([s for s, _, _ in subjects])
    policy_ids = ids([x["id"] for k in ("constraints", "evidence") for x in policy[k]])
    waivers = policy.get("waivers", [])
    parts = [
        integrity, made(late + binding_issues(document, policy)), rules.selector_issues(g, resolved, declarations), rules.declaration_issues(resolved),
        rules.unknown_subjects(g, document["id"], named, "UNKNOWN_POLICY_SUBJECT"), rules.unknown_subjects(g, document["id"], ids([s for w in waivers for s in w["subjects"]]), "UNKNOWN_WAIVER_SUBJECT", policy_ids),
        rules.semantic_issues(g, resolved, declarations), rules.context_issues(resolved, declarations, context), rules.contradictions(g, evidence, active),
        *[constraints.evaluate(c, scope) for c in policy["constraints"]],
    ]
    found = save(union(parts), "issues")
    table = spark.createDataFrame([(w["id"], k, w["expiresAt"]) for k, w in enumerate(waivers)], "waiver string, ord int, expires_at string")
    pairs = spark.createDataFrame([(w["id"], c, s) for w in waivers for c in w["codes"] for s in w["subjects"]], "waiver string, code string, subject_id string")
    told, own = rules.apply_waivers(found, table, pairs, evaluated_at if timed else "1970-01-01T00:00:00Z")
    told = save(told, "waived")
    everything = save(told.drop("waived_by").unionByName(own), "told")
    errors = everything.filter("severity = 'error'")
    seeds = ids(changed) if changed else errors.filter("subject_id IS NOT NULL").select(F.col("subject_id").alias("id")).distinct()
    spread = save(impact(g, seeds, active, stood), "impact")
    if not validate.is_valid(everything):
        return Compilation("rejected", with_paths(everything, spread), spread, quarantined=spread.select("id"))
    column = lambda df, c: [r[0] for r in df.select(c).distinct().collect()]
    revision = {"revision": document["revision"]} if "revision" in document else {}
    content = {
        "schemaVersion": VERSION,
        "evaluatedAt": evaluated_at,
        "graph": {"id": document["id"], **revision, "digest": value_digest(document)},
        "policy": {"id": policy["id"], "digest": value_digest(policy)},
        "context": context,
        "activeMappings": sorted(column(active, "id")),
        "inactiveMappings": sorted(({"id": r.id, "reason": r.reason} for r in state.filter("NOT active").collect()), key=lambda x: collation_key(x["id"])),
        "evidence": sorted(column(rules.supporting(g, evidence, active), "id")),
        "waiversApplied": sorted(column(told.filter("waived_by IS NOT NULL"), "waived_by")),
    }
    digest = value_digest(content)
    return Compilation("viable", with_paths(everything, spread), spread, content | {"id": address("generation", digest), "digest": digest})


def address(kind: str, digest: str) -> str:
    return f"urn:corrgraph:{kind}:{digest.removeprefix('sha256:')}"


def verify(value: dict, kind: str) -> list[str]:
    """Codes of a content-addressed document: of its form, or else of an address that does not match its content.

    kind is generation, projection or path-tree.
    """
    wrong = shapes.findings(value, kind)
    if wrong:
        return sorted({code for code, _ in wrong})
    content = {k: v for k, v in value.items() if k not in ("$schema", "id", "digest")}
    digest, name = value_digest(content), kind.replace("-", "_").upper()
    return [f"{name}_DIGEST_MISMATCH"] * (value["digest"] != digest) + [f"{name}_ID_MISMATCH"] * (value["id"] != address(kind, digest))


def parse(value, kind: str) -> dict:
    """The document itself if it is sound; otherwise a ValueError that names what is wrong.

    kind is policy, projection-spec, generation, projection or path-tree.
    """
    wrong = shapes.findings(value, kind)
    if not wrong and kind == "policy":
        wrong = policy_issues(value)
    elif not wrong and kind == "projection-spec":
        wrong = projection.spec_issues(value)
    elif not wrong:
        wrong = [(code, value["id"]) for code in verify(value, kind)]
    if wrong:
        raise ValueError(f"{kind}: " + "; ".join(f"{code} {what}" for code, what in wrong[:5]))
    return value


def seal(content: dict, kind: str) -> dict:
    digest = value_digest(content)
    return content | {"id": address(kind, digest), "digest": digest}


class Activator:
    """Keeps the last viable generation; a rejected candidate changes nothing."""

    def __init__(self):
        self.current: dict | None = None

    def offer(self, found: Compilation) -> bool:
        if found.status == "viable":
            self.current = found.generation
        return found.status == "viable"


def promote(found: Compilation, path: str) -> dict:
    """Write a viable generation beside its place and rename it there; a rejected one writes nothing."""
    previous = None
    if os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            previous = json.load(f).get("digest")
    if found.status != "viable":
        return {"activated": False, "path": path, "previousDigest": previous}
    folder = os.path.dirname(os.path.abspath(path))
    os.makedirs(folder, exist_ok=True)
    draft = os.path.join(folder, f".{os.path.basename(path)}.{uuid.uuid4().hex}.tmp")
    try:
        with os.fdopen(os.open(draft, os.O_WRONLY | os.O_CREAT | os.O_EXCL, 0o600), "w", encoding="utf-8") as f:
            f.write(stable_json(found.generation))
            f.flush()
            os.fsync(f.fileno())
        os.replace(draft, path)
    except BaseException:
        if os.path.exists(draft):
            os.unlink(draft)
        raise
    return {"activated": True, "path": path, "previousDigest": previous, "current": found.generation}
