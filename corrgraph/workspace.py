"""A workspace: sources discovered through adapters, composed, overlaid with declared correspondences,
validated, and written as graph tables, a snapshot, a drift report and documentation."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corrgraph.functions.canonical import stable_json, value_digest
from corrgraph.functions.relations import RelationRegistry, all_packs, parse_pack
from corrgraph.operators import compose, correspond, diff, report, validate
from corrgraph.operators.graph import Graph
from corrgraph.operators.issues import issues, say, union
from corrgraph.plans.scratch import is_empty, save
from corrgraph.sources import documents
from corrgraph.sources.adapters import AdapterRegistry, Context, default_registry, discover_cached

REQUIRED = ("id", "namespace", "repository", "repositoryRoot", "sources", "outputs")
OUTPUTS = ("graph", "snapshot", "report", "documentation")


def parse_config(value) -> dict:
    """A workspace configuration; malformed ones raise."""
    if not isinstance(value, dict) or any(k not in value for k in REQUIRED):
        raise ValueError(f"a workspace needs {', '.join(REQUIRED)}")
    names = [s.get("id") for s in value["sources"]]
    if not names or len(set(names)) < len(names) or None in names:
        raise ValueError("sources need ids of their own")
    pairs = [c.get("id") for c in value.get("correspondences", [])]
    if len(set(pairs)) < len(pairs):
        raise ValueError("correspondences need ids of their own")
    for c in value.get("correspondences", []):
        for side in ("source", "target"):
            if c[side].get("sourceId") not in names:
                raise ValueError(f"correspondence {c['id']} names unknown source {c[side].get('sourceId')}")
    if any(k not in value["outputs"] for k in OUTPUTS):
        raise ValueError(f"outputs need {', '.join(OUTPUTS)}")
    return value


@dataclass
class Discovery:
    config: dict
    graph: Graph
    validation: DataFrame
    drift: DataFrame
    diagnostics: DataFrame
    snapshot: dict
    cached: list[str]

    def has_errors(self) -> bool:
        wrong = lambda df: not is_empty(df.filter("severity = 'error'"))
        return wrong(self.validation) or wrong(self.drift) or wrong(self.diagnostics)


def structures_of(g: Graph) -> tuple[DataFrame, DataFrame]:
    """The catalogue that correspondences look at: structures and their children, from attributes."""
    a = lambda k: F.get_json_object("attributes", f"$.{k}")
    flag = lambda k: a(k).cast("boolean")
    structures = g.entities.filter(a("structureKind").isNotNull()).select(a("sourceId").alias("source_id"), a("structureKind").alias("kind"), a("name").alias("name"), F.col("id").alias("structure"))
    children = g.entities.filter(a("structureId").isNotNull()).select(a("structureId").alias("structure"), a("name").alias("name"), a("dataType").alias("data_type"), flag("presenceRequired").alias("presence"), flag("nullable").alias("nullable"), a("cardinality").alias("cardinality"), flag("relation").alias("relation"), F.col("ord"), F.col("id"))
    return structures, children


def correspondences(g: Graph, config: dict) -> tuple[list[dict], DataFrame]:
    """The records that declared correspondences add, and where their sides differ."""
    spark = g.spark
    structures, children = (save(df, "catalogue") for df in structures_of(g))
    listed = config.get("correspondences", [])
    references = spark.createDataFrame([(c["id"], side, c[side]["sourceId"], c[side]["kind"], c[side]["name"]) for c in listed for side in ("source", "target")], "correspondence string, side string, source_id string, kind string, name string")
    resolved, found = correspond.resolve_structures(structures, references)
    at = {(r.correspondence, r.side): r.structure for r in resolved.collect()}  # two for each correspondence
    whole = [c for c in listed if (c["id"], "source") in at and (c["id"], "target") in at]
    pairs, sides, mapped, ignored = [], [], [], []
    for c in whole:
        f = c.get("fields")
        if not f:
            continue
        for p in f["pairs"]:
            pairs.append((c["id"], at[c["id"], "source"], at[c["id"], "target"], p["source"], p["target"], p.get("compare", list(correspond.FACTS)), p.get("allowDifferences", [])))
            mapped += [(c["id"], side, p[side]) for side in ("source", "target")]
        for side in ("source", "target"):
            sides.append((c["id"], side, at[c["id"], side], bool(f.get(f"require{side.title()}Coverage"))))
            ignored += [(c["id"], side, n) for n in f.get(f"ignore{side.title()}", [])]
    frame = spark.createDataFrame
    drift = correspond.field_drift(frame(pairs, "correspondence string, source_structure string, target_structure string, source string, target string, compare array<string>, allowed array<string>"), children)
    drift = save(drift, "drift")
    missing = drift.filter("code = 'MISSING_MAPPED_FIELD'").select("correspondence", "source", "target")
    keys = frame(mapped, "correspondence string, side string, name string")
    lost = missing.select("correspondence", F.explode(F.array(F.struct(F.lit("source").alias("side"), F.col("source").alias("name")), F.struct(F.lit("target").alias("side"), F.col("target").alias("name")))).alias("x")).select("correspondence", "x.*")
    cover = correspond.coverage(children, frame(sides, "correspondence string, side string, structure string, required boolean"), keys.join(lost, ["correspondence", "side", "name"], "left_anti"), frame(ignored, "correspondence string, side string, name string"))
    parts = [
        found,
        drift.select("severity", "code", say(F.col("source"), " and ", F.col("target"), " differ in ", F.col("fact")).alias("message"), F.col("correspondence").alias("subject_id")),
        issues(cover.filter("severity = 'error'"), F.col("code"), F.col("correspondence"), say(F.col("side"), " ", F.col("name"))),
        issues(cover.filter("severity = 'warning'"), F.col("code"), F.col("correspondence"), say(F.col("side"), " ", F.col("name")), "warning"),
    ]
    for c in whole:
        if "enumValues" in c or c["source"]["kind"] == "enum":
            of = lambda side, c=c: children.filter(F.col("structure") == at[c["id"], side])
            allowed = [(n, side) for side in ("source", "target") for n in c.get("enumValues", {}).get(f"allow{side.title()}Only", [])]
            e = correspond.enum_drift(of("source"), of("target"), frame(allowed, "name string, side string"))
            parts.append(e.select("severity", "code", say(F.col("name"), " is in the ", F.col("side"), " alone").alias("message"), F.lit(c["id"]).alias("subject_id")))
    severity = config.get("policy", {}).get("unconfiguredStructures", "warning")
    if severity != "ignore":
        bare = correspond.unconfigured(structures, references.select("source_id", "kind", "name").distinct())
        parts.append(issues(bare, "UNCONFIGURED_STRUCTURES", F.col("source_id"), say(F.col("n"), ": ", F.col("names")), severity))
    return overlay(config, whole, at, drift, children), union(parts)


def overlay(config: dict, whole: list[dict], at: dict, drift: DataFrame, children: DataFrame) -> list[dict]:
    """The document records of resolved correspondences: few, as configurations are written by hand."""
    space = config["namespace"]
    said = {"status": "declared", "assertedBy": f"workspace:{config['id']}"}
    name = lambda kind, value: f"urn:{space}:{kind}:{value}"
    out = {"entities": [], "mappings": [], "authorities": []}
    missing = {(r.correspondence, r.source, r.target) for r in drift.filter("code = 'MISSING_MAPPED_FIELD'").collect()}
    wanted = sorted(set(at.values()))
    ids = {(r.structure, r.name): r.id for r in children.filter(F.col("structure").isin(wanted)).orderBy("ord").collect()}

    def link(what, relation, a, b, **more):
        out["mappings"].append({"id": name("mapping", what), "relation": relation, "sources": [a], "targets": [b], "cardinality": "one-to-one", "lossiness": "unknown", **more, "provenance": said})

    for c in whole:
        concept = name("concept", c["id"])
        source, target = at[c["id"], "source"], at[c["id"], "target"]
        out["entities"].append({"id": concept, "kind": "concept", "label": c["id"], "provenance": said})
        link(f"{c['id']}:implements:source", "core:implements", concept, source)
        link(f"{c['id']}:implements:target", "core:implements", concept, target)
        link(f"{c['id']}:structure", c.get("relation", "core:derives_from"), source, target)
        for p in c.get("fields", {}).get("pairs", []):
            if (c["id"], p["source"], p["target"]) not in missing:
                transform = {"transform": {"adapter": "declaration", "version": "1.0.0", "entrypoint": p["transform"], "deterministic": True}} if "transform" in p else {}
                link(f"{c['id']}:field:{p['source']}:{p['target']}", c.get("relation", "core:derives_from"), ids[source, p["source"]], ids[target, p["target"]], **transform)
        if "authority" in c:
            out["authorities"].append({"id": name("authority", c["id"]), "concept": concept, "source": at[c["id"], c["authority"]["side"]], "facts": c["authority"]["facts"], "mode": "canonical", "provenance": said})
    return out


def discover(spark: SparkSession, config: dict, base: str = ".", adapters: AdapterRegistry | None = None, use_cache: bool = True) -> Discovery:
    config, adapters = parse_config(config), adapters or default_registry()
    root = os.path.normpath(os.path.join(base, config["repositoryRoot"]))
    registry = all_packs()
    for path in config.get("relationPacks", []):
        with open(os.path.join(base, path), encoding="utf-8") as f:
            registry.register(*parse_pack(json.load(f)))
    context = Context(root, config["namespace"], config["repository"])
    cache = config["outputs"].get("cache") and "file://" + os.path.abspath(os.path.join(base, config["outputs"]["cache"]))
    shards, inputs, cached = [], [], []
    step = 1_000_000_000
    for k, source in enumerate(config["sources"]):
        rows, hit = discover_cached(spark, adapters.require(source["adapter"]), source, context, cache, use_cache)
        cached += [source["id"]] if hit else []
        shards.append(rows.withColumn("ord", F.col("ord") + F.lit(k * step)))
        inputs += [(source["id"], r.payload) for r in rows.filter("record = 'input'").select("payload").collect()]  # one for each file
    rows = shards[0]
    for part in shards[1:]:
        rows = rows.unionByName(part)
    rows = save(rows, "records")
    found = compose.compose([documents.graph_of(part, registry) for part in shards])
    added, drift = correspondences(found, config)
    drift = save(drift, "drift")
    own = documents.graph(spark, added, registry)
    whole = compose.compose([found, own])
    notes = rows.filter("record = 'diagnostic'").select(*[F.get_json_object("payload", f"$.{k}").alias(k) for k in ("severity", "code", "message")], F.col("path").alias("subject_id"))
    validation = save(validate.validate(whole), "validation")
    revision = value_digest({"config": config, "inputs": sorted(inputs)})
    snapshot = {"schemaVersion": "1.0.0", "id": config["id"], "revision": revision, "configDigest": value_digest(config), "inputs": [{"sourceId": s, **json.loads(p)} for s, p in sorted(inputs)], "counts": {"entities": whole.entities.count(), "mappings": whole.mappings.count(), "authorities": whole.authorities.count()}}
    return Discovery(config, whole, validation, drift, notes, snapshot, cached)


TABLES = ("entities", "mappings", "endpoints", "authorities", "facts")


def write_graph(g: Graph, place: str) -> None:
    for name in TABLES:
        getattr(g, name).write.mode("overwrite").parquet(f"{place}/{name}")


def read_graph(spark: SparkSession, place: str, registry: RelationRegistry | None = None) -> Graph:
    return Graph(*[spark.read.parquet(f"{place}/{name}") for name in TABLES], registry or all_packs())


def write_outputs(found: Discovery, base: str = ".") -> dict:
    """Write the four outputs; the graph as Parquet tables, the others as files."""
    place = {k: os.path.abspath(os.path.join(base, found.config["outputs"][k])) for k in OUTPUTS}
    write_graph(found.graph, "file://" + place["graph"])
    texts = {"snapshot": stable_json(found.snapshot), "report": report.drift_report(found.config["id"], found.validation, found.drift.unionByName(found.diagnostics)), "documentation": report.documentation(found.config["id"], found.graph)}
    for k, text in texts.items():
        os.makedirs(os.path.dirname(place[k]), exist_ok=True)
        with open(place[k], "w", encoding="utf-8") as f:
            f.write(text)
    return place


def check(spark: SparkSession, found: Discovery, base: str = ".") -> tuple[DataFrame, DataFrame | None]:
    """(issues against the committed graph, changes or None where there is none)."""
    place = os.path.abspath(os.path.join(base, found.config["outputs"]["graph"]))
    if not os.path.isdir(os.path.join(place, "entities")):
        rows = spark.createDataFrame([("error", "BASELINE_MISSING_OR_INVALID", "no graph was written", place)], "severity string, code string, message string, subject_id string")
        return rows, None
    changes = diff.diff(read_graph(spark, "file://" + place, found.graph.registry), found.graph)
    return diff.baseline_issues(changes, found.config.get("policy", {}).get("baselineChanges", "error")), changes
