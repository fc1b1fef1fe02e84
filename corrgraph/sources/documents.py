"""Graph documents: shape rules, and the way between JSON and DataFrames.

Shards are parsed where they are read, one row per record, so a thousand shards load as one job.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corrgraph.functions.identifiers import is_reference_identifier, is_relation_identifier
from corrgraph.functions.relations import CARDINALITIES, RelationRegistry, all_packs
from corrgraph.operators.graph import Graph
from corrgraph.plans.scratch import save

VERSION = "2.0.0"
LOSSINESS = ("lossless", "lossy", "unknown")
STATUSES = ("declared", "observed", "generated", "inferred")
MODES = ("canonical", "delegated", "candidate")

RECORD = "record string, id string, payload string, ord long, path string"
PROVENANCE = "struct<status:string,assertedBy:string,observedAt:string,sourceRevision:string,confidence:double>"
ENTITY_JSON = f"id string, kind string, label string, schema string, locators array<struct<uri:string,mediaType:string,revision:string,digest:string>>, provenance {PROVENANCE}"
MAPPING_JSON = f"id string, relation string, sources array<string>, targets array<string>, cardinality string, lossiness string, provenance {PROVENANCE}"
AUTHORITY_JSON = f"id string, concept string, source string, facts array<string>, mode string, delegatedFrom string, provenance {PROVENANCE}"


def filled(value) -> bool:
    return isinstance(value, str) and bool(value)


class Shape:
    """Collects (code, path) of what a document's shape breaks."""

    def __init__(self):
        self.found: list[tuple[str, str]] = []

    def want(self, good: bool, code: str, path: str) -> bool:
        if not good:
            self.found.append((code, path))
        return good

    def strings(self, value, path: str, identifiers: bool = True) -> None:
        if not self.want(isinstance(value, list), "EXPECTED_ARRAY", path):
            return
        self.want(bool(value), "EMPTY_ARRAY", path)
        for k, v in enumerate(value):
            if self.want(filled(v), "EXPECTED_STRING", f"{path}/{k}") and identifiers:
                self.want(is_reference_identifier(v), "INVALID_IDENTIFIER", f"{path}/{k}")

    def provenance(self, value, path: str) -> None:
        if not self.want(isinstance(value, dict), "INVALID_PROVENANCE", path):
            return
        self.want(value.get("status") in STATUSES, "INVALID_PROVENANCE_STATUS", f"{path}/status")
        self.want(filled(value.get("assertedBy")), "INVALID_ASSERTER", f"{path}/assertedBy")
        if "confidence" in value:
            c = value["confidence"]
            self.want(isinstance(c, int | float) and not isinstance(c, bool) and 0 <= c <= 1, "INVALID_CONFIDENCE", f"{path}/confidence")

    def packs(self, value) -> None:
        if not self.want(isinstance(value, list), "EXPECTED_ARRAY", "$/relationPacks"):
            return
        for k, p in enumerate(value):
            path = f"$/relationPacks/{k}"
            if self.want(isinstance(p, dict), "INVALID_RELATION_PACK_REFERENCE", path):
                self.want(is_reference_identifier(p.get("id")), "INVALID_IDENTIFIER", f"{path}/id")
                self.want(filled(p.get("version")), "INVALID_RELATION_PACK_VERSION", f"{path}/version")

    def entity(self, e, path: str) -> None:
        if not self.want(isinstance(e, dict), "INVALID_ENTITY", path):
            return
        self.want(is_reference_identifier(e.get("id")), "INVALID_ENTITY_ID", f"{path}/id")
        self.want(filled(e.get("kind")), "INVALID_ENTITY_KIND", f"{path}/kind")
        if "locators" in e and self.want(isinstance(e["locators"], list), "EXPECTED_ARRAY", f"{path}/locators"):
            for k, at in enumerate(e["locators"]):
                self.want(isinstance(at, dict) and is_reference_identifier(at.get("uri")), "INVALID_LOCATOR", f"{path}/locators/{k}")
        self.want(isinstance(e.get("attributes", {}), dict), "INVALID_ATTRIBUTES", f"{path}/attributes")
        if "provenance" in e:
            self.provenance(e["provenance"], f"{path}/provenance")

    def mapping(self, m, path: str) -> None:
        if not self.want(isinstance(m, dict), "INVALID_MAPPING", path):
            return
        self.want(is_reference_identifier(m.get("id")), "INVALID_MAPPING_ID", f"{path}/id")
        self.want(is_relation_identifier(m.get("relation")), "INVALID_RELATION_ID", f"{path}/relation")
        for side in ("sources", "targets"):
            self.strings(m.get(side), f"{path}/{side}")
        self.want(m.get("cardinality") in CARDINALITIES, "INVALID_CARDINALITY", f"{path}/cardinality")
        self.want(m.get("lossiness") in LOSSINESS, "INVALID_LOSSINESS", f"{path}/lossiness")
        self.provenance(m.get("provenance"), f"{path}/provenance")

    def authority(self, a, path: str) -> None:
        if not self.want(isinstance(a, dict), "INVALID_AUTHORITY", path):
            return
        for k in ("id", "concept", "source"):
            self.want(is_reference_identifier(a.get(k)), "INVALID_IDENTIFIER", f"{path}/{k}")
        self.strings(a.get("facts"), f"{path}/facts", False)
        self.want(a.get("mode") in MODES, "INVALID_AUTHORITY_MODE", f"{path}/mode")
        if a.get("mode") == "delegated":
            self.want(is_reference_identifier(a.get("delegatedFrom")), "INVALID_DELEGATION_PARENT", f"{path}/delegatedFrom")
        else:
            self.want("delegatedFrom" not in a, "UNEXPECTED_DELEGATION_PARENT", f"{path}/delegatedFrom")
        self.provenance(a.get("provenance"), f"{path}/provenance")


def shape_issues(value) -> list[tuple[str, str]]:
    """(code, path) of every rule of shape that a document breaks; semantic rules apply only to documents without any."""
    s = Shape()
    if not s.want(isinstance(value, dict), "INVALID_DOCUMENT", "$"):
        return s.found
    s.want(value.get("schemaVersion") == VERSION, "UNSUPPORTED_SCHEMA_VERSION", "$/schemaVersion")
    s.want(is_reference_identifier(value.get("id")), "INVALID_DOCUMENT_ID", "$/id")
    s.want(filled(value.get("namespace")), "INVALID_NAMESPACE", "$/namespace")
    if "relationPacks" in value:
        s.packs(value["relationPacks"])
    for field, check in (("entities", s.entity), ("mappings", s.mapping), ("authorities", s.authority)):
        if s.want(isinstance(value.get(field), list), "EXPECTED_ARRAY", f"$/{field}"):
            for k, item in enumerate(value[field]):
                check(item, f"$/{field}/{k}")
    return s.found


#: Members that the strict form allows; anything else is refused when a shard is read.
MEMBERS = {
    "document": {"$schema", "schemaVersion", "id", "namespace", "label", "revision", "relationPacks", "entities", "mappings", "authorities", "metadata", "extensions"},
    "entities": {"id", "kind", "label", "schema", "locators", "attributes", "provenance"},
    "mappings": {"id", "relation", "sources", "targets", "cardinality", "lossiness", "transform", "invariants", "attributes", "provenance"},
    "authorities": {"id", "concept", "source", "facts", "mode", "delegatedFrom", "provenance"},
}


def strict_issues(value) -> list[tuple[str, str]]:
    """Shape issues, and UNEXPECTED_MEMBER and REPEATED_ITEM of the closed form."""
    found = shape_issues(value)
    if not isinstance(value, dict):
        return found
    found += [("UNEXPECTED_MEMBER", f"$/{k}") for k in value if k not in MEMBERS["document"]]
    for field in ("entities", "mappings", "authorities"):
        for n, item in enumerate(value.get(field) if isinstance(value.get(field), list) else []):
            if isinstance(item, dict):
                found += [("UNEXPECTED_MEMBER", f"$/{field}/{n}/{k}") for k in item if k not in MEMBERS[field]]
                found += [("REPEATED_ITEM", f"$/{field}/{n}/{k}") for k in ("sources", "targets", "facts") if isinstance(item.get(k), list) and len(set(map(str, item[k]))) < len(item[k])]
    return found


def rows_of(document: dict, path: str = "", shard: int = 0) -> list[tuple]:
    """(record, id, payload, ord, path) of a document's records."""
    step = 1_000_000_000
    out = []
    for record, field in (("entity", "entities"), ("mapping", "mappings"), ("authority", "authorities")):
        for k, item in enumerate(document.get(field, [])):
            out.append((record, item.get("id"), json.dumps(item, ensure_ascii=False, sort_keys=True), shard * step + k, path))
    return out


def records(spark: SparkSession, document: dict) -> DataFrame:
    return spark.createDataFrame(rows_of(document), RECORD)


def read_shards(spark: SparkSession, paths: list[str] | str, strict: bool = True) -> DataFrame:
    """Records of every document under the paths; those that break the strict form raise with the first findings."""
    texts = spark.read.text(paths, wholetext=True).select(F.input_file_name().alias("path"), F.col("value"))

    def parse(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for path, text in zip(pdf["path"], pdf["value"], strict=True):
                try:
                    document = json.loads(text)
                except ValueError as why:
                    out.append(("issue", None, json.dumps(["INVALID_DOCUMENT", str(why)]), 0, path))
                    continue
                found = strict_issues(document) if strict else shape_issues(document)
                out += [("issue", None, json.dumps(x), 0, path) for x in found] or rows_of(document, path)
            yield pd.DataFrame(out, columns=["record", "id", "payload", "ord", "path"])

    out = save(texts.mapInPandas(parse, RECORD), "shards")
    bad = out.filter("record = 'issue'").limit(5).collect()
    if bad:
        raise ValueError("; ".join(f"{r.path}: {' '.join(json.loads(r.payload))}" for r in bad))
    return out


def graph_of(rows: DataFrame, registry: RelationRegistry | None = None) -> Graph:
    """The graph of records: headers, and endpoints and facts as rows of their own."""
    parsed = lambda record, schema: rows.filter(F.col("record") == record).select("ord", "payload", F.from_json("payload", schema).alias("x"))
    raw = lambda name: F.get_json_object("payload", f"$.{name}").alias(name)
    e, m, a = parsed("entity", ENTITY_JSON), parsed("mapping", MAPPING_JSON), parsed("authority", AUTHORITY_JSON)
    more = lambda *names: F.map_filter(F.create_map(*[c for n in names for c in (F.lit(n), F.get_json_object("payload", f"$.{n}"))]), lambda _, v: v.isNotNull()).alias("more")
    entities = e.select("x.id", "x.kind", "x.label", raw("attributes"), F.coalesce(F.transform("x.locators", lambda u: u["uri"]), F.array().cast("array<string>")).alias("locators"), "ord", more("schema", "locators", "provenance"))
    mappings = m.select("x.id", "x.relation", "x.cardinality", "x.lossiness", raw("transform"), F.col("x.provenance.status").alias("status"), raw("attributes"), "ord", more("invariants", "provenance"))
    side = lambda s: m.select(F.col("x.id").alias("mapping_id"), F.lit(s).alias("side"), F.posexplode(f"x.{s}s").alias("pos", "entity_id")).withColumn("pos", F.col("pos").cast("long"))
    authorities = a.select("x.id", "x.concept", "x.source", "x.mode", F.col("x.delegatedFrom").alias("delegated_from"), "ord", more("provenance"))
    facts = a.select(F.col("x.id").alias("authority_id"), F.explode("x.facts").alias("fact"))
    return Graph(entities, mappings, side("source").unionByName(side("target")), authorities, facts, registry or all_packs())


def graph(spark: SparkSession, document: dict, registry: RelationRegistry | None = None) -> Graph:
    return graph_of(records(spark, document), registry)


def validated_graph(spark: SparkSession, document: dict, registry: RelationRegistry | None = None) -> Graph:
    """The graph of a document without errors; others raise with the first findings."""
    wrong = [(code, what) for severity, code, what in validate_document(spark, document, registry) if severity == "error"]
    if wrong:
        raise ValueError("; ".join(f"{code} {what}" for code, what in wrong[:5]))
    return graph(spark, document, registry)


def validate_document(spark: SparkSession, document, registry: RelationRegistry | None = None) -> list[tuple[str, str, str | None]]:
    """(severity, code, subject or path): shape first; semantic rules only if the shape is sound."""
    from corrgraph.operators import validate

    shape = shape_issues(document)
    if shape:
        return [("error", code, path) for code, path in shape]
    registry = registry or all_packs()
    packs = [("error", "UNAVAILABLE_RELATION_PACK", p["id"]) for p in document.get("relationPacks", []) if not registry.has_pack(p["id"], p["version"])]
    found = validate.validate(graph(spark, document, registry)).orderBy("code", "subject_id").collect()
    return packs + [(r.severity, r.code, r.subject_id) for r in found]


def evidence_of(spark: SparkSession, policy: dict) -> DataFrame:
    """(id, subject, kind, result, confidence): a row for each subject of a policy's evidence."""
    rows = [(e["id"], s, e["kind"], e["result"], float(e["confidence"]) if "confidence" in e else None) for e in policy.get("evidence", []) for s in e["subjects"]]
    return spark.createDataFrame(rows, "id string, subject string, kind string, result string, confidence double")
