"""Adapters: source files to graph records.

An adapter is a parser of one file's text and, where files depend on each other, DataFrame plans over
what the parsers observed. Files are read by Spark and parsed where they are read, so a large tree is
as many tasks. Records are rows (record, id, payload, ord, path), record being entity, mapping,
authority, input or diagnostic; documents.graph_of() turns them into a graph.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corrgraph.functions.canonical import value_digest
from corrgraph.functions.identifiers import AMBIGUOUS, PATTERN, repository_uri, route_path, urn
from corrgraph.plans.scratch import save
from corrgraph.sources import documents
from corrgraph.sources.documents import RECORD


@dataclass(frozen=True)
class Context:
    """Where a source lies and how its records are named."""

    root: str
    namespace: str
    repository: str


class Adapter(Protocol):
    id: str
    version: str

    def paths(self, config: dict, context: Context) -> list[str]:
        """The files it reads."""

    def discover(self, spark: SparkSession, config: dict, context: Context) -> DataFrame:
        """Its records."""


class AdapterRegistry:
    def __init__(self, adapters=()):
        self.known: dict[str, Adapter] = {}
        for a in adapters:
            self.register(a)

    def register(self, adapter: Adapter) -> None:
        if adapter.id in self.known:
            raise ValueError(f"adapter {adapter.id} is registered already")
        self.known[adapter.id] = adapter

    def get(self, name: str) -> Adapter | None:
        return self.known.get(name)

    def require(self, name: str) -> Adapter:
        if name not in self.known:
            raise ValueError(f"no adapter {name}; there are {', '.join(self.ids())}")
        return self.known[name]

    def ids(self) -> list[str]:
        return sorted(self.known)


class Writer:
    """Gathers the records of one file."""

    def __init__(self, adapter: str, version: str, config: dict, context: Context, path: str, text: str):
        self.config, self.context, self.path = config, context, path
        self.digest = "sha256:" + hashlib.sha256(text.encode()).hexdigest()
        self.adapter, self.rows, self.seen = adapter, [], set()
        self.observed = {"status": "observed", "assertedBy": f"adapter:{adapter}@{version}", "sourceRevision": self.digest}
        self.add("input", path, {"path": path, "digest": self.digest})

    def add(self, record: str, name: str | None, payload) -> None:
        self.rows.append((record, name, json.dumps(payload, ensure_ascii=False), len(self.rows), self.path))

    def name(self, kind: str, value: str) -> str:
        return urn(self.context.namespace, kind, value)

    def at(self, mark: str = "", kind: str = "text/plain") -> list[dict]:
        return [{"uri": repository_uri(self.context.repository, self.path) + mark, "mediaType": kind, "digest": self.digest}]

    def entity(self, kind: str, name: str, label: str, attributes: dict, locators: list | None = None, provenance: dict | None = None) -> str:
        if name not in self.seen:
            self.seen.add(name)
            self.add("entity", name, {"id": name, "kind": kind, "label": label, **({"locators": locators} if locators else {}), "attributes": attributes, "provenance": provenance or self.observed})
        return name

    def mapping(self, name: str, relation: str, sources: list[str], targets: list[str], lossiness: str = "lossless", **more) -> None:
        if sources and targets:
            self.add("mapping", name, {"id": name, "relation": relation, "sources": sources, "targets": targets, "cardinality": "one-to-one" if len(targets) == 1 else "one-to-many", "lossiness": lossiness, **more, "provenance": self.observed})

    def diagnose(self, code: str, message: str, severity: str = "error") -> None:
        self.add("diagnostic", code, {"severity": severity, "code": code, "message": message, "path": self.path})


def parsed(spark: SparkSession, adapter, config: dict, context: Context, paths: list[str]) -> DataFrame:
    """Records of the files, each parsed whole by adapter.parse(writer, text)."""
    if not paths:
        return spark.createDataFrame([], RECORD)
    root = os.path.abspath(context.root)
    full = [os.path.join(root, p) for p in paths]
    # file sources skip empty files, and read brackets as patterns
    texts = spark.createDataFrame([("file:" + p, bytearray()) for p in full if not os.path.getsize(p)], "path string, content binary")
    literal = [re.sub(r"([\[\]{}*?\\])", r"\\\1", "file://" + p) for p in full if os.path.getsize(p)]
    if literal:
        texts = texts.unionByName(spark.read.format("binaryFile").load(literal).select("path", "content"))

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                place, text = os.path.relpath(re.sub("^file:/+", "/", path), root), bytes(content).decode()
                w = Writer(adapter.id, adapter.version, config, context, place.replace("\\", "/"), text)
                adapter.parse(w, text)
                rows += w.rows
            yield pd.DataFrame(rows, columns=["record", "id", "payload", "ord", "path"])

    return texts.mapInPandas(run, RECORD)


class SingleFile:
    def paths(self, config, context):
        return [config["path"]]

    def discover(self, spark, config, context):
        return parsed(spark, self, config, context, self.paths(config, context))


class ShardAdapter(SingleFile):
    """A graph document as it is, held to its strict form."""

    id, version = "graph-shard", "1.0.0"

    def parse(self, w: Writer, text: str) -> None:
        document = json.loads(text)
        if found := documents.strict_issues(document):
            raise ValueError(f"{w.path}: " + "; ".join(f"{c} {p}" for c, p in found[:5]))
        w.rows += documents.rows_of(document, w.path)


def pointer(value, at: str):
    """What a JSON pointer leads to; None if nothing."""
    for part in at.split("/")[1:] if at else []:
        part = part.replace("~1", "/").replace("~0", "~")
        if isinstance(value, list):
            value = value[int(part)] if re.match(r"\d+", part) and int(part) < len(value) else None
        else:
            value = value.get(part) if isinstance(value, dict) else None
    return value


class JsonCollections(SingleFile):
    """Arrays of a JSON document: an entity for each item, mappings for what items refer to."""

    id, version = "json-collections", "1.0.0"

    def parse(self, w: Writer, text: str) -> None:
        c, document = w.config, json.loads(text)
        whole = w.entity("json-document", w.name("json-document", c["id"]), w.path, {"adapter": self.id, "sourceId": c["id"]}, w.at("", "application/json"))
        for part in c["collections"]:
            items = pointer(document, part["pointer"])
            if not isinstance(items, list):
                w.diagnose("JSON_COLLECTION_NOT_ARRAY", f"{part['pointer']} is no array")
                continue
            names = []
            for k, item in enumerate(items):
                name = item.get(part["idProperty"]) if isinstance(item, dict) else None
                if not isinstance(name, str):
                    w.diagnose("JSON_COLLECTION_ITEM_ID_MISSING", f"{part['pointer']}/{k} has no {part['idProperty']}")
                    continue
                label = item.get(part.get("labelProperty"))
                names.append(w.entity(part["entityKind"], w.name(part["entityKind"], f"{c['id']}:{name}"), label if isinstance(label, str) else name, {"adapter": self.id, "sourceId": c["id"], "name": name, "collection": part["pointer"], "order": k}, w.at(f"#{part['pointer']}/{k}", "application/json")))
                for r in part.get("references", []):
                    value = item.get(r["property"])
                    values = [value] if isinstance(value, str) else [v for v in value if isinstance(v, str)] if isinstance(value, list) else []
                    targets = [w.entity(r["targetKind"], w.name(r["targetKind"], v), v, {"name": v, "externalReference": True}, None, {"status": "inferred", "assertedBy": f"adapter:{self.id}@{self.version}"}) for v in values]
                    w.mapping(w.name("mapping", f"{c['id']}:{part['pointer']}:{name}:{r['property']}"), r.get("relation", "core:references"), [names[-1]], targets, attributes={"jsonProperty": r["property"]})
            w.mapping(w.name("mapping", f"{c['id']}:contains:{part['pointer']}"), "core:contains", [whole], names)


def is_legacy_catalogue(value) -> bool:
    """Whether a document is a legacy catalogue: entries with an id and a label, and paths and outputs that are texts."""
    entries = value.get("sourcesOfTruth") if isinstance(value, dict) else None
    texts = lambda x: isinstance(x, list) and all(isinstance(t, str) for t in x)
    return isinstance(entries, list) and all(isinstance(e, dict) and isinstance(e.get("id"), str) and isinstance(e.get("label"), str) and texts(e.get("paths")) and texts(e.get("outputs")) for e in entries)


class LegacyCatalogue(SingleFile):
    """A catalogue of concepts with paths and outputs; several paths leave ownership open."""

    id, version = "legacy-sources", "1.0.0"

    def parse(self, w: Writer, text: str) -> None:
        for entry in json.loads(text)["sourcesOfTruth"]:
            concept = w.entity("concept", w.name("concept", entry["id"]), entry.get("label", entry["id"]), {k: v for k, v in entry.items() if k not in ("id", "label")})
            paths = entry.get("paths", [])
            if len(paths) > 1:
                w.diagnose("LEGACY_MULTIPLE_SOURCES", f"{entry['id']} has {len(paths)} sources", "warning")
            for k, path in enumerate(paths):
                artifact = w.entity("artifact", w.name("legacy-artifact", path), path, {"rawPath": path}, [{"uri": repository_uri(w.context.repository, path)}])
                w.mapping(w.name("mapping", f"{entry['id']}:references:{k}"), "core:references", [concept], [artifact], "unknown")
                name = w.name("authority", f"{entry['id']}:{k}")
                w.add("authority", name, {"id": name, "concept": concept, "source": artifact, "facts": ["*"], "mode": "canonical" if len(paths) == 1 else "candidate", "provenance": w.observed})
                if re.search(AMBIGUOUS, path):
                    w.diagnose("LEGACY_AMBIGUOUS_PATH", f"{entry['id']}: {path}", "warning")
                if re.search(PATTERN, path):
                    w.diagnose("LEGACY_PATH_PATTERN", f"{entry['id']}: {path}", "warning")
            for k, output in enumerate(entry.get("outputs", [])):
                made = w.entity("projection", w.name("legacy-output", output), output, {"legacyDescription": output})
                w.mapping(w.name("mapping", f"{entry['id']}:generates:{k}"), "core:generates", [concept], [made], "unknown")
            if entry.get("specDoc"):
                spec = w.entity("specification", w.name("legacy-artifact", entry["specDoc"]), entry["specDoc"], {"rawPath": entry["specDoc"]}, [{"uri": repository_uri(w.context.repository, entry["specDoc"])}])
                w.mapping(w.name("mapping", f"{entry['id']}:specified-by"), "core:specified_by", [concept], [spec], "unknown")


#: Scalar types of schema files.
SCALARS = {"String": "string", "Int": "integer", "BigInt": "integer", "Float": "number", "Decimal": "number", "Boolean": "boolean", "DateTime": "datetime", "Json": "json", "Bytes": "bytes"}


def line_of(text: str, at: int) -> int:
    return text.count("\n", 0, at) + 1


class PrismaAdapter(SingleFile):
    """Models and enumerations of a schema file, with their fields and values."""

    id, version = "prisma", "1.0.0"

    def blocks(self, w: Writer, text: str):
        bare = re.sub(r'"(?:\\.|[^"\\\n])*"|//[^\n]*', lambda m: m[0] if m[0][0] == '"' else " " * len(m[0]), text)  # comments hold no brackets
        for m in re.finditer(r"^[ \t]*(model|enum)\s+([A-Za-z_]\w*)\s*\{", bare, re.M):
            end = balanced(bare, m.end() - 1)
            if bare[end - 1] != "}" or end - 1 < m.end():
                w.diagnose("PRISMA_UNCLOSED_BLOCK", f"{m[1]} {m[2]} is not closed")
                continue
            yield m[1], m[2], text[m.end() : end - 1], line_of(text, m.start()), line_of(text, m.end())

    def parse(self, w: Writer, text: str) -> None:
        source, found = w.config["id"], list(self.blocks(w, text))
        models, enums = ({n for k, n, *_ in found if k == kind} for kind in ("model", "enum"))
        for kind, name, body, line, first in found:
            mapped = re.search(r'@@map\("([^"]+)"\)', body)
            base = {"adapter": self.id, "sourceId": source}
            owner = w.entity(f"prisma-{kind}", w.name(f"prisma-{kind}", f"{source}:{name}"), name, {**base, "structureKind": kind, "name": name, "mappedName": mapped[1] if mapped else name}, w.at(f"#L{line}"))
            children = []
            for k, raw in enumerate(body.split("\n")):
                code = re.sub(r"//.*$", "", raw).strip()
                if not code or code.startswith("@@"):
                    continue
                common = {**base, "structureId": owner, "structureName": name}
                if kind == "enum":
                    m = re.match(r"([A-Za-z_]\w*)\b", code)
                    if m:
                        children.append(w.entity("prisma-enum-value", w.name("prisma-enum-value", f"{source}:{name}.{m[1]}"), f"{name}.{m[1]}", {**common, "name": m[1], "value": m[1]}, w.at(f"#L{first + k}")))
                    continue
                m = re.match(r"([A-Za-z_]\w*)\s+([A-Za-z_]\w*)(\[\])?(\?)?(.*)$", code)
                if not m:
                    continue
                native, rest = m[2], m[5]
                kind_of = f"enum:{native}" if native in enums else f"reference:{native}" if native in models else SCALARS.get(native, f"native:{native}")
                own = re.search(r'@map\("([^"]+)"\)', rest)
                facts = {"name": m[1], "mappedName": own[1] if own else m[1], "nativeType": native, "dataType": kind_of, "presenceRequired": True, "nullable": bool(m[4]), "cardinality": "many" if m[3] else "one", "relation": native in models, "id": "@id" in rest, "unique": "@unique" in rest, "hasDefault": "@default(" in rest}
                children.append(w.entity("prisma-field", w.name("prisma-field", f"{source}:{name}.{m[1]}"), f"{name}.{m[1]}", {**common, **facts}, w.at(f"#L{first + k}")))
            w.mapping(w.name("mapping", f"{source}:contains:{owner}"), "core:contains", [owner], children)


def balanced(text: str, at: int) -> int:
    """The place after the bracket that closes the one at a place; quotes are skipped."""
    depth, quote = 0, ""
    while at < len(text):
        c = text[at]
        if quote:
            if c == "\\":
                at += 1
            elif c == quote:
                quote = ""
        elif c in "\"'`":
            quote = c
        elif c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
            if not depth:
                return at + 1
        at += 1
    return at


def split_top(text: str) -> list[str]:
    """The parts of a list at its top-level commas."""
    out, at, start = [], 0, 0
    while at < len(text):
        if text[at] in "([{\"'`":
            if text[at] in "([{":
                at = balanced(text, at)
            else:
                m = re.compile(r"\\.|" + text[at]).search(text, at + 1)
                while m and m[0] != text[at]:
                    m = re.compile(r"\\.|" + text[at]).search(text, m.end())
                at = m.end() if m else len(text)
            continue
        if text[at] == ",":
            out.append(text[start:at])
            start = at + 1
        at += 1
    return [p.strip() for p in [*out, text[start:]] if p.strip()]


def zod_type(expression: str) -> str:
    """The data type of a schema expression."""
    e = expression.strip()
    if m := re.match(r"z\s*\.\s*array\s*\(", e):
        return "array:" + zod_type(e[m.end() : balanced(e, m.end() - 1) - 1])
    if m := re.match(r"z\s*\.\s*(?:lazy\s*\(\s*\(\)\s*=>\s*)?(\w+)", e):
        kind = m[1]
        if kind == "number":
            return "integer" if ".int(" in e else "number"
        return {"string": "datetime" if ".datetime(" in e else "string", "boolean": "boolean", "date": "datetime", "enum": "enum:inline", "bigint": "integer", "unknown": "unknown", "any": "unknown", "record": "json"}.get(kind, f"zod:{kind}")
    if m := re.match(r"(\w+)", e):
        name = m[1]
        return "string" if name.endswith("IdSchema") else "datetime" if name.endswith("DateTimeSchema") else f"reference:{name}"
    return "unknown"


class ZodAdapter:
    """Exported schemas of a source tree: objects with fields, enumerations with values, derived schemas."""

    id, version = "typescript-zod", "1.0.0"
    EXPORT = re.compile(r"export\s+const\s+(\w+)\s*(?::[^=]+)?=\s*")

    def paths(self, config, context):
        found = []
        for given in config["paths"] if "paths" in config else [config["path"]]:
            full = os.path.join(context.root, given)
            if os.path.isdir(full):
                for folder, _, names in os.walk(full):
                    found += [os.path.relpath(os.path.join(folder, n), context.root) for n in names if n.endswith((".ts", ".tsx")) and not n.endswith((".d.ts", ".test.ts"))]
            else:
                found.append(given)
        return sorted(found)

    def parse(self, w: Writer, text: str) -> None:
        source = w.config["id"]
        for m in self.EXPORT.finditer(text):
            end, at = m.end(), m.end()
            while at < len(text) and text[at] not in ";":
                if text[at] in "([{":
                    at = balanced(text, at)
                    end = at
                    continue
                if text[at] == "\n" and end > m.end() and not re.match(r"\s*\.", text[at:]):
                    break
                at += 1
            expression = text[m.end() : max(end, at)].strip()
            base = re.match(r"(\w+)\s*\.", expression)
            if not base or (base[1] != "z" and not base[1].endswith("Schema")):
                continue
            name, line = m[1], line_of(text, m.start())
            owner, kind = w.name("zod-schema", f"{source}:{name}"), "enum" if re.match(r"z\s*\.\s*(enum|nativeEnum)\b", expression) else "schema"
            common = {"adapter": self.id, "sourceId": source}
            w.entity(f"zod-{kind}", owner, name, {**common, "structureKind": kind, "name": name}, w.at(f"#L{line}"))
            children = []
            if kind == "enum":
                for v in re.findall(r"[\"']([^\"']+)[\"']", expression):
                    children.append(w.entity("zod-enum-value", w.name("zod-enum-value", f"{source}:{name}.{v}"), f"{name}.{v}", {**common, "structureId": owner, "structureName": name, "name": v, "value": v}, w.at(f"#L{line}")))
            for body in re.finditer(r"(?:z\s*\.\s*(?:object|strictObject)|\.\s*(?:extend|merge))\s*\(\s*\{", expression):
                inner = expression[body.end() : balanced(expression, body.end() - 1) - 1]
                for part in split_top(re.sub(r"//[^\n]*", "", inner)):
                    f = re.match(r"[\"']?(\w+)[\"']?\s*:\s*(.+)$", part, re.S)
                    if not f:
                        continue
                    field, e = f[1], f[2]
                    kind_of = zod_type(e)
                    facts = {"name": field, "dataType": kind_of.removeprefix("array:") if kind_of.startswith("array:") else kind_of, "presenceRequired": ".default(" in e or not re.search(r"\.(optional|nullish)\(", e), "nullable": bool(re.search(r"\.(nullable|nullish)\(", e)), "cardinality": "many" if kind_of.startswith("array:") else "one", "relation": False, "hasDefault": ".default(" in e}
                    children.append(w.entity("zod-field", w.name("zod-field", f"{source}:{name}.{field}"), f"{name}.{field}", {**common, "structureId": owner, "structureName": name, **facts}, w.at(f"#L{line}")))
            w.mapping(w.name("mapping", f"{source}:contains:{owner}"), "core:contains", [owner], children)
            if base[1] != "z":
                steps = re.findall(r"\.\s*(\w+)\s*\(", expression)
                w.mapping(w.name("mapping", f"{source}:derives:{name}:{base[1]}"), "core:derives_from", [owner], [w.name("zod-schema", f"{source}:{base[1]}")], "lossy" if {"pick", "omit"} & set(steps) else "lossless", attributes={"operations": steps})

    def discover(self, spark, config, context):
        rows = save(parsed(spark, self, config, context, self.paths(config, context)), "zod")
        twice = rows.filter("record = 'entity' AND get_json_object(payload, '$.attributes.structureKind') IS NOT NULL").groupBy("id").agg(F.count("*").alias("n"), F.min("path").alias("path")).filter("n > 1")
        payload = F.to_json(F.struct(F.lit("error").alias("severity"), F.lit("DUPLICATE_ZOD_SCHEMA_NAME").alias("code"), F.col("id").alias("message"), "path"))
        return rows.unionByName(twice.select(F.lit("diagnostic").alias("record"), F.lit("DUPLICATE_ZOD_SCHEMA_NAME").alias("id"), payload.alias("payload"), F.lit(0).cast("long").alias("ord"), "path"))


#: Roles of special files.
ROLES = {"page": "page", "layout": "container", "template": "container", "loading": "boundary", "error": "boundary", "global-error": "boundary", "not-found": "boundary", "default": "page", "route": "route"}
METHODS = ("GET", "POST", "PUT", "PATCH", "DELETE", "HEAD", "OPTIONS")


QUOTED_OR_COMMENT = re.compile(r"\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|//[^\n]*|/\*[\s\S]*?\*/")
IMPORT = re.compile(r"\bimport\s+(?:type\s+)?([^;'\"()]*?)\s*from\s*[\"']([^\"']+)[\"']")
MOUNT = re.compile(r"(?<![\w)])<((?:\w+\.)*\w*Provider)(?=[\s/>])")
MOUNTED = "array<struct<module:string,symbol:string,local:string,line:int,column:int>>"


def uncommented(text: str) -> str:
    """The text with blanks for comments, so places stay."""
    return QUOTED_OR_COMMENT.sub(lambda m: re.sub(r"[^\n]", " ", m[0]) if m[0][0] == "/" else m[0], text)


def imports(code: str, path: str) -> dict[str, tuple[str, str]]:
    """Local name to (module, exported name); a relative module is told from the root of the repository."""
    out = {}
    for m in IMPORT.finditer(code):
        module = os.path.normpath(os.path.join(os.path.dirname(path), m[2])) if m[2].startswith(".") else m[2]
        named = re.search(r"\{([^}]*)\}", m[1])
        for part in named[1].split(",") if named else []:
            words = re.findall(r"[\w$]+", part.removeprefix("type "))
            if words:
                out[words[-1]] = (module, words[0])
        for part in re.sub(r"\{[^}]*\}", "", m[1]).split(","):
            words = re.findall(r"[\w$*]+", part)
            if words:
                out[words[-1]] = (module, "*" if words[0] == "*" else "default")
    return out


def mounts(code: str, path: str) -> list[dict]:
    """Providers that a file mounts, each where it stands; one that is not imported is the file's own."""
    known, out = imports(code, path), []
    for m in MOUNT.finditer(code):
        first, _, rest = m[1].partition(".")
        module, exported = known.get(first, (path, first))
        symbol = rest if exported == "*" and rest else exported + (f".{rest}" if rest else "")
        out.append({"module": module, "symbol": symbol, "local": m[1], "line": line_of(code, m.start()), "column": m.start() - code.rfind("\n", 0, m.start())})
    return out


class AppRouterAdapter:
    """An application tree of special files: segments, outlets, pages, containers, boundaries, routes, endpoints, contexts.

    Files are observed one by one; what contains or wraps what follows from their folders: ancestors are
    exploded and joined by equality, and a page's containers are ordered by depth in a window.
    """

    id, version = "nextjs-app-router", "1.1.0"
    EXCLUDED = ("node_modules", ".git")

    def paths(self, config, context):
        found = []
        for folder, inner, names in os.walk(os.path.join(context.root, config["path"])):
            inner[:] = [x for x in inner if x not in self.EXCLUDED]
            found += [os.path.relpath(os.path.join(folder, n), context.root) for n in names if n.rsplit(".", 1)[0] in ROLES and n.endswith((".tsx", ".ts", ".jsx", ".js"))]
        return sorted(found)

    def parse(self, w: Writer, text: str) -> None:
        base = w.config["path"].rstrip("/")
        inside = os.path.relpath(w.path, base).replace("\\", "/")
        folder, stem = os.path.dirname(inside), os.path.basename(inside).rsplit(".", 1)[0]
        text = uncommented(text)
        methods = sorted(set(re.findall(r"export\s+(?:async\s+)?(?:function|const)\s+(" + "|".join(METHODS) + r")\b", text)))
        providers = mounts(text, w.path)
        loaders = sorted(set(re.findall(r"\b(fetch|useQuery|useSWR|useInfiniteQuery)\s*\(", text)))
        seen = {"folder": folder, "stem": stem, "role": ROLES[stem], "methods": methods, "providers": providers, "loaders": loaders, "client": bool(re.match(r"\s*[\"']use client[\"']", text))}
        if stem == "route" and not methods:
            w.diagnose("NEXT_ROUTE_METHOD_MISSING", f"{w.path} exports no method")
        w.add("observed", w.path, seen)

    def discover(self, spark, config, context):
        source, excluded = config["id"], [x["path"] for x in config.get("exclusions", [])]
        raw = save(parsed(spark, self, config, context, self.paths(config, context)), "observed")
        files = raw.filter("record = 'observed'").select("path", F.from_json("payload", "folder string, stem string, role string, methods array<string>, providers " + MOUNTED + ", loaders array<string>, client boolean").alias("x")).select("path", "x.*")
        asked = spark.createDataFrame([(p,) for p in excluded], "path string")
        twice = asked.groupBy("path").count().filter("count > 1").select("path", F.lit("DUPLICATE_TOPOLOGY_EXCLUSION").alias("code"))
        stale = asked.distinct().join(files.select("path"), "path", "left_anti").select("path", F.lit("STALE_TOPOLOGY_EXCLUSION").alias("code"))
        problems = twice.unionByName(stale).select(F.lit("diagnostic").alias("record"), F.col("code").alias("id"), F.to_json(F.struct(F.lit("error").alias("severity"), "code", F.col("path").alias("message"), "path")).alias("payload"), F.lit(0).cast("long").alias("ord"), "path")
        out_of = F.broadcast(asked.distinct().withColumn("out", F.lit(True)))
        files = save(files.join(out_of, "path", "left").withColumn("out", F.coalesce("out", F.lit(False))), "files")
        name = lambda kind, value: F.concat(F.lit(f"urn:{context.namespace}:{kind}:{source}%3A"), F.url_encode(value))
        provenance = F.struct(F.lit("observed").alias("status"), F.lit(f"adapter:{self.id}@{self.version}").alias("assertedBy"))

        def entity(df, kind, ident, label, **attributes):
            body = F.struct(F.lit(self.id).alias("adapter"), F.lit(source).alias("sourceId"), *[v.alias(k) for k, v in attributes.items()])
            payload = F.to_json(F.struct(ident.alias("id"), F.lit(kind).alias("kind"), label.alias("label"), body.alias("attributes"), provenance.alias("provenance")))
            return df.select(F.lit("entity").alias("record"), ident.alias("id"), payload.alias("payload"), F.lit(0).cast("long").alias("ord"), F.col("path")).dropDuplicates(["id"])

        def link(df, relation, ident, sources, targets):
            size = F.when(F.size(targets) == 1, "one-to-one").otherwise("one-to-many")
            payload = F.to_json(F.struct(ident.alias("id"), F.lit(relation).alias("relation"), sources.alias("sources"), targets.alias("targets"), size.alias("cardinality"), F.lit("lossless").alias("lossiness"), provenance.alias("provenance")))
            return df.select(F.lit("mapping").alias("record"), ident.alias("id"), payload.alias("payload"), F.lit(0).cast("long").alias("ord"), F.col("path"))

        parts = F.filter(F.split("folder", "/"), lambda s: s != "")
        prefixes = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
        segments = files.select("path", F.explode(prefixes).alias("folder")).groupBy("folder").agg(F.min("path").alias("path"))
        parent = F.regexp_replace("folder", "/?[^/]*$", "")
        segment = lambda c: name("segment", F.concat(F.lit("/"), c))
        own = lambda kind: name(kind, F.col("path"))
        of = lambda role: files.filter(F.col("role") == role)
        pages, containers, boundaries, routes = of("page"), of("container"), of("boundary"), of("route")
        app = spark.createDataFrame([(source,)], "path string")
        app_id = F.lit(urn(context.namespace, "application", source))
        out = [raw.filter("record IN ('input', 'diagnostic')"), problems, entity(app, "topology:application", app_id, F.lit(source))]
        out.append(entity(segments, "topology:segment", segment(F.col("folder")), F.concat(F.lit("/"), F.col("folder")), urlPath=route_path(F.col("folder"))))
        out.append(link(segments.filter("folder = ''"), "topology:contains", name("mapping", F.lit("root")), F.array(app_id), F.array(segment(F.col("folder")))))
        # a folder @name is an outlet of the folder above, and its segment is inside the outlet
        last = F.regexp_extract("folder", "[^/]*$", 0)
        slotted, below = segments.filter(last.startswith("@")), segments.filter("folder <> ''")
        outlet = name("outlet", F.concat(F.lit("/"), "folder"))
        out.append(entity(slotted, "topology:outlet", outlet, F.expr("substring(regexp_extract(folder, '[^/]*$', 0), 2)"), routePath=route_path(parent)))
        out.append(link(slotted, "topology:contains", name("mapping", F.concat(F.lit("outlet:"), "folder")), F.array(segment(parent)), F.array(outlet)))
        inside = F.when(last.startswith("@"), outlet).otherwise(segment(parent))
        out.append(link(below, "topology:contains", name("mapping", F.concat(F.lit("segment:"), "folder")), F.array(inside), F.array(segment(F.col("folder")))))
        route_id = name("route", route_path(F.col("folder")))
        disposition = F.when(F.col("out"), "excluded")
        for rows, kind, urn_kind in ((pages, "topology:page", "page"), (containers, "topology:container", "container"), (boundaries, "topology:boundary", "boundary")):
            out.append(entity(rows, kind, own(urn_kind), F.col("path"), file=F.col("path"), stem=F.col("stem"), client=F.col("client"), topologyDisposition=disposition))
            out.append(link(rows, "topology:contains", name("mapping", F.concat(F.lit(f"in:{urn_kind}:"), "path")), F.array(segment(F.col("folder"))), F.array(own(urn_kind))))
            client, hydration = rows.filter("client"), own("hydration-boundary")
            out.append(entity(client, "topology:hydration-boundary", hydration, F.concat(F.lit("Hydration boundary for "), "path"), file=F.col("path")))
            out.append(link(client, "topology:contains", name("mapping", F.concat(F.lit("in:hydration:"), "path")), F.array(segment(F.col("folder"))), F.array(hydration)))
            out.append(link(client, "topology:hydrates", name("mapping", F.concat(F.lit("hydrates:"), "path")), F.array(hydration), F.array(own(urn_kind))))
        live = pages.filter("stem = 'page'")
        out.append(entity(live, "routing:route", route_id, route_path(F.col("folder")), path=route_path(F.col("folder"))))
        out.append(link(live, "topology:implemented_by", name("mapping", F.concat(F.lit("implemented:"), "path")), F.array(route_id), F.array(own("page"))))
        # a route, a handler and an endpoint for each method
        called = routes.select("path", "folder", F.explode("methods").alias("method"))
        where = route_path(F.col("folder"))
        verb = lambda kind, of: name(kind, F.concat("method", F.lit(" "), of))
        surface, handler, endpoint = verb("route", where), verb("handler", F.col("path")), verb("endpoint", where)
        out.append(entity(called, "routing:route", surface, where, path=where, method=F.col("method"), topologySurface=F.lit("route-handler")))
        out.append(entity(called, "routing:handler", handler, F.concat("method", F.lit(" handler")), file=F.col("path"), method=F.col("method")))
        out.append(entity(called, "routing:endpoint", endpoint, F.concat("method", F.lit(" "), where), path=where, method=F.col("method")))
        for relation, word, source_of, target_of in (("topology:contains", "in:route", segment(F.col("folder")), surface), ("routing:handled_by", "handled", surface, handler), ("routing:exposed_as", "exposed", surface, endpoint)):
            out.append(link(called, relation, verb("mapping", F.concat(F.lit(f"{word}:"), "path")), F.array(source_of), F.array(target_of)))
        out.append(link(boundaries, "topology:fallback_for", name("mapping", F.concat(F.lit("fallback:"), "path")), F.array(own("boundary")), F.array(segment(F.col("folder")))))
        token = r"^\[{1,2}(?:\.\.\.)?([^\]]+)\]{1,2}$"
        dynamic = F.filter(parts, lambda s: s.rlike(token))
        shaped = live.withColumn("tokens", dynamic).filter(F.size("tokens") > 0)
        shape_id = name("parameters", route_path(F.col("folder")))
        fields = F.transform("tokens", lambda s: F.struct(F.regexp_extract(s, token, 1).alias("name"), F.when(s.contains("..."), "many").otherwise("one").alias("cardinality"), s.startswith("[[").alias("optional")))
        out.append(entity(shaped, "routing:schema", shape_id, F.concat(route_path(F.col("folder")), F.lit(" parameters")), parameters=fields))
        out.append(link(shaped.dropDuplicates(["folder"]), "topology:parameterized_by", name("mapping", F.concat(F.lit("parameters:"), "folder")), F.array(route_id), F.array(shape_id)))
        used = containers.unionByName(live).filter(F.size("providers") > 0).select("path", "role", F.inline("providers"))
        host = F.when(F.col("role") == "page", own("page")).otherwise(own("container"))
        spot = F.concat("path", F.lit(":"), "module", F.lit(":"), "symbol", F.lit(":"), F.col("line").cast("string"), F.lit(":"), F.col("column").cast("string"))
        provider, shared = name("provider", spot), name("context", F.concat("module", F.lit(":"), "symbol"))
        out.append(entity(used, "topology:context-provider", provider, F.col("local"), module=F.col("module"), symbol=F.col("symbol"), file=F.col("path"), line=F.col("line"), column=F.col("column")))
        out.append(link(used, "topology:hosts_provider", name("mapping", F.concat(F.lit("hosts:"), spot)), F.array(host), F.array(provider)))
        contexts = used.groupBy("module", "symbol").agg(F.min(F.struct("path", "local")).alias("x")).select("module", "symbol", "x.*")
        out.append(entity(contexts, "topology:context", shared, F.regexp_replace("local", r"\.?Provider$", ""), module=F.col("module"), symbol=F.col("symbol")))
        out.append(link(used, "topology:provides_context", name("mapping", F.concat(F.lit("provides:"), spot)), F.array(provider), F.array(shared)))
        fetched = live.filter(F.size("loaders") > 0).select("path", F.explode("loaders").alias("p"))
        out.append(entity(fetched, "topology:loader", name("loader", F.concat("path", F.lit("#"), "p")), F.col("p")))
        out.append(link(fetched, "topology:loads", name("mapping", F.concat(F.lit("loads:"), "path", F.lit(":"), "p")), F.array(own("page")), F.array(name("loader", F.concat("path", F.lit("#"), "p")))))
        # containers of the folders above a page, outermost first; in one folder a layout wraps a template
        above = live.select(F.col("path").alias("page"), F.explode(prefixes).alias("folder"))
        rank = Window.partitionBy("page").orderBy(F.length("folder"), "folder", F.when(F.col("stem") == "layout", 0).otherwise(1), "path")
        chain = above.join(containers.select("folder", "stem", "path"), "folder").withColumn("outer", F.lag("path").over(rank)).withColumn("last", F.lead("path").over(rank).isNull())
        wraps = chain.filter("outer IS NOT NULL").select(F.col("outer").alias("path"), F.col("path").alias("inner")).distinct()
        out.append(link(wraps, "topology:wraps", name("mapping", F.concat(F.lit("wraps:"), "path", F.lit(":"), "inner")), F.array(own("container")), F.array(name("container", F.col("inner")))))
        out.append(link(chain.filter("last").select("path", "page"), "topology:rendered_in", name("mapping", F.concat(F.lit("rendered:"), "page")), F.array(name("page", F.col("page"))), F.array(own("container"))))
        rows = out[0]
        for part in out[1:]:
            rows = rows.unionByName(part)
        return rows


def default_registry() -> AdapterRegistry:
    return AdapterRegistry([JsonCollections(), LegacyCatalogue(), ShardAdapter(), AppRouterAdapter(), PrismaAdapter(), ZodAdapter()])


def fingerprint(adapter: Adapter, config: dict, context: Context) -> str:
    """A key that changes with the adapter, its configuration and its inputs' content."""
    inputs = []
    for path in adapter.paths(config, context):
        with open(os.path.join(context.root, path), "rb") as f:
            inputs.append({"path": path, "digest": "sha256:" + hashlib.sha256(f.read()).hexdigest()})
    return value_digest({"adapter": adapter.id, "version": adapter.version, "config": config, "inputs": inputs})


def discover_cached(spark: SparkSession, adapter: Adapter, config: dict, context: Context, cache: str | None, use_cache: bool = True) -> tuple[DataFrame, bool]:
    """Records, and whether they came from the cache. A Parquet table for each key; written even if not read."""
    key = fingerprint(adapter, config, context)
    place = cache and f"{cache.rstrip('/')}/{config['id']}/{key.removeprefix('sha256:')}"
    if place and use_cache and os.path.exists(os.path.join(place.removeprefix("file://"), "_SUCCESS")):
        return spark.read.schema(RECORD).parquet(place), True
    rows = adapter.discover(spark, config, context)
    if not place:
        return save(rows, "records"), False
    rows.write.mode("overwrite").parquet(place)
    return spark.read.schema(RECORD).parquet(place), False
