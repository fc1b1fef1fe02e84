"""Adapters on small files: what they find, and what they complain about."""

import json

import pytest

from corrgraph.sources import adapters, documents

PRISMA = """
// model Ghost { }
enum Berth { NORTH SOUTH }
enum Cargo {
  GRAIN   // loose }
  @@map("cargo_kind")
  STEEL @map("st")
}
model Vessel {
  imo      BigInt   @id
  name     String   @unique @default("{none}")
  draught  Decimal?
  built    DateTime
  papers   Json
  calls    Call[]   // what it's done: {
}
model Call {
  vessel   Vessel @relation(fields: [vesselImo], references: [imo])
  cargo    Cargo?
  weights  Float[]
  flag     Colour
}
model Adrift {
  x Int
"""
ZOD = """
export const CargoSchema = z.enum(["GRAIN", 'STEEL']);
export const CallSchema = z.strictObject({
  vessel: VesselIdSchema,
  arrived: z.string().datetime().nullish(),
  weights: z.array(z.number()).default([]),
  "notes": z.record(z.string(), z.unknown()), // keys, and "values"
  crew: z.array(CrewSchema),
  cargo: CargoSchema.optional().nullable(),
});
export const ArrivalSchema = CallSchema.pick({ vessel: true, arrived: true });
export const LongCallSchema = CallSchema.extend({ days: z.bigint() });
const inner = z.object({ lost: z.any() });
export const limit = 3;
"""


def found(spark, tmp_path, adapter, config, files):
    for name, text in files.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    rows = adapter.discover(spark, {"id": "src", **config}, adapters.Context(str(tmp_path), "t", "repo")).collect()
    by = {}
    for r in rows:
        by.setdefault(r.record, []).append(json.loads(r.payload))
    return by


def names(by, kind):
    return sorted(e["label"] for e in by["entity"] if e["kind"] == kind)


def fields_of(by, name):
    return {e["attributes"]["name"]: e["attributes"] for e in by["entity"] if e["attributes"].get("structureName") == name and "dataType" in e["attributes"]}


def test_prisma(spark, tmp_path):
    by = found(spark, tmp_path, adapters.PrismaAdapter(), {"path": "port.prisma"}, {"port.prisma": PRISMA})
    assert names(by, "prisma-model") == ["Call", "Vessel"] and names(by, "prisma-enum") == ["Berth", "Cargo"]
    assert names(by, "prisma-enum-value") == ["Berth.NORTH", "Cargo.GRAIN", "Cargo.STEEL"]
    vessel, call = fields_of(by, "Vessel"), fields_of(by, "Call")
    assert {k: v["dataType"] for k, v in vessel.items()} == {"imo": "integer", "name": "string", "draught": "number", "built": "datetime", "papers": "json", "calls": "reference:Call"}
    assert vessel["imo"]["id"] and vessel["name"]["unique"] and vessel["name"]["hasDefault"] and vessel["draught"]["nullable"] and not vessel["built"]["nullable"]
    assert vessel["calls"]["relation"] and vessel["calls"]["cardinality"] == "many" and call["vessel"]["relation"] and call["vessel"]["cardinality"] == "one"
    assert call["cargo"]["dataType"] == "enum:Cargo" and call["weights"]["cardinality"] == "many" and call["flag"]["dataType"] == "native:Colour"
    assert next(e for e in by["entity"] if e["label"] == "Cargo")["attributes"]["mappedName"] == "cargo_kind"
    assert [d["code"] for d in by["diagnostic"]] == ["PRISMA_UNCLOSED_BLOCK"]
    graph = documents.graph_of(spark.createDataFrame([("entity", e["id"], json.dumps(e), 0, "") for e in by["entity"]] + [("mapping", m["id"], json.dumps(m), 0, "") for m in by["mapping"]], documents.RECORD))
    from corrgraph.operators import validate

    assert validate.is_valid(validate.validate(graph))


def test_zod(spark, tmp_path):
    by = found(spark, tmp_path, adapters.ZodAdapter(), {"paths": ["web"]}, {"web/port.ts": ZOD, "web/deep/again.tsx": "export const CargoSchema = z.enum(['OIL']);\n", "web/port.test.ts": "export const TestSchema = z.object({});\n"})
    call = fields_of(by, "CallSchema")
    assert {k: (v["dataType"], v["cardinality"], v["presenceRequired"], v["nullable"]) for k, v in call.items()} == {
        "vessel": ("string", "one", True, False), "arrived": ("datetime", "one", False, True), "weights": ("number", "many", True, False),
        "notes": ("json", "one", True, False), "crew": ("reference:CrewSchema", "many", True, False), "cargo": ("reference:CargoSchema", "one", False, True),
    }
    assert names(by, "zod-schema") == ["ArrivalSchema", "CallSchema", "LongCallSchema"] and fields_of(by, "LongCallSchema")["days"]["dataType"] == "integer"
    derived = {m["id"].rsplit("%3A", 2)[-2]: m["lossiness"] for m in by["mapping"] if m["relation"] == "core:derives_from"}
    assert derived == {"ArrivalSchema": "lossy", "LongCallSchema": "lossless"}
    assert [d["code"] for d in by["diagnostic"]] == ["DUPLICATE_ZOD_SCHEMA_NAME"]


def test_legacy_guard():
    good = {"sourcesOfTruth": [{"id": "a", "label": "A", "paths": ["x"], "outputs": []}]}
    assert adapters.is_legacy_catalogue(good) and adapters.is_legacy_catalogue({"sourcesOfTruth": []})
    assert not any(map(adapters.is_legacy_catalogue, (None, {}, {"sourcesOfTruth": {}}, {"sourcesOfTruth": [3]}, {"sourcesOfTruth": [{"id": "a", "label": "A", "paths": [1], "outputs": []}]})))


def test_json_collections(spark, tmp_path):
    config = {"path": "c.json", "collections": [{"pointer": "/surfaces", "idProperty": "id", "labelProperty": "label", "entityKind": "surface", "references": [{"property": "viewIds", "targetKind": "view"}]}, {"pointer": "/nothing", "idProperty": "id", "entityKind": "x"}]}
    by = found(spark, tmp_path, adapters.JsonCollections(), config, {"c.json": json.dumps({"surfaces": [{"id": "s1", "label": "One", "viewIds": ["v1", "v2", 3]}, {"x": 1}, {"id": "s2", "viewIds": "v1"}]})})
    assert names(by, "surface") == ["One", "s2"] and names(by, "view") == ["v1", "v2"]
    assert sorted(d["code"] for d in by["diagnostic"]) == ["JSON_COLLECTION_ITEM_ID_MISSING", "JSON_COLLECTION_NOT_ARRAY"]
    assert sorted(len(m["targets"]) for m in by["mapping"]) == [1, 2, 2]
    assert adapters.pointer({"a/b": {"~": [1, 2]}}, "/a~1b/~0/1") == 2 and adapters.pointer({"a": 1}, "") == {"a": 1} and adapters.pointer([], "/3") is None


def test_legacy(spark, tmp_path):
    entries = [{"id": "one", "label": "One", "paths": ["a.ts"], "outputs": ["docs"]}, {"id": "two", "label": "Two", "paths": ["b/*.ts", "c or d"], "outputs": []}]
    by = found(spark, tmp_path, adapters.LegacyCatalogue(), {"path": "l.json"}, {"l.json": json.dumps({"sourcesOfTruth": entries})})
    assert sorted(a["mode"] for a in by["authority"]) == ["candidate", "candidate", "canonical"]
    assert sorted(d["code"] for d in by["diagnostic"]) == ["LEGACY_AMBIGUOUS_PATH", "LEGACY_MULTIPLE_SOURCES", "LEGACY_PATH_PATTERN"]


def test_app_router(spark, tmp_path):
    files = {
        "app/layout.tsx": "export default () => <ThemeProvider/>", "app/page.tsx": "'use client'\nfetch('/x')", "app/blog/layout.tsx": "", "app/blog/template.tsx": "", "app/blog/[slug]/page.tsx": "", "app/(group)/about/page.tsx": "",
        "app/blog/error.tsx": "", "app/api/items/route.ts": "export async function GET() {}\nexport const POST = 1", "app/api/bad/route.ts": "", "app/util.ts": "",
    }
    by = found(spark, tmp_path, adapters.AppRouterAdapter(), {"path": "app", "exclusions": [{"path": "app/page.tsx"}, {"path": "app/none.tsx"}]}, files)
    assert names(by, "routing:route") == ["/", "/about", "/api/items", "/api/items", "/blog/:slug"]
    tail = lambda u: u.rsplit("%3A", 1)[-1].replace("%2F", "/")
    wraps = {(tail(m["sources"][0]), tail(m["targets"][0])) for m in by["mapping"] if m["relation"] == "topology:wraps"}
    assert wraps == {("app/layout.tsx", "app/blog/layout.tsx"), ("app/blog/layout.tsx", "app/blog/template.tsx")}
    rendered = {tail(m["sources"][0]): tail(m["targets"][0]) for m in by["mapping"] if m["relation"] == "topology:rendered_in"}
    assert rendered["app/blog/%5Bslug%5D/page.tsx"] == "app/blog/template.tsx" and len(rendered) == 3
    assert sorted(d["code"] for d in by["diagnostic"]) == ["NEXT_ROUTE_METHOD_MISSING", "STALE_TOPOLOGY_EXCLUSION"]
    assert next(e for e in by["entity"] if e["kind"] == "routing:schema")["attributes"]["parameters"] == [{"name": "slug", "cardinality": "one", "optional": False}]
    assert next(e for e in by["entity"] if e["label"] == "app/page.tsx")["attributes"]["topologyDisposition"] == "excluded"


def test_app_router_surfaces(spark, tmp_path):
    """Outlets, endpoints by method, hydration boundaries, and contexts told by where they are imported from."""
    files = {
        "app/layout.tsx": "'use client'\nimport Shade, { InkProvider as Pen } from '../lib/ink'\nimport { PenProvider } from 'pens'\n// <GhostProvider>\nexport default () => <PenProvider><ShadeProvider/></PenProvider>",
        "app/desk/layout.tsx": "import { PenProvider as OtherProvider } from \"pens\"\nimport * as kit from '../../lib/kit'\nconst x: Set<PenProvider> = 0\nexport default () => <OtherProvider><kit.Provider /></OtherProvider>",
        "app/desk/page.tsx": "", "app/desk/@side/page.tsx": "", "app/desk/@side/deep/page.tsx": "", "app/desk/error.tsx": "'use client'", "app/desk/sheets/route.ts": "export async function GET() {}\nexport const POST = 1",
    }
    by = found(spark, tmp_path, adapters.AppRouterAdapter(), {"path": "app"}, files)
    label = {e["id"]: e["label"] for e in by["entity"]}
    links = lambda r: {(label[m["sources"][0]], label[m["targets"][0]]) for m in by["mapping"] if m["relation"] == r}
    assert names(by, "topology:outlet") == ["side"]
    assert {("/desk", "side"), ("side", "/desk/@side"), ("/desk/@side", "/desk/@side/deep")} <= links("topology:contains") and ("/desk", "/desk/@side") not in links("topology:contains")
    assert links("topology:hydrates") == {(f"Hydration boundary for {p}", p) for p in ("app/layout.tsx", "app/desk/error.tsx")}
    assert links("routing:exposed_as") == {("/desk/sheets", "GET /desk/sheets"), ("/desk/sheets", "POST /desk/sheets")} and links("routing:handled_by") == {("/desk/sheets", "GET handler"), ("/desk/sheets", "POST handler")}
    contexts = {(e["attributes"]["module"], e["attributes"]["symbol"]) for e in by["entity"] if e["kind"] == "topology:context"}
    assert contexts == {("pens", "PenProvider"), ("app/layout.tsx", "ShadeProvider"), ("lib/kit", "Provider")}
    assert links("topology:hosts_provider") == {("app/layout.tsx", "PenProvider"), ("app/layout.tsx", "ShadeProvider"), ("app/desk/layout.tsx", "OtherProvider"), ("app/desk/layout.tsx", "kit.Provider")}
    assert links("topology:provides_context") >= {("OtherProvider", "Other"), ("PenProvider", "Other")} and {m["relation"] for m in by["mapping"]} >= {"topology:rendered_in", "topology:wraps"}


def test_shards_and_cache(spark, tmp_path):
    shard = {"schemaVersion": "2.0.0", "id": "urn:d", "namespace": "t", "entities": [{"id": "urn:t:a", "kind": "x"}], "mappings": [], "authorities": []}
    (tmp_path / "a.json").write_text(json.dumps(shard))
    context, adapter = adapters.Context(str(tmp_path), "t", "repo"), adapters.ShardAdapter()
    config, cache = {"id": "s", "path": "a.json"}, str(tmp_path / "cache")
    assert [hit for _, hit in (adapters.discover_cached(spark, adapter, config, context, cache) for _ in range(2))] == [False, True]
    (tmp_path / "a.json").write_text(json.dumps(shard | {"label": "new"}))
    assert not adapters.discover_cached(spark, adapter, config, context, cache)[1]
    assert documents.graph_of(documents.read_shards(spark, str(tmp_path / "a.json"))).entities.count() == 1
    (tmp_path / "a.json").write_text(json.dumps(shard | {"more": 1}))
    with pytest.raises(ValueError, match="UNEXPECTED_MEMBER"):
        documents.read_shards(spark, str(tmp_path / "a.json"))


def test_registry():
    registry = adapters.default_registry()
    assert registry.ids() == ["graph-shard", "json-collections", "legacy-sources", "nextjs-app-router", "prisma", "typescript-zod"]
    with pytest.raises(ValueError, match="already"):
        registry.register(adapters.PrismaAdapter())
    with pytest.raises(ValueError, match="there are"):
        registry.require("none")
