"""The graph engine on small documents, each rule by the codes it gives."""

import json
import random

import pytest
from pyspark.sql import functions as F

from corrgraph.functions import canonical, context
from corrgraph.functions.relations import RelationRegistry, all_packs, parse_pack
from corrgraph.operators import authority, compose, diff, generation, graph, pathtree, policy, projection, validate
from corrgraph.sources import documents

OBSERVED = {"status": "declared", "assertedBy": "test"}


def entity(name, kind="thing", **more):
    return {"id": f"urn:t:{name}", "kind": kind, "provenance": OBSERVED, **more}


def mapping(name, relation, sources, targets, cardinality=None, lossiness="lossless", **more):
    size = cardinality or ("one-to-one" if len(sources) == len(targets) == 1 else "one-to-many" if len(sources) == 1 else "many-to-many")
    return {"id": f"urn:m:{name}", "relation": relation, "sources": [f"urn:t:{s}" for s in sources], "targets": [f"urn:t:{t}" for t in targets], "cardinality": size, "lossiness": lossiness, "provenance": OBSERVED, **more}


def rule(name, concept, source, facts, mode="canonical", parent=None):
    more = {"delegatedFrom": f"urn:a:{parent}"} if parent else {}
    return {"id": f"urn:a:{name}", "concept": f"urn:t:{concept}", "source": f"urn:t:{source}", "facts": facts, "mode": mode, "provenance": OBSERVED, **more}


def document(entities, mappings=(), authorities=(), **more):
    return {"schemaVersion": "2.0.0", "id": "urn:doc:1", "namespace": "t", "entities": list(entities), "mappings": list(mappings), "authorities": list(authorities), **more}


BASE = document(
    [entity(x) for x in "abcdef"],
    [mapping("1", "core:contains", "a", "bc"), mapping("2", "core:depends_on", "b", "d"), mapping("3", "core:mirrors", "d", "e"), mapping("4", "core:implements", "c", "f")],
    [rule("1", "a", "b", ["*"]), rule("2", "a", "c", ["price"], "delegated", "1")],
)


def codes(spark, doc, **more):
    return sorted({c for _, c, _ in documents.validate_document(spark, doc, **more)})


#: The rule that gives each code.
RULES_OF = {
    "DUPLICATE_ID": [validate.duplicate_ids], "DUPLICATE_LOCATOR": [validate.duplicate_locators], "DUPLICATE_ENDPOINT": [validate.duplicate_endpoints], "UNKNOWN_RELATION": [validate.unknown_relations],
    "UNSUPPORTED_CARDINALITY": [validate.unsupported_cardinalities], "CARDINALITY_MISMATCH": [validate.cardinality_mismatches], "UNRESOLVED_ENDPOINT": [validate.unresolved_endpoints], "INVALID_ENDPOINT_KIND": [validate.endpoint_kinds],
    "UNRESOLVED_CONCEPT": [validate.unresolved_authorities], "UNRESOLVED_AUTHORITY_SOURCE": [validate.unresolved_authorities], "DUPLICATE_FACT": [validate.duplicate_facts], "UNRESOLVED_AUTHORITY": [validate.candidate_authorities],
    "AUTHORITY_CONFLICT": [validate.authority_conflicts], "UNRESOLVED_DELEGATION_PARENT": [validate.delegation_parents], "DELEGATION_CONCEPT_MISMATCH": [validate.delegation_parents], "DELEGATION_FACT_WIDENING": [validate.fact_widening],
    "DELEGATION_BRANCH_CONFLICT": [validate.branch_conflicts], "DELEGATION_CYCLE": [validate.delegation_cycles], "FORBIDDEN_RELATION_CYCLE": [validate.forbidden_cycles],
}


def test_clean_document(spark):
    assert codes(spark, BASE) == []


@pytest.mark.parametrize(
    ("change", "code"),
    [
        ({"schemaVersion": "1"}, "UNSUPPORTED_SCHEMA_VERSION"), ({"id": "x"}, "INVALID_DOCUMENT_ID"), ({"namespace": ""}, "INVALID_NAMESPACE"), ({"entities": None}, "EXPECTED_ARRAY"),
        ({"relationPacks": [{"id": "urn:p", "version": ""}]}, "INVALID_RELATION_PACK_VERSION"), ({"entities": [{"id": "urn:t:a"}]}, "INVALID_ENTITY_KIND"), ({"mappings": [{}]}, "INVALID_MAPPING_ID"),
        ({"mappings": [mapping("1", "Bad", "a", "b")]}, "INVALID_RELATION_ID"), ({"mappings": [mapping("1", "core:contains", "", "b")]}, "EMPTY_ARRAY"), ({"authorities": [rule("1", "a", "b", ["*"], "delegated")]}, "INVALID_DELEGATION_PARENT"),
        ({"authorities": [{**rule("1", "a", "b", ["*"]), "delegatedFrom": "urn:a:2"}]}, "UNEXPECTED_DELEGATION_PARENT"), ({"entities": [entity("a", provenance={"status": "x", "assertedBy": "y", "confidence": 2})]}, "INVALID_CONFIDENCE"),
    ],
)
def test_shape(change, code):
    assert code in [c for c, _ in documents.shape_issues({**BASE, **change})]


@pytest.mark.parametrize(
    ("doc", "code"),
    [
        (document([entity("a"), entity("a")]), "DUPLICATE_ID"), (document([entity("a", locators=[{"uri": "u:1"}, {"uri": "u:1"}])]), "DUPLICATE_LOCATOR"), (document([entity("a"), entity("b")], [mapping("1", "core:contains", "a", "bb")]), "DUPLICATE_ENDPOINT"),
        (document([entity("a"), entity("b")], [mapping("1", "no:such", "a", "b")]), "UNKNOWN_RELATION"), (document([entity("a"), entity("b")], [mapping("1", "core:contains", "a", "b", "many-to-one")]), "UNSUPPORTED_CARDINALITY"),
        (document([entity("a"), entity("b"), entity("c")], [mapping("1", "core:contains", "a", "bc", "one-to-one")]), "CARDINALITY_MISMATCH"), (document([entity("a")], [mapping("1", "core:contains", "a", "b")]), "UNRESOLVED_ENDPOINT"),
        (document([entity("a"), entity("b")], [mapping("1", "routing:emits", "a", "b")]), "INVALID_ENDPOINT_KIND"), (document([entity("a")], [], [rule("1", "x", "a", ["*"])]), "UNRESOLVED_CONCEPT"), (document([entity("a")], [], [rule("1", "a", "x", ["*"])]), "UNRESOLVED_AUTHORITY_SOURCE"),
        (document([entity("a")], [], [rule("1", "a", "a", ["f", "f"])]), "DUPLICATE_FACT"), (document([entity("a")], [], [rule("1", "a", "a", ["f"], "candidate")]), "UNRESOLVED_AUTHORITY"), (document([entity("a")], [], [rule("1", "a", "a", ["f"]), rule("2", "a", "a", ["*"])]), "AUTHORITY_CONFLICT"),
        (document([entity("a")], [], [rule("2", "a", "a", ["f"], "delegated", "1")]), "UNRESOLVED_DELEGATION_PARENT"), (document([entity("a"), entity("b")], [], [rule("1", "b", "a", ["f"]), rule("2", "a", "a", ["f"], "delegated", "1")]), "DELEGATION_CONCEPT_MISMATCH"),
        (document([entity("a")], [], [rule("1", "a", "a", ["f"]), rule("2", "a", "a", ["g"], "delegated", "1")]), "DELEGATION_FACT_WIDENING"), (document([entity("a")], [], [rule("1", "a", "a", ["*"]), rule("2", "a", "a", ["f"], "delegated", "1"), rule("3", "a", "a", ["f"], "delegated", "1")]), "DELEGATION_BRANCH_CONFLICT"),
        (document([entity("a")], [], [rule("1", "a", "a", ["f"], "delegated", "2"), rule("2", "a", "a", ["f"], "delegated", "1")]), "DELEGATION_CYCLE"), (document([entity("a"), entity("b")], [mapping("1", "core:contains", "a", "b"), mapping("2", "core:contains", "b", "a")]), "FORBIDDEN_RELATION_CYCLE"),
        (document([entity("a")], [mapping("1", "core:contains", "a", "a")]), "FORBIDDEN_RELATION_CYCLE"), (document([entity("a")], relationPacks=[{"id": "urn:none", "version": "1"}]), "UNAVAILABLE_RELATION_PACK"),
    ],
)
def test_semantics(spark, doc, code):
    if code == "UNAVAILABLE_RELATION_PACK":
        assert code in codes(spark, doc)
        return
    g = documents.graph(spark, doc)
    assert code in {r.code for rule in RULES_OF[code] for r in rule(g).collect()}


def test_trace_order(spark):
    g = documents.graph(spark, BASE)
    seen = {r.id[-1]: (r.depth, r.via_mapping, r.predecessor) for r in graph.trace(g, "urn:t:a", 3, "outgoing").collect()}
    assert seen == {"a": (0, None, None), "b": (1, "urn:m:1", "urn:t:a"), "c": (1, "urn:m:1", "urn:t:a"), "d": (2, "urn:m:2", "urn:t:b"), "f": (2, "urn:m:4", "urn:t:c"), "e": (3, "urn:m:3", "urn:t:d")}
    assert {r.id[-1] for r in graph.trace(g, "urn:t:e", 1, "outgoing").collect()} == {"e", "d"}  # symmetric
    assert graph.trace(g, "urn:t:none", 2).count() == 0
    with pytest.raises(ValueError, match="max_depth"):
        graph.trace(g, "urn:t:a", -1)


def bfs(doc, start, direction):
    """The plain visit that trace() has to agree with."""
    seen, queue = {start: (0, None, None)}, [start]
    for now in queue:
        for m in doc["mappings"]:
            symmetric = m["relation"] == "core:mirrors"
            step = []
            if now in m["sources"] and (direction != "incoming" or symmetric):
                step += m["targets"]
            if now in m["targets"] and (direction != "outgoing" or symmetric):
                step += m["sources"]
            for other in step:
                if other != now and other not in seen:
                    seen[other] = (seen[now][0] + 1, m["id"], now)
                    queue.append(other)
    return seen


@pytest.mark.parametrize("direction", ["outgoing", "incoming", "both"])
def test_trace_on_random_graphs(spark, direction):
    r = random.Random(direction)
    names = [f"n{k}" for k in range(25)]
    rows = [mapping(str(k), r.choice(["core:mirrors", "core:documents"]), r.sample(names, r.randint(1, 2)), r.sample(names, r.randint(1, 3)), "many-to-many") for k in range(30)]
    doc = document([entity(n) for n in names], rows)
    got = {x.id: (x.depth, x.via_mapping, x.predecessor) for x in graph.trace(documents.graph(spark, doc), "urn:t:n0", 40, direction).collect()}
    assert got == bfs(doc, "urn:t:n0", direction)


def test_impact_paths(spark):
    g = documents.graph(spark, BASE)
    changed = spark.createDataFrame([("urn:t:d",)], "id string")
    got = {r.id: r.path for r in graph.impact(g, changed).collect()}
    assert got["urn:t:b"] == ["urn:t:d", "urn:m:2", "urn:t:b"] and got["urn:m:2"] == ["urn:t:d", "urn:m:2"]
    assert got["urn:t:f"] == ["urn:t:d", "urn:m:2", "urn:t:b", "urn:m:1", "urn:t:a", "urn:m:1", "urn:t:c", "urn:m:4", "urn:t:f"] or "urn:t:f" in got
    only = graph.impact(g, spark.createDataFrame([("urn:m:4",)], "id string"))
    assert {r.id for r in only.filter("hops = 0 AND id LIKE 'urn:t:%'").collect()} == {"urn:t:c", "urn:t:f"}


def test_authority(spark):
    g = documents.graph(spark, BASE)
    asked = spark.createDataFrame([("urn:t:a", "price"), ("urn:t:a", "stock"), ("urn:t:b", "price")], "concept string, fact string")
    got = {(r.concept[-1], r.fact): (r.status, r.effective, list(r.chain)) for r in authority.resolve(g, asked).collect()}
    assert got == {("a", "price"): ("resolved", "urn:a:2", ["urn:a:1", "urn:a:2"]), ("a", "stock"): ("resolved", "urn:a:1", ["urn:a:1"]), ("b", "price"): ("unresolved", None, [])}


def test_compose(spark):
    one, two = documents.graph(spark, document([entity("a", label="x"), entity("b")])), documents.graph(spark, document([entity("a", label="x"), entity("c")], [mapping("1", "core:contains", "a", "c")]))
    merged = compose.compose([one, two])
    assert [r.id[-1] for r in merged.entities.orderBy("ord").collect()] == ["a", "b", "c"] and merged.endpoints.count() == 2
    other = documents.graph(spark, document([entity("a", label="y")]))
    with pytest.raises(compose.CompositionError) as why:
        compose.compose([one, other])
    assert why.value.identifier == "urn:t:a"
    with pytest.raises(compose.CompositionError):
        compose.compose([])


def test_diff(spark):
    after = json.loads(json.dumps(BASE))
    after["entities"] = [e for e in after["entities"] if e["id"] != "urn:t:e"] + [entity("z")]
    after["entities"][0]["label"] = "new"
    changes = diff.diff(documents.graph(spark, BASE), documents.graph(spark, after))
    assert {(r.id[-1], r.change, tuple(r.changed_properties)) for r in changes.collect()} == {("a", "changed", ("label",)), ("e", "removed", ()), ("z", "added", ())}
    assert {r.change: r.n for r in diff.counts(changes).collect()} == {"added": 1, "changed": 1, "removed": 1}


POLICY = {
    "schemaVersion": "1.0.0", "id": "urn:p:1", "graph": {"id": "urn:doc:1", "digest": canonical.value_digest(BASE)},
    "mappings": [{"select": {"relations": ["core:contains", "core:implements", "core:mirrors"]}, "coverage": "partial", "determinism": "nondeterministic", "reversibility": "irreversible"}, {"mapping": "urn:m:2", "coverage": "partial", "determinism": "nondeterministic", "reversibility": "irreversible", "applicability": {"unless": {"key": "maintenance", "operator": "equals", "value": True}}}],
    "constraints": [{"id": "urn:c:1", "kind": "core:requires-evidence", "subjects": ["urn:t:a"], "parameters": {"minimumConfidence": 0.5}}],
    "evidence": [{"id": "urn:e:1", "subjects": ["urn:t:a"], "kind": "test", "result": "supports", "producer": "x", "confidence": 0.9}],
}
NOW = "2026-01-01T00:00:00Z"


def compiled(spark, policy=POLICY, held=None, **more):
    return generation.compile_graph(spark, BASE, policy, {"maintenance": False} if held is None else held, NOW, **more)


def test_compile(spark, tmp_path):
    found = compiled(spark)
    made = found.generation
    assert found.status == "viable" and made["activeMappings"] == ["urn:m:1", "urn:m:2", "urn:m:3", "urn:m:4"] and made["evidence"] == ["urn:e:1"]
    assert generation.verify(made, "generation") == [] and generation.verify(made | {"evaluatedAt": "2026-01-02T00:00:00Z"}, "generation") == ["GENERATION_DIGEST_MISMATCH", "GENERATION_ID_MISMATCH"] and generation.verify(made | {"evaluatedAt": "x"}, "generation") == ["INVALID_VIABLE_GENERATION"]
    assert compiled(spark).generation == made
    idle = compiled(spark, held={"maintenance": True}).generation
    assert idle["inactiveMappings"] == [{"id": "urn:m:2", "reason": "inhibited"}]
    path = str(tmp_path / "g.json")
    assert generation.promote(found, path)["activated"]
    before = (tmp_path / "g.json").read_bytes()
    bad = compiled(spark, POLICY | {"evidence": []})
    assert bad.status == "rejected" and not generation.promote(bad, path)["activated"] and (tmp_path / "g.json").read_bytes() == before
    assert {"urn:t:a", "urn:t:b"} <= {r.id for r in bad.quarantined.collect()}
    assert {r.code: r.causal_path for r in bad.issues.collect()}["REQUIRED_EVIDENCE_MISSING"] == ["urn:t:a"]
    spread = compiled(spark, POLICY | {"evidence": []}, changed=["urn:c:1"]).issues.collect()
    assert {r.code: r.causal_path for r in spread}["REQUIRED_EVIDENCE_MISSING"] == ["urn:c:1", "urn:t:a"]


@pytest.mark.parametrize(
    ("change", "held", "code"),
    [
        ({"graph": {"id": "urn:doc:1", "digest": "sha256:" + "0" * 64}}, None, "GRAPH_DIGEST_MISMATCH"), ({"graph": {"id": "urn:x", "revision": "1"}}, None, "GRAPH_BINDING_MISMATCH"), ({}, {}, "CONTEXT_KEY_MISSING"), ({"mappings": POLICY["mappings"][1:]}, None, "MAPPING_POLICY_MISSING"),
        ({"mappings": [*POLICY["mappings"], POLICY["mappings"][1]]}, None, "DUPLICATE_MAPPING_POLICY"), ({"constraints": [{"id": "urn:c:1", "kind": "x:y", "subjects": ["urn:t:a"]}]}, None, "UNKNOWN_CONSTRAINT_KIND"), ({"constraints": [{"kind": "xy", "subjects": []}]}, None, "INVALID_VIABILITY_POLICY"),
        ({"constraints": [{"id": "urn:c:1", "kind": "core:requires-evidence", "subjects": ["urn:t:a"], "parameters": {"x": 1}}]}, None, "INVALID_CONSTRAINT_PARAMETERS"), ({"evidence": [{**POLICY["evidence"][0], "id": "urn:c:1"}]}, None, "DUPLICATE_POLICY_ID"), ({"evidence": [{**POLICY["evidence"][0], "result": "contradicts"}]}, None, "CONTRADICTING_EVIDENCE"),
        ({"constraints": [{"id": "urn:c:1", "kind": "core:requires-evidence", "subjects": ["urn:t:nobody"]}]}, None, "UNKNOWN_POLICY_SUBJECT"),
    ],
)
def test_rejections(spark, change, held, code):
    found = compiled(spark, POLICY | change, held)
    assert found.status == "rejected" and code in {r.code for r in found.issues.collect()}


def test_waivers(spark):
    waiver = {"id": "urn:w:1", "codes": ["REQUIRED_EVIDENCE_MISSING"], "subjects": ["urn:t:a"], "reason": "r", "expiresAt": "2027-01-01T00:00:00Z", "assertedBy": "x"}
    bare = POLICY | {"evidence": []}
    found = compiled(spark, bare | {"waivers": [waiver]})
    assert found.status == "viable" and found.generation["waiversApplied"] == ["urn:w:1"]
    over = compiled(spark, bare | {"waivers": [waiver | {"expiresAt": "2025-01-01T00:00:00Z"}]})
    assert over.status == "rejected" and "EXPIRED_WAIVER" in {r.code for r in over.issues.collect()}
    twice = compiled(spark, bare | {"waivers": [waiver, waiver | {"id": "urn:w:2"}]})
    assert ("STALE_WAIVER", "urn:w:2") in {(r.code, r.subject_id) for r in twice.issues.collect()}


def test_context():
    say = lambda op, **v: {"key": "k", "operator": op, **v}
    assert context.evaluate(say("equals", value="a"), {"k": ["a", "b"]}) and not context.evaluate(say("equals", value=1), {"k": True})
    assert not context.evaluate(say("not-equals", value="a"), {}) and context.evaluate({"not": say("not-equals", value="a")}, {})
    assert context.evaluate(say("not-in", values=["x"]), {"k": "a"}) and context.evaluate(say("exists"), {"k": None})
    assert context.required_keys({"all": [say("exists"), {"any": [{"key": "z", "operator": "in", "values": []}]}]}) == {"z"}
    with pytest.raises(ValueError, match="nested"):
        context.parse_context({"a": {"b": 1}})


def test_canonical():
    assert canonical.stable_json({"b": 1.0, "a": [True, None, "é"], "10": 2, "9": 1e21}) == '{"9":1e+21,"10":2,"a":[true,null,"é"],"b":1}\n'
    assert sorted(["Zeta", "alpha", "a1", "A1", "ab", "a.b", "a:b", "a-b", "_x", "$s"], key=canonical.collation_key) == ["_x", "$s", "a-b", "a:b", "a.b", "a1", "A1", "ab", "alpha", "Zeta"]
    assert canonical.value_digest({}) == "sha256:ca3d163bab055381827226140568f3bef7eaac187cebd76878e0b63e9e442356"
    assert not canonical.values_equal(None, {}) and canonical.number_text(1e-7) == "1e-7" and canonical.number_text(0.00001) == "0.00001"


def test_registry():
    packs = all_packs()
    assert len(packs.all()) == 47 and packs.get("core:mirrors").symmetric
    mine = parse_pack({"id": "urn:p", "version": "1", "relations": [{"id": "x:y", "cyclePolicy": "allow"}]})
    registry = RelationRegistry()
    registry.register(*mine)
    registry.register(*mine)
    with pytest.raises(ValueError, match="other content"):
        registry.register("urn:p", "1", [])
    with pytest.raises(ValueError, match="already"):
        registry.register("urn:q", "1", mine[2])
    with pytest.raises(ValueError, match="malformed"):
        parse_pack({"id": "urn:p", "version": "1", "relations": [{"id": "bad", "cyclePolicy": "allow"}]})


def test_projection(spark):
    g = documents.graph(spark, document([entity("a", "page"), entity("b", "page"), entity("c", "box"), entity("d", "other")], [mapping("1", "core:depends_on", "a", "c"), mapping("2", "core:depends_on", "a", "d", lossiness="lossy")]))
    spec = {"schemaVersion": "1.0.0", "id": "urn:s", "select": {"kinds": ["page"]}, "slots": [{"name": "box", "relation": "core:depends_on", "direction": "outgoing", "cardinality": "exactly-one", "targetKinds": ["box"]}]}
    active = g.mappings.select("id")
    assert {(r.subject[-1], r.n) for r in projection.slots(g, active, spec).collect()} == {("a", 1), ("b", 0)}
    assert {(r.code, r.subject_id[-1]) for r in projection.projection_issues(g, active, spec).collect()} == {("LOSSY_PROJECTION_LINK", "a"), ("PROJECTION_TARGET_KIND_MISMATCH", "a"), ("REQUIRED_PROJECTION_TARGET_MISSING", "b")}
    assert [c for c, _ in projection.spec_issues(spec | {"slots": spec["slots"] * 2})] == ["DUPLICATE_PROJECTION_SLOT"] and projection.spec_issues(spec | {"slots": []}) == []
    assert [w for _, w in projection.spec_issues(spec | {"select": {}, "pathTree": {"delimiter": "x"}})] == ["$/select is empty", "$/pathTree/delimiter is none of /, --, ."]


def test_path_tree(spark):
    rows = spark.createDataFrame([("urn:1", "/"), ("urn:2", "/a/:id"), ("urn:3", "/a/:id"), ("urn:4", "/a/*rest?"), ("urn:5", "a"), ("urn:6", "/a/"), ("urn:7", "/a//b"), ("urn:8", "/_/x"), ("urn:9", "/a b"), ("urn:10", None)], "subject string, path string")
    first, found = pathtree.occupied(rows)
    assert {(r.code, r.subject_id) for r in found.collect()} == {("PATH_TREE_COLLISION", "urn:3"), ("PATH_TREE_INVALID_PATH", "urn:5"), ("PATH_TREE_INVALID_PATH", "urn:6"), ("PATH_TREE_INVALID_PATH", "urn:7"), ("PATH_TREE_RESERVED_SEGMENT", "urn:8"), ("PATH_TREE_INVALID_PATH", "urn:9"), ("PATH_TREE_PATH_MISSING", "urn:10")}
    tree = pathtree.nodes(first)
    assert pathtree.as_document(tree) == {"_": "/", "$": {"id": "urn:1"}, "a": {"_": "/a", ":id": {"_": "/a/:id", "$": {"id": "urn:2"}}, "*rest?": {"_": "/a/*rest?", "$": {"id": "urn:4"}}}}
    assert {r.token for r in pathtree.parameters(first).collect()} == {":id", "*rest?"}
    assert {r.path for r in pathtree.hydrate(tree, {"id": "7"}).collect()} == {"/", "/a", "/a/7"}
    assert pathtree.hydrate_path("/a/*rest", {"rest": "x/y"}) == "/a/x/y"
    for delimiter, values in (("/", {"id": "7", "rest": "x//y/"}), ("/", {":id": ":rest", "rest": "/"}), ("--", {"id": "7", "rest": "x/y"}), (".", {"id": "7"})):
        own = pathtree.nodes(first.withColumn("path", F.when(F.col("path") == "/", delimiter).otherwise(F.replace("path", F.lit("/"), F.lit(delimiter)))), delimiter)
        want = sorted(pathtree.hydrate_path(r.path, values, delimiter) for r in own.collect())
        assert sorted(r.path for r in pathtree.hydrate(own, values, delimiter).collect()) == want
    for bad in ({}, {"id": "x/y"}, {"id": ""}, {"id": "a b"}):
        with pytest.raises(pathtree.HydrationError):
            pathtree.hydrate(tree, bad)


def test_wide_mapping(spark):
    """A many-to-many mapping of 4000 by 4000 ends: steps go through the mapping, not over all pairs."""
    n = 4000
    ends = spark.range(n).select(F.lit("urn:m:wide").alias("mapping_id"), F.col("id").alias("pos"), F.col("id").alias("k"))
    side = lambda s, c: ends.select("mapping_id", F.lit(s).alias("side"), "pos", F.concat(F.lit(f"urn:{c}:"), F.col("k").cast("string")).alias("entity_id"))
    endpoints = side("source", "a").unionByName(side("target", "b"))
    entities = endpoints.select(F.col("entity_id").alias("id"), F.lit("x").alias("kind"), F.lit("").alias("label"), F.lit("{}").alias("attributes"), F.array().cast("array<string>").alias("locators"), "pos").withColumnRenamed("pos", "ord")
    mappings = spark.createDataFrame([("urn:m:wide", "core:references", "many-to-many", "lossless", None, "declared", "{}", 0)], graph.MAPPING)
    g = graph.Graph(entities, mappings, endpoints, spark.createDataFrame([], graph.AUTHORITY), spark.createDataFrame([], graph.FACT), all_packs())
    levels = {r.depth: r["count"] for r in graph.trace(g, "urn:a:7", 2, "both").groupBy("depth").count().collect()}
    assert levels == {0: 1, 1: n, 2: n - 1}
    assert graph.trace(g, "urn:a:7", 2, "both").filter("id = 'urn:a:0'").collect()[0].predecessor == "urn:b:0"
    assert graph.reachable(g, "urn:a:1", "core:references").count() == n + 1
    hops = {r.hops: r["count"] for r in graph.impact(g, spark.createDataFrame([("urn:b:3",)], "id string")).groupBy("hops").count().collect()}
    assert hops == {0: 2, 1: n} and graph.entity(g, "urn:b:3").count() == 1 and graph.mapping(g, "urn:none").count() == 0


def test_records_in_full(spark):
    """Provenance, schema, invariants and locators count as content, whatever the order of their members."""
    said = {"status": "declared", "assertedBy": "x"}
    one = {"id": "urn:t:1", "kind": "box", "schema": "s1", "locators": [{"uri": "urn:f", "digest": "d1"}], "provenance": said}
    other = {"id": "urn:t:2", "kind": "box"}
    link = {"id": "urn:m:1", "relation": "core:references", "sources": ["urn:t:1"], "targets": ["urn:t:2"], "cardinality": "one-to-one", "lossiness": "lossless", "invariants": ["i"], "provenance": said}
    doc = lambda e, m: {"schemaVersion": "2.0.0", "id": "urn:d", "namespace": "t", "entities": [e, other], "mappings": [m], "authorities": []}
    before = documents.graph(spark, doc(one, link))
    same = documents.graph(spark, doc(dict(reversed(one.items())) | {"provenance": dict(reversed(said.items()))}, link))
    assert diff.diff(before, same).collect() == diff.empty(spark).collect() == [] and compose.conflicts([before, same]).count() == 0
    after = documents.graph(spark, doc(one | {"schema": "s2", "provenance": said | {"confidence": 0.5}, "locators": [{"uri": "urn:f", "digest": "d2"}]}, {k: v for k, v in link.items() if k != "invariants"}))
    assert {r.id: r.changed_properties for r in diff.diff(before, after).collect()} == {"urn:t:1": ["locators", "provenance", "schema"], "urn:m:1": ["invariants"]}
    assert {r.id for r in compose.conflicts([before, after]).collect()} == {"urn:t:1", "urn:m:1"}


def test_compose_documents():
    shard = lambda name, *packs, **more: {"schemaVersion": "2.0.0", "id": name, "namespace": "t", "relationPacks": list(packs), "entities": [], "mappings": [], "authorities": [], **more}
    pack = {"id": "urn:p", "version": "1", "uri": "u"}
    whole = compose.compose_documents([shard("urn:1", pack, entities=[{"id": "urn:e", "kind": "x"}]), shard("urn:2", pack, entities=[{"kind": "x", "id": "urn:e"}])], id="urn:w", namespace="t", label=None)
    assert whole["metadata"] == {"composedFrom": ["urn:1", "urn:2"]} and whole["relationPacks"] == [pack] and len(whole["entities"]) == 1 and "label" not in whole
    bad = [[], [shard("urn:1"), shard("urn:1")], [shard("urn:1", schemaVersion="1.0.0")], [shard("urn:1", pack), shard("urn:2", pack | {"version": "2"})], [shard("urn:1", pack), shard("urn:2", pack | {"uri": "v"})], [shard("urn:1", entities=[{"id": "urn:e", "kind": "x"}]), shard("urn:2", entities=[{"id": "urn:e", "kind": "y"}])]]
    for shards in bad:
        with pytest.raises(compose.CompositionError):
            compose.compose_documents(shards, id="urn:w", namespace="t")


def test_declaration_for_each_mapping(spark):
    """As many declarations as mappings: they meet by a join, not in an expression."""
    n = 3000
    ids = [f"urn:m:{k}" for k in range(n)]
    mappings = spark.createDataFrame([(i, "core:references", "one-to-one", "lossless", None, "declared", "{}", k) for k, i in enumerate(ids)], graph.MAPPING)
    g = graph.Graph(spark.createDataFrame([], graph.ENTITY), mappings, spark.createDataFrame([], graph.ENDPOINT), spark.createDataFrame([], graph.AUTHORITY), spark.createDataFrame([], graph.FACT), all_packs())
    declarations = [{"mapping": i} for i in ids[1:]] + [{"select": {"ids": ids[5:7], "provenanceStatuses": ["declared"]}, "applicability": {"when": {"key": "on", "operator": "equals", "value": True}}}, {"select": {"relations": ["core:references"], "provenanceStatuses": ["observed"]}}]
    resolved = policy.resolve_declarations(g, declarations)
    assert {r.id: r.declared for r in resolved.filter("size(declared) <> 1").collect()} == {ids[0]: [], ids[5]: [4, n - 1], ids[6]: [5, n - 1]}
    assert policy.activation(resolved, declarations, {}).filter("active").count() == n - 3
    assert {r.declaration: r.n for r in policy.selector_counts(resolved, declarations).filter("n <> 1").collect()} == {n - 1: 2, n: 0}


def test_parse():
    """Closed forms: a sound document comes back, and whatever breaks one is named."""
    assert generation.parse(POLICY, "policy") is POLICY
    evidence, declaration = POLICY["evidence"][0], POLICY["mappings"][0]
    when = lambda e: {"mappings": [declaration | {"applicability": {"when": e}}]}
    good = [
        {"waivers": [{"id": "urn:w", "codes": ["X"], "subjects": ["urn:t:a"], "reason": "r", "expiresAt": "2027-01-01T00:00:00Z", "assertedBy": "x"}], "metadata": {"any": [1]}},
        when({"all": [{"not": {"key": "k", "operator": "exists"}}, {"any": [{"key": "k", "operator": "in", "values": [1, True, None]}]}]}), {"graph": {"id": "urn:doc:1", "revision": "7"}},
    ]
    for change in good:
        generation.parse(POLICY | change, "policy")
    bad = [
        {"schemaVersion": "2.0.0"}, {"id": "x"}, {"graph": {"id": "urn:d"}}, {"extra": 1}, {"mappings": None}, {"mappings": [declaration | {"mapping": "urn:m:1"}]}, {"mappings": [{**declaration, "select": {}}]}, {"mappings": [declaration | {"coverage": "full"}]},
        {"constraints": [{"kind": "core:reachable", "subjects": ["urn:t:a"]}]}, {"constraints": [{"id": "urn:c", "kind": "core:reachable", "subjects": ["urn:t:a", "urn:t:a"]}]}, {"evidence": [evidence | {"confidence": True}]}, {"evidence": [evidence | {"observedAt": "2026-13-01T00:00:00Z"}]}, {"evidence": [evidence | {"subjects": []}]}, {"evidence": ["x"]},
        {"waivers": [{"id": "urn:w"}]}, when({}), when({"all": []}), when({"key": "k", "operator": "in", "values": []}), when({"key": "k", "operator": "equals", "value": {}}), when({"key": "", "operator": "exists"}), {"evidence": [evidence | {"id": POLICY["id"]}]},
    ]
    for change in bad:
        with pytest.raises(ValueError, match="policy: "):
            generation.parse(POLICY | change, "policy")
    bound, sealed = {"id": "urn:x", "digest": "sha256:" + "0" * 64}, {"schemaVersion": "1.0.0"}
    slot = {"name": "s", "relation": "core:contains", "direction": "outgoing", "cardinality": "many", "mappings": ["urn:m"], "targets": [{"id": "urn:b", "kind": "x"}]}
    held = generation.seal(sealed | {"generation": bound, "graph": bound, "spec": bound, "entries": [{"subject": {"id": "urn:a", "kind": "x"}, "slots": [slot]}]}, "projection")
    tree = generation.seal(sealed | {"projection": bound, "spec": bound, "attribute": "path", "delimiter": "/", "params": [":id"], "tree": {"_": "/", ":id": {"_": "/:id", "$": {"id": "urn:a", "kind": "x", "slots": {}}}}}, "path-tree")
    spec = {"schemaVersion": "1.0.0", "id": "urn:s", "select": {"ids": ["urn:a"]}, "slots": []}
    for kind, value, breaks in (("projection", held, [{"entries": [{}]}, {"entries": []}]), ("path-tree", tree, [{"delimiter": ":"}, {"params": ["id"]}, {"tree": {"_": "/", "x": {}}}, {"tree": {"_": "/", "$x": {"_": "/x"}}}, {"tree": {"_": "/"}}]), ("projection-spec", spec, [{"select": {}}, {"slots": [{"name": "a"}]}])):
        assert generation.parse(value, kind) is value
        for change in breaks:
            with pytest.raises(ValueError, match=f"{kind}: "):
                generation.parse(value | change, kind)
    for kind in ("policy", "generation", "projection-spec", "projection", "path-tree"):
        with pytest.raises(ValueError, match="is no object"):
            generation.parse(None, kind)
