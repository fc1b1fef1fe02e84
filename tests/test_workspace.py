"""A workspace end to end, the command line, projections and path trees, and the entry point."""

import json

import pytest

from corrgraph import cli, emit, workspace
from corrgraph.functions.canonical import value_digest

PRISMA = "enum Grade {\n  RAW\n  FINE\n  VOID\n}\nmodel Sample {\n  code String @id\n  mass Decimal?\n  taken DateTime\n  grade Grade\n  bench Bench?\n}\nmodel Bench {\n  code String @id\n}\n"
ZOD = 'export const GradeSchema = z.enum(["RAW", "FINE"]);\nexport const SampleSchema = z.object({\n  label: z.string(),\n  grams: z.number(),\n  taken: z.string().datetime(),\n  grade: GradeSchema,\n});\n'
CONFIG = {
    "id": "urn:w:lab", "namespace": "lab", "repository": "lab", "repositoryRoot": ".",
    "sources": [{"id": "store", "adapter": "prisma", "path": "lab.prisma"}, {"id": "wire", "adapter": "typescript-zod", "paths": ["wire.ts"]}],
    "correspondences": [
        {"id": "sample", "source": {"sourceId": "store", "kind": "model", "name": "Sample"}, "target": {"sourceId": "wire", "kind": "schema", "name": "SampleSchema"}, "fields": {"pairs": [{"source": "code", "target": "label"}, {"source": "mass", "target": "grams", "allowDifferences": ["nullability"]}, {"source": "taken", "target": "taken", "transform": "toInstant"}], "requireTargetCoverage": True, "ignoreTarget": ["grade"]}, "authority": {"side": "target", "facts": ["mass", "taken"]}},
        {"id": "grade", "source": {"sourceId": "store", "kind": "enum", "name": "Grade"}, "target": {"sourceId": "wire", "kind": "enum", "name": "GradeSchema"}, "enumValues": {"allowSourceOnly": ["VOID"]}},
    ],
    "outputs": {"graph": "out/graph", "snapshot": "out/snapshot.json", "report": "out/report.md", "documentation": "out/graph.md", "cache": "out/cache"},
}


def test_workspace(spark, tmp_path):
    (tmp_path / "lab.prisma").write_text(PRISMA)
    (tmp_path / "wire.ts").write_text(ZOD)
    found = workspace.discover(spark, CONFIG, str(tmp_path))
    seen = {(r.severity, r.code, r.subject_id) for r in found.drift.collect()}
    assert ("info", "WAIVED_FIELD_DIFFERENCE", "sample") in seen and ("info", "WAIVED_ENUM_DIFFERENCE", "grade") in seen and ("warning", "UNCONFIGURED_STRUCTURES", "store") in seen
    assert not found.has_errors(), [r for r in found.validation.collect()] + sorted(seen)
    assert found.cached == [] and found.snapshot["counts"]["authorities"] == 1
    assert {r.code for r in workspace.check(spark, found, str(tmp_path))[0].collect()} == {"BASELINE_MISSING_OR_INVALID"}
    workspace.write_outputs(found, str(tmp_path))
    again = workspace.discover(spark, CONFIG, str(tmp_path))
    assert again.cached == ["store", "wire"] and again.snapshot == found.snapshot
    assert workspace.check(spark, again, str(tmp_path))[0].count() == 0
    assert "# urn:w:lab" in (tmp_path / "out/report.md").read_text()
    (tmp_path / "lab.prisma").write_text(PRISMA.replace("taken DateTime", "taken BigInt"))
    moved = workspace.discover(spark, CONFIG, str(tmp_path))
    assert ("error", "FIELD_DRIFT", "sample") in {(r.severity, r.code, r.subject_id) for r in moved.drift.collect()}
    assert "BASELINE_DRIFT" in {r.code for r in workspace.check(spark, moved, str(tmp_path))[0].collect()}


@pytest.mark.parametrize("change", [{"sources": []}, {"outputs": {}}, {"correspondences": [{"id": "x", "source": {"sourceId": "no"}, "target": {"sourceId": "store"}}]}])
def test_config(change):
    with pytest.raises(ValueError, match=r"."):
        workspace.parse_config(CONFIG | change)


SAID = {"status": "declared", "assertedBy": "test"}
DOC = {
    "schemaVersion": "2.0.0", "id": "urn:doc:1", "namespace": "t", "authorities": [],
    "entities": [{"id": "urn:t:a", "kind": "page", "label": "A", "attributes": {"path": "/a/:id"}}, {"id": "urn:t:b", "kind": "box", "label": "B"}],
    "mappings": [{"id": "urn:m:1", "relation": "core:depends_on", "sources": ["urn:t:a"], "targets": ["urn:t:b"], "cardinality": "one-to-one", "lossiness": "lossless", "provenance": SAID}],
}
POLICY = {"schemaVersion": "1.0.0", "id": "urn:p:1", "graph": {"id": "urn:doc:1", "digest": value_digest(DOC)}, "mappings": [{"mapping": "urn:m:1", "coverage": "partial", "determinism": "nondeterministic", "reversibility": "irreversible"}], "constraints": [], "evidence": []}
SPEC = {"schemaVersion": "1.0.0", "id": "urn:s:1", "select": {"kinds": ["page"]}, "slots": [{"name": "box", "relation": "core:depends_on", "direction": "outgoing", "cardinality": "exactly-one"}], "pathTree": {}}
AT = ["--at", "2026-01-01T00:00:00Z"]


def test_command_line(spark, tmp_path, capsys):
    files = {}
    for name, value in (("graph", DOC), ("policy", POLICY), ("spec", SPEC), ("other", {**DOC, "entities": DOC["entities"][:1]})):
        files[name] = str(tmp_path / f"{name}.json")
        (tmp_path / f"{name}.json").write_text(json.dumps(value))
    run = lambda *argv: (cli.main(list(argv), spark), capsys.readouterr().out)
    assert run("validate", files["graph"])[0] == 0 and run("validate", files["other"])[0] == 1
    assert run("validate", str(tmp_path / "none"))[0] == 2 and run("nonsense")[0] == 2
    code, out = run("compile", files["graph"], files["policy"], *AT)
    assert code == 0
    made = json.loads(out)
    (tmp_path / "generation.json").write_text(out)
    assert run("promote", files["graph"], files["policy"], str(tmp_path / "live.json"), *AT)[0] == 0 and json.loads((tmp_path / "live.json").read_text()) == made
    assert run("trace", files["graph"], "urn:t:a", "--direction", "outgoing")[0] == 0 and run("trace", files["graph"], "urn:t:z")[0] == 1
    assert run("authority", files["graph"], "urn:t:a", "price")[0] == 0 and run("diff", files["graph"], files["graph"]) == (0, "")
    link = ("link", files["graph"], str(tmp_path / "generation.json"), files["spec"], "--format")
    projected = json.loads(run(*link, "json")[1])
    assert projected["entries"][0]["slots"][0]["targets"][0]["label"] == "B"
    assert "resolvePages" in run(*link, "typescript", "--name", "pages")[1] and "fillPages" in run(*link, "path-tree-typescript", "--name", "pages")[1]
    tree = json.loads(run(*link, "path-tree")[1])
    assert tree["params"] == [":id"] and tree["tree"]["a"][":id"]["$"]["slots"]["box"]["id"] == "urn:t:b"
    with pytest.raises(ValueError, match="exported"):
        emit.export_name("class")
    stale = {**DOC, "label": "new"}
    assert ("STALE_PROJECTION_GENERATION", made["id"]) in emit.build_projection(spark, stale, made, SPEC)[1]
    assert emit.build_path_tree(spark, {**SPEC, "id": "urn:s:2"}, projected)[1] == [("PATH_TREE_SPEC_MISMATCH", "urn:s:2")]
    assert projected["spec"]["digest"] == value_digest(SPEC)


def test_entry_point():
    import __spark_entry__

    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(queries) and "trace_depth3" in queries and len(sql) > 60
