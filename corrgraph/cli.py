"""Command line: validate, compile, promote, impact, link, generate, check, diff, trace, authority.

Exit codes: 0 for success, 1 for a negative answer (invalid, rejected, drift, nothing found), 2 for misuse.
"""

from __future__ import annotations

import argparse
import json
import os
import sys

from corrgraph.functions.canonical import stable_json


def session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("corrgraph").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()


def load(path: str):
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def show(rows) -> None:
    for r in rows:
        print(json.dumps(r if isinstance(r, dict | list) else r.asDict(), ensure_ascii=False, default=str))


def validate(spark, a) -> int:
    from corrgraph.sources import documents

    found = documents.validate_document(spark, load(a.graph))
    show([{"severity": s, "code": c, "subject": x} for s, c, x in found])
    return int(any(s == "error" for s, _, _ in found))


def _compiled(spark, a):
    from corrgraph.operators import generation

    return generation.compile_graph(spark, load(a.graph), load(a.policy), load(a.context) if a.context else {}, a.at, a.changed)


def compile_(spark, a) -> int:
    found = _compiled(spark, a)
    if found.status == "viable":
        print(stable_json(found.generation), end="")
        return 0
    show(found.issues.orderBy("severity", "code", "subject_id").collect())
    return 1


def promote(spark, a) -> int:
    from corrgraph.operators import generation

    out = generation.promote(_compiled(spark, a), a.output)
    show([{k: v for k, v in out.items() if k != "current"}])
    return 0 if out["activated"] else 1


def impact(spark, a) -> int:
    found = _compiled(spark, a)
    show(found.impact.orderBy("id").collect())
    return 0 if found.status == "viable" else 1


def link(spark, a) -> int:
    from corrgraph.emit import build_path_tree, build_projection, path_tree_typescript, projection_typescript

    spec, generation, document = load(a.spec), load(a.generation), load(a.graph)
    made, found = build_projection(spark, document, generation, spec)
    if made is not None and a.format.startswith("path-tree"):
        made, found = build_path_tree(spark, spec, made)
    if made is None:
        show([{"code": c, "subject": s} for c, s in found])
        return 1
    print({"json": stable_json, "path-tree": stable_json, "typescript": lambda m: projection_typescript(m, a.name), "path-tree-typescript": lambda m: path_tree_typescript(m, a.name)}[a.format](made), end="")
    return 0


def generate(spark, a) -> int:
    from corrgraph import workspace

    base = os.path.dirname(os.path.abspath(a.config))
    found = workspace.discover(spark, load(a.config), base, use_cache=not a.no_cache)
    if found.has_errors():
        show(found.validation.unionByName(found.drift).unionByName(found.diagnostics).filter("severity = 'error'").collect())
        return 1
    show([workspace.write_outputs(found, base)])
    return 0


def check(spark, a) -> int:
    from corrgraph import workspace
    from corrgraph.operators import report

    base = os.path.dirname(os.path.abspath(a.config))
    found = workspace.discover(spark, load(a.config), base)
    drift, changes = workspace.check(spark, found, base)
    print(report.drift_report(found.config["id"], found.validation, found.drift.unionByName(found.diagnostics).unionByName(drift), changes), end="")
    return int(found.has_errors() or drift.filter("severity = 'error'").limit(1).count())


def diff(spark, a) -> int:
    from corrgraph.operators import diff as d
    from corrgraph.sources import documents

    both = [load(a.before), load(a.after)]
    if any(s == "error" for doc in both for s, _, _ in documents.validate_document(spark, doc)):
        print("both documents have to be valid", file=sys.stderr)
        return 1
    show(d.diff(*(documents.graph(spark, doc) for doc in both)).orderBy("kind", "id").collect())
    return 0


def trace(spark, a) -> int:
    from corrgraph.operators import graph
    from corrgraph.sources import documents

    rows = graph.trace(documents.graph(spark, load(a.graph)), a.entity, a.depth, a.direction, a.relation or None).orderBy("depth", "id").collect()
    show(rows)
    return 0 if rows else 1


def authority(spark, a) -> int:
    from corrgraph.operators import authority as au
    from corrgraph.sources import documents

    asked = spark.createDataFrame([(a.concept, a.fact)], "concept string, fact string")
    show(au.resolve(documents.graph(spark, load(a.graph)), asked).collect())
    return 0


def migrate_sources(spark, a) -> int:
    from corrgraph.sources import adapters

    where = os.path.abspath(a.catalogue)
    rows = adapters.LegacyCatalogue().discover(spark, {"id": "legacy", "path": os.path.basename(where)}, adapters.Context(os.path.dirname(where), a.namespace, a.repository)).orderBy("ord").collect()
    of = lambda kind: [json.loads(r.payload) for r in rows if r.record == kind]
    print(stable_json({"schemaVersion": "2.0.0", "id": f"urn:{a.namespace}:graph:legacy", "namespace": a.namespace, "entities": of("entity"), "mappings": of("mapping"), "authorities": of("authority")}), end="")
    for d in of("diagnostic"):
        print(json.dumps(d), file=sys.stderr)
    return 0


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="corrgraph")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name, run, *names):
        c = sub.add_parser(name)
        for n in names:
            c.add_argument(n)
        c.set_defaults(run=run)
        return c

    command("validate", validate, "graph")
    for name, run in (("compile", compile_), ("promote", promote), ("impact", impact)):
        c = command(name, run, "graph", "policy", *(["output"] if name == "promote" else []))
        c.add_argument("--context")
        c.add_argument("--at", required=True)
        c.add_argument("--changed", action="append")
    c = command("link", link, "graph", "generation", "spec")
    c.add_argument("--format", choices=["json", "typescript", "path-tree", "path-tree-typescript"], default="json")
    c.add_argument("--name", default="projection")
    command("generate", generate, "config").add_argument("--no-cache", action="store_true")
    command("check", check, "config")
    command("diff", diff, "before", "after")
    c = command("migrate-sources", migrate_sources, "catalogue")
    c.add_argument("--namespace", default="legacy")
    c.add_argument("--repository", default="repository")
    c = command("trace", trace, "graph", "entity")
    c.add_argument("--depth", type=int, default=1)
    c.add_argument("--direction", choices=["outgoing", "incoming", "both"], default="both")
    c.add_argument("--relation", action="append")
    command("authority", authority, "graph", "concept", "fact")
    return p


def main(argv: list[str] | None = None, spark=None) -> int:
    try:
        a = parser().parse_args(argv)
    except SystemExit as end:
        return 0 if end.code == 0 else 2
    try:
        return a.run(spark or session(), a)
    except (OSError, ValueError, KeyError) as why:
        print(f"corrgraph: {why}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
