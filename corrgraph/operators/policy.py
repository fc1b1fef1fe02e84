"""Which mappings a policy declares and a context activates; evidence, waivers and policy checks.

A policy's declarations are a table like any other once they are read: a declaration meets its mappings
by an equi-join on what it names, so there may be as many declarations as mappings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corrgraph.functions.context import inactive_reason, required_keys
from corrgraph.functions.identifiers import is_date_time
from corrgraph.operators.graph import Graph
from corrgraph.operators.issues import issues, say, union

#: The codes that a waiver may turn into warnings.
WAIVABLE = ["CONTRADICTING_EVIDENCE", "FORBIDDEN_MAPPING_ACTIVE", "NON_UNIQUE_MAPPING_TARGET", "REQUIRED_AUTHORITY_UNRESOLVED", "REQUIRED_EVIDENCE_MISSING", "REQUIRED_MAPPING_MISSING", "UNDECLARED_LOSSINESS", "UNDECLARED_IMPACT_DIRECTION", "UNVERIFIED_DETERMINISM", "UNVERIFIED_REVERSIBILITY"]


#: Fields of a selector, and the column of a mapping that each is held against.
SELECTOR = {"ids": "id", "relations": "relation", "provenanceStatuses": "status", "sourceKinds": "_source", "targetKinds": "_target"}


def declared(spark, rows: list[tuple], columns: str) -> DataFrame:
    """A table (declaration, ...) of what declarations say."""
    return spark.createDataFrame(rows, f"declaration int, {columns}")


def resolve_declarations(g: Graph, declarations: list[dict]) -> DataFrame:
    """(id, relation, lossiness, transform, declared): the places of the declarations that select each mapping.

    Fields of a selector must all match, any of a field's values does; kinds match if any endpoint has one.
    A declaration joins by its first field, and the mappings it meets are held against its other fields.
    """
    heads = g.mappings.select("id", "relation", "lossiness", "transform", "status")
    wanted = sorted({k for d in declarations for f in ("sourceKinds", "targetKinds") for k in d.get("select", {}).get(f, [])})
    full = heads
    if wanted:
        named = F.broadcast(g.spark.createDataFrame([(k,) for k in wanted], "kind string"))  # as many rows as selectors name kinds
        kinds = g.entities.join(named, "kind", "left_semi").groupBy("id").agg(F.max_by("kind", "ord").alias("kind")).withColumnRenamed("id", "entity_id")
        ends = g.endpoints.select("mapping_id", "side", "entity_id").join(kinds, "entity_id")
        seen = ends.groupBy("mapping_id").agg(*[F.collect_set(F.when(F.col("side") == s, F.col("kind"))).alias(f"_{s}") for s in ("source", "target")])
        full = full.join(seen, F.col("id") == F.col("mapping_id"), "left").drop("mapping_id")
    else:
        full = full.withColumn("_source", F.array().cast("array<string>")).withColumn("_target", F.array().cast("array<string>"))
    by_first: dict[str, list[tuple]] = {f: [] for f in SELECTOR}
    everything = []
    for k, d in enumerate(declarations):
        says = {"ids": [d["mapping"]]} if "mapping" in d else {f: list(v) for f, v in d["select"].items() if f in SELECTOR}
        first = next((f for f in SELECTOR if f in says), None)
        if first is None:
            everything.append(k)
        else:
            by_first[first] += [(k, v, *(says.get(f) for f in SELECTOR)) for v in dict.fromkeys(says[first])]
    hits = [full.select("id", F.explode(F.array(*[F.lit(k) for k in everything])).alias("declaration"))] if everything else []
    for first, rows in by_first.items():
        if not rows:
            continue
        table = declared(g.spark, rows, "_value string, " + ", ".join(f"{f} array<string>" for f in SELECTOR))
        column = SELECTOR[first]
        met = (full.withColumn("_value", F.explode(column)) if column in ("_source", "_target") else full.withColumn("_value", F.col(column))).join(table, "_value")
        for f, other in SELECTOR.items():
            if f != first:
                good = F.arrays_overlap(other, f) if other in ("_source", "_target") else F.array_contains(f, F.col(other))
                met = met.filter(F.col(f).isNull() | F.coalesce(good, F.lit(False)))
        hits.append(met.select("id", "declaration"))
    none = F.array().cast("array<int>")
    if not hits:
        return heads.select("id", "relation", "lossiness", "transform", none.alias("declared"))
    found = union(hits).groupBy(F.col("id").alias("_hit")).agg(F.array_sort(F.collect_set("declaration")).alias("declared"))
    return heads.join(found, F.col("id") == F.col("_hit"), "left").select("id", "relation", "lossiness", "transform", F.coalesce("declared", none).alias("declared"))


def declaration_issues(resolved: DataFrame) -> DataFrame:
    missing = resolved.filter(F.size("declared") == 0)
    twice = resolved.filter(F.size("declared") > 1)
    return issues(missing, "MAPPING_POLICY_MISSING", F.col("id"), say(F.col("id"), " has no declaration")).unionByName(issues(twice, "DUPLICATE_MAPPING_POLICY", F.col("id"), say(F.col("id"), " has ", F.size("declared"), " declarations")))


def selector_counts(resolved: DataFrame, declarations: list[dict]) -> DataFrame:
    """(declaration, n): how many mappings each declaration selects, none included."""
    spark = resolved.sparkSession
    every = spark.createDataFrame([(k,) for k in range(len(declarations))], "declaration int")
    hit = resolved.select(F.explode("declared").alias("declaration")).groupBy("declaration").agg(F.count("*").alias("n"))
    return every.join(hit, "declaration", "left").select("declaration", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def selector_issues(g: Graph, resolved: DataFrame, declarations: list[dict]) -> DataFrame:
    """Declarations that name unknown mappings or select none."""
    spark = g.spark
    named = [(k, d["mapping"], "UNKNOWN_MAPPING_DECLARATION") for k, d in enumerate(declarations) if "mapping" in d]
    named += [(k, i, "UNKNOWN_MAPPING_SELECTOR_ID") for k, d in enumerate(declarations) for i in d.get("select", {}).get("ids", [])]
    rows = spark.createDataFrame(named, "declaration int, named string, code string")
    unknown = rows.join(g.mappings.select(F.col("id").alias("named")), "named", "left_anti")
    selectors = spark.createDataFrame([(k,) for k, d in enumerate(declarations) if "select" in d], "declaration int")
    empty = selector_counts(resolved, declarations).filter("n = 0").join(selectors, "declaration", "left_semi")
    return issues(unknown, F.col("code"), F.col("named"), say(F.col("named"), " is unknown")).unionByName(issues(empty, "EMPTY_MAPPING_SELECTOR", F.col("declaration").cast("string"), say("declaration ", F.col("declaration"), " selects nothing")))


def activation(resolved: DataFrame, declarations: list[dict], context: dict) -> DataFrame:
    """(id, active, reason) of mappings with exactly one declaration. The context is one, so reasons are folded here."""
    reasons = [(k, r) for k, d in enumerate(declarations) if (r := inactive_reason(d.get("applicability"), context))]
    table = declared(resolved.sparkSession, reasons, "reason string")
    single = resolved.filter(F.size("declared") == 1).select("id", F.get("declared", F.lit(0)).alias("declaration"))
    return single.join(table, "declaration", "left").select("id", F.col("reason").isNull().alias("active"), "reason")


def context_issues(resolved: DataFrame, declarations: list[dict], context: dict) -> DataFrame:
    """A key that a declaration's expressions need and the context lacks, for each mapping it selects."""
    lacking = [(k, key) for k, d in enumerate(declarations) for key in sorted(set().union(*(required_keys((d.get("applicability") or {}).get(f)) for f in ("when", "unless"))) - set(context))]
    rows = declared(resolved.sparkSession, lacking, "key string")
    found = resolved.select("id", F.explode("declared").alias("declaration")).join(rows, "declaration")
    return issues(found, "CONTEXT_KEY_MISSING", F.col("id"), say(F.col("id"), " needs context key ", F.col("key")))


def semantic_issues(g: Graph, resolved: DataFrame, declarations: list[dict]) -> DataFrame:
    """What mappings leave undeclared, and claims that transforms do not bear out."""
    silent = resolved.join(g.relations().filter("impact_direction IS NOT NULL").select("relation"), "relation", "left_anti")
    unknown = resolved.filter("lossiness = 'unknown'")
    claims = declared(resolved.sparkSession, [(k, d.get("determinism"), d.get("reversibility")) for k, d in enumerate(declarations)], "determinism string, reversibility string")
    one = resolved.select("*", F.explode("declared").alias("declaration")).join(claims, "declaration")
    flag = lambda name: F.get_json_object("transform", f"$.{name}") == "true"
    steady = one.filter((F.col("determinism") == "deterministic") & F.col("transform").isNotNull() & ~F.coalesce(flag("deterministic"), F.lit(False)))
    back = one.filter(F.col("reversibility") == "reversible")
    lossy = back.filter("lossiness <> 'lossless'")
    claimed = back.filter(F.col("transform").isNotNull() & ~F.coalesce(flag("reversible"), F.lit(False)))
    return union([
        issues(silent, "UNDECLARED_IMPACT_DIRECTION", F.col("id"), say(F.col("relation"), " declares no direction of impact")),
        issues(unknown, "UNDECLARED_LOSSINESS", F.col("id"), say(F.col("id"), " leaves its lossiness open")),
        issues(steady, "UNVERIFIED_DETERMINISM", F.col("id"), say(F.col("id"), " is declared deterministic, its transform is not")),
        issues(lossy, "REVERSIBLE_MAPPING_IS_LOSSY", F.col("id"), say(F.col("id"), " is declared reversible and is ", F.col("lossiness"))),
        issues(claimed, "UNVERIFIED_REVERSIBILITY", F.col("id"), say(F.col("id"), " is declared reversible, its transform is not")),
    ])


def contradictions(g: Graph, evidence: DataFrame, active: DataFrame) -> DataFrame:
    """Contradicting evidence (id, subject, result) on subjects that are active mappings or no mappings."""
    against = evidence.filter("result = 'contradicts'").select("id", "subject")
    idle = g.mappings.select("id").join(active.select("id"), "id", "left_anti").select(F.col("id").alias("subject"))
    found = against.join(idle, "subject", "left_anti")
    return issues(found, "CONTRADICTING_EVIDENCE", F.col("subject"), say(F.col("id"), " contradicts ", F.col("subject")))


def unknown_subjects(g: Graph, document_id: str, named: DataFrame, code: str, more: DataFrame | None = None) -> DataFrame:
    """Subjects (id) that are neither the document, an entity, a mapping nor an authority, nor in `more` (id)."""
    known = union([x.select("id") for x in (g.entities, g.mappings, g.authorities)] + ([more.select("id")] if more is not None else []))
    found = named.select("id").filter(F.col("id") != document_id).join(known, "id", "left_anti")
    return issues(found, code, F.col("id"), say(F.col("id"), " is unknown"))


def duplicate_policy_ids(ids: DataFrame) -> DataFrame:
    """ids: (id) of the policy, its constraints, evidence and waivers."""
    again = ids.groupBy("id").count().filter("count > 1").select("id", F.explode(F.sequence(F.lit(2), F.col("count").cast("int"))).alias("n"))
    return issues(again, "DUPLICATE_POLICY_ID", F.col("id"), say("occurrence ", F.col("n"), " of ", F.col("id")))


def apply_waivers(found: DataFrame, waivers: DataFrame, subjects: DataFrame, now: str) -> tuple[DataFrame, DataFrame]:
    """Issues after waiving, with waived_by, and the waivers' own issues.

    waivers: (waiver, ord, expires_at); subjects: (waiver, code, subject_id), one row for each pair it names.
    Waivers apply in their order, and an issue that one has made a warning is out of reach of the next; so
    each error goes to the first waiver that names it, and a waiver that got none is stale. Expired ones
    are errors and waive nothing.
    """
    clean = is_date_time(F.col("expires_at"))
    wrong, right = waivers.filter(~clean), waivers.filter(clean).withColumn("until", F.try_to_timestamp("expires_at"))
    over = right.filter(F.col("until") <= F.to_timestamp(F.lit(now)))
    live = right.filter(F.col("until") > F.to_timestamp(F.lit(now)))
    named = subjects.filter(F.col("code").isin(WAIVABLE)).join(live.select("waiver", "ord"), "waiver").groupBy("code", "subject_id").agg(F.min_by("waiver", "ord").alias("waived_by"))
    out = found.join(named, ["code", "subject_id"], "left").withColumn("waived_by", F.when(F.col("severity") == "error", F.col("waived_by")))
    out = out.select(F.when(F.col("waived_by").isNotNull(), "warning").otherwise(F.col("severity")).alias("severity"), "code", "message", "subject_id", "waived_by")
    used = out.filter("waived_by IS NOT NULL").select(F.col("waived_by").alias("waiver")).distinct()
    own = union([
        issues(wrong, "INVALID_WAIVER_EXPIRY", F.col("waiver"), say(F.col("waiver"), " has no full date-time")),
        issues(over, "EXPIRED_WAIVER", F.col("waiver"), say(F.col("waiver"), " is over")),
        issues(live.join(used, "waiver", "left_anti"), "STALE_WAIVER", F.col("waiver"), say(F.col("waiver"), " waives nothing"), "warning"),
    ])
    return out, own


def supporting(g: Graph, evidence: DataFrame, active: DataFrame) -> DataFrame:
    """(id) of supporting evidence on some subject that is an active mapping or no mapping."""
    idle = g.mappings.select("id").join(active.select("id"), "id", "left_anti").select(F.col("id").alias("subject"))
    return evidence.filter("result = 'supports'").join(idle, "subject", "left_anti").select("id").distinct()
