"""Composition of shards: records merge by id, the first definition wins, other content is a conflict."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corrgraph.functions.canonical import stable_json
from corrgraph.operators.graph import Graph, more_of, row_set
from corrgraph.operators.issues import union

SHARD = 1_000_000_000_000_000
#: The schema version of graph documents. Fixed value.
VERSION = "2.0.0"


class CompositionError(ValueError):
    """Shards that do not compose; `identifier` is the one at fault."""

    def __init__(self, message: str, identifier: str):
        super().__init__(message)
        self.identifier = identifier


def content(g: Graph, kind: str) -> DataFrame:
    """(kind, id, digest): records with a digest of all they say; endpoints and facts enter as sets of rows."""
    digest = lambda df, *columns: df.withColumn("_more", F.array_sort(F.map_entries(more_of(df)))).select(F.lit(kind).alias("kind"), "id", F.sha2(F.to_json(F.struct(*columns, "_more")), 256).alias("digest"))
    if kind == "entity":
        return digest(g.entities, "kind", "label", "attributes", "locators")
    if kind == "mapping":
        ends = g.endpoints.groupBy(F.col("mapping_id").alias("id")).agg(row_set("side", "pos", "entity_id").alias("ends"))
        return digest(g.mappings.join(ends, "id", "left"), "relation", "cardinality", "lossiness", "transform", "status", "attributes", "ends")
    held = g.facts.groupBy(F.col("authority_id").alias("id")).agg(row_set("fact").alias("facts"))
    return digest(g.authorities.join(held, "id", "left"), "concept", "source", "mode", "delegated_from", "facts")


def conflicts(shards: list[Graph]) -> DataFrame:
    """(kind, id, n): ids that shards define in n different ways."""
    parts = [content(g, kind) for kind in ("entity", "mapping", "authority") for g in shards]
    return union(parts).groupBy("kind", "id").agg(F.count_distinct("digest").alias("n")).filter("n > 1")


def merged(frames: list[DataFrame], key: str = "id") -> DataFrame:
    """Rows by id, each from the first shard that has it; `ord` follows the shards, then their own order."""
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.withColumn("ord", F.lit(k * SHARD) + F.col("ord")) for k, df in enumerate(frames)])
    columns = rows.columns
    first = rows.groupBy(key).agg(F.min_by(F.struct(*columns), "ord").alias("x"))
    return first.select(*[F.col(f"x.{c}").alias(c) for c in columns])


def details(shards: list[Graph], field: str, key: str, of: str) -> DataFrame:
    """Detail rows (endpoints, facts) of the first shard that defines their record."""
    owners = reduce(DataFrame.unionByName, [getattr(g, of).select("id", F.lit(k).alias("shard")) for k, g in enumerate(shards)]).groupBy("id").agg(F.min("shard").alias("owner"))
    rows = reduce(DataFrame.unionByName, [getattr(g, field).withColumn("shard", F.lit(k)) for k, g in enumerate(shards)])
    return rows.join(owners, (F.col(key) == F.col("id")) & (F.col("shard") == F.col("owner"))).drop("id", "shard", "owner")


def compose(shards: list[Graph], strict: bool = True) -> Graph:
    """One graph of all shards. With strict, a conflict raises; without, the first definition wins."""
    if not shards:
        raise CompositionError("there is no shard to compose", "")
    if strict:
        found = conflicts(shards).orderBy("kind", "id").limit(1).collect()
        if found:
            raise CompositionError(f"{found[0].kind} {found[0].id} is defined in {found[0].n} ways", found[0].id)
    return replace(
        shards[0],
        entities=merged([g.entities for g in shards]),
        mappings=merged([g.mappings for g in shards]),
        authorities=merged([g.authorities for g in shards]),
        endpoints=details(shards, "endpoints", "mapping_id", "mappings"),
        facts=details(shards, "facts", "authority_id", "authorities"),
    )


def merge_packs(documents: list[dict]) -> list[dict]:
    """The relation packs that documents name, each once; other versions or references of one pack raise."""
    found: dict[str, dict] = {}
    for pack in (p for d in documents for p in d.get("relationPacks", [])):
        have = found.setdefault(pack["id"], pack)
        if have["version"] != pack["version"]:
            raise CompositionError(f"pack {pack['id']} is wanted in versions {have['version']} and {pack['version']}", pack["id"])
        if stable_json(have) != stable_json(pack):
            raise CompositionError(f"pack {pack['id']} is referred to in two ways", pack["id"])
    return list(found.values())


def compose_documents(documents: list[dict], **head) -> dict:
    """One document of shards emitted apart. head: id, namespace and, if there are, label and revision.

    Shards need the one schema version and ids of their own; records merge by id as compose() merges rows.
    """
    if not documents:
        raise CompositionError("there is no shard to compose", "")
    names: set[str] = set()
    for d in documents:
        if d.get("schemaVersion") != VERSION:
            raise CompositionError(f"shard {d.get('id')} has schema version {d.get('schemaVersion')}", d.get("id"))
        if d["id"] in names:
            raise CompositionError(f"two shards are {d['id']}", d["id"])
        names.add(d["id"])
    out = {"schemaVersion": VERSION, **{k: v for k, v in head.items() if v is not None}, "relationPacks": merge_packs(documents)}
    for field in ("entities", "mappings", "authorities"):
        merged_records: dict[str, dict] = {}
        for record in (r for d in documents for r in d.get(field, [])):
            have = merged_records.setdefault(record["id"], record)
            if stable_json(have) != stable_json(record):
                raise CompositionError(f"{field}: {record['id']} is defined in two ways", record["id"])
        out[field] = list(merged_records.values())
    return out | {"metadata": {"composedFrom": [d["id"] for d in documents]}}
