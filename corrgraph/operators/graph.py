"""The graph as DataFrames, and its queries: neighbours, trace, reachability, impact.

Endpoints are rows, not arrays: a hub's mapping with a billion targets is a billion rows, which
shuffle and skew-split like any others. Mappings keep a header row each.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corrgraph.functions.relations import RelationRegistry, all_packs
from corrgraph.plans.scratch import is_empty, save

ENTITY = "id string, kind string, label string, attributes string, locators array<string>, ord long"
MAPPING = "id string, relation string, cardinality string, lossiness string, transform string, status string, attributes string, ord long"
ENDPOINT = "mapping_id string, side string, pos long, entity_id string"
AUTHORITY = "id string, concept string, source string, mode string, delegated_from string, ord long"
FACT = "authority_id string, fact string"
#: Entities, mappings and authorities may also have `more`: the record's other members by name, as canonical JSON.
MORE = "map<string,string>"


def more_of(df: DataFrame):
    return F.col("more") if "more" in df.columns else F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))


def row_set(*columns, where=None) -> F.Column:
    """Aggregate: rows as text that equal multisets share: their count and the sums of two independent 64-bit hashes.

    Repeated rows do not cancel, and two different multisets agree with a chance near 2^-128.
    """
    parts = []
    for seed in (11, 97):
        h = F.xxhash64(F.lit(seed), *columns)
        h = F.when(where, h) if where is not None else h
        parts += [F.sum(h.bitwiseAND(0xFFFFFFFF)), F.sum(F.shiftrightunsigned(h, 32))]  # halves: their sums stay in range
    n = F.count(F.when(where, 1)) if where is not None else F.count("*")
    return F.concat_ws(":", n.cast("string"), *[p.cast("string") for p in parts])


@dataclass(frozen=True)
class Graph:
    """entities, mappings, endpoints, authorities and facts, with the registry that explains relations."""

    entities: DataFrame
    mappings: DataFrame
    endpoints: DataFrame
    authorities: DataFrame
    facts: DataFrame
    registry: RelationRegistry

    @property
    def spark(self):
        return self.entities.sparkSession

    def relations(self) -> DataFrame:
        """Small by construction: as many rows as the registered packs declare."""
        return F.broadcast(self.registry.frame(self.spark))

    def only(self, active: DataFrame) -> Graph:
        """The graph without mappings that are not in `active` (id)."""
        ids = active.select(F.col("id").alias("_active"))
        return replace(self, mappings=self.mappings.join(ids, F.col("id") == F.col("_active"), "left_semi"), endpoints=self.endpoints.join(ids, F.col("mapping_id") == F.col("_active"), "left_semi"))


def empty_graph(spark, registry: RelationRegistry | None = None) -> Graph:
    frames = [spark.createDataFrame([], schema) for schema in (ENTITY, MAPPING, ENDPOINT, AUTHORITY, FACT)]
    return Graph(*frames, registry or all_packs())


def side_of(endpoints: DataFrame, side: str, entity: str, pos: str) -> DataFrame:
    return endpoints.filter(F.col("side") == side).select("mapping_id", F.col("entity_id").alias(entity), F.col("pos").alias(pos))


def edges(graph: Graph, relations: list[str] | None = None) -> DataFrame:
    """(mapping_id, relation, src, dst, ord, src_pos, dst_pos): the cross product of each mapping's sides."""
    headers = graph.mappings.select(F.col("id").alias("mapping_id"), "relation", "ord")
    if relations is not None:
        headers = headers.filter(F.col("relation").isin(relations))
    return headers.join(side_of(graph.endpoints, "source", "src", "src_pos"), "mapping_id").join(side_of(graph.endpoints, "target", "dst", "dst_pos"), "mapping_id")


def entity(graph: Graph, name: str) -> DataFrame:
    """The entity of an id, or no row."""
    return graph.entities.filter(F.col("id") == name)


def mapping(graph: Graph, name: str) -> DataFrame:
    """The mapping of an id, or no row."""
    return graph.mappings.filter(F.col("id") == name)


def touching(graph: Graph, relations: list[str] | None = None) -> DataFrame:
    """(mapping_id, side, pos, entity_id, relation, ord, symmetric, impact_direction): each endpoint with its mapping.

    A step goes from an entity to a mapping and from there to the other side, so no mapping's sides are
    multiplied with each other, however wide they are.
    """
    headers = graph.mappings.select(F.col("id").alias("mapping_id"), "relation", "ord")
    if relations is not None:
        headers = headers.filter(F.col("relation").isin(relations))
    headers = headers.join(graph.relations().select("relation", "symmetric", "impact_direction"), "relation", "left")
    return graph.endpoints.select("mapping_id", "side", "pos", "entity_id").join(headers, "mapping_id")


def leaving(touch: DataFrame, direction: str = "both") -> DataFrame:
    """(at, mapping_id, ord, back, own): where steps may enter mappings; symmetric relations go both ways.

    back is 0 for a step to a target and 1 for one to a source, the order in which a visit looks at them.
    """
    if direction not in ("outgoing", "incoming", "both"):
        raise ValueError(f"unknown direction {direction}")
    either, source = F.coalesce("symmetric", F.lit(False)), F.col("side") == "source"
    good = F.when(source, F.lit(direction != "incoming") | either).otherwise(F.lit(direction != "outgoing") | either)
    return touch.filter(good).select(F.col("entity_id").alias("at"), "mapping_id", "ord", F.when(source, 0).otherwise(1).alias("back"), F.col("pos").alias("own"))


def spreading(touch: DataFrame) -> DataFrame:
    """leaving() in the directions in which a change spreads; an unknown relation spreads both ways."""
    way, source = F.coalesce("impact_direction", F.lit("both")), F.col("side") == "source"
    good = (way == "both") | (source & (way == "source-to-target")) | (~source & (way == "target-to-source"))
    return touch.filter(good).select(F.col("entity_id").alias("at"), "mapping_id", "ord", F.when(source, 0).otherwise(1).alias("back"), F.col("pos").alias("own"))


def arriving(touch: DataFrame) -> DataFrame:
    """(mapping_id, back, next, pos): where steps that entered a mapping come out."""
    return touch.select("mapping_id", F.when(F.col("side") == "target", 0).otherwise(1).alias("back"), F.col("entity_id").alias("next"), "pos")


class Visited:
    """What a traversal has seen: tables by level, written together now and then, so a level reads a few."""

    def __init__(self, first: DataFrame, every: int = 6):
        self.tables, self.every = [first], every

    def add(self, level: DataFrame) -> None:
        self.tables.append(level)
        if len(self.tables) > self.every:
            self.tables = [save(self.all(), "visited")]

    def all(self) -> DataFrame:
        out = self.tables[0]
        for table in self.tables[1:]:
            out = out.unionByName(table)
        return out


def mappings_for(graph: Graph, ids: DataFrame, direction: str = "both", relations: list[str] | None = None) -> DataFrame:
    """(entity_id, mapping_id) of the mappings that touch the entities of ids (id) on the side asked for."""
    headers = graph.mappings.select(F.col("id").alias("mapping_id"), "relation").join(graph.relations().select("relation", "symmetric"), "relation", "left")
    if relations is not None:
        headers = headers.filter(F.col("relation").isin(relations))
    side = {"outgoing": F.col("side") == "source", "incoming": F.col("side") == "target", "both": F.lit(True)}[direction]
    touched = graph.endpoints.join(ids.select(F.col("id").alias("entity_id")), "entity_id", "left_semi").join(headers, "mapping_id")
    return touched.filter(side | F.coalesce("symmetric", F.lit(False))).select("entity_id", "mapping_id").distinct()


def neighbors(graph: Graph, ids: DataFrame, direction: str = "both", relations: list[str] | None = None) -> DataFrame:
    """(entity_id, mapping_id, neighbor_id), each once; only entities of the graph are neighbours."""
    touch = touching(graph, relations)
    entered = leaving(touch, direction).join(ids.select(F.col("id").alias("at")), "at", "left_semi").select("at", "mapping_id", "back").distinct()
    known = graph.entities.select(F.col("id").alias("next"))
    found = entered.join(arriving(touch), ["mapping_id", "back"]).filter("at <> next").join(known, "next", "left_semi")
    return found.select(F.col("at").alias("entity_id"), "mapping_id", F.col("next").alias("neighbor_id")).distinct()


def trace(graph: Graph, start: str, max_depth: int = 1, direction: str = "both", relations: list[str] | None = None) -> DataFrame:
    """(id, depth, via_mapping, predecessor): breadth first, each entity once, as its first visit found it.

    A visit's place is a string that sorts as the visits do: its predecessor's place, then the mapping's
    order, targets before sources, then the endpoint's. A level enters each mapping once in a direction,
    by its first visitor, comes out on the other side and picks the first for each entity; no level needs
    a global order.
    """
    if not isinstance(max_depth, int) or isinstance(max_depth, bool) or max_depth < 0:
        raise ValueError("max_depth must be a non-negative integer")
    known = graph.entities.select("id").distinct()
    visited = known.filter(F.col("id") == start).select("id", F.lit(0).alias("depth"), F.lit(None).cast("string").alias("via_mapping"), F.lit(None).cast("string").alias("predecessor"), F.lit("").alias("place"))
    if max_depth == 0:
        return visited.drop("place")
    touch = save(touching(graph, relations), "touch")
    level = save(visited, "level0")
    seen, spent = Visited(level), Visited(graph.spark.createDataFrame([], "mapping_id string, back int"))
    for depth in range(1, max_depth + 1):
        here = level.select(F.col("id").alias("at"), F.col("place").alias("from")).join(leaving(touch, direction), "at")
        entered = here.groupBy("mapping_id", "back", "ord").agg(F.min(F.struct("from", "own", "at")).alias("x")).join(spent.all(), ["mapping_id", "back"], "left_anti")
        entered = save(entered.select("mapping_id", "back", F.col("x.at").alias("at"), F.concat("x.from", F.lpad(F.col("ord").cast("string"), 16, "0"), F.col("back").cast("string")).alias("place")), "entered")
        found = entered.join(arriving(touch), ["mapping_id", "back"]).join(known.select(F.col("id").alias("next")), "next", "left_semi").join(seen.all().select(F.col("id").alias("next")), "next", "left_anti")
        place = F.concat("place", F.lpad(F.col("pos").cast("string"), 12, "0"))
        first = found.groupBy("next").agg(F.min(F.struct(place.alias("place"), "mapping_id", "at")).alias("x"))
        level = save(first.select(F.col("next").alias("id"), F.lit(depth).alias("depth"), F.col("x.mapping_id").alias("via_mapping"), F.col("x.at").alias("predecessor"), F.col("x.place").alias("place")), f"level{depth}")
        if is_empty(level):
            break
        seen.add(level)
        spent.add(entered.select("mapping_id", "back"))
    return seen.all().drop("place")


def reachable(graph: Graph, root: str, relation: str) -> DataFrame:
    """(id, hops) of what the root reaches over one relation, itself included. Each level joins the new nodes alone."""
    touch = save(touching(graph, [relation]), "touch")
    into = touch.filter("side = 'source'").select(F.col("entity_id").alias("id"), "mapping_id")
    out = touch.filter("side = 'target'").select("mapping_id", F.col("entity_id").alias("id"))
    level = save(graph.spark.createDataFrame([(root, 0)], "id string, hops int"), "level")
    seen, spent = Visited(level), Visited(graph.spark.createDataFrame([], "mapping_id string"))
    hops = 0
    while True:
        hops += 1
        entered = save(level.select("id").join(into, "id").select("mapping_id").distinct().join(spent.all(), "mapping_id", "left_anti"), "entered")
        found = entered.join(out, "mapping_id").select("id").distinct().join(seen.all().select("id"), "id", "left_anti")
        level = save(found.withColumn("hops", F.lit(hops)), "level")
        if is_empty(level):
            return seen.all()
        seen.add(level)
        spent.add(entered)


def impact_seeds(graph: Graph, changed: DataFrame, policy_subjects: DataFrame | None = None) -> DataFrame:
    """(id, path, place): changed subjects (id), and what a mapping, authority, constraint or evidence among them stands for.

    Seeds go in the order of their ids, and each one's own subjects before the next seed.
    """
    own = changed.select("id", F.col("id").alias("of"), F.lit(-1).cast("long").alias("n"))
    ends = graph.endpoints.join(changed, F.col("mapping_id") == F.col("id"), "left_semi").select(F.col("entity_id").alias("id"), F.col("mapping_id").alias("of"), (F.when(F.col("side") == "source", 0).otherwise(1_000_000_000) + F.col("pos")).cast("long").alias("n"))
    rules = graph.authorities.join(changed.select(F.col("id").alias("_c")), F.col("id") == F.col("_c"), "left_semi")
    about = rules.select(F.explode(F.array(F.struct(F.col("concept").alias("id"), F.lit(0).cast("long").alias("n")), F.struct(F.col("source").alias("id"), F.lit(1).cast("long").alias("n")))).alias("x"), F.col("id").alias("of")).select("x.id", "of", "x.n")
    seeds = own.unionByName(ends).unionByName(about)
    if policy_subjects is not None:
        seeds = seeds.unionByName(policy_subjects.join(changed.select(F.col("id").alias("of")), "of", "left_semi").select("id", "of", F.col("n").cast("long")))
    place = F.struct("of", "n")
    first = seeds.groupBy("id").agg(F.min(place).alias("p"))
    path = F.when(F.col("p.n") == -1, F.array("id")).otherwise(F.array("p.of", "id"))
    return first.select("id", path.alias("path"), F.concat(F.col("p.of"), F.lit("\u0000"), F.lpad((F.col("p.n") + 1).cast("string"), 12, "0")).alias("place"))


def impact(graph: Graph, changed: DataFrame, active: DataFrame | None = None, policy_subjects: DataFrame | None = None) -> DataFrame:
    """(id, hops, path) of every subject that the changed ones (id) affect, mappings on the way included.

    Many seeds spread at once; each level is one job. A subject keeps the path that was found first.
    """
    graph = graph.only(active) if active is not None else graph
    touch = save(touching(graph), "touch")
    level = save(impact_seeds(graph, changed, policy_subjects).withColumn("hops", F.lit(0)), "seeds")
    seen, spent = Visited(level), Visited(graph.spark.createDataFrame([], "mapping_id string, back int, id string, hops int, path array<string>"))
    hops = 0
    while True:
        hops += 1
        here = level.select(F.col("id").alias("at"), F.col("path").alias("way"), F.col("place").alias("from"), "hops").join(spreading(touch), "at")
        first = here.groupBy("mapping_id", "back", "ord").agg(F.min(F.struct("from", "own", "way", "hops")).alias("x")).join(spent.all().select("mapping_id", "back"), ["mapping_id", "back"], "left_anti")
        entered = save(first.select("mapping_id", "back", F.col("x.own").alias("own"), F.concat("x.way", F.array("mapping_id")).alias("path"), F.concat("x.from", F.lpad(F.col("ord").cast("string"), 16, "0")).alias("from"), F.col("x.hops").alias("hops")), "entered")
        digits = lambda c: F.lpad(c.cast("string"), 12, "0")
        place = F.concat("from", digits(F.when(F.col("back") == 0, F.col("own")).otherwise(F.col("pos"))), digits(F.when(F.col("back") == 0, F.col("pos")).otherwise(F.col("own"))), F.col("back").cast("string"))
        moved = entered.join(arriving(touch), ["mapping_id", "back"]).join(seen.all().select(F.col("id").alias("next")), "next", "left_anti")
        new = moved.groupBy(F.col("next").alias("id")).agg(F.min_by(F.struct(F.concat("path", F.array("next")).alias("path"), place.alias("place")), place).alias("x"))
        level = save(new.select("id", F.col("x.path").alias("path"), F.col("x.place").alias("place"), F.lit(hops).alias("hops")), "front")
        spent.add(entered.select("mapping_id", "back", F.col("mapping_id").alias("id"), "hops", "path"))
        if is_empty(level):
            break
        seen.add(level)
    out = seen.all().select("id", "hops", "path")
    mappings = spent.all().groupBy("id").agg(F.min(F.struct("hops", "path")).alias("x")).select("id", "x.hops", "x.path")
    return out.unionByName(mappings.join(out.select("id"), "id", "left_anti"))


def cyclic_nodes(steps: DataFrame, group: str, strips: int = 2) -> DataFrame:
    """(group, id) of the nodes that leaf stripping leaves: there are some if and only if the group has a cycle.

    A job after the first strips `strips` layers from either end, and one count tells whether it found any.
    """
    steps = save(steps.select(group, "at", "next").distinct(), "edges")
    n, before, layers = steps.count(), -1, 1
    while n and n != before:
        kept = steps
        for _ in range(layers):  # a node on a cycle has an edge in and an edge out
            ends, starts = (kept.select(group, F.col(c).alias("n")).distinct() for c in ("next", "at"))
            kept = kept.join(ends.withColumnRenamed("n", "at"), [group, "at"], "left_semi").join(starts.withColumnRenamed("n", "next"), [group, "next"], "left_semi")
        steps, before, layers = save(kept.select(group, "at", "next"), "edges"), n, strips
        n = steps.count()
    return steps.select(group, F.col("at").alias("id")).distinct()


def relation_cycles(graph: Graph) -> DataFrame:
    """(relation, id) of the nodes left in cycles of relations that forbid them."""
    forbidden = graph.relations().filter("cycle_policy = 'forbid'").select("relation")
    headers = graph.mappings.select(F.col("id").alias("mapping_id"), "relation").join(forbidden, "relation")
    ends = graph.endpoints.join(headers, "mapping_id")
    through = F.concat(F.lit("\u0000"), F.col("mapping_id"))  # a mapping is a node of its own between its sides
    at, next_ = F.when(F.col("side") == "source", F.col("entity_id")).otherwise(through), F.when(F.col("side") == "source", through).otherwise(F.col("entity_id"))
    return cyclic_nodes(ends.select("relation", at.alias("at"), next_.alias("next")), "relation").filter(~F.col("id").startswith("\u0000"))


def first_by(df: DataFrame, key: str, *order) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("_n = 1").drop("_n")
