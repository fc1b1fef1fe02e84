"""The star schema as a graph: tables become entities, foreign keys become mappings.

`broken` leaves out and adds rows by fixed rules, so that every integrity rule has something to find.
The same definitions are stated in SQL (LENS_SQL) for the checks of the queries.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corrgraph.functions.relations import all_packs
from corrgraph.operators.graph import Graph

#: Table, prefix of its columns, key, name column; the place gives the order of its entities.
TABLES = [
    ("region", "region", "r_regionkey", "r_name"),
    ("nation", "nation", "n_nationkey", "n_name"),
    ("customer", "customer", "c_custkey", "c_name"),
    ("supplier", "supplier", "s_suppkey", "s_name"),
    ("part", "part", "p_partkey", "p_name"),
    ("order", "orders", "o_orderkey", None),
]
STEP = 1_000_000_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def urn(kind: str, key) -> F.Column:
    return F.concat(F.lit(f"urn:tpch:{kind}:"), F.col(key).cast("string"))


def entities(spark: SparkSession, sf_dir: str, broken: bool = False) -> DataFrame:
    parts = []
    for k, (kind, name, key, label) in enumerate(TABLES):
        df = table(spark, sf_dir, name)
        if broken and kind in ("customer", "part"):
            df = df.filter(F.col(key) % 97 != 0)
        status = F.concat(F.lit('{"status":"'), F.col("o_orderstatus"), F.lit('"}')) if kind == "order" else F.lit("{}")
        row = df.select(urn(kind, key).alias("id"), F.lit(f"tpch:{kind}").alias("kind"), (F.col(label) if label else F.concat(F.lit("order "), F.col(key).cast("string"))).alias("label"), status.alias("attributes"), F.array().cast("array<string>").alias("locators"), (F.lit(k * STEP) + F.col(key)).alias("ord"))
        parts.append(row)
        if broken and kind == "supplier":
            parts.append(row.filter(F.col("ord") % 50 == 0).withColumns({"label": F.lit("again"), "ord": F.col("ord") + 100 * STEP}))
    return reduce(DataFrame.unionByName, parts)


def linked(spark: SparkSession, sf_dir: str, broken: bool = False) -> DataFrame:
    """One row per endpoint pair (mapping name, key of the mapping, source, target) before grouping."""
    nation, orders = table(spark, sf_dir, "nation"), table(spark, sf_dir, "orders")
    customer, supplier, item = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier"), table(spark, sf_dir, "lineitem")
    row = lambda df, name, key, source, target, pos: df.select(F.lit(name).alias("name"), F.col(key).cast("long").alias("key"), source.alias("source"), target.alias("target"), F.col(pos).cast("long").alias("pos"))
    lines = item.join(orders.select("o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    parts = lines.select("l_orderkey", "l_partkey").distinct()
    if broken:  # some orders list a part twice
        parts = parts.unionByName(parts.filter("l_orderkey % 109 = 0"))
    out = [
        row(nation, "region-nations", "n_regionkey", urn("region", "n_regionkey"), urn("nation", "n_nationkey"), "n_nationkey"),
        row(customer, "nation-customers", "c_nationkey", urn("nation", "c_nationkey"), urn("customer", "c_custkey"), "c_custkey"),
        row(supplier, "nation-suppliers", "s_nationkey", urn("nation", "s_nationkey"), urn("supplier", "s_suppkey"), "s_suppkey"),
        row(orders, "order-customer", "o_orderkey", urn("order", "o_orderkey"), urn("customer", "o_custkey"), "o_custkey"),
        row(parts, "order-parts", "l_orderkey", urn("order", "l_orderkey"), urn("part", "l_partkey"), "l_partkey"),
        row(lines.select("l_orderkey", "l_suppkey").distinct(), "order-suppliers", "l_orderkey", urn("order", "l_orderkey"), urn("supplier", "l_suppkey"), "l_suppkey"),
    ]
    if broken:
        out.append(row(nation.filter("n_nationkey % 10 = 0"), "nation-region", "n_nationkey", urn("nation", "n_nationkey"), urn("region", "n_regionkey"), "n_regionkey"))
    return reduce(DataFrame.unionByName, out)


ORDER = ["region-nations", "nation-customers", "nation-suppliers", "order-customer", "order-parts", "order-suppliers", "nation-region"]


def graph(spark: SparkSession, sf_dir: str, broken: bool = False) -> Graph:
    rows = linked(spark, sf_dir, broken)
    mapping_id = F.concat(F.lit("urn:map:"), F.col("name"), F.lit(":"), F.col("key").cast("string"))
    pairs = rows.select(mapping_id.alias("mapping_id"), "name", "key", "source", "target", "pos")
    targets = pairs.select("mapping_id", F.lit("target").alias("side"), "pos", F.col("target").alias("entity_id"))
    sources = pairs.select("mapping_id", F.lit("source").alias("side"), F.lit(0).cast("long").alias("pos"), F.col("source").alias("entity_id")).distinct()
    status = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("key"), "o_orderstatus")
    heads = pairs.groupBy("mapping_id", "name", "key").agg(F.count("*").alias("n"))
    heads = heads.join(status, "key", "left")
    relation = F.when(F.col("name").isin("order-parts", "order-suppliers"), "core:references").when(F.col("name") == "order-customer", "core:depends_on").otherwise("core:contains")
    cardinality = F.when(F.col("n") == 1, "one-to-one").otherwise("one-to-many")
    if broken:
        relation = F.when((F.col("name") == "order-suppliers") & (F.col("key") % 101 == 0), "tpch:unknown").when((F.col("name") == "nation-suppliers") & (F.col("key") % 5 == 0), "routing:emits").otherwise(relation)
        cardinality = F.when((F.col("name") == "order-customer") & (F.col("key") % 103 == 0), "many-to-one").when((F.col("name") == "order-parts") & (F.col("key") % 107 == 0), "one-to-one").otherwise(cardinality)
    lossiness = F.when(~F.col("name").startswith("order"), "lossless").when(F.col("o_orderstatus") == "F", "lossless").when(F.col("o_orderstatus") == "O", "lossy").otherwise("unknown")
    place = reduce(lambda c, k: c.when(F.col("name") == ORDER[k], k), range(1, len(ORDER)), F.when(F.col("name") == ORDER[0], 0))
    mappings = heads.select(F.col("mapping_id").alias("id"), relation.alias("relation"), cardinality.alias("cardinality"), lossiness.alias("lossiness"), F.lit(None).cast("string").alias("transform"), F.lit("declared").alias("status"), F.lit("{}").alias("attributes"), (place * F.lit(STEP) + F.col("key")).alias("ord"))
    rules, facts = authorities(spark, sf_dir)
    return Graph(entities(spark, sf_dir, broken), mappings, sources.unionByName(targets), rules, facts, all_packs())


#: By rank within the nation: mode, rank of the parent, facts; rank 4 differs where the nation's key divides by 6.
RANKS = [
    (1, "canonical", None, ["*"]),
    (2, "delegated", 1, ["price", "stock"]),
    (3, "delegated", 2, ["price"]),
    (4, "candidate", None, ["price"]),
    (5, "delegated", 1, ["stock"]),
    (6, "candidate", None, ["stock"]),
]


def authorities(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Up to six authorities for each nation, held by its first suppliers."""
    ranked = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.slice(F.array_sort(F.collect_set("s_suppkey")), 1, 6).alias("all"))
    held = ranked.select(F.col("s_nationkey").alias("n"), F.posexplode("all").alias("p", "s"), "all").withColumn("rank", F.col("p") + 1)
    plan = F.broadcast(spark.createDataFrame(RANKS, "rank int, mode string, parent int, facts array<string>"))
    held = held.join(plan, "rank")
    sixth = (F.col("n") % 6 == 0) & (F.col("rank") == 4)
    widened = (F.col("n") % 4 == 0) & (F.col("rank") == 3)
    circle = F.col("n") % 8 == 1
    name = lambda rank: F.concat(F.lit("urn:tpch:authority:"), F.col("n").cast("string"), F.lit("-"), rank.cast("string"))
    mode = F.when(sixth, "canonical").when(circle & (F.col("rank") >= 5), "delegated").otherwise(F.col("mode"))
    parent = F.when(circle & (F.col("rank") == 5), 6).when(circle & (F.col("rank") == 6), 5).otherwise(F.col("parent"))
    rows = held.select(name(F.col("rank")).alias("id"), urn("nation", "n").alias("concept"), urn("supplier", "s").alias("source"), mode.alias("mode"), F.when(mode == "delegated", name(parent)).alias("delegated_from"), (F.col("n").cast("long") * 10 + F.col("rank")).alias("ord"), F.when(widened, F.array(F.lit("price"), F.lit("quality"))).otherwise(F.col("facts")).alias("facts"))
    return rows.drop("facts"), rows.select(F.col("id").alias("authority_id"), F.explode("facts").alias("fact"))


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, subject, kind, result, confidence) from events."""
    e = table(spark, sf_dir, "events")
    result = F.when(F.col("event_type") == "purchase", "supports").when(F.col("event_type") == "error", "contradicts").otherwise("inconclusive")
    return e.select(F.concat(F.lit("urn:tpch:event:"), F.col("event_id").cast("string")).alias("id"), urn("customer", "user_id").alias("subject"), F.col("event_type").alias("kind"), result.alias("result"), (F.col("event_id") % 101 / 100.0).alias("confidence"))


LENS_SQL = r"""
WITH RECURSIVE entities AS MATERIALIZED (
  SELECT 'urn:tpch:region:' || r_regionkey AS id, 'tpch:region' AS kind, r_name AS label, '{}' AS attributes FROM region
  UNION ALL SELECT 'urn:tpch:nation:' || n_nationkey, 'tpch:nation', n_name, '{}' FROM nation
  UNION ALL SELECT 'urn:tpch:customer:' || c_custkey, 'tpch:customer', c_name, '{}' FROM customer {{customers}}
  UNION ALL SELECT 'urn:tpch:supplier:' || s_suppkey, 'tpch:supplier', s_name, '{}' FROM supplier
  UNION ALL SELECT 'urn:tpch:part:' || p_partkey, 'tpch:part', p_name, '{}' FROM part {{parts}}
  UNION ALL SELECT 'urn:tpch:order:' || o_orderkey, 'tpch:order', 'order ' || o_orderkey, '{"status":"' || o_orderstatus || '"}' FROM orders {{twins}}),
linked AS (
  SELECT 'region-nations' AS name, n_regionkey AS key, 'urn:tpch:region:' || n_regionkey AS src, 'urn:tpch:nation:' || n_nationkey AS dst FROM nation
  UNION ALL SELECT 'nation-customers', c_nationkey, 'urn:tpch:nation:' || c_nationkey, 'urn:tpch:customer:' || c_custkey FROM customer
  UNION ALL SELECT 'nation-suppliers', s_nationkey, 'urn:tpch:nation:' || s_nationkey, 'urn:tpch:supplier:' || s_suppkey FROM supplier
  UNION ALL SELECT 'order-customer', o_orderkey, 'urn:tpch:order:' || o_orderkey, 'urn:tpch:customer:' || o_custkey FROM orders
  UNION ALL SELECT 'order-parts', l_orderkey, 'urn:tpch:order:' || l_orderkey, 'urn:tpch:part:' || l_partkey FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders)) {{double}}
  UNION ALL SELECT 'order-suppliers', l_orderkey, 'urn:tpch:order:' || l_orderkey, 'urn:tpch:supplier:' || l_suppkey FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders)) {{back}}),
heads AS (SELECT 'urn:map:' || name || ':' || key AS id, name, key, count(*) AS n FROM linked GROUP BY ALL),
mappings AS MATERIALIZED (
  SELECT h.id, h.name, h.key, h.n, {{relation}} AS relation, {{cardinality}} AS cardinality,
         CASE WHEN name NOT LIKE 'order%' THEN 'lossless' WHEN o_orderstatus = 'F' THEN 'lossless' WHEN o_orderstatus = 'O' THEN 'lossy' ELSE 'unknown' END AS lossiness
  FROM heads h LEFT JOIN orders ON o_orderkey = key AND name LIKE 'order%'),
edges AS MATERIALIZED (SELECT DISTINCT m.id AS mapping_id, relation, lossiness, src, dst FROM mappings m JOIN linked l ON l.name = m.name AND l.key = m.key),
endpoints AS (SELECT mapping_id, 'source' AS side, src AS entity_id FROM edges UNION SELECT mapping_id, 'target', dst FROM edges),
ranked AS (SELECT s_nationkey AS n, s_suppkey AS s, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS r FROM (SELECT DISTINCT s_nationkey, s_suppkey FROM supplier) QUALIFY r <= 6),
authorities AS (
  SELECT 'urn:tpch:authority:' || n || '-' || r AS id, 'urn:tpch:nation:' || n AS concept, 'urn:tpch:supplier:' || s AS source,
         CASE WHEN r = 1 OR (r = 4 AND n % 6 = 0) THEN 'canonical' WHEN r IN (2, 3, 5) OR (r = 6 AND n % 8 = 1) THEN 'delegated' ELSE 'candidate' END AS mode,
         CASE WHEN r = 2 THEN 'urn:tpch:authority:' || n || '-1' WHEN r = 3 THEN 'urn:tpch:authority:' || n || '-2'
              WHEN r = 5 THEN 'urn:tpch:authority:' || n || CASE WHEN n % 8 = 1 THEN '-6' ELSE '-1' END
              WHEN r = 6 AND n % 8 = 1 THEN 'urn:tpch:authority:' || n || '-5' END AS delegated_from,
         n * 10 + r AS ord,
         CASE WHEN r = 1 THEN ['*'] WHEN r = 2 THEN ['price', 'stock'] WHEN r = 3 AND n % 4 = 0 THEN ['price', 'quality'] WHEN r IN (3, 4) THEN ['price'] ELSE ['stock'] END AS facts
  FROM ranked),
facts AS (SELECT id AS authority_id, unnest(facts) AS fact FROM authorities),
evidence AS (
  SELECT 'urn:tpch:event:' || event_id AS id, 'urn:tpch:customer:' || user_id AS subject, event_type AS kind,
         CASE event_type WHEN 'purchase' THEN 'supports' WHEN 'error' THEN 'contradicts' ELSE 'inconclusive' END AS result, (event_id % 101) / 100.0 AS confidence
  FROM events),
relations(relation, cards, cycle_policy, impact, kinds) AS (VALUES {{relations}})
"""


def lens_sql(body: str, broken: bool = False) -> str:
    """A DuckDB statement over the lens; body follows its common tables."""
    from corrgraph.functions.relations import all_packs as packs

    kind = "CASE WHEN name IN ('order-parts', 'order-suppliers') THEN 'core:references' WHEN name = 'order-customer' THEN 'core:depends_on' ELSE 'core:contains' END"
    size = "CASE WHEN n = 1 THEN 'one-to-one' ELSE 'one-to-many' END"
    fill = {"customers": "", "parts": "", "twins": "", "double": "", "back": "", "relation": kind, "cardinality": size}
    if broken:
        fill |= {
            "customers": "WHERE c_custkey % 97 <> 0",
            "parts": "WHERE p_partkey % 97 <> 0",
            "twins": "UNION ALL SELECT 'urn:tpch:supplier:' || s_suppkey, 'tpch:supplier', 'again', '{}' FROM supplier WHERE s_suppkey % 50 = 0",
            "double": "UNION ALL SELECT 'order-parts', l_orderkey, 'urn:tpch:order:' || l_orderkey, 'urn:tpch:part:' || l_partkey FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE l_orderkey % 109 = 0 AND l_orderkey IN (SELECT o_orderkey FROM orders))",
            "back": "UNION ALL SELECT 'nation-region', n_nationkey, 'urn:tpch:nation:' || n_nationkey, 'urn:tpch:region:' || n_regionkey FROM nation WHERE n_nationkey % 10 = 0",
            "relation": f"CASE WHEN name = 'order-suppliers' AND key % 101 = 0 THEN 'tpch:unknown' WHEN name = 'nation-suppliers' AND key % 5 = 0 THEN 'routing:emits' ELSE {kind} END",
            "cardinality": f"CASE WHEN name = 'order-customer' AND key % 103 = 0 THEN 'many-to-one' WHEN name = 'order-parts' AND key % 107 = 0 THEN 'one-to-one' ELSE {size} END",
        }
    listed = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]" if xs else "NULL::VARCHAR[]"
    fill["relations"] = ", ".join(f"('{r.id}', {listed(r.cardinalities)}, '{r.cycle_policy}', '{r.impact_direction}', {listed(sorted({*(r.source_kinds or ()), *(r.target_kinds or ())}))})" for r in packs().all())
    head = LENS_SQL
    for k, v in fill.items():
        head = head.replace("{{" + k + "}}", v)
    return head + body
