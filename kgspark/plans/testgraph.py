"""A graph over the star-schema tables: raw labels in mixed spellings, and some dirt for the validator.

The text below is plain SQL that Spark runs and that the queries' SQL versions repeat.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from kgspark.plans.graph import Graph, cut, graph

NODES = """
SELECT 'cls:Customer' AS id, 'Customer' AS label, 'Class' AS type, 'Whoever places orders in the shop' AS description, NULL AS pk, NULL AS pv
UNION ALL SELECT 'cls:Supplier', 'Supplier', 'Class', 'Whoever delivers parts', NULL, NULL
UNION ALL SELECT 'cls:Part', 'Part', 'Class', 'What is bought and sold', NULL, NULL
UNION ALL SELECT 'cls:Order', 'Order', 'Class', NULL, NULL, NULL
UNION ALL SELECT 'cls:odd', 'sub-class   of odds', 'Class', NULL, NULL, NULL
UNION ALL SELECT DISTINCT 'seg:' || c_mktsegment, c_mktsegment, 'Class', 'Market segment ' || c_mktsegment, NULL, NULL FROM customer
UNION ALL SELECT DISTINCT 'ptype:' || p_type, p_type, 'Class', 'Part type ' || p_type, NULL, NULL FROM part
UNION ALL SELECT 'region:' || r_regionkey, r_name, 'Instance', '', NULL, NULL FROM region
UNION ALL SELECT 'nation:' || n_nationkey, n_name, 'Instance', 'Nation number ' || n_nationkey, NULL, NULL FROM nation
UNION ALL SELECT 'cust:' || c_custkey, c_name, 'Instance', NULL, 'segment', c_mktsegment FROM customer
UNION ALL SELECT 'supp:' || s_suppkey, s_name, 'Instance', 'Supplier in nation ' || s_nationkey, NULL, NULL FROM supplier
UNION ALL SELECT 'part:' || p_partkey, p_name, 'Instance', 'A part of brand ' || p_brand, 'brand', p_brand FROM part
UNION ALL SELECT DISTINCT 'brand:' || p_brand, p_brand, 'Instance', NULL, NULL, NULL FROM part
UNION ALL SELECT DISTINCT 'mfgr:' || substring(p_brand, 1, 7), 'Maker of ' || substring(p_brand, 1, 7), 'Instance', NULL, NULL, NULL FROM part
UNION ALL SELECT DISTINCT 'lit:size:' || p_size, CAST(p_size AS STRING), 'Literal', NULL, NULL, NULL FROM part
UNION ALL SELECT 'order:' || o_orderkey, 'Order ' || o_orderkey, 'Instance', NULL, 'priority', o_orderpriority FROM orders
"""

EDGES = """
SELECT 'nr:' || n_nationkey AS id, 'nation:' || n_nationkey AS source, 'region:' || n_regionkey AS target,
  CASE n_nationkey % 3 WHEN 0 THEN 'is located in' WHEN 1 THEN 'located_at' ELSE 'Situated In' END AS label FROM nation
UNION ALL SELECT 'cn:' || c_custkey, 'cust:' || c_custkey, 'nation:' || c_nationkey,
  CASE c_custkey % 3 WHEN 0 THEN 'is located in' WHEN 1 THEN 'located_at' ELSE 'Situated In' END FROM customer
UNION ALL SELECT 'sn:' || s_suppkey, 'supp:' || s_suppkey, 'nation:' || s_nationkey,
  CASE s_suppkey % 3 WHEN 0 THEN 'is located in' WHEN 1 THEN 'located_at' ELSE 'Situated In' END FROM supplier
UNION ALL SELECT 'ct:' || c_custkey, 'cust:' || c_custkey, 'seg:' || c_mktsegment,
  CASE c_custkey % 3 WHEN 0 THEN 'is-a' WHEN 1 THEN 'instance of' ELSE 'type' END FROM customer
UNION ALL SELECT 'pt:' || p_partkey, 'part:' || p_partkey, 'ptype:' || p_type,
  CASE p_partkey % 3 WHEN 0 THEN 'is-a' WHEN 1 THEN 'instance of' ELSE 'type' END FROM part
UNION ALL SELECT DISTINCT 'sc:' || c_mktsegment, 'seg:' || c_mktsegment, 'cls:Customer',
  CASE length(c_mktsegment) % 3 WHEN 0 THEN 'is-a' WHEN 1 THEN 'subclass of' ELSE 'kind of' END FROM customer
UNION ALL SELECT DISTINCT 'pc:' || p_type, 'ptype:' || p_type, 'cls:Part',
  CASE length(p_type) % 3 WHEN 0 THEN 'is-a' WHEN 1 THEN 'subclass of' ELSE 'kind of' END FROM part
UNION ALL SELECT 'sp:' || l_suppkey || ':' || l_partkey, 'supp:' || l_suppkey, 'part:' || l_partkey,
  CASE l_partkey % 3 WHEN 0 THEN 'produces' WHEN 1 THEN 'develops' ELSE 'makes' END FROM lineitem GROUP BY l_suppkey, l_partkey
UNION ALL SELECT 'ps:' || l_suppkey || ':' || l_partkey, 'part:' || l_partkey, 'supp:' || l_suppkey, 'made by'
  FROM lineitem GROUP BY l_suppkey, l_partkey HAVING max(l_quantity) >= 50
UNION ALL SELECT 'pb:' || p_partkey, 'part:' || p_partkey, 'brand:' || p_brand, 'is a member of' FROM part
UNION ALL SELECT DISTINCT 'bm:' || p_brand, 'brand:' || p_brand, 'mfgr:' || substring(p_brand, 1, 7), 'component of' FROM part
UNION ALL SELECT 'pl:' || p_partkey, 'part:' || p_partkey, 'lit:size:' || p_size, 'has value' FROM part
UNION ALL SELECT 'oc:' || o_orderkey, 'order:' || o_orderkey, 'cust:' || o_custkey, 'belongs to' FROM orders
UNION ALL SELECT 'ob:' || o_orderkey, 'order:' || o_orderkey, 'cust:' || o_custkey, 'ordered by' FROM orders WHERE o_orderstatus = 'F'
UNION ALL SELECT 'oo:' || o_orderkey, 'order:' || prev, 'order:' || o_orderkey, CASE o_orderkey % 2 WHEN 0 THEN 'precedes' ELSE 'before' END FROM
  (SELECT o_orderkey, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS prev FROM orders) WHERE prev IS NOT NULL
UNION ALL SELECT 'ss:' || a.c_mktsegment || ':' || b.c_mktsegment, 'seg:' || a.c_mktsegment, 'seg:' || b.c_mktsegment, 'disjoint with'
  FROM (SELECT DISTINCT c_mktsegment FROM customer) a JOIN (SELECT DISTINCT c_mktsegment FROM customer) b ON a.c_mktsegment < b.c_mktsegment
UNION ALL SELECT 'x1:' || c_custkey, 'cust:' || c_custkey, 'cust:' || c_custkey, 'related to' FROM customer WHERE c_custkey % 97 = 0
UNION ALL SELECT 'x2:' || c_custkey, 'cust:' || c_custkey, 'gone:' || c_custkey, 'uses' FROM customer WHERE c_custkey % 101 = 0
UNION ALL SELECT 'x3:' || c_custkey, 'cust:' || c_custkey, 'nation:' || c_nationkey, '' FROM customer WHERE c_custkey % 89 = 0
UNION ALL SELECT 'x4:' || p_partkey, 'lit:size:' || p_size, 'part:' || p_partkey, 'related to' FROM part WHERE p_partkey % 97 = 0
UNION ALL SELECT 'x5:' || c_custkey, 'cust:' || c_custkey, 'seg:BUILDING', 'is-a' FROM customer WHERE c_custkey % 103 = 0
UNION ALL SELECT 'x6:' || p_partkey, 'part:' || p_partkey, 'supp:1', 'is-a' FROM part WHERE p_partkey % 107 = 0
"""

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")


def load(spark: SparkSession, sf_dir: str, stored: bool = True) -> Graph:
    """The graph; stored once in the checkpoint folder, as most operators read it several times."""
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES}
    nodes, edges = spark.sql(_bound(NODES), **tables), spark.sql(_bound(EDGES), **tables)
    pair = F.struct(F.col("pk").alias("key"), F.col("pv").alias("value"))
    nodes = nodes.withColumn("properties", F.when(F.col("pk").isNotNull(), F.array(pair))).drop("pk", "pv")
    g = graph(nodes, edges)
    return Graph(cut(g.nodes), cut(g.edges)) if stored else g


def _bound(sql: str) -> str:
    import re

    return re.sub(rf"\b(FROM|JOIN) ({'|'.join(TABLES)})\b", r"\1 {\2}", sql)


#: CTEs nodes, edges for the SQL versions.
BASE = f"nodes AS ({NODES}), edges AS ({EDGES})"

#: CTEs voc, typed, norm, fact0: the raw labels that occur, resolved by the types of their ends.
NORM = f"""{BASE},
voc(label, found, flipped) AS (VALUES
  ('is located in', 'located-in', false), ('located_at', 'located-in', false), ('Situated In', 'located-in', false),
  ('is-a', 'rdfs:subClassOf', false), ('subclass of', 'rdfs:subClassOf', false), ('kind of', 'rdfs:subClassOf', false),
  ('instance of', 'rdf:type', false), ('type', 'rdf:type', false),
  ('produces', 'produces', false), ('develops', 'produces', false), ('makes', 'produces', false), ('made by', 'produces', true),
  ('is a member of', 'member-of', false), ('component of', 'part-of', false), ('belongs to', 'part-of', false), ('has value', 'has-property', false),
  ('precedes', 'precedes', false), ('before', 'precedes', false), ('disjoint with', 'owl:disjointWith', false),
  ('related to', 'related-to', false), ('uses', 'uses', false)),
typed AS (
  SELECT e.id, e.label AS raw, v.found, coalesce(v.flipped, false) AS flipped,
    CASE WHEN v.flipped THEN e.target ELSE e.source END AS source, CASE WHEN v.flipped THEN e.source ELSE e.target END AS target,
    CASE WHEN v.flipped THEN t.type ELSE s.type END AS st, CASE WHEN v.flipped THEN s.type ELSE t.type END AS tt
  FROM edges e LEFT JOIN voc v ON v.label = e.label LEFT JOIN nodes s ON s.id = e.source LEFT JOIN nodes t ON t.id = e.target),
res AS (
  SELECT id, raw, source, target, st, tt, flipped,
    CASE WHEN found IS NULL AND raw = '' THEN 'related-to' WHEN found IS NULL THEN 'custom'
      WHEN found IN ('rdfs:subClassOf', 'rdf:type') AND tt NOT IN ('Instance', 'Literal') THEN CASE WHEN st NOT IN ('Instance', 'Literal') THEN 'rdfs:subClassOf' ELSE 'rdf:type' END
      WHEN found IN ('rdfs:subClassOf', 'rdf:type') AND st = 'Instance' AND tt = 'Instance' THEN 'related-to'
      ELSE found END AS relation,
    CASE WHEN found IS NULL AND raw = '' THEN 'empty label → related-to'
      WHEN found IN ('rdfs:subClassOf', 'rdf:type') AND st = 'Instance' AND tt = 'Instance' THEN 'is-a between two instances → related-to' END AS note
  FROM typed),
norm AS (
  SELECT id, raw, source, target, st, tt, relation, label, note FROM (
    SELECT *, CASE WHEN relation = 'custom' THEN raw ELSE relation END AS label FROM res WHERE source <> target)
  QUALIFY row_number() OVER (PARTITION BY label,
    CASE WHEN label IN ('related-to', 'owl:disjointWith') THEN least(source, target) ELSE source END,
    CASE WHEN label IN ('related-to', 'owl:disjointWith') THEN greatest(source, target) ELSE target END ORDER BY id) = 1),
fact0 AS (SELECT DISTINCT source AS s, label AS p, target AS o FROM norm WHERE source IN (SELECT id FROM nodes) AND target IN (SELECT id FROM nodes))"""

#: CTE fact: the closure as a set, after NORM in a WITH RECURSIVE.
CLOSURE = f"""{NORM},
comp(p1, p2, p) AS (VALUES ('rdfs:subClassOf', 'rdfs:subClassOf', 'rdfs:subClassOf'), ('part-of', 'part-of', 'part-of'), ('located-in', 'located-in', 'located-in'),
  ('precedes', 'precedes', 'precedes'), ('member-of', 'part-of', 'member-of'), ('part-of', 'located-in', 'located-in'), ('rdf:type', 'rdfs:subClassOf', 'rdf:type')),
trail(s, p, o) AS (
  SELECT s, p, o FROM fact0 WHERE p IN (SELECT p1 FROM comp) UNION
  SELECT t.s, c.p, f.o FROM trail t JOIN comp c ON c.p1 = t.p JOIN fact0 f ON f.s = t.o AND f.p = c.p2),
fact AS (SELECT * FROM fact0 UNION SELECT * FROM trail UNION SELECT o, p, s FROM fact0 WHERE p IN ('related-to', 'owl:disjointWith'))"""
