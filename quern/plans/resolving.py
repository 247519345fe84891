"""Entities, their resolution and their graph over tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions import text
from quern.operators import graph, identity
from quern.plans.tables import table


def entity_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of each block, as written and normalised."""
    p = table(spark, sf_dir, "part").select("p_brand", text.normalised_name("p_name").alias("nn"))
    return p.groupBy("p_brand").agg(F.count("*").alias("n"), F.count_distinct("nn").alias("n_names"))


def trigram_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of names of a brand, by prefix-filtered trigrams."""
    near, _ = identity.trigram_pairs(table(spark, sf_dir, "part"), "p_partkey", "p_name", ["p_brand"], 0.5)
    return near.where("nn <> nn_b").select("p_brand", F.col("nn").alias("a"), F.col("nn_b").alias("b"), "similarity")


def cosine_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.cosine_band(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label", (0.3, 0.6))


def cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of a brand through all stages: a part's alias is its first word with
    "widget", its vector the one of its number."""
    p = table(spark, sf_dir, "part").withColumn("aliases", F.array(F.concat(F.substring_index("p_name", " ", 1), F.lit(" Widget!"))))
    v = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return identity.cascade(p, "p_partkey", "p_name", "p_brand", "aliases", v, 0.5, (0.2, 0.3))


def _merges(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Parts of one brand and name merge into the first of them; merges of another
    size than the first's are taken back."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_brand", "p_name", "p_size")
    first = Window.partitionBy("p_brand", "p_name").orderBy("id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    m = p.withColumn("winner_id", F.first("id").over(first)).withColumn("size_w", F.first("p_size").over(first)).where("winner_id <> id")
    merged = m.select(F.col("id").alias("loser_id"), "winner_id", F.lit("merge").alias("kind"), F.lit(1).alias("seq"))
    undone = m.where("p_size <> size_w").select(F.col("id").alias("loser_id"), "winner_id", F.lit("unmerge").alias("kind"), F.lit(2).alias("seq"))
    return p, merged.unionByName(undone)


def soft_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merges and their reversals as events; the view follows the last."""
    return identity.merged_view(*_merges(spark, sf_dir)).select("id", "merged_into", "status")


def merge_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a customer as a chain, each merged into the one before."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    before = F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    edges = o.withColumn("parent", before).where("parent IS NOT NULL").select(F.col("o_orderkey").alias("child"), "parent")
    return identity.roots(edges, "child", "parent", o.select("o_orderkey"))


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions, nations, suppliers and customers, linked."""
    node = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    n = table(spark, sf_dir, "nation").select(node("r", "n_regionkey").alias("src"), node("n", "n_nationkey").alias("dst"))
    s = table(spark, sf_dir, "supplier").select(node("n", "s_nationkey").alias("src"), node("s", "s_suppkey").alias("dst"))
    c = table(spark, sf_dir, "customer").select(node("n", "c_nationkey").alias("src"), node("c", "c_custkey").alias("dst"))
    return n.union(s).union(c)


def _seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("seed"))


def neighbours_1hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.neighbours(_places(spark, sf_dir), _seeds(spark, sf_dir), 1)


def neighbours_2hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.neighbours(_places(spark, sf_dir), _seeds(spark, sf_dir), 2)


def cooccurrence_without_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers of two common orders or more that are not of one nation."""
    return graph.apart(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_suppkey", table(spark, sf_dir, "supplier"), "s_suppkey", "s_nationkey")


def graph_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"))
    edges = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("src"), F.col("n_regionkey").alias("dst"), F.lit("in").alias("label"))
    return graph.to_json(nodes, edges)


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "region")
    n = table(spark, sf_dir, "nation")
    return n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("src"), F.col("n_name").alias("src_name"), (F.col("r_regionkey") + 1000).alias("dst"), F.col("r_name").alias("dst_name"), F.lit("in").alias("label"))


def graph_mermaid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.to_mermaid(_named(spark, sf_dir))


def graph_cypher(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.to_cypher(_named(spark, sf_dir))


def graph_graphml(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    return graph.to_graphml(nodes, _named(spark, sf_dir))


QUERIES = {f.__name__: f for f in (entity_block, trigram_pairs, cosine_band, cascade, soft_merge, merge_root, neighbours_1hop, neighbours_2hop, cooccurrence_without_edge, graph_json, graph_mermaid, graph_cypher, graph_graphml)}

_NAME = r"trim(regexp_replace(lower(regexp_replace(p_name, '[^\p{L}\p{N}\s]', '', 'g')), '\s+', ' ', 'g'))"
_EDGES = """
x AS (SELECT 'r' || n_regionkey AS a, 'n' || n_nationkey AS b FROM nation UNION SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier UNION SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer),
e AS (SELECT a AS src, b AS dst FROM x UNION SELECT b, a FROM x),
h1 AS (SELECT DISTINCT src AS seed, dst AS node FROM e WHERE src IN (SELECT 'r' || r_regionkey FROM region))"""
_JOINED = "FROM nation JOIN region ON n_regionkey = r_regionkey"
SQL = {
    "entity_block": f"SELECT p_brand, count(*) AS n, count(DISTINCT {_NAME}) AS n_names FROM part GROUP BY p_brand",
    "trigram_pairs": f"""
WITH k AS (SELECT DISTINCT p_brand, {_NAME} AS nn FROM part),
t AS (SELECT p_brand, nn, list_distinct(list_transform(range(1, length(nn) + 2), lambda i: substr('  ' || nn || ' ', i, 3))) AS g FROM k WHERE nn <> ''),
j AS (SELECT x.p_brand, x.nn AS a, y.nn AS b, len(list_intersect(x.g, y.g)) AS c, len(x.g) + len(y.g) AS s FROM t x JOIN t y ON x.p_brand = y.p_brand AND x.nn < y.nn)
SELECT p_brand, a, b, round(c / (s - c), 6) AS similarity FROM j WHERE round(c / (s - c), 6) >= 0.5
""",
    "cosine_band": """
WITH d AS (SELECT a.vec_id AS a, b.vec_id AS b, round(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda x: CAST(x[1] AS DOUBLE) * CAST(x[2] AS DOUBLE))) / (sqrt(list_sum(list_transform(a.embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) * sqrt(list_sum(list_transform(b.embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))))), 6) AS similarity
  FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id)
SELECT a, b, similarity FROM d WHERE similarity BETWEEN 0.3 AND 0.6
""",
    "cascade": f"""
WITH n AS (SELECT p_partkey AS id, p_brand AS kind, {_NAME} AS nn, string_split(p_name, ' ')[1] || ' Widget!' AS alias FROM part WHERE p_name IS NOT NULL AND p_brand IS NOT NULL),
r AS (SELECT kind, nn, min(id) AS rep FROM n WHERE nn <> '' GROUP BY kind, nn),
t AS (SELECT *, list_distinct(list_transform(range(1, length(nn) + 2), lambda i: substr('  ' || nn || ' ', i, 3))) AS g FROM r),
v AS (SELECT t.*, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM t JOIN embeddings ON vec_id = rep),
s AS (SELECT rep AS a, id AS b, 0 AS stage, 1.0 AS score FROM n JOIN r USING (kind, nn) WHERE id <> rep
  UNION ALL SELECT x.rep, y.rep, 1, 1.0 FROM (SELECT kind, nn, trim(regexp_replace(lower(regexp_replace(alias, '[^\\p{{L}}\\p{{N}}\\s]', '', 'g')), '\\s+', ' ', 'g')) AS alias FROM n) n JOIN r x USING (kind, nn) JOIN r y ON y.kind = n.kind AND y.nn = n.alias WHERE x.rep <> y.rep
  UNION ALL SELECT a, b, 2, c FROM (SELECT x.rep AS a, y.rep AS b, round(len(list_intersect(x.g, y.g)) / (len(x.g) + len(y.g) - len(list_intersect(x.g, y.g))), 6) AS c FROM t x JOIN t y ON x.kind = y.kind AND x.nn < y.nn) WHERE c > 0.5
  UNION ALL SELECT a, b, CASE WHEN c >= 0.3 THEN 3 ELSE 4 END, c FROM (SELECT x.rep AS a, y.rep AS b, round(list_dot_product(x.e, y.e) / sqrt(list_dot_product(x.e, x.e) * list_dot_product(y.e, y.e)), 6) AS c FROM v x JOIN v y ON x.kind = y.kind AND x.rep < y.rep) WHERE c >= 0.2),
o AS (SELECT least(a, b) AS a, greatest(a, b) AS b, stage, CAST(score AS DOUBLE) AS score FROM s)
SELECT a, b, ['exact', 'alias', 'trigram', 'embedding', 'adjudicate'][stage + 1] AS decision, score FROM (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY stage, score DESC) AS k FROM o) WHERE k = 1
""",
    "soft_merge": """
WITH p AS (SELECT p_partkey AS id, p_size, first_value(p_partkey) OVER w AS win, first_value(p_size) OVER w AS sw FROM part WINDOW w AS (PARTITION BY p_brand, p_name ORDER BY p_partkey))
SELECT id, CASE WHEN id <> win AND p_size = sw THEN win END AS merged_into, CASE WHEN id <> win AND p_size = sw THEN 'merged' ELSE 'active' END AS status FROM p
""",
    "merge_root": "SELECT o_orderkey AS id, min(o_orderkey) OVER (PARTITION BY o_custkey) AS root FROM orders",
    "neighbours_1hop": f"WITH {_EDGES} SELECT seed, node, 1 AS hop FROM h1 WHERE node <> seed",
    "neighbours_2hop": f"WITH {_EDGES} SELECT seed, node, 1 AS hop FROM h1 UNION ALL SELECT DISTINCT seed, dst, 2 FROM h1 JOIN e ON e.src = node WHERE dst <> seed AND (seed, dst) NOT IN (SELECT seed, node FROM h1)",
    "cooccurrence_without_edge": """
WITH m AS (SELECT DISTINCT l_orderkey AS g, l_suppkey AS s FROM lineitem)
SELECT x.s AS a, y.s AS b, count(*) AS together FROM m x JOIN m y ON x.g = y.g AND x.s < y.s JOIN supplier p ON p.s_suppkey = x.s JOIN supplier q ON q.s_suppkey = y.s WHERE p.s_nationkey <> q.s_nationkey GROUP BY 1, 2 HAVING count(*) >= 2
""",
    "graph_json": """
SELECT 'node' AS kind, '{"id":' || r_regionkey || ',"name":"' || r_name || '"}' AS json FROM region UNION ALL SELECT 'edge', '{"src":' || n_nationkey || ',"dst":' || n_regionkey || ',"label":"in"}' FROM nation
""",
    "graph_mermaid": f"""SELECT 'n' || n_nationkey || '["' || n_name || '"] -->|in| n' || (r_regionkey + 1000) || '["' || r_name || '"]' AS line {_JOINED}""",
    "graph_cypher": f"""SELECT 'MERGE (a {{id: ''' || n_nationkey || ''', name: ''' || n_name || '''}}) MERGE (b {{id: ''' || (r_regionkey + 1000) || ''', name: ''' || r_name || '''}}) MERGE (a)-[:IN]->(b)' AS line {_JOINED}""",
    "graph_graphml": f"""SELECT 0 AS seq, '<node id="' || n_nationkey || '"><data key="name">' || n_name || '</data></node>' AS line FROM nation UNION ALL SELECT 1, '<edge source="' || n_nationkey || '" target="' || (r_regionkey + 1000) || '"/>' {_JOINED}""",
}
