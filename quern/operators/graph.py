"""Neighbourhoods, chains and exports of a graph of edges (src, dst)."""

from __future__ import annotations

import tempfile
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators.sizes import union


@cache
def _folder() -> str:
    return tempfile.mkdtemp(prefix="quern-")


def shared(spark: SparkSession) -> str:
    """The folder that all executors share, spark.checkpoint.dir of the session; only a
    local session may go without one set."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    named = named or _folder()
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the session's shared folder."""
    shared(df.sparkSession)
    return df.checkpoint()


def undirected(edges: DataFrame) -> DataFrame:
    return union([edges.select("src", "dst"), edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))]).where("src <> dst").distinct()


def neighbours(edges: DataFrame, seeds: DataFrame, hops: int = 1) -> DataFrame:
    """(seed, node, hop): nodes reached first at that hop."""
    e = undirected(edges)
    seen = seeds.select(F.col(seeds.columns[0]).alias("seed"), F.col(seeds.columns[0]).alias("node"), F.lit(0).alias("hop"))
    front = seen
    for h in range(1, hops + 1):
        step = front.join(e, front["node"] == e["src"]).select("seed", F.col("dst").alias("node")).distinct()
        known = seen.select(F.col("seed").alias("s"), F.col("node").alias("n"))
        front = step.join(known, (step["seed"] == F.col("s")) & (step["node"] == F.col("n")), "left_anti").withColumn("hop", F.lit(h))
        seen = union([seen, front])
    return seen.where("hop > 0")


def _together(members: DataFrame, group: str, item: str, least: int) -> DataFrame:
    """(a, b, together): items a < b of at least ``least`` common groups."""
    m = members.select(F.col(group).alias("g"), F.col(item).alias("a")).distinct()
    pairs = m.join(m.select(F.col("g").alias("g2"), F.col("a").alias("b")), (F.col("g") == F.col("g2")) & (F.col("a") < F.col("b")))
    return pairs.groupBy("a", "b").agg(F.count("*").alias("together")).where(F.col("together") >= least)


def unconnected_pairs(members: DataFrame, group: str, item: str, edges: DataFrame, least: int = 2) -> DataFrame:
    """(a, b, together): items of at least ``least`` common groups without an edge."""
    often, e = _together(members, group, item, least), undirected(edges)
    return often.join(e, (often["a"] == e["src"]) & (often["b"] == e["dst"]), "left_anti")


def apart(members: DataFrame, group: str, item: str, kinds: DataFrame, kind_item: str, kind: str, least: int = 2) -> DataFrame:
    """As ``unconnected_pairs`` where an edge joins any two items of one kind.  Such
    edges grow with the square of a kind, so each pair's kinds are compared instead;
    an item without a kind has no edge."""
    k = kinds.where(F.col(kind).isNotNull()).groupBy(F.col(kind_item).alias("i")).agg(F.collect_set(kind).alias("k"))
    ka, kb = k.select(F.col("i").alias("__a"), F.col("k").alias("__ka")), k.select(F.col("i").alias("__b"), F.col("k").alias("__kb"))
    often = _together(members, group, item, least)
    found = often.join(ka, F.col("a") == F.col("__a"), "left").join(kb, F.col("b") == F.col("__b"), "left")
    return found.where(~F.coalesce(F.arrays_overlap("__ka", "__kb"), F.lit(False))).select("a", "b", "together")


def to_json(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, json) lines."""
    a = nodes.select(F.lit("node").alias("kind"), F.to_json(F.struct(*nodes.columns)).alias("json"))
    return a.unionByName(edges.select(F.lit("edge").alias("kind"), F.to_json(F.struct(*edges.columns)).alias("json")))


def to_mermaid(edges: DataFrame) -> DataFrame:
    """(line) of a Mermaid flow chart without its head."""
    return edges.select(F.format_string('n%s["%s"] -->|%s| n%s["%s"]', F.col("src").cast("string"), F.col("src_name"), F.col("label"), F.col("dst").cast("string"), F.col("dst_name")).alias("line"))


def to_cypher(edges: DataFrame) -> DataFrame:
    q = lambda c: F.replace(F.replace(F.col(c), F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'"))
    return edges.select(F.concat(F.lit("MERGE (a {id: '"), F.col("src").cast("string"), F.lit("', name: '"), q("src_name"), F.lit("'}) MERGE (b {id: '"), F.col("dst").cast("string"), F.lit("', name: '"), q("dst_name"), F.lit("'}) MERGE (a)-[:"), F.upper("label"), F.lit("]->(b)")).alias("line"))


def to_graphml(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(seq, line) of a GraphML body: nodes before edges."""
    esc = lambda c: F.replace(F.replace(F.replace(c.cast("string"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
    a = nodes.select(F.lit(0).alias("seq"), F.concat(F.lit('<node id="'), esc(F.col("id")), F.lit('"><data key="name">'), esc(F.col("name")), F.lit("</data></node>")).alias("line"))
    b = edges.select(F.lit(1).alias("seq"), F.concat(F.lit('<edge source="'), esc(F.col("src")), F.lit('" target="'), esc(F.col("dst")), F.lit('"/>')).alias("line"))
    return a.unionByName(b)


def session(df: DataFrame) -> SparkSession:
    return df.sparkSession
