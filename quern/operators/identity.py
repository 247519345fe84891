"""Entity resolution: names, blocking, similarity, reversible merges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.errors import RecordError
from quern.functions import text
from quern.operators import dense
from quern.operators.sizes import union

TRIGRAM, BAND = 0.85, (0.80, 0.92)


def latest_entities(observations: DataFrame) -> DataFrame:
    """One row an id: the last observation's columns, first_seen the least and
    last_seen the greatest."""
    by = Window.partitionBy("id")
    order = by.orderBy(F.desc("observed_at"), F.desc("canonical_name"))
    rows = observations.withColumn("first_seen", F.min("first_seen").over(by)).withColumn("last_seen", F.max("last_seen").over(by))
    return rows.withColumn("__r", F.row_number().over(order)).where("__r = 1").drop("__r")


def find(entities: DataFrame, workspace: str, name: str) -> DataFrame:
    """Unmerged entities of a workspace with a name, however it is written."""
    wanted = text.normalised_name(F.lit(name))
    return entities.where((F.col("workspace_id") == workspace) & (F.col("normalised_name") == wanted) & F.col("merged_into").isNull())


def merge_event(winner: str, loser: str) -> tuple[str, str]:
    if winner == loser:
        raise RecordError("an entity cannot be merged into itself")
    return winner, loser


def merged_view(entities: DataFrame, merges: DataFrame, id_: str = "id") -> DataFrame:
    """merged_into and status from merge and unmerge events: the last event of a
    loser decides (kind merge or unmerge, seq its order)."""
    last = merges.groupBy(F.col("loser_id").alias("__l")).agg(F.max_by(F.struct("kind", "winner_id"), "seq").alias("__e"))
    into = F.when(F.col("__e.kind") == "merge", F.col("__e.winner_id"))
    out = entities.join(last, entities[id_] == F.col("__l"), "left").withColumn("merged_into", into)
    return out.withColumn("status", F.when(F.col("merged_into").isNull(), "active").otherwise("merged")).drop("__l", "__e")


def roots(edges: DataFrame, child: str, parent: str, ids: DataFrame, steps: int = 64) -> DataFrame:
    """(id, root) by pointer jumping: log2 of the longest chain joins, each cut."""
    from quern.operators.graph import cut

    cur = cut(ids.select(F.col(ids.columns[0]).alias("id")).join(edges.select(F.col(child).alias("c"), F.col(parent).alias("p")), F.col("id") == F.col("c"), "left").select("id", F.coalesce("p", "id").alias("root")))
    for _ in range(steps):
        far = cur.select(F.col("id").alias("i"), F.col("root").alias("far"))
        new = cut(cur.join(far, F.col("root") == F.col("i"), "left").select("id", "root", F.coalesce("far", "root").alias("next")))
        done = new.where("root <> next").isEmpty()
        cur = new.select("id", F.col("next").alias("root"))
        if done:
            # jumping may settle inside a cycle, whose members all have parents
            tops = cur.select(F.col("root").alias("__top")).distinct()
            if not tops.join(edges.select(F.col(child).alias("c")), F.col("__top") == F.col("c")).isEmpty():
                break
            return cur
    raise RecordError("merges form a cycle")


def trigram_pairs(entities: DataFrame, id_: str, name: str, block: list[str], least: float = TRIGRAM) -> DataFrame:
    """(a, b, similarity) of entities of one block whose names' trigrams have a
    Jaccard similarity of ``least`` at least.

    Names are compared once each: equal names are grouped first.  Within a block
    pairs are found by prefix filtering: at a similarity of t two sets of n
    trigrams share one of the rarest n - ceil(t*n) + 1, so only these are joined."""
    named = entities.where(F.col(name).isNotNull()).select(*block, F.col(id_).alias("id"), text.normalised_name(name).alias("nn")).where("nn <> ''")
    kinds = named.select(*block, "nn").distinct().withColumn("t", text.trigrams(F.col("nn")))
    grams = kinds.select(*block, "nn", F.explode("t").alias("g"))
    often = grams.groupBy("g").count()
    ranked = grams.join(often, "g").withColumn("r", F.row_number().over(Window.partitionBy(*block, "nn").orderBy("count", "g")))
    size = kinds.select(*block, "nn", F.size("t").alias("n"))
    prefix = ranked.join(size, [*block, "nn"]).where(F.col("r") <= F.col("n") - F.ceil(F.lit(least) * F.col("n") - 1e-9) + 1).select(*block, "nn", "g", "n")
    right = prefix.select(*[F.col(b).alias(f"{b}_b") for b in block], F.col("nn").alias("nn_b"), F.col("g").alias("g_b"), F.col("n").alias("n_b"))
    on = (F.col("g") == F.col("g_b")) & (F.col("nn") < F.col("nn_b")) & (F.col("n_b") >= least * F.col("n")) & (F.col("n") >= least * F.col("n_b"))
    for b in block:
        on = on & F.col(b).eqNullSafe(F.col(f"{b}_b"))
    some = prefix.join(right, on).select(*block, "nn", "nn_b").distinct()
    same = text.jaccard(text.trigrams(F.col("nn")), text.trigrams(F.col("nn_b")))
    near = some.withColumn("similarity", F.round(same, 6)).where(F.col("similarity") >= least)
    return near.unionByName(kinds.select(*block, "nn", F.col("nn").alias("nn_b"), F.lit(1.0).alias("similarity"))), named


def resolved_pairs(entities: DataFrame, id_: str, name: str, block: list[str], least: float = TRIGRAM) -> DataFrame:
    """(a, b, similarity), a < b, of entity ids."""
    near, named = trigram_pairs(entities, id_, name, block, least)
    left = named.select(*block, F.col("nn"), F.col("id").alias("x"))
    right = named.select(*[F.col(c).alias(f"{c}_r") for c in block], F.col("nn").alias("nn_r"), F.col("id").alias("y"))
    on = F.col("nn_b") == F.col("nn_r")
    for c in block:
        on = on & F.col(c).eqNullSafe(F.col(f"{c}_r"))
    pairs = near.join(left, [*block, "nn"]).join(right, on).where("x <> y AND (nn <> nn_b OR x < y)")
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "similarity")


def cosine_band(entities: DataFrame, id_: str, vector: str, block: str, band: tuple[float, float] = BAND, rows: int = dense.BLOCK) -> DataFrame:
    """(a, b, similarity) within a block whose vectors' cosine lies in the band:
    the pairs that a reviewer or model adjudicates.

    A block is cut into parts of about ``rows`` vectors, as many as its size needs,
    and every two parts of it are one matrix product; a pair that is not in the band
    is never a row.  Zero vectors have similarity 0; null ids, vectors and blocks
    are in no pair."""
    e = entities.where(F.col(vector).isNotNull() & F.col(id_).isNotNull() & F.col(block).isNotNull()).select(F.col(block).alias("k"), F.col(id_).alias("id"), F.col(vector).alias("v"))
    parts = e.groupBy(F.col("k").alias("__k")).agg(F.ceil(F.count("*") / rows).alias("__parts"))
    named = e.join(parts, F.col("k") == F.col("__k")).withColumn("part", F.pmod(F.xxhash64(F.col("id").cast("string")), F.col("__parts")))
    kind, key = e.schema["id"].dataType, e.schema["k"].dataType
    packed = T.StructType([T.StructField("k", key), T.StructField("part", T.LongType()), T.StructField("ids", T.ArrayType(kind)), T.StructField("m", T.BinaryType())])

    def pack(t: pa.Table) -> pa.Table:
        m = np.array(t.column("v").to_pylist(), np.float64)
        size = np.sqrt((m * m).sum(1))
        unit = m / np.where(size > 0, size, 1.0)[:, None]
        return pa.table({"k": t.column("k").slice(0, 1), "part": t.column("part").slice(0, 1), "ids": pa.array([t.column("id").to_pylist()], pa.list_(t.column("id").type)), "m": pa.array([unit.tobytes()], pa.binary())})

    blocks = named.select("k", "part", "id", "v").groupBy("k", "part").applyInArrow(pack, packed)
    other = blocks.select(F.col("k").alias("k2"), F.col("part").alias("part2"), F.col("ids").alias("ids2"), F.col("m").alias("m2"))
    pairs = blocks.join(other, (F.col("k") == F.col("k2")) & (F.col("part") <= F.col("part2")))
    schema = T.StructType([T.StructField("a", kind), T.StructField("b", kind), T.StructField("similarity", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                ids, ids2 = batch.column(0)[r].values, batch.column(1)[r].values
                x = np.frombuffer(batch.column(2)[r].as_py(), np.float64).reshape(len(ids), -1)
                y = np.frombuffer(batch.column(3)[r].as_py(), np.float64).reshape(len(ids2), -1)
                s = np.round(x @ y.T, 6)
                i, j = np.nonzero((s >= band[0]) & (s <= band[1]))
                if batch.column(4)[r].as_py():  # a part with itself
                    i, j = i[i < j], j[i < j]
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(i)), ids2.take(pa.array(j)), pa.array(s[i, j])], names=["a", "b", "similarity"])

    found = pairs.select("ids", "ids2", "m", "m2", (F.col("part") == F.col("part2")).alias("own")).mapInArrow(run, schema)
    return found.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "similarity")


STAGES = ("exact", "alias", "trigram", "embedding", "adjudicate")


def cascade(entities: DataFrame, id_: str, name: str, kind: str, aliases: str, vectors: DataFrame | None = None, trigram: float = TRIGRAM, band: tuple[float, float] = BAND) -> DataFrame:
    """(a, b, decision, score), a < b: what resolution says of entities of one kind.

    The first stage that fits decides: exact, the same normalised name; alias, the name
    of one is an alias of the other; trigram, names' similarity above ``trigram``;
    embedding, cosine at the band's upper end or above; adjudicate, cosine within the
    band, which a reviewer or model must settle.  ``vectors`` are (id, embedding).
    Entities of one name are linked to the least id of it, which stands for them in the
    later stages, so no stage lists all pairs of a name.  Null names and kinds, and
    names without letters or digits, are in no pair."""
    named = entities.where(F.col(name).isNotNull() & F.col(kind).isNotNull()).select(F.col(id_).alias("id"), F.col(kind).alias("kind"), text.normalised_name(name).alias("nn"), F.col(aliases).alias("aliases")).where("nn <> ''")
    reps = named.groupBy("kind", "nn").agg(F.min("id").alias("rep"))
    exact = named.join(reps, ["kind", "nn"]).where("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b"), F.lit(0).alias("stage"), F.lit(1.0).alias("score"))
    other = reps.select(F.col("kind").alias("k2"), F.col("nn").alias("nn2"), F.col("rep").alias("rep2"))
    told = named.select("kind", "nn", F.explode("aliases").alias("alias")).withColumn("alias", text.normalised_name("alias")).where("alias <> '' AND alias <> nn").distinct()
    told = told.join(reps, ["kind", "nn"]).join(other, (F.col("kind") == F.col("k2")) & (F.col("alias") == F.col("nn2")))
    alias = told.select(F.col("rep").alias("a"), F.col("rep2").alias("b"), F.lit(1).alias("stage"), F.lit(1.0).alias("score"))
    near, _ = trigram_pairs(reps, "rep", "nn", ["kind"], trigram)
    near = near.where((F.col("nn") != F.col("nn_b")) & (F.col("similarity") > trigram)).join(reps, ["kind", "nn"]).join(other, (F.col("kind") == F.col("k2")) & (F.col("nn_b") == F.col("nn2")))
    found = [exact, alias, near.select(F.col("rep").alias("a"), F.col("rep2").alias("b"), F.lit(2).alias("stage"), F.col("similarity").alias("score"))]
    if vectors is not None:
        v = vectors.select(F.col(vectors.columns[0]).alias("__v"), F.col(vectors.columns[1]).alias("embedding"))
        banded = cosine_band(reps.join(v, F.col("rep") == F.col("__v")), "rep", "embedding", "kind", (band[0], 1.0 + 1e-6))
        found.append(banded.select("a", "b", F.when(F.col("similarity") >= band[1], 3).otherwise(4).alias("stage"), F.col("similarity").alias("score")))
    pairs = union([f.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "stage", "score") for f in found])
    best = pairs.groupBy("a", "b").agg(F.min(F.struct("stage", (-F.col("score")).alias("less"))).alias("m"))
    return best.select("a", "b", F.get(F.array(*[F.lit(x) for x in STAGES]), F.col("m.stage")).alias("decision"), F.round(-F.col("m.less"), 6).alias("score"))
